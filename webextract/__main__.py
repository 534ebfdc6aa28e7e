"""python -m webextract parse <file or URL>: extracts one page."""

from __future__ import annotations

import argparse
import sys
from dataclasses import replace

from webextract.constants import patterns_from
from webextract.options import Options
from webextract.plans.extract import timed_page
from webextract.sources import sinks, web
from webextract.sources.charset import decode_page


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="webextract")
    parse = parser.add_subparsers(dest="command", required=True).add_parser("parse", help="extract one page")
    parse.add_argument("source")
    parse.add_argument("-j", "--json", action="store_true")
    parse.add_argument("-m", "--markdown", "--md", action="store_true")
    parse.add_argument("-p", "--property", default="")
    parse.add_argument("-o", "--output", default="")
    parse.add_argument("--user-agent", default=web.USER_AGENT)
    parse.add_argument("-H", "--header", action="append", default=[])
    parse.add_argument("--timeout", type=float, default=web.TIMEOUT)
    parse.add_argument("--proxy", default="")
    parse.add_argument("--debug", action="store_true")
    parse.add_argument("--patterns", default="", help="file of substrings that mark clutter, one a line; turns the pass on")
    args = parser.parse_args(argv)
    try:
        client = web.Client(args.user_agent, args.timeout, web.parse_headers(args.header), args.proxy)
        # As a request that names no selector passes: both are off.
        options = Options.zero(debug=args.debug, markdown=args.markdown, separate_markdown=args.markdown, url=args.source)
        if args.patterns:
            with open(args.patterns, encoding="utf-8") as f:
                options = replace(options, remove_partial_selectors=True, partial_patterns=patterns_from(f))
        if web.is_url(args.source):
            r = web.fetch(args.source, client)
            if r.error or r.status >= 400:
                raise web.HTTPStatusError(args.source, r.status) if r.status else OSError(r.error)
            html = decode_page(r.body, r.content_type)
        else:
            if ".." in args.source.split("/"):
                raise ValueError(f"the path leads upwards: {args.source}")
            with open(args.source, "rb") as f:
                html = decode_page(f.read())
        record = timed_page(html, args.source, options)
        if args.debug:
            return 0
        if args.property:
            text = sinks.property_of(record, args.property)
        else:
            text = sinks.contract(record) if args.json else sinks.markdown_of(record) if args.markdown else record["content"]
        sinks.write_text(text, args.output)
    except (OSError, ValueError, sinks.PropertyNotFound, web.HTTPStatusError) as e:
        print(f"{type(e).__name__}: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
