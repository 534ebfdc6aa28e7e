"""The whole extraction of a page, and of a table or stream of pages. It is a narrow plan: no shuffle, one Arrow pass."""

from __future__ import annotations

import json
import time
from collections.abc import Iterator
from dataclasses import replace

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webextract.htmltree import Node, parse
from webextract.operators import extractors, metadata, removal, routing, scoring, standardize
from webextract.operators.markdown import to_markdown
from webextract.options import Options, merge_options

#: A page with fewer words is tried again without the partial patterns.
SPARSE_WORDS = 200

SCHEMA = (
    "title string, description string, domain string, favicon string, image string, published string, author string, site string, word_count int, content string, content_markdown string, extractor_type string, "
    "meta_tags array<struct<name:string,property:string,content:string>>, schema_org_data string, debug_info struct<extractor_used:string,main_content:string,elements_before:int,elements_after:int,elements_removed:int,"
    "images:int,links:int,words:int,characters:int,steps:array<string>,removed:array<struct<reason:string,selector:string,text:string>>>, error string"
)
CONTRACT = {"word_count": "wordCount", "content_markdown": "contentMarkdown", "extractor_type": "extractorType", "meta_tags": "metaTags", "schema_org_data": "schemaOrgData", "debug_info": "debugInfo"}


_REGISTERED: list[tuple[str, tuple, object]] = []


def register_extractor(name: str, patterns: tuple[str, ...], function) -> None:
    """A site extractor for all later extractions of this session, after the built-in ones and those registered before.

    function(tree, url, schema items) gives {content_html, extracted, variables}, or None to pass; it is sent to the executors.
    """
    _REGISTERED.append((name, tuple(patterns), function))


def registered_extractors() -> tuple[tuple[str, tuple], ...]:
    """Names and patterns of all rules, in the order in which they are tried."""
    return routing.BUILTIN + tuple((n, p) for n, p, _ in _REGISTERED)


def clear_extractors() -> None:
    """Forgets the registered ones."""
    _REGISTERED.clear()


def _with_registered(options: Options | None) -> Options:
    options = merge_options(options)
    new = tuple(r for r in _REGISTERED if r not in options.extractors)
    return replace(options, extractors=options.extractors + new) if new else options


def _attempt(document: Node, meta: dict, options: Options) -> tuple[str, int, dict]:
    """Content, its words, and what was done. Changes the document."""
    before = sum(1 for n in document.walk() if n.kind == "element")
    log: removal.Log = []
    steps = []
    removal.apply_mobile_styles(document, options.mobile_styles)
    small = removal.small_images(document)
    main, how = scoring.main_content(document)
    steps.append(f"main content: {how}")
    if main is None:
        return "", 0, {"steps": steps}
    removal.remove_small_images(document, small, log)
    if options.remove_images:
        removal.remove_all_images(document, log)
    removal.remove_hidden(document, log)
    removal.remove_by_score(document, log)
    if options.remove_exact_selectors:
        removal.remove_exact(document, log)
    if options.remove_partial_selectors:
        removal.remove_partial(document, log, options.partial_patterns)
    steps.append(f"removed {len(log)} elements")
    standardize.standardize(main, meta["title"], options.debug)
    content = main.inner_html()
    words = standardize.count_words(content)
    inside = main.elements()
    facts = {
        "main_content": how,
        "elements_before": before,
        "elements_after": len(inside),
        "elements_removed": max(0, before - len(inside)),
        "images": sum(n.tag == "img" for n in inside),
        "links": sum(n.tag == "a" for n in inside),
        "words": words,
        "characters": len(content.encode()),
        "steps": steps,
        "removed": [{"reason": r, "selector": s, "text": n.text().strip()[:100]} for r, s, n in log],
    }
    return content, words, facts


def extract_page(html: str | None, url: str | None = "", options: Options | None = None) -> dict:
    """The result record of one page; options None are the defaults, with both selector passes on."""
    options = _with_registered(options)
    html, url = html or "", options.url or url or ""
    document = parse(html)
    items, tags = metadata.schema_items(document), metadata.meta_tags(document)
    meta = metadata.metadata(document, url, items, tags)
    record = meta | {"meta_tags": tags, "schema_org_data": json.dumps(items, ensure_ascii=False, sort_keys=True) if items else None, "extractor_type": None, "content_markdown": None, "debug_info": None, "error": None}
    functions = extractors.EXTRACTORS | {name: f for name, _, f in options.extractors}
    name = routing.route(url, routing.BUILTIN + tuple((n, p) for n, p, _ in options.extractors))
    site = functions[name](document.copy(), url, items) if name else None
    if site is not None:
        content, variables = site["content_html"], site["variables"]
        for k in ("title", "author", "published", "description", "image"):
            record[k] = variables.get(k) or record[k]
        record["site"] = variables.get("site", record["site"])
        record["extractor_type"] = name
        words, facts = standardize.count_words(content), {"extractor_used": name, "steps": [f"extractor: {name}"]}
    else:
        # Without elements for the partial patterns the second attempt would be the first one again.
        retry = document.copy() if options.remove_partial_selectors and removal.partial_matches(document, options.partial_patterns) else None
        content, words, facts = _attempt(document, meta, options)
        if words < SPARSE_WORDS and retry is not None:
            other = _attempt(retry, meta, merge_options(options, _without_partial(options)))
            if other[1] > words:
                content, words, facts = other
    record |= {"content": content, "word_count": words}
    if options.markdown or options.separate_markdown:
        record["content_markdown"] = to_markdown(content)
    if options.debug:
        record["debug_info"] = facts
    return record


def _without_partial(options: Options) -> Options:
    return replace(options, remove_partial_selectors=False)


def _empty(error: str) -> dict:
    return dict.fromkeys(metadata.FIELDS, "") | {"word_count": 0, "content": "", "content_markdown": None, "extractor_type": None, "meta_tags": [], "schema_org_data": None, "debug_info": None, "error": error}


def spread(rows: DataFrame) -> DataFrame:
    """Rows of fewer files than there are cores dealt out, as a small file may be one row group, which one task reads; others as they are."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    few = rows.rdd.getNumPartitions() <= 4 * cores and len(rows.inputFiles()) < cores
    return rows.repartition(cores) if few else rows


def extract(pages: DataFrame, options: Options | None = None) -> DataFrame:
    """pages: page_id, url, html (batch or streaming). Returns page_id, url and the result columns, a row for each page.

    A null or empty html gives an empty record. A page that fails has its message in `error` and doesn't fail the job; so has one over
    options.max_html_chars.
    """
    kinds = {f.name: f.dataType.simpleString() for f in pages.schema.fields}
    options = _with_registered(options)
    most = options.max_html_chars
    # Only the types of the schema's columns are needed on the executors.
    schema = f"page_id {kinds['page_id']}, url {kinds['url']}, {SCHEMA}"
    types = _arrow_types(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, len(whole), 200):
                batch = whole.slice(i, 200)
                rows = []
                for url, html in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                    try:
                        rows.append(_empty(f"over {most} characters") if most and len(html or "") > most else extract_page(html, url, options))
                    except Exception as e:  # one bad page must not fail the job
                        rows.append(_empty(f"{type(e).__name__}: {e}"))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array([r[f.name] for r in rows], f.type) for f in types)], names=["page_id", "url", *(f.name for f in types)])

    return pages.select("page_id", "url", "html").mapInArrow(run, schema)


def _arrow_types(spark) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(spark.createDataFrame([], SCHEMA).schema)


def contract_column(results: DataFrame) -> Column:
    """The record as JSON in the public field names."""
    return F.to_json(F.struct(*(F.col(c).alias(CONTRACT.get(c, c)) for c in results.columns if c not in ("page_id", "url", "error"))))


def to_contract_json(results: DataFrame) -> DataFrame:
    """page_id and the record as JSON."""
    return results.select("page_id", contract_column(results).alias("json"))


def summary(record: dict) -> str:
    """What was done to a page, as lines of text; '' without debug information."""
    facts = record.get("debug_info")
    if not facts:
        return ""
    lines = [f"Extractor: {facts.get('extractor_used') or 'none'}", f"Main content: {facts.get('main_content', '')}"]
    lines += [f"{name.replace('_', ' ').capitalize()}: {facts[name]}" for name in ("elements_before", "elements_after", "elements_removed", "images", "links", "words", "characters") if name in facts]
    lines += [f"Step {i}: {step}" for i, step in enumerate(facts.get("steps", []), 1)]
    lines += [f"Removed ({r['reason']}{' ' + r['selector'] if r['selector'] else ''}): {r['text']}" for r in facts.get("removed", [])]
    if "parse_time" in record:
        lines.append(f"Parse time: {record['parse_time']} ms")
    return "\n".join(lines)


def timed_page(html: str, url: str = "", options: Options | None = None) -> dict:
    start = time.perf_counter()
    return extract_page(html, url, options) | {"parse_time": int((time.perf_counter() - start) * 1000)}
