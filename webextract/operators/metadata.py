"""A page's metadata: meta tags, schema.org items, and the chains of fallbacks over them. '' stands for what isn't known."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from typing import Any
from urllib.parse import urljoin, urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame

from webextract.css import matcher, select
from webextract.htmltree import Node, parse

FIELDS = ("title", "description", "domain", "favicon", "image", "published", "author", "site")


def meta_tags(document: Node) -> list[dict[str, str | None]]:
    """name, property and content of every meta tag with content, in order."""
    return [{"name": n.attrs.get("name"), "property": n.attrs.get("property"), "content": n.attrs["content"]} for n in document.find("meta") if n.get("content")]


# schema.org


def clean_json_ld(text: str) -> str:
    """Without comments and CDATA marks; '' if what is left isn't an object or array."""
    text = re.sub(r"<!--.*?-->", "", text, flags=re.S)
    text = re.sub(r"/\*.*?\*/", "", text, flags=re.S)
    text = re.sub(r"^[ \t]*//[^\n]*$", "", text, count=1, flags=re.M)
    text = re.sub(r"^\s*<!\[CDATA\[(.*?)\]\]>\s*$", r"\1", text, flags=re.S)
    text = re.sub(r"^\s*(?:\*/|/\*)\s*|\s*(?:\*/|/\*)\s*$", "", text).strip()
    return text if (text[:1], text[-1:]) in (("{", "}"), ("[", "]")) else ""


def is_schema_item(item: Any) -> bool:
    if not isinstance(item, dict):
        return False
    for k in ("@type", "type"):
        if isinstance(item.get(k), (str, list)) and item[k]:
            return True
    if isinstance(item.get("@id"), str) and item["@id"]:
        return "schema.org" in item["@id"] or "http" in item["@id"]
    return sum(k in item for k in ("name", "description", "url", "image", "author", "publisher")) >= 2


def _mirrored(item: dict) -> dict:
    """type and @type, where one of them is there, as both."""
    out = dict(item)
    if "@type" in item:
        out.setdefault("type", item["@type"])
    elif "type" in item:
        out["@type"] = item["type"]
    return out


def schema_items(document: Node) -> list[dict]:
    """Items of all JSON-LD scripts; a script that isn't JSON is left out. The JSON is taken as it is, without fetching contexts."""
    out = []
    for script in select(document, 'script[type="application/ld+json"]'):
        cleaned = clean_json_ld(script.text().strip())
        if not cleaned:
            continue
        try:
            data = json.loads(cleaned)
        except ValueError:
            continue
        for top in data if isinstance(data, list) else [data]:
            items = top["@graph"] if isinstance(top, dict) and "@graph" in top else top
            out.extend(_mirrored(i) for i in (items if isinstance(items, list) else [items]) if is_schema_item(i))
    return out


def item_types(items: list[dict]) -> list[str]:
    found = [t for i in items for t in (i.get("@type", i.get("type")) if isinstance(i.get("@type", i.get("type")), list) else [i.get("@type", i.get("type"))])]
    return list(dict.fromkeys(t for t in found if isinstance(t, str)))


def _number(x: Any) -> str:
    return str(int(x)) if float(x).is_integer() else repr(float(x))


def _search(data: Any, path: list[str], exact: bool) -> list[str]:
    if isinstance(data, str):
        return [] if path else [data]
    if isinstance(data, list):
        if path and re.fullmatch(r"\[[0-9]+\]", path[0]):
            at = int(path[0][1:-1])
            return _search(data[at], path[1:], exact) if at < len(data) else []
        plain = lambda x: isinstance(x, str) or (isinstance(x, (int, float)) and not isinstance(x, bool))
        if not path and all(map(plain, data)):
            return [x if isinstance(x, str) else _number(x) for x in data]
        return [r for x in data for r in _search(x, path, exact)]
    if isinstance(data, dict):
        if not path:
            return [data["name"]] if isinstance(data.get("name"), str) else []
        if path[0] in data:
            return _search(data[path[0]], path[1:], True)
        if not exact:
            return [r for v in data.values() if isinstance(v, dict) for r in _search(v, path, False)]
    return []


def schema_property(items: Any, path: str) -> str:
    """Values at a dotted path, joined by ", "; first the path as it stands, then also below objects that lack its first name."""
    if not items:
        return ""
    names = path.split(".")
    found = _search(items, names, True) or _search(items, names, False)
    return ", ".join(x for x in found if x)


def schema_values(pages: DataFrame, paths: list[str]) -> DataFrame:
    """pages: page_id, html. Returns page_id, items (JSON, '' without any), types, and the values at each of the paths."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [schema_items(parse(html or "")) for html in batch.column(1).to_pylist()]
            columns = [[json.dumps(i, ensure_ascii=False, sort_keys=True) if i else "" for i in found], [item_types(i) for i in found], [[schema_property(i, p) for p in paths] for i in found]]
            kinds = [pa.string(), pa.list_(pa.string()), pa.list_(pa.string())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds))], names=["page_id", "items", "types", "values"])

    source = pages.select("page_id", "html")
    return source.mapInArrow(run, f"page_id {source.schema['page_id'].dataType.simpleString()}, items string, types array<string>, `values` array<string>")


# Chains


def _first(*values: str) -> str:
    return next((v for v in values if v), "")


def domain_of(url: str) -> str:
    try:
        return (_host(url) or "").removeprefix("www.")
    except ValueError:
        return ""


def _host(url: str) -> str:
    """The host as it is written, without user and port."""
    if re.match(r"^[^a-zA-Z]*:", url) or re.search(r"[\x00-\x20\x7f]", url.split("?")[0].split("#")[0].partition("://")[2].partition("/")[0]):
        return ""
    place = urlsplit(url).netloc.rpartition("@")[2]
    m = re.fullmatch(r"(\[[^\]]*\]|[^:]*)(?::[0-9]*)?", place)
    return m[1].strip("[]") if m else ""


def clean_title(title: str, site: str) -> str:
    if title and site:
        quoted = re.escape(site)
        for pattern in (rf"\s*[|\-–—]\s*{quoted}\s*$", rf"^\s*{quoted}\s*[|\-–—]\s*"):
            shorter = re.sub(pattern, "", title, count=1, flags=re.I)
            if shorter != title:
                title = shorter
                break
    return title.strip()


def author_list(names: list[str]) -> str:
    cleaned = (n.strip().removesuffix(",").strip() for n in names)
    return ", ".join(list(dict.fromkeys(n for n in cleaned if n))[:10])


class Lookup:
    """The sources that the chains read."""

    def __init__(self, document: Node, items: list[dict], tags: list[dict]) -> None:
        self.elements, self.items, self.tags = document.elements(), items, tags

    def first(self, selector: str) -> Node | None:
        test = matcher(selector)
        return next((n for n in self.elements if test(n)), None)

    def meta(self, attribute: str, value: str) -> str:
        return next((t["content"] or "" for t in self.tags if t[attribute] == value), "")

    def name(self, value: str) -> str:
        return self.meta("name", value)

    def prop(self, value: str) -> str:
        return self.meta("property", value)

    def schema(self, path: str) -> str:
        return schema_property(self.items, path)

    def attr(self, selector: str, name: str) -> str:
        n = self.first(selector)
        return n.get(name) if n is not None else ""

    def url(self, given: str) -> str:
        return _first(given, self.prop("og:url"), self.prop("twitter:url"), self.schema("url"), self.schema("mainEntityOfPage.url"), self.schema("mainEntity.url"), self.schema("WebSite.url"), self.attr('link[rel="canonical"]', "href"), self.attr("base[href]", "href"))

    def dom_authors(self) -> list[str]:
        out = []
        for selector in ('[itemprop="author"]', ".author", '[href*="author"]', ".authors a"):
            for n in filter(matcher(selector), self.elements):
                out.extend(x for part in n.text().split(",") if (x := part.strip()) and x.lower() not in ("author", "authors"))
        return out

    def author(self) -> str:
        direct = _first(self.name("sailthru.author"), self.prop("author"), self.name("author"), self.name("byl"), self.name("authorList"))
        if direct:
            return direct
        for path in ("author.name", "author.[].name"):
            if found := self.schema(path):
                return author_list(found.split(","))
        if found := author_list(self.dom_authors()):
            return found
        return _first(self.name("copyright"), self.schema("copyrightHolder.name"), self.prop("og:site_name"), self.schema("publisher.name"), self.schema("sourceOrganization.name"), self.schema("isPartOf.name"), self.name("twitter:creator"), self.name("application-name"))

    def site(self, author: str) -> str:
        return _first(self.schema("publisher.name"), self.prop("og:site_name"), self.schema("WebSite.name"), self.schema("sourceOrganization.name"), self.name("copyright"), self.schema("copyrightHolder.name"), self.schema("isPartOf.name"), self.name("application-name"), author)

    def title(self, site: str) -> str:
        page = self.first("title")
        raw = _first(self.prop("og:title"), self.name("twitter:title"), self.schema("headline"), self.name("title"), self.name("sailthru.title"), page.text().strip() if page is not None else "")
        return clean_title(raw, site)

    def description(self) -> str:
        return _first(self.name("description"), self.prop("description"), self.prop("og:description"), self.schema("description"), self.name("twitter:description"), self.name("sailthru.description"))

    def image(self) -> str:
        return _first(self.prop("og:image"), self.name("twitter:image"), self.schema("image.url"), self.schema("image"), self.name("sailthru.image.full"), self.name("sailthru.image.thumb"))

    def favicon(self, url: str) -> str:
        href = _first(self.attr('link[rel*="icon"]', "href"), self.name("msapplication-TileImage"), "/favicon.ico")
        if href.startswith("http") or not url:
            return href
        try:
            return urljoin(url, href)
        except ValueError:
            return href

    def published(self) -> str:
        return _first(self.schema("datePublished"), self.prop("article:published_time"), self.name("sailthru.date"), self.name("date"), self.attr("time[datetime]", "datetime"))


def metadata(document: Node, url: str = "", items: list[dict] | None = None, tags: list[dict] | None = None) -> dict[str, str]:
    look = Lookup(document, schema_items(document) if items is None else items, meta_tags(document) if tags is None else tags)
    url = look.url(url)
    author = look.author()
    site = look.site(author)
    return {
        "title": look.title(site),
        "description": look.description(),
        "domain": domain_of(url),
        "favicon": look.favicon(url),
        "image": look.image(),
        "published": look.published(),
        "author": author,
        "site": site,
    }
