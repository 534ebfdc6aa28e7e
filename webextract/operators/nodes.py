"""The node table: one row for each node of each page, and operators over it as filters, joins, windows and aggregates.

pre numbers a page's nodes in document order and post is the last pre below a node, so `b` is below `a` where a.pre < b.pre <= a.post.
All joins carry page_id, so they are hash or merge joins with the interval as a residual.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from webextract import constants as C
from webextract.css import Chain, SelectorIndex, Test, parse_selector
from webextract.htmltree import Node, parse
from webextract.operators.removal import HIDDEN, SMALL, partial_regex
from webextract.operators.scoring import BYLINE_PATTERN, DATE_PATTERN

COUNTED = ("p", "a", "img", "ul", "ol", "table", "td")
SCHEMA = "pre int, post int, parent int, depth int, sib int, kind string, tag string, ns string, attrs map<string,string>, text string, subtree_text string, n_words int, " + ", ".join(f"n_{t} int" for t in COUNTED) + ", n_note_refs int, n_note_lists int"
_MARKS = (SelectorIndex(C.FOOTNOTE_REFERENCES), SelectorIndex(C.FOOTNOTE_LISTS))


def node_rows(document: Node) -> list[tuple]:
    """One tuple in the order of SCHEMA for each node below the document."""
    order: list[tuple[Node, int, int, int]] = []
    stack = [(c, -1, 0, i) for i, c in reversed(list(enumerate(document.children)))]
    while stack:
        n, parent, depth, sib = stack.pop()
        me = len(order)
        order.append((n, parent, depth, sib))
        stack.extend((c, me, depth + 1, i) for i, c in reversed(list(enumerate(n.children))))
    size = len(order)
    post, counts = list(range(size)), [[0] * (len(COUNTED) + len(_MARKS)) for _ in range(size)]
    texts: list[list[str]] = [[] for _ in range(size)]
    for i in range(size - 1, -1, -1):
        n, parent, _, _ = order[i]
        if n.kind == "text":
            texts[i].append(n.data)
        if parent >= 0:
            post[parent] = max(post[parent], post[i])
            texts[parent][:0] = texts[i]
            for k, t in enumerate(COUNTED):
                counts[parent][k] += counts[i][k] + (n.kind == "element" and n.tag == t)
            for k, index in enumerate(_MARKS, len(COUNTED)):
                counts[parent][k] += counts[i][k] + bool(n.kind == "element" and (n.attrs or n.tag == "ol") and index.matches(n))
    out = []
    for i, (n, parent, depth, sib) in enumerate(order):
        whole = "".join(texts[i])
        out.append((i, post[i], parent if parent >= 0 else None, depth, sib, n.kind, n.tag, n.ns, n.attrs, n.data if n.kind != "element" else None, whole if n.kind == "element" else None, len(whole.split()), *counts[i]))
    return out


def parse_nodes(pages: DataFrame) -> DataFrame:
    """pages: page_id, html. A null html is an empty page."""
    from pyspark.sql.pandas.types import to_arrow_schema

    kinds = to_arrow_schema(pages.sparkSession.createDataFrame([], SCHEMA).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, len(whole), 100):
                part = whole.slice(i, 100)
                rows, at = [], []
                for k, html in enumerate(part.column(1)):
                    found = node_rows(parse(html.as_py()))
                    rows.extend(found)
                    at.extend([k] * len(found))
                columns = [pa.array([list(r[j].items()) if f.name == "attrs" else r[j] for r in rows], f.type) for j, f in enumerate(kinds)]
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(at, pa.int64())), *columns], names=["page_id", *kinds.names])

    source = pages.select("page_id", F.coalesce("html", F.lit("")).alias("html"))
    return source.mapInArrow(run, f"page_id {source.schema['page_id'].dataType.simpleString()}, {SCHEMA}")


# Selectors as column predicates


def _attr(name: str) -> Column:
    return F.col("attrs")[name]


def _test(t: Test) -> Column:
    if t.kind == "tag":
        return F.col("tag") == t.value
    if t.kind == "class":
        return F.coalesce(F.array_contains(F.split(F.trim(_attr("class")), r"[ \t\n\f\r]+"), t.value), F.lit(False))
    if t.kind == "attr":
        v = F.lower(_attr(t.name)) if t.fold else _attr(t.name)
        if t.op == "":
            return v.isNotNull()
        if t.op != "=" and not t.value:
            return F.lit(False)
        found = {"=": v == t.value, "^=": v.startswith(t.value), "$=": v.endswith(t.value), "*=": v.contains(t.value)}[t.op]
        return F.coalesce(found, F.lit(False))
    if t.kind == "not":
        return ~reduce(Column.__or__, [reduce(Column.__and__, [_test(x) for x in chain[0][1]]) for chain in t.inner])
    return F.lit(True)


def _compound(tests: tuple[Test, ...]) -> Column:
    return (F.col("kind") == "element") & reduce(Column.__and__, [_test(t) for t in tests])


def predicate(selector: str) -> Column:
    """A selector without combinators as a condition on a node."""
    chains = parse_selector(selector)
    if any(len(c) > 1 for c in chains):
        raise ValueError(f"{selector!r} asks for ancestors; use select_nodes()")
    return reduce(Column.__or__, [_compound(c[0][1]) for c in chains])


def _chain(nodes: DataFrame, chain: Chain) -> DataFrame:
    found = nodes.where(_compound(chain[0][1]))
    for how, tests in chain[1:]:
        above = found.select(F.col("page_id").alias("p"), F.col("pre").alias("from"), F.col("post").alias("to"))
        below = nodes.where(_compound(tests))
        inside = (F.col("parent") == F.col("from")) if how == ">" else (F.col("pre") > F.col("from")) & (F.col("pre") <= F.col("to"))
        found = below.join(above, (F.col("page_id") == F.col("p")) & inside, "left_semi")
    return found


def select_nodes(nodes: DataFrame, selector: str) -> DataFrame:
    """The nodes that a selector matches; ancestors are semi-joins on intervals."""
    chains = parse_selector(selector)
    simple = [c for c in chains if len(c) == 1]
    parts = [nodes.where(reduce(Column.__or__, [_compound(c[0][1]) for c in simple]))] if simple else []
    parts += [_chain(nodes, c) for c in chains if len(c) > 1]
    return parts[0] if len(parts) == 1 else reduce(DataFrame.unionByName, parts).dropDuplicates(["page_id", "pre"])


# Operators


def meta_tags(nodes: DataFrame) -> DataFrame:
    """page_id, pre, name, property, content of meta tags with content."""
    return nodes.where((F.col("kind") == "element") & (F.col("tag") == "meta") & (F.coalesce(_attr("content"), F.lit("")) != "")).select("page_id", "pre", _attr("name").alias("name"), _attr("property").alias("property"), _attr("content").alias("content"))


def links(nodes: DataFrame) -> DataFrame:
    return nodes.where((F.col("tag") == "a") & _attr("href").isNotNull()).select("page_id", "pre", _attr("href").alias("href"), F.trim("subtree_text").alias("text"))


def score_blocks(nodes: DataFrame) -> DataFrame:
    """page_id, pre, tag and score of every block (div, section, article, main): one scan, as subtree counts are columns."""
    text, words = F.trim("subtree_text"), F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    style, look = F.coalesce(_attr("style"), F.lit("")), F.lower(F.coalesce(_attr("class"), F.lit("")))
    yes = lambda condition, value: F.when(condition, F.lit(float(value))).otherwise(F.lit(0.0))
    blocks = nodes.where((F.col("kind") == "element") & F.col("tag").isin("div", "section", "article", "main"))
    scored = blocks.select(
        "page_id",
        "pre",
        "tag",
        (
            F.col("n_words")
            + F.col("n_p") * 10.0
            - F.col("n_a") / words * 5
            - F.col("n_img") / words * 3
            - F.col("n_table") * 5.0
            + yes(style.contains("float: right") | style.contains("text-align: right") | (F.coalesce(_attr("align"), F.lit("")) == "right"), 5)
            + yes(text.rlike("(?i)" + DATE_PATTERN), 10)
            + yes(text.rlike("(?i)" + BYLINE_PATTERN), 10)
            + yes(look.rlike("content|article|post"), 15)
            + yes(F.col("n_note_refs") > 0, 10)
            + yes(F.col("n_note_lists") > 0, 10)
        ).alias("score"),
    )
    return scored


def entry_points(nodes: DataFrame) -> DataFrame:
    """page_id, pre, selector: the main content by the list of entry points, the first of the list and then of the page."""
    places = F.array(*[F.when(predicate(s), F.lit(i)) for i, s in enumerate(C.ENTRY_POINTS)])
    found = nodes.withColumn("place", F.array_min(places)).where("place IS NOT NULL")
    best = found.groupBy("page_id").agg(F.min(F.struct("place", "pre")).alias("b"))
    names = F.element_at(F.array(*map(F.lit, C.ENTRY_POINTS)), F.col("b.place") + 1)
    return best.select("page_id", F.col("b.pre").alias("pre"), names.alias("selector"))


def best_block(nodes: DataFrame, over: float = 50.0) -> DataFrame:
    """page_id, pre, score of the first of the highest scores over the limit."""
    return score_blocks(nodes).groupBy("page_id").agg(F.max(F.struct("score", (-F.col("pre")).alias("neg"))).alias("b")).where(F.col("b.score") > over).select("page_id", (-F.col("b.neg")).alias("pre"), F.col("b.score").alias("score"))


def hidden(nodes: DataFrame) -> DataFrame:
    style = F.lower(_attr("style"))
    return nodes.where((F.col("kind") == "element") & reduce(Column.__or__, [style.contains(h) for h in HIDDEN]))


def identifier() -> Column:
    own = lambda name: F.when(F.coalesce(_attr(name), F.lit("")) != "", _attr(name))
    img = F.when(F.col("tag") == "img", F.coalesce(F.concat(F.lit("src:"), own("data-src")), F.concat(F.lit("src:"), own("src")), F.concat(F.lit("srcset:"), own("srcset")), F.concat(F.lit("srcset:"), own("data-srcset"))))
    box = F.when(F.col("tag") == "svg", F.concat(F.lit("viewBox:"), own("viewBox")))
    return F.coalesce(img, F.concat(F.lit("id:"), own("id")), box, F.concat(F.lit("class:"), own("class")))


def small_images(nodes: DataFrame) -> DataFrame:
    """Images that share an identifier with one of a width or height of 1 to 32."""
    images = nodes.where(F.col("tag").isin("img", "svg")).withColumn("identifier", identifier())
    size = lambda name: F.when(_attr(name).rlike(r"^[+-]?\d+$"), _attr(name).try_cast("int")).between(1, SMALL - 1)
    small = images.where((F.coalesce(size("width"), F.lit(False)) | F.coalesce(size("height"), F.lit(False))) & F.col("identifier").isNotNull())
    return images.join(small.select("page_id", "identifier").distinct(), ["page_id", "identifier"], "left_semi")


def partial_matches(nodes: DataFrame, patterns: tuple[str, ...] | None = None) -> DataFrame:
    names = F.lower(F.concat_ws("\n", *(_attr(a) for a in C.TEST_ATTRIBUTES)))
    return nodes.where((F.col("kind") == "element") & names.rlike(partial_regex(patterns)))


def exact_matches(nodes: DataFrame) -> DataFrame:
    """page_id, pre, post, tag, selector for every exact selector that matches a node: one scan, and a semi-join for each selector that asks
    for ancestors."""
    simple = [s for s in C.EXACT_SELECTORS if all(len(c) == 1 for c in parse_selector(s))]
    hits = F.array_compact(F.array(*[F.when(predicate(s), F.lit(s)) for s in dict.fromkeys(simple)]))
    found = nodes.where(F.col("kind") == "element").select("page_id", "pre", "post", "tag", F.explode(hits).alias("selector"))
    others = [s for s in C.EXACT_SELECTORS if s not in simple]
    return reduce(DataFrame.unionByName, [found, *(select_nodes(nodes, s).select("page_id", "pre", "post", "tag", F.lit(s).alias("selector")) for s in others)])


def without(nodes: DataFrame, taken: DataFrame) -> DataFrame:
    """The nodes that are neither taken nor below one that is."""
    gone = taken.select(F.col("page_id").alias("p"), F.col("pre").alias("from"), F.col("post").alias("to")).distinct()
    return nodes.join(gone, (F.col("page_id") == F.col("p")) & (F.col("pre") >= F.col("from")) & (F.col("pre") <= F.col("to")), "left_anti")


def clutter(nodes: DataFrame) -> DataFrame:
    """page_id, pre, tag, clutter_score of the blocks that aren't likely content: navigation phrases, links, lists and names count against."""
    words, links_ = F.greatest(F.col("n_words"), F.lit(1)), F.col("n_a")
    names = [F.lower(F.coalesce(_attr(a), F.lit(""))) for a in ("class", "id")]
    any_name = lambda w: names[0].contains(w) | names[1].contains(w)
    likely = (
        F.coalesce(_attr("role").isin(*C.CONTENT_ROLES), F.lit(False))
        | reduce(Column.__or__, [any_name(w) for w in C.CONTENT_INDICATORS])
        | (F.col("n_words") > 100)
        | ((F.col("n_words") > 50) & (F.col("n_p") > 1))
        | ((F.col("n_words") > 30) & (F.col("n_p") > 0))
    )
    text, lists = F.lower("subtree_text"), F.col("n_ul") + F.col("n_ol")
    count = lambda conditions: reduce(Column.__add__, [c.cast("int") for c in conditions])
    score = (
        -10.0 * count([text.contains(p) for p in C.NAVIGATION_PHRASES])
        - F.when(links_ / words > 0.5, 15.0).otherwise(0.0)
        - F.when((lists > 0) & (links_ > lists * 3), 10.0).otherwise(0.0)
        - 8.0 * count([any_name(p) for p in C.NON_CONTENT_PATTERNS])
    )
    blocks = nodes.where((F.col("kind") == "element") & F.col("tag").isin(*C.BLOCK_TAGS) & ~likely & (F.col("n_words") >= 3) & (F.col("n_note_lists") == 0))
    return blocks.select("page_id", "pre", "post", "tag", score.alias("clutter_score"))


def trailing_headings(nodes: DataFrame) -> DataFrame:
    """Headings after which no sibling element has text."""
    mark = F.max(F.when(F.col("n_words") > 0, F.col("sib"))).over(Window.partitionBy("page_id", "parent"))
    siblings = nodes.where(F.col("kind") == "element").withColumn("last_text", mark)
    return siblings.where(F.col("tag").rlike("^h[1-6]$") & (F.coalesce(F.col("last_text"), F.lit(-1)) <= F.col("sib"))).drop("last_text")


def footnote_pairs(nodes: DataFrame) -> DataFrame:
    """page_id, reference, definition, ref_text: links to ids of the same page."""
    refs = links(nodes).where(F.col("href").startswith("#")).select("page_id", F.col("pre").alias("reference"), F.substring("href", 2, 1 << 20).alias("id"), F.col("text").alias("ref_text"))
    ids = nodes.where(_attr("id").isNotNull()).groupBy("page_id", _attr("id").alias("id")).agg(F.min("pre").alias("definition"))
    return refs.join(ids, ["page_id", "id"])


def footnote_notes(nodes: DataFrame) -> DataFrame:
    """page_id, ref_text, note: what the definition of each of footnote_pairs() says."""
    notes = nodes.select("page_id", F.col("pre").alias("definition"), F.col("subtree_text").alias("note"))
    return footnote_pairs(nodes).join(notes, ["page_id", "definition"]).select("page_id", "ref_text", "note")


def first_images(nodes: DataFrame, eager: int = 3) -> DataFrame:
    """Images with their number on the page and how they should load."""
    number = F.row_number().over(Window.partitionBy("page_id").orderBy("pre"))
    return nodes.where(F.col("tag") == "img").select("page_id", "pre", _attr("src").alias("src"), number.alias("number")).withColumn("loading", F.when(F.col("number") <= eager, "eager").otherwise("lazy"))
