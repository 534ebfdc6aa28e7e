"""The registered queries of the extraction engine, with the DuckDB SQL that each must equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webextract import constants as C
from webextract.functions import text as T
from webextract.operators import conversation, nodes, routing
from webextract.plans import rendered
from webextract.plans.extract import extract, spread

Query = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def _query(sql: str | None = None):
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "pages")


def _nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nodes.parse_nodes(_pages(spark, sf_dir).select("page_id", "html"))


# What regular expressions make of the test pages. RE2 has no look-around, so the engine's own rules are written out in steps.
_SPACE = r"[\s\x{00A0}\x{0085}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{1680}\x{0B}]"
_REFERENCES = "replace(replace(replace(replace(replace(replace({}, '&copy;', '©'), '&middot;', '·'), '&quot;', '\"'), '&lt;', '<'), '&gt;', '>'), '&amp;', '&')"


def _decoded(text: str) -> str:
    return _REFERENCES.replace("{}", text)


_HOST = "regexp_replace(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1), '^www\\.', '')"
# A reference at the very end of a title is one without its semicolon too.
_TITLE = "trim(" + _decoded("regexp_replace(regexp_extract(html, '<title>([^<]*)</title>', 1), '&(copy|middot|quot|lt|gt|amp)$', '&\\\\1;')") + ")"
_ARTICLE = "regexp_extract(html, '(?s)<article>(.*)</article>', 1)"


@_query(f"SELECT page_id, {_TITLE} AS title FROM pages")
def page_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles by the metadata chain."""
    return extract(_pages(spark, sf_dir)).select("page_id", "title")


@_query(f"SELECT page_id, {_HOST} AS domain FROM pages")
def page_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pages(spark, sf_dir).select("page_id", T.domain(F.col("url")).alias("domain"))


@_query(f"SELECT {_HOST} AS domain, count(*) AS n_pages FROM pages GROUP BY 1")
def domain_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(_pages(spark, sf_dir)).groupBy("domain").agg(F.count("*").alias("n_pages"))


@_query("SELECT page_id, regexp_extract(url, '^([a-zA-Z]+://[^/?#]*)', 1) || '/favicon.ico' AS favicon FROM pages")
def page_favicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(_pages(spark, sf_dir)).select("page_id", "favicon")


@_query("SELECT page_id, CAST(0 AS BIGINT) AS n_meta_tags FROM pages")
def meta_tag_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The test pages' only meta tag has no content."""
    found = nodes.meta_tags(_nodes(spark, sf_dir)).groupBy("page_id").agg(F.count("*").alias("n"))
    return _pages(spark, sf_dir).select("page_id").join(found, "page_id", "left").select("page_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_meta_tags"))


_PLAIN = "regexp_replace(regexp_replace(html, '(?s)<script>.*?</script>', '<script>'), '(?s)<style>.*?</style>', '<style>')"


@_query(
    f"""WITH tags AS (SELECT unnest(regexp_extract_all({_PLAIN}, '<(h1|ul|li|a|nav|footer|article|title|style|script|meta|div|head|body|html)[ >]', 1)) AS tag FROM pages)
SELECT tag, count(*) AS n FROM tags GROUP BY tag"""
)
def node_counts_by_tag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elements by tag, of those that open formatting elements don't multiply."""
    tags = "h1 ul li a nav footer article title style script meta div head body html".split()
    found = _nodes(spark, sf_dir).where((F.col("kind") == "element") & F.col("tag").isin(*tags))
    return found.groupBy("tag").agg(F.count("*").alias("n"))


@_query("SELECT page_id, 'article' AS selector FROM pages")
def entry_point_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nodes.entry_points(_nodes(spark, sf_dir)).select("page_id", "selector")


#: A text of a page's element as the tree has it: tags go, references are decoded.
_AD = _decoded("regexp_replace(regexp_extract(html, '(?s)<div class=\"ad\">(.*?)</div>', 1), '<[^>]*>', '', 'g')")


def _count(text: str) -> str:
    return f"CAST(len(list_filter(regexp_split_to_array({text}, '{_SPACE}+'), lambda w: w <> '')) AS BIGINT)"


@_query(
    f"""WITH t AS (SELECT page_id, {_AD} AS text FROM pages)
SELECT page_id, round(CAST({_count('text')} AS DOUBLE)
  + CASE WHEN regexp_matches(text, '(?i)\\b(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*\\s+\\d{{1,2}},?\\s+\\d{{4}}\\b') THEN 10 ELSE 0 END
  + CASE WHEN regexp_matches(text, '(?i)\\b(?:by|written by|author:)\\s+[A-Za-z\\s]+\\b') THEN 10 ELSE 0 END, 6) AS score FROM t"""
)
def ad_block_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of the advertisement blocks."""
    scored = nodes.score_blocks(_nodes(spark, sf_dir)).where("tag = 'div'")
    return scored.select("page_id", F.round("score", 6).alias("score"))


@_query(
    f"""SELECT s.selector, count(*) AS n FROM pages, (VALUES ('nav'), ('footer'), ('style'), ('meta'), ('script:not([type^="math/"])'), ('.ad:not([class*="gradient"])')) AS s(selector) GROUP BY 1"""
)
def clutter_removed_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches of the exact selectors other than those on links' targets."""
    # Five scans of the node table read it from Spark's cache, which spills to disk.
    found = nodes.exact_matches(_nodes(spark, sf_dir).persist()).where(~F.col("selector").contains("href"))
    return found.groupBy("selector").agg(F.count("*").alias("n"))


@_query(
    f"""WITH l AS (SELECT page_id, len(regexp_extract_all(html, '<a href=', 0)) AS n FROM pages)
SELECT page_id, CAST(n AS BIGINT) AS n_links FROM l"""
)
def nav_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = nodes.links(_nodes(spark, sf_dir)).groupBy("page_id").agg(F.count("*").alias("n"))
    return _pages(spark, sf_dir).select("page_id").join(found, "page_id", "left").select("page_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"))


_NAV = "regexp_extract(html, '(?s)<nav>(.*?)</nav>', 1)"


@_query(
    f"""WITH t AS (SELECT page_id, {_NAV} AS nav FROM pages), c AS (
  SELECT page_id, len(regexp_extract_all(nav, '<a ', 0)) AS links, {_count(_decoded("regexp_replace(nav, '<[^>]*>', '', 'g')"))} AS words FROM t)
SELECT page_id, round(CAST(links AS DOUBLE) / greatest(words, 1), 6) AS link_density FROM c"""
)
def nav_link_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links for each word of the menu, whose items run together as text."""
    nav = _nodes(spark, sf_dir).where((F.col("kind") == "element") & (F.col("tag") == "nav"))
    return nav.select("page_id", F.round(F.col("n_a").cast("double") / F.greatest("n_words", F.lit(1)), 6).alias("link_density"))


# The test pages have hardly any of what follows, and SQL can't follow nesting; tests hold these against small pages that do.
@_query()
def hidden_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nodes.hidden(_nodes(spark, sf_dir)).select("page_id", "tag", F.col("attrs")["style"].alias("style"))


@_query()
def small_image_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nodes.small_images(_nodes(spark, sf_dir)).groupBy("page_id", "identifier").agg(F.count("*").alias("n"))


@_query()
def footnote_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nodes.footnote_notes(_nodes(spark, sf_dir))


@_query()
def dangling_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nodes.trailing_headings(_nodes(spark, sf_dir)).select("page_id", F.col("subtree_text").alias("heading"))


@_query()
def clutter_partial(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nodes.partial_matches(_nodes(spark, sf_dir)).select("page_id", "tag", F.col("attrs")["class"].alias("class"))


@_query()
def image_loading(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nodes.first_images(_nodes(spark, sf_dir)).drop("pre")


@_query("SELECT page_id, true AS same FROM pages")
def duplicate_title_heading(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the page's first h1 says the same as its title."""
    n = _nodes(spark, sf_dir).where(F.col("tag").isin("title", "h1"))
    text = F.lower(F.trim(F.regexp_replace(F.regexp_replace("subtree_text", " ", " "), r"\s+", " ")))
    first = lambda tag: F.min_by(F.when(F.col("tag") == tag, text), F.when(F.col("tag") == tag, F.col("pre")))
    return n.groupBy("page_id").agg((first("title") == first("h1")).alias("same"))


# The h1 goes as it says what the title says; a word may then start right after a break or after an inline element.
_BODY = f"regexp_replace({_ARTICLE}, '(?s)<h1>.*?</h1>', '')"
_SPACED = "regexp_replace(" + _BODY + ", '(&[a-z]+;|[^ ,.!?:;(\\[>])<br>', '\\1 <br>', 'g')"


@_query(f"SELECT page_id, {_count(_decoded(f'''regexp_replace({_SPACED}, '<[^>]*>', '', 'g')'''))} AS word_count FROM pages")
def content_word_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(_pages(spark, sf_dir)).select("page_id", F.col("word_count").cast("long").alias("word_count"))


_ROUTES = [
    "https://twitter.com/a/status/1", "https://x.com/a", "https://www.netflix.com/t", "https://www.youtube.com/watch?v=1", "https://youtu.be/1", "https://old.reddit.com/r/a/comments/b", "https://news.ycombinator.com/item?id=1",
    "https://news.ycombinator.com/", "https://chatgpt.com/share/1", "https://claude.ai/chat/1", "https://claude.ai/", "https://grok.com/share/1", "https://gemini.google.com/app/1", "https://github.com/a/b/issues/1", "://bad", "",
]
_EXPECTED = ["twitter", "twitter", "twitter", "youtube", "youtube", "reddit", "hackernews", None, "chatgpt", "claude", None, "grok", "gemini", "github", None, None]


@_query("SELECT * FROM (VALUES " + ", ".join(f"('{u}', {'NULL' if r is None else repr(r)})" for u, r in zip(_ROUTES, _EXPECTED)) + ") AS t(url, extractor) UNION ALL SELECT url, NULL FROM pages")
def extractor_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    urls = spark.sql("SELECT * FROM VALUES " + ", ".join(f"('{u}')" for u in _ROUTES) + " AS t(url)").unionByName(_pages(spark, sf_dir).select("url"))
    return urls.select("url", routing.route_column(F.col("url")).alias("extractor"))


_PIECE = """'<div class="message message-' || lower(role) || '"><div class="message-header"><p class="message-author"><strong>' || role || '</strong></p></div><div class="message-content"><p>' || text || '</p></div></div>'"""


@_query(f"SELECT conv_id, string_agg({_PIECE}, chr(10) || '<hr>' ORDER BY turn) AS html FROM conversations GROUP BY conv_id")
def conversation_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation.render_conversations(_table(spark, sf_dir, "conversations")).select("conv_id", "html")


@_query(
    """WITH c AS (SELECT conv_id, count(*) AS n, min_by(text, turn) FILTER (role = 'user') AS q FROM conversations GROUP BY conv_id)
SELECT conv_id, n AS message_count, CASE WHEN q IS NULL THEN 'Chat Conversation' WHEN length(q) > 50 THEN substr(q, 1, 50) || '...' ELSE q END AS title, 'Chat conversation with ' || n || ' messages' AS description FROM c"""
)
def conversation_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation.render_conversations(_table(spark, sf_dir, "conversations")).drop("html")


_DATE_SQL = r"(?i)\b(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*\s+\d{1,2},?\s+\d{4}\b"
_BYLINE_SQL = r"(?i)\b(?:by|written by|author:)\s+[A-Za-z\s]+\b"


@_query(
    f"""SELECT doc_id, {_count('text')} AS n_words, regexp_matches(text, '{_DATE_SQL}') AS has_date, regexp_matches(text, '{_BYLINE_SQL}') AS has_byline,
  CAST({" + ".join(f"CAST(contains(lower(text), '{p}') AS BIGINT)" for p in C.NAVIGATION_PHRASES)} AS BIGINT) AS nav_hits FROM documents"""
)
def doc_score_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return _table(spark, sf_dir, "documents").select("doc_id", T.word_count(t).alias("n_words"), T.has_date(t).alias("has_date"), T.has_byline(t).alias("has_byline"), T.navigation_hits(t).alias("nav_hits"))


@_query(
    """WITH c AS (SELECT doc_id, text, substr(text, 1, 200) AS cut FROM documents), p AS (SELECT *, length(cut) - strpos(reverse(cut), ' ') AS place FROM c)
SELECT doc_id, regexp_replace(regexp_replace(substr(text, 1, 140), '^[ \\t\\n\\f\\r]+|[ \\t\\n\\f\\r]+$', '', 'g'), '[ \\t\\n\\f\\r]+', ' ', 'g') AS short_140,
  CASE WHEN length(text) <= 200 THEN trim(text) ELSE trim(CASE WHEN contains(cut, ' ') AND place > 150 THEN substr(cut, 1, place) ELSE cut END) END AS short_200 FROM p"""
)
def doc_truncations(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return _table(spark, sf_dir, "documents").select("doc_id", T.flattened(t, 140).alias("short_140"), T.shortened(t).alias("short_200"))


@_query(
    r"""SELECT doc_id, regexp_matches(text, '\$.*\$|\\\w+|\{.*\}|\^|_') AS latex,
  CAST(len(regexp_extract_all(text, '\[([0-9]+)\]', 0)) + len(regexp_extract_all(text, '\(([0-9]+)\)', 0)) AS BIGINT) AS note_marks FROM documents"""
)
def doc_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that look like LaTeX, and marks of footnotes in them."""
    count = lambda p: F.size(F.regexp_extract_all("text", F.lit(p), F.lit(0)))
    return _table(spark, sf_dir, "documents").select("doc_id", T.looks_like_latex(F.col("text")).alias("latex"), (count(r"\[([0-9]+)\]") + count(r"\(([0-9]+)\)")).cast("long").alias("note_marks"))


def _normalize_sql() -> str:
    from webextract.operators.standardize import TEXT_CHAIN

    out = "text"
    for pattern, to in TEXT_CHAIN:
        # RE2 takes \z for the end of the text; characters are written by their numbers.
        p = "".join(c if ord(c) < 128 else f"\\x{{{ord(c):X}}}" for c in pattern.replace("$", r"\z").replace(r"\xa0", r"\x{A0}"))
        to = "".join(c if ord(c) < 128 else c for c in to)
        out = f"regexp_replace({out}, '{p}', '{to}', 'g')"
    return out


@_query(f"SELECT doc_id, {_normalize_sql()} AS text FROM documents")
def text_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select("doc_id", T.normalized_text(F.col("text")).alias("text"))


@_query("SELECT event_id, coalesce(json_extract_string(props, '$.k'), '') AS k FROM events")
def json_property(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A simple property path of a JSON payload."""
    return _table(spark, sf_dir, "events").select("event_id", F.coalesce(F.try_variant_get(F.try_parse_json("props"), "$.k", "string"), F.lit("")).alias("k"))


@_query()
def page_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's whole record."""
    return extract(_pages(spark, sf_dir))


_WORDS = _count(_decoded(f"regexp_replace({_SPACED}, '<[^>]*>', '', 'g')"))


@_query(f"SELECT {_HOST} AS host, count(*) AS n_pages, CAST(sum({_WORDS}) AS BIGINT) AS words, round(avg({_WORDS}), 6) AS mean_words FROM pages GROUP BY 1")
def host_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages and words of main content per host."""
    results = extract(_pages(spark, sf_dir)).select(F.col("domain").alias("host"), F.col("word_count").cast("long").alias("w"))
    return results.groupBy("host").agg(F.count("*").alias("n_pages"), F.sum("w").alias("words"), F.round(F.avg("w"), 6).alias("mean_words"))


def queries() -> dict[str, Query]:
    return _QUERIES | rendered.queries()


def oracle_sql() -> dict[str, str]:
    return _SQL | rendered.oracle_sql()
