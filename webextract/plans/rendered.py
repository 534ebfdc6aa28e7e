"""Queries over pages rendered from the rows of tables: what goes into a page is known, so SQL can say what must come out of it.

The test pages have no metadata, no site markup, no code, mathematics, images or notes. Each query here writes every row of a table (or every
conversation) into a page with one of several layouts, runs the engine over these pages, and has SQL that gives the result from the
table's columns alone. Templates are SQL that Spark and DuckDB read alike, with expressions between « and ».
"""

from __future__ import annotations

import codecs
import re
from collections.abc import Callable
from urllib.parse import unquote_plus

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webextract.operators import elements, metadata, nodes
from webextract.options import Options
from webextract.plans.extract import contract_column, extract, spread
from webextract.sources import sinks, web

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def _query(sql: str):
    def add(f: Query) -> Query:
        _QUERIES[f.__name__], _SQL[f.__name__] = f, sql
        return f

    return add


def filled(template: str) -> str:
    """The SQL of a template: text as it stands, and the values of the expressions between « and »."""
    parts = re.split("«([^«»]*)»", template)
    return " || ".join(f"CAST(({p}) AS STRING)" if i % 2 else "'" + p.replace("'", "''") + "'" for i, p in enumerate(parts) if p or not i)


def by_case(key: str, *templates: str) -> str:
    """One of the templates, by the key's remainder."""
    cases = " ".join(f"WHEN {i} THEN {filled(t)}" for i, t in enumerate(templates))
    return f"CASE {key} % {len(templates)} {cases} END"


ESCAPED = "replace(replace(replace(coalesce(text, ''), '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"


def _rows(spark: SparkSession, sf_dir: str, table: str, key: str, url: str, html: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{table}.parquet")).selectExpr(f"{key} AS page_id", f"{url} AS url", f"{html} AS html")


def _chats(spark: SparkSession, sf_dir: str, url: str, head: str, piece: str, tail: str) -> DataFrame:
    """A page a conversation: head, a piece for each turn in order, and tail."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").selectExpr("conv_id", "turn", f"{filled(piece)} AS piece")
    grouped = rows.selectExpr("conv_id", "struct(turn, piece) AS p").groupBy("conv_id").agg({"p": "collect_list"}).toDF("conv_id", "pieces")
    body = "array_join(transform(array_sort(pieces), p -> p.piece), '')"
    return grouped.selectExpr("conv_id AS page_id", f"{filled(url)} AS url", f"{head} || {body} || {filled(tail)} AS html")


# Metadata

_ORIGIN = "https://www.h«c_custkey».example"
_METADATA = by_case(
    "c_custkey",
    '<html><head><title>other</title><meta property="og:title" content="«c_name» | Shop «c_nationkey»"><meta property="og:site_name" content="Shop «c_nationkey»"><meta property="og:description" content="In «c_mktsegment»">'
    f'<meta property="og:image" content="https://img.example/«c_custkey».png"><meta property="og:url" content="{_ORIGIN}/p"><meta property="article:published_time" content="2024-01-«c_custkey % 9 + 10»"><meta name="author" content="By «c_custkey»"><link rel="shortcut icon" href="/«c_custkey».ico"></head><body>x</body></html>',
    '<html><head><title>other</title><meta name="twitter:title" content="Shop «c_nationkey» - «c_name»"><meta name="copyright" content="Shop «c_nationkey»"><meta name="twitter:description" content="In «c_mktsegment»">'
    f'<meta name="twitter:image" content="https://img.example/«c_custkey».png"><link rel="canonical" href="{_ORIGIN}/p"><meta name="sailthru.date" content="2024-01-«c_custkey % 9 + 10»"><meta name="byl" content="By «c_custkey»"><meta name="msapplication-TileImage" content="/«c_custkey».ico"></head><body>x</body></html>',
    '<html><head><title>other</title><script type="application/ld+json">/* an article */ {"@type": "Article", "headline": "«c_name»", "description": "In «c_mktsegment»", "image": {"url": "https://img.example/«c_custkey».png"},'
    f'"url": "{_ORIGIN}/p", "datePublished": "2024-01-«c_custkey % 9 + 10»", "author": [{{"name": "By «c_custkey»"}}], "publisher": {{"name": "Shop «c_nationkey»"}}}}</script><link rel="icon" href="https://www.h«c_custkey».example/«c_custkey».ico"></head><body>x</body></html>',
    '<html><head><title> «c_name» — shop «c_nationkey»</title><meta name="application-name" content="Shop «c_nationkey»"><meta name="sailthru.description" content="In «c_mktsegment»"><meta name="sailthru.image.full" content="https://img.example/«c_custkey».png">'
    f'<base href="{_ORIGIN}/p"><link rel="apple-touch-icon" href="/«c_custkey».ico"></head><body><p class="author">By «c_custkey»</p><p class="author">Author, By «c_custkey»</p><time datetime="2024-01-«c_custkey % 9 + 10»">x</time></body></html>',
)


@_query(
    f"""SELECT c_custkey AS page_id, c_name AS title, {filled('In «c_mktsegment»')} AS description, {filled('h«c_custkey».example')} AS domain, {filled(_ORIGIN + '/«c_custkey».ico')} AS favicon,
  {filled('https://img.example/«c_custkey».png')} AS image, {filled('2024-01-«c_custkey % 9 + 10»')} AS published, {filled('By «c_custkey»')} AS author, {filled('Shop «c_nationkey»')} AS site FROM customer"""
)
def rendered_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every field by its chain of fallbacks, from four places each; the page's address is known only from the page."""
    return extract(_rows(spark, sf_dir, "customer", "c_custkey", "''", _METADATA)).select("page_id", "title", "description", "domain", "favicon", "image", "published", "author", "site")


_EVENT = '"name": "«event_type»", "offer": {"sku": "s«event_id»"}'
_SCHEMA_ORG = by_case(
    "event_id",
    f'<script type="application/ld+json">{{"@type": "Event", {_EVENT}}}</script>',
    f'<script type="application/ld+json"><![CDATA[[{{"type": "Event", {_EVENT}}}, {{"x": 1}}]]]></script>',
    f'<script type="application/ld+json">// one\n{{"@graph": [{{"@type": ["Event", "Thing"], {_EVENT}}}]}}</script>',
    f'<script type="application/ld+json">{{"@type": "Event", {_EVENT}</script><script>var x = {{}};</script>',
    f'<script type="application/ld+json"><!-- a --> {{"@type": "Event", {_EVENT}}}</script><script type="application/ld+json">{{"@type": "Event", "name": "two"}}</script>',
)
_KEPT = '"name": "«event_type»", "offer": {"sku": "s«event_id»"}, '


@_query(
    f"""SELECT event_id AS page_id, {by_case('event_id', '[{"@type": "Event", ' + _KEPT + '"type": "Event"}]', '[{"@type": "Event", ' + _KEPT + '"type": "Event"}]', '[{"@type": ["Event", "Thing"], ' + _KEPT + '"type": ["Event", "Thing"]}]', '', '[{"@type": "Event", ' + _KEPT + '"type": "Event"}, {"@type": "Event", "name": "two", "type": "Event"}]')} AS items,
  CASE event_id % 5 WHEN 2 THEN 'Event,Thing' WHEN 3 THEN '' ELSE 'Event' END AS types, CASE event_id % 5 WHEN 3 THEN '' WHEN 4 THEN event_type || ', two' ELSE event_type END AS name,
  CASE WHEN event_id % 5 = 3 THEN '' ELSE 's' || CAST(event_id AS STRING) END AS sku FROM events"""
)
def rendered_schema_org(spark: SparkSession, sf_dir: str) -> DataFrame:
    """schema.org items of several forms, their types, a property and one that lies below another object."""
    found = metadata.schema_values(_rows(spark, sf_dir, "events", "event_id", "''", _SCHEMA_ORG), ["name", "sku"])
    return found.selectExpr("page_id", "items", "array_join(types, ',') AS types", "values[0] AS name", "values[1] AS sku")


# Sites

_SITE = ["page_id", "extractor_type", "title", "author", "site", "description", "content"]
_NAME = "CASE role WHEN 'user' THEN 'You' WHEN 'assistant' THEN '{}' ELSE 'System' END"


def _message(author: str, css: str, role: str, content: str) -> str:
    return f'<div class="message message-{css}" data-role="{role}"><div class="message-header"><p class="message-author"><strong>{author}</strong></p></div><div class="message-content">{content}</div></div>'


_NUMBERED = "(SELECT *, count(*) FILTER (WHERE role = 'assistant') OVER (PARTITION BY conv_id ORDER BY turn) AS note FROM conversations)"
_BREAK = "chr(10) || '<hr>'"


def _notes(link: str, text: str) -> str:
    item = filled(f'<li class="footnote" id="fn:«note»"><p><a href="{link}" target="_blank">{text}</a>&nbsp;<a href="#fnref:«note»" class="footnote-backref">↩</a></p></li>')
    return f"coalesce(chr(10) || '<div id=\"footnotes\"><ol>' || string_agg({item}, '' ORDER BY turn) FILTER (WHERE role = 'assistant') || '</ol></div>', '')"


_QUESTION = "CASE WHEN length(min_by(text, turn)) > 50 THEN substr(min_by(text, turn), 1, 50) || '...' ELSE min_by(text, turn) END"
_CHATGPT = _message(f"«{_NAME.format('ChatGPT')}»", f"«lower({_NAME.format('ChatGPT')})»", "«role»", f"<div class=\"text-message\"><p>«{ESCAPED}»</p></div>«CASE WHEN role = 'assistant' THEN '<sup id=\"fnref:' || CAST(note AS STRING) || '\"><a href=\"#fn:' || CAST(note AS STRING) || '\">' || CAST(note AS STRING) || '</a></sup>' ELSE '' END»")


@_query(
    f"""SELECT conv_id AS page_id, 'chatgpt' AS extractor_type, CASE WHEN conv_id % 2 = 0 THEN {filled('Chat «conv_id»')} ELSE {_QUESTION} END AS title, '' AS author, 'ChatGPT' AS site, {filled('ChatGPT conversation with «count(*)» messages')} AS description,
  string_agg({filled(_CHATGPT)}, {_BREAK} ORDER BY turn) || {_notes('https://s.example/«turn»', 'Source «note»')} AS content FROM {_NUMBERED} GROUP BY conv_id"""
)
def rendered_chatgpt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns, citations as numbered notes, titles from the page or the first turn."""
    piece = f'<article data-testid="conversation-turn-«turn»" data-message-author-role="«role»"><h5 class="sr-only">«{_NAME.format("ChatGPT")}»:</h5><div class="text-message"><p>«{ESCAPED}»</p></div><p> </p>'
    piece += "«CASE WHEN role = 'assistant' THEN '<span class=\"c\"><a href=\"https://s.example/' || CAST(turn AS STRING) || '\" target=\"_blank\" rel=\"noopener\">s</a></span>' ELSE '' END»</article>"
    head = by_case("conv_id", "<html><head><title>Chat «conv_id»</title></head><body>", "<html><head><title>ChatGPT</title></head><body>")
    return extract(_chats(spark, sf_dir, "https://chatgpt.com/share/«conv_id»", head, piece, "</body></html>")).select(*_SITE)


@_query(
    f"""SELECT conv_id AS page_id, 'claude' AS extractor_type, CASE WHEN conv_id % 2 = 0 THEN {filled('Talk «conv_id»')} ELSE {filled('Header «conv_id»')} END AS title, '' AS author, 'Claude' AS site,
  {filled("Claude conversation with «count(*) FILTER (WHERE role <> 'system')» messages")} AS description,
  coalesce(string_agg({filled(_message(f"«{_NAME.format('Claude')}»", f"«lower({_NAME.format('Claude')})»", "«CASE role WHEN 'user' THEN 'you' ELSE 'assistant' END»", f'<p>«{ESCAPED}»</p>'))}, {_BREAK} ORDER BY turn) FILTER (WHERE role <> 'system'), '') AS content FROM conversations GROUP BY conv_id"""
)
def rendered_claude(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages by their test ids; blocks without one have no author and stay out."""
    piece = f"<div «CASE role WHEN 'system' THEN 'class=\"font-claude-message\"' ELSE 'data-testid=\"' || role || '-message\"' END»><p>«{ESCAPED}»</p></div>"
    head = by_case("conv_id", "<title>Talk «conv_id» - Claude</title><body>", '<title>Claude</title><body><header><div class="font-tiempos">Header «conv_id»</div></header>')
    return extract(_chats(spark, sf_dir, "https://claude.ai/chat/«conv_id»", head, piece, "</body>")).select(*_SITE)


_GROK = f"«CASE role WHEN 'user' THEN text ELSE {ESCAPED} || ' ref<sup id=\"fnref:' || CAST(note AS STRING) || '\" class=\"footnote-ref\"><a href=\"#fn:' || CAST(note AS STRING) || '\" class=\"footnote-link\">' || CAST(note AS STRING) || '</a></sup><a href=\"/here\">here</a>' END»"


@_query(
    f"""SELECT conv_id AS page_id, 'grok' AS extractor_type, {filled('Talk «conv_id»')} AS title, '' AS author, 'Grok' AS site, {filled('Grok conversation with «count(*)» messages')} AS description,
  coalesce(string_agg({filled(_message(f"«{_NAME.format('Grok')}»", f"«lower({_NAME.format('Grok')})»", '«role»', f'<p>{_GROK}</p>'))}, {_BREAK} ORDER BY turn) FILTER (WHERE role <> 'system'), '')
  || {_notes('https://www.s«turn».example/x', '<a href="https://www.s«turn».example/x" target="_blank" rel="noopener noreferrer">s«turn».example</a>')} AS content FROM {_NUMBERED} GROUP BY conv_id"""
)
def rendered_grok(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bubbles of both sides, outward links as notes."""
    side = "«CASE role WHEN 'user' THEN 'items-end' WHEN 'assistant' THEN 'items-start' ELSE '' END»"
    links = "«CASE WHEN role = 'assistant' THEN ' <a href=\"https://www.s' || CAST(turn AS STRING) || '.example/x\">ref</a><a href=\"/here\">here</a>' ELSE '' END»"
    piece = f'<div class="relative group flex flex-col justify-center w-full {side}"><div class="message-bubble">«{ESCAPED}»{links}</div></div>'
    return extract(_chats(spark, sf_dir, "https://grok.com/share/«conv_id»", filled("<title>Talk «conv_id» - Grok</title><body>"), piece, "</body>")).select(*_SITE)


@_query(
    f"""SELECT conv_id AS page_id, 'gemini' AS extractor_type, CASE WHEN conv_id % 2 = 0 THEN {filled('Talk «conv_id»')} ELSE {filled('Named «conv_id»')} END AS title, '' AS author, 'Gemini' AS site, {filled('Gemini conversation with «count(*)» messages')} AS description,
  string_agg(CASE role WHEN 'assistant' THEN {filled(_message('Gemini', 'gemini', 'assistant', f'<p>«{ESCAPED}»</p><div class="big">t</div>'))} ELSE {filled(_message('You', 'you', 'user', f'<p>«{ESCAPED}»</p>'))} END, {_BREAK} ORDER BY turn)
  || chr(10) || '<div id="footnotes"><ol>' || {filled('<li class="footnote" id="fn:1"><p><a href="https://s.example/«conv_id»" target="_blank">s.example: Page «conv_id»</a>&nbsp;<a href="#fnref:1" class="footnote-backref">↩</a></p></li></ol></div>')} AS content FROM conversations GROUP BY conv_id"""
)
def rendered_gemini(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries, answers and the list of sources."""
    answer = f"'<model-response><div class=\"model-response-text\"><div class=\"markdown\"><p>' || {ESCAPED} || '</p><div class=\"table-content big\">t</div></div></div></model-response>'"
    piece = f"<div class=\"conversation-container\">«CASE role WHEN 'assistant' THEN {answer} ELSE '<user-query><div class=\"query-text\"><p>' || {ESCAPED} || '</p></div></user-query>' END»</div>"
    head = by_case("conv_id", "<title>Talk «conv_id»</title><body>", '<title>Gemini</title><body><div class="title-text">Named «conv_id»</div>')
    tail = '<browse-item><a href="https://s.example/«conv_id»"><span class="domain">s.example</span><span class="title">Page «conv_id»</span></a></browse-item></body>'
    return extract(_chats(spark, sf_dir, "https://gemini.google.com/app/«conv_id»", head, piece, tail)).select(*_SITE)


_TWEET = f"""<div class="tweet"><div class="tweet-header"><span class="tweet-author"><strong>«role»</strong> <span class="tweet-handle">@«role»</span></span> <a href="/«role»/status/«turn»" class="tweet-date">2024-02-03</a></div><div class="tweet-text"><p>«replace({ESCAPED}, chr(10), '</p><p>')»</p></div><div class="tweet-media"><img src="https://m.example/media/«turn»?f=png&amp;name=large" alt="a b" /></div></div>"""


@_query(
    f"""WITH t AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i, {filled(_TWEET)} AS tweet FROM conversations)
SELECT conv_id AS page_id, 'twitter' AS extractor_type, 'Thread by @' || min_by(role, turn) AS title, '@' || min_by(role, turn) AS author, 'X (Twitter)' AS site,
  trim(regexp_replace(substr(min_by(text, turn), 1, 140), '\\s+', ' ', 'g')) AS description, '<div class="tweet-thread"><div class="main-tweet">' || min_by(tweet, turn) || '</div>'
  || coalesce('<hr><div class="thread-tweets">' || string_agg(tweet, chr(10) || '<hr>' || chr(10) ORDER BY turn) FILTER (WHERE i > 1) || '</div>', '') || '</div>' AS content FROM t GROUP BY conv_id"""
)
def rendered_twitter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Threads: users, dates, lines, large images."""
    piece = f'<article data-testid="tweet"><div data-testid="User-Name"><a href="/«role»">«role»</a><a href="/«role»">@«role»</a><a href="/«role»/status/«turn»"><time datetime="2024-02-03T04:05:06Z">3</time></a></div><div data-testid="tweetText">«{ESCAPED}»</div><div data-testid="tweetPhoto"><img src="https://m.example/media/«turn»?f=png&amp;name=small" alt=" a  b"></div></article>'
    return extract(_chats(spark, sf_dir, "https://x.com/a/status/«conv_id»", "'<body><div aria-label=\"Timeline: Conversation\">'", piece, "</div></body>")).select(*_SITE)


_COMMENT = f'<div class="comment"><div class="comment-metadata"><span class="comment-author"><strong>«role»</strong></span> • <a href="https://reddit.com/c/«turn»" class="comment-link">«turn» points</a> • <span class="comment-date">2024-02-03</span></div><div class="comment-content"><p>«{ESCAPED}»</p></div></div>'


@_query(
    f"""SELECT conv_id AS page_id, 'reddit' AS extractor_type, {filled('Post «conv_id»')} AS title, {filled('u«conv_id»')} AS author, 'r/some' AS site, {filled('A question, «conv_id»')} AS description,
  {filled('<div class="reddit-post"><div class="post-content"><p>A  question, «conv_id»</p></div></div><hr><h2>Comments</h2><div class="reddit-comments">')}
  || CASE WHEN conv_id % 2 = 0 THEN string_agg('<blockquote>' || {filled(_COMMENT)}, '' ORDER BY turn) || repeat('</blockquote>', count(*)) ELSE string_agg('<blockquote>' || {filled(_COMMENT)} || '</blockquote>', '' ORDER BY turn) END || '</div>' AS content
  FROM conversations GROUP BY conv_id"""
)
def rendered_reddit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A post, and comments that answer each other or the post."""
    piece = f'<shreddit-comment author="«role»" depth="«CASE WHEN conv_id % 2 = 0 THEN turn ELSE 0 END»" permalink="/c/«turn»" score="«turn»"><faceplate-timeago ts="2024-02-03T01:02:03.000Z"></faceplate-timeago><div slot="comment"><p>«{ESCAPED}»</p></div></shreddit-comment>'
    head = filled('<body><h1>Post «conv_id»</h1><shreddit-post author="u«conv_id»"><div slot="text-body"><p>A  question, «conv_id»</p></div></shreddit-post>')
    return extract(_chats(spark, sf_dir, "https://www.reddit.com/r/some/comments/a«conv_id»", head, piece, "</body>")).select(*_SITE)


_HN_COMMENT = f'<div class="comment"><div class="comment-metadata"><span class="comment-author"><strong>«role»</strong></span> • <a href="https://news.ycombinator.com/item?id=«turn + 1»" class="comment-link">2024-02-03</a></div><div class="comment-content">«{ESCAPED}»</div></div>'


@_query(
    f"""SELECT conv_id AS page_id, 'hackernews' AS extractor_type, CASE WHEN conv_id % 2 = 0 THEN {filled('Story «conv_id»')} ELSE {filled('Comment by u«conv_id»: About «conv_id»')} END AS title, {filled('u«conv_id»')} AS author, 'Hacker News' AS site,
  CASE WHEN conv_id % 2 = 0 THEN {filled('Story «conv_id» - by u«conv_id» on Hacker News')} ELSE {filled('Comment by u«conv_id» on Hacker News')} END AS description, '2024-02-02' AS published,
  '<div class="hackernews-post"><div class="post-content">' || CASE WHEN conv_id % 2 = 0 THEN {filled('<p><a href="https://s.example/«conv_id»" target="_blank">https://s.example/«conv_id»</a></p><div class="post-text">About <i>«conv_id»</i></div>')}
  ELSE {filled('<div class="comment main-comment"><div class="comment-metadata"><span class="comment-author"><strong>u«conv_id»</strong></span> • <span class="comment-date">2024-02-02</span> • <a href="https://news.ycombinator.com/item?id=9#parent" class="parent-link">parent</a></div><div class="comment-content">About <i>«conv_id»</i></div></div>')} END
  || '</div><hr><h2>Comments</h2><div class="hackernews-comments">' || string_agg('<blockquote>' || {filled(_HN_COMMENT)}, '' ORDER BY turn) || repeat('</blockquote>', count(*)) || '</div></div>' AS content FROM conversations GROUP BY conv_id"""
)
def rendered_hackernews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stories and single comments, with the comments below them by their indents."""
    piece = f'<tr class="comtr" id="«turn + 1»"><td class="ind"><img width="«turn * 40»"></td><td><a class="hnuser">«role»</a> <span class="age" title="2024-02-03T01:02:03">3</span><div class="commtext">«{ESCAPED}»</div></td></tr>'
    head = by_case(
        "conv_id",
        '<body><table class="fatitem"><tr><td><span class="titleline"><a href="https://s.example/«conv_id»">Story «conv_id»</a></span><a class="hnuser">u«conv_id»</a><span class="age" title="2024-02-02T01:02:03">2</span><div class="toptext">About <i>«conv_id»</i></div></td></tr></table><table>',
        '<body><table class="fatitem"><tr><td><a class="hnuser">u«conv_id»</a><span class="age" title="2024-02-02T01:02:03">2</span><span class="navs"><a href="item?id=9#parent">parent</a></span><div class="commtext">About <i>«conv_id»</i></div></td></tr></table><table>',
    )
    return extract(_chats(spark, sf_dir, "https://news.ycombinator.com/item?id=«conv_id»", head, piece, "</table></body>")).select(*_SITE, "published")


@_query(
    f"""SELECT p_partkey AS page_id, 'youtube' AS extractor_type, p_name AS title, CASE WHEN p_partkey % 3 = 0 THEN p_brand ELSE '' END AS author, 'YouTube' AS site, p_type AS description, CASE WHEN p_partkey % 3 = 0 THEN '2024-02-03' ELSE '' END AS published,
  CASE WHEN p_partkey % 3 = 0 THEN {filled('https://img.example/«p_partkey».jpg')} ELSE {filled('https://img.youtube.com/vi/v«p_partkey»/maxresdefault.jpg')} END AS image,
  {filled('<iframe width="560" height="315" src="https://www.youtube.com/embed/v«p_partkey»" title="YouTube video player" frameborder="0" allow="accelerometer; autoplay; clipboard-write; encrypted-media; gyroscope; picture-in-picture; web-share" allowfullscreen></iframe><p>«p_type»</p>')} AS content FROM part"""
)
def rendered_youtube(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Videos by their schema.org item or the page, at both hosts."""
    url = by_case("p_partkey", "https://www.youtube.com/watch?t=1&v=v«p_partkey»", "https://youtu.be/v«p_partkey»")
    plain = '<title>«p_name» - YouTube</title><body><div id="description">«p_type»</div></body>'
    html = by_case("p_partkey", '<title>x</title><script type="application/ld+json">{"@type": "VideoObject", "name": "«p_name»", "author": "«p_brand»", "description": "«p_type»", "uploadDate": "2024-02-03", "thumbnailUrl": ["https://img.example/«p_partkey».jpg"]}</script><body>y</body>', plain, plain)
    return extract(_rows(spark, sf_dir, "part", "p_partkey", url, html)).select(*_SITE, "published", "image")


@_query(
    f"""SELECT o_orderkey AS page_id, 'github' AS extractor_type, {filled('Issue «o_orderkey»')} AS title, 'GitHub - own/rep' AS site, {filled('u«o_custkey» opened this issue on «strftime(o_orderdate, $$%B %-d, %Y$$)» Status «o_orderstatus» now c«o_custkey» commented on «strftime(o_orderdate, $$%B %-d, %Y$$)» «o_orderpriority»')} AS description,
  {filled('<div class="issue-author"><strong>u«o_custkey»</strong> opened this issue on «strftime(o_orderdate, $$%B %-d, %Y$$)»</div>')} || chr(10) || chr(10) || {filled('<div class="issue-body"><p>Status  «o_orderstatus» now</p></div>')} || chr(10) || chr(10)
  || '<div class="comment">' || chr(10) || {filled('<div class="comment-header"><strong>c«o_custkey»</strong> commented on «strftime(o_orderdate, $$%B %-d, %Y$$)»</div>')} || chr(10) || {filled('<div class="comment-body"><p>«o_orderpriority»</p></div>')} || chr(10) || '</div>' || chr(10) || chr(10) AS content FROM orders"""
)
def rendered_github(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Issues and comments, the second copy of a comment left out."""
    when = '<relative-time datetime="«CAST(o_orderdate AS DATE)»T00:00:00Z"></relative-time>'
    comment = f'<div data-wrapper-timeline-id="t1"><div class="react-issue-comment"><a data-testid="avatar-link" href="/c«o_custkey»">c</a>{when}<div class="markdown-body"><p>«o_orderpriority»</p><div class="zeroclipboard-container">copy</div></div></div></div>'
    html = '<head><meta name="expected-hostname" content="github.com"><title>Issue «o_orderkey»</title></head><body><h1 data-testid="issue-title">x</h1><div data-testid="issue-viewer-issue-container">'
    html += f'<a data-testid="issue-body-header-author" href="https://github.com/u«o_custkey»?x=1">u</a>{when}<div data-testid="issue-body-viewer"><div class="markdown-body"><p>Status  «o_orderstatus» now</p><button>b</button></div></div></div>{comment}{comment}</body>'
    return extract(_rows(spark, sf_dir, "orders", "o_orderkey", filled("https://github.com/own/rep/issues/«o_orderkey»"), filled(html))).select("page_id", "extractor_type", "title", "site", "description", "content")


# Elements


def _elements(spark: SparkSession, sf_dir: str, which: str, html: str) -> DataFrame:
    return elements.process_pages(_rows(spark, sf_dir, "part", "p_partkey", "''", html), which)


def _element_sql(*expected: str) -> str:
    return f"SELECT p_partkey AS page_id, {by_case('p_partkey', *expected)} AS html FROM part"


@_query(
    _element_sql(
        '<pre><code data-lang="python" class="language-python">x = «p_size»«chr(10)»    y</code></pre>',
        '<pre><code data-lang="java" class="language-java">int «p_size»«chr(10)»}</code></pre>',
        '<p>a</p><pre><code data-lang="rust" class="language-rust">fn f«p_size»()«chr(10)»«chr(10)»end</code></pre>',
        "<pre><code>plain «p_size»</code></pre>",
    )
)
def rendered_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Code blocks of four highlighters."""
    return _elements(
        spark,
        sf_dir,
        "code",
        by_case(
            "p_partkey",
            '<body><div class="highlight"><pre><code class="language-python">x = «p_size»<br>«chr(9)»y</code></pre></div></body>',
            '<body><div class="syntaxhighlighter nogutter java"><div class="code"><div class="container"><div class="line"><code class="keyword">int</code><code class="spaces">&nbsp;</code><code>«p_size»</code></div><div class="line"><code>}</code></div></div></div></div></body>',
            '<body><p>a</p><pre data-lang="Rust"><span class="lineno">1</span>fn f«p_size»()«chr(10)»«chr(10)»«chr(10)»«chr(10)»end</pre></body>',
            "<body><pre>«chr(10)»plain «p_size»«chr(10)»</pre></body>",
        ),
    )


@_query(
    _element_sql(
        '<h2 id="h«p_partkey»">«p_name»</h2><p>x</p>',
        '<h3 class="c">«p_name»</h3>',
        "<h1>«p_name»</h1>",
        "<h1>«p_name»</h1>",
    )
)
def rendered_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headings with links, buttons and markup in them; the last two have only links' texts."""
    return _elements(
        spark,
        sf_dir,
        "headings",
        by_case(
            "p_partkey",
            '<body><h2 id="h«p_partkey»" data-x="1">«p_name» <a href="#h">#</a><button>copy</button></h2><p>x</p></body>',
            '<body><h3 class="c" style="color: red"><em>«p_name»</em><span><a href="#x">¶</a></span><i class="anchor">§</i></h3></body>',
            '<body><h1><a href="#top">«p_name»</a></h1></body>',
            '<body><h1><button>copy</button><span><a href="#a">«p_name»</a> here</span><a href="#b">other</a></h1></body>',
        ),
    )


_MATH = '<math xmlns="http://www.w3.org/1998/Math/MathML" display="{}" data-latex="{}">{}</math>'


@_query(
    _element_sql(
        "<p>" + _MATH.format("block", "x^«p_size»", "<mi>x</mi>") + "</p>",
        "<p>" + _MATH.format("inline", "y_«p_size»", "y_«p_size»") + "</p>",
        "<p>" + _MATH.format("block", "z^«p_size»", "z^«p_size»") + "</p>",
        '<p>a <math xmlns="http://www.w3.org/1998/Math/MathML" display="inline"><mn>«p_size»</mn></math></p>',
    )
)
def rendered_math(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MathML, LaTeX in attributes, scripts and texts, in lines and blocks."""
    return _elements(
        spark,
        sf_dir,
        "math",
        by_case(
            "p_partkey",
            '<body><p><math display="block" data-latex="x^«p_size»"><mi>x</mi></math></p></body>',
            '<body><p><span class="MathJax_Preview">y</span><script type="math/tex">y_«p_size»</script></p></body>',
            '<body><p><span class="katex-display" data-tex="z^«p_size»">z</span></p></body>',
            "<body><p>a <math><mn>«p_size»</mn></math></p></body>",
        ),
    )


_IMG = 'loading="eager" decoding="async" fetchpriority="high" class="{}responsive-image" style="max-width: 100%; height: auto;" sizes="(max-width: 768px) 100vw, 50vw"'


@_query(
    _element_sql(
        f'<img src="/a/«p_type»-view.png" alt="«substr(p_type, 1, 1) || substr(p_type, 2)» view" {_IMG.format("")}/>',
        f'<figure class="image-figure large-image"><img width="900" alt="The «p_name» on a table" src="/l«p_partkey».jpg" {_IMG.format("")} id="img-1"/><figcaption>The «p_name» on a table</figcaption></figure>',
        f'<p>x</p><img class="big responsive-image" src="/p.gif" title="Seen «p_size»" alt="Seen «p_size»" {_IMG.format("").replace('class="responsive-image" ', "")}/>',
        "<p>«p_name»</p>",
    )
)
def rendered_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alternative texts, lazy sources, figures with captions, and images that go: small, decorative or tracking ones."""
    return _elements(
        spark,
        sf_dir,
        "images",
        by_case(
            "p_partkey",
            '<body><img src="/a/«p_type»-view.png"></body>',
            '<body><figure><img width="900" data-src="/l«p_partkey».jpg" alt="The «p_name» on a table"><figcaption> </figcaption></figure></body>',
            '<body><p>x</p><img class="lazy big" src="/p.gif" title="Seen «p_size»" alt="image"></body>',
            '<body><p>«p_name»</p><img src="/pixel.gif"><img class="avatar" src="/a.png"><img width="«p_partkey % 40 + 1»" src="/i.png"></body>',
        ),
    )


@_query(
    _element_sql(
        '<p>a<sup><a href="#fn:1" id="fnref:1" role="doc-noteref" aria-describedby="fn:1">1</a></sup></p><p id="fn:1" role="doc-endnote">Note «p_name»</p><div class="footnotes"><h2>Footnotes</h2><ol><li id="fn:1">Note «p_name» <a href="#fnref:1" class="footnote-backref">↩</a></li></ol></div>',
        "<p>«p_name»</p>",
    )
)
def rendered_footnotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _elements(spark, sf_dir, "footnotes", by_case("p_partkey", '<body><p>a<sup><a href="#n1">1</a></sup></p><p id="n1">Note «p_name»</p></body>', "<body><p>«p_name»</p></body>"))


@_query(
    _element_sql(
        "<ol><li>«p_name»</li><li>«p_size»</li></ol>",
        '<p>«p_name»</p><a href="/x">«p_size»</a><button>b</button>',
        "<ul><li>«p_name»</li></ul>",
    )
)
def rendered_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists, paragraphs, links and buttons by their roles."""
    return _elements(
        spark,
        sf_dir,
        "roles",
        by_case(
            "p_partkey",
            '<body><div role="list"><div role="listitem"><span class="label">1)</span>«p_name»</div><div role="listitem"><span class="label">2)</span>«p_size»</div></div></body>',
            '<body><div role="paragraph">«p_name»</div><span role="link" href="/x">«p_size»</span><button role="button">b</button></body>',
            '<body><div role="list"><div role="listitem"><span class="label">-</span>«p_name»</div></div></body>',
        ),
    )

# Sources and sinks


def _served(url: str, client: web.Client) -> web.Response:
    """A server by the URL alone: its last part is the text of the page, and the one before it how the page is sent."""
    how, text = url.split("/")[-2:]
    page = unquote_plus(text)
    if how == "0":
        return web.Response(200, url, "text/html; charset=ISO-8859-1", page.encode("cp1252"))
    if how == "1":
        return web.Response(200, url + "#end", "text/html", codecs.BOM_UTF16_LE + page.encode("utf-16-le"))
    if how == "2":
        return web.Response(200, url, "", b"<meta charset='windows-1252'>" + page.encode("cp1252"))
    if how == "3":
        return web.Response(200, url, "text/html", page.encode())
    return web.Response(404, url, "text/html", b"", "status 404")


_HOW = "(conv_id + turn) % 5"


@_query(
    f"""SELECT conv_id * 1000000 + turn AS page_id, CAST(CASE WHEN {_HOW} = 4 THEN 404 ELSE 200 END AS INT) AS fetch_status, CASE WHEN {_HOW} = 4 THEN 'status 404' END AS fetch_error, {_HOW} = 1 AS moved,
  CASE {_HOW} WHEN 4 THEN '' WHEN 2 THEN '<meta charset=''windows-1252''>' || text ELSE text END AS html FROM conversations"""
)
def rendered_fetch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages fetched where the table of URLs lies, from a server that sends each in one of four charsets, moves it, or hasn't got it."""
    urls = spark.read.parquet(f"{sf_dir}/conversations.parquet").selectExpr("conv_id * 1000000 + turn AS page_id", f"'https://a.example/' || {_HOW} || '/' || url_encode(text) AS url")
    got = web.fetch_urls(urls, fetcher=_served)
    final = web.effective_url(F.lit(""), F.col("url"), F.col("requested_url"))
    return got.select("page_id", "fetch_status", "fetch_error", (final != F.col("requested_url")).alias("moved"), "html")


@_query(
    f"""SELECT c_custkey AS page_id, c_name AS title, '' AS author, {filled('<p>«c_mktsegment»</p>')} AS content, '1' AS words, '[{{"name":"k","content":"' || CAST(c_nationkey AS STRING) || '"}}]' AS tags, 'null' AS items,
  {filled('h«c_custkey».example')} AS json_domain, CAST(1 AS BIGINT) AS json_words FROM customer"""
)
def rendered_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Properties by their public names, absent ones null (here: ''), and the record as JSON."""
    html = filled('<html><head><title>«c_name»</title><meta name="k" content="«c_nationkey»"></head><body><article><p>«c_mktsegment»</p></article></body></html>')
    results = extract(_rows(spark, sf_dir, "customer", "c_custkey", filled("https://www.h«c_custkey».example/"), html))
    names = {"title": "TITLE", "author": "author", "content": "Content", "words": "wordCount", "tags": "metaTags", "items": "schemaOrgData"}
    columns = [F.coalesce(sinks.property_column(n), F.lit("")).alias(c) for c, n in names.items()]
    # From one pass over the pages.
    whole = results.select("page_id", *columns, contract_column(results).alias("json"))
    return whole.select("page_id", *names, F.get_json_object("json", "$.domain").alias("json_domain"), F.get_json_object("json", "$.wordCount").cast("long").alias("json_words"))


# Scoring and removal

_WORDS = "repeat('w ', p_size)"


@_query(
    """SELECT p_partkey AS page_id, round(p_size + 3 + 10.0 * (p_partkey % 4) - 5.0 * 2 / (p_size + 3) - 3.0 / (p_size + 3)
  + CASE p_partkey % 7 WHEN 0 THEN 5 WHEN 1 THEN 10 WHEN 2 THEN 10 WHEN 3 THEN 15 WHEN 4 THEN 10 WHEN 5 THEN 10 ELSE -5 END
  + CASE p_partkey % 7 WHEN 1 THEN 3 WHEN 2 THEN 3 WHEN 4 THEN 1 WHEN 5 THEN 1 ELSE 0 END
  + CASE WHEN p_partkey % 7 IN (1, 2) THEN 13.0 / (p_size + 3) - 13.0 / (p_size + 6) WHEN p_partkey % 7 IN (4, 5) THEN 13.0 / (p_size + 3) - CASE p_partkey % 7 WHEN 4 THEN 18.0 ELSE 13.0 END / (p_size + 4) ELSE 0 END, 6) AS score FROM part"""
)
def rendered_block_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every term of a block's score: words, paragraphs, links, images, the right side, dates, bylines, classes, notes and tables."""
    special = by_case("p_partkey", "", " Jan 5, 2024", " by Ann Lee", "", ' <sup class="reference"><a>1</a></sup>', ' <ol class="references"><li>n</li></ol>', "<table></table>")
    look = by_case("p_partkey", 'align="right"', "", "", 'class="Article-x"', "", "", "")
    block = f"<section «{look}»>«{_WORDS}» <a>b</a> <a>c</a> <img src=\"/i.png\">«{special}» d«repeat('<p></p>', CAST(p_partkey % 4 AS INT))»</section>"
    found = nodes.score_blocks(nodes.parse_nodes(_rows(spark, sf_dir, "part", "p_partkey", "''", filled("<body>" + block + "</body>"))))
    return found.selectExpr("page_id", "round(score, 6) AS score")


_MAIN = "<p>one «p_name»</p><p>two «p_size»</p><p>three</p><p>four</p><p>five «p_type»</p><p>six</p>"


@_query(
    f"""SELECT p_partkey AS page_id, {filled(_MAIN)} AS content, CASE p_partkey % 5 WHEN 0 THEN 'table_cell' WHEN 1 THEN 'scored_block' WHEN 2 THEN '.post-content' WHEN 3 THEN '[role="main"]' ELSE 'body' END AS found FROM part"""
)
def rendered_main_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main content by entry points in their order, whatever the order in the page."""
    html = by_case(
        "p_partkey",
        f'<body><table width="500"><tr><td>left</td><td>{_MAIN}</td><td>right</td></tr></table></body>',
        f'<body><div>short</div><div>{_MAIN}</div></body>',
        f'<body><main>other</main><div class="post-content">{_MAIN}</div><div id="other">x</div></body>',
        f'<body><div>x</div><div role="main">{_MAIN}</div></body>',
        f"<body>{_MAIN}</body>",
    )
    return extract(_rows(spark, sf_dir, "part", "p_partkey", "''", html), Options(debug=True)).selectExpr("page_id", "content", "debug_info.main_content AS found")


@_query(
    """SELECT p_partkey AS page_id, CASE p_partkey % 6 WHEN 0 THEN 'hidden ' WHEN 1 THEN 'exact .ad:not([class*="gradient"])' WHEN 2 THEN 'partial ' WHEN 3 THEN 'small_image |small_image ' WHEN 4 THEN 'score |score ' ELSE 'hidden ' END AS removed, '<p>' || p_name || '</p>' AS content FROM part"""
)
def rendered_removed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is taken out of the content and why: hidden, by exact and partial selectors, small images with their larger copies, by score (the short article too, whose
    content stays as it is the main one), by the caller's styles."""
    clutter = (
        '<p style="display:none">x</p>',
        '<p class="ad">x</p>',
        '<p class="my-newsletter-box">x</p>',
        '<img src="/a.png" width="«p_partkey % 30 + 1»"><img src="/a.png" width="900">',
        '<div><a href="/a">read more</a> <a href="/b">share</a> <a href="/c">comments</a></div>',
        '<p class="aa">x</p>',
    )
    html = by_case("p_partkey", *(f"<body><article><p>«p_name»</p>{c}</article></body>" for c in clutter))
    options = Options(debug=True, partial_patterns=("newsletter",), mobile_styles=((".aa", "display: none"),))
    return extract(_rows(spark, sf_dir, "part", "p_partkey", "''", html), options).selectExpr("page_id", "array_join(transform(debug_info.removed, r -> r.reason || ' ' || r.selector), '|') AS removed", "content")


def _own_site(tree, url: str, items: list) -> dict:
    return {"content_html": "<p>own</p>", "extracted": {}, "variables": {"title": url.rsplit("/", 1)[-1], "site": "Own"}}


@_query(
    f"""SELECT c_custkey AS page_id, CASE WHEN c_custkey % 2 = 0 THEN 'own' END AS extractor_type, CASE WHEN c_custkey % 2 = 0 THEN CAST(c_custkey AS STRING) ELSE c_name END AS title, CASE WHEN c_custkey % 2 = 0 THEN '<p>own</p>' ELSE {filled('<p>«c_mktsegment»</p>')} END AS content FROM customer"""
)
def rendered_own_extractor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A caller's extractor for a site, images left out elsewhere."""
    url = by_case("c_custkey", "https://own.example/«c_custkey»", "https://else.example/«c_custkey»")
    html = filled('<title>«c_name»</title><body><article><p>«c_mktsegment»</p><picture><img src="/big.png"></picture></article></body>')
    return extract(_rows(spark, sf_dir, "customer", "c_custkey", url, html), Options(extractors=(("own", ("own.example",), _own_site),), remove_images=True)).select("page_id", "extractor_type", "title", "content")


# The whole way


@_query(
    _element_sql(
        "<h2>Part «p_partkey»</h2><p>«p_name» and more</p>",
        "<p>«p_name» <br/> <br/> «p_size»</p>",
        "<ol><li><p>«p_name»</p></li></ol>",
        '<iframe width="560" height="315" src="https://www.youtube.com/embed/v«p_partkey»" title="«p_name»" frameborder="0" allow="accelerometer; autoplay; clipboard-write; encrypted-media; gyroscope; picture-in-picture; web-share" allowfullscreen=""></iframe><p>x</p>',
        "<p>«p_name»</p>",
        '<p>«p_name» <sup id="fnref:1">1</sup></p>',
    )
)
def rendered_standard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headings, wrappers, attributes, empty elements, breaks, lists, players, clutter and notes on the whole way of a page."""
    page = "<html><head><title>«p_name»</title></head><body><nav>menu</nav><article>{}</article><footer>end</footer></body></html>"
    cases = (
        '<div class="wrapper"><div><h1 style="x" data-a="1">Part «p_partkey»</h1></div></div><p onclick="f()">«p_name» and more</p><div><span> </span></div><h3>Next</h3>',
        "<p>«p_name»<br><br><br><br>«p_size»</p>",
        '<div role="list"><div role="listitem"><span class="label">1)</span><div class="content"><div role="paragraph">«p_name»</div></div></div></div>',
        '<lite-youtube videoid="v«p_partkey»" videotitle="«p_name»"></lite-youtube><p>x</p>',
        '<h1>«upper(p_name)»</h1><p>«p_name»</p><div style="display: none">hidden</div><div class="ad">ad</div><form>f</form><aside class="related-posts">r</aside><img width="20" height="20" src="/i.png">',
        '<p>«p_name»<sup class="reference" id="fnref:1">1</sup> <a class="footnote-backref" href="#x">↩</a></p>',
    )
    return extract(_rows(spark, sf_dir, "part", "p_partkey", "''", by_case("p_partkey", *(page.format(c) for c in cases)))).selectExpr("page_id", "content AS html")


@_query(
    f"""SELECT p_partkey AS page_id, {by_case('p_partkey', '## Part «p_partkey»«chr(10) || chr(10)»«p_name» **«p_size»** and [«p_type»](/t)', '- «p_name»«chr(10)»- «p_size»', '```sql«chr(10)»select «p_size»«chr(10)»```', '> «p_name»«chr(10) || chr(10)»* * *«chr(10) || chr(10)»`«p_size»`')} AS markdown FROM part"""
)
def rendered_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Markdown of headings, inline markup, lists, code, quotes and rules."""
    cases = (
        '<h1>Part «p_partkey»</h1><p>«p_name» <strong>«p_size»</strong> and <a href="/t">«p_type»</a></p>',
        "<ul><li>«p_name»</li><li>«p_size»</li></ul>",
        '<pre><code class="language-sql">select «p_size»</code></pre>',
        "<blockquote><p>«p_name»</p></blockquote><hr><p><code>«p_size»</code></p>",
    )
    html = by_case("p_partkey", *(f"<body><article>{c}</article></body>" for c in cases))
    return extract(_rows(spark, sf_dir, "part", "p_partkey", "''", html), Options(markdown=True)).selectExpr("page_id", "content_markdown AS markdown")


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
