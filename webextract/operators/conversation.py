"""Rendering conversations: messages and footnotes to HTML, for single pages and as a set-at-a-time operator."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_PARAGRAPH = re.compile(r"<p[^>]*>[\s\S]*?</p>", re.I)


@dataclass
class Message:
    author: str
    content: str
    timestamp: str = ""
    metadata: dict[str, str] = field(default_factory=dict)


@dataclass
class Footnote:
    url: str
    text: str


def message_html(m: Message) -> str:
    data = "".join(f' data-{k}="{v}"' for k, v in sorted(m.metadata.items()))
    content = m.content if _PARAGRAPH.search(m.content) else f"<p>{m.content}</p>"
    stamp = f'<div class="message-timestamp">{m.timestamp}</div>' if m.timestamp else ""
    head = f'<div class="message-header"><p class="message-author"><strong>{m.author}</strong></p>{stamp}</div>'
    return f'<div class="message message-{m.author.lower()}"{data}>{head}<div class="message-content">{content}</div></div>'


def footnotes_html(notes: list[Footnote]) -> str:
    if not notes:
        return ""
    items = "".join(
        f'<li class="footnote" id="fn:{i}"><p><a href="{n.url}" target="_blank">{n.text}</a>&nbsp;<a href="#fnref:{i}" class="footnote-backref">↩</a></p></li>' for i, n in enumerate(notes, 1)
    )
    return f'<div id="footnotes"><ol>{items}</ol></div>'


def conversation_html(messages: list[Message], notes: list[Footnote] = ()) -> str:
    parts = ["\n<hr>".join(map(message_html, messages)), footnotes_html(list(notes))]
    return "\n".join(p for p in parts if p).strip()


def conversation_result(messages: list[Message], notes: list[Footnote], title: str, site: str, description: str = "") -> dict:
    return {
        "content_html": conversation_html(messages, notes),
        "extracted": {"messageCount": str(len(messages))},
        "variables": {"title": title, "site": site, "description": description or f"{site} conversation with {len(messages)} messages"},
    }


def render_conversations(messages: DataFrame, site: str = "Chat") -> DataFrame:
    """messages: conv_id, turn, role, text. Returns conv_id, html, message_count, title, description: the same HTML by expressions.

    The title is the first 50 characters of the first user's text.
    """
    wrapped = F.when(F.col("text").rlike(r"(?is)<p[^>]*>.*?</p>"), F.col("text")).otherwise(F.concat(F.lit("<p>"), "text", F.lit("</p>")))
    piece = F.concat(
        F.lit('<div class="message message-'),
        F.lower("role"),
        F.lit('"><div class="message-header"><p class="message-author"><strong>'),
        F.col("role"),
        F.lit('</strong></p></div><div class="message-content">'),
        wrapped,
        F.lit("</div></div>"),
    )
    rows = messages.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).withColumn("piece", piece)
    ordered = F.sort_array(F.collect_list(F.struct("turn", "role", "text", "piece")))
    whole = rows.groupBy("conv_id").agg(ordered.alias("m"))
    first = F.element_at(F.filter("m", lambda x: x["role"] == "user"), 1)["text"]
    return whole.select(
        "conv_id",
        F.concat_ws("\n<hr>", F.transform("m", lambda x: x["piece"])).alias("html"),
        F.size("m").cast("long").alias("message_count"),
        F.when(F.size(F.filter("m", lambda x: x["role"] == "user")) > 0, F.when(F.length(first) > 50, F.concat(F.substring(first, 1, 50), F.lit("..."))).otherwise(first)).otherwise(F.lit(f"{site} Conversation")).alias("title"),
        F.concat(F.lit(f"{site} conversation with "), F.size("m").cast("string"), F.lit(" messages")).alias("description"),
    )
