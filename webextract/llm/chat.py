"""Chat formatting with DataFrame functions only.

A declarative template says how a turn is written, which roles carry loss and which role may follow which. A finite-state machine runs
over the roles of each conversation; the formatted text is cut into segments, each with a loss flag.

Escaping: inside roles and texts a backslash is doubled and every control string of the template gets a backslash after its first
character, so no control string is left in what a turn contains, and removing one backslash before each character restores it.

Defined results. Null role or text: empty. Turns are ordered by (turn, role, text), so ties and repeated rows have one order; a null
turn comes first. Rows with a null conv_id form one conversation. An empty table gives an empty one. A conversation whose roles break
the transitions is formatted all the same, with valid false and error_turn its first offending turn (from 0). One conversation is one
row: its whole text has to fit in a row, as its digest is defined over it.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class ChatTemplate:
    open: str = "<turn>"
    role_end: str = "</role>"
    close: str = "</turn>"
    loss_roles: tuple[str, ...] = ("assistant",)
    start: str = "start"
    #: (state, role) to the next state; a pair that isn't here is an error.
    transitions: dict[tuple[str, str], str] = field(
        default_factory=lambda: {
            ("start", "system"): "system",
            ("start", "user"): "user",
            ("system", "user"): "user",
            ("user", "assistant"): "assistant",
            ("assistant", "user"): "user",
        }
    )
    #: States in which a conversation may end.
    final: tuple[str, ...] = ("user", "assistant")

    def __post_init__(self) -> None:
        for c in self.controls:
            if len(c) < 2 or "\\" in c or c[0] in c[1:]:
                raise ValueError(f"a control string has two characters or more, no backslash, and its first character once: {c!r}")

    @property
    def controls(self) -> tuple[str, ...]:
        return (self.open, self.role_end, self.close)


def escaped(text: Column, template: ChatTemplate) -> Column:
    text = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for c in template.controls:
        text = F.replace(text, F.lit(c), F.lit(f"{c[0]}\\{c[1:]}"))
    return text


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def format_chats(rows: DataFrame, template: ChatTemplate = ChatTemplate()) -> DataFrame:
    """rows: conv_id, turn, role, text. Returns conv_id, segments (array of text and loss), formatted, valid, error_turn."""
    clean = rows.select(
        "conv_id",
        F.struct("turn", F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).alias("t"),
    )
    chats = clean.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    piece = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
    no = F.lit(False)
    segments = F.flatten(
        F.transform(
            "turns",
            lambda t: F.array(
                piece(F.concat(F.lit(template.open), escaped(t["role"], template), F.lit(template.role_end)), no),
                piece(escaped(t["text"], template), t["role"].isin(*template.loss_roles)),
                piece(F.lit(template.close), no),
            ),
        )
    )
    moves = F.create_map(*[F.lit(x) for (state, role), to in template.transitions.items() for x in (f"{state}\n{role}", to)])
    # The fold keeps (state, place, first error); '' is the state after an error.
    begin = F.struct(F.lit(template.start).alias("state"), F.lit(0).alias("at"), F.lit(-1).alias("error"))

    def step(acc: Column, t: Column) -> Column:
        to = F.coalesce(F.try_element_at(moves, F.concat(acc["state"], F.lit("\n"), t["role"])), F.lit(""))
        return F.struct(to.alias("state"), (acc["at"] + 1).alias("at"), F.when((acc["error"] < 0) & (to == ""), acc["at"]).otherwise(acc["error"]).alias("error"))

    state = F.aggregate("turns", begin, step)
    return (
        chats.select("conv_id", segments.alias("segments"), state.alias("state"))
        .withColumn("formatted", F.concat_ws("", F.transform("segments", lambda s: s["text"])))
        .select(
            "conv_id",
            "segments",
            "formatted",
            F.col("state.state").isin(*template.final).alias("valid"),
            F.when(F.col("state.error") >= 0, F.col("state.error")).alias("error_turn"),
        )
    )


def read_back(formatted: Column, template: ChatTemplate = ChatTemplate()) -> Column:
    """The turns (role, text) of a formatted conversation, from its text alone."""
    pieces = F.split(formatted, "\\Q" + template.close + "\\E")
    pieces = F.slice(pieces, 1, F.greatest(F.size(pieces) - 1, F.lit(0)))

    def turn(p: Column) -> Column:
        rest = F.substring(p, F.lit(len(template.open) + 1), F.length(p))
        role = F.substring_index(rest, template.role_end, 1)
        text = F.substring(rest, F.length(role) + len(template.role_end) + 1, F.length(rest))
        return F.struct(unescaped(role).alias("role"), unescaped(text).alias("text"))

    return F.transform(pieces, turn)


def loss_text(segments: Column) -> Column:
    """All text under the loss mask, unescaped, in order."""
    return F.concat_ws("", F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescaped(s["text"])))


def digests(formatted: DataFrame, template: ChatTemplate = ChatTemplate()) -> DataFrame:
    """Counts and hashes of what the formatted conversations hold, read back from them."""
    nl = F.lit("\n")
    read = formatted.select("conv_id", read_back(F.col("formatted"), template).alias("turns"), loss_text(F.col("segments")).alias("loss"), "formatted", "valid", "error_turn")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.concat_ws("", F.transform("turns", lambda t: F.concat(t["role"], nl, t["text"], nl))), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "valid",
        "error_turn",
    )
