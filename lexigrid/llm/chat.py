"""Chat formatting, native: all in DataFrame operations.

A declarative template says for each role what stands before and after its text and whether the
text counts for the loss. A finite-state machine over the roles validates the order of turns. A
conversation becomes a list of segments, each with a loss flag; the formatted text is their
concatenation, and its loss mask a list of spans in it. Control strings inside texts and roles are broken by a backslash after their first
character, and backslashes are doubled, so that texts can't forge marks and can be read back.

Defined cases. Null text or role: empty. Null turn: before all others. Rows that share a turn follow by
role, then text; repeated rows are turns of their own. Rows with a null conv_id form one
conversation. Roles that the template doesn't name are formatted without loss. A conversation in
the wrong order is formatted as well, has `valid` false, and `wrong_turn` is its first turn (from 0) that
the machine doesn't allow, null if it only ends too early. Very long texts are escaped in place. An empty
table gives no conversations. Other columns, whatever their names, are ignored.

Scale: one shuffle by conversation. A conversation is a single output value and so fits in a row.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F


@dataclass(frozen=True)
class Template:
    turn_mark: str = "<|im_start|>"
    text_mark: str = "<|im_sep|>"
    end_mark: str = "<|im_end|>"
    loss_roles: tuple[str, ...] = ("assistant",)
    #: strings that mean something to models; no text may hold them as they are
    controls: tuple[str, ...] = ("<|", "|>", "</s>", "<s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
    #: state -> {role: next state}; a conversation is valid if it ends in a final state
    transitions: dict[str, dict[str, str]] = field(
        default_factory=lambda: {
            "start": {"system": "primed", "user": "asked"},
            "primed": {"user": "asked"},
            "asked": {"assistant": "answered", "tool": "asked"},
            "answered": {"user": "asked", "tool": "asked"},
        }
    )
    final: tuple[str, ...] = ("answered",)


def _quote(text: str) -> str:
    return "".join(f"\\{c}" if c in r"\.^$|?*+()[]{}<>/" else c for c in text)


def escape(text: Column, template: Template) -> Column:
    """Backslashes doubled, and one put after the first character of each control string."""
    heads = "|".join(f"{_quote(c[0])}(?={_quote(c[1:])})" for c in sorted(set(template.controls), key=lambda c: (-len(c), c)))
    return F.regexp_replace(F.regexp_replace(text, r"\\", r"\\\\"), f"({heads})", r"$1\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _next_state(state: Column, role: Column, template: Template) -> Column:
    chosen = F.lit("wrong")
    for begin, steps in template.transitions.items():
        for name, end in steps.items():
            chosen = F.when((state == begin) & (role == name), F.lit(end)).otherwise(chosen)
    return chosen


def format_conversations(rows: DataFrame, template: Template | None = None, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, n_turns, valid, wrong_turn, segments (array of text, loss), formatted, loss_spans."""
    template = template or Template()
    empty = F.lit("")
    turn = F.struct(F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), empty).alias("role"), F.coalesce(F.col(text_col), empty).alias("text"))
    turns = rows.groupBy(F.col(conv_col).alias("conv_id")).agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    segment = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
    segments = F.flatten(
        F.transform(
            "turns",
            lambda t: F.array(
                segment(F.concat(F.lit(template.turn_mark), escape(t["role"], template), F.lit(template.text_mark)), F.lit(False)),
                segment(escape(t["text"], template), t["role"].isin(*template.loss_roles)),
                segment(F.lit(template.end_mark), F.lit(False)),
            ),
        )
    )
    begin = F.expr("named_struct('state', 'start', 'at', 0, 'wrong', cast(null as int))")

    def step(s: Column, t: Column) -> Column:
        now = _next_state(s["state"], t["role"], template)
        return F.struct(now.alias("state"), (s["at"] + 1).alias("at"), F.when(s["wrong"].isNull() & (now == "wrong"), s["at"]).otherwise(s["wrong"]).alias("wrong"))

    formed = turns.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.aggregate("turns", begin, step).alias("end"), segments.alias("segments"))
    return formed.select(
        "conv_id",
        "n_turns",
        F.col("end.state").isin(*template.final).alias("valid"),
        F.col("end.wrong").cast("long").alias("wrong_turn"),
        "segments",
        F.concat_ws("", F.transform("segments", lambda s: s["text"])).alias("formatted"),
        loss_spans(F.col("segments")).alias("loss_spans"),
    )


def loss_spans(segments: Column) -> Column:
    """array of (start, stop) in characters of the formatted text: the segments under the loss mask."""

    def step(s: Column, x: Column) -> Column:
        stop = s["at"] + F.length(x["text"])
        span = F.struct(s["at"].alias("start"), stop.alias("stop"))
        return F.struct(stop.alias("at"), F.when(x["loss"], F.array_append(s["spans"], span)).otherwise(s["spans"]).alias("spans"))

    return F.aggregate(segments, F.expr("named_struct('at', 0, 'spans', cast(array() as array<struct<start:int,stop:int>>))"), step)["spans"]


def read_back(formatted: Column, template: Template | None = None) -> Column:
    """array of (role, text) from a formatted conversation."""
    template = template or Template()
    parts = F.filter(F.split(formatted, _quote(template.turn_mark)), lambda p: p != "")

    def turn(part: Column) -> Column:
        body = F.substring(part, F.lit(1), F.length(part) - F.lit(len(template.end_mark)))
        halves = F.split(body, _quote(template.text_mark), 2)
        return F.struct(unescape(F.element_at(halves, 1)).alias("role"), unescape(F.element_at(halves, 2)).alias("text"))

    return F.transform(parts, turn)


def loss_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, from the formatted text."""
    return F.concat_ws("", F.transform(spans, lambda s: unescape(F.substring(formatted, s["start"] + 1, s["stop"] - s["start"]))))
