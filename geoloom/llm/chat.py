"""Chat formatting with a grammar round trip, in DataFrame functions only.

A conversation is written as one string: each turn is ``<|im_start|>role``, a line feed, the text,
``<|im_end|>`` and a line feed.  A control string is ``<|``; escaped content has one backslash more
between ``<`` and ``|`` than the source, so written turns hold no control string of their own and
one parser reads every string the same way.  Turns are first written as they are and read back; a
conversation whose turns do not come back the same is written again with the conflicting content
escaped, until what is read equals the source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
#: Turns of a conversation and their texts: array<struct<role:string,text:string>>.
TURNS = "turns"


def escape(text: Column) -> Column:
    """One backslash more in every ``<``, backslashes, ``|``."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def escape_role(role: Column) -> Column:
    """A role is one line; percent signs, line feeds and ``<`` are written by their codes."""
    return F.replace(F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A")), F.lit("<"), F.lit("%3C"))


def unescape_role(role: Column) -> Column:
    return F.replace(F.replace(F.replace(role, F.lit("%3C"), F.lit("<")), F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))


def render(turns: Column, escaped: bool) -> Column:
    """The string of an array of turns."""
    role = (lambda t: escape_role(t["role"])) if escaped else (lambda t: t["role"])
    text = (lambda t: escape(t["text"])) if escaped else (lambda t: t["text"])
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit(START), role(t), F.lit("\n"), text(t), F.lit(END), F.lit("\n"))), "")


def parse(formatted: Column) -> Column:
    """The turns of a string: array of (role, text, head, body), the last two as they are written.

    The string is cut at every end mark.  A turn is what stands before one: a line feed that ended
    the turn before, the start mark, a head up to the first line feed and a body, neither holding a
    control string.  Fields are null where that is not so.
    """
    parts = F.split(formatted, r"\Q" + END + r"\E")
    last = F.element_at(parts, -1)
    whole = F.when(last == "\n", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)

    def turn(part: Column, at: Column) -> Column:
        mark = F.when(at == 0, F.lit(START)).otherwise(F.lit("\n" + START))
        inner = F.substring(part, F.length(mark) + 1, F.length(part))
        cut = F.locate("\n", inner, 1)
        fits = part.startswith(mark) & (cut > 0) & ~inner.contains(F.lit("<|"))
        head, body = F.substring(inner, F.lit(1), cut - 1), F.substring(inner, cut + 1, F.length(inner))
        return F.struct(
            F.when(fits, unescape_role(head)).alias("role"), F.when(fits, unescape(body)).alias("text"),
            F.when(fits, head).alias("head"), F.when(fits, body).alias("body"),
        )

    return F.transform(whole, turn)


def as_source(parsed: Column) -> Column:
    return F.transform(parsed, lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))


def conversations(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, turns): the turns of each conversation in order.

    Null roles and texts are empty.  Turns are ordered by turn (null first), then role, then text; so
    repeated rows and equal turns follow each other.  A null conversation id is an id of its own.
    A conversation becomes one string, so its turns come together; whole conversations spread by id.
    """
    one = F.struct(F.col(turn).alias("turn"), F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"))
    ordered = F.array_sort(F.collect_list(one), _in_order)
    return rows.groupBy(F.col(conv).alias("conv_id")).agg(
        F.transform(ordered, lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias(TURNS)
    )


def _in_order(a: Column, b: Column) -> Column:
    nulls = F.when(a["turn"].isNull() & b["turn"].isNotNull(), -1).when(a["turn"].isNotNull() & b["turn"].isNull(), 1)
    for key in ("turn", "role", "text"):
        nulls = nulls.when(a[key] < b[key], -1).when(a[key] > b[key], 1)
    return nulls.otherwise(0)


def format_chats(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, formatted, parsed, escaped): every conversation as a string that reads back the same.

    ``parsed`` is what the parser reads in ``formatted``; ``escaped`` tells whether content had to be
    escaped.  No rows give no rows.  Columns not named are ignored.
    """
    plain = conversations(rows, conv, turn, role, text).withColumn("formatted", render(F.col(TURNS), False)).withColumn("parsed", parse(F.col("formatted")))
    judged = plain.withColumn("escaped", ~F.coalesce(as_source(F.col("parsed")) == F.col(TURNS), F.lit(False)))
    final = F.when(F.col("escaped"), render(F.col(TURNS), True)).otherwise(F.col("formatted"))
    again = judged.select("conv_id", TURNS, "escaped", final.alias("formatted")).withColumn("parsed", parse(F.col("formatted")))
    same = as_source(F.col("parsed")) == F.col(TURNS)
    return again.select("conv_id", "formatted", F.when(same, F.col("parsed")).otherwise(F.raise_error(F.lit("a conversation does not read back"))).alias("parsed"), "escaped")


def loss_text(parsed: Column, trained_role: str = "assistant") -> Column:
    """All text that training counts: the unescaped texts of one role, in order, with nothing between."""
    return F.array_join(F.transform(F.filter(parsed, lambda t: t["role"] == trained_role), lambda t: t["text"]), "")


def loss_spans(parsed: Column, trained_role: str = "assistant") -> Column:
    """(start, end) of the counted bodies in the formatted string, in code points."""
    fixed = len(START) + 1 + len(END) + 1
    step = lambda t: F.length(t["head"]) + F.length(t["body"]) + fixed
    return F.aggregate(
        parsed,
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("out")),
        lambda acc, t: F.struct(
            (acc["at"] + step(t)).alias("at"),
            F.when(
                t["role"] == trained_role,
                F.concat(acc["out"], F.array(F.struct(
                    (acc["at"] + step(t) - F.length(t["body"]) - len(END) - 1).alias("start"), (acc["at"] + step(t) - len(END) - 1).alias("end")
                ))),
            ).otherwise(acc["out"]).alias("out"),
        ),
        lambda acc: acc["out"],
    )


def digests(chats: DataFrame) -> DataFrame:
    """Counts and digests of what reads back from each formatted conversation."""
    turns = F.array_join(F.transform("parsed", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.col("loss")
    return chats.withColumn("loss", loss_text(F.col("parsed"))).select(
        "conv_id",
        F.size("parsed").cast("long").alias("n_turns"),
        F.sha2(turns.cast("binary"), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss.cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
