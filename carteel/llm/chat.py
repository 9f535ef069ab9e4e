"""Multi-party perspective rotation of dialogues.

For every participant a dialogue is rendered once, with that speaker's turns as
the assistant's and the others' as named users'; spans mark what the assistant
says, which is what a model is trained on.  System turns are context in every
rendering.  A long dialogue is rendered in parts of consecutive turn numbers, so
no task holds more than a part; a rendering is the concatenation of its parts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Turn numbers in a part.
PART = 256
SYSTEM = ("system",)


def _plain(text: Column) -> Column:
    """Text in which no marker can be mistaken for one of the rendering's."""
    return F.replace(text, F.lit("<|"), F.lit("< |"))


def rotate(turns: DataFrame, part: int = PART, system: tuple[str, ...] = SYSTEM) -> DataFrame:
    """(conv_id, perspective, part, text, spans, n_turns, n_own): a row for each conversation, participant and part.

    Turns are (conv_id, turn, role, text); a participant is a role that isn't a
    system role.  spans: (start, end) in characters of ``text`` of each turn of the
    assistant, its end marker included.  A null role is a speaker named
    ``unknown``; null text is empty; null turns come last, in a part of their own;
    equal turn numbers are ordered by role and text.  A conversation of system
    turns alone, or a null conv_id, has no rendering.  Repeated rows repeat."""
    rows = turns.filter("conv_id IS NOT NULL").select(
        "conv_id",
        F.floor(F.col("turn").cast("long") / part).alias("part"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("unknown")).alias("role"),
        F.coalesce(_plain(F.col("text").cast("string")), F.lit("")).alias("text"),
    )
    speakers = rows.filter(~F.col("role").isin(*system)).groupBy("conv_id").agg(F.sort_array(F.collect_set("role")).alias("speakers"))
    held = rows.groupBy("conv_id", "part").agg(F.array_sort(F.collect_list(F.struct(F.col("turn").isNull().alias("late"), "turn", "role", "text"))).alias("turns"))
    each = held.join(speakers, "conv_id").select("conv_id", "part", "turns", F.explode("speakers").alias("perspective"))

    def head(t: Column, me: Column) -> Column:
        return F.when(t["role"] == me, F.lit("<|assistant|>\n")).when(t["role"].isin(*system), F.lit("<|system|>\n")).otherwise(F.concat(F.lit("<|user name="), _plain(t["role"]), F.lit("|>\n")))

    me = F.col("perspective")
    shown = F.transform("turns", lambda t: F.struct(head(t, me).alias("head"), F.concat(t["text"], F.lit("<|end|>\n")).alias("body"), (t["role"] == me).alias("own")))
    each = each.select("conv_id", "perspective", "part", shown.alias("shown"))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.expr("cast(array() as array<struct<start: bigint, end: bigint>>)").alias("spans"))

    def step(acc: Column, t: Column) -> Column:
        begin = acc["at"] + F.length(t["head"])
        end = begin + F.length(t["body"])
        return F.struct(end.alias("at"), F.when(t["own"], F.array_append(acc["spans"], F.struct(begin.alias("start"), end.alias("end")))).otherwise(acc["spans"]).alias("spans"))

    return each.select(
        "conv_id",
        "perspective",
        "part",
        F.concat_ws("", F.transform("shown", lambda t: F.concat(t["head"], t["body"]))).alias("text"),
        F.aggregate("shown", start, step)["spans"].alias("spans"),
        F.size("shown").cast("long").alias("n_turns"),
        F.size(F.filter("shown", lambda t: t["own"])).cast("long").alias("n_own"),
    )
