"""Chat formatting with cumulative-snapshot collapse.

Chat logs hold a conversation once for every time it was saved: each snapshot is a
prefix of a later one.  Only maximal conversations are rendered.

Method: a rolling hash of a conversation's turns (role and text, exclusive or over
turns of 128 bits that know their place) gives each of its prefixes.  For each
(length, hash) the longest conversation that has this prefix is found by ``max``,
combined before its shuffle: a first turn that all conversations share is one
row per task.  A conversation that a longer one, or an equal one with a smaller
id, begins with is dropped by an anti-join on (length, whole hash).  No pairs are
formed.  Rendering gathers at most ``PART_TURNS`` turns: a longer conversation
gives numbered parts, to be read in order.

Defined cases: turns are ordered by turn, role and text, nulls first, and repeats
stay; a null role or text renders as empty, but differs from an empty one in
comparisons; turns without conv_id form one conversation; an empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._workspace import Workspace

PART_TURNS = 1024


def _turns(conversations: DataFrame) -> DataFrame:
    line = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    turns = conversations.select("conv_id", "turn", "role", "text").withColumn("place", F.row_number().over(line).cast("long"))
    said = [F.col("place"), F.col("role").isNull(), F.col("role"), F.col("text").isNull(), F.col("text")]
    turns = turns.withColumns({"a": F.xxhash64(F.lit(1), *said), "b": F.xxhash64(F.lit(2), *reversed(said))})
    so_far = line.rowsBetween(Window.unboundedPreceding, 0)
    return turns.withColumns({"p": F.expr("bit_xor(a)").over(so_far), "q": F.expr("bit_xor(b)").over(so_far)})


def maximal(turns: DataFrame) -> DataFrame:
    """(conv_id, n_turns) of the conversations that no other begins with."""
    whole = turns.groupBy("conv_id").agg(F.max(F.struct("place", "p", "q")).alias("end")).select("conv_id", F.col("end.place").alias("n_turns"), F.col("end.p").alias("p"), F.col("end.q").alias("q"))
    # equal conversations: the least id stands for them
    heads = whole.groupBy("n_turns", "p", "q").agg(F.min(F.struct(F.col("conv_id").isNull().alias("unnamed"), F.col("conv_id").alias("conv_id"))).alias("least"))
    heads = heads.select("n_turns", "p", "q", "least.conv_id")
    # prefixes that some conversation goes on after
    inner = turns.withColumn("more", F.lead("place").over(Window.partitionBy("conv_id").orderBy("place"))).where("more is not null")
    inner = inner.groupBy(F.col("place").alias("n_turns"), "p", "q").agg(F.count("*").alias("longer"))
    return heads.join(inner, ["n_turns", "p", "q"], "left_anti").select("conv_id", "n_turns")


def render(conversations: DataFrame) -> DataFrame:
    """(conv_id, part, n_turns, rendered) of the maximal conversations."""
    with Workspace(conversations.sparkSession, "chat") as ws:
        turns = ws.table(_turns(conversations), "turns")
        kept = maximal(turns).withColumnsRenamed({"conv_id": "kept_id"})
        turns = turns.select("conv_id", "place", "role", "text")
        turns = turns.join(kept, turns["conv_id"].eqNullSafe(kept["kept_id"]))
        part = F.floor((F.col("place") - 1) / PART_TURNS).cast("long").alias("part")
        line = F.concat(F.lit("<|"), F.coalesce("role", F.lit("")), F.lit("|>\n"), F.coalesce("text", F.lit("")), F.lit("<|end|>\n"))
        shown = turns.groupBy("conv_id", part, "n_turns").agg(F.array_sort(F.collect_list(F.struct("place", line.alias("line")))).alias("lines"))
        return ws.finish(shown.select("conv_id", "part", "n_turns", F.array_join("lines.line", "").alias("rendered")))
