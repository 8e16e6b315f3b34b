"""Mixing sources to target weights by Sainte-Lague apportionment.

DataFrame functions only.  The mix is made of blocks of ``block_words`` words.

Method
  1. Targets: ``share`` of all words is dealt out by the sources' weights; a
     source stops at ``most`` times its size and the excess is dealt out again,
     which is one level ``t``: target = min(most * size, weight * t).
  2. The mix's blocks go to the sources by highest quotients target / (2k + 1).
     Only quotients near the last winner are formed: a source's number of blocks
     is within (its share * number of sources + 1) of its proportion.
  3. A source's blocks go to its shards in the same way.  Shards are cut by a
     hash of the document, ``shard_docs`` documents each, so no source, however
     hot, meets in one task.
  4. In a shard, documents stand in an order that the seed gives.  Of its blocks
     each is taken ``q div n`` times, and ``q mod n`` once more: those at even
     steps from a seeded start.  A document gives its parts of the blocks taken:
     spans of words (``mix_spans``), their text (``mix_texts``), their number
     (``mix_sources``).

Defined cases: a null, empty or wordless text has size 0 and gives 0; a null
source is a source of its own, ordered last; rows without doc_id, or that repeat
one, are rows of their own; an empty table gives an empty result.
Rows that give nothing have no spans and no text.  At most ``most`` times a document's size is taken.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._workspace import Workspace, fresh

WORD = r"[^\x20\x09-\x0D]+"
#: A word with the white space after it, and the first one with that before it.
UNIT = r"\A[\x20\x09-\x0D]*[^\x20\x09-\x0D]+[\x20\x09-\x0D]*|[^\x20\x09-\x0D]+[\x20\x09-\x0D]*"
SPANS = "array<struct<start: bigint, stop: bigint, times: bigint>>"
EVER = (Window.unboundedPreceding, Window.unboundedFollowing)


def seats(df: DataFrame, within: list[str], by: str, total: str, order: list[str]) -> DataFrame:
    """Sainte-Lague: ``quota`` (long) of each row from ``total`` seats of its group ``within``.

    Rows are told apart by ``order``, which also breaks ties of quotients.
    """
    group = Window.partitionBy(*within)
    near = F.ceil(F.col("_share") * F.col("_n")) + 1
    df = df.withColumns({"_sum": F.sum(by).over(group), "_n": F.count(F.lit(1)).over(group)})
    df = df.withColumn("_share", F.when(F.col("_sum") > 0, F.col(by) / F.col("_sum")).otherwise(F.lit(0.0)))
    df = df.withColumn("_low", F.greatest(F.lit(0), F.floor(F.col("_share") * F.col(total) + 0.5) - near).cast("long"))
    df = df.withColumn("_left", F.col(total) - F.sum("_low").over(group))
    steps = F.sequence(F.lit(0).cast("long"), (2 * near + 1).cast("long"))
    each = df.where(F.col(by) > 0).select(*within, *[c for c in order if c not in within], "_low", "_left", by, F.explode(steps).alias("_k"))
    each = each.withColumn("_quotient", F.col(by) / (2 * (F.col("_low") + F.col("_k")) + 1))
    ranked = each.withColumn("_rank", F.row_number().over(Window.partitionBy(*within).orderBy(F.desc("_quotient"), *[F.asc_nulls_last(c) for c in order], "_k")))
    keys = list(dict.fromkeys([*within, *order]))
    won = ranked.where("_rank <= _left").groupBy(*keys).agg(F.count("*").alias("_won"))
    won = won.select(*[F.col(c).alias(f"_{c}") for c in keys], "_won")
    met = df.join(won, [df[c].eqNullSafe(won[f"_{c}"]) for c in keys], "left")
    return met.withColumn("quota", F.col("_low") + F.coalesce("_won", F.lit(0))).drop(*[f"_{c}" for c in keys], "_won", "_sum", "_n", "_share", "_low", "_left")


def _spans() -> Column:
    """A document's words that the mix takes: parts of blocks, each with the times it is taken."""
    block, begin, end = F.col("block"), F.col("end") - F.col("size"), F.col("end")
    steps = lambda u: F.call_function("div", u * F.col("extra"), F.col("n_blocks"))
    span = lambda start, stop, times: F.struct(start.cast("long").alias("start"), stop.cast("long").alias("stop"), times.cast("long").alias("times"))

    def part(j: Column) -> Column:
        u = j + F.col("shift")
        return span(F.greatest(j * block, begin) - begin, F.least((j + 1) * block, end) - begin, F.col("times") + steps(u + 1) - steps(u))

    blocks = F.sequence(F.call_function("div", begin, block), F.call_function("div", end - 1, block))
    whole = F.array(span(F.lit(0), F.col("size"), F.col("times")))
    found = F.when(F.col("extra") == 0, whole).otherwise(F.transform(blocks, part))
    return F.when(F.col("size") > 0, F.filter(found, lambda s: s["times"] > 0)).otherwise(F.array().cast(SPANS))


def taken(spans: Column) -> Column:
    """Words in ``spans``."""
    return F.aggregate(spans, F.lit(0).cast("long"), lambda n, s: n + (s["stop"] - s["start"]) * s["times"])


def _text(text: Column, spans: Column) -> Column:
    """The words of ``spans`` with the white space around them; what is taken again follows on a new line."""

    def passes(words: Column) -> Column:
        cut = lambda s: F.slice(words, (s["start"] + 1).cast("int"), (s["stop"] - s["start"]).cast("int"))
        once = lambda p: F.array_join(F.flatten(F.transform(F.filter(spans, lambda s: s["times"] >= p), cut)), "")
        return F.array_join(F.transform(F.sequence(F.lit(1).cast("long"), F.array_max(F.transform(spans, lambda s: s["times"]))), once), "\n")

    # an array of one item binds the words, so that they are split once
    return F.transform(F.array(F.regexp_extract_all(text, F.lit(UNIT), F.lit(0))), passes)[0]


def mix_spans(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: int = 2, block_words: int = 32, shard_docs: int = 4_000, seed: int = 20240229,
              id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", keep: tuple[str, ...] = ()) -> DataFrame:
    """The mix: ``id_col``, ``size``, ``source_size``, ``target`` and ``spans`` for every row, and the columns ``keep``.

    A span (start, stop, times) is the document's words from ``start``, counted from 0, to before
    ``stop``; spans come in order and don't overlap.
    """
    with Workspace(docs.sparkSession, "mixture") as ws:
        size = F.coalesce(F.regexp_count(docs[text_col], F.lit(WORD)), F.lit(0)).cast("long")
        kept = F.struct(*[docs[c].alias(c) for c in keep], F.lit(0).alias("_"))
        spot = F.md5(F.concat_ws(":", F.lit(str(seed)), docs[id_col].cast("string")))
        rows = ws.table(docs.select(docs[id_col].alias("id"), docs[source_col].alias("source"), size.alias("size"), spot.alias("spot"), kept.alias("kept")), "sizes")
        return ws.finish(_mixed(rows, weights, share, most, block_words, shard_docs, seed).select(
            F.col("id").alias(id_col), "size", "source_size", "target", _spans().alias("spans"), *[F.col(f"kept.{c}").alias(c) for c in keep]))


def mix_sources(docs: DataFrame, **how) -> DataFrame:
    """Digest of ``mix_spans``, whose parameters it takes: ``taken`` words of every row instead of its spans."""
    spans = mix_spans(docs, **how)
    return spans.withColumn("spans", taken(F.col("spans"))).withColumnRenamed("spans", "taken")


def mix_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size_col: str | None = "n_chars", **how) -> DataFrame:
    """The mix as a table: the rows of ``docs`` of which words are taken, with these words as their text.

    What is taken more than once is repeated on a new line.  ``size_col``, if there is such a column, becomes
    the new text's characters; ``size``, ``source_size``, ``target`` and ``taken`` are added or
    replaced.  Where ids are null or repeat, rows are told apart by a number of their own, for which the table
    is written once.
    """
    names, kinds = docs.columns, {f.name: f.dataType for f in docs.schema.fields}
    with Workspace(docs.sparkSession, "mix-texts") as ws:
        row = id_col
        if docs.groupBy(id_col).count().where(F.col(id_col).isNull() | (F.col("count") > 1)).limit(1).count():
            row = fresh("_row", docs.columns)
            docs = ws.table(docs.withColumn(row, F.monotonically_increasing_id()), "docs")
        spans = mix_spans(docs, id_col=id_col, text_col=text_col, keep=(row,) if row != id_col else (), **how)
        spans = spans.where(F.size("spans") > 0).select(F.col(row).alias(of := fresh("_of", docs.columns)), F.struct("size", "source_size", "target", "spans").alias(mix := fresh("_mix", docs.columns)))
        # only now do texts travel, once
        out = docs.join(spans, docs[row] == spans[of]).withColumn(text_col, _text(F.col(text_col), F.col(f"{mix}.spans")))
        if size_col in names:
            out = out.withColumn(size_col, F.length(text_col).cast(kinds[size_col]))
        out = out.select(*[c for c in names if c not in ("size", "source_size", "target", "taken")], f"{mix}.size", f"{mix}.source_size", f"{mix}.target", taken(F.col(f"{mix}.spans")).alias("taken"))
        return ws.finish(out) if row != id_col else out


def source_targets(rows: DataFrame, weights: tuple[int, ...], share: float, most: int) -> DataFrame:
    """One row a source: its words, documents and target; the level is found from running sums."""
    sources = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    place = F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place % len(weights) + 1).cast("int"))
    full = most * F.col("source_size")
    fill = Window.orderBy(full / F.col("weight"), F.asc_nulls_last("source"))
    sources = sources.withColumn("weight", weight).withColumns({
        "all": F.sum("source_size").over(Window.rowsBetween(*EVER)) * F.lit(share),
        "used": F.coalesce(F.sum(full).over(fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
        "rest": F.sum("weight").over(fill.rowsBetween(0, Window.unboundedFollowing)),
    })
    level = (F.col("all") - F.col("used")) / F.col("rest")
    level = F.max(F.when(level * F.col("weight") <= full, level)).over(Window.rowsBetween(*EVER))
    return sources.withColumn("target", F.least(full.cast("double"), F.coalesce(level, F.lit(0.0)) * F.col("weight"))).select("source", "source_size", "n_docs", "target", "all")


def _mixed(rows: DataFrame, weights: tuple[int, ...], share: float, most: int, block: int, shard_docs: int, seed: int) -> DataFrame:
    sources = source_targets(rows, weights, share, most)
    sources = sources.withColumns({"blocks": F.round(F.col("all") / block).cast("long"), "one": F.lit(1)})
    sources = seats(sources, ["one"], "target", "blocks", ["source"])
    sources = sources.select("source", "source_size", "target", F.col("quota").alias("blocks"), F.ceil(F.col("n_docs") / shard_docs).cast("long").alias("shards"))
    # one row a source: Spark broadcasts it only below its own size threshold
    right = sources.withColumnRenamed("source", "_source")
    rows = rows.join(right, rows["source"].eqNullSafe(right["_source"]), "left").drop("_source")
    rows = rows.withColumn("shard", F.conv(F.substring("spot", 1, 8), 16, 10).cast("long") % F.col("shards"))

    shards = rows.groupBy("source", "shard").agg(F.sum("size").alias("words"), F.max("blocks").alias("blocks"))
    shards = seats(shards, ["source"], "words", "blocks", ["shard"])
    n_blocks = F.greatest(F.lit(1), F.ceil(F.col("words") / block)).cast("long")
    quota = F.least(F.col("quota"), most * n_blocks)
    start = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce("source", F.lit("")), F.col("shard").cast("string"))), 1, 8), 16, 10).cast("long")
    shards = shards.select(F.col("source").alias("_source"), F.col("shard").alias("_shard"), n_blocks.alias("n_blocks"), F.floor(quota / n_blocks).alias("times"), (quota % n_blocks).alias("extra"), (start % n_blocks).alias("shift"))
    line = Window.partitionBy("source", "shard").orderBy("spot", "id", "size")
    rows = rows.withColumn("end", F.sum("size").over(line.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.join(shards, rows["source"].eqNullSafe(shards["_source"]) & (rows["shard"] == shards["_shard"]), "left").withColumn("block", F.lit(block).cast("long"))
    return rows
