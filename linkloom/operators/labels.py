"""Labelled pairs, and what blocking finds of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.sources.tsv import id_num


def explode_truth(truth: DataFrame) -> DataFrame:
    """(i, j) of the ground truth; empty lists give nothing."""
    return truth.select(F.col("source1_entity_id").alias("i"), F.explode(F.split("matched_entity_ids", ",")).alias("j")).where("j <> ''")


def known_truth(truth: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """True pairs of which both records exist."""
    pairs = explode_truth(truth)
    return pairs.join(left.select(F.col("entity_id").alias("i")), "i", "left_semi").join(right.select(F.col("entity_id").alias("j")), "j", "left_semi").select("i", "j")


def label_pairs(pairs: DataFrame, true_pairs: DataFrame) -> DataFrame:
    """``pairs`` with y: whether they are true."""
    return pairs.join(true_pairs.distinct().withColumn("_y", F.lit(True)), ["i", "j"], "left").withColumn("y", F.col("_y").isNotNull()).drop("_y")


def recall(labelled: DataFrame, true_pairs: DataFrame, left: DataFrame) -> DataFrame:
    """One row: pairs, pairs per left record, true pairs found, true pairs, recall."""
    found = labelled.agg(F.count("*").alias("n_pairs"), F.coalesce(F.sum(F.col("y").cast("long")), F.lit(0)).alias("n_found"))
    return found.crossJoin(true_pairs.agg(F.count("*").alias("n_true"))).crossJoin(left.agg(F.count("*").alias("n_left"))).select(
        "n_pairs", "n_found", "n_true", F.round(F.col("n_pairs") / F.col("n_left"), 6).alias("pairs_per_left"), F.round(F.col("n_found") / F.col("n_true"), 6).alias("recall"))


def fold_of(i: str = "i", folds: int = 3):
    """Cross-fitting fold of a left record."""
    return F.pmod(id_num(i) * 7919, F.lit(folds)).cast("int")


def order_statistic(df: DataFrame, value: str, share: float) -> DataFrame:
    """One row: the element at place floor(share * n), from 0, of the sorted values.

    The quantile's place is small, so the values up to it are found by a top-k,
    without sorting all in one task.
    """
    n = df.where(F.col(value).isNotNull()).count()
    if not n:
        return df.select(F.col(value).alias("tau")).limit(0)
    first = df.where(F.col(value).isNotNull()).select(value).orderBy(value).limit(int(share * n) + 1)
    return first.agg(F.max(value).alias("tau"))

