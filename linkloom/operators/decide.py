"""From scores to matches: exclusive assignment, set selection, and the metric."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def exclusive(scored: DataFrame, p: str = "p") -> DataFrame:
    """A right record's score counts for its best left record only; ties all keep theirs."""
    best = F.max(p).over(Window.partitionBy("j"))
    return scored.withColumn(p, F.when(F.col(p) >= best, F.col(p)).otherwise(F.lit(0.0)))


def select_threshold(scored: DataFrame, tau: float) -> DataFrame:
    return scored.where((F.col("p") > 0) & (F.col("p") >= tau))


def _expected(scored: DataFrame, by: list[str], tau) -> DataFrame:
    """Pairs of each group's best set: expected F0.5 of the m likeliest, against that of none.

    Every window is over the same partitioning: one exchange.
    """
    group = Window.partitionBy(*by)
    line = group.orderBy(F.desc("p"), "j")
    so_far = line.rowsBetween(Window.unboundedPreceding, 0)
    exact = F.col("p").cast("decimal(20,15)")  # sums that don't depend on the order of rows
    likely = scored.where("p > 0").withColumns({"_m": F.row_number().over(line), "_cum": F.sum(exact).over(so_far).cast("double"), "_tot": F.sum(exact).over(group).cast("double"),
                                                "_none": F.exp(F.sum(F.log1p(-F.least(F.col("p"), F.lit(1 - 1e-9)))).over(group))})
    value = F.when(F.col("p") < tau, F.lit(-1.0)).otherwise(1.25 * F.col("_cum") / (0.25 * F.col("_tot") + F.col("_m")))
    valued = likely.withColumn("_val", value).withColumn("_best", F.max("_val").over(group))
    cut = F.min(F.when(F.col("_val") == F.col("_best"), F.col("_m"))).over(group)
    return valued.withColumn("_cut", F.when(F.col("_best") > F.col("_none"), cut).otherwise(0)).where("_m <= _cut").drop("_m", "_cum", "_tot", "_none", "_val", "_best", "_cut")


def select_expected(scored: DataFrame, tau: float) -> DataFrame:
    return _expected(scored, ["i"], F.lit(tau))


def f05(selected: DataFrame, truth: DataFrame, everyone: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Macro F0.5 over ``everyone`` (i), of pairs (i, j) against pairs (i, j); one row, or one per ``by``.

    A record without matches and without truth counts 1.
    """
    by = by or []
    true_n = truth.groupBy("i").agg(F.count("*").alias("t"))
    hits = selected.join(truth.withColumn("y", F.lit(1)), ["i", "j"], "left").groupBy(*by, "i").agg(F.count("*").alias("n"), F.sum(F.coalesce("y", F.lit(0))).alias("tp"))
    each = everyone.select("i").join(true_n, "i", "left")
    if by:
        each = each.crossJoin(F.broadcast(hits.sparkSession.createDataFrame(GRID, "mode string, tau double")))
    each = each.join(hits, [*by, "i"], "left")
    t, n, tp = (F.coalesce(c, F.lit(0)) for c in ("t", "n", "tp"))
    precision, recall = tp / n, tp / t
    score = F.when((t == 0) & (n == 0), 1.0).when(tp == 0, 0.0).otherwise(1.25 * precision * recall / (0.25 * precision + recall))
    return each.withColumn("_f", score).groupBy(*by).agg(F.avg("_f").alias("f05"), F.count("*").alias("n"))


#: Modes and thresholds of the search.
GRID = [(mode, round(0.30 + 0.05 * k, 2)) for mode in ("thr", "exp") for k in range(9)]


def grid(scored: DataFrame, truth: DataFrame, everyone: DataFrame) -> DataFrame:
    """Macro F0.5 of every mode and threshold, in one plan over the pairs times the 18 rows of ``GRID``."""
    tried = scored.crossJoin(F.broadcast(scored.sparkSession.createDataFrame(GRID, "mode string, tau double")))
    plain = tried.where("mode = 'thr' and p > 0 and p >= tau")
    best = _expected(tried.where("mode = 'exp'"), ["mode", "tau", "i"], F.col("tau"))
    chosen = plain.select("mode", "tau", "i", "j").union(best.select("mode", "tau", "i", "j"))
    return f05(chosen, truth, everyone, ["mode", "tau"])
