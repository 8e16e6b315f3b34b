"""Tab-separated sources and sinks, without quoting; missing values are empty strings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

RECORD = "entity_id STRING, business_name STRING, business_address STRING, country STRING"
TRUTH = "source1_entity_id STRING, matched_entity_ids STRING"
_PLAIN = {"sep": "\t", "quote": "", "escape": "", "header": True}


def read_tsv(spark: SparkSession, path: str | list[str], schema: str = RECORD) -> DataFrame:
    df = spark.read.options(**_PLAIN, enforceSchema=True).schema(schema).csv(path)
    return df.select(*[F.coalesce(c, F.lit("")).alias(c) for c in df.columns])


def union_right(first: DataFrame, *others: DataFrame) -> DataFrame:
    """Sources that are linked to the first one, one below the other."""
    for df in others:
        first = first.unionByName(df)
    return first


def id_num(entity_id):
    """S2-123 becomes 20000000123: source times 10^10 plus number."""
    entity_id = F.col(entity_id) if isinstance(entity_id, str) else entity_id
    return F.substring(entity_id, 2, 1).cast("long") * F.lit(10_000_000_000) + F.substring(entity_id, 4, 30).cast("long")


def listed(left: DataFrame, pairs: DataFrame, column: str, score: str | None = "p") -> DataFrame:
    """Every left record once, with its matches comma-separated by falling score, or empty."""
    order = f"{score} desc, j" if score else "j"
    lists = pairs.groupBy("i").agg(F.expr(f"listagg(j, ',') within group (order by {order})").alias(column))
    return left.join(lists, left["entity_id"] == lists["i"], "left").select(left["entity_id"].alias("source1_entity_id"), F.coalesce(column, F.lit("")).alias(column))


def write_tsv(df: DataFrame, path: str, one_file: bool = True) -> None:
    """One file when the consumer needs one; otherwise one per partition."""
    out = df.coalesce(1) if one_file else df
    out.write.mode("overwrite").options(**_PLAIN, emptyValue="", nullValue="").csv(path)


def sample_exact(df: DataFrame, n: int, key: str, seed: int = 0) -> DataFrame:
    """Exactly n rows (or all), the same ones on every run."""
    return df.orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string"))), key).limit(n)


def split_groups(df: DataFrame, sizes: dict[str, int], key: str, seed: int = 42) -> DataFrame:
    """Disjoint random groups of exact sizes, in the order given; the first takes what is left over.

    The rank is global: only the keys are sorted, by range, and numbered by the
    sizes of the ranges before them.
    """
    keys = df.select(F.col(key).alias("_k"), F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string"))).alias("_h"))
    ranked = global_rank(keys, ["_h", "_k"])
    rest, *named = sizes
    cases, low = None, 0
    for name in named:
        inside = (F.col("_rank") > low) & (F.col("_rank") <= low + sizes[name])
        cases = F.when(inside, name) if cases is None else cases.when(inside, name)
        low += sizes[name]
    label = cases.otherwise(rest) if cases is not None else F.lit(rest)
    return df.join(ranked.select("_k", label.alias("grp")), df[key] == F.col("_k")).drop("_k")


def global_rank(df: DataFrame, order: list[str]) -> DataFrame:
    """``_rank`` 1..n in the given order, without sorting all rows in one task."""
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id())
    placed = placed.withColumn("_at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)) + 1).checkpoint()
    sizes = placed.groupBy("_part").agg(F.count("*").alias("_n"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return placed.join(before.select("_part", "_before"), "_part").withColumn("_rank", F.col("_before") + F.col("_at")).drop("_part", "_before", "_at")
