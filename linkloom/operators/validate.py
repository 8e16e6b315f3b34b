"""Integrity checks of result lists: each check is a DataFrame of what violates it."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EXAMPLES = 5


def rows_of(lists: DataFrame) -> DataFrame:
    """(id, ids) of a list table: the second column split, empties dropped, blanks trimmed."""
    first, second = lists.columns[:2]
    ids = F.filter(F.transform(F.split(F.coalesce(second, F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")
    return lists.select(F.trim(F.col(first)).alias("id"), ids.alias("ids"))


def dup_rows(rows: DataFrame) -> DataFrame:
    return rows.groupBy("id").agg(F.count("*").alias("n")).where("n > 1")


def dup_ids(rows: DataFrame) -> DataFrame:
    return rows.where(F.size("ids") != F.size(F.array_distinct("ids"))).select("id", (F.size("ids") - F.size(F.array_distinct("ids"))).cast("long").alias("n"))


def entries(rows: DataFrame) -> DataFrame:
    return rows.select("id", F.explode("ids").alias("entry"))


def wrong_prefix(rows: DataFrame) -> DataFrame:
    """(id, entry, kind): ids of source 1 in a list, and ids of no linked source."""
    e = entries(rows)
    kind = F.when(F.col("entry").startswith("S1-"), "source1").when(~(F.col("entry").startswith("S2-") | F.col("entry").startswith("S3-")), "other")
    return e.withColumn("kind", kind).where("kind is not null")


def unknown(rows: DataFrame, known: DataFrame) -> DataFrame:
    """(entry): listed ids of linked sources that no record has."""
    return entries(rows).where("entry like 'S2-%' or entry like 'S3-%'").select("entry").distinct().join(known.select(F.col("entity_id").alias("entry")), "entry", "left_anti")


def missing(rows: DataFrame, required: DataFrame) -> DataFrame:
    return required.select(F.col("entity_id").alias("id")).distinct().join(rows, "id", "left_anti")


def extra(rows: DataFrame, required: DataFrame) -> DataFrame:
    return rows.select("id").distinct().join(required.select(F.col("entity_id").alias("id")), "id", "left_anti")


def not_candidates(matches: DataFrame, candidates: DataFrame) -> DataFrame:
    """(id, entry): matches that are no candidates of the same record."""
    return entries(matches).distinct().join(entries(candidates), ["id", "entry"], "left_anti")


def _finding(df: DataFrame, severity: str, check: str, shown) -> DataFrame:
    """One row: how many violations, and the first few of them; nothing is gathered but those few."""
    n = df.agg(F.count("*").alias("n"))
    some = df.select(shown.cast("string").alias("e")).distinct().orderBy("e").limit(EXAMPLES).agg(F.array_sort(F.collect_list("e")).alias("examples"))
    return n.crossJoin(some).select(F.lit(severity).alias("severity"), F.lit(check).alias("check"), "n", "examples")


def report(matches: DataFrame, candidates: DataFrame | None, required: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(severity, check, n, examples) of all checks, violated ones only."""
    found = []
    for name, lists in (("matches", matches), ("candidates", candidates)):
        if lists is None:
            continue
        rows = rows_of(lists)
        bad = wrong_prefix(rows)
        found += [
            _finding(dup_rows(rows), "error", f"{name}: repeated rows", F.col("id")),
            _finding(dup_ids(rows), "error", f"{name}: ids repeated in a list", F.col("id")),
            _finding(bad.where("kind = 'source1'"), "error", f"{name}: ids of source 1 in a list", F.col("entry")),
            _finding(bad.where("kind = 'other'"), "error", f"{name}: ids of no linked source", F.col("entry")),
            _finding(missing(rows, required), "error", f"{name}: missing records", F.col("id")),
            _finding(extra(rows, required), "error", f"{name}: unexpected records", F.col("id")),
        ]
        if known is not None:
            found.append(_finding(unknown(rows, known), "error", f"{name}: unknown ids", F.col("entry")))
    if candidates is not None:
        found.append(_finding(not_candidates(rows_of(matches), rows_of(candidates)), "warning", "matches that are no candidates", F.concat_ws(" ", "id", "entry")))
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out.where("n > 0")


def there(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def warned(spark: SparkSession, check: str, example: str) -> DataFrame:
    return spark.createDataFrame([("warning", check, 1, [example])], "severity string, check string, n long, examples array<string>")


def file_findings(spark: SparkSession, path: str, columns: tuple[str, str]) -> DataFrame:
    """What is wrong with a file as text: header, tabs; fatal findings make the rest meaningless."""
    schema = "severity string, check string, n long, examples array<string>"
    if not there(spark, path):
        return spark.createDataFrame([("fatal", "no such file", 1, [path])], schema)
    lines = spark.read.text(path)
    head = lines.limit(1).collect()
    fatal = None
    if not head:
        fatal = "empty file"
    else:
        header = head[0]["value"].removeprefix("﻿")
        if "\t" not in header:
            fatal = "commas instead of tabs" if "," in header else "no tab in the header"
        elif tuple(x.strip().lower() for x in header.split("\t")) != columns:
            fatal = f"header is not {' and '.join(columns)}"
        elif lines.where(F.contains("value", F.lit("�")) | F.col("value").rlike(r"[\x00-\x08]")).limit(1).count():
            fatal = "not UTF-8"
    if fatal:
        return spark.createDataFrame([("fatal", fatal, 1, [])], schema)
    bare = lines.where(~F.contains("value", F.lit("\t")) & (F.trim("value") != ""))
    return _finding(bare, "error", "rows without a tab", F.col("value")).where("n > 0")


def passed(findings: DataFrame) -> bool:
    return not findings.where("severity <> 'warning'").limit(1).count()
