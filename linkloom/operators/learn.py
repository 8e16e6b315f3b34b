"""Dictionaries mined from labelled pairs: renderings of other scripts, address components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkloom.functions.text import clean_nulls, fold, foreign, is_latin, strip, to_latin, with_known
from linkloom.operators.labels import explode_truth

#: Entries beyond which a dictionary is no map literal but a table that is joined.
MOST_ENTRIES = 20_000


def labelled_records(left: DataFrame, right: DataFrame, truth: DataFrame) -> DataFrame:
    """(i, j, name_l, addr_l, name_r, addr_r) of the true pairs, raw."""
    l = left.select(F.col("entity_id").alias("i"), F.col("business_name").alias("name_l"), F.col("business_address").alias("addr_l"))
    r = right.select(F.col("entity_id").alias("j"), F.col("business_name").alias("name_r"), F.col("business_address").alias("addr_r"))
    return explode_truth(truth).join(l, "i").join(r, "j")


def _tokens(folded: Column) -> Column:
    return F.filter(F.split(folded, r"(?U)\s+"), lambda t: t != "")


def token_align(labelled: DataFrame) -> DataFrame:
    """(token, target, n): words of another script against the left name's words of the same place."""
    both = labelled.where(~is_latin(F.coalesce("name_r", F.lit("")))).select(_tokens(fold(F.col("name_r"))).alias("r"), _tokens(fold(F.col("name_l"))).alias("l"))
    aligned = both.where(F.size("r") == F.size("l")).select(F.explode(F.arrays_zip("r", "l")).alias("z"))
    pairs = aligned.select(F.col("z.r").alias("token"), F.regexp_replace("z.l", r"^[.,()]+|[.,()]+$", "").alias("target")).where(~is_latin(F.col("token")))
    return pairs.groupBy("token", "target").agg(F.count("*").alias("n"))


def learn_translit(aligned: DataFrame, min_count: int = 3, min_share: float = 0.5) -> DataFrame:
    """(token, target): the most frequent target, if frequent enough; ties go to the first in the alphabet."""
    group = Window.partitionBy("token")
    best = aligned.withColumns({"_at": F.row_number().over(group.orderBy(F.desc("n"), "target")), "_all": F.sum("n").over(group)})
    return best.where((F.col("_at") == 1) & (F.col("n") >= min_count) & (F.col("n") / F.col("_all") >= min_share)).select("token", "target", "n")


def _parts(address: Column) -> Column:
    return F.array_distinct(F.filter(F.transform(F.split(address, ","), strip), lambda p: p != ""))


def component_cooc(labelled: DataFrame) -> DataFrame:
    """(c, t, n, comp_n, left_n): right components that the left address lacks, against its components.

    ``comp_n`` counts pairs that have c, ``left_n`` left records with a match that have it.
    """
    raw = labelled.select("i", "j", fold(clean_nulls(F.col("addr_l"))).alias("a"), fold(clean_nulls(F.col("addr_r"))).alias("b"))
    pairs = raw.select("i", "j", _parts(F.col("a")).alias("l"), _parts(F.col("b")).alias("r"))
    new = pairs.select("l", F.explode(F.array_except("r", "l")).alias("c")).where(~(is_latin(F.col("c")) & (F.length("c") > 3)))
    comp_n = new.groupBy("c").agg(F.count("*").alias("comp_n"))
    left_n = pairs.dropDuplicates(["i"]).select(F.explode("l").alias("c")).groupBy("c").agg(F.count("*").alias("left_n"))
    cooc = new.select("c", F.explode("l").alias("t")).groupBy("c", "t").agg(F.count("*").alias("n"))
    return cooc.join(comp_n, "c").join(left_n, "c", "left").select("c", "t", "n", "comp_n", F.coalesce("left_n", F.lit(0)).alias("left_n"))


def learn_component(cooc: DataFrame, min_count: int = 20, max_left: float = 0.05, min_share: float = 0.8) -> DataFrame:
    """(component, target) of components that mostly stand for one component of the left side."""
    kept = cooc.where((F.col("comp_n") >= min_count) & (F.col("left_n") <= max_left * F.col("comp_n")))
    best = kept.withColumn("_at", F.row_number().over(Window.partitionBy("c").orderBy(F.desc("n"), "t"))).where("_at = 1")
    return best.where(F.col("n") / F.col("comp_n") >= min_share).select(F.col("c").alias("component"), F.col("t").alias("target"), "n")


def rekeyed(component: DataFrame, translit: Column | DataFrame | None = None) -> DataFrame:
    """Component entries as prepared addresses show them; empty, equal or digit-bearing ones go."""
    shape = lambda c: F.trim(F.regexp_replace(F.regexp_replace(c, r"[^a-z0-9/\- ]", " "), " +", " "))
    if isinstance(translit, DataFrame):
        component = with_known(component, "component", F.concat(foreign("component"), foreign("target")), translit, "_known")
        translit = F.col("_known")
    latin = component.select(to_latin(F.col("component"), translit).alias("k"), to_latin(F.col("target"), translit).alias("v"), "n")
    out = latin.select(shape(F.col("k")).alias("component"), shape(F.col("v")).alias("target"), "n")
    out = out.where("component <> '' and target <> '' and component <> target").where(~F.concat("component", "target").rlike("[0-9]"))
    one = F.row_number().over(Window.partitionBy("component").orderBy(F.desc("n"), "target"))
    return out.withColumn("_at", one).where("_at = 1").drop("_at")


def as_map(entries: DataFrame, key: str, value: str, most: int = MOST_ENTRIES) -> Column | DataFrame | None:
    """A whole dictionary: a map literal of up to ``most`` entries, beyond that the table (key, value)."""
    rows = entries.orderBy(F.desc("n"), key).limit(most + 1).collect()
    if not rows:
        return None
    if len(rows) > most:
        return entries.select(F.col(key).alias("key"), F.col(value).alias("value"))
    return F.map_from_arrays(F.array(*[F.lit(r[key]) for r in rows]), F.array(*[F.lit(r[value]) for r in rows]))
