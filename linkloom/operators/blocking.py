"""Candidate generation with an inverted index of blocking keys.

Each family of keys is one array expression over a prepared record; records meet
by an equi-join on (country, key).  Keys of more than ``max_df`` right records are
no keys, so a left record meets at most that many per key.  ``meet``, ``score`` and
``top`` are the steps one by one; ``block`` joins whole lists instead of single
postings and deals them out by left record once, so that pairs are listed, summed
and ranked within a task and never shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkloom.functions import vocab
from linkloom.functions.text import numbers, skeleton

MAX_DF, TOP = 500, 40
#: As many stop keys are broadcast at most; more are joined by shuffle.
MOST_BROADCAST = 100_000
#: Weights are summed as whole numbers of so many parts, so that the order of rows doesn't show.
PARTS = 10**12
#: Left records to a task that lists and sums pairs: each has at most ``max_df`` pairs a key.
LEFT_RECORDS = 2_500
MOST_TASKS = 20_000


def words(c: Column) -> Column:
    return F.filter(F.split(c, " "), lambda t: t != "")


def _digits(t: Column) -> Column:
    return t.rlike("^[0-9]+$")


def _tag(tag: str, items: Column) -> Column:
    return F.transform(items, lambda x: F.concat(F.lit(tag), x))


def _one(tag: str, condition: Column, value: Column) -> Column:
    return F.when(condition, F.array(F.concat(F.lit(tag), value))).otherwise(F.array().cast("array<string>"))


def _pairs(items: Column) -> Column:
    """struct(a, b) of neighbours; none for fewer than two items."""
    n = F.size(items)
    both = F.arrays_zip(F.slice(items, 1, n - 1).alias("a"), F.slice(items, 2, n - 1).alias("b"))
    return F.when(n > 1, both).otherwise(F.array().cast("array<struct<a:string,b:string>>"))


def _last(items: Column, n: int) -> Column:
    return F.when(F.size(items) > n, F.slice(items, -n, n)).otherwise(items)


def name_keys(toks: Column, nums: Column, places: Column) -> Column:
    """Keys of one variant's tokens."""
    glued = F.array_join(toks, "")
    long = F.length(glued)
    lead = F.slice(F.filter(toks, lambda t: F.length(t) >= 2), 1, 1)
    sort = lambda a, b: F.concat(F.least(a, b), F.lit("_"), F.greatest(a, b))
    grams = F.when((F.size(toks) == 1) & (long >= 10), F.transform(F.sequence(F.lit(1), F.greatest(long - 4, F.lit(1))), lambda i: F.substr(glued, i, F.lit(5)))).otherwise(F.array().cast("array<string>"))
    cross = lambda tag, others: F.flatten(F.transform(lead, lambda t: F.transform(others, lambda o: F.concat(F.lit(tag), t, F.lit("_"), o))))
    first = F.get(toks, F.lit(0))
    families = [
        _tag("t", F.filter(toks, lambda t: (F.length(t) >= 2) & ~_digits(t))),
        _tag("k", F.transform(F.filter(toks, lambda t: F.length(t) >= 4), skeleton)),
        F.array(F.concat(F.lit("g"), glued)),
        _tag("u", grams),
        _tag("u", F.transform(F.filter(toks, lambda t: F.length(t) >= 5), lambda t: F.substring(t, 1, 5))),
        _one("h", long >= 8, F.substring(glued, 1, 6)),
        _tag("b", F.transform(_pairs(toks), lambda p: sort(p["a"], p["b"]))),
        _one("b", F.size(toks) >= 3, sort(first, F.get(toks, F.lit(2)))),
        cross("x", nums),
        cross("y", places),
        _one("q", long >= 6, F.array_join(F.array_sort(F.filter(F.split(glued, ""), lambda x: x != "")), "")),
        F.when(F.size(toks) >= 2, F.array(F.concat(F.lit("a"), F.array_join(F.transform(toks, lambda t: F.substring(t, 1, 1)), ""))))
        .when(F.length(first).between(2, 5), F.array(F.concat(F.lit("a"), first))).otherwise(F.array().cast("array<string>")),
    ]
    return F.when(F.size(toks) > 0, F.concat(*families)).otherwise(F.array().cast("array<string>"))


def address_keys(at: Column) -> Column:
    """Keys of an address's tokens: postal codes, house with street, neighbouring street words."""
    street = lambda i: F.get(F.filter(F.slice(at, i + 2, F.lit(2)), lambda u: ~_digits(u) & ~u.isin(vocab.HOUSE_SKIP) & (F.length(u) >= 2)), F.lit(0))
    house = F.transform(at, lambda t, i: F.when(_digits(t) & street(i).isNotNull(), F.concat(F.lit("n"), F.regexp_replace(t, "^0+", ""), F.lit("_"), skeleton(street(i)))))
    alpha = F.transform(F.filter(at, lambda t: ~_digits(t) & ~t.isin(vocab.PLACE_STOP) & (F.length(t) >= 3)), skeleton)
    return F.concat(
        _tag("z", F.filter(at, lambda t: t.rlike("^[0-9]{5,6}$"))),
        F.slice(F.filter(house, lambda h: h.isNotNull()), 1, 3),
        F.transform(_pairs(alpha), lambda p: F.concat(F.lit("s"), p["a"], F.lit("_"), p["b"])),
    )


def record_keys(name_vars: Column, addr_n: Column) -> Column:
    """All distinct keys of a prepared record."""
    at = words(addr_n)
    nums = F.slice(numbers(at), 1, 3)
    places = F.transform(_last(F.array_distinct(F.filter(at, lambda t: ~_digits(t) & ~t.isin(vocab.PLACE_STOP) & (F.length(t) >= 3))), 4), skeleton)
    names = F.flatten(F.transform(F.split(name_vars, r"\|"), lambda v: name_keys(words(v), nums, places)))
    return F.array_distinct(F.concat(names, address_keys(at)))


def keys(prepared: DataFrame) -> DataFrame:
    """(entity_id, ctry, key): the inverted index's postings."""
    return prepared.select("entity_id", "ctry", F.explode(record_keys(F.col("name_vars"), F.col("addr_n"))).alias("key"))


def shards(left: DataFrame, right: DataFrame) -> DataFrame:
    """Countries that both sides have, with the right side's number of records."""
    n = right.groupBy("ctry").agg(F.count("*").alias("n_right"))
    return n.join(left.select("ctry").distinct(), "ctry", "left_semi")


def weights(right_keys: DataFrame, shard: DataFrame, max_df: int = MAX_DF) -> DataFrame:
    """(ctry, key, df, idf) of keys that are not too common."""
    df = right_keys.groupBy("ctry", "key").agg(F.count("*").alias("df")).where(F.col("df") <= max_df)
    # one row a country: joined by broadcast only under Spark's own size threshold
    return df.join(shard, "ctry").select("ctry", "key", "df", F.log1p(F.col("n_right") / F.col("df")).alias("idf"))


def stop_keys(right_keys: DataFrame, max_df: int = MAX_DF) -> DataFrame:
    """(ctry, key) of the keys that are too common; counts are combined before their shuffle."""
    return right_keys.groupBy("ctry", "key").agg(F.count("*").alias("df")).where(F.col("df") > max_df).select("ctry", "key")


def sized(stops: DataFrame) -> DataFrame:
    """The same keys, to be broadcast if there are at most ``MOST_BROADCAST`` of them, which are then found only once."""
    rows = stops.limit(MOST_BROADCAST + 1).collect()
    return F.broadcast(stops.sparkSession.createDataFrame(rows, stops.schema)) if len(rows) <= MOST_BROADCAST else stops


def without(keyed: DataFrame, stops: DataFrame) -> DataFrame:
    """Postings without those of ``stops``, which so never meet in one task."""
    return keyed.join(stops, ["ctry", "key"], "left_anti")


def _units(idf: Column) -> Column:
    return (idf.cast("decimal(18,12)") * F.lit(PARTS)).cast("long")


def index(right_keys: DataFrame, shard: DataFrame, max_df: int = MAX_DF) -> DataFrame:
    """(ctry, key, j, idf, units): postings of the keys that are not too common, with a key's weight in ``PARTS``.

    One shuffle on (ctry, key), of lists of at most ``max_df`` records: longer ones go before it.
    """
    weighted = weights(right_keys, shard, max_df).withColumn("units", _units(F.col("idf")))
    lists = without(right_keys, sized(stop_keys(right_keys, max_df)))
    return lists.join(weighted, ["ctry", "key"]).select("ctry", "key", F.col("entity_id").alias("j"), "idf", "units")


def lists(right_keys: DataFrame, shard: DataFrame) -> DataFrame:
    """(ctry, key, js, units): the same index with a row a key; ``right_keys`` have no stop keys, which bounds a list."""
    listed = right_keys.groupBy("ctry", "key").agg(F.collect_list("entity_id").alias("js"))
    return listed.join(shard, "ctry").select("ctry", "key", "js", _units(F.log1p(F.col("n_right") / F.size("js"))).alias("units"))


def meet(left_keys: DataFrame, postings: DataFrame) -> DataFrame:
    """(i, j, key, idf, units): an inner equi-join; left keys without postings fall out."""
    return left_keys.join(postings, ["ctry", "key"]).select(F.col("entity_id").alias("i"), "j", "key", "idf", "units")


def score(met: DataFrame) -> DataFrame:
    """Pairs' summed weights."""
    return met.groupBy("i", "j").agg(F.round(F.sum("units") / F.lit(float(PARTS)), 6).alias("kscore"))


def top(scored: DataFrame, k: int = TOP) -> DataFrame:
    best = Window.partitionBy("i").orderBy(F.desc("kscore"), "j")
    return scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def block(left: DataFrame, right: DataFrame, max_df: int = MAX_DF, k: int = TOP) -> DataFrame:
    """(i, j, kscore, rank): each left record's best candidates.

    Lists meet left keys by one shuffle on (ctry, key), and left records by one on i, whose number of tasks follows
    the left records: bytes would tell little of the pairs in a list.
    """
    right_keys = keys(right)
    stops = sized(stop_keys(right_keys, max_df))
    met = without(keys(left), stops).join(lists(without(right_keys, stops), shards(left, right)), ["ctry", "key"])
    least = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tasks = max(least, min(left.count() // LEFT_RECORDS + 1, MOST_TASKS))
    dealt = met.select(F.col("entity_id").alias("i"), "units", "js").repartition(tasks, "i")
    return top(score(dealt.select("i", "units", F.explode("js").alias("j"))), k)


def neighbours(right: DataFrame, k: int = 6, max_df: int = MAX_DF) -> DataFrame:
    """(a, n): each right record's nearest right records: the best k + 1 without itself."""
    found = block(right, right, max_df, k + 1)
    return found.where("i <> j").select(F.col("i").alias("a"), F.col("j").alias("n"), F.col("kscore").alias("score"))
