"""URL filters by temporal list join.

A list is a history of dated entries: a domain (with all below it) or a domain
with a path prefix is added or removed.  Entries become validity intervals, and
each capture is judged by the entries that were active when it was fetched.

Method: a URL gives its keys, every domain suffix of its host and each of these
with every prefix of the path (whole segments), a handful per URL; an equi-join on the key meets the
intervals, and ``from <= fetched < until`` is the as-of condition.  The list side
is broadcast only when it has at most ``MOST_BROADCAST`` intervals, counted
first; a longer one is joined by shuffle, where captures of one key are spread
over ``SALTS`` parts and the few intervals of a key are repeated for each.

Defined cases: a null or unparsable URL, or a null fetch time, has no active
entry and is not blocked; captures that repeat stay separate rows; of entries of
one pattern at one time the removal counts; removing what isn't listed, or
adding it again, changes nothing; patterns are compared as URLs are, without scheme,
user, port, query and closing slashes (``www.`` is a label like others); null patterns, times or actions are ignored;
an empty list blocks nothing and an empty table gives an empty result; columns
besides those named are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MOST_BROADCAST, SALTS = 100_000, 16
#: The part of a URL after the scheme: host without user and port, and path.
_HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)"
_PATH = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)"


def normal(pattern: Column) -> Column:
    """A list's pattern in the form of ``keys``."""
    out = F.lower(pattern)
    for old, new in ((r"^[a-z][a-z0-9+.-]*://", ""), (r"[?#].*$", ""), (r"^[^/@]*@", ""), (r"^([^/:]*):[0-9]*", "$1"), (r"^([^/]*?)\.+(/|$)", "$1$2"), (r"/+", "/"), (r"/$", "")):
        out = F.regexp_replace(out, old, new)
    return out


def intervals(entries: DataFrame) -> DataFrame:
    """(pattern, since, until) from (pattern, at, action in add/remove); ``until`` is null while listed."""
    known = entries.where("pattern is not null and at is not null and action in ('add', 'remove')")
    states = known.groupBy(normal(F.col("pattern")).alias("pattern"), "at").agg(F.min(F.col("action") == "add").alias("listed"))
    line = Window.partitionBy("pattern").orderBy("at")
    changes = states.withColumn("before", F.lag("listed", 1, False).over(line)).where("listed <> before")
    return changes.withColumn("until", F.lead("at").over(line)).where("listed").select("pattern", F.col("at").alias("since"), "until")


def host(url: Column) -> Column:
    return F.rtrim(F.lower(F.regexp_extract(url, _HOST, 1)), F.lit("."))


def keys(url: Column) -> Column:
    """Domain suffixes, and each of them with each prefix of the path."""
    labels = F.split(host(url), r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    parts = F.filter(F.split(F.regexp_extract(url, _PATH, 1), "/"), lambda s: s != "")
    n = F.size(parts)
    prefixes = F.when(n > 0, F.flatten(F.transform(suffixes, lambda s: F.transform(F.sequence(F.lit(1), n), lambda i: F.concat_ws("/", s, F.array_join(F.slice(parts, 1, i), "/")))))).otherwise(F.array().cast("array<string>"))
    return F.when(host(url) != "", F.array_distinct(F.concat(suffixes, F.transform(prefixes, F.lower))))


def judge(captures: DataFrame, entries: DataFrame, most_broadcast: int = MOST_BROADCAST) -> DataFrame:
    """Every capture (page_id, url, fetched) with ``n_active``, ``first_pattern`` and ``blocked``."""
    listed = intervals(entries)
    slim = captures.select("page_id", "url", "fetched")
    # equal captures have equal answers: judge each once
    each = slim.where("fetched is not null").select("url", "fetched").distinct()
    keyed = each.select("url", "fetched", F.explode(keys(F.col("url"))).alias("pattern"))
    small = listed.limit(most_broadcast + 1).count() <= most_broadcast
    active = (F.col("since") <= F.col("fetched")) & (F.col("until").isNull() | (F.col("fetched") < F.col("until")))
    if small:
        met = keyed.join(F.broadcast(listed), "pattern")
    else:
        spread = F.pmod(F.xxhash64("url", "fetched"), F.lit(SALTS)).cast("int")
        salted = listed.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        met = keyed.withColumn("salt", spread).join(salted, ["pattern", "salt"])
    found = met.where(active).groupBy("url", "fetched").agg(F.count("*").alias("n_active"), F.min("pattern").alias("first_pattern"))
    out = slim.join(found, ["url", "fetched"], "left")
    return out.select("page_id", "url", "fetched", F.coalesce("n_active", F.lit(0)).cast("long").alias("n_active"), "first_pattern", F.col("n_active").isNotNull().alias("blocked"))
