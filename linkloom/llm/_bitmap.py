"""Maps of fixed size that spare most rows a shuffle.

A map has ``2^BITS`` bits; bit ``xxhash64(key) mod 2^BITS`` is set for every key of a
table.  It is made by ``bit_or`` (at most ``2^BITS / 32`` small rows leave for the
driver, whatever the input) and broadcast.  Rows whose bit isn't set surely have
no partner; the others go on to an exact join.  A full map only saves less.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._workspace import fresh

BITS = 23


def slot(*keys) -> Column:
    return F.xxhash64(*keys).bitwiseAND(F.lit((1 << BITS) - 1))


def low_bits(key):
    """The slot of a key that is a hash itself; a Column or an array."""
    mask = (1 << BITS) - 1
    return key.bitwiseAND(F.lit(mask)) if isinstance(key, Column) else key & mask


def build(df: DataFrame, *keys: str, slots: Column | None = None):
    """A broadcast map of the keys of ``df``, or of ``slots`` of its rows."""
    words = df.select((slot(*keys) if slots is None else slots).alias("s")).selectExpr("cast(shiftright(s, 5) as int) word", "shiftleft(1L, cast(s & 31 as int)) bit")
    got = words.groupBy("word").agg(F.expr("bit_or(bit)").alias("bits")).toArrow()
    bits = np.zeros(1 << (BITS - 5), np.int64)
    bits[got.column("word").to_numpy()] = got.column("bits").to_numpy()
    return df.sparkSession.sparkContext.broadcast(bits)


def hit(shared, slots: np.ndarray) -> np.ndarray:
    return (shared.value[slots >> 5] >> (slots & 31)) & 1 == 1


def only(df: DataFrame, shared, keys: list[str], want: bool) -> DataFrame:
    """The rows of ``df`` whose key's bit is set, or isn't."""

    def run(batches):
        for batch in batches:
            keep = hit(shared, batch.column(batch.num_columns - 1).to_numpy()) == want
            yield pa.RecordBatch.from_arrays(batch.columns[:-1], schema=pa.schema(list(batch.schema)[:-1])).filter(pa.array(keep))

    return df.select("*", slot(*keys).alias(fresh("_slot", df.columns))).mapInArrow(run, df.schema)
