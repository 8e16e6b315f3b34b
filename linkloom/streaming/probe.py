"""Candidates of arriving records against a standing index.

The index is a table of postings (``operators.blocking.index``).  Each micro-batch
is cleaned and blocked like any batch; its candidates go to a folder of the
batch's number, written over when a batch is tried again, so each is there once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from linkloom.functions.text import prepare
from linkloom.operators import blocking


def probe(stream: DataFrame, postings: DataFrame, out: str, checkpoint: str, k: int = blocking.TOP, once: bool = False) -> StreamingQuery:
    """Starts the query; with ``once`` it ends when all that is there has been read."""

    def each(batch: DataFrame, number: int) -> None:
        found = blocking.top(blocking.score(blocking.meet(blocking.keys(prepare(batch)), postings)), k)
        found.write.mode("overwrite").parquet(f"{out}/batch={number}")

    writer = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
