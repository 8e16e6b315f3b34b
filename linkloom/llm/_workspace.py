"""Shared-folder tables for multi-pass operators.

A pass whose output several later passes read is written as Parquet below the
folder that the cluster names in ``spark.checkpoint.dir``: lineage is cut there,
a lost executor costs only its running tasks, and no file lands on a machine's
own disk.  ``Workspace`` removes its tables when the operator has finished;
the operator's (small) result is checkpointed first.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

#: For a local master alone, whose driver and executor are one process.
FALLBACK_DIR = "/tmp/linkloom-checkpoints"


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; one of our own only where it is unset and the master local."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if found is None:
        current = context._jsc.sc().getCheckpointDir()
        if current.isDefined():
            return current.get()
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = FALLBACK_DIR
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(found)
    return found


#: Rows and bytes of one Arrow batch at most.  Whole texts travel in batches, and Spark's default of
#: 10,000 rows would hold tens of MB several times over on both sides of the pipe.
BATCH_ROWS, BATCH_BYTES = 1_000, 4 << 20


def bounded(spark: SparkSession) -> SparkSession:
    """Lowers the session's Arrow batches to these sizes; smaller ones stay."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        text = spark.conf.get(key, None)
        digits = "".join(c for c in text or "" if c.isdigit())
        if text is None or not digits or not 0 < int(digits) <= most or not text.isdigit():
            spark.conf.set(key, str(most))
    return spark


def fresh(name: str, taken: list[str]) -> str:
    """``name``, or what is like it and no column of ``taken`` (whatever the case)."""
    low = {c.lower() for c in taken}
    while name.lower() in low:
        name += "_"
    return name


class Workspace:
    def __init__(self, spark: SparkSession, name: str):
        self.spark = bounded(spark)
        self.root = f"{shared_dir(spark).rstrip('/')}/linkloom-{name}-{uuid.uuid4().hex}"

    def __enter__(self) -> "Workspace":
        return self

    def __exit__(self, *exc) -> None:
        self.drop(self.root)

    def drop(self, path: str) -> None:
        jvm = self.spark._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(target, True)

    def table(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` once and read it back."""
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").option("compression", "lz4_raw").parquet(path)
        # read whole or nearly: looking filters up in dictionaries first would only open each file twice
        return self.spark.read.schema(df.schema).option("parquet.filter.dictionary.enabled", "false").parquet(path)

    def release(self, name: str) -> None:
        self.drop(f"{self.root}/{name}")

    def finish(self, df: DataFrame) -> DataFrame:
        """Checkpoint the operator's result, so that the tables below can go."""
        return df.checkpoint(eager=True)
