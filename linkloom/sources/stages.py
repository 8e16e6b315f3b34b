"""Stage tables: written once per set of parameters, read back ever after."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


class Stages:
    """Parquet tables and small JSON documents below one folder, on any Hadoop file system.

    A stage's name carries a digest of all its parameters, so a run with others
    never picks up a stale table.  Only a table that was written to its end
    (``_SUCCESS``) counts.
    """

    def __init__(self, spark: SparkSession, root: str, **parameters):
        self.spark, self.root, self.parameters = spark, root.rstrip("/"), parameters

    def path(self, name: str, **more) -> str:
        told = json.dumps(self.parameters | more, sort_keys=True, default=str)
        return f"{self.root}/{name}-{hashlib.sha256(told.encode()).hexdigest()[:12]}"

    def _file(self, path: str):
        target = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return target.getFileSystem(self.spark._jsc.hadoopConfiguration()), target

    def exists(self, path: str) -> bool:
        store, target = self._file(path)
        return store.exists(target)

    def table(self, name: str, make: Callable[[], DataFrame], **more) -> DataFrame:
        path = self.path(name, **more)
        if not self.exists(f"{path}/_SUCCESS"):
            make().write.mode("overwrite").parquet(path)
        return self.spark.read.parquet(path)

    def document(self, name: str, make: Callable[[], dict], **more) -> dict:
        """A small JSON value, kept as a one-row text table."""
        path = self.path(name, **more)
        if not self.exists(f"{path}/_SUCCESS"):
            self.spark.createDataFrame([(json.dumps(make()),)], "value string").coalesce(1).write.mode("overwrite").text(path)
        return json.loads(self.spark.read.text(path).first()["value"])
