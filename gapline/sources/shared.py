"""Tables that cut lineage, written to the folder that the driver and all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where that is unset a temporary folder, which only a local master can share."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if context.applicationId not in _own:
        _own[context.applicationId] = tempfile.mkdtemp(prefix="gapline-")
        atexit.register(shutil.rmtree, _own[context.applicationId], ignore_errors=True)
    return "file://" + _own[context.applicationId]


class Scope:
    """Writes tables and, when it is left, deletes them: ``with Scope(spark) as s: s.keep(df)``. Left open, they stay for what reads them."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def keep(self, df: DataFrame, *by: str) -> DataFrame:
        """``df`` as written; with ``by``, in a folder for each value of these columns."""
        path = f"{shared_folder(self.spark)}/gapline-{uuid.uuid4().hex}"
        (df.write.partitionBy(*by) if by else df.write).parquet(path)
        self.paths.append(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self) -> None:
        context = self.spark.sparkContext
        for path in self.paths:
            p = context._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(context._jsc.hadoopConfiguration()).delete(p, True)
        self.paths = []

    def __enter__(self) -> Scope:
        return self

    def __exit__(self, *_: object) -> None:
        self.drop()
