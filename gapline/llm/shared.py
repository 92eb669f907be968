"""Tables that cut lineage, in the folder that all executors share."""

from __future__ import annotations

import atexit
import ctypes
import re
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session. Where it is unset, a temporary folder, on a local master only: on a cluster
    each executor would write to a disk of its own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    sc = spark.sparkContext
    if not re.fullmatch(r"local(\[[^]]*\])?", sc.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if sc.applicationId not in _own:
        folder = tempfile.mkdtemp(prefix="gapline-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        _own[sc.applicationId] = f"file://{folder}"
    return _own[sc.applicationId]


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/gapline-{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back, so that a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._gapline_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete a table that :func:`materialise` wrote, once nothing reads it any more."""
    path = getattr(df, "_gapline_path", None)
    if path:
        sc = df.sparkSession.sparkContext
        p = sc._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)


ARROW_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def bound_batches() -> None:
    """Arrow batches of at most 8 MB for this session, unless its user has set another bound than Spark's 64 MB: every task holds one or two of
    them in the JVM and as many in Python."""
    spark = SparkSession.getActiveSession()
    if spark is not None and spark.conf.get(ARROW_BYTES, f"{64 << 20}b").rstrip("b") == str(64 << 20):
        spark.conf.set(ARROW_BYTES, str(8 << 20))


def trim() -> None:
    """Gives freed memory back to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


Batches = Iterator[pa.RecordBatch]


def lean(run: Callable[[Batches], Batches]) -> Callable[[Batches], Batches]:
    """``run`` for ``mapInArrow``, with what it freed given back after each batch and task: Spark reuses its Python workers, so what one
    stage leaves would add to the next one's memory."""
    bound_batches()

    def wrapped(batches: Batches) -> Batches:
        def each() -> Batches:
            for batch in batches:
                yield batch
                del batch
                trim()

        try:
            yield from run(each())
        finally:
            trim()

    return wrapped
