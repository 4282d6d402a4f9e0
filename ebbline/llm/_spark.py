"""Session helpers of the training-data operators."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import re
import shutil
import sys
import tempfile
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Sizes beyond this are Spark's "unknown".
_UNKNOWN = 1 << 50


_SHIPPED: set[str] = set()


#: Whole texts go to Python in Arrow batches of so many bytes; a batch of thousands of long texts has no bound.
BATCH_BYTES = 4 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def ship(spark: SparkSession) -> None:
    """Send this package's code to the executors, once per application, so that their Python finds it.

    Also bounds the session's Arrow batches, unless they are smaller already.
    """
    sc = spark.sparkContext
    if _bytes(spark.conf.get(_BATCH)) > BATCH_BYTES:
        spark.conf.set(_BATCH, str(BATCH_BYTES))
    if sc.applicationId not in _SHIPPED:
        package = Path(__file__).resolve().parents[1]
        if package.is_dir() and package.parent.is_dir():
            folder = tempfile.mkdtemp(prefix="ebbline-code-")  # on the driver, which serves it to the executors until it ends
            atexit.register(shutil.rmtree, folder, ignore_errors=True)
            copy = shutil.copytree(package, f"{folder}/code/{package.name}", ignore=shutil.ignore_patterns("__pycache__"))
            sc.addPyFile(shutil.make_archive(f"{folder}/{package.name}", "zip", Path(copy).parent))
        _SHIPPED.add(sc.applicationId)


#: Parquet's reader holds the texts of a batch of rows in arrays that grow by doubling; Spark's 4096 rows have no bound in bytes.
READ_ROWS = 256
_READ = "spark.sql.parquet.columnarReaderBatchSize"


def read_few(spark: SparkSession) -> None:
    """Bound the session's Parquet batches, unless they are smaller already: fewer huge arrays, a smaller heap."""
    if int(spark.conf.get(_READ)) > READ_ROWS:
        spark.conf.set(_READ, str(READ_ROWS))


def _bytes(text: str) -> int:
    """A size as Spark writes it; no limit is a large one."""
    m = re.fullmatch(r"(\d+)([kmgtp]?)b?", text.strip().lower())
    return int(m[1]) << 10 * " kmgtp".index(m[2] or " ") if m and int(m[1]) else 1 << 62


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage: materialise in the folder every executor shares (spark.checkpoint.dir).

    What was shuffled on the way goes as soon as the rows are stored. Only a session without that setting (tests, one
    machine) gets a folder of its own.
    """
    spark = df.sparkSession
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="ebbline-"))
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:  # a plan takes the setting when it is made
        once = df.select("*")
    finally:
        spark.conf.set(_CLEANUP, before)
    return once.checkpoint()


def drop(stored: DataFrame) -> None:
    """Delete the files of a frame that cut() returned and that nothing reads any more."""
    plan = stored._jdf.queryExecution().logical()
    if plan.getClass().getSimpleName() == "LogicalRDD" and (at := plan.rdd().getCheckpointFile()).isDefined():
        sc = stored.sparkSession.sparkContext
        path = sc._jvm.org.apache.hadoop.fs.Path(at.get())
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def input_bytes(df: DataFrame) -> int:
    """Catalyst's size of df (file sizes of its scans), without a job; rows are counted where Spark doesn't know."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return size if size < _UNKNOWN else 2000 * df.count()


def release() -> None:
    """Give a Python worker's free memory back to the machine; workers outlive tasks and would keep their peak."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if sys.platform.startswith("linux"):
        with contextlib.suppress(OSError, AttributeError):  # a libc without it
            ctypes.CDLL(None).malloc_trim(0)


def pieces(size: int, each: int, least: int = 1) -> int:
    """So many parts of about `each` bytes."""
    return max(least, -(-size // each))


def pow2(n: int) -> int:
    return 1 << max(0, (n - 1).bit_length())
