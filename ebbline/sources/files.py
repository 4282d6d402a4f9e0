"""File sets: staging immutable Parquet files, and reading the ones a manifest lists."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .catalog import FileEntry

PK, SEQ, BUCKET, TIER = "__pk", "__seq", "__bucket", "__tier"
_HIDDEN = T.StructType([T.StructField(PK, T.StringType()), T.StructField(BUCKET, T.LongType()), T.StructField(TIER, T.LongType()), T.StructField(SEQ, T.LongType())])
DELTA = T.StructType([T.StructField(PK, T.StringType()), T.StructField("__op", T.IntegerType()), T.StructField(TIER, T.LongType()), T.StructField("__old_tier", T.LongType()), T.StructField("__version", T.LongType())])
DELETE = T.StructType([T.StructField(PK, T.StringType()), T.StructField(BUCKET, T.LongType()), T.StructField(SEQ, T.LongType())])


def stored_schema(schema: T.StructType) -> T.StructType:
    """A table's columns as hot and lake files hold them."""
    return T.StructType([*schema.fields, *_HIDDEN.fields])


def delta_schema(schema: T.StructType) -> T.StructType:
    """A correction's columns, typed, so that filters and pruning reach its files too."""
    return T.StructType([*schema.fields, *DELTA.fields])


def read_files(spark: SparkSession, files: Sequence[FileEntry], schema: T.StructType) -> DataFrame:
    """The rows of the files; columns that older files don't have are null."""
    if not files:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*[f.path for f in files])


def stage(df: DataFrame, folder: str, kind: str, tier: str | None = TIER, by_bucket: bool = True) -> list[FileEntry]:
    """Write df to files nobody sees yet and describe them: rows, key range and bucket of each.

    Rows of a bucket are brought together first, so that a file has one bucket, but in as many files as their size
    asks for: the shuffle is one that adaptive execution may split and coalesce (REBALANCE).
    """
    path = f"{folder.rstrip('/')}/{uuid.uuid4().hex}"
    has_bucket = BUCKET in df.columns
    out = df.hint("rebalance", F.col(BUCKET)) if has_bucket and by_bucket else df
    if has_bucket:
        out = out.withColumn("__folder", F.col(BUCKET))
    writer = out.write.partitionBy("__folder") if has_bucket else out.write
    writer.option("maxRecordsPerFile", 20_000_000).parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    number = F.col(tier) if tier and tier in df.columns else F.lit(None).cast("long")
    bucket = F.first(BUCKET) if has_bucket else F.first(F.lit(None).cast("long"))
    found = back.groupBy(F.col("_metadata.file_path").alias("path")).agg(F.count("*").alias("n"), F.min(number).alias("low"), F.max(number).alias("high"), bucket.alias("bucket")).collect()
    return [FileEntry(r.path, kind, r.bucket, r.low, r.high, r.n) for r in sorted(found, key=lambda r: r.path)]


def apply_deletes(spark: SparkSession, files: Sequence[FileEntry], schema: T.StructType, small: int) -> DataFrame:
    """The rows of data files without those that a younger delete file of their bucket removes.

    Only files in buckets with younger deletes are joined; the others are read as they are. Deletes are broadcast if the
    manifest counts no more than `small` of them.
    """
    data, deletes = [f for f in files if f.kind == "data"], [f for f in files if f.kind == "delete"]
    newest: dict[int | None, int] = {}
    for d in deletes:
        newest[d.bucket] = max(newest.get(d.bucket, -1), d.added)
    touched = [f for f in data if newest.get(f.bucket, -1) > f.added]
    if not touched:
        return read_files(spark, data, stored_schema(schema))
    buckets = {f.bucket for f in touched}
    used = [d for d in deletes if d.bucket in buckets]
    gone = read_files(spark, used, DELETE).select(F.col(PK).alias("__dpk"), F.col(BUCKET).alias("__dbucket"), F.col(SEQ).alias("__dseq"))
    gone = gone.groupBy("__dpk", "__dbucket").agg(F.max("__dseq").alias("__dseq"))
    if sum(d.rows for d in used) <= small:
        gone = F.broadcast(gone)
    rows = read_files(spark, touched, stored_schema(schema))
    on: Column = (F.col(PK) == F.col("__dpk")) & (F.col(BUCKET) == F.col("__dbucket")) & (F.col("__dseq") > F.col(SEQ))
    rows = rows.join(gone, on, "left_anti")
    rest = [f for f in data if newest.get(f.bucket, -1) <= f.added]
    return rows.unionByName(read_files(spark, rest, stored_schema(schema))) if rest else rows


def remove_files(spark: SparkSession, paths: Sequence[str]) -> int:
    """Delete files in whatever store they are."""
    jvm, n = spark._jvm, 0
    conf = spark._jsparkSession.sessionState().newHadoopConf()
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        n += bool(path.getFileSystem(conf).delete(path, False))
    return n


def list_files(spark: SparkSession, folder: str) -> list[tuple[str, float]]:
    """Parquet files below a folder, with their times in seconds."""
    jvm = spark._jvm
    conf = spark._jsparkSession.sessionState().newHadoopConf()
    path = jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(conf)
    if not fs.exists(path):
        return []
    out, walk = [], fs.listFiles(path, True)
    while walk.hasNext():
        f = walk.next()
        if f.getPath().getName().endswith(".parquet"):
            out.append((f.getPath().toString(), f.getModificationTime() / 1000))
    return out
