"""What every operator works on: a session, a catalog and a folder for files."""

from __future__ import annotations

import contextlib
import os
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ebbline.functions.codec import Layout, floor_to, pk_text
from ebbline.plans.modes import Mode
from ebbline.plans.seam import Keys, Seam, Table
from ebbline.sources.catalog import Catalog, CatalogError, Conflict, FileEntry, Line
from ebbline.sources.files import BUCKET, PK, SEQ, TIER, remove_files, stage


class RoutingError(ValueError):
    """A write that no placement allows."""


@dataclass
class Store:
    spark: SparkSession
    catalog: Catalog
    root: str

    @classmethod
    def open(cls, spark: SparkSession, root: str, catalog: str | None = None) -> Store:
        """root: a folder of any store that driver and executors share. catalog: a file of the driver, by default in root."""
        if spark.conf.get("spark.sql.session.timeZone") != "UTC":
            raise ValueError("tier keys need spark.sql.session.timeZone=UTC")
        return cls(spark, Catalog(catalog or os.path.join(root.removeprefix("file://"), "catalog.db")), root)

    def table(self, name: str) -> Table:
        table, spec = self.catalog.table(name)
        return Table(table, name, T.StructType.fromJson(spec["schema"]), spec["pk"], spec["tier_key"], Mode.parse(spec["mode"]), Layout(spec["layout"]), spec)

    def seam(self, table: Table, line: Line | None = None, keys: Keys = Keys()) -> Seam:
        return Seam(self.spark, self.catalog, table, line or self.catalog.line(table.id), keys)

    def folder(self, table: Table, part: str) -> str:
        return f"{self.root}/{table.name}-{table.id}/{part}"

    def prepared(self, table: Table, rows: DataFrame) -> DataFrame:
        """Rows in the table's columns, with their key texts and tier keys. Missing columns are null."""
        unknown = set(rows.columns) - set(table.columns)
        if unknown:
            raise RoutingError(f"{table.name} has no column {', '.join(sorted(unknown))}")
        columns = [(F.col(f"`{f.name}`") if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in table.schema]
        out = rows.select(*columns)
        return out.select("*", pk_text(table.pk, table.schema).alias(PK), table.kind.to_long(F.col(table.tier_key)).alias(TIER))

    @contextlib.contextmanager
    def validated(self, table: Table, rows: DataFrame) -> Iterator[DataFrame]:
        """prepared rows; keys must not be null nor repeat.

        The input is computed once and kept (spilling to disk) for the checks and the write, which so see the same rows.
        """
        out = self.prepared(table, rows).persist()
        try:
            self._check_keys(table, out)
            yield out
        finally:
            out.unpersist()

    @staticmethod
    def _check_keys(table: Table, out: DataFrame) -> None:
        bad = out.agg(F.count_if(F.col(PK).isNull()).alias("pk"), F.count_if(F.col(TIER).isNull()).alias("tier")).first()
        if bad.pk:
            raise RoutingError(f"{table.name}: a primary key is null")
        if bad.tier:
            raise RoutingError(f"{table.name}: a tier key is null")
        if twice := out.groupBy(PK).count().filter("count > 1").take(1):
            raise RoutingError(f"{table.name}: the key {twice[0][0]!r} is there twice")

    # Files of the three sets

    def stage_hot(self, table: Table, rows: DataFrame) -> list[FileEntry]:
        """rows: columns, PK, TIER."""
        width = table.spec["width"]
        bucket = floor_to(F.col(TIER), width) if width else F.lit(0).cast("long")
        out = rows.select(*table.columns, PK, bucket.alias(BUCKET), TIER, F.lit(0).cast("long").alias(SEQ))
        return stage(out, self.folder(table, "hot"), "data")

    def stage_lake(self, table: Table, rows: DataFrame, seq: int) -> list[FileEntry]:
        bucket = table.layout.bucket(F.col(TIER), table.kind)
        return stage(rows.select(*table.columns, PK, bucket.alias(BUCKET), TIER, F.lit(seq).cast("long").alias(SEQ)), self.folder(table, "lake"), "data")

    def stage_deletes(self, table: Table, keys: DataFrame, seq: int, once: bool = False) -> list[FileEntry]:
        """keys: PK and the tier key the lake has the row at (TIER), or any of its bucket; once: no key is there twice for a bucket."""
        bucket = table.layout.bucket(F.col(TIER), table.kind)
        out = keys.select(PK, bucket.alias(BUCKET), F.lit(seq).cast("long").alias(SEQ))
        return stage(out if once else out.distinct(), self.folder(table, "lake"), "delete", tier=None)

    def stage_delta(self, table: Table, rows: DataFrame) -> list[FileEntry]:
        """rows: columns, PK, __op, TIER, __old_tier. All of them get one version, newer than any before."""
        version = self.catalog.next_delta_version(table.id)
        out = rows.select(*table.columns, PK, F.col("__op").cast("int").alias("__op"), TIER, F.col("__old_tier").cast("long").alias("__old_tier"), F.lit(version).cast("long").alias("__version"))
        return stage(out, self.folder(table, "delta"), "data", tier="__version")

    def publish_lake(self, table: Table, seq: int, add: list[FileEntry], remove: list[FileEntry] = (), props: dict | None = None, **advance: int) -> int:
        """Commit staged lake files as snapshot seq, which their rows carry; lines move in the same transaction."""
        try:
            with self.catalog.transaction():
                if self.catalog.line(table.id).s != seq - 1:
                    raise Conflict(f"another commit took snapshot {seq}")
                self.catalog.publish(table.id, "lake", add, remove, props)
                if advance:
                    self.catalog.advance(table.id, **advance)
        except CatalogError:
            self.discard(add)
            raise
        return seq

    def discard(self, files: list[FileEntry]) -> None:
        remove_files(self.spark, [f.path for f in files])

    def affected(self, table: Table, keys: DataFrame) -> list[FileEntry]:
        """Hot files that hold any of the keys (a DataFrame with PK). Only key columns are read.

        Keys may be at any tier key, as an upsert may move a row.
        """
        files = self.catalog.files(table.id, "hot")
        if not files:
            return []
        hot = self.spark.read.schema(T.StructType([T.StructField(PK, T.StringType())])).parquet(*[f.path for f in files])
        paths = hot.select(PK, F.col("_metadata.file_path").alias("path")).join(keys.select(PK), PK, "left_semi").select("path").distinct().collect()
        found = {r.path for r in paths}
        return [f for f in files if f.path in found]

    def rewrite_hot(self, table: Table, gone: DataFrame | None, new: DataFrame | None) -> tuple[list[FileEntry], list[FileEntry]]:
        """Copy-on-write: files to add and remove so that the keys `gone` are away and the rows `new` are there."""
        from ebbline.sources.files import read_files, stored_schema

        old = self.affected(table, gone) if gone is not None else []
        rest = read_files(self.spark, old, stored_schema(table.schema)).select(*table.columns, PK, TIER).join(gone.select(PK).distinct(), PK, "left_anti") if old else None
        rows = rest.unionByName(new.select(*table.columns, PK, TIER)) if rest is not None and new is not None else rest if rest is not None else new
        return (self.stage_hot(table, rows) if rows is not None else []), old
