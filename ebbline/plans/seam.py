"""The seam view: one DataFrame over the hot set, the lake and the corrections, split at the cut-line.

    hot[tier >= t]  UNION ALL  ((lake@s LEFT ANTI newest corrections ON pk) UNION ALL upserts)[tier < t]

Built as plain DataFrame composition: Catalyst pushes filters and columns through the union and the anti join into the
Parquet scans. What it can't see is decided here from the catalog: files outside the wanted keys, an empty overlay, and
sides of the cut-line that a predicate rules out.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ebbline.functions.codec import Layout, TierKind
from ebbline.plans.modes import Cold, Mode
from ebbline.plans.predicates import Side
from ebbline.sources.catalog import Catalog, FileEntry, Line
from ebbline.sources.files import PK, TIER, apply_deletes, delta_schema, read_files, stored_schema

#: Corrections and deletes up to so many rows, as the catalog counts them, are broadcast; beyond, Spark joins by shuffle.
BROADCAST_ROWS = 200_000


@dataclass
class Table:
    """A registered table's fixed properties."""

    id: int
    name: str
    schema: T.StructType
    pk: list[str]
    tier_key: str
    mode: Mode
    layout: Layout
    spec: dict

    @property
    def kind(self) -> TierKind:
        return TierKind.of(self.schema[self.tier_key].dataType)

    @property
    def columns(self) -> list[str]:
        return self.schema.names


@dataclass(frozen=True)
class Keys:
    """A half-open range of tier keys; None is open."""

    low: int | None = None
    high: int | None = None

    def meets(self, f: FileEntry) -> bool:
        return (self.low is None or f.high is None or f.high >= self.low) and (self.high is None or f.low is None or f.low < self.high)


class Seam:
    """Reads of one table as of one line.

    keys: tier keys that are wanted; hot and lake files outside of them aren't read, rows outside may still come.
    pin: what keeps the line's files, if anything does.
    """

    def __init__(self, spark: SparkSession, catalog: Catalog, table: Table, line: Line, keys: Keys = Keys(), pin: str | None = None):
        self.spark, self.catalog, self.table, self.line, self.keys, self.pin = spark, catalog, table, line, keys, pin

    def _files(self, part: str, version: int, keys: Keys) -> list[FileEntry]:
        return [f for f in self.catalog.files(self.table.id, part, version) if keys.meets(f)]

    def _between(self, low: int | None, high: int | None) -> Keys:
        lows, highs = [x for x in (low, self.keys.low) if x is not None], [x for x in (high, self.keys.high) if x is not None]
        return Keys(max(lows, default=None), min(highs, default=None))

    def hot(self, floor: int | None = None) -> DataFrame:
        """Stored hot rows, from the floor on."""
        rows = read_files(self.spark, self._files("hot", self.line.hot, self._between(floor, None)), stored_schema(self.table.schema))
        return rows if floor is None else rows.filter(F.col(self.table.tier_key) >= self.table.kind.literal(floor))

    def lake(self, below: int | None = None, live: bool = False) -> DataFrame:
        """Stored lake rows at the pinned snapshot, or at the current one."""
        files = self.catalog.files(self.table.id, "lake", None if live else self.line.s)
        keys = self._between(None, below)
        # Deletes stay whatever their keys: they are matched by bucket.
        return apply_deletes(self.spark, [f for f in files if f.kind == "delete" or keys.meets(f)], self.table.schema, BROADCAST_ROWS)

    def delta_rows(self) -> int:
        return sum(f.rows for f in self.catalog.files(self.table.id, "delta", self.line.delta))

    def corrections(self) -> DataFrame:
        """Newest correction of each key; __old_tier is where the lake has the row, if that isn't at __tier.

        Of several corrections of a key the newest wins, but the lake's place is the one the first of them names.
        """
        log = read_files(self.spark, self.catalog.files(self.table.id, "delta", self.line.delta), delta_schema(self.table.schema))
        return newest(log)

    def _cold(self, below: int | None) -> DataFrame:
        columns, kind = self.table.columns, self.table.kind
        under = (lambda df: df) if below is None else (lambda df: df.filter(F.col(self.table.tier_key) < kind.literal(below)))
        if self.table.mode.cold is Cold.LIVE:
            return under(self.lake(below, live=True).select(*columns))
        lake = self.lake(below)
        n = self.delta_rows()
        if not n:
            return under(lake.select(*columns))
        fixes = self.corrections()
        # Any correction hides the lake's row of its key, wherever its own tier key lies.
        hiding = fixes.select(F.col(PK).alias("__hidden"))
        lake = lake.join(F.broadcast(hiding) if n <= BROADCAST_ROWS else hiding, F.col(PK) == F.col("__hidden"), "left_anti")
        return under(lake.select(*columns).unionByName(fixes.filter("__op = 0").select(*columns)))

    def view(self, side: Side = Side.MIXED) -> DataFrame:
        """The table as of the line; a provable side leaves the other side's branch out of the plan."""
        if self.table.mode.hot_complete or self.table.mode.keep_heap and not self.line.s:
            return self.hot().select(*self.table.columns)
        hot = self.hot(self.line.t).select(*self.table.columns)
        if side is Side.HOT:
            return hot
        cold = self._cold(self.line.t)
        return cold if side is Side.COLD else hot.unionByName(cold)

    def cold(self) -> DataFrame:
        """Only what lies below the cut-line."""
        return self._cold(self.line.t)

    def hybrid(self, lag: int) -> DataFrame:
        """A mirrored table read as if it were tiered: the newest `lag` keys hot, older ones from the lake.

        The lake must have a snapshot, otherwise the hot set answers.
        """
        high = max((f.high for f in self.catalog.files(self.table.id, "hot", self.line.hot) if f.high is not None), default=None)
        if not self.line.s or high is None:
            return self.hot().select(*self.table.columns)
        cut = high - lag
        below = self.lake(cut).filter(F.col(self.table.tier_key) < self.table.kind.literal(cut))
        return self.hot(cut).select(*self.table.columns).unionByName(below.select(*self.table.columns))


def newest(log: DataFrame) -> DataFrame:
    """One row per key: the newest version, with the first known place in the lake. Map-side combined."""
    place = F.coalesce("__old_tier", TIER)
    rows = log.groupBy(F.col(PK).alias("__key")).agg(F.max_by(F.struct(*log.columns), "__version").alias("__row"), F.min_by(place, "__version").alias("__place"))
    out = rows.select("__row.*", "__place")
    return out.withColumn("__old_tier", F.when(F.col("__place") != F.col(TIER), F.col("__place"))).drop("__place")
