"""Routed writes: insert, upsert, delete, update, and what they return."""

from __future__ import annotations

import functools
from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ebbline.functions.codec import pk_text
from ebbline.operators.store import RoutingError, Store
from ebbline.plans.modes import Kind, Placement
from ebbline.plans.predicates import Predicate, Side, from_tree, parse_predicate
from ebbline.plans.seam import Keys, Seam, Table
from ebbline.sources.catalog import CatalogError, Conflict, FileEntry, Line
from ebbline.sources.files import PK, TIER

UPSERT, TOMBSTONE = 0, 1
#: How often a write is routed anew before it gives up.
TRIES = 8


def retried(write: Callable) -> Callable:
    """Route and write again if the cut-line or the files that the write had read changed before it was published."""

    @functools.wraps(write)
    def run(*args, **kwargs):
        for _ in range(TRIES - 1):
            try:
                return write(*args, **kwargs)
            except Conflict:
                continue
        return write(*args, **kwargs)

    return run


def _is_hot(table: Table, t: int) -> Column:
    return F.lit(True) if table.mode.hot_complete else F.col(TIER) >= t


def check_retention(store: Store, table: Table, rows: DataFrame) -> None:
    r = store.catalog.line(table.id).r
    if r is not None and rows.filter(F.col(TIER) < r).take(1):
        raise RoutingError(f"{table.name}: rows below the retention line {r}")


def check_partitions(store: Store, table: Table, rows: DataFrame) -> None:
    """Hot rows need a partition, if the table has any."""
    parts = [p for p in store.catalog.partitions(table.id) if p.state != "dropped"]
    if not parts:
        return
    bounds = store.spark.createDataFrame([(p.lo, p.hi) for p in parts], "lo long, hi long")
    if rows.join(F.broadcast(bounds), (F.col(TIER) >= F.col("lo")) & (F.col(TIER) < F.col("hi")), "left_anti").take(1):
        raise RoutingError(f"{table.name}: rows outside of all partitions")


def corrections(rows: DataFrame, op: int, old_tier: Column | None = None) -> DataFrame:
    return rows.withColumn("__op", F.lit(op)).withColumn("__old_tier", (F.lit(None) if old_tier is None else old_tier).cast("long"))


def _total(files: list[FileEntry]) -> int:
    return sum(f.rows for f in files if f.kind == "data")


def publish(store: Store, table: Table, routed: Line, hot: tuple[list[FileEntry], list[FileEntry]] | None = None, delta: list[FileEntry] | None = None, lake: tuple[int, list[FileEntry]] | None = None, same_hot: bool = False) -> None:
    """Publish the staged files of a write in one transaction, or none of them.

    routed: the line the rows were routed by; a Conflict if the cut-line moved since, or, with same_hot, if the hot set
    changed at all. Files of a write that isn't published are deleted.
    """
    try:
        with store.catalog.transaction():
            now = store.catalog.line(table.id)
            if now.t != routed.t or same_hot and now.hot != routed.hot:
                raise Conflict(f"{table.name} changed since its rows were routed")
            if hot and (hot[0] or hot[1]):
                store.catalog.publish(table.id, "hot", *hot)
            if delta:
                store.catalog.publish(table.id, "delta", delta)
            if lake:
                store.publish_lake(table, *lake)
    except CatalogError:
        store.discard([*(hot[0] if hot else []), *(delta or [])])
        raise


def lake_merge(store: Store, table: Table, rows: DataFrame | None, gone: DataFrame | None, props: dict | None = None) -> int:
    """Replace rows of the lake by key: `gone` (PK, TIER where the lake has them) leave, `rows` come. One snapshot."""
    seq = store.catalog.line(table.id).s + 1
    add = (store.stage_deletes(table, gone, seq) if gone is not None else []) + (store.stage_lake(table, rows, seq) if rows is not None else [])
    return store.publish_lake(table, seq, add, props=props)


def _lake_places(store: Store, table: Table, keys: DataFrame) -> DataFrame:
    """PK and TIER of the lake's rows with the keys."""
    lake = store.seam(table).lake(live=True)
    return lake.select(PK, TIER).join(keys.select(PK), PK, "left_semi")


def _with_places(store: Store, table: Table, fixes: DataFrame) -> DataFrame:
    """Upserts with the tier key that the lake has their row at, where that is another: a fold has to remove it there."""
    if not store.catalog.line(table.id).s:
        return fixes
    places = _lake_places(store, table, fixes).groupBy(F.col(PK).alias("__key")).agg(F.max(TIER).alias("__at"))
    out = fixes.drop("__old_tier").join(places, F.col(PK) == F.col("__key"), "left")
    return out.withColumn("__old_tier", F.when(F.col("__at") != F.col(TIER), F.col("__at"))).drop("__key", "__at")


def insert(store: Store, name: str, rows: DataFrame, replace: bool = False) -> dict[str, int]:
    """Route every row to its side of the cut-line; rows per place. replace: hot rows of the same keys are replaced."""
    table = store.table(name)
    with store.validated(table, rows) as valid:
        return _insert(store, table, valid, replace)


@retried
def _insert(store: Store, table: Table, rows: DataFrame, replace: bool) -> dict[str, int]:
    line = store.catalog.line(table.id)
    is_hot = _is_hot(table, line.t)
    hot, cold = rows.filter(is_hot), rows.filter(~is_hot)
    at: Placement = table.mode.insert(False)
    has_cold = not table.mode.hot_complete and bool(cold.take(1))
    if has_cold and at.check_retention:
        check_retention(store, table, cold)
    into_hot = rows if has_cold and at.hot else hot
    check_partitions(store, table, into_hot)
    out = {"hot": 0, "delta": 0, "lake": 0}
    files = store.rewrite_hot(table, into_hot if replace else None, into_hot) if into_hot.take(1) else None
    delta = None
    if has_cold and at.delta:
        fixes = corrections(cold, UPSERT)
        delta = store.stage_delta(table, _with_places(store, table, fixes) if replace else fixes)
    lake = None
    if has_cold and at.lake:
        lake = (line.s + 1, store.stage_deletes(table, _lake_places(store, table, cold), line.s + 1) + store.stage_lake(table, cold, line.s + 1))
        out["lake"] = _total(lake[1])
    if files:
        out["hot"] = _total(files[0]) - _total(files[1]) if not replace else into_hot.count()
    out["delta"] = _total(delta or [])
    publish(store, table, line, files, delta, lake, same_hot=replace and bool(files))
    return out


def upsert(store: Store, name: str, rows: DataFrame) -> dict[str, int]:
    """Insert rows, replacing those of the same key on the same side of the cut-line.

    Below the line a row may come with another tier key than the lake has it at: the correction remembers that place, so
    that a fold removes the old row there.
    """
    return insert(store, name, rows, replace=True)


@retried
def delete(store: Store, name: str, keys: DataFrame) -> dict[str, int]:
    """Delete rows by key. keys: the primary key's columns and the tier key of each row.

    Counted are the keys routed to each side. A key of the wrong tier key deletes nothing on the other side.
    """
    table = store.table(name)
    line = store.catalog.line(table.id)
    rows = keys.select(*[F.col(f"`{c}`").cast(table.schema[c].dataType).alias(c) for c in dict.fromkeys([*table.pk, table.tier_key])])
    rows = rows.withColumn(PK, pk_text(table.pk, table.schema)).withColumn(TIER, table.kind.to_long(F.col(table.tier_key)))
    if rows.filter(F.col(PK).isNull() | F.col(TIER).isNull()).take(1):
        raise RoutingError(f"{name}: a key is null")
    for c in table.columns:
        if c not in rows.columns:
            rows = rows.withColumn(c, F.lit(None).cast(table.schema[c].dataType))
    is_hot = _is_hot(table, line.t)
    hot, cold = rows.filter(is_hot), rows.filter(~is_hot)
    at = table.mode.delete(False)
    has_cold = not table.mode.hot_complete and bool(cold.take(1))
    if has_cold and at.check_retention:
        check_retention(store, table, cold)
    from_hot = rows if at.hot else hot
    files = store.rewrite_hot(table, from_hot, None)
    delta = store.stage_delta(table, corrections(cold, TOMBSTONE)) if has_cold and at.delta else None
    out = {"hot": _total(files[1]) - _total(files[0]), "delta": _total(delta or []), "lake": 0}
    lake = None
    if has_cold and at.lake:
        add = store.stage_deletes(table, _lake_places(store, table, cold), line.s + 1)
        out["lake"] = sum(f.rows for f in add)
        lake = (line.s + 1, add) if add else None
    publish(store, table, line, files, delta, lake)
    return out


#: A condition: SQL text, or a column with the tree that Spark's parser made of it.
Condition = str | tuple[Column, object] | None


def column_of(where: str | tuple[Column, object]) -> Column:
    return F.expr(where) if isinstance(where, str) else where[0]


def _predicate(store: Store, table: Table, where: Condition) -> Predicate:
    if where is None or isinstance(where, str):
        return parse_predicate(store.spark, where, table.tier_key, table.kind)
    return from_tree(where[1], table.tier_key, table.kind)


def seam_for(store: Store, table: Table, where: Condition, line: Line | None = None) -> tuple[Seam, Side]:
    """The seam as of now without the files that the condition rules out, and the side of the cut-line it leaves."""
    line = line or store.catalog.line(table.id)
    predicate = _predicate(store, table, where)
    side = Side.HOT if table.mode.hot_complete else predicate.side(line.t)
    return store.seam(table, line, Keys(*predicate.keys())), side


def _matching(store: Store, table: Table, where: Condition, line: Line) -> tuple[DataFrame | None, DataFrame | None]:
    """(hot, cold) rows a condition holds for, with PK and TIER, as of the line; None for a side that is ruled out."""
    seam, side = seam_for(store, table, where, line)
    keep = (lambda df: df) if where is None else (lambda df: df.filter(column_of(where)))
    if table.mode.hot_complete:
        return keep(seam.hot()).select(*table.columns, PK, TIER), None
    hot = None if side is Side.COLD else keep(seam.hot(line.t)).select(*table.columns, PK, TIER)
    cold = None
    if side is not Side.HOT:
        if table.mode.kind is Kind.DIRECT:
            raise RoutingError(f"{table.name}: rows below the cut-line of a direct table can't be updated in place")
        cold = store.prepared(table, keep(seam.cold()))
    return hot, cold


def side_of(store: Store, table: Table, where: Condition) -> Side:
    return seam_for(store, table, where)[1]


def _both(a: DataFrame | None, b: DataFrame | None, columns: list[str]) -> DataFrame:
    parts = [x.select(*columns) for x in (a, b) if x is not None]
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


@retried
def update(store: Store, name: str, assign: Mapping[str, str | tuple[Column, object]], where: Condition = None) -> tuple[dict[str, int], DataFrame]:
    """UPDATE name SET c = expression, ... WHERE: rows written per place, and the new images of all changed rows.

    A row that moves over the cut-line leaves one side and comes to the other. Below it, a move is a correction that
    remembers where the lake has the row.
    """
    table = store.table(name)
    unknown = [c for c in assign if c not in table.columns]
    if unknown:
        raise RoutingError(f"{name} has no column {', '.join(unknown)}")
    if set(assign) & set(table.pk):
        raise RoutingError(f"{name}: a primary key can't be updated")
    line = store.catalog.line(table.id)
    hot, cold = _matching(store, table, where, line)
    t = line.t

    def image(df: DataFrame) -> DataFrame:
        new = [(column_of(assign[f.name]).cast(f.dataType) if f.name in assign else F.col(f"`{f.name}`")).alias(f.name) for f in table.schema]
        out = df.select(*new, F.col(TIER).alias("__was"))
        return out.select("*", pk_text(table.pk, table.schema).alias(PK), table.kind.to_long(F.col(table.tier_key)).alias(TIER))

    new_hot, new_cold = (image(x) if x is not None else None for x in (hot, cold))
    returned = _both(new_hot, new_cold, table.columns)
    for x in (new_hot, new_cold):
        if x is not None and table.tier_key in assign and x.filter(F.col(TIER).isNull()).take(1):
            raise RoutingError(f"{name}: a tier key would be null")
    below = F.lit(False) if table.mode.hot_complete else F.col(TIER) < t
    columns = [*table.columns, PK, TIER]
    fixes, gone, come = [], [], []
    if new_hot is not None:
        gone.append(new_hot.select(PK))
        come.append((new_hot if table.mode.keep_heap or table.mode.hot_complete else new_hot.filter(~below)).select(*columns))
        if not table.mode.hot_complete and table.tier_key in assign:
            fixes.append(corrections(new_hot.filter(below).select(*columns), UPSERT))
    if new_cold is not None:
        moved = F.when(F.col("__was") != F.col(TIER), F.col("__was"))
        fixes.append(corrections(new_cold.filter(below), UPSERT, moved).drop("__was"))
        if table.tier_key in assign:
            away = new_cold.filter(~below)
            fixes.append(corrections(away.withColumn(TIER, F.col("__was")).drop("__was"), TOMBSTONE))
            come.append(away.select(*columns))
        if table.mode.keep_heap:
            gone.append(new_cold.select(PK))
            come.append(new_cold.filter(below).select(*columns))
    delta_rows = _union(fixes)
    if delta_rows is not None and table.mode.delete(False).check_retention:
        check_retention(store, table, delta_rows)
    if come and table.tier_key in assign:
        check_partitions(store, table, _union(come))
    delta = store.stage_delta(table, delta_rows) if delta_rows is not None else []
    files = store.rewrite_hot(table, _union(gone), _union(come)) if gone or come and _union(come).take(1) else None
    publish(store, table, line, files, delta)
    return {"hot": new_hot.count() if new_hot is not None else 0, "delta": _total(delta)}, returned


@retried
def delete_where(store: Store, name: str, where: Condition = None) -> tuple[dict[str, int], DataFrame]:
    """DELETE FROM name WHERE: rows per place, and the old images of all deleted rows."""
    table = store.table(name)
    line = store.catalog.line(table.id)
    hot, cold = _matching(store, table, where, line)
    returned = _both(hot, cold, table.columns)
    if cold is not None and table.mode.delete(False).check_retention:
        check_retention(store, table, cold)
    delta = store.stage_delta(table, corrections(cold, TOMBSTONE)) if cold is not None else []
    gone = [x.select(PK) for x in (hot, cold if table.mode.keep_heap else None) if x is not None]
    files = store.rewrite_hot(table, _union(gone), None) if gone else None
    publish(store, table, line, files, delta)
    return {"hot": hot.count() if hot is not None else 0, "delta": _total(delta)}, returned


def _union(parts: list[DataFrame]) -> DataFrame | None:
    out = None
    for p in parts:
        out = p if out is None else out.unionByName(p)
    return out
