"""Lake maintenance, verification and status."""

from __future__ import annotations

import json
import time
from dataclasses import dataclass, fields, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ebbline.operators.store import Store
from ebbline.plans.modes import Kind
from ebbline.plans.seam import Keys
from ebbline.sources.catalog import SETS
from ebbline.sources.files import BUCKET, PK, SEQ, TIER, apply_deletes, list_files, read_files, remove_files, stage, stored_schema


@dataclass(frozen=True)
class Policy:
    """Defaults of a table's maintenance; a table's spec may override each."""

    small_rows: int = 1_000_000  # a file of fewer rows is small
    small_files: int = 8  # so many small files in all, and two of a bucket, before they are merged
    snapshot_age: float = 24 * 3600.0
    snapshots_kept: int = 5
    orphan_age: float | None = None  # seconds; None: no sweep
    deletes_ratio: float = 0.3
    deletes_files: int = 8

    @classmethod
    def of(cls, overrides: dict | None) -> Policy:
        unknown = set(overrides or {}) - {f.name for f in fields(cls)}
        if unknown:
            raise ValueError(f"no policy {', '.join(sorted(unknown))}")
        return replace(cls(), **(overrides or {}))


def _rewrite(store: Store, table, buckets: list[int], props: dict) -> int:
    """Rewrite all files of the buckets, deletes applied, as one snapshot. Rows get the snapshot's number."""
    files = [f for f in store.catalog.files(table.id, "lake") if f.bucket in buckets]
    seq = store.catalog.line(table.id).s + 1
    rows = apply_deletes(store.spark, files, table.schema, 200_000).withColumn(SEQ, F.lit(seq).cast("long"))
    add = stage(rows.select(*table.columns, PK, BUCKET, TIER, SEQ), store.folder(table, "lake"), "data")
    store.publish_lake(table, seq, add, files, props)
    return len(files)


def maintain(store: Store, name: str) -> dict[str, int]:
    """In this order: apply deletes, merge small files, expire snapshots, sweep orphans."""
    table = store.table(name)
    policy = Policy.of(table.spec.get("policy"))
    out = {"deletes": 0, "small": 0, "expired": 0, "orphans": 0}
    files = store.catalog.files(table.id, "lake")
    buckets = sorted({f.bucket for f in files if f.kind == "delete"})
    if buckets:
        out["deletes"] = _rewrite(store, table, buckets, {"maintenance": "deletes"})
    files = [f for f in store.catalog.files(table.id, "lake") if f.kind == "data" and f.rows < policy.small_rows]
    if len(files) >= policy.small_files:
        count: dict[int, int] = {}
        for f in files:
            count[f.bucket] = count.get(f.bucket, 0) + 1
        many = [b for b, n in count.items() if n >= 2]
        if many:
            out["small"] = _rewrite(store, table, many, {"maintenance": "small files"})
    out["expired"] = expire(store, name, policy)
    if policy.orphan_age is not None:
        out["orphans"] = sweep(store, name, policy.orphan_age)
    return out


def expire(store: Store, name: str, policy: Policy) -> int:
    """Forget snapshots beyond age and number, never one a pin reads, and delete the files only they had."""
    table = store.table(name)
    line, (_, pinned, _) = store.catalog.line(table.id), store.catalog.horizon(table.id)
    snapshots = store.catalog.snapshots(table.id)
    old = [seq for seq, at, _ in snapshots[: -policy.snapshots_kept or None] if at < time.time() - policy.snapshot_age and seq < line.s and (pinned is None or seq < pinned)]
    if not old:
        return 0
    first = min(seq for seq, _, _ in snapshots if seq not in old)
    pins = store.catalog.rows("SELECT min(hot) hot, min(delta) delta FROM pins WHERE table_id = ? AND expires > ?", table.id, time.time())[0]
    with store.catalog.transaction() as c:
        dead = []
        for part in SETS:
            floor = first if part == "lake" else min(x for x in (getattr(line, part), pins[part]) if x is not None)
            dead += c.execute("SELECT id, path FROM files WHERE table_id = ? AND part = ? AND removed <= ?", (table.id, part, floor)).fetchall()
        c.executemany("DELETE FROM files WHERE id = ?", [(d["id"],) for d in dead])
        c.executemany("DELETE FROM snapshots WHERE table_id = ? AND seq = ?", [(table.id, s) for s in old])
    shared = {r["path"] for r in store.catalog.rows("SELECT path FROM files")}  # a clone may still read them
    remove_files(store.spark, [d["path"] for d in dead if d["path"] not in shared])
    return len(old)


def sweep(store: Store, name: str, age: float) -> int:
    """Delete files that no manifest and no staged load knows and that are older than `age` seconds."""
    table = store.table(name)
    known = {r["path"] for r in store.catalog.rows("SELECT path FROM files WHERE table_id = ?", table.id)}
    staged = " ".join(r["staged"] for r in store.catalog.staged_labels(table.id))
    tail = lambda p: p.rsplit("/", 3)[-3:]
    names = {"/".join(tail(p)) for p in known}
    gone = [p for part in SETS for p, at in list_files(store.spark, store.folder(table, part)) if at < time.time() - age and "/".join(tail(p)) not in names and p.rsplit("/", 1)[1] not in staged]
    return remove_files(store.spark, gone)


# Verification


def checksum(rows: DataFrame, tier: str = TIER, pk: str = PK) -> DataFrame:
    """One row that doesn't depend on the order: number, least and greatest tier key, sum of crc32 of the key texts."""
    return rows.agg(F.count("*").alias("n"), F.min(tier).alias("low"), F.max(tier).alias("high"), F.coalesce(F.sum(F.crc32(F.col(pk).cast("binary"))), F.lit(0)).alias("crc"))


def verify(store: Store, name: str) -> dict:
    """Compare what must agree: a mirrored table's hot set and lake, a kept heap's old rows and the cold view, a tiered
    table's lake with itself through its manifests."""
    table = store.table(name)
    seam, line = store.seam(table), store.catalog.line(table.id)
    if table.mode.kind is Kind.MIRRORED and not table.mode.heap_retention:
        a, b = seam.hot(), seam.lake(live=True)
    elif table.mode.keep_heap:
        a, b = seam.hot().filter(F.col(TIER) < line.t), store.prepared(table, seam.cold())
    else:
        lake = seam.lake(live=True)
        files = [f for f in store.catalog.files(table.id, "lake") if f.kind == "data"]
        deletes = any(f.kind == "delete" for f in store.catalog.files(table.id, "lake"))
        listed = sum(f.rows for f in files)
        got = checksum(lake).first()
        twice = lake.groupBy(PK).count().filter("count > 1").count()
        # Hot files that the last tiering didn't know must hold nothing below the cut-line but what the lake has too.
        known = max((json.loads(o["details"]).get("hot", -1) for o in store.catalog.rows("SELECT details FROM ops WHERE table_id = ? AND kind = 'tier' AND phase = 'done'", table.id)), default=-1)
        late = [f for f in store.catalog.files(table.id, "hot") if f.added > known and f.low is not None and f.low < line.t]
        stranded = read_files(store.spark, late, stored_schema(table.schema)).filter(F.col(TIER) < line.t).select(PK)
        stranded = stranded.join(lake.select(PK), PK, "left_anti").join(seam.corrections().select(PK), PK, "left_anti").count() if late else 0
        return {"ok": not twice and not stranded and (deletes or got.n == listed), "rows": got.n, "listed": listed, "repeated": twice, "untiered": stranded}
    left, right = (checksum(x).first().asDict() for x in (a, b))
    return {"ok": left == right, "hot": left, "lake": right}


# Status


def status(store: Store) -> DataFrame:
    """One row per table: lines, rows and files of each set, corrections waiting, pins, labels, partitions by state."""
    rows, now = [], time.time()
    for name in store.catalog.names():
        table = store.table(name)
        line = store.catalog.line(table.id)
        files = {p: store.catalog.files(table.id, p) for p in SETS}
        states: dict[str, int] = {}
        for p in store.catalog.partitions(table.id):
            states[p.state] = states.get(p.state, 0) + 1
        policy = Policy.of(table.spec.get("policy"))
        deletes, data = sum(f.rows for f in files["lake"] if f.kind == "delete"), [f for f in files["lake"] if f.kind == "data"]
        n = sum(f.rows for f in data)
        waiting = sum(f.rows for f in files["delta"])
        level = table.spec.get("delta_warn", 100_000)
        warnings = ["deletes"] * (len(data) >= policy.deletes_files and deletes >= policy.deletes_ratio * max(n, 1)) + ["backlog error" if waiting >= 4 * level else "backlog"] * (waiting >= level)
        pins = store.catalog.horizon(table.id)[2]
        labels = store.catalog.staged_labels(table.id)
        rows.append((name, str(table.mode), line.t, line.s, line.f, line.r, sum(f.rows for f in files["hot"]), n, deletes, waiting, len(data), pins, len(labels), (now - min(x["at"] for x in labels)) if labels else None, states, warnings))
    schema = "name string, mode string, t long, s long, f long, r long, hot_rows long, lake_rows long, lake_deletes long, corrections long, lake_files long, pins long, staged_loads long, oldest_staged_s double, partitions map<string,long>, warnings array<string>"
    return store.spark.createDataFrame(rows, schema)


def state_totals(store: Store) -> DataFrame:
    """How many partitions of all tables are in each state: the status's maps, expanded and summed up."""
    return status(store).select(F.explode("partitions").alias("state", "n")).groupBy("state").agg(F.sum("n").alias("n"))


def holds(store: Store, name: str, low: int, high: int) -> bool:
    """Whether the lake may hold a row with a tier key in [low, high): from the manifests, without a job."""
    table = store.table(name)
    return any(f.kind == "data" and Keys(low, high).meets(f) for f in store.catalog.files(table.id, "lake"))
