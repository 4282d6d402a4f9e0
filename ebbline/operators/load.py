"""Bulk ingest, labelled loads, CSV and JSON-lines sources, initial copy."""

from __future__ import annotations

import json
from dataclasses import asdict

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ebbline.operators.dml import _lake_places, check_retention, corrections, insert, lake_merge, retried
from ebbline.operators.store import RoutingError, Store
from ebbline.plans.modes import Kind
from ebbline.sources.catalog import CatalogError, Conflict, FileEntry
from ebbline.sources.files import PK, TIER, read_files, stored_schema

#: Commits of one call of an initial copy.
COMMITS = 16
#: Keys that an initial copy brings to the driver at once to cut the rest of the table.
SAMPLE = 16_000


def read_jsonl(store: Store, name: str, path: str) -> DataFrame:
    """JSON lines in the table's schema: an object a line, blank lines skipped, scalars only; anything else is an error."""
    table = store.table(name)
    lines = store.spark.read.text(path).filter(F.trim("value") != "")
    value = F.try_parse_json("value")
    shape = F.schema_of_variant(value)
    if bad := lines.filter(value.isNull() | ~shape.startswith("OBJECT<") | F.substring(shape, 8, 1 << 30).rlike("OBJECT<|ARRAY<")).take(1):
        raise RoutingError(f"not an object of scalars: {bad[0][0][:200]}")
    names = lines.select(F.explode(F.json_object_keys("value")).alias("k")).distinct().filter(~F.col("k").isin(table.columns)).take(1)
    if names:
        raise RoutingError(f"{name} has no column {names[0][0]}")
    return lines.select(F.from_json("value", table.schema, {"mode": "FAILFAST"}).alias("r")).select("r.*")


def copy_from(store: Store, name: str, path: str, **options) -> dict[str, int]:
    """COPY FROM a CSV: rows are routed one by one as by an insert."""
    table = store.table(name)
    return insert(store, name, store.spark.read.schema(table.schema).options(header=True, mode="FAILFAST", **options).csv(path))


def ingest(store: Store, name: str, rows: DataFrame | list[str]) -> dict[str, int]:
    """Bring rows, or Parquet files, into the lake as one snapshot: append, or replace by key where keys overlap.

    All rows must lie between the retention line and the cut-line. Files that one bucket of a truncating layout doesn't
    hold are rejected. Only the snapshot number moves. Keys must be unique.
    """
    table = store.table(name)
    if isinstance(rows, list):
        read = store.spark.read.parquet(*rows)
        key = table.kind.to_long(F.col(table.tier_key))
        for f in read.groupBy(F.col("_metadata.file_path").alias("path")).agg(F.min(key).alias("low"), F.max(key).alias("high")).collect():
            if f.low is not None and not table.layout.one_bucket(f.low, f.high):
                raise RoutingError(f"{f.path} lies in several buckets")
        rows = read
    with store.validated(table, rows) as valid:
        return _ingest(store, table, valid)


@retried
def _ingest(store: Store, table: Table, rows: DataFrame) -> dict[str, int]:
    line = store.catalog.line(table.id)
    _window(rows, line.r, line.t, table.name)
    reach = rows.agg(F.min(TIER), F.max(TIER), F.count("*")).first()
    if not reach[2]:
        return {"rows": 0, "replaced": 0}
    files = [f for f in store.catalog.files(table.id, "lake") if f.kind == "data"]
    # Without a row at these tier keys in the lake nothing can be replaced in place; moved keys lie elsewhere.
    places = _lake_places(store, table, rows) if files else None
    replaced = places.count() if places is not None else 0
    lake_merge(store, table, rows, places if replaced else None, {"ingest": reach[2]})
    return {"rows": reach[2], "replaced": replaced}


def _window(rows: DataFrame, low: int | None, high: int, name: str) -> None:
    if rows.filter((F.col(TIER) >= high) | (F.lit(False) if low is None else F.col(TIER) < low)).take(1):
        raise RoutingError(f"{name}: rows outside of [{low}, {high})")


def load(store: Store, name: str, label: str, rows: DataFrame, spool_above: int = 1000) -> dict:
    """Load a batch once under its label: hot rows are upserted, cold ones become corrections, or staged lake files if
    there are more than spool_above. A label that is there already changes nothing and returns what it did.
    """
    table = store.table(name)
    if done := store.catalog.label(table.id, label):
        return {"label": label, "replayed": True, "hot": done["hot"], "cold": done["cold"]}
    with store.validated(table, rows) as valid:
        out = _load(store, table, label, valid, spool_above)
    return out or load(store, name, label, rows, spool_above)  # another load took the label meanwhile


@retried
def _load(store: Store, table: Table, label: str, rows: DataFrame, spool_above: int) -> dict | None:
    t = store.catalog.line(table.id).t
    files: tuple[list[FileEntry], list[FileEntry]] = ([], [])
    if table.mode.hot_complete:
        hot, cold, n_cold = rows, rows.limit(0), 0
    else:
        hot, cold = rows.filter(F.col(TIER) >= t), rows.filter(F.col(TIER) < t)
        n_cold = cold.count()
    if n_cold and table.mode.kind is Kind.DIRECT:
        raise RoutingError(f"{table.name}: a direct table loads no rows below the cut-line")
    if n_cold and table.mode.insert(False).check_retention:
        check_retention(store, table, cold)
    n_hot = hot.count()
    staged, delta = [], []
    if n_cold > spool_above:
        staged = store.stage_lake(table, cold, store.catalog.line(table.id).s + 1)
    elif n_cold:
        delta = store.stage_delta(table, corrections(cold, 0))
    into_hot = rows if table.mode.keep_heap else hot
    files = store.rewrite_hot(table, into_hot, into_hot) if n_hot or table.mode.keep_heap and n_cold else ([], [])
    try:
        with store.catalog.transaction():
            if store.catalog.line(table.id).t != t:
                raise Conflict(f"{table.name}: the cut-line moved")
            if not store.catalog.claim_label(table.id, label, n_hot, n_cold, "staged" if staged else "done", [asdict(f) for f in staged]):
                store.discard([*staged, *delta, *files[0]])
                return None
            if files[0] or files[1]:
                store.catalog.publish(table.id, "hot", *files)
            if delta:
                store.catalog.publish(table.id, "delta", delta)
    except CatalogError:
        store.discard([*staged, *delta, *files[0]])
        raise
    return {"label": label, "replayed": False, "hot": n_hot, "cold": n_cold}


def adopt_loads(store: Store, name: str) -> int:
    """Commit all staged loads as one snapshot, the last load of a key winning; how many loads."""
    table = store.table(name)
    labels = store.catalog.staged_labels(table.id)
    if not labels:
        return 0
    spark, parts = store.spark, None
    for i, row in enumerate(labels):
        files = [FileEntry(**f) for f in json.loads(row["staged"])]
        rows = read_files(spark, files, stored_schema(table.schema)).select(*table.columns, PK, TIER, F.lit(i).alias("__load"))
        parts = rows if parts is None else parts.unionByName(rows)
    last = parts.groupBy(PK).agg(F.max_by(F.struct(*table.columns, TIER), "__load").alias("r")).select("r.*", PK)
    places = _lake_places(store, table, last)
    seq = store.catalog.line(table.id).s + 1
    add = store.stage_deletes(table, places, seq) + store.stage_lake(table, last, seq)
    with store.catalog.transaction() as c:
        store.publish_lake(table, seq, add, props={"loads": [r["label"] for r in labels]})
        c.executemany("UPDATE labels SET state = 'done', staged = NULL WHERE table_id = ? AND label = ?", [(table.id, r["label"]) for r in labels])
    return len(labels)


def initial_copy(store: Store, name: str, chunk_rows: int = 50_000, max_chunks: int | None = None) -> dict:
    """Copy a mirrored table's hot rows into the lake in chunks of the primary key's order, from where the journal is.

    A call makes at most COMMITS commits of as many chunks each as that takes, and notes each in the journal. As every commit
    reads the hot rows once, the copy costs in proportion to the table however small its chunks are.
    """
    table = store.table(name)
    row = store.catalog.one("SELECT * FROM copies WHERE table_id = ?", table.id)
    after, copied = (row["last_pk"], row["rows"]) if row else (None, 0)
    if row and row["done"]:
        return {"rows": copied, "chunks": 0, "done": True}
    hot = store.seam(table).hot().select(*table.columns, PK, TIER)
    rest = hot if after is None else hot.filter(F.col(PK) > after)
    n = rest.count()
    chunks = max(1, -(-n // chunk_rows))
    wanted = chunks if max_chunks is None else min(chunks, max(1, max_chunks))
    step = -(-wanted // COMMITS)
    ends = [min(i + step, wanted) for i in range(0, wanted, step)]
    bounds = _bounds(rest, n, [end * chunk_rows for end in ends if end < chunks])
    if wanted == chunks:
        bounds.append(None)
    done = 0
    for end, high in zip(ends, bounds, strict=True):
        part = rest if high is None else rest.filter(F.col(PK) <= high)
        part = part if after is None else part.filter(F.col(PK) > after)
        seq = store.catalog.line(table.id).s + 1
        files = store.stage_lake(table, part, seq)
        copied += sum(f.rows for f in files)
        after, last = high, high is None
        with store.catalog.transaction() as c:
            if files:
                store.publish_lake(table, seq, files, props={"copy": done, "chunks": end - done})
            c.execute("INSERT INTO copies VALUES (?, ?, ?, ?) ON CONFLICT(table_id) DO UPDATE SET last_pk = excluded.last_pk, rows = excluded.rows, done = excluded.done", (table.id, high, copied, int(last)))
        done = end
    return {"rows": copied, "chunks": done, "done": last}


def _bounds(rows: DataFrame, n: int, places: list[int]) -> list[str]:
    """The keys at about these places, ascending, among n rows in the keys' order; found on hash samples of SAMPLE keys.

    Rows far beyond the last place are left out and the others sampled anew, so that early places are met as well.
    """
    while places:
        keys = sorted(k[0] for k in rows.select(PK).orderBy(F.xxhash64(PK), PK).limit(SAMPLE).collect())
        reach = 2 * len(keys) * places[-1] // n + 100
        if n <= SAMPLE or 2 * reach >= len(keys):
            return [keys[max(1, min(len(keys) * p // n, len(keys))) - 1] for p in places]
        rows = rows.filter(F.col(PK) <= keys[reach])
        n = rows.count()
    return []


def schema_of(fields: str | T.StructType) -> T.StructType:
    return fields if isinstance(fields, T.StructType) else T.StructType.fromDDL(fields)


