"""Registered queries over sources, SQL writes, concurrent ageing and upkeep, with the same results in SQL.

They work like those of `queries`: on clones of the tables set up there, or on tables of their own.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ebbline import queries as base
from ebbline.engine import Engine
from ebbline.operators import maintain
from ebbline.queries import _clone, _read, _root, _state, _tiered, engine

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

_EVENTS = "event_id, ts, user_id, event_type, value, props"
_PLAIN = "SELECT event_id, ts, event_type, value FROM events"
_MICROS = 86_400_000_000
#: Text files keep microseconds.
_TEXT = {"timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}


def _query(oracle: str):
    def keep(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = oracle.replace("{seam}", base._SEAM).replace("{cut}", base.CUT)
        return f

    return keep


def _kept(spark: SparkSession, df: DataFrame) -> DataFrame:
    """The rows as they are now, whatever happens to their table later."""
    path = f"{_root(spark)}/kept"
    df.write.parquet(path)
    return spark.read.parquet(path)


def _raw(spark: SparkSession, sf_dir: str, name: str = "events") -> str:
    view = f"ebbline_raw_{name}"
    _read(spark, sf_dir, name).createOrReplaceTempView(view)
    return view


def _shifted(spark: SparkSession, sf_dir: str, by: int) -> DataFrame:
    return _read(spark, sf_dir, "events").withColumn("event_id", F.col("event_id") + by)


def _mirrored_orders(spark: SparkSession, sf_dir: str) -> tuple[Engine, str]:
    e, q = engine(spark, sf_dir), f"q{next(base._SERIAL)}"
    orders = _read(spark, sf_dir, "orders")
    e.register(q, orders.schema, ["o_orderkey"], "o_orderdate", "mirrored", layout="year")
    e.insert(q, orders)
    return e, q


# Sources


@_query("SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority FROM orders")
def heap_scan(spark, sf_dir):
    """A mirrored table is read from its hot set alone."""
    e, q = _mirrored_orders(spark, sf_dir)
    return e.read(q)


@_query("SELECT o_orderkey, o_custkey, o_orderdate FROM orders")
def initial_copy_lake(spark, sf_dir):
    """The lake after a copy in chunks of the key's order that was stopped and went on."""
    e, q = _mirrored_orders(spark, sf_dir)
    e.initial_copy(q, chunk_rows=4000, max_chunks=1)
    while not e.initial_copy(q, chunk_rows=4000)["done"]:
        pass
    return e.seam(q).lake(live=True).select("o_orderkey", "o_custkey", "o_orderdate")


@_query(f"{_PLAIN} UNION ALL SELECT event_id + 30000000, ts, event_type, value FROM events")
def copy_csv(spark, sf_dir):
    e, q = _clone(spark, sf_dir, "events_plain")
    path = f"{_root(spark)}/csv"
    _shifted(spark, sf_dir, 30_000_000).write.options(header=True, **_TEXT).csv(path)
    e.copy_from(q, path)
    return _state(e.read(q))


@_query(f"{_PLAIN} UNION ALL SELECT event_id + 31000000, ts, event_type, value FROM events")
def load_jsonl(spark, sf_dir):
    """A labelled load of JSON lines, twice: the second changes nothing."""
    e, q = _clone(spark, sf_dir, "events_plain")
    path = f"{_root(spark)}/json"
    _shifted(spark, sf_dir, 31_000_000).write.options(**_TEXT).json(path)
    e.load_jsonl(q, "one", path)
    assert e.load_jsonl(q, "one", path)["replayed"]
    e.adopt_loads(q)
    return _state(e.read(q))


@_query(f"{_PLAIN} UNION ALL SELECT event_id + 32000000, ts, event_type, value FROM events WHERE ts < TIMESTAMP '{{cut}}'")
def ingest_jsonl(spark, sf_dir):
    e, q = _clone(spark, sf_dir, "events_plain")
    path = f"{_root(spark)}/json"
    _shifted(spark, sf_dir, 32_000_000).filter(F.col("ts") < F.lit(base.CUT).cast("timestamp_ntz")).write.options(**_TEXT).json(path)
    e.ingest_jsonl(q, path)
    return _state(e.read(q))


@_query(f"{_PLAIN} UNION ALL SELECT event_id + 33000000, ts, event_type, value FROM events WHERE ts >= TIMESTAMP '2024-01-02' AND ts < TIMESTAMP '2024-01-04'")
def ingest_parquet(spark, sf_dir):
    """Parquet files, each of one bucket, become lake rows."""
    e, q = _clone(spark, sf_dir, "events_plain")
    paths = [f"{_root(spark)}/{d}" for d in (2, 3)]
    for d, path in zip((2, 3), paths, strict=True):
        _shifted(spark, sf_dir, 33_000_000).filter(f"ts >= timestamp_ntz'2024-01-0{d}' AND ts < timestamp_ntz'2024-01-0{d + 1}'").write.parquet(path)
    e.ingest(q, paths)
    return _state(e.read(q))


@_query("SELECT 'a' AS label, count(*) FILTER (WHERE ts >= TIMESTAMP '{cut}') AS hot, count(*) FILTER (WHERE ts < TIMESTAMP '{cut}') AS cold FROM events WHERE user_id % 2 = 0 UNION ALL SELECT 'b', count(*) FILTER (WHERE ts >= TIMESTAMP '{cut}'), count(*) FILTER (WHERE ts < TIMESTAMP '{cut}') FROM events WHERE user_id % 2 = 1")
def staged_labels(spark, sf_dir):
    """The ledger of loads that wait for adoption, oldest first."""
    e, q = _clone(spark, sf_dir, "events_plain")
    for i, label in enumerate("ab"):
        e.load(q, label, _shifted(spark, sf_dir, 34_000_000).filter(f"user_id % 2 = {i}"), spool_above=0)
    got = [(r["label"], r["hot"], r["cold"]) for r in e.store.catalog.staged_labels(e.store.table(q).id)]
    assert [x[0] for x in got] == ["a", "b"] and e.adopt_loads(q) == 2
    return spark.createDataFrame(got, "label string, hot long, cold long")


# SQL writes


@_query("WITH {seam} SELECT event_id, ts, event_type, value FROM seam UNION ALL SELECT event_id + 70000000, ts, NULL, value FROM events")
def insert_column_list(spark, sf_dir):
    """Columns in the statement's order; those it leaves out are null."""
    e, q = _clone(spark, sf_dir)
    e.sql(f"INSERT INTO {q} (value, event_id, ts) SELECT value, event_id + 70000000, ts FROM {_raw(spark, sf_dir)}")
    return _state(e.read(q))


@_query("WITH {seam} SELECT event_id, ts, event_type, value FROM seam UNION ALL SELECT event_id + 70000000, ts, event_type, value FROM events WHERE value > 10")
def insert_with_cte(spark, sf_dir):
    e, q = _clone(spark, sf_dir)
    e.sql(f"INSERT INTO {q} WITH selections AS (SELECT * FROM {_raw(spark, sf_dir)} WHERE value > 10) SELECT event_id + 70000000, ts, user_id, event_type, value, props FROM selections")
    return _state(e.read(q))


@_query("WITH {seam} SELECT event_id, ts, event_type, value FROM seam UNION ALL SELECT * FROM (VALUES (90000001, TIMESTAMP '2024-01-05 00:00:00', 'x', 1.5), (90000002, TIMESTAMP '2024-01-29 00:00:00', NULL, NULL))")
def insert_values(spark, sf_dir):
    e, q = _clone(spark, sf_dir)
    e.sql(f"INSERT INTO {q} (event_id, ts, event_type, value) VALUES (90000001, timestamp_ntz'2024-01-05', 'x', 1.5D), (90000002, timestamp_ntz'2024-01-29', null, null)")
    return _state(e.read(q))


@_query("WITH {seam} SELECT event_id, ts, event_type, CASE WHEN user_id IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0) THEN 0.0 ELSE value END AS value FROM seam")
def update_in_subquery(spark, sf_dir):
    e, q = _clone(spark, sf_dir)
    e.sql(f"UPDATE {q} SET value = 0.0D WHERE user_id IN (SELECT c_custkey FROM {_raw(spark, sf_dir, 'customer')} WHERE c_acctbal < 0)")
    return _state(e.read(q))


@_query("WITH {seam} SELECT event_id, ts, event_type, CASE WHEN event_type = 'click' THEN (SELECT max(value) FROM events) ELSE value END AS value FROM seam")
def update_scalar_subquery(spark, sf_dir):
    e, q = _clone(spark, sf_dir)
    e.sql(f"UPDATE {q} SET value = (SELECT max(value) FROM {_raw(spark, sf_dir)}) WHERE event_type = 'click'")
    return _state(e.read(q))


@_query("WITH {seam} SELECT event_id, ts, event_type, value FROM seam WHERE event_id NOT IN (SELECT max(event_id) FROM events GROUP BY user_id)")
def delete_in_subquery(spark, sf_dir):
    e, q = _clone(spark, sf_dir)
    e.sql(f"DELETE FROM {q} WHERE event_id IN (SELECT max(event_id) FROM {_raw(spark, sf_dir)} GROUP BY user_id)")
    return _state(e.read(q))


@_query("WITH {seam} SELECT event_id, ts, event_type, value FROM seam WHERE event_id NOT BETWEEN 100 AND 399")
def delete_by_keys(spark, sf_dir):
    """Keys as JSON has them: scalars and objects."""
    e, q = _clone(spark, sf_dir)
    e.delete_keys(q, [k if k % 2 else {"event_id": k} for k in range(100, 400)])
    return _state(e.read(q))


@_query("WITH {seam} SELECT 0::BIGINT AS rest, count(*) AS gone, sum(event_id)::BIGINT AS ids FROM seam")
def delete_all_returning(spark, sf_dir):
    """Everything goes, and comes back as the deleted images."""
    e, q = _clone(spark, sf_dir)
    gone = e.delete_where(q)[1].agg(F.count("*").alias("gone"), F.sum("event_id").alias("ids"))
    return e.read(q).agg(F.count("*").alias("rest")).crossJoin(gone)  # one row each


# Ageing while others write


@_query(f"{_PLAIN} UNION ALL SELECT event_id + 40000000, ts, event_type, value FROM events WHERE ts < TIMESTAMP '2024-01-21'")
def insert_during_tiering(spark, sf_dir):
    """Rows inserted below the line to come, after the tiering has read the partitions and before it commits."""
    e, q = engine(spark, sf_dir), f"q{next(base._SERIAL)}"
    events = _read(spark, sf_dir, "events")
    e.register(q, events.schema, ["event_id"], "ts", width="1d", lag="9d", cut="2024-01-01")
    e.insert(q, events)
    e.add_partitions(q, [(f"2024-01-{d:02d}", f"2024-01-{d + 1:02d}") for d in range(1, 31)])
    late = _shifted(spark, sf_dir, 40_000_000).filter("ts < timestamp_ntz'2024-01-21'")
    other, stage = Engine(spark, e.store.root, e.store.catalog.path), e.store.stage_lake
    calls = []

    def slow(*args):
        out = stage(*args)
        if not calls:
            calls.append(1)
            other.insert(q, late)
        return out

    e.store.stage_lake = slow
    try:
        e.tier(q)
    finally:
        e.store.stage_lake = stage
    assert calls and e.verify(q)["ok"]
    return _state(e.read(q))


@_query("WITH {seam} SELECT event_id, CASE WHEN event_id % 40 = 7 AND ts < TIMESTAMP '2024-01-10' AND event_id < 10000000 THEN ts + INTERVAL 5 DAY ELSE ts END AS ts, event_type, value FROM seam")
def upsert_moves_then_fold(spark, sf_dir):
    """Upserts that bring lake rows to another day below the line; the fold keeps one row of each key."""
    e, q = _clone(spark, sf_dir)
    rows = _kept(spark, e.read(q).filter("event_id % 40 = 7 AND ts < timestamp_ntz'2024-01-10' AND event_id < 10000000"))
    e.upsert(q, rows.withColumn("ts", F.expr("ts + INTERVAL 5 DAYS")))
    while e.compact(q, 10_000_000):
        pass
    return _state(e.read(q))


@_query(f"WITH d AS (SELECT unnest(generate_series(TIMESTAMP '2024-01-01', (SELECT date_trunc('day', max(ts)) + INTERVAL 2 DAY FROM events), INTERVAL 1 DAY)) AS lo) SELECT epoch_us(lo) AS lo, epoch_us(lo) + {_MICROS} AS hi, CASE WHEN epoch_us(lo) + {_MICROS} <= (SELECT epoch_us(max(ts)) FROM events) - 9 * {_MICROS} THEN 'dropped' ELSE 'hot' END AS state FROM d")
def premade_partitions(spark, sf_dir):
    """Partitions after tiering, with two days ahead of the newest row."""
    e, q = _tiered(spark, sf_dir)
    e.premake(q, 2)
    return e.partitions(q).select("lo", "hi", "state")


@_query(f"WITH d AS (SELECT unnest(generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-30', INTERVAL 1 DAY)) AS lo) SELECT CASE WHEN epoch_us(lo) + {_MICROS} <= (SELECT epoch_us(max(ts)) FROM events) - 9 * {_MICROS} THEN 'dropped' ELSE 'hot' END AS state, 2 * count(*) AS n FROM d GROUP BY 1")
def partition_state_totals(spark, sf_dir):
    """The states of the partitions of two tables, expanded from the status and summed up."""
    e, events = Engine(spark, _root(spark)), _read(spark, sf_dir, "events")
    for name in ("one", "two"):
        e.register(name, events.schema, ["event_id"], "ts", width="1d", lag="9d", cut="2024-01-01")
        e.insert(name, events)
        e.add_partitions(name, [(f"2024-01-{d:02d}", f"2024-01-{d + 1:02d}") for d in range(1, 31)])
        e.tier(name)
    return maintain.state_totals(e.store)


# Reads and upkeep


@_query("WITH {seam} SELECT event_id, ts, event_type, value FROM seam WHERE ts >= TIMESTAMP '2024-01-03' AND ts < TIMESTAMP '2024-01-04'")
def pruned_read(spark, sf_dir):
    """A day of the lake: the files of other days aren't even listed."""
    e = engine(spark, sf_dir)
    where = "ts >= '2024-01-03' AND ts < '2024-01-04'"
    table = e.store.table("events")
    from ebbline.operators import dml

    seam, side = dml.seam_for(e.store, table, where)
    assert side.value == "cold" and {f.bucket for f in seam._files("lake", seam.line.s, seam._between(None, None))} <= {1704240000000000}
    return _state(e.read("events", where))


@_query("SELECT event_id, value FROM events")
def token_read(spark, sf_dir):
    """A pinned read handed on as text doesn't see what is written meanwhile."""
    e, q = _clone(spark, sf_dir, "events_plain")
    with e.pinned(q) as seam:
        token = e.token(seam)
        e.update(q, {"value": "-1.0"}, "event_id % 2 = 0")
        e.delete_where(q, "event_id % 3 = 0")
        return _kept(spark, e.from_token(token).view().select("event_id", "value"))


@_query("SELECT event_id, CASE WHEN event_id % 2 = 0 THEN -1.0 ELSE value END AS value FROM events WHERE event_id % 3 <> 0")
def upkeep_keeps_rows(spark, sf_dir):
    """Folded, small files merged, snapshots expired, orphans swept: the same rows from fewer files."""
    e, q = _clone(spark, sf_dir, "events_plain")
    e.set_policy(q, small_files=2, snapshot_age=0.0, snapshots_kept=1, deletes_files=1, deletes_ratio=0.0)
    e.update(q, {"value": "-1.0"}, "event_id % 2 = 0")
    while e.compact(q, 10_000_000):
        pass
    e.delete_where(q, "event_id % 3 = 0")
    while e.compact(q, 10_000_000):
        pass
    table = e.store.table(q)
    before = len(e.store.catalog.snapshots(table.id))
    e.maintain(q)
    assert len(e.store.catalog.snapshots(table.id)) < before and e.verify(q)["ok"]
    return e.read(q).select("event_id", "value")


@_query("SELECT true AS ok, count(*) FILTER (WHERE ts < TIMESTAMP '2024-01-21') AS rows, 0::BIGINT AS repeated, 0::BIGINT AS untiered FROM events")
def verify_after_tiering(spark, sf_dir):
    e, q = _tiered(spark, sf_dir)
    got = e.verify(q)
    return spark.createDataFrame([(got["ok"], got["rows"], got["repeated"], got["untiered"])], "ok boolean, rows long, repeated long, untiered long")


@_query("WITH o AS (SELECT *, ts < TIMESTAMP '{cut}' AS old FROM events) SELECT 'tiered' AS mode, epoch_us(TIMESTAMP '{cut}') AS t, count(*) FILTER (WHERE NOT old) AS hot_rows, count(*) FILTER (WHERE old) AS lake_rows, 0::BIGINT AS lake_deletes, count(*) FILTER (WHERE old AND event_id % 97 = 0) + count(*) FILTER (WHERE event_id % 500 = 0) + count(*) FILTER (WHERE old AND event_id % 101 = 0) AS corrections, 1::BIGINT AS pins, 0::BIGINT AS staged_loads FROM o")
def status_of_corrected(spark, sf_dir):
    e, q = _clone(spark, sf_dir)
    with e.pinned(q):
        return _kept(spark, e.status().filter(F.col("name") == q).select("mode", "t", "hot_rows", "lake_rows", "lake_deletes", "corrections", "pins", "staged_loads"))
