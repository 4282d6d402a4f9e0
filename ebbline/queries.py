"""Registered queries over `events` and `orders` as ageing tables, with the same results in SQL.

The tables are set up once per session and input: rows from a fixed cut-line on are hot, older ones are in the lake, and
fixed corrections lie over them. Queries that write work on a clone, which shares the files.
"""

from __future__ import annotations

import itertools
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ebbline.engine import Engine
from ebbline.functions import codec
from ebbline.functions.codec import TierKind, floor_to, pk_text
from ebbline.operators import maintain
from ebbline.plans.seam import newest
from ebbline.sources.files import PK, TIER

CUT = "2024-01-21 00:00:00"
ORDERS_CUT = "1999-01-01 00:00:00"
_ENGINES: dict[tuple[str, str], Engine] = {}
_SERIAL = itertools.count()


def _root(spark: SparkSession) -> str:
    base = spark.conf.get("spark.checkpoint.dir", None) or tempfile.gettempdir()
    return f"{base.rstrip('/')}/ebbline-{uuid.uuid4().hex}"


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def engine(spark: SparkSession, sf_dir: str) -> Engine:
    """Both tables of an input, set up once."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _ENGINES:
        e = Engine(spark, _root(spark))
        events = _read(spark, sf_dir, "events")
        e.register("events", events.schema, ["event_id"], "ts", width="1d", cut=CUT)
        old = F.col("ts") < F.lit(CUT).cast("timestamp_ntz")
        e.insert("events", events.filter(~old))
        e.ingest("events", events.filter(old))
        e.clone("events", "events_plain")
        fixes = events.filter(old & (F.col("event_id") % 97 == 0)).withColumn("value", F.col("value") * 2)
        late = events.filter(F.col("event_id") % 500 == 0).withColumn("event_id", F.col("event_id") + 10_000_000).withColumn("ts", F.expr("ts - INTERVAL 40 DAYS"))
        e.upsert("events", fixes.unionByName(late))
        e.delete("events", events.filter(old & (F.col("event_id") % 101 == 0)).select("event_id", "ts"))
        orders = _read(spark, sf_dir, "orders")
        e.register("orders", orders.schema, ["o_orderkey"], "o_orderdate", layout="year", cut=ORDERS_CUT)
        old = F.col("o_orderdate") < F.lit(ORDERS_CUT).cast("timestamp_ntz")
        e.insert("orders", orders.filter(~old))
        e.ingest("orders", orders.filter(old))
        e.delete("orders", orders.filter(old & (F.col("o_orderkey") % 50 == 0)).select("o_orderkey", "o_orderdate"))
        _ENGINES[key] = e
    return _ENGINES[key]


def _clone(spark: SparkSession, sf_dir: str, name: str = "events") -> tuple[Engine, str]:
    e, new = engine(spark, sf_dir), f"q{next(_SERIAL)}"
    e.clone(name, new)
    return e, new


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: The corrected table, in SQL.
_SEAM = f"""seam AS (
  SELECT * FROM events WHERE ts >= TIMESTAMP '{CUT}'
  UNION ALL SELECT event_id, ts, user_id, event_type, CASE WHEN event_id % 97 = 0 THEN value * 2 ELSE value END, props FROM events WHERE ts < TIMESTAMP '{CUT}' AND event_id % 101 <> 0
  UNION ALL SELECT event_id + 10000000, ts - INTERVAL 40 DAY, user_id, event_type, value, props FROM events WHERE event_id % 500 = 0)"""
_ORDERS = f"live AS (SELECT * FROM orders WHERE o_orderdate >= TIMESTAMP '{ORDERS_CUT}' OR o_orderkey % 50 <> 0)"


def _query(oracle: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle.replace("{seam}", _SEAM).replace("{live}", _ORDERS).replace("{cut}", CUT)
        return f

    return keep


def _cents(c: str):
    return F.sum(F.round(F.col(c) * 100).cast("long"))


_CENTS = "sum(round(value * 100)::BIGINT)::BIGINT"


# Reads


@_query("WITH {seam} SELECT event_id, ts, user_id, event_type, value, props FROM seam")
def seam_scan(spark, sf_dir):
    return engine(spark, sf_dir).read("events")


@_query(f"WITH {{seam}} SELECT event_type, count(*) AS n, {_CENTS} AS cents, min(event_id) AS low, max(event_id) AS high FROM seam GROUP BY event_type")
def seam_agg_by_type(spark, sf_dir):
    return engine(spark, sf_dir).read("events").groupBy("event_type").agg(F.count("*").alias("n"), _cents("value").alias("cents"), F.min("event_id").alias("low"), F.max("event_id").alias("high"))


@_query(f"SELECT event_type, count(*) AS n, {_CENTS} AS cents FROM events GROUP BY event_type")
def plain_scan_agg(spark, sf_dir):
    """The same aggregate over the raw table: what the seam is measured against."""
    return _read(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), _cents("value").alias("cents"))


@_query(f"SELECT event_type, count(*) AS n, {_CENTS} AS cents FROM events GROUP BY event_type")
def seam_without_corrections(spark, sf_dir):
    return engine(spark, sf_dir).read("events_plain").groupBy("event_type").agg(F.count("*").alias("n"), _cents("value").alias("cents"))


@_query(f"WITH {{seam}} SELECT user_id, count(*) AS n, {_CENTS} AS cents FROM seam WHERE ts >= TIMESTAMP '2024-01-25' GROUP BY user_id")
def hot_side_filter(spark, sf_dir):
    e = engine(spark, sf_dir)
    return e.read("events", "ts >= timestamp_ntz'2024-01-25'").groupBy("user_id").agg(F.count("*").alias("n"), _cents("value").alias("cents"))


@_query("WITH {seam} SELECT event_id, user_id, value FROM seam WHERE ts < TIMESTAMP '2024-01-05' AND value > 50")
def cold_side_filter(spark, sf_dir):
    return engine(spark, sf_dir).read("events", "ts < timestamp_ntz'2024-01-05' AND value > 50").select("event_id", "user_id", "value")


@_query("WITH {seam} SELECT event_id, ts, value FROM seam WHERE ts BETWEEN TIMESTAMP '2024-01-20' AND TIMESTAMP '2024-01-22' AND event_type IN (SELECT min(event_type) FROM events)")
def seam_range_across(spark, sf_dir):
    e = engine(spark, sf_dir)
    first = _read(spark, sf_dir, "events").agg(F.min("event_type").alias("event_type"))
    return e.read("events", "ts BETWEEN timestamp_ntz'2024-01-20' AND timestamp_ntz'2024-01-22'").join(first, "event_type", "left_semi").select("event_id", "ts", "value")


@_query("WITH {seam} SELECT event_id, value FROM seam WHERE ts < TIMESTAMP '{cut}'")
def cold_only(spark, sf_dir):
    return engine(spark, sf_dir).seam("events").cold().select("event_id", "value")


@_query("SELECT event_id, value FROM events WHERE ts >= TIMESTAMP '{cut}'")
def hot_only(spark, sf_dir):
    s = engine(spark, sf_dir).seam("events")
    return s.hot(s.line.t).select("event_id", "value")


@_query("SELECT event_id, value FROM events WHERE ts < TIMESTAMP '{cut}'")
def pinned_lake_scan(spark, sf_dir):
    return engine(spark, sf_dir).seam("events").lake().select("event_id", "value")


@_query(
    "SELECT event_id, value * 2 AS value, false AS gone FROM events WHERE ts < TIMESTAMP '{cut}' AND event_id % 97 = 0 AND event_id % 101 <> 0 "
    "UNION ALL SELECT event_id + 10000000, value, false FROM events WHERE event_id % 500 = 0 UNION ALL SELECT event_id, NULL, true FROM events WHERE ts < TIMESTAMP '{cut}' AND event_id % 101 = 0"
)
def delta_newest_wins(spark, sf_dir):
    return engine(spark, sf_dir).seam("events").corrections().select("event_id", "value", (F.col("__op") == 1).alias("gone"))


@_query("WITH d AS (SELECT user_id % 1000 AS k, event_id AS version, event_type AS v FROM events) SELECT k::VARCHAR AS pk, max(version) AS version, arg_max(v, version) AS v, arg_min(version % 7, version)::BIGINT AS place FROM d GROUP BY k")
def newest_per_key(spark, sf_dir):
    """Newest-wins over a log where every key has many versions; the first place stays."""
    log = _read(spark, sf_dir, "events").select((F.col("user_id") % 1000).cast("string").alias(PK), F.col("event_type").alias("v"), F.lit(0).alias("__op"), (F.col("event_id") % 7).alias(TIER), F.lit(None).cast("long").alias("__old_tier"), F.col("event_id").alias("__version"))
    out = newest(log)
    return out.select(F.col(PK).alias("pk"), F.col("__version").alias("version"), "v", F.coalesce("__old_tier", TIER).alias("place"))


@_query("SELECT event_id + 10000000 AS event_id, value FROM events")
def delta_only_cold_whole(spark, sf_dir):
    """All events below the cut-line of a table whose lake has no snapshot yet."""
    e, name = engine(spark, sf_dir), f"q{next(_SERIAL)}"
    events = _read(spark, sf_dir, "events")
    e.register(name, events.schema, ["event_id"], "ts", cut="2030-01-01")
    e.insert(name, events.withColumn("event_id", F.col("event_id") + 10_000_000))
    return e.read(name).select("event_id", "value")


@_query(f"SELECT event_type, count(*) AS n, {_CENTS} AS cents FROM events WHERE NOT (ts < TIMESTAMP '{{cut}}' AND event_id % 300 = 0) GROUP BY event_type")
def direct_lake_only(spark, sf_dir):
    e, name = engine(spark, sf_dir), f"q{next(_SERIAL)}"
    events = _read(spark, sf_dir, "events")
    e.register(name, events.schema, ["event_id"], "ts", "direct", width="1d", cut=CUT)
    e.insert(name, events)
    e.delete(name, events.filter(F.col("ts") < F.lit(CUT).cast("timestamp_ntz")).filter("event_id % 300 = 0").select("event_id", "ts"))
    return e.read(name).groupBy("event_type").agg(F.count("*").alias("n"), _cents("value").alias("cents"))


@_query(f"SELECT event_type, count(*) AS n, {_CENTS} AS cents FROM (SELECT event_type, CASE WHEN ts < TIMESTAMP '{{cut}}' AND event_id % 100 = 0 THEN value + 1 ELSE value END AS value FROM events) GROUP BY event_type")
def keep_heap_corrections(spark, sf_dir):
    """Old rows stay hot too; an update changes both copies."""
    e, name = engine(spark, sf_dir), f"q{next(_SERIAL)}"
    events = _read(spark, sf_dir, "events")
    e.register(name, events.schema, ["event_id"], "ts", "tiered+keep_heap", width="1d", lag="0d", cut="2023-12-01")
    e.insert(name, events)
    e.add_partitions(name, [("2023-12-01", CUT)])
    assert e.tier(name)["partitions"] == 1
    e.update(name, {"value": "value + 1"}, f"ts < timestamp_ntz'{CUT}' AND event_id % 100 = 0")
    return e.read(name).groupBy("event_type").agg(F.count("*").alias("n"), _cents("value").alias("cents"))


@_query("WITH {seam} SELECT c_mktsegment, count(*) AS n, sum(round(value * 100)::BIGINT)::BIGINT AS cents FROM seam JOIN customer ON user_id = c_custkey GROUP BY c_mktsegment")
def seam_join_customer(spark, sf_dir):
    c = _read(spark, sf_dir, "customer")
    return engine(spark, sf_dir).read("events").join(c, F.col("user_id") == F.col("c_custkey")).groupBy("c_mktsegment").agg(F.count("*").alias("n"), _cents("value").alias("cents"))


@_query("WITH {seam}, {live} SELECT o_orderstatus, event_type, count(*) AS n FROM live JOIN seam ON o_orderkey = event_id GROUP BY ALL")
def seam_join_seam(spark, sf_dir):
    e = engine(spark, sf_dir)
    return e.read("orders").join(e.read("events"), F.col("o_orderkey") == F.col("event_id")).groupBy("o_orderstatus", "event_type").agg(F.count("*").alias("n"))


@_query("WITH {seam} SELECT a.event_id, b.event_id AS late_id FROM seam a JOIN seam b ON a.event_id + 10000000 = b.event_id")
def seam_self_join(spark, sf_dir):
    e = engine(spark, sf_dir)
    a, b = e.read("events").select("event_id"), e.read("events").select(F.col("event_id").alias("late_id"))
    return a.join(b, F.col("event_id") + 10_000_000 == F.col("late_id"))


@_query("WITH {seam} SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM seam WHERE user_id = c_custkey AND value > 90)")
def seam_semi_exists(spark, sf_dir):
    e = engine(spark, sf_dir)
    return _read(spark, sf_dir, "customer").join(e.read("events").filter("value > 90"), F.col("c_custkey") == F.col("user_id"), "left_semi").select("c_custkey")


@_query("WITH {seam} SELECT * FROM (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) AS place FROM seam) WHERE place <= 3")
def seam_window_rank(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy(F.desc("ts"), "event_id")
    return engine(spark, sf_dir).read("events").select("event_id", "user_id", F.row_number().over(w).cast("long").alias("place")).filter("place <= 3")


@_query("WITH {seam} SELECT event_type, hour(ts)::INT AS hour, count(*) AS n FROM seam GROUP BY ROLLUP (event_type, hour(ts))")
def seam_rollup(spark, sf_dir):
    rows = engine(spark, sf_dir).read("events").withColumn("hour", F.hour("ts"))
    return rows.rollup("event_type", "hour").agg(F.count("*").alias("n"))


@_query("WITH {seam} SELECT event_id, value FROM seam ORDER BY value DESC, event_id LIMIT 25")
def seam_top_k(spark, sf_dir):
    return engine(spark, sf_dir).read("events").select("event_id", "value").orderBy(F.desc("value"), "event_id").limit(25)


@_query("WITH {seam} SELECT user_id FROM seam WHERE ts >= TIMESTAMP '{cut}' INTERSECT SELECT user_id FROM seam WHERE ts < TIMESTAMP '{cut}' EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'F'")
def seam_set_operations(spark, sf_dir):
    e = engine(spark, sf_dir)
    s = e.seam("events")
    done = _read(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").select("o_custkey")
    return s.hot(s.line.t).select("user_id").intersect(s.cold().select("user_id")).subtract(done)


@_query("WITH {seam} SELECT user_id, date_trunc('hour', ts) AS hour, string_agg(event_id::VARCHAR, ',' ORDER BY event_id) AS ids FROM seam GROUP BY ALL")
def seam_string_agg_whole(spark, sf_dir):
    """All rows; a group is one user's hour, which doesn't grow with the table."""
    rows = engine(spark, sf_dir).read("events").withColumn("hour", F.date_trunc("hour", "ts").cast("timestamp_ntz"))
    return rows.groupBy("user_id", "hour").agg(F.array_join(F.transform(F.array_sort(F.collect_list("event_id")), lambda x: x.cast("string")), ",").alias("ids"))


@_query("WITH {seam}, {live} SELECT o_orderpriority, count(*) AS n, min(o_orderkey) AS low FROM live WHERE o_totalprice > (SELECT avg(o_totalprice) FROM orders) GROUP BY o_orderpriority")
def orders_seam_sql(spark, sf_dir):
    """Plain SQL over registered tables."""
    e = engine(spark, sf_dir)
    _read(spark, sf_dir, "orders").createOrReplaceTempView("ebbline_raw_orders")
    return e.sql("SELECT o_orderpriority, count(*) AS n, min(o_orderkey) AS low FROM orders WHERE o_totalprice > (SELECT avg(o_totalprice) FROM ebbline_raw_orders) GROUP BY o_orderpriority")


# Routed writes


def _state(df: DataFrame) -> DataFrame:
    return df.select("event_id", "ts", "event_type", "value")


@_query("WITH {seam} SELECT event_id, ts, event_type, CASE WHEN ts < TIMESTAMP '2024-01-03' AND event_id < 10000000 THEN value + 1000 ELSE value END AS value FROM seam")
def update_cold(spark, sf_dir):
    e, q = _clone(spark, sf_dir)
    e.update(q, {"value": "value + 1000"}, "ts < timestamp_ntz'2024-01-03' AND event_id < 10000000")
    return _state(e.read(q))


@_query("WITH {seam} SELECT event_id, ts, event_type, CASE WHEN ts >= TIMESTAMP '2024-01-28' THEN -value ELSE value END AS value FROM seam")
def update_hot(spark, sf_dir):
    e, q = _clone(spark, sf_dir)
    e.update(q, {"value": "-value"}, "ts >= timestamp_ntz'2024-01-28'")
    return _state(e.read(q))


@_query("WITH {seam} SELECT event_id, ts, CASE WHEN user_id % 10 = 3 THEN 'changed' ELSE event_type END AS event_type, value FROM seam")
def update_mixed(spark, sf_dir):
    e, q = _clone(spark, sf_dir)
    e.sql(f"UPDATE {q} SET event_type = 'changed' WHERE user_id % 10 = 3")
    return _state(e.read(q))


@_query("WITH {seam} SELECT event_id, CASE WHEN event_id % 40 = 0 AND event_id < 10000000 THEN ts + INTERVAL 10 DAY ELSE ts END AS ts, event_type, value FROM seam")
def update_tier_move(spark, sf_dir):
    """Moves inside the cold side, from cold to hot and inside the hot side."""
    e, q = _clone(spark, sf_dir)
    e.update(q, {"ts": "ts + INTERVAL 10 DAYS"}, "event_id % 40 = 0 AND event_id < 10000000")
    return _state(e.read(q))


@_query("WITH {seam} SELECT event_id, CASE WHEN event_id % 30 = 0 AND ts >= TIMESTAMP '2024-01-26' THEN ts - INTERVAL 20 DAY ELSE ts END AS ts, event_type, value FROM seam")
def update_hot_to_cold(spark, sf_dir):
    e, q = _clone(spark, sf_dir)
    e.update(q, {"ts": "ts - INTERVAL 20 DAYS"}, "event_id % 30 = 0 AND ts >= timestamp_ntz'2024-01-26'")
    return _state(e.read(q))


@_query("WITH {seam} SELECT event_id, ts, event_type, value FROM seam WHERE NOT (event_id % 9 = 4 AND ts < TIMESTAMP '2024-01-10')")
def delete_cold(spark, sf_dir):
    e, q = _clone(spark, sf_dir)
    e.sql(f"DELETE FROM {q} WHERE event_id % 9 = 4 AND ts < timestamp_ntz'2024-01-10'")
    return _state(e.read(q))


@_query("WITH {seam} SELECT event_id, value * 10 AS value FROM seam WHERE event_id % 77 = 0")
def returning_update(spark, sf_dir):
    e, q = _clone(spark, sf_dir)
    return e.update(q, {"value": "value * 10"}, "event_id % 77 = 0")[1].select("event_id", "value")


@_query("WITH {seam} SELECT event_id, ts, value FROM seam WHERE event_id % 77 = 0")
def returning_delete(spark, sf_dir):
    e, q = _clone(spark, sf_dir)
    return e.delete_where(q, "event_id % 77 = 0")[1].select("event_id", "ts", "value")


@_query("SELECT 'hot' AS side, count(*) FILTER (WHERE ts >= TIMESTAMP '{cut}') AS n FROM events UNION ALL SELECT 'delta', count(*) FILTER (WHERE ts < TIMESTAMP '{cut}') FROM events UNION ALL SELECT 'lake', 0")
def route_counts_whole(spark, sf_dir):
    e, q = _clone(spark, sf_dir)
    out = e.insert(q, _read(spark, sf_dir, "events").withColumn("event_id", F.col("event_id") + 50_000_000))
    return spark.createDataFrame(list(out.items()), "side string, n long")


@_query("WITH {seam} SELECT event_id, ts, event_type, value FROM seam UNION ALL SELECT event_id + 70000000, ts, event_type, value FROM events")
def insert_select_whole(spark, sf_dir):
    e, q = _clone(spark, sf_dir)
    _read(spark, sf_dir, "events").createOrReplaceTempView("ebbline_raw_events")
    e.sql(f"INSERT INTO {q} SELECT event_id + 70000000, ts, user_id, event_type, value, props FROM ebbline_raw_events")
    return _state(e.read(q))


@_query("SELECT event_id % 4000 AS event_id, arg_max(value, event_id) AS value FROM events WHERE ts >= TIMESTAMP '2024-01-21' GROUP BY 1")
def upsert_hot(spark, sf_dir):
    """Two upserts of overlapping keys: the later one wins."""
    e, q = engine(spark, sf_dir), f"q{next(_SERIAL)}"
    events = _read(spark, sf_dir, "events").filter(f"ts >= timestamp_ntz'{CUT}'").select((F.col("event_id") % 4000).alias("k"), F.col("event_id").alias("v"), "ts", "value")
    rows = lambda df: df.groupBy("k").agg(F.max_by("ts", "v").alias("ts"), F.max_by("value", "v").alias("value")).withColumnRenamed("k", "event_id")
    e.register(q, "event_id long, ts timestamp_ntz, value double", ["event_id"], "ts", cut=CUT)
    first = events.groupBy("k").agg(F.min("v").alias("m"))
    e.upsert(q, rows(events.join(first, "k").filter("v = m").drop("m")))
    e.upsert(q, rows(events))
    return e.read(q).select("event_id", "value")


# Ageing


@_query("WITH d AS (SELECT unnest(generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-30', INTERVAL 1 DAY)) AS lo) SELECT CASE WHEN lo + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 9 DAY FROM events) THEN 'dropped' ELSE 'hot' END AS state, count(*) AS n FROM d GROUP BY 1")
def partition_states(spark, sf_dir):
    e, q = _tiered(spark, sf_dir)
    got = [(p.state,) for p in e.store.catalog.partitions(e.store.table(q).id)]
    return spark.createDataFrame(got, "state string").groupBy("state").agg(F.count("*").alias("n"))


def _tiered(spark, sf_dir, mode: str = "tiered", **options):
    """All rows hot in daily partitions, and those ten days behind tiered (the newest row is of January 30)."""
    e, q = engine(spark, sf_dir), f"q{next(_SERIAL)}"
    events = _read(spark, sf_dir, "events")
    e.register(q, events.schema, ["event_id"], "ts", mode, width="1d", lag="9d", cut="2024-01-01", **options)
    e.insert(q, events)
    e.add_partitions(q, [(f"2024-01-{d:02d}", f"2024-01-{d + 1:02d}") for d in range(1, 31)])
    e.tier(q)
    return e, q


@_query(f"SELECT event_type, count(*) AS n, {_CENTS} AS cents, 'all' AS part FROM events GROUP BY event_type UNION ALL SELECT event_type, count(*), {_CENTS}, 'hot' FROM events WHERE ts >= TIMESTAMP '2024-01-21' GROUP BY event_type")
def tiering_advance(spark, sf_dir):
    """Tiering changes no read, and leaves only young rows hot."""
    e, q = _tiered(spark, sf_dir)
    agg = lambda df, part: df.groupBy("event_type").agg(F.count("*").alias("n"), _cents("value").alias("cents")).withColumn("part", F.lit(part))
    return agg(e.read(q), "all").unionByName(agg(e.seam(q).hot(), "hot"))


@_query("WITH {seam} SELECT event_id, ts, event_type, value FROM seam")
def compaction_fold(spark, sf_dir):
    """All corrections folded into the lake: the view stays the same without them."""
    e, q = _clone(spark, sf_dir)
    while e.compact(q, 10_000_000):
        pass
    assert not e.seam(q).delta_rows()
    return _state(e.read(q))


@_query("WITH {seam} SELECT event_id, value FROM seam WHERE ts < TIMESTAMP '{cut}'")
def equality_delete_apply(spark, sf_dir):
    """The lake by itself after a fold: deletes apply to older rows of their bucket only."""
    e, q = _clone(spark, sf_dir)
    while e.compact(q, 10_000_000):
        pass
    return e.seam(q).lake().select("event_id", "value")


@_query("WITH {seam} SELECT event_id, value FROM seam WHERE ts < TIMESTAMP '{cut}'")
def maintained_lake(spark, sf_dir):
    e, q = _clone(spark, sf_dir)
    while e.compact(q, 10_000_000):
        pass
    e.maintain(q)
    assert not [f for f in e.store.catalog.files(e.store.table(q).id, "lake") if f.kind == "delete"]
    return e.seam(q).lake().select("event_id", "value")


@_query("SELECT event_id, value FROM events WHERE ts >= TIMESTAMP '2024-01-11'")
def retention_expire(spark, sf_dir):
    e, q = _tiered(spark, sf_dir, lake_retention="10d")
    e.retain(q)
    return e.read(q).select("event_id", "value")


@_query("SELECT event_id, CASE WHEN event_id % 10 = 0 AND ts < TIMESTAMP '{cut}' THEN 0.5 ELSE value END AS value FROM events UNION ALL SELECT event_id + 20000000, value FROM events WHERE ts < TIMESTAMP '2024-01-02'")
def ingest_upsert(spark, sf_dir):
    e, q = _clone(spark, sf_dir, "events_plain")
    events = _read(spark, sf_dir, "events")
    e.ingest(q, events.filter(f"event_id % 10 = 0 AND ts < timestamp_ntz'{CUT}'").withColumn("value", F.lit(0.5)))
    e.ingest(q, events.filter("ts < timestamp_ntz'2024-01-02'").withColumn("event_id", F.col("event_id") + 20_000_000))
    return e.read(q).select("event_id", "value")


@_query("SELECT event_id, 7.0 AS value FROM events")
def stream_load_replay(spark, sf_dir):
    """A labelled load: hot rows at once, many cold ones staged and adopted, replays without effect."""
    e, q = _clone(spark, sf_dir, "events_plain")
    rows = _read(spark, sf_dir, "events")
    for value in (7.0, 8.0):
        e.load(q, "a", rows.withColumn("value", F.lit(value)), spool_above=100)
    e.adopt_loads(q)
    return e.read(q).select("event_id", "value")


# The change feed


def _feed(spark, sf_dir, folder: str) -> None:
    """Inserts of all orders, then updates of some, moves in time of others, and deletes, in four files."""
    o = _read(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", "o_orderstatus", "o_totalprice")
    none = F.lit(None).cast(o.schema.simpleString())
    old = F.struct(*[F.col(c) for c in o.columns])
    parts = [
        o.select(F.col("o_orderkey").alias("seq"), F.lit(1).cast("long").alias("txn"), F.lit("I").alias("kind"), old.alias("new"), none.alias("old")),
        o.filter("o_orderkey % 7 = 0").select((F.col("o_orderkey") + 10**9).alias("seq"), F.lit(2).cast("long").alias("txn"), F.lit("U").alias("kind"), F.struct("o_orderkey", "o_orderdate", F.lit("X").alias("o_orderstatus"), (F.col("o_totalprice") + 1).alias("o_totalprice")).alias("new"), old.alias("old")),
        o.filter("o_orderkey % 11 = 0 AND o_orderkey % 7 <> 0").select((F.col("o_orderkey") + 2 * 10**9).alias("seq"), F.lit(3).cast("long").alias("txn"), F.lit("U").alias("kind"), F.struct("o_orderkey", F.expr("o_orderdate + INTERVAL 400 DAYS").alias("o_orderdate"), "o_orderstatus", "o_totalprice").alias("new"), old.alias("old")),
        o.filter("o_orderkey % 13 = 0 AND o_orderkey % 11 <> 0 AND o_orderkey % 7 <> 0").select((F.col("o_orderkey") + 3 * 10**9).alias("seq"), F.lit(4).cast("long").alias("txn"), F.lit("D").alias("kind"), none.alias("new"), old.alias("old")),
    ]
    for p in parts:
        p.coalesce(1).write.mode("append").parquet(folder)


_FED = "fed AS (SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 0 AND o_orderkey % 7 <> 0 THEN o_orderdate + INTERVAL 400 DAY ELSE o_orderdate END AS o_orderdate, CASE WHEN o_orderkey % 7 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus, CASE WHEN o_orderkey % 7 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice FROM orders WHERE o_orderkey % 13 <> 0 OR o_orderkey % 11 = 0 OR o_orderkey % 7 = 0)"


def _mirrored(spark, sf_dir):
    e, q = engine(spark, sf_dir), f"q{next(_SERIAL)}"
    folder = f"{_root(spark)}/feed"
    _feed(spark, sf_dir, folder)
    e.register(q, "o_orderkey long, o_orderdate timestamp_ntz, o_orderstatus string, o_totalprice double", ["o_orderkey"], "o_orderdate", "mirrored", layout="year")
    for _ in range(2):  # the second query finds nothing new
        e.mirror(q, folder, f"{_root(spark)}/offsets", files_per_batch=2).awaitTermination()
    return e, q


@_query(f"WITH {_FED} SELECT * FROM fed")
def cdc_fold_state(spark, sf_dir):
    e, q = _mirrored(spark, sf_dir)
    return e.seam(q).lake(live=True).select(*e.store.table(q).columns)


@_query(f"WITH {_FED} SELECT * FROM fed")
def hybrid_read(spark, sf_dir):
    """A mirrored table read from both sides: the newest year hot, the rest from the lake."""
    e, q = _mirrored(spark, sf_dir)
    e.insert(q, e.seam(q).lake(live=True).select(*e.store.table(q).columns))
    return e.read_hybrid(q, "365d")


# Verification, codecs, status


@_query("WITH {seam} SELECT count(*) AS n, min(epoch_us(ts)) AS low, max(epoch_us(ts)) AS high FROM seam")
def verify_checksum(spark, sf_dir):
    e = engine(spark, sf_dir)
    return maintain.checksum(e.store.prepared(e.store.table("events"), e.read("events"))).drop("crc")


@_query("SELECT event_id, epoch_us(ts) AS micros, (ts::DATE - DATE '1970-01-01')::BIGINT AS days FROM events")
def codec_tier_keys(spark, sf_dir):
    return _read(spark, sf_dir, "events").select("event_id", TierKind.TIMESTAMP.to_long(F.col("ts")).alias("micros"), TierKind.DATE.to_long(F.col("ts").cast("date")).alias("days"))


@_query(r"SELECT event_id, replace(replace(event_type || '\' || chr(31), '\', '\\'), chr(31), '\' || chr(31)) || chr(31) || user_id::VARCHAR AS pk FROM events")
def codec_pk(spark, sf_dir):
    rows = _read(spark, sf_dir, "events").select("event_id", F.concat("event_type", F.lit("\\\x1f")).alias("a"), "user_id")
    return rows.select("event_id", pk_text(["a", "user_id"], rows.schema).alias("pk"))


@_query("SELECT event_id, (event_id - 5000) - (((event_id - 5000) % 77 + 77) % 77) AS low, epoch_us(date_trunc('month', ts)) AS month FROM events")
def lake_buckets(spark, sf_dir):
    micros = TierKind.TIMESTAMP.to_long(F.col("ts"))
    return _read(spark, sf_dir, "events").select("event_id", floor_to(F.col("event_id") - 5000, 77).alias("low"), codec.Layout("month").bucket(micros, TierKind.TIMESTAMP).alias("month"))


@_query("SELECT 'events' AS name, 'tiered' AS mode, count(*) FILTER (WHERE ts >= TIMESTAMP '{cut}') AS hot_rows, count(*) FILTER (WHERE ts < TIMESTAMP '{cut}') AS lake_rows FROM events")
def status_view(spark, sf_dir):
    return engine(spark, sf_dir).status().filter("name = 'events'").select("name", "mode", "hot_rows", "lake_rows")


@_query("SELECT min(t)::BIGINT AS t, min(s)::BIGINT AS s, count(*) AS pins FROM (VALUES (1705795200000000, 1), (1705795200000000, 1)) v(t, s)")
def horizon_min_pins(spark, sf_dir):
    e, q = _clone(spark, sf_dir)
    with e.pinned(q), e.pinned(q):
        t, s, n = e.store.catalog.horizon(e.store.table(q).id)
    return spark.createDataFrame([(t, s, n)], "t long, s long, pins long")


@_query("SELECT event_id, value FROM events")
def pinned_read_is_stable(spark, sf_dir):
    """A pinned read doesn't see a later update, delete and fold."""
    e, q = _clone(spark, sf_dir, "events_plain")
    with e.pinned(q) as seam:
        e.update(q, {"value": "0.0"}, "event_id % 2 = 0")
        e.delete_where(q, "event_id % 3 = 0")
        path = f"{_root(spark)}/kept"
        seam.view().select("event_id", "value").write.parquet(path)  # while the pin lives
    assert e.compact(q)
    return spark.read.parquet(path)

