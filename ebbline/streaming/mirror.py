"""Mirroring a change feed into the lake with Structured Streaming.

A feed is a folder of Parquet or JSON files with the columns seq long, txn long, kind string (I, U, D, T), new and old
structs of the table's row. Micro-batches are folded to the newest image of each key and committed as one lake snapshot
stamped with the batch and the frontier, the largest transaction it holds. Transactions up to the frontier are skipped,
so a replayed batch changes nothing.
"""

from __future__ import annotations

import time

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ebbline.functions.codec import pk_text
from ebbline.operators.store import RoutingError, Store
from ebbline.plans.seam import Table
from ebbline.sources.files import PK, TIER

#: Marks a text value that an update didn't send.
UNCHANGED = "__unchanged__"
#: Changes that one task folds. Up to 200 tasks, that is 80 million changes, Spark brings them together without sorting or keeping them.
FOLD_ROWS = 400_000


def feed_schema(table: Table) -> T.StructType:
    row = T.StructType(table.schema.fields)
    return T.StructType([T.StructField("seq", T.LongType()), T.StructField("txn", T.LongType()), T.StructField("kind", T.StringType()), T.StructField("new", row), T.StructField("old", row)])


def ends_of(table: Table, changes: DataFrame) -> DataFrame:
    """What each change does to its keys: PK, at (their order), gone boolean, row, TIER, and place, where the lake may have the row.

    Values an update didn't send come from the old image. A changed primary key ends the old key.
    """
    new, old = F.col("new"), F.col("old")
    fields = []
    for f in table.schema:
        v = new[f.name]
        if isinstance(f.dataType, T.StringType):
            v = F.when((v == UNCHANGED) & old.isNotNull(), old[f.name]).otherwise(v)
        fields.append(v.alias(f.name))
    image = F.when(F.col("kind") == "D", F.coalesce(old, new)).otherwise(F.struct(*fields))
    rows = changes.select("seq", "kind", image.alias("row"), F.coalesce(old, image).alias("was"))
    tier = lambda c: table.kind.to_long(F.col(c)[table.tier_key])
    keyed = rows.select("seq", "kind", "row", tier("row").alias("tier"), tier("was").alias("was_tier"), _key(table, "row").alias("key"), _key(table, "was").alias("was_key"))
    ends = keyed.filter("kind = 'U' AND was_key <> key").select(F.col("was_key").alias(PK), (F.col("seq") * 2).alias("at"), F.lit(True).alias("gone"), "row", F.col("was_tier").alias(TIER), F.col("was_tier").alias("place"))
    same = F.when(F.col("kind") == "I", F.lit(None)).when(F.col("was_key") != F.col("key"), F.lit(None)).otherwise(F.col("was_tier"))
    return keyed.select(F.col("key").alias(PK), (F.col("seq") * 2 + 1).alias("at"), (F.col("kind") == "D").alias("gone"), "row", F.col("tier").alias(TIER), F.coalesce(same, F.col("tier")).alias("place")).unionByName(ends)


def fold(table: Table, ends: DataFrame, n: int) -> DataFrame:
    """The state each key ends in: columns, PK, TIER, gone boolean, and __place, the tier key the lake has the row at.

    The lake's place is the first old tier key of the key in the batch, however often the row moves. Changes of a key meet
    in one task before anything is sorted, in as many tasks as n changes ask for: rows can't be merged by hashing, so a
    sort before the shuffle would hold all that a task reads, and one after it a share that grows with the batch.
    """
    tasks = max(-(-n // FOLD_ROWS), min(ends.sparkSession.sparkContext.defaultParallelism, -(-n // 20_000)))
    last = ends.repartition(tasks, PK).groupBy(PK).agg(F.max_by(F.struct("gone", "row", TIER), "at").alias("x"), F.min_by("place", "at").alias("__place"))
    return last.select(*[F.col("x.row")[c].alias(c) for c in table.columns], PK, F.col(f"x.{TIER}").alias(TIER), F.col("x.gone").alias("gone"), "__place")


def _key(table: Table, struct: str):
    """The key text of a struct column's row."""
    if len(table.pk) == 1:
        return F.col(struct)[table.pk[0]].cast("string")
    parts = []
    for i, c in enumerate(table.pk):
        text = F.replace(F.replace(F.col(struct)[c].cast("string"), F.lit("\\"), F.lit("\\\\")), F.lit("\x1f"), F.lit("\\\x1f"))
        parts += [F.lit("\x1f"), text] if i else [text]
    return F.concat(*parts)


def apply_batch(store: Store, name: str, changes: DataFrame, batch: int) -> int:
    """Fold one micro-batch into the lake and advance the frontier; how many keys changed."""
    table = store.table(name)
    f = store.catalog.line(table.id).f
    changes = changes.filter(F.col("txn") > f)
    found = changes.agg(F.max("txn"), F.count_if(F.col("kind") == "T"), F.count_if(~F.col("kind").isin("I", "U", "D", "T")), F.count("*")).first()
    if found[0] is None:
        return 0
    if found[1] or found[2]:
        raise RoutingError(f"{name}: the feed holds a truncation or an unknown kind of change")
    changes = evolve(store, table, changes)
    table = store.table(name)
    ends = ends_of(table, changes)
    if ends.filter(F.col(PK).isNull()).take(1):
        raise RoutingError(f"{name}: a change has no primary key")
    seq = store.catalog.line(table.id).s + 1
    state = fold(table, ends, found[3]).persist()
    try:
        buckets = F.array_distinct(F.transform(F.array("__place", TIER), lambda x: table.layout.bucket(x, table.kind)))
        add = store.stage_deletes(table, state.select(PK, F.explode(buckets).alias(TIER)), seq, once=True) + store.stage_lake(table, state.filter("NOT gone"), seq)
    finally:
        state.unpersist()
    store.publish_lake(table, seq, add, props={"batch": batch, "frontier": found[0]}, f=found[0])
    return sum(x.rows for x in add if x.kind == "data")


def evolve(store: Store, table: Table, changes: DataFrame) -> DataFrame:
    """Columns may be added to a feed; columns that go, or change their type, stop the mirror."""
    row: T.StructType = changes.schema["new"].dataType
    have = {f.name: f.dataType for f in row}
    for f in table.schema:
        if f.name not in have:
            raise RoutingError(f"{table.name}: the feed lost the column {f.name}")
        if have[f.name] != f.dataType:
            raise RoutingError(f"{table.name}: {f.name} became {have[f.name].simpleString()}")
    added = [f for f in row if f.name not in table.columns]
    if added:
        spec = dict(table.spec)
        spec["schema"] = T.StructType([*table.schema.fields, *added]).jsonValue()
        store.catalog.set_spec(table.id, spec)
    return changes


def mirror(store: Store, name: str, feed: str, checkpoint: str, files_per_batch: int = 100, fmt: str = "parquet", schema: T.StructType | None = None):
    """Start a query that applies all of the feed that is there, file batch by file batch, and ends."""
    table = store.table(name)
    stream = store.spark.readStream.schema(schema or feed_schema(table)).option("maxFilesPerTrigger", files_per_batch).format(fmt).load(feed)
    query = stream.writeStream.foreachBatch(lambda df, i: apply_batch(store, name, df, i)).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    return query.start()


def wait_for(store: Store, name: str, frontier: int, timeout_ms: int = 5000) -> bool:
    """Wait until the lake holds the feed up to the frontier; False if it doesn't in time (read the hot set then)."""
    table, end = store.table(name), time.time() + timeout_ms / 1000
    while store.catalog.line(table.id).f < frontier:
        if time.time() >= end:
            return False
        time.sleep(0.05)
    return True
