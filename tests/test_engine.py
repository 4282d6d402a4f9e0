"""Scripted traces on small tables: whole contents are compared as sorted text rows."""

import pytest
from pyspark.sql import functions as F

from ebbline.engine import Engine
from ebbline.operators import lifecycle, load
from ebbline.operators.store import RoutingError, Store
from ebbline.sources.catalog import CatalogError

SCHEMA = "id long, event_time long, val string"


@pytest.fixture
def engine(spark, tmp_path):
    return Engine(spark, str(tmp_path))


def rows(spark, *values, schema=SCHEMA):
    return spark.createDataFrame(list(values), schema)


def text(df):
    return sorted("|".join("" if v is None else str(v) for v in r) for r in df.collect())


def trips(engine, mode="tiered", lag=50, **options):
    engine.register("trips", SCHEMA, ["id"], "event_time", mode, width=100, lag=lag, cut=0, **options)
    engine.add_partitions("trips", [(0, 100), (100, 200), (200, 300)])
    engine.insert("trips", rows(engine.spark, (1, 10, "a"), (2, 20, "b"), (3, 110, "c"), (4, 150, "d"), (5, 250, "e")))
    return engine


def test_golden_trace(spark, engine):
    e = trips(engine)
    assert e.tier("trips") == {"partitions": 2, "t": 200, "dropped": 2}
    assert len(text(e.read("trips"))) == 5 and text(e.seam("trips").hot().select("id")) == ["5"]
    e.delete("trips", rows(spark, (1, 10, None)))
    e.upsert("trips", rows(spark, (3, 110, "C!"), (6, 260, "f")))
    assert text(e.read("trips")) == ["2|20|b", "3|110|C!", "4|150|d", "5|250|e", "6|260|f"]
    e.sql("UPDATE trips SET val = 'B?' WHERE id = 2")
    e.sql("DELETE FROM trips WHERE id = 4")
    after = ["2|20|B?", "3|110|C!", "5|250|e", "6|260|f"]
    assert text(e.read("trips")) == after
    assert e.compact("trips") > 0 and e.seam("trips").delta_rows() == 0
    assert text(e.read("trips")) == after
    vehicles = rows(spark, (1, "VIN-001", 100), (2, "VIN-002", 150), (3, "VIN-003", 200), schema="id long, vin string, last_seen long")
    e.register("vehicles", vehicles.schema, ["id"], "last_seen", "mirrored")
    e.insert("vehicles", vehicles)
    assert text(e.sql("SELECT t.id, t.val, v.vin FROM trips t JOIN vehicles v ON t.id = v.id WHERE t.id = 2")) == ["2|B?|VIN-002"]
    e.load("trips", "hot", rows(spark, (7, 265, "g"), (8, 270, "h")))
    e.load("trips", "both", rows(spark, (9, 280, "i"), (10, 130, "j")))
    assert e.load("trips", "both", rows(spark, (99, 280, "z")))["replayed"]
    assert text(e.read("trips")) == sorted([*after, "7|265|g", "8|270|h", "9|280|i", "10|130|j"])
    assert e.verify("trips")["ok"]


def test_pins_delay_the_drop_and_keep_their_view(spark, engine):
    e = trips(engine)
    with e.pinned("trips") as before:
        assert e.tier("trips")["dropped"] == 0
        assert len(text(before.view())) == 5 and len(text(e.read("trips"))) == 5
        assert e.compact("trips") == 0
    assert e.reclaim("trips") == 2
    assert e.reclaim("trips") == 0
    assert len(text(e.read("trips"))) == 5


def test_tiering_guards(spark, engine):
    e = trips(engine, lag=200)
    assert e.tier("trips")["partitions"] == 0
    parts = e.store.catalog.partitions(e.store.table("trips").id)
    with pytest.raises(CatalogError):
        lifecycle.check_contiguous(0, [parts[0], parts[2]])
    with pytest.raises(CatalogError):
        e.store.catalog.move_partition(parts[0].id, "tiered", "hot")
    with pytest.raises(CatalogError):
        e.store.catalog.advance(e.store.table("trips").id, t=-1)


def test_empty_partition_advances_the_line_alone(spark, engine):
    e = engine
    e.register("t", SCHEMA, ["id"], "event_time", width=100, lag=0, cut=0)
    e.add_partitions("t", [(0, 100), (100, 200), (200, 300)])
    e.insert("t", rows(spark, (1, 205, "x")))
    assert e.tier("t")["t"] == 200
    assert e.store.catalog.line(e.store.table("t").id).s == 0


def test_resume_after_a_lost_driver(spark, engine):
    e = trips(engine)
    table = e.store.table("trips")
    e.store.catalog.log("dead", table.id, "tier", "flush", None, {"t": 100})
    e.store.catalog.log("committed", table.id, "tier", "flush", None, {"t": 100})
    files = e.store.stage_lake(table, e.store.prepared(table, rows(spark, (1, 10, "a"), (2, 20, "b"))), 1)
    e.store.publish_lake(table, 1, files, props={"op": "committed", "t": 100})
    lifecycle.resume(e.store, table)
    assert e.store.catalog.line(table.id).t == 100
    assert not e.store.catalog.unfinished(table.id, "tier")
    assert len(text(e.read("trips"))) == 5


def test_concurrent_commit_loses(spark, engine):
    e = trips(engine)
    table = e.store.table("trips")
    files = e.store.stage_lake(table, e.store.prepared(table, rows(spark, (9, 10, "x"))), 5)
    with pytest.raises(CatalogError):
        e.store.publish_lake(table, 5, files)


def test_moves_over_the_line(spark, engine):
    e = trips(engine)
    e.tier("trips")
    e.update("trips", {"event_time": "event_time + 100"}, "id IN (1, 3)")  # cold to cold, cold to hot
    e.update("trips", {"event_time": "20"}, "id = 5")  # hot to cold
    want = ["1|110|a", "2|20|b", "3|210|c", "4|150|d", "5|20|e"]
    assert text(e.read("trips")) == want
    while e.compact("trips"):
        pass
    assert text(e.read("trips")) == want
    assert text(e.seam("trips").lake(live=True).select("id")) == ["1", "2", "4", "5"]
    assert e.maintain("trips")["deletes"] > 0
    assert text(e.read("trips")) == want


def test_repeated_moves_remember_the_lakes_place(spark, engine):
    e = trips(engine)
    e.tier("trips")
    e.update("trips", {"event_time": "120"}, "id = 1")
    e.update("trips", {"event_time": "130"}, "id = 1")
    assert [tuple(r) for r in e.seam("trips").corrections().select("__tier", "__old_tier").collect()] == [(130, 10)]
    e.compact("trips")
    assert text(e.read("trips").filter("id = 1")) == ["1|130|a"]


def test_rejections(spark, engine):
    e = trips(engine, lake_retention=100)
    with pytest.raises(RoutingError, match="partition"):
        e.insert("trips", rows(spark, (9, 500, "x")))
    with pytest.raises(RoutingError, match="null"):
        e.insert("trips", rows(spark, (None, 250, "x")))
    with pytest.raises(RoutingError, match="twice"):
        e.insert("trips", rows(spark, (9, 250, "x"), (9, 251, "y")))
    with pytest.raises(RoutingError, match="no column"):
        e.insert("trips", rows(spark, (9, 250, "x")).withColumn("other", F.lit(1)))
    with pytest.raises(RoutingError, match="primary key"):
        e.update("trips", {"id": "id + 1"})
    e.tier("trips")
    assert e.retain("trips") == 100
    for write in (lambda: e.insert("trips", rows(spark, (9, 50, "x"))), lambda: e.delete("trips", rows(spark, (1, 10, None)))):
        with pytest.raises(RoutingError, match="retention"):
            write()
    assert text(e.read("trips")) == ["3|110|c", "4|150|d", "5|250|e"]
    assert e.retain("trips") is None


def test_returned_images(spark, engine):
    e = trips(engine)
    e.tier("trips")
    counts, new = e.update("trips", {"val": "upper(val)"}, "id IN (2, 5)")
    assert text(new) == ["2|20|B", "5|250|E"] and counts == {"hot": 1, "delta": 1}
    counts, old = e.delete_where("trips", "id IN (2, 5)")
    assert text(old) == ["2|20|B", "5|250|E"] and counts == {"hot": 1, "delta": 1}
    assert text(e.read("trips").select("id")) == ["1", "3", "4"]


def test_keep_heap(spark, engine):
    e = trips(engine, "tiered+keep_heap")
    assert e.tier("trips") == {"partitions": 2, "t": 200, "dropped": 0}
    e.update("trips", {"val": "'new'"}, "id = 1")
    e.delete_where("trips", "id = 2")
    assert text(e.read("trips")) == ["1|10|new", "3|110|c", "4|150|d", "5|250|e"]
    assert e.verify("trips")["ok"]


def test_direct(spark, engine):
    e = trips(engine, "direct")
    e.tier("trips")
    assert e.insert("trips", rows(spark, (1, 10, "again"), (8, 30, "new")))["lake"] == 2
    assert e.delete("trips", rows(spark, (2, 20, None)))["lake"] == 1
    assert text(e.read("trips")) == ["1|10|again", "3|110|c", "4|150|d", "5|250|e", "8|30|new"]
    with pytest.raises(RoutingError, match="direct"):
        e.update("trips", {"val": "'x'"}, "id = 1")
    with pytest.raises(RoutingError, match="direct"):
        e.load("trips", "l", rows(spark, (9, 30, "x")))
    assert e.update("trips", {"val": "'x'"}, "event_time >= 200")[0]["hot"] == 1


def test_composite_keys(spark, engine):
    e = engine
    e.register("r", "tenant long, device string, at long, v string", ["tenant", "device"], "at", width=100, cut=100)
    schema = e.store.table("r").schema
    e.ingest("r", rows(spark, (1, "d1", 10, "a"), (2, "d1", 20, "b"), (1, "d\x1f1", 30, "c"), schema=schema))
    e.upsert("r", rows(spark, (1, "d1", 10, "A"), (3, "d", 150, "hot"), schema=schema))
    e.delete("r", rows(spark, (2, "d1", 20, None), schema=schema))
    want = ["1|d\x1f1|30|c", "1|d1|10|A", "3|d|150|hot"]
    assert text(e.read("r")) == want
    e.compact("r")
    assert text(e.read("r")) == want


def test_ingest(spark, engine, tmp_path):
    e = trips(engine)
    e.tier("trips")
    path = str(tmp_path / "in")
    rows(spark, (1, 15, "moved"), (20, 17, "new")).coalesce(1).write.parquet(path)
    assert e.ingest("trips", [path]) == {"rows": 2, "replaced": 1}
    assert e.store.catalog.line(e.store.table("trips").id).t == 200
    assert "1|15|moved" in text(e.read("trips")) and len(text(e.read("trips"))) == 6
    straddling = str(tmp_path / "straddling")
    rows(spark, (30, 90, "x"), (31, 110, "y")).coalesce(1).write.parquet(straddling)
    with pytest.raises(RoutingError, match="several buckets"):
        e.ingest("trips", [straddling])
    with pytest.raises(RoutingError, match="outside"):
        e.ingest("trips", rows(spark, (30, 200, "x")))
    lines = tmp_path / "rows.jsonl"
    lines.write_text('{"id": 40, "event_time": 60, "val": "j"}\n\n{"id": 41, "event_time": 61, "val": null}\n')
    assert e.ingest_jsonl("trips", str(lines))["rows"] == 2
    for bad in ('{"id": 1, "nope": 2}', '{"id": [1]}', "[1]", "{"):
        lines.write_text(bad + "\n")
        with pytest.raises(RoutingError):
            e.ingest_jsonl("trips", str(lines))


def test_staged_loads(spark, engine):
    e = trips(engine)
    e.tier("trips")
    many = spark.range(100, 150).select("id", (F.col("id") - 50).alias("event_time"), F.lit("m").alias("val"))
    assert e.load("trips", "big", many, spool_above=10)["cold"] == 50
    assert len(text(e.read("trips"))) == 5  # not visible before they are adopted
    e.load("trips", "big2", many.limit(20).withColumn("val", F.lit("n")), spool_above=10)
    assert e.adopt_loads("trips") == 2 and e.adopt_loads("trips") == 0
    assert e.read("trips").filter("val = 'n'").count() == 20 and e.read("trips").count() == 55


def test_csv(spark, engine, tmp_path):
    e = trips(engine)
    e.tier("trips")
    (tmp_path / "x.csv").write_text("id,event_time,val\n50,60,cold\n51,260,hot\n")
    assert e.copy_from("trips", str(tmp_path / "x.csv")) == {"hot": 1, "delta": 1, "lake": 0}


def feed(spark, engine, name, path, *changes):
    from ebbline.streaming.mirror import feed_schema

    spark.createDataFrame([(s, t, k, n, o) for s, t, k, n, o in changes], feed_schema(engine.store.table(name))).coalesce(1).write.mode("append").parquet(path)


def test_mirror(spark, engine, tmp_path):
    e, path, state = engine, str(tmp_path / "feed"), str(tmp_path / "offsets")
    e.register("v", SCHEMA, ["id"], "event_time", "mirrored", layout=100)
    run = lambda: e.mirror("v", path, state).awaitTermination()
    lake = lambda: text(e.seam("v").lake(live=True).select("id", "event_time", "val"))
    feed(spark, e, "v", path, (1, 1, "I", (1, 10, "a"), None), (2, 1, "I", (2, 20, "b"), None), (3, 1, "U", (2, 250, "b2"), (2, 20, "b")), (4, 1, "I", (3, 30, "c"), None))
    run()
    assert lake() == ["1|10|a", "2|250|b2", "3|30|c"]
    feed(spark, e, "v", path, (5, 2, "U", (2, 150, "__unchanged__"), (2, 250, "b2")), (6, 2, "D", None, (1, 10, "a")), (7, 2, "U", (33, 30, "key"), (3, 30, "c")))
    run()
    assert lake() == ["2|150|b2", "33|30|key"]
    assert e.store.catalog.line(e.store.table("v").id).f == 2
    feed(spark, e, "v", path, (5, 2, "U", (2, 0, "old"), (2, 250, "b2")))  # a replayed transaction
    run()
    assert lake() == ["2|150|b2", "33|30|key"]
    e.insert("v", rows(spark, (2, 150, "b2"), (33, 30, "key")))
    assert e.verify("v")["ok"]
    assert text(e.read_hybrid("v", 50, frontier=2)) == ["2|150|b2", "33|30|key"]
    feed(spark, e, "v", path, (9, 3, "T", None, None))
    with pytest.raises(Exception, match="truncation"):
        run()


def test_fold_sorts_a_share_of_the_batch_only(spark, engine, tmp_path, monkeypatch):
    from ebbline.streaming import mirror

    e, path = engine, str(tmp_path / "feed")
    e.register("v", SCHEMA, ["id"], "event_time", "mirrored", layout=100)
    monkeypatch.setattr(mirror, "FOLD_ROWS", 5, raising=False)
    state, changes = {}, []
    for i in range(400):  # key 7 has half of all changes; every third key ends, and some move
        k = 7 if i % 2 else i % 60
        new = (k, i * 3 % 500, f"v{i}")
        changes.append((i, 1, "D", None, state.pop(k)) if k % 3 == 0 and k in state else (i, 1, "U" if k in state else "I", new, state.get(k)))
        if changes[-1][2] != "D":
            state[k] = new
    feed(spark, e, "v", path, *changes)
    whole, seen = mirror.fold, []

    def fold(*args):
        seen.append(whole(*args))
        return seen[-1]

    monkeypatch.setattr(mirror, "fold", fold)
    e.mirror("v", path, str(tmp_path / "offsets")).awaitTermination()
    assert text(e.seam("v").lake(live=True).select("id", "event_time", "val")) == text(rows(spark, *state.values()))
    assert seen[0].rdd.getNumPartitions() == 80
    plan = seen[0]._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("Exchange") == 1 and "Aggregate" not in plan[plan.index("Exchange") :] and "Sort " not in plan[plan.index("Exchange") :]


def test_mirror_refuses_changes_without_a_key(spark, engine, tmp_path):
    e, path = engine, str(tmp_path / "feed")
    e.register("v", SCHEMA, ["id"], "event_time", "mirrored", layout=100)
    feed(spark, e, "v", path, (1, 1, "I", (1, 10, "a"), None), (2, 1, "I", (None, 20, "b"), None))
    with pytest.raises(Exception, match="no primary key"):
        e.mirror("v", path, str(tmp_path / "offsets")).awaitTermination()


def test_mirror_heap_retention(spark, engine, tmp_path):
    e = engine
    e.register("m", SCHEMA, ["id"], "event_time", "mirrored+heap_retention", width=100, heap_retention=100, cut=-1000)
    data = [(1, 10, "a"), (2, 120, "b"), (3, 250, "c")]
    e.insert("m", rows(spark, *data))
    feed(spark, e, "m", str(tmp_path / "f"), *[(i, 1, "I", d, None) for i, d in enumerate(data)])
    e.mirror("m", str(tmp_path / "f"), str(tmp_path / "o")).awaitTermination()
    assert e.retain_heap("m") is None  # nothing proves that the feed has been applied
    head = e.store.catalog.line(e.store.table("m").id).f + 5
    assert e.retain_heap("m", head) is None and e.retain_heap("m", head) is None
    e.advance_frontier("m", head)
    assert e.retain_heap("m") == 100
    assert text(e.read("m")) == ["1|10|a", "2|120|b", "3|250|c"] and e.seam("m").hot().count() == 2
    e.update("m", {"val": "'A'"}, "id = 1")
    assert text(e.read("m"))[0] == "1|10|A"


def test_initial_copy_resumes(spark, engine):
    e = engine
    e.register("c", SCHEMA, ["id"], "event_time", "mirrored", layout=1000)
    e.insert("c", spark.range(500).select("id", F.col("id").alias("event_time"), F.lit("x").alias("val")))
    first = e.initial_copy("c", 100, max_chunks=2)
    assert not first["done"] and 0 < first["rows"] < 500
    last = e.initial_copy("c", 100)
    assert last["done"] and last["rows"] == 500 and e.verify("c")["ok"]


def test_initial_copy_of_many_chunks_takes_few_commits(spark, engine, monkeypatch):
    e, whole, calls = engine, Store.stage_lake, []

    def stage_lake(*args):
        calls.append(1)
        if len(calls) == 4:
            raise OSError("lost")
        return whole(*args)

    monkeypatch.setattr(Store, "stage_lake", stage_lake)
    e.register("c", SCHEMA, ["id"], "event_time", "mirrored", layout=1000)
    e.insert("c", spark.range(500).select("id", F.col("id").alias("event_time"), F.lit("x").alias("val")))
    with pytest.raises(OSError, match="lost"):
        e.initial_copy("c", 5)
    assert e.seam("c").lake(live=True).count() == 3 * 7 * 5
    last = e.initial_copy("c", 5)
    assert last == {"rows": 500, "chunks": 79, "done": True} and len(calls) <= 4 + load.COMMITS
    assert sorted(r.id for r in e.seam("c").lake(live=True).collect()) == list(range(500)) and e.verify("c")["ok"]


def test_initial_copy_meets_early_places(spark, engine, monkeypatch):
    monkeypatch.setattr(load, "SAMPLE", 1000)
    e = engine
    e.register("c", SCHEMA, ["id"], "event_time", "mirrored", layout=100_000)
    e.insert("c", spark.range(50_000).select("id", F.col("id").alias("event_time"), F.lit("x").alias("val")))
    first = e.initial_copy("c", 20, max_chunks=2)  # fewer rows than lie between two keys of the first sample
    assert first["chunks"] == 2 and 20 <= first["rows"] <= 80
    low = sorted(map(str, range(50_000)))[: first["rows"]]
    assert sorted(str(r.id) for r in e.seam("c").lake(live=True).collect()) == low


def test_maintenance_expires_and_sweeps(spark, engine):
    e = trips(engine, policy={"snapshots_kept": 1, "snapshot_age": -1, "orphan_age": -1, "small_files": 2})
    e.tier("trips")
    e.delete("trips", rows(spark, (1, 10, None)))
    e.compact("trips")
    want = text(e.read("trips"))
    table = e.store.table("trips")
    e.store.stage_lake(table, e.store.prepared(table, rows(spark, (77, 10, "orphan"))), 99)
    out = e.maintain("trips")
    assert out["deletes"] > 0 and out["expired"] > 0 and out["orphans"] > 0
    assert text(e.read("trips")) == want


def test_status_and_cycle(spark, engine):
    e = trips(engine)
    done = e.cycle()
    assert done["trips"]["tier"]["partitions"] == 2
    r = e.status().first()
    assert (r.name, r.hot_rows, r.lake_rows) == ("trips", 1, 4)
    assert r.partitions["dropped"] == 2 and r.partitions["hot"] >= 1


def test_explain_writes_nothing(spark, engine):
    e = trips(engine, "direct")
    e.tier("trips")
    before = e.store.catalog.line(e.store.table("trips").id)
    assert any("mixed" in x for x in e.explain("UPDATE trips SET val = 'x' WHERE id = 1"))
    assert any(x.startswith("rejected") for x in e.explain("UPDATE trips SET val = 'x' WHERE id = 1"))
    assert any("hot" in x for x in e.explain("DELETE FROM trips WHERE event_time >= 200"))
    assert e.explain("SELECT * FROM trips t WHERE EXISTS (SELECT 1 FROM nowhere n WHERE n.id = t.id)")
    assert e.explain("COPY trips FROM 'x'") and e.explain("INSERT INTO trips SELECT 1, 2, 'x'")
    assert e.store.catalog.line(e.store.table("trips").id) == before


def test_plan_leaves_out_a_ruled_out_side(spark, engine):
    e = trips(engine)
    e.tier("trips")
    e.delete("trips", rows(spark, (1, 10, None)))
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftAnti" in plan(e.read("trips"))
    hot = plan(e.read("trips", "event_time >= 210"))
    assert "LeftAnti" not in hot and "Union" not in hot


def test_unregister(spark, engine):
    e = trips(engine)
    e.store.catalog.unregister("trips")
    with pytest.raises(CatalogError):
        e.read("trips")


def test_tokens_and_previews(spark, engine):
    e = trips(engine)
    e.tier("trips")
    with e.pinned("trips") as seam:
        token = e.token(seam)
        e.update("trips", {"val": "'later'"})
        assert text(e.from_token(token).view()) == text(seam.view()) != text(e.read("trips"))
    with pytest.raises(RoutingError):
        e.from_token("x")
    assert (lambda r, more: (len(r), more))(*e.preview("SELECT * FROM trips", 3)) == (3, True)
    assert (lambda r, more: (len(r), more))(*e.preview("SELECT * FROM trips", 5)) == (5, False)
    with pytest.raises(RoutingError):
        e.preview("DELETE FROM trips")
    assert e.partitions("trips", 2).count() == 2 and e.history("trips").first().phase == "done"


def test_transparent_writes_can_be_off(spark, engine):
    e = trips(engine)
    e.tier("trips")
    e.transparent_writes("trips", False)
    with pytest.raises(RoutingError, match="transparent"):
        e.insert("trips", rows(spark, (9, 50, "x")))
    assert e.upsert("trips", rows(spark, (9, 50, "x")))["delta"] == 1
    e.transparent_writes("trips", True)
    assert e.insert("trips", rows(spark, (8, 50, "x")))["delta"] == 1


def test_added_columns(spark, engine):
    e = trips(engine)
    e.tier("trips")
    e.add_columns("trips", "note string")
    e.upsert("trips", rows(spark, (1, 10, "a", "n"), schema=SCHEMA + ", note string"))
    want = ["1|10|a|n", "2|20|b|", "3|110|c|", "4|150|d|", "5|250|e|"]
    assert text(e.read("trips")) == want
    e.compact("trips")
    assert text(e.read("trips")) == want
    with pytest.raises(RoutingError):
        e.add_columns("trips", "val string")


def test_command_line(spark, tmp_path, capsys):
    from ebbline.__main__ import main

    run = lambda *a: main(["--root", str(tmp_path), *a], spark)
    assert run("register", "t", "--schema", SCHEMA, "--pk", "id", "--tier-key", "event_time", "--width", "100", "--lag", "50", "--cut", "100") == 0
    (tmp_path / "r.jsonl").write_text('{"id": 1, "event_time": 5, "val": "a"}\n')
    assert run("ingest", "t", str(tmp_path / "r.jsonl")) == 0
    assert run("policy", "t", "snapshots_kept=2") == 0 and run("maintain", "t") == 0 and run("verify", "t") == 0
    assert run("run", "--cycles", "1") == 0 and run("status") == 0 and run("explain", "SELECT * FROM t") == 0
    assert run("sql", "SELECT count(*) AS n FROM t") == 0 and "|1  |" in capsys.readouterr().out
    assert run("unregister", "t") == 0


LATE = [(91, 15, "late"), (92, 205, "new")]


@pytest.mark.parametrize("mode", ["tiered", "tiered+keep_heap", "direct", "direct+keep_heap"])
@pytest.mark.parametrize("order", ["insert first", "tiering first"])
def test_writes_and_tiering_at_once(spark, engine, mode, order):
    """A row that comes while partitions are tiered is on one side of the line afterwards, whoever commits first."""
    e, other = engine, Engine(spark, engine.store.root, engine.store.catalog.path)
    e.register("c", "id long, k long, v string", ["id"], "k", mode, width=100, lag=50, cut=0)
    e.add_partitions("c", [(0, 100), (100, 200), (200, 300)])
    e.insert("c", spark.createDataFrame([(1, 10, "a"), (2, 160, "b"), (3, 250, "c")], "id long, k long, v string"))
    rows = spark.createDataFrame(LATE, "id long, k long, v string")
    done = []
    name = "stage_lake" if order == "insert first" else "stage_hot"
    stage = getattr(e.store, name)

    def slow(*args):
        out = stage(*args)
        if not done:
            done.append(1)
            other.insert("c", rows) if order == "insert first" else other.tier("c")
        return out

    setattr(e.store, name, slow)
    e.tier("c") if order == "insert first" else e.insert("c", rows)
    assert done and sorted(tuple(r) for r in e.read("c").collect()) == [(1, 10, "a"), (2, 160, "b"), (3, 250, "c"), (91, 15, "late"), (92, 205, "new")]
    assert e.store.catalog.line(e.store.table("c").id).t == 200 and e.verify("c")["ok"]


def test_verify_sees_stranded_rows(spark, engine):
    e = engine
    e.register("c", "id long, k long", ["id"], "k", width=100, lag=50, cut=0)
    e.add_partitions("c", [(0, 100), (100, 200), (200, 300)])
    e.insert("c", spark.createDataFrame([(1, 10), (3, 250)], "id long, k long"))
    e.tier("c")
    assert e.verify("c")["ok"]
    table = e.store.table("c")
    lost = e.store.stage_hot(table, e.store.prepared(table, spark.createDataFrame([(9, 20)], "id long, k long")))
    e.store.catalog.publish(table.id, "hot", lost)  # as no write would
    assert e.verify("c")["untiered"] == 1 and not e.verify("c")["ok"]


def test_sql_writes_by_their_plans(spark, engine):
    e = engine
    e.register("c", "id long, k long, v string, w string", ["id"], "k", width=100, lag=50, cut=200)
    e.sql("INSERT INTO c (id, k, w, v) VALUES (2, 201, 'W', 'V')")
    e.sql("WITH x AS (SELECT 3 AS id, 10 AS k) INSERT INTO c (k, id) SELECT k, id FROM x")
    e.sql("INSERT INTO c BY NAME SELECT 'w4' AS w, 4 AS id, 250 AS k")
    rows = lambda: sorted(tuple(r) for r in e.read("c").collect())
    assert rows() == [(2, 201, "V", "W"), (3, 10, None, None), (4, 250, None, "w4")]
    spark.createDataFrame([(3,), (4,)], "x long").createOrReplaceTempView("ids")
    got = e.sql("UPDATE c SET v = (SELECT max(w) FROM c) WHERE id IN (SELECT x FROM ids) AND EXISTS (SELECT 1 FROM ids)").collect()
    assert sorted((r.id, r.v) for r in got) == [(3, "w4"), (4, "w4")]
    e.sql("DELETE FROM c WHERE id = (SELECT min(x) FROM ids)")
    assert rows() == [(2, 201, "V", "W"), (4, 250, "w4", "w4")]
    for bad in ("INSERT OVERWRITE c SELECT 1, 1, 'a', 'b'", "INSERT INTO c (id, k) VALUES (1, 2, 'x')", "INSERT INTO c (id, nothing) VALUES (1, 2)", "MERGE INTO c USING ids ON c.id = ids.x WHEN MATCHED THEN DELETE"):
        with pytest.raises(Exception):  # noqa: B017, PT011
            e.sql(bad)
    assert len(rows()) == 2
    e.delete_keys("c", [2, {"id": 4}])
    assert rows() == []
    with pytest.raises(RoutingError):
        e.delete_keys("c", [{"k": 4}])


def test_upserts_to_another_place_fold_to_one_row(spark, engine):
    e = engine
    e.register("c", "id long, k long", ["id"], "k", layout=100, cut=1000)
    e.ingest("c", spark.createDataFrame([(5, 5), (6, 6)], "id long, k long"))
    e.upsert("c", spark.createDataFrame([(5, 500)], "id long, k long"))
    want = [(5, 500), (6, 6)]
    assert sorted(map(tuple, e.read("c").collect())) == want
    while e.compact("c"):
        pass
    assert sorted(map(tuple, e.read("c").collect())) == want


def test_files_outside_of_a_condition_are_not_read(spark, engine):
    e = engine
    e.register("c", "id long, k long", ["id"], "k", layout=10, cut=1000)
    e.ingest("c", spark.range(1000).selectExpr("id", "id AS k"))
    assert len(e.read("c").inputFiles()) == 100
    assert len(e.read("c", "k < 10").inputFiles()) == 1 and e.read("c", "k < 10").count() == 10
    for where, files, n in (("k BETWEEN 20 AND 29", 1, 10), ("k IN (5, 995)", 100, 2), ("k = 5 OR k = 17", 2, 2), ("k >= 990 AND id < 995", 1, 5), ("id = 5", 100, 1)):
        got = e.read("c", where)
        assert (len(got.inputFiles()), got.count()) == (files, n), where
    assert e.holds("c", 0, 5) and not e.holds("c", 1000, 1010)


def test_tokens_end_with_their_pin(spark, engine):
    e = engine
    e.register("c", "id long, k long", ["id"], "k", cut=0)
    e.insert("c", spark.createDataFrame([(1, 1)], "id long, k long"))
    with e.pinned("c") as seam:
        token = e.token(seam)
        assert e.from_token(token).view().count() == 1
    with pytest.raises(RoutingError):
        e.from_token(token)
    with pytest.raises(RoutingError):
        e.token(e.seam("c"))
