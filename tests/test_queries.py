"""Registered queries over whole tables against brute force."""

import collections
import datetime
import os

import pytest

from ebbline import queries
from ebbline.engine import Engine
from ebbline.streaming import mirror

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


@pytest.fixture
def events(spark):
    return spark.read.parquet(f"{SF}/events.parquet").collect()


def test_string_agg_takes_every_row(spark):
    groups = collections.defaultdict(list)
    for r in queries.QUERIES["seam_scan"](spark, SF).collect():
        groups[r.user_id, r.ts.replace(minute=0, second=0, microsecond=0)].append(r.event_id)
    got = queries.QUERIES["seam_string_agg_whole"](spark, SF).collect()
    assert {(r.user_id, r.hour): r.ids for r in got} == {k: ",".join(map(str, sorted(v))) for k, v in groups.items()} and len(got) == len(groups)


@pytest.mark.parametrize("name", ["equality_delete_apply", "maintained_lake"])
def test_folds_go_on_until_nothing_is_left(spark, monkeypatch, name):
    whole = Engine.compact
    monkeypatch.setattr(Engine, "compact", lambda self, q, n=1000: whole(self, q, 1))  # as if each batch were beyond the bound
    want = queries.QUERIES["cold_only"](spark, SF).collect()
    assert sorted(map(tuple, queries.QUERIES[name](spark, SF).collect())) == sorted(map(tuple, want))


def test_writes_take_every_row(spark, events):
    cut = [r for r in events if str(r.ts) < queries.CUT]
    got = queries.QUERIES["delta_only_cold_whole"](spark, SF).collect()
    assert sorted(map(tuple, got)) == sorted((r.event_id + 10**7, r.value) for r in events)
    got = dict(map(tuple, queries.QUERIES["route_counts_whole"](spark, SF).collect()))
    assert got == {"hot": len(events) - len(cut), "delta": len(cut), "lake": 0}
    got = [r for r in queries.QUERIES["insert_select_whole"](spark, SF).collect() if r.event_id >= 7 * 10**7]
    assert sorted(map(tuple, got)) == sorted((r.event_id + 7 * 10**7, r.ts, r.event_type, r.value) for r in events)


@pytest.mark.parametrize("name", ["cdc_fold_state", "hybrid_read"])
def test_mirrored_state_is_folded_in_shares(spark, monkeypatch, name):
    whole, parts = mirror.fold, []

    def fold(*args):
        out = whole(*args)
        parts.append(out.rdd.getNumPartitions())
        return out

    monkeypatch.setattr(mirror, "FOLD_ROWS", 50, raising=False)
    monkeypatch.setattr(mirror, "fold", fold)
    want = []
    for r in spark.read.parquet(f"{SF}/orders.parquet").collect():
        k, at, status, price = r.o_orderkey, r.o_orderdate, r.o_orderstatus, r.o_totalprice
        if k % 7 == 0:
            status, price = "X", price + 1
        elif k % 11 == 0:
            at += datetime.timedelta(days=400)
        elif k % 13 == 0:
            continue
        want.append((k, at, status, price))
    got = queries.QUERIES[name](spark, SF).collect()
    assert sorted(map(tuple, got)) == sorted(want)
    assert max(parts) > len(want) // 50  # the shuffle partitions of the session are 4
