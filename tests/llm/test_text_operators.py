"""Operators on texts against brute force, on fixtures with nulls, empties, repeats, ties, long texts and clashing columns."""

import collections
import hashlib
import math
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from ebbline.llm import decontaminate
from ebbline.llm.components import connected_components
from ebbline.llm.decontaminate import build_index, find_near, find_overlaps
from ebbline.llm.line_dedup import line_dedup
from ebbline.llm.minhash_dedup import near_duplicates
from ebbline.llm.sharding import rendezvous_shards
from ebbline.llm.substring_dedup import COVER, PERIOD, substring_dedup

DOC = "doc_id long, text string"


def frame(spark, rows, schema=DOC):
    return spark.createDataFrame(rows, schema).repartition(3)


def words_of(draw, n, vocabulary=400):
    return [f"{draw.choice('abcdefgh')}{draw.randrange(vocabulary)}" + draw.choice(["", "", ",", "É"]) for _ in range(n)]


@pytest.fixture(scope="module")
def corpus():
    draw = random.Random(3)
    passages = [" ".join(words_of(draw, n)) for n in (19, 20, 21, 33, 60)]
    out = [(0, None), (1, ""), (2, " \n\t "), (3, "one two"), (4, "\x0b\x0cx\x1cy z")]
    for i in range(5, 70):
        parts = [" ".join(words_of(draw, draw.randrange(1, 60))) for _ in range(draw.randrange(1, 5))]
        for _ in range(draw.randrange(3)):
            parts.insert(draw.randrange(len(parts) + 1), draw.choice(passages))
        out.append((i, draw.choice([" ", "\n", "  ", "\n\n"]).join(parts)))
    out += [(100 + i, out[10 + i % 3][1]) for i in range(12)]
    out += [(200, "a b " * 300), (201, "same " * 45), (202, "same " * 45 + "end")]
    out.append((300, " ".join(words_of(draw, 30000))))
    return out


def test_cover_is_a_difference_set():
    assert {(a - b) % PERIOD for a in COVER for b in COVER} == set(range(PERIOD))


def brute_substring(rows, window=20):
    seen, out = set(), {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            key = tuple(w[k : k + window])
            if key in seen:
                gone[k : k + window] = [True] * window
            seen.add(key)
        out[i] = (len(w), sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g))
    return out


@pytest.mark.parametrize("window", [14, 20])
def test_substring_dedup(spark, corpus, window):
    got = substring_dedup(frame(spark, corpus).withColumn("__group", F.lit("x")).withColumn("n_words", F.lit("x")), window=window).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.text) for r in got} == brute_substring(corpus, window) and len(got) == len(corpus)


def test_substring_dedup_repeated_rows_and_empty(spark):
    text = " ".join(map(str, range(30)))
    got = substring_dedup(frame(spark, [(1, text), (1, text), (None, text), (None, text), (2, None)])).collect()
    assert sorted(r.n_removed for r in got) == [0, 0, 30, 30, 30]
    assert [r.n_removed for r in got if r.doc_id == 1].count(0) == 1
    assert substring_dedup(frame(spark, [])).collect() == []
    with pytest.raises(ValueError):
        substring_dedup(frame(spark, []), window=13)


def brute_lines(rows, least=20, docs=3):
    key = lambda x: x.strip(" \t\n\r\x0b\x0c").translate({c: c + 32 for c in range(65, 91)})
    where = collections.defaultdict(set)
    for i, t in rows:
        for x in (t or "").split("\n"):
            if len(key(x)) >= least:
                where[key(x)].add(i)
    out = {}
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(where[key(x)]) < docs or max(where[key(x)]) == i]
        out[i] = (len(lines), len(lines) - len(kept), "\n".join(kept))
    return out


def test_line_dedup(spark):
    draw = random.Random(5)
    common = ["  All Rights Reserved, everywhere ", "all rights reserved, everywhere\t", "x" * 19, "é" * 20, "É" * 20, "A" * 20, "", "short", "line of the third kind that is long " * 9]
    rows = [(i, None if i == 7 else "" if i == 8 else "\n".join(draw.choice([*common, f"own line number {draw.randrange(10**6)} of this text"]) for _ in range(draw.randrange(1, 9)))) for i in range(80)]
    df = frame(spark, rows).withColumn("n_lines", F.lit("old")).withColumn("__key", F.lit(5))
    got = line_dedup(df).collect()
    assert {r.doc_id: (r.n_lines, r.n_dropped, r.text) for r in got} == brute_lines(rows) and len(got) == 80
    assert {r["__key"] for r in got} == {5} and sum(r.n_dropped for r in got) > 50


def test_line_dedup_edges(spark):
    line = "this line is long enough to count"
    got = line_dedup(frame(spark, [(1, line), (1, line), (2, line), (None, line), (None, line)])).collect()
    assert sum(r.n_dropped for r in got) == 0  # two ids only
    got = line_dedup(frame(spark, [(1, line), (2, f"{line}\n{line}"), (3, f"{line}\n{line}\nx"), (3, line), (None, line)])).collect()
    assert sorted((r.doc_id or 0, r.n_dropped) for r in got) == [(0, 0), (1, 1), (2, 2), (3, 0), (3, 0)]
    assert line_dedup(frame(spark, [])).collect() == []


def shingles(text, size=5):
    w = re.findall(rb"[^\x20\x09-\x0d]+", (text or "").encode().lower())
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set()


def brute_near(rows, percent=85):
    sets, root = {i: shingles(t) for i, t in rows}, {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in sets:
        for j in sets:
            if i < j and sets[i] and (both := len(sets[i] & sets[j])) and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: (len(sets[i]), find(i), find(i) == i) for i in sets}


def near_corpus(n=60):
    """Groups of copies with few and many changed words, around the threshold and chained."""
    draw = random.Random(9)
    out = [(0, None), (1, ""), (2, "a b"), (3, "A  B"), (4, "a b c d e"), (5, "a b c d e f")]
    for g in range(5):
        base = words_of(draw, 150)
        for k in range(n // 5):
            w = list(base)
            for _ in range(draw.choice([0, 0, 1, 2, 2, 3, 4, 6, 9])):
                w[draw.randrange(len(w))] = f"new{draw.randrange(10**6)}"
            out.append((10 + g * 100 + k, " ".join(w)))
    chain = words_of(draw, 200)
    for k in range(8):
        chain = [*chain[7:], *words_of(draw, 7)]
        out.append((900 + k, " ".join(chain)))
    return out


def test_near_duplicates(spark):
    rows = near_corpus()
    got = near_duplicates(frame(spark, rows).withColumn("bucket", F.lit(1))).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got} == brute_near(rows) and len(got) == len(rows)


def test_near_duplicates_compare_in_blocks(spark, monkeypatch):
    from ebbline.llm import minhash_dedup

    monkeypatch.setattr(minhash_dedup, "BLOCK", 4)
    rows = near_corpus(100)
    got = near_duplicates(frame(spark, rows)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got} == brute_near(rows)


def test_near_duplicates_edges(spark):
    text = " ".join(map(str, range(40)))
    got = near_duplicates(frame(spark, [(5, text), (5, text), (7, text.upper()), (None, text), (9, None), (8, " ")])).collect()
    assert sorted((r.doc_id or 0, r.component_id or 0, r.kept) for r in got) == [(0, 0, True), (5, 5, True), (5, 5, True), (7, 5, False), (8, 8, True), (9, 9, True)]
    assert near_duplicates(frame(spark, [])).collect() == []


def test_components(spark):
    edges = [(1, 2), (2, 3), (3, 4), (10, 9), (9, 8), (5, 5), (2, 1), (None, 1)] + [(100 + i, 101 + i) for i in range(40)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 8: 8, 9: 8, 10: 8} | {100 + i: 100 for i in range(41)}


def contract_words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))


def brute_overlaps(docs, items, size=10):
    windows = collections.defaultdict(set)
    for i, t in items:
        w = contract_words(t)
        for k in range(max(len(w) - size + 1, min(len(w), 1))):
            windows[tuple(w[k : k + size])].add(i)
    out = {}
    for d, t in docs:
        w, hit, found = contract_words(t), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if got := windows.get(tuple(w[k : k + n])):
                    hit |= set(range(k, k + n))
                    found |= got
        out[d] = (len(w), len(hit), sorted(x for x in found if x is not None))
    return out


@pytest.mark.parametrize("block", [1 << 20, 200])
def test_overlaps(spark, corpus, monkeypatch, block):
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", block)
    draw = random.Random(1)
    items = [(0, None), (1, ""), (2, "--"), (3, "Same same"), (4, "one TWO"), (None, "x\x1cy z"), (5, corpus[9][1]), (5, corpus[9][1]), (6, " ".join(words_of(draw, 40)))]
    items += [(10 + i, " ".join((corpus[20 + i][1]).split()[3:17])) for i in range(8)]
    got = find_overlaps(build_index(frame(spark, corpus).withColumn("segment", F.lit("x"))), frame(spark, items, "item_id long, text string")).collect()
    assert {r.id: (r.n_words, r.n_hit, sorted(r["items"])) for r in got} == brute_overlaps(corpus, items) and len(got) == len(corpus)
    assert all(r.n_hit == sum(s.end - s.start for s in r.spans) for r in got)


def test_overlaps_edges(spark):
    none = frame(spark, [], "item_id long, text string")
    got = find_overlaps(build_index(frame(spark, [(1, "a b"), (None, None), (1, "a b")])), none).collect()
    assert sorted((r.id or 0, r.n_words, r.n_hit) for r in got) == [(0, 0, 0), (1, 2, 0), (1, 2, 0)]
    some = frame(spark, [(1, "a")], "item_id long, text string")
    assert find_overlaps(build_index(frame(spark, [])), some).collect() == []


def test_near_matches(spark):
    index = build_index(frame(spark, [(1, "red fox and blue hen"), (2, "red x x x x x x hen"), (3, "hen, Red"), (4, None)]))
    assert sorted(r.id for r in find_near(index, ["red", "hen"], 4).collect()) == [1, 3]
    assert find_near(index, ["red", "absent"], 4).collect() == []


def test_near_matches_do_not_depend_on_the_segment(spark):
    rows = [(1, "a x b x c"), (2, "a b c"), (3, "b a c x x a"), (4, "c x x a b")]
    common = {"a": "a " * 9, "b": "b " * 9, "c": "c " * 9}
    want = sorted((i, p) for i, t in rows for p, w in enumerate(t.split()) if w != "x" and {"a", "b", "c"} <= set(t.split()[p : p + 4]))
    assert {i for i, _ in want} == {2, 3}
    for others in ("", "ab", "ac", "bc"):
        filler = [(100 + k, common[w]) for k, w in enumerate(others)]
        for parts in (1, 2, 5):
            index = build_index(spark.createDataFrame(rows + filler, DOC).repartition(parts))
            assert sorted(map(tuple, find_near(index, ["a", "b", "c"], 3).collect())) == want


def test_sharding(spark):
    rows = [(None if i == 5 else i, f"t{i}", i % 7) for i in range(1500)] + [(3, "t3", 3)] * 3
    df = frame(spark, rows, "doc_id long, text string, slot long").drop("slot")
    got = rendezvous_shards(df, ["doc_id"], [1.0] * 16).collect()
    slots = collections.defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert len(got) == len(rows) and all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) == set(range(16))
    assert all(r.grown_shard in (r.shard, 16) for r in got) and 40 < sum(r.grown_shard == 16 for r in got) < 150
    grown = {r.doc_id: r.shard for r in rendezvous_shards(df, ["doc_id"], [1.0] * 17).collect()}
    assert all(grown[r.doc_id] == r.grown_shard for r in got)
    heavy = collections.Counter(r.shard for r in rendezvous_shards(df, ["doc_id"], [1.0, 3.0]).collect())
    assert 2.3 < heavy[1] / heavy[0] < 3.9
    assert rendezvous_shards(frame(spark, []), ["doc_id"], [1.0]).collect() == []
    with pytest.raises(ValueError):
        rendezvous_shards(df, ["doc_id"], [1.0, 0.0])


def test_sharding_query_digests(spark, tmp_path):
    from ebbline.llm.queries import op2_sharding

    rows = [(i, None if i == 3 else "é" * i) for i in range(60)]
    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in op2_sharding(spark, str(tmp_path)).collect()}
    for i, t in rows:
        raw = (t or "").encode()
        assert (got[i]["size"], got[i].text_crc32, got[i].law) == (len(raw) + 1, zlib.crc32(raw), "key")


def test_kept_digest(spark, tmp_path):
    from ebbline.llm.queries import op1_substring_dedup

    frame(spark, [(1, None), (2, "a  b")]).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.kept_sha256 for r in op1_substring_dedup(spark, str(tmp_path)).collect()}
    assert got == {1: hashlib.sha256(b"").hexdigest(), 2: hashlib.sha256(b"a b").hexdigest()}


def test_shards_are_the_winners_of_plain_rendezvous_hashing(spark):
    """The shard recomputed in plain Python; very long texts beside; equal rows keep slots of their own."""
    rows = [(i, f"text {i}") for i in range(400)] + [(7, "text 7"), (None, None), (1000, "long " * 200_000)]
    weights = [1.0, 2.0, 1.0, 0.5, 1.0]

    def winner(key, ws):
        u = lambda i: (int(hashlib.md5(f"{key}#{i}".encode()).hexdigest()[:13], 16) + 0.5) / (1 << 52)
        return min(range(len(ws)), key=lambda i: (-math.log(u(i)) / ws[i], i))

    got = rendezvous_shards(frame(spark, rows), ["doc_id"], weights).collect()
    assert len(got) == len(rows)
    for r in got:
        key = "null" if r.doc_id is None else f"={r.doc_id}"
        assert r.shard == winner(key, weights) and r.grown_shard == winner(key, [*weights, weights[-1]])
    for s in range(len(weights)):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
