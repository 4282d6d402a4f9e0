import math
import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ebbline.llm._labels import labelled_sample
from ebbline.llm._text import NOT_ALNUM, Words
from ebbline.llm.quality import features, fit_quality, fit_ranking, score_quality
from ebbline.llm.toxicity import BITS, BLOCK, TOGETHER, Field, chains, document_features, fit_toxicity, forward_backward, score_toxicity, token_features
from ebbline.llm.vector_search import max_score, top_k


def corpus(n=300):
    draw = random.Random(4)
    rows, good, toxic = [], {}, {}
    for i in range(n):
        w = ["".join(draw.choice("aeioulnrst") for _ in range(draw.randrange(2, 9))) for _ in range(draw.randrange(20, 120))]
        good[i], toxic[i] = int(draw.random() < 0.8), int(draw.random() < 0.25)
        if not good[i]:
            w = [x.upper() + "!!" if draw.random() < 0.6 else x for x in w]
        if toxic[i]:
            for _ in range(4):
                w.insert(draw.randrange(len(w)), draw.choice(["zorkface", "blighty", "Zorkfaces,"]))
        rows.append((i, " ".join(w)))
    return rows, good, toxic


@pytest.fixture(scope="module")
def tables(spark):
    rows, good, toxic = corpus()
    docs = spark.createDataFrame([*rows, (900, None), (901, ""), (902, "é" * 40000)], "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([*[(i, good[i], toxic[i]) for i in good], (900, None, None), (None, 1, 1), (5, good[5], toxic[5])], "doc_id long, quality int, toxic int")
    return docs, labels, good, toxic


def test_quality(spark, tables):
    docs, labels, good, _ = tables
    model = fit_quality(docs, labels.filter("doc_id % 3 <> 0"))
    got = {r.doc_id: r for r in score_quality(docs.withColumn("score", F.lit("old")).withColumn("x", F.lit(1)), model).collect()}
    assert len(got) == 303 and all(0 <= r.score <= 1 and r.x == 1 for r in got.values())
    held = [i for i in good if i % 3 == 0]
    assert np.mean([(got[i].score >= 0.7) == good[i] for i in held]) > 0.97
    again = fit_quality(docs.repartition(5), labels.filter("doc_id % 3 <> 0").repartition(4))
    assert np.allclose(again.weights, model.weights) and again.cut == pytest.approx(model.cut)


def test_quality_without_labels(spark, tables):
    docs, labels, *_ = tables
    assert {r.score for r in score_quality(docs, fit_quality(docs, labels.limit(0))).collect()} == {0.5}
    one = fit_quality(docs, labels.filter("quality = 1"))
    assert all(r.score > 0.9 for r in score_quality(docs, one).collect())
    assert score_quality(docs.limit(0), one).collect() == []


def test_ranking_orders_pairs():
    x = np.random.default_rng(0).normal(size=(400, 6))
    label = (x[:, 0] - 0.5 * x[:, 1] > 0).astype(int)
    m = fit_ranking(x, label, 0.7)
    assert ((m.score(x) >= 0.7) == label).mean() > 0.97


def test_features_of_nothing():
    x = features(pa.array([None, "", " \n", "a"]))
    assert np.isfinite(x).all() and x.shape[0] == 4


def test_toxicity(spark, tables):
    docs, labels, _, toxic = tables
    field = fit_toxicity(docs, labels.filter("doc_id % 3 <> 0"))
    got = {r.doc_id: r for r in score_toxicity(docs.withColumn("toxic_spans", F.lit("old")), field).collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    held = [i for i in toxic if i % 3 == 0]
    assert np.mean([(got[i].score >= 0.3) == toxic[i] for i in held]) > 0.97
    spans = [texts[i][s.start : s.end].lower() for i in held if toxic[i] for s in got[i].toxic_spans]
    assert len(spans) > 50 and np.mean([any(w in x for w in ("zorkface", "blighty")) for x in spans]) > 0.95
    assert got[900].toxic_words == got[901].toxic_words == 0 and len(got) == 303


def test_toxicity_without_labels(spark, tables):
    docs, labels, *_ = tables
    out = score_toxicity(docs, fit_toxicity(docs, labels.limit(0))).collect()
    assert len({r.score for r in out}) == 1 and not any(r.toxic_words for r in out)
    assert score_toxicity(docs.limit(0), fit_toxicity(docs, labels.filter("toxic = 0"))).collect() == []


def test_forward_backward_equals_enumeration():
    draw = np.random.default_rng(1)
    move, begin, n = draw.random((2, 2)) + 0.1, 0.7, np.array([1, 4, 3])
    odds = draw.random((3, 4)) * 3
    got, moves = forward_backward(np.where(np.arange(4) < n[:, None], odds, 1.0), n, move, begin)
    want_moves = np.zeros((2, 2))
    for c, size in enumerate(n):
        total, mass, pairs = 0.0, np.zeros(size), np.zeros((2, 2))
        for bits in range(1 << size):
            s = [bits >> t & 1 for t in range(size)]
            p = (begin if s[0] else 1.0) * np.prod([odds[c, t] if s[t] else 1.0 for t in range(size)]) * np.prod([move[a, b] for a, b in zip(s, s[1:], strict=False)])
            total += p
            mass += p * np.array(s)
            for a, b in zip(s, s[1:], strict=False):
                pairs[a, b] += p
        assert np.allclose(got[c, :size], mass / total)
        want_moves += pairs / total
    assert np.allclose(moves, want_moves)


def test_chains_cover_every_word():
    first = np.array([0, 0, 5, 5 + BLOCK, 5 + 3 * BLOCK + 1])
    start, n = chains(first)
    assert sorted(i for a, b in zip(start, n, strict=True) for i in range(a, a + b)) == list(range(first[-1])) and n.max() == BLOCK


def test_tagging_takes_little_memory_and_joins_groups_of_chains():
    draw = np.random.default_rng(2)
    field = Field(draw.normal(size=1 << BITS).astype(np.float32), draw.random((2, 2)) + 0.1, 0.3, np.zeros(5), np.zeros(4), np.ones(4))
    long = " ".join(map(str, draw.integers(0, 10**5, 3 * TOGETHER * BLOCK + 17)))
    words = Words(pa.array([None, "one two", long, "", long[:5000], "three"]), NOT_ALNUM, lower=True)
    tracemalloc.start()
    got = field.marginals(words)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100 * words.starts.size
    emission = np.exp(np.clip(field.weights[token_features(words)].sum(1), -20, 20))
    for start, n in zip(*chains(words.first), strict=True):
        one = forward_backward(emission[None, start : start + n], np.array([n]), field.move, field.begin)[0][0]
        assert np.allclose(got[start : start + n], one, atol=1e-6)


def test_toxicity_reads_and_stores_few(spark, tables, tmp_path):
    """Batches of the reader are bounded, the sample lies in few files, texts stay out of the result if nobody reads them."""
    docs, labels, *_ = tables
    docs.repartition(20).write.parquet(f"{tmp_path}/docs")
    spark.conf.set("spark.sql.parquet.columnarReaderBatchSize", 4096)
    stored = spark.read.parquet(f"{tmp_path}/docs").repartition(20)
    field = fit_toxicity(stored, labels)
    assert int(spark.conf.get("spark.sql.parquet.columnarReaderBatchSize")) <= 256
    sample = [labelled_sample(stored, labels, "doc_id", "text", "toxic", 100, *parts) for parts in ((), (3,))]
    assert sample[1].rdd.getNumPartitions() == 3 and sorted(sample[0].collect()) == sorted(sample[1].collect()) and sample[1].count() == 100
    whole, bare = score_toxicity(stored, field), score_toxicity(stored, field, keep_text=False)
    assert bare.columns == [c for c in whole.columns if c != "text"]
    assert sorted(bare.collect()) == sorted(whole.drop("text").collect())


def brute_top(rows, k=5):
    good = {i: np.floor(256 * np.array(v, float)) for i, v in rows if i is not None and v is not None and None not in v and np.isfinite(np.array(v, float)).all()}
    out = {}
    for q in good:
        if q % 20 == 0:
            scores = sorted(((-int(good[q] @ v), i) for i, v in good.items() if i != q and len(v) == len(good[q])))[:k]
            out[q] = [(i, -s) for s, i in scores]
    return out


@pytest.mark.parametrize("n", [0, 3, 700])
def test_top_k(spark, n):
    draw = random.Random(n)
    rows = [(i, [draw.gauss(0, 0.2) for _ in range(12)]) for i in range(n)]
    if n > 100:
        rows += [(1000 + i, rows[7][1]) for i in range(300)]  # ties
        rows += [(5000, None), (5001, [None] * 12), (5002, [float("nan")] * 12), (5003, [float("inf")] * 12), (5004, [0.5] * 3), (5020, [0.25] * 3), (None, [0.1] * 12), (5040, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("rank", F.lit("x")).repartition(4)
    as_float = [(i, None if v is None else [None if x is None else np.float32(x) for x in v]) for i, v in rows]
    got = {}
    for r in top_k(df, df.filter("vec_id % 20 = 0")).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert got == {q: x for q, x in brute_top(as_float).items() if x}


def test_max_score_skips_and_stays_exact():
    draw = np.random.default_rng(3)
    x = np.floor(draw.normal(size=(24, 6000)) * 40)
    x[:, ::2] = np.floor(x[:, ::2] / 20)
    ids = np.arange(6000) * 3
    for q in np.floor(draw.normal(size=(5, 24)) * 60):
        got = max_score(q, x, x.min(1), x.max(1), ids, 9, 7)
        scores = q @ x
        best = sorted(range(6000), key=lambda i: (-scores[i], ids[i]))
        best = [i for i in best if ids[i] != 9][:7]
        assert got[0].tolist() == [ids[i] for i in best] and got[1].tolist() == [scores[i] for i in best]


def test_scores_of_repeated_and_odd_rows(spark):
    """Rows of one text share a score; clashing columns are replaced; scores are those of the model by itself."""
    bad, good = "BUY!!! $$$ now *** " * 9, "A calm sentence about rivers, written with care. " * 9
    rows = [(i, bad if i % 2 else good) for i in range(40)] + [(1, bad), (1, bad), (50, None), (51, ""), (None, good)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1 - i % 2, i % 2) for i in range(40)], "doc_id long, quality int, toxic int")
    model = fit_quality(docs, labels, at=0.7)
    got = score_quality(docs.withColumn("score", F.lit("x")), model).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.score == pytest.approx(float(model.score(features(pa.array([r.text], pa.string())))[0]), abs=1e-12)
        assert r.text in (None, "") or (r.score >= 0.7) == (r.text == good)
    field = fit_toxicity(docs, labels)
    clash = docs.withColumn("score", F.lit("x")).withColumn("toxic_words", F.lit("y")).withColumn("toxic_spans", F.lit("z"))
    got = score_toxicity(clash, field).collect()
    assert len(got) == len(rows) and len({r.score for r in got if r.doc_id == 1}) == 1
    for r in got:
        words = Words(pa.array([r.text], pa.string()), NOT_ALNUM, lower=True)
        p = field.marginals(words)
        assert r.score == pytest.approx(float(field.score(document_features(p, words.first))[0]), abs=1e-9) and r.toxic_words == int((p > 0.5).sum())


def test_scores_beyond_a_double_are_exact(spark):
    big = [3.0e6, 1.0, -7.0e5]
    rows = [(i, [x * (1 + i / 1024) for x in big]) for i in range(6)] + [(100, big), (100, big), (20, [0.5, 0.25, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = {}
    for r in top_k(df, df.filter("vec_id % 20 = 0"), scale=2.0**9).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    whole = [(i, [math.floor(x * 512) for x in v]) for i, v in rows]
    for q, have in got.items():
        mine = min(v for i, v in whole if i == q)
        want = sorted((-sum(a * b for a, b in zip(mine, v, strict=True)), i) for i, v in whole if i != q)[:5]
        assert have == [(i, -s) for s, i in want]
    assert set(got) == {0, 20, 100} and max(s for _, s in got[100]) > 1 << 53
