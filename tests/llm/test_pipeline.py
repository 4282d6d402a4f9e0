"""The pipeline's stages against brute force, each on its own input."""

import os
import random
import sys

import numpy as np
import pytest

sys.path.insert(0, os.path.dirname(__file__))
from test_text_operators import brute_lines, brute_near, brute_overlaps, shingles

import corpus_pipeline
from ebbline.llm.quality import fit_quality, score_quality
from ebbline.llm.queries import QUALITY_AT, learnable

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


def test_stages(spark, tmp_path):
    import public_tokenizers
    import tokenizers

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    steps = []
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        if i < 4:
            assert out.columns == corpus_pipeline.COLUMNS
        out.write.parquet(f"{tmp_path}/{i}")
        steps.append((name, docs.collect(), (docs := spark.read.parquet(f"{tmp_path}/{i}")).collect()))
    texts = [[{r.doc_id: r.text for r in rows} if "text" in rows[0] else rows for rows in s[1:]] for s in steps]
    (_, before, after), labels = steps[0], spark.read.parquet(f"{SF}/labels.parquet")
    source = spark.read.parquet(f"{SF}/documents.parquet")
    good = {r.doc_id for r in score_quality(source, fit_quality(source, learnable(labels))).filter(f"score >= {QUALITY_AT}").collect()}
    assert {r.doc_id for r in after} == good and 0 < len(after) < len(before)
    want = brute_lines(list(texts[1][0].items()))
    assert texts[1][1] == {i: t for i, (_, _, t) in want.items()} and all(r.n_chars == len(r.text) for r in steps[1][2])
    want = brute_near(list(texts[2][0].items()), 80)
    assert set(texts[2][1]) == {i for i, (_, _, kept) in want.items() if kept}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    want = brute_overlaps(list(texts[3][0].items()), items)
    assert set(texts[3][1]) == {i for i, (_, hit, _) in want.items() if not hit}
    library = tokenizers.Tokenizer.from_file(str(public_tokenizers.path("word_bpe_49k.json")))
    tokens = {r.doc_id: np.frombuffer(r.ids, "<u4").tolist() for r in steps[4][2]}
    assert tokens == {i: library.encode(t, add_special_tokens=False).ids for i, t in texts[4][0].items()}
    ran = {r.doc_id: r.ids_sha256 for r in corpus_pipeline.run(spark, SF).collect()}
    assert ran == {r.doc_id: r.ids_sha256 for r in steps[4][2]}


def test_empty_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.collect() == []


def test_near_stage_links_from_four_fifths_on(spark):
    draw = random.Random(21)
    rows = []
    for g in range(6):
        words = [f"g{g}w{k}" for k in range(300)]
        rows.append((100 * g, " ".join(words)))
        for k in range(1, 9):  # replaced words far from each other: five shingles each
            w = list(words)
            for at in draw.sample(range(10, 290, 10), k):
                w[at] = f"new{draw.randrange(10**9)}"
            rows.append((100 * g + k, " ".join(w)))
    low = [f"x{k}" for k in range(104)]
    rows += [(1000, " ".join(low)), (1001, " ".join([*low[10:], *[f"y{k}" for k in range(10)]]))]  # 90 of 110 shingles: 0.818
    sets = {i: shingles(t) for i, t in rows}
    share = [len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a in sets for b in sets if a < b]
    assert sum(0.8 <= s < 0.85 for s in share) > 10
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    got = {r.doc_id for r in corpus_pipeline.near(spark, docs, SF).collect()}
    want = {i for i, (_, _, kept) in brute_near(rows, 80).items() if kept}
    assert got == want != {i for i, (_, _, kept) in brute_near(rows, 85).items() if kept}


def test_whole_run_from_the_lines_on(spark):
    """What the last three stages keep and encode, against brute force with links from 0.8 on."""
    import public_tokenizers
    import tokenizers

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:2]:
        docs = stage(spark, docs, SF)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    near = brute_near(rows, 80)
    kept = [(i, t) for i, t in rows if near[i][2]]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    hit = brute_overlaps(kept, items)
    library = tokenizers.Tokenizer.from_file(str(public_tokenizers.path("word_bpe_49k.json")))
    want = {i: library.encode(t, add_special_tokens=False).ids for i, t in kept if not hit[i][1]}
    assert {r.doc_id: np.frombuffer(r.ids, "<u4").tolist() for r in corpus_pipeline.run(spark, SF).collect()} == want


def test_rows_without_an_id_are_decontaminated(spark):
    passage = spark.read.parquet(f"{SF}/benchmark.parquet").filter("text IS NOT NULL").orderBy("item_id").first().text
    texts = [(None, f"before {passage} after"), (None, "a clean text"), (None, None), (1, passage), (2, "another clean text"), (3, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in texts], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    got = [(r.doc_id, r.text) for r in corpus_pipeline.decontaminate(spark, docs, SF).collect()]
    assert sorted(got, key=str) == sorted([texts[1], texts[2], texts[4], texts[5]], key=str)
