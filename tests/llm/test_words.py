"""Hashes of words and windows, and what operators make of words that simple hashes confuse."""

import numpy as np
import pyarrow as pa
import pytest

from ebbline.llm._text import NOT_ALNUM, Words, fitting, window_hashes
from ebbline.llm.decontaminate import Segment, _pack, _terms, build_index, find_overlaps
from ebbline.llm.minhash_dedup import near_duplicates
from ebbline.llm.substring_dedup import substring_dedup

DOC = "doc_id long, text string"


def thue_morse(n, letters="ab"):
    """A word that polynomials modulo a power of two confuse with the one of swapped letters."""
    return "".join(letters[bin(i).count("1") & 1] for i in range(n))


def test_words_differ():
    texts = [thue_morse(n, x) for n in (128, 256, 1024) for x in ("ab", "ba")] + ["a" * n for n in range(1, 200)] + ["x" * 7 + c + "y" * 60 for c in "abc"]
    words = Words(pa.array([*texts, None, ""]))
    assert len({*words.hashes().tolist()}) == len(texts) and len({*words.hashes(2).tolist(), *words.hashes().tolist()}) == 2 * len(texts)
    assert (Words(pa.array(["x " + texts[3]])).hashes()[1] == words.hashes()[3]).all()  # wherever the word stands


@pytest.mark.parametrize("size", [1, 2, 3, 5, 8, 10, 20, 31])
def test_windows_differ(size):
    draw = np.random.default_rng(size)
    word = draw.integers(0, 2, 600).astype(np.uint64)
    at = fitting(np.array([0, 200, 600]), size)
    h = window_hashes(word, at, size)
    seen = {}
    for a, x in zip(at.tolist(), h.tolist(), strict=True):
        assert seen.setdefault(tuple(word[a : a + size].tolist()), x) == x
    assert len({*seen.values()}) == len(seen)
    mixed = window_hashes(word, at[:2], np.array([1, size]))
    assert mixed[1] == h[1]


def test_equal_words_and_letters():
    words = Words(pa.array(["ab abc abcdefgh abcdefghi abcdefgh " + "z" * 300 + " " + "z" * 300 + " " + "z" * 299 + "y", "ab"]))
    n = words.starts.size
    strings = [bytes(words.data[a:b]) for a, b in zip(words.starts, words.ends, strict=True)]
    for shift in range(n):
        other = (np.arange(n) + shift) % n
        assert words.equal(np.arange(n), other).tolist() == [strings[i] == strings[j] for i, j in enumerate(other)]
    vocabulary, place = words.distinct()
    assert [vocabulary[i] for i in place] == strings and len({*vocabulary}) == len(vocabulary)
    assert bytes(words.letters(np.array([2, 0]))) == b"abcdefghab"


def test_long_words_of_two_letters(spark):
    common = " ".join(f"w{i}" for i in range(19))
    rows = [(1, f"{common} {thue_morse(256, 'ab')}"), (2, f"{common} {thue_morse(256, 'ba')}"), (3, thue_morse(1024, "ab")), (4, thue_morse(1024, "ba"))]
    df = spark.createDataFrame(rows, DOC)
    assert {r.n_removed for r in substring_dedup(df, window=20).collect()} == {0}
    assert {r.component_id for r in near_duplicates(df.filter("doc_id > 2")).collect()} == {3, 4}
    items = spark.createDataFrame([("one", thue_morse(1024, "ba"))], "item_id string, text string")
    assert {r.id: r.n_hit for r in find_overlaps(build_index(df), items).collect()} == {1: 0, 2: 0, 3: 0, 4: 1}


def test_terms_of_one_hash_stay_apart():
    words = Words(pa.array(["ab cd ab ef", "cd gh ab"]), NOT_ALNUM)
    order, terms, starts = _terms(words, np.full(7, 5, np.uint64))
    one = order[starts]
    sizes = (words.ends - words.starts)[one].astype(np.int32)
    segment = Segment(*map(_pack, (words.first.astype(np.int32), terms, words.letters(one), sizes, starts.astype(np.int32), np.diff(order, prepend=0).astype(np.int32))))
    vocabulary = [b"gh", b"ab", b"zz", b"cd", b"ef"]
    place, n = segment.lookup(vocabulary, np.full(5, 5, np.uint64))
    assert n.tolist() == [1, 3, 0, 2, 1] and len({*place[n > 0].tolist()}) == 4
    found, start = segment.phrases(vocabulary, np.full(5, 5, np.uint64), np.array([[3, 1], [1, 4], [1, 2]]), np.array([2, 2, 2]))
    assert sorted(zip(found.tolist(), start.tolist(), strict=True)) == [(0, 1), (1, 2)]


