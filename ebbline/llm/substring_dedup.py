"""Substring dedup by difference-cover anchors.

Every text is cut into words. A window of `window` words that also starts earlier (smaller id, or earlier in the same
text) is a repeat, and each word a repeat covers goes. Finding repeats doesn't need a hash of every window in a shuffle:

* Anchors of `anchor` words are hashed only at positions whose remainder modulo `PERIOD` is in `COVER`, a perfect
  difference set. For any two equal windows, whatever their positions, some anchor inside both lies on covered
  positions of both texts, as long as anchor + PERIOD - 1 <= window. So a window without a repeated anchor is no repeat.
* Windows that hold a repeated anchor are extended to their full length: 96 bits of two hashes of the window decide,
  which are made from two independent hashes of each word.

Texts are dealt into groups of a few MB by a hash of their id. A group sends each distinct hash once, with whatever it
needs to be compared, packed into one binary row per hash bucket; a bucket answers each group with the hashes that
matter to it. A passage in a third of all texts is so at most one entry per group and never a row per occurrence,
and no group, bucket or answer grows with the input, only their number does.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import input_bytes, pieces, pow2, ship
from ._text import U64, Words, binary, fitting, member, unpack, window_hashes

#: A perfect difference set modulo 13: every remainder is a difference of two of its elements.
PERIOD, COVER = 13, (0, 1, 3, 9)
_GROUP_BYTES, _BUCKET_BYTES = 2 << 20, 4 << 20
_COVERED = np.isin(np.arange(PERIOD), COVER)


def _sorted(table: pa.Table) -> pa.Table:
    """Earlier texts first: by id (nulls last), then by the text's hash."""
    return table.sort_by([("__id", "ascending"), ("__tie", "ascending")]).combine_chunks()


def _anchors(words: Words, hashes: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the anchors at covered positions."""
    at = fitting(words.first, size)
    inside = at - np.repeat(words.first[:-1], np.maximum(words.counts - size + 1, 0))
    at = at[_COVERED[inside % PERIOD]]
    return at, window_hashes(hashes, at, size, 3)


def _candidates(words: Words, repeated: np.ndarray, window: int, anchor: int):
    """Windows holding a repeated anchor: positions and two independent hashes, of 64 and 32 bits."""
    hashes = words.hashes()
    at, h = _anchors(words, hashes, anchor)
    at = at[member(repeated, h)]
    text = np.searchsorted(words.first, at, "right") - 1
    low = np.maximum(words.first[text], at - (window - anchor))
    high = np.minimum(at, words.first[text + 1] - window)
    low, high = low[high >= low], high[high >= low]
    cover = np.zeros(words.starts.size + 1, np.int32)
    np.add.at(cover, low, 1)
    np.add.at(cover, high + 1, -1)
    at = np.flatnonzero(np.cumsum(cover[:-1]) > 0)
    return at, window_hashes(hashes, at, window, 5), window_hashes(words.hashes(8), at, window, 6).astype(np.uint32)


def _runs(h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A stable order that brings equal keys together, and where in it a new key begins."""
    order = np.lexsort((h2, h1))
    a, b = h1[order], h2[order]
    new = np.ones(order.size, bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    return order, new


def _split(keys: np.ndarray, buckets: int) -> tuple[np.ndarray, list[slice]]:
    """The buckets of sorted keys (buckets: a power of two, by the leading bits) and where each one's keys are."""
    bucket = (keys >> U64(65 - buckets.bit_length())).astype(np.int64) if buckets > 1 else np.zeros(keys.size, np.int64)
    starts = np.flatnonzero(np.diff(bucket, prepend=-1))
    ends = np.append(starts[1:], keys.size)[: starts.size]  # no keys: no buckets
    return bucket[starts], [slice(a, b) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 20) -> DataFrame:
    r"""Remove every word inside a window of `window` words that also starts earlier.

    Returns one row per input row: id_col, text_col (the kept words joined by one space), n_words, n_removed.

    Words are `[^\x20\x09-\x0D]+` and compared unchanged. Null and empty texts have no words and give an empty text.
    Other columns of `docs`, whatever their names, are not read. Rows with equal ids are ordered by a hash of their
    text (identical rows: one of them is the first); null ids come after all others. An empty table gives no rows.
    `window` must be at least PERIOD + 1 words.
    """
    anchor = window - PERIOD + 1
    if anchor < 2:
        raise ValueError(f"window must be at least {PERIOD + 1}")
    ship(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    size = input_bytes(docs)
    groups, buckets = pieces(size, _GROUP_BYTES, 12), pow2(pieces(size // 2, _BUCKET_BYTES, 16))
    rows = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text")).withColumn("__tie", F.xxhash64("__text"))
    rows = rows.withColumn("__group", F.pmod(F.coalesce(F.xxhash64("__id") + F.when(F.col("__id").isNotNull(), 0), F.col("__tie")), F.lit(groups)).cast("int"))

    def send_anchors(key, table):
        words = Words(table["__text"])
        _, h = _anchors(words, words.hashes(), anchor)
        keys, n = np.unique(h, return_counts=True)
        full, parts = _split(keys, buckets)
        return pa.table({"bucket": pa.array(full, pa.int32()), "group": pa.array([key[0].as_py()] * len(full), pa.int32()), "keys": binary([keys[p] for p in parts]), "twice": binary([n[p] > 1 for p in parts])})

    def answer_anchors(table):
        parts = unpack(table["keys"])
        keys, twice = np.concatenate(parts), np.concatenate(unpack(table["twice"], bool))
        order, new = _runs(keys, keys)
        run = np.cumsum(new) - 1
        repeated = np.zeros(keys.size, bool)
        repeated[order] = (np.bincount(run) > 1)[run] | twice[order]
        ends = np.cumsum([x.size for x in parts])
        found = [x[m] for x, m in zip(parts, np.split(repeated, ends[:-1]), strict=True)]
        some = [i for i, x in enumerate(found) if x.size]
        return pa.table({"group": table["group"].take(pa.array(some, pa.int64())), "keys": binary([found[i] for i in some])})

    def send_windows(table, answers):
        table = _sorted(table)
        kinds = pa.schema([("bucket", pa.int32()), ("group", pa.int32()), ("a", pa.binary()), ("b", pa.binary()), ("who", pa.binary()), ("ids", pa.list_(table["__id"].type)), ("ties", pa.list_(pa.int64()))])
        if not answers.num_rows or not table.num_rows:
            return kinds.empty_table()
        words = Words(table["__text"])
        at, a, b = _candidates(words, np.sort(np.concatenate(unpack(answers["keys"]))), window, anchor)
        order, new = _runs(a, b)
        firsts = order[new]
        text = np.searchsorted(words.first, at[firsts], "right") - 1
        a, b = a[firsts], b[firsts]
        full, parts = _split(a, buckets)
        # A window names its text by its place in the row's short list of texts.
        texts, who = zip(*[np.unique(text[p], return_inverse=True) for p in parts], strict=True) if parts else ((), ())
        ends = pa.array(np.concatenate([[0], np.cumsum([len(x) for x in texts])]), pa.int32())
        flat = pa.array(np.concatenate([[], *texts]).astype(np.int64))
        lists = [pa.ListArray.from_arrays(ends, table[c].combine_chunks().take(flat) if isinstance(table[c], pa.ChunkedArray) else table[c].take(flat)) for c in ("__id", "__tie")]
        return pa.Table.from_arrays([pa.array(full, pa.int32()), pa.array([table["__group"][0].as_py()] * len(full), pa.int32()), binary([a[p] for p in parts]), binary([b[p] for p in parts]), binary([x.astype(np.uint16 if x.size and x.max() < 65536 else np.uint32) for x in who]), *lists], schema=kinds)

    def answer_windows(table):
        a, b = unpack(table["a"]), unpack(table["b"], np.uint32)
        n = [x.size for x in a]
        group = np.repeat(np.arange(len(a)), n)
        who = [np.frombuffer(x, np.uint16 if len(x) == 2 * k else np.uint32) for x, k in zip(table["who"].to_pylist(), n, strict=True)]
        ids, ties = (table[c].combine_chunks() for c in ("ids", "ties"))
        at = np.concatenate(who).astype(np.int64) + np.repeat(np.cumsum([0, *map(len, ids)])[:-1], n)
        a, b, rank, tie = np.concatenate(a), np.concatenate(b), _rank(ids.flatten())[at], np.asarray(ties.flatten())[at]
        order = np.lexsort((tie, rank, b, a))
        new = np.ones(order.size, bool)
        new[1:] = (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])
        late = np.sort(order[~new])
        out = [late[group[late] == g] for g in np.unique(group[late])]
        return pa.table({"group": table["group"].take(pa.array([int(group[x[0]]) for x in out], pa.int64())), "a": binary([a[x] for x in out]), "b": binary([b[x] for x in out])})

    def drop(table, answers):
        table = _sorted(table)
        words = Words(table["__text"])
        gone = np.zeros(words.starts.size, bool)
        if answers.num_rows:
            anchors = answers.filter(pa.compute.is_valid(answers["keys"]))
            late = answers.filter(pa.compute.is_valid(answers["a"]))
            at, a, b = _candidates(words, np.sort(np.concatenate(unpack(anchors["keys"]))), window, anchor)
            order, new = _runs(a, b)
            repeat = np.ones(order.size, bool)
            repeat[order] = ~new
            if late.num_rows:
                firsts = order[new]
                la, lb = np.concatenate(unpack(late["a"])), np.concatenate(unpack(late["b"], np.uint32))
                both = np.concatenate([la, a[firsts]]), np.concatenate([lb, b[firsts]])
                o, n = _runs(*both)
                at_late = np.zeros(o.size, bool)
                at_late[1:] = ~n[1:]
                elsewhere = np.zeros(o.size, bool)
                elsewhere[o] = at_late
                repeat[firsts] |= elsewhere[la.size :]
            cover = np.zeros(words.starts.size + 1, np.int32)
            np.add.at(cover, at[repeat], 1)
            np.add.at(cover, at[repeat] + window, -1)
            gone = np.cumsum(cover[:-1]) > 0
        removed = np.concatenate([[0], np.cumsum(gone)])
        removed = removed[words.first[1:]] - removed[words.first[:-1]]
        kept = []
        for d, raw in enumerate(table["__text"].cast(pa.large_binary()).to_pylist()):
            part = (raw or b"").split()
            kept.append(b" ".join(itertools.compress(part, ~gone[words.first[d] : words.first[d + 1]]) if removed[d] else part))
        return pa.table({id_col: table["__id"], text_col: pa.array(kept, pa.large_binary()).cast(pa.large_string()).cast(table["__text"].type), "n_words": pa.array(words.counts, pa.int64()), "n_removed": pa.array(removed, pa.int64())})

    by_group = lambda x: rows.groupBy("__group").cogroup(x.groupBy("group"))
    anchors = rows.groupBy("__group").applyInArrow(send_anchors, "bucket int, group int, keys binary, twice binary")
    # One plan, no cut: the exchange of the texts by group is written once and read by all three passes.
    repeated = anchors.groupBy("bucket").applyInArrow(answer_anchors, "group int, keys binary")
    windows = by_group(repeated).applyInArrow(send_windows, f"bucket int, group int, a binary, b binary, who binary, ids array<{kind}>, ties array<long>")
    late = windows.groupBy("bucket").applyInArrow(answer_windows, "group int, a binary, b binary")
    answers = repeated.selectExpr("group", "keys", "cast(null as binary) a", "cast(null as binary) b").unionByName(late.selectExpr("group", "cast(null as binary) keys", "a", "b"))
    return by_group(answers).applyInArrow(drop, f"`{id_col}` {kind}, `{text_col}` string, n_words long, n_removed long")


def _rank(ids: pa.Array) -> np.ndarray:
    """Places of ids in their order, equal ids sharing one; nulls last."""
    return np.asarray(pa.compute.rank(ids, "ascending", null_placement="at_end", tiebreaker="dense")).astype(np.int64)
