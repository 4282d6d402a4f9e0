r"""Benchmark decontamination on a distributed positional inverted index.

The index is stored by segments of about a MB of text: per segment the terms, where each one's postings begin, and the
postings, i.e. word positions in ascending order. Terms are sorted by a 64-bit hash and kept with their letters: a term is
found by its hash and confirmed by its letters; words of one hash take the next free numbers. A phrase is found from its rarest term in the segment: its
postings, moved back by the term's offset, are the candidate starts, and the other terms' lists, from the rarest on,
are intersected with them after the same move. A segment is searched by itself, so a phrase in a third of all texts
costs its matches and nothing is shuffled.

The benchmark is searched in blocks of bounded size (BLOCK_BYTES of text), each broadcast by itself.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import cut, ship
from ._text import NOT_ALNUM, U64, Words, fitting, rows_within

SEGMENT_BYTES = 1 << 20
#: A benchmark block's text; its windows take some 100 times that on the driver and an executor at most.
BLOCK_BYTES = 1 << 20
_COLUMNS = ["first", "terms", "letters", "sizes", "starts", "gaps"]
_SCHEMA = "segment long, ids array<{0}>, " + ", ".join(f"{c} binary" for c in _COLUMNS)


def _pack(x: np.ndarray) -> bytes:
    return len(raw := x.tobytes()).to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True)


def _unpack(x: bytes, dtype) -> np.ndarray:
    return np.frombuffer(pa.decompress(x[8:], int.from_bytes(x[:8], "little"), "zstd", asbytes=True), dtype)


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    r"""The positional index of all words of all texts, stored in the shared checkpoint folder.

    Words are `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` with A-Z lower-cased. Null and empty texts are in it without words.
    Rows may repeat, ids may be null; other columns of docs are not read. An empty table gives an empty index.
    """
    ship(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def build(batches):
        for batch in batches:
            for lo, hi in rows_within(batch.column(1), SEGMENT_BYTES):
                words = Words(batch.column(1).slice(lo, hi - lo), NOT_ALNUM, lower=True)
                order, terms, starts = _terms(words, words.hashes())
                one = order[starts]
                gaps = np.diff(order, prepend=0).astype(np.int32)
                parts = (words.first.astype(np.int32), terms, words.letters(one), (words.ends - words.starts)[one].astype(np.int32), starts.astype(np.int32), gaps)
                ids = pa.ListArray.from_arrays(pa.array([0, hi - lo], pa.int32()), batch.column(0).slice(lo, hi - lo))
                yield pa.RecordBatch.from_arrays([ids, *[pa.array([_pack(x)]) for x in parts]], ["ids", *_COLUMNS])

    made = docs.select(id_col, text_col).mapInArrow(build, _SCHEMA.format(kind).partition(", ")[2])
    return cut(made.select(F.monotonically_increasing_id().alias("segment"), "*"))


def _terms(words: Words, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word positions by term, the terms' numbers in ascending order, and where each one's positions begin.

    A term's number is its hash, or the next one that no term of other letters has.
    """
    h = h.copy()
    while True:
        order = np.argsort(h, kind="stable")
        terms, starts = np.unique(h[order], return_index=True)
        one = np.repeat(order[starts], np.diff(np.append(starts, h.size)))
        other = order[~words.equal(order, one)]
        if not other.size:
            return order, terms, starts
        h[other] += U64(1)


class Segment:
    """One segment's postings."""

    def __init__(self, first: bytes, terms: bytes, letters: bytes, sizes: bytes, starts: bytes, gaps: bytes):
        self.first, self.terms = _unpack(first, np.int32).astype(np.int64), _unpack(terms, U64)
        ends = np.concatenate([[0], np.cumsum(_unpack(sizes, np.int32), dtype=np.int64)])
        self.letters, self.begin = _unpack(letters, np.uint8).tobytes(), ends
        self.positions = np.cumsum(_unpack(gaps, np.int32), dtype=np.int64)
        self.size = self.positions.size
        self.starts = np.append(_unpack(starts, np.int32).astype(np.int64), self.size)
        # (term, position) as one ascending number.
        self.keys = np.repeat(np.arange(self.terms.size), np.diff(self.starts)) * (self.size + 1) + self.positions

    def lookup(self, vocabulary: list[bytes], h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each term's place and its number of postings, 0 if it isn't there."""
        place, n = np.zeros(h.size, np.int64), np.zeros(h.size, np.int64)
        left, h = np.arange(h.size), h.copy()
        while left.size and self.terms.size:
            at = np.minimum(np.searchsorted(self.terms, h[left]), self.terms.size - 1)
            there = self.terms[at] == h[left]
            left, at = left[there], at[there]
            same = np.array([self.letters[a:b] == vocabulary[i] for i, a, b in zip(left.tolist(), self.begin[at].tolist(), self.begin[at + 1].tolist(), strict=True)], bool)
            place[left[same]] = at[same]
            n[left[same]] = self.starts[at[same] + 1] - self.starts[at[same]]
            left = left[~same]  # another word with this number: the next one
            h[left] += U64(1)
        return place, n

    def text_of(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.first, at, "right") - 1

    def has(self, term: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Whether the term stands at the position."""
        key = term * (self.size + 1) + at
        return self.keys[np.minimum(np.searchsorted(self.keys, key), self.size - 1)] == key

    def expand(self, term: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All postings of the terms: the index of the term's entry, and the position."""
        which = np.repeat(np.arange(term.size), n)
        return which, self.positions[np.repeat(self.starts[term], n) + np.arange(which.size) - np.repeat(np.cumsum(n) - n, n)]

    def phrases(self, vocabulary: list[bytes], h: np.ndarray, windows: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Every occurrence of the windows (rows of places in vocabulary, of given sizes): window and start. h: the vocabulary's hashes."""
        term, n = self.lookup(vocabulary, h)
        inside = np.arange(windows.shape[1]) < sizes[:, None]
        counts = np.where(inside, n[windows], np.iinfo(np.int64).max)
        alive = np.flatnonzero(counts.min(axis=1, initial=np.iinfo(np.int64).max) > 0)
        if not alive.size or not self.size:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        order = np.argsort(counts[alive], axis=1, kind="stable")  # offsets, rarest term first
        rarest = windows[alive, order[:, 0]]
        which, at = self.expand(term[rarest], n[rarest])
        start = at - order[which, 0]
        size = sizes[alive]
        text = self.text_of(at)
        ok = (start >= self.first[text]) & (start + size[which] <= self.first[text + 1])
        which, start = which[ok], start[ok]
        for step in range(1, windows.shape[1]):
            if not which.size:
                break
            offset = order[which, step]
            ok = (step >= size[which]) | self.has(term[windows[alive[which], offset]], np.minimum(start + offset, self.size - 1))
            which, start = which[ok], start[ok]
        return alive[which], start

    def near(self, terms: list[bytes], h: np.ndarray, within: int) -> np.ndarray:
        """Where a span of at most `within` words distance begins that holds every term: a term stands at its begin."""
        term, n = self.lookup(terms, h)
        if not n.size or not n.min():
            return np.zeros(0, np.int64)
        rarest = [int(np.argmin(n))]
        _, at = self.expand(term[rarest], n[rarest])
        may = np.zeros(self.size + 1, np.int32)  # a span holds the rarest term, so it begins at most `within` words before one
        np.add.at(may, np.maximum(at - within, self.first[self.text_of(at)]), 1)
        np.add.at(may, at + 1, -1)
        _, start = self.expand(term, n)
        start = np.sort(start[np.cumsum(may)[start] > 0])
        for t in term:
            base, high = t * (self.size + 1), np.minimum(start + within, self.first[self.text_of(start) + 1] - 1)
            start = start[np.searchsorted(self.keys, base + high, "right") > np.searchsorted(self.keys, base + start)]
        return start


class Phrases:
    """The distinct windows of some items: rows of places in a vocabulary, and the items that hold each."""

    def __init__(self, ids: pa.Array, texts: pa.Array, size: int):
        words = Words(texts, NOT_ALNUM, lower=True)
        n = words.counts
        short = np.flatnonzero((n > 0) & (n < size))
        at = np.concatenate([fitting(words.first, size), words.first[short]])
        sizes = np.concatenate([np.full(at.size - short.size, size), n[short]]).astype(np.int64)
        self.vocabulary, place = words.distinct()
        self.hashes = Words(pa.array(self.vocabulary, pa.binary()), NOT_ALNUM).hashes()
        inside = np.arange(size) < sizes[:, None]
        rows = np.where(inside, place[np.minimum(at[:, None] + np.arange(size), max(place.size - 1, 0))] if place.size else 0, -1)
        rows, one, self.window = np.unique(rows, axis=0, return_index=True, return_inverse=True)
        self.window = self.window.reshape(-1)
        self.windows, self.sizes = np.maximum(rows, 0), sizes[one]
        coded = ids.dictionary_encode()  # rows of one id are one item; a null id is one too
        self.ids = pa.concat_arrays([coded.dictionary, pa.nulls(1, ids.type)])
        item = np.asarray(pa.compute.fill_null(coded.indices.cast(pa.int64()), len(coded.dictionary)))
        self.item = item[np.searchsorted(words.first, at, "right") - 1]
        order = np.argsort(self.window, kind="stable")
        self.window, self.item = self.window[order], self.item[order]
        self.begin = np.searchsorted(self.window, np.arange(len(rows) + 1))

    def items_of(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index into windows, item) for each item that holds the window."""
        n = self.begin[windows + 1] - self.begin[windows]
        which = np.repeat(np.arange(windows.size), n)
        return which, self.item[np.repeat(self.begin[windows], n) + np.arange(which.size) - np.repeat(np.cumsum(n) - n, n)]


def _blocks(items: DataFrame, id_col: str, text_col: str) -> Iterator[pa.Table]:
    """The items in blocks of about BLOCK_BYTES of text."""
    items = items.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter("text IS NOT NULL")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-size // BLOCK_BYTES)
    for i in range(n):
        yield items.filter(F.pmod(F.xxhash64("id", "text"), F.lit(n)) == i).toArrow()


def _spans(cover: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.diff(np.concatenate([[0], cover.astype(np.int8), [0]]))
    return np.flatnonzero(edge > 0), np.flatnonzero(edge < 0)


def find_overlaps(index: DataFrame, items: DataFrame, item_id: str = "item_id", item_text: str = "text", window: int = 10) -> DataFrame:
    """One row per indexed text: id, n_words, n_hit, items (ids of items with an occurring window), spans of hit words.

    A window is `window` consecutive words of an item; an item of fewer words, but not none, is one window. A word
    inside any occurrence of any window is hit. spans: word positions [start, end), merged. An item's id is listed once;
    null item ids hit but aren't listed. No items: no hits.
    """
    kind, item_kind = index.schema["ids"].dataType.elementType.simpleString(), items.schema[item_id].dataType.simpleString()
    out = f"segment long, at int, id {kind}, n_words long, n_hit long, items array<{item_kind}>, spans array<struct<start:int,end:int>>"
    item_type = None
    ship(index.sparkSession)

    def result(segment: int, ids: pa.Array, first: np.ndarray, cover: np.ndarray, text: np.ndarray, item: pa.Array) -> pa.RecordBatch:
        """text, item: pairs of a text and an item's id, sorted by text."""
        n = len(ids)
        total = np.concatenate([[0], np.cumsum(cover)])
        starts, ends = _spans_inside(cover, first)
        of = np.searchsorted(first, starts, "right") - 1
        struct = pa.StructArray.from_arrays([pa.array((starts - first[of]).astype(np.int32)), pa.array((ends - first[of]).astype(np.int32))], ["start", "end"])
        lists = [pa.ListArray.from_arrays(pa.array(np.searchsorted(x, np.arange(n + 1)).astype(np.int32)), y) for x, y in ((text, item), (of, struct))]
        return pa.RecordBatch.from_arrays([pa.array([segment] * n, pa.int64()), pa.array(range(n), pa.int32()), ids, pa.array(np.diff(first), pa.int64()), pa.array(total[first[1:]] - total[first[:-1]], pa.int64()), *lists], ["segment", "at", "id", "n_words", "n_hit", "items", "spans"])

    def searcher(phrases):
        def search(batches):
            for batch in batches:
                for r in range(batch.num_rows):
                    row = batch.slice(r, 1)
                    segment = Segment(*[row.column(c)[0].as_py() for c in _COLUMNS])
                    ids = row.column("ids").flatten()
                    cover = np.zeros(segment.size + 1, np.int32)
                    text, item = np.zeros(0, np.int64), pa.array([], item_type)
                    if phrases is not None:
                        p = phrases.value
                        found, start = segment.phrases(p.vocabulary, p.hashes, p.windows, p.sizes)
                        np.add.at(cover, start, 1)
                        np.add.at(cover, start + p.sizes[found], -1)
                        which, items = p.items_of(found)
                        pairs = np.unique(np.stack([segment.text_of(start)[which], items], 1), axis=0) if which.size else np.zeros((0, 2), np.int64)
                        listed = p.ids.take(pa.array(pairs[:, 1]))
                        keep = np.asarray(listed.is_valid())
                        text, item = pairs[keep, 0], listed.filter(pa.array(keep))
                    yield result(row.column("segment")[0].as_py(), ids, segment.first, np.cumsum(cover[:-1]) > 0, text, item)

        return search

    sc, parts = index.sparkSession.sparkContext, []
    for block in _blocks(items, item_id, item_text):
        block = block.combine_chunks()
        item_type = block["id"].type
        ids = block["id"].combine_chunks() if isinstance(block["id"], pa.ChunkedArray) else block["id"]
        parts.append(index.mapInArrow(searcher(sc.broadcast(Phrases(ids, block["text"], window))), out))
    if not parts:
        from pyspark.sql.pandas.types import to_arrow_type

        item_type = to_arrow_type(items.schema[item_id].dataType)
        return index.mapInArrow(searcher(None), out).drop("segment", "at")
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    if len(parts) > 1:
        rows = whole.groupBy("segment", "at").agg(F.first("id").alias("id"), F.first("n_words").alias("n_words"), F.flatten(F.collect_list("items")).alias("items"), F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"))
        merged = F.aggregate("spans", F.array().cast("array<struct<start:int,end:int>>"), _join_spans)
        whole = rows.select("id", "n_words", F.array_distinct("items").alias("items"), merged.alias("spans"))
        whole = whole.withColumn("n_hit", F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"]))
    return whole.select("id", "n_words", "n_hit", "items", "spans")


def _join_spans(done, s):
    """The spans so far and one more, that starts no earlier."""
    last = F.element_at(done, -1)
    joined = F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"))))
    return F.when((F.size(done) > 0) & (F.try_element_at(done, F.lit(-1))["end"] >= s["start"]), joined).otherwise(F.concat(done, F.array(s)))


def _spans_inside(cover: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of covered words, cut where texts begin."""
    starts, ends = _spans(cover)
    if starts.size:
        edges = np.unique(first)
        inner = edges[(edges > 0) & (edges < cover.size)]
        inner = inner[cover[inner] & cover[inner - 1]]
        starts, ends = np.sort(np.concatenate([starts, inner])), np.sort(np.concatenate([ends, inner]))
    return starts, ends


def find_near(index: DataFrame, terms: list[str], within: int) -> DataFrame:
    """(id, position): where a span begins that holds all the words, its first and last word at most `within` words apart.

    One of the words stands at the position. Only the text itself decides: how texts are dealt to segments doesn't matter.
    """
    kind = index.schema["ids"].dataType.elementType.simpleString()
    ship(index.sparkSession)
    words = Words(pa.array(terms), NOT_ALNUM, lower=True)
    vocabulary, _ = words.distinct()
    h = Words(pa.array(vocabulary, pa.binary()), NOT_ALNUM).hashes()

    def search(batches):
        for batch in batches:
            for r in range(batch.num_rows):
                row = batch.slice(r, 1)
                segment = Segment(*[row.column(c)[0].as_py() for c in _COLUMNS])
                at = segment.near(vocabulary, h, within)
                text = segment.text_of(at)
                yield pa.RecordBatch.from_arrays([row.column("ids").flatten().take(pa.array(text)), pa.array(at - segment.first[text], pa.int64())], ["id", "position"])

    return index.mapInArrow(search, f"id {kind}, position long")
