"""Line dedup with two Bloom filters, for keys seen in one text and in two or more.

Pass 1 fills the pair of filters, in each task and then, segment by segment, over all tasks. Pass 2 tests every line
against the second filter: only suspected repeats are shuffled, as exact keys, to be counted by distinct text. Keys in
enough texts keep their lines in the largest id only. Texts without a suspect never leave their task.

The filters have a fixed upper size (MAX_SEGMENTS * 128 KiB each), so what is gathered on the driver and broadcast is
bounded. Beyond it they fill up and let more suspects through; the result stays exact, as suspects are confirmed exactly.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import cut, input_bytes, pieces, pow2, ship

SEGMENT_BITS, MAX_SEGMENTS = 1 << 20, 128
_PROBES = 3
_BITS_PER_BYTE = 0.5  # bits of a filter per byte of input: some 20 a line


def line_key(line: bytes) -> bytes:
    r"""The line without [\x20\x09-\x0D] at its ends, A-Z lower-cased."""
    return line.strip().lower()


def _long(key: bytes, least: int) -> bool:
    return len(key) >= least and (len(key) >= 4 * least or len(key.decode("utf-8", "replace")) >= least)


def _keys(text: bytes, least: int) -> set[bytes]:
    return {k for k in map(line_key, text.split(b"\n")) if _long(k, least)}


def _probes(hashes: np.ndarray, segments: int) -> np.ndarray:
    """Bit positions, one row a probe, in a filter of so many segments; all probes of a key are in one segment."""
    base = (hashes >> np.uint64(60 - segments.bit_length() + 1)) % np.uint64(segments) * np.uint64(SEGMENT_BITS)
    return np.stack([base + (hashes >> np.uint64(19 * i)) % np.uint64(SEGMENT_BITS) for i in range(_PROBES)]).astype(np.int64)


def _test(bits: np.ndarray, at: np.ndarray) -> np.ndarray:
    return np.logical_and.reduce((bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1).astype(bool)


def _set(bits: np.ndarray, at: np.ndarray) -> None:
    at = at.ravel()
    np.bitwise_or.at(bits, at >> 3, np.left_shift(np.uint8(1), (at & 7).astype(np.uint8)))


def seen_twice(docs: DataFrame, text_col: str, least: int) -> bytes:
    """The filter of the line keys that two texts or more may hold (no key that they do hold is missing)."""
    ship(docs.sparkSession)
    segments = min(MAX_SEGMENTS, pow2(pieces(int(input_bytes(docs) * 2 * _BITS_PER_BYTE), SEGMENT_BITS, 2)))

    def fill(batches):
        once, twice = np.zeros((2, segments * SEGMENT_BITS // 8), np.uint8)
        for batch in batches:
            found = [xxhash.xxh3_64_intdigest(k) for t in batch.column(0).cast(pa.large_binary()).to_pylist() if t for k in _keys(t, least)]
            keys, n = np.unique(np.array(found, np.uint64), return_counts=True)
            at = _probes(keys, segments)
            _set(twice, at[:, (n > 1) | _test(once, at)])
            _set(once, at)
        for i, (a, b) in enumerate(zip(np.split(once, segments), np.split(twice, segments), strict=True)):
            if a.any():
                yield pa.RecordBatch.from_pydict({"segment": pa.array([i], pa.int32()), "once": pa.array([zlib.compress(a, 1)]), "twice": pa.array([zlib.compress(b, 1)])})

    def merge(key, batches):
        once, twice = np.zeros((2, SEGMENT_BITS // 8), np.uint8)
        for batch in batches:
            for a, b in zip(batch.column("once"), batch.column("twice"), strict=True):
                a = np.frombuffer(zlib.decompress(a.as_py()), np.uint8)
                twice |= np.frombuffer(zlib.decompress(b.as_py()), np.uint8) | (once & a)
                once |= a
        yield pa.RecordBatch.from_pydict({"segment": pa.array([key[0].as_py()], pa.int32()), "twice": pa.array([twice.tobytes()])})

    parts = docs.select(text_col).mapInArrow(fill, "segment int, once binary, twice binary")
    rows = parts.groupBy("segment").applyInArrow(_streamed(merge), "segment int, twice binary").collect()
    whole = bytearray(segments * SEGMENT_BITS // 8)
    for r in rows:
        whole[r.segment * SEGMENT_BITS // 8 : (r.segment + 1) * SEGMENT_BITS // 8] = r.twice
    return bytes(whole)


def _streamed(f):
    """f(key, batches), marked as one that takes a group batch by batch."""
    from collections.abc import Iterator

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from f(key, batches)

    run.__annotations__ = {"key": tuple[pa.Scalar, ...], "batches": Iterator[pa.RecordBatch], "return": Iterator[pa.RecordBatch]}
    return run


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    r"""Drop repeated lines: docs with text_col rewritten, and n_lines and n_dropped (long) added.

    Texts are split at \n; a null or empty text is one empty line and becomes the empty text. A line's key is the line
    stripped of [\x20\x09-\x0D] with A-Z lower-cased. Keys of at least min_chars code points found in at least min_docs
    distinct ids lose all lines but those in the largest such id. Other lines stay, joined by \n.

    Rows of one id count as one document. Rows with a null id keep all lines and count for no key. Columns of docs
    named n_lines or n_dropped are replaced; all others pass through. An empty table stays empty.
    """
    spark = docs.sparkSession
    docs = docs.drop("n_lines", "n_dropped")
    twice = spark.sparkContext.broadcast(seen_twice(docs, text_col, min_chars))
    segments = len(twice.value) * 8 // SEGMENT_BITS

    def suspects_of(texts: pa.Array) -> list[list[str]]:
        bits = np.frombuffer(twice.value, np.uint8)
        keys = [sorted(_keys(t, min_chars)) if t else [] for t in texts.cast(pa.large_binary()).to_pylist()]
        flat = np.array([xxhash.xxh3_64_intdigest(k) for ks in keys for k in ks], np.uint64)
        hit = iter(_test(bits, _probes(flat, segments)).tolist())
        return [[k.decode() for k in ks if next(hit)] for ks in keys]

    names, text_at = docs.columns, docs.columns.index(text_col)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)

    def list_suspects(batches):
        for batch in batches:
            found = suspects_of(batch.column(1))
            ids = np.repeat(np.arange(batch.num_rows), [len(x) for x in found])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(ids)), pa.array([k for x in found for k in x], pa.string())], ["__id", "__key"])

    def with_suspects(batches, has: bool = True):
        for batch in batches:
            mask = pa.array([bool(x) == has for x in suspects_of(batch.column(text_at))], pa.bool_())
            yield batch.filter(mask)

    def rewrite(batches):
        for batch in batches:
            drops = batch.column(len(names)).to_pylist() if batch.num_columns > len(names) else [None] * batch.num_rows
            out, total, gone = [], [], []
            for t, drop in zip(batch.column(text_at).cast(pa.large_binary()).to_pylist(), drops, strict=True):
                lines = (t or b"").split(b"\n")
                kept = lines
                if drop:
                    bad = {k.encode() for k in drop}
                    kept = [x for x in lines if line_key(x) not in bad]
                out.append(b"\n".join(kept))
                total.append(len(lines))
                gone.append(len(lines) - len(kept))
            columns = batch.columns[: len(names)]
            columns[text_at] = pa.array(out, pa.large_binary()).cast(pa.large_string()).cast(columns[text_at].type)
            yield pa.RecordBatch.from_arrays([*columns, pa.array(total, pa.int64()), pa.array(gone, pa.int64())], [*names, "n_lines", "n_dropped"])

    kind = docs.schema[id_col].dataType.simpleString()
    with_id = docs.select(id_col, text_col).filter(F.col(id_col).isNotNull())
    suspects = with_id.mapInArrow(list_suspects, f"__id {kind}, __key string")
    # Stored, so that both sides of the join come from plain exchanges and a hot key can be split.
    repeated = cut(suspects.groupBy("__key").agg(F.count_distinct("__id").alias("__n"), F.max("__id").alias("__last")).filter(F.col("__n") >= min_docs))
    drops = suspects.join(repeated, "__key").filter("__id <> __last").groupBy("__id").agg(F.collect_set("__key").alias("__drop"))
    out = f"{fields}, n_lines long, n_dropped long"
    clean = docs.mapInArrow(lambda batches: rewrite(with_suspects(batches, False)), out)  # both steps in one Python process
    dirty = docs.mapInArrow(with_suspects, docs.schema)
    dirty = dirty.join(drops, dirty[id_col] == drops["__id"], "left").drop("__id").mapInArrow(rewrite, out)
    return clean.unionByName(dirty)
