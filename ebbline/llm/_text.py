"""Words of whole Arrow text columns and their hashes, vectorised.

A word's hash takes its bytes eight at a time through a 64-bit mixer (xxh3 for long words); a window's hash is a tree of
mixed pairs of such hashes. Nothing in either is a polynomial, so no pattern of letters or words makes two of them
equal by construction. All of it is deterministic across processes and machines.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import xxhash

U64 = np.uint64
_MASK = (1 << 64) - 1

#: Byte classes. SPACE: [\x20\x09-\x0D]; NOT_ALNUM: [\x00-\x2F\x3A-\x60\x7B-\x7F].
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
NOT_ALNUM = np.zeros(256, bool)
NOT_ALNUM[:0x30] = NOT_ALNUM[0x3A:0x61] = NOT_ALNUM[0x7B:0x80] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash (a bijection)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def stream(seed: int, n: int) -> np.ndarray:
    """n pseudo-random 64-bit numbers."""
    with np.errstate(over="ignore"):
        return mix((np.arange(1, n + 1, dtype=U64) + U64(seed * 1_000_003 & _MASK)) * U64(0x9E3779B97F4A7C15))


#: Words of more bytes are hashed by xxh3.
_LONG = 64
#: The low n bytes of a number.
_LOW = np.array([(1 << 8 * n) - 1 for n in range(9)], U64)


def rows_within(texts: pa.Array, max_bytes: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about max_bytes of text each, one row at least."""
    ends = np.cumsum(np.asarray(pa.compute.fill_null(pa.compute.binary_length(texts), 0)).astype(np.int64))
    at = 0
    while at < len(ends):
        done = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, done + max_bytes, "right")))
        yield at, to
        at = to


class Words:
    """The words of some texts: word w has the bytes data[starts[w]:ends[w]]; text d has the words first[d]:first[d + 1].

    Nulls have no words.
    """

    def __init__(self, texts: pa.Array, sep: np.ndarray = SPACE, lower: bool = False):
        texts = pa.compute.fill_null(texts.cast(pa.large_binary()), b"")
        if isinstance(texts, pa.ChunkedArray):
            texts = texts.combine_chunks()
        _, offsets, data = texts.buffers()
        offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
        raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and data.size else np.zeros(0, np.uint8)
        self.offsets = offsets - offsets[0]
        self.data = LOWER[raw] if lower else raw
        n = self.data.size
        word = ~sep[self.data]
        edge = self.offsets[(self.offsets > 0) & (self.offsets < n)]
        start, end = word.copy(), word.copy()
        start[1:] &= ~word[:-1]
        end[:-1] &= ~word[1:]
        start[edge] = word[edge]
        end[edge - 1] = word[edge - 1]
        self.starts, self.ends = np.flatnonzero(start), np.flatnonzero(end) + 1
        self.first = np.searchsorted(self.starts, self.offsets)
        padded = np.zeros(n + 8, np.uint8)
        padded[:n] = self.data
        # The eight bytes from each position on, as one number.
        self._eights = np.ndarray((n + 1,), "<u8", padded, strides=(1,))

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def text_of(self) -> np.ndarray:
        """The text of each word."""
        return np.repeat(np.arange(len(self.first) - 1), self.counts)

    def equal(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether words a[i] and b[i] have the same letters."""
        size = self.ends[a] - self.starts[a]
        out = size == self.ends[b] - self.starts[b]
        done, at = 0, np.flatnonzero(out)
        while at.size:
            low = _LOW[np.minimum(size[at] - done, 8)]
            out[at] = (self._eights[self.starts[a[at]] + done] ^ self._eights[self.starts[b[at]] + done]) & low == 0
            done += 8
            at = at[out[at] & (size[at] > done) & (a[at] != b[at])]
            if done == _LONG:
                for i in at.tolist():
                    out[i] = self.data[self.starts[a[i]] : self.ends[a[i]]].tobytes() == self.data[self.starts[b[i]] : self.ends[b[i]]].tobytes()
                break
        return out

    def letters(self, at: np.ndarray) -> np.ndarray:
        """The bytes of some words, one after another."""
        size = self.ends[at] - self.starts[at]
        return self.data[np.repeat(self.starts[at], size) + np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)]

    def distinct(self) -> tuple[list[bytes], np.ndarray]:
        """The distinct words, and the place in them of each word."""
        every = np.arange(self.starts.size)
        ends = np.concatenate([[0], np.cumsum(self.ends - self.starts)])
        coded = pa.LargeBinaryArray.from_buffers(pa.large_binary(), every.size, [None, pa.py_buffer(ends), pa.py_buffer(self.letters(every))]).dictionary_encode()
        return coded.dictionary.to_pylist(), np.asarray(coded.indices).astype(np.int64)

    def spans_hash(self, starts: np.ndarray, ends: np.ndarray, seed: int = 1) -> np.ndarray:
        """64-bit hashes of byte ranges."""
        size = ends - starts
        h = stream(seed, _LONG + 1)[np.minimum(size, _LONG)]
        at = np.arange(size.size)
        for done in range(0, _LONG, 8):
            if done:
                at = np.flatnonzero((size > done) & (size <= _LONG))
                if not at.size:
                    break
            h[at] = mix(h[at] ^ (self._eights[starts[at] + done] & _LOW[np.clip(size[at] - done, 0, 8)]))
        for i in np.flatnonzero(size > _LONG).tolist():
            h[i] = xxhash.xxh3_64_intdigest(self.data[starts[i] : ends[i]], seed)
        return h

    def hashes(self, seed: int = 1) -> np.ndarray:
        """64-bit hashes of the words."""
        return self.spans_hash(self.starts, self.ends, seed)


def _pairs(left: np.ndarray, right: np.ndarray, salt: int) -> np.ndarray:
    """Hashes of ordered pairs of hashes."""
    return mix(left * U64(0x9E3779B97F4A7C15) + mix(right ^ U64(salt)))


def window_hashes(words: np.ndarray, starts: np.ndarray, size: int | np.ndarray, seed: int = 2) -> np.ndarray:
    """64-bit hashes of the windows of `size` words at the given word positions (the windows must fit)."""
    if not isinstance(size, int):
        out = np.zeros(starts.size, U64)
        for n in np.unique(size).tolist():
            out[size == n] = window_hashes(words, starts[size == n], n, seed)
        return out
    if not starts.size:
        return np.zeros(0, U64)
    salts = stream(seed, 64).tolist()
    out, done, width, level = None, 0, 1, words
    while True:  # level[i]: the hash of the `width` words from i on
        if size & width:
            here = level[starts + done]
            out = here if out is None else _pairs(out, here, salts[32 + width.bit_length()])
            done += width
        if done == size:
            return mix(out ^ U64(salts[0]) ^ U64(size))
        level = _pairs(level[:-width], level[width:], salts[width.bit_length()])
        width *= 2


def fitting(first: np.ndarray, size: int) -> np.ndarray:
    """Positions where a window of `size` words starts and ends in one text."""
    counts = np.diff(first)
    n = np.maximum(counts - size + 1, 0)
    return np.repeat(first[:-1], n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)


def member(sorted_keys: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Whether each x is in sorted_keys."""
    if not sorted_keys.size:
        return np.zeros(x.size, bool)
    at = np.searchsorted(sorted_keys, x)
    at[at == sorted_keys.size] = 0
    return sorted_keys[at] == x


def binary(parts: list[np.ndarray]) -> pa.Array:
    return pa.array([np.ascontiguousarray(x).tobytes() for x in parts], pa.binary())


def unpack(column, dtype=U64) -> list[np.ndarray]:
    return [np.frombuffer(x, dtype) for x in column.to_pylist()]
