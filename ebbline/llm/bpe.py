r"""BPE encoding and decoding with a public vocabulary file, by last-token states on a trie of distinct words.

The BPE encoding of a text is the only segmentation whose neighbouring tokens all stand beside each other in BPE, i.e.
for which no merge across their border comes before the merges that built them. So the encoding of a prefix is known
from its last token and the encodings of shorter prefixes. Distinct words go into a trie; depth-first, each node gets
the last token of its prefix from the nodes above it, once for all words that share the prefix, and only if a node below
asks for it: the longest token that ends a word mostly stands, and the nodes inside it are never asked. A trie in
depth-first order is the sorted list of its words, each sharing its longest common prefix with the one before, and that
is how it is walked: the stack of states above a node is all that is kept. The tokens that end at a node come from an
automaton that runs along: its state is the longest end of the prefix that begins some token. Its states are made as
they are met.

Supported files: `tokenizers` JSON files of byte-level BPE with a word-end suffix, NFC, white space and lower-case
normalisation, and the split pattern below.
"""

from __future__ import annotations

import json
import unicodedata
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession

from ._spark import release, ship

#: Unicode White_Space, and the pattern of words in the normalised text.
_SPACES = "\t\n\x0b\x0c\r \x85\xa0  -     　"
_WORD = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{_SPACES}\p{{L}}\p{{N}}]+")
_SPLIT = regex.compile(f"[{_SPACES}]+")
#: Letters and then these only, no apostrophe, are two words.
_MARKS = '!"#$%&()*+,-./:;<=>?@[\\]^_`{|}~'
#: str.split() also splits at these, which aren't white space here.
_CONTROL = regex.compile("[\x1c-\x1f]")
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Chunks and their words that a task remembers from run to run; beyond, only those of the last run stay. A worker keeps fewer between tasks.
_CACHE, _KEEP = 200_000, 20_000
#: Pairs of neighbours and states of the automaton that are remembered.
_PAIRS, _PLACES = 200_000, 50_000
#: Words of more bytes get the states of all their prefixes in order; asking from the end would nest too deeply.
_DEEP = 200


def _byte_symbols() -> list[str]:
    """The printable character that stands for each byte in the vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {b: chr(b) for b in plain}
    for b in range(256):
        out.setdefault(b, chr(256 + len(out) - len(plain)))
    return [out[b] for b in range(256)]


class _Place(dict):
    """A state of the automaton: the next states by byte, made as they are met; the tokens that end here inside and at the end of words."""

    __slots__ = ("end", "final", "inner", "make")

    def __init__(self, end: bytes, inner: tuple, final: tuple, make):
        self.end, self.inner, self.final, self.make = end, inner, final, make

    def __missing__(self, byte: int) -> _Place:
        to = self[byte] = self.make(self.end + bytes((byte,)))
        return to


class Model:
    """A vocabulary: tokens by bytes, inside and at the end of words, and the rule which tokens may be neighbours."""

    def __init__(self, text: str):
        spec = json.loads(text)
        model = spec["model"]
        self.suffix = model.get("end_of_word_suffix") or ""
        split = [x.get("pattern", {}).get("Regex") for x in (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])]
        if model["type"] != "BPE" or not self.suffix or _PATTERN not in split:
            raise ValueError("not a supported kind of tokenizer file")
        byte = {c: b for b, c in enumerate(_byte_symbols())}
        vocab, self.inner, self.final = model["vocab"], {}, {}
        added = spec.get("added_tokens") or []
        self.special = {t["content"]: t["id"] for t in added}
        self.names = [""] * (max([*vocab.values(), *self.special.values()]) + 1)
        for t, i in [*vocab.items(), *self.special.items()]:
            self.names[i] = t
        for t, i in vocab.items():
            at_end = t.endswith(self.suffix) and len(t) > len(self.suffix)
            core = t[: -len(self.suffix)] if at_end else t
            if all(c in byte for c in core):
                (self.final if at_end else self.inner)[bytes(byte[c] for c in core)] = i
        self.width = len(self.names)  # a pair of tokens is the number left * width + right
        self.rank: dict[int, int] = {}
        self.parts: dict[int, tuple[int, int, int]] = {}
        for r, m in enumerate(model["merges"]):
            a, b = m.split(" ") if isinstance(m, str) else m
            self.rank[vocab[a] * self.width + vocab[b]] = r
            self.parts.setdefault(vocab[a + b], (vocab[a], vocab[b], r))
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self._beside: dict[int, bool] = {}
        # A token that its own bytes don't encode to never appears.
        for table in (self.inner, self.final):
            for piece, t in [*table.items()]:
                if t in self.parts and not self.beside(*self.parts[t][:2], self.parts[t][2]):
                    del table[piece]
        self.size = {t: len(p) for table in (self.inner, self.final) for p, t in table.items()}
        self.begins = {p[:n] for table in (self.inner, self.final) for p in table for n in range(len(p) + 1)}
        self.raw_id = [i.to_bytes(4, "little") for i in range(self.width)]
        self.spoken = pa.array(self.names, pa.string())
        self.chunks: dict[str, bytes] = {}
        self._forget_moves()

    def _forget_moves(self) -> None:
        self._places: dict[bytes, _Place] = {}
        self._start = self._place(b"")

    def _place(self, end: bytes) -> _Place:
        """The automaton's state after a text that ends so."""
        while end not in self.begins:
            end = end[1:]
        if end not in self._places:
            inner, final = (tuple((len(end) - i, table[end[i:]]) for i in range(len(end)) if end[i:] in table) for table in (self.inner, self.final))
            self._places[end] = _Place(end, inner, final, self._place)
        return self._places[end]

    def _edge(self, token: int, side: int) -> list[tuple[int, float]]:
        """The pieces at one end of a token as it was merged (0: left end, 1: right end), each with the rank of the merge that took it up."""
        got, taken = [(token, float("inf"))], 0
        while token in self.parts:
            taken, token = self.parts[token][2], self.parts[token][side]
            got.append((token, taken))
        return got

    def beside(self, left: int, right: int, last: float = float("inf")) -> bool:
        """Whether BPE leaves the border between the two tokens alone (before merge `last`).

        A merge across it happens if it comes before both its pieces are taken up by merges inside their tokens. Of
        equal merges the one further left comes first: inside `left` before the border, the border before `right`.
        """
        rank, rights = self.rank, self._edge(right, 0)
        for x, x_taken in self._edge(left, 1):
            row = x * self.width
            for y, y_taken in rights:
                q = rank.get(row + y)
                if q is not None and q < x_taken and q <= y_taken and q < last:
                    return False
        return True

    def _border(self, pair: int) -> bool:
        """beside() of a pair's number, remembered."""
        out = self._beside[pair] = self.beside(*divmod(pair, self.width))
        return out

    def encode_words(self, words: list[str]) -> dict[str, bytes]:
        """The encodings of distinct words, by walking their trie depth-first."""
        if len(self._beside) > _PAIRS:
            self._beside.clear()
        if len(self._places) > _PLACES:
            self._forget_moves()
        size_of, width, known, raw_id, out = self.size, self.width, self._beside, self.raw_id, {}
        # Above the current node: the last token of each prefix (-1: not asked for yet), and the automaton's state after it.
        tokens, places = [-1], [self._start]

        def last(end: int, here: tuple) -> int:
            """The last token of the path's first `end` bytes, of those that end there."""
            # Longest first; a byte by itself is always a token, and the last resort.
            for size, t in here:
                if size == end:
                    break
                at = end - size
                left = tokens[at]
                if left < 0:
                    left = tokens[at] = last(at, places[at].inner)
                pair = left * width + t
                if pair in known:
                    if known[pair]:
                        break
                elif self._border(pair):
                    break
            return t

        words = sorted(words)  # in the order of their bytes
        raws = [w.encode() for w in words]
        for word, raw, end in zip(words, raws, _shared(raws), strict=True):
            full, place = len(raw), places[end]
            tokens[end + 1 :] = [-1] * (full - end)
            del places[end + 1 :]
            for byte in raw[end:]:
                place = place[byte]
                places.append(place)
            if full > _DEEP:
                for at in range(end or 1, full):
                    if tokens[at] < 0:
                        tokens[at] = last(at, places[at].inner)
            t, end = last(full, place.final), full
            ids = [raw_id[t]]
            while size_of[t] < end:
                end -= size_of[t]
                t = tokens[end]
                ids.append(raw_id[t])
            ids.reverse()
            out[word] = b"".join(ids)
        return out

    def _chunks_of(self, text: str) -> list[str]:
        """The normalised text between white space. A special token has a space before it, which no chunk of a text has."""
        if self.split_special and any(s in text for s in self.special):
            return [c for part in self.split_special.split(text) for c in ([f" {part}"] if part in self.special else self._plain_chunks(part))]
        return self._plain_chunks(text)

    @staticmethod
    def _plain_chunks(text: str) -> list[str]:
        # Lower case character by character: no rule for a sigma at the end of a word.
        text = text.lower() if text.isascii() else unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()
        return [c for c in _SPLIT.split(text) if c] if _CONTROL.search(text) else text.split()

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Token ids of whole texts as little-endian unsigned 32-bit integers."""
        split = [self._chunks_of(t) if t else [] for t in texts]
        every = set(chain.from_iterable(split))
        if len(self.chunks) > _CACHE:
            self.chunks = {c: self.chunks[c] for c in every if c in self.chunks}
        chunks, words, mixed = self.chunks, set(), {}
        known = chunks.__getitem__
        for c in every.difference(chunks):
            if c.isalpha():
                words.add(c)
            elif c[0] == " ":
                chunks[c] = self.raw_id[self.special[c[1:]]]
            else:
                core = c.rstrip(_MARKS)
                mixed[c] = (core, c[len(core) :]) if core.isalpha() else _WORD.findall(c)
        # A word by itself is a chunk too.
        words.update(chain.from_iterable(mixed.values()))
        chunks.update(self.encode_words([w for w in words if w not in chunks]))
        for c, ws in mixed.items():
            chunks[c] = b"".join(map(known, ws))
        return [b"".join(map(known, cs)) for cs in split]

    def rest(self) -> None:
        """Give memory back at the end of a task."""
        if len(self.chunks) > _KEEP:
            self.chunks = {}
        release()

    def decode(self, ids: list[bytes | None]) -> pa.Array:
        """The texts of rows of tokens, joined by one space, as a file without a decoder asks for."""
        flat = np.frombuffer(b"".join([x for x in ids if x]), "<u4").astype(np.int32)
        at = np.concatenate([[0], np.cumsum([len(x) // 4 if x else 0 for x in ids])]).astype(np.int32)
        return pa.compute.binary_join(pa.ListArray.from_arrays(pa.array(at), self.spoken.take(pa.array(flat))), " ")


def _shared(raws: list[bytes], most: int = 32) -> list[int]:
    """How many bytes each word, of distinct ones in order, shares with the one before, so far as `most`."""
    if not raws:
        return []
    size = np.fromiter(map(len, raws), np.int64, len(raws))
    letters = np.array(raws, f"S{most}").view(np.uint8).reshape(-1, most)
    differ = np.ones((len(raws) - 1, most + 1), bool)
    differ[:, :most] = letters[1:] != letters[:-1]
    return [0, *np.minimum(differ.argmax(1), np.minimum(size[1:], size[:-1])).tolist()]


_LOADED: dict[str, Model] = {}


def load(source: Broadcast | str) -> Model:
    """The model, parsed once per process."""
    text = source if isinstance(source, str) else source.value
    if text not in _LOADED:
        _LOADED.clear()
        _LOADED[text] = Model(text)
    return _LOADED[text]


def _vocabulary(spark: SparkSession, path: str) -> Broadcast:
    """The file's text, of a few MB, to every executor: the path need only be there on the driver."""
    ship(spark)
    with open(path, encoding="utf-8") as f:
        return spark.sparkContext.broadcast(f.read())


def _runs(sizes: list[int], most: int = 2 << 20):
    """Ranges of items of about `most` bytes together."""
    at, total = 0, 0
    for i, n in enumerate(sizes):
        total += n
        if total >= most:
            yield at, i + 1
            at, total = i + 1, 0
    if at < len(sizes):
        yield at, len(sizes)


def bpe_encode(docs: DataFrame, vocabulary: str, text_col: str = "text", decoded_col: str | None = None) -> DataFrame:
    """docs with text_col replaced by ids binary (token ids, little-endian unsigned 32-bit) and n_tokens long.

    decoded_col: a string column more, what the ids decode to. It saves bpe_decode a second Python process per task.

    Special tokens written out in a text become their ids; none are added. Null and empty texts have no ids. Columns of
    docs named ids or n_tokens are replaced, all others pass through. An empty table stays empty.
    """
    source = _vocabulary(docs.sparkSession, vocabulary)
    docs = docs.select(*[c for c in docs.columns if c not in ("ids", "n_tokens", decoded_col)])
    rest = [f for f in docs.schema if f.name != text_col]
    at = docs.columns.index(text_col)

    def run(batches):
        model = load(source)
        for batch in batches:
            sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(at)), 0).to_pylist()
            for lo, hi in _runs(sizes):
                ids = model.encode(batch.column(at).slice(lo, hi - lo).to_pylist())
                others = [batch.column(i).slice(lo, hi - lo) for i in range(batch.num_columns) if i != at]
                decoded = [model.decode(ids)] if decoded_col else []
                yield pa.RecordBatch.from_arrays([*others, pa.array(ids, pa.binary()), pa.array([len(x) // 4 for x in ids], pa.int64()), *decoded], names)
        model.rest()

    names = [*[f.name for f in rest], "ids", "n_tokens", *([decoded_col] if decoded_col else [])]
    more = [f"`{decoded_col}` string"] if decoded_col else []
    return docs.mapInArrow(run, ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in rest], "ids binary", "n_tokens long", *more]))


def bpe_decode(rows: DataFrame, vocabulary: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """rows with out_col, the text of the ids. Null and empty ids give an empty text. A column out_col is replaced."""
    source = _vocabulary(rows.sparkSession, vocabulary)
    rows = rows.select(*[c for c in rows.columns if c != out_col])
    names, at = rows.columns, rows.columns.index(ids_col)

    def run(batches):
        model = load(source)
        for batch in batches:
            ids = batch.column(at).to_pylist()
            for lo, hi in _runs([len(x or b"") for x in ids]):
                part = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([*part.columns, model.decode(ids[lo:hi])], [*names, out_col])

    return rows.mapInArrow(run, ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema], f"`{out_col}` string"]))
