r"""Toxicity: a linear-chain conditional random field tags toxic words; marginals give document scores and offsets.

Words are `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` with A-Z lower-cased. A word's features are hashes of itself and of some of
its beginnings and ends. Documents carry labels, words don't, so word labels come first: in toxic documents, words with
a feature that is many times as common in toxic documents as in others. The field (two states, emission weights by
feature, transition weights) is trained on blocks of such labelled words by its likelihood's gradient (forward-backward).
A document's score is a logistic function of its words' marginals. Spans are runs of words more likely toxic than not.

Documents are tagged whole, in chains of at most BLOCK words, TOGETHER chains at a time: what tagging takes beside the
words and their marginals doesn't grow with a text. Fitting uses a bounded sample of labelled rows (`sample` rows, BLOCKS
blocks); scoring is one pass without a shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._labels import labelled_sample
from ._spark import read_few, ship
from ._text import NOT_ALNUM, U64, Words, mix, rows_within

SAMPLE, BLOCKS, BLOCK, TOGETHER = 20_000, 6_000, 64, 512
#: Texts of about so many bytes are taken at a time, one text at least.
PIECE = 1 << 18
BITS = 18
_HEADS, _TAILS = (4, 5, 6, 8), (4, 6)
N_FEATURES = 1 + len(_HEADS) + len(_TAILS)


def token_features(words: Words, lo: int = 0, hi: int | None = None) -> np.ndarray:
    """One row of feature numbers per word, from word lo up to word hi."""
    starts, ends = words.starts[lo:hi], words.ends[lo:hi]
    ranges = [(starts, ends), *[(starts, np.minimum(ends, starts + k)) for k in _HEADS], *[(np.maximum(starts, ends - k), ends) for k in _TAILS]]
    with np.errstate(over="ignore"):
        hashes = [mix(words.spans_hash(a, b) + U64(i)) >> U64(64 - BITS) for i, (a, b) in enumerate(ranges)]
    return np.stack(hashes, 1).astype(np.int32) if hashes else np.zeros((0, N_FEATURES), np.int32)


def chains(first: np.ndarray, size: int = BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """The words of each text in chains: first word and number of words."""
    n = -(-np.diff(first) // size)
    text = np.repeat(np.arange(n.size), n)
    start = first[text] + size * (np.arange(text.size) - np.repeat(np.cumsum(n) - n, n))
    return start, np.minimum(size, first[text + 1] - start)


def forward_backward(odds: np.ndarray, n: np.ndarray, move: np.ndarray, begin: float, moves: bool = True) -> tuple[np.ndarray, np.ndarray | None]:
    """Marginals of the toxic state, and the expected number of each move (2 x 2) if `moves`, for chains of n words.

    odds: one row a chain, the toxic state's emission weight relative to the other's. move: transition weights.
    """
    rows, size = odds.shape
    alpha, beta = np.empty((2, size, rows)), np.ones((2, size, rows))
    e = np.ascontiguousarray(odds.T)
    a0, a1 = np.ones(rows), begin * e[0]
    for t in range(size):
        if t:
            a0, a1 = a0 * move[0, 0] + a1 * move[1, 0], (a0 * move[0, 1] + a1 * move[1, 1]) * e[t]
        total = a0 + a1
        a0, a1 = a0 / total, a1 / total
        alpha[0, t], alpha[1, t] = a0, a1
    b0, b1 = np.ones(rows), np.ones(rows)
    for t in range(size - 2, -1, -1):
        inside = t + 1 < n
        c1 = e[t + 1] * b1
        d0, d1 = move[0, 0] * b0 + move[0, 1] * c1, move[1, 0] * b0 + move[1, 1] * c1
        total = d0 + d1
        b0, b1 = np.where(inside, d0 / total, 1.0), np.where(inside, d1 / total, 1.0)
        beta[0, t], beta[1, t] = b0, b1
    both = alpha * beta
    marginal = both[1] / (both[0] + both[1])
    if not moves:  # only fitting needs them
        return marginal.T, None
    pairs = alpha[:, None, :-1] * move[:, :, None, None] * (beta[None, :, 1:] * np.stack([np.ones_like(e[1:]), e[1:]])[None])
    valid = (np.arange(1, size)[:, None] < n)[None, None]
    pairs = pairs / pairs.sum((0, 1)) * valid
    return marginal.T, pairs.sum((2, 3))


@dataclass
class Field:
    """A fitted field and the logistic function of a document's marginals."""

    weights: np.ndarray
    move: np.ndarray
    begin: float
    document: np.ndarray
    mean: np.ndarray
    scale: np.ndarray

    def marginals(self, words: Words) -> np.ndarray:
        """The probability of each word to be toxic."""
        out = np.zeros(words.starts.size)
        every_start, every_n = chains(words.first)
        for at in range(0, every_start.size, TOGETHER):  # their words follow one another
            start, n = every_start[at : at + TOGETHER], every_n[at : at + TOGETHER]
            lo, hi = start[0], start[-1] + n[-1]
            inside = np.arange(BLOCK) < n[:, None]
            odds = np.ones(inside.shape, self.weights.dtype)
            odds[inside] = np.exp(np.clip(self.weights[token_features(words, lo, hi)].sum(1), -20, 20))
            out[lo:hi] = forward_backward(odds, n, self.move, self.begin, moves=False)[0][inside]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.clip(((x - self.mean) / self.scale) @ self.document[1:] + self.document[0], -30, 30)
        return 1 / (1 + np.exp(-z))


def document_features(marginals: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Of each text's marginals: the largest, the expected number, that number per word, whether there is any likely one."""
    n = np.diff(first)
    some = np.flatnonzero(n)
    top, total, likely = np.zeros((3, n.size))
    if some.size:
        top[some] = np.maximum.reduceat(marginals, first[some])
        total[some] = np.add.reduceat(marginals, first[some])
        likely[some] = np.add.reduceat((marginals > 0.5).astype(float), first[some])
    return np.stack([top, np.log1p(total), total / np.maximum(n, 1) ** 0.5, np.minimum(likely, 3)], 1)


def telling(toxic: np.ndarray, clean: np.ndarray, n_toxic: int, n_clean: int, times: float = 12.0, least: int = 4) -> np.ndarray:
    """Features whose share of toxic documents is `times` that of the others at least, chance aside."""
    share = (toxic - np.sqrt(toxic)) / max(n_toxic, 1)
    return (toxic >= least) & (share >= times * (clean + 0.5) / (n_clean + 1))


def fit_field(f: np.ndarray, n: np.ndarray, label: np.ndarray, rounds: int = 12, rate: float = 0.3, decay: float = 1e-4) -> tuple[np.ndarray, np.ndarray, float]:
    """Emission weights, moves and begin weight from chains: features (chain, word, feature), lengths, labels (chain, word)."""
    w = np.zeros(1 << BITS)
    inside = np.arange(f.shape[1]) < n[:, None]
    pairs = lambda a, b, m: np.array([[(x * y * m).sum() for y in (1 - b, b)] for x in (1 - a, a)])
    follow = inside[:, 1:]
    seen = pairs(label[:, :-1], label[:, 1:], follow) + 1.0
    move = seen / seen.sum(1, keepdims=True)
    begin = (label[:, 0].sum() + 1.0) / ((1 - label[:, 0]).sum() + 1.0)
    square, move_square, base = np.full(w.size, 1e-6), np.full((2, 2), 1e-6), np.log(move)
    draw = np.random.Generator(np.random.PCG64(5))
    for _ in range(rounds):
        for part in np.array_split(draw.permutation(len(f)), max(1, len(f) // 500)):
            where = inside[part]
            odds = np.where(where, np.exp(np.clip(w[f[part]].sum(2), -20, 20)), 1.0)
            marginal, moves = forward_backward(odds, n[part], np.exp(base), begin)
            error = ((label[part] - marginal) * where)[where]
            g = np.bincount(f[part][where].ravel(), np.repeat(error, f.shape[2]), minlength=w.size) - decay * w * len(part)
            square += g * g
            w += rate * g / np.sqrt(square)
            gm = pairs(label[part][:, :-1], label[part][:, 1:], where[:, 1:]) - moves
            move_square += gm * gm
            base += 0.05 * gm / np.sqrt(move_square)
    return w, np.exp(base - base.max()), float(begin)


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weights (the constant first) on standardised columns, their means and scales."""
    mean, scale = (x.mean(0), np.maximum(x.std(0), 1e-6)) if len(x) else (np.zeros(x.shape[1]), np.ones(x.shape[1]))
    z = np.column_stack([np.ones(len(x)), (x - mean) / scale])
    w = np.zeros(z.shape[1])
    penalty = ridge * np.eye(w.size)
    penalty[0, 0] = 0.1
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        w = w + np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + penalty, z.T @ (y - p) - penalty @ w)
    return w, mean, scale


def fit_toxicity(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> Field:
    """Learn from at most `sample` labelled rows. Without toxic rows nothing is telling and scores are the labels' share."""
    read_few(docs.sparkSession)
    parts = labelled_sample(docs, labels, id_col, text_col, label_col, sample, parts=8).select("id", "text", "label")

    def count(batches):
        counts, n = np.zeros((2, 1 << BITS), np.int32), np.zeros(2, np.int64)
        for batch in batches:
            for lo, hi in rows_within(batch.column(1), PIECE):
                words = Words(batch.column(1).slice(lo, hi - lo), NOT_ALNUM, lower=True)
                f, label = token_features(words).astype(np.int64), np.asarray(batch.column(2).slice(lo, hi - lo))
                keys = np.unique((words.text_of[:, None] << BITS | f).ravel())
                for y in (0, 1):
                    counts[y] += np.bincount(keys[label[keys >> BITS] == y] & ((1 << BITS) - 1), minlength=1 << BITS).astype(np.int32)
                    n[y] += (label == y).sum()
        yield pa.RecordBatch.from_pydict({"counts": pa.array([counts.tobytes()], pa.binary()), "clean": pa.array([n[0]]), "toxic": pa.array([n[1]])})

    got = parts.mapInArrow(count, "counts binary, clean long, toxic long").collect()
    counts = sum([np.frombuffer(r.counts, np.int32).reshape(2, -1) for r in got], np.zeros((2, 1 << BITS)))
    tells = telling(counts[1], counts[0], sum(r.toxic for r in got), sum(r.clean for r in got))

    def blocks(batches):
        for batch in batches:
            for lo, hi in rows_within(batch.column(1), PIECE):
                words = Words(batch.column(1).slice(lo, hi - lo), NOT_ALNUM, lower=True)
                f, label = token_features(words), np.asarray(batch.column(2).slice(lo, hi - lo))
                word_label = tells[f].any(1) & (label[words.text_of] == 1)
                start, n = chains(words.first)
                toxic = np.add.reduceat(word_label, start) > 0 if start.size else np.zeros(0, bool)
                # A chain of a toxic document may hold toxic words that nothing tells: only clean ones teach the clean state.
                use = np.flatnonzero(toxic | (label[np.searchsorted(words.first, start, "right") - 1] == 0))
                yield pa.RecordBatch.from_arrays([pa.array([f[start[i] : start[i] + n[i]].tobytes() for i in use], pa.binary()), pa.array([word_label[start[i] : start[i] + n[i]].tobytes() for i in use], pa.binary()), pa.array(toxic[use])], ["f", "y", "toxic"])

    made = parts.mapInArrow(blocks, "f binary, y binary, toxic boolean")
    order = F.xxhash64("f", "y")
    picked = [made.filter(F.col("toxic") == x).orderBy(order).limit(BLOCKS // 2).collect() for x in (True, False)]
    picked = [r for rs in picked for r in rs]
    if picked:
        n = np.array([len(r.y) for r in picked])
        f, y = np.zeros((len(picked), BLOCK, N_FEATURES), np.int32), np.zeros((len(picked), BLOCK))
        for i, r in enumerate(picked):
            f[i, : n[i]] = np.frombuffer(r.f, np.int32).reshape(-1, N_FEATURES)
            y[i, : n[i]] = np.frombuffer(r.y, bool)
        weights, move, begin = fit_field(f, n, y)
    else:
        weights, move, begin = np.zeros(1 << BITS), np.full((2, 2), 0.5), 1.0
    field = Field(weights.astype(np.float32), move, begin, np.zeros(5), np.zeros(4), np.ones(4))

    def look(batches):
        for batch in batches:
            for lo, hi in rows_within(batch.column(1), PIECE):
                words = Words(batch.column(1).slice(lo, hi - lo), NOT_ALNUM, lower=True)
                x = document_features(field.marginals(words), words.first)
                yield pa.RecordBatch.from_arrays([pa.array(list(x), pa.list_(pa.float64())), batch.column(2).slice(lo, hi - lo)], ["x", "y"])

    got = parts.mapInArrow(look, "x array<double>, y int").toArrow()
    x, y = np.array(got["x"].to_pylist(), float).reshape(-1, 4), np.asarray(got["y"]).astype(float)
    order = np.lexsort((*x.T, y))
    field.document, field.mean, field.scale = fit_logistic(x[order], y[order])
    return field


def score_toxicity(docs: DataFrame, field: Field, text_col: str = "text", keep_text: bool = True) -> DataFrame:
    """docs with score double (0 to 1, higher: likelier toxic), toxic_words long and toxic_spans.

    toxic_spans array<struct<start:long,end:long>>: code-point offsets [start, end) of runs of words more likely toxic
    than not. Null and empty texts have no words and the score that goes with none. Columns of docs with these names
    are replaced, all others pass through, text_col only if `keep_text`: texts nobody reads needn't come back from
    Python. An empty table stays empty.
    """
    ship(docs.sparkSession)
    read_few(docs.sparkSession)
    docs = docs.select(*[c for c in docs.columns if c not in ("score", "toxic_words", "toxic_spans")])
    at = docs.columns.index(text_col)
    kept = [i for i in range(len(docs.columns)) if keep_text or i != at]
    names, fields = [docs.columns[i] for i in kept], [docs.schema[i] for i in kept]

    def run(batches):
        for batch in batches:
            for lo, hi in rows_within(batch.column(at), PIECE):
                part = batch.slice(lo, hi - lo)
                words = Words(part.column(at), NOT_ALNUM, lower=True)
                p = field.marginals(words)
                score = field.score(document_features(p, words.first))
                bad = p > 0.5
                text = words.text_of
                begins, ends = bad.copy(), bad.copy()
                begins[1:] &= ~(bad[:-1] & (text[1:] == text[:-1]))
                ends[:-1] &= ~(bad[1:] & (text[1:] == text[:-1]))
                points = np.concatenate([[0], np.cumsum((words.data & 0xC0) != 0x80)])
                own = points[words.offsets[text[begins]]]
                starts, stops = points[words.starts[begins]] - own, points[words.ends[ends]] - own
                cuts = pa.array(np.searchsorted(text[begins], np.arange(part.num_rows + 1)).astype(np.int32))
                spans = pa.ListArray.from_arrays(cuts, pa.StructArray.from_arrays([pa.array(starts, pa.int64()), pa.array(stops, pa.int64())], ["start", "end"]))
                yield pa.RecordBatch.from_arrays([*[part.column(i) for i in kept], pa.array(score), pa.array(np.bincount(text[bad], minlength=part.num_rows), pa.int64()), spans], [*names, "score", "toxic_words", "toxic_spans"])

    return docs.mapInArrow(run, ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in fields], "score double, toxic_words long, toxic_spans array<struct<start:bigint,end:bigint>>"]))
