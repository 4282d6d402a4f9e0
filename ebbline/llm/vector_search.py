"""Exact top-k search by inner product with MaxScore.

A query's terms are its dimensions; a dimension's postings are all vectors' values in it, one array per shard. With the
least and greatest value of a dimension in the shard, its contribution to a score lies between bounds. Terms are ordered
by the width of those bounds; those whose bounds together can't lift any vector to the k-th best score so far are
non-essential. Essential postings are traversed for every vector of a block; the others are probed, widest first, only
for vectors that are still competitive. Shards are searched by themselves and their best rows merged.

Vectors are dealt into shards of bounded size and never copied; queries, far fewer, go to every shard. A task holds one
shard and meets its queries batch by batch, so neither the number of vectors nor that of queries is held in memory.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._spark import input_bytes, pieces, ship

SHARD_BYTES = 8 << 20
_STEP, _PROBE = 2048, 8


def _matrix(vectors: pa.Array, scale: float) -> np.ndarray:
    flat = np.asarray(vectors.flatten()).astype(np.float64)
    return np.floor(flat.reshape(len(vectors), -1) * scale) if len(vectors) else np.zeros((0, 0))


def max_score(query: np.ndarray, postings: np.ndarray, low: np.ndarray, high: np.ndarray, ids: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best (ids, scores) of a shard for a query, by score and then smaller id; ids must ascend.

    postings: one row a dimension; low, high: its least and greatest value.
    """
    a, b = query * low, query * high
    least, most = np.minimum(a, b), np.maximum(a, b)
    order = np.argsort(least - most, kind="stable")  # widest bounds first
    rest = np.concatenate([np.cumsum(most[order][::-1])[::-1], [0]])  # the most that dimensions order[i:] can add
    floor = np.concatenate([[0], np.cumsum(least[order])])
    best_ids, best = np.zeros(0, ids.dtype), np.zeros(0)
    for lo in range(0, ids.size, _STEP):
        at = np.arange(lo, min(lo + _STEP, ids.size))
        at = at[ids[at] != own]
        bar = best[k - 1] if best.size >= k else -np.inf
        # Non-essential: dimensions order[n:], if vectors with the least value in all others can't reach the bar with them.
        n = int(np.argmax(floor + rest < bar)) if (floor + rest < bar).any() else order.size
        n = max(n, 1) if order.size else 0
        score = query[order[:n]] @ postings[order[:n]][:, at] if n else np.zeros(at.size)
        while n < order.size:
            alive = score + rest[n] > bar  # ids ascend: an equal score comes too late
            at, score = at[alive], score[alive]
            if not at.size:
                break
            part = order[n : n + _PROBE]
            score = score + query[part] @ postings[part][:, at]
            n += part.size
        keep = score > bar
        best_ids, best = np.concatenate([best_ids, ids[at[keep]]]), np.concatenate([best, score[keep]])
        top = np.lexsort((best_ids, -best))[:k]
        best_ids, best = best_ids[top], best[top]
    return best_ids, best


def exact_scores(query: np.ndarray, postings: np.ndarray, ids: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The same by whole numbers, for components whose products a double can't hold."""
    other = np.flatnonzero(ids != own)
    score = np.zeros(other.size, object)
    for q, row in zip(query.tolist(), postings, strict=True):
        score = score + int(q) * np.array([int(x) for x in row[other].tolist()], object)
    best = sorted(range(other.size), key=lambda i: (-score[i], ids[other[i]]))[:k]
    if any(not -(1 << 63) <= score[i] < 1 << 63 for i in best):
        raise OverflowError("an inner product doesn't fit a long")
    return ids[other[best]], np.array([score[i] for i in best], np.int64)


class Shard:
    """The vectors of one shard, by dimension."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.postings = ids[order], np.ascontiguousarray(vectors[order].T)
        self.low, self.high = (self.postings.min(axis=1), self.postings.max(axis=1)) if vectors.size else (np.zeros(len(self.postings)), np.zeros(len(self.postings)))
        self.most = np.maximum(np.abs(self.low), np.abs(self.high))

    def search(self, query: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        if np.abs(query) @ self.most < 1 << 53:
            return max_score(query, self.postings, self.low, self.high, self.ids, own, k)
        return exact_scores(query, self.postings, self.ids, own, k)


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = 256.0) -> DataFrame:
    """(query_id, rank int from 1, id_col, score long): the k best vectors of every query, all if there are fewer.

    Components become floor(scale * x), x as double; the score is their exact inner product, an OverflowError if one of
    the best doesn't fit a long. Ties go to the smaller id. Vectors that are null, hold null or non-finite components or
    have a null id take no part, neither do vectors of another length than the query's. Rows with the query's id are its
    own and no candidates; rows of one id are candidates each; as a query, the least vector of an id counts. Other
    columns are not read. Empty tables give no rows.
    """
    ship(vectors.sparkSession)
    good = F.col(id_col).isNotNull() & F.col(vector_col).isNotNull() & F.forall(vector_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.filter(good).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"))
    asked = queries.filter(good).groupBy(F.col(id_col).cast("long").alias("id")).agg(F.min(vector_col).alias("v"))
    shards = pieces(input_bytes(vectors), SHARD_BYTES, 6)
    own = F.pmod(F.xxhash64("id", F.lit(0)), F.lit(shards)).cast("int")
    everywhere = F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))
    columns = lambda df, shard, asks: df.select(shard.alias("shard"), F.size("v").alias("dim"), F.lit(asks).alias("asks"), "id", "v")
    met = columns(rows, own, False).unionByName(columns(asked, everywhere, True))
    # A shard's vectors come first, then its queries.
    met = met.repartition(shards, "shard").sortWithinPartitions("shard", "dim", "asks", "id")

    def search(batches):
        at, ids, parts, shard = None, [], [], None
        for batch in batches:
            keys = np.stack([np.asarray(batch.column(i).cast(pa.int64())) for i in range(3)], 1)
            edges = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), batch.num_rows]
            for lo, hi in zip(edges[:-1], edges[1:], strict=True):
                if lo == hi:
                    continue
                here, asks = tuple(keys[lo, :2].tolist()), keys[lo, 2]
                if here != at:
                    at, ids, parts, shard = here, [], [], None
                part = batch.slice(lo, hi - lo)
                own, x = np.asarray(part.column(3)), _matrix(part.column(4), scale)
                if not asks:
                    ids.append(own)
                    parts.append(x)
                    continue
                if shard is None and ids:
                    shard = Shard(np.concatenate(ids), np.concatenate(parts))
                    ids, parts = [], []
                if shard is None:
                    continue  # no vector of this length here
                out = [shard.search(row, i, k) for row, i in zip(x, own.tolist(), strict=True)]
                asked_by = np.repeat(own, [len(a) for a, _ in out])
                yield pa.RecordBatch.from_arrays([pa.array(asked_by), pa.array(np.concatenate([a for a, _ in out])), pa.array(np.concatenate([b for _, b in out]).astype(np.int64))], ["query_id", "id", "score"])

    found = met.mapInArrow(search, "query_id long, id long, score long")
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", F.col("id").alias(id_col), "score")
