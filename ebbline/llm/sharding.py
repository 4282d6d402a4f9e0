"""Rendezvous hashing of stable record keys over weighted shards, in DataFrame expressions only.

A record scores every shard with -ln(u) / weight, u in (0, 1) from a hash of (key, shard), and goes to the least score.
The score of a shard doesn't depend on the others, so a further shard only takes records into itself: 1 of n + 1 of
them on average. The law is `key`: key and shard list decide, nothing else.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._spark import input_bytes, pieces, pow2

_BITS = 52  # 13 hexadecimal digits: exact in a long and in a double
#: Rows of a numbering part, by bytes of input; a part is one window partition.
_PART_BYTES = 8 << 20


def _bits(text: Column) -> Column:
    return F.conv(F.substring(F.md5(text), 1, _BITS // 4), 16, 10).cast("long")


def key_text(*keys: Column) -> Column:
    """Keys as one text; a null differs from every text."""
    return F.concat_ws("\x1f", *[F.coalesce(F.concat(F.lit("="), k.cast("string")), F.lit("null")) for k in keys])


def shard_scores(key: Column, weights: Sequence[float]) -> Column:
    """array<struct<score,shard>>: each shard's score for the key."""
    if not weights or min(weights) <= 0:
        raise ValueError("weights must be positive")
    scores = [F.struct((-F.log((_bits(F.concat(key, F.lit(f"#{i}"))) + 0.5) / float(1 << _BITS)) / float(w)).alias("score"), F.lit(i).alias("shard")) for i, w in enumerate(weights)]
    return F.array(*scores)


def winner(scores: Column) -> Column:
    """The shard of the least score; of equal scores the smaller shard."""
    return F.array_min(scores)["shard"]


def rendezvous_shards(rows: DataFrame, keys: Sequence[str], weights: Sequence[float], grown_weight: float | None = None) -> DataFrame:
    """Add shard int, slot long and grown_shard int to the rows.

    shard: by rendezvous hashing of the key columns over len(weights) weighted shards. slot: gapless from 0 inside each
    shard, in the order of a hash of the row's key and further columns. grown_shard: the shard if one more shard of
    grown_weight (default: the last weight) stood at the end; it is either shard or the new one.

    Null keys are a key of their own. Equal keys share a shard; repeated rows get slots of their own in no fixed order.
    Columns named shard, slot or grown_shard are replaced. An empty table stays empty.

    Numbering: each shard is cut by the leading bits of the row hash into parts of bounded size; parts are counted
    (with map-side combine), the counts are summed up, and rows are numbered inside their part only. A repeated key
    falls apart by the other columns' hash, so a part never holds all rows of one key unless the rows are identical.
    """
    rest = [c for c in rows.columns if c not in ("shard", "slot", "grown_shard")]
    bits = pow2(pieces(input_bytes(rows), _PART_BYTES, 4)).bit_length() - 1
    key = F.col("__key")
    plain = [F.col(f"`{c}`") for c in rest if c not in keys]
    out = rows.select(*[F.col(f"`{c}`") for c in rest], key_text(*[F.col(f"`{k}`") for k in keys]).alias("__key"))
    out = out.withColumn("__hash", _bits(F.concat(key, F.lit("@"), F.xxhash64(*plain).cast("string") if plain else F.lit(""))))
    out = out.withColumn("__scores", shard_scores(key, [*weights, grown_weight or weights[-1]]))
    out = out.withColumn("shard", winner(F.slice("__scores", 1, len(weights)))).withColumn("grown_shard", winner(F.col("__scores"))).drop("__scores")
    out = out.withColumn("__part", F.shiftright("__hash", _BITS - bits))
    counts = out.groupBy("shard", "__part").agg(F.count("*").alias("__n"))
    before = Window.partitionBy("shard").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("shard", "__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    place = F.row_number().over(Window.partitionBy("shard", "__part").orderBy("__hash", "__key", *[F.hash(c) for c in plain])) - 1
    out = out.withColumn("__place", place).join(counts, ["shard", "__part"])
    return out.select(*[F.col(f"`{c}`") for c in rest], "shard", (F.col("__before") + F.col("__place")).cast("long").alias("slot"), "grown_shard")
