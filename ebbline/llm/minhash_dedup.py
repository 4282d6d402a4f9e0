"""MinHash near-dedup: universal hash minima, banding, signature verification, exact confirmation, star components.

1. Each text becomes its set of word shingles; a sketch holds its size, a 128-bit fingerprint of the set and the minima
   of HASHES universal hash functions. Texts with equal sets are one node (the smallest id), so a group of exact copies
   costs one row from here on.
2. BANDS bands of ROWS minima give buckets. Two texts at similarity s share none with probability
   (1 - s**ROWS)**BANDS: 7e-9 at 0.85.
3. Every text is compared with the smallest pivot of its buckets, and then with the pivots of its buckets that this
   left in other components: first signatures, then the full sets. Members never meet all members. Components are found
   on the confirmed links.
4. What that leaves open are buckets that hold several components. A member's shingles that also occur in members of
   other components bound its intersection with any of those, so most members can't have a further link. The others are
   compared in blocks, bucket by bucket, wherever the bound allows a link. No link between bucket members is lost.
5. Components are found again with all links.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import cut, ship
from ._text import U64, Words, binary, fitting, mix, rows_within, stream, window_hashes
from .components import connected_components

BANDS, ROWS = 32, 5
HASHES = BANDS * ROWS
#: Pivots of a bucket in step 3: its smallest id, and some by hashes.
PIVOTS = 2
#: Members of a bucket that one task compares with as many others in step 4.
BLOCK = 512
#: A signature's estimate may lie this many standard deviations low (5: once in 3 million).
_SIGMAS = 5.0
_A, _B = stream(11, HASHES) | U64(1), stream(12, HASHES)


def shingle_sets(texts: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes, sorted inside each text, and where each text's begin."""
    words = Words(texts, lower=True)
    hashes = words.hashes()
    at = fitting(words.first, size)
    n = words.counts
    short = np.flatnonzero((n > 0) & (n < size))
    text = np.concatenate([np.searchsorted(words.first, at, "right") - 1, short])
    h = np.concatenate([window_hashes(hashes, at, size, 4), window_hashes(hashes, words.first[short], n[short], 4)])
    order = np.lexsort((h, text))
    text, h = text[order], h[order]
    new = np.ones(h.size, bool)
    new[1:] = (h[1:] != h[:-1]) | (text[1:] != text[:-1])
    return h[new], np.searchsorted(text[new], np.arange(len(n) + 1))


def _sketch(h: np.ndarray, first: np.ndarray):
    """Fingerprints and minima (16 leading bits of each) of the sets that aren't empty, and which those are."""
    some = np.flatnonzero(np.diff(first))
    minima = np.empty((HASHES, some.size), np.uint16)
    prints = np.zeros((2, some.size), U64)
    if some.size:
        at = first[some]
        for i, c in enumerate(stream(13, 2)):
            prints[i] = np.add.reduceat(mix(h ^ c), at)
        for i in range(HASHES):
            minima[i] = (np.minimum.reduceat(h * _A[i] + _B[i], at) >> U64(48)).astype(np.uint16)
    return some, prints, np.ascontiguousarray(minima.T)


def _bands(minima: np.ndarray) -> np.ndarray:
    """Bucket ids, one row per signature."""
    parts = minima.reshape(len(minima), BANDS, ROWS).astype(U64)
    h = np.broadcast_to(stream(14, BANDS), (len(minima), BANDS)).copy()
    for i in range(ROWS):
        h = mix(h ^ parts[:, :, i]) * U64(0x9E3779B97F4A7C15)
    return mix(h).astype(np.int64)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 85) -> DataFrame:
    r"""One row per input row: id_col, n_shingles long, component_id, kept boolean (id_col = component_id).

    Words are `[^\x20\x09-\x0D]+` with A-Z lower-cased; a text's set holds its distinct `shingle`-word shingles, or its
    whole word sequence if it is shorter. Texts are linked if 100 * intersection >= percent * union of the full sets;
    component_id is the smallest id that links reach. Texts without words have the empty set, are linked with nothing
    and are their own component. Rows of one id are one node (its links are those of all its rows). Rows with a null id
    take no part in links: component_id is null and kept is true. Other columns of docs are not read. An empty table
    gives no rows.
    """
    ship(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def sketch(batches):
        for batch in batches:
            for lo, hi in rows_within(batch.column(1), 1 << 18):
                part = batch.slice(lo, hi - lo)
                h, first = shingle_sets(part.column(1), shingle)
                some, prints, minima = _sketch(h, first)
                at = np.full(part.num_rows, -1)
                at[some] = np.arange(some.size)
                spread = lambda x: pa.array(x).take(pa.array(at, mask=at < 0))  # noqa: E731, B023
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.diff(first), pa.int64()), spread(prints[0].astype(np.int64)), spread(prints[1].astype(np.int64)), spread([x.tobytes() for x in minima]) if some.size else pa.nulls(part.num_rows, pa.binary())], ["id", "n", "f1", "f2", "minima"])

    def sets(batches):
        for batch in batches:
            for lo, hi in rows_within(batch.column(1)):
                h, first = shingle_sets(batch.column(1).slice(lo, hi - lo), shingle)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(h.astype(np.int64)))], ["id", "shingles"])

    def buckets(batches):
        for batch in batches:
            minima = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint16).reshape(-1, HASHES)
            yield pa.RecordBatch.from_arrays([pa.array(_bands(minima).ravel()), batch.column(0).take(pa.array(np.repeat(np.arange(len(minima)), BANDS)))], ["bucket", "id"])

    every = cut(rows.mapInArrow(sketch, f"id {kind}, n long, f1 long, f2 long, minima binary"))
    linked = every.filter("n > 0 AND id IS NOT NULL")
    reps = cut(linked.groupBy("f1", "f2").agg(F.min(F.struct("id", "n", "minima")).alias("r")).select("f1", "f2", "r.*"))
    nodes = reps.select("f1", "f2", F.col("id").alias("node"))
    reps = reps.select("id", "n", "minima")
    entries = reps.select("id", "minima").mapInArrow(buckets, f"bucket long, id {kind}")
    pivots = entries.groupBy("bucket").agg(F.min("id").alias("p0"), F.max("id").alias("high"), *[F.min(F.struct(F.xxhash64("id", F.lit(i)), "id"))["id"].alias(f"p{i}") for i in range(1, PIVOTS)])
    members = cut(entries.join(pivots.filter("p0 <> high").drop("high"), "bucket"))
    wanted = members.select("id").distinct()
    texts = rows.join(wanted, "id", "left_semi").mapInArrow(sets, f"id {kind}, shingles array<long>")
    candidates = cut(texts.join(reps, "id").select("id", "shingles", F.size("shingles").alias("n"), "minima"))

    least = percent / 100 - _SIGMAS * float(np.sqrt(percent / 100 * (1 - percent / 100) / HASHES))

    def alike(batches):
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint16).reshape(-1, HASHES) for i in (2, 3))
            yield batch.filter(pa.array((x == y).mean(axis=1) >= least)).select([0, 1])

    def confirmed(pairs: DataFrame) -> DataFrame:
        """Those of pairs(u, v) that are links."""
        signatures = candidates.select("id", "minima")
        a, b = (signatures.select(F.col("id").alias(k), F.col("minima").alias(f"m{k}")) for k in "uv")
        close = pairs.join(a, "u").join(b, "v").select("u", "v", "mu", "mv").mapInArrow(alike, f"u {kind}, v {kind}")
        a, b = (candidates.select(F.col("id").alias(k), F.col("shingles").alias(f"s{k}")) for k in "uv")
        both = F.size(F.array_intersect("su", "sv"))
        return close.join(a, "u").join(b, "v").filter(100 * both >= percent * (F.size("su") + F.size("sv") - both)).select("u", "v")

    first = members.groupBy("id").agg(F.min("p0").alias("v")).filter("id <> v").select(F.col("id").alias("u"), "v")
    links = cut(confirmed(first))
    parts = cut(connected_components(links))
    pairs = members.select("id", F.explode(F.array(*[f"p{i}" for i in range(PIVOTS)])).alias("p")).filter("id <> p")
    pairs = pairs.select(F.greatest("id", "p").alias("u"), F.least("id", "p").alias("v")).distinct()
    links = cut(links.unionByName(confirmed(_apart(pairs, parts))))
    parts = cut(connected_components(links))
    links = links.unionByName(cut(_open_links(members.select("bucket", "id"), candidates, parts, percent, least)))

    parts = connected_components(links)
    nodes = nodes.join(parts, "node", "left").select("f1", "f2", F.coalesce("component", "node").alias("__component"))
    out = every.join(nodes, ["f1", "f2"], "left")
    # Rows of one id with different texts: the links of all of them count.
    component = F.when(F.col("id").isNotNull(), F.coalesce(F.col("__component"), F.col("id")))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))


def _apart(pairs: DataFrame, parts: DataFrame) -> DataFrame:
    """Those of pairs(u, v) whose ends lie in different components."""
    a, b = (parts.select(F.col("node").alias(k), F.col("component").alias(f"c{k}")) for k in "uv")
    both = pairs.join(a, "u", "left").join(b, "v", "left")
    return both.filter(F.coalesce("cu", "u") != F.coalesce("cv", "v")).select("u", "v")


def _open_links(members: DataFrame, candidates: DataFrame, parts: DataFrame, percent: int, least: float) -> DataFrame:
    """Links (u, v) between members of one bucket that lie in different components.

    Members of a bucket that may still have such a link are compared in blocks of BLOCK: a task holds two blocks and
    returns the links only. A pair that shares several buckets is compared in the first of them.
    """
    kind = members.schema["id"].dataType.simpleString()
    labelled = members.join(parts.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    labelled = cut(_mixed(labelled))
    ids = labelled.select("id", "component").distinct()
    shingles = candidates.join(ids, "id").select("id", "component", "n", F.explode("shingles").alias("shingle"))
    across = shingles.groupBy("shingle").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low <> high").select("shingle")
    bound = shingles.join(across, "shingle").groupBy("id", "n").agg(F.count("*").alias("c")).filter(100 * F.col("c") >= percent * F.col("n"))
    left = cut(_mixed(labelled.join(bound, "id")))
    sizes = left.groupBy("bucket").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    placed = left.join(sizes, "bucket").withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    placed = placed.select("bucket", "id", "component", "c", "own", other)
    placed = placed.select("bucket", "id", "component", "c", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    rows = placed.join(candidates, "id")

    def compare(key, table):
        kinds = pa.schema([("u", table["id"].type), ("v", table["id"].type)])
        bucket, i, j = (k.as_py() for k in key)
        table = table.combine_chunks()
        code = lambda c: np.asarray(pa.compute.rank(table[c], tiebreaker="dense")).astype(np.int64)
        place, component, own = code("id"), code("component"), np.asarray(table["own"])
        n, c = (np.asarray(table[x]).astype(np.int64) for x in ("n", "c"))
        minima = np.frombuffer(b"".join(table["minima"].to_pylist()), np.uint16).reshape(-1, HASHES)
        bands = _bands(minima)
        lists = table["shingles"].combine_chunks()
        flat, at = np.asarray(lists.flatten()), np.concatenate([[0], np.cumsum(np.asarray(pa.compute.list_value_length(lists)))])
        out = []
        for x in range(table.num_rows):
            most = np.minimum(c[x], c)
            may = (place < place[x]) & (component != component[x]) & (100 * most >= percent * (n[x] + n - most)) & (100 * np.minimum(n[x], n) >= percent * np.maximum(n[x], n))
            if i != j:
                may &= own != own[x]
            ys = np.flatnonzero(may)
            if ys.size:
                same = bands[ys] == bands[x]
                ys = ys[bands[x][same.argmax(axis=1)] == bucket]
            if ys.size:
                ys = ys[(minima[ys] == minima[x]).mean(axis=1) >= least]
            mine = flat[at[x] : at[x + 1]]
            for y in ys:
                both = np.intersect1d(mine, flat[at[y] : at[y + 1]], assume_unique=True).size
                if 100 * both >= percent * (n[x] + n[y] - both):
                    out.append((x, y))
        u, v = (pa.array([p[k] for p in out], pa.int64()) for k in (0, 1))
        return pa.Table.from_arrays([table["id"].take(u), table["id"].take(v)], schema=kinds)

    return rows.groupBy("bucket", "i", "j").applyInArrow(compare, f"u {kind}, v {kind}").distinct()


def _mixed(labelled: DataFrame) -> DataFrame:
    """The members of buckets that hold several components."""
    mixed = labelled.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low <> high").select("bucket")
    return labelled.join(mixed, "bucket")
