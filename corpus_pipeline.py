"""A training corpus from raw documents: five stages, each one operator of ebbline.llm.

Every stage takes (spark, docs, sf_dir), docs with the columns of `documents`, and returns a DataFrame; all but the last
return those columns. A stage works on every row its predecessor kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ebbline.llm import bpe
from ebbline.llm._spark import cut
from ebbline.llm.decontaminate import build_index, find_overlaps
from ebbline.llm.line_dedup import line_dedup
from ebbline.llm.minhash_dedup import near_duplicates
from ebbline.llm.quality import fit_quality, score_quality
from ebbline.llm.queries import QUALITY_AT, learnable, vocabulary

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the quality ranking accepts; the others go."""
    model = fit_quality(docs, learnable(spark.read.parquet(f"{sf_dir}/labels.parquet")), at=QUALITY_AT)
    return score_quality(docs, model, score_col="__score").filter(F.col("__score") >= QUALITY_AT).select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that line dedup drops; n_chars counts what is left."""
    out = line_dedup(docs.select(*COLUMNS), min_chars=20, min_docs=3)
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the smallest id, of each group of near duplicates: five-word shingles, a similarity of 0.8 or more."""
    gone = near_duplicates(docs, shingle=5, percent=80).filter(~F.col("kept")).select("doc_id")
    return docs.join(gone, "doc_id", "left_anti").select(*COLUMNS)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a word of a benchmark window; the others go. Rows without an id are told apart by their text."""
    key = F.struct("doc_id", F.when(F.col("doc_id").isNull(), F.sha2("text", 256)).alias("digest"))
    hits = find_overlaps(build_index(docs.select(key.alias("key"), "text"), "key"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), window=10)
    gone = hits.filter("n_hit > 0").select(F.col("id.doc_id").alias("__id"), F.col("id.digest").alias("__digest"))
    keyed = docs.withColumn("__own", key["digest"])
    return keyed.join(gone, F.col("doc_id").eqNullSafe(F.col("__id")) & F.col("__own").eqNullSafe(F.col("__digest")), "left_anti").select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and the digest of what they decode to."""
    out = bpe.bpe_encode(docs.select("doc_id", "text", "lang", "source"), vocabulary(), decoded_col="decoded")
    return out.select("doc_id", "lang", "source", "n_tokens", "ids", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("quality", quality), ("line_dedup", lines), ("near_dedup", near), ("decontaminate", decontaminate), ("bpe", tokens)]

#: Ranking, iterated components and BPE aren't SQL; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; what one returns is stored before the next reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = cut(docs)
    return docs
