"""Bounded labelled samples."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import cut, ship


def labelled_sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, limit: int, parts: int | None = None) -> DataFrame:
    """(id, text, label int) of at most `limit` labelled rows, those of the least id hashes; stored, in `parts` files if given.

    Labels other than 0 and 1 and null ids don't count; of several labels of an id the largest does. The bound `limit`
    is also that of the broadcast side of the join. Without `parts` there are as many files as tasks that read docs.
    """
    ship(docs.sparkSession)
    rows = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).filter("id IS NOT NULL AND label IN (0, 1)")
    rows = rows.groupBy("id").agg(F.max("label").alias("label")).orderBy(F.xxhash64("id"), "id").limit(limit)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    found = texts.join(F.broadcast(rows), "id")
    return cut(found.repartition(parts) if parts else found)
