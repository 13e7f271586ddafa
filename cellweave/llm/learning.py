"""Bounded labelled samples for the classifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int) -> DataFrame:
    """(text, y): at most `per_class` labelled documents of each class, chosen by a hash of doc_id.

    Ids labelled twice count once, with the larger label; null labels, ids and
    texts are left out; of rows equal in doc_id and text one counts, and different
    texts of one doc_id are rows of their own, so the bound holds for rows.
    """
    ids = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(F.col(label).cast("int")).alias("y"))
    known = docs.where("doc_id is not null and text is not null").select("doc_id").distinct().join(ids, "doc_id")
    order = known.withColumn("h", F.xxhash64("doc_id", F.lit(17)))
    first = [order.where(F.col("y") == y).orderBy("h", "doc_id").limit(per_class).select(F.col("doc_id").alias("id"), "y", "h") for y in (0, 1)]
    chosen = F.broadcast(first[0].unionByName(first[1]))
    rows = docs.select("doc_id", "text").join(chosen, F.col("doc_id") == F.col("id")).select("y", "h", "id", "text", F.xxhash64("text").alias("t")).dropDuplicates(["id", "t"])
    parts = [rows.where(F.col("y") == y).orderBy("h", "id", "t").limit(per_class).select("text", "y") for y in (0, 1)]
    return parts[0].unionByName(parts[1])
