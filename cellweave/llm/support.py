"""What the operators share: cutting lineage, reading tables, connected components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which driver and executors share; one in the warehouse where it is not set."""
    context = spark.sparkContext
    if not context.getConf().get("spark.checkpoint.dir") and context.getCheckpointDir() is None:
        context.setCheckpointDir(f"{spark.conf.get('spark.sql.warehouse.dir')}/_checkpoints")
    return context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder wherever Spark keeps it."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def cut(df: DataFrame) -> DataFrame:
    """The same rows, kept in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def width(spark: SparkSession) -> int:
    """Partitions of a shuffle; it is set to suit the input, so state per partition stays bounded."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def least_labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest of 0 to n - 1 that each is connected with by the edges (a, b)."""
    label = np.arange(n)
    while True:
        least = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], least)
        np.minimum.at(new, label[b], least)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _rooted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, root) of all edges at once."""
    edges = [np.zeros((2, 0), np.int64), *(np.stack([x.column(0).to_numpy(), x.column(1).to_numpy()]) for x in batches)]
    a, b = np.concatenate(edges, axis=1)
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    label = least_labels(len(nodes), at[: len(a)], at[len(a) :])
    yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[label])], ["node", "root"])


def components(edges: DataFrame, most_rounds: int = 60, small: int = 500_000) -> DataFrame:
    """(node, root) for every node of `edges` (a, b): root is the smallest node it is linked to.

    Up to `small` edges (of 16 bytes) are solved by one task.  For more, large-star
    and small-star steps alternate, each a min per node joined back to the edges.
    The minima are a table of their own, so both sides of the join are plain
    shuffles and the edges of a hub are split among tasks.  Stops when the edges no
    longer change, or are few; their number never grows.
    """
    edges = edges.select("a", "b").where("a <> b")
    before, count = None, edges.count()
    if count > small:
        edges = cut(_down(edges))
        count = edges.count()
    for _ in range(most_rounds):
        if count <= small:
            return edges.coalesce(1).mapInArrow(_rooted, "node long, root long")
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = cut(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")))
        large = cut(_down(both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))))
        least = cut(large.groupBy("a").agg(F.min("b").alias("m")))
        kept = large.join(least, "a")
        small_star = kept.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(kept.select("a", F.col("m").alias("b")))
        edges = cut(_down(small_star))
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        count = now[0]
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()


def _down(edges: DataFrame) -> DataFrame:
    return edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
