"""Comparison by segments: checksums first, rows only where they differ.

Rows fall into segments by the first hexadecimal digits of the md5 of their key,
as many digits as leave about `leaf_rows` rows or fewer in one.  Each side is
scanned once for the checksums of its segments, and only rows of segments that
differ are joined.  Signatures are compared in Spark; nothing but counts comes to
the driver.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.canonical import fields_text
from ..functions.equality import Pair
from ..functions.hashing import bucket, checksums
from .join_diff import JoinDiff
from .keys import col, key_text

MAX_DIGITS = 15
HALF = 1 << 30  # sums of 60-bit numbers are taken in halves, so they stay longs
REMOTE_SEGMENTS = 50_000  # differing segments that are named in statements at most; of more all rows are read
BROADCAST_SEGMENTS = 1_000_000  # differing segments that are broadcast at most


def _rows(df: DataFrame, pairs: dict[str, Pair], key: list[str], side: str) -> DataFrame:
    """(bucket, h1, h2, pr) of every row; the bucket is as fine as it may get."""
    texts = [p.identity(col(p.name), side) for p in pairs.values()]
    sums = checksums(F.col("row"))
    keyed = df.select(key_text([pairs[k] for k in key], side).alias("key"), fields_text(texts).alias("row"))
    return keyed.select(bucket(F.col("key"), MAX_DIGITS).alias("bucket"), *(c.alias(n) for n, c in sums.items()))


def signatures(rows: DataFrame, digits: int) -> DataFrame:
    """(bucket, n, h1, h2, pr): the checksums of each segment; sums are exact decimals."""
    parts = [F.sum(F.expr(e)).alias(f"{c}_{x}") for c in ("h1", "h2") for x, e in (("high", f"{c} div {HALF}L"), ("low", f"{c} % {HALF}L"))]
    summed = rows.groupBy(F.substring("bucket", 1, digits).alias("bucket")).agg(F.count("*").alias("n"), *parts, F.sum("pr").alias("pr"))
    whole = [F.expr(f"cast(cast({c}_high as decimal(20,0)) * {HALF}BD + {c}_low as decimal(38,0))").alias(c) for c in ("h1", "h2")]
    return summed.select("bucket", "n", *whole, F.col("pr").cast("decimal(38,0)").alias("pr"))


def segment_signatures(df: DataFrame, pairs: dict[str, Pair], key: list[str], side: str = "left", digits: int = 1) -> DataFrame:
    return signatures(_rows(df, pairs, key, side), digits)


def differing(left: DataFrame, right: DataFrame) -> DataFrame:
    """(bucket, left_n, right_n) of segments whose signatures differ or that one side lacks."""
    a = left.select("bucket", *(F.col(c).alias(f"l_{c}") for c in ("n", "h1", "h2", "pr")))
    b = right.select("bucket", *(F.col(c).alias(f"r_{c}") for c in ("n", "h1", "h2", "pr")))
    same = F.expr(" and ".join(f"l_{c} <=> r_{c}" for c in ("n", "h1", "h2", "pr")))
    both = a.join(b, "bucket", "full_outer").where(~same)
    return both.select("bucket", F.coalesce("l_n", F.lit(0)).alias("left_n"), F.coalesce("r_n", F.lit(0)).alias("right_n"))


class SegmentDiff:
    """Segments of two tables; `leaves` holds the differing ones.

    `remote`: for a side whose database can do it, its statements (count, signatures
    and rows of segments); nothing else is then asked of its rows.
    """

    def __init__(self, left: DataFrame, right: DataFrame, pairs: dict[str, Pair], key: list[str], leaf_rows: int = 8192, remote=(None, None)) -> None:
        self.left, self.right, self.pairs, self.key, self.remote = left, right, pairs, key, remote
        self.totals = tuple(there.count() if there else df.count() for there, df in zip(remote, (left, right), strict=True))
        self.digits = min(MAX_DIGITS, max(1, math.ceil(math.log(max(1, max(self.totals) / leaf_rows), 16))))
        sides = [there.signatures(pairs, key, self.digits) if there else segment_signatures(df, pairs, key, side, self.digits) for there, df, side in zip(remote, (left, right), ("left", "right"), strict=True)]
        self.leaves = differing(*sides).persist()

    def slices(self) -> tuple[DataFrame, DataFrame]:
        """The rows of both sides in the differing segments."""
        leaves = self.leaves.select(F.col("bucket").alias("_leaf"))
        leaves = F.broadcast(leaves) if self.leaves.count() <= BROADCAST_SEGMENTS else leaves
        out = []
        for there, df, side in zip(self.remote, (self.left, self.right), ("left", "right"), strict=True):
            if there and self.leaves.count() <= REMOTE_SEGMENTS:
                df = there.rows(self.pairs, self.key, sorted(r[0] for r in self.leaves.select("bucket").collect()))
            out.append(df.join(leaves, bucket(key_text([self.pairs[k] for k in self.key], side), self.digits) == F.col("_leaf"), "left_semi"))
        return tuple(out)

    def join(self) -> JoinDiff:
        return JoinDiff(*self.slices(), self.pairs, self.key)

    def close(self) -> None:
        self.leaves.unpersist()
