"""Comparison without a key: rows as multisets of row hashes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.canonical import fields_text
from ..functions.equality import Pair
from ..model import RowTally
from .keys import col


def row_hashes(df: DataFrame, pairs: dict[str, Pair], side: str) -> DataFrame:
    """(h, n): how often each row occurs; columns in the order of their names."""
    texts = [pairs[n].identity(col(n), side) for n in sorted(pairs)]
    return df.select(F.md5(fields_text(texts)).alias("h")).groupBy("h").agg(F.count("*").alias("n"))


def matched_hashes(left: DataFrame, right: DataFrame, pairs: dict[str, Pair]) -> DataFrame:
    """(h, left_n, right_n) of every row hash."""
    a = row_hashes(left, pairs, "left").withColumnRenamed("n", "left_n")
    b = row_hashes(right, pairs, "right").withColumnRenamed("n", "right_n")
    return a.join(b, "h", "full_outer").na.fill(0, ["left_n", "right_n"])


def keyless_counts(left: DataFrame, right: DataFrame, pairs: dict[str, Pair]) -> DataFrame:
    """One row: totals, rows over on either side, rows matched, and rows whose hash the other side lacks."""
    return matched_hashes(left, right, pairs).agg(
        *(
            F.coalesce(F.sum(F.expr(e)), F.lit(0)).cast("bigint").alias(n)
            for n, e in {
                "left_total": "left_n",
                "right_total": "right_n",
                "left_only": "greatest(left_n - right_n, 0)",
                "right_only": "greatest(right_n - left_n, 0)",
                "both": "least(left_n, right_n)",
                "left_absent": "if(right_n = 0, left_n, 0)",
                "right_absent": "if(left_n = 0, right_n, 0)",
            }.items()
        )
    )


def keyless_diff(left: DataFrame, right: DataFrame, pairs: dict[str, Pair]) -> RowTally:
    row = keyless_counts(left, right, pairs).first()
    return RowTally(row["left_only"], row["right_only"], row["both"])
