"""Statistics of columns, side by side.

Everything but the numbers of distinct values comes from one aggregate without
shuffled rows.  Exact distinct counts multiply the rows by the columns counted
together, so columns are taken a few at a time.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.types import Family, TypeInfo
from ..model import Profiles
from .keys import col

DISTINCT_TOGETHER = 4


def _comparable(name: str, kind: TypeInfo) -> Column:
    """Values that can be ordered and told apart; maps and variants as text."""
    c = col(name)
    if kind.family is Family.OTHER:
        return F.to_json(c) if kind.type.startswith(("array", "struct", "map")) else c.cast("string")
    return F.to_json(c) if kind.type == "variant" else c


def stats_table(df: DataFrame, types: dict[str, TypeInfo], exact: bool = True) -> DataFrame:
    """(column, min, max, avg, null_count, distinct_count) for each column; min and max as text.

    `exact` False: distinct counts are approximate, without a shuffle of rows.
    """
    names = sorted(types)
    parts = []
    aggs = [F.count("*").alias("rows")]
    for i, n in enumerate(names):
        c = _comparable(n, types[n])
        aggs += [F.count(c).alias(f"count{i}"), F.min(c).alias(f"min{i}"), F.max(c).alias(f"max{i}"), (F.avg(c.cast("double")) if types[n].is_numeric else F.lit(None).cast("double")).alias(f"avg{i}")]
        if not exact:
            aggs.append(F.approx_count_distinct(c).alias(f"distinct{i}"))
    base = df.agg(*aggs)
    if exact:
        for at in range(0, len(names), DISTINCT_TOGETHER):
            some = range(at, min(at + DISTINCT_TOGETHER, len(names)))
            parts.append(df.agg(*(F.count_distinct(_comparable(names[i], types[names[i]])).alias(f"distinct{i}") for i in some)).withColumn("one", F.lit(1)))
        base = reduce(lambda a, b: a.join(b, "one"), parts, base.withColumn("one", F.lit(1)))
    rows = F.array(
        *(
            F.struct(
                F.lit(n).alias("column"), _text(F.col(f"min{i}"), types[n]).alias("min"), _text(F.col(f"max{i}"), types[n]).alias("max"), F.col(f"avg{i}").alias("avg"),
                (F.col("rows") - F.col(f"count{i}")).alias("null_count"), F.col(f"distinct{i}").alias("distinct_count"),
            )
            for i, n in enumerate(names)
        )
    )
    return base.select(F.explode(rows).alias("s")).select("s.*")


def _text(c: Column, kind: TypeInfo) -> Column:
    return F.lower(F.hex(c)) if kind.family is Family.BINARY else c.cast("string")


def profiles(left: DataFrame, right: DataFrame, left_types: dict[str, TypeInfo], right_types: dict[str, TypeInfo], exact: bool = True) -> Profiles:
    """Statistics of the columns that both sides have; they never decide whether the sides are identical."""
    shared = sorted(set(left_types) & set(right_types))
    if not shared:
        return {}
    sides = []
    for df, types in ((left, left_types), (right, right_types)):
        rows = stats_table(df, {n: types[n] for n in shared}, exact).collect()
        sides.append({r["column"]: r.asDict() for r in rows})
    return {n: (sides[0][n], sides[1][n]) for n in shared}
