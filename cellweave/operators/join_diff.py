"""Comparison by key: one full outer join, from which everything is derived.

The plan stays lazy.  Counts need one aggregate over the join; examples need one
more pass, for all columns together, and only if something differs.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.canonical import not_ascii
from ..functions.equality import Pair
from ..functions.types import Family
from ..model import Cell, CellTally, RowTally
from .keys import col, key_columns, shown_key


def with_ascii_known(pairs: dict[str, Pair], left: DataFrame, right: DataFrame) -> dict[str, Pair]:
    """The pairs, told which text columns are ASCII on both sides; one scan of those columns."""
    names = [n for n, p in pairs.items() if p.compares_text or Family.STRING in (p.left.family, p.right.family)]
    if not names:
        return pairs
    seen: set[str] = set()
    for df, side in ((left, "left"), (right, "right")):
        texts = [n for n in names if getattr(pairs[n], side).family is Family.STRING]
        if texts:
            row = df.agg(*(F.max(not_ascii(col(n))).alias(f"t{i}") for i, n in enumerate(texts))).first()
            seen |= {n for n, found in zip(texts, row, strict=True) if found}
    return {n: Pair(p.name, p.left, p.right, p.how, p.options, n in seen) for n, p in pairs.items()}


class JoinDiff:
    """Two tables matched by key.  `pairs`: the columns that can be compared; key columns are among them."""

    def __init__(self, left: DataFrame, right: DataFrame, pairs: dict[str, Pair], key: list[str]) -> None:
        self.keys = [pairs[k] for k in key]
        self.compared = list(pairs.values())
        sides = []
        for df, side in ((left, "left"), (right, "right")):
            s = side[0]
            keys = [k.alias(f"{s}k{i}") for i, k in enumerate(key_columns(self.keys, side))]
            values = [col(p.name).alias(f"{s}{i}") for i, p in enumerate(self.compared)]
            sides.append(df.select(*keys, *values, F.lit(True).alias(f"in_{s}")))
        matches = [F.col(f"lk{i}").eqNullSafe(F.col(f"rk{i}")) for i in range(len(key))]
        self.joined = sides[0].join(sides[1], reduce(Column.__and__, matches), "full_outer")
        self.both = F.col("in_l").isNotNull() & F.col("in_r").isNotNull()
        self.equal = [p.equal(F.col(f"l{i}"), F.col(f"r{i}")) for i, p in enumerate(self.compared)]

    def status(self) -> DataFrame:
        """(key, status): only_left, only_right, changed or same, for every row."""
        same = reduce(Column.__and__, self.equal, F.lit(True))
        status = F.when(F.col("in_r").isNull(), "only_left").when(F.col("in_l").isNull(), "only_right").when(same, "same").otherwise("changed")
        return self.joined.select(self._key().alias("key"), status.alias("status"))

    def _key(self) -> Column:
        return shown_key(self.keys, [F.coalesce(F.col(f"lk{i}"), F.col(f"rk{i}")) for i in range(len(self.keys))])

    def counts(self) -> DataFrame:
        """One row: left_only, right_only, both, changed_rows and m0, m1, ... mismatches per column."""
        differs = [F.count_if(self.both & ~e).alias(f"m{i}") for i, e in enumerate(self.equal)]
        changed = F.count_if(self.both & ~reduce(Column.__and__, self.equal, F.lit(True)))
        return self.joined.agg(F.count_if(F.col("in_r").isNull()).alias("left_only"), F.count_if(F.col("in_l").isNull()).alias("right_only"), F.count_if(self.both).alias("both"), changed.alias("changed_rows"), *differs)

    def column_counts(self) -> DataFrame:
        """(column, mismatched_rows) for the compared columns."""
        rows = F.array(*(F.struct(F.lit(p.name).alias("column"), F.col(f"m{i}").alias("mismatched_rows")) for i, p in enumerate(self.compared)))
        return self.counts().select(F.explode(rows).alias("c")).select("c.*")

    def cell_diffs(self) -> DataFrame:
        """(column, key, left, right): canonical texts of every differing cell; null for null."""
        cells = []
        for i, (p, equal) in enumerate(zip(self.compared, self.equal, strict=True)):
            cell = F.struct(F.lit(p.name).alias("column"), p.text(F.col(f"l{i}"), "left").alias("left"), p.text(F.col(f"r{i}"), "right").alias("right"))
            cells.append(F.when(~equal, cell))
        if not cells:
            return self.joined.sparkSession.createDataFrame([], "column string, key string, left string, right string")
        rows = self.joined.where(self.both & ~reduce(Column.__and__, self.equal, F.lit(True)))
        return rows.select(self._key().alias("key"), F.explode(F.array_compact(F.array(*cells))).alias("c")).select("c.column", "key", "c.left", "c.right")

    def examples(self, n: int) -> DataFrame:
        """The n differing cells of each column with the smallest keys (as text)."""
        rank = F.row_number().over(Window.partitionBy("column").orderBy("key"))
        return self.cell_diffs().withColumn("rank", rank).where(F.col("rank") <= n).drop("rank")

    def only(self, side: str) -> DataFrame:
        """(key): rows of one side alone."""
        return self.joined.where(F.col("in_r" if side == "left" else "in_l").isNull()).select(self._key().alias("key"))

    def measure(self, examples_n: int) -> tuple[RowTally, CellTally]:
        row = self.counts().first()
        cells = CellTally(row["changed_rows"], {n: c for n, c in sorted((p.name, row[f"m{i}"]) for i, p in enumerate(self.compared)) if c})
        if cells.differing and examples_n > 0:
            for e in self.examples(examples_n).orderBy("column", "key").toLocalIterator():
                cells.samples.setdefault(e["column"], []).append(Cell(e["key"], e["left"], e["right"]))
        return RowTally(row["left_only"], row["right_only"], row["both"]), cells
