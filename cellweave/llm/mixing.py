"""Mixing sources to target weights by hash-random keys, without sorting a source, by DataFrame functions alone.

Targets fill sources in proportion to their weights up to `most` times their
size; what a full source cannot take goes to the others (water filling, solved
on the list of sources sorted by the level at which each is full).

Inside a source, rows stand in the order of a keyed hash.  The cut is found
without sorting a source: the hash range is split evenly into as many buckets as
a bucket has rows (the square root of the source's rows), prefix sums over the
buckets' token counts name the one bucket in which the budget ends, and only that
bucket is sorted for a running sum.  So a
source may hold any share of the rows, and documents are never shuffled; they
get their source's epochs, cut and rest by a join with the table of sources
(broadcast if its size allows).

Defined cases: null text has size 0; a null source is a source of its own, last
in order; a null doc_id has a hash of its own; rows equal in source, doc_id and
size at the cut share what is left evenly, rounded down; sources of size 0 have
target 0; extra columns stay, but those with the names of the new columns are
replaced; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .support import cut, width

SOURCES = 100_000  # rows of the table of sources that are broadcast, or summed in one window, at most
NEW = ("size", "source_size", "target", "taken")
_WORD = r"[^\x20\x09-\x0D]+"


def hash_key(seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))


def _sized(docs: DataFrame, seed: int) -> DataFrame:
    return docs.withColumn("size", F.coalesce(F.regexp_count("text", F.lit(_WORD)).cast("long"), F.lit(0).cast("long"))).withColumn("_key", hash_key(seed))


def running(rows: DataFrame, order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """Adds the sums over all rows that stand before a row.

    Up to SOURCES rows that is one window; of more, rows are dealt out by ranges of
    the order, and the totals of the ranges before are added to sums within one.
    """
    before = lambda w: w.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    if rows.count() <= SOURCES:
        return rows.withColumns({n: F.coalesce(F.sum(c).over(before(Window)), F.lit(0)) for n, c in sums.items()})
    rows = cut(rows.repartitionByRange(width(rows.sparkSession), *order).withColumn("_range", F.spark_partition_id()))
    held = rows.groupBy("_range").agg(*(F.sum(c).alias(f"_{n}") for n, c in sums.items()))
    ranges = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    held = held.select("_range", *(F.coalesce(F.sum(f"_{n}").over(ranges), F.lit(0)).alias(f"_{n}") for n in sums))
    out = rows.join(F.broadcast(held), "_range")
    return out.withColumns({n: F.coalesce(F.sum(c).over(before(Window.partitionBy("_range"))), F.lit(0)) + F.col(f"_{n}") for n, c in sums.items()}).drop("_range", *(f"_{n}" for n in sums))


def targets(sources: DataFrame, cycle: int = 3, most: int = 3) -> DataFrame:
    """Adds weight and target to (source, source_size, ...): weights 1 to `cycle`, repeating in the order of names."""
    by_name = F.col("source").asc_nulls_last()
    out = running(sources, [by_name], {"rank": F.lit(1)}).withColumn("weight", F.col("rank") % cycle + 1).drop("rank")
    out = out.withColumn("level", F.col("source_size") * most / F.col("weight"))
    out = cut(running(out, [F.col("level").asc(), by_name], {"capacity": F.col("source_size") * most, "heavier": F.col("weight")}))
    everything = out.agg(F.sum("source_size").alias("size"), F.sum("weight").alias("weight")).first()
    if everything["weight"] is None:
        return out.withColumn("target", F.lit(0.0)).drop("level", "capacity", "heavier")
    out = out.withColumns({"room": F.lit(everything["size"]) - F.col("capacity"), "heavy": F.lit(everything["weight"]) - F.col("heavier")})
    out = out.withColumn("full", F.col("source_size") * most * F.col("heavy") < F.col("weight") * F.col("room"))
    # the first source that is not full sets the level for all that follow; there always is one
    sets = out.where("not full").agg(F.min(F.struct("level", F.col("source").isNull(), "source", "room", "heavy")).alias("s")).first()["s"]
    share = (F.col("weight") * F.lit(sets["room"])).cast("double") / F.lit(sets["heavy"]).cast("double")
    target = F.when(F.col("full"), (F.col("source_size") * most).cast("double")).otherwise(share)
    return out.withColumn("target", target).drop("level", "capacity", "heavier", "room", "heavy", "full")


def _same_source(a: DataFrame, b: DataFrame) -> Column:
    return a["source"].eqNullSafe(b["_source"])


def _ready(sources: DataFrame) -> DataFrame:
    return F.broadcast(sources) if sources.count() <= SOURCES else sources


def plan(rows: DataFrame, cycle: int, most: int) -> DataFrame:
    """One row per source: target, whole epochs, and the hash, size and rest at which the last epoch is cut."""
    sources = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    sources = targets(sources, cycle, most).withColumn("budget", F.floor(F.col("target") + 0.5))
    sources = sources.withColumns({"epochs": F.when(F.col("source_size") > 0, F.expr("budget div source_size")).otherwise(0), "rest": F.when(F.col("source_size") > 0, F.expr("budget % source_size")).otherwise(0), "buckets": F.ceil(F.sqrt(F.col("n")))})
    sources = cut(sources.withColumnRenamed("source", "_source"))
    placed = rows.join(_ready(sources.select("_source", "buckets", "rest")), _same_source(rows, sources)).withColumn("bucket", F.expr("cast(conv(substr(_key, 1, 8), 16, 10) as bigint) * buckets div 4294967296"))
    sums = placed.groupBy("_source", "bucket").agg(F.sum("size").alias("held"), F.first("rest").alias("rest"))
    sums = sums.withColumn("upto", F.sum("held").over(Window.partitionBy("_source").orderBy("bucket")))
    last = sums.where("upto - held <= rest and rest < upto").select(F.col("_source").alias("_at"), F.col("bucket").alias("_bucket"), (F.col("rest") - F.col("upto") + F.col("held")).alias("inside"))
    inner = placed.join(last, placed["_source"].eqNullSafe(last["_at"]) & (placed["bucket"] == last["_bucket"]))
    inner = inner.groupBy("_at", "_key", "size").agg(F.count("*").alias("copies"), F.first("inside").alias("inside"))
    inner = inner.withColumn("upto", F.sum(F.col("size") * F.col("copies")).over(Window.partitionBy("_at").orderBy("_key", "size")))
    edge = inner.withColumn("left", F.col("inside") - F.col("upto") + F.col("size") * F.col("copies")).where("left >= 0 and inside < upto")
    edge = edge.select("_at", F.col("_key").alias("cut_key"), F.col("size").alias("cut_size"), F.expr("left div copies").alias("cut_rest"))
    return cut(sources.join(edge, sources["_source"].eqNullSafe(edge["_at"]), "left").select("_source", "source_size", "weight", "target", "epochs", "cut_key", "cut_size", "cut_rest"))


def mix(docs: DataFrame, seed: int = 7, cycle: int = 3, most: int = 3) -> DataFrame:
    """All rows and columns of `docs` with size, source_size, target and taken (words, repeats counted)."""
    docs = docs.drop(*NEW)
    narrow = cut(_sized(docs.select("doc_id", "source", "text"), seed).select("source", "size", "_key"))
    sources = plan(narrow, cycle, most)
    sources = sources.select("_source", *(F.col(c).alias(f"_mix_{c}") for c in sources.columns if c != "_source"))
    # only the new columns are named: whatever else `docs` has may clash with what is joined
    rows = _sized(docs.select(F.struct(*docs.columns).alias("_row"), "doc_id", "source", "text"), seed)
    rows = rows.join(_ready(sources), _same_source(rows, sources))
    more = F.expr(
        """case when _mix_cut_key is null then 0
                when _key < _mix_cut_key or _key = _mix_cut_key and size < _mix_cut_size then size
                when _key = _mix_cut_key and size = _mix_cut_size then _mix_cut_rest else 0 end"""
    )
    taken = (F.col("size") * F.col("_mix_epochs") + more).cast("long")
    return rows.select("_row.*", "size", F.col("_mix_source_size").alias("source_size"), F.col("_mix_target").alias("target"), taken.alias("taken"))


MIX_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         md5('7:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS k
  FROM {documents}),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight FROM s),
f AS (
  SELECT *, sum(source_size) OVER () - coalesce(sum(source_size * 3) OVER b, 0) AS room,
         sum(weight) OVER () - coalesce(sum(weight) OVER b, 0) AS heavy
  FROM w
  WINDOW b AS (ORDER BY source_size * 3 / CAST(weight AS DOUBLE), source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
g AS (SELECT *, source_size * 3 * heavy < weight * room AS is_full FROM f),
l AS (SELECT room, heavy FROM g WHERE NOT is_full ORDER BY source_size * 3 / CAST(weight AS DOUBLE), source NULLS LAST LIMIT 1),
t AS (
  SELECT source, source_size,
         CASE WHEN is_full THEN CAST(source_size * 3 AS DOUBLE)
              ELSE CAST(weight * l.room AS DOUBLE) / CAST(l.heavy AS DOUBLE) END AS target
  FROM g, l),
e AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target + 0.5) AS BIGINT) ELSE 0 END AS budget FROM t),
o AS (
  SELECT d.doc_id, d.size, e.source_size, e.target, e.budget,
         sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.size ROWS UNBOUNDED PRECEDING) - d.size AS before_
  FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, size, source_size, target,
       CAST(CASE WHEN source_size = 0 THEN 0
            ELSE size * (budget // source_size) + greatest(0, least(size, budget % source_size - before_)) END AS BIGINT) AS taken
FROM o
"""
