"""Times the headline queries and two whole comparisons of a wide table, and prints one line of JSON.

BENCH_ROWS: rows of the wide table (20 columns; the second side has changed cells,
deleted and added rows).  For the published 10 M x 20 set it to 10000000.
The value is the sum of the headline queries alone.
"""

import json
import os
import shutil
import tempfile
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from cellweave import catalogue, catalogue_use  # noqa: F401  (registers its queries)
from cellweave.options import SECTIONS, RunOptions
from cellweave.plans.engine import run_diff

SF_DIR, CPUS = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
ROWS = int(os.environ.get("BENCH_ROWS", "1000000"))
HEADLINE = ["row_counts_orders", "cell_mismatch_orders", "cell_diffs_orders", "examples_topk_orders", "tolerance_rel", "nfc_equal_documents", "json_semantic_events", "segment_signatures_orders", "hash_leaf_rows", "keyless_lineitem", "dup_keys_lineitem", "stats_orders"]
WHOLE = ["run_diff_join_orders", "run_diff_hash_orders"]


def wide(spark: SparkSession, folder: str) -> tuple[str, str]:
    """Orders repeated to ROWS rows, with columns made from theirs up to 20, and a changed copy."""
    orders = spark.read.parquet(f"{SF_DIR}/orders.parquet")
    times = -(-ROWS // orders.count())
    rows = orders.select("*", F.explode(F.sequence(F.lit(0), F.lit(times - 1))).alias("again")).limit(ROWS)
    rows = rows.select((F.col("o_orderkey") * times + F.col("again")).alias("id"), "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority", *((F.col("o_totalprice") * (i + 1) / 7).alias(f"d{i}") for i in range(6)), *((F.col("o_custkey") % (i + 9)).cast("int").alias(f"i{i}") for i in range(4)), *(F.md5(F.concat_ws("-", "o_orderkey", F.lit(i))).alias(f"s{i}") for i in range(3)), (F.col("o_custkey") % 2 == 0).alias("flag"))
    rows.write.parquet(f"{folder}/l.parquet")
    left = spark.read.parquet(f"{folder}/l.parquet")
    changed = left.where("id % 2003 <> 0").withColumn("d0", F.when(F.col("id") % 997 == 0, F.col("d0") + 17.5).otherwise(F.col("d0")))
    changed.unionByName(left.where("id % 2011 = 0").withColumn("id", -F.col("id") - 1)).write.parquet(f"{folder}/r.parquet")
    return f"{folder}/l.parquet", f"{folder}/r.parquet"


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]").config("spark.sql.shuffle.partitions", CPUS).config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.warehouse.dir", warehouse := tempfile.mkdtemp(prefix="bench-")).getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries = catalogue.queries()
    queries["identical_self_diff"](spark, SF_DIR).collect()  # starts the engine
    times, speed = {}, {}
    try:
        for name in HEADLINE + WHOLE:
            began = time.perf_counter()
            queries[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()
            times[name] = round(time.perf_counter() - began, 3)
        sides = wide(spark, warehouse)
        for strategy in ("join", "hash"):
            began = time.perf_counter()
            run_diff(*sides, RunOptions(key=("id",), strategy=strategy, sections=SECTIONS - {"stats"}), spark)
            times[f"wide_{strategy}"] = round(time.perf_counter() - began, 3)
            speed[f"wide_{strategy}"] = round(ROWS / times[f"wide_{strategy}"] / int(CPUS))
    finally:
        shutil.rmtree(warehouse, ignore_errors=True)
    print(json.dumps({"metric": "headline queries", "value": round(sum(times[n] for n in HEADLINE), 3), "unit": "sec", "queries": times, "sf": SF_DIR.rpartition("sf")[2], "wide": {"rows": ROWS, "columns": 20, "rows_per_second_and_core": speed}}))
    spark.stop()


if __name__ == "__main__":
    main()
