"""Queries over the TPC-H-like tables, each with the same result in plain SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.canonical import NULL_MARK, text_of
from .functions.equality import Pair
from .functions.types import Family, TypeInfo, parse_type
from .operators.column_stats import stats_table
from .operators.join_diff import JoinDiff, with_ascii_known
from .operators.keyless_diff import keyless_counts
from .operators.keys import col, duplicate_keys
from .operators.schema_diff import diff_schemas
from .operators.segment_diff import SegmentDiff, differing, segment_signatures
from .options import CompareOptions
from .sources.bind import columns_of, scoped_conf

Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}
_oracles: dict[str, str] = {}

#: The right side of most comparisons, in SQL that both engines read: nulls, changed
#: prices, deleted rows and added rows.
CHANGED_ORDERS = """
SELECT o_orderkey, o_custkey,
       CASE WHEN o_orderkey % 211 = 0 THEN NULL ELSE o_orderstatus END AS o_orderstatus,
       CASE WHEN o_orderkey % 97 = 0 THEN o_totalprice + 17.5 ELSE o_totalprice END AS o_totalprice,
       o_orderdate, o_orderpriority
FROM {orders} WHERE o_orderkey % 101 <> 0
UNION ALL
SELECT o_orderkey + 10000000, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority
FROM {orders} WHERE o_orderkey % 103 = 0
"""


def query(oracle: str | None = None) -> Callable[[Query], Query]:
    """Registers a query and the SQL that gives its result."""

    def add(f: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            with scoped_conf(spark):
                return f(spark, sf_dir)

        _queries[f.__name__] = run
        if oracle:
            _oracles[f.__name__] = oracle
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def derived(spark: SparkSession, sf_dir: str, sql: str, name: str) -> DataFrame:
    return spark.sql(sql, **{name: read(spark, sf_dir, name)})


def oracle(template: str, name: str, right: str) -> str:
    """SQL with l and r for the two sides."""
    return f"WITH l AS (SELECT * FROM {name}), r AS ({right.format(**{name: name})}) {template}"


def compared(left: DataFrame, right: DataFrame, key: list[str], options: CompareOptions | None = None) -> JoinDiff:
    _, pairs = diff_schemas(columns_of(left), columns_of(right), options)
    return JoinDiff(left, right, with_ascii_known(pairs, left, right), key)


def orders(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return read(spark, sf_dir, "orders"), derived(spark, sf_dir, CHANGED_ORDERS, "orders")


_orders = partial(oracle, name="orders", right=CHANGED_ORDERS)
_J = "FROM l FULL OUTER JOIN r ON l.o_orderkey = r.o_orderkey"
_BOTH = "l.o_orderkey IS NOT NULL AND r.o_orderkey IS NOT NULL"
_DIFF = {c: f"l.{c} IS DISTINCT FROM r.{c}" for c in ("o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")}


@query(_orders(f"SELECT count(*) FILTER (WHERE r.o_orderkey IS NULL) AS left_only, count(*) FILTER (WHERE l.o_orderkey IS NULL) AS right_only, count(*) FILTER (WHERE {_BOTH}) AS both, count(*) FILTER (WHERE {_BOTH} AND ({' OR '.join(_DIFF.values())})) AS changed_rows {_J}"))
def row_counts_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compared(*orders(spark, sf_dir), ["o_orderkey"]).counts().select("left_only", "right_only", "both", "changed_rows")


@query(_orders("SELECT 'o_orderkey' AS \"column\", 0::BIGINT AS mismatched_rows UNION ALL " + " UNION ALL ".join(f"SELECT '{c}', count(*) FILTER (WHERE {_BOTH} AND {d}) {_J}" for c, d in _DIFF.items())))
def cell_mismatch_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compared(*orders(spark, sf_dir), ["o_orderkey"]).column_counts()


@query(_orders(f"SELECT CASE WHEN r.o_orderkey IS NULL THEN 'only_left' WHEN l.o_orderkey IS NULL THEN 'only_right' WHEN {' OR '.join(_DIFF.values())} THEN 'changed' ELSE 'same' END AS status, CAST(coalesce(l.o_orderkey, r.o_orderkey) AS VARCHAR) AS key {_J}"))
def row_status_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compared(*orders(spark, sf_dir), ["o_orderkey"]).status()


def _shifted(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    left = read(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderdate", "o_custkey")
    return left, derived(spark, sf_dir, _SHIFTED, "orders")


_SHIFTED = """SELECT o_orderkey, CASE WHEN o_orderkey % 53 = 0 THEN NULL ELSE o_orderstatus END AS o_orderstatus,
CASE WHEN o_orderkey % 59 = 0 THEN o_orderdate + INTERVAL 1 DAY ELSE o_orderdate END AS o_orderdate,
CASE WHEN o_orderkey % 61 = 0 THEN o_custkey + 1 ELSE o_custkey END AS o_custkey FROM {orders} WHERE o_orderkey % 67 <> 0"""
_CELLS = """, cells AS (
SELECT 'o_orderstatus' AS "column", CAST(l.o_orderkey AS VARCHAR) AS key, l.o_orderstatus AS "left", r.o_orderstatus AS "right" FROM l JOIN r ON l.o_orderkey = r.o_orderkey WHERE l.o_orderstatus IS DISTINCT FROM r.o_orderstatus
UNION ALL SELECT 'o_orderdate', CAST(l.o_orderkey AS VARCHAR), strftime(l.o_orderdate, '%Y-%m-%d %H:%M:%S.%f'), strftime(r.o_orderdate, '%Y-%m-%d %H:%M:%S.%f') FROM l JOIN r ON l.o_orderkey = r.o_orderkey WHERE l.o_orderdate IS DISTINCT FROM r.o_orderdate
UNION ALL SELECT 'o_custkey', CAST(l.o_orderkey AS VARCHAR), CAST(l.o_custkey AS VARCHAR), CAST(r.o_custkey AS VARCHAR) FROM l JOIN r ON l.o_orderkey = r.o_orderkey WHERE l.o_custkey IS DISTINCT FROM r.o_custkey)"""
_cells = "WITH l AS (SELECT * FROM orders), r AS (" + _SHIFTED.format(orders="orders") + ")" + _CELLS


@query(_cells + " SELECT * FROM cells")
def cell_diffs_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compared(*_shifted(spark, sf_dir), ["o_orderkey"]).cell_diffs()


@query(_cells + ' SELECT * EXCLUDE (n) FROM (SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY key) AS n FROM cells) WHERE n <= 20')
def examples_topk_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compared(*_shifted(spark, sf_dir), ["o_orderkey"]).examples(20)


@query(_orders("SELECT CAST(o_orderkey AS VARCHAR) AS key FROM l WHERE o_orderkey NOT IN (SELECT o_orderkey FROM r)"))
def only_left_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compared(*orders(spark, sf_dir), ["o_orderkey"]).only("left")


@query(_orders("SELECT CAST(o_orderkey AS VARCHAR) AS key FROM r WHERE o_orderkey NOT IN (SELECT o_orderkey FROM l)"))
def only_right_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compared(*orders(spark, sf_dir), ["o_orderkey"]).only("right")


_PRICES = "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN o_totalprice * 1.0005 WHEN o_orderkey % 7 = 0 THEN o_totalprice + 0.25 WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_totalprice END AS o_totalprice FROM {orders}"


def _prices(spark: SparkSession, sf_dir: str, options: CompareOptions) -> DataFrame:
    left = read(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    return compared(left, derived(spark, sf_dir, _PRICES, "orders"), ["o_orderkey"], options).column_counts().where("column = 'o_totalprice'")


def _near(condition: str) -> str:
    near = f"coalesce({condition}, l.o_totalprice IS NULL AND r.o_totalprice IS NULL)"
    return oracle(f"SELECT 'o_totalprice' AS \"column\", count(*) FILTER (WHERE NOT {near}) AS mismatched_rows FROM l JOIN r ON l.o_orderkey = r.o_orderkey", "orders", _PRICES)


_GAP = "abs(l.o_totalprice - r.o_totalprice)"


@query(_near(f"{_GAP} <= 0.5"))
def tolerance_abs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _prices(spark, sf_dir, CompareOptions(tolerance_abs=0.5))


@query(_near(f"({_GAP} <= 0.001 * abs(l.o_totalprice) OR {_GAP} <= 0.001 * abs(r.o_totalprice))"))
def tolerance_rel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _prices(spark, sf_dir, CompareOptions(tolerance_rel=0.001))


_EMPTY = "SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN NULL WHEN c_custkey % 7 = 0 THEN '' WHEN c_custkey % 11 = 0 THEN ' ' ELSE c_mktsegment END AS c_mktsegment FROM {customer}"
_GAPS = "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN NULL WHEN c_custkey % 5 = 0 THEN '' ELSE c_mktsegment END AS c_mktsegment FROM {customer}"


def _segments(spark: SparkSession, sf_dir: str, options: CompareOptions) -> DataFrame:
    sides = (derived(spark, sf_dir, sql, "customer") for sql in (_EMPTY, _GAPS))
    return compared(*sides, ["c_custkey"], options).counts().select("both", "changed_rows")


def _empties(differs: str) -> str:
    return f"WITH l AS ({_EMPTY.format(customer='customer')}), r AS ({_GAPS.format(customer='customer')}) SELECT count(*) AS both, count(*) FILTER (WHERE {differs}) AS changed_rows FROM l JOIN r ON l.c_custkey = r.c_custkey"


@query(_empties("l.c_mktsegment IS DISTINCT FROM r.c_mktsegment"))
def null_vs_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _segments(spark, sf_dir, CompareOptions())


@query(_empties("nullif(l.c_mktsegment, '') IS DISTINCT FROM nullif(r.c_mktsegment, '')"))
def empty_as_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _segments(spark, sf_dir, CompareOptions(treat_empty_as_null=True))


def _one_column(name: str, table: str, key: str, left: str, right: str, differs: str, options: CompareOptions | None = None) -> None:
    """Registers the count of differing values v of two derived tables."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        sides = (derived(spark, sf_dir, f"SELECT {key}, {e} AS v FROM {{{table}}}", table) for e in (left, right))
        return compared(*sides, [key], options).counts().select("both", "changed_rows")

    run.__name__ = name
    query(f"WITH l AS (SELECT {key}, {left} AS v FROM {table}), r AS (SELECT {key}, {right} AS v FROM {table}) SELECT count(*) AS both, count(*) FILTER (WHERE {differs}) AS changed_rows FROM l JOIN r ON l.{key} = r.{key}")(run)


_one_column("bool_alias", "orders", "o_orderkey", "o_orderkey % 2 = 0", "CASE o_orderkey % 6 WHEN 0 THEN ' Yes ' WHEN 1 THEN 'f' WHEN 2 THEN 'TRUE' WHEN 3 THEN '1' WHEN 4 THEN 'maybe' ELSE 'no' END",
            "CASE WHEN lower(trim(r.v)) IN ('true','t','yes','y','1') THEN 'true' WHEN lower(trim(r.v)) IN ('false','f','no','n','0') THEN 'false' ELSE 'bad' END <> CASE WHEN l.v THEN 'true' ELSE 'false' END")
_one_column("string_cast_int", "orders", "o_orderkey", "o_custkey", "CASE WHEN o_orderkey % 9 = 0 THEN 'x' WHEN o_orderkey % 13 = 0 THEN CAST(o_custkey + 1 AS VARCHAR(20)) ELSE CAST(o_custkey AS VARCHAR(20)) END", "l.v IS DISTINCT FROM TRY_CAST(r.v AS BIGINT)")
_one_column("decimal_scale_equal", "orders", "o_orderkey", "CAST(o_custkey AS DECIMAL(18,2))", "CAST(CASE WHEN o_orderkey % 17 = 0 THEN o_custkey + 1 ELSE o_custkey END AS DECIMAL(20,4))", "l.v <> r.v")
_one_column("integer_widening", "orders", "o_orderkey", "CAST(o_custkey AS INT)", "CASE WHEN o_orderkey % 19 = 0 THEN o_custkey + 1 ELSE o_custkey END", "l.v <> r.v")
_one_column("nfc_equal_documents", "documents", "doc_id", "text", "CASE WHEN doc_id % 10 = 0 THEN concat(text, '!') ELSE replace(text, 'é', 'é') END", "nfc_normalize(l.v) IS DISTINCT FROM nfc_normalize(r.v)")
_one_column("json_semantic_events", "events", "event_id", "props", "CASE WHEN event_id % 23 = 0 THEN concat(substr(props, 1, 1), '\"z\": 1, ', substr(props, 2)) ELSE replace(props, ':', ' :  ') END", "CAST(json(l.v) AS VARCHAR) IS DISTINCT FROM CAST(json(r.v) AS VARCHAR)", CompareOptions(json_columns=frozenset({"v"})))
_one_column("ts_precision_events", "events", "event_id", "ts", "date_trunc('second', ts)", "date_trunc('second', l.v) <> date_trunc('second', r.v)", CompareOptions(ts_precision="s"))


@query("WITH l AS (SELECT event_id, ts AS v FROM events), r AS (SELECT event_id, CASE WHEN event_id % 29 = 0 THEN ts ELSE ts + INTERVAL 1 HOUR END AS v FROM events) SELECT count(*) AS both, count(*) FILTER (WHERE (l.v AT TIME ZONE 'Europe/Berlin') <> (r.v AT TIME ZONE 'UTC')) AS changed_rows FROM l JOIN r ON l.event_id = r.event_id")
def assume_tz_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The right side has a zone, the left is read as Berlin's time."""
    events = read(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp_ntz").alias("v"))
    right = events.select("event_id", F.when(F.col("event_id") % 29 == 0, F.col("v")).otherwise(F.col("v") + F.expr("INTERVAL 1 HOUR")).cast("timestamp").alias("v"))
    return compared(events, right, ["event_id"], CompareOptions(assume_tz="Europe/Berlin")).counts().select("both", "changed_rows")


@query("SELECT event_id, md5(strftime(ts, '%Y-%m-%d %H:%M:%S.%f')) AS digest FROM events")
def canonical_ts_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = TypeInfo(Family.TIMESTAMP_NAIVE, "timestamp_ntz", 6)
    return read(spark, sf_dir, "events").select("event_id", F.md5(text_of(F.col("ts").cast("timestamp_ntz"), kind, CompareOptions())).alias("digest"))


_FIELDS = {"o_custkey": "CAST(o_custkey AS VARCHAR)", "o_orderdate": "strftime(o_orderdate, '%Y-%m-%d %H:%M:%S.%f')", "o_orderkey": "CAST(o_orderkey AS VARCHAR)", "o_orderpriority": "o_orderpriority", "o_orderstatus": "o_orderstatus"}
_MARKED = {n: f"coalesce({e}, chr(1) || '{NULL_MARK[1:-1]}' || chr(1))" for n, e in _FIELDS.items()}
_ROW = " || ".join(f"length({e}) || ':' || {e}" for e in (_MARKED[n] for n in ("o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate", "o_orderpriority")))


def _signed(table: str, digits: int) -> str:
    """Segment signatures in SQL."""
    return f"""SELECT substr(hk, 1, {digits}) AS bucket, count(*) AS n, CAST(sum(h1) AS DECIMAL(38,0)) AS h1, CAST(sum(h2) AS DECIMAL(38,0)) AS h2,
 CAST(sum(((h1 % 2147483629) * (h2 % 2147483629)) % 2147483629) AS DECIMAL(38,0)) AS pr
 FROM (SELECT hk, ('0x' || substr(h, 1, 15))::BIGINT AS h1, ('0x' || substr(h, 16, 15))::BIGINT AS h2
       FROM (SELECT md5(length(CAST(o_orderkey AS VARCHAR)) || ':' || CAST(o_orderkey AS VARCHAR)) AS hk, md5({_ROW}) AS h FROM {table})) GROUP BY 1"""


def _without_price(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, dict[str, Pair]]:
    left, right = (df.select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate", "o_orderpriority") for df in orders(spark, sf_dir))
    _, pairs = diff_schemas(columns_of(left), columns_of(right))
    return left, right, with_ascii_known(pairs, left, right)


_SUMS = "bucket, n, CAST(h1 AS VARCHAR) AS h1, CAST(h2 AS VARCHAR) AS h2, CAST(pr AS VARCHAR) AS pr"


@query(f"SELECT {_SUMS} FROM ({_signed('orders', 1)})")
def segment_signatures_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    left, _, pairs = _without_price(spark, sf_dir)
    return segment_signatures(left, pairs, ["o_orderkey"], digits=1).selectExpr("bucket", "n", "cast(h1 as string) h1", "cast(h2 as string) h2", "cast(pr as string) pr")


@query(_orders(f", a AS ({_signed('l', 2)}), b AS ({_signed('r', 2)}) SELECT coalesce(a.bucket, b.bucket) AS bucket, coalesce(a.n, 0) AS left_n, coalesce(b.n, 0) AS right_n FROM a FULL OUTER JOIN b ON a.bucket = b.bucket WHERE (a.n, a.h1, a.h2, a.pr) IS DISTINCT FROM (b.n, b.h1, b.h2, b.pr)"))
def segment_diff_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    left, right, pairs = _without_price(spark, sf_dir)
    return differing(*(segment_signatures(df, pairs, ["o_orderkey"], side, 2) for df, side in ((left, "left"), (right, "right"))))


_DIFF_BUT_PRICE = " OR ".join(d for c, d in _DIFF.items() if c != "o_totalprice")


@query(_orders(f"SELECT count(*) FILTER (WHERE r.o_orderkey IS NULL) AS left_only, count(*) FILTER (WHERE l.o_orderkey IS NULL) AS right_only, count(*) FILTER (WHERE {_BOTH} AND ({_DIFF_BUT_PRICE})) AS changed_rows {_J}"))
def hash_leaf_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same differences, found by segments of at most 64 rows."""
    left, right, pairs = _without_price(spark, sf_dir)
    return SegmentDiff(left, right, pairs, ["o_orderkey"], leaf_rows=64).join().counts().select("left_only", "right_only", "changed_rows")


_LINES = "SELECT * FROM {lineitem} WHERE l_orderkey % 89 <> 0 UNION ALL SELECT * FROM {lineitem} WHERE l_orderkey % 83 = 0"
_LINE_KEY = "l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate"


@query(oracle(f", a AS (SELECT {_LINE_KEY}, count(*) AS n FROM l GROUP BY ALL), b AS (SELECT {_LINE_KEY}, count(*) AS n FROM r GROUP BY ALL), j AS (SELECT coalesce(a.n, 0) AS x, coalesce(b.n, 0) AS y FROM a FULL OUTER JOIN b USING ({_LINE_KEY})) SELECT CAST(sum(x) AS BIGINT) AS left_total, CAST(sum(y) AS BIGINT) AS right_total, CAST(sum(greatest(x - y, 0)) AS BIGINT) AS left_only, CAST(sum(greatest(y - x, 0)) AS BIGINT) AS right_only, CAST(sum(least(x, y)) AS BIGINT) AS both, CAST(sum(CASE WHEN y = 0 THEN x ELSE 0 END) AS BIGINT) AS left_absent, CAST(sum(CASE WHEN x = 0 THEN y ELSE 0 END) AS BIGINT) AS right_absent FROM j", "lineitem", _LINES))
def keyless_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    left, right = read(spark, sf_dir, "lineitem"), derived(spark, sf_dir, _LINES, "lineitem")
    _, pairs = diff_schemas(columns_of(left), columns_of(right))
    return keyless_counts(left, right, with_ascii_known(pairs, left, right))


@query("SELECT l_orderkey AS k0, l_linenumber AS k1, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def dup_keys_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicate_keys(read(spark, sf_dir, "lineitem"), [col("l_orderkey"), col("l_linenumber")])


def _stats(table: str, columns: list[str], number: list[str]) -> str:
    parts = [f"SELECT '{c}' AS \"column\", CAST(min({c}) AS VARCHAR) AS \"min\", CAST(max({c}) AS VARCHAR) AS \"max\", {f'avg(CAST({c} AS DOUBLE))' if c in number else 'CAST(NULL AS DOUBLE)'} AS avg, count(*) - count({c}) AS null_count, count(DISTINCT {c}) AS distinct_count FROM {table}" for c in columns]
    return " UNION ALL ".join(parts)


@query(_stats("orders", ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"], ["o_orderkey", "o_custkey"]))
def stats_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
    return stats_table(df, {c.name: parse_type(c) for c in columns_of(df)})


_EVENTS = "(SELECT CASE WHEN event_id % 31 = 0 THEN NULL ELSE event_type END AS event_type, user_id + 1 AS user_id FROM events)"


@query(f"SELECT l.\"column\", l.\"min\" AS left_min, r.\"min\" AS right_min, l.\"max\" AS left_max, r.\"max\" AS right_max, l.null_count AS left_nulls, r.null_count AS right_nulls, l.distinct_count AS left_distinct, r.distinct_count AS right_distinct FROM ({_stats('events', ['event_type', 'user_id'], ['user_id'])}) l JOIN ({_stats(_EVENTS, ['event_type', 'user_id'], ['user_id'])}) r ON l.\"column\" = r.\"column\"")
def stats_drift_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = read(spark, sf_dir, "events").select("event_id", "event_type", "user_id")
    right = left.select(F.when(F.col("event_id") % 31 != 0, F.col("event_type")).alias("event_type"), (F.col("user_id") + 1).alias("user_id"))
    sides = []
    for df, side in ((left.drop("event_id"), "left"), (right, "right")):
        t = stats_table(df, {c.name: parse_type(c) for c in columns_of(df)})
        sides.append(t.select("column", F.col("min").alias(f"{side}_min"), F.col("max").alias(f"{side}_max"), F.col("null_count").alias(f"{side}_nulls"), F.col("distinct_count").alias(f"{side}_distinct")))
    return sides[0].join(sides[1], "column")


_TURNS = "SELECT conv_id, turn, role, CASE WHEN conv_id % 7 = 0 AND turn = 1 THEN 'changed' ELSE text END AS text FROM {conversations} WHERE NOT (conv_id % 11 = 0 AND turn = 0)"


@query(oracle("SELECT count(*) FILTER (WHERE r.conv_id IS NULL) AS left_only, count(*) FILTER (WHERE l.conv_id IS NULL) AS right_only, count(*) FILTER (WHERE l.conv_id = r.conv_id) AS both, count(*) FILTER (WHERE l.conv_id = r.conv_id AND l.text IS DISTINCT FROM r.text) AS changed_rows FROM l FULL OUTER JOIN r ON l.conv_id = r.conv_id AND l.turn = r.turn", "conversations", _TURNS))
def composite_key_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    left, right = read(spark, sf_dir, "conversations"), derived(spark, sf_dir, _TURNS, "conversations")
    return compared(left, right, ["conv_id", "turn"]).counts().select("left_only", "right_only", "both", "changed_rows")


@query("SELECT count(*) AS both, count(*) FILTER (WHERE vec_id % 13 = 0) AS changed_rows FROM embeddings")
def nested_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = read(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    right = left.withColumn("embedding", F.when(F.col("vec_id") % 13 == 0, F.slice("embedding", 2, 1000)).otherwise(F.col("embedding")))
    return compared(left, right, ["vec_id"]).counts().select("both", "changed_rows")


@query("SELECT count(*) AS both, 0::BIGINT AS left_only, 0::BIGINT AS right_only, 0::BIGINT AS changed_rows FROM customer")
def identical_self_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = read(spark, sf_dir, "customer")
    return compared(df, df.select("*"), ["c_custkey"]).counts().select("both", "left_only", "right_only", "changed_rows")


#: For each verdict two columns of orders that it is given for, and in SQL how their values differ (None: not compared).
VERDICTS = {
    "same": ("o_custkey", "CASE WHEN o_orderkey % 7 = 0 THEN o_custkey + 1 ELSE o_custkey END", "l.c <> r.c"),
    "benign": ("CAST(o_totalprice AS DECIMAL(18,4))", "CAST(CASE WHEN o_orderkey % 9 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS DECIMAL(18,2))", "l.c <> r.c"),
    "widening": ("CAST(o_custkey AS INT)", "CASE WHEN o_orderkey % 11 = 0 THEN o_custkey + 1 ELSE o_custkey END", "l.c <> r.c"),
    "lossy": ("o_custkey", "CAST(o_custkey AS DOUBLE) + CASE WHEN o_orderkey % 13 = 0 THEN 0.5 ELSE 0.0 END", "l.c <> r.c"),
    "needs_tz": ("o_orderdate", "CAST(o_orderdate AS {zoned})", None),
    "bool_alias": ("CASE WHEN o_orderkey % 17 = 0 THEN 'perhaps' WHEN o_orderkey % 2 = 0 THEN ' YES' ELSE 'f' END", "o_orderkey % 2 = 0", "l.c = 'perhaps'"),
    "string_cast": ("CASE WHEN o_orderkey % 19 = 0 THEN 'some day' ELSE CAST(CAST(o_orderdate AS DATE) AS VARCHAR(20)) END", "CAST(o_orderdate AS DATE)", "TRY_CAST(l.c AS DATE) IS DISTINCT FROM r.c"),
    "incompatible": ("CAST(o_orderdate AS DATE)", "o_orderkey % 2 = 0", None),
    "only_left": ("o_custkey", None, None),
    "only_right": (None, "o_custkey", None),
}
#: DuckDB's names of types as Spark spells them (fixed values).
TYPES = {"BIGINT": "bigint", "INTEGER": "int", "SMALLINT": "smallint", "DOUBLE": "double", "FLOAT": "float", "VARCHAR": "string", "BOOLEAN": "boolean", "DATE": "date", "TIMESTAMP": "timestamp_ntz", "TIMESTAMP WITH TIME ZONE": "timestamp", "DECIMAL(18,4)": "decimal(18,4)", "DECIMAL(18,2)": "decimal(18,2)"}
SPELLED = "CASE {c} " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in TYPES.items()) + " END"


def _verdict(status: str, left: str | None, right: str | None, differs: str | None) -> None:
    sides = [f"SELECT o_orderkey{f', {e} AS c' if e else ''} FROM {{orders}}" for e in (left, right)]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        a, b = (spark.sql(s.replace("{zoned}", "TIMESTAMP").replace("VARCHAR(20)", "STRING"), orders=read(spark, sf_dir, "orders")) for s in sides)
        found, pairs = diff_schemas(columns_of(a), columns_of(b))
        c = next(x for x in found.columns if x.name == "c")
        counts = JoinDiff(a, b, with_ascii_known(pairs, a, b), ["o_orderkey"]).counts()
        return counts.select(F.lit(c.status).alias("status"), F.lit(c.types[0]).cast("string").alias("left_type"), F.lit(c.types[1]).cast("string").alias("right_type"), F.lit("c" in pairs).alias("compared"), F.lit(found.agree).alias("agree"), "both", "changed_rows")

    run.__name__ = f"verdict_{status}"
    own = [s.replace("{zoned}", "TIMESTAMPTZ").format(orders="orders") for s in sides]
    kinds = [f"(SELECT max({SPELLED.format(c='column_type')}) FROM (DESCRIBE {s}) WHERE column_name = 'c')" for s in own]
    query(f"WITH l AS ({own[0]}), r AS ({own[1]}) SELECT '{status}' AS status, {kinds[0]} AS left_type, {kinds[1]} AS right_type, {differs is not None} AS compared, {status in ('same', 'benign')} AS agree, count(*) AS both, count(*) FILTER (WHERE {differs or 'false'}) AS changed_rows FROM l JOIN r ON l.o_orderkey = r.o_orderkey")(run)


for _status, _sides in VERDICTS.items():
    _verdict(_status, *_sides)


def queries() -> dict[str, Query]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_oracles)
