"""Queries for what users call: whole comparisons, sources, reports, errors and texts of all types, each with SQL over the same tables."""

from __future__ import annotations

import contextlib
import io
import json
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import catalogue as base
from .catalogue import CHANGED_ORDERS, derived, query, read
from .cli import main
from .errors import CellweaveError
from .functions.canonical import text_of
from .functions.types import Family, TypeInfo
from .model import Findings
from .operators.keys import col, guess_key, worst_keys
from .options import SECTIONS, CompareOptions, CsvOptions, Limits, RunOptions
from .plans.engine import choose_strategy, run_diff
from .plans.report import as_dict, to_json, to_markdown
from .sources.bind import bind_frame, bind_source, columns_of
from .sources.spec import split_postgres_url

KEYED = RunOptions(key=("o_orderkey",), sections=SECTIONS - {"stats"})


def shared(spark: SparkSession, name: str) -> str:
    """A new path in the warehouse folder, which driver and executors share."""
    return f"{spark.conf.get('spark.sql.warehouse.dir')}/_catalogue/{uuid.uuid4().hex}/{name}"


def numbers(spark: SparkSession, found: Findings) -> DataFrame:
    """(what, n): the counts of a comparison as its JSON has them."""
    out = as_dict(found)
    rows = [*out.get("counts", {}).items()]
    if "values" in out:
        rows += [("changed_rows", out["values"]["changed_rows"]), *((f"cells of {c['column']}", c["mismatched_rows"]) for c in out["values"]["columns"])]
    return spark.createDataFrame([(what, int(n)) for what, n in rows], "what string, n long")


def _counted(left: str, right: str, key: str, differs: dict[str, str]) -> str:
    """SQL for `numbers` of two tables that are queries."""
    both = f"l.{key} IS NOT NULL AND r.{key} IS NOT NULL"
    parts = {"left_total": f"l.{key} IS NOT NULL", "right_total": f"r.{key} IS NOT NULL", "left_only": f"r.{key} IS NULL", "right_only": f"l.{key} IS NULL", "both": both, "changed_rows": f"{both} AND ({' OR '.join(differs.values())})"}
    parts |= {f"cells of {c}": f"{both} AND {d}" for c, d in differs.items()}
    named = ", ".join(f"{c} AS d{i}" for i, c in enumerate(parts.values()))
    rows = " UNION ALL ".join(f"SELECT '{what}' AS what, count(*) FILTER (WHERE d{i}) AS n FROM j" for i, what in enumerate(parts))
    return f"WITH l AS ({left}), r AS ({right}), j AS (SELECT {named} FROM l FULL OUTER JOIN r ON l.{key} = r.{key}) SELECT * FROM ({rows}) WHERE n > 0 OR what NOT LIKE 'cells of %'"


_ORDERS_SQL = _counted("SELECT * FROM orders", CHANGED_ORDERS.format(orders="orders"), "o_orderkey", base._DIFF)


@query(_ORDERS_SQL)
def run_diff_join_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return numbers(spark, run_diff(*base.orders(spark, sf_dir), KEYED))


@query(_ORDERS_SQL)
def run_diff_hash_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return numbers(spark, run_diff(*base.orders(spark, sf_dir), RunOptions(key=("o_orderkey",), strategy="hash", sections=KEYED.sections, limits=Limits(leaf_rows=256))))


@query(f"SELECT what, n FROM (UNPIVOT (SELECT * EXCLUDE (left_absent, right_absent) FROM ({base._oracles['keyless_lineitem']})) ON COLUMNS(*) INTO NAME what VALUE n)")
def run_diff_keyless_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    return numbers(spark, run_diff(read(spark, sf_dir, "lineitem"), derived(spark, sf_dir, base._LINES, "lineitem"), RunOptions(strategy="keyless")))


# Files

_ACCOUNTS = "SELECT c_custkey, CASE WHEN c_custkey % 41 = 0 THEN NULL ELSE c_name END AS c_name, CASE WHEN c_custkey % 43 = 0 THEN 31 ELSE c_nationkey END AS c_nationkey, c_acctbal FROM {customer} WHERE c_custkey % 47 <> 0"
_PLAIN = "SELECT c_custkey, c_name, c_nationkey, c_acctbal FROM customer"
_ACCOUNT_DIFF = {c: f"l.{c} IS DISTINCT FROM r.{c}" for c in ("c_name", "c_nationkey", "c_acctbal")}
_ACCOUNTS_SQL = _counted(_PLAIN, _ACCOUNTS.format(customer="customer"), "c_custkey", _ACCOUNT_DIFF)
_BY_CUSTOMER = {"key": ("c_custkey",), "sections": SECTIONS - {"stats"}}


def _as_file(spark: SparkSession, sf_dir: str, name: str, mark: str) -> tuple[DataFrame, str]:
    """Customers, and the path of changed ones as a file."""
    path = shared(spark, name)
    derived(spark, sf_dir, _ACCOUNTS, "customer").write.csv(path, header=True, sep=mark, quote='"', escape='"', emptyValue="")
    return read(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey", "c_acctbal"), path


def _file_query(name: str, file: str, mark: str, csv: CsvOptions, sql: str = _ACCOUNTS_SQL) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        left, path = _as_file(spark, sf_dir, file, mark)
        return numbers(spark, run_diff(left, path, RunOptions(csv=csv, **_BY_CUSTOMER)))

    run.__name__ = name
    query(sql)(run)


_file_query("source_csv", "c.csv", ",", CsvOptions())
_file_query("source_csv_in_parts", "c.csv", ",", CsvOptions(line_breaks=False))
_file_query("source_csv_as_text", "c.csv", ",", CsvOptions(as_text=True))
_file_query("source_tsv", "c.tsv", "\t", CsvOptions())
_file_query("source_txt_delimiter", "c.txt", ";", CsvOptions())


@query(_ACCOUNTS_SQL)
def source_parquet_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared(spark, "c.parquet")
    derived(spark, sf_dir, _ACCOUNTS, "customer").write.parquet(path)
    left = read(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey", "c_acctbal")
    return numbers(spark, run_diff(left, path, RunOptions(**_BY_CUSTOMER)))


@query(_ACCOUNTS_SQL)
def source_catalogue_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    left, name = read(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey", "c_acctbal"), f"cellweave_{uuid.uuid4().hex}"
    derived(spark, sf_dir, _ACCOUNTS, "customer").createOrReplaceTempView(name)
    try:
        return numbers(spark, run_diff(left, f"table:{name}", RunOptions(**_BY_CUSTOMER)))
    finally:
        spark.catalog.dropTempView(name)


@query(_ACCOUNTS_SQL)
def source_duckdb(spark: SparkSession, sf_dir: str) -> DataFrame:
    import duckdb

    left = read(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey", "c_acctbal")
    with tempfile.TemporaryDirectory() as folder:
        with duckdb.connect(f"{folder}/c.duckdb") as db:
            rows = derived(spark, sf_dir, _ACCOUNTS, "customer").toArrow()
            db.sql("CREATE TABLE customers (c_custkey BIGINT PRIMARY KEY, c_name VARCHAR, c_nationkey INTEGER, c_acctbal DOUBLE)")
            db.sql("INSERT INTO customers SELECT * FROM rows")
            del rows
        return numbers(spark, run_diff(left, f"duckdb://{folder}/c.duckdb/customers", RunOptions(**_BY_CUSTOMER)))


@query("SELECT 'text' AS source, count(*) AS n, 'string' AS type FROM customer UNION ALL SELECT 'typed', count(*), 'bigint,string,int,double' FROM customer WHERE c_custkey % 47 <> 0")
def bound_counts_and_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows and types of a bound source, without types and with them."""
    text = shared(spark, "c.csv")
    read(spark, sf_dir, "customer").write.csv(text, header=True)
    sides = {"text": bind_source(spark, text, CsvOptions(as_text=True)), "typed": bind_frame(derived(spark, sf_dir, _ACCOUNTS, "customer"))}
    rows = [(n, s.df.count(), ",".join(dict.fromkeys(c.type for c in s.columns))) for n, s in sides.items()]
    return spark.createDataFrame(rows, "source string, n long, type string")


# Schemas

_MORE = """SELECT o_orderkey, CAST(o_custkey AS INT) AS o_custkey, o_orderpriority AS o_priority, CAST(o_totalprice AS DECIMAL(18,2)) AS o_totalprice,
CAST(o_orderdate AS DATE) AS o_day, o_orderstatus = 'F' AS o_orderstatus, CAST(o_orderkey AS {varchar}) AS o_text, CAST(o_totalprice AS DECIMAL(18,4)) AS o_exact FROM {orders}"""
_LESS = """SELECT CAST(o_orderkey AS BIGINT) AS o_orderkey, o_custkey, o_orderpriority, o_totalprice, CAST(o_orderdate AS {varchar}) AS o_day, o_orderstatus, o_orderkey AS o_text,
CAST(o_totalprice AS DECIMAL(18,2)) AS o_exact FROM {orders}"""


def _two_schemas(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    orders = read(spark, sf_dir, "orders")
    return tuple(spark.sql(sql.replace("{varchar}", "STRING"), orders=orders) for sql in (_LESS, _MORE))


def _described() -> str:
    sides = [f"SELECT column_name AS name, {base.SPELLED.format(c='column_type')} AS type FROM (DESCRIBE {sql.format(varchar='VARCHAR', orders='orders')})" for sql in (_LESS, _MORE)]
    numbers_ = "('bigint', 'int', 'smallint')"
    status = f"""CASE WHEN r.name IS NULL THEN 'only_left' WHEN l.name IS NULL THEN 'only_right' WHEN l.type = r.type THEN 'same'
      WHEN l.type LIKE 'decimal%' AND r.type LIKE 'decimal%' THEN 'benign' WHEN l.type IN {numbers_} AND r.type IN {numbers_} THEN 'widening'
      WHEN 'double' IN (l.type, r.type) AND 'string' NOT IN (l.type, r.type) THEN 'lossy' WHEN 'string' IN (l.type, r.type) AND 'boolean' IN (l.type, r.type) THEN 'bool_alias'
      WHEN 'string' IN (l.type, r.type) THEN 'string_cast' ELSE 'incompatible' END"""
    return f"SELECT coalesce(l.name, r.name) AS name, {status} AS status, l.type AS left_type, r.type AS right_type FROM ({sides[0]}) l FULL OUTER JOIN ({sides[1]}) r ON l.name = r.name"


@query(_described())
def schema_of_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts on the columns of two tables, from their own types."""
    found = run_diff(*_two_schemas(spark, sf_dir), RunOptions(key=("o_orderkey",), sections=frozenset({"schema"})))
    return spark.createDataFrame([(c.name, c.status, *c.types) for c in found.schemas.columns], "name string, status string, left_type string, right_type string")


@query(f"SELECT left_type || '/' || right_type AS types FROM ({_described()}) WHERE status = 'lossy' OR status = 'incompatible'")
def schema_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pairs of types that the report warns of."""
    found = run_diff(*_two_schemas(spark, sf_dir), RunOptions(key=("o_orderkey",), sections=frozenset({"schema"})))
    warned = [c for c in found.schemas.columns if any(w.startswith(f"column '{c.name}': {c.note}") for w in found.schemas.notes.beware)]
    return spark.createDataFrame([("/".join(c.types),) for c in warned], "types string")


@query("SELECT list(column_name ORDER BY i) <> list(column_name ORDER BY column_name DESC) AS reordered, count(*) AS columns FROM (SELECT column_name, row_number() OVER () AS i FROM (DESCRIBE customer))")
def schema_order_hint(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = read(spark, sf_dir, "customer")
    found = run_diff(df, df.select(*sorted(df.columns, reverse=True)), RunOptions(key=("c_custkey",), sections=frozenset({"schema"})))
    return spark.createDataFrame([(found.schemas.reordered, len(found.schemas.columns))], "reordered boolean, columns long")


@query("SELECT column_name AS name, CASE WHEN column_name = 'n_nationkey' THEN 'nullability differs (nullable vs NOT NULL)' ELSE '' END AS note FROM (DESCRIBE nation)")
def schema_nullability_note(spark: SparkSession, sf_dir: str) -> DataFrame:
    import pyarrow as pa
    import pyarrow.parquet as pq

    nation = read(spark, sf_dir, "nation")
    t = nation.toArrow()
    t = t.cast(pa.schema([f.with_nullable(f.name != "n_nationkey") for f in t.schema]))
    with tempfile.TemporaryDirectory() as folder:
        pq.write_table(t, f"{folder}/n.parquet")
        found = run_diff(nation, f"{folder}/n.parquet", RunOptions(key=("n_nationkey",), sections=frozenset({"schema"})), spark)
    return spark.createDataFrame([(c.name, c.note) for c in found.schemas.columns], "name string, note string")


@query("SELECT count(*) AS n, count(*) FILTER (WHERE date_trunc('millisecond', ts) <> ts) > 0 AS finer, 0::BIGINT AS differing, 'milliseconds' AS unit FROM events")
def footer_precision_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file in milliseconds against one in microseconds: both are cut, and the report says so."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    left = read(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp_ntz").alias("ts"))
    t = left.toArrow()
    with tempfile.TemporaryDirectory() as folder:
        pq.write_table(t.set_column(1, "ts", t["ts"].cast(pa.timestamp("ms"), safe=False)), f"{folder}/e.parquet")
        pq.write_table(t, f"{folder}/u.parquet")
        found = run_diff(f"{folder}/u.parquet", f"{folder}/e.parquet", RunOptions(key=("event_id",)), spark)
    unit = found.notes.assumed[0].rsplit(" ", 2)[1]
    finer = left.where(F.date_trunc("millisecond", "ts") != F.col("ts")).count() > 0
    return spark.createDataFrame([(found.rows.matched, finer, sum(found.cells.differing.values()), unit)], "n long, finer boolean, differing long, unit string")


# Keys and errors


@query("SELECT l_orderkey AS k0, l_linenumber AS k1, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1 ORDER BY n DESC, k0, k1 LIMIT 3")
def worst_keys_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    return worst_keys(read(spark, sf_dir, "lineitem"), [col("l_orderkey"), col("l_linenumber")])


def _error(spark: SparkSession, *sides: DataFrame, options: RunOptions) -> DataFrame:
    try:
        run_diff(*sides, options)
        rows = [("none", 0)]
    except CellweaveError as e:
        rows = [(type(e).__name__, e.exit_code)]
    except KeyError:
        rows = [("KeyError", 2)]
    return spark.createDataFrame(rows, "error string, exit_code int")


@query("SELECT CASE WHEN count(*) > count(DISTINCT (l_orderkey, l_linenumber)) THEN 'KeyNotUnique' ELSE 'none' END AS error, CASE WHEN count(*) > count(DISTINCT (l_orderkey, l_linenumber)) THEN 2 ELSE 0 END AS exit_code FROM lineitem")
def error_key_not_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = read(spark, sf_dir, "lineitem")
    return _error(spark, df, df, options=RunOptions(key=("l_orderkey", "l_linenumber")))


@query("SELECT CASE WHEN count(*) FILTER (WHERE column_name IN ('id', 'pk', 'uuid', 'guid')) = 0 THEN 'NoKeyFound' ELSE 'none' END AS error, 2 AS exit_code FROM (DESCRIBE orders)")
def error_no_key_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _error(spark, *base.orders(spark, sf_dir), options=RunOptions())


@query("SELECT CASE WHEN count(*) FILTER (WHERE column_name = 'o_clerk') = 0 THEN 'KeyError' ELSE 'none' END AS error, 2 AS exit_code FROM (DESCRIBE orders)")
def error_missing_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _error(spark, *base.orders(spark, sf_dir), options=RunOptions(key=("o_clerk",)))


@query("SELECT name AS key FROM (VALUES (1, 'id'), (2, 'pk'), (3, 'uuid'), (4, 'guid')) u(i, name) WHERE name IN (SELECT column_name FROM (DESCRIBE SELECT o_orderkey AS pk, o_custkey AS id, o_orderdate FROM orders)) AND name IN (SELECT column_name FROM (DESCRIBE SELECT o_custkey AS id, o_orderkey AS pk FROM orders)) ORDER BY i LIMIT 1")
def guessed_key_of_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = read(spark, sf_dir, "orders")
    sides = [df.selectExpr("o_orderkey AS pk", "o_custkey AS id", "o_orderdate"), df.selectExpr("o_custkey AS id", "o_orderkey AS pk")]
    return spark.createDataFrame([(k,) for k in guess_key(*([c.name for c in columns_of(s)] for s in sides))], "key string")


@query("SELECT column_name AS key FROM (DESCRIBE SELECT o_orderkey AS pk, o_orderstatus FROM orders) WHERE column_name = 'pk'")
def announced_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The key that was guessed is in the report."""
    df = read(spark, sf_dir, "orders").selectExpr("o_orderkey AS pk", "o_orderstatus")
    return spark.createDataFrame([(k,) for k in json.loads(to_json(run_diff(df, df)))["meta"]["key"]], "key string")


# Strategies, reports and the command line


@query("SELECT * FROM (VALUES ('files', 'join'), ('one server', 'join'), ('server and file', 'hash'), ('two servers', 'hash'), ('without key', 'keyless'), ('wanted', 'hash')) v(sides, strategy) WHERE (SELECT count(*) FROM region) > 0")
def chosen_strategies(spark: SparkSession, sf_dir: str) -> DataFrame:
    file, one, same, other = (bind_frame(read(spark, sf_dir, "region")) for _ in range(4))
    one.postgres, same.postgres, other.postgres = (split_postgres_url(u) for u in ("postgres://h/a/t", "postgres://h/b/t", "postgres://i/a/t"))
    cases = [("files", file, file, RunOptions()), ("one server", one, same, RunOptions()), ("server and file", one, file, RunOptions()), ("two servers", one, other, RunOptions()), ("without key", file, one, RunOptions(strategy="keyless")), ("wanted", file, file, RunOptions(strategy="hash"))]
    return spark.createDataFrame([(n, choose_strategy(a, b, o)) for n, a, b, o in cases], "sides string, strategy string")


_TABLE_LINES = f"SELECT CASE WHEN what LIKE 'cells of %' THEN '| ' || substr(what, 10) || ' | ' || n || ' | ' || least(n, 20) || ' |' ELSE 'Changed rows: ' || n END AS line FROM ({_ORDERS_SQL}) WHERE what LIKE 'cells of %' OR what = 'changed_rows'"


@query(_TABLE_LINES)
def report_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of the section on values."""
    text = to_markdown(run_diff(*base.orders(spark, sf_dir), KEYED)).split("## Value differences")[1].split("### ")[0]
    return spark.createDataFrame([(line,) for line in text.split("\n") if line.startswith(("| o_", "Changed"))], "line string")


@query(base._cells + ' SELECT "column", key, "left", "right" FROM (SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY key) AS n FROM cells) WHERE n <= 5')
def report_json_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = json.loads(to_json(run_diff(*base._shifted(spark, sf_dir), RunOptions(key=("o_orderkey",), sections=frozenset({"values"}), limits=Limits(examples=5)))))
    rows = [(c["column"], e["key"], e["left"], e["right"]) for c in found["values"]["columns"] for e in c["examples"]]
    return spark.createDataFrame(rows, '`column` string, key string, `left` string, `right` string')


@query("SELECT section, n FROM (VALUES ('identical', 0), ('meta', 0), ('schema_version', 1)) v(section, n)  UNION ALL SELECT 'counts', count(*) FROM orders")
def report_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections that were switched off are missing."""
    left, right = base.orders(spark, sf_dir)
    out = json.loads(to_json(run_diff(left, right, RunOptions(key=("o_orderkey",), sections=frozenset({"counts"})))))
    return spark.createDataFrame([(k, {"counts": lambda v: v["left_total"], "schema_version": int}.get(k, lambda _: 0)(v)) for k, v in out.items()], "section string, n long")


@query("SELECT 'identical' AS sides, CASE WHEN count(*) = 0 THEN 0 ELSE 1 END AS code FROM (SELECT * FROM nation EXCEPT SELECT * FROM nation) UNION ALL SELECT 'different', CASE WHEN count(*) = 0 THEN 0 ELSE 1 END FROM (SELECT * FROM nation WHERE n_nationkey <> 3 EXCEPT SELECT * FROM nation UNION ALL SELECT * FROM nation WHERE n_nationkey = 3) UNION ALL SELECT 'missing', 2")
def command_line_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, other = f"{sf_dir}/nation.parquet", shared(spark, "n.parquet")
    read(spark, sf_dir, "nation").where("n_nationkey <> 3").write.parquet(other)
    out = []
    for name, right in (("identical", path), ("different", other), ("missing", f"{other}.none.parquet")):
        with contextlib.redirect_stdout(io.StringIO()), contextlib.redirect_stderr(io.StringIO()):
            out.append((name, main(["diff", path, right, "--key", "n_nationkey", "--no-stats"], spark)))
    return spark.createDataFrame(out, "sides string, code int")


@query(f"SELECT what, n FROM ({_ORDERS_SQL})")
def command_line_json_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report that the command line writes to a file."""
    other = shared(spark, "o.parquet")
    derived(spark, sf_dir, CHANGED_ORDERS, "orders").write.parquet(other)
    with tempfile.TemporaryDirectory() as folder, contextlib.redirect_stdout(io.StringIO()):
        main(["diff", f"{sf_dir}/orders.parquet", other, "--key", "o_orderkey", "--no-stats", "-f", "json", "-o", os.path.join(folder, "r.json")], spark)
        with open(os.path.join(folder, "r.json")) as f:
            out = json.load(f)
    rows = [*out["counts"].items(), ("changed_rows", out["values"]["changed_rows"]), *((f"cells of {c['column']}", c["mismatched_rows"]) for c in out["values"]["columns"])]
    return spark.createDataFrame(rows, "what string, n long")


# Canonical texts


def _text_query(name: str, table: str, key: str, value: str, family: Family, kind: str, text: str, precision: int | None = None) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return read(spark, sf_dir, table).select(key, text_of(F.expr(value), TypeInfo(family, kind, precision), CompareOptions()).alias("text"))

    run.__name__ = f"canonical_{name}_text"
    query(f"SELECT {key}, {text} AS text FROM {table}")(run)


_UUID = "concat_ws('-', substr({h}, 1, 8), substr({h}, 9, 4), substr({h}, 13, 4), substr({h}, 17, 4), substr({h}, 21, 12))"
_text_query("decimal", "orders", "o_orderkey", "cast(o_totalprice as decimal(18,4))", Family.DECIMAL, "decimal(18,4)", r"regexp_replace(CAST(CAST(o_totalprice AS DECIMAL(18,4)) AS VARCHAR), '\.?0+$', '')", 4)
_text_query("date", "orders", "o_orderkey", "cast(o_orderdate as date)", Family.DATE, "date", "strftime(o_orderdate, '%Y-%m-%d')")
_text_query("time", "events", "event_id", "to_time(date_format(ts, 'HH:mm:ss.SSSSSS'))", Family.TIME, "time(6)", "strftime(ts, '%H:%M:%S.%f')")
_text_query("uuid", "customer", "c_custkey", f"upper({_UUID.format(h='md5(c_name)')})", Family.UUID, "uuid", _UUID.format(h="md5(c_name)"))
_text_query("binary", "customer", "c_custkey", "cast(c_name as binary)", Family.BINARY, "binary", "lower(hex(c_name))")
_text_query("boolean", "orders", "o_orderkey", "if(o_orderkey % 5 = 0, null, o_orderkey % 2 = 0)", Family.BOOLEAN, "boolean", "CASE WHEN o_orderkey % 5 = 0 THEN NULL WHEN o_orderkey % 2 = 0 THEN 'true' ELSE 'false' END")
_text_query("float", "orders", "o_orderkey", "o_totalprice - 0.5 * (o_orderkey % 2)", Family.FLOAT, "double", r"regexp_replace(CAST(o_totalprice - 0.5 * (o_orderkey % 2) AS VARCHAR), '\.0$', '')")
_text_query("integer", "lineitem", "l_orderkey", "l_linenumber - 4", Family.INTEGER, "int", "CAST(l_linenumber - 4 AS VARCHAR)")
_text_query("list", "embeddings", "vec_id", "array(label, vec_id)", Family.OTHER, "array<bigint>", "'[' || label || ',' || vec_id || ']'")
