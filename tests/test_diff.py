"""Whole comparisons, by both keyed strategies and without a key."""

import json
from datetime import datetime

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from cellweave.errors import CellweaveError, KeyNotUnique, NoKeyFound, SourceError
from cellweave.options import SECTIONS, CompareOptions, CsvOptions, Limits, RunOptions
from cellweave.plans.engine import choose_strategy, matched, run_diff
from cellweave.plans.report import to_json
from cellweave.sources.bind import bind_frame, bind_source, scoped_conf
from cellweave.sources.spec import split_postgres_url

from .injections import base, cases

CASES = cases()


@pytest.fixture(scope="module")
def files(tmp_path_factory):
    folder = tmp_path_factory.mktemp("sides")
    for name, c in CASES.items():
        pq.write_table(c.left, folder / f"{name}_l.parquet")
        pq.write_table(c.right, folder / f"{name}_r.parquet")
    return folder


@pytest.mark.parametrize("strategy", ["join", "hash"])
@pytest.mark.parametrize("name", CASES)
def test_injections(spark, files, name, strategy):
    case = CASES[name]
    sides = [str(files / f"{name}_{s}.parquet") for s in "lr"]
    options = RunOptions(key=("id",), strategy=strategy, sections=SECTIONS - {"stats"}, limits=Limits(leaf_rows=16), compare=CompareOptions(assume_tz=case.assume_tz))
    if case.duplicate:
        with pytest.raises(KeyNotUnique, match="6"):
            run_diff(*sides, options, spark)
        return
    report = run_diff(*sides, options, spark)
    assert report.cells.differing == case.cells
    assert (report.rows.left, report.rows.right) == (case.left_only, case.right_only)
    assert report.rows.totals == (case.left.num_rows, case.right.num_rows)
    assert report.rows.matched == case.left.num_rows - case.left_only
    seen = {c.name: c.status for c in report.schemas.columns}
    assert {n: seen[n] for n in case.status} == case.status
    assert report.agree == case.identical
    for name, n in report.cells.differing.items():
        assert len(report.cells.samples[name]) == min(20, n)
        assert all(e.left != e.right for e in report.cells.samples[name])


def _frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def _cells(left, right, key="id", **compare):
    strategy = compare.pop("strategy", "join")
    report = run_diff(left, right, RunOptions(key=tuple(key.split(",")), strategy=strategy, sections=SECTIONS - {"stats"}, compare=CompareOptions(**compare)))
    return report.cells.differing, report


def test_json_key_order(spark):
    left = _frame(spark, [(1, '{"a":1,"b":2}'), (2, "[1, 2]"), (3, "no json"), (4, None)], "id long, p string")
    right = _frame(spark, [(1, '{  "b":2, "a":1 }'), (2, "[2, 1]"), (3, "no json"), (4, None)], "id long, p string")
    assert _cells(left, right, json_columns=frozenset({"p"}))[0] == {"p": 1}
    cells, report = _cells(left, right)
    assert cells == {"p": 2} and report.cells.rows == 2


def test_json_changed_rows_follow(spark):
    """Rows that differ only in spelling are not counted as changed."""
    left = _frame(spark, [(1, '{"a":1,"b":2}', 1)], "id long, p string, v int")
    right = _frame(spark, [(1, '{"b":2,"a":1}', 1)], "id long, p string, v int")
    _, report = _cells(left, right, json_columns=frozenset({"p"}))
    assert report.cells.rows == 0 and report.cells.differing == {}


def test_composite_and_null_keys(spark):
    schema = "a int, b string, v int"
    left = _frame(spark, [(1, "x", 1), (1, "y", 2), (None, "z", 3)], schema)
    right = _frame(spark, [(1, "x", 1), (1, "y", 9), (None, "z", 3)], schema)
    assert _cells(left, right, "a,b")[0] == {"v": 1}
    twice = left.union(_frame(spark, [(None, "z", 4)], schema))
    with pytest.raises(KeyNotUnique):
        _cells(twice, right, "a,b")


def test_canonical_keys_must_be_unique(spark):
    """Keys that differ as bytes and agree as texts name one row twice."""
    left = _frame(spark, [("é", 1), ("é", 2)], "id string, v int")
    with pytest.raises(KeyNotUnique):
        _cells(left, left)


def test_missing_key_and_no_key(spark):
    df = _frame(spark, [(1, 2)], "a int, b int")
    with pytest.raises(KeyError, match="left"):
        run_diff(df, df, RunOptions(key=("nope",)))
    with pytest.raises(NoKeyFound, match="a, b"):
        run_diff(df, df)


def test_wrong_options(spark):
    for wrong in ({"strategy": "sideways"}, {"sections": frozenset({"pictures"})}):
        with pytest.raises(CellweaveError):
            RunOptions(**wrong)
    with pytest.raises(CellweaveError):
        Limits(leaf_rows=0)
    for wrong in ({"assume_tz": "Nowhere/Land"}, {"assume_tz": "+02"}, {"ts_precision": "h"}, {"tolerance_abs": -1}):
        with pytest.raises(CellweaveError):
            CompareOptions(**wrong)


def test_tolerances(spark):
    left = _frame(spark, [(1, 100.0), (2, 0.0), (3, None), (4, float("nan")), (5, float("inf")), (6, 1.0)], "id long, v double")
    right = _frame(spark, [(1, 100.4), (2, 0.0), (3, None), (4, float("nan")), (5, float("inf")), (6, None)], "id long, v double")
    assert _cells(left, right, tolerance_abs=0.5)[0] == {"v": 3}
    assert _cells(left, right, tolerance_rel=0.01)[0] == {"v": 3}
    assert _cells(left, right)[0] == {"v": 2}
    ids = _frame(spark, [(1, 1), (2, 2)], "id long, v long")
    assert _cells(ids, ids, tolerance_abs=5)[1].agree


def test_minus_zero_and_float_widths(spark):
    left = _frame(spark, [(1, 0.0), (2, 0.5)], "id long, v double")
    right = _frame(spark, [(1, -0.0), (2, 0.5)], "id long, v double")
    assert _cells(left, right)[0] == {"v": 1}
    single, double = _frame(spark, [(1, 0.1)], "id long, v float"), _frame(spark, [(1, 0.1)], "id long, v double")
    assert _cells(single, double)[0] == {}


def test_numbers_across_families(spark):
    values = [(1, 10000000.0), (2, 0.25), (3, 1e-5), (4, 123456789.5), (5, -3.0)]
    as_decimal = spark.sql("SELECT * FROM VALUES (1L, 10000000.00000), (2L, 0.25000), (3L, 0.00001), (4L, 123456789.50000), (5L, -3.00000) t(id, v)")
    assert _cells(_frame(spark, values, "id long, v double"), as_decimal)[0] == {}


def test_text_against_types(spark):
    left = _frame(spark, [(1, "5"), (2, "x"), (3, " yes"), (4, None)], "id long, v string")
    cells, report = _cells(left, _frame(spark, [(1, 5), (2, None), (3, 7), (4, None)], "id long, v long"))
    assert cells == {"v": 1} and any("2 texts" in w for w in report.notes.beware)
    assert _cells(left, _frame(spark, [(1, True), (2, False), (3, True), (4, None)], "id long, v boolean"))[0] == {"v": 2}


def test_nested_values(spark):
    left = spark.sql("SELECT 1L id, array(1, 2) a, map('x', 1, 'y', 2) m, named_struct('p', 1) s")
    right = spark.sql("SELECT 1L id, array(1, 2) a, map('y', 2, 'x', 1) m, named_struct('p', 2) s")
    assert _cells(left, right)[0] == {"s": 1}
    lists = spark.sql("SELECT 1L id, array(1) v"), spark.sql("SELECT 1L id, named_struct('p', 1) v")
    assert _cells(*lists)[1].schemas.having("incompatible")


def test_precision_and_another_change_in_one_row(spark, tmp_path):
    """The segment strategy must not forget the declared precision of its slices."""
    t = pa.table({"id": [1, 2], "ts": pa.array([datetime(1969, 12, 31, 23, 59, 59, 999999)] * 2, pa.timestamp("us")), "v": [1, 2]})
    coarse = pa.table({"id": [1, 2], "ts": pa.array([datetime(1969, 12, 31, 23, 59, 59, 999000)] * 2, pa.timestamp("ms")), "v": [1, 3]})
    pq.write_table(t, tmp_path / "l.parquet")
    pq.write_table(coarse, tmp_path / "r.parquet")
    for strategy in ("join", "hash"):
        assert _cells(*(str(tmp_path / f"{s}.parquet") for s in "lr"), strategy=strategy)[0] == {"v": 1}


def test_nanoseconds(spark, tmp_path):
    t = pa.table({"id": [1, 2], "ts": pa.array([-1_500, 1_700_000_000_123_456_789], pa.timestamp("ns"))})
    pq.write_table(t, tmp_path / "n.parquet")
    with scoped_conf(spark):
        bound = bind_source(spark, str(tmp_path / "n.parquet"))
        assert [c.precision for c in bound.columns] == [None, 9]
        assert [str(r["ts"]) for r in bound.df.orderBy("id").collect()] == ["1969-12-31 23:59:59.999998", "2023-11-14 22:13:20.123456"]


def test_footers_are_read_where_spark_reads(spark, tmp_path):
    """What Spark's own classes tell of a file is what the local footer tells."""
    from cellweave.sources.bind import remote_footer

    fields = [("id", pa.int64(), False), ("n", pa.timestamp("ns"), True), ("u", pa.timestamp("us", "UTC"), True), ("m", pa.timestamp("ms"), True), ("w", pa.uint32(), True), ("t", pa.time64("us"), True), ("s", pa.string(), True)]
    schema = pa.schema([pa.field(n, t, nullable=x) for n, t, x in fields])
    pq.write_table(pa.table({n: pa.array([1], pa.int64()).cast(t) if n != "s" else pa.array(["x"]) for n, t, _ in fields}, schema=schema), tmp_path / "f.parquet")
    got = remote_footer(spark, f"file://{tmp_path}/f.parquet")
    for f, g in zip(schema, got, strict=True):
        assert f.name == g.name and f.nullable == g.nullable
        assert pa.types.is_binary(g.type) or f.type == g.type, f.name
    assert sum(not pa.types.is_binary(g.type) for g in got) == 5


@pytest.mark.parametrize(("lines", "mark"), [(["a,b", "1,2"], ","), (["a;b", "1,5;2"], ";"), (["a|b|c", "x,y|2|3"], "|"), (["a\tb", '"x\ty"\t2'], "\t"), (["a", "1"], ","), ([], ","), (["a;b;c", 'x;"y', 'z";1'], ";")])
def test_delimiters(lines, mark):
    from cellweave.sources.bind import delimiter

    assert delimiter(lines) == mark


def test_keyless(spark):
    left = _frame(spark, [("A", 1), ("A", 1), ("B", 2)], "x string, y int")
    right = _frame(spark, [("A", 1), ("B", 2), ("B", 2)], "x string, y int")
    report = run_diff(left, right, RunOptions(strategy="keyless"))
    assert report.rows == (1, 1, 2)
    assert not report.agree and report.cells is None and report.profiles is None and report.notes.beware
    turned = right.selectExpr("cast(y as bigint) y", "x")
    same = run_diff(right, turned, RunOptions(strategy="keyless", sections=SECTIONS - {"schema"}))
    assert same.agree


def test_sections(spark):
    df = _frame(spark, [(1, "a")], "id long, v string")
    other = _frame(spark, [(1, "b")], "id long, v string")
    for strategy in ("join", "hash"):
        report = run_diff(df, other, RunOptions(strategy=strategy, sections=frozenset()))
        assert report.agree and set(json.loads(to_json(report))) == {"schema_version", "identical", "meta"}


def test_strategy_choice(spark):
    local = bind_frame(_frame(spark, [(1,)], "id long"))
    remote, other = bind_frame(local.df), bind_frame(local.df)
    remote.postgres = split_postgres_url("postgres://h/db/t")
    other.postgres = split_postgres_url("postgres://h2/db/t")
    assert choose_strategy(local, local, RunOptions()) == "join"
    assert choose_strategy(local, remote, RunOptions()) == choose_strategy(remote, other, RunOptions()) == "hash"
    assert choose_strategy(remote, remote, RunOptions()) == "join"
    assert choose_strategy(local, remote, RunOptions(strategy="keyless")) == "keyless"


@pytest.fixture()
def database(spark, monkeypatch, tmp_path):
    """Two servers, played by DuckDB, that remember what they were asked."""
    import duckdb

    from cellweave.functions import remote_sql
    from cellweave.functions.types import Family
    from cellweave.sources import bind

    texts = remote_sql.POSTGRES.texts | {Family.STRING: "nfc_normalize({c})", Family.DATE: "strftime({c}, '%Y-%m-%d')", Family.TIMESTAMP_NAIVE: "strftime({c}, '%Y-%m-%d %H:%M:%S.%f')", Family.BINARY: "lower(hex({c}))"}
    monkeypatch.setattr(remote_sql, "POSTGRES", remote_sql.Dialect(texts, "CAST('0x' || {h} AS BIGINT)"))
    db, asked = duckdb.connect(), []

    def run(_, url, sql):
        asked.append(sql)
        if "server_version_num" in sql:
            return spark.createDataFrame([(150000,)], "v int")
        return bind.frame_of(spark, db.sql(sql).to_arrow_table())

    monkeypatch.setattr(bind, "postgres_query", run)
    monkeypatch.setattr(bind, "postgres_rows", lambda s, url: run(s, url, f"SELECT * FROM {url.relation}"))
    monkeypatch.setattr(bind, "_versions", {})
    db.sql("CREATE SCHEMA public") if not db.sql("SELECT 1 FROM information_schema.schemata WHERE schema_name = 'public'").fetchall() else None
    columns = "id BIGINT PRIMARY KEY, v VARCHAR, d DECIMAL(12,2), t TIMESTAMP, f BOOLEAN, day DATE, raw BLOB"
    row = "SELECT i AS id, CASE WHEN i % 7 = 0 THEN NULL WHEN i % 5 = 0 THEN 'e' || chr(769) || i ELSE 'v' || i END AS v, i / 4 AS d, TIMESTAMP '2024-01-01' + INTERVAL (i) SECOND AS t, i % 2 = 0 AS f, DATE '1969-12-01' + CAST(i % 90 AS INTEGER) AS day, encode('b' || i) AS raw FROM range(3000) r(i)"
    for name in ("a", "b"):
        db.sql(f"CREATE TABLE public.{name} ({columns})")
        db.sql(f"INSERT INTO public.{name} {row}")
    db.sql("UPDATE public.b SET v = 'other' WHERE id IN (17, 1700)")
    db.sql("UPDATE public.b SET v = nfc_normalize(v), d = d + 1 WHERE id = 25")
    db.sql("DELETE FROM public.b WHERE id = 99")
    yield db, asked
    db.close()


def test_segments_are_compared_in_the_database(spark, database, tmp_path):
    db, asked = database
    sides = "postgres://h1/x/a", "postgres://h2/x/b"
    report = run_diff(*sides, RunOptions(sections=SECTIONS - {"stats"}, limits=Limits(leaf_rows=50)), spark)
    assert report.strategy == "hash" and report.key == ["id"] and report.ran_in == {"left": "pushdown", "right": "pushdown"}
    assert report.rows == (1, 0, 2999) and report.cells.differing == {"d": 1, "v": 2} and report.cells.rows == 3
    pulled = [s for s in asked if " IN (" in s]
    assert len(pulled) == 2 and all(3 < len(db.sql(s).fetchall()) < 400 for s in pulled)
    db.sql("COPY (SELECT * FROM public.b) TO '" + str(tmp_path / "b.parquet") + "' (FORMAT parquet)")
    mixed = run_diff(sides[0], str(tmp_path / "b.parquet"), RunOptions(key=("id",), sections=SECTIONS - {"stats"}, limits=Limits(leaf_rows=50)), spark)
    assert mixed.ran_in == {"left": "pushdown", "right": "local-scan"} and (mixed.rows, mixed.cells.differing) == (report.rows, report.cells.differing)


def test_what_a_database_cannot_spell_is_scanned_here(spark, database):
    """Floating-point texts differ between engines, so such tables are signed by Spark, and the report says so."""
    db, _ = database
    for name, host in (("a", "h1"), ("b", "h2")):
        db.sql(f"ALTER TABLE public.{name} ADD COLUMN x DOUBLE DEFAULT 0.1")
    report = run_diff("postgres://h1/x/a", "postgres://h2/x/b", RunOptions(sections=SECTIONS - {"stats"}), spark)
    assert report.ran_in == {"left": "local-scan", "right": "local-scan"} and report.cells.differing == {"d": 1, "v": 2}


def test_a_database_counts_duplicate_keys(spark, database):
    db, asked = database
    with pytest.raises(KeyNotUnique, match="true"):
        run_diff("postgres://h1/x/a", "postgres://h2/x/b", RunOptions(key=("f",)), spark)
    assert any("HAVING count(*) > 1" in s for s in asked)


def test_settings_come_back(spark):
    spark.conf.set("spark.sql.session.timeZone", "Europe/Berlin")
    try:
        df = _frame(spark, [(1,)], "id long")
        run_diff(df, df)
        assert spark.conf.get("spark.sql.session.timeZone") == "Europe/Berlin"
        assert spark.conf.get("spark.sql.caseSensitive") == "false"
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_lazy_frames(spark):
    left = _frame(spark, [(1, "a"), (2, "b"), (3, "c")], "id long, v string")
    right = _frame(spark, [(1, "a"), (2, "x"), (4, "d")], "id long, v string")
    j = matched(left, right, ["id"])
    assert {tuple(r) for r in j.status().collect()} == {("1", "same"), ("2", "changed"), ("3", "only_left"), ("4", "only_right")}
    assert [tuple(r) for r in j.cell_diffs().collect()] == [("v", "2", "b", "x")]


def test_csv_and_duckdb(spark, tmp_path, monkeypatch):
    import duckdb

    from cellweave.sources import bind

    (tmp_path / "p.csv").write_text("id,name,score\n1,a,1.5\n2,b,\n")
    (tmp_path / "p.tsv").write_text("id\tname\tscore\n1\ta\t1.5\n2\tb\t\n")
    with duckdb.connect(str(tmp_path / "p.duckdb")) as db:
        db.sql("CREATE TABLE people (id BIGINT PRIMARY KEY, name VARCHAR, score DOUBLE)")
        db.sql("INSERT INTO people VALUES (1, 'a', 1.5), (2, 'c', NULL)")
    assert run_diff(str(tmp_path / "p.csv"), str(tmp_path / "p.tsv"), spark=spark).agree
    report = run_diff(str(tmp_path / "p.csv"), f"duckdb://{tmp_path}/p.duckdb/people", RunOptions(key=("id",)), spark)
    assert report.cells.differing == {"name": 1}
    texts = run_diff(str(tmp_path / "p.csv"), str(tmp_path / "p.csv"), RunOptions(csv=CsvOptions(as_text=True)), spark)
    assert {c.types[0] for c in texts.schemas.columns} == {"string"}
    (tmp_path / "p.txt").write_text('id;name;score\n1;"a";1.5\n2;b;\n')
    assert run_diff(str(tmp_path / "p.csv"), str(tmp_path / "p.txt"), RunOptions(csv=CsvOptions(line_breaks=False)), spark).agree
    monkeypatch.setattr(bind, "DUCKDB_ROWS", 0)
    again = run_diff(str(tmp_path / "p.csv"), f"duckdb://{tmp_path}/p.duckdb/people", RunOptions(key=("id",)), spark)
    assert again.cells == report.cells
    for missing in (str(tmp_path / "none.parquet"), f"duckdb://{tmp_path}/none.duckdb/t", f"duckdb://{tmp_path}/p.duckdb/none", "what.xlsx"):
        with pytest.raises(SourceError):
            run_diff(missing, missing, spark=spark)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.text(max_size=6), st.floats(), st.booleans()), max_size=12))
def test_a_table_is_identical_to_itself(spark, rows):
    rows = [(i, *(None if isinstance(x, str) and "\ud800" <= x[:1] <= "\udfff" else x for x in r)) for i, r in enumerate(rows)]
    df = _frame(spark, rows, "id int, a string, b double, c boolean")
    for strategy in ("join", "hash"):
        assert run_diff(df, df, RunOptions(strategy=strategy)).agree
    assert run_diff(df, df, RunOptions(strategy="keyless")).agree


def test_base_is_the_same_each_time():
    assert base().equals(base())
