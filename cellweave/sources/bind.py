"""Sources as DataFrames, with the facts about their columns that Spark's schema loses."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field, replace
from functools import reduce

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import SourceError
from ..model import ColumnInfo
from ..functions import remote_sql
from ..functions.equality import Pair
from ..operators.keys import col
from ..options import CsvOptions
from .spec import PostgresUrl, Spec, parse_source_spec, split_postgres_url

#: Settings under which sources are read and compared.
CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.caseSensitive": "true",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.timeType.enabled": "true",
    "spark.sql.legacy.parquet.nanosAsLong": "true",
    "spark.sql.adaptive.enabled": "true",
}
POSTGRES_PARTS = 16
DUCKDB_ROWS, DUCKDB_BATCH = 1_000_000, 100_000  # rows of a database file that pass through the driver's memory
_UNIT_DIGITS = {"s": 0, "ms": 3, "us": 6, "ns": 9}


@contextmanager
def scoped_conf(spark: SparkSession, **more: str) -> Iterator[None]:
    """CONF for the time of a comparison; what was set before comes back."""
    wanted = CONF | more
    before = {k: spark.conf.get(k, None) for k in wanted}
    try:
        for k, v in wanted.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


@dataclass(frozen=True)
class Remote:
    """Statements that run in the database of a side, on its own rows."""

    spark: SparkSession
    url: PostgresUrl
    columns: tuple[str, ...]

    def takes(self, pairs: dict[str, Pair]) -> bool:
        """Whether signatures can be computed there: like types throughout, and a server that normalises Unicode."""
        return all(remote_sql.pushable(p, remote_sql.POSTGRES) for p in pairs.values()) and server_version(self.spark, self.url) >= 130000

    def count(self) -> int:
        return int(postgres_query(self.spark, self.url, f"SELECT count(*) AS n FROM {self.url.relation}").first()[0])

    def signatures(self, pairs: dict[str, Pair], key: list[str], digits: int) -> DataFrame:
        rows = postgres_query(self.spark, self.url, remote_sql.signature_sql(self.url.relation, pairs, key, digits, remote_sql.POSTGRES))
        return rows.select("bucket", F.col("n").cast("bigint").alias("n"), *(F.col(c).cast("decimal(38,0)").alias(c) for c in ("h1", "h2", "pr")))

    def rows(self, pairs: dict[str, Pair], key: list[str], buckets: list[str]) -> DataFrame:
        statements = remote_sql.slice_sql(self.url.relation, list(self.columns), [pairs[k] for k in key], buckets, remote_sql.POSTGRES)
        return reduce(DataFrame.unionByName, (postgres_query(self.spark, self.url, s) for s in statements))

    def duplicates(self, key: list[Pair]) -> list:
        return postgres_query(self.spark, self.url, remote_sql.duplicate_sql(self.url.relation, key, remote_sql.POSTGRES)).collect()


_versions: dict[tuple, int] = {}


def server_version(spark: SparkSession, url: PostgresUrl) -> int:
    """The server's version as a number; asked once for each server."""
    if url.instance not in _versions:
        _versions[url.instance] = int(postgres_query(spark, url, "SELECT CAST(current_setting('server_version_num') AS INTEGER) AS v").first()[0])
    return _versions[url.instance]


@dataclass
class BoundSource:
    """A side of a comparison."""

    df: DataFrame
    columns: list[ColumnInfo]
    primary_key: list[str] = field(default_factory=list)
    postgres: PostgresUrl | None = None
    remote: Remote | None = None

    def select(self, names: list[str]) -> BoundSource:
        return replace(self, df=self.df.select(*(col(n) for n in names)), columns=[c for c in self.columns if c.name in names])


def columns_of(df: DataFrame) -> list[ColumnInfo]:
    """Columns as Spark knows them; field metadata may name `logical`, `precision` and `nullable`."""
    return [ColumnInfo(f.name, f.dataType.simpleString(), f.metadata.get("nullable", f.nullable), f.metadata.get("precision"), f.metadata.get("logical")) for f in df.schema.fields]


def bind_frame(df: DataFrame, primary_key: list[str] | None = None) -> BoundSource:
    return BoundSource(df, columns_of(df), list(primary_key or []))


def bind_source(spark: SparkSession, source: str | DataFrame | BoundSource, csv: CsvOptions = CsvOptions()) -> BoundSource:
    """A source by its specification, or a DataFrame."""
    if isinstance(source, BoundSource):
        return source
    if isinstance(source, DataFrame):
        return bind_frame(source)
    spec = parse_source_spec(source)
    try:
        return {"parquet": _parquet, "csv": _csv, "duckdb": _duckdb, "postgres": _postgres, "table": _table}[spec.kind](spark, spec, csv)
    except AnalysisException as e:
        raise SourceError(f"cannot read {source!r}: {e.getMessage() if hasattr(e, 'getMessage') else e}") from e


def _footer(spark: SparkSession, path: str) -> pa.Schema | None:
    """The schema in a file's footer (of a folder, its first file's)."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(conf)
    if not fs.exists(at):
        return None
    if fs.getFileStatus(at).isDirectory():
        files = sorted(str(f.getPath()) for f in fs.listStatus(at) if str(f.getPath()).endswith(".parquet"))
        if not files:
            return None
        path = files[0]
    local = path.removeprefix("file://").removeprefix("file:")
    return pq.read_schema(local) if os.path.exists(local) else remote_footer(spark, path)


def remote_footer(spark: SparkSession, path: str) -> pa.Schema:
    """What `overlay` needs to know, read by Spark's own Parquet classes from wherever Spark can read."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    reader = jvm.org.apache.parquet.hadoop.ParquetFileReader.open(jvm.org.apache.parquet.hadoop.util.HadoopInputFile.fromPath(jvm.org.apache.hadoop.fs.Path(path), conf))
    try:
        declared = [(f.getName(), f.getRepetition().toString(), str(f.getLogicalTypeAnnotation() or "")) for f in reader.getFooter().getFileMetaData().getSchema().getFields()]
    finally:
        reader.close()
    return pa.schema([pa.field(name, _logical(kind), nullable=repetition != "REQUIRED") for name, repetition, kind in declared])


def _logical(kind: str) -> pa.DataType:
    """The type that Parquet's text of a logical type stands for, as far as `overlay` looks at it (else binary)."""
    head, _, rest = kind.rstrip(")").partition("(")
    unit, _, flag = rest.partition(",")
    units = {"MILLIS": "ms", "MICROS": "us", "NANOS": "ns"}
    if head == "TIMESTAMP":
        return pa.timestamp(units[unit], "UTC" if flag == "true" else None)
    if head == "TIME":
        return pa.time32("ms") if unit == "MILLIS" else pa.time64(units[unit])
    if head == "INTEGER" and flag == "false":
        return pa.type_for_alias(f"uint{unit}")
    return pa.binary()


def _parquet(spark: SparkSession, spec: Spec, _: CsvOptions) -> BoundSource:
    footer = _footer(spark, spec.path)
    for f in footer or ():
        if pa.types.is_time32(f.type):
            raise SourceError(f"column {f.name!r}: times in milliseconds cannot be read from Parquet; write them in microseconds")
    df = spark.read.parquet(spec.path)
    return overlay(df, footer) if footer is not None else bind_frame(df)


def overlay(df: DataFrame, footer: pa.Schema) -> BoundSource:
    """Time units, nullability and unsigned types of a file's footer; nanoseconds become timestamps."""
    columns, select = [], []
    for info in columns_of(df):
        at = footer.get_all_field_indices(info.name)
        f = footer.field(at[0]) if at else None
        c = col(info.name)
        if f is not None:
            info = replace(info, nullable=f.nullable)
            if pa.types.is_timestamp(f.type):
                info = replace(info, precision=_UNIT_DIGITS[f.type.unit])
                if info.type == "bigint":  # nanoseconds, read as numbers; the floor keeps times before 1970 in order
                    c = F.timestamp_micros(F.expr(f"({_sql(info.name)} - pmod({_sql(info.name)}, 1000L)) div 1000L"))
                    zoned = f.type.tz is not None
                    c = (c if zoned else c.cast("timestamp_ntz")).alias(info.name)
                    info = replace(info, type="timestamp" if zoned else "timestamp_ntz")
            elif pa.types.is_unsigned_integer(f.type):
                info = replace(info, logical=str(f.type))
            elif str(f.type) in ("extension<arrow.uuid>", "extension<arrow.json>"):
                info = replace(info, logical=str(f.type)[16:-1])
        columns.append(info)
        select.append(c)
    return BoundSource(df.select(*select), columns)


def _sql(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def delimiter(lines: list[str]) -> str:
    """What separates the cells: of the usual marks the one that cuts all lines into the most, equally many cells."""
    best = (1, ",")
    for mark in (",", "\t", ";", "|"):
        cells = {line.count(mark) + 1 for line in (_unquoted(x) for x in lines) if line}
        if len(cells) == 1 and max(cells) > best[0]:
            best = (max(cells), mark)
    if best[0] == 1 and lines:  # lines that do not agree (cells with line breaks): the header decides
        head = _unquoted(lines[0])
        best = max((head.count(m) + 1, -i, m) for i, m in enumerate((",", "\t", ";", "|")))[::2]
    return best[1]


def _unquoted(line: str) -> str:
    return "".join(line.split('"')[::2])


def _csv(spark: SparkSession, spec: Spec, csv: CsvOptions) -> BoundSource:
    tab = spec.path.rstrip("/").lower().endswith(".tsv")
    mark = "\t" if tab else delimiter([r[0] for r in spark.read.text(spec.path).limit(20).collect()])
    return bind_frame(spark.read.csv(spec.path, header=True, sep=mark, inferSchema=not csv.as_text, quote='"', escape='"', multiLine=csv.line_breaks))


def _table(spark: SparkSession, spec: Spec, _: CsvOptions) -> BoundSource:
    return bind_frame(spark.table(spec.table))


def frame_of(spark: SparkSession, table: pa.Table) -> DataFrame:
    """Rows that the driver holds; timestamps without a zone stay without one."""
    with scoped_conf(spark, **{"spark.sql.timestampType": "TIMESTAMP_NTZ"}):
        return spark.createDataFrame(table)


def _shipped(spark: SparkSession, batches: pa.RecordBatchReader) -> DataFrame:
    """Rows that the driver reads batch by batch, as a Parquet file in the warehouse folder, which executors can read."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    folder = jvm.org.apache.hadoop.fs.Path(spark.conf.get("spark.sql.warehouse.dir"), "_shipped")
    target = jvm.org.apache.hadoop.fs.Path(folder, f"{uuid.uuid4().hex}.parquet")
    with tempfile.TemporaryDirectory() as own:
        with pq.ParquetWriter(f"{own}/rows.parquet", batches.schema) as out:
            for batch in batches:
                out.write_batch(batch)
        fs = folder.getFileSystem(conf)
        fs.mkdirs(folder)
        fs.copyFromLocalFile(jvm.org.apache.hadoop.fs.Path(f"file://{own}/rows.parquet"), target)
    return spark.read.parquet(target.toString())


def _duckdb(spark: SparkSession, spec: Spec, _: CsvOptions) -> BoundSource:
    try:
        import duckdb
    except ImportError as e:
        raise SourceError("duckdb:// sources need the duckdb package") from e
    if not os.path.exists(spec.path):
        raise SourceError(f"no such database: {spec.path!r}")
    try:
        with duckdb.connect(spec.path, read_only=True) as db:
            quoted = '"' + spec.table.replace('"', '""') + '"'
            described = db.sql(f"DESCRIBE {quoted}").fetchall()
            rows = db.sql(f"SELECT count(*) FROM {quoted}").fetchall()[0][0]
            result = db.sql(f"SELECT * FROM {quoted}")
            df = frame_of(spark, result.to_arrow_table()) if rows <= DUCKDB_ROWS else _shipped(spark, result.to_arrow_reader(DUCKDB_BATCH))
    except duckdb.Error as e:
        raise SourceError(f"cannot read {spec.table!r}: {e}") from e
    bound = bind_frame(df)
    declared = {r[0]: r for r in described}
    kinds = {"UUID": "uuid", "JSON": "json", "UBIGINT": "uint64", "HUGEINT": "hugeint"}
    bound.columns = [replace(c, nullable=declared[c.name][2] == "YES", logical=kinds.get(declared[c.name][1], c.logical)) for c in bound.columns]
    bound.primary_key = [r[0] for r in described if r[3] == "PRI"]
    return bound


def postgres_query(spark: SparkSession, url: PostgresUrl, query: str) -> DataFrame:
    """Rows of a query that runs in the database; needs the database's JDBC driver on Spark's class path."""
    reader = spark.read.format("jdbc").option("url", url.jdbc).option("query", query).option("driver", "org.postgresql.Driver")
    for name, value in (("user", url.user), ("password", url.password)):
        if value is not None:
            reader = reader.option(name, value)
    try:
        return reader.load()
    except Exception as e:
        raise SourceError(f"cannot query {url.host}: {e}") from e


def postgres_rows(spark: SparkSession, url: PostgresUrl) -> DataFrame:
    """All rows, in POSTGRES_PARTS parts by their place in the table, each read by a task of its own."""
    pages = postgres_query(spark, url, f"SELECT greatest(pg_relation_size('{url.relation}') / 8192, 1) AS pages").first()[0]
    step = max(1, -(-int(pages) // POSTGRES_PARTS))
    bounds = [f"'({i * step},0)'::tid" for i in range(POSTGRES_PARTS)]
    parts = [" AND ".join([f"ctid >= {low}", *([f"ctid < {high}"] if high else [])]) for low, high in zip(bounds, [*bounds[1:], None], strict=True)]
    properties = {"driver": "org.postgresql.Driver"} | {n: v for n, v in (("user", url.user), ("password", url.password)) if v is not None}
    try:
        return spark.read.jdbc(url.jdbc, url.relation, predicates=parts, properties=properties)
    except Exception as e:
        raise SourceError(f"cannot read {url.relation} of {url.host}: {e}") from e


def _postgres(spark: SparkSession, spec: Spec, _: CsvOptions) -> BoundSource:
    url = split_postgres_url(spec.path)
    df = postgres_rows(spark, url)
    where = "table_schema = '{}' AND table_name = '{}'".format(*(x.replace("'", "''") for x in (url.schema, url.table)))
    declared = {r[0]: r for r in postgres_query(spark, url, f"SELECT column_name, is_nullable, data_type FROM information_schema.columns WHERE {where}").collect()}
    key = postgres_query(
        spark,
        url,
        "SELECT k.column_name, k.ordinal_position FROM information_schema.table_constraints t JOIN information_schema.key_column_usage k "
        f"USING (constraint_name, table_schema, table_name) WHERE constraint_type = 'PRIMARY KEY' AND {where}",
    ).collect()
    kinds = {"uuid": "uuid", "json": "json", "jsonb": "jsonb"}
    columns = [replace(c, nullable=declared[c.name][1] == "YES", logical=kinds.get(declared[c.name][2])) if c.name in declared else c for c in columns_of(df)]
    return BoundSource(df, columns, [r[0] for r in sorted(key, key=lambda r: r[1])], url, Remote(spark, url, tuple(df.columns)))
