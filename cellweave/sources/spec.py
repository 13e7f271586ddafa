"""How a source is named on the command line.

*.parquet, *.csv, *.tsv, *.txt; duckdb://path/table; postgres://user@host/db[/schema]/table
(or postgresql://); table:name for a table of the catalogue.
"""

from __future__ import annotations

from dataclasses import dataclass
from urllib.parse import unquote, urlsplit

from ..errors import SourceError

_FILES = {".parquet": "parquet", ".csv": "csv", ".tsv": "csv", ".txt": "csv"}


@dataclass(frozen=True)
class Spec:
    kind: str  # parquet, csv, duckdb, postgres or table
    path: str  # a file, or the database part of a URL
    table: str | None = None
    schema: str | None = None


@dataclass(frozen=True)
class PostgresUrl:
    host: str
    port: int
    database: str
    schema: str
    table: str
    user: str | None
    password: str | None

    @property
    def jdbc(self) -> str:
        return f"jdbc:postgresql://{self.host}:{self.port}/{self.database}"

    @property
    def instance(self) -> tuple[str, int]:
        """Rows of two tables of one server leave one place only."""
        return self.host, self.port

    @property
    def relation(self) -> str:
        return ".".join('"' + x.replace('"', '""') + '"' for x in (self.schema, self.table))


def split_postgres_url(url: str) -> PostgresUrl:
    parts = urlsplit(url)
    names = [unquote(x) for x in parts.path.split("/") if x]
    if not parts.hostname or len(names) not in (2, 3):
        raise SourceError(f"not postgres://host/database[/schema]/table: {url!r}")
    schema = names[1] if len(names) == 3 else "public"
    return PostgresUrl(parts.hostname, parts.port or 5432, names[0], schema, names[-1], unquote(parts.username) if parts.username else None, unquote(parts.password) if parts.password else None)


def parse_source_spec(spec: str) -> Spec:
    head, mark, rest = spec.partition("://")
    if mark and head in ("postgres", "postgresql"):
        url = split_postgres_url(spec)
        return Spec("postgres", spec, url.table, url.schema)
    if mark and head == "duckdb":
        path, _, table = rest.rpartition("/")
        if not path or not table:
            raise SourceError(f"not duckdb://path/table: {spec!r}")
        return Spec("duckdb", path, table)
    if spec.startswith("table:") and spec[6:]:
        return Spec("table", spec, spec[6:])
    for ending, kind in _FILES.items():
        if spec.rstrip("/").lower().endswith(ending):
            return Spec(kind, spec)
    raise SourceError(f"cannot tell what kind of source this is: {spec!r}")
