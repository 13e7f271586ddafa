"""Canonical texts, signatures and slices as SQL, for a database that keeps its rows."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from .canonical import NULL_MARK
from .equality import Pair
from .types import Family


@dataclass(frozen=True)
class Dialect:
    """What databases spell differently; {c} is a column, {h} a hexadecimal text of 15 digits."""

    texts: dict[Family, str]
    number: str
    truncated: str = "date_trunc('{unit}', {c})"


POSTGRES = Dialect(
    {
        Family.BOOLEAN: "CASE {c} WHEN true THEN 'true' WHEN false THEN 'false' END",
        Family.INTEGER: "CAST({c} AS TEXT)",
        Family.DECIMAL: "CAST({c} AS TEXT)",
        Family.STRING: "normalize({c}, NFC)",
        Family.DATE: "to_char({c}, 'YYYY-MM-DD')",
        Family.TIMESTAMP_NAIVE: "to_char({c}, 'YYYY-MM-DD HH24:MI:SS.US')",
        Family.TIMESTAMP_TZ: "to_char({c} AT TIME ZONE 'UTC', 'YYYY-MM-DD HH24:MI:SS.US')",
        Family.BINARY: "encode({c}, 'hex')",
        Family.UUID: "lower(CAST({c} AS TEXT))",
    },
    "CAST(CAST(('x' || {h}) AS BIT(60)) AS BIGINT)",
)
#: Differing segments that are named in one statement; more take several.
NAMED = 1000


def quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def pushable(pair: Pair, dialect: Dialect) -> bool:
    """Whether the database gives the same text as Spark: like types, with one spelling everywhere."""
    family = pair.left.family
    plain = family is pair.right.family and family in dialect.texts and not pair.is_json
    zoned = family is Family.TIMESTAMP_NAIVE and pair.options.assume_tz
    return plain and not zoned and (family is not Family.DECIMAL or pair.left.type == pair.right.type)


def text_sql(pair: Pair, dialect: Dialect) -> str:
    c, family = quoted(pair.name), pair.left.family
    if family is Family.STRING and pair.options.treat_empty_as_null:
        c = f"nullif({c}, '')"
    if pair.left.is_temporal and pair.digits in (0, 3):
        c = dialect.truncated.format(unit={0: "second", 3: "millisecond"}[pair.digits], c=c)
    return dialect.texts[family].format(c=c)


def fields_sql(texts: Iterable[str]) -> str:
    """One text of several, as `canonical.fields_text` makes it."""
    marked = [f"coalesce({t}, chr(1) || '{NULL_MARK[1:-1]}' || chr(1))" for t in texts]
    return " || ".join(f"CAST(length({m}) AS TEXT) || ':' || {m}" for m in marked)


def key_hash_sql(key: list[Pair], dialect: Dialect) -> str:
    return f"md5({fields_sql(text_sql(p, dialect) for p in key)})"


def signature_sql(relation: str, pairs: dict[str, Pair], key: list[str], digits: int, dialect: Dialect = POSTGRES) -> str:
    """(bucket, n, h1, h2, pr) of each segment."""
    row = fields_sql(text_sql(p, dialect) for p in pairs.values())
    numbers = ", ".join(f"{dialect.number.format(h=f'substr(h, {at}, 15)')} AS {n}" for at, n in ((1, "h1"), (16, "h2")))
    m = 2147483629  # fixed value, as in functions.hashing
    hashed = f"SELECT substr({key_hash_sql([pairs[k] for k in key], dialect)}, 1, {digits}) AS bucket, md5({row}) AS h FROM {relation}"
    sums = ", ".join(f"CAST(sum({e}) AS DECIMAL(38,0)) AS {n}" for e, n in (("h1", "h1"), ("h2", "h2"), (f"((h1 % {m}) * (h2 % {m})) % {m}", "pr")))
    return f"SELECT bucket, count(*) AS n, {sums} FROM (SELECT bucket, {numbers} FROM ({hashed}) a) b GROUP BY bucket"


def slice_sql(relation: str, columns: list[str], key: list[Pair], buckets: list[str], dialect: Dialect = POSTGRES) -> list[str]:
    """Statements that give the rows of some segments, NAMED of them each."""
    wanted, at = ", ".join(map(quoted, columns)), f"substr({key_hash_sql(key, dialect)}, 1, {len(buckets[0]) if buckets else 1})"
    parts = [buckets[i : i + NAMED] for i in range(0, len(buckets), NAMED)] or [[]]
    return [f"SELECT {wanted} FROM {relation} WHERE {at} IN ({', '.join(repr(b) for b in p)})" if p else f"SELECT {wanted} FROM {relation} WHERE 1 = 0" for p in parts]


def duplicate_sql(relation: str, key: list[Pair], dialect: Dialect = POSTGRES) -> str:
    """The three keys that most rows have, of those that several have."""
    texts = ", ".join(f"{text_sql(p, dialect)} AS k{i}" for i, p in enumerate(key))
    names = ", ".join(f"k{i}" for i in range(len(key)))
    return f"SELECT {names}, count(*) AS n FROM (SELECT {texts} FROM {relation}) t GROUP BY {names} HAVING count(*) > 1 ORDER BY n DESC, {names} LIMIT 3"
