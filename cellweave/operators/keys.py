"""Keys: which columns, and whether they name one row each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from ..errors import KeyNotUnique, NoKeyFound
from ..functions.canonical import fields_text
from ..functions.equality import Pair
from ..functions.types import Family

#: Names that are taken for a key, in this order (fixed values).
USUAL_NAMES = ("id", "pk", "uuid", "guid")
#: Families that are joined on as they are; others on their canonical text.
_TYPED = frozenset({Family.BOOLEAN, Family.INTEGER, Family.DATE, Family.BINARY})


def col(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def guess_key(left: list[str], right: list[str], left_hint: list[str] | None = None, right_hint: list[str] | None = None) -> list[str]:
    """The primary key that both sides declare, else a usual name that both have."""
    shared = [n for n in left if n in set(right)]
    if left_hint and right_hint and set(left_hint) == set(right_hint) <= set(shared):
        return list(left_hint)
    for name in USUAL_NAMES:
        if name in shared:
            return [name]
    listed = ", ".join(shared[:12]) + (", ..." if len(shared) > 12 else "")
    raise NoKeyFound(f"no key was given and none can be guessed; shared columns: {listed or 'none'}")


def require_columns(names: list[str], key: list[str], side: str) -> None:
    missing = [k for k in key if k not in names]
    if missing:
        raise KeyError(f"key column {missing[0]!r} is not in the {side} source")


def key_columns(pairs: list[Pair], side: str) -> list[Column]:
    """What is joined on: values where equal values are equal texts, else texts; nulls are kept."""
    out = []
    for p in pairs:
        value = col(p.name)
        out.append(value if p.left.family is p.right.family and p.left.family in _TYPED else p.text(value, side))
    return out


def key_text(pairs: list[Pair], side: str) -> Column:
    """The canonical key as one text, never null."""
    return fields_text([p.text(col(p.name), side) for p in pairs])


def shown_key(pairs: list[Pair], columns: list[Column]) -> Column:
    texts = [F.coalesce(c.cast("string") if p.left.family is not Family.BINARY else F.hex(c), F.lit("NULL")) for p, c in zip(pairs, columns, strict=True)]
    return F.concat_ws(", ", *texts)


def duplicate_keys(df: DataFrame, keys: list[Column]) -> DataFrame:
    """(k0, ..., n): key values that several rows have; nulls are values like others."""
    named = [k.alias(f"k{i}") for i, k in enumerate(keys)]
    return df.groupBy(*named).agg(F.count("*").alias("n")).where("n > 1")


def worst_keys(df: DataFrame, keys: list[Column]) -> DataFrame:
    """The three keys that most rows have, of those that several have."""
    return duplicate_keys(df, keys).orderBy(F.desc("n"), *(f"k{i}" for i in range(len(keys)))).limit(3)


def check_unique(df: DataFrame, pairs: list[Pair], side: str, found: list[Row] | None = None) -> None:
    """Raises KeyNotUnique with up to three of the most frequent keys; `found`: these, where they are known."""
    worst = worst_keys(df, key_columns(pairs, side)).collect() if found is None else found
    if worst:
        shown = "; ".join(f"({', '.join(repr(v) for v in r[:-1])}) x{r['n']}" for r in worst)
        raise KeyNotUnique(f"key {[p.name for p in pairs]} is not unique on the {side} side: {shown}")
