"""Families of types, and what it means when two columns are of different types."""

from __future__ import annotations

import re
from dataclasses import dataclass
from enum import Enum

from ..model import ColumnInfo
from ..options import PRECISIONS, CompareOptions


class Family(Enum):
    BOOLEAN = "boolean"
    INTEGER = "integer"
    FLOAT = "float"
    DECIMAL = "decimal"
    STRING = "string"
    BINARY = "binary"
    DATE = "date"
    TIME = "time"
    TIMESTAMP_NAIVE = "timestamp_naive"
    TIMESTAMP_TZ = "timestamp_tz"
    JSON = "json"
    UUID = "uuid"
    OTHER = "other"


class Verdict(Enum):
    SAME = "same"
    BENIGN = "benign"
    WIDENING = "widening"
    LOSSY = "lossy"
    NEEDS_TZ = "needs_tz"
    BOOL_ALIAS = "bool_alias"
    STRING_CAST = "string_cast"
    INCOMPATIBLE = "incompatible"

    @property
    def comparable(self) -> bool:
        return self not in (Verdict.NEEDS_TZ, Verdict.INCOMPATIBLE)


#: Spellings of types (fixed values); anything else is OTHER.
SPELLINGS = {
    Family.BOOLEAN: "boolean bool",
    Family.INTEGER: "tinyint smallint int integer bigint hugeint utinyint usmallint uinteger ubigint uhugeint int2 int4 int8 short long byte uint8 uint16 uint32 uint64",
    Family.FLOAT: "float double real float4 float8",
    Family.STRING: "string varchar char bpchar text",
    Family.BINARY: "binary blob bytea varbinary",
    Family.DATE: "date",
    Family.JSON: "json jsonb variant",
    Family.UUID: "uuid",
}
_FAMILY = {spelling: family for family, text in SPELLINGS.items() for spelling in text.split()} | {"character varying": Family.STRING, "double precision": Family.FLOAT}
NUMBERS = frozenset({Family.INTEGER, Family.FLOAT, Family.DECIMAL})
TIMESTAMPS = frozenset({Family.TIMESTAMP_NAIVE, Family.TIMESTAMP_TZ})
#: Families that text may be cast to.
FROM_TEXT = NUMBERS | TIMESTAMPS | {Family.DATE, Family.TIME, Family.UUID, Family.JSON}


@dataclass(frozen=True)
class TypeInfo:
    """`precision`: digits after the second of timestamps, or the scale of decimals."""

    family: Family
    type: str
    precision: int | None = None
    nullable: bool = True

    @property
    def is_numeric(self) -> bool:
        return self.family in NUMBERS

    @property
    def is_temporal(self) -> bool:
        return self.family in TIMESTAMPS


@dataclass(frozen=True)
class PairClass:
    verdict: Verdict
    note: str = ""


_TIMESTAMP = re.compile(r"timestamp(?:_(s|ms|us|ns|ntz|ltz|tz))?(?:\((\d)\))?( with time zone| without time zone)?$")


def parse_type(column: ColumnInfo) -> TypeInfo:
    """The family of a declared type: Spark's names, or the usual SQL ones.

    Spark's `timestamp` has a zone and `timestamp_ntz` has none; SQL spellings
    that name a zone or a unit mean what they say.
    """
    spelled = re.sub(r"\s+", " ", column.logical or column.type).strip().lower()
    if spelled in _FAMILY:
        return TypeInfo(_FAMILY[spelled], spelled, None, column.nullable)
    if m := re.fullmatch(r"(?:decimal|numeric) ?\((\d+) ?, ?(\d+)\)", spelled):
        return TypeInfo(Family.DECIMAL, f"decimal({m[1]},{m[2]})", int(m[2]), column.nullable)
    if spelled == "numeric":
        return TypeInfo(Family.DECIMAL, spelled, 0, column.nullable)
    if m := _TIMESTAMP.match(spelled):
        unit, digits, zone = m.groups()
        zoned = zone == " with time zone" or unit in ("ltz", "tz") or (unit, zone) == (None, None)
        given = int(digits) if digits else PRECISIONS.get(unit or "", 6)
        return TypeInfo(Family.TIMESTAMP_TZ if zoned else Family.TIMESTAMP_NAIVE, spelled, given if column.precision is None else column.precision, column.nullable)
    if re.match(r"time(\(|tz| |$)", spelled):
        return TypeInfo(Family.TIME, spelled, None, column.nullable)
    return TypeInfo(Family.OTHER, spelled, None, column.nullable)


def _kind(spelled: str) -> str:
    return re.split(r"[<(\[ ]", spelled)[0]


def _same_family(a: TypeInfo, b: TypeInfo) -> PairClass:
    if a.is_temporal and a.precision != b.precision:
        return PairClass(Verdict.BENIGN, f"timestamp precision differs ({a.precision} and {b.precision} digits)")
    if a.type == b.type or a.family in (Family.STRING, Family.BOOLEAN, Family.DATE):
        return PairClass(Verdict.SAME)
    if a.family is Family.INTEGER:
        return PairClass(Verdict.WIDENING, f"integer widths differ ({a.type}/{b.type})")
    if a.family is Family.DECIMAL:
        return PairClass(Verdict.BENIGN, f"decimal scales differ ({a.type}/{b.type})")
    if a.family is Family.OTHER and _kind(a.type) != _kind(b.type):
        return PairClass(Verdict.INCOMPATIBLE, f"no rule for {a.type} and {b.type}")
    return PairClass(Verdict.BENIGN, f"spelled differently ({a.type}/{b.type})")


def classify(left: TypeInfo, right: TypeInfo) -> PairClass:
    """What a pair of types means for the comparison of its values."""
    if left.family is right.family:
        return _same_family(left, right)
    families = {left.family, right.family}
    if families <= NUMBERS:
        if Family.FLOAT in families:
            return PairClass(Verdict.LOSSY, "one side is floating point; use tolerances for computed values")
        return PairClass(Verdict.WIDENING, f"exact numbers of different families ({left.type}/{right.type})")
    if families == TIMESTAMPS:
        return PairClass(Verdict.NEEDS_TZ, "only one side has a time zone; assume_tz says how to read the other")
    if Family.STRING in families:
        other = right if left.family is Family.STRING else left
        if other.family is Family.BOOLEAN:
            return PairClass(Verdict.BOOL_ALIAS, "one side holds booleans as text")
        if other.family in FROM_TEXT:
            return PairClass(Verdict.STRING_CAST, f"one side holds {other.type} as text")
    return PairClass(Verdict.INCOMPATIBLE, f"no rule for {left.type} and {right.type}")


def effective_precision(left: TypeInfo, right: TypeInfo, options: CompareOptions) -> int | None:
    """Digits after the second at which timestamps are compared."""
    known = [t.precision for t in (left, right) if t.is_temporal and t.precision is not None]
    if not known:
        return None
    return min(known) if options.ts_precision == "coarse" else PRECISIONS[options.ts_precision]
