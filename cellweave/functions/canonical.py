"""Canonical text: two values are equal when their canonical texts are.

All expressions are built-in and safe under ANSI mode.  Only Unicode
normalisation needs Python; it runs in Arrow batches, on columns in which some
value is not ASCII, and sees nulls in place of the ASCII values.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as St

from ..options import CompareOptions
from .types import Family, TypeInfo

NULL_MARK = "\x01null\x01"
BAD_BOOLEAN = "\x01not a boolean\x01"
#: Texts that stand for booleans (fixed values).
TRUE_TEXTS = ("true", "t", "yes", "y", "1")
FALSE_TEXTS = ("false", "f", "no", "n", "0")


@F.pandas_udf(St.StringType())
def _nfc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda x: unicodedata.normalize("NFC", x), na_action="ignore")


def nfc(c: Column) -> Column:
    """Unicode normal form C."""
    return F.coalesce(_nfc(F.when(not_ascii(c), c)), c)


def not_ascii(c: Column) -> Column:
    return F.octet_length(c) != F.length(c)


def float_text(c: Column, single: bool = False) -> Column:
    """The shortest text of a floating-point number, without an exponent from 1e-9 up to 1e15.

    `single`: c is a float, whose shortest text differs from that of the double.
    """
    own = c.cast("string")
    size = F.abs(c.cast("double"))
    # 17 digits, after up to 8 zeros in small numbers
    plain = trimmed(F.when(size < 1e7, own.try_cast("decimal(38,30)").cast("string")).otherwise(own.try_cast("decimal(38,20)").cast("string")))
    whole = c.cast("double").try_cast("decimal(20,0)").cast("string")
    scientific = F.regexp_replace(F.lower(own), r"\.0(?=e|$)", "")
    return (
        F.when(F.isnan(c), "nan")
        .when(size == float("inf"), F.when(c > 0, "inf").otherwise("-inf"))
        .when(c == 0, F.when(own.startswith("-"), "-0").otherwise("0"))
        .when((size < 1e15) & (c.cast("double") == F.floor(c.cast("double"))) & F.lit(not single), whole)
        .when((size < 1e15) & (size >= 1e-9), plain)
        .otherwise(scientific)
    )


def trimmed(text: Column) -> Column:
    """A decimal's text without zeros at its end."""
    short = F.when(text.contains("."), F.regexp_replace(text, r"\.?0+$", "")).otherwise(text)
    return F.when(short == "-0", "0").otherwise(short)


def boolean_alias(c: Column) -> Column:
    text = F.lower(F.trim(c))
    return F.when(c.isNull(), F.lit(None).cast("string")).when(text.isin(*TRUE_TEXTS), "true").when(text.isin(*FALSE_TEXTS), "false").otherwise(BAD_BOOLEAN)


def json_text(c: Column, kind: TypeInfo) -> Column:
    """Minified, with sorted keys; text that is no JSON stays as it is."""
    if kind.type == "variant":
        return F.to_json(c)
    return F.coalesce(F.to_json(F.try_parse_json(c)), c)


def truncated(c: Column, digits: int | None) -> Column:
    """A timestamp cut to so many digits after the second (earlier, also before 1970); its zone stays."""
    unit = {0: "SECOND", 3: "MILLISECOND"}.get(6 if digits is None else digits)
    return c if unit is None else F.date_trunc(unit, c)


def instant(c: Column, kind: TypeInfo, options: CompareOptions, digits: int | None) -> Column:
    """A timestamp without zone, in UTC (the session's zone must be UTC)."""
    if kind.family is Family.TIMESTAMP_NAIVE and options.assume_tz:
        c = F.convert_timezone(F.lit(options.assume_tz), F.lit("UTC"), c)
    return truncated(c, digits).cast("timestamp_ntz")


def other_text(c: Column, kind: TypeInfo) -> Column:
    name = kind.type
    if name.startswith("map"):
        return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(c))))
    return F.to_json(c) if name.startswith(("array", "struct")) else c.cast("string")


def text_of(c: Column, kind: TypeInfo, options: CompareOptions, digits: int | None = None, is_json: bool = False, unicode: bool = True) -> Column:
    """Canonical text, or null for null.  `unicode` False: the column is known to be ASCII."""
    match kind.family:
        case _ if is_json or kind.family is Family.JSON:
            return json_text(c, kind)
        case Family.STRING:
            c = F.nullif(c, F.lit("")) if options.treat_empty_as_null else c
            return nfc(c) if unicode else c
        case Family.FLOAT:
            return float_text(c, kind.type in ("float", "real", "float4"))
        case Family.DECIMAL:
            return trimmed(c.cast("string"))
        case Family.BINARY:
            return F.lower(F.hex(c))
        case Family.TIME:
            text = c.cast("string")
            return F.concat(F.substring(text, 1, 8), F.lit("."), F.rpad(F.substring(text, 10, 6), 6, "0"))
        case Family.TIMESTAMP_NAIVE | Family.TIMESTAMP_TZ:
            return F.date_format(instant(c, kind, options, digits), "yyyy-MM-dd HH:mm:ss.SSSSSS")
        case Family.UUID:
            return F.lower(c)
        case Family.OTHER:
            return other_text(c, kind)
        case _:
            return c.cast("string")


def marked(text: Column) -> Column:
    return F.coalesce(text, F.lit(NULL_MARK))


def fields_text(texts: list[Column]) -> Column:
    """One text of several: each field after its length, so no two lists have the same."""
    parts = [F.concat(F.length(marked(t)).cast("string"), F.lit(":"), marked(t)) for t in texts]
    return F.concat(*parts) if parts else F.lit("")
