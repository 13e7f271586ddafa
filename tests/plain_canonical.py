"""Canonical texts by their rules, in plain Python: what the Spark expressions are held against."""

import json
import math
import unicodedata
from datetime import date, datetime, time
from decimal import Decimal


def number(x: float) -> str:
    if math.isnan(x):
        return "nan"
    if math.isinf(x):
        return "inf" if x > 0 else "-inf"
    if x == 0:
        return "-0" if math.copysign(1, x) < 0 else "0"
    if 1e-9 <= abs(x) < 1e15:
        return exact(Decimal(repr(x)))
    digits, _, power = repr(x).partition("e")
    if not power:
        sign, figures, exponent = Decimal(repr(x)).normalize().as_tuple()
        figures = "".join(map(str, figures))
        digits, power = ("-" if sign else "") + figures[0] + ("." + figures[1:] if figures[1:] else ""), str(exponent + len(figures) - 1)
    return f"{digits.removesuffix('.0')}e{int(power)}"


def exact(x: Decimal) -> str:
    text = format(x, "f")
    text = text.rstrip("0").rstrip(".") if "." in text else text
    return "0" if text in ("-0", "") else text


def text(value, kind: str = "") -> str | None:
    if value is None:
        return None
    if kind == "json":
        try:
            return json.dumps(json.loads(value), sort_keys=True, separators=(",", ":"), ensure_ascii=False)
        except ValueError:
            return value
    if kind == "uuid":
        return value.lower()
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, float):
        return number(value)
    if isinstance(value, Decimal):
        return exact(value)
    if isinstance(value, (bytes, bytearray)):
        return value.hex()
    if isinstance(value, datetime):
        return value.strftime("%Y-%m-%d %H:%M:%S.%f")
    if isinstance(value, (date, time)):
        return value.strftime("%Y-%m-%d" if isinstance(value, date) else "%H:%M:%S.%f")
    return unicodedata.normalize("NFC", value) if isinstance(value, str) else str(value)


def row(values: list) -> str:
    """One text of several canonical texts: each after its length."""
    marked = ["\x01null\x01" if v is None else v for v in values]
    return "".join(f"{len(v)}:{v}" for v in marked)
