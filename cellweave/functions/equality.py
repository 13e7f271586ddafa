"""Equality of two values as one Boolean column, never null.

Typed comparison where it agrees with the comparison of canonical texts, texts
otherwise.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..options import CompareOptions
from .canonical import boolean_alias, instant, marked, text_of
from .types import Family, PairClass, TypeInfo, Verdict, effective_precision

#: Families whose values are equal exactly if their canonical texts are.
_TYPED = frozenset({Family.BOOLEAN, Family.INTEGER, Family.DECIMAL, Family.DATE, Family.BINARY})
#: What text is cast to before it is compared with a value of the family.
_CAST = {Family.INTEGER: "bigint", Family.FLOAT: "double", Family.DATE: "date", Family.TIMESTAMP_NAIVE: "timestamp_ntz", Family.TIMESTAMP_TZ: "timestamp"}


@dataclass(frozen=True)
class Pair:
    """Two columns of one name and how they are compared."""

    name: str
    left: TypeInfo
    right: TypeInfo
    how: PairClass
    options: CompareOptions
    unicode: bool = True  # some value is not ASCII

    @property
    def digits(self) -> int | None:
        return effective_precision(self.left, self.right, self.options)

    @property
    def is_json(self) -> bool:
        return Family.JSON in (self.left.family, self.right.family) or self.name in self.options.json_columns and self.left.family is self.right.family is Family.STRING

    @property
    def compares_text(self) -> bool:
        """Whether texts are compared that Unicode normalisation may change."""
        return Family.STRING in (self.left.family, self.right.family) and self.how.verdict in (Verdict.SAME, Verdict.BENIGN) and not self.is_json

    def text(self, c: Column, side: str) -> Column:
        """Canonical text of a side's value; text on one side only is read as the other side's type."""
        own, other = (self.left, self.right) if side == "left" else (self.right, self.left)
        if own.family is Family.STRING and other.family is not Family.STRING:
            if other.family is Family.BOOLEAN:
                return boolean_alias(c)
            if other.family is Family.DECIMAL:
                return text_of(c.try_cast(other.type), other, self.options)
            if other.family in _CAST:
                kind = TypeInfo(other.family, _CAST[other.family], other.precision)
                return text_of(c.try_cast(_CAST[other.family]), kind, self.options, self.digits)
            return text_of(c, other if other.family in (Family.UUID, Family.JSON) else own, self.options, is_json=self.is_json, unicode=False)
        return text_of(c, own, self.options, self.digits, self.is_json, self.unicode)

    def identity(self, c: Column, side: str) -> Column:
        """A text that is equal exactly where canonical texts are, cheaper where both sides are of one type."""
        if self.left.type == self.right.type and self.left.family in (Family.FLOAT, Family.DECIMAL):
            return c.cast("string")
        return self.text(c, side)

    def equal(self, a: Column, b: Column) -> Column:
        left, right = self.left, self.right
        if self.options.tolerant and left.is_numeric and right.is_numeric:
            return within(a.cast("double"), b.cast("double"), self.options)
        if {left.family, right.family} <= {Family.INTEGER, Family.DECIMAL} or left.family is right.family and left.family in _TYPED:
            return a.eqNullSafe(b)
        if left.family is right.family is Family.FLOAT and left.type == right.type:
            return a.eqNullSafe(b) & ((a != 0) | a.cast("string").eqNullSafe(b.cast("string")) | a.isNull())
        if left.is_temporal and right.is_temporal:
            return instant(a, left, self.options, self.digits).eqNullSafe(instant(b, right, self.options, self.digits))
        return marked(self.text(a, "left")) == marked(self.text(b, "right"))


def within(a: Column, b: Column, options: CompareOptions) -> Column:
    """Both null, or both numbers near each other; NaN and equal infinities are near nothing."""
    gap = F.abs(a - b)
    near = gap <= options.tolerance_abs if options.tolerance_abs > 0 else gap == 0
    if options.tolerance_rel > 0:
        near = near | ((gap <= F.abs(a) * options.tolerance_rel) | (gap <= F.abs(b) * options.tolerance_rel)) & ~F.isnan(gap) & (gap != float("inf"))
    return F.coalesce(near & ~F.isnan(gap), a.isNull() & b.isNull())
