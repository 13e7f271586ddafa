"""Comparison of two schemas."""

from __future__ import annotations

from ..functions.equality import Pair
from ..functions.types import Verdict, classify, parse_type
from ..model import ColumnInfo, Declared, Schemas
from ..options import CompareOptions

_UNITS = {0: "seconds", 3: "milliseconds", 6: "microseconds", 9: "nanoseconds"}


def _nullability(left: ColumnInfo, right: ColumnInfo) -> str:
    if left.nullable == right.nullable:
        return ""
    words = ["nullable" if c.nullable else "NOT NULL" for c in (left, right)]
    return "nullability differs ({} vs {})".format(*words)


def diff_schemas(left: list[ColumnInfo], right: list[ColumnInfo], options: CompareOptions | None = None) -> tuple[Schemas, dict[str, Pair]]:
    """The difference to report, and the pairs of columns whose values can be compared.

    Names match exactly, with their case.
    """
    options = options or CompareOptions()
    found, pairs = Schemas(), {}
    rights = {c.name: c for c in right}
    lefts = {c.name for c in left}
    found.reordered = [c.name for c in left if c.name in rights] != [c.name for c in right if c.name in lefts]
    for a in left:
        b = rights.get(a.name)
        if b is None:
            found.columns.append(Declared(a.name, "only_left", (a.type, None)))
            continue
        pair = Pair(a.name, parse_type(a), parse_type(b), classify(parse_type(a), parse_type(b)), options)
        verdict = pair.how.verdict
        note = "; ".join(x for x in (pair.how.note, _nullability(a, b)) if x)
        found.columns.append(Declared(a.name, verdict.value, (a.type, b.type), note))
        if verdict.comparable or (verdict is Verdict.NEEDS_TZ and options.assume_tz):
            pairs[a.name] = pair
        _explain(found, pair, note)
    found.columns += [Declared(b.name, "only_right", (None, b.type)) for b in right if b.name not in lefts]
    return found, pairs


def _explain(found: Schemas, pair: Pair, note: str) -> None:
    verdict, options = pair.how.verdict, pair.options
    if verdict is Verdict.NEEDS_TZ and options.assume_tz:
        found.notes.assumed.append(f"column '{pair.name}': timestamps without zone are read as {options.assume_tz} and compared in UTC")
    elif not verdict.comparable:
        found.notes.beware.append(f"column '{pair.name}': {note}; values NOT compared")
        return
    elif verdict is Verdict.LOSSY:
        found.notes.beware.append(f"column '{pair.name}': {note}")
    cut = pair.digits
    if options.ts_precision == "coarse" and cut is not None and any(t.is_temporal and t.precision != cut for t in (pair.left, pair.right)):
        found.notes.assumed.append(f"column '{pair.name}': both sides are cut to {_UNITS[cut]} precision")
