"""The report as JSON, Markdown and plain text."""

from __future__ import annotations

import json

from ..model import Findings

MARKDOWN_EXAMPLES, TEXT_EXAMPLES = 10, 20  # per column; in all
#: The version of the published JSON and its names, in the order of the findings they show (fixed values).
SCHEMA_VERSION = 1
META = ("strategy", "key", "assumptions", "warnings", "duration_s", "execution_path")
COLUMN = ("name", "status", "left_type", "right_type", "note")
COUNTS = ("left_total", "right_total", "left_only", "right_only", "both")
VALUE_COLUMN = ("column", "mismatched_rows", "examples", "approximated")
EXAMPLE = ("key", "left", "right")
STATISTICS = ("min_", "max_", "avg", "null_count", "distinct_count")


def _named(names: tuple[str, ...], *values: object) -> dict:
    return dict(zip(names, values, strict=True))


def _statistics(row: dict) -> dict:
    return _named(STATISTICS, row["min"], row["max"], None if row["avg"] is None else repr(row["avg"]), row["null_count"], row["distinct_count"])


def as_dict(found: Findings) -> dict:
    """Fields are only ever added; sections that were switched off are missing.  All differing cells are counted, so none is approximated."""
    out = {"schema_version": SCHEMA_VERSION, "identical": found.agree, "meta": _named(META, found.strategy, found.key, *found.notes, found.seconds, found.ran_in)}
    if (s := found.schemas) is not None:
        out["schema"] = {"columns": [_named(COLUMN, c.name, c.status, *c.types, c.note) for c in s.columns], "order_changed": s.reordered, "assumptions": s.notes.assumed, "warnings": s.notes.beware}
    if (r := found.rows) is not None:
        out["counts"] = _named(COUNTS, *r.totals, *r)
    if (v := found.cells) is not None:
        out["values"] = {"changed_rows": v.rows, "columns": [_named(VALUE_COLUMN, n, c, [_named(EXAMPLE, *e) for e in v.samples.get(n, ())], False) for n, c in v.differing.items()]}
    if (p := found.profiles) is not None:
        out["stats"] = {"columns": {n: [_statistics(x) for x in sides] for n, sides in p.items()}}
    return out


def to_json(found: Findings, indent: int | None = 2) -> str:
    return json.dumps(as_dict(found), indent=indent, ensure_ascii=False)


def _shown(value: object) -> str:
    return "-" if value is None else str(value)


class _Section:
    """A titled table, with lines before it."""

    def __init__(self, title: str, header: tuple[str, ...], rows: list[tuple], before: list[str] | None = None) -> None:
        self.title, self.header, self.before = title, header, before or []
        self.rows = [tuple(_shown(x) for x in r) for r in rows]

    def markdown(self, level: int = 2) -> list[str]:
        def line(cells: tuple[str, ...]) -> str:
            return "| " + " | ".join(c.replace("|", "\\|").replace("\n", " ") or " " for c in cells) + " |"

        table = [line(self.header), "|" + "---|" * len(self.header), *map(line, self.rows)] if self.rows else []
        return ["", "#" * level + " " + self.title, "", *self.before, *([""] if self.before and table else []), *table]

    def text(self) -> list[str]:
        cells = [self.header, *(tuple(c.replace("\n", " ") for c in r) for r in self.rows)]
        widths = [max(len(r[i]) for r in cells) for i in range(len(self.header))]
        lines = ["  ".join(c.ljust(w) for c, w in zip(r, widths, strict=True)).rstrip() for r in cells]
        table = [lines[0], "  ".join("-" * w for w in widths), *lines[1:]] if self.rows else []
        return ["", self.title, *self.before, *table]


def _sections(found: Findings) -> list[_Section]:
    out = []
    if (s := found.schemas) is not None:
        rows = [(c.name, c.status, *c.types, c.note) for c in s.columns]
        out.append(_Section("Schema", ("Column", "Status", "Left", "Right", "Note"), rows, ["Column order differs."] if s.reordered else []))
    if (r := found.rows) is not None:
        out.append(_Section("Row counts", ("Metric", "Rows"), list(zip(("left total", "right total", "only left", "only right", "in both"), (*r.totals, *r), strict=True))))
    if (v := found.cells) is not None:
        rows = [(n, c, len(v.samples.get(n, ()))) for n, c in v.differing.items()]
        out.append(_Section("Value differences", ("Column", "Mismatching rows", "Examples"), rows, [f"Changed rows: {v.rows}"]))
    return out


def _stats(found: Findings) -> list[_Section]:
    if not found.profiles:
        return []
    rows = []
    for name, sides in sorted(found.profiles.items()):
        a, b = map(_statistics, sides)
        rows.append((name, *(f"{_shown(a[f])} / {_shown(b[f])}" for f in STATISTICS)))
    return [_Section("Column statistics (left / right)", ("Column", "Min", "Max", "Avg", "Nulls", "Distinct"), rows)]


def _null(text: str | None) -> str:
    return "NULL" if text is None else text


def _head(found: Findings) -> list[str]:
    lines = [f"Strategy: {found.strategy}", f"Key: {', '.join(found.key) or '(none)'}", f"Duration: {found.seconds:.2f} s"]
    if found.ran_in:
        lines.append("Execution: " + ", ".join(f"{k}={v}" for k, v in sorted(found.ran_in.items())))
    return lines + [f"Assumption: {a}" for a in found.notes.assumed] + [f"Warning: {w}" for w in found.notes.beware]


def _verdict(found: Findings) -> str:
    return "IDENTICAL" if found.agree else "DIFFERENCES FOUND"


def to_markdown(found: Findings) -> str:
    lines = [f"# Comparison: **{_verdict(found)}**", "", *(f"- {x}" for x in _head(found))]
    for s in _sections(found):
        lines += s.markdown()
    for name, cells in (found.cells.samples if found.cells else {}).items():
        rows = [(e.key, _null(e.left), _null(e.right)) for e in cells[:MARKDOWN_EXAMPLES]]
        lines += _Section(f"Examples: {name}", ("Key", "Left", "Right"), rows).markdown(3)
    for s in _stats(found):
        lines += s.markdown()
    return "\n".join(lines) + "\n"


def to_text(found: Findings) -> str:
    lines = [_verdict(found), *_head(found)]
    for s in _sections(found):
        lines += s.text()
    rows = [(name, e.key, _null(e.left), _null(e.right)) for name, cells in (found.cells.samples if found.cells else {}).items() for e in cells]
    if rows:
        lines += _Section("Examples", ("Column", "Key", "Left", "Right"), rows[:TEXT_EXAMPLES]).text()
    for s in _stats(found):
        lines += s.text()
    return "\n".join(lines) + "\n"
