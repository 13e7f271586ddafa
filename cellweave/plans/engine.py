"""A whole comparison: bind both sides, choose a strategy, compare, report."""

from __future__ import annotations

import time
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.equality import Pair
from ..functions.types import Family, Verdict, parse_type
from ..model import Findings, Schemas
from ..operators.column_stats import profiles
from ..operators.join_diff import JoinDiff, with_ascii_known
from ..operators.keyless_diff import keyless_diff
from ..operators.keys import check_unique, col, guess_key, require_columns
from ..operators.schema_diff import diff_schemas
from ..operators.segment_diff import SegmentDiff
from ..options import FULL_EXAMPLES, CompareOptions, RunOptions
from ..sources.bind import BoundSource, bind_source, scoped_conf

Source = str | DataFrame | BoundSource


def choose_strategy(left: BoundSource, right: BoundSource, options: RunOptions) -> str:
    """Segments where rows would have to leave a database that the other side is not in; a join otherwise."""
    if options.strategy != "auto":
        return options.strategy
    places = [s.postgres.instance if s.postgres else None for s in (left, right)]
    return "join" if places[0] == places[1] else "hash"


def resolve_key(left: BoundSource, right: BoundSource, options: RunOptions) -> list[str]:
    names = [[c.name for c in s.columns] for s in (left, right)]
    key = [k.strip() for k in options.key] or guess_key(*names, left.primary_key, right.primary_key)
    for n, side in zip(names, ("left", "right"), strict=True):
        require_columns(n, key, side)
    return key


def run_diff(left: Source, right: Source, options: RunOptions | None = None, spark: SparkSession | None = None) -> Findings:
    """Compares two sources and reports.  Raises CellweaveError where no comparison is possible."""
    options = options or RunOptions()
    started = time.monotonic()
    spark = spark or next((s.sparkSession for s in (left, right) if isinstance(s, DataFrame)), None) or SparkSession.builder.getOrCreate()
    with scoped_conf(spark):
        a, b = (bind_source(spark, s, options.csv) for s in (left, right))
        strategy = choose_strategy(a, b, options)
        schemas, pairs = diff_schemas(a.columns, b.columns, options.compare)
        found = _keyless(a, b, schemas, pairs) if strategy == "keyless" else _keyed(a, b, schemas, pairs, strategy, options)
        if "stats" in options.sections and strategy != "keyless":
            found.profiles = profiles(a.df, b.df, *({c.name: parse_type(c) for c in s.columns} for s in (a, b)))
    found.notes.assumed.extend(schemas.notes.assumed)
    found.notes.beware.extend(schemas.notes.beware)
    found.schemas = schemas if "schema" in options.sections else None
    found.rows = found.rows if "counts" in options.sections else None
    found.cells = found.cells if "values" in options.sections else None
    found.seconds = time.monotonic() - started
    return found


def _keyless(a: BoundSource, b: BoundSource, schemas: Schemas, pairs: dict[str, Pair]) -> Findings:
    pairs = with_ascii_known(pairs, a.df, b.df)
    found = Findings("keyless", [], rows=keyless_diff(a.df, b.df, pairs))
    found.notes.beware.append("compared without a key: rows are matched as wholes, cells are not told apart")
    left_out = [c.name for c in schemas.columns if c.name not in pairs]
    if left_out:
        found.notes.beware.append(f"columns left out of the rows: {', '.join(left_out)}")
    return found


def _key_pairs(pairs: dict[str, Pair], key: list[str], schemas: Schemas) -> None:
    for k in key:
        if k not in pairs:
            status = next(c for c in schemas.columns if c.name == k)
            raise KeyError(f"key column {k!r} cannot be compared: {status.note}")


def _keyed(a: BoundSource, b: BoundSource, schemas: Schemas, pairs: dict[str, Pair], strategy: str, options: RunOptions) -> Findings:
    key = resolve_key(a, b, options)
    _key_pairs(pairs, key, schemas)
    remote = tuple(s.remote if strategy == "hash" and s.remote and s.remote.takes(pairs) else None for s in (a, b))
    if not any(remote):
        pairs = with_ascii_known(pairs, a.df, b.df)
    # keys are compared as they are, whatever the tolerance for values
    exact = {k: replace(pairs[k], options=replace(options.compare, tolerance_abs=0.0, tolerance_rel=0.0)) for k in key}
    pairs = pairs | exact
    for s, there, side in zip((a, b), remote, ("left", "right"), strict=True):
        check_unique(s.df, [pairs[k] for k in key], side, there.duplicates([pairs[k] for k in key]) if there else None)
    n = FULL_EXAMPLES if options.limits.examples is None else options.limits.examples
    n = n if "values" in options.sections else 0
    found = Findings(strategy, key)
    if strategy == "hash":
        segments = SegmentDiff(a.df, b.df, pairs, key, options.limits.leaf_rows, remote)
        rows, found.cells = segments.join().measure(n)
        found.rows = rows._replace(matched=segments.totals[0] - rows.left)
        found.ran_in = {side: "pushdown" if there else "local-scan" for side, there in zip(("left", "right"), remote, strict=True)}
        segments.close()
    else:
        found.rows, found.cells = JoinDiff(a.df, b.df, pairs, key).measure(n)
    found.notes.beware.extend(_cast_failures(a.df, b.df, pairs))
    return found


def _cast_failures(left: DataFrame, right: DataFrame, pairs: dict[str, Pair]) -> list[str]:
    """Texts that cannot be read as the other side's type; they are compared as nulls."""
    out = []
    for df, side in ((left, "left"), (right, "right")):
        failing: dict[str, Column] = {}
        for n, p in pairs.items():
            own, other = (p.left, p.right) if side == "left" else (p.right, p.left)
            if p.how.verdict is Verdict.STRING_CAST and own.family is Family.STRING and other.family not in (Family.JSON, Family.UUID, Family.TIME):
                failing[n] = F.count_if(col(n).isNotNull() & p.text(col(n), side).isNull())
        if failing:
            row = df.agg(*(c.alias(f"f{i}") for i, c in enumerate(failing.values()))).first()
            out += [f"column '{n}': {c} texts of the {side} side are no {pairs[n].right.type if side == 'left' else pairs[n].left.type}; compared as NULL" for n, c in zip(failing, row, strict=True) if c]
    return out


def matched(left: Source, right: Source, key: list[str], options: CompareOptions | None = None, spark: SparkSession | None = None) -> JoinDiff:
    """The lazy join of two sources, for its DataFrames; keys are not checked."""
    spark = spark or next(s.sparkSession for s in (left, right) if isinstance(s, DataFrame))
    with scoped_conf(spark):
        a, b = (bind_source(spark, s) for s in (left, right))
        _, pairs = diff_schemas(a.columns, b.columns, options)
        return JoinDiff(a.df, b.df, with_ascii_known(pairs, a.df, b.df), key)
