"""The command line: cellweave diff LEFT RIGHT [options].

Exit code 0: identical, 1: different, 2: error.
"""

from __future__ import annotations

import argparse
import sys
import traceback
from pathlib import Path

from pyspark.sql import SparkSession

from . import __version__
from .errors import CellweaveError
from .options import SECTIONS, CompareOptions, CsvOptions, Limits, RunOptions
from .plans.engine import run_diff
from .plans.report import to_json, to_markdown, to_text

IDENTICAL, DIFFERENT, ERROR = 0, 1, 2
FORMATS = {"rich": to_text, "text": to_text, "json": to_json, "markdown": to_markdown}


def _names(text: str | None) -> tuple[str, ...]:
    return tuple(x.strip() for x in text.split(",")) if text else ()


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="cellweave", description="Compares two tables cell by cell.")
    top.add_argument("--version", action="version", version=f"cellweave {__version__}")
    p = top.add_subparsers(dest="command", required=True).add_parser("diff", help="compare two sources")
    for side in ("left", "right"):
        p.add_argument(side, help="file.parquet, file.csv, duckdb://path/table, postgres://host/db[/schema]/table or table:name")
    p.add_argument("--key", help="key columns, separated by commas")
    p.add_argument("--key-less", action="store_true", help="compare rows as multisets")
    p.add_argument("--strategy", default="auto", help="join, hash or auto")
    p.add_argument("--format", "-f", default="rich", help="rich (text), json or markdown")
    p.add_argument("--output", "-o", type=Path, help="write json or markdown to this file")
    p.add_argument("--tolerance-abs", type=float, default=0.0)
    p.add_argument("--tolerance-rel", type=float, default=0.0)
    p.add_argument("--treat-empty-as-null", action="store_true")
    p.add_argument("--assume-tz", help="time zone of timestamps without one")
    p.add_argument("--ts-precision", default="coarse", help="coarse, s, ms, us or ns")
    p.add_argument("--json-columns", help="text columns that hold JSON, separated by commas")
    p.add_argument("--examples", type=int, default=20, help="examples per column")
    p.add_argument("--full", action="store_true", help="all examples")
    p.add_argument("--all-varchar", action="store_true", help="read CSV files without types")
    p.add_argument("--csv-lines", action="store_true", help="no cell of a CSV file holds a line break, so large files are read in parts")
    p.add_argument("--leaf-rows", type=int, default=8192, help="rows of a segment that is no longer cut")
    for section in ("schema", "counts", "values", "stats"):
        p.add_argument(f"--no-{section}", action="store_true")
    return top


def run_options(a: argparse.Namespace) -> RunOptions:
    compare = CompareOptions(a.tolerance_abs, a.tolerance_rel, a.treat_empty_as_null, a.assume_tz, a.ts_precision, frozenset(_names(a.json_columns)))
    if a.key_less and a.strategy not in ("auto", "keyless"):
        raise CellweaveError(f"strategy {a.strategy!r} needs a key; --key-less was given")
    sections = frozenset(s for s in SECTIONS if not getattr(a, f"no_{s}"))
    return RunOptions(compare, _names(a.key), "keyless" if a.key_less else a.strategy, sections, Limits(None if a.full else a.examples, a.leaf_rows), CsvOptions(a.all_varchar, not a.csv_lines))


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    try:
        if args.format not in FORMATS:
            raise CellweaveError(f"unknown format {args.format!r}")
        if args.output and args.format in ("rich", "text"):
            raise CellweaveError("only json and markdown are written to a file")
        found = run_diff(args.left, args.right, run_options(args), spark)
        text = FORMATS[args.format](found)
        if args.output:
            args.output.write_text(text if text.endswith("\n") else text + "\n", encoding="utf-8")
            print(f"report written to {args.output}")
        else:
            print(text)
    except CellweaveError as e:
        print(f"error: {e}", file=sys.stderr)
        return e.exit_code
    except Exception as e:
        print(f"unexpected error: {e!r}", file=sys.stderr)
        traceback.print_exc()
        return ERROR
    return IDENTICAL if found.agree else DIFFERENT


if __name__ == "__main__":
    sys.exit(main())
