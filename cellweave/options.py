"""What a comparison may be told."""

from __future__ import annotations

from dataclasses import dataclass, field
from zoneinfo import ZoneInfo, ZoneInfoNotFoundError

from .errors import CellweaveError

STRATEGIES = ("auto", "join", "hash", "keyless")
PRECISIONS = {"s": 0, "ms": 3, "us": 6, "ns": 9}


@dataclass(frozen=True)
class CompareOptions:
    """How values are compared.

    Tolerances apply to pairs of numbers.  `ts_precision` is "coarse" (the coarser
    of both sides) or one of PRECISIONS.  `json_columns` are text columns that hold
    JSON.
    """

    tolerance_abs: float = 0.0
    tolerance_rel: float = 0.0
    treat_empty_as_null: bool = False
    assume_tz: str | None = None
    ts_precision: str = "coarse"
    json_columns: frozenset[str] = frozenset()

    def __post_init__(self) -> None:
        if self.ts_precision != "coarse" and self.ts_precision not in PRECISIONS:
            raise CellweaveError(f"unknown timestamp precision {self.ts_precision!r}")
        if min(self.tolerance_abs, self.tolerance_rel) < 0:
            raise CellweaveError("tolerances must not be negative")
        if self.assume_tz is not None:
            try:
                ZoneInfo(self.assume_tz)
            except (ZoneInfoNotFoundError, ValueError) as e:
                raise CellweaveError(f"unknown time zone {self.assume_tz!r}") from e

    @property
    def tolerant(self) -> bool:
        return self.tolerance_abs > 0 or self.tolerance_rel > 0


SECTIONS = frozenset({"schema", "counts", "values", "stats"})
FULL_EXAMPLES = 200_000


@dataclass(frozen=True)
class Limits:
    """Examples per column (None: FULL_EXAMPLES), and rows of a segment that is no longer cut."""

    examples: int | None = 20
    leaf_rows: int = 8192

    def __post_init__(self) -> None:
        if self.leaf_rows < 1:
            raise CellweaveError("leaf_rows must be positive")


@dataclass(frozen=True)
class CsvOptions:
    """`as_text`: no types.  `line_breaks`: cells may hold some, so a file is one task; else files are split."""

    as_text: bool = False
    line_breaks: bool = True


@dataclass(frozen=True)
class RunOptions:
    """How a comparison runs: by which key and strategy, and which sections it has."""

    compare: CompareOptions = field(default_factory=CompareOptions)
    key: tuple[str, ...] = ()
    strategy: str = "auto"
    sections: frozenset[str] = SECTIONS
    limits: Limits = field(default_factory=Limits)
    csv: CsvOptions = field(default_factory=CsvOptions)

    def __post_init__(self) -> None:
        if self.strategy not in STRATEGIES:
            raise CellweaveError(f"unknown strategy {self.strategy!r}; one of {', '.join(STRATEGIES)}")
        if unknown := self.sections - SECTIONS:
            raise CellweaveError(f"unknown sections: {', '.join(sorted(unknown))}")
