"""Quality rules: text statistics and robust multivariate outliers.

For each language and source the location and scatter of transformed statistics
are estimated by minimum covariance determinant: from coordinate medians and
MADs (the deterministic start) concentration steps keep the three quarters of
the rows with the smallest Mahalanobis distances and take their mean and
covariance, and a last step reweights.  A document far outside is rejected.

This is MCD with one deterministic start and STEPS concentration steps, in place
of the best of many random starts run until nothing changes; tests compare its
verdicts with those of such a plain one.  Floors (below) are added to the
covariance, since most texts have no symbols or repetitions at all.

Every step reads all rows, but only sums per group and per bin of the distance
are shuffled (at most BINS rows per group and task), so a group may hold any
share of the rows.  The cut lies on a bin's edge; distances are binned to a
sixteenth of an octave.

Defined cases: null or wordless text has no words and fails the base rules; null
language and null source are groups of their own; a group of fewer than `least`
rows that pass the base rules is judged with its language, a small language with
all rows; with fewer than `least` rows in all nothing but the base rules rejects;
repeated rows each count; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textops as T
from .support import cut

GROUPS = 100_000  # rows of a table by group that is broadcast, at most; larger ones are joined by a shuffle

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper")
#: Transformed statistics, each with a floor for its standard deviation: a spread
#: under the floor (most texts have no symbols at all) is not worth a rejection.
#: Those of x3 and x4 are the spread of the values that are not 0 (0.118 and 0.104 on sf0.1).
FEATURES = {
    "x0": ("log(n_words + 1.0)", 0.25),
    "x1": ("log(word_chars / n_words)", 0.05),
    "x2": ("sqrt(n_symbols / word_chars)", 0.04),
    "x3": ("sqrt(n_dup_lines / n_lines)", 0.10),
    "x4": ("sqrt(n_repeat_words / n_words)", 0.10),
    "x5": ("sqrt(n_upper / word_chars)", 0.05),
}
BINS, KEEP, STEPS = 512, 0.75, 4
_D = len(FEATURES)
_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[list(b"#*$%&|<>")] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True


def _counts(texts: pa.Array, k: int = 8) -> list[np.ndarray]:
    out: list[list[np.ndarray]] = [[] for _ in COUNTS]
    for _, _, data, offsets in T.slices(texts):
        words = T.split(data, offsets, T.SPACED)
        n_words = np.diff(words.first)
        chars = T.counts_between(((data & 0xC0) != 0x80) & T.SPACED.word[data], offsets)
        # lines: between line feeds and text borders
        lines = T.split(data, offsets, _LINE)
        has_word = np.searchsorted(words.start, lines.end) > np.searchsorted(words.start, lines.start)
        text = np.repeat(np.arange(len(offsets) - 1), np.diff(lines.first))[has_word]
        line = lines.hash[has_word]
        n_lines = np.bincount(text, minlength=len(offsets) - 1)
        distinct = np.unique(np.stack([text.astype(np.uint64), line], 1), axis=0)[:, 0] if len(line) else np.zeros(0, np.uint64)
        n_dup = n_lines - np.bincount(distinct.astype(np.int64), minlength=len(offsets) - 1)
        # windows found again in their text
        h, at, of = T.text_windows(words, k)
        h = T.mix(h + T.mix(of.astype(np.uint64) + np.uint64(1)))
        ordered = np.sort(h)
        again = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
        twice = at[_within(h, again)]
        repeated = T.counts_between(T.spread(twice, k, len(words.start)), words.first)
        for into, x in zip(out, (n_words, chars, T.counts_between(_SYMBOLS[data], offsets), n_dup, repeated, n_lines, T.counts_between(_UPPER[data], offsets)), strict=True):
            into.append(x)
    return [np.concatenate([np.zeros(0, np.int64), *x]).astype(np.int64) for x in out]


def _within(values: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    if not len(ordered):
        return np.zeros(len(values), bool)
    return ordered[np.minimum(np.searchsorted(ordered, values), len(ordered) - 1)] == values


_LINE = T.Splitter(np.arange(256) != 10, lower=False)


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts = _counts(T.column(batch, "text"))
        yield pa.RecordBatch.from_arrays([T.column(batch, "doc_id"), T.column(batch, "lang"), T.column(batch, "source"), *map(pa.array, counts)], ["doc_id", "lang", "source", *COUNTS])


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source, the base counts, n_lines, n_upper and base_failed for each document."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *(F.col(c).cast("string").alias(c) for c in ("lang", "source", "text")))
    measured = docs.mapInArrow(_measure, "doc_id long, lang string, source string, " + ", ".join(f"{c} long" for c in COUNTS))
    return measured.withColumn("base_failed", F.expr("n_words < 20 or 100 * n_repeat_words > 30 * n_words"))


def chi2_cdf(x: float, d: float) -> float:
    """The regularised lower incomplete gamma function, by its series."""
    a, x = d / 2, x / 2
    if x <= 0:
        return 0.0
    term = total = 1 / a
    n = a
    while term > total * 1e-14:
        n += 1
        term *= x / n
        total += term
    return min(1.0, total * math.exp(a * math.log(x) - x - math.lgamma(a)))


def chi2_quantile(p: float, d: int) -> float:
    z = NormalDist().inv_cdf(p)
    low, high = 0.0, 4 * d * (1 + abs(z)) ** 2 + 50
    for _ in range(100):
        middle = (low + high) / 2
        low, high = (middle, high) if chi2_cdf(middle, d) < p else (low, middle)
    return high


def _spread_factor(kept: float) -> float:
    """How much the covariance of the innermost share of a normal sample falls short."""
    return 1.0 if kept >= 1 else kept / chi2_cdf(chi2_quantile(kept, _D), _D + 2)


_PARAMS = "g string, " + ", ".join(f"m{i} double" for i in range(_D)) + ", " + ", ".join(f"p{i}{j} double" for i in range(_D) for j in range(i, _D))


def _row(g: str, mean: np.ndarray, cov: np.ndarray) -> pd.DataFrame:
    floors = np.array([s for _, s in FEATURES.values()])
    inverse = np.linalg.inv(cov + np.diag(floors**2))
    return pd.DataFrame([[g, *mean, *(inverse[i, j] for i in range(_D) for j in range(i, _D))]])


def _start(rows: pd.DataFrame) -> pd.DataFrame:
    return pd.concat([_row(r["g"], np.array([r[f"m{i}"] for i in range(_D)]), np.diag([(1.4826 * r[f"a{i}"]) ** 2 for i in range(_D)])) for _, r in rows.iterrows()])


def _concentrate(limit: float | None):
    """New location and scatter of a group from its sums by bin; limit: reweight up to this squared distance."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("bin")
        n = rows["n"].to_numpy()
        if limit is None:
            inside = np.arange(len(n)) <= np.searchsorted(np.cumsum(n), KEEP * n.sum())
        else:
            inside = rows["bin"].to_numpy() <= _bin_of(limit)
            inside[0] = True
        kept = rows[inside]
        total = kept["n"].sum()
        mean = np.array([kept[f"s{i}"].sum() / total for i in range(_D)])
        cov = np.empty((_D, _D))
        for i in range(_D):
            for j in range(i, _D):
                cov[i, j] = cov[j, i] = kept[f"q{i}{j}"].sum() / total - mean[i] * mean[j]
        return _row(rows["g"].iloc[0], mean, cov * _spread_factor(KEEP if limit is None else 0.975))

    return run


def _bin_of(d2: float) -> int:
    return max(0, min(BINS - 1, math.floor((math.log2(d2) + 10) * 16)))


def _groups(stats: DataFrame, least: int) -> DataFrame:
    """Adds g: the group by which a row is judged; null where there are too few rows in all."""
    sizes = cut(stats.where("not base_failed").groupBy("lang", "source").agg(F.count("*").alias("n")))
    in_all = sizes.agg(F.sum("n")).first()[0] or 0
    by_lang = sizes.groupBy("lang").agg(F.sum("n").alias("of_lang"))
    few = sizes.count() <= GROUPS
    both = sizes.alias("s").join(by_lang.alias("l"), F.col("s.lang").eqNullSafe(F.col("l.lang")))
    named = both.select(
        F.col("s.lang").alias("glang"),
        F.col("source").alias("gsource"),
        F.when(F.col("n") >= least, F.to_json(key_of("s.lang", "source"))).when(F.col("of_lang") >= least, F.to_json(key_of("s.lang"))).when(F.lit(in_all >= least), F.lit("all")).alias("g"),
    )
    named = F.broadcast(named) if few else cut(named)
    return stats.join(named, stats["lang"].eqNullSafe(F.col("glang")) & stats["source"].eqNullSafe(F.col("gsource")), "left").drop("glang", "gsource")


def _ready(by_group: DataFrame) -> DataFrame:
    """A stored table by group, to be joined with all rows: broadcast, or else of plain shuffles, in which a large group is split."""
    return F.broadcast(by_group) if by_group.count() <= GROUPS else by_group


def key_of(*names: str) -> Column:
    return F.array(*(F.coalesce(F.concat(F.lit("="), F.col(n)), F.lit("null")) for n in names))


def quality_rules(docs: DataFrame, tail: float = 1e-3, least: int = 50) -> DataFrame:
    """One row per document: doc_id, the base counts, base_failed, distance (squared), kept.

    `tail`: the share of a normal sample that would be rejected.
    """
    stats = cut(statistics(docs))
    rows = cut(_groups(stats, least).withColumns({x: F.when(~F.col("base_failed"), F.expr(f)) for x, (f, _) in FEATURES.items()}))
    fit = rows.where("not base_failed and g is not null").select("g", *FEATURES)
    center = _ready(cut(fit.groupBy("g").agg(*(F.percentile_approx(f"x{i}", 0.5).alias(f"m{i}") for i in range(_D)))))
    around = fit.join(center, "g").groupBy("g").agg(*(F.first(f"m{i}").alias(f"m{i}") for i in range(_D)), *(F.percentile_approx(F.abs(F.col(f"x{i}") - F.col(f"m{i}")), 0.5).alias(f"a{i}") for i in range(_D)))
    params = _ready(cut(around.mapInPandas(lambda parts: (_start(p) for p in parts if len(p)), _PARAMS)))
    for limit in [None] * STEPS + [chi2_quantile(0.975, _D)]:
        binned = fit.join(params, "g").withColumn("bin", F.expr(f"cast(greatest(0, least({BINS - 1}, floor((log2(greatest({_distance_sql()}, 1e-9)) + 10) * 16))) as int)"))
        sums = binned.groupBy("g", "bin").agg(F.count("*").alias("n"), *(F.sum(f"x{i}").alias(f"s{i}") for i in range(_D)), *(F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"q{i}{j}") for i in range(_D) for j in range(i, _D)))
        params = _ready(cut(sums.groupBy("g").applyInPandas(_concentrate(limit), _PARAMS)))
    judged = rows.join(params, "g", "left").withColumn("distance", F.expr(_distance_sql()))
    kept = ~F.col("base_failed") & F.coalesce(F.col("distance") <= chi2_quantile(1 - tail, _D), F.lit(True))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "distance", kept.alias("kept"))


def _distance_sql() -> str:
    return "(" + " + ".join(f"{1 if i == j else 2} * p{i}{j} * (x{i} - m{i}) * (x{j} - m{j})" for i in range(_D) for j in range(i, _D)) + ")"
