"""Toxicity by a factorization machine over hashed terms.

Terms are words and their first four to six bytes, lowered and hashed to 2**BITS
bins.  A model is trained on a bounded, balanced sample of labelled texts: bins
that tell the classes apart, alone or in a pair with another bin, are chosen by
chi-square tests, and the machine
learns a weight per bin and, by factor vectors, a weight per pair of bins, so
that two terms may mean more (or less) together than each alone.  The model has
at most `terms` bins (and PAIRED more) and is broadcast; every text is scored whole.

Defined cases: a text without a chosen term (null and empty ones too) gets the
score of no evidence, and with no labelled rows every score is 0; repeated rows
score alike; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textops as T

BITS = 22
#: What a bin needs to be chosen: chi square alone, or of a pair with another bin
#: (four times that of either alone) among the most frequent, and texts that hold it.
ALONE, TOGETHER, PAIRED, LEAST = 15, 30, 1024, 4
PREFIXES = (4, 5, 6)  # bytes


class Machine(NamedTuple):
    bins: np.ndarray  # sorted
    bias: float
    weight: np.ndarray
    factor: np.ndarray  # one row per bin


def text_terms(texts: pa.Array, bins: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each slice of texts: its first row, and the distinct (row, bin) pairs, by row; `bins` limits them."""
    shift = np.uint64(64 - BITS)
    for begin, _, data, offsets in T.slices(texts):
        words = T.split(data, offsets, T.ALNUM_LOWER)
        row = np.repeat(np.arange(len(offsets) - 1), np.diff(words.first))
        codes = T.prefix_codes(data, T.ALNUM_LOWER.codes)
        length = words.end - words.start
        found = [(row, words.hash >> shift)]
        for n in PREFIXES:
            long = np.flatnonzero(length > n)
            found.append((row[long], T.mix(T.span_hash(codes, words.start[long], words.start[long] + n) + np.uint64(n)) >> shift))
        rows = np.concatenate([r for r, _ in found])
        terms = np.concatenate([t for _, t in found]).astype(np.int64)
        if bins is not None:
            if not len(bins):
                rows, terms = rows[:0], terms[:0]
            else:
                at = np.minimum(np.searchsorted(bins, terms), len(bins) - 1)
                known = bins[at] == terms
                rows, terms = rows[known], at[known]
        pairs = np.unique(rows << BITS | terms)
        yield begin, pairs >> BITS, pairs & ((1 << BITS) - 1)


def _sample_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        y = T.column(batch, "y").to_numpy(zero_copy_only=False)
        texts = T.column(batch, "text")
        rows, terms = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for begin, r, t in text_terms(texts):
            rows.append(r + begin)
            terms.append(t)
        bounds = np.searchsorted(np.concatenate(rows), np.arange(len(y) + 1)).astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(y.astype(np.int32)), pa.ListArray.from_arrays(pa.array(bounds), pa.array(np.concatenate(terms).astype(np.int32)))], ["y", "terms"])


def train(sample: DataFrame, terms: int = 4096, factors: int = 8, epochs: int = 12, seed: int = 5) -> Machine:
    """A machine for the rows (text, y) given; their number must be bounded."""
    rows = sample.mapInArrow(_sample_terms, "y int, terms array<int>").toPandas()
    lists = [np.asarray(x) for x in rows["terms"]]
    y = rows["y"].to_numpy(np.int64)
    by = sorted(range(len(y)), key=lambda i: (y[i], len(lists[i]), lists[i].tobytes()))  # whatever the order of tasks
    return fit([lists[i] for i in by], y[by], terms, factors, epochs, seed)


def fit(lists: list[np.ndarray], y: np.ndarray, terms: int, factors: int, epochs: int, seed: int) -> Machine:
    if not len(y) or not (0 < y.sum() < len(y)):
        return Machine(np.zeros(0, np.int64), -50.0 if not len(y) or not y.any() else 50.0, np.zeros(0), np.zeros((0, factors)))
    flat = np.concatenate(lists)
    row = np.repeat(np.arange(len(y)), [len(x) for x in lists])
    bins, column = np.unique(flat, return_inverse=True)
    n1, n0 = y.sum(), len(y) - y.sum()
    c1 = np.bincount(column, weights=y[row], minlength=len(bins))
    c0 = np.bincount(column, minlength=len(bins)) - c1
    p = (c1 + c0) / len(y)
    chi = (c1 / n1 - c0 / n0) ** 2 / (p * (1 - p) * (1 / n1 + 1 / n0) + 1e-12)
    chosen = np.argsort(-chi, kind="stable")[:terms]
    chosen = chosen[(chi[chosen] > ALONE) & (c1 + c0 >= LEAST)[chosen]]
    chosen = np.union1d(chosen, _telling_pairs(row, column, y, chi, p))
    place = np.full(len(bins), -1)
    place[chosen] = np.arange(len(chosen))
    keep = place[column] >= 0
    row, column = row[keep], place[column][keep]
    rng = np.random.default_rng(seed)
    weight, factor, bias = np.zeros(len(chosen)), rng.normal(0, 0.05, (len(chosen), factors)), 0.0
    g_weight, g_factor, g_bias = np.full(len(chosen), 1e-6), np.full((len(chosen), factors), 1e-6), 1e-6
    starts = np.searchsorted(row, np.arange(len(y) + 1))
    rate, shrink, batch = 0.1, 1e-4, 256
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for i in range(0, len(y), batch):
            docs = order[i : i + batch]
            where = np.concatenate([np.arange(starts[d], starts[d + 1]) for d in docs])
            local = np.repeat(np.arange(len(docs)), starts[docs + 1] - starts[docs])
            cols = column[where]
            score, sums = _scores(bias, weight, factor, local, cols, len(docs))
            error = (1 / (1 + np.exp(-np.clip(score, -30, 30))) - y[docs]) / len(docs)
            used, at = np.unique(cols, return_inverse=True)
            g = np.bincount(at, weights=error[local], minlength=len(used)) + shrink * weight[used]
            g_weight[used] += g**2
            weight[used] -= rate * g / np.sqrt(g_weight[used])
            gv = np.zeros((len(used), factors))
            np.add.at(gv, at, error[local, None] * (sums[local] - factor[cols]))
            gv += shrink * factor[used]
            g_factor[used] += gv**2
            factor[used] -= rate / 4 * gv / np.sqrt(g_factor[used])
            g_bias += error.sum() ** 2
            bias -= rate * error.sum() / np.sqrt(g_bias)
    return Machine(bins[chosen].astype(np.int64), float(bias), weight, factor)


def _telling_pairs(row: np.ndarray, column: np.ndarray, y: np.ndarray, chi: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Terms that tell the classes apart with another term, and not alone, among the PAIRED most frequent ones."""
    often = np.flatnonzero(p < 0.95)
    often = np.sort(often[np.argsort(-p[often], kind="stable")[:PAIRED]])
    place = np.full(len(chi), -1)
    place[often] = np.arange(len(often))
    x = np.zeros((len(y), len(often)), np.float32)
    held = place[column] >= 0
    x[row[held], place[column][held]] = 1
    both1, both = x[y == 1].T @ x[y == 1], x.T @ x
    n1, n = float(y.sum()), float(len(y))
    rate = both / n
    joint = (both1 / n1 - (both - both1) / (n - n1)) ** 2 / (rate * (1 - rate) * (1 / n1 + 1 / (n - n1)) + 1e-12)
    alone = np.maximum(chi[often][:, None], chi[often][None, :])
    np.fill_diagonal(joint, 0)
    return often[((joint > TOGETHER) & (joint > 4 * alone) & (both >= LEAST)).any(axis=1)]


def _scores(bias: float, weight: np.ndarray, factor: np.ndarray, row: np.ndarray, column: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Scores of n rows and their sums of factor vectors."""
    sums = np.stack([np.zeros(n), *(np.bincount(row, weights=factor[column, f], minlength=n) for f in range(factor.shape[1]))], 1)[:, 1:]
    squares = np.bincount(row, weights=(factor[column] ** 2).sum(1), minlength=n)
    return bias + np.bincount(row, weights=weight[column], minlength=n) + ((sums**2).sum(1) - squares) / 2, sums


def score_texts(machine: Machine, texts: pa.Array) -> np.ndarray:
    out = np.full(len(texts), machine.bias)
    for begin, rows, terms in text_terms(texts, machine.bins):
        if len(rows):
            n = int(rows[-1]) + 1
            out[begin : begin + n] = _scores(machine.bias, machine.weight, machine.factor, rows, terms, n)[0]
    return 1 / (1 + np.exp(-np.clip(out, -500, 500)))


def toxicity(docs: DataFrame, machine: Machine) -> DataFrame:
    """doc_id, score (0 to 1) and predicted (score >= 0.5) for each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = score_texts(machine, T.column(batch, "text"))
            yield pa.RecordBatch.from_arrays([T.column(batch, "doc_id"), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], ["doc_id", "score", "predicted"])

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(run, "doc_id long, score double, predicted int")
