"""Quality by votes of the nearest labelled documents in a latent-semantic space.

Terms are words and shapes: trigrams of character classes, with runs of letters
drawn together, words that follow themselves at a distance of one to three, and
lines met before.  All are hashed to DIM bins.  A bounded, balanced sample of
labelled texts gives weights (inverse document frequency) and, by a randomised
singular value decomposition, a projection to `rank` dimensions.  The projection
and the labelled vectors are broadcast; for every document exact cosines with all
of them are computed in blocks, and the `k` largest vote by similarity.

Defined cases: a text without terms (null, empty) scores 0; with no labelled rows
every score is 0; equal similarities are taken in the order of the sample, which
does not depend on tasks; repeated rows score alike; extra columns are ignored;
an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textops as T

DIM = 4096
_WORDS = 2048  # bins for words; the others are for shapes
BLOCK = 512  # documents multiplied together

# classes of bytes: lower, upper, digit, space, line feed, beyond ASCII, or the byte itself
_CLASS = np.arange(256)
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58], _CLASS[[9, 11, 12, 13]], _CLASS[128:] = 97, 65, 48, 32, 97


class Space(NamedTuple):
    idf: np.ndarray
    project: np.ndarray  # DIM x rank
    vectors: np.ndarray  # unit rows, one per labelled text
    y: np.ndarray


def term_counts(texts: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """For blocks of texts: the first row, and a matrix of term frequencies (words, and shapes, each of norm 1)."""
    for begin, _, data, offsets in T.slices(texts):
        n = len(offsets) - 1
        words = T.split(data, offsets, T.SPACED_LOWER)
        row = np.repeat(np.arange(n), np.diff(words.first))
        kind = _CLASS[data]
        text = np.repeat(np.arange(n), np.diff(offsets))
        fresh = np.ones(len(kind), bool)
        fresh[1:] = (kind[1:] != kind[:-1]) | (text[1:] != text[:-1]) | ((kind[1:] != 97) & (kind[1:] != 65) & (kind[1:] != 48))
        kind, text = kind[fresh], text[fresh]
        shapes = kind[:-2] * 65536 + kind[1:-1] * 256 + kind[2:] if len(kind) > 2 else kind[:0]
        of = text[2:] if len(kind) > 2 else text[:0]
        inside = text[: len(of)] == of
        found = [(of[inside], _shape_bin(shapes[inside].astype(np.uint64)), 1.0)]
        for d in (1, 2, 3):
            again = np.flatnonzero((words.hash[d:] == words.hash[:-d]) & (row[d:] == row[:-d])) if len(row) > d else row[:0]
            found.append((row[again], np.full(len(again), _WORDS + d), 4.0))
        lines = T.split(data, offsets, _LINE)
        line_row = np.repeat(np.arange(n), np.diff(lines.first))
        by = np.lexsort((lines.hash, line_row))
        same = by[1:][(lines.hash[by[1:]] == lines.hash[by[:-1]]) & (line_row[by[1:]] == line_row[by[:-1]])] if len(by) > 1 else by[:0]
        found.append((line_row[same], np.full(len(same), _WORDS + 4), 16.0))
        word_bin = (words.hash % np.uint64(_WORDS)).astype(np.int64)
        for a in range(0, n, BLOCK):
            b = min(n, a + BLOCK)
            out = np.zeros((b - a, DIM), np.float32)
            i, j = np.searchsorted(row, [a, b])
            out[:, :_WORDS] = np.bincount((row[i:j] - a) * _WORDS + word_bin[i:j], minlength=(b - a) * _WORDS).reshape(b - a, _WORDS)
            for r, t, w in found:
                if w == 1.0:
                    i, j = np.searchsorted(r, [a, b])
                    pick = slice(i, j)
                else:
                    pick = (r >= a) & (r < b)
                out += w * np.bincount((r[pick] - a) * DIM + t[pick], minlength=(b - a) * DIM).reshape(b - a, DIM).astype(np.float32)
            yield begin + a, np.log1p(out)


_LINE = T.Splitter(np.arange(256) != 10, lower=False)


def _shape_bin(codes: np.ndarray) -> np.ndarray:
    return (_WORDS + 8 + T.mix(codes) % np.uint64(DIM - _WORDS - 8)).astype(np.int64)


def _weighted(tf: np.ndarray, idf: np.ndarray, words: float = 0.3) -> np.ndarray:
    x = tf * idf
    for part, weight in ((slice(0, _WORDS), words), (slice(_WORDS, DIM), 1.0)):
        norm = np.linalg.norm(x[:, part], axis=1, keepdims=True)
        x[:, part] *= weight / np.maximum(norm, 1e-9)
    return x


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


def _sample_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        y = T.column(batch, "y").to_numpy(zero_copy_only=False).astype(np.int32)
        for begin, tf in term_counts(T.column(batch, "text")):
            packed = [np.flatnonzero(r).astype(np.uint16).tobytes() + r[r > 0].astype(np.float32).tobytes() for r in tf]
            yield pa.RecordBatch.from_arrays([pa.array(y[begin : begin + len(tf)]), pa.array(packed, pa.binary())], ["y", "tf"])


def learn(sample: DataFrame, rank: int = 64, seed: int = 3) -> Space:
    """The space of the rows (text, y) given; their number must be bounded."""
    rows = sorted((r["y"], bytes(r["tf"])) for r in sample.mapInArrow(_sample_terms, "y int, tf binary").collect())
    tf = np.zeros((len(rows), DIM), np.float32)
    for i, (_, packed) in enumerate(rows):
        n = len(packed) // 6
        tf[i, np.frombuffer(packed, np.uint16, n)] = np.frombuffer(packed[2 * n :], np.float32, n)
    return fit(tf, np.array([y for y, _ in rows], np.int64), rank, seed)


def fit(tf: np.ndarray, y: np.ndarray, rank: int, seed: int) -> Space:
    idf = (np.log((1 + len(y)) / (1 + (tf > 0).sum(0))) + 0.1).astype(np.float32)
    x = _weighted(tf, idf)
    rng = np.random.default_rng(seed)
    basis = rng.normal(size=(DIM, min(rank + 16, DIM))).astype(np.float32)
    for _ in range(4 if len(y) else 0):
        basis, _ = np.linalg.qr(x.T @ (x @ basis))
    if len(y):
        _, _, v = np.linalg.svd(x @ basis, full_matrices=False)
        basis = basis @ v[:rank].T
    basis = basis[:, :rank].astype(np.float32)
    return Space(idf, basis, _unit(x @ basis), y)


def vote(space: Space, tf: np.ndarray, k: int = 25, sharp: int = 8) -> np.ndarray:
    """Scores of rows of term frequencies."""
    if not len(space.y):
        return np.zeros(len(tf))
    near = _unit(_weighted(tf, space.idf) @ space.project) @ space.vectors.T
    k = min(k, near.shape[1])
    top = np.sort(np.argpartition(-near, k - 1, axis=1)[:, :k], axis=1)
    weight = np.maximum(np.take_along_axis(near, top, 1), 1e-9).astype(float) ** sharp
    score = (weight * space.y[top]).sum(1) / weight.sum(1)
    return np.where(tf.any(axis=1), np.clip(score, 0, 1), 0.0)


def quality(docs: DataFrame, space: Space, k: int = 25) -> DataFrame:
    """doc_id, score (0 to 1) and predicted (score >= 0.5) for each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = T.column(batch, "text")
            score = np.concatenate([np.zeros(0), *(vote(space, tf, k) for _, tf in term_counts(texts))])
            yield pa.RecordBatch.from_arrays([T.column(batch, "doc_id"), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], ["doc_id", "score", "predicted"])

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(run, "doc_id long, score double, predicted int")
