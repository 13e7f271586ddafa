"""Substring deduplication with a log-structured index of window fingerprints.

A window is k consecutive words.  Documents are cut into runs by ranges of
doc_id, so every earlier run holds smaller ids only.  Each run is written once as
sorted, immutable blocks of fingerprints, dealt out by fingerprint range.  Per
range the runs are merge-joined: a fingerprint belongs to the first run that has
it, and later runs are told which of theirs are old.  The merge is a stable merge
sort, which finds the sorted runs and merges them.  Matches between runs are
verified by 24 bits of an independent hash (88 bits agree), matches inside a run
by all of its 64.  Each run then removes what old windows cover, or windows that
start in a smaller document of the same run.

`previous` adds blocks of an index kept from earlier batches (run -1); they count
as older than every document.  `fingerprints` gives a batch's blocks and
`compact` merges the blocks of many runs into one, so batches may be
deduplicated as they come.

Defined cases: null or wordless text has no words and keeps an empty text; texts
under k words have no window; a null doc_id is smaller than none, so its windows
make no other old, while it loses what any identified document holds; rows that
share a doc_id do not remove each other's windows; extra columns are ignored; an
empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textops as T
from .support import width

_TAG = np.uint64(0xA24BAED4963EE407)
TAG_BYTES = 3  # of the hash that verifies, in a block
BLOCKS = "run int, bucket int, block binary"


def pack(values: np.ndarray, tags: np.ndarray) -> bytes:
    """Sorted fingerprints as differences of as few bytes as the largest takes, then tags."""
    steps = np.diff(values)
    n = max(1, (int(steps.max()).bit_length() + 7) // 8) if len(steps) else 1
    head = np.array([len(values), n, values[0] if len(values) else 0], np.uint64)
    return head.tobytes() + steps.view(np.uint8).reshape(-1, 8)[:, :n].tobytes() + tags.view(np.uint8).reshape(-1, 4)[:, :TAG_BYTES].tobytes()


def unpack(block: memoryview | bytes) -> tuple[np.ndarray, np.ndarray]:
    count, n, first = (int(x) for x in np.frombuffer(block, np.uint64, 3))
    if not count:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint32)
    steps = np.zeros((count, 8), np.uint8)
    steps[1:, :n] = np.frombuffer(block, np.uint8, (count - 1) * n, 24).reshape(-1, n)
    out = steps.reshape(-1).view(np.uint64)
    out[0] = first
    tags = np.zeros((count, 4), np.uint8)
    tags[:, :TAG_BYTES] = np.frombuffer(block, np.uint8, count * TAG_BYTES, 24 + (count - 1) * n).reshape(-1, TAG_BYTES)
    return np.cumsum(out, dtype=np.uint64), tags.reshape(-1).view(np.uint32)


def _second(words: np.ndarray, k: int, at: np.ndarray) -> np.ndarray:
    """Another hash of the windows that start at the words `at`."""
    return T.windows(T.mix(words ^ _TAG), k)[at]


def _tags(words: np.ndarray, k: int, at: np.ndarray) -> np.ndarray:
    return (_second(words, k, at) >> np.uint64(64 - 8 * TAG_BYTES)).astype(np.uint32)


def _bucket(values: np.ndarray, buckets: int) -> np.ndarray:
    return ((values >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)


def _write_run(k: int, buckets: int):
    def run(key: tuple, rows: pa.Table) -> pa.Table:
        all_values, all_tags = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint32)]
        for texts in rows.column("text").chunks:
            for _, _, data, offsets in T.slices(texts):
                words = T.split(data, offsets, T.SPACED)
                h, at, _ = T.text_windows(words, k)
                all_values.append(h)
                all_tags.append(_tags(words.hash, k, at))
        values, first = np.unique(np.concatenate(all_values), return_index=True)
        tags = np.concatenate(all_tags)[first]
        bucket = _bucket(values, buckets).astype(np.int32)
        present, start = np.unique(bucket, return_index=True)
        del all_values, all_tags
        blocks = [pack(v, t) for v, t in zip(np.split(values, start[1:]), np.split(tags, start[1:]), strict=True)] if len(values) else []
        T.give_back()
        return pa.table({"run": pa.array([key[0].as_py()] * len(blocks), pa.int32()), "bucket": pa.array(present), "block": pa.array(blocks, pa.binary())})

    return run


def _merged(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    parts = [unpack(b.as_buffer()) for b in rows.column("block")]
    runs = np.repeat(rows.column("run").to_numpy(), [len(v) for v, _ in parts])
    values, tags = np.concatenate([v for v, _ in parts]), np.concatenate([t for _, t in parts])
    by = np.argsort(values, kind="stable")  # a merge of the sorted blocks
    return values[by], tags[by], runs[by]


def _old_of(runs_in_all: int):
    """For each run, its fingerprints that an earlier run has."""

    def run(rows: pa.Table) -> pa.Table:
        values, tags, runs = _merged(rows)
        if not len(values):
            return pa.table({"run": pa.array([], pa.int32()), "old": pa.array([], pa.binary())})
        start = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]]))
        group = np.repeat(np.arange(len(start)), np.diff(np.append(start, len(values))))
        first = np.minimum.reduceat(runs, start)
        owner = np.zeros(len(start), np.uint32)
        is_first = runs == first[group]
        owner[group[is_first]] = tags[is_first]
        old = np.flatnonzero((runs > first[group]) & (first[group] < runs_in_all) & (tags == owner[group]))
        old = old[np.argsort(runs[old], kind="stable")]
        present, at = np.unique(runs[old], return_index=True)
        lists = [x.tobytes() for x in np.split(values[old], at[1:])] if len(old) else []
        del values, tags, runs, start, group, first, owner, is_first, old
        T.give_back()
        return pa.table({"run": pa.array(present.astype(np.int32)), "old": pa.array(lists, pa.binary())})

    return run


def _remove(k: int):
    """A run's documents without their old words."""
    names = ["doc_id", "n_words", "n_removed", "text"]

    def run(rows: pa.Table, lists: pa.Table) -> pa.Table:
        old = np.sort(np.concatenate([np.zeros(0, np.uint64), *(np.frombuffer(b.as_buffer(), np.uint64) for b in lists.column("old"))]))
        if not rows.num_rows:
            return pa.table({n: pa.array([], t) for n, t in zip(names, (pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)})
        ids_column = rows.column("doc_id").combine_chunks()
        ids, known = ids_column.fill_null(0).to_numpy(zero_copy_only=False), np.asarray(ids_column.is_valid())
        parts = []
        seconds = []
        for begin, end, data, offsets in T.slices(rows.column("text").cast(pa.large_string()).combine_chunks()):  # of any length in all
            words = T.split(data, offsets, T.SPACED)
            h, at, text = T.text_windows(words, k)
            parts.append((begin, end, words, h, at, text + begin))
            seconds.append(_second(words.hash, k, at))
        h, second = np.concatenate([p[3] for p in parts]), np.concatenate(seconds)
        text = np.concatenate([p[5] for p in parts])
        covered = _in_sorted(h, old)
        by = np.argsort(h)
        again = np.zeros(len(by), bool)
        again[1:] = h[by[1:]] == h[by[:-1]]
        again[:-1] |= again[1:]
        by = by[again & known[text[by]]] if len(by) else by  # windows found more than once, in identified rows
        if len(by):
            by = by[np.lexsort((second[by], h[by]))]
            value, other, doc = h[by], second[by], ids[text[by]]
            start = np.flatnonzero(np.concatenate([[True], (value[1:] != value[:-1]) | (other[1:] != other[:-1])]))
            least = np.repeat(np.minimum.reduceat(doc, start), np.diff(np.append(start, len(value))))
            covered[by[doc > least]] = True
        out = []
        seen = 0
        for begin, end, words, part, at, _ in parts:
            drop = T.spread(at[covered[seen : seen + len(part)]], k, len(words.start))
            seen += len(part)
            n_words = np.diff(words.first)
            kept = np.flatnonzero(~drop)
            counts = np.diff(np.searchsorted(kept, words.first))
            out.append(pa.table([ids_column.slice(begin, end - begin), pa.array(n_words), pa.array(n_words - counts), joined(words, kept, counts)], names=names))
        del parts, h, second, seconds, text, by, covered
        T.give_back()
        return pa.concat_tables(out)

    return run


def _in_sorted(values: np.ndarray, sorted_values: np.ndarray) -> np.ndarray:
    if not len(sorted_values):
        return np.zeros(len(values), bool)
    return sorted_values[np.minimum(np.searchsorted(sorted_values, values), len(sorted_values) - 1)] == values


def joined(words: T.Words, kept: np.ndarray, counts: np.ndarray) -> pa.Array:
    """The kept words of each text, joined by one space."""
    start, length = words.start[kept], (words.end - words.start)[kept]
    place = np.concatenate([[0], np.cumsum(length + 1)])
    out = np.full(place[-1], 0x20, np.uint8)
    total = int(length.sum())
    if total:
        run = np.repeat(np.cumsum(length) - length, length)
        inner = np.arange(total) - run
        out[np.repeat(place[:-1], length) + inner] = words.data[np.repeat(start, length) + inner]
    ends = place[np.concatenate([[0], np.cumsum(counts)])]
    if total:  # the space after each text's last word goes
        last = ends[1:][counts > 0] - 1
        out = np.delete(out, last)
        ends = ends - np.concatenate([[0], np.cumsum(counts > 0)])
    return pa.Array.from_buffers(pa.string(), len(counts), [None, pa.py_buffer(ends.astype(np.int32).tobytes()), pa.py_buffer(out.tobytes())])


def with_runs(docs: DataFrame, runs: int) -> DataFrame:
    """Adds `run`: ranges of doc_id of about equal rows, a power of two of them; null ids go to runs from `runs` on."""
    inner = docs.approxQuantile("doc_id", [i / runs for i in range(1, runs)], 1 / (4 * runs))
    bounds = "array(" + ", ".join(f"{int(x)}L" for x in inner) + ")"
    steps = "array(" + ", ".join(str(runs >> i) for i in range(1, runs.bit_length())) + ")"
    place = f"aggregate({steps}, 0, (at, step) -> if(element_at({bounds}, at + step) <= doc_id, at + step, at))" if inner and runs > 1 else "0"
    return docs.withColumn("run", F.expr(f"cast(if(doc_id is null, {runs} + pmod(xxhash64(text), {runs}), {place}) as int)"))


def _dealt(docs: DataFrame) -> tuple[DataFrame, int]:
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    n = width(docs.sparkSession)
    runs = 1 << max(1, (2 * n - 1).bit_length())
    return with_runs(docs, runs).repartition(n, "run"), runs


def fingerprints(docs: DataFrame, k: int = 13, buckets: int | None = None) -> DataFrame:
    """(run, bucket, block): the sorted runs of a table.  Batches of one index must share `buckets`."""
    dealt, _ = _dealt(docs)
    return dealt.groupBy("run").applyInArrow(_write_run(k, buckets or width(docs.sparkSession)), BLOCKS)


def compact(blocks: DataFrame) -> DataFrame:
    """One run, numbered -1, that holds the fingerprints of all."""

    def run(rows: pa.Table) -> pa.Table:
        values, tags, _ = _merged(rows)
        values, first = np.unique(values, return_index=True)
        return pa.table({"run": pa.array([-1], pa.int32()), "bucket": rows.column("bucket")[:1].combine_chunks(), "block": pa.array([pack(values, tags[first])], pa.binary())})

    return blocks.groupBy("bucket").applyInArrow(run, BLOCKS)


def substring_dedup(docs: DataFrame, k: int = 13, previous: DataFrame | None = None, buckets: int | None = None) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, text (the kept words joined by spaces)."""
    dealt, runs = _dealt(docs)
    n = buckets or width(docs.sparkSession)
    blocks = dealt.groupBy("run").applyInArrow(_write_run(k, n), BLOCKS)
    if previous is not None:
        blocks = blocks.unionByName(previous)
    old = blocks.repartition(n, "bucket").groupBy("bucket").applyInArrow(_old_of(runs), "run int, old binary")
    old = old.where("run >= 0")
    return dealt.groupBy("run").cogroup(old.groupBy("run")).applyInArrow(_remove(k), "doc_id long, n_words long, n_removed long, text string")
