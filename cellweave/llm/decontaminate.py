"""Benchmark decontamination with a distributed positional inverted index.

The index is cut by documents: each segment covers some millions of words and
holds, per term, the sorted positions of the term in the segment, whatever the
benchmark, so a stored index serves any.  Segments are
built where the documents are read, stored in the shared checkpoint folder, and
searched where they lie, so no posting list is ever gathered across segments and
a term or passage that every document holds is spread like any other.

A phrase search starts from the list of its rarest term in the segment and
intersects the other lists, shifted by their offsets, from rare to frequent.
Documents are numbered with a gap between them, so no match crosses a border.

Defined cases: null or wordless text has no words and no hits; a null item text
or item_id has no windows; an item of fewer than k words is one window; a null
doc_id keeps its row; repeated rows are judged one by one; extra columns are
ignored; an empty table gives no rows, an empty benchmark no hits.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textops as T
from .support import cut

SEGMENT = 1 << 21  # words of a segment
QUERY_WORDS = 2_000_000  # words of test items searched in one pass; more take several
INDEX = "segment string, doc_id array<long>, text_hash array<long>, first array<long>, n_words array<long>, term array<long>, start array<long>, positions binary"
HITS = "segment string, place int, doc_id long, text_hash long, n_words long, spans array<struct<from:long,until:long>>, items array<string>"


def _pack(values: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.diff(values, prepend=0).astype(np.int32).tobytes())


def _unpack(block: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(zstandard.ZstdDecompressor().decompress(block), np.int32), dtype=np.int64)


def _build(gap: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, made = TaskContext.get().partitionId(), 0
        ids: list[pa.Array] = []
        text_hashes: list[pa.Array] = []
        firsts: list[np.ndarray] = []
        counts: list[np.ndarray] = []
        found: list[tuple[np.ndarray, np.ndarray]] = []
        at = 0

        def segment() -> pa.RecordBatch:
            hashes = np.concatenate([x for x, _ in found])
            places = np.concatenate([x for _, x in found])
            by = np.argsort(hashes, kind="stable")
            hashes, places = hashes[by], places[by]
            term, start = np.unique(hashes, return_index=True)
            columns = [pa.concat_arrays(ids), pa.concat_arrays(text_hashes), pa.array(np.concatenate(firsts)), pa.array(np.concatenate(counts)), pa.array(term.view(np.int64)), pa.array(np.append(start, len(places)))]
            arrays = [pa.ListArray.from_arrays(pa.array([0, len(c)], pa.int32()), c) for c in columns]
            return pa.RecordBatch.from_arrays([pa.array([f"{task}-{made}"]), *arrays, pa.array([_pack(places)], pa.binary())], ["segment", "doc_id", "text_hash", "first", "n_words", "term", "start", "positions"])

        for batch in batches:
            doc_id = T.column(batch, "doc_id")
            for begin, end, data, offsets in T.slices(T.column(batch, "text")):
                words = T.split(data, offsets, T.ALNUM_LOWER)
                n = np.diff(words.first)
                first = at + np.concatenate([[0], np.cumsum(n + gap)])
                place = np.arange(len(words.hash)) + np.repeat(first[:-1] - words.first[:-1], n)
                ids.append(doc_id.slice(begin, end - begin))
                text_hashes.append(T.column(batch, "text_hash").slice(begin, end - begin))
                firsts.append(first[:-1])
                counts.append(n)
                found.append((words.hash, place))
                at = int(first[-1])
                if at >= SEGMENT:
                    yield segment()
                    made, at = made + 1, 0
                    ids, text_hashes, firsts, counts, found = [], [], [], [], []
        if ids:
            yield segment()

    return run


def build_index(docs: DataFrame, gap: int = 1) -> DataFrame:
    """The stored index of `docs`."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("text_hash", F.xxhash64("text"))
    return cut(docs.mapInArrow(_build(gap), INDEX))


class Postings:
    """Lists of one segment."""

    def __init__(self, row: dict) -> None:
        self.term = np.asarray(row["term"]).view(np.uint64)
        self.start = np.asarray(row["start"])
        self.all = _unpack(row["positions"])
        self.first = np.asarray(row["first"])
        self.n_words = np.asarray(row["n_words"])

    def slots(self, hashes: np.ndarray) -> np.ndarray:
        """The place of each term in the lists, -1 where the segment lacks it."""
        if not len(self.term):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.term, hashes), len(self.term) - 1)
        return np.where(self.term[at] == hashes, at, -1)

    def of(self, slot: int) -> np.ndarray:
        return self.all[self.start[slot] : self.start[slot + 1]]

    def phrase(self, slots: np.ndarray) -> np.ndarray:
        """Where the terms follow each other."""
        by = np.argsort(self.start[slots + 1] - self.start[slots], kind="stable")
        begin = self.of(slots[by[0]]) - by[0]
        for j in by[1:]:
            if not len(begin):
                break
            positions = self.of(slots[j])
            at = np.minimum(np.searchsorted(positions, begin + j), len(positions) - 1)
            begin = begin[positions[at] == begin + j]
        return begin

    def near(self, slots: np.ndarray, within: int) -> np.ndarray:
        """Places of the rarest term that have every other term of their text within so many words."""
        by = np.argsort(self.start[slots + 1] - self.start[slots], kind="stable")
        place = self.of(slots[by[0]])
        doc = self.texts(place)
        low = np.maximum(place - within, self.first[doc])
        high = np.minimum(place + within, self.first[doc] + self.n_words[doc] - 1)
        ok = np.ones(len(place), bool)
        for j in by[1:]:
            positions = self.of(slots[j])
            ok &= np.searchsorted(positions, low) < np.searchsorted(positions, high, "right")
        return place[ok]

    def texts(self, place: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.first, place, "right") - 1


class Phrases:
    """The distinct windows of some items: window w is terms[start[w] : start[w] + length[w]]."""

    def __init__(self, items: list[tuple[str, np.ndarray]], k: int) -> None:
        self.names = [name for name, _ in items]
        self.terms = np.concatenate([np.zeros(0, np.uint64), *(h for _, h in items)])
        size = np.array([len(h) for _, h in items], np.int64)
        first = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
        starts, lengths, owners, bounds, held = [], [], [], [np.zeros(1, np.int64)], 0
        for n in np.unique(np.minimum(size, k)):
            if not n:
                continue
            of = np.flatnonzero(np.minimum(size, k) == n)
            many = size[of] - n + 1
            item = np.repeat(of, many)
            at = np.arange(len(item)) - np.repeat(np.cumsum(many) - many, many) + first[item]
            _, window, inverse = np.unique(T.windows(self.terms, int(n))[at], return_index=True, return_inverse=True)
            pairs = np.unique(np.stack([inverse, item], 1), axis=0)
            starts.append(at[window])
            lengths.append(np.full(len(window), n))
            owners.append(pairs[:, 1])
            bounds.append(held + np.searchsorted(pairs[:, 0], np.arange(len(window)), "right"))
            held += len(pairs)
        none = np.zeros(0, np.int64)
        self.start, self.length = np.concatenate([none, *starts]), np.concatenate([none, *lengths])
        self.owner, self.bound = np.concatenate([none, *owners]), np.concatenate(bounds)

    def within(self, slots: np.ndarray, k: int) -> np.ndarray:
        """The windows all of whose terms have a slot."""
        ok = np.ones(len(self.start), bool)
        for j in range(k):
            inside = self.length > j
            ok[inside] &= slots[self.start[inside] + j] >= 0
        return np.flatnonzero(ok)

    def of(self, w: int) -> list[str]:
        return [self.names[i] for i in self.owner[self.bound[w] : self.bound[w + 1]]]


def _search(items: list[tuple[str, np.ndarray]], k: int, within: int | None):
    def phrases(lists: Postings, wanted: Phrases) -> Iterator[tuple[np.ndarray, int, list[str]]]:
        slots = lists.slots(wanted.terms)
        for w in wanted.within(slots, k):
            n = int(wanted.length[w])
            yield lists.phrase(slots[wanted.start[w] : wanted.start[w] + n]), n, wanted.of(w)

    def places(lists: Postings, wanted: list[tuple[str, np.ndarray]]) -> Iterator[tuple[np.ndarray, int, list[str]]]:
        for name, terms in wanted:
            slots = lists.slots(terms)
            if (slots >= 0).all():
                yield lists.near(slots, within), 1, [name]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = Phrases(items, k) if within is None else [(name, np.unique(h)) for name, h in items if len(h)]
        for batch in batches:
            for i in range(batch.num_rows):
                row = {n: x.values if isinstance(x := T.column(batch, n)[i], pa.ListScalar) else x.as_py() for n in batch.schema.names}
                lists = Postings(row)
                begin: list[np.ndarray] = [np.zeros(0, np.int64)]
                length: list[np.ndarray] = [np.zeros(0, np.int64)]
                docs_items: dict[int, set[str]] = {}
                for at, n, names in (phrases if within is None else places)(lists, wanted):
                    if len(at):
                        begin.append(at)
                        length.append(np.full(len(at), n))
                        for d in np.unique(lists.texts(at)).tolist():
                            docs_items.setdefault(d, set()).update(names)
                yield _hits(row, lists, np.concatenate(begin), np.concatenate(length), docs_items)
        T.give_back()

    return run


def _hits(row: dict, lists: Postings, begin: np.ndarray, length: np.ndarray, items: dict[int, set[str]]) -> pa.RecordBatch:
    """Merged spans (word numbers) and items of each text of a segment."""
    by = np.argsort(begin, kind="stable")
    begin, until = begin[by], (begin + length)[by]
    n = len(row["doc_id"])
    spans: list[list[dict]] = [[] for _ in range(n)]
    if len(begin):
        reach = np.maximum.accumulate(until)
        fresh = np.concatenate([[True], begin[1:] > reach[:-1]])
        start = np.flatnonzero(fresh)
        ends = reach[np.append(start[1:], len(begin)) - 1]
        for d, a, b in zip(lists.texts(begin[start]).tolist(), begin[start].tolist(), ends.tolist(), strict=True):
            spans[d].append({"from": a - int(lists.first[d]), "until": b - int(lists.first[d])})
    kind = pa.list_(pa.struct([("from", pa.int64()), ("until", pa.int64())]))
    columns = [pa.array([row["segment"]] * n), pa.array(np.arange(n, dtype=np.int32)), row["doc_id"], row["text_hash"], pa.array(lists.n_words), pa.array(spans, kind), pa.array([sorted(items.get(d, ())) for d in range(n)], pa.list_(pa.string()))]
    return pa.RecordBatch.from_arrays(columns, ["segment", "place", "doc_id", "text_hash", "n_words", "spans", "items"])


def _hashed(rows) -> list[tuple[str, np.ndarray]]:
    out = []
    for row in rows:
        data, offsets = T.text_buffers(pa.array([row["text"] or ""], pa.string()))
        out.append((str(row["item"]), T.split(data, offsets, T.ALNUM_LOWER).hash))
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, k: int = 13, percent: int = 5, within: int | None = None) -> DataFrame:
    """One row per document: doc_id, text_hash (xxhash64), n_words, n_hit, items (sorted strings), spans, contaminated.

    Contaminated: some word is hit and at least `percent` of the words are.
    `within`: instead of phrases, hits are places of an item's rarest term with
    all its other terms at most so many words away.
    """
    items = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("string").alias("item"), F.col("text").cast("string").alias("text"))
    total = items.agg(F.sum(F.expr("1 + length(text) div 4"))).first()[0] or 0
    blocks = max(1, -(-total // QUERY_WORDS))
    parts = [items.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == b) for b in range(blocks)]
    index = build_index(docs)
    found = reduce(DataFrame.unionByName, (index.mapInArrow(_search(_hashed(part.toLocalIterator()), k, within), HITS) for part in parts))
    if blocks > 1:
        found = found.groupBy("segment", "place", "doc_id", "text_hash", "n_words").agg(F.flatten(F.collect_list("spans")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
        spans = "aggregate(array_sort(spans), struct(0L as n, 0L as reach), (a, s) -> struct(a.n + greatest(0L, s.until - greatest(s.from, a.reach)) as n, greatest(a.reach, s.until) as reach), a -> a.n)"
    else:
        spans = "aggregate(spans, 0L, (n, s) -> n + s.until - s.from)"
    found = found.withColumn("n_hit", F.expr(spans))
    return found.select("doc_id", "text_hash", "n_words", "n_hit", "items", "spans", F.expr(f"n_hit > 0 and 100 * n_hit >= {percent} * n_words").alias("contaminated"))


def without_contaminated(docs: DataFrame, benchmark: DataFrame, small: int = 1_000_000, **how) -> DataFrame:
    """The rows of `docs` that are not contaminated."""
    found = decontaminate(docs, benchmark, **how).where("contaminated").select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).distinct()
    found = cut(found)
    return docs.join(F.broadcast(found) if found.count() <= small else found, docs["doc_id"].eqNullSafe(F.col("_id")) & (F.xxhash64(docs["text"]) == F.col("_hash")), "left_anti")
