"""N-gram Jaccard self-join by a grouped prefix join.

Shingles of each document are put in one global order, rare ones first.  Two
sets with Jaccard similarity t or more share a shingle among their first
n - ceil(t*n) + 1, and the first shingle that they share leaves enough of both
sets to reach the overlap that t asks for.  If that is o, the first l shingles
that they share each leave o - l + 1 at least, so l of those are asked for, as many
as the prefixes allow (`SHARED` at most): chance gives unlike sets one or two.

1. Documents with the same prefix and size form a group, and only groups are
   listed, with the place of the shingle; copies never meet one by one.
2. Groups of a list pair up if their sizes and places allow the overlap, and stay
   if they do so in enough lists.  A list that would give more than `hot` pairs for each of its groups gives a chain
   through those groups that could pair; so does a group of more than `hot` sets.
   What chains tie together is a crowd.
3. All other pairs of groups are expanded to pairs of their members (distinct
   sets) and verified one by one, next to pairs they share sets with.
   In a crowd nearly all pairs link, so its sets are verified by matrix products,
   in blocks by size and hash: a task holds two blocks at most, whatever the size
   of the crowd.  Tasks return a spanning forest and the number of links of each
   set, so no list of all links exists.
4. Components of the verified links give each document its smallest partner.

Order: shingles counted often are ranked by their count, all others stand before
them by their hash.  Counts come from all documents; which shingles get a rank
affects speed only, since any common order gives the same links.

Defined cases: null or wordless text has no shingles and links with nothing;
fewer than k words form one shingle; equal texts are linked whatever their ids;
a null doc_id keeps its row, and is never a component's smallest id unless the
component has no other; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textops as T
from .support import components, cut, least_labels, width

_POSTING = np.dtype([("t", "u4"), ("g", "u8"), ("n", "u4"), ("i", "u4")])
_DOC = np.dtype([("d", "i8"), ("null", "u1"), ("n", "u4"), ("g", "u8"), ("s", "u8"), ("h", "i8")])
_CHUNK = 1 << 20  # shingles, postings or pairs handled together
_COUNTED = 1 << 23  # shingles counted together
_SEEN = 1 << 18  # sets remembered by a task to skip copies
_SENT = 64 << 20  # bytes of a table that is broadcast, at most
RANKED = 200_000  # shingles with a rank by count
ELEMENTS = 1_000_000  # shingles of a block
SHARED = 8  # shingles that the prefixes of a pair must share, at most
WORK = 32  # shingles that a task for pairs looks up, for each that it holds


def shingle_sets(texts: pa.Array, k: int, how: T.Splitter = T.SPACED_LOWER) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingle hashes) for each text."""
    for begin, end, data, offsets in T.slices(texts):
        words = T.split(data, offsets, how)
        hashes, _, text = T.text_windows(words, k)
        bounds = np.searchsorted(text, np.arange(end - begin + 1))
        counts = np.diff(words.first)
        for i in range(end - begin):
            if counts[i] >= k:
                yield begin + i, np.unique(hashes[bounds[i] : bounds[i + 1]])
            elif counts[i]:
                yield begin + i, T.windows(words.hash[words.first[i] : words.first[i + 1]], int(counts[i]))
            else:
                yield begin + i, hashes[:0]


def set_id(shingles: np.ndarray) -> np.uint64:
    return T.mix(np.array([T.mix(shingles).sum(dtype=np.uint64) + np.uint64(len(shingles))], np.uint64))[0]


def _fresh(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[tuple[np.ndarray, np.uint64]]:
    """Sets of a task, without most repetitions."""
    seen: set[int] = set()
    for batch in batches:
        for _, s in shingle_sets(T.column(batch, "text"), k):
            if len(s) and (sid := int(set_id(s))) not in seen:
                if len(seen) >= _SEEN:
                    seen.clear()
                seen.add(sid)
                yield s


def _count_often(k: int, least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = np.empty(0, np.uint64), 0

        def often() -> pa.RecordBatch:
            part = held[:size]
            part.sort()
            h = np.unique(part[least - 1 :][part[least - 1 :] == part[: max(0, size - least + 1)]])
            c = np.searchsorted(part, h, "right") - np.searchsorted(part, h)
            return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(c.astype(np.int64))], ["h", "c"])

        for s in _fresh(batches, k):
            if size and size + len(s) > _COUNTED:
                yield often()
                size = 0
            if size + len(s) > len(held):
                held = np.concatenate([held[:size], np.empty(max(len(s), min(_COUNTED - size, size + _CHUNK)), np.uint64)])
            held[size : size + len(s)] = s
            size += len(s)
        if size:
            yield often()
        held = np.empty(0, np.uint64)
        T.give_back()

    return run


def often_ranked(docs: DataFrame, k: int, least: int = 3) -> np.ndarray:
    """Hashes of shingles that many sets hold, rarest first; RANKED at most, by count."""
    counted = docs.select("text").mapInArrow(_count_often(k, least), "h long, c long").groupBy("h").agg(F.sum("c").alias("c")).where(F.col("c") >= 2 * least)
    rows = counted.orderBy(F.desc("c"), "h").limit(RANKED).select("h").toArrow()
    return rows.column("h").to_numpy().view(np.uint64)[::-1].copy()


class Order:
    """The order of shingles: by hash, then the ranked ones, the most frequent last."""

    def __init__(self, ranked: np.ndarray) -> None:
        at = np.argsort(ranked)
        self.hashes, self.ranks = ranked[at], at.astype(np.uint64)

    def keys(self, s: np.ndarray) -> np.ndarray:
        out = s >> np.uint64(1)
        if len(self.hashes):
            at = np.minimum(np.searchsorted(self.hashes, s), len(self.hashes) - 1)
            hit = self.hashes[at] == s
            out[hit] = np.uint64(1 << 63) + self.ranks[at[hit]]
        return out


def prefix_length(n: int, percent: int) -> int:
    return n - (percent * n + 99) // 100 + 1


def _index(k: int, percent: int, buckets: int, ranked: np.ndarray):
    """Rows (kind, bucket, blob): postings of prefixes by shingle (0), documents (1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = Order(ranked)
        seen: set[int] = set()
        held: list[tuple[np.ndarray, np.uint64, int]] = []
        size = 0

        def rows(kind: int, part: np.ndarray, what: np.ndarray) -> pa.RecordBatch:
            at = np.argsort(part, kind="stable")
            part, what = part[at], what[at]
            b, first = np.unique(part, return_index=True)
            blobs = [by_column(x) for x in np.split(what, first[1:])]
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(b), kind, np.int32)), pa.array(b.astype(np.int32)), pa.array(blobs, pa.binary())], ["kind", "bucket", "blob"])

        def postings() -> pa.RecordBatch:
            out = np.empty(size, _POSTING)
            held.sort(key=lambda x: x[1])
            tokens = T.mix(np.concatenate([x[0] for x in held]))
            out["t"] = tokens >> np.uint64(32)  # shingles that agree in bucket and these bits only add pairs to verify
            lengths = [len(x[0]) for x in held]
            out["g"] = np.repeat(np.array([x[1] for x in held], np.uint64), lengths)
            out["n"] = np.repeat(np.array([x[2] for x in held], np.uint32), lengths)
            out["i"] = np.concatenate([np.arange(n, dtype=np.uint32) for n in lengths])
            return rows(0, (tokens % np.uint64(buckets)).astype(np.int64), out)

        for batch in batches:
            ids = T.column(batch, "doc_id")
            null = np.asarray(ids.is_null(), dtype=bool) if ids.null_count else np.zeros(len(ids), bool)
            docs = np.zeros(len(ids), _DOC)
            docs["d"], docs["null"] = ids.fill_null(0).to_numpy(zero_copy_only=False), null
            docs["h"] = T.column(batch, "text_hash").to_numpy()
            for i, s in shingle_sets(T.column(batch, "text"), k):
                if not len(s):
                    continue
                n = len(s)
                p = prefix_length(n, percent)
                keys = order.keys(s)
                prefix = np.sort(np.partition(keys, p - 1)[:p] if p < n else keys)
                group = np.uint64(min(n, 0xFFFF) << 48) | T.mix(T.windows(prefix, p) + np.uint64(n))[0] >> np.uint64(16)
                docs["n"][i], docs["g"][i], docs["s"][i] = n, group, set_id(s)
                if int(group) not in seen:
                    if len(seen) >= _SEEN:
                        seen.clear()
                    seen.add(int(group))
                    held.append((prefix, group, n))
                    size += p
                    if size >= _CHUNK:
                        yield postings()
                        held, size = [], 0
            if len(docs):
                yield rows(1, (T.mix(docs["s"] + np.where(docs["n"] > 0, 0, np.arange(len(docs))).astype(np.uint64)) % np.uint64(buckets)).astype(np.int64), docs)
        if held:
            yield postings()
        held = []
        T.give_back()

    return run


def by_column(rows: np.ndarray) -> bytes:
    """The fields one after the other, each by the place of its bytes, packed: of sorted ones the high bytes repeat."""
    return zstandard.compress(b"".join(np.ascontiguousarray(rows[f]).view(np.uint8).reshape(len(rows), -1).T.tobytes() for f in rows.dtype.names), 1)


def from_columns(blob: memoryview, kind: np.dtype) -> np.ndarray:
    data = zstandard.decompress(blob)
    n, at = len(data) // kind.itemsize, 0
    out = np.empty(n, kind)
    for f in kind.names:
        size = kind[f].itemsize
        out[f] = np.ascontiguousarray(np.frombuffer(data, np.uint8, n * size, at).reshape(size, n).T).view(kind[f]).ravel()
        at += n * size
    return out


def _unpack_docs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for blob in T.column(batch, "blob"):
            x = from_columns(blob.as_buffer(), _DOC)
            yield pa.RecordBatch.from_arrays(
                [pa.array(x["d"].copy(), mask=x["null"].astype(bool)), pa.array(x["n"].astype(np.int64)), pa.array(x["g"].copy().view(np.int64)), pa.array(x["s"].copy().view(np.int64)), pa.array(x["h"].copy())], ["doc_id", "n", "g", "s", "text_hash"]
            )


def least_overlap(n: np.ndarray, m: np.ndarray, percent: int) -> np.ndarray:
    """How many shingles sets of n and m share at least if they link."""
    return (percent * (n + m) + 99 + percent) // (100 + percent)


def spread_out(counts: np.ndarray, limit: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(i, k) for k from 0 to counts[i] - 1, in runs of about `limit`; one i is never cut."""
    total = np.concatenate([[0], np.cumsum(counts)])
    low = 0
    while low < len(counts):
        high = max(low + 1, int(np.searchsorted(total, total[low] + limit, "right")) - 1)
        i = np.repeat(np.arange(low, high), counts[low:high])
        yield i, np.arange(len(i)) - (total[i] - total[low])
        low = high


def least_rest(n: np.ndarray, m: np.ndarray, percent: int) -> np.ndarray:
    """What those shingles that are counted leave of each of two sets at least; more than it, up to the least overlap, is their number."""
    return np.maximum(least_overlap(n, m, percent) - SHARED + 1, (percent * np.maximum(n, m) + 99) // 100)


def _ties(g: np.ndarray, h: np.ndarray, need: np.ndarray | None = None) -> pa.RecordBatch:
    """Distinct pairs of groups, in how many lists they met, and in how many they must; none for a crowd."""
    a, b = np.minimum(g, h), np.maximum(g, h)
    _, at, shared = np.unique(T.mix(a) ^ b, return_index=True, return_counts=True)
    crowd = need is None
    need = np.zeros(len(at), np.int32) if crowd else need[at].astype(np.int32)
    return pa.RecordBatch.from_arrays([pa.array(a[at].view(np.int64)), pa.array(b[at].view(np.int64)), pa.array(np.full(len(at), crowd)), pa.array(shared.astype(np.int32)), pa.array(need)], ["g1", "g2", "crowd", "shared", "need"])


def _meet(percent: int, hot: int):
    """Pairs of groups that may link, or chains where there would be too many."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x = np.concatenate([np.zeros(0, _POSTING), *(from_columns(b.as_buffer(), _POSTING) for batch in batches for b in T.column(batch, "blob"))])
        by = np.argsort(x["t"])
        token = x["t"][by]
        more = np.zeros(len(by), bool)
        more[1:] = token[1:] == token[:-1]
        more[:-1] |= more[1:]
        x = x[by[more]]  # shingles that one group only has are most
        del by, token, more
        x = x[np.lexsort((x["i"], x["g"], x["n"], x["t"]))]
        fresh = np.ones(len(x), bool)
        fresh[1:] = (x["t"][1:] != x["t"][:-1]) | (x["g"][1:] != x["g"][:-1]) | (x["i"][1:] != x["i"][:-1])
        x = x[fresh]
        if not len(x):
            return
        g, n = x["g"].copy(), x["n"].astype(np.int64)
        rest = n - x["i"]
        opens = np.ones(len(x), bool)
        opens[1:] = x["t"][1:] != x["t"][:-1]
        del x, fresh
        place = np.arange(len(g))
        list_of = np.cumsum(opens) - 1
        first = np.flatnonzero(opens)
        length = np.diff(np.append(first, len(g)))
        # The smaller set of a pair (listed first) leaves enough even for one of its own size.
        leads = rest >= least_rest(n, n, percent)
        end = np.searchsorted((list_of << 32) + n, (list_of << 32) + 100 * n // percent, "right")
        count = np.where(leads, end - place - 1, 0)
        crowded = np.add.reduceat(count, first) > hot * length
        lead = np.maximum.accumulate(np.where(leads, place, -1))
        lead[1:], lead[0] = lead[:-1].copy(), -1
        tied = np.flatnonzero(crowded[list_of] & (lead >= first[list_of]))
        tied = tied[percent * n[tied] <= 100 * n[lead[tied]]]
        for low in range(0, len(tied), _CHUNK):
            part = tied[low : low + _CHUNK]
            yield _ties(g[lead[part]], g[part])
        open_ = np.flatnonzero((count > 0) & ~crowded[list_of])
        for i, k in spread_out(count[open_], _CHUNK):
            i = open_[i]
            j = i + 1 + k
            least = least_rest(n[i], n[j], percent)
            fits = (np.minimum(rest[i], rest[j]) >= least) & (g[i] != g[j])
            i, j, least = i[fits], j[fits], least[fits]
            yield _ties(g[i], g[j], least_overlap(n[i], n[j], percent) - least + 1)
        T.give_back()

    return run


def _sets(k: int):
    """Adds the shingles of each text; rows whose text is not the set meant (texts of one hash) go."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["s", "copies", "pieces"]
        for batch in batches:
            meant = T.column(batch, "s").to_numpy().view(np.uint64)
            at: list[int] = []
            held: list[bytes] = []
            size = 0
            for i, s in shingle_sets(T.column(batch, "text"), k):
                if len(s) and set_id(s) == meant[i]:
                    at.append(i)
                    held.append(s.tobytes())
                    size += len(s)
                if held and (size >= _CHUNK or i == len(meant) - 1):
                    yield pa.RecordBatch.from_arrays([*(T.column(batch, n).take(pa.array(at)) for n in names), pa.array(held, pa.binary())], [*names, "shingles"])
                    at, held, size = [], [], 0

    return run


class Rows:
    """Sets as rows of a sparse matrix whose columns are the shingles that two sets hold or more."""

    def __init__(self, sets: list[np.ndarray]) -> None:
        self.size = np.array([len(s) for s in sets], np.int64)
        _, inverse, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        shared = counts[inverse] > 1
        row = np.repeat(np.arange(len(sets)), self.size)[shared]
        self.width = int((counts > 1).sum())
        self.column = (np.cumsum(counts > 1) - 1)[inverse[shared]]  # ascending in each row
        self.first = np.searchsorted(row, np.arange(len(sets) + 1))
        self.row = row

    def _similar(self, both: np.ndarray, n: np.ndarray, m: np.ndarray, percent: int) -> np.ndarray:
        return 100 * both >= percent * (n + m - both)

    def pairs(self, a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
        """Which of the pairs of rows link."""
        cells = self.row * self.width + self.column
        count = np.diff(self.first)
        short = np.where(count[a] <= count[b], a, b)
        long = a + b - short
        both = np.zeros(len(a), np.int64)
        if len(cells):
            for i, k in spread_out(count[short], _CHUNK):
                sought = long[i] * self.width + self.column[self.first[short[i]] + k]
                found = cells[np.minimum(np.searchsorted(cells, sought), len(cells) - 1)] == sought
                both += np.bincount(i[found], minlength=len(a))
        return self._similar(both, self.size[a], self.size[b], percent)

    def products(self, left: np.ndarray, right: np.ndarray, percent: int, step: int = 4096) -> np.ndarray:
        """Which of the rows `left` link with which of `right`, as a boolean matrix."""
        both = np.zeros((len(left), len(right)))
        by = np.argsort(self.column, kind="stable")
        row, column = self.row[by], self.column[by]
        for low in range(0, self.width, step):
            i, j = np.searchsorted(column, [low, low + step])
            dense = np.zeros((len(self.size), min(step, self.width - low)), np.float32)
            dense[row[i:j], column[i:j] - low] = 1
            both += dense[left] @ dense[right].T
        return self._similar(both, self.size[left][:, None], self.size[right][None, :], percent)


def _verify(percent: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """Links of the pairs given, or else between two blocks or within one: forest edges and link counts (a = b)."""

    def run(rows: pa.Table, pairs: pa.Table) -> pa.Table:
        ids, first = np.unique(rows.column("s").to_numpy(), return_index=True)
        found = [np.zeros(0, np.int64)] * 3
        if len(ids):
            side, copies = rows.column("side").to_numpy()[first], rows.column("copies").to_numpy()[first]
            blobs = rows.column("shingles")
            sets = Rows([np.frombuffer(blobs[int(i)].as_buffer(), np.uint64) for i in first])
            if pairs.num_rows:
                a, b = (np.minimum(np.searchsorted(ids, sought := pairs.column(c).to_numpy()), len(ids) - 1) for c in ("s1", "s2"))
                here = (ids[a] == pairs.column("s1").to_numpy()) & (ids[b] == pairs.column("s2").to_numpy())
                a, b = a[here], b[here]
                link = sets.pairs(a, b, percent)
                a, b = a[link], b[link]
            else:
                left, right = (np.arange(len(ids)),) * 2 if not side.any() else (np.flatnonzero(side == 1), np.flatnonzero(side == 2))
                a, b = np.nonzero(sets.products(left, right, percent))
                a, b = left[a], right[b]
                once = a < b if not side.any() else slice(None)
                a, b = a[once], b[once]
            links = np.bincount(a, copies[b], len(ids)) + np.bincount(b, copies[a], len(ids))
            label = least_labels(len(ids), a, b)
            low, own = np.flatnonzero(label < np.arange(len(ids))), np.flatnonzero(links)
            found = [np.concatenate(x).astype(np.int64) for x in ((ids[low], ids[own]), (ids[label[low]], ids[own]), (np.zeros(len(low)), links[own]))]
            T.give_back()
        return pa.table(dict(zip(("a", "b", "links"), map(pa.array, found), strict=True)))

    return run


_PIECE = ("cluster", "low", "x", "high", "y", "side")


def ngram_join(docs: DataFrame, k: int = 5, percent: int = 80, hot: int = 64, block: int = 1024, small: int = 1_000_000) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, n_links, component, text_hash.

    n_links counts the other documents it links with; component is the same for
    linked documents whatever their ids (null without shingles), and text_hash is
    xxhash64 of the text.  `hot`: pairs that a list may give for each of its
    groups, and sets that a group may have, before they become a crowd.  `block`:
    sets of a block; blocks of large sets hold fewer.  `small`: keys that are
    broadcast at most, and in no more than 64 MB; more are joined by a shuffle.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    docs = docs.withColumn("text_hash", F.xxhash64("text"))
    buckets = width(spark)
    index = docs.mapInArrow(_index(k, percent, buckets, often_ranked(docs, k)), "kind int, bucket int, blob binary").persist(StorageLevel.DISK_ONLY)
    try:
        rows = cut(index.where("kind = 1").select("blob").mapInArrow(_unpack_docs, "doc_id long, n long, g long, s long, text_hash long"))
        met = index.where("kind = 0").select("bucket", "blob").repartition(buckets, "bucket").groupBy("bucket").applyInArrow(_meet(percent, hot), "g1 long, g2 long, crowd boolean, shared int, need int")
        met = met.groupBy("g1", "g2").agg(F.max("crowd").alias("crowd"), F.sum("shared").alias("shared"), F.max("need").alias("need"))
        met = cut(met.where("crowd or shared >= need").select("g1", "g2", "crowd"))
    finally:
        index.unpersist()
    texts = rows.where("n > 0").groupBy("doc_id", "text_hash", "g", "s", "n").agg(F.count("*").alias("copies"))
    texts = cut(texts)
    repeated = not texts.where("copies > 1").isEmpty()
    rep = F.min(F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", "text_hash"))
    members = cut(texts.groupBy("g", "s", "n").agg(rep.alias("rep"), F.sum("copies").alias("copies")))
    crowds, pairs = _crowds(met, members, hot)
    tasks = _tasks(pairs)
    blocks = _blocks(members.join(crowds, "g").select("s", "n", "cluster"), block, percent)
    both = [tasks.select(F.col(x).alias("s"), F.array(F.struct(*_PIECE)).alias("pieces")) for x in ("s1", "s2")]
    needed = blocks.unionByName(both[0].unionByName(both[1]).distinct())
    needed = needed.groupBy("s").agg(F.flatten(F.collect_list("pieces")).alias("pieces")).join(members.select("s", "copies", "rep.doc_id", "rep.text_hash"), "s")
    needed = cut(needed.select("s", "copies", "pieces", F.col("doc_id").alias("rep_id"), F.col("text_hash").alias("rep_hash")))
    of_it = needed.agg(F.count("*"), F.sum(64 + 32 * F.size("pieces"))).first()
    ready = F.broadcast(needed) if of_it[0] <= small and (of_it[1] or 0) <= _SENT else needed
    chosen = docs.join(ready, F.col("doc_id").eqNullSafe(F.col("rep_id")) & (F.col("text_hash") == F.col("rep_hash"))).select("text", "s", "copies", "pieces")
    sets = chosen.mapInArrow(_sets(k), "s long, copies long, pieces array<struct<cluster:long,low:int,x:int,high:int,y:int,side:int>>, shingles binary")
    if repeated:  # rows equal in doc_id and text all bring their set
        sets = sets.dropDuplicates(["s"])
    placed = sets.select(F.explode("pieces").alias("p"), "s", "copies", "shingles").select("p.*", "s", "copies", "shingles")
    by = _PIECE[:-1]
    tested = cut(placed.groupBy(*by).cogroup(tasks.select(*by, "s1", "s2").groupBy(*by)).applyInArrow(_verify(percent), "a long, b long, links long"))
    links = tested.where("a = b").groupBy(F.col("a").alias("s")).agg(F.sum("links").alias("links"))
    roots = components(tested.where("a <> b").select("a", "b")).withColumnRenamed("node", "s")
    classes = members.join(roots, "s", "left").join(links, "s", "left").withColumn("root", F.coalesce("root", "s"))
    least = classes.groupBy("root").agg(F.min("rep.doc_id").alias("component_id"))
    classes = classes.join(least, "root").select("s", "root", "component_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    empty = rows.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.lit(0).cast("long").alias("n_links"), F.lit(None).cast("long").alias("component"), "text_hash")
    return rows.where("n > 0").join(classes, "s").select("doc_id", F.col("n").alias("n_shingles"), "component_id", "n_links", F.col("root").alias("component"), "text_hash").unionByName(empty)


def _crowds(met: DataFrame, members: DataFrame, hot: int) -> tuple[DataFrame, DataFrame]:
    """(g, cluster) of the groups in crowds, and (s1, n1, s2, n2): all pairs of sets to verify besides."""
    counts = members.groupBy("g").agg(F.count("*").alias("m")).where("m > 1")
    counts = cut(counts)
    large = cut(counts.where(f"m > {hot}").select("g"))
    if not large.isEmpty():
        for x in ("g1", "g2"):
            met = met.join(large.select(F.col("g").alias(x), F.lit(True).alias("large")), x, "left").withColumn("crowd", F.col("crowd") | F.col("large").isNotNull()).drop("large")
        met = cut(met)
    roots = components(met.where("crowd").select(F.col("g1").alias("a"), F.col("g2").alias("b")))
    crowds = roots.select(F.col("node").alias("g"), F.col("root").alias("cluster"))
    crowds = cut(crowds.unionByName(large.join(crowds, "g", "left_anti").select("g", F.col("g").alias("cluster"))))
    apart = met.where("not crowd")
    if not crowds.isEmpty():
        for i in (1, 2):
            apart = apart.join(crowds.select(F.col("g").alias(f"g{i}"), F.col("cluster").alias(f"c{i}")), f"g{i}", "left")
        apart = apart.where("c1 is null or c2 is null or c1 <> c2")
    sides = [members.select(F.col("g").alias(f"g{i}"), F.col("s").alias(f"s{i}"), F.col("n").alias(f"n{i}")) for i in (1, 2)]
    across = apart.select("g1", "g2").join(sides[0], "g1").join(sides[1], "g2").select("s1", "n1", "s2", "n2")
    few = counts.join(crowds, "g", "left_anti").select("g")
    inside = few.join(members.select("g", "s", "n"), "g")
    inside = inside.select("g", F.col("s").alias("s1"), F.col("n").alias("n1")).join(inside.select("g", F.col("s").alias("s2"), F.col("n").alias("n2")), "g").where("s1 < s2")
    return crowds, cut(across.unionByName(inside.select("s1", "n1", "s2", "n2")))


def _tasks(pairs: DataFrame) -> DataFrame:
    """(s1, s2) with the task that verifies the pair, as the columns of a piece.

    A pair goes by the smallest set near either of its sets, so pairs that share
    sets mostly meet.  What one such set draws to itself is a task, or several of
    them if it is light, or, if it is heavy, cut into squares by hashes of both
    sets, so a set goes to few of them.
    """
    ends = cut(pairs.select(F.col("s1").alias("s"), F.col("s2").alias("o")).unionByName(pairs.select(F.col("s2").alias("s"), F.col("s1").alias("o"))))
    near = cut(ends.groupBy("s").agg(F.min("o").alias("o")).select("s", F.least("s", "o").alias("near")))
    near = ends.join(near.withColumnRenamed("s", "o"), "o").groupBy("s").agg(F.min("near").alias("near")).select("s", F.least("s", "near").alias("near"))
    for i in (1, 2):
        pairs = pairs.join(near.select(F.col("s").alias(f"s{i}"), F.col("near").alias(f"near{i}")), f"s{i}")
    pairs = cut(pairs.select("s1", "n1", "s2", "n2", F.least("near1", "near2").alias("near")))
    sets = pairs.select("near", F.col("s1").alias("s"), F.col("n1").alias("n")).unionByName(pairs.select("near", F.col("s2").alias("s"), F.col("n2").alias("n"))).distinct()
    weights = pairs.groupBy("near").agg(F.sum(F.col("n1") + F.col("n2")).alias("work")).join(sets.groupBy("near").agg(F.sum("n").alias("held")), "near")
    # a square holds the sets of two of its sides; a task looks up WORK shingles for each that it holds
    side = F.greatest(F.when(F.col("held") > ELEMENTS, F.ceil(2 * F.col("held") / ELEMENTS)).otherwise(1), F.ceil(F.sqrt(F.col("work") / (WORK * ELEMENTS))))
    weights = cut(weights.select("near", "held", side.cast("int").alias("side")))
    bins = 1 + (weights.where("side = 1").agg(F.sum("held")).first()[0] or 0) // ELEMENTS
    pairs = pairs.join(weights.select("near", "side"), "near")
    light, none = F.col("side") == 1, F.lit(-1)
    at = [F.when(light, none).otherwise(F.pmod(F.xxhash64(x), F.col("side"))).cast("int") for x in ("s1", "s2")]
    cluster = F.when(light, F.pmod(F.xxhash64("near"), F.lit(bins))).otherwise(F.col("near"))
    return cut(pairs.select("s1", "s2", cluster.alias("cluster"), at[0].alias("low"), at[1].alias("x"), none.alias("high"), none.alias("y"), F.lit(0).alias("side")))


def first_of_each(docs: DataFrame, small: int = 1_000_000, **how) -> DataFrame:
    """The rows of `docs` without those linked to an earlier one (by doc_id, null last, then by text).

    Of rows equal in doc_id and text one stays, unless they have no words.
    """
    joined = cut(ngram_join(docs, **how))
    first = joined.where("component is not null").groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", "text_hash")).alias("first"), F.count("*").alias("members"))
    first = first.where("members > 1")
    drop = joined.join(first, "component").where("not (doc_id <=> first.doc_id and text_hash = first.text_hash)").select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).distinct()
    drop = cut(drop)
    kept = docs.join(F.broadcast(drop) if drop.count() <= small else drop, docs["doc_id"].eqNullSafe(F.col("_id")) & (F.xxhash64(docs["text"]) == F.col("_hash")), "left_anti")
    again = joined.where("component is not null").groupBy("doc_id", "text_hash").count().where("count > 1").select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"))
    again = cut(again)
    if again.isEmpty():
        return kept
    same = kept["doc_id"].eqNullSafe(F.col("_id")) & (F.xxhash64(kept["text"]) == F.col("_hash"))
    return kept.join(again, same, "left_anti").unionByName(kept.join(again, same, "left_semi").dropDuplicates(["doc_id", "text"]))


def _blocks(sets: DataFrame, block: int, percent: int = 80) -> DataFrame:
    """(s, pieces): the pairs of blocks that each set of a crowd takes part in; sets that meet no other go.

    A small cluster is one block.  In a larger one sizes fall into steps of
    100/percent (5/4 for 80), so linked sets lie in the same or in neighbouring steps (of
    percent 100 in the same size, so steps of 5/4 do), and a step is cut by a hash into blocks of `block` sets, fewer where they are large.
    side: 0 a block against itself, 1 and 2 the two blocks of a pair.
    """
    whole = sets.groupBy("cluster").agg((F.count("*") <= block).alias("few"), (F.sum("n") <= ELEMENTS).alias("light"), F.count("*").alias("of_cluster"))
    whole = whole.where("of_cluster > 1").select("cluster", (F.col("few") & F.col("light")).alias("whole"))
    ratio = max(1.25, 100 / percent)
    step = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(ratio)) + 1e-9).cast("int")
    sets = sets.join(whole, "cluster").withColumn("step", F.when(F.col("whole"), 0).otherwise(step))
    holds = F.greatest(F.lit(2.0), F.least(F.lit(float(block)), F.lit(float(ELEMENTS)) / F.pow(F.lit(ratio), F.col("step").cast("double"))))
    counts = sets.groupBy("cluster", "step", "whole").agg(F.count("*").alias("held")).withColumn("parts", F.when(F.col("whole"), 1).otherwise(F.ceil(F.col("held") / holds)).cast("int"))
    around = counts.select("cluster", F.explode(F.array(*(F.struct((F.col("step") + d).alias("step"), F.lit(-d).alias("at"), F.col("parts").alias("parts")) for d in (-1, 0, 1)))).alias("x")).select("cluster", "x.*")
    around = around.groupBy("cluster", "step").agg(*(F.max(F.when(F.col("at") == d, F.col("parts"))).alias(name) for d, name in ((-1, "below"), (0, "parts"), (1, "above"))))
    sets = sets.join(around, ["cluster", "step"]).withColumn("part", F.expr("cast(pmod(xxhash64(s), parts) as int)"))
    pieces = F.expr(
        """concat(
            array(struct(cluster as cluster, step as low, part as x, step as high, part as y, 0 as side)),
            transform(filter(sequence(0, parts - 1), p -> p > part), p -> struct(cluster as cluster, step as low, part as x, step as high, p as y, 1 as side)),
            transform(filter(sequence(0, parts - 1), p -> p < part), p -> struct(cluster as cluster, step as low, p as x, step as high, part as y, 2 as side)),
            if(above is null, array(), transform(sequence(0, above - 1), p -> struct(cluster as cluster, step as low, part as x, step + 1 as high, p as y, 1 as side))),
            if(below is null, array(), transform(sequence(0, below - 1), p -> struct(cluster as cluster, step - 1 as low, p as x, step as high, part as y, 2 as side))))"""
    )
    return sets.select("s", pieces.alias("pieces"))
