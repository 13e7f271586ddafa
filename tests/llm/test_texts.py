"""Operators on texts against plain versions."""

import collections
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
import zstandard
from pyspark.sql import functions as F

from cellweave.llm import decontaminate as dc
from cellweave.llm import language_id, learning, ngram_join, quality_rules, substring_dedup, support, textops, toxicity
from cellweave.llm import neighbour_quality as nq

SPACED = r"[^\x20\x09-\x0D]+"
ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WORDS = [f"{a}{b}" for a in ("ka", "Lo", "é", "x") for b in ("na", "ti", "ŋ", "-", "!", "9")]


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def corpus(n=120, seed=1):
    """Texts with copies, near copies, shared passages, odd spaces, empty and long ones."""
    rng = random.Random(seed)
    passage = " ".join(rng.choices(WORDS, k=40))
    out = [None, "", " \n\t ", "one", "a b c d", "a b c d", "a  b c d e", "a b c d e"]
    while len(out) < n:
        kind = rng.random()
        if kind < 0.2 and len(out) > 12:
            out.append(rng.choice(out[8:]))
        elif kind < 0.5 and len(out) > 12:
            w = (rng.choice(out[8:]) or "").split()
            for _ in range(rng.randrange(4)):
                if w:
                    w[rng.randrange(len(w))] = rng.choice(WORDS)
            out.append(rng.choice([" ", "\n", "  "]).join(w))
        else:
            text = " ".join(f"{rng.choice(WORDS)}{rng.randrange(30)}" for _ in range(rng.choice([6, 20, 60, 300])))
            out.append(f"{text}\n{passage} {text[:20]}" if rng.random() < 0.3 else text)
    out.append(" ".join(f"w{i % 977}" for i in range(30000)))
    return out


def frame(spark, texts, ids=None):
    rows = [(i, t, "en", "s") for i, t in zip(range(len(texts)) if ids is None else ids, texts, strict=True)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("n_words", F.lit("clash")).repartition(5)


@pytest.mark.parametrize("how, pattern", [(textops.SPACED, SPACED), (textops.SPACED_LOWER, SPACED), (textops.ALNUM_LOWER, ALNUM)])
def test_split(how, pattern):
    texts = [*corpus(40), "A\x0bB\x1fC\x85D", "\x7fÀ", "Ab aB AB"]
    seen = {}
    for begin, end, data, offsets in textops.slices(pa.array(texts), 200):
        w = textops.split(data, offsets, how)
        for i in range(begin, end):
            mine = [data[a:b].tobytes().decode() for a, b in zip(w.start, w.end, strict=True)][w.first[i - begin] : w.first[i - begin + 1]]
            text = texts[i] or ""
            want = re.findall(pattern, lower(text) if pattern == ALNUM else text)
            assert [lower(x) if how is not textops.SPACED else x for x in mine] == [lower(x) if how is not textops.SPACED else x for x in want]
            for word, h in zip(mine, w.hash[w.first[i - begin] : w.first[i - begin + 1]], strict=True):
                assert seen.setdefault(word if how is textops.SPACED else lower(word), h) == h
    assert len(set(seen.values())) == len(seen)


def plain_links(texts, k=5, percent=80):
    sets = []
    for t in texts:
        w = re.findall(SPACED, lower(t or ""))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set()))
    links = {i: [j for j in range(len(texts)) if j != i and sets[i] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])] for i in range(len(texts))}
    least = list(range(len(texts)))
    for _ in texts:
        least = [min([least[i], *(least[j] for j in links[i])]) for i in range(len(texts))]
    return [(len(s), least[i], len(links[i])) for i, s in enumerate(sets)]


@pytest.mark.parametrize("hot, block", [(64, 1024), (1, 2)])
def test_ngram_join(spark, monkeypatch, hot, block):
    if block < 10:
        monkeypatch.setattr(ngram_join, "ELEMENTS", 300)
    texts = corpus(150, seed=hot)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["n_links"]) for r in ngram_join.ngram_join(frame(spark, texts), hot=hot, block=block, small=0 if hot == 1 else 10**6).collect()}
    assert got == dict(enumerate(plain_links(texts)))


def test_ngram_join_blocks_follow_percent(spark):
    """Sets 1.6 times as large link at 60 %, in blocks as in one."""
    words = [f"w{i}" for i in range(164)]
    texts = [" ".join(words[:n]) for n in (104, 164, 110, 150, 66)]
    want = plain_links(texts, percent=60)
    for block in (1024, 1):
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["n_links"]) for r in ngram_join.ngram_join(frame(spark, texts), percent=60, block=block).collect()}
        assert [got[i] for i in range(len(texts))] == want


def test_ngram_join_ids_and_first(spark):
    texts = ["a b c d e f", "a b c d e f", "A b c d e f", "x y", "x y", None, None]
    docs = frame(spark, texts, [None, 5, 5, 9, 9, None, 2])
    got = collections.Counter((r["doc_id"], r["component_id"], r["n_links"]) for r in ngram_join.ngram_join(docs).collect())
    assert got == {(None, 5, 2): 1, (5, 5, 2): 2, (9, 9, 1): 2, (None, None, 0): 1, (2, 2, 0): 1}
    kept = sorted((str(r["doc_id"]), str(r["text"]).lower()) for r in ngram_join.first_of_each(docs).collect())
    assert kept == [("2", "none"), ("5", "a b c d e f"), ("9", "x y"), ("None", "none")]
    assert ngram_join.ngram_join(docs.limit(0)).count() == 0 and ngram_join.first_of_each(docs.limit(0)).count() == 0


def test_ngram_join_null_ids_stay_linear(spark, monkeypatch):
    """Rows without an id are told apart by their texts: every text brings its own set only, equal rows one."""
    words = [f"w{i}" for i in range(60)]
    texts = [" ".join([*words, f"x{i % 500}"]) for i in range(2000)] + ["lone text of its own"] * 50
    docs = frame(spark, texts, [None] * 2000 + [7] * 50)
    seen = []
    monkeypatch.setattr(ngram_join, "cut", lambda df: seen.append(real := support.cut(df)) or real)
    got = collections.Counter(tuple(r) for r in ngram_join.ngram_join(docs).select("n_shingles", "component_id", "n_links").collect())
    assert got == {(57, None, 1999): 2000, (1, 7, 49): 50}
    assert max(df.count() for df in seen) <= 2050


def test_ngram_join_crowds(spark):
    """Thousands of near copies, of which each list gives too many pairs, among unlike texts with their passage."""
    rng = random.Random(3)
    passage = [f"p{i}" for i in range(80)]
    near = [" ".join([*passage[:k], f"x{rng.randrange(300)}", *passage[k:]]) for k in (rng.randrange(80) for _ in range(400))]
    unlike = [" ".join([*passage[:40], *(f"y{i}-{j}" for j in range(40))]) for i in range(60)]
    texts = near + unlike
    want = plain_links(texts)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["n_links"]) for r in ngram_join.ngram_join(frame(spark, texts), hot=8, block=64).collect()}
    assert [got[i] for i in range(len(texts))] == want


def test_meet_in_bounded_pieces(monkeypatch):
    """One shingle that very many groups hold: pieces of the output stay small, and no pair that could link is lost."""
    monkeypatch.setattr(ngram_join, "_CHUNK", 1000)
    rng = np.random.default_rng(4)
    n = 3000
    x = np.zeros(2 * n, ngram_join._POSTING)
    x["t"], x["g"] = np.repeat([5, 9], n), np.tile(np.arange(n), 2)
    size, place = rng.integers(20, 200, n), rng.integers(0, 40, 2 * n)
    x["n"], x["i"] = np.tile(size, 2), np.minimum(place, np.tile(size, 2) - 1)
    batch = pa.RecordBatch.from_arrays([pa.array([ngram_join.by_column(x)], pa.binary())], ["blob"])
    for hot in (10**6, 1):
        out = list(ngram_join._meet(80, hot)(iter([batch])))
        assert max(b.num_rows for b in out) <= 1000 + n
        edges = [(a, b) for o in out for a, b in zip(o.column("g1").to_pylist(), o.column("g2").to_pylist(), strict=True)]
        label = ngram_join.least_labels(n, *np.array(edges).T)
        rest = x["n"].astype(int) - x["i"]
        for t in (0, n):
            g, m, r = np.arange(n), size, rest[t : t + n]
            a, b = rng.integers(0, n, 4000), rng.integers(0, n, 4000)
            low, high = np.minimum(m[a], m[b]), np.maximum(m[a], m[b])
            could = (a != b) & (80 * high <= 100 * low) & (np.minimum(r[a], r[b]) >= -(-80 * (low + high) // 180))
            assert could.sum() > 50 and (label[g[a[could]]] == label[g[b[could]]]).all()
            if hot > 1:
                assert {tuple(sorted(e)) for e in zip(a[could].tolist(), b[could].tolist(), strict=True)} <= set(edges)


def test_pairs_share_enough_of_their_prefixes(spark, monkeypatch):
    """Unlike texts that share one rare shingle each with each are not verified; those that link share all that is asked for."""
    words = lambda name, n: " ".join(f"{name}{j}" for j in range(n))
    texts = [" ".join([words(f"a{i}x", 40), words("common", 5), words(f"b{i}x", 40)]) for i in range(40)]
    texts += [f"{words('near', 60)} {words(f'end{i}x', 1 + i % 3)}" for i in range(6)]
    seen = []
    tasks = ngram_join._tasks
    monkeypatch.setattr(ngram_join, "_tasks", lambda pairs: seen.append(pairs.count()) or tasks(pairs))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["n_links"]) for r in ngram_join.ngram_join(frame(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == plain_links(texts)
    assert seen == [15]
    rng = np.random.default_rng(5)
    for percent in (60, 80, 100):
        for _ in range(500):
            n = int(rng.integers(1, 150))
            m = int(rng.integers(n, 100 * n // percent + 1))
            both = int(ngram_join.least_overlap(np.array(n), np.array(m), percent))
            order = rng.permutation(n + m - both)
            a, b = (np.sort(x) for x in (order[:n], np.concatenate([order[:both], order[n:]])))
            shared = np.intersect1d(a, b)
            rest = np.minimum(n - np.searchsorted(a, shared), m - np.searchsorted(b, shared))
            least = int(ngram_join.least_rest(np.array(n), np.array(m), percent))
            assert (rest >= least).sum() >= both - least + 1 >= 1
            assert n - ngram_join.prefix_length(n, percent) < least and m - ngram_join.prefix_length(m, percent) < least


def test_shingles_of_one_token_lose_no_pair():
    """Shingles that agree in all bits sent are counted for each place, and no group meets itself."""
    x = np.zeros(4, ngram_join._POSTING)
    x["t"], x["g"], x["n"], x["i"] = 7, [1, 1, 2, 2], 50, [0, 3, 1, 2]
    batch = pa.RecordBatch.from_arrays([pa.array([ngram_join.by_column(x)], pa.binary())], ["blob"])
    (out,) = ngram_join._meet(80, 64)(iter([batch]))
    assert out.select(["g1", "g2", "crowd"]).to_pylist() == [{"g1": 1, "g2": 2, "crowd": False}] and out.column("shared").to_pylist()[0] >= 2


def test_postings_are_packed():
    rng = random.Random(6)
    texts = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(rng.randrange(200, 900))) for _ in range(300)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(300), pa.int64()), pa.array(texts), pa.array(range(300), pa.int64())], ["doc_id", "text", "text_hash"])
    rows = [r for b in ngram_join._index(5, 80, 2, np.zeros(0, np.uint64))(iter([batch])) for r in b.to_pylist()]
    sent = [r["blob"] for r in rows if r["kind"] == 0]
    postings = np.concatenate([ngram_join.from_columns(b, ngram_join._POSTING) for b in sent])
    sizes = [len(t.split()) - 4 for t in texts]
    assert sorted(postings["n"].tolist()) == sorted(n for n in sizes for _ in range(ngram_join.prefix_length(n, 80)))
    assert sum(map(len, sent)) < 14 * len(postings)


def test_least_labels():
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)]
    want = {n: n for n in range(300)} | _roots(edges)
    assert ngram_join.least_labels(300, *np.array(edges).T).tolist() == [want[n] for n in range(300)]
    assert ngram_join.least_labels(3, np.zeros(0, int), np.zeros(0, int)).tolist() == [0, 1, 2]


def test_prefix_lengths():
    """Sets that link share a shingle of their prefixes, at the least overlap."""
    for n in range(1, 60):
        for m in range(n, 80):
            need = -(-80 * (n + m) // 180)
            if need <= n and 80 * m <= 100 * n:
                assert need > n - ngram_join.prefix_length(n, 80) and need > m - ngram_join.prefix_length(m, 80)


def test_few_components_take_no_rounds(spark, monkeypatch):
    """A long path over several partitions is solved by one task: nothing is stored on the way."""
    order = random.Random(8).sample(range(3000), 3000)
    edges = spark.createDataFrame(list(zip(order, order[1:], strict=False)) + [(5000, 5001)], "a long, b long").repartition(7)
    cuts = []
    monkeypatch.setattr(support, "cut", lambda df: cuts.append(df) or df)
    got = {r["node"]: r["root"] for r in support.components(edges).collect()}
    assert got == dict.fromkeys(order, 0) | {5000: 5000, 5001: 5000} and not cuts


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 40) if i % 13] + [(100, 3), (50, 50), (7, 3)] + [(200, 200 + i) for i in range(1, 60)]
    for small in (500_000, 3):
        got = {r["node"]: r["root"] for r in support.components(spark.createDataFrame(edges, "a long, b long"), small=small).collect()}
        assert got == _roots(edges)
    assert support.components(spark.createDataFrame([], "a long, b long")).count() == 0


def _roots(edges):
    root = {n: n for e in edges for n in e if e[0] != e[1]}
    for _ in root:
        for a, b in edges:
            if a != b:
                root[a] = root[b] = min(root[a], root[b])
    return root


def plain_dedup(texts, ids, k=13):
    words = [re.findall(SPACED, t or "") for t in texts]
    first = {}
    for i, w in zip(ids, words, strict=True):
        for j in range(len(w) - k + 1):
            x = tuple(w[j : j + k])
            if i is not None:
                first[x] = min(first.get(x, i), i)
    out = []
    for i, w in zip(ids, words, strict=True):
        drop = set()
        for j in range(len(w) - k + 1):
            f = first.get(tuple(w[j : j + k]))
            if f is not None and (i is None or f < i):
                drop |= set(range(j, j + k))
        out.append((len(w), len(drop), " ".join(x for j, x in enumerate(w) if j not in drop)))
    return out


def test_substring_dedup(spark):
    texts = corpus(150)
    ids = [None if i % 17 == 3 else 200 - i // 2 for i in range(len(texts))]  # null and shared ids
    got = collections.Counter(tuple(r) for r in substring_dedup.substring_dedup(frame(spark, texts, ids)).collect())
    assert got == collections.Counter((i, *x) for i, x in zip(ids, plain_dedup(texts, ids), strict=True))
    assert substring_dedup.substring_dedup(frame(spark, [])).count() == 0


def test_dedup_by_batches(spark):
    """Batches against a compacted index give the result of the whole."""
    texts = corpus(120, seed=3)
    whole = plain_dedup(texts, list(range(len(texts))))
    index, got = None, {}
    for part in (range(0, 50), range(50, 90), range(90, len(texts))):
        docs = frame(spark, [texts[i] for i in part], list(part))
        got |= {r["doc_id"]: tuple(r)[1:] for r in substring_dedup.substring_dedup(docs, previous=index, buckets=6).collect()}
        new = substring_dedup.fingerprints(docs, buckets=6)
        index = support.cut(substring_dedup.compact(new if index is None else index.unionByName(new)))
    assert [got[i] for i in range(len(texts))] == whole


def test_pack():
    rng = np.random.default_rng(1)
    for values in (np.zeros(0, np.uint64), np.array([5], np.uint64), np.unique(rng.integers(0, 2**63, 1000).astype(np.uint64)), np.array([0, 2**64 - 1], np.uint64)):
        tags = (values & np.uint64(0xFFFFFF)).astype(np.uint32)
        a, b = substring_dedup.unpack(substring_dedup.pack(values, tags))
        assert (a == values).all() and (b == tags).all()


def plain_hits(texts, items, k=13):
    windows = collections.defaultdict(set)
    for name, t in items:
        w = re.findall(ALNUM, lower(t or ""))
        n = min(k, len(w))
        for i in range(len(w) - n + 1 if n and name is not None else 0):
            windows[tuple(w[i : i + n])].add(str(name))
    out = []
    for t in texts:
        w = re.findall(ALNUM, lower(t or ""))
        hit, found = set(), set()
        for n in {len(x) for x in windows}:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in windows:
                    hit |= set(range(i, i + n))
                    found |= windows[tuple(w[i : i + n])]
        out.append((len(w), len(hit), sorted(found), len(hit) > 0 and 20 * len(hit) >= len(w)))
    return out


@pytest.mark.parametrize("limits", [(1 << 21, 2_000_000), (200, 40)])
def test_decontaminate(spark, monkeypatch, limits):
    for name, value in zip(("SEGMENT", "QUERY_WORDS"), limits, strict=True):
        monkeypatch.setattr(dc, name, value)
    texts = corpus(100)
    items = [(i, " ".join((texts[j] or "").split()[:n]).upper()) for i, (j, n) in enumerate([(20, 13), (30, 40), (40, 5), (50, 14), (60, 200), (3, 1), (1, 3)])] + [(10, None), (None, "a b"), (2, "b C d")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = dc.decontaminate(frame(spark, texts), bench).collect()
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["items"], r["contaminated"]) for r in rows}
    assert got == dict(enumerate(plain_hits(texts, items)))
    kept = {r["doc_id"] for r in dc.without_contaminated(frame(spark, texts), bench).collect()}
    assert kept == {i for i, x in got.items() if not x[3]}
    assert dc.decontaminate(frame(spark, []), bench).count() == 0
    assert dc.decontaminate(frame(spark, texts), bench.limit(0)).where("n_hit > 0 or contaminated").count() == 0


def test_an_index_serves_any_benchmark(spark):
    """The stored index holds all terms, so it is searched for items that nobody knew when it was built."""
    texts = corpus(60)
    index = dc.build_index(frame(spark, texts))
    for j in (20, 33):
        items = [("7", re.findall(ALNUM, lower(texts[j] or ""))[:30])]
        hashed = dc._hashed([{"item": "7", "text": " ".join(items[0][1])}])
        rows = index.mapInArrow(dc._search(hashed, 13, None), dc.HITS).collect()
        want = plain_hits(texts, [("7", " ".join(items[0][1]))])
        assert {r["doc_id"]: r["items"] for r in rows} == {i: w[2] for i, w in enumerate(want)} and any(w[2] for w in want)


def test_proximity(spark):
    docs = frame(spark, ["alpha x x beta", "beta y alpha", "alpha x x x x x beta", "alpha", "beta"])
    bench = spark.createDataFrame([(1, "alpha beta")], "item_id long, text string")
    got = {r["doc_id"]: r["n_hit"] for r in dc.decontaminate(docs, bench, within=3).collect()}
    assert got == {0: 1, 1: 1, 2: 0, 3: 0, 4: 0}


def test_quality_counts(spark):
    texts = [*corpus(80), "# * |x|\n\nsame line\nsame line\n same line\n" * 3, "a b c d e f g h " * 9]
    rows = {r["doc_id"]: r for r in quality_rules.statistics(frame(spark, texts)).collect()}
    for i, t in enumerate(texts):
        t = t or ""
        w = re.findall(SPACED, t)
        seen, dup = set(), 0
        for line in t.split("\n"):
            if re.search(SPACED, line):
                dup += line in seen
                seen.add(line)
        c = collections.Counter(tuple(w[j : j + 8]) for j in range(len(w) - 7))
        again = {x for j in range(len(w) - 7) if c[tuple(w[j : j + 8])] > 1 for x in range(j, j + 8)}
        r = rows[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (len(w), sum(map(len, w)), sum(t.count(x) for x in "#*$%&|<>"), dup, len(again))
        assert r["base_failed"] == (len(w) < 20 or 100 * len(again) > 30 * len(w))


def test_robust_outliers(spark):
    """Outliers are found although they are many, and groups are judged by their own."""
    rng = random.Random(5)
    short = [" ".join("abcdefgh"[: rng.randrange(3, 8)] + str(rng.randrange(10**6)) for _ in range(rng.randrange(60, 140))) for _ in range(300)]
    symbols = [" ".join(f"{w} | # $ % &" for w in t.split()) for t in short[:60]]
    rows = [(i, t, "en", "s") for i, t in enumerate(short + symbols)] + [(1000 + i, t, None, "other") for i, t in enumerate(symbols)] + [(5000, None, None, None), (5001, short[0], "xx", "rare")]
    got = {r["doc_id"]: r for r in quality_rules.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert len(got) == len(rows) and not got[5000]["kept"] and got[5001]["kept"]
    assert sum(got[i]["kept"] for i in range(300)) >= 299
    assert not any(got[300 + i]["kept"] for i in range(60)) and sum(got[1000 + i]["kept"] for i in range(60)) >= 58
    few = quality_rules.quality_rules(spark.createDataFrame(rows[:5], "doc_id long, text string, lang string, source string"))
    assert all(r["kept"] for r in few.collect())
    assert quality_rules.quality_rules(spark.createDataFrame([], "doc_id long, text string, lang string, source string")).count() == 0


def plain_mcd(x, floors, rng, keep=0.75, starts=30):
    """Minimum covariance determinant from random starts, each until nothing changes, and one reweighting."""
    n, d = x.shape
    best = None
    for _ in range(starts):
        inside = rng.choice(n, d + 2, replace=False)
        for _ in range(100):
            mean, cov = x[inside].mean(0), np.cov(x[inside].T, bias=True) + np.diag(floors**2)
            far = np.einsum("ij,jk,ik->i", x - mean, np.linalg.inv(cov), x - mean)
            new = np.sort(np.argsort(far, kind="stable")[: int(np.ceil(keep * n))])
            if len(new) == len(inside) and (new == inside).all():
                break
            inside = new
        size = np.linalg.slogdet(np.cov(x[inside].T, bias=True) + np.diag(floors**2))[1]
        if best is None or size < best[0]:
            best = (size, inside)
    q = quality_rules.chi2_quantile
    spread = keep / quality_rules.chi2_cdf(q(keep, d), d + 2)
    mean, cov = x[best[1]].mean(0), np.cov(x[best[1]].T, bias=True) * spread + np.diag(floors**2)
    far = np.einsum("ij,jk,ik->i", x - mean, np.linalg.inv(cov), x - mean)
    near = x[far <= q(0.975, d)]
    spread = 0.975 / quality_rules.chi2_cdf(q(0.975, d), d + 2)
    mean, cov = near.mean(0), np.cov(near.T, bias=True) * spread + np.diag(floors**2)
    return np.einsum("ij,jk,ik->i", x - mean, np.linalg.inv(cov), x - mean)


def test_robust_outliers_agree_with_a_plain_mcd(spark):
    """Verdicts of one group of 1000 with 150 planted outliers are those of the plain estimate, but for a few at the cut."""
    rng = random.Random(15)
    word = lambda: "abcdefghijkl"[: rng.randrange(2, 9)].capitalize() if rng.random() < 0.1 else "abcdefghijkl"[: rng.randrange(2, 9)] + str(rng.randrange(10**4))
    usual = [" ".join(word() for _ in range(int(rng.lognormvariate(4.5, 0.4)) + 20)) for _ in range(850)]
    planted = [t.upper() for t in usual[:50]] + [" ".join(f"{w} #$ |" for w in t.split()) for t in usual[50:100]] + ["\n".join([t] * 3 + usual[200 + i : 210 + i]) for i, t in enumerate(usual[100:150])]
    docs = spark.createDataFrame([(i, t, "en", "s") for i, t in enumerate(usual + planted)], "doc_id long, text string, lang string, source string")
    kept = {r["doc_id"]: r["kept"] for r in quality_rules.quality_rules(docs).collect()}
    rows = quality_rules.statistics(docs).where("not base_failed").selectExpr("doc_id", *(f"{e} as {x}" for x, (e, _) in quality_rules.FEATURES.items())).toPandas()
    far = plain_mcd(rows[list(quality_rules.FEATURES)].to_numpy(), np.array([f for _, f in quality_rules.FEATURES.values()]), np.random.default_rng(1))
    plain = dict(zip(rows["doc_id"], far <= quality_rules.chi2_quantile(0.999, 6), strict=True))
    assert sum(kept[i] == plain[i] for i in plain) >= 0.99 * len(plain)
    assert sum(kept[i] for i in range(850, 950)) == 0 and sum(kept[i] for i in range(850)) >= 840


def test_quality_rules_ties_and_hot_groups(spark, monkeypatch):
    """Rows that are all alike are all kept; tables by group that are not broadcast give the same verdicts."""
    rng = random.Random(16)
    line = " ".join(f"w{i}" for i in range(30))
    rows = [(i, line, "en", "s") for i in range(120)] + [(200 + i, " ".join(f"v{rng.randrange(99)}" for _ in range(rng.randrange(25, 90))), "en", f"s{i % 3}") for i in range(300)] + [(900, line + " #" * 30, "en", "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("distance", F.lit("clash")).withColumn("g", F.lit("clash"))
    got = {r["doc_id"]: (r["kept"], r["distance"]) for r in quality_rules.quality_rules(docs).collect()}
    assert len({got[i] for i in range(120)}) == 1 and got[0][0] and not got[900][0]
    monkeypatch.setattr(quality_rules, "GROUPS", 0)
    again = {r["doc_id"]: (r["kept"], r["distance"]) for r in quality_rules.quality_rules(docs.repartition(9)).collect()}
    assert all(got[i][0] == again[i][0] and got[i][1] == pytest.approx(again[i][1]) for i in got)


def test_repeats_are_outliers(spark):
    """Repeated lines and passages count under the base rule's limit; one repeated line does not."""
    rng = random.Random(7)
    line = lambda: " ".join("abcdefgh"[: rng.randrange(3, 8)] + str(rng.randrange(10**6)) for _ in range(5))
    usual = [[line() for _ in range(20)] for _ in range(300)]
    lines = [[x for pair in zip(u[:12], [u[0]] * 12, strict=True) for x in pair] for u in usual[:15]]
    passage = [[*u, " ".join(" ".join(u).split()[:14])] for u in usual[15:30]]
    once = [u[:19] + u[:1] for u in usual[30:45]]
    rows = [(i, "\n".join(t), "en", "s") for i, t in enumerate(usual + lines + passage + once)]
    got = {r["doc_id"]: r for r in quality_rules.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert not any(got[i]["base_failed"] for i in got)
    assert not any(got[i]["kept"] for i in range(300, 330))
    assert sum(got[i]["kept"] for i in range(300)) >= 298 and all(got[i]["kept"] for i in range(330, 345))


def test_chi2():
    assert quality_rules.chi2_quantile(0.975, 6) == pytest.approx(14.4494, abs=1e-3)
    assert quality_rules.chi2_cdf(5.3481, 6) == pytest.approx(0.5, abs=1e-4)


def test_language(spark):
    rng = random.Random(6)
    syllables = {"aa": ["the", "ing", "ou", "and"], "bb": ["sch", "ung", "ein", "der"], "cc": ["ció", "que", "los", "ñ"]}
    def text(lang):
        return " ".join("".join(rng.choices(syllables[lang], k=rng.randrange(1, 4))) for _ in range(30))
    rows = [(i, text(lang), lang, "s") for i, lang in enumerate("aa bb cc aa".split() * 60)] + [(900, None, "aa", "s"), (901, "12 %", "aa", "s"), (902, "", None, "s"), (903, "ß", "aa", "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("score", F.lit("clash"))
    dictionaries = language_id.learn(docs.where(language_id.fold(5) != 0))
    assert list(dictionaries) == ["aa", "bb", "cc"]
    got = {r["doc_id"]: r for r in language_id.language_id(docs, dictionaries).collect()}
    held = [r for r in rows[:240] if zlib.crc32(str(r[0]).encode()) % 5 == 0]
    assert len(held) > 20 and all(got[r[0]]["lang_pred"] == r[2] and not got[r[0]]["rejected"] for r in held)
    assert [(got[i]["lang_pred"], got[i]["rejected"]) for i in (900, 901, 902)] == [("und", True)] * 3 and got[903]["lang_pred"] != "und"
    assert all(0 <= r["score"] <= 1 for r in got.values())
    none = language_id.language_id(docs, {}).first()
    assert (none["lang_pred"], none["rejected"]) == ("und", True)
    assert language_id.language_id(docs.limit(0), dictionaries).count() == 0 and language_id.learn(docs.limit(0)) == {}


def test_language_learns_from_whole_texts(spark):
    """Texts that open with one long shared passage are learned from beyond it."""
    rows = [(i, "shared opening " * 120 + " ".join(f"unique{chr(97 + i)}{chr(97 + j)}" for j in range(20)) * 10 + " last", "aa") for i in range(20)] + [(90, "short", "bb")]
    learned = language_id.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert b"unique" in learned["aa"] and b"last" in learned["aa"] and learned["bb"] == b"short"
    assert len(learned["aa"]) <= 20 * (1500 + language_id.PIECES)


def test_language_margin(spark):
    """Texts half in one language and half in another are rejected, though one half is a little shorter when packed."""
    rng = random.Random(8)
    other = str.maketrans("abcdefghij", "klmnopqrst")
    text = lambda n: " ".join("".join(rng.choices(["abc", "ed", "fghi", "jac"], k=rng.randrange(1, 4))) for _ in range(n))
    learned = [(i, text(40) if i % 2 else text(40).translate(other), "ab"[i % 2]) for i in range(160)]
    docs = [x for t in [text(200) for _ in range(40)] for x in (f"{t} {t.translate(other)}", t)]
    dictionaries = language_id.learn(spark.createDataFrame(learned, "doc_id long, text string, lang string"))
    got = {r["doc_id"]: r["rejected"] for r in language_id.language_id(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string"), dictionaries).collect()}
    assert sum(got[i] for i in range(0, 80, 2)) >= 36, sum(got[i] for i in range(0, 80, 2))
    assert not any(got[i] for i in range(1, 80, 2))


def plain_machine(machine, texts):
    """Scores by the definition of a factorization machine: bias, weights and products of all pairs, one by one."""
    out = []
    for t in texts:
        terms = sorted({int(x) for _, _, ts in toxicity.text_terms(pa.array([t], pa.string())) for x in ts})
        held = [int(np.searchsorted(machine.bins, x)) for x in terms if x in set(machine.bins.tolist())]
        total = machine.bias + sum(machine.weight[i] for i in held)
        total += sum(float(machine.factor[i] @ machine.factor[j]) for a, i in enumerate(held) for j in held[:a])
        out.append(1 / (1 + np.exp(-total)))
    return out


def _exclusive(seed, n):
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        a, b = rng.random() < 0.5, rng.random() < 0.5
        words = rng.choices(["plain", "talk", "about", "nothing", "much"], k=12) + ["grumble"] * a + ["people"] * b
        rng.shuffle(words)
        rows.append((i, " ".join(words), "en", "s"))
        labels.append((i, None, int(a != b)))
    return rows, labels


def test_toxicity_learns_pairs(spark):
    """Either word alone is toxic and both together are not, which no sum of weights can tell."""
    rows, labels = _exclusive(8, 1600)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumns({"score": F.lit("clash"), "predicted": F.lit("clash")})
    labelled = spark.createDataFrame([*labels, (3, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    sample = lambda d: learning.labelled_sample(d.where("doc_id < 1200"), labelled, "toxic", 1000)
    machine = toxicity.train(sample(docs), epochs=60)
    again = toxicity.train(sample(docs.repartition(7)), epochs=60)
    assert (machine.weight == again.weight).all() and (machine.factor == again.factor).all()
    more = docs.unionByName(spark.createDataFrame([(None, None, None, None), (9000, "", None, None), (9001, "grumble " * 400_000, None, None)], "doc_id long, text string, lang string, source string"), allowMissingColumns=True)
    got = {r["doc_id"]: r for r in toxicity.toxicity(more, machine).collect()}
    right = lambda by: sum(by[i] == labels[i][2] for i in range(1200, 1600))
    assert right({i: r["predicted"] for i, r in got.items()}) >= 390 and got[None]["predicted"] in (0, 1) and 0 <= got[9000]["score"] <= 1 and got[9001]["predicted"] == 1
    additive = toxicity.train(sample(docs), factors=0, epochs=60)
    plain = {r["doc_id"]: r["predicted"] for r in toxicity.toxicity(docs, additive).collect()}
    assert right(plain) <= 320
    some = [r[1] for r in rows[1200:1230]]
    assert [got[1200 + i]["score"] for i in range(30)] == pytest.approx(plain_machine(machine, some), abs=1e-9)
    empty = toxicity.train(learning.labelled_sample(docs.limit(0), labelled, "toxic", 500))
    assert {r["predicted"] for r in toxicity.toxicity(docs.limit(3), empty).collect()} == {0}
    assert toxicity.toxicity(docs.limit(0), machine).count() == 0


def test_samples_are_bounded_by_rows(spark):
    """An id that very many rows share, alike or not, brings no more rows than asked for."""
    rows = [(1, "same")] * 500 + [(2, f"text {i}") for i in range(500)] + [(3, "three"), (4, None), (None, "none")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 1), (3, 0), (4, 0), (None, 1), (5, 1)], "doc_id long, toxic int")
    got = collections.Counter(tuple(r) for r in learning.labelled_sample(docs, labels, "toxic", 10).collect())
    assert sum(n for (_, y), n in got.items() if y == 1) == 10 and got[("three", 0)] == 1 and max(got.values()) == 1
    assert got == collections.Counter(tuple(r) for r in learning.labelled_sample(docs.repartition(3), labels, "toxic", 10).collect())


def plain_language(text, dictionaries, margin=0.05):
    letters = language_id.normal(text)
    if not letters:
        return "und", True
    sizes = {}
    for name, content in dictionaries.items():
        d = zstandard.ZstdCompressionDict(b" " * 8 + content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        sizes[name] = sum(len(zstandard.ZstdCompressor(level=9, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False).compress(letters[i : i + 4096])) for i in range(0, len(letters), 4096))
    first = min(sizes, key=lambda n: (sizes[n], list(sizes).index(n)))
    others = [v for n, v in sizes.items() if n != first]
    return first, bool(others) and (min(others) <= sizes[first] or min(others) < sizes[first] * (1 + margin))


def test_language_agrees_with_plain_zstandard(spark):
    """Texts of many chunks, repeated rows, and ties between dictionaries."""
    rng = random.Random(12)
    text = lambda k, n: " ".join("".join(rng.choices(k, k=rng.randrange(1, 4))) for _ in range(n))
    kinds = {"aa": ["the", "ing", "ou"], "bb": ["sch", "ung", "ein"]}
    learned = [(i, text(kinds[k], 40), k) for i, k in enumerate(["aa", "bb", "aa"] * 40)]
    dictionaries = language_id.learn(spark.createDataFrame(learned, "doc_id long, text string, lang string"))
    dictionaries["twin"] = dictionaries["aa"]  # a tie: the first wins, and is rejected
    texts = [text(kinds["bb"], 9000), text(kinds["aa"], 4000) + text(kinds["bb"], 4000), *[text(kinds["bb"], 30)] * 3, text(kinds["aa"], 30), "a", "", "1 2 3", "schung " * 50_000]
    got = [(r["lang_pred"], r["rejected"]) for r in language_id.language_id(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), dictionaries).orderBy("doc_id").collect()]
    assert got == [plain_language(t, dictionaries) for t in texts]
    assert got[0] == ("bb", False) and got[5] == ("aa", True) and len(set(got[2:5])) == 1
    few = language_id.learn(spark.createDataFrame(learned, "doc_id long, text string, lang string"), languages=1)
    assert list(few) == ["aa"]


def test_neighbours(spark):
    rng = random.Random(9)
    good = lambda: " ".join(rng.choice(WORDS) for _ in range(40)) + "."
    rows = [(i, good() if i % 2 else " ".join([rng.choice(WORDS)] * 40), "en", "s") for i in range(400)] + [(900, None, None, None), (901, "", None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(400)], "doc_id long, quality int, toxic int")
    space = nq.learn(learning.labelled_sample(docs.where("doc_id < 300"), labels, "quality", 200))
    got = {r["doc_id"]: r for r in nq.quality(docs, space).collect()}
    assert sum(got[i]["predicted"] == i % 2 for i in range(300, 400)) >= 97 and got[900]["score"] == got[901]["score"] == 0
    tf = np.concatenate([x for _, x in nq.term_counts(pa.array([r[1] for r in rows[300:310]]))])
    x = nq._unit(nq._weighted(tf, space.idf) @ space.project) @ space.vectors.T
    for i, row in enumerate(x):  # the exact vote
        top = np.argsort(-row, kind="stable")[:25]
        w = np.maximum(row[top], 1e-9) ** 8
        assert got[300 + i]["score"] == pytest.approx((w * space.y[top]).sum() / w.sum(), abs=1e-4)
    none = nq.learn(learning.labelled_sample(docs.limit(0), labels, "quality", 200))
    assert {r["score"] for r in nq.quality(docs.limit(3), none).collect()} == {0.0} and nq.quality(docs.limit(0), space).count() == 0
