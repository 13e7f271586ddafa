"""The corpus pipeline and the registered queries."""

import collections
import zlib

import duckdb
import pytest

import corpus_pipeline
from cellweave.llm import chat_format, decontaminate, language_id, mixing, ngram_join, pii, queries

SMALL, LARGER = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


def test_stages():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "ngram_join", "decontaminate", "pii", "mixing"]
    assert {n.split("_")[0] for n in queries.queries()} == {f"op{i}" for i in range(1, 11)}
    assert set(queries.oracle_sql()) <= set(queries.queries()) and chat_format.CHAT_SQL in queries.oracle_sql().values()


@pytest.mark.parametrize("name", queries.oracle_sql())
def test_queries_agree_with_sql(spark, name):
    with duckdb.connect() as db:
        for t in ("documents", "benchmark", "conversations"):
            db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
        want = db.sql(queries.oracle_sql()[name]).df()
    got = queries.queries()[name](spark, SMALL).toPandas()
    assert sorted(got.columns) == sorted(want.columns)
    assert collections.Counter(got[want.columns].itertuples(index=False, name=None)) == collections.Counter(want.itertuples(index=False, name=None))


@pytest.mark.parametrize(("name", "label", "caught", "kept"), [("op1_toxicity", "toxic", 0.6, 0.98), ("op5_neighbour_quality", "quality", 0.95, 0.95)])
def test_held_out_labels(spark, name, label, caught, kept):
    """Labelled documents that nothing was learned from: shares of either class that are told right."""
    got = queries.queries()[name](spark, LARGER)
    assert got.columns == ["doc_id", "held_out", "score", "predicted"]
    labels = spark.read.parquet(f"{LARGER}/labels.parquet").select("doc_id", label).where(f"{label} is not null")
    rows = got.where("held_out").join(labels, "doc_id").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % {"toxic": 5, "quality": 3}[label] == {"toxic": 0, "quality": 1}[label]) for r in rows)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in rows)
    for y, least in ((1, caught), (0, kept)):
        of = [r["predicted"] == y for r in rows if r[label] == y]
        assert of and sum(of) >= least * len(of), (y, sum(of), len(of))


def test_held_out_languages(spark):
    rows = queries.op6_language_id(spark, LARGER).where("held_out").join(spark.read.parquet(f"{LARGER}/documents.parquet").select("doc_id", "lang"), "doc_id").where("lang is not null and lang_pred <> 'und'").collect()
    assert len(rows) > 100 and sum(r["lang"] == r["lang_pred"] for r in rows) >= 0.98 * len(rows)


def test_pipeline_agrees_with_a_plain_one(spark):
    got = collections.Counter((r["doc_id"], r["text"], r["size"], r["taken"]) for r in corpus_pipeline.run(spark, SMALL).collect())
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns = docs.columns
    bench = spark.read.parquet(f"{SMALL}/benchmark.parquet")
    kept = language_id.language_id(docs, language_id.learn(docs)).where("not rejected").toPandas()[columns]
    from .test_texts import plain_hits, plain_links

    rows = sorted(kept.itertuples(index=False), key=lambda r: r.doc_id)
    links = plain_links([r.text for r in rows])
    rows = [r for i, r in enumerate(rows) if links[i][1] == i]
    hits = plain_hits([r.text for r in rows], [tuple(r) for r in bench.select("item_id", "text").collect()])
    rows = [r for r, h in zip(rows, hits, strict=True) if not h[3]]
    assert 20 < len(rows) < len(kept)
    rest = mixing.mix(pii.pseudonymise(spark.createDataFrame([tuple(r) for r in rows], docs.schema), pii.key_of(spark)).select(*columns)).where("taken > 0")
    assert got == collections.Counter((r["doc_id"], r["text"], r["size"], r["taken"]) for r in rest.collect())


def test_stages_keep_columns_and_survive_an_empty_table(spark, tmp_path):
    empty = spark.read.parquet(f"{SMALL}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, empty, SMALL)
        assert out.count() == 0 and out.columns[:5] == empty.columns, name
    odd = spark.createDataFrame([(None, None, None, None, None), (1, None, "en", None, 3), (1, "a b", None, "s", None), (1, "a b", None, "s", None)], empty.schema)
    for name, stage in corpus_pipeline.STAGES[1:]:
        assert stage(spark, odd, SMALL).count() <= 4, name
    assert decontaminate.without_contaminated(odd, empty.selectExpr("doc_id item_id", "text")).count() == 4
    assert ngram_join.first_of_each(odd).count() == 3
