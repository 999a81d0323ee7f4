"""Stages of the pipeline on null and repeated ids."""
from collections import Counter

import corpus_pipeline
from tidegauge.llm import toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], SCHEMA)


def found(df):
    return Counter((r.doc_id, r.text) for r in df.collect())


def words(a, b):
    return " ".join(f"word{i}" for i in range(a, b))


def test_toxicity_by_row(spark, monkeypatch, tmp_path):
    def scores(docs, labels, carry=()):
        return docs.selectExpr("doc_id", "cast(text like 'bad%' as int) as predicted", *carry)
    monkeypatch.setattr(toxicity, "toxicity_scores", scores)
    spark.createDataFrame([(1, 1)], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = table(spark, [(1, "bad one", "a"), (1, "good one", "a"), (None, "bad two", "a"), (None, "good two", "a"), (2, None, "a"), (3, "good", "a"), (3, "good", "a")])
    assert found(corpus_pipeline.toxicity(spark, docs, str(tmp_path))) == Counter([(1, "good one"), (None, "good two"), (2, None), (3, "good"), (3, "good")])


def test_toxicity_carries_columns(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    got = toxicity.toxicity_scores(docs, labels, carry=["source"])
    want = toxicity.toxicity_scores(docs, labels)
    assert Counter((r.doc_id, r.predicted) for r in got.collect()) == Counter((r.doc_id, r.predicted) for r in want.collect())
    assert Counter((r.doc_id, r.source) for r in got.collect()) == Counter((r.doc_id, r.source) for r in docs.collect())


def test_one_row_of_a_repeated_document(spark):
    docs = table(spark, [(1, words(0, 40), "a"), (1, words(0, 40), "b"), (1, "a", "a"), (2, words(0, 40), "a"), (3, words(50, 90), "a"), (None, words(0, 40), "a"), (None, None, "a")])
    assert found(corpus_pipeline.ngram_jaccard_join(spark, docs, None)) == Counter(
        [(1, words(0, 40)), (3, words(50, 90)), (None, words(0, 40)), (None, None)])


def test_repeats_are_cut_once_a_row(spark):
    a, b = words(0, 30), words(100, 130)
    docs = table(spark, [(1, a, "a"), (1, a, "a"), (1, b, "a"), (2, a, "a"), (3, None, "a"), (3, "", "a"), (None, a, "a"), (None, a, "a")])
    assert found(corpus_pipeline.suffix_array_dedup(spark, docs, None)) == Counter(
        [(1, a), (1, a), (1, b), (3, None), (3, ""), (None, a), (None, a)])


def test_mix_draws_rows(spark):
    docs = table(spark, [(1, "x y", "a"), (1, "y z", "a"), (1, "x y", "a"), (None, "u v", "a"), (None, "u w", "a"), (2, "k", "a")])
    assert found(corpus_pipeline.mixing(spark, docs, None)) == found(docs)     # one source is drawn once


def test_run_keeps_null_ids(spark, tmp_path):
    docs = table(spark, [(1, words(0, 40), "a"), (1, words(0, 40), "a"), (2, words(50, 90), "a"), (None, words(200, 240), "a"), (None, words(300, 340), "a")])
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    got = Counter(r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect())
    assert got == Counter([1, 2, None, None])
