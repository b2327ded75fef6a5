"""Each stage of the pipeline on its own, and the whole of it."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from coppice.llm import jaccard_join, pii
from coppice.llm.mixing import word_count

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [
        (1, "The cat sat on the mat and looked at the dog near the old house", "en", "a", 1),
        (2, "The cat sat on the mat and looked at the dog near the old house", "en", "b", 1),
        (3, None, "en", "a", None),
        (4, "", None, None, 0),
        (5, "12 34", "en", "a", 5),
        (6, "Write to amy@corp.com about the card 4111 1111 1111 1111 please", "en", "b", 2),
        (7, "Der Hund lief in das alte Haus und suchte dort die Katze", "de", None, 3),
        (None, "A text without an id that should stay in the corpus", "en", "a", 4),
    ]
    return spark.createDataFrame(rows, SCHEMA).withColumn("size", F.lit(1)).withColumn("key", F.lit("k"))


def stage(name):
    return dict(corpus_pipeline.STAGES)[name]


def test_stages_and_columns(spark, docs):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_duplicates", "personal_data", "source_mixture", "sentencepiece"]
    for name, f in corpus_pipeline.STAGES:
        out = f(spark, docs, SF)
        if name != "sentencepiece":
            assert out.columns == corpus_pipeline.COLUMNS, name
        assert f(spark, docs.filter("doc_id < 0"), SF).count() == 0, name


def test_language_stage_drops_only_letterless(spark, docs):
    ids = {r[0] for r in stage("language_id")(spark, docs, SF).select("doc_id").collect()}
    assert ids == {1, 2, 6, 7, None}


def test_near_duplicate_stage(spark, docs):
    rows = stage("near_duplicates")(spark, docs.union(docs.filter("doc_id = 6")), SF).select("doc_id").collect()
    assert sorted(r[0] or -1 for r in rows) == [-1, 1, 3, 4, 5, 6, 7]


def test_personal_data_stage(spark, docs):
    out = {r["doc_id"]: r for r in stage("personal_data")(spark, docs, SF).collect()}
    assert out[6]["text"] == "Write to [EMAIL] about the card [CARD] please" and out[6]["n_chars"] == len(out[6]["text"])
    assert out[1]["text"].startswith("The cat") and len(out) == 8 and out[3]["text"] == ""


def test_mixture_stage_keeps_budgets(spark, docs):
    before = docs.agg(F.sum(word_count(F.col("text")))).first()[0]
    after = stage("source_mixture")(spark, docs, SF)
    assert abs(after.agg(F.sum(word_count(F.col("text")))).first()[0] - before) <= 3
    assert after.filter("doc_id in (3, 4)").count() == 0


def test_whole_pipeline(spark):
    out = corpus_pipeline.run(spark, SF).cache()
    assert {"doc_id", "ids", "n_tokens"} <= set(out.columns) and out.filter("n_tokens = 0").count() == 0
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = jaccard_join.ngram_jaccard_join(docs).filter("kept").select("doc_id")
    assert out.select("doc_id").distinct().join(kept, "doc_id", "left_anti").count() == 0
    assert pii.pii_report(docs).filter("n_email > 0").count() > 0
