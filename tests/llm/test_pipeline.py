"""The pipeline's stages and the SQL of the text queries."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from test_pairs import near

from lodestone.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_matches_sql(spark, name):
    from oracle import both

    got, want = both(spark, SF, queries.queries()[name], queries.oracle_sql()[name])
    assert got == want


def test_pipeline(spark):
    from lodestone.llm import mixing
    from lodestone.llm.common import saved

    docs, seen = spark.read.parquet(f"{SF}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, saved(stage(spark, docs, SF), name)
        seen[name] = (before, docs)
        if name != "sentencepiece":
            assert docs.columns == list(corpus_pipeline.COLUMNS)
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    before, after = seen["toxicity"]
    clean = before.join(labels.where("toxic = 0"), "doc_id", "left_semi")
    assert clean.join(after, "doc_id", "left_semi").count() >= 0.97 * clean.count()
    before, after = seen["near_dedup"]
    want = near([(r["doc_id"], r["text"]) for r in before.collect()], 5)
    assert {r["doc_id"] for r in after.collect()} == {i for i, (_, _, kept) in want.items() if kept}
    before, after = seen["substring_dedup"]
    assert after.count() == before.count()
    before, after = seen["mixing"]
    words = mixing.word_count(F.col("text"))
    total = before.agg(F.sum(words).alias("n")).first()["n"]
    assert abs(after.agg(F.sum(words).alias("n")).first()["n"] - 1.5 * total) <= 0.02 * total + 40 * 128
    assert seen["sentencepiece"][1].where("n_tokens != size(ids)").isEmpty()
