"""A training corpus from documents in five stages, each written as Parquet and read again for the next.

Texts that the toxicity classifier rejects go; of each group of near-duplicates
the document with the smallest id stays; word runs that repeat lose their words;
sources are mixed to target weights; the mixed texts are encoded.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import minhash, mixing, sentencepiece_codec, substring_dedup, toxicity
from lodestone.llm.common import saved, table
from lodestone.llm.queries import PIECE_MODEL

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the threshold; the classifier learns from the labelled ones among them."""
    config = toxicity.ToxicityConfig()
    model = toxicity.fit(docs.select("doc_id", "text"), table(spark, sf_dir, "labels"), F.lit(True), config)
    scored = toxicity.score(docs, model, config, keep=COLUMNS)
    return scored.where(F.col("score") < config.threshold).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts that are linked by a similarity of 0.8 on five-word shingles."""
    found = minhash.near_duplicates(docs.select("doc_id", "text"), minhash.MinHashConfig())
    gone = saved(found.where(~F.col("kept")).select("doc_id").distinct(), "gone")
    return docs.join(gone, "doc_id", "left_anti").select(*COLUMNS)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the words of 35-word runs that occur more than once; untouched texts stay as they are."""
    out = substring_dedup.remove_repeats(docs.select(*COLUMNS), keep=("lang", "source"), texts=True)
    return out.select("doc_id", "text", "rest.lang", "rest.source", F.length("text").cast("long").alias("n_chars"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as the mix takes them: whole, in part, or repeated."""
    return mixing.mix_documents(docs.select(*COLUMNS))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str, model_path: str = PIECE_MODEL) -> DataFrame:
    """doc_id, source, n_tokens and ids."""
    return sentencepiece_codec.encode_documents(docs, sentencepiece_codec.read_model(model_path), keep=("doc_id", "source"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_duplicates),
    ("substring_dedup", cut_repeats),
    ("mixing", mix_sources),
    ("sentencepiece", encode),
]

#: SQL can express neither the classifier nor the mix; the tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents table."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir), name)
    return docs
