"""The corpus pipeline: each stage is written and read again as the next one's documents.

Defined results, of every stage: null and empty texts fail the quality rules, so they leave there; very long texts go
through whole; repeated rows have one fate, and are mixed as often each; rows that share an id but not a text are judged
each by its own text until near-duplicates, where one id is one document; documents without an id are told apart by
their text; null sources and languages are sources and languages of their own; an empty table gives an empty result;
further columns of documents are kept and never read, whatever their names.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bpe, mixing, near_dedup, quality, toxicity
from tidemark.llm.common import dropped, scratch, written


def _without(docs: DataFrame, rejected: DataFrame, host: bool) -> DataFrame:
    """docs but those rejected: rows of that id and text (and of that source, where the verdict depends on it)."""
    gone = rejected.select(F.col("doc_id").alias("gone_id"), F.col("text_hash").alias("gone_text"), *([F.col("host").alias("gone_host")] if host else [])).distinct()
    on = docs["doc_id"].cast("long").eqNullSafe(gone["gone_id"]) & (F.xxhash64(docs["text"].cast("string")) == gone["gone_text"])
    return docs.join(gone, on & docs["source"].cast("string").eqNullSafe(gone["gone_host"]) if host else on, "left_anti")


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.5 or more go. The model learns from the labelled documents among docs."""
    model = toxicity.train(docs, toxicity.training_rows(spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return toxicity.below(docs, model, 0.5)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the rules or are depleted of their own lines go."""
    return _without(docs, quality.quality(docs).where(~F.col("kept")), host=True)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays: that of the smallest id."""
    return _without(docs, near_dedup.near_duplicates(docs, words=5, percent=80).where(~F.col("kept")), host=False)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as the mixture takes them. Rows are known by a hash of what the mixture reads, so equal rows share an order and a fate."""
    read = ["doc_id", "lang", "source", "text"]
    key = F.xxhash64(*(x for c in read for x in (F.isnull(c), F.col(c).cast("string"))))
    taken = mixing.mix(mixing.leveled(docs, key, public_tokenizers.path("word_bpe_49k.json")), mixing.LEVELS, mixing.WEIGHTS, share=0.6)
    times = taken.select("key", "epoch").distinct().groupBy("key").agg(F.count("*").cast("int").alias("times")).select(F.col("key").alias("taken_key"), F.sequence(F.lit(1), F.col("times")).alias("taken_times"))
    out = docs.join(times, key == times["taken_key"])
    return out.select(*(docs[c] for c in docs.columns), F.explode(times["taken_times"]).alias("__mixing_time")).drop("__mixing_time")


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of each document, and digests of them and of what they decode to."""
    return bpe.encode_decode(docs, public_tokenizers.path("word_bpe_49k.json"), ("n_tokens", "ids", "ids_sha256", "decoded_sha256"))


STAGES = [
    ("toxicity", toxicity_stage),
    ("quality rules", quality_stage),
    ("near-duplicates", near_dedup_stage),
    ("mixing", mixing_stage),
    ("bpe", bpe_stage),
]

#: SQL cannot express the trained and the hashed stages; tests compare them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = []
    for name, stage in STAGES[:-1]:
        with scratch(spark) as kept:  # what a stage wrote for itself goes when its documents are written
            docs = written(spark, stage(spark, docs, sf_dir), name.replace(" ", "-"))
            kept(docs)
        dropped(spark, *before)
        before = [docs]
    return STAGES[-1][1](spark, docs, sf_dir)
