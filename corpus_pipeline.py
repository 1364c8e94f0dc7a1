"""A corpus pipeline of five stages over `documents`; each stage works on all that the one before it kept.

Toxicity and language identification reject documents, near-duplicate detection keeps one document of each group, mixing
keeps documents with rates that bring the expected tokens of the label qualities to their targets, and byte-level BPE
encodes what is left. All stages but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from knownat.llm import bpe, langid, mixing, order_minhash, toxicity
from knownat.llm.store import stored

#: A document is toxic from this score on, as in op5_toxicity.
TOXIC = 0.3
#: Target weights of the qualities in `labels`, in expected tokens.
QUALITY_TARGETS = {"1": 0.95, "0": 0.05}


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def _rows(docs: DataFrame, *more: str) -> DataFrame:
    """Whole rows as one struct beside the columns that a stage needs, so that other columns can have any name."""
    return docs.select(F.struct(*docs.columns).alias("_row"), *more)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Reject documents whose toxicity score reaches TOXIC. Learns from all labelled documents; null texts stay. Of several
    labels of one document the larger counts."""
    labels = _labels(spark, sf_dir).where("toxic is not null").groupBy(F.col("doc_id").alias("_id")).agg(F.max("toxic").alias("_toxic"))
    known = docs.select("doc_id", "text").join(labels, F.col("doc_id") == F.col("_id"))
    model = toxicity.fit(known, label="_toxic")
    scored = toxicity.score(_rows(docs, "text"), model, output="score")
    return scored.where(F.col("score") < TOXIC).select("_row.*")


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Reject documents without a letter, or whose language the codewords can't tell. Learns from the given lang values."""
    model = langid.fit(docs.select("doc_id", "text", "lang"))
    named = langid.identify(_rows(docs, "text"), model)
    return named.where((F.col("lang_pred") != langid.UNKNOWN) & ~F.col("ambiguous")).select("_row.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group: the one with the least doc_id. Of rows with the same doc_id one stays; rows
    with a null text or doc_id are in no group and stay."""
    classes = order_minhash.near_classes(docs.select("doc_id", "text"))
    kept = classes.where(F.col("doc_id") == F.col("class_id")).select(F.col("doc_id").alias("_id")).distinct()
    rows = _rows(docs, "doc_id", "text")
    whole = rows.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).drop("text")
    alone = rows.where(F.col("doc_id").isNull() | F.col("text").isNull()).drop("text")
    single = whole.join(kept, F.col("doc_id") == F.col("_id"), "left_semi").dropDuplicates(["doc_id"])
    return single.unionByName(alone).select("_row.*")


def mix_qualities(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents with the rates, as shares of the largest, that bring qualities to QUALITY_TARGETS."""
    labelled = _labels(spark, sf_dir).select("doc_id", F.col("quality").alias("domain"))
    rates = stored(mixing.mix(docs.select("doc_id", "text"), labelled, QUALITY_TARGETS), "rates")
    return mixing.thin(_rows(docs, "doc_id"), rates).select("_row.*")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each whole text, with doc_id, lang and source."""
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    encoded = bpe.encode(docs.select("doc_id", "lang", "source", "text"), ranks, offsets=False)
    return encoded.select("doc_id", "lang", "source", F.size("ids").cast("bigint").alias("n_tokens"), "ids")


STAGES = [
    ("toxicity", drop_toxic),
    ("language_id", keep_languages),
    ("near_duplicates", drop_near_duplicates),
    ("mixing", mix_qualities),
    ("byte_bpe", encode),
]

#: The stages learn classifiers and merge by rank, which SQL can't express; tests/llm compares each with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
