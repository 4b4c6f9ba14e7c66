"""A training-corpus pipeline: each stage works on all that the one before it kept.

Of every stage: a null or empty text is judged as an empty one and stays (no toxic word, nothing alike, no
repeat, no item); texts of any length are read whole; repeated rows are judged alike; a table without rows
gives none; other columns of a document, whatever their names, pass through all stages but the last.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.llm import bpe, decontam, minhash, suffix, toxicity
from folio.llm.store import materialize
from folio.session import ship


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents not predicted toxic, by a model of labelled documents among them; without labels all stay."""
    ship(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.fit(docs, labels, F.lit(True))
    scored = toxicity.score(docs, model, evidence=False)
    return scored.where("predicted = 0").select(*docs.columns)


def minhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group, its smallest id.

    Rows without an id or without words stay; rows that share an id are judged by their own texts.
    """
    ship(spark)
    found = minhash.near_duplicates(docs.select("doc_id", "text"))
    gone = found.where("not kept").select(F.col("node").alias("__node")).distinct()
    marked = docs.withColumn("__node", minhash.node_of("doc_id", "text"))
    return marked.join(gone, "__node", "left_anti").select(*docs.columns)


def suffix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that an earlier one, or they themselves earlier, hold; n_chars is counted anew.

    A document of which nothing is left stays, with an empty text; a null text stays null.
    """
    ship(spark)
    cut = suffix.remove_repeats(docs)
    return cut.withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item; without items all stay."""
    ship(spark)
    return decontam.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(*docs.columns)


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with the digests of ids and of their decoding; a null text has none."""
    ship(spark)
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    coded = bpe.encode(docs, path, public_tokenizers.PATTERN)
    return coded.select("doc_id", "lang", "source", "token_ids", "n_tokens", "ids_sha256", "decoded_sha256")


STAGES = [
    ("toxicity", toxicity_stage),
    ("minhash", minhash_stage),
    ("suffix", suffix_stage),
    ("decontamination", decontamination_stage),
    ("bpe", bpe_stage),
]

#: SQL can't express the trained classifier, nor the tokenizer; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs, _ = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
