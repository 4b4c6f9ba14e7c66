"""The registered queries of the training-data operators, each over its whole table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.llm import bpe, ctw, decontam, html, langid, media, minhash, shard, sql, suffix, toxicity

RANKS = "byte_bpe_multi_50k.tiktoken"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard.assign(_table(spark, sf_dir, "documents"))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = bpe.encode(docs, public_tokenizers.path(RANKS), public_tokenizers.PATTERN, with_ids=False)
    return coded.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op3_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.matches(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op4_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(_table(spark, sf_dir, "pages").select("page_id", "url", "html")).select("page_id", "url", "text", "n_chars")


def op5_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tables hold no images: each vector of ``embeddings`` is drawn as one."""
    images = media.drawn(_table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return media.copies(images, "vec_id", F.col("image"))


def op6_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, sf_dir, "documents")).drop("node")


def op7_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.remove_repeats(_table(spark, sf_dir, "documents"), with_text=False)


def id_remainder(modulus: int, id_col: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo ``modulus``; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(modulus))


def op8_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.fit(docs, id_remainder(5) != 0)
    found = langid.predict(docs.select("doc_id", "text"), model)
    return found.select("doc_id", (id_remainder(5) == 0).alias("held_out"), "lang_pred", "score", "bits", "rejected")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, _table(spark, sf_dir, "labels"), id_remainder(3) != 1)
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", (id_remainder(3) == 1).alias("held_out"), "score", "predicted", "evidence")


def op10_ctw(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = ctw.score(_table(spark, sf_dir, "documents"), id_remainder(5) != 1)
    return scored.withColumn("held_out", ~F.col("in_training")).drop("in_training")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_shard": op1_shard,
    "op2_bpe": op2_bpe,
    "op3_decontam": op3_decontam,
    "op4_html": op4_html,
    "op5_media": op5_media,
    "op6_minhash": op6_minhash,
    "op7_suffix": op7_suffix,
    "op8_langid": op8_langid,
    "op9_toxicity": op9_toxicity,
    "op10_ctw": op10_ctw,
}

#: The others learn a model, decode or search by it: SQL can't express them, tests hold them against brute force.
ORACLE_SQL: dict[str, str] = {"op1_shard": sql.SHARD, "op6_minhash": sql.MINHASH, "op7_suffix": sql.SUFFIX}
