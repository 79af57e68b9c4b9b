"""The corpus operators' queries over the test tables, each over its whole table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from pyspark.sql import functions as F

from lodestream.llm import bpe, decontam, licenses, neardup, pii, quality, sharding, tokencount, toxicity, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(table(spark, sf_dir, "documents"), keep=["doc_id"])


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.trained(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic"))
    scored = toxicity.score_documents(docs, model, keep=["doc_id"])
    return scored.select("doc_id", toxicity.held_out().alias("held_out"), "score", "predicted", "n_hits", "quotation")


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.encode_documents(docs, public_tokenizers.path("word_bpe_49k.json"), keep=["doc_id"], with_ids=False)


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.find_documents(docs, pii.trained(docs), keep=["doc_id"])


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), keep=["doc_id"])


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), ["doc_id"])


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = sharding.sharded(table(spark, sf_dir, "documents"), shards=8)
    return made.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return tokencount.count_tokens(docs, public_tokenizers.path("piece_bpe_32k.model"), keep=["doc_id"])


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"op1_quality": op1_quality, "op2_toxicity": op2_toxicity, "op3_bpe": op3_bpe, "op4_pii": op4_pii, "op5_licenses": op5_licenses, "op6_decontamination": op6_decontamination, "op7_sharding": op7_sharding, "op8_near_duplicates": op8_near_duplicates, "op9_warc": op9_warc, "op10_token_counts": op10_token_counts}


def oracle_sql() -> dict[str, str]:
    return {"op1_quality": quality.SQL, "op6_decontamination": decontam.SQL, "op7_sharding": sharding.SQL, "op8_near_duplicates": neardup.SQL, "op9_warc": warc.SQL}
