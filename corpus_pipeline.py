"""The corpus pipeline: stages over documents, each written as Parquet and read again by the next.

Toxic documents go, one document of each near-duplicate component stays, documents that overlap a benchmark item go,
personal data is replaced by its kind, and the rest is encoded. All stages but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestream.llm import bpe, decontam, neardup, pii, toxicity
from lodestream.llm.common import drop_path, fresh_path, passing


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model, fitted on the labels of these documents, doesn't predict to be toxic."""
    model = toxicity.trained(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score_documents(docs, model, prefix="__toxicity_").filter("__toxicity_predicted = 0").select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate component: the one with the least doc_id."""
    return neardup.deduplicated(docs)


def drop_benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap no benchmark item."""
    return decontam.decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind in brackets, and n_chars of the new text."""
    found = pii.find_documents(docs, pii.trained(docs), with_redacted=True, prefix="__pii_")
    out = {"text": F.col("__pii_redacted"), "n_chars": F.when(F.col("__pii_redacted").isNull(), F.col("n_chars")).otherwise(F.char_length("__pii_redacted").cast("long"))}
    return found.select(*[out[c].alias(c) if c in out else F.col(c) for c in docs.columns])


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of each document's ids and decoded text."""
    return bpe.encode_documents(docs, public_tokenizers.path("word_bpe_49k.json"), keep=["doc_id"], with_ids=False)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("minhash_near_dedup", drop_near_duplicates),
    ("benchmark_decontamination", drop_benchmark_passages),
    ("pii", redact_personal_data),
    ("bpe", encode),
]

#: The first stage's model is fitted, which SQL can't express.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents in sf_dir; each stage's rows are written to the shared folder for the next."""
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        # What a stage has stored, and the rows it began with, go once its own rows are written.
        with passing(spark) as keep:
            path = keep(fresh_path(spark, f"pipeline-{name}"))
            stage(spark, docs, sf_dir).write.parquet(path)
        if last is not None:
            drop_path(spark, last)
        docs, last = spark.read.parquet(path), path
    return STAGES[-1][1](spark, docs, sf_dir)
