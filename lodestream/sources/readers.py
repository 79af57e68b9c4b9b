"""Readers of JSON files: one row a record, with its place, and the issue of a record that can't be read."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestream.operators.shipping import ship
from lodestream.plans import model as m


def _text_type() -> str:
    return "path string, ordinal long, start long, value string"


def text(spark: SparkSession, path: str) -> DataFrame:
    """(path, value): one JSON text a file; a leading byte order mark is dropped."""
    files = spark.read.text(path, wholetext=True)
    return files.select(F.col("_metadata.file_path").alias("path"), F.regexp_replace("value", "^﻿", "").alias("value"))


def ndjson(spark: SparkSession, path: str) -> DataFrame:
    """(path, value): one record a line that holds something; files are split at line ends among tasks.

    Records have no ordinal: that takes one task a file, as framed() does it.
    """
    lines = spark.read.text(path)
    return lines.select(F.col("_metadata.file_path").alias("path"), "value").filter(F.col("value").rlike("[^ \\t]"))


def jsonseq(spark: SparkSession, path: str) -> DataFrame:
    """(path, value): one record a payload between record separators; files are split among tasks."""
    parts = spark.read.text(path, lineSep="\x1e")
    return parts.select(F.col("_metadata.file_path").alias("path"), F.trim(F.regexp_replace("value", "^[ \\t\\r\\n]+|[ \\t\\r\\n]+$", "")).alias("value")).filter("value != ''")


def framed(spark: SparkSession, path: str, framing: str, dialect: str = "rfc8259") -> DataFrame:
    """(path, ordinal, start, value): each file's records in order, by the exact framer; a file is one task's input."""
    from lodestream.sources.framing import frames

    ship(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                src = content.as_py()
                spans = frames(src, framing, dialect)
                for at in range(0, len(spans), 4096):
                    part = spans[at : at + 4096]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([p] * len(part)), pa.array(range(at, at + len(part)), pa.int64()), pa.array([s for s, _ in part], pa.int64()), pa.array([src[s:e].decode("utf-8", "replace").strip(" \t\r\n") for s, e in part])],
                        names=["path", "ordinal", "start", "value"],
                    )

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(run, _text_type())


def split_array(spark: SparkSession, path: str, at: tuple[m.Step, ...] = (), target: int = 256 << 10) -> DataFrame:
    """(path, ordinal, value): the elements of one array in each file, behind any path; a file is one task's input.

    That task finds the elements' borders; the elements are then read on as many tasks as there are ranges. An array at the
    root of a large file is read by many tasks with sources.ranges.array_elements().
    """
    from lodestream.plans.shard import cut

    ship(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                src = content.as_py()
                for first, start, end in cut(src, at, target):
                    yield pa.RecordBatch.from_arrays([pa.array([p]), pa.array([first], pa.int64()), pa.array([src[start:end].decode()])], names=["path", "first", "part"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    parts = files.mapInArrow(run, "path string, first long, part string")
    from lodestream.operators import exact

    # Each part is a run of elements; as an array of its own it answers like the whole.
    spread = parts.select("path", "first", F.concat(F.lit("["), "part", F.lit("]")).alias("part")).repartition("path", "first")
    each = exact.rows(spread, "part", m.Collection(), keep=["path", "first"], ordinal="own")
    return each.select("path", (F.col("first") + F.col("own")).alias("ordinal"), "value")


def write_ndjson(df: DataFrame, column: str, path: str) -> None:
    """One record a line, as Spark's text writer puts them."""
    df.select(F.col(column).alias("value")).write.text(path)


def write_jsonseq(df: DataFrame, column: str, path: str) -> None:
    """Each record after a record separator and before a line end."""
    df.select(F.concat(F.lit("\x1e"), column).alias("value")).write.text(path)
