"""Helpers that the corpus operators share: shipping code, shared tables, Arrow maps, words."""

from __future__ import annotations

import atexit
import gc
import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestream.sources.scratch import shared_folder

#: The characters that separate words, for Java and Python patterns alike.
SPACE = r"\x20\x09-\x0D"
#: The same characters as a literal, for translate() and trim().
SPACE_CHARS = " \t\n\x0b\x0c\r"

#: Rows of an Arrow batch, at most.
BATCH_ROWS = 1024


def ship(spark: SparkSession) -> None:
    """Makes this package importable in Python workers, wherever the driver found it."""
    package = Path(__file__).resolve().parents[1]
    sc = spark.sparkContext
    if getattr(sc, "_lodestream_shipped", False):
        return
    folder = tempfile.mkdtemp(prefix="lodestream-ship-")
    target = os.path.join(folder, "lodestream_code.zip")
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(package.rglob("*.py")):
            z.write(p, str(p.relative_to(package.parent)))
    sc.addPyFile(target)
    sc._lodestream_shipped = True


_written: list[tuple[SparkSession, str]] = []
#: The paths written within the innermost passing() of this thread.
_passing: ContextVar[list[str] | None] = ContextVar("_passing", default=None)


def drop_path(spark: SparkSession, path: str) -> None:
    """Deletes a path through Hadoop's file system, so that any store works."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def _drop_written() -> None:
    for spark, path in _written:
        try:
            drop_path(spark, path)
        except Exception:  # noqa: BLE001  the session has ended; the folder's owner clears it
            return


atexit.register(_drop_written)


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, deleted when the driver ends."""
    path = f"{shared_folder(spark).rstrip('/')}/lodestream-{name}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    if (own := _passing.get()) is not None:
        own.append(path)
    return path


@contextmanager
def passing(spark: SparkSession) -> Iterator[Callable[[str], str]]:
    """Tables that are written inside are deleted at the end, but for the paths that are given to what this yields."""
    own: list[str] = []
    kept: list[str] = []
    outer = _passing.get()
    token = _passing.set(own)
    try:
        yield lambda path: kept.append(path) or path
    finally:
        _passing.reset(token)
        for path in own:
            if path not in kept:
                drop_path(spark, path)
        if outer is not None:
            outer += kept


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read again: lineage ends there, and lost executors lose nothing."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    found = spark.read.schema(df.schema).parquet(path)
    found._lodestream_path = path
    return found


def forget(df_or_path: DataFrame | str, spark: SparkSession | None = None) -> None:
    """Deletes a table that stored() wrote, once no plan needs it."""
    if isinstance(df_or_path, str):
        paths = [df_or_path]
    else:
        spark = df_or_path.sparkSession
        paths = list({f.rsplit("/", 1)[0] for f in df_or_path.inputFiles()})
    for path in paths:
        drop_path(spark, path)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once a row, even where body uses it inside lambdas."""
    return F.transform(F.array(value), body)[0]


def word_array(text: Column) -> Column:
    """The words [^\\x20\\x09-\\x0D]+ of a text, in order; null text: no words."""
    parts = F.split(F.coalesce(text, F.lit("")), f"[{SPACE}]+")
    return F.filter(parts, lambda w: w != "")


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of some MB: texts are long, and a batch is in the JVM's and the worker's memory at once."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def appended(df: DataFrame, fields: list[tuple[str, T.DataType]]) -> T.StructType:
    """df's schema with fields added at the end; a field that df already has is replaced."""
    names = {n.lower() for n, _ in fields}
    kept = [f for f in df.schema.fields if f.name.lower() not in names]
    return T.StructType([*kept, *[T.StructField(n, t, True) for n, t in fields]])


def map_texts(df: DataFrame, text_col: str, fields: list[tuple[str, T.DataType]], make: Callable[[], Callable[[list[str | None]], list[list]]], keep: list[str] | None = None, rows: int = 256) -> DataFrame:
    """Adds fields computed from text_col by a Python function over slices of Arrow batches.

    make() runs once a task and returns a function from a list of texts to one list a field.
    keep: the columns to carry along (all if None). No shuffle; memory is one Arrow batch plus `rows` texts.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    names = {n.lower() for n, _ in fields}
    columns = [c for c in (df.columns if keep is None else keep) if c.lower() not in names]
    temp = "__text_in"
    source = df.select(*[F.col(f"`{c}`") for c in columns], F.col(f"`{text_col}`").alias(temp))
    schema = T.StructType([*[df.schema[c] for c in columns], *[T.StructField(n, t, True) for n, t in fields]])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                out = work(part.column(len(columns)).to_pylist())
                made = [pa.array(v, type=arrow.field(len(columns) + i).type) for i, v in enumerate(out)]
                carried = [part.column(i) for i in range(len(columns))]
                carried = [c if c.type == arrow.field(i).type else c.cast(arrow.field(i).type) for i, c in enumerate(carried)]
                yield pa.RecordBatch.from_arrays([*carried, *made], schema=arrow)
        # Workers wait for further tasks; what this one has gathered shouldn't wait with them.
        if close := getattr(work, "close", None):
            close()
        del work
        gc.collect()
        pa.default_memory_pool().release_unused()

    ship(df.sparkSession)
    small_batches(df.sparkSession)
    return source.mapInArrow(run, schema)
