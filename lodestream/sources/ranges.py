"""One large array, or values back to back, in one file, read in ranges by many tasks.

Spark's text reader deals the file out as runs of bytes between commas, or up to closing braces. A task doesn't know whether
its range begins in a string, or how deep; so a first reading summarises each range for both, a pass over the summaries (one
short row a range) fixes every range's beginning, and a second reading cuts the elements. An element that runs over ranges
is put together from its pieces; all others never leave their task.

Both readings must deal the same ranges: should a growing cluster deal a small file otherwise the second time, the query
fails and says so (spark.sql.files.minPartitionNum fixes the ranges).
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestream.operators.shipping import ship
from lodestream.plans.model import JsonError

_STRING = re.compile(rb'"(?:[^"\\]++|\\.)*+"', re.DOTALL)
_REST = re.compile(rb'(?:[^"\\]++|\\.)*+"', re.DOTALL)
#: Rows of an output batch, and bytes of their values, about.
BATCH_ROWS, BATCH_BYTES = 4096, 4 << 20


def step(run: bytes, inside: bool) -> tuple[bool, int]:
    """(whether the run ends in a string, change of depth) of bytes before a comma, for either beginning."""
    if inside:
        m = _REST.match(run)
        if not m:
            return True, 0
        run = run[m.end() :]
    bare = _STRING.sub(b"", run) if b'"' in run else run
    at = bare.find(b'"')
    if at >= 0:
        bare = bare[:at]
    return at >= 0, bare.count(b"[") + bare.count(b"{") - bare.count(b"]") - bare.count(b"}")


def _ranges(batches: Iterator[pa.RecordBatch], columns: int) -> Iterator[tuple[tuple, Iterator[bytes]]]:
    def rows() -> Iterator[tuple[tuple, bytes]]:
        for batch in batches:
            for key, run in zip(zip(*[batch.column(i).to_pylist() for i in range(columns)], strict=True), batch.column(columns), strict=True):
                yield key, run.as_py()

    for key, group in groupby(rows(), key=lambda r: r[0]):
        yield key, (run for _, run in group)


def _summaries(batches: Iterator[pa.RecordBatch], mark: bytes) -> Iterator[pa.RecordBatch]:
    """One row a range: its bytes, and for either beginning whether it ends in a string, and the change of depth."""
    for (path, start), runs in _ranges(batches, 2):
        total, ends, depths = 0, [False, True], [0, 0]
        for run in runs:
            total += len(run) + 1
            run += mark
            met = ends[0] == ends[1]
            ends[0], change = step(run, ends[0])
            depths[0] += change
            if not met:
                ends[1], change = step(run, ends[1])
            else:
                # Both beginnings have come to the same state and stay together.
                ends[1] = ends[0]
            depths[1] += change
        yield pa.RecordBatch.from_arrays([pa.array([v]) for v in (path, start, total, ends[0], depths[0], ends[1], depths[1])], names=["path", "start", "total", "end0", "depth0", "end1", "depth1"])


def _elements(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (path, start, opens, closes, value): whole elements open and close; pieces of others lack one or both."""
    for (path, start, base, inside, depth), runs in _ranges(batches, 5):
        if base is None:
            raise ValueError(f"{path}: cut at byte {start} in other ranges than before")
        rows: list[tuple] = []
        # A range that begins in the array itself begins an element.
        held, pos, begun, opens = 0, base, base, depth == 1 and not inside
        kept: list[bytes] = []
        for run in runs:
            here, pos = pos, pos + len(run) + 1
            was = depth
            ends, change = step(run, inside)
            if was == 0 and here == 0 and not inside:
                # The file's first bytes lead to the array.
                lead = run.removeprefix(b"\xef\xbb\xbf").lstrip(b" \t\r\n")
                if lead[:1] != b"[":
                    raise ValueError(f"{path}: no array at the root")
                skip = len(run) - len(lead) + 1
                run, begun, opens, was = run[skip:], skip, True, 1
            kept.append(run)
            inside, depth = ends, depth + change
            if not inside and depth <= 1:
                # An element ends at a comma in the array itself, or at the array's end.
                value = b",".join(kept)
                if depth == 0:
                    value = value.rstrip(b" \t\r\n").removesuffix(b"]")
                rows.append((path, begun, opens, True, value))
                held += len(value)
                kept, begun, opens = [], pos, True
                if len(rows) >= BATCH_ROWS or held >= BATCH_BYTES:
                    yield _batch(rows)
                    rows, held = [], 0
        if kept:
            # The comma after the last run belongs to the element that goes on.
            rows.append((path, begun, opens, False, b",".join(kept) + b","))
        if rows:
            yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True))
    return pa.RecordBatch.from_arrays([pa.array(columns[0]), pa.array(columns[1], pa.int64()), pa.array(columns[2]), pa.array(columns[3]), pa.array(columns[4], pa.binary())], names=["path", "start", "opens", "closes", "value"])


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows like those of _elements(): bytes up to a brace after which no value is open, with what stands before."""
    for (path, start, base, inside, depth, size), runs in _ranges(batches, 6):
        if base is None:
            raise ValueError(f"{path}: cut at byte {start} in other ranges than before")
        rows: list[tuple] = []
        held, pos, begun, opens = 0, base, base, depth == 0 and not inside
        kept: list[bytes] = []
        for run in runs:
            pos += len(run) + 1
            # The last run of a file may have no brace behind it.
            run = run + b"}" if pos <= size else run
            kept.append(run)
            inside, change = step(run, inside)
            depth += change
            if not inside and depth == 0:
                value = b"".join(kept)
                rows.append((path, begun, opens, True, value))
                held += len(value)
                kept, begun, opens = [], pos, True
                if len(rows) >= BATCH_ROWS or held >= BATCH_BYTES:
                    yield _batch(rows)
                    rows, held = [], 0
        if kept:
            rows.append((path, begun, opens, False, b"".join(kept)))
        if rows:
            yield _batch(rows)


def _framed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from lodestream.sources.framing import adjacent_frames

    for batch in batches:
        for path, start, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            src = value.as_py()
            spans = adjacent_frames(src)
            if spans:
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(spans)), pa.array([start + s for s, _ in spans], pa.int64()), pa.array([src[s:e].decode("utf-8", "replace").strip(" \t\r\n") for s, e in spans])], names=["path", "start", "value"])


def _runs(spark: SparkSession, path: str, mark: str) -> DataFrame:
    lines = spark.read.option("lineSep", mark).text(path)
    return lines.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"), F.col("_metadata.file_size").alias("size"), F.col("value").cast("binary").alias("run"))


def _beginnings(runs: DataFrame, path: str, mark: str) -> DataFrame | None:
    """(path, start, base, inside, depth) of each range; None if there are none. A file that ends inside a value fails."""
    # Names and lengths only; no file is read.
    files = runs.sparkSession.read.format("binaryFile").load(path).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("size"))
    sizes = {r.path: r["size"] for r in files.collect()}
    found = runs.select("path", "start", "run").mapInArrow(lambda batches: _summaries(batches, mark.encode()), "path string, start long, total long, end0 boolean, depth0 long, end1 boolean, depth1 long")
    known = []
    # One short row a range.
    for name, own in groupby(sorted(found.collect(), key=lambda r: (r.path, r.start)), key=lambda r: r.path):
        base, inside, depth, size = 0, False, 0, sizes.get(name, 0)
        if mark == "}" and re.search(r"\.(gz|bz2|zst|lz4|snappy|deflate)$", name):
            raise ValueError(f"{name}: packed files aren't dealt out in ranges; readers.framed() reads them")
        for r in own:
            known.append((name, r.start, base, inside, depth))
            base += r.total
            inside, depth = (r.end1, depth + r.depth1) if inside else (r.end0, depth + r.depth0)
        # The mark behind the last run, if it isn't there, was counted.
        if inside or depth + (mark == "}" and base > size):
            raise JsonError("Syntax", "expected-value", size, f"{name}: a value isn't closed at the file's end")
    return runs.sparkSession.createDataFrame(known, "path string, start long, base long, inside boolean, depth long") if known else None


def _together(rows: DataFrame) -> DataFrame:
    """(path, start, value) of whole elements, and of those whose pieces stand in several ranges."""
    whole = rows.filter("opens and closes").select("path", "start", "value")
    # At most two pieces a range.
    pieces = rows.filter("not (opens and closes)").withColumn("element", F.sum(F.col("opens").cast("int")).over(Window.partitionBy("path").orderBy("start")))
    joined = F.aggregate(F.array_sort(F.collect_list(F.struct("start", "value"))), F.lit(b"").cast("binary"), lambda x, p: F.concat(x, p["value"]))
    return whole.unionByName(pieces.groupBy("path", "element").agg(F.min("start").alias("start"), joined.alias("value")).select("path", "start", "value"))


_PIECES = "path string, start long, opens boolean, closes boolean, value binary"


def array_elements(spark: SparkSession, path: str) -> DataFrame:
    """(path, start, value): the elements of the array at the root of each file, by their places in the file.

    Elements are cut by structure alone; what reads them refuses what isn't JSON. An empty array has no rows. Files without
    an array, or whose array isn't closed, fail the query.
    """
    ship(spark)
    runs = _runs(spark, path, ",")
    known = _beginnings(runs, path, ",")
    if known is None:
        return spark.createDataFrame([], "path string, start long, value string")
    dealt = runs.join(F.broadcast(known), ["path", "start"], "left").select("path", "start", "base", "inside", "depth", "run")
    found = _together(dealt.mapInArrow(_elements, _PIECES))
    text = F.regexp_replace(F.col("value").cast("string"), r"^[ \t\r\n]+|[ \t\r\n]+$", "")
    return found.select("path", "start", text.alias("value")).filter("value != ''")


def adjacent_records(spark: SparkSession, path: str) -> DataFrame:
    """(path, start, value): values back to back in each file, by their places in the file.

    Ranges are cut after objects, so a file without objects is one task's input. What can't be framed is a record of its
    own, up to the next place where no value is open.
    """
    ship(spark)
    runs = _runs(spark, path, "}")
    known = _beginnings(runs, path, "}")
    if known is None:
        return spark.createDataFrame([], "path string, start long, value string")
    dealt = runs.join(F.broadcast(known), ["path", "start"], "left").select("path", "start", "base", "inside", "depth", "size", "run")
    return _together(dealt.mapInArrow(_records, _PIECES)).mapInArrow(_framed, "path string, start long, value string")
