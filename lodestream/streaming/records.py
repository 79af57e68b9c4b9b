"""Demands over streams: each record answers on its own, so streaming needs no state but a running count's."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition, SimpleDataSourceStreamReader

from lodestream.operators import exact
from lodestream.plans import model as m
from lodestream.sources.framing import RS


def rows(stream: DataFrame, column: str, demand: m.Demand, keep: list[str] | None = None, **options: Any) -> DataFrame:
    """A row demand over each record of a stream, batch or streaming: the same operator, append mode."""
    return exact.rows(stream, column, demand, keep=keep, **options)


def running_count(stream: DataFrame, column: str, demand: m.Demand, by: list[str], **options: Any) -> DataFrame:
    """Sums of a count demand by key, for update or complete mode."""
    counts = exact.value(stream, column, demand, out="n", keep=by, **options)
    return counts.groupBy(*by).agg(F.sum(F.col("n").cast("long")).alias("n"))


def windowed_count(stream: DataFrame, column: str, demand: m.Demand, time: str, window: str, late: str, **options: Any) -> DataFrame:
    """Sums of a count demand by event-time window; records later than `late` are not waited for."""
    counts = exact.value(stream.withWatermark(time, late), column, demand, out="n", keep=[time], **options)
    return counts.groupBy(F.window(time, window)).agg(F.sum(F.col("n").cast("long")).alias("n"))


#: Bytes of a growing file that one task reads, about, and that are looked at in one step for a record's end.
PART_BYTES, STEP_BYTES = 64 << 20, 64 << 10


def _decoded(data: bytes, at: int, framing: str) -> Iterator[tuple]:
    from lodestream.sources.framing import frames

    for s, e in frames(data, framing):
        yield at + s, data[s:e].decode("utf-8", "replace").strip(" \t\r\n")


class _Part(InputPartition):
    def __init__(self, start: int, stop: int, end: int):
        self.start, self.stop, self.end = start, stop, end


class _GrowingRanges(DataSourceStreamReader):
    """What a growing file of lines or record separators has gained: the driver looks for the last record's end, tasks read."""

    def __init__(self, options: dict[str, str]):
        self.path, self.framing = options["path"], options.get("framing", "ndjson")
        self.part = int(options.get("bytes", PART_BYTES))
        #: Up to where the file was complete when it was last looked at.
        self.known = 0

    def initialOffset(self) -> dict:
        return {"byte": 0}

    def latestOffset(self) -> dict:
        """The end of the last complete record, looked for from the file's end; nothing before it is read."""
        with open(self.path, "rb") as f:
            stop = f.seek(0, 2)
            # A final CR may be half of a CRLF.
            tail = b""
            while stop > self.known:
                start = max(self.known, stop - STEP_BYTES)
                f.seek(start)
                tail = f.read(stop - start)
                last = tail.rfind(RS) if self.framing == "jsonseq" else max(tail.rfind(b"\n"), tail.rfind(b"\r", 0, len(tail) - 1)) + 1
                if last > 0 or (last == 0 and self.framing == "jsonseq" and start > 0):
                    self.known = start + last
                    break
                stop = start
        return {"byte": self.known}

    def partitions(self, start: dict, end: dict) -> list[_Part]:
        edges = [*range(start["byte"], end["byte"], self.part), end["byte"]]
        return [_Part(a, b, end["byte"]) for a, b in zip(edges, edges[1:], strict=False)] or [_Part(end["byte"], end["byte"], end["byte"])]

    def _border(self, f: Any, at: int, end: int) -> int:
        """The first place from `at` on where a record begins."""
        if at == 0 or at >= end:
            return min(at, end)
        at = at if self.framing == "jsonseq" else at - 1
        while at < end:
            f.seek(at)
            data = f.read(min(STEP_BYTES, end - at))
            found = [i for i in ((data.find(RS),) if self.framing == "jsonseq" else (data.find(b"\n"), data.find(b"\r"))) if i >= 0]
            if found:
                return at + min(found) + (self.framing != "jsonseq")
            at += len(data)
        return end

    def read(self, partition: _Part) -> Iterator[tuple]:
        with open(self.path, "rb") as f:
            start, stop = self._border(f, partition.start, partition.end), self._border(f, partition.stop, partition.end)
            f.seek(start)
            yield from _decoded(f.read(max(0, stop - start)), start, self.framing)


class _GrowingValues(SimpleDataSourceStreamReader):
    """What a growing file of values back to back has gained: only reading on tells where a value ends, so one reader does."""

    def __init__(self, options: dict[str, str]):
        self.path = options["path"]

    def initialOffset(self) -> dict:
        return {"byte": 0}

    def _bytes(self, start: dict, end: int | None) -> bytes:
        from lodestream.sources.framing import complete_prefix

        with open(self.path, "rb") as f:
            f.seek(start["byte"])
            data = f.read() if end is None else f.read(end - start["byte"])
        return data[: complete_prefix(data, "adjacent")] if end is None else data

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        data = self._bytes(start, None)
        return iter(list(_decoded(data, start["byte"], "adjacent"))), {"byte": start["byte"] + len(data)}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        return iter(list(_decoded(self._bytes(start, end["byte"]), start["byte"], "adjacent")))


class GrowingFile(DataSource):
    """Streaming source "lodestream_growing": options path, framing, and bytes for a task.

    Driver and tasks open the path, so on a cluster it lies on a file system that all of them have mounted.
    """

    @classmethod
    def name(cls) -> str:
        return "lodestream_growing"

    def schema(self) -> str:
        return "start long, value string"

    def streamReader(self, schema: Any) -> DataSourceStreamReader:
        if self.options.get("framing") == "adjacent":
            return super().streamReader(schema)
        return _GrowingRanges(self.options)

    def simpleStreamReader(self, schema: Any) -> SimpleDataSourceStreamReader:
        return _GrowingValues(self.options)


def register(spark: SparkSession) -> None:
    from lodestream.operators.shipping import ship

    ship(spark)
    spark.dataSource.register(GrowingFile)
