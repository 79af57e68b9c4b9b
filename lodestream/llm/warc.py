"""WARC archives: written with revisit records for repeated payloads, read by boundary-chain verification.

Writing: pages with equal payloads of some size become one response and revisits of it. Records are text rows that Spark's
own writer separates by two line ends, so archives land in any store Spark can write. They are plain unless asked for
otherwise, since tasks can only share plain archives.

Reading: Spark's text reader deals ranges of the archives out to tasks, as runs of bytes between one magic at a line's start
and the next, so no header is ever cut. A run that parses as a header is a candidate; it names its successor, the byte after
its block. Payloads can hold the magic too, even whole records, so only candidates that the chain from the file's start
reaches are records. Within its range a task follows the chain itself; across ranges, candidates'
offsets and where their chains leave the range go into a table, and pointer jumping doubles the reach of the chain over it
until every range's first record is known. A chain that doesn't end at the archive's last byte is an error, so no record is
left out in silence. Tasks hold one record at a time and some rows of output; headers and archives may have any length.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestream.llm.common import fresh_path, passing, ship, small_batches, stored

#: Payloads below this many bytes are always written in full.
LEAST_REVISIT_BYTES = 100
#: Records in one packed archive, at most.
RECORDS_PER_FILE = 2000
#: Bytes of repeated payloads' digests and responses that are broadcast, at most, and of one without its page_id.
BROADCAST_BYTES = 64 << 20
DIGEST_BYTES = 96
#: Rows of one payload go to so many tasks when they are shuffled to its response.
SALTS = 16
MAGIC, EOL = "WARC/1.1\r\n", "\r\n"
#: Bytes of payloads in an output batch, about; longer pieces of a cut record are handed out in parts.
BATCH_BYTES = 4 << 20


def name_of(page_id: Column) -> Column:
    """A page_id as a record's name; a null one has a name without an id."""
    return F.coalesce(F.concat(F.lit("<urn:page:"), F.url_encode(page_id.cast("string")), F.lit(">")), F.lit("<urn:page>"))


def id_of(name: Column, kind: T.DataType) -> Column:
    """What name_of() made the name of."""
    pattern = "^<urn:page:([^>]*)>$"
    return F.when(name.rlike(pattern), F.try_url_decode(F.regexp_extract(name, pattern, 1))).cast(kind)


def revisits(pages: DataFrame, page_id: str = "page_id", payload: str = "html") -> DataFrame:
    """(digest, response): the least page_id of the payloads that two rows or more have, where they are long enough.

    Null page_ids can't be referred to: such rows count, but only a page_id can be the response.
    """
    body = F.coalesce(F.col(payload), F.lit(""))
    narrow = pages.select(F.col(page_id).alias("page_id"), F.sha2(body, 256).alias("digest"), F.octet_length(body).alias("n")).filter(f"n >= {LEAST_REVISIT_BYTES}")
    return narrow.groupBy("digest").agg(F.min("page_id").alias("response"), F.count("*").alias("rows")).filter("rows > 1 and response is not null").select("digest", "response")


def records(pages: DataFrame, page_id: str = "page_id", url: str = "url", payload: str = "html") -> DataFrame:
    """One record a row, as text: its headers, an empty line, and the payload unless it is a revisit.

    A row whose page_id is the response's own is a response, even if rows repeat. Repeated payloads' digests are counted
    first: they go out in a broadcast while their measured size allows, and payloads stay where they are; beyond it rows
    are shuffled by digest. Short payloads meet nothing in the join, and rows of one payload are spread, so no payload's
    rows gather in one task.
    """
    body = F.coalesce(F.col(payload), F.lit(""))
    own = pages.select(F.col(page_id).alias("page_id"), F.coalesce(F.regexp_replace(F.col(url), r"[\r\n]", ""), F.lit("")).alias("url"), body.alias("body"), F.sha2(body, 256).alias("digest"), F.octet_length(body).alias("n"))
    long_enough = F.col("n") >= LEAST_REVISIT_BYTES
    own = own.withColumn("__key", F.when(long_enough, F.col("digest")))
    known = stored(revisits(pages, page_id, payload).select(F.col("digest").alias("__key"), "response"), "warc-revisits")
    size = known.agg(F.sum(F.octet_length(F.col("response").cast("string")) + DIGEST_BYTES)).first()[0] or 0
    if size <= BROADCAST_BYTES:
        joined = own.join(F.broadcast(known), "__key", "left")
    else:
        spread = F.xxhash64("page_id", "url")
        own = own.withColumn("__salt", F.when(long_enough, F.pmod(spread, F.lit(SALTS))).otherwise(spread))
        known = known.withColumn("__salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
        joined = own.join(known, ["__key", "__salt"], "left")
    again = F.col("response").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("response"))
    line = lambda k, v: F.concat(F.lit(f"{k}: "), v, F.lit(EOL))
    head = F.concat(
        F.lit(MAGIC),
        line("WARC-Type", F.when(again, "revisit").otherwise("response")),
        line("WARC-Record-ID", name_of(F.col("page_id"))),
        line("WARC-Target-URI", F.col("url")),
        line("WARC-Date", F.lit("1970-01-01T00:00:00Z")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        line("Payload-Length", F.col("n").cast("string")),
        F.when(again, F.concat(line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")), line("WARC-Refers-To", name_of(F.col("response"))))).otherwise(""),
        line("Content-Type", F.lit("text/html; charset=utf-8")),
        line("Content-Length", F.when(again, F.lit("0")).otherwise(F.col("n").cast("string"))),
        F.lit(EOL),
    )
    return joined.select(F.concat(head, F.when(again, "").otherwise(F.col("body"))).alias("value"))


def write(pages: DataFrame, path: str, page_id: str = "page_id", url: str = "url", payload: str = "html", records_per_file: int | None = None, packed: bool = False) -> None:
    """Writes the pages as WARC files below path, plain or gzipped; files hold at most records_per_file records.

    Many tasks read a plain archive, so it may have any size; a packed one is one task's, so it is bounded if nothing is said.
    """
    most = records_per_file or (RECORDS_PER_FILE if packed else 0)
    records(pages, page_id, url, payload).write.option("lineSep", EOL + EOL).option("maxRecordsPerFile", most).option("compression", "gzip" if packed else "none").text(path)


#: What stands between two runs.
_BETWEEN = b"\r\nWARC/1."
_HEADER = re.compile(rb"WARC/1\.[01]((?:\r\n[A-Za-z0-9-]+:[^\r\n]*)*)\r\n\r\n")
_LINE = re.compile(rb"\r\n([A-Za-z0-9-]+):[ \t]*([^\r\n]*)")


def header(data: bytes) -> tuple[dict[bytes, bytes], int, int] | None:
    """(headers by lower-case name, the header's length, its block's length) if the bytes begin with a header."""
    m = _HEADER.match(data)
    if not m:
        return None
    head: dict[bytes, bytes] = {}
    for line in _LINE.finditer(data, m.start(1), m.end(1)):
        head.setdefault(line[1].lower(), line[2])
    length = head.get(b"content-length", b"")
    return (head, m.end(), int(length)) if length.isdigit() and len(length) <= 15 else None


def chain_ends(candidates: list[tuple[int, int]]) -> dict[int, tuple[int, int]]:
    """For each candidate (place, successor) of a range, where its chain leaves the range: (last place, next place).

    Candidates whose chain meets a place before the last candidate that is none have no entry.
    """
    ends: dict[int, tuple[int, int]] = {}
    for at, to in reversed(candidates):
        if to > candidates[-1][0]:
            ends[at] = (at, to)
        elif to in ends:
            ends[at] = ends[to]
    return ends


def _ranges(batches: Iterator[pa.RecordBatch], columns: int) -> Iterator[tuple[tuple, Iterator[bytes]]]:
    """The runs of each range, in order; a range is told by the values of the leading columns."""
    from itertools import groupby

    def rows() -> Iterator[tuple[tuple, bytes]]:
        for batch in batches:
            keys = zip(*[batch.column(i).to_pylist() for i in range(columns)], strict=True)
            for key, run in zip(keys, batch.column(columns), strict=True):
                yield key, run.as_py()

    for key, group in groupby(rows(), key=lambda r: r[0]):
        yield key, (run for _, run in group)


def _placed(runs: Iterator[bytes], base: int) -> Iterator[tuple[int, int, int, bytes]]:
    """(place of its magic, place of its bytes, place after what follows it, bytes with the magic) of each run of a range.

    The file's first run holds its magic; the others come after theirs. What follows the last run isn't there.
    """
    pos = base
    for run in runs:
        here, pos = pos, pos + len(run) + len(_BETWEEN)
        yield (0, 0, pos, run) if here == 0 else (here - 7, here - 7, pos, _BETWEEN[2:] + run)


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (path, start, total, at, last, to): the chain ends of a range's candidates; one row without at has its bytes."""
    for (path, start), runs in _ranges(batches, 2):
        found, pos = [], 0
        # Places count from the range's first byte; only the file's first range has place 0 for its first magic.
        for at, here, pos, data in _placed(runs, 0 if start == 0 else 1 << 40):
            if (h := header(data + _BETWEEN)) is not None:
                found.append((at, here + h[1] + h[2] + 4))
        shift = 0 if start == 0 else 1 << 40
        rows = [(path, start, pos - shift, None, None, None), *[(path, start, None, at - shift, last - shift, to - shift) for at, (last, to) in chain_ends(found).items() if start or at == 0]]
        for i in range(0, len(rows), 4096):
            part = list(zip(*rows[i : i + 4096], strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(part[0], pa.string()), *[pa.array(c, pa.int64()) for c in part[1:]]], names=["path", "start", "total", "at", "last", "to"])


def first_records(runs: DataFrame, files: DataFrame) -> DataFrame:
    """(path, start, base, total, first, open, open_to, ends): for each range of the archives its place in bytes, its first
    record, the record that it begins in and that one's successor, and whether the file's chain ends at its last byte.

    Pointer jumping: each round, the reached candidates reach what they jump to, and all jumps double.
    """
    found = stored(runs.mapInArrow(_candidates, "path string, start long, total long, at long, last long, to long"), "warc-candidates")
    order = Window.partitionBy("path").orderBy("start")
    sizes = found.filter("at is null").select("path", "start", "total", (F.sum("total").over(order) - F.col("total")).alias("base"))
    placed = found.filter("at is not null").select("path", "start", "at", "last", "to").join(sizes, ["path", "start"])
    jumps = placed.select("path", "start", (F.col("base") + F.col("at")).alias("at"), (F.col("base") + F.col("last")).alias("last"), (F.col("base") + F.col("to")).alias("to"))
    jumps = stored(jumps, "warc-jumps")
    reached = jumps.filter("at = 0").select("path", "at")
    step = jumps.select("path", "at", "to")
    while not step.isEmpty():
        more = reached.join(step, ["path", "at"]).select("path", F.col("to").alias("at"))
        reached = stored(reached.union(more).distinct(), "warc-reached")
        ahead = step.select("path", F.col("at").alias("to"), F.col("to").alias("far"))
        step = stored(step.join(ahead, ["path", "to"]).select("path", "at", F.col("far").alias("to")), "warc-jumps")
    firsts = reached.join(jumps, ["path", "at"]).select("path", "start", F.col("at").alias("first"), "last", "to")
    # A candidate that the chain reaches stands in one range, and leaves it at once for the next reached one.
    known = sizes.join(firsts, ["path", "start"], "left")
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("path")
    known = known.join(files, "path").withColumn("ends", (F.max("to").over(whole) == F.col("bytes")) & (F.sum("total").over(whole) - len(_BETWEEN) == F.col("bytes")))
    return known.select("path", "start", "base", "total", "first", F.last("last", True).over(earlier).alias("open"), F.last("to", True).over(earlier).alias("open_to"), "ends")


_FIELDS = (("type", b"warc-type"), ("record_id", b"warc-record-id"), ("url", b"warc-target-uri"), ("refers_to", b"warc-refers-to"), ("digest", b"warc-payload-digest"), ("length", b"payload-length"))
_ROW = pa.schema([("part", pa.string()), ("path", pa.string()), ("offset", pa.int64()), *[(n, pa.string()) for n, _ in _FIELDS], ("at", pa.int64()), ("block", pa.binary()), ("block_bytes", pa.int64()), ("block_sha256", pa.string())])


def _read(batches: Iterator[pa.RecordBatch], blocks: bool) -> Iterator[pa.RecordBatch]:
    """Rows of whole records, and of cut ones: their beginning, and the pieces that later ranges hold.

    Whole records come without their blocks unless these are asked for; the others' are needed to make them whole.
    """
    rows: list[tuple] = []
    held = 0

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _ROW.types, strict=True)], schema=_ROW)

    for (path, start, base, total, first, open_at, open_to, ends), runs in _ranges(batches, 8):
        alone = base is None
        if ends is False or not alone and ends is None:
            raise ValueError(f"{path}: the chain of records doesn't end at the archive's last byte")
        if alone and start:
            raise ValueError(f"{path}: cut at byte {start} in other ranges than before")
        base = base or 0
        # Until the range's first record, its bytes are a piece of the record that it begins in: fields is None.
        fields, offset, follows = (None, open_at, open_to) if base else ((), 0, 0)
        content, content_end = base, follows - 4
        kept: list[bytes] = []
        held_here, pos, tail = 0, base, _BETWEEN[:2]

        def close(block: bytes, done: bool) -> None:
            if fields is None:
                if block:
                    rows.append(("piece", path, offset, *[None] * len(_FIELDS), content, block, None, None))  # noqa: B023
            elif fields and done:
                rows.append(("record", path, offset, *fields, content, block if blocks else None, len(block), hashlib.sha256(block).hexdigest()))  # noqa: B023
            elif fields:
                rows.append(("beginning", path, offset, *fields, content, block, None, None))  # noqa: B023

        for at, here, pos, data in _placed(runs, base):
            if at >= follows:
                # A block that begins with the magic has its header's end before it.
                h = header(data + _BETWEEN)
                if at > follows or h is None or tail != _BETWEEN[:2]:
                    raise ValueError(f"{path}: no record at byte {follows}")
                close(b"".join(kept), True)
                held += held_here + 256
                if held >= BATCH_BYTES and rows:
                    yield out()
                    rows, held = [], 0
                kept, held_here, offset = [], 0, at
                fields = tuple(h[0][k].decode("utf-8", "replace") if k in h[0] else None for _, k in _FIELDS)
                content = here + h[1]
                content_end = content + h[2]
                follows = content_end + 4
            tail = data[-2:]
            # The bytes of this run, and of the magic that ends it, that belong to the open record.
            lo, hi = content, min(content_end, pos)
            if at and content <= at:
                # The magic itself came at the end of the run before.
                lo = at + 7
            if hi > lo:
                part = (data + _BETWEEN)[lo - here : hi - here]
                kept.append(part)
                held_here += len(part)
            if fields is None and held_here >= BATCH_BYTES:
                close(b"".join(kept), False)
                yield out()
                rows, held, kept, held_here, content = [], 0, [], 0, min(pos, content_end)
        if alone and follows != pos - len(_BETWEEN):
            raise ValueError(f"{path}: no record at byte {follows} of {pos - len(_BETWEEN)}")
        close(b"".join(kept), content_end <= pos)
        held += held_here
    if rows:
        yield out()


def _rows(runs: DataFrame, known: DataFrame | None, blocks: bool) -> DataFrame:
    schema = "part string, path string, offset long, " + ", ".join(f"{n} string" for n, _ in _FIELDS) + ", at long, block binary, block_bytes long, block_sha256 string"
    names = ["base", "total", "first", "open", "open_to", "ends"]
    if known is None:
        dealt = runs.select("path", "start", *[F.lit(None).cast("boolean" if n == "ends" else "long").alias(n) for n in names], "run")
    else:
        # One row of some 150 bytes for each range of an archive, so about 1 MB for each TB.
        dealt = runs.join(F.broadcast(known), ["path", "start"], "left").select("path", "start", *names, "run")
    return dealt.mapInArrow(lambda batches: _read(batches, blocks), schema)


def read(spark: SparkSession, path: str, blocks: bool = True) -> DataFrame:
    """(path, offset, type, record_id, url, refers_to, digest, length, block, block_bytes, block_sha256) of the archives'
    records; without the column block if blocks is false.

    Archives may be plain or packed. A packed one is one task's stream and is read as the result is; plain ones are read in
    ranges by many tasks, and their records are written to the shared folder. digest and length are the record's own
    headers; block_bytes and block_sha256 are computed from the bytes read. A record's block is one value, so it is bounded
    by Spark's 2 GB. An archive whose chain of records breaks fails the query.
    """
    ship(spark)
    small_batches(spark)
    lines = spark.read.option("lineSep", _BETWEEN.decode()).text(path)
    runs = lines.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"), F.col("value").cast("binary").alias("run"))
    packed = F.col("path").rlike(r"\.(gz|bz2|zst|lz4|snappy|deflate)$")
    columns = ["path", "offset", *[n for n, _ in _FIELDS], *(["block"] if blocks else []), "block_bytes", "block_sha256"]
    # Names and lengths only; no file is read.
    plain = spark.read.format("binaryFile").load(path).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("bytes")).filter(~packed)
    streamed = _rows(runs.filter(packed), None, blocks).select(columns)
    if plain.isEmpty():
        return streamed
    # Both readings must deal the same ranges, even if executors come or go between them.
    setting = "spark.sql.files.minPartitionNum"
    before = spark.conf.get(setting, None)
    spark.conf.set(setting, before or str(spark.sparkContext.defaultParallelism))
    try:
        with passing(spark) as keep:
            known = stored(first_records(runs.filter(~packed), plain), "warc-ranges")
            rows = stored(_rows(runs.filter(~packed), known, blocks), "warc-records")
            keep(rows._lodestream_path)
    finally:
        spark.conf.set(setting, before) if before else spark.conf.unset(setting)
    cut = rows.filter("part != 'record'")
    pieces = F.array_sort(F.collect_list(F.when(F.col("part") == "piece", F.struct("at", "block"))))
    joined = F.aggregate(pieces, F.max(F.when(F.col("part") == "beginning", F.col("block"))), lambda x, p: F.concat(x, p["block"]))
    made = cut.groupBy("path", "offset").agg(*[F.max(n).alias(n) for n, _ in _FIELDS], joined.alias("block")).withColumn("block_bytes", F.octet_length("block").cast("long")).withColumn("block_sha256", F.sha2("block", 256))
    return streamed.unionByName(rows.filter("part = 'record'").select(columns)).unionByName(made.select(columns))


def round_trip(pages: DataFrame, page_id: str = "page_id", url: str = "url", payload: str = "html") -> DataFrame:
    """Writes the pages as plain archives in the shared folder and reads them back in ranges: one row for each page.

    page_id, payload_bytes and payload_digest (of the full payload; a revisit's come from its headers, a response's from
    the bytes read), record_type, and refers_to, the response's page_id for revisits. Null payloads are empty. A null
    page_id stays null; page_ids of other types than numbers come back as they were. Repeated rows give repeated records;
    the rows of the least page_id are all responses. An empty table gives an empty table.
    """
    spark = pages.sparkSession
    folder = fresh_path(spark, "warc")
    write(pages, folder, page_id, url, payload)
    return digests(read(spark, folder, blocks=False), pages.schema[page_id].dataType)


def digests(found: DataFrame, kind: T.DataType | None = None) -> DataFrame:
    kind = kind or T.LongType()
    again = F.col("type") == "revisit"
    return found.select(
        id_of(F.col("record_id"), kind).alias("page_id"),
        F.when(again, F.col("length").cast("long")).otherwise(F.col("block_bytes")).cast("long").alias("payload_bytes"),
        F.when(again, F.regexp_replace("digest", "^sha256:", "")).otherwise(F.col("block_sha256")).alias("payload_digest"),
        F.col("type").alias("record_type"),
        id_of(F.col("refers_to"), kind).alias("refers_to"),
    )


#: The same rows in DuckDB's SQL.
SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS b FROM pages),
d AS (SELECT page_id, strlen(b)::BIGINT AS payload_bytes, sha256(b) AS payload_digest FROM p),
r AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS least, count(*) OVER (PARTITION BY payload_digest) AS n FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 100 AND n > 1 AND page_id <> least THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND n > 1 AND page_id <> least THEN least END AS refers_to FROM r
"""
