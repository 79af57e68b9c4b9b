"""Sharding by histogram sort, with built-in functions only.

Rows are ordered by (hash of the text, doc_id, place in the narrow table), so equal texts lie together. Splitters come from
exact counts: each round counts the bytes between candidate boundaries over all partitions, keeps the cells that hold a
target, and refines them until each is one element, going on to the next key column within a group that may be cut. An
element is a group of equal texts, or a row of a group so heavy that a shard would miss its size by it; it goes to the
shard in whose share of all bytes its middle lies. With all splitters known, rows are exchanged once, in slices of even
row counts whatever the keys are, and numbered there.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestream.llm.common import stored

LEAST, MOST = -(1 << 63), (1 << 63) - 1
KEYS = ("h", "d", "u")
#: A group of equal texts up to one part in so many of a shard's bytes is never cut; heavier ones are, or sizes would drift.
GROUP_PART = 50
#: Rows that one task sorts and numbers, about.
SLICE_ROWS = 500_000
#: An interval is counted in at most 2 ** BITS cells.
BITS = 12
#: Intervals refined in one query, at most; there are no more than shards.
TOGETHER = 100


@dataclass
class Interval:
    """Keys with the given leading values whose next column lies in lo..hi; below: the bytes of all keys before."""

    prefix: tuple[int, ...]
    lo: int
    hi: int
    below: int
    targets: list[int] = field(default_factory=list)

    @property
    def shift(self) -> int:
        s = 0
        while (self.hi >> s) - (self.lo >> s) >= 1 << BITS:
            s += 1
        return s


def narrow(df: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(doc_id, size, text_crc32, h, d, u), written once; u tells equal rows apart."""
    t = F.coalesce(F.col(text), F.lit(""))
    kind = df.schema[doc_id].dataType
    number = F.col(doc_id).cast("long") if isinstance(kind, T.IntegralType) else F.xxhash64(doc_id)
    # 60 bits, so never negative.
    h = F.conv(F.substring(F.md5(t), 1, 15), 16, 10).cast("long")
    made = df.select(F.col(doc_id).alias("doc_id"), (F.octet_length(t) + 1).cast("long").alias("size"), F.crc32(t).alias("text_crc32"), h.alias("h"), F.coalesce(number, F.lit(LEAST)).alias("d"), F.monotonically_increasing_id().alias("u"))
    return stored(made, "sharding-rows")


def _counted(rows: DataFrame, intervals: list[Interval]) -> list[list]:
    """For each interval its cells in order: (weight, least and greatest value, least and greatest next value)."""
    nothing = F.lit(None)
    which, cell, value, after = nothing.cast("int"), nothing.cast("long"), nothing.cast("long"), nothing.cast("long")
    for i, x in enumerate(intervals):
        level = len(x.prefix)
        v = F.col(KEYS[level])
        own = (v >= F.lit(x.lo)) & (v <= F.lit(x.hi))
        for name, fixed in zip(KEYS, x.prefix, strict=False):
            own = own & (F.col(name) == F.lit(fixed))
        which = F.when(own, F.lit(i)).otherwise(which)
        cell = F.when(own, F.shiftright(v, x.shift)).otherwise(cell)
        value = F.when(own, v).otherwise(value)
        after = F.when(own, F.col(KEYS[min(level + 1, 2)])).otherwise(after)
    made = rows.select(which.alias("i"), cell.alias("c"), value.alias("v"), after.alias("a"), "size").filter("i is not null")
    # At most 2 ** BITS rows an interval.
    found = made.groupBy("i", "c").agg(F.sum("size").alias("w"), F.min("v").alias("mn"), F.max("v").alias("mx"), F.min("a").alias("amn"), F.max("a").alias("amx")).collect()
    out: list[list] = [[] for _ in intervals]
    for r in sorted(found, key=lambda r: (r.i, r.c)):
        out[r.i].append(r)
    return out


def _next(prefix: tuple[int, ...], v: int) -> tuple[int, int, int]:
    """The least key after all keys that begin with prefix and v."""
    while v == MOST and prefix:
        *prefix, v = prefix
    key = (*prefix, v + 1) if v < MOST else (MOST, MOST, MOST)
    return (*key, *[LEAST] * (3 - len(key)))


def splitters(rows: DataFrame, targets: list[int], group: int) -> list[tuple[int, int, int]]:
    """For each target the least key whose element's middle lies at or beyond it, counted in bytes from the first row.

    An element is a group of equal hashes that weighs `group` at most, else a row.
    """
    done: dict[int, tuple[int, int, int]] = {}
    todo = [Interval((), 0, (1 << 60) - 1, 0, sorted(set(targets)))]
    while todo:
        now, todo = todo[:TOGETHER], todo[TOGETHER:]
        for x, cells in zip(now, _counted(rows, now), strict=True):
            below, at, level = x.below, 0, len(x.prefix)
            refined: dict[int, Interval] = {}
            for t in x.targets:
                # The cell that holds the target: below <= t < below + its weight.
                while at < len(cells) - 1 and below + cells[at].w <= t:
                    below += cells[at].w
                    at += 1
                c = cells[at]
                single = c.mn == c.mx
                if single and (level == 2 or level == 0 and c.w <= group):
                    first = (*x.prefix, c.mn, *[LEAST] * (2 - level))
                    done[t] = first if 2 * t <= 2 * below + c.w else _next(x.prefix, c.mn)
                elif at in refined:
                    refined[at].targets.append(t)
                else:
                    refined[at] = Interval((*x.prefix, c.mn), c.amn, c.amx, below, [t]) if single else Interval(x.prefix, c.mn, c.mx, below, [t])
            todo += refined.values()
    return [done[t] for t in targets]


def sharded(df: DataFrame, shards: int = 8, doc_id: str = "doc_id", text: str = "text", slice_rows: int = SLICE_ROWS) -> DataFrame:
    """One row for each row of df: doc_id, size, text_crc32, shard, slot.

    size is the UTF-8 bytes of the text plus 1; shards hold near equal sums of it: they differ from the mean by half a
    group of 1/GROUP_PART of it at most, or by half a row. slot numbers a shard's rows from 0 without gaps: slice after
    slice, in key order within each; up to slice_rows rows a shard there is one slice. Null texts count as empty. Null
    doc_ids come first among equal texts. Repeated rows are told apart by their place and numbered one after another. An
    empty table gives an empty table.
    """
    rows = narrow(df, doc_id, text)
    total, n = rows.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    cuts = splitters(rows, [total * k // shards for k in range(1, shards)], total // shards // GROUP_PART) if n else []
    key = F.struct(*KEYS)
    shard = F.lit(0)
    for cut in cuts:
        shard = shard + (key >= F.struct(*[F.lit(v).alias(k) for k, v in zip(KEYS, cut, strict=True)])).cast("int")
    slices = max(1, -(-n // (shards * slice_rows)))
    placed = rows.select("doc_id", "size", "text_crc32", *KEYS, shard.alias("shard"), F.pmod(F.xxhash64(*KEYS), F.lit(slices)).cast("long").alias("slice"))
    # One row for each slice of slice_rows rows, about.
    counts = placed.groupBy("shard", "slice").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("slice")) - F.col("n")
    firsts = counts.select("shard", "slice", before.alias("first"))
    rank = F.row_number().over(Window.partitionBy("shard", "slice").orderBy(*KEYS)).cast("long") - 1
    return placed.withColumn("__rank", rank).join(F.broadcast(firsts), ["shard", "slice"]).select("doc_id", "size", "text_crc32", "shard", (F.col("first") + F.col("__rank")).alias("slot"))


#: The same rows in DuckDB's SQL, for tables of one slice a shard. crc holds the table of CRC-32's 256 steps.
SQL = """
WITH RECURSIVE bits AS (SELECT range AS b, range::BIGINT AS v, 0 AS k FROM range(256) UNION ALL SELECT b, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, k + 1 FROM bits WHERE k < 8),
crc AS (SELECT list(v ORDER BY b) AS steps FROM bits WHERE k = 8),
t AS (SELECT doc_id, coalesce(text, '') AS x FROM documents),
r AS (SELECT doc_id, strlen(x)::BIGINT + 1 AS size, ('0x' || substr(md5(x), 1, 15))::BIGINT AS h, CASE WHEN x = '' THEN 0
  ELSE xor(list_reduce([4294967295::BIGINT] || list_transform(range(strlen(x)::BIGINT), lambda i: ('0x' || substr(hex(encode(x)), 2 * i + 1, 2))::BIGINT), lambda a, b: xor(a >> 8, steps[(xor(a, b) & 255) + 1])), 4294967295) END AS text_crc32 FROM t, crc),
s AS (SELECT *, sum(size) OVER () AS total, sum(size) OVER (PARTITION BY h) AS w, sum(size) OVER (ORDER BY h) AS upto, sum(size) OVER (ORDER BY h, doc_id NULLS FIRST ROWS UNBOUNDED PRECEDING) AS upto_row FROM r),
m AS (SELECT *, CASE WHEN w <= total // 8 // 50 THEN 2 * (upto - w) + w ELSE 2 * (upto_row - size) + size END AS middle2 FROM s),
p AS (SELECT *, len(list_filter(range(1, 8), lambda k: 2 * (total * k // 8) <= middle2))::INTEGER AS shard FROM m)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY h, doc_id NULLS FIRST) - 1 AS slot, NULL::INTEGER AS grown_shard FROM p
"""
