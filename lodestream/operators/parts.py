"""One large array over many tasks: a text is cut into ranges of whole elements, which answer apart and fold back.

Where a demand can't be split, or its text holds no such array, the text is answered serially, as one part.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestream.operators import exact
from lodestream.plans import model as m
from lodestream.plans import walk
from lodestream.plans.shard import FIRST_BYTES, Plan, at_elements


def spread(df: DataFrame, column: str, demand: m.Demand, target: int = FIRST_BYTES, keep: list[str] | None = None) -> DataFrame:
    """(keep, part, whole, text): the ranges of each text as arrays of their own, dealt out to all tasks.

    whole: the text itself, for a demand that meets no array that can be cut. Null texts have no parts.
    """
    request = m.Request((demand,))

    def each(src: bytes | None) -> Iterator[tuple]:
        if src is None:
            return
        plan = Plan.build(src, request, target)
        if plan is None or not plan.ranges:
            yield 0, True, src.decode()
            return
        for i, (_, start, end) in enumerate(plan.ranges):
            yield i, False, "[" + src[start:end].decode() + "]"

    walk.refuse_containers(demand)
    fields = [T.StructField("part", T.LongType()), T.StructField("whole", T.BooleanType()), T.StructField("text", T.StringType())]
    kept = exact._keeps(df, column, keep)
    return exact._mapped(df, column, kept, fields, each).repartition(F.xxhash64("text"))


def rows(df: DataFrame, column: str, demand: m.Demand, target: int = FIRST_BYTES, keep: list[str] | None = None, **options: Any) -> DataFrame:
    """As exact.rows(), with part and at: a row's range, and its place among the range's rows; both give the order."""
    dealt = spread(df, column, demand, target, keep)
    kept = [*[c for c in dealt.columns if c not in ("whole", "text")]]
    cut = exact.rows(dealt.filter(~F.col("whole")), "text", at_elements(walk.canonical(demand)), keep=kept, ordinal="at", **options)
    serial = exact.rows(dealt.filter("whole"), "text", demand, keep=kept, ordinal="at", **options)
    return cut.unionByName(serial)


def folded(df: DataFrame, column: str, request: m.Request, target: int = FIRST_BYTES, keep: list[str] | None = None) -> DataFrame:
    """As exact.answers() for several demands on one array, each text's ranges answered apart and folded within its task.

    Rows follow one another, counts add up; a range that fails has its text read serially, as one that can't be cut is.
    """

    def each(src: bytes | None) -> Iterator[tuple]:
        if src is None:
            yield None, []
            return
        plan = Plan.build(src, request, target)
        r = walk.scan(src, request) if plan is None else plan.run()
        yield [exact.answer_row(src, a) for a in r.answers], [exact._issue(i) for i in r.issues]

    for d in request.demands:
        walk.refuse_containers(d)
    return exact._mapped(df, column, exact._keeps(df, column, keep), exact.RESULT, each)


def count(df: DataFrame, column: str, demand: m.Demand, by: list[str], target: int = FIRST_BYTES) -> DataFrame:
    """(by, n): a count demand answered in parts and added up for each key."""
    if m.shard(demand) != "sum":
        raise m.JsonError("Shape", "invalid-shape", 0, "only counts add up")
    dealt = spread(df, column, demand, target, by)
    cut = exact.value(dealt.filter(~F.col("whole")), "text", at_elements(walk.canonical(demand)), out="n", keep=by)
    serial = exact.value(dealt.filter("whole"), "text", demand, out="n", keep=by)
    return cut.unionByName(serial).groupBy(*by).agg(F.sum(F.col("n").cast("long")).alias("n"))


def encoded(df: DataFrame, column: str, by: list[str], options: Any = None, out: str = "encoded", least: int | None = None) -> DataFrame:
    """(by, out): arrays whose items are written in parts by many tasks and put together: the bytes that one write gives.

    Values that aren't long arrays are one part. by tells the texts apart.
    """
    from lodestream.functions.encode import LEAST_ITEMS, Options, _Writer, encode_part, encode_value, plan_parts
    from lodestream.functions.lexer import parse

    options = options or Options()
    least = LEAST_ITEMS if least is None else least
    # What stands before, between and after the parts.
    line, end = _Writer(options).line(1), _Writer(options).line(0)

    def cut(src: bytes | None) -> Iterator[tuple]:
        if src is not None:
            v = parse(src)
            ranges = plan_parts(v, least)
            for i, r in enumerate(ranges):
                yield i, encode_value([v[j] for j in r]).decode(), len(ranges)
            if not ranges:
                yield 0, src.decode(), 0

    fields = [T.StructField("part", T.LongType()), T.StructField("text", T.StringType()), T.StructField("parts", T.LongType())]
    dealt = exact._mapped(df, column, by, fields, cut).repartition(F.xxhash64(*by, "part"))

    def part(src: bytes | None) -> Iterator[tuple]:
        v = parse(src)
        yield encode_part(v, range(len(v)), options) if isinstance(v, list) else None, encode_value(v, options).decode()

    made = exact._mapped(dealt, "text", [*by, "part", "parts"], [T.StructField("items", T.StringType()), T.StructField("alone", T.StringType())], part)
    texts = F.transform(F.array_sort(F.collect_list(F.struct("part", "items"))), lambda p: p["items"])
    joined = F.concat(F.lit("[" + line), F.array_join(texts, "," + line), F.lit(end + "]"))
    return made.groupBy(*by).agg(F.when(F.max("parts") == 0, F.max("alone")).otherwise(joined).alias(out))
