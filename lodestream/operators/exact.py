"""Demands over a text column, answered exactly in Arrow-batched Python workers.

Each operator is one mapInArrow without a shuffle; columns that aren't asked for are pruned before it. Predicates run in
the worker, so rejected rows never leave it. Filters on other columns belong before the operator, where Spark pushes
them into the scan.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import replace
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from lodestream.operators.control import Limits, scan_controlled, scan_traced
from lodestream.operators.shipping import ship
from lodestream.plans import model as m
from lodestream.plans import walk
from lodestream.plans.model import JsonError

ISSUE = T.StructType([T.StructField("cls", T.StringType()), T.StructField("code", T.StringType()), T.StructField("message", T.StringType()), T.StructField("offset", T.LongType())])
CELL = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("text", T.StringType())])
FACT = T.StructType([T.StructField("role", T.StringType()), *[T.StructField(n, T.LongType()) for n in ("start", "end", "owner_start", "owner_end")], T.StructField("text", T.StringType())])
ANSWER = T.StructType(
    [
        T.StructField("kind", T.StringType()),
        T.StructField("actual", T.StringType()),
        T.StructField("document", CELL),
        T.StructField("validated", T.BooleanType()),
        T.StructField("facts", T.ArrayType(FACT)),
        T.StructField("fields", T.ArrayType(T.StringType())),
        T.StructField("rows", T.ArrayType(T.ArrayType(CELL))),
        T.StructField("oracle", T.StringType()),
        T.StructField("names", T.ArrayType(T.StringType())),
    ]
)
RESULT = [T.StructField("answers", T.ArrayType(ANSWER)), T.StructField("issues", T.ArrayType(ISSUE))]


def _bytes(v: Any) -> bytes | None:
    return None if v is None else v.encode() if isinstance(v, str) else bytes(v)


def _cell(src: bytes, span: tuple[int, int] | None) -> dict | None:
    return None if span is None else {"start": span[0], "end": span[1], "text": src[span[0] : span[1]].decode("utf-8", "replace")}


def _issue(i: m.Issue) -> dict:
    return {"cls": i.cls, "code": i.code, "message": i.message, "offset": i.offset}


def answer_row(src: bytes, a: m.Answer) -> dict:
    """An answer as a struct of ANSWER; kind is document, columns, oracle, missing or type_mismatch."""
    out: dict[str, Any] = dict.fromkeys(ANSWER.names)
    if isinstance(a, m.Document):
        facts = [{"role": f.role, "start": f.start, "end": f.end, "owner_start": f.owner_start, "owner_end": f.owner_end, "text": src[f.start : f.end].decode()} for f in a.facts]
        return out | {"kind": "document", "document": _cell(src, (a.start, a.end)), "validated": a.validated, "facts": facts}
    if isinstance(a, m.Columns):
        return out | {"kind": "columns", "fields": list(a.fields), "rows": [[_cell(src, c) for c in r] for r in a.rows]}
    if isinstance(a, m.OracleAnswer):
        names = a.value if isinstance(a.value, list) else None
        return out | {"kind": "oracle", "oracle": None if names is not None else str(a.value).lower() if isinstance(a.value, bool) else str(a.value), "names": names}
    return out | ({"kind": "type_mismatch", "actual": a.actual} if isinstance(a, m.TypeMismatch) else {"kind": "missing"})


def _array(values: list, kind: pa.DataType) -> pa.Array:
    """An Arrow array; texts may come as UTF-8 bytes, which aren't decoded one by one."""
    if kind != pa.string():
        return pa.array(values, type=kind)
    try:
        return pa.array(values, type=pa.binary()).cast(kind)
    except pa.ArrowInvalid:
        return pa.array([v.decode("utf-8", "replace") if isinstance(v, bytes) else v for v in values], type=kind)


def _mapped(df: DataFrame, column: str, keep: list[str], fields: list[T.StructField], each: Callable[[bytes | None], Iterator[tuple]]) -> DataFrame:
    """Rows that each() makes of the column's values, with the kept columns of the row they come from."""
    ship(df.sparkSession)
    names = {f.name.lower() for f in fields}
    keep = [c for c in keep if c.lower() not in names]
    schema = T.StructType([*[df.schema[c] for c in keep], *fields])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                came, made = [], []
                texts = part.column(len(keep))
                for i, v in enumerate((texts.cast(pa.binary()) if texts.type == pa.string() else texts).to_pylist()):
                    for row in each(_bytes(v)):
                        came.append(i)
                        made.append(row)
                taken = part.select(list(range(len(keep)))).take(pa.array(came, pa.int64())) if keep else None
                columns = [c if c.type == arrow.field(i).type else c.cast(arrow.field(i).type) for i, c in enumerate(taken.columns if keep else [])]
                columns += [_array([r[k] for r in made], arrow.field(len(keep) + k).type) for k in range(len(fields))]
                yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    source = df.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{column}`").alias("__json"))
    return source.mapInArrow(run, schema)


def _keeps(df: DataFrame, column: str, keep: list[str] | None) -> list[str]:
    return [c for c in df.columns if c != column] if keep is None else keep


def _scan(src: bytes, request: m.Request, limits: Limits | None) -> m.Result:
    return walk.scan(src, request) if limits is None else scan_controlled(src, request, limits.control())


def answers(df: DataFrame, column: str, request: m.Request, keep: list[str] | None = None, mode: str = "failfast", limits: Limits | None = None) -> DataFrame:
    """Adds answers (one struct a demand) and issues for each row's text; null texts have null answers.

    mode failfast: a refused text fails the query; permissive: its answers are null and its refusal is an issue. limits
    bound the reading of each text; a text beyond them is refused, too.
    """

    def each(src: bytes | None) -> Iterator[tuple]:
        if src is None:
            yield None, []
            return
        try:
            r = _scan(src, request, limits)
            yield [answer_row(src, a) for a in r.answers], [_issue(i) for i in r.issues]
        except JsonError as error:
            if mode == "failfast":
                raise
            yield None, [_issue(error.issue())]

    for d in request.demands:
        walk.refuse_containers(d)
    return _mapped(df, column, _keeps(df, column, keep), RESULT, each)


def records(df: DataFrame, column: str, request: m.Request, keep: list[str] | None = None) -> DataFrame:
    """One row a record of each text's stream: ordinal, answers, issues. A text that isn't a stream is one record."""

    def each(src: bytes | None) -> Iterator[tuple]:
        if src is not None:
            for i, r in walk.scan_each(src, request):
                yield i, [answer_row(src, a) for a in r.answers], [_issue(x) for x in r.issues]

    return _mapped(df, column, _keeps(df, column, keep), [T.StructField("ordinal", T.LongType()), *RESULT], each)


def rows(df: DataFrame, column: str, demand: m.Demand, keep: list[str] | None = None, ordinal: str | None = None, mode: str = "failfast", on_mismatch: str = "empty", limits: Limits | None = None, window: m.Range | None = None, **options: Any) -> DataFrame:
    """The rows of a row demand over each text: one column a field, holding the authored text; null where absent.

    JSON null is the text null. ordinal names a column for the row's place in its text. A missing or mismatched target
    has no rows, or raises with on_mismatch="raise". window keeps some of each text's rows, by their places. options go to the request: framing, strictness, dialect.
    """
    walk.refuse_containers(demand)
    request = m.Request((demand,), **options)
    names = ["value" if f == "$" else f for f in m.fields_of(demand)]
    fields = [*([T.StructField(ordinal, T.LongType())] if ordinal else []), *[T.StructField(n, T.StringType()) for n in names]]

    def each(src: bytes | None) -> Iterator[tuple]:
        if src is None:
            return
        try:
            answer = _scan(src, request, limits).answers[0]
        except JsonError:
            if mode == "failfast":
                raise
            return
        if isinstance(answer, m.Columns):
            answer = answer if window is None else answer.windowed(window)
            for i, r in enumerate(answer.rows):
                cells = tuple([None if c is None else src[c[0] : c[1]] for c in r])
                yield (i, *cells) if ordinal else cells
        elif on_mismatch == "raise" and not isinstance(answer, m.Document):
            raise JsonError("Shape", "invalid-shape", 0, f"no rows: {answer}")

    return _mapped(df, column, _keeps(df, column, keep), fields, each)


def value(df: DataFrame, column: str, demand: m.Demand, out: str = "value", keep: list[str] | None = None, mode: str = "failfast", limits: Limits | None = None, **options: Any) -> DataFrame:
    """Adds the text of a path's value, or an oracle's answer as text (names as a JSON array); null if there is none."""
    request = m.Request((demand,), **options)

    def each(src: bytes | None) -> Iterator[tuple]:
        made = None
        try:
            answer = _scan(src, request, limits).answers[0] if src is not None else m.Missing()
        except JsonError:
            if mode == "failfast":
                raise
            answer = m.Missing()
        if isinstance(answer, m.Document):
            made = src[answer.start : answer.end]
        elif isinstance(answer, m.OracleAnswer):
            from lodestream.functions.encode import encode_value

            made = answer.value if isinstance(answer.value, str) else encode_value(answer.value).decode() if isinstance(answer.value, list) else str(answer.value).lower()
        yield (made,)

    return _mapped(df, column, _keeps(df, column, keep), [T.StructField(out, T.StringType())], each)


def validate(df: DataFrame, column: str, dialect: str = "rfc8259", out: str = "issue", keep: list[str] | None = None) -> DataFrame:
    """Adds what a strict reading refuses, as a struct; null where nothing is refused, and for null texts."""

    def each(src: bytes | None) -> Iterator[tuple]:
        found = None if src is None else walk.validate(src, dialect)
        yield (None if found is None else _issue(found),)

    keep = df.columns if keep is None else keep
    return _mapped(df, column, keep, [T.StructField(out, ISSUE)], each)


def _or_issue(mode: str, out: str, each: Callable[[bytes], str | None]) -> tuple[list[T.StructField], Callable[[bytes | None], Iterator[tuple]]]:
    """Fields and function of an operator that gives one text, or in mode permissive its refusal as `issue`."""
    fields = [T.StructField(out, T.StringType()), *([T.StructField("issue", ISSUE)] if mode == "permissive" else [])]

    def run(src: bytes | None) -> Iterator[tuple]:
        made, issue = None, None
        try:
            made = None if src is None else each(src)
        except JsonError as error:
            if mode == "failfast":
                raise
            issue = _issue(error.issue())
        yield (made, issue) if mode == "permissive" else (made,)

    return fields, run


def materialized(df: DataFrame, column: str, demand: m.Demand, out: str = "value", keep: list[str] | None = None, mode: str = "failfast", **options: Any) -> DataFrame:
    """Adds a demand's value as canonical text: rows become an array of objects without their absent members.

    In mode permissive also issue: a refusal, with its place in the whole text.
    """
    from lodestream.functions.encode import Options, encode_value

    request = m.Request((demand,), **options)

    def each(src: bytes) -> str | None:
        answer = walk.scan(src, request).answers[0]
        made = isinstance(answer, (m.Document, m.Columns))
        return encode_value(walk.materialize(src, answer, request.dialect), Options(dialect=request.dialect)).decode() if made else None

    return _mapped(df, column, _keeps(df, column, keep), *_or_issue(mode, out, each))


EVENT = T.StructType([T.StructField("event", T.StringType()), T.StructField("demand", T.IntegerType()), T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
COUNTERS = T.StructType([T.StructField(n, T.LongType()) for n in ("demands", "answered", "skips", "skipped_bytes", "polls", "stops")])


def traced(df: DataFrame, column: str, request: m.Request, keep: list[str] | None = None, mode: str = "failfast", limits: Limits | None = None) -> DataFrame:
    """As answers(), with events and counters of the reading: one mark a demand, skipped regions, an early stop."""

    def each(src: bytes | None) -> Iterator[tuple]:
        if src is None:
            yield None, [], [], None
            return
        try:
            r, t = scan_traced(src, request, None if limits is None else limits.control())
            yield [answer_row(src, a) for a in r.answers], [_issue(i) for i in r.issues], [dict(zip(EVENT.names, e, strict=True)) for e in t.events], t.counters
        except JsonError as error:
            if mode == "failfast":
                raise
            yield None, [_issue(error.issue())], [], None

    return _mapped(df, column, _keeps(df, column, keep), [*RESULT, T.StructField("events", T.ArrayType(EVENT)), T.StructField("counters", COUNTERS)], each)


def encoded(df: DataFrame, column: str, out: str = "encoded", options: Any = None, dialect: str = "rfc8259", verbatim: bool = False, keep: list[str] | None = None, mode: str = "failfast", strictness: str = "strict") -> DataFrame:
    """Adds each text, strictly read and written again: as values, or as its own tokens with verbatim or a comment dialect.

    Documents of a less strict reading are refused by the writer of tokens. In mode permissive also issue.
    """
    from lodestream.functions.encode import Options, compacted, encode_document, encode_value

    options = replace(options or Options(), dialect=dialect)
    request = m.Request((m.Whole(),), strictness=strictness, dialect=dialect)

    def each(src: bytes) -> str:
        answer = walk.scan(src, request).answers[0]
        if dialect != "rfc8259" or verbatim:
            return encode_document(src, answer, options, verbatim).decode()
        made = compacted(src[answer.start : answer.end], options) if strictness != "lazy" else None
        return (encode_value(walk.materialize(src, answer), options) if made is None else made).decode()

    return _mapped(df, column, df.columns if keep is None else keep, *_or_issue(mode, out, each))


def edited(df: DataFrame, column: str, edits: list, out: str = "edited", dialect: str = "rfc8259", keep: list[str] | None = None, mode: str = "failfast") -> DataFrame:
    """Adds each text after the edits, all bytes that they don't touch as they were; null texts stay null.

    In mode permissive also issue: why the edits were refused.
    """
    from lodestream.functions.edit import edit

    return _mapped(df, column, df.columns if keep is None else keep, *_or_issue(mode, out, lambda src: edit(src, edits, dialect).decode()))


def edited_documents(df: DataFrame, column: str, edits: list, out: str = "edited", dialect: str = "rfc8259", keep: list[str] | None = None) -> DataFrame:
    """As edited(), with the edited text's root as a strictly read document: its cell and its comments."""
    from lodestream.functions.edit import edit_document

    def each(src: bytes | None) -> Iterator[tuple]:
        if src is None:
            yield None, None
            return
        text, doc = edit_document(src, edits, dialect)
        yield text.decode(), answer_row(text, doc)

    return _mapped(df, column, df.columns if keep is None else keep, [T.StructField(out, T.StringType()), T.StructField("document", ANSWER)], each)


def total(df: DataFrame, column: str, demand: m.Demand, **options: Any) -> DataFrame:
    """The sum of a count demand over all texts, as n: partial sums in each task, one final sum. Other demands are refused."""
    if m.shard(demand) != "sum":
        raise JsonError("Shape", "invalid-shape", 0, "only counts add up")
    counts = value(df, column, demand, out="n", keep=[], **options)
    return counts.agg(F.coalesce(F.sum(F.col("n").cast("long")), F.lit(0)).alias("n"))
