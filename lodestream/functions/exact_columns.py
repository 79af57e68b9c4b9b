"""Column functions with the exact reader's semantics, for what Spark's own JSON functions lose: spellings, order, decimals.

Each is one vectorised Python function over Arrow batches; a null cell gives null. Cells hold one JSON text each.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from lodestream.functions import values
from lodestream.functions.encode import encode_value
from lodestream.functions.lexer import parse
from lodestream.operators.shipping import ship
from lodestream.plans import model as m


def _column(f: Callable[..., Any], kind: str, *cells: Column) -> Column:
    ship(SparkSession.getActiveSession())

    def run(*batch: pd.Series) -> pd.Series:
        return pd.Series([None if any(v is None for v in row) else f(*row) for row in zip(*batch, strict=True)], dtype=object)

    return F.pandas_udf(run, kind)(*cells)


def _text(v: Any) -> str:
    return encode_value(v).decode()


def display(cell: Column, dialect: str = "rfc8259") -> Column:
    """The value's canonical text: spellings of numbers stay, a repeated name has its last value in its first place."""
    return _column(lambda s: _text(parse(s, dialect)), "string", cell)


def equal(a: Column, b: Column) -> Column:
    """Numbers by value, objects by name whatever the order."""
    return _column(lambda x, y: values.equal(parse(x), parse(y)), "boolean", a, b)


def strict_equal(a: Column, b: Column) -> Column:
    """Spellings, order and count matter, too."""
    return _column(lambda x, y: values.strict_equal(parse(x), parse(y)), "boolean", a, b)


def order(a: Column, b: Column) -> Column:
    """-1, 0 or 1 by value for numbers and bools; null for all else."""
    return _column(lambda x, y: values.compare(parse(x), parse(y)), "int", a, b)


def matches(cell: Column, predicate: m.Predicate) -> Column:
    """Whether the predicate holds for the value; what isn't an object satisfies ne alone."""
    return _column(lambda s: values.matches(parse(s), predicate), "boolean", cell)


def member(cell: Column, name: str) -> Column:
    """The text of a member's value; null where there is none."""

    def f(s: str) -> str | None:
        v = parse(s)
        return _text(v[name]) if isinstance(v, dict) and name in v else None

    return _column(f, "string", cell)


def element(cell: Column, at: int) -> Column:
    """The text of an element, a negative index from the end; null where there is none."""

    def f(s: str) -> str | None:
        v = parse(s)
        i = values.resolve_index(len(v), at) if isinstance(v, list) else None
        return None if i is None else _text(v[i])

    return _column(f, "string", cell)


def elements(cell: Column) -> Column:
    """The texts of an array's elements; null for other kinds."""

    def f(s: str) -> list[str] | None:
        v = parse(s)
        return list(map(_text, v)) if isinstance(v, list) else None

    return _column(f, "array<string>", cell)


def members(cell: Column) -> Column:
    """An object's (name, value) pairs in authored order, values as texts; null for other kinds."""

    def f(s: str) -> list[dict] | None:
        v = parse(s)
        return [{"name": k, "value": _text(y)} for k, y in v.items()] if isinstance(v, dict) else None

    return _column(f, "array<struct<name:string,value:string>>", cell)


def length(cell: Column) -> Column:
    """An array's elements, an object's members, a string's bytes; null for other kinds."""

    def f(s: str) -> int | None:
        v = parse(s)
        return len(v.encode()) if isinstance(v, str) else len(v) if isinstance(v, (list, dict)) else None

    return _column(f, "long", cell)


def _number(s: str) -> values.Number | None:
    v = parse(s)
    return v if isinstance(v, values.Number) else None


def coefficient(cell: Column) -> Column:
    """A number's digits without its sign, leading zeros and point; a zero's are 0."""
    return _column(lambda s: None if (n := _number(s)) is None else n.digits or "0", "string", cell)


def scale(cell: Column) -> Column:
    """How many of the coefficient's digits stand after the point; negative for large exponents."""
    return _column(lambda s: None if (n := _number(s)) is None else n.scale, "long", cell)


def negative(cell: Column) -> Column:
    """Whether a number has a minus; -0 has one."""
    return _column(lambda s: None if (n := _number(s)) is None else n.negative, "boolean", cell)


def complete_prefix(cell: Column, framing: str) -> Column:
    """Bytes of a growing buffer that hold complete records."""
    from lodestream.sources.framing import complete_prefix as f

    return _column(lambda s: f(s.encode(), framing), "long", cell)


def partition(cell: Column, framing: str, target: int) -> Column:
    """A stream's text in parts of whole records, about target bytes each."""
    from lodestream.sources.framing import partition as f

    def run(s: str) -> list[str]:
        src = s.encode()
        return [src[a:b].decode() for a, b in f(src, framing, target)]

    return _column(run, "array<string>", cell)
