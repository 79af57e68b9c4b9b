"""Scalar functions over columns that hold one JSON value's text: typed reads that never convert across kinds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_INTEGER, _NUMBER = r"^-?(0|[1-9][0-9]*)$", r"^-?(0|[1-9][0-9]*)(\.[0-9]+)?([eE][+-]?[0-9]+)?$"


def kind(cell: Column) -> Column:
    """null, bool, number, string, array or object by the first character; SQL null for an absent cell."""
    c = F.substring(cell, 1, 1)
    return F.when(c == "{", "object").when(c == "[", "array").when(c == '"', "string").when(c.isin("t", "f"), "bool").when(c == "n", "null").when(cell.isNotNull(), "number")


def as_i64(cell: Column) -> Column:
    """Integers as they are spelled; 1.0 and 1e2 are none, nor is what doesn't fit."""
    return F.when(cell.rlike(_INTEGER), cell.try_cast("long"))


def as_u64(cell: Column) -> Column:
    """Integers as they are spelled, from 0 to 2 ** 64 - 1, as decimals; -0 is one, other negative ones aren't."""
    wide = F.when(cell.rlike(_INTEGER), cell.try_cast("decimal(38,0)"))
    return F.when(wide.between(0, F.lit("18446744073709551615").cast("decimal(38,0)")), wide)


def as_i128(cell: Column) -> Column:
    """Integers of up to 38 digits."""
    return F.when(cell.rlike(_INTEGER), cell.try_cast("decimal(38,0)"))


def as_f64(cell: Column) -> Column:
    return F.when(cell.rlike(_NUMBER), cell.try_cast("double"))


def as_bool(cell: Column) -> Column:
    return F.when(cell == "true", F.lit(True)).when(cell == "false", F.lit(False))


def as_str(cell: Column) -> Column:
    """The text of a string cell, escapes decoded."""
    return F.when(kind(cell) == "string", F.get_json_object(F.concat(F.lit("["), cell, F.lit("]")), "$[0]"))


def is_json_null(cell: Column) -> Column:
    """Whether a cell holds JSON null; false for absent cells."""
    return F.coalesce(cell == "null", F.lit(False))


def string_byte_length(cell: Column) -> Column:
    return F.octet_length(as_str(cell))


def elements(cell: Column) -> Column:
    """An array cell's elements as texts (spellings as VARIANT writes them)."""
    return F.transform(F.try_variant_get(F.try_parse_json(cell), "$", "array<variant>"), lambda v: F.to_json(v))


def field_column(answer: Column, at: int) -> Column:
    """One column of an answer's batch: the cells' texts, null where absent."""
    return F.transform(answer["rows"], lambda r: r[at]["text"])


def row_object(cells: dict[str, Column]) -> Column:
    """An object of named cells, absent ones left out; each cell's text goes in as it is."""
    from lodestream.functions.encode import quoted

    parts = [F.when(c.isNotNull(), F.concat(F.lit(quoted(name) + ":"), c)) for name, c in cells.items()]
    return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))
