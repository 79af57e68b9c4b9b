"""Demands as Catalyst expressions over VARIANT, for trusted texts.

Equal to the exact path where texts are valid, keys unique, and compared numbers fit DECIMAL(38, 10); spellings are not
kept. plans.gate says which demands qualify. Everything stays in the JVM.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestream.functions.values import Number
from lodestream.plans import model as m

NUMERIC = "decimal(38,10)"


def kind(v: Column) -> Column:
    """null, bool, number, string, array, object; SQL null if absent."""
    s = F.schema_of_variant(v)
    return F.when(F.is_variant_null(v), "null").when(s.startswith("OBJECT"), "object").when(s.startswith("ARRAY"), "array").when(s == "STRING", "string").when(s == "BOOLEAN", "bool").when(v.isNotNull(), "number")


def _path(name: str) -> str:
    return "$['" + name.replace("\\", "\\\\").replace("'", "\\'") + "']"


def member(v: Column, name: str) -> Column:
    return F.try_variant_get(v, _path(name), "variant")


def elements(v: Column) -> Column:
    """The elements of a VARIANT array; null for other kinds."""
    return F.try_variant_get(v, "$", "array<variant>")


def go(v: Column, path: tuple[m.Step, ...]) -> Column:
    for step in path:
        v = member(v, step.name) if isinstance(step, m.Key) else F.try_element_at(elements(v), F.lit(step.at + 1 if step.at >= 0 else step.at))
    return v


def text(v: Column) -> Column:
    """A value's JSON text; absent stays null, JSON null is the text null."""
    return F.to_json(v)


def leaf(row: Column, p: m.Compare) -> Column:
    v = member(row, p.field)
    if isinstance(p.value, bool) and p.op not in ("eq", "ne"):
        # In an order true counts as 1, false as 0.
        return leaf(row, m.Compare(p.op, p.field, Number(str(int(p.value)))))
    if isinstance(p.value, Number):
        typed, own = F.try_variant_get(v, "$", NUMERIC), "number"
        literal = F.lit(p.value.spelling).cast(NUMERIC)
    elif isinstance(p.value, bool):
        typed, own, literal = F.try_variant_get(v, "$", "boolean"), "bool", F.lit(p.value)
    elif p.value is None:
        typed, own, literal = F.lit(1), "null", F.lit(1)
    else:
        typed, own, literal = F.try_variant_get(v, "$", "string"), "string", F.lit(p.value)
    if p.op in ("gt", "lt", "ge", "le") and own != "number":
        return F.lit(False)
    test = {"eq": typed == literal, "ne": typed == literal, "gt": typed > literal, "lt": typed < literal, "ge": typed >= literal, "le": typed <= literal}[p.op]
    found = F.coalesce(F.when(kind(v) == own, test), F.lit(False))
    return ~found if p.op == "ne" else found


def holds(row: Column, p: m.Predicate) -> Column:
    """Two-valued: each leaf is true or false, never null."""
    if isinstance(p, m.And):
        return holds(row, p.left) & holds(row, p.right)
    if isinstance(p, m.Or):
        return holds(row, p.left) | holds(row, p.right)
    if isinstance(p, m.Not):
        return ~holds(row, p.inner)
    return leaf(row, p)


def rows(df: DataFrame, column: str, demand: m.Demand, keep: list[str] | None = None, ordinal: str | None = None) -> DataFrame:
    """As exact.rows() for Project, Filter, Collection and Slice by way of keys, over texts that are trusted."""
    path: tuple[m.Step, ...] = ()
    while isinstance(demand, m.Path) and demand.nested is not None:
        path, demand = path + demand.steps, demand.nested
    flat = isinstance(demand, (m.Project, m.Filter))
    if flat:
        path += demand.path
    names = {*["value" if f == "$" else f for f in m.fields_of(demand)], ordinal}
    keep = [c for c in ([c for c in df.columns if c != column] if keep is None else keep) if c.lower() not in {n.lower() for n in names if n}]
    parsed = df.select(*[F.col(f"`{c}`") for c in keep], F.try_parse_json(column).alias("__v"))
    target = go(F.col("__v"), path)
    # A projection or filter takes an object as one element.
    array = F.coalesce(elements(target), F.when(kind(target) == "object", F.array(target))) if flat else elements(target)
    inner = demand.nested if isinstance(demand, (m.Slice, m.Collection)) else demand
    if isinstance(demand, m.Collection) and inner is None and demand.fields is not None:
        inner = m.Project((), demand.fields)
    if isinstance(demand, m.Slice):
        n = F.size(array)
        edge = lambda at, default: default if at is None else F.least(F.lit(at), n) if at >= 0 else F.greatest(n + F.lit(at), F.lit(0))
        lo, hi = edge(demand.range.start, F.lit(0)), edge(demand.range.end, n)
        array = F.slice(array, lo + 1, F.greatest(hi - lo, F.lit(0)))
    passes = (lambda e: (kind(e) == "object") & holds(e, inner.predicate)) if isinstance(inner, m.Filter) else None
    if passes and ordinal:
        # Ordinals count the rows that remain.
        array = F.filter(array, passes)
    one = parsed.select(*[F.col(f"`{c}`") for c in keep], F.posexplode(array).alias("__pos", "__e"))
    if passes and not ordinal:
        one = one.filter(passes(F.col("__e")))
    fields = m.fields_of(inner) if inner is not None else ("$",)
    if not fields:
        one = one.filter(F.lit(False))
    cells = [text(F.col("__e")).alias("value") if f == "$" else text(member(F.col("__e"), f)).alias(f) for f in fields]
    return one.select(*[F.col(f"`{c}`") for c in keep], *([F.col("__pos").cast("long").alias(ordinal)] if ordinal else []), *cells)


def _plain(path: tuple[m.Step, ...]) -> bool:
    return all(isinstance(s, m.Key) and re.fullmatch(r"\w+", s.name, re.ASCII) for s in path)


def answers_value(demand: m.Demand) -> bool:
    """Whether value() has an expression for the demand."""
    path: tuple[m.Step, ...] = ()
    while isinstance(demand, m.Path):
        path, demand = path + demand.steps, demand.nested or m.Whole()
    if isinstance(demand, m.Oracle):
        return demand.kind not in ("member_names", "descend_count") or _plain(path)
    return isinstance(demand, m.Whole)


def value(df: DataFrame, column: str, demand: m.Demand, out: str = "value", keep: list[str] | None = None) -> DataFrame:
    """As exact.value() for paths and for all oracles; names and counts of descendants only behind plain keys."""
    if not answers_value(demand):
        raise ValueError(f"no native expression for {demand!r}")
    keep = [c for c in ([c for c in df.columns if c != column] if keep is None else keep) if c.lower() != out.lower()]
    path: tuple[m.Step, ...] = ()
    while isinstance(demand, m.Path):
        path, demand = path + demand.steps, demand.nested or m.Whole()
    parsed = df.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{column}`").alias("__t"), F.try_parse_json(column).alias("__v"))
    v = go(F.col("__v"), path)
    if isinstance(demand, m.Whole):
        made = text(v)
    else:
        own = F.get_json_object("__t", "$" + "".join(f".{s.name}" for s in path)) if path and _plain(path) else F.col("__t")
        # VARIANT sorts names; the text has them in their order.
        names = F.json_object_keys(own)
        # Without strings and gaps, each comma and each container that isn't empty stands for one value more.
        bare = F.regexp_replace(own, r'"(?:[^"\\]++|\\.)*+"', "s")
        bare = F.translate(bare, " \t\r\n", "")
        least = F.char_length(bare) - F.char_length(F.translate(bare, ",[{", ""))
        empty = F.char_length(bare) - F.char_length(F.regexp_replace(bare, r"\[\]|\{\}", "x"))
        members = F.size(F.json_object_keys(F.to_json(v)))
        made = {
            "kind": lambda: kind(v),
            "count": lambda: F.when(kind(v) == "array", F.size(elements(v))).when(kind(v) == "object", members).cast("string"),
            "member_count": lambda: F.when(kind(v) == "object", members).cast("string"),
            "has_key": lambda: F.when(kind(v) == "object", member(v, demand.key or "").isNotNull()).cast("string"),
            "member_names": lambda: F.when(kind(v) == "object", F.to_json(names)),
            "descend_count": lambda: F.when(kind(v).isin("array", "object"), 1 + least - empty).otherwise(F.when(v.isNotNull(), F.lit(1))).cast("string"),
            "string_byte_length": lambda: F.when(kind(v) == "string", F.octet_length(F.try_variant_get(v, "$", "string"))).cast("string"),
        }[demand.kind]()
    return parsed.select(*[F.col(f"`{c}`") for c in keep], made.alias(out))
