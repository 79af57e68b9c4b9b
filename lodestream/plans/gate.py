"""Which demands the native path answers as the exact one would."""

from __future__ import annotations

from pyspark.sql import DataFrame

from lodestream.functions.values import Number
from lodestream.plans import model as m


def _narrow(p: m.Predicate) -> bool:
    if isinstance(p, (m.And, m.Or)):
        return _narrow(p.left) and _narrow(p.right)
    if isinstance(p, m.Not):
        return _narrow(p.inner)
    n = Number(str(int(p.value))) if isinstance(p.value, bool) and p.op not in ("eq", "ne") else p.value
    if isinstance(n, Number):
        if not n.digits:
            # VARIANT drops the sign of -0, which comes before 0; above and not above don't tell them apart.
            return not n.negative and p.op in ("gt", "le")
        return n.finite and len(n.digits) <= 28 and -20 <= n.scale <= 10
    return not isinstance(p.value, (list, dict))


def native(demand: m.Demand, request: m.Request, trusted: bool) -> bool:
    """Only for texts that the caller vouches for: valid, with unique keys and numbers within DECIMAL(38, 10)."""
    if not trusted or request.dialect != "rfc8259" or request.strictness == "strict" or request.framing != "text" or request.facts:
        return False
    match demand:
        case m.Path(path, nested) if all(isinstance(s, m.Key) for s in path):
            return nested is None or native(nested, request, trusted)
        case m.Project(path, _) if all(isinstance(s, m.Key) for s in path):
            return True
        case m.Filter(path, p, _) if all(isinstance(s, m.Key) for s in path):
            return _narrow(p)
        case m.Collection(_, nested) | m.Slice(_, nested):
            return nested is None or isinstance(nested, (m.Project, m.Filter)) and not nested.path and native(nested, request, trusted)
        case m.Whole() | m.Oracle():
            return True
    return False


def rows(df: DataFrame, column: str, demand: m.Demand, trusted: bool = False, **options) -> DataFrame:
    """Rows by the native path if the gate lets it, else by the exact one.

    The caller's promise covers the texts' numbers: what an operand within ten decimals is compared with must be, too.
    """
    from lodestream.operators import exact
    from lodestream.operators import native as quick

    own = {k: options.pop(k) for k in ("keep", "ordinal") if k in options}
    if not options and m.makes_rows(demand) and native(demand, m.Request((demand,)), trusted):
        return quick.rows(df, column, demand, **own)
    return exact.rows(df, column, demand, **own, **options)


def value(df: DataFrame, column: str, demand: m.Demand, trusted: bool = False, **options) -> DataFrame:
    """A path's value or an oracle's answer by the native path if the gate lets it, else by the exact one.

    A native value is VARIANT's spelling: without gaps, members by name.
    """
    from lodestream.operators import exact
    from lodestream.operators import native as quick

    own = {k: options.pop(k) for k in ("keep", "out") if k in options}
    if not options and not m.makes_rows(demand) and quick.answers_value(demand) and native(demand, m.Request((demand,)), trusted):
        return quick.value(df, column, demand, **own)
    return exact.value(df, column, demand, **own, **options)
