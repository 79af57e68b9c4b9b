import pytest

from lodestream.functions.values import Number
from lodestream.plans import model as m
from lodestream.plans.build import at, field

S = m.steps


@pytest.mark.parametrize(
    ("built", "want"),
    [
        (at().whole(), m.Whole()), (at("a", 0).whole(), m.Path(S("a", 0))), (at("a")["b"][-1].project("x"), m.Project(S("a", "b", -1), ("x",))),
        (at("a").rows(), m.Path(S("a"), m.Collection())), (at().collect("x", "y"), m.Collection(("x", "y"))), (at("a")[:2].collect("x"), m.Path(S("a"), m.Slice(m.Range(None, 2), m.Project((), ("x",))))),
        (at("a")[1:].rows(), m.Path(S("a"), m.Slice(m.Range(1, None)))), (at().each(m.Collection()), m.Collection(None, m.Collection())), (at()[-2:].each(m.Whole()), m.Slice(m.Range(-2, None), m.Whole())),
        (at("a").where(field("q") >= 2.5).project("x"), m.Filter(S("a"), m.Compare("ge", "q", Number("2.5")), ("x",))),
        (at("a")[:3].where(field("q") != "n").rows(), m.Path(S("a"), m.Slice(m.Range(None, 3), m.Filter((), m.Compare("ne", "q", "n"))))),
        (at().where((field("a") == None) & ~(field("b") < 1) | (field("c") == True)).rows(), m.Filter((), m.Or(m.And(m.Compare("eq", "a", None), m.Not(m.Compare("lt", "b", Number("1")))), m.Compare("eq", "c", True)))),  # noqa: E711, E712
        (at("a").count(), m.Path(S("a"), m.Oracle("count"))), (at().has("k"), m.Oracle("has_key", "k")), (at().names(), m.Oracle("member_names")),
    ],
)
def test_expressions_are_demands(built, want):
    assert built == want


def test_places_end_at_windows():
    for bad in (lambda: at()[1:][0], lambda: at()[::2], lambda: at().where(field("a") == 1).each(m.Whole())):
        with pytest.raises(ValueError):
            bad()
