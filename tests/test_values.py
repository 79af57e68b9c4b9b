"""Numbers and values: exact order whatever the spelling, and navigation."""

import itertools
from decimal import Decimal

import pytest
from hypothesis import given
from hypothesis import strategies as st

from lodestream.functions import values as v
from lodestream.plans.model import And, Compare, JsonError, Not, Or, Range

N = v.Number


@pytest.mark.parametrize(
    ("a", "b", "order"),
    [("2", "10", -1), ("10", "9", 1), ("2", "2.5", -1), ("2.0", "2", 0), ("1e2", "99", 1), ("100", "1e2", 0), ("-2", "-10", 1), ("0.09", "0.1", -1), ("1.50", "1.5", 0), ("-0", "0", -1), ("0", "0.0", 0), ("-0.0", "-0", 0), ("1e1000000000", "9e999999999", 1)],
)
def test_order(a, b, order):
    assert N(a).compare(N(b)) == order
    assert N(b).compare(N(a)) == -order


@pytest.mark.parametrize("text", ["", "+", "-", ".", "e2", "1e", "x", "12abc", "1_000", "0x10", "Infinity", "1.5x", "1.2.3", "1e2x"])
def test_refused(text):
    with pytest.raises(JsonError):
        N(text)


@given(st.decimals(allow_nan=False, allow_infinity=False), st.decimals(allow_nan=False, allow_infinity=False))
def test_order_is_decimals(a, b):
    if a == 0 and b == 0:
        return
    assert N(str(a)).compare(N(str(b))) == (a > b) - (a < b)


def test_reads_of_integers():
    assert N("9223372036854775807").to_int() == 2**63 - 1
    assert N("9223372036854775808").to_int() is None
    assert N("1.0").to_int() is None and N("1e2").to_int() is None
    assert N("-1").to_int(signed=False) is None
    assert N("1" * 60).to_int(None) == int("1" * 60)


def test_equality():
    a, b = {"x": N("1.0"), "y": [True]}, {"y": [True], "x": N("1")}
    assert v.equal(a, b) and not v.strict_equal(a, b)
    assert not v.equal(True, N("1")) and v.compare(True, N("1")) == 0
    assert v.compare("a", "b") is None
    nan = N("NaN", special=True)
    assert nan == N("NaN", special=True) and nan.compare(nan) is None


@pytest.mark.parametrize(("n", "at", "want"), [(3, 0, 0), (3, 2, 2), (3, 3, None), (3, -1, 2), (3, -3, 0), (3, -4, None), (0, 0, None)])
def test_resolve_index(n, at, want):
    assert v.resolve_index(n, at) == want


def test_windows_are_slices():
    for n, lo, hi in itertools.product(range(4), [None, *range(-5, 6)], [None, *range(-5, 6)]):
        assert list(Range(lo, hi).window(n)) == list(range(n))[lo:hi]


def test_matches():
    row = {"a": N("1"), "b": None}
    assert v.matches(row, Compare("ne", "absent", N("1"))) and not v.matches(row, Compare("eq", "absent", N("1")))
    assert v.matches(row, And(Compare("eq", "b", None), Not(Or(Compare("gt", "a", N("1")), Compare("lt", "a", N("1"))))))
    assert not v.matches(row, Compare("gt", "b", N("0")))


def test_decimal_spelling_survives():
    assert N("1.50").spelling == "1.50" and Decimal(N("1.50").spelling) == Decimal("1.5")
