"""Demands and predicates written as expressions.

    at("items").where((field("q") > 30) & (field("f") == "N")).project("n", "p")
    at("items")[:2].collect("n")
    at("items", -1).project("n", "q")
    at().count()
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from lodestream.functions import values
from lodestream.plans import model as m


class Test:
    """A predicate that combines with &, | and ~."""

    def __init__(self, predicate: m.Predicate):
        self.predicate = predicate

    def __and__(self, other: Test) -> Test:
        return Test(m.And(self.predicate, other.predicate))

    def __or__(self, other: Test) -> Test:
        return Test(m.Or(self.predicate, other.predicate))

    def __invert__(self) -> Test:
        return Test(m.Not(self.predicate))


class field:  # noqa: N801  reads as a word of the expression
    """A member of the row that a predicate looks at; operands are plain Python data, numbers also Numbers."""

    __hash__ = None

    def __init__(self, name: str):
        self.name = name

    def _test(self, op: str, value: Any) -> Test:
        return Test(m.Compare(op, self.name, values.of(value)))

    def __eq__(self, value: Any) -> Test:  # type: ignore[override]
        return self._test("eq", value)

    def __ne__(self, value: Any) -> Test:  # type: ignore[override]
        return self._test("ne", value)

    def __gt__(self, value: Any) -> Test:
        return self._test("gt", value)

    def __lt__(self, value: Any) -> Test:
        return self._test("lt", value)

    def __ge__(self, value: Any) -> Test:
        return self._test("ge", value)

    def __le__(self, value: Any) -> Test:
        return self._test("le", value)


@dataclass(frozen=True)
class At:
    """A place, and what is asked there: each method gives a demand, indexing goes on, a slice takes a window of elements."""

    steps: tuple[m.Step, ...] = ()
    window: m.Range | None = None
    test: Test | None = None

    def __getitem__(self, step: str | int | slice) -> At:
        if self.window is not None or self.test is not None:
            raise ValueError("a place can't go on behind a window or a predicate")
        if isinstance(step, slice):
            if step.step not in (None, 1):
                raise ValueError("windows have no step")
            return At(self.steps, m.Range(step.start, step.stop))
        return At(self.steps + m.steps(step))

    def where(self, test: Test) -> At:
        return At(self.steps, self.window, test if self.test is None else self.test & test)

    def _here(self, demand: m.Demand) -> m.Demand:
        return m.Path(self.steps, demand) if self.steps else demand

    def _rows(self, fields: tuple[str, ...]) -> m.Demand:
        if self.window is None:
            return m.Filter(self.steps, self.test.predicate, fields) if self.test is not None else m.Project(self.steps, fields)
        inner = m.Filter((), self.test.predicate, fields) if self.test is not None else m.Project((), fields) if fields else None
        return self._here(m.Slice(self.window, inner))

    def project(self, *fields: str) -> m.Demand:
        """These members of each row; of an object, of itself."""
        return self._rows(fields)

    def rows(self) -> m.Demand:
        """Each row as a whole."""
        return self._rows(()) if self.test is not None or self.window is not None else self._here(m.Collection())

    def collect(self, *fields: str) -> m.Demand:
        """These members of each element of an array."""
        return self._rows(fields) if self.test is not None or self.window is not None else self._here(m.Collection(fields))

    def each(self, demand: m.Demand) -> m.Demand:
        """A demand on each element."""
        if self.test is not None:
            raise ValueError("a predicate has no nested demand")
        return self._here(m.Collection(None, demand) if self.window is None else m.Slice(self.window, demand))

    def whole(self) -> m.Demand:
        return m.Path(self.steps) if self.steps else m.Whole()

    def _ask(self, kind: str, key: str | None = None) -> m.Demand:
        return self._here(m.Oracle(kind, key))

    def count(self) -> m.Demand:
        return self._ask("count")

    def descend_count(self) -> m.Demand:
        return self._ask("descend_count")

    def kind(self) -> m.Demand:
        return self._ask("kind")

    def has(self, key: str) -> m.Demand:
        return self._ask("has_key", key)

    def names(self) -> m.Demand:
        return self._ask("member_names")

    def member_count(self) -> m.Demand:
        return self._ask("member_count")

    def byte_length(self) -> m.Demand:
        return self._ask("string_byte_length")


def at(*steps: str | int) -> At:
    return At(m.steps(*steps))
