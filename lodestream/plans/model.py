"""Demands as plain values: what to locate in a JSON text, and how answers of parts fold together."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

MAX_NESTING = 256
STRICTNESS = ("strict", "structural", "lazy")
DIALECTS = ("rfc8259", "jsonc", "json5")
FRAMINGS = ("text", "adjacent", "ndjson", "jsonseq")


@dataclass(frozen=True)
class Key:
    name: str


@dataclass(frozen=True)
class Index:
    """An array element; negative from the end."""

    at: int


Step = Key | Index


def steps(*parts: str | int | Step) -> tuple[Step, ...]:
    """Steps from names and numbers: steps("users", 0, "id")."""
    return tuple(p if isinstance(p, (Key, Index)) else Index(p) if isinstance(p, int) else Key(p) for p in parts)


@dataclass(frozen=True)
class Range:
    """A half-open window with the rules of Python's slices; None is an edge."""

    start: int | None = None
    end: int | None = None

    def window(self, n: int) -> range:
        lo, hi, _ = slice(self.start, self.end).indices(n)
        return range(lo, max(lo, hi))

    @property
    def bounded(self) -> bool:
        """Whether the window ends at a place that is known before the array's length is."""
        return (self.start or 0) >= 0 and self.end is not None and self.end >= 0


# Predicates over an object row; each names one member of the row.
@dataclass(frozen=True)
class Compare:
    """op: eq, ne, gt, lt, ge, le; value: a value of lodestream.functions.values."""

    op: str
    field: str
    value: Any


@dataclass(frozen=True)
class And:
    left: Predicate
    right: Predicate


@dataclass(frozen=True)
class Or:
    left: Predicate
    right: Predicate


@dataclass(frozen=True)
class Not:
    inner: Predicate


Predicate = Compare | And | Or | Not


@dataclass(frozen=True)
class Whole:
    pass


@dataclass(frozen=True)
class Path:
    steps: tuple[Step, ...]
    nested: Demand | None = None


@dataclass(frozen=True)
class Collection:
    """One row an element: its fields, or the rows of a nested demand, or the element as the column "$"."""

    fields: tuple[str, ...] | None = None
    nested: Demand | None = None


@dataclass(frozen=True)
class Slice:
    range: Range
    nested: Demand | None = None


@dataclass(frozen=True)
class Project:
    path: tuple[Step, ...]
    fields: tuple[str, ...]


@dataclass(frozen=True)
class Filter:
    """Rows that satisfy the predicate: their fields, or the whole row as "$" without any."""

    path: tuple[Step, ...]
    predicate: Predicate
    project: tuple[str, ...] = ()


@dataclass(frozen=True)
class Oracle:
    """kind: count, descend_count, kind, has_key, member_names, member_count, string_byte_length."""

    kind: str
    key: str | None = None


Demand = Whole | Path | Collection | Slice | Project | Filter | Oracle

ORACLES = ("count", "descend_count", "kind", "has_key", "member_names", "member_count", "string_byte_length")


def fields_of(demand: Demand) -> tuple[str, ...]:
    """The columns of a demand's rows."""
    match demand:
        case Project(_, fields):
            return fields
        case Filter(_, _, project):
            return project or ("$",)
        case Collection(_, nested) | Slice(_, nested) | Path(_, nested) if nested is not None:
            return fields_of(nested)
        case Collection(fields, None) if fields is not None:
            return fields
    return ("$",)


def makes_rows(demand: Demand) -> bool:
    match demand:
        case Path(_, nested):
            return nested is not None and makes_rows(nested)
        case Collection() | Slice() | Project() | Filter():
            return True
    return False


def shard(demand: Demand) -> str:
    """serial: one task sees the whole text; concat: parts' rows follow one another; sum: parts' counts add up."""

    def keys(path: tuple[Step, ...]) -> bool:
        return all(isinstance(s, Key) for s in path)

    match demand:
        case Project(path, _) | Filter(path, _, _) if keys(path):
            return "concat"
        case Collection(_, None):
            return "concat"
        case Collection(None, Project(path, _) | Filter(path, _, _)) if not path:
            return "concat"
        case Path(path, Oracle("count")) if keys(path):
            return "sum"
        case Oracle("count"):
            return "sum"
    return "serial"


@dataclass(frozen=True)
class Request:
    """Demands and how to read: strictness, dialect, framing, nesting bound, and whether to keep comments."""

    demands: tuple[Demand, ...]
    framing: str = "text"
    strictness: str = "structural"
    dialect: str = "rfc8259"
    max_nesting: int = MAX_NESTING
    facts: bool = False

    def __post_init__(self) -> None:
        for value, known in ((self.framing, FRAMINGS), (self.strictness, STRICTNESS), (self.dialect, DIALECTS)):
            if value not in known:
                raise ValueError(f"{value!r} is none of {known}")


# Answers.
@dataclass(frozen=True)
class Document:
    """A located value: its bytes start..end, whether all of it was checked, its dialect, and its comments."""

    start: int
    end: int
    validated: bool = False
    grammar: str = "rfc8259"
    facts: tuple[Fact, ...] = ()


@dataclass(frozen=True)
class Columns:
    """Rows of spans (start, end), None for an absent member."""

    fields: tuple[str, ...]
    rows: list[tuple[tuple[int, int] | None, ...]] = field(default_factory=list)

    def column(self, i: int) -> list[tuple[int, int] | None]:
        return [r[i] for r in self.rows]

    def windowed(self, window: Range) -> Columns:
        r = window.window(len(self.rows))
        return Columns(self.fields, self.rows[r.start : r.stop])


@dataclass(frozen=True)
class OracleAnswer:
    kind: str
    value: Any


@dataclass(frozen=True)
class Missing:
    pass


@dataclass(frozen=True)
class TypeMismatch:
    actual: str


Answer = Document | Columns | OracleAnswer | Missing | TypeMismatch


@dataclass(frozen=True)
class Fact:
    """A comment and the value it belongs to; role: lead, foot or inline."""

    role: str
    start: int
    end: int
    owner_start: int
    owner_end: int


@dataclass(frozen=True)
class Issue:
    cls: str
    code: str
    message: str
    offset: int


class JsonError(ValueError):
    """A refusal: its class, its code, and the byte where it arose."""

    def __init__(self, cls: str, code: str, offset: int = 0, message: str = ""):
        super().__init__(message or f"{code} at byte {offset}")
        self.cls, self.code, self.offset = cls, code, min(offset, 0xFFFFFFFF)

    def issue(self) -> Issue:
        return Issue(self.cls, self.code, str(self), self.offset)


@dataclass(frozen=True)
class Result:
    answers: list[Answer]
    issues: list[Issue] = field(default_factory=list)
