"""Edits of JSON text that leave all other bytes as they are.

All edits are located in one strict reading, become splices, and are applied from the end. Where an edit has no place in
the text, or the spliced text can't be read again, the edits are applied one after another to the value instead, and the
result is written compactly.
"""

from __future__ import annotations

from copy import deepcopy
from dataclasses import dataclass, replace
from typing import Any

from lodestream.functions import values
from lodestream.functions.encode import Options, encode_value, quoted
from lodestream.functions.facts import facts_of
from lodestream.functions.lexer import CHECKED, FULL, Node, Plain, Reader, Want, check, merged, parse
from lodestream.plans.model import Document, Fact, Index, JsonError, Key, Step


@dataclass(frozen=True)
class Set:
    """Replaces a value that is there."""

    path: tuple[Step, ...]
    value: Any


@dataclass(frozen=True)
class Insert:
    """A new member, or the new value of one that is there; or an element before an index from 0 to the length."""

    path: tuple[Step, ...]
    value: Any


@dataclass(frozen=True)
class Delete:
    path: tuple[Step, ...]


@dataclass(frozen=True)
class ReplaceMember:
    """A member's new name and value, in its place."""

    path: tuple[Step, ...]
    key: str
    value: Any


@dataclass(frozen=True)
class Clear:
    """Empties a container."""

    path: tuple[Step, ...]


@dataclass(frozen=True)
class Comment:
    """action: insert, replace or clear; role: lead, foot or inline. Texts without comments ignore it."""

    path: tuple[Step, ...]
    action: str
    role: str
    text: str = ""


Edit = Set | Insert | Delete | ReplaceMember | Clear | Comment
Splice = tuple[int, int, bytes]


def _unplaceable(at: int = 0) -> JsonError:
    return JsonError("Write", "edit-unplaceable", at)


def _child(node: Node, step: Step) -> Node | None:
    if isinstance(step, Key):
        return node.by_name().get(step.name) if node.kind == "object" else None
    i = values.resolve_index(len(node.items), step.at) if node.kind == "array" else None
    return None if i is None else node.items[i]


def _locate(root: Node, path: tuple[Step, ...]) -> Node | None:
    node: Node | None = root
    for step in path:
        node = _child(node, step) if node is not None else None
    return node


class _Placer:
    def __init__(self, src: bytes, root: Node, dialect: str, outer: list[tuple[int, int]]):
        self.src, self.root, self.dialect = src, root, dialect
        self.facts = facts_of(src, root, outer) if dialect != "rfc8259" else []
        #: Comments that edits write: (place of the splice, the comment's place in its bytes, its length, the fact it stands for).
        self.written: list[tuple[int, int, int, Fact]] = []

    def text(self, v: Any) -> bytes:
        return encode_value(v, Options(dialect=self.dialect))

    def splices(self, e: Edit) -> list[Splice]:
        if isinstance(e, Comment):
            return self.comment(e)
        node = _locate(self.root, e.path)
        if isinstance(e, Insert):
            return self.insert(e, node)
        if isinstance(e, Delete):
            if not e.path:
                raise JsonError("Write", "write", 0, "the root can't be deleted")
            return [] if node is None else self.delete(_locate(self.root, e.path[:-1]), node)
        if node is None:
            raise _unplaceable()
        if isinstance(e, Set):
            return [(node.start, node.end, self.text(e.value))]
        if isinstance(e, Clear):
            if node.kind not in ("array", "object"):
                raise JsonError("Write", "write", node.start, "only containers can be cleared")
            return [(node.start, node.end, b"[]" if node.kind == "array" else b"{}")]
        parent = _locate(self.root, e.path[:-1])
        if parent is None or parent.kind != "object" or not e.path or e.key in parent.by_name() and e.key != e.path[-1].name:
            raise _unplaceable(node.start)
        key = next(k for _, k, n in parent.members if n is node)
        return [(key, node.end, quoted(e.key).encode() + b":" + self.text(e.value))]

    def insert(self, e: Insert, node: Node | None) -> list[Splice]:
        parent = _locate(self.root, e.path[:-1]) if e.path else None
        if parent is None:
            raise _unplaceable()
        step, text = e.path[-1], self.text(e.value)
        if isinstance(step, Key):
            if parent.kind != "object":
                raise _unplaceable(parent.start)
            if node is not None:
                return [(node.start, node.end, text)]
            text = quoted(step.name).encode() + b":" + text
            last = parent.members[-1][2] if parent.members else None
        else:
            n = len(parent.items)
            at = step.at + n if step.at < 0 else step.at
            if parent.kind != "array" or not 0 <= at <= n:
                raise _unplaceable(parent.start)
            if at < n:
                return [(parent.items[at].start, parent.items[at].start, text + b",")]
            last = parent.items[-1] if n else None
        return [(last.end, last.end, b"," + text)] if last is not None else [(parent.start + 1, parent.start + 1, text)]

    def delete(self, parent: Node, node: Node) -> list[Splice]:
        """The value with one comma beside it; all of a repeated name's members go."""
        if parent.kind == "object":
            name = next(k for k, _, n in parent.members if n is node)
            spans = [(k, n.end) for _, k, n in parent.members]
            gone = [i for i, (k, _, _) in enumerate(parent.members) if k == name]
        else:
            spans = [(n.start, n.end) for n in parent.items]
            gone = [parent.items.index(node)]
        out, kept = [], [i for i in range(len(spans)) if i not in set(gone)]
        for i in gone:
            if i + 1 < len(spans) and (kept and kept[-1] > i):
                out.append((spans[i][0], spans[i + 1][0], b""))
            elif kept:
                out.append((spans[i - 1][1], spans[i][1], b""))
            else:
                out.append((spans[i][0], spans[i + 1][0] if i + 1 < len(spans) else spans[i][1], b""))
        return out

    def comment(self, e: Comment) -> list[Splice]:
        """Insert writes a new comment, one without a text none; replace and clear meet all of the role, feet excepted."""
        if self.dialect == "rfc8259" or e.action == "insert" and not e.text:
            return []
        node = _locate(self.root, e.path)
        if node is None:
            raise _unplaceable()
        if e.action != "clear" and ("\n" in e.text or "\r" in e.text or "*/" in e.text):
            raise JsonError("Write", "invalid-comment", node.start)
        if e.action == "insert":
            return [self.fresh(e, node)]
        if e.role == "foot":
            return []
        own = [f for f in self.facts if f.role == e.role and (f.owner_start, f.owner_end) == (node.start, node.end)]
        if e.action == "clear" or not e.text:
            return [(f.start, f.end, b"") for f in own]
        if not own:
            raise _unplaceable(node.start)
        out = []
        for f in own:
            text = b"// " + e.text.encode() if self.src[f.start : f.start + 2] == b"//" else b"/* " + e.text.encode() + b" */"
            self.written.append((f.start, 0, len(text), f))
            out.append((f.start, f.end, text))
        return out

    def fresh(self, e: Comment, node: Node) -> Splice:
        """A new comment: a lead on a line of its own before the value, a foot after it, an inline one in an empty container."""
        text = b"// " + e.text.encode()
        if e.role == "lead":
            at, before, after = node.start, b"", b"\n"
        elif e.role == "foot":
            at, before, after = node.end, b" ", b"\n"
        elif node.kind in ("array", "object") and not node.children():
            at, before, text, after = node.start + 1, b"", b"/* " + e.text.encode() + b" */", b""
        else:
            raise _unplaceable(node.start)
        self.written.append((at, len(before), len(text), Fact(e.role, at, at, node.start, node.end)))
        return at, at, before + text + after


def _applied(v: Any, e: Edit) -> Any:
    """One edit of a value."""
    if isinstance(e, Comment):
        raise _unplaceable()
    if not e.path:
        if isinstance(e, Set):
            return e.value
        if isinstance(e, Clear) and isinstance(v, (list, dict)):
            return type(v)()
        raise JsonError("Write", "write", 0)
    parent = v
    for step in e.path[:-1]:
        parent = parent.get(step.name) if isinstance(step, Key) and isinstance(parent, dict) else values.element(parent, step.at) if isinstance(step, Index) else None
    step = e.path[-1]
    at: Any = step.name if isinstance(step, Key) else None
    if isinstance(step, Index) and isinstance(parent, list):
        at = values.resolve_index(len(parent), step.at)
    there = isinstance(parent, dict) and at in parent if isinstance(step, Key) else at is not None
    if isinstance(e, Insert):
        if isinstance(parent, dict) and isinstance(step, Key):
            parent[at] = e.value
            return v
        n = len(parent) if isinstance(parent, list) else -1
        i = step.at + n if isinstance(step, Index) and step.at < 0 else getattr(step, "at", -1)
        if not 0 <= i <= n:
            raise _unplaceable()
        parent.insert(i, e.value)
    elif isinstance(e, Delete):
        if there:
            del parent[at]
    elif not there:
        raise _unplaceable()
    elif isinstance(e, Set):
        parent[at] = e.value
    elif isinstance(e, Clear):
        if not isinstance(parent[at], (list, dict)):
            raise JsonError("Write", "write", 0)
        parent[at] = type(parent[at])()
    elif isinstance(parent, dict):
        # The new name takes the old one's place; a member that had it goes.
        items = [(e.key if k == at else k, e.value if k == at else x) for k, x in parent.items() if k == at or k != e.key]
        parent.clear()
        parent.update(items)
    else:
        raise _unplaceable()
    return v


def _want(path: tuple[Step, ...]) -> Want:
    want = CHECKED
    for step in reversed(path):
        if isinstance(step, Key):
            want = Want(keys={step.name: want}, names=True, arrays=True, items=CHECKED, rest=CHECKED)
        else:
            # From the end, any element may be the one.
            window = range(step.at, step.at + 1) if step.at >= 0 else None
            want = Want(names=True, arrays=True, items=want, window=window, rest=CHECKED)
    return want


def _planned(src: bytes, edits: list[Edit], dialect: str) -> tuple[list[Splice], _Placer]:
    reader = Reader(src, dialect)
    want = FULL if dialect != "rfc8259" else None
    for e in edits:
        want = merged(want, _want(e.path))
    # All values are checked; only those on the edits' ways have their members and elements read.
    root = reader.document(want or CHECKED)
    if type(root) is not Plain:
        check(src, root, dialect)
    placer = _Placer(src, root, dialect, reader.outer)
    splices = sorted(s for e in edits for s in placer.splices(e))
    for a, b in zip(splices, splices[1:], strict=False):
        if b[0] < a[1] or a[0] == b[0]:
            raise JsonError("Write", "write", b[0], "edits overlap")
    return splices, placer


def _spliced(src: bytes, splices: list[Splice]) -> bytes:
    out, at = [], 0
    for s, e, new in splices:
        out += [src[at:s], new]
        at = e
    return b"".join([*out, src[at:]])


def edit(src: bytes | str, edits: list[Edit], dialect: str = "rfc8259", revalidate: bool = True) -> bytes:
    """The text after all edits, which are all located in the text as it was."""
    src = src.encode() if isinstance(src, str) else src
    try:
        splices, _ = _planned(src, edits, dialect)
        out = _spliced(src, splices)
    except JsonError as error:
        if error.code != "edit-unplaceable" or any(isinstance(e, Comment) for e in edits):
            raise
    else:
        try:
            if revalidate and type(root := Reader(out, dialect).document(CHECKED)) is not Plain:
                check(out, root, dialect)
            return out
        except JsonError:
            if any(isinstance(e, Comment) for e in edits):
                raise
    value = parse(src, dialect)
    for e in edits:
        # Later edits may change what an earlier one has put in; the edits themselves stay as they are.
        value = _applied(value, e if isinstance(e, (Delete, Clear, Comment)) else replace(e, value=deepcopy(e.value)))
    return encode_value(value, Options(dialect=dialect))


def _carried(placer: _Placer, splices: list[Splice]) -> list[Fact]:
    """The text's comments in the places that they have after the splices; those that a splice touches are gone.

    A splice moves what stands at its end or after it. What is put in right before a value moves the value, what is put in
    right behind it doesn't belong to it.
    """

    def start_of(at: int) -> int:
        return at + sum(len(new) - (e - s) for s, e, new in splices if e <= at)

    def end_of(at: int) -> int:
        return at + sum(len(new) - (e - s) for s, e, new in splices if e <= at and not s == e == at)

    kept = [f for f in placer.facts if not any(s < f.end and e > f.start for s, e, _ in splices)]
    out = [Fact(f.role, start_of(f.start), end_of(f.end), start_of(f.owner_start), end_of(f.owner_end)) for f in kept]
    for at, within, length, f in placer.written:
        begin = at + sum(len(new) - (e - s) for s, e, new in splices if s < at) + within
        out.append(Fact(f.role, begin, begin + length, start_of(f.owner_start), end_of(f.owner_end)))
    return sorted(out, key=lambda f: f.start)


def edit_document(src: bytes | str, edits: list[Edit], dialect: str = "rfc8259") -> tuple[bytes, Document]:
    """The edited text and its root as a strictly read document; comments are carried through the edits, new ones among them.

    Values that were edited without a place in the text are written without comments.
    """
    src = src.encode() if isinstance(src, str) else src
    out = edit(src, edits, dialect)
    root = Reader(out, dialect).document()
    facts: list[Fact] = []
    if dialect != "rfc8259":
        try:
            splices, placer = _planned(src, edits, dialect)
            if _spliced(src, splices) == out:
                facts = _carried(placer, splices)
        except JsonError as error:
            if error.code != "edit-unplaceable":
                raise
    return out, Document(root.start, root.end, True, dialect, tuple(facts))
