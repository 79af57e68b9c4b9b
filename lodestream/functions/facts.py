"""Comments as facts: which value each comment belongs to, and in what role."""

from __future__ import annotations

from lodestream.functions.lexer import Node
from lodestream.plans.model import Fact, JsonError


def _same_line(src: bytes, a: int, b: int) -> bool:
    return b"\n" not in src[a:b] and b"\r" not in src[a:b]


def facts_of(src: bytes, root: Node, outer: list[tuple[int, int]] = ()) -> list[Fact]:
    """Facts in the order of their comments.

    On a value's line and after it, a comment is the value's foot; before a value it is that value's lead, and it can be
    both. After the last value of a container it is the container's lead, alone in one it is inline.
    """
    out: list[Fact] = []
    for s, e in outer:
        if s >= root.end:
            out.append(Fact("foot" if _same_line(src, root.end, s) else "lead", s, e, root.start, root.end))
        else:
            out.append(Fact("lead", s, e, root.start, root.end))
    todo = [root]
    while todo:
        n = todo.pop()
        children = n.children()
        for s, e, before in n.comments:
            # A member's value may have its comment between name and value; it then leads the value.
            before = sum(c.start < s for c in children)
            last = children[before - 1] if before else None
            if last is not None and _same_line(src, last.end, s):
                out.append(Fact("foot", s, e, last.start, last.end))
            if before < len(children):
                out.append(Fact("lead", s, e, children[before].start, children[before].end))
            elif children:
                if not (last is not None and _same_line(src, last.end, s)):
                    out.append(Fact("lead", s, e, n.start, n.end))
            else:
                out.append(Fact("inline", s, e, n.start, n.end))
        todo.extend(children)
    return sorted(out, key=lambda f: (f.start, f.role))


def ordered(facts: list[Fact]) -> list[Fact]:
    """The facts themselves if their comments ascend; else they are refused."""
    if any(a.start > b.start for a, b in zip(facts, facts[1:], strict=False)):
        raise JsonError("Write", "facts-not-ordered", 0)
    return facts
