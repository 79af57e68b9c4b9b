"""One large array in parts: where to cut it, what a part answers, and how the parts fold back."""

from __future__ import annotations

from dataclasses import dataclass

from lodestream.functions.lexer import FULL, Node, Reader, check, merged
from lodestream.plans import model as m
from lodestream.plans.model import JsonError
from lodestream.plans.walk import Walker, canonical, refuse_containers, scan, stitch, want_of

FIRST_BYTES = 256 << 10


def _array_path(demand: m.Demand) -> tuple[m.Step, ...]:
    return demand.path if isinstance(demand, (m.Project, m.Filter)) else demand.steps if isinstance(demand, m.Path) else ()


def at_elements(demand: m.Demand) -> m.Demand:
    """The demand as it meets a part's elements: without its way to the array."""
    match demand:
        case m.Project(_, fields):
            return m.Project((), fields)
        case m.Filter(_, predicate, project):
            return m.Filter((), predicate, project)
        case m.Path(_, nested):
            return nested or m.Whole()
    return demand


def located(src: bytes, request: m.Request, path: tuple[m.Step, ...]) -> Node | None:
    """The array at path, its elements only located; None where there is none."""
    want = want_of(m.Path(path, m.Collection()) if path else m.Collection(), checked=False) if request.dialect == "rfc8259" else FULL
    node = Walker(src, request).go(Reader(src, request.dialect, request.max_nesting).document(want), path)
    return None if isinstance(node, (m.Missing, m.TypeMismatch)) or node.kind != "array" else node


def cut(src: bytes, path: tuple[m.Step, ...] = (), target: int = FIRST_BYTES) -> list[tuple[int, int, int]]:
    """(first element's index, start, end) of runs of whole elements of the array at path, about target bytes each."""
    node = located(src, m.Request(()), path)
    out: list[list[int]] = []
    for i, item in enumerate(node.items if node is not None else ()):
        if out and out[-1][2] - out[-1][1] < target:
            out[-1][2] = item.end
        else:
            out.append([i, item.start, item.end])
    return [tuple(x) for x in out]


@dataclass(frozen=True)
class Plan:
    """Ranges of one array that may answer a request's demands apart from each other."""

    src: bytes
    request: m.Request
    ranges: list[tuple[int, int, int]]

    @classmethod
    def build(cls, src: bytes, request: m.Request, target: int = FIRST_BYTES) -> Plan | None:
        """None if the demands are to be answered serially: not all of them split, or they name several arrays."""
        demands = [canonical(d) for d in request.demands]
        for d in demands:
            refuse_containers(d)
        paths = {_array_path(d) for d in demands}
        if request.framing != "text" or request.dialect != "rfc8259" or len(paths) != 1 or any(m.shard(d) == "serial" for d in demands):
            return None
        path = paths.pop()
        if located(src, request, path) is None:
            return None
        return cls(src, request, cut(src, path, target))

    def scan(self, part: tuple[int, int, int]) -> m.Result:
        """The answers of one range; spans are those of the whole source."""
        _, start, end = part
        # The range as an array of its own; its bracket takes the byte before it.
        own, demands = b"[" + self.src[start:end] + b"]", [at_elements(canonical(d)) for d in self.request.demands]
        want = FULL
        if self.request.strictness != "strict" and self.request.dialect == "rfc8259":
            want = None
            for d in demands:
                want = merged(want, want_of(d, self.request.strictness != "lazy"))
        try:
            array = Reader(own, self.request.dialect, self.request.max_nesting).document(want)
            if self.request.strictness == "strict":
                check(own, array, self.request.dialect)
            walker = Walker(own, self.request, base=start - 1)
            return m.Result([walker.answer(array, d) for d in demands])
        except JsonError as error:
            raise JsonError(error.cls, error.code, error.offset + start - 1) from None

    def run(self) -> m.Result:
        """All parts folded; if one fails, the whole is read serially and fails, or not, as that does."""
        from lodestream.operators.control import run_or_serial

        return run_or_serial(bool(self.ranges), lambda: stitch([self.scan(r) for r in self.ranges]), lambda: scan(self.src, self.request))
