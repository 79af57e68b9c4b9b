"""Answers demands over located nodes: one reading of the text serves all demands.

A flat projection gives one row for each element, absent cells where the element is no object; a filter gives a row or
none. An element that is itself an array is one element. A path with keys inside an element may end at an array, which
is then mapped.
"""

from __future__ import annotations

import operator
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

from lodestream.functions import values
from lodestream.functions.lexer import _ANY_STRING, BOM, CHECKED, FULL, Node, Plain, Reader, Want, check, checked_value, decoded, merged, number_at, value_of
from lodestream.plans import model as m
from lodestream.plans.model import JsonError
from lodestream.sources.framing import frames

Cell = tuple[int, int] | None
Row = tuple[Cell, ...]


def refuse_containers(demand: m.Demand) -> None:
    """eq and ne compare scalars only; a container operand is refused before any byte is read."""

    def predicate(p: m.Predicate) -> None:
        if isinstance(p, m.Compare):
            if p.op in ("eq", "ne") and isinstance(p.value, (list, dict)):
                raise JsonError("Shape", "predicate-operand", 0)
        elif isinstance(p, m.Not):
            predicate(p.inner)
        else:
            predicate(p.left)
            predicate(p.right)

    if isinstance(demand, m.Filter):
        predicate(demand.predicate)
    nested = getattr(demand, "nested", None)
    if nested is not None:
        refuse_containers(nested)


def canonical(demand: m.Demand) -> m.Demand:
    """Without paths of no steps: such a path is its nested demand."""
    nested = getattr(demand, "nested", None)
    if nested is not None:
        nested = canonical(nested)
    match demand:
        case m.Path((), _):
            return nested or m.Whole()
        case m.Path(steps, _):
            return m.Path(steps, nested)
        case m.Collection(fields, _):
            # A nested demand wins over fields.
            return m.Collection(None if nested is not None else fields, nested)
        case m.Slice(window, _):
            return m.Slice(window, nested)
    return demand


def canonical_demands(request: m.Request) -> list[m.Demand]:
    """The request's demands in canonical form, refused or not once for all texts."""
    made = request.__dict__.get("_canonical")
    if made is None:
        for d in request.demands:
            refuse_containers(d)
        made = [canonical(d) for d in request.demands]
        object.__setattr__(request, "_canonical", made)
    return made


@lru_cache(maxsize=1024)
def _short(spelling: str) -> float | None:
    """A number that a double holds as exactly as its spelling of at most 15 characters says."""
    return float(spelling) if len(spelling) <= 15 and re.fullmatch(r"-?[0-9]+(\.[0-9]+)?", spelling) else None


def _fields(p: m.Predicate) -> set[str]:
    if isinstance(p, m.Compare):
        return {p.field}
    return _fields(p.inner) if isinstance(p, m.Not) else _fields(p.left) | _fields(p.right)


def want_of(demand: m.Demand, checked: bool = True) -> Want | None:
    """What a canonical demand asks of the value that it meets; checked: whether answers' values are looked into."""
    whole = CHECKED if checked else None

    def at(steps: tuple[m.Step, ...], w: Want | None) -> Want | None:
        for step in reversed(steps):
            if isinstance(step, m.Key):
                w = Want(keys={step.name: w})
            else:
                w = Want(arrays=True, items=w, window=range(step.at, step.at + 1) if step.at >= 0 else None)
        return w

    def each(names: set[str]) -> Want:
        keys = dict.fromkeys(names, whole)
        return Want(keys=keys, arrays=True, items=Want(keys=keys))

    match demand:
        case m.Path(steps, nested):
            return at(steps, want_of(nested or m.Whole(), checked))
        case m.Project(path, fields):
            return at(path, each(set(fields)))
        case m.Filter(path, predicate, project):
            return at(path, each(_fields(predicate) | set(project)) if project or not checked else FULL)
        case m.Collection(fields, nested):
            return Want(arrays=True, items=want_of(nested or (m.Whole() if fields is None else m.Project((), fields)), checked))
        case m.Slice(window, nested):
            return Want(arrays=True, items=want_of(nested or m.Whole(), checked), window=range(window.start or 0, max(window.start or 0, window.end)) if window.bounded else None)
        case m.Oracle(kind, key):
            if kind == "has_key":
                return Want(keys={key or "": None})
            return Want(names=True, arrays=True) if kind in ("count", "member_names", "member_count") else None
    return whole


def want_of_request(request: m.Request, demands: list[m.Demand]) -> Want | None:
    """What all demands together ask of the text; all of it for strict readings, comments and other dialects."""
    made = request.__dict__.get("_want")
    if made is None:
        if request.facts or request.dialect != "rfc8259":
            made = (FULL,)
        elif request.strictness == "strict":
            made = (CHECKED if all(isinstance(d, m.Whole) for d in demands) else FULL,)
        else:
            w = None
            for d in demands:
                w = merged(w, want_of(d, request.strictness != "lazy"))
            made = (w,)
        object.__setattr__(request, "_want", made)
    return made[0]


Test = Callable[["Walker", dict[str, Node]], bool]


@lru_cache(maxsize=1024)
def _compiled(op: str, name: str, kind: str, operand: str | None) -> Test:
    """A comparison of plain scalars without parsing them; what isn't plain goes Walker.holds()'s way."""
    want = values.Number(operand) if kind == "number" else operand if kind == "string" else {"true": True, "false": False, None: None}[operand]
    slow = m.Compare(op, name, want)
    order = {"gt": operator.gt, "lt": operator.lt, "ge": operator.ge, "le": operator.le, "eq": operator.eq, "ne": operator.ne}[op]
    short = _short(operand) if kind == "number" else None
    raw = operand.encode("utf-8", "surrogatepass") if kind == "string" else None
    unequal = op == "ne"

    def number(w: Walker, named: dict[str, Node]) -> bool:
        node = named.get(name)
        if node is None:
            return unequal
        if type(node) is Plain and node.kind == "number" and node.end - node.start <= 15:
            own = float(w.src[node.start : node.end])
            if own or short:
                return order(own, short)
        return w.holds(named, slow)

    def string(w: Walker, named: dict[str, Node]) -> bool:
        node = named.get(name)
        if node is None:
            return unequal
        if type(node) is Plain and node.kind == "string" and b"\\" not in (own := w.src[node.start + 1 : node.end - 1]):
            return (own == raw) != unequal
        return w.holds(named, slow)

    if short is not None:
        return number
    return string if raw is not None and op in ("eq", "ne") else lambda w, named: w.holds(named, slow)


def compiled(p: m.Predicate) -> Test:
    """The predicate as a function; both sides of and/or are looked at, so that their values are checked."""
    if isinstance(p, m.And):
        a, b = compiled(p.left), compiled(p.right)
        return lambda w, named: a(w, named) & b(w, named)
    if isinstance(p, m.Or):
        a, b = compiled(p.left), compiled(p.right)
        return lambda w, named: a(w, named) | b(w, named)
    if isinstance(p, m.Not):
        inner = compiled(p.inner)
        return lambda w, named: not inner(w, named)
    v = p.value
    if isinstance(v, values.Number) and v.finite:
        return _compiled(p.op, p.field, "number", v.spelling)
    if v is None or isinstance(v, (bool, str)):
        return _compiled(p.op, p.field, "string" if isinstance(v, str) else "literal", v if v is None or isinstance(v, str) else str(v).lower())
    return lambda w, named: w.holds(named, p)


class Walker:
    """Answers over one source's nodes, with the checks that a strictness asks for. base: where the source begins in its stream."""

    def __init__(self, src: bytes, request: m.Request, watch: Callable[[str, int, int], None] | None = None, base: int = 0):
        self.src, self.dialect, self.strictness = src, request.dialect, request.strictness
        self.facts = request.facts
        self.watch, self.base = watch, base

    def demanded(self, node: Node) -> tuple[int, int]:
        """The span of a node that an answer holds; its values are checked unless reading is lazy."""
        if self.strictness == "structural" and type(node) is not Plain and node.kind != "null" and node.kind != "bool":
            check(self.src, node, self.dialect)
        if self.watch is not None:
            self.watch("hold", self.base + node.start, self.base + node.end)
        return self.base + node.start, self.base + node.end

    def go(self, node: Node, steps: tuple[m.Step, ...]) -> Node | m.Missing | m.TypeMismatch:
        for step in steps:
            if isinstance(step, m.Key):
                if node.kind != "object":
                    return m.TypeMismatch(node.kind)
                found = node.by_name().get(step.name)
            else:
                if node.kind != "array":
                    return m.TypeMismatch(node.kind)
                at = values.resolve_index(len(node.items), step.at)
                found = None if at is None else node.items[at]
            if found is None:
                return m.Missing()
            node = found
        return node

    def answer(self, node: Node, demand: m.Demand) -> m.Answer:
        match demand:
            case m.Whole():
                start, end = self.demanded(node)
                return m.Document(start, end, self.strictness == "strict", self.dialect)
            case m.Path(steps, nested):
                found = self.go(node, steps)
                return self.answer(found, nested or m.Whole()) if isinstance(found, Node) else found
            case m.Oracle():
                return self.oracle(node, demand)
            case m.Collection() | m.Slice():
                if node.kind != "array":
                    return m.TypeMismatch(node.kind)
                return m.Columns(m.fields_of(demand), list(self.rows(node, demand)))
            case m.Project(path, _) | m.Filter(path, _, _):
                found = self.go(node, path)
                if not isinstance(found, Node):
                    return found
                one = bool(path) and isinstance(path[-1], m.Index)
                if found.kind not in ("array", "object") and not one:
                    return m.TypeMismatch(found.kind)
                mapped = found.items if found.kind == "array" and not one else [found]
                if isinstance(demand, m.Project):
                    return m.Columns(demand.fields, self.projected(mapped, demand.fields))
                return m.Columns(m.fields_of(demand), self.filtered(mapped, demand))
        raise TypeError(f"no demand: {demand!r}")

    def projected(self, elements: list[Node], fields: tuple[str, ...]) -> list[Row]:
        """One row an element, as flat() has it."""
        if not fields:
            return []
        base, quick, rows, absent = self.base, self.watch is None, [], (None,) * len(fields)
        for e in elements:
            named = e.named if e.named is not None else e.by_name() if e.kind == "object" else None
            if not named:
                rows.append(absent)
                continue
            row = []
            for f in fields:
                node = named.get(f)
                if node is None:
                    row.append(None)
                elif quick and type(node) is Plain:
                    row.append((base + node.start, base + node.end))
                else:
                    row.append(self.demanded(node))
            rows.append(tuple(row))
        return rows

    def filtered(self, elements: list[Node], demand: m.Filter) -> list[Row]:
        """The rows that flat() has of each element."""
        if self.watch is not None or not demand.project:
            return [r for e in elements for r in self.flat(e, demand)]
        base, rows, test, fields = self.base, [], compiled(demand.predicate), demand.project
        for e in elements:
            named = e.named if e.named is not None else e.by_name() if e.kind == "object" else None
            if named is None:
                continue
            row = []
            # Fields are checked on rows that the predicate drops, too.
            for f in fields:
                node = named.get(f)
                if node is None:
                    row.append(None)
                elif type(node) is Plain:
                    row.append((base + node.start, base + node.end))
                else:
                    row.append(self.demanded(node))
            if test(self, named):
                rows.append(tuple(row))
        return rows

    def flat(self, element: Node, demand: m.Project | m.Filter) -> Iterator[Row]:
        """The rows of one element under a projection or filter without its path."""
        named = element.by_name() if element.kind == "object" else None
        fields = m.fields_of(demand)
        if isinstance(demand, m.Project):
            if fields:
                yield tuple(self.cell(named, f) for f in fields)
            return
        if named is None:
            return
        # Fields are checked on rows that the predicate drops, too.
        cells = tuple(self.cell(named, f) for f in demand.project)
        if self.holds(named, demand.predicate):
            yield cells if demand.project else (self.demanded(element),)

    def cell(self, named: dict[str, Node] | None, name: str) -> Cell:
        node = named.get(name) if named is not None else None
        return None if node is None else self.demanded(node)

    def rows(self, array: Node, demand: m.Collection | m.Slice) -> Iterator[Row]:
        items = array.items
        if isinstance(demand, m.Slice):
            window = demand.range.window(len(items))
            items = items[window.start : window.stop]
            each = demand.nested or m.Whole()
        else:
            each = demand.nested or (m.Whole() if demand.fields is None else m.Project((), demand.fields))
        for item in items:
            yield from self.element(item, each)

    def element(self, node: Node, demand: m.Demand) -> Iterator[Row]:
        """The rows that one element adds to its collection's."""
        match demand:
            case m.Whole():
                yield (self.demanded(node),)
            case m.Path(steps, nested):
                found = self.go(node, steps)
                each = nested or m.Whole()
                if isinstance(found, Node):
                    answer = self.answer(found, each) if m.makes_rows(each) else None
                    if isinstance(answer, m.Columns):
                        yield from answer.rows
                    elif answer is None and not isinstance(each, m.Oracle):
                        yield from self.element(found, each)
                elif not m.makes_rows(each) and not isinstance(each, m.Oracle):
                    yield (None,)
            case m.Project(path, fields) | m.Filter(path, _, fields):
                found = self.go(node, path) if path else node
                projects = isinstance(demand, m.Project)
                if path and isinstance(found, Node) and found.kind == "array" and isinstance(path[-1], m.Key):
                    if found.items:
                        for inner in found.items:
                            yield from self.flat(inner, demand)
                    elif projects and fields:
                        yield (None,) * len(fields)
                elif isinstance(found, Node):
                    yield from self.flat(found, demand)
                elif projects and fields:
                    yield (None,) * len(fields)
            case m.Collection() | m.Slice():
                if node.kind == "array":
                    yield from self.rows(node, demand)
            case m.Oracle():
                return

    def holds(self, named: dict[str, Node], p: m.Predicate) -> bool:
        """Two-valued, over a row's members; both sides of and/or are looked at, so that their values are checked."""
        if isinstance(p, m.And):
            a, b = self.holds(named, p.left), self.holds(named, p.right)
            return a and b
        if isinstance(p, m.Or):
            a, b = self.holds(named, p.left), self.holds(named, p.right)
            return a or b
        if isinstance(p, m.Not):
            return not self.holds(named, p.inner)
        node = named.get(p.field)
        if node is None:
            return p.op == "ne"
        self.demanded(node)
        want = p.value
        if p.op in ("eq", "ne"):
            return self._equals(node, want) == (p.op == "eq")
        # Order needs a number in the text; an operand true or false counts as 1 or 0.
        if type(node) is Plain and node.kind == "number" and node.end - node.start <= 15 and isinstance(want, values.Number) and (short := _short(want.spelling)) is not None:
            # Both have 15 digits at most, so doubles order them rightly; zeros have signs.
            own = float(self.src[node.start : node.end])
            if own or short:
                return {"gt": own > short, "lt": own < short, "ge": own >= short, "le": own <= short}[p.op]
        own = self._scalar(node) if node.kind == "number" else None
        order = values.compare(own, want) if isinstance(own, values.Number) else None
        return order is not None and {"gt": order > 0, "lt": order < 0, "ge": order >= 0, "le": order <= 0}[p.op]

    def _scalar(self, node: Node):
        try:
            return value_of(self.src, node, self.dialect)
        except JsonError:
            if self.strictness != "lazy":
                raise
            return NotImplemented

    def _equals(self, node: Node, want) -> bool:
        if node.kind != values.kind_of(want):
            return False
        if type(node) is Plain and node.kind == "string" and b"\\" not in (raw := self.src[node.start + 1 : node.end - 1]):
            return raw.decode() == want
        own = self._scalar(node)
        if isinstance(want, values.Number):
            return isinstance(own, values.Number) and own.compare(want) == 0
        return own is not NotImplemented and own == want

    def oracle(self, node: Node, o: m.Oracle) -> m.Answer:
        kind = node.kind
        if o.kind == "kind":
            return m.OracleAnswer("kind", kind)
        if o.kind == "descend_count" and self.dialect == "rfc8259":
            # Without strings and gaps, each comma and each container that isn't empty stands for one node more.
            bare = _ANY_STRING.sub(b"s", self.src[node.start : node.end]).translate(None, b" \t\n\r")
            many = sum(map(bare.count, (b",", b"[", b"{"))) - bare.count(b"[]") - bare.count(b"{}")
            return m.OracleAnswer("descend_count", 1 + many)
        if o.kind == "descend_count":
            total, todo = 0, [node]
            while todo:
                n = todo.pop()
                total += 1
                todo.extend(n.children())
            return m.OracleAnswer("descend_count", total)
        if o.kind == "string_byte_length":
            if kind != "string":
                return m.TypeMismatch(kind)
            self.demanded(node)
            return m.OracleAnswer("string_byte_length", len(decoded(self.src, node.start, node.end, self.dialect).encode()))
        if o.kind == "count" and kind == "array":
            return m.OracleAnswer("count", len(node.items))
        if kind != "object":
            return m.TypeMismatch(kind)
        named = node.by_name()
        if o.kind == "has_key":
            return m.OracleAnswer("has_key", o.key in named)
        if o.kind == "member_names":
            return m.OracleAnswer("member_names", list(named))
        return m.OracleAnswer(o.kind, len(named))


def _early(request: m.Request, demands: list[m.Demand]) -> tuple[tuple[str, ...], int] | None:
    """(names, elements to read) if all demands are bounded slices of one array behind these names; strict reading sees all."""
    made = request.__dict__.get("_early")
    if made is None:
        made = (_early_of(request, demands),)
        object.__setattr__(request, "_early", made)
    return made[0]


def _early_of(request: m.Request, demands: list[m.Demand]) -> tuple[tuple[str, ...], int] | None:
    if request.strictness == "strict" or not demands or request.facts:
        return None
    places, most = set(), 0
    for d in demands:
        steps: tuple[m.Step, ...] = ()
        while isinstance(d, m.Path) and d.nested is not None:
            steps, d = steps + d.steps, d.nested
        if not (isinstance(d, m.Slice) and d.range.bounded and all(isinstance(x, m.Key) for x in steps)):
            return None
        places.add(tuple(x.name for x in steps))
        most = max(most, d.range.end)
    return (places.pop(), most) if len(places) == 1 else None


def _until(reader: Reader, names: tuple[str, ...], most: int, want: Want | None, depth: int = 0) -> Node | None:
    """The array behind names as soon as it has `most` elements; None where it ends before, or there is none."""
    src = reader.src
    if not names:
        if src[reader.at : reader.at + 1] != b"[":
            return None
        array = Node("array", reader.at)
        elements = reader.elements(array, depth, want if want is not None else Want())
        while len(array.items) < most:
            if next(elements, None) is None:
                return None
        return array if array.end < 0 else None
    if src[reader.at : reader.at + 1] != b"{" or depth >= reader.max_nesting:
        return None
    node = Node("object", reader.at)
    reader.at += 1
    reader.trivia(node)
    if src[reader.at : reader.at + 1] == b"}":
        return None
    run = Want(keys={names[0]: None}).run().match if not reader.lax else None
    inner = want.keys.get(names[0]) if want is not None and not want.full else want
    while True:
        if run is not None:
            reader.at = run(src, reader.at).end()
        name = reader._name()
        reader.trivia(node)
        if src[reader.at : reader.at + 1] != b":":
            raise JsonError("Syntax", "expected-colon", reader.at)
        reader.at += 1
        reader.trivia(node)
        if name == names[0]:
            return _until(reader, names[1:], most, inner, depth + 1)
        reader.take(None, depth + 1)
        if reader._closes(node, b"}", 1):
            return None


def scan_text(src: bytes, request: m.Request, watch: Callable[[str, int, int], None] | None = None) -> m.Result:
    demands = canonical_demands(request)
    want = want_of_request(request, demands)
    walker = Walker(src, request, watch)
    early = _early(request, demands)
    if early is not None:
        reader = Reader(src, request.dialect, request.max_nesting, watch)
        reader.at = 3 if src[:3] == BOM else 0
        reader.trivia()
        try:
            array = _until(reader, *early, want)
        except JsonError:
            # The whole reading says what is wrong, in its order.
            array = None
        if array is not None:
            if watch is not None:
                watch("stop", reader.at, reader.at)
            slices = [d.nested if isinstance(d, m.Path) else d for d in demands]
            while any(isinstance(d, m.Path) for d in slices):
                slices = [d.nested if isinstance(d, m.Path) else d for d in slices]
            return m.Result([walker.answer(array, d) for d in slices])
    reader = Reader(src, request.dialect, request.max_nesting, watch)
    root = reader.document(want)
    if request.strictness == "strict" and type(root) is not Plain:
        check(src, root, request.dialect)
    answers = [walker.answer(root, d) for d in demands]
    if request.facts:
        from lodestream.functions.facts import facts_of

        found = facts_of(src, root, reader.outer)
        answers = [m.Document(a.start, a.end, a.validated, a.grammar, tuple(f for f in found if a.start <= f.owner_start and f.owner_end <= a.end)) if isinstance(a, m.Document) else a for a in answers]
    return m.Result(answers)


def _record(src: bytes, span: tuple[int, int], request: m.Request, want: Want | None, watch: Callable[[str, int, int], None] | None) -> tuple[Node, Walker]:
    """The root of one record of a stream, and its walker; refusals have the stream's offsets."""
    s, e = span
    own = src[s:e]
    seen = None if watch is None else lambda event, start, end: watch(event, s + start, s + end)
    try:
        reader = Reader(own, request.dialect, request.max_nesting, seen)
        reader.trivia()
        root = reader.take(want)
        reader.finish()
        if request.strictness == "strict" and type(root) is not Plain:
            check(own, root, request.dialect)
    except JsonError as error:
        raise JsonError(error.cls, error.code, error.offset + s) from None
    return root, Walker(own, request, watch, s)


def _per_record(demand: m.Demand) -> tuple[str, m.Demand, m.Demand | None]:
    """How a demand on the virtual array of records meets one record: (mode, demand on the record, index or window)."""
    match demand:
        case m.Whole():
            return "rows", m.Whole(), None
        case m.Path((m.Index() as step, *rest), nested):
            return "at", canonical(m.Path(tuple(rest), nested)), step
        case m.Project((m.Index() as step, *rest), fields):
            return "at_row", m.Project(tuple(rest), fields), step
        case m.Filter((m.Index() as step, *rest), predicate, project):
            return "at_row", m.Filter(tuple(rest), predicate, project), step
        case m.Project((), _) | m.Filter((), _, _):
            return "rows", demand, None
        case m.Collection(fields, nested):
            return "rows", nested or (m.Whole() if fields is None else m.Project((), fields)), None
        case m.Slice(window, nested):
            return "rows", nested or m.Whole(), window
        case m.Oracle():
            return "oracle", demand, None
    return "never", demand, None


def scan_stream(src: bytes, request: m.Request, watch: Callable[[str, int, int], None] | None = None) -> m.Result:
    """Records as one virtual array. A bad last record is an issue and ends the stream; an earlier one is an error."""
    demands = canonical_demands(request)
    spans = frames(src, request.framing, request.dialect, request.max_nesting)
    plans = [_per_record(d) for d in demands]
    checked = request.strictness != "lazy"
    full = request.strictness == "strict" or request.dialect != "rfc8259"
    wants = [FULL if full else want_of(d, checked) if mode in ("rows", "at", "at_row") else None for mode, d, _ in plans]
    n = len(spans)
    wanted = []
    for mode, _, at in plans:
        if mode in ("at", "at_row"):
            wanted.append(values.resolve_index(n, at.at))
        else:
            wanted.append(at.window(n) if isinstance(at, m.Range) else range(n))
    rows: list[list[Row]] = [[] for _ in demands]
    single: list[m.Answer] = [m.Missing() for _ in demands]
    issues, walked = [], 0
    for i, span in enumerate(spans):
        try:
            want = FULL if full else None
            asked = [k for k, (mode, _, _) in enumerate(plans) if (mode == "rows" and i in wanted[k]) or (mode in ("at", "at_row") and i == wanted[k])]
            for k in asked:
                want = merged(want, wants[k])
            root, walker = _record(src, span, request, want, watch)
            made: list[tuple[int, list[Row] | m.Answer]] = []
            try:
                for k in asked:
                    mode, demand, _ = plans[k]
                    if mode == "rows":
                        made.append((k, list(walker.element(root, demand))))
                    elif mode == "at":
                        made.append((k, walker.answer(root, demand)))
                    else:
                        made.append((k, m.Columns(m.fields_of(demand), list(walker.flat(root, demand))) if not demand.path else walker.answer(root, demand)))
            except JsonError as error:
                raise JsonError(error.cls, error.code, error.offset + span[0]) from None
        except JsonError as error:
            if i == n - 1:
                issues.append(error.issue())
                break
            raise
        walked += 1
        for k, x in made:
            if isinstance(x, list):
                rows[k] += x
            else:
                single[k] = x
    out: list[m.Answer] = []
    for k, (mode, demand, _) in enumerate(plans):
        if mode == "rows":
            out.append(m.Columns(m.fields_of(demands[k]), rows[k]))
        elif mode == "never":
            out.append(m.TypeMismatch("array"))
        elif mode == "oracle":
            if demand.kind in ("count", "descend_count", "member_count"):
                out.append(m.OracleAnswer(demand.kind, walked))
            elif demand.kind == "kind":
                out.append(m.OracleAnswer("kind", "array"))
            else:
                out.append(m.Missing() if demand.kind == "string_byte_length" else m.TypeMismatch("array"))
        else:
            out.append(single[k])
    return m.Result(out, issues)


def scan(src: bytes | str, request: m.Request, watch: Callable[[str, int, int], None] | None = None) -> m.Result:
    """One answer for each demand of the request.

    watch is told (event, start, end): "poll" at each step through a container that is read, "skip" for each region that
    was only located, "hold" for each span that an answer holds, "stop" where reading ends early.
    """
    src = src.encode() if isinstance(src, str) else src
    return scan_text(src, request, watch) if request.framing == "text" else scan_stream(src, request, watch)


def scan_each(src: bytes | str, request: m.Request) -> Iterator[tuple[int, m.Result]]:
    """(record ordinal, its answers) one by one, each record answering as a text of its own; a text is one record.

    Spans are those of the whole stream. A bad last record gives a result with an issue and no answers.
    """
    src = src.encode() if isinstance(src, str) else src
    if request.framing == "text":
        yield 0, scan(src, request)
        return
    demands = canonical_demands(request)
    want = want_of_request(request, demands)
    spans = frames(src, request.framing, request.dialect, request.max_nesting)
    for i, span in enumerate(spans):
        try:
            root, walker = _record(src, span, request, want, None)
            try:
                made = m.Result([walker.answer(root, d) for d in demands])
            except JsonError as error:
                raise JsonError(error.cls, error.code, error.offset + span[0]) from None
        except JsonError as error:
            if i < len(spans) - 1:
                raise
            made = m.Result([], [error.issue()])
        yield i, made


def validate(src: bytes | str, dialect: str = "rfc8259") -> m.Issue | None:
    """What a strict reading of the whole text refuses, or None."""
    try:
        scan(src, m.Request((m.Whole(),), strictness="strict", dialect=dialect))
    except JsonError as error:
        return error.issue()
    return None


def materialize(src: bytes | str, answer: m.Answer, dialect: str = "rfc8259"):
    """The value of a document or of rows; rows become objects without their absent members, or bare values for "$"."""
    src = src.encode() if isinstance(src, str) else src

    def at(cell: tuple[int, int]):
        return checked_value(src, cell[0], dialect)[0]

    if isinstance(answer, m.Document):
        return at((answer.start, answer.end))
    if isinstance(answer, m.Columns):
        if answer.fields == ("$",):
            return [None if r[0] is None else at(r[0]) for r in answer.rows]
        return [{f: at(c) for f, c in zip(answer.fields, r, strict=True) if c is not None} for r in answer.rows]
    raise JsonError("Shape", "invalid-shape", 0, "only documents and rows have a value")


def stitch(parts: list[m.Result]) -> m.Result:
    """Parts' answers folded back: rows follow one another, counts add up, else the first answer stands."""
    if not parts:
        return m.Result([])
    width = max(len(p.answers) for p in parts)
    out: list[m.Answer] = []
    for k in range(width):
        own = [p.answers[k] for p in parts if k < len(p.answers)]
        batches = [a for a in own if isinstance(a, m.Columns)]
        counts = [a for a in own if isinstance(a, m.OracleAnswer) and a.kind == "count"]
        if batches:
            out.append(m.Columns(batches[0].fields, [r for b in batches for r in b.rows]))
        elif counts:
            out.append(m.OracleAnswer("count", min(sum(a.value for a in counts), (1 << 64) - 1)))
        else:
            out.append(next((a for a in own if not isinstance(a, m.Missing)), m.Missing()))
    return m.Result(out, [i for p in parts for i in p.issues])


__all__ = ["Walker", "canonical", "materialize", "number_at", "refuse_containers", "scan", "scan_each", "stitch", "validate"]
