"""Demands against their laws, and against a second evaluator."""

import json
import random

import dom
import pytest

from lodestream.functions import values as v
from lodestream.functions.encode import encode_value
from lodestream.plans import walk
from lodestream.plans.model import And, Collection, Columns, Compare, Document, Filter, JsonError, Missing, Not, Or, Oracle, OracleAnswer, Path, Project, Range, Request, Slice, TypeMismatch, Whole, steps
from lodestream.plans.shard import Plan

P = steps


def N(x):
    return v.Number(str(x))


def answers(text, *demands, **options):
    result = walk.scan(text, Request(demands, **options))
    src = text.encode() if isinstance(text, str) else text
    return [json.loads(encode_value(walk.materialize(src, a, options.get("dialect", "rfc8259")))) if isinstance(a, (Columns, Document)) else a for a in result.answers]


def one(text, demand, **options):
    return answers(text, demand, **options)[0]


BOOKS = """{
  "shelves": [
    {"no": 4, "box": {"label": {"lang": "de", "year": 1921}}},
    null,
    {"no": 9, "box": {}},
    {"no": 2.50, "box": {"label": [{"lang": "fr"}, "torn", {"year": 1874, "lang": null}]}},
    {"no": "4", "box": {"label": []}},
    [{"no": 4}],
    {"no": 4e0, "no": 11, "box": {"label": 7}}
  ],
  "keeper": {"name": "Ada", "name": "Eve", "since": -0},
  "open": false
}"""
SHELVES = P("shelves")
LABELS = Project(P("box", "label"), ("lang",))


def test_projections_behind_elements():
    """A path in each element ends at an object (one row), an array (a row an element, one if it is empty), or nowhere."""
    each = Path(SHELVES, Collection(None, LABELS))
    assert one(BOOKS, each) == [{"lang": "de"}, {}, {}, {"lang": "fr"}, {}, {"lang": None}, {}, {}, {}]
    assert one(BOOKS, Project(SHELVES, ("no",))) == [{"no": 4}, {}, {"no": 9}, {"no": 2.5}, {"no": "4"}, {}, {"no": 11}]
    assert one(BOOKS, Path(SHELVES, Collection(("box", "no")))) == one(BOOKS, Project(SHELVES, ("box", "no")))
    assert one(BOOKS, Project(P("shelves", 5), ("no",))) == [{}] and one(BOOKS, Project(P("shelves", -2, 0), ("no",))) == [{"no": 4}]
    assert one(BOOKS, Project(P("keeper"), ("since", "name"))) == [{"since": 0, "name": "Eve"}]


def test_filters_and_windows():
    """Rows that aren't objects never pass; a window counts elements, not the rows that a filter leaves."""
    four = Compare("ge", "no", N("4.0"))
    assert one(BOOKS, Filter(SHELVES, four, ("no",))) == [{"no": 4}, {"no": 9}, {"no": 11}]
    assert one(BOOKS, Filter(SHELVES, Not(four), ("no",))) == [{"no": 2.5}, {"no": "4"}]
    assert one(BOOKS, Path(SHELVES, Collection(None, Filter((), four, ("no",))))) == one(BOOKS, Filter(SHELVES, four, ("no",)))
    assert one(BOOKS, Path(SHELVES, Slice(Range(1, 4), Filter((), four, ("no",))))) == [{"no": 9}]
    assert one(BOOKS, Path(SHELVES, Slice(Range(-3, -1), Filter((), Compare("eq", "no", "4"))))) == [{"no": "4", "box": {"label": []}}]
    assert one(BOOKS, Filter(P("keeper"), Compare("ne", "gone", True), ("name",))) == [{"name": "Eve"}]
    assert one(BOOKS, Filter(P("keeper"), Compare("eq", "name", "Ada"))) == []


def test_nested_collections_and_spent_paths():
    grid = '[[10, 20], "x", [], [[30]], {"a": [40]}]'
    assert one(grid, Collection(None, Collection())) == [10, 20, [30]]
    assert one(grid, Collection(None, Slice(Range(-1, None)))) == [20, [30]]
    assert one(grid, Path((), Path((), Collection(None, Path((), Path(P("a"), Collection())))))) == [40]
    assert one(grid, Path((), Whole())) == json.loads(grid)


@pytest.mark.parametrize(
    ("demand", "want"),
    [
        (Path(P("open", "hours")), TypeMismatch("bool")), (Path(P("shelves", "no")), TypeMismatch("array")), (Path(P("keeper", 0)), TypeMismatch("object")), (Path(P("shelves", 1, "no")), TypeMismatch("null")),
        (Path(P("cellar")), Missing()), (Path(P("shelves", 7)), Missing()), (Path(P("shelves", -8)), Missing()), (Path(P("keeper"), Collection()), TypeMismatch("object")),
        (Path(P("open"), Slice(Range(0, 1))), TypeMismatch("bool")), (Project(P("shelves", 4, "no"), ("x",)), TypeMismatch("string")), (Filter(P("shelves", 0, "no"), Compare("eq", "x", None)), TypeMismatch("number")),
    ],
)
def test_missing_and_mismatch(demand, want):
    assert one(BOOKS, demand) == want


def test_oracles():
    ask = lambda path, kind, key=None: one(BOOKS, Path(P(*path), Oracle(kind, key)) if path else Oracle(kind, key))
    assert ask((), "member_names").value == ["shelves", "keeper", "open"] and ask((), "count").value == ask((), "member_count").value == 3
    assert ask(("shelves",), "count").value == 7 and ask(("shelves", 4, "box", "label"), "count").value == 0
    # A repeated name is one member, but both its values are nodes.
    assert ask(("keeper",), "member_names").value == ["name", "since"] and ask(("keeper",), "descend_count").value == 4
    assert ask(("shelves", 3), "descend_count").value == 10 and ask(("open",), "descend_count").value == 1
    assert [ask(("keeper",), "has_key", k).value for k in ("since", "until")] == [True, False]
    assert [ask(p, "kind").value for p in (("open",), ("keeper", "name"), ("shelves", 1), ("shelves", 3, "no"))] == ["bool", "string", "null", "number"]
    assert ask(("keeper", "name"), "string_byte_length").value == 3 and one('"Zoë \\ud83d\\udcda\\t"', Oracle("string_byte_length")).value == 10
    assert one('{"ca\\u0066\\u00e9": 1, "café": 2}', Oracle("member_names")).value == ["café"]
    assert ask(("shelves",), "member_count") == TypeMismatch("array") and ask(("open",), "count") == TypeMismatch("bool") and ask(("keeper",), "string_byte_length") == TypeMismatch("object")
    lines = "".join(f'{{"line": {i}, "x": [{i}]}}\n' for i in range(12))
    assert [a.value if isinstance(a, OracleAnswer) else a for a in answers(lines, *(Oracle(k) for k in ("count", "descend_count", "member_count", "kind", "member_names", "string_byte_length")), framing="ndjson")] == [12, 12, 12, "array", TypeMismatch("array"), Missing()]


def test_numbers_compare_by_value():
    """Any spelling, any size; the sign of zero counts."""
    ladder = ["-1e3", "-7", "-0.50", "-0", "0.000", "4E-2", "0.5", "7", "70e-1", "99999999999999999999999999.5", "1e40"]
    text = "[" + ",".join(f'{{"v": {x}}}' for x in ladder) + "]"
    rank = {"70e-1": 7}
    places = [rank.get(x, i) for i, x in enumerate(ladder)]
    for i, x in enumerate(ladder):
        for op, keep in (("gt", lambda p, q: p > q), ("lt", lambda p, q: p < q), ("ge", lambda p, q: p >= q), ("le", lambda p, q: p <= q), ("eq", lambda p, q: p == q), ("ne", lambda p, q: p != q)):
            assert len(one(text, Filter((), Compare(op, "v", N(x)), ("v",)))) == sum(keep(p, places[i]) for p in places), (op, x)


def _some(rng, depth):
    kind = rng.randrange(8 if depth else 5)
    if kind == 5:
        return [_some(rng, depth - 1) for _ in range(rng.randrange(4))]
    if kind > 5:
        return {k: _some(rng, depth - 1) for k in rng.sample(["id", "n", "x", 'q"\\', "é", "rows"], rng.randrange(5))}
    return rng.choice([None, True, False, 0, 3, -17, 2.5, "a,b]}", "é\n", "", 'say "n":1'])


def _any_predicate(rng, depth=2):
    if depth and rng.random() < 0.5:
        return rng.choice([And, Or])(_any_predicate(rng, depth - 1), _any_predicate(rng, depth - 1)) if rng.random() < 0.7 else Not(_any_predicate(rng, depth - 1))
    return Compare(rng.choice(["eq", "ne", "gt", "lt", "ge", "le"]), rng.choice(["id", "n", "x"]), rng.choice([N(3), N("2.50"), N(-17), "", "a,b]}", True, None]))


@pytest.mark.parametrize("seed", range(60))
def test_predicates_against_dom(seed):
    rng = random.Random(seed)
    items = [_some(rng, 2) for _ in range(12)] + [{"id": _some(rng, 0), "n": _some(rng, 0)} for _ in range(12)]
    text = json.dumps(items, ensure_ascii=rng.random() < 0.5, indent=rng.choice([None, 1]))
    for _ in range(6):
        p = _any_predicate(rng)
        if any(isinstance(x, Compare) and x.value is True and x.op not in ("eq", "ne") for x in _leaves(p)):
            continue
        want = [dom.row(e, ("n", "x")) for e in dom.load(text) if dom.holds(e, p)]
        assert one(text, Filter((), p, ("n", "x"))) == json.loads(json.dumps(want, default=float)), p


def _leaves(p):
    return [p] if isinstance(p, Compare) else _leaves(p.inner) if isinstance(p, Not) else _leaves(p.left) + _leaves(p.right)


def _any_demand(rng):
    path = P(*rng.choice([(), ("rows",), ("x",), ("rows", 0), ("x", -1), ("rows", "x"), ("é",)]))
    fields = tuple(rng.sample(["id", "n", "x", "é"], rng.randint(1, 3)))
    edge = lambda: rng.choice([None, -2, 0, 1, 2, 4])
    inner = rng.choice([None, Whole(), Project((), fields), Project(P("x"), fields), Filter((), _any_predicate(rng, 1), fields), Collection(), Path(P("x"))])
    oracle = Oracle(rng.choice(["count", "descend_count", "kind", "member_names", "member_count", "string_byte_length", "has_key"]), "x")
    at = lambda d: Path(path, d) if path else d
    return rng.choice([Whole(), Path(path), at(oracle), Project(path, fields), Filter(path, _any_predicate(rng), fields), Filter(path, _any_predicate(rng)), at(Collection(None, inner)), at(Collection(fields)), at(Slice(Range(edge(), edge()), inner))])


@pytest.mark.parametrize("seed", range(150))
def test_reading_what_is_asked_is_reading_all(seed, monkeypatch):
    """The same answers, spans included, as from a whole reading; a text that ends early is refused by both."""
    rng = random.Random(seed)
    value = _some(rng, 4) if rng.random() < 0.3 else {"rows": [_some(rng, 3) for _ in range(rng.randrange(6))], "x": _some(rng, 5), "é": _some(rng, 2), "id": 1}
    text = json.dumps(value, ensure_ascii=rng.random() < 0.5, indent=rng.choice([None, None, 2])).encode()
    demands = tuple(_any_demand(rng) for _ in range(rng.randint(1, 3)))
    stream = b"".join(json.dumps(_some(rng, 3)).encode() + b"\n" for _ in range(5))
    cut = text[: rng.randrange(len(text))] if len(text) > 1 else b""
    strictness = rng.choice(["structural", "lazy"])

    def all_of(src, framing="text"):
        try:
            return walk.scan(src, Request(demands, strictness=strictness, framing=framing, max_nesting=40))
        except JsonError as error:
            return error.cls

    found = [all_of(text), all_of(stream, "ndjson"), all_of(b"[" * 6 + text + b"]" * 6)]
    early = walk._early(Request(demands), [walk.canonical(d) for d in demands]) is not None
    refused = all_of(cut)
    with monkeypatch.context() as patch:
        patch.setattr(walk, "want_of_request", lambda request, demands: walk.FULL)
        patch.setattr(walk, "want_of", lambda demand, checked=True: walk.FULL)
        patch.setattr(walk, "_early", lambda request, demands: None)
        assert found == [all_of(text), all_of(stream, "ndjson"), all_of(b"[" * 6 + text + b"]" * 6)], demands
        assert early or refused == all_of(cut)


INNER = ['{"lang":"it"}', "{}", '[{"lang":8},null]', "[]", '"torn"']
ELEMENTS = [f'{{"no":{i},"box":{{"label":{x}}}}}' for i, x in enumerate(INNER)] + ['{"id":-40,"n":0.5}', '{"n":null}', '{"id":2}', '{"id":7,"id":1}', '{"x":{"id":5}}', '{"x":[{"id":6},[]]}', "-3.25", '"id"', "false", "null", '[{"id":4}]', "{}"]


@pytest.mark.parametrize("seed", range(60))
def test_random_rows_against_dom(seed):
    rng = random.Random(seed)
    items = [rng.choice(ELEMENTS) for _ in range(rng.randint(0, 8))]
    text, stream = "[" + ", ".join(items) + "]", "".join(i + "\n" for i in items)
    loaded = dom.load(text)
    lo, hi = rng.choice([None, -3, -1, 0, 1, 2]), rng.choice([None, -2, 0, 1, 3, 9])
    cases = [
        (Project((), ("id", "n")), [dom.row(e, ("id", "n")) for e in loaded]),
        (Collection(None, LABELS), dom.project_each(loaded, ("box", "label"), ("lang",))),
        (Collection(None, Project(P("x"), ("id",))), dom.project_each(loaded, ("x",), ("id",))),
        (Collection(), loaded),
        (Slice(Range(lo, hi)), loaded[lo:hi]),
        (Slice(Range(lo, hi), Project((), ("id",))), [dom.row(e, ("id",)) for e in loaded[lo:hi]]),
        (Filter((), Compare("ge", "id", N(2)), ("id",)), [dom.row(e, ("id",)) for e in loaded if dom.holds(e, Compare("ge", "id", N(2)))]),
    ]
    for demand, want in cases:
        want = json.loads(json.dumps(want, default=float))
        assert one(text, demand) == want
        assert one(stream, demand, framing="ndjson") == want
        assert one("\x1e" + "\n\x1e".join(items) + "\n", demand, framing="jsonseq") == want
        assert one(" ".join(items) + " ", demand, framing="adjacent") == want


def test_streams():
    tail = '{"t":"10:00"}\r\n\r\n{"t":"10:05"}\n{"t":'
    r = walk.scan(tail, Request((Whole(), Project(P(1), ("t",))), framing="ndjson"))
    assert len(r.answers[0].rows) == 2 and r.issues[0].code == "expected-value" and r.issues[0].offset == len(tail)
    assert [tail[s:e] for ((s, e),) in r.answers[1].rows] == ['"10:05"']
    with pytest.raises(JsonError) as e:
        walk.scan('{"t":1}\n{"t" 2}\n{"t":3}\n', Request((Whole(),), framing="ndjson"))
    assert e.value.code == "expected-colon" and e.value.offset == 13
    got = list(walk.scan_each("\x1e[5]\n\x1e\n\x1e[6, 7]\n", Request((Path(P(-1)), Oracle("count")), framing="jsonseq")))
    assert [(i, r.answers[0].start, r.answers[1].value) for i, r in got] == [(0, 2, 1), (1, 12, 2)]
    assert one("7 8", Path(P("k")), framing="adjacent") == TypeMismatch("array") and one("7 8", Path(P(-1)), framing="adjacent") == 8


def test_strictness():
    """Strict readings check every value, structural ones what answers hold and predicates look at, lazy ones none."""
    text = '{"good": {"n": 1}, "odd": [{"n": 2, "u": "\\x", "v": 1.}, {"n": 3}]}'
    cheap = Filter(P("odd"), Compare("lt", "n", N(5)), ("n",))
    assert one(text, cheap) == [{"n": 2}, {"n": 3}] and one(text, Path(P("good"))) == {"n": 1}
    for demand in (Path(P("odd")), Project(P("odd"), ("v",)), Filter(P("odd"), Compare("eq", "u", "a"), ("n",)), Filter(P("odd"), Compare("lt", "n", N(5)))):
        with pytest.raises(JsonError):
            one(text, demand)
        walk.scan(text, Request((demand,), strictness="lazy"))
    for demand in (cheap, Path(P("good"))):
        with pytest.raises(JsonError):
            one(text, demand, strictness="strict")
    late = walk.scan(text, Request((Path(P("odd", 0, "v")),), strictness="lazy")).answers[0]
    with pytest.raises(JsonError) as e:
        walk.materialize(text, late)
    assert e.value.offset == text.index("1.}")
    # A bounded window, at the root or behind names, ends the reading.
    assert one("[40, 41, oops", Slice(Range(1, 2))) == [41]
    assert one('{"a": {"b": [40, 41, oops', Path(P("a", "b"), Slice(Range(0, 2)))) == [40, 41]
    for demand in (Slice(Range(1, 4)), Slice(Range(-1, None))):
        with pytest.raises(JsonError):
            one("[40, 41, oops", demand)


def test_refusals():
    with pytest.raises(JsonError) as e:
        one("[]", Filter((), Compare("eq", "a", [None])))
    assert e.value.code == "predicate-operand"
    with pytest.raises(JsonError) as e:
        one("[" * 300 + "]" * 300, Whole())
    assert e.value.code == "nesting"
    for text, code in (("[1,]", "trailing-comma"), ("01", "invalid-number"), ('"\\ud800"', "missing-low-surrogate"), ('{"a":1} x', "trailing-content"), ("[1 2]", "expected-comma"), ("", "expected-value"), (b'"\xff"', "invalid-utf8"), ('"\x01"', "control-in-string"), ('"\\q"', "invalid-escape"), ('"a', "unterminated-string"), ("tru", "invalid-literal")):
        assert walk.validate(text).code == code, text


@pytest.mark.parametrize("src", ["'\\x41'", '"\\x41"', '"\\v"', '"\\0"', '"a\\\nb"', "Infinity", "-Infinity", "+Infinity", "NaN", ".5", "5.", "+1", "0x1F", "{a:1,$b:2,_c:3,d4:4}"])
def test_json5_only(src):
    assert walk.validate(src, "json5") is None
    assert walk.validate(src) is not None and walk.validate(src, "jsonc") is not None


def test_comments_and_trailing_commas():
    text = '[1, /* c */ 2, // d\n]'
    for dialect in ("jsonc", "json5"):
        assert one(text, Whole(), dialect=dialect) == [1, 2]
    assert walk.validate(text) is not None
    assert walk.validate("01", "json5") is not None and walk.validate("{é:1}", "json5") is not None


@pytest.mark.parametrize("target", [1, 7, 40, 10_000])
def test_parts_fold_to_the_whole(target):
    text = json.dumps({"rows": [{"id": i, "n": i % 7, "s": "x,[]{}\"" * (i % 3)} for i in range(50)]}).encode()
    request = Request((Project(P("rows"), ("id",)), Filter(P("rows"), Compare("gt", "n", N(3)), ("id", "s")), Path(P("rows"), Oracle("count"))))
    plan = Plan.build(text, request, target)
    assert plan.run() == walk.scan(text, request)
    assert Plan.build(text, Request((Slice(Range(0, 1)),))) is None


PIECES = [b'"', b"\\", b"\\u12", b"\\ud800", b"\\u0041", b"\\x", b"01", b"1.", b"-", b"+1", b"1e", b"e5", b",", b":", b"[", b"]", b"{", b"}", b"\x01", b"\n", b"\xff", b"\xc3\xa9", b"\xc3", b"\xed\xa0\x80", b"\xe2\x82\xac", b"\xf0\x9f\x98\x80", b"nul", b"true", b"/", b" "]


@pytest.mark.parametrize("seed", range(40))
def test_damaged_texts_are_refused_alike(seed, monkeypatch):
    """Checked by pattern or node by node: the same refusals, at the same places."""
    rng = random.Random(seed)
    found = []
    for _ in range(60):
        text = bytearray(json.dumps(_some(rng, 5), ensure_ascii=rng.random() < 0.5).encode())
        for _ in range(rng.randrange(3)):
            at = rng.randrange(len(text) + 1)
            text[at : at + rng.randrange(2)] = rng.choice(PIECES)
        request = Request((Whole(),), strictness=rng.choice(["strict", "structural"]), max_nesting=rng.choice([2, 4, 256]))
        found.append((bytes(text), request))

    def outcome(text, request):
        try:
            return walk.scan(text, Request(request.demands, strictness=request.strictness, max_nesting=request.max_nesting))
        except JsonError as error:
            return error.cls, error.code, error.offset

    quick = [outcome(*f) for f in found]
    monkeypatch.setattr(walk, "want_of_request", lambda request, demands: walk.FULL)
    for f, q in zip(found, quick, strict=True):
        assert q == outcome(*f), f
