"""Encoding, edits, facts and framing."""

import json
import random

import pytest
from hypothesis import given
from hypothesis import strategies as st

from lodestream.functions import edit as edit_module
from lodestream.functions import lexer, values
from lodestream.functions.edit import Clear, Comment, Delete, Insert, ReplaceMember, Set, edit, edit_document
from lodestream.functions.encode import Options, compacted, encode_document, encode_part, encode_value, plan_parts, stitch_parts
from lodestream.plans import walk
from lodestream.plans.model import JsonError, Request, Whole, steps
from lodestream.sources.framing import adjacent_prefix, complete_prefix, frames, partition

P = steps
N = values.Number
JSON = st.recursive(st.none() | st.booleans() | st.integers() | st.text(max_size=8), lambda c: st.lists(c, max_size=4) | st.dictionaries(st.text(max_size=4), c, max_size=4), max_leaves=12)


@given(JSON)
def test_round_trip(value):
    for options in (Options(), Options(indent=2), Options(indent="\t", sort_keys=True, ascii=True)):
        text = encode_value(values.of(value), options)
        assert json.loads(text) == value
        assert values.equal(lexer.parse(text), values.of(value))
    assert json.loads(encode_value(lexer.parse(json.dumps(value)))) == value


@given(JSON, st.sampled_from([None, 1]), st.booleans())
def test_compact_texts(value, indent, ascii):
    text = json.dumps(value, indent=indent, ensure_ascii=ascii).encode("utf-8", "replace")
    want = encode_value(lexer.parse(text))
    for options in (Options(), Options(framing="ndjson"), Options(sort_keys=True), Options(indent=2)):
        assert compacted(text, options) in (None, encode_value(lexer.parse(text), options))
    assert (b"\\" in text) == (compacted(text) is None) and compacted(b'{"x": 1, "x": 2}') is None
    assert compacted(text) in (None, want)


def test_spellings_survive():
    text = '{"b":[1.50,-0,1e2,123456789012345678901234567890],"a":"caf\\u00e9\\n\\u0001"}'
    assert encode_value(lexer.parse(text)).decode() == '{"b":[1.50,-0,1e2,123456789012345678901234567890],"a":"café\\n\\u0001"}'


def test_parts_of_a_large_array():
    v = [N(str(i)) for i in range(3000)]
    for options in (Options(), Options(indent=2)):
        assert stitch_parts([encode_part(v, p, options) for p in plan_parts(v)], options) == encode_value(v, options)


def test_write_gate():
    src = b"{ a: 1 }"
    loose = walk.scan(src, Request((Whole(),), dialect="json5")).answers[0]
    with pytest.raises(JsonError):
        encode_document(src, loose, Options(dialect="json5"))
    strict = walk.scan(src, Request((Whole(),), dialect="json5", strictness="strict")).answers[0]
    assert encode_document(src, strict, Options(dialect="json5")) == src
    with pytest.raises(JsonError):
        encode_document(src, strict, Options())
    assert encode_document(src, strict, Options(dialect="json5"), verbatim=False) == b"{a:1}"


@pytest.mark.parametrize(
    ("src", "edits", "want"),
    [
        ('{ "a": 1, "b": 2 }', [Set(P("a"), N("9"))], '{ "a": 9, "b": 2 }'),
        ('{ "a" : 1, "b" : [2, 3] }', [Set(P("a"), N("9")), Delete(P("b", 0))], '{ "a" : 9, "b" : [3] }'),
        ('{"a":1,"b":2,"c":3}', [Delete(P("b"))], '{"a":1,"c":3}'),
        ('{"a":1,"b":2}', [Delete(P("b"))], '{"a":1}'),
        ('{"a":1}', [Delete(P("a"))], "{}"),
        ('{"a":1}', [Delete(P("x")), Delete(P(0))], '{"a":1}'),
        ("[1,2,3]", [Insert(P(0), N("0")), Insert(P(3), N("4"))], "[0,1,2,3,4]"),
        ("[]", [Insert(P(0), None)], "[null]"),
        ("{}", [Insert(P("k"), "x")], '{"k":"x"}'),
        ('{"k":1}', [Insert(P("k"), "x")], '{"k":"x"}'),
        ('{"a":{"x":1},"b":[1]}', [Clear(P("a")), Clear(P("b"))], '{"a":{},"b":[]}'),
        ('{"left":[0],"right":null}', [ReplaceMember(P("left"), "middle", N("5"))], '{"middle":5,"right":null}'),
        ('{"left":[0],"right":null}', [ReplaceMember(P("left"), "right", N("5"))], '{"right":5}'),
        ('{"tag":"x","size":7,"tag":"y"}', [Delete(P("tag"))], '{"size":7}'),
    ],
)
def test_edits(src, edits, want):
    assert edit(src, edits).decode() == want


def test_refused_edits():
    for edits in ([Set(P("x"), None)], [Clear(P("a"))], [Delete(())], [Set(P("a"), None), Set(P("a"), True)]):
        with pytest.raises(JsonError):
            edit('{"a":1}', edits)
    with pytest.raises(JsonError):
        edit('{"a":01}', [Set(P("a"), None)])


def test_comments():
    src = "// lead\n[ 1/* inner */, 2 ] // trail\n"
    facts = walk.scan(src, Request((Whole(),), strictness="strict", dialect="jsonc", facts=True)).answers[0].facts
    assert [(f.role, src[f.start : f.end]) for f in facts] == [("lead", "// lead"), ("foot", "/* inner */"), ("lead", "/* inner */"), ("foot", "// trail")]
    only = walk.scan("{ /* only */ }", Request((Whole(),), strictness="strict", dialect="jsonc", facts=True)).answers[0].facts
    assert [f.role for f in only] == ["inline"]
    out, doc = edit_document('{"a":1}', [Comment(P("a"), "insert", "lead", "hi")], "jsonc")
    assert out == b'{"a":// hi\n1}' and [f.role for f in doc.facts] == ["lead"]
    assert edit('{"a":// hi\n1}', [Comment(P("a"), "clear", "lead")], "jsonc") == b'{"a":\n1}'
    assert edit('{"a":1}', [Comment(P("a"), "insert", "lead", "hi")]) == b'{"a":1}'


EDITS = [
    [Set(P("k"), N("12345"))], [Insert(P("z"), "new")], [Delete(P("drop"))], [Comment(P("xs"), "insert", "lead", "fresh")], [Comment(P("k"), "replace", "lead", "other")],
    [Comment(P("k"), "clear", "lead"), Set(P("k"), None)], [Insert(P("xs", 0), N("7")), Comment(P("k"), "replace", "lead", "longer than before")], [Comment(P("e"), "insert", "inline", "empty")], [],
]


@pytest.mark.parametrize("edits", EDITS)
def test_comments_are_carried(edits):
    """Where nothing but places change, the carried comments are those that a reading of the edited text finds."""
    src = '// top\n{\n  // of k\n  "k": 1,\n  "drop": true,\n  "xs": [2, // two\n    3],\n  "e": {}\n}\n// end\n'
    out, doc = edit_document(src, edits, "jsonc")
    again = walk.scan(out, Request((Whole(),), strictness="strict", dialect="jsonc", facts=True)).answers[0].facts
    texts = lambda facts: [(out[f.start : f.end].decode(), out[f.owner_start : f.owner_end].decode()) for f in facts]
    assert set(texts(doc.facts)) <= set(texts(again)) and {t for t, _ in texts(doc.facts)} == {t for t, _ in texts(again)}
    assert [f.start for f in doc.facts] == sorted(f.start for f in doc.facts)


def test_comment_actions():
    src = '[1, /* a */ /* b */ 2]'
    assert edit(src, [Comment(P(1), "replace", "lead", "c")], "jsonc") == b"[1, /* c */ /* c */ 2]"
    assert edit(src, [Comment(P(1), "clear", "lead")], "jsonc") == edit(src, [Comment(P(1), "replace", "lead", "")], "jsonc") == b"[1,   2]"
    assert edit(src, [Comment(P(0), "insert", "lead", "")], "jsonc").decode() == src
    for bad in ([Comment(P(0), "replace", "inline", "x")], [Comment(P(0), "insert", "lead", "a\nb")], [Comment(P(9), "clear", "lead")]):
        with pytest.raises(JsonError):
            edit(src, bad, "jsonc")


def test_framing():
    assert frames(b'1\r\n\r\n2\r3', "ndjson") == [(0, 1), (5, 6), (7, 8)]
    assert len(frames(b"\x1e1\n\x1e2\n", "jsonseq")) == 2 and len(frames(b"1 2 3", "adjacent")) == 3
    assert [complete_prefix(x, "ndjson") for x in (b"1\n2\n", b"1\n2", b"1\r\n2\r\n")] == [4, 2, 6]
    assert complete_prefix(b"\x1e1\n\x1e2", "jsonseq") == 3
    assert [adjacent_prefix(x) for x in (b"1 2 3", b"1 2 3 ", b'{"a":1} {"b":', b"12", b"12 ", b"   ")] == [4, 6, 8, 0, 3, 3]
    src = b"".join(b'{"i":%d}\n' % i for i in range(40))
    for target in (1, 50, 10_000):
        parts = partition(src, "ndjson", target)
        assert sum(len(frames(src[s:e], "ndjson")) for s, e in parts) == 40


def _random_edit(rng, value):
    path, at = [], value
    for _ in range(rng.randint(1, 3)):
        if isinstance(at, dict) and at and rng.random() < 0.9:
            path.append(rng.choice(list(at)))
            at = at[path[-1]]
        elif isinstance(at, list) and at and rng.random() < 0.9:
            i = rng.randrange(-len(at), len(at))
            path.append(i)
            at = at[i]
        else:
            path.append(rng.choice(["new", 0, -1, 7]))
            break
    p = P(*path)
    return rng.choice([Set(p, N("1.50")), Insert(p, ["x"]), Delete(p), Clear(p), ReplaceMember(p, "re\"named", None)])


@pytest.mark.parametrize("seed", range(60))
def test_edits_read_no_more_than_their_ways(seed, monkeypatch):
    """The same text, or the same refusal, as from a reading of all nodes; damaged texts among them."""
    rng = random.Random(seed)

    def some(depth):
        kind = rng.randrange(8 if depth else 5)
        if kind == 5:
            return [some(depth - 1) for _ in range(rng.randrange(4))]
        if kind > 5:
            return {k: some(depth - 1) for k in rng.sample(["a", "b", "é", 'q"', "new"], rng.randrange(5))}
        return rng.choice([None, True, 0, -2.5, "x\n", "é"])

    cases = []
    for _ in range(25):
        value = some(5)
        text = json.dumps(value, ensure_ascii=rng.random() < 0.5, indent=rng.choice([None, 1])).encode()
        if rng.random() < 0.2:
            at = rng.randrange(len(text) + 1)
            text = text[:at] + rng.choice([b"01", b'"', b",", b"\\ud800", b"}"]) + text[at:]
        cases.append((text, [_random_edit(rng, value) for _ in range(rng.randint(1, 2))]))

    def outcome(text, edits):
        try:
            return edit(text, edits)
        except JsonError as error:
            return error.cls, error.code, error.offset

    quick = [outcome(*c) for c in cases]
    monkeypatch.setattr(edit_module, "_want", lambda path: lexer.FULL)
    for c, q in zip(cases, quick, strict=True):
        assert q == outcome(*c), c


@given(JSON)
def test_values_by_the_scanner(value):
    """The value that the standard scanner gives is the nodes' own: spellings, order and repeated names."""
    text = json.dumps(value).replace("{}", '{"d": 1.50, "e": -0, "d": 1E2}').encode()
    assert values.strict_equal(lexer.parse(text), lexer.value_of(text, lexer.Reader(text).document()))
