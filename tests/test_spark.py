"""Operators over DataFrames: null and refused texts, partitions, native against exact, sources and streams."""

import json
import random

import duckdb
import pytest

from lodestream import entries
from lodestream.functions.values import Number
from lodestream.operators import exact, native
from lodestream.plans import gate
from lodestream.plans.model import And, Collection, Compare, Filter, JsonError, Not, Or, Oracle, Path, Project, Range, Request, Slice, Whole, steps
from lodestream.sources import readers

P = steps
SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.mark.parametrize("name", sorted(entries.QUERIES))
def test_queries_equal_sql(spark, duck, name):
    got = entries.QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    want = duck.execute(f"SELECT {', '.join(columns)} FROM ({entries.SQL[name]})").fetchall()
    assert rows(got.select(*columns)) == sorted(map(tuple, want), key=repr)


DOCS = ['{"rows":[{"id":1,"n":5},{"id":2},7,{"id":null,"n":-1},{"n":"7"},{"n":true}]}', '{"rows":[]}', '{"other":1}', None, "[1]"]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, d) for i, d in enumerate(DOCS)], "key int, doc string")


@pytest.mark.parametrize("demand", [Project(P("rows"), ("id", "n")), Filter(P("rows"), Compare("gt", "n", Number("0")), ("id", "n")), Filter(P("rows"), Compare("ne", "n", Number("5"))), Path(P("rows"), Collection(("n",))), Path(P("rows"), Slice(Range(-3, -1), Project((), ("n",)))), Path(P("rows"), Slice(Range(1, None)))])
def test_native_is_exact(docs, demand):
    assert gate.native(demand, Request((demand,)), True) and not gate.native(demand, Request((demand,)), False)
    assert rows(native.rows(docs, "doc", demand, ordinal=None)) == rows(exact.rows(docs, "doc", demand))


def _value(rng, depth):
    kind = rng.randrange(9 if depth else 6)
    if kind < 3:
        return rng.choice(["0", "7", "-3", "12.5", "40", "-0.25", "1000000"])
    if kind < 6:
        return rng.choice(['"seven"', '""', "true", "false", "null", '"n"'])
    if kind == 6:
        return "[" + ",".join(_value(rng, depth - 1) for _ in range(rng.randrange(4))) + "]"
    names = rng.sample(["id", "n", "tag", "rows", "in"], rng.randrange(5))
    return "{" + ",".join(f'"{x}": {_value(rng, depth - 1)}' for x in names) + "}"


def _demand(rng):
    fields = tuple(rng.sample(["id", "n", "tag"], rng.randint(1, 2)))
    path = P(*rng.choice([(), ("rows",), ("rows", "in"), ("n",)]))

    def predicate(depth):
        if depth and rng.random() < 0.5:
            return rng.choice([And, Or])(predicate(depth - 1), predicate(depth - 1)) if rng.random() < 0.7 else Not(predicate(depth - 1))
        x = rng.choice([Number("7"), Number("12.5"), Number("-3"), Number("100"), "seven", True, None])
        return Compare(rng.choice(["eq", "ne", "gt", "lt", "ge", "le"]), rng.choice(["id", "n", "tag"]), x)

    edge = lambda: rng.choice([None, -2, -1, 0, 1, 2, 5])
    inner = rng.choice([None, Project((), fields), Filter((), predicate(1), fields)])
    return rng.choice([Project(path, fields), Filter(path, predicate(2), fields), Filter(path, predicate(1)), Path(path, Collection(fields)) if path else Collection(fields), Path(path, Collection(None, inner)) if path else Collection(None, inner), Path(P("rows"), Slice(Range(edge(), edge()), inner))])


@pytest.mark.parametrize("seed", range(12))
def test_native_is_exact_on_random_texts(spark, seed):
    """Each seed: 45 texts by three demands, with and without ordinals; cells are compared as values."""
    rng = random.Random(seed)
    texts = ["{" + ",".join(f'"{x}": {_value(rng, 3)}' for x in rng.sample(["rows", "n", "id", "in"], rng.randint(1, 4))) + "}" for _ in range(40)] + [_value(rng, 2) for _ in range(5)]
    df = spark.createDataFrame(list(enumerate(texts)), "key int, doc string").coalesce(1).cache()
    load = lambda x: None if x is None else json.dumps(json.loads(x), sort_keys=True)
    for k in range(3):
        demand = _demand(rng)
        assert gate.native(demand, Request((demand,)), True)
        ordinal = "at" if k % 2 else None
        keys = 2 if ordinal else 1
        found = [sorted(repr((*r[:keys], *map(load, r[keys:]))) for r in f(df, "doc", demand, keep=["key"], ordinal=ordinal).collect()) for f in (native.rows, exact.rows)]
        assert found[0] == found[1], demand
    for o in (Oracle("kind"), Oracle("count"), Oracle("has_key", "rows"), Oracle("member_count"), Oracle("member_names"), Oracle("descend_count"), Path(P("rows"), Oracle("member_names")), Path(P("rows", "in"), Oracle("descend_count")), Path(P("n"), Oracle("string_byte_length"))):
        assert rows(gate.value(df, "doc", o, trusted=True)) == rows(exact.value(df, "doc", o)), o


def test_what_the_gate_keeps_exact(spark):
    df = spark.createDataFrame([(1, '{"id":5,"rows":[{"n":-0},{"n":0},{"n":3}]}'), (2, '{"id":6,"rows":{"n":-0.0}}')], "id int, doc string")
    for op in ("eq", "ne", "gt", "lt", "ge", "le"):
        for zero in ("0", "-0", "0.00"):
            f = Filter(P("rows"), Compare(op, "n", Number(zero)))
            assert gate.rows(df, "doc", f, trusted=True).count() == exact.rows(df, "doc", f).count(), (op, zero)
    assert not gate.native(Filter((), Compare("lt", "n", Number("0"))), Request(()), True)
    assert gate.rows(df, "doc", Path(P("rows"), Oracle("count")), trusted=True).collect() == []
    assert gate.rows(df, "doc", Project((), ("id",)), trusted=True).columns == ["id"]
    assert sorted(r.id for r in gate.rows(df, "doc", Project((), ("id",)), trusted=True).collect()) == ["5", "6"]
    with pytest.raises(ValueError, match="no native expression"):
        native.value(df, "doc", Path(P("rows", 0), Oracle("member_names")))


def test_modes(spark):
    bad = spark.createDataFrame([(1, '{"a":1}'), (2, '{"a":'), (3, None)], "key int, doc string")
    found = {r.key: r for r in exact.answers(bad, "doc", Request((Path(P("a")),)), mode="permissive").collect()}
    assert found[1].answers[0].document.text == "1" and found[2].issues[0].code == "expected-value" and found[3].answers is None
    with pytest.raises(Exception, match="expected-value"):
        exact.rows(bad, "doc", Project((), ("a",))).collect()
    assert exact.rows(bad, "doc", Project((), ("a",)), mode="permissive").count() == 1
    with pytest.raises(JsonError):
        exact.total(bad, "doc", Whole())


def test_empty_and_clashing_columns(spark):
    empty = spark.createDataFrame([], "id int, doc string")
    assert exact.rows(empty, "doc", Project((), ("id",))).collect() == []
    assert exact.total(empty, "doc", Oracle("count")).first().n == 0
    one = spark.createDataFrame([(1, '{"id":2}')], "id int, doc string")
    assert [r.id for r in exact.rows(one, "doc", Project((), ("id",))).collect()] == ["2"]


def test_any_partitioning(spark, docs):
    demand = Filter(P("rows"), Compare("ge", "n", Number("-5")), ("n",))
    want = rows(exact.rows(docs, "doc", demand))
    for n in (1, 3, 7):
        assert rows(exact.rows(docs.repartition(n), "doc", demand)) == want


def test_plan_has_no_shuffle_and_reads_two_columns(spark):
    df = exact.rows(spark.read.parquet(f"{SF}/events.parquet"), "props", Project((), ("k",)), keep=["event_id"])
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "ReadSchema: struct<event_id:bigint,props:string>" in plan


def test_traced_marks(spark):
    df = spark.createDataFrame([("[1,2,",)], "doc string")
    r = exact.traced(df, "doc", Request((Slice(Range(0, 1)),))).first()
    assert [e.event for e in r.events] == ["stop", "mark"]


def test_readers(spark, tmp_path):
    items = [{"id": i, "s": "a,]" * (i % 3)} for i in range(30)]
    (tmp_path / "a.ndjson").write_bytes(b"\r\n".join(json.dumps(x).encode() for x in items) + b"\r\n\r\n")
    (tmp_path / "a.seq").write_bytes(b"".join(b"\x1e" + json.dumps(x).encode() + b"\n" for x in items))
    (tmp_path / "a.adj").write_bytes(b" ".join(json.dumps(x).encode() for x in items))
    (tmp_path / "a.json").write_text("﻿" + json.dumps({"all": items}))
    ids = lambda df: sorted(json.loads(r.value)["id"] for r in df.collect())
    want = list(range(30))
    assert ids(readers.ndjson(spark, str(tmp_path / "a.ndjson"))) == want
    assert ids(readers.jsonseq(spark, str(tmp_path / "a.seq"))) == want
    for name, framing in (("a.ndjson", "ndjson"), ("a.seq", "jsonseq"), ("a.adj", "adjacent")):
        got = readers.framed(spark, str(tmp_path / name), framing).orderBy("ordinal").collect()
        assert [json.loads(r.value)["id"] for r in got] == want == [r.ordinal for r in got]
    whole = readers.text(spark, str(tmp_path / "a.json"))
    assert exact.value(whole, "value", Path(P("all"), Oracle("count")), out="n").first().n == "30"
    split = readers.split_array(spark, str(tmp_path / "a.json"), P("all"), target=100).orderBy("ordinal").collect()
    assert [(r.ordinal, json.loads(r.value)["id"]) for r in split] == [(i, i) for i in want]
    readers.write_jsonseq(spark.createDataFrame([("1",), ("2",)], "v string"), "v", str(tmp_path / "out"))
    assert sorted(r.value for r in readers.jsonseq(spark, str(tmp_path / "out")).collect()) == ["1", "2"]
