"""More queries over the test tables: one for each finer operator, and the same in DuckDB's SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestream.entries import _HOURS, _LINES, ITEMS, _n, _streams, _typed, events, orders, query
from lodestream.functions import columns as c
from lodestream.functions import edit as e
from lodestream.functions import exact_columns as x
from lodestream.functions.encode import Options
from lodestream.operators import exact, parts
from lodestream.operators.control import Limits
from lodestream.plans import gate
from lodestream.plans import model as m
from lodestream.plans.build import at, field
from lodestream.sources.ranges import adjacent_records, array_elements
from lodestream.sources.scratch import fresh_path
from lodestream.streaming import records

_E = "(SELECT event_id, (props->>'$.k')::BIGINT AS k FROM events)"


def _made(spark: SparkSession, sf_dir: str, *parts: object) -> DataFrame:
    """(event_id, doc): a text of literal parts and columns for each event; K stands for its number."""
    k = F.get_json_object("props", "$.k")
    pieces = [k if p is K else F.lit(p) if isinstance(p, str) else p for p in parts]
    return events(spark, sf_dir).select("event_id", F.concat(*pieces).alias("doc"))


K = object()


# Scans.


@query("SELECT hour, framing, count(*) AS n FROM (SELECT date_trunc('hour', ts) AS hour FROM events), (SELECT unnest(['text', 'ndjson', 'jsonseq', 'adjacent']) AS framing) GROUP BY ALL")
def json_dispatch(spark, sf_dir):
    """The same records as one text and in each framing."""
    made = None
    for framing, before, after in (("text", ",", ""), ("ndjson", "", "\n"), ("jsonseq", "\x1e", "\n"), ("adjacent", " ", "")):
        docs = _streams(spark, sf_dir, before, after)
        if framing == "text":
            docs = docs.select("hour", F.concat(F.lit("["), F.substr("doc", F.lit(2)), F.lit("]")).alias("doc"))
        one = exact.value(docs, "doc", m.Oracle("count"), out="n", framing=framing).select("hour", F.lit(framing).alias("framing"), F.col("n").cast("long").alias("n"))
        made = one if made is None else made.unionByName(one)
    return made


@query("SELECT * FROM (VALUES ('eq', 'predicate-operand'), ('ne', 'predicate-operand'), ('gt', ''), ('lt', ''), ('ge', ''), ('le', '')) v(op, code)")
def json_refuse_container(spark, sf_dir):
    """A container as an operand of eq and ne is refused before any text is read."""
    found = []
    for op in ("eq", "ne", "gt", "lt", "ge", "le"):
        try:
            exact.rows(events(spark, sf_dir), "props", m.Filter((), m.Compare(op, "k", [_n("1")])))
            found.append((op, ""))
        except m.JsonError as error:
            found.append((op, error.code))
    return spark.range(1).select(F.explode(F.array(*[F.struct(F.lit(a).alias("op"), F.lit(b).alias("code")) for a, b in found])).alias("r")).select("r.*")


@query(f"SELECT hour, pos, k, k AS again FROM ({_HOURS})")
def json_stream_whole(spark, sf_dir):
    """Two whole demands over a stream give the same column of records."""
    a = exact.answers(_streams(spark, sf_dir, "", "\n"), "doc", m.Request((m.Whole(), m.Whole()), framing="ndjson"))
    both = a.select("hour", F.posexplode(F.arrays_zip(c.field_column(F.col("answers")[0], 0).alias("x"), c.field_column(F.col("answers")[1], 0).alias("y"))).alias("pos", "r"))
    k = lambda t: F.get_json_object(t, "$.k").cast("long")
    return both.select("hour", F.col("pos").cast("long").alias("pos"), k(F.col("r.x")).alias("k"), k(F.col("r.y")).alias("again"))


@query("SELECT date_trunc('hour', ts) AS hour, count(*) AS ordinal, 'expected-value' AS code, sum(strlen(props) + 1)::BIGINT + 5 AS place FROM events GROUP BY ALL")
def json_records_issues(spark, sf_dir):
    """Each record by itself; a cut last one is a record with an issue, at its place in the stream."""
    docs = _streams(spark, sf_dir, "", "\n").select("hour", F.concat("doc", F.lit('{"k":')).alias("doc"))
    r = exact.records(docs, "doc", m.Request((m.Path(m.steps("k")),), framing="ndjson")).filter(F.size("issues") > 0)
    return r.select("hour", "ordinal", F.col("issues")[0]["code"].alias("code"), F.col("issues")[0]["offset"].alias("place"))


@query(f"SELECT event_id, 2 AS demands, 1 AS answered, 'missing' AS kind, k, 1 AS skips, 7 AS skipped FROM {_E}")
def json_traced(spark, sf_dir):
    """What a reading did: a mark for each demand, and the regions that it only located."""
    docs = _made(spark, sf_dir, '{"k":', K, ',"x":[1,2,3]}')
    t = exact.traced(docs, "doc", m.Request((m.Path(m.steps("none")), m.Path(m.steps("k")))))
    marks = F.filter("events", lambda v: v["event"] == "mark")
    found = t.join(docs, "event_id").select("event_id", "counters", marks.alias("marks"), "doc", F.filter("events", lambda v: v["event"] == "skip").alias("skips"))
    k = F.expr("substr(doc, marks[1].start + 1, marks[1].end - marks[1].start)").cast("long")
    return found.select("event_id", F.col("counters.demands").cast("int").alias("demands"), F.col("counters.answered").cast("int").alias("answered"), F.col("marks")[0]["kind"].alias("kind"), k.alias("k"), F.col("counters.skips").cast("int").alias("skips"), F.col("counters.skipped_bytes").cast("int").alias("skipped"))


@query(f"SELECT event_id, 1 AS stops, k FROM {_E}")
def json_early_stop(spark, sf_dir):
    """A bounded window ends the reading of any array behind names; what follows isn't looked at."""
    docs = _made(spark, sf_dir, '{"pad":{"x":[0]},"in":{"xs":[', K, ', 2, 3, oh no')
    t = exact.traced(docs, "doc", m.Request((m.Path(m.steps("in", "xs"), m.Slice(m.Range(0, 1))),)))
    return t.select("event_id", F.col("counters.stops").cast("int").alias("stops"), F.col("answers")[0]["rows"][0][0]["text"].cast("long").alias("k"))


@query(f"SELECT event_id, CASE WHEN k % 4 > 2 THEN 'memory-exceeded' END AS code, CASE WHEN k % 4 <= 2 THEN k % 4 END AS n FROM {_E}")
def json_controlled(spark, sf_dir):
    """A ceiling for what answers hold: texts with more than two elements are refused."""
    many = F.array_join(F.array_repeat(F.lit("0"), F.expr("cast(get_json_object(props, '$.k') as int) % 4")), ",")
    docs = _made(spark, sf_dir, "[", many, "]")
    a = exact.answers(docs, "doc", m.Request((m.Collection(),)), mode="permissive", limits=Limits(most_bytes=32))
    return a.select("event_id", F.get("issues", F.lit(0))["code"].alias("code"), F.when(F.col("answers").isNotNull(), F.size(F.col("answers")[0]["rows"])).cast("long").alias("n"))


@query(f"SELECT event_id, CASE WHEN k % 2 = 0 THEN 'deadline-exceeded' END AS code, CASE WHEN k % 2 = 1 THEN 1 END AS answered FROM {_E}")
def json_traced_controlled(spark, sf_dir):
    """A deadline that is over refuses each text; without one the trace is there."""
    docs = _made(spark, sf_dir, '{"k":', K, "}")
    request = m.Request((m.Path(m.steps("k")),))
    odd = F.expr("cast(get_json_object(doc, '$.k') as int) % 2 = 1")
    late = exact.traced(docs.filter(~odd), "doc", request, mode="permissive", limits=Limits(until=0.0))
    free = exact.traced(docs.filter(odd), "doc", request, mode="permissive", limits=Limits(seconds=3600.0))
    return late.unionByName(free).select("event_id", F.get("issues", F.lit(0))["code"].alias("code"), F.col("counters.answered").cast("int").alias("answered"))


# Framing.


def _parts(framing: str, before: str, after: str):
    def run(spark, sf_dir):
        cut = _streams(spark, sf_dir, before, after).select("hour", F.explode(x.partition(F.col("doc"), framing, 40)).alias("doc"))
        rows = exact.rows(cut, "doc", m.Project((), ("k",)), keep=["hour"], framing=framing)
        return rows.select("hour", F.col("k").cast("long").alias("k"))

    run.__name__ = f"json_partition_{framing}"
    query(f"SELECT hour, k FROM ({_HOURS})")(run)


_parts("ndjson", "", "\n")
_parts("jsonseq", "\x1e", "\n")
_parts("adjacent", " ", "")


@query("SELECT date_trunc('hour', ts) AS hour, sum(strlen(props) + 1)::BIGINT AS held FROM events GROUP BY ALL")
def json_holdback(spark, sf_dir):
    """Of a stream that is still written, the lines that are complete."""
    docs = _streams(spark, sf_dir, "", "\n").select("hour", F.concat("doc", F.lit('{"k": 1')).alias("doc"))
    return docs.select("hour", x.complete_prefix(F.col("doc"), "ndjson").alias("held"))


@query("SELECT date_trunc('hour', ts) AS hour, sum(strlen(props) + 1)::BIGINT AS held FROM events GROUP BY ALL")
def json_holdback_adjacent(spark, sf_dir):
    """A value that touches the end may go on, so it is held back."""
    docs = _streams(spark, sf_dir, "", " ").select("hour", F.concat("doc", F.lit("12")).alias("doc"))
    return docs.select("hour", x.complete_prefix(F.col("doc"), "adjacent").alias("held"))


@query(f"SELECT event_id, k, 8 AS place FROM {_E}")
def json_byte_order_mark(spark, sf_dir):
    """A leading byte order mark is skipped; offsets count it."""
    docs = _made(spark, sf_dir, '\ufeff{"k":', K, "}")
    a = exact.answers(docs, "doc", m.Request((m.Path(m.steps("k")),)))
    doc = F.col("answers")[0]["document"]
    return a.select("event_id", doc["text"].cast("long").alias("k"), doc["start"].cast("int").alias("place"))


@query("SELECT event_id, 'q,f' AS fields, 0 AS n, 0 AS records FROM events")
def json_empty_stream(spark, sf_dir):
    """A stream without records: an empty batch with the demand's fields, and a count of none."""
    docs = events(spark, sf_dir).select("event_id", F.lit(" \n\r\n\t\n").alias("doc"))
    a = exact.answers(docs, "doc", m.Request((m.Project((), ("q", "f")), m.Oracle("count")), framing="ndjson"))
    return a.select("event_id", F.array_join(F.col("answers")[0]["fields"], ",").alias("fields"), F.size(F.col("answers")[0]["rows"]).alias("n"), F.col("answers")[1]["oracle"].cast("int").alias("records"))


# Demands.


@query(f"SELECT event_id, k FROM {_E}")
def json_spent_path(spark, sf_dir):
    """Paths of no steps are what they hold."""
    rows = exact.rows(_made(spark, sf_dir, '[{"k":', K, "}]"), "doc", m.Path((), m.Path((), m.Collection(None, m.Path((), m.Project((), ("k",)))))))
    return rows.select("event_id", F.col("k").cast("long").alias("k"))


def _object(name: str, rows, demand: m.Demand, sql: str) -> None:
    def run(spark, sf_dir):
        docs = _made(spark, sf_dir, '{"o":{"k":', K, ',"z":[1]}}')
        return rows(docs, "doc", demand).select("event_id", F.col("k").cast("long").alias("k"))

    run.__name__ = name
    query(sql)(run)


def _native(docs: DataFrame, column: str, demand: m.Demand) -> DataFrame:
    assert gate.native(demand, m.Request((demand,)), True)
    return gate.rows(docs, column, demand, trusted=True)


_object("json_project_object", exact.rows, m.Project(m.steps("o"), ("k",)), f"SELECT event_id, k FROM {_E}")
_object("json_project_object_native", _native, m.Project(m.steps("o"), ("k",)), f"SELECT event_id, k FROM {_E}")
_object("json_filter_object_native", _native, m.Filter(m.steps("o"), m.Compare("ge", "k", _n("50")), ("k",)), f"SELECT event_id, k FROM {_E} WHERE k >= 50")


@query("SELECT event_id, op FROM events, (VALUES ('lt', 0), ('ge', 1), ('eq', 1)) v(op, odd) WHERE event_id % 2 = odd")
def json_negative_zero_native(spark, sf_dir):
    """-0 comes before 0, which the native path can't see; so the gate leaves such operands to the exact one."""
    docs = events(spark, sf_dir).select("event_id", F.when(F.expr("event_id % 2 = 0"), F.lit('{"n":-0}')).otherwise(F.lit('{"n":0.0}')).alias("doc"))
    made = None
    for op in ("lt", "ge", "eq"):
        one = gate.rows(docs, "doc", m.Filter((), m.Compare(op, "n", _n("0")), ("n",)), trusted=True).select("event_id", F.lit(op).alias("op"))
        made = one if made is None else made.unionByName(one)
    return made


@query(f"SELECT event_id, '[\"z\",\"k\",\"a\"]' AS names, 5 AS nodes FROM {_E}")
def json_oracle_names_native(spark, sf_dir):
    """Names in authored order and a count of all values, without leaving the JVM."""
    docs = _made(spark, sf_dir, '{"z": "x,{[", "k": ', K, ', "a": [ true ]}')
    names = gate.value(docs, "doc", m.Oracle("member_names"), trusted=True, out="names")
    nodes = gate.value(docs, "doc", m.Oracle("descend_count"), trusted=True, out="nodes")
    return names.join(nodes, "event_id").select("event_id", "names", F.col("nodes").cast("int").alias("nodes"))


@query(f"SELECT id, n FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY pos) AS r FROM ({_LINES}) WHERE q > 10) WHERE r BETWEEN 2 AND 3")
def json_windowed_batch(spark, sf_dir):
    """Some rows of a batch by their places: the second and third row that a filter leaves."""
    return _typed(exact.rows(orders(spark, sf_dir), "doc", m.Filter(ITEMS, m.Compare("gt", "q", _n("10")), ("n",)), window=m.Range(1, 3)))


@query(f"SELECT id, string_agg(q, ',' ORDER BY pos) AS qs, count(d) AS ds FROM ({_LINES}) GROUP BY id")
def json_column(spark, sf_dir):
    """One column of a batch at a time; absent cells are null."""
    a = exact.answers(orders(spark, sf_dir), "doc", m.Request((m.Project(ITEMS, ("q", "d")),)))
    return a.select("id", F.array_join(c.field_column(F.col("answers")[0], 0), ",").alias("qs"), F.size(F.filter(c.field_column(F.col("answers")[0], 1), lambda v: v.isNotNull())).cast("long").alias("ds"))


_P10 = m.Or(m.And(m.Compare("gt", "q", _n("3e1")), m.Not(m.Compare("eq", "f", "N"))), m.Compare("ne", "d", _n("0.060")))


@query(f"SELECT id, n FROM ({_LINES}) WHERE (q > 30 AND f <> 'N') OR d IS NULL OR d <> 0.06")
def json_matches(spark, sf_dir):
    """A predicate on values that are already parsed."""
    rows = exact.rows(orders(spark, sf_dir), "doc", m.Path(ITEMS, m.Collection()))
    return rows.filter(x.matches(F.col("value"), _P10)).select("id", F.get_json_object("value", "$.n").cast("long").alias("n"))


@query(f"SELECT event_id, spelling FROM {_E}, (SELECT unnest(['30', '3e1', '30.000', '0.3E+2']) AS spelling) WHERE k > 30")
def json_operand_spellings(spark, sf_dir):
    """Operands are numbers, not spellings."""
    made = None
    for spelling in ("30", "3e1", "30.000", "0.3E+2"):
        one = exact.rows(events(spark, sf_dir), "props", m.Filter((), m.Compare("gt", "k", _n(spelling)), ("k",)), keep=["event_id"]).select("event_id", F.lit(spelling).alias("spelling"))
        made = one if made is None else made.unionByName(one)
    return made


@query("SELECT event_id, '$' AS fields, 0 AS n FROM events")
def json_oracle_in_collection(spark, sf_dir):
    """A question under a collection adds no rows."""
    a = exact.answers(_made(spark, sf_dir, "[", K, ",[1],{}]"), "doc", m.Request((m.Collection(None, m.Oracle("count")),)))
    return a.select("event_id", F.col("answers")[0]["fields"][0].alias("fields"), F.size(F.col("answers")[0]["rows"]).alias("n"))


@query(f"SELECT id, n, p FROM ({_LINES}) WHERE pos >= 1 AND (q > 30 AND f = 'N' OR d IS NULL)")
def json_expressions(spark, sf_dir):
    """Demands and predicates written as expressions."""
    demand = at("items")[1:].where((field("q") > 30) & (field("f") == "N") | ~(field("d") >= 0)).project("n", "p")
    return _typed(exact.rows(orders(spark, sf_dir), "doc", demand))


# Parts of one array.


@query(f"SELECT id, string_agg(n || ':' || q, ',' ORDER BY pos) AS rows FROM ({_LINES}) WHERE q > 20 GROUP BY id")
def json_parts(spark, sf_dir):
    """Arrays cut into ranges that tasks answer apart; parts and places give the rows' order."""
    rows = parts.rows(orders(spark, sf_dir), "doc", m.Filter(ITEMS, m.Compare("gt", "q", _n("20")), ("n", "q")), target=60, keep=["id"])
    ordered = F.array_sort(F.collect_list(F.struct("part", "at", F.concat("n", F.lit(":"), "q").alias("row"))))
    return rows.groupBy("id").agg(F.array_join(F.transform(ordered, lambda r: r["row"]), ",").alias("rows"))


@query(f"SELECT id, max(len)::BIGINT AS n FROM ({_LINES}) GROUP BY id")
def json_parts_count(spark, sf_dir):
    """Counts of the parts add up."""
    return parts.count(orders(spark, sf_dir), "doc", m.Path(ITEMS, m.Oracle("count")), by=["id"], target=60)


@query(f"SELECT id, max(len)::BIGINT AS n, string_agg(q, ',' ORDER BY pos) AS qs, coalesce(string_agg(CASE WHEN q > 25 THEN n END, ',' ORDER BY pos), '') AS big FROM ({_LINES}) GROUP BY id")
def json_fold(spark, sf_dir):
    """Several demands on one array, its ranges answered apart: rows follow one another, counts add up."""
    request = m.Request((at("items").count(), at("items").project("q"), at("items").where(field("q") > 25).project("n")))
    a = parts.folded(orders(spark, sf_dir), "doc", request, target=50)
    rows = lambda i: F.array_join(c.field_column(F.col("answers")[i], 0), ",")
    return a.select("id", F.col("answers")[0]["oracle"].cast("long").alias("n"), rows(1).alias("qs"), rows(2).alias("big"))


@query(f"SELECT event_id, k, CASE WHEN k % 2 = 0 THEN 'parts' ELSE 'serial' END AS way FROM {_E}")
def json_parts_or_serial(spark, sf_dir):
    """A text that holds no array to cut is answered serially, as one part."""
    even = F.expr("cast(get_json_object(props, '$.k') as int) % 2 = 0")
    docs = _made(spark, sf_dir, F.when(even, F.lit('{"o":[{"k":')).otherwise(F.lit('{"o":{"k":')), K, F.when(even, F.lit("}]}")).otherwise(F.lit("}}")))
    demand = m.Project(m.steps("o"), ("k",))
    way = parts.spread(docs, "doc", demand).select("event_id", F.when(F.col("whole"), "serial").otherwise("parts").alias("way"))
    return parts.rows(docs, "doc", demand).join(way, "event_id").select("event_id", F.col("k").cast("long").alias("k"), "way")


@query("SELECT date_trunc('hour', ts) AS hour, '[' || chr(10) || string_agg('  {' || chr(10) || '    \"k\": ' || (props->>'$.k') || chr(10) || '  }', ',' || chr(10) ORDER BY event_id) || chr(10) || ']' AS encoded FROM events GROUP BY ALL")
def json_encode_parts(spark, sf_dir):
    """One array written by many tasks: the same text as one write gives."""
    docs = _streams(spark, sf_dir, ",", "").select("hour", F.concat(F.lit("["), F.substr("doc", F.lit(2)), F.lit("]")).alias("doc"))
    return parts.encoded(docs, "doc", ["hour"], Options(indent=2), least=3)


@query(f"SELECT event_id, k FROM {_E}")
def json_array_ranges(spark, sf_dir):
    """One array in one file: ranges of the file are read by many tasks, elements by their places."""
    path = fresh_path(spark, "array")
    every = events(spark, sf_dir).select(F.concat(F.lit('{"id": '), F.col("event_id").cast("string"), F.lit(', "t": ",]\\"[", "k": '), F.get_json_object("props", "$.k"), F.lit("}")).alias("x"))
    every.agg(F.concat(F.lit("[ "), F.array_join(F.collect_list("x"), " , "), F.lit(" ]")).alias("value")).write.text(path)
    rows = exact.rows(array_elements(spark, path), "value", m.Project((), ("id", "k")), keep=[])
    return rows.select(F.col("id").cast("long").alias("event_id"), F.col("k").cast("long").alias("k"))


@query(f"SELECT event_id, k FROM {_E}")
def json_adjacent_ranges(spark, sf_dir):
    """Values back to back in one file, read in ranges by many tasks."""
    path = fresh_path(spark, "adjacent")
    every = events(spark, sf_dir).select(F.concat(F.lit('{"id": '), F.col("event_id").cast("string"), F.lit(', "t": ["}{"], "k": '), F.get_json_object("props", "$.k"), F.lit("}")).alias("x"))
    every.agg(F.array_join(F.collect_list("x"), " 7 ").alias("value")).write.text(path)
    rows = exact.rows(adjacent_records(spark, path), "value", m.Filter((), m.Compare("ne", "id", None), ("id", "k")), keep=[])
    return rows.select(F.col("id").cast("long").alias("event_id"), F.col("k").cast("long").alias("k"))


@query(f"SELECT event_id, k FROM {_E} WHERE k > 25")
def json_stream_rows(spark, sf_dir):
    """The same operator over a stream of files, each record as it comes."""
    path = fresh_path(spark, "stream")
    lines = events(spark, sf_dir).select(F.concat(F.lit('{"id":'), F.col("event_id").cast("string"), F.lit(',"k":'), F.get_json_object("props", "$.k"), F.lit("}")).alias("value"))
    lines.write.text(f"{path}/in")
    found = records.rows(spark.readStream.text(f"{path}/in"), "value", m.Filter((), m.Compare("gt", "k", _n("25")), ("id", "k")), keep=[])
    found.writeStream.trigger(availableNow=True).option("checkpointLocation", f"{path}/state").format("parquet").start(f"{path}/out").awaitTermination()
    return spark.read.schema("id string, k string").parquet(f"{path}/out").select(F.col("id").cast("long").alias("event_id"), F.col("k").cast("long").alias("k"))


# Values.


@query(f"SELECT event_id, k::DECIMAL(38, 0) AS small, CASE WHEN event_id % 2 = 0 THEN 18446744073709551615::DECIMAL(38, 0) END AS big, CASE WHEN event_id % 2 = 0 THEN 18446744073709551615::DECIMAL(38, 0) ELSE -1 END AS wide FROM {_E}")
def json_unsigned(spark, sf_dir):
    """Integers of 64 bits without a sign, and wider ones."""
    cell = F.when(F.expr("event_id % 2 = 0"), F.lit("18446744073709551615")).otherwise(F.lit("-1"))
    return events(spark, sf_dir).select("event_id", c.as_u64(F.get_json_object("props", "$.k")).alias("small"), c.as_u64(cell).alias("big"), c.as_i128(cell).alias("wide"))


@query(f"SELECT event_id, k || '.50|\"b\"|[]' AS elements, 'z=1e2,k=' || k AS members, CASE WHEN k > 9 THEN 4 ELSE 4 END AS size FROM {_E}")
def json_elements_members(spark, sf_dir):
    """Elements and members as texts, spellings and order as authored."""
    docs = _made(spark, sf_dir, "[", K, '.50, "b", [ ]]').select("event_id", F.col("doc").alias("a")).join(_made(spark, sf_dir, '{"z": 1e2, "k": ', K, "}"), "event_id")
    pairs = F.transform(x.members(F.col("doc")), lambda p: F.concat(p["name"], F.lit("="), p["value"]))
    return docs.select("event_id", F.array_join(x.elements(F.col("a")), "|").alias("elements"), F.array_join(pairs, ",").alias("members"), (x.length(F.col("a")) + F.size(x.members(F.col("doc"))) - 1).cast("int").alias("size"))


@query(f"SELECT event_id, k AS last, NULL::BIGINT AS beyond, k AS deep, 'array' AS kind FROM {_E}")
def json_navigate(spark, sf_dir):
    """Steps into parsed values: indexes from either end, names, and what isn't there."""
    docs = _made(spark, sf_dir, '{"xs": [true, {"k": ', K, "}, ", K, "]}")
    xs = x.member(F.col("doc"), "xs")
    return docs.select("event_id", x.element(xs, -1).cast("long").alias("last"), x.element(xs, 3).cast("long").alias("beyond"), x.member(x.element(xs, 1), "k").cast("long").alias("deep"), c.kind(xs).alias("kind"))


@query(f"SELECT event_id, true AS same, false AS strictly, true AS itself, CASE WHEN k < 50 THEN -1 WHEN k > 50 THEN 1 ELSE 0 END AS place, NULL::INTEGER AS none FROM {_E}")
def json_equality(spark, sf_dir):
    """Equal by value, equal as written, and the order of numbers."""
    docs = _made(spark, sf_dir, '{"a":', K, ',"b":[1.0]}').join(_made(spark, sf_dir, '{"b":[1],"a":', K, ".0}").withColumnRenamed("doc", "other"), "event_id")
    a, b = F.col("doc"), F.col("other")
    return docs.select("event_id", x.equal(a, b).alias("same"), x.strict_equal(a, b).alias("strictly"), x.strict_equal(a, a).alias("itself"), x.order(x.member(a, "a"), F.lit("0.5e2")).alias("place"), x.order(a, b).alias("none"))


@query(f"SELECT event_id, CASE WHEN k = 0 THEN '50' ELSE k || '50' END AS digits, 1::BIGINT AS scale, true AS negative FROM {_E}")
def json_decimal_parts(spark, sf_dir):
    """A number's coefficient, scale and sign, whatever its size."""
    docs = _made(spark, sf_dir, "-", K, ".50e1")
    d = F.col("doc")
    return docs.select("event_id", x.coefficient(d).alias("digits"), x.scale(d).alias("scale"), x.negative(d).alias("negative"))


@query(f"SELECT event_id, '{{\"a\":' || k || ',\"é\":\"\\n\",\"c\":[1.50,null]}}' AS shown FROM {_E}")
def json_display(spark, sf_dir):
    """A parsed value's text: JSON5 in, JSON out; the last of a repeated name in the first one's place."""
    docs = _made(spark, sf_dir, "{a: 1, 'é': '\\x0a', c: [1.50, null,], /* again */ a: ", K, "}")
    return docs.select("event_id", x.display(F.col("doc"), "json5").alias("shown"))


@query(f"SELECT event_id, 'invalid-number' AS code, 12 + strlen(k::VARCHAR) AS place FROM {_E}")
def json_error_place(spark, sf_dir):
    """A lazily located value fails when it is materialized, at its place in the whole text."""
    docs = _made(spark, sf_dir, '{"p":', K, ',"v":[01]}').select("event_id", F.concat(F.lit(" "), "doc").alias("doc"))
    v = exact.materialized(docs, "doc", m.Path(m.steps("v")), mode="permissive", strictness="lazy")
    return v.select("event_id", F.col("issue.code").alias("code"), F.col("issue.offset").cast("long").alias("place"))


# Writing.


@query("SELECT event_id, NULL::VARCHAR AS encoded, 'write' AS code FROM events")
def json_write_gate(spark, sf_dir):
    """Only what a strict reading located is written as it stands."""
    made = exact.encoded(events(spark, sf_dir), "props", verbatim=True, keep=["event_id"], mode="permissive", strictness="structural")
    return made.select("event_id", "encoded", F.col("issue.code").alias("code"))


@query(f"SELECT event_id, '{{ \"k\" :' || k || ' , \"b\":[ ]}}' AS encoded FROM {_E}")
def json_write_verbatim(spark, sf_dir):
    """The root's bytes as they are, gaps and all."""
    return exact.encoded(_made(spark, sf_dir, ' { "k" :', K, ' , "b":[ ]} \n'), "doc", verbatim=True, keep=["event_id"])


@query(f"SELECT event_id, '{{' || chr(10) || '  \"k\": ' || k || 'e0,' || chr(10) || '  \"k\": \"\\u0041\"' || chr(10) || '}}' AS encoded FROM {_E}")
def json_write_tokens(spark, sf_dir):
    """Token by token: spellings, escapes and repeated names stay, gaps are the writer's."""
    return exact.encoded(_made(spark, sf_dir, '{"k":', K, 'e0 , "k" : "\\u0041"}'), "doc", verbatim=True, options=Options(indent=2), keep=["event_id"])


@query(f"SELECT event_id, '{{\"k\":' || k || '}}' || chr(10) AS lines, chr(30) || '{{\"k\":' || k || '}}' || chr(10) AS seq FROM {_E}")
def json_item_framing(spark, sf_dir):
    """Each item with what its framing puts around it."""
    docs = _made(spark, sf_dir, '{"k": ', K, "}")
    lines = exact.encoded(docs, "doc", out="lines", options=Options(framing="ndjson"), keep=["event_id"])
    return lines.join(exact.encoded(docs, "doc", out="seq", options=Options(framing="jsonseq"), keep=["event_id"]), "event_id")


@query(f"SELECT event_id, '[/* a */1,// b' || chr(10) || k || ']' AS encoded FROM {_E}")
def json_write_comments(spark, sf_dir):
    """Comments are written again where they stand, each once; a line comment ends its line."""
    return exact.encoded(_made(spark, sf_dir, "[ /* a */ 1 , // b\n  ", K, " ]"), "doc", dialect="jsonc", keep=["event_id"])


# Edits.


@query(f"""SELECT event_id, '{{"key":7, "xs": [], "y": ' || k || '}}' AS edited FROM {_E}""")
def json_edit_rename(spark, sf_dir):
    """A member's new name and value, and an emptied container; all other bytes as they were."""
    docs = _made(spark, sf_dir, '{"k": 0, "xs": [1, ', K, '], "y": ', K, "}")
    return exact.edited(docs, "doc", [e.ReplaceMember(m.steps("k"), "key", _n("7")), e.Clear(m.steps("xs"))], keep=["event_id"])


@query(f"SELECT event_id, NULL::VARCHAR AS edited, 'write' AS code FROM {_E}")
def json_edit_overlap(spark, sf_dir):
    """Edits whose places meet are refused."""
    docs = _made(spark, sf_dir, '{"a":{"b":', K, "}}")
    made = exact.edited(docs, "doc", [e.Set(m.steps("a"), None), e.Set(m.steps("a", "b"), True)], keep=["event_id"], mode="permissive")
    return made.select("event_id", "edited", F.col("issue.code").alias("code"))


@query(f"""SELECT event_id, '{{"b":5,"c":' || k || '}}' AS edited FROM {_E}""")
def json_edit_fallback(spark, sf_dir):
    """A new name that another member has: no place in the text, so the value is edited and written compactly."""
    docs = _made(spark, sf_dir, '{"a": 1, "b": 2, "c": ', K, "}")
    return exact.edited(docs, "doc", [e.ReplaceMember(m.steps("a"), "b", _n("5"))], keep=["event_id"])


@query(f"""SELECT event_id, '{{"k":// new' || chr(10) || k || ' // old' || chr(10) || '}}' AS edited, 'lead,foot' AS roles FROM {_E}""")
def json_edit_comment(spark, sf_dir):
    """A comment before a value; the edited document carries both comments."""
    docs = _made(spark, sf_dir, '{"k":', K, " // old\n}")
    made = exact.edited_documents(docs, "doc", [e.Comment(m.steps("k"), "insert", "lead", "new")], dialect="jsonc", keep=["event_id"])
    return made.select("event_id", "edited", F.array_join(F.transform("document.facts", lambda f: f["role"]), ",").alias("roles"))


@query(f"""SELECT event_id, '{{"k":// new' || chr(10) || k || ',"z":' || chr(10) || '1}}' AS edited FROM {_E}""")
def json_edit_comment_replace(spark, sf_dir):
    """One comment's text replaced in its place, another one taken away."""
    docs = _made(spark, sf_dir, '{"k":// old\n', K, ',"z":// gone\n1}')
    return exact.edited(docs, "doc", [e.Comment(m.steps("k"), "replace", "lead", "new"), e.Comment(m.steps("z"), "clear", "lead")], dialect="jsonc", keep=["event_id"])


@query(f"""SELECT event_id, '{{"k":' || k || ',"new":[1]}}' AS edited, 0 AS first_byte, (14 + strlen(k::VARCHAR) + 2)::BIGINT AS last_byte, true AS validated FROM {_E}""")
def json_edit_document(spark, sf_dir):
    """The edited text and its root as a strictly read document."""
    made = exact.edited_documents(_made(spark, sf_dir, '{"k":', K, "}"), "doc", [e.Insert(m.steps("new"), [_n("1")])], keep=["event_id"])
    return made.select("event_id", "edited", F.col("document.document.start").cast("int").alias("first_byte"), F.col("document.document.end").alias("last_byte"), F.col("document.validated").alias("validated"))


@query(f"SELECT event_id, 'lead:// 1|foot:/* 2 */|lead:/* 2 */|foot:// 3' AS facts FROM {_E}")
def json_fact_order(spark, sf_dir):
    """Comments in the order in which they stand, with the values that they belong to."""
    docs = _made(spark, sf_dir, "// 1\n[", K, " /* 2 */, 0] // 3\n")
    a = exact.answers(docs, "doc", m.Request((m.Whole(),), strictness="strict", dialect="jsonc", facts=True))
    facts = F.transform(F.col("answers")[0]["facts"], lambda f: F.concat(f["role"], F.lit(":"), f["text"]))
    return a.select("event_id", F.array_join(facts, "|").alias("facts"))
