"""Queries over the test tables for each kind of demand, and the same in DuckDB's SQL.

events.props holds JSON texts; nested ones are made of orders and lineitem, one text an order.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestream.functions import columns as c
from lodestream.functions import edit as e
from lodestream.functions.encode import Options
from lodestream.functions.values import Number
from lodestream.operators import exact
from lodestream.plans import gate
from lodestream.plans import model as m

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
ITEMS = m.steps("items")


def query(sql: str) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return add


def _n(text: str) -> Number:
    return Number(text)


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, doc): {"id", "status", "items": [{"n", "q", "p", "f", "d" if above 0.05}]}, items by line number."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    item = F.struct(F.col("l_linenumber").alias("n"), F.col("l_quantity").cast("int").alias("q"), F.col("l_extendedprice").alias("p"), F.col("l_returnflag").alias("f"), F.when(F.col("l_discount") > 0.05, F.col("l_discount")).alias("d"))
    grouped = lines.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(item)).alias("items"))
    own = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_orderstatus")
    joined = own.join(grouped, own.o_orderkey == grouped.l_orderkey)
    return joined.select(F.col("o_orderkey").alias("id"), F.to_json(F.struct(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), "items")).alias("doc"))


_LINES = "SELECT l_orderkey AS id, l_linenumber::BIGINT AS n, l_quantity::BIGINT AS q, l_extendedprice AS p, l_returnflag AS f, CASE WHEN l_discount > 0.05 THEN l_discount END AS d, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_quantity, l_extendedprice) - 1 AS pos, count(*) OVER (PARTITION BY l_orderkey) AS len FROM lineitem JOIN orders ON o_orderkey = l_orderkey"


def _typed(rows: DataFrame) -> DataFrame:
    kinds = {"n": "long", "q": "long", "p": "double", "d": "double"}
    return rows.select(*[F.col(x).cast(kinds[x]).alias(x) if x in kinds else c.as_str(F.col(x)).alias(x) if x == "f" else F.col(x) for x in rows.columns])


@query("SELECT event_id, (props->>'$.k')::BIGINT AS k FROM events")
def json_path(spark, sf_dir):
    return exact.value(events(spark, sf_dir), "props", m.Path(m.steps("k")), keep=["event_id"]).select("event_id", c.as_i64(F.col("value")).alias("k"))


@query("SELECT event_id, (props->>'$.k')::BIGINT AS k FROM events")
def json_path_native(spark, sf_dir):
    return gate.value(events(spark, sf_dir), "props", m.Path(m.steps("k")), trusted=True, keep=["event_id"]).select("event_id", c.as_i64(F.col("value")).alias("k"))


@query("SELECT event_type, count(*) AS n FROM events WHERE (props->>'$.k')::BIGINT >= 50 GROUP BY event_type")
def json_filter_count(spark, sf_dir):
    kept = exact.rows(events(spark, sf_dir), "props", m.Filter((), m.Compare("ge", "k", _n("50"))), keep=["event_type"])
    return kept.groupBy("event_type").agg(F.count("*").alias("n"))


@query(f"SELECT id, pos, q, f FROM ({_LINES})")
def json_project(spark, sf_dir):
    return _typed(exact.rows(orders(spark, sf_dir), "doc", m.Project(ITEMS, ("q", "f")), ordinal="pos"))


@query(f"SELECT id, pos, q, f FROM ({_LINES})")
def json_project_native(spark, sf_dir):
    return _typed(gate.rows(orders(spark, sf_dir), "doc", m.Project(ITEMS, ("q", "f")), trusted=True, ordinal="pos"))


_CHEAP = m.And(m.Compare("gt", "q", _n("30")), m.Compare("eq", "f", "N"))


@query(f"SELECT id, n, p FROM ({_LINES}) WHERE q > 30 AND f = 'N'")
def json_filter(spark, sf_dir):
    return _typed(exact.rows(orders(spark, sf_dir), "doc", m.Filter(ITEMS, _CHEAP, ("n", "p"))))


@query(f"SELECT id, n, p FROM ({_LINES}) WHERE q > 30 AND f = 'N'")
def json_filter_native(spark, sf_dir):
    return _typed(gate.rows(orders(spark, sf_dir), "doc", m.Filter(ITEMS, _CHEAP, ("n", "p")), trusted=True))


@query(f"SELECT id, n FROM ({_LINES}) WHERE d IS NULL OR d <> 0.06")
def json_filter_ne(spark, sf_dir):
    """An absent member satisfies ne."""
    return _typed(exact.rows(orders(spark, sf_dir), "doc", m.Filter(ITEMS, m.Compare("ne", "d", _n("0.06")), ("n",))))


@query(f"SELECT id, n FROM ({_LINES}) WHERE q <= 5 OR NOT coalesce(d >= 0.08, false)")
def json_filter_or_not(spark, sf_dir):
    p = m.Or(m.Compare("le", "q", _n("5")), m.Not(m.Compare("ge", "d", _n("0.08"))))
    return _typed(exact.rows(orders(spark, sf_dir), "doc", m.Filter(ITEMS, p, ("n",))))


@query(f"SELECT id, n, q FROM ({_LINES}) WHERE q < 10")
def json_filter_whole_row(spark, sf_dir):
    """Whole rows of a filter, read again by a second demand."""
    rows = exact.rows(orders(spark, sf_dir), "doc", m.Filter(ITEMS, m.Compare("lt", "q", _n("10"))))
    return _typed(exact.rows(rows, "value", m.Project((), ("n", "q")), keep=["id"]))


@query(f"SELECT id, n FROM ({_LINES}) WHERE pos < 2")
def json_slice_head(spark, sf_dir):
    return _typed(exact.rows(orders(spark, sf_dir), "doc", m.Path(ITEMS, m.Slice(m.Range(0, 2), m.Project((), ("n",))))))


@query(f"SELECT id, n FROM ({_LINES}) WHERE pos >= len - 2")
def json_slice_tail(spark, sf_dir):
    return _typed(exact.rows(orders(spark, sf_dir), "doc", m.Path(ITEMS, m.Slice(m.Range(-2, None), m.Project((), ("n",))))))


@query(f"SELECT id, n FROM ({_LINES}) WHERE pos >= greatest(len - 3, 0) AND pos < len - 1")
def json_slice_native(spark, sf_dir):
    return _typed(gate.rows(orders(spark, sf_dir), "doc", m.Path(ITEMS, m.Slice(m.Range(-3, -1), m.Project((), ("n",)))), trusted=True))


@query(f"SELECT id, n FROM ({_LINES}) WHERE pos >= 1 AND pos < 4 AND q > 25")
def json_slice_filter(spark, sf_dir):
    """The window comes first, then the filter."""
    inner = m.Filter((), m.Compare("gt", "q", _n("25")), ("n",))
    return _typed(exact.rows(orders(spark, sf_dir), "doc", m.Path(ITEMS, m.Slice(m.Range(1, 4), inner))))


@query(f"SELECT id, n, q FROM ({_LINES}) WHERE pos = len - 1")
def json_index_last(spark, sf_dir):
    return _typed(exact.rows(orders(spark, sf_dir), "doc", m.Project(m.steps("items", -1), ("n", "q"))))


@query(f"SELECT id, (SELECT max(q) FROM ({_LINES}) y WHERE y.id = x.id AND pos = 2) AS q FROM (SELECT DISTINCT l_orderkey AS id FROM lineitem JOIN orders ON o_orderkey = l_orderkey) x")
def json_path_index(spark, sf_dir):
    """A path to a place that may be missing: null then."""
    return _typed(exact.value(orders(spark, sf_dir), "doc", m.Path(m.steps("items", 2, "q")), out="q"))


@query(f"SELECT id, pos, 'object' AS kind, n FROM ({_LINES})")
def json_collection(spark, sf_dir):
    rows = exact.rows(orders(spark, sf_dir), "doc", m.Path(ITEMS, m.Collection()), ordinal="pos")
    return rows.select("id", "pos", c.kind(F.col("value")).alias("kind"), F.get_json_object("value", "$.n").cast("long").alias("n"))


@query("SELECT r_regionkey AS r, n_nationkey::BIGINT AS k, n_name AS name FROM region JOIN nation ON n_regionkey = r_regionkey")
def json_nested_collection(spark, sf_dir):
    """Each element's path ends at an array, whose elements are mapped: regions in groups of groups of nations."""
    nations = spark.read.parquet(f"{sf_dir}/nation.parquet").groupBy("n_regionkey").agg(F.collect_list(F.struct(F.col("n_nationkey").alias("k"), F.col("n_name").alias("name"))).alias("all"))
    docs = spark.read.parquet(f"{sf_dir}/region.parquet").join(nations, F.col("r_regionkey") == F.col("n_regionkey"))
    docs = docs.select(F.col("r_regionkey").alias("r"), F.to_json(F.array(F.struct(F.struct("all").alias("in")))).alias("doc"))
    rows = exact.rows(docs, "doc", m.Collection(None, m.Project(m.steps("in", "all"), ("k", "name"))))
    return rows.select("r", F.col("k").cast("long").alias("k"), c.as_str(F.col("name")).alias("name"))


def _oracle(kind: str, sql: str, at: tuple = (), key: str | None = None, cast: str | None = "long") -> None:
    def run(spark, sf_dir):
        o = m.Oracle(kind, key)
        made = exact.value(orders(spark, sf_dir), "doc", m.Path(at, o) if at else o, out="a")
        return made.select("id", F.col("a").cast(cast).alias("a") if cast else F.col("a"))

    run.__name__ = f"json_oracle_{kind}"
    query(sql)(run)


_oracle("count", f"SELECT id, max(len)::BIGINT AS a FROM ({_LINES}) GROUP BY id", ITEMS)
_oracle("descend_count", f"SELECT id, (4 + sum(CASE WHEN d IS NULL THEN 5 ELSE 6 END))::BIGINT AS a FROM ({_LINES}) GROUP BY id")
_oracle("kind", f"SELECT id, 'array' AS a FROM ({_LINES}) GROUP BY id", ITEMS, cast=None)
_oracle("has_key", f"SELECT id, d IS NOT NULL AS a FROM ({_LINES}) WHERE pos = 0", m.steps("items", 0), "d", "boolean")
_oracle("member_names", f"""SELECT id, CASE WHEN d IS NULL THEN '["n","q","p","f"]' ELSE '["n","q","p","f","d"]' END AS a FROM ({_LINES}) WHERE pos = 0""", m.steps("items", 0), cast=None)
_oracle("member_count", f"SELECT id, (CASE WHEN d IS NULL THEN 4 ELSE 5 END)::BIGINT AS a FROM ({_LINES}) WHERE pos = len - 1", m.steps("items", -1))
_oracle("string_byte_length", "SELECT o_orderkey AS id, strlen(o_orderstatus)::BIGINT AS a FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)", m.steps("status"))


@query(f"SELECT id, max(len)::BIGINT AS n, max(CASE WHEN pos = 0 THEN q END) AS first_q, count(*) FILTER (q > 40) AS big FROM ({_LINES}) GROUP BY id")
def json_multi(spark, sf_dir):
    """Three demands from one reading of each text."""
    request = m.Request((m.Path(ITEMS, m.Oracle("count")), m.Path(m.steps("items", 0, "q")), m.Filter(ITEMS, m.Compare("gt", "q", _n("40")), ("n",))))
    a = exact.answers(orders(spark, sf_dir), "doc", request)
    return a.select("id", F.col("answers")[0]["oracle"].cast("long").alias("n"), F.col("answers")[1]["document"]["text"].cast("long").alias("first_q"), F.size(F.col("answers")[2]["rows"]).cast("long").alias("big"))


@query("SELECT sum(n)::BIGINT AS n FROM (SELECT count(*) AS n FROM lineitem JOIN orders ON o_orderkey = l_orderkey)")
def json_total(spark, sf_dir):
    return exact.total(orders(spark, sf_dir), "doc", m.Path(ITEMS, m.Oracle("count")))


@query("SELECT event_id, CASE event_id % 4 WHEN 0 THEN NULL WHEN 1 THEN 'trailing-comma' WHEN 2 THEN 'invalid-number' ELSE 'trailing-content' END AS code FROM events")
def json_validate(spark, sf_dir):
    k = F.get_json_object("props", "$.k")
    docs = events(spark, sf_dir).select("event_id", F.expr("event_id % 4").alias("w"), k.alias("k"))
    doc = F.when(F.col("w") == 0, F.concat(F.lit('{"k":'), "k", F.lit("}"))).when(F.col("w") == 1, F.concat(F.lit('{"k":'), "k", F.lit(",}"))).when(F.col("w") == 2, F.concat(F.lit('{"k":0'), "k", F.lit("}"))).otherwise(F.concat(F.lit('{"k":'), "k", F.lit("} x")))
    return exact.validate(docs.select("event_id", doc.alias("doc")), "doc", keep=["event_id"]).select("event_id", F.col("issue.code").alias("code"))


@query("SELECT event_id, replace(props, ' ', '') AS encoded FROM events")
def json_encode(spark, sf_dir):
    return exact.encoded(events(spark, sf_dir), "props", keep=["event_id"])


@query("""SELECT event_id, '{' || chr(10) || '  "k": ' || (props->>'$.k') || chr(10) || '}' AS encoded FROM events""")
def json_encode_pretty(spark, sf_dir):
    return exact.encoded(events(spark, sf_dir), "props", options=Options(indent=2), keep=["event_id"])


@query("""SELECT event_id, '{"k": -1.50,"t":[true,null]}' AS edited FROM events""")
def json_edit(spark, sf_dir):
    edits = [e.Set(m.steps("k"), _n("-1.50")), e.Insert(m.steps("t"), [True, None])]
    return exact.edited(events(spark, sf_dir), "props", edits, keep=["event_id"])


@query("""SELECT event_id, '{}' AS edited FROM events""")
def json_edit_delete(spark, sf_dir):
    return exact.edited(events(spark, sf_dir), "props", [e.Delete(m.steps("k")), e.Delete(m.steps("absent"))], keep=["event_id"])


def _streams(spark: SparkSession, sf_dir: str, before: str, after: str) -> DataFrame:
    """(day, hour, doc): the props of each hour's events as one stream, by event."""
    e = events(spark, sf_dir).select(F.date_trunc("hour", "ts").alias("hour"), F.struct("event_id", "props").alias("x"))
    grouped = e.groupBy("hour").agg(F.array_sort(F.collect_list("x")).alias("xs"))
    return grouped.select("hour", F.array_join(F.transform("xs", lambda x: F.concat(F.lit(before), x["props"], F.lit(after))), "").alias("doc"))


_HOURS = "SELECT date_trunc('hour', ts) AS hour, event_id, (props->>'$.k')::BIGINT AS k, row_number() OVER (PARTITION BY date_trunc('hour', ts) ORDER BY event_id) - 1 AS pos, count(*) OVER (PARTITION BY date_trunc('hour', ts)) AS len FROM events"


@query(f"SELECT hour, pos, k FROM ({_HOURS})")
def json_ndjson(spark, sf_dir):
    rows = exact.rows(_streams(spark, sf_dir, "", "\n"), "doc", m.Project((), ("k",)), ordinal="pos", framing="ndjson")
    return rows.select("hour", "pos", F.col("k").cast("long").alias("k"))


@query(f"SELECT hour, pos, k FROM ({_HOURS}) WHERE pos >= len - 2")
def json_jsonseq_tail(spark, sf_dir):
    """The last two records of each stream; pos from the records' count."""
    docs = _streams(spark, sf_dir, "\x1e", "\n")
    request = m.Request((m.Slice(m.Range(-2, None), m.Project((), ("k",))), m.Oracle("count")), framing="jsonseq")
    a = exact.answers(docs, "doc", request)
    n, rows = F.col("answers")[1]["oracle"].cast("long"), F.col("answers")[0]["rows"]
    return a.select("hour", n.alias("n"), F.size(rows).alias("m"), F.posexplode(rows).alias("i", "r")).select("hour", (F.col("n") - F.col("m") + F.col("i")).alias("pos"), F.col("r")[0]["text"].cast("long").alias("k"))


@query("SELECT date_trunc('hour', ts) AS hour, count(*) AS n FROM events GROUP BY ALL")
def json_adjacent_count(spark, sf_dir):
    return exact.value(_streams(spark, sf_dir, " ", ""), "doc", m.Oracle("count"), out="n", framing="adjacent").select("hour", F.col("n").cast("long").alias("n"))


@query(f"SELECT hour, pos AS ordinal, k FROM ({_HOURS})")
def json_records(spark, sf_dir):
    """One row a record, each answering as a text of its own."""
    r = exact.records(_streams(spark, sf_dir, "", "\r\n"), "doc", m.Request((m.Path(m.steps("k")),), framing="ndjson"))
    return r.select("hour", "ordinal", F.col("answers")[0]["document"]["text"].cast("long").alias("k"))


@query("""SELECT date_trunc('hour', ts) AS hour, count(*) AS n, 'Syntax' AS cls FROM events GROUP BY ALL""")
def json_tail_recovery(spark, sf_dir):
    """A cut last record becomes an issue; the records before it answer."""
    docs = _streams(spark, sf_dir, "", "\n").select("hour", F.concat("doc", F.lit('{"k":')).alias("doc"))
    a = exact.answers(docs, "doc", m.Request((m.Oracle("count"),), framing="ndjson"))
    return a.select("hour", F.col("answers")[0]["oracle"].cast("long").alias("n"), F.col("issues")[0]["cls"].alias("cls"))


@query(f"""SELECT id, '[' || string_agg('{{"n":' || n || ',"q":' || q || '}}', ',' ORDER BY n, q, p) || ']' AS value FROM ({_LINES}) GROUP BY id""")
def json_materialize(spark, sf_dir):
    return exact.materialized(orders(spark, sf_dir), "doc", m.Project(ITEMS, ("n", "q")))


@query("SELECT event_id, 31 + (props->>'$.k')::BIGINT AS k FROM events")
def json5_hex(spark, sf_dir):
    docs = events(spark, sf_dir).select("event_id", F.concat(F.lit("{k: 0x1F, 'more': "), F.get_json_object("props", "$.k"), F.lit(", /* end */}")).alias("doc"))
    v = exact.materialized(docs, "doc", m.Whole(), dialect="json5")
    return v.select("event_id", (F.get_json_object("value", "$.k").cast("long") + F.get_json_object("value", "$.more").cast("long")).alias("k"))


@query("SELECT event_id, 'lead' AS role, '// k is ' || (props->>'$.k') AS comment FROM events")
def jsonc_facts(spark, sf_dir):
    docs = events(spark, sf_dir).select("event_id", F.concat(F.lit("// k is "), F.get_json_object("props", "$.k"), F.lit("\n"), "props").alias("doc"))
    a = exact.answers(docs, "doc", m.Request((m.Whole(),), strictness="strict", dialect="jsonc", facts=True))
    return a.select("event_id", F.explode(F.col("answers")[0]["facts"]).alias("f")).select("event_id", "f.role", F.col("f.text").alias("comment"))


@query(f"SELECT f, count(*) AS n, sum(q)::BIGINT AS q, max(p) AS p FROM ({_LINES}) GROUP BY f")
def json_group(spark, sf_dir):
    """Spark's own operators over a demand's rows."""
    rows = _typed(gate.rows(orders(spark, sf_dir), "doc", m.Project(ITEMS, ("f", "q", "p")), trusted=True))
    return rows.groupBy("f").agg(F.count("*").alias("n"), F.sum("q").alias("q"), F.max("p").alias("p"))


@query(f"SELECT c_mktsegment, count(*) AS n FROM ({_LINES}) JOIN orders ON o_orderkey = id JOIN customer ON c_custkey = o_custkey WHERE q > 45 GROUP BY ALL")
def json_join(spark, sf_dir):
    """A demand's rows joined with tables."""
    rows = gate.rows(orders(spark, sf_dir), "doc", m.Filter(ITEMS, m.Compare("gt", "q", _n("45")), ("q",)), trusted=True)
    o, cust = spark.read.parquet(f"{sf_dir}/orders.parquet"), spark.read.parquet(f"{sf_dir}/customer.parquet")
    joined = rows.join(o.select("o_orderkey", "o_custkey"), rows.id == F.col("o_orderkey")).join(cust.select("c_custkey", "c_mktsegment"), F.col("c_custkey") == F.col("o_custkey"))
    return joined.groupBy("c_mktsegment").agg(F.count("*").alias("n"))


@query("SELECT event_id, CASE event_id % 4 WHEN 0 THEN k END AS i64, CASE event_id % 4 WHEN 0 THEN k::DOUBLE WHEN 1 THEN k + 0.5 END AS f64, CASE event_id % 4 WHEN 2 THEN true END AS bool, CASE event_id % 4 WHEN 3 THEN 'é' || k END AS str FROM (SELECT event_id, (props->>'$.k')::BIGINT AS k FROM events)")
def json_accessors(spark, sf_dir):
    """Typed reads of one member whose kind differs from text to text; none converts."""
    k, w = F.get_json_object("props", "$.k"), F.expr("event_id % 4")
    v = F.when(w == 0, k).when(w == 1, F.concat(k, F.lit(".50"))).when(w == 2, F.lit("true")).otherwise(F.concat(F.lit('"\\u00e9'), k, F.lit('"')))
    docs = events(spark, sf_dir).select("event_id", F.concat(F.lit('{"v":'), v, F.lit("}")).alias("doc"))
    cell = F.col("value")
    return exact.value(docs, "doc", m.Path(m.steps("v"))).select("event_id", c.as_i64(cell).alias("i64"), c.as_f64(cell).alias("f64"), c.as_bool(cell).alias("bool"), c.as_str(cell).alias("str"))


@query("SELECT event_id FROM events WHERE (props->>'$.k')::BIGINT > 50")
def json_number_order(spark, sf_dir):
    """Numbers compare by value, whatever their spelling: 51.0e0 is above 5e1, 50.000 is not."""
    k = F.get_json_object("props", "$.k")
    v = F.when(F.expr("event_id % 2 = 0"), F.concat(k, F.lit(".000"))).otherwise(F.concat(k, F.lit(".0e0")))
    docs = events(spark, sf_dir).select("event_id", F.concat(F.lit('{"v":'), v, F.lit("}")).alias("doc"))
    return exact.rows(docs, "doc", m.Filter((), m.Compare("gt", "v", _n("5e1")))).select("event_id")


@query("""SELECT event_id, '{"a":"\\u00e9","b":' || (props->>'$.k') || '}' AS encoded FROM events""")
def json_encode_sorted(spark, sf_dir):
    docs = events(spark, sf_dir).select("event_id", F.concat(F.lit('{"b": '), F.get_json_object("props", "$.k"), F.lit(', "a": "é"}')).alias("doc"))
    return exact.encoded(docs, "doc", options=Options(sort_keys=True, ascii=True), keep=["event_id"])


@query("SELECT event_id % 2 AS half, count(*) AS n, sum(CASE WHEN event_id % 2 = 1 THEN 1 ELSE 0 END)::BIGINT AS refused FROM events GROUP BY ALL")
def json_strictness(spark, sf_dir):
    """A bad number that isn't asked for stops a strict reading only."""
    bad = F.when(F.expr("event_id % 2 = 1"), F.lit("01")).otherwise(F.lit("1"))
    docs = events(spark, sf_dir).select(F.expr("event_id % 2").alias("half"), F.concat(F.lit('{"k":1,"pad":'), bad, F.lit("}")).alias("doc"))
    strict = exact.answers(docs, "doc", m.Request((m.Path(m.steps("k")),), strictness="strict"), mode="permissive", keep=["half", "doc"])
    both = exact.answers(strict.select("half", "doc", F.size("issues").alias("refused")), "doc", m.Request((m.Path(m.steps("k")),)), keep=["half", "refused"])
    return both.groupBy("half").agg(F.sum(F.col("answers")[0]["document"]["text"].cast("long")).alias("n"), F.sum("refused").alias("refused"))


@query("SELECT event_id, k, k + 1 AS next FROM (SELECT event_id, (props->>'$.k')::BIGINT AS k FROM events)")
def json_scalar_collection(spark, sf_dir):
    """Elements that are no objects have absent cells, so each event has one row with k and one without."""
    docs = events(spark, sf_dir).select("event_id", F.concat(F.lit('[{"k":'), F.get_json_object("props", "$.k"), F.lit("},7]")).alias("doc"))
    rows = exact.rows(docs, "doc", m.Collection(("k",)), ordinal="pos")
    one = rows.groupBy("event_id").agg(F.max(F.col("k").cast("long")).alias("k"), F.max("pos").alias("last"))
    return one.select("event_id", "k", (F.col("k") + F.col("last")).alias("next"))


# The finer operators' queries register themselves.
from lodestream import entries_detail  # noqa: E402, F401


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
