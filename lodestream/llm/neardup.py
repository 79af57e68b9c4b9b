"""Near duplicates by fast similarity sketches, banding and exact verification.

A text's set holds its distinct 4-word shingles. Texts with equal sets form a class. A class's sketch has T coordinates;
in round i every shingle is placed in a hashed bin, from round T on in bin i - T, and rounds go on until each bin is
filled, so no coordinate is ever empty and equal coordinates estimate the Jaccard similarity with the concentration of
independent samples. Bands of sketch coordinates give buckets. In each bucket all classes are compared with one pivot.
Buckets whose members still lie in several components are open: for their members, the shingles that no other open member
has are counted, which bounds the similarity of any two. The member with the least share of own shingles is the next
pivot, the hub. What is then still open is compared pair by pair, where two members' differences from the hub share one
among their rarest, as those of linked sets must, and the bound doesn't rule a link out. Links make components by hooking and pointer jumping. Nothing is collected: every step is a join or an
aggregation.
"""

from __future__ import annotations

import hashlib
import math
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestream.llm.common import map_texts, passing, ship, stored

SHINGLE_WORDS, LINK_PERCENT = 4, 80
#: A link at 80 % shares no band with probability (1 - 0.8**5)**40, about 1 in 8 million.
BANDS, BAND_ROWS = 40, 5
COORDINATES = BANDS * BAND_ROWS
#: Rows of one hub go to so many tasks when they are joined with what is known of it.
SALTS = 16
#: Sets that a verifying task keeps for the next pairs.
KEPT_SETS = 64

_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_ODD = np.uint64(0x9E3779B97F4A7C15)
_S33 = np.uint64(33)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit over all (the finaliser of MurmurHash3)."""
    x = x ^ (x >> _S33)
    x = x * _M1
    x = x ^ (x >> _S33)
    x = x * _M2
    return x ^ (x >> _S33)


_SEEDS = mixed(np.arange(1, 2 * COORDINATES + 1, dtype=np.uint64) * _ODD)


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles; A-Z count as a-z."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, dtype=np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))
    k = min(SHINGLE_WORDS, len(words))
    acc = np.full(len(words) - k + 1, k, dtype=np.uint64)
    for i in range(k):
        acc = mixed(acc * _ODD + h[i : len(words) - k + 1 + i])
    return np.unique(acc)


def sketch(items: np.ndarray) -> np.ndarray:
    """The coordinates of a set that isn't empty: round and hash of the least item in each bin's first filled round."""
    t, n = COORDINATES, len(items)
    out = np.full(t, np.iinfo(np.uint64).max, dtype=np.uint64)
    done = 0
    while done < t:
        rounds = min(t - done, max(1, math.ceil(t * (math.log(t) + 2) / n)) if done == 0 else max(1, 256 // n))
        x = mixed(items[None, :] ^ _SEEDS[done : done + rounds, None])
        bins = ((x >> np.uint64(32)) * np.uint64(t) >> np.uint64(32)).astype(np.int64).ravel()
        values = ((np.arange(done, done + rounds, dtype=np.uint64) << np.uint64(54))[:, None] | (x * _ODD >> np.uint64(10))).ravel()
        if done:
            still = out[bins] >= np.uint64(done) << np.uint64(54)
            bins, values = bins[still], values[still]
        order = np.argsort(values)[::-1]
        out[bins[order]] = values[order]
        done += rounds
        if out.max() != np.iinfo(np.uint64).max:
            return out
    for b in np.flatnonzero(out == np.iinfo(np.uint64).max):
        x = mixed(items ^ _SEEDS[t + b])
        out[b] = np.uint64(t + b) << np.uint64(54) | (x * _ODD >> np.uint64(10)).min()
    return out


_BAND_SEEDS = mixed(np.arange(1, BANDS + 1, dtype=np.uint64) * _M2)


def band_keys(coordinates: np.ndarray) -> np.ndarray:
    acc = _BAND_SEEDS.copy()
    for i in range(BAND_ROWS):
        acc = mixed(acc * _ODD + coordinates.reshape(BANDS, BAND_ROWS)[:, i])
    return acc.view(np.int64)


def digest(items: np.ndarray) -> bytes:
    return hashlib.blake2b(items.tobytes(), digest_size=16).digest()


def sketched(df: DataFrame, doc_id: str, text: str, carried: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, carried, n_shingles, node, bands): node is the digest of the set, null for an empty one."""

    def make():
        def work(texts: list[str | None]) -> list[list]:
            counts, nodes, bands = [], [], []
            for t in texts:
                s = shingles(t)
                counts.append(len(s))
                nodes.append(digest(s) if len(s) else None)
                bands.append(band_keys(sketch(s)) if len(s) else None)
            return [counts, nodes, bands]

        return work

    return map_texts(df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), *carried), "text", [("n_shingles", T.LongType()), ("node", T.BinaryType()), ("bands", T.ArrayType(T.LongType()))], make, keep=["doc_id", *carried])


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sets: OrderedDict[bytes, np.ndarray] = OrderedDict()

    def of(node: bytes, text: str) -> np.ndarray:
        known = sets.get(node)
        if known is None:
            known = sets[node] = shingles(text)
            if len(sets) > KEPT_SETS:
                sets.popitem(last=False)
        else:
            sets.move_to_end(node)
        return known

    for batch in batches:
        a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        shared, union = [], []
        for x, y, tx, ty in zip(a, b, batch.column(2), batch.column(3), strict=True):
            sx, sy = of(x, tx.as_py()), of(y, ty.as_py())
            both = len(np.intersect1d(sx, sy, assume_unique=True)) if min(len(sx), len(sy)) * 100 >= 40 * max(len(sx), len(sy)) else 0
            shared.append(both)
            union.append(len(sx) + len(sy) - both)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(shared, pa.int64()), pa.array(union, pa.int64())], names=["a", "b", "shared", "joint"])


def texts_of(nodes: DataFrame, classes: DataFrame, docs: DataFrame) -> DataFrame:
    """(node, text) for nodes: the text of each class's least document."""
    wanted = nodes.join(classes.select("node", "least_doc"), "node")
    # A doc_id with several texts brings them all; the digest picks the right one.
    return _right_texts(docs.join(wanted, F.col("doc_id").eqNullSafe(F.col("least_doc"))).select("node", "text"))


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """pairs (a, b) of nodes with shared and joint, the exact sizes of intersection and union of their whole sets.

    Sizes that differ by more than 2.5 times count as sharing nothing: the similarity is then at most 0.4.
    """
    one = texts.select(F.col("node").alias("a"), F.col("text").alias("ta"))
    two = texts.select(F.col("node").alias("b"), F.col("text").alias("tb"))
    joined = pairs.select("a", "b").join(two, "b").join(one, "a").select("a", "b", "ta", "tb")
    return joined.mapInArrow(_verify, "a binary, b binary, shared long, joint long")


def _right_texts(found: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = [digest(shingles(t.as_py())) == n.as_py() for n, t in zip(batch.column(0), batch.column(1), strict=True)]
            yield batch.filter(pa.array(good, pa.bool_()))

    # Several rows of one document may remain; any will do.
    return found.mapInArrow(run, found.schema).groupBy("node").agg(F.first("text").alias("text"))


def components(links: DataFrame) -> DataFrame:
    """(node, comp) for the nodes of links (a, b): comp is the least node that is reachable.

    Each round, every component hooks onto the least component next to it, and labels jump to their label's label.
    """
    edges = stored(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "neardup-edges")
    labels = stored(edges.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("comp")), "neardup-labels")
    while True:
        near = edges.join(labels.select(F.col("node").alias("b"), F.col("comp").alias("next")), "b").groupBy(F.col("a").alias("node")).agg(F.min("next").alias("next"))
        # The least label next to any node of a component is where the component goes.
        hooks = labels.join(near, "node").groupBy("comp").agg(F.least(F.min("next"), F.first("comp")).alias("to"))
        hooks = stored(hooks, "neardup-hooks")
        if hooks.filter(F.col("to") != F.col("comp")).isEmpty():
            return labels
        far = hooks.select(F.col("comp").alias("to"), F.col("to").alias("far"))
        jumps = hooks.join(far, "to", "left").select("comp", F.coalesce("far", "to").alias("to"))
        labels = stored(labels.join(jumps, "comp").select("node", F.col("to").alias("comp")), "neardup-labels")


def near_duplicates(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of df: doc_id, n_shingles, component_id and kept.

    Two texts are linked if 100 * shared shingles >= 80 * joint shingles. component_id is the least doc_id that is
    reachable over links, the row's own included; kept says whether it is the row's own. Texts without words have no
    shingles, are linked with nothing and kept. Texts of fewer than four words have one shingle, the whole sequence.
    Rows with equal doc_id and text are one document and get equal rows. Null doc_ids count as no doc_id: such a row
    takes its component's least doc_id, or null, and is kept only if there is none. An empty table gives an empty table.
    """
    return _verdicts(df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")))


def _verdicts(docs: DataFrame, carried: tuple[str, ...] = ()) -> DataFrame:
    """near_duplicates() of docs (doc_id, text, carried), whose columns `carried` come in front of its own."""
    ship(docs.sparkSession)
    sketches = stored(sketched(docs, "doc_id", "text", carried), "neardup-sketches")
    with passing(docs.sparkSession) as keep:
        by_class = _components_of(sketches, docs)
        keep(by_class._lodestream_path)
    least = by_class.groupBy("comp").agg(F.min("least_doc").alias("component_id"))
    named = by_class.join(least, "comp").select("node", "component_id")
    out = sketches.select(*carried, "doc_id", "n_shingles", "node").join(named, "node", "left")
    component = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select(*carried, "doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def _components_of(sketches: DataFrame, docs: DataFrame) -> DataFrame:
    """(node, least_doc, comp) of all classes, as a stored table."""
    classes = sketches.filter(F.col("node").isNotNull()).groupBy("node").agg(F.min("doc_id").alias("least_doc"), F.first("bands").alias("bands"))
    classes = stored(classes, "neardup-classes")
    members = classes.select("node", F.explode("bands").alias("key"))
    buckets = members.groupBy("key").agg(F.min("node").alias("pivot"), F.count("*").alias("n")).filter("n > 1").select("key", "pivot")
    placed = stored(members.join(buckets, "key").select("key", "node", "pivot"), "neardup-buckets")
    texts = stored(texts_of(placed.select("node").distinct(), classes, docs), "neardup-texts")
    pairs = placed.filter("node != pivot").select(F.col("node").alias("a"), F.col("pivot").alias("b")).distinct()
    tested = stored(verified(pairs, texts), "neardup-tested")
    linked = f"100 * shared >= {LINK_PERCENT} * joint"
    labels = components(tested.filter(linked))
    rows = _open_rows(placed, tested, labels)
    if not rows.isEmpty():
        sets = stored(_sets(rows, texts), "neardup-open-sets")
        rows = stored(rows.join(_own_shingles(sets), "node"), "neardup-open")
        for pairs in (_hub_pairs, _remaining_pairs):
            more = stored(pairs(rows, sets, tested), "neardup-open-pairs")
            tested = tested.union(stored(verified(more, texts), "neardup-tested"))
            labels = components(tested.filter(linked))
            rows = rows.drop("comp").join(labels, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    by_class = classes.select("node", "least_doc").join(labels, "node", "left").select("node", "least_doc", F.coalesce("comp", "node").alias("comp"))
    return stored(by_class, "neardup-components")


def deduplicated(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """df without the rows that near_duplicates() doesn't keep, and with one row of each that repeats; all columns kept.

    Rows go by doc_id and text, so a null doc_id is no reason to drop a text that is linked with nothing.
    """
    with passing(df.sparkSession) as keep:
        found = _verdicts(df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.xxhash64(text).alias("__hash")), ("__hash",))
        # Narrow: one row a dropped document. A verdict is a document's own: its doc_id may be null, or repeat with other texts.
        dropped = stored(found.filter("not kept").select(F.col("doc_id").alias("__id"), "__hash").distinct(), "neardup-dropped")
        keep(dropped._lodestream_path)
    kept = df.join(dropped, F.col(doc_id).eqNullSafe(F.col("__id")) & (F.xxhash64(text) == F.col("__hash")), "left_anti")
    repeated = df.groupBy(F.col(doc_id).alias("__id")).agg(F.count("*").alias("n")).filter("n > 1").select("__id")
    if repeated.isEmpty():
        return kept
    again = F.col(doc_id).eqNullSafe(F.col("__id"))
    return kept.join(repeated, again, "left_anti").unionByName(kept.join(repeated, again, "left_semi").dropDuplicates([doc_id, text]))


def _open_rows(placed: DataFrame, tested: DataFrame, labels: DataFrame) -> DataFrame:
    """(key, node, comp) of the buckets whose pivot failed a member that is in another component."""
    comp = labels.select("node", "comp")
    failed = tested.filter(f"100 * shared < {LINK_PERCENT} * joint").select(F.col("a").alias("node"), F.col("b").alias("pivot"))
    ends = failed.join(comp, "node", "left").withColumnRenamed("comp", "c1").join(comp.select(F.col("node").alias("pivot"), F.col("comp").alias("c2")), "pivot", "left")
    apart = ends.filter(F.coalesce("c1", "node") != F.coalesce("c2", "pivot")).select("node", "pivot")
    open_keys = placed.join(apart, ["node", "pivot"], "left_semi").select("key").distinct()
    return placed.join(open_keys, "key", "left_semi").join(comp, "node", "left").select("key", "node", F.coalesce("comp", "node").alias("comp"))


def _sets(rows: DataFrame, texts: DataFrame) -> DataFrame:
    """(node, id, items) of the open nodes: their shingles, and a shorter name."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for node, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array([node], pa.binary()), pa.array([shingles(text.as_py()).view(np.int64)], pa.list_(pa.int64()))], names=["node", "items"])

    made = texts.join(rows.select("node").distinct(), "node", "left_semi").mapInArrow(run, "node binary, items array<long>")
    return made.select("node", F.xxhash64("node").alias("id"), "items")


def _own_shingles(sets: DataFrame) -> DataFrame:
    """(node, size, own): the size of each open node's set and how many of its shingles no other open node has."""
    single = sets.select("id", F.explode("items").alias("item")).groupBy("item").agg(F.count("*").alias("n"), F.min("id").alias("id")).filter("n = 1")
    own = single.groupBy("id").agg(F.count("*").alias("own"))
    return sets.select("node", F.size("items").alias("size"), "id").join(own, "id", "left").select("node", "size", F.coalesce("own", F.lit(0)).alias("own"))


#: Own shingles are in no intersection and in every union, so this holds for all links.
_BOUND = f"100 * least(sx - ox, sy - oy) >= {LINK_PERCENT} * greatest(sx + oy, sy + ox)"


def _untested(pairs: DataFrame, tested: DataFrame) -> DataFrame:
    pairs = pairs.select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct()
    known = tested.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    return pairs.join(known, ["a", "b"], "left_anti")


def _linkable(rows: DataFrame) -> DataFrame:
    return rows.filter(f"100 * (size - own) >= {LINK_PERCENT} * size")


def _spread_join(many: DataFrame, few: DataFrame, key: str) -> DataFrame:
    """many joined with the one row that few has of each key, dealt by key and node, so that no key's rows gather in a task."""
    salted = few.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return many.withColumn("__salt", F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int")).join(salted, [key, "__salt"]).drop("__salt")


def _hubs(rows: DataFrame) -> DataFrame:
    """(key, hub): each open bucket's member with the least share of own shingles."""
    share = F.struct((F.col("own") / F.col("size")).alias("share"), F.col("node").alias("hub"))
    return _linkable(rows).groupBy("key").agg(F.min(share).alias("h")).select("key", "h.hub")


def _hub_pairs(rows: DataFrame, sets: DataFrame, tested: DataFrame) -> DataFrame:
    """Each open bucket's hub with the members of other components."""
    hubs = _hubs(rows)
    ends = _linkable(rows).join(hubs, "key")
    hub = ends.filter("node = hub").select("key", F.col("node").alias("y"), F.col("comp").alias("cy"), F.col("size").alias("sy"), F.col("own").alias("oy"))
    met = ends.select("key", F.col("node").alias("x"), F.col("comp").alias("cx"), F.col("size").alias("sx"), F.col("own").alias("ox")).join(hub, "key")
    return _untested(met.filter((F.col("cx") != F.col("cy")) & F.expr(_BOUND)), tested)


def _differences(placed: DataFrame, sets: DataFrame) -> DataFrame:
    """(hub, node, d, items): the shingles that are in one of the node's and its hub's sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hubs, nodes = batch.column(0), batch.column(1)
            made = [np.setxor1d(np.asarray(x.values), np.asarray(h.values), assume_unique=True) for x, h in zip(batch.column(2), batch.column(3), strict=True)]
            yield pa.RecordBatch.from_arrays([hubs, nodes, pa.array([len(m) for m in made], pa.int64()), pa.array(made, pa.list_(pa.int64()))], names=["hub", "node", "d", "items"])

    hubs = sets.select(F.col("node").alias("hub"), F.col("items").alias("hub_items")).join(placed.select("hub").distinct(), "hub", "left_semi")
    joined = _spread_join(placed.select("hub", "node").join(sets.select("node", F.col("items").alias("own_items")), "node"), hubs, "hub")
    return joined.select("hub", "node", "own_items", "hub_items").mapInArrow(run, "hub binary, node binary, d long, items array<long>")


def _remaining_pairs(rows: DataFrame, sets: DataFrame, tested: DataFrame) -> DataFrame:
    """Pairs of nodes with a common hub, in different components, that may still be linked.

    With dx and dy the sizes of two nodes' differences from their hub, their own difference is dx + dy - 2 o, where o
    counts what the differences share, and a link allows at most (nx + ny) / 9 of it. Both ends of a pair that needs
    no o >= 1 are linked with the hub, and so lie in one component. For the others, in an order of a hub's differences
    from rare to common, either end has a shared one among its first d - o + 1. How many must be shared depends on
    both ends, so ends look each other up by classes of d. Only nodes outside their hub's largest component look.
    """
    placed = _linkable(rows).join(_hubs(rows), "key").select("hub", "node", "comp", "size", "own").distinct()
    sizes = placed.groupBy("hub", "comp").agg(F.count("*").alias("n"))
    main = sizes.groupBy("hub").agg(F.max(F.struct("n", "comp")).alias("m"), F.count("*").alias("comps")).filter("comps > 1").select("hub", F.col("m.comp").alias("main"))
    apart = stored(_spread_join(placed, main, "hub").withColumn("seeks", F.col("comp") != F.col("main")), "neardup-apart")
    found = stored(_differences(apart, sets), "neardup-differences")
    level = F.floor(F.log(1.25, F.col("d") + 1)).cast("int")
    ends = apart.join(found.select("hub", "node", "d", level.alias("level")), ["hub", "node"])
    levels = ends.groupBy("hub", "level").agg(F.min("d").alias("d"), F.max("size").alias("size")).groupBy("hub").agg(F.collect_list(F.struct("level", "d", "size")).alias("levels"))
    # Shared differences that a partner of a class needs at least, and from it how far the prefix goes; in eighteenths.
    need = F.transform("levels", lambda c: F.struct(c["level"].alias("partner"), (F.col("d") + 1 - F.greatest(F.lit(1), F.ceil((9 * (F.col("d") + c["d"]) - F.col("size") - c["size"]) / 18))).alias("prefix")))
    ends = stored(_spread_join(ends, levels, "hub").withColumn("needs", need).drop("levels"), "neardup-ends")
    items = found.select("hub", "node", "d", F.explode("items").alias("item"))
    ranks = items.groupBy("hub", "item").agg(F.count("*").alias("n")).filter("n > 1")
    one = Window.partitionBy("hub", "node")
    # Differences that one node has alone come first and are never shared.
    placed_items = items.join(ranks, ["hub", "item"]).withColumn("at", F.row_number().over(one.orderBy("n", "item")) + F.col("d") - F.count("*").over(one)).select("hub", "node", "item", "at")
    full = placed_items.join(ends, ["hub", "node"]).withColumn("p", F.explode(F.filter("needs", lambda c: c["prefix"] >= F.col("at"))))
    full = full.select("hub", "item", "node", "comp", "size", "own", "seeks", "level", "p.partner")
    left = full.filter("seeks").select("hub", "item", F.col("node").alias("x"), F.col("comp").alias("cx"), F.col("size").alias("sx"), F.col("own").alias("ox"), "level", "partner")
    right = full.select("hub", "item", F.col("node").alias("y"), F.col("comp").alias("cy"), F.col("size").alias("sy"), F.col("own").alias("oy"), F.col("partner").alias("level"), F.col("level").alias("partner"))
    met = left.join(right, ["hub", "item", "level", "partner"]).filter((F.col("cx") != F.col("cy")) & F.expr(_BOUND))
    return _untested(met, tested)


#: The same rows in DuckDB's SQL, by comparing all texts that share a shingle.
SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')] ELSE list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' ')) END) AS h FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.h = b.h AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 80 * (nx.n + ny.n - c)),
r AS (SELECT doc_id, doc_id AS z FROM documents UNION SELECT r.doc_id, e.y FROM r JOIN e ON e.x = r.z)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept
FROM (SELECT doc_id, min(z) AS component_id FROM r GROUP BY doc_id) LEFT JOIN n USING (doc_id)
"""
