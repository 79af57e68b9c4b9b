"""Benchmark decontamination by spaced-seed hashing, with built-in functions only.

A mask takes some words of a run and ignores the others, so a hash of the taken words is the same whatever stands at the
ignored places. For each size of window there is a family of fixed masks such that however the words that may differ lie
in it, one mask of the family misses them all. Hashes of all texts meet the items' hashes; around each hit, all windows of
the item that hold it are compared word by word. So every overlap is found, and only overlaps are.

Hashes of items go out in a broadcast while their measured size allows; beyond it both sides are shuffled by hash. Either
way the texts are read in one pass, and an item's part in a broadcast is in proportion to its words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestream.llm.common import let, stored

#: Words of an item that are compared at once, at most, and the share of them that must agree.
WINDOW, LEAST_PERCENT = 20, 80
#: Bytes of hashes and words of items that are broadcast, at most.
BROADCAST_BYTES = 64 << 20
SEED_BYTES, WORD_BYTES = 48, 8
#: For items of so many words or more, the places of a run that each mask takes. In a window of that size 0, 1,
#: 2 or 3 words may differ; a family that holds there holds for longer windows with as many, and the last one for 20 with 4.
MASKS = {
    1: ((0,),),
    2: ((0, 1),),
    3: ((0, 1, 2),),
    4: ((0, 1, 2, 3),),
    5: ((0, 1, 2), (0, 1, 4)),
    10: ((0, 2, 5, 7), (0, 4, 5, 8)),
    15: ((0, 1, 2, 3, 5), (0, 4, 8, 9, 10)),
}


def word_hashes(text: Column) -> Column:
    """64-bit hashes of the lower-cased runs of letters and digits."""
    parts = F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+")
    return F.transform(F.filter(parts, lambda w: w != ""), lambda w: F.xxhash64(w))


def class_of(n: Column) -> Column:
    """The class of items of n words: the greatest key of MASKS up to n."""
    return F.greatest(*[F.when(n >= k, F.lit(k)) for k in MASKS])


def seeds_at(words: Column, at: Column, masks: list[tuple[int, ...]]) -> Column:
    """The hash of each mask's words from place `at` on, null where the mask goes beyond the last word."""

    def one(mask: tuple[int, ...]) -> Column:
        taken = [F.get(words, at + o) for o in mask]
        return F.when(at + mask[-1] < F.size(words), F.xxhash64(F.lit(",".join(map(str, mask))), *taken))

    return F.array(*[one(x) for x in masks])


def item_words(items: DataFrame, item_id: str, text: str) -> DataFrame:
    """(item_no, item_id, item): the word hashes of items that have words; written once, so that numbers stay."""
    words = items.select(F.col(item_id).alias("item_id"), word_hashes(F.col(text)).alias("item")).filter(F.size("item") > 0)
    return stored(words.select(F.monotonically_increasing_id().alias("item_no"), "item_id", "item"), "decontam-items")


def item_seeds(words: DataFrame, classes: list[int]) -> DataFrame:
    """(seed, item_no, item_at, span): each mask of an item's class at each place where it fits."""
    n = F.size("item")
    parts = None
    for k in classes:
        masks = list(MASKS[k])
        spans = F.array(*[F.lit(x[-1] + 1) for x in masks])
        own = words.filter(class_of(n) == k).select("item_no", "item", F.posexplode("item").alias("item_at", "__w"))
        made = own.select("item_no", "item_at", F.explode(F.arrays_zip(seeds_at(F.col("item"), F.col("item_at"), masks).alias("seed"), spans.alias("span"))).alias("s"))
        made = made.select("s.seed", "item_no", "item_at", "s.span").filter("seed is not null")
        parts = made if parts is None else parts.unionByName(made)
    return parts


def overlaps(docs: DataFrame, items: DataFrame, keys: list[str], text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(keys, item_id, matched, compared, first_word): one row for each text and item that overlap.

    Any min(WINDOW, the item's length) successive words of the item are compared with the text's words at the same
    distance; matched of compared must agree by LEAST_PERCENT or more. matched is the best of the pair's overlaps, and
    first_word the least word position where one begins (it may be negative for an item cut at the start).
    Null and empty texts and items have no words and overlap nothing; empty tables give an empty table. Rows that repeat
    a key are one text's rows and give one row an item.
    """
    known = item_words(items, item_id, item_text)
    # As many rows as MASKS has classes, at most.
    sizes = known.groupBy(class_of(F.size("item")).alias("k")).agg(F.sum(F.size("item")).alias("words")).collect()
    classes = sorted(r.k for r in sizes)
    masks = list(dict.fromkeys(x for k in classes for x in MASKS[k])) or [(0,)]
    seeds = item_seeds(known, classes or [1])
    size = sum(r.words * (SEED_BYTES * len(MASKS[r.k]) + WORD_BYTES) for r in sizes)
    # Keys may have any names, those of the columns below among them.
    names, keys = keys, [f"__key_{i}" for i in range(len(keys))]
    words = docs.select(*[F.col(f"`{n}`").alias(k) for n, k in zip(names, keys, strict=True)], word_hashes(F.col(f"`{text}`")).alias("words")).filter(F.size("words") > 0)
    spread = words.select(*keys, "words", F.posexplode("words").alias("at", "__w"))
    spread = spread.select(*keys, "words", "at", F.explode(seeds_at(F.col("words"), F.col("at"), masks)).alias("seed")).filter("seed is not null")
    named = known.select("item_no", "item_id", "item")
    if size <= BROADCAST_BYTES:
        met = spread.join(F.broadcast(seeds), "seed").join(F.broadcast(named), "item_no")
    else:
        # Hashes travel without their texts' words, which only texts with hits bring along afterwards.
        hits = spread.select(*keys, "at", "seed").join(seeds, "seed").drop("seed")
        same = [F.col(k).eqNullSafe(F.col(f"__hit_{i}")) for i, k in enumerate(keys)]
        hits = hits.select(*[F.col(k).alias(f"__hit_{i}") for i, k in enumerate(keys)], "at", "item_no", "item_at", "span")
        met = words.join(hits, same).select(*keys, "words", "at", "item_no", "item_at", "span").join(named, "item_no")
    found = _agreeing(met, keys).groupBy(*keys, "item_id").agg(F.max("matched").alias("matched"), F.max("compared").alias("compared"), F.min("first_word").alias("first_word"))
    return found.select(*[F.col(k).alias(n) for n, k in zip(names, keys, strict=True)], "item_id", "matched", "compared", "first_word")


def _agreeing(met: DataFrame, keys: list[str]) -> DataFrame:
    """The best of the item's windows around each hit, where one agrees well enough."""
    n = F.size("item")
    made = met.select(*keys, "item_id", "words", "item", "at", "item_at", "span", F.least(n, F.lit(WINDOW)).alias("size"))
    # Windows of `size` words that hold the hit and lie within the item begin at item places lo..hi.
    lo, hi = F.greatest(F.lit(0), F.col("item_at") + F.col("span") - F.col("size")), F.least(F.col("item_at"), n - F.col("size"))
    made = made.select(*keys, "item_id", "words", "item", "size", (F.col("at") - F.col("item_at")).alias("shift"), lo.alias("lo"), hi.alias("hi"))
    agree = F.transform(F.sequence(F.col("lo"), F.col("hi") + F.col("size") - 1), lambda j: F.when(F.get("words", j + F.col("shift")).eqNullSafe(F.get("item", j)), F.lit(1)).otherwise(F.lit(0)))
    counts = let(agree, lambda a: F.transform(F.sequence(F.lit(0), F.col("hi") - F.col("lo")), lambda s: F.aggregate(F.slice(a, s + 1, F.col("size")), F.lit(0), lambda x, y: x + y)))
    first = lambda c: F.array_min(F.transform(c, lambda m, s: F.when(100 * m >= LEAST_PERCENT * F.col("size"), s)))
    best = let(counts, lambda c: F.struct(F.array_max(c).cast("long").alias("matched"), (first(c) + F.col("lo") + F.col("shift")).cast("long").alias("first_word")))
    found = made.select(*keys, "item_id", best.alias("best"), F.col("size").cast("long").alias("compared"))
    return found.filter("best.first_word is not null").select(*keys, "item_id", "best.matched", "compared", "best.first_word")


def decontaminated(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """docs without the rows whose texts overlap an item; all columns kept. Rows are told apart by id and text."""
    own = docs.select(F.col(doc_id).alias("__id"), F.xxhash64(text).alias("__hash"), F.col(text).alias("__text"))
    found = overlaps(own, items, ["__id", "__hash"], "__text", item_id, item_text).select("__id", "__hash").distinct()
    return docs.join(found, F.col(doc_id).eqNullSafe(F.col("__id")) & (F.xxhash64(text) == F.col("__hash")), "left_anti")


#: The same rows in DuckDB's SQL, by runs of words that an overlap can't lack: with d differing words in a window of c, some
#: run of ceil((c - d) / (d + 1)) words agrees. Every alignment that has such a run is compared in all windows.
SQL = r"""
WITH dw AS (SELECT doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS ws FROM documents),
iw AS (SELECT item_id, ws, len(ws) AS n, least(len(ws), 20) AS c, least(len(ws), 20) // 5 AS d
  FROM (SELECT item_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS ws FROM benchmark) WHERE len(ws) > 0),
ir AS (SELECT *, (c - d + d) // (d + 1) AS r FROM iw),
isd AS (SELECT item_id, ws, n, c, r, i, array_to_string(ws[i + 1:i + r], ' ') AS k FROM (SELECT *, unnest(range(n - r + 1)) AS i FROM ir)),
ds AS (SELECT doc_id, ws, r, i, array_to_string(ws[i + 1:i + r], ' ') AS k FROM (SELECT doc_id, ws, unnest(range(len(ws))) AS i FROM dw), (SELECT DISTINCT r FROM ir) WHERE i + r <= len(ws)),
h AS (SELECT DISTINCT doc_id, item_id, x.ws AS dws, s.ws AS iws, n, c, x.i - s.i AS shift FROM ds x JOIN isd s ON x.r = s.r AND x.k = s.k),
g AS (SELECT *, list_transform(range(n), lambda j: CASE WHEN j + shift >= 0 AND dws[j + shift + 1] = iws[j + 1] THEN 1 ELSE 0 END) AS ok FROM h),
v AS (SELECT doc_id, item_id, c, s, s + shift AS first_word, list_sum(ok[s + 1:s + c]) AS matched FROM (SELECT *, unnest(range(n - c + 1)) AS s FROM g))
SELECT doc_id, item_id, max(matched)::BIGINT AS matched, max(c)::BIGINT AS compared, min(first_word)::BIGINT AS first_word FROM v WHERE 100 * matched >= 80 * c GROUP BY ALL
"""
