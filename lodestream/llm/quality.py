"""Quality rules whose thresholds adapt to each language and source.

Every text is measured once with built-in functions. The measures of the texts that pass the fixed base rules go into
quantile sketches, one a (language, source): histograms over buckets of five significant bits, so a quantile is right to
one part in 32, and sketches merge by adding counts. Outer fences from the quartiles give the thresholds. A share that
is the same in most texts of a group has no spread of its own; there the weight of one occurrence in the group's short
texts, from the sketch of their sizes, stands for it. Small groups take the merged sketch of their language, or of all.
Joined with its thresholds, each text gets its verdict.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestream.llm.common import SPACE, SPACE_CHARS, let, stored, word_array

# The base rules.
SYMBOLS = "#*$%&|<>"
LEAST_WORDS, MOST_REPEATED_PERCENT = 50, 50

#: (measure, its texts' size, units that one occurrence adds in a text of size 1, has a lower fence). The least repetition
#: is two windows of three words; word length has no occurrences.
MEASURES = (("symbols", "chars", 1000, False), ("dup_lines", "lines", 1000, False), ("repeats", "words", 6000, False), ("word_length", None, 0, True))
#: Fences lie so many spreads beyond the quartiles; a spread is the quartiles' distance or one occurrence, the larger.
REACH = 5
#: A group with fewer texts takes the merged sketch of its language, and that failing of all.
LEAST_GROUP = 30


def repeated_words(words: Column) -> Column:
    """Words in three-word windows found twice or more in the text, the first included; each word counts once.

    Windows are compared by a 64-bit hash: sorted with their places, equal neighbours are repeats.
    """

    def of(w: Column) -> Column:
        windows = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.struct(F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("h"), i.alias("i")))
        return F.when(F.size(w) < 3, F.lit(0)).otherwise(let(F.sort_array(windows), covered))

    def covered(s: Column) -> Column:
        again = F.filter(s, lambda x, j: x["h"].eqNullSafe(F.get(s, j - 1)["h"]) | x["h"].eqNullSafe(F.get(s, j + 1)["h"]))
        return let(F.sort_array(F.transform(again, lambda x: x["i"])), lambda p: F.aggregate(F.transform(p, lambda x, j: F.when(j == 0, F.lit(3)).otherwise(F.least(F.lit(3), x - F.get(p, j - 1)))), F.lit(0), lambda a, b: a + b))

    return let(words, of).cast("long")


def measured(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines and base_failed; drops nothing."""
    t = F.coalesce(F.col(text), F.lit(""))
    bare = F.translate(t, SPACE_CHARS, "")
    words = word_array(t)
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(f"[^{SPACE}]"))
    counts = let(words, lambda w: F.struct(F.size(w).cast("long").alias("n"), repeated_words(w).alias("r")))
    line_counts = let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("d")))
    made = df.select("*", counts.alias("__w"), line_counts.alias("__l"), F.char_length(bare).cast("long").alias("__c"), (F.char_length(t) - F.char_length(F.translate(t, SYMBOLS, ""))).cast("long").alias("__s"))
    out = {"n_words": F.col("__w.n"), "word_chars": F.col("__c"), "n_symbols": F.col("__s"), "n_dup_lines": F.col("__l.d"), "n_repeat_words": F.col("__w.r"), "n_lines": F.col("__l.n")}
    made = made.withColumns(out).drop("__w", "__l", "__c", "__s")
    return made.withColumn("base_failed", (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED_PERCENT * F.col("n_words")))


def measures() -> dict[str, Column]:
    """The measures as whole numbers: parts in a thousand, and hundredths of a character."""
    return {
        "symbols": F.expr("1000 * n_symbols div greatest(word_chars, 1)"),
        "dup_lines": F.expr("1000 * n_dup_lines div greatest(n_lines, 1)"),
        "repeats": F.expr("1000 * n_repeat_words div greatest(n_words, 1)"),
        "word_length": F.expr("100 * word_chars div greatest(n_words, 1)"),
    }


def sizes() -> dict[str, Column]:
    return {"chars": F.col("word_chars"), "lines": F.col("n_lines"), "words": F.col("n_words")}


def width(v: Column) -> Column:
    """How many values share v's bucket."""
    return F.pow(F.lit(2), F.greatest(F.length(F.bin(v)) - 6, F.lit(0))).cast("long")


def bucket(v: Column) -> Column:
    """v with five significant bits after the first kept."""
    return v - F.pmod(v, width(v))


def sketches(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, measure, bucket, n): one sketch a group and measure, merged by adding n."""
    one = F.explode(F.array(*[F.struct(F.lit(k).alias("measure"), bucket(v).alias("bucket")) for k, v in (measures() | sizes()).items()])).alias("m")
    return rows.select(*keys, one).groupBy(*keys, "m.measure", "m.bucket").agg(F.count("*").alias("n"))


def fences(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, group_rows, <measure>_low, <measure>_high) from the sketches' quartiles and the sizes' first tenth."""
    from pyspark.sql import Window

    group = Window.partitionBy(*keys, "measure")
    upto = F.sum("n").over(group.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0))
    cum = sketch.select(*keys, "measure", "bucket", upto.alias("upto"), F.sum("n").over(group).alias("total"))
    at = lambda tenths: F.min(F.when(20 * F.col("upto") >= tenths * F.col("total"), F.col("bucket")))
    quantiles = cum.groupBy(*keys, "measure").agg(F.max("total").alias("total"), at(2).alias("short"), at(5).alias("q1"), at(15).alias("q3"))
    own = lambda name, c: F.max(F.when(F.col("measure") == name, F.col(c)))
    cols = [F.max("total").alias("group_rows")]
    for name, size, units, has_low in MEASURES:
        one = F.ceil(F.lit(units) / F.greatest(own(size, "short"), F.lit(1))) if size else F.lit(0)
        # Quartiles are known to one bucket.
        spread = REACH * F.greatest(own(name, "q3") - own(name, "q1") + width(own(name, "q3")), one)
        cols.append((own(name, "q3") + spread).cast("long").alias(f"{name}_high"))
        if has_low:
            cols.append((own(name, "q1") - spread).cast("long").alias(f"{name}_low"))
    return quantiles.groupBy(*keys).agg(*cols)


LIMITS = [x for name, _, _, has_low in MEASURES for x in ([f"{name}_high", f"{name}_low"] if has_low else [f"{name}_high"])]


def thresholds(rows: DataFrame, lang: str = "lang", source: str = "source") -> DataFrame:
    """(lang, source, limits) for every pair in rows; the limits are the group's own, its language's, or all rows'."""
    # The sketches hold a few hundred buckets a group, whatever the number of rows.
    base = stored(sketches(rows.filter(~F.col("base_failed")), [lang, source]), "quality-sketches")
    by_lang = base.groupBy(lang, "measure", "bucket").agg(F.sum("n").alias("n"))
    over_all = by_lang.groupBy("measure", "bucket").agg(F.sum("n").alias("n")).withColumn("__all", F.lit(1))
    own = fences(base, [lang, source]).select(F.col(lang).alias("__lang"), F.col(source).alias("__source"), F.struct("group_rows", *LIMITS).alias("own"))
    wide = fences(by_lang, [lang]).select(F.col(lang).alias("__lang2"), F.struct("group_rows", *LIMITS).alias("wide"))
    # One row of a few numbers.
    widest = fences(over_all, ["__all"]).select("group_rows", *LIMITS).first()
    last = F.struct(*[F.lit(widest[k] if widest else None).cast("long").alias(k) for k in ["group_rows", *LIMITS]])
    pick = F.when(F.col("own.group_rows") >= LEAST_GROUP, F.col("own")).when(F.col("wide.group_rows") >= LEAST_GROUP, F.col("wide")).otherwise(last)
    return own.join(wide, F.col("__lang").eqNullSafe(F.col("__lang2"))).select("__lang", "__source", pick.alias("limits"))


def judged(rows: DataFrame, lang: str = "lang", source: str = "source") -> DataFrame:
    """Joins measured rows with their thresholds and adds kept; rows that fail the base rules are not kept.

    Null languages and sources form groups of their own. A group in which every row fails has no thresholds and needs none.
    """
    limits = thresholds(rows, lang, source)
    joined = rows.join(limits, F.col(lang).eqNullSafe(F.col("__lang")) & F.col(source).eqNullSafe(F.col("__source")), "left")
    good = F.lit(True)
    for name, value in measures().items():
        good = good & (value <= F.col(f"limits.{name}_high"))
        if f"{name}_low" in LIMITS:
            good = good & (value >= F.col(f"limits.{name}_low"))
    return joined.withColumn("kept", ~F.col("base_failed") & F.coalesce(good, F.lit(False))).drop("__lang", "__source", "limits")


def quality_rules(df: DataFrame, keep: list[str], text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """One row for each row of df: keep, the base counts, base_failed and kept.

    Null and empty texts have no words, fail the base rules and are not kept. Repeated rows are measured alike and all
    returned. An empty table gives an empty table. Columns of df that aren't in keep are never read; a kept column with the
    name of one that is added gives way to it.
    """
    made = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    df = df.select(*[F.col(f"`{c}`") for c in dict.fromkeys([*keep, lang, source])], F.col(f"`{text}`").alias("__text"))
    keep = [c for c in keep if c.lower() not in made]
    rows = stored(measured(df, "__text").drop("__text"), "quality-measures")
    return judged(rows, lang, source).select(*keep, *made)


#: The same rows in DuckDB's SQL.
SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, lang, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT rid, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM d),
u AS (SELECT rid, unnest(ws) AS x, unnest(range(len(ws))) AS i FROM w),
tri AS (SELECT rid, i, x, lead(x, 1) OVER p AS y, lead(x, 2) OVER p AS z FROM u WINDOW p AS (PARTITION BY rid ORDER BY i)),
again AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, x, y, z) AS c FROM tri WHERE z IS NOT NULL),
rep AS (SELECT rid, count(DISTINCT j) AS r FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS j FROM again WHERE c >= 2) GROUP BY rid),
l AS (SELECT rid, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
m AS (SELECT d.rid, doc_id, lang, source, len(ws)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
  length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
  coalesce(r, 0)::BIGINT AS n_repeat_words, len(ls)::BIGINT AS n_lines FROM d JOIN w USING (rid) JOIN l USING (rid) LEFT JOIN rep USING (rid)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, 1000 * n_symbols // greatest(word_chars, 1) AS symbols,
  1000 * n_dup_lines // greatest(n_lines, 1) AS dup_lines, 1000 * n_repeat_words // greatest(n_words, 1) AS repeats, 100 * word_chars // greatest(n_words, 1) AS word_length FROM m),
v AS (SELECT lang, source, 'symbols' AS measure, symbols AS x FROM b WHERE NOT base_failed UNION ALL SELECT lang, source, 'dup_lines', dup_lines FROM b WHERE NOT base_failed
  UNION ALL SELECT lang, source, 'repeats', repeats FROM b WHERE NOT base_failed UNION ALL SELECT lang, source, 'word_length', word_length FROM b WHERE NOT base_failed
  UNION ALL SELECT lang, source, 'chars', word_chars FROM b WHERE NOT base_failed UNION ALL SELECT lang, source, 'lines', n_lines FROM b WHERE NOT base_failed UNION ALL SELECT lang, source, 'words', n_words FROM b WHERE NOT base_failed),
k AS (SELECT lang, source, measure, x - x % (1 << greatest(length(bin(x)) - 6, 0)) AS bucket FROM v),
lv AS (SELECT 0 AS lv, lang, source, measure, bucket, count(*) AS n FROM k GROUP BY ALL UNION ALL SELECT 1, lang, NULL, measure, bucket, count(*) FROM k GROUP BY ALL UNION ALL SELECT 2, NULL, NULL, measure, bucket, count(*) FROM k GROUP BY ALL),
c AS (SELECT *, sum(n) OVER (PARTITION BY lv, lang, source, measure ORDER BY bucket) AS upto, sum(n) OVER (PARTITION BY lv, lang, source, measure) AS total FROM lv),
q AS (SELECT lv, lang, source, measure, max(total) AS total, min(bucket) FILTER (10 * upto >= total) AS short, min(bucket) FILTER (4 * upto >= total) AS q1, min(bucket) FILTER (4 * upto >= 3 * total) AS q3 FROM c GROUP BY ALL),
e AS (SELECT lv, lang, source, max(total) AS group_rows, max(short) FILTER (measure = 'chars') AS chars, max(short) FILTER (measure = 'lines') AS lines, max(short) FILTER (measure = 'words') AS words,
  max(q3) FILTER (measure = 'symbols') AS s3, max(sp) FILTER (measure = 'symbols') AS sd, max(q3) FILTER (measure = 'dup_lines') AS d3, max(sp) FILTER (measure = 'dup_lines') AS dd,
  max(q3) FILTER (measure = 'repeats') AS r3, max(sp) FILTER (measure = 'repeats') AS rd, max(q3) FILTER (measure = 'word_length') AS w3, max(q1) FILTER (measure = 'word_length') AS w1, max(sp) FILTER (measure = 'word_length') AS wd
  FROM (SELECT *, q3 - q1 + (1 << greatest(length(bin(q3)) - 6, 0)) AS sp FROM q) GROUP BY ALL),
f AS (SELECT lv, lang, source, group_rows, s3 + 5 * greatest(sd, ceil(1000 / greatest(chars, 1))) AS symbols_high, d3 + 5 * greatest(dd, ceil(1000 / greatest(lines, 1))) AS dup_lines_high,
  r3 + 5 * greatest(rd, ceil(6000 / greatest(words, 1))) AS repeats_high, w3 + 5 * wd AS word_length_high, w1 - 5 * wd AS word_length_low FROM e),
g AS (SELECT o.lang, o.source, CASE WHEN o.group_rows >= 30 THEN 0 WHEN a.group_rows >= 30 THEN 1 ELSE 2 END AS lv FROM f o JOIN f a ON o.lv = 0 AND a.lv = 1 AND o.lang IS NOT DISTINCT FROM a.lang),
h AS (SELECT g.lang, g.source, f.* EXCLUDE (lv, lang, source) FROM g JOIN f ON f.lv = g.lv AND (g.lv = 2 OR f.lang IS NOT DISTINCT FROM g.lang) AND (g.lv > 0 OR f.source IS NOT DISTINCT FROM g.source))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND coalesce(symbols <= symbols_high AND dup_lines <= dup_lines_high AND repeats <= repeats_high AND word_length <= word_length_high AND word_length >= word_length_low, false) AS kept
FROM b LEFT JOIN h ON b.lang IS NOT DISTINCT FROM h.lang AND b.source IS NOT DISTINCT FROM h.source
"""
