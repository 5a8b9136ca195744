"""Quality rules with adaptive thresholds. DataFrame operations only.

Per document some counts are taken; per language and source a quantile sketch of each measure is kept, and the cut-off
of a measure is a fence beyond the quantiles that the sketch gives, or the split between clean and junk documents that
it shows, instead of one number for all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, cut, let, wide_table

SYMBOLS = "#*$%&|<>"
#: Measures, as whole numbers: (name, numerator, denominator, scale, tail, fence, least spread, floor, ceiling, below too).
#: A document is cut off if its measure is over high + spread, where high leaves `tail` per cent of its group above it
#: and spread is max(least spread, fence * (high - median)); below too, if it is under the same on the other side. The
#: tail is what a group may hold of such junk. Floor and ceiling only guard groups in which all values are alike.
#: Where nearly all values of a group are zero, as with symbols, quantiles say nothing about the rest; such measures
#: (SPLIT) first look for two classes in the sketch.
MEASURES = (
    ("symbols", "n_symbols", "word_chars", 10_000, 25, 4, 0, 100, 2_000, False),
    ("dup_lines", "n_dup_lines", "n_lines", 10_000, 1, 1, 0, 500, 5_000, False),
    ("repeats", "n_repeat_words", "n_words", 10_000, 1, 1, 0, 200, 10_000, False),
    ("word_len", "word_chars", "n_words", 100, 25, 10, 100, 0, 10_000, True),
)
#: Measures cut off between two classes of a sketch: the upper one holds at most the tail, and the split explains this
#: share of the variance of bucket numbers (a uniform or normal group stays below it). Half way between the classes'
#: means is the cut-off. Without such a split the fence decides.
SPLIT, APART = ("symbols",), 0.8
#: A language and source with fewer documents takes the sketch of its language, one with fewer still that of all.
LEAST_DOCS = 100


def percents(tail: int, below: bool) -> tuple[int, ...]:
    """The percentiles that a fence needs."""
    return (tail, 50, 100 - tail) if below else (50, 100 - tail)


def repeated_words(words: Column, window: int = 5) -> Column:
    """Words inside windows of five that the text holds twice or more; the first counts too.

    Windows are compared as 64-bit hashes. Most texts hold no repeat: a hash set tells, and only the rest are sorted.
    """
    n = F.size(words)
    hashes = F.when(n >= window, F.transform(F.sequence(F.lit(0), n - window), lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(window)])))

    def starts(s: Column) -> Column:
        same = lambda x, j: F.coalesce(F.get(s, j)["h"] == x["h"], F.lit(False))
        return F.transform(F.filter(s, lambda x, i: same(x, i - 1) | same(x, i + 1)), lambda x: x["p"])

    def covered(p: Column) -> Column:
        zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
        return F.aggregate(p, zero, lambda a, x: F.struct((a["n"] + window - F.greatest(a["end"] - x, F.lit(0))).alias("n"), (x + window).alias("end")), lambda a: a["n"])

    def count(h: Column) -> Column:
        order = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("p"))))
        return F.when(F.size(F.array_distinct(h)) < F.size(h), let(let(order, lambda s: F.sort_array(starts(s))), covered)).otherwise(F.lit(0))

    return F.coalesce(let(hashes, count), F.lit(0))


def quality_features(docs: DataFrame, id_col: str, text_col: str, lang_col: str, source_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(F.col(id_col).alias("_id"), F.col(lang_col).alias("_lang"), F.col(source_col).alias("_source"), text.alias("_text"))
    base = base.withColumn("_words", F.array_remove(F.split("_text", SPACE), ""))
    base = base.withColumn("_lines", F.filter(F.split("_text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    chars = lambda drop: F.length("_text") - F.length(F.translate("_text", drop, ""))
    long = lambda c, name: c.cast("long").alias(name)
    counts = base.select(
        "_id", "_lang", "_source",
        long(F.size("_words"), "n_words"),
        long(F.length(F.translate("_text", " \t\n\x0b\x0c\r", "")), "word_chars"),
        long(chars(SYMBOLS), "n_symbols"),
        long(F.size("_lines"), "n_lines"),
        long(F.size("_lines") - F.size(F.array_distinct("_lines")), "n_dup_lines"),
        long(repeated_words(F.col("_words")), "n_repeat_words"),
    )
    return counts.withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))


def measure(num: str, den: str, scale: int) -> Column:
    return F.expr(f"({num} * {scale}L) div greatest({den}, 1L)")


def sketch_bucket(x: Column) -> Column:
    """Number of x's bucket: whole numbers to 63 have their own, above that a bucket is a 32nd of a power of two wide."""
    return let(F.greatest(F.length(F.bin(x)) - 6, F.lit(0)), lambda s: F.call_function("shiftright", x, s) + 64 * s)


def bucket_top(b: Column) -> Column:
    """The largest value in bucket b."""
    shift = (b / 64).cast("int")
    return F.call_function("shiftleft", b - 64 * shift + 1, shift) - 1


def sketches(features: DataFrame) -> DataFrame:
    """(lang, source, measure, bucket, n): a sketch is a count per bucket, so merging sketches is adding counts."""
    values = F.array(*[F.struct(F.lit(m[0]).alias("measure"), sketch_bucket(measure(*m[1:4])).alias("bucket")) for m in MEASURES])
    rows = features.where(~F.col("base_failed")).select("_lang", "_source", F.explode(values).alias("v")).select("_lang", "_source", "v.*")
    return rows.groupBy("_lang", "_source", "measure", "bucket").agg(F.count(F.lit(1)).alias("n"))


#: Two classes, in SQL that Spark and DuckDB share, over the buckets of a sketch in order (upto, sum_upto: documents and
#: bucket numbers up to a bucket; total, sum_all, squares: of all): the share of variance that a split above the bucket
#: explains, and the bucket half way between the means of the classes. Numbers from 64 on whose last six bits are below 32
#: name no bucket; the cut-off is then the top of the one before.
LOW, HIGH = "CAST(upto AS DOUBLE)", "nullif(CAST(total - upto AS DOUBLE), 0)"
APART_BY = "(CAST(total AS DOUBLE) * CAST(sum_upto AS DOUBLE) - CAST(upto AS DOUBLE) * CAST(sum_all AS DOUBLE))"
VARIANCE = "nullif(CAST(total AS DOUBLE) * CAST(squares AS DOUBLE) - CAST(sum_all AS DOUBLE) * CAST(sum_all AS DOUBLE), 0)"
EXPLAINED = f"{APART_BY} * {APART_BY} / ({LOW} * {HIGH}) / {VARIANCE}"
HALF_WAY = f"CAST(floor((CAST(sum_upto AS DOUBLE) / {LOW} + CAST(sum_all - sum_upto AS DOUBLE) / {HIGH}) / 2) AS BIGINT)"


def may_split(name: str, tail: int) -> str:
    """SQL: whether the buckets above this one hold something, and at most the tail."""
    return f"measure = '{name}' AND upto < total AND 100 * upto >= {100 - tail} * total"


def quantiles(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """Per key: documents, the percentiles that each measure needs, and the cut-off between two classes or null."""
    merged = sketch.groupBy(*keys, "measure", "bucket").agg(F.sum("n").alias("n"))
    part = Window.partitionBy(*keys, "measure")
    ranked = merged.withColumn("upto", F.sum("n").over(part.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0))).withColumn("total", F.sum("n").over(part))
    number = F.col("n") * F.col("bucket")
    ranked = ranked.withColumn("sum_upto", F.sum(number).over(part.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)))
    ranked = ranked.withColumn("sum_all", F.sum(number).over(part)).withColumn("squares", F.sum(number * F.col("bucket")).over(part))
    at = lambda m, q: F.min(F.when((F.col("measure") == m) & (100 * F.col("upto") >= q * F.col("total")), F.col("bucket")))
    aggs = [F.max("total").alias("docs")] + [bucket_top(at(m[0], q)).alias(f"{m[0]}_q{q}") for m in MEASURES for q in percents(m[4], m[9])]
    best = lambda m: F.max(F.when(F.expr(may_split(m[0], m[4])), F.struct(F.expr(EXPLAINED).alias("share"), (-F.col("bucket")).alias("low"), F.expr(HALF_WAY).alias("mid"))))
    aggs += [let(best(m), lambda x: F.when(x["share"] >= APART, bucket_top(F.when(x["mid"] < 64, x["mid"]).otherwise(F.greatest(x["mid"], x["mid"] - x["mid"] % 64 + 31))))).alias(f"{m[0]}_split") for m in MEASURES if m[0] in SPLIT]
    return ranked.groupBy(*keys).agg(*aggs)


def thresholds(sketch: DataFrame, least_docs: int) -> DataFrame:
    """(lang, source): lower and upper cut-off of each measure, from its own sketch or, if that is thin, a merged one."""
    own, lang, everything = quantiles(sketch, ["_lang", "_source"]), quantiles(sketch, ["_lang"]), quantiles(sketch, [])
    cols = [c for c in own.columns if c not in ("_lang", "_source")]
    lang = lang.select(F.col("_lang").alias("_l"), *[F.col(c).alias(f"l_{c}") for c in cols])
    everything = everything.select(*[F.col(c).alias(f"a_{c}") for c in cols])
    # one row: the quantiles over all rows
    both = own.join(lang, own["_lang"].eqNullSafe(lang["_l"])).join(F.broadcast(everything))
    pick = lambda c: F.when(F.col("docs") >= least_docs, F.col(c)).when(F.col("l_docs") >= least_docs, F.col(f"l_{c}")).otherwise(F.col(f"a_{c}"))
    out = []
    for name, _, _, _, tail, fence, least, floor, ceiling, below in MEASURES:
        low, mid, high = pick(f"{name}_q{tail}") if below else None, pick(f"{name}_q50"), pick(f"{name}_q{100 - tail}")
        fenced = F.least(F.lit(ceiling), high + F.greatest(F.lit(least), fence * (high - mid)))
        fenced = F.coalesce(pick(f"{name}_split"), fenced) if name in SPLIT else fenced
        out.append(F.greatest(F.lit(floor), fenced).cast("long").alias(f"{name}_max"))
        out.append((low - F.greatest(F.lit(least), fence * (mid - low)) if below else F.lit(0)).cast("long").alias(f"{name}_min"))
    return both.select("_lang", "_source", *out)


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least_docs: int = LEAST_DOCS) -> DataFrame:
    """One row per document: id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept.

    The features are written once; their sketches give the cut-offs, which then join back on (lang, source). A source
    with a third of all rows meets in few sketch rows, as counts are added before the shuffle.

    Null or empty text has no words and fails the base rule; very long texts are counted whole. A null language or
    source is a group like any other. A group whose documents all fail the base rule has no cut-offs and needs none.
    Rows that repeat count and answer each for itself; other columns of docs are not read. An empty table gives an empty
    result.
    """
    features = cut(quality_features(docs, id_col, text_col, lang_col, source_col), "quality")
    limits = thresholds(sketches(features), least_docs).withColumnsRenamed({"_lang": "_tl", "_source": "_ts"})
    judged = features.join(limits, features["_lang"].eqNullSafe(limits["_tl"]) & features["_source"].eqNullSafe(limits["_ts"]), "left")
    fine = ~F.col("base_failed")
    for name, num, den, scale, *_ in MEASURES:
        fine = fine & F.coalesce(measure(num, den, scale).between(F.col(f"{name}_min"), F.col(f"{name}_max")), F.lit(True))
    return judged.select(
        F.col("_id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", fine.alias("kept")
    )


def op5_quality_rules(spark, sf_dir: str) -> DataFrame:
    return quality_rules(wide_table(spark, sf_dir, "documents"))


def quality_sql(docs: str = "documents") -> str:
    """The same in DuckDB: features, sketches, cut-offs and verdict."""
    sym = "".join(SYMBOLS)
    bucket = lambda x: f"(({x}) >> greatest(length(bin({x})) - 6, 0)) + 64 * greatest(length(bin({x})) - 6, 0)"
    top = lambda b: f"(((({b}) - 64 * (({b}) // 64) + 1) << (({b}) // 64)) - 1)"
    real = lambda b: f"CASE WHEN {b} < 64 THEN {b} ELSE greatest({b}, {b} - {b} % 64 + 31) END"
    val = {m[0]: f"(({m[1]} * {m[3]}) // greatest({m[2]}, 1))" for m in MEASURES}
    rows = " UNION ALL ".join(f"SELECT lang, source, '{m[0]}' AS measure, {bucket(val[m[0]])} AS bucket FROM features WHERE NOT base_failed" for m in MEASURES)

    def quart(name: str, keys: str) -> str:
        k = keys + ", " if keys else ""
        cols = ", ".join(f"{top(f'min(bucket) FILTER (WHERE measure = {chr(39)}{m[0]}{chr(39)} AND 100 * upto >= {q} * total)')} AS {m[0]}_q{q}" for m in MEASURES for q in percents(m[4], m[9]))
        best = lambda m: f"max(CASE WHEN {may_split(m[0], m[4])} THEN {{'share': {EXPLAINED}, 'low': -bucket, 'mid': {HALF_WAY}}} END)"
        cols += "".join(f", CASE WHEN ({best(m)}).share >= {APART} THEN {top(real('(' + best(m) + ').mid'))} END AS {m[0]}_split" for m in MEASURES if m[0] in SPLIT)
        over = f"OVER (PARTITION BY {k}measure)"
        return f"""{name} AS (SELECT {k}max(total) AS docs, {cols} FROM (
            SELECT {k}measure, bucket, sum(n) OVER (PARTITION BY {k}measure ORDER BY bucket) AS upto, sum(n * bucket) OVER (PARTITION BY {k}measure ORDER BY bucket) AS sum_upto,
                sum(n) {over} AS total, sum(n * bucket) {over} AS sum_all, sum(n * bucket * bucket) {over} AS squares
            FROM (SELECT {k}measure, bucket, count(*) AS n FROM rows GROUP BY {k}measure, bucket)) {'GROUP BY ' + keys if keys else ''})"""

    pick = lambda c: f"CASE WHEN o.docs >= {LEAST_DOCS} THEN o.{c} WHEN l.docs >= {LEAST_DOCS} THEN l.{c} ELSE a.{c} END"
    cuts = []
    for name, _, _, _, tail, fence, least, floor, ceiling, below in MEASURES:
        mid, high = pick(f"{name}_q50"), pick(f"{name}_q{100 - tail}")
        under = f"({pick(f'{name}_q{tail}')}) - greatest({least}, {fence} * (({mid}) - ({pick(f'{name}_q{tail}')})))" if below else 0
        fenced = f"least({ceiling}, ({high}) + greatest({least}, {fence} * (({high}) - ({mid}))))"
        fenced = f"coalesce({pick(f'{name}_split')}, {fenced})" if name in SPLIT else fenced
        cuts.append(f"greatest({floor}, {fenced}) AS {name}_max, {under} AS {name}_min")
    fine = " AND ".join(f"coalesce({val[m[0]]} BETWEEN {m[0]}_min AND {m[0]}_max, true)" for m in MEASURES)
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, lang, source, coalesce(text, '') AS text FROM {docs}),
w AS (SELECT *, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS words,
      list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM d),
win AS (SELECT rid, i, list_slice(words, i, i + 4) AS five FROM (SELECT rid, words, unnest(range(1, len(words) - 3)) AS i FROM w WHERE len(words) >= 5)),
rep AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, five) AS c FROM win) WHERE c >= 2),
cov AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest(range(i, i + 5)) AS p FROM rep) GROUP BY rid),
counts AS (SELECT w.rid, doc_id, lang, source, len(words) AS n_words, length(translate(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '')) AS word_chars,
      length(text) - length(translate(text, '{sym}', '')) AS n_symbols, len(lines) AS n_lines, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
      coalesce(cov.n, 0) AS n_repeat_words FROM w LEFT JOIN cov ON w.rid = cov.rid),
features AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM counts),
rows AS ({rows}),
{quart('own', 'lang, source')}, {quart('langs', 'lang')}, {quart('everything', '')},
limits AS (SELECT o.lang, o.source, {', '.join(cuts)} FROM own o JOIN langs l ON o.lang IS NOT DISTINCT FROM l.lang CROSS JOIN everything a)
SELECT f.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND {fine} AS kept
FROM features f LEFT JOIN limits t ON f.lang IS NOT DISTINCT FROM t.lang AND f.source IS NOT DISTINCT FROM t.source
"""
