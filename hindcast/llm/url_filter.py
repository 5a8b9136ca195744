"""URL filter by association rules. DataFrame operations only.

A short list of fixed rules comes first. All other urls are judged by rules that Spark's FP-growth mines from labelled
urls: combinations of url tokens that go with bad pages.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, join_small, table

#: (host, path prefix, verdict); a host stands for its subdomains too, and the longest rule wins.
FIXED_RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))
BAD = "@bad"
#: Share of the labelled urls, and number of bad ones among them, that a combination must occur in.
MIN_SUPPORT, LEAST_PAGES = 0.002, 20
#: Least lift of a rule, and least confidence, which the lower end of its Wilson interval of Z deviations must reach.
MIN_LIFT, MIN_CONFIDENCE, Z = 1.5, 0.6, 3
A_TO_Z, a_to_z = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """Between the first :// and the next /, ? or #, with A-Z lower-cased; empty without ://."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1), A_TO_Z, a_to_z), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


def query_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1), F.lit(""))


def fixed_rule(host: Column, path: Column, rules) -> Column:
    """The longest rule that fits, as struct(rule, verdict), else null. Of equal lengths, the longer host wins."""
    out = F.lit(None).cast("struct<rule: string, verdict: string>")
    for h, p, verdict in sorted(rules, key=lambda r: (len(r[0]) + len(r[1]), len(r[0]))):
        fits = ((host == h) | F.endswith(host, F.lit(f".{h}"))) & F.startswith(path, F.lit(p))
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def url_tokens(host: Column, path: Column, query: Column) -> Column:
    """Distinct tokens: the host and each domain above it of two labels or more, words of the path, query names, ending."""
    labels = F.split(host, r"\.")
    n = F.size(labels)
    domains = F.transform(F.when(n > 1, F.sequence(F.lit(1), n - 1)).otherwise(F.array(F.lit(1))), lambda i: F.concat(F.lit("h:"), F.array_join(F.slice(labels, i, n), ".")))
    words = F.transform(F.filter(F.split(F.regexp_replace(path, r"\.[A-Za-z0-9]*\z", ""), "/"), lambda x: (x != "") & ~x.rlike(r"^[0-9]+\z")), lambda x: F.concat(F.lit("p:"), x))
    names = F.transform(F.filter(F.split(query, "&"), lambda x: x != ""), lambda x: F.concat(F.lit("q:"), F.substring_index(x, "=", 1)))
    ending = F.regexp_extract(path, r"\.([A-Za-z0-9]+)\z", 1)
    ends = F.when(ending != "", F.array(F.concat(F.lit("e:"), ending))).otherwise(F.array().cast("array<string>"))
    return F.when(host == "", F.array().cast("array<string>")).otherwise(F.array_distinct(F.concat(domains, words, names, ends)))


def wilson(bad: Column, n: Column) -> Column:
    """Lower end of the Wilson interval of a share of `bad` among n."""
    p, zz = bad / n, float(Z * Z)
    return (p + zz / (2 * n) - Z * F.sqrt(p * (1 - p) / n + zz / (4 * n * n))) / (1 + zz / n)


def mine_rules(baskets: DataFrame, min_support: float, min_confidence: float, min_lift: float, least_pages: int, most_tokens: int | None = None) -> DataFrame:
    """(rule_id, tokens, rarest, support, confidence) from baskets (tokens, bad).

    A combination that few labelled urls hold, or whose confidence may be chance, is no rule. A rule is left out if a
    rule over a part of its tokens is at least as sure: it would fire whenever that one does.
    """
    items = cut(baskets.select(F.when(F.col("bad"), F.concat("tokens", F.array(F.lit(BAD)))).otherwise(F.col("tokens")).alias("items")), "baskets")
    n = items.count()
    model = FPGrowth(itemsCol="items", minSupport=min(1.0, max(min_support, (least_pages - 0.5) / max(n, 1))), minConfidence=min_confidence).fit(items)
    both = F.round(F.col("support") * n)
    rules = model.associationRules.where((F.col("consequent")[0] == BAD) & (F.col("lift") >= min_lift))
    rules = rules if most_tokens is None else rules.where(F.size("antecedent") <= most_tokens)
    rules = rules.where((both >= least_pages) & (wilson(both, F.round(both / F.col("confidence"))) >= min_confidence))
    rules = cut(rules.select(F.array_sort("antecedent").alias("tokens"), "support", "confidence"), "url-rules")
    rules = rules.withColumn("rule_id", F.array_join("tokens", " "))
    # a wider rule is found by the tokens that it shares with a narrower one: an index on every token of the narrow rule
    part = rules.select(F.col("tokens").alias("p_tokens"), F.col("confidence").alias("p_conf"), F.col("tokens")[0].alias("token"))
    wide = rules.select("rule_id", "tokens", "confidence", F.explode("tokens").alias("token")).join(part, "token")
    wide = wide.where((F.size("p_tokens") < F.size("tokens")) & (F.size(F.array_except("p_tokens", "tokens")) == 0) & (F.col("p_conf") >= F.col("confidence")))
    rules = rules.join(wide.select("rule_id").distinct(), "rule_id", "left_anti")
    seen = model.freqItemsets.where(F.size("items") == 1).select(F.col("items")[0].alias("token"), F.col("freq"))
    rarest = rules.select("rule_id", F.explode("tokens").alias("token")).join(seen, "token", "left").groupBy("rule_id").agg(F.min(F.struct("freq", "token"))["token"].alias("rarest"))
    return cut(rules.join(rarest, "rule_id"), "url-rules")


def url_filter(
    pages: DataFrame, labels: DataFrame, id_col: str = "page_id", url_col: str = "url", label_id: str = "doc_id", fixed=FIXED_RULES,
    min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE, min_lift: float = MIN_LIFT, least_pages: int = LEAST_PAGES,
    most_tokens: int | None = None,
) -> DataFrame:
    """One row per page: id, host, path, rule (the fixed rule that fits, else null), verdict (allow or block), mined_rule.

    A labelled url is bad if its quality is 0 or it is toxic; the label of a page is the one with the page's id. Mined
    rules are kept by support, count, confidence (with the chance of few pages taken off) and lift, and have any number of tokens
    unless most_tokens sets a limit. They match by an
    inverted index: a rule stands under its rarest token alone, the tokens of the distinct urls look it up, and the whole
    rule is then compared.

    Null urls and urls without :// have empty host and path and are allowed, as nothing speaks against them. Null label
    values count as not bad; a label or page that repeats counts each time. Without labels no rule is mined. Repeated
    pages answer each; very long urls are like others; an empty table gives an empty result. Other columns are not read.
    """
    url = F.col(url_col)
    own = pages.select(F.col(id_col).alias("_id"), url.alias("_url"), host_of(url).alias("host"), path_of(url).alias("path"), query_of(url).alias("_query"))
    own = own.withColumn("_tokens", url_tokens(F.col("host"), F.col("path"), F.col("_query")))
    bad = F.coalesce(F.col("quality") == 0, F.lit(False)) | F.coalesce(F.col("toxic") == 1, F.lit(False))
    baskets = own.select("_id", F.col("_tokens").alias("tokens")).join(labels.select(F.col(label_id).alias("_id"), bad.alias("bad")), "_id").where(F.size("tokens") > 0).select("tokens", "bad")
    rules = mine_rules(baskets, min_support, min_confidence, min_lift, least_pages, most_tokens)
    index = rules.select(F.col("rarest").alias("_rarest"), F.col("tokens").alias("_rule_tokens"), "confidence", "support", "rule_id")
    tokens = own.where(fixed_rule(F.col("host"), F.col("path"), fixed).isNull()).select("_url", "_tokens").groupBy("_url").agg(F.first("_tokens").alias("_tokens"))
    hits = join_small(tokens.select("_url", "_tokens", F.explode("_tokens").alias("_token")), index, {"_token": "_rarest"}, "inner")
    hits = hits.where(F.size(F.array_except("_rule_tokens", "_tokens")) == 0)
    best = hits.groupBy("_url").agg(F.max(F.struct("confidence", "support", "rule_id"))["rule_id"].alias("mined_rule"))
    best = cut(best, "url-hits").withColumnRenamed("_url", "_hit")
    out = join_small(own, best, {"_url": "_hit"}, "left").withColumn("_fixed", fixed_rule(F.col("host"), F.col("path"), fixed))
    return out.select(
        F.col("_id").alias(id_col), "host", "path", F.col("_fixed.rule").alias("rule"),
        F.coalesce(F.col("_fixed.verdict"), F.when(F.col("mined_rule").isNotNull(), "block").otherwise("allow")).alias("verdict"),
        F.when(F.col("_fixed").isNull(), F.col("mined_rule")).alias("mined_rule"),
    )


def op2_url_filter(spark, sf_dir: str) -> DataFrame:
    return url_filter(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))


def url_sql(pages: str = "pages", labels: str = "labels", fixed=FIXED_RULES) -> str:
    """The same in DuckDB; all combinations of the frequent tokens of a url are enumerated."""
    where = "WHEN (host = '{0}' OR ends_with(host, '.{0}')) AND starts_with(path, '{1}') THEN "
    first = sorted(fixed, key=lambda r: (-len(r[0]) - len(r[1]), -len(r[0])))
    case = lambda f: "CASE " + " ".join(where.format(h, p) + f"'{f(h, p, v)}'" for h, p, v in first) + " END" if first else "NULL::VARCHAR"
    zz = f"{Z * Z}.0"
    return f"""
WITH RECURSIVE split AS (SELECT row_number() OVER () AS rid, page_id, url,
      coalesce(translate(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1), '{A_TO_Z}', '{a_to_z}'), '') AS host,
      coalesce(regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1), '') AS path,
      coalesce(regexp_extract(url, '^[^?#]*\\?([^#]*)', 1), '') AS query FROM {pages}),
own AS (SELECT *, CASE WHEN host = '' THEN []::VARCHAR[] ELSE list_distinct(list_concat(
        list_transform(range(1, greatest(len(string_split(host, '.')), 2)), lambda i: 'h:' || array_to_string(list_slice(string_split(host, '.'), i, len(string_split(host, '.'))), '.')),
        list_transform(list_filter(string_split(regexp_replace(path, '\\.[A-Za-z0-9]*\\z', ''), '/'), lambda x: x <> '' AND NOT regexp_matches(x, '^[0-9]+\\z')), lambda x: 'p:' || x),
        list_transform(list_filter(string_split(query, '&'), lambda x: x <> ''), lambda x: 'q:' || split_part(x, '=', 1)),
        CASE WHEN regexp_extract(path, '\\.([A-Za-z0-9]+)\\z', 1) <> '' THEN ['e:' || regexp_extract(path, '\\.([A-Za-z0-9]+)\\z', 1)] ELSE []::VARCHAR[] END)) END AS tokens,
      {case(lambda h, p, v: h + p)} AS rule, {case(lambda h, p, v: v)} AS said FROM split),
baskets AS (SELECT row_number() OVER () AS b, tokens, coalesce(quality = 0, false) OR coalesce(toxic = 1, false) AS bad FROM own JOIN {labels} ON doc_id = page_id WHERE len(tokens) > 0),
every AS (SELECT b, bad, unnest(tokens) AS tok FROM baskets),
items AS (SELECT * FROM every WHERE tok IN (SELECT tok FROM every WHERE bad GROUP BY tok HAVING count(*) >= {LEAST_PAGES})),
combos AS (SELECT b, bad, [tok] AS a FROM items UNION ALL SELECT c.b, c.bad, list_append(c.a, i.tok) FROM combos c JOIN items i ON c.b = i.b AND i.tok > c.a[-1]),
stat AS (SELECT a, count(*)::DOUBLE AS n, (count(*) FILTER (WHERE bad))::DOUBLE AS k FROM combos GROUP BY a),
whole AS (SELECT count(*) AS n, count(*) FILTER (WHERE bad) AS k FROM baskets),
rules AS (SELECT a, k / n AS confidence, k / (SELECT n FROM whole) AS support FROM stat
      WHERE k >= greatest({LEAST_PAGES}, ceil({MIN_SUPPORT} * (SELECT n FROM whole))) AND k / n >= {MIN_CONFIDENCE} AND (k / n) / ((SELECT k FROM whole) / (SELECT n FROM whole)) >= {MIN_LIFT}
      AND (k / n + {zz} / (2 * n) - {Z} * sqrt(k / n * (1 - k / n) / n + {zz} / (4 * n * n))) / (1 + {zz} / n) >= {MIN_CONFIDENCE}),
narrow AS (SELECT * FROM rules r WHERE NOT EXISTS (SELECT 1 FROM rules q WHERE len(q.a) < len(r.a) AND list_has_all(r.a, q.a) AND q.confidence >= r.confidence)),
hits AS (SELECT rid, arg_max(array_to_string(a, ' '), (confidence, support, array_to_string(a, ' '))) AS mined FROM own JOIN narrow ON rule IS NULL AND list_has_all(tokens, a) GROUP BY rid)
SELECT page_id, host, path, rule, coalesce(said, CASE WHEN mined IS NULL THEN 'allow' ELSE 'block' END) AS verdict, mined AS mined_rule FROM own LEFT JOIN hits USING (rid)
"""
