"""Join, set, reshaping, validation and scalar-function queries."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from hindcast.functions import scalar as S
from hindcast.operators import aggregates as A
from hindcast.operators import relational as R
from hindcast.operators import windows as W

from .bindings import CELLS_SQL, DAILY_SQL, PLOTS_SQL, PREDICTIONS_SQL, cells, daily, load, n, plots, predictions, r

FIRST_SQL = f"{DAILY_SQL}, firsts AS (SELECT user_id, min(date) AS anchor FROM daily GROUP BY user_id)"


def anchors(spark, d):
    return daily(spark, d).groupBy("user_id").agg(F.min("date").alias("anchor"))


def projected_cells(spark, d):
    o = load(spark, d, "orders")
    return o.select(F.col("o_orderkey").cast("string").alias("id"), S.number(F.col("o_totalprice").cast("string")).alias("price"), S.number(F.col("o_orderstatus")).alias("status_number"), n(F.year("o_orderdate"), "year"))


def filters_and_membership(spark, d):
    c = cells(spark, d)
    wanted = load(spark, d, "nation").join(load(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).where("r_regionkey < 2").select(F.col("n_name").alias("nation"))
    out = c.where(F.col("year").between(1996, 1999) & F.col("entity").isNotNull()).join(wanted, "nation", "left_semi")
    return out.select("entity", "context", n("replicates", "replicates"))


def truth_values(spark, d):
    o = load(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 5 == 0, " TRUE ").when(F.col("o_orderkey") % 5 == 1, "no").when(F.col("o_orderkey") % 5 == 2, "1").when(F.col("o_orderkey") % 5 == 3, "False").otherwise("yes").alias("t"))
    return o.select("o_orderkey", S.truth(F.col("t")).alias("true_only"), S.truth(F.col("t"), "strict").alias("strict"), S.truth(F.col("t"), "false_only").alias("false_only"))


def support_states(spark, d):
    c = cells(spark, d)
    known = c.where("year < 1999").select("context").withColumn("context", F.substring_index("context", "-", -1)).distinct().withColumn("hit", F.lit(1))
    test = c.where("year >= 1999").select("entity", "year", F.col("nation").alias("context")).join(known, "context", "left")
    state = F.when(F.col("hit").isNotNull() & (F.col("entity") < "Brand#3"), "SUPPORTED").otherwise("UNSUPPORTED")
    return test.select("entity", "year", "context", state.alias("state"))


def forbidden_column_audit(spark, d):
    """Columns of two tables whose plain names hold a forbidden word, and how many values each brings along."""
    out = None
    for t in ("orders", "lineitem"):
        df = load(spark, d, t)
        bad = set(R.forbidden_columns(df.columns, ["price", "tax"]))
        counts = F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.lit(c in bad).alias("forbidden"), F.col(c).alias("values")) for c in df.columns])).alias("x")
        one = df.agg(*[F.count(c).alias(c) for c in df.columns]).select(counts).select("x.*")
        out = one if out is None else out.union(one)
    return out.select("name", "forbidden", n("values", "values"))


def S_plain(name: str) -> str:
    return R.plain(name)


def melted_grid(spark, d):
    wide = cells(spark, d).where("nation in ('NATION_1', 'NATION_2', 'NATION_3')").groupBy("entity").pivot("nation", ["NATION_1", "NATION_2", "NATION_3"]).agg(F.sum("replicates"))
    long = R.melt(wide, ["entity"], ["NATION_1", "NATION_2", "NATION_3"], "context", "replicates")
    long = W.coded(W.coded(long, "entity", "entity_code"), "context", "context_code")
    return long.select("entity", "context", n("replicates", "replicates"), n("entity_code", "entity_code"), n("context_code", "context_code"))


def finite_mask(spark, d):
    e = load(spark, d, "events").withColumn("x", F.when(F.col("event_id") % 7 == 0, F.lit(float("nan"))).when(F.col("event_id") % 11 == 0, F.lit(None)).otherwise(F.col("value").cast("decimal(18,6)").cast("double")))
    out = e.where(~F.isnan("x") & F.col("x").isNotNull()).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.avg("x").alias("mean"))
    return out.select("event_type", n("n", "n"), r("mean", "mean"))


def one_hot_segments(spark, d):
    c = load(spark, d, "customer")
    return R.one_hot(c.select("c_nationkey", "c_mktsegment"), "c_nationkey", "c_mktsegment", ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]).withColumn("c_nationkey", F.col("c_nationkey").cast("long"))


def missing_encodings(spark, d):
    c = load(spark, d, "customer").select("c_custkey", F.when(F.col("c_custkey") % 9 != 0, F.col("c_acctbal").cast("decimal(12,2)").cast("double")).alias("balance"), (F.col("c_custkey") % 2 == 0).alias("train"))
    mean = c.where("train").agg(F.avg("balance").alias("m"))
    # one row: the mean of the training rows
    out = R.with_missing_flag(c.join(F.broadcast(mean)).withColumn("imputed", F.coalesce("balance", "m")), "balance")
    return out.select("c_custkey", r("balance", "balance"), "balance_missing", r("imputed", "imputed"))


def contract_violations(spark, d):
    li = load(spark, d, "lineitem")
    out = R.violations(li, {"quantity": F.col("l_quantity").between(1, 50), "discount": F.col("l_discount") <= 0.05, "flag": F.col("l_returnflag").isin("A", "N")}, ["l_orderkey", "l_linenumber"])
    return out.select(*[n(c, c) for c in out.columns])


def checked_cardinality(spark, d):
    a = cells(spark, d).where("year = 1999").groupBy("entity").agg(F.sum("replicates").alias("a"))
    b = cells(spark, d).where("year = 2000").groupBy("entity").agg(F.sum("replicates").alias("b"))
    return R.checked_join(a, b, ["entity"], "one_to_one").select("entity", n("a", "a"), n("b", "b"))


def referential_completeness(spark, d):
    o = load(spark, d, "orders").select(F.col("o_custkey").alias("k"))
    c = load(spark, d, "customer").where("c_custkey % 10 <> 0").select(F.col("c_custkey").alias("k"))
    return R.complete_join(o, c, ["k"], strict=False).groupBy("matched").agg(n(F.count(F.lit(1)), "rows"))


def membership_by_key(spark, d):
    sealed = predictions(spark, d).where("model = 'G+E' and year = 2001").select("entity", "context", "predicted")
    answer = cells(spark, d).where("year = 2001 and entity <> 'Brand#1'").select("entity", "context", "observed")
    out = R.membership_join(sealed, answer, ["entity", "context"], ["observed"])
    return out.select("entity", "context", "present", r("observed", "observed", 7))


def missing_keys(spark, d):
    c = cells(spark, d)
    out = c.where("year = 2001").select("entity", "nation").join(c.where("year = 1995 and replicates > 12").select("entity", "nation"), ["entity", "nation"], "left_anti")
    return out.withColumn("reason", F.when(F.col("entity") < "Brand#2", "EARLY_BRAND").otherwise("ABSENT_IN_1995"))


def paired_segments(spark, d):
    m = A.collapse_replicates(plots(spark, d), ["entity", "nation", "segment"], "price")
    out = R.paired(m, ["entity", "nation"], "segment", "AUTOMOBILE", "BUILDING", "observed")
    return out.select("entity", "nation", r("a", "a", 7), r("b", "b", 7), r(F.col("b") - F.col("a"), "difference", 6))


def candidate_universe(spark, d):
    c = cells(spark, d)
    e = c.where("year < 1997").select("entity").distinct()
    x = c.where("year = 2001").select("context").distinct()
    # a product by definition: every entity with every feasible context
    return S.seal(e.crossJoin(x), F.concat_ws("|", "entity", "context")).select("digest", n("rows", "pairs"))


def scenario_grid(spark, d):
    """Every penalty and width on every pair of an entity fold and a context fold, with the cells that test and train it.

    A pair tests the cells of both folds and trains on those of neither; all of it comes from the counts of the nine pairs.
    """
    c = W.coded(W.coded(cells(spark, d), "entity", "g"), "context", "e")
    own = c.groupBy(F.pmod("g", F.lit(3)).cast("long").alias("entity_fold"), F.pmod("e", F.lit(3)).cast("long").alias("context_fold")).agg(F.count(F.lit(1)).alias("test"))
    everywhere, row, column = W.Window.partitionBy(), W.Window.partitionBy("entity_fold"), W.Window.partitionBy("context_fold")
    # nine rows: windows over all of them are small
    total = F.sum("test").over(everywhere) - F.sum("test").over(row) - F.sum("test").over(column) + F.col("test")
    pairs = own.withColumn("train", total)
    grid = F.explode(F.array(*[F.struct(F.lit(a).alias("alpha"), F.lit(g).alias("gamma")) for a in (0.1, 1.0, 10.0) for g in (0.5, 1.0, 2.0)])).alias("x")
    out = pairs.select("entity_fold", "context_fold", "test", "train", grid).select("x.*", "entity_fold", "context_fold", n("test", "test"), n("train", "train"))
    return out.withColumn("scenario", F.row_number().over(W.Window.orderBy("alpha", "gamma", "entity_fold", "context_fold")).cast("long"))


def interval_aggregate(spark, d):
    """Series within 7 and 14 days of a user's first day."""
    horizons = spark.createDataFrame([("T1", 7), ("T2", 14)], "horizon string, days int")
    # two horizons per anchor
    a = anchors(spark, d).crossJoin(F.broadcast(horizons))
    rows = R.interval_join(a, daily(spark, d), ["user_id"], "date", F.col("anchor"), F.date_add("anchor", F.col("days")))
    out = rows.groupBy("user_id", "horizon").agg(F.avg("v_mean").alias("mean"), F.min("v_min").alias("low"), F.max("v_max").alias("high"), F.sum("v_sum").alias("total"), F.count(F.lit(1)).alias("days"))
    return out.select("user_id", "horizon", *[r(c, c, 9) for c in ("mean", "low", "high", "total")], n("days", "days"))


def anchored_history(spark, d):
    """Orders in the 60 days from a customer's latest calendar day, in each of the three years before."""
    o = load(spark, d, "orders").select("o_custkey", F.to_date("o_orderdate").alias("date"), F.col("o_totalprice").cast("decimal(12,2)").alias("p"))
    last = o.groupBy("o_custkey").agg(F.max("date").alias("anchor"))
    years = last.select("o_custkey", "anchor", F.explode(F.sequence(F.year("anchor") - 3, F.year("anchor") - 1)).alias("year"))
    years = years.withColumn("begin", S.anchor_in_year(F.col("year"), F.col("anchor")))
    rows = R.interval_join(years, o, ["o_custkey"], "date", F.col("begin"), F.date_add("begin", 60))
    return rows.groupBy("o_custkey").agg(n(F.count(F.lit(1)), "orders"), n(F.countDistinct("year"), "years"), F.sum("p").cast("double").alias("total"))


def nearest_purchase(spark, d):
    e = load(spark, d, "events").select("user_id", "ts", "event_id", "event_type")
    left = e.where("event_type = 'signup'").select("user_id", "ts", "event_id")
    right = e.where("event_type = 'purchase'").groupBy("user_id", F.col("ts").alias("p_ts")).agg(F.min("event_id").alias("p_id"))
    return R.nearest_match(left, right, ["user_id"], "ts", "p_ts", "p_id").select("event_id", n("p_id", "p_id"))


def nearest_vectors(spark, d):
    e = load(spark, d, "embeddings")
    out = R.nearest_points(e.where("label >= 5"), e.where("label < 5"), "vec_id", "embedding")
    return out.select("vec_id", "nearest", r("nearest_sq", "nearest_sq"), r("mean_k_sq", "mean_k_sq"))


def great_circle(spark, d):
    """Distance of each nation's made-up place to the nearest nation of an earlier key."""
    p = load(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("k"), (F.col("n_nationkey") * 7 % 90 - 45.0).alias("lat"), (F.col("n_nationkey") * 31 % 180 - 90.0).alias("lon"))
    q = p.select(F.col("k").alias("k2"), F.col("lat").alias("lat2"), F.col("lon").alias("lon2"))
    km = S.great_circle_km(F.col("lat"), F.col("lon"), F.col("lat2"), F.col("lon2"))
    return p.join(F.broadcast(q), F.col("k2") < F.col("k")).groupBy("k").agg(r(F.min(km), "km", 3))


def context_contrasts(spark, d):
    c = cells(spark, d).where("nation in ('NATION_1', 'NATION_2')")
    out = R.shared_pairs(c, "entity", "context", "observed")
    return out.select("a", "b", n("n", "n"), r("mean_diff", "mean_diff"), r("mean_abs_diff", "mean_abs_diff"))


def pairwise_residuals(spark, d):
    p = predictions(spark, d).where("model = 'G+E'").withColumn("res", F.col("observed") - F.col("predicted"))
    return p.groupBy("context").agg(r(2 * F.var_samp("res"), "msed", 2), n(F.count(F.lit(1)), "n"))


def assembled_cells(spark, d):
    p = predictions(spark, d).where("model = 'G+E'")
    support = cells(spark, d).groupBy("nation").agg(F.sum("replicates").alias("support"))
    lock = p.groupBy("year").agg(F.max(F.abs(F.col("observed") - F.col("predicted"))).alias("lock"))
    return p.join(support, "nation").join(lock, "year").select("entity", "context", n("support", "support"), r("lock", "lock"))


def kernel_vector_product(spark, d):
    """Sum over train entities of K(test, train) * coefficient, K a function of the brand numbers, without a cell matrix."""
    c = cells(spark, d).groupBy("entity").agg(F.sum("replicates").cast("double").alias("coef")).withColumn("b", F.array(F.regexp_extract("entity", r"(\d+)", 1).cast("double")))
    out = R.kernel_sums(c, c, "entity", "b", "coef", lambda sq: np.exp(-sq / 50))
    return out.select(F.col("entity").alias("test"), r("value", "value", 3))


def union_of_sources(spark, d):
    a = load(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    b = load(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("segment"))
    return a.unionByName(b, allowMissingColumns=True).groupBy("segment").agg(n(F.count(F.lit(1)), "rows"), n(F.count("name"), "named"))


def key_sets(spark, d):
    a = load(spark, d, "customer").select(F.col("c_nationkey").cast("long").alias("k")).distinct()
    b = load(spark, d, "supplier").select(F.col("s_nationkey").cast("long").alias("k")).distinct()
    tag = lambda df, name: df.select(F.lit(name).alias("op"), "k")
    return tag(a.intersect(b), "both").union(tag(a.exceptAll(b), "only_a")).union(tag(b.exceptAll(a), "only_b")).union(tag(a.union(b).distinct(), "either"))


def set_equality(spark, d):
    a = load(spark, d, "nation").select(F.col("n_nationkey").alias("k"))
    b = load(spark, d, "supplier").select(F.col("s_nationkey").alias("k")).where("k <> 3")
    out = R.set_report(a, b, "k")
    return out.select(n("missing", "missing"), n("extra", "extra"), "equal")


def duplicate_keys(spark, d):
    out = R.repeated_keys(load(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])
    return out.select("l_orderkey", n("l_linenumber", "l_linenumber"), n("copies", "copies"))


def feature_stacking(spark, d):
    e = load(spark, d, "embeddings").select("vec_id", F.transform(F.slice("embedding", 1, 2), lambda x: x.cast("double")).alias("g"), F.transform(F.slice("embedding", 3, 2), lambda x: x.cast("double")).alias("e"))
    both, product = F.concat("g", "e"), S.outer_product(F.col("g"), F.col("e"))
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    return e.select("vec_id", n(F.size(both), "width"), r(total(both), "stacked"), r(total(product), "product"))


def pivoted_models(spark, d):
    out = predictions(spark, d).groupBy("context").pivot("model", ["G", "E"]).agg(F.avg("predicted"))
    return out.select("context", r("G", "g_mean"), r("E", "e_mean"))


def text_normalisation(spark, d):
    p = load(spark, d, "part")
    return p.select("p_partkey", S.code(F.concat(F.lit(" "), "p_brand", F.lit("-x y "))).alias("code"), S.normalised(F.col("p_brand")).alias("plain"), F.col("p_brand").rlike("^Brand#[0-9]+$").alias("full_match"), F.split_part("p_brand", F.lit("#"), F.lit(2)).alias("tail"))


def years_in_text(spark, d):
    o = load(spark, d, "orders").select("o_orderkey", F.concat(F.lit("order of "), F.date_format("o_orderdate", "yyyy-MM-dd")).alias("t"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("s"))
    return o.select("o_orderkey", S.year_in(F.col("t")).alias("found"), S.leading_year(F.col("s")).alias("leading"), S.leading_year(F.col("t")).alias("none"))


def joined_sets(spark, d):
    c = load(spark, d, "customer")
    return c.groupBy("c_nationkey").agg(S.joined_set("c_mktsegment").alias("segments")).withColumn("c_nationkey", F.col("c_nationkey").cast("long"))


def date_functions(spark, d):
    o = load(spark, d, "orders").withColumn("day", F.to_date("o_orderdate"))
    sin, cos = S.day_cycle(F.col("day"))
    iso = F.date_format("day", "yyyy-MM-dd")
    parsed = S.parsed_date(F.when(F.col("o_orderkey") % 3 == 0, F.date_format("day", "MM/dd/yyyy")).when(F.col("o_orderkey") % 3 == 1, iso).otherwise("no date"))
    return o.select("o_orderkey", iso.alias("iso"), n(F.dayofyear("day"), "doy"), F.date_format(F.date_add("day", 60), "yyyy-MM-dd").alias("plus60"), n(F.datediff("day", F.lit("1995-01-01").cast("date")), "days"), F.date_format(parsed, "yyyy-MM-dd").alias("parsed"), r(sin, "sin"), r(cos, "cos"))


def math_functions(spark, d):
    c = load(spark, d, "customer").select("c_custkey", F.col("c_acctbal").cast("decimal(12,2)").cast("double").alias("x"))
    x = F.col("x")
    return c.select("c_custkey", r(F.exp(x / 10000), "e"), r(F.log(F.abs(x) + 1), "l"), r(F.sqrt(F.abs(x)), "q"), F.signum(x).alias("sign"), S.clip(x, 0.0, 5000.0).alias("clipped"), S.close(x, F.lit(1000.0), 500.0).alias("near"), *[r(f, name, 6) for f, name in zip(S.spectral_filters(F.abs(x) + 1, 2.0), ("f1", "f2"), strict=True)])


def standardised(spark, d):
    """Balances standardised by the mean and sd (n) of the even customers."""
    c = load(spark, d, "customer").select("c_custkey", F.col("c_acctbal").cast("decimal(12,2)").cast("double").alias("x"))
    t = c.where("c_custkey % 2 = 0").agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s"))
    # one row: the training moments
    return c.join(F.broadcast(t)).select("c_custkey", r((F.col("x") - F.col("m")) / F.when(F.col("s") > 0, F.col("s")).otherwise(1.0), "z"))


def array_summaries(spark, d):
    e = load(spark, d, "embeddings").select("vec_id", F.transform(F.slice("embedding", 1, 12), lambda x: x.cast("double")).alias("a"), F.transform(F.slice("embedding", 13, 12), lambda x: x.cast("double")).alias("b"))
    return e.select("vec_id", r(S.array_mean(F.col("a")), "mean"), r(S.array_median(F.col("a")), "median"), r(S.dot(F.col("a"), F.col("b")), "dot"), r(S.squared_distance(F.col("a"), F.col("b")), "sq"))


def json_columns(spark, d):
    e = load(spark, d, "events").select("event_id", F.from_json("props", "k long").alias("p"))
    return e.select("event_id", F.col("p.k").alias("k"), F.to_json("p").alias("canonical"))


def formatted_numbers(spark, d):
    c = load(spark, d, "customer")
    return c.select("c_custkey", S.printed(F.col("c_acctbal"), "%.2f").alias("two"), F.when(F.col("c_custkey").isNotNull(), F.format_string("W%03d", F.col("c_custkey"))).alias("id"))


def threshold_labels(spark, d):
    p = A.regression_metrics(predictions(spark, d), ["model", "year"]).select("model", "year", (F.col("mae") / 20000).alias("c"))
    return p.select("model", "year", F.when(F.col("c") < 0.2, "LOW").when(F.col("c") < 0.4, "MID").otherwise("HIGH").alias("label"), r(S.next_level(F.least(F.lit(1.0), F.col("c"))), "next_level"))


def payload_sniffing(spark, d):
    p = load(spark, d, "pages")
    url = F.regexp_replace(F.col("url"), r"[?#].*$", "")
    return p.select("page_id", F.lower(F.ltrim(F.substring("html", 1, 256))).startswith("<!doctype html").alias("is_html"), url.alias("clean"), F.regexp_extract("url", r"^[a-z]+://([^/?#]+)", 1).alias("host"))


def evidence_claims(spark, d):
    """Numbers claimed in the assistant's turns that no turn of the user mentions, and inflated words."""
    c = load(spark, d, "conversations")
    said = c.where("role = 'user'").groupBy("conv_id").agg(F.flatten(F.collect_list(S.numbers_in(F.col("text")))).alias("evidence"))
    a = c.where("role <> 'user'").join(said, "conv_id", "left").withColumn("claimed", S.numbers_in(F.col("text")))
    none = F.array().cast("array<double>")
    loose = S.untraceable(F.col("claimed"), F.coalesce("evidence", none))
    return a.select("conv_id", "turn", n(F.size("claimed"), "numbers"), n(F.size(loose), "untraceable"), n(F.size(S.phrases_in(F.col("text"), ["the ", "certainly", "always"])), "phrases"))


def sql(body: str, prelude: str = "") -> str:
    return f"WITH {prelude} {body}" if prelude else body


SIX = lambda x: f"regexp_extract_all({x}, '-?[0-9]+(?:\\.[0-9]+)?')"
QUERIES = {
    "projected_cells": (projected_cells, "SELECT o_orderkey::VARCHAR AS id, o_totalprice AS price, try_cast(o_orderstatus AS DOUBLE) AS status_number, year(o_orderdate) AS year FROM orders"),
    "filters_and_membership": (filters_and_membership, sql("SELECT entity, context, replicates FROM cells WHERE year BETWEEN 1996 AND 1999 AND nation IN (SELECT n_name FROM nation WHERE n_regionkey < 2)", CELLS_SQL)),
    "truth_values": (truth_values, "SELECT o_orderkey, o_orderkey % 5 = 0 AS true_only, o_orderkey % 5 IN (0, 2, 4) AS strict, o_orderkey % 5 <> 3 AS false_only FROM orders"),
    "support_states": (support_states, sql("SELECT entity, year, nation AS context, CASE WHEN nation IN (SELECT nation FROM cells WHERE year < 1999) AND entity < 'Brand#3' THEN 'SUPPORTED' ELSE 'UNSUPPORTED' END AS state FROM cells WHERE year >= 1999", CELLS_SQL)),
    "forbidden_column_audit": (forbidden_column_audit, "SELECT name, contains(regexp_replace(lower(name), '[^a-z0-9]', '', 'g'), 'price') OR contains(lower(name), 'tax') AS forbidden, \"values\" FROM (" + " UNION ALL ".join(f"SELECT * FROM (UNPIVOT (SELECT count(COLUMNS(*)) AS '\\0' FROM {t}) ON COLUMNS(*) INTO NAME name VALUE \"values\")" for t in ("orders", "lineitem")) + ")"),
    "melted_grid": (melted_grid, sql("""g AS (SELECT entity, nation AS context, CAST(sum(replicates) AS BIGINT) AS replicates FROM cells WHERE nation IN ('NATION_1','NATION_2','NATION_3') GROUP BY ALL),
        f AS (SELECT e.entity, c.context, replicates FROM (SELECT DISTINCT entity FROM g) e CROSS JOIN (VALUES ('NATION_1'), ('NATION_2'), ('NATION_3')) c(context) LEFT JOIN g USING (entity, context))
        SELECT *, dense_rank() OVER (ORDER BY entity) - 1 AS entity_code, dense_rank() OVER (ORDER BY context) - 1 AS context_code FROM f""", CELLS_SQL + ",")),
    "finite_mask": (finite_mask, "SELECT event_type, count(*) AS n, round(avg(value::DECIMAL(18,6)::DOUBLE), 4) AS mean FROM events WHERE event_id % 7 <> 0 AND event_id % 11 <> 0 GROUP BY event_type"),
    "one_hot_segments": (one_hot_segments, "SELECT c_nationkey::BIGINT AS c_nationkey, " + ", ".join(f"CAST(max((c_mktsegment = '{s}')::INT) AS BIGINT) AS is_{s.lower()}" for s in ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")) + " FROM customer GROUP BY 1"),
    "missing_encodings": (missing_encodings, """WITH c AS (SELECT c_custkey, CASE WHEN c_custkey % 9 <> 0 THEN c_acctbal END AS b FROM customer), m AS (SELECT avg(b) AS m FROM c WHERE c_custkey % 2 = 0)
        SELECT c_custkey, round(coalesce(b, 0), 4) + 0 AS balance, (b IS NULL)::INT::DOUBLE AS balance_missing, round(coalesce(b, m), 4) + 0 AS imputed FROM c, m"""),
    "contract_violations": (contract_violations, """SELECT count(*) AS rows, count(*) FILTER (WHERE NOT l_quantity BETWEEN 1 AND 50) AS quantity, count(*) FILTER (WHERE NOT l_discount <= 0.05) AS discount,
        count(*) FILTER (WHERE l_returnflag NOT IN ('A', 'N')) AS flag, count(*) - count(DISTINCT (l_orderkey, l_linenumber)) AS repeated_keys FROM lineitem"""),
    "checked_cardinality": (checked_cardinality, sql("SELECT entity, CAST(sum(replicates) FILTER (WHERE year = 1999) AS BIGINT) AS a, CAST(sum(replicates) FILTER (WHERE year = 2000) AS BIGINT) AS b FROM cells GROUP BY entity HAVING a IS NOT NULL AND b IS NOT NULL", CELLS_SQL)),
    "referential_completeness": (referential_completeness, "SELECT c.c_custkey IS NOT NULL AS matched, count(*) AS rows FROM orders LEFT JOIN (SELECT c_custkey FROM customer WHERE c_custkey % 10 <> 0) c ON o_custkey = c_custkey GROUP BY 1"),
    "membership_by_key": (membership_by_key, sql("SELECT entity, context, entity <> 'Brand#1' AS present, CASE WHEN entity <> 'Brand#1' THEN round(observed, 7) END AS observed FROM predictions WHERE model = 'G+E' AND year = 2001", PREDICTIONS_SQL)),
    "missing_keys": (missing_keys, sql("SELECT entity, nation, CASE WHEN entity < 'Brand#2' THEN 'EARLY_BRAND' ELSE 'ABSENT_IN_1995' END AS reason FROM cells a WHERE year = 2001 AND NOT EXISTS (SELECT 1 FROM cells b WHERE b.year = 1995 AND replicates > 12 AND a.entity = b.entity AND a.nation = b.nation)", CELLS_SQL)),
    "paired_segments": (paired_segments, sql("""m AS (SELECT entity, nation, segment, CAST(sum(price) AS DOUBLE) / count(*) AS o FROM plots GROUP BY ALL)
        SELECT entity, nation, round(x.o, 7) AS a, round(y.o, 7) AS b, round(y.o - x.o, 6) + 0 AS difference FROM m x JOIN m y USING (entity, nation) WHERE x.segment = 'AUTOMOBILE' AND y.segment = 'BUILDING'""", PLOTS_SQL + ",")),
    "candidate_universe": (candidate_universe, sql(f"SELECT digest, rows AS pairs FROM ({S.seal_sql('SELECT e || chr(124) || x AS l FROM (SELECT DISTINCT entity AS e FROM cells WHERE year < 1997), (SELECT DISTINCT context AS x FROM cells WHERE year = 2001)')})", CELLS_SQL)),
    "scenario_grid": (scenario_grid, sql("""k AS (SELECT (dense_rank() OVER (ORDER BY entity) - 1) % 3 AS entity_fold, (dense_rank() OVER (ORDER BY context) - 1) % 3 AS context_fold FROM cells), c AS (SELECT entity_fold, context_fold, count(*) AS test FROM k GROUP BY ALL),
        p AS (SELECT a.entity_fold, a.context_fold, a.test, coalesce(sum(b.test), 0)::BIGINT AS train FROM c a LEFT JOIN c b ON a.entity_fold <> b.entity_fold AND a.context_fold <> b.context_fold GROUP BY ALL)
        SELECT alpha, gamma, entity_fold, context_fold, test, train, row_number() OVER (ORDER BY alpha, gamma, entity_fold, context_fold) AS scenario FROM p, (VALUES (0.1::DOUBLE), (1.0), (10.0)) a(alpha), (VALUES (0.5::DOUBLE), (1.0), (2.0)) g(gamma)""", CELLS_SQL + ",")),
    "interval_aggregate": (interval_aggregate, sql("""SELECT user_id, horizon, round(avg(v_mean),9) + 0 AS mean, round(min(v_min),9) + 0 AS low, round(max(v_max),9) + 0 AS high, round(sum(v_sum),9) + 0 AS total, count(*) AS days
        FROM daily JOIN firsts USING (user_id) CROSS JOIN (VALUES ('T1', 7), ('T2', 14)) h(horizon, k) WHERE date BETWEEN anchor AND anchor + k::INTEGER GROUP BY ALL""", FIRST_SQL)),
    "anchored_history": (anchored_history, """WITH o AS (SELECT o_custkey, o_orderdate::DATE AS date, o_totalprice::DECIMAL(12,2) AS p FROM orders), l AS (SELECT o_custkey, max(date) AS anchor FROM o GROUP BY 1),
        y AS (SELECT o_custkey, y AS year, coalesce(try_cast(y || strftime(anchor, '-%m-%d') AS DATE), CAST(y || strftime(anchor, '-%m-') || '28' AS DATE)) AS b FROM (SELECT *, unnest(range(year(anchor) - 3, year(anchor))) AS y FROM l))
        SELECT o_custkey, count(*) AS orders, count(DISTINCT year) AS years, CAST(sum(p) AS DOUBLE) AS total FROM y JOIN o USING (o_custkey) WHERE date BETWEEN b AND b + 60 GROUP BY 1"""),
    "nearest_purchase": (nearest_purchase, """WITH p AS (SELECT user_id, ts, min(event_id) AS p_id FROM events WHERE event_type = 'purchase' GROUP BY ALL)
        SELECT s.event_id, (SELECT p_id FROM p WHERE p.user_id = s.user_id ORDER BY abs(epoch_us(p.ts) - epoch_us(s.ts)), p.ts LIMIT 1) AS p_id FROM events s WHERE event_type = 'signup'"""),
    "nearest_vectors": (nearest_vectors, """WITH k AS (SELECT a.vec_id, b.vec_id AS i, list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[])**2 AS d, row_number() OVER (PARTITION BY a.vec_id ORDER BY list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), b.vec_id) AS k
        FROM embeddings a JOIN embeddings b ON a.label >= 5 AND b.label < 5) SELECT vec_id, arg_min(i, k) AS nearest, round(min(d), 4) AS nearest_sq, round(avg(d), 4) AS mean_k_sq FROM k WHERE k <= 5 GROUP BY vec_id"""),
    "great_circle": (great_circle, """WITH p AS (SELECT n_nationkey::BIGINT AS k, n_nationkey * 7 % 90 - 45.0::DOUBLE AS lat, n_nationkey * 31 % 180 - 90.0::DOUBLE AS lon FROM nation)
        SELECT a.k, round(min(2*6371.0088*asin(sqrt(least(1, greatest(0, sin((radians(b.lat)-radians(a.lat))/2)**2 + cos(radians(a.lat))*cos(radians(b.lat))*sin(radians(b.lon-a.lon)/2)**2))))), 3) AS km FROM p a JOIN p b ON b.k < a.k GROUP BY a.k"""),
    "context_contrasts": (context_contrasts, sql("SELECT x.context AS a, y.context AS b, count(*) AS n, round(avg(y.observed - x.observed), 4) + 0 AS mean_diff, round(avg(abs(y.observed - x.observed)), 4) AS mean_abs_diff FROM cells x JOIN cells y USING (entity) WHERE x.context < y.context AND x.nation IN ('NATION_1','NATION_2') AND y.nation IN ('NATION_1','NATION_2') GROUP BY ALL", CELLS_SQL)),
    "pairwise_residuals": (pairwise_residuals, sql("SELECT context, round(2 * var_samp(observed - predicted), 2) AS msed, count(*) AS n FROM predictions WHERE model = 'G+E' GROUP BY context", PREDICTIONS_SQL)),
    "assembled_cells": (assembled_cells, sql("s AS (SELECT nation, sum(replicates)::BIGINT AS support FROM cells GROUP BY nation), k AS (SELECT year, max(abs(observed - predicted)) AS lock FROM predictions WHERE model = 'G+E' GROUP BY year) SELECT entity, context, support, round(lock, 4) AS lock FROM predictions JOIN s USING (nation) JOIN k USING (year) WHERE model = 'G+E'", PREDICTIONS_SQL + ",")),
    "kernel_vector_product": (kernel_vector_product, sql("c AS (SELECT entity, sum(replicates)::DOUBLE AS coef, regexp_extract(entity, '([0-9]+)', 1)::DOUBLE AS b FROM cells GROUP BY ALL) SELECT t.entity AS test, round(sum(exp(-((t.b-c.b)**2)/50)*c.coef), 3) AS value FROM c t, c GROUP BY t.entity", CELLS_SQL + ",")),
    "union_of_sources": (union_of_sources, "SELECT segment, count(*) AS rows, count(name) AS named FROM (SELECT s_name AS name, NULL AS segment FROM supplier UNION ALL SELECT NULL, c_mktsegment FROM customer) GROUP BY segment"),
    "key_sets": (key_sets, """WITH a AS (SELECT DISTINCT c_nationkey::BIGINT AS k FROM customer), b AS (SELECT DISTINCT s_nationkey::BIGINT AS k FROM supplier)
        SELECT 'both' AS op, k FROM (FROM a INTERSECT FROM b) UNION ALL SELECT 'only_a', k FROM (FROM a EXCEPT FROM b) UNION ALL SELECT 'only_b', k FROM (FROM b EXCEPT FROM a) UNION ALL SELECT 'either', k FROM (FROM a UNION FROM b)"""),
    "set_equality": (set_equality, """WITH a AS (SELECT n_nationkey AS k FROM nation), b AS (SELECT DISTINCT s_nationkey AS k FROM supplier WHERE s_nationkey <> 3)
        SELECT count(*) FILTER (WHERE b.k IS NULL) AS missing, count(*) FILTER (WHERE a.k IS NULL) AS extra, count(*) FILTER (WHERE b.k IS NULL OR a.k IS NULL) = 0 AS equal FROM a FULL JOIN b ON a.k = b.k"""),
    "duplicate_keys": (duplicate_keys, "SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, count(*) AS copies FROM lineitem GROUP BY ALL HAVING count(*) > 1"),
    "feature_stacking": (feature_stacking, "SELECT vec_id, 4::BIGINT AS width, round(list_sum(e[1:4]), 4) + 0 AS stacked, round((e[1]+e[2])*(e[3]+e[4]), 4) + 0 AS product FROM (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings)"),
    "pivoted_models": (pivoted_models, sql("SELECT context, round(avg(predicted) FILTER (WHERE model = 'G'), 4) AS g_mean, round(avg(predicted) FILTER (WHERE model = 'E'), 4) AS e_mean FROM predictions GROUP BY context", PREDICTIONS_SQL)),
    "text_normalisation": (text_normalisation, "SELECT p_partkey, upper(p_brand) || '_XY' AS code, regexp_replace(lower(p_brand), '[^a-z0-9]', '', 'g') AS plain, regexp_full_match(p_brand, 'Brand#[0-9]+') AS full_match, split_part(p_brand, '#', 2) AS tail FROM part"),
    "years_in_text": (years_in_text, "SELECT o_orderkey, year(o_orderdate) AS found, year(o_orderdate) AS leading, NULL::BIGINT AS none FROM orders"),
    "joined_sets": (joined_sets, "SELECT c_nationkey::BIGINT AS c_nationkey, string_agg(DISTINCT c_mktsegment, '|' ORDER BY c_mktsegment) AS segments FROM customer GROUP BY 1"),
    "date_functions": (date_functions, """SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS iso, dayofyear(o_orderdate) AS doy, strftime(o_orderdate::DATE + 60, '%Y-%m-%d') AS plus60, datediff('day', DATE '1995-01-01', o_orderdate::DATE) AS days,
        CASE WHEN o_orderkey % 3 < 2 THEN strftime(o_orderdate, '%Y-%m-%d') END AS parsed, round(sin(2*pi()*dayofyear(o_orderdate)/365.25), 4) + 0 AS sin, round(cos(2*pi()*dayofyear(o_orderdate)/365.25), 4) + 0 AS cos FROM orders"""),
    "math_functions": (math_functions, """SELECT c_custkey, round(exp(x/10000), 4) AS e, round(ln(abs(x)+1), 4) AS l, round(sqrt(abs(x)), 4) AS q, sign(x)::DOUBLE AS sign, least(5000, greatest(0, x))::DOUBLE AS clipped, abs(x-1000) <= 500 AS near,
        round((abs(x)+1)/((abs(x)+1)**2+2), 6) AS f1, round((abs(x)+1)**2/((abs(x)+1)**2+2), 6) AS f2 FROM (SELECT c_custkey, c_acctbal AS x FROM customer)"""),
    "standardised": (standardised, "SELECT c_custkey, round((c_acctbal - m) / s, 4) + 0 AS z FROM customer, (SELECT avg(c_acctbal) AS m, stddev_pop(c_acctbal) AS s FROM customer WHERE c_custkey % 2 = 0)"),
    "array_summaries": (array_summaries, "SELECT vec_id, round(list_avg(a), 4) + 0 AS mean, round(list_median(a), 4) + 0 AS median, round(list_dot_product(a, b), 4) + 0 AS dot, round(list_distance(a, b)**2, 4) AS sq FROM (SELECT vec_id, embedding[1:12]::DOUBLE[] AS a, embedding[13:24]::DOUBLE[] AS b FROM embeddings)"),
    "json_columns": (json_columns, "SELECT event_id, (props->>'k')::BIGINT AS k, '{\"k\":' || (props->>'k') || '}' AS canonical FROM events"),
    "formatted_numbers": (formatted_numbers, "SELECT c_custkey, printf('%.2f', c_acctbal) AS two, printf('W%03d', c_custkey) AS id FROM customer"),
    "threshold_labels": (threshold_labels, sql("y AS (SELECT model, year, avg(abs(predicted-observed))/20000 AS c FROM predictions GROUP BY ALL) SELECT model, year, CASE WHEN c < 0.2 THEN 'LOW' WHEN c < 0.4 THEN 'MID' ELSE 'HIGH' END AS label, round(least(0.995, 0.9 + greatest(0, 0.9 - least(1, c))), 4) AS next_level FROM y", PREDICTIONS_SQL + ",")),
    "payload_sniffing": (payload_sniffing, "SELECT page_id, lower(ltrim(html[1:256])) LIKE '<!doctype html%' AS is_html, regexp_replace(url, '[?#].*$', '') AS clean, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS host FROM pages"),
    "evidence_claims": (evidence_claims, f"""WITH s AS (SELECT conv_id, flatten(list(list_transform({SIX('text')}, lambda x: x::DOUBLE))) AS ev FROM conversations WHERE role = 'user' GROUP BY conv_id),
        a AS (SELECT c.conv_id, turn, text, list_transform({SIX('text')}, lambda x: x::DOUBLE) AS cl, coalesce(ev, []) AS ev FROM conversations c LEFT JOIN s USING (conv_id) WHERE role <> 'user')
        SELECT conv_id, turn, len(cl) AS numbers, len(list_filter(cl, lambda c: len(list_filter(ev, lambda e: abs(c - e) <= 1e-6)) = 0)) AS untraceable,
        contains(lower(text), 'the ')::BIGINT + contains(lower(text), 'certainly')::BIGINT + contains(lower(text), 'always')::BIGINT AS phrases FROM a"""),
}
