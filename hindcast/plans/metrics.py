"""Metric, coverage, interval and decomposition queries over forward predictions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hindcast.operators import aggregates as A
from hindcast.operators import windows as W
from hindcast.sources.scratch import stored

from .bindings import CELLS_SQL, PLOTS_SQL, PREDICTIONS_SQL, cells, n, plots, predictions, r

LEVELS = (0.8, 0.9, 0.95)
BUNDLE = ["rmse", "mae", "bias", "r2", "pearson"]
METRICS_SQL = """count(*) AS n, round(sqrt(avg((predicted-observed)*(predicted-observed))),4) AS rmse, round(avg(abs(predicted-observed)),4) AS mae,
  round(avg(predicted-observed),4) + 0 AS bias, round(CASE WHEN var_pop(observed)>0 THEN 1-avg((predicted-observed)*(predicted-observed))/var_pop(observed) END,4) + 0 AS r2,
  round(CASE WHEN count(*)>=3 AND stddev_pop(observed)*stddev_pop(predicted)>1e-9 THEN covar_pop(observed,predicted)/(stddev_pop(observed)*stddev_pop(predicted)) END,4) AS pearson"""


def bundle(df: DataFrame, *keys: str) -> DataFrame:
    out = A.regression_metrics(df, keys)
    # a predictor that is constant in a slice has no correlation; its sd is rounding noise
    flat = df.groupBy(*keys).agg((F.stddev_pop("predicted") * F.stddev_pop("observed") <= 1e-9).alias("_flat"))
    out = out.join(flat, list(keys)).withColumn("pearson", F.when(~F.col("_flat"), F.col("pearson")))
    return out.select(*keys, n("n", "n"), *[r(c, c) for c in BUNDLE])


def intervals(spark, d) -> DataFrame:
    """Forward intervals of the G+E predictor: per test year and level, the quantile of strictly earlier absolute errors."""
    return with_intervals(forward_errors(spark, d))


def forward_errors(spark, d) -> DataFrame:
    """Predictions of G+E with their absolute errors, written once, as several passes read them."""
    return stored(predictions(spark, d).where("model = 'G+E'").withColumn("err", F.abs(F.col("observed") - F.col("predicted"))), "errors")


def with_intervals(p: DataFrame) -> DataFrame:
    q = A.prior_quantile(p, "year", "err", LEVELS, "year").where("periods >= 2").select("year", "level", "q")
    # as many rows as years and levels
    return p.join(F.broadcast(q), "year")


INTERVALS_SQL = (
    PREDICTIONS_SQL
    + """,
ge AS (SELECT *, abs(observed - predicted) AS err FROM predictions WHERE model = 'G+E'),
pool AS (SELECT t.year AS test_year, p.year, p.err FROM ge p JOIN (SELECT DISTINCT year FROM ge) t ON p.year < t.year),
ranked AS (SELECT *, row_number() OVER (PARTITION BY test_year ORDER BY err) AS k, count(*) OVER (PARTITION BY test_year) AS c FROM pool),
history AS (SELECT test_year, count(DISTINCT year) AS years FROM pool GROUP BY test_year),
quant AS (SELECT r.test_year AS year, level, err AS q FROM ranked r JOIN history USING (test_year) CROSS JOIN (VALUES (0.8::DOUBLE), (0.9::DOUBLE), (0.95::DOUBLE)) l(level)
  WHERE years >= 2 AND k = least(c, greatest(1, ceil(round((c + 1) * level, 9))))),
ints AS (SELECT g.*, level, q FROM ge g JOIN quant USING (year))"""
)


def forward_interval_coverage(spark, d):
    errors = forward_errors(spark, d)
    rows = with_intervals(errors).withColumn("hit", (F.col("err") <= F.col("q")).cast("double"))
    per = rows.groupBy("year", "level", "context").agg(F.avg("hit").alias("m"), F.sum("hit").alias("s"), F.count(F.lit(1)).alias("c"), F.max("q").alias("q"))
    out = per.groupBy("year", "level").agg(F.sum("c").alias("cells"), (F.sum("s") / F.sum("c")).alias("coverage"), F.avg("m").alias("balanced"), (2 * F.max("q")).alias("width"))
    known = out.select("year", "level", n("cells", "cells"), r("coverage", "coverage", 6), r("balanced", "balanced_coverage", 6), r("width", "width"), F.lit("CALIBRATED").alias("status"))
    short = errors.groupBy("year").agg(F.count(F.lit(1)).alias("cells")).join(out.select("year").distinct(), "year", "left_anti")
    none = short.select("year", F.lit(None).cast("double").alias("level"), n("cells", "cells"), *[F.lit(None).cast("double").alias(c) for c in ("coverage", "balanced_coverage", "width")], F.lit("INSUFFICIENT_CALIBRATION_HISTORY").alias("status"))
    return known.unionByName(none)


FORWARD_SQL = f"""WITH {INTERVALS_SQL},
per AS (SELECT year, level, context, avg((err <= q)::INT) AS m, sum((err <= q)::INT) AS s, count(*) AS c, max(q) AS q FROM ints GROUP BY ALL),
o AS (SELECT year, level, CAST(sum(c) AS BIGINT) AS cells, round(sum(s) / sum(c), 6) AS coverage, round(avg(m), 6) AS balanced_coverage, round(2 * max(q), 4) AS width, 'CALIBRATED' AS status FROM per GROUP BY ALL)
SELECT * FROM o UNION ALL
SELECT year, NULL, count(*), NULL, NULL, NULL, 'INSUFFICIENT_CALIBRATION_HISTORY' FROM ge WHERE year NOT IN (SELECT year FROM o) GROUP BY year"""


def replicate_collapse(spark, d):
    return cells(spark, d).select("entity", "context", r("observed", "observed", 7), n("replicates", "replicates"))


def descriptive_profile(spark, d):
    c = cells(spark, d)
    out = c.groupBy("nation").agg(*A.profile(c, "observed", "entity"))
    return out.select("nation", n("rows", "rows"), n("non_null", "non_null"), n("entities", "entities"), *[r(x, x) for x in ("mean", "sd", "median", "min", "max", "missing")])


def entity_summary(spark, d):
    out = plots(spark, d).groupBy("entity", "segment").agg(F.avg(F.col("price").cast("double")).alias("mean"), F.median(F.col("price").cast("double")).alias("median"), F.stddev_samp(F.col("price").cast("double")).alias("sd"), F.count(F.lit(1)).alias("n"))
    return out.select("entity", "segment", r("mean", "mean"), r("median", "median"), r("sd", "sd"), n("n", "n"))


def model_metrics(spark, d):
    return bundle(predictions(spark, d), "model")


def year_metrics(spark, d):
    return bundle(predictions(spark, d), "model", "year")


def context_metrics(spark, d):
    return bundle(predictions(spark, d), "model", "context")


def model_spearman(spark, d):
    out = A.spearman(predictions(spark, d).where("model in ('G', 'G+E')").withColumn("predicted", F.round("predicted", 6)), ["model", "year"], "observed", "predicted")
    return out.select("model", "year", n("n", "n"), r("spearman", "spearman"))


def fold_and_pooled_metrics(spark, d):
    p = W.coded(predictions(spark, d).where("model = 'G+E'"), "nation", "_code").withColumn("fold", F.pmod("_code", F.lit(5)).cast("long"))
    e = F.col("predicted") - F.col("observed")
    out = A.grouped_summaries(p, [["fold"], []], [F.count(F.lit(1)).alias("n"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae")])
    return out.select("fold", n("n", "n"), r("rmse", "rmse"), r("mae", "mae"))


def multi_level_summaries(spark, d):
    e = F.col("predicted") - F.col("observed")
    out = A.grouped_summaries(predictions(spark, d), [["model"], ["model", "nation"], ["model", "year"]], [F.count(F.lit(1)).alias("n"), F.sqrt(F.avg(e * e)).alias("rmse")])
    return out.select("model", "nation", "year", n("n", "n"), r("rmse", "rmse"))


def scoped_coverage(spark, d):
    rows = intervals(spark, d).withColumn("hit", (F.col("err") <= F.col("q")).cast("double"))
    out = A.grouped_summaries(rows, [["level"], ["level", "nation"]], [F.count(F.lit(1)).alias("n"), F.avg("hit").alias("coverage")], "POOLED")
    return out.select(F.col("level").cast("double").alias("level"), F.col("nation").alias("scope"), n("n", "n"), r("coverage", "coverage", 6))


def conditional_coverage(spark, d):
    """Coverage by support: whether the entity was seen in the nation in an earlier year. The outcome has no part in it."""
    first = cells(spark, d).groupBy("entity", "nation").agg(F.min("year").alias("first"))
    rows = intervals(spark, d).join(first, ["entity", "nation"]).withColumn("hit", (F.col("err") <= F.col("q")).cast("double"))
    rows = rows.withColumn("support", F.when(F.col("first") < F.col("year"), "SUPPORTED").otherwise("NEW"))
    out = rows.rollup("level", "support").agg(F.count(F.lit(1)).alias("n"), F.avg("hit").alias("coverage"), F.grouping("support").alias("g"), F.grouping("level").alias("h")).where("h = 0")
    return out.select("level", F.when(F.col("g") == 1, "ALL").otherwise(F.col("support")).alias("support"), n("n", "n"), r("coverage", "coverage", 6))


def balanced_error(spark, d):
    out = A.balanced_mean(predictions(spark, d), "context", F.abs(F.col("predicted") - F.col("observed")), ["model"])
    return out.select("model", r("balanced", "balanced"), r("weighted", "weighted"), n("groups", "groups"), n("n", "n"))


def conformal_quantiles(spark, d):
    p = predictions(spark, d).withColumn("err", F.abs(F.col("observed") - F.col("predicted")))
    out = A.finite_sample_quantile(p, ["model", "nation"], "err", LEVELS)
    return out.select("model", "nation", "level", n("n", "n"), r("q", "q"))


def interpolated_quantiles(spark, d):
    out = cells(spark, d).groupBy("nation").agg(*[F.percentile("observed", F.lit(q)).alias(f"p{int(1000 * q)}") for q in (0.01, 0.025, 0.5, 0.975, 0.99)])
    return out.select("nation", *[r(c, c, 6) for c in out.columns if c != "nation"])


def modal_segment(spark, d):
    out = A.mode_of(plots(spark, d), ["entity"], "segment")
    return out.select("entity", "mode", n("mode_count", "mode_count"))


def column_audit(spark, d):
    from .bindings import load

    c = load(spark, d, "customer")
    out = A.column_audit(c.select("c_name", F.col("c_nationkey").cast("string").alias("c_nationkey"), "c_mktsegment"), ["c_name", "c_nationkey", "c_mktsegment"])
    return out.select("covariate", n("rows", "rows"), n("non_null", "non_null"), r("missing", "missing"), n("distinct", "distinct"), "varies")


def key_overlap(spark, d):
    c = cells(spark, d)
    out = A.overlap(c.where("year < 1998").select("context"), c.where("year >= 1997").select("context"), "context")
    return out.select(*[n(x, x) for x in ("both", "only_left", "only_right")], r("left_covered", "left_covered", 6), r("right_covered", "right_covered", 6))


def state_crosstab(spark, d):
    c = plots(spark, d).withColumn("size_state", F.when(F.col("l_quantity") > 25, "LARGE").otherwise("SMALL"))
    out = c.groupBy("size_state", "segment").agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("entity").alias("entities"), F.countDistinct("context").alias("contexts"))
    return out.select("size_state", "segment", n("rows", "rows"), n("entities", "entities"), n("contexts", "contexts"))


def cluster_statistics(spark, d):
    p = predictions(spark, d)
    wide = p.groupBy("context", "entity", "observed").agg(F.max(F.when(F.col("model") == "Mean", F.col("predicted"))).alias("ref"), F.max(F.when(F.col("model") == "G+E", F.col("predicted"))).alias("cand"))
    out = A.cluster_statistics(wide, "context", [], "observed", "ref", "cand")
    return out.select("context", n("n", "n"), *[r(c, c, 2) for c in out.columns if c.startswith("s")])


def error_decomposition(spark, d):
    out = A.sse_decomposition(predictions(spark, d), "context", F.col("observed") - F.col("predicted"), ["model"])
    return out.select("model", r("bias_share", "bias_share", 6), r("within_share", "within_share", 6), "identity_holds")


def response_amplitude(spark, d):
    out = A.response_amplitude(predictions(spark, d).where("model = 'G+E'"), ["context"])
    return out.select("context", n("n", "n"), *[r(c, c) for c in ("sd_ratio", "slope", "slope_identity")], r("pairwise_msed", "pairwise_msed", 2))


def interval_scores(spark, d):
    rows = intervals(spark, d).where("level = 0.9")
    score = A.interval_score(F.col("observed"), F.col("predicted") - F.col("q"), F.col("predicted") + F.col("q"), 0.9)
    out = rows.groupBy("year").agg(F.avg(score).alias("score"), F.avg(2 * F.col("q")).alias("width"))
    return out.select("year", r("score", "score"), r("width", "width"))


def pooled_rmse(spark, d):
    per = A.regression_metrics(predictions(spark, d), ["model", "year"])
    out = per.groupBy("model").agg(A.pooled_rmse().alias("rmse"), F.sum("n").alias("n"))
    return out.select("model", r("rmse", "pooled_rmse"), n("n", "n"))


def quartile_conditional_means(spark, d):
    c = cells(spark, d)
    q = c.groupBy("nation").agg(F.percentile("observed", F.lit(0.25)).alias("q1"), F.percentile("observed", F.lit(0.75)).alias("q3"))
    out = c.join(q, "nation").groupBy("nation").agg(F.avg(F.when(F.col("observed") <= F.col("q1"), F.col("replicates"))).alias("low"), F.avg(F.when(F.col("observed") >= F.col("q3"), F.col("replicates"))).alias("high"))
    return out.select("nation", r("low", "low"), r("high", "high"), r(F.col("high") - F.col("low"), "difference"))


def association_stability(spark, d):
    """Correlation of replicates with observed: pooled, median of years, extremes with one year left out, sign stability."""
    c = cells(spark, d).withColumn("x", F.col("replicates").cast("double"))
    years = c.select(F.col("year").alias("held")).distinct()
    within = c.groupBy("year").agg(A.pearson("observed", "x").alias("rho")).agg(F.median("rho").alias("within_median"))
    left_out = c.join(F.broadcast(years), F.col("year") != F.col("held")).groupBy("held").agg(A.pearson("observed", "x").alias("rho")).agg(F.min("rho").alias("loo_min"), F.max("rho").alias("loo_max"))
    pooled = c.agg(A.pearson("observed", "x").alias("pooled"))
    one = [t.withColumn("_one", F.lit(1)) for t in (pooled, within, left_out)]
    out = one[0].join(one[1], "_one").join(one[2], "_one")
    return out.select(r("pooled", "pooled"), r("within_median", "within_median"), r("loo_min", "loo_min"), r("loo_max", "loo_max"), (F.signum("loo_min") == F.signum("loo_max")).alias("sign_stable"))


def yearly_summary(spark, d):
    p = predictions(spark, d).where("model = 'G+E'").withColumn("err", F.abs(F.col("observed") - F.col("predicted")))
    out = p.groupBy("year").agg(F.avg("err").alias("mean_err"), F.median("err").alias("median_err"), F.avg((F.col("err") > 5000).cast("double")).alias("share_large"))
    return out.select("year", r("mean_err", "mean_err"), r("median_err", "median_err"), r("share_large", "share_large", 6))


def waiting_value(spark, d):
    """How much rmse falls from one predictor to the next, absolute and in per cent."""
    per = A.regression_metrics(predictions(spark, d), ["model"])
    pick = lambda m: F.max(F.when(F.col("model") == m, F.col("rmse")))
    wide = per.agg(pick("Mean").alias("a"), pick("E").alias("b"), pick("G+E").alias("c"))
    pairs = wide.select(F.inline(F.array(*[F.struct(F.lit(k).alias("step"), x.alias("before"), y.alias("after")) for k, x, y in (("Mean->E", F.col("a"), F.col("b")), ("E->G+E", F.col("b"), F.col("c")))])))
    return pairs.select("step", r(F.col("after") - F.col("before"), "delta"), r(100 * (F.col("before") - F.col("after")) / F.col("before"), "improvement_pct"))


def instability(spark, d):
    per = A.regression_metrics(predictions(spark, d), ["model", "year"])
    out = per.groupBy("model").agg(F.min("rmse").alias("best"), F.max("rmse").alias("worst"), F.stddev_samp("rmse").alias("sd"), F.max_by("year", "rmse").alias("worst_year"))
    return out.select("model", r("best", "best"), r("worst", "worst"), r(F.col("worst") - F.col("best"), "range"), r("sd", "sd"), n("worst_year", "worst_year"))


QUERIES = {
    "forward_interval_coverage": (forward_interval_coverage, FORWARD_SQL),
    "replicate_collapse": (replicate_collapse, f"WITH {CELLS_SQL} SELECT entity, context, round(observed,7) AS observed, replicates FROM cells"),
    "descriptive_profile": (descriptive_profile, f"WITH {CELLS_SQL} SELECT nation, count(*) AS rows, count(observed) AS non_null, count(DISTINCT entity) AS entities, round(avg(observed),4) AS mean, round(stddev_samp(observed),4) AS sd, round(median(observed),4) AS median, round(min(observed),4) AS min, round(max(observed),4) AS max, round(1-count(observed)/count(*),4) AS missing FROM cells GROUP BY nation"),
    "entity_summary": (entity_summary, f"WITH {PLOTS_SQL} SELECT entity, segment, round(avg(price::DOUBLE),4) AS mean, round(median(price::DOUBLE),4) AS median, round(stddev_samp(price::DOUBLE),4) AS sd, count(*) AS n FROM plots GROUP BY ALL"),
    "model_metrics": (model_metrics, f"WITH {PREDICTIONS_SQL} SELECT model, {METRICS_SQL} FROM predictions GROUP BY model"),
    "year_metrics": (year_metrics, f"WITH {PREDICTIONS_SQL} SELECT model, year, {METRICS_SQL} FROM predictions GROUP BY model, year"),
    "context_metrics": (context_metrics, f"WITH {PREDICTIONS_SQL} SELECT model, context, {METRICS_SQL} FROM predictions GROUP BY model, context"),
    "model_spearman": (model_spearman, f"""WITH {PREDICTIONS_SQL}, k AS (SELECT model, year, rank() OVER (PARTITION BY model, year ORDER BY observed) + (count(*) OVER (PARTITION BY model, year, observed) - 1) / 2 AS rx,
        rank() OVER (PARTITION BY model, year ORDER BY round(predicted, 6)) + (count(*) OVER (PARTITION BY model, year, round(predicted, 6)) - 1) / 2 AS ry FROM predictions WHERE model IN ('G', 'G+E'))
        SELECT model, year, count(*) AS n, round(covar_pop(rx, ry) / (stddev_pop(rx) * stddev_pop(ry)), 4) AS spearman FROM k GROUP BY ALL"""),
    "fold_and_pooled_metrics": (fold_and_pooled_metrics, f"""WITH {PREDICTIONS_SQL}, f AS (SELECT *, (dense_rank() OVER (ORDER BY nation) - 1) % 5 AS fold FROM predictions WHERE model = 'G+E')
        SELECT CASE WHEN grouping(fold) = 1 THEN 'ALL' ELSE fold::VARCHAR END AS fold, count(*) AS n, round(sqrt(avg((predicted-observed)*(predicted-observed))),4) AS rmse, round(avg(abs(predicted-observed)),4) AS mae FROM f GROUP BY GROUPING SETS ((fold), ())"""),
    "multi_level_summaries": (multi_level_summaries, f"""WITH {PREDICTIONS_SQL} SELECT model, CASE WHEN grouping(nation) = 1 THEN 'ALL' ELSE nation END AS nation, CASE WHEN grouping(year) = 1 THEN 'ALL' ELSE year::VARCHAR END AS year,
        count(*) AS n, round(sqrt(avg((predicted-observed)*(predicted-observed))),4) AS rmse FROM predictions GROUP BY GROUPING SETS ((model), (model, nation), (model, year))"""),
    "scoped_coverage": (scoped_coverage, f"WITH {INTERVALS_SQL} SELECT level, CASE WHEN grouping(nation) = 1 THEN 'POOLED' ELSE nation END AS scope, count(*) AS n, round(avg((err <= q)::INT), 6) AS coverage FROM ints GROUP BY GROUPING SETS ((level), (level, nation))"),
    "conditional_coverage": (conditional_coverage, f"""WITH {INTERVALS_SQL}, y AS (SELECT entity, nation, min(year) AS first FROM cells GROUP BY ALL), s AS (SELECT ints.*, CASE WHEN first < year THEN 'SUPPORTED' ELSE 'NEW' END AS support FROM ints JOIN y USING (entity, nation))
        SELECT level, CASE WHEN grouping(support) = 1 THEN 'ALL' ELSE support END AS support, count(*) AS n, round(avg((err <= q)::INT), 6) AS coverage FROM s GROUP BY GROUPING SETS ((level), (level, support))"""),
    "balanced_error": (balanced_error, f"WITH {PREDICTIONS_SQL}, p AS (SELECT model, context, avg(abs(predicted-observed)) AS m, sum(abs(predicted-observed)) AS s, count(*) AS c FROM predictions GROUP BY ALL) SELECT model, round(avg(m),4) AS balanced, round(sum(s)/sum(c),4) AS weighted, count(*) AS groups, CAST(sum(c) AS BIGINT) AS n FROM p GROUP BY model"),
    "conformal_quantiles": (conformal_quantiles, f"""WITH {PREDICTIONS_SQL}, k AS (SELECT model, nation, abs(observed-predicted) AS err, row_number() OVER (PARTITION BY model, nation ORDER BY abs(observed-predicted)) AS k, count(*) OVER (PARTITION BY model, nation) AS n FROM predictions)
        SELECT model, nation, level, n, round(err,4) AS q FROM k CROSS JOIN (VALUES (0.8::DOUBLE), (0.9::DOUBLE), (0.95::DOUBLE)) l(level) WHERE k = least(n, greatest(1, ceil(round((n + 1) * level, 9))))"""),
    "interpolated_quantiles": (interpolated_quantiles, f"WITH {CELLS_SQL} SELECT nation, {', '.join(f'round(quantile_cont(observed, {q}),6) AS p{int(1000 * q)}' for q in (0.01, 0.025, 0.5, 0.975, 0.99))} FROM cells GROUP BY nation"),
    "modal_segment": (modal_segment, f"WITH {PLOTS_SQL}, c AS (SELECT entity, segment, count(*) AS c FROM plots GROUP BY ALL) SELECT entity, segment AS mode, c AS mode_count FROM c QUALIFY row_number() OVER (PARTITION BY entity ORDER BY c DESC, segment) = 1"),
    "column_audit": (column_audit, " UNION ALL ".join(f"SELECT '{c}' AS covariate, count(*) AS rows, count({c}) AS non_null, round(1-count({c})/count(*),4) AS missing, count(DISTINCT {c}) AS distinct, count(DISTINCT {c}) > 1 AS varies FROM customer" for c in ("c_name", "c_nationkey", "c_mktsegment"))),
    "key_overlap": (key_overlap, f"""WITH {CELLS_SQL}, a AS (SELECT DISTINCT context, 1 AS a FROM cells WHERE year < 1998), b AS (SELECT DISTINCT context, 1 AS b FROM cells WHERE year >= 1997)
        SELECT count(*) FILTER (WHERE a = 1 AND b = 1) AS both, count(*) FILTER (WHERE b IS NULL) AS only_left, count(*) FILTER (WHERE a IS NULL) AS only_right,
        round(count(*) FILTER (WHERE a = 1 AND b = 1) / count(a), 6) AS left_covered, round(count(*) FILTER (WHERE a = 1 AND b = 1) / count(b), 6) AS right_covered FROM a FULL JOIN b USING (context)"""),
    "state_crosstab": (state_crosstab, f"WITH {PLOTS_SQL} SELECT CASE WHEN l_quantity > 25 THEN 'LARGE' ELSE 'SMALL' END AS size_state, segment, count(*) AS rows, count(DISTINCT entity) AS entities, count(DISTINCT context) AS contexts FROM plots GROUP BY ALL"),
    "cluster_statistics": (cluster_statistics, f"""WITH {PREDICTIONS_SQL}, w AS (SELECT context, observed, m AS ref, g + e - m AS cand FROM wide)
        SELECT context, count(*) AS n, round(sum((ref-observed)*(ref-observed)),2) AS sse_reference, round(sum((cand-observed)*(cand-observed)),2) AS sse_candidate, round(sum(abs(ref-observed)),2) AS sae_reference, round(sum(abs(cand-observed)),2) AS sae_candidate FROM w GROUP BY context"""),
    "error_decomposition": (error_decomposition, f"""WITH {PREDICTIONS_SQL}, p AS (SELECT model, context, count(*) AS c, avg(observed-predicted) AS m, var_pop(observed-predicted) AS v, sum((observed-predicted)*(observed-predicted)) AS s FROM predictions GROUP BY ALL)
        SELECT model, round(sum(c*m*m)/sum(s),6) AS bias_share, round(sum(c*v)/sum(s),6) AS within_share, abs(sum(s)-sum(c*m*m)-sum(c*v)) <= 1e-9*sum(s) AS identity_holds FROM p GROUP BY model"""),
    "response_amplitude": (response_amplitude, f"""WITH {PREDICTIONS_SQL} SELECT context, count(*) AS n, round(stddev_samp(predicted)/stddev_samp(observed),4) AS sd_ratio, round(covar_pop(observed,predicted)/var_pop(predicted),4) AS slope,
        round(covar_pop(observed,predicted)/(stddev_pop(observed)*stddev_pop(predicted))*stddev_samp(observed)/stddev_samp(predicted),4) AS slope_identity, round(2*var_samp(observed-predicted),2) AS pairwise_msed FROM predictions WHERE model = 'G+E' GROUP BY context"""),
    "interval_scores": (interval_scores, f"""WITH {INTERVALS_SQL} SELECT year, round(avg(2*q + 2/(1-0.9)*(greatest(predicted-q-observed,0)+greatest(observed-predicted-q,0))),4) AS score, round(avg(2*q),4) AS width FROM ints WHERE level = 0.9 GROUP BY year"""),
    "pooled_rmse": (pooled_rmse, f"WITH {PREDICTIONS_SQL}, y AS (SELECT model, year, count(*) AS n, sqrt(avg((predicted-observed)*(predicted-observed))) AS rmse FROM predictions GROUP BY ALL) SELECT model, round(sqrt(sum(n*rmse*rmse)/sum(n)),4) AS pooled_rmse, CAST(sum(n) AS BIGINT) AS n FROM y GROUP BY model"),
    "quartile_conditional_means": (quartile_conditional_means, f"""WITH {CELLS_SQL}, q AS (SELECT nation, quantile_cont(observed, 0.25) AS q1, quantile_cont(observed, 0.75) AS q3 FROM cells GROUP BY nation)
        SELECT nation, round(avg(replicates) FILTER (WHERE observed <= q1),4) AS low, round(avg(replicates) FILTER (WHERE observed >= q3),4) AS high, round(avg(replicates) FILTER (WHERE observed >= q3) - avg(replicates) FILTER (WHERE observed <= q1),4) AS difference FROM cells JOIN q USING (nation) GROUP BY nation"""),
    "association_stability": (association_stability, f"""WITH {CELLS_SQL}, w AS (SELECT median(c) AS m FROM (SELECT year, covar_pop(observed, replicates)/(stddev_pop(observed)*stddev_pop(replicates)) AS c FROM cells GROUP BY year)),
        l AS (SELECT min(c) AS a, max(c) AS b FROM (SELECT h.year, covar_pop(observed, replicates)/(stddev_pop(observed)*stddev_pop(replicates)) AS c FROM cells x JOIN (SELECT DISTINCT year FROM cells) h ON x.year <> h.year GROUP BY h.year))
        SELECT round((SELECT covar_pop(observed, replicates)/(stddev_pop(observed)*stddev_pop(replicates)) FROM cells),4) AS pooled, round(m,4) AS within_median, round(a,4) AS loo_min, round(b,4) AS loo_max, sign(a) = sign(b) AS sign_stable FROM w, l"""),
    "yearly_summary": (yearly_summary, f"WITH {PREDICTIONS_SQL} SELECT year, round(avg(abs(observed-predicted)),4) AS mean_err, round(median(abs(observed-predicted)),4) AS median_err, round(avg((abs(observed-predicted) > 5000)::INT),6) AS share_large FROM predictions WHERE model = 'G+E' GROUP BY year"),
    "waiting_value": (waiting_value, f"""WITH {PREDICTIONS_SQL}, y AS (SELECT model, sqrt(avg((predicted-observed)*(predicted-observed))) AS rmse FROM predictions GROUP BY model),
        p AS (SELECT 'Mean->E' AS step, (SELECT rmse FROM y WHERE model='Mean') AS x, (SELECT rmse FROM y WHERE model='E') AS z UNION ALL SELECT 'E->G+E', (SELECT rmse FROM y WHERE model='E'), (SELECT rmse FROM y WHERE model='G+E'))
        SELECT step, round(z-x,4) AS delta, round(100*(x-z)/x,4) AS improvement_pct FROM p"""),
    "instability": (instability, f"""WITH {PREDICTIONS_SQL}, y AS (SELECT model, year, sqrt(avg((predicted-observed)*(predicted-observed))) AS rmse FROM predictions GROUP BY ALL)
        SELECT model, round(min(rmse),4) AS best, round(max(rmse),4) AS worst, round(max(rmse)-min(rmse),4) AS range, round(stddev_samp(rmse),4) AS sd, arg_max(year, rmse) AS worst_year FROM y GROUP BY model"""),
}
