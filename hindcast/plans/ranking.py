"""Ranking, window, top-k, split, support and decision queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hindcast.operators import aggregates as A
from hindcast.operators import relational as R
from hindcast.operators import windows as W

from .bindings import CELLS_SQL, PREDICTIONS_SQL, cells, load, n, predictions, r
from .metrics import INTERVALS_SQL, intervals

LEAST_CELLS = 125
#: rmse of each predictor in each test year: the ranking grid.
GRID_SQL = f"{PREDICTIONS_SQL}, grid AS (SELECT model, year, round(sqrt(avg((predicted-observed)*(predicted-observed))), 6) AS rmse FROM predictions GROUP BY ALL)"


def grid(spark, d) -> DataFrame:
    return A.regression_metrics(predictions(spark, d), ["model", "year"]).select("model", "year", F.round("rmse", 6).alias("rmse"))


def average_ranks(spark, d):
    c = cells(spark, d)
    return c.select("entity", "context", r(W.average_rank(["context"], "replicates"), "rank"), r(W.percentile_rank(["context"], "replicates"), "pct", 6))


def sequence_in_group(spark, d):
    c = load(spark, d, "customer")
    k = F.row_number().over(Window.partitionBy("c_mktsegment").orderBy("c_custkey"))
    return c.select("c_custkey", n(k, "seq"))


def quartile_by_rank(spark, d):
    c = cells(spark, d).withColumn("q", W.first_rank_quartile(["context"], "replicates", "entity"))
    return c.select("entity", "context", "q")


def retained_rows(spark, d):
    out = W.retain_fraction(cells(spark, d), ["year"], 0.1, "replicates", "context", "entity")
    return out.select("year", "context", "entity", n("replicates", "replicates"))


def adjacent_periods(spark, d):
    """Rankings of predictors in neighbouring years: rank correlation, mean rank shift, regret of the year before's best."""
    g = grid(spark, d).withColumn("rank", W.average_rank(["year"], "rmse"))
    nxt = g.select("model", (F.col("year") - 1).alias("year"), F.col("rank").alias("rank2"), F.col("rmse").alias("rmse2"))
    out = g.join(nxt, ["model", "year"]).groupBy("year").agg(
        A.pearson("rank", "rank2").alias("rho"), F.avg(F.abs(F.col("rank") - F.col("rank2"))).alias("shift"),
        (F.min_by("rmse2", F.struct("rmse", "model")) - F.min("rmse2")).alias("regret"), (F.min_by("model", F.struct("rmse", "model")) == F.min_by("model", F.struct("rmse2", "model"))).alias("same_best"),
    )
    return out.select("year", r("rho", "rho"), r("shift", "shift"), r("regret", "regret"), "same_best")


def mean_rank_steps(spark, d):
    g = grid(spark, d).withColumn("rank", W.average_rank(["year"], "rmse"))
    g = g.withColumn("step", W.mean_step(["model"], "year", "rank"))
    return g.groupBy("model").agg(r(F.avg("step"), "mean_step"))


def z_scored_series(spark, d):
    g = grid(spark, d).withColumn("z", W.z_score(["model"], "rmse"))
    w = Window.partitionBy("model").orderBy("year")
    g = g.withColumn("dz", F.col("z") - F.lag("z").over(w))
    return g.groupBy("model").agg(r(F.sqrt(F.avg(F.col("dz") * F.col("dz"))), "rms_change"), r(F.max("z"), "max_z"))


def change_from_previous(spark, d):
    prev = F.lag("rmse").over(Window.partitionBy("model").orderBy("year"))
    out = grid(spark, d).withColumn("delta", F.col("rmse") - prev).withColumn("pct", 100 * F.try_divide(F.col("rmse") - prev, prev))
    return out.select("model", "year", r("delta", "delta"), r("pct", "pct"))


def forward_predictions(spark, d):
    return predictions(spark, d).select("model", "entity", "context", r("predicted", "predicted"))


def leave_group_out_pool(spark, d):
    """Quantile of the errors of all other folds, for each fold; sums and counts of folds make the pool's size."""
    p = W.coded(predictions(spark, d).where("model = 'G+E'"), "nation", "rk").select(F.abs(F.col("observed") - F.col("predicted")).alias("err"), F.pmod("rk", F.lit(5)).cast("long").alias("fold"))
    folds = spark.range(5).select(F.col("id").alias("own"))
    # five folds: each error is in four pools
    pool = p.join(F.broadcast(folds), F.col("fold") != F.col("own"))
    out = A.finite_sample_quantile(pool, ["own"], "err", [0.9])
    return out.select(F.col("own").alias("fold"), n("n", "pool"), r("q", "q"))


def leave_one_out_means(spark, d):
    c = W.leave_one_out_mean(cells(spark, d), ["context"], "observed", "proxy")
    return c.select("entity", "context", r("proxy", "proxy"))


def reference_position(spark, d):
    c = cells(spark, d)
    out = W.position_in_reference(c.where("year = 2001").select("entity", "context", "nation", "observed"), c.where("year < 2001"), ["nation"], "observed", "position")
    return out.select("entity", "context", r("position", "position", 6))


def cumulative_share(spark, d):
    c = cells(spark, d).groupBy("nation").agg(F.sum("replicates").alias("s"))
    return c.select("nation", r(W.running_share([], "s", F.col("s").desc(), F.col("nation")), "share", 6))


def strategy_top_k(spark, d):
    """Ten best candidates by each of three strategies, ties by entity and context."""
    rows = intervals(spark, d).where("level = 0.9 and year = 2001")
    outs = []
    for name, score in (("exploit", F.col("predicted")), ("optimistic", F.col("predicted") + F.col("q")), ("cautious", F.col("predicted") - F.col("q"))):
        outs.append(rows.orderBy(F.round(score, 6).desc(), "entity", "context").limit(10).select(F.lit(name).alias("strategy"), "entity", "context", r(score, "score")))
    return outs[0].union(outs[1]).union(outs[2])


def best_model_per_year(spark, d):
    return grid(spark, d).groupBy("year").agg(F.min_by("model", F.struct("rmse", "model")).alias("best"), r(F.min("rmse"), "rmse"))


def risk_retention(spark, d):
    """Metrics of what stays when cells over a quantile of interval risk are put aside, at several fractions."""
    p = predictions(spark, d).where("model = 'G+E'").withColumn("risk", F.round(F.abs(F.col("predicted") - F.avg("predicted").over(Window.partitionBy("year"))), 6))
    w = Window.partitionBy("year").orderBy("risk", "entity", "context")
    p = p.withColumn("k", F.row_number().over(w)).withColumn("c", F.count(F.lit(1)).over(Window.partitionBy("year")))
    p = p.withColumn("kept", F.explode(F.array(*[F.lit(x) for x in (0.5, 0.75, 1.0)]))).where(F.col("k") <= F.ceil(F.col("kept") * F.col("c")))
    e = F.col("predicted") - F.col("observed")
    return p.groupBy("kept").agg(n(F.count(F.lit(1)), "n"), r(F.sqrt(F.avg(e * e)), "rmse"))


def sorted_by_size_of_change(spark, d):
    c = change_from_previous(spark, d).where("delta is not null")
    return c.orderBy(F.abs("delta").desc()).limit(5)


def first_per_customer(spark, d):
    o = load(spark, d, "orders").select("o_custkey", "o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"))
    return R.first_per_key(o, ["o_custkey"], "date", "o_orderkey")


def evenly_spaced_rows(spark, d):
    """Twenty evenly spaced parts, by position in key order."""
    p = W.numbered(load(spark, d, "part").select("p_partkey"), ["p_partkey"], "pos")
    m = p.agg(F.count(F.lit(1)).alias("m"))
    idx = spark.range(20)
    # one row and twenty rows
    want = idx.join(F.broadcast(m)).select(F.floor(F.col("id") * (F.col("m") - 1) / 19).cast("int").alias("pos"))
    return p.join(F.broadcast(want), "pos").select("p_partkey", n("pos", "pos"))


def split_roles(spark, d):
    """Rows per scenario and role of five designs: folds of entities, contexts held out, sparse mask, cold start, forward."""
    c = W.coded(W.coded(cells(spark, d), "entity", "g"), "context", "e")
    f = lambda x: F.pmod(F.col(x), F.lit(5))
    folds = spark.range(5).select(F.col("id").alias("s"))
    base = c.join(F.broadcast(folds))
    designs = {
        "CV-G": (f("g") == F.col("s"), f("g") != F.col("s")),
        "CV-E": (f("e") == F.col("s"), f("e") != F.col("s")),
        "CV-GE": ((f("g") == F.col("s")) & (f("e") == F.col("s")), (f("g") != F.col("s")) & (f("e") != F.col("s"))),
        "SPARSE": (F.pmod(F.col("g") + F.col("e"), F.lit(5)) == F.col("s"), F.pmod(F.col("g") + F.col("e"), F.lit(5)) != F.col("s")),
        "FORWARD": (F.col("year") == 1997 + F.col("s"), F.col("year") < 1997 + F.col("s")),
    }
    rows = F.array(*[F.struct(F.lit(k).alias("regime"), F.when(t, "test").when(x, "train").otherwise("unused").alias("role")) for k, (t, x) in designs.items()])
    return base.select("s", F.explode(rows).alias("x")).groupBy(F.col("x.regime").alias("regime"), F.col("s").alias("scenario"), F.col("x.role").alias("role")).agg(n(F.count(F.lit(1)), "rows"))


def group_or_global_interval(spark, d):
    """A group's own quantile if it rests on at least 5 contexts and LEAST_CELLS cells, else the global one.

    No nation of the driver's tables has more than LEAST_CELLS cells, where the study's rule asks for 200.
    """
    p = predictions(spark, d).where("model = 'G+E'").withColumn("err", F.abs(F.col("observed") - F.col("predicted")))
    g = A.finite_sample_quantile(p, ["nation"], "err", [0.9]).select("nation", F.col("q").alias("gq"))
    size = p.groupBy("nation").agg(F.countDistinct("context").alias("contexts"), F.count(F.lit(1)).alias("cells"))
    whole = A.finite_sample_quantile(p, [], "err", [0.9]).select(F.col("q").alias("wq"))
    # one row: the global quantile
    out = size.join(g, "nation").join(F.broadcast(whole))
    own = (F.col("contexts") >= 5) & (F.col("cells") >= LEAST_CELLS)
    return out.select("nation", n("cells", "cells"), F.when(own, "GROUP").otherwise("GLOBAL").alias("source"), r(F.when(own, F.col("gq")).otherwise(F.col("wq")), "q"))


def minimax_actions(spark, d):
    """World x action losses (year x predictor): worst loss, worst regret and whether an action is best in every world."""
    g = grid(spark, d).withColumn("best", F.min("rmse").over(Window.partitionBy("year")))
    out = g.groupBy("model").agg(F.max("rmse").alias("worst"), F.max(F.col("rmse") - F.col("best")).alias("regret"), F.every(F.abs(F.col("rmse") - F.col("best")) <= 1e-9).alias("identified"))
    everyone = Window.partitionBy()
    return out.select("model", r("worst", "worst_loss"), r("regret", "worst_regret"), "identified", (F.col("worst") == F.min("worst").over(everyone)).alias("minimax"), (F.col("regret") == F.min("regret").over(everyone)).alias("minimax_regret"))


def budget_selection(spark, d):
    """Mean and best response, hits over a threshold and diversity of the first k by prediction."""
    order = F.round("predicted", 6).desc(), F.col("entity"), F.col("context")
    best = predictions(spark, d).where("model = 'G+E' and year = 2001").orderBy(*order).limit(50)
    # the largest budget's rows
    p = best.withColumn("k", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order)))
    p = p.withColumn("budget", F.explode(F.array(*[F.lit(x) for x in (5, 10, 50)]))).where("k <= budget")
    out = p.groupBy("budget").agg(F.avg("observed").alias("mean"), F.max("observed").alias("best"), F.count_if(F.col("observed") > 60000).alias("hits"), F.countDistinct("entity").alias("entities"))
    return out.select(n("budget", "budget"), r("mean", "mean"), r("best", "best"), n("hits", "hits"), r(F.col("hits") / F.col("budget"), "hit_rate"), n("entities", "entities"))


def random_selection(spark, d):
    """What random selection of the same budgets gives on average, in closed form."""
    p = cells(spark, d).where("year = 2001")
    t = p.agg(F.avg("observed").alias("mean"), F.avg((F.col("observed") > 60000).cast("double")).alias("rate"), F.count(F.lit(1)).alias("n"))
    t = t.withColumn("budget", F.explode(F.array(*[F.lit(x) for x in (5, 10, 50)])))
    return t.select(n("budget", "budget"), r("mean", "mean"), r(F.col("budget") * F.col("rate"), "hits"), r(F.sqrt(F.col("budget") * F.col("rate") * (1 - F.col("rate")) * (F.col("n") - F.col("budget")) / (F.col("n") - 1)), "hits_sd"))


def decision_rules(spark, d):
    g = A.regression_metrics(predictions(spark, d), ["model"])
    ref = F.max(F.when(F.col("model") == "Mean", F.col("rmse"))).over(Window.partitionBy())
    rel = F.col("rmse") / ref
    return g.select("model", F.when(rel < 0.98, "PROMOTE").when(rel <= 1.02, "ADMIT").when(rel < 1.2, "BRANCH").otherwise("STOP").alias("decision"))


def transport_identity(spark, d):
    """Weighted sums of coverage under source and target weights of nations; the difference splits exactly."""
    p = predictions(spark, d).where("model = 'G+E'").withColumn("hit", (F.abs(F.col("observed") - F.col("predicted")) <= 8000).cast("double"))
    per = p.groupBy("nation").agg(F.avg(F.when(F.col("year") < 2000, F.col("hit"))).alias("fs"), F.avg(F.when(F.col("year") >= 2000, F.col("hit"))).alias("ft"), F.count_if(F.col("year") < 2000).alias("ns"), F.count_if(F.col("year") >= 2000).alias("nt"))
    w = Window.partitionBy()
    per = per.withColumn("ws", F.col("ns") / F.sum("ns").over(w)).withColumn("wt", F.col("nt") / F.sum("nt").over(w))
    out = per.agg(F.sum(F.col("fs") * (F.col("wt") - F.col("ws"))).alias("mix"), F.sum(F.col("wt") * (F.col("ft") - F.col("fs"))).alias("change"), (F.sum(F.col("wt") * F.col("ft")) - F.sum(F.col("ws") * F.col("fs"))).alias("total"), F.max(F.abs(F.col("ft") - F.col("fs"))).alias("sup"))
    return out.select(r("mix", "mix", 6), r("change", "change", 6), r("total", "total", 6), r("sup", "sup", 6), (F.abs(F.col("mix") + F.col("change") - F.col("total")) < 1e-12).alias("identity_holds"))


def bayes_risk(spark, d):
    """Mean squared error of the group mean under finer partitions: each split of the partition can only lower it."""
    c = cells(spark, d)
    outs = []
    for name, keys in (("none", []), ("nation", ["nation"]), ("nation_year", ["nation", "year"])):
        outs.append(c.groupBy(*keys).agg(F.count(F.lit(1)).alias("c"), F.var_pop("observed").alias("v")).agg(F.lit(name).alias("partition"), (F.sum(F.col("c") * F.col("v")) / F.sum("c")).alias("risk")))
    out = outs[0].union(outs[1]).union(outs[2])
    return out.select("partition", r("risk", "risk", 2))


RANK = lambda keys, v: f"rank() OVER (PARTITION BY {keys} ORDER BY {v}) + (count(*) OVER (PARTITION BY {keys}, {v}) - 1) / 2"
RM = "sqrt(avg((predicted-observed)*(predicted-observed)))"
QUERIES = {
    "average_ranks": (average_ranks, f"WITH {CELLS_SQL} SELECT entity, context, {RANK('context', 'replicates')} AS rank, round(({RANK('context', 'replicates')}) / count(*) OVER (PARTITION BY context), 6) AS pct FROM cells"),
    "sequence_in_group": (sequence_in_group, "SELECT c_custkey, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) AS seq FROM customer"),
    "quartile_by_rank": (quartile_by_rank, f"WITH {CELLS_SQL} SELECT entity, context, CAST(greatest(1, ceil(round((row_number() OVER (PARTITION BY context ORDER BY replicates, entity) - 1) * 4.0::DOUBLE / (count(*) OVER (PARTITION BY context) - 1), 9))) AS BIGINT) AS q FROM cells"),
    "retained_rows": (retained_rows, f"WITH {CELLS_SQL} SELECT year, context, entity, replicates FROM cells QUALIFY row_number() OVER (PARTITION BY year ORDER BY replicates, context, entity) <= ceil(round(0.1 * count(*) OVER (PARTITION BY year), 9))"),
    "adjacent_periods": (adjacent_periods, f"""WITH {GRID_SQL}, k AS (SELECT *, {RANK('year', 'rmse')} AS rk FROM grid), j AS (SELECT a.year, a.model, a.rk, b.rk AS rk2, a.rmse, b.rmse AS rmse2 FROM k a JOIN k b ON a.model = b.model AND b.year = a.year + 1)
        SELECT year, round(covar_pop(rk, rk2) / (stddev_pop(rk) * stddev_pop(rk2)), 4) + 0 AS rho, round(avg(abs(rk - rk2)), 4) AS shift, round(arg_min(rmse2, (rmse, model)) - min(rmse2), 4) AS regret, arg_min(model, (rmse, model)) = arg_min(model, (rmse2, model)) AS same_best FROM j GROUP BY year"""),
    "mean_rank_steps": (mean_rank_steps, f"WITH {GRID_SQL}, k AS (SELECT model, year, {RANK('year', 'rmse')} AS rk FROM grid) SELECT model, round(avg(s), 4) AS mean_step FROM (SELECT model, abs(rk - lag(rk) OVER (PARTITION BY model ORDER BY year)) AS s FROM k) GROUP BY model"),
    "z_scored_series": (z_scored_series, f"WITH {GRID_SQL}, z AS (SELECT model, year, (rmse - avg(rmse) OVER w) / stddev_samp(rmse) OVER w AS z FROM grid WINDOW w AS (PARTITION BY model)) SELECT model, round(sqrt(avg(dz*dz)), 4) AS rms_change, round(max(z), 4) AS max_z FROM (SELECT *, z - lag(z) OVER (PARTITION BY model ORDER BY year) AS dz FROM z) GROUP BY model"),
    "change_from_previous": (change_from_previous, f"WITH {GRID_SQL} SELECT model, year, round(rmse - lag(rmse) OVER w, 4) AS delta, round(100 * (rmse - lag(rmse) OVER w) / lag(rmse) OVER w, 4) AS pct FROM grid WINDOW w AS (PARTITION BY model ORDER BY year)"),
    "forward_predictions": (forward_predictions, f"WITH {PREDICTIONS_SQL} SELECT model, entity, context, round(predicted, 4) AS predicted FROM predictions"),
    "leave_group_out_pool": (leave_group_out_pool, f"""WITH {PREDICTIONS_SQL}, p AS (SELECT abs(observed-predicted) AS err, (dense_rank() OVER (ORDER BY nation) - 1) % 5 AS fold FROM predictions WHERE model = 'G+E'),
        k AS (SELECT f AS own, err, row_number() OVER (PARTITION BY f ORDER BY err) AS k, count(*) OVER (PARTITION BY f) AS c FROM p JOIN range(5) t(f) ON fold <> f) SELECT own AS fold, c AS pool, round(err, 4) AS q FROM k WHERE k = least(c, ceil(round((c + 1) * 0.9, 9)))"""),
    "leave_one_out_means": (leave_one_out_means, f"WITH {CELLS_SQL} SELECT entity, context, round(coalesce((sum(observed) OVER w - observed) / nullif(count(*) OVER w - 1, 0), (sum(observed) OVER () - observed) / (count(*) OVER () - 1)), 4) AS proxy FROM cells WINDOW w AS (PARTITION BY context)"),
    "reference_position": (reference_position, f"WITH {CELLS_SQL} SELECT t.entity, t.context, round(count(*) FILTER (WHERE q.observed <= t.observed) / count(*), 6) AS position FROM cells t JOIN cells q ON t.nation = q.nation AND q.year < 2001 WHERE t.year = 2001 GROUP BY ALL"),
    "cumulative_share": (cumulative_share, f"WITH {CELLS_SQL}, s AS (SELECT nation, sum(replicates) AS s FROM cells GROUP BY nation) SELECT nation, round(sum(s) OVER (ORDER BY s DESC, nation ROWS UNBOUNDED PRECEDING) / sum(s) OVER (), 6) AS share FROM s"),
    "strategy_top_k": (strategy_top_k, f"WITH {INTERVALS_SQL}, b AS (SELECT * FROM ints WHERE level = 0.9 AND year = 2001) " + " UNION ALL ".join(f"(SELECT '{k}' AS strategy, entity, context, round({x}, 4) AS score FROM b ORDER BY round({x}, 6) DESC, entity, context LIMIT 10)" for k, x in (("exploit", "predicted"), ("optimistic", "predicted + q"), ("cautious", "predicted - q")))),
    "best_model_per_year": (best_model_per_year, f"WITH {GRID_SQL} SELECT year, arg_min(model, (rmse, model)) AS best, round(min(rmse), 4) AS rmse FROM grid GROUP BY year"),
    "risk_retention": (risk_retention, f"""WITH {PREDICTIONS_SQL}, p AS (SELECT *, round(abs(predicted - avg(predicted) OVER (PARTITION BY year)), 6) AS risk FROM predictions WHERE model = 'G+E'),
        k AS (SELECT *, row_number() OVER (PARTITION BY year ORDER BY risk, entity, context) AS k, count(*) OVER (PARTITION BY year) AS c FROM p)
        SELECT kept, count(*) AS n, round({RM}, 4) AS rmse FROM k CROSS JOIN (VALUES (0.5::DOUBLE), (0.75), (1.0)) f(kept) WHERE k <= ceil(kept * c) GROUP BY kept"""),
    "sorted_by_size_of_change": (sorted_by_size_of_change, f"WITH {GRID_SQL}, x AS (SELECT model, year, round(rmse - lag(rmse) OVER w, 4) AS delta, round(100 * (rmse - lag(rmse) OVER w) / lag(rmse) OVER w, 4) AS pct FROM grid WINDOW w AS (PARTITION BY model ORDER BY year)) SELECT * FROM x WHERE delta IS NOT NULL ORDER BY abs(delta) DESC LIMIT 5"),
    "first_per_customer": (first_per_customer, "SELECT o_custkey, o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS date FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate::DATE, o_orderkey) = 1"),
    "evenly_spaced_rows": (evenly_spaced_rows, "WITH p AS (SELECT p_partkey, row_number() OVER (ORDER BY p_partkey) - 1 AS pos FROM part) SELECT p_partkey, pos FROM p WHERE pos IN (SELECT floor(i * ((SELECT count(*) FROM part) - 1) / 19)::BIGINT FROM range(20) t(i))"),
    "split_roles": (split_roles, f"""WITH {CELLS_SQL}, c AS (SELECT year, (dense_rank() OVER (ORDER BY entity) - 1) AS g, (dense_rank() OVER (ORDER BY context) - 1) AS e FROM cells), b AS (SELECT *, g % 5 AS gf, e % 5 AS ef FROM c, range(5) t(s)),
        x AS (SELECT 'CV-G' AS regime, s, CASE WHEN gf = s THEN 'test' ELSE 'train' END AS role FROM b UNION ALL SELECT 'CV-E', s, CASE WHEN ef = s THEN 'test' ELSE 'train' END FROM b
        UNION ALL SELECT 'CV-GE', s, CASE WHEN gf = s AND ef = s THEN 'test' WHEN gf <> s AND ef <> s THEN 'train' ELSE 'unused' END FROM b
        UNION ALL SELECT 'SPARSE', s, CASE WHEN (g + e) % 5 = s THEN 'test' ELSE 'train' END FROM b UNION ALL SELECT 'FORWARD', s, CASE WHEN year = 1997 + s THEN 'test' WHEN year < 1997 + s THEN 'train' ELSE 'unused' END FROM b)
        SELECT regime, s AS scenario, role, count(*) AS rows FROM x GROUP BY ALL"""),
    "group_or_global_interval": (group_or_global_interval, f"""WITH {PREDICTIONS_SQL}, p AS (SELECT nation, context, abs(observed-predicted) AS err FROM predictions WHERE model = 'G+E'),
        k AS (SELECT *, row_number() OVER (PARTITION BY nation ORDER BY err) AS k, count(*) OVER (PARTITION BY nation) AS c, row_number() OVER (ORDER BY err) AS wk, count(*) OVER () AS wc FROM p),
        w AS (SELECT err AS wq FROM k WHERE wk = least(wc, ceil(round((wc + 1) * 0.9, 9)))), s AS (SELECT nation, count(*) AS cells, count(DISTINCT context) AS x, max(err) FILTER (WHERE k = least(c, ceil(round((c + 1) * 0.9, 9)))) AS gq FROM k GROUP BY nation)
        SELECT nation, cells, CASE WHEN x >= 5 AND cells >= {LEAST_CELLS} THEN 'GROUP' ELSE 'GLOBAL' END AS source, round(CASE WHEN x >= 5 AND cells >= {LEAST_CELLS} THEN gq ELSE wq END, 4) AS q FROM s, w"""),
    "minimax_actions": (minimax_actions, f"""WITH {GRID_SQL}, b AS (SELECT *, min(rmse) OVER (PARTITION BY year) AS best FROM grid), a AS (SELECT model, max(rmse) AS w, max(rmse - best) AS g, bool_and(abs(rmse - best) <= 1e-9) AS identified FROM b GROUP BY model)
        SELECT model, round(w, 4) AS worst_loss, round(g, 4) AS worst_regret, identified, w = min(w) OVER () AS minimax, g = min(g) OVER () AS minimax_regret FROM a"""),
    "budget_selection": (budget_selection, f"""WITH {PREDICTIONS_SQL}, k AS (SELECT *, row_number() OVER (ORDER BY round(predicted, 6) DESC, entity, context) AS k FROM predictions WHERE model = 'G+E' AND year = 2001)
        SELECT budget, round(avg(observed), 4) AS mean, round(max(observed), 4) AS best, count(*) FILTER (WHERE observed > 60000) AS hits, round(count(*) FILTER (WHERE observed > 60000) / budget, 4) AS hit_rate, count(DISTINCT entity) AS entities FROM k CROSS JOIN (VALUES (5::BIGINT), (10), (50)) b(budget) WHERE k <= budget GROUP BY budget"""),
    "random_selection": (random_selection, f"""WITH {CELLS_SQL}, t AS (SELECT avg(observed) AS m, avg((observed > 60000)::INT) AS p, count(*) AS n FROM cells WHERE year = 2001)
        SELECT budget, round(m, 4) AS mean, round(budget * p, 4) AS hits, round(sqrt(budget * p * (1 - p) * (n - budget) / (n - 1)), 4) AS hits_sd FROM t CROSS JOIN (VALUES (5::BIGINT), (10), (50)) b(budget)"""),
    "decision_rules": (decision_rules, f"WITH {PREDICTIONS_SQL}, per AS (SELECT model, {RM} AS rmse FROM predictions GROUP BY model), x AS (SELECT model, rmse / (SELECT rmse FROM per WHERE model = 'Mean') AS rel FROM per) SELECT model, CASE WHEN rel < 0.98 THEN 'PROMOTE' WHEN rel <= 1.02 THEN 'ADMIT' WHEN rel < 1.2 THEN 'BRANCH' ELSE 'STOP' END AS decision FROM x"),
    "transport_identity": (transport_identity, f"""WITH {PREDICTIONS_SQL}, p AS (SELECT nation, avg((abs(observed-predicted) <= 8000)::INT) FILTER (WHERE year < 2000) AS fs, avg((abs(observed-predicted) <= 8000)::INT) FILTER (WHERE year >= 2000) AS ft, count(*) FILTER (WHERE year < 2000) AS ns, count(*) FILTER (WHERE year >= 2000) AS nt FROM predictions WHERE model = 'G+E' GROUP BY nation),
        w AS (SELECT *, ns / sum(ns) OVER () AS ws, nt / sum(nt) OVER () AS wt FROM p) SELECT round(sum(fs*(wt-ws)), 6) + 0 AS mix, round(sum(wt*(ft-fs)), 6) + 0 AS change, round(sum(wt*ft) - sum(ws*fs), 6) + 0 AS total, round(max(abs(ft-fs)), 6) AS sup, true AS identity_holds FROM w"""),
    "bayes_risk": (bayes_risk, f"WITH {CELLS_SQL} " + " UNION ALL ".join(f"SELECT '{k}' AS partition, round(sum(c * v) / sum(c), 2) AS risk FROM (SELECT count(*) AS c, var_pop(observed) AS v FROM cells {g})" for k, g in (("none", ""), ("nation", "GROUP BY nation"), ("nation_year", "GROUP BY nation, year")))),
}
