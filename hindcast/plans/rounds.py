"""Queries of feedback rounds, cached scans and pruned nearest neighbours."""

from __future__ import annotations

from pyspark.sql import functions as F

from hindcast.operators import feedback as B
from hindcast.operators import relational as R
from hindcast.sources import cache
from hindcast.sources.scratch import shared_path, stored

from .bindings import DAILY_SQL, PREDICTIONS_SQL, daily, load, n, predictions, r

#: A prediction within this share of the observation covers it; coverage that an action owes in each world.
WITHIN, NOMINAL = 0.25, 0.5
#: Whether an action raises, keeps or lowers the forecast's detail.
DIRECTIONS = {"Mean": -1, "E": 0, "G": 0, "G+E": 1}


def context_worlds(spark, d):
    """Each context as a world that becomes known in its year, each model as an action; worlds that no action covers are left out."""
    p = predictions(spark, d)
    off = F.abs(F.col("predicted") - F.col("observed")) <= WITHIN * F.col("observed")
    per = p.groupBy("context", "year", F.col("model").alias("action")).agg(F.round(F.sqrt(F.avg(F.pow(F.col("predicted") - F.col("observed"), 2))), 2).alias("loss"), F.avg(off.cast("double")).alias("coverage"))
    per = stored(per, "worlds")
    held = per.where(F.col("coverage") >= NOMINAL).select("context").distinct()
    return per.join(held, "context", "left_semi")


def feedback_rounds(spark, d):
    """After each year: which models are identified as optimal, robust, and minimax, over the contexts known so far."""
    out = B.feedback_rounds(context_worlds(spark, d), "context", "year", "action", "loss", "coverage", NOMINAL, 1e-9)
    return out.select("round", "action", "identified", "robust", r("worst_loss", "worst_loss", 2), r("worst_regret", "worst_regret", 2), "minimax_loss", "minimax_regret")


def identified_actions(spark, d):
    """The identified set after each year, whether it is a point, and the directions that it leaves open."""
    rounds = B.feedback_rounds(context_worlds(spark, d), "context", "year", "action", "loss", "coverage", NOMINAL, 1e-9)
    out = B.identified_sets(rounds, DIRECTIONS)
    return out.select("round", F.array_join("actions", "|").alias("actions"), "point_identified", F.array_join(F.transform("directions", lambda x: x.cast("string")), "|").alias("directions"))


WORLDS_SQL = f"""{PREDICTIONS_SQL}, per AS (SELECT context, year AS round, model AS action, round(sqrt(avg((predicted - observed)**2)), 2) AS loss, avg((abs(predicted - observed) <= {WITHIN} * observed)::INT) AS coverage FROM predictions GROUP BY ALL),
        w AS (SELECT *, coverage >= {NOMINAL} AS feasible, min(CASE WHEN coverage >= {NOMINAL} THEN loss END) OVER (PARTITION BY context) AS best FROM per QUALIFY best IS NOT NULL),
        a AS (SELECT y.round, x.action, bool_or(x.feasible AND x.loss - x.best <= 1e-9) AS identified, bool_and(x.feasible) AS robust, max(x.loss) AS worst_loss, max(x.loss - x.best) AS worst_regret FROM (SELECT DISTINCT round FROM w) y JOIN w x ON x.round <= y.round GROUP BY ALL)"""


def cached_series(spark, d):
    """Series of nations' places through a cache: some places first, then all, so the second load fetches the rest alone; and a third none."""
    where = load(spark, d, "nation").select("n_nationkey", cache.place_key(F.col("n_nationkey") * 7 % 90 - 45, F.col("n_nationkey") * 31 % 180 - 90).alias("place"))
    series = stored(daily(spark, d).join(where, F.pmod("user_id", F.lit(25)) == F.col("n_nationkey")).groupBy("place", "date").agg(F.sum("v_sum").alias("total"), F.max("v_max").alias("most")), "series")
    fetch = lambda places: series.join(places, "place", "left_semi")
    path = shared_path(spark, "places")
    customers = load(spark, d, "customer").select(F.col("c_nationkey").alias("n_nationkey")).join(where, "n_nationkey")
    for wanted in (customers.where("n_nationkey % 3 = 0"), customers, customers):
        out = cache.scan_places(spark, wanted, fetch, path, ["total", "most"])
    audit = cache.audited(spark, path)
    loads = audit.agg(F.countDistinct("load").alias("loads"))
    per = out.groupBy("place").agg(F.count(F.lit(1)).alias("rows"), F.sum("total").alias("total"))
    # one row: how many loads there were
    return audit.join(per, "place", "left").join(F.broadcast(loads)).select("place", n("days", "days"), "first_date", "last_date", r("missing", "missing", 6), r("total", "total", 2), n("loads", "loads"))


def nearest_by_pivots(spark, d):
    """The nearest training vectors of each test vector, cells that cannot hold them left out."""
    e = load(spark, d, "embeddings")
    out = R.pruned_nearest(e.where("label >= 5"), e.where("label < 5"), "vec_id", "embedding")
    return out.select("vec_id", "nearest", r("nearest_sq", "nearest_sq"), r("mean_k_sq", "mean_k_sq"))


def nearest_places(spark, d):
    """For each customer's place the nearest supplier's, by great circle; places come of the keys."""
    place = lambda t, k, salt: load(spark, d, t).select(F.col(k).cast("long").alias("k"), ((F.col(k) * 7919 + salt) % 17_000 / 100.0 - 85).alias("lat"), ((F.col(k) * 104_729 + salt) % 35_900 / 100.0 - 179).alias("lon"))
    out = R.nearest_places(place("customer", "c_custkey", 11), place("supplier", "s_suppkey", 5_003), "k", "lat", "lon")
    return out.select("k", r("km", "km", 3))


PLACES_SQL = "(({k}::BIGINT * 7919 + {s}) % 17000 / 100.0 - 85) AS lat, (({k}::BIGINT * 104729 + {s}) % 35900 / 100.0 - 179) AS lon"

QUERIES = {
    "feedback_rounds": (feedback_rounds, f"""WITH {WORLDS_SQL}, b AS (SELECT *, min(CASE WHEN robust THEN worst_loss END) OVER (PARTITION BY round) AS bl, min(CASE WHEN robust THEN worst_regret END) OVER (PARTITION BY round) AS br FROM a)
        SELECT round, action, identified, robust, round(worst_loss, 2) AS worst_loss, round(worst_regret, 2) AS worst_regret, coalesce(robust AND worst_loss <= bl + 1e-9, false) AS minimax_loss, coalesce(robust AND worst_regret <= br + 1e-9, false) AS minimax_regret FROM b"""),
    "identified_actions": (identified_actions, f"""WITH {WORLDS_SQL}, k(action, way) AS (VALUES {", ".join(str(x) for x in DIRECTIONS.items())})
        SELECT round, string_agg(action, '|' ORDER BY action) AS actions, count(*) = 1 AS point_identified, array_to_string(list_sort(list_distinct(list(way))), '|') AS directions FROM a JOIN k USING (action) WHERE identified GROUP BY round"""),
    "cached_series": (cached_series, f"""WITH {DAILY_SQL}, p AS (SELECT n_nationkey AS k, printf('%.4f_%.4f', (n_nationkey * 7 % 90 - 45)::DOUBLE, (n_nationkey * 31 % 180 - 90)::DOUBLE) AS place FROM nation WHERE n_nationkey IN (SELECT c_nationkey FROM customer)),
        s AS (SELECT place, date, sum(v_sum) AS t FROM p LEFT JOIN daily ON user_id % 25 = k GROUP BY ALL)
        SELECT place, count(date) AS days, min(date)::VARCHAR AS first_date, max(date)::VARCHAR AS last_date, CASE WHEN count(date) > 0 THEN 0.0::DOUBLE END AS missing, round(sum(t), 2) AS total, 2::BIGINT AS loads FROM s GROUP BY place"""),
    "nearest_by_pivots": (nearest_by_pivots, """WITH k AS (SELECT a.vec_id, b.vec_id AS i, list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[])**2 AS d, row_number() OVER (PARTITION BY a.vec_id ORDER BY list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), b.vec_id) AS k
        FROM embeddings a JOIN embeddings b ON a.label >= 5 AND b.label < 5) SELECT vec_id, any_value(i) FILTER (WHERE k = 1) AS nearest, round(min(d), 4) AS nearest_sq, round(avg(d), 4) AS mean_k_sq FROM k WHERE k <= 5 GROUP BY vec_id"""),
    "nearest_places": (nearest_places, f"""WITH a AS (SELECT c_custkey::BIGINT AS k, {PLACES_SQL.format(k="c_custkey", s=11)} FROM customer), b AS (SELECT {PLACES_SQL.format(k="s_suppkey", s=5003)} FROM supplier)
        SELECT k, round(min(2 * 6371.0088 * asin(least(1, sqrt(sin(radians(b.lat - a.lat) / 2)**2 + cos(radians(a.lat)) * cos(radians(b.lat)) * sin(radians(b.lon - a.lon) / 2)**2)))), 3) + 0 AS km FROM a, b GROUP BY k"""),
}
