"""Queries over retention, smallest rows, look-ups, reproduction and the lock of a bundle."""

from __future__ import annotations

from pyspark.sql import functions as F

from hindcast.operators import aggregates as A
from hindcast.operators import audits as U
from hindcast.operators import windows as W
from hindcast.sources.scratch import shared_path, stored

from .bindings import PREDICTIONS_SQL, load, n, predictions, r

REMOVED = (0.0, 0.05, 0.1, 0.2)


def selective_risk(spark, d):
    """Errors of what stays when each year's riskiest cells are put aside; risk is how far a forecast lies from 15,000, in thousands."""
    p = predictions(spark, d).where("model = 'G+E'").withColumn("risk", F.floor(F.abs(F.col("predicted") - 15000) / 1000))
    out = U.retained_by_risk(p, ["year"], "risk", ["entity", "context"], REMOVED)
    e = F.col("predicted") - F.col("observed")
    return out.groupBy("year", "removed").agg(n(F.count(F.lit(1)), "retained"), r(F.max("risk").cast("double"), "largest"), r(F.sqrt(F.avg(e * e)), "rmse"))


def smallest_balances(spark, d):
    """The five least balances of each nation, and the mean of all up to each."""
    c = load(spark, d, "customer").select("c_nationkey", "c_custkey", F.col("c_acctbal").cast("decimal(12,2)").alias("b"))
    out = U.smallest(c, ["c_nationkey"], ["b", "c_custkey"], 5)
    return out.select(n("c_nationkey", "nation"), n("place", "place"), "c_custkey", r(F.col("b").cast("double"), "balance", 2))


def looked_up_folds(spark, d):
    """Orders and turnover by fold; a customer's row and fold come from one table of places."""
    places = W.numbered(load(spark, d, "customer").select("c_custkey"), ["c_custkey"], "row").withColumn("fold", F.pmod("row", F.lit(5)))
    o = load(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), F.col("o_totalprice").cast("decimal(14,2)").alias("p"))
    out = U.looked_up(o, stored(places, "places"), "c_custkey", ["row", "fold"])
    return out.groupBy(n("fold", "fold")).agg(n(F.count(F.lit(1)), "orders"), n(F.countDistinct("row"), "customers"), r(F.sum("p").cast("double"), "turnover", 2))


def reproduced_metrics(spark, d):
    """Yearly errors against the ones stored before with four places: none of 1997, those of 1998 in error by one per cent."""
    p = stored(predictions(spark, d), "predictions")
    m = A.regression_metrics(p, ["model", "year"]).select("model", "year", "rmse")
    e = F.col("predicted") - F.col("observed")
    sums = p.groupBy("model", "year", "context").agg(F.sum(e * e).alias("s"), F.count(F.lit(1)).alias("c")).groupBy("model", "year").agg(F.sqrt(F.sum("s") / F.sum("c")).alias("rmse"))
    path = shared_path(spark, "metrics")
    sums.where("year > 1997").withColumn("rmse", F.round(F.when(F.col("year") == 1998, F.col("rmse") * 1.01).otherwise(F.col("rmse")), 4)).write.json(path)
    out = U.reproduced(m, spark.read.schema("model string, year long, rmse double").json(path), ["model", "year"], "rmse", 1e-4)
    return out.select("model", "year", r("computed", "computed"), r("stored", "stored"), "state")


def encoder_bits(spark, d):
    """Rows of standardised balances that differ in any bit after a table, a text file and single precision."""
    c = load(spark, d, "customer").select("c_custkey", (F.col("c_acctbal").cast("double") / 7).alias("z"), (-F.col("c_acctbal").cast("double") / 3).alias("w"))
    path = shared_path(spark, "encoded")
    c.write.csv(path)
    trips = {"table": stored(c, "encoded"), "text": spark.read.schema(c.schema).csv(path), "single": c.select("c_custkey", F.col("z").cast("float").alias("z"), F.col("w").cast("float").alias("w"))}
    out = None
    for name, back in trips.items():
        one = U.bit_differences(c, back, ["c_custkey"], ["z", "w"]).select(F.lit(name).alias("trip"), "rows", "alone", "z", "w")
        out = one if out is None else out.union(one)
    return out


def data_lock(spark, d):
    """What the bundle of orders, customers and days of shipping holds."""
    records = load(spark, d, "orders").select(F.col("o_custkey").alias("entity"), F.to_date("o_orderdate").alias("context"), F.col("o_totalprice").alias("value"), F.year("o_orderdate").alias("year"))
    entities = load(spark, d, "customer").withColumnRenamed("c_custkey", "entity")
    ship = load(spark, d, "lineitem").groupBy(F.to_date("l_shipdate").alias("context"))
    contexts = ship.agg(F.sum(F.col("l_quantity").cast("decimal(12,2)")).alias("quantity"), F.max(F.when(F.col("l_tax") > 0.07, F.col("l_tax"))).alias("tax"), F.max(F.when(F.col("l_discount") > 0.08, F.col("l_discount"))).alias("discount"), F.max(F.lit(1)).alias("one"))
    out = U.data_lock(records, entities, contexts, "entity", "context", "value", "year")
    whole = ["records", "with_value", "record_entities", "entities", "shared_entities", "record_contexts", "contexts", "shared_contexts", "markers", "covariates", "varying", "first_year", "last_year"]
    return out.select(*[n(c, c) for c in whole], r("missing", "missing", 6))


LEVELS = " UNION ALL ".join(f"SELECT year, {x}::DOUBLE AS removed, count(*) AS n, quantile_cont(risk, {1 - x}) AS q, min(risk) AS least FROM p GROUP BY year" for x in REMOVED)
QUERIES = {
    "selective_risk": (selective_risk, f"""WITH {PREDICTIONS_SQL}, p AS (SELECT *, floor(abs(predicted - 15000) / 1000) AS risk FROM predictions WHERE model = 'G+E'), k AS ({LEVELS}),
        x AS (SELECT p.*, removed, n, q, least, row_number() OVER (PARTITION BY year, removed ORDER BY risk, entity, context) AS i FROM p JOIN k USING (year)), t AS (SELECT * FROM x WHERE removed = 0 OR CASE WHEN least < q THEN risk < q ELSE i <= greatest(1, round_even((1 - removed) * n, 0)) END)
        SELECT year, removed, count(*) AS retained, max(risk)::DOUBLE AS largest, round(sqrt(avg((predicted - observed)**2)), 4) AS rmse FROM t GROUP BY ALL"""),
    "smallest_balances": (smallest_balances, "SELECT c_nationkey::BIGINT AS nation, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal, c_custkey) AS place, c_custkey, round(c_acctbal, 2)::DOUBLE + 0 AS balance FROM customer QUALIFY place <= 5"),
    "looked_up_folds": (looked_up_folds, "WITH f AS (SELECT c_custkey, (row_number() OVER (ORDER BY c_custkey) - 1) % 5 AS fold FROM customer) SELECT fold, count(*) AS orders, count(DISTINCT c_custkey) AS customers, round(sum(o_totalprice::DECIMAL(14,2))::DOUBLE, 2) AS turnover FROM orders JOIN f ON o_custkey = c_custkey GROUP BY fold"),
    "reproduced_metrics": (reproduced_metrics, f"""WITH {PREDICTIONS_SQL}, mt AS (SELECT model, year, sqrt(avg((predicted - observed)**2)) AS rmse FROM predictions GROUP BY ALL)
        SELECT model, year, round(rmse, 4) AS computed, CASE WHEN year > 1997 THEN round(rmse * CASE WHEN year = 1998 THEN 1.01 ELSE 1 END, 4) END AS stored, CASE WHEN year <= 1997 THEN 'NOT_STORED' WHEN year = 1998 THEN 'DIFFERS' ELSE 'REPRODUCED' END AS state FROM mt"""),
    "encoder_bits": (encoder_bits, """WITH c AS (SELECT c_acctbal::DOUBLE / 7 AS z, -c_acctbal::DOUBLE / 3 AS w FROM customer) SELECT 'table' AS trip, count(*) AS rows, 0::BIGINT AS alone, 0::BIGINT AS z, 0::BIGINT AS w FROM c UNION ALL SELECT 'text', count(*), 0, 0, 0 FROM c
        UNION ALL SELECT 'single', count(*), 0, count(*) FILTER (WHERE z <> z::FLOAT::DOUBLE), count(*) FILTER (WHERE w <> w::FLOAT::DOUBLE) FROM c"""),
    "data_lock": (data_lock, """WITH c AS (SELECT l_shipdate::DATE AS k, max(l_tax) FILTER (WHERE l_tax > 0.07) AS t, max(l_discount) FILTER (WHERE l_discount > 0.08) AS g, sum(l_quantity::DECIMAL(12,2)) AS q FROM lineitem GROUP BY 1),
        m AS (SELECT count(*) AS n, CASE WHEN min(q) < max(q) THEN 1 - count(q) / count(*) END AS mq, CASE WHEN min(t) < max(t) THEN 1 - count(t) / count(*) END AS mt, CASE WHEN min(g) < max(g) THEN 1 - count(g) / count(*) END AS mg FROM c)
        SELECT (SELECT count(*) FROM orders) AS records, (SELECT count(o_totalprice) FROM orders) AS with_value, (SELECT count(DISTINCT o_custkey) FROM orders) AS record_entities, (SELECT count(*) FROM customer) AS entities,
          (SELECT count(DISTINCT o_custkey) FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer)) AS shared_entities, (SELECT count(DISTINCT o_orderdate::DATE) FROM orders) AS record_contexts, n AS contexts,
          (SELECT count(DISTINCT o_orderdate::DATE) FROM orders WHERE o_orderdate::DATE IN (SELECT k FROM c)) AS shared_contexts, 4::BIGINT AS markers, 4::BIGINT AS covariates, ((mq IS NOT NULL)::INT + (mt IS NOT NULL)::INT + (mg IS NOT NULL)::INT)::BIGINT AS varying,
          (SELECT year(min(o_orderdate)) FROM orders) AS first_year, (SELECT year(max(o_orderdate)) FROM orders) AS last_year,
          round((coalesce(mq, 0) + coalesce(mt, 0) + coalesce(mg, 0)) / nullif((mq IS NOT NULL)::INT + (mt IS NOT NULL)::INT + (mg IS NOT NULL)::INT, 0), 6) + 0 AS missing FROM m"""),
}
