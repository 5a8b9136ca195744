"""The library's vocabulary bound to the driver's tables: cells, forward predictions, daily series, support points.

An *entity* is a brand, a *context* a nation in a year, an observation the mean price of a cell.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

FIRST_TEST_YEAR = 1997


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r(c: Column | str, name: str, digits: int = 4) -> Column:
    """A float output, rounded: engines add in different orders."""
    c = F.col(c) if isinstance(c, str) else c
    return (F.round(c, digits) + F.lit(0.0)).alias(name)


def n(c: Column | str, name: str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return c.cast("long").alias(name)


def plots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per replicate: entity, context, nation, year, segment, price. Dimensions are small; Spark sizes the joins."""
    t = lambda name: load(spark, sf_dir, name)
    lines = t("lineitem").select("l_orderkey", "l_partkey", F.col("l_extendedprice").cast("decimal(12,2)").alias("price"), "l_quantity")
    orders = t("orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey", F.year("o_orderdate").cast("long").alias("year"))
    customers = t("customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey", F.col("c_mktsegment").alias("segment"))
    nations = t("nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("nation"))
    parts = t("part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("entity"))
    joined = lines.join(orders, "l_orderkey").join(customers, "o_custkey").join(nations, "c_nationkey").join(parts, "l_partkey")
    return joined.select("entity", F.concat_ws("-", "year", "nation").alias("context"), "nation", "year", "segment", "price", "l_quantity")


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    from hindcast.operators.aggregates import collapse_replicates

    return collapse_replicates(plots(spark, sf_dir), ["entity", "context", "nation", "year"], "price")


PLOTS_SQL = """plots AS (
  SELECT p_brand AS entity, year(o_orderdate) || '-' || n_name AS context, n_name AS nation, CAST(year(o_orderdate) AS BIGINT) AS year,
         c_mktsegment AS segment, CAST(l_extendedprice AS DECIMAL(12,2)) AS price, l_quantity
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
  JOIN nation ON c_nationkey = n_nationkey JOIN part ON l_partkey = p_partkey)"""
CELLS_SQL = (
    PLOTS_SQL
    + """,
cells AS (SELECT entity, context, nation, year, CAST(sum(price) AS DOUBLE) / count(*) AS observed, count(*) AS replicates
  FROM plots GROUP BY entity, context, nation, year)"""
)


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(model, entity, context, nation, year, observed, predicted): means over strictly earlier years."""
    from hindcast.operators.windows import prior_mean
    from hindcast.sources.scratch import stored

    # cells are few beside plots, and each mean reads them twice
    base = stored(cells(spark, sf_dir), "cells")
    base = prior_mean(base, ["entity"], "year", "observed", "g")
    base = prior_mean(base, ["nation"], "year", "observed", "e")
    base = prior_mean(base, [], "year", "observed", "m")
    g, e, m = F.coalesce("g", "m"), F.coalesce("e", "m"), F.col("m")
    rows = F.array(*[F.struct(F.lit(k).alias("model"), v.alias("predicted")) for k, v in (("Mean", m), ("G", g), ("E", e), ("G+E", g + e - m))])
    keep = ["entity", "context", "nation", "year", "observed"]
    return base.where(F.col("year") >= FIRST_TEST_YEAR).select(*keep, F.explode(rows).alias("p")).select("p.model", *keep, "p.predicted")


PREDICTIONS_SQL = (
    CELLS_SQL
    + f""",
gy AS (SELECT entity, year, sum(observed) AS s, count(*) AS c FROM cells GROUP BY ALL),
ey AS (SELECT nation, year, sum(observed) AS s, count(*) AS c FROM cells GROUP BY ALL),
my AS (SELECT year, sum(observed) AS s, count(*) AS c FROM cells GROUP BY ALL),
g AS (SELECT a.entity, a.year, sum(b.s) / sum(b.c) AS g FROM gy a JOIN gy b ON a.entity = b.entity AND b.year < a.year GROUP BY ALL),
e AS (SELECT a.nation, a.year, sum(b.s) / sum(b.c) AS e FROM ey a JOIN ey b ON a.nation = b.nation AND b.year < a.year GROUP BY ALL),
m AS (SELECT a.year, sum(b.s) / sum(b.c) AS m FROM my a JOIN my b ON b.year < a.year GROUP BY ALL),
wide AS (SELECT c.entity, c.context, c.nation, c.year, c.observed, coalesce(g, m) AS g, coalesce(e, m) AS e, m
  FROM cells c JOIN m ON c.year = m.year LEFT JOIN g ON c.entity = g.entity AND c.year = g.year
  LEFT JOIN e ON c.nation = e.nation AND c.year = e.year WHERE c.year >= {FIRST_TEST_YEAR}),
predictions AS (
  SELECT 'Mean' AS model, entity, context, nation, year, observed, m AS predicted FROM wide
  UNION ALL SELECT 'G', entity, context, nation, year, observed, g FROM wide
  UNION ALL SELECT 'E', entity, context, nation, year, observed, e FROM wide
  UNION ALL SELECT 'G+E', entity, context, nation, year, observed, g + e - m FROM wide)"""
)


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily series per user: date, mean, least, largest and sum of value, rows."""
    e = load(spark, sf_dir, "events").select("user_id", F.to_date("ts").alias("date"), F.col("value").cast("decimal(18,6)").alias("v"))
    return e.groupBy("user_id", "date").agg((F.sum("v").cast("double") / F.count("v")).alias("v_mean"), F.min("v").cast("double").alias("v_min"), F.max("v").cast("double").alias("v_max"), F.sum("v").cast("double").alias("v_sum"), F.count("v").alias("rows"))


DAILY_SQL = """daily AS (SELECT user_id, CAST(ts AS DATE) AS date, CAST(sum(v) AS DOUBLE) / count(v) AS v_mean, CAST(min(v) AS DOUBLE) AS v_min,
  CAST(max(v) AS DOUBLE) AS v_max, CAST(sum(v) AS DOUBLE) AS v_sum, count(v) AS rows
  FROM (SELECT *, CAST(value AS DECIMAL(18,6)) AS v FROM events) GROUP BY ALL)"""


def window(*keys: str):
    return Window.partitionBy(*keys)
