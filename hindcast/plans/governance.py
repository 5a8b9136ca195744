"""Seals, cohorts, audits, gates, cut-offs, streams and sources as queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from hindcast.functions import scalar as S
from hindcast.operators import aggregates as A
from hindcast.operators import relational as R
from hindcast.sources import readers
from hindcast.sources.scratch import shared_path, stored
from hindcast.streaming import events as E

from .bindings import DAILY_SQL, PREDICTIONS_SQL, cells, daily, load, n, predictions, r
from .metrics import INTERVALS_SQL, intervals

LINE = "entity || chr(31) || context || chr(31) || CAST(round(predicted, 3)::DECIMAL(18,3) AS VARCHAR)"


def sealed(spark, d):
    p = predictions(spark, d).where("model = 'G+E' and year = 2001")
    return p.select("entity", "context", F.round("predicted", 3).cast("decimal(18,3)").alias("predicted"))


def prediction_seal(spark, d):
    """Digest of a sealed table; shuffled rows give the same, a changed value does not."""
    p = stored(sealed(spark, d), "sealed")
    line = S.row_text("entity", "context", "predicted")
    own = S.seal(p, line)
    again = S.seal(p.repartition(7, F.xxhash64("context", "entity")), line).select(F.col("digest").alias("again"))
    first = p.agg(F.min(F.struct("entity", "context")).alias("least"))
    # one row: the cell whose value is changed
    other = p.join(F.broadcast(first)).withColumn("predicted", F.when(F.struct("entity", "context") == F.col("least"), F.col("predicted") + 1).otherwise(F.col("predicted")).cast("decimal(18,3)"))
    changed = S.seal(other, line).select(F.col("digest").alias("changed"))
    # one row each
    return own.join(F.broadcast(again)).join(F.broadcast(changed)).select("digest", n("rows", "rows"), (F.col("digest") == F.col("again")).alias("order_free"), (F.col("digest") != F.col("changed")).alias("tamper_seen"))


def observable_cohort(spark, d):
    """Of sealed cells, those whose key the answer has: a count by presence that values cannot change."""
    answer = cells(spark, d).where("year = 2001 and replicates >= 10").select("entity", "context", "observed")
    out = R.membership_join(sealed(spark, d), answer, ["entity", "context"], ["observed"])
    return out.groupBy("present").agg(n(F.count(F.lit(1)), "cells"), n(F.countDistinct("context"), "contexts"))


def reveal_scores(spark, d):
    rows = intervals(spark, d).where("level = 0.9 and year = 2001")
    e = F.col("predicted") - F.col("observed")
    hit = (F.abs(e) <= F.col("q")).cast("double")
    out = rows.groupBy("nation").agg(n(F.count(F.lit(1)), "n"), r(F.sqrt(F.avg(e * e)), "rmse"), r(F.avg(hit), "coverage", 6), (F.avg(hit) >= 0.85).alias("passes"))
    return out


def gate_check(spark, d):
    """The one-row table of frozen counts equals what the data give."""
    got = cells(spark, d).agg(n(F.countDistinct("entity"), "entities"), n(F.countDistinct("nation"), "nations"), n(F.countDistinct("year"), "years"))
    frozen = spark.createDataFrame([(25, 25, 7)], "entities long, nations long, years long")
    return got.exceptAll(frozen).agg((F.count(F.lit(1)) == 0).alias("holds"))


def reproduction_audit(spark, d):
    """Metrics from cells against metrics from per-context sums."""
    p = predictions(spark, d)
    a = A.regression_metrics(p, ["model"]).select("model", F.col("rmse").alias("a"))
    e = F.col("predicted") - F.col("observed")
    b = p.groupBy("model", "context").agg(F.sum(e * e).alias("s"), F.count(F.lit(1)).alias("c")).groupBy("model").agg(F.sqrt(F.sum("s") / F.sum("c")).alias("b"))
    return a.join(b, "model").select("model", S.close(F.col("a"), F.col("b"), 1e-8).alias("reproduced"))


def metadata_audit(spark, d):
    """Requested customers against their order dates: exactly one date, the median date, or a reason why not."""
    want = load(spark, d, "customer").select(F.col("c_custkey").alias("k"))
    have = load(spark, d, "orders").select(F.col("o_custkey").alias("k"), F.to_date("o_orderdate").alias("date"))
    per = have.groupBy("k").agg(F.countDistinct("date").alias("dates"), A.upper_median("date").alias("median"))
    out = want.join(per, "k", "left")
    reason = F.when(F.col("dates").isNull(), "NO_DATE").when(F.col("dates") == 1, "ONE_DATE").otherwise("SEVERAL_DATES")
    return out.select("k", reason.alias("reason"), F.date_format("median", "yyyy-MM-dd").alias("median_date"))


def conflicting_duplicates(spark, d):
    """Keys with more than one value, null counting as a value."""
    li = load(spark, d, "lineitem").withColumn("flag", F.nullif("l_returnflag", F.lit("R")))
    out = li.groupBy("l_orderkey", "l_linenumber").agg(F.size(F.collect_set(F.struct("flag"))).alias("values"), F.count(F.lit(1)).alias("rows"))
    return out.where("values > 1").select("l_orderkey", n("l_linenumber", "l_linenumber"), n("values", "values"), n("rows", "rows"))


def null_groups(spark, d):
    c = load(spark, d, "customer").withColumn("segment", F.nullif("c_mktsegment", F.lit("BUILDING")))
    return c.groupBy("segment").agg(n(F.count(F.lit(1)), "rows"))


def admitted_days(spark, d):
    rows = daily(spark, d).where(F.col("date") <= "2024-01-20")
    out = E.admitted(rows, "date", "2024-01-20")
    return out.groupBy("user_id").agg(n(F.count(F.lit(1)), "days"), F.date_format(F.max("date"), "yyyy-MM-dd").alias("last"))


def feedback_levels(spark, d):
    """Level of each year from the coverage of the year before."""
    from pyspark.sql import Window

    per = intervals(spark, d).where("level = 0.9").groupBy("year").agg(F.avg((F.col("err") <= F.col("q")).cast("double")).alias("c"))
    prev = F.lag("c").over(Window.orderBy("year"))
    return per.select("year", r("c", "coverage", 6), r(F.coalesce(S.next_level(prev), F.lit(0.9)), "level", 6))


def stream_window_counts(spark, d):
    return E.drained(E.windowed_counts(E.event_stream(spark, d)), "complete", "windows").select("start", "event_type", "rows", r("total", "total"), r("largest", "largest"))


def stream_user_state(spark, d):
    return E.drained(E.running_users(E.event_stream(spark, d)), "complete", "users")


def csv_round_trip(spark, d):
    path = shared_path(spark, "nation-csv")
    readers.write_sorted_csv(load(spark, d, "nation"), path, "n_nationkey")
    return readers.read_csv(spark, path, "n_nationkey int, n_name string, n_regionkey int")


def dialect_round_trip(spark, d):
    path = shared_path(spark, "region-tsv")
    load(spark, d, "region").write.option("header", True).option("sep", ";").csv(path)
    out = readers.read_any_dialect(spark, path)
    return out.select(F.col("r_regionkey").cast("long").alias("r_regionkey"), "r_name")


def nested_daily_json(spark, d):
    """Daily totals written as one nested document and read back as a wide daily table."""
    import json

    e = daily(spark, d).groupBy("date").agg(F.sum("rows").alias("n"), F.max("v_max").alias("m")).collect()  # days, not events
    doc = {"properties": {"parameter": {"N": {r["date"].strftime("%Y%m%d"): float(r["n"]) for r in e}, "M": {r["date"].strftime("%Y%m%d"): r["m"] if r["n"] > 300 else readers.MISSING for r in e}}}}
    path = shared_path(spark, "daily-json")
    spark.createDataFrame([(json.dumps(doc),)], "value string").coalesce(1).write.text(path)
    out = readers.read_daily_json(spark, path, ["N", "M"])
    return out.select(F.date_format("date", "yyyy-MM-dd").alias("date"), F.col("N").alias("rows"), F.col("M").alias("largest"))


def component_lookup(spark, d):
    """Each part's dearest line item supplier: left join, semi-join and top one by order."""
    from pyspark.sql import Window

    parts = load(spark, d, "part").where("p_size <= 10").select("p_partkey")
    li = load(spark, d, "lineitem").select(F.col("l_partkey").alias("p_partkey"), "l_suppkey", F.col("l_extendedprice").cast("decimal(12,2)").alias("p"))
    li = li.join(parts, "p_partkey", "left_semi")
    w = Window.partitionBy("p_partkey").orderBy(F.col("p").desc(), "l_suppkey")
    top = li.withColumn("k", F.row_number().over(w)).where("k = 1")
    return parts.join(top, "p_partkey", "left").select("p_partkey", "l_suppkey", F.col("p").cast("double").alias("price"))


def identifier_resolution(spark, d):
    """Which column of a table holds customer ids: candidates scored by overlap, name and size."""
    ids = load(spark, d, "customer").select(F.col("c_custkey").cast("long").alias("id"))
    o = load(spark, d, "orders")
    long = o.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("long").alias("id")) for c in ("o_orderkey", "o_custkey")])).alias("x")).select("x.*").distinct()
    hit = long.join(ids.withColumn("_h", F.lit(1)), "id", "left").groupBy("column").agg(F.count("_h").alias("overlap"), F.count(F.lit(1)).alias("size"))
    score = F.col("overlap") / F.col("size") + F.when(F.contains(F.col("column"), F.lit("cust")), 0.5).otherwise(0.0)
    return hit.select("column", n("overlap", "overlap"), n("size", "size"), r(score, "score"))


def topic_evidence(spark, d):
    """Topics of questions by keyword, and how many evidence documents of each language they meet."""
    words = spark.createDataFrame([("shipping", "the"), ("pricing", "of"), ("quality", "ing ")], "topic string, word string")
    q = load(spark, d, "conversations").where("role = 'user'").select("conv_id", "turn", F.lower("text").alias("t"))
    # three keywords
    hits = q.join(F.broadcast(words), F.contains(F.col("t"), F.col("word")), "left")
    return hits.groupBy("conv_id", "turn").agg(F.coalesce(F.min("topic"), F.lit("UNANSWERABLE")).alias("topic"), n(F.count("topic"), "topics"))


QUERIES = {
    "prediction_seal": (prediction_seal, f"""WITH {PREDICTIONS_SQL}, s AS (SELECT entity, context, predicted FROM predictions WHERE model = 'G+E' AND year = 2001), t AS (SELECT min((entity, context)) AS least FROM s),
        c AS (SELECT entity, context, predicted + ((entity, context) = least)::INT AS predicted FROM s, t), a AS ({S.seal_sql(f"SELECT {LINE} AS l FROM s")}), b AS ({S.seal_sql(f"SELECT {LINE} AS l FROM c")}), r AS ({S.seal_sql(f"SELECT {LINE} AS l FROM (SELECT * FROM s ORDER BY context DESC, entity)")})
        SELECT a.digest, a.rows, a.digest = r.digest AS order_free, a.digest <> b.digest AS tamper_seen FROM a, b, r"""),
    "observable_cohort": (observable_cohort, f"WITH {PREDICTIONS_SQL} SELECT replicates >= 10 AS present, count(*) AS cells, count(DISTINCT context) AS contexts FROM cells WHERE year = 2001 GROUP BY 1"),
    "reveal_scores": (reveal_scores, f"WITH {INTERVALS_SQL} SELECT nation, count(*) AS n, round(sqrt(avg((predicted-observed)*(predicted-observed))), 4) AS rmse, round(avg((err <= q)::INT), 6) AS coverage, avg((err <= q)::INT) >= 0.85 AS passes FROM ints WHERE level = 0.9 AND year = 2001 GROUP BY nation"),
    "gate_check": (gate_check, f"WITH {PREDICTIONS_SQL} SELECT count(DISTINCT entity) = 25 AND count(DISTINCT nation) = 25 AND count(DISTINCT year) = 7 AS holds FROM cells"),
    "reproduction_audit": (reproduction_audit, f"""WITH {PREDICTIONS_SQL}, a AS (SELECT model, sqrt(avg((predicted-observed)**2)) AS a FROM predictions GROUP BY model),
        b AS (SELECT model, sqrt(sum(s) / sum(c)) AS b FROM (SELECT model, context, sum((predicted-observed)**2) AS s, count(*) AS c FROM predictions GROUP BY ALL) GROUP BY model) SELECT model, abs(a - b) <= 1e-8 AS reproduced FROM a JOIN b USING (model)"""),
    "metadata_audit": (metadata_audit, """WITH o AS (SELECT o_custkey AS k, list_sort(list(o_orderdate::DATE)) AS l, count(DISTINCT o_orderdate::DATE) AS n FROM orders GROUP BY 1)
        SELECT c_custkey AS k, CASE WHEN n IS NULL THEN 'NO_DATE' WHEN n = 1 THEN 'ONE_DATE' ELSE 'SEVERAL_DATES' END AS reason, strftime(l[len(l) // 2 + 1], '%Y-%m-%d') AS median_date FROM customer LEFT JOIN o ON c_custkey = k"""),
    "conflicting_duplicates": (conflicting_duplicates, "SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, count(DISTINCT l_returnflag) AS values, count(*) AS rows FROM lineitem GROUP BY 1, 2 HAVING count(DISTINCT l_returnflag) > 1"),
    "null_groups": (null_groups, "SELECT nullif(c_mktsegment, 'BUILDING') AS segment, count(*) AS rows FROM customer GROUP BY 1"),
    "admitted_days": (admitted_days, f"WITH {DAILY_SQL} SELECT user_id, count(*) AS days, strftime(max(date), '%Y-%m-%d') AS last FROM daily WHERE date <= DATE '2024-01-20' GROUP BY user_id"),
    "feedback_levels": (feedback_levels, f"WITH {INTERVALS_SQL}, y AS (SELECT year, avg((err <= q)::INT) AS c FROM ints WHERE level = 0.9 GROUP BY year) SELECT year, round(c, 6) AS coverage, round(coalesce(least(0.995, 0.9 + greatest(0, 0.9 - lag(c) OVER (ORDER BY year))), 0.9), 6) AS level FROM y"),
    "stream_window_counts": (stream_window_counts, "SELECT strftime(time_bucket(INTERVAL 6 HOURS, ts, TIMESTAMP '1970-01-01'), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS rows, round(sum(value::DECIMAL(18,6))::DOUBLE, 4) + 0 AS total, round(max(value::DECIMAL(18,6))::DOUBLE, 4) + 0 AS largest FROM events GROUP BY 1, 2"),
    "stream_user_state": (stream_user_state, "SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last, count(*) AS rows FROM events GROUP BY user_id"),
    "csv_round_trip": (csv_round_trip, "SELECT n_nationkey, n_name, n_regionkey FROM nation"),
    "dialect_round_trip": (dialect_round_trip, "SELECT r_regionkey::BIGINT AS r_regionkey, r_name FROM region"),
    "nested_daily_json": (nested_daily_json, f"WITH {DAILY_SQL} SELECT strftime(date, '%Y-%m-%d') AS date, sum(rows)::DOUBLE AS rows, CASE WHEN sum(rows) > 300 THEN max(v_max) END AS largest FROM daily GROUP BY date"),
    "component_lookup": (component_lookup, "WITH t AS (SELECT l_partkey, l_suppkey, l_extendedprice FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY l_extendedprice DESC, l_suppkey) = 1) SELECT p_partkey, l_suppkey, l_extendedprice AS price FROM part LEFT JOIN t ON p_partkey = l_partkey WHERE p_size <= 10"),
    "identifier_resolution": (identifier_resolution, " UNION ALL ".join(f"SELECT '{c}' AS column, count(DISTINCT {c}) FILTER (WHERE {c} IN (SELECT c_custkey FROM customer)) AS overlap, count(DISTINCT {c}) AS size, round(count(DISTINCT {c}) FILTER (WHERE {c} IN (SELECT c_custkey FROM customer)) / count(DISTINCT {c}) + {b}, 4) AS score FROM orders" for c, b in (("o_orderkey", 0), ("o_custkey", 0.5)))),
    "topic_evidence": (topic_evidence, """WITH w(topic, word) AS (VALUES ('shipping', 'the'), ('pricing', 'of'), ('quality', 'ing '))
        SELECT conv_id, turn, coalesce(min(topic), 'UNANSWERABLE') AS topic, count(topic) AS topics FROM conversations LEFT JOIN w ON contains(lower(text), word) WHERE role = 'user' GROUP BY conv_id, turn"""),
}
