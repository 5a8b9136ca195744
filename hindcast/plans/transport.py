"""Queries over how coverage and rankings carry over to coming years."""

from __future__ import annotations

from pyspark.sql import functions as F

from hindcast.operators import transport as T

from .bindings import CELLS_SQL, PREDICTIONS_SQL, cells, n, predictions, r

#: Coverage to keep: about what the predictors have, so that the intervals say different things.
NOMINAL = 0.66


def hits():
    return F.abs(F.col("observed") - F.col("predicted")) <= 8000


def transport_certificates(spark, d):
    """Per predictor and year: the gap of coverage to expect, its interval under earlier drifts, what that proves, and whether it held."""
    out = T.transport_certificates(predictions(spark, d), ["model"], "nation", "year", hits(), NOMINAL)
    return out.select("model", "year", *[r(c, c, 6) for c in ("source_gap", "mixture", "drift", "center", "bound", "lower", "upper", "target_gap")], "verdict", "held")


def transport_worlds(spark, d):
    """Per predictor and year: two worlds that agree in all that is known before the year and differ in its gap."""
    out = T.transport_worlds(predictions(spark, d), ["model"], "nation", "year", hits(), 0.05, NOMINAL)
    return out.select("model", "year", "world", r("gap", "gap", 6), "valid", "signs_differ")


def amplitude_worlds(spark, d):
    """Per context: worlds with the same predictions and other spreads of the outcome."""
    out = T.amplitude_worlds(predictions(spark, d).where("model = 'G+E'"), ["context"], "predicted")
    return out.select("context", "scale", n("n", "n"), r("ratio", "ratio", 6))


def late_rankings(spark, d):
    """Per entity: its mean contrast to the leading entity and the contexts that rank the two the other way."""
    out = T.late_rankings(cells(spark, d), "entity", "context", "observed")
    return out.select("entity", r("expected", "expected"), n("states", "states"), n("reversed", "reversed"))


TRANSPORTED_SQL = f"""{PREDICTIONS_SQL}, k AS (SELECT model, nation, year, count(*) AS n, count(*) FILTER (WHERE abs(observed - predicted) <= 8000) AS h FROM predictions GROUP BY ALL),
  w AS (SELECT model, year, sum(n) AS nt, sum(h) AS ht FROM k GROUP BY ALL), b AS (SELECT a.model, a.year, a.nt, a.ht, sum(p.nt) AS ns, sum(p.ht) AS hs FROM w a JOIN w p ON p.model = a.model AND p.year < a.year GROUP BY ALL),
  s AS (SELECT a.model, a.nation, a.year, sum(p.h) / sum(p.n) AS f FROM k a JOIN k p ON p.model = a.model AND p.nation = a.nation AND p.year < a.year GROUP BY ALL),
  t AS (SELECT model, year, any_value(hs / ns) AS source, any_value(ht / nt) AS target, sum(coalesce(f, hs / ns) * n / nt) AS carried, min(coalesce(f, hs / ns)) AS below, min(1 - coalesce(f, hs / ns)) AS above
    FROM b JOIN k USING (model, year) LEFT JOIN s USING (model, nation, year) GROUP BY ALL)"""
QUERIES = {
    "transport_certificates": (transport_certificates, f"""WITH {TRANSPORTED_SQL}, gaps AS (SELECT model, year, source - {NOMINAL} AS source_gap, target - {NOMINAL} AS target_gap, carried - source AS mixture, target - carried AS drift, carried - {NOMINAL} AS center,
          max(abs(target - carried)) OVER (PARTITION BY model ORDER BY year ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS bound FROM t)
        SELECT model, year, round(source_gap, 6) + 0 AS source_gap, round(mixture, 6) + 0 AS mixture, round(drift, 6) + 0 AS drift, round(center, 6) + 0 AS center, round(bound, 6) AS bound, round(center - bound, 6) + 0 AS lower, round(center + bound, 6) + 0 AS upper,
          round(target_gap, 6) + 0 AS target_gap, CASE WHEN bound IS NULL THEN 'NO_HISTORY' WHEN center + bound < 0 THEN 'UNDER' WHEN center - bound > 0 THEN 'OVER' ELSE 'OPEN' END AS verdict, abs(target_gap - center) <= bound + 1e-12 AS held FROM gaps"""),
    "transport_worlds": (transport_worlds, f"""WITH {TRANSPORTED_SQL} SELECT model, year, world, round(carried - {NOMINAL} + shift, 6) + 0 AS gap, 0.05 <= least(below, above) + 1e-15 AS valid, abs(carried - {NOMINAL}) < 0.05 AS signs_differ
        FROM t CROSS JOIN (VALUES ('BELOW', -0.05::DOUBLE), ('ABOVE', 0.05::DOUBLE)) x(world, shift)"""),
    "amplitude_worlds": (amplitude_worlds, f"""WITH {PREDICTIONS_SQL}, p AS (SELECT context, predicted, avg(predicted) OVER (PARTITION BY context) AS m FROM predictions WHERE model = 'G+E' AND predicted IS NOT NULL),
        x AS (SELECT context, scale, count(*) AS n, stddev_samp(predicted) / stddev_samp(10 + scale * (predicted - m)) AS ratio FROM p CROSS JOIN (VALUES (0.5::DOUBLE), (2.0::DOUBLE)) s(scale) GROUP BY ALL HAVING count(*) >= 3 AND max(predicted) > min(predicted))
        SELECT context, scale, n, round(ratio, 6) AS ratio FROM x"""),
    "late_rankings": (late_rankings, f"""WITH {CELLS_SQL}, m AS (SELECT entity, avg(observed) AS m FROM cells GROUP BY entity), l AS (SELECT entity FROM m ORDER BY m DESC, entity LIMIT 1), v AS (SELECT context, observed AS v FROM cells WHERE entity = (FROM l)),
        c AS (SELECT entity, avg(observed - v) AS e, count(*) AS states, count(*) FILTER (WHERE observed > v) AS up, count(*) FILTER (WHERE observed < v) AS down FROM cells JOIN v USING (context) WHERE entity <> (FROM l) GROUP BY entity)
        SELECT entity, round(e, 4) + 0 AS expected, states, CASE WHEN e > 0 THEN down ELSE up END AS reversed FROM c"""),
}
