"""Retention, quantiles, look-ups, reproduction and locks on small inputs, against plain versions."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pytest

from hindcast.operators import aggregates as A
from hindcast.operators import audits as U


@pytest.fixture(scope="module")
def risks(spark):
    rng = np.random.default_rng(11)
    rows = [("a", i, float(x)) for i, x in enumerate(rng.integers(0, 12, 101))] + [("b", i, float(x)) for i, x in enumerate(rng.normal(size=64))]
    rows += [("flat", i, 3.0) for i in range(10)] + [("low", i, 1.0 if i < 9 else 2.0) for i in range(10)] + [("one", 0, 5.0), (None, 0, 1.0), (None, 1, 2.0), ("null", 0, None), ("a", 900, None)]
    return rows, spark.createDataFrame(rows, "k string, i int, x double")


def test_interpolated_quantile(risks):
    rows, df = risks
    levels = [0.0, 0.1, 0.5, 0.95, 1.0]
    got = {(r["k"], r["level"]): (r["n"], r["q"]) for r in A.interpolated_quantile(df, ["k"], "x", levels).collect()}
    for k in ("a", "b", "flat", "low", "one", None):
        own = [x for key, _, x in rows if key == k and x is not None]
        for p in levels:
            n, q = got[k, p]
            assert n == len(own) and math.isclose(q, np.quantile(own, p), abs_tol=1e-12)
    assert len(got) == 6 * len(levels)


def test_retained_by_risk(risks):
    rows, df = risks
    removed = [0.0, 0.05, 0.1, 0.5]
    got = sorted((r["removed"], str(r["k"]), r["i"]) for r in U.retained_by_risk(df, ["k"], "x", ["i"], removed).collect())
    frame, want = pd.DataFrame(rows, columns=["k", "i", "x"]), []
    for k in frame["k"].map(str).unique():
        every = frame[frame["k"].map(str) == k]
        own = every[every["x"].notna()]
        for r in removed:
            kept = every if r == 0 else own[own["x"] < own["x"].quantile(1 - r)]
            if kept.empty and len(own):
                kept = own.sort_values(["x", "i"]).head(max(1, round(len(own) * (1 - r))))
            want += [(r, k, i) for i in kept["i"]]
    assert got == sorted(want)
    assert U.retained_by_risk(df, ["k"], "x", ["i"], [0.0]).count() == len(rows)
    assert U.retained_by_risk(df.limit(0), ["k"], "x", ["i"], removed).count() == 0


def test_smallest_limits_before_the_shuffle(risks):
    rows, df = risks
    out = U.smallest(df.where("x is not null"), ["k"], ["x", "i"], 3)
    assert sorted((str(r["k"]), r["place"], r["i"]) for r in out.collect()) == sorted((k, p, i) for k in {str(r[0]) for r in rows} for p, (x, i) in enumerate(sorted((x, i) for key, i, x in rows if str(key) == k and x is not None)[:3], 1))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.index("WindowGroupLimit") < plan.index("Exchange hashpartitioning") < plan.rindex("WindowGroupLimit")


def test_looked_up(spark):
    table = spark.createDataFrame([("x", 1), ("y", 2), (None, 9)], "key string, row int")
    df = spark.createDataFrame([("x", 0.5), ("x", 0.7), ("y", 1.0)], "key string, v double")
    assert sorted(tuple(r) for r in U.looked_up(df, table, "key", ["row"]).collect()) == [("x", 0.5, 1), ("x", 0.7, 1), ("y", 1.0, 2)]
    more = df.union(spark.createDataFrame([("z", 1.0), (None, 2.0)], df.schema))
    with pytest.raises(ValueError, match="no entry for key"):
        U.looked_up(more, table, "key", ["row"])
    assert {r["v"]: r["row"] for r in U.looked_up(more, table, "key", ["row"], strict=False).collect()}[2.0] is None
    with pytest.raises(ValueError, match="several entries"):
        U.looked_up(df, table.union(table), "key", ["row"])


def test_reproduced_and_bits(spark):
    a = spark.createDataFrame([(1, 1.0), (2, 2.0), (3, None), (4, 4.0), (None, 5.0), (6, None)], "k int, v double")
    b = spark.createDataFrame([(1, 1.0 + 5e-9), (2, 2.1), (3, None), (5, 5.0), (None, 5.0), (6, 1.0)], "k int, v double")
    assert {r["k"]: r["state"] for r in U.reproduced(a, b, ["k"], "v").collect()} == {1: "REPRODUCED", 2: "DIFFERS", 3: "REPRODUCED", 4: "NOT_STORED", 5: "NOT_COMPUTED", None: "REPRODUCED", 6: "DIFFERS"}
    x = spark.createDataFrame([(1, 0.0, 0.1), (2, float("nan"), None), (3, 1.0, 2.0)], "k int, v double, w double")
    y = spark.createDataFrame([(1, -0.0, float(np.nextafter(0.1, 1))), (2, float("nan"), None), (4, 1.0, 2.0)], "k int, v double, w double")
    assert tuple(U.bit_differences(x, y, ["k"], ["v", "w"]).collect()[0]) == (2, 2, 1, 1)


def test_data_lock(spark):
    records = spark.createDataFrame([("g1", "e1", 1.0, 1999), ("g1", "e2", None, 2001), ("g2", "e9", 2.0, 2000), (None, None, 1.0, None)], "g string, e string, y double, year int")
    entities = spark.createDataFrame([("g1", 0, 1), ("g3", 1, 1)], "g string, m1 int, m2 int")
    contexts = spark.createDataFrame([("e1", 1.0, 5.0, None), ("e2", 2.0, 5.0, None), ("e3", None, 5.0, None)], "e string, t double, same double, none double")
    row = U.data_lock(records, entities, contexts, "g", "e", "y", "year").collect()[0].asDict()
    assert row == {
        "records": 4, "with_value": 3, "first_year": 1999, "last_year": 2001, "record_entities": 2, "entities": 2, "shared_entities": 1, "record_contexts": 3, "contexts": 3, "shared_contexts": 2,
        "covariates": 3, "varying": 1, "missing": pytest.approx(1 / 3), "markers": 2,
    }
    empty = U.data_lock(records.limit(0), entities.limit(0), contexts.limit(0), "g", "e", "y", "year").collect()[0]
    assert (empty["records"], empty["varying"], empty["missing"]) == (0, 0, None)
