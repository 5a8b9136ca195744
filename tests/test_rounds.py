"""Feedback rounds, cached scans, the outcome guard and pruned nearest neighbours on small inputs."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from hindcast.operators import feedback as B
from hindcast.operators import relational as R
from hindcast.sources import cache, readers


def plain_rounds(worlds, nominal):
    out = {}
    for t in sorted({w[0] for w in worlds}):
        known = [w for w in worlds if w[0] <= t]
        actions = sorted(known[0][1])
        best = [min(l for l, c in w[1].values() if c >= nominal) for w in known]
        robust = [a for a in actions if all(w[1][a][1] >= nominal for w in known)]
        worst = {a: max(w[1][a][0] for w in known) for a in actions}
        regret = {a: max(w[1][a][0] - b for w, b in zip(known, best, strict=True)) for a in actions}
        for a in actions:
            identified = any(w[1][a][1] >= nominal and w[1][a][0] <= b + 1e-12 for w, b in zip(known, best, strict=True))
            least = lambda v, a=a: a in robust and v[a] <= min(v[x] for x in robust) + 1e-12
            out[t, a] = (identified, a in robust, worst[a], regret[a], least(worst), least(regret))
    return out


def test_feedback_rounds(spark):
    rng = np.random.default_rng(3)
    worlds = []
    for w in range(12):
        own = {a: (float(rng.integers(1, 6)), float(rng.choice([0.7, 0.9, 0.95]))) for a in "abcd"}
        own["a"] = (own["a"][0], 0.95)
        worlds.append((w // 3, own))
    df = spark.createDataFrame([(f"w{i}", t, a, *v) for i, (t, own) in enumerate(worlds) for a, v in own.items()], "world string, round int, action string, loss double, coverage double")
    rounds = B.feedback_rounds(df, "world", "round", "action", "loss", "coverage", 0.9)
    got = {(r["round"], r["action"]): tuple(r)[2:] for r in rounds.collect()}
    assert got == plain_rounds(worlds, 0.9)
    sets = {r["round"]: r for r in B.identified_sets(rounds, {"a": -1, "b": 0, "c": 1, "d": 1}).collect()}
    for t, r in sets.items():
        assert r["actions"] == sorted(a for (u, a), v in got.items() if u == t and v[0]) and r["point_identified"] == (len(r["actions"]) == 1)
    assert all(set(sets[t]["actions"]) <= set(sets[t + 1]["actions"]) for t in range(3))
    with pytest.raises(Exception, match="no direction"):
        B.identified_sets(rounds, {"a": 0}).collect()
    with pytest.raises(Exception, match="feasible"):
        B.feedback_rounds(df.withColumn("coverage", F.lit(0.1)), "world", "round", "action", "loss", "coverage", 0.9).collect()


def test_places_are_fetched_once(spark, tmp_path):
    asked = []

    def fetch(places):
        own = [r["place"] for r in places.collect()]
        asked.append(sorted(own))
        rows = [(p, f"2024-01-{k + 1:02d}", float(k), None if k else 1.0) for p in own if p != "empty" for k in range(3)]
        return spark.createDataFrame(rows, "place string, date string, rain double, heat double")

    wanted = lambda *p: spark.createDataFrame([(x,) for x in p], "place string")
    path = str(tmp_path / "cache")
    assert cache.scan_places(spark, wanted("b", "a", "a", None), fetch, path, ["rain", "heat"]).count() == 6
    out = cache.scan_places(spark, wanted("a", "c", "empty"), fetch, path, ["rain", "heat"])
    assert sorted({r["place"] for r in out.collect()}) == ["a", "c"] and out.agg(F.sum("rain")).first()[0] == 6.0
    assert cache.scan_places(spark, wanted("a", "empty"), fetch, path, ["rain", "heat"]).count() == 3
    assert asked == [["a", "b"], ["c", "empty"]]
    audit = {r["place"]: (r["days"], r["first_date"], r["missing"]) for r in cache.audited(spark, path).collect()}
    assert audit["a"] == (3, "2024-01-01", pytest.approx(1 / 3)) and audit["empty"] == (0, None, None) and len(audit) == 4
    assert list((tmp_path / "cache" / "series").glob("load=*/place=a/*.csv.gz"))


def test_a_load_cut_short_does_not_count(spark, tmp_path):
    path = str(tmp_path / "cache")
    spark.createDataFrame([("2024-01-01", 1.0, "a")], "date string, rain double, place string").write.partitionBy("place").option("header", True).csv(f"{path}/series/load=dead")
    fetch = lambda places: places.selectExpr("place", "'2024-02-01' AS date", "2.0D AS rain")
    out = cache.scan_places(spark, spark.createDataFrame([("a",)], "place string"), fetch, path, ["rain"])
    assert [(str(r["date"]), r["rain"]) for r in out.collect()] == [("2024-02-01", 2.0)]


def test_place_key(spark):
    row = spark.range(1).select(cache.place_key(F.lit(1.23456), F.lit(-7)).alias("k")).first()
    assert row["k"] == "1.2346_-7.0000"


def test_outcomes_are_refused_before_the_seal(spark, tmp_path):
    (tmp_path / "deep" / "er").mkdir(parents=True)
    for name in ("inputs.csv", "deep/covariates.csv"):
        (tmp_path / name).write_text("x")
    assert cache.refuse_outcomes(spark, [str(tmp_path), str(tmp_path / "missing")], ["2024_Answers.csv"]) == 2
    (tmp_path / "deep" / "er" / "2024-ANSWERS.CSV").write_text("y")
    with pytest.raises(PermissionError, match="ANSWERS"):
        cache.refuse_outcomes(spark, [str(tmp_path)], ["2024_Answers.csv"])


def test_pruned_nearest_is_exact_and_prunes(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(12, 4)) * 50
    x = np.concatenate([centres[rng.integers(0, 12, 300)] + rng.normal(size=(300, 4)), np.tile(centres[0], (60, 1))])
    y = centres[rng.integers(0, 12, 90)] + rng.normal(size=(90, 4))
    frame = lambda m, first: spark.createDataFrame([(first + i, v.tolist()) for i, v in enumerate(m)], "i long, v array<double>").repartition(3)
    train, test = frame(x, 0), frame(y, 1000)
    got = {r["i"]: (r["nearest"], r["nearest_sq"], r["mean_k_sq"]) for r in R.pruned_nearest(test, train, "i", "v", 5, pivots=16, block=25).collect()}
    for i, v in enumerate(y):
        d = ((x - v) ** 2).sum(1)
        order = np.lexsort((np.arange(len(x)), d))[:5]
        assert got[1000 + i][0] == order[0] and np.allclose(got[1000 + i][1:], [d[order[0]], d[order].mean()])
    cells = R.reachable_cells(centres, np.full(12, 30), np.full(12, 6.0), y, 5)
    assert sum(map(len, cells)) < 0.3 * 12 * len(y)
    few = R.pruned_nearest(test, train.limit(2), "i", "v", 5).collect()
    assert len(few) == 90
    assert R.pruned_nearest(test, train.limit(0), "i", "v").count() == 0 and R.pruned_nearest(test.limit(0), train, "i", "v").count() == 0


def test_places_meet_few_cells(spark, monkeypatch):
    import tracemalloc

    rng = np.random.default_rng(14)
    y = rng.normal(size=(20_000, 3))
    y /= np.sqrt((y**2).sum(1))[:, None]
    y[700:720] = y[:20]  # copies of pivots
    pivots, x = y[:500], np.concatenate([y[:20], rng.normal(size=(3_000, 3))])
    x /= np.sqrt((x**2).sum(1))[:, None]
    cell = R.squared_distances(y, pivots).argmin(1)
    count, radius = np.bincount(cell, minlength=500), np.zeros(500)
    np.maximum.at(radius, cell, np.sqrt(((y - pivots[cell]) ** 2).sum(1)))
    for k, most in ((1, 6), (5, 16)):
        tracemalloc.start()
        cells = R.reachable_cells(pivots, count, radius, x, k)
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert sum(map(len, cells)) < most * len(x) and peak < 24e6  # by the triangle inequality alone and all rows at once: 16.5 cells a place, 72 MB
        for v, own in zip(x[:200], cells, strict=False):
            d = ((y - v) ** 2).sum(1)
            assert np.isin(cell[d <= np.partition(d, k - 1)[k - 1]], own).all()
    assert [R.place_pivots(n) for n in (0, 1_000, 360_000)] == [64, 64, 1_200]

    place = lambda lat, lon, first: spark.createDataFrame([(f"p{first + i}", float(a), float(b)) for i, (a, b) in enumerate(zip(lat, lon, strict=True))], "k string, lat double, lon double")
    lat, lon = rng.uniform(-90, 90, 400), rng.uniform(-180, 180, 400)
    lat[:3], lon[:5], lat[200:240], lon[200:240] = (90, -90, 90), (0, 0, 77, 180, -180), lat[240], lon[240]
    monkeypatch.setattr(R, "STEP", 3)
    monkeypatch.setattr(R, "BLOCK", 50)
    a, b = np.radians(lat), np.radians(lon)
    h = lambda i, j: np.sin((a[j] - a[i]) / 2) ** 2 + np.cos(a[i]) * np.cos(a[j]) * np.sin((b[j] - b[i]) / 2) ** 2
    got = {r["k"]: r for r in R.nearest_places(place(lat[:150], lon[:150], 1_000), place(lat[150:], lon[150:], 1_150), "k", "lat", "lon").collect()}
    assert len(got) == 150
    for i in range(150):
        d = 2 * 6371.0088 * np.arcsin(np.sqrt(np.minimum(1, h(i, np.arange(150, 400)))))
        assert abs(got[f"p{1000 + i}"]["km"] - d.min()) < 1e-3 and d[int(got[f"p{1000 + i}"]["nearest"][1:]) - 1150] < d.min() + 1e-3


def test_kernel_sums(spark):
    rng = np.random.default_rng(5)
    x, w = rng.normal(size=(30, 2)), rng.normal(size=30)
    df = spark.createDataFrame([(i, v.tolist(), float(c)) for i, (v, c) in enumerate(zip(x, w, strict=True))], "i long, v array<double>, w double")
    got = {r["i"]: r["value"] for r in R.kernel_sums(df, df, "i", "v", "w", lambda sq: np.exp(-sq)).collect()}
    want = np.exp(-((x[:, None] - x[None]) ** 2).sum(2)) @ w
    assert all(abs(got[i] - want[i]) < 1e-9 for i in range(30))


def test_json_records(spark, tmp_path):
    df = spark.createDataFrame([("x\"y", 1, None), (None, 2, 0.5)], "b string, a long, c double")
    readers.write_json_records(df, str(tmp_path / "j"))
    back = readers.read_json_records(spark, str(tmp_path / "j"), "a long, b string, c double")
    assert sorted((r["a"], r["b"], r["c"]) for r in back.collect()) == [(1, 'x"y', None), (2, None, 0.5)]
    (tmp_path / "k").mkdir()
    (tmp_path / "k" / "one.txt").write_text('{"b":"x","a":1,"c":null}\n')
    with pytest.raises(Exception, match="not canonical"):
        readers.read_json_records(spark, str(tmp_path / "k"), "a long, b string, c double").collect()
