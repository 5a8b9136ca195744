"""Operators on small tables made here."""

from __future__ import annotations

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from hindcast.functions import scalar as S
from hindcast.operators import aggregates as A
from hindcast.operators import estimators as M
from hindcast.operators import relational as R
from hindcast.operators import windows as W
from hindcast.sources import readers
from hindcast.streaming import events as E


def test_finite_sample_quantile_rank(spark):
    df = spark.createDataFrame([(float(i),) for i in range(1, 11)], "v double")
    got = {r["level"]: r["q"] for r in A.finite_sample_quantile(df, [], "v", [0.8, 0.9, 0.95]).collect()}
    assert got == {0.8: 9.0, 0.9: 10.0, 0.95: 10.0}


def test_balanced_mean(spark):
    df = spark.createDataFrame([("A", 1.0)] * 10 + [("B", 0.0)] * 2, "g string, v double")
    row = A.balanced_mean(df, "g", "v").first()
    assert row["balanced"] == 0.5 and round(row["weighted"], 6) == round(10 / 12, 6)


def test_interval_score(spark):
    df = spark.createDataFrame([(5.0, 4.0, 6.0), (9.0, 4.0, 6.0)], "y double, l double, u double")
    hit, miss = [r[0] for r in df.select(A.interval_score(F.col("y"), F.col("l"), F.col("u"), 0.9)).collect()]
    assert hit == 2.0 and miss > 50


def test_constant_side_has_no_correlation(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0), (1.0, 5.0)], "x double, y double")
    assert df.agg(A.pearson("x", "y").alias("r")).first()["r"] is None


def test_sse_identity(spark):
    rng = np.random.default_rng(1)
    df = spark.createDataFrame([(str(i % 3), float(x)) for i, x in enumerate(rng.normal(size=60))], "g string, r double")
    row = A.sse_decomposition(df, "g", F.col("r")).first()
    assert row["identity_holds"]
    offsets = spark.createDataFrame([("a", 2.0)] * 4 + [("b", -1.0)] * 4, "g string, r double")
    assert A.sse_decomposition(offsets, "g", F.col("r")).first()["within_share"] == 0


@pytest.mark.parametrize("n", [4, 6, 9, 13])
def test_quartiles_equal_cut_ranks(spark, n):
    df = spark.createDataFrame([(i,) for i in range(n)], "v int").withColumn("q", W.first_rank_quartile([], "v"))
    want = pd.qcut(pd.Series(range(n)).rank(method="first"), 4, labels=False) + 1
    assert [r["q"] for r in df.orderBy("v").collect()] == list(want)


def test_average_ranks(spark):
    df = spark.createDataFrame([(1,), (1,), (2,), (2,), (3,)], "v int").select("v", W.percentile_rank([], "v").alias("p"))
    assert sorted(r["p"] for r in df.collect()) == [0.3, 0.3, 0.7, 0.7, 1.0]


def test_prior_mean_excludes_own_year(spark):
    df = spark.createDataFrame([("a", 1, 1.0), ("a", 2, 999.0), ("a", 3, 5.0)], "k string, y int, v double")
    got = {r["y"]: r["m"] for r in W.prior_mean(df, ["k"], "y", "v", "m").collect()}
    assert got == {1: None, 2: 1.0, 3: 500.0}


def test_position_in_reference(spark):
    ref = spark.createDataFrame([(float(i),) for i in (1, 2, 3, 4)], "v double")
    df = spark.createDataFrame([(0.5,), (2.0,), (9.0,)], "v double")
    assert sorted(r["p"] for r in W.position_in_reference(df, ref, [], "v", "p").collect()) == [0.0, 0.5, 1.0]


def test_column_resolution(spark):
    df = spark.createDataFrame([(1, 2)], "`Year-Loc` int, yield int")
    assert R.resolve_column(df, ["year_loc"]) == "Year-Loc" and R.resolve_column(df, ["nope"], required=False) is None
    with pytest.raises(ValueError):
        R.resolve_column(df, ["nope"])
    assert R.rename_by_prefix(df, "context", ["year"]).columns == ["context", "yield"]
    with pytest.raises(ValueError):
        R.require_columns(df, ["absent"])
    assert R.column_blocks(["TT_GerEme", "yield_FlaFlw", "SW_StGEnG", "plain"], {"TT": "heat", "SW": "water", "yield": "target"}, ["yield"]) == [("TT_GerEme", "heat", "GerEme"), ("SW_StGEnG", "water", "StGEnG")]


def test_checked_joins(spark):
    a, b = spark.createDataFrame([(1, "x"), (1, "y")], "k int, a string"), spark.createDataFrame([(1, "z")], "k int, b string")
    assert R.checked_join(a, b, ["k"], "many_to_one").count() == 2
    with pytest.raises(ValueError):
        R.checked_join(a, b, ["k"], "one_to_one")
    with pytest.raises(PySparkException):
        R.complete_join(spark.createDataFrame([(7, "q")], "k int, a string"), b, ["k"]).collect()


def test_membership_ignores_values(spark):
    sealed = spark.createDataFrame([("a",), ("b",), ("c",)], "k string")
    one = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "k string, v double")
    two = spark.createDataFrame([("a", 9.0), ("b", None)], "k string, v double")
    flags = lambda t: {r["k"]: r["present"] for r in R.membership_join(sealed, t, ["k"], ["v"]).collect()}
    assert flags(one) == flags(two) == {"a": True, "b": True, "c": False}


def test_strict_truth_values_raise(spark):
    df = spark.createDataFrame([("maybe",)], "t string")
    with pytest.raises(PySparkException):
        df.select(S.truth(F.col("t"), "strict")).collect()


def test_anchor_falls_back_to_day_28(spark):
    df = spark.createDataFrame([(2023, dt.date(2024, 2, 29)), (2020, dt.date(2024, 2, 29))], "y int, d date")
    assert [r[0] for r in df.select(S.anchor_in_year(F.col("y"), F.col("d"))).collect()] == [dt.date(2023, 2, 28), dt.date(2020, 2, 29)]


def test_seal_ignores_order(spark):
    rows = [("a", 1.5), ("b", None), ("c", 2.0)]
    digest = lambda x: S.seal(spark.createDataFrame(x, "k string, v double"), S.row_text("k", "v")).first()[0]
    assert digest(rows) == digest(rows[::-1]) != digest([("a", 1.5), ("b", 0.0), ("c", 2.0)])


def test_late_rows_are_an_error(spark):
    df = spark.createDataFrame([(dt.date(2024, 1, 1),), (dt.date(2024, 3, 1),)], "d date")
    assert E.admitted(df.limit(1), "d", "2024-02-01").count() == 1
    with pytest.raises(PySparkException):
        E.admitted(df, "d", "2024-02-01").collect()


def test_ridge_equals_dense(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(80, 4)) * [1, 5, 0.2, 3]
    y = x @ [1.0, -2.0, 3.0, 0.0] + 4 + rng.normal(size=80)
    df = spark.createDataFrame([(r.tolist(), float(v)) for r, v in zip(x, y, strict=True)], "x array<double>, y double")
    z = (x - x.mean(0)) / x.std(0)
    beta = np.linalg.solve(z.T @ z + 2.5 * np.eye(4), z.T @ (y - y.mean())) / x.std(0)
    got = M.ridge(df, "x", "y", 2.5)
    assert np.allclose(got[1:], beta) and np.isclose(got[0], y.mean() - beta @ x.mean(0))


def test_relationship_matrix(spark):
    rng = np.random.default_rng(3)
    d = rng.integers(0, 3, (6, 20))
    d[:, 4] = 2
    df = spark.createDataFrame([(i, j, int(d[i, j])) for i in range(6) for j in range(20)], "s int, m int, v int")
    p = d.mean(0) / 2
    keep = (p > 0) & (p < 1)
    z = d[:, keep] - 2 * p[keep]
    want = z @ z.T / (2 * (p[keep] * (1 - p[keep])).sum())
    got = np.zeros((6, 6))
    for r in M.relationship(df, "s", "m", "v").collect():
        got[r["a"], r["b"]] = r["g"]
    assert np.allclose(got, want) and np.allclose(got, got.T)


def test_relationship_sums_over_blocks_and_partitions(spark, monkeypatch):
    rng = np.random.default_rng(13)
    d = rng.integers(0, 3, (40, 20)).astype(float)
    d[:, 4], d[3, 5], d[7, :9] = 2, np.nan, np.nan
    cells = [(i, j, None if np.isnan(d[i, j]) else int(d[i, j])) for i in range(40) for j in range(20) if i != 7 or j >= 9]
    df = spark.createDataFrame(cells, "s int, m int, v int")
    p = np.nanmean(d, axis=0) / 2
    keep = (p > 0) & (p < 1)
    z = np.nan_to_num(d[:, keep] - 2 * p[keep])
    want = z @ z.T / (2 * (p[keep] * (1 - p[keep])).sum())
    for floor in (7, 2_000):
        monkeypatch.setattr(R, "BLOCK", floor)
        got = {r["s"]: r for r in unmerged(spark, lambda: M.relationship_sums(df, "s", "m", "v"))}
        assert len(got) == 40
        assert all(abs(got[i]["own"] - want[i, i]) < 1e-9 and abs(got[i]["size"] - np.abs(want[i]).sum()) < 1e-9 for i in range(40))
    pairs = unmerged(spark, lambda: M.relationship(df, "s", "m", "v", block=7))
    assert len(pairs) == 1600 and all(abs(r["g"] - want[r["a"], r["b"]]) < 1e-9 for r in pairs)
    assert M.relationship_sums(df.where("m = 4"), "s", "m", "v").count() == 0


def test_printed_numbers_are_those_of_the_sql(spark, tmp_path):
    import duckdb

    from hindcast.plans import relational

    x = [0.125, 0.375, 2.675, -0.001, None, -0.0, 98765432109.125, 1e15 + 0.25, 1.005, 4516.95]
    spark.createDataFrame([(None if i == 3 else i, v) for i, v in enumerate(x)], "c_custkey long, c_acctbal double").coalesce(1).write.parquet(str(tmp_path / "customer.parquet"))
    got = sorted(map(repr, map(tuple, relational.formatted_numbers(spark, str(tmp_path)).collect())))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW customer AS SELECT * FROM '{tmp_path}/customer.parquet/*.parquet'")
    assert got == sorted(map(repr, con.sql(relational.QUERIES["formatted_numbers"][1]).fetchall()))


def test_conjugate_gradient_and_kernels():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(40, 3))
    k = M.rbf_kernel(x, x, M.median_bandwidth(x))
    b = rng.normal(size=40)
    assert np.allclose(M.conjugate_gradient(lambda v: k @ v + 0.5 * v, b, np.diag(k) + 0.5), np.linalg.solve(k + 0.5 * np.eye(40), b), atol=1e-5)
    v, s = M.nystrom_map(k, 1.0)
    f = k @ v * s
    assert np.allclose(f @ f.T, k, atol=1e-6)


def test_p_values():
    # Student's t with 3 degrees at 3.182446 and with 8 at 2.306004 has 5 % outside
    for df, t in ((3, 3.182446), (8, 2.306004), (30, 2.042272)):
        rho = t / np.sqrt(df + t * t)
        assert abs(M.correlation_p_value(rho, df + 2) - 0.05) < 1e-6
    assert np.isnan(M.correlation_p_value(0.5, 2)) and M.correlation_p_value(1.0, 9) == 0.0


def test_mixed_kernel():
    x = np.random.default_rng(7).normal(size=(30, 4))
    k = M.mixed_kernel([x[:, :2], x[:, 2:]])
    assert np.allclose(np.diag(k), 1) and np.allclose(k, k.T) and np.linalg.eigvalsh(k).min() > -1e-9


def test_reml_finds_signal():
    rng = np.random.default_rng(5)
    z = rng.normal(size=(150, 300))
    k = z @ z.T / 300
    y = 2 + np.linalg.cholesky(k + 1e-6 * np.eye(150)) @ rng.normal(size=150) * 2 + rng.normal(size=150) * 0.5
    t, mean, u, edge = M.reml_blup(y, k)
    assert not edge and np.exp(t) < 1 and np.corrcoef(u, y)[0, 1] > 0.8
    assert M.reml_blup(rng.normal(size=60), np.eye(60))[1] is not None


def test_bootstrap_dominant_challenger(spark):
    rng = np.random.default_rng(6)
    rows = [(f"c{i % 10}", float(y), float(y + rng.normal() * 3), float(y + rng.normal())) for i, y in enumerate(rng.normal(size=200))]
    df = spark.createDataFrame(rows, "c string, y double, a double, b double")
    got = M.bootstrap_summary(M.cluster_bootstrap(A.cluster_statistics(df, "c", [], "y", "a", "b"), "c", 100)).first()
    assert got["high"] < 0 and got["p_improve"] == 1.0 and got["reps"] == 100


def test_readers(spark, tmp_path):
    (tmp_path / "a.csv").write_text("k,v\n1,x\n2,y\n")
    assert readers.read_csv(spark, str(tmp_path / "a.csv"), "k int, v string").count() == 2
    with pytest.raises(Exception, match="header does not conform"):
        readers.read_csv(spark, str(tmp_path / "a.csv"), "v string, k int").collect()
    (tmp_path / "b.txt").write_text("k;v\n1;x\n")
    assert readers.read_any_dialect(spark, str(tmp_path / "b.txt")).columns == ["k", "v"]
    doc = '{"properties": {"parameter": {"T": {"20200101": 1.5, "20200102": -999}, "R": {"20200101": 0.0, "20200102": 2.0}}}}'
    (tmp_path / "d.json").write_text(doc)
    got = readers.read_daily_json(spark, str(tmp_path / "d.json"), ["T", "R"]).orderBy("date").collect()
    assert [(r["T"], r["R"]) for r in got] == [(1.5, 0.0), (None, 2.0)]
    (tmp_path / "safe").mkdir()
    (tmp_path / "safe" / "ok.csv").write_text("x")
    assert readers.manifest(spark, str(tmp_path / "safe"), ["ok.csv"]).count() == 1
    (tmp_path / "safe" / "answer.csv").write_text("x")
    with pytest.raises(ValueError):
        readers.manifest(spark, str(tmp_path / "safe"), ["ok.csv"])
    with pytest.raises(FileNotFoundError):
        readers.read_all_or_none(spark, {"a": str(tmp_path / "none.parquet")})
    import hashlib

    assert readers.digests(spark, str(tmp_path / "safe" / "ok.csv")).first()["sha256"] == hashlib.sha256(b"x").hexdigest()


def test_kernel_ridge_with_all_rows_as_landmarks(spark):
    rng = np.random.default_rng(4)
    x, z = rng.normal(size=(40, 3)), rng.normal(size=(7, 3))
    y = x[:, 0] ** 2 + x[:, 1]
    table = lambda v, t: spark.createDataFrame([(i, [float(a) for a in r], float(b)) for i, (r, b) in enumerate(zip(v, t, strict=True))], "i long, v array<double>, y double")
    got = M.kernel_ridge(table(x, y), table(z, np.zeros(7)), "i", "v", "y", 0.5, landmarks=40)
    width = M.median_bandwidth(x)
    k = M.rbf_kernel(x, x, width)
    want = y.mean() + M.rbf_kernel(z, x, width) @ np.linalg.solve(k + 0.5 * np.eye(40), y - y.mean())
    assert np.allclose([r["predicted"] for r in got.orderBy("i").collect()], want, atol=1e-6)
    by_steps = M.conjugate_gradient(lambda v: k @ v + 0.5 * v, y - y.mean(), np.diag(k) + 0.5)
    assert np.allclose(M.rbf_kernel(z, x, width) @ by_steps + y.mean(), want, atol=1e-4)


def test_sums_of_features_are_taken_where_the_rows_are(spark):
    rng = np.random.default_rng(14)
    x, y = rng.normal(size=(2_500, 3)), rng.normal(size=2_500)
    df = spark.createDataFrame([(i, [float(a) for a in r], float(b)) for i, (r, b) in enumerate(zip(x, y, strict=True))], "i long, v array<double>, y double").coalesce(1)

    def features(v):
        if len(v) > 1_000:
            raise ValueError("too many rows at a time")
        return np.hstack([v, v**2])

    z = np.column_stack([np.ones(len(x)), x, x**2, y])
    assert np.allclose(M.gram_matrix(M.gram(df, "v", "y", features)), z.T @ z)
    plan = M.kernel_ridge(df.where("i > 9"), df.where("i < 10"), "i", "v", "y", 1.0, landmarks=20)._jdf.queryExecution().toString()
    assert "_f" not in plan.replace("_func", "")  # a row's features never pass between Python and the JVM


def test_reml_from_sums_is_reml_from_rows(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(80, 5))
    y = x @ rng.normal(size=5) + rng.normal(size=80) + 3
    df = spark.createDataFrame([([float(a) for a in r], float(b)) for r, b in zip(x, y, strict=True)], "v array<double>, y double")
    t, mean, edge = M.reml_share(M.gram_matrix(M.gram(df, "v", "y")))
    z = (x - x.mean(0)) / x.std(0)
    want, mu, _, bound = M.reml_blup(y, z @ z.T / 5)
    assert abs(t - want) < 1e-4 and abs(mean - mu) < 1e-9 and edge == bound


def test_nearest_points_and_support_over_blocks(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(60, 4))
    df = spark.createDataFrame([(i, [float(a) for a in r]) for i, r in enumerate(x)], "i long, v array<double>")
    d = ((x[:30, None, :] - x[None, 30:, :]) ** 2).sum(2)
    R.BLOCK, before = 7, R.BLOCK
    try:
        for many in (7, 2_000):
            def small(i, a, j, b):
                return pd.DataFrame({"i": np.repeat(i, len(j)), "j": np.tile(j, len(i)), "d": R.squared_distances(a, b).ravel()})

            got = R.block_pairs(df.where("i < 30"), df.where("i >= 30"), "i", "v", small, "i long, j long, d double", many).toPandas()
            assert len(got) == 900 and np.allclose([d[i, j - 30] for i, j in zip(got.i, got.j, strict=True)], got.d)
    finally:
        R.BLOCK = before
    got = {r["i"]: r for r in R.nearest_points(df.where("i < 30"), df.where("i >= 30"), "i", "v", 3).collect()}
    for i in range(30):
        order = np.argsort(d[i])
        assert got[i]["nearest"] == order[0] + 30 and abs(got[i]["mean_k_sq"] - d[i][order[:3]].mean()) < 1e-9
    got = {r["i"]: r for r in R.support_geometry(df.where("i < 30"), df.where("i >= 30"), "i", "v", 2.0).collect()}
    assert all(abs(got[i]["density"] - np.exp(-d[i] / 2).mean()) < 1e-9 and abs(got[i]["mass"] - (d[i] <= 2).mean()) < 1e-9 for i in range(30))
    assert R.nearest_points(df.limit(0), df, "i", "v").count() == 0 and R.nearest_points(df, df.limit(0), "i", "v").count() == 0


def unmerged(spark, build):
    """The rows of a frame whose shuffle partitions stay apart, as on larger tables: merged small ones hide keys of two types."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        return build().collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_nearest_points_over_blocks_and_partitions(spark, monkeypatch):
    rng = np.random.default_rng(17)
    x = rng.normal(size=(90, 4))
    x[40:80] = x[40]  # more copies than any block keeps: the lesser ids are the nearest
    df = spark.createDataFrame([(i, [float(a) for a in r]) for i, r in enumerate(x)], "i long, v array<double>")
    d = ((x[:30, None, :] - x[None, 30:, :]) ** 2).sum(2)
    for block in (7, 2_000):
        monkeypatch.setattr(R.block_pairs, "__defaults__", (block,))
        got = {r["i"]: r for r in unmerged(spark, lambda: R.nearest_points(df.where("i < 30"), df.where("i >= 30"), "i", "v", 3))}
        assert len(got) == 30
        for i in range(30):
            order = np.lexsort((np.arange(60), d[i].round(12)))
            assert got[i]["nearest"] == order[0] + 30 and abs(got[i]["mean_k_sq"] - d[i][order[:3]].mean()) < 1e-9
    best = R.least_distances(3)(np.array([7]), x[40:41], np.arange(89, 29, -1), x[:29:-1])
    assert best["j"].tolist() == [40, 41, 42] and not best["d"].any()


def test_support_geometry_over_blocks_and_partitions(spark, monkeypatch):
    rng = np.random.default_rng(18)
    x = rng.normal(size=(90, 4))
    df = spark.createDataFrame([(i, [float(a) for a in r]) for i, r in enumerate(x)], "i long, v array<double>")
    d = ((x[:30, None, :] - x[None, 30:, :]) ** 2).sum(2)
    for floor, grid in ((7, 3), (1, 24), (2_000, 24)):
        monkeypatch.setattr(R, "BLOCK", floor)
        monkeypatch.setattr(R, "GRID", grid)
        got = {r["i"]: r for r in unmerged(spark, lambda: R.support_geometry(df.where("i < 30"), df.where("i >= 30"), "i", "v", 2.0))}
        assert len(got) == 30
        for i in range(30):
            assert abs(got[i]["similarity"] - np.exp(-d[i] / 2).max()) < 1e-9 and abs(got[i]["density"] - np.exp(-d[i] / 2).mean()) < 1e-9 and abs(got[i]["mass"] - (d[i] <= 2).mean()) < 1e-9


def test_blocks_meet_in_steps():
    import tracemalloc

    rng = np.random.default_rng(19)
    x, y, i = rng.normal(size=(2_000, 3)), rng.normal(size=(2_000, 3)), np.arange(2_000)
    least = R.least_distances(1)
    tracemalloc.start()
    got = R.in_steps(least)(i, x, i, y)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 16e6 and got.equals(least(i, x, i, y))  # one product of all of them has 32 MB


def test_quantiles_without_a_sorted_pool(spark):
    rng = np.random.default_rng(8)
    rows = [(int(rng.integers(0, 3)), int(rng.integers(1990, 1996)), float(round(v, 1))) for v in rng.normal(size=400) * 10] + [(0, 1990, 0.0), (1, 1991, -0.0), (2, 1992, 1e-300)]
    df = spark.createDataFrame(rows, "g int, y int, v double")
    rank = lambda n, level: min(n, max(1, int(np.ceil(round((n + 1) * level, 9)))))
    for r in A.finite_sample_quantile(df, ["g"], "v", [0.1, 0.5, 0.99]).collect():
        own = sorted(v for g, _, v in rows if g == r["g"])
        assert r["n"] == len(own) and r["q"] == own[rank(len(own), r["level"]) - 1]
    got = A.prior_quantile(df, "y", "v", [0.5, 0.9]).collect()
    assert {r["test_period"] for r in got} == set(range(1991, 1996))
    for r in got:
        own = sorted(v for _, y, v in rows if y < r["test_period"])
        assert r["n"] == len(own) and r["periods"] == r["test_period"] - 1990 and r["q"] == own[rank(len(own), r["level"]) - 1]


def test_numbers_over_ranges(spark):
    df = spark.createDataFrame([(i * 7 % 101, "x") for i in range(101)] + [(None, "y")], "k long, s string").repartition(5)
    got = sorted((r["n"], r["k"]) for r in W.numbered(df, ["k"], "n").collect() if r["k"] is not None)
    assert got == [(i + 1, i) for i in range(101)]


def test_archives(spark):
    import io
    import tarfile
    import zipfile

    from hindcast.sources import archives

    def tar(*names):
        out = io.BytesIO()
        with tarfile.open(fileobj=out, mode="w:gz") as t:
            for name in names:
                info = tarfile.TarInfo(name)
                info.size = 2
                t.addfile(info, io.BytesIO(b"ab"))
        return out.getvalue()

    def zip_(*names):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            for name in names:
                z.writestr(name, b"ab")
        return out.getvalue()

    table = lambda data: spark.createDataFrame([("x", bytearray(data))], "path string, content binary")
    assert [r["member"] for r in archives.archive_members(table(tar("a/b.csv", "c.csv")), "tar").collect()] == ["a/b.csv", "c.csv"]
    assert [bytes(r["content"]) for r in archives.archive_members(table(zip_("a.csv")), "zip", only=True).collect()] == [b"ab"]
    for data, kind, only in ((tar("../x"), "tar", False), (tar("/x"), "tar", False), (zip_("a/../../x"), "zip", False), (zip_("a", "b"), "zip", True)):
        with pytest.raises(PySparkException):
            archives.archive_members(table(data), kind, only=only).collect()


def test_queries_without_sql_against_numpy(spark):
    """Ridge, principal shares, correlation tests, k-means and model families over a whole table."""
    from hindcast.plans import models

    d = "/root/testdata/sf0.001"
    e = pd.read_parquet(f"{d}/embeddings.parquet").sort_values("vec_id")
    x, y, odd = np.stack(e.embedding.to_numpy()).astype(float), e.label.to_numpy(dtype=float), e.vec_id.to_numpy() % 2 == 1
    mean, sd = x[~odd].mean(0), x[~odd].std(0)
    z = (x - mean) / sd
    beta = np.linalg.solve(z[~odd].T @ z[~odd] + np.eye(x.shape[1]), z[~odd].T @ (y[~odd] - y[~odd].mean()))
    miss = z[odd] @ beta + y[~odd].mean() - y[odd]
    got = models.ridge_predictions(spark, d).first()
    assert got["n"] == odd.sum() and abs(got["rmse"] - np.sqrt((miss**2).mean())) < 1e-3
    w = np.linalg.eigvalsh(np.cov(x.T))[::-1]
    got = models.principal_shares(spark, d).orderBy("component").collect()
    assert np.allclose([r["share"] for r in got], (w / w.sum())[:10], atol=1e-4) and np.allclose([r["cumulative"] for r in got], (np.cumsum(w) / w.sum())[:10], atol=1e-4)
    assert sum(r["rows"] for r in models.cluster_folds(spark, d).collect()) == len(e)
    base = np.sqrt(((y[odd] - y[~odd].mean()) ** 2).mean())
    assert all(r["n"] == odd.sum() and r["rmse"] < 2 * base for r in models.model_families(spark, d).collect())
    for r in models.kernel_ridge(spark, d).collect():
        test = (e.vec_id.to_numpy() % 2) == r["fold"]
        assert r["n"] == test.sum() and r["rmse"] < 1.5 * base
    got = {(r["label"], r["rows"], r["rank"]) for r in models.mixed_kernel_ranks(spark, d).collect()}
    for label, many, rank in got:
        own = x[y == label][: M.LANDMARKS]
        assert many == len(own)
        w = np.maximum(np.linalg.eigvalsh(M.mixed_kernel([own[:, :32], own[:, 32:]]))[::-1], 0)
        assert rank == int(np.searchsorted(np.cumsum(w) / w.sum(), 0.9)) + 1


def test_correlation_p_values_against_sampling():
    rng = np.random.default_rng(11)
    for size in (5, 12, 40):
        r = np.array([np.corrcoef(rng.normal(size=(2, size)))[0, 1] for _ in range(20_000)])
        for at in (0.2, 0.5):
            assert abs(M.correlation_p_value(at, size) - (np.abs(r) >= at).mean()) < 0.015


def test_upper_median_of_dates(spark):
    import datetime

    from hindcast.operators.aggregates import upper_median

    day = lambda n: datetime.date(1969, 12, 20) + datetime.timedelta(n)
    groups = {"one": [3], "even": [9, 1, 4, 20], "odd": [30, 2, 2], "ties": [5, 5, 7, 7], "none": [None], "some": [None, 8, 6]}
    df = spark.createDataFrame([(k, None if n is None else day(n)) for k, each in groups.items() for n in each], "k string, d date")
    got = {r.k: r.m for r in df.groupBy("k").agg(upper_median("d").alias("m")).collect()}
    want = {k: sorted(n for n in each if n is not None) for k, each in groups.items()}
    assert got == {k: day(v[len(v) // 2]) if v else None for k, v in want.items()}
