"""Structured ridge, product features, kernel maps, principal scores, k-means, genetic values, draws, blocks and sums, each against numpy."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from hindcast.operators import draws as D
from hindcast.operators import spectral as P
from hindcast.operators import structured as S
from hindcast.operators.estimators import LANDMARKS, median_bandwidth, rbf_kernel, reml_blup
from hindcast.sources import blocks as B


@pytest.fixture(scope="module")
def cells():
    rng = np.random.default_rng(5)
    z = rng.normal(size=(9, 3)) / np.sqrt(3)
    rows = [(f, f"e{e}", g, *map(float, z[g]), float(rng.normal() + z[g, 0] * e), gamma) for f, gamma in (("one", 0.0), ("two", 0.7)) for e in range(6) for g in range(9) if (g + e) % 4]
    return rows


def dense(rows, alpha):
    z = np.array([r[3:6] for r in rows])
    same = np.array([[a[1] == b[1] for b in rows] for a in rows])
    k = (z @ z.T) * (1 + rows[0][7] * same)
    return np.linalg.solve(k + alpha * np.eye(len(rows)), np.array([r[6] for r in rows])), z


def test_structured_ridge_equals_a_dense_solve(spark, cells):
    schema = "fit string, context string, entity int, a double, b double, c double, y double, gamma double"
    df = spark.createDataFrame(cells, schema).repartition(3)
    whole, within, steps = S.structured_ridge(df, "fit", "context", ["a", "b", "c"], "y", "gamma", 0.5)
    assert 0 < steps <= 6  # about one for each feature
    unseen = [("two", "new", 1, 0.3, -0.2, 0.9, 0.0, 0.7), ("two", "e1", 1, 0.3, -0.2, 0.9, 0.0, 0.7)]
    got = {(r["fit"], r["context"], r["entity"]): r["value"] for r in S.structured_values(spark.createDataFrame([*cells, *unseen], schema), whole, within, "fit", "context", ["a", "b", "c"], "gamma").collect()}
    for fit in ("one", "two"):
        rows = [r for r in cells if r[0] == fit]
        c, z = dense(rows, 0.5)
        for r in [*rows, *[u for u in unseen if u[0] == fit]]:
            own = np.array(r[3:6])
            want = own @ (z.T @ c) + r[7] * own @ (z.T @ (c * [x[1] == r[1] for x in rows]))
            assert abs(got[r[0], r[1], r[2]] - want) < 1e-5 or (r[1], r[2]) == ("e1", 1)
    c, z = dense([r for r in cells if r[0] == "two"], 0.5)
    sums = {r["context"]: np.array(r[2:]) for r in within.where("fit = 'two'").collect()}
    for e, v in sums.items():
        assert np.allclose(v, z.T @ (c * [r[1] == e for r in cells if r[0] == "two"]), atol=1e-6)


def test_structured_ridge_without_signal_or_rows(spark, cells):
    schema = "fit string, context string, entity int, a double, b double, c double, y double, gamma double"
    flat = spark.createDataFrame([(*r[:6], 0.0, r[7]) for r in cells], schema)
    whole, _, steps = S.structured_ridge(flat, "fit", "context", ["a", "b", "c"], "y", "gamma", 0.5)
    assert steps == 0 and all(r["a"] == 0 for r in whole.collect())
    assert S.structured_ridge(flat.limit(0), "fit", "context", ["a"], "y", "gamma", 0.5)[0].count() == 0


def test_product_features(spark):
    rng = np.random.default_rng(6)
    a, b = rng.normal(size=(40, 3)), rng.normal(size=(40, 4))
    df = spark.createDataFrame([(i, x.tolist(), y.tolist()) for i, (x, y) in enumerate(zip(a, b, strict=True))], "i int, a array<double>, b array<double>")
    rows = df.select("i", S.product_features(F.col("a"), F.col("b")).alias("all"), S.product_features(F.col("a"), F.col("b"), 512).alias("few")).orderBy("i").collect()
    whole, few = np.array([r["all"] for r in rows]), np.array([r["few"] for r in rows])
    want = (a[:, :, None] * b[:, None, :]).reshape(40, 12)
    assert np.allclose(whole, want)
    assert np.corrcoef((few @ few.T).ravel(), (want @ want.T).ravel())[0, 1] > 0.9
    # with more buckets than products none of them meet, for some seed; the sketch then is the products, placed and signed
    assert np.allclose(np.sort(np.abs(few[0][np.abs(few[0]) > 1e-9])), np.sort(np.abs(want[0]))) or len(few[0][np.abs(few[0]) > 1e-9]) < 12


def test_models_of_one_pass(spark):
    rng = np.random.default_rng(7)
    x, fold = rng.normal(size=(60, 4)), rng.integers(0, 2, 60)
    y = x @ [1.0, -2.0, 0.0, 0.5] + rng.normal(size=60)
    df = spark.createDataFrame([(int(f), v.tolist(), float(t)) for f, v, t in zip(fold, x, y, strict=True)], "fold int, x array<double>, y double").repartition(3)
    models = {"mean": [], "two": [0, 1], "all": [0, 1, 2, 3]}
    got = {(r["fold"], r["model"]): np.array(r["coefficients"]) for r in S.fitted_models(df, ["fold"], "x", "y", models, 2.0).collect()}
    for f in (0, 1):
        own, t = x[fold == f], y[fold == f]
        z = (own - own.mean(0)) / own.std(0)
        for name, at in models.items():
            beta = np.linalg.solve(z[:, at].T @ z[:, at] + 2 * np.eye(len(at)), z[:, at].T @ (t - t.mean())) / own.std(0)[at] if at else np.zeros(0)
            full = np.zeros(4)
            full[at] = beta
            assert np.allclose(got[f, name], [t.mean() - full @ own.mean(0), *full])
    p = S.predicted_by(df, spark.createDataFrame([(k[0], k[1], v.tolist()) for k, v in got.items()], "fold int, model string, coefficients array<double>"), ["fold"], "x")
    assert p.count() == 180 and all(abs(r["predicted"] - (got[r["fold"], r["model"]] @ [1, *r["x"]])) < 1e-9 for r in p.collect())


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(50, 6)) + 3 * rng.integers(0, 3, 50)[:, None]
    y = x @ rng.normal(size=6) + rng.normal(size=50)
    return x, y, spark.createDataFrame([(i, v.tolist(), float(t), i % 4) for i, (v, t) in enumerate(zip(x, y, strict=True))], "i long, v array<double>, y double, fold long").repartition(3).cache()


def test_kernel_map_with_all_rows_as_landmarks(spark, vectors):
    x, _, df = vectors
    train, blocks = x[:30], [[0, 1, 2], [3, 4], [5]]
    found = P.kernel_map(df.where("i < 30"), "i", "v", blocks, 100, landmarks=LANDMARKS)
    z = (x - train.mean(0)) / train.std(0)
    k = sum(rbf_kernel(z[:, b], z[:30][:, b], median_bandwidth(z[:30][:, b])) for b in blocks) / 3
    w, v = np.linalg.eigh(k[:30])
    rows = df.select("i", P.map_scores(found, "v").alias("s")).withColumn("support", P.projection_support(F.col("s"))).orderBy("i").collect()
    scores = np.array([r["s"] for r in rows])
    keep = np.argsort(w)[::-1][: found.rank]
    want = k @ (v[:, keep] / np.sqrt(w[keep]))
    assert found.rank == 29 and np.allclose(scores @ scores.T, want @ want.T, atol=1e-6)
    assert np.allclose([r["support"] for r in rows], np.clip((want**2).sum(1), 0, 1), atol=1e-6)
    assert abs(found.effective_rank - w[w > 1e-10].sum() ** 2 / (w[w > 1e-10] ** 2).sum()) < 1e-6
    few = P.kernel_map(df, "i", "v", blocks, 3, landmarks=20)
    assert few.rank == 3 and few.landmarks.shape == (20, 6)
    assert P.kernel_map(df.limit(0), "i", "v", blocks, 3) is None


def test_principal_scores(vectors):
    x, _, df = vectors
    got = np.array([r["scores"] for r in P.principal_scores(df, "v", 3).orderBy("i").collect()])
    _, s, vt = np.linalg.svd(x - x.mean(0))
    want = (x - x.mean(0)) @ vt[:3].T
    assert np.allclose(np.abs(got), np.abs(want), atol=1e-6)


def test_k_means_is_the_best_start(vectors):
    x, _, df = vectors
    centres, cost = P.k_means(df, "i", "v", 3, starts=6)
    costs = []
    for c in P.first_centres(df, "i", "v", 3, 6):
        for _ in range(100):
            at, _ = P.assigned(x, c)
            c = np.array([x[at == k].mean(0) if (at == k).any() else c[k] for k in range(3)])
        costs.append(P.assigned(x, c)[1].sum())
    assert abs(cost - min(costs)) < 1e-6 and len(set(np.round(costs, 3))) >= 1
    label = [r["c"] for r in df.select("i", P.cluster_of(centres, "v").alias("c")).orderBy("i").collect()]
    assert abs(sum(((x[i] - centres[c]) ** 2).sum() for i, c in enumerate(label)) - cost) < 1e-6
    assert P.k_means(df.limit(0), "i", "v", 3)[0].size == 0


def test_genetic_values_are_those_of_rows(vectors):
    x, y, df = vectors
    out, fits = P.cross_fitted_values(df, "fold", "v", "y")
    got = {r["i"]: r["predicted"] for r in out.collect()}
    for fold, t, _ in fits:
        train = np.arange(50) % 4 != fold
        z = (x - x[train].mean(0)) / x[train].std(0)
        k = z @ z.T / 6
        want, mu, _, _ = reml_blup(y[train], k[np.ix_(train, train)])
        assert abs(t - want) < 1e-3
        a = np.linalg.solve(k[np.ix_(train, train)] + np.exp(t) * np.eye(train.sum()), y[train] - mu)
        for i in np.flatnonzero(~train):
            assert abs(got[i] - (mu + k[i, train] @ a)) < 1e-3


def test_draws_have_the_moments_of_draws_without_replacement(spark):
    rng = np.random.default_rng(9)
    v = rng.normal(size=300)
    df = spark.createDataFrame([(i, float(x)) for i, x in enumerate(v)], "i long, v double")
    rows = {r["budget"]: r for r in D.drawn_summary(D.drawn_budgets(df.repartition(3), "i", "v", 1.0, [5, 40], 2000)).collect()}
    for b, r in rows.items():
        spread = v.std(ddof=1) * np.sqrt((1 - b / 300) / b)
        assert r["draws"] == 2000 and abs(r["mean"] - v.mean()) < 5 * spread / np.sqrt(2000) and abs(r["spread"] / spread - 1) < 0.1
        assert abs(r["hit_rate"] - (v >= 1).mean()) < 0.02
    one = sorted(map(tuple, D.drawn(df.repartition(5), "i", ["v"], 7, 10).collect()))
    assert one == sorted(map(tuple, D.drawn(df.coalesce(1), "i", ["v"], 7, 10, step=13).collect()))
    keys = D.least_keys(np.array([r[0] for r in df.select(F.xxhash64("i")).collect()]), np.arange(7))
    assert all([x[2] for x in one if x[0] == d] == np.argsort(keys[d])[:10].tolist() for d in range(7))
    assert D.drawn(df.limit(3), "i", ["v"], 2, 10).count() == 6 and D.drawn(df.limit(0), "i", ["v"], 2, 10).count() == 0


def test_draws_by_rank_look_at_each_row_once(spark, monkeypatch):
    df = spark.createDataFrame([(i, float(i)) for i in range(300)], "i long, v double")
    order = [r["i"] for r in df.orderBy(F.expr("shiftrightunsigned(xxhash64(i), 48)"), F.xxhash64("i")).collect()]
    want = {(d, p + 1): order[k] for d in range(7) for p, k in enumerate(np.random.default_rng([1, d]).choice(300, 10, replace=False))}
    for parts in (5, 1):
        rows = D.drawn_by_rank(df.repartition(parts), "i", ["v"], 7, 10).collect()
        assert len(rows) == 70 and {(r["draw"], r["place"]): r["i"] for r in rows} == want and all(r["v"] == r["i"] for r in rows)
    got = D.drawn_by_rank(df.limit(3), "i", ["v"], 2, 10).collect()
    assert sorted((r["draw"], r["place"]) for r in got) == [(d, p) for d in range(2) for p in (1, 2, 3)] and len({(r["draw"], r["i"]) for r in got}) == 6
    assert D.drawn_by_rank(df.limit(0), "i", ["v"], 2, 10).count() == 0
    monkeypatch.setattr(D, "least_keys", None)  # a key for each row and draw
    assert D.drawn_budgets(df, "i", "v", 1.0, [5], 20).count() == 20


def test_blocked_matrix(spark, tmp_path):
    rng = np.random.default_rng(10)
    x = rng.normal(size=(20, 11))
    df = spark.createDataFrame([(f"r{i}", v.tolist()) for i, v in enumerate(x)], "r string, v array<double>").repartition(3)
    path = str(tmp_path / "m")
    B.write_blocks(df, "r", "v", path, 4)
    order = spark.createDataFrame([(0, "r7"), (1, "r2"), (2, "none"), (3, "r7")], "place int, row string")
    got = [tuple(r) for r in B.read_columns(spark, path, [9, 0, 10, 0, 11], 4, order).orderBy("place").collect()]
    want = lambda i: [x[i, 9], x[i, 0], x[i, 10], x[i, 0], None]
    assert got == [(0, "r7", want(7)), (1, "r2", want(2)), (2, "none", None), (3, "r7", want(7))]
    scan = B.read_columns(spark, path, [9, 8], 4)
    assert "PartitionFilters: [isnotnull(block" in scan._jdf.queryExecution().toString() or "block#" in scan._jdf.queryExecution().toString()
    assert len(scan.inputFiles()) < len(spark.read.parquet(path).inputFiles()) or scan.count() == 20


def test_sums_of_batches(spark, tmp_path):
    path = str(tmp_path / "s")
    sums = {"n": F.count("v"), "total": F.sum("v")}
    schema = "k long, n long, total double"
    assert B.total_sums(spark, path, ["k"], schema).count() == 0
    parts = [[(i % 3, float(i)) for i in range(a, b)] for a, b in ((0, 10), (10, 25), (25, 26))]
    for k, part in enumerate([*parts, parts[1]]):
        B.add_sums(spark.createDataFrame(part, "k long, v double"), ["k"], sums, path, 1 if k == 3 else k)
    got = {r["k"]: (r["n"], r["total"]) for r in B.total_sums(spark, path, ["k"], schema).collect()}
    assert got == {k: (len(range(k, 26, 3)), float(sum(range(k, 26, 3)))) for k in range(3)}


SF = "/root/testdata/sf0.001"


def test_structured_models_of_whole_folds_against_dense_kernels(spark):
    from hindcast.plans import kernels as K

    cells, names = K.structured_cells(spark, SF)
    pdf = cells.where("scenario = 0 and regime in ('CV-E', 'SPARSE')").toPandas()
    got = {(r["regime"], r["model"]): r["rmse"] for r in K.structured_models(spark, SF).where("scenario = 0").collect()}
    for key, own in pdf.groupby(["regime", "model"]):
        train, test = own[own.role == "train"], own[own.role == "test"]
        z, x, gamma = train[names].to_numpy(), test[names].to_numpy(), own.gamma.iloc[0]
        c, e = train.context.to_numpy(), test.context.to_numpy()
        k = (z @ z.T) * (1 + gamma * (c[:, None] == c[None, :]))
        a = np.linalg.solve(k + K.ALPHA * np.eye(len(train)), train.residual.to_numpy())
        p = test.baseline.to_numpy() + ((x @ z.T) * (1 + gamma * (e[:, None] == c[None, :]))) @ a
        assert abs(got[key] - np.sqrt(((p - test.observed) ** 2).mean())) < 2e-3 * got[key] / 100


def test_product_models_of_a_fold_against_rows(spark):
    from hindcast.plans import kernels as K

    rows, models = K.product_rows(spark, SF)
    pdf = rows.where("regime = 'SPARSE' and scenario = 2").select("role", "x", "observed").toPandas()
    got = {r["model"]: r["rmse"] for r in K.product_models(spark, SF).where("regime = 'SPARSE' and scenario = 2").collect()}
    x, y, train = np.stack(pdf.x.to_numpy()), pdf.observed.to_numpy(), (pdf.role == "train").to_numpy()
    mean, sd = x[train].mean(0), x[train].std(0)
    z = (x - mean) / np.where(sd > 1e-12, sd, 1)
    assert set(got) == set(models)
    for name, at in models.items():
        b = np.linalg.solve(z[train][:, at].T @ z[train][:, at] + K.ALPHA * np.eye(len(at)), z[train][:, at].T @ (y[train] - y[train].mean())) if at else np.zeros(0)
        p = y[train].mean() + z[~train][:, at] @ b
        assert abs(got[name] - np.sqrt(((p - y[~train]) ** 2).mean())) < 2e-3
