"""Entity, context and interaction effects over all cells: structured kernel ridge by conjugate gradient, product features.

No cell meets another: a kernel of entity features acts through sums per fit and per context, which are as wide as the
features. Several fits (folds, designs, models) are solved side by side, so the passes over the cells are those of one.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hindcast.sources.scratch import stored


def dot(a: Sequence[Column], b: Sequence[Column]) -> Column:
    return reduce(lambda s, x: s + x, (x * y for x, y in zip(a, b, strict=True)), F.lit(0.0))


def context_blocks(state: DataFrame, names: Sequence[str], alpha: float) -> DataFrame:
    """(fit, context, gram, inverse): Z'Z of the context's cells, and the inverse of it plus alpha / gamma, row by row."""
    p = len(names)
    upper = [(i, j) for i in range(p) for j in range(i, p)]
    sums = state.groupBy("_fit", "_context").agg(F.first("_gamma").alias("_gamma"), *[F.sum(F.col(names[i]) * F.col(names[j])).alias(f"_s{i}_{j}") for i, j in upper])
    full = sums.select("_fit", "_context", "_gamma", F.array(*[F.col(f"_s{min(i, j)}_{max(i, j)}") for i in range(p) for j in range(p)]).alias("gram"))

    @F.pandas_udf("array<double>")
    def inverse(gram: pd.Series, gamma: pd.Series) -> pd.Series:
        out = [np.linalg.inv(np.reshape(s, (p, p)) + alpha / g * np.eye(p)).ravel() if g > 0 else np.zeros(p * p) for s, g in zip(gram, gamma, strict=True)]
        return pd.Series(out, dtype=object)

    return full.withColumn("inverse", inverse("gram", "_gamma"))


def through_block(alpha: float) -> Column:
    """A residual's context sums r through the block: h = inverse r, the preconditioned sums t, and two products."""

    @F.pandas_udf("h array<double>, t array<double>, rh double, hsh double")
    def through(r: pd.Series, gram: pd.Series, inverse: pd.Series) -> pd.DataFrame:
        out = []
        for x, s, v in zip(r, gram, inverse, strict=True):
            h = np.reshape(v, (len(x), len(x))) @ x
            sh = np.reshape(s, (len(x), len(x))) @ h
            out.append((h, (x - sh) / alpha, float(x @ h), float(h @ sh)))
        return pd.DataFrame(out, columns=["h", "t", "rh", "hsh"])

    return through("r", "gram", "inverse")


def structured_ridge(cells: DataFrame, fit: str, context: str, features: Sequence[str], residual: str, gamma: str, alpha: float, tolerance: float = 1e-7, most: int = 1_000) -> tuple[DataFrame, DataFrame, int]:
    """Solve (K + gamma * K within a context + alpha * I) c = residual for each fit; K is the product of entity features.

    cells: one row per training cell with its fit, context, entity features, residual and the fit's gamma. Returns (whole,
    within, steps): the sums of c times features of each fit, and of each fit and context. They are all that a prediction
    needs: features . (whole + gamma * within), see ``structured_values``.

    Conjugate gradient, in the form that needs one reduction a step. The product of the matrix with a vector is the sums of
    the vector times features per fit and context, joined back to the cells. The part within contexts and the diagonal are
    the preconditioner: its inverse acts through a matrix of features squared for each context, and what it leaves has the
    rank of the features, so a fit takes about one step per feature, whatever the cells and contexts.

    Sums are taken before the shuffle, so a context with a third of the cells is a row for each task. Vectors are columns of
    the cells' table, which each step writes anew: lineage ends there and memory holds no vector. Only one row per fit reaches
    the driver. A fit ends when its residual is under ``tolerance`` of its right side; when all have, the loop ends.
    """
    names = [f"_z{k}" for k in range(len(features))]
    z = [F.col(n) for n in names]
    own = cells.select(F.col(fit).alias("_fit"), F.col(context).alias("_context"), F.col(gamma).cast("double").alias("_gamma"), *[F.col(f).cast("double").alias(n) for f, n in zip(features, names, strict=True)], F.col(residual).cast("double").alias("_r"))
    state = stored(own.select("*", *[F.lit(0.0).alias(n) for n in ("_x", "_p", "_q")]), "cells")
    blocks = stored(context_blocks(state, names, alpha), "blocks")
    kind = cells.schema[fit].dataType.simpleString()
    scalars: dict = {}
    for steps in range(most + 1):
        sums = state.groupBy("_fit", "_context").agg(F.array(*[F.sum(F.col("_r") * c) for c in z]).alias("r"), F.sum(F.col("_r") * F.col("_r")).alias("rr"))
        met = sums.join(blocks, ["_fit", "_context"]).withColumn("u", through_block(alpha))
        within = stored(met.select("_fit", "_context", "_gamma", "rr", "u.*"), "sums")
        t = [F.get("t", k) for k in range(len(names))]
        rows = within.groupBy("_fit").agg(F.array(*[F.sum(c) for c in t]).alias("g"), F.sum("rr").alias("rr"), F.sum("rh").alias("rh"), F.sum("hsh").alias("hsh"), F.sum(F.col("_gamma") * dot(t, t)).alias("tt")).collect()  # one row per fit
        moves = []
        for r in rows:
            old, beta, step, start = scalars.get(r["_fit"]), 0.0, 0.0, scalars[r["_fit"]][2] if r["_fit"] in scalars else r["rr"]
            ru, uu = (r["rr"] - r["rh"]) / alpha, (r["rr"] - 2 * r["rh"] + r["hsh"]) / alpha**2
            done = r["rr"] <= tolerance**2 * start or ru <= 0
            if not done:
                delta = sum(x * x for x in r["g"]) + r["tt"] + alpha * uu
                beta = ru / old[0] if old else 0.0
                step = ru / (delta - (beta * ru / old[1] if beta else 0.0))
                scalars[r["_fit"]] = (ru, step, start)
            moves.append((r["_fit"], r["g"], step, beta, done))
        if steps == most or all(m[-1] for m in moves):
            break
        table = F.broadcast(state.sparkSession.createDataFrame(moves, f"_fit {kind}, g array<double>, step double, beta double, done boolean"))  # one row per fit
        joined = state.join(within.select("_fit", "_context", "h", "t"), ["_fit", "_context"]).join(table, "_fit")
        part = lambda c: [F.get(c, k) for k in range(len(names))]
        u = (F.col("_r") - dot(z, part("h"))) / alpha
        product = dot(z, part("g")) + F.col("_gamma") * dot(z, part("t")) + alpha * u
        p, q = u + F.col("beta") * F.col("_p"), product + F.col("beta") * F.col("_q")
        state = stored(joined.select("_fit", "_context", "_gamma", *names, (F.col("_r") - F.col("step") * q).alias("_r"), (F.col("_x") + F.col("step") * p).alias("_x"), p.alias("_p"), q.alias("_q")), "cells")
    answer = [F.sum(F.col("_x") * c).alias(n) for c, n in zip(z, features, strict=True)]
    inside = stored(state.groupBy("_fit", "_context").agg(*answer), "within").select(F.col("_fit").alias(fit), F.col("_context").alias(context), *features)
    return inside.groupBy(fit).agg(*[F.sum(f).alias(f) for f in features]), inside, steps


def structured_values(rows: DataFrame, whole: DataFrame, within: DataFrame, fit: str, context: str, features: Sequence[str], gamma: str, name: str = "value") -> DataFrame:
    """rows with the kernel part of their prediction; a context that training lacks has no interaction."""
    w = whole.select(F.col(fit).alias("_fit"), *[F.col(f).alias(f"_w{k}") for k, f in enumerate(features)])
    e = within.select(F.col(fit).alias("_fit2"), F.col(context).alias("_context"), *[F.col(f).alias(f"_e{k}") for k, f in enumerate(features)])
    out = rows.join(w, rows[fit] == w["_fit"], "left").join(e, (rows[fit] == e["_fit2"]) & (rows[context] == e["_context"]), "left")
    part = lambda c: [F.coalesce(F.col(f"_{c}{k}"), F.lit(0.0)) for k in range(len(features))]
    z = [F.col(f) for f in features]
    return out.withColumn(name, dot(z, part("w")) + F.col(gamma) * dot(z, part("e"))).select(*rows.columns, name)


def product_features(a: Column, b: Column, width: int | None = None) -> Column:
    """Products of two feature vectors as an array: all of them, or hashed and signed into ``width`` sums (tensor sketch).

    Each side's features go to a bucket and a sign by a fixed seed; the sketch of the products is the circular convolution
    of both sides' sketches, so no product is formed. Its inner products are those of all products, in the mean.
    """

    def seeded(n: int, seed: int) -> np.ndarray:
        rng = np.random.Generator(np.random.PCG64([seed, n, width or 0]))
        out = np.zeros((n, width or 0))
        out[np.arange(n), rng.integers(0, width, n)] = rng.choice([-1.0, 1.0], n)
        return out

    @F.pandas_udf("array<double>")
    def products(x: pd.Series, y: pd.Series) -> pd.Series:
        if not len(x):
            return x
        p, q = np.stack(x.to_numpy()).astype(float), np.stack(y.to_numpy()).astype(float)
        if width is None:
            return pd.Series(list((p[:, :, None] * q[:, None, :]).reshape(len(p), -1)))
        f = np.fft.rfft(p @ seeded(p.shape[1], 1)) * np.fft.rfft(q @ seeded(q.shape[1], 2))
        return pd.Series(list(np.fft.irfft(f, n=width)))

    return products(a, b)


def grouped_gram(df: DataFrame, keys: Sequence[str], vec: str, target: str) -> DataFrame:
    """(keys, i, j, v): Gram sums as of ``estimators.gram``, of each key, for i up to j. Batches add up before the shuffle.

    A task holds the matrices of at most 64 keys at a time.
    """
    keys = list(keys)
    kinds = ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in keys)

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple, np.ndarray] = {}

        def rows() -> pd.DataFrame:
            parts = []
            for key, m in held.items():
                i, j = np.triu_indices(len(m))
                parts.append(pd.DataFrame({**dict(zip(keys, key, strict=True)), "i": i, "j": j, "v": m[i, j]}))
            held.clear()
            return pd.concat(parts)

        for b in batches:
            for key, part in b.groupby(keys, sort=False, dropna=False):
                x = np.column_stack([np.ones(len(part)), np.stack(part["x"].to_numpy()), part["y"].to_numpy()])
                held[key] = held.get(key, 0) + x.T @ x
                if len(held) > 64:
                    yield rows()
        if held:
            yield rows()

    own = df.select(*keys, F.transform(F.col(vec), lambda x: x.cast("double")).alias("x"), F.col(target).cast("double").alias("y"))
    return own.mapInPandas(partial, f"{kinds}, i int, j int, v double").groupBy(*keys, "i", "j").agg(F.sum("v").alias("v"))


def ridge_of_sums(g: np.ndarray, picked: Sequence[int], alpha: float) -> np.ndarray:
    """Intercept and coefficients on the picked features, standardised by the summed rows; the intercept is free."""
    at = np.array(picked, int) + 1
    n, mean, y = g[0, 0], g[0, at] / g[0, 0], g[0, -1] / g[0, 0]
    c = g[np.ix_(at, at)] - n * np.outer(mean, mean)
    sd = np.sqrt(np.maximum(np.diag(c) / n, 0))
    sd[sd <= 1e-12] = 1.0
    beta = np.linalg.solve(c / np.outer(sd, sd) + alpha * np.eye(len(at)), (g[at, -1] - n * mean * y) / sd) / sd if len(at) else np.zeros(0)
    return np.concatenate([[y - beta @ mean], beta])


def fitted_models(train: DataFrame, keys: Sequence[str], vec: str, target: str, models: dict[str, Sequence[int]], alpha: float) -> DataFrame:
    """(keys, model, coefficients): ridge of each model's features for each key, all from one pass over the training rows.

    A model without features is the mean. coefficients: intercept first, then one per feature of vec, zero where the model
    leaves it out. A group holds the square of the features.
    """
    keys = list(keys)
    kinds = ", ".join(f"{k} {train.schema[k].dataType.simpleString()}" for k in keys)

    def solve(part: pd.DataFrame) -> pd.DataFrame:
        n = int(part["j"].max()) + 1
        g = np.zeros((n, n))
        g[part["i"], part["j"]] = g[part["j"], part["i"]] = part["v"]
        out = []
        for name, picked in models.items():
            full = np.zeros(n - 1)
            full[[0, *(k + 1 for k in picked)]] = ridge_of_sums(g, picked, alpha)
            out.append({**{k: part[k].iloc[0] for k in keys}, "model": name, "coefficients": full})
        return pd.DataFrame(out)

    return grouped_gram(train, keys, vec, target).groupBy(*keys).applyInPandas(solve, f"{kinds}, model string, coefficients array<double>")


def predicted_by(test: DataFrame, fitted: DataFrame, keys: Sequence[str], vec: str) -> DataFrame:
    """test rows for each model of their key, with ``model`` and ``predicted``. fitted has a row per key and model."""
    out = test.join(fitted, list(keys))
    x = F.concat(F.array(F.lit(1.0)), F.transform(vec, lambda v: v.cast("double")))
    return out.withColumn("predicted", F.aggregate(F.zip_with(x, "coefficients", lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)).drop("coefficients")

