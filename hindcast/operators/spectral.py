"""Maps and folds from a spectrum: multi-kernel eigen-maps, projection support, principal scores, k-means, genetic values.

What a spectrum is taken of is bounded: the Gram sums of all rows (features squared) or a documented number of landmarks.
Scores are then computed for every row where it lies.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hindcast.sources.scratch import stored

from .draws import drawn
from .estimators import LANDMARKS, golden, gram, gram_matrix, median_bandwidth, rbf_kernel
from .structured import grouped_gram


@dataclass
class KernelMap:
    """Equal-weight mean of an RBF kernel per block of features, on landmarks, and its leading directions."""

    blocks: list[list[int]]
    mean: np.ndarray
    sd: np.ndarray
    landmarks: np.ndarray
    widths: list[float]
    roots: np.ndarray
    values: np.ndarray

    def scores(self, rows: np.ndarray) -> np.ndarray:
        """Inner products of scores are the kernel's, as far as the kept directions hold it."""
        z = (rows - self.mean) / self.sd
        k = sum(rbf_kernel(z[:, b], self.landmarks[:, b], w) for b, w in zip(self.blocks, self.widths, strict=True)) / len(self.blocks)
        return k @ self.roots

    @property
    def effective_rank(self) -> float:
        """Squared sum of the positive eigenvalues over the sum of their squares."""
        return float(self.values.sum() ** 2 / (self.values**2).sum()) if len(self.values) else 0.0

    @property
    def rank(self) -> int:
        return self.roots.shape[1]


def kernel_map(train: DataFrame, id_col: str, vec: str, blocks: Sequence[Sequence[int]], rank: int, multiplier: float = 1.0, landmarks: int = LANDMARKS) -> KernelMap | None:
    """The map of training rows alone: scaled by their sums, each block with its own median squared distance as bandwidth.

    At most ``landmarks`` training rows span the map, those whose id has the least md5; with as many as there are rows it is
    the kernel's own eigen-map. multiplier shortens the bandwidth. None without training rows.
    """
    g = gram_matrix(gram(train, vec))
    if not len(g):
        return None
    mean = g[0, 1:] / g[0, 0]
    sd = np.sqrt(np.maximum(np.diag(g)[1:] / g[0, 0] - mean**2, 0))
    sd[sd <= 1e-12] = 1.0
    picked = train.orderBy(F.md5(F.col(id_col).cast("string")), id_col).limit(landmarks).select(F.transform(vec, lambda x: x.cast("double")).alias("v")).collect()
    z = (np.array([r["v"] for r in picked]) - mean) / sd
    blocks = [list(b) for b in blocks]
    widths = [median_bandwidth(z[:, b]) / multiplier for b in blocks]
    k = sum(rbf_kernel(z[:, b], z[:, b], w) for b, w in zip(blocks, widths, strict=True)) / len(blocks)
    w, v = np.linalg.eigh((k + k.T) / 2)
    w, v = w[::-1], v[:, ::-1]
    positive = w > 1e-10
    keep = max(1, min(rank, int(positive.sum()), len(z) - 1))
    return KernelMap(blocks, mean, sd, z, widths, v[:, :keep] / np.sqrt(w[:keep]), w[positive])


def map_scores(found: KernelMap, vec: str) -> Column:
    """Scores of each row, training row or not, as an array."""

    @F.pandas_udf("array<double>")
    def scores(rows: pd.Series) -> pd.Series:
        return pd.Series(list(found.scores(np.stack(rows.to_numpy()).astype(float)))) if len(rows) else rows

    return scores(vec)


def projection_support(scores: Column) -> Column:
    """How much of a row's own kernel the kept directions of training hold, 0 to 1; the rest is its residual.

    That is k' K+ k over the kept directions, which is the squared length of the row's scores.
    """
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.aggregate(scores, F.lit(0.0), lambda s, x: s + x * x)))


def principal_scores(df: DataFrame, vec: str, components: int, name: str = "scores") -> DataFrame:
    """df with its rows' scores on the leading principal components; each component's largest coefficient is positive."""
    g = gram_matrix(gram(df, vec))
    if not len(g):
        return df.withColumn(name, F.lit(None).cast("array<double>"))
    mean = g[0, 1:] / g[0, 0]
    _, v = np.linalg.eigh(g[1:, 1:] - g[0, 0] * np.outer(mean, mean))
    v = v[:, ::-1][:, :components]
    v = v * np.sign(v[np.abs(v).argmax(0), np.arange(v.shape[1])])

    @F.pandas_udf("array<double>")
    def scores(rows: pd.Series) -> pd.Series:
        return pd.Series(list((np.stack(rows.to_numpy()).astype(float) - mean) @ v)) if len(rows) else rows

    return df.withColumn(name, scores(vec))


def first_centres(df: DataFrame, id_col: str, vec: str, k: int, starts: int) -> np.ndarray:
    """(start, cluster, feature): k rows at random for each start, by keyed hashes of their ids."""
    rows = drawn(df, id_col, [vec], starts, k).orderBy("draw", "place").collect()  # starts * k rows
    return np.array([r[vec] for r in rows], float).reshape(starts, -1, len(rows[0][vec])) if rows else np.zeros((starts, 0, 0))


def assigned(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    d = np.maximum((x**2).sum(1)[:, None] + (centres**2).sum(1)[None, :] - 2 * x @ centres.T, 0)
    return d.argmin(1), d.min(1)


def k_means(df: DataFrame, id_col: str, vec: str, k: int, starts: int = 20, most: int = 100) -> tuple[np.ndarray, float]:
    """Centres of the best of several starts, and its sum of squared distances. All starts share each pass over the rows.

    Batches add up each start's sums per cluster, and only those are shuffled: starts * k rows for each task. A start is done
    when its centres hold still; an emptied cluster keeps its centre. Clusters are numbered by their centres, in order.
    """
    data = stored(df.select(F.col(id_col).alias("i"), F.transform(vec, lambda x: x.cast("double")).alias("v")), "points")
    centres = first_centres(data, "i", "v", k, starts)
    if not centres.size:
        return centres.reshape(0, 0), 0.0
    open_, cost = list(range(starts)), np.full(starts, np.inf)
    width = centres.shape[2]
    for _ in range(most):
        now = {s: centres[s] for s in open_}

        def sums(batches: Iterator[pd.DataFrame], now=now) -> Iterator[pd.DataFrame]:
            total = {s: np.zeros((len(c), width + 2)) for s, c in now.items()}
            for b in batches:
                if len(b):
                    x = np.stack(b["v"].to_numpy())
                    for s, c in now.items():
                        at, d = assigned(x, c)
                        np.add.at(total[s], at, np.column_stack([np.ones(len(x)), d, x]))
            for s, t in total.items():
                yield pd.DataFrame({"s": s, "c": np.repeat(np.arange(len(t)), width + 2), "f": np.tile(np.arange(width + 2), len(t)), "v": t.ravel()})

        rows = data.mapInPandas(sums, "s int, c int, f int, v double").groupBy("s", "c", "f").agg(F.sum("v").alias("v")).collect()
        total = np.zeros((starts, centres.shape[1], width + 2))
        for r in rows:
            total[r["s"], r["c"], r["f"]] = r["v"]
        still = []
        for s in open_:
            n = total[s, :, :1]
            new = np.where(n > 0, total[s, :, 2:] / np.maximum(n, 1), centres[s])
            cost[s] = total[s, :, 1].sum()
            if np.abs(new - centres[s]).max() > 1e-9:
                still.append(s)
            centres[s] = new
        open_ = still
        if not open_:
            break
    best = int(np.argmin(np.round(cost, 6)))
    found = centres[best]
    return found[np.lexsort(found.T[::-1])], float(cost[best])


def cluster_of(centres: np.ndarray, vec: str) -> Column:
    @F.pandas_udf("long")
    def cluster(rows: pd.Series) -> pd.Series:
        return pd.Series(assigned(np.stack(rows.to_numpy()).astype(float), centres)[0]) if len(rows) else pd.Series([], dtype="int64")

    return cluster(vec)


def reml_of_sums(g: np.ndarray, low: float = -12.0, high: float = 12.0) -> tuple[float, np.ndarray, np.ndarray, np.ndarray, bool]:
    """log delta, scaling mean and sd, coefficients (mean of the target first), and whether the search ended at a bound.

    Profile REML with an intercept and the relationship of standardised features Z Z' / p. Sums of features squared hold
    all that it needs, and the genetic values of any rows are Z times the coefficients.
    """
    n, mean = g[0, 0], g[0, 1:] / g[0, 0]
    c = g[1:, 1:] - n * np.outer(mean, mean)
    p = len(c) - 1
    sd = np.sqrt(np.maximum(np.diag(c)[:-1] / n, 0))
    sd[sd <= 1e-12] = 1.0
    w, v = np.linalg.eigh(c[:-1, :-1] / np.outer(sd, sd) / p)
    along = v.T @ (c[:-1, -1] / sd)
    keep = w > 1e-10
    part = along[keep] ** 2 / (p * w[keep])
    rest, free = max(c[-1, -1] - part.sum(), 0.0), n - keep.sum()

    def loss(t: float) -> float:
        s, d = w[keep] + np.exp(t), np.exp(t)
        q = max((part / s).sum() + rest / d, 1e-300)
        return (n - 1) * np.log(q / (n - 1)) + np.log(s).sum() + free * t + np.log(n / d)

    t = golden(loss, low, high)
    beta = v @ (along / (np.maximum(w, 0) + np.exp(t))) / p
    return t, mean[:-1], sd, np.concatenate([[mean[-1]], beta]), min(t - low, high - t) < 1e-3


def cross_fitted_values(df: DataFrame, fold: str, vec: str, target: str) -> tuple[DataFrame, list[tuple]]:
    """df with ``predicted``, each fold's rows by the other folds alone; and (fold, log delta, at a bound) of each fit.

    One pass gives the Gram sums of each fold; the training sums of a fold are the total less its own. Folds are few: their
    sums reach the driver, features squared each.
    """
    parts: dict = {}
    for r in grouped_gram(df, [fold], vec, target).collect():
        parts.setdefault(r[fold], []).append((r["i"], r["j"], r["v"]))
    size = 1 + max((j for part in parts.values() for _, j, _ in part), default=0)
    sums = {}
    for key, part in parts.items():
        g = np.zeros((size, size))
        for i, j, v in part:
            g[i, j] = g[j, i] = v
        sums[key] = g
    total = sum(sums.values()) if sums else 0
    rows, fits = [], []
    for key, g in sums.items():
        if (total - g)[0, 0] < 3:
            continue
        t, mean, sd, beta, edge = reml_of_sums(total - g)
        slope = beta[1:] / sd
        rows.append((key, [float(beta[0] - slope @ mean), *map(float, slope)]))
        fits.append((key, float(t), bool(edge)))
    fitted = df.sparkSession.createDataFrame(rows, f"_fold {df.schema[fold].dataType.simpleString()}, _w array<double>")
    x = F.concat(F.array(F.lit(1.0)), F.transform(vec, lambda v: v.cast("double")))
    out = df.join(F.broadcast(fitted), df[fold].eqNullSafe(fitted["_fold"]), "left")  # a row per fold
    value = F.aggregate(F.zip_with(x, "_w", lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    return out.withColumn("predicted", value).drop("_fold", "_w"), fits
