"""Random selections without replacement: the rows with the least keyed hashes, kept by each task and merged."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def least_keys(ids: np.ndarray, draws: np.ndarray) -> np.ndarray:
    """(draw, row): the key of each row in each draw, from the hash of its id."""
    with np.errstate(over="ignore"):
        seeds = mixed(draws.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1))
        return mixed(ids.view(np.uint64)[None, :] ^ seeds[:, None])


def drawn(df: DataFrame, id_col: str, columns: Sequence[str], draws: int, size: int, step: int = 256) -> DataFrame:
    """(draw, place, id, columns): for each draw ``size`` rows at random without replacement, in the order they came out.

    A row's key in a draw is a hash of its id and the draw's number, and the rows with the least keys are drawn: so tasks keep
    ``size`` rows of each draw, whatever they read, and merging tasks is keeping the least again. The first rows of a draw are a
    draw of fewer rows. The same rows are drawn whatever the order and the partitions; ids must be distinct.
    """
    kept = df.select(F.xxhash64(id_col).alias("_h"), F.col(id_col).alias("_id"), *columns)
    schema = "draw int, _key long, " + ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kept.schema.fields[1:])

    def least(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        keys, rows, held = None, None, None
        for b in batches:
            for at in range(0, len(b), step):
                part = b.iloc[at : at + step].reset_index(drop=True)
                own = least_keys(part["_h"].to_numpy(), np.arange(draws))
                place = np.broadcast_to(np.arange(len(part)), own.shape)
                if keys is not None:
                    own, place = np.concatenate([keys, own], axis=1), np.concatenate([rows, place + len(held)], axis=1)
                    part = pd.concat([held, part], ignore_index=True)
                order = np.argsort(own, axis=1, kind="stable")[:, :size]
                keys, rows = np.take_along_axis(own, order, 1), np.take_along_axis(place, order, 1)
                used, back = np.unique(rows, return_inverse=True)  # rows that no draw holds any more are let go
                held, rows = part.iloc[used].reset_index(drop=True), back.reshape(rows.shape)
        if keys is not None:
            out = held.iloc[rows.ravel()].drop(columns="_h").reset_index(drop=True)
            out.insert(0, "_key", (keys ^ np.uint64(1 << 63)).view(np.int64).ravel())
            out.insert(0, "draw", np.repeat(np.arange(draws), rows.shape[1]).astype(np.int32))
            yield out

    merged = kept.mapInPandas(least, schema)
    ranked = merged.withColumn("place", F.row_number().over(Window.partitionBy("draw").orderBy("_key", "_id"))).where(F.col("place") <= size)
    return ranked.select("draw", "place", F.col("_id").alias(id_col), *columns)


#: Leading bits of a hash that number the buckets whose sizes place a rank.
BUCKET_BITS = 16


def drawn_by_rank(df: DataFrame, id_col: str, columns: Sequence[str], draws: int, size: int) -> DataFrame:
    """(draw, place, id, columns) as ``drawn`` has them, for many draws: rows are looked at once, not once a draw.

    Rows stand in the order of a hash of their id. Each draw takes ``size`` ranks of that order at random without replacement,
    from its own seed, and rows meet ranks in a join. Ranks are found from the sizes of 2 ** BUCKET_BITS ranges of the hash,
    the only numbers that pass through the driver. The same rows are drawn whatever the order and the partitions; the first rows
    of a draw are a draw of fewer rows.
    """
    bucket = F.shiftrightunsigned("_h", 64 - BUCKET_BITS).cast("int")
    kept = df.select(F.xxhash64(id_col).alias("_h"), F.col(id_col).alias("_id"), *columns).withColumn("_b", bucket)
    sizes = np.zeros(1 << BUCKET_BITS, np.int64)
    for r in kept.groupBy("_b").agg(F.count(F.lit(1)).alias("n")).collect():  # at most a row per bucket
        sizes[r["_b"]] = r["n"]
    ends = np.cumsum(sizes)
    total = int(ends[-1])
    many = min(size, total)

    def ranks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for draw in b["id"] if many else ():
                own = np.random.default_rng([1, int(draw)]).choice(total, many, replace=False)
                at = np.searchsorted(ends, own, side="right")
                yield pd.DataFrame({"draw": np.int32(draw), "place": np.arange(1, many + 1, dtype=np.int32), "_b": at.astype(np.int32), "_at": (own - (ends - sizes)[at]).astype(np.int32)})

    picks = df.sparkSession.range(draws).mapInPandas(ranks, "draw int, place int, _b int, _at int")
    ranked = kept.withColumn("_at", F.row_number().over(Window.partitionBy("_b").orderBy("_h", "_id")) - 1)
    return ranked.join(picks, ["_b", "_at"]).select("draw", "place", F.col("_id").alias(id_col), *columns)


def drawn_budgets(df: DataFrame, id_col: str, value: str, hit: float, budgets: Sequence[int], draws: int = 5_000) -> DataFrame:
    """(draw, budget, n, mean, best, hit_rate): random selections of each budget; a hit has a value of at least ``hit``."""
    picked = drawn_by_rank(df, id_col, [value], draws, max(budgets)).withColumn("budget", F.explode(F.array(*[F.lit(int(b)) for b in budgets]))).where("place <= budget")
    return picked.groupBy("draw", "budget").agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), F.max(value).alias("best"), F.avg((F.col(value) >= hit).cast("double")).alias("hit_rate"))


def drawn_summary(selections: DataFrame) -> DataFrame:
    """(budget, draws, mean and spread of the selections' means, mean hit rate, mean best)."""
    return selections.groupBy("budget").agg(F.count(F.lit(1)).alias("draws"), F.avg("mean").alias("mean"), F.stddev_samp("mean").alias("spread"), F.avg("hit_rate").alias("hit_rate"), F.avg("best").alias("best"))
