"""Window operators: ranks, strictly earlier means, leave-one-out pools, period comparisons."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def prior_mean(df: DataFrame, keys: Sequence[str], order: str, value: str, name: str) -> DataFrame:
    """Mean of value over rows of the key with a strictly smaller order (say, year); null if none.

    Rows are summed by key and order first, so the window runs over periods and not over rows.
    """
    per = df.groupBy(*keys, order).agg(F.sum(value).alias("_s"), F.count(value).alias("_c"))
    w = Window.partitionBy(*keys).orderBy(order).rangeBetween(Window.unboundedPreceding, -1)
    per = per.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col(order).alias("_o"), F.try_divide(F.sum("_s").over(w), F.sum("_c").over(w)).alias(name))
    cond = df[order] == per["_o"]
    for k in keys:
        cond = cond & df[k].eqNullSafe(per[f"_{k}"])
    return df.join(per, cond, "left").drop("_o", *[f"_{k}" for k in keys])


def average_rank(keys: Sequence[str], value: str, descending: bool = False) -> Column:
    order = F.col(value).desc() if descending else F.col(value).asc()
    return F.rank().over(Window.partitionBy(*keys).orderBy(order)) + (F.count(F.lit(1)).over(Window.partitionBy(*keys, value)) - 1) / 2


def percentile_rank(keys: Sequence[str], value: str) -> Column:
    """Average rank over the number of rows: the largest of distinct values has 1."""
    return average_rank(keys, value) / F.count(F.lit(1)).over(Window.partitionBy(*keys))


def first_rank_quartile(keys: Sequence[str], *order: str) -> Column:
    """Quartile 1 to 4 after numbering rows: four equal-width cuts of the numbers, closed on the right."""
    w = Window.partitionBy(*keys)
    k, count = F.row_number().over(w.orderBy(*order)), F.count(F.lit(1)).over(w)
    return F.coalesce(F.greatest(F.lit(1), F.ceil(F.round(F.try_divide((k - 1) * 4.0, count - 1), 9))), F.lit(1)).cast("long")


def retain_fraction(df: DataFrame, keys: Sequence[str], fraction: float, *order: str) -> DataFrame:
    """The first ceil(fraction * n) rows of each key in that order."""
    w = Window.partitionBy(*keys)
    ranked = df.withColumn("_k", F.row_number().over(w.orderBy(*order))).withColumn("_n", F.count(F.lit(1)).over(w))
    return ranked.where(F.col("_k") <= F.ceil(F.round(fraction * F.col("_n"), 9))).drop("_k", "_n")


def others_mean(keys: Sequence[str], value: str) -> Column:
    """Mean over the other rows of the key; null for a row alone."""
    w = Window.partitionBy(*keys)
    return F.try_divide(F.sum(value).over(w) - F.col(value), F.count(value).over(w) - 1)


def leave_one_out_mean(df: DataFrame, keys: Sequence[str], value: str, name: str) -> DataFrame:
    """Mean over the other rows of the key, else over all other rows; null for a row alone. Sums are joined, not windowed."""
    per = df.groupBy(*keys).agg(F.sum(value).alias("_s"), F.count(value).alias("_c"))
    whole = per.agg(F.sum("_s").alias("_ws"), F.sum("_c").alias("_wc"))
    per = per.select(*[F.col(k).alias(f"_{k}") for k in keys], "_s", "_c")
    cond = F.lit(True)
    for k in keys:
        cond = cond & df[k].eqNullSafe(per[f"_{k}"])
    # one row: the sums over all rows
    out = df.join(per, cond).join(F.broadcast(whole))
    own = lambda s, c: F.try_divide(F.col(s) - F.col(value), F.col(c) - 1)
    return out.withColumn(name, F.coalesce(own("_s", "_c"), own("_ws", "_wc"))).drop("_s", "_c", "_ws", "_wc", *[f"_{k}" for k in keys])


def numbered(df: DataFrame, order: Sequence[str], name: str) -> DataFrame:
    """Number of each row from 0 in that order, over the whole table: ranges are sorted and counted apart, then shifted."""
    from hindcast.sources.scratch import stored

    ranges = stored(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ranges")
    shift = ranges.groupBy("_part").agg(F.count(F.lit(1)).alias("_c"))
    # as many rows as ranges
    shift = shift.select("_part", F.sum("_c").over(Window.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)).alias("_shift"))
    own = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1
    out = ranges.withColumn("_own", own).join(F.broadcast(shift), "_part")
    return out.withColumn(name, F.coalesce("_shift", F.lit(0)) + F.col("_own")).drop("_part", "_own", "_shift")


def coded(df: DataFrame, column: str, name: str) -> DataFrame:
    """Place of the row's value among the distinct values in order, from 0."""
    codes = numbered(df.select(F.col(column).alias("_v")).distinct(), ["_v"], name)
    return df.join(codes, df[column].eqNullSafe(codes["_v"])).drop("_v")


def mean_step(keys: Sequence[str], order: str, value: str) -> Column:
    """Absolute difference from the row before in the key."""
    return F.abs(F.col(value) - F.lag(value).over(Window.partitionBy(*keys).orderBy(order)))


def z_score(keys: Sequence[str], value: str) -> Column:
    """(x - mean) / sd (n - 1); 0 where values are constant."""
    w = Window.partitionBy(*keys)
    return F.coalesce(F.try_divide(F.col(value) - F.avg(value).over(w), F.nullif(F.stddev_samp(value).over(w), F.lit(0.0))), F.lit(0.0))


def running_share(keys: Sequence[str], value: str, *order) -> Column:
    w = Window.partitionBy(*keys)
    return F.try_divide(F.sum(value).over(w.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)), F.sum(value).over(w))


def position_in_reference(df: DataFrame, reference: DataFrame, keys: Sequence[str], value: str, name: str) -> DataFrame:
    """Share of the reference sample of the key that is at most the row's value.

    Both samples are stacked and counted in order, so no pair of rows is formed.
    """
    both = df.withColumn("_ref", F.lit(0)).unionByName(reference.select(*keys, value).withColumn("_ref", F.lit(1)), allowMissingColumns=True)
    w = Window.partitionBy(*keys)
    counted = both.withColumn(name, F.try_divide(F.sum("_ref").over(w.orderBy(value).rangeBetween(Window.unboundedPreceding, 0)), F.sum("_ref").over(w)))
    return counted.where(F.col("_ref") == 0).drop("_ref")
