"""Aggregations: replicate collapse, metric bundles, coverage, finite-sample quantiles, decompositions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def collapse_replicates(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Mean of a decimal value and number of rows per key: observed, replicates. The sum is exact in any order."""
    return df.groupBy(*keys).agg((F.sum(value).cast("double") / F.count(F.lit(1))).alias("observed"), F.count(F.lit(1)).alias("replicates"))


def pearson(x: str, y: str, least: int = 3) -> Column:
    """Correlation, null with fewer than ``least`` rows or a constant side."""
    sd = F.stddev_pop(x) * F.stddev_pop(y)
    return F.when((F.count(F.lit(1)) >= least) & (sd > 0), F.try_divide(F.covar_pop(x, y), sd))


def regression_metrics(df: DataFrame, keys: Sequence[str], y: str = "observed", p: str = "predicted") -> DataFrame:
    """n, rmse, mae, bias, r2 (about the slice's own mean) and Pearson's r per key, in one pass."""
    e = F.col(p) - F.col(y)
    total = F.var_pop(y)
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"), F.avg(e).alias("bias"),
        F.when(total > 0, 1 - F.try_divide(F.avg(e * e), total)).alias("r2"), pearson(y, p).alias("pearson"),
    )


def mid_rank(df: DataFrame, keys: Sequence[str], value: str, name: str) -> DataFrame:
    """Rank within keys from 1, ties averaged."""
    w = Window.partitionBy(*keys)
    return df.withColumn(name, F.rank().over(w.orderBy(value)) + (F.count(F.lit(1)).over(Window.partitionBy(*keys, value)) - 1) / 2)


def spearman(df: DataFrame, keys: Sequence[str], x: str, y: str, name: str = "spearman") -> DataFrame:
    ranked = mid_rank(mid_rank(df.where(F.col(x).isNotNull() & F.col(y).isNotNull()), keys, x, "_rx"), keys, y, "_ry")
    return ranked.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), pearson("_rx", "_ry").alias(name))


def grouped_summaries(df: DataFrame, sets: Sequence[Sequence[str]], aggs: Sequence[Column], all_label: str = "ALL") -> DataFrame:
    """Several groupings in one pass; a column that a set leaves out reads all_label."""
    columns = list(dict.fromkeys(c for s in sets for c in s))
    out = df.groupingSets([[F.col(c) for c in s] for s in sets], *[F.col(c) for c in columns]).agg(*aggs, *[F.grouping(c).alias(f"_g_{c}") for c in columns])
    named = [F.when(F.col(f"_g_{c}") == 1, all_label).otherwise(F.col(c).cast("string")).alias(c) for c in columns]
    return out.select(*named, *[c for c in out.columns if c not in columns and not c.startswith("_g_")])


def balanced_mean(df: DataFrame, group: str, value: Column | str, keys: Sequence[str] = ()) -> DataFrame:
    """Mean of per-group means, so that large groups weigh no more than small ones, beside the plain mean."""
    value = F.col(value) if isinstance(value, str) else value
    per = df.groupBy(*keys, group).agg(F.avg(value).alias("_m"), F.sum(value).alias("_s"), F.count(value).alias("_c"))
    return per.groupBy(*keys).agg(F.avg("_m").alias("balanced"), (F.sum("_s") / F.sum("_c")).alias("weighted"), F.count(F.lit(1)).alias("groups"), F.sum("_c").alias("n"))


def order_bucket(value: str) -> Column:
    """A whole number that grows with the value, in steps of 1/64 of its size; null sorts first."""
    x = F.col(value)
    size = F.floor(F.ln(F.abs(x)) * 64) + 100_000
    return F.coalesce(F.when(x == 0, F.lit(0)).otherwise(F.signum(x) * size), F.lit(-1_000_000)).cast("long")


def finite_sample_rank(n: Column, level: Column) -> Column:
    """ceil((n + 1) * level), from 1 to n."""
    return F.least(n, F.greatest(F.lit(1), F.ceil(F.round((n + 1) * level, 9))))


def order_statistics(counts: DataFrame, values, keys: Sequence[str], levels: Sequence[float], rank=finite_sample_rank) -> DataFrame:
    """(keys, level, n, q) from counts (keys, bucket, c): the bucket that holds the rank, then the value within it.

    values(targets) gives the rows (keys, level, n, need, value) of the buckets asked for. Only those are put in order,
    and equal ones count as one row. rank(n, level) says which place is asked for.
    """
    w = Window.partitionBy(*keys)
    upto = counts.withColumn("_upto", F.sum("c").over(w.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0))).withColumn("n", F.sum("c").over(w))
    at = upto.withColumn("level", F.explode(F.array(*[F.lit(float(x)) for x in levels]))).withColumn("_rank", rank(F.col("n"), F.col("level")))
    targets = at.where((F.col("_upto") >= F.col("_rank")) & (F.col("_upto") - F.col("c") < F.col("_rank")))
    targets = targets.select(*keys, "level", "n", F.col("bucket").alias("_bucket"), (F.col("_rank") - F.col("_upto") + F.col("c")).alias("need"))
    found = values(targets).groupBy(*keys, "level", "n", "need", "value").agg(F.count(F.lit(1)).alias("_c"))
    inner = Window.partitionBy(*keys, "level").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    return found.withColumn("_upto", F.sum("_c").over(inner)).where("_upto >= need").groupBy(*keys, "level", "n").agg(F.min_by("value", "_upto").alias("q"))


def bucketed(df: DataFrame, keys: Sequence[str], value: str):
    """Counts (keys, bucket, c) of values by size, and the values of the buckets that are asked for."""
    own = df.select(*keys, F.col(value).alias("value"), order_bucket(value).alias("bucket"))
    counts = own.groupBy(*keys, "bucket").agg(F.count(F.lit(1)).alias("c"))

    def values(targets: DataFrame) -> DataFrame:
        targets = targets.select(*[F.col(k).alias(f"_{k}") for k in keys], "level", "n", "_bucket", "need")
        cond = own["bucket"] == targets["_bucket"]
        for k in keys:
            cond = cond & own[k].eqNullSafe(targets[f"_{k}"])
        return own.join(targets, cond).select(*keys, "level", "n", "need", "value")

    return counts, values


def finite_sample_quantile(df: DataFrame, keys: Sequence[str], value: str, levels: Sequence[float]) -> DataFrame:
    """(keys, level, n, q): the order statistic at ceil((n + 1) * level), at most n.

    Values are counted in buckets by size first; no group is sorted as a whole, however large.
    """
    return order_statistics(*bucketed(df, keys, value), keys, levels)


def interpolated_quantile(df: DataFrame, keys: Sequence[str], value: str, levels: Sequence[float]) -> DataFrame:
    """(keys, level, n, low, high, q): q lies between the order statistics around (n - 1) * level, linearly.

    Counted in buckets like finite_sample_quantile. Rows with a null value are left out.
    """
    counts, values = bucketed(df.where(F.col(value).isNotNull()), keys, value)
    place = lambda n, level: F.round((n - 1) * level, 9)
    low = order_statistics(counts, values, keys, levels, lambda n, level: F.floor(place(n, level)) + 1)
    high = order_statistics(counts, values, keys, levels, lambda n, level: F.least(n, F.floor(place(n, level)) + 2))
    high = high.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("level").alias("_level"), F.col("q").alias("high"))
    same = F.col("level") == F.col("_level")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    share = place(F.col("n"), F.col("level"))
    met = low.withColumnRenamed("q", "low").join(high, same)
    return met.select(*keys, "level", "n", "low", "high", (F.col("low") + (F.col("high") - F.col("low")) * (share - F.floor(share))).alias("q"))


def prior_quantile(df: DataFrame, period: str, value: str, levels: Sequence[float], name: str = "test_period") -> DataFrame:
    """(test_period, level, n, periods, q): the same over all rows of strictly earlier periods.

    Counts of period and bucket are added up for each test period, so that no row stands in several pools.
    """
    own = df.select(F.col(period).alias("_p"), F.col(value).alias("value"), order_bucket(value).alias("bucket"))
    each = own.groupBy("_p", "bucket").agg(F.count(F.lit(1)).alias("c"))
    tests = each.select(F.col("_p").alias(name)).distinct()
    # as many rows as periods
    pools = each.join(F.broadcast(tests), F.col("_p") < F.col(name))
    counts = pools.groupBy(name, "bucket").agg(F.sum("c").alias("c"))
    periods = pools.groupBy(F.col(name).alias("_t")).agg(F.countDistinct("_p").alias("periods"))
    # as many rows as periods and levels
    out = order_statistics(counts, lambda targets: own.join(F.broadcast(targets), (F.col("bucket") == F.col("_bucket")) & (F.col("_p") < F.col(name))).select(name, "level", "n", "need", "value"), [name], levels)
    return out.join(F.broadcast(periods), F.col(name) == F.col("_t")).drop("_t")


def mode_of(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Most frequent value per key; of ties the first in order."""
    counts = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_c"))
    return counts.groupBy(*keys).agg(F.min_by(value, F.struct(-F.col("_c"), F.col(value))).alias("mode"), F.max("_c").alias("mode_count"))


def upper_median(date: str) -> Column:
    """The date at n // 2 of the sorted dates: of two in the middle, the later.

    Spark counts the distinct days of a group, partly before the shuffle, so a group holds days and no rows.
    """
    return F.expr(f"date_from_unix_date(CAST(percentile_disc(0.5) WITHIN GROUP (ORDER BY unix_date(`{date}`) DESC) AS INT))")


def profile(df: DataFrame, value: str, entity: str) -> list[Column]:
    return [
        F.count(F.lit(1)).alias("rows"), F.count(value).alias("non_null"), F.countDistinct(entity).alias("entities"), F.avg(value).alias("mean"),
        F.stddev_samp(value).alias("sd"), F.median(value).alias("median"), F.min(value).alias("min"), F.max(value).alias("max"),
        (1 - F.count(value) / F.count(F.lit(1))).alias("missing"),
    ]


def column_audit(df: DataFrame, columns: Sequence[str], key: str = "covariate") -> DataFrame:
    """Per column: rows, non-null, missing fraction, distinct values, whether it varies. One scan, melted."""
    long = df.unpivot([], list(columns), key, "value")
    return long.groupBy(key).agg(
        F.count(F.lit(1)).alias("rows"), F.count("value").alias("non_null"), (1 - F.count("value") / F.count(F.lit(1))).alias("missing"),
        F.countDistinct("value").alias("distinct"), (F.countDistinct("value") > 1).alias("varies"),
    )


def overlap(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Keys in both, only left and only right, and the covered fractions."""
    a, b = left.select(key).distinct().withColumn("_a", F.lit(1)), right.select(key).distinct().withColumn("_b", F.lit(1))
    both = F.count_if(F.col("_a").isNotNull() & F.col("_b").isNotNull())
    return a.join(b, key, "full").agg(
        both.alias("both"), F.count_if(F.col("_b").isNull()).alias("only_left"), F.count_if(F.col("_a").isNull()).alias("only_right"),
        F.try_divide(both, F.count("_a")).alias("left_covered"), F.try_divide(both, F.count("_b")).alias("right_covered"),
    )


def sse_decomposition(df: DataFrame, group: str, residual: Column, keys: Sequence[str] = ()) -> DataFrame:
    """Squared error split into group bias (n * mean^2) and what varies inside groups; gap is how far the sum is off."""
    per = df.withColumn("_r", residual).groupBy(*keys, group).agg(F.count("_r").alias("_n"), F.avg("_r").alias("_m"), F.var_pop("_r").alias("_v"), F.sum(F.col("_r") * F.col("_r")).alias("_sse"))
    out = per.groupBy(*keys).agg(F.sum(F.col("_n") * F.col("_m") ** 2).alias("bias_sse"), F.sum(F.col("_n") * F.col("_v")).alias("within_sse"), F.sum("_sse").alias("sse"))
    share = lambda c: F.try_divide(F.col(c), F.col("sse"))
    return out.select("*", share("bias_sse").alias("bias_share"), share("within_sse").alias("within_share"), (F.abs(F.col("sse") - F.col("bias_sse") - F.col("within_sse")) <= 1e-9 * F.col("sse")).alias("identity_holds"))


def response_amplitude(df: DataFrame, keys: Sequence[str], y: str = "observed", p: str = "predicted") -> DataFrame:
    """Per group: sd ratio, slope of y on p, r, slope = r * sd(y) / sd(p), mean squared difference over ordered pairs."""
    out = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.stddev_samp(y).alias("sd_y"), F.stddev_samp(p).alias("sd_p"), pearson(y, p, 2).alias("r"),
        F.when(F.var_pop(p) > 0, F.try_divide(F.covar_pop(y, p), F.var_pop(p))).alias("slope"), (2 * F.var_samp(F.col(y) - F.col(p))).alias("pairwise_msed"),
    )
    return out.withColumn("sd_ratio", F.try_divide("sd_p", "sd_y")).withColumn("slope_identity", F.col("r") * F.try_divide("sd_y", "sd_p"))


def interval_score(y: Column, lower: Column, upper: Column, level: float) -> Column:
    """Width plus 2 / (1 - level) times how far y is outside."""
    miss = F.greatest(lower - y, F.lit(0.0)) + F.greatest(y - upper, F.lit(0.0))
    return upper - lower + 2 / (1 - level) * miss


def pooled_rmse(rmse: str = "rmse", n: str = "n") -> Column:
    return F.sqrt(F.sum(F.col(n) * F.col(rmse) * F.col(rmse)) / F.sum(n))


def cluster_statistics(df: DataFrame, cluster: str, keys: Sequence[str], y: str, reference: str, candidate: str) -> DataFrame:
    """What a bootstrap over clusters needs of each: n and sums of squared and absolute errors of both predictors."""
    er, ec = F.col(reference) - F.col(y), F.col(candidate) - F.col(y)
    return df.groupBy(*keys, cluster).agg(
        F.count(F.lit(1)).alias("n"), F.sum(er * er).alias("sse_reference"), F.sum(ec * ec).alias("sse_candidate"),
        F.sum(F.abs(er)).alias("sae_reference"), F.sum(F.abs(ec)).alias("sae_candidate"),
    )
