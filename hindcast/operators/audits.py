"""Retention under a risk cut-off, smallest rows, look-ups, reproduction of stored numbers, and one-row locks of a bundle."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import aggregates as A
from . import windows as W


def matched(keys: Sequence[str]):
    """Condition that columns are those named with a leading underscore, null like null."""
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return same


def retained_by_risk(df: DataFrame, keys: Sequence[str], risk: str, ties: Sequence[str], removed: Sequence[float]) -> DataFrame:
    """(df, removed): per fraction the rows of each key whose risk lies under its quantile at 1 - removed; all for 0.

    Only the order of risks decides. Where equal risks leave no row under the cut-off, the round((1 - removed) * n) rows of
    least risk stay, at least one, ties in the order of ``ties``; those keys alone are put in order, in sorted ranges.
    A null risk is never retained at a fraction above 0 and does not count.
    """
    every = df.withColumn("removed", F.lit(0.0)) if 0.0 in removed else None
    cut = [float(x) for x in removed if x]
    if not cut:
        return every if every is not None else df.withColumn("removed", F.lit(0.0)).limit(0)
    own = df.where(F.col(risk).isNotNull())
    q = A.interpolated_quantile(own, keys, risk, [1 - x for x in cut])
    level = F.round(1 - F.col("level"), 9)
    least = own.groupBy(*keys).agg(F.min(risk).alias("_least"))
    at = q.select(*[F.col(k).alias(f"_{k}") for k in keys], level.alias("removed"), F.col("n").alias("_n"), F.col("q").alias("_q"))
    at = at.join(least, matched(keys)).drop(*keys)
    met = own.join(at, matched(keys)).drop(*[f"_{k}" for k in keys])
    under = met.where((F.col("_least") < F.col("_q")) & (F.col(risk) < F.col("_q")))
    flat = W.numbered(met.where(F.col("_least") >= F.col("_q")), ["removed", *keys, risk, *ties], "_place")
    first = flat.groupBy("removed", *keys).agg(F.min("_place").alias("_from")).select(F.col("removed").alias("_removed"), *[F.col(k).alias(f"_{k}") for k in keys], "_from")
    some = flat.join(first, matched(["removed", *keys])).where(F.col("_place") - F.col("_from") < F.greatest(F.lit(1), F.bround((1 - F.col("removed")) * F.col("_n"))))
    out = under.select(*df.columns, "removed").unionByName(some.select(*df.columns, "removed"))
    return out if every is None else every.unionByName(out)


def smallest(df: DataFrame, keys: Sequence[str], order: Sequence, k: int) -> DataFrame:
    """The first k rows of each key, with their place from 1. Tasks let go of all but k rows a key before the shuffle."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("place", place).where(F.col("place") <= k)


def looked_up(df: DataFrame, table: DataFrame, key: str, columns: Sequence[str], strict: bool = True) -> DataFrame:
    """df with columns of table under its key. Strict: a repeated key of the table, or one of df that it lacks, raises.

    A null key of df has no entry; with strict=False missing entries are null and repeated keys still raise.
    """
    again = table.where(F.col(key).isNotNull()).groupBy(key).count().where("count > 1").limit(1).collect()
    if again:
        raise ValueError(f"{key} {again[0][0]!r} has several entries")
    own = table.select(F.col(key).alias(f"_{key}"), *columns, F.lit(True).alias("_known"))
    out = df.join(own, F.col(key) == F.col(f"_{key}"), "left")
    if strict:
        missing = [r[0] for r in out.where("_known is null").select(key).distinct().limit(5).collect()]
        if missing:
            raise ValueError(f"no entry for {key} {missing}")
    return out.drop(f"_{key}", "_known")


def reproduced(computed: DataFrame, stored: DataFrame, keys: Sequence[str], value: str, tolerance: float = 1e-8) -> DataFrame:
    """(keys, computed, stored, difference, state): REPRODUCED within tolerance, DIFFERS, or NOT_STORED and NOT_COMPUTED.

    Null equals null and nothing else; keys are unique on both sides.
    """
    a = computed.select(*keys, F.col(value).alias("computed"), F.lit(True).alias("_a"))
    b = stored.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col(value).alias("stored"), F.lit(True).alias("_b"))
    out = a.join(b, matched(keys), "full").withColumn("difference", F.abs(F.col("computed") - F.col("stored")))
    close = (F.col("difference") <= tolerance) | F.col("computed").eqNullSafe(F.col("stored"))
    state = F.when(F.col("_b").isNull(), "NOT_STORED").when(F.col("_a").isNull(), "NOT_COMPUTED").when(F.coalesce(close, F.lit(False)), "REPRODUCED").otherwise("DIFFERS")
    return out.select(*[F.when(F.col("_a").isNull(), F.col(f"_{k}")).otherwise(F.col(k)).alias(k) for k in keys], "computed", "stored", "difference", state.alias("state"))


def bit_differences(a: DataFrame, b: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """One row: rows of both, rows of one alone, and per column the rows whose doubles differ in any bit.

    Doubles are compared by their shortest text, which tells 0 from -0; NaN equals NaN, null equals null.
    """
    left = a.select(*keys, *[F.col(c).cast("double").cast("string").alias(c) for c in columns], F.lit(True).alias("_a"))
    right = b.select(*[F.col(k).alias(f"_{k}") for k in keys], *[F.col(c).cast("double").cast("string").alias(f"_v_{c}") for c in columns], F.lit(True).alias("_b"))
    met = left.join(right, matched(keys), "full")
    both = F.col("_a").isNotNull() & F.col("_b").isNotNull()
    return met.agg(F.count_if(both).alias("rows"), F.count_if(~both).alias("alone"), *[F.count_if(both & ~F.col(c).eqNullSafe(F.col(f"_v_{c}"))).alias(c) for c in columns])


def data_lock(records: DataFrame, entities: DataFrame, contexts: DataFrame, entity: str, context: str, value: str, year: str) -> DataFrame:
    """One row that describes a bundle: records, distinct keys and their overlaps, covariates that vary, what is missing, years.

    entities and contexts hold the key of that name and covariates. A context covariate varies if it has two values; the
    missing share is the mean over those that do. Keys are counted by grouping, so none is held in one task.
    """
    def keys(df: DataFrame, key: str) -> DataFrame:
        return df.where(F.col(key).isNotNull()).select(F.col(key).alias("_k")).distinct()

    def size(df: DataFrame, name: str) -> DataFrame:
        return df.agg(F.count(F.lit(1)).alias(name))

    covariates = [c for c in contexts.columns if c != context]
    varies = lambda c: F.coalesce(F.min(c) < F.max(c), F.lit(False))
    per = [F.struct(varies(c).alias("v"), (1 - F.try_divide(F.count(c), F.count(F.lit(1)))).alias("m")) for c in covariates]
    shape = contexts.agg(F.filter(F.array(*per), lambda x: x["v"]).alias("_x"))
    shape = shape.select(F.lit(len(covariates)).alias("covariates"), F.size("_x").alias("varying"), F.when(F.size("_x") > 0, F.aggregate("_x", F.lit(0.0), lambda t, x: t + x["m"]) / F.size("_x")).alias("missing"))
    own_e, own_c, all_e, all_c = keys(records, entity), keys(records, context), keys(entities, entity), keys(contexts, context)
    parts = [
        records.agg(F.count(F.lit(1)).alias("records"), F.count(value).alias("with_value"), F.min(year).alias("first_year"), F.max(year).alias("last_year")),
        size(own_e, "record_entities"), size(all_e, "entities"), size(own_e.join(all_e, "_k", "left_semi"), "shared_entities"),
        size(own_c, "record_contexts"), size(all_c, "contexts"), size(own_c.join(all_c, "_k", "left_semi"), "shared_contexts"), shape,
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.join(F.broadcast(p))  # one row
    return out.withColumn("markers", F.lit(len(entities.columns) - 1))
