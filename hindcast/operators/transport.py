"""How a coverage carries over from past to coming periods: its split, bounds under limited drift, and worlds apart."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def joined(own: DataFrame, per: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of own with those of per under the same keys; null is a key like any other."""
    same = F.lit(True)
    for k in keys:
        per = per.withColumnRenamed(k, f"_per_{k}")
        same = same & F.col(k).eqNullSafe(F.col(f"_per_{k}"))
    return own.join(per, same)


def transported(df: DataFrame, fits: Sequence[str], state: str, period: str, hit: Column) -> DataFrame:
    """(fits, period, source, target, carried, room_below, room_above): coverage before and in each period with earlier rows.

    ``carried`` weighs the states' coverage before the period by the rows they have in it; a state that is new takes the
    fit's coverage before. Rows are counted per fit, state and period once, and what is windowed are those counts. Null
    hits count as misses; rows with a null period are left out.
    """
    counts = df.where(F.col(period).isNotNull()).groupBy(*fits, state, period).agg(F.count(F.lit(1)).alias("_n"), F.count_if(F.coalesce(hit, F.lit(False))).alias("_h"))
    past = lambda keys: Window.partitionBy(*keys).orderBy(period).rowsBetween(Window.unboundedPreceding, -1)
    whole = counts.groupBy(*fits, period).agg(F.sum("_n").alias("_nt"), F.sum("_h").alias("_ht"))
    whole = whole.withColumn("_ns", F.sum("_nt").over(past(fits))).withColumn("_hs", F.sum("_ht").over(past(fits))).where("_ns is not null")
    own = counts.withColumn("_n0", F.sum("_n").over(past([*fits, state]))).withColumn("_h0", F.sum("_h").over(past([*fits, state])))
    met = joined(own, whole, [*fits, period]).select(*fits, period, "_n", "_nt", "_ns", "_ht", "_hs", F.coalesce(F.col("_h0") / F.col("_n0"), F.col("_hs") / F.col("_ns")).alias("_f"))
    return met.groupBy(*fits, period).agg(
        F.first(F.col("_hs") / F.col("_ns")).alias("source"), F.first(F.col("_ht") / F.col("_nt")).alias("target"), F.sum(F.col("_f") * F.col("_n") / F.col("_nt")).alias("carried"),
        F.min("_f").alias("room_below"), F.min(1 - F.col("_f")).alias("room_above"),
    )


def transport_certificates(df: DataFrame, fits: Sequence[str], state: str, period: str, hit: Column, nominal: float = 0.9) -> DataFrame:
    """Per fit and period: the gap to expect, an interval for it, and what the interval proves.

    The change of the gap splits into ``mixture`` (other weights of states) and ``drift`` (other coverage within states),
    exactly. Only the first is known beforehand: ``center`` is the gap before plus the mixture, and the interval reaches
    ``bound`` to both sides, the largest drift of any earlier period. ``verdict`` is UNDER or OVER where the interval lies
    on one side of zero, OPEN where it does not, and NO_HISTORY without an earlier drift. ``held``: the gap that came lies
    in the interval.
    """
    out = transported(df, fits, state, period, hit)
    out = out.select(*fits, period, (F.col("source") - nominal).alias("source_gap"), (F.col("target") - nominal).alias("target_gap"), (F.col("carried") - F.col("source")).alias("mixture"), (F.col("target") - F.col("carried")).alias("drift"))
    before = Window.partitionBy(*fits).orderBy(period).rowsBetween(Window.unboundedPreceding, -1)
    out = out.withColumn("center", F.col("source_gap") + F.col("mixture")).withColumn("bound", F.max(F.abs("drift")).over(before))
    out = out.withColumn("lower", F.col("center") - F.col("bound")).withColumn("upper", F.col("center") + F.col("bound"))
    verdict = F.when(F.col("bound").isNull(), "NO_HISTORY").when(F.col("upper") < 0, "UNDER").when(F.col("lower") > 0, "OVER").otherwise("OPEN")
    return out.withColumn("verdict", verdict).withColumn("held", F.col("target_gap").between(F.col("lower") - 1e-12, F.col("upper") + 1e-12))


def transport_worlds(df: DataFrame, fits: Sequence[str], state: str, period: str, hit: Column, separation: float = 0.05, nominal: float = 0.9) -> DataFrame:
    """Two worlds per fit and period that agree in all that is known before it and differ in its gap by twice separation.

    In one every state's coverage lies ``separation`` under what it was, in the other as much over. ``valid``: no coverage
    leaves [0, 1]. ``signs_differ``: the worlds call for corrections of opposite sign, so none is identified.
    """
    if not 0 < separation < 0.5 or not 0 < nominal < 1:
        raise ValueError("separation lies between 0 and 0.5, nominal between 0 and 1")
    out = transported(df, fits, state, period, hit).withColumn("_c", F.col("carried") - nominal)
    valid = separation <= F.least("room_below", "room_above") + 1e-15
    worlds = F.explode(F.array(*[F.struct(F.lit(w).alias("world"), (F.col("_c") + s * separation).alias("gap")) for w, s in (("BELOW", -1), ("ABOVE", 1))])).alias("w")
    return out.select(*fits, period, valid.alias("valid"), (F.abs("_c") < separation).alias("signs_differ"), worlds).select(*fits, period, "w.*", "valid", "signs_differ")


def amplitude_worlds(df: DataFrame, keys: Sequence[str], predicted: str, scales: Sequence[float] = (0.5, 2.0), level: float = 10.0) -> DataFrame:
    """Per group one world a scale: outcomes at ``level`` plus the scaled, centred predictions, and the ratio of spreads.

    All worlds share the predictions, so the ratio cannot be known from them. Groups of under three predictions or without
    spread have none; null predictions are left out.
    """
    own = df.where(F.col(predicted).isNotNull())
    whole = own.groupBy(*keys).agg(F.avg(predicted).alias("_m"), F.count(F.lit(1)).alias("_n"), F.max(predicted).alias("_hi"), F.min(predicted).alias("_lo")).where("_n >= 3 and _hi > _lo")
    p = joined(own, whole, keys).select(*keys, F.col(predicted).alias("_p"), "_m", F.explode(F.array(*[F.lit(float(s)) for s in scales])).alias("scale"))
    return p.groupBy(*keys, "scale").agg(F.count(F.lit(1)).alias("n"), (F.stddev_samp("_p") / F.stddev_samp(level + F.col("scale") * (F.col("_p") - F.col("_m")))).alias("ratio"))


def late_rankings(df: DataFrame, entity: str, state: str, value: str) -> DataFrame:
    """Per entity: its mean contrast to the leader over shared states, and in how many states the order is the other way.

    The leader has the largest mean, ties to the least entity. What a mean ranks one way, a later state may rank the other.
    One row per entity and state is expected; null values are left out.
    """
    own = df.where(F.col(value).isNotNull())
    best = own.groupBy(entity).agg(F.avg(value).alias("_m")).agg(F.min_by(entity, F.struct(-F.col("_m"), entity)).alias("_leader"))
    lead = own.join(F.broadcast(best), F.col(entity) == F.col("_leader")).select(F.col(state).alias("_s"), F.col(value).alias("_v"))  # one row: the leader
    met = own.where(F.col(state).isNotNull()).join(lead, F.col(state) == F.col("_s")).join(F.broadcast(best), F.col(entity) != F.col("_leader"))
    per = met.select(entity, (F.col(value) - F.col("_v")).alias("_c")).groupBy(entity).agg(F.avg("_c").alias("expected"), F.count(F.lit(1)).alias("states"), F.count_if(F.col("_c") > 0).alias("_up"), F.count_if(F.col("_c") < 0).alias("_down"))
    return per.select(entity, "expected", "states", F.when(F.col("expected") > 0, F.col("_down")).otherwise(F.col("_up")).alias("reversed"))
