"""Decisions over a set of possible worlds that grows with each round of feedback."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def statewise(df: DataFrame, world: str, action: str, loss: str, coverage: str, nominal: float, tolerance: float = 1e-12) -> DataFrame:
    """Rows with ``feasible`` (coverage of at least nominal), ``best`` (least loss among a world's feasible actions), ``optimal``
    (within the tolerance of it) and ``regret``. A world in which no action is feasible has null best, optimal and regret.
    """
    best = df.groupBy(F.col(world).alias("_w")).agg(F.min(F.when(F.col(coverage) >= nominal - tolerance, F.col(loss))).alias("best"))
    out = df.join(best, df[world].eqNullSafe(best["_w"])).drop("_w").withColumn("feasible", F.col(coverage) >= nominal - tolerance)
    return out.withColumn("regret", F.col(loss) - F.col("best")).withColumn("optimal", F.col("feasible") & (F.col("regret") <= tolerance))


def feedback_rounds(df: DataFrame, world: str, round_: str, action: str, loss: str, coverage: str, nominal: float, tolerance: float = 1e-12) -> DataFrame:
    """(round, action, identified, robust, worst_loss, worst_regret, minimax_loss, minimax_regret) after each round of worlds.

    df: one row per world and action, with the round in which the world became known; every world has every action. After a
    round, the identified set holds the actions that are optimal in some world so far, and so only grows; an action is
    robust while it is feasible in every world so far; the minimax actions have the least worst loss, or worst regret, among
    the robust ones, ties within the tolerance included, none if no action is robust. A world without a feasible action is
    outside the class and raises.

    Worlds are summed up by round and action before any window, so windows run over rounds, not worlds.
    """
    rows = statewise(df, world, action, loss, coverage, nominal, tolerance)
    checked = F.when(F.col("best").isNull(), F.raise_error(F.lit("a world without a feasible action")).cast("double")).otherwise(F.col(loss))
    per = rows.groupBy(F.col(round_).alias("round"), F.col(action).alias("action")).agg(F.max(checked).alias("loss"), F.max("regret").alias("regret"), F.max("optimal").alias("optimal"), F.min("feasible").alias("feasible"))
    so_far = Window.partitionBy("action").orderBy("round").rowsBetween(Window.unboundedPreceding, 0)
    seen = per.select("round", "action", F.max("optimal").over(so_far).alias("identified"), F.min("feasible").over(so_far).alias("robust"), F.max("loss").over(so_far).alias("worst_loss"), F.max("regret").over(so_far).alias("worst_regret"))
    whole = Window.partitionBy("round")  # as many rows as actions
    least = lambda c: F.col("robust") & (F.col(c) <= F.min(F.when(F.col("robust"), F.col(c))).over(whole) + tolerance)
    return seen.withColumn("minimax_loss", least("worst_loss")).withColumn("minimax_regret", least("worst_regret"))


def identified_sets(rounds: DataFrame, directions: dict[str, int]) -> DataFrame:
    """(round, actions, point_identified, directions): the identified set after each round, and the directions it leaves open.

    directions: -1, 0 or 1 for each action; an action without one raises.
    """
    if set(directions.values()) - {-1, 0, 1}:
        raise ValueError("a direction is -1, 0 or 1")
    way = F.element_at(F.create_map(*[F.lit(x) for pair in directions.items() for x in pair]), F.col("action"))
    known = F.when(way.isNull(), F.raise_error(F.concat(F.lit("no direction for "), "action")).cast("int")).otherwise(way)
    own = rounds.where("identified").groupBy("round").agg(F.sort_array(F.collect_set("action")).alias("actions"), F.sort_array(F.collect_set(known)).alias("directions"))
    return own.select("round", "actions", (F.size("actions") == 1).alias("point_identified"), "directions")
