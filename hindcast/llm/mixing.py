"""Mixing sources to target weights by iterative proportional fitting."""

from __future__ import annotations

import warnings

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, cut, forget, join_small, wide_table

#: Without given targets, a margin's shares are its token shares to this power, scaled to one: rare values gain, up to
#: this share of the tokens that they have.
TEMPER, MOST_USED = 0.7, 0.98
#: Share of all tokens to sample, or less where the targets allow no more.
BUDGET = 0.8
#: The fit stops when no margin is further than TOLERANCE off, or after SWEEPS rounds over all margins.
TOLERANCE, SWEEPS = 1e-4, 40
#: Parts of the budget that are tried until every target is reached.
TRIES = (1, 0.9, 0.8, 0.7, 0.6, 0.5, 0.25)
#: A target counts as reached if the expected tokens are no further off than this share of it.
REACHED = 0.01
SEED = 17
#: Up to this many cells are raked in the driver's memory (some 10 MB); more are raked as a table.
DRIVER_CELLS = 50_000
#: Forms of text: a table has a bar in every BAR_EACH characters, a list has lines of under LIST_LINE characters on
#: average, a long text has over LONG_TEXT characters; all else is prose.
BAR_EACH, LIST_LINE, LONG_TEXT = 40, 80, 12_000
MARGINS = ("source", "lang", "topic")


def topic_of(text: Column) -> Column:
    """A stand-in where the table has no topic: the form of the text. Give mix_sources a column of real topics instead."""
    lines = F.size(F.split(text, "\n"))
    bars = F.length(text) - F.length(F.translate(text, "|", ""))
    return F.when(BAR_EACH * bars > F.length(text), "table").when(F.length(text) < LIST_LINE * lines, "list").when(F.length(text) > LONG_TEXT, "long").otherwise("prose")


def words_in(text: Column) -> Column:
    return F.size(F.array_remove(F.split(text, SPACE), "")).cast("long")


def filled(sums, amount: float) -> float:
    """The rate at which values get rate * weight tokens, or MOST_USED of what they have if that is less: amount in all.

    sums(rate) gives the tokens of the values that are full at a rate, and the weights of the others.
    """
    rate = 0.0
    while True:
        full, open_weight = sums(rate)
        new = (amount - full) / open_weight if open_weight > 0 else float("inf")
        if new <= rate * (1 + 1e-12):
            return rate
        rate = new


def with_targets(cells: DataFrame, margin: str, targets: dict | None, budget: float) -> DataFrame:
    """Adds the margin's target in tokens. Given shares count among the values that occur; others get none."""
    everything = F.col("_all")
    if targets is None:
        sums = cut(cells.groupBy(margin, "_all").agg(F.sum("tokens").alias("_t")).withColumn("_w", F.pow(F.col("_t") / everything, F.lit(TEMPER))), "margin")
        amount = (sums.agg(F.sum("_t")).first()[0] or 0) * budget

        def at(rate: float) -> tuple[float, float]:
            full = F.lit(rate) * F.col("_w") > MOST_USED * F.col("_t")
            return tuple(x or 0.0 for x in sums.agg(F.sum(F.when(full, MOST_USED * F.col("_t"))), F.sum(F.when(~full, F.col("_w")))).first())

        rate = filled(at, amount)
        target = F.least(MOST_USED * F.col("_t"), F.lit(rate) * F.col("_w")) / F.lit(budget)
    else:
        given = cells.sparkSession.createDataFrame([(k, float(v)) for k, v in targets.items()], f"_v {cells.schema[margin].dataType.simpleString()}, _w double")
        sums = cells.select(margin, "_all").distinct()
        sums = sums.join(given, sums[margin].eqNullSafe(given["_v"]), "left").withColumn("_w", F.coalesce("_w", F.lit(0.0)))
        target = F.col("_w") / (sums.agg(F.sum("_w")).first()[0] or 1.0) * everything
    sums = sums.select(F.col(margin).alias("_v"), target.alias(f"target_{margin}"))
    return cells.join(sums, cells[margin].eqNullSafe(sums["_v"])).drop("_v")


def margins(cells: DataFrame) -> DataFrame:
    """(margin, value, tokens, target, expected, reached): tokens that each value has, should give and is expected to give."""
    out = None
    for margin in MARGINS:
        one = cells.groupBy(F.lit(margin).alias("margin"), F.col(margin).cast("string").alias("value"), (F.col(f"target_{margin}") * F.col("budget")).alias("target"))
        one = one.agg(F.sum("tokens").alias("tokens"), F.sum(F.col("tokens") * F.col("probability")).alias("expected"))
        out = one if out is None else out.unionByName(one)
    return out.withColumn("reached", F.abs(F.col("expected") - F.col("target")) <= REACHED * F.col("target"))


def rake_in_driver(cells: DataFrame, targets: dict, budget: float) -> DataFrame:
    """What rake gives, for at most DRIVER_CELLS cells."""
    rows = cells.select(*MARGINS, "tokens").collect()
    tokens = np.array([float(r["tokens"] or 0) for r in rows])
    total = tokens.sum()
    codes, wanted = [], []
    for margin in MARGINS:
        number: dict = {}
        code = np.array([number.setdefault(r[margin], len(number)) for r in rows], dtype=np.int64)
        has = np.bincount(code, tokens, len(number))
        given = targets.get(margin)
        if given is None:
            weight = (has / (total or 1.0)) ** TEMPER
            rate = filled(lambda x, w=weight, h=has: ((MOST_USED * h[x * w > MOST_USED * h]).sum(), w[x * w <= MOST_USED * h].sum()), total * budget)
            want = np.minimum(MOST_USED * has, rate * weight) / budget if total else has
        else:
            share = np.array([float(given.get(v, 0.0)) for v in number])
            want = share / (share.sum() or 1.0) * total
        some = (want > 0) & (has > 0)
        least = (has[some] / want[some]).min() if some.any() else None
        if least is not None and least < budget * 1.01:
            budget = min(budget, 0.99 * float(least))
        codes.append(code)
        wanted.append(want)
    first = None
    for share in (budget * x for x in TRIES):
        x = np.full(len(rows), share)
        for _ in range(SWEEPS):
            worst = 0.0
            for code, want in zip(codes, wanted, strict=True):
                now = np.bincount(code, tokens * np.minimum(x, 1), len(want))
                factor = np.divide(want * share, now, out=np.ones(len(want)), where=now > 0)
                x = x * factor[code]
                worst = max([worst, *np.abs(factor - 1)[want > 0]])
            if worst < TOLERANCE:
                break
        p = np.minimum(x, 1)
        first = (p, share) if first is None else first
        if all((np.abs(np.bincount(c, tokens * p, len(w)) - w * share) <= REACHED * w * share).all() for c, w in zip(codes, wanted, strict=True)):
            first = (p, share)
            break
        if not (x >= 1).any():
            break
    p, share = first
    out = [(*(r[m] for m in MARGINS), r["tokens"], *(float(w[c[i]]) for c, w in zip(codes, wanted, strict=True)), float(p[i]), float(share), float(p[i] / share)) for i, r in enumerate(rows)]
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in (cells.schema[m] for m in (*MARGINS, "tokens")))
    return cells.sparkSession.createDataFrame(out, f"{kinds}, {', '.join(f'target_{m} double' for m in MARGINS)}, probability double, budget double, weight double")


def rake(cells: DataFrame, targets: dict, budget: float) -> DataFrame:
    """cells (source, lang, topic, tokens) with probability, weight (probability / budget) and the budget that was used.

    The expected tokens of every value of every margin are its target: probabilities are the products of one factor per
    value, at most 1, and a cell at 1 leaves the rest of its margin to the cells below 1 in the next round. A value
    cannot give more tokens than it has, so the budget is at most the least ratio of tokens to target, less a
    hundredth; where cells at 1 still keep a target out of reach, smaller parts of it are tried.
    """
    total, many = cells.agg(F.sum("tokens"), F.count(F.lit(1))).first()
    if many <= DRIVER_CELLS:
        return rake_in_driver(cells, targets, budget)
    total = total or 0
    cells = cells.withColumn("_all", F.lit(float(total)))
    for margin in MARGINS:
        cells = cut(with_targets(cells, margin, targets.get(margin), budget), "cells")
    for margin in MARGINS:
        ratio = F.try_divide(F.col("has"), F.col("target"))
        needs = cells.groupBy(margin).agg(F.sum("tokens").alias("has"), F.max(f"target_{margin}").alias("target"))
        least = needs.where("target > 0 and has > 0").agg(F.min(ratio)).first()[0]
        if least is not None and least < budget * 1.01:
            budget = min(budget, 0.99 * least)
    p, first = F.least(F.lit(1.0), F.col("_x")), None
    for share in (budget * x for x in TRIES):
        fitted = cells.withColumn("_x", F.lit(float(share)))
        for _ in range(SWEEPS):
            off = []
            for margin in MARGINS:
                now = F.sum(F.col("tokens") * p).over(Window.partitionBy(margin))
                fitted = fitted.withColumn(f"_f_{margin}", F.coalesce(F.try_divide(F.col(f"target_{margin}") * share, now), F.lit(1.0)))
                fitted = fitted.withColumn("_x", F.col("_x") * F.col(f"_f_{margin}"))
                off.append(F.max(F.when(F.col(f"target_{margin}") > 0, F.abs(F.col(f"_f_{margin}") - 1))))
            swept = cut(fitted, "cells")
            worst = swept.agg(F.greatest(*off)).first()[0]
            fitted = swept.drop(*[f"_f_{m}" for m in MARGINS])
            if worst is None or worst < TOLERANCE:
                break
        fitted = fitted.withColumn("probability", p).withColumn("budget", F.lit(float(share))).withColumn("weight", F.col("probability") / F.col("budget"))
        first = fitted if first is None else first
        if not margins(fitted).where("not reached").limit(1).count():
            return fitted
        if not fitted.where("_x >= 1").limit(1).count():
            break
    return first


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang", topic: Column | None = None, targets: dict | None = None, budget: float = BUDGET, seed: int = SEED, draw_col: str | None = None) -> DataFrame:
    """One row per input row: id, source, lang, topic, tokens, weight, probability, kept.

    targets: per margin ("source", "lang", "topic") a share for each value; without them shares are tempered, and a rare
    value gets what it has at the most, so that it does not hold back the others. tokens are words; the topic is the shape of
    the text unless a column is given. Cells (source, language, topic) are summed before they are shuffled, so a source
    with a third of all rows is no hot spot; raking touches cells alone. A document is kept if a number drawn from its id
    (or draw_col) and the seed is below its probability, which is at most 1 and at which every margin's expected tokens meet its
    targets. Targets come before the budget: where ``budget`` of all tokens would need more of a value than there is,
    fewer tokens are sampled. Targets that no budget tried reaches, as margins contradict each other, are named in a
    warning; ``margins`` of the raked cells lists all. weight is probability / share of tokens sampled.

    Null sources, languages and topics are values like others. Null or empty text has no tokens and is drawn like the
    rest of its cell; a very long text counts whole. Rows with the same id draw the same number. An empty table gives an
    empty result; other columns of docs are not read, unless the topic names them.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    own = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(draw_col or id_col), F.lit(seed)).alias("_draw"), F.col(source_col).alias("source"), F.col(lang_col).alias("lang"), (topic_of(text) if topic is None else topic).alias("topic"), words_in(text).alias("tokens"))
    own = cut(own, "mixing")
    cells = cut(own.groupBy(*MARGINS).agg(F.sum("tokens").alias("tokens")), "cells")
    fitted = cut(rake(cells, targets or {}, budget), "fitted")
    forget(cells)
    lost = margins(fitted).where("not reached").limit(20).collect()
    if lost:
        warnings.warn("targets out of reach: " + ", ".join(f"{r.margin} {r.value} ({r.expected:.0f} of {r.target:.0f} tokens)" for r in lost), stacklevel=2)
    rates = fitted.select(*[F.col(m).alias(f"_{m}") for m in MARGINS], "weight", "probability")
    out = join_small(own, rates, {m: f"_{m}" for m in MARGINS}, "inner")
    drawn = F.pmod("_draw", F.lit(1 << 53)) / F.lit(float(1 << 53))
    return out.select(F.col("id").alias(id_col), "source", "lang", "topic", "tokens", "weight", "probability", (drawn < F.col("probability")).alias("kept"))


def op8_mix_sources(spark, sf_dir: str) -> DataFrame:
    return mix_sources(wide_table(spark, sf_dir, "documents"))
