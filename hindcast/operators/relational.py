"""Joins with contracts, set operations, reshaping, validation."""

from __future__ import annotations

import re
from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

#: Vectors of a block where all pairs are looked at, at least; blocks that a larger table is cut into; bytes that bound a block.
BLOCK, GRID, BLOCK_BYTES = 2_000, 24, 32 << 20
#: Left vectors of a block that are looked at together.
STEP = 128

# columns and contracts


def plain(name: str) -> str:
    return re.sub("[^a-z0-9]", "", name.lower())


def resolve_column(df: DataFrame, candidates: Sequence[str], required: bool = True) -> str | None:
    """The first candidate among the columns: exact names first, then names without case and punctuation."""
    for c in candidates:
        if c in df.columns:
            return c
    known = {}
    for c in df.columns:
        known.setdefault(plain(c), c)
    for c in candidates:
        if plain(c) in known:
            return known[plain(c)]
    if required:
        raise ValueError(f"none of {list(candidates)} among {df.columns}")
    return None


def rename_by_prefix(df: DataFrame, name: str, prefixes: Sequence[str]) -> DataFrame:
    """Rename the one column that starts with a prefix; with none or several, nothing happens."""
    found = [c for c in df.columns if any(plain(c).startswith(plain(p)) for p in prefixes)]
    return df.withColumnRenamed(found[0], name) if len(found) == 1 and name not in df.columns else df


def require_columns(df: DataFrame, names: Sequence[str], label: str = "table") -> DataFrame:
    missing = sorted(set(names) - set(df.columns))
    if missing:
        raise ValueError(f"{label} lacks {missing}")
    return df


def violations(df: DataFrame, rules: dict[str, Column], keys: Sequence[str] = ()) -> DataFrame:
    """One row: how often each rule fails, null counting as failure, and how many rows share a key with an earlier one."""
    aggs = [F.count_if(~F.coalesce(rule, F.lit(False))).alias(name) for name, rule in rules.items()]
    out = df.agg(F.count(F.lit(1)).alias("rows"), *aggs)
    if keys:
        repeats = df.groupBy(*keys).agg((F.count(F.lit(1)) - 1).alias("_d")).agg(F.coalesce(F.sum("_d"), F.lit(0)).alias("repeated_keys"))
        out = out.withColumn("_one", F.lit(1)).join(repeats.withColumn("_one", F.lit(1)), "_one").drop("_one")
    return out


def unique_by(df: DataFrame, keys: Sequence[str], label: str) -> DataFrame:
    again = df.groupBy(*keys).count().where("count > 1").limit(1).collect()
    if again:
        raise ValueError(f"{label} repeats key {again[0].asDict()}")
    return df


# joins


def checked_join(left: DataFrame, right: DataFrame, keys: Sequence[str], validate: str, how: str = "inner") -> DataFrame:
    """Join after checking that the declared sides hold each key once: one_to_one, one_to_many, many_to_one, many_to_many."""
    a, b = validate.split("_to_")
    if a == "one":
        unique_by(left, keys, "left side")
    if b == "one":
        unique_by(right, keys, "right side")
    return left.join(right, list(keys), how)


def complete_join(left: DataFrame, right: DataFrame, keys: Sequence[str], strict: bool = True) -> DataFrame:
    """Left join that reports rows without a partner: an error when strict, else a flag ``matched``."""
    out = left.join(right.withColumn("_hit", F.lit(True)), list(keys), "left").withColumn("matched", F.coalesce("_hit", F.lit(False))).drop("_hit")
    if not strict:
        return out
    return out.where(F.when(F.col("matched"), F.lit(True)).otherwise(F.raise_error(F.lit("row without a partner")).cast("boolean")))


def membership_join(left: DataFrame, answer: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Rows of left with a flag ``present`` that depends on the keys in answer alone, never on its values."""
    own = answer.select(*keys).distinct().withColumn("_p", F.lit(True))
    flagged = left.join(own, list(keys), "left").withColumn("present", F.coalesce("_p", F.lit(False))).drop("_p")
    return flagged.join(answer.select(*keys, *values), list(keys), "left")


def paired(df: DataFrame, keys: Sequence[str], label: str, a: str, b: str, value: str) -> DataFrame:
    """The same entity under two labels, side by side, in one pass; entities that lack either are left out."""
    pick = lambda v: F.max(F.when(F.col(label) == v, F.col(value)))
    return df.where(F.col(label).isin(a, b)).groupBy(*keys).agg(pick(a).alias("a"), pick(b).alias("b")).where(F.col("a").isNotNull() & F.col("b").isNotNull())


def interval_join(anchors: DataFrame, series: DataFrame, keys: Sequence[str], date: str, low: Column, high: Column) -> DataFrame:
    """Rows of a series within [low, high] of their key's anchors; the keys keep it from being a product."""
    renamed = series.withColumnRenamed(date, "_date")
    return anchors.join(renamed, list(keys)).where(F.col("_date").between(low, high)).withColumnRenamed("_date", date)


def nearest_match(left: DataFrame, right: DataFrame, keys: Sequence[str], left_time: str, right_time: str, value: str) -> DataFrame:
    """For each left row the right row of its key whose time is nearest, earlier of equals; null if the key has none.

    Candidates are the last right row up to the left row and the first one after it: two window passes over the stacked
    rows, so a key with many rows on both sides forms no pairs.
    """
    columns = left.columns
    stack = left.withColumn("_t", F.col(left_time)).withColumn("_left", F.lit(1)).unionByName(
        right.select(*keys, F.col(right_time).alias("_t"), F.struct(F.col(right_time).alias("t"), F.col(value).alias("v")).alias("_r"), F.lit(0).alias("_left")), allowMissingColumns=True
    )
    w = Window.partitionBy(*keys)
    back = F.last("_r", ignorenulls=True).over(w.orderBy("_t", "_left").rowsBetween(Window.unboundedPreceding, 0))
    ahead = F.last("_r", ignorenulls=True).over(w.orderBy(F.col("_t").desc(), "_left").rowsBetween(Window.unboundedPreceding, 0))
    both = stack.withColumn("_b", back).withColumn("_a", ahead).where("_left = 1")
    gap = lambda c: F.abs(F.unix_micros(F.col(c)["t"].cast("timestamp")) - F.unix_micros(F.col("_t").cast("timestamp")))
    best = F.when(F.col("_b").isNull() | (gap("_a") < gap("_b")), F.col("_a")).otherwise(F.col("_b"))
    return both.withColumn("_best", best).select(*columns, F.col("_best.t").alias(right_time), F.col("_best.v").alias(value))


def in_steps(meet, step: int = STEP):
    """meet for some left rows at a time, so that no product is larger than ``step`` left rows times a block: more of them where
    the right rows are fewer."""

    def stepped(i: np.ndarray, x: np.ndarray, j: np.ndarray, y: np.ndarray) -> pd.DataFrame:
        rows = max(step, step * BLOCK // max(1, len(j)))
        return pd.concat([meet(i[s : s + rows], x[s : s + rows], j, y) for s in range(0, len(i), rows)], ignore_index=True)

    return stepped


def block_pairs(left: DataFrame, right: DataFrame, id_col: str, vec: str, meet, schema: str, block: int | None = None) -> DataFrame:
    """meet(left ids, left matrix, right ids, right matrix) of every block of left rows with every block of right rows.

    All pairs are looked at, but none is a row: a task holds two blocks of about ``block`` vectors each, dealt by a hash
    of the id, and returns what meet makes of ``STEP`` left rows at a time (a frame with the columns of schema; each left
    row comes once per right block). Without ``block`` a side is cut into ``GRID`` blocks, which keeps the vectors shuffled
    in proportion to the rows; into fewer that are not smaller than ``BLOCK``, into more that do not pass ``BLOCK_BYTES``.
    """

    def blocks(df: DataFrame) -> int:
        rows, width = df.agg(F.count(F.lit(1)), F.max(F.size(vec))).first()
        most = max(1, BLOCK_BYTES // (8 * max(1, width or 1)))
        return max(1, -(-rows // (block or min(max(BLOCK, -(-rows // GRID)), most))))

    a, b = blocks(left), blocks(right)
    # both numbers are int on both sides: a cogroup hashes keys as they are, and a long and an int of one value fall apart
    deal = lambda df, own, salt, n, other, m: df.select(F.col(id_col).alias("i"), F.transform(vec, lambda x: x.cast("double")).alias("v"), F.pmod(F.xxhash64(id_col, F.lit(salt)), F.lit(n)).cast("int").alias(own), F.explode(F.sequence(F.lit(0), F.lit(m - 1))).alias(other))
    mine, theirs = deal(left, "a", 1, a, "b", b), deal(right, "b", 2, b, "a", a)
    stepped = in_steps(meet)

    def both(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        if not len(x) or not len(y):
            return pd.DataFrame({c.split()[0]: [] for c in schema.split(", ")})
        return stepped(x["i"].to_numpy(), np.stack(x["v"].to_numpy()), y["i"].to_numpy(), np.stack(y["v"].to_numpy()))

    return mine.groupBy("a", "b").cogroup(theirs.groupBy("a", "b")).applyInPandas(both, schema)


def squared_distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.maximum((x**2).sum(1)[:, None] + (y**2).sum(1)[None, :] - 2 * x @ y.T, 0)


def least_distances(k: int):
    """What two blocks keep: for each left row its k nearest right rows, equal distances to the lesser id.

    Products round, so every right row within their error of the k-th is measured anew: however many copies of a vector tie
    there, all of them are.
    """

    def least(i: np.ndarray, x: np.ndarray, j: np.ndarray, y: np.ndarray) -> pd.DataFrame:
        d, many = squared_distances(x, y), min(len(j), k)
        slack = 1e-10 * ((x**2).sum(1) + (y**2).sum(1).max())
        last = np.partition(d, many - 1, axis=1)[:, many - 1] if many > 1 else d.min(1)
        at, near = np.nonzero(d <= (last + slack)[:, None])
        exact = np.zeros(len(at))
        for c in range(x.shape[1]):
            exact += (x[at, c] - y[near, c]) ** 2
        order = np.lexsort((j[near], exact, at))
        order = order[np.arange(len(at)) - np.searchsorted(at, at) < k]  # at ascends in both orders
        return pd.DataFrame({"i": i[at[order]], "d": exact[order], "j": j[near[order]]})

    return least


def summed_nearest(met: DataFrame, id_col: str, k: int) -> DataFrame:
    w = Window.partitionBy("i").orderBy("d", "j")
    ranked = met.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= k)
    return ranked.groupBy(F.col("i").alias(id_col)).agg(F.min(F.struct("d", "j"))["j"].alias("nearest"), F.min("d").alias("nearest_sq"), F.avg("d").alias("mean_k_sq"))


def nearest_points(test: DataFrame, train: DataFrame, id_col: str, vec: str, k: int = 5) -> DataFrame:
    """Per test point: nearest train point, squared distance to it, mean of the k least.

    Blocks meet as matrix products and keep their k least, measured anew as the products round.
    """
    kind = test.schema[id_col].dataType.simpleString()
    return summed_nearest(block_pairs(test, train, id_col, vec, least_distances(k), f"i {kind}, d double, j {kind}"), id_col, k)


def reachable_cells(pivots: np.ndarray, count: np.ndarray, radius: np.ndarray, x: np.ndarray, k: int) -> list[np.ndarray]:
    """For each row of x the cells that may hold one of its k nearest points.

    A cell's points lie within its radius of its pivot, and no pivot is nearer to them than their own. So their distances to x
    are bounded from below by the triangle inequality, and by the plane half way between their pivot and the one nearest to x.
    Pivots are points, so the k-th nearest one bounds the k-th distance from above, and so do the cells of the least upper
    bounds that hold k points together. As many rows are looked at together as make ``STEP`` times ``BLOCK`` distances.
    """
    held = np.flatnonzero(count > 0)
    p, n, r = pivots[held], count[held], radius[held]
    if not len(held):
        return [held] * len(x)
    most, many = ((np.sqrt((p**2).sum(1)) + r) ** 2).max(), min(k, len(held))
    out = []
    step = max(1, STEP * BLOCK // len(held))
    for s in range(0, len(x), step):
        part = x[s : s + step]
        scale = ((part**2).sum(1) + most)[:, None]
        slack = 1e-12 * scale  # more than a squared distance rounds by
        sq = squared_distances(part, p)
        home = sq.argmin(1)
        d = np.sqrt(sq)
        bound = np.partition(d, k - 1, axis=1)[:, k - 1] if many == k > 1 else d.min(1) if k == 1 else np.full(len(d), np.inf)
        if k > 1:  # no upper bound of a cell is below its pivot's distance
            least = np.argpartition(d + r, many - 1, axis=1)[:, :many]
            ends = np.take_along_axis(d + r, least, 1)
            order = np.argsort(ends, axis=1)
            enough = np.cumsum(np.take_along_axis(n[least], order, 1), axis=1) >= k
            ends = np.where(enough.any(1)[:, None], np.take_along_axis(ends, order, 1), np.inf)
            bound = np.minimum(bound, np.take_along_axis(ends, enough.argmax(1)[:, None], 1)[:, 0])
        gap = squared_distances(p[home], p)
        beyond = sq - np.take_along_axis(sq, home[:, None], 1) - slack
        # pivots that nearly coincide have no plane between them that could be told from rounding
        plane = np.divide(beyond, 2 * np.sqrt(gap), out=np.zeros_like(sq), where=gap > 1e-6 * scale)
        near = np.maximum(d - r, plane) <= bound[:, None] * (1 + 1e-9) + 2 * np.sqrt(slack)
        out += [held[np.flatnonzero(row)] for row in near]
    return out


def pruned_nearest(test: DataFrame, train: DataFrame, id_col: str, vec: str, k: int = 5, pivots: int = 64, block: int = BLOCK) -> DataFrame:
    """``nearest_points`` without meeting every block: train points stand in cells about pivots, test points visit few cells.

    The pivots are a random draw of train points (at most ``pivots``); a train point belongs to its nearest one. What a cell
    holds and how far it reaches are known in the driver, two numbers a pivot. Exact: a cell is left out only where
    ``reachable_cells`` rules it out. Cells, and the test points that visit one, are dealt in blocks of about ``block`` rows, so
    a cell with a third of all points is many tasks. Equal distances go to the lesser id.
    """
    from hindcast.sources.scratch import stored

    from .draws import drawn

    doubles = lambda df: df.select(F.col(id_col).alias("i"), F.transform(vec, lambda x: x.cast("double")).alias("v"))
    kind = test.schema[id_col].dataType.simpleString()
    empty = test.sparkSession.createDataFrame([], f"i {kind}, d double, j {kind}")
    train, test = doubles(train), doubles(test)
    centres = np.array([r["v"] for r in drawn(train, "i", ["v"], 1, pivots).collect()])  # at most as many rows as pivots
    if not len(centres):
        return summed_nearest(empty, id_col, k)

    @F.pandas_udf("cell int, away double")
    def cell_of(rows: pd.Series) -> pd.DataFrame:
        if not len(rows):
            return pd.DataFrame({"cell": pd.Series([], dtype="int32"), "away": pd.Series([], dtype="float64")})
        x = np.stack(rows.to_numpy())
        step = max(1, STEP * BLOCK // len(centres))
        at = np.concatenate([squared_distances(x[s : s + step], centres).argmin(1) for s in range(0, len(x), step)])
        return pd.DataFrame({"cell": at.astype(np.int32), "away": np.sqrt(((x - centres[at]) ** 2).sum(1))})

    placed = stored(train.select("i", "v", cell_of("v").alias("c")).select("i", "v", "c.*"), "placed")
    count, radius = np.zeros(len(centres), np.int64), np.zeros(len(centres))
    for r in placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("away").alias("r")).collect():  # a row per pivot
        count[r["cell"]], radius[r["cell"]] = r["n"], r["r"]

    @F.pandas_udf("array<int>")
    def visited(rows: pd.Series) -> pd.Series:
        return pd.Series(reachable_cells(centres, count, radius, np.stack(rows.to_numpy()), k)) if len(rows) else rows

    visits = stored(test.select("i", "v", F.explode(visited("v")).alias("cell")), "visits")
    guests = {r["cell"]: r["n"] for r in visits.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}
    blocks = [(c, -(-int(count[c]) // block), -(-n // block)) for c, n in guests.items()]
    parts = F.broadcast(test.sparkSession.createDataFrame(blocks, "cell int, own int, guests int"))  # a row per pivot
    deal = lambda df, mine, other, a, b, salt: df.join(parts, "cell").select("cell", "i", "v", F.pmod(F.xxhash64("i", F.lit(salt)), F.col(mine)).cast("int").alias(a), F.explode(F.sequence(F.lit(0), F.col(other) - 1)).alias(b))
    left, right = deal(visits, "guests", "own", "a", "b", 1), deal(placed, "own", "guests", "b", "a", 2)
    least = in_steps(least_distances(k))
    arrow = to_arrow_schema(empty.schema)

    def both(x: pa.Table, y: pa.Table) -> pa.Table:
        if not len(x) or not len(y):
            return arrow.empty_table()
        ids = lambda rows: rows["i"].to_pandas().to_numpy()
        matrix = lambda rows: rows["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(rows), -1)
        return pa.Table.from_pandas(least(ids(x), matrix(x), ids(y), matrix(y)), arrow, preserve_index=False)

    met = left.groupBy("cell", "a", "b").cogroup(right.groupBy("cell", "a", "b")).applyInArrow(both, empty.schema)
    return summed_nearest(met, id_col, k)


def on_sphere(lat: Column, lon: Column) -> Column:
    """The point of the unit sphere: the nearest along the ground is the nearest straight through it."""
    a, b = F.radians(lat), F.radians(lon)
    return F.array(F.cos(a) * F.cos(b), F.cos(a) * F.sin(b), F.sin(a))


def place_pivots(rows: int) -> int:
    """Pivots for so many train places: twice the root, so a place's distances to pivots and to the points of the few cells that it
    visits grow alike."""
    return max(64, 2 * int(rows**0.5))


def nearest_places(test: DataFrame, train: DataFrame, id_col: str, lat: str, lon: str, radius: float = 6371.0088) -> DataFrame:
    """(id, nearest, km): the nearest train place of each test place by great circle, through ``pruned_nearest``.

    On a sphere a place visits few cells however many there are, so their number grows with the root of the train rows.
    """
    point = lambda df: df.select(id_col, on_sphere(F.col(lat), F.col(lon)).alias("p"))
    out = pruned_nearest(point(test), point(train), id_col, "p", 1, place_pivots(train.count()))
    return out.select(id_col, "nearest", (2 * radius * F.asin(F.least(F.lit(1.0), F.sqrt("nearest_sq") / 2))).alias("km"))


def kernel_sums(test: DataFrame, train: DataFrame, id_col: str, vec: str, weight: str, kernel) -> DataFrame:
    """(id, value): sum over train rows of kernel(squared distance) times their weight, block by block, no pair a row."""
    left = test.select(id_col, F.concat(vec, F.array(F.lit(0.0))).alias("_v"))
    right = train.select(id_col, F.concat(vec, F.array(F.col(weight).cast("double"))).alias("_v"))

    def sums(i: np.ndarray, x: np.ndarray, j: np.ndarray, y: np.ndarray) -> pd.DataFrame:
        return pd.DataFrame({"i": i, "s": kernel(squared_distances(x[:, :-1], y[:, :-1])) @ y[:, -1]})

    met = block_pairs(left, right, id_col, "_v", sums, f"i {test.schema[id_col].dataType.simpleString()}, s double")
    return met.groupBy(F.col("i").alias(id_col)).agg(F.sum("s").alias("value"))


def support_geometry(test: DataFrame, train: DataFrame, id_col: str, vec: str, bandwidth: float) -> DataFrame:
    """Per test point, over all train points: largest and mean Gaussian similarity, and the share within the bandwidth."""

    def sums(i: np.ndarray, x: np.ndarray, j: np.ndarray, y: np.ndarray) -> pd.DataFrame:
        d = squared_distances(x, y)
        k = np.exp(-d / bandwidth)
        return pd.DataFrame({"i": i, "n": len(j), "most": k.max(1), "total": k.sum(1), "near": (d <= bandwidth).sum(1)})

    met = block_pairs(test, train, id_col, vec, sums, f"i {test.schema[id_col].dataType.simpleString()}, n long, most double, total double, near long")
    return met.groupBy(F.col("i").alias(id_col)).agg(F.max("most").alias("similarity"), (F.sum("total") / F.sum("n")).alias("density"), (F.sum("near") / F.sum("n")).alias("mass"))


def shared_pairs(df: DataFrame, entity: str, context: str, value: str) -> DataFrame:
    """Contrasts between two contexts a < b over the entities that both have: n, mean difference, mean absolute one."""
    a = df.select(entity, F.col(context).alias("a"), F.col(value).alias("va"))
    b = df.select(entity, F.col(context).alias("b"), F.col(value).alias("vb"))
    return a.join(b, entity).where("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("vb") - F.col("va")).alias("mean_diff"), F.avg(F.abs(F.col("vb") - F.col("va"))).alias("mean_abs_diff"))


# sets and shapes


def set_report(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """One row: missing and extra keys of right against left, and whether the sets are equal."""
    a, b = left.select(key).distinct().withColumn("_a", F.lit(1)), right.select(key).distinct().withColumn("_b", F.lit(1))
    miss, extra = F.count_if(F.col("_b").isNull()), F.count_if(F.col("_a").isNull())
    return a.join(b, key, "full").agg(miss.alias("missing"), extra.alias("extra"), ((miss == 0) & (extra == 0)).alias("equal"))


def repeated_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")


def first_per_key(df: DataFrame, keys: Sequence[str], *order) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def melt(df: DataFrame, ids: Sequence[str], columns: Sequence[str], name: str = "context", value: str = "observed") -> DataFrame:
    return df.unpivot(list(ids), list(columns), name, value)


def one_hot(df: DataFrame, key: str, category: str, values: Sequence[str]) -> DataFrame:
    """A 0/1 column for each category, in the order given."""
    return df.groupBy(key).agg(*[F.max(F.when(F.col(category) == v, 1).otherwise(0)).cast("long").alias(f"is_{plain(v)}") for v in values])


def with_missing_flag(df: DataFrame, column: str) -> DataFrame:
    return df.withColumn(f"{column}_missing", F.col(column).isNull().cast("double")).withColumn(column, F.coalesce(F.col(column), F.lit(0.0)))


def column_blocks(names: Sequence[str], blocks: dict[str, str], excluded: Sequence[str] = ()) -> list[tuple[str, str, str]]:
    """(name, block, stage) of columns named prefix_STAGE whose prefix has a block; excluded prefixes go."""
    out = []
    for name in names:
        prefix, _, stage = name.partition("_")
        if stage and prefix in blocks and prefix not in excluded:
            out.append((name, blocks[prefix], stage))
    return out


def forbidden_columns(names: Sequence[str], tokens: Sequence[str]) -> list[str]:
    return [n for n in names if any(plain(t) in plain(n) for t in tokens)]
