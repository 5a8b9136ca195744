"""Queries of structured kernels, product features, eigen-maps, genetic values, folds by structure, random draws, blocks."""

from __future__ import annotations

from pyspark.sql import functions as F

from hindcast.operators import aggregates as A
from hindcast.operators import draws as D
from hindcast.operators import spectral as P
from hindcast.operators import structured as S
from hindcast.sources import blocks as B
from hindcast.sources.scratch import shared_path, stored

from .bindings import load, n, plots, r
from .models import DOSE_SQL, designs, dosages

#: First words of part types; their shares are features of a brand.
TYPES = ("ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD")
ALPHA, GAMMA = 2.0, 0.5


def scaled(df, columns, width):
    """Columns standardised over the rows of df (one per entity or context) and divided by the root of width."""
    stats = df.agg(*[x for c in columns for x in (F.avg(c).alias(f"_m{c}"), F.stddev_pop(c).alias(f"_d{c}"))])
    z = lambda c: F.when(F.col(f"_d{c}") > 1e-12, (F.col(c) - F.col(f"_m{c}")) / F.col(f"_d{c}")).otherwise(0.0) / width**0.5
    # one row: means and deviations
    return df.join(F.broadcast(stats)).select(*[c for c in df.columns if c not in columns], *[z(c).alias(c) for c in columns])


def entity_features(spark, d):
    """Of each brand, no outcome: mean size, mean list price, shares of the part types."""
    word = F.split("p_type", " ")[0]
    own = [F.avg("p_size").alias("z0"), F.avg("p_retailprice").alias("z1"), *[F.avg((word == w).cast("double")).alias(f"z{k + 2}") for k, w in enumerate(TYPES)]]
    out = load(spark, d, "part").groupBy(F.col("p_brand").alias("entity")).agg(*own)
    names = [c for c in out.columns if c != "entity"]
    return scaled(out, names, len(names)), names


def context_features(spark, d):
    """Of each context, no outcome: mean quantity, its spread, the year, the nation's region by number."""
    region = load(spark, d, "nation").select(F.col("n_name").alias("nation"), F.col("n_regionkey").cast("double").alias("e3"))
    own = plots(spark, d).groupBy("context", "nation").agg(F.avg("l_quantity").alias("e0"), F.coalesce(F.stddev_pop("l_quantity"), F.lit(0.0)).alias("e1"), F.avg("year").alias("e2"))
    out = own.join(region, "nation").drop("nation")
    return scaled(out, ["e0", "e1", "e2", "e3"], 1), ["e0", "e1", "e2", "e3"]


FITS = ("regime", "scenario")


def structured_cells(spark, d):
    """Rows of three designs for the models G, G+E and G+E+GxE: fit, role, baseline of the training rows, gamma, features.

    The baseline is the training mean of the context for models with E, else of all; so is that of a context not trained on.
    """
    features, names = entity_features(spark, d)
    rows = stored(designs(spark, d).where("role <> 'unused'").join(features, "entity"), "designs")
    train = rows.where("role = 'train'")
    mean = train.groupBy(*FITS).agg(F.avg("observed").alias("_m"))
    own = train.groupBy(*FITS, "context").agg(F.avg("observed").alias("_e"))
    rows = rows.join(mean, list(FITS)).join(own, [*FITS, "context"], "left")
    models = [("G", 0.0, False), ("G+E", 0.0, True), ("G+E+GxE", GAMMA, True)]
    each = F.explode(F.array(*[F.struct(F.lit(m).alias("model"), F.lit(g).alias("gamma"), (F.coalesce("_e", "_m") if e else F.col("_m")).alias("baseline")) for m, g, e in models])).alias("x")
    out = rows.select(*FITS, "role", "entity", "context", "observed", *names, each).select("*", "x.*").drop("x")
    return out.withColumn("fit", F.concat_ws(" ", *FITS, "model")).withColumn("residual", F.col("observed") - F.col("baseline")), names


def structured_models(spark, d):
    """G, G+E and G+E+GxE by structured kernel ridge over all training cells of each fold of three designs; errors."""
    cells, names = structured_cells(spark, d)
    cells = stored(cells, "structured")
    whole, within, _ = S.structured_ridge(cells.where("role = 'train'"), "fit", "context", names, "residual", "gamma", ALPHA)
    out = S.structured_values(cells.where("role = 'test'"), whole, within, "fit", "context", names, "gamma").withColumn("predicted", F.col("baseline") + F.col("value"))
    m = A.regression_metrics(out, [*FITS, "model"])
    return m.select("regime", "scenario", "model", n("n", "n"), r("rmse", "rmse", 3), r("mae", "mae", 3))


def product_rows(spark, d, width=None):
    """Rows of three designs with one feature vector: of the entity, of the context, and their products."""
    g, gn = entity_features(spark, d)
    e, en = context_features(spark, d)
    g, e = g.select("entity", F.array(*gn).alias("g")), e.select("context", F.array(*en).alias("e"))
    rows = designs(spark, d).where("role <> 'unused'").join(g, "entity").join(e, "context")
    rows = rows.withColumn("x", F.concat("g", "e", S.product_features(F.col("g"), F.col("e"), width)))
    a, b = len(gn), len(en)
    own, both = list(range(a)), list(range(a + b))
    return rows, {"Mean": [], "G": own, "E": both[a:], "G+E": both, "G+E+GxE": list(range(a + b + (width or a * b)))}


def product_models(spark, d):
    """Ridge on entity features, context features and their products, in each fold of three designs; errors."""
    rows, models = product_rows(spark, d)
    rows = stored(rows, "products")
    fitted = S.fitted_models(rows.where("role = 'train'"), list(FITS), "x", "observed", models, ALPHA)
    m = A.regression_metrics(S.predicted_by(rows.where("role = 'test'"), fitted, list(FITS), "x"), [*FITS, "model"])
    return m.select("regime", "scenario", "model", n("n", "n"), r("rmse", "rmse", 3), r("mae", "mae", 3))


#: Blocks of an embedding's coordinates that get a kernel of their own; directions that a map keeps.
BLOCKS, RANK = (range(32), range(32, 64)), 24


def embedding_map(spark, d):
    e = load(spark, d, "embeddings")
    return e, P.kernel_map(e.where("label < 5"), "vec_id", "embedding", BLOCKS, RANK)


def kernel_map_scores(spark, d):
    """Each vector's scores under the map of two blocks' mean kernel, learned from half of the labels: the three leading sizes."""
    e, found = embedding_map(spark, d)
    s = e.select("vec_id", P.map_scores(found, "embedding").alias("s"))
    size = lambda k: F.abs(F.get("s", k))
    return s.select("vec_id", n(F.size("s"), "rank"), *[r(size(k), f"size{k + 1}", 5) for k in range(3)])


def projection_support(spark, d):
    """How much of each test vector's kernel the training directions hold, and what is left."""
    e, found = embedding_map(spark, d)
    own = P.projection_support(P.map_scores(found, "embedding"))
    return e.where("label >= 5").select("vec_id", own.alias("s")).select("vec_id", r("s", "support", 5), r(1 - F.col("s"), "residual", 5))


def genetic_values(spark, d):
    """Held-out genetic values of the label by fold: their error beside that of the training mean, which sums give."""
    e = load(spark, d, "embeddings").withColumn("fold", F.pmod("vec_id", F.lit(5))).withColumn("observed", F.col("label").cast("double"))
    out, fits = P.cross_fitted_values(e, "fold", "embedding", "observed")
    edge = spark.createDataFrame([(int(f), float(t), b) for f, t, b in fits], "fold long, log_delta double, at_bound boolean")
    m = A.regression_metrics(out, ["fold"]).join(F.broadcast(edge), "fold")  # a row per fold
    return m.select(n("fold", "fold"), n("n", "n"), r("rmse", "rmse", 3), r("log_delta", "log_delta", 2), "at_bound")


def structure_folds(spark, d):
    """Folds by k-means on five principal scores, the best of twenty starts: rows of each, and how tight it is."""
    e = P.principal_scores(load(spark, d, "embeddings").select("vec_id", "embedding"), "embedding", 5)
    e = stored(e, "scores")
    centres, _ = P.k_means(e, "vec_id", "scores", 5)
    out = e.select(P.cluster_of(centres, "scores").alias("fold"), F.aggregate("scores", F.lit(0.0), lambda s, x: s + x * x).alias("q"))
    return out.groupBy("fold").agg(n(F.count(F.lit(1)), "rows"), r(F.avg("q"), "mean_square", 4))


BUDGETS, DRAWS = (5, 10, 20), 5_000


def random_draws(spark, d):
    """5,000 random selections of each budget without replacement beside the moments that theory gives them.

    within: the mean of the selections' means, and of their hit rates, is within five standard errors of the table's; the
    spread within a tenth of that of draws without replacement.
    """
    o = load(spark, d, "orders").select("o_orderkey", F.col("o_totalprice").cast("double").alias("v"))
    cut = 200_000.0
    whole = o.agg(F.count(F.lit(1)).alias("size"), F.avg("v").alias("m"), F.stddev_samp("v").alias("sd"), F.avg((F.col("v") >= cut).cast("double")).alias("hits"))
    s = D.drawn_summary(D.drawn_budgets(o, "o_orderkey", "v", cut, BUDGETS, DRAWS)).join(F.broadcast(whole))  # one row: the table's moments
    spread = F.col("sd") * F.sqrt((1 - F.col("budget") / F.col("size")) / F.col("budget"))
    rate = F.sqrt(F.col("hits") * (1 - F.col("hits")) / F.col("budget"))
    near = lambda a, b, err: F.abs(F.col(a) - F.col(b)) <= 5 * err / F.sqrt("draws") + 1e-9
    return s.select(n("budget", "budget"), n("draws", "draws"), r("m", "expected", 2), near("mean", "m", spread).alias("mean_within"), (F.abs(F.col("spread") / spread - 1) < 0.1).alias("spread_within"), near("hit_rate", "hits", rate).alias("hits_within"))


#: Coordinates that the blocked scan asks for, in this order, and the width of a block.
COLUMNS, WIDTH = (50, 3, 17, 3), 16


def blocked_columns(spark, d):
    """Four coordinates of every vector through a table of column blocks, in the order of a caller's list."""
    e = load(spark, d, "embeddings")
    path = shared_path(spark, "blocks")
    B.write_blocks(e, "vec_id", "embedding", path, WIDTH)
    order = e.select("vec_id", (-F.col("vec_id")).alias("at"))
    out = B.read_columns(spark, path, COLUMNS, WIDTH, order, "vec_id", "at")
    return out.select(n("place", "place"), F.col("row").alias("vec_id"), *[r(F.col("values")[k].cast("double"), f"c{k}", 5) for k in range(len(COLUMNS))])


BATCHES = 4


def marker_sums_by_batch(spark, d):
    """Marker counts and dose sums from vectors that come in four batches, the third one twice: state is a row per marker and batch."""
    x = dosages(spark, d)
    path = shared_path(spark, "marker-sums")
    sums = {"n": F.count(F.lit(1)), "known": F.count("dose"), "total": F.sum("dose"), "square": F.sum(F.col("dose") * F.col("dose"))}
    for k in (0, 1, 2, 2, 3):
        B.add_sums(x.where(F.pmod("vec_id", F.lit(BATCHES)) == k), ["marker"], sums, path, k)
    out = B.total_sums(spark, path, ["marker"], "marker int, n long, known long, total long, square long")
    freq = F.col("total") / (2 * F.col("known"))
    return out.select(n("marker", "marker"), n("n", "n"), r(freq, "freq", 6), r(F.least(freq, 1 - freq), "maf", 6), r(1 - F.col("known") / F.col("n"), "missing", 6), n("square", "square"))


QUERIES = {
    "structured_models": (structured_models, None),
    "product_models": (product_models, None),
    "kernel_map_scores": (kernel_map_scores, None),
    "projection_support": (projection_support, None),
    "genetic_values": (genetic_values, None),
    "structure_folds": (structure_folds, None),
    "random_draws": (random_draws, f"SELECT b::BIGINT AS budget, {DRAWS}::BIGINT AS draws, round(avg(o_totalprice::DOUBLE), 2) AS expected, true AS mean_within, true AS spread_within, true AS hits_within FROM orders, (VALUES (5), (10), (20)) t(b) GROUP BY b"),
    "blocked_columns": (blocked_columns, "SELECT -vec_id AS place, vec_id, " + ", ".join(f"round(embedding[{c + 1}]::DOUBLE, 5) + 0 AS c{k}" for k, c in enumerate(COLUMNS)) + " FROM embeddings"),
    "marker_sums_by_batch": (marker_sums_by_batch, f"""WITH {DOSE_SQL}, f AS (SELECT marker, count(*) AS n, avg(dose) / 2 AS f, sum(dose * dose)::BIGINT AS square FROM dose GROUP BY marker)
        SELECT marker, n, round(f, 6) AS freq, round(least(f, 1 - f), 6) AS maf, 0.0::DOUBLE AS missing, square FROM f"""),
}
