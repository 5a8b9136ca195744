"""Queries over sources, contracts, constrained decisions, ledgers and grounded answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from hindcast.functions import scalar as S
from hindcast.operators import aggregates as A
from hindcast.operators import answers as Q
from hindcast.operators import relational as R
from hindcast.operators import windows as W
from hindcast.sources import archives, readers
from hindcast.sources.scratch import shared_path

from .bindings import DAILY_SQL, PREDICTIONS_SQL, daily, load, n, predictions, r

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")
FILES = (*TABLES, "documents", "embeddings", "pages", "benchmark", "labels", "conversations")
MODELS = ("Mean", "G", "E", "G+E")


def required_tables(spark, d):
    """Rows of each table of a bundle that is read as a whole or not at all."""
    bundle = readers.read_all_or_none(spark, {t: f"{d}/{t}.parquet" for t in TABLES})
    out = None
    for name, df in bundle.items():
        one = df.agg(F.lit(name).alias("name"), n(F.count(F.lit(1)), "rows"))
        out = one if out is None else out.union(one)
    return out


def safe_manifest(spark, d):
    """Tables of a folder by the names of their files, and their rows; a file of another name raises before any is opened."""
    names = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(d).select(F.regexp_extract("path", r"([a-z]+)\.parquet", 1).alias("name")).distinct()
    known = spark.createDataFrame([(f,) for f in FILES], "name string")
    extra = names.join(known, "name", "left_anti").limit(5).collect()
    if extra:
        raise ValueError(f"unexpected files {[x['name'] for x in extra]}")
    out = None
    for name in FILES:
        one = load(spark, d, name).agg(F.lit(name).alias("name"), n(F.count(F.lit(1)), "rows"))
        out = one if out is None else out.union(one)
    return out.join(names, "name", "left_semi")


def json_sidecars(spark, d):
    """A canonical JSON record per year of orders, written, read again with its contract, and sealed."""
    own = load(spark, d, "orders").groupBy(F.year("o_orderdate").cast("long").alias("year")).agg(n(F.count(F.lit(1)), "orders"), n(F.countDistinct("o_custkey"), "customers"))
    path = shared_path(spark, "sidecars")
    readers.write_json_records(own, path)
    back = readers.read_json_records(spark, path, "customers long, orders long, year long")
    return back.select("year", "orders", "customers", "sha256")


def resolved_columns(spark, d):
    """Mean balance per segment, with both columns found by candidate names and one renamed by its prefix."""
    c = load(spark, d, "customer")
    segment, balance = R.resolve_column(c, ["Market Segment", "C MKT SEGMENT"]), R.resolve_column(c, ["balance", "C-AcctBal"])
    c = R.rename_by_prefix(c.withColumnRenamed(balance, "balance_usd"), "balance", ["balance"])
    return c.groupBy(F.col(segment).alias("segment")).agg(r(F.avg(F.col("balance").cast("double")), "balance"))


def column_block_means(spark, d):
    """Means of the columns prefix_STAGE of the daily table, by block and stage; columns of no block are left out."""
    own = daily(spark, d)
    found = R.column_blocks(own.columns, {"v": "value"}, excluded=["user"])
    long = F.explode(F.array(*[F.struct(F.lit(b).alias("block"), F.lit(s).alias("stage"), F.col(c).alias("x")) for c, b, s in found])).alias("c")
    return own.select(long).select("c.*").groupBy("block", "stage").agg(r(F.avg("x"), "mean", 6), n(F.count("x"), "rows"))


def spectral_weights(spark, d):
    """The two spectral filters of each embedding's length."""
    e = load(spark, d, "embeddings").withColumn("s", F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda t, x: t + x.cast("double") * x.cast("double"))))
    a, b = S.spectral_filters(F.col("s"), 10.0)
    return e.select("vec_id", r(a, "inverse", 6), r(b, "shrink", 6))


def archive_round_trip(spark, d):
    """Nations zipped by region, a member each, written, read as files and unpacked."""
    own = load(spark, d, "nation").select(F.concat(F.lit("region-"), F.col("n_regionkey").cast("string")).alias("archive"), F.concat("n_name", F.lit(".csv")).alias("member"), F.concat_ws(",", "n_nationkey", "n_name").alias("line"))
    path = shared_path(spark, "archives")
    archives.zipped(own, "archive", "member", "line").write.parquet(path)
    out = archives.archive_members(spark.read.parquet(path), "zip")
    cells = F.split(F.decode("content", "UTF-8"), ",")
    return out.select("archive", "member", n(cells[0], "n_nationkey"), cells[1].alias("n_name"))


def registry_links(spark, d):
    """Addresses in nested registry payloads, wherever they stand, cleaned."""
    web = F.concat(F.lit("https://registry.org/n/"), F.col("n_nationkey").cast("string"), F.lit(")."))
    zone = F.concat(F.lit("irods:/zone/"), F.col("n_name"))
    payload = F.to_json(F.struct(F.struct(F.array(web, F.lit("none")).alias("links"), F.struct(zone.alias("path")).alias("store")).alias("data"), F.col("n_name").alias("https")))
    return load(spark, d, "nation").select(n("n_nationkey", "n_nationkey"), F.array_join(archives.links_in_json(payload), " ").alias("links"))


def worlds(spark, d):
    """Per predictor and year: rmse and the share of errors of at most 8,000."""
    e = F.abs(F.col("predicted") - F.col("observed"))
    return predictions(spark, d).groupBy("model", "year").agg(F.round(F.sqrt(F.avg(e * e)), 6).alias("rmse"), F.round(F.avg((e <= 8000).cast("double")), 6).alias("coverage"))


WORLDS_SQL = PREDICTIONS_SQL + ", worlds AS (SELECT model, year, round(sqrt(avg((predicted-observed)**2)), 6) AS rmse, round(avg((abs(predicted-observed) <= 8000)::INT), 6) AS coverage FROM predictions GROUP BY ALL)"


def constrained_minimax(spark, d):
    """Predictor with the least worst loss among those whose coverage in every year is at least that of the mean's worst year."""
    per = worlds(spark, d).groupBy("model").agg(F.max("rmse").alias("worst"), F.min("coverage").alias("least"))
    bound = per.where("model = 'Mean'").select(F.col("least").alias("bound"))
    # one row: the bound
    per = per.join(F.broadcast(bound)).withColumn("feasible", F.col("least") >= F.col("bound"))
    best = per.where("feasible").agg(F.min_by("model", F.struct("worst", "model")).alias("best"))
    # one row: the choice
    return per.join(F.broadcast(best)).select("model", r("worst", "worst_loss"), r("least", "least_coverage", 6), "feasible", (F.col("model") == F.col("best")).alias("chosen"))


def transport_witnesses(spark, d):
    """Neighbours in source risk: pairs of nations that source years cannot tell apart, and how far target years can."""
    e = F.pow(F.col("predicted") - F.col("observed"), 2)
    p = predictions(spark, d).where("model = 'G+E'").groupBy("nation").agg(F.round(F.avg(F.when(F.col("year") < 2000, e)), 2).alias("s"), F.round(F.avg(F.when(F.col("year") >= 2000, e)), 2).alias("t"))
    k = W.numbered(p.where("s is not null and t is not null"), ["s", "nation"], "k")
    other = k.select((F.col("k") - 1).alias("k"), F.col("nation").alias("other"), F.col("s").alias("s2"), F.col("t").alias("t2"))
    gap = lambda a, b: F.abs(F.col(b) / F.col(a) - 1)
    out = k.join(other, "k").where(gap("s", "s2") <= 0.05)
    return out.select("nation", "other", r(gap("s", "s2"), "source_gap", 6), r(gap("t", "t2"), "target_gap", 6), (gap("t", "t2") > 0.05).alias("witness"))


#: (claim, better, worse): what a ledger states about predictors.
CLAIMS = (("entity effects help", "G", "Mean"), ("context effects help", "E", "Mean"), ("both beat entity effects", "G+E", "G"), ("both beat context effects", "G+E", "E"))


def claim_ledger(spark, d):
    """Claims about predictors checked against the metrics, overall and in how many years."""
    claims = spark.createDataFrame(list(CLAIMS), "claim string, better string, worse string")
    w = worlds(spark, d)
    a = w.select(F.col("model").alias("better"), "year", F.col("rmse").alias("ra"))
    b = w.select(F.col("model").alias("worse"), "year", F.col("rmse").alias("rb"))
    met = claims.join(a, "better").join(b, ["worse", "year"])
    out = met.groupBy("claim").agg(n(F.count_if(F.col("ra") < F.col("rb")), "years_held"), n(F.count(F.lit(1)), "years"))
    status = F.when(F.col("years_held") == F.col("years"), "SUPPORTED").when(F.col("years_held") == 0, "REFUTED").otherwise("MIXED")
    return out.select("claim", "years_held", "years", status.alias("status"))


KEYWORDS = (("error", "error"), ("error", "accura"), ("bias", "bias"), ("rows", "how many"))
QUESTIONS = (
    "What error does each model have?", "How accurate is the mean?", "Is there bias?", "How many cells were predicted?", "Which soil is best?", "Does the bias differ?",
    "Compare the errors.", "How many rows has G?", "Who won the cup?", "Is accuracy improving?", "Tell me about bias and error.",
)


def grounded_answers(spark, d):
    """Eleven questions against the metrics: grounded answers, answers with a made-up number, and none without evidence."""
    m = A.regression_metrics(predictions(spark, d), ["model"])
    facts = m.select("model", F.explode(F.array(*[F.struct(F.lit(t).alias("topic"), F.round(F.col(c).cast("double"), 2).alias("value")) for t, c in (("error", "rmse"), ("bias", "bias"), ("rows", "n"))])).alias("f")).select("model", "f.*")
    asked = spark.createDataFrame([(i + 1, q) for i, q in enumerate(QUESTIONS)], "case long, question string")
    provider = F.when(F.col("case") % 3 == 0, F.concat("template", F.lit("; and 12345.67"))).otherwise(F.col("template"))
    out = Q.grounded(Q.with_topic(asked, "question", KEYWORDS), Q.packets(facts, "topic", "model", "value"), provider)
    return out.select("case", "topic", "status", "answer")


def topic_case() -> str:
    return "CASE " + " ".join(f"WHEN contains(lower(question), '{w}') THEN '{t}'" for t, w in KEYWORDS) + " END"


QUERIES = {
    "required_tables": (required_tables, " UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS rows FROM {t}" for t in TABLES)),
    "safe_manifest": (safe_manifest, " UNION ALL ".join(f"SELECT '{f}' AS name, count(*) AS rows FROM {f}" for f in FILES)),
    "json_sidecars": (json_sidecars, """WITH x AS (SELECT year(o_orderdate)::BIGINT AS year, count(*) AS orders, count(DISTINCT o_custkey) AS customers FROM orders GROUP BY 1)
        SELECT *, sha256('{"customers":' || customers || ',"orders":' || orders || ',"year":' || year || '}') AS sha256 FROM x"""),
    "resolved_columns": (resolved_columns, "SELECT c_mktsegment AS segment, round(avg(c_acctbal), 4) + 0 AS balance FROM customer GROUP BY 1"),
    "column_block_means": (column_block_means, f"WITH {DAILY_SQL} " + " UNION ALL ".join(f"SELECT 'value' AS block, '{s}' AS stage, round(avg(v_{s}), 6) + 0 AS mean, count(v_{s}) AS rows FROM daily" for s in ("mean", "min", "max", "sum"))),
    "spectral_weights": (spectral_weights, "WITH s AS (SELECT vec_id, sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x*x))) AS s FROM embeddings) SELECT vec_id, round(s/(s*s+10), 6) AS inverse, round(s*s/(s*s+10), 6) AS shrink FROM s"),
    "archive_round_trip": (archive_round_trip, "SELECT 'region-' || n_regionkey AS archive, n_name || '.csv' AS member, n_nationkey::BIGINT AS n_nationkey, n_name FROM nation"),
    "registry_links": (registry_links, "SELECT n_nationkey::BIGINT AS n_nationkey, 'https://registry.org/n/' || n_nationkey || ' irods:/zone/' || n_name AS links FROM nation"),
    "constrained_minimax": (constrained_minimax, f"""WITH {WORLDS_SQL}, p AS (SELECT model, max(rmse) AS w, min(coverage) AS c FROM worlds GROUP BY model), f AS (SELECT *, c >= (SELECT c FROM p WHERE model = 'Mean') AS feasible FROM p)
        SELECT model, round(w, 4) AS worst_loss, round(c, 6) AS least_coverage, feasible, model = (SELECT arg_min(model, (w, model)) FROM f WHERE feasible) AS chosen FROM f"""),
    "transport_witnesses": (transport_witnesses, f"""WITH {PREDICTIONS_SQL}, p AS (SELECT nation, round(avg((predicted-observed)**2) FILTER (WHERE year < 2000), 2) AS s, round(avg((predicted-observed)**2) FILTER (WHERE year >= 2000), 2) AS t FROM predictions WHERE model = 'G+E' GROUP BY nation),
        k AS (SELECT *, lead(nation) OVER w AS other, lead(s) OVER w AS s2, lead(t) OVER w AS t2 FROM p WHERE s IS NOT NULL AND t IS NOT NULL WINDOW w AS (ORDER BY s, nation))
        SELECT nation, other, round(abs(s2/s - 1), 6) AS source_gap, round(abs(t2/t - 1), 6) AS target_gap, abs(t2/t - 1) > 0.05 AS witness FROM k WHERE abs(s2/s - 1) <= 0.05"""),
    "claim_ledger": (claim_ledger, f"""WITH {WORLDS_SQL}, c(claim, better, worse) AS (VALUES {', '.join(str(c) for c in CLAIMS)}), held AS (SELECT claim, count(*) FILTER (WHERE a.rmse < b.rmse) AS years_held, count(*) AS years FROM c JOIN worlds a ON a.model = better JOIN worlds b ON b.model = worse AND a.year = b.year GROUP BY claim)
        SELECT claim, years_held, years, CASE WHEN years_held = years THEN 'SUPPORTED' WHEN years_held = 0 THEN 'REFUTED' ELSE 'MIXED' END AS status FROM held"""),
    "grounded_answers": (grounded_answers, f"""WITH {PREDICTIONS_SQL}, mt AS (SELECT model, round(sqrt(avg((predicted-observed)**2)), 2) AS e, round(avg(predicted-observed), 2) AS b, count(*)::DOUBLE AS n FROM predictions GROUP BY model),
        f AS (SELECT model, 'error' AS topic, e AS v FROM mt UNION ALL SELECT model, 'bias', b FROM mt UNION ALL SELECT model, 'rows', n FROM mt), p AS (SELECT topic, topic || ': ' || string_agg(model || ' ' || printf('%.2f', v), '; ' ORDER BY model) AS t FROM f GROUP BY topic),
        q("case", question) AS (VALUES {', '.join(f"({i + 1}::BIGINT, '{x}')" for i, x in enumerate(QUESTIONS))}), k AS (SELECT "case", {topic_case()} AS topic FROM q)
        SELECT "case", topic, CASE WHEN t IS NULL THEN 'REFUSED' WHEN "case" % 3 = 0 THEN 'REPLACED' ELSE 'GROUNDED' END AS status, t AS answer FROM k LEFT JOIN p USING (topic)"""),
}
