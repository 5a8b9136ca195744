"""A scan per distinct place, kept in an append-only cache; and a guard over a tree of files."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hindcast.functions import scalar as S

AUDIT = "place string, load string, first_date string, last_date string, days long, missing double"


def place_key(lat: Column | str, lon: Column | str) -> Column:
    """The name of a place: both coordinates with four decimals, which also is what tells places apart."""
    number = lambda c: F.col(c) if isinstance(c, str) else c
    return F.concat(S.printed(number(lat), "%.4f"), F.lit("_"), S.printed(number(lon), "%.4f"))


def audited(spark: SparkSession, path: str) -> DataFrame:
    """The audit rows of all finished loads: one per place."""
    try:
        return spark.read.schema(AUDIT).parquet(f"{path.rstrip('/')}/audit")
    except AnalysisException:
        return spark.createDataFrame([], AUDIT)


def scan_places(spark: SparkSession, wanted: DataFrame, fetch: Callable[[DataFrame], DataFrame], path: str, values: Sequence[str], date: str = "date", place: str = "place") -> DataFrame:
    """Series of the wanted places, (place, date, values), from the cache; places that it lacks are fetched first.

    wanted has a place column, with repeats. fetch takes the table of new places, one row each, and returns their rows. A load
    writes gzip CSV files by place and then its audit rows, which name the load: rows count only once audited, so a load that
    was cut short is fetched again and never seen twice. A place without rows is audited with 0 days and not asked again.
    """
    base = path.rstrip("/")
    known = audited(spark, base)
    new = wanted.select(F.col(place).alias("place")).where("place is not null").distinct().join(known.select("place"), "place", "left_anti")
    if not new.isEmpty():
        load = uuid.uuid4().hex
        where = f"{base}/series/load={load}"
        new.write.parquet(f"{base}/asked/load={load}")
        asked = spark.read.schema("place string").parquet(f"{base}/asked/load={load}")
        rows = fetch(asked).select("place", F.col(date).cast("string").alias("date"), *values)
        rows.repartition("place").sortWithinPartitions("place", "date").write.partitionBy("place").option("compression", "gzip").option("header", True).csv(where)
        try:
            own = spark.read.option("header", True).schema("date string, " + ", ".join(f"{v} double" for v in values) + ", place string").csv(where)
        except AnalysisException:  # no place had a row
            own = spark.createDataFrame([], "date string, " + ", ".join(f"{v} double" for v in values) + ", place string")
        gaps = sum((F.col(v).isNull().cast("double") for v in values), F.lit(0.0)) / len(values)
        per = own.groupBy("place").agg(F.min("date").alias("first_date"), F.max("date").alias("last_date"), F.count(F.lit(1)).alias("days"), F.avg(gaps).alias("missing"))
        asked.join(per, "place", "left").select("place", F.lit(load).alias("load"), "first_date", "last_date", F.coalesce("days", F.lit(0)).alias("days"), "missing").write.mode("append").parquet(f"{base}/audit")
        known = audited(spark, base)
    schema = "date string, " + ", ".join(f"{v} double" for v in values) + ", load string, place string"
    finished = known.where("days > 0").select("load", "place")
    try:
        series = spark.read.option("header", True).option("basePath", f"{base}/series").schema(schema).csv(f"{base}/series")
    except AnalysisException:
        series = spark.createDataFrame([], schema)
    asked = wanted.select(F.col(place).alias("place")).distinct()
    return series.join(finished, ["load", "place"]).join(asked, "place", "left_semi").select("place", F.col("date").cast("date").alias("date"), *values)


def plain_name(name: str) -> str:
    return re.sub(r"[^a-z0-9]", "", name.lower())


def refuse_outcomes(spark: SparkSession, roots: Sequence[str], forbidden: Sequence[str]) -> int:
    """Walk the trees below roots and raise if a file bears a forbidden name, whatever its case and marks; else their number.

    Names alone are listed, by Spark, so any store that it reads can be walked; no file is opened. A missing root is skipped.
    """
    names = {plain_name(f) for f in forbidden}
    count = 0
    for root in roots:
        try:
            files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path")
        except AnalysisException:
            continue
        bare = F.regexp_replace(F.lower(F.element_at(F.split("path", "/"), -1)), "[^a-z0-9]", "")
        found = files.where(bare.isin(*names)).select("path").limit(5).collect()
        if found:
            raise PermissionError(f"outcomes before the seal: {[r['path'] for r in found]}")
        count += files.count()
    return count
