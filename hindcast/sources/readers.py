"""Readers and writers with contracts: declared CSV schemas, dialects, nested daily JSON, manifests, canonical sinks."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Tried in this order; the first under which the header has two columns or more is taken.
ENCODINGS, SEPARATORS = ("UTF-8", "UTF-16", "ISO-8859-1"), (",", "\t", ";", "|", " ")
MISSING = -999.0


def exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def read_csv(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """CSV with a header and a declared schema; a malformed row fails the read, and no type is guessed."""
    return spark.read.schema(schema).option("header", True).option("mode", "FAILFAST").option("enforceSchema", False).csv(path)


def read_all_or_none(spark: SparkSession, paths: dict[str, str]) -> dict[str, DataFrame]:
    """Parquet tables by name, if every one exists; else an error that names what is absent."""
    absent = sorted(name for name, path in paths.items() if not exists(spark, path))
    if absent:
        raise FileNotFoundError(f"no {absent}")
    return {name: spark.read.parquet(path) for name, path in paths.items()}


def read_any_dialect(spark: SparkSession, path: str) -> DataFrame:
    for encoding in ENCODINGS:
        for sep in SEPARATORS:
            head = spark.read.option("encoding", encoding).text(path).limit(1).collect()
            if head and len((head[0][0] or "").split(sep)) >= 2 and "�" not in head[0][0]:
                return spark.read.option("header", True).option("sep", sep).option("encoding", encoding).csv(path)
    raise ValueError(f"no dialect gives {path} two columns")


def read_daily_json(spark: SparkSession, path: str, names: Sequence[str]) -> DataFrame:
    """{"properties": {"parameter": {NAME: {yyyymmdd: value}}}} to a row per day; the missing mark becomes null."""
    raw = spark.read.text(path, wholetext=True).select(F.from_json("value", "properties struct<parameter: map<string, map<string, double>>>").alias("j"))
    long = raw.select(F.explode("j.properties.parameter").alias("name", "days")).select("name", F.explode("days").alias("day", "value"))
    long = long.select("name", F.to_date("day", "yyyyMMdd").alias("date"), F.nullif("value", F.lit(MISSING)).alias("value"))
    return long.groupBy("date").pivot("name", list(names)).agg(F.first("value"))


def manifest(spark: SparkSession, path: str, allowed: Sequence[str] | None = None) -> DataFrame:
    """name and length of the files under a path, contents unread; a file that is not allowed raises."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select(F.element_at(F.split("path", "/"), -1).alias("name"), "length")
    if allowed is not None:
        known = spark.createDataFrame([(a,) for a in allowed], "name string")
        extra = [r["name"] for r in files.join(known, "name", "left_anti").limit(5).collect()]
        if extra:
            raise ValueError(f"unexpected files {extra}")
    return files


def digests(spark: SparkSession, path: str) -> DataFrame:
    """name and SHA-256 of small files; each is read whole by one task."""
    return spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("name"), F.sha2("content", 256).alias("sha256"))


def write_sorted_csv(df: DataFrame, path: str, *order: str) -> None:
    """CSV with a header, in an order that the rows alone decide; ranges are sorted across files."""
    df.orderBy(*order).write.option("header", True).csv(path)


def canonical_json(record: dict) -> str:
    return json.dumps(record, sort_keys=True, indent=2, default=str)


def write_json_records(df: DataFrame, path: str) -> None:
    """One canonical JSON text per row: keys in order, nulls written, nothing between marks."""
    df.select(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}).alias("value")).write.text(path)


def read_json_records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The records with the SHA-256 of each text. A text that is not of the schema, or not canonical, raises."""
    own = spark.read.text(path).select(F.col("value"), F.from_json("value", schema, {"mode": "FAILFAST"}).alias("r"))
    fields = sorted(own.schema["r"].dataType.names)
    again = F.to_json(F.struct(*[F.col("r")[f].alias(f) for f in fields]), {"ignoreNullFields": "false"})
    checked = F.when(again == F.col("value"), F.sha2("value", 256)).otherwise(F.raise_error(F.concat(F.lit("not canonical: "), "value")).cast("string"))
    return own.select("r.*", checked.alias("sha256"))
