"""Structured Streaming over the events table: windowed sums with late data, keyed state, cut-off checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hindcast.sources.scratch import shared_path


def event_stream(spark: SparkSession, sf_dir: str, name: str = "events") -> DataFrame:
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)


def drained(stream: DataFrame, mode: str, name: str) -> DataFrame:
    """Run a stream over what there is now and read its last result; every batch replaces the result as a whole."""
    spark = stream.sparkSession
    path, state = shared_path(spark, name), shared_path(spark, f"{name}-state")
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", state).trigger(availableNow=True)
    writer.foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(path)).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


def windowed_counts(stream: DataFrame, width: str = "6 hours", late: str = "1 day") -> DataFrame:
    """Rows, sum and largest value per event type and window; rows later than the watermark are not waited for."""
    s = stream.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    v = F.col("value").cast("decimal(18,6)")
    out = s.groupBy(F.window("at", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("rows"), F.sum(v).cast("double").alias("total"), F.max(v).cast("double").alias("largest"))
    return out.select(F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "rows", "total", "largest")


def running_users(stream: DataFrame) -> DataFrame:
    """First and last event and number of rows of each user, kept as state across batches."""
    s = stream.withColumn("at", F.col("ts").cast("timestamp"))
    out = s.groupBy("user_id").agg(F.min("at").alias("first"), F.max("at").alias("last"), F.count(F.lit(1)).alias("rows"))
    text = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    return out.select("user_id", text("first").alias("first"), text("last").alias("last"), "rows")


def admitted(df: DataFrame, date: str, issued: str) -> DataFrame:
    """Rows up to the issuance date; a later row is an error, not dropped."""
    late = F.raise_error(F.lit("row after issuance")).cast("boolean")
    return df.where(F.when(F.col(date) <= F.lit(issued).cast("date"), F.lit(True)).otherwise(late))
