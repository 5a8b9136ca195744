"""Wide matrices as rows of column blocks, and sums that grow batch by batch."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_blocks(df: DataFrame, row: str, values: str, path: str, width: int) -> None:
    """Write a matrix, one row with an array of all its columns each, as (row, block, values): ``width`` columns a block.

    The table is partitioned by block, so a scan of some columns reads the folders of their blocks alone.
    """
    many = F.ceil(F.size(values) / F.lit(width)).cast("int")
    blocks = df.where(F.size(values) > 0).select(F.col(row).alias("row"), F.col(values).alias("_v"), F.explode(F.sequence(F.lit(0), many - 1)).alias("block"))
    blocks = blocks.select("row", "block", F.slice("_v", F.col("block") * width + 1, F.lit(width)).alias("values"))
    blocks.write.partitionBy("block").parquet(path)


def read_columns(spark: SparkSession, path: str, columns: Sequence[int], width: int, order: DataFrame | None = None, key: str = "row", place: str = "place") -> DataFrame:
    """(row, values): the named columns of each row in the order given, repeats included; a column past the end is null.

    order: a table of row keys with their places. Rows then come once per place, as (place, row, values), missing rows with
    null values: the caller's order is restored by a join on the key and a sort by the reader, never by a scan in that order.
    """
    wanted = list(columns)
    needed = sorted({c // width for c in wanted})
    blocks = spark.read.parquet(path).where(F.col("block").isin(needed))
    per = blocks.groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct(F.col("block").cast("int"), "values"))).alias("_m"))  # as many as blocks asked for
    pick = [F.get(F.element_at("_m", F.lit(c // width)), F.lit(c % width)) for c in wanted]
    out = per.select("row", F.array(*pick).alias("values"))
    if order is None:
        return out
    return order.select(F.col(place).alias("place"), F.col(key).alias("row")).join(out, "row", "left").select("place", "row", "values")


def add_sums(batch: DataFrame, keys: Sequence[str], sums: dict, path: str, batch_id: int) -> None:
    """Write a batch's sums by key under its number. A batch that comes again replaces its own sums, so none counts twice."""
    batch.groupBy(*keys).agg(*[c.alias(n) for n, c in sums.items()]).write.mode("overwrite").parquet(f"{path.rstrip('/')}/batch={batch_id}")


def total_sums(spark: SparkSession, path: str, keys: Sequence[str], schema: str) -> DataFrame:
    """The sums over all batches so far. schema: of the sums, for a path that no batch has reached yet."""
    try:
        parts = spark.read.parquet(path)
    except AnalysisException:
        parts = spark.createDataFrame([], schema)
    names = [c for c in parts.columns if c not in keys and c != "batch"]
    return parts.groupBy(*keys).agg(*[F.sum(n).alias(n) for n in names])

