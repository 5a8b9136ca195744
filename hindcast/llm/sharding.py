"""Shards of a shuffled table by a two-pass external shuffle. DataFrame operations only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, forget, table

#: Bytes of a bucket that one task shuffles in memory; what a row takes there besides its strings.
BUCKET_BYTES, ROW_BYTES = 8 << 20, 64
#: Buckets whose sizes are added up together, before their sums are.
RUN = 1024
#: What a document takes in a shard besides its text.
DOCUMENT_BYTES = 16


def external_shuffle(rows: DataFrame, seed: int = 0, bucket_bytes: int = BUCKET_BYTES) -> tuple[DataFrame, int]:
    """rows in a random order that the seed fixes, with ``place`` gapless from 0; and the number of rows.

    Pass 1 scatters rows into buckets by a seeded hash of their place in the written table, so that neither one id nor a
    hundred million copies of a text make a bucket larger than others. The buckets' number comes from the counted bytes.
    Pass 2 puts each bucket in a Fisher-Yates order (Spark's ``shuffle``; each task seeded by its number). Buckets stand one
    after the other, so every order of all rows can come out.
    """
    names = rows.columns
    place, bucket = unused("_place", names), unused("_bucket", names)
    held = cut(rows.withColumn(place, F.monotonically_increasing_id()), "records")
    size = F.lit(ROW_BYTES)
    for f in rows.schema:
        if f.dataType.simpleString() in ("string", "binary"):
            size = size + F.coalesce(F.octet_length(f.name), F.lit(0))
    total, weight = held.agg(F.count(F.lit(1)), F.sum(size.cast("long"))).first()
    many = max(1, -(-(weight or 0) // bucket_bytes))
    scattered = held.withColumn(bucket, F.pmod(F.xxhash64(F.lit(seed), place), F.lit(many)))
    # as many tasks as buckets at most, by number, so that a task's seed meets the same buckets again
    dealt = scattered.repartition(min(many, 100_000), bucket)
    gathered = dealt.groupBy(bucket).agg(F.sort_array(F.collect_list(F.struct(place, *names))).alias("_rows")).sortWithinPartitions(bucket)
    mixed = gathered.select(bucket, F.posexplode(F.shuffle("_rows", F.lit(seed))).alias("_at", "_row"))
    mixed = cut(mixed, "buckets")
    starts = offsets(mixed.groupBy(bucket).agg(F.count(F.lit(1)).alias("_n")), bucket)
    out = mixed.join(starts, bucket).select(*[F.col("_row")[n].alias(n) for n in names], (F.col("_start") + F.col("_at")).alias("place"))
    forget(held)
    return out, total


def unused(name: str, names: Sequence[str]) -> str:
    while name in names:
        name = "_" + name
    return name


def offsets(sizes: DataFrame, bucket: str) -> DataFrame:
    """(bucket, _start): the rows of all buckets before it; sums within runs of buckets, then over the runs."""
    sizes = sizes.withColumn("_run", F.floor(F.col(bucket) / RUN))
    runs = sizes.groupBy("_run").agg(F.sum("_n").alias("_s"))
    runs = runs.select("_run", (F.sum("_s").over(Window.orderBy("_run")) - F.col("_s")).alias("_before"))
    own = F.sum("_n").over(Window.partitionBy("_run").orderBy(bucket)) - F.col("_n")
    return sizes.withColumn("_own", own).join(runs, "_run").select(bucket, (F.col("_before") + F.col("_own")).alias("_start"))


def shard_rows(rows: DataFrame, shards: int, seed: int = 0, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """rows with ``shard`` (int) and ``slot`` (long): a random order cut into shards whose counts differ by one at most.

    The first rows % shards shards have a row more; slots of a shard are gapless from 0. Any columns, nulls, repeated rows and
    ids are carried along and never looked at; columns of rows named shard, slot or place are in the way of the new ones and
    raise. With fewer rows than shards the last shards are empty; an empty table gives an empty result. A text longer than a
    bucket is a bucket's work alone. The same rows in the same files give the same order; another seed gives another.
    """
    taken = {"shard", "slot", "place"} & set(rows.columns)
    if taken or shards < 1:
        raise ValueError(f"columns in the way: {sorted(taken)}" if taken else f"shards is {shards}")
    out, total = external_shuffle(rows, seed, bucket_bytes)
    least, more = divmod(total, shards)
    wide = more * (least + 1)  # places in the shards that have a row more
    early = F.col("place") < wide
    shard = F.when(early, F.floor(F.col("place") / (least + 1))).otherwise(more + F.floor((F.col("place") - wide) / max(least, 1)))
    first = F.when(early, F.col("shard") * (least + 1)).otherwise(wide + (F.col("shard") - more) * least)
    return out.withColumn("shard", shard.cast("int")).withColumn("slot", (F.col("place") - first).cast("long")).drop("place")


def write_shards(placed: DataFrame, path: str, parts: int = 1) -> None:
    """Write rows of ``shard_rows`` as Parquet, a folder for each shard; each file is a run of slots in order.

    parts: into how many files a shard's slots are dealt, so that a large shard is several tasks' work.
    """
    shards = (placed.agg(F.max("shard")).first()[0] or 0) + 1
    ranged = placed.repartitionByRange(shards * parts, "shard", "slot").sortWithinPartitions("shard", "slot")
    ranged.write.partitionBy("shard").option("compression", "zstd").parquet(path)


def shard_documents(docs: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text", seed: int = 0) -> DataFrame:
    """One row per document: id, size, text_crc32, law, shard, slot, grown_shard, under the law ``rows``.

    Whole documents, texts and all other columns, go through the shuffle, and the numbers are taken of what came out. size is
    the text's UTF-8 bytes and 16 more; a null text has none, and the CRC-32 of ''. Null and repeated ids and repeated rows
    are rows of their own.
    """
    inner = {name: f"_{k}" for k, name in enumerate(docs.columns)}  # names that are in nobody's way
    out = shard_rows(docs.toDF(*inner.values()), shards, seed)
    text = F.coalesce(F.col(inner[text_col]), F.lit(""))
    size = (F.octet_length(text) + DOCUMENT_BYTES).cast("long").alias("size")
    return out.select(F.col(inner[id_col]).alias(id_col), size, F.crc32(text).alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


SHARDS = 40


def op13_sharding(spark, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"), SHARDS)
