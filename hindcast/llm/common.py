"""Helpers shared by the corpus operators: shared scratch tables, size-checked joins, small column idioms."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space that separates words, as a regular-expression class; the same in Java, RE2 and Python.
SPACE = r"[\x20\x09-\x0D]+"
#: Bytes that may be broadcast, as counted rows times the bytes of a row; beyond that both sides of a join shuffle.
BROADCAST_BYTES = 24 << 20
#: Bytes of a row in a broadcast hash table besides its values.
ROW_BYTES = 48

_own_dir: list[str] = []
#: Paths of cut tables that are not yet deleted, by the DataFrame's path.
_written: dict[str, SparkSession] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def wide_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table, dealt over all cores where fewer parts of its files hold rows: a few files with a single row group."""
    df = table(spark, sf_dir, name)
    cores = spark.sparkContext.defaultParallelism
    if len(df.inputFiles()) >= cores or df.select(F.spark_partition_id().alias("p")).distinct().count() >= cores:
        return df
    return df.repartition(cores)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` where the cluster names one.

    Only a local session that has none gets a temporary folder.
    """
    conf = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if conf:
        return conf
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _own_dir:
        import shutil

        _own_dir.append(tempfile.mkdtemp(prefix="hindcast-"))
        atexit.register(shutil.rmtree, _own_dir[0], ignore_errors=True)
    return _own_dir[0]


def cut(df: DataFrame, name: str = "cut") -> DataFrame:
    """Write df to the shared folder and read it back: the lineage ends there, and a lost executor loses nothing.

    The table stays until ``forget`` gets it or the driver's Python ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/llm/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _written[path] = spark
    out = spark.read.schema(df.schema).parquet(path)
    out.cut_path = path
    return out


def forget(*tables: DataFrame) -> None:
    """Delete cut tables that nothing reads any more: all that came from them has been cut or collected since."""
    for df in tables:
        _delete(df.cut_path)


def _delete(path: str) -> None:
    spark = _written.pop(path, None)
    if spark is not None:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


@atexit.register
def _delete_all() -> None:
    for path in list(_written):
        try:
            _delete(path)
        except Exception:  # the session is gone: whoever owns the folder clears it  # noqa: BLE001
            return


def let(value: Column, body) -> Column:
    """Bind value once for body: an expression used inside a lambda would else be computed for each element."""
    return F.transform(F.array(value), body)[0]


def match_null_safe(left: DataFrame, right: DataFrame, keys: dict[str, str]) -> Column:
    cond = None
    for a, b in keys.items():
        one = left[a].eqNullSafe(right[b])
        cond = one if cond is None else cond & one
    return cond


def join_small(big: DataFrame, small: DataFrame, keys: dict[str, str], how: str) -> DataFrame:
    """Join on null-safe keys; small is broadcast only if its counted bytes are few, else both sides shuffle.

    small should be a cut table: it is counted first, and its strings are summed.
    """
    texts = [f.name for f in small.schema if f.dataType.simpleString() in ("string", "binary")]
    fixed = ROW_BYTES + 16 * len(small.columns)
    size = F.count(F.lit(1)) * fixed
    for name in texts:
        size = size + F.coalesce(F.sum(F.octet_length(name)), F.lit(0))
    few = small.agg(size).first()[0] <= BROADCAST_BYTES
    return big.join(F.broadcast(small) if few else small, match_null_safe(big, small, keys), how)


def shuffle_width(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
