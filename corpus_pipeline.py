"""From documents to packed training sequences, in five stages; each takes what the one before it left.

Stages decide about rows, not ids: a null or repeated id never makes one row stand for another. Null and empty texts fail
the quality rules; an empty table goes through all stages; further columns of documents stay as they are.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hindcast.llm.common import cut, join_small, table
from hindcast.llm.exact_dedup import exact_dedup
from hindcast.llm.mixing import mix_sources
from hindcast.llm.near_dedup import near_dedup
from hindcast.llm.packing import best_fit_packing, default_tokenizer
from hindcast.llm.quality_rules import quality_rules


class Keyed(NamedTuple):
    """Rows with three more columns, named apart from all of theirs: the row's file, its number there, and its key."""

    docs: DataFrame
    file: str
    row: str
    key: str


def keyed(docs: DataFrame, nulls_last: bool = False) -> Keyed:
    """docs with the place of each row, and a key that sorts by doc_id and then by place.

    A row of a Parquet file is told by file and row number, whatever its id: rows with a null or repeated id are rows of
    their own. Null ids sort before all others, or after them. Columns of docs may have any names.
    """
    taken = {c.lower() for c in docs.columns}
    file, row, key = (next(n for n in ("_" * k + name for k in range(1, len(taken) + 2)) if n not in taken) for name in ("file", "row", "key"))

    def placed(df: DataFrame) -> DataFrame:
        place = df.metadataColumn("_metadata")
        return df.select("*", F.xxhash64(place["file_path"]).alias(file), place["row_index"].alias(row))

    try:
        docs = placed(docs)
    except AnalysisException:  # no table of files, or several: written as one
        docs = placed(cut(docs, "documents"))
    null = F.col("doc_id").isNull() if nulls_last else F.col("doc_id").isNotNull()
    docs = docs.withColumn(key, F.struct(null.alias("null"), "doc_id", F.col(file).alias("file"), F.col(row).alias("row")))
    return Keyed(docs, file, row, key)


def without_dropped(own: Keyed, decisions: DataFrame) -> DataFrame:
    """The rows of keyed docs that the decisions keep, with the columns of documents."""
    dropped = decisions.where(~F.col("kept")).select(F.col(own.key)["file"].alias(f"{own.key}_file"), F.col(own.key)["row"].alias(f"{own.key}_row"))
    kept = join_small(own.docs, cut(dropped, "dropped"), {own.file: f"{own.key}_file", own.row: f"{own.key}_row"}, "left_anti")
    return kept.drop(own.file, own.row, own.key)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules accept."""
    own = keyed(docs)
    return without_dropped(own, quality_rules(own.docs, id_col=own.key))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text: the one with the largest id."""
    own = keyed(docs)
    return without_dropped(own, exact_dedup(own.docs, id_col=own.key))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: the one with the smallest id."""
    own = keyed(docs, nulls_last=True)
    return without_dropped(own, near_dedup(own.docs, id_col=own.key))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample whose sources, languages and topics have the target weights; rows with one id share their draw."""
    own = keyed(docs)
    return without_dropped(own, mix_sources(own.docs, id_col=own.key, draw_col="doc_id"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in training sequences."""
    return best_fit_packing(docs, default_tokenizer())


STAGES = [("quality_rules", quality), ("exact_dedup", exact), ("minhash_near_dedup", near), ("mix_sources", mixed), ("best_fit_packing", packed)]
#: Fitting, sketches and packing are no SQL; the tests compare the stages with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), "stage")
    return STAGES[-1][1](spark, docs, sf_dir)
