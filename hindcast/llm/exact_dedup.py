"""Exact dedup by a tree merge of sorted digest runs. DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, shuffle_width

KEY = ["_digest", "_bytes", "_check"]


def digest_runs(docs: DataFrame, id_col: str, text_col: str, fan: int) -> tuple[DataFrame, int]:
    """One light row per document: digest, checks and the run that it belongs to; how many rounds merge the runs.

    The run comes from the id alone, so that a rerun task deals rows the same way.
    """
    rounds, width = 1, shuffle_width(docs.sparkSession)
    while fan**rounds < max(width, 64):
        rounds += 1
    text = F.coalesce(F.col(text_col), F.lit(""))
    keyed = docs.select(
        F.col(id_col).alias("_id"),
        F.unhex(F.sha2(text, 256)).alias("_digest"),
        F.octet_length(text).alias("_bytes"),
        F.xxhash64(text).alias("_check"),
        F.pmod(F.xxhash64(F.col(id_col)), F.lit(fan**rounds)).alias("_run"),
    )
    return keyed, rounds


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "largest", fan: int = 8) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    Texts are one group if SHA-256, byte length and a second hash agree; all three are compared at every merge.
    keep: "largest" or "smallest" id of a group stays.

    Rows form ``fan ** rounds`` runs by a hash of their id. A run holds an entry for each digest: its best id and its
    count. Each round merges ``fan`` sorted runs into one, until one is left. So a text that a third of all rows share
    is at most one entry per run, and the way back joins on (digest, run), which deals that text's rows over all runs.

    Null text equals empty text. A null id never wins against another id; a group with null ids alone keeps null.
    Rows with the same id and text are one document written twice and get the same answer. An empty table gives an
    empty result; other columns of docs are not read.
    """
    if keep not in ("largest", "smallest"):
        raise ValueError(f"keep is largest or smallest, not {keep!r}")
    best = F.max if keep == "largest" else F.min
    keyed, rounds = digest_runs(docs, id_col, text_col, fan)
    keyed = cut(keyed, "digests")

    def merged(runs: DataFrame, ids: str, n) -> DataFrame:
        return runs.groupBy(*KEY, "_run").agg(best(ids).alias("_keep"), n.alias("_n")).sortWithinPartitions("_run", *KEY)

    leaves = merged(keyed, "_id", F.count(F.lit(1)))
    runs = leaves
    for _ in range(rounds):
        runs = merged(runs.withColumn("_run", F.floor(F.col("_run") / fan)), "_keep", F.sum("_n"))
    answers = leaves.select(*KEY, "_run").join(runs.select(*KEY, "_keep", "_n"), KEY)
    return keyed.join(answers, [*KEY, "_run"]).select(
        F.col("_id").alias(id_col),
        F.col("_keep").alias("keep_id"),
        F.col("_n").cast("long").alias("group_size"),
        F.col("_id").eqNullSafe(F.col("_keep")).alias("kept"),
        F.lower(F.hex("_digest")).alias("text_sha256"),
    )


def op10_exact_dedup(spark, sf_dir: str) -> DataFrame:
    from .common import table

    return exact_dedup(table(spark, sf_dir, "documents"))


OP10_SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""
