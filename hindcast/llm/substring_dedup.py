"""Substring dedup on words with a count-min prefilter."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import windows as W
from .common import wide_table
from .countmin import MOST_CELLS, twice_sieve
from .repeats import Unit, repeated_anchors, substring_dedup as dedup, texts

WINDOW, GRAM = 35, 6
#: Bytes of text to a run of windows with one anchor, roughly.
BYTES_EACH = 48


def count_min_sieve(docs: DataFrame, unit: Unit, most: int = MOST_CELLS) -> Callable:
    """A test for anchors: False for those that the count-min sketch of all texts knows to occur once.

    A window is counted under its anchor, once for each run of windows with that anchor: its count is never more than
    that of its anchor.
    """

    def anchors(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        at, data = texts(batch)
        for first, last in W.chunks(at, 2 << 20):
            base = int(at[first])
            symbols, own = unit.symbols(data[base : int(at[last])], at[first : last + 1] - base)
            yield W.segments(symbols, own, unit.window, unit.gram)[3]

    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return twice_sieve(docs.select("text"), anchors, size // BYTES_EACH, most)


def count_min_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, keep: str = "none", most_cells: int = MOST_CELLS) -> DataFrame:
    """One row per input row: id, n_words, n_removed, n_spans, kept_sha256 (kept words joined by one space).

    Every word under a window of `window` words whose sequence also starts elsewhere is removed; keep="first" leaves the
    earliest occurrence (by id, then place). Windows are judged on the input. The first pass counts windows in a
    count-min sketch; the second groups only those exactly that it estimates as repeated, so none is lost. The sketch has
    at most most_cells cells a row: over more text than that allows for, estimates grow and more goes to the grouping.

    Null text has no words. Texts with fewer words than window are never touched; very long texts are hashed in
    overlapping parts. Rows with the same id and text count as two places. Null ids stay. Other columns of docs are not
    read. Sequences are equal if two 64-bit hashes agree.
    """
    if keep not in ("none", "first"):
        raise ValueError(f"keep is none or first, not {keep!r}")

    def payload(text, hashes, start, n):
        return hashes.tobytes()

    def flags(contents, n, group):
        hashes = np.frombuffer(b"".join(contents.to_pylist()), dtype=np.int64)
        order = np.lexsort((np.arange(len(hashes)), hashes, group))
        a, b = order[1:], order[:-1]
        same = np.concatenate(([False], (hashes[a] == hashes[b]) & (group[a] == group[b])))
        earlier, later = np.zeros(len(hashes), dtype=bool), np.zeros(len(hashes), dtype=bool)
        earlier[order] = same
        later[order] = np.concatenate((same[1:], [False]))
        return earlier, later

    unit = Unit(True, window, min(GRAM, window))
    out = dedup(docs, id_col, text_col, unit, repeated_anchors, payload, flags, keep == "first", lambda own: count_min_sieve(own, unit, most_cells))
    return out.select(id_col, F.col("n").alias("n_words"), "n_removed", "n_spans", "kept_sha256")


def op4_substring_dedup(spark, sf_dir: str) -> DataFrame:
    return count_min_dedup(wide_table(spark, sf_dir, "documents"))
