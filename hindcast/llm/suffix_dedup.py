"""Substring dedup on bytes by longest-previous-factor arrays over a suffix array."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import windows as W
from .common import wide_table
from .repeats import Unit, repeated_anchors, substring_dedup

WINDOW, GRAM = 400, 48
#: Bits of a rank: three of them make one sorting key, so a block may have 2 ** RANK_BITS - 2 bytes.
RANK_BITS = 21


def dense_ranks(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order that sorts the keys, and each key's rank from 1; equal keys have equal ranks."""
    order = np.argsort(keys)
    ordered = keys[order]
    ranks = np.empty(len(keys), dtype=np.int64)
    ranks[order] = np.cumsum(np.concatenate(([1], ordered[1:] != ordered[:-1])))
    return order, ranks


def prefix_ranks(text: np.ndarray, window: int) -> list[tuple[int, np.ndarray]]:
    """(length, ranks of all suffixes by their first `length` bytes), for lengths 1, 8 and then three times more up to window.

    Each step ranks a suffix by the ranks of its three thirds, so bytes decide and no hash does. Suffixes that end early
    are padded with rank 0, which sorts first.
    """
    n = len(text)
    levels = [(1, text.astype(np.int64) + 1)]
    if window >= 8:
        padded = np.zeros(n + 7, dtype=np.uint64)
        padded[:n] = text
        eight = padded[:n].copy()
        for i in range(1, 8):
            eight = (eight << np.uint64(8)) | padded[i : n + i]
        levels.append((8, dense_ranks(eight)[1]))
    while 3 * levels[-1][0] <= window:
        h, ranks = levels[-1]
        far = np.concatenate((ranks, np.zeros(2 * h, dtype=np.int64)))
        key = (((far[:n] << RANK_BITS) | far[h : n + h]) << RANK_BITS) | far[2 * h : n + 2 * h]
        levels.append((3 * h, dense_ranks(key)[1]))
    return levels


def suffix_array(levels: list[tuple[int, np.ndarray]], starts: np.ndarray, window: int) -> np.ndarray:
    """Numbers of the suffixes at `starts` (ascending), sorted by their first `window` bytes, ties by position."""
    h, ranks = levels[-1]
    key = ranks[starts]
    for at in (min(h, window - h), window - h):  # two more prefixes of length h reach exactly to `window`
        key = (key << RANK_BITS) | ranks[starts + at]
    return np.argsort(key, kind="stable")


def common_prefix(levels: list[tuple[int, np.ndarray]], a: np.ndarray, b: np.ndarray, window: int) -> np.ndarray:
    """Common prefix of the suffixes at a and b, at most `window`; both have that many bytes."""
    out = np.zeros(len(a), dtype=np.int64)
    longer = window + 1
    for h, ranks in reversed(levels):
        for _ in range((longer - 1) // h):
            fits = np.flatnonzero(out + h <= window)
            if not len(fits):
                break
            same = fits[ranks[a[fits] + out[fits]] == ranks[b[fits] + out[fits]]]
            out[same] += h
        longer = h
    return out


def nearest_smaller(place: np.ndarray) -> np.ndarray:
    """For each entry the number of the nearest one before it with a smaller value, or -1.

    Entries between an entry and its candidate are all larger, so a candidate that is too large passes on to its own.
    """
    near = np.arange(-1, len(place) - 1)
    todo = np.flatnonzero((near >= 0) & (place[near] > place))
    while len(todo):
        near[todo] = near[near[todo]]
        todo = todo[(near[todo] >= 0) & (place[near[todo]] > place[todo])]
    return near


def previous_factors(text: np.ndarray, starts: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Longest previous factor of each suffix at `starts`, and its common prefix with the next suffix in suffix order.

    Both are cut off at `window`. The longest earlier match of a suffix is at the previous or the next smaller position
    in suffix order.
    """
    levels = prefix_ranks(text, window)
    order = suffix_array(levels, starts, window)
    n = len(order)
    place = starts[order]
    factor = np.zeros(n, dtype=np.int64)
    before, after = nearest_smaller(place), nearest_smaller(place[::-1])
    for smaller in (before, np.where(after < 0, -1, n - 1 - after)[::-1]):
        some = np.flatnonzero(smaller >= 0)
        factor[some] = np.maximum(factor[some], common_prefix(levels, place[some], place[smaller[some]], window))
    shared = np.append(common_prefix(levels, place[:-1], place[1:], window), 0)
    lpf, follow = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
    lpf[order], follow[order] = factor, shared
    return lpf, follow


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, keep: str = "none") -> DataFrame:
    """One row per input row: id, n_bytes, n_removed, n_spans, kept_sha256.

    Every byte under a string of `window` bytes that also starts elsewhere is removed; keep="first" leaves the earliest
    occurrence (by id, then place). Strings are judged on the input. Matches never cross documents.

    Windows that can be equal share an anchor, so suffix arrays are built for blocks of whole anchors, in bounded
    memory. A block's places stand in the order of ids, so a longest previous factor of `window` bytes means that an
    earlier copy exists, and a common prefix of that length with the next suffix that a later one does.

    Null text is empty. Texts shorter than window are never touched; very long texts are hashed in overlapping parts.
    Rows with the same id and text count as two places, so with keep="none" both lose what they share. Null ids stay.
    Other columns of docs are not read. In suffix arrays bytes decide; runs of windows (at most 2 * window bytes) that
    are equal as a whole are told by two 64-bit hashes, as are windows of an anchor with over 1,000 different runs.
    """
    if keep not in ("none", "first"):
        raise ValueError(f"keep is none or first, not {keep!r}")

    def payload(text, hashes, start, n):
        return text[start : start + n + window - 1].tobytes()

    def flags(contents, n, group):
        at, data = W.utf8(contents.cast("large_binary").view("large_string"))
        first = np.repeat(at[:-1] - at[0], n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        lpf, follow = previous_factors(data[at[0] : at[-1]], first, window)
        return lpf >= window, follow >= window

    out = substring_dedup(docs, id_col, text_col, Unit(False, window, min(GRAM, window)), repeated_anchors, payload, flags, keep == "first")
    return out.select(id_col, F.col("n").alias("n_bytes"), "n_removed", "n_spans", "kept_sha256")


def op1_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    return suffix_dedup(wide_table(spark, sf_dir, "documents"))
