"""Repeated windows across and inside documents: what byte-level and word-level substring dedup share.

1. One pass over the texts emits *segments* (runs of windows with one anchor, see windows.py), some 1 % to 7 % as many
   as windows. A sieve, where there is one, holds back those that it knows to occur once.
2. Segments whose anchor occurs once in the corpus hold no repeated window and go.
3. Segments equal as a whole are grouped, with counts added before the shuffle: a passage that many documents share
   becomes few rows. All their windows are repeated.
4. Where an anchor has several different segments, one example of each is cut out of the texts and its windows are
   compared, anchor by anchor. The windows of an anchor with very many different segments go through a count-min sketch
   and, if it estimates them as repeated, through a grouping of single windows.
5. The repeated windows of a document are applied to its text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import windows as W
from .common import cut, forget, join_small, shuffle_width
from .countmin import twice_sieve

#: Different segments of an anchor beyond which its windows are grouped one by one instead of in one task's memory.
HOT_ANCHOR = 1_000
#: Bytes of segments that a task compares at a time, and that a partition should have.
BLOCK_BYTES, PARTITION_BYTES = 1 << 20, 4 << 20


@dataclass(frozen=True)
class Unit:
    """What windows consist of. kept() joins what is left of a text."""

    words: bool
    window: int
    gram: int

    def symbols(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return W.word_hashes(data, at) if self.words else (W.BYTE_HASH[data], at)

    def kept(self, text: bytes, spans: list[tuple[int, int]]) -> bytes:
        parts = text.split() if self.words else text
        left, begin = [], 0
        for a, b in spans:
            left.append(parts[begin:a])
            begin = b
        left.append(parts[begin:])
        return b" ".join([w for p in left for w in p]) if self.words else b"".join(left)


def texts(batch: pa.RecordBatch, column: str = "text") -> tuple[np.ndarray, np.ndarray]:
    at, data = W.utf8(batch.column(batch.schema.get_field_index(column)))
    return at, data


def scan(docs: DataFrame, unit: Unit, sieve: Callable | None = None) -> DataFrame:
    """docs (id, th, text) to rows of two kinds: per document n and sha (of all that there is), per segment the rest.

    sieve(anchors) says which segments may have repeated windows.
    """
    id_type = docs.schema["id"].dataType
    schema = T.StructType([T.StructField("id", id_type), *[T.StructField(n, T.LongType()) for n in ("th", "n")], T.StructField("sha", T.StringType()), *[T.StructField(n, T.LongType()) for n in ("anchor", "segment")], *[T.StructField(n, T.IntegerType()) for n in ("start", "windows")]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            at, data = texts(batch)
            ids, th = batch.column(0), batch.column(1)
            n, sha = [], []
            for first, last in W.chunks(at, 2 << 20):
                base = int(at[first])
                symbols, own = unit.symbols(data[base : int(at[last])], at[first : last + 1] - base)
                n.extend(np.diff(own).tolist())
                for i in range(first, last):
                    sha.append(hashlib.sha256(unit.kept(data[at[i] : at[i + 1]].tobytes(), [])).hexdigest())
                found = W.segments(symbols, own, unit.window, unit.gram)
                if sieve is not None:
                    stay = sieve(found[3])
                    found = tuple(x[stay] for x in found)
                text, start, count, anchor, segment = found
                k = len(text)
                if k:
                    pick = pa.array(text + first)
                    none = pa.nulls(k, pa.int64())
                    yield pa.RecordBatch.from_arrays([ids.take(pick), th.take(pick), none, pa.nulls(k, pa.string()), pa.array(anchor.view(np.int64)), pa.array(segment.view(np.int64)), pa.array(start.astype(np.int32)), pa.array(count.astype(np.int32))], names=schema.names)
            k = batch.num_rows
            long, short = pa.nulls(k, pa.int64()), pa.nulls(k, pa.int32())
            yield pa.RecordBatch.from_arrays([ids, th, pa.array(n, pa.int64()), pa.array(sha, pa.string()), long, long, short, short], names=schema.names)

    return docs.mapInArrow(run, schema)


def repeated_anchors(segments: DataFrame) -> DataFrame:
    """The segments whose anchor occurs twice or more."""
    counts = segments.groupBy("anchor").agg(F.count(F.lit(1)).alias("c"))
    # written before the join, so that the join alone makes its stage and an anchor with very many segments can be split
    twice = cut(counts.where("c >= 2").select(F.col("anchor").alias("_a")), "anchors")
    shared = cut(join_small(segments, twice, {"anchor": "_a"}, "left_semi"), "shared")
    forget(twice)
    return shared


def examples(work: DataFrame, unit: Unit, payload: Callable) -> DataFrame:
    """work (id, th, text, wanted: array of anchor, start, windows, hot) to a row per segment with its content.

    Ordinary segments carry payload bytes, hot ones the hash of each window.
    """
    id_type = work.schema["id"].dataType
    schema = T.StructType([T.StructField("anchor", T.LongType()), T.StructField("id", id_type), T.StructField("th", T.LongType()), *[T.StructField(n, T.IntegerType()) for n in ("start", "windows")], T.StructField("content", T.BinaryType()), T.StructField("hashes", T.ArrayType(T.LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, data = texts(batch)
            wanted = batch.column(batch.schema.get_field_index("wanted")).to_pylist() if batch.num_rows else []
            rows: list[tuple] = []
            size = 0
            for i, asked in enumerate(wanted):
                text = data[at[i] : at[i + 1]]
                symbols, _ = unit.symbols(text, np.array([0, len(text)]))
                for w in asked:
                    start, n = w["start"], w["windows"]
                    part = symbols[start : start + n + unit.window - 1]
                    hashes = W.Spans(part).all(unit.window).view(np.int64) if w["hot"] or unit.words else None
                    rows.append((i, w["anchor"], start, n, None if w["hot"] else payload(text, hashes, start, n), hashes if w["hot"] else None))
                    size += n * 8 if unit.words or w["hot"] else n + unit.window
                if size > PARTITION_BYTES or (i == len(wanted) - 1 and rows):
                    who, anchor, start, n, content, hashes = zip(*rows, strict=True)
                    pick = pa.array(who, pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array(anchor, pa.int64()), batch.column(0).take(pick), batch.column(1).take(pick), pa.array(start, pa.int32()), pa.array(n, pa.int32()), pa.array(content, pa.binary()), pa.array(hashes, pa.list_(pa.int64()))], names=schema.names)
                    rows, size = [], 0

    return work.select("id", "th", "text", "wanted").mapInArrow(run, schema)


def hot_windows(hot: DataFrame) -> DataFrame:
    """Rows (anchor, id, th, start, hashes) to a row (anchor, hash, id, th, start) for each window that may be repeated."""
    schema = T.StructType([*[T.StructField(n, T.LongType()) for n in ("anchor", "hash")], hot.schema["id"], T.StructField("th", T.LongType()), T.StructField("start", T.IntegerType())])
    windows = hot.agg(F.sum(F.size("hashes"))).first()[0]
    if not windows:
        return hot.sparkSession.createDataFrame([], schema)

    def flat(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row, hash and key of each window: windows are the same if anchor and hash are."""
        lists = batch.column(batch.schema.get_field_index("hashes"))
        n = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
        row, hashes = np.repeat(np.arange(len(n)), n), lists.flatten().to_numpy()
        anchor = batch.column(batch.schema.get_field_index("anchor")).to_numpy()
        return row, hashes, W.mix(anchor.view(np.uint64))[row] ^ hashes.view(np.uint64)

    sieve = twice_sieve(hot.select("anchor", "hashes"), lambda batch: [flat(batch)[2]], windows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, hashes, key = flat(batch)
            begin = np.concatenate(([0], np.cumsum(np.bincount(row, minlength=batch.num_rows))))
            stay = np.flatnonzero(sieve(key))
            pick = pa.array(row[stay])
            start = batch.column(3).to_numpy()[row[stay]] + stay - begin[row[stay]]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pick), pa.array(hashes[stay]), batch.column(1).take(pick), batch.column(2).take(pick), pa.array(start.astype(np.int32))], names=schema.names)

    return hot.select("anchor", "id", "th", "start", "hashes").mapInArrow(run, schema)


def compare(found: DataFrame, flags: Callable, keep_first: bool) -> DataFrame:
    """Rows sorted by anchor to the ranges (id, th, start, end) of windows that another segment or place has too.

    flags(contents, windows, groups) gives (has an earlier match, has a later match) for every window; a block holds
    whole anchors, at most those that begin in BLOCK_BYTES.
    """
    id_type = found.schema["id"].dataType
    schema = T.StructType([T.StructField("id", id_type), T.StructField("th", T.LongType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])

    def judge(block: pa.Table) -> pa.RecordBatch:
        anchor = block.column("anchor").to_numpy()
        n, start = block.column("windows").to_numpy(), block.column("start").to_numpy()
        group = np.repeat(np.cumsum(np.concatenate(([0], np.diff(anchor) != 0))), n)
        earlier, later = flags(block.column("content").combine_chunks(), n, group)
        hit = earlier if keep_first else earlier | later
        row = np.repeat(np.arange(len(n)), n)
        offset = np.arange(len(hit)) - np.repeat(np.cumsum(n) - n, n)
        edge = np.flatnonzero(hit & ~(np.concatenate(([False], hit[:-1])) & (offset > 0)))
        stop = np.flatnonzero(hit & ~(np.concatenate((hit[1:], [False])) & np.concatenate((offset[1:] > 0, [False])))) + 1
        r = row[edge]
        pick, s = pa.array(r), start[r] + offset[edge]
        return pa.RecordBatch.from_arrays([block.column("id").combine_chunks().take(pick), block.column("th").combine_chunks().take(pick), pa.array(s.astype(np.int32)), pa.array((s + stop - edge).astype(np.int32))], names=schema.names)

    def blocks(whole: pa.Table, last: bool) -> tuple[list[pa.Table], pa.Table]:
        """Blocks of whole anchors, and the rows that are held back as their anchor may go on."""
        anchor = whole.column("anchor").to_numpy()
        edge = np.flatnonzero(np.concatenate(([True], anchor[1:] != anchor[:-1], [last])))
        size = np.concatenate(([0], np.cumsum(pc.binary_length(whole.column("content")).to_numpy(), dtype=np.int64)))
        out, first = [], 0
        for at in edge[1:].tolist():
            if size[at] - size[first] >= BLOCK_BYTES or at == edge[-1]:
                out.append(whole.slice(first, at - first))
                first = at
        return out, whole.slice(first).combine_chunks()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            size += batch.nbytes
            if size >= BLOCK_BYTES:
                ready, rest = blocks(pa.Table.from_batches(held), False)
                yield from map(judge, ready)
                held, size = rest.to_batches(), 0
        if held:
            yield from map(judge, blocks(pa.Table.from_batches(held), True)[0])

    return found.mapInArrow(run, schema)


def apply_spans(work: DataFrame, unit: Unit) -> DataFrame:
    """work (id, th, text, spans: array of window ranges) to id, th, n_removed, n_spans, sha."""
    id_type = work.schema["id"].dataType
    schema = T.StructType([T.StructField("id", id_type), *[T.StructField(n, T.LongType()) for n in ("th", "n_removed", "n_spans")], T.StructField("sha", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, data = texts(batch)
            removed, count, sha = [], [], []
            for i, ranges in enumerate(batch.column(3).to_pylist()):
                merged = merge_spans([(r["start"], r["end"] - 1 + unit.window) for r in ranges])
                removed.append(sum(b - a for a, b in merged))
                count.append(len(merged))
                sha.append(hashlib.sha256(unit.kept(data[at[i] : at[i + 1]].tobytes(), merged)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(removed, pa.int64()), pa.array(count, pa.int64()), pa.array(sha, pa.string())], names=schema.names)

    return work.select("id", "th", "text", "spans").mapInArrow(run, schema)


def with_path(df: DataFrame, written: DataFrame) -> DataFrame:
    """df, which reads a cut table, to be forgotten as that table is."""
    df.cut_path = written.cut_path
    return df


def merge_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def repeated_windows(docs: DataFrame, unit: Unit, prefilter: Callable, payload: Callable, flags: Callable, keep_first: bool = False, sieve: Callable | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """docs (id, th, text) to (scanned, fetched texts, spans), all cut.

    scanned: id, th, n, sha of every row, besides rows without n. spans: id, th and the ranges of window starts to
    remove. th is a hash of the text, so that rows which share an id by mistake are kept apart. Rows that share both are
    copies: their text is fetched and compared once, and each copy counts as an occurrence.
    """
    scanned = cut(scan(docs, unit, sieve), "scan")
    shared = prefilter(scanned.where(F.col("anchor").isNotNull()).select("id", "th", "anchor", "segment", "start", "windows"))
    # rows that share id and text are one row from here on, and how often: all that follows is linear in different rows
    again = not scanned.where(F.col("n").isNotNull()).groupBy("id", "th").agg(F.count(F.lit(1)).alias("c")).where("c > 1").isEmpty()
    if again:
        whole, shared = shared, cut(shared.groupBy(*shared.columns).agg(F.count(F.lit(1)).alias("times")), "distinct")
        forget(whole)
    else:
        shared = with_path(shared.withColumn("times", F.lit(1)), shared)
    place = F.struct("id", "th", "start", "windows")
    kinds = cut(shared.groupBy("anchor", "segment").agg(F.sum("times").alias("c"), F.min(place).alias("first")), "kinds")
    anchors = cut(kinds.groupBy("anchor").agg(F.count(F.lit(1)).alias("k")).where("k >= 2"), "anchors")
    most = min(HOT_ANCHOR, BLOCK_BYTES // (2 * unit.window))
    mixed = kinds.join(anchors, "anchor").select("anchor", "first.*", (F.col("k") > most).alias("hot"))
    wanted = cut(mixed.groupBy("id", "th").agg(F.collect_list(F.struct("anchor", "start", "windows", "hot")).alias("wanted")), "wanted")
    copies = cut(kinds.where("c >= 2").select(F.col("anchor").alias("_a"), F.col("segment").alias("_s"), *([F.col("first")] if keep_first else [])), "copies")
    # a shuffle on both keys alone: very many copies of one segment are split by adaptive execution
    full = shared.join(copies, (shared["anchor"] == copies["_a"]) & (shared["segment"] == copies["_s"]))
    if keep_first:
        full = full.where(~place.eqNullSafe(F.col("first")))
    full = full.groupBy("id", "th").agg(F.collect_list(F.struct("start", (F.col("start") + F.col("windows")).alias("end"))).alias("spans"))
    full = cut(full, "full")
    forget(kinds, anchors, copies, shared)
    keys = cut(wanted.select("id", "th").union(full.select("id", "th")).distinct().withColumnsRenamed({"id": "_i", "th": "_t"}), "keys")
    fetched = join_small(docs, keys, {"id": "_i", "th": "_t"}, "left_semi")
    fetched = cut(fetched.dropDuplicates(["id", "th"]) if again else fetched, "texts")

    asked = wanted.withColumnsRenamed({"id": "_i", "th": "_t"})
    work = fetched.join(asked, fetched["id"].eqNullSafe(asked["_i"]) & (fetched["th"] == asked["_t"])).drop("_i", "_t")
    found = cut(examples(work, unit, payload), "examples")
    size = found.agg(F.sum(F.octet_length("content"))).first()[0] or 0
    parts = max(shuffle_width(docs.sparkSession), -(-size // PARTITION_BYTES))
    cold = found.where(F.col("content").isNotNull()).select("anchor", "id", "th", "start", "windows", "content")
    cold = compare(cold.repartition(parts, "anchor").sortWithinPartitions("anchor", "id", "th", "start"), flags, keep_first)

    single = cut(hot_windows(found.where(F.col("hashes").isNotNull())), "hot")
    spot = F.struct("id", "th", "start")
    twice = single.groupBy("anchor", "hash").agg(F.count(F.lit(1)).alias("c"), F.min(spot).alias("first")).where("c >= 2").drop("c")
    twice = cut(twice.withColumnsRenamed({"anchor": "_a", "hash": "_h"}), "hot-twice")
    warm = single.join(twice, (single["anchor"] == twice["_a"]) & (single["hash"] == twice["_h"]))
    warm = (warm.where(~spot.eqNullSafe(F.col("first"))) if keep_first else warm).select("id", "th", "start", (F.col("start") + 1).alias("end"))

    partial = cold.union(warm).groupBy("id", "th").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    spans = cut(full.union(partial).groupBy("id", "th").agg(F.flatten(F.collect_list("spans")).alias("spans")), "spans")
    forget(wanted, keys, found, full, single, twice)
    return scanned, fetched, spans


def substring_dedup(docs: DataFrame, id_col: str, text_col: str, unit: Unit, prefilter: Callable, payload: Callable, flags: Callable, keep_first: bool, sieve: Callable | None = None) -> DataFrame:
    """id, n, n_removed, n_spans, sha for every input row. sieve(docs) makes a sieve for scan()."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    docs = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("th"), text.alias("text"))
    scanned, fetched, spans = repeated_windows(docs, unit, prefilter, payload, flags, keep_first, sieve(docs) if sieve else None)
    ranges = spans.withColumnsRenamed({"id": "_i", "th": "_t"})
    work = fetched.join(ranges, fetched["id"].eqNullSafe(ranges["_i"]) & (fetched["th"] == ranges["_t"])).drop("_i", "_t")
    done = cut(apply_spans(work, unit).dropDuplicates(["id", "th"]).withColumnsRenamed({"id": "_i", "th": "_t", "sha": "_sha"}), "applied")
    forget(fetched, spans)
    summaries = scanned.where(F.col("n").isNotNull()).select("id", "th", "n", "sha")
    out = join_small(summaries, done, {"id": "_i", "th": "_t"}, "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n"), zero("n_removed"), zero("n_spans"), F.coalesce("_sha", "sha").alias("kept_sha256"))
