"""Best-fit packing of token sequences by linear grouping.

Only the number of pieces of each length decides how sequences are filled, and there are at most ``capacity`` lengths. So
the plan is made from that histogram, whatever the size of the corpus, and actual pieces then take the planned places by
their rank among the pieces of their length.
"""

from __future__ import annotations

import json
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, wide_table

CAPACITY, END_ID = 2048, 0
#: Lengths over this share of the capacity are large: they are grouped and rounded up. GROUPS: sizes that are left.
LARGE, GROUPS = 1 / 3, 1000
#: Parts into which a length's pieces are dealt to be ranked: at least so many, and one for so many pieces of the corpus.
RANK_PARTS, RANK_ROWS = 256, 200_000


class Encoder:
    """Token ids of a byte-level BPE vocabulary file of ``tokenizers``, as little-endian unsigned 32-bit bytes.

    Plain texts go through tiktoken with the vocabulary of that same file, which gives the same ids in less time. What it
    may not (a text that names a special token, a file with another normaliser or pattern) goes to ``tokenizers``.
    """

    def __init__(self, path: str):
        import tiktoken
        from public_tokenizers import PATTERN

        self.path = path
        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        self.special = [t["content"] for t in model.get("added_tokens", [])]
        before = model.get("pre_tokenizer") or {}
        self.plain = model.get("normalizer") is None and before.get("type") == "ByteLevel" and not before.get("add_prefix_space")
        if self.plain:
            to_byte = {c: b for b, c in byte_letters().items()}
            ranks = {bytes(to_byte[c] for c in token): i for token, i in model["model"]["vocab"].items() if token not in self.special}
            self.encoding = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    @cached_property
    def tokenizer(self):
        """Loaded once a text needs it, which few do."""
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def __call__(self, text: str) -> bytes:
        if not self.plain or any(s in text for s in self.special):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        return self.encoding.encode_to_numpy(text, disallowed_special=()).astype("<u4").tobytes()


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in the vocabulary: itself if printable in Latin-1, else the next from 256 on."""
    out, extra = {}, 256
    for b in range(256):
        if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255:
            out[b] = chr(b)
        else:
            out[b], extra = chr(extra), extra + 1
    return out


def cut_pieces(ids: bytes, capacity: int) -> Iterator[tuple[int, int, int, int]]:
    """(piece, start, length, crc32); the first piece takes what is over, all others are full."""
    n = len(ids) // 4
    start, piece = 0, 0
    while start < n:
        length = capacity if piece or n % capacity == 0 else n % capacity
        yield piece, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)])
        start, piece = start + length, piece + 1


def token_pieces(docs: DataFrame, id_col: str, text_col: str, tokenizer: str, capacity: int) -> DataFrame:
    end = END_ID.to_bytes(4, "little")
    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("piece", T.IntegerType()), *[T.StructField(n, T.LongType()) for n in ("start", "length", "ids_crc32")]])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(tokenizer)
        for batch in batches:
            rows = [(i, *p) for i, text in enumerate(batch.column(1)) for p in cut_pieces(encoder(text.as_py()) + end, capacity)]
            who, piece, *rest = zip(*rows, strict=True) if rows else [()] * 5
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(who, pa.int64())), pa.array(piece, pa.int32()), *[pa.array(x, pa.int64()) for x in rest]], names=schema.names)

    return docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).mapInArrow(encode, schema)


def linear_groups(counts: dict[int, int], groups: int) -> list[list[tuple[int, int]]]:
    """Equal-cardinality groups of (length, n), longest first; a group's size is its longest length."""
    total = sum(counts.values())
    share, out, left = max(1, -(-total // groups)), [], 0
    for length in sorted(counts, reverse=True):
        n = counts[length]
        while n:
            if not left:
                out.append([])
                left = share
            take = min(n, left)
            out[-1].append((length, take))
            n, left = n - take, left - take
    return out


def fullest(sizes: list[int], left: list[int], first: int, capacity: int) -> list[int]:
    """Group numbers of a configuration that holds ``first`` and fills the rest as full as it can (subset sum)."""
    room = capacity - sizes[first]
    used = {0: ()}
    for g in range(first, len(sizes)):
        stock = left[g] - (g == first)
        if not stock or sizes[g] > room:
            continue
        more = {}
        for total, picks in used.items():
            for k in range(1, min(stock, (room - total) // sizes[g]) + 1):
                new = total + k * sizes[g]
                if new not in used and new not in more:
                    more[new] = picks + (g,) * k
        used |= more
        if room in used:
            break
    return [first, *used[max(used)]]


class Blocks:
    """Runs of sequences filled alike: (first sequence, how many, [(length, first rank, offset)], room left)."""

    def __init__(self):
        self.by_room: dict[int, list] = {}
        self.rooms: list[int] = []
        self.sequences = 0

    def put(self, block: list) -> None:
        if block[3] not in self.by_room:
            self.by_room[block[3]] = []
            insort(self.rooms, block[3])
        self.by_room[block[3]].append(block)

    def take(self, length: int):
        """A block with the least room that length fits in."""
        i = bisect_left(self.rooms, length)
        if i == len(self.rooms):
            return None
        room = self.rooms[i]
        block = self.by_room[room].pop()
        if not self.by_room[room]:
            del self.by_room[room], self.rooms[i]
        return block


def plan_packing(histogram: dict[int, int], capacity: int = CAPACITY, large: float = LARGE, groups: int = GROUPS) -> list[tuple[int, int, int, int, int]]:
    """(length, rank from, rank to, first sequence, offset): the piece of rank r goes to first sequence + r - rank from.

    Large lengths are rounded up within groups of equal cardinality; for the few sizes that are left, the fullest
    configurations are taken as often as their pieces last. Actual pieces replace the rounded ones, longest first in
    each group, which frees what rounding wasted. Small lengths, and whatever is left, then go best-fit: each to the
    sequence with the least room that takes it.
    """
    big = {k: n for k, n in histogram.items() if k > capacity * large}
    small = {k: n for k, n in histogram.items() if k <= capacity * large}
    grouped = linear_groups(big, groups)
    sizes, left = [g[0][0] for g in grouped], [sum(n for _, n in g) for g in grouped]
    rank = dict.fromkeys(histogram, 0)
    blocks = Blocks()

    def draw(g: int, most: int) -> tuple[int, int, int]:
        """Up to most pieces of one actual length from group g: length, first rank, how many."""
        length, n = grouped[g][0]
        n = min(n, most)
        if n == grouped[g][0][1]:
            grouped[g].pop(0)
        else:
            grouped[g][0] = (length, grouped[g][0][1] - n)
        rank[length] += n
        return length, rank[length] - n, n

    first = 0
    while first < len(sizes):
        if not left[first]:
            first += 1
            continue
        config = fullest(sizes, left, first, capacity)
        uses = {g: config.count(g) for g in config}
        times = min(left[g] // k for g, k in uses.items())
        for g, k in uses.items():
            left[g] -= k * times
        # each place of the configuration is a column of `times` pieces; columns are cut where an actual length ends
        columns = []
        for g in config:
            column, need = [], times
            while need:
                length, at, n = draw(g, need)
                column.append((length, at, n))
                need -= n
            columns.append(column)
        done, at = 0, [[0, 0] for _ in columns]
        while done < times:
            step = min(c[i][2] - o for c, (i, o) in zip(columns, at, strict=True))
            places, offset = [], 0
            for c, p in zip(columns, at, strict=True):
                length, rank0, n = c[p[0]]
                places.append((length, rank0 + p[1], offset))
                offset += length
                p[1] += step
                if p[1] == n:
                    p[0], p[1] = p[0] + 1, 0
            blocks.put([blocks.sequences, step, places, capacity - offset])
            blocks.sequences += step
            done += step
    for length in sorted(small, reverse=True):
        n = small[length]
        while n:
            block = blocks.take(length)
            if block is None:
                per = capacity // length
                rows = max(1, n // per)
                block = [blocks.sequences, rows, [], capacity]
                blocks.sequences += rows
            start, count, places, room = block
            used = min(n, count)
            if used < count:
                blocks.put([start + used, count - used, [(k, r + used, o) for k, r, o in places], room])
            blocks.put([start, used, [*places, (length, rank[length], capacity - room)], room - length])
            rank[length] += used
            n -= used
    return [(k, r, r + count, start, o) for room in blocks.by_room.values() for start, count, places, _ in room for k, r, o in places]


def rank_parts(pieces: int) -> int:
    """Parts for that many pieces. One length may hold them all, so a part's share of a length stays near RANK_ROWS at most."""
    return max(RANK_PARTS, -(-pieces // RANK_ROWS))


def ranked(pieces: DataFrame, parts: int) -> DataFrame:
    """A rank from 0 among the pieces of a length; pieces is a table of files.

    Each length is dealt over parts by content and place in the file, so neither a length that all pieces share nor an id
    or text that many rows share is a hot spot.
    """
    dealt = pieces.withColumn("_part", F.pmod(F.xxhash64("id", "piece", "start", "ids_crc32", F.col("_metadata.row_index")), F.lit(parts)).cast("int"))
    sizes = dealt.groupBy("length", "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("length", "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("length", "_part").orderBy("id", "piece", "start", "ids_crc32")
    return dealt.withColumn("_row", F.row_number().over(inside)).join(sizes, ["length", "_part"]).withColumn("rank", F.col("_before") + F.col("_row") - 1)


def best_fit_packing(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, sequence_id, offset.

    A document is its token ids and one end id. Those longer than capacity are cut; no other is.

    Null text is empty and becomes the end id alone. Rows with the same id count as documents of their own. Null ids
    stay null. An empty table gives an empty result; other columns of docs are not read. The driver holds the histogram
    of lengths and the plan, whose size follows capacity and not the corpus.
    """
    pieces = cut(token_pieces(docs, id_col, text_col, tokenizer, capacity), "pieces")
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most `capacity` rows
    plan = plan_packing(histogram, capacity)
    plan_schema = "_length long, _from long, _to long, _first long, _offset long"
    places = pieces.sparkSession.createDataFrame(pd.DataFrame(plan, columns=[c.split()[0] for c in plan_schema.split(", ")]) if plan else [], plan_schema)
    # broadcast: the plan has at most some rows per length and configuration
    rows = ranked(pieces, rank_parts(sum(histogram.values()))).join(F.broadcast(places), (F.col("length") == F.col("_length")) & (F.col("rank") >= F.col("_from")) & (F.col("rank") < F.col("_to")))
    return rows.select(F.col("id").alias(id_col), "piece", "start", "length", "ids_crc32", (F.col("_first") + F.col("rank") - F.col("_from")).alias("sequence_id"), F.col("_offset").alias("offset"))


def default_tokenizer(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op3_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    return best_fit_packing(wide_table(spark, sf_dir, "documents"), default_tokenizer())
