"""Alignment of the tokens of two tokenizers by an interval index over the bytes of a text."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, wide_table
from .packing import byte_letters

#: A text up to the next seam, a single space between two other characters: no token spans the place before it.
CHUNK = re.compile(r" ?\s*\S+(?:(?:\s\s+|[^\S ])\S+)*(?:\s+$)?|\s+")
SPACE_MARK = "▁"
#: Chunks, and characters of chunks, that a worker remembers before it starts anew.
REMEMBER, REMEMBER_CHARACTERS = 300_000, 1 << 25
#: Characters that are encoded at once; characters of documents that are handled at once.
ENCODE, STEP = 1 << 20, 1 << 20
#: A group with more links than this is counted by distinct ids, not link by link.
LARGE_GROUP = 4096
#: Pairs whose corpus-wide counts every task gets, in two numbers each; rarer pairs meet their counts in a join.
KNOWN_PAIRS = 2_000_000


class ByteLevel:
    """Ids of a byte-level BPE file of ``tokenizers``, and the bytes of each id. Special strings are plain text."""

    def __init__(self, path: str):
        import tiktoken
        from public_tokenizers import PATTERN

        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        special = {t["content"] for t in model.get("added_tokens", [])}
        to_byte = {c: b for b, c in byte_letters().items()}
        ranks = {bytes(to_byte[c] for c in token): i for token, i in model["model"]["vocab"].items() if token not in special}
        self.encode = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.bytes = table_of({i: token for token, i in ranks.items()})
        self.seams = True


class Pieces:
    """Ids of a sentencepiece file that puts a space before a text, and the bytes of each id.

    ``encode`` takes the text with that space in front.
    """

    def __init__(self, path: str):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.sp.vocab_size()
        names = [self.sp.id_to_piece(i) for i in range(n)]
        self.bytes = table_of({i: bytes([int(p[3:5], 16)]) if self.sp.is_byte(i) else p.replace(SPACE_MARK, " ").encode() for i, p in enumerate(names)})
        # a piece with a space behind other characters could span a seam
        self.seams = not any(SPACE_MARK in p.lstrip(SPACE_MARK) for p in names)

    def encode(self, text: str) -> list[int]:
        return self.sp.encode(text[1:])


def table_of(by_id: dict[int, bytes]) -> list[bytes]:
    return [by_id.get(i, b"") for i in range(max(by_id) + 1)]


def overlaps(a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each A token, the first and the last B token whose byte range meets its own.

    The ends are ascending, so they are the static index of the B ranges, and a bisection finds the one that holds a byte.
    """
    starts = np.concatenate([[0], a_ends[:-1]]) if len(a_ends) else a_ends
    return np.searchsorted(b_ends, starts, side="right"), np.searchsorted(b_ends, a_ends, side="left")


def groups_of(a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The group of each A token and of each B token: the gap after a token that no token of the other side spans ends a group."""
    _, last = overlaps(a_ends, b_ends)
    closed = b_ends[last] == a_ends  # the last B token met ends here too: nothing spans the gap
    a_group = np.cumsum(closed) - closed
    b_closed = np.zeros(len(b_ends), bool)
    b_closed[last[closed]] = True
    return a_group, np.cumsum(b_closed) - b_closed


def links_of(a_ids: np.ndarray, b_ids: np.ndarray, a_group: np.ndarray, b_group: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(group, pair code, times) of all links: A id in the upper 32 bits, B id in the lower."""
    n = int(a_group[-1]) + 1
    n_a, n_b = np.bincount(a_group, minlength=n), np.bincount(b_group, minlength=n)
    first_b = np.cumsum(n_b) - n_b
    plain = (n_a * n_b <= LARGE_GROUP)[a_group]
    width = n_b[a_group] * plain
    inner = np.arange(width.sum()) - np.repeat(np.cumsum(width) - width, width)
    code = np.repeat(a_ids << 32, width) | b_ids[np.repeat(first_b[a_group], width) + inner]
    parts = [(np.repeat(a_group, width), code, np.ones(len(code), np.int64))]
    for g in np.unique(a_group[~plain]):  # every A id with every B id, once, and how often
        (a, ka), (b, kb) = np.unique(a_ids[a_group == g], return_counts=True), np.unique(b_ids[b_group == g], return_counts=True)
        parts.append((np.full(len(a) * len(b), g), np.add.outer(a << 32, b).ravel(), np.outer(ka, kb).ravel()))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


class Aligner:
    """Chunks of texts with their alignment, each computed once: a worker keeps it over batches and tasks.

    A text is cut at its seams. Tokens and groups of a text are those of its chunks, one after the other, so what a chunk
    gives is looked up. ``fresh`` forgets all chunks once there are many.
    """

    def __init__(self, a_path: str, b_path: str):
        self.a, self.b = ByteLevel(a_path), Pieces(b_path)
        self.a_size, self.b_size = (np.array([len(x) for x in side.bytes], np.int64) for side in (self.a, self.b))
        self.seams = self.a.seams and self.b.seams
        self.marked = [f"{i}{mark}" for sizes, marks in ((self.a_size, ",|"), (self.b_size, ",;")) for mark in marks for i in range(len(sizes))]
        self.find = CHUNK.findall if self.seams else lambda text: [text]
        self.fresh()

    def fresh(self) -> None:
        self.at: dict[str, int] = {}
        self.broken: set[int] = set()
        self.size = 0
        self.text: list[str] = []
        self.counts = np.zeros((0, 4), np.int64)
        self.codes = self.times = np.zeros(0, np.int64)
        self.first = np.zeros(1, np.int64)

    def learn(self, chunks: list[str]) -> None:
        """Encode and align chunks that are not known yet."""
        if not chunks:
            return
        parts, run, size = [], [], 0
        for c in chunks:
            # alone: what stands beside it could change its tokens
            joinable = self.seams and c[1:2].strip() != "" and not c[-1].isspace()
            if run and (not joinable or size > ENCODE):
                parts.append(self.encoded(run))
                run, size = [], 0
            run.append(c)
            size += len(c)
            if not joinable:
                parts.append(self.encoded(run))
                run, size = [], 0
        if run:
            parts.append(self.encoded(run))
        a_ids, b_ids, a_n, b_n = (np.concatenate(x) for x in zip(*parts, strict=True))
        known, many = len(self.at), len(chunks)
        self.size += sum(map(len, chunks))
        self.at.update(zip(chunks, range(known, known + many), strict=True))
        self.broken.update((known + np.flatnonzero(a_n == 0)).tolist())
        counts = np.zeros((many, 4), np.int64)
        pairs = np.zeros(many, np.int64)
        codes = times = np.zeros(0, np.int64)
        texts = [""] * many
        if len(a_ids):
            a_group, b_group = groups_of(np.cumsum(self.a_size[a_ids]), np.cumsum(self.b_size[b_ids]))
            # chunks end groups, so a group lies in the chunk of its tokens
            home = np.zeros(int(a_group[-1]) + 1, np.int64)
            home[a_group] = np.repeat(np.arange(many), a_n)
            group, codes, times = links_of(a_ids, b_ids, a_group, b_group)
            order = np.argsort(home[group], kind="stable")
            codes, times, owner = codes[order], times[order], home[group][order]
            pairs = np.bincount(owner, minlength=many)
            counts[:, 0], counts[:, 1] = a_n, b_n
            counts[:, 2] = np.bincount(home, minlength=many)
            counts[:, 3] = np.bincount(owner, times, minlength=many)
            words = self.written(a_ids, b_ids, a_group, b_group)
            ends = np.cumsum(a_n + b_n).tolist()
            texts = ["".join(words[i:j]) for i, j in zip([0, *ends[:-1]], ends, strict=True)]
        self.text += texts
        self.counts = np.concatenate([self.counts, counts])
        self.codes, self.times = np.concatenate([self.codes, codes]), np.concatenate([self.times, times])
        self.first = np.concatenate([self.first, self.first[-1] + np.cumsum(pairs)])

    def written(self, a_ids: np.ndarray, b_ids: np.ndarray, a_group: np.ndarray, b_group: np.ndarray) -> list[str]:
        """The ids in the order a1,a2|b1; group by group, each with the mark that follows it."""
        last_a, last_b = (np.append(g[1:] != g[:-1], True) for g in (a_group, b_group))
        # four tables of written ids, one after the other: A id and comma, A id and bar, B id and comma, B id and semicolon
        at = np.concatenate([a_ids + last_a * len(self.a_size), b_ids + 2 * len(self.a_size) + last_b * len(self.b_size)])
        order = np.argsort(np.concatenate([2 * a_group, 2 * b_group + 1]), kind="stable")
        return list(map(self.marked.__getitem__, at[order].tolist()))

    def encoded(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """A and B ids of a run of chunks, encoded at once, and how many of each belong to each chunk.

        A chunk has none where the bytes of either differ from its own.
        """
        text = "".join(chunks)
        raw = text.encode()
        a, b = self.a.encode(text), self.b.encode(text)
        if b"".join([self.a.bytes[i] for i in a]) != raw or b"".join([self.b.bytes[i] for i in b]) != raw:
            if len(chunks) == 1:
                return tuple(np.zeros(n, np.int64) for n in (0, 0, 1, 1))
            half = len(chunks) // 2
            return tuple(np.concatenate(x) for x in zip(self.encoded(chunks[:half]), self.encoded(chunks[half:]), strict=True))
        ends = np.cumsum([len(c) for c in chunks] if len(raw) == len(text) else [len(c.encode()) for c in chunks])
        a, b = np.array(a, np.int64), np.array(b, np.int64)
        return a, b, *[np.diff(np.searchsorted(np.cumsum(size[ids]), ends, side="right"), prepend=0) for ids, size in ((a, self.a_size), (b, self.b_size))]

    def documents(self, texts: list[str]) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray, np.ndarray]:
        """Per text its counts (A tokens, B tokens, groups, links), the digest of its groups, its distinct pairs' number;
        then the pairs' codes and times, text by text."""
        if len(self.at) > REMEMBER or self.size > REMEMBER_CHARACTERS:
            self.fresh()
        parts = [self.find(" " + t) if t else [] for t in texts]
        self.learn(list(set().union(*parts) - self.at.keys()))
        digests, rows, sizes = [], [], []
        for p in parts:
            row = list(map(self.at.__getitem__, p))
            if self.broken and not self.broken.isdisjoint(row):
                row = []
            groups = "".join(map(self.text.__getitem__, row))
            digests.append(hashlib.sha256(groups[:-1].encode()).hexdigest() if row else "")
            rows.append(row)
            sizes.append(len(row))
        sizes = np.array(sizes, np.int64)
        chunk = np.fromiter(chain.from_iterable(rows), np.int64, int(sizes.sum()))
        doc = np.repeat(np.arange(len(texts)), sizes)
        counts = np.stack([np.bincount(doc, self.counts[chunk, k], minlength=len(texts)) for k in range(4)], axis=1).astype(np.int64)
        # each distinct chunk of a document once, with how often it stands there
        key, often = np.unique(doc * len(self.at) + chunk, return_counts=True) if len(chunk) else (chunk, chunk)
        doc, chunk = np.divmod(key, max(1, len(self.at)))
        width = self.first[chunk + 1] - self.first[chunk]
        at = np.repeat(self.first[chunk] - np.cumsum(width) + width, width) + np.arange(width.sum())
        doc, code, times = np.repeat(doc, width), self.codes[at], self.times[at] * np.repeat(often, width)
        order = np.lexsort((code, doc))
        doc, code, times = doc[order], code[order], times[order]
        new = np.ones(len(code), bool)
        new[1:] = (doc[1:] != doc[:-1]) | (code[1:] != code[:-1])
        starts = np.flatnonzero(new)
        times = np.add.reduceat(times, starts) if len(starts) else times
        return counts, digests, np.bincount(doc[starts], minlength=len(texts)), code[starts], times


_aligners: dict[tuple[str, str], Aligner] = {}


def aligner(a_path: str, b_path: str) -> Aligner:
    """One per worker, kept over tasks."""
    if (a_path, b_path) not in _aligners:
        _aligners[a_path, b_path] = Aligner(a_path, b_path)
    return _aligners[a_path, b_path]


def aligned(docs: DataFrame, a_path: str, b_path: str, id_col: str, text_col: str) -> DataFrame:
    """One row per input row: its key, id, counts and digest, and its distinct linked pairs with their number of links."""
    longs = [T.StructField(n, T.LongType()) for n in ("n_a", "n_b", "n_groups", "n_links")]
    lists = [T.StructField(n, T.ArrayType(T.LongType())) for n in ("pairs", "times")]
    schema = T.StructType([T.StructField("key", T.LongType()), T.StructField("id", docs.schema[id_col].dataType), *longs, T.StructField("groups_sha256", T.StringType()), *lists])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = aligner(a_path, b_path)
        for batch in batches:
            for part in steps(batch):
                counts, digests, n, codes, times = own.documents(part.column(2).to_pylist())
                ends = pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32))
                columns = [part.column(0), part.column(1), *[pa.array(counts[:, k]) for k in range(4)], pa.array(digests)]
                yield pa.RecordBatch.from_arrays([*columns, *[pa.ListArray.from_arrays(ends, pa.array(x)) for x in (codes, times)]], names=schema.names)

    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.monotonically_increasing_id().alias("key"), F.col(id_col).alias("id"), text.alias("text")).mapInArrow(run, schema)


def steps(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about STEP characters, of a document at least."""
    start, size = 0, 0
    for i, n in enumerate(pa.compute.utf8_length(batch.column(2)).to_pylist()):
        size += n
        if size >= STEP:
            yield batch.slice(start, i + 1 - start)
            start, size = i + 1, 0
    if start < len(batch):
        yield batch.slice(start)


def pair_counts(rows: DataFrame) -> DataFrame:
    """(pair, count, best): documents that hold each pair linked, and whether no pair of its A id has more.

    Tasks add up before the shuffle, so a pair of every document is a row for each task.
    """
    seen = rows.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("count"))
    seen = cut(seen, "pairs")
    # as many rows as A has ids
    top = seen.groupBy(F.shiftright("pair", 32).alias("a")).agg(F.max("count").alias("top"))
    return seen.join(F.broadcast(top), F.shiftright(seen["pair"], 32) == top["a"]).select("pair", "count", (F.col("count") == F.col("top")).alias("best"))


def known_pairs(pairs: DataFrame, most: int) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    """(least, pair, count, best): the pairs in at least ``least`` documents, as few as make no more than ``most`` of them."""
    sizes = {r["k"]: r["n"] for r in pairs.groupBy(F.floor(F.log2("count")).alias("k")).agg(F.count(F.lit(1)).alias("n")).collect()}
    total, level = 0, max(sizes, default=0) + 1
    while level > 0 and total + sizes.get(level - 1, 0) <= most:
        level -= 1
        total += sizes.get(level, 0)
    least = 2**level
    t = pairs.where(F.col("count") >= least).toArrow()
    pair, count, best = (t.column(c).to_numpy() for c in ("pair", "count", "best"))
    order = np.argsort(pair)
    return least, pair[order], count[order], best[order]


def align_tokens(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text", most_known: int = KNOWN_PAIRS) -> DataFrame:
    """One row per input row: id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    A is a byte-level BPE file of ``tokenizers``, B a sentencepiece file; both get the text with a space in front. The ends of
    B tokens are a static index: bisection finds the B tokens that each A token meets, and a gap that none spans ends a group.
    A pair of ids is linked where both stand in one group; its count is the number of rows that hold it.

    Each text is tokenized once. Its distinct pairs are written, counted over all rows and then valued: the most frequent
    pairs (at most ``most_known``, so a bound that no corpus moves) go to every task, and each rarer one joins its count, so
    the result is the same whatever the bound. Nothing is shuffled but pairs: one row for each task or rare occurrence.

    Null and empty texts, and texts whose tokens do not give back their bytes (a literal U+2581), have zeros and ''. Repeated
    rows and null ids are rows of their own and count as documents. A long text is handled chunk by chunk; a chunk without
    seams is held whole. An empty table gives an empty result; other columns of docs are not read.
    """
    rows = cut(aligned(docs, a_path, b_path, id_col, text_col), "aligned")
    pairs = cut(pair_counts(rows), "pair_counts")
    least, pair, count, best = known_pairs(pairs, most_known)
    table = docs.sparkSession.sparkContext.broadcast((pair, count, best))
    sums = T.StructType([*[f for f in rows.schema if f.name not in ("pairs", "times")], T.StructField("n_best", T.LongType()), T.StructField("count_sum", T.LongType())])

    def found(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Row number, code and times of each pair of a batch; its place in the table, and whether it is there."""
        pair, _, _ = table.value
        n = len(batch.schema) - 2
        lists = batch.column(n)
        code, times = lists.flatten().to_numpy(), batch.column(n + 1).flatten().to_numpy()
        row = np.repeat(np.arange(len(batch)), np.diff(lists.offsets.to_numpy()))
        place = np.searchsorted(pair, code)
        there = np.zeros(len(code), bool)
        inside = place < len(pair)
        there[inside] = pair[place[inside]] == code[inside]
        return row, code, times, place, there

    def value(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, count, best = table.value
        for batch in batches:
            row, _, times, place, there = found(batch)
            out = np.zeros((2, len(batch)), np.int64)
            place, times, row = place[there], times[there], row[there]
            np.add.at(out[0], row, times * best[place])
            np.add.at(out[1], row, times * count[place])
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], pa.array(out[0]), pa.array(out[1])], names=sums.names)

    def rare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, code, times, _, there = found(batch)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row[~there])), pa.array(code[~there]), pa.array(times[~there])], names=["key", "pair", "times"])

    out = rows.mapInArrow(value, sums)
    if least > 1:
        left = rows.select("key", "pairs", "times").mapInArrow(rare, "key long, pair long, times long")
        more = left.join(pairs.where(F.col("count") < least), "pair").groupBy("key").agg(F.sum(F.col("times") * F.col("best").cast("long")).alias("_best"), F.sum(F.col("times") * F.col("count")).alias("_sum"))
        out = out.join(more, "key", "left").withColumn("n_best", F.col("n_best") + F.coalesce("_best", F.lit(0))).withColumn("count_sum", F.col("count_sum") + F.coalesce("_sum", F.lit(0)))
    return out.select(F.col("id").alias(id_col), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def op11_cross_tokenizer(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return align_tokens(wide_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
