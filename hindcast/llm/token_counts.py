"""Token counts by a count-only Viterbi pass over a unigram vocabulary."""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import wide_table

#: What the tokenizer takes off the least score for a character that no piece covers; how it writes a space.
UNKNOWN_PENALTY, SPACE_MARK = 10.0, "▁"
#: Chunks whose counts a worker remembers, of at most so many characters each; all are forgotten when it is full.
REMEMBER, LONG_CHUNK = 1_000_000, 64


class UnigramCounter(dict):
    """Chunk of text to its number of tokens under the best segmentation.

    Score of a segmentation: the sum of its pieces' scores. Ends are reached in text order; at an end, a segmentation
    replaces the best one so far only if its score is higher, and starts are tried from the left, so that of equal
    scores the one with the longest last piece stays. A character that is no piece itself may stand alone for the least
    score less a penalty; it counts its UTF-8 bytes with byte fallback, else a run of such characters counts one.
    """

    def __init__(self, pieces: list[tuple[str, float]], byte_fallback: bool = True):
        super().__init__()
        self.automaton = ahocorasick.Automaton()
        self.single = {p for p, _ in pieces if len(p) == 1}
        for piece, score in pieces:
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown = min((s for _, s in pieces), default=0.0) - UNKNOWN_PENALTY
        self.byte_fallback = byte_fallback
        # a text may be cut before a space mark, and around a character that is in no piece, if no piece spans the cut
        joined = {c for p, _ in pieces for c in p}
        spans_space = any(SPACE_MARK in p.lstrip(SPACE_MARK) for p, _ in pieces)
        alone = "".join(c for c in "\n\t\r" if c not in joined) if byte_fallback else ""
        mark = SPACE_MARK
        if spans_space:
            self.find = lambda text: [text] if text else []
        else:
            self.find = re.compile(f"[{alone}]|{mark}*[^{mark}{alone}]+|{mark}+" if alone else f"{mark}*[^{mark}]+|{mark}+").findall

    def __missing__(self, chunk: str) -> int:
        n = self.best(chunk)[1]
        if len(chunk) <= LONG_CHUNK:
            if len(self) >= REMEMBER:
                self.clear()
            self[chunk] = n
        return n

    def best(self, chunk: str) -> tuple[float, int]:
        """Best score of the chunk, and that segmentation's number of tokens."""
        n = len(chunk)
        ends: list[list] = [[] for _ in range(n + 1)]
        for last, match in self.automaton.iter(chunk):
            ends[last + 1].append(match)
        score, count, open_run = [0.0] * (n + 1), [0] * (n + 1), [False] * (n + 1)
        for end in range(1, n + 1):
            top = None
            for length, s in sorted(ends[end], reverse=True):
                s += score[end - length]
                if top is None or s > top:
                    top, start = s, end - length
                    tokens, run = count[start] + 1, False
            c = chunk[end - 1]
            if c not in self.single and (top is None or score[end - 1] + self.unknown > top):
                top = score[end - 1] + self.unknown
                run = True
                tokens = count[end - 1] + (len(c.encode()) if self.byte_fallback else not open_run[end - 1])
            score[end], count[end], open_run[end] = top, tokens, run
        return score[n], count[n]

    def count(self, text: str) -> int:
        """Tokens of a text; a space mark is put before it, and each space becomes one."""
        if not text:
            return 0
        return sum(map(self.__getitem__, self.find((" " + text).replace(" ", SPACE_MARK))))


_counters: dict[str, UnigramCounter] = {}


def vocabulary(path: str) -> list[tuple[str, float]]:
    """Pieces and scores of a sentencepiece file, without its control, unknown and byte pieces."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(sp.id_to_piece(i), sp.get_score(i)) for i in range(sp.vocab_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]


def counter(path: str) -> UnigramCounter:
    """One per worker, kept over tasks."""
    if path not in _counters:
        _counters[path] = UnigramCounter(vocabulary(path))
    return _counters[path]


def token_counts(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, n_tokens.

    Null and empty text have no tokens. Null ids and repeated rows each give a row; other columns of docs are not read.
    Nothing is shuffled; a long text is handled word by word.
    """
    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("n_tokens", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(tokenizer).count
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([count(t.as_py()) for t in batch.column(1)], pa.int64())], names=schema.names)

    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).alias("id"), text.alias("text")).mapInArrow(run, schema).withColumnRenamed("id", id_col)


def op6_token_counts(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(wide_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
