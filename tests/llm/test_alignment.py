"""Cross-tokenizer alignment against a plain merge of the two token lists."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

from hindcast.llm import alignment

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
COLUMNS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


@pytest.fixture(scope="module")
def sides():
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    return a, SentencePieceProcessor(model_file=B), alignment.ByteLevel(A).bytes, alignment.Pieces(B).bytes


def groups(text, sides):
    """Groups of (A ids, B ids): both lists are read along the bytes, and a group ends where both stand at one byte."""
    a_tok, b_tok, a_bytes, b_bytes = sides
    if not text:
        return []
    raw = (" " + text).encode()
    a, b = a_tok.encode(" " + text, add_special_tokens=False).ids, b_tok.encode(text)
    if b"".join(a_bytes[i] for i in a) != raw or b"".join(b_bytes[i] for i in b) != raw:
        return []
    out, i, j, x, y = [([], [])], 0, 0, 0, 0
    while i < len(a) or j < len(b):
        if x == y and out[-1][0]:
            out.append(([], []))
        if x <= y and i < len(a):
            x, i = x + len(a_bytes[a[i]]), i + 1
            out[-1][0].append(a[i - 1])
        else:
            y, j = y + len(b_bytes[b[j]]), j + 1
            out[-1][1].append(b[j - 1])
    return out


def plain(docs, sides):
    """id to COLUMNS, for (id, text) with ids of their own."""
    linked, whole = {}, {i: groups(t, sides) for i, t in docs}
    for i, gs in whole.items():
        linked[i] = Counter((a, b) for x, y in gs for a in x for b in y)
    count = Counter(p for c in linked.values() for p in c)
    top = {}
    for (a, _), n in count.items():
        top[a] = max(n, top.get(a, 0))
    out = {}
    for i, gs in whole.items():
        c = linked[i]
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in gs)
        digest = hashlib.sha256(text.encode()).hexdigest() if gs else ""
        out[i] = (sum(len(x) for x, _ in gs), sum(len(y) for _, y in gs), len(gs), sum(c.values()), sum(n for p, n in c.items() if count[p] == top[p[0]]), sum(n * count[p] for p, n in c.items()), digest)
    return out


ODD = [None, "", " ", "\n", "a", "a  b", "  x  ", "a ▁ b", "▁", "<|endoftext|> and <s> it's", "日本語 テキスト 🙂 é", "=" * 3000, "\x1c \x1c a \x00 b", "tab\tand\nline \n end ", " x  y", "same words here", "same words here", "un believable unbelievable " * 30]


def result(df):
    return {r["doc_id"]: tuple(r[c] for c in COLUMNS) for r in df.collect()}


def test_odd_texts(spark, sides):
    docs = list(enumerate(ODD))
    df = spark.createDataFrame([(i, t, "x", 1, 2) for i, t in docs], "doc_id long, text string, id string, pair long, key int").repartition(3)
    assert result(alignment.align_tokens(df, A, B)) == plain(docs, sides)
    assert alignment.align_tokens(df.limit(0), A, B).count() == 0


def test_rare_pairs_join_their_counts(spark, sides):
    docs = list(enumerate(ODD))
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    want = plain(docs, sides)
    for most in (0, 5, 60):
        assert result(alignment.align_tokens(df, A, B, most_known=most)) == want


def test_repeated_rows_and_null_ids(spark, sides):
    df = spark.createDataFrame([(None, "one two three"), (None, "one two three"), (7, "one two three"), (7, "one four")], "doc_id long, text string")
    want = plain(list(enumerate(["one two three"] * 3 + ["one four"])), sides)
    got = sorted((tuple(r[c] for c in COLUMNS) for r in alignment.align_tokens(df, A, B).collect()))
    assert got == sorted(want.values())


def test_a_whole_table(spark, sides):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    docs = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
    assert result(alignment.align_tokens(df, A, B, most_known=500)) == plain(docs, sides)


def test_forgetting_chunks_changes_nothing(monkeypatch):
    rng = random.Random(2)
    texts = [" ".join("".join(rng.choice("abcdé, \n") for _ in range(rng.randrange(1, 9))) for _ in range(40)) for _ in range(30)]
    one, other = alignment.Aligner(A, B), alignment.Aligner(A, B)
    counts, digests, n, codes, times = one.documents(texts)
    monkeypatch.setattr(alignment, "REMEMBER", 5)
    monkeypatch.setattr(alignment, "ENCODE", 20)
    monkeypatch.setattr(alignment, "LARGE_GROUP", 1)
    parts = [other.documents([t]) for t in texts]
    assert np.array_equal(counts, np.concatenate([p[0] for p in parts])) and digests == [p[1][0] for p in parts]
    assert np.array_equal(codes, np.concatenate([p[3] for p in parts])) and np.array_equal(times, np.concatenate([p[4] for p in parts]))


def test_overlaps():
    a, b = np.array([2, 5, 6, 9]), np.array([1, 2, 6, 7, 9])
    first, last = alignment.overlaps(a, b)
    assert first.tolist() == [0, 2, 2, 3] and last.tolist() == [1, 2, 2, 4]
    x, y = alignment.groups_of(a, b)
    assert x.tolist() == [0, 1, 1, 2] and y.tolist() == [0, 0, 1, 2, 2]
