"""Sharding: the law, gapless slots, whole rows, and an order that is random and comes again."""

from __future__ import annotations

import zlib
from collections import Counter

import pytest

from hindcast.llm import sharding


def placed(df, *columns):
    return [tuple(r) for r in df.select("shard", "slot", *columns).collect()]


def check_law(rows, total, shards):
    slots = {}
    for shard, slot, *_ in rows:
        slots.setdefault(shard, []).append(slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    counts = [len(slots.get(k, [])) for k in range(shards)]
    assert sum(counts) == total and max(counts) - min(counts) <= 1 and set(slots) <= set(range(shards))


@pytest.mark.parametrize(("n", "shards", "bucket"), [(0, 4, 100), (1, 4, 100), (3, 40, 100), (40, 40, 100), (41, 40, 1000), (500, 7, 700), (500, 7, 10**6), (500, 1, 3000)])
def test_law(spark, n, shards, bucket):
    df = spark.createDataFrame([(i % 5 or None, "text " * (i % 9), i) for i in range(n)], "doc_id long, text string, _bucket long").repartition(3)
    rows = placed(sharding.shard_rows(df, shards, bucket_bytes=bucket), "_bucket", "doc_id", "text")
    check_law(rows, n, shards)
    assert sorted(r[2] for r in rows) == list(range(n))
    assert all(r[3:] == (r[2] % 5 or None, "text " * (r[2] % 9)) for r in rows)


def test_order_comes_again_and_depends_on_the_seed(spark, tmp_path):
    spark.range(3000).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    order = lambda seed: [r[2] for r in sorted(placed(sharding.shard_rows(df, 5, seed, 4000), "id"))]
    one = order(1)
    assert one == order(1) != order(2)
    # as a random order: about one place in 3,000 stays, neighbours are far apart, shards mix all parts of the input
    assert sum(i == x for i, x in enumerate(one)) < 20
    assert sum(abs(a - b) for a, b in zip(one, one[1:])) / 2999 > 800
    for shard in range(5):
        thirds = Counter(x // 1000 for x in one[600 * shard : 600 * shard + 600])
        assert all(140 < thirds[k] < 260 for k in range(3))


def test_each_bucket_has_its_own_order(spark):
    df = spark.range(4000).repartition(4)
    rows = [r[2] for r in sorted(placed(sharding.shard_rows(df, 1, 3, 64 * 500), "id"))]
    assert sorted(rows) == list(range(4000))
    positions = {x: i for i, x in enumerate(rows)}
    up = sum(positions[i] < positions[i + 1] for i in range(3999))
    assert 1800 < up < 2200


def test_copies_do_not_meet_in_one_bucket(spark, monkeypatch):
    sizes = []
    real = sharding.offsets
    monkeypatch.setattr(sharding, "offsets", lambda s, b: sizes.extend(r["_n"] for r in s.collect()) or real(s, b))
    df = spark.createDataFrame([(None, "same")] * 4000, "doc_id long, text string").repartition(4)
    check_law(placed(sharding.shard_rows(df, 3, bucket_bytes=68 * 200)), 4000, 3)
    assert len(sizes) == 20 and max(sizes) < 300


def test_documents(spark):
    table = [(1, "Ünï"), (1, "Ünï"), (None, None), (2, ""), (3, "x" * 100_000)]
    df = spark.createDataFrame([(*r, 1, "s") for r in table], "doc_id long, text string, size int, shard string")
    rows = sharding.shard_documents(df, 2).collect()
    check_law([(r.shard, r.slot) for r in rows], 5, 2)
    key = lambda r: str(r)
    want = [(i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode()), "rows", None) for i, t in table]
    assert sorted(((r.doc_id, r["size"], r.text_crc32, r.law, r.grown_shard) for r in rows), key=key) == sorted(want, key=key)


def test_whole_documents_are_shuffled(spark, monkeypatch):
    held = []
    real = sharding.shard_rows
    monkeypatch.setattr(sharding, "shard_rows", lambda rows, *rest: held.append(rows) or real(rows, *rest))
    df = spark.createDataFrame([(1, "Ünï", "de"), (2, None, "en")], "doc_id long, text string, lang string")
    rows = sharding.shard_documents(df, 2).collect()
    assert sorted(map(tuple, held[0].collect())) == [(1, "Ünï", "de"), (2, None, "en")]
    assert {r.doc_id: (r["size"], r.text_crc32) for r in rows} == {1: (21, zlib.crc32("Ünï".encode())), 2: (16, 0)}


def test_columns_in_the_way(spark):
    with pytest.raises(ValueError, match="shard"):
        sharding.shard_rows(spark.range(3).withColumnRenamed("id", "shard"), 2)


def test_files_of_shards(spark, tmp_path):
    df = spark.range(1000)
    out = sharding.shard_rows(df, 4, bucket_bytes=5000)
    sharding.write_shards(out, str(tmp_path / "s"), parts=2)
    back = spark.read.parquet(str(tmp_path / "s"))
    assert sorted(r["id"] for r in back.collect()) == list(range(1000))
    for path in sorted((tmp_path / "s").glob("shard=*/*.parquet")):
        slots = [r["slot"] for r in spark.read.parquet(str(path)).collect()]
        assert slots == list(range(slots[0], slots[0] + len(slots)))


def test_whole_table(spark):
    sf = "/root/testdata/sf0.01"
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    rows = sharding.op13_sharding(spark, sf).collect()
    check_law([(r.shard, r.slot) for r in rows], len(docs), sharding.SHARDS)
    assert {r.doc_id: (r["size"], r.text_crc32) for r in rows} == {i: (len(t.encode()) + 16, zlib.crc32(t.encode())) for i, t in docs.items()}
