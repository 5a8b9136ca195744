"""Corpus operators against plain versions, on small tables with nulls, empty texts, ties, repeated rows and odd columns."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import brute
import pytest
from pyspark.sql import functions as F

from hindcast.llm import common, exact_dedup, html_text, mixing, near_dedup, packing, quality_rules, substring_dedup, suffix_dedup, token_counts, url_filter

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, kept string, th string, node string, anchor string, tokens string"


def words(rng, n):
    return " ".join(rng.choice(["alpha", "Beta", "gamma,", "delta", "eps", "zeta", "Ünï", "theta.", "iota", "kap"]) + str(rng.randrange(40)) for _ in range(n))


def corpus():
    rng = random.Random(5)
    base, passage = words(rng, 120), words(rng, 70)
    texts = [words(rng, rng.randrange(1, 90)) for _ in range(12)]
    texts += [base, base, base + " tail", base.replace("alpha", "omega", 2), base.upper(), passage + " " + words(rng, 30), words(rng, 20) + " " + passage, passage + " " + passage]
    texts += [None, "", "   \n", "one two three", "ONE two Three", "x", words(rng, 4000) + " " + passage, "\n".join(["same line here"] * 12), "<|endoftext|> 'll 日本語 🙂 \u00a0 x", "### %%% a | b | c *** $$ && << >> |||"]
    rows = [(i, t, ["en", "de", None][i % 3], ["a", "b", None][i % 2 if i % 7 else 2], None) for i, t in enumerate(texts)]
    return [(*r, "x", "y", "z", "w", "v", "u") for r in rows]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def pairs():
    return [(r[0], r[1]) for r in corpus()]


def test_suffix_dedup(docs, nothing):
    got = suffix_dedup.suffix_dedup(docs, window=60)
    assert rows(got, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == brute.substring(pairs(), 60, False)
    first = suffix_dedup.suffix_dedup(docs, window=60, keep="first")
    assert rows(first, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == brute.substring(pairs(), 60, False, True)
    assert suffix_dedup.suffix_dedup(nothing).count() == 0


def test_substring_dedup(docs, nothing):
    got = substring_dedup.count_min_dedup(docs, window=12)
    assert rows(got, "doc_id", "n_words", "n_removed", "n_spans", "kept_sha256") == brute.substring(pairs(), 12, True)
    first = substring_dedup.count_min_dedup(docs, window=12, keep="first")
    assert rows(first, "doc_id", "n_words", "n_removed", "n_spans", "kept_sha256") == brute.substring(pairs(), 12, True, True)
    assert substring_dedup.count_min_dedup(nothing).count() == 0


def test_whole_tables_at_the_real_window(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    own = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    got = suffix_dedup.suffix_dedup(docs)
    assert rows(got, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == brute.substring(own, suffix_dedup.WINDOW, False)
    got = substring_dedup.count_min_dedup(docs)
    assert rows(got, "doc_id", "n_words", "n_removed", "n_spans", "kept_sha256") == brute.substring(own, substring_dedup.WINDOW, True)


def test_longest_previous_factors():
    import numpy as np

    rng = random.Random(3)
    for window in (3, 8, 10, 24, 60, 100):
        text = bytes(rng.choice(b"ab") for _ in range(30))
        text = b"".join(text[rng.randrange(30) :] for _ in range(25))
        starts = np.array(sorted(rng.sample(range(len(text) - window + 1), 90)))

        def common(a, b, text=text, window=window):
            return next((k for k in range(window) if text[a + k] != text[b + k]), window)

        lpf, follow = suffix_dedup.previous_factors(np.frombuffer(text, dtype=np.uint8), starts, window)
        for i, s in enumerate(starts):
            assert lpf[i] == max((common(s, x) for x in starts[:i]), default=0)
            assert (follow[i] >= window) == any(common(s, x) >= window for x in starts[i + 1 :])


def test_count_min_never_estimates_too_low(spark):
    import numpy as np

    unit = substring_dedup.Unit(True, 12, 6)
    own = spark.createDataFrame([(t or "",) for _, t in pairs()], "text string").repartition(3)
    sieve = substring_dedup.count_min_sieve(own, unit)
    from hindcast.llm import windows

    anchors = []
    for _, t in pairs():
        data = np.frombuffer((t or "").encode(), dtype=np.uint8)
        symbols, at = windows.word_hashes(data, np.array([0, len(data)]))
        anchors.append(windows.segments(symbols, at, 12, 6)[3])
    anchors = np.concatenate(anchors)
    each, n = np.unique(anchors, return_counts=True)
    said = sieve(each)
    assert said[n > 1].all() and said[n == 1].mean() < 0.05


def test_blocks_hold_whole_anchors(docs, monkeypatch):
    from hindcast.llm import repeats

    monkeypatch.setattr(repeats, "BLOCK_BYTES", 2_000)
    got = suffix_dedup.suffix_dedup(docs, window=60)
    assert rows(got, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == brute.substring(pairs(), 60, False)


def test_hot_anchors_go_through_single_windows(docs, monkeypatch):
    from hindcast.llm import repeats

    monkeypatch.setattr(repeats, "HOT_ANCHOR", 1)
    got = substring_dedup.count_min_dedup(docs, window=12)
    assert rows(got, "doc_id", "n_words", "n_removed", "n_spans", "kept_sha256") == brute.substring(pairs(), 12, True)


def test_repeated_rows_lose_what_they_share(spark):
    text = words(random.Random(1), 30)
    df = spark.createDataFrame([(1, text), (1, text), (None, "other " + text)], "doc_id long, text string")
    assert {r.n_removed for r in substring_dedup.count_min_dedup(df, window=10).where("doc_id = 1").collect()} == {30}


def test_many_copies_of_a_row_count_and_are_compared_once(spark):
    rng = random.Random(44)
    base, passage = words(rng, 60), words(rng, 20)
    table = [(None, base)] * 40 + [(None, words(rng, 15) + " " + passage)] * 3 + [(1, passage + " " + words(rng, 10)), (1, words(rng, 30)), (2, base + " more"), (2, base + " more"), (3, None), (3, None)]
    docs = spark.createDataFrame(table, "doc_id long, text string").repartition(4)
    for own, window, by_words in ((suffix_dedup.suffix_dedup, 60, False), (substring_dedup.count_min_dedup, 12, True)):
        want = brute.substring(list(enumerate(t for _, t in table)), window, by_words)
        got = own(docs, window=window).collect()
        assert sorted(((r["doc_id"] or 0, *r[1:5]) for r in got), key=str) == sorted(((table[i][0] or 0, *rest) for i, *rest in want), key=str)


def test_long_text_in_parts(spark, monkeypatch):
    from hindcast.llm import windows

    monkeypatch.setattr(windows, "CHUNK", 500)
    import numpy as np
    import pyarrow as pa

    text = words(random.Random(2), 600)
    at, data = windows.utf8(pa.array([text, text[:300], ""]))
    t, s, n, anchor, _ = windows.segments(windows.BYTE_HASH[data], at, 40, 8)
    covered = {(int(a), int(b) + i) for a, b, c in zip(t, s, n, strict=True) for i in range(c)}
    assert covered == {(k, i) for k, x in enumerate((text, text[:300])) for i in range(len(x.encode()) - 39)}
    seen = {}
    raw = [text.encode(), text[:300].encode()]
    for a, b, c, m in zip(t, s, n, anchor, strict=True):
        for i in range(c):
            assert seen.setdefault(raw[a][b + i : b + i + 40], m) == m
    assert np.all(n > 0)


def test_near_dedup(docs, nothing):
    got = near_dedup.near_dedup(docs)
    assert rows(got, "doc_id", "n_shingles", "component_id", "kept") == brute.near(pairs())
    assert near_dedup.near_dedup(nothing).count() == 0


def test_near_dedup_large_group_in_parts(spark, monkeypatch):
    rng = random.Random(9)
    base = words(rng, 60).split()
    texts = []
    for i in range(40):
        t = list(base)
        for _ in range(i % 4):
            t[rng.randrange(60)] = f"new{rng.randrange(1000)}"
        texts.append((i, " ".join(t)))
    monkeypatch.setattr(near_dedup, "PART", 7)
    got = near_dedup.near_dedup(spark.createDataFrame(texts, "doc_id long, text string"))
    assert rows(got, "doc_id", "n_shingles", "component_id", "kept") == brute.near(texts)


def test_near_dedup_on_a_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    own = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert rows(near_dedup.near_dedup(docs), "doc_id", "n_shingles", "component_id", "kept") == brute.near(own)


def test_near_dedup_of_nodes_that_stars_leave_apart(spark, monkeypatch):
    rng = random.Random(21)
    base = [f"w{i}" for i in range(80)]
    texts = []
    for i in range(90):  # drifts away from the first text, so that a band's hub links few of its nodes
        at = (7 * i) % 76
        base = base[:at] + [f"x{i}"] + base[at + 1 :]
        texts.append((i, " ".join(base)))
    rng.shuffle(texts)
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    want = brute.near(texts)
    for part in (500, 3):
        monkeypatch.setattr(near_dedup, "PART", part)
        assert rows(near_dedup.near_dedup(docs), "doc_id", "n_shingles", "component_id", "kept") == want


def test_components_of_edges_that_change_when_computed_again(spark):
    import os

    from hindcast.llm.near_dedup import components

    flip = F.udf(lambda i: os.urandom(1)[0] < 128, "boolean").asNondeterministic()
    node = lambda c: F.lpad(c.cast("string"), 4, "0").cast("binary")
    path = spark.range(40).select("id", flip("id").alias("f")).select(
        F.when(F.col("f"), node(F.col("id"))).otherwise(node(F.col("id") + 1)).alias("a"), F.when(F.col("f"), node(F.col("id") + 1)).otherwise(node(F.col("id"))).alias("b")
    )
    got = components(path).collect()
    assert len(got) == 41 and {bytes(r["comp"]) for r in got} == {b"0000"}


def test_sketch_merges_and_estimates():
    import numpy as np

    from hindcast.llm import setsketch as S

    rng = np.random.default_rng(3)
    x = rng.integers(0, 1 << 63, 3000, dtype=np.uint64)
    a, b = x[:2000], x[1000:]
    assert (np.maximum(S.registers(a), S.registers(b)) == S.registers(x)).all()
    pair = lambda n: (x[:1000], np.concatenate([x[: int(n * 1000)], rng.integers(0, 1 << 63, 1000 - int(n * 1000), dtype=np.uint64)]))
    for shared, want in ((0.95, True), (0.2, False)):
        p, q = pair(shared)
        assert S.may_link(S.registers(p)[None], S.registers(q)[None], np.array([1000]), np.array([1000]), 0.75)[0] == want


def test_exact_dedup(spark, docs, nothing):
    groups = {}
    for i, t in pairs():
        groups.setdefault(t or "", []).append(i)
    want = sorted((i, max(groups[t or ""]), len(groups[t or ""]), i == max(groups[t or ""]), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in pairs())
    assert rows(exact_dedup.exact_dedup(docs), "doc_id", "keep_id", "group_size", "kept", "text_sha256") == want
    assert exact_dedup.exact_dedup(nothing).count() == 0
    small = exact_dedup.exact_dedup(spark.createDataFrame([(3, "a"), (None, "a"), (1, "a"), (1, "a"), (None, "b")], "doc_id long, text string"), keep="smallest")
    assert sorted((r.doc_id or -1, r.keep_id or -1, r.group_size, r.kept) for r in small.collect()) == [(-1, -1, 1, True), (-1, 1, 4, False), (1, 1, 4, True), (1, 1, 4, True), (3, 1, 4, False)]


def test_quality_counts(docs, nothing):
    want = []
    for i, t in pairs():
        t = t or ""
        w = t.encode().split()
        windows = [tuple(w[k : k + 5]) for k in range(len(w) - 4)]
        often = Counter(windows)
        covered = {k + j for k, x in enumerate(windows) if often[x] > 1 for j in range(5)}
        lines = [x for x in t.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
        n = len(covered)
        want.append((i, len(w), sum(len(x.decode()) for x in w), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), n, len(w) < 10 or 100 * n > 20 * len(w)))
    got = quality_rules.quality_rules(docs)
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    assert rows(got, *columns) == sorted(want)
    assert got.where("base_failed and kept").count() == 0
    assert quality_rules.quality_rules(nothing).count() == 0


def test_quality_thresholds_adapt(spark):
    rng = random.Random(4)
    good = [(i, words(rng, 40), "en", "a") for i in range(80)]
    bad = [(100 + i, " ".join(w + "###" for w in words(rng, 40).split()), "en", "a") for i in range(3)]
    got = {r.doc_id: r.kept for r in quality_rules.quality_rules(spark.createDataFrame(good + bad, "doc_id long, text string, lang string, source string")).collect()}
    assert all(got[i] for i, *_ in good) and not any(got[i] for i, *_ in bad)


def test_url_rules(spark, nothing):
    urls = ["http://M.Example.org/es/1", "https://x.example.org/en/12", "http://a.org", "http://a.org/", "https://sub.foo.com/de/3?x=1", "foo.com/de/", None, "http://notexample.org/es/", "HTTP://u@b.com:80/fr/#t", "x://y://org/", ""]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.url_filter(pages, labels).collect()}
    assert got[0] == ("m.example.org", "/es/1", "example.org/es/", "block")
    assert got[1] == ("x.example.org", "/en/12", "example.org/en/1", "block")
    assert got[2] == ("a.org", "", None, "allow") and got[3] == ("a.org", "/", "org/", "allow")
    assert got[4] == ("sub.foo.com", "/de/3", "com/de/", "block") and got[5] == ("", "", None, "allow") and got[6] == ("", "", None, "allow")
    assert got[7] == ("notexample.org", "/es/", "org/", "allow") and got[8][:3] == ("u@b.com:80", "/fr/", None)
    assert got[9] == ("y:", "//org/", None, "allow") and got[10] == ("", "", None, "allow")


def url_table(spark):
    rows_ = []
    for i in range(400):
        host, path = ("spam.net", "/win/") if i % 4 == 0 else ("good.net", "/win/") if i % 4 == 1 else ("spam.net", "/news/") if i % 4 == 2 else ("good.net", "/news/")
        rows_.append((i, f"http://{host}{path}{i}", 0 if i % 4 == 0 else 1))
    return spark.createDataFrame(rows_, "page_id long, url string, quality int")


def test_mined_url_rules(spark):
    df = url_table(spark)
    labels = df.select(F.col("page_id").alias("doc_id"), "quality", F.lit(None).cast("int").alias("toxic"))
    got = url_filter.url_filter(df.select("page_id", "url"), labels, fixed=())
    assert {(r.page_id % 4 == 0, r.verdict) for r in got.collect()} == {(True, "block"), (False, "allow")}
    assert {r.mined_rule for r in got.where("verdict = 'block'").collect()} == {"h:spam.net p:win"}
    few = labels.where("doc_id < 76")  # 19 bad pages: one too few for a rule
    assert not url_filter.url_filter(df, few, fixed=()).where("verdict = 'block'").count()
    assert url_filter.url_filter(df, labels.where("doc_id < 80"), fixed=()).where("verdict = 'block'").count() == 100


def test_url_rules_of_four_tokens(spark):
    """Only all four words together go with bad pages; any three occur as often on good ones."""
    paths = ["a/b/c/d"] * 40 + [p for p in ("a/b/c", "a/b/d", "a/c/d", "b/c/d") for _ in range(40)]
    pages = [(i, f"http://h{i}.net/{p}") for i, p in enumerate(paths)]
    labels = [(i, 0 if i < 40 else 1, 0) for i in range(len(paths))]
    df, lab = spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = url_filter.url_filter(df, lab)
    assert rows(got, "page_id", "host", "path", "rule", "verdict") == sorted(brute_url_rules(pages, labels))
    assert {r.mined_rule for r in got.where("verdict = 'block'").collect()} == {"p:a p:b p:c p:d"} and got.where("verdict = 'block'").count() == 40
    assert not url_filter.url_filter(df, lab, most_tokens=3).where("verdict = 'block'").count()


def brute_url_rules(pages, labels):
    """Verdict per (page_id, url): every combination of tokens is counted."""
    import re
    from itertools import combinations

    def parts(url):
        m = re.match(r"(?s:.*?)://([^/?#]*)([^?#]*)(?:\?([^#]*))?", url or "")
        return (m[1].lower(), m[2], m[3] or "") if m else ("", "", "")

    def tokens(url):
        host, path, query = parts(url)
        if not host:
            return frozenset()
        labels_ = host.split(".")
        out = {"h:" + ".".join(labels_[i:]) for i in range(max(len(labels_) - 1, 1))}
        out |= {"p:" + x for x in re.sub(r"\.[A-Za-z0-9]*\Z", "", path).split("/") if x and not re.fullmatch("[0-9]+", x)}
        out |= {"q:" + x.split("=")[0] for x in query.split("&") if x}
        end = re.search(r"\.([A-Za-z0-9]+)\Z", path)
        return frozenset(out | ({"e:" + end[1]} if end else set()))

    baskets = [(tokens(u), q == 0 or t == 1) for p, u in pages for d, q, t in labels if p == d and tokens(u)]
    n, k = {}, {}
    often = {x for x in set().union(*(own for own, _ in baskets)) if sum(x in own and bad for own, bad in baskets) >= 20}
    for own, bad in baskets:
        for size in range(1, len(own & often) + 1):
            for c in combinations(sorted(own & often), size):
                n[c], k[c] = n.get(c, 0) + 1, k.get(c, 0) + bad
    base = sum(bad for _, bad in baskets) / max(len(baskets), 1)
    rules = {}
    for c in n:
        p, z = k[c] / n[c], url_filter.Z
        low = (p + z * z / (2 * n[c]) - z * (p * (1 - p) / n[c] + z * z / (4 * n[c] ** 2)) ** 0.5) / (1 + z * z / n[c])
        if k[c] >= max(20, 0.002 * len(baskets)) and low >= 0.6 and p / base >= 1.5:
            rules[c] = p
    out = []
    for p, u in pages:
        host, path, _ = parts(u)
        rule = max((r for r in url_filter.FIXED_RULES if (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])), key=lambda r: (len(r[0] + r[1]), len(r[0])), default=None)
        hit = any(set(c) <= tokens(u) for c in rules)
        out.append((p, host, path, rule and rule[0] + rule[1], rule[2] if rule else "block" if hit else "allow"))
    return sorted(out, key=str)


def test_url_rules_against_brute_force_and_sql(spark):
    import duckdb

    rng = random.Random(17)
    pages = []
    for i in range(900):
        host = rng.choice(["Spam.net", "a.spam.net", "good.net", "en.example.org", "b.com", "x.org"])
        path = rng.choice(["/win/", "/news/", "/fr/", "/de/", "/en/1", "/es/", ""]) + rng.choice(["", "7", "a.html", "b.php"])
        pages.append((i, f"https://{host}{path}" + rng.choice(["", "?q=1&ref=2", "#x"])))
    pages += [(900, None), (901, "no host"), (3, pages[3][1]), (None, "http://good.net/win/"), (902, "http://" + "long." * 500 + "net/" + "deep/" * 500)]
    label = lambda u: int("pam.net" in u and "/win/" in u and rng.random() < 0.97)
    labels = [(p, 1 - label(u), rng.choice([0, 0, 0, 0, None])) for p, u in pages if p is not None and u and p % 3] + [(5, None, None), (6, 1, 0), (6, 1, 0)]
    df = spark.createDataFrame(pages, "page_id long, url string").withColumn("quality", F.lit("x")).withColumn("rule", F.lit(1)).withColumn("host", F.lit("h"))
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("page_id", F.lit("y"))
    want = brute_url_rules(pages, labels)
    assert {r[4] for r in want if r[3] is None} == {"block", "allow"}
    got = url_filter.url_filter(df, lab)
    assert sorted((tuple(r) for r in got.select("page_id", "host", "path", "rule", "verdict").collect()), key=str) == want
    con = duckdb.connect()
    con.register("pages", df.select("page_id", "url").toPandas())
    con.execute("CREATE TABLE labels (doc_id BIGINT, quality INT, toxic INT)")
    con.executemany("INSERT INTO labels VALUES (?, ?, ?)", labels)
    con.execute("CREATE TABLE p2 AS SELECT CAST(page_id AS BIGINT) AS page_id, url FROM pages")
    sql = con.sql(url_filter.url_sql("p2")).project("page_id, host, path, rule, verdict, mined_rule").fetchall()
    assert sorted(map(str, sql)) == sorted(str(tuple(r)) for r in got.select("page_id", "host", "path", "rule", "verdict", "mined_rule").collect())
    assert url_filter.url_filter(df.limit(0), lab).count() == 0


def test_packing(docs, nothing):
    from tokenizers import Tokenizer

    path = packing.default_tokenizer()
    tokenizer = Tokenizer.from_file(path)
    got = packing.best_fit_packing(docs, path, capacity=256).toPandas()
    import zlib

    import numpy as np

    for i, t in pairs():
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0], dtype="<u4")
        own = got[got.doc_id == i].sort_values("piece")
        assert own.length.sum() == len(ids) and list(own.start) == [0, *own.length.cumsum()[:-1]]
        assert all(zlib.crc32(ids[s : s + n].tobytes()) == c for s, n, c in zip(own.start, own.length, own.ids_crc32, strict=True))
        assert (own.length.iloc[1:] == 256).all() and own.length.iloc[0] <= 256
    ordered = got.sort_values(["sequence_id", "offset"])
    assert (ordered.groupby("sequence_id").length.cumsum() - ordered.length == ordered.offset).all()
    assert got.groupby("sequence_id").length.sum().max() <= 256
    assert got.sequence_id.nunique() <= -(-got.length.sum() // 256) + 1
    assert packing.best_fit_packing(nothing, path).count() == 0


def test_packing_plans_hold_every_piece():
    rng = random.Random(6)
    for _ in range(60):
        histogram = {rng.randint(1, 128): rng.randint(1, 40) for _ in range(rng.randint(1, 30))}
        used, seen = {}, set()
        for length, a, b, first, offset in packing.plan_packing(histogram, 128):
            for k in range(a, b):
                assert (length, k) not in seen
                seen.add((length, k))
                used.setdefault(first + k - a, []).append((offset, length))
        assert len(seen) == sum(histogram.values())
        for places in used.values():
            at = 0
            for offset, length in sorted(places):
                assert offset == at
                at += length
            assert at <= 128


def test_token_counts(docs, nothing):
    import public_tokenizers
    import sentencepiece
    from tokenizers import Tokenizer, models

    path = public_tokenizers.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    model = Tokenizer(models.Unigram([(sp.id_to_piece(i), sp.get_score(i)) for i in range(sp.vocab_size())], unk_id=0, byte_fallback=True))
    want = sorted((i, len(model.encode((" " + t).replace(" ", "▁")).ids) if t else 0) for i, t in pairs())
    assert rows(token_counts.token_counts(docs, path), "doc_id", "n_tokens") == want
    assert token_counts.token_counts(nothing, path).count() == 0


def test_long_chunks_are_counted_and_not_remembered():
    own = token_counts.UnigramCounter([("<unk>", 0.0), ("a", -1.0), ("aa", -1.5), ("▁", -1.0)])
    assert own.count("a" * 1001) == 502 and not own
    assert own.count("aaa") == 3 and len(own) == 1


def test_ids_of_a_whole_table(spark):
    import zlib

    import numpy as np
    from tokenizers import Tokenizer

    path = packing.default_tokenizer()
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    tokenizer = Tokenizer.from_file(path)
    ids = {r.doc_id: np.array([*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 0], dtype="<u4") for r in docs.select("doc_id", "text").collect()}
    got = packing.best_fit_packing(docs, path).collect()
    assert sum(r["length"] for r in got) == sum(map(len, ids.values()))
    assert all(zlib.crc32(ids[r["doc_id"]][r["start"] : r["start"] + r["length"]].tobytes()) == r["ids_crc32"] for r in got)
    assert len({r["sequence_id"] for r in got}) <= -(-sum(map(len, ids.values())) // packing.CAPACITY) + 1


def test_quality_cut_offs_are_no_fixed_numbers(spark):
    """Cut-offs of the measures that vary at all differ between groups, and are not at their floors."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    features = common.cut(quality_rules.quality_features(docs, "doc_id", "text", "lang", "source"))
    limits = quality_rules.thresholds(quality_rules.sketches(features), 10).toPandas()
    for name, floor in (("symbols", 100), ("dup_lines", 500), ("repeats", 200), ("word_len", 0)):
        assert (limits[f"{name}_max"] > floor).mean() > 0.9 and limits[f"{name}_max"].nunique() > 1, name


def symbol_docs(spark, groups):
    """Documents of 20 words of nine characters; groups: per source, the number of symbols of each document."""
    word = lambda i, j, k: f"{chr(97 + j)}{chr(97 + i % 26)}{chr(97 + i // 26)}{'#' * k}{'wxyzuv'[k:]}"
    rows_ = [(1000 * g + i, " ".join(word(i, j, n // 20 + (j < n % 20)) for j in range(20)), "en", s) for g, (s, each) in enumerate(groups.items()) for i, n in enumerate(each)]
    return spark.createDataFrame(rows_, "doc_id long, text string, lang string, source string")


def test_symbols_are_split_by_the_sketch(spark):
    import duckdb

    groups = {
        "few": [0] * 180 + [60] * 20,  # zero but for junk: the split lies between
        "code": [5 + i % 20 for i in range(200)],  # symbols throughout, one class: nothing goes
        "half": [0] * 100 + [30] * 100,  # two classes, but the upper one is no tail
        "some": [i % 3 for i in range(180)] + [80] * 20,  # clean documents with a few symbols stay
        "clean": [0] * 200,
        "thin": [0] * 20 + [60] * 2,  # too few: the language's sketch, where half of the upper class is code
    }
    docs = symbol_docs(spark, groups)
    got = {r.doc_id: r.kept for r in quality_rules.quality_rules(docs).collect()}
    kept = {s: [got[1000 * k + i] for i in range(len(each))] for k, (s, each) in enumerate(groups.items())}
    assert kept["few"] == [True] * 180 + [False] * 20 and kept["some"] == [True] * 180 + [False] * 20
    assert all(kept["code"]) and all(kept["half"]) and all(kept["clean"])
    con = duckdb.connect()
    con.register("documents", docs.toPandas())
    assert got == {r[0]: r[7] for r in con.sql(f"SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept FROM ({quality_rules.quality_sql()})").fetchall()}
    limits = quality_rules.thresholds(quality_rules.sketches(quality_rules.quality_features(docs, "doc_id", "text", "lang", "source")), 100).toPandas().set_index("_source")
    assert 100 < limits.symbols_max["few"] < 3000 and limits.symbols_max["clean"] == 100


def test_unigram_ties_and_unknowns():
    pieces = [("a", -1.0), ("b", -1.0), ("ab", -2.0), ("▁", -1.0)]
    from tokenizers import Tokenizer, models

    model = Tokenizer(models.Unigram([("<unk>", 0.0), *pieces], unk_id=0, byte_fallback=False))
    own = token_counts.UnigramCounter([("<unk>", 0.0), *pieces], byte_fallback=False)
    for text in ("ab", "abab", "axxb", "xx", "aabbx", "ba"):
        assert own.best(text)[1] == len(model.encode(text).ids), text


def test_html_text(spark, nothing):
    page = """<html><head><title>T</title><style>p{}</style></head><body><header><a href=x>Home</a></header><nav><ul><li>Menu</li></ul></nav>
    <div class="cookie-notice">We use cookies</div><article><h1>The&nbsp;Title</h1><p>First   para &amp; more<br>line<p>Second <b>bold</b> one.</p><p>x</p>
    <aside>Side</aside><div class="ad">Buy</div><form><input>Sign</form><script>var t="</p>";</script></article>
    <section class="comments"><article class="comment"><p>A reader says a lot of words here, more than the article itself has, again and again.</p></article></section><footer>&copy; F</footer></body></html>"""
    rows_ = [(1, "u", page), (2, None, None), (3, "v", ""), (4, "w", "plain text only"), (None, "z", "<p>open <b>tags"), (1, "u", page)]
    df = spark.createDataFrame(rows_, "page_id long, url string, html string")
    got = [(r.page_id, r.text, r.n_chars) for r in html_text.html_text(df).collect()]
    text = "The Title\n\nFirst para & more line\n\nSecond bold one.\n\nx"
    assert sorted(got, key=str) == sorted([(1, text, len(text)), (1, text, len(text)), (2, "", 0), (3, "", 0), (4, "plain text only", 15), (None, "open tags", 9)], key=str)


def test_html_without_article():
    body = "".join(f"<p>{'Many words of real content stand in this block. ' * 6}{i}</p>" for i in range(4))
    page = f"<body><ul><li><a href=a>One</a></li><li><a href=b>Two</a></li></ul><div>{body}<p>Short.</p>{body}</div><div><a href=c>Three</a></div></body>"
    text = html_text.main_text(page)
    assert "Short." in text and text.count("\n\n") == 8 and "One" not in text and "Three" not in text


def test_html_uneven_blocks_stay_whole():
    def page(sizes):
        return "<body><div>" + "".join(f"<p>{chr(97 + i) * n}</p>" for i, n in enumerate(sizes)) + "</div></body>"

    for sizes in ([250, 300, 280, 320, 900, 310, 290, 270, 260], [300] * 5 + [6000] + [300] * 5, [20, 300, 320, 310, 300, 330, 15]):
        assert html_text.main_text(page(sizes)).split("\n\n") == [chr(97 + i) * n for i, n in enumerate(sizes)]
    menu = "<ul>" + "".join(f"<li><a href={i}>Link</a></li>" for i in range(8)) + "</ul>"
    text = html_text.main_text(f"<body>{menu}<div><h2>Heading</h2>{'<p>' + 'word ' * 60 + '</p>'}<p>End.</p></div>{menu}</body>")
    assert text.startswith("Heading") and text.endswith("End.") and "Link" not in text


def test_html_keeps_each_marked_article():
    articles = [("word " * n).strip() for n in (200, 40, 90)]
    body = "".join(f"<article><p>{a}</p></article>" for a in articles)
    assert html_text.main_text(f"<body>{body}</body>").split("\n\n") == articles


def plain_article(html):
    """The blocks between <article> tags, by patterns alone."""
    import html as entities
    import re

    inner = re.search(r"<article\b[^>]*>(.*)</article>", html, re.S)[1]
    inner = re.sub(r"<!--.*?-->|<(script|style|aside|form|nav|footer)\b.*?</\1>|<div class=\"[^\"]*\b(?:ad|comments?|share|related)\b.*?</div>", "", inner, flags=re.S)
    inner = re.sub(r"</?(?:a|b|i|em|strong|span|code|u|sup|sub|small)\b[^>]*>", "", inner)
    blocks = [" ".join(entities.unescape(x).split()) for x in re.split(r"<(?!br)[^>]*>", inner.replace("<br>", " ").replace("<br/>", " "))]
    return "\n\n".join(x for x in blocks if x)


def test_html_of_a_whole_table_with_and_without_marks(spark):
    import re

    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("page_id", "url", "html")
    want = {r.page_id: plain_article(r.html) for r in pages.collect()}
    extra = pages.withColumn("text", F.lit("x")).withColumn("id", F.lit(1))
    assert {r.page_id: r.text for r in html_text.html_text(extra).collect()} == want
    bare = [(r.page_id, html_text.main_text(re.sub(r"<(/?)article\b", r"<\1div", r.html))) for r in pages.collect()]
    assert dict(bare) == want
    assert html_text.html_text(pages.limit(0)).count() == 0


def test_html_marks_count_only_where_the_clusters_agree():
    teasers = "".join(f"<article><a href={i}>Read</a></article>" for i in range(6))
    body = "".join(f"<p>{'Many words of real content stand in this block. ' * 6}{i}</p>" for i in range(4))
    text = html_text.main_text(f"<body>{teasers}<div>{body}</div></body>")
    assert text.count("\n\n") == 3 and "Read" not in text
    long = html_text.main_text(f"<body><article>{'<p>' + 'word ' * 40000 + '</p>'}{body}</article></body>")
    assert long.count("\n\n") == 4


def test_mixing(docs, nothing):
    topics = F.when(F.col("doc_id") % 2 == 0, "even").otherwise("odd")
    got = mixing.mix_sources(docs, topic=topics, targets={"lang": {"en": 0.6, "de": 0.4}}).toPandas()
    assert len(got) == len(corpus())
    total = (got.tokens * got.weight).sum()
    share = got.assign(w=got.tokens * got.weight).groupby("lang", dropna=False).w.sum() / total
    assert abs(share["en"] - 0.6) < 0.02 and abs(share["de"] - 0.4) < 0.02
    assert not got[got.lang.isna()].kept.any()
    assert got.probability.between(0, 1).all()
    assert mixing.mix_sources(nothing).count() == 0


def plain_raking(cells, targets, budget, sweeps=200):
    """Probability per cell, by one margin after the other."""
    margins = range(len(next(iter(cells))))
    total = sum(cells.values())
    p = dict.fromkeys(cells, budget)
    for _ in range(sweeps):
        for m in margins:
            for v in {c[m] for c in cells}:
                now = sum(n * p[c] for c, n in cells.items() if c[m] == v)
                for c in cells:
                    if c[m] == v:
                        p[c] *= targets[m][v] * total * budget / now
    return p


def test_raking_against_a_plain_version(spark, monkeypatch):
    rng = random.Random(31)
    data = [(i, words(rng, rng.randrange(5, 40)), rng.choice(["en", "de", "fr"]), rng.choice(["a", "b"]), rng.choice(["x", "y", "z"])) for i in range(1500)]
    df = spark.createDataFrame(data, "doc_id long, text string, lang string, source string, subject string")
    targets = {"source": {"a": 0.4, "b": 0.6}, "lang": {"en": 0.5, "de": 0.3, "fr": 0.2}, "topic": {"x": 0.2, "y": 0.35, "z": 0.45}}
    cells = {}
    for _, t, lang, source, subject in data:
        cells[source, lang, subject] = cells.get((source, lang, subject), 0) + len(t.split())
    want = plain_raking(cells, [targets[m] for m in mixing.MARGINS], 0.3)
    for most in (mixing.DRIVER_CELLS, 0):
        monkeypatch.setattr(mixing, "DRIVER_CELLS", most)
        got = mixing.mix_sources(df, topic=F.col("subject"), targets=targets, budget=0.3).toPandas()
        for r in got.itertuples():
            assert abs(r.probability - want[r.source, r.lang, r.topic]) < 1e-3
        expected = got.tokens * got.probability
        for m in mixing.MARGINS:
            share = expected.groupby(got[m]).sum() / expected.sum()
            assert all(abs(share[v] - x) < 1e-3 for v, x in targets[m].items())
        kept = got[got.kept]
        for m in mixing.MARGINS:
            share = kept.groupby(m).tokens.sum() / kept.tokens.sum()
            assert all(abs(share[v] - x) < 0.06 for v, x in targets[m].items())


def test_raking_is_the_same_in_the_driver_and_as_a_table(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").repartition(2).cache()
    both = []
    for most in (mixing.DRIVER_CELLS, 0):
        monkeypatch.setattr(mixing, "DRIVER_CELLS", most)
        both.append(sorted((r.doc_id, r.topic, r.tokens, round(r.probability, 6), round(r.weight, 6)) for r in mixing.mix_sources(docs).collect()))
    assert both[0] == both[1]


def test_tokens_and_topics_in_sql(spark):
    import duckdb

    path = "/root/testdata/sf0.001/documents.parquet"
    sql = f"""SELECT doc_id, len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) AS tokens, CASE
        WHEN {mixing.BAR_EACH} * (length(text) - length(replace(text, '|', ''))) > length(text) THEN 'table'
        WHEN length(text) < {mixing.LIST_LINE} * len(string_split(text, chr(10))) THEN 'list' WHEN length(text) > {mixing.LONG_TEXT} THEN 'long' ELSE 'prose' END AS topic
        FROM (SELECT doc_id, coalesce(text, '') AS text FROM '{path}')"""
    got = mixing.mix_sources(spark.read.parquet(path).withColumn("topic", F.lit("clash")).withColumn("tokens", F.lit(0)))
    assert rows(got, "doc_id", "tokens", "topic") == sorted(duckdb.sql(sql).fetchall())


def test_calibrated_budget(spark):
    rng = random.Random(8)
    df = spark.createDataFrame([(i, words(rng, 20), "en" if i % 5 else "de", f"s{i % 3}") for i in range(2000)], "doc_id long, text string, lang string, source string")
    got = mixing.mix_sources(df, budget=0.5)
    expected, sampled, everything = got.agg(F.sum(F.col("tokens") * F.col("probability")), F.sum(F.when(F.col("kept"), F.col("tokens"))), F.sum("tokens")).first()
    assert abs(expected / everything - 0.5) < 0.01 and abs(sampled / everything - 0.5) < 0.05


def test_sampled_tokens_have_the_target_weights(spark):
    rng = random.Random(12)
    lang = lambda i: "en" if i % 20 else "de"
    df = spark.createDataFrame([(i, words(rng, 20), lang(i), "ab"[i % 3 == 0]) for i in range(6000)], "doc_id long, text string, lang string, source string")
    got = mixing.mix_sources(df, targets={"lang": {"en": 0.8, "de": 0.2}}, budget=0.8).toPandas()
    kept = got[got.kept]
    share = kept.groupby("lang").tokens.sum() / kept.tokens.sum()
    assert abs(share["de"] - 0.2) < 0.02
    expected = (got.tokens * got.probability).groupby(got.lang).sum()
    assert abs(expected["de"] / expected.sum() - 0.2) < 0.001
    assert 0.24 < expected.sum() / got.tokens.sum() <= 0.25


def test_targets_out_of_reach_are_named(spark):
    rng = random.Random(13)
    df = spark.createDataFrame([(i, words(rng, 20), "en" if i % 2 else "de", "a" if i % 2 else "b") for i in range(40)], "doc_id long, text string, lang string, source string")
    with pytest.warns(UserWarning, match="out of reach"):
        mixing.mix_sources(df, targets={"lang": {"en": 0.9, "de": 0.1}, "source": {"a": 0.5, "b": 0.5}})


def test_pipeline(spark, docs, nothing, tmp_path):
    import corpus_pipeline

    plain = docs.select("doc_id", "text", "lang", "source", "n_chars")
    plain.write.parquet(f"{tmp_path}/documents.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).toPandas()
    quality = {r.doc_id for r in quality_rules.quality_rules(plain).where("kept").collect()}
    left = [(i, t) for i, t in pairs() if i in quality]
    best = {}
    for i, t in left:
        best[t or ""] = max(i, best.get(t or "", -1))
    left = [(i, t) for i, t in left if best[t or ""] == i]
    left = [r for r in left if r[0] in {x[0] for x in brute.near(left) if x[3]}]
    assert set(got.doc_id) <= {i for i, _ in left} and len(got)
    ordered = got.sort_values(["sequence_id", "offset"])
    assert (ordered.groupby("sequence_id").length.cumsum() - ordered.length == ordered.offset).all()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, nothing.select("doc_id", "text", "lang", "source", "n_chars"), str(tmp_path)).columns == plain.columns, name


def test_pipeline_against_plain_stages(spark, tmp_path):
    """Each stage's rows equal a plain version's, which works on what the plain stages before it left."""
    import zlib

    import corpus_pipeline
    import duckdb
    import numpy as np
    from tokenizers import Tokenizer

    columns = ["doc_id", "text", "lang", "source"]
    given = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select(*columns).collect()]
    given += [(10**6 + r[0], *r[1:4]) for r in corpus()] + [(2 * 10**6 + r[0], *r[1:]) for r in given[:5]]
    spark.createDataFrame(given, "doc_id long, text string, lang string, source string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    docs, left = spark.read.parquet(f"{tmp_path}/documents.parquet"), {r[0]: r for r in given}
    stages = dict(corpus_pipeline.STAGES)

    def after(name):
        out = common.cut(stages[name](spark, docs, str(tmp_path)), "stage")
        assert sorted(map(tuple, out.collect())) == [left[i] for i in sorted(left)], name
        return out

    kept = duckdb.sql(f"SELECT doc_id FROM ({quality_rules.quality_sql(f"'{tmp_path}/documents.parquet/*.parquet'")}) WHERE kept").fetchall()
    left = {i: left[i] for (i,) in kept}
    docs = after("quality_rules")
    largest = {r[1]: i for i, r in sorted(left.items())}
    left = {i: left[i] for i in largest.values()}
    docs = after("exact_dedup")
    left = {r[0]: left[r[0]] for r in brute.near([(i, r[1]) for i, r in left.items()]) if r[3]}
    docs = after("minhash_near_dedup")

    def topic(t):
        if mixing.BAR_EACH * t.count("|") > len(t):
            return "table"
        return "list" if len(t) < mixing.LIST_LINE * (t.count("\n") + 1) else "long" if len(t) > mixing.LONG_TEXT else "prose"

    cell = {i: (r[3], r[2], topic(r[1])) for i, r in left.items()}
    tokens = Counter()
    for i, r in left.items():
        tokens[cell[i]] += len(r[1].encode().split())
    p = brute.mixed(tokens, mixing.TEMPER, mixing.MOST_USED, mixing.BUDGET, mixing.TRIES, mixing.SWEEPS, mixing.TOLERANCE, mixing.REACHED)
    assert all(abs(brute.draw(i, mixing.SEED) - p[c]) > 1e-6 for i, c in cell.items())
    many = len(left)
    left = {i: r for i, r in left.items() if brute.draw(i, mixing.SEED) < p[cell[i]]}
    assert 0 < len(left) < many
    docs = after("mix_sources")
    tokenizer = Tokenizer.from_file(packing.default_tokenizer())
    tokenizer.encode_special_tokens = True
    ids = {i: np.array([*tokenizer.encode(r[1], add_special_tokens=False).ids, 0], dtype="<u4") for i, r in left.items()}
    want = []
    for i, x in ids.items():
        cuts = [0, *range(len(x) % packing.CAPACITY or packing.CAPACITY, len(x) + 1, packing.CAPACITY)]
        cuts = cuts if len(x) > packing.CAPACITY else [0, len(x)]
        want += [(i, k, a, b - a, zlib.crc32(x[a:b].tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
    got = common.cut(corpus_pipeline.run(spark, str(tmp_path)), "packed")
    assert rows(got, "doc_id", "piece", "start", "length", "ids_crc32") == sorted(want)
    placed = got.toPandas().sort_values(["sequence_id", "offset"])
    assert (placed.groupby("sequence_id").length.cumsum() - placed.length == placed.offset).all()
    assert placed.groupby("sequence_id").length.sum().max() <= packing.CAPACITY
    assert placed.sequence_id.nunique() <= -(-sum(map(len, ids.values())) // packing.CAPACITY) + 1


def test_stages_decide_about_rows(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(40)
    clean, other, junk = words(rng, 60), words(rng, 60), "bad bad"
    data = [(None, clean), (None, junk), (7, other), (7, junk), (8, other), (8, other), (8, other + " end"), (None, other), (9, words(rng, 50)), (9, words(rng, 55))]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t), "x") for i, t in data], "doc_id long, text string, lang string, source string, n_chars long, _m string")
    docs.repartition(2).write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    key = lambda r: (r.doc_id if r.doc_id is not None else -1, r.text)
    left = corpus_pipeline.quality(spark, docs, "")
    assert sorted(map(key, left.collect())) == sorted((-1 if i is None else i, t) for i, t in data if t != junk) and left.columns == docs.columns
    left = corpus_pipeline.exact(spark, left, "")
    assert sorted(map(key, left.collect())) == sorted([(-1, clean), (8, other), (8, other + " end"), *((9, t) for i, t in data if i == 9)])
    left = corpus_pipeline.near(spark, left, "")
    kept = sorted(map(key, left.collect()))
    assert len(kept) == 4 and (-1, clean) in kept and sum(k == 8 for k, _ in kept) == 1 and sum(k == 9 for k, _ in kept) == 2
    both = docs.where("doc_id is null").unionByName(docs.where("doc_id = 7"))  # the null id does not win
    assert {r.doc_id for r in corpus_pipeline.near(spark, both.where(F.col("text") == other), "").collect()} == {7}
    assert set(map(key, corpus_pipeline.mixed(spark, left, "").collect())) <= set(kept)


def test_stages_with_clashing_columns(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(43)
    data = [(i, words(rng, 40 + i), "en", "s", 1, 0, 1, 2, "m") for i in range(4)] + [(9, "bad bad", "en", "s", 1, 0, 1, 2, "m")]
    columns = "doc_id long, text string, lang string, source string, n_chars long, _file int, _row int, _KEY int, _metadata string"
    spark.createDataFrame(data, columns).write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        left = stage(spark, docs, "")
        assert left.columns == docs.columns and set(map(tuple, left.collect())) <= set(data)
    assert sorted(map(tuple, corpus_pipeline.quality(spark, docs, "").collect())) == data[:4]
    assert corpus_pipeline.run(spark, str(tmp_path)).count()


def thue_morse(n):
    return "".join("ab"[i.bit_count() % 2] for i in range(n))


def test_long_words_that_polynomials_confuse(spark):
    one = thue_morse(2048)
    other = one.translate(str.maketrans("ab", "ba"))
    long = [f"{' '.join(f'w{i}' for i in range(17))} {w} {' '.join(f'v{i}' for i in range(17))}" for w in (one, other)]
    docs = spark.createDataFrame([(1, long[0]), (2, long[1])], "doc_id long, text string")
    got = substring_dedup.count_min_dedup(docs)
    assert rows(got, "doc_id", "n_removed") == [(1, 0), (2, 0)]
    assert rows(suffix_dedup.suffix_dedup(docs), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == brute.substring([(1, long[0]), (2, long[1])], suffix_dedup.WINDOW, False)
    words_ = spark.createDataFrame([(1, one), (2, other), (3, one)], "doc_id long, text string")
    assert rows(near_dedup.near_dedup(words_), "doc_id", "component_id", "kept") == [(1, 1, True), (2, 2, True), (3, 1, False)]


def test_html_of_any_bytes():
    rng = random.Random(1)
    parts = ["<", "</", ">", "<![", "]]>", "<!--", "-->", "<!", "<?", "&#x", "&", "div", "p", "article", " class='share'", "script", "style", "title", "text ", "=", "'", '"', "\x00", "é", "]", "[", "/", "svg", "<![CDATA[", "<![1]>", "<![foo["]
    for _ in range(10_000):
        html_text.main_text("".join(rng.choice(parts) for _ in range(rng.randrange(1, 60))))
    assert html_text.main_text("<p>before<![1]> and after</p><![foo[") == "before and after"


@pytest.mark.parametrize("page", ["<div>" * 20_000 + "x" + "</section>" * 20_000, "<b>" * 20_000 + "<div>y</div>" * 20_000, "<i><div>" + "<b>" * 20_000 + "</i>z" * 20_000, "<a " * 20_000, "<!--" * 20_000, "<div>" * 20_000 + "x"])
def test_html_deep_nesting_is_linear(page):
    import time

    start = time.thread_time()
    html_text.main_text(page)
    assert time.thread_time() - start < 5


def test_html_topics_in_class_words_and_short_sections():
    long = "<p>" + "true text here " * 30 + "</p>"
    for mark in ('class="share-price"', 'class="related-work"', 'id="search-results"'):
        text = html_text.main_text(f"<body><nav><a href=x>menu</a></nav><article {mark}>{long}<p>End.</p></article><footer>foot</footer></body>")
        assert text.startswith("true text") and text.endswith("End.")
    menu = "<div><a href=x>One</a><a href=y>Two</a></div>"
    text = html_text.main_text(f"<body>{menu}<div>{long}</div><div><p>Short one.</p></div><div>{long}</div>{menu}</body>")
    assert text.count("\n\n") == 2 and "Short one." in text and "Two" not in text


def test_packing_of_repeated_rows_and_clashing_columns(spark):
    text = words(random.Random(41), 30)
    df = spark.createDataFrame([(1, text), (1, text), (None, text), (2, "other")], "doc_id long, text string").withColumn("piece", F.lit("p")).withColumn("length", F.lit(1)).withColumn("id", F.lit(2))
    got = packing.best_fit_packing(df, packing.default_tokenizer(), capacity=64).toPandas()
    assert len(got[got.doc_id.isna()]) >= 1 and len(got[got.doc_id == 1]) == 2 * len(got[got.doc_id.isna()])
    assert got.groupby("sequence_id").length.sum().max() <= 64
    ordered = got.sort_values(["sequence_id", "offset"])
    assert (ordered.groupby("sequence_id").length.cumsum() - ordered.length == ordered.offset).all()


def test_packing_ranks_are_dealt(spark, monkeypatch):
    monkeypatch.setattr(packing, "RANK_PARTS", 1)
    monkeypatch.setattr(packing, "RANK_ROWS", 8)
    assert (packing.rank_parts(0), packing.rank_parts(8), packing.rank_parts(9), packing.rank_parts(300)) == (1, 1, 2, 38)
    df = spark.createDataFrame([(None, "one text in many rows")] * 200 + [(i, "short") for i in range(100)], "doc_id long, text string")
    pieces = common.cut(packing.token_pieces(df, "doc_id", "text", packing.default_tokenizer(), 16), "pieces")
    got = packing.ranked(pieces, packing.rank_parts(300)).toPandas()
    for _, own in got.groupby("length"):
        assert sorted(own["rank"]) == list(range(len(own))) and own.groupby("_part").size().max() <= len(own) / 4
    packed = packing.best_fit_packing(df, packing.default_tokenizer(), capacity=16).sort("sequence_id", "offset").toPandas()
    assert len(packed) == 300 and (packed.groupby("sequence_id").length.cumsum() - packed.length == packed.offset).all() and packed.groupby("sequence_id").length.sum().max() <= 16
