"""Evidence, checked answers and transported coverage on small inputs, against plain versions."""

from __future__ import annotations

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from hindcast.operators import evidence as E
from hindcast.operators import transport as T

ITEMS = [(1, "Alpha beta 12.5 gamma."), (2, "alpha, delta 7"), (3, "alpha alpha epsilon"), (4, "alpha zeta"), (None, "rare words"), (5, None), (6, ""), (7, "delta theta")]
ASKED = [("a", "Is DELTA gamma."), ("b", "alpha"), ("c", None), ("d", ""), ("e", "beta, zeta. delta beta"), ("f", "rare words")]


def plain_words(text):
    return set(re.findall(r"[^\s.,]+", (text or "").lower()))


def plain_found(most, top):
    held = {}
    for item, text in ITEMS:
        for w in plain_words(text) if item is not None else ():
            held.setdefault(w, set()).add(item)
    out = {}
    for key, text in ASKED:
        score, shared = {}, {}
        for w in plain_words(text):
            for i in held[w] if w in held and len(held[w]) <= most else ():
                score[i] = score.get(i, 0) + most + 1 - len(held[w])
                shared.setdefault(i, []).append(w)
        for place, i in enumerate(sorted(score, key=lambda i: (-score[i], i))[:top], 1):
            out[key, place] = (i, score[i], sorted(shared[i]))
    return out


@pytest.fixture(scope="module")
def texts(spark):
    return spark.createDataFrame(ITEMS, "item int, text string"), spark.createDataFrame(ASKED, "key string, question string")


@pytest.mark.parametrize(("most", "top"), [(1, 1), (3, 2), (9, 9)])
def test_retrieved(texts, most, top):
    items, asked = texts
    got = {(r["key"], r["place"]): (r["item"], r["score"], r["shared"]) for r in E.retrieved(asked, ["key"], "question", E.specific_words(items, "item", "text", most), top).collect()}
    assert got == plain_found(most, top)


def test_verified(texts):
    items, asked = texts
    found = E.retrieved(asked, ["key"], "question", E.specific_words(items, "item", "text", 3), 2)
    own = E.packets(asked, ["key"], found, items, "item", "text")
    said = [
        ("a", "ok", "gamma is 12.6 [source: 1]"), ("a", "number", "Gamma is 40 [source: 1]"), ("a", "always", "Always gamma [source: 1]"), ("a", "other", "Nothing of it [source: 2]"),
        ("a", "bare", "gamma, delta"), ("a", "strange", "gamma [source: 99]"), ("a", "null", None), ("b", "refuse", "The evidence is INSUFFICIENT"), ("b", "answer", "It is alpha x2"), ("c", "number", "insufficient, 5"),
    ]
    drafts = asked.sparkSession.createDataFrame(said, "key string, name string, draft string").join(own, "key")
    got = {(r["key"], r["name"]): r for r in E.verified(drafts, "question", "draft", {"certainty": ["always"]}).collect()}
    issues = {k: r["issues"] for k, r in got.items()}
    assert issues == {
        ("a", "ok"): [], ("a", "number"): ["unsupported_number"], ("a", "always"): ["certainty"], ("a", "other"): ["evidence_omitted"], ("a", "bare"): ["source_missing"], ("a", "strange"): ["source_missing"],
        ("a", "null"): ["evidence_omitted", "source_missing"], ("b", "refuse"): [], ("b", "answer"): ["unsupported_question_answered"], ("c", "number"): ["unsupported_number"],
    }
    assert got["a", "ok"]["answer"] == "gamma is 12.6 [source: 1]" and got["a", "bare"]["answer"] == "Withheld: source_missing"
    assert got["b", "answer"]["numbers"] == 0 and got["a", "ok"]["numbers"] == 1 and (got["a", "ok"]["traceable"], got["a", "ok"]["expected"]) == (1, 2)
    template = E.verified(own.withColumn("draft", E.template(F.col("packet"))).withColumn("provider", F.lit("t")), "question", "draft", {})
    row = E.generation_summary(template, "provider").collect()[0]
    assert (row["cases"], row["passed"], row["supported_passed"], row["refused"], row["cited"], row["failures"]) == (6, 1.0, 1.0, 1.0, 1.0, 0)


def test_empty_evidence(spark, texts):
    _, asked = texts
    none = spark.createDataFrame([], "item int, text string")
    own = E.packets(asked, ["key"], E.retrieved(asked, ["key"], "question", E.specific_words(none, "item", "text")), none, "item", "text")
    assert [r["s"] for r in own.select(E.template(F.col("packet")).alias("s")).collect()] == ["Evidence is insufficient."] * 6
    empty = E.generation_summary(E.verified(own.limit(0).withColumn("draft", F.lit("")).withColumn("provider", F.lit("t")), "question", "draft", {}), "provider")
    assert empty.collect() == []


def test_transport(spark):
    rng = np.random.default_rng(5)
    rows = [(str(rng.choice(["m", "n"])), None if z == 3 else f"z{z}", int(y), None if rng.random() < 0.05 else bool(rng.random() < 0.3 + 0.15 * z)) for z, y in zip(rng.integers(0, 4, 600), rng.integers(1, 7, 600), strict=True)]
    rows += [("m", "late", 6, True), ("n", "early", 1, False), ("m", "z0", None, True)]
    df = spark.createDataFrame(rows, "fit string, state string, year int, hit boolean")
    got = {(r["fit"], r["year"]): r for r in T.transport_certificates(df, ["fit"], "state", "year", F.col("hit"), 0.5).collect()}
    worlds = {(r["fit"], r["year"], r["world"]): r for r in T.transport_worlds(df, ["fit"], "state", "year", F.col("hit"), 0.1, 0.5).collect()}
    cover = lambda own: sum(bool(r[3]) for r in own) / len(own)
    for fit in "mn":
        drifts = []
        for year in range(2, 7):
            before, now = ([r for r in rows if r[0] == fit and r[2] is not None and ok(r[2])] for ok in (lambda y, t=year: y < t, lambda y, t=year: y == t))
            past = [cover([r for r in before if r[1] == z] or before) for z in (r[1] for r in now)]
            carried, r = float(np.mean(past)), got[fit, year]
            want = (cover(before) - 0.5, cover(now) - 0.5, carried - cover(before), cover(now) - carried)
            assert np.allclose((r["source_gap"], r["target_gap"], r["mixture"], r["drift"]), want, atol=1e-12)
            assert abs(r["target_gap"] - r["source_gap"] - r["mixture"] - r["drift"]) < 1e-12
            if drifts:
                low, high = carried - 0.5 - max(drifts), carried - 0.5 + max(drifts)
                assert np.allclose((r["lower"], r["upper"]), (low, high)) and r["held"] == (low - 1e-12 <= want[1] <= high + 1e-12)
                assert r["verdict"] == ("UNDER" if high < 0 else "OVER" if low > 0 else "OPEN")
            else:
                assert r["verdict"] == "NO_HISTORY" and r["held"] is None
            drifts.append(abs(want[3]))
            a, b = worlds[fit, year, "BELOW"], worlds[fit, year, "ABOVE"]
            assert np.allclose((a["gap"], b["gap"]), (carried - 0.6, carried - 0.4))
            assert a["valid"] == (0.1 <= min(min(past), 1 - max(past)) + 1e-15) and a["signs_differ"] == (a["gap"] < 0 < b["gap"])
    assert len(got) == 10 and len(worlds) == 20
    with pytest.raises(ValueError, match="separation"):
        T.transport_worlds(df, ["fit"], "state", "year", F.col("hit"), 0.0)


def test_amplitudes_and_rankings(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", 4.0), ("b", 3.0), ("b", 3.0), ("b", 3.0), ("c", 1.0), ("c", 2.0), (None, 1.0), (None, 5.0), (None, 6.0), ("a", None)], "k string, p double")
    got = {(r["k"], r["scale"]): (r["n"], round(r["ratio"], 9)) for r in T.amplitude_worlds(df, ["k"], "p").collect()}
    assert got == {(k, s): (3, 1 / s) for k in ("a", None) for s in (0.5, 2.0)}
    cells = spark.createDataFrame([("x", "s0", 5.0), ("x", "s1", 9.0), ("y", "s0", 6.0), ("y", "s1", 2.0), ("z", "s1", 9.0), ("z", None, 5.0), ("w", "s9", 1.0), ("w", "s0", None)], "e string, s string, v double")
    out = sorted(tuple(r) for r in T.late_rankings(cells, "e", "s", "v").collect())
    assert out == [("y", -3.0, 2, 1), ("z", 0.0, 1, 0)]  # x and z lead with 7, x by name
