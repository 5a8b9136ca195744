"""Plain versions of the operators, for small inputs."""

from __future__ import annotations

import hashlib
from collections import Counter


def removed(symbols: list, window: int, counts: Counter, firsts: dict, where, keep_first: bool) -> list[bool]:
    out = [False] * len(symbols)
    for i in range(len(symbols) - window + 1):
        key = tuple(symbols[i : i + window])
        if counts[key] >= 2 and not (keep_first and firsts[key] == (where, i)):
            out[i : i + window] = [True] * window
    return out


def substring(docs: list[tuple], window: int, words: bool, keep_first: bool = False) -> list[tuple]:
    """(id, n, n_removed, n_spans, sha) per (id, text); ids must be distinct."""
    parts = [(i, (t or "").encode().split() if words else list((t or "").encode())) for i, t in docs]
    counts, firsts = Counter(), {}
    for i, p in sorted(parts):
        for k in range(len(p) - window + 1):
            key = tuple(p[k : k + window])
            counts[key] += 1
            firsts.setdefault(key, (i, k))
    out = []
    for i, p in parts:
        gone = removed(p, window, counts, firsts, i, keep_first)
        kept = [x for x, g in zip(p, gone, strict=True) if not g]
        text = b" ".join(kept) if words else bytes(kept)
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out.append((i, len(p), sum(gone), spans, hashlib.sha256(text).hexdigest()))
    return sorted(out)


def lower(text: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def near(docs: list[tuple]) -> list[tuple]:
    """(id, n_shingles, component_id, kept) per (id, text); ids must be distinct."""
    sets = {}
    for i, t in docs:
        w = lower(t or "").encode().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    comp = {i: i for i in sets}

    def top(x):
        while comp[x] != x:
            x = comp[x]
        return x

    holders: dict = {}
    for i, s in sets.items():
        for g in s:
            holders.setdefault(g, []).append(i)
    for i, s in sets.items():
        shared = Counter(j for g in s for j in holders[g] if j < i)
        for j, c in shared.items():
            if 100 * c >= 75 * (len(s) + len(sets[j]) - c):
                a, b = sorted((top(i), top(j)))
                comp[b] = a
    return sorted((i, len(s), top(i), top(i) == i) for i, s in sets.items())


def draw(doc_id: int, seed: int) -> float:
    """The number in [0, 1) that mixing draws for an id: 64-bit xxHash of the id, then of the seed."""
    import xxhash

    first = xxhash.xxh64_intdigest(doc_id.to_bytes(8, "little", signed=True), seed=42)
    return xxhash.xxh64_intdigest(seed.to_bytes(4, "little"), seed=first) % 2**53 / 2**53


def tempered(has: dict, amount: float, power: float, most: float) -> dict:
    """Tokens per value, in proportion to shares to a power but at most a part of what there is: amount in all."""
    total = sum(has.values())
    give = lambda rate: {v: min(most * n, rate * (n / total) ** power) for v, n in has.items()}
    low, high = 0.0, 1e3 * total
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if sum(give(mid).values()) < amount else (low, mid)
    return give(high)


def mixed(cells: dict, power: float, most: float, budget: float, tries, sweeps: int, tolerance: float, reached: float) -> dict:
    """Probability per cell (a tuple with one value per margin, to tokens), raked under 1 towards tempered margins."""
    total, first = sum(cells.values()), None
    margins = range(len(next(iter(cells))))
    has = [{v: sum(n for c, n in cells.items() if c[m] == v) for v in {c[m] for c in cells}} for m in margins]
    wants = [{v: t / budget for v, t in tempered(h, total * budget, power, most).items()} for h in has]
    for share in (budget * x for x in tries):
        x = dict.fromkeys(cells, share)
        given = lambda m, v: sum(n * min(x[c], 1) for c, n in cells.items() if c[m] == v)  # noqa: B023, E731
        for _ in range(sweeps):
            worst = 0.0
            for m in margins:
                factors = {v: want * share / given(m, v) for v, want in wants[m].items() if want}
                worst = max([worst, *(abs(f - 1) for f in factors.values())])
                x = {c: p * factors.get(c[m], 1) for c, p in x.items()}
            if worst < tolerance:
                break
        p = {c: min(v, 1) for c, v in x.items()}
        first = first or p
        if all(abs(given(m, v) - want * share) <= reached * want * share for m in margins for v, want in wants[m].items()):
            return p
        if max(x.values()) < 1:
            break
    return first
