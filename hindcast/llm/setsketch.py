"""Shingle sets and SetSketch registers, with numpy."""

from __future__ import annotations

import numpy as np

from . import windows as W

SHINGLE = 5
#: Registers, rows of a band; base, rate and largest value of the registers (16 bits).
REGISTERS, ROWS = 160, 4
BANDS = REGISTERS // ROWS
BASE_B, RATE_A, TOP_Q = 1.001, 20.0, (1 << 16) - 2
_factors = W._rng.integers(0, W.MASK64, REGISTERS, dtype=np.uint64, endpoint=True) | np.uint64(1)
#: Similarities among which the likelihood is maximised.
GRID = np.linspace(0, 1, 41)


def shingle_sets(data: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text. A text of fewer than five words is one shingle; without words, none."""
    words, word_at = W.word_hashes(W.LOWER[data], at)
    spans = W.Spans(words)
    grams = spans.all(SHINGLE)
    out = []
    for a, b in zip(word_at[:-1].tolist(), word_at[1:].tolist(), strict=True):
        if b - a >= SHINGLE:
            out.append(np.unique(grams[a : b - SHINGLE + 1]))
        else:
            out.append(spans.of(np.array([a]), np.array([b])) if b > a else np.zeros(0, np.uint64))
    return out


def registers(elements: np.ndarray) -> np.ndarray:
    """Register j is the largest of 1 - log_b(x) over the set, x exponential with rate a from the element's j-th hash.

    That is a truncated minimum on an exponential scale: registers of a union are the larger of both sets' registers.
    """
    low = np.full(REGISTERS, W.MASK64, dtype=np.uint64)
    for i in range(0, len(elements), 256):
        np.minimum(low, (elements[i : i + 256, None] * _factors).min(axis=0), out=low)
    x = -np.log1p(-np.minimum((low.astype(np.float64) + 0.5) / 2.0**64, 1 - 2.0**-53)) / RATE_A
    return np.clip(np.floor(1 - np.log(x) / np.log(BASE_B)), 0, TOP_Q + 1).astype(np.uint16)


def may_link(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray, least: float, ratio: float = 18.0) -> np.ndarray:
    """Pairs (rows of a and b) whose similarity may reach `least`, by joint maximum likelihood.

    The numbers of registers that are larger, smaller and equal have known chances given both sizes and a similarity.
    A pair is ruled out if some similarity is exp(ratio) times as likely as any from `least` on.
    """
    more, less = (a > b).sum(axis=1), (a < b).sum(axis=1)
    same = a.shape[1] - more - less
    u = (na / (na + nb))[:, None]
    v = 1 - u
    j = np.minimum(GRID[None, :], np.minimum(u / v, v / u))
    chance = lambda x: -np.log1p(-np.clip(x, 0, 1) * (BASE_B - 1) / BASE_B) / np.log(BASE_B)
    up, down = chance(u - v * j), chance(v - u * j)
    part = lambda n, p: np.where(n[:, None] == 0, 0.0, n[:, None] * np.log(np.maximum(p, 1e-12)))
    score = part(more, up) + part(less, down) + part(same, 1 - up - down)
    return score[:, GRID >= least - 1e-9].max(axis=1) >= score.max(axis=1) - ratio
