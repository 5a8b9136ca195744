"""Hashes of fixed-length windows over symbols (bytes or words), with numpy.

A window's *anchor* is the least hash among the short grams inside it. Equal windows have equal anchors, so windows need
to be compared only with windows of the same anchor. A run of windows that share one anchor is a *segment*.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa

#: Symbols handled at once; positions inside a chunk take POS_BITS of an ordering key.
CHUNK, POS_BITS = 1 << 20, 21
MASK64 = (1 << 64) - 1
#: Bytes from which on a word is hashed by BLAKE2: polynomials modulo 2 ** 64 collide on words of 1,024 letters made for it.
LONG_WORD = 256
BASE = 0x9E3779B97F4A7C15 | 1
_rng = np.random.Generator(np.random.PCG64(20240229))
BYTE_HASH = _rng.integers(0, MASK64, 256, dtype=np.uint64, endpoint=True)
SPACES = np.zeros(256, dtype=bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
#: A-Z to a-z.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE ** i and its inverse, modulo 2 ** 64."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, 1 << 16)
        out = []
        for base in (BASE, pow(BASE, -1, 1 << 64)):
            p = np.full(size, base, dtype=np.uint64)
            p[0] = 1
            out.append(np.multiply.accumulate(p))
        _powers[:] = out
    return _powers[0][:n], _powers[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: close inputs get far outputs."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class Spans:
    """Hashes of any spans of a symbol array."""

    def __init__(self, symbols: np.ndarray):
        n = len(symbols)
        up, self.down = powers(n + 1)
        self.sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(symbols * up[:n], out=self.sums[1:])

    def all(self, length: int) -> np.ndarray:
        """Of each span of that length."""
        m = len(self.sums) - length
        return mix((self.sums[length:] - self.sums[:m]) * self.down[:m]) if m > 0 else np.zeros(0, dtype=np.uint64)

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def utf8(column) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of an Arrow string column without nulls."""
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, dtype=np.int64)
    return at, np.frombuffer(data, dtype=np.uint8) if data is not None and len(data) else np.zeros(0, dtype=np.uint8)


def words_of(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word in data, and each text's offset into the words. at: the texts' offsets, from 0."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(at), np.int64)
    solid = ~SPACES[data]
    begins = np.zeros(n + 1, dtype=bool)
    begins[at] = True
    starts = np.flatnonzero(solid & (begins[:-1] | np.concatenate(([True], ~solid[:-1]))))
    ends = np.flatnonzero(solid & (begins[1:] | np.concatenate((~solid[1:], [True])))) + 1
    return starts, ends, np.searchsorted(starts, at)


def word_hashes(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each word, and each text's offset into the words."""
    starts, ends, word_at = words_of(data, at)
    if not len(starts):
        return np.zeros(0, np.uint64), word_at
    hashes = Spans(BYTE_HASH[data]).of(starts, ends)
    for i in np.flatnonzero(ends - starts >= LONG_WORD).tolist():
        hashes[i] = int.from_bytes(hashlib.blake2b(data[starts[i] : ends[i]].tobytes(), digest_size=8).digest(), "little")
    return hashes, word_at


def chunks(sizes_at: np.ndarray, most: int):
    """(first, last) ranges of texts of about `most` bytes together; a longer text is alone."""
    first, n = 0, len(sizes_at) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(sizes_at, sizes_at[first] + most, "right")) - 1)
        yield first, min(last, n)
        first = min(last, n)


def least_positions(keys: np.ndarray, width: int) -> np.ndarray:
    """Position of the least key in each window of `width`; the leftmost of equals. Keys count without their low bits."""
    n = len(keys)
    low = np.uint64((1 << POS_BITS) - 1)
    packed = (keys & ~low) | np.arange(n, dtype=np.uint64)
    rows = -(-n // width)
    padded = np.full(rows * width, MASK64, dtype=np.uint64)
    padded[:n] = packed
    square = padded.reshape(rows, width)
    ahead = np.minimum.accumulate(square, axis=1).reshape(-1)
    behind = np.minimum.accumulate(square[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return (np.minimum(behind[: n - width + 1], ahead[width - 1 : n]) & low).astype(np.int64)


def segments(symbols: np.ndarray, at: np.ndarray, window: int, gram: int):
    """Segments of all texts: text number, first window, windows, anchor hash, hash of all symbols that the windows cover.

    A text longer than a chunk is taken in overlapping parts; a segment cut by that is still found, as two.
    """
    out = []
    for first, last in chunks(at, CHUNK):
        lo, hi = int(at[first]), int(at[last])
        for begin in range(lo, max(hi - window + 1, lo), CHUNK) if hi - lo > CHUNK else [lo]:
            end = min(hi, begin + CHUNK + window - 1)
            part = symbols[begin:end]
            if len(part) < window:
                continue
            spans = Spans(part)
            grams = spans.all(gram)
            pos = least_positions(grams, window - gram + 1)
            bounds = np.clip(at[first : last + 1] - begin, 0, len(part))
            starts, ends = bounds[:-1], np.maximum(bounds[1:] - window + 1, bounds[:-1])
            # windows that lie in one text
            mark = np.zeros(len(part) + 1, dtype=np.int32)
            np.add.at(mark, starts, 1)
            np.add.at(mark, ends, -1)
            valid = np.flatnonzero(np.cumsum(mark[: len(pos)]) > 0)
            if not len(valid):
                continue
            p = pos[valid]
            new = np.concatenate(([True], (np.diff(p) != 0) | (np.diff(valid) != 1)))
            begins = np.flatnonzero(new)
            sizes = np.diff(np.concatenate((begins, [len(valid)])))
            s = valid[begins]
            text = np.searchsorted(bounds, s, "right") - 1
            out.append((text + first, s + begin - at[text + first], sizes, grams[p[begins]], spans.of(s, s + sizes + window - 1)))
    if not out:
        e = np.zeros(0, np.int64)
        return e, e, e, e.astype(np.uint64), e.astype(np.uint64)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))
