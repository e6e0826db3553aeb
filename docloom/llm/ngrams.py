"""Hashed word and character n-gram features of whole texts, computed over many texts at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Texts are taken together until they have so many characters; a longer text stands alone.
BATCH_CHARS = 1 << 18


def batches(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Slices of the list that hold about BATCH_CHARS characters each."""
    begun, total = 0, 0
    for i, t in enumerate(texts):
        if i > begun and total + len(t) > BATCH_CHARS:
            yield begun, i
            begun, total = i, 0
        total += len(t)
    if begun < len(texts):
        yield begun, len(texts)


def _mixed(h: np.ndarray, bits: int) -> np.ndarray:
    h = h ^ (h >> np.uint32(15))
    h *= np.uint32(0x2C1B3C6D)
    h ^= h >> np.uint32(12)
    h *= np.uint32(0x297A2D39)
    return h >> np.uint32(32 - bits)


def grams(texts: list[str], orders: tuple[int, ...], words: bool, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(buckets, bounds) for each order, then for words: text i has buckets[bounds[i]:bounds[i + 1]].

    An n-gram holds n characters of a word and the blanks around it: white space may stand at its ends,
    never within. Texts do not run into each other.
    """
    joined = np.frombuffer(f" {' '.join(texts)} ".encode("utf-32-le", "replace"), "<u4")
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    ends = np.cumsum(lengths + 1)
    edges = np.append(ends - lengths - 1, ends[-1])  # of the blank before each text
    blank = joined <= 32
    for n in orders:
        m = len(joined) - n + 1
        if n == 1:
            ok = ~blank
        elif n == 2:
            ok = ~(blank[:-1] & blank[1:])
        else:
            ok = ~blank[1 : m + 1]
            for k in range(2, n - 1):
                ok &= ~blank[k : m + k]
        at = np.flatnonzero(ok)
        h = joined[at] + np.uint32(n * 0x9E3779B1 & 0xFFFFFFFF)
        for k in range(1, n):
            h = h * np.uint32(0x01000193) + joined[at + k] * np.uint32(0x85EBCA6B)
        yield _mixed(h, bits), np.searchsorted(at, edges)
    if words:
        starts = np.flatnonzero(blank[:-1] & ~blank[1:]) + 1
        if len(starts):
            stops = np.flatnonzero(~blank[:-1] & blank[1:]) + 1
            sizes = stops - starts
            at = np.flatnonzero(~blank)
            within = (at - np.repeat(starts, sizes)).astype(np.uint32)
            h = (joined[at] + within * np.uint32(0x9E3779B1)) * np.uint32(0x85EBCA6B)
            h ^= h >> np.uint32(13)
            h *= np.uint32(0xC2B2AE35)
            firsts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            h = np.add.reduceat(h, firsts, dtype=np.uint32)
        else:
            h = np.zeros(0, np.uint32)
        yield _mixed(h, bits), np.searchsorted(starts, edges + 1)


def sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sum of the values of each text; 0 for texts without any."""
    out = np.zeros((len(bounds) - 1, *values.shape[1:]))
    full = bounds[1:] > bounds[:-1]
    if full.any():
        out[full] = np.add.reduceat(values, bounds[:-1][full], axis=0, dtype=np.float64)
    return out


def bags(texts: list[str], orders: tuple[int, ...], words: bool, bits: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Distinct buckets and their counts for each text."""
    out = []
    for a, b in batches(texts):
        found = list(grams(texts[a:b], orders, words, bits))
        for i in range(b - a):
            out.append(np.unique(np.concatenate([h[e[i] : e[i + 1]] for h, e in found]), return_counts=True))
    return out


def means(texts: list[str], table: np.ndarray, orders: tuple[int, ...], words: bool, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean of the table's rows over all features of each text, and the number of features."""
    totals = np.zeros((len(texts), *table.shape[1:]))
    counts = np.zeros(len(texts))
    for a, b in batches(texts):
        for h, e in grams(texts[a:b], orders, words, bits):
            totals[a:b] += sums(table[h], e)
            counts[a:b] += np.diff(e)
    return totals / np.maximum(counts, 1).reshape(-1, *[1] * (table.ndim - 1)), counts
