"""Sets of hashed word shingles of whole texts, computed over many texts at once."""

from __future__ import annotations

import numpy as np

from .ngrams import batches

#: Words of a shingle.
WIDTH = 5
_SPAN = 64


def _table() -> np.ndarray:
    return np.random.default_rng(5).integers(0, 1 << 64, _SPAN * 256, np.uint64)


def _final(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(33))
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


class Shingler:
    """Turns texts into sorted arrays of distinct 64-bit shingle hashes.

    Words are runs of characters other than ASCII white space, A-Z lower-cased. A text of fewer words
    than a shingle has its whole sequence as the only one; a text without words has none.
    """

    def __init__(self, width: int = WIDTH):
        self.width = width
        self.table = _table()
        self.weights = np.random.default_rng(6).integers(0, 1 << 63, width, np.uint64) * np.uint64(2) + np.uint64(1)

    def sets(self, texts: list[str | None]) -> list[np.ndarray]:
        """One array per text."""
        texts = [t or "" for t in texts]
        return [s for a, b in batches(texts) for s in self._sets(texts[a:b])]

    def _words(self, raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        data = np.frombuffer(b" " + b" ".join(raw) + b" ", np.uint8)
        blank = (data == 32) | ((data >= 9) & (data <= 13))
        starts = np.flatnonzero(blank[:-1] & ~blank[1:]) + 1
        edges = np.cumsum(np.fromiter(map(len, raw), np.int64, len(raw)) + 1) + 1
        bounds = np.searchsorted(starts, np.concatenate([[0], edges]))
        if not len(starts):
            return np.zeros(0, np.uint64), bounds
        sizes = np.flatnonzero(~blank[:-1] & blank[1:]) + 1 - starts
        at = np.flatnonzero(~blank)
        within = at - np.repeat(starts, sizes)
        values = self.table[(within & (_SPAN - 1)) * 256 + data[at]]
        if sizes.max() > _SPAN:
            values = values * ((within // _SPAN).astype(np.uint64) * np.uint64(2) + np.uint64(1))
        return _final(np.add.reduceat(values, np.concatenate([[0], np.cumsum(sizes)[:-1]]), dtype=np.uint64)), bounds

    def _sets(self, texts: list[str]) -> list[np.ndarray]:
        words, bounds = self._words([t.encode().lower() for t in texts])
        k = self.width
        m = max(0, len(words) - k + 1)
        rolled = np.zeros(m, np.uint64)
        for i in range(k):
            rolled += words[i : i + m] * self.weights[i]
        rolled = _final(rolled)
        out = []
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            if b - a >= k:
                out.append(np.unique(rolled[a : b - k + 1]))
            elif b > a:
                with np.errstate(over="ignore"):
                    out.append(_final((words[a:b] * self.weights[: b - a]).sum(keepdims=True, dtype=np.uint64) + np.uint64(b - a)))
            else:
                out.append(np.zeros(0, np.uint64))
        return out
