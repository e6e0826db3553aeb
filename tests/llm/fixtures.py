"""Small tables with everything that operators must bear."""

from __future__ import annotations

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LICENSE = "Some words first. Released under the MIT License. Licensed under the Apache License, Version 2.0."


def words(n: int, seed: int, alphabet: str = "abcdefghij") -> str:
    r = random.Random(seed)
    return " ".join("".join(r.choice(alphabet) for _ in range(r.randint(2, 6))) for _ in range(n))


def awkward() -> list[tuple]:
    """Nulls in every column, empty, blank, short and very long texts, copies, near copies and a repeated row."""
    base = words(80, 1).split()
    near = base.copy()
    near[40] = "changed"
    rows = [
        (0, None, "en", "a", 0),
        (1, "", "en", "a", 0),
        (2, " \t\n ", None, None, 4),
        (3, "one two", "en", "a", 7),
        (4, "One  TWO", "de", "b", 8),
        (5, words(20000, 2), "en", "b", None),
        (6, " ".join(base), "en", None, 1),
        (7, " ".join(near), "en", "a", 1),
        (8, " ".join(base), None, "a", 1),
        (9, LICENSE, "en", "a", 1),
        (10, "12 34 !!", "en", "c", 8),
        (11, "ünï cödé 漢字 \U0001f600 text", "de", "c", 1),
        (None, "a row without an id", "en", "a", 1),
        (12, "same row", "en", "a", 1),
        (12, "same row", "en", "a", 1),
    ]
    return rows


def many(n: int = 60) -> list[tuple]:
    """Families of copies and near copies among unrelated texts."""
    rows = []
    for i in range(n):
        base = words(40 + i % 7 * 10, 100 + i // 6).split()
        r = random.Random(i)
        for _ in range(i % 6 // 2):
            base[r.randrange(len(base))] = f"edit{r.randrange(1000)}"
        rows.append((i * 3, " ".join(base), "en", f"s{i % 4}", 1))
    return rows
