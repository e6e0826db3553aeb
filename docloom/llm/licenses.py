"""License scans: an exact set-similarity join of text blocks with license templates.

A text is cut into overlapping blocks of words; a template is the set of its words. Blocks have a width
that follows the template's length: the least of BLOCK, 2 BLOCK, 4 BLOCK, ... whose half, the step from
one block to the next, the template fits into, so that a template of any length lies whole in some
block. A block meets a template if it holds at least the threshold's share of the template's words, and
every such block is found, also where another template met there has all of those words. Words are
ordered by how many documents of the whole corpus hold them, rarest first, and three filters leave few
blocks to verify: a match must share one of the template's first words in that order (prefix), the
block must hold enough template words at all (length), and what follows the shared word on either side
must suffice (positional). Template words are few, so the order and the index over template prefixes
are bounded by the templates, whatever the corpus.

Phrases are templates of threshold 1 whose words must also stand consecutively in a block that holds
them all; a place belongs to the one block in whose first half it starts.

Defined results: null and empty texts have no words and no labels; a text shorter than a block is one
block; a text of any length is scanned whole, block by block, in one row's memory; templates that tie
are all given, in no order; repeated rows are scanned alike; an empty table gives an empty result.
Extra columns don't matter.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches, table, text_of

#: Words of the narrowest blocks; wider ones are powers of two of it. The next block starts at a block's half.
BLOCK = 48
THRESHOLD = 0.9

# The phrases and their labels.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

# Wording of common license notices, sentences and whole texts, and their labels.
TEMPLATES = {
    "released under the mit license": "mit",
    "permission is hereby granted free of charge to any person obtaining a copy of this software": "mit",
    "licensed under the apache license version 2 0": "apache-2",
    "you may not use this file except in compliance with the license": "apache-2",
    "gnu general public license version 3": "gpl-3",
    "gnu general public license version 2": "gpl-2",
    "gnu lesser general public license version 3": "lgpl-3",
    "gnu affero general public license version 3": "agpl-3",
    "redistribution and use in source and binary forms with or without modification are permitted": "bsd",
    "this source code form is subject to the terms of the mozilla public license v 2 0": "mpl-2",
    "licensed under cc by nc 4 0": "cc-by-nc",
    "licensed under cc by sa 4 0": "cc-by-sa",
    "creative commons attribution noncommercial 4 0 international license": "cc-by-nc",
    "this is free and unencumbered software released into the public domain": "unlicense",
    """permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the
    software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute
    sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following
    conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software
    the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of
    merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any
    claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software
    or the use or other dealings in the software""": "mit",
    """permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the
    above copyright notice and this permission notice appear in all copies the software is provided as is and the author disclaims all
    warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall the author be
    liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits
    whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this
    software""": "isc",
    """redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are
    met redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer
    redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the
    documentation and or other materials provided with the distribution""": "bsd",
    """licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain
    a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software
    distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see
    the license for the specific language governing permissions and limitations under the license""": "apache-2",
    """this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by
    the free software foundation either version 3 of the license or at your option any later version this program is distributed in the hope
    that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose
    see the gnu general public license for more details""": "gpl-3",
}

_TO_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    """Runs of digits, ASCII letters (lower-cased) and characters beyond ASCII."""
    return (text or "").encode().translate(_TO_WORDS).split()


@dataclass
class Template:
    """A template: its words in order of the text and, once ordered, its distinct words rarest first."""

    label: str
    words: list[bytes]
    threshold: float
    phrase: bool
    ordered: tuple[bytes, ...] = ()

    @property
    def least(self) -> int:
        """How many distinct words a block must share."""
        return math.ceil(self.threshold * len(set(self.words)) - 1e-9)

    @property
    def width(self) -> int:
        """Words of the blocks that it is looked for in."""
        return BLOCK << max(0, math.ceil(len(self.words) / (BLOCK // 2)) - 1).bit_length()


def last_block(words: int, width: int) -> int:
    """Number of the last block, from 0, of so many words."""
    return max(0, math.ceil((words - width) / (width // 2)))


def templates(threshold: float = THRESHOLD, texts: dict[str, str] = TEMPLATES, phrases: dict[str, str] = PHRASES) -> list[Template]:
    """All templates; one without words meets everything and is refused."""
    out = [Template(label, words_of(p), 1.0, True) for p, label in phrases.items()]
    out += [Template(label, words_of(t), threshold, False) for t, label in texts.items()]
    if not all(t.words for t in out):
        raise ValueError("a template must have words")
    return out


def frequencies(docs: DataFrame, vocabulary: frozenset[bytes]) -> dict[bytes, int]:
    """In how many documents of the corpus each template word occurs."""
    small_batches(docs.sparkSession)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[bytes] = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                total.update(vocabulary.intersection(words_of(text)))
        yield pa.RecordBatch.from_pydict({"word": pa.array(list(total), pa.binary()), "n": pa.array(list(total.values()), pa.int64())})

    rows = docs.select("text").mapInArrow(counted, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    return {bytes(r.word): r.n for r in rows}


class Index:
    """Templates in the global order, findable by their blocks' width and the words of their prefixes."""

    def __init__(self, all_templates: list[Template], counts: dict[bytes, int]):
        vocabulary = {w for t in all_templates for w in t.words}
        self.rank = {w: i for i, w in enumerate(sorted(vocabulary, key=lambda w: (counts.get(w, 0), w)))}
        self.templates = [Template(t.label, t.words, t.threshold, t.phrase, tuple(sorted(set(t.words), key=self.rank.get))) for t in all_templates]
        self.widths = sorted({t.width for t in self.templates})
        self.vocabulary = {width: frozenset(w for t in self.templates if t.width == width for w in t.words) for width in self.widths}
        self.prefixes: dict[int, dict[bytes, list[tuple[int, int]]]] = {width: {} for width in self.widths}
        for k, t in enumerate(self.templates):
            for i, w in enumerate(t.ordered[: len(t.ordered) - t.least + 1]):
                self.prefixes[t.width].setdefault(w, []).append((k, i))
        self.heads = frozenset(w for heads in self.prefixes.values() for w in heads)

    def blocks(self, words: list[bytes], width: int) -> Iterator[tuple[int, int, int]]:
        """(block, template, shared words) of every block of that width that meets one of its templates."""
        heads, vocabulary = self.prefixes[width], self.vocabulary[width]
        if heads.keys().isdisjoint(words):
            return
        step, last = width // 2, last_block(len(words), width)
        begun = sorted({b for i, w in enumerate(words) if w in heads for b in range(max(0, (i - width) // step + 1), min(last, i // step) + 1)})
        for b in begun:
            held = sorted(vocabulary.intersection(words[b * step : b * step + width]), key=self.rank.get)
            tried: set[int] = set()
            for j, w in enumerate(held):
                for k, i in heads.get(w, ()):
                    t = self.templates[k]
                    if k in tried:
                        continue
                    tried.add(k)  # a later shared word leaves less on either side
                    if len(held) < t.least or 1 + min(len(t.ordered) - i - 1, len(held) - j - 1) < t.least:
                        continue
                    if (shared := len(set(held).intersection(t.ordered))) >= t.least:
                        yield b, k, shared

    def scan(self, text: str | None) -> tuple[int, list[dict], list[dict]]:
        """Number of words, places of phrases, and blocks that meet templates."""
        words = words_of(text)
        places, blocks = [], []
        for width in () if self.heads.isdisjoint(words) else self.widths:
            step, last = width // 2, last_block(len(words), width)
            for b, k, shared in self.blocks(words, width):
                t = self.templates[k]
                if t.phrase:
                    n = len(t.words)
                    end = len(words) if b == last else (b + 1) * step
                    places += [{"label": t.label, "first_word": i, "words": n} for i in range(b * step, min(end, len(words) - n + 1)) if words[i : i + n] == t.words]
                else:
                    blocks.append({"label": t.label, "template": b" ".join(t.words).decode(), "first_word": b * step, "words": min(width, len(words) - b * step), "containment": shared / len(t.ordered)})
        return len(words), places, blocks


FOUND = "doc_id long, n_words long, places array<struct<label string, first_word long, words long>>, blocks array<struct<label string, template string, first_word long, words long, containment double>>"
_PLACE = pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("words", pa.int64())])
_BLOCK = pa.struct([("label", pa.string()), ("template", pa.string()), ("first_word", pa.int64()), ("words", pa.int64()), ("containment", pa.float64())])


def scan(docs: DataFrame, wanted: list[Template] | None = None) -> DataFrame:
    """Every row's number of words, phrase places and matching blocks: two passes, no shuffle of texts."""
    small_batches(docs.sparkSession)
    wanted = wanted or templates()
    index = Index(wanted, frequencies(docs, frozenset(w for t in wanted for w in t.words)))

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [index.scan(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "n_words": pa.array([n for n, _, _ in found], pa.int64()), "places": pa.array([p for _, p, _ in found], pa.list_(_PLACE)), "blocks": pa.array([b for _, _, b in found], pa.list_(_BLOCK))})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).mapInArrow(scanned, FOUND)


def op1_license_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's license phrases and blocks."""
    found = scan(table(spark, sf_dir, "documents"))
    named = lambda c: F.array_join(F.array_sort(F.array_distinct(c)), ",")
    return found.select(
        "doc_id",
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min("places.first_word").alias("first_word"),
        F.array_max("places.first_word").alias("last_word"),
        named(F.col("places.label")).alias("base_labels"),
        named(F.concat("places.label", "blocks.label")).alias("labels"),
        F.coalesce(F.greatest(F.when(F.size("places") > 0, 1.0), F.array_max("blocks.containment")), F.lit(0.0)).alias("score"),
        F.size("blocks").cast("long").alias("n_blocks"),
    )


def oracle() -> str:
    """DuckDB SQL that tries every block with every template and every place with every phrase."""
    listed = lambda ws: "[" + ", ".join(f"'{w.decode()}'" for w in ws) + "]"
    wanted = templates()
    rows = ", ".join(f"('{t.label}', {listed(dict.fromkeys(t.words))}, {len(set(t.words))}, {t.least}, {t.width})" for t in wanted if not t.phrase)
    widths = ", ".join(f"({width})" for width in sorted({t.width for t in wanted if not t.phrase}))
    phrases = ", ".join(f"('{t.label}', {listed(t.words)}, {len(t.words)})" for t in wanted if t.phrase)
    return rf"""
WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
t AS (SELECT * FROM (VALUES {rows}) v(label, words, n, least, width)),
p AS (SELECT * FROM (VALUES {phrases}) v(label, words, n)),
z AS (SELECT * FROM (VALUES {widths}) v(width)),
b AS (SELECT doc_id, width, list_distinct(w[k * (width // 2) + 1 : k * (width // 2) + width]) AS s FROM (SELECT doc_id, w, width, unnest(range(CAST(greatest(0, ceil((len(w) - width) / (width // 2))) AS BIGINT) + 1)) AS k FROM w, z)),
f AS (SELECT b.doc_id, t.label, len(list_intersect(b.s, t.words)) / t.n AS c FROM b JOIN t ON b.width = t.width AND len(list_intersect(b.s, t.words)) >= t.least),
i AS (SELECT doc_id, w, unnest(range(len(w))) AS i FROM w),
a AS (SELECT i.doc_id, p.label, i.i FROM i JOIN p ON i.w[i.i + 1 : i.i + p.n] = p.words),
g AS (SELECT doc_id, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM a GROUP BY doc_id),
h AS (SELECT doc_id, count(*) AS n_blocks, max(c) AS c FROM f GROUP BY doc_id),
l AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT doc_id, label FROM a UNION SELECT doc_id, label FROM f) GROUP BY doc_id)
SELECT w.doc_id, CAST(len(w.w) AS BIGINT) AS n_words, coalesce(g.n_base, 0) AS n_base, g.first_word, g.last_word, coalesce(g.base_labels, '') AS base_labels, coalesce(l.labels, '') AS labels,
  coalesce(greatest(CASE WHEN g.n_base > 0 THEN CAST(1 AS DOUBLE) END, h.c), CAST(0 AS DOUBLE)) AS score, coalesce(h.n_blocks, 0) AS n_blocks
FROM w LEFT JOIN g ON g.doc_id = w.doc_id LEFT JOIN h ON h.doc_id = w.doc_id LEFT JOIN l ON l.doc_id = w.doc_id
"""
