"""Packing into optimal length buckets.

A text's length is its number of words. From the global histogram of exact lengths, dynamic programming
picks the bucket boundaries that minimise padding to the bucket's boundary. The histogram has a row per
distinct length, at most about the square root of twice the number of all words. Inside each bucket,
batches take as many rows as the token budget allows at the padded length, at least one. Rows are
numbered within their bucket in pieces, so that a bucket of any size spreads over tasks.

Defined results: null and blank texts have length 0 and go to the first bucket, and count a token each
for the budget if that is padded to 0; fewer distinct lengths than buckets give fewer buckets; a text
beyond the budget is a batch of its own; of equal paddings any choice of boundaries may be made; rows
that tie in the order are told apart by id and length, and equal ones are packed each; an empty table
gives an empty result. Extra columns don't matter.

Texts are read once: what is known of each row then, its id, length and place in the order, is written
to the shared folder, and all else reads that.
"""

from __future__ import annotations

from bisect import bisect_right
from itertools import accumulate

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import pieces, ranked, table, text_of, written

BUCKETS = 16
#: Padded tokens of a batch.
BUDGET = 32768


def length_of() -> Column:
    """Words between white space."""
    return F.regexp_count(text_of(), F.lit(r"\S+")).cast("long")


def boundaries(lengths: list[int], counts: list[int], buckets: int = BUCKETS) -> list[int]:
    """The padded lengths, out of `lengths` (rising), that minimise the padding of all rows together.

    A layer of the programme takes, for each length, the least of lines whose slopes fall from one length
    to the next while the lengths rise, so that each line is looked at about once: all in whole numbers.
    """
    m = len(lengths)
    if m <= buckets:
        return list(lengths)
    before = [0, *accumulate(counts)]
    best: list[int | None] = [0, *[None] * m]  # least padded total of the first i lengths
    back = []
    for _ in range(buckets):
        total: list[int | None] = [None] * (m + 1)
        froms, lines, at = np.zeros(m, np.int32), [], 0
        for j, x in enumerate(lengths):
            if best[j] is not None:
                slope, rise = -before[j], best[j]
                while len(lines) - at >= 2:
                    (s1, r1, _), (s2, r2, _) = lines[-2:]
                    if (r2 - r1) * (s1 - slope) < (rise - r1) * (s1 - s2):
                        break
                    lines.pop()
                lines.append((slope, rise, j))
            while len(lines) - at >= 2 and lines[at + 1][0] * x + lines[at + 1][1] <= lines[at][0] * x + lines[at][1]:
                at += 1
            if len(lines) > at:
                total[j + 1] = lines[at][0] * x + lines[at][1] + x * before[j + 1]
                froms[j] = lines[at][2]
        best = total
        back.append(froms)
    out, j = [], m - 1
    for froms in reversed(back):
        out.append(lengths[j])
        j = int(froms[j]) - 1
        if j < 0:
            break
    return out[::-1]


def _bucket_of(buckets: list[tuple[int, ...]]) -> Column:
    """The first bucket that a row's length fits into, as a struct: a chain over the few buckets."""
    names = ("bucket", "_low", "bucket_length", "_each", "_first", "_pieces")
    out = None
    for b in reversed(buckets):
        own = F.struct(*[F.lit(x).cast("int" if n == "bucket" else "long").alias(n) for n, x in zip(names, b, strict=True)])
        out = own if out is None else F.when(F.col("n_tokens") <= b[2], own).otherwise(out)
    if out is None:
        out = F.struct(*[F.lit(None).cast("int" if n == "bucket" else "long").alias(n) for n in names])
    return out


def packed(docs: DataFrame, buckets: int = BUCKETS, budget: int = BUDGET, chunk: Column | None = None, order: list[Column] | None = None) -> DataFrame:
    """doc_id, n_tokens, bucket, bucket_length, batch, slot and padding of every row.

    Rows go into batches in the order given (`chunk` a whole number that rises with it, over at most
    about a thousand rows each), else in that of a hash of their ids and texts.
    """
    if order is None:  # a hot id spreads by its texts, rows without an id by where they lie
        spread = F.when(F.col("doc_id").isNull(), F.monotonically_increasing_id()).otherwise(F.xxhash64("text"))
        extra = {"_chunk0": F.xxhash64("doc_id", spread, F.lit(5)), "_o0": F.xxhash64("doc_id", spread, F.lit(6)), "_o1": F.col("doc_id")}
    else:
        extra = {"_chunk0": chunk, **{f"_o{i}": c for i, c in enumerate(order)}}
    rows = written(docs.select("doc_id", length_of().alias("n_tokens"), *[c.alias(n) for n, c in extra.items()]), "lengths")
    found = rows.groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n")).toArrow().sort_by("n_tokens")
    lengths, counts = found["n_tokens"].to_pylist(), found["n"].to_pylist()
    edges = boundaries(lengths, counts, buckets)
    upto = [0, *accumulate(counts)]
    table_, below, first = [], -1, 0
    for b, edge in enumerate(edges):
        n = upto[bisect_right(lengths, edge)] - upto[bisect_right(lengths, below)]
        each = max(1, budget // max(1, edge))
        table_.append((b, below, edge, each, first, pieces(n)))
        first, below = first + -(-n // each), edge
    rows = rows.select("*", F.inline(F.array(_bucket_of(table_))))
    piece = F.col("_chunk0") if order is not None else F.pmod(F.col("_chunk0"), F.col("_pieces"))
    rows = ranked(rows, "bucket", piece, [F.col(n) for n in extra if n != "_chunk0"], "_rank")
    return rows.select(
        "doc_id",
        "n_tokens",
        "bucket",
        "bucket_length",
        (F.col("_first") + F.floor(F.col("_rank") / F.col("_each"))).cast("long").alias("batch"),
        (F.col("_rank") % F.col("_each")).cast("int").alias("slot"),
        (F.col("bucket_length") - F.col("n_tokens")).alias("padding"),
    )


def op4_length_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's bucket and batch."""
    return packed(table(spark, sf_dir, "documents"))
