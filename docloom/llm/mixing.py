"""Mixing sources to target weights by Pfair scheduling.

Each source is cut into blocks of equal bytes in an order drawn from a hash of the ids. A source of
weight w (of all weights' sum, exact fractions) gives its block i (from 0) the release time floor(i / w)
and the deadline ceil((i + 1) / w); in each slot the released block of earliest deadline goes. On one
resource that keeps every source's count within less than one block of its share at any time, however
many sources there are and however small a weight is. A source that runs out leaves the mix; the blocks
of the others still go between their release and deadline, so slots may stay empty, and every row gets
its place. Sources of weight 0 have no share: they come after all others, evenly among themselves.

The schedule needs one entry per source at a time. One task makes it as a stream, an entry per block
(never per row), into a table that the rows are joined with.

Defined results: a null source is a source of its own; null and empty texts have one byte; a text longer
than a block takes as many of its source's blocks as it fills; equal deadlines go by the sources' names,
equal hashes of ids by id, then by text; neither a null id nor one of many rows is held by one task, but
rows equal in id and text are; repeated rows get places of their own;
an empty table gives an empty result; negative or infinite weights and slots beyond 63 bits raise. The
rows' own columns are carried in a struct, so no name clashes.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from fractions import Fraction

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ranks import spread_join
from .common import CHUNK_ROWS, ranked, table, written

#: Bytes of a block.
BLOCK_BYTES = 64 << 10
#: Tables of so many sources or blocks at most are broadcast; larger ones are joined by a shuffle.
FEW_SOURCES, FEW_BLOCKS = 5000, 1 << 18
#: Without given weights, a source's weight is its bytes to this power.
TEMPER = 0.5
#: Blocks that the schedule hands over at a time.
BATCH_BLOCKS = 1 << 15


def turns(weights: list[int], blocks: list[int]) -> Iterator[tuple[int, int, int, int, int]]:
    """(slot, source, block, release, deadline) of every block by slot: earliest deadline first among released blocks.

    A source's next block only comes in when the one before has gone: it is released at the earliest in
    the last slot before that one's deadline, and its own deadline is later.
    """
    total = sum(weights)
    waiting, ready = [(0, s) for s, n in enumerate(blocks) if n], []
    done, t = [0] * len(blocks), 0
    while waiting or ready:
        if not ready:
            t = max(t, waiting[0][0])
        while waiting and waiting[0][0] <= t:
            release, s = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(done[s] + 1) * total // weights[s]), s, release))
        deadline, s, release = heapq.heappop(ready)
        yield t, s, done[s], release, deadline
        done[s] += 1
        if done[s] < blocks[s]:
            heapq.heappush(waiting, (done[s] * total // weights[s], s))
        t += 1


def in_turn(weights: list[float], blocks: list[int]) -> Iterator[tuple[int, int, int, int, int]]:
    """:func:`turns` by the exact values of the weights; sources of weight 0 begin when the others have ended."""
    exact = [Fraction(w) for w in weights]
    scale = math.lcm(*[w.denominator for w in exact])
    whole, start = [int(w * scale) for w in exact], 0
    for part in ([s for s, w in enumerate(whole) if w], [s for s, w in enumerate(whole) if not w]):
        first = start
        for t, k, i, release, deadline in turns([whole[s] or 1 for s in part], [blocks[s] for s in part]):
            yield first + t, part[k], i, first + release, first + deadline
            start = first + t + 1


def timetable(stats: DataFrame, weights: dict[str | None, float] | None, block_bytes: int) -> DataFrame:
    """_s, _b (a source's block), _slot, _release and _deadline, from the rows (_source, n, b) of all sources."""
    names = ["_s", "_b", "_slot", "_release", "_deadline"]

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [r for batch in batches for r in zip(batch.column("_source").to_pylist(), batch.column("b").to_pylist(), strict=True)]
        if weights is None:
            target = [b**TEMPER for _, b in rows]
        else:
            target = [float(weights.get(None if s == "null" else s[1:], 0.0)) for s, _ in rows]
        out: list[tuple] = []

        def batch() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True))
            return pa.RecordBatch.from_arrays([pa.array([rows[s][0] for s in columns[1]], pa.string()), *[pa.array(columns[k], pa.int64()) for k in (2, 0, 3, 4)]], names=names)

        for turn in in_turn(target, [-(-b // block_bytes) for _, b in rows]):
            out.append(turn)
            if len(out) == BATCH_BLOCKS:
                yield batch()
                out.clear()
        if out:
            yield batch()

    return stats.repartition(1).sortWithinPartitions("_source").mapInArrow(made, "_s string, _b long, _slot long, _release long, _deadline long")


def placed(docs: DataFrame, weights: dict[str | None, float] | None = None, block_bytes: int = BLOCK_BYTES, carry: list[str] | None = None) -> DataFrame:
    """Every row (its columns in `carry`, else all) as the struct _row, with _source, _size, _block, _release, _deadline, _slot and _at (bytes of the source before the row).

    Ordering by _slot and _at gives the mixed sequence. Rows that carry no text are written down first, so
    that texts are read once.
    """
    rows = docs.select(
        F.struct(*(carry or ["*"])).alias("_row"),
        F.col("doc_id").alias("_id"),
        F.xxhash64("text").alias("_tie"),
        F.coalesce(F.concat(F.lit("="), "source"), F.lit("null")).alias("_source"),
        F.greatest(F.octet_length(F.coalesce("text", F.lit(""))), F.lit(1)).cast("long").alias("_size"),
    )
    if weights is not None and not all(0 <= w < math.inf for w in weights.values()):
        raise ValueError("weights must be finite and not negative")
    if carry and "text" not in carry:
        rows = written(rows, "sizes")
    stats = written(rows.groupBy("_source").agg(F.count(F.lit(1)).alias("n"), F.sum("_size").alias("b")), "sources")
    blocks = written(timetable(stats, weights, block_bytes), "timetable")
    per_source = stats.select(F.col("_source").alias("_s"), F.greatest(F.lit(1), F.ceil(F.col("n") / CHUNK_ROWS)).alias("_pieces"))
    rows = rows.withColumnRenamed("_size", "_bytes")
    if stats.count() <= FEW_SOURCES:
        rows = rows.join(F.broadcast(per_source), F.col("_source") == F.col("_s")).drop("_s")
    else:
        rows = spread_join(rows, per_source, "_source", "_s", ["_id", "_tie"])
    chunk = F.pmod(F.xxhash64("_id", "_tie", F.lit(3)), F.col("_pieces"))  # a hot id spreads by its texts
    order: list[Column] = [F.xxhash64("_id", F.lit(4)), F.col("_id"), F.col("_tie")]
    rows = ranked(rows, "_source", chunk, order, "_at", F.col("_bytes")).withColumnRenamed("_bytes", "_size")
    rows = rows.withColumn("_block", F.floor(F.col("_at") / block_bytes))
    few = blocks.count() <= FEW_BLOCKS
    rows = rows.join(F.broadcast(blocks) if few else blocks, (F.col("_source") == F.col("_s")) & (F.col("_block") == F.col("_b")))
    return rows.drop("_s", "_b", "_pieces", "_id", "_tie")


def mixed(docs: DataFrame, weights: dict[str | None, float] | None = None, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows with their own columns, in the mixed sequence: written out, files and rows follow it."""
    out = placed(docs, weights, block_bytes)
    return out.repartitionByRange("_slot", "_at").sortWithinPartitions("_slot", "_source", "_at").select("_row.*")


def op3_pfair_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place in the mix of sources by the square root of their bytes."""
    rows = placed(table(spark, sf_dir, "documents"), carry=["doc_id", "source"])
    return rows.select("_row.doc_id", "_row.source", F.col("_size").alias("size"), F.col("_block").alias("block"), F.col("_release").alias("release"), F.col("_deadline").alias("deadline"), F.col("_slot").alias("slot"), F.col("_at").alias("bytes_before"))
