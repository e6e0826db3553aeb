"""Connected components of a distributed edge list."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ranks import plain_unions, spread_join
from .common import dropped, written

#: Rounds after which something must be wrong: each at least halves the longest path.
MOST_ROUNDS = 60
#: So many edges are joined up in one task (some 50 MB there); more in rounds over all tasks.
FEW_EDGES = 1 << 19


def joined_up(edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All nodes of the edges (two rows) and the least node that each reaches."""
    nodes, ends = np.unique(edges, return_inverse=True)
    a, b = ends.reshape(edges.shape)
    label = np.arange(len(nodes))
    while True:
        lower = label.copy()
        low = np.minimum(label[a], label[b])
        for end in (a, b):
            np.minimum.at(lower, label[end], low)  # whole components hang onto lower ones
            np.minimum.at(lower, end, low)
        while (lower[lower] != lower).any():
            lower = lower[lower]
        if (lower == label).all():
            return nodes, nodes[label]
        label = lower


def components(edges: DataFrame) -> DataFrame:
    """node, component (the least reachable node) of every node in the edges (a, b).

    Alternating large-star and small-star rounds: each node hangs its neighbours onto its least one.
    Few edges are joined up in one task, with the same result. Else edges never outgrow the input; each round is written to the shared folder, and rounds end when
    an order-free checksum of the edges stays the same. Joins spread a node of very many neighbours over
    several tasks.
    """
    plain_unions(edges.sparkSession)
    now = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    if now.count() <= FEW_EDGES:

        def alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            edges_ = [np.stack([b.column(0).to_numpy(), b.column(1).to_numpy()]) for b in batches]
            if edges_:
                nodes, least = joined_up(np.concatenate(edges_, axis=1))
                yield pa.RecordBatch.from_pydict({"node": pa.array(nodes), "component": pa.array(least)})

        return now.select(F.col("a").cast("long"), F.col("b").cast("long")).repartition(1).mapInArrow(alone, "node long, component long")
    was = None
    for _ in range(MOST_ROUNDS):
        mark = now.agg(F.count(F.lit(1)), F.coalesce(F.bit_xor(F.xxhash64("a", "b")), F.lit(0)), F.coalesce(F.sum(F.pmod(F.xxhash64("b", "a"), F.lit(1 << 31))), F.lit(0))).collect()[0]
        if mark == was:
            break
        was = mark
        both = now.union(now.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("_m")).select(F.col("a").alias("_u"), F.least("a", "_m").alias("m"))
        large = spread_join(now, least, "b", "_u", ["a"]).select(F.col("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "_u")
        small = spread_join(large, low, "a", "_u", ["b"])
        small = small.select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e")).select("e.a", "e.b")
        before, now = now, written(small.where("a <> b").distinct(), "edges")
        dropped(before)
    else:
        raise RuntimeError("components didn't settle")
    least = now.groupBy("a").agg(F.min("b").alias("component"))
    return least.union(now.select("b", "b").distinct()).toDF("node", "component").groupBy("node").agg(F.min("component").alias("component"))
