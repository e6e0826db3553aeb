"""Exact top-k search by inner product: dual-tree search over cover trees.

Data rows are dealt into blocks around pivots, each row to the nearest one; pivots come from a bounded
sample and lie far from each other, so a block is a node of a tree's top level: its pivot and the
distance of its farthest row bound the scores of all in it. A pivot of many rows has several blocks.
Each query searches the block whose pivot scores best first. Its kth score there is what any other
block's bound must reach for the query to be sent there at all; what is sent goes in groups, and each
pair of a block and a group of queries builds a cover tree of either side and walks both together. A
pair of nodes is cut off when the best inner product that their centres and covering radii allow is
below the worst kth score so far of every query in the query node; ties go on, since the smaller id
wins. No task holds more than a block and a group, and any vector or id can be there any number of times.

Vectors are compared after floor(scale * x) as integers. Trees and bounds are float64 with room for
rounding; scores are float64 where that is exact, and those pairs for which it isn't, and which may
reach a kth score, are multiplied in Python's integers, so that vectors of any size take part.

Defined results: vectors that are null, empty or hold components that are null, NaN or, scaled, not
finite take no part, nor do rows of null id; vectors of different lengths aren't compared; rows that
share the query's id are its own; a query with fewer candidates than k has fewer rows; a score beyond
what a long holds counts as the nearest long; ties go to the smaller id; of several query rows of one
id that of least length, then of least hash, is asked; repeated rows are candidates each; an empty
table gives an empty result. Extra columns don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.ranks import plain_unions
from .common import table, written

K = 5
SCALE = 256
#: Rows of a data block and of a group of queries.
DATA_BLOCK, QUERY_BLOCK = 8192, 2048
#: Pivots for vectors of one length, rows that they are chosen from for each, and bytes of those rows at most.
MOST_PIVOTS, CHOICE, CHOICE_BYTES = 1024, 8, 64 << 20
#: A node of so few points (of so few queries) isn't divided.
LEAF, QUERY_LEAF = 256, 256
#: A child's covering radius is at most this share of its parent's.
SHRINK = 0.8
#: A node is divided into at most so many children; what they don't cover stays with the nearest.
MOST_CHILDREN = 64


@dataclass
class Node:
    """A subset of points, all within `radius` of `center`."""

    center: np.ndarray
    radius: float
    norm: float
    rows: np.ndarray
    children: list[Node] = field(default_factory=list)


def cover_tree(points: np.ndarray, rows: np.ndarray, center: np.ndarray | None = None, leaf: int = LEAF) -> Node:
    """Divide points by centres that lie further apart than the children's radius, until nodes are small.

    Radii are measured, not assumed, so that they bound even where children were limited.
    """
    own = points[rows]
    if center is None:
        center = own[np.abs(own - own.mean(0)).sum(1).argmin()]
    away = np.sqrt(((own - center) ** 2).sum(1))
    node = Node(center, float(away.max()), float(np.sqrt((center**2).sum())), rows)
    if len(rows) <= leaf or node.radius == 0:
        return node
    reach = node.radius * SHRINK
    nearest, owner, centers = away, np.zeros(len(rows), int), [center]
    while len(centers) < MOST_CHILDREN and nearest.max() > reach:
        far = own[nearest.argmax()]
        d = np.sqrt(((own - far) ** 2).sum(1))
        closer = d < nearest
        nearest, owner = np.where(closer, d, nearest), np.where(closer, len(centers), owner)
        centers.append(far)
    parts = [rows[owner == c] for c in range(len(centers))]
    if max(map(len, parts)) == len(rows):
        return node
    node.children = [cover_tree(points, p, c, leaf) for p, c in zip(parts, centers, strict=True) if len(p)]
    return node


#: The least and the greatest score.
LOW, HIGH = -(1 << 63), (1 << 63) - 1
#: Whole numbers below this are exact as float64, also as sums of products.
EXACT = 2.0**52


class Search:
    """Best k of the data for each query, found by walking two trees; scores below a query's `least` aren't looked for.

    Scores are held as float64 if that is exact for all pairs, else as longs.
    """

    def __init__(self, queries: np.ndarray, query_ids: np.ndarray, data: np.ndarray, data_ids: np.ndarray, k: int = K, least: np.ndarray | None = None):
        self.queries, self.query_ids, self.data, self.data_ids, self.k = queries, query_ids, data, data_ids, k
        self.least = np.full(len(queries), LOW, np.int64) if least is None else least
        self.scores = np.full((len(queries), k), LOW, np.float64)
        self.ids = np.full((len(queries), k), HIGH, np.int64)
        self.held = np.zeros(len(queries), int)
        self.compared = 0
        if len(queries) and len(data):
            with np.errstate(over="ignore"):
                self.norms = np.sqrt((queries**2).sum(1))
                self.most_q, self.most_d = np.abs(queries).max(1), np.abs(data).max(1)
                if not self.most_q.max() * self.most_d.max() * queries.shape[1] < EXACT:
                    self.scores = np.full((len(queries), k), LOW, np.int64)

    def run(self) -> Search:
        with np.errstate(over="ignore", invalid="ignore"):  # bounds that aren't numbers cut off nothing
            if len(self.queries) and len(self.data):
                self._walk(cover_tree(self.queries, np.arange(len(self.queries)), leaf=QUERY_LEAF), cover_tree(self.data, np.arange(len(self.data))))
        return self

    def found(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Query ids, ids and scores of all that was found."""
        good = np.arange(self.k) < self.held[:, None]
        return np.repeat(self.query_ids, good.sum(1)), self.ids[good], self.scores[good].astype(np.int64)

    def _worst(self, rows: np.ndarray) -> np.ndarray:
        return np.maximum(self.scores[rows, -1], self.least[rows])

    def _bound(self, q: Node, d: Node) -> float:
        most = float(q.center @ d.center) + d.radius * q.norm + q.radius * d.norm + q.radius * d.radius
        return max(float(LOW), most + 1e-9 * (abs(most) + q.norm * d.norm + 1))  # rounding in the radii

    def _walk(self, q: Node, d: Node) -> None:
        if self._bound(q, d) < self._worst(q.rows).min():
            return
        if not q.children and not d.children:
            most = self.queries[q.rows] @ d.center + d.radius * self.norms[q.rows]  # single queries are nodes of radius 0
            most = np.maximum(float(LOW), most + 1e-9 * (np.abs(most) + self.norms[q.rows] * d.norm + 1))
            rows = q.rows[~(most < self._worst(q.rows))]
            for i in range(0, len(d.rows) if len(rows) else 0, 4096):
                self._compare(rows, d.rows[i : i + 4096])
            return
        if q.children and (not d.children or q.radius > d.radius):
            for c in q.children:
                self._walk(c, d)
            return
        for _, _, c in sorted((-self._bound(q, c), i, c) for i, c in enumerate(d.children)):
            self._walk(q, c)

    def _products(self, rows: np.ndarray, others: np.ndarray) -> np.ndarray:
        """Scores of all pairs; for pairs that can't reach the kth score, where float64 isn't exact, something below it."""
        q, d = self.queries[rows], self.data[others]
        close = q @ d.T
        limit = EXACT / q.shape[1]
        if self.most_q[rows].max() * self.most_d[others].max() < limit:
            return close.astype(self.scores.dtype)
        size = self.most_q[rows][:, None] * self.most_d[others][None]
        vague = ~(size < limit)
        out = np.where(vague, 0, close).astype(np.int64)
        out[vague] = LOW
        near = vague & ~(close + size * (q.shape[1] * 1e-12) + 1 < self._worst(rows)[:, None])
        whole = {i: [int(x) for x in q[i]] for i in np.flatnonzero(near.any(1))}
        other = {j: [int(x) for x in d[j]] for j in np.flatnonzero(near.any(0))}
        for i, j in zip(*np.nonzero(near), strict=True):
            out[i, j] = min(max(sum(a * b for a, b in zip(whole[i], other[j], strict=True)), LOW), HIGH)
        return out

    def _compare(self, rows: np.ndarray, others: np.ndarray) -> None:
        self.compared += len(rows) * len(others)
        found = self._products(rows, others)
        own = self.query_ids[rows][:, None] == self.data_ids[others][None]
        found[own] = LOW
        worst = self._worst(rows)
        better = found.max(1) >= worst
        rows, found, own, worst = rows[better], found[better], own[better], worst[better]
        if not len(rows):
            return
        if found.shape[1] > 4 * self.k:  # columns that reach no row's kth score can go
            some = (found >= worst[:, None]).any(0)
            found, own, others = found[:, some], own[:, some], others[some]
        ids = np.where(own, HIGH, self.data_ids[others][None])
        scores = np.concatenate([self.scores[rows], found], axis=1)
        ids = np.concatenate([self.ids[rows], ids], axis=1)
        order = np.lexsort((ids, -scores if scores.dtype == np.float64 else ~scores), axis=1)[:, : self.k]
        self.scores[rows], self.ids[rows] = np.take_along_axis(scores, order, 1), np.take_along_axis(ids, order, 1)
        self.held[rows] = np.minimum(self.k, self.held[rows] + (~own).sum(1))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dim)


def _of_one_length(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, row numbers, vectors) for each length of vectors in the batch."""
    dims = batch.column("dim").to_numpy()
    for dim in np.unique(dims).tolist():
        at = np.flatnonzero(dims == dim)
        yield dim, at, _matrix(batch.column("v").take(pa.array(at)), dim)


def nearest(left: pa.Table, right: pa.Table, k: int = K) -> pa.Table:
    """query_id, vec_id, score: the k best of a data block for each query (vec_id, v, least) of a group."""
    if not len(left) or not len(right):
        return pa.table({n: pa.array([], pa.int64()) for n in ("query_id", "vec_id", "score")})
    dim = left["dim"][0].as_py()
    (q, q_ids), (d, d_ids) = ((_matrix(x["v"].combine_chunks(), dim), x["vec_id"].to_numpy()) for x in (left, right))
    s = Search(q, q_ids, d, d_ids, k, left["least"].to_numpy()).run()
    return pa.table(dict(zip(("query_id", "vec_id", "score"), map(pa.array, s.found()), strict=True)))


def pivots_of(sample: np.ndarray, count: int) -> np.ndarray:
    """So many of the rows at most, each the farthest from those before it."""
    with np.errstate(over="ignore", invalid="ignore"):
        chosen = [int(np.abs(sample - sample.mean(0)).sum(1).argmin())]
        away = ((sample - sample[chosen[0]]) ** 2).sum(1)
        while len(chosen) < count and away.max() > 0:
            chosen.append(int(away.argmax()))
            away = np.minimum(away, ((sample - sample[chosen[-1]]) ** 2).sum(1))
    return sample[chosen]


def choose_pivots(rows: DataFrame, scale: int) -> dict[int, np.ndarray]:
    """Pivots for each length of vectors, as many as it has blocks; one block needs none but the origin."""
    sizes = {r.dim: r.n for r in rows.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).collect()}
    wanted = {dim: min(MOST_PIVOTS, -(-n // DATA_BLOCK)) for dim, n in sizes.items()}
    out = {dim: np.zeros((1, dim)) for dim in wanted}
    several = {dim: min(CHOICE * m, max(m, CHOICE_BYTES // (8 * dim))) for dim, m in wanted.items() if m > 1}
    for dim, most in several.items():
        found = rows.where(F.col("dim") == dim).orderBy(F.xxhash64("vec_id", F.lit(9)), F.xxhash64("v")).limit(most).select("v").toArrow()
        out[dim] = pivots_of(np.floor(_matrix(found["v"].combine_chunks(), dim) * scale), wanted[dim])
    return out


def dealt(rows: DataFrame, pivots: dict[int, np.ndarray], scale: int) -> DataFrame:
    """The rows as whole numbers, with their nearest pivot and their distance from it."""

    def nearest_pivot(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, at, v in _of_one_length(batch):
                with np.errstate(over="ignore", invalid="ignore"):
                    v = np.floor(v * scale)
                    own = pivots[dim]
                    p, away = np.zeros(len(v), np.int32), np.full(len(v), np.inf)
                    for i, c in enumerate(own):
                        d = np.sqrt(((v - c) ** 2).sum(1))
                        p, away = np.where(d < away, i, p).astype(np.int32), np.fmin(away, d)
                part = batch.take(pa.array(at))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(v) + 1, dtype=np.int32) * dim), pa.array(v.ravel()))
                yield pa.RecordBatch.from_pydict({"vec_id": part.column("vec_id"), "v": lists, "dim": part.column("dim"), "_q": part.column("_q"), "_r": part.column("_r"), "p": pa.array(p), "away": pa.array(away)})

    return rows.withColumn("_r", F.monotonically_increasing_id()).mapInArrow(nearest_pivot, "vec_id long, v array<double>, dim int, _q boolean, _r long, p int, away double")


def targets(queries: DataFrame, pivots: dict[int, np.ndarray], blocks: dict[tuple[int, int], tuple[int, float]], first: bool) -> DataFrame:
    """Queries (vec_id, v, dim, least) with the blocks (p, sub) that they go to.

    First that of the pivot that scores best; then, with `least` known, all others whose bound reaches it.
    """

    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, at, q in _of_one_length(batch):
                have = np.array([p for d, p in blocks if d == dim], int)
                subs, radius = np.array([blocks[dim, p][0] for p in have], int), np.array([blocks[dim, p][1] for p in have])
                with np.errstate(over="ignore", invalid="ignore"):
                    close = q @ pivots[dim][have].T
                    best = np.nan_to_num(close, nan=-np.inf).argmax(1)
                    norm, far = np.sqrt((q**2).sum(1))[:, None], np.sqrt((pivots[dim][have] ** 2).sum(1))[None]
                    most = np.maximum(float(LOW), close + radius[None] * norm + 1e-9 * (np.abs(close) + norm * (far + radius[None]) + 1))
                least = batch.column("least").to_numpy()[at]
                for i in range(0, len(at), 256):  # so many queries at a time
                    part = np.arange(i, min(i + 256, len(at)))
                    if first:
                        row, pivot, sub = part, best[part], np.zeros(len(part), int)
                    else:
                        row, pivot = np.nonzero(~(most[part] < least[part][:, None]))
                        row = part[row]
                        n = subs[pivot]
                        row, pivot, sub = np.repeat(row, n), np.repeat(pivot, n), np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                        again = (pivot == best[row]) & (sub == 0)
                        row, pivot, sub = row[~again], pivot[~again], sub[~again]
                    own = batch.take(pa.array(at[row]))
                    yield pa.RecordBatch.from_pydict({"vec_id": own.column("vec_id"), "v": own.column("v"), "dim": own.column("dim"), "least": own.column("least"), "p": pa.array(have[pivot].astype(np.int32)), "sub": pa.array(sub.astype(np.int32))})

    return queries.select("vec_id", "v", "dim", "least").mapInArrow(sent, "vec_id long, v array<double>, dim int, least long, p int, sub int")


def searched(plan: DataFrame, data: DataFrame, k: int) -> DataFrame:
    """query_id, vec_id, score of the k best of each block for each query that the plan sends there."""
    plan = written(plan, "targets")
    groups = plan.groupBy("dim", "p", "sub").agg(F.ceil(F.count(F.lit(1)) / QUERY_BLOCK).cast("int").alias("_groups"))
    keys = ["dim", "p", "sub"]
    left = plan.join(groups, keys).withColumn("g", F.pmod(F.xxhash64("vec_id"), F.col("_groups")).cast("int")).drop("_groups")
    right = data.select("vec_id", "v", *keys).join(groups, keys).withColumn("g", F.explode(F.sequence(F.lit(0), F.col("_groups") - 1))).drop("_groups")

    def search(one: pa.Table, other: pa.Table) -> pa.Table:
        return nearest(one, other, k)

    keys.append("g")
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(search, "query_id long, vec_id long, score long")


def top(vectors: DataFrame, is_query: Column, k: int = K, scale: int = SCALE) -> DataFrame:
    """query_id, rank, vec_id, score of the k best rows for each query row.

    `vectors` has vec_id and embedding. Blocks that no bound rules out meet every query that asks for
    them: that product is the search itself; all else grows with the input.
    """
    spark = vectors.sparkSession
    plain_unions(spark)
    x = F.col("embedding").cast("array<double>")
    whole = F.forall(x, lambda y: y.isNotNull() & ~F.isnan(y) & (F.abs(y * scale) < float("inf")))
    rows = vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0)).where(whole)
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("v"), F.size("embedding").alias("dim"), is_query.alias("_q"))
    pivots = choose_pivots(rows, scale)
    data = written(dealt(rows, pivots, scale), "dealt")
    stats = data.groupBy("dim", "p").agg(F.count(F.lit(1)).alias("n"), F.max("away").alias("r")).collect()
    blocks = {(r.dim, r.p): (-(-r.n // DATA_BLOCK), r.r * (1 + 1e-9)) for r in stats}
    subs = spark.createDataFrame([(*key, n) for key, (n, _) in blocks.items()], "dim int, p int, _subs int")
    data = data.join(F.broadcast(subs), ["dim", "p"]).withColumn("sub", F.pmod(F.xxhash64("vec_id", "_r"), F.col("_subs")).cast("int")).drop("_subs")
    one = F.row_number().over(Window.partitionBy("vec_id").orderBy("dim", F.xxhash64("v")))
    queries = written(data.where("_q").withColumn("_k", one).where("_k = 1").select("vec_id", "v", "dim", F.lit(LOW).cast("long").alias("least")), "queries")
    found = searched(targets(queries, pivots, blocks, True), data, k)
    if len(blocks) > len(pivots) or any(n > 1 for n, _ in blocks.values()):
        found = written(found, "found")
        least = found.groupBy(F.col("query_id").alias("_i")).agg(F.count(F.lit(1)).alias("_n"), F.min("score").alias("_least")).where(F.col("_n") >= k)
        known = queries.drop("least").join(least, F.col("vec_id") == F.col("_i"), "left").withColumn("least", F.coalesce("_least", F.lit(LOW).cast("long")))
        found = found.unionAll(searched(targets(known, pivots, blocks, False), data, k))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op9_dual_cover_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 best other rows for every 50th row of the embeddings."""
    return top(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, d.vec_id, CAST(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * d.v[i])) AS BIGINT) AS score
  FROM v q JOIN v d ON q.vec_id <> d.vec_id AND len(q.v) = len(d.v) WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
"""
