"""N-gram Jaccard join with adaptive multi-match prefixes.

Documents with equal shingle sets form classes first, and one row of each class goes on. Shingles have
a global order: how often they occur in all documents, as estimated by a counting table of fixed size
that every document is counted into, then their hash. Any order gives exact results; a good one puts
frequent shingles last. If two sets of sizes a and b reach the similarity, they share at least
`least(a)` shingles, so with prefixes of size a - least(a) + l they share at least l prefix shingles.
Each document takes the l of least estimated cost - shared prefix shingles to count, candidates to
verify - and a pair is a candidate if it shares as many prefix shingles as the smaller of its two l.

Candidates come from runs of rows with the same prefix shingle. Pairs are counted in short runs. In a
longer run counting would list all its pairs, so its rows are linked with a few leaders instead, which
keeps every pair that the run holds in one cluster: a chain of leaders over sizes that could match,
and where the counting table shows a shingle to be hot, its run is read in pieces by many tasks, whose
leaders are linked in turn.

Candidate links make clusters, and documents of a cluster are verified on whole sets in tiles of bounded
size. To count links, all pairs of tiles of a cluster are compared. For components alone that isn't
needed: each tile is compared within itself and with a few leaders of its cluster, which joins up a
large group of near copies in work proportional to its size; then only documents still outside their
cluster's largest component are compared, with those of sizes that could match. No pair that could join
two components is left out, and what comes out per tile is at most one row per document.

Defined results: null and blank texts have no shingles and are linked with nothing; fewer words than a
shingle are one shingle; equal rows are one class; rows that share an id share its component; rows of
null id have a null component; of shingles of equal count that of smaller hash comes first, and any
order gives the same result; a text of any length is one set, held by one task at a time. An empty
table gives an empty result. Extra columns don't matter: only id and text are read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.ranks import plain_unions, spread_join
from .common import dropped, fresh, small_batches, table, written
from .graph import components
from .shingles import Shingler

#: Similarity in percent.
PERCENT = 80
#: The counting table has 2 ** COUNT_BITS counters, more for more rows, up to 2 ** MOST_COUNT_BITS (64 MB
#: when sent out), and is sent about in pieces.
COUNT_BITS, MOST_COUNT_BITS, PIECE = 20, 24, 1 << 12
#: Runs of up to so many rows are paired up; shingles counted more often than HOT_RUN
#: are read in HOT_SALTS pieces.
SHORT_RUN, HOT_RUN, HOT_SALTS = 48, 1024, 64
#: Cost model: candidates that a prefix shingle brings though the counting table can't show it, and the
#: cost of verifying one shingle in units of counting one prefix shingle.
UNSEEN, VERIFY = 0.02, 0.1
#: Documents of a verification tile, and leaders that each tile of a larger cluster is compared with.
TILE, LEADERS = 128, 8
#: Bits per id of the filter that keeps documents without candidates from being read again, and bounds of its size (32 MB).
FILTER_EACH, LEAST_FILTER_BITS, MOST_FILTER_BITS = 16, 16, 28


def least(n: int, percent: int = PERCENT) -> int:
    """Shingles that a set of n shares at least with any similar one."""
    return -(-n * percent // 100)


def profile(docs: DataFrame, percent: int = PERCENT) -> tuple[DataFrame, np.ndarray]:
    """doc_id, n and digest (d1, d2) of every row, and the counting table over all of them."""
    small_batches(docs.sparkSession)
    bits = min(MOST_COUNT_BITS, max(COUNT_BITS, docs.count().bit_length() + 1))

    def profiled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, counts = Shingler(), np.zeros(1 << bits, np.uint32)
        for batch in batches:
            sets = shingler.sets(batch.column("text").to_pylist())
            for s in sets:
                np.add.at(counts, s >> np.uint64(64 - bits), np.uint32(1))
            digests = np.frombuffer(b"".join(hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets), np.int64).reshape(-1, 2)
            none = pa.nulls(len(sets), pa.int32()), pa.nulls(len(sets), pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(digests[:, 0]), pa.array(digests[:, 1]), *none], names=names)
        pieces = [i for i in range(0, 1 << bits, PIECE) if counts[i : i + PIECE].any()]
        none = [pa.nulls(len(pieces), pa.int64())] * 4
        yield pa.RecordBatch.from_arrays([*none, pa.array([i // PIECE for i in pieces], pa.int32()), pa.array([counts[i : i + PIECE].tobytes() for i in pieces], pa.binary())], names=names)

    names = ["doc_id", "n", "d1", "d2", "piece", "counts"]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = written(rows.mapInArrow(profiled, "doc_id long, n long, d1 long, d2 long, piece int, counts binary"), "profile")

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for piece, counts in zip(batch.column("piece").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                more = np.frombuffer(counts, np.uint32)
                total[piece] = total.get(piece, 0) + more.astype(np.uint64)
        for piece, counts in total.items():
            yield pa.RecordBatch.from_pydict({"piece": pa.array([piece], pa.int32()), "counts": pa.array([counts.tobytes()], pa.binary())})

    counts = np.zeros(1 << bits, np.uint64)
    for r in rows.where("piece IS NOT NULL").select("piece", "counts").repartition("piece").mapInArrow(summed, "piece int, counts binary").collect():
        counts[r.piece * PIECE : (r.piece + 1) * PIECE] = np.frombuffer(r.counts, np.uint64)
    return rows.where("piece IS NULL").select("doc_id", "n", "d1", "d2"), counts


def prefix(s: np.ndarray, counts: np.ndarray, usual: float, percent: int = PERCENT) -> tuple[int, np.ndarray]:
    """The multi-match l of least estimated cost and the prefix that goes with it."""
    f = counts[s >> np.uint64(65 - len(counts).bit_length())]
    order = np.lexsort((s, f))
    n, need = len(s), least(len(s), percent)
    matches = np.unique(np.geomspace(1, max(1, need // 4), 24).astype(int))
    seen = np.maximum(f[order].astype(np.float64) - 2 * usual, 0)  # beyond what chance puts into a counter
    sizes = n - need + matches
    partners = np.cumsum(seen + UNSEEN)[sizes - 1]
    cost = sizes + np.cumsum(seen)[sizes - 1] + VERIFY * n * partners / matches
    chosen = int(matches[cost.argmin()])
    return chosen, s[order[: n - need + chosen]]


def candidates(docs: DataFrame, rows: DataFrame, counts: np.ndarray, percent: int = PERCENT, exact: bool = True) -> DataFrame:
    """Links (a, b) that put every candidate pair into one cluster.

    Each class of equal sets goes in with its least row. Unless that must be exact, some few others come
    along that a filter lets through: they are linked with the least row, so components stay the same.
    """
    spark = docs.sparkSession
    usual = float(counts.mean())
    shared = spark.sparkContext.broadcast(counts.astype(np.uint32 if counts.max() < 1 << 32 else np.uint64))
    hot_from = HOT_RUN + 2 * usual  # as a counter may hold so much by chance
    reps = written(rows.where("n > 0 AND doc_id IS NOT NULL").groupBy("d1", "d2").agg(F.min("doc_id").alias("rep")).select(F.col("rep").alias("id")), "classes")
    place, inside = members(docs, reps)

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler()
        for batch in batches:
            batch = batch.filter(pa.array(inside(batch.column("_place"))))
            ids, ns, ls, tokens, hot = [], [], [], [], []
            for i, s in zip(batch.column("doc_id").to_pylist(), shingler.sets(batch.column("text").to_pylist()), strict=True):
                if len(s):
                    enough, own = prefix(s, shared.value, usual, percent)
                    often = shared.value[own >> np.uint64(65 - len(shared.value).bit_length())] > hot_from
                    ids.append(i), ns.append(len(s)), ls.append(enough), tokens.append(own.view(np.int64)), hot.append(often)
            yield pa.RecordBatch.from_pydict({"doc_id": pa.array(ids, pa.int64()), "n": pa.array(ns, pa.int32()), "l": pa.array(ls, pa.int32()), "tokens": pa.array(tokens, pa.list_(pa.int64())), "hot": pa.array(hot, pa.list_(pa.bool_()))})

    found = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), "text", place.alias("_place"))
    found = found.mapInArrow(prefixes, "doc_id long, n int, l int, tokens array<long>, hot array<boolean>")
    if exact:
        found = found.join(reps, F.col("doc_id") == F.col("id"), "left_semi")
    found = found.select("hot", F.posexplode("tokens").alias("_at", "token"), "doc_id", "n", "l")
    salt = F.when(F.get("hot", F.col("_at")), F.pmod(F.xxhash64("doc_id"), F.lit(HOT_SALTS))).otherwise(-1).cast("int")
    found = found.select("token", "doc_id", "n", "l", salt.alias("salt")).repartition("token", "salt").sortWithinPartitions("token", "salt", "n", "doc_id")

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return Runs(percent).all(batches)

    links = found.mapInArrow(runs, "a long, b long, shared long, needed int, head boolean")
    links = links.groupBy("a", "b", "head").agg(F.sum("shared").alias("shared"), F.min("needed").alias("needed"))
    links = written(links.where("head OR shared >= needed").select("a", "b", "needed", "head"), "candidates")
    heads = links.where("head").select(F.col("a").alias("token"), F.col("b").alias("doc_id"), band_of(F.col("needed"), percent).alias("band"))
    if heads.limit(1).count() == 0:
        return links
    out = written(links.where("NOT head").select("a", "b").unionAll(head_links(heads)), "candidates")
    dropped(links)
    return out


def band_of(n: Column, percent: int) -> Column:
    """A set's band of sizes: those of similar sets are the same or next to each other."""
    return F.floor(F.log(n.cast("double")) / math.log(100 / percent * (1 + 1e-6))).cast("int") if percent < 100 else n.cast("int")


def head_links(heads: DataFrame) -> DataFrame:
    """Links (a, b) of the leaders (token, doc_id, band) of a hot shingle: with the least of their band, and those of bands up to two apart.

    A row is at most a band above its leader, so leaders of similar rows are at most two bands apart.
    """
    least = heads.groupBy("token", "band").agg(F.min("doc_id").alias("least")).select(F.col("token").alias("_t"), F.col("band").alias("_b"), "least")
    near = heads.withColumn("below", F.explode(F.array(*[F.col("band") - k for k in range(3)])))
    return near.join(least, (F.col("token") == F.col("_t")) & (F.col("below") == F.col("_b"))).select(F.col("doc_id").alias("a"), F.col("least").alias("b")).distinct()


class Runs:
    """Reads rows sorted by (token, salt, n, doc_id) and gives links of the runs of equal tokens.

    Rows are (token, doc_id, n, l, salt). A salt of 0 or more marks a piece of a hot token's run: it is
    long, however few rows it has, and its leaders come out too, as (token, leader, 0, n, True).
    """

    SCHEMA = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("shared", pa.int64()), ("needed", pa.int32()), ("head", pa.bool_())])
    FLUSH = 1 << 18

    def __init__(self, percent: int):
        self.percent = percent
        self.pairs: list[np.ndarray] = []
        self.heads: list[tuple[int, int, int]] = []
        self.held = 0

    def _give(self) -> Iterator[pa.RecordBatch]:
        if self.heads:
            tokens, leaders, ns = zip(*self.heads, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(tokens, pa.int64()), pa.array(leaders, pa.int64()), pa.array([0] * len(ns), pa.int64()), pa.array(ns, pa.int32()), pa.array([True] * len(ns))], schema=self.SCHEMA)
            self.heads = []
        if not self.pairs:
            return
        rows = np.concatenate(self.pairs)
        self.pairs, self.held = [], 0
        rows = rows[np.lexsort((rows[:, 1], rows[:, 0]))]
        first = np.flatnonzero(np.concatenate([[True], (rows[1:, :2] != rows[:-1, :2]).any(1)]))
        shared, needed = np.add.reduceat(rows[:, 2], first), np.minimum.reduceat(rows[:, 3], first)
        yield pa.RecordBatch.from_arrays([pa.array(rows[first, 0]), pa.array(rows[first, 1]), pa.array(shared), pa.array(needed.astype(np.int32)), pa.array(np.zeros(len(first), bool))], schema=self.SCHEMA)

    def _add(self, a: np.ndarray, b: np.ndarray, shared: int, needed: np.ndarray | int) -> None:
        keep = a != b
        if keep.any():
            rows = np.empty((int(keep.sum()), 4), np.int64)
            rows[:, 0], rows[:, 1], rows[:, 2] = np.minimum(a, b)[keep], np.maximum(a, b)[keep], shared
            rows[:, 3] = needed[keep] if isinstance(needed, np.ndarray) else needed
            self.pairs.append(rows)
            self.held += len(rows)

    def all(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = np.zeros((5, 0), np.int64)
        chain = None  # ((token, salt), leader, its n, last row, its n) of a long run that goes on
        for batch in batches:
            own = [batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(batch.num_columns)]
            rows = np.concatenate([rest, np.stack([*own, np.full(batch.num_rows, -1)][:5])], axis=1)
            if not rows.shape[1]:
                continue
            starts = np.flatnonzero(np.concatenate([[True], (rows[::4, 1:] != rows[::4, :-1]).any(0)]))
            stops = np.append(starts[1:], rows.shape[1])
            sizes = stops - starts
            if chain and chain[0] != (rows[0, 0], rows[4, 0]):
                chain = None
            long = (sizes > SHORT_RUN) | (rows[4, starts] >= 0)
            long[0] |= chain is not None
            open_from = rows.shape[1] if long[-1] else starts[-1]  # the last short run may go on
            for k in np.flatnonzero(long):
                chain = self._chain(rows[:, starts[k] : stops[k]], chain if chain and chain[0] == (rows[0, starts[k]], rows[4, starts[k]]) else None)
            closed = ~long
            closed[-1] = False
            self._short(rows, starts[closed], sizes[closed])
            rest = rows[:, open_from:]
            if self.held + len(self.heads) >= self.FLUSH:
                yield from self._give()
        if rest.shape[1]:
            self._short(rest, np.zeros(1, np.int64), np.array([rest.shape[1]]))
        yield from self._give()

    def _short(self, rows: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> None:
        for size in np.unique(sizes):
            if size < 2:
                continue
            at = starts[sizes == size]
            i, j = np.triu_indices(size, 1)
            x, y = (at[:, None] + i).ravel(), (at[:, None] + j).ravel()
            fits = 100 * rows[2, x] >= self.percent * rows[2, y]  # rows of a run rise by n
            x, y = x[fits], y[fits]
            self._add(rows[1, x], rows[1, y], 1, np.minimum(rows[3, x], rows[3, y]))

    def _chain(self, rows: np.ndarray, chain: tuple | None) -> tuple:
        key, docs, ns = (rows[0, 0], rows[4, 0]), rows[1], rows[2]
        if chain is None:
            chain = key, docs[0], ns[0], docs[0], ns[0]
            self._lead(key, docs[0], ns[0])
        leader, leader_n, last, last_n = chain[1:]
        at = 0
        while at < len(docs):
            end = int(np.searchsorted(ns, 100 * leader_n // self.percent, "right"))
            if end > at:
                self._add(np.full(end - at, leader), docs[at:end], 0, 0)
                at, last, last_n = end, docs[end - 1], ns[end - 1]
            if at < len(docs):
                if 100 * last_n >= self.percent * ns[at]:
                    self._add(np.array([last]), docs[at : at + 1], 0, 0)
                leader, leader_n, last, last_n = docs[at], ns[at], docs[at], ns[at]
                self._lead(key, leader, leader_n)
                at += 1
        return key, leader, leader_n, last, last_n

    def _lead(self, key: tuple, leader: int, n: int) -> None:
        if key[1] >= 0:
            self.heads.append((int(key[0]), int(leader), int(n)))


def member_filter(ids: DataFrame, bits: int) -> np.ndarray:
    """A filter of 2 ** bits places over the ids' hashes, built by the JVM; what it lets through may be too much, never too little."""
    place = F.pmod(F.xxhash64("id"), F.lit(1 << bits))
    parts = ids.select(F.bitmap_bucket_number(place).alias("k"), F.bitmap_bit_position(place).alias("p")).groupBy("k").agg(F.bitmap_construct_agg("p").alias("m")).collect()
    out = np.zeros((1 << bits) // 8 + 4096, np.uint8)
    for r in parts:  # bucket 0 holds place 0 alone, bucket 1 the next 32768 places
        out[r.k * 4096 : (r.k + 1) * 4096] = np.frombuffer(r.m, np.uint8)
    return out


def members(docs: DataFrame, ids: DataFrame) -> tuple[Column, Callable[[pa.Array], np.ndarray]]:
    """A column of a row's place in the filter over `ids` (column id), and a function that tells for such places what passes."""
    size = min(MOST_FILTER_BITS, max(LEAST_FILTER_BITS, (FILTER_EACH * ids.count()).bit_length()))
    bits = docs.sparkSession.sparkContext.broadcast(member_filter(ids, size))

    def inside(places: pa.Array) -> np.ndarray:
        place = places.fill_null(0).to_numpy()
        # bitmap_bucket_number(x) is 1 + (x - 1) // 32768 for x > 0, else 0; bitmap_bit_position(x) is (x - 1) % 32768, or 0
        bucket, bit = np.where(place > 0, 1 + (place - 1) // 32768, 0), np.where(place > 0, (place - 1) % 32768, 0)
        return (bits.value[bucket * 4096 + bit // 8] >> (bit % 8).astype(np.uint8) & 1).astype(bool)

    return F.pmod(F.xxhash64(F.col("doc_id").cast("long")), F.lit(1 << size)), inside


def without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows whose doc_id isn't in `ids` (column id).

    Rows that the filter doesn't let through can't be among them and stay where they are; only the
    rest, about as many as there are ids, is shuffled for the exact join.
    """
    small_batches(docs.sparkSession)
    plain_unions(docs.sparkSession)
    own = fresh(docs, "_id")
    place, inside = members(docs, ids)

    def passing(wanted: bool) -> DataFrame:
        def passed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                last = batch.num_columns - 1
                yield batch.filter(pa.array(inside(batch.column(last)) == wanted)).select(list(range(last)))

        return docs.select("*", place.alias(fresh(docs, "_place"))).mapInArrow(passed, docs.schema)

    return passing(False).union(passing(True).join(ids.withColumnRenamed("id", own), F.col("doc_id") == F.col(own), "left_anti"))


def sets_of(docs: DataFrame, clusters: DataFrame) -> DataFrame:
    """c, m (the cluster's documents), doc_id, n, shingles of every document of a cluster (node, component), written down."""
    counted = clusters.groupBy("component").agg(F.count(F.lit(1)).alias("m")).withColumnRenamed("component", "_c")
    of = spread_join(clusters, counted, "component", "_c", ["node"])
    place, inside = members(docs, clusters.select(F.col("node").alias("id")))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler()
        for batch in batches:
            batch = batch.filter(pa.array(inside(batch.column("_place"))))
            found = shingler.sets(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "n": pa.array([len(s) for s in found], pa.int64()), "shingles": pa.array([s.tobytes() for s in found], pa.binary())})

    wanted = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), "text", place.alias("_place"))
    wanted = wanted.mapInArrow(sets, "doc_id long, n long, shingles binary").where("n > 0")
    return written(wanted.join(of, F.col("doc_id") == F.col("node")).select(F.col("component").alias("c"), "m", "doc_id", "n", "shingles"), "sets")


def tile_of(count: Column) -> tuple[Column, Column]:
    """How many tiles so many documents make, and which of them a document is in."""
    tiles = F.ceil(count / TILE).cast("int")
    return tiles, F.pmod(F.xxhash64("doc_id"), tiles).cast("int")


def all_links(sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """a, b, links: for every pair of tiles of a cluster, each linked document with one of its group there and its number of links."""
    tiles, t = tile_of(F.col("m"))
    pair = F.transform(F.sequence(F.lit(0), F.col("tiles") - 1), lambda o: F.struct(F.least(F.col("t"), o).alias("t1"), F.greatest(F.col("t"), o).alias("t2")))
    rows = sets.select("c", tiles.alias("tiles"), t.alias("t"), "doc_id", "shingles")
    rows = rows.select("c", F.explode(pair).alias("p"), "t", "doc_id", "shingles").select("c", "p.t1", "p.t2", "t", "doc_id", "shingles")

    def matched(group: pa.Table) -> pa.Table:
        return matches(group, percent, "t" if group["t1"][0].as_py() != group["t2"][0].as_py() else None)

    return rows.groupBy("c", "t1", "t2").applyInArrow(matched, "a long, b long, links long")


def joining_links(sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """a, b: links between documents of a cluster, enough of them to join up all that links join up."""
    tiles, t = tile_of(F.col("m"))
    large = sets.where(F.col("m") > TILE)
    several = large.limit(1).count() > 0
    rows = sets.select("c", (F.col("m") > TILE).alias("large"), t.alias("t"), "doc_id", "shingles")
    if several:
        rank = F.row_number().over(Window.partitionBy("c").orderBy(F.xxhash64("doc_id", F.lit(1)), "doc_id"))
        leaders = large.select("c", "doc_id").withColumn("_k", rank).where(F.col("_k") <= LEADERS).select(F.col("doc_id").alias("_lead"))
        lead = large.join(leaders, F.col("doc_id") == F.col("_lead"), "left_semi").select("c", F.lit(True).alias("large"), t.alias("own"), F.explode(F.sequence(F.lit(0), tiles - 1)).alias("t"), "doc_id", "shingles")
        rows = rows.unionAll(lead.where("t <> own").select("c", "large", "t", "doc_id", "shingles"))

    def within(group: pa.Table) -> pa.Table:
        found = matches(group, percent)
        return pa.table({"a": found["a"], "b": found["b"], "large": pa.array([group["large"][0].as_py()] * len(found), pa.bool_())})

    edges = written(rows.groupBy("c", "t").applyInArrow(within, "a long, b long, large boolean"), "links")
    if not several:
        return edges.select("a", "b")
    labels = components(edges.where("large").select("a", "b"))
    ids = large.select("c", "doc_id", "n").join(labels, F.col("doc_id") == F.col("node"), "left")
    ids = written(ids.select("c", "doc_id", "n", F.coalesce("component", "doc_id").alias("q")), "labels")
    apart = ids.groupBy("c", "q").agg(F.count(F.lit(1)).alias("k")).groupBy(F.col("c").alias("_c"))
    apart = written(apart.agg(F.max_by("q", F.struct("k", "q")).alias("_main"), F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n"), "apart")
    if apart.count() == 0:
        return edges.select("a", "b")
    ids = spread_join(ids, apart, "c", "_c", ["doc_id"]).select("c", "doc_id", "q", band_of(F.col("n"), percent).alias("band"), (F.col("q") == F.col("_main")).alias("main"))
    placed = met(ids).join(large.select(F.col("doc_id").alias("_d"), "shingles"), F.col("doc_id") == F.col("_d")).drop("_d")

    def between(group: pa.Table) -> pa.Table:
        return matches(group, percent, "q").select(["a", "b"])

    more = placed.groupBy("c", "bu", "bv", "vmain", "tu", "tv").applyInArrow(between, "a long, b long")
    return edges.select("a", "b").unionAll(more)


def met(ids: DataFrame) -> DataFrame:
    """The documents (c, doc_id, q, band, main) in every meeting (c, bu, bv, vmain, tu, tv) of two tiles of similar sizes.

    One tile holds documents outside the cluster's main component; the other any. Both may be the same.
    """
    units = written(ids.groupBy("c", "band", "main").agg(tile_of(F.count(F.lit(1)))[0].alias("tiles")), "units")
    one = units.where("NOT main").select("c", F.col("band").alias("bu"), F.col("tiles").alias("ut"))
    other = units.select(F.col("c").alias("_c"), F.col("band").alias("bv"), F.col("main").alias("vmain"), F.col("tiles").alias("vt"))
    pairs = one.join(other, (F.col("c") == F.col("_c")) & (F.abs(F.col("bu") - F.col("bv")) <= 1) & (F.col("vmain") | (F.col("bv") >= F.col("bu"))))
    same = ~F.col("vmain") & (F.col("bu") == F.col("bv"))
    unit = lambda band, main: F.struct(F.col("c"), F.col(band).alias("band"), main.alias("main"))
    named = F.struct("c", "bu", "bv", "vmain").alias("meeting")
    left = pairs.select(unit("bu", F.lit(False)).alias("_unit"), named, F.col("ut").alias("own"), F.col("vt").alias("others"), F.when(same, 2).otherwise(0).alias("role"))
    right = pairs.where(~same).select(unit("bv", F.col("vmain")).alias("_unit"), named, F.col("vt").alias("own"), F.col("ut").alias("others"), F.lit(1).alias("role"))
    rows = spread_join(ids.select("doc_id", "q", F.struct("c", "band", "main").alias("unit")), left.unionAll(right), "unit", "_unit", ["doc_id"])
    rows = rows.withColumn("t", F.pmod(F.xxhash64("doc_id"), F.col("own")).cast("int")).withColumn("o", F.explode(F.sequence(F.lit(0), F.col("others") - 1)))
    first = F.when(F.col("role") == 0, F.col("t")).when(F.col("role") == 1, F.col("o")).otherwise(F.least("t", "o"))
    second = F.when(F.col("role") == 0, F.col("o")).when(F.col("role") == 1, F.col("t")).otherwise(F.greatest("t", "o"))
    return rows.select("meeting.*", first.alias("tu"), second.alias("tv"), "doc_id", "q")


def matches(group: pa.Table, percent: int = PERCENT, apart: str | None = None) -> pa.Table:
    """Linked documents (a) of a group with one that they are joined up with (b) and their number of links, by counting the shingles that pairs share.

    With `apart`, pairs that have the same value in that column don't count.
    """
    ids = group["doc_id"].to_numpy()
    sets = [np.frombuffer(s.as_py(), np.uint64) for s in group["shingles"]]
    sizes = np.array([len(s) for s in sets])
    _, place, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(sets)), sizes)
    often = count[place] > 1
    renamed = np.cumsum(count > 1) - 1
    column, owner = renamed[place[often]], owner[often]
    width = int((count > 1).sum())
    shared = np.zeros((len(sets), len(sets)), np.float32)
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    step = max(64, (1 << 21) // max(1, len(sets)))
    for a in range(0, width, step):
        x, y = np.searchsorted(column, [a, a + step])
        m = np.zeros((len(sets), min(step, width - a)), np.float32)
        m[owner[x:y], column[x:y] - a] = 1
        shared += m @ m.T
    shared = shared.astype(np.int64)
    linked = 100 * shared >= percent * (sizes[:, None] + sizes[None] - shared)
    linked &= (sizes > 0)[:, None] & (sizes > 0)[None]
    np.fill_diagonal(linked, False)
    if apart:
        kind = group[apart].to_numpy()
        linked &= kind[:, None] != kind[None]
    label = np.arange(len(sets))
    while True:
        lower = np.minimum(label, np.where(linked, label[None], len(sets)).min(1))
        lower = lower[lower]
        if (lower == label).all():
            break
        label = lower
    some = linked.any(1)
    return pa.table({"a": pa.array(ids[some], pa.int64()), "b": pa.array(ids[label[some]], pa.int64()), "links": pa.array(linked.sum(1)[some], pa.int64())})


def join(docs: DataFrame, percent: int = PERCENT, links: bool = True) -> DataFrame:
    """doc_id, n_shingles, component_id and, unless that is left out, links (to other classes of texts) of every row.

    Counting links compares all pairs of a cluster; without it, work follows the clusters' sizes.
    """
    plain_unions(docs.sparkSession)
    rows, counts = profile(docs, percent)
    near = candidates(docs, rows, counts, percent, exact=links)
    clusters = written(components(near), "clusters")
    sets = sets_of(docs, clusters)
    edges = written((all_links if links else joining_links)(sets, percent), "links")
    dropped(near, clusters, sets)
    found = components(edges.select("a", "b"))
    digest = F.struct("d1", "d2")
    classes = rows.where("n > 0").groupBy("d1", "d2").agg(F.min("doc_id").alias("rep")).join(found, F.col("rep") == F.col("node"), "left")
    classes = classes.select(digest.alias("_class"), "rep", F.coalesce("component", "rep").alias("_c"))
    if links:
        counted = edges.groupBy(F.col("a").alias("_l")).agg(F.sum("links").alias("links"))
        classes = classes.join(counted, F.col("rep") == F.col("_l"), "left")
    out = spread_join(rows.withColumn("_digest", digest), classes, "_digest", "_class", ["doc_id"], "left")
    component = F.when(F.col("n") > 0, F.when(F.col("doc_id").isNotNull(), F.col("_c"))).otherwise(F.col("doc_id")).alias("component_id")
    return out.select("doc_id", F.col("n").alias("n_shingles"), component, *([F.coalesce("links", F.lit(0)).alias("links")] if links else []))


def op7_adaptive_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's set size and component."""
    return join(table(spark, sf_dir, "documents"), links=False)


ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))) END AS s
  FROM w),
e AS (SELECT doc_id, unnest(s) AS x, len(s) AS n FROM s),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.x = b.x AND a.doc_id <> b.doc_id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
reach AS (
  SELECT doc_id AS a, doc_id AS b FROM s
  UNION
  SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, (SELECT min(b) FROM reach r WHERE r.a = s.doc_id) AS component_id
FROM s
"""
