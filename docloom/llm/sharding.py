"""Sharding by fixed virtual slots (DataFrame functions only).

A record's virtual slot is a hash of its id, its text's checksum and its size, and never changes. Bytes
are summed up per slot, and a versioned table maps slots to shards. Where there is none yet, version 1
is made from scratch; else the latest version is edited for the rows' totals and the number of shards,
which moves only the slots that the balance needs, and written as the next one. Records never move
between slots, and a version that is there is never written over.

Neither a null id nor one that many rows bear makes a slot heavy, as their texts tell them apart. Rows
equal in all three are counted before anything is shuffled and go on as groups of at most RUN copies,
each with a slot of its own; the copies come apart again at the end.

Defined results: a null text has 0 bytes (size 16); a null id is an id like any other; equal rows get
positions of their own; a text of any length is one record of its size, so a shard is at least as heavy
as its heaviest record; ties in a slot's order are between equal rows; an empty table gives an empty
result; a stored map of another number of slots raises. A version counts once it is written whole, one
that was only begun is passed over, and of two runs that edit one map at a time the later one fails. Extra columns don't matter: only id and
text are read.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import listed, scratch, table, written

SHARDS = 40
#: Fixed for the life of a data set. The driver holds one count and one sum for each.
SLOTS = 8192
#: Bytes that each record takes besides its text.
OVERHEAD = 16
#: Equal rows that share a virtual slot at most.
RUN = 64


def slotted(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """doc_id, size, text_crc32, copies and the virtual slot of every group of equal rows."""
    rows = docs.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + OVERHEAD).cast("long").alias("size"),
        F.crc32(F.encode(F.coalesce("text", F.lit("")), "UTF-8")).alias("text_crc32"),
    )
    rows = rows.groupBy("doc_id", "size", "text_crc32").agg(F.count(F.lit(1)).alias("n"))
    runs = F.when(F.col("n") == 1, F.array(F.lit(0).cast("long"))).otherwise(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / RUN)))
    rows = rows.select("doc_id", "size", "text_crc32", "n", F.explode(runs).alias("_run"))
    copies = F.least(F.lit(RUN).cast("long"), F.col("n") - F.col("_run") * RUN)
    slot = F.pmod(F.xxhash64("doc_id", "text_crc32", "size", "_run"), F.lit(slots)).cast("int")
    return rows.select("doc_id", "size", "text_crc32", copies.alias("copies"), slot.alias("vslot"))


def slot_totals(rows: DataFrame, slots: int = SLOTS) -> tuple[list[int], list[int]]:
    """Rows and bytes of every virtual slot: two lists as long as there are slots, whatever the input."""
    counts, sizes = [0] * slots, [0] * slots
    for r in rows.groupBy("vslot").agg(F.sum("copies").alias("n"), F.sum(F.col("size") * F.col("copies")).alias("b")).collect():
        counts[r.vslot], sizes[r.vslot] = r.n, r.b
    return counts, sizes


def assign(sizes: list[int], shards: int) -> list[int]:
    """Version 1 of the map: slots by falling bytes, each to the shard with least so far."""
    heap, out = [(0, s) for s in range(shards)], [0] * len(sizes)
    for slot in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        load, shard = heapq.heappop(heap)
        out[slot] = shard
        heapq.heappush(heap, (load + sizes[slot], shard))
    return out


def rebalance(sizes: list[int], was: list[int], shards: int, tolerance: float = 0.01) -> list[int]:
    """The next version: slots of shards that are gone go to the least loaded; others move only from shards above the mean, never to below it, and to the least loaded, until all are within tolerance."""
    now = list(was)
    load = [0] * shards
    held: list[list[int]] = [[] for _ in range(shards)]
    gone = sorted((slot for slot, shard in enumerate(now) if shard >= shards), key=lambda i: (-sizes[i], i))
    for slot, shard in enumerate(now):
        if shard < shards:
            load[shard] += sizes[slot]
            held[shard].append(slot)
    heap = [(n, shard) for shard, n in enumerate(load)]
    heapq.heapify(heap)
    for slot in gone:
        _, shard = heapq.heappop(heap)
        now[slot] = shard
        load[shard] += sizes[slot]
        held[shard].append(slot)
        heapq.heappush(heap, (load[shard], shard))
    mean = sum(sizes) / shards
    for shard in sorted(range(shards), key=lambda s: -load[s]):
        for slot in sorted(held[shard], key=lambda i: (-sizes[i], i)):
            if load[shard] <= mean * (1 + tolerance):
                break
            to = min(range(shards), key=lambda s: (load[s], s))
            if 0 < sizes[slot] <= load[shard] - mean and load[to] + sizes[slot] <= mean * (1 + tolerance):
                now[slot] = to
                load[shard] -= sizes[slot]
                load[to] += sizes[slot]
    return now


def stored(spark: SparkSession, path: str, version: int, shard_of: list[int], sizes: list[int], counts: list[int]) -> DataFrame:
    """Write one version of the slot map beside the earlier ones and read it back; fails if it is there."""
    rows = listed(spark, vslot=list(range(len(shard_of))), shard=shard_of, bytes=sizes, first=offsets(shard_of, counts))
    rows.select(F.col("vslot").cast("int"), F.col("shard").cast("int"), "bytes", "first").write.parquet(f"{path}/version={version}")
    return spark.read.parquet(f"{path}/version={version}")


def latest(spark: SparkSession, path: str, whole: bool = True) -> int:
    """The last version of the slot map that was written whole (or begun), 0 if there is none."""
    base = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/version=*{'/_SUCCESS' if whole else ''}")
    found = base.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(base)
    names = [(f.getPath().getParent() if whole else f.getPath()).getName() for f in found or []]
    return max((int(n.split("=")[1]) for n in names), default=0)


def shards_of(spark: SparkSession, path: str, version: int, slots: int) -> list[int]:
    """A stored version of the map: the shard of each slot."""
    rows = {r.vslot: r.shard for r in spark.read.parquet(f"{path}/version={version}").select("vslot", "shard").collect()}
    if sorted(rows) != list(range(slots)):
        raise ValueError(f"the slot map of {path} hasn't {slots} slots")
    return [rows[i] for i in range(slots)]


def offsets(shard_of: list[int], counts: list[int]) -> list[int]:
    """Where each slot's rows begin within their shard."""
    filled: dict[int, int] = {}
    out = []
    for shard, n in zip(shard_of, counts, strict=True):
        out.append(filled.get(shard, 0))
        filled[shard] = out[-1] + n
    return out


def shard(docs: DataFrame, shards: int = SHARDS, slots: int = SLOTS, path: str | None = None) -> DataFrame:
    """Every row with its virtual slot, shard, gapless position within the shard and the map's version.

    With `path`, the map there is edited for these rows and shards, and its next version applied; without,
    the map is new. Texts are read once; ids, sizes and checksums are shuffled twice, by group and by
    virtual slot; the map has one row per slot, so broadcasting it is bounded by the parameter.
    """
    spark = docs.sparkSession
    rows = written(slotted(docs, slots), "slotted")
    counts, sizes = slot_totals(rows, slots)
    was, begun = (latest(spark, path), latest(spark, path, whole=False)) if path else (0, 0)
    shard_of = rebalance(sizes, shards_of(spark, path, was, slots), shards) if was else assign(sizes, shards)
    mapped = stored(spark, path or scratch(spark, "slot-map"), begun + 1, shard_of, sizes, counts)
    before = Window.partitionBy("vslot").orderBy("doc_id", "text_crc32", "size", "copies").rowsBetween(Window.unboundedPreceding, -1)
    out = rows.withColumn("_in", F.coalesce(F.sum("copies").over(before), F.lit(0))).join(F.broadcast(mapped), "vslot")
    out = out.withColumn("_copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
    return out.select("doc_id", "size", "text_crc32", "shard", (F.col("first") + F.col("_in") + F.col("_copy")).cast("long").alias("slot"), "vslot", F.lit(begun + 1).alias("map_version"))


def op8_virtual_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents into 40 shards of near equal bytes."""
    out = shard(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "vslot", "map_version")
