"""Bounded samples of labelled texts, and models that one task learns from them."""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import small_batches, written
from .ngrams import bags

#: Features (pairs of a bucket and its count) of a sample at most, over all its rows: 256 MB.
MOST_FEATURES = 1 << 25


def distinct_texts(rows: DataFrame, label: str, most: int, seed: int) -> DataFrame:
    """label, text and _h (a hash of the text) of at most `most` rows per label: those of least hash, each text once.

    Tasks keep no more than that of what they read, so that neither an id nor a text that a third of all
    rows bear makes the sample larger.
    """
    rows = rows.select(label, "text", F.xxhash64("text", F.lit(seed)).alias("_h"))
    once = rows.withColumn("_k", F.row_number().over(Window.partitionBy(label, "_h").orderBy("_h"))).where("_k = 1")
    return once.withColumn("_k", F.row_number().over(Window.partitionBy(label).orderBy("_h"))).where(F.col("_k") <= most).drop("_k")


def features(rows: DataFrame, label: str, orders: tuple[int, ...], words: bool, bits: int, most: int = MOST_FEATURES, lower: bool = False) -> DataFrame:
    """label, _h, ids, ns: the rows' (label, text, _h) bags of features, written down.

    If together they have more features than `most`, the rows of greatest hash are left out: texts are
    taken whole or not at all.
    """
    small_batches(rows.sparkSession)
    kind = dict(rows.dtypes)[label]

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            found = bags([t.lower() for t in texts] if lower else texts, orders, words, bits)
            columns = {"label": batch.column(label), "_h": batch.column("_h"), "n": pa.array([len(x) for x, _ in found], pa.int64())}
            yield pa.RecordBatch.from_pydict(columns | {"ids": pa.array([x.astype(np.uint32).tobytes() for x, _ in found], pa.binary()), "ns": pa.array([n.astype(np.float32).tobytes() for _, n in found], pa.binary())})

    found = written(rows.select(label, "text", "_h").mapInArrow(counted, f"label {kind}, _h long, n long, ids binary, ns binary"), "features")
    sizes = found.select("_h", "n").toArrow().sort_by("_h")
    hashes, upto = sizes["_h"].to_numpy(), np.cumsum(sizes["n"].to_numpy())
    if len(upto) and upto[-1] > most:
        path, found = found.docloom_path, found.where(F.col("_h") < int(hashes[int(np.searchsorted(upto, most, "right"))]))
        found.docloom_path = path
    return found


def learned(found: DataFrame, learn: Callable[[list, list], list[np.ndarray]]) -> list[np.ndarray]:
    """What `learn` makes of the labels and bags of :func:`features`, in order of the texts' hashes.

    One task holds the sample, whose size is bounded, and gives the arrays of a model alone to the driver.
    """
    small_batches(found.sparkSession, 64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = list(batches)
        if not parts:
            return
        kept = pa.Table.from_batches(parts)
        order = pa.compute.sort_indices(kept.select(["_h", "label"]), [("_h", "ascending"), ("label", "ascending")]).to_pylist()
        views = {n: [np.frombuffer(x.as_buffer(), t) for chunk in kept[n].chunks for x in chunk] for n, t in (("ids", np.uint32), ("ns", np.float32))}
        labels = kept["label"].to_pylist()
        arrays = learn([labels[i] for i in order], [(views["ids"][i], views["ns"][i]) for i in order])
        columns = [pa.array(range(len(arrays)), pa.int32()), pa.array([a.dtype.str for a in arrays], pa.string()), pa.array([list(a.shape) for a in arrays], pa.list_(pa.int32())), pa.array([a.tobytes() for a in arrays], pa.binary())]
        del views, kept, parts
        yield pa.RecordBatch.from_arrays(columns, names=["i", "kind", "shape", "data"])
        released()

    rows = found.select("label", "_h", "ids", "ns").repartition(1).mapInArrow(run, "i int, kind string, shape array<int>, data binary").collect()
    return [np.frombuffer(r["data"], r.kind).reshape(r.shape) for r in sorted(rows, key=lambda r: r.i)]


def released() -> None:
    """Give memory that a sample took back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
