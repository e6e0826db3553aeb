"""Quality classifier: supervised subword embeddings.

A document is the mean of learned vectors of its hashed words and character n-grams; a softmax layer
over that mean gives the score. Both layers are learned together by stochastic gradient descent in
numpy in one task, from a bounded sample of labelled rows whose features all tasks count. As the
output is linear in the vectors, scoring looks up one number per feature: the model that is sent out
is one table of 2 ** BITS floats, whatever the corpus.

Defined results: null and empty texts have no features and score 0.5, as both labels weigh alike; labels other
than 0 and 1, null labels and ids without a document are not learnt from; a document with several
labels counts with the least; a text is learnt from once per label, however many rows or ids bear it;
with labels of one kind all score next to that, with none 0.5. A text of any length is scored whole and
is learnt from whole or not at all. A score of exactly 0.5 predicts 1. Repeated rows are scored alike.
Extra columns don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import dropped, held_out, small_batches, table, text_of
from .ngrams import means
from .samples import distinct_texts, features, learned

BITS = 17
DIM = 16
ORDERS = (2, 3, 4)
#: So many texts of either label are learnt from at most, those of least hash. Labelled ids are picked for
#: twice as many first, as some have no document or share a text with others.
PER_LABEL, SPARE = 1500, 2
EPOCHS = 6
RATE = 0.5


@dataclass
class Model:
    """Per-bucket share of the logit, and a logit added to all."""

    weights: np.ndarray
    bias: float

    def scores(self, texts: list[str]) -> np.ndarray:
        """Probability of label 1."""
        mean, count = means(texts, self.weights, ORDERS, True, BITS)
        return 1 / (1 + np.exp(-np.clip(np.where(count > 0, mean, 0) + self.bias, -30, 30)))


def sampled(labels: DataFrame, per_label: int = PER_LABEL) -> tuple[DataFrame, dict[int, int]]:
    """doc_id, y of at most SPARE times so many ids of either label, and how many of either there are."""
    ys = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).where(~held_out())
    ys = ys.groupBy("doc_id").agg(F.min("quality").cast("int").alias("y"))
    counts = {r.y: r.n for r in ys.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    picked = [ys.where(F.col("y") == y).orderBy(F.xxhash64("doc_id", F.lit(2)), "doc_id").limit(SPARE * per_label) for y in (0, 1)]
    rows = [(r.doc_id, r.y) for part in picked for r in part.collect()]
    return labels.sparkSession.createDataFrame(rows, "doc_id long, y int"), counts


def train(docs: DataFrame, labels: DataFrame, per_label: int = PER_LABEL) -> Model:
    """Learn from rows that aren't held out. The sample's size is a parameter, so it may be broadcast."""
    picked, counts = sampled(labels, per_label)
    rows = docs.select("doc_id", text_of().alias("text")).join(F.broadcast(picked), "doc_id")
    found = features(distinct_texts(rows, "y", per_label, 2), "y", ORDERS, True, BITS)
    got = learned(found, lambda ys, data: [fitted(data, np.array(ys, int))] if len(set(ys)) > 1 else [])
    dropped(found)
    n0, n1 = counts.get(0, 0), counts.get(1, 0)
    if not n0 or not n1 or not got:
        return Model(np.zeros(1 << BITS, np.float32), 0.0 if n0 == n1 else (30.0 if n1 else -30.0))
    return Model(got[0], 0.0)


def fitted(data: list, ys: np.ndarray) -> np.ndarray:
    """Stochastic gradient descent on one document at a time, with a falling rate."""
    draw = np.random.default_rng(7)
    vectors = np.empty((1 << BITS, DIM), np.float32)
    for part in np.array_split(vectors, 16):
        part[:] = draw.uniform(-1 / DIM, 1 / DIM, part.shape)
    output = np.zeros((DIM, 2), np.float32)
    share = np.bincount(ys, minlength=2) / len(ys)
    cost = 0.5 / share  # both labels weigh alike
    steps, done = EPOCHS * len(ys), 0
    for _ in range(EPOCHS):
        for i in draw.permutation(len(ys)):
            rate = RATE * (1 - done / steps)
            done += 1
            ids, ns = data[i]
            if not len(ids):
                continue
            part = ns / ns.sum()
            mean = part @ vectors[ids]
            z = mean @ output
            p = np.exp(z - z.max())
            p /= p.sum()
            p[ys[i]] -= 1
            g = (rate * cost[ys[i]] * p).astype(np.float32)
            back = output @ g
            output -= np.outer(mean, g)
            vectors[ids] -= (part * min(len(ids), 200))[:, None] * back
    return (vectors @ (output[:, 1] - output[:, 0])).astype(np.float32)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score of every row, in one pass over the texts."""
    small_batches(docs.sparkSession)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "score": pa.array(model.scores(batch.column("text").to_pylist()), pa.float64())})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).mapInArrow(scored, "doc_id long, score double")


def kept(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """The rows, with all their columns, that score at least so much."""
    small_batches(docs.sparkSession)

    def passed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            yield batch.filter(pa.array(model.scores(texts) >= least))

    return docs.mapInArrow(passed, docs.schema)


def op2_subword_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's quality score."""
    docs = table(spark, sf_dir, "documents")
    scored = score(docs, train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
