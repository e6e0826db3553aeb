"""Language identification by error-correcting output codes.

Every learned language has a codeword of bits. One binary classifier per bit, linear over hashed
character n-grams, is learned by stochastic gradient descent in numpy from a bounded sample; decoding
weighs each bit's loss by how well that bit was learned and picks the nearest codeword. If the second
nearest is about as near, the row is flagged as ambiguous.

Defined results: null texts and texts without a letter are `und` with score 0; if no language can be
learned all rows are `und`; rows of null language are not learnt from but are predicted; of more than
MOST_LANGUAGES languages those of most rows are learned, of equals the first by name, and no row is
predicted to be another; a text is learnt from once per language, however many rows bear it; of equally
near codewords the first by name counts. A text of any length is predicted from all of it, and learnt
from whole or not at all. Equal texts get equal answers. Extra columns don't matter.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import dropped, held_out, small_batches, table
from .ngrams import means
from .samples import distinct_texts, features, learned

BITS = 15
ORDERS = (1, 2, 3)
#: So many texts of each language are learnt from at most, those of least hash, and so many of all. Rows
#: are picked by a hash of their texts for SPARE times as many first, as many may be copies.
PER_LANGUAGE, MOST_ROWS, SPARE = 600, 30000, 4
#: So many languages are learned at most: the code matrix lives on the driver.
MOST_LANGUAGES = 500
EPOCHS = 6
RATE = 4.0
#: A row is ambiguous if the nearest codeword's score is below this.
CLEAR = 0.5

_ASCII_LETTER = re.compile("[A-Za-z]")


def codewords(classes: int) -> np.ndarray:
    """One row of -1 and 1 per class: all splits of few classes, else the best of some random dense codes."""
    if classes <= 6:
        splits = range(1, 1 << max(0, classes - 1))
        bits = [[1 if c == 0 or not k >> (c - 1) & 1 else -1 for c in range(classes)] for k in splits]
        return np.array(bits or [[1] * classes], np.float32).T.copy()
    draw, best, width = np.random.default_rng(11), None, int(np.ceil(10 * np.log2(classes)))
    for _ in range(50):
        code = draw.choice([-1.0, 1.0], (classes, width)).astype(np.float32)
        near = (code @ code.T - 2 * width * np.eye(classes)).max()
        if (np.abs(code.sum(0)) < classes).all() and (best is None or near < best[0]):
            best = near, code
    return best[1]


def has_letter(text: str | None) -> bool:
    """Whether any character is a letter of any script."""
    return bool(text) and (bool(_ASCII_LETTER.search(text)) or any(map(str.isalpha, text)))


@dataclass
class Model:
    """Languages, their codewords, the bits' weights and the n-gram table with a column per bit."""

    languages: list[str]
    code: np.ndarray
    trust: np.ndarray
    weights: np.ndarray
    bias: np.ndarray

    def decide(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score and whether the row is ambiguous."""
        known = np.array([has_letter(t) for t in texts], bool)
        if not self.languages:
            return ["und"] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
        mean, _ = means([(t or "").lower() for t in texts], self.weights, ORDERS, False, BITS)
        margins = np.clip(mean + self.bias, -30, 30)
        loss = (np.log1p(np.exp(-margins[:, None, :] * self.code[None])) * self.trust).sum(-1)
        likely = np.exp(loss.min(-1, keepdims=True) - loss)
        likely /= likely.sum(-1, keepdims=True)
        best = loss.argmin(-1)
        score = np.where(known, likely[np.arange(len(texts)), best], 0.0)
        return [self.languages[b] if k else "und" for b, k in zip(best, known, strict=True)], score, score < CLEAR


def train(docs: DataFrame, per_language: int = PER_LANGUAGE) -> Model:
    """Learn the bits from rows with a language that aren't held out; the sample's size is a parameter."""
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out()).select("lang", "text")
    counts = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(MOST_LANGUAGES).collect()}
    nothing = Model([], np.zeros((0, 0)), np.zeros(0), np.zeros((1 << BITS, 1), np.float32), np.zeros(1))
    if not counts:
        return nothing
    each = max(1, min(per_language, MOST_ROWS // len(counts)))
    shares = docs.sparkSession.createDataFrame([(lang, round(min(1.0, SPARE * each / n) * (1 << 30))) for lang, n in counts.items()], "_l string, _share long")
    rows = rows.join(F.broadcast(shares), F.col("lang") == F.col("_l")).where(F.pmod(F.xxhash64("text", F.lit(10)), F.lit(1 << 30)) < F.col("_share"))
    found = features(distinct_texts(rows, "lang", each, 11), "lang", ORDERS, False, BITS, lower=True)
    languages = sorted(counts)
    place = {lang: i for i, lang in enumerate(languages)}
    code = codewords(len(languages))
    got = learned(found, lambda langs, data: list(fitted(data, np.array([place[x] for x in langs], int), code)))
    dropped(found)
    return Model(languages, code, *got) if got else nothing


def fitted(data: list, ys: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All bits at once, each by its own logistic loss; a bit's trust is its log odds of being right on a fifth kept aside."""
    draw = np.random.default_rng(10)
    width = code.shape[1]
    order = draw.permutation(len(ys))
    aside = order[: len(ys) // 5]
    share = np.bincount(ys, minlength=len(code)) / max(1, len(ys))
    cost = np.where(share > 0, 1 / np.maximum(share, 1e-9) / len(code), 0)

    def learned(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        weights, bias = np.zeros((1 << BITS, width), np.float32), np.zeros(width, np.float32)
        steps, done = EPOCHS * len(rows), 0
        for _ in range(EPOCHS):
            for i in draw.permutation(rows):
                rate = RATE * (1 - done / steps)
                done += 1
                ids, ns = data[i]
                if not len(ids):
                    continue
                part = ns / ns.sum()
                bits = code[ys[i]]
                g = -bits / (1 + np.exp(np.clip(bits * (part @ weights[ids] + bias), -30, 30))) * rate * cost[ys[i]]
                weights[ids] -= (part * min(len(ids), 200))[:, None] * g.astype(np.float32)
                bias -= 0.01 * g.astype(np.float32)
        return weights, bias

    trust = np.ones(width)
    if len(aside) >= 20:
        weights, bias = learned(order[len(aside) :])
        right = sum(((data[i][1] / max(1, data[i][1].sum())) @ weights[data[i][0]] + bias) * code[ys[i]] > 0 for i in aside)
        accuracy = (right + 1) / (len(aside) + 2)
        trust = np.maximum(np.log(accuracy / (1 - accuracy)), 0.05)
        trust = trust / trust.mean()
    weights, bias = learned(np.arange(len(ys)))
    return trust, weights, bias


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score and ambiguous of every row, in one pass over the texts."""
    small_batches(docs.sparkSession)

    def predicted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, score, ambiguous = model.decide(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "lang_pred": pa.array(langs, pa.string()), "score": pa.array(score, pa.float64()), "ambiguous": pa.array(ambiguous, pa.bool_())})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(predicted, "doc_id long, lang_pred string, score double, ambiguous boolean")


def kept(docs: DataFrame, model: Model) -> DataFrame:
    """The rows, with all their columns, whose language is known and clear."""
    small_batches(docs.sparkSession)

    def passed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, _, ambiguous = model.decide(batch.column("text").to_pylist())
            yield batch.filter(pa.array((np.array(langs, object) != "und") & ~ambiguous))

    return docs.mapInArrow(passed, docs.schema)


def op10_output_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's language."""
    docs = table(spark, sf_dir, "documents")
    found = predict(docs, train(docs))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "ambiguous")
