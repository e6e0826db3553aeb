import math
from collections import Counter

import numpy as np
import pytest

from docloom.llm import common, language, quality, samples
from docloom.llm.common import table
from docloom.llm.ngrams import bags, grams, means

from .fixtures import DOCS, awkward, words


def test_held_out_accuracy_of_quality(spark, tiny):
    sf = tiny.replace("sf0.001", "sf0.01")
    found = quality.op2_subword_quality(spark, sf).join(table(spark, sf, "labels"), "doc_id").where("held_out").toPandas()
    assert len(found) > 50 and (found.predicted == found.quality).mean() > 0.95


def test_held_out_accuracy_of_languages(spark, tiny):
    sf = tiny.replace("sf0.001", "sf0.01")
    found = language.op10_output_codes(spark, sf).join(table(spark, sf, "documents").select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert len(found) > 200 and (found.lang_pred == found.lang).mean() > 0.97


@pytest.mark.parametrize("rows", [awkward(), []], ids=["awkward", "empty"])
def test_awkward_tables(spark, rows):
    docs = spark.createDataFrame([(*r, "x", 0.5) for r in rows], DOCS + ", label string, score double")
    labels = spark.createDataFrame([(3, 1, 0), (3, 0, 0), (5, 0, 0), (6, 1, None), (None, 1, 0), (9, None, 0), (99, 1, 0), (11, 7, 0)], "doc_id long, quality int, toxic int")
    model = quality.train(docs, labels)
    scores = quality.score(docs, model).collect()
    assert len(scores) == len(rows) and all(0 <= r.score <= 1 for r in scores)
    assert quality.kept(docs, model).columns == docs.columns and quality.kept(docs, model, 0.0).count() == len(rows)
    langs = language.train(docs)
    found = {r.doc_id: r for r in language.predict(docs, langs).collect()}
    assert len(found) == len({r[0] for r in rows})
    if rows:
        assert all(found[i].lang_pred == "und" and found[i].score == 0 for i in (0, 1, 2, 10)) and found[11].lang_pred in langs.languages
        assert {r.doc_id for r in language.kept(docs, langs).collect()}.isdisjoint({0, 1, 2, 10})


def test_no_labels_and_labels_of_one_kind(spark):
    docs = spark.createDataFrame(awkward(), DOCS)
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in quality.score(docs, quality.train(docs, none)).collect()} == {0.5}
    ones = spark.createDataFrame([(i, 1) for i in range(13)], "doc_id long, quality int")
    assert all(r.score > 0.99 for r in quality.score(docs, quality.train(docs, ones)).collect())


def test_samples_are_bounded_by_texts_whatever_the_ids(spark, monkeypatch):
    """A third of the rows of one id, a third of none, a third of one text; with more languages than are learned."""
    rows = [(7 if i % 3 == 0 else None if i % 3 == 1 else i, "one text" if i % 3 == 2 else words(20, i), f"l{i % 4}", "a", 1) for i in range(3000)]
    docs = spark.createDataFrame(rows, DOCS)
    got = samples.distinct_texts(docs.select("lang", "text"), "lang", 50, 1).collect()
    assert len(got) == 200 and len({(r.lang, r.text) for r in got}) == 200
    seen = spark.sparkContext.accumulator(0)
    monkeypatch.setattr(quality, "fitted", lambda data, ys: seen.add(len(ys)) or np.zeros(1 << quality.BITS, np.float32))
    labels = spark.createDataFrame([(i, i % 2) for i in range(3000)], "doc_id long, quality int")
    quality.train(docs, labels, 40)
    assert 0 < seen.value <= 80
    few = samples.features(docs.selectExpr("lang", "text", "xxhash64(text) AS _h"), "lang", (1, 2), True, 10, most=5000)
    kept, size = samples.learned(few, lambda labels, data: [np.array([len(labels), len(data)]), np.array([sum(len(x) for x, _ in data)])])
    assert 0 < size[0] <= 5000 and kept[0] == kept[1] > 0
    common.dropped(few)
    many = spark.createDataFrame([(i, words(12, i), f"l{i % 600:03}", "a", 1) for i in range(1300)], DOCS)
    monkeypatch.setattr(language, "EPOCHS", 1)
    model = language.train(many, 2)
    assert len(model.languages) == language.MOST_LANGUAGES and model.languages == sorted(model.languages)
    assert {r.lang_pred for r in language.predict(many, model).collect()} <= set(model.languages)


def plain_features(text, orders, with_words, bits):
    """Buckets of a text's n-grams and words, one after the other, by the definition of the hashes."""
    u32 = lambda x: x & 0xFFFFFFFF

    def bucket(h):
        h ^= h >> 15
        h = u32(h * 0x2C1B3C6D)
        h ^= h >> 12
        h = u32(h * 0x297A2D39)
        return h >> 32 - bits

    padded, out = " " + text + " ", []
    for n in orders:
        for i in range(len(padded) - n + 1):
            gram = padded[i : i + n]
            blank = [ord(c) <= 32 for c in gram]
            if n == 1 and blank[0] or n == 2 and all(blank) or n > 2 and any(blank[1:-1]):
                continue
            h = u32(ord(gram[0]) + n * 0x9E3779B1)
            for c in gram[1:]:
                h = u32(u32(h * 0x01000193) + ord(c) * 0x85EBCA6B)
            out.append(bucket(h))
    for word in "".join(" " if ord(c) <= 32 else c for c in text).split(" ") if with_words else ():
        if word:
            total = 0
            for k, c in enumerate(word):
                h = u32(u32(ord(c) + k * 0x9E3779B1) * 0x85EBCA6B)
                h ^= h >> 13
                total = u32(total + h * 0xC2B2AE35)
            out.append(bucket(total))
    return out


def test_scores_and_decoding_are_brute_force(spark):
    """What the queries score and decode, from the models' tables by plain loops over every text."""
    docs = [r for r in awkward() if len(r[1] or "") < 5000]
    table_ = spark.createDataFrame(docs, DOCS)
    draw = np.random.default_rng(3)
    q = quality.Model(draw.normal(size=1 << quality.BITS).astype(np.float32) * 3, 0.25)
    code = language.codewords(4)
    m = language.Model(list("abcd"), code, draw.uniform(0.2, 2, code.shape[1]), draw.normal(size=(1 << language.BITS, code.shape[1])).astype(np.float32) * 4, draw.normal(size=code.shape[1]))
    scores = {(r.doc_id, r.score) for r in quality.score(table_, q).collect()}
    found = {r.doc_id: r for r in language.predict(table_, m).collect()}
    for doc_id, text, *_ in docs:
        buckets = plain_features(text or "", quality.ORDERS, True, quality.BITS)
        want = 1 / (1 + math.exp(-((sum(float(q.weights[b]) for b in buckets) / len(buckets) if buckets else 0) + q.bias)))
        assert any(i == doc_id and abs(s - want) < 1e-9 for i, s in scores)
        if not any(c.isalpha() for c in text or ""):
            assert (found[doc_id].lang_pred, found[doc_id].score) == ("und", 0)
            continue
        buckets = plain_features(text.lower(), language.ORDERS, False, language.BITS)
        margins = [sum(float(m.weights[b][k]) for b in buckets) / len(buckets) + m.bias[k] for k in range(code.shape[1])]
        losses = [sum(m.trust[k] * math.log1p(math.exp(-code[c][k] * margins[k])) for k in range(code.shape[1])) for c in range(4)]
        likely = [math.exp(min(losses) - x) for x in losses]
        assert found[doc_id].lang_pred == "abcd"[losses.index(min(losses))]
        assert abs(found[doc_id].score - max(likely) / sum(likely)) < 1e-6 and found[doc_id].ambiguous == (max(likely) / sum(likely) < language.CLEAR)


def test_training_is_brute_force():
    """Both trainers against the same steps in plain Python, on a few short texts."""
    texts = ["good plain words", "bad bad junk", "plain good text", "junk of junk", "words of text", "bad stuff here"]
    ys, bits = [1, 0, 1, 0, 1, 0], quality.BITS
    data = bags(texts, quality.ORDERS, True, bits)
    got = quality.fitted(data, np.array(ys))
    draw = np.random.default_rng(7)
    vectors = draw.uniform(-1 / quality.DIM, 1 / quality.DIM, (1 << bits, quality.DIM)).astype(np.float32).astype(float)
    start, out, done, steps = vectors.copy(), [[0.0, 0.0] for _ in range(quality.DIM)], 0, quality.EPOCHS * len(ys)
    for _ in range(quality.EPOCHS):
        for i in draw.permutation(len(ys)):
            rate, done = quality.RATE * (1 - done / steps), done + 1
            counts = Counter(plain_features(texts[i], quality.ORDERS, True, bits))
            total = sum(counts.values())
            mean = [sum(n / total * vectors[b][d] for b, n in counts.items()) for d in range(quality.DIM)]
            z = [sum(mean[d] * out[d][c] for d in range(quality.DIM)) for c in (0, 1)]
            p1 = 1 / (1 + math.exp(z[0] - z[1]))
            g = [rate * ((1 - p1, p1)[c] - (ys[i] == c)) for c in (0, 1)]
            back = [out[d][0] * g[0] + out[d][1] * g[1] for d in range(quality.DIM)]
            for d in range(quality.DIM):
                for c in (0, 1):
                    out[d][c] -= mean[d] * g[c]
            for b, n in counts.items():
                vectors[b] -= n / total * min(len(counts), 200) * np.array(back)
    want = vectors @ np.array([b - a for a, b in out])
    assert np.abs(got - want).max() < 1e-3 and np.abs(vectors - start).max() > 0.01
    code = language.codewords(2)
    few = bags(texts, language.ORDERS, False, language.BITS)
    trust, weights, bias = language.fitted(few, np.array(ys), code)
    draw = np.random.default_rng(10)
    draw.permutation(len(ys))
    w, b0, done, steps = {}, 0.0, 0, language.EPOCHS * len(ys)
    for _ in range(language.EPOCHS):
        for i in draw.permutation(np.arange(len(ys))):
            rate, done = language.RATE * (1 - done / steps), done + 1
            counts = Counter(plain_features(texts[i], language.ORDERS, False, language.BITS))
            total, bit = sum(counts.values()), float(code[ys[i]][0])
            margin = sum(n / total * w.get(b, 0.0) for b, n in counts.items()) + b0
            g = -bit / (1 + math.exp(bit * margin)) * rate  # both labels weigh alike
            for b, n in counts.items():
                w[b] = w.get(b, 0.0) - n / total * min(len(counts), 200) * g
            b0 -= 0.01 * g
    assert (trust == 1).all() and abs(bias[0] - b0) < 1e-4 and max(abs(weights[b][0] - x) for b, x in w.items()) < 1e-3 and len(w) > 30


def test_features_do_not_depend_on_neighbours():
    texts = ["ab cd", "", "x", "añb  cd\n\n", "ab cd"]
    draw = np.random.default_rng(0).normal(size=1 << 10).astype(np.float32)
    together, counts = means(texts, draw, (1, 2, 3, 4), True, 10)
    for t, m, c in zip(texts, together, counts, strict=True):
        alone, n = means([t], draw, (1, 2, 3, 4), True, 10)
        assert m == alone[0] and c == n[0]
    assert together[0] == together[4] and counts[1] == 0


def test_ngrams_stay_within_words():
    found = list(grams(["ab c"], (1, 2, 3, 4), True, 20))
    assert [len(h) for h, _ in found] == [3, 5, 3, 1, 2]  # a b c; _a ab b_ _c c_; _ab ab_ _c_; _ab_; ab c


def test_codewords_differ_from_each_other_and_split_classes():
    for n in (1, 2, 3, 4, 6, 7, 30):
        code = language.codewords(n)
        assert len(code) == n and set(np.unique(code)) <= {-1, 1}
        for i in range(n):
            for j in range(i):
                assert (code[i] != code[j]).sum() >= max(1, code.shape[1] // 5)


def test_crc_held_out_rule(spark):
    import zlib

    from docloom.llm.common import held_out

    rows = spark.createDataFrame([(i,) for i in [*range(300), -5, None]], "doc_id long").select("doc_id", held_out().alias("h")).collect()
    assert all(r.h == (zlib.crc32(("" if r.doc_id is None else str(r.doc_id)).encode()) % 3 == 1) for r in rows)
