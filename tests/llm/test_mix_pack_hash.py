import itertools
import math
import os
import random

import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from docloom.llm import mixing, packing, simhash

from .fixtures import DOCS, awkward, many, words


def hashed(values, seed=42):
    """Spark's xxhash64 over whole numbers: 8 bytes of a long, 4 of an int."""
    for v, size in values:
        seed = xxhash.xxh64((v & (1 << 8 * size) - 1).to_bytes(size, "little"), seed=seed).intdigest()
    return signed(seed)


def brute_mix(rows, weights, block):
    """(doc_id, slot, bytes before) by stepping through all slots and looking at all sources in each."""
    from fractions import Fraction

    total, left = sum(Fraction(w) for w in weights.values()), {}
    for i, text, _, source, _ in rows:
        left.setdefault(source, []).append((hashed([(i, 8), (4, 4)]), i, max(1, len((text or "").encode()))))
    starts = {}
    for source, mine in left.items():
        at = 0
        for _, i, n in sorted(mine):
            starts[i] = source, at
            at += n
        left[source] = -(-at // block)
    slot_of, done, t = {}, dict.fromkeys(left, 0), 0
    while any(left.values()):
        ready = [(math.ceil((done[s] + 1) * total / Fraction(weights[s])), s) for s in left if left[s] and math.floor(done[s] * total / Fraction(weights[s])) <= t]
        if ready:
            s = min(ready)[1]
            slot_of[s, done[s]] = t
            done[s], left[s] = done[s] + 1, left[s] - 1
        t += 1
    return sorted((i, slot_of[s, at // block], at) for i, (s, at) in starts.items())


def test_mix_is_brute_force(spark):
    """Slots and the order inside each source, from the definition."""
    r = random.Random(8)
    rows = [(i * 3 - 40, words(r.randrange(1, 60), i), "en", f"s{min(r.randrange(9), 4)}", 1) for i in range(300)]
    weights = {"s0": 0.1, "s1": 1 / 3, "s2": 7.0, "s3": 2.5, "s4": 0.7}
    found = mixing.placed(spark.createDataFrame(rows, DOCS), weights, block_bytes=200).collect()
    assert sorted((x._row.doc_id, x._slot, x._at) for x in found) == brute_mix(rows, weights, 200)


def test_rows_of_a_hot_id_spread(spark, monkeypatch):
    """Half the rows of one source without an id, half of one id: all have places of their own, in many pieces."""
    monkeypatch.setattr(mixing, "CHUNK_ROWS", 20)
    rows = [(None if i % 2 else 5, f"text {i}", "en", "s", 1) for i in range(600)]
    found = mixing.placed(spark.createDataFrame(rows, DOCS), block_bytes=50).collect()
    at = 0
    for r in sorted(found, key=lambda r: r._at):
        assert r._at == at and r._slot == r._block == at // 50
        at += r._size
    assert len(found) == 600


@pytest.mark.parametrize("n", [2, 3, 50, 250, 1000])
def test_lag_over_many_slots(n):
    """A hundred thousand slots: every source's blocks stay strictly within one of its exact share, whatever its weight."""
    from fractions import Fraction

    r = random.Random(n)
    weights = [n / 2.0] + [r.choice([0.1, 1.0, 1.0, r.random()]) for _ in range(n - 1)]
    total = sum(map(Fraction, weights))
    share, count = [Fraction(w) / total for w in weights], [0] * n
    close = [float(x) for x in share]
    for t, (slot, s, i, release, deadline) in zip(range(1, 100001), mixing.in_turn(weights, [10**6] * n)):
        assert slot == t - 1 and release <= slot < deadline and i == count[s]
        assert count[s] - t * close[s] < 0.001  # not ahead before its turn
        count[s] += 1
        if t % 10007 == 0 or t == 100000:
            assert all(abs(c - t * w) < 1 for c, w in zip(count, share, strict=True))


@pytest.mark.parametrize("rows", [awkward(), many(), []], ids=["awkward", "many", "empty"])
def test_places_follow_the_schedule(spark, rows):
    docs = spark.createDataFrame([(*r, i, "x") for i, r in enumerate(rows)], DOCS + ", _slot int, _source string")
    found = mixing.placed(docs, {"a": 3.0, "s1": 2.0, "b": 1.0}, block_bytes=300).collect()
    assert len(found) == len(rows) and sorted(r._row._slot for r in found) == list(range(len(rows)))
    for source in {r._source for r in found}:
        mine = sorted((r for r in found if r._source == source), key=lambda r: r._at)
        at = 0
        for r in mine:
            assert r._at == at and r._block == at // 300 and r._release <= r._slot < r._deadline
            at += r._size
    mixed = mixing.mixed(docs, block_bytes=300)
    assert mixed.columns == docs.columns and mixed.count() == len(rows)


def test_whole_blocks_deviate_by_less_than_one(spark):
    """While all sources last, each one's blocks so far are within one of its share."""
    rows = [(i, "x" * 100, "en", f"s{i % 3}", 1) for i in range(900)]
    found = mixing.placed(spark.createDataFrame(rows, DOCS), {"s0": 5.0, "s1": 3.0, "s2": 2.0}, block_bytes=100).collect()
    slots = sorted((r._slot, r._source) for r in found)
    count = {"=s0": 0, "=s1": 0, "=s2": 0}
    for t, (slot, source) in enumerate(slots[:500], 1):
        assert slot == t - 1
        count[source] += 1
        assert all(abs(count[s] - w * t) < 1 for s, w in (("=s0", 0.5), ("=s1", 0.3), ("=s2", 0.2)))


def test_shares_are_exact_for_hundreds_of_sources(spark):
    """A source of a third among 300, and one of weight 0: shares follow the weights themselves, over many slots."""
    weights = {f"s{i}": 299.0 if i == 0 else 2.0 for i in range(300)}
    rows = [(i * 1000 + k, "x" * 10, "en", f"s{i}", 1) for i in range(300) for k in range(400 if i == 0 else 3)] + [(-1, "x", "en", "zero", 1)]
    found = sorted((r._slot, r._source) for r in mixing.placed(spark.createDataFrame(rows, DOCS), weights, block_bytes=10).collect())
    total, count = sum(weights.values()), {}
    for t, (slot, source) in enumerate(found[:1197], 1):  # as long as the hot source lasts
        assert slot == t - 1
        count[source] = count.get(source, 0) + 1
        assert all(abs(count.get(f"={s}", 0) - w * t / total) < 1 for s, w in weights.items())
    assert found[-1][1] == "=zero" and len(found) == len(rows)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.floats(0.001, 100), min_size=2, max_size=8))
def test_lag_is_below_one_for_any_weights(weights):
    from fractions import Fraction

    exact = [Fraction(w) for w in weights]
    count = [0] * len(exact)
    for t, (slot, s, i, release, deadline) in zip(range(1, 3000), mixing.in_turn(weights, [10**6] * len(exact))):
        assert slot == t - 1 and release <= slot < deadline and i == count[s]
        count[s] += 1
        assert all(abs(n - w * t / sum(exact)) < 1 for n, w in zip(count, exact, strict=True)) if t < 300 or t % 97 == 0 else True


def test_many_sources_and_blocks_by_shuffle(spark, monkeypatch):
    rows = [(i, "x" * (1 + i % 50), "en", f"s{i % 70}", 1) for i in range(700)]
    docs = spark.createDataFrame(rows, DOCS)
    key = lambda r: (r._row.doc_id, r._slot, r._at, r._release, r._deadline)
    want = sorted(key(r) for r in mixing.placed(docs, block_bytes=40).collect())
    monkeypatch.setattr(mixing, "FEW_SOURCES", 10)
    monkeypatch.setattr(mixing, "FEW_BLOCKS", 10)
    assert sorted(key(r) for r in mixing.placed(docs, block_bytes=40).collect()) == want and len(want) == 700


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 60), st.integers(1, 50), min_size=1, max_size=9), st.integers(1, 4))
def test_boundaries_minimise_padding(histogram, buckets):
    lengths = sorted(histogram)
    counts = [histogram[x] for x in lengths]

    def padding(edges):
        return sum(n * (min(e for e in edges if e >= x) - x) for x, n in zip(lengths, counts, strict=True))

    best = min(padding([*c, lengths[-1]]) for k in range(min(buckets, len(lengths))) for c in itertools.combinations(lengths[:-1], k))
    edges = packing.boundaries(lengths, counts, buckets)
    assert len(edges) <= buckets and edges == sorted(edges) and padding(edges) == best


@pytest.mark.parametrize("sizes", [range(1, 9), [0, 0, 1, 2, 3, 9, 9, 9, 10, 17, 1100, 1101, 1130], [5]], ids=["to 8", "wide", "one"])
def test_packed_rows_have_the_least_padding(spark, sizes):
    """The padding of all packed rows together, against every choice of boundaries."""
    docs = spark.createDataFrame([(i, " ".join(["w"] * n), "en", "a", 1) for i, n in enumerate(sizes)], DOCS)
    lengths = sorted(set(sizes))
    for buckets in (4, 16):
        best = min(sum(min(e for e in (*c, lengths[-1]) if e >= x) - x for x in sizes) for k in range(min(buckets, len(lengths))) for c in itertools.combinations(lengths[:-1], k))
        found = packing.packed(docs, buckets=buckets).collect()
        assert sum(r.padding for r in found) == best and all(r.padding == r.bucket_length - r.n_tokens >= 0 for r in found)
        assert len({r.bucket for r in found}) <= buckets


def test_rows_without_ids_spread_over_chunks(spark, monkeypatch):
    """A third of the rows without an id and a third of one id: batches are as full as any."""
    rows = [(None if i % 3 == 0 else 7 if i % 3 == 1 else i, " ".join(["w"] * (i % 5)) + f" {i}", "en", "a", 1) for i in range(3000)]
    found = packing.packed(spark.createDataFrame(rows, DOCS), buckets=2, budget=100).collect()
    assert len(found) == 3000 and sorted({r.batch for r in found}) == list(range(max(r.batch for r in found) + 1))
    each = {r.bucket: 100 // r.bucket_length for r in found}
    sizes = {}
    for r in found:
        sizes[r.bucket, r.batch] = sizes.get((r.bucket, r.batch), 0) + 1
    assert all(n == each[b] or batch == max(x for k, x in sizes if k == b) for (b, batch), n in sizes.items())


def test_boundaries_of_very_many_lengths():
    r = random.Random(4)
    lengths = sorted(r.sample(range(1, 200000), 300))
    counts = [r.randrange(1, 10**9) for _ in lengths]
    u, c = lengths, [0, *itertools.accumulate(counts)]
    best = [0] + [float("inf")] * 300
    for _ in range(16):
        best = [float("inf")] + [min(best[i] + u[j] * (c[j + 1] - c[i]) for i in range(j + 1)) for j in range(300)]
    edges = packing.boundaries(lengths, counts)
    assert sum(n * min(e for e in edges if e >= x) for x, n in zip(lengths, counts, strict=True)) == best[300]
    many_ = packing.boundaries(list(range(30000)), [1] * 30000)
    assert len(many_) == 16 and many_[-1] == 29999


@pytest.mark.parametrize("rows", [awkward(), many(), []], ids=["awkward", "many", "empty"])
def test_batches_keep_the_budget(spark, rows):
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], DOCS + ", bucket int, batch int")
    found = packing.packed(docs, buckets=4, budget=300).collect()
    assert len(found) == len(rows)
    assert sorted((r.doc_id is None, r.doc_id, r.n_tokens) for r in found) == sorted((r[0] is None, r[0], len((r[1] or "").split())) for r in rows)
    batches = {}
    for r in found:
        assert r.padding == r.bucket_length - r.n_tokens >= 0
        batches.setdefault(r.batch, []).append(r)
    assert sorted(batches) == list(range(len(batches)))
    for b in batches.values():
        assert len({r.bucket for r in b}) == 1 and sorted(r.slot for r in b) == list(range(len(b)))
        assert len(b) == 1 or len(b) * b[0].bucket_length <= 300
    for k in {r.bucket for r in found}:  # only a bucket's last batch is short
        sizes = [len(batches[b]) for b in sorted({r.batch for r in found if r.bucket == k})]
        assert all(s == sizes[0] for s in sizes[:-1]) and sizes[-1] <= sizes[0]


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def brute_hash(text):
    w = (text or "").split()
    terms = [w[i : i + 5] for i in range(len(w) - 4)] if len(w) >= 5 else [w] if w else []
    votes = [0] * 64
    for term in terms:
        h = 42
        for x in term:
            h = xxhash.xxh64(x.encode(), seed=h).intdigest()
        for k in range(64):
            votes[k] += 1 if h >> k & 1 else -1
    return sum(1 << k for k in range(64) if votes[k] > 0)


@pytest.mark.parametrize("rows", [awkward(), many(), [], [(7, "only a row", "", "", 0)]], ids=["awkward", "many", "empty", "one"])
def test_fingerprints_are_brute_force(spark, rows):
    import hashlib

    found = simhash.with_edits(spark.createDataFrame([(*r, 1, "x") for r in rows], DOCS + ", fp int, v string")).collect()
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0)))
    assert len(found) == len(rows)
    by = {}
    for r in found:
        by.setdefault(r.doc_id, []).append(r)
    for i, (doc_id, text, *_) in enumerate(order):
        text, after = text or "", order[(i + 1) % len(order)][1] or ""
        cut = len(text) // 3
        edited = text[: len(text) - cut] + after[:cut]
        want = (len(text), signed(brute_hash(text)), signed(brute_hash(edited)), signed(brute_hash(after)), hashlib.sha256(edited.encode()).hexdigest())
        assert want in {(r.n_chars, r.fp, r.efp, r.nfp, r.edited_sha256) for r in by[doc_id]}


def test_windows_of_many_buckets(spark, monkeypatch):
    """Ids alone, in clumps, and a third of the rows of one id and a third of none."""
    monkeypatch.setattr(simhash, "WINDOW_ROWS", 3)
    r = random.Random(1)
    rows = [(i, words(12, i), "", "", 0) for i in r.sample(range(10**6), 50)] + [(i, words(7, i), "", "", 0) for i in range(-5, 10)]
    test_fingerprints_are_brute_force(spark, rows)
    clumps = [(10**9 * (i // 20) + i, words(6, i), "", "", 0) for i in range(60)]
    test_fingerprints_are_brute_force(spark, clumps)
    hot = [(i if i % 3 == 0 else 30 if i % 3 == 1 else None, words(8, i), "", "", 0) for i in range(90)]
    docs = spark.createDataFrame(hot, DOCS)
    windows = simhash.neighbour_windows(docs).groupBy("_bucket").count().collect()
    assert max(w["count"] for w in windows) <= 16 and len(windows) > 15
    order = sorted(hot, key=lambda r: (r[0] is None, -(r[0] or 0), signed(xxhash.xxh64(r[1].encode(), seed=42).intdigest())))
    found = {(r.doc_id, r.fp): r.nfp for r in simhash.with_edits(docs).collect()}
    assert len(found) == 90
    for a, b in zip(order, order[1:] + order[:1], strict=True):
        assert found[a[0], signed(brute_hash(a[1]))] == signed(brute_hash(b[1]))


@pytest.mark.parametrize("most", [8192, 3])
def test_block_tables_find_all_pairs(spark, monkeypatch, most):
    """With few and with many fingerprints to a key: pairing them up and looking up what is near give the same."""
    monkeypatch.setattr(simhash, "MOST_PAIRED", most)
    r = random.Random(2)
    fps = [r.getrandbits(64) for _ in range(40)]
    fps += [f ^ sum(1 << b for b in r.sample(range(64), k)) for f in fps for k in (1, 3, 4)]
    want = sorted((a, b, bin((a ^ b) & (1 << 64) - 1).count("1")) for a, b in itertools.combinations(sorted(map(signed, set(fps))), 2) if bin((a ^ b) & (1 << 64) - 1).count("1") <= 3)
    found = simhash.near_pairs(spark.createDataFrame([(signed(f),) for f in fps] * 2, "fp long")).collect()
    assert sorted(map(tuple, found)) == want and len(want) >= 80


def test_flips_change_up_to_three_bits_outside_the_key(spark):
    rows = simhash.flips(spark).groupBy("table").agg({"flip": "count"}).collect()
    free = [64 - sum(64 * (p + 1) // 6 - 64 * p // 6 for p in c) for c in itertools.combinations(range(6), 3)]
    assert {r[0]: r[1] for r in rows} == {i: n + math.comb(n, 2) + math.comb(n, 3) for i, n in enumerate(free)}


def test_long_words_and_texts_of_few_words(spark):
    """Cuts inside words, at blanks, in the first five words, and terms beyond one run of sums."""
    r = random.Random(6)
    texts = ["a", "a b", "a b c d e", "a b c d e f", "  a  b\n\tc d e f g h ", "x" * 50, "x" * 50 + " y", "one two three four five six seven eight nine ten", words(700, 3), words(300, 4, "ab"), " ", "é ü 漢 字 ñ ç ö", "a b c d ", "a b c d e "]
    rows = [(i, t[: r.randrange(len(t)) + 1] if k else t, "", "", 0) for i, (t, k) in enumerate((t, k) for t in texts for k in range(4))]
    test_fingerprints_are_brute_force(spark, rows)


def test_pipeline_keeps_what_it_should(spark, tiny, tmp_path):
    """Each stage against brute force on what the stage before has written."""
    import corpus_pipeline as cp
    from docloom.llm import language, quality
    from docloom.llm.common import table

    from .test_jaccard import brute

    docs = table(spark, tiny, "documents")
    steps = [docs]
    for i, (_, stage) in enumerate(cp.STAGES):
        stage(spark, steps[-1], tiny).write.parquet(f"{tmp_path}/{i}")
        steps.append(spark.read.parquet(f"{tmp_path}/{i}"))
        assert i == len(cp.STAGES) - 1 or steps[-1].columns == docs.columns
    rows = [{r.doc_id: r for r in s.collect()} for s in steps]
    good = {r.doc_id for r in quality.score(docs, quality.train(docs, table(spark, tiny, "labels"))).collect() if r.score >= 0.5}
    assert set(rows[1]) == good and 0.5 < len(good) / len(rows[0]) < 1
    clear = {r.doc_id for r in language.predict(steps[1], language.train(steps[1])).collect() if r.lang_pred != "und" and not r.ambiguous}
    assert set(rows[2]) == clear
    assert set(rows[3]) == {c for i, n, c in brute([tuple(r) for r in rows[2].values()])}
    assert set(rows[4]) == set(rows[3]) == set(rows[5]) and all(rows[4][i].text == rows[0][i].text for i in rows[4])
    places = sorted(((r._slot, r._at), r._row.doc_id) for r in mixing.placed(steps[3]).collect())
    files = sorted(f for f in os.listdir(f"{tmp_path}/3") if f.endswith(".parquet"))
    import pyarrow.parquet as pq

    assert [i for f in files for i in pq.read_table(f"{tmp_path}/3/{f}")["doc_id"].to_pylist()] == [i for _, i in places]
    rank = {i: k for k, (_, i) in enumerate(places)}
    packed = sorted(rows[5].values(), key=lambda r: (r.batch, r.slot))
    for bucket in {r.bucket for r in packed}:
        inside = [rank[r.doc_id] for r in packed if r.bucket == bucket]
        assert inside == sorted(inside)
    final = {r.doc_id for r in cp.run(spark, tiny).collect()}
    assert final == set(rows[5])


def test_near_duplicates_are_told_by_row(spark):
    """Repeated ids with texts of their own, copies under other ids and under none."""
    import corpus_pipeline as cp

    a, b, c, d = (words(60, 50 + i) for i in range(4))
    rows = [(1, a), (5, a + " more"), (5, b), (5, c), (None, c), (None, d), (None, d + " more"), (7, ""), (7, None), (2, "x"), (2, "x")]
    docs = spark.createDataFrame([(i, t, "en", "s", k) for k, (i, t) in enumerate(rows)], DOCS)
    found = cp.ngram_jaccard_join(spark, docs, "")
    assert found.columns == docs.columns
    got = [(r.doc_id, r.text) for r in found.collect()]
    assert sorted(map(repr, [x for x in got if x[0] is not None])) == sorted(map(repr, [(1, a), (5, b), (5, c), (7, ""), (7, None), (2, "x")]))
    assert len(got) == 7 and [x for x in got if x[0] is None][0][1] in (d, d + " more")


def test_pipeline_of_an_empty_and_an_awkward_table(spark, tmp_path):
    import corpus_pipeline as cp

    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for k, rows in enumerate(([], awkward())):
        docs = spark.createDataFrame([(*r, 1, 2) for r in rows], DOCS + ", _metadata int, _file int")
        for i, (_, stage) in enumerate(cp.STAGES):
            stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{k}-{i}")
            docs = spark.read.parquet(f"{tmp_path}/{k}-{i}")
        assert (docs.count() > 0) == bool(rows)
