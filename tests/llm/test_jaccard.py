import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from docloom.llm import graph, jaccard
from docloom.llm.shingles import Shingler

from .fixtures import DOCS, awkward, many, words


def brute(rows, percent=80):
    """n_shingles and component of each row by comparing all pairs of sets."""
    sets = []
    for r in rows:
        w = [x for x in re.split(r"[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), r[1] or "")) if x]
        sets.append(set() if not w else {tuple(w)} if len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)})
    parent = {r[0]: r[0] for r in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * len(sets[i] | sets[j]) and rows[i][0] is not None and rows[j][0] is not None:
                a, b = sorted((root(rows[i][0]), root(rows[j][0])))
                parent[b] = a
    return sorted(((r[0], len(s), None if r[0] is None else root(r[0])) for r, s in zip(rows, sets, strict=True)), key=repr)


@pytest.mark.parametrize("rows", [awkward(), many(), []], ids=["awkward", "many", "empty"])
def test_join_is_brute_force(spark, rows):
    for links in (True, False):
        found = jaccard.join(spark.createDataFrame(rows, DOCS), links=links).select("doc_id", "n_shingles", "component_id").collect()
        assert sorted(map(tuple, found), key=repr) == brute(rows)


@pytest.mark.parametrize(("short", "hot", "tile", "leaders"), [(48, 1024, 256, 16), (3, 2, 8, 2), (2, -1000, 4, 1)])
def test_components_of_large_clusters(spark, monkeypatch, short, hot, tile, leaders):
    """Groups of near copies, chains from one text to another, and texts that share passages but aren't similar, in many sizes."""
    for name, value in (("SHORT_RUN", short), ("HOT_RUN", hot), ("TILE", tile), ("LEADERS", leaders)):
        monkeypatch.setattr(jaccard, name, value)
    rows, r = [], random.Random(12)
    passage = words(40, 77).split()
    for g in range(4):
        base = words(50 + 30 * g, 40 + g).split()
        for i in range(30):
            mine = base + [f"x{g}{k}" for k in range(i // 3)]
            for _ in range(r.randrange(4)):
                mine[r.randrange(len(mine))] = f"w{r.randrange(10**6)}"
            rows.append((len(rows), " ".join(mine), "en", "a", 1))
    drift = words(60, 5).split()
    for i in range(40):
        drift[i % 60] = f"d{i}"
        rows.append((len(rows), " ".join(drift), "en", "a", 1))
    for i in range(40):
        rows.append((len(rows), " ".join(passage + words(12 + i, 900 + i).split()), "en", "a", 1))
    want = brute(rows)
    assert 10 < len({c for _, _, c in want}) < 150
    found = jaccard.join(spark.createDataFrame(rows, DOCS), links=False).collect()
    assert sorted(map(tuple, found), key=repr) == want


def test_work_on_near_copies_grows_with_their_number(spark, monkeypatch):
    """Twice the near copies of one text: about twice the rows that tiles read, not four times."""
    monkeypatch.setattr(jaccard, "TILE", 16)
    monkeypatch.setattr(jaccard, "LEADERS", 4)
    read, matches = spark.sparkContext.accumulator(0), jaccard.matches

    def counted(group, *rest):
        read.add(len(group))
        return matches(group, *rest)

    monkeypatch.setattr(jaccard, "matches", counted)
    took, base = [], words(200, 3).split()
    for n in (400, 800):
        r, rows, was = random.Random(n), [], read.value
        for i in range(n):
            mine = base.copy()
            for _ in range(2):
                mine[r.randrange(200)] = f"w{i}"
            rows.append((i, " ".join(mine), "en", "a", 1))
        found = jaccard.join(spark.createDataFrame(rows, DOCS), links=False).collect()
        assert {x.component_id for x in found} == {0}
        took.append(read.value - was)
    assert took[1] < 2.5 * took[0]


def test_copies_that_the_filter_lets_through_change_nothing(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "members", lambda docs, ids: (F.lit(0).cast("long"), lambda places: np.ones(len(places), bool)))
    rows = many()
    rows += [(1000 - r[0], *r[1:]) for r in rows[::2]]
    found = jaccard.join(spark.createDataFrame(rows, DOCS), links=False).collect()
    assert sorted(map(tuple, found), key=repr) == brute(rows)


def test_bands_of_similar_sizes_are_neighbours(spark):
    rows = spark.range(1, 20001).select("id", jaccard.band_of(F.col("id"), 80).alias("a"), jaccard.band_of(F.ceil(F.col("id") * 0.8), 80).alias("b"), jaccard.band_of(F.col("id"), 50).alias("c"), jaccard.band_of(F.ceil(F.col("id") / 2), 50).alias("d"))
    assert rows.where("a - b > 1 OR c - d > 1 OR a < b").count() == 0


def test_chain_of_near_copies_and_short_runs(spark, monkeypatch):
    """Runs longer than SHORT_RUN and clusters larger than TILE give the same components."""
    base = words(60, 9).split()
    rows, r = [], random.Random(3)
    for i in range(40):
        mine = base.copy()
        for _ in range(i % 5):
            mine[r.randrange(60)] = f"w{r.randrange(10**6)}"
        rows.append((i, " ".join(mine + base[: i % 3]), "en", "a", 1))
    want = brute(rows)
    for short, tile in ((48, 256), (3, 8)):
        monkeypatch.setattr(jaccard, "SHORT_RUN", short)
        monkeypatch.setattr(jaccard, "TILE", tile)
        found = jaccard.join(spark.createDataFrame(rows, DOCS)).select("doc_id", "n_shingles", "component_id").collect()
        assert sorted(map(tuple, found), key=repr) == want


def test_links_count_other_classes(spark):
    rows = [(0, words(50, 1), "", "", 0), (1, words(50, 1) + " extra", "", "", 0), (2, words(50, 1), "", "", 0)]
    found = {r.doc_id: r.links for r in jaccard.join(spark.createDataFrame(rows, DOCS)).collect()}
    assert found == {0: 1, 1: 1, 2: 1}


def test_multi_match_prefixes_lose_no_pair():
    """Two similar sets share as many prefix shingles as the smaller multi-match asks for."""
    r = np.random.default_rng(1)
    counts = r.integers(0, 500, 1 << jaccard.COUNT_BITS).astype(np.uint64)
    for n in (1, 4, 5, 20, 200, 1500):
        for _ in range(20):
            a = r.integers(0, 1 << 63, n, np.uint64)
            k = int(n * 0.1)
            b = np.concatenate([a[k:], r.integers(0, 1 << 63, k, np.uint64)])
            a, b = np.unique(a), np.unique(b)
            (la, pa_), (lb, pb) = (jaccard.prefix(x, counts, 250.0) for x in (a, b))
            both = len(np.intersect1d(a, b))
            if 100 * both >= 80 * len(np.union1d(a, b)):
                assert len(np.intersect1d(pa_, pb)) >= min(la, lb)


def test_runs_do_not_depend_on_batches():
    r = random.Random(5)
    rows = sorted((t, r.randrange(10, 60), d, 1 + d % 3) for t in range(30) for d in r.sample(range(100), r.choice([1, 2, 5, 60])))
    def links(size):
        batches = [pa.RecordBatch.from_arrays([pa.array([x[i] for x in rows[a : a + size]], pa.int64()) for i in (0, 2, 1, 3)], names=list("tdnl")) for a in range(0, len(rows), size)]
        out = {}
        for b in jaccard.Runs(80).all(iter(batches)):
            for a, c, s, n in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                was = out.get((a, c), (0, 99))
                out[a, c] = was[0] + s, min(was[1], n)
        return out
    assert links(7) == links(10**6) == links(1)
    hot = sorted((t, k, n, d, m) for t, n, d, m in rows for k in ((d % 3,) if t % 2 else (-1,)))
    def pieces(size):
        batches = [pa.RecordBatch.from_arrays([pa.array([x[i] for x in hot[a : a + size]], pa.int64()) for i in (0, 3, 2, 4, 1)], names=list("tdnls")) for a in range(0, len(hot), size)]
        out = [r for b in jaccard.Runs(80).all(iter(batches)) for r in b.to_pylist()]
        return sorted({(r["a"], r["b"], r["head"]) for r in out}), {r["a"] for r in out if r["head"]}
    assert pieces(7) == pieces(10**6) == pieces(1) and pieces(7)[1] == {t for t, k, *_ in hot if k >= 0}


def test_shingles_ignore_case_and_batches():
    texts = ["A b  C d\te f", "a B c D E F", "", None, "x", " ".join(["w" * 200] * 9), "é ü ß ñ ç"]
    together, alone = Shingler().sets(texts), [Shingler().sets([t])[0] for t in texts]
    assert all((x == y).all() for x, y in zip(together, alone, strict=True))
    assert (together[0] == together[1]).all() and [len(s) for s in together] == [2, 2, 0, 0, 1, 1, 1]


def test_components_of_paths_and_stars(spark, monkeypatch):
    r = random.Random(9)
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 120)] + [(200, 200)]
    edges += [(r.randrange(300, 500), r.randrange(300, 500)) for _ in range(90)]
    want = {}
    for a, b in edges:
        if a != b:
            low = min(want.get(a, a), want.get(b, b))
            joined = {want.get(a, a), want.get(b, b)}
            want |= {a: low, b: low} | {n: low for n, c in want.items() if c in joined}
    for few in (graph.FEW_EDGES, 0):
        monkeypatch.setattr(graph, "FEW_EDGES", few)
        found = {x.node: x.component for x in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
        assert found == want


def test_without_keeps_everything_else(spark):
    docs = spark.createDataFrame([(i if i % 7 else None, "t", i) for i in range(500)], "doc_id long, text string, _id int")
    drop = spark.createDataFrame([(i,) for i in range(0, 500, 3)], "id long")
    found = sorted(r._id for r in jaccard.without(docs, drop).collect())
    assert found == [i for i in range(500) if not i % 7 or i % 3]
