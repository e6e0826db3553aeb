import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from docloom.llm import sharding, topk, warc
from docloom.llm.common import scratch

from .fixtures import DOCS, awkward


def brute_top(vectors, queries, k):
    out = []
    for q in sorted(set(queries)):
        mine = [v for i, v in vectors if i == q][0]
        scores = sorted((-sum(int(a) * int(b) for a, b in zip(mine, v, strict=True)), i) for i, v in vectors if i != q)[:k]
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scores)]
    return out


def test_top_is_brute_force_with_copies_and_ties(spark, monkeypatch):
    draw = np.random.default_rng(2)
    own = draw.normal(size=(700, 6)).round(2)
    own[100:400] = own[100]
    own[400:420] = 0
    rows = [(int(i), [float(x) for x in v]) for i, v in zip(draw.permutation(700), own, strict=True)]
    monkeypatch.setattr(topk, "DATA_BLOCK", 150)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 20)
    found = topk.top(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("vec_id") % 10 == 0).collect()
    whole = [(i, [int(np.floor(256 * np.float64(np.float32(x)))) for x in v]) for i, v in rows]
    assert sorted(map(tuple, found)) == brute_top(whole, [i for i, _ in rows if i % 10 == 0], topk.K)


def test_trees_cut_off_far_nodes_and_cover_their_points():
    draw = np.random.default_rng(4)
    data = np.concatenate([draw.normal(size=(600, 8)) + 40 * c for c in np.eye(8)]).round(3)
    ids = np.arange(len(data))
    s = topk.Search(data[::50], ids[::50], data, ids).run()
    full = data[::50] @ data.T
    full[np.arange(len(full)), ids[::50]] = -np.inf
    want = np.array([np.lexsort((ids, -row))[:5] for row in full])
    assert (s.ids == want).all() and s.compared < 0.7 * full.size
    nodes = [topk.cover_tree(data, ids)]
    while nodes:
        n = nodes.pop()
        assert np.sqrt(((data[n.rows] - n.center) ** 2).sum(1)).max() <= n.radius + 1e-9
        assert not n.children or sorted(np.concatenate([c.rows for c in n.children])) == sorted(n.rows)
        nodes += n.children


def test_one_large_vector_does_not_end_the_pruning():
    """Where float64 isn't exact, whole numbers are; the trees still cut off what can't reach."""
    draw = np.random.default_rng(4)
    data = np.concatenate([draw.normal(size=(600, 8)) * 3 + 200 * c for c in np.eye(8)]).round()
    data[77] = [3.0**30, -(2.0**60), 1, 2, 3, 4, 5, 6]
    ids = np.arange(len(data))
    s = topk.Search(data[::50], ids[::50], data, ids).run()
    whole = [[int(x) for x in row] for row in data]
    for n, q in enumerate(ids[::50]):
        best = sorted((-min(max(sum(a * b for a, b in zip(whole[q], row, strict=True)), topk.LOW), topk.HIGH), i) for i, row in enumerate(whole) if i != q)[:5]
        assert best == [(-x, i) for x, i in zip(s.scores[n].tolist(), s.ids[n].tolist(), strict=True)]
    assert s.compared < 0.7 * len(data) * len(data[::50])


def test_blocks_out_of_reach_are_not_sent_queries(spark, monkeypatch):
    """Clustered vectors in several blocks: most pairs of a query and a block are ruled out before anything is shipped."""
    monkeypatch.setattr(topk, "DATA_BLOCK", 100)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 30)
    draw, sent = np.random.default_rng(5), []
    own = np.concatenate([draw.normal(size=(200, 16)) * 0.02 + 3 * c for c in np.eye(16)]).astype(np.float32)
    rows = [(int(i), [float(x) for x in v]) for i, v in zip(draw.permutation(len(own)), own, strict=True)]
    searched = topk.searched
    monkeypatch.setattr(topk, "searched", lambda plan, data, k: sent.append(plan.count()) or searched(plan, data, k))
    found = topk.top(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("vec_id") % 20 == 0).collect()
    whole = [(i, [int(np.floor(256 * np.float64(x))) for x in v]) for i, v in rows]
    assert sorted(map(tuple, found)) == brute_top(whole, [i for i, _ in rows if i % 20 == 0], topk.K)
    queries, blocks = sum(i % 20 == 0 for i, _ in rows), len(rows) // 100
    assert sent[0] == queries and sum(sent) < 0.25 * queries * blocks


def test_top_of_awkward_vectors(spark):
    rows = [(0, [1.0, 2.0], "x"), (10, None, None), (20, [], None), (30, [1.0, None], None), (40, [float("nan"), 1.0], None), (50, [float("inf"), 1.0], None), (None, [1.0, 1.0], None), (1, [3.0, 1.0], None), (2, [1.0, 1.0, 1.0], None), (0, [1.0, 2.0], "x"), (60, [1e12, -1e12], None), (70, [1e308, 0.0], None)]
    top = lambda rows, kind="array<double>": sorted(map(tuple, topk.top(spark.createDataFrame(rows, f"vec_id long, embedding {kind}, score string"), F.col("vec_id") % 10 == 0).collect()))
    assert top(rows) == [(0, 1, 1, 256 * 768 + 512 * 256), (0, 2, 60, 256 * 256 * 10**12 - 512 * 256 * 10**12), (60, 1, 1, 256 * 10**12 * 512), (60, 2, 0, -256 * 10**12 * 256), (60, 3, 0, -256 * 10**12 * 256)]
    large = [(0, [1e30, 1.0], ""), (1, [1e30, 0.0], ""), (2, [-1e30, 0.0], ""), (3, [1e-3, 5.0], ""), (4, [1e305, -1e305], ""), (5, [0.0, 0.0], "")]
    assert top(large) == [(0, 1, 1, topk.HIGH), (0, 2, 4, topk.HIGH), (0, 3, 3, 256 * 1280), (0, 4, 5, 0), (0, 5, 2, topk.LOW)]
    assert top([], "array<float>") == []


def test_top_with_hot_ids_and_equal_vectors(spark, monkeypatch):
    monkeypatch.setattr(topk, "DATA_BLOCK", 20)
    rows = [(7 if i % 3 == 0 else 10 if i % 3 == 1 else i, [1.0, float(i % 2)] if i % 3 else [2.0, 2.0]) for i in range(300)] + [(301, [3.0])]
    whole = [(i, [int(256 * x) for x in v]) for i, v in rows if len(v) == 2]
    found = sorted(map(tuple, topk.top(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("vec_id") % 20 == 0).collect()))
    assert found == brute_top(whole, [i for i, _ in whole if i % 20 == 0], 5)


def pages():
    big, small = "<p>" + "x" * 1200, "<p>y"
    return [(1, "http://a/1", big), (2, "http://a/2", big), (3, None, big), (4, "http://a b\r\n", small), (5, "", small), (6, "u", None), (7, "u", ""), (8, "ü", "é漢" * 600), (None, "n", big), (9, "z", "é漢" * 600), (10, "r", "q" * 5000), (10, "r", "q" * 5000), (11, "two of an id", "w" * 3000), (11, "two of an id", "v" * 3000), (12, "", "w" * 3000)]


@pytest.mark.parametrize("few", [1 << 17, 0])
def test_archives_round_trip(spark, monkeypatch, few):
    monkeypatch.setattr(warc, "FEW_REVISITS", few)
    rows = [(*p, 1) for p in pages()]
    index = warc.write(spark.createDataFrame(rows, "page_id long, url string, html string, file int"), scratch(spark, "warc-test"), file_bytes=2000)
    assert index.count() == len(rows) and index.select("file").distinct().count() > 1
    found = warc.read(index).collect()
    assert len(found) == len(rows)
    assert sorted((r.record_type, r.refers_to) for r in found if r.page_id == 11) == [("response", None), ("revisit", 12)]
    by = {r.page_id: r for r in found if r.page_id != 11}
    assert {i: (r.record_type, r.refers_to) for i, r in by.items() if r.record_type == "revisit"} == {1: ("revisit", 3), 2: ("revisit", 3), None: ("revisit", 3), 8: ("revisit", 9)}
    for i, _, html in (p for p in pages() if p[0] != 11):
        r = by[i]
        body = (html or "").encode()
        assert r.payload_bytes == len(body) and r.payload_digest == __import__("hashlib").sha1(body).hexdigest()
        assert r.html is None if r.record_type == "revisit" else bytes(r.html) == body
    some = warc.read(index.where("page_id IN (3, 8)"), payload=False).collect()
    assert sorted(r.page_id for r in some) == [3, 8]
    assert warc.read(warc.write(spark.createDataFrame([], "page_id long, url string, html string"), scratch(spark, "warc-test"))).count() == 0


def test_very_long_and_hot_payloads(spark):
    """A payload of 30 MB, and one that a third of the pages bear."""
    long = "é" * 15_000_000
    rows = [(i, f"u{i}", "h" * 2000 if i % 3 == 0 else f"<p>{i}" * 300) for i in range(600)] + [(1000, "long", long), (1001, "long", long)]
    found = warc.read(warc.write(spark.createDataFrame(rows, "page_id long, url string, html string"), scratch(spark, "warc-test")), payload=False).collect()
    by = {r.page_id: r for r in found}
    assert len(found) == 602 and by[1001].payload_bytes == 30_000_000 and (by[1000].record_type, by[1000].refers_to) == ("revisit", 1001)
    assert {(r.record_type, r.refers_to) for r in found if r.page_id < 597 and r.page_id % 3 == 0} == {("revisit", 597)}
    assert [warc.tasks_for(n) for n in (0, 1, 5 << 20, 1 << 34, 1 << 44)] == [1, 1, 2, 4096, 65536]


def test_ranges_coalesce_and_damage_shows():
    assert warc.coalesced([(0, 10), (10, 5), (100, 5), (5000, 1)], gap=85, most=1000) == [(0, 105, [0, 1, 2]), (5000, 1, [3])]
    assert warc.coalesced([(0, 10), (10, 10), (20, 10)], gap=0, most=20) == [(0, 20, [0, 1]), (20, 10, [2])]
    member = warc.encode(1, "u", b"body", "00" * 20, None)
    with pytest.raises(ValueError):
        warc.decode(member)


@pytest.mark.parametrize("rows", [awkward(), []], ids=["awkward", "empty"])
def test_shards_are_gapless(spark, rows):
    docs = spark.createDataFrame([(*r, "s", 1) for r in rows], DOCS + ", shard string, slot int")
    found = sharding.shard(docs, shards=3, slots=16).collect()
    assert len(found) == len(rows)
    for s in {r.shard for r in found}:
        assert sorted(r.slot for r in found if r.shard == s) == list(range(sum(r.shard == s for r in found)))
    if rows:
        by = {r.doc_id: r for r in found}
        assert by[0].size == 16 and by[11].size == len(awkward()[11][1].encode()) + 16 and by[11].text_crc32 == zlib.crc32(awkward()[11][1].encode())


def test_shards_are_near_equal_and_rebalance_moves_little():
    draw = np.random.default_rng(1)
    sizes = [int(x) for x in draw.lognormal(8, 1, 8192)]
    one = sharding.assign(sizes, 40)
    load = np.bincount(one, sizes, 40)
    assert load.max() - load.min() <= max(sizes)
    two = sharding.rebalance(sizes, one, 41)
    moved = [i for i in range(8192) if one[i] != two[i]]
    assert {two[i] for i in moved} == {40} and np.bincount(two, sizes, 41).max() <= 1.02 * sum(sizes) / 41
    assert sum(sizes[i] for i in moved) <= 1.05 * sum(sizes) / 41


def brute_shards(rows, shards, slots):
    """Shard of each (id, crc, size, run of 64 copies), by giving slots in falling order to the lightest shard."""
    import xxhash

    def slot_of(*values):
        h = 42
        for v in values:
            h = h if v is None else xxhash.xxh64((v & (1 << 64) - 1).to_bytes(8, "little"), seed=h).intdigest()
        return (h - (1 << 64) if h >> 63 else h) % slots

    seen, weight, of = {}, [0] * slots, []
    for i, text, *_ in rows:
        key = i, zlib.crc32((text or "").encode()), len((text or "").encode()) + 16
        seen[key] = seen.get(key, -1) + 1
        of.append((*key, slot_of(*key, seen[key] // 64)))
        weight[of[-1][3]] += key[2]
    load, shard = [0] * shards, [0] * slots
    for s in sorted(range(slots), key=lambda s: (-weight[s], s)):
        shard[s] = min(range(shards), key=lambda k: (load[k], k))
        load[shard[s]] += weight[s]
    return sorted(((i, crc, size, s, shard[s]) for i, crc, size, s in of), key=repr)


def test_shards_are_brute_force_and_hot_ids_spread(spark):
    """Rows without an id, rows of one id, and rows equal in everything, a fifth of all each."""
    rows = [(None if i % 5 == 0 else 7 if i % 5 == 1 else 9 if i % 5 == 2 else i, "same" if i % 5 == 2 else "x" * (i % 50) + str(i), "", "", 0) for i in range(6000)]
    found = sharding.shard(spark.createDataFrame(rows, DOCS), shards=8, slots=512).collect()
    assert sorted(((r.doc_id, r.text_crc32, r.size, r.vslot, r.shard) for r in found), key=repr) == brute_shards(rows, 8, 512)
    load = np.bincount([r.shard for r in found], [r.size for r in found])
    assert load.max() <= 1.01 * load.min()
    for s in range(8):
        assert sorted(r.slot for r in found if r.shard == s) == list(range(sum(r.shard == s for r in found)))


def test_a_version_is_never_written_over(spark, tmp_path):
    sharding.stored(spark, str(tmp_path), 1, [0, 1], [5, 6], [1, 1])
    with pytest.raises(Exception, match="(?i)exist"):
        sharding.stored(spark, str(tmp_path), 1, [1, 0], [5, 6], [1, 1])
    (tmp_path / "version=2").mkdir()  # a run that was lost
    assert {r.map_version for r in sharding.shard(spark.createDataFrame(awkward(), DOCS), shards=2, slots=2, path=str(tmp_path)).collect()} == {3}
    assert sharding.latest(spark, str(tmp_path)) == 3


def test_a_stored_map_is_edited_and_applied(spark, tmp_path):
    """More rows and a shard more, then fewer shards: each run edits the version before it and keeps that one."""
    rows = [(i, "x" * (i % 90), "", "", 0) for i in range(4000)]
    path, seen = f"{tmp_path}/map", []
    for version, (n, shards) in enumerate([(3000, 4), (4000, 5), (4000, 3)], 1):
        docs = spark.createDataFrame(rows[:n], DOCS)
        found = sharding.shard(docs, shards=shards, slots=256, path=path).collect()
        assert len(found) == n and {r.map_version for r in found} == {version}
        load = np.bincount([r.shard for r in found], [r.size for r in found], shards)
        assert len(load) == shards and load.max() <= 1.1 * load.sum() / shards
        for s in range(shards):
            assert sorted(r.slot for r in found if r.shard == s) == list(range(sum(r.shard == s for r in found)))
        kept = sharding.shards_of(spark, path, version, 256)
        assert all(r.shard == kept[r.vslot] for r in found)
        seen.append(kept)
    assert sharding.latest(spark, path) == 3 and [sharding.shards_of(spark, path, v, 256) for v in (1, 2, 3)] == seen
    assert sum(a != b for a, b in zip(seen[0], seen[1], strict=True)) <= 256 * 0.3
    assert all(a == b for a, b in zip(seen[1], seen[2], strict=True) if a < 3 and b < 3) and sum(a != b for a, b in zip(seen[1], seen[2], strict=True)) <= 256 * 0.5
    with pytest.raises(ValueError):
        sharding.shard(spark.createDataFrame(rows, DOCS), shards=3, slots=128, path=path)
