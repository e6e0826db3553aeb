"""The registered queries over whole small tables: against SQL where there is some, and their columns and laws."""

import glob
import hashlib
import os
import zlib

import duckdb
import pytest

from docloom.llm.common import table
from docloom.llm.queries import ORACLE_SQL, QUERIES

COLUMNS = {
    1: "doc_id n_words n_base first_word last_word base_labels labels score",
    2: "doc_id held_out score predicted",
    3: "doc_id source slot",
    4: "doc_id batch slot",
    5: "doc_id n_chars edited_sha256 fingerprint edited_fingerprint near_edited near_next",
    6: "page_id payload_bytes payload_digest record_type refers_to",
    7: "doc_id n_shingles component_id",
    8: "doc_id size text_crc32 law shard slot grown_shard",
    9: "query_id rank vec_id score",
    10: "doc_id held_out lang_pred score",
}


def test_ten_queries_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 11))


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, tiny, name):
    df = QUERIES[name](spark, tiny)
    n = int(name[2:].split("_")[0])
    assert set(COLUMNS[n].split()) <= set(df.columns)
    rows = df.collect()
    whole = table(spark, tiny, {6: "pages", 9: "embeddings"}.get(n, "documents")).collect()
    if n == 9:
        assert len(rows) == 5 * sum(r.vec_id % 50 == 0 for r in whole)
        return
    ids = [r.page_id if n == 6 else r.doc_id for r in whole]
    assert sorted(r[0] for r in rows) == sorted(ids)
    if n == 5:
        docs = sorted(whole, key=lambda r: -r.doc_id)
        by = {r.doc_id: r for r in rows}
        for a, b in zip(docs, docs[1:] + docs[:1], strict=True):
            k = len(a.text) // 3
            assert by[a.doc_id].edited_sha256 == hashlib.sha256((a.text[: len(a.text) - k] + b.text[:k]).encode()).hexdigest()
            near = {r.fingerprint for r in rows if 0 < bin(int(r.fingerprint, 16) ^ int(by[a.doc_id].fingerprint, 16)).count("1") <= 3}
            assert by[a.doc_id].n_near == len(near)
            assert len(by[a.doc_id].fingerprint) == 16 and by[a.doc_id].near_next == 1 - bin(int(by[a.doc_id].fingerprint, 16) ^ int(by[b.doc_id].fingerprint, 16)).count("1") / 64
    if n == 8:
        text = {r.doc_id: r.text for r in whole}
        load = [sum(r.size for r in rows if r.shard == s) for s in range(40)]
        assert max(load) - min(load) <= max(r.size for r in rows) and {r.law for r in rows} == {"bytes"}
        assert all(r.size == len(text[r.doc_id].encode()) + 16 and r.text_crc32 == zlib.crc32(text[r.doc_id].encode()) for r in rows)
        assert all(sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows))) for s in range(40))


@pytest.mark.parametrize("name", ORACLE_SQL)
def test_query_equals_sql(spark, tiny, name):
    con = duckdb.connect()
    for path in glob.glob(f"{tiny}/*.parquet"):
        files = f"{path}/**/*.parquet" if os.path.isdir(path) else path
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{files}')")
    df = QUERIES[name](spark, tiny)
    columns = sorted(df.columns)
    theirs = con.sql(f"SELECT {', '.join(columns)} FROM ({ORACLE_SQL[name]})").fetchall()
    assert sorted(map(repr, [tuple(r) for r in df.select(*columns).collect()])) == sorted(map(repr, theirs))
