"""Every query of the library against its SQL in DuckDB, and the entry without the llm parts."""

import glob
import os
import shutil
import subprocess
import sys

import duckdb
import pytest

from docloom.plans.registry import ORACLE_SQL, QUERIES

from .conftest import ROOT


@pytest.fixture(scope="module")
def duck(tiny):
    con = duckdb.connect()
    for path in glob.glob(f"{tiny}/*.parquet"):
        files = f"{path}/**/*.parquet" if os.path.isdir(path) else path
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{files}')")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, tiny, duck, name):
    df = QUERIES[name](spark, tiny)
    columns = sorted(df.columns)
    theirs = duck.sql(f"SELECT {', '.join(columns)} FROM ({ORACLE_SQL[name]})").fetchall()
    mine = [tuple(r) for r in df.select(*columns).collect()]
    assert mine and sorted(map(repr, mine)) == sorted(map(repr, theirs))


def test_entry_without_the_llm_parts(tmp_path):
    """What is left imports and offers its queries when the folders and the pipeline are gone; a broken module still fails."""
    for f in ("__spark_entry__.py", "docloom"):
        (shutil.copytree if os.path.isdir(f"{ROOT}/{f}") else shutil.copy)(f"{ROOT}/{f}", tmp_path / f)
    run = lambda: subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"], cwd=tmp_path, capture_output=True, text=True, env=os.environ | {"PYTHONPATH": str(tmp_path)})
    shutil.rmtree(tmp_path / "docloom/llm", ignore_errors=True)
    found = run()
    assert found.returncode == 0, found.stderr
    assert found.stdout.split()[-2:] == [str(len(QUERIES)), str(len(ORACLE_SQL))]
    (tmp_path / "docloom/llm").mkdir()
    (tmp_path / "docloom/llm/__init__.py").write_text("")
    (tmp_path / "docloom/llm/queries.py").write_text("QUERIES, ORACLE_SQL = {}, {}\n")
    (tmp_path / "corpus_pipeline.py").write_text("import a_module_that_is_missing\n")
    assert run().returncode != 0
