"""Every registered query against its SQL on the smallest tables."""

import os

import duckdb
import pytest
from massline.plans import catalogue

DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("set timezone='UTC'")
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", list(catalogue.PLANS))
def test_query(spark, duck, name):
    df = catalogue.PLANS[name](spark, DIR)
    cols = sorted(df.columns)
    got = sorted(repr(tuple(r[c] for c in cols)) for r in df.collect())
    assert got
    if name in catalogue.SQL:
        cur = duck.execute(catalogue.SQL[name])
        names = [x[0] for x in cur.description]
        assert sorted(names) == cols
        assert got == sorted(repr(tuple(r[names.index(c)] for c in cols)) for r in cur.fetchall())


def test_result_tables(spark, tmp_path):
    from massline.plans import tables
    from massline.sources import responses

    assert set(tables.TABLES.values()) <= set(catalogue.PLANS)
    paths = tables.write(spark, DIR, str(tmp_path), ["token_tier", "verdicts"])
    assert [responses.table(spark, p).count() > 0 for p in paths] == [True, True]


def test_the_rest_stands_without_the_corpus_operators():
    """Nothing outside imports them, so that deleting them leaves the other queries."""
    from pathlib import Path

    root = Path(__file__).resolve().parents[1]
    for p in [*root.glob("massline/**/*.py"), root / "bench.py"]:
        if "llm" not in p.parts:
            assert ".llm" not in p.read_text(), p


def test_the_entry_without_the_corpus_operators(tmp_path):
    """Their folders and the pipeline deleted: the entry imports and lists the other queries; a missing library is no such case."""
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parents[1]
    shutil.copytree(root / "massline", tmp_path / "massline", ignore=shutil.ignore_patterns("__pycache__", "llm"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    run = lambda: subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"], cwd=tmp_path, capture_output=True, text=True)
    assert run().stdout.split() == [str(len(catalogue.PLANS)), str(len(catalogue.SQL))]
    (tmp_path / "massline/llm").mkdir()
    assert run().stdout.split() == [str(len(catalogue.PLANS)), str(len(catalogue.SQL))]
    (tmp_path / "corpus_pipeline.py").write_text("import a_library_that_is_not_there\n")
    assert "a_library_that_is_not_there" in run().stderr
