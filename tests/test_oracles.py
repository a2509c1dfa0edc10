"""Every registered query of the smallest tables against its SQL."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for path in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return con


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, sql, name):
    df = entry.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    rows = sorted(repr(tuple(r[c] for c in columns)) for r in df.collect())
    assert len(set(columns)) == len(columns)
    if name in entry.oracle_sql():
        told = sql.execute(entry.oracle_sql()[name])
        names = [c[0] for c in told.description]
        assert sorted(names) == columns
        assert rows == sorted(repr(tuple(r[names.index(c)] for c in columns)) for r in told.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_the_core_stands_alone():
    """Nothing outside the subpackage for training data imports it."""
    for path in glob.glob("tidemark/**/*.py", recursive=True):
        if not path.startswith("tidemark/llm"):
            assert "tidemark.llm" not in open(path).read(), path


def test_the_core_is_registered_without_the_subpackage(monkeypatch):
    import importlib

    real = importlib.import_module

    def broken(name, *args):
        if name == "tidemark.llm":
            raise ModuleNotFoundError("No module named 'xxhash'", name="xxhash")
        return real(name, *args)

    monkeypatch.setattr(entry.importlib, "import_module", broken)
    assert "p1_found" in entry.queries() and "p3_found" not in entry.queries() and "p3_found" not in entry.oracle_sql()
