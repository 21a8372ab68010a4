"""Every query with SQL gives DuckDB's rows at sf0.001."""

import math
import os

import duckdb
import pytest

from brightloom.durable import durable
from brightloom.plans import lists, ontologies, people, scoring, services, store, texts  # noqa: F401 (register their queries)
from brightloom.plans import queries as engine

SF = "/root/testdata/sf0.001"
ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.fixture(scope="module", autouse=True)
def scores_once(spark):
    """The queries over scores share one written scoring here; by themselves each works it out."""
    kept, real, modules = {}, scoring.all_scores, (scoring, people, texts)

    def once(session, sf_dir):
        if sf_dir not in kept:
            kept[sf_dir] = durable(real(session, sf_dir))
        return kept[sf_dir]

    for m in modules:
        m.all_scores = once
    yield
    for m in modules:
        m.all_scores = real


def plain(v):
    if v is None:
        return "null"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, int | float) or hasattr(v, "as_integer_ratio"):
        return f"{float(v):.6g}" if math.isfinite(v) else str(v)
    return str(v)


@pytest.mark.parametrize("name", sorted(engine.SQL))
def test_same_rows(spark, duck, name):
    found = engine.QUERIES[name](spark, SF)
    told = duck.execute(engine.SQL[name])
    columns = [c[0] for c in told.description]
    assert sorted(columns) == sorted(found.columns)
    wanted = sorted(tuple(plain(r[columns.index(c)]) for c in sorted(columns)) for r in told.fetchall())
    got = sorted(tuple(plain(r[c]) for c in sorted(columns)) for r in found.collect())
    assert got == wanted


def test_registry():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_needs_no_session():
    """The driver imports the entry before it makes a session."""
    import subprocess
    import sys

    told = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"], capture_output=True, text=True, cwd=ROOT, timeout=120)
    assert told.returncode == 0, told.stderr
