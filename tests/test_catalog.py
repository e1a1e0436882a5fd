"""Every query with an oracle against DuckDB on the smallest tables."""

import duckdb
import pytest

from peakframe.plans.catalog import ORACLES, QUERIES

from .conftest import SMALL

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SLOW = {"parsimony", "graph_cap_component", "kernel_heaviest_path", "pairs_greedy_cosine"}  # without oracle; covered by tests of their own


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    return c


def _key(row):
    return tuple(repr(v + 0.0) if isinstance(v, float) else repr(v) for v in row)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_oracle(spark, duck, name):
    df = QUERIES[name](spark, SMALL)
    cols = sorted(df.columns)
    got = sorted(_key(r[c] for c in cols) for r in df.collect())
    found = duck.execute(ORACLES[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == cols
    want = sorted(_key(r[names.index(c)] for c in cols) for r in found.fetchall())
    assert got == want


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES) - SLOW))
def test_runs(spark, name):
    rows = QUERIES[name](spark, SMALL)
    assert rows.count() > 0 and rows.distinct().count() > 1


def test_entry(spark):
    import __spark_entry__ as e

    df = e.entry(spark)
    assert df.columns == ["scan", "spectrum_file", "score", "is_decoy", "fdr", "q", "rank"] and df.count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
