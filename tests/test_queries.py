"""Every registered query of the engine's own operators against its SQL."""

import duckdb
import pytest

from sparkloom.plans import analytics, choices, corpus, reading, rebuilding, upkeep

QUERIES = corpus.QUERIES | analytics.QUERIES | upkeep.QUERIES | rebuilding.QUERIES | choices.QUERIES | reading.QUERIES
SQL = corpus.SQL | analytics.SQL | upkeep.SQL | rebuilding.SQL | choices.SQL | reading.SQL
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return c


def cells(rows, columns):
    clean = lambda x: round(x, 6) + 0.0 if isinstance(x, float) else x
    return sorted(repr([clean(x) for _, x in sorted(zip(columns, r))]) for r in rows)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_dir, con, name):
    df = QUERIES[name](spark, sf_dir)
    rows = df.collect()
    assert rows or name in SQL  # what is right of the rows of queries without SQL is in the tests of their operators
    if name in SQL:
        got = con.execute(SQL[name])
        columns = [c[0] for c in got.description]
        assert sorted(columns) == sorted(df.columns)
        assert cells(rows, df.columns) == cells(got.fetchall(), columns)
