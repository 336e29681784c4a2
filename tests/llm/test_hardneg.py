from math import isfinite

import duckdb
import numpy as np
import pytest

from sparkloom.llm import hardneg, vectors
from sparkloom.llm.queries import op13_hard_negatives

SCHEMA = "vec_id long, embedding array<double>, label long"
LAST = 1 << 62


def brute(rows, every=100, positives=5, negatives=5):
    rows = [(i, [int(np.floor(256 * x)) for x in v], y) for i, v, y in rows if v is not None and y is not None and all(x is not None and isfinite(x) for x in v)]
    out = []
    for at, (i, v, y) in enumerate(rows):
        if i is None or i % every:
            continue
        scored = [(-min(max(sum(a * b for a, b in zip(v, w)), -(1 << 63)), (1 << 63) - 1), j is None, j if j is not None else LAST, z) for n, (j, w, z) in enumerate(rows) if n != at and len(w) == len(v)]
        for p in sorted(r for r in scored if r[3] == y)[:positives]:
            fit = sorted(r for r in scored if r[3] != y and 80 * -p[0] <= 100 * -r[0] <= 100 * -p[0])[:negatives]
            out += [(i, None if p[1] else p[2], n + 1, None if r[1] else r[2], -p[0], -r[0]) for n, r in enumerate(fit)]
    return sorted(out, key=str)


def mined(spark, rows, **how):
    df = spark.createDataFrame([(i, v if v is None else [None if x is None else float(x) for x in v], y) for i, v, y in rows], SCHEMA)
    return sorted(map(tuple, hardneg.mine(df.repartition(3), **how).collect()), key=str)


@pytest.fixture
def small_blocks(monkeypatch):
    for name, n in {"PILOTS": 60, "SPLIT": 8, "LEAVES": 6, "ANCHOR_BLOCK": 9, "CANDIDATE_BLOCK": 40, "ANCHOR_LEAF": 3, "CANDIDATE_LEAF": 5}.items():
        monkeypatch.setattr(hardneg, name, n)


def test_search_is_exact(spark, small_blocks):
    rng = np.random.default_rng(5)
    centre = rng.normal(size=(6, 8))
    v = centre[rng.integers(6, size=600)] + rng.normal(size=(600, 8)) * 0.3
    v[100:200] = v[100]  # copies, of several labels
    v[300:305] = 0
    rows = [(i, x.tolist(), int(rng.integers(4))) for i, x in enumerate(v)]
    got = mined(spark, rows, every=10)
    assert got == brute(rows, every=10) and len(got) > 500


def test_repeated_and_missing_ids(spark, small_blocks):
    rng = np.random.default_rng(9)
    v = rng.integers(-2, 4, (300, 5)) / 4
    rows = [(None if i % 9 == 0 else i % 80, x.tolist(), int(rng.integers(3))) for i, x in enumerate(v)]
    rows += rows[:120]
    assert mined(spark, rows, every=10) == brute(rows, every=10)


@pytest.mark.parametrize("vast", [1, 100])
def test_any_finite_size(spark, small_blocks, vast):
    rng = np.random.default_rng(vast)
    rows = [(i, rng.normal(size=2).tolist(), int(rng.integers(2))) for i in range(150)]
    rows += [(1000 + i, [[0.0, 1e200], [1e160, -1.0], [1e17, 3.0], [2.0**40, 5.0]][i % 4], int(rng.integers(2))) for i in range(vast)]
    got = mined(spark, rows, every=50)
    assert got == brute(rows, every=50)


def test_odd_rows(spark, small_blocks):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [1.0, 1.0], 1), (0, [1.0, 1.0], 1), (0, [1.0, 0.5], 1), (1, [1.0, 1.0], 2), (2, [0.9, 1.0], 2), (3, [1.0, 0.9], 1), (4, None, 1), (5, [1.0, None], 1), (6, [nan, 1.0], 2),
        (7, [inf, 1.0], 2), (8, [1.0, 1.0], None), (None, [1.0, 0.95], 2), (None, [1.0, 1.0], 1), (100, [1.0, 2.0, 3.0], 1), (101, [1.0, 2.0, 3.0], 1), (102, [1.0, 2.0, 2.5], 2), (200, [], 1), (201, [], 2), (202, [], 1),
    ]
    assert mined(spark, rows) == brute(rows)
    assert mined(spark, []) == []
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as id", "2 as anchor", "3 as leaf", "4 as v")
    assert sorted(map(tuple, hardneg.mine(df).collect()), key=str) == brute(rows)


def test_scores_are_exact():
    rng = np.random.default_rng(1)
    a, c = np.floor(rng.normal(size=(6, 3)) * 1e9), np.floor(rng.normal(size=(9, 3)) * np.array([[1.0], [1e9], [1e300]] * 3))
    want = [[min(max(sum(int(x) * int(y) for x, y in zip(p, q)), vectors.LOW), vectors.HIGH) for q in c] for p in a]
    assert vectors.scores(a, c).tolist() == want


def test_interval_holds_all_products():
    rng = np.random.default_rng(2)
    x, y = rng.normal(size=(200, 4)) * 100, rng.normal(size=(300, 4)) * 50 + 20
    a, b = hardneg.Tree(x, 10), hardneg.Tree(y, 10)
    least, most = hardneg.interval(a.centre, a.radius, b.centre, b.radius)
    for i, p in enumerate(a.rows):
        for j, q in enumerate(b.rows):
            s = x[p] @ y[q].T
            assert least[i, j] <= s.min() and s.max() <= most[i, j]


def test_sql(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{sf_dir}/embeddings.parquet'")
    got = sorted(map(tuple, op13_hard_negatives(spark, sf_dir).collect()))
    assert got == sorted(con.execute(hardneg.ORACLE).fetchall())
