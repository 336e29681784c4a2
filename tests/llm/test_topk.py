import duckdb
import numpy as np
import pytest

from sparkloom.llm import topk
from sparkloom.llm.queries import op3_topk


def brute(ids, x, k, every):
    out = []
    for i, q in zip(ids, x):
        if i % every == 0:
            best = sorted((-int(q @ y), j) for j, y in zip(ids, x) if j != i)[:k]
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(best)]
    return sorted(out)


def test_elimination_is_exact(spark, monkeypatch):
    monkeypatch.setattr(topk, "QUERY_BLOCK", 7)
    monkeypatch.setattr(topk, "CANDIDATE_BLOCK", 60)
    monkeypatch.setattr(topk, "CELL", 4)
    monkeypatch.setattr(topk, "PILOTS", 40)
    rng = np.random.default_rng(2)
    v = rng.normal(size=(400, 8)) * rng.choice([0.01, 1, 3], (400, 1))
    v[50:150] = v[50]  # ties
    v[200:210] = 0
    df = spark.createDataFrame([(i, [float(np.float32(y)) for y in x]) for i, x in enumerate(v)], "vec_id long, embedding array<float>")
    x = np.floor(256 * v.astype(np.float32).astype(np.float64))
    got = sorted(map(tuple, topk.top_k(df, k=5, every=10).collect()))
    assert got == brute(range(400), x, 5, 10)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (0, [1.0, 2.0]), (50, [1.0, 1.0]), (1, None), (2, [1.0, None]), (3, [nan, 1.0]), (4, [inf, 1.0]), (None, [0.25, 0.0]), (5, [0.5, 0.5]), (6, [1.0, 2.0, 3.0]), (7, [0.5, 0.5]), (8, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 as id", "2 as rank", "3 as key")
    got = sorted(map(tuple, topk.top_k(df).collect()), key=str)
    s = 65536
    zero = [(0, 1, 0, 5 * s), (0, 2, 50, 3 * s), (0, 3, 5, int(1.5 * s)), (0, 4, 7, int(1.5 * s)), (0, 5, None, s // 4)]
    assert got == sorted([*zero, *zero, (50, 1, 0, 3 * s), (50, 2, 0, 3 * s), (50, 3, 5, s), (50, 4, 7, s), (50, 5, None, s // 4)], key=str)
    assert topk.top_k(df.limit(0)).collect() == []


def test_repeated_and_missing_ids_equal_the_sql(spark, monkeypatch):
    """Ids that several rows share, with equal and other vectors, rows without an id, and ties."""
    monkeypatch.setattr(topk, "PILOTS", 30)
    monkeypatch.setattr(topk, "CANDIDATE_BLOCK", 50)
    rng = np.random.default_rng(7)
    ids = [None if i % 9 == 0 else int(i % 120) for i in range(500)]
    v = rng.integers(-3, 4, (500, 6)).astype(np.float32) / 4
    v[100:140] = v[100]
    df = spark.createDataFrame([(i, [float(y) for y in x]) for i, x in zip(ids, v)] * 2, "vec_id long, embedding array<float>")
    con = duckdb.connect()
    con.register("t", df.toPandas())
    con.execute("create view embeddings as select cast(vec_id as bigint) as vec_id, cast(embedding as float[]) as embedding from t")
    assert sorted(map(str, map(tuple, topk.top_k(df).collect()))) == sorted(map(str, con.execute(topk.ORACLE).fetchall()))


@pytest.mark.parametrize("vast", [1, 39, 100])
def test_no_row_is_lost_at_any_finite_size(spark, monkeypatch, vast):
    """Vectors whose squares overflow, as pivots, queries and candidates; scores of 0 among them, and beyond the longs."""
    monkeypatch.setattr(topk, "PILOTS", 60)
    monkeypatch.setattr(topk, "CANDIDATE_BLOCK", 50)
    rng = np.random.default_rng(vast)
    plain = [[-float(x), -float(y)] for x, y in rng.random((196, 2))]
    rows = [(0, [1.0, 0.0])] + [(1 + i, v) for i, v in enumerate(plain)]
    huge = [[0.0, 1e200], [0.0, -1e200], [-1e17, 2.0], [1e308, 1.0], [-3e30, 1.0]]
    rows += [(1000 + i, huge[i % 5] if vast == 100 else huge[0]) for i in range(vast)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    most = np.finfo(np.float64).max
    x = [[int(np.floor(min(max(256 * y, -most), most))) for y in v] for _, v in rows]
    want = []
    for a, (i, _) in enumerate(rows):
        if i % 50 == 0:
            s = sorted((-min(max(sum(p * q for p, q in zip(x[a], x[b])), -(1 << 63)), (1 << 63) - 1), j) for b, (j, _) in enumerate(rows) if a != b)
            want += [(i, r + 1, j, -t) for r, (t, j) in enumerate(s[:5])]
    assert sorted(map(tuple, topk.top_k(df).collect())) == sorted(want)


def test_large_numbers_are_exact(spark):
    big = float(1 << 29)
    rows = [(0, [big, 1.0]), (1, [big, 3.0]), (2, [big, 2.0]), (3, [big, 4.0]), (4, [-big, 4.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    x = np.array([[int(y) for y in r[1]] for r in rows], object)
    want = sorted((0, j, int(x[0] @ x[j])) for j in range(1, 5))
    assert sorted((r.query_id, r.vec_id, r.score) for r in topk.top_k(df, scale=1.0).collect()) == want


def test_sql(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{sf_dir}/embeddings.parquet'")
    assert sorted(map(tuple, op3_topk(spark, sf_dir).collect())) == sorted(con.execute(topk.ORACLE).fetchall())
