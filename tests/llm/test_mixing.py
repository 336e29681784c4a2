import duckdb
import pytest

from sparkloom.llm import mixing
from sparkloom.llm.queries import op2_mixing


def fill(sizes, weights, cap=3):
    """Sharing anew until no target is above its cap."""
    left, target = dict(sizes), {}
    budget = sum(sizes.values())
    while True:
        open_w = sum(weights[s] for s in left)
        share = {s: budget * weights[s] / open_w for s in left} if open_w else {}
        above = [s for s in left if share[s] > cap * sizes[s]]
        if not above:
            return target | share
        for s in above:
            target[s] = cap * sizes[s]
            budget -= target[s]
            del left[s]


def test_targets_equal_repeated_sharing(spark):
    sizes = {f"s{i:02d}": n for i, n in enumerate([5, 100, 1, 0, 7000, 3, 900, 42, 10_000, 12])} | {None: 77}
    order = sorted(k for k in sizes if k) + [None]
    weights = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r.source: r.target for r in mixing.source_targets(df).collect()}
    want = fill(sizes, weights)
    assert got == pytest.approx(want)


def test_thresholds_are_nested_and_near_target(spark):
    rows = [(i, f"w{i} " * (1 + i % 9), "ab"[i % 5 == 0]) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = mixing.mix(docs).collect()
    by = {}
    for r in out:
        assert 0 <= r.taken <= 3 * r.size
        by.setdefault(r.source, []).append(r)
    for rs in by.values():
        assert abs(sum(r.taken for r in rs) - rs[0].target) <= max(r.size for r in rs)
        more = sorted((r.h, r.copies) for r in rs)
        assert all(a[1] >= b[1] for a, b in zip(more, more[1:]))
    again = mixing.mix(docs.repartition(7)).collect()
    assert sorted(out) == sorted(again)


def test_odd_rows(spark, odd_docs, no_docs):
    rows = mixing.mix(odd_docs).collect()
    assert len(rows) == 10 and all(r.taken <= 3 * r.size for r in rows)
    assert {r.size for r in rows if r.doc_id in (3, 4, 5)} == {0}
    same = [r for r in rows if r.doc_id == 1]
    assert same[0] == same[1]
    assert mixing.mix(no_docs).collect() == []


def test_sql(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf_dir}/documents.parquet'")
    want = con.execute(mixing.ORACLE).fetchall()
    assert sorted(map(tuple, op2_mixing(spark, sf_dir).collect())) == sorted(want)
