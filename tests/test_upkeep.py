"""Probe runs, row-addressed sources and checks on small fixtures."""

import gzip
import hashlib
import json
import math

import numpy as np
import pytest

from sparkloom.functions import budgets
from sparkloom.operators import probes
from sparkloom.sources import rows
from pyspark.sql import functions as F


def test_learning_rate_joins_its_parts(spark):
    r = spark.range(0, 1441).select("id", budgets.learning_rate(F.col("id"), F.lit(1440)).alias("r")).orderBy("id").collect()
    assert r[0].r == 0 and r[144].r == pytest.approx(budgets.PEAK) and r[1296].r == pytest.approx(budgets.PEAK)
    assert r[1440].r == pytest.approx(0.1 * budgets.PEAK) and r[1368].r == pytest.approx(0.55 * budgets.PEAK)


def test_token_budget_is_whole_steps(spark):
    s = budgets.token_budget(F.col("r"))
    got = spark.createDataFrame([(4.96,), (20.0,), (0.0,), (-1.0,), (0.001,)], "r double").select(*[c.alias(n) for c, n in zip(s, "stu")]).collect()
    assert tuple(got[0]) == (1439 * 96, 1439, 1439 * 96 * 2048)
    assert got[1].t == int(20 * 57_078_144) // 2048 // 96
    assert all(tuple(r) == (None, None, None) for r in got[2:])


def test_step_law_recovers_a_curve_and_needs_five_points(spark):
    curve = [("a", s, 1.2 + 3.0 * s**-0.4) for s in range(120, 1441, 120)] + [("b", s, 1.0) for s in (1, 2, 3, 4)]
    df = spark.createDataFrame([(r, s, float(v)) for r, s, v in curve], "run string, step long, loss double")
    got = {r.run: r for r in probes.extrapolate(probes.step_laws(df, "run"), 5806).collect()}
    assert got["a"].alpha == pytest.approx(0.4, abs=1e-3) and got["a"].rmse < 1e-6
    assert got["a"].expected == pytest.approx(1.2 + 3.0 * 5806**-0.4, abs=1e-4) and got["a"].measured_step == 1440
    assert got["b"].expected is None and got["b"].n_points == 4


def test_step_law_keeps_its_bounds():
    step = np.arange(1.0, 30)
    floor, scale, alpha, _ = probes.fit_step_law(step, 2 + 0.01 * step)
    assert 1.0 <= floor <= 2.01 * 1.001 + 1e-9 and 0 <= scale and 0.01 <= alpha <= 2


def test_paired_draws_have_as_many_items_as_there_are(spark):
    items = spark.range(30).select(F.col("id").alias("item"))
    d = probes.paired_draws(items, 4, 1)
    assert {r.draw: r.n for r in d.groupBy("draw").agg(F.sum("times").alias("n")).collect()} == dict.fromkeys(range(4), 30)
    assert d.exceptAll(probes.paired_draws(items.repartition(3), 4, 1)).isEmpty()


def test_ordered_vector(spark):
    v = spark.createDataFrame([("a", 1.0), ("b", None), ("c", 3.0)], "k string, v double")
    assert probes.ordered_vector(v, ["c", "a"], "k", "v") == [3.0, 1.0]
    for names in (["a", "b"], ["z"]):
        with pytest.raises(ValueError):
            probes.ordered_vector(v, names, "k", "v")


def test_snapshot(spark, tmp_path):
    line = lambda i: json.dumps({"id": i, "text": "x" * 1100}) + "\n"
    (tmp_path / "data").mkdir()
    (tmp_path / "deep" / "er").mkdir(parents=True)
    (tmp_path / "none").mkdir()
    (tmp_path / "none" / "readme.txt").write_text("x" * 2000)
    (tmp_path / "a.jsonl").write_text(line(1))
    (tmp_path / "tiny.jsonl").write_text("{}\n")
    with gzip.open(tmp_path / "data" / "b.jsonl.gz", "wt", compresslevel=0) as f:
        f.write(line(2))
    (tmp_path / "deep" / "er" / "my-dataset-1.jsonl").write_text(line(3))
    (tmp_path / "deep" / "other.jsonl").write_text(line(4))
    got = rows.read_snapshot(spark, str(tmp_path), "id long, text string")
    assert sorted(r.id for r in got.collect()) == [1, 2, 3]
    with pytest.raises(FileNotFoundError):
        rows.read_snapshot(spark, str(tmp_path / "none"), "id long").collect()


def test_line_rows_skip_blank_lines(spark, tmp_path):
    p = tmp_path / "x.jsonl"
    p.write_text('{"v": 1}\n\n  \n{"v": 2}\n{"v": 3}\n')
    got = rows.line_rows(spark, [str(p)], "v long")
    assert [(r.row, r.v) for r in got.orderBy("row").collect()] == [(0, 1), (1, 2), (2, 3)]
    want = spark.createDataFrame([(2,), (0,), (0,)], "row long")
    assert sorted(r.v for r in rows.take_rows(got, want).collect()) == [1, 3]
    with pytest.raises(IndexError):
        rows.take_rows(got, spark.createDataFrame([(3,)], "row long"))


def test_float_table_and_chunk_digests(spark, tmp_path):
    x = np.arange(12, dtype="<f4").reshape(4, 3)
    (tmp_path / "t.bin").write_bytes(x.tobytes())
    table = rows.read_float_table(spark, str(tmp_path / "t.bin"), 3)
    assert [r.scores for r in table.orderBy("row").collect()] == x.tolist()
    got = {r.chunk: r for r in rows.chunk_digests(table, 3, "row", "scores").collect()}
    assert got[0].sha256 == hashlib.sha256(x[:3].tobytes()).hexdigest() and got[1].n == 1 and got[1].finite
    bad = spark.createDataFrame([(0, [1.0, math.nan])], "row long, scores array<float>")
    assert not rows.chunk_digests(bad, 3, "row", "scores").first().finite
    with pytest.raises(Exception, match="whole records"):
        rows.read_float_table(spark, str(tmp_path / "t.bin"), 5).collect()
