"""Rule files, tool calls of any type, laws and searches over rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.functions import chat
from sparkloom.operators import curves, mixture
from sparkloom.plans import analytics, choices, rebuilding

RULES = """
sources:
  tulu-v2:
    drop_source_substrings: []
  openhermes-25:
    drop_non_english_language: true
    english_language_values: [EN]
  tulu-3:
    drop_source_substrings: [Bad]
  hermes-3:
  smoltalk:
    skip_configs: [skipped]
  dolci:
    drop_domains: [Safety]
    drop_if_function_calls: true
"""


def test_rules_from_a_file(spark, tmp_path):
    (tmp_path / "rules.yaml").write_text(RULES)
    rules = chat.load_rules(spark, str(tmp_path / "rules.yaml"))
    assert rules["openhermes-25"] == {"languages": ["en"]} and rules["hermes-3"] == {}
    df = spark.createDataFrame([("a bad one", "de", "skipped", "SAFETY"), ("aya", "en", "other", "x")], "source string, language string, config string, domain string")
    got = {s: [r.k for r in df.select(chat.keep_row(df, s, rules).alias("k")).collect()] for s in chat.EXCLUSION}
    assert got == {s: [s in ("tulu-v2", "hermes-3"), True] for s in got}


@pytest.mark.parametrize("text", ["[]", "sources: 1", RULES.replace("  hermes-3:\n", ""), RULES + "  more: {}\n", RULES.replace("[Bad]", "bad"), RULES.replace("[Bad]", "[1]")])
def test_wrong_rules_raise(spark, tmp_path, text):
    (tmp_path / "rules.yaml").write_text(text)
    with pytest.raises(ValueError):
        chat.load_rules(spark, str(tmp_path / "rules.yaml"))


@pytest.mark.parametrize("kind, empty, full", [
    ("string", ["NULL", "''", "' \n'", "'[]'", "'{ }'"], ["'f()'", "'[1]'"]),
    ("array<string>", ["NULL", "array()"], ["array('')", "array(NULL)"]),
    ("map<string,int>", ["NULL", "map()"], ["map('a', NULL)"]),
    ("struct<a:int>", ["NULL"], ["named_struct('a', NULL)"]),
    ("variant", ["NULL", "parse_json('[]')", "parse_json('{}')", "parse_json('null')"], ["parse_json('[1]')", "parse_json('3')"]),
])
def test_tool_fields_of_any_type(spark, kind, empty, full):
    for values, kept in ((empty, True), (full, False)):
        for v in values:
            df = spark.sql(f"SELECT array(named_struct('role', 'user', 'functions', CAST({v} AS {kind}))) AS messages")
            assert df.select(chat.keep_row(df, "dolci").alias("k")).first().k is kept, v


def test_laws_of_the_tables_are_found_again(spark, sf_dir):
    fits = {r.family: r for r in analytics.mixing_law_fit(spark, sf_dir).collect()}
    runs = analytics.law_runs(spark, sf_dir)
    assert set(fits) == {"f0", "f1"} and runs.select("run").distinct().count() > 20 and all(r.rmse < 1e-3 for r in fits.values())
    for r in analytics.leave_one_out(spark, sf_dir).collect():
        assert r.rmse < 0.01


def test_optima_of_the_fitted_laws(spark, sf_dir):
    laws = [(r.c, r.k, np.array(r.t)) for r in analytics.fitted_laws(spark, sf_dir).collect()]
    value = lambda w: np.mean([c + k * np.exp(t @ w) for c, k, t in laws])
    best = analytics.simplex_optimum(spark, sf_dir).orderBy("ord").collect()
    w = np.array([r.weight for r in best])
    assert w.sum() == pytest.approx(1) and w.min() >= 0.05 - 1e-9 and w.max() <= 0.8 + 1e-9 and best[0].loss == pytest.approx(value(w))
    points = [np.array([a, b, 1 - a - b]) for a in np.linspace(0.05, 0.8, 60) for b in np.linspace(0.05, 0.8, 60) if 0.05 <= 1 - a - b <= 0.8]
    assert best[0].loss <= min(map(value, points)) + 1e-9
    assert choices.global_search(spark, sf_dir).first().loss == pytest.approx(best[0].loss, abs=1e-6)


def test_near_optimal_equals_the_greedy_rule(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.dirichlet(np.ones(3)).tolist(), float(rng.integers(0, 40)) / 100) for i in range(400)]
    kept, seen = [], set()
    best = min(r[2] for r in rows)
    for i, w, x in sorted(rows, key=lambda r: (r[2], r[0])):
        key = tuple(round(v, 2) for v in w)
        if x <= best + 0.2 and key not in seen and len(kept) < 8 and all(sum(abs(a - b) for a, b in zip(w, k[1])) >= 0.3 for k in kept):
            kept.append((i, w, x))
        seen.add(key)
    got = mixture.near_optimal(spark.createDataFrame(rows, "id long, w array<double>, loss double"), 0.2, 8, 0.3)
    assert [tuple(r) for r in got.collect()] == kept


def test_surrogate_queries_learn(spark, sf_dir):
    rows = analytics.gbt_surrogate(spark, sf_dir).collect()
    y, p = np.array([r.y for r in rows]), np.array([r.prediction for r in rows])
    assert len(rows) > 20 and ((y - p) ** 2).mean() < 0.3 * y.var()
    grid = choices.surrogate_grid(spark, sf_dir).collect()
    assert [r.rmse for r in grid] == sorted(r.rmse for r in grid) and {r.leaves for r in grid} == {3, 7}


def test_ladders_of_columns(spark):
    got = {r.f: r.s for r in spark.range(0, 400).select(F.col("id").alias("f"), curves.ladder_of(F.col("id")).alias("s")).collect()}
    assert got == {n: curves.ladder(n) for n in range(400)}


def test_byte_pair_query(spark, sf_dir):
    rows = rebuilding.byte_pairs(spark, sf_dir).collect()
    assert len(rows) == spark.read.parquet(f"{sf_dir}/documents.parquet").count() and all(len(r.tokens) == r.n_tokens + 1 for r in rows)
