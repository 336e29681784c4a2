"""Boosted trees leaf by leaf, byte-pair encoding, and averages as streaming state."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sparkloom.functions.bpe import PATTERN, BytePairs, load_ranks
from sparkloom.operators import boosting, rebuild
from sparkloom.streaming import averages

RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"


# --- boosted trees ----------------------------------------------------------------------------------------------------
def plain(x, y, edges, s):
    """Predictions of the rows by the same rule on whole rows: every leaf's gains from its own rows."""
    bins = np.array([[sum(e < v for e in edges[j]) for j, v in enumerate(row)] for row in x])
    f, out = np.full(len(y), y.mean()), []
    for _ in range(s.rounds):
        g, leaves = f - y, [(np.arange(len(y)), 0)]
        score = lambda rows: g[rows].sum() ** 2 / (len(rows) + s.l2)
        while len(leaves) < s.leaves:
            best = None
            for i, (rows, depth) in enumerate(leaves):
                for j in range(x.shape[1]) if depth < s.depth else ():
                    for b in range(bins.max() + 1):
                        left, right = rows[bins[rows, j] <= b], rows[bins[rows, j] > b]
                        if min(len(left), len(right)) >= s.least_rows:
                            gain = score(left) + score(right) - score(rows)
                            if best is None or gain > best[0] + 1e-12:
                                best = gain, i, left, right
            if best is None or best[0] <= boosting.LEAST_GAIN:
                break
            _, i, left, right = best
            depth = leaves.pop(i)[1] + 1
            leaves += [(left, depth), (right, depth)]
        if len(leaves) == 1:
            break
        for rows, _ in leaves:
            f[rows] -= s.rate * g[rows].sum() / (len(rows) + s.l2)
        out.append(len(leaves))
    return f, out


@pytest.mark.parametrize("s", [boosting.Settings(5, 3, 4, 0.3, 3, 1.0, 16), boosting.Settings(4, 2, 3, 0.5, 20, 0.0, 255), boosting.Settings(31, 9, 2, 1.0, 1, 0.1, 8)])
def test_trees_equal_plain_ones(spark, s):
    rng = np.random.default_rng(3)
    x = rng.random((120, 3)).round(2)
    y = 3 * x[:, 0] + np.sin(9 * x[:, 1]) * (x[:, 2] > 0.4) + rng.normal(0, 0.05, 120)
    df = spark.createDataFrame([(i, *map(float, r), float(v)) for i, (r, v) in enumerate(zip(x, y))], "i int, a double, b double, c double, y double").repartition(3)
    model = boosting.fit(df, ["a", "b", "c"], "y", s)
    got = [r.prediction for r in model.predict(df).orderBy("i").collect()]
    want, leaves = plain(x, y, model.edges, s)
    assert np.allclose(got, want, atol=1e-9)

    def count(t):
        return 1 if t.left is None else count(t.left) + count(t.right)

    assert [count(t) for t in model.trees] == leaves


def test_growth_is_by_gain_not_by_level(spark):
    """A target with all its structure on one side: depth goes there, up to the leaves allowed."""
    rows = [(float(i), float((i >= 64) * (i % 16 + i // 8))) for i in range(128)]
    df = spark.createDataFrame([*rows, (None, 5.0), (3.0, float("nan"))], "x double, y double")
    tree = boosting.fit(df, ["x"], "y", boosting.Settings(5, 9, 1, 1.0, 1, 0.0)).trees[0]
    depth = lambda t: 0 if t.left is None else 1 + max(depth(t.left), depth(t.right))
    assert depth(tree) >= 3 and min(depth(tree.left), depth(tree.right)) == 0
    with pytest.raises(ValueError):
        boosting.fit(df.limit(0), ["x"], "y")


def test_grid_puts_the_better_setting_first(spark):
    df = spark.range(200).select("id", (F.col("id") % 40 / 40).alias("x")).withColumn("y", F.when(F.col("x") > 0.5, 1.0).otherwise(0.0))
    got = boosting.grid_errors(df, ["x"], "y", [boosting.Settings(2, 1, 1, 0.01, 1, 1.0), boosting.Settings(2, 1, 3, 0.9, 1, 0.0)], 2, "id").collect()
    assert [r.setting for r in got] == [1, 0] and got[0].rmse < 0.01 < got[1].rmse


# --- byte pairs -------------------------------------------------------------------------------------------------------
ODD = ["", " ", "\n\n  \t x", "don't we'll I'D", "naïve 你好 🎉👩‍👩‍👧 ﬁ", "a" * 5000, "ab" * 3000 + " " * 700, "٣٤ ½ Ⅷ", "<|endoftext|> x", "\u0000́‍", "http://x.test/?q=1&&b", "ÿ" * 77 + "\U0010ffff"]


def test_ids_equal_the_library_s(spark):
    import tiktoken

    ranks = load_ranks(spark, RANKS)
    library = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = np.random.default_rng(5)
    texts = ODD + ["".join(map(chr, rng.integers(32, 0x2FF, 200))) for _ in range(60)] + ["".join(rng.choice(list("the anrs\n'"), 300)) for _ in range(60)]
    pairs = BytePairs(ranks, kept=50)
    assert pairs.encode(texts) == [library.encode_ordinary(t) for t in texts]
    for raw in (b"a" * 999, bytes(range(256)), b"the the", b""):
        assert list(pairs.merged(raw)) == library._encode_single_piece(raw) if raw else pairs.merged(raw) == ()


def test_documents_are_encoded(spark, sf_dir):
    import tiktoken

    ranks = load_ranks(spark, RANKS)
    library = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    got = {r.doc_id: r.tokens for r in rebuild.tokenise(docs, BytePairs(ranks).encode).collect()}
    assert got == {r.doc_id: [*library.encode_ordinary(r.text), rebuild.EOS] for r in docs.collect()}
    counts = {r.doc_id: r.n_tokens for r in rebuild.token_counts(docs, BytePairs(ranks).encode).collect()}
    assert counts == {k: len(v) - 1 for k, v in got.items()}


# --- averages ---------------------------------------------------------------------------------------------------------
@pytest.mark.parametrize("keep, seeded", [(0.9, False), (0.5, True), (0.0, False), (0.999, False)])
def test_a_restarted_stream_equals_the_fold(spark, tmp_path, keep, seeded):
    rng = np.random.default_rng(7)
    rows = [(i, int(rng.integers(3)) if i % 50 else 9, float(rng.normal())) for i in range(600)]
    want, state = {}, {}
    for i, k, v in rows:
        shadow, weight, n = state.get(k, (v, 1.0, 0) if seeded else (0.0, 0.0, 0))
        base = shadow / weight if n else None
        shadow, weight = keep * shadow + (1 - keep) * v, keep * weight + 1 - keep
        state[k] = (shadow, weight, n + 1)
        want[i] = (str(k), base, shadow / weight, n + 1)
    schema = "event int, user int, value double"
    for part in ([*rows[:250], (-1, 0, None)], rows[250:251], rows[251:]):  # each run starts anew from the state
        spark.createDataFrame(part, schema).repartition(3).write.mode("append").parquet(str(tmp_path / "in"))
        stream = averages.running_averages(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), "user", "value", "event", keep, seeded)
        stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "at")).trigger(availableNow=True).start().awaitTermination()
    got = {r.event: (r.key, r.baseline, r.average, r.n) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got.keys() == want.keys()
    for i, (k, base, now, n) in want.items():
        assert got[i][0] == k and got[i][3] == n and got[i][2] == pytest.approx(now) and (got[i][1] == pytest.approx(base) if base is not None else got[i][1] is None)


def test_keys_share_calls_and_states():
    """A call holds a bucket's keys, each with its own state, so calls don't grow with the keys."""
    held = []

    class Held:
        exists = lambda _: bool(held)
        get = lambda _: iter(list(held))

        def put(self, rows):
            held[:] = rows

    one = averages.Averages(0.0, "event", "value", False)
    one.state = Held()
    frame = lambda rows: pd.DataFrame([(0, *r) for r in rows], columns=["_bucket", "_key", "event", "value"])
    first = pd.concat(one.handleInputRows((0,), iter([frame([("a", 3, 5.0), ("b", 2, 1.0)]), frame([("a", 1, 4.0), (None, 4, 9.0)])]), None))
    assert sorted(first[["key", "event", "baseline", "average", "n"]].itertuples(index=False, name=None), key=lambda r: r[1]) == [("a", 1, None, 4.0, 1), ("b", 2, None, 1.0, 1), ("a", 3, 4.0, 5.0, 2), ("None", 4, None, 9.0, 1)]
    second = pd.concat(one.handleInputRows((0,), iter([frame([("b", 5, 2.0), (None, 6, 8.0)])]), None))
    assert sorted(second[["key", "baseline", "n"]].itertuples(index=False, name=None)) == [("None", 9.0, 2), ("b", 1.0, 2)]
    assert sorted((r[0] or "", r[-1]) for r in held) == [("", 2), ("a", 2), ("b", 2)]


def test_decay_over_many_blocks():
    v = np.random.default_rng(1).normal(size=5000)
    for keep in (0.01, 0.9, 0.9999):
        x, want = 2.0, []
        for y in v:
            x = keep * x + (1 - keep) * y
            want.append(x)
        assert np.allclose(averages.decayed(v, keep, 2.0), want, rtol=1e-9, atol=1e-9)
    assert isinstance(pd.Series(averages.decayed(np.zeros(0), 0.9, 1.0)), pd.Series)
