"""Single operators on small fixtures with known results."""

import gzip
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.functions import chat, text
from sparkloom.operators import contamination, curves, gates, mixture, relational, sampling, selection
from sparkloom.plans import corpus
from sparkloom.sources import files
from sparkloom.streaming import logs


def one(df):
    return df.first()[0]


def test_normalise_and_compatibility_form(spark):
    df = spark.createDataFrame([("ﬁne\tÉTÉ,  x_y — ½",), ("",), (None,)], "s string")
    assert [r[0] for r in df.select(text.normalize(F.col("s"), True)).collect()] == ["fine été x_y 1 2", "", None]
    assert [r[0] for r in df.select(F.size(text.words(text.normalize(F.col("s"))))).collect()][1:] == [0, 0]


@pytest.mark.parametrize("n, keys", [(7, 0), (8, 1), (12, 1), (13, 1), (15, 3)])
def test_keys_by_length(spark, n, keys):
    assert one(spark.range(1).select(F.size(text.keys_for_field(F.array(*[F.lit(f"w{i}") for i in range(n)]))))) == keys


def test_flatten(spark):
    df = spark.createDataFrame([(1, 1, "gpt", " Hello "), (1, 0, "human", "Hi"), (1, 2, "critic", "No"), (1, 3, None, "  ")], "conv_id long, turn int, role string, text string")
    assert chat.flatten_rows(df).first().text == "User: Hi\n\nAssistant: Hello\n\nCritic: No"


def test_exclusion_rules(spark):
    rows = [("x", "ai2/WildGuardMix", None, "Safety", None, "fr"), ("y", "flan", "Coconot-v1", None, None, None), ("z", "flan", None, "Math", "apigen-80k", " EN ")]
    df = spark.createDataFrame(rows, "id string, source string, source_dataset string, domain string, config string, language string")
    keep = {s: [r[0] for r in df.select(chat.keep_row(df, s)).collect()] for s in chat.EXCLUSION}
    assert keep["tulu-3"] == [False, True, True] and keep["dolci"] == [False, False, True] and keep["smoltalk"] == [True, True, False]
    assert keep["openhermes-25"] == [False, True, True] and keep["tulu-v2"] == [True] * 3
    calls = spark.createDataFrame([([("f()", None)],), ([(" ", "")],), (None,)], "messages array<struct<function_calls string, functions string>>")
    assert [r[0] for r in calls.select(chat.keep_row(calls, "dolci")).collect()] == [False, True, True]
    with pytest.raises(ValueError):
        chat.keep_row(df, "unknown")


def test_domains(spark):
    df = spark.createDataFrame([("personas-math-x", "code_alpaca and gpt4_alpaca", "Coding", "roleplay", "MetaMathQA-50k")], "source string, dataset string, domain string, category string, config string")
    got = {s: one(df.select(chat.map_domain(df, s))) for s in chat.EXCLUSION}
    assert got == {"tulu-v2": "code", "openhermes-25": "chat", "tulu-3": "math", "hermes-3": "general", "smoltalk": "math", "dolci": "code"}


def test_scan_finds_short_and_long_keys(spark):
    long = " ".join(f"a{i}" for i in range(20))
    items = spark.createDataFrame([(1, long), (2, "one two three four five six seven eight nine"), (3, "too short")], "item_id long, text string")
    docs = spark.createDataFrame([(10, f"x {long} y"), (11, "So: ONE two, three four five six seven eight nine!"), (12, "a0 a1 a2 a3 a4 a5 a6 a7 a8 a9 a10 a11"), (13, None)], "doc_id long, text string")
    hits = contamination.scan(docs, items)
    assert sorted((r.doc_id, r.pos, r.width, r.item_id) for r in hits.collect()) == [(10, p, 13, 1) for p in range(2, 10)] + [(11, 2, 9, 2)]
    assert {r.doc_id: r.matched_words for r in contamination.collapse(hits).collect()} == {10: 20, 11: 9}


def test_strip_shared_prefixes(spark):
    shared = [f"p{i}" for i in range(9)]
    items = [(i, shared + [f"q{i}", "z"]) for i in range(7)] + [(8, ["other"] * 12), (9, ["zz", "y"])]
    df = spark.createDataFrame([("l", i, w) for i, w in items], "label string, item_id long, w array<string>")
    got = {r.item_id: (r.stripped, r.stem) for r in contamination.strip_shared_prefix(df).collect()}
    assert got[3] == (9, "q3 z") and got[8][0] == 0 and got[9] == (0, "zz y")


def test_holdout_counts(spark):
    df = spark.createDataFrame([(10_000,), (1000,), (1,), (0,)], "n long")
    assert [r[0] for r in df.select(sampling.holdout_count(F.col("n"), 0.0015)).collect()] == [15, 2, 0, 0]
    for f in (0.0, 0.5):
        with pytest.raises(ValueError):
            sampling.holdout_count(F.col("n"), f)


def test_holdout_is_the_same_for_any_partitions(spark):
    df = spark.range(500).withColumn("s", F.col("id") % 3)
    a = sampling.holdout_split(df, 0.1, 1, "id", ["s"]).where("split = 'val'").collect()
    b = sampling.holdout_split(df.repartition(9), 0.1, 1, "id", ["s"]).where("split = 'val'").collect()
    assert sorted(a) == sorted(b) and len(a) == 51


def test_apportion(spark):
    df = spark.createDataFrame([(0, 0.5), (1, 0.3), (2, 0.2), (3, 0.0)], "ord int, w double")
    assert [r.n for r in sampling.apportion(df, "w", 5000, "ord").orderBy("ord").collect()] == [2500, 1500, 1000, 0]
    thirds = spark.createDataFrame([(i, 1.0) for i in range(7)], "ord int, w double")
    assert [r.n for r in sampling.apportion(thirds, "w", 10, "ord").orderBy("ord").collect()] == [2, 2, 2, 1, 1, 1, 1]


def test_plan_takes_each_once_or_raises(spark):
    items = spark.range(300).withColumn("domain", F.col("id") % 2)
    counts = spark.createDataFrame([(0, 100), (1, 7)], "domain long, n long")
    got = [r.id for r in sampling.plan_without_replacement(items, counts, 1, "domain", "id").collect()]
    assert len(set(got)) == len(got) == 107
    with pytest.raises(ValueError):
        sampling.plan_without_replacement(items, counts.withColumn("n", F.lit(151)), 1, "domain", "id")


def test_band_topup_skips_what_would_overshoot(spark):
    rows = [("d", "a", 10, 1.0, 0.0, 90.0, 110.0), ("d", "b", 50, 1.0, 0.0, 90.0, 110.0), ("d", "c", 60, 1.0, 0.0, 90.0, 110.0), ("d", "e", 45, 1.0, 0.0, 90.0, 110.0)]
    df = spark.createDataFrame(rows, "domain string, path string, size long, rate double, have double, floor double, ceiling double")
    assert sorted(r.path for r in sampling.band_topup(df).collect()) == ["a", "b", "e"]


def test_topups_see_no_domain_whole(spark):
    """One hot domain: rows equal the rule taken file by file, and no plan sends a domain to one Python task."""
    rows = [("hot" if i % 9 else "cold", i, i * 7919 % 101, 0.25, 3.0, 300.0, 340.0) for i in range(900)]
    df = spark.createDataFrame(rows, "domain string, path long, size long, rate double, have double, floor double, ceiling double")
    want = []
    for domain in ("hot", "cold"):
        have = 3.0
        for _, path, size, rate, _, low, high in sorted((r for r in rows if r[0] == domain), key=lambda r: (r[2], r[1])):
            if have < low and have + rate * size <= high:
                want.append((domain, path))
                have += rate * size
    got = sampling.band_topup(df)
    assert sorted((r.domain, r.path) for r in got.collect()) == sorted(want)
    trimmed = sampling.trim_topup(df.select("domain", "path", F.col("size").alias("tokens"), F.lit(400.0).alias("plan"), "have"))
    for plan in (got, trimmed):
        assert "Pandas" not in plan._jdf.queryExecution().toString()
    with pytest.raises(ValueError):
        sampling.band_topup(df.withColumn("rate", F.col("path").cast("double")))


@pytest.mark.parametrize("target", [20_000, 50_000, 10**7])
def test_trim_equals_the_sequential_rule(spark, target):
    df = spark.createDataFrame([(i, 100 if i % 7 else 3000) for i in range(200)], "id long, n long")
    have, want = 0, set()
    for r in df.orderBy(sampling.hash_order(1, F.col("id"))).collect():
        if have >= target:
            break
        if have >= int(target * 0.98) and have + r.n > int(target * 1.02):
            continue
        want.add(r.id)
        have += r.n
    assert {r.id for r in sampling.trim_to_budget(df, "n", target, sampling.hash_order(1, F.col("id"))).collect()} == want


def test_tail_carve_cuts_across_shards(spark):
    df = spark.createDataFrame([(0, 400), (1, 40), (2, 40)], "ord int, bytes long")
    assert [r.val_bytes for r in sampling.tail_carve(df, 0.2).orderBy("ord").collect()] == [16, 40, 40]
    cut = sampling.byte_shards(spark.createDataFrame([(0, 16)], "ord int, bytes long"), 8).collect()
    assert [(r.shard, r.start, r.end) for r in cut] == [(0, 0, 8), (1, 8, 16)]


@pytest.mark.parametrize("method, want", [("rho_excess", "TTFF"), ("middle_ppl", "FTTF"), ("full", "TTTT")])
def test_token_masks(spark, method, want):
    df = spark.createDataFrame([(1, i, 4.0 - i, 0.0 if method == "rho_excess" else float(i), 0.0, True) for i in range(4)], "instance_id long, pos int, current double, reference double, history double, valid boolean")
    got = selection.select_tokens(df, method, 0.5).orderBy("pos").collect()
    assert "".join("FT"[r.weight] for r in got) == want


def test_middle_band_of_ten(spark):
    df = spark.createDataFrame([(1, i, float(i), True) for i in range(10)], "instance_id long, pos int, x double, valid boolean")
    got = selection.middle_fraction(df, F.col("x"), 0.6).orderBy("pos").collect()
    assert "".join("FT"[r.weight] for r in got) == "FFTTTTTTFF"


def test_ema_with_bias_correction(spark):
    df = spark.createDataFrame([("k", i, float(i * i)) for i in range(6)], "k string, s int, v double")
    m, c = 0.0, 1.0
    for i in range(6):
        m, c = m * 0.7 + i * i * 0.3, c * 0.7
    assert selection.ema(df, "k", "s", "v", 0.3).first().ema == pytest.approx(m / (1 - c))


def test_profile_fit_recovers_a_power_law(spark):
    df = spark.createDataFrame([("r", s, 1.5 + 4 * s**-0.5) for s in range(1000, 6000, 500)], "run string, step int, loss double")
    f = curves.profile_fit(df, curves.alpha_grid(spark)).first()
    assert f.a == pytest.approx(1.5, abs=0.01) and f.alpha == pytest.approx(0.5, abs=0.01)
    draws = curves.bootstrap(df, 200, 8000.0).collect()
    assert len({r.draw for r in draws}) == 200 and np.allclose([r.final for r in draws], 1.5 + 4 * 8000**-0.5, atol=1e-3)


def test_p_values(spark):
    p = curves.p_values(spark.createDataFrame([(float(x),) for x in (1, 2, 3, -1)], "d double")).first()
    assert (p.p_two, p.p_one) == (0.5, 0.25)
    q = curves.p_values(spark.createDataFrame([(1.0,)] * 10, "d double")).first()
    assert (q.p_two, q.p_one, q.p_two_no_floor) == (0.1, 0.1, 0.0)


def test_law_fit_predicts(spark):
    laws = spark.createDataFrame([("f", 1.2, 0.8, [-1.5, 0.4, 0.6])], "family string, c double, k double, t array<double>")
    runs = mixture.simplex_candidates(spark, 24, 3, 5).crossJoin(laws).select(F.col("id").alias("run"), "family", F.col("w").alias("r"), mixture.law(F.col("c"), F.col("k"), F.col("t"), F.col("w")).alias("y"))
    assert mixture.fit_law(runs, 3).first().rmse < 1e-4
    best = mixture.optimise(laws, 3, 0.05, 0.8).orderBy("ord").collect()
    assert [r.weight for r in best] == pytest.approx([0.8, 0.15, 0.05], abs=1e-3) or best[0].weight == pytest.approx(0.8, abs=1e-3)


def test_weight_update_and_adjacency(spark):
    probes = spark.createDataFrame([("a", "f", 0.4), ("b", "f", 2.0), ("c", "g", 0.1)], "domain string, family string, loss double")
    ref = spark.createDataFrame([("f", 1.0), ("g", 1.0)], "family string, ref_loss double")
    a = {(r.domain, r.family): r.a for r in mixture.adjacency(probes, ref).collect()}
    assert a[("a", "f")] == pytest.approx(0.6) and a[("b", "f")] == 0 and a[("a", "g")] is None
    zero = spark.createDataFrame([("a", "f", 0.0), ("b", "f", 0.0)], "domain string, family string, a double")
    p = spark.createDataFrame([("a", 0.3), ("b", 0.7)], "domain string, p double")
    out = mixture.update_weights(p, zero, ref.withColumnRenamed("ref_loss", "loss"), 1.0).collect()
    assert {r.domain: r.p_after for r in out} == pytest.approx({"a": 0.3, "b": 0.7})


def test_simplex_gate(spark):
    good = spark.createDataFrame([("m", "a", 0.5005), ("m", "b", 0.5)], "mix_id string, domain string, weight double")
    assert sum(r.weight for r in mixture.check_simplex(good).collect()) == pytest.approx(1)
    with pytest.raises(ValueError):
        mixture.check_simplex(good.withColumn("weight", F.col("weight") * 1.1))


def test_gates(spark):
    with pytest.raises(ValueError):
        gates.require(gates.duplicate_keys(spark.createDataFrame([(1,), (1,)], "k int"), "k"), "repeated")
    spans = spark.createDataFrame([("s", 0, 5), ("s", 5, 9), ("s", 10, 12)], "src string, start int, end int")
    assert [(r.start, r.expected) for r in gates.tiling_gaps(spans, "src").collect()] == [(10, 9)]


def test_overlap_join_counts_each_pair_once(spark):
    a = spark.createDataFrame([("s", 1, 0, 100), ("s", 2, 100, 101)], "src string, a_id int, a_start long, a_end long")
    b = spark.createDataFrame([("s", 7, 50, 101), ("s", 8, 101, 200)], "src string, b_id int, b_start long, b_end long")
    assert sorted((r.a_id, r.b_id) for r in relational.interval_overlap(a, b, "src", 10).collect()) == [(1, 7), (2, 7)]


def test_readers_and_writers(spark, tmp_path):
    with gzip.open(tmp_path / "a.jsonl.gz", "wt") as f:
        f.write('{"id":"1","text":"x"}\n\nnot json\n{"id":"2","text":""}\n{"id":"3","text":"y"}\n')
    path = str(tmp_path / "a.jsonl.gz")
    assert [r.id for r in files.read_docs(spark, path, malformed="skip").collect()] == ["1", "3"]
    with pytest.raises(Exception):  # noqa: B017
        files.read_docs(spark, path).collect()
    assert [r.reason for r in files.read_rows_with_reason(spark, path).collect()] == [None, "blank", "badjson", "notext", None]
    (tmp_path / "arr.json").write_text(json.dumps([{"id": "a"}, {"id": "b"}]))
    assert files.read_json_array(spark, str(tmp_path / "arr.json"), "id string").count() == 2
    docs = spark.createDataFrame([("1", "x", "s", ("math",)), ("2", "y", "s", ("code",))], files.DOC).withColumn("domain", F.col("metadata.domain"))
    files.write_docs(docs, str(tmp_path / "out"), ["source", "domain"])
    assert files.list_files(spark, str(tmp_path / "out"), r"\.json\.gz$").count() == 2
    np.array([11, 22, 33, files.EOS], "<u4").tofile(tmp_path / "t.npy")
    assert files.read_tokens(spark, str(tmp_path / "t.npy")).first().tokens == [11, 22, 33, files.EOS]
    packed = files.write_tokens(spark.createDataFrame([(0, [11, 22, 33])], "ord long, tokens array<int>"), str(tmp_path / "packed"))
    row = packed.first()
    import zlib

    assert row.bytes == 16 and row.crc32 == zlib.crc32(np.array([11, 22, 33, files.EOS], "<u4").tobytes())


def test_trainer_log(spark, tmp_path):
    (tmp_path / "log.txt").write_text("step=5 loss=2.5\nnoise\narc/easy=0.9\nstep=6 loss=2.25\n")
    got = [(r.step, r.name, r.value) for r in files.read_trainer_log(spark, str(tmp_path / "log.txt")).collect()]
    assert got == [(5, "loss", 2.5), (5, "arc/easy", 0.9), (6, "loss", 2.25)]


def test_polling_logs_each_step_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    full = json.dumps({"step": 1, "values": {"a": 1.0, "b": 2.0}})
    (tmp_path / "in" / "1.json").write_text(full)
    (tmp_path / "in" / "2.json").write_text(json.dumps({"step": 2, "values": {"a": 1.0}}))
    args = (spark, str(tmp_path / "in"), "step long, values map<string,double>", ["a", "b"], str(tmp_path / "out"), str(tmp_path / "ck"))
    logs.poll_results(*args).awaitTermination()
    (tmp_path / "in" / "3.json").write_text(full)
    (tmp_path / "in" / "4.json").write_text(json.dumps({"step": 2, "values": {"a": 1.0, "b": 3.0}}))
    logs.poll_results(*args).awaitTermination()
    assert sorted(r.step for r in logs.read_steps(spark, str(tmp_path / "out"), "step long, values map<string,double>").collect()) == [1, 2]


def test_two_writers_add_a_step_once(spark, tmp_path):
    """The second writer commits while the first has looked but not committed: the first looks again."""
    from sparkloom.sources import writers

    path, kept = str(tmp_path / "log"), writers.create_json
    rows = lambda *steps: spark.createDataFrame([(s, s * 10) for s in steps], "step int, v int")
    calls = []

    def between(*args):
        calls.append(1)
        if len(calls) == 1:
            logs.append_new_steps(spark, rows(2, 3), path, ["step"])
        return kept(*args)

    writers.create_json = between
    try:
        logs.append_new_steps(spark, rows(1, 2), path, ["step"])
    finally:
        writers.create_json = kept
    assert len(calls) == 3 and sorted(map(tuple, logs.read_steps(spark, path, "step int, v int").collect())) == [(1, 10), (2, 20), (3, 30)]
    logs.append_new_steps(spark, rows(1, 2, 3), path, ["step"])
    assert logs.read_steps(spark, path, "step int, v int").count() == 3


def test_shared_prefix_sees_no_source_whole(spark, tmp_path):
    rows = [(i, "s", f"{'a b c' if i % 3 else 'a b'} {'x' * (i % 5)} d") for i in range(100)] + [(100, "s", None), (101, "s", "a"), (7, "r", "a b")]
    spark.createDataFrame(rows, "doc_id long, source string, text string").write.parquet(str(tmp_path / "documents.parquet"))
    df = corpus.QUERIES["fn07_shared_word_prefix"](spark, str(tmp_path))
    split = {i: (text or "").split() for i, s, text in rows if s == "s"}
    common = lambda a, b: next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    assert sorted((r.doc_id, r.shared) for r in df.collect()) == [(i, common(split[i], split[i + 1])) for i in range(101)]
    plan = df._jdf.queryExecution().toString()
    assert "lead(" not in plan or "_part" in plan  # windows are within ranges
