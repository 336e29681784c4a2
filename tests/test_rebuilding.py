"""Coverage, listings, rebuilds, writers and loader state on small fixtures: results, and what must raise."""

import gzip
import hashlib
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.functions import chat, text
from sparkloom.operators import contamination, coverage, curves, gates, mixture, rebuild, sampling, selection
from sparkloom.plans.analytics import LAW
from sparkloom.sources import files, listings, writers
from sparkloom.staging import scratch
from sparkloom.streaming import logs, state


def test_labels_and_assessable_fields(spark):
    df = spark.createDataFrame([("mmlu_law_rc_5shot_bpb",), ("arc_easy_rc_5shot_bpb",), ("boolq_rc_5shot_bpb",)], "l string")
    assert [r[0] for r in df.select(coverage.benchmark_of(F.col("l"))).collect()] == ["mmlu", "arc", "boolq"]
    assert [r[0] for r in df.select(coverage.longest_prefix(F.col("l"), ["arc", "arc_easy", "m"])).collect()] == ["m", "arc_easy", None]
    items = spark.createDataFrame([(1, "arc_easy_rc_5shot_bpb", 7, 8), (2, "arc_easy_rc_5shot_bpb", 15, 13), (3, "arc_easy_rc_5shot_bpb", 12, None)], "item_id long, label string, stem_words long, gold_words long")
    r = coverage.label_statistics(items).first()
    assert (r.n_items, r.stem_not_assessable, r.gold_not_assessable, r.stem_keys, r.gold_keys, r.items_with_lt3_keys) == (3, 1, 1, 4, 2, 2)
    flags = coverage.item_flags(items)
    domains = spark.createDataFrame([("a",), ("b",)], "domain string")
    hits = spark.createDataFrame([("a", 2, "stem"), ("a", 2, "stem"), ("a", 3, "stem"), ("a", 1, "gold")], "domain string, item_id long, field string")
    got = {(r.domain, r.field): (r.found, r.assessable) for r in coverage.found_by_benchmark(hits, flags, domains).collect()}
    assert got == {("a", "stem"): (2, 2), ("a", "gold"): (1, 2), ("b", "stem"): (0, 2), ("b", "gold"): (0, 2)}
    with pytest.raises(ValueError):
        coverage.item_flags(items.union(items))
    with pytest.raises(ValueError):
        coverage.require_text(spark.createDataFrame([(1, None)], "item_id long, stem string"), "item_id", "stem")


def test_sentinels_refuse_what_is_not_finished(spark):
    schema = "domain string, shard int, docs_scanned long, words_scanned long, hit_rows long, spikes_injected long, spikes_recovered long, canary_ok boolean"
    good = [("a", 0, 1, 10, 1, 8, 8, True), ("a", 1, 2, 20, 0, 8, 8, True)]
    domains = spark.createDataFrame([("a",)], "domain string")
    r = coverage.merged_sentinels(spark.createDataFrame(good, schema), domains).first()
    assert (r.n_shards, r.docs_scanned, r.words_scanned, r.spikes_recovered) == (2, 3, 30, 16)
    for bad in (("a", 2, 1, 1, 0, 8, 7, True), ("a", 2, 1, 1, 0, 8, 8, False), ("a", 2, 1, 1, 0, 8, 8, None)):
        with pytest.raises(ValueError):
            coverage.merged_sentinels(spark.createDataFrame([*good, bad], schema), domains)
    with pytest.raises(ValueError):
        coverage.merged_sentinels(spark.createDataFrame(good, schema), spark.createDataFrame([("a",), ("b",)], "domain string"))


def test_normaliser_fingerprint(spark, monkeypatch):
    coverage.require_normaliser(spark)
    monkeypatch.setattr(coverage, "FINGERPRINT", "other")
    with pytest.raises(ValueError):
        coverage.require_normaliser(spark)


def test_spread_needs_two_rates(spark):
    rates = lambda *x: spark.createDataFrame([(v,) for v in x], "r double")
    assert coverage.spread(rates(0.0, 0.2, 0.5), "r").first().spread == pytest.approx(2.5)
    assert coverage.spread(rates(0.0, 0.2), "r").count() == 0


def test_rolling_hashes_equal_plain_ones(spark):
    words = [f"w{i % 7}" for i in range(20)]
    df = spark.createDataFrame([(" ".join(words),), ("too short",), (None,)], "s string")
    got = [r[0] for r in df.select(text.rolling_hashes(F.col("s"), F.lit(5), F.lit(31))).collect()]
    of = lambda w: int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little") % text.MERSENNE
    want = []
    for i in range(16):
        h = 0
        for w in words[i : i + 5]:
            h = (h * 31 + of(w)) % text.MERSENNE
        want.append(h)
    assert got == [want, [], []]


def test_preambles(spark):
    shared = [f"p{i}" for i in range(8)]
    rows = [("a", i, shared + [f"x{i}"]) for i in range(3)] + [("b", 0, shared)] + [("c", i, shared[:7] + [str(i)]) for i in range(2)] + [("d", i, shared) for i in range(2)]
    got = {(r.label, r.item_id): (r.stripped, r.w) for r in contamination.strip_preamble(spark.createDataFrame(rows, "label string, item_id int, w array<string>")).collect()}
    assert got[("a", 1)] == (8, ["x1"]) and got[("b", 0)][0] == 0 and got[("c", 1)][0] == 0 and got[("d", 0)] == (0, shared)


def test_contents(spark):
    raw = ["plain", '[{"type":"text","text":"a"},{"type":"image"},"b"]', '{"content":"c"}', '{"x":1}', "[not json", "", None, '{"text": "t", "content": "u"}']
    df = spark.createDataFrame([(x,) for x in raw], "c string")
    assert [r[0] for r in df.select(chat.content_text(F.col("c"))).collect()] == ["plain", "a\nb", "c", "", "[not json", "", "", "t"]


def test_listings(spark, tmp_path):
    rows = [("data/a/1.jsonl.zst", 5), ("data/a/2.JSON.GZ", 6), ("data/b/3.jsonl", 7), ("data/c/4.jsonl", 8), ("data/a/README.md", 9), ("x", 1)]
    df = spark.createDataFrame(rows, "path string, size long")
    assert sorted((r.path, r.domain) for r in listings.shard_table(df, ["a", "b"]).collect()) == [("data/a/1.jsonl.zst", "a"), ("data/a/2.JSON.GZ", "a"), ("data/b/3.jsonl", "b")]
    (tmp_path / "m.jsonl").write_text('{"path":"v1/data/a/1.jsonl","size":3}\n{"path":"v2/data/a/2.jsonl","size":4}\n')
    assert [tuple(r) for r in listings.shards_of_manifest(spark, str(tmp_path / "m.jsonl"), "v1/", ["a"]).collect()] == [("data/a/1.jsonl", 3, "a")]
    with pytest.raises(ValueError):
        listings.refreshed(df, df.where("size > 5"))
    with pytest.raises(ValueError):
        listings.token_report(spark.createDataFrame([("a", 6, None, None)], "d string, bytes long, stream_tokens long, meta_tokens long"), ["d"])
    report = spark.createDataFrame([("a", 8, 0, 5), ("a", 4, None, None), ("b", 8, None, None)], "d string, bytes long, stream_tokens long, meta_tokens long")
    assert sorted(map(tuple, listings.token_report(report, ["d"]).collect())) == [("a", 2, 12, 5), ("b", 1, 8, 2)]
    with pytest.raises(ValueError):
        listings.merged_lines(spark.createDataFrame([("s", "{}"), ("s", "{")], "shard string, value string"), "shard")


def test_tokenising(spark):
    df = spark.createDataFrame([(1, "a b <|endoftext|> a"), (2, None), (3, "  ")], "id int, text string")
    own = {r.id: r.tokens for r in rebuild.tokenise(df).collect()}
    assert own[1][2] == files.EOS and own[1][0] == own[1][3] != own[1][1] and own[1][-1] == files.EOS and own[2] == own[3] == [files.EOS]
    assert [r[0] for r in rebuild.tokenise(df).orderBy("id").select(rebuild.eos_in_text(F.col("tokens"))).collect()] == [1, 0, 0]
    lengths = lambda texts: [[len(w) for w in t.split()] for t in texts]
    assert {r.id: r.tokens for r in rebuild.tokenise(df, lengths).collect()}[1] == [1, 1, 13, 1, files.EOS]
    assert {r.id: r.n_tokens for r in rebuild.token_counts(df, lengths).collect()} == {1: 4, 2: 0, 3: 0}


def test_lookups_and_names_raise_for_what_is_not_there(spark):
    source = spark.createDataFrame([(i, f"t{i}") for i in range(5)], "row long, text string")
    wanted = spark.createDataFrame([(3, 0), (1, 1), (3, 2)], "row long, ord long")
    assert [r.text for r in rebuild.lookup_in_order(source, wanted).collect()] == ["t3", "t1", "t3"]
    with pytest.raises(ValueError):
        rebuild.lookup_in_order(source, spark.createDataFrame([(9, 0)], "row long, ord long"))
    objects = spark.createDataFrame([("s", "s/0", 0, 10), ("s", "s/1", 10, 14)], "source string, obj string, start long, end long")
    found = spark.createDataFrame([("s", 1, "f1", 0, 6), ("s", 2, "f2", 6, 12), ("s", 3, "f3", 12, 14), ("u", 4, "f4", 0, 3)], "source string, src long, path string, start long, end long")
    names = lambda *x: spark.createDataFrame([(n,) for n in x], "name string")
    assert sorted(r.src for r in rebuild.resolve_names(names("s/0"), objects, found, 4).collect()) == [1, 2]
    assert sorted(r.src for r in rebuild.resolve_names(names("tokens/s", "src:4"), objects, found, 4).collect()) == [1, 2, 3, 4]
    assert sorted(r.src for r in rebuild.resolve_names(names("f3", "/s/1/"), objects, found, 4).collect()) == [2, 3]
    with pytest.raises(ValueError):
        rebuild.resolve_names(names("f3", "nothing"), objects, found, 4)


def test_digests_of_token_streams(spark):
    rows = [("a", i, [i, i + 1, files.EOS]) for i in range(50)] + [("b", 0, [7])]
    raw = rebuild.token_bytes(spark.createDataFrame(rows, "src string, ord long, tokens array<long>").repartition(5))
    got = {r.src: (r.n, r.bytes, r.sha256) for r in rebuild.ordered_digests(raw, ["src"], ["ord"], "raw").collect()}
    whole = np.concatenate([np.array(t, "<u4") for s, _, t in rows if s == "a"]).tobytes()
    assert got == {"a": (50, len(whole), hashlib.sha256(whole).hexdigest()), "b": (1, 4, hashlib.sha256(np.array([7], "<u4").tobytes()).hexdigest())}
    digests = rebuild.ordered_digests(raw, ["src"], ["ord"], "raw")
    expected = spark.createDataFrame([("a", got["a"][2]), ("b", "x"), ("c", "y")], "src string, sha256 string")
    assert sorted(map(tuple, rebuild.digest_mismatches(digests, expected, ["src"]).collect())) == [("b", "differs"), ("c", "missing")]


def test_json_is_replaced_whole(spark):
    path = scratch(spark, "json") + "/x.json"
    assert writers.read_json(spark, path) is None
    for what in ({"a": 1}, {"b": "é"}):
        writers.write_json(spark, path, what)
        assert writers.read_json(spark, path) == what


def test_marked_results_and_progress(spark):
    path, df = scratch(spark, "marked"), spark.range(5)
    with pytest.raises(FileNotFoundError):
        writers.read_marked(spark, path, df.schema)
    assert writers.write_with_mark(df, path, {"n": F.count("*")}) == {"n": 5}
    assert writers.read_marked(spark, path, df.schema).count() == 5
    table, chunks = scratch(spark, "table"), spark.range(4).select(F.col("id").alias("chunk"))
    assert writers.unfinished_chunks(spark, table, chunks, {"rows": "9"}).count() == 4
    writers.finish_chunks(chunks.where("chunk < 3").withColumn("sha256", F.lit("x")), table)
    assert [r.chunk for r in writers.unfinished_chunks(spark, table, chunks, {"rows": "9"}).collect()] == [3]
    with pytest.raises(ValueError):
        writers.unfinished_chunks(spark, table, chunks, {"rows": "10"})


def test_checkpoints(spark):
    rows = [("r", 10, None, "a", True), ("r", 20, "pre", "b", True), ("r", 20, "post", "c", True), ("r", 30, None, "d", False), ("r", 10, "post", "e", True), ("r", 20, None, "f", True), ("r", 5, None, "g", True)]
    c = spark.createDataFrame(rows, "run string, step long, phase string, path string, whole boolean")
    assert writers.latest_checkpoint(c, "run").first().path == "f"
    assert writers.latest_checkpoint(c.where("path <> 'f'"), "run").first().path == "c"
    old = lambda s: sorted(r.path for r in writers.superseded(c, spark.createDataFrame([("r", s)], "run string, durable_step long"), "run").collect())
    assert old(20) == ["a", "b", "c", "e", "g"] and old(10) == ["e", "g"]
    with pytest.raises(ValueError):
        old(30)
    with pytest.raises(ValueError):
        writers.staged(spark.createDataFrame([("x/1",), ("y/1",)], "path string"), "root", name=F.regexp_extract("path", "[^/]*$", 0))


def test_a_stream_goes_on_where_it_stopped(spark):
    rows = spark.range(10)
    at, seen = state.Position(), []
    for _ in range(4):
        got, at = state.next_batches(rows, "id", 4, 7, at, 2)
        seen += [(r.epoch, r.batch, r.id) for r in got.collect()]
    assert at == state.Position(3, 2)
    assert sorted(i for e, _, i in seen if e == 1) == sorted(i for e, _, i in seen if e == 2) == list(range(10))
    whole, last = state.next_batches(rows.repartition(3), "id", 4, 7, state.Position(), 8)
    assert sorted((r.epoch, r.batch, r.id) for r in whole.collect()) == sorted(seen) and last == at
    with pytest.raises(ValueError):
        state.next_batches(rows, "id", 4, 7, state.Position(version=2), 1)


def test_weights_and_templates(spark):
    domains = spark.createDataFrame([("b", 0), ("a", 1)], "domain string, ord int")
    w = lambda *x: spark.createDataFrame(list(zip("ab", x)), "domain string, weight double")
    assert [(r.domain, r.weight) for r in state.normalised_weights(w(1.0, 3.0), domains).orderBy("ord").collect()] == [("b", 0.75), ("a", 0.25)]
    for bad in ((1.0, -1.0), (0.0, 0.0), (1.0, float("nan")), (1.0, float("inf")), (1.0,)):
        with pytest.raises(ValueError):
            state.normalised_weights(w(*bad), domains)
    assert spark.range(1).select(state.fill_template("a/${X}/${X}.y", {"X": F.lit(5)})).first()[0] == "a/5/5.y"
    with pytest.raises(KeyError):
        state.fill_template("${X}", {})


def test_topup_is_trimmed_into_its_band(spark):
    # the band of 100 is 90.9 to 111.1: 60, 70, 90; 112 would be past it, 111 isn't
    rows = [("d", "a", 10), ("d", "b", 20), ("d", "c", 22), ("d", "e", 90), ("f", "a", 10), ("f", "b", 20), ("f", "c", 21), ("f", "e", 90)]
    df = spark.createDataFrame([(*r, 100.0, 60.0) for r in rows], "domain string, path string, tokens long, plan double, have double")
    assert sorted((r.domain, r.path) for r in sampling.trim_topup(df).collect()) == [("d", "a"), ("d", "b"), ("f", "a"), ("f", "b"), ("f", "c")]


def test_arms_and_counts(spark):
    draws = spark.createDataFrame([("x", i, float(i)) for i in range(4)] + [("y", i, 1.0) for i in range(3)], "arm string, draw int, value double")
    assert sorted(r.d for r in curves.paired_differences(draws, "x", "y").collect()) == [-1.0, 0.0, 1.0]
    m = curves.subset_means(spark.createDataFrame([(1, "a", 1.0), (1, "b", 3.0), (2, "a", 5.0)], "s int, l string, v double"), "s", "l", "v", {"ab": ["a", "b"], "only_a": ["a"]})
    assert {r.s: (r.ab, r.only_a) for r in m.collect()} == {1: (2.0, 1.0), 2: (None, 5.0)}
    cells = spark.createDataFrame([("r", "x", 1.0), ("r", "y", 2.0), ("q", "x", 3.0)], "r string, c string, v double")
    assert curves.complete_cells(cells, "r", "c", "v", ["r"], ["x", "y"]).first().asDict() == {"r": "r", "x": 1.0, "y": 2.0}
    for names in (["r", "q"], ["r", "none"]):
        with pytest.raises(ValueError):
            curves.complete_cells(cells, "r", "c", "v", names, ["x", "y"])
    scored = spark.createDataFrame([(0, p, p < 6, int(p < 3)) for p in range(8)], "instance_id long, pos int, valid boolean, weight int")
    assert [(r.bin, r.valid, r.kept, r.within) for r in selection.keep_rate_bins(scored, 4, 0.5, 1.0).orderBy("bin").collect()] == [(0, 4, 3, True), (1, 2, 0, False)]
    with pytest.raises(ValueError):
        selection.gather(scored, spark.createDataFrame([(9,)], "instance_id long"))


def test_sets(spark):
    a, b = spark.createDataFrame([(1, 5), (2, 6)], "k int, v int"), spark.createDataFrame([(2, 6), (3, 7)], "k int, v int")
    assert sorted(map(tuple, gates.merged_values(a, b, ["k"], "v").collect())) == [(1, 5), (2, 6), (3, 7)]
    with pytest.raises(ValueError):
        gates.merged_values(a, b.withColumn("v", F.lit(0)), ["k"], "v")
    assert sorted(map(tuple, gates.set_differences(a, b, "k").collect())) == [(1, "unexpected"), (3, "missing")]


def test_search_finds_the_optimum(spark):
    laws = spark.createDataFrame(LAW, "family string, c double, k double, t array<double>")
    best = mixture.optimise_global(laws, 3, 0.05, 0.8, candidates=3000, polished=6, refined=4).first()
    known = mixture.optimise(laws, 3, 0.05, 0.8).first()
    assert best.loss == pytest.approx(known.loss, abs=1e-6) and sum(best.w) == pytest.approx(1)


def test_mixtures_from_a_file(spark, tmp_path):
    (tmp_path / "good.json").write_text(json.dumps({"m": {"a": 0.5005, "b": 0.5}}))
    assert sum(r.weight for r in mixture.registered(mixture.load_mixtures(spark, str(tmp_path / "good.json")), "m").collect()) == pytest.approx(1)
    (tmp_path / "twice.json").write_text('{"m": {"a": 0.5, "a": 0.5}}')
    (tmp_path / "off.json").write_text('{"m": {"a": 0.5, "b": 0.6}}')
    for name in ("twice", "off"):
        with pytest.raises(ValueError):
            mixture.load_mixtures(spark, str(tmp_path / f"{name}.json"))
    with pytest.raises(KeyError):
        mixture.registered(mixture.load_mixtures(spark, str(tmp_path / "good.json")), "other")


def test_a_cut_file_fails_the_job(spark, tmp_path):
    raw = gzip.compress(b"".join(b'{"id":"%d","text":"x %d"}\n' % (i, i) for i in range(5000)))
    (tmp_path / "cut.jsonl.gz").write_bytes(raw[: len(raw) // 2])
    with pytest.raises(Exception):  # noqa: B017
        files.read_docs(spark, str(tmp_path / "cut.jsonl.gz")).count()


def test_the_first_file_of_a_step_wins(spark, tmp_path):
    import os

    (tmp_path / "in").mkdir()
    for i, (name, v) in enumerate((("b", 1.0), ("a", 2.0), ("c", 3.0))):
        (tmp_path / "in" / f"{name}.json").write_text(json.dumps({"step": 1, "values": {"x": v}}))
        os.utime(tmp_path / "in" / f"{name}.json", (1_700_000_000 + 10 * i,) * 2)
    logs.poll_results(spark, str(tmp_path / "in"), "step long, values map<string,double>", ["x"], str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    assert [r["values"]["x"] for r in logs.read_steps(spark, str(tmp_path / "out"), "step long, values map<string,double>").collect()] == [1.0]


def test_a_run_of_one_step_has_no_fit(spark):
    rows = [("one", 5, 1.0), *[("r", s, 1.5 + 4 * s**-0.5) for s in range(1000, 6000, 500)]]
    fits = {r.run: r for r in curves.profile_fit(spark.createDataFrame(rows, "run string, step int, loss double"), curves.alpha_grid(spark)).collect()}
    assert fits["one"].alpha is None and fits["r"].alpha == pytest.approx(0.5, abs=0.01)
