"""The contamination queries on texts that NFKC changes, which their SQL can't express, against brute force."""

import hashlib
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from sparkloom.operators import contamination
from sparkloom.operators.running import running_totals
from sparkloom.plans.corpus import QUERIES

PLAIN = "the first office of five final effects was café number 2 for all eleven clients there"
FORMS = {
    "ligatures": PLAIN.replace("ffi", "\ufb03").replace("fi", "\ufb01").replace("ff", "\ufb00"),
    "full width": "".join(chr(ord(c) + 0xFEE0) if "a" <= c <= "z" else c for c in PLAIN),
    "superscript": PLAIN.replace("2", "²"),
    "decomposed": unicodedata.normalize("NFD", PLAIN),
    "plain": PLAIN,
}
ITEMS = [(1, PLAIN), (2, "ｓｅｖｅｎ short words and one ﬁne word more"), (3, "too short")]
DOCS = [(i, f"before {t}, after", s) for i, (t, s) in enumerate(zip(FORMS.values(), "aabbc"))] + [(8, "Seven short words and one fine word more!", "c"), (9, None, "c")]


def norm(t):
    return re.sub(r"\s+", " ", re.sub(r"[^\w\s]", " ", unicodedata.normalize("NFKC", t or "").lower())).strip().split()


def keys(w):
    return set() if len(w) < 8 else {tuple(w)} if len(w) < 13 else {tuple(w[i : i + 13]) for i in range(len(w) - 12)}


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("forms"))
    spark.createDataFrame(DOCS, "doc_id long, text string, source string").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(ITEMS, "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d


def test_queries_equal_brute_force(spark, folder):
    ask = lambda name: QUERIES[name](spark, folder).collect()
    words = {d: norm(t) for d, t, _ in DOCS}
    hits = {(d, p + 1, len(k), i) for d, w in words.items() for i, t in ITEMS for k in keys(norm(t)) for p in range(len(w)) if tuple(w[p : p + len(k)]) == k}
    assert {h[0] for h in hits} == {0, 1, 2, 3, 4, 8}
    assert {(r.doc_id, r.pos, r.width, r.item_id) for r in ask("jn06_contam_hits")} == hits
    covered = {d: {p + j for e, p, n, _ in hits if e == d for j in range(n)} for d in words}
    assert {r.doc_id: r.matched_words for r in ask("ag12_contam_doc_hits")} == {d: len(c) for d, c in covered.items() if c}
    of = {s: [d for d, _, x in DOCS if x == s] for s in "abc"}
    rates = {s: sum(bool(covered[d]) for d in ds) / len(ds) for s, ds in of.items()}
    for r in ask("contam_rate_by_source"):
        ds = of[r.source]
        assert (r.words_scanned, r.matched_span_words) == (sum(len(words[d]) for d in ds), sum(len(covered[d]) for d in ds))
        assert r.matched_document_rate == pytest.approx(rates[r.source])
    assert {r.source: (r.items_hit, r.docs_hit) for r in ask("ag09_contam_totals")} == {"a": (1, 2), "b": (1, 2), "c": (2, 2), None: (2, 6)}
    assert {r.mix_id: r.exposure for r in ask("jn08_exposure_by_mixture")}["even"] == pytest.approx(sum(rates.values()) / 3)
    stats = ask("ag06_item_index_stats")[0]
    assert (stats["items"], stats.not_assessable, stats.short, stats.exact_keys) == (3, 1, 1, sum(len(keys(norm(t))) for _, t in ITEMS))
    assert {r.item_id: r.stem_sha256 for r in ask("fn09_item_identity")} == {i: hashlib.sha256(" ".join(norm(t)).encode()).hexdigest() for i, t in ITEMS}


@pytest.mark.parametrize("rows, prefixes", [(0, 1 << 20), (0, 0)])
def test_a_large_index_gives_the_same(spark, sf_dir, monkeypatch, rows, prefixes):
    """The index joined by shuffle behind its prefixes, sent or not; chunks of a few positions."""
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    hits = sorted(contamination.scan(docs, items).collect())
    rates = sorted(contamination.rates_by_source(docs, items).collect())
    assert hits and sum(r.matched_documents for r in rates) == len({h.doc_id for h in hits})
    monkeypatch.setattr(contamination, "BROADCAST_ROWS", rows)
    monkeypatch.setattr(contamination, "BROADCAST_PREFIXES", prefixes)
    monkeypatch.setattr(contamination, "CHUNK", 7)
    assert sorted(contamination.scan(docs, items).collect()) == hits
    assert sorted(contamination.rates_by_source(docs, items).collect()) == rates


def test_running_totals_equal_plain_ones(spark):
    rows = [(i % 3 if i % 7 else None, (i * 37) % 101, i) for i in range(400)]
    df = spark.createDataFrame(rows, "g int, o int, v long").repartition(7)
    want, sums = [], {}
    for g, o, v in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2])):
        sums[g] = sums.get(g, 0) + v
        want.append((g, o, v, sums[g]))
    got = running_totals(df, {"cum": F.col("v")}, ["o", "v"], ["g"]).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    whole = running_totals(df, {"cum": F.col("v"), "n": F.lit(1)}, ["v"]).collect()
    assert [(r.cum, r.n) for r in sorted(whole, key=lambda r: r.v)] == [(i * (i + 1) // 2, i + 1) for i in range(400)]
    assert running_totals(df.limit(0), {"cum": F.col("v")}, ["v"]).collect() == []
