import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.llm import fingerprint as fp
from sparkloom.llm.queries import op5_order_minhash


def plain(text):
    """Occurrence-numbered k-mers dealt to bins, the two smallest of each in text order."""
    h = fp.kmer_hashes(text).tolist()
    low = (1 << fp.POSITION_BITS) - 1
    seen, bins = {}, {}
    for pos, x in enumerate(h):
        x &= ~low & (2**64 - 1)
        n = seen[x] = seen.get(x, -1) + 1
        order = int(fp._mixed(np.array([(x + n * int(fp._A)) % 2**64], np.uint64))[0])
        bins.setdefault(order >> 58, []).append((order, pos, x))
    out = [-1] * fp.BINS
    for b, found in bins.items():
        best = sorted(sorted(found)[: fp.TUPLE], key=lambda f: f[1])
        tail = int(fp._mixed(np.array([(best[1][2] + int(fp._C)) % 2**64], np.uint64))[0]) if len(best) > 1 else 0
        out[b] = int(fp._mixed(np.array([(best[0][2] * int(fp._A) + tail) % 2**64], np.uint64))[0]) >> 48
    return out


@pytest.mark.parametrize("n", [0, 1, 7, 8, 9, 60, 3000, 9000])
def test_sketch_equals_plain(n):
    rng = random.Random(n)
    text = "".join(rng.choice("ab cdé🎉") for _ in range(n))
    assert fp.sketch(text).tolist() == plain(text)
    assert fp.sketch("ab" * n).tolist() == plain("ab" * n)


def test_longest_texts_are_sorted_otherwise_and_give_the_same(monkeypatch):
    texts = [" ".join(f"w{i * i % 101}" for i in range(n)) for n in (3, 40, 900)] + ["ab" * 500, "x"]
    want = [fp.sketch(t).tolist() for t in texts]
    assert [plain(t) for t in texts] == want
    monkeypatch.setattr(fp, "LONGEST", 5)
    assert [fp.sketch(t).tolist() for t in texts] == want


@pytest.mark.parametrize("hot", [None, 10, 0, 25])
def test_rows_of_one_id_or_none_spread_and_keep_their_order(spark, hot):
    rows = [(hot, f"text number {i * 7919 % 1000} of many") for i in range(300)] + [(i, f"other {i}") for i in range(20)] + [(hot, None)] * 3 + [(None, "x")] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string")
    ordered = [r.text or "" for r in df.orderBy(F.col("doc_id").desc_nulls_last(), F.xxhash64(F.coalesce("text", F.lit("")))).collect()]
    want = sorted((t, round(fp.likeness(fp.sketch(t), fp.sketch(n)), 9)) for t, n in zip(ordered, ordered[1:] + ordered[:1]))
    hashes = {t: fp.written(fp.sketch(t)) for t in ordered}
    got = fp.edited_pairs(df)
    assert sorted((r.fingerprint, round(r.near_next, 9)) for r in got.collect()) == sorted((hashes[t], x) for t, x in want)
    assert got.groupBy(F.spark_partition_id()).count().count() > 2


def test_likeness_falls_with_edits_and_sees_order():
    rng = random.Random(4)
    words = [f"{rng.getrandbits(40):x}" for _ in range(600)]
    base = " ".join(words)
    one = " ".join(words[:300] + ["changed"] + words[301:])
    turned = " ".join(words[300:] + words[:300])
    other = " ".join(f"{rng.getrandbits(40):x}" for _ in range(600))
    s = fp.sketch(base)
    near, moved, far = (fp.likeness(s, fp.sketch(t)) for t in (one, turned, other))
    assert near > 0.85 and near > moved + 0.2 and moved > far + 0.2 and far < 0.1
    assert fp.likeness(s, fp.sketch(base)) == 1.0


def test_query_equals_brute_force(spark, sf_dir):
    docs = sorted(((r.doc_id, r.text or "") for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()), reverse=True)
    got = {r.doc_id: r for r in op5_order_minhash(spark, sf_dir).collect()}
    assert len(got) == len(docs)
    for (d, t), (_, nxt) in zip(docs, docs[1:] + docs[:1]):
        half = len(t) // 2
        edited = t[: len(t) - half] + nxt[:half]
        r = got[d]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        a, b, c = fp.sketch(t), fp.sketch(edited), fp.sketch(nxt)
        assert (r.fingerprint, r.edited_fingerprint, r.near_edited, r.near_next) == (fp.written(a), fp.written(b), fp.likeness(a, b), fp.likeness(a, c))


def test_odd_rows(spark, odd_docs, no_docs):
    rows = fp.edited_pairs(odd_docs).collect()
    assert len(rows) == 10 and sorted(r.doc_id or 0 for r in rows) == [0, 0, 1, 1, 2, 3, 4, 5, 6, 7]
    assert {r.n_chars for r in rows if r.doc_id in (3, 4)} == {0}
    assert len({r.fingerprint for r in rows if r.doc_id in (1, 2)}) == 1
    assert fp.edited_pairs(no_docs).collect() == []
    one = fp.edited_pairs(odd_docs.where("doc_id = 7")).collect()
    assert len(one) == 1 and one[0].near_next == 1.0
    assert len(fp.fingerprints(odd_docs).collect()) == 10
