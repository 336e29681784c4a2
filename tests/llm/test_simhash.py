import random

import numpy as np
import pytest
import xxhash

from sparkloom.llm import simhash
from sparkloom.llm.queries import op10_simhash


def plain(text):
    words = "".join(c.lower() if c.isascii() else c for c in text or "").replace("\x0b", " ").split(" ")
    words = [w for part in words for w in part.replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\x0c", " ").split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute(fps):
    """Smallest member by union of all pairs at three bits or less."""
    u = np.array(sorted(set(fps)), np.int64)
    root = {int(x): int(x) for x in u}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, x in enumerate(u):
        near = np.bitwise_count((u[i + 1 :] ^ x).view(np.uint64)) <= 3
        for y in u[i + 1 :][near]:
            a, b = find(int(x)), find(int(y))
            root[max(a, b)] = min(a, b)
    return {x: find(x) for x in root}


def test_fingerprint_is_the_contract():
    for t in (None, "", " \t", "One", "one TWO", "a b c", "A b\x0bc d É é É", "x " * 500, "the cat sat on the mat " * 40 + "end"):
        assert simhash.simhash(t) & (2**64 - 1) == plain(t)


@pytest.mark.parametrize("listed", [1024, 5])
def test_links_lose_nothing(spark, monkeypatch, listed):
    """Random fingerprints, chains, and dense groups of hundreds within a few bits."""
    monkeypatch.setattr(simhash, "LISTED", listed)
    rng = random.Random(3)
    fps = {0, 1, -1, 7, 2**63 - 1, -(2**63)}
    for _ in range(40):
        fps.add(rng.getrandbits(64) - 2**63)
    for bits in (3, 9, 12):
        x = rng.getrandbits(64)
        places = rng.sample(range(64), bits)
        for _ in range(250):
            y = x
            for p in places:
                y ^= rng.getrandbits(1) << p
            fps.add(y - 2**64 if y >> 63 else y)
    x = rng.getrandbits(63)
    for _ in range(30):  # a chain of three-bit steps
        for p in rng.sample(range(63), 3):
            x ^= 1 << p
        fps.add(x)
    want = brute(fps)
    df = spark.createDataFrame([(f,) for f in fps], "fp long")
    got = {r.fp: r.root for r in simhash.group_of(df).collect()}
    assert got == want


def test_odd_rows(spark, odd_docs, no_docs):
    rows = simhash.near_duplicates(odd_docs).collect()
    assert len(rows) == 10
    ids = {r.doc_id: r.component_id for r in rows if r.doc_id}
    assert ids[1] == ids[2] == 1 and ids[3] == ids[4] == ids[5] == 3 and ids[6] == 6 and ids[7] == 7
    assert sorted(r.component_id or 0 for r in rows if r.doc_id is None)[-1] == 3
    assert simhash.near_duplicates(no_docs).collect() == []


def test_query_equals_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    fps = {r.doc_id: plain(r.text) for r in docs}
    signed = {d: f - 2**64 if f >> 63 else f for d, f in fps.items()}
    root = brute(signed.values())
    first = {}
    for d, f in signed.items():
        first[root[f]] = min(first.get(root[f], d), d)
    got = {(r.doc_id, r.fingerprint, r.component_id) for r in op10_simhash(spark, sf_dir).collect()}
    assert got == {(d, f"{fps[d]:016x}", first[root[signed[d]]]) for d in fps}
