import random

import numpy as np
import pytest

from sparkloom.llm import shingled, simhash

WIDTH = 5


def _texts() -> list[str | None]:
    """A crowd of near copies of one text, smaller groups, loners, copies, short and missing texts."""
    rnd = random.Random(5)
    word = lambda: f"w{rnd.randrange(4000)}"
    out: list[str | None] = [None, "", " \n", "one", "one two", "one two", "ONE two"]
    for copies in (60, 5, 3, 2, 1, 1, 1):
        base = [word() for _ in range(rnd.choice((80, 200, 900)))]
        for _ in range(copies):
            own = list(base)
            for _ in range(rnd.randrange(1 + len(own) // 60)):
                own[rnd.randrange(len(own))] = word()
            out.append(" ".join(own))
    return out


def _groups(n: int, pairs: list[tuple[int, int]]) -> list[int]:
    root = list(range(n))
    for a, b in pairs:
        x, y = root[a], root[b]
        root = [min(x, y) if r in (x, y) else r for r in root]
    return root


@pytest.mark.parametrize("listed", [512, 8])
def test_components_equal_brute_force(spark, listed):
    texts = _texts()
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    seen = shingled.features(df, WIDTH).cache()
    root = {r.node: r.root for r in simhash.components(shingled.links(seen, listed)).collect()}
    fp = [simhash.simhash(t, WIDTH) for t in texts]
    sets = [set(simhash.shingle_hashes(t, WIDTH).tolist()) for t in texts]
    low = [{h >> 32 for h in s} for s in sets]
    pairs = []
    for i in range(len(texts)):
        for j in range(i):
            least = sorted(low[i] | low[j])[: shingled.SKETCH]
            if fp[i] == fp[j] or (sets[i] and sets[j] and len(low[i].intersection(low[j], least)) >= 0.8 * len(least)):
                pairs.append((j, i))
    want = _groups(len(texts), pairs)
    first: dict[int, int] = {}
    assert [first.setdefault(root.get(f, f), i) for i, f in enumerate(fp)] == want
    seen.unpersist()


def test_likeness_is_jaccard_of_small_sets_and_near_it_for_large_ones():
    rng = np.random.default_rng(3)
    for n in (1, 40, 200, 5000):
        x = rng.integers(0, 1 << 63, n, dtype=np.uint64)
        y = np.concatenate([x[n // 8 :], rng.integers(0, 1 << 63, n // 9, dtype=np.uint64)])
        exact = len(np.intersect1d(x, y)) / len(np.union1d(x, y))
        a, b = (shingled._padded([shingled.sketch_of(v)[1]]) for v in (x, y))
        got = shingled.likeness(a[0][0], *b)[0]
        assert got == pytest.approx(exact, abs=1e-12 if len(np.union1d(x, y)) <= shingled.SKETCH else 0.1)


def test_pairs_near_the_limit_are_decided_by_whole_sets(spark):
    """Long texts at 0.77 to 0.83 by exact Jaccard, some of which the sketch puts on the wrong side."""
    rnd = random.Random(11)
    word = lambda: f"v{rnd.getrandbits(40):x}"
    texts, wrong = [], 0
    for i in range(60):
        base = [word() for _ in range(1500)]
        cut = (170, 160, 152, 146, 138, 130)[i % 6]  # a run of new words: one cut, not many broken shingles
        texts += [" ".join(base), " ".join(base[:300] + [word() for _ in range(cut)] + base[300 + cut :])]
    sets = [set(simhash.shingle_hashes(t, WIDTH).tolist()) for t in texts]
    alike = [len(a & b) / len(a | b) for a, b in zip(sets[::2], sets[1::2])]
    for a, b, exact in zip(sets[::2], sets[1::2], alike):
        x, y = (shingled._padded([shingled.sketch_of(np.array(list(s), np.uint64))[1]]) for s in (a, b))
        wrong += (shingled.likeness(x[0][0], *y)[0] >= 0.8) != (exact >= 0.8)
    assert wrong > 5 and 0.76 < min(alike) < 0.8 < max(alike) < 0.86
    df = spark.createDataFrame(list(enumerate(texts)), "_key long, text string")
    fp = [simhash.simhash(t, WIDTH) for t in texts]
    whole, again = shingled.features(df, WIDTH), shingled.features(df, WIDTH, whole=False)
    for found in (shingled.links(whole), shingled.links(again, rows=df, width=WIDTH)):
        got = {(r.a, r.b) for r in found.collect()}
        assert got == {(max(p), min(p)) for p, exact in zip(zip(fp[::2], fp[1::2]), alike) if exact >= 0.8}


def test_lists_of_large_sets_are_bounded_by_shingles(spark, monkeypatch):
    monkeypatch.setattr(shingled, "HELD", 4000)
    texts = _texts()
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    sets = [set(simhash.shingle_hashes(t, WIDTH).tolist()) for t in texts]
    fp = [simhash.simhash(t, WIDTH) for t in texts]
    pairs = [(j, i) for i in range(len(texts)) for j in range(i) if fp[i] == fp[j] or (sets[i] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]))]
    root = {r.node: r.root for r in simhash.components(shingled.links(shingled.features(df, WIDTH))).collect()}
    first: dict[int, int] = {}
    assert [first.setdefault(root.get(f, f), i) for i, f in enumerate(fp)] == _groups(len(texts), pairs)


def test_empty_table(spark, no_docs):
    seen = shingled.features(no_docs.select("doc_id", "text"), WIDTH)
    assert shingled.links(seen).count() == 0
