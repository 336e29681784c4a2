import random

import pytest

from sparkloom.llm import suffixdedup as sd
from sparkloom.llm.queries import op9_suffix_dedup


def windows(docs, n=sd.MIN_WORDS):
    """Positions covered by runs of n words that another document has too, by brute force."""
    seen = {}
    for i, (_, words) in enumerate(docs):
        for k in range(len(words) - n + 1):
            seen.setdefault(tuple(words[k : k + n]), set()).add(i)
    out = []
    for i, (d, words) in enumerate(docs):
        covered = set()
        for k in range(len(words) - n + 1):
            if len(seen[tuple(words[k : k + n])]) > 1:
                covered |= set(range(k, k + n))
        out.append((d, covered))
    return out


def covered(rows):
    out = {}
    for r in rows:
        out.setdefault(r.doc_id, set()).update(range(r.start_word, r.end_word))
        assert r.n_words == r.end_word - r.start_word >= sd.MIN_WORDS
    return out


def fresh(rng, n):
    return [f"{rng.getrandbits(48):x}" for _ in range(n)]


@pytest.fixture(params=[sd.LISTED, 4])
def listed(request, monkeypatch):
    """Both ways of comparing suffixes: in lists, and dealt by run."""
    monkeypatch.setattr(sd, "LISTED", request.param)


def check(spark, docs):
    """The query's covered words equal brute force exactly."""
    df = spark.createDataFrame([(d, " ".join(w)) for d, w in docs], "doc_id long, text string")
    assert covered(sd.repeated_passages(df.repartition(5)).collect()) == {d: c for d, c in windows(docs) if c}


def test_planted_passages_are_found_whole_and_nothing_else(spark, listed):
    rng = random.Random(9)
    passages = [fresh(rng, n) for n in (50, 51, 60, 75, 300, 1200)]
    docs = []
    for i in range(60):
        words = fresh(rng, rng.randint(0, 120))
        if i % 2:
            words += passages[i % 6] + fresh(rng, rng.randint(0, 90))
        if i % 5 == 0:
            words = passages[(i // 5) % 6] + words
        docs.append((i, words))
    near = fresh(rng, 49)
    docs += [(60, fresh(rng, 20) + near + fresh(rng, 20)), (61, near), (62, ["der"] * 200), (63, [])]
    check(spark, docs)


def test_shorter_neighbours_hide_nothing(spark, listed):
    """A passage in two documents, and others that share parts of it: too short to count, on either side or both."""
    rng = random.Random(21)
    docs = []
    for _ in range(80):
        n = rng.randint(50, 84)
        passage = fresh(rng, n)
        new = lambda: fresh(rng, rng.randint(0, 60))
        docs += [(len(docs) + i, w) for i, w in enumerate([new() + passage + new(), new() + passage + new()])]
        for _ in range(rng.randint(1, 4)):
            a = rng.randint(0, n - 16)
            docs.append((len(docs), new() + passage[a : a + rng.randint(16, 49)] + new()))
    check(spark, docs)


def test_frequent_tails_hide_nothing(spark, listed):
    """Passages of a header and a line that many documents hold alone."""
    rng = random.Random(22)
    line, headers = fresh(rng, 30), [fresh(rng, 25) for _ in range(5)]
    docs = [(i, fresh(rng, 15) + (headers[i % 5] if i < 10 else []) + line + fresh(rng, rng.randint(0, 40))) for i in range(120)]
    check(spark, docs)


def test_query_equals_brute_force(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    docs = [(r.doc_id, (r.text or "").encode().split()) for r in rows]
    assert covered(op9_suffix_dedup(spark, sf_dir).collect()) == {d: c for d, c in windows(docs) if c}


def test_shared_loops_are_found_whole(spark, listed):
    """Passages that repeat one to nine words, at other offsets in two documents each, alone and beside others."""
    rng = random.Random(4)
    docs = []
    for p in (1, 2, 3, 4, 5, 9):
        for n in (50, 51, 120, 121, 300):
            loop = fresh(rng, p) * n
            for before in (rng.randint(0, 40), rng.randint(41, 99)):
                docs.append((len(docs), fresh(rng, before) + loop[:n] + fresh(rng, 20)))
            docs.append((len(docs), loop[:n] + docs[-1][1][-15:]))
    one = fresh(rng, 1)
    docs += [(len(docs) + i, fresh(rng, 3) + one * n + fresh(rng, 3)) for i, n in enumerate((49, 50, 66, 120, 200, 33))]
    a, b = fresh(rng, 1), fresh(rng, 2)
    docs += [(len(docs) + i, fresh(rng, i) + a * 60 + b * 40 + a * n) for i, n in enumerate((10, 60, 61))]
    check(spark, docs)


def test_random_texts_of_few_words(spark, listed):
    """Many short repeats, loops and overlaps at once."""
    rng = random.Random(30)
    for size in (2, 3, 40):
        words = fresh(rng, size)
        base = [rng.choice(words) for _ in range(400)]
        docs = []
        for i in range(40):
            a, b = sorted(rng.sample(range(400), 2))
            text = base[a:b] + [rng.choice(words) for _ in range(rng.randint(0, 30))] + base[: rng.randint(0, 90)]
            docs.append((i, text * rng.choice((1, 1, 3))))
        check(spark, docs)


def test_loops_ask_for_few_runs():
    rng = random.Random(6)
    for p in (1, 2, 3, 4):
        for before in range(0, 80, 7):
            gram, at, low, high, reach = sd.places(sd.word_hashes(" ".join(fresh(rng, before) + (fresh(rng, p) * 3000)[:3000] + fresh(rng, 60))))
            assert len(at) < 60
            runs = sorted((a - h, a - lo + r) for a, lo, h, r in zip(at, low, high, reach))
            assert runs[0][0] == 0 and max(e for _, e in runs) == before + 3010
            assert all(b[0] <= max(e for _, e in runs[: i + 1]) + 1 for i, b in enumerate(runs[1:]))


def test_odd_rows(spark, odd_docs, no_docs):
    assert sd.repeated_passages(odd_docs).collect() == []  # the copies are short; a row's own double is no other document
    assert sd.repeated_passages(no_docs).collect() == []
    long = " ".join(f"w{i}" for i in range(5000))
    df = spark.createDataFrame([(1, long), (1, long), (2, long), (None, long), (3, None), (4, "")], "doc_id long, text string").selectExpr("*", "1 as key", "2 as at")
    got = sorted((r.doc_id or 0, r.start_word, r.end_word) for r in sd.repeated_passages(df).collect())
    assert got == [(0, 0, 5000), (1, 0, 5000), (2, 0, 5000)]
