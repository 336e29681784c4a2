import zlib

import numpy as np
from pyspark.sql import functions as F

from sparkloom.llm import quality
from sparkloom.llm.queries import op7_quality


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    rows = op7_quality(spark, d).collect()
    docs = spark.read.parquet(f"{d}/documents.parquet")
    assert len(rows) == docs.count()
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    held = [(r.predicted, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    assert len(held) > 50 and np.mean([a == b for a, b in held]) >= 0.95


def test_scores_ignore_labels_of_held_out_rows_and_other_columns(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    a = quality.train(docs, labels)
    turned = labels.withColumn("quality", F.when(quality.learnable(F.col("doc_id")), F.col("quality")).otherwise(1 - F.col("quality")))
    b = quality.train(docs.withColumn("lang", F.lit("zz")).withColumn("source", F.lit(None).cast("string")), turned)
    assert (a == b).all()


def test_training_equals_a_plain_version():
    """Follow the regularised leader with dictionaries, one coordinate at a time."""
    rng = np.random.default_rng(1)
    words = [f"w{i}" for i in range(60)]
    rows = [(" ".join(rng.choice(words[: 40 if y else 60], rng.integers(0, 40))), int(y)) for y in rng.integers(0, 2, 80)]
    z, n = {}, {}

    def weight(i, bias):
        l1, l2 = (0.0, 0.0) if bias else (quality.L1, quality.L2)
        if abs(z.get(i, 0.0)) <= l1:
            return 0.0
        sign = 1.0 if z.get(i, 0.0) > 0 else -1.0
        return -(z[i] - sign * l1) / ((quality.BETA + n[i] ** 0.5) / quality.ALPHA + l2)

    for _ in range(quality.EPOCHS):
        for text, y in rows:
            at, x = quality.features(text)
            pairs = [*zip(at.tolist(), x.tolist()), (quality.DIMS, 1.0)]
            w = {i: weight(i, i == quality.DIMS) for i, _ in pairs}
            p = 1 / (1 + np.exp(-sum(w[i] * v for i, v in pairs)))
            for i, v in pairs:
                g = (p - y) * v
                sigma = ((n.get(i, 0.0) + g * g) ** 0.5 - n.get(i, 0.0) ** 0.5) / quality.ALPHA
                z[i] = z.get(i, 0.0) + g - sigma * w[i]
                n[i] = n.get(i, 0.0) + g * g
    got = quality.fit_rows([(*quality.features(t), y) for t, y in rows])
    want = np.zeros(quality.DIMS + 1)
    for i in z:
        want[i] = weight(i, i == quality.DIMS)
    assert np.count_nonzero(want) > 20 and np.allclose(got, want, atol=1e-9)


def test_text_score_equals_sparse_dot_product():
    rng = np.random.default_rng(0)
    w = rng.normal(size=quality.DIMS + 1)
    for text in ("", "One two. One two!! one", "x " * 300, "a"):
        at, x = quality.features(text)
        assert quality.score_text(text, w) == np.float64(1 / (1 + np.exp(-(w[at] @ x + w[-1])))) or abs(quality.score_text(text, w) - 1 / (1 + np.exp(-(w[at] @ x + w[-1])))) < 1e-9


def test_parts_give_the_same_places(monkeypatch):
    text = " ".join(f"w{i % 7} x" for i in range(200))
    whole = np.sort(np.concatenate(list(quality.ngram_places(text))))
    monkeypatch.setattr(quality, "AT_ONCE", 37)
    assert (np.sort(np.concatenate(list(quality.ngram_places(text)))) == whole).all()


def test_odd_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, None), (None, 1), (6, 1), (99, 0), (4, 7)], "doc_id long, quality int")
    w = quality.train(odd_docs, labels)
    rows = quality.score(odd_docs, w, keep_text=True).collect()
    assert len(rows) == 10 and all(0 <= r.score <= 1 for r in rows)
    bias = {r.score for r in rows if not (r.text or "").strip()}
    assert len(bias) == 1
    none = quality.train(no_docs, labels.limit(0))
    assert not none.any() and quality.score_text("anything", none) == 0.5
    assert quality.score(no_docs, none).collect() == []


def test_epochs_over_kept_rows_equal_rows_in_memory(spark, sf_dir, monkeypatch):
    """The sample is of labelled documents that are there; features are written a few at a time."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("doc_id % 3 <> 0").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    monkeypatch.setattr(quality, "AT_ONCE", 50)
    got = quality.train(docs, labels, sample=20)
    rows = labels.join(docs, "doc_id").where(quality.learnable(F.col("doc_id")) & F.col("quality").isin(0, 1)).orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(20).collect()
    assert len(rows) == 20
    assert np.allclose(got, quality.fit_rows([(*quality.features(r.text), r.quality) for r in rows]), atol=1e-12)
