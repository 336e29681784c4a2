import re

import duckdb
import pytest
import sentencepiece
from pyspark.sql import functions as F

from sparkloom.llm import rollup, spm
from sparkloom.llm.common import scratch
from sparkloom.llm.queries import MODEL, TOKENIZERS, op4_token_counts, token_counts_by_pieces


def test_batches_are_idempotent_and_signed(spark, odd_docs, no_docs):
    counted = odd_docs.select("source", "lang", "doc_id", rollup.count_tokens(F.col("text"), "words-1").alias("n"))
    r = rollup.TokenRollup(spark, scratch(spark, "test"))
    assert r.totals().collect() == []
    assert r.commit("a/1", rollup.inserts(counted, "w", "n"))
    once = sorted(map(str, r.totals().collect()))
    assert not r.commit("a/1", rollup.inserts(counted, "w", "n"))
    assert sorted(map(str, r.totals().collect())) == once
    assert sum(x.docs for x in r.totals().collect()) == 10
    assert r.commit("fix", rollup.revisions(counted.withColumn("m", F.col("n") + 1), "w", "n", "m"))
    totals = r.totals().collect()
    assert sum(x.tokens for x in totals) == sum(x.n for x in counted.collect()) + 10
    assert r.commit("gone", rollup.deletes(counted.withColumn("m", F.col("n") + 1), "w", "m"))
    assert r.totals().collect() == []
    assert r.commit("none", rollup.inserts(no_docs.withColumn("n", F.lit(1)), "w", "n"))
    assert len(r.batches()) == 4


def test_an_unfinished_commit_does_not_count(spark, odd_docs):
    counted = odd_docs.select("source", "lang", F.lit(1).alias("n"))
    r = rollup.TokenRollup(spark, scratch(spark, "test"))
    r._store(rollup.inserts(counted, "w", "n"))  # an attempt that ends before its mark
    assert r.totals().collect() == [] and r.batches() == []
    assert r.commit("x", rollup.inserts(counted, "w", "n"))
    folder, digest = r._store(rollup.inserts(counted, "w", "n"))  # an attempt that comes second
    assert not r._create(r._mark("batch-x"), {"data": folder, "digest": digest})
    assert sum(x.docs for x in r.totals().collect()) == 10


def test_an_id_that_comes_back_can_be_compared(spark, odd_docs):
    counted = odd_docs.select("source", "lang", F.lit(1).alias("n"))
    r = rollup.TokenRollup(spark, scratch(spark, "test"))
    assert r.commit("x", rollup.inserts(counted, "w", "n"), compare=True)
    assert not r.commit("x", rollup.inserts(counted, "w", "n"), compare=True)
    with pytest.raises(ValueError):
        r.commit("x", rollup.deletes(counted, "w", "n"), compare=True)
    assert not r.commit("x", rollup.deletes(counted, "w", "n"))
    assert sum(x.docs for x in r.totals().collect()) == 10


def test_compaction_keeps_totals_and_ids(spark, odd_docs):
    counted = odd_docs.select("source", "lang", F.lit(2).alias("n"))
    r = rollup.TokenRollup(spark, scratch(spark, "test"))
    assert not r.compact()
    for i in range(3):
        assert r.commit(f"b{i}", rollup.inserts(counted, "w", "n"))
        before = sorted(map(str, r.totals().collect()))
        r.compact()
        assert sorted(map(str, r.totals().collect())) == before
        assert len(r._folders()[0]) == 1
        assert not r.commit(f"b{i}", rollup.inserts(counted, "w", "n"))
    assert sum(x.docs for x in r.totals().collect()) == 30
    assert r.batches() == ["batch-b0", "batch-b1", "batch-b2"]


def test_counts_equal_plain_ones(spark, odd_docs):
    texts = ["a  b", "x1-y2 ...", "\u00a0 \u2003", "\U0001f389\U0001f389 z", " \n\t ", "", None, "--", "é9é", "\x1c\x00 q"]
    rows = odd_docs.select("text").collect() + spark.createDataFrame([(t,) for t in texts], "text string").collect()
    df = spark.createDataFrame(rows, "text string")
    plain = {"words-1": r"[^\x20\x09-\x0D]+", "runs-1": "[A-Za-z0-9]+", "runs-2": r"[A-Za-z0-9]+|[^A-Za-z0-9\x20\x09-\x0D]+"}
    for version, pattern in plain.items():
        got = df.select("text", rollup.count_tokens(F.col("text"), version).alias("n")).collect()
        assert [r.n for r in got] == [len(re.findall(pattern, r.text or "")) for r in got]


def test_a_tokenizer_counts_as_one_version(spark, odd_docs):
    path = f"{TOKENIZERS}/{MODEL}"
    counted = rollup.count_pieces(odd_docs.select("source", "lang", "doc_id", "text"), spm.load_model(path)).cache()
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    assert sum(r.n_pieces for r in counted.collect()) == sum(len(sp.encode(r.text or "")) for r in odd_docs.collect())
    r = rollup.TokenRollup(spark, scratch(spark, "test"))
    r.commit("a", rollup.inserts(counted, MODEL, "n_pieces"))
    assert {(x.tokenizer, x.docs > 0) for x in r.totals().collect()} == {(MODEL, True)}
    counted.unpersist()


def test_sql(spark, sf_dir):
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    assert sorted(map(tuple, op4_token_counts(spark, sf_dir).collect())) == sorted(con.execute(rollup.ORACLE).fetchall())


def test_totals_by_a_model_equal_the_library_s(spark, sf_dir):
    sp = sentencepiece.SentencePieceProcessor(model_file=f"{TOKENIZERS}/{MODEL}")
    toxic = {r.doc_id for r in spark.read.parquet(f"{sf_dir}/labels.parquet").where("toxic = 1").collect()}
    want = {}
    for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect():
        if r.doc_id not in toxic:
            docs, tokens = want.get((r.source, r.lang), (0, 0))
            want[r.source, r.lang] = docs + 1, tokens + len(sp.encode(r.text))
    got = {(r.source, r.lang): (r.docs, r.tokens) for r in token_counts_by_pieces(spark, sf_dir).collect()}
    assert got == want
