"""Thin queries over the operators of this package, and their SQL where SQL can express them."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import audit, fingerprint, hardneg, licenses, mixing, pii, quality, rollup, simhash, spm, suffixdedup, topk, urlfilter
from .common import checkpoint, scratch, table

#: Folder of public vocabulary files; the files are read on the driver only.
TOKENIZERS = os.environ.get("SPARKLOOM_TOKENIZERS", "/opt/tokenizers")
MODEL = "piece_bpe_32k.model"


def op1_sentencepiece(spark: SparkSession, sf_dir: str, folder: str = TOKENIZERS) -> DataFrame:
    """Token ids of every document, and whether decoding them gives the text back."""
    model = spm.load_model(f"{folder}/{MODEL}")
    return spm.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), model, check=True, keep_text=False)


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op3_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals after four commits: all documents are inserted under two tokenizer versions; the second version's counts
    are revised; toxic documents are deleted; the first commit comes again and changes nothing."""
    docs = table(spark, sf_dir, "documents")
    toxic = table(spark, sf_dir, "labels").where("toxic = 1").select(F.col("doc_id").alias("_id")).distinct()
    counts = {v: rollup.count_tokens(F.col("text"), v).alias(v) for v in rollup.VERSIONS}
    counted = docs.select("doc_id", "source", "lang", *counts.values())
    counted = checkpoint(counted.join(toxic.withColumn("_toxic", F.lit(True)), F.col("doc_id") == F.col("_id"), "left"))
    gone = counted.where("_toxic")
    totals = rollup.TokenRollup(spark, scratch(spark, "token-rollup"))
    load = (rollup.inserts(counted, "words-1", "words-1"), rollup.inserts(counted, "runs", "runs-1"))
    totals.commit("load", *load)
    totals.commit("revise", rollup.revisions(counted, "runs", "runs-1", "runs-2"))
    totals.commit("delete", rollup.deletes(gone, "words-1", "words-1"), rollup.deletes(gone, "runs", "runs-2"))
    totals.commit("load", *load)
    return totals.totals()


def token_counts_by_pieces(spark: SparkSession, sf_dir: str, folder: str = TOKENIZERS) -> DataFrame:
    """Totals of op4_token_counts' operator by a real model's tokens: all documents are inserted, toxic ones deleted."""
    docs, model = table(spark, sf_dir, "documents"), spm.load_model(f"{folder}/{MODEL}")
    counted = checkpoint(rollup.count_pieces(docs.select("doc_id", "source", "lang", "text"), model))
    toxic = table(spark, sf_dir, "labels").where("toxic = 1").select("doc_id").distinct()
    totals = rollup.TokenRollup(spark, scratch(spark, "piece-rollup"))
    totals.commit("load", rollup.inserts(counted, MODEL, "n_pieces"))
    totals.commit("delete", rollup.deletes(counted.join(toxic, "doc_id", "left_semi"), MODEL, "n_pieces"))
    return totals.totals()


def op5_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.edited_pairs(table(spark, sf_dir, "documents"))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digests(table(spark, sf_dir, "documents"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    weights = quality.train(docs, table(spark, sf_dir, "labels"))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    scored = quality.score(docs, weights)
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op8_urlfilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge(table(spark, sf_dir, "pages"))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixdedup.repeated_passages(table(spark, sf_dir, "documents"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex_fingerprint(F.col("fp")).alias("fingerprint"), "component_id")


def op11_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every seventh label is wrong on purpose."""
    return hardneg.mine(hardneg.with_shifted_labels(table(spark, sf_dir, "embeddings")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_sentencepiece, op2_mixing, op3_topk, op4_token_counts, op5_order_minhash, op6_pii, op7_quality, op8_urlfilter, op9_suffix_dedup, op10_simhash, op11_license_scan, op12_filter_audit, op13_hard_negatives)
    return {f.__name__: f for f in (*found, token_counts_by_pieces)}


def oracle_sql() -> dict[str, str]:
    return {"op2_mixing": mixing.ORACLE, "op3_topk": topk.ORACLE, "op4_token_counts": rollup.ORACLE, "op11_license_scan": licenses.ORACLE, "op12_filter_audit": audit.ORACLE, "op13_hard_negatives": hardneg.ORACLE}
