"""A corpus pipeline of five stages; each takes what its predecessor kept, as Parquet, and its decisions take effect."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm import mixing, pii, quality, shingled, simhash, spm
from sparkloom.llm.common import checkpoint, discard, free_name, scratch, table
from sparkloom.llm.queries import MODEL, TOKENIZERS


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose quality score is 0.5 or more.

    Null and empty texts are scored like others, by the bias alone; repeated rows and ties get the same decision each;
    an empty table stays empty; all columns are kept, whatever their names."""
    weights = quality.train(docs, table(spark, sf_dir, "labels"))
    score = free_name(docs, "_score")
    return quality.score(docs, weights, out=score, keep_text=True).where(F.col(score) >= 0.5).select(*[f"`{c}`" for c in docs.columns])


#: Words of a shingle in the near-duplicate stage.
SHINGLE = 5


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group: the smallest id; of rows that share it, one of those with the smallest hash
    of id and text. Texts link at three SimHash bits or fewer, and at a Jaccard similarity of 0.8 or more of their
    shingles.

    Null, empty and wordless texts are one group; rows without an id stay only if their group has none, and then the
    smallest hash; of rows equal in id and text one stays; an empty table stays empty; all columns are kept."""
    key, part = free_name(docs, "_key"), free_name(docs, "_doc")
    row_key = F.xxhash64(F.col("doc_id"), F.col("text"))
    rows = docs.select("doc_id", "text", row_key.alias("_key"))
    seen = checkpoint(shingled.features(rows, width=SHINGLE, whole=False))
    groups = simhash.group_of(seen, shingled.links(seen, rows=rows.select("_key", "text"), width=SHINGLE))
    # the first row by fingerprint, aggregated before the shuffle, so that no join meets a hot fingerprint
    first = seen.groupBy("fp").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "_key")).alias("first"))
    chosen = first.join(groups, "fp").groupBy("root").agg(F.min("first").alias("first"))
    chosen = checkpoint(chosen.select(F.col("first._key").alias(key), F.col("first.doc_id").alias(part)))
    same = (F.col(f"a.{key}") == F.col(f"b.{key}")) & F.col("a.doc_id").eqNullSafe(F.col(f"b.{part}"))
    kept = docs.withColumn(key, row_key).alias("a").join(chosen.alias("b"), same, "left_semi")
    repeated = seen.groupBy("_key").agg(F.count("*").alias("n")).where("n > 1").select(F.col("_key").alias(key))
    if not repeated.isEmpty():  # rows equal in id and text
        several = kept.join(repeated, key, "left_semi").dropDuplicates([key, "doc_id"])
        kept = kept.join(repeated, key, "left_anti").unionByName(several)
    return kept.select(*[f"`{c}`" for c in docs.columns])


def pii_redaction(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data in the texts; all documents stay.

    Null texts stay null and empty ones empty; repeated rows are redacted alike; all columns are kept."""
    return pii.redacted(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes each document as many times as the mix says: 0 to 3 copies.

    A null source is a source of its own; null, empty and wordless texts have no words to take and count by their
    source's threshold like others; repeated rows are taken alike; an empty table stays empty; all columns are kept."""
    key, n, other = (free_name(docs, c) for c in ("_mix_key", "_copies_of_row", "_mix_id"))
    row_key = lambda h: F.xxhash64(F.col("doc_id"), F.col("source"), h)
    taken = mixing.mix(docs).groupBy(row_key(F.col("h")).alias(key), F.col("doc_id").alias(other)).agg(F.max("copies").alias(n)).where(F.col(n) > 0)
    rows = docs.withColumn(key, row_key(mixing.document_hash(F.col("doc_id"), F.col("text"))))
    joined = rows.alias("a").join(taken.alias("b"), (F.col(f"a.{key}") == F.col(f"b.{key}")) & F.col("a.doc_id").eqNullSafe(F.col(f"b.{other}")))
    return joined.withColumn(n, F.explode(F.sequence(F.lit(1).cast("long"), F.col(n)))).select(*[f"a.`{c}`" for c in docs.columns])


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and whether they decode to its text.

    Null and empty texts have no ids; repeated rows are listed each; columns but doc_id and source are not kept."""
    model = spm.load_model(f"{TOKENIZERS}/{MODEL}")
    return spm.encode(docs.select("doc_id", "source", "text"), model, check=True, keep_text=False)


STAGES = [("quality", quality_filter), ("near_dedup", near_dedup), ("pii", pii_redaction), ("mix", source_mix), ("tokenise", tokenise)]

#: SQL can't express the learnt scores and the tokenizer; tests hold run() against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    base = scratch(spark, "pipeline")
    for i, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{i}-{name}")
        docs = spark.read.parquet(f"{base}/{i}-{name}")
        if i:  # its predecessor's rows have been read
            discard(spark, f"{base}/{i - 1}-{STAGES[i - 1][0]}")
    return docs
