"""Mixing sources to target weights with hash-threshold histograms; DataFrame functions only.

Sizes are summed by source and bucket of a document hash. Each source's budget falls into one bucket; only that bucket
is split again, until the hash is used up. A document is then kept by comparing its hash with its source's threshold:
no sort of documents, one pre-aggregated histogram of bounded width for each source and level, and thresholds that are
nested: a larger budget keeps all that a smaller one keeps.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import checkpoint, n_words

#: Bits of the document hash that one histogram level resolves, and levels.
LEVEL_BITS, LEVELS = 13, 3
BITS = LEVEL_BITS * LEVELS


def document_hash(doc_id: Column, text: Column) -> Column:
    """The first 39 bits of an MD5 over id and text, as a long; equal rows tie."""
    digest = F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), F.coalesce(text, F.lit(""))))
    return F.shiftright(F.conv(F.substring(digest, 1, 10), 16, 10).cast("long"), 40 - BITS)


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), cap: int = 3) -> DataFrame:
    """(source, source_size) -> with the target of each source.

    Sources by code point, null last, weigh weights in turn and share the sum of all sizes. A target stops at cap times
    its source's size; the excess is shared anew by weight until no target is above: filling by ascending cap per
    weight gives that fixed point in one pass. One row a source; documents are never in this window."""
    turn = (F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights)
    whole = W.partitionBy()
    fill = W.orderBy((F.col("_cap") / F.col("_w")), F.col("source").asc_nulls_last())
    dec = "decimal(38,0)"
    df = (
        sizes.withColumn("_w", F.element_at(F.array(*[F.lit(w).cast("long") for w in weights]), turn + 1))
        .withColumn("_cap", F.col("source_size") * cap)
        .withColumn("_total", F.sum("source_size").over(whole))
        .withColumn("_capped_before", F.coalesce(F.sum("_cap").over(fill.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("_w_left", F.sum("_w").over(fill.rowsBetween(0, W.unboundedFollowing)))
        .withColumn("_full", F.col("_w").cast(dec) * (F.col("_total") - F.col("_capped_before")).cast(dec) > F.col("_cap").cast(dec) * F.col("_w_left").cast(dec))
        .withColumn("_rest", F.col("_total") - F.coalesce(F.sum(F.when(F.col("_full"), F.col("_cap"))).over(whole), F.lit(0)))
        .withColumn("_w_open", F.sum(F.when(~F.col("_full"), F.col("_w"))).over(whole))
    )
    target = F.when(F.col("_full"), F.col("_cap").cast("double")).otherwise((F.col("_w") * F.col("_rest")).cast("double") / F.col("_w_open"))
    return df.select("source", "source_size", target.alias("target"))


def _same(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)


def thresholds(slim: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, source_size, target) -> with copies (of every document) and cut: documents whose hash is below it are
    taken once more. slim: (source, size, h)."""
    copies = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    at = checkpoint(
        targets.withColumn("copies", copies)
        .withColumn("_rest", F.col("target") - F.col("copies") * F.col("source_size"))
        .withColumn("_prefix", F.lit(0).cast("long"))
        .withColumn("_cell", F.col("source_size"))
    )
    for level in range(LEVELS):
        shift = BITS - LEVEL_BITS * (level + 1)
        t = at.select(F.col("source").alias("_s"), "_prefix", "_rest")
        inside = _same(F.col("source"), F.col("_s")) & (F.shiftright("h", shift + LEVEL_BITS) == F.col("_prefix"))
        by_bucket = slim.join(t, inside).groupBy("source", "_rest", F.shiftright("h", shift).alias("_bucket")).agg(F.sum("size").alias("_n"))
        upto = F.sum("_n").over(W.partitionBy("source").orderBy("_bucket").rowsBetween(W.unboundedPreceding, 0))
        edge = (
            by_bucket.withColumn("_upto", upto)
            .where((F.col("_upto") - F.col("_n") <= F.col("_rest")) & (F.col("_upto") > F.col("_rest")))
            .select(F.col("source").alias("_s"), F.col("_bucket").alias("_prefix2"), (F.col("_rest") - (F.col("_upto") - F.col("_n"))).alias("_rest2"), F.col("_n").alias("_cell2"))
        )
        at = checkpoint(
            at.join(edge, _same(F.col("source"), F.col("_s")), "left").select(
                "source", "source_size", "target", "copies",
                F.coalesce("_rest2", "_rest").alias("_rest"),
                F.coalesce("_prefix2", F.shiftleft("_prefix", LEVEL_BITS)).alias("_prefix"),
                F.coalesce("_cell2", F.lit(0)).alias("_cell"),
            )
        )
    # what is left of the budget ends inside one hash value: taken if that comes nearer to the target
    more = (F.col("_cell") > 0) & (F.col("_rest") * 2 >= F.col("_cell"))
    return at.select("source", "source_size", "target", "copies", (F.col("_prefix") + more.cast("long")).alias("cut"))


def mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), cap: int = 3, doc_id: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """One row a document: doc_id, size (words), source_size, target (its source's), taken (words, repeats counted),
    copies (times the document is taken: 0 to cap).

    Defined results: a null text has size 0; a null source is a source of its own, last in order; rows with equal id
    and text share a hash and are taken alike; a source without words has target 0; an empty table gives no rows.
    Reruns agree: everything depends on the rows alone, not on their order or partitions."""
    key = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{source}`").alias("source"), F.col(f"`{text}`").alias("_text"))
    slim = checkpoint(key.select("doc_id", "source", n_words(F.col("_text")).alias("size"), document_hash(F.col("doc_id"), F.col("_text")).alias("h")))
    targets = source_targets(slim.groupBy("source").agg(F.sum("size").alias("source_size")), weights, cap)
    cuts = thresholds(slim.select("source", "size", "h"), targets).withColumnRenamed("source", "_s")
    copies = F.col("copies") + (F.col("h") < F.col("cut")).cast("long")
    return slim.join(cuts, _same(F.col("source"), F.col("_s"))).select(
        "doc_id", "size", "source_size", "target", (F.col("size") * copies).alias("taken"), copies.alias("copies"), "source", "h"
    )


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         CAST(('0x' || md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, ''))[1:10]) AS BIGINT) >> 1 AS h
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, CAST([5, 2, 1][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS INT) + 1] AS BIGINT) AS w, source_size * 3 AS cap FROM s),
f AS (
  SELECT *, sum(source_size) OVER () AS total,
         coalesce(sum(cap) OVER (ORDER BY CAST(cap AS DOUBLE) / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
         sum(w) OVER (ORDER BY CAST(cap AS DOUBLE) / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS w_left
  FROM w),
g AS (SELECT *, w * (total - before) > cap * w_left AS full_ FROM f),
t AS (
  SELECT source, source_size,
         CASE WHEN full_ THEN CAST(cap AS DOUBLE)
              ELSE CAST(w * (total - coalesce(sum(CASE WHEN full_ THEN cap END) OVER (), 0)) AS DOUBLE) / CAST(sum(CASE WHEN NOT full_ THEN w END) OVER () AS DOUBLE) END AS target
  FROM g),
r AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS copies FROM t),
c AS (SELECT source, h, sum(size) AS cell, sum(sum(size)) OVER (PARTITION BY source ORDER BY h) AS upto FROM d GROUP BY source, h),
x AS (
  SELECT d.doc_id, d.size, r.source_size, r.target, r.copies,
         r.target - CAST(r.copies * r.source_size AS DOUBLE) AS rest, c.cell, c.upto, d.source, d.h
  FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source JOIN c ON c.source IS NOT DISTINCT FROM d.source AND c.h = d.h)
SELECT doc_id, size, source_size, target,
       CAST(size * (copies + CASE WHEN upto <= rest THEN 1 WHEN upto - cell <= rest AND (rest - (upto - cell)) * 2 >= cell THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM x
"""
