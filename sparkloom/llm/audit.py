"""Filter interaction audit: what filters remove, alone and in every order, by a packed bitmap index.

Each document gets a byte of failed filters and labels. Per Arrow batch its rows are put in order of their part, and
every filter and label becomes a NumPy bitset in which each part begins on a byte of its own. For each set of filters
that may have run before (32 for five filters) the documents still kept are a chain of AND-NOTs, and what the next
filter removes of them, good and toxic ones included, is an AND and a popcount for each part. Batches emit only counts;
these are summed, and the orders are read off the sums: a step needs the set of filters before it, not their order.

A text's copies are told by its SHA-256. Their smallest id is an aggregate, and comes back by a join of two plain
shuffles, which splits where one text is very common.

Defined results: a null text counts as empty; a null part is the empty string; rows without an id never hold a smaller
id, nor has anything a smaller id than theirs, so they don't fail as copies; rows that share an id and text aren't
copies of each other, but all of their text's smallest id; a document has a label if any of its label rows says so; an
empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations, permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import checkpoint

FILTERS = "ABCDE"
#: Words that a text must have, the least percentage of distinct words and the most of capitals.
LEAST_WORDS, DISTINCT_PERCENT, CAPITALS_PERCENT = 200, 50, 3
SPECIALS = b"#$%&*|"
CAPITALS = bytes(range(ord("A"), ord("Z") + 1))
COPY, GOOD, TOXIC = 1 << FILTERS.index("E"), 1 << len(FILTERS), 1 << len(FILTERS) + 1


def failures(text: str | None) -> int:
    """Bits of the filters A to D that a whole text fails."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()  # at space and 9 to 13
    chars, n = len(text or ""), len(words)
    failed = (n < LEAST_WORDS, 100 * len(set(words)) < DISTINCT_PERCENT * n, 100 * (len(raw) - len(raw.translate(None, CAPITALS))) > CAPITALS_PERCENT * chars, len(raw.translate(None, SPECIALS)) < len(raw))
    return sum(bool(f) << i for i, f in enumerate(failed))


def _read(docs: DataFrame) -> DataFrame:
    """(doc_id, part, _text) -> (doc_id, part, digest, bits)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t.as_py() for t in batch.column("_text")]
            digests = [hashlib.sha256((t or "").encode("utf-8", "surrogatepass")).digest() for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("part"), pa.array(digests, pa.binary()), pa.array([failures(t) for t in texts], pa.int32())], ["doc_id", "part", "digest", "bits"])

    kept = [docs.schema["doc_id"], docs.schema["part"]]
    return docs.mapInArrow(run, T.StructType([*kept, T.StructField("digest", T.BinaryType()), T.StructField("bits", T.IntegerType())]))


def index(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """(part, bits) of every document: the filters it fails, and its labels."""
    own = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.coalesce(F.col(f"`{part}`").cast("string"), F.lit("")).alias("part"), F.col(f"`{text}`").alias("_text"))
    read = checkpoint(_read(own))
    first = read.groupBy(F.col("digest").alias("_digest")).agg(F.min("doc_id").alias("_first"), F.count("*").alias("_n")).where("_n > 1")
    said = labels.where("doc_id is not null").groupBy(F.col("doc_id").alias("_id")).agg(F.max(F.when(F.col("quality") == 1, GOOD).otherwise(0)).alias("_good"), F.max(F.when(F.col("toxic") == 1, TOXIC).otherwise(0)).alias("_toxic"))
    known = read.join(said, F.col("doc_id") == F.col("_id"), "left").join(first, F.col("digest") == F.col("_digest"), "left")
    copy = F.when(F.col("_first") < F.col("doc_id"), COPY).otherwise(0)
    bits = F.col("bits").bitwiseOR(copy).bitwiseOR(F.coalesce("_good", F.lit(0))).bitwiseOR(F.coalesce("_toxic", F.lit(0)))
    return known.select("part", bits.cast("int").alias("bits"))


def subsets() -> list[tuple[int, int]]:
    """(set of filters that ran before, next filter) for each filter that isn't in the set."""
    n = len(FILTERS)
    return [(sum(1 << i for i in before), f) for k in range(n) for before in combinations(range(n), k) for f in range(n) if f not in before]


def counted(bits: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Documents' bits in order of their part, starts: where each part begins -> for each part its documents, those that
    fail each filter, those that fail it only, and for each of subsets() what is removed, good and toxic ones of it."""
    sizes = np.diff(np.r_[starts, len(bits)])
    first_byte = np.cumsum((sizes + 7) // 8) - (sizes + 7) // 8
    place = np.repeat(first_byte * 8 - starts, sizes) + np.arange(len(bits))  # each part begins on a byte
    width = int(first_byte[-1] + (sizes[-1] + 7) // 8) * 8

    def packed(mask: int | None) -> np.ndarray:
        flags = np.zeros(width, bool)
        flags[place] = True if mask is None else bits & mask != 0
        return np.packbits(flags)

    def popcount(x: np.ndarray) -> np.ndarray:
        return np.add.reduceat(np.bitwise_count(x), first_byte, dtype=np.int64)

    every, fails = packed(None), [packed(1 << i) for i in range(len(FILTERS))]
    good, toxic = packed(GOOD), packed(TOXIC)
    kept = [every]
    for mask in range(1, 1 << len(FILTERS)):  # AND-NOT of the set's last filter from the rest of the set
        last = mask.bit_length() - 1
        kept.append(kept[mask ^ 1 << last] & ~fails[last])
    full = (1 << len(FILTERS)) - 1
    out = [sizes, *[popcount(f) for f in fails], *[popcount(kept[full ^ 1 << i] & f) for i, f in enumerate(fails)]]
    for before, f in subsets():
        gone = kept[before] & fails[f]
        out += [popcount(gone), popcount(gone & good), popcount(gone & toxic)]
    return np.array(out).T


def bitmaps(flags: DataFrame) -> DataFrame:
    """(part, bits) -> (part, counts) as of counted(), summed over all documents."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            coded = batch.column("part").dictionary_encode()
            part, bits = coded.indices.to_numpy(), batch.column("bits").to_numpy()
            order = np.argsort(part, kind="stable")
            starts = np.flatnonzero(np.r_[True, np.diff(part[order]) != 0])
            counts = counted(bits[order], starts)
            names = coded.dictionary.take(pa.array(part[order][starts]))
            yield pa.RecordBatch.from_arrays([names, pa.array(list(counts), pa.list_(pa.int64()))], ["part", "counts"])

    n = 1 + 2 * len(FILTERS) + 3 * len(subsets())
    sums = flags.mapInArrow(run, "part string, counts array<long>").groupBy("part").agg(*[F.sum(F.col("counts")[i]).alias(f"c{i}") for i in range(n)])
    return sums.select("part", F.array(*[f"c{i}" for i in range(n)]).alias("counts"))


def _steps(spark: SparkSession) -> DataFrame:
    """Each order and step with the places of its counts: 600 rows, whatever the data."""
    at, n = {s: 1 + 2 * len(FILTERS) + 3 * i for i, s in enumerate(subsets())}, len(FILTERS)
    rows = []
    for order in permutations(range(n)):
        before, gone = 0, []
        for step, f in enumerate(order):
            gone.append(at[before, f])
            rows.append(("".join(FILTERS[i] for i in order), step + 1, f, gone[:]))
            before |= 1 << f
    return spark.createDataFrame(rows, "filter_order string, step int, filter int, gone array<int>")


def audit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """For each part, order of the filters and step: documents kept after it, removed by it, redundant (they fail its
    filter but went before), failing its filter only, good and toxic ones removed by it, and shapley: what its filter
    removes at any step, summed over all orders."""
    sums = checkpoint(bitmaps(index(docs, labels, doc_id, text, part)))
    n, after = len(FILTERS), 1 + 2 * len(FILTERS)
    # orders in which exactly this set ran before: of the set, and of what comes after
    weight = [factorial(before.bit_count()) * factorial(n - 1 - before.bit_count()) for before, _ in subsets()]
    shapley = F.array(*[sum((F.col("counts")[after + 3 * i] * weight[i] for i, (_, g) in enumerate(subsets()) if g == f), F.lit(0).cast("long")) for f in range(n)])
    wide = sums.select("part", "counts", shapley.alias("_shapley"))
    steps = _steps(docs.sparkSession)
    each = wide.select("part", "counts", "_shapley", F.explode(F.lit(list(range(n)))).alias("_filter"))
    each = each.join(F.broadcast(steps), F.col("_filter") == F.col("filter"))  # 600 rows
    at = lambda i: F.element_at("counts", i + 1)
    here = F.element_at("gone", -1)
    lost = F.aggregate(F.transform("gone", lambda i: at(i)), F.lit(0).cast("long"), lambda a, b: a + b)
    removed = at(here)
    return each.select(
        "part", "filter_order", "step", (F.col("counts")[0] - lost).alias("kept"), removed.alias("removed"),
        (at(F.col("filter") + 1) - removed).alias("redundant"), at(F.col("filter") + 1 + n).alias("unique_fails"),
        at(here + 1).alias("good_lost"), at(here + 2).alias("toxic_lost"), F.element_at("_shapley", F.col("filter") + 1).alias("shapley"),
    )


ORACLE = r"""
WITH t AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text,
                  regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
l AS (SELECT doc_id, max(CAST(quality = 1 AS INT)) AS good, max(CAST(toxic = 1 AS INT)) AS toxic FROM labels GROUP BY doc_id),
m AS (SELECT text, min(doc_id) AS first FROM t GROUP BY text),
d AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, [
    CAST(len(words) < 200 AS INT), CAST(100 * len(list_distinct(words)) < 50 * len(words) AS INT),
    CAST(100 * length(regexp_replace(t.text, '[^A-Z]', '', 'g')) > 3 * length(t.text) AS INT),
    CAST(regexp_matches(t.text, '[#$%&*|]') AS INT), CAST(coalesce(m.first < t.doc_id, FALSE) AS INT)] AS f
  FROM t JOIN m ON t.text = m.text LEFT JOIN l ON t.doc_id = l.doc_id),
g AS (SELECT part, f, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM d GROUP BY part, f),
i AS (SELECT unnest([1, 2, 3, 4, 5]) AS i),
o AS (SELECT [a.i, b.i, c.i, d.i, e.i] AS o FROM i a, i b, i c, i d, i e WHERE len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5),
s AS (SELECT array_to_string(list_transform(o, lambda x: 'ABCDE'[x]), '') AS filter_order, i AS step, o[i] AS x, o[:i - 1] AS before FROM o, i),
r AS (
  SELECT part, filter_order, step, x,
         sum(CASE WHEN f[x] = 0 AND list_sum(list_transform(before, lambda b: f[b])) IS DISTINCT FROM 0 AND len(before) > 0 THEN 0
                  WHEN f[x] = 0 THEN n ELSE 0 END) AS kept,
         sum(CASE WHEN f[x] = 1 AND coalesce(list_sum(list_transform(before, lambda b: f[b])), 0) = 0 THEN n ELSE 0 END) AS removed,
         sum(CASE WHEN f[x] = 1 AND coalesce(list_sum(list_transform(before, lambda b: f[b])), 0) > 0 THEN n ELSE 0 END) AS redundant,
         sum(CASE WHEN f[x] = 1 AND list_sum(f) = 1 THEN n ELSE 0 END) AS unique_fails,
         sum(CASE WHEN f[x] = 1 AND coalesce(list_sum(list_transform(before, lambda b: f[b])), 0) = 0 THEN good ELSE 0 END) AS good_lost,
         sum(CASE WHEN f[x] = 1 AND coalesce(list_sum(list_transform(before, lambda b: f[b])), 0) = 0 THEN toxic ELSE 0 END) AS toxic_lost
  FROM g, s GROUP BY ALL)
SELECT part, filter_order, CAST(step AS INT) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
       CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, x) AS BIGINT) AS shapley
FROM r
"""
