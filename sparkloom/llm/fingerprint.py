"""Document fingerprints by order MinHash.

A text's k-mers are numbered by occurrence. A hash of k-mer and number deals them over BINS bins and orders them; each
bin selects its TUPLE smallest, puts them back into text order and hashes the tuple. Moving or replacing text changes
which k-mers are selected or their order, so the share of equal bins falls with edit distance. One hash a k-mer serves
all bins, so the cost doesn't grow with the number of bins.

Defined results: a null text counts as empty; a text shorter than K is one k-mer; bins without k-mers are written as
dashes and, where both texts lack them, not compared; two texts without any k-mer are alike (1.0); equal texts have
equal fingerprints.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

K, BINS, TUPLE = 8, 64, 2
BIN_BITS = 6
#: Bits of a sort key that hold the position; longer texts are sorted by two keys.
POSITION_BITS = 24
LONGEST = 1 << POSITION_BITS
#: Selected k-mers a bin that a first pass expects; bins left short make it a full pass.
EXPECTED = 12

_A, _B, _C, _D = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93))
_32, _29 = np.uint64(32), np.uint64(29)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _32)) * _D
    x = (x ^ (x >> _29)) * _B
    return x ^ (x >> _32)


def kmer_hashes(text: str) -> np.ndarray:
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64) + np.uint64(1)
    if len(c) < K:
        h = np.uint64(len(c))
        with np.errstate(over="ignore"):
            for x in c:
                h = h * _A + x
        return _mixed(np.array([h], np.uint64)) if len(c) else np.zeros(0, np.uint64)
    c = c[:-1] * _A + c[1:]
    c = c[:-2] * _B + c[2:]
    return _mixed(c[:-4] * _C + c[4:])


def sketch(text: str | None) -> np.ndarray:
    """BINS numbers from 0 to 65535, -1 for a bin without k-mers."""
    h = kmer_hashes(text or "")
    n = len(h)
    out = np.full(BINS, -1, np.int32)
    if not n:
        return out
    low = np.uint64((1 << POSITION_BITS) - 1)
    if n <= LONGEST:
        key = np.sort((h & ~low) | np.arange(n, dtype=np.uint64))
        kmer, place = key & ~low, (key & low).astype(np.int64)
    else:
        kmer = h & ~low
        place = np.argsort(kmer, kind="stable")
        kmer = kmer[place]
    at = np.arange(n)
    first = np.maximum.accumulate(np.where(np.r_[True, kmer[1:] != kmer[:-1]], at, 0))
    order = _mixed(kmer + (at - first).astype(np.uint64) * _A)
    kept, bins = None, order >> np.uint64(64 - BIN_BITS)
    if n > 4 * EXPECTED * BINS:
        kept = np.flatnonzero((order << np.uint64(BIN_BITS)) < np.uint64(int(2**64 * (EXPECTED * BINS / n))))
        if np.bincount(bins[kept].astype(np.int64), minlength=BINS).min() < TUPLE:
            kept = None
    kept = at if kept is None else kept
    kept = kept[np.argsort(order[kept], kind="stable")]
    b = bins[kept].astype(np.int64)
    start = np.flatnonzero(np.r_[True, b[1:] != b[:-1]])
    second = np.minimum(start + 1, len(kept) - 1)
    paired = (second > start) & (b[second] == b[start])
    one, two = kept[start], kept[second]
    swap = paired & (place[two] < place[one])
    left, right = np.where(swap, two, one), np.where(swap, one, two)
    value = _mixed(kmer[left] * _A + np.where(paired, _mixed(kmer[right] + _C), np.uint64(0)))
    out[b[start]] = (value >> np.uint64(48)).astype(np.int32)
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of equal bins among those that either has."""
    some = (a >= 0) | (b >= 0)
    return float((a == b)[some].mean()) if some.any() else 1.0


def written(s: np.ndarray) -> str:
    return "".join("----" if x < 0 else f"{x:04x}" for x in s.tolist())


def fingerprints(docs: DataFrame, text: str = "text", out: str = "fingerprint") -> DataFrame:
    """docs without the text, with the fingerprint of each whole text. One narrow stage."""
    from .pii import _narrow
    from pyspark.sql import types as T

    return _narrow(docs, text, [T.StructField(out, T.StringType())], lambda t: (written(sketch(t)),), (text,))


def _above(key: Column, cuts: list[int], low: int, high: int, starts: list[int]) -> Column:
    """The number of cuts above a key, looked up in starts: a search that asks about log2 of them."""
    if low == high:
        return F.lit(starts[len(cuts) - low])
    mid = (low + high) // 2
    return F.when(key < cuts[mid], _above(key, cuts, low, mid, starts)).otherwise(_above(key, cuts, mid + 1, high, starts))


def edited_pairs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Each document's fingerprint beside those of its edited text and of the next document.

    Next is by descending id (rows without an id last; equal ids by a hash of their text), after the last the first.
    The texts are shuffled once, into ranges of ids (and, without an id, of the texts' hashes) that each also get the
    first row of the next range."""
    spark = docs.sparkSession
    slim = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    about = slim.agg(F.percentile_approx("doc_id", [i / parts for i in range(1, parts)] or [0.5], 10_000).alias("cuts"), F.count("*").alias("n"), F.count_if(F.col("doc_id").isNull()).alias("none")).first()
    raw = about.cuts or []
    # an id that several cuts fall on is dealt further by the hash of its texts, as rows without an id are
    heavy = {c: n + 1 for c, n in Counter(raw).items() if n > 1}
    cuts = sorted({*raw, *(h + 1 for h in heavy if h < (1 << 63) - 1)})
    wide = {len(cuts) - bisect_right(cuts, h): n for h, n in heavy.items()}
    starts = [0]
    for i in range(len(cuts) + 1):
        starts.append(starts[-1] + wide.get(i, 1))
    nameless = max(1, -(-about.none * parts // max(1, about.n)))  # ranges of rows without an id
    ranges = starts[-1] + nameless

    key, none = F.col("doc_id"), F.col("doc_id").isNull()
    hashed = F.when(none | key.isin(list(heavy)), F.xxhash64("text"))
    dealt_by = lambda n: F.least(F.floor((hashed / float(1 << 64) + 0.5) * n), F.lit(n - 1))
    named = _above(key, cuts, 0, len(cuts), starts)
    for h, n in heavy.items():
        named = F.when(key == h, starts[len(cuts) - bisect_right(cuts, h)] + dealt_by(n)).otherwise(named)
    slim = slim.withColumn("_b", F.when(none, dealt_by(nameless) + starts[-1]).otherwise(named).cast("int"))
    # the first row of each range: one row a range, whatever the data
    firsts = slim.groupBy(F.col("_b").alias("b")).agg(F.coalesce(F.min(hashed), F.max("doc_id")).alias("first")).orderBy("b").collect()
    first_of, back = [None] * ranges, [0] * ranges
    for i, row in enumerate(firsts):
        first_of[row.b], back[row.b] = row.first, firsts[i - 1].b
    first = F.element_at(F.array(*[F.lit(x).cast("long") for x in first_of]), F.col("_b") + 1)
    ahead = F.struct(F.element_at(F.array(*[F.lit(x) for x in back]), F.col("_b") + 1).alias("b"), F.lit(True).alias("ahead"))
    own = F.struct(F.col("_b").alias("b"), F.lit(False).alias("ahead"))
    dealt = slim.select("doc_id", "text", F.explode(F.when(F.coalesce(hashed, key) == first, F.array(own, ahead)).otherwise(F.array(own))).alias("to"))
    dealt = dealt.select("doc_id", "text", F.col("to.b").alias("b"), F.col("to.ahead").alias("ahead"))
    ordered = dealt.repartitionById(ranges, F.col("b")).sortWithinPartitions("b", "ahead", F.col("doc_id").desc_nulls_last(), F.xxhash64("text"))

    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = None  # the row whose next row has not come yet
        for batch in batches:
            rows = []
            for d, t, b, ahead in zip(*(batch.column(i).to_pylist() for i in range(4))):
                own = sketch(t)
                if before and before[2] == b and not before[3]:
                    d0, t0, _, _, own0 = before
                    half = len(t0) // 2
                    edited = t0[: len(t0) - half] + t[:half]
                    new = sketch(edited)
                    digest = hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest()
                    rows.append((d0, len(t0), digest, written(own0), written(new), likeness(own0, new), likeness(own0, own)))
                before = (d, t, b, ahead, own)
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(types)], names)

    return ordered.mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
