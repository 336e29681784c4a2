"""SimHash near-duplicates: fingerprints, links at up to three differing bits, and components.

Meet-in-the-middle ball hashing. The 64 bits form three blocks. Two fingerprints at three or fewer differing bits
either differ inside some block, and then at most two bits remain outside it, or are equal. So for each block every
distinct fingerprint emits, without that block's bits, all variants within half of that remaining radius: itself and
its one-bit flips, 131 in all. Linked fingerprints meet in at least one variant; the pairs that meet are verified.

A variant shared by two or three fingerprints gives its pairs at once. Where up to LISTED meet, a variant's holders are
one list; all of it is compared at once in numpy, and only edges that join its parts leave, fewer than it has members.
Where still more meet, no list is formed. Those fingerprints emit whole 64-bit variants, themselves and their one-bit
flips: all holders of a variant are within two bits of each other, 65 at most, and one star joins them. What is left
are links of exactly three bits between the components this gives; one end of each is outside the largest component.
Fingerprints outside it also emit their two-bit flips within a half (two of three differing bits share a half), which
meet the other end's one-bit flip. So nothing is lost, and lists are bounded whatever the data.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import checkpoint

BLOCKS = ((0, 22), (22, 43), (43, 64))
RADIUS = 3
#: Longest list of a variant's holders that is compared as a whole; beyond it another exact way takes over.
LISTED = 1024
#: Shingles whose bits are counted at a time.
COUNTED = 1 << 16
#: Fingerprints whose variants one task emits, about.
EMITTED = 1 << 15


def shingle_hashes(text: str | None, width: int = 3) -> np.ndarray:
    """XXH64 of each shingle of a whole text, repeats included; none without words."""
    words = (text or "").encode().lower().split()  # bytes: A-Z only; splits at space and 9 to 13
    joined = b" ".join(words)
    if not words:
        hashes = []
    elif len(words) <= width:
        hashes = [xxhash.xxh64_intdigest(joined, 42)]
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        starts = [0, *ends[:-width].tolist()]
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[a:b], 42) for a, b in zip(starts, (ends[width - 1 :] - 1).tolist())]
    return np.array(hashes, "<u8")


def majority(h: np.ndarray) -> int:
    """The bits set in over half of the hashes, as a signed 64-bit number."""
    counts = np.zeros(64, np.int64)
    for k in range(0, len(h), COUNTED):
        counts += np.unpackbits(h[k : k + COUNTED].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(h), bitorder="little").view("<i8")[0])


def simhash(text: str | None, width: int = 3) -> int:
    """The fingerprint of a whole text, as a signed 64-bit number; 0 without words."""
    return majority(shingle_hashes(text, width))


def fingerprints(docs: DataFrame, text: str = "text", width: int = 3, out: str = "fp") -> DataFrame:
    """docs without the text, with the fingerprint of each whole text in column out (long)."""
    kept = [f for f in docs.schema.fields if f.name not in (text, out)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(text))
            fps = pa.array([simhash(t.as_py(), width) for t in column], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(f.name)) for f in kept] + [fps], [f.name for f in kept] + [out])

    return docs.mapInArrow(run, T.StructType([*kept, T.StructField(out, T.LongType(), False)]))


def _bit(b: int) -> int:
    return (1 << b) - (1 << 64 if b == 63 else 0)


def _flips(entries: list[tuple]) -> F.Column:
    return F.array(*[F.struct(*[F.lit(v).cast(k).alias(n) for n, k, v in zip(("block", "keep", "flip"), ("byte", "long", "long"), e)]) for e in entries])


def _block_variants() -> list[tuple[int, int, int]]:
    out = []
    for j, (a, b) in enumerate(BLOCKS):
        gone = ((1 << b) - 1) ^ ((1 << a) - 1)
        keep = np.int64(np.uint64(0xFFFFFFFFFFFFFFFF ^ gone).astype(np.int64)).item()
        out += [(j, keep, 0)] + [(j, keep, _bit(i)) for i in range(64) if not a <= i < b]
    return out


def links(fps: DataFrame) -> DataFrame:
    """Distinct fingerprints (column fp) -> (a, b), a > b: enough of the links at RADIUS bits or less that their
    components are those of all such links. Every row is a verified link."""
    kinds = _flips(_block_variants())
    spread = fps.select("fp", F.explode(kinds).alias("k")).select("fp", F.col("k.block").alias("block"), F.col("fp").bitwiseAND(F.col("k.keep")).bitwiseXOR(F.col("k.flip")).alias("variant"))
    met = W.partitionBy("block", "variant")
    tier = F.when(F.col("n") <= 3, 0).when(F.col("n") <= LISTED, 1).otherwise(2)
    only = lambda k, c: F.when(F.col("tier") == k, F.col(c)).alias(c)
    met = checkpoint(
        spread.withColumns({"n": F.count("*").over(met), "low": F.min("fp").over(met), "high": F.max("fp").over(met)})
        .where("n > 1")
        .withColumn("tier", tier)
        .groupBy("fp", "tier", only(0, "low"), only(0, "high"), only(1, "block"), only(1, "variant"))
        .agg(F.lit(1).alias("_"))
    )
    few = met.where("tier = 0").select("fp", F.explode(F.array("low", "high")).alias("other"))
    lists = met.where("tier = 1").groupBy("block", "variant").agg(F.collect_list("fp").alias("all"))
    few = few.unionByName(lists.select("all").mapInArrow(_joined_lists, "fp long, other long"))
    crowd = met.where("tier = 2").select("fp").distinct()
    balls = few.limit(0) if crowd.isEmpty() else _crowd_links(checkpoint(crowd))
    both = few.unionByName(balls).where((F.col("fp") != F.col("other")) & (F.bit_count(F.col("fp").bitwiseXOR(F.col("other"))) <= RADIUS))
    return both.select(F.greatest("fp", "other").alias("a"), F.least("fp", "other").alias("b")).distinct()


def _joined_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lists of fingerprints -> edges (fp, other) that join what links join within each list."""
    for batch in batches:
        edges: list[tuple[int, int]] = []
        for row in batch.column(0):
            x = np.unique(row.values.to_numpy())
            near = np.bitwise_count((x[:, None] ^ x).view(np.uint64)) <= RADIUS
            left = np.ones(len(x), bool)
            while left.any():  # a search from each unreached member
                front = [int(np.flatnonzero(left)[0])]
                left[front[0]] = False
                while front:
                    i = front.pop()
                    new = np.flatnonzero(near[i] & left)
                    left[new] = False
                    edges += [(int(x[j]), int(x[i])) for j in new]
                    front += new.tolist()
        edges = list(dict.fromkeys(edges))
        yield pa.RecordBatch.from_arrays([pa.array([e[k] for e in edges], pa.int64()) for k in (0, 1)], ["fp", "other"])


def _crowd_links(crowd: DataFrame) -> DataFrame:
    """Distinct fingerprints -> (fp, other): stars that join all links among them."""
    near_kinds = _flips([(0, 0, 0)] + [(0, 0, _bit(b)) for b in range(64)])

    def spread(df: DataFrame, kinds: F.Column) -> DataFrame:
        return df.select("fp", F.explode(kinds).alias("k")).select("fp", F.col("fp").bitwiseXOR(F.col("k.flip")).alias("variant"))

    near = spread(crowd, near_kinds)
    held = near.groupBy("variant").agg(F.collect_list("fp").alias("all")).where(F.size("all") > 1)  # 65 holders at most
    stars = checkpoint(held.select(F.explode("all").alias("fp"), F.array_min("all").alias("other")).where("fp <> other").distinct())
    roots = components(stars.select(F.greatest("fp", "other").alias("a"), F.least("fp", "other").alias("b")))
    largest = roots.groupBy("root").count().orderBy(F.col("count").desc(), "root").first()  # one row
    if largest is None:
        outside = crowd
    else:
        inside = roots.where(F.col("root") == largest.root).select(F.col("node").alias("fp"))
        outside = crowd.join(inside, "fp", "left_anti").where(F.col("fp") != largest.root)
    far = spread(outside, _far()).select("variant", F.lit(None).cast("long").alias("near"), F.col("fp").alias("far"))
    met = near.select("variant", F.col("fp").alias("near"), F.lit(None).cast("long").alias("far")).unionByName(far)
    met = met.groupBy("variant").agg(F.min("near").alias("other"), F.collect_list("far").alias("all"))  # 992 at most
    return stars.unionByName(met.where(F.col("other").isNotNull() & (F.size("all") > 0)).select(F.explode("all").alias("fp"), "other"))


def _far() -> F.Column:
    """All two-bit flips within a half, 992, made from ranges."""
    def half(low: int, high: int) -> F.Column:
        one = lambda i, j: F.struct(F.lit(1).cast("byte").alias("block"), F.lit(0).cast("long").alias("keep"), _pair(i, j).alias("flip"))
        return F.flatten(F.transform(F.sequence(F.lit(low), F.lit(high - 1)), lambda i: F.transform(F.sequence(i + 1, F.lit(high)), lambda j: one(i, j))))

    return F.concat(half(0, 31), half(32, 63))


def _pair(i: F.Column, j: F.Column) -> F.Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), i).bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), j))


def components(edges: DataFrame, most_rounds: int = 100) -> DataFrame:
    """(a, b) long edges -> (node, root): the smallest node of each component, by alternating large and small stars.

    Every round is a pre-aggregated minimum and a join that can be split; rounds end when the edges stay the same."""
    def mark(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())

    edges = checkpoint(edges.select("a", "b").where("a <> b").distinct())
    seen = mark(edges)
    for _ in range(most_rounds):
        if not seen[0]:
            break
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = checkpoint(large)
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        small = small.where("b <> m").select(F.greatest("b", "m").alias("a"), F.least("b", "m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        edges = checkpoint(small.where("a <> b").distinct())
        now = mark(edges)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def group_of(fps: DataFrame, more: DataFrame | None = None) -> DataFrame:
    """Fingerprints (column fp, repeats allowed) -> (fp, root): the smallest fingerprint that links reach; more holds
    further links (a, b)."""
    each = checkpoint(fps.select("fp").distinct())
    parts = max(int(each.sparkSession.conf.get("spark.sql.shuffle.partitions")), each.count() // EMITTED)
    spread = each.repartition(parts)  # each row becomes 131
    edges = links(spread) if more is None else links(spread).unionByName(more)
    members = components(edges).select(F.col("node").alias("_node"), F.col("root").alias("_root"))
    return each.join(members, F.col("fp") == F.col("_node"), "left").select("fp", F.coalesce("_root", "fp").alias("root"))


def near_duplicates(docs: DataFrame, width: int = 3, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a document: doc_id, fp (long), component_id: the smallest doc_id that links reach, itself included.

    Defined results: a null or wordless text has fingerprint 0 and links like any other; equal texts and repeated rows
    share a fingerprint and so a component; rows without an id take part, but give no component_id unless no row of
    their component has an id; an empty table gives no rows. Copies are never paired: links join distinct fingerprints."""
    slim = checkpoint(fingerprints(docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("_text")), "_text", width))
    first = slim.groupBy("fp").agg(F.min("doc_id").alias("first"))
    rooted = checkpoint(group_of(slim.select("fp")).join(first, "fp"))
    named = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    # kept, so that the join below is of two plain shuffles, which can be split where a fingerprint is hot
    by_fp = checkpoint(rooted.join(named, "root").select(F.col("fp").alias("_fp"), "component_id"))
    return slim.join(by_fp, F.col("fp") == F.col("_fp")).select("doc_id", "fp", "component_id")


def hex_fingerprint(fp: F.Column) -> F.Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
