"""Links between texts whose word shingles have a Jaccard similarity of 0.8 or more, as graph edges of fingerprints.

SimHash balls end at three bits, and texts at a similarity of 0.8 differ in about ten, so the near-duplicate stage adds
these links. Equal shingle sets are one row. Its BANDS keys of ROWS minima each bring similar sets into one bucket (a
pair at 0.8 shares one with a chance of 0.997). The sets themselves decide each pair; they are read back for the sets
that share a bucket. A sketch, the SKETCH smallest hashes, only passes over pairs that it puts under CLEAR: with a
standard error of 0.025 at 0.8 that is twelve of them away.

A bucket is compared in parts of about `listed` rows, or HELD shingles if that is less, each with the bucket's smallest set added. In buckets of several
parts what is left are links between different parts; one end of each is outside the bucket's largest component, so only
the rows outside meet all rows again, block by block. No list grows with the data and no link between rows that share a
bucket is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import simhash
from .common import checkpoint

SIMILAR = 0.8
SKETCH = 256
#: Pairs whose sketches are less alike than this are not compared as sets.
CLEAR = 0.5
BANDS, ROWS = 20, 6
#: Rows of a bucket that are compared as one list.
LISTED = 512
#: Shingles of a bucket that are compared as one list.
HELD = 1 << 21
#: Shingles whose minima are taken at a time.
MIXED = 2048

_MIXERS = np.array([xxhash.xxh64_intdigest(str(i)) | 1 for i in range(BANDS * ROWS)], np.uint64)
_PAD = 1 << 32
_FEATURES = [T.StructField("fp", T.LongType(), False), T.StructField("set_id", T.LongType()), T.StructField("size", T.LongType()), T.StructField("keys", T.ArrayType(T.LongType(), False))]
_WHOLE = T.StructField("shingles", T.BinaryType())


def features(docs: DataFrame, width: int = 5, text: str = "text", whole: bool = True) -> DataFrame:
    """docs without the text, with its SimHash (fp), the id and size of its shingle set, its bucket keys and, if whole,
    the set.

    A null or wordless text has fingerprint 0 and nulls in the other columns."""
    kept = [f for f in docs.schema.fields if f.name != text]
    schema = T.StructType([*kept, *_FEATURES, *[_WHOLE] * whole])
    types = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), *[pa.binary()] * whole)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [_features(t.as_py(), width) for t in batch.column(batch.schema.get_field_index(text))]
            new = [pa.array([m[i] for m in made], t) for i, t in enumerate(types)]
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(f.name)) for f in kept] + new, schema.names)

    return docs.mapInArrow(run, schema)


def _features(text: str | None, width: int) -> tuple:
    h = simhash.shingle_hashes(text, width)
    if not len(h):
        return 0, None, None, None, None
    whole = np.unique(h)
    set_id, _, keys = sketch_of(whole)
    return simhash.majority(h), set_id, len(whole), keys, whole.tobytes()


def _shingles(rows: DataFrame, width: int) -> DataFrame:
    """Rows (set_id, text) -> (set_id, shingles)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [np.unique(simhash.shingle_hashes(t.as_py(), width)).tobytes() for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("set_id"), pa.array(sets, pa.binary())], ["set_id", "shingles"])

    return rows.select("set_id", "text").mapInArrow(run, "set_id long, shingles binary")


def sketch_of(h: np.ndarray) -> tuple[int, bytes, list[int]]:
    """Shingle hashes -> (id of their set, its smallest hashes, keys of its buckets)."""
    h = np.unique(h)
    least = np.full(BANDS * ROWS, (1 << 64) - 1, np.uint64)
    for k in range(0, len(h), MIXED):
        mixed = h[k : k + MIXED, None] * _MIXERS
        mixed ^= mixed >> np.uint64(32)
        np.minimum(least, mixed.min(0), out=least)
    bands = least.reshape(BANDS, ROWS)
    keys = [_signed(xxhash.xxh64_intdigest(bands[i].tobytes(), i)) for i in range(BANDS)]
    return _signed(xxhash.xxh64_intdigest(h.tobytes())), _smallest(h), keys


def _smallest(h: np.ndarray) -> bytes:
    return np.unique((h >> np.uint64(32)).astype("<u4"))[:SKETCH].tobytes()


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def likeness(x: np.ndarray, others: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Similarity of one sorted sketch to each row of others, which holds sizes[i] sorted values and then _PAD."""
    at = np.searchsorted(x, others)
    common = x[np.minimum(at, len(x) - 1)] == others
    rank = np.arange(others.shape[1]) + at - (np.cumsum(common, 1) - common)  # in the union
    least = np.minimum(SKETCH, len(x) + sizes - common.sum(1))
    return (common & (rank < least[:, None])).sum(1) / least


def _padded(sketches: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.array([len(s) // 4 for s in sketches])
    out = np.full((len(sketches), sizes.max()), _PAD, np.int64)
    for row, s in zip(out, sketches):
        row[: len(s) // 4] = np.frombuffer(s, "<u4")
    return out, sizes


def similar(x: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    """Whether the Jaccard similarity of one sorted set to each of others is SIMILAR or more."""
    n = np.array([len(o) for o in others], np.int64)
    if not len(n):
        return np.zeros(0, bool)
    every = np.concatenate(others)
    met = x[np.minimum(np.searchsorted(x, every), len(x) - 1)] == every
    common = np.add.reduceat(met, np.cumsum(n) - n, dtype=np.int64)
    return common / (len(x) + n - common) >= SIMILAR


def joined(fps: list[int], shingles: list[bytes]) -> list[tuple[int, int]]:
    """Edges (fp, other) that join what the links within one list join."""
    sets = [np.frombuffer(s, "<u8") for s in shingles]
    x, sizes = _padded([_smallest(s) for s in sets])
    left, edges = np.arange(len(fps)), []
    while len(left):  # a search from each unreached row
        front, left = [int(left[0])], left[1:]
        while front and len(left):
            i = front.pop()
            near = likeness(x[i, : sizes[i]], x[left], sizes[left]) >= CLEAR
            near[near] = similar(sets[i], [sets[j] for j in left[near]])
            reached, left = left[near], left[~near]
            edges += [(fps[j], fps[i]) for j in reached if fps[j] != fps[i]]
            front += reached.tolist()
    return edges


def _lists(members: DataFrame, sets: DataFrame, by: list[str]) -> DataFrame:
    """Rows (by, set_id) -> edges (fp, other) within each list, which a task reads as neighbouring rows."""
    rows = members.join(sets, "set_id").select(*by, "fp", "shingles")
    rows = rows.repartition(*by).sortWithinPartitions(*by)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, fps, sets = None, [], []
        for batch in batches:
            edges: list[tuple[int, int]] = []
            *keys, fp, whole = (c.to_pylist() for c in batch.columns)
            for k, f, s in zip(zip(*keys), fp, whole):
                if k != key:
                    edges += joined(fps, sets) if len(fps) > 1 else []
                    key, fps, sets = k, [], []
                fps.append(f)
                sets.append(s)
            yield _batch(edges)
        yield _batch(joined(fps, sets) if len(fps) > 1 else [])

    return rows.mapInArrow(run, "fp long, other long").distinct()


def _batch(edges: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([e[k] for e in edges], pa.int64()) for k in (0, 1)], ["fp", "other"])


def links(seen: DataFrame, listed: int = LISTED, rows: DataFrame | None = None, width: int = 5) -> DataFrame:
    """features() -> (a, b), a > b: fingerprints to join, so that texts at SIMILAR or more meet in one component.

    rows: _key and text of the rows of seen, if that has _key in place of whole sets; the sets are then made again for
    the texts that share a bucket."""
    some = [F.min("_key").alias("_key")] if rows is not None else []
    texts = checkpoint(seen.where("set_id is not null").groupBy("set_id").agg(F.min("fp").alias("fp"), F.first("size").alias("size"), F.first("keys").alias("keys"), *some))
    equal = seen.select("set_id", "fp").distinct().join(texts.select("set_id", F.col("fp").alias("other")), "set_id").select("fp", "other")
    held = texts.select("set_id", "size", F.posexplode("keys").alias("band", "key"))
    buckets = held.groupBy("band", "key").agg(F.count("*").alias("n"), F.sum("size").alias("held"), F.min("set_id").alias("star")).where("n > 1")
    buckets = checkpoint(buckets.withColumn("parts", F.ceil(F.greatest(F.col("n") / listed, F.col("held") / HELD))))
    members = checkpoint(held.join(buckets, ["band", "key"]).select("band", "key", "n", "held", "size", "parts", "set_id", F.pmod(F.xxhash64("set_id"), "parts").alias("part")))
    stars = buckets.where("parts > 1").select("band", "key", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), F.col("star").alias("set_id"))
    lists = members.select("band", "key", "part", "set_id").unionByName(stars)
    wanted = members.select("set_id").distinct()
    if rows is None:
        whole = seen.groupBy("set_id").agg(F.first("shingles").alias("shingles")).join(wanted, "set_id", "left_semi")
    else:
        whole = _shingles(rows.join(texts.join(wanted, "set_id", "left_semi").select("set_id", "_key"), "_key"), width).dropDuplicates(["set_id"])
    sets = checkpoint(whole.join(texts.select("set_id", "fp"), "set_id"))
    edges = _ordered(_lists(lists, sets, ["band", "key", "part"]).unionByName(equal))
    crowd = members.where("parts > 1")
    if crowd.isEmpty():
        return edges
    edges = checkpoint(edges)
    return edges.unionByName(_ordered(_crowd(checkpoint(crowd), texts, sets, edges, listed))).distinct()


def _ordered(edges: DataFrame) -> DataFrame:
    return edges.where("fp <> other").select(F.greatest("fp", "other").alias("a"), F.least("fp", "other").alias("b")).distinct()


def _crowd(crowd: DataFrame, texts: DataFrame, sets: DataFrame, edges: DataFrame, listed: int) -> DataFrame:
    """Links between different parts of a bucket: rows outside its largest component against all of its rows."""
    bucket, block = ["band", "key"], max(1, listed // 2)
    roots = simhash.components(edges).select(F.col("node").alias("fp"), "root")
    rooted = crowd.join(texts.select("set_id", "fp"), "set_id").join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    rooted = checkpoint(rooted.select(*bucket, "n", "held", "size", "set_id", "root"))
    sizes = rooted.groupBy(*bucket, "root").agg(F.count("*").alias("n_root"), F.sum("size").alias("held_root"))
    most = F.max(F.struct("n_root", "root", "held_root"))
    largest = sizes.groupBy(*bucket).agg(most["root"].alias("largest"), (F.sum("n_root") - most["n_root"]).alias("n_out"), (F.sum("held_root") - most["held_root"]).alias("held_out")).where("n_out > 0")
    rows = rooted.join(largest, bucket)
    in_blocks = lambda n, held: F.ceil(F.greatest(F.col(n) / block, F.col(held) * 2 / HELD))
    rows = rows.withColumns({"blocks": in_blocks("n", "held"), "blocks_out": in_blocks("n_out", "held_out")})
    at = lambda n: F.pmod(F.xxhash64("set_id"), n)
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    outside = rows.where("root <> largest").select(*bucket, "set_id", at("blocks_out").alias("i"), every("blocks").alias("j"))
    whole = rows.select(*bucket, "set_id", at("blocks").alias("j"), every("blocks_out").alias("i"))
    return _lists(outside.unionByName(whole).distinct(), sets, [*bucket, "i", "j"])
