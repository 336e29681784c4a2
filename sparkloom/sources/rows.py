"""Row-addressed and fixed-record sources, local snapshots of data sets, and digests of what they hold."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from sparkloom.operators.relational import point_in_interval
from sparkloom.operators.running import running_totals
from sparkloom.staging import checkpoint

from .files import list_files
from .ranges import listed, located
from .records import read_records

# Which files of a snapshot hold rows, in order, and the size below which a file is only metadata.
SNAPSHOT = (r"^/[^/]*\.jsonl$", r"^/[^/]*\.jsonl\.gz$", r"^/data/[^/]*\.jsonl$", r"^/data/[^/]*\.jsonl\.gz$", r"/[^/]*dataset[^/]*\.jsonl$")
LEAST_BYTES = 1024
#: A line with something in it.
NOT_BLANK = r"(?U)[^\s\x1c-\x1f]"
#: Most blocks, in rows of about 100 bytes, that are sent to every executor; more are joined by shuffle.
BROADCAST_BLOCKS = 500_000


def snapshot_files(spark: SparkSession, root: str) -> DataFrame:
    """(path, size, priority) of a snapshot's row files: those at its top, in data/, or with dataset in their name."""
    listed = list_files(spark, root, least=LEAST_BYTES)
    base = "/" + root.split("://")[-1].strip("/")
    below = F.substr(F.regexp_replace("path", r"^[a-z0-9]+:/+", "/"), F.lit(len(base) + 1))
    hits = [F.when(below.rlike(p), i) for i, p in enumerate(SNAPSHOT)]
    return listed.withColumn("priority", F.coalesce(*hits)).where("priority is not null")


def read_snapshot(spark: SparkSession, root: str, schema: str) -> DataFrame:
    """Rows of a snapshot's JSON lines; bad JSON raises. The driver holds the list of files, not their rows."""
    paths = [r.path for r in snapshot_files(spark, root).orderBy("priority", "path").collect()]
    if not paths:
        raise FileNotFoundError(f"no JSON lines below {root}")
    return spark.read.schema(schema).option("mode", "FAILFAST").json(paths)


def union_configs(scans: dict[str, DataFrame], skip: tuple[str, ...] = ()) -> DataFrame:
    """Scans of a source's configurations, in the order of their names, with the name in column config."""
    each = [scans[n].withColumn("config", F.lit(n)) for n in sorted(scans) if n not in skip]
    if not each:
        raise ValueError("no configuration is left")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), each)


def parquet_rows(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Some columns with row: the row's index in its file. Other columns aren't read."""
    return spark.read.parquet(path).select(F.col("_metadata.row_index").alias("row"), *columns)


def _blocks(lines: DataFrame, sums: dict[str, Column]) -> DataFrame:
    """lines with first_<name>: the sum over the blocks of the file before a line's own. A block is what one split reads,
    from the place that the reader says; a row a block is summed."""
    before = W.partitionBy("_f").orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    each = lines.groupBy(F.col("file").alias("_f"), F.col("_block").alias("_b")).agg(F.min("_at").alias("_least"), *[F.sum(v).alias(f"_{n}") for n, v in sums.items()])
    each = checkpoint(each.withColumns({f"first_{n}": F.coalesce(F.sum(f"_{n}").over(before), F.lit(0)) for n in sums}).drop(*[f"_{n}" for n in sums]))
    each = F.broadcast(each) if each.count() <= BROADCAST_BLOCKS else each
    both = lines.join(each, (F.col("file") == F.col("_f")) & (F.col("_block") == F.col("_b")), "left")
    # both passes must read the same splits; settings changed between them would part the files anew
    anew = F.raise_error(F.lit("the files were split anew while being read"))
    return both.withColumns({f"first_{n}": F.coalesce(f"first_{n}", anew) for n in sums})


def _block_lines(spark: SparkSession, paths: str | list[str], ends: str | None, blank: bool) -> DataFrame:
    """(value, file, _block, _at): lines with the split that reads them, and a number that rises by one within it."""
    reader = spark.read if ends is None else spark.read.option("lineSep", ends)
    df = reader.text(paths).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_block"))
    return (df if blank else df.where(F.col("value").rlike(NOT_BLANK))).withColumn("_at", F.monotonically_increasing_id())


def indexed_lines(spark: SparkSession, paths: str | list[str], blank: bool = False) -> DataFrame:
    """(file, row, value): lines, those that aren't blank unless blank is set, with their index in the file.

    Two passes: the lines of each split are counted, and then numbered from where the splits before it end. Nothing but
    the counts is shuffled, and files of any size are read by many tasks."""
    lines = _blocks(_block_lines(spark, paths, None, blank), {"n": F.lit(1)})
    return lines.select("file", (F.col("first_n") + F.col("_at") - F.col("_least")).cast("long").alias("row"), "value")


def line_offsets(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(file, row, offset): where each line of files of lines (parted by newlines, not compressed) begins, in bytes."""
    lines = _block_lines(spark, paths, "\n", True).select("file", "_block", "_at", (F.octet_length("value") + 1).cast("long").alias("_size"))
    lines = _blocks(lines, {"n": F.lit(1), "bytes": F.col("_size")})
    inside = F.sum("_size").over(W.partitionBy("file", "_block").orderBy("_at")) - F.col("_size")  # a split at a time
    return lines.select("file", (F.col("first_n") + F.col("_at") - F.col("_least")).cast("long").alias("row"), (F.col("first_bytes") + inside).cast("long").alias("offset"))


def line_rows(spark: SparkSession, paths: str | list[str], schema: str) -> DataFrame:
    """JSON lines with row: the index among a file's lines that aren't blank."""
    lines = indexed_lines(spark, paths)
    return lines.select("file", "row", F.from_json("value", schema, {"mode": "FAILFAST"}).alias("r")).select("file", "row", "r.*")


def row_groups(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(path, group, start, end): the rows of each row group of Parquet files, by their footers."""
    def footers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                store, at = located(path)
                meta = pq.read_metadata(at, filesystem=store)
                n = np.array([meta.row_group(i).num_rows for i in range(meta.num_row_groups)], np.int64)
                end = np.cumsum(n)
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(n)), pa.array(np.arange(len(n))), pa.array(end - n), pa.array(end)], ["path", "group", "start", "end"])

    files = [(p,) for p, _ in listed(paths)]
    return spark.createDataFrame(files, "path string").repartition(max(1, min(len(files), 1000))).mapInArrow(footers, "path string, group long, start long, end long")


def rows_at(spark: SparkSession, paths: str | list[str], wanted: DataFrame, columns: list[str], row: str = "row") -> DataFrame:
    """Rows of Parquet files by index: wanted (row, and path if rows are counted in each file, not through all files in
    order of their paths) -> path, row, group and some columns. Only the row groups that hold a wanted row are read, each
    by one task, and of them only the columns. An index past the end raises."""
    paths = [paths] if isinstance(paths, str) else paths
    groups = checkpoint(row_groups(spark, paths))
    by = ["path"]
    own = wanted.select(*(by if "path" in wanted.columns else []), F.col(row).cast("long").alias("row")).distinct()
    if "path" not in wanted.columns:
        own, groups = own.withColumn("all", F.lit(True)), groups.withColumn("_n", F.col("end") - F.col("start"))
        groups = running_totals(groups, {"end": F.col("_n")}, ["path", "group"]).withColumns({"start": F.col("end") - F.col("_n"), "all": F.lit(True)}).drop("_n")
        by = ["all"]
    widest = groups.agg(F.max(F.col("end") - F.col("start"))).first()[0] or 1
    placed = point_in_interval(own, groups, by[0], "row", int(widest))
    placed = checkpoint(placed.select("path", "group", "row", (F.col("row") - F.col("start")).alias("at")))
    lost = own.join(placed, "row" if by == ["all"] else ["path", "row"], "left_anti").limit(1).collect()
    if lost:
        raise IndexError(f"row {lost[0].row} is past the end")
    schema = T.StructType([T.StructField("path", T.StringType()), T.StructField("row", T.LongType()), T.StructField("group", T.LongType()), *spark.read.parquet(*paths).select(*columns).schema.fields])
    arrow = to_arrow_schema(schema)

    def read(rows: pa.Table) -> pa.Table:
        path, group = (rows.column(c)[0].as_py() for c in ("path", "group"))
        store, at = located(path)
        held = pq.ParquetFile(store.open_input_file(at)).read_row_group(group, columns=columns).select(columns)
        held = held.take(rows.column("at"))
        same = [rows.column(c) for c in ("path", "row", "group")]
        return pa.table([*same, *held.columns], names=schema.names).cast(arrow)

    return placed.groupBy("path", "group").applyInArrow(read, schema)


def take_rows(rows: DataFrame, wanted: DataFrame, key: str = "row") -> DataFrame:
    """The wanted rows by index; an index past the end raises."""
    lost = wanted.join(rows, key, "left_anti").select(key).limit(1).collect()
    if lost:
        raise IndexError(f"row {lost[0][0]} is past the end")
    return rows.join(wanted.select(key).distinct(), key)


def read_range(shards: DataFrame, start: int, end: int, *by: str) -> DataFrame:
    """(by, ord, first, tokens) shards of streams -> (by, ord, tokens): what lies between two token positions."""
    stop = F.col("first") + F.size("tokens")
    lo = F.greatest(F.lit(start), F.col("first"))
    part = F.slice("tokens", (lo - F.col("first") + 1).cast("int"), (F.least(F.lit(end), stop) - lo).cast("int"))
    return shards.where((F.col("first") < end) & (stop > start)).select(*by, "ord", part.alias("tokens"))


def read_float_table(spark: SparkSession, paths: str | list[str], width: int, **options) -> DataFrame:
    """(path, row, scores) of headerless little-endian float32 files of fixed records; other sizes raise. A file is read by
    many tasks."""
    return read_records(spark, paths, "<f4", width, **options).select("path", F.col("record").alias("row"), F.col("numbers").alias("scores"))


def chunk_digests(scores: DataFrame, size: int, key: str, value: str) -> DataFrame:
    """(chunk, n, finite, sha256) of arrays in runs of size consecutive keys: of their float32 bytes in key order. A
    chunk that isn't all finite must be scored again; a finished one is known by its digest."""
    def pack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            arrays = [np.asarray(v, "<f4") for v in f["v"]]
            yield pd.DataFrame({"k": f.k, "raw": [a.tobytes() for a in arrays], "finite": [bool(np.isfinite(a).all()) for a in arrays]})

    raw = scores.select(F.col(key).cast("long").alias("k"), F.col(value).cast("array<float>").alias("v")).mapInPandas(pack, "k long, raw binary, finite boolean")
    joined = F.concat_ws("", F.transform(F.array_sort(F.collect_list(F.struct("k", F.hex("raw").alias("h")))), lambda r: r.h))
    g = raw.groupBy(F.floor(F.col("k") / size).alias("chunk")).agg(F.count("*").alias("n"), F.bool_and("finite").alias("finite"), joined.alias("all"))
    return g.select("chunk", "n", "finite", F.sha2(F.unhex("all"), 256).alias("sha256"))


def crc_mismatches(built: DataFrame, declared: DataFrame, by: str, key: str) -> DataFrame:
    """Documents whose count or checksum differs from the declared one: number and first of each group."""
    both = built.join(declared.select(by, key, F.col("n").alias("_n"), F.col("crc").alias("_crc")), [by, key], "full_outer")
    bad = ~F.col("n").eqNullSafe(F.col("_n")) | ~F.col("crc").eqNullSafe(F.col("_crc"))
    return both.where(bad).groupBy(by).agg(F.min(key).alias("first_bad"), F.count("*").alias("n_bad"))


def layout_differences(predicted: DataFrame, actual: DataFrame) -> DataFrame:
    """Rows that only one layout has; repeats count."""
    a = predicted.exceptAll(actual).withColumn("side", F.lit("predicted"))
    return a.unionByName(actual.exceptAll(predicted).withColumn("side", F.lit("actual")))


def pinned(markers: DataFrame, expected: dict[str, str]) -> DataFrame:
    """(name, value) markers that conflict with each other, are missing, or differ from the expected ones."""
    want = markers.sparkSession.createDataFrame(sorted(expected.items()), "name string, expected string")
    found = markers.groupBy("name").agg(F.min("value").alias("low"), F.max("value").alias("high"))
    kind = F.when(F.col("low").isNull(), "missing").when(F.col("low") != F.col("high"), "conflict").when(F.col("low") != F.col("expected"), "differs")
    return want.join(found, "name", "left").withColumn("kind", kind).where("kind is not null").select("name", "kind")


def index_summary(keys: DataFrame, key: str, item: str, text: Column) -> DataFrame:
    """One row on an item index: keys, keys of several items, and the bytes of the texts."""
    g = keys.groupBy(key).agg(F.countDistinct(item).alias("items"), F.first(F.octet_length(text)).alias("bytes"))
    return g.agg(F.count("*").alias("n_keys"), F.count_if(F.col("items") > 1).alias("n_shared"), F.sum("bytes").cast("long").alias("bytes"))
