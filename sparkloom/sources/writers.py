"""Writers that can be run again: splits, capped pieces, marked results, atomic files, retention."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from pathlib import PurePosixPath

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from py4j.protocol import Py4JJavaError
from pyarrow.fs import FileType
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.operators.gates import require
from sparkloom.operators.running import running_totals

from sparkloom.staging import checkpoint

from .files import write_docs
from .ranges import located
from .rows import indexed_lines

#: The file that says a result is whole, and the one that says how far a table is.
DONE, PROGRESS = "DONE.json", "progress.json"


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def read_json(spark: SparkSession, path: str) -> dict | None:
    fs, p = _fs(spark, path)
    if not fs.exists(p):
        return None
    stream = fs.open(p)
    try:
        return json.loads(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def write_json(spark: SparkSession, path: str, what: dict) -> None:
    """Replaces a small JSON file whole: readers see the old one or the new one."""
    fs, p = _fs(spark, path)
    draft = _fs(spark, f"{PurePosixPath(path).parent if '://' not in path else path.rsplit('/', 1)[0]}/.{uuid.uuid4().hex}.tmp")[1]
    out = fs.create(draft, False)
    out.write(bytearray(json.dumps(what, sort_keys=True).encode()))
    out.hsync()
    out.close()
    jvm = spark.sparkContext._jvm
    kind = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    how = spark.sparkContext._gateway.new_array(kind, 1)
    how[0] = kind.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(draft, p, how)


def create_json(spark: SparkSession, path: str, what: dict) -> bool:
    """Makes a small JSON file whole unless there is one; whether it did."""
    fs, p = _fs(spark, path)
    fs.mkdirs(p.getParent())
    draft = _fs(spark, f"{p.getParent().toString()}/.{uuid.uuid4().hex}.tmp")[1]
    out = fs.create(draft, False)
    out.write(bytearray(json.dumps(what, sort_keys=True).encode()))
    out.hsync()
    out.close()
    jvm = spark.sparkContext._jvm
    kind = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    how = spark.sparkContext._gateway.new_array(kind, 1)
    how[0] = kind.NONE  # fails where the file is there
    try:
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(draft, p, how)
        return True
    except Py4JJavaError:
        fs.delete(draft, False)
        if not fs.exists(p):
            raise
        return False


def write_splits(docs: DataFrame, path: str, by: tuple[str, ...] = ("source", "domain", "split")) -> None:
    """A folder for each source, domain and split, in place of what was there."""
    write_docs(docs, path, list(by), mode="overwrite")


def concatenated(spark: SparkSession, paths: list[str], out: str) -> int:
    """Shards' lines as one file of lines, <out>/lines.txt, blank ones left out, shards in order of their names; how many
    lines there are. Many tasks write pieces of it; the file system then joins the pieces, so no task writes all."""
    lines = indexed_lines(spark, paths)
    written = lines.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), "file", "row").sortWithinPartitions("file", "row")
    written.select("value").write.mode("overwrite").text(f"{out}/pieces")
    fs, folder = _fs(spark, f"{out}/pieces")
    names = sorted(s.getPath().toString() for s in fs.listStatus(folder) if s.getPath().getName().startswith("part-"))
    target = _fs(spark, f"{out}/lines.txt")[1]
    draft = _fs(spark, f"{out}/.{uuid.uuid4().hex}")[1]
    join_files(spark, names, draft.toString())
    fs.delete(target, False)
    fs.rename(draft, target)
    fs.delete(folder, True)
    return spark.read.text(f"{out}/lines.txt").count()


def join_files(spark: SparkSession, names: list[str], out: str) -> None:
    """One file of others' bytes, in order: by the file system where it can join files, else by copying them."""
    fs, target = _fs(spark, out)
    jvm = spark.sparkContext._jvm
    stream = fs.create(target, True)
    if fs.getScheme() == "hdfs":
        stream.close()
        paths = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Path, len(names))
        for i, n in enumerate(names):
            paths[i] = _fs(spark, n)[1]
        fs.concat(target, paths)
        return
    try:
        for n in names:
            source = fs.open(_fs(spark, n)[1])
            jvm.org.apache.hadoop.io.IOUtils.copyBytes(source, stream, 1 << 20, False)
            source.close()
    finally:
        stream.close()


def write_raw(df: DataFrame, path: str, piece: str, order: str, raw: str = "raw", frame: tuple[bytes, bytes, bytes] = (b"", b"", b"")) -> DataFrame:
    """Binary values as headerless files: one for each piece, piece-<n>.bin, in order; (piece, path, bytes) of each. frame:
    what stands before a file's values, between two and after them.

    A piece is streamed by one task, row by row, to a draft that is renamed once it is whole, so a task that runs again
    replaces what it left."""
    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, done = None, []
        for batch in batches:
            for k, value in zip(batch.column(piece).to_pylist(), batch.column(raw).to_pylist()):
                if held is None or held[0] != k:
                    done += _close(held)
                    store, at = located(f"{path}/piece-{k}.bin")
                    store.create_dir(at.rsplit("/", 1)[0], recursive=True)
                    draft = f"{at.rsplit('/', 1)[0]}/.{uuid.uuid4().hex}"
                    held = [k, store, draft, at, store.open_output_stream(draft), 0]
                for part in (frame[1] if held[5] else frame[0], value):
                    held[4].write(part)
                    held[5] += len(part)
        done += _close(held)
        yield pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], k) for i, k in enumerate((pa.int64(), pa.string(), pa.int64()))], ["piece", "path", "bytes"])

    def _close(held: list | None) -> list[tuple]:
        if held is None:
            return []
        k, store, draft, at, stream, n = held
        stream.write(frame[2])
        stream.close()
        store.move(draft, at)
        return [(k, f"{path}/piece-{k}.bin", n + len(frame[2]))]

    rows = df.select(F.col(piece).cast("long").alias(piece), order, raw).repartition(piece).sortWithinPartitions(piece, order)
    return checkpoint(rows.mapInArrow(put, "piece long, path string, bytes long"))


def capped_pieces(df: DataFrame, size: Column, cap: int, order: str) -> DataFrame:
    """df with the piece of about `cap` bytes that each row goes to, in order: the piece its first byte falls into."""
    d = running_totals(df, {"_end": size}, [order])
    return d.withColumn("piece", F.floor((F.col("_end") - size) / cap).cast("long")).drop("_end")


def write_pieces(df: DataFrame, path: str, order: str) -> DataFrame:
    """Writes the pieces that aren't there yet, pieces/piece-<n>.parquet each, rows in order, and a mark, <n>.DONE.json, when
    a piece is whole; (piece) of those written.

    Tasks look for the marks, write and mark, a piece in one task, row by row; so the driver does nothing for each piece.
    A draft is renamed once it is whole: pieces cut short before are replaced, whole ones aren't touched."""
    columns = [c for c in df.columns if c != "piece"]

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = located(path)
        piece, file, draft, done = None, None, "", []

        def close() -> None:
            if file is None:
                return
            file.close()
            store.move(draft, f"{root}/pieces/piece-{piece}.parquet")
            mark = f"{root}/.{uuid.uuid4().hex}"
            with store.open_output_stream(mark) as out:
                out.write(json.dumps({"piece": piece}).encode())
            store.move(mark, f"{root}/{piece}.{DONE}")
            done.append(piece)

        for batch in batches:
            held = batch.column("piece").to_numpy(zero_copy_only=False)
            starts = [0, *(np.flatnonzero(np.diff(held)) + 1).tolist()] if len(held) else []
            rows = batch.select(columns)
            for i, n in zip(starts, [*starts[1:], len(held)]):
                if piece != int(held[i]):
                    close()
                    piece, file = int(held[i]), None
                    if store.get_file_info(f"{root}/{piece}.{DONE}").type == FileType.NotFound:
                        draft = f"{root}/pieces/.{uuid.uuid4().hex}"
                        file = pq.ParquetWriter(draft, rows.schema, filesystem=store)
                if file is not None:
                    file.write_batch(rows.slice(i, n - i))
        close()
        yield pa.RecordBatch.from_arrays([pa.array(done, pa.int64())], ["piece"])

    fs, folder = _fs(df.sparkSession, f"{path}/pieces")
    fs.mkdirs(folder)
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = df.repartition(parts, "piece").sortWithinPartitions("piece", order)
    return checkpoint(rows.mapInArrow(put, "piece long"))


def read_pieces(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of the pieces that write_pieces has written, with the piece of each."""
    piece = F.regexp_extract("_metadata.file_name", r"^piece-(\d+)\.parquet$", 1).cast("long")
    return spark.read.schema(schema).parquet(f"{path}/pieces").select("*", piece.alias("piece"))


def write_with_mark(df: DataFrame, path: str, metrics: dict[str, Column]) -> dict:
    """Gzipped JSON lines and, once they are whole, a file of their metrics that says so."""
    spark = df.sparkSession
    fs, mark = _fs(spark, f"{path}/{DONE}")
    fs.delete(mark, False)
    df.write.mode("overwrite").json(f"{path}/rows", compression="gzip")
    found = spark.read.schema(df.schema).json(f"{path}/rows").agg(*[v.alias(k) for k, v in metrics.items()]).first().asDict()
    write_json(spark, f"{path}/{DONE}", found)
    return found


def read_marked(spark: SparkSession, path: str, schema) -> DataFrame:
    """Rows of a result that is marked whole; another raises."""
    if not exists(spark, f"{path}/{DONE}"):
        raise FileNotFoundError(f"{path} isn't finished")
    return spark.read.schema(schema).option("mode", "FAILFAST").json(f"{path}/rows")


def unfinished_chunks(spark: SparkSession, path: str, chunks: DataFrame, binding: dict[str, str]) -> DataFrame:
    """Chunks (column chunk) of a table that aren't done; a table begun for something else raises."""
    state = read_json(spark, f"{path}/{PROGRESS}")
    if state is None:
        write_json(spark, f"{path}/{PROGRESS}", {"binding": binding})
    elif changed := sorted(k for k in {**binding, **state["binding"]} if binding.get(k) != state["binding"].get(k)):
        raise ValueError(f"the table was begun with other {', '.join(changed)}")
    if not exists(spark, f"{path}/chunks"):
        return chunks
    return chunks.join(spark.read.parquet(f"{path}/chunks").select("chunk"), "chunk", "left_anti")


def finish_chunks(done: DataFrame, path: str) -> None:
    """Adds chunks (chunk, sha256) to those done."""
    done.select("chunk", "sha256").write.mode("append").parquet(f"{path}/chunks")


def staged(listing: DataFrame, root: str, *by: str, name: Column) -> DataFrame:
    """(path) -> where each file goes below root: a folder for each of by. Two files for one place raise."""
    d = listing.withColumn("staged", F.concat_ws("/", F.lit(root), *[F.col(b) for b in by], name))
    require(d.groupBy("staged").agg(F.count("*").alias("n")).where("n > 1"), "files that go to one place")
    return d


def latest_checkpoint(candidates: DataFrame, *by: str) -> DataFrame:
    """candidates (by, step, phase, path, whole) -> the newest whole one: at one step a normal one, then post, then pre."""
    rank = F.when(F.col("phase") == "post", 1).when(F.col("phase") == "pre", 0).otherwise(2)
    return candidates.where("whole").groupBy(*by).agg(F.max_by(F.struct("step", "phase", "path"), F.struct("step", rank, "path")).alias("c")).select(*by, "c.*")


def superseded(candidates: DataFrame, durable: DataFrame, *by: str) -> DataFrame:
    """Checkpoints that a durable one replaces: normal ones before its step, those of a phase up to it. Newer ones stay.
    durable: by, durable_step; it must itself be whole, or this raises."""
    here = candidates.where("whole and phase is null").select(*by, F.col("step").alias("durable_step"))
    require(durable.join(here, [*by, "durable_step"], "left_anti"), "durable checkpoints that aren't whole")
    d = candidates.join(durable, list(by))
    old = (F.col("phase").isNull() & (F.col("step") < F.col("durable_step"))) | (F.col("phase").isNotNull() & (F.col("step") <= F.col("durable_step")))
    return d.where(old).select(*candidates.columns)
