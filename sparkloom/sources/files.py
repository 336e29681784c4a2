"""Readers and writers of corpus files. Schemas are always given; codecs follow the file's extension."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DOC = "id string, text string, source string, metadata struct<domain:string>"
EOS = 100257  # fixed value: the token after every document
DOCS_PER_SHARD = 10_000
CHUNK_TOKENS = 2048  # fixed value: tokens of an instance


def read_docs(spark: SparkSession, paths: str | list[str], schema: str = DOC, malformed: str = "raise") -> DataFrame:
    """JSON lines with a text. malformed: raise, or skip such lines. Documents without text are left out."""
    mode = {"raise": "FAILFAST", "skip": "DROPMALFORMED"}[malformed]
    return spark.read.schema(schema).option("mode", mode).json(paths).where(F.trim("text") != "")


def read_lines(spark: SparkSession, path: str | list[str], lossy: bool = False) -> DataFrame:
    """Lines of text files; lossy: invalid UTF-8 becomes U+FFFD."""
    df = spark.read.text(path)
    return df.select(F.make_valid_utf8("value").alias("value")) if lossy else df


def read_rows_with_reason(spark: SparkSession, path: str) -> DataFrame:
    """(value, text, reason): reason is blank, badjson or notext for the lines that give no document."""
    v = F.try_parse_json("value")
    text = F.try_variant_get(v, "$.text", "string")
    reason = F.when(F.trim("value") == "", "blank").when(v.isNull(), "badjson").when(F.coalesce(text, F.lit("")) == "", "notext")
    return spark.read.text(path).select("value", text.alias("text"), reason.alias("reason"))


def read_json_array(spark: SparkSession, path: str | list[str], schema: str) -> DataFrame:
    """Rows of files that are one JSON array each; a file is read by many tasks."""
    from .arrays import parsed, read_array

    return parsed(read_array(spark, path), schema).drop("path", "row")


def read_manifest(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("sep", "\t").option("header", True).option("enforceSchema", False).option("mode", "FAILFAST").csv(path)


def list_files(spark: SparkSession, root: str, pattern: str | None = None, least: int = 0) -> DataFrame:
    """(path, size) of files below root; contents aren't read."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", F.col("length").alias("size"))
    df = df.where(F.col("size") >= least)
    return df.where(F.col("path").rlike(pattern)) if pattern else df


def read_tokens(spark: SparkSession, paths: str | list[str], width: int = CHUNK_TOKENS, tail: str = "keep", **options) -> DataFrame:
    """(path, chunk, tokens) of headerless little-endian uint32 files, in chunks of width tokens; tail: keep a file's shorter
    last chunk, drop it or raise. A size that isn't whole tokens raises. A file is read by many tasks."""
    from .records import read_records

    return read_records(spark, paths, "<u4", width, tail, **options).select("path", F.col("record").alias("chunk"), F.col("numbers").alias("tokens"))


def read_curves(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines (step, task_loss_bpb map) -> (path, step, label, bpb)."""
    df = spark.read.schema("step long, task_loss_bpb map<string,double>").json(path).select(F.input_file_name().alias("path"), "step", "task_loss_bpb")
    return df.select("path", "step", F.explode("task_loss_bpb").alias("label", "bpb"))


def read_trainer_log(spark: SparkSession, path: str) -> DataFrame:
    """(step, name, value) of log lines; a line without a step belongs to the last one seen in its file. Lines that hold
    neither are left out before the steps are carried on, over ranges of lines."""
    from sparkloom.operators.running import last_seen

    from .rows import indexed_lines

    pair = r"([\w./-]+)=(-?[\d.]+(?:e-?\d+)?)"
    step = F.nullif(F.regexp_extract("value", r"step[=: ]+(\d+)", 1), F.lit("")).cast("long")
    pairs = F.arrays_zip(F.regexp_extract_all("value", F.lit(pair), 1).alias("k"), F.regexp_extract_all("value", F.lit(pair), 2).alias("v"))
    lines = indexed_lines(spark, path).select("file", "row", step.alias("step"), pairs.alias("pairs")).where("step is not null or size(pairs) > 0")
    lines = last_seen(lines, F.col("step"), ["row"], ["file"], "step")
    return lines.select("step", F.explode("pairs").alias("p")).select("step", F.col("p.k").alias("name"), F.col("p.v").cast("double").alias("value")).where("name <> 'step'")


def write_docs(df: DataFrame, path: str, by: list[str], mode: str = "overwrite") -> None:
    """Gzipped JSON lines, a folder for each value of by, at most DOCS_PER_SHARD documents a file."""
    df.write.mode(mode).partitionBy(*by).option("maxRecordsPerFile", DOCS_PER_SHARD).json(path, compression="gzip")


def write_tokens(df: DataFrame, path: str, tokens: str = "tokens", order: str = "ord") -> DataFrame:
    """Token lists with EOS after each, packed to uint32 and kept as one binary row a document, in Parquet, with sizes
    and checksums; returns what was written."""
    def pack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            raw = [np.append(np.asarray(t, np.int64), EOS).astype("<u4").tobytes() for t in f[tokens]]
            yield pd.DataFrame({"ord": f[order], "raw": raw})

    packed = df.select(order, tokens).mapInPandas(pack, "ord long, raw binary")
    packed.withColumn("bytes", F.octet_length("raw").cast("long")).withColumn("crc32", F.crc32("raw")).write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def audit(spark: SparkSession, path: str) -> DataFrame:
    """Lines and bytes of decompressed text files, by file."""
    return spark.read.text(path).groupBy(F.input_file_name().alias("path")).agg(F.count("*").alias("lines"), F.sum(F.octet_length("value") + 1).alias("bytes"))
