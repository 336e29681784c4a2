"""Shard listings: which files of a corpus hold data, of which domain, how large, and where they are to be found."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.functions.text import domain_of_path
from sparkloom.operators.gates import require

from .files import list_files

#: Fixed value: endings of files that hold documents.
DATA_FILE = r"(?i)\.jsonl?(\.(gz|zst|zstd))?$"


def is_data_file(path: Column) -> Column:
    return F.coalesce(path.rlike(DATA_FILE), F.lit(False))


def shard_table(listing: DataFrame, domains: list[str]) -> DataFrame:
    """(path, size) of any listing, local or remote -> the data files of known domains, with their domain."""
    named = listing.where(is_data_file(F.col("path"))).withColumn("domain", domain_of_path(F.col("path"), domains))
    return named.where("domain is not null")


def shards_below(spark: SparkSession, root: str, domains: list[str]) -> DataFrame:
    """Shard table of a folder; contents aren't read."""
    base = "/" + root.split("://")[-1].strip("/")
    relative = F.substr(F.regexp_replace("path", r"^[a-z0-9]+:/+", "/"), F.lit(len(base) + 2))
    return shard_table(list_files(spark, root).withColumn("path", relative), domains)


def shards_of_manifest(spark: SparkSession, path: str, prefix: str, domains: list[str]) -> DataFrame:
    """Shard table of a manifest of JSON lines (path, size): rows below prefix, which is cut off. Bad lines raise."""
    rows = spark.read.schema("path string, size long").option("mode", "FAILFAST").json(path)
    rows = rows.where(F.startswith("path", F.lit(prefix))).withColumn("path", F.substr("path", F.lit(len(prefix) + 1)))
    return shard_table(rows, domains)


def measured(manifest: DataFrame) -> DataFrame:
    """Tokens, bytes, shards and distinct paths of each domain."""
    return manifest.groupBy("domain").agg(F.sum("tokens").alias("tokens"), F.sum("bytes").alias("bytes"), F.count("*").alias("shards"), F.countDistinct("path").alias("paths"))


def pool_tokens(pools: DataFrame, defaults: dict[str, float]) -> DataFrame:
    """pools (domain, estimated, target, full, bytes) -> the first that isn't 0: the estimate, the target, the full
    pool, a default, and a token for every four bytes."""
    some = lambda c: F.nullif(F.col(c).cast("double"), F.lit(0.0))
    known = F.create_map(*[F.lit(x) for k, v in sorted(defaults.items()) for x in (k, float(v))]) if defaults else None
    default = F.try_element_at(known, F.col("domain")) if known is not None else F.lit(None).cast("double")
    return pools.withColumn("pool_tokens", F.coalesce(some("estimated"), some("target"), some("full"), default, F.col("bytes") / 4.0))


def first_layout(listing: DataFrame, key: str, folders: list[str]) -> DataFrame:
    """Of each key's files those in the first folder, in order of preference, that has any. listing: key, folder, path."""
    order = F.array_position(F.array(*[F.lit(f) for f in folders]), F.col("folder"))
    d = listing.withColumn("_p", F.nullif(order, F.lit(0))).where("_p is not null")
    best = d.groupBy(F.col(key).alias("_k")).agg(F.min("_p").alias("_best"))
    return d.join(best, F.col(key).eqNullSafe(F.col("_k")) & (F.col("_p") == F.col("_best"))).select(*listing.columns)


def refreshed(manifest: DataFrame, listing: DataFrame) -> DataFrame:
    """A manifest with sizes as listed now; shards that aren't there, or are empty, raise."""
    now = listing.select("path", F.col("size").alias("_now"))
    d = manifest.join(now, "path", "left")
    require(d.where("_now is null or _now = 0").select("path"), "shards that are missing or empty")
    return d.withColumn("size", F.col("_now")).drop("_now")


def token_report(files: DataFrame, by: list[str]) -> DataFrame:
    """files (by, bytes, stream_tokens, meta_tokens) -> shards, bytes and tokens: those of the stream, of the metadata, or a
    fourth of the bytes. Bytes that aren't whole tokens raise."""
    require(files.where("bytes % 4 <> 0").select(*by), "sizes that aren't whole tokens")
    tokens = F.coalesce(F.nullif(F.max("stream_tokens"), F.lit(0)), F.nullif(F.max("meta_tokens"), F.lit(0)), F.floor(F.sum("bytes") / 4))
    return files.groupBy(*by).agg(F.count("*").alias("shards"), F.sum("bytes").alias("bytes"), tokens.cast("long").alias("tokens"))


def merged_lines(lines: DataFrame, by: str, value: str = "value") -> DataFrame:
    """JSON lines of a shard's parts -> lines and bytes by shard; blank lines don't count, a line that isn't JSON raises."""
    d = lines.where(F.trim(value) != "")
    require(d.where(F.try_parse_json(value).isNull()).select(by), "lines that aren't JSON")
    return d.groupBy(by).agg(F.count("*").alias("lines"), F.sum(F.octet_length(value) + 1).alias("bytes"))
