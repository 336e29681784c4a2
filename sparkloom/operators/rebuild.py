"""Rebuilding a token corpus from manifests: rows by index, streams laid end to end, objects cut from them, digests."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom.sources.files import EOS

from .gates import require
from .relational import interval_overlap

#: Fixed value: the text that stands for EOS.
EOS_TEXT = "<|endoftext|>"


def hashed_words(text: Column, size: int = EOS) -> Column:
    """The engine's own tokenizer, which needs no model: an id for every word from its hash; EOS_TEXT is EOS."""
    words = F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: w != "")
    number = lambda w: (F.conv(F.substring(F.md5(w), 1, 8), 16, 10).cast("long") % size).cast("int")
    return F.transform(words, lambda w: F.when(w == EOS_TEXT, F.lit(EOS)).otherwise(number(w)))


def tokenise(docs: DataFrame, encode: Callable[[list[str]], list[list[int]]] | None = None, text: str = "text", out: str = "tokens") -> DataFrame:
    """docs with the token ids of each text and EOS after them. encode turns a list of texts into lists of ids, without
    special tokens, and is called on Arrow batches; without it the words' hashes are the ids, all in Spark."""
    if encode is None:
        return docs.withColumn(out, F.concat(hashed_words(F.col(text)), F.array(F.lit(EOS))))
    kept = [f for f in docs.schema.fields if f.name != out]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield f.assign(**{out: [[*ids, EOS] for ids in encode([t or "" for t in f[text]])]})

    return docs.mapInPandas(run, T.StructType([*kept, T.StructField(out, T.ArrayType(T.IntegerType()))]))


def token_counts(docs: DataFrame, encode: Callable[[list[str]], list[list[int]]] | None = None, text: str = "text", out: str = "n_tokens") -> DataFrame:
    """docs with the number of tokens of each text, without EOS."""
    return tokenise(docs, encode, text, "_tokens").withColumn(out, (F.size("_tokens") - 1).cast("long")).drop("_tokens")


def eos_in_text(tokens: Column, eos: int = EOS) -> Column:
    """EOS tokens that a text itself holds: all but the last."""
    return F.greatest(F.size(F.filter(tokens, lambda x: x == eos)) - 1, F.lit(0)).cast("long")


def lookup_in_order(source: DataFrame, wanted: DataFrame, row: str = "row", order: str = "ord") -> DataFrame:
    """The wanted rows of a source by index, in the order of the manifest; a row that the source hasn't raises."""
    require(wanted.join(source, row, "left_anti").select(row), "rows past the end of the source")
    return wanted.join(source, row).orderBy(order)


def object_documents(objects: DataFrame, spans: DataFrame, on: str, width: int) -> DataFrame:
    """objects (on, obj, start, end), spans (on, doc_id, start, end) of documents laid end to end -> one row an object: its
    first and last document, how many, and how much of the stream it takes from them."""
    a = objects.select(on, "obj", F.col("start").alias("a_start"), F.col("end").alias("a_end"))
    b = spans.select(on, "doc_id", F.col("start").alias("b_start"), F.col("end").alias("b_end"))
    both = interval_overlap(a, b, on, width).withColumn("taken", F.least("a_end", "b_end") - F.greatest("a_start", "b_start"))
    first, last = F.min_by("doc_id", "b_start"), F.max_by("doc_id", "b_start")
    return both.groupBy(on, "obj").agg(first.alias("first_doc"), last.alias("last_doc"), F.count("*").alias("docs"), F.sum("taken").alias("taken"))


def object_pieces(objects: DataFrame, spans: DataFrame, on: str, width: int, text: str = "text") -> DataFrame:
    """What each object takes of each document: (on, obj, at, piece), at counting from the object's start."""
    a = objects.select(on, "obj", F.col("start").alias("a_start"), F.col("end").alias("a_end"))
    b = spans.select(on, F.col("start").alias("b_start"), F.col("end").alias("b_end"), F.col(text).alias("_text"))
    both = interval_overlap(a, b, on, width)
    lo, hi = F.greatest("a_start", "b_start"), F.least("a_end", "b_end")
    piece = F.substr("_text", (lo - F.col("b_start") + 1).cast("int"), (hi - lo).cast("int"))
    return both.select(on, "obj", (lo - F.col("a_start")).alias("at"), piece.alias("piece"))


def ordered_digests(df: DataFrame, by: list[str], order: list[str], value: str) -> DataFrame:
    """by, n, bytes and SHA-256 of each group's values one after the other. A group is read in order by one task, row by
    row: none of it is held."""
    fields = [df.schema[b] for b in by]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, digest, n, size = None, hashlib.sha256(), 0, 0
        for f in frames:
            done = []
            for *key, v in f[[*by, value]].itertuples(index=False, name=None):
                key = tuple(None if pd.isna(k) else k for k in key)
                if key != now:
                    if now is not None:
                        done.append((*now, n, size, digest.hexdigest()))
                    now, digest, n, size = key, hashlib.sha256(), 0, 0
                raw = v if isinstance(v, bytes) else str(v).encode()
                digest.update(raw)
                n, size = n + 1, size + len(raw)
            yield pd.DataFrame(done, columns=[*by, "n", "bytes", "sha256"])
        if now is not None:
            yield pd.DataFrame([(*now, n, size, digest.hexdigest())], columns=[*by, "n", "bytes", "sha256"])

    rows = df.where(F.col(value).isNotNull()).select(*dict.fromkeys([*by, *order, value]))
    rows = rows.repartition(*by).sortWithinPartitions(*by, *order)
    return rows.mapInPandas(run, T.StructType([*fields, *[T.StructField(c, T.LongType()) for c in ("n", "bytes")], T.StructField("sha256", T.StringType())]))


def token_bytes(df: DataFrame, tokens: str = "tokens", out: str = "raw") -> DataFrame:
    """df with token lists as little-endian uint32 bytes."""
    kept = [f for f in df.schema.fields if f.name != out]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield f.assign(**{out: [np.asarray(t, "<u4").tobytes() for t in f[tokens]]})

    return df.mapInPandas(run, T.StructType([*kept, T.StructField(out, T.BinaryType())]))


def digest_mismatches(digests: DataFrame, expected: DataFrame, by: list[str]) -> DataFrame:
    """Objects whose digest differs from the expected one, or that are on one side only."""
    both = digests.select(*by, F.col("sha256").alias("_a")).join(expected.select(*by, F.col("sha256").alias("_b")), by, "full_outer")
    return both.where(~F.col("_a").eqNullSafe(F.col("_b"))).select(*by, F.when(F.col("_a").isNull(), "missing").when(F.col("_b").isNull(), "unexpected").otherwise("differs").alias("kind"))


def resolve_names(names: DataFrame, objects: DataFrame, files: DataFrame, width: int) -> DataFrame:
    """names (name) -> the files needed: each name is an object, a source (all of its objects, with or without tokens/),
    src: and a file's number, or a file's path; objects bring the files that overlap them. An unknown name raises.

    objects: source, obj, start, end; files: source, src, path, start, end."""
    n = names.select(F.regexp_replace(F.trim("name"), "^/+|/+$", "").alias("name"))
    plain = F.regexp_replace("name", "^tokens/", "")
    of = objects.select(F.col("obj").alias("_o"), F.col("source").alias("_s"))
    by_name = n.join(of.select("_o").distinct(), F.col("name") == F.col("_o")).select("name", F.col("_o").alias("obj"))
    by_source = n.withColumn("_p", plain).join(of, F.col("_p") == F.col("_s")).select("name", F.col("_o").alias("obj"))
    number = F.regexp_extract("name", "^src:([0-9]+)$", 1)
    by_number = n.join(files.select(F.col("src").alias("_i")), F.nullif(number, F.lit("")).cast("long") == F.col("_i")).select("name", F.col("_i").alias("src"))
    by_path = n.join(files.select("path", F.col("src").alias("_i")), F.col("name") == F.col("path")).select("name", F.col("_i").alias("src"))
    direct, named = by_number.unionByName(by_path), by_name.unionByName(by_source)
    require(n.join(direct.select("name").unionByName(named.select("name")), "name", "left_anti"), "unknown names")
    wanted = objects.join(named.select("obj").distinct(), "obj", "left_semi")
    a = wanted.select("source", "obj", F.col("start").alias("a_start"), F.col("end").alias("a_end"))
    b = files.select("source", "src", F.col("start").alias("b_start"), F.col("end").alias("b_end"))
    return interval_overlap(a, b, "source", width).select("src").unionByName(direct.select("src")).distinct()
