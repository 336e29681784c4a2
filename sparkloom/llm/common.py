"""Helpers that the operators of this package share."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.staging import balanced, checkpoint, discard, free_name, scratch, shared_dir

__all__ = ["CHUNK_CHARS", "SPACES", "WORD", "checkpoint", "chunked", "discard", "free_name", "n_matches", "n_words", "scratch", "shared_dir", "table"]

#: Java regular expression of a word: anything but space and the ASCII controls 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"
SPACES = r"[\x20\x09-\x0D]"
#: Code points that a Python operator handles at a time; bounds a worker's memory.
CHUNK_CHARS = 1 << 21


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return balanced(df) if name == "documents" else df  # whose texts are the work


def n_matches(text: Column, token: str, skip: str = SPACES) -> Column:
    """How often token matches in a text column, as a long; null counts as empty. skip: a class of every character that
    is in no match. Each match leaves one character of the text, so none is kept as a string of its own."""
    left = F.length(F.regexp_replace(text, f"{skip}*+(?:{token}){skip}*+", "x"))
    return F.coalesce(F.when(text.rlike(token), left), F.lit(0)).cast("long")


def n_words(text: Column) -> Column:
    """Words of a text column as a long; null counts as empty."""
    return n_matches(text, r"[^\x20\x09-\x0D]++")


def chunked(texts: Iterable[str], limit: int = CHUNK_CHARS) -> Iterator[tuple[int, int]]:
    """Row ranges of about limit code points each; a longer text has a range of its own."""
    start = size = i = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > limit:
            yield start, i
            start, size = i, 0
        size += len(t)
    if size or i >= start:
        yield start, i + 1
