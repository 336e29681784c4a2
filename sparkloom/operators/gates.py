"""Checks that stop a build: every one is a small DataFrame of failures, and `require` raises if there are any."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def require(failures: DataFrame, what: str) -> None:
    bad = failures.limit(5).collect()
    if bad:
        raise ValueError(f"{what}: {[r.asDict() for r in bad]}")


def duplicate_keys(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def tiling_gaps(spans: DataFrame, by: str, start: str = "start", end: str = "end") -> DataFrame:
    """Rows that don't begin where the one before ends, or at 0."""
    w = W.partitionBy(by).orderBy(start, end)
    return spans.withColumn("expected", F.coalesce(F.lag(end).over(w), F.lit(0))).where(F.col(start) != F.col("expected"))


def missing(expected: DataFrame, found: DataFrame, *keys: str) -> DataFrame:
    return expected.join(found, list(keys), "left_anti")


def monotone_steps(df: DataFrame, by: str, step: str, final: int) -> DataFrame:
    """Steps that don't rise, a first step other than 0, a last one not below final."""
    w = W.partitionBy(by).orderBy("ord")
    d = df.withColumn("_before", F.lag(step).over(w)).withColumn("_next", F.lead(step).over(w))
    first = F.col("_before").isNull() & (F.col(step) != 0)
    return d.where(first | (F.col(step) <= F.col("_before")) | (F.col("_next").isNull() & (F.col(step) >= final))).drop("_before", "_next")


def misaligned(df: DataFrame, size: Column, declared: Column) -> DataFrame:
    """Objects that aren't whole 4-byte tokens or differ from their declared size."""
    return df.where((size % 4 != 0) | ~size.eqNullSafe(declared))


def identity_mismatches(a: DataFrame, b: DataFrame, keys: list[str], value: str) -> DataFrame:
    both = a.select(*keys, F.col(value).alias("_a")).join(b.select(*keys, F.col(value).alias("_b")), keys, "full_outer")
    return both.where(~F.col("_a").eqNullSafe(F.col("_b"))).select(*keys, F.when(F.col("_a").isNull(), "only_right").when(F.col("_b").isNull(), "only_left").otherwise("differs").alias("kind"))


def set_differences(found: DataFrame, required: DataFrame, key: str) -> DataFrame:
    """Keys that one side lacks."""
    a = required.select(key).distinct().exceptAll(found.select(key).distinct()).withColumn("kind", F.lit("missing"))
    b = found.select(key).distinct().exceptAll(required.select(key).distinct()).withColumn("kind", F.lit("unexpected"))
    return a.unionByName(b)


def complete_sets(df: DataFrame, by: str, label: str, value: str, labels: list[str]) -> DataFrame:
    """Groups that have a value of every label."""
    some = df.where(F.col(label).isin(labels) & F.col(value).isNotNull())
    return some.groupBy(by).agg(F.countDistinct(label).alias("_n")).where(F.col("_n") == len(labels)).select(by)


def merged_values(a: DataFrame, b: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Values of two tables by key; a key that has different ones raises."""
    both = a.select(*keys, F.col(value).alias("_a")).join(b.select(*keys, F.col(value).alias("_b")), keys, "full_outer")
    require(both.where(F.col("_a").isNotNull() & F.col("_b").isNotNull() & (F.col("_a") != F.col("_b"))).select(*keys), "values in conflict")
    return both.select(*keys, F.coalesce("_a", "_b").alias(value))


def accepted(shards: DataFrame, by: str, failed: Column) -> DataFrame:
    return shards.groupBy(by).agg(F.count("*").alias("shards"), F.count_if(failed).alias("failures"), F.bool_and(~failed).alias("accepted"))


def macro_matches(rows: DataFrame, labels: DataFrame, step: str, tolerance: float = 1e-6) -> DataFrame:
    mean = labels.groupBy(step).agg(F.avg("value").alias("_mean"))
    return rows.join(mean, step).where(F.abs(F.col("macro") - F.col("_mean")) > tolerance)


def first_mismatch(df: DataFrame, by: str, order: str, bad: Column) -> DataFrame:
    return df.where(bad).groupBy(by).agg(F.min(order).alias("first_bad"), F.count("*").alias("n_bad"))
