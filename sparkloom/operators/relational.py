"""Joins, windows and set operations that corpus planning needs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkloom.operators.running import last_seen, next_value, running_totals


def interval_overlap(a: DataFrame, b: DataFrame, on: str, width: int) -> DataFrame:
    """Pairs of half-open intervals that overlap: a(on, a_id, a_start, a_end), b likewise. Both sides are cut into
    buckets of `width`, which makes it an equi-join; a pair counts in the bucket where its overlap begins."""
    def cut(df: DataFrame, p: str) -> DataFrame:
        return df.where(F.col(f"{p}_end") > F.col(f"{p}_start")).withColumn("_bucket", F.explode(F.sequence(F.floor(F.col(f"{p}_start") / width), F.floor((F.col(f"{p}_end") - 1) / width))))

    begin = F.greatest("a_start", "b_start")
    both = cut(a, "a").join(cut(b, "b"), [on, "_bucket"])
    return both.where((begin < F.least("a_end", "b_end")) & (F.floor(begin / width) == F.col("_bucket"))).drop("_bucket")


def point_in_interval(points: DataFrame, spans: DataFrame, on: str, point: str, width: int) -> DataFrame:
    """Each point with the span (start, end) of its group that holds it."""
    s = spans.where("end > start").withColumn("_bucket", F.explode(F.sequence(F.floor(F.col("start") / width), F.floor((F.col("end") - 1) / width))))
    p = points.withColumn("_bucket", F.floor(F.col(point) / width))
    return p.join(s, [on, "_bucket"]).where((F.col(point) >= F.col("start")) & (F.col(point) < F.col("end"))).drop("_bucket")


def offsets(df: DataFrame, length: Column, by: str, order: str) -> DataFrame:
    """df with start (exclusive running sum) and end of each row."""
    return running_totals(df, {"end": length}, [order], [by]).withColumn("start", F.col("end") - length)


def last_wins(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(F.col(order).desc()))
    return df.withColumn("_r", rank).where("_r = 1").drop("_r")


def first_wins(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(order))
    return df.withColumn("_r", rank).where("_r = 1").drop("_r")


def carry_forward(df: DataFrame, value: str, by: str, order: str) -> DataFrame:
    """df with the last value that isn't null up to each row of a group."""
    return last_seen(df, F.col(value), [order], [by], f"last_{value}")


def segments(df: DataFrame, by: str, step: str, final: int) -> DataFrame:
    """df with the length of each row's segment: up to its group's next step, or to final."""
    d = next_value(df, F.col(step), [step], [by], F.lit(final).cast(df.schema[step].dataType), "length")
    return d.withColumn("length", (F.col("length") - F.col(step)).cast("long"))


def ordinal_windows(df: DataFrame, closes: Column, every: int, order: str) -> DataFrame:
    """df with a window number that rises after every `every`-th row that closes one."""
    closed = F.coalesce(closes, F.lit(False)).cast("long")
    d = running_totals(df, {"_closed": closed}, [order])
    return d.withColumn("window", F.floor((F.col("_closed") - closed) / every).cast("long")).drop("_closed")


def fill_missing(primary: DataFrame, fallback: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Primary values, and the fallback's where the primary has none; agrees tells whether both have the same."""
    f = fallback.select(*keys, F.col(value).alias("_f"))
    both = primary.select(*keys, F.col(value).alias("_p")).join(f, keys, "full_outer")
    return both.select(*keys, F.coalesce("_p", "_f").alias(value), (F.col("_p").isNull() | F.col("_f").isNull() | (F.col("_p") == F.col("_f"))).alias("agrees"))


def append_new(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    return old.unionByName(new.join(old, key, "left_anti"))


def first_existing(wanted: DataFrame, listing: DataFrame, key: str) -> DataFrame:
    """Of each key's candidate paths (array, in order of preference) the first that is listed; null if none is."""
    tried = wanted.select(key, F.posexplode("candidates").alias("priority", "path"))
    found = tried.join(listing.select("path").distinct(), "path", "left_semi").groupBy(key).agg(F.min_by("path", "priority").alias("path"))
    return wanted.select(key).join(found, key, "left")


def cell_differences(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Cells (keys, column) whose values differ, null and NaN equal to themselves; rows of one side count as well."""
    cols = [c for c in a.columns if c not in keys]
    long = lambda df, name: df.unpivot(keys, cols, "column", name)
    both = long(a, "left").join(long(b, "right"), [*keys, "column"], "full_outer")
    return both.where(~F.col("left").eqNullSafe(F.col("right")))


def prefix_match(df: DataFrame, name: str, wanted: list[str]) -> DataFrame:
    """Rows whose name is one of `wanted` or lies below one."""
    hit = F.lit(False)
    for s in wanted:
        hit = hit | (F.col(name) == s) | F.col(name).startswith(f"{s}/")
    return df.where(hit)
