"""Running sums that no single task has to see whole."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkloom.staging import checkpoint, free_name


def running_totals(df: DataFrame, values: dict[str, Column], order: Sequence[Column | str], by: Sequence[str] = ()) -> DataFrame:
    """df with running sums (inclusive) of values, by output column, in order within by.

    Rows are dealt by ranges of by and order; each range is summed by itself and begins where those before it end. So a
    group that holds most rows, or a whole table, spreads over tasks. Order should tell all rows of a group apart."""
    part, names = free_name(df, "_part"), {c: free_name(df, f"_value_{c}") for c in values}
    d = df.withColumns({names[c]: v for c, v in values.items()})
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col(o) if isinstance(o, str) else o for o in order]
    d = checkpoint(d.repartitionByRange(parts, *by, *order).withColumn(part, F.spark_partition_id()))
    inside = W.partitionBy(part, *by).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    ahead = W.partitionBy(*(by or [F.lit(1)])).orderBy(part).rowsBetween(W.unboundedPreceding, -1)  # a row a range
    sums = d.groupBy(part, *by).agg(*[F.sum(names[c]).alias(names[c]) for c in values])
    starts = sums.select(
        F.col(part).alias(f"{part}_s"), *[F.col(b).alias(f"{part}_{i}") for i, b in enumerate(by)], *[F.coalesce(F.sum(names[c]).over(ahead), F.lit(0)).alias(f"{names[c]}_s") for c in values]
    )
    on = F.col(part) == F.col(f"{part}_s")
    for i, b in enumerate(by):
        on = on & F.col(b).eqNullSafe(F.col(f"{part}_{i}"))
    local = d.withColumns({f"{n}_i": F.sum(n).over(inside) for n in names.values()})
    joined = local.join(starts, on)
    kept = [c for c in df.columns if c not in values]
    return joined.select(*[F.col(f"`{c}`") for c in kept], *[(F.col(f"{n}_i") + F.col(f"{n}_s")).alias(c) for c, n in names.items()])


def ranked(df: DataFrame, order: Sequence[Column | str], by: Sequence[str] = (), out: str = "rank") -> DataFrame:
    """df with the rank of each row from 1, in order within by."""
    return running_totals(df, {out: F.lit(1).cast("long")}, order, by)


def with_totals(df: DataFrame, totals: dict[str, Column], by: Sequence[str]) -> DataFrame:
    """df with aggregates of its groups, aggregated before the shuffle."""
    names = {b: free_name(df, f"_by_{b}") for b in by}
    sums = df.groupBy(*[F.col(b).alias(n) for b, n in names.items()]).agg(*[v.alias(c) for c, v in totals.items()])
    on = F.lit(True)
    for b, n in names.items():
        on = on & F.col(b).eqNullSafe(F.col(n))
    return df.join(sums, on).drop(*names.values())


def _ranged(df: DataFrame, order: Sequence[Column], by: Sequence[str]) -> tuple[DataFrame, str]:
    """df dealt by ranges of by and order and kept, and its column that numbers the ranges."""
    part = free_name(df, "_part")
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return checkpoint(df.repartitionByRange(parts, *by, *order).withColumn(part, F.spark_partition_id())), part


def _with_edges(d: DataFrame, part: str, by: Sequence[str], summary: Column, over, out: str) -> DataFrame:
    """d with what over(window) gives of the ranges' summaries, a row a range and group, in order of the ranges."""
    names = [part, *by]
    renamed = [f"{out}_{i}" for i in range(len(names))]
    edges = d.groupBy(*names).agg(summary.alias(out)).withColumn(out, over(W.partitionBy(*(by or [F.lit(1)])).orderBy(part)))
    edges = edges.select(*[F.col(f"`{n}`").alias(r) for n, r in zip(names, renamed)], out)
    on = F.lit(True)
    for n, r in zip(names, renamed):
        on = on & F.col(f"`{n}`").eqNullSafe(F.col(r))
    return d.join(edges, on).drop(*renamed)


def last_seen(df: DataFrame, value: Column, order: Sequence[Column | str], by: Sequence[str] = (), out: str = "last_seen") -> DataFrame:
    """df with the last value that isn't null up to each row, in order within by.

    A segmented scan: each range's last value is its summary, summaries are carried over ranges, and each range is
    filled from what came before it. No task sees a group whole. Order should tell all rows of a group apart."""
    order = [F.col(o) if isinstance(o, str) else o for o in order]
    kept, v, edge = df.columns, free_name(df, "_value"), free_name(df, "_edge")
    d, part = _ranged(df.withColumn(v, value), order, by)
    summary = F.max_by(F.col(v), F.when(F.col(v).isNotNull(), F.struct(*order)))
    d = _with_edges(d, part, by, summary, lambda w: F.last(edge, ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, -1)), edge)
    inside = F.last(v, ignorenulls=True).over(W.partitionBy(part, *by).orderBy(*order).rowsBetween(W.unboundedPreceding, 0))
    return d.withColumn(part, F.coalesce(inside, edge)).select(*[f"`{c}`" for c in kept if c != out], F.col(part).alias(out))


def next_value(df: DataFrame, value: Column, order: Sequence[Column | str], by: Sequence[str] = (), default: Column | None = None, out: str = "next_value") -> DataFrame:
    """df with the value of the next row, in order within by; default for a group's last row. Ranges lend their first
    value to the range before, so no task sees a group whole."""
    order = [F.col(o) if isinstance(o, str) else o for o in order]
    kept, v, edge = df.columns, free_name(df, "_value"), free_name(df, "_edge")
    d, part = _ranged(df.withColumn(v, F.struct(value.alias("v"))), order, by)
    d = _with_edges(d, part, by, F.min_by(F.col(v), F.struct(*order)), lambda w: F.lead(edge).over(w), edge)
    following = F.coalesce(F.lead(v).over(W.partitionBy(part, *by).orderBy(*order)), F.col(edge))
    end = F.lit(None) if default is None else default
    return d.withColumn(part, F.when(following.isNull(), end).otherwise(following["v"])).select(*[f"`{c}`" for c in kept if c != out], F.col(part).alias(out))
