"""State of loaders that stop and go on: where they are, and what may not have changed."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.operators.running import ranked
from sparkloom.operators.sampling import hash_order
from sparkloom.staging import with_each


@dataclass(frozen=True)
class Position:
    """A loader's place: an epoch, and how many of its batches are done."""

    epoch: int = 1
    done: int = 0
    version: int = 1


def epoch_batches(rows: DataFrame, key: str, size: int, seed: int, epoch: int) -> DataFrame:
    """rows with their batch (from 0) in one epoch's order, which seed and epoch decide. The last batch may be short."""
    d = ranked(rows, [hash_order(f"{seed}:{epoch}", F.col(key)), key], out="_rank")
    return d.withColumns({"epoch": F.lit(epoch), "batch": F.floor((F.col("_rank") - 1) / size).cast("long")}).drop("_rank")


def next_batches(rows: DataFrame, key: str, size: int, seed: int, at: Position, n: int) -> tuple[DataFrame, Position]:
    """The next n batches of an endless stream of shuffled epochs, and the position after them."""
    if at.version != 1:
        raise ValueError(f"unknown version of a position: {at.version}")
    whole = -(-rows.count() // size)
    if not whole:
        raise ValueError("a stream of no rows")
    parts = []
    while n > 0:
        take = min(n, whole - at.done)
        if take:
            parts.append(epoch_batches(rows, key, size, seed, at.epoch).where((F.col("batch") >= at.done) & (F.col("batch") < at.done + take)))
        at, n = replace(at, done=at.done + take), n - take
        if n > 0:
            at = Position(at.epoch + 1)
    out = parts[0] if parts else epoch_batches(rows, key, size, seed, at.epoch).limit(0)
    for p in parts[1:]:
        out = out.unionByName(p)
    return out, at


def changed_fields(saved: DataFrame, expected: DataFrame, *by: str) -> DataFrame:
    """saved, expected (by, field, value) -> immutable fields that differ or are missing: a loader may not go on with
    them."""
    a = expected.select(*by, "field", F.col("value").alias("expected"))
    b = saved.select(*by, "field", F.col("value").alias("saved"))
    return a.join(b, [*by, "field"], "left").where(~F.col("expected").eqNullSafe(F.col("saved")))


def normalised_weights(weights: DataFrame, domains: DataFrame, *by: str) -> DataFrame:
    """weights (by, domain, weight) in the order of domains (domain, ord), scaled to sum 1; missing, negative or
    non-finite ones, and sums of 0, raise."""
    from pyspark.sql import Window as W

    from sparkloom.operators.gates import require

    sets = weights.select(*by).distinct() if by else weights.limit(1).select(F.lit(1).alias("_"))
    d = with_each(sets, domains).join(weights, [*by, "domain"], "left")  # one row a set and domain
    bad = F.col("weight").isNull() | F.isnan("weight") | (F.abs("weight") == float("inf")) | (F.col("weight") < 0)
    require(d.where(bad).select(*by, "domain"), "weights that are missing, negative or not finite")
    total = F.sum("weight").over(W.partitionBy(*(by or [F.lit(1)])))
    d = d.withColumn("_total", total)
    require(d.where("_total <= 0").select(*by), "weights that sum to 0")
    return d.select(*by, "ord", "domain", (F.col("weight") / F.col("_total")).alias("weight"))


def fill_template(template: str, values: dict[str, Column]) -> Column:
    """A text with ${NAME} in place of values; a name without a value raises."""
    import re

    parts, at = [], 0
    for m in re.finditer(r"\$\{(\w+)\}", template):
        if m[1] not in values:
            raise KeyError(f"${{{m[1]}}} isn't set")
        parts += [F.lit(template[at : m.start()]), values[m[1]].cast("string")]
        at = m.end()
    return F.concat(*parts, F.lit(template[at:]))


def utc_text(ts: Column) -> Column:
    """A time in UTC as ISO 8601 text."""
    return F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("+00:00"))
