"""Budgets, samples, splits and layouts. Random order is a hash of seed and key, so it doesn't depend on partitions."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkloom.operators.gates import require
from sparkloom.operators.running import ranked, running_totals, with_totals
from sparkloom.staging import free_name


CUTS = 256


def hash_order(seed: int | str, *keys: Column) -> Column:
    """An ordering key that other engines can compute too."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[k.cast("string") for k in keys]))


def estimated_tokens(df: DataFrame, total: Column, size: str = "size", domain: str = "domain") -> Column:
    """A domain's tokens in proportion to a shard's bytes."""
    return total * F.col(size) / F.sum(size).over(W.partitionBy(domain))


def greedy_prefix(df: DataFrame, value: str, target: Column, order: Column, by: str = "domain", at_least_one: bool = False) -> DataFrame:
    """Rows in order until their sum reaches the target; the row that crosses it is kept."""
    d = running_totals(df, {"cum": F.col(value), "_rank": F.lit(1).cast("long")}, [order], [by])
    keep = F.col("cum") - F.col(value) < target
    return d.where(keep | (F.col("_rank") == 1) if at_least_one else keep).drop("_rank")


def holdout_count(n: Column, fraction: float) -> Column:
    """round half to even of n * fraction, one row at least for training; fractions outside (0, 0.5) raise."""
    if not 0 < fraction < 0.5:
        raise ValueError("the fraction must be between 0 and 0.5")
    return F.when(n > 0, F.least(F.bround(n * F.lit(fraction)).cast("long"), n - 1)).otherwise(0).cast("long")


def holdout_split(df: DataFrame, fraction: float, seed: int, key: str, by: list[str]) -> DataFrame:
    """df with split train or val, the same rows for the same seed whatever the partitions."""
    d = with_totals(ranked(df, [hash_order(seed, F.col(key)), key], by, "_rank"), {"_n": F.count("*")}, by)
    return d.withColumn("split", F.when(F.col("_rank") <= holdout_count(F.col("_n"), fraction), "val").otherwise("train")).drop("_rank", "_n")


def apportion(df: DataFrame, weight: str, total: int, order: str, by: list[str] | None = None) -> DataFrame:
    """Whole counts in proportion to weights that add up to total: largest remainders, ties by weight and then order."""
    part = W.partitionBy(*(by or [F.lit(1)]))
    raw = F.col(weight) / F.sum(weight).over(part) * total
    d = df.withColumn("_raw", raw).withColumn("_base", F.floor("_raw"))
    d = d.withColumn("_left", F.lit(total) - F.sum("_base").over(part))
    rank = F.row_number().over(part.orderBy((F.col("_raw") - F.col("_base")).desc(), F.col("_raw").desc(), F.col(order)))
    n = F.when(F.col(weight) > 0, F.col("_base") + F.when(F.col("_rank") <= F.col("_left"), 1).otherwise(0)).otherwise(0)
    return d.withColumn("_rank", rank).withColumn("n", n.cast("long")).drop("_raw", "_base", "_left", "_rank")


def plan_without_replacement(items: DataFrame, counts: DataFrame, seed: int, by: str, key: str) -> DataFrame:
    """counts.n rows of each group, none twice; too few rows raise. Positions are a shuffle of the whole plan."""
    have = items.groupBy(by).agg(F.count("*").alias("have"))
    short = counts.join(have, by, "left").where(F.col("n") > F.coalesce("have", F.lit(0)))
    if not short.isEmpty():
        raise ValueError("a group has fewer rows than the plan takes")
    picked = ranked(items, [hash_order(seed, F.col(by), F.col(key)), key], [by], "_r").join(counts.select(by, "n"), by).where(F.col("_r") <= F.col("n"))
    return picked.drop("_r", "n").withColumn("shuffle_key", hash_order(f"{seed}-order", F.col(by), F.col(key)))


def draw_with_replacement(slots: DataFrame, weights: DataFrame, seed: int) -> DataFrame:
    """A domain for every slot by hash and cumulative weight; the same for any number of partitions. Shares are cut at
    CUTS even points, which makes it an equi-join. weights has a row a domain."""
    cum = F.sum("weight").over(W.orderBy("ord").rowsBetween(W.unboundedPreceding, 0))
    total = F.sum("weight").over(W.partitionBy())
    bounds = weights.select("domain", ((cum - F.col("weight")) / total).alias("lo"), (cum / total).alias("hi"), "ord")
    top = bounds.agg(F.max("ord")).first()[0]
    bounds = bounds.withColumn("hi", F.when(F.col("ord") == top, F.lit(2.0)).otherwise(F.col("hi")))
    u = F.conv(F.substring(hash_order(seed, F.col("slot")), 1, 13), 16, 10).cast("double") / float(1 << 52)
    cut = F.explode(F.sequence(F.floor(F.col("lo") * CUTS), F.floor(F.least(F.col("hi"), F.lit(1.0)) * CUTS)))
    drawn = slots.withColumn("u", u).withColumn("_cut", F.floor(F.col("u") * CUTS))
    return drawn.join(bounds.withColumn("_cut", cut), "_cut").where((F.col("u") >= F.col("lo")) & (F.col("u") < F.col("hi"))).select("slot", "domain")


def _prefix(df: DataFrame, by: str, size: str, rate: Column, low: Column, fits: Callable[[Column], Column], constants: Sequence[str]) -> DataFrame:
    """Smallest first until have + rate * sizes reaches low; a file with which the sum doesn't fit is skipped, and so are all
    after it, which are no smaller. So the files taken are a running sum's: no task sees a domain whole. What stands in constants is
    one value a domain, or this raises, as does a negative size or rate."""
    same = df.groupBy(by).agg(*[F.struct(F.min(c).alias("a"), F.max(c).alias("b"), F.count_if(F.col(c).isNull()).alias("n")).alias(c) for c in constants], F.min(F.least(F.col(size), F.lit(0))).alias("_least"), F.min(rate).alias("_rate"))
    odd = F.col("_least") < 0
    for c in constants:
        odd = odd | ~F.col(f"{c}.a").eqNullSafe(F.col(f"{c}.b")) | (F.col(f"{c}.n") > 0)
    require(same.where(odd | (F.col("_rate") < 0)), "domains whose files differ in rate or bounds, or have negative sizes")
    upto = free_name(df, "_upto")
    d = running_totals(df, {upto: F.col(size).cast("long")}, [size, "path"], [by])
    before = F.col("have") + rate * (F.col(upto) - F.col(size))
    return d.where((before < low) & fits(F.col("have") + rate * F.col(upto))).select(*df.columns)


def band_topup(df: DataFrame, by: str = "domain") -> DataFrame:
    """Smallest files first until a domain reaches its floor; a file that would pass the ceiling is skipped. df: domain,
    path, size, rate, have, floor, ceiling; all but path and size are one value a domain."""
    return _prefix(df, by, "size", F.col("rate"), F.col("floor"), lambda s: s <= F.col("ceiling"), ["rate", "have", "floor", "ceiling"])


def trim_topup(df: DataFrame, by: str = "domain", tolerance: float = 0.1) -> DataFrame:
    """Trims added files back into the band: smallest first until a domain reaches plan / (1 + tolerance); a file that
    would pass plan / (1 - tolerance) is only taken if the sum is then within the tolerance of the plan. df: domain, path,
    tokens, plan, have; plan and have are one value a domain."""
    plan = F.col("plan")
    fits = lambda s: (s <= plan / (1 - tolerance)) | ((s != 0) & (F.try_divide(F.abs(plan - s), s) <= tolerance))
    return _prefix(df, by, "tokens", F.lit(1), plan / (1 + tolerance), fits, ["plan", "have"])


def trim_to_budget(docs: DataFrame, tokens: str, target: int, order: Column) -> DataFrame:
    """Rows in order up to a token target. Below 98 % of it every row is kept, by a running sum; in the last 2 % rows
    that would pass 102 % are skipped, one after the other.

    Rows of up to 2 % of the target always fit, so they are settled by a running sum as well. Only the larger ones
    depend on those before: they are fewer than 50 in a target's worth of tokens, and go through a loop on the driver."""
    if target <= 0:
        return docs.limit(0)
    low, high = max(int(target * 0.98), 1), int(target * 1.02)  # the first row with tokens is kept, whatever its size
    d = running_totals(docs.withColumn("_order", order), {"_upto": F.col(tokens)}, ["_order"]).withColumn("_before", F.col("_upto") - F.col(tokens))
    head = d.where(F.col("_before") < low).select(*docs.columns)
    start = d.where(F.col("_before") < low).agg(F.sum(tokens)).first()[0] or 0
    small = F.col(tokens) <= high - target
    rest = running_totals(d.where((F.col("_before") >= low) & (F.col(tokens) <= high - low)), {"_fits": F.when(small, F.col(tokens)).otherwise(0)}, ["_order"])
    rest = rest.withColumn("_at", F.col("_fits") - F.when(small, F.col(tokens)).otherwise(0) + start)
    large, more = rest.where(~small & (F.col("_at") < target)).select("_order", "_at", F.col(tokens).alias("n")).orderBy("_order").toLocalIterator(), []
    for r in large:
        have = r["_at"] + sum(n for _, n in more)
        if have >= target:
            break
        if have + r.n <= high:
            more.append((r["_order"], r.n))  # two at most
    have = F.col("_at")
    for at, n in more:
        have = have + F.when(F.col("_order") > at, n).otherwise(0)
    kept = (small & (have < target)) | F.col("_order").isin([at for at, _ in more])
    return head.unionByName(rest.where(kept).select(*docs.columns))


def tail_carve(shards: DataFrame, fraction: float, order: str = "ord", size: str = "bytes") -> DataFrame:
    """How many bytes of each shard go to validation: the last int(total * fraction) bytes, in whole 4-byte tokens."""
    total = F.lit(shards.agg(F.sum(size)).first()[0] or 0)
    want = F.floor(total * F.lit(fraction) / 4).cast("long") * 4
    val = F.least(F.col(size), F.greatest(F.lit(0), want - (total - F.col("_end")))).cast("long")
    d = running_totals(shards, {"_end": F.col(size)}, [order]).withColumn("val_bytes", val).drop("_end")
    return d.withColumn("train_bytes", (F.col(size) - F.col("val_bytes")).cast("long"))


def byte_shards(objects: DataFrame, limit: int, order: str = "ord", size: str = "bytes") -> DataFrame:
    """Pieces of a byte stream cut every `limit` bytes: (ord, shard, start, end) in the stream."""
    d = running_totals(objects, {"_end": F.col(size)}, [order]).withColumn("_start", F.col("_end") - F.col(size)).where(F.col(size) > 0)
    cut = F.explode(F.sequence(F.floor(F.col("_start") / limit), F.floor((F.col("_end") - 1) / limit)))
    d = d.withColumn("shard", cut)
    return d.select(order, "shard", F.greatest("_start", F.col("shard") * limit).alias("start"), F.least("_end", (F.col("shard") + 1) * limit).alias("end"))


def balanced_slices(df: DataFrame, weight: str, n: int, order: str) -> DataFrame:
    """df with a slice 0 to n-1 of about equal weight each, in order."""
    total = df.agg(F.sum(weight)).first()[0] or 0
    d = running_totals(df, {"_upto": F.col(weight)}, [order])
    at = F.try_divide((F.col("_upto") - F.col(weight)) * n, F.lit(total))
    return d.withColumn("slice", F.least(F.floor(F.coalesce(at, F.lit(0))), F.lit(n - 1)).cast("long")).drop("_upto")
