"""Choosing training tokens by score: one row a (instance, pos)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkloom.operators.running import ranked, with_totals

ROW = "instance_id"
METHODS = ("full", "random", "rho_excess", "rel_ema", "middle_ppl", "blade", "attention_topk")


def uniform(tag: str, seed: int, *keys: Column) -> Column:
    """A number in [0, 1) that depends on tag, seed and keys alone."""
    h = F.md5(F.concat_ws(":", F.lit(tag), F.lit(str(seed)), *[k.cast("string") for k in keys]))
    return F.conv(F.substring(h, 1, 13), 16, 10).cast("double") / float(1 << 52)


def keep_count(n: Column, fraction: float) -> Column:
    """round half to even of n * fraction, at least 1, at most n."""
    return F.when(n > 0, F.least(F.greatest(F.bround(n * F.lit(fraction)).cast("long"), F.lit(1).cast("long")), n)).otherwise(0)


def _ranked(df: DataFrame, score: Column, seed: int, valid: str) -> DataFrame:
    d = df.withColumn("_n", F.count_if(valid).over(W.partitionBy(ROW)))
    order = W.partitionBy(ROW).orderBy(F.col(valid).desc(), score.desc_nulls_last(), uniform("tie", seed, F.col(ROW), F.col("pos")), F.col("pos"))
    return d.withColumn("_rank", F.row_number().over(order))


def top_fraction(df: DataFrame, score: Column, fraction: float, seed: int = 0, valid: str = "valid") -> DataFrame:
    """df with weight 1 for the best fraction of a row's valid tokens, ties by hash."""
    d = _ranked(df, score, seed, valid)
    return d.withColumn("weight", (F.col(valid) & (F.col("_rank") <= keep_count(F.col("_n"), fraction))).cast("int")).drop("_n", "_rank")


def middle_fraction(df: DataFrame, score: Column, fraction: float, seed: int = 0, valid: str = "valid") -> DataFrame:
    """df with weight 1 for the middle band of a row's valid tokens by score."""
    d = _ranked(df, score, seed, valid)
    k = keep_count(F.col("_n"), fraction)
    low = F.floor((F.col("_n") - k) / 2)
    return d.withColumn("weight", (F.col(valid) & (F.col("_rank") > low) & (F.col("_rank") <= low + k)).cast("int")).drop("_n", "_rank")


def select_tokens(df: DataFrame, method: str, fraction: float = 1.0, seed: int = 0) -> DataFrame:
    """df (instance_id, pos, valid and the scores a method needs) with a 0/1 weight."""
    if method == "full":
        return df.withColumn("weight", F.col("valid").cast("int"))
    if method == "random":
        return top_fraction(df, uniform("select", seed, F.col(ROW), F.col("pos")), fraction, seed)
    if method == "rho_excess":
        return top_fraction(df, F.col("current") - F.col("reference"), fraction, seed)
    if method == "rel_ema":
        return top_fraction(df, F.col("current") - F.col("history"), fraction, seed)
    if method == "middle_ppl":
        return middle_fraction(df, F.col("reference"), fraction, seed)
    if method == "blade":
        return top_fraction(df, F.col("proxy") - F.col("reference"), fraction, seed)
    if method == "attention_topk":
        return top_fraction(df, F.col("z"), fraction, seed)
    raise ValueError(f"unknown method: {method!r}")


def position_moments(df: DataFrame, value: str, pos: str = "pos") -> DataFrame:
    return df.groupBy(pos).agg(F.count(value).alias("n"), F.sum(value).alias("s"), F.sum(F.col(value) * F.col(value)).alias("ss"))


def position_statistics(moments: DataFrame, least: int = 2, floor: float = 1e-6) -> DataFrame:
    """Mean and standard deviation by position; positions with few values take the pooled ones."""
    whole = W.partitionBy()
    n, s, ss = (F.sum(c).over(whole) for c in ("n", "s", "ss"))
    stat = lambda a, b, c: (b / a, F.sqrt(F.greatest(c / a - (b / a) * (b / a), F.lit(0.0))))
    pooled, own = stat(n, s, ss), stat(F.col("n"), F.col("s"), F.col("ss"))
    few = F.col("n") < least
    d = moments.withColumn("mean", F.when(few, pooled[0]).otherwise(own[0]))
    return d.withColumn("std", F.greatest(F.when(few, pooled[1]).otherwise(own[1]), F.lit(floor))).select("pos", "n", "mean", "std")


def z_scores(df: DataFrame, value: str) -> DataFrame:
    stats = position_statistics(position_moments(df, value)).select("pos", "mean", "std")
    return df.join(stats, "pos").withColumn("z", (F.col(value) - F.col("mean")) / F.col("std")).drop("mean", "std")


def uniform_attention(df: DataFrame, mass: str) -> DataFrame:
    """Log mass over what uniform attention gives a position, moved one to the left."""
    after = W.partitionBy(ROW).orderBy(F.col("pos").desc()).rowsBetween(W.unboundedPreceding, 0)
    d = df.withColumn("_u", F.sum(1 / (F.col("pos") + 1)).over(after)).withColumn("_l", F.ln(F.col(mass) / F.col("_u")))
    return d.withColumn("aligned", F.lead("_l").over(W.partitionBy(ROW).orderBy("pos"))).drop("_u", "_l")


def ema(df: DataFrame, key: str, step: str, value: str, alpha: float) -> DataFrame:
    """Exponential average in step order by key, with bias correction: the recursion written out, so that a value's
    share depends on its rank alone and groups are summed in parts."""
    d = with_totals(ranked(df.select(key, step, value), [step, value], [key], "_rank"), {"_n": F.count("*")}, [key])
    share = alpha * F.power(F.lit(1 - alpha), F.col("_n") - F.col("_rank"))
    g = d.groupBy(key).agg(F.count("*").alias("n"), F.sum(F.col(value).cast("double") * share).alias("m"))
    return g.select(key, "n", (F.col("m") / (1 - F.power(F.lit(1 - alpha), F.col("n")))).alias("ema"))


def keep_rate_bins(df: DataFrame, width: int, low: float, high: float) -> DataFrame:
    """Share of valid tokens kept by bin of positions, and whether it lies within bounds; a bin without any doesn't."""
    g = df.groupBy(F.floor(F.col("pos") / width).cast("long").alias("bin")).agg(F.count_if("valid").alias("valid"), F.count_if(F.col("valid") & (F.col("weight") == 1)).alias("kept"))
    rate = F.try_divide("kept", "valid")
    return g.withColumn("rate", rate).withColumn("within", F.coalesce(F.col("rate").between(low, high), F.lit(False)))


def planned_weight(df: DataFrame, fraction: float) -> DataFrame:
    """The weight that a selection is planned to have: the sum of what each instance keeps."""
    each = df.groupBy(ROW).agg(F.count_if("valid").alias("_n"))
    return each.agg(F.sum(keep_count(F.col("_n"), fraction)).cast("long").alias("planned"), F.count("*").alias("instances"))


def gather(table: DataFrame, wanted: DataFrame, key: str = ROW) -> DataFrame:
    """Rows of a table by id, for every wanted one; an id that the table hasn't raises."""
    from .gates import require

    require(wanted.join(table, key, "left_anti").select(key), "rows that the table hasn't")
    return wanted.select(key).distinct().join(table, key)


def weighted_loss(df: DataFrame, loss: str, planned: float | None = None) -> DataFrame:
    """Mean loss of the chosen tokens; a sum of weights that isn't the planned one raises."""
    out = df.agg((F.sum(F.col(loss) * F.col("weight")) / F.sum("weight")).alias("loss"), F.sum("weight").alias("weight"))
    if planned is not None:
        got = out.first().weight
        if abs(got - planned) > 1e-4 * max(1.0, planned):
            raise ValueError(f"planned a weight of {planned}, got {got}")
    return out


def agreement(a: DataFrame, b: DataFrame) -> DataFrame:
    j = a.select(ROW, "pos", F.col("weight").alias("_a")).join(b.select(ROW, "pos", F.col("weight").alias("_b")), [ROW, "pos"])
    return j.agg(F.avg((F.col("_a") == F.col("_b")).cast("double")).alias("agreement"), F.count("*").alias("n"))
