"""Probe runs: per-item losses, subsets and resampling, step laws, extrapolation, and savings in steps."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkloom.functions.budgets import RMSE_SLACK

from .curves import crossing, interval, predict
from .sampling import hash_order


def item_losses(rows: DataFrame, batches: int = 16) -> DataFrame:
    """(label, doc, cont, loss, batch, ord) -> (label, doc, loss, complete) of items with continuation 0: its loss, and
    whether the continuations of the first batches are 0 to k - 1, itself included. Of repeats the first counts."""
    once = rows.groupBy("label", "doc", "cont").agg(F.min_by(F.struct("loss", "batch"), "ord").alias("r"))
    early, zero = F.col("r.batch") < batches, F.col("cont") == 0
    g = once.groupBy("label", "doc").agg(
        F.max(F.when(zero, F.col("r.loss"))).alias("loss"), F.count_if(zero).alias("_zero"), F.count_if(zero & early).alias("_early"),
        F.count_if(early).alias("_n"), F.max(F.when(early, F.col("cont"))).alias("_top"),
    )
    return g.where("_zero > 0").select("label", "doc", "loss", ((F.col("_early") > 0) & (F.col("_top") + 1 == F.col("_n"))).alias("complete"))


def first_items(df: DataFrame, n: int, by: str, order: str) -> DataFrame:
    """The first n items of each group; Spark keeps n rows of a group before it shuffles."""
    return df.withColumn("_n", F.row_number().over(W.partitionBy(by).orderBy(order))).where(F.col("_n") <= n).drop("_n")


def hash_sample(df: DataFrame, n: int, seed: int | str, *keys: Column) -> DataFrame:
    """n rows without replacement, the same in every run; every task keeps n."""
    return df.withColumn("_h", hash_order(seed, *keys)).orderBy("_h", *keys).limit(n).drop("_h")


def paired_draws(items: DataFrame, draws: int, seed: int, item: str = "item") -> DataFrame:
    """(draw, item, times): bootstrap samples of the items, as large as their number. Probes that join them are paired:
    each sees the same items in a draw. items is an evaluation's list, numbered in one task."""
    at = items.select(item, (F.row_number().over(W.orderBy(item)) - 1).cast("long").alias("_at"))
    n = items.count()
    slots = items.sparkSession.range(n).select(F.col("id").alias("slot"), F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("draw"))
    number = F.conv(F.substring(hash_order(seed, F.col("draw"), F.col("slot")), 1, 11), 16, 10).cast("long")
    picked = slots.select("draw", (number % n).alias("_at"))
    return picked.groupBy("draw", "_at").agg(F.count("*").alias("times")).join(at, "_at").select("draw", item, "times")


def draw_means(losses: DataFrame, draws: DataFrame, by: list[str], item: str = "item", loss: str = "loss") -> DataFrame:
    joined = losses.join(draws, item)
    return joined.groupBy(*by, "draw").agg((F.sum(F.col(loss) * F.col("times")) / F.sum("times")).alias("loss"))


def improvements(probes: DataFrame, reference: DataFrame, label: str = "label") -> DataFrame:
    """(probe, label, loss) against (label, loss): max(0, reference - loss)."""
    joined = probes.join(reference.select(label, F.col("loss").alias("_base")), label)
    return joined.select("probe", label, F.greatest(F.lit(0.0), F.col("_base") - F.col("loss")).alias("gain"))


def last_measured(df: DataFrame, by: str, step: str, value: str) -> DataFrame:
    return df.groupBy(by).agg(F.max_by(value, step).alias(value), F.max(step).alias(step))


def family_series(df: DataFrame, families: DataFrame, label: str = "label") -> DataFrame:
    """(step, label, loss) and (label, family, ord) -> (family, step, loss) of the first label that a step has."""
    return df.join(families, label).groupBy("family", "step").agg(F.min_by("loss", "ord").alias("loss"))


def matrix_rows(cells: DataFrame, row: str, column: str, value: str) -> DataFrame:
    """Cells -> one map for each row, by column name."""
    return cells.groupBy(row).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(column, value)))).alias("cells"))


def ordered_vector(values: DataFrame, names: list[str], name: str, value: str) -> list[float]:
    """The values of names in their order; a missing one raises. names is a fixed short list."""
    found = {r[0]: r[1] for r in values.where(F.col(name).isin(names)).select(name, value).collect()}
    if lacking := [n for n in names if found.get(n) is None]:
        raise ValueError(f"no value for {lacking}")
    return [found[n] for n in names]


def parsimonious(fits: DataFrame, by: str, slack: float = RMSE_SLACK) -> DataFrame:
    """Of the fits with an rmse up to slack times the best, the one with the least moderation."""
    near = fits.withColumn("_best", F.min("rmse").over(W.partitionBy(by))).where(F.col("rmse") <= F.col("_best") * slack).drop("_best")
    row = F.struct(*[c for c in near.columns if c != by])
    return near.groupBy(by).agg(F.min_by(row, F.struct("moderation", "rmse")).alias("_f")).select(by, "_f.*")


def _box(x: np.ndarray, y: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[float, np.ndarray]:
    """Least squares of y on (1, x) with both coefficients in a box: the free optimum, or the best point of an edge."""
    n, sx, sy, sxx, sxy = len(x), x.sum(), y.sum(), x @ x, x @ y
    tries, det = [], n * sxx - sx * sx
    if det > 1e-300:
        b = (n * sxy - sx * sy) / det
        tries.append(np.array([(sy - b * sx) / n, b]))
    if not tries or (tries[0] < low).any() or (tries[0] > high).any():
        tries = [np.array([a, np.clip((sxy - a * sx) / sxx, low[1], high[1])]) for a in (low[0], high[0])]
        tries += [np.array([np.clip((sy - b * sx) / n, low[0], high[0]), b]) for b in (low[1], high[1])]
    return min(((float(((p[0] + p[1] * x - y) ** 2).sum()), p) for p in tries), key=lambda f: f[0])


def fit_step_law(step: np.ndarray, loss: np.ndarray) -> tuple[float, float, float, float] | None:
    """(floor, scale, alpha, rmse) of loss = floor + scale * step^-alpha: least squares with alpha from 0.01 to 2, the
    floor from half the least loss to 1.001 times it, and the scale up to 50 times the span; none below five points."""
    if len(step) < 5:
        return None
    least = loss.min()
    low, high = np.array([least * 0.5, 0.0]), np.array([least * 1.001, max(loss.max() - least, 1e-3) * 50])
    at = lambda a: _box(step**-a, loss, low, high)
    grid = np.linspace(0.01, 2, 200)
    i = int(np.argmin([at(a)[0] for a in grid]))
    lo, hi = grid[max(0, i - 1)], grid[min(len(grid) - 1, i + 1)]
    for _ in range(60):  # thirds
        a, b = lo + (hi - lo) / 3, hi - (hi - lo) / 3
        lo, hi = (lo, b) if at(a)[0] <= at(b)[0] else (a, hi)
    alpha = (lo + hi) / 2
    sse, (floor, scale) = at(alpha)
    return float(floor), float(scale), float(alpha), float(np.sqrt(sse / len(step)))


def step_laws(points: DataFrame, *by: str) -> DataFrame:
    """A step law for each group of (step, loss) points, which is one curve; groups below five points give nulls."""
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in points.schema.fields if f.name in by)

    def fit(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("step")
        f = fit_step_law(g.step.to_numpy(float), g.loss.to_numpy(float)) or (None,) * 4
        return pd.DataFrame([[*(g[c].iloc[0] for c in by), *f, len(g), int(g.step.iloc[-1]), float(g.loss.iloc[-1])]], columns=[*by, "floor", "scale", "alpha", "rmse", "n_points", "measured_step", "measured"])

    schema = f"{fields}, floor double, scale double, alpha double, rmse double, n_points long, measured_step long, measured double"
    return points.select(*by, "step", "loss").groupBy(*by).applyInPandas(fit, schema)


def extrapolate(laws: DataFrame, step: int) -> DataFrame:
    """step_laws() with the loss expected at a later step and its difference from the last measured one."""
    at = predict(F.col("floor"), F.col("scale"), F.col("alpha"), F.lit(step))
    return laws.withColumn("expected", at).withColumn("delta", F.col("expected") - F.col("measured"))


def pooled_control(arms: DataFrame, value: str, *keys: str) -> DataFrame:
    """The mean of the arms' draws, draw by draw."""
    return arms.groupBy(*keys).agg(F.avg(value).alias(value), F.count("*").alias("arms"))


def saving(draws: DataFrame, final: int, overhead: float) -> DataFrame:
    """(run, a, b, alpha, target) draws -> share of the steps saved until the target's loss, with its interval, before
    and after the overhead, and the share of draws that get there in time. Draws that never do count in that share only."""
    at = crossing(F.col("a"), F.col("b"), F.col("alpha"), F.col("target"))
    d = draws.withColumn("_at", at)
    d = d.withColumn("saved", F.when(F.col("_at") < float("inf"), 1 - F.col("_at") / final))
    within = d.groupBy("run").agg(F.avg((F.col("_at") <= final).cast("double")).alias("within"), F.count("saved").alias("n_finite"))
    i = interval(d.where("saved is not null"), "run", "saved")
    net = [(F.col(c) - overhead).alias(f"net_{c}") for c in ("mean", "lo", "mid", "hi")]
    return within.join(i.select("*", *net), "run", "left")


def plausibility(mixes: DataFrame, value: str, low: float, high: float, limits: tuple[int, ...] = (3, 5, 10)) -> DataFrame:
    """Spread of predicted losses over mixtures, and how many leave the range of the observed ones."""
    v = F.col(value)
    inside = F.avg(v.between(low, high).cast("double")) * 100
    return mixes.agg(
        F.min(v).alias("min"), *[F.percentile(v, F.lit(p / 100)).alias(f"p{p}") for p in (5, 50, 95, 99)], F.max(v).alias("max"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"),
        inside.alias("pct_inside"), F.count_if(v < low).alias("n_below"), F.count_if(v > high).alias("n_above"), *[F.count_if(v > k).alias(f"n_gt_{k}") for k in limits],
    )
