"""Loss curves: power-law fits, bootstrap intervals, p-values, correlations."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkloom.staging import with_each


def alpha_grid(spark, n: int = 400, low: float = 0.05, high: float = 3.0) -> DataFrame:
    return spark.range(n).select((F.lit(low) + F.col("id") * ((high - low) / (n - 1))).alias("alpha"))


def profile_fit(points: DataFrame, grid: DataFrame, run: str = "run", step: str = "step", loss: str = "loss") -> DataFrame:
    """loss = a + b * step^-alpha: ordinary least squares at every alpha of the grid, and the one with the least
    squared error. The grid is a few hundred rows."""
    x, y = F.power(F.col(step).cast("double"), -F.col("alpha")), F.col(loss)
    crossed = with_each(points.select(run, step, loss), grid).withColumn("_x", x)
    fits = crossed.groupBy(run, "alpha").agg(
        F.regr_slope(y, F.col("_x")).alias("b"), F.regr_intercept(y, F.col("_x")).alias("a"),
        (F.regr_syy(y, F.col("_x")) - F.try_divide(F.power(F.regr_sxy(y, F.col("_x")), F.lit(2)), F.regr_sxx(y, F.col("_x")))).alias("sse"),
    )
    # a run of one step has no fit: nulls
    best = fits.groupBy(run).agg(F.min_by(F.struct("alpha", "a", "b", "sse"), F.when(F.col("sse").isNotNull(), F.struct("sse", "alpha"))).alias("f"))
    return best.select(run, "f.alpha", "f.a", "f.b", "f.sse")


def predict(a: Column, b: Column, alpha: Column, step: Column) -> Column:
    return a + b * F.power(step.cast("double"), -alpha)


def crossing(a: Column, b: Column, alpha: Column, target: Column) -> Column:
    """The step at which a fitted curve reaches a target; infinite if it never does."""
    return F.when((target > a) & (b > 0), F.power(b / (target - a), 1 / alpha)).otherwise(float("inf"))


def bootstrap(points: DataFrame, draws: int, final: float, seed: int = 0, n: int = 400, low: float = 0.05, high: float = 3.0, rescale: bool = False) -> DataFrame:
    """(run, draw, final): residual bootstrap with alpha fitted anew in every draw; one numpy batch a run and block."""
    grid = np.linspace(low, high, n)

    def fit(x, ys):
        """ys: draws as rows -> alpha, a, b of each. The least squared error is where the regression explains most."""
        t = x[:, None] ** -grid
        tc, mean = t - t.mean(0), ys.mean(1)
        norm = (tc * tc).sum(0)
        dot = (ys - mean[:, None]) @ tc
        best = (dot * dot / norm).argmax(1)
        b = dot[np.arange(len(ys)), best] / norm[best]
        return np.c_[grid[best], mean - b * t.mean(0)[best], b]

    def draw(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("step")
        x, y, block = g.step.to_numpy(float), g.loss.to_numpy(float), int(g.block.iloc[0])
        alpha, a, b = fit(x, y[None])[0]
        line = a + b * x**-alpha
        left = (y - line) * (np.sqrt(len(y) / max(1, len(y) - 3)) if rescale else 1)
        key = int.from_bytes(__import__("hashlib").sha256(f"{seed}:{g.run.iloc[0]}:{block}".encode()).digest()[:8])
        pick = np.random.default_rng(key).integers(0, len(y), (int(g["size"].iloc[0]), len(y)))
        f = np.concatenate([fit(x, line + left[pick[i : i + 2000]]) for i in range(0, len(pick), 2000)])
        return pd.DataFrame({"run": g.run.iloc[0], "draw": block * 10_000 + np.arange(len(f)), "final": f[:, 1] + f[:, 2] * final ** -f[:, 0]})

    blocks = points.sparkSession.range(-(-draws // 10_000)).select(F.col("id").alias("block"), F.least(F.lit(10_000), F.lit(draws) - F.col("id") * 10_000).cast("long").alias("size"))
    work = with_each(points.select(F.col("run").cast("string"), F.col("step").cast("double"), F.col("loss").cast("double")), blocks)
    return work.groupBy("run", "block").applyInPandas(draw, "run string, draw long, final double")


def interval(df: DataFrame, by: str, value: str) -> DataFrame:
    """Mean and the 2.5, 50 and 97.5 percentiles with linear interpolation."""
    p = lambda q: F.percentile(F.col(value), F.lit(q))
    return df.groupBy(by).agg(F.avg(value).alias("mean"), p(0.025).alias("lo"), p(0.5).alias("mid"), p(0.975).alias("hi"))


def p_values(diffs: DataFrame, value: str = "d") -> DataFrame:
    """Two- and one-sided empirical p-values with a floor of one draw, and the two-sided one without a floor."""
    d = F.col(value)
    up, down, n = F.avg((d >= 0).cast("double")), F.avg((d <= 0).cast("double")), F.count(d)
    two = F.least(2 * F.least(up, down), F.lit(1.0))
    return diffs.agg(F.greatest(two, 1 / n).alias("p_two"), F.greatest(F.least(up, down), 1 / n).alias("p_one"), two.alias("p_two_no_floor"), n.alias("n"))


def upper_median(value: str) -> Column:
    """Aggregate: the middle value, the upper of two; from counts of distinct values, not a list of all."""
    return F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY `{value}` DESC)")


def spearman(df: DataFrame, x: str, y: str, by: str) -> DataFrame:
    """Rank correlation with mean ranks for ties."""
    d = df
    for c in (x, y):
        d = d.withColumn(f"_rn_{c}", F.row_number().over(W.partitionBy(by).orderBy(c))).withColumn(f"_r_{c}", F.avg(f"_rn_{c}").over(W.partitionBy(by, c)))
    return d.groupBy(by).agg(F.corr(f"_r_{x}", f"_r_{y}").alias("rho"), F.count("*").alias("n"))


def errors(df: DataFrame, actual: str, predicted: str, by: str) -> DataFrame:
    e = F.col(predicted) - F.col(actual)
    return df.groupBy(by).agg(F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"), F.max(F.abs(e)).alias("max_abs"), F.stddev_pop(e).alias("sd"))


def complete_means(df: DataFrame, step: str, label: str, value: str, labels: list[str]) -> DataFrame:
    """Mean over exactly the given labels; steps that lack one are left out."""
    some = df.where(F.col(label).isin(labels) & F.col(value).isNotNull())
    return some.groupBy(step).agg(F.countDistinct(label).alias("_n"), F.avg(value).alias("macro")).where(F.col("_n") == len(labels)).drop("_n")


def family_macro(df: DataFrame, by: list[str], family: str, value: str) -> DataFrame:
    return df.groupBy(*by, family).agg(F.avg(value).alias("_m")).groupBy(*by).agg(F.avg("_m").alias("macro"))


def envelope(df: DataFrame, runs: int, step: str = "step", value: str = "loss") -> DataFrame:
    """Least and greatest value at the steps that all runs have."""
    return df.groupBy(step).agg(F.min(value).alias("lo"), F.max(value).alias("hi"), F.countDistinct("run").alias("_n")).where(F.col("_n") == runs).drop("_n")


def edge_value(df: DataFrame, at: float, step: str = "step", value: str = "loss", by: str = "run") -> DataFrame:
    """Linear interpolation at a step between the nearest points on its two sides."""
    p = F.struct(F.col(step).alias("s"), F.col(value).alias("v"))
    g = df.groupBy(by).agg(F.max_by(p, F.when(F.col(step) < at, F.col(step))).alias("l"), F.min_by(p, F.when(F.col(step) >= at, F.col(step))).alias("r"))
    share = (F.lit(at) - F.col("l.s")) / (F.col("r.s") - F.col("l.s"))
    return g.select(by, (F.col("l.v") + share * (F.col("r.v") - F.col("l.v"))).alias("at_edge"))


def pooled_fit(points: DataFrame, grid: DataFrame, runs: list[str], least: int = 0, name: str = "pooled") -> DataFrame:
    """One fit over the points of several runs together, from step `least` on."""
    some = points.where(F.col("run").isin(runs) & (F.col("step") >= least))
    return profile_fit(some.withColumn("run", F.lit(name)), grid)


def fit_arms(points: DataFrame, grid: DataFrame, controls: list[str], least: int, window: int) -> DataFrame:
    """A fit of every run, and one of the controls together; unexpected: whether a fit has other than `window` points."""
    used = points.where(F.col("step") >= least)
    n = used.groupBy("run").agg(F.count("*").alias("n_points"))
    n = n.unionByName(used.where(F.col("run").isin(controls)).agg(F.lit("control").alias("run"), F.count("*").alias("n_points")).select("run", "n_points"))
    fits = profile_fit(used, grid).unionByName(pooled_fit(points, grid, controls, least, "control"))
    expected = F.when(F.col("run") == "control", window * len(controls)).otherwise(window)
    return fits.join(n, "run").withColumn("unexpected", F.col("n_points") != expected)


def paired_differences(draws: DataFrame, arm: str, control: str) -> DataFrame:
    """draws (arm, draw, value) -> differences of two arms' draws of the same number."""
    a = draws.where(F.col("arm") == arm).select("draw", F.col("value").alias("_a"))
    b = draws.where(F.col("arm") == control).select("draw", F.col("value").alias("_b"))
    return a.join(b, "draw").select("draw", (F.col("_a") - F.col("_b")).alias("d"))


def subset_means(df: DataFrame, step: str, label: str, value: str, subsets: dict[str, list[str]]) -> DataFrame:
    """Mean over each subset of labels by step; null where a step lacks one of them."""
    means = [F.when(F.countDistinct(F.when(F.col(label).isin(s), F.col(label))) == len(s), F.avg(F.when(F.col(label).isin(s), F.col(value)))).alias(n) for n, s in subsets.items()]
    return df.groupBy(step).agg(*means)


def sign_counts(df: DataFrame, by: str) -> DataFrame:
    """df (by, delta, lo, hi), one row a label: labels better (below 0) and worse than the control, and those whose
    interval leaves 0 out."""
    n = lambda c: F.count_if(c)
    return df.groupBy(by).agg(n(F.col("delta") < 0).alias("better"), n(F.col("delta") > 0).alias("worse"), n(F.col("hi") < 0).alias("sure_better"), n(F.col("lo") > 0).alias("sure_worse"), F.count("*").alias("labels"))


def grid_rows(spark, values: dict[str, list[float]]) -> DataFrame:
    """Every combination of a few parameters' values, as rows."""
    import itertools

    rows = [tuple(float(x) for x in c) for c in itertools.product(*values.values())]
    return spark.createDataFrame(rows, ", ".join(f"{n} double" for n in values))


def complete_cells(df: DataFrame, row: str, column: str, value: str, rows: list[str], columns: list[str]) -> DataFrame:
    """A matrix of rows and columns; a cell that is missing or null raises."""
    from .gates import require

    some = df.where(F.col(row).isin(rows) & F.col(column).isin(columns))
    wide = some.groupBy(row).pivot(column, columns).agg(F.first(value))
    lost = F.greatest(*[F.col(f"`{c}`").isNull() for c in columns]) if len(columns) > 1 else F.col(f"`{columns[0]}`").isNull()
    require(wide.where(lost).select(row), "rows with missing cells")
    if wide.count() != len(rows):
        raise ValueError("rows are missing")
    return wide


def ladder(final: int, every: int = 125) -> list[int]:
    """Checkpoint steps: 0 and every `every`-th step up to final; a last gap under half a step width is closed by final."""
    steps = list(range(0, final + 1, every))
    if final - steps[-1] > 0:
        steps = (steps if final - steps[-1] >= every / 2 or len(steps) == 1 else steps[:-1]) + [final]
    return steps


def ladder_of(final: Column, every: int = 125) -> Column:
    """ladder() of a column of final steps, as an array."""
    rest = final % every
    short = (rest > 0) & (rest < every / 2) & (final >= every)
    steps = F.sequence(F.lit(0).cast("long"), F.when(short, final - rest - every).otherwise(final - rest), F.lit(every).cast("long"))
    return F.when(rest > 0, F.concat(steps, F.array(final))).otherwise(steps)
