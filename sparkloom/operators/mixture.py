"""Mixture laws: loss as a function of domain weights, fits, optima, and weight updates from an adjacency matrix."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkloom.staging import checkpoint, with_each


def law(c: Column, k: Column, t: Column, r: Column) -> Column:
    """c + k * exp(sum t_i r_i), the exponent held to +-60; t and r are arrays."""
    dot = F.aggregate(F.zip_with(t, r, lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    return c + k * F.exp(F.greatest(F.lit(-60.0), F.least(F.lit(60.0), dot)))


def check_simplex(mixes: DataFrame, tolerance: float = 2e-3) -> DataFrame:
    """(mix_id, domain, weight) with weights scaled to sum 1; negative or non-finite weights, sums off by more than the
    tolerance and repeated domains raise."""
    bad = mixes.groupBy("mix_id").agg(F.sum("weight").alias("s"), F.min("weight").alias("lo"), F.count("*").alias("n"), F.countDistinct("domain").alias("d"))
    bad = bad.where((F.abs(F.col("s") - 1) > tolerance) | (F.col("lo") < 0) | F.col("s").isNull() | F.isnan("s") | (F.col("n") != F.col("d")))
    if not bad.isEmpty():
        raise ValueError("a mixture isn't a point of the simplex")
    return mixes.withColumn("weight", F.col("weight") / F.sum("weight").over(W.partitionBy("mix_id")))


def load_mixtures(spark, path: str) -> DataFrame:
    """A JSON file {mixture: {domain: weight}} -> (mix_id, domain, weight), checked and scaled; repeated names raise."""
    import json

    raw = "\n".join(r.value for r in spark.read.text(path, wholetext=True).collect())  # a configuration file

    def once(pairs):
        if len({k for k, _ in pairs}) < len(pairs):
            raise ValueError("a name comes twice")
        return dict(pairs)

    found = json.loads(raw, object_pairs_hook=once)
    rows = [(m, d, float(w)) for m, ws in found.items() for d, w in ws.items()]
    return check_simplex(spark.createDataFrame(rows, "mix_id string, domain string, weight double"))


def registered(mixes: DataFrame, name: str) -> DataFrame:
    """One mixture of a registry; an unknown name raises."""
    found = mixes.where(F.col("mix_id") == name)
    if found.isEmpty():
        raise KeyError(f"no mixture {name!r}")
    return found


def macro_predictions(mixes: DataFrame, laws: DataFrame, mix: str = "mix_id", r: str = "r") -> DataFrame:
    """Mean over families of the predicted losses of each mixture. laws has a row a family."""
    each = with_each(mixes, laws).select(mix, law(F.col("c"), F.col("k"), F.col("t"), F.col(r)).alias("_p"))
    return each.groupBy(mix).agg(F.avg("_p").alias("macro"))


def _solve(r: np.ndarray, y: np.ndarray, start: np.ndarray, delta: float, rounds: int = 200) -> tuple[np.ndarray, float]:
    """Levenberg-Marquardt on Huber-weighted residuals; parameters ln c, ln k, t."""
    p, damp = start.copy(), 1e-2

    def res(p):
        e = np.exp(np.clip(r @ p[2:], -60, 60) + p[1])
        return np.exp(p[0]) + e - y, e

    def cost(d):
        a = np.abs(d)
        return float(np.where(a <= delta, 0.5 * a * a, delta * (a - 0.5 * delta)).sum())

    d, e = res(p)
    now = cost(d)
    for _ in range(rounds):
        j = np.c_[np.full(len(y), np.exp(p[0])), e, e[:, None] * r]
        w = np.minimum(1.0, delta / np.maximum(np.abs(d), 1e-12))
        h, g = (j * w[:, None]).T @ j, (j * w[:, None]).T @ d
        step = np.linalg.solve(h + damp * np.diag(np.maximum(np.diag(h), 1e-9)), -g)
        new = np.clip(p + step, -50, 50)
        d2, e2 = res(new)
        if (c := cost(d2)) < now:
            done = now - c < 1e-14 * max(now, 1e-300)
            p, d, e, now, damp = new, d2, e2, c, max(damp / 3, 1e-12)
            if done:
                break
        else:
            damp *= 4
            if damp > 1e12:
                break
    return p, now


def fit_law(runs: DataFrame, domains: int, starts: int = 12, delta: float = 0.02, seed: int = 0) -> DataFrame:
    """runs: family, r (array), y -> one row a family: c, k, t, rmse. Several starts; each family is one small task."""
    def fit(g: pd.DataFrame) -> pd.DataFrame:
        r, y = np.stack(g.r.to_numpy()), g.y.to_numpy(float)
        rng, best = np.random.default_rng(seed), None
        for i in range(starts):
            low = y.min() * (0.5 + 0.45 * rng.random())
            start = np.r_[np.log(max(low, 1e-6)), np.log(max(y.mean() - low, 1e-6)), rng.normal(0, 0.3, domains) * (i > 0)]
            p, cost = _solve(r, y, start, delta)
            if best is None or cost < best[1]:
                best = (p, cost)
        p = best[0]
        e = np.exp(p[0]) + np.exp(p[1] + np.clip(r @ p[2:], -60, 60)) - y
        return pd.DataFrame({"family": [g.family.iloc[0]], "c": [np.exp(p[0])], "k": [np.exp(p[1])], "t": [p[2:].tolist()], "rmse": [float(np.sqrt((e * e).mean()))]})

    return runs.select(F.col("family").cast("string"), "r", F.col("y").cast("double")).groupBy("family").applyInPandas(fit, "family string, c double, k double, t array<double>, rmse double")


def leave_one_out(runs: DataFrame, domains: int, **options) -> DataFrame:
    """family, run, actual, predicted: every run predicted by a fit on the others."""
    ids = runs.select(F.col("run").alias("fold")).distinct()
    folds = runs.join(ids, F.col("run") != F.col("fold"))
    keyed = folds.withColumn("family", F.concat_ws("\x1f", "family", "fold"))
    fits = fit_law(keyed, domains, **options).select(F.split("family", "\x1f")[0].alias("family"), F.split("family", "\x1f")[1].alias("run"), "c", "k", "t")
    return runs.withColumn("run", F.col("run").cast("string")).join(fits, ["family", "run"]).select("family", "run", F.col("y").alias("actual"), law(F.col("c"), F.col("k"), F.col("t"), F.col("r")).alias("predicted"))


def _project(w: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The nearest point of the simplex between bounds, of each row, by bisection on the shift."""
    a, b = (w - high).min(-1, keepdims=True) - 1, (w - low).max(-1, keepdims=True) + 1
    for _ in range(100):
        m = (a + b) / 2
        over = np.clip(w - m, low, high).sum(-1, keepdims=True) > 1
        a, b = np.where(over, m, a), np.where(over, b, m)
    return np.clip(w - (a + b) / 2, low, high)


def _polish(rows: list[tuple], low: float, high: float, domains: int):
    """A mapInPandas function (w -> w, loss): projected gradient from each row's mixture. rows: c, k and t of each family."""
    c, k, t = np.array([r[0] for r in rows]), np.array([r[1] for r in rows]), np.array([r[2] for r in rows])
    lo, hi = np.full(domains, low), np.full(domains, high)
    value = lambda w: float((c + k * np.exp(np.clip(t @ w, -60, 60))).mean())

    def polish(frames):
        for f in frames:
            out = []
            for w in f.w:
                w, rate = _project(np.asarray(w, float), lo, hi), 0.5
                now = value(w)
                while rate > 1e-9:
                    new = _project(w - rate * ((k * np.exp(np.clip(t @ w, -60, 60)))[:, None] * t).mean(0), lo, hi)
                    if value(new) < now - 1e-15:
                        w, now, rate = new, value(new), rate * 1.3
                    else:
                        rate /= 3
                out.append((w.tolist(), now))
            yield pd.DataFrame(out, columns=["w", "loss"])

    return polish


def _families(laws: DataFrame) -> list[tuple]:
    """Laws as rows for all tasks: a row a family."""
    return [(float(r.c), float(r.k), [float(x) for x in r.t]) for r in laws.orderBy("family").collect()]


def optimise(laws: DataFrame, domains: int, low: float = 0.0, high: float = 1.0, starts: int = 16, seed: int = 0) -> DataFrame:
    """(ord, weight, loss): the mixture with the least mean predicted loss over all families: projected gradient from an even
    mixture and random ones, each start a row of its own."""
    spark = laws.sparkSession
    even = spark.range(1).select(F.array(*[F.lit(1.0 / domains)] * domains).alias("w"))
    begin = even.unionByName(simplex_candidates(spark, starts - 1, domains, seed, low, high).select("w")).repartition(starts)
    best = begin.mapInPandas(_polish(_families(laws), low, high, domains), "w array<double>, loss double").orderBy("loss", "w").limit(1)
    return best.select(F.posexplode("w").alias("ord", "weight"), "loss").select(F.col("ord").cast("long").alias("ord"), "weight", "loss")


def simplex_points(df: DataFrame, key: str, domains: int, seed: int, low: float = 0.0, high: float = 1.0, out: str = "w") -> DataFrame:
    """df with a flat Dirichlet point for each row, from uniforms keyed by seed and key, moved between bounds."""
    from .selection import uniform

    raw = F.transform(F.sequence(F.lit(0), F.lit(domains - 1)), lambda i: -F.ln(1 - uniform("dirichlet", seed, F.col(key), i)))
    w = F.transform("_e", lambda x: x / F.aggregate("_e", F.lit(0.0), lambda s, y: s + y))
    df = df.withColumn("_e", raw).withColumn(out, w).drop("_e")
    if low <= 0 and high >= 1:
        return df

    def move(frames):
        for f in frames:
            yield f.assign(**{out: list(_project(np.stack(f[out].to_numpy()).astype(float), np.full(domains, low), np.full(domains, high)))}) if len(f) else f

    return df.mapInPandas(move, df.schema)


def simplex_candidates(spark, n: int, domains: int, seed: int, low: float = 0.0, high: float = 1.0) -> DataFrame:
    """(id, w): n points of simplex_points."""
    return simplex_points(spark.range(n), "id", domains, seed, low, high)


def near_optimal(scored: DataFrame, band: float, keep: int, least_gap: float) -> DataFrame:
    """Up to `keep` mixtures within `band` of the best, each at least `least_gap` (L1) from those kept before; of equal
    rounded mixtures the first. A pass a mixture kept: the best of what is left, and then only what is far enough from it."""
    best = scored.agg(F.min("loss")).first()[0]
    near = scored.where(F.col("loss") <= best + band).withColumn("_key", F.transform("w", lambda x: F.bround(x, 2)))
    near = near.groupBy("_key").agg(F.min_by(F.struct(*scored.columns), F.struct("loss", "id")).alias("r")).select("r.*")
    left, kept = checkpoint(near), []
    while len(kept) < keep and (top := left.orderBy("loss", "id").limit(1).collect()):
        kept += top
        gap = F.zip_with("w", F.array(*[F.lit(float(x)) for x in top[0].w]), lambda a, b: F.abs(a - b))
        left = left.where((F.aggregate(gap, F.lit(0.0), lambda s, x: s + x) >= least_gap) & (F.struct("loss", "id") > F.struct(F.lit(top[0].loss), F.lit(top[0].id).cast(scored.schema["id"].dataType))))
    return scored.sparkSession.createDataFrame(kept, scored.schema)


def far_from(df: DataFrame, w: Column, references: list[list[float]], linf: float, l1: float) -> DataFrame:
    """Mixtures at least linf (largest difference) and l1 (sum of differences) from every reference."""
    ok = F.lit(True)
    for ref in references:
        gap = F.zip_with(w, F.array(*[F.lit(float(x)) for x in ref]), lambda a, b: F.abs(a - b))
        ok = ok & (F.array_max(gap) >= linf) & (F.aggregate(gap, F.lit(0.0), lambda s, x: s + x) >= l1)
    return df.where(ok)


def adjacency(probes: DataFrame, reference: DataFrame) -> DataFrame:
    """(domain, family, a): how far a probe on one domain brings a family's loss below the reference; never negative.
    A domain without a probe for a family has a null."""
    every = probes.select("domain").distinct().join(reference)
    got = every.join(probes, ["domain", "family"], "left")
    return got.select("domain", "family", F.when(F.col("loss").isNotNull(), F.greatest(F.lit(0.0), F.col("ref_loss") - F.col("loss"))).alias("a"))


def update_weights(weights: DataFrame, a: DataFrame, losses: DataFrame, eta: float) -> DataFrame:
    """p <- p * exp(eta * A L), scaled to sum 1; the largest exponent is taken off first."""
    pull = a.join(losses, "family").groupBy("domain").agg(F.sum(F.col("a") * F.col("loss")).alias("_s"))
    d = weights.join(pull, "domain", "left").withColumn("_x", F.coalesce(F.col("_s"), F.lit(0.0)) * eta)
    whole = W.partitionBy()
    d = d.withColumn("_w", F.col("p") * F.exp(F.col("_x") - F.max("_x").over(whole)))
    return d.select("domain", "p", (F.col("_w") / F.sum("_w").over(whole)).alias("p_after"))


def optimise_global(laws: DataFrame, domains: int, low: float, high: float, candidates: int = 50_000, polished: int = 32, refined: int = 16, seed: int = 0) -> DataFrame:
    """The mixture with the least mean predicted loss by random search: candidates are scored as rows, the best are
    polished, and perturbations of the best of these once more. laws has a row a family and is sent to all tasks."""
    rows, lo, hi, rng = _families(laws), np.full(domains, low), np.full(domains, high), np.random.default_rng(seed)
    polish = _polish(rows, low, high, domains)
    spark = laws.sparkSession
    mean = sum((law(F.lit(c), F.lit(k), F.array(*[F.lit(x) for x in t]), F.col("w")) for c, k, t in rows), F.lit(0.0)) / len(rows)
    start = simplex_candidates(spark, candidates, domains, seed, low, high).withColumn("_loss", mean).orderBy("_loss", "id").limit(polished)
    best = start.select("w").repartition(8).mapInPandas(polish, "w array<double>, loss double").orderBy("loss").first()
    near = [(_project(np.asarray(best.w) * np.exp(rng.normal(0, 0.03, domains)), lo, hi).tolist(),) for _ in range(refined)] + [(list(best.w),)]
    return spark.createDataFrame(near, "w array<double>").mapInPandas(polish, "w array<double>, loss double").orderBy("loss").limit(1)


def multiplied_weights(weights: DataFrame, a: DataFrame, losses: DataFrame, eta: float) -> DataFrame:
    """update_weights as a product that is scaled afterwards, with its checks: the weights are a point of the simplex,
    and adjacencies and losses are finite."""
    from .gates import require

    bad = lambda c: F.col(c).isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    require(a.where(bad("a") | (F.col("a") < 0)).select("domain", "family"), "adjacencies that are negative or not finite")
    require(losses.where(bad("loss")).select("family"), "losses that aren't finite")
    total = weights.agg(F.sum("p"), F.min("p")).first()
    if total[0] is None or abs(total[0] - 1) > 1e-6 or total[1] < 0:
        raise ValueError("the weights aren't a point of the simplex")
    pull = a.join(losses, "family").groupBy("domain").agg(F.sum(F.col("a") * F.col("loss")).alias("_s"))
    d = weights.join(pull, "domain", "left").withColumn("_w", F.col("p") * F.exp(eta * F.coalesce("_s", F.lit(0.0))))
    return d.select("domain", "p", (F.col("_w") / F.sum("_w").over(W.partitionBy())).alias("p_after"))


def derivative_adjacency(t: Column, loss: Column, c: Column) -> Column:
    return F.greatest(F.lit(0.0), -t * (loss - c))
