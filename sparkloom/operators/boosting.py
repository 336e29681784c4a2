"""Gradient-boosted trees that grow leaf by leaf, for squared loss.

Features are put in bins and rows of equal bins become one cell (rows, sum of the target): a tree can't tell them apart,
so neither can a prediction. A leaf is described by its histogram, the rows and gradients of its cells by feature and bin,
which one pre-aggregated job gives. The leaf with the largest gain is split next; of its children only the one with fewer
rows is summed anew, the other is what is left of the parent.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.staging import checkpoint

#: Least gain of a split.
LEAST_GAIN = 1e-10


@dataclass(frozen=True)
class Settings:
    leaves: int = 7
    depth: int = 3
    rounds: int = 100
    rate: float = 0.05
    least_rows: int = 3
    l2: float = 1.0
    bins: int = 255


@dataclass
class Tree:
    """A leaf has a value; another node sends rows whose feature is in bins up to `bin` to the left."""

    value: float = 0.0
    feature: int = -1
    bin: int = 0
    left: Tree | None = None
    right: Tree | None = None

    def column(self, goes_left) -> Column:
        if self.left is None:
            return F.lit(self.value)
        return F.when(goes_left(self.feature, self.bin), self.left.column(goes_left)).otherwise(self.right.column(goes_left))


@dataclass
class Boosted:
    features: list[str]
    edges: list[list[float]]
    start: float
    trees: list[Tree] = field(default_factory=list)

    def predict(self, df: DataFrame, out: str = "prediction") -> DataFrame:
        """df with the prediction of each row, by column expressions."""
        left = lambda f, b: F.col(f"`{self.features[f]}`") <= self.edges[f][b]
        return df.withColumn(out, sum((t.column(left) for t in self.trees), F.lit(self.start)))


def best_split(rows: np.ndarray, gradients: np.ndarray, s: Settings) -> tuple[float, int, int]:
    """(gain, feature, bin) of the best split of a histogram (a row a feature, a column a bin); the first of equal ones."""
    n, g = rows.cumsum(1), gradients.cumsum(1)
    all_n, all_g = n[:, -1:], g[:, -1:]
    score = lambda g, n: g * g / np.maximum(n + s.l2, 1e-300)
    gain = score(g, n) + score(all_g - g, all_n - n) - score(all_g, all_n)
    gain[(n < max(s.least_rows, 1)) | (all_n - n < max(s.least_rows, 1))] = -np.inf
    f, b = np.unravel_index(int(gain.argmax()), gain.shape)
    return float(gain[f, b]), int(f), int(b)


def _histogram(cells: DataFrame, shape: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Rows and gradients by feature and bin: one row a feature and bin comes to the driver."""
    each = cells.select("n", (F.col("n") * F.col("f") - F.col("s")).alias("g"), F.posexplode("bins").alias("feature", "bin"))
    out = np.zeros((2, *shape))
    for r in each.groupBy("feature", "bin").agg(F.sum("n").alias("n"), F.sum("g").alias("g")).collect():
        out[:, r.feature, r.bin] = r.n, r.g
    return out[0], out[1]


def grow(cells: DataFrame, shape: tuple[int, int], s: Settings) -> Tree:
    """One tree for the gradients of cells (bins, n, s: sum of the target, f: prediction)."""
    goes_left = lambda f, b: F.col("bins")[f] <= b
    value = lambda h: -s.rate * float(h[1][0].sum()) / (float(h[0][0].sum()) + s.l2)
    whole = _histogram(cells, shape)
    root = Tree(value(whole))
    open_ = [(root, F.lit(True), whole, 0)]
    leaves = 1
    while leaves < s.leaves:
        found = [(best_split(*h, s), i) for i, (_, _, h, depth) in enumerate(open_) if depth < s.depth]
        (gain, f, b), i = max(found, key=lambda x: x[0][0], default=((0.0, 0, 0), 0))  # the first of equal gains
        if gain <= LEAST_GAIN:
            break
        node, where, h, depth = open_.pop(i)
        left = where & goes_left(f, b)
        right = where & ~goes_left(f, b)
        n_left = h[0][f, : b + 1].sum()
        small = _histogram(cells.where(left if 2 * n_left <= h[0][f].sum() else right), shape)
        rest = (h[0] - small[0], h[1] - small[1])
        parts = (small, rest) if 2 * n_left <= h[0][f].sum() else (rest, small)
        node.feature, node.bin, node.left, node.right = f, b, Tree(value(parts[0])), Tree(value(parts[1]))
        open_ += [(node.left, left, parts[0], depth + 1), (node.right, right, parts[1], depth + 1)]
        leaves += 1
    return root


def fit(train: DataFrame, features: list[str], target: str, settings: Settings = Settings()) -> Boosted:
    """Trees for rows whose features and target aren't null or NaN; without such rows it raises."""
    s = settings
    x = [F.col(f"`{f}`").cast("double") for f in features]
    known = train.select(*[c.alias(f"_{i}") for i, c in enumerate(x)], F.col(f"`{target}`").cast("double").alias("_y"))
    for c in known.columns:
        known = known.where(F.col(c).isNotNull() & ~F.isnan(c))
    cuts = [(i + 1) / s.bins for i in range(s.bins - 1)]
    about = known.agg(F.avg("_y").alias("y"), *[F.percentile_approx(f"_{i}", cuts, 10_000).alias(f"q{i}") for i in range(len(x))]).first()
    if about.y is None:
        raise ValueError("there are no rows to learn from")
    edges = [sorted(set(about[f"q{i}"])) for i in range(len(x))]
    below = lambda e, c: F.size(F.filter(F.lit(e), lambda v: v < c))
    placed = [below(e, F.col(f"_{i}")) for i, e in enumerate(edges)]
    cells = known.select(F.array(*placed).alias("bins"), "_y").groupBy("bins").agg(F.count("*").alias("n"), F.sum("_y").alias("s"))
    cells = checkpoint(cells.withColumn("f", F.lit(float(about.y))))
    shape = (len(x), max(len(e) for e in edges) + 1)
    model = Boosted(features, edges, float(about.y))
    for _ in range(s.rounds):
        tree = grow(cells, shape, s)
        if tree.left is None:
            break
        model.trees.append(tree)
        cells = checkpoint(cells.withColumn("f", F.col("f") + tree.column(lambda f, b: F.col("bins")[f] <= b)))
    return model


def grid_errors(runs: DataFrame, features: list[str], target: str, settings: list[Settings], folds: int, key: str) -> DataFrame:
    """(setting, leaves, depth, rounds, rate, least_rows, l2, rmse, mae): settings by their error on held-out folds of the
    key's hash, best first."""
    runs = checkpoint(runs.withColumn("_fold", F.pmod(F.xxhash64(key), F.lit(folds))))
    parts = []
    for k, s in enumerate(settings):
        for i in range(folds):
            e = F.col("_e") - F.col(target)
            held = fit(runs.where(F.col("_fold") != i), features, target, s).predict(runs.where(F.col("_fold") == i), "_e")
            r = held.agg(F.sum(e * e).alias("s"), F.sum(F.abs(e)).alias("a"), F.count(e).alias("n")).first()
            parts.append((k, s.leaves, s.depth, s.rounds, float(s.rate), s.least_rows, float(s.l2), r.s or 0.0, r.a or 0.0, r.n))
    names = ["setting", "leaves", "depth", "rounds", "rate", "least_rows", "l2"]
    d = runs.sparkSession.createDataFrame(parts, "setting int, leaves int, depth int, rounds int, rate double, least_rows int, l2 double, s double, a double, n long")
    return d.groupBy(*names).agg(F.sqrt(F.sum("s") / F.sum("n")).alias("rmse"), (F.sum("a") / F.sum("n")).alias("mae")).orderBy("rmse", "mae", "setting")
