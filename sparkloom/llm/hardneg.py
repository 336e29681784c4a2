"""Hard-negative mining by dual-tree search.

A tree of balls over a bounded sample sends every row to a leaf; balls are then fitted to all rows. Anchors and
candidates each are such a tree. A pair of nodes has an interval that holds the inner products of all their rows: the
centres' product, plus and minus what the radii allow. Pairs of leaves whose interval can't hold a wanted score are
dropped for the whole group of anchors at once, before any row is copied. What is left meets in blocks of bounded size,
each with trees of its own: a group of anchors takes only the candidate nodes that it still needs down to its children,
leaf pairs are scored exactly, and the scores found raise the group's floor.

Two searches: an anchor's positives are its best rows of its own label; its negatives are, for each positive, the best
rows of other labels in the band from low to high percent of the positive's score. Scores that an anchor reaches among
PILOTS sampled rows are floors from the beginning.

Candidates equal in vector and label have equal scores with every anchor, so the k + 1 of them with the smallest ids
give the same results as all (one may be the anchor itself): large groups of copies stay out of the search, losing
nothing.

Defined results: rows with a null label or vector, or with null, NaN or infinite components, take no part; rows that
share an id are rows of their own, and each row whose id is divisible is an anchor of its own; an anchor's own row is
neither positive nor negative, though a copy of it may be; rows without an id are candidates, last among ties; vectors
of different lengths have no score with each other; a score that doesn't fit a long is the nearest long; vectors of any
finite size count, those longer than HUGE without bounds; a negative positive score has no negatives; an empty table
gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import checkpoint
from .vectors import HIGH, HUGE, LOW, matrices, scores, spans, usable, whole

#: Rows with the smallest hashes that the tree is made of and that give floors: a bounded sample; every row is searched.
PILOTS = 2048
#: Sampled rows below which a node isn't split, and the most leaves of the tree.
SPLIT, LEAVES = 64, 64
ANCHOR_BLOCK, CANDIDATE_BLOCK = 4096, 8192
#: Rows of a leaf of a block's own tree.
ANCHOR_LEAF, CANDIDATE_LEAF = 32, 128
#: Above any rounding of an interval, as a share of the lengths' product.
SLACK = 1e-9
#: Leaves of rows that no tree can bound: other lengths than most, and huge vectors.
ODD, VAST = -1, -2

_ROW = "id long, none boolean, label long, v array<double>, leaf int, radius double"
_ANCHOR = ["anchor", "id", "label", "v", "leaf", "radius"]
_ANCHOR_ROW = "anchor long, id long, label long, v array<double>, leaf int, radius double, low array<long>, high array<long>, least long, most long"


class Tree:
    """Balls over rows of x: each node has a centre, a radius and either two children or rows."""

    def __init__(self, x: np.ndarray, most: int, leaves: int = 1 << 30):
        self.centre, self.radius, self.kids, self.rows = [], [], [], []
        todo, made = [(np.arange(len(x)), None)], 1
        while todo:
            rows, parent = todo.pop(0)
            here, own = len(self.kids), x[rows]
            centre = own.mean(0)
            gap = np.sqrt(((own - centre) ** 2).sum(1))
            self.centre.append(centre)
            self.radius.append(float(gap.max(initial=0.0)))
            self.kids.append([])
            self.rows.append(rows)
            if parent is not None:
                self.kids[parent].append(here)
            if len(rows) > most and self.radius[-1] > 0 and made < leaves:
                one = own[int(gap.argmax())]
                far = ((own - one) ** 2).sum(1)
                side = far - ((own - own[int(far.argmax())]) ** 2).sum(1)
                cut = side <= np.median(side)
                if cut.all():
                    cut = side < np.median(side)
                todo += [(rows[cut], here), (rows[~cut], here)]
                made += 1
        self.centre, self.radius = np.array(self.centre).reshape(len(self.kids), x.shape[1]), np.array(self.radius)

    def leaf_of(self, x: np.ndarray) -> np.ndarray:
        """The leaf that each row of x descends to: at each node the child with the nearer centre."""
        at = np.zeros(len(x), np.int64)
        for node, kids in enumerate(self.kids):  # parents come before their children
            here = np.flatnonzero(at == node)
            if kids and len(here):
                gap = [((x[here] - self.centre[k]) ** 2).sum(1) for k in kids]
                at[here] = np.where(gap[1] < gap[0], kids[1], kids[0])
        return at


def interval(a: np.ndarray, ra: np.ndarray, b: np.ndarray, rb: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest inner product of rows within ra of centres a and within rb of centres b: a row for each of a, a
    column for each of b."""
    la, lb = np.sqrt((a * a).sum(1))[:, None], np.sqrt((b * b).sum(1))
    middle = a @ b.T
    reach = la * rb + lb * ra[:, None] + ra[:, None] * rb
    reach = reach + SLACK * (la + ra[:, None]) * (lb + rb) + 1e-6
    # scores end at the longs, and so do intervals
    return np.minimum(middle - reach, np.nextafter(2.0**63, 0)), np.maximum(middle + reach, -(2.0**63))


class Best:
    """The k best candidates of each anchor's bands (least and largest score): by score, rows with an id first, id."""

    def __init__(self, low: np.ndarray, high: np.ndarray, k: int):
        self.low, self.high, self.k = low, high, k
        self.found = [[[] for _ in range(low.shape[1])] for _ in range(len(low))]

    def add(self, anchors: np.ndarray, rows: np.ndarray, s: np.ndarray, wanted: np.ndarray, none: np.ndarray, ids: np.ndarray) -> None:
        for b in range(self.low.shape[1]):
            hit = wanted & (s >= self.low[anchors, b][:, None]) & (s <= self.high[anchors, b][:, None])
            for i in np.flatnonzero(hit.any(1)):
                j = np.flatnonzero(hit[i])
                if len(j) > self.k:  # those below the k-th score can't count
                    j = j[s[i, j] >= np.partition(s[i, j], -self.k)[-self.k]]
                own = self.found[anchors[i]][b]
                own = sorted([*own, *((-int(s[i, x]), bool(none[rows[x]]), int(ids[rows[x]]), int(rows[x])) for x in j)])[: self.k]
                self.found[anchors[i]][b] = own
                if len(own) == self.k:
                    self.low[anchors[i], b] = max(self.low[anchors[i], b], -own[-1][0])


def search(a: dict[str, np.ndarray], c: dict[str, np.ndarray], same: bool, low: np.ndarray, high: np.ndarray, k: int) -> Best:
    """Best candidates of c for each anchor of a, of its own label (same) or of others, with scores in its bands. Both
    hold v, id, none and label; c also nth: how many equal rows come before a row (the first may be an anchor's own)."""
    best = Best(low, high, k)
    every = np.arange(len(c["id"]))

    def leaf_pair(i: np.ndarray, j: np.ndarray) -> None:
        s = scores(a["v"][i], c["v"][j])
        alike = a["label"][i][:, None] == c["label"][j]
        wanted = alike if same else ~alike
        if same:  # not the anchor's own row
            own = ~c["none"][j] & (c["nth"][j] == 0) & (a["id"][i][:, None] == c["id"][j])
            for x, y in zip(*np.nonzero(own & alike)):
                wanted[x, y] = not np.array_equal(a["v"][i[x]], c["v"][j[y]])
        best.add(i, j, s, wanted, c["none"], c["id"])

    if max(spans(a["v"]).max(), spans(c["v"]).max()) >= HUGE:
        for i in range(0, len(a["id"]), ANCHOR_LEAF):
            leaf_pair(np.arange(i, min(i + ANCHOR_LEAF, len(a["id"]))), every)
        return best
    tree, other = Tree(a["v"], ANCHOR_LEAF), Tree(c["v"], CANDIDATE_LEAF)
    ends = [(c["label"][r].min(), c["label"][r].max()) for r in other.rows]
    first, last = (np.array([e[x] for e in ends]) for x in (0, 1))

    def needed(node: int, some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Candidate nodes of some that a row of an anchor node may still need, and the upper ends of their intervals."""
        rows = tree.rows[node]
        least, most = interval(tree.centre[node : node + 1], tree.radius[node : node + 1], other.centre[some], other.radius[some])
        open_ = low[rows] <= high[rows]
        if not open_.any():
            return some[:0], most[0][:0]
        keep = (most[0] >= low[rows][open_].min()) & (least[0] <= high[rows][open_].max())
        labels = a["label"][rows]
        if same:
            keep &= (last[some] >= labels.min()) & (first[some] <= labels.max())
        elif labels.min() == labels.max():
            keep &= (first[some] != labels[0]) | (last[some] != labels[0])
        return some[keep], most[0][keep]

    def below(some: np.ndarray) -> np.ndarray:
        return np.array([y for x in some for y in (other.kids[x] or [x])], np.int64)

    def visit(node: int, some: np.ndarray) -> None:
        some = needed(node, some)[0]
        if tree.kids[node]:
            for kid in tree.kids[node]:
                visit(kid, below(some))
            return
        while any(other.kids[x] for x in some):
            some = needed(node, below(some))[0]
        some, most = needed(node, some)
        for x in some[np.argsort(-most, kind="stable")]:
            if len(needed(node, np.array([x]))[0]):  # floors have risen since
                leaf_pair(tree.rows[node], other.rows[x])

    visit(0, np.array([0]))
    return best


def _floored(anchors: DataFrame, floors) -> DataFrame:
    """anchors with the least and largest score of each band, low and high, and over all bands, least and most; anchors
    whose bands are all empty go. floors(rows, x) gives low and high."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for rows, x in matrices(f):
                low, high = floors(rows, x)
                open_ = low <= high
                least, most = np.where(open_, low, HIGH).min(1), np.where(open_, high, LOW).max(1)
                out = rows[_ANCHOR].assign(low=list(low), high=list(high), least=least, most=most)
                yield out[open_.any(1)]

    return anchors.mapInPandas(run, _ANCHOR_ROW)


def _cut(tree: Tree | None, leaves: dict[int, dict], most: int) -> tuple[dict[int, dict], dict[int, int]]:
    """What is known of each leaf -> the same of the highest nodes of at most `most` rows (or of leaves), and the node of
    each leaf. A node's ball holds its leaves' balls."""
    of, nodes = {leaf: leaf for leaf in leaves if leaf < 0}, {leaf: r for leaf, r in leaves.items() if leaf < 0}

    def below(node: int) -> list[int]:
        return [x for kid in tree.kids[node] for x in below(kid)] if tree.kids[node] else [node]

    todo = [0] if tree else []
    while todo:
        node = todo.pop()
        held = [x for x in below(node) if x in leaves]
        if sum(leaves[x]["n"] for x in held) > most and tree.kids[node]:
            todo += tree.kids[node]
        elif held:
            of |= dict.fromkeys(held, node)
            ends = {"n": sum, "first": min, "last": max, "least": min, "most": max}
            nodes[node] = {k: f([leaves[x][k] for x in held]) for k, f in ends.items() if k in leaves[held[0]]}
            nodes[node]["radius"] = max(float(np.sqrt(((tree.centre[x] - tree.centre[node]) ** 2).sum())) * (1 + SLACK) + leaves[x]["radius"] for x in held)
    return nodes, of


def _by(by: dict[int, object], of: Column) -> Column:
    return F.element_at(F.create_map(*[x for k, v in by.items() for x in (F.lit(k), F.lit(v))]), of) if by else F.lit(None)


def _search(anchors: DataFrame, candidates: DataFrame, tree: Tree, same: bool, k: int) -> DataFrame:
    """_floored() anchors -> (anchor, id, label, p, score, other, none): for each anchor and band p, from 1, the best
    candidates of each block: the k best overall are among them."""
    # a row a leaf, LEAVES + 2 at most
    of_leaf = lambda df, *more: {r.leaf: r.asDict() for r in df.groupBy("leaf").agg(F.count("*").alias("n"), F.max("radius").alias("radius"), F.min("label").alias("first"), F.max("label").alias("last"), *more).collect()}
    ours, our_group = _cut(tree, of_leaf(anchors, F.min("least").alias("least"), F.max("most").alias("most")), ANCHOR_BLOCK)
    theirs, their_group = _cut(tree, of_leaf(candidates), CANDIDATE_BLOCK)
    ball = lambda node, r: (tree.centre[node : node + 1], np.array([r["radius"]]))

    def met(g: int, h: int) -> bool:
        """Whether a group of anchors may need a group of candidates."""
        a, c = ours[g], theirs[h]
        alike = a["first"] == a["last"] == c["first"] == c["last"]
        if (g == ODD) != (h == ODD) or (not same and alike) or (same and (a["last"] < c["first"] or c["last"] < a["first"])):
            return False
        if g < 0 or h < 0:
            return True
        least, most = interval(*ball(g, a), *ball(h, c))
        return bool(most[0, 0] >= a["least"] and least[0, 0] <= a["most"])

    pairs = [(g, h) for g in ours for h in theirs if met(g, h)]
    other_of = {g: [h for x, h in pairs if x == g] for g in {g for g, _ in pairs}}
    group_of = {h: [g for g, x in pairs if x == h] for h in {h for _, h in pairs}}
    n_a = {g: max(1, ceil(r["n"] / ANCHOR_BLOCK)) for g, r in ours.items()}
    n_c = {h: max(1, ceil(r["n"] / CANDIDATE_BLOCK)) for h, r in theirs.items()}
    meetings = sum(n_a[g] * n_c[h] for g, h in pairs)
    parts = max(1, min(meetings, max(int(anchors.sparkSession.conf.get("spark.sql.shuffle.partitions")), meetings // 8)))
    on = ["g", "ab", "h", "cb"]
    block = lambda n, group: F.pmod(F.xxhash64("id", "label", "v"), _by(n, F.col(group))).cast("int")
    upto = lambda n, group: F.explode(F.sequence(F.lit(0), _by(n, F.col(group)) - 1))
    each = lambda groups, group: F.explode(_by(groups, F.col(group)).cast("array<int>"))
    a = anchors.withColumn("g", _by(our_group, F.col("leaf"))).withColumn("ab", block(n_a, "g")).withColumn("h", each(other_of, "g")).withColumn("cb", upto(n_c, "h")).repartition(parts, *on)
    c = candidates.withColumn("h", _by(their_group, F.col("leaf"))).withColumn("cb", block(n_c, "h")).withColumn("g", each(group_of, "h")).withColumn("ab", upto(n_a, "g")).repartition(parts, *on)

    def pair(a: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        side = lambda rows, x: {n: rows[n].to_numpy() for n in rows if n not in ("v", "low", "high")} | {"v": x}
        theirs, found = {x.shape[1]: side(rows, x) for rows, x in matrices(c)}, []
        for rows, x in matrices(a):
            if x.shape[1] in theirs:
                best = search(side(rows, x), theirs[x.shape[1]], same, np.stack(rows.low), np.stack(rows.high), k)
                found += [(anchor, i, label, p + 1, -s, other, none) for anchor, i, label, bands in zip(rows.anchor, rows.id, rows.label, best.found) for p, b in enumerate(bands) for s, none, other, _ in b]
        return pd.DataFrame(found, columns=["anchor", "id", "label", "p", "score", "other", "none"])

    return a.groupBy(*on).cogroup(c.groupBy(*on)).applyInPandas(pair, "anchor long, id long, label long, p int, score long, other long, none boolean")


def mine(df: DataFrame, positives: int = 5, negatives: int = 5, every: int = 100, band: tuple[int, int] = (80, 100), scale: float = 256.0, vec_id: str = "vec_id", vec: str = "embedding", label: str = "label") -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: for every row whose id is divisible by
    `every` and each of its best `positives` other rows of its label the best `negatives` rows of other labels that score
    from band[0] to band[1] percent of the positive. Scores: inner products of floor(scale * x)."""
    own = df.select(F.col(f"`{vec_id}`").cast("long").alias("id"), F.col(f"`{label}`").cast("long").alias("label"), F.col(f"`{vec}`").alias("v"))
    own = own.where(F.col("label").isNotNull() & usable(F.col("v")))
    sample = own.withColumn("h", F.xxhash64("id", "label", "v")).orderBy("h", "id", "label").limit(PILOTS).collect()
    lengths = [len(r.v) for r in sample]
    size = max(lengths, key=lengths.count, default=0)
    some = [r for r in sample if len(r.v) == size and spans(whole([r.v], scale))[0] < HUGE]
    pilots, pilot_label = whole([r.v for r in some], scale).reshape(len(some), size), np.array([r.label for r in some], np.int64)
    tree = Tree(pilots, SPLIT, LEAVES) if some else None

    def index(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for rows, x in matrices(f):
                x = whole(x, scale)
                leaf, radius = np.full(len(x), ODD), np.zeros(len(x))
                if x.shape[1] == size:
                    leaf[:] = VAST
                    fit = np.flatnonzero(spans(x) < HUGE)
                    if tree and len(fit):
                        leaf[fit] = tree.leaf_of(x[fit])
                        radius[fit] = np.sqrt(((x[fit] - tree.centre[leaf[fit]]) ** 2).sum(1))
                yield rows[["id", "none", "label"]].assign(v=list(x), leaf=leaf.astype(np.int32), radius=radius)

    named = own.select(F.coalesce("id", F.lit(0).cast("long")).alias("id"), F.col("id").isNull().alias("none"), "label", "v")
    table = checkpoint(named.mapInPandas(index, _ROW))
    equal, most = W.partitionBy("label", "v").orderBy("none", "id"), max(positives, negatives) + 1
    rows = table.withColumn("_place", F.row_number().over(equal)).withColumn("_rank", F.rank().over(equal)).where(F.col("_place") <= most)
    candidates = checkpoint(rows.withColumn("nth", F.col("_place") - F.col("_rank")).drop("_place", "_rank"))
    anchors = table.where(~F.col("none") & (F.pmod("id", F.lit(every)) == 0)).groupBy("id", "label", "v", "leaf", "radius").agg(F.count("*").alias("n"))
    anchors = checkpoint(anchors.withColumn("anchor", F.xxhash64("id", "label", "v")))

    def best_floor(rows: pd.DataFrame, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        low, fit = np.full((len(x), 1), LOW), np.flatnonzero(rows.leaf >= 0)
        if len(fit) and len(pilots) > positives:
            s = np.where(rows.label.to_numpy()[fit, None] == pilot_label, scores(x[fit], pilots), LOW)
            low[fit, 0] = np.partition(s, -positives - 1, axis=1)[:, -positives - 1]  # one more: the anchor may be a pilot
        return low, np.full((len(x), 1), HIGH)

    def band_floors(rows: pd.DataFrame, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        low, high = np.full((len(x), positives), HIGH), np.full((len(x), positives), LOW)
        for i, listed in enumerate(rows.scores):
            for b, y in enumerate(map(int, listed)):
                low[i, b], high[i, b] = -(-band[0] * y // 100), band[1] * y // 100
        fit = np.flatnonzero(rows.leaf >= 0)
        if len(fit) and len(pilots) >= negatives:
            s, other = scores(x[fit], pilots), rows.label.to_numpy()[fit, None] != pilot_label
            for b in range(positives):
                inside = np.where(other & (s >= low[fit, b][:, None]) & (s <= high[fit, b][:, None]), s, LOW)
                low[fit, b] = np.maximum(low[fit, b], np.partition(inside, -negatives, axis=1)[:, -negatives])
        return low, high

    key = ["anchor", "id", "label"]
    place = W.partitionBy(*key, "p").orderBy(F.col("score").desc(), "none", "other")
    named_id = F.when(~F.col("none"), F.col("other"))
    best = _search(checkpoint(_floored(anchors, best_floor)), candidates, tree, True, positives)
    best = best.withColumn("p", F.row_number().over(place)).where(F.col("p") <= positives)
    best = checkpoint(best.select(*key, "p", named_id.alias("positive_id"), F.col("score").alias("positive_score")))
    listed = best.groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.struct("p", "positive_score"))), lambda r: r.positive_score).alias("scores"))  # `positives` at most
    found = _search(checkpoint(_floored(anchors.join(listed, key), band_floors)), candidates, tree, False, negatives)
    found = found.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= negatives)
    found = found.select(*key, "p", "rank", named_id.alias("negative_id"), F.col("score").alias("negative_score"))
    both = best.join(found, [*key, "p"]).join(anchors.select(*key, "n"), key).withColumn("_", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))))
    return both.select(F.col("id").alias("anchor_id"), "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def with_shifted_labels(df: DataFrame, every: int = 7, labels: int = 10, vec_id: str = "vec_id", label: str = "label") -> DataFrame:
    """df with (label + 1) % labels where the id is divisible by `every`."""
    shifted = F.when(F.pmod(F.col(vec_id), F.lit(every)) == 0, (F.col(label) + 1) % labels).otherwise(F.col(label))
    return df.withColumn(label, shifted)


ORACLE = """
WITH v AS (SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                  list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
           WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.r, a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, CAST(list_dot_product(a.v, c.v) AS BIGINT) AS score, c.r AS cr
      FROM v a JOIN v c ON a.vec_id % 100 = 0 AND c.r <> a.r AND len(c.v) = len(a.v)),
p AS (SELECT r, anchor_id, vec_id AS positive_id, score AS positive_score, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id NULLS LAST, cr) AS p
      FROM s WHERE same QUALIFY p <= 5),
n AS (SELECT p.r, anchor_id, positive_id, positive_score, vec_id AS negative_id, score AS negative_score,
             CAST(row_number() OVER (PARTITION BY p.r, p ORDER BY score DESC, vec_id NULLS LAST, cr) AS INT) AS rank
      FROM p JOIN (SELECT r, vec_id, score, cr FROM s WHERE NOT same) s ON s.r = p.r AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5
"""
