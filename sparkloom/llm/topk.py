"""Exact top-k by inner product with a pivot table.

Every vector stores its distances to PIVOTS fixed vectors and the origin. Candidates that are near the same pivot form
cells of CELL rows, and a cell stores the least and largest of its distances. For a query the largest gap between its
own distance to a pivot and a cell's range bounds the distance to the cell's candidates from below, and so their inner
product from above. Cells are evaluated in the order of that bound until no remaining bound reaches the k-th score: the
rest are eliminated, nothing is missed.

The k-th score of each query among PILOTS candidates is known before any search and holds for all of them, so whole
pivot groups of candidates whose bound is below it never meet the query. Queries of near pivot groups and the candidates
of another meet in blocks of bounded size, and candidates are copied only to blocks of queries that need their group;
each pair of blocks keeps k rows a query, and the blocks' results are ranked together. Every query may have to meet
every candidate, so the work grows with their product where bounds don't part them.

Vectors longer than HUGE, whose squares could overflow, are a group without bounds: they meet all, and all meet them.

Defined results: candidates are all rows but the query's own, so rows that share an id, or have none (null), are
candidates each, and each row whose id is divisible is a query of its own; null vectors and vectors with null, NaN or
infinite components take no part; vectors of different lengths have no score with each other; equal scores rank by
smaller id, null last; a score that doesn't fit a long is the nearest long, and ranks as such; a component that is no
double once scaled is the largest double of its sign; an empty table gives no rows.
"""

from __future__ import annotations

from math import ceil

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import checkpoint
from .vectors import EXACT, HUGE, LOW, matrices, scores, spans, usable, whole

#: Vectors with the smallest hashes serve as pivots and pilots: bounded samples; every row is indexed against the pivots.
PIVOTS, PILOTS = 24, 2048
QUERY_BLOCK, CANDIDATE_BLOCK = 2048, 16384
#: Candidates that share a bound.
CELL = 64
#: Above any rounding of a bound.
SLACK = 1e-9

#: Groups of rows that no pivot can bound: other lengths than most, and huge vectors.
ODD, VAST = -1, -2
#: Most rows of the list of groups that blocks of queries need that is sent to every executor.
LISTED = 1_000_000

_ROW = "key long, id long, none boolean, n long, v array<double>, dist array<double>, grp int"
_KEPT = ["key", "id", "none", "n"]


def distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Distances of the rows of x to the origin and the pivots of the same length, one row of the result each."""
    if pivots.shape[1] != x.shape[1]:
        pivots = pivots[:0, :0].reshape(0, x.shape[1])
    return np.array([np.sqrt((x * x).sum(1))] + [np.sqrt(((x - p) ** 2).sum(1)) for p in pivots])


def bounds(q: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Upper bounds of inner products: a row a query and a column a cell. q: distances of queries, one column each;
    low, high: ranges of the cells' distances, one column each. Row 0 is the distance to the origin."""
    gap = np.zeros((q.shape[1], low.shape[1]))
    for d, a, b in zip(q, low, high):
        np.maximum(gap, np.maximum(a - d[:, None], d[:, None] - b), out=gap)
    squares = q[0][:, None] ** 2 + high[0] ** 2
    return np.maximum((squares - gap * gap) / 2 + SLACK * squares + 1e-6, LOW)  # scores end there too


def search_block(q: dict[str, np.ndarray], c: dict[str, np.ndarray], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of q and c, and their scores, among which are each query's k best candidates. Both hold v (vectors of one
    length, whole numbers), dist (a column a row) and key; q a floor, a score that the k-th best is known to reach; c its
    id, none (whether it has no id) and n, how many equal rows it stands for."""
    dist = c["dist"]
    order = np.lexsort((dist[0], dist[1:].argmin(0))) if len(dist) > 1 else np.argsort(dist[0], kind="stable")
    cells = np.arange(0, len(order), CELL)
    top = np.full((len(q["v"]), len(cells)), np.inf)
    fit = np.flatnonzero(spans(q["v"]) < HUGE)
    if spans(c["v"]).max() < HUGE:
        low, high = (f.reduceat(dist[:, order], cells, axis=1) for f in (np.minimum, np.maximum))
        top[fit] = bounds(q["dist"][:, fit], low, high)
    plain = min(spans(q["v"]).max(), HUGE) * min(spans(c["v"]).max(), HUGE) < EXACT
    rows, found, reached = [], [], []
    for i in range(len(top)):
        rank = np.argsort(-top[i], kind="stable")
        rank = rank[top[i][rank] >= q["floor"][i]]
        best_s, best_j, at, step = np.zeros(0, np.int64), np.zeros(0, np.int64), 0, 2
        while at < len(rank) and (len(best_s) < k or top[i][rank[at]] >= best_s[-1]):
            j = np.concatenate([order[x : x + CELL] for x in cells[rank[at : at + step]]])
            j = j[(c["key"][j] != q["key"][i]) | (c["n"][j] > 1)]  # not the query's own row, unless others equal it
            best_s, best_j = np.r_[best_s, (c["v"][j] @ q["v"][i]).astype(np.int64) if plain else scores(q["v"][i : i + 1], c["v"][j])[0]], np.r_[best_j, j]
            best = np.lexsort((c["id"][best_j], c["none"][best_j], ~best_s))[:k]
            best_s, best_j = best_s[best], best_j[best]
            at, step = at + step, step * 2
        rows += [i] * len(best_j)
        found += best_j.tolist()
        reached += best_s.tolist()
    return np.array(rows, np.int64), np.array(found, np.int64), np.array(reached, np.int64)


def top_k(df: DataFrame, k: int = 5, every: int = 50, scale: float = 256.0, vec_id: str = "vec_id", vec: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: for every row whose id is divisible by `every` the k best other rows by integer
    inner product of floor(scale * x)."""
    own = df.select(F.col(f"`{vec_id}`").cast("long").alias("id"), F.col(f"`{vec}`").alias("v")).where(usable(F.col("v"))).withColumn("key", F.xxhash64("id", "v"))
    sample = [r.v for r in own.orderBy(F.xxhash64("key"), "key").select("v").limit(PILOTS).collect()]
    size = max(map(len, sample), key=[len(v) for v in sample].count, default=0)
    pilots = whole([v for v in sample if len(v) == size], scale).reshape(-1, size) if sample else np.zeros((0, 1))
    pilots = pilots[spans(pilots) < HUGE]
    pivots = pilots[:PIVOTS]
    # rows equal in id and vector are one row that counts n times
    rows = own.groupBy("id", "v").agg(F.count("*").alias("n"), F.first("key").alias("key"))
    rows = rows.select("key", F.coalesce("id", F.lit(0).cast("long")).alias("id"), F.col("id").isNull().alias("none"), "n", "v")

    def index(frames):
        for f in frames:
            for own, x in matrices(f):
                x = whole(x, scale)
                vast = spans(x) >= HUGE
                dist = distances(np.where(vast[:, None], 0.0, x), pivots)
                grp = dist[1:].argmin(0) if len(dist) > 1 else np.full(len(x), ODD)
                yield own[_KEPT].assign(v=list(x), dist=list(dist.T), grp=np.where(vast, VAST, grp).astype(np.int32))

    table = checkpoint(rows.mapInPandas(index, _ROW))
    is_query = ~F.col("none") & (F.pmod("id", F.lit(every)) == 0)
    # one row a pivot, PIVOTS + 2 at most
    ends = table.groupBy("grp").agg(F.count("*").alias("rows"), F.count_if(is_query).alias("queries"), *[f(F.get("dist", F.lit(i))).alias(f"{n}{i}") for i in range(len(pivots) + 1) for n, f in (("low", F.min), ("high", F.max))]).collect()
    parts = {r.grp: max(1, ceil(r["rows"] / CANDIDATE_BLOCK)) for r in ends}
    first, blocks, room = {}, {}, 0  # small groups of queries share a block
    for r in sorted(ends, key=lambda r: -r["queries"]):
        blocks[r.grp] = max(1, ceil(r["queries"] / QUERY_BLOCK))
        first[r.grp] = max((first[g] + blocks[g] for g in first), default=0) - (r["queries"] <= room)
        room = (room if r["queries"] <= room else blocks[r.grp] * QUERY_BLOCK if blocks[r.grp] == 1 else 0) - r["queries"]

    def route(frames):
        """Queries with the score that their k-th best candidate is known to reach, once for each block to search."""
        for f in frames:
            for own, x in matrices(f):
                dist, floor, fit = np.stack(own.dist.to_numpy()).T, np.full(len(x), LOW), np.flatnonzero(own.grp != VAST)
                if pilots.shape[1] == x.shape[1] and len(pilots) > k:
                    # one row more than k: the query itself may be a pilot
                    floor[fit] = np.partition(scores(x[fit], pilots), -k - 1, axis=1)[:, -k - 1]
                for r in ends:
                    if r.grp != VAST and (r.grp == ODD) != (len(dist) == 1):
                        continue
                    span = lambda n: np.array([[r[f"{n}{i}"]] for i in range(len(dist))])
                    hit = np.full(len(x), True)
                    if r.grp != VAST:
                        hit[fit] = bounds(dist[:, fit], span("low"), span("high"))[:, 0] >= floor[fit]
                    yield own[hit].assign(qg=own.grp[hit], grp=np.int32(r.grp), floor=floor[hit])

    of = lambda by, group: F.element_at(F.create_map(*[F.lit(x) for p in by.items() for x in p]), F.col(group)) if by else F.lit(1)
    queries = table.where(is_query).mapInPandas(route, f"{_ROW}, qg int, floor long")
    queries = checkpoint(queries.withColumn("qb", (of(first, "qg") + F.pmod(F.xxhash64("key", F.lit(0)), of(blocks, "qg"))).cast("int")).drop("qg"))
    needed = queries.select(F.col("qb").alias("_qb"), F.col("grp").alias("_grp")).distinct()
    needed = F.broadcast(needed) if sum(blocks.values()) * len(ends) <= LISTED else needed
    queries = queries.withColumn("sub", F.explode(F.sequence(F.lit(0), of(parts, "grp") - 1)))
    candidates = table.withColumn("sub", F.pmod(F.xxhash64("key"), of(parts, "grp")).cast("int")).join(needed, F.col("grp") == F.col("_grp"))
    candidates = candidates.withColumnRenamed("_qb", "qb").drop("_grp")

    def pair(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        side = lambda own, x: {n: own[n].to_numpy() for n in own if n not in ("v", "dist")} | {"v": x, "dist": np.stack(own.dist.to_numpy()).T}
        other = {x.shape[1]: side(own, x) for own, x in matrices(c)}
        found = []
        for a in (side(own, x) for own, x in matrices(q)):
            if a["v"].shape[1] in other:
                b = other[a["v"].shape[1]]
                i, j, score = search_block(a, b, k)
                times = np.minimum(k, b["n"][j] - (a["key"][i] == b["key"][j]))
                found.append(pd.DataFrame({"key": a["key"][i], "query_id": a["id"][i], "n": a["n"][i], "vec_id": b["id"][j], "none": b["none"][j], "score": score, "times": times}))
        return pd.concat(found) if found else pd.DataFrame({n: [] for n in ("key", "query_id", "n", "vec_id", "none", "score", "times")})

    on = ["grp", "sub", "qb"]
    found = queries.groupBy(*on).cogroup(candidates.groupBy(*on)).applyInPandas(pair, "key long, query_id long, n long, vec_id long, none boolean, score long, times long")
    found = found.withColumn("vec_id", F.when(~F.col("none"), F.col("vec_id")))
    place = W.partitionBy("query_id", "key").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last())
    again = lambda n: F.explode(F.sequence(F.lit(1).cast("long"), F.col(n)))
    ranked = found.withColumn("_", again("times")).withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k)
    return ranked.withColumn("_", again("n")).select("query_id", "rank", "vec_id", "score")


ORACLE = """
WITH v AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT q.r, q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.r <> q.r AND len(c.v) = len(q.v)),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id NULLS LAST) AS INT) AS rank, vec_id, score FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
