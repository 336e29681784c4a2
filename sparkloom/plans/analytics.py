"""Registered queries over curves, mixtures and token scores. Events serve as measurements: a type is a run, a rank in
time is a step."""

from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkloom.operators import boosting, curves, gates, mixture, relational, selection
from sparkloom.staging import scratch, with_each
from sparkloom.streaming import logs

from .corpus import t

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return put


def points(spark: SparkSession, d: str) -> DataFrame:
    """(run, step, loss): mean price by brand and size."""
    p = t(spark, d, "part").groupBy(F.col("p_brand").alias("run"), F.col("p_size").cast("long").alias("step")).agg(F.avg("p_retailprice").alias("v"))
    return p.select("run", "step", (F.col("v") / 1000 + 3 / F.sqrt("step")).alias("loss"))


POINTS = "pts AS (SELECT run, step, v / 1000 + 3 / sqrt(step) AS loss FROM (SELECT p_brand AS run, CAST(p_size AS BIGINT) AS step, avg(p_retailprice) AS v FROM part GROUP BY 1, 2))"
FIT = f"""{POINTS}, grid AS (SELECT 0.05 + i * (2.95 / 399) AS alpha FROM range(400) g(i)),
fits AS (SELECT run, alpha, regr_slope(loss, x) AS b, regr_intercept(loss, x) AS a, regr_syy(loss, x) - regr_sxy(loss, x) ** 2 / regr_sxx(loss, x) AS sse FROM (SELECT run, alpha, loss, pow(CAST(step AS DOUBLE), -alpha) AS x FROM pts, grid) GROUP BY run, alpha),
best AS (SELECT run, arg_min(alpha, sse) AS alpha, arg_min(a, sse) AS a, arg_min(b, sse) AS b, min(sse) AS sse FROM fits GROUP BY run)"""


@query("ml11_alpha_profile_fit", f"WITH {FIT} SELECT run, round(alpha, 6) AS alpha, round(a, 6) AS a, round(b, 6) AS b, round(sse, 6) AS sse FROM best")
def alpha_profile_fit(spark, d):
    f = curves.profile_fit(points(spark, d), curves.alpha_grid(spark))
    return f.select("run", *[F.round(c, 6).alias(c) for c in ("alpha", "a", "b", "sse")])


@query("fn24_crossing", f"WITH {FIT} SELECT run, round(a + b * pow(100.0, -alpha), 6) AS at_100, CASE WHEN b > 0 THEN round(pow(b / (b * pow(100.0, -alpha)), 1 / alpha), 3) END AS back FROM best")
def crossing(spark, d):
    f = curves.profile_fit(points(spark, d), curves.alpha_grid(spark))
    at = curves.predict(F.col("a"), F.col("b"), F.col("alpha"), F.lit(100))
    back = curves.crossing(F.col("a"), F.col("b"), F.col("alpha"), F.col("a") + F.col("b") * F.power(F.lit(100.0), -F.col("alpha")))
    return f.select("run", F.round(at, 6).alias("at_100"), F.when(F.col("b") > 0, F.round(back, 3)).alias("back"))


@query("ml12_bootstrap_ci")
def bootstrap_ci(spark, d):
    return curves.interval(curves.bootstrap(points(spark, d), 10_000, 100.0, rescale=True), "run", "final")


@query("ag16_percentile_ci", "SELECT event_type, round(avg(value), 8) AS mean, round(quantile_cont(value, 0.025), 8) AS lo, round(quantile_cont(value, 0.5), 8) AS mid, round(quantile_cont(value, 0.975), 8) AS hi FROM events GROUP BY 1")
def percentile_ci(spark, d):
    i = curves.interval(t(spark, d, "events"), "event_type", "value")
    return i.select("event_type", *[F.round(c, 8).alias(c) for c in ("mean", "lo", "mid", "hi")])


@query("ag30_p_values", "WITH x AS (SELECT value - 50 AS d FROM events), s AS (SELECT avg(CASE WHEN d >= 0 THEN 1.0 ELSE 0.0 END) AS up, avg(CASE WHEN d <= 0 THEN 1.0 ELSE 0.0 END) AS down, count(*) AS n FROM x) SELECT round(greatest(least(2 * least(up, down), 1), 1.0 / n), 10) AS p_two, round(greatest(least(up, down), 1.0 / n), 10) AS p_one, round(least(2 * least(up, down), 1), 10) AS p_two_no_floor, n FROM s")
def p_values(spark, d):
    p = curves.p_values(t(spark, d, "events").select((F.col("value") - 50).alias("d")))
    return p.select(*[F.round(c, 10).alias(c) for c in ("p_two", "p_one", "p_two_no_floor")], "n")


@query("ag17_upper_median", "SELECT source, list_sort(list(n_chars))[len(list(n_chars)) // 2 + 1] AS mid FROM documents GROUP BY source")
def upper_median(spark, d):
    return t(spark, d, "documents").groupBy("source").agg(curves.upper_median("n_chars").cast("long").alias("mid"))


@query("ag18_pearson", "SELECT l_returnflag, round(corr(l_quantity, l_extendedprice), 8) AS r, CAST(count(*) FILTER (sign(l_quantity - 25) <> sign(l_discount - 0.05)) AS BIGINT) AS disagree, round(max(abs(l_discount - l_tax)), 8) AS max_abs FROM lineitem GROUP BY 1")
def pearson(spark, d):
    return t(spark, d, "lineitem").groupBy("l_returnflag").agg(
        F.round(F.corr("l_quantity", "l_extendedprice"), 8).alias("r"), F.count_if(F.signum(F.col("l_quantity") - 25) != F.signum(F.col("l_discount") - 0.05)).alias("disagree"), F.round(F.max(F.abs(F.col("l_discount") - F.col("l_tax"))), 8).alias("max_abs")
    )


@query("ag19_spearman", """WITH a AS (SELECT p_brand, p_size, p_retailprice, row_number() OVER (PARTITION BY p_brand ORDER BY p_size) AS rx, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice) AS ry FROM part),
b AS (SELECT p_brand, avg(rx) OVER (PARTITION BY p_brand, p_size) AS x, avg(ry) OVER (PARTITION BY p_brand, p_retailprice) AS y FROM a) SELECT p_brand, round(corr(x, y), 8) AS rho, CAST(count(*) AS BIGINT) AS n FROM b GROUP BY 1""")
def spearman(spark, d):
    return curves.spearman(t(spark, d, "part"), "p_size", "p_retailprice", "p_brand").withColumn("rho", F.round("rho", 8))


@query("ag21_errors", "SELECT l_returnflag, round(sqrt(avg((l_tax - l_discount) ** 2)), 8) AS rmse, round(avg(abs(l_tax - l_discount)), 8) AS mae, round(max(abs(l_tax - l_discount)), 8) AS max_abs, round(stddev_pop(l_tax - l_discount), 8) AS sd FROM lineitem GROUP BY 1")
def errors(spark, d):
    e = curves.errors(t(spark, d, "lineitem"), "l_discount", "l_tax", "l_returnflag")
    return e.select("l_returnflag", *[F.round(c, 8).alias(c) for c in ("rmse", "mae", "max_abs", "sd")])


@query("ag13_macro_complete_only", "SELECT user_id AS step, round(avg(value), 8) AS macro FROM events WHERE event_type IN ('click', 'view', 'purchase') AND value IS NOT NULL GROUP BY 1 HAVING count(DISTINCT event_type) = 3")
def macro_complete_only(spark, d):
    m = curves.complete_means(t(spark, d, "events"), "user_id", "event_type", "value", ["click", "view", "purchase"])
    return m.select(F.col("user_id").alias("step"), F.round("macro", 8).alias("macro"))


@query("ag14_family_macro", "WITH m AS (SELECT l_shipmode_, l_returnflag, avg(l_quantity) AS m FROM (SELECT *, CAST(l_linenumber AS BIGINT) AS l_shipmode_ FROM lineitem) GROUP BY 1, 2) SELECT l_shipmode_ AS line, round(avg(m), 8) AS macro FROM m GROUP BY 1")
def family_macro(spark, d):
    li = t(spark, d, "lineitem").withColumn("line", F.col("l_linenumber").cast("long"))
    return curves.family_macro(li, ["line"], "l_returnflag", "l_quantity").withColumn("macro", F.round("macro", 8))


@query("ag33_envelope", """WITH pts AS (SELECT l_returnflag AS run, l_suppkey AS step, avg(l_quantity) AS loss FROM lineitem GROUP BY 1, 2)
SELECT step, round(min(loss), 8) AS lo, round(max(loss), 8) AS hi FROM pts GROUP BY step HAVING count(DISTINCT run) = (SELECT count(DISTINCT run) FROM pts)""")
def envelope(spark, d):
    p = t(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("run"), F.col("l_suppkey").alias("step")).agg(F.avg("l_quantity").alias("loss"))
    n = p.select("run").distinct().count()
    return curves.envelope(p, n).select("step", F.round("lo", 8).alias("lo"), F.round("hi", 8).alias("hi"))


@query("wn16_edge_value", f"WITH {POINTS}, g AS (SELECT run, arg_max(step, step) FILTER (step < 25.5) AS ls, arg_max(loss, step) FILTER (step < 25.5) AS lv, arg_min(step, step) FILTER (step >= 25.5) AS rs, arg_min(loss, step) FILTER (step >= 25.5) AS rv FROM pts GROUP BY run) SELECT run, round(lv + (25.5 - ls) / (rs - ls) * (rv - lv), 8) AS at_edge FROM g")
def edge_value(spark, d):
    return curves.edge_value(points(spark, d), 25.5).withColumn("at_edge", F.round("at_edge", 8))


# --- mixtures ---------------------------------------------------------------------------------------------------------
LAW = [("f0", 1.0, 0.5, [-1.0, 0.5, 0.2]), ("f1", 0.8, 0.9, [0.3, -0.7, 0.1])]


def mixes(spark: SparkSession, d: str) -> DataFrame:
    """Shares of three order states by priority."""
    o = t(spark, d, "orders")
    share = lambda s: F.count_if(F.col("o_orderstatus") == s) / F.count("*")
    return o.groupBy(F.col("o_orderpriority").alias("mix_id")).agg(F.array(share("F"), share("O"), share("P")).alias("r"))


@query("fn23_mixing_law_predict", """WITH m AS (SELECT o_orderpriority AS mix_id, count(*) FILTER (o_orderstatus = 'F') / count(*) AS a, count(*) FILTER (o_orderstatus = 'O') / count(*) AS b, count(*) FILTER (o_orderstatus = 'P') / count(*) AS c FROM orders GROUP BY 1)
SELECT mix_id, 'f0' AS family, round(1.0 + 0.5 * exp(-1.0 * a + 0.5 * b + 0.2 * c), 8) AS loss FROM m UNION ALL SELECT mix_id, 'f1', round(0.8 + 0.9 * exp(0.3 * a - 0.7 * b + 0.1 * c), 8) FROM m""")
def mixing_law_predict(spark, d):
    laws = spark.createDataFrame(LAW, "family string, c double, k double, t array<double>")
    return with_each(mixes(spark, d), laws).select("mix_id", "family", F.round(mixture.law(F.col("c"), F.col("k"), F.col("t"), F.col("r")), 8).alias("loss"))


def law_runs(spark: SparkSession, d: str) -> DataFrame:
    """(run, family, r, y): the mixtures of order states by month, with what laws make of them and a little of the orders'
    prices."""
    o, share = t(spark, d, "orders"), lambda s: F.count_if(F.col("o_orderstatus") == s) / F.count("*")
    runs = o.groupBy(F.months_between(F.trunc("o_orderdate", "month"), F.lit("1990-01-01")).cast("int").alias("run")).agg(F.array(share("F"), share("O"), share("P")).alias("r"), F.avg("o_totalprice").alias("_p"))
    laws = spark.createDataFrame(LAW, "family string, c double, k double, t array<double>")
    y = mixture.law(F.col("c"), F.col("k"), F.col("t"), F.col("r")) + 1e-4 * F.sin("_p")
    return with_each(runs, laws).select("run", "family", "r", y.alias("y"))  # two laws


def fitted_laws(spark: SparkSession, d: str) -> DataFrame:
    return mixture.fit_law(law_runs(spark, d), 3)


@query("ml01_mixing_law_fit")
def mixing_law_fit(spark, d):
    return fitted_laws(spark, d)


@query("ml05_leave_one_out")
def leave_one_out(spark, d):
    return curves.errors(mixture.leave_one_out(law_runs(spark, d), 3, starts=3), "actual", "predicted", "family")


@query("ml07_simplex_optimum")
def simplex_optimum(spark, d):
    return mixture.optimise(fitted_laws(spark, d), 3, low=0.05, high=0.8)


@query("ml09_near_optimal")
def near_optimal(spark, d):
    """Of all customers' own mixtures of orders, the near-optimal ones that are apart."""
    o, share = t(spark, d, "orders"), lambda s: F.count_if(F.col("o_orderstatus") == s) / F.count("*")
    cand = o.groupBy(F.col("o_custkey").alias("id")).agg(F.array(share("F"), share("O"), share("P")).alias("w"))
    laws = fitted_laws(spark, d)
    scored = with_each(cand, laws).groupBy("id", "w").agg(F.avg(mixture.law(F.col("c"), F.col("k"), F.col("t"), F.col("w"))).alias("loss"))  # a law a family
    return mixture.near_optimal(scored, 0.04, 8, 0.2)


@query("pf15_far_from_reference", """WITH m AS (SELECT o_orderpriority AS mix_id, [count(*) FILTER (o_orderstatus = 'F') / count(*), count(*) FILTER (o_orderstatus = 'O') / count(*), count(*) FILTER (o_orderstatus = 'P') / count(*)] AS r FROM orders GROUP BY 1)
SELECT mix_id FROM m WHERE list_max([abs(r[1] - 0.33), abs(r[2] - 0.33), abs(r[3] - 0.34)]) >= 0.005 AND abs(r[1] - 0.33) + abs(r[2] - 0.33) + abs(r[3] - 0.34) >= 0.01""")
def far_from_reference(spark, d):
    return mixture.far_from(mixes(spark, d), F.col("r"), [[0.33, 0.33, 0.34]], 0.005, 0.01).select("mix_id")


LOSSES = "ref AS (SELECT l_returnflag AS family, avg(l_quantity) AS ref_loss FROM lineitem GROUP BY 1), pr AS (SELECT CAST(l_linenumber AS VARCHAR) AS domain, l_returnflag AS family, avg(l_quantity) AS loss FROM lineitem GROUP BY 1, 2)"


def probe_losses(spark, d):
    li = t(spark, d, "lineitem").select(F.col("l_linenumber").cast("string").alias("domain"), F.col("l_returnflag").alias("family"), "l_quantity")
    return li.groupBy("domain", "family").agg(F.avg("l_quantity").alias("loss")), li.groupBy("family").agg(F.avg("l_quantity").alias("ref_loss"))


@query("fn27_adjacency_offline", f"WITH {LOSSES} SELECT domain, family, round(greatest(0, ref_loss - loss), 8) AS a FROM pr JOIN ref USING (family)")
def adjacency_offline(spark, d):
    a = mixture.adjacency(*probe_losses(spark, d))
    return a.withColumn("a", F.round("a", 8))


@query("fn25_weight_update", f"""WITH {LOSSES}, a AS (SELECT domain, family, greatest(0, ref_loss - loss) AS a, ref_loss FROM pr JOIN ref USING (family)), s AS (SELECT domain, sum(a * ref_loss) * 0.01 AS x FROM a GROUP BY 1), n AS (SELECT count(*) AS n FROM s)
SELECT domain, round(exp(x) / sum(exp(x)) OVER (), 8) AS p_after FROM s""")
def weight_update(spark, d):
    probes, ref = probe_losses(spark, d)
    a = mixture.adjacency(probes, ref)
    p = probes.select("domain").distinct().withColumn("p", F.lit(1.0) / F.count("*").over(W.partitionBy()))
    out = mixture.update_weights(p, a, ref.withColumnRenamed("ref_loss", "loss"), 0.01)
    return out.select("domain", F.round("p_after", 8).alias("p_after"))


@query("ss03_weight_trajectory", """WITH u AS (SELECT CAST(date_trunc('day', ts) AS DATE) AS step, event_type AS domain, sum(value) / 10000 AS pull FROM events GROUP BY 1, 2), c AS (SELECT step, domain, 0.5 * sum(pull) OVER (PARTITION BY domain ORDER BY step ROWS UNBOUNDED PRECEDING) AS x FROM u)
SELECT CAST(step AS VARCHAR) AS step, domain, round(exp(x) / sum(exp(x)) OVER (PARTITION BY step), 8) AS p_after FROM c""")
def weight_trajectory(spark, d):
    u = t(spark, d, "events").groupBy(F.to_date("ts").alias("step"), F.col("event_type").alias("domain")).agg((F.sum("value") / 10000).alias("pull"))
    kinds = [r.domain for r in u.select("domain").distinct().collect()]
    out = logs.weight_trajectory(u, dict.fromkeys(kinds, 1.0 / max(1, len(kinds))), 0.5)
    return out.select(F.col("step").cast("string").alias("step"), "domain", F.round("p_after", 8).alias("p_after"))


WEIGHTS = ["w0", "w1", "w2"]


def surrogate_runs(spark: SparkSession, d: str) -> DataFrame:
    return law_runs(spark, d).where("family = 'f0'").select("run", *[F.element_at("r", i + 1).alias(w) for i, w in enumerate(WEIGHTS)], "y")


@query("ml06_gbt_surrogate")
def gbt_surrogate(spark, d):
    """Trees grown leaf by leaf on the months' mixtures, and what they predict for these."""
    runs = surrogate_runs(spark, d)
    return boosting.fit(runs, WEIGHTS, "y", boosting.Settings(leaves=5, depth=3, rounds=8, rate=0.3, bins=64)).predict(runs)


# --- token selection --------------------------------------------------------------------------------------------------
def scores(spark: SparkSession, d: str) -> DataFrame:
    """Embeddings as scored rows: an instance a vector, a position a component; the last position isn't valid."""
    e = t(spark, d, "embeddings").select(F.col("vec_id").alias("instance_id"), F.posexplode("embedding").alias("pos", "x"))
    x = F.col("x").cast("double")
    return e.select("instance_id", "pos", x.alias("current"), (x * x).alias("reference"), F.abs(x).alias("history"), (F.col("pos") < 63).alias("valid"))


SCORES = "sc AS (SELECT vec_id AS instance_id, i - 1 AS pos, CAST(embedding[i] AS DOUBLE) AS x, i < 64 AS valid FROM embeddings, range(1, 65) r(i))"
TIE = "md5('tie:0:' || CAST(instance_id AS VARCHAR) || ':' || CAST(pos AS VARCHAR))[1:13]"


def chosen(order: str, low: str = "0") -> str:
    return f"""WITH {SCORES}, k AS (SELECT *, row_number() OVER (PARTITION BY instance_id ORDER BY valid DESC, {order} DESC, {TIE}, pos) AS rk, count(*) FILTER (valid) OVER (PARTITION BY instance_id) AS n FROM sc),
c AS (SELECT *, least(greatest(CAST(round_even(n * 0.6::DOUBLE, 0) AS BIGINT), 1), n) AS keep FROM k)
SELECT instance_id, CAST(pos AS INT) AS pos, CAST(valid AND rk > {low} AND rk <= {low} + keep AS INT) AS weight FROM c"""


@query("tk04_rho_excess", chosen("x - x * x"))
def rho_excess(spark, d):
    return selection.select_tokens(scores(spark, d), "rho_excess", 0.6).select("instance_id", "pos", "weight")


@query("tk05_rel_ema", chosen("x - abs(x)"))
def rel_ema(spark, d):
    return selection.select_tokens(scores(spark, d), "rel_ema", 0.6).select("instance_id", "pos", "weight")


@query("tk06_middle_ppl", chosen("x * x", "((n - keep) // 2)"))
def middle_ppl(spark, d):
    return selection.select_tokens(scores(spark, d), "middle_ppl", 0.6).select("instance_id", "pos", "weight")


@query("tk03_random", chosen("CAST(('0x' || md5('select:0:' || CAST(instance_id AS VARCHAR) || ':' || CAST(pos AS VARCHAR))[1:13]) AS BIGINT)"))
def random_tokens(spark, d):
    return selection.select_tokens(scores(spark, d), "random", 0.6).select("instance_id", "pos", "weight")


@query("ag23_position_statistics", f"WITH {SCORES} SELECT CAST(pos AS INT) AS pos, CAST(count(*) AS BIGINT) AS n, round(avg(x), 8) AS mean, round(stddev_pop(x), 8) AS std FROM sc GROUP BY pos")
def position_statistics(spark, d):
    s = selection.position_statistics(selection.position_moments(scores(spark, d), "current"))
    return s.select("pos", "n", F.round("mean", 8).alias("mean"), F.round("std", 8).alias("std"))


@query("tk07_attention_topk", f"""WITH {SCORES}, u AS (SELECT instance_id, pos, valid, ln((abs(x) + 0.001) / sum(1.0::DOUBLE / (pos + 1)) OVER (PARTITION BY instance_id ORDER BY pos DESC ROWS UNBOUNDED PRECEDING)) AS l FROM sc),
a AS (SELECT instance_id, pos, valid, lead(l) OVER (PARTITION BY instance_id ORDER BY pos) AS v FROM u), m AS (SELECT pos, avg(v) AS mean, greatest(stddev_pop(v), 1e-6) AS std FROM a GROUP BY pos),
k AS (SELECT a.*, row_number() OVER (PARTITION BY instance_id ORDER BY valid DESC, round((v - mean) / std, 9) DESC NULLS LAST, {TIE}, pos) AS rk, count(*) FILTER (valid) OVER (PARTITION BY instance_id) AS n FROM a JOIN m USING (pos))
SELECT instance_id, CAST(pos AS INT) AS pos, CAST(valid AND rk <= least(greatest(CAST(round_even(n * 0.6::DOUBLE, 0) AS BIGINT), 1), n) AS INT) AS weight FROM k""")
def attention_topk(spark, d):
    s = scores(spark, d).withColumn("mass", F.col("history") + 0.001)
    z = selection.z_scores(selection.uniform_attention(s, "mass"), "aligned").withColumn("z", F.round("z", 9))
    return selection.select_tokens(z, "attention_topk", 0.6).select("instance_id", "pos", "weight")


@query("fn28_uniform_attention", f"WITH {SCORES}, u AS (SELECT instance_id, pos, ln((abs(x) + 0.001) / sum(1.0 / (pos + 1)) OVER (PARTITION BY instance_id ORDER BY pos DESC ROWS UNBOUNDED PRECEDING)) AS l FROM sc) SELECT instance_id, CAST(pos AS INT) AS pos, round(lead(l) OVER (PARTITION BY instance_id ORDER BY pos), 6) AS aligned FROM u")
def uniform_attention(spark, d):
    s = scores(spark, d).withColumn("mass", F.col("history") + 0.001)
    return selection.uniform_attention(s, "mass").select("instance_id", "pos", F.round("aligned", 6).alias("aligned"))


@query("wn13_ema", """WITH r AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn, count(*) OVER (PARTITION BY user_id) AS n FROM events)
SELECT user_id, CAST(n AS BIGINT) AS n, round(sum(value * 0.1 * pow(0.9::DOUBLE, n - rn)) / (1 - pow(0.9::DOUBLE, n)), 6) AS ema FROM r GROUP BY user_id, n""")
def ema(spark, d):
    return selection.ema(t(spark, d, "events"), "user_id", "event_id", "value", 0.1).withColumn("ema", F.round("ema", 6))


@query("tk10_weighted_loss", "WITH x AS (SELECT l_quantity AS loss, CASE WHEN l_returnflag = 'N' THEN 1.0 ELSE 0.0 END AS w FROM lineitem) SELECT round(sum(loss * w) / sum(w), 8) AS loss, CAST(sum(w) AS DOUBLE) AS weight FROM x")
def weighted_loss(spark, d):
    li = t(spark, d, "lineitem").select(F.col("l_quantity").alias("loss"), F.when(F.col("l_returnflag") == "N", 1.0).otherwise(0.0).alias("weight"))
    return selection.weighted_loss(li, "loss").withColumn("loss", F.round("loss", 8))


@query("tk12_mask_agreement", f"""WITH a AS ({chosen('x - x * x')}), b AS ({chosen('x - abs(x)')}) SELECT round(avg(CASE WHEN a.weight = b.weight THEN 1.0 ELSE 0.0 END), 8) AS agreement, CAST(count(*) AS BIGINT) AS n FROM a JOIN b USING (instance_id, pos)""")
def mask_agreement(spark, d):
    return selection.agreement(rho_excess(spark, d), rel_ema(spark, d)).withColumn("agreement", F.round("agreement", 8))


@query("se09_cell_differences", "SELECT p_partkey, 'b' AS \"column\", CAST(p_size AS DOUBLE) AS \"left\", CAST(p_size % 10 AS DOUBLE) AS \"right\" FROM part WHERE p_size <> p_size % 10")
def cell_differences(spark, d):
    p = t(spark, d, "part")
    a = p.select("p_partkey", F.col("p_retailprice").alias("a"), F.col("p_size").cast("double").alias("b"))
    return relational.cell_differences(a, a.withColumn("b", F.col("b") % 10), ["p_partkey"])


@query("vg09_monotone_steps", "WITH x AS (SELECT source, doc_id AS ord, n_chars AS step, lag(n_chars) OVER w AS b, lead(n_chars) OVER w AS nx FROM documents WINDOW w AS (PARTITION BY source ORDER BY doc_id)) SELECT source, ord, step FROM x WHERE (b IS NULL AND step <> 0) OR step <= b OR (nx IS NULL AND step >= 5000)")
def monotone_steps(spark, d):
    docs = t(spark, d, "documents").select("source", F.col("doc_id").alias("ord"), F.col("n_chars").alias("step"))
    return gates.monotone_steps(docs, "source", "step", 5000)


@query("fn37_matrix_cells", "SELECT p_partkey, unnest(['p_size', 'p_retailprice']) AS name, unnest([CAST(p_size AS DOUBLE), p_retailprice]) AS value FROM part")
def matrix_cells(spark, d):
    p = t(spark, d, "part").select("p_partkey", F.col("p_size").cast("double").alias("p_size"), "p_retailprice")
    return p.unpivot("p_partkey", ["p_size", "p_retailprice"], "name", "value")


@query("fn35_canonical_fingerprint", "SELECT r_regionkey, sha256('{\"key\":' || CAST(r_regionkey AS VARCHAR) || ',\"name\":\"' || r_name || '\"}') AS fingerprint FROM region")
def canonical_fingerprint(spark, d):
    return t(spark, d, "region").select("r_regionkey", F.sha2(F.to_json(F.struct(F.col("r_regionkey").alias("key"), F.col("r_name").alias("name"))), 256).alias("fingerprint"))


@query("ext_windowed_counts", "SELECT time_bucket(INTERVAL 1 hour, ts) AS window_start, event_type, CAST(count(*) AS BIGINT) AS n, round(sum(value), 6) AS total FROM events GROUP BY 1, 2")
def windowed_counts(spark, d):
    """An extension: the reference has no event time."""
    return logs.windowed_counts(t(spark, d, "events")).withColumn("total", F.round("total", 6))


@query("ss01_stream_poll_once", f"WITH {POINTS}, l AS (SELECT DISTINCT run FROM pts ORDER BY run LIMIT 3) SELECT step, CAST(count(*) AS BIGINT) AS n FROM pts GROUP BY step HAVING count(*) FILTER (run IN (SELECT run FROM l)) = 3")
def stream_poll_once(spark, d):
    """Curves of three labels arrive as files, one of them twice and one incomplete; every step is logged once. Files
    go to the folder that driver and executors share."""
    root = scratch(spark, "poll")
    rows = points(spark, d).groupBy("step").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("run", "loss")))).alias("values"))
    labels = [r.run for r in points(spark, d).select("run").distinct().orderBy("run").limit(3).collect()]
    rows.unionByName(rows).write.json(f"{root}/in")
    logs.poll_results(spark, f"{root}/in", "step long, values map<string,double>", labels, f"{root}/out", f"{root}/offsets").awaitTermination()
    return logs.read_steps(spark, f"{root}/out", "step long, values map<string,double>").select("step", F.size("values").cast("long").alias("n"))


__all__ = ["QUERIES", "SQL"]
