"""Registered queries over filters, orders, set operations, bootstrap arms, search and settings, each with its SQL where
SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.functions import chat
from sparkloom.operators import boosting, contamination, curves, gates, mixture, probes, selection
from sparkloom.operators.running import ranked, with_totals
from sparkloom.operators.sampling import hash_order
from sparkloom.staging import scratch, with_each

from .analytics import FIT, LAW, LOSSES, POINTS, SCORES, WEIGHTS, chosen, fitted_laws, mixes, points, probe_losses, rho_excess, scores, surrogate_runs
from .corpus import SHARDS, shards, t

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return put


# --- filters ----------------------------------------------------------------------------------------------------------
@query("pf07_english_score", "SELECT doc_id FROM documents WHERE lang = 'en' AND n_chars % 100 / 100.0 >= 0.5")
def english_score(spark, d):
    tagged = t(spark, d, "documents").select("doc_id", F.create_map(F.col("lang"), F.col("n_chars") % 100 / 100.0).alias("attributes"))
    return tagged.where(chat.english(tagged)).select("doc_id")


@query("pf10_limit_of_kept", "SELECT doc_id FROM documents WHERE lang = 'en' ORDER BY doc_id LIMIT 30")
def limit_of_kept(spark, d):
    """The limit counts kept rows only; each task keeps that many."""
    return t(spark, d, "documents").where("lang = 'en'").orderBy("doc_id").limit(30).select("doc_id")


@query("pf13_fit_window", f"WITH {POINTS} SELECT run, count(*) AS n FROM pts WHERE step >= 20 GROUP BY 1")
def fit_window(spark, d):
    return points(spark, d).where("step >= 20").groupBy("run").agg(F.count("*").alias("n"))


@query("pf14_complete_sets", "SELECT user_id FROM events WHERE event_type IN ('click', 'view', 'purchase') AND value IS NOT NULL GROUP BY 1 HAVING count(DISTINCT event_type) = 3")
def complete_sets(spark, d):
    return gates.complete_sets(t(spark, d, "events"), "user_id", "event_type", "value", ["click", "view", "purchase"])


@query("pf17_near_best", f"WITH {POINTS}, b AS (SELECT *, min(loss) OVER (PARTITION BY run) AS best FROM pts) SELECT run, step FROM b WHERE loss <= best + 0.04")
def near_best(spark, d):
    p = with_totals(points(spark, d), {"best": F.min("loss")}, ["run"])
    return p.where("loss <= best + 0.04").select("run", "step")


@query("pf18_document_rows", "SELECT CAST(doc_id AS VARCHAR) AS id, trim(text) AS text, source, lang AS domain FROM documents WHERE trim(text) <> ''")
def document_rows(spark, d):
    row = F.struct(F.col("doc_id").cast("string").alias("id"), F.trim("text").alias("text"), "source", F.struct(F.col("lang").alias("domain")).alias("metadata"))
    return t(spark, d, "documents").select(row.alias("doc")).where("doc.text <> ''").select("doc.id", "doc.text", "doc.source", "doc.metadata.domain")


@query("pf19_valid_positions", f"WITH {SCORES} SELECT instance_id, count(*) FILTER (pos < 63 AND x <> 0) AS valid FROM sc GROUP BY 1")
def valid_positions(spark, d):
    """The last column predicts nothing, and labels that are masked don't count."""
    valid = (F.col("pos") < 63) & (F.col("current") != 0)
    return scores(spark, d).groupBy("instance_id").agg(F.count_if(valid).alias("valid"))


@query("fn08_strip_preamble", """WITH p AS (SELECT p_brand AS label, p_partkey AS item_id, string_split('a b c d e f g h ' || CASE WHEN p_brand < 'Brand#3' THEN 'i ' ELSE '' END || p_size || ' ' || p_partkey, ' ') AS w FROM part)
SELECT label, item_id, CASE WHEN label < 'Brand#3' THEN CAST(9 AS BIGINT) ELSE 8 END AS stripped, array_to_string(w[CASE WHEN label < 'Brand#3' THEN 10 ELSE 9 END:], ' ') AS stem FROM p""")
def strip_preamble(spark, d):
    more = F.when(F.col("p_brand") < "Brand#3", "i ").otherwise("")
    w = F.split(F.concat(F.lit("a b c d e f g h "), more, "p_size", F.lit(" "), "p_partkey"), " ")
    p = t(spark, d, "part").select(F.col("p_brand").alias("label"), F.col("p_partkey").alias("item_id"), w.alias("w"))
    return contamination.strip_preamble(p).select("label", "item_id", "stripped", F.array_join("w", " ").alias("stem"))


@query("fn11_content_text", "SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN text WHEN 1 THEN text || chr(10) || 'more' ELSE text END AS content FROM conversations")
def content_text(spark, d):
    """Content as text, as a list of parts and as an object."""
    part = lambda c: F.to_json(F.struct(c.alias("text")))
    listed = F.concat(F.lit("["), part(F.col("text")), F.lit(","), part(F.lit("more")), F.lit(",{\"type\":\"image\"}]"))
    raw = F.when(F.col("turn") % 3 == 0, F.col("text")).when(F.col("turn") % 3 == 1, listed).otherwise(part(F.col("text")))
    return t(spark, d, "conversations").select("conv_id", "turn", chat.content_text(raw).alias("content"))


# --- orders and sets --------------------------------------------------------------------------------------------------
@query("wn02_index_in_domain", f"WITH {SHARDS} SELECT path, domain, row_number() OVER (ORDER BY domain, path) - 1 AS idx, row_number() OVER (PARTITION BY domain ORDER BY path) AS rank FROM shards")
def index_in_domain(spark, d):
    r = ranked(ranked(shards(spark, d).select("path", "domain"), ["domain", "path"], out="idx"), ["path"], ["domain"])
    return r.select("path", "domain", (F.col("idx") - 1).alias("idx"), "rank")


@query("wn14_share_of_total", f"WITH {SHARDS}, g AS (SELECT domain, sum(size) AS size FROM shards GROUP BY 1) SELECT domain, round(size / sum(size) OVER (), 6) AS share FROM g")
def share_of_total(spark, d):
    s = shards(spark, d)
    total = s.agg(F.sum("size")).first()[0] or 0
    return s.groupBy("domain").agg(F.round(F.try_divide(F.sum("size"), F.lit(total)), 6).alias("share"))


@query("st01_sorted_listing", f"WITH {SHARDS} SELECT path, size FROM shards ORDER BY path")
def sorted_listing(spark, d):
    return shards(spark, d).select("path", "size").orderBy("path")


@query("st02_multi_key_order", f"WITH {SHARDS}, r AS (SELECT domain, path, row_number() OVER (PARTITION BY domain ORDER BY size % 100, path) AS rank FROM shards) SELECT * FROM r WHERE rank <= 5")
def multi_key_order(spark, d):
    return ranked(shards(spark, d).select("domain", "path", (F.col("size") % 100).alias("k")), ["k", "path"], ["domain"]).where("rank <= 5").drop("k")


@query("st03_restored_order", "SELECT row_number() OVER (ORDER BY doc_id) - 1 AS ord, doc_id FROM documents WHERE n_chars > 500 ORDER BY doc_id")
def restored_order(spark, d):
    """Rows handled in another order come back in the first one."""
    r = ranked(t(spark, d, "documents").where("n_chars > 500").select("doc_id", "n_chars"), ["doc_id"], out="ord")
    return r.repartition(4, "n_chars").orderBy("ord").select((F.col("ord") - 1).alias("ord"), "doc_id")


@query("st05_first_distinct", "WITH r AS (SELECT *, row_number() OVER (PARTITION BY round(p_retailprice, -2), p_size ORDER BY p_retailprice, p_partkey) AS rn FROM part) SELECT p_partkey, p_retailprice FROM r WHERE rn = 1 ORDER BY p_retailprice, p_partkey LIMIT 8")
def first_distinct(spark, d):
    """SE-07 and ST-05: the first of each rounded key in order, and of these the first eight."""
    row, order = F.struct("p_partkey", "p_retailprice"), F.struct("p_retailprice", "p_partkey")
    p = t(spark, d, "part").groupBy(F.round("p_retailprice", -2).alias("k"), "p_size").agg(F.min_by(row, order).alias("r"))
    return p.select("r.*").orderBy("p_retailprice", "p_partkey").limit(8)


@query("st06_best_run", f"WITH {POINTS} SELECT step, arg_min(run, (loss, run)) AS run FROM pts GROUP BY 1")
def best_run(spark, d):
    return points(spark, d).groupBy("step").agg(F.min_by("run", F.struct("loss", "run")).alias("run"))


@query("st09_canonical_subset", "SELECT ord, source FROM (SELECT unnest(['src9', 'src3', 'nowhere', 'src1']) AS source, unnest([0, 1, 2, 3]) AS ord) WHERE source IN (SELECT source FROM documents) ORDER BY ord")
def canonical_subset(spark, d):
    names = spark.createDataFrame([("src9", 0), ("src3", 1), ("nowhere", 2), ("src1", 3)], "source string, ord int")
    return names.join(t(spark, d, "documents"), "source", "left_semi").orderBy("ord").select("ord", "source")


@query("se01_union_of_selections", f"WITH {SHARDS} SELECT domain, path FROM shards WHERE size % 7 = 0 UNION ALL SELECT domain, path FROM shards WHERE domain = '2-HIGH'")
def union_of_selections(spark, d):
    s = shards(spark, d).select("domain", "path", "size")
    return s.where("size % 7 = 0").unionByName(s.where("domain = '2-HIGH'")).drop("size")


@query("se05_set_differences", "SELECT doc_id, 'missing' AS kind FROM (SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels) UNION ALL SELECT doc_id, 'unexpected' FROM (SELECT doc_id FROM labels EXCEPT SELECT doc_id FROM documents)")
def set_differences(spark, d):
    return gates.set_differences(t(spark, d, "labels"), t(spark, d, "documents"), "doc_id")


@query("se06_merged_values", "SELECT doc_id, n_chars FROM documents WHERE doc_id % 2 = 0 OR doc_id % 3 = 0")
def merged_values(spark, d):
    """Two tables that agree where they overlap; a conflict would raise."""
    docs = t(spark, d, "documents").select("doc_id", "n_chars")
    return gates.merged_values(docs.where("doc_id % 2 = 0"), docs.where("doc_id % 3 = 0"), ["doc_id"], "n_chars")


@query("se07_rounded_vectors", "SELECT count(DISTINCT list_transform(embedding[1:2], lambda x: round_even(CAST(x AS DOUBLE), 1) + 0)) AS n FROM embeddings")
def rounded_vectors(spark, d):
    """Vectors that are equal once rounded count once."""
    key = F.transform(F.slice("embedding", 1, 2), lambda x: F.bround(x.cast("double"), 1) + 0)
    return t(spark, d, "embeddings").select(key.alias("k")).dropDuplicates(["k"]).agg(F.count("*").alias("n"))


# --- joins and arms ---------------------------------------------------------------------------------------------------
@query("jn13_gathered_rows", "SELECT vec_id AS instance_id, label FROM embeddings WHERE vec_id IN (SELECT doc_id FROM labels) AND vec_id < 400")
def gathered_rows(spark, d):
    e = t(spark, d, "embeddings").select(F.col("vec_id").alias("instance_id"), "label")
    wanted = t(spark, d, "labels").select(F.col("doc_id").alias("instance_id")).where("instance_id < 400").join(e, "instance_id", "left_semi")
    return selection.gather(e, wanted)


DRAWS = "dr AS (SELECT o_orderstatus AS arm, o_orderkey % 500 AS draw, avg(o_totalprice) AS value FROM orders GROUP BY 1, 2)"


@query("jn14_paired_differences", f"WITH {DRAWS}, x AS (SELECT a.value - b.value AS d FROM dr a JOIN dr b ON a.draw = b.draw AND a.arm = 'O' AND b.arm = 'F') SELECT count(*) AS n, round(avg(d), 4) AS mean, round(quantile_cont(d, 0.025), 4) AS lo, round(quantile_cont(d, 0.975), 4) AS hi FROM x")
def paired_differences(spark, d):
    draws = t(spark, d, "orders").groupBy(F.col("o_orderstatus").alias("arm"), (F.col("o_orderkey") % 500).alias("draw")).agg(F.avg("o_totalprice").alias("value"))
    x = curves.paired_differences(draws, "O", "F")
    p = lambda q: F.round(F.percentile("d", F.lit(q)), 4)
    return x.agg(F.count("*").alias("n"), F.round(F.avg("d"), 4).alias("mean"), p(0.025).alias("lo"), p(0.975).alias("hi"))


@query("jn15_alpha_by_draw", """WITH y AS (SELECT 'd' || p_partkey % 4 AS run, p_size AS step, avg(p_retailprice) / 1000 + 3 / sqrt(p_size) AS loss FROM part GROUP BY 1, 2), g AS (SELECT 0.05 + i * (2.95 / 39) AS alpha FROM range(40) r(i)),
f AS (SELECT run, alpha, regr_syy(loss, x) - regr_sxy(loss, x) ** 2 / regr_sxx(loss, x) AS sse FROM (SELECT run, alpha, loss, pow(CAST(step AS DOUBLE), -alpha) AS x FROM y, g) GROUP BY 1, 2) SELECT run, round(arg_min(alpha, sse), 6) AS alpha FROM f GROUP BY 1""")
def alpha_by_draw(spark, d):
    """Every draw of every run against every alpha; the draws here are fourths of the parts."""
    p = t(spark, d, "part").groupBy(F.concat(F.lit("d"), F.col("p_partkey") % 4).alias("run"), F.col("p_size").alias("step")).agg(F.avg("p_retailprice").alias("v"))
    p = p.select("run", "step", (F.col("v") / 1000 + 3 / F.sqrt("step")).alias("loss"))
    return curves.profile_fit(p, curves.alpha_grid(spark, 40)).select("run", F.round("alpha", 6).alias("alpha"))


@query("jn16_setting_grid", "SELECT * FROM (SELECT DISTINCT p_brand AS run FROM part), (SELECT unnest([3.0, 4.0, 5.0]::DOUBLE[]) AS depth), (SELECT unnest([0.05, 0.1]::DOUBLE[]) AS rate), (SELECT unnest([50.0, 100.0, 200.0]::DOUBLE[]) AS rounds), (SELECT unnest([1.0, 3.0]::DOUBLE[]) AS leaf), (SELECT unnest([0.0, 1.0]::DOUBLE[]) AS l2), (SELECT unnest([0.8, 1.0]::DOUBLE[]) AS share)")
def setting_grid(spark, d):
    """Every setting for every run."""
    runs = t(spark, d, "part").select(F.col("p_brand").alias("run")).distinct()
    grid = curves.grid_rows(spark, {"depth": [3, 4, 5], "rate": [0.05, 0.1], "rounds": [50, 100, 200], "leaf": [1, 3], "l2": [0, 1], "share": [0.8, 1]})
    return with_each(runs, grid)  # 144 settings


SUBSETS = {"all5": ["click", "view", "purchase", "scroll", "signup"], "three": ["click", "view", "purchase"], "pair": ["click", "view"]}


def _subset(name: str) -> str:
    names = ", ".join(f"'{x}'" for x in SUBSETS[name])
    return f"CASE WHEN count(DISTINCT event_type) FILTER (event_type IN ({names})) = {len(SUBSETS[name])} THEN round(avg(value) FILTER (event_type IN ({names})), 8) END AS {name}"


@query("ag15_subset_means", f"SELECT user_id, {', '.join(map(_subset, SUBSETS))} FROM events GROUP BY 1")
def subset_means(spark, d):
    """AG-15 and HX-21: means over subsets of labels, null where one is missing."""
    m = curves.subset_means(t(spark, d, "events"), "user_id", "event_type", "value", SUBSETS)
    return m.select("user_id", *[F.round(n, 8).alias(n) for n in SUBSETS])


@query("ag31_keep_rate_bins", f"WITH m AS ({chosen('x - x * x')}) SELECT CAST(pos // 16 AS BIGINT) AS bin, count(*) FILTER (pos < 63) AS valid, CAST(sum(weight) AS BIGINT) AS kept, round(sum(weight) / count(*) FILTER (pos < 63), 8) AS rate, sum(weight) / count(*) FILTER (pos < 63) BETWEEN 0.55 AND 0.65 AS within FROM m GROUP BY 1")
def keep_rate_bins(spark, d):
    m = rho_excess(spark, d).withColumn("valid", F.col("pos") < 63)
    return selection.keep_rate_bins(m, 16, 0.55, 0.65).withColumn("rate", F.round("rate", 8))


@query("hx26_planned_weight", f"WITH m AS ({chosen('x - x * x')}) SELECT CAST(sum(weight) AS BIGINT) AS planned, count(DISTINCT instance_id) AS instances FROM m")
def planned_weight(spark, d):
    return selection.planned_weight(scores(spark, d), 0.6)


@query("tk08_blade", chosen("x * x - abs(x)"))
def blade(spark, d):
    s = scores(spark, d).select("instance_id", "pos", F.col("reference").alias("proxy"), F.col("history").alias("reference"), "valid")
    return selection.select_tokens(s, "blade", 0.6).select("instance_id", "pos", "weight")


@query("ag32_sign_counts", """WITH x AS (SELECT l_returnflag AS arm, l_suppkey AS label, avg(l_quantity) - 25.5 AS delta, avg(l_quantity) - 25.5 - 2 * stddev_pop(l_quantity) / sqrt(count(*)) AS lo, avg(l_quantity) - 25.5 + 2 * stddev_pop(l_quantity) / sqrt(count(*)) AS hi FROM lineitem GROUP BY 1, 2)
SELECT arm, count(*) FILTER (delta < 0) AS better, count(*) FILTER (delta > 0) AS worse, count(*) FILTER (hi < 0) AS sure_better, count(*) FILTER (lo > 0) AS sure_worse, count(*) AS labels FROM x GROUP BY 1""")
def sign_counts(spark, d):
    mean, half = F.avg("l_quantity") - 25.5, 2 * F.stddev_pop("l_quantity") / F.sqrt(F.count("*"))
    x = t(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("arm"), "l_suppkey").agg(mean.alias("delta"), (mean - half).alias("lo"), (mean + half).alias("hi"))
    return curves.sign_counts(x, "arm")


PAIR = ["Brand#11", "Brand#12"]


@query("ml14_pooled_fit", ("WITH " + FIT).replace("pts AS (SELECT run,", "pts0 AS (SELECT run,", 1).replace(", grid AS", ", pts AS (SELECT 'pooled' AS run, step, loss FROM pts0 WHERE run IN ('Brand#11', 'Brand#12') AND step >= 5), grid AS", 1) + " SELECT run, round(alpha, 6) AS alpha, round(a, 6) AS a, round(b, 6) AS b FROM best")
def pooled_fit(spark, d):
    f = curves.pooled_fit(points(spark, d), curves.alpha_grid(spark), PAIR, 5)
    return f.select("run", *[F.round(c, 6).alias(c) for c in ("alpha", "a", "b")])


@query("hx23_fitted_arms", f"WITH {POINTS}, u AS (SELECT run, step FROM pts WHERE step >= 5), n AS (SELECT run, count(*) AS n_points, 46 AS want FROM u GROUP BY 1 UNION ALL SELECT 'control', count(*), 92 FROM u WHERE run IN ('Brand#11', 'Brand#12')) SELECT run, n_points, n_points <> want AS unexpected FROM n")
def fitted_arms(spark, d):
    f = curves.fit_arms(points(spark, d), curves.alpha_grid(spark, 40), PAIR, 5, 46)
    return f.select("run", "n_points", "unexpected")


@query("hx24_rounded_table", f"WITH {FIT} SELECT run, round_even(a, 4) AS a, round_even(sse, 6) AS sse FROM best")
def rounded_table(spark, d):
    f = curves.profile_fit(points(spark, d), curves.alpha_grid(spark))
    return f.select("run", F.bround("a", 4).alias("a"), F.bround("sse", 6).alias("sse"))


@query("ml16_probe_matrix", f"WITH {FIT}, x AS (SELECT run, a + b * pow(100.0, -alpha) AS v FROM best), r AS (SELECT avg(v) AS ref FROM x) SELECT run AS domain, 'all' AS family, round(greatest(0, ref - v), 6) AS a FROM x, r")
def probe_matrix(spark, d):
    """Curves of probes extrapolated, against the mean of all as the reference."""
    f = curves.profile_fit(points(spark, d), curves.alpha_grid(spark))
    at = f.select(F.col("run").alias("domain"), F.lit("all").alias("family"), curves.predict(F.col("a"), F.col("b"), F.col("alpha"), F.lit(100)).alias("loss"))
    ref = at.groupBy("family").agg(F.avg("loss").alias("ref_loss"))
    return mixture.adjacency(at, ref).withColumn("a", F.round("a", 6))


@query("hx13_target_matrix", "SELECT CAST(l_linenumber AS VARCHAR) AS run, round(avg(l_quantity) FILTER (l_returnflag = 'A'), 6) AS \"A\", round(avg(l_quantity) FILTER (l_returnflag = 'N'), 6) AS \"N\", round(avg(l_quantity) FILTER (l_returnflag = 'R'), 6) AS \"R\" FROM lineitem GROUP BY 1")
def target_matrix(spark, d):
    cells = t(spark, d, "lineitem").groupBy(F.col("l_linenumber").cast("string").alias("run"), F.col("l_returnflag").alias("family")).agg(F.avg("l_quantity").alias("y"))
    names = [r.run for r in cells.select("run").distinct().collect()]
    m = curves.complete_cells(cells, "run", "family", "y", names, ["A", "N", "R"])
    return m.select("run", *[F.round(c, 6).alias(c) for c in ("A", "N", "R")])


@query("hx15_macro_predictions", """WITH m AS (SELECT o_orderpriority AS mix_id, count(*) FILTER (o_orderstatus = 'F') / count(*) AS a, count(*) FILTER (o_orderstatus = 'O') / count(*) AS b, count(*) FILTER (o_orderstatus = 'P') / count(*) AS c FROM orders GROUP BY 1)
SELECT mix_id, round((1.0 + 0.5 * exp(-1.0 * a + 0.5 * b + 0.2 * c) + 0.8 + 0.9 * exp(0.3 * a - 0.7 * b + 0.1 * c)) / 2, 8) AS macro FROM m""")
def macro_predictions(spark, d):
    laws = spark.createDataFrame(LAW, "family string, c double, k double, t array<double>")
    return mixture.macro_predictions(mixes(spark, d), laws).withColumn("macro", F.round("macro", 8))


@query("hx19_multiplied_weights", f"""WITH {LOSSES}, a AS (SELECT domain, family, greatest(0, ref_loss - loss) AS a, ref_loss FROM pr JOIN ref USING (family)), s AS (SELECT domain, sum(a * ref_loss) * 0.01 AS x FROM a GROUP BY 1)
SELECT domain, round(exp(x) / sum(exp(x)) OVER (), 8) AS p_after FROM s""")
def multiplied_weights(spark, d):
    losses, ref = probe_losses(spark, d)
    n = losses.select("domain").distinct().count()
    p = losses.select("domain").distinct().withColumn("p", F.lit(1.0 / max(1, n)))
    out = mixture.multiplied_weights(p, mixture.adjacency(losses, ref), ref.withColumnRenamed("ref_loss", "loss"), 0.01)
    return out.select("domain", F.round("p_after", 8).alias("p_after"))


@query("sc23_loaded_mixtures", "WITH m AS (SELECT o_orderpriority AS mix_id, o_orderstatus AS domain, count(*) AS n FROM orders GROUP BY 1, 2) SELECT mix_id, domain, round(n / sum(n) OVER (PARTITION BY mix_id), 8) AS weight FROM m")
def loaded_mixtures(spark, d):
    """A JSON file of mixtures written, read, checked; HX-28 looks one up and raises for a name that isn't there."""
    from sparkloom.sources.writers import write_json

    counts = t(spark, d, "orders").groupBy("o_orderpriority", "o_orderstatus").count().collect()  # five mixtures of three domains
    table: dict[str, dict[str, float]] = {}
    for r in counts:
        table.setdefault(r.o_orderpriority, {})[r.o_orderstatus] = r["count"]
    path = scratch(spark, "mixtures") + ".json"
    write_json(spark, path, {m: {k: n / sum(w.values()) for k, n in w.items()} for m, w in table.items()})
    found = mixture.load_mixtures(spark, path)
    mixture.registered(found, "2-HIGH")
    return found.withColumn("weight", F.round("weight", 8))


@query("hx28_registered_mixture", "SELECT o_orderstatus AS domain, round(count(*) / sum(count(*)) OVER (), 8) AS weight FROM orders WHERE o_orderpriority = '2-HIGH' GROUP BY 1")
def registered_mixture(spark, d):
    return mixture.registered(loaded_mixtures(spark, d), "2-HIGH").select("domain", "weight")


@query("ml08_global_search")
def global_search(spark, d):
    return mixture.optimise_global(fitted_laws(spark, d), 3, 0.05, 0.8)


@query("ml06_surrogate_grid")
def surrogate_grid(spark, d):
    grid = [boosting.Settings(leaves=n, depth=3, rounds=3, rate=0.5, least_rows=2, bins=32) for n in (3, 7)]
    return boosting.grid_errors(surrogate_runs(spark, d), WEIGHTS, "y", grid, 2, "run")


@query("hx27_sampled_instances", "SELECT vec_id FROM embeddings ORDER BY md5('diagnostic:' || vec_id), vec_id LIMIT 64")
def sampled_instances(spark, d):
    return probes.hash_sample(t(spark, d, "embeddings").select("vec_id"), 64, "diagnostic", F.col("vec_id"))


@query("sm16_keyed_uniform", "SELECT vec_id, CAST(('0x' || md5('draw:4:' || vec_id)[1:13]) AS BIGINT) / 4503599627370496.0 AS u FROM embeddings")
def keyed_uniform(spark, d):
    return t(spark, d, "embeddings").select("vec_id", selection.uniform("draw", 4, F.col("vec_id")).alias("u"))


@query("wn15_staged_to_cap", f"WITH {SHARDS}, o AS (SELECT *, sum(size) OVER (PARTITION BY domain ORDER BY md5('13:' || path) ROWS UNBOUNDED PRECEDING) AS cum FROM shards) SELECT domain, count(*) AS shards, CAST(sum(size) AS BIGINT) AS size FROM o WHERE cum - size < 2000000 GROUP BY 1")
def staged_to_cap(spark, d):
    from sparkloom.operators import sampling

    kept = sampling.greedy_prefix(shards(spark, d), "size", F.lit(2_000_000), hash_order(13, F.col("path")))
    return kept.groupBy("domain").agg(F.count("*").alias("shards"), F.sum("size").alias("size"))
