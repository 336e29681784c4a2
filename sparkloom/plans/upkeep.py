"""Registered queries over probe runs, budgets, row-addressed sources and rebuild checks, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.functions import budgets
from sparkloom.operators import probes, relational
from sparkloom.sources import rows

from .analytics import points
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


def rounded(df: DataFrame, digits: int, *names: str) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if c in names else c for c in df.columns])


@query("fn30_learning_rate", """WITH x AS (SELECT o_orderkey, o_orderkey % 500 AS s, 400 AS n FROM orders)
SELECT o_orderkey, round(CASE WHEN s < 40 THEN 0.0058 * s / 40 WHEN s < 360 THEN 0.0058 WHEN s >= n THEN 0.00058 ELSE 0.00058 + (0.0058 - 0.00058) * (1 + cos(pi() * (s - 360) / 40)) / 2 END, 10) AS rate FROM x""")
def learning_rate(spark, d):
    rate = budgets.learning_rate(F.col("o_orderkey") % 500, F.lit(400))
    return t(spark, d, "orders").select("o_orderkey", F.round(rate, 10).alias("rate"))


@query("fn31_token_budget", """WITH x AS (SELECT DISTINCT p_size / 2.0 AS ratio FROM part), y AS (SELECT ratio, CAST(floor(floor(ratio * 57078144) / 2048) AS BIGINT) // 96 AS steps FROM x)
SELECT ratio, steps * 96 AS sequences, steps, steps * 96 * 2048 AS tokens, round((steps * 96 * 2048 / 150000.0 + 720) / 3600, 8) AS hours,
round((6 * 76296576.0 + 12 * 8.0 * 2048 * 512) * (steps * 96 * 2048) / 1e18, 8) AS flops_e18 FROM y""")
def token_budget(spark, d):
    r = t(spark, d, "part").select((F.col("p_size") / 2.0).alias("ratio")).distinct()
    sequences, steps, tokens = budgets.token_budget(F.col("ratio"))
    r = r.select("ratio", sequences.alias("sequences"), steps.alias("steps"), tokens.alias("tokens"))
    flops = budgets.training_flops(F.lit(76_296_576), F.lit(8), F.lit(2048), F.lit(512), F.col("tokens"))
    return r.withColumns({"hours": F.round(budgets.gpu_hours(F.col("tokens")), 8), "flops_e18": F.round(flops / 1e18, 8)})


MODERATION = """md AS (SELECT p_partkey, p_brand, p_size / 50.0 AS rmse, p_retailprice / 100 AS k, [p_size / 10.0, -(p_partkey % 7) / 2.0] AS e FROM part),
mo AS (SELECT p_partkey, p_brand, rmse, sqrt((e[1] * e[1] + e[2] * e[2]) / 2) + 0.25 * greatest(abs(e[1]), abs(e[2])) + 0.5 * (abs(log10(k / 0.3)) + CASE WHEN k / 0.3 > 20 THEN log10(k / 0.3 / 20) ELSE 0 END) AS moderation FROM md)"""


def moderated(spark: SparkSession, d: str) -> DataFrame:
    e = F.array(F.col("p_size") / 10.0, -(F.col("p_partkey") % 7) / 2.0)
    m = budgets.moderation(e, F.col("p_retailprice") / 100, F.lit(0.3))
    return t(spark, d, "part").select("p_partkey", "p_brand", (F.col("p_size") / 50.0).alias("rmse"), m.alias("moderation"))


@query("fn32_moderation", f"WITH {MODERATION} SELECT p_partkey, round(moderation, 8) AS moderation FROM mo")
def moderation(spark, d):
    return moderated(spark, d).select("p_partkey", F.round("moderation", 8).alias("moderation"))


@query("ml02_parsimonious", f"""WITH {MODERATION} SELECT p_brand, arg_min(p_partkey, (moderation, rmse, p_partkey)) AS p_partkey, round(arg_min(moderation, (moderation, rmse, p_partkey)), 8) AS moderation, round(arg_min(rmse, (moderation, rmse, p_partkey)), 8) AS rmse
FROM (SELECT *, min(rmse) OVER (PARTITION BY p_brand) AS b FROM mo) WHERE rmse <= b * 1.35 GROUP BY 1""")
def parsimonious(spark, d):
    return rounded(probes.parsimonious(moderated(spark, d), "p_brand"), 8, "moderation", "rmse")


@query("sm19_relative_error", "SELECT o_orderpriority, round(abs(sum(o_totalprice) - 1e7) / sum(o_totalprice), 8) AS err, abs(sum(o_totalprice) - 1e7) / sum(o_totalprice) <= 0.1 AS within FROM orders GROUP BY 1")
def relative_error(spark, d):
    e = budgets.relative_error(F.lit(1e7), F.sum("o_totalprice"))
    return t(spark, d, "orders").groupBy("o_orderpriority").agg(F.round(e, 8).alias("err"), (e <= 0.1).alias("within"))


@query("hx14_log_parameters", "SELECT p_partkey, round(ln(p_retailprice), 8) AS a, round(ln(p_size), 8) AS b, CAST(p_size + 0.5 AS DOUBLE) AS c FROM part")
def log_parameters(spark, d):
    v = budgets.log_parameters(F.col("p_retailprice"), F.col("p_size"), F.array(F.col("p_size") + 0.5))
    return t(spark, d, "part").select("p_partkey", F.round(v[0], 8).alias("a"), F.round(v[1], 8).alias("b"), v[2].alias("c"))


@query("wn17_item_losses", """WITH r AS (SELECT l_returnflag AS label, l_orderkey AS doc, l_linenumber - 1 AS cont, l_quantity AS loss, l_partkey % 24 AS batch, l_suppkey * 1000000 + l_partkey AS ord FROM lineitem),
o AS (SELECT label, doc, cont, arg_min(loss, ord) AS loss, arg_min(batch, ord) AS batch FROM r GROUP BY 1, 2, 3)
SELECT label, doc, max(loss) FILTER (cont = 0) AS loss, count(*) FILTER (cont = 0 AND batch < 16) > 0 AND max(cont) FILTER (batch < 16) + 1 = count(*) FILTER (batch < 16) AS complete FROM o GROUP BY 1, 2 HAVING count(*) FILTER (cont = 0) > 0""")
def item_losses(spark, d):
    li = t(spark, d, "lineitem")
    ord_ = F.col("l_suppkey") * 1_000_000 + F.col("l_partkey")
    return probes.item_losses(li.select(F.col("l_returnflag").alias("label"), F.col("l_orderkey").alias("doc"), (F.col("l_linenumber") - 1).alias("cont"), F.col("l_quantity").alias("loss"), (F.col("l_partkey") % 24).alias("batch"), ord_.alias("ord")))


@query("wn12_first_items", "SELECT source, doc_id FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY doc_id) <= 5")
def first_items(spark, d):
    return probes.first_items(t(spark, d, "documents").select("source", "doc_id"), 5, "source", "doc_id")


@query("sm18_hash_sample", "SELECT doc_id FROM documents ORDER BY md5('parity:' || doc_id), doc_id LIMIT 50")
def hash_sample(spark, d):
    return probes.hash_sample(t(spark, d, "documents").select("doc_id"), 50, "parity", F.col("doc_id"))


@query("sm17_paired_bootstrap", """WITH it AS (SELECT p_partkey AS item, row_number() OVER (ORDER BY p_partkey) - 1 AS a FROM part), n AS (SELECT count(*) AS n FROM it),
s AS (SELECT draw, CAST(('0x' || md5('7:' || draw || ':' || slot)[1:11]) AS BIGINT) % n AS a FROM n, range(20) d(draw), range(n) s(slot)),
w AS (SELECT draw, item, count(*) AS times FROM s JOIN it USING (a) GROUP BY 1, 2)
SELECT probe, draw, round(sum(v * times) / sum(times), 6) AS loss FROM w, (SELECT p_partkey, unnest(['price', 'size']) AS probe, unnest([p_retailprice, CAST(p_size AS DOUBLE)]) AS v FROM part) x WHERE x.p_partkey = w.item GROUP BY 1, 2""")
def paired_bootstrap(spark, d):
    p = t(spark, d, "part").select(F.col("p_partkey").alias("item"), F.col("p_retailprice").alias("price"), F.col("p_size").cast("double").alias("size"))
    draws = probes.paired_draws(p.select("item"), 20, 7)
    means = probes.draw_means(p.unpivot("item", ["price", "size"], "probe", "loss"), draws, ["probe"])
    return means.select("probe", F.col("draw").cast("long").alias("draw"), F.round("loss", 6).alias("loss"))


@query("hx18_improvements", """WITH b AS (SELECT p_size AS label, avg(p_retailprice) AS base FROM part GROUP BY 1), p AS (SELECT p_brand AS probe, p_size AS label, avg(p_retailprice) AS loss FROM part GROUP BY 1, 2)
SELECT probe, label, round(greatest(0, base - loss), 6) AS gain FROM p JOIN b USING (label)""")
def improvements(spark, d):
    p = t(spark, d, "part").select(F.col("p_brand").alias("probe"), F.col("p_size").alias("label"), "p_retailprice")
    base = p.groupBy("label").agg(F.avg("p_retailprice").alias("loss"))
    return rounded(probes.improvements(p.groupBy("probe", "label").agg(F.avg("p_retailprice").alias("loss")), base), 6, "gain")


@query("hx17_last_measured", "SELECT event_type, arg_max(value, event_id) AS value, max(event_id) AS event_id FROM events GROUP BY 1")
def last_measured(spark, d):
    return probes.last_measured(t(spark, d, "events"), "event_type", "event_id", "value")


@query("hx22_family_series", """WITH f AS (SELECT unnest(['Brand#11', 'Brand#12', 'Brand#13', 'Brand#21', 'Brand#22']) AS p_brand, unnest(['x', 'x', 'x', 'y', 'y']) AS family, unnest([1, 2, 3, 1, 2]) AS ord),
l AS (SELECT p_brand, p_size, max(p_retailprice) AS loss FROM part GROUP BY 1, 2)
SELECT family, p_size AS step, arg_min(loss, ord) AS loss FROM l JOIN f USING (p_brand) GROUP BY 1, 2""")
def family_series(spark, d):
    families = spark.createDataFrame([("Brand#11", "x", 1), ("Brand#12", "x", 2), ("Brand#13", "x", 3), ("Brand#21", "y", 1), ("Brand#22", "y", 2)], "label string, family string, ord int")
    p = t(spark, d, "part").groupBy(F.col("p_brand").alias("label"), F.col("p_size").alias("step")).agg(F.max("p_retailprice").alias("loss"))
    return probes.family_series(p, families)


@query("fn38_matrix_rows", "SELECT probe, count(*) AS n, round(sum(v), 4) AS total FROM (SELECT p_brand AS probe, p_size, avg(p_retailprice) AS v FROM part GROUP BY 1, 2) GROUP BY 1")
def matrix_rows(spark, d):
    cells = t(spark, d, "part").groupBy(F.col("p_brand").alias("probe"), "p_size").agg(F.avg("p_retailprice").alias("v"))
    m = probes.matrix_rows(cells, "probe", "p_size", "v")
    total = F.aggregate(F.map_values("cells"), F.lit(0.0), lambda s, x: s + x)
    return m.select("probe", F.size("cells").cast("long").alias("n"), F.round(total, 4).alias("total"))


@query("ml03_step_law")
def step_law(spark, d):
    return probes.step_laws(points(spark, d), "run")


@query("ml04_extrapolate")
def extrapolate(spark, d):
    return probes.extrapolate(probes.step_laws(points(spark, d), "run"), 5806)


@query("ml13_pooled_control", "SELECT o_custkey, round(avg(o_totalprice), 6) AS o_totalprice, count(*) AS arms FROM orders GROUP BY 1")
def pooled_control(spark, d):
    return rounded(probes.pooled_control(t(spark, d, "orders"), "o_totalprice", "o_custkey"), 6, "o_totalprice")


@query("ml15_saving", """WITH x AS (SELECT p_brand AS run, p_retailprice / 1000 AS a, 1 + p_size / 10.0 AS b, p_retailprice / 1000 + 0.01 * (p_partkey % 9) AS target FROM part),
c AS (SELECT run, CASE WHEN target > a THEN pow(b / (target - a), 2) ELSE CAST('inf' AS DOUBLE) END AS hit FROM x),
s AS (SELECT run, hit, CASE WHEN hit < CAST('inf' AS DOUBLE) THEN 1 - hit / 2384 END AS saved FROM c)
SELECT run, round(avg(CASE WHEN hit <= 2384 THEN 1.0 ELSE 0 END), 6) AS within, count(saved) AS n_finite, round(avg(saved), 4) AS mean, round(quantile_cont(saved, 0.025), 4) AS lo, round(quantile_cont(saved, 0.5), 4) AS mid, round(quantile_cont(saved, 0.975), 4) AS hi,
round(avg(saved) - 0.046, 4) AS net_mean, round(quantile_cont(saved, 0.025) - 0.046, 4) AS net_lo, round(quantile_cont(saved, 0.5) - 0.046, 4) AS net_mid, round(quantile_cont(saved, 0.975) - 0.046, 4) AS net_hi FROM s GROUP BY 1""")
def saving(spark, d):
    a = F.col("p_retailprice") / 1000
    draws = t(spark, d, "part").select(F.col("p_brand").alias("run"), a.alias("a"), (1 + F.col("p_size") / 10.0).alias("b"), F.lit(0.5).alias("alpha"), (a + 0.01 * (F.col("p_partkey") % 9)).alias("target"))
    s = probes.saving(draws, 2384, 0.046)
    return rounded(rounded(s, 6, "within"), 4, *[f"{n}{c}" for n in ("", "net_") for c in ("mean", "lo", "mid", "hi")])


@query("ml10_plausibility", """WITH v AS (SELECT p_retailprice / 400 AS v FROM part) SELECT round(min(v), 6) AS min, round(quantile_cont(v, 0.05), 6) AS p5, round(quantile_cont(v, 0.5), 6) AS p50, round(quantile_cont(v, 0.95), 6) AS p95, round(quantile_cont(v, 0.99), 6) AS p99, round(max(v), 6) AS max, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std,
round(avg(CASE WHEN v BETWEEN 2.5 AND 4 THEN 1.0 ELSE 0 END) * 100, 6) AS pct_inside, count(*) FILTER (v < 2.5) AS n_below, count(*) FILTER (v > 4) AS n_above, count(*) FILTER (v > 3) AS n_gt_3, count(*) FILTER (v > 5) AS n_gt_5, count(*) FILTER (v > 10) AS n_gt_10 FROM v""")
def plausibility(spark, d):
    s = probes.plausibility(t(spark, d, "part").select((F.col("p_retailprice") / 400).alias("v")), "v", 2.5, 4.0)
    return rounded(s, 6, "min", "p5", "p50", "p95", "p99", "max", "mean", "std", "pct_inside")


@query("sc09_union_configs", "SELECT 'orders' AS config, o_orderkey AS k, o_totalprice AS v FROM orders UNION ALL SELECT 'part', p_partkey, NULL FROM part")
def union_configs(spark, d):
    scans = {"part": t(spark, d, "part").select(F.col("p_partkey").alias("k")), "orders": t(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("v")), "skipped": t(spark, d, "region").select(F.col("r_regionkey").cast("long").alias("k"))}
    return rows.union_configs(scans, ("skipped",)).select("config", "k", "v")


@query("sc15_row_access", "SELECT file_row_number AS \"row\", doc_id, source FROM (SELECT row_number() OVER () - 1 AS file_row_number, doc_id, source FROM documents) WHERE file_row_number IN (SELECT doc_id FROM labels)")
def row_access(spark, d):
    """Labelled rows by their index, read from the row groups that hold them."""
    got = rows.rows_at(spark, f"{d}/documents.parquet", t(spark, d, "labels").select(F.col("doc_id").alias("row")), ["doc_id", "source"])
    return got.select("row", "doc_id", "source")


@query("sc19_token_range", """WITH s AS (SELECT source, doc_id AS ord, string_split(text, ' ') AS w FROM documents), o AS (SELECT source, ord, w, CAST(sum(len(w)) OVER (PARTITION BY source ORDER BY ord) - len(w) AS BIGINT) AS first FROM s)
SELECT source, ord, array_to_string(w[greatest(1, 500 - first + 1):least(len(w), 900 - first)], ' ') AS part FROM o WHERE first < 900 AND first + len(w) > 500""")
def token_range(spark, d):
    """Tokens 500 to 900 of each source's stream."""
    docs = t(spark, d, "documents").select("source", F.col("doc_id").alias("ord"), F.split("text", " ", -1).alias("tokens"))
    first = relational.offsets(docs.select("source", "ord", F.size("tokens").alias("n")), F.col("n"), "source", "ord")
    got = rows.read_range(docs.join(first.select("source", "ord", F.col("start").alias("first")), ["source", "ord"]), 500, 900, "source")
    return got.select("source", "ord", F.array_join("tokens", " ").alias("part"))


@query("tk11_chunk_digests")
def chunk_digests(spark, d):
    return rows.chunk_digests(t(spark, d, "embeddings"), 64, "vec_id", "embedding")


@query("vg05_crc_mismatches", """SELECT source, min(doc_id) AS first_bad, count(*) AS n_bad FROM documents WHERE doc_id % 5 = 1 OR doc_id % 11 = 2 GROUP BY 1""")
def crc_mismatches(spark, d):
    docs = t(spark, d, "documents")
    built = docs.select("source", "doc_id", F.col("n_chars").alias("n"), F.crc32("text").alias("crc"))
    off = built.withColumns({"n": F.col("n") + (F.col("doc_id") % 5 == 1).cast("long"), "crc": F.col("crc") + (F.col("doc_id") % 11 == 2).cast("long")})
    return rows.crc_mismatches(built, off, "source", "doc_id")


@query("vg06_layout_differences", "SELECT o_orderkey, o_custkey, 'predicted' AS side FROM orders WHERE o_orderkey % 6 = 0 UNION ALL SELECT o_orderkey, o_custkey + 1, 'actual' FROM orders WHERE o_orderkey % 6 = 0")
def layout_differences(spark, d):
    o = t(spark, d, "orders").select("o_orderkey", "o_custkey")
    return rows.layout_differences(o, o.withColumn("o_custkey", F.col("o_custkey") + (F.col("o_orderkey") % 6 == 0).cast("long")))


@query("vg11_provenance", "SELECT unnest(['bucket', 'version']) AS name, unnest(['missing', 'conflict']) AS kind")
def provenance(spark, d):
    n = t(spark, d, "nation")
    markers = n.select(F.lit("version").alias("name"), (F.col("n_regionkey") % 2).cast("string").alias("value")).unionByName(n.select(F.lit("id").alias("name"), F.lit("a").alias("value")))
    return rows.pinned(markers, {"id": "a", "version": "0", "bucket": "b"})


@query("sk09_index_summary", "SELECT count(*) AS n_keys, count(*) FILTER (c > 1) AS n_shared, CAST(sum(strlen(k)) AS BIGINT) AS bytes FROM (SELECT k, count(DISTINCT item_id) AS c FROM (SELECT item_id, unnest(string_split(text, ' ')) AS k FROM benchmark) GROUP BY 1)")
def index_summary(spark, d):
    keys = t(spark, d, "benchmark").select("item_id", F.explode(F.split("text", " ", -1)).alias("k"))
    return rows.index_summary(keys, "k", "item_id", F.col("k"))


@query("fn19_crc32", "SELECT o_orderkey FROM orders")
def crc32(spark, d):
    """Checksums of packed tokens equal zlib's: keys whose two checksums agree."""
    import struct
    import zlib

    o = t(spark, d, "orders").select("o_orderkey")
    made = o.mapInPandas(lambda fs: (f.assign(raw=[struct.pack("<2I", k, 100257) for k in f.o_orderkey], z=[zlib.crc32(struct.pack("<2I", k, 100257)) for k in f.o_orderkey]) for f in fs), "o_orderkey long, raw binary, z long")
    return made.where(F.crc32("raw") == F.col("z")).select("o_orderkey")


__all__ = ["QUERIES", "SQL"]
