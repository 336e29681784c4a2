"""Registered queries over contamination coverage, listings, manifest rebuilds, writers and loader state, each with its
SQL where SQL can express it."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.functions import text
from sparkloom.functions.bpe import BytePairs, load_ranks
from sparkloom.operators import contamination as con
from sparkloom.operators import coverage, gates, rebuild, relational, sampling
from sparkloom.operators.running import ranked, running_totals
from sparkloom.sources import files, listings, writers
from sparkloom.staging import balanced, scratch
from sparkloom.streaming import logs, state

from .corpus import DOC_WORDS, NORM, OBJECT, OBJECTS, SPANS, documents, spans, t

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return put


# --- coverage ---------------------------------------------------------------------------------------------------------
def items(spark: SparkSession, d: str) -> DataFrame:
    """Benchmark texts as items: the stem is the whole text, the gold its last words, by item."""
    w = text.words(text.normalize(F.col("text")))
    n = (F.col("item_id") % 12 + 3).cast("int")
    b = t(spark, d, "benchmark").select("item_id", F.explode(F.array(w)).alias("w"))
    label = F.concat(F.lit("b"), F.col("item_id") % 3, F.lit("_p"), F.col("item_id") % 2, F.lit(coverage.LABEL_END))
    gold = F.slice("w", F.greatest(F.size("w") - n + 1, F.lit(1)), n)
    return b.select("item_id", label.alias("label"), F.array_join("w", " ").alias("stem"), F.array_join(gold, " ").alias("gold"), F.size("w").cast("long").alias("stem_words"), F.size(gold).cast("long").alias("gold_words"))


ITEMS = f"""iw0 AS (SELECT item_id, CASE WHEN {NORM.format('text')} = '' THEN [] ELSE string_split({NORM.format('text')}, ' ') END AS w FROM benchmark),
it AS (SELECT item_id, 'b' || item_id % 3 || '_p' || item_id % 2 || '_rc_5shot_bpb' AS label, 'b' || item_id % 3 AS bench, w AS stem, w[greatest(len(w) - (item_id % 12 + 3) + 1, 1):] AS gold FROM iw0),
fl AS (SELECT item_id, label, bench, unnest(['stem', 'gold']) AS field, unnest([stem, gold]) AS w FROM it)"""
FOUND = f"""{DOC_WORDS}, {ITEMS},
fk AS (SELECT DISTINCT item_id, field, ngram, len(string_split(ngram, ' ')) AS width FROM (SELECT item_id, field, unnest(CASE WHEN len(w) < 8 THEN [] WHEN len(w) < 13 THEN [array_to_string(w, ' ')]
  ELSE list_transform(range(1, len(w) - 11), lambda i: array_to_string(w[i:i+12], ' ')) END) AS ngram FROM fl)),
ps AS (SELECT source, w, unnest(range(1, len(w) - 6)) AS pos FROM dw WHERE len(w) >= 8),
gr AS (SELECT source, width, array_to_string(w[pos:pos + width - 1], ' ') AS ngram FROM ps, (SELECT DISTINCT width FROM fk) WHERE pos + width - 1 <= len(w)),
hi AS (SELECT DISTINCT source AS domain, item_id, field FROM gr JOIN fk USING (ngram, width))"""


def field_hits(spark: SparkSession, d: str) -> DataFrame:
    """(domain, item_id, field) found in the documents."""
    i = items(spark, d)
    long = i.select(F.explode(F.array(*[F.struct((F.col("item_id") * 2 + k).alias("item_id"), F.col(f).alias("text")) for k, f in enumerate(coverage.FIELDS)])).alias("r")).select("r.*")
    docs = documents(spark, d)
    hits = con.scan(docs, long).select("doc_id", "item_id").distinct().join(docs.select("doc_id", F.col("source").alias("domain")), "doc_id")
    field = F.when(F.col("item_id") % 2 == 0, "stem").otherwise("gold")
    return hits.select("domain", F.floor(F.col("item_id") / 2).alias("item_id"), field.alias("field")).distinct()


RATES = f"""{FOUND}, base AS (SELECT bench, field, count(*) FILTER (len(w) >= 8) AS assessable FROM fl GROUP BY 1, 2), dm AS (SELECT DISTINCT source AS domain FROM documents),
fo AS (SELECT domain, bench, hi.field, count(DISTINCT item_id) AS found FROM hi JOIN it USING (item_id) GROUP BY 1, 2, 3),
ra AS (SELECT domain, bench, field, CAST(coalesce(found, 0) AS BIGINT) AS found, CAST(assessable AS BIGINT) AS assessable, coalesce(found, 0) / nullif(assessable, 0) AS rate FROM dm CROSS JOIN base LEFT JOIN fo USING (domain, bench, field))"""


def field_rates(spark: SparkSession, d: str) -> DataFrame:
    domains = t(spark, d, "documents").select(F.col("source").alias("domain")).distinct()
    return coverage.found_by_benchmark(field_hits(spark, d), coverage.item_flags(items(spark, d)), domains)


@query("jn07_found_by_benchmark", f"WITH {RATES} SELECT domain, bench, field, found, assessable, round(rate, 10) AS rate FROM ra")
def found_by_benchmark(spark, d):
    """AG-08 by benchmark and field over assessable items, with JN-07 and HX-11."""
    return field_rates(spark, d).withColumn("rate", F.round("rate", 10))


@query("ag10_macro_rates", f"WITH {RATES} SELECT domain, field, round(avg(rate), 10) AS macro_rate FROM ra GROUP BY 1, 2")
def macro_rates(spark, d):
    return coverage.macro_rates(field_rates(spark, d)).withColumn("macro_rate", F.round("macro_rate", 10))


@query("ag11_rate_spread", "WITH r AS (SELECT lang, count(*) FILTER (source = 'src1') / count(*) AS rate FROM documents GROUP BY 1) SELECT count(*) AS n, round(max(rate) / min(rate), 8) AS spread FROM r WHERE rate > 0 HAVING count(*) > 1")
def rate_spread(spark, d):
    r = t(spark, d, "documents").groupBy("lang").agg((F.count_if(F.col("source") == "src1") / F.count("*")).alias("rate"))
    return coverage.spread(r, "rate").withColumn("spread", F.round("spread", 8))


@query("ag05_label_statistics", f"""WITH {ITEMS}, k AS (SELECT label, item_id, field, CASE WHEN len(w) < 8 THEN 0 WHEN len(w) < 13 THEN 1 ELSE len(w) - 12 END AS k FROM fl),
p AS (SELECT label, item_id, max(k) FILTER (field = 'stem') AS s, max(k) FILTER (field = 'gold') AS g FROM k GROUP BY 1, 2)
SELECT label, count(*) AS n_items, count(*) FILTER (s = 0) AS stem_not_assessable, count(*) FILTER (g = 0) AS gold_not_assessable, CAST(sum(s) AS BIGINT) AS stem_keys, CAST(sum(g) AS BIGINT) AS gold_keys, count(*) FILTER (s + g < 3) AS items_with_lt3_keys FROM p GROUP BY 1""")
def label_statistics(spark, d):
    return coverage.label_statistics(coverage.require_text(items(spark, d), "item_id", *coverage.FIELDS))


@query("ag07_merged_sentinels", "SELECT source AS domain, count(DISTINCT doc_id % 3) AS n_shards, count(*) AS docs_scanned, CAST(sum(n_chars) AS BIGINT) AS words_scanned, count(*) FILTER (lang = 'en') AS hit_rows, count(DISTINCT doc_id % 3) * 8 AS spikes_injected, count(DISTINCT doc_id % 3) * 8 AS spikes_recovered, true AS canary_ok FROM documents GROUP BY 1")
def merged_sentinels(spark, d):
    docs = t(spark, d, "documents").withColumnRenamed("source", "domain")
    each = docs.groupBy("domain", (F.col("doc_id") % 3).alias("shard")).agg(F.count("*").alias("docs_scanned"), F.sum("n_chars").alias("words_scanned"), F.count_if(F.col("lang") == "en").alias("hit_rows"))
    spikes = F.lit(8).cast("long")
    return coverage.merged_sentinels(each.withColumns({"spikes_injected": spikes, "spikes_recovered": spikes, "canary_ok": F.lit(True)}), docs.select("domain").distinct())


@query("vg01_normaliser_canary", f"SELECT 'normalise' AS canary, true AS ok, count(*) AS items, count(*) FILTER ({NORM.format('n')} = n) AS stable FROM (SELECT {NORM.format('text')} AS n FROM benchmark)")
def normaliser_canary(spark, d):
    """VG-01 with FN-03: raises unless the normaliser does what the index was made with; then how many items it leaves as
    they are once they are normalised."""
    coverage.require_normaliser(spark)
    n = t(spark, d, "benchmark").select(F.explode(F.array(text.normalize(F.col("text")))).alias("n"))
    return n.agg(F.lit("normalise").alias("canary"), F.lit(True).alias("ok"), F.count("*").alias("items"), F.count_if(text.normalize(F.col("n")) == F.col("n")).alias("stable"))


@query("fn17_benchmark_of", """WITH l AS (SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN 'mmlu_' || p_size || '_rc_5shot_bpb' ELSE lower(replace(p_type, ' ', '_')) || '_rc_5shot_bpb' END AS label FROM part)
SELECT p_partkey, CASE WHEN label LIKE 'mmlu\\_%' ESCAPE '\\' THEN 'mmlu' ELSE regexp_replace(regexp_replace(label, '_rc_5shot_bpb$', ''), '_[^_]*$', '') END AS bench,
CASE WHEN label LIKE 'mmlu\\_1%' ESCAPE '\\' THEN 'mmlu_1' WHEN label LIKE 'mmlu%' THEN 'mmlu' END AS longest FROM l""")
def benchmark_names(spark, d):
    label = F.concat(F.when(F.col("p_partkey") % 5 == 0, F.concat(F.lit("mmlu_"), F.col("p_size"))).otherwise(F.lower(F.translate("p_type", " ", "_"))), F.lit(coverage.LABEL_END))
    return t(spark, d, "part").select("p_partkey", coverage.benchmark_of(label).alias("bench"), coverage.longest_prefix(label, ["mmlu", "mmlu_1"]).alias("longest"))


@query("hx12_label_identities", """WITH m AS (SELECT o_orderpriority AS label, min(o_orderstatus || ' ' || o_orderkey) AS lo, max(o_orderstatus || ' ' || o_orderkey) AS hi, count(*) AS n FROM orders GROUP BY 1),
p AS (SELECT label, n, lo[1:coalesce(list_max(list_filter(range(0, least(len(lo), len(hi)) + 1), lambda i: lo[1:i] = hi[1:i])), 0)] AS prefix FROM m) SELECT label, n AS items, prefix, sha256(prefix) AS prefix_sha256 FROM p""")
def label_identities(spark, d):
    s = F.concat_ws(" ", "o_orderstatus", "o_orderkey")
    m = t(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("label")).agg(F.min(s).alias("lo"), F.max(s).alias("hi"), F.count("*").alias("items"))
    m = m.select("label", "items", text.common_prefix(F.col("lo"), F.col("hi")).alias("prefix"))
    return m.withColumn("prefix_sha256", text.sha256(F.col("prefix")))


@query("jn17_exposure_and_change", """WITH f AS (SELECT source AS domain, lang AS bench, count(*) AS found FROM documents WHERE doc_id % 2 = 0 GROUP BY 1, 2), w AS (SELECT source AS domain, sum(n_chars) AS words FROM documents GROUP BY 1), n AS (SELECT count(*) AS n FROM w),
c AS (SELECT lang AS bench, avg(n_chars) AS change FROM documents GROUP BY 1) SELECT bench, round(sum(1.0 / n * found / words), 10) AS density, round(change, 6) AS change FROM f JOIN w USING (domain) JOIN c USING (bench), n GROUP BY bench, change""")
def exposure_and_change(spark, d):
    docs = t(spark, d, "documents").withColumnRenamed("source", "domain")
    words = docs.groupBy("domain").agg(F.sum("n_chars").alias("words"))
    n = words.count()
    found = docs.where("doc_id % 2 = 0").groupBy("domain", F.col("lang").alias("bench")).agg(F.count("*").alias("found"))
    change = docs.groupBy(F.col("lang").alias("bench")).agg(F.avg("n_chars").alias("change"))
    out = coverage.exposure_and_change(words.select("domain", F.lit(1.0 / max(n, 1)).alias("weight")), found, words, change)
    return out.select("bench", F.round("density", 10).alias("density"), F.round("change", 6).alias("change"))


# --- listings ---------------------------------------------------------------------------------------------------------
PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM"]


def listing(spark: SparkSession, d: str) -> DataFrame:
    """Orders as files of a store."""
    ending = F.element_at(F.array(*[F.lit(x) for x in (".jsonl.zst", ".json.gz", ".jsonl", ".md", ".parquet")]), (F.col("o_orderkey") % 5 + 1).cast("int"))
    return t(spark, d, "orders").select(F.concat(F.lit("data/"), "o_orderpriority", F.lit("/"), "o_orderkey", ending).alias("path"), F.floor("o_totalprice").cast("long").alias("size"))


LISTING = """ls AS (SELECT 'data/' || o_orderpriority || '/' || o_orderkey || ['.jsonl.zst', '.json.gz', '.jsonl', '.md', '.parquet'][CAST(o_orderkey % 5 + 1 AS INT)] AS path, CAST(floor(o_totalprice) AS BIGINT) AS size, o_orderpriority AS domain FROM orders),
st AS (SELECT * FROM ls WHERE regexp_matches(path, '(?i)\\.jsonl?(\\.(gz|zst|zstd))?$') AND domain IN ('1-URGENT', '2-HIGH', '3-MEDIUM'))"""


@query("sc11_shard_table", f"WITH {LISTING} SELECT path, size, domain FROM st")
def shard_table(spark, d):
    """SC-11 and PF-08: the data files of known domains in a listing."""
    return listings.shard_table(listing(spark, d), PRIORITIES)


@query("sc12_manifest_inventory", f"WITH {LISTING} SELECT path, size, domain FROM st")
def manifest_inventory(spark, d):
    """The same from a manifest of JSON lines with a prefix before each path."""
    path = scratch(spark, "manifest")
    listing(spark, d).withColumn("path", F.concat(F.lit("v1/"), "path")).write.json(path)
    return listings.shards_of_manifest(spark, path, "v1/", PRIORITIES)


@query("sc13_folder_inventory", "SELECT lang AS domain, true AS has_bytes FROM documents WHERE lang IN ('en', 'fr') GROUP BY 1")
def folder_inventory(spark, d):
    path = scratch(spark, "folder")
    for lang in ("en", "fr", "de"):
        t(spark, d, "documents").where(F.col("lang") == lang).select("doc_id").coalesce(1).write.json(f"{path}/data/{lang}")
    found = listings.shards_below(spark, path, ["en", "fr"])
    return found.groupBy("domain").agg((F.sum("size") > 0).alias("has_bytes"))


@query("ag01_measured_by_domain", "SELECT l_returnflag AS domain, CAST(sum(l_quantity) AS BIGINT) AS tokens, CAST(sum(l_partkey) AS BIGINT) AS bytes, count(*) AS shards, count(DISTINCT l_orderkey) AS paths FROM lineitem GROUP BY 1")
def measured_by_domain(spark, d):
    return listings.measured(t(spark, d, "lineitem").select(F.col("l_returnflag").alias("domain"), F.col("l_quantity").cast("long").alias("tokens"), F.col("l_partkey").alias("bytes"), F.col("l_orderkey").alias("path")))


@query("sm05_pool_tokens", """WITH p AS (SELECT p_brand AS domain, sum(CASE WHEN p_size > 45 THEN p_size END) * (min(p_partkey) % 2) AS estimated, sum(p_size) * (min(p_partkey) % 3 // 2) AS target, CAST(NULL AS BIGINT) AS full_, sum(p_partkey) AS bytes FROM part GROUP BY 1)
SELECT domain, CAST(coalesce(nullif(estimated, 0), nullif(target, 0), nullif(full_, 0), CASE WHEN domain = 'Brand#11' THEN 77 END, bytes / 4.0) AS DOUBLE) AS pool_tokens FROM p""")
def pool_tokens(spark, d):
    p = t(spark, d, "part").groupBy(F.col("p_brand").alias("domain")).agg(
        (F.sum(F.when(F.col("p_size") > 45, F.col("p_size"))) * (F.min("p_partkey") % 2)).alias("estimated"), (F.sum("p_size") * F.floor(F.min("p_partkey") % 3 / 2)).alias("target"), F.lit(None).cast("long").alias("full"), F.sum("p_partkey").alias("bytes")
    )
    return listings.pool_tokens(p, {"Brand#11": 77.0}).select("domain", "pool_tokens")


@query("sm07_trim_topup", """WITH RECURSIVE s AS (SELECT p_brand AS domain, p_partkey, p_size * 10 AS tokens, row_number() OVER (PARTITION BY p_brand ORDER BY p_size * 10, p_partkey) AS rn, sum(p_size * 10) OVER (PARTITION BY p_brand) * 0.3::DOUBLE AS plan FROM part),
r(domain, rn, p_partkey, tokens, have, kept) AS (SELECT DISTINCT domain, CAST(0 AS BIGINT), CAST(NULL AS BIGINT), CAST(0 AS BIGINT), 50.0::DOUBLE, false FROM s
 UNION ALL SELECT x.domain, x.rn, x.p_partkey, x.tokens, x.have + CASE WHEN x.take THEN x.tokens ELSE 0 END, x.take FROM (SELECT s.domain, s.rn, s.p_partkey, CAST(s.tokens AS BIGINT) AS tokens, r.have,
  (r.have + s.tokens <= s.plan / 0.9::DOUBLE) OR abs(s.plan - r.have - s.tokens) / (r.have + s.tokens) <= 0.1::DOUBLE AS take FROM r JOIN s ON s.domain = r.domain AND s.rn = r.rn + 1 WHERE r.have < s.plan / 1.1::DOUBLE) x)
SELECT domain, p_partkey FROM r WHERE kept""")
def trim_topup(spark, d):
    from pyspark.sql import Window as W

    s = t(spark, d, "part").select(F.col("p_brand").alias("domain"), F.col("p_partkey").alias("path"), (F.col("p_size") * 10).cast("long").alias("tokens"))
    s = s.withColumn("plan", F.sum("tokens").over(W.partitionBy("domain")) * 0.3).withColumn("have", F.lit(50.0))
    return sampling.trim_topup(s).select("domain", F.col("path").alias("p_partkey"))


@query("hx06_refreshed_sizes", "SELECT o_orderkey AS path, o_orderpriority AS domain, CAST(floor(o_totalprice) AS BIGINT) AS size FROM orders WHERE o_totalprice >= 1")
def refreshed_sizes(spark, d):
    o = t(spark, d, "orders").where("o_totalprice >= 1")
    manifest = o.select(F.col("o_orderkey").alias("path"), F.col("o_orderpriority").alias("domain"), F.lit(0).cast("long").alias("size"))
    return listings.refreshed(manifest, o.select(F.col("o_orderkey").alias("path"), F.floor("o_totalprice").cast("long").alias("size")))


@query("hx07_first_layout", """WITH l AS (SELECT o_custkey, CASE WHEN o_orderstatus = 'F' THEN 'tok' WHEN o_orderstatus = 'O' THEN 'tokenized' ELSE 'other' END AS folder, o_orderkey AS path FROM orders), p AS (SELECT *, list_position(['tokenized', 'tok'], folder) AS p FROM l),
b AS (SELECT *, min(p) OVER (PARTITION BY o_custkey) AS best FROM p WHERE p > 0) SELECT o_custkey, folder, path FROM b WHERE p = best""")
def first_layout(spark, d):
    folder = F.when(F.col("o_orderstatus") == "F", "tok").when(F.col("o_orderstatus") == "O", "tokenized").otherwise("other")
    return listings.first_layout(t(spark, d, "orders").select("o_custkey", folder.alias("folder"), F.col("o_orderkey").alias("path")), "o_custkey", ["tokenized", "tok"])


@query("hx08_merged_lines", "SELECT event_type, count(*) AS lines, CAST(sum(strlen(props) + 1) AS BIGINT) AS bytes FROM events WHERE trim(coalesce(props, '')) <> '' GROUP BY 1")
def merged_lines(spark, d):
    return listings.merged_lines(t(spark, d, "events").select("event_type", F.col("props").alias("value")), "event_type")


@query("hx09_token_report", "SELECT p_brand, p_size % 2 AS split, count(*) AS shards, CAST(sum(p_partkey * 4) AS BIGINT) AS bytes, CAST(CASE WHEN max(p_size) % 3 = 0 AND max(p_size) > 0 THEN max(p_size) ELSE sum(p_partkey * 4) // 4 END AS BIGINT) AS tokens FROM part GROUP BY 1, 2")
def token_report(spark, d):
    p = t(spark, d, "part").select("p_brand", (F.col("p_size") % 2).alias("split"), (F.col("p_partkey") * 4).alias("bytes"), F.col("p_size").cast("long").alias("n"))
    whole = p.groupBy("p_brand", "split").agg(F.max("n").alias("m"))
    p = p.join(whole.select(F.col("p_brand").alias("b"), F.col("split").alias("s"), F.when(F.col("m") % 3 == 0, F.col("m")).alias("meta_tokens")), (F.col("p_brand") == F.col("b")) & (F.col("split") == F.col("s")))
    return listings.token_report(p.withColumn("stream_tokens", F.lit(0).cast("long")), ["p_brand", "split"])


@query("hx10_staged_rows", "SELECT p_brand AS corpus, count(*) AS objects, CAST(sum(p_partkey * 4) // 4 AS BIGINT) AS rows FROM part GROUP BY 1")
def staged_rows(spark, d):
    p = t(spark, d, "part").select(F.col("p_brand").alias("corpus"), (F.col("p_partkey") * 4).alias("size"))
    gates.require(gates.misaligned(p, F.col("size"), F.col("size")), "objects that aren't whole tokens")
    return p.groupBy("corpus").agg(F.count("*").alias("objects"), F.floor(F.sum("size") / 4).alias("rows"))


# --- rebuild ----------------------------------------------------------------------------------------------------------
@query("jn05_lookup_in_order", "WITH w AS (SELECT doc_id, row_number() OVER (ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id) AS ord FROM labels) SELECT ord, w.doc_id AS \"row\", CAST(length(text) AS BIGINT) AS n FROM w JOIN documents d ON d.doc_id = w.doc_id")
def lookup_in_order(spark, d):
    wanted = ranked(t(spark, d, "labels").select(F.col("doc_id").alias("row")), [F.md5(F.col("row").cast("string")), "row"], out="ord")
    source = t(spark, d, "documents").select(F.col("doc_id").alias("row"), F.length("text").cast("long").alias("n"))
    return rebuild.lookup_in_order(source, wanted).select("ord", "row", "n")


def objects(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Objects of a fixed length that cut each source's stream of texts, and the texts laid end to end."""
    s = spans(spark, d).select("source", "doc_id", "start", "end").where("end > start")
    o = s.groupBy("source").agg(F.max("end").alias("m")).select("source", "m", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("m") / OBJECT) - 1)).alias("obj"))
    return o.select("source", "obj", (F.col("obj") * OBJECT).alias("start"), F.least(F.col("m"), F.col("obj") * OBJECT + OBJECT).alias("end")), s


@query("jn11_object_documents", f"WITH {SPANS}, {OBJECTS} SELECT sp.source, obj, arg_min(doc_id, e) AS first_doc, arg_max(doc_id, e) AS last_doc, count(*) AS docs, CAST(sum(least(e, obj * {OBJECT} + {OBJECT}) - greatest(e - n, obj * {OBJECT})) AS BIGINT) AS taken FROM sp JOIN ob USING (source) WHERE e - n < obj * {OBJECT} + {OBJECT} AND e > obj * {OBJECT} AND n > 0 GROUP BY 1, 2")
def object_documents(spark, d):
    o, s = objects(spark, d)
    return rebuild.object_documents(o, s, "source", 2 * OBJECT)


@query("sk07_routed_objects", f"""WITH s AS (SELECT source, string_agg(text, '' ORDER BY doc_id) AS t FROM documents GROUP BY 1), o AS (SELECT source, t, unnest(range(0, CAST(ceil(length(t) / {OBJECT}.0) AS BIGINT))) AS obj FROM s),
p AS (SELECT source, obj, t[obj * {OBJECT} + 1:obj * {OBJECT} + {OBJECT}] AS piece FROM o) SELECT source, obj, CAST(strlen(piece) AS BIGINT) AS bytes, sha256(piece) AS sha256 FROM p WHERE piece <> ''""")
def routed_objects(spark, d):
    """SK-07 with AG-26: each source's stream cut into objects, with the digest of each."""
    o, s = objects(spark, d)
    texts = s.join(t(spark, d, "documents").select("doc_id", "text"), "doc_id")
    pieces = rebuild.object_pieces(o, texts, "source", 2 * OBJECT)
    return rebuild.ordered_digests(pieces, ["source", "obj"], ["at"], "piece").select("source", "obj", "bytes", "sha256")


@query("ag26_window_digests", """WITH x AS (SELECT event_id, props, coalesce(sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER (ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) // 50 AS w FROM events)
SELECT CAST(w AS BIGINT) AS "window", count(*) AS n, substr(sha256(string_agg(props, '' ORDER BY event_id)), 1, 16) AS digest FROM x WHERE props IS NOT NULL GROUP BY 1""")
def window_digests(spark, d):
    """Digests of windows that every 50th closing row ends."""
    e = relational.ordinal_windows(t(spark, d, "events").select("event_id", "event_type", "props"), F.col("event_type") == "purchase", 50, "event_id")
    return rebuild.ordered_digests(e, ["window"], ["event_id"], "props").select("window", "n", F.substring("sha256", 1, 16).alias("digest"))


TOKENS = """tk AS (SELECT doc_id, source, list_transform(list_filter(regexp_split_to_array(coalesce(text, ''), '\\s+'), lambda w: w <> ''), lambda w: CASE WHEN w = '<|endoftext|>' THEN 100257 ELSE CAST(('0x' || md5(w)[1:8]) AS BIGINT) % {0} END) AS ids FROM documents)"""


@query("fn22_tokenise", f"WITH {TOKENS.format(100257)} SELECT doc_id, CAST(len(ids) + 1 AS BIGINT) AS n, CAST(list_sum(ids) + 100257 AS BIGINT) AS total, 100257 AS last FROM tk".replace("list_sum(ids)", "coalesce(list_sum(ids), 0)"))
def tokenise(spark, d):
    docs = rebuild.tokenise(t(spark, d, "documents").select("doc_id", "text"))
    total = F.aggregate("tokens", F.lit(0).cast("long"), lambda s, x: s + x)
    return docs.select("doc_id", F.size("tokens").cast("long").alias("n"), total.alias("total"), F.element_at("tokens", -1).alias("last"))


#: Merge ranks of a public vocabulary; a file that is read, never kept.
RANKS = os.environ.get("SPARKLOOM_MERGE_RANKS", "/opt/tokenizers/byte_bpe_50k.tiktoken")


@query("fn22_byte_pairs")
def byte_pairs(spark, d, ranks: str = RANKS):
    """Ids of every document by byte-level merges, and HX-01's counts of them."""
    encode = BytePairs(load_ranks(spark, ranks)).encode
    docs = rebuild.tokenise(balanced(t(spark, d, "documents")).select("doc_id", "text"), encode)
    return docs.select("doc_id", (F.size("tokens") - 1).cast("long").alias("n_tokens"), "tokens")


@query("hx01_token_counts", f"WITH {TOKENS.format(100257)} SELECT doc_id, CAST(len(ids) AS BIGINT) AS n_tokens FROM tk")
def token_counts(spark, d):
    return rebuild.token_counts(t(spark, d, "documents").select("doc_id", "text")).select("doc_id", "n_tokens")


@query("ag27_eos_in_text", f"WITH {TOKENS.format(50)} SELECT source, CAST(sum(len(list_filter(ids, lambda x: x = 7))) AS BIGINT) AS eos_in_text FROM tk GROUP BY 1")
def eos_counts(spark, d):
    """EOS tokens inside texts, by source; a small vocabulary, so that there are some."""
    tokens = F.concat(rebuild.hashed_words(F.col("text"), 50), F.array(F.lit(7)))
    return t(spark, d, "documents").groupBy("source").agg(F.sum(rebuild.eos_in_text(tokens, 7)).alias("eos_in_text"))


@query("hx04_resolved_files", f"""WITH {SPANS}, {OBJECTS}, w AS (SELECT DISTINCT source, obj FROM ob WHERE source = 'src3' OR (source = 'src1' AND obj = 0))
SELECT DISTINCT doc_id AS src FROM sp JOIN w USING (source) WHERE e - n < obj * {OBJECT} + {OBJECT} AND e > obj * {OBJECT} AND n > 0 UNION SELECT doc_id FROM documents WHERE doc_id IN (5, 9)""")
def resolved_files(spark, d):
    """Files needed for one object, one source's objects, a file by number and one by path."""
    o, s = objects(spark, d)
    o = o.withColumn("obj", F.concat_ws("/", "source", "obj"))
    f = spans(spark, d).select("source", F.col("doc_id").alias("src"), F.concat(F.lit("f/"), "doc_id").alias("path"), "start", "end")
    names = spark.createDataFrame([("src1/0",), ("/tokens/src3/",), ("src:5",), ("f/9",)], "name string")
    return rebuild.resolve_names(names, o, f, 2 * OBJECT)


@query("sc21_byte_offsets", "SELECT source, doc_id, CAST(sum(strlen(text) + 1) OVER (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING) - strlen(text) - 1 AS BIGINT) AS \"offset\" FROM documents")
def byte_offsets(spark, d):
    """Where each document's line begins in its source's file."""
    n = (F.octet_length("text") + 1).cast("long")
    d_ = running_totals(t(spark, d, "documents").select("source", "doc_id", n.alias("n")), {"end": F.col("n")}, ["doc_id"], ["source"])
    return d_.select("source", "doc_id", (F.col("end") - F.col("n")).alias("offset"))


# --- writers ----------------------------------------------------------------------------------------------------------
def corpus_docs(spark: SparkSession, d: str) -> DataFrame:
    docs = t(spark, d, "documents")
    return docs.select(F.col("doc_id").cast("string").alias("id"), "text", "source", F.struct(F.col("lang").alias("domain")).alias("metadata"), F.col("lang").alias("domain"), F.when(F.col("doc_id") % 10 == 0, "val").otherwise("train").alias("split"))


@query("sk02_split_folders", "SELECT source, lang AS domain, CASE WHEN doc_id % 10 = 0 THEN 'val' ELSE 'train' END AS split, count(*) AS docs FROM documents GROUP BY 1, 2, 3")
def split_folders(spark, d):
    """Written twice, read once: the second write replaces the first. PF-18 makes the rows."""
    path = scratch(spark, "splits")
    for _ in range(2):
        writers.write_splits(corpus_docs(spark, d), path)
    got = spark.read.schema(f"{files.DOC}, domain string, split string").json(path)
    return got.groupBy("source", "domain", "split").agg(F.count("*").alias("docs"))


@query("sk03_one_file", "SELECT CAST(count(*) AS BIGINT) AS lines FROM events WHERE event_type <> 'view' AND trim(coalesce(props, '')) <> ''")
def one_file(spark, d):
    path = scratch(spark, "one")
    e = t(spark, d, "events").where("event_type <> 'view' and trim(coalesce(props, '')) <> ''")
    e.select("props").write.text(f"{path}/in")
    n = writers.concatenated(spark, [f"{path}/in"], f"{path}/out")
    return spark.createDataFrame([(n,)], "lines long")


@query("sk06_capped_pieces", "WITH e AS (SELECT n_chars, CAST(sum(n_chars) OVER (ORDER BY doc_id ROWS UNBOUNDED PRECEDING) - n_chars AS BIGINT) // 100000 AS piece FROM documents) SELECT CAST(piece AS BIGINT) AS piece, count(*) AS docs, CAST(sum(n_chars) AS BIGINT) AS chars FROM e GROUP BY 1")
def capped_pieces(spark, d):
    """Pieces written, one of them lost and written again."""
    path = scratch(spark, "capped")
    pieces = writers.capped_pieces(t(spark, d, "documents").select("doc_id", "n_chars"), F.col("n_chars"), 100_000, "doc_id")
    writers.write_pieces(pieces, path, "doc_id")
    fs, mark = writers._fs(spark, f"{path}/0.{writers.DONE}")
    fs.delete(mark, False)
    if [r.piece for r in writers.write_pieces(pieces, path, "doc_id").limit(2).collect()] not in ([0], []):
        raise ValueError("whole pieces were written again")
    got = writers.read_pieces(spark, path, "doc_id long, n_chars long")
    return got.groupBy("piece").agg(F.count("*").alias("docs"), F.sum("n_chars").alias("chars"))


@query("sk08_marked_hits", "SELECT source, count(*) AS n FROM documents WHERE lang = 'en' GROUP BY 1")
def marked_hits(spark, d):
    """Rows that are only read once their mark is there; SK-10 writes the mark whole."""
    path = scratch(spark, "hits")
    hits = t(spark, d, "documents").where("lang = 'en'").select("doc_id", "source")
    said = writers.write_with_mark(hits, path, {"rows": F.count("*"), "sources": F.countDistinct("source")})
    got = writers.read_marked(spark, path, hits.schema)
    if writers.read_json(spark, f"{path}/{writers.DONE}") != said or got.count() != said["rows"]:
        raise ValueError("the mark differs from the rows")
    return got.groupBy("source").agg(F.count("*").alias("n"))


@query("sk11_staged_layout", f"WITH {LISTING} SELECT path, 'corpus/' || domain || '/' || regexp_extract(path, '[^/]*$') AS staged FROM st")
def staged_layout(spark, d):
    s = listings.shard_table(listing(spark, d), PRIORITIES)
    return writers.staged(s, "corpus", "domain", name=F.regexp_extract("path", "[^/]*$", 0)).select("path", "staged")


@query("ss08_chunk_progress", "SELECT vec_id // 64 AS chunk, count(*) AS n FROM embeddings GROUP BY 1")
def chunk_progress(spark, d):
    """A table scored in two runs: the second one does what the first left."""
    path, e = scratch(spark, "table"), t(spark, d, "embeddings").select("vec_id", F.floor(F.col("vec_id") / 64).alias("chunk"))
    chunks, binding = e.select("chunk").distinct(), {"corpus": "embeddings", "rows": str(e.count())}
    for share in (F.col("chunk") % 2 == 0, F.lit(True)):
        todo = writers.unfinished_chunks(spark, path, chunks, binding).where(share)
        writers.finish_chunks(todo.select("chunk", F.sha2(F.col("chunk").cast("string"), 256).alias("sha256")), path)
    done = spark.read.schema("chunk long, sha256 string").parquet(f"{path}/chunks")
    gates.require(gates.duplicate_keys(done, "chunk"), "chunks done twice")
    return e.join(done, "chunk").groupBy("chunk").agg(F.count("*").alias("n"))


CHECKPOINTS = "cp AS (SELECT o_custkey AS run, o_orderkey // 100 AS step, CASE o_orderstatus WHEN 'O' THEN 'post' WHEN 'P' THEN 'pre' END AS phase, o_orderkey AS path, o_orderkey % 7 <> 0 AS whole FROM orders)"


def checkpoints(spark: SparkSession, d: str) -> DataFrame:
    phase = F.when(F.col("o_orderstatus") == "O", "post").when(F.col("o_orderstatus") == "P", "pre")
    return t(spark, d, "orders").select(F.col("o_custkey").alias("run"), F.floor(F.col("o_orderkey") / 100).alias("step"), phase.alias("phase"), F.col("o_orderkey").alias("path"), (F.col("o_orderkey") % 7 != 0).alias("whole"))


@query("ag34_latest_checkpoint", f"""WITH {CHECKPOINTS}, r AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY step DESC, CASE phase WHEN 'post' THEN 1 WHEN 'pre' THEN 0 ELSE 2 END DESC, path DESC) AS rn FROM cp WHERE whole) SELECT run, step, phase, path FROM r WHERE rn = 1""")
def latest_checkpoint(spark, d):
    return writers.latest_checkpoint(checkpoints(spark, d), "run")


@query("ss09_superseded", f"""WITH {CHECKPOINTS}, du AS (SELECT run, max(step) AS s FROM cp WHERE whole AND phase IS NULL GROUP BY 1) SELECT run, step, phase, path, whole FROM cp JOIN du USING (run) WHERE (phase IS NULL AND step < s) OR (phase IS NOT NULL AND step <= s)""")
def superseded(spark, d):
    c = checkpoints(spark, d)
    durable = c.where("whole and phase is null").groupBy("run").agg(F.max("step").alias("durable_step"))
    return writers.superseded(c, durable, "run")


# --- loader state -----------------------------------------------------------------------------------------------------
@query("ss04_resumed_stream", """WITH n AS (SELECT count(*) AS n, CAST(ceil(count(*) / 64.0) AS BIGINT) AS whole FROM documents),
e AS (SELECT e AS epoch, doc_id, (row_number() OVER (PARTITION BY e ORDER BY md5('3:' || e || ':' || doc_id), doc_id) - 1) // 64 AS batch FROM documents, range(2, 4) r(e))
SELECT CAST(epoch AS INT) AS epoch, CAST(batch AS BIGINT) AS batch, doc_id FROM e, n WHERE (epoch = 2 AND batch >= whole - 2) OR (epoch = 3 AND batch < 1)""")
def resumed_stream(spark, d):
    """Three batches of a stream that goes on two batches before the end of its second epoch."""
    docs = t(spark, d, "documents").select("doc_id")
    whole = -(-docs.count() // 64)
    got, at = state.next_batches(docs, "doc_id", 64, 3, state.Position(2, max(0, whole - 2)), 3)
    if at != state.Position(3, 1):
        raise ValueError(f"the stream is at {at}")
    return got.select("epoch", "batch", "doc_id")


@query("ss05_changed_fields", "SELECT o_custkey AS loader, 'status' AS field, min(o_orderstatus) AS expected, max(o_orderstatus) AS saved FROM orders GROUP BY 1 HAVING min(o_orderstatus) <> max(o_orderstatus)")
def changed_fields(spark, d):
    """Loaders whose saved status isn't the one they are begun with again."""
    o = t(spark, d, "orders").groupBy(F.col("o_custkey").alias("loader")).agg(F.min("o_orderstatus").alias("a"), F.max("o_orderstatus").alias("b"))
    row = lambda c: o.select("loader", F.lit("status").alias("field"), F.col(c).alias("value"))
    return state.changed_fields(row("b"), row("a"), "loader")


@query("ss07_rewritten_curve", "WITH a AS (SELECT user_id AS step, avg(value) AS loss FROM events WHERE event_type = 'click' GROUP BY 1), b AS (SELECT user_id AS step, max(value) AS loss FROM events WHERE event_type = 'view' AND user_id % 3 = 0 GROUP BY 1) SELECT step, round(coalesce(b.loss, a.loss), 8) AS loss FROM a FULL JOIN b USING (step)")
def rewritten_curve(spark, d):
    """A curve, and a batch that replaces some of its steps and adds others."""
    path, e = scratch(spark, "curve"), t(spark, d, "events").withColumnRenamed("user_id", "step")
    batches = (e.where("event_type = 'click'").groupBy("step").agg(F.avg("value").alias("loss")), e.where("event_type = 'view' and step % 3 = 0").groupBy("step").agg(F.max("value").alias("loss")))
    for b in batches:
        logs.upsert_steps(b, path, ["step"])
    return logs.latest_steps(spark, path, "step long, loss double").withColumn("loss", F.round("loss", 8))


@query("hx20_normalised_weights", "WITH w AS (SELECT o_orderpriority AS mix, o_orderstatus AS domain, count(*) AS weight FROM orders GROUP BY 1, 2), o AS (SELECT unnest(['P', 'O', 'F']) AS domain, unnest([0, 1, 2]) AS ord) SELECT mix, ord, domain, weight / sum(weight) OVER (PARTITION BY mix) AS weight FROM w JOIN o USING (domain)")
def normalised_weights(spark, d):
    w = t(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("mix"), F.col("o_orderstatus").alias("domain")).agg(F.count("*").cast("double").alias("weight"))
    return state.normalised_weights(w, spark.createDataFrame([("P", 0), ("O", 1), ("F", 2)], "domain string, ord int"), "mix")


@query("fn20_filled_template", "SELECT doc_id, 'root/' || source || '/x-' || doc_id || '.jsonl' AS path FROM documents")
def filled_template(spark, d):
    path = state.fill_template("root/${SOURCE}/x-${ID}.jsonl", {"SOURCE": F.col("source"), "ID": F.col("doc_id")})
    return t(spark, d, "documents").select("doc_id", path.alias("path"))


@query("fn36_utc_text", "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || '+00:00' AS at FROM events")
def utc_text(spark, d):
    """Times as ISO 8601 text; the session's time zone is UTC in tests and by the driver's tables."""
    return t(spark, d, "events").select("event_id", state.utc_text(F.col("ts")).alias("at"))


@query("fn04_rolling_hashes")
def rolling_hashes(spark, d):
    h = text.rolling_hashes(text.normalize(F.col("text")), F.lit(8), F.lit(1_000_003))
    return t(spark, d, "benchmark").select("item_id", h.alias("hashes"))
