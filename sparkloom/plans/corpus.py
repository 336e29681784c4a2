"""Registered queries over documents, benchmark items, chats and shards, each with its SQL. Keys begin with the ID of
the operator that a query shows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.functions import chat, text
from sparkloom.operators import contamination as con
from sparkloom.operators import gates, relational, sampling
from sparkloom.operators.running import next_value, ranked, with_totals
from sparkloom.staging import balanced, checkpoint

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return put


def t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def documents(spark: SparkSession, d: str) -> DataFrame:
    """Documents whose texts are worked on."""
    return balanced(t(spark, d, "documents"))


def shards(spark: SparkSession, d: str) -> DataFrame:
    """Orders as a shard listing: path, size in bytes, domain."""
    return t(spark, d, "orders").select(F.col("o_orderkey").alias("path"), F.floor("o_totalprice").cast("long").alias("size"), F.col("o_orderpriority").alias("domain"))


SHARDS = "shards AS (SELECT o_orderkey AS path, CAST(floor(o_totalprice) AS BIGINT) AS size, o_orderpriority AS domain FROM orders)"
NORM = r"trim(regexp_replace(regexp_replace(lower({0}), '[^\p{{L}}\p{{N}}_\s]', ' ', 'g'), '\s+', ' ', 'g'))"
DOC_WORDS = f"dw AS (SELECT doc_id, source, CASE WHEN {NORM.format('text')} = '' THEN [] ELSE string_split({NORM.format('text')}, ' ') END AS w FROM documents)"
ITEM_WORDS = f"iw AS (SELECT item_id, CASE WHEN {NORM.format('text')} = '' THEN [] ELSE string_split({NORM.format('text')}, ' ') END AS w FROM benchmark)"
KEYS = """keys AS (SELECT DISTINCT item_id, ngram FROM (
  SELECT item_id, unnest(CASE WHEN len(w) < 8 THEN [] WHEN len(w) < 13 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 11), lambda i: array_to_string(w[i:i+12], ' ')) END) AS ngram FROM iw)),
idx AS (SELECT item_id, ngram, len(string_split(ngram, ' ')) AS width FROM keys)"""
HITS = f"""{DOC_WORDS}, {ITEM_WORDS}, {KEYS},
widths AS (SELECT DISTINCT width FROM idx),
pos AS (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS pos FROM dw WHERE len(w) >= 8),
grams AS (SELECT doc_id, pos, width, array_to_string(w[pos:pos + width - 1], ' ') AS ngram FROM pos, widths WHERE pos + width - 1 <= len(w)),
hits AS (SELECT g.doc_id, g.pos, g.width, i.item_id FROM grams g JOIN idx i ON g.ngram = i.ngram AND g.width = i.width)"""
COLLAPSED = """found AS (SELECT h.doc_id, CAST(count(DISTINCT p) AS BIGINT) AS matched_words, CAST(count(DISTINCT item_id) AS BIGINT) AS n_items
  FROM hits h, unnest(range(h.pos, h.pos + h.width)) AS u(p) GROUP BY h.doc_id)"""


# --- contamination --------------------------------------------------------------------------------------------------
@query("jn06_contam_hits", f"WITH {HITS} SELECT doc_id, CAST(pos AS BIGINT) AS pos, CAST(width AS BIGINT) AS width, item_id FROM hits")
def contam_hits(spark, d):
    return con.scan(documents(spark, d), t(spark, d, "benchmark"))


@query("ag12_contam_doc_hits", f"WITH {HITS}, {COLLAPSED} SELECT * FROM found")
def contam_doc_hits(spark, d):
    return con.collapse(contam_hits(spark, d))


RATES = f"""WITH {HITS}, {COLLAPSED}, r AS (
  SELECT source, CAST(count(*) AS BIGINT) AS docs_scanned, CAST(sum(len(w)) AS BIGINT) AS words_scanned, CAST(count(f.doc_id) AS BIGINT) AS matched_documents,
         CAST(coalesce(sum(matched_words), 0) AS BIGINT) AS matched_span_words
  FROM dw LEFT JOIN found f ON dw.doc_id = f.doc_id GROUP BY source)"""


@query("contam_rate_by_source", f"{RATES} SELECT *, round(matched_documents / docs_scanned, 10) AS matched_document_rate, round(matched_span_words / nullif(words_scanned, 0), 10) AS matched_span_word_rate FROM r")
def contam_rate_by_source(spark, d):
    """AG-08 with JN-06 and AG-12: the flagship."""
    return con.rates_by_source(documents(spark, d), t(spark, d, "benchmark"))


@query("ag09_contam_totals", f"""WITH {HITS}, j AS (SELECT DISTINCT source, h.doc_id, item_id FROM hits h JOIN documents d ON d.doc_id = h.doc_id)
SELECT source, CAST(count(DISTINCT item_id) AS BIGINT) AS items_hit, CAST(count(DISTINCT doc_id) AS BIGINT) AS docs_hit, CAST(grouping(source) AS BIGINT) AS is_total FROM j GROUP BY GROUPING SETS ((source), ())""")
def contam_totals(spark, d):
    return con.totals(contam_hits(spark, d), t(spark, d, "documents"))


@query("jn08_exposure_by_mixture", f"""{RATES}, rr AS (SELECT source, round(matched_document_rate_, 10) AS rate FROM (SELECT source, matched_documents / docs_scanned AS matched_document_rate_ FROM r)),
n AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM rr), k AS (SELECT source, row_number() OVER (ORDER BY source) AS k FROM rr), s AS (SELECT CAST(sum(k) AS DOUBLE) AS s FROM k)
SELECT 'even' AS mix_id, round(sum(rate / n.n), 10) AS exposure FROM rr, n UNION ALL SELECT 'ramp', round(sum(rate * k / s.s), 10) FROM rr JOIN k USING (source), s""")
def exposure_by_mixture(spark, d):
    from pyspark.sql import Window as W

    rates = checkpoint(contam_rate_by_source(spark, d).select("source", "matched_document_rate"))
    k = rates.select("source", F.row_number().over(W.orderBy("source")).alias("k"), F.count("*").over(W.partitionBy()).alias("n"))
    total = F.sum("k").over(W.partitionBy())
    even = k.select(F.lit("even").alias("mix_id"), "source", (1 / F.col("n")).alias("weight"))
    ramp = k.select(F.lit("ramp").alias("mix_id"), "source", (F.col("k") / total).alias("weight"))
    return con.exposure(rates, even.unionByName(ramp), "matched_document_rate")


@query("ag06_item_index_stats", f"""WITH {ITEM_WORDS}, {KEYS}, p AS (SELECT array_to_string(string_split(ngram, ' ')[1:8], ' ') AS prefix, count(DISTINCT width) AS n FROM idx GROUP BY 1)
SELECT (SELECT count(*) FROM iw) AS items, (SELECT count(*) FROM iw WHERE len(w) < 8) AS not_assessable, (SELECT count(*) FROM iw WHERE len(w) BETWEEN 8 AND 12) AS short,
 (SELECT count(*) FROM idx) AS item_keys, (SELECT count(DISTINCT ngram) FROM idx) AS exact_keys, (SELECT count(*) FROM p) AS prefixes, (SELECT count(*) FROM p WHERE n > 1) AS multi_width_prefixes""")
def item_index_stats(spark, d):
    return con.index_summary(t(spark, d, "benchmark"))


@query("fn09_item_identity", f"WITH {ITEM_WORDS} SELECT item_id, sha256(array_to_string(w, ' ')) AS stem_sha256, CAST(len(w) AS BIGINT) AS stem_words, CASE WHEN len(w) < 8 THEN 'not_assessable' WHEN len(w) < 13 THEN 'short' ELSE 'full' END AS length_class FROM iw")
def item_identity(spark, d):
    w = text.words(text.normalize(F.col("text")))
    return t(spark, d, "benchmark").select("item_id", text.sha256(F.array_join(w, " ")).alias("stem_sha256"), F.size(w).cast("long").alias("stem_words"), text.length_class(w).alias("length_class"))


@query("ag24_common_prefix", """WITH m AS (SELECT source, min(text) AS lo, max(text) AS hi FROM documents GROUP BY source)
SELECT source, lo[1:coalesce(list_max(list_filter(range(0, least(len(lo), len(hi)) + 1), lambda i: lo[1:i] = hi[1:i])), 0)] AS prefix FROM m""")
def common_prefix(spark, d):
    m = t(spark, d, "documents").groupBy("source").agg(F.min("text").alias("lo"), F.max("text").alias("hi"))
    return m.select("source", text.common_prefix(F.col("lo"), F.col("hi")).alias("prefix"))


@query("fn07_shared_word_prefix", f"""WITH {DOC_WORDS}, n AS (SELECT source, doc_id, w, lead(w) OVER (PARTITION BY source ORDER BY doc_id) AS v FROM dw)
SELECT doc_id, CAST(coalesce(list_min(list_filter(range(1, least(len(w), len(v)) + 1), lambda i: w[i] <> v[i])) - 1, least(len(w), len(v))) AS BIGINT) AS shared FROM n WHERE v IS NOT NULL""")
def shared_prefix(spark, d):
    docs = t(spark, d, "documents").select("source", "doc_id", text.normalize(F.col("text")).alias("n"))
    n = next_value(docs, F.coalesce("n", F.lit("")), ["doc_id"], ["source"], out="v").where("v is not null")
    return n.select("doc_id", text.shared_word_prefix(text.words(F.col("n")), text.words(F.col("v"))).alias("shared"))


@query("wn06_strip_exemplars", f"""WITH {ITEM_WORDS}, a AS (SELECT item_id, w, lead(w) OVER (ORDER BY w, item_id) AS v FROM iw),
b AS (SELECT *, CASE WHEN v IS NOT NULL THEN coalesce(list_min(list_filter(range(1, least(len(w), len(v)) + 1), lambda i: w[i] <> v[i])) - 1, least(len(w), len(v))) END AS adj FROM a),
c AS (SELECT *, CASE WHEN count(adj) OVER f = 5 THEN min(adj) OVER f END AS win FROM b WINDOW f AS (ORDER BY w, item_id ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING)),
e AS (SELECT *, coalesce(max(win) OVER (ORDER BY w, item_id ROWS BETWEEN 5 PRECEDING AND CURRENT ROW), 0) AS best FROM c)
SELECT 'all' AS label, item_id, CAST(CASE WHEN best >= 8 AND best < len(w) THEN best ELSE 0 END AS BIGINT) AS stripped, array_to_string(w[CASE WHEN best >= 8 AND best < len(w) THEN best ELSE 0 END + 1:], ' ') AS stem FROM e""")
def strip_exemplars(spark, d):
    items = t(spark, d, "benchmark").select(F.lit("all").alias("label"), "item_id", text.words(text.normalize(F.col("text"))).alias("w"))
    return con.strip_shared_prefix(items)


# --- chats ------------------------------------------------------------------------------------------------------------
ROLE = "CASE lower(trim(coalesce(role, 'user'))) WHEN 'system' THEN 'System' WHEN 'user' THEN 'User' WHEN 'assistant' THEN 'Assistant' ELSE 'Other' END"


@query("fn10_chat_flatten", f"SELECT conv_id, CAST(count(*) AS BIGINT) AS n_turns, string_agg({ROLE} || ': ' || trim(text), chr(10) || chr(10) ORDER BY turn) FILTER (trim(coalesce(text, '')) <> '') AS text FROM conversations GROUP BY conv_id")
def chat_flatten(spark, d):
    return chat.flatten_rows(t(spark, d, "conversations"))


@query("ag04_chat_role_counts", "SELECT role, CAST(count(*) AS BIGINT) AS turns, CAST(count(DISTINCT conv_id) AS BIGINT) AS conversations, CAST(count(*) FILTER (trim(coalesce(text, '')) = '') AS BIGINT) AS empty FROM conversations GROUP BY role")
def chat_role_counts(spark, d):
    return t(spark, d, "conversations").groupBy("role").agg(F.count("*").alias("turns"), F.countDistinct("conv_id").alias("conversations"), F.count_if(F.trim(F.coalesce("text", F.lit(""))) == "").alias("empty"))


@query("pf03_language_filter", "SELECT source, CAST(count(*) FILTER (lang IS NULL OR trim(lang) = '' OR lower(trim(lang)) IN ('en','eng','english')) AS BIGINT) AS kept, CAST(count(*) AS BIGINT) AS total FROM documents GROUP BY source")
def language_filter(spark, d):
    docs = t(spark, d, "documents").withColumnRenamed("lang", "language")
    return docs.groupBy("source").agg(F.count_if(chat.keep_row(docs, "openhermes-25")).alias("kept"), F.count("*").alias("total"))


@query("pf01_metadata_exclusion", """SELECT doc_id, NOT (contains(lower(source || ' ' || CAST(doc_id AS VARCHAR)), 'wildguardmix') OR contains(lower(source || ' ' || CAST(doc_id AS VARCHAR)), 'aya')) AS kept_by_substring,
lower(trim(lang)) NOT IN ('safety', 'precise if') AS kept_by_domain FROM documents""")
def metadata_exclusion(spark, d):
    docs = t(spark, d, "documents").withColumnRenamed("doc_id", "id")
    dolci = docs.select("id", F.col("lang").alias("domain"), F.lit(None).cast("string").alias("source_dataset"))
    return docs.select(F.col("id").alias("doc_id"), chat.keep_row(docs, "tulu-3").alias("kept_by_substring")).join(dolci.select(F.col("id").alias("doc_id"), chat.keep_row(dolci, "dolci").alias("kept_by_domain")), "doc_id")


@query("fn14_domain_map", """SELECT p_partkey, CASE WHEN contains(lower(p_type), 'code_alpaca') OR contains(lower(p_type), 'codealpaca') THEN 'code' WHEN contains(lower(p_type), 'science') THEN 'science' WHEN contains(lower(p_type), 'sharegpt') OR contains(lower(p_type), 'hard_coded') THEN 'chat' ELSE 'general' END AS domain FROM part""")
def domain_map(spark, d):
    parts = t(spark, d, "part").select("p_partkey", F.col("p_type").alias("dataset"))
    return parts.select("p_partkey", chat.map_domain(parts, "tulu-v2").alias("domain"))


@query("pf09_normalise_report", "SELECT source, CAST(count(*) FILTER (lang = 'en' AND trim(text) <> '') AS BIGINT) AS kept, CAST(count(*) FILTER (lang IS DISTINCT FROM 'en') AS BIGINT) AS dropped, CAST(count(*) FILTER (lang = 'en' AND trim(coalesce(text,'')) = '') AS BIGINT) AS empty FROM documents GROUP BY source")
def normalise_report(spark, d):
    en, full = F.coalesce(F.col("lang") == "en", F.lit(False)), F.trim(F.coalesce("text", F.lit(""))) != ""
    return t(spark, d, "documents").groupBy("source").agg(F.count_if(en & full).alias("kept"), F.count_if(~en).alias("dropped"), F.count_if(en & ~full).alias("empty"))


@query("fn13_row_ids", "SELECT conv_id, turn, 'chat:' || CAST(conv_id AS VARCHAR) AS row_id FROM conversations")
def row_ids(spark, d):
    c = t(spark, d, "conversations").withColumnRenamed("conv_id", "conversation_id")
    return c.select(F.col("conversation_id").alias("conv_id"), "turn", chat.row_id(c, "chat", F.lit(0)).alias("row_id"))


# --- shards and samples -----------------------------------------------------------------------------------------------
@query("wn01_greedy_sample", f"""WITH {SHARDS}, o AS (SELECT *, sum(size) OVER (PARTITION BY domain ORDER BY md5('7:' || CAST(path AS VARCHAR)) ROWS UNBOUNDED PRECEDING) AS cum, sum(size) OVER (PARTITION BY domain) AS total FROM shards)
SELECT domain, path, size, CAST(cum AS BIGINT) AS cum FROM o WHERE cum - size < total * 0.3""")
def greedy_sample(spark, d):
    s = with_totals(shards(spark, d), {"total": F.sum("size")}, ["domain"])
    return sampling.greedy_prefix(s, "size", F.col("total") * 0.3, sampling.hash_order(7, F.col("path"))).select("domain", "path", "size", "cum")


@query("sm03_capped_policy", f"""WITH {SHARDS}, o AS (SELECT *, sum(size) OVER (PARTITION BY domain ORDER BY md5('7:' || CAST(path AS VARCHAR)) ROWS UNBOUNDED PRECEDING) AS cum, row_number() OVER (PARTITION BY domain ORDER BY md5('7:' || CAST(path AS VARCHAR))) AS rn FROM shards)
SELECT domain, CAST(count(*) AS BIGINT) AS n, CAST(sum(size) AS BIGINT) AS bytes FROM o WHERE domain = '1-URGENT' OR cum - size < 5000000 * 1.15 OR rn = 1 GROUP BY domain""")
def capped_policy(spark, d):
    s = shards(spark, d)
    capped = sampling.greedy_prefix(s.where("domain <> '1-URGENT'"), "size", F.lit(5_000_000 * 1.15), sampling.hash_order(7, F.col("path")), at_least_one=True)
    both = s.where("domain = '1-URGENT'").unionByName(capped.select("path", "size", "domain"))
    return both.groupBy("domain").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))


@query("sm02_byte_token_estimate", f"WITH {SHARDS} SELECT path, round(1000000.0 * size / sum(size) OVER (PARTITION BY domain), 6) AS est_tokens FROM shards")
def byte_token_estimate(spark, d):
    s = shards(spark, d)
    return s.select("path", F.round(sampling.estimated_tokens(s, F.lit(1e6)), 6).alias("est_tokens"))


@query("sm06_band_topup", f"""WITH {SHARDS}, c AS (SELECT *, sum(size) OVER (PARTITION BY domain ORDER BY size, path ROWS UNBOUNDED PRECEDING) AS cum, sum(size) OVER (PARTITION BY domain) AS total FROM shards)
SELECT domain, path, size FROM c WHERE (cum - size) * 0.25::DOUBLE < total * 0.1::DOUBLE / 1.1 AND cum * 0.25::DOUBLE <= total * 0.1::DOUBLE / 0.9""")
def band_topup(spark, d):
    s, total = with_totals(shards(spark, d), {"total": F.sum("size")}, ["domain"]), F.col("total")
    s = s.select("domain", "path", "size", F.lit(0.25).alias("rate"), F.lit(0.0).alias("have"), (total * 0.1 / 1.1).alias("floor"), (total * 0.1 / 0.9).alias("ceiling"))
    return sampling.band_topup(s).select("domain", "path", "size")


@query("sm08_trim_to_budget", r"""WITH RECURSIVE d AS (SELECT doc_id, CAST(len(string_split_regex(text, '\s+')) AS BIGINT) AS n, row_number() OVER (ORDER BY md5('3:' || CAST(doc_id AS VARCHAR))) AS rn FROM documents),
p AS (SELECT target, CAST(floor(target * 0.98::DOUBLE) AS BIGINT) AS low, CAST(floor(target * 1.02::DOUBLE) AS BIGINT) AS high FROM (SELECT CAST(floor(sum(n) * 0.4::DOUBLE) AS BIGINT) AS target FROM d)),
r(rn, doc_id, n, have, kept) AS (SELECT CAST(0 AS BIGINT), CAST(NULL AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT), false
  UNION ALL SELECT s.rn, s.doc_id, s.n, s.have + CASE WHEN s.take THEN s.n ELSE 0 END, s.take FROM (SELECT d.rn, d.doc_id, d.n, r.have, r.have < target AND NOT (r.have >= low AND r.have + d.n > high AND r.have > 0) AS take FROM r JOIN d ON d.rn = r.rn + 1 CROSS JOIN p WHERE r.have < target) s)
SELECT doc_id, n FROM r WHERE kept""")
def trim_to_budget(spark, d):
    docs = t(spark, d, "documents").select("doc_id", F.size(F.split("text", r"\s+")).cast("long").alias("n"))
    target = int((docs.agg(F.sum("n")).first()[0] or 0) * 0.4)
    return sampling.trim_to_budget(docs, "n", target, sampling.hash_order(3, F.col("doc_id")))


@query("sm09_holdout_counts", "SELECT source, CAST(count(*) AS BIGINT) AS n, CAST(least(round_even(count(*) * 0.0015::DOUBLE, 0), count(*) - 1) AS BIGINT) AS val FROM documents GROUP BY source UNION ALL SELECT 'all', CAST(count(*) AS BIGINT), CAST(least(round_even(count(*) * 0.0015::DOUBLE, 0), count(*) - 1) AS BIGINT) FROM lineitem")
def holdout_counts(spark, d):
    a = t(spark, d, "documents").groupBy("source").agg(F.count("*").alias("n"))
    b = t(spark, d, "lineitem").agg(F.lit("all").alias("source"), F.count("*").alias("n"))
    return a.unionByName(b).withColumn("val", sampling.holdout_count(F.col("n"), 0.0015))


@query("sm10_holdout_split", """WITH r AS (SELECT doc_id, source, lang, row_number() OVER (PARTITION BY source, lang ORDER BY md5('11:' || CAST(doc_id AS VARCHAR)), doc_id) AS rn, count(*) OVER (PARTITION BY source, lang) AS n FROM documents)
SELECT doc_id, source, lang, CASE WHEN rn <= least(CAST(round_even(n * 0.1::DOUBLE, 0) AS BIGINT), n - 1) THEN 'val' ELSE 'train' END AS split FROM r""")
def holdout_split(spark, d):
    return sampling.holdout_split(t(spark, d, "documents").select("doc_id", "source", "lang"), 0.1, 11, "doc_id", ["source", "lang"])


@query("sm12_apportion", """WITH s AS (SELECT source, CAST(count(*) AS DOUBLE) AS weight FROM documents GROUP BY source), r AS (SELECT *, weight / sum(weight) OVER () * 1000 AS raw FROM s),
b AS (SELECT *, floor(raw) AS base, 1000 - sum(floor(raw)) OVER () AS left_, row_number() OVER (ORDER BY raw - floor(raw) DESC, raw DESC, source) AS rk FROM r)
SELECT source, weight, CAST(base + CASE WHEN rk <= left_ THEN 1 ELSE 0 END AS BIGINT) AS n FROM b""")
def apportion(spark, d):
    s = t(spark, d, "documents").groupBy("source").agg(F.count("*").cast("double").alias("weight"))
    return sampling.apportion(s, "weight", 1000, "source")


@query("sm13_plan_without_replacement", """WITH r AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5('5:' || lang || ':' || CAST(doc_id AS VARCHAR)), doc_id) AS rn, count(*) OVER (PARTITION BY lang) AS n FROM documents)
SELECT doc_id, lang, md5('5-order:' || lang || ':' || CAST(doc_id AS VARCHAR)) AS shuffle_key FROM r WHERE rn <= n // 2""")
def plan_without_replacement(spark, d):
    docs = t(spark, d, "documents").select("doc_id", "lang")
    counts = docs.groupBy("lang").agg((F.floor(F.count("*") / 2)).alias("n"))
    return sampling.plan_without_replacement(docs, counts, 5, "lang", "doc_id")


@query("sm14_draw_with_replacement", """WITH s AS (SELECT event_id AS slot, CAST(('0x' || md5('9:' || CAST(event_id AS VARCHAR))[1:13]) AS BIGINT) / 4503599627370496.0 AS u FROM events)
SELECT slot, CASE WHEN u < 0.5 THEN 'a' WHEN u < 0.75 THEN 'b' ELSE 'c' END AS domain FROM s""")
def draw_with_replacement(spark, d):
    slots = t(spark, d, "events").select(F.col("event_id").alias("slot"))
    weights = spark.createDataFrame([("a", 2.0, 0), ("b", 1.0, 1), ("c", 1.0, 2)], "domain string, weight double, ord int")
    return sampling.draw_with_replacement(slots, weights, 9)


@query("sm11_tail_carve", """WITH s AS (SELECT p_partkey AS ord, CAST(p_size * 4 AS BIGINT) AS bytes FROM part), e AS (SELECT *, sum(bytes) OVER (ORDER BY ord ROWS UNBOUNDED PRECEDING) AS e, sum(bytes) OVER () AS total FROM s),
v AS (SELECT ord, bytes, CAST(least(bytes, greatest(0, CAST(floor(total * 0.05::DOUBLE / 4) AS BIGINT) * 4 - (total - e))) AS BIGINT) AS val_bytes FROM e) SELECT ord, bytes, val_bytes, bytes - val_bytes AS train_bytes FROM v""")
def tail_carve(spark, d):
    s = t(spark, d, "part").select(F.col("p_partkey").alias("ord"), (F.col("p_size") * 4).cast("long").alias("bytes"))
    return sampling.tail_carve(s, 0.05)


@query("sk05_byte_shards", """WITH s AS (SELECT p_partkey AS ord, CAST(p_size * 4 AS BIGINT) AS bytes FROM part), e AS (SELECT ord, bytes, CAST(sum(bytes) OVER (ORDER BY ord ROWS UNBOUNDED PRECEDING) AS BIGINT) AS e FROM s),
x AS (SELECT ord, e - bytes AS a, e, unnest(range((e - bytes) // 1000, (e - 1) // 1000 + 1)) AS shard FROM e WHERE bytes > 0) SELECT ord, shard, greatest(a, shard * 1000) AS start, least(e, (shard + 1) * 1000) AS "end" FROM x""")
def byte_shards(spark, d):
    s = t(spark, d, "part").select(F.col("p_partkey").alias("ord"), (F.col("p_size") * 4).cast("long").alias("bytes"))
    return sampling.byte_shards(s, 1000)


@query("wn04_balanced_slices", """WITH s AS (SELECT doc_id, n_chars, coalesce(sum(n_chars) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b, sum(n_chars) OVER () AS total FROM documents)
SELECT least(CAST(floor(b * 8 / total) AS BIGINT), 7) AS slice, CAST(count(*) AS BIGINT) AS docs, CAST(sum(n_chars) AS BIGINT) AS chars FROM s GROUP BY 1""")
def balanced_slices(spark, d):
    s = sampling.balanced_slices(t(spark, d, "documents").select("doc_id", "n_chars"), "n_chars", 8, "doc_id")
    return s.groupBy("slice").agg(F.count("*").alias("docs"), F.sum("n_chars").alias("chars"))


# --- joins, windows, sets ---------------------------------------------------------------------------------------------
SPANS = "sp AS (SELECT source, doc_id, CAST(sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS e, n_chars AS n FROM documents)"


def spans(spark, d) -> DataFrame:
    """Documents laid end to end by source."""
    docs = t(spark, d, "documents").select("source", "doc_id", F.col("n_chars").alias("n"))
    return relational.offsets(docs, F.col("n"), "source", "doc_id")


@query("wn03_offset_cumsum", f"WITH {SPANS} SELECT source, doc_id, e - n AS start, e AS \"end\" FROM sp")
def offset_cumsum(spark, d):
    return spans(spark, d).select("source", "doc_id", "start", "end")


#: Length of an object of the laid-out stream, in characters.
OBJECT = 5000
OBJECTS = f"ob AS (SELECT source, unnest(range(0, CAST(ceil(max(e) / {OBJECT}.0) AS BIGINT))) AS obj FROM sp GROUP BY source)"


@query("jn09_interval_overlap", f"WITH {SPANS}, {OBJECTS} SELECT sp.source, doc_id, obj, least(e, obj * {OBJECT} + {OBJECT}) - greatest(e - n, obj * {OBJECT}) AS shared FROM sp JOIN ob USING (source) WHERE e - n < obj * {OBJECT} + {OBJECT} AND e > obj * {OBJECT} AND n > 0")
def interval_overlap(spark, d):
    s = spans(spark, d)
    objects = s.groupBy("source").agg(F.max("end").alias("m")).select("source", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("m") / OBJECT) - 1)).alias("obj"))
    a = s.select("source", "doc_id", F.col("start").alias("a_start"), F.col("end").alias("a_end"))
    b = objects.select("source", "obj", (F.col("obj") * OBJECT).alias("b_start"), (F.col("obj") * OBJECT + OBJECT).alias("b_end"))
    return relational.interval_overlap(a, b, "source", 2 * OBJECT).select("source", "doc_id", "obj", (F.least("a_end", "b_end") - F.greatest("a_start", "b_start")).alias("shared"))


@query("jn10_point_in_interval", f"WITH {SPANS}, p AS (SELECT source, max(e) // 2 AS point FROM sp GROUP BY 1) SELECT source, point, doc_id FROM p JOIN sp USING (source) WHERE point >= e - n AND point < e")
def point_in_interval(spark, d):
    s = spans(spark, d)
    points = s.groupBy("source").agg(F.floor(F.max("end") / 2).alias("point"))
    return relational.point_in_interval(points, s, "source", "point", 2 * OBJECT).select("source", "point", "doc_id")


@query("jn01_left_index", "SELECT d.doc_id, l.quality, l.doc_id IS NULL AS missing FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def left_index(spark, d):
    l = t(spark, d, "labels").select(F.col("doc_id").alias("k"), "quality")  # noqa: E741
    return t(spark, d, "documents").join(l, F.col("doc_id") == F.col("k"), "left").select("doc_id", "quality", F.col("k").isNull().alias("missing"))


@query("jn02_anti_existing", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)")
def anti_existing(spark, d):
    return t(spark, d, "documents").join(t(spark, d, "labels"), "doc_id", "left_anti").select("doc_id")


@query("jn03_semi_either", "SELECT doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1 UNION SELECT doc_id FROM labels WHERE quality = 0)")
def semi_either(spark, d):
    l = t(spark, d, "labels")  # noqa: E741
    kept = l.where("toxic = 1").select("doc_id").union(l.where("quality = 0").select("doc_id"))
    return t(spark, d, "documents").join(kept, "doc_id", "left_semi").select("doc_id")


@query("jn04_manifest_join", "SELECT row_number() OVER (ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id) - 1 AS ord, doc_id, CAST(length(text) AS BIGINT) AS n FROM documents")
def manifest_join(spark, d):
    docs = t(spark, d, "documents")
    manifest = ranked(docs.select("doc_id"), [F.md5(F.col("doc_id").cast("string")), "doc_id"], out="ord").withColumn("ord", F.col("ord") - 1)
    gates.require(gates.missing(manifest, docs, "doc_id"), "rows missing from the source")
    return manifest.join(docs, "doc_id").select("ord", "doc_id", F.length("text").cast("long").alias("n")).orderBy("ord")


@query("jn12_identity_full_outer", """SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, CASE WHEN a.doc_id IS NULL THEN 'only_right' WHEN b.doc_id IS NULL THEN 'only_left' ELSE 'differs' END AS kind
FROM (SELECT doc_id, 1 AS v FROM documents) a FULL JOIN (SELECT doc_id, quality AS v FROM labels) b ON a.doc_id = b.doc_id WHERE a.v IS DISTINCT FROM b.v""")
def identity_full_outer(spark, d):
    a = t(spark, d, "documents").select("doc_id", F.lit(1).alias("v"))
    return gates.identity_mismatches(a, t(spark, d, "labels").select("doc_id", F.col("quality").alias("v")), ["doc_id"], "v")


@query("jn18_first_existing", """WITH c AS (SELECT c_custkey, unnest(['9999999', CAST(c_custkey * 2 AS VARCHAR), CAST(c_custkey AS VARCHAR)]) AS path, unnest([1, 2, 3]) AS pr FROM customer), l AS (SELECT CAST(o_custkey AS VARCHAR) AS path FROM orders)
SELECT k.c_custkey, x.path FROM customer k LEFT JOIN (SELECT c_custkey, arg_min(path, pr) AS path FROM c WHERE path IN (SELECT path FROM l) GROUP BY 1) x ON k.c_custkey = x.c_custkey""")
def first_existing(spark, d):
    k = F.col("c_custkey")
    wanted = t(spark, d, "customer").select("c_custkey", F.array(F.lit("9999999"), (k * 2).cast("string"), k.cast("string")).alias("candidates"))
    return relational.first_existing(wanted, t(spark, d, "orders").select(F.col("o_custkey").cast("string").alias("path")), "c_custkey")


@query("jn19_fill_missing", """WITH p AS (SELECT o_custkey AS k, count(*) AS v FROM orders WHERE o_orderstatus = 'F' GROUP BY 1), f AS (SELECT o_custkey AS k, count(*) AS v FROM orders GROUP BY 1)
SELECT coalesce(p.k, f.k) AS k, coalesce(p.v, f.v) AS v, (p.v IS NULL OR f.v IS NULL OR p.v = f.v) AS agrees FROM p FULL JOIN f ON p.k = f.k""")
def fill_missing(spark, d):
    o = t(spark, d, "orders").select(F.col("o_custkey").alias("k"), "o_orderstatus")
    return relational.fill_missing(o.where("o_orderstatus = 'F'").groupBy("k").agg(F.count("*").alias("v")), o.groupBy("k").agg(F.count("*").alias("v")), ["k"], "v")


@query("se02_append_new", "SELECT doc_id FROM labels UNION ALL SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)")
def append_new(spark, d):
    return relational.append_new(t(spark, d, "labels").select("doc_id"), t(spark, d, "documents").select("doc_id"), "doc_id")


@query("se03_first_wins", "SELECT text, min(doc_id) AS doc_id FROM documents GROUP BY text")
def first_wins(spark, d):
    return relational.first_wins(t(spark, d, "documents").select("text", "doc_id"), ["text"], "doc_id")


@query("wn09_last_write_wins", "SELECT user_id, arg_max(value, event_id) AS value FROM events GROUP BY user_id")
def last_write_wins(spark, d):
    return relational.last_wins(t(spark, d, "events").select("user_id", "event_id", "value"), ["user_id"], "event_id").select("user_id", "value")


@query("wn10_carry_forward", "SELECT event_id, last_value(CASE WHEN event_type = 'purchase' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS last_mark FROM events")
def carry_forward(spark, d):
    e = t(spark, d, "events").select("event_id", "user_id", F.when(F.col("event_type") == "purchase", F.col("event_id")).alias("mark"))
    return relational.carry_forward(e, "mark", "user_id", "event_id").select("event_id", "last_mark")


@query("wn05_segment_lengths", "SELECT source, doc_id, lead(doc_id, 1, 1000000000) OVER (PARTITION BY source ORDER BY doc_id) - doc_id AS length FROM documents")
def segment_lengths(spark, d):
    return relational.segments(t(spark, d, "documents").select("source", "doc_id"), "source", "doc_id", 1_000_000_000)


@query("wn11_ordinal_windows", "WITH x AS (SELECT coalesce(sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER (ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM events) SELECT CAST(b // 50 AS BIGINT) AS \"window\", CAST(count(*) AS BIGINT) AS n FROM x GROUP BY 1")
def ordinal_windows(spark, d):
    e = t(spark, d, "events").select("event_id", "event_type")
    return relational.ordinal_windows(e, F.col("event_type") == "purchase", 50, "event_id").groupBy("window").agg(F.count("*").alias("n"))


@query("ag03_shard_rollup", f"WITH {SHARDS} SELECT domain, CAST(size % 3 AS BIGINT) AS part, CAST(count(*) AS BIGINT) AS n, CAST(sum(size) AS BIGINT) AS bytes FROM shards GROUP BY ROLLUP (domain, CAST(size % 3 AS BIGINT))")
def shard_rollup(spark, d):
    s = shards(spark, d).withColumn("part", (F.col("size") % 3).cast("long"))
    return s.rollup("domain", "part").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))


@query("ag02_share_of_total", f"WITH {SHARDS} SELECT domain, CAST(sum(size) AS BIGINT) AS bytes, round_even(CAST(sum(size) AS DOUBLE) / sum(sum(size)) OVER (), 6) AS share FROM shards GROUP BY domain")
def share_of_total(spark, d):
    from pyspark.sql import Window as W

    s = shards(spark, d).groupBy("domain").agg(F.sum("size").alias("bytes"))
    return s.withColumn("share", F.bround(F.col("bytes") / F.sum("bytes").over(W.partitionBy()), 6))


@query("ag25_key_digest", "SELECT source, sha256(array_to_string(list_sort(list(doc_id)), ',')) AS digest FROM documents GROUP BY source")
def key_digest(spark, d):
    return t(spark, d, "documents").groupBy("source").agg(text.key_digest(F.col("doc_id")).alias("digest"))


@query("fn16_shard_names", "SELECT doc_id, printf('%05d', doc_id) || '__' || source || '__' || left(lang, 60) || '__' || sha1(CAST(doc_id AS VARCHAR) || '/' || source)[1:10] AS name FROM documents")
def shard_names(spark, d):
    key = F.concat(F.col("doc_id").cast("string"), F.lit("/"), F.col("source"))
    return t(spark, d, "documents").select("doc_id", text.shard_name(F.col("doc_id"), F.col("source"), F.col("lang"), key=key).alias("name"))


@query("se08_duplicate_keys", "SELECT text, CAST(count(*) AS BIGINT) AS n FROM documents GROUP BY text HAVING count(*) > 1")
def duplicate_keys(spark, d):
    return gates.duplicate_keys(t(spark, d, "documents"), "text")


@query("vg04_tiling_gaps", f"WITH {SPANS}, g AS (SELECT sp.source, sp.doc_id, e - n AS start, e AS \"end\" FROM sp JOIN documents d ON d.doc_id = sp.doc_id AND d.lang = 'en'), x AS (SELECT *, coalesce(lag(\"end\") OVER (PARTITION BY source ORDER BY start, \"end\"), 0) AS expected FROM g) SELECT source, start, expected FROM x WHERE start <> expected")
def tiling_gaps(spark, d):
    """The layout of all documents without those that a language filter drops: the gaps they leave."""
    s = spans(spark, d).join(t(spark, d, "documents").where("lang = 'en'").select("doc_id"), "doc_id", "left_semi")
    return gates.tiling_gaps(s, "source").select("source", "start", "expected")


@query("ag29_accepted", f"WITH {SHARDS} SELECT domain, CAST(count(*) AS BIGINT) AS shards, CAST(count(*) FILTER (size % 4 <> 0) AS BIGINT) AS failures, bool_and(size % 4 = 0) AS accepted FROM shards GROUP BY domain")
def accepted(spark, d):
    return gates.accepted(shards(spark, d), "domain", F.col("size") % 4 != 0)


@query("st08_control_spikes", f"""WITH {ITEM_WORDS}, {KEYS}, g AS (SELECT item_id, min(ngram) AS text FROM idx GROUP BY item_id), k AS (SELECT *, row_number() OVER (ORDER BY item_id) - 1 AS rn, greatest(1, count(*) OVER () // 8) AS step FROM g)
SELECT item_id, text FROM k WHERE rn % step = 0 AND rn < step * 8""")
def control_spikes(spark, d):
    return con.spikes(con.item_index(t(spark, d, "benchmark")), 8)


@query("pf11_stride_filter", "SELECT doc_id FROM documents WHERE doc_id % 7 = 3")
def stride_filter(spark, d):
    """The stride itself is the feature: one of seven tasks that share a scan."""
    return t(spark, d, "documents").where(F.pmod("doc_id", F.lit(7)) == 3).select("doc_id")


@query("st04_top_k", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 32")
def top_k(spark, d):
    return t(spark, d, "orders").select("o_orderkey", "o_totalprice").orderBy(F.col("o_totalprice").desc(), "o_orderkey").limit(32)


@query("se04_set_sizes", "WITH a AS (SELECT DISTINCT o_custkey AS k FROM orders), b AS (SELECT c_custkey AS k FROM customer) SELECT (SELECT count(*) FROM (SELECT k FROM a INTERSECT SELECT k FROM b)) AS both_, (SELECT count(*) FROM (SELECT k FROM a UNION SELECT k FROM b)) AS either, (SELECT count(*) FROM (SELECT k FROM b EXCEPT SELECT k FROM a)) AS only_b")
def set_sizes(spark, d):
    a, b = t(spark, d, "orders").select(F.col("o_custkey").alias("k")).distinct(), t(spark, d, "customer").select(F.col("c_custkey").alias("k"))
    tagged = a.intersect(b).withColumn("w", F.lit("both_")).unionByName(a.union(b).distinct().withColumn("w", F.lit("either"))).unionByName(b.subtract(a).withColumn("w", F.lit("only_b")))
    return tagged.agg(*[F.count_if(F.col("w") == x).alias(x) for x in ("both_", "either", "only_b")])
