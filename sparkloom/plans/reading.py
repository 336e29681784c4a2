"""Registered queries over readers, text functions, filters by source, gates and streams, each with its SQL. Files that a
query reads are written by it first, from the tables, to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkloom.functions import chat, text
from sparkloom.operators import contamination, curves, gates, mixture, relational, sampling, selection
from sparkloom.operators.running import ranked
from sparkloom.sources import arrays, files, ranges, records, rows, writers
from sparkloom.staging import scratch
from sparkloom.streaming import averages, logs

from .analytics import POINTS, SCORES, chosen, points, scores
from .corpus import DOC_WORDS, ITEM_WORDS, KEYS, NORM, SHARDS, documents, shards, t

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return put


# --- readers ----------------------------------------------------------------------------------------------------------
def doc_rows(spark: SparkSession, d: str) -> DataFrame:
    docs = t(spark, d, "documents")
    return docs.select(F.col("doc_id").cast("string").alias("id"), "text", "source", F.struct(F.col("lang").alias("domain")).alias("metadata"))


@query("sc01_compressed_lines", "SELECT source, count(*) AS docs, CAST(sum(length(text)) AS BIGINT) AS chars FROM documents WHERE trim(text) <> '' GROUP BY 1")
def compressed_lines(spark, d):
    """SC-01, SC-04 and SC-10: JSON lines in two codecs; a bad line would raise."""
    path = scratch(spark, "lines")
    for codec in ("gzip", "none"):
        docs = doc_rows(spark, d)
        odd = F.col("id").cast("long") % 2 == 1
        docs.where(odd if codec == "gzip" else ~odd).write.json(f"{path}/{codec}", compression=codec)
    got = files.read_docs(spark, [f"{path}/gzip", f"{path}/none"])
    return got.groupBy("source").agg(F.count("*").alias("docs"), F.sum(F.length("text")).cast("long").alias("chars"))


@query("sc02_lossy_lines", "SELECT doc_id, 'a' || chr(65533) || doc_id AS value FROM documents")
def lossy_lines(spark, d):
    """Lines with a byte that isn't UTF-8."""
    path = scratch(spark, "lossy")
    t(spark, d, "documents").select(F.expr("concat('a', cast(unhex('FF') as string), doc_id)").alias("value")).write.text(path)
    got = files.read_lines(spark, path, lossy=True)
    return got.select(F.regexp_extract("value", "([0-9]+)$", 1).cast("long").alias("doc_id"), "value")


BAD = "CASE doc_id % 5 WHEN 0 THEN '' WHEN 1 THEN '{\"text\": ' WHEN 2 THEN '{\"text\":\"\"}' ELSE '{\"text\":\"x' || doc_id || '\"}' END"


def bad_lines(spark: SparkSession, d: str) -> str:
    path, k = scratch(spark, "bad"), F.col("doc_id") % 5
    line = F.when(k == 0, "").when(k == 1, '{"text": ').when(k == 2, '{"text":""}').otherwise(F.concat(F.lit('{"text":"x'), "doc_id", F.lit('"}')))
    t(spark, d, "documents").select(line.alias("value")).write.text(path)
    return path


@query("sc05_skipped_lines", "SELECT 'x' || doc_id AS text FROM documents WHERE doc_id % 5 > 2")
def skipped_lines(spark, d):
    return files.read_docs(spark, bad_lines(spark, d), "text string", malformed="skip").select("text")


@query("sc06_line_reasons", "SELECT ['blank', 'badjson', 'notext', 'kept'][CAST(least(doc_id % 5, 3) AS INT) + 1] AS reason, count(*) AS n FROM documents GROUP BY 1")
def line_reasons(spark, d):
    got = files.read_rows_with_reason(spark, bad_lines(spark, d))
    return got.groupBy(F.coalesce("reason", F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


@query("fn21_skipped_rows", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN CAST(0 AS BIGINT) ELSE 2 END AS n, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE 'badjson' END AS reason FROM documents")
def skipped_rows(spark, d):
    s = F.when(F.col("doc_id") % 3 == 0, "").otherwise(F.concat(F.lit("3:blank,"), "doc_id", F.lit("0000:badjson")))
    m = text.skipped_rows(s)
    return t(spark, d, "documents").select("doc_id", F.size(m).cast("long").alias("n"), F.try_element_at(m, F.concat(F.col("doc_id").cast("string"), F.lit("0000"))).alias("reason"))


@query("sc07_snapshot", "SELECT count(*) AS docs FROM documents WHERE lang IN ('en', 'fr')")
def snapshot(spark, d):
    """Row files of a snapshot: at its top or in data/, or with dataset in the name; others and tiny ones don't count."""
    path = scratch(spark, "snapshot")
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for lang, name in (("en", "data/a.jsonl"), ("fr", "more/x-dataset-1.jsonl"), ("de", "other/y.txt")):
        t(spark, d, "documents").where(F.col("lang") == lang).select("doc_id", F.rpad(F.lit("x"), 1100, "x").alias("text")).coalesce(1).write.json(f"{path}/tmp-{lang}")
        part = [r.path for r in files.list_files(spark, f"{path}/tmp-{lang}", r"/part-[^/]*\.json$").collect()][0]
        src, dst = jvm.org.apache.hadoop.fs.Path(part), jvm.org.apache.hadoop.fs.Path(f"{path}/snap/{name}")
        fs = dst.getFileSystem(conf)
        fs.mkdirs(dst.getParent())
        fs.rename(src, dst)
    return rows.read_snapshot(spark, f"{path}/snap", "doc_id long, text string").agg(F.count("*").alias("docs"))


#: Bytes of texts of an array file, about: a language of more has more files, as one task writes a file.
ARRAY_BYTES = 32 << 20


def array_files(docs: DataFrame, limit: int = ARRAY_BYTES) -> DataFrame:
    """docs (doc_id, lang, text) with piece: the number of the file of its language that each goes to, by hash."""
    langs = docs.groupBy("lang").agg(F.ceil((F.sum(F.octet_length("text")) + 1) / limit).alias("n")).fillna(1, ["n"])  # one row a language
    first = F.coalesce(F.sum("n").over(W.orderBy("lang").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    langs = langs.select(F.col("lang").alias("_lang"), F.col("n").alias("_n"), first.alias("_first"))
    piece = F.col("_first") + F.pmod(F.xxhash64("doc_id"), "_n")
    return docs.join(F.broadcast(langs), F.col("lang").eqNullSafe(F.col("_lang"))).withColumn("piece", piece).drop("_lang", "_n", "_first")


@query("sc14_json_array", "SELECT doc_id, lang, md5(text) AS md5 FROM documents")
def json_array(spark, d):
    """Files that are one JSON array each, read by pieces that know nothing of elements."""
    path = scratch(spark, "array")
    docs = array_files(t(spark, d, "documents").select("doc_id", "lang", "text"))
    whole = docs.select("piece", "doc_id", F.encode(F.to_json(F.struct("doc_id", "lang", "text")), "utf-8").alias("raw"))
    writers.write_raw(whole, path, "piece", "doc_id", frame=(b"[", b"\n,", b"\n]\n"))
    got = arrays.parsed(arrays.read_array(spark, path, 1 << 16), "doc_id long, lang string, text string")
    return got.select("doc_id", "lang", F.md5("text").alias("md5"))


@query("sc16_rows_by_line", "SELECT doc_id, source FROM documents WHERE doc_id % 10 = 3")
def rows_by_line(spark, d):
    """HX-02 and SC-16: rows of one file by the index of its lines that aren't blank."""
    path = scratch(spark, "rows")
    docs = t(spark, d, "documents").select("doc_id", "source").orderBy("doc_id").coalesce(1)
    docs.select(F.explode(F.array(F.to_json(F.struct("doc_id", "source")), F.lit(" "))).alias("value")).write.text(path)
    got = rows.line_rows(spark, path, "doc_id long, source string")
    wanted = t(spark, d, "documents").where("doc_id % 10 = 3").select(F.col("doc_id").alias("row"))
    return rows.take_rows(got, wanted).select("doc_id", "source")


@query("sc17_tsv_manifest", "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders")
def tsv_manifest(spark, d):
    path = scratch(spark, "tsv")
    o = t(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    o.write.option("sep", "\t").option("header", True).csv(path, compression="gzip")
    return files.read_manifest(spark, path, "o_orderkey long, o_orderstatus string, o_totalprice double")


#: Orders of a token shard, and tokens of a chunk.
SHARD, CHUNK = 1000, 64


def token_shards(spark: SparkSession, d: str) -> tuple[str, DataFrame]:
    """The customers of all orders, in order, as token shards of SHARD tokens; (piece, path, bytes) of the shards."""
    path = scratch(spark, "tokens")
    o = ranked(t(spark, d, "orders").select("o_orderkey", "o_custkey"), ["o_orderkey"]).withColumn("piece", F.floor((F.col("rank") - 1) / SHARD))
    raw = ranges.packed(F.array("o_custkey"), "<u4")
    return path, writers.write_raw(o.withColumn("raw", raw), path, "piece", "rank")


ORDER_SHARDS = f"o AS (SELECT o_custkey AS k, row_number() OVER (ORDER BY o_orderkey) - 1 AS r FROM orders), s AS (SELECT k, r // {SHARD} AS shard, r % {SHARD} AS i FROM o)"


@query("sc18_token_file", f"WITH {ORDER_SHARDS} SELECT CAST(shard AS BIGINT) AS shard, CAST(i // {CHUNK} AS BIGINT) AS chunk, count(*) AS tokens, CAST(sum(k * (i % {CHUNK} + 1)) AS BIGINT) AS total FROM s GROUP BY ALL")
def token_file(spark, d):
    """Chunks of token files, by byte ranges; the last of a file is shorter."""
    path, _ = token_shards(spark, d)
    got = files.read_tokens(spark, path, CHUNK, split=CHUNK * 4 * 3)
    total = F.aggregate(F.transform("tokens", lambda x, i: x * (i + 1)), F.lit(0).cast("long"), lambda a, b: a + b)
    return got.select(F.regexp_extract("path", r"piece-(\d+)", 1).cast("long").alias("shard"), "chunk", F.size("tokens").cast("long").alias("tokens"), total.alias("total"))


@query("sc18_chunks_by_address", f"""WITH {ORDER_SHARDS}, n AS (SELECT shard, count(*) // {CHUNK} AS n FROM s GROUP BY 1), f AS (SELECT shard, n, sum(n) OVER (ORDER BY shard) - n AS first FROM n)
SELECT CAST(first + i // {CHUNK} AS BIGINT) AS chunk, CAST(sum(k * (i % {CHUNK} + 1)) AS BIGINT) AS total FROM s JOIN f USING (shard) WHERE i // {CHUNK} < n AND (first + i // {CHUNK}) % 3 = 1 GROUP BY 1""")
def chunks_by_address(spark, d):
    """Every third chunk of a stream of shards, sought in the files; shards' rests are in none."""
    _, shards = token_shards(spark, d)
    table = shards.select(F.lit("all").alias("domain"), F.col("piece"), "path", (F.col("bytes") / 4).cast("long").alias("tokens"))
    table = table.withColumn("path", F.concat(F.lpad(F.col("piece").cast("string"), 12, "0"), F.lit(" "), "path"))  # in order of their numbers
    n = table.agg(F.sum(F.floor(F.col("tokens") / CHUNK))).first()[0]
    wanted = spark.range(1, n, 3).select(F.lit("all").alias("domain"), F.col("id").alias("chunk"))
    placed = records.chunk_places(wanted, table, CHUNK).withColumn("path", F.substring("path", 14, 1 << 20))
    got = ranges.bytes_at(placed, "length").select("chunk", ranges.numbers(F.col("value"), "<u4").alias("tokens"))
    return got.select("chunk", F.aggregate(F.transform("tokens", lambda x, i: x * (i + 1)), F.lit(0).cast("long"), lambda a, b: a + b).alias("total"))


@query("sc20_float_table", """WITH e AS (SELECT vec_id, embedding AS e, vec_id // 100 AS piece FROM embeddings), r AS (SELECT piece, row_number() OVER (PARTITION BY piece ORDER BY vec_id) - 1 AS "row", e FROM e)
SELECT CAST(piece AS BIGINT) AS piece, CAST("row" AS BIGINT) AS "row", CAST(e[1] AS DOUBLE) AS first, CAST(e[64] AS DOUBLE) AS last FROM r WHERE "row" >= 10 AND "row" < 90""")
def float_table(spark, d):
    """Records of float files, some of each file: the rest isn't read."""
    path, e = scratch(spark, "floats"), t(spark, d, "embeddings").select("vec_id", "embedding")
    packed = e.withColumn("piece", F.floor(F.col("vec_id") / 100)).withColumn("raw", ranges.packed(F.col("embedding"), "<f4"))
    writers.write_raw(packed, path, "piece", "vec_id")
    got = rows.read_float_table(spark, path, 64, split=64 * 4 * 30).where("row >= 10 and row < 90")
    piece = F.regexp_extract("path", r"piece-(\d+)", 1).cast("long").alias("piece")
    return got.select(piece, "row", F.col("scores")[0].cast("double").alias("first"), F.col("scores")[63].cast("double").alias("last"))


@query("sc21_documents_at_offsets", "SELECT doc_id, md5(text) AS md5 FROM documents WHERE doc_id % 3 = 1")
def documents_at_offsets(spark, d):
    """Documents read at the byte offsets of their lines: those whose lines are found by a scan of the offsets."""
    path = scratch(spark, "offsets")
    docs = t(spark, d, "documents").select("doc_id", "text").sortWithinPartitions("doc_id")
    docs.select(F.to_json(F.struct("doc_id", "text")).alias("value")).write.text(path)
    found = ranges.lines_at(rows.line_offsets(spark, path).withColumnRenamed("file", "path"))
    r = F.from_json("value", "doc_id long, text string", {"mode": "FAILFAST"})
    return found.select(r.alias("r")).where("r.doc_id % 3 = 1").select("r.doc_id", F.md5("r.text").alias("md5"))


@query("sc22_loaded_curves", f"WITH {POINTS} SELECT step, run AS label, round(loss, 8) AS bpb FROM pts")
def loaded_curves(spark, d):
    path = scratch(spark, "curves")
    m = F.map_from_entries(F.array_sort(F.collect_list(F.struct("run", "loss"))))
    points(spark, d).groupBy("step").agg(m.alias("task_loss_bpb")).write.json(path)
    return files.read_curves(spark, path).select("step", "label", F.round("bpb", 8).alias("bpb"))


@query("sc24_trainer_log", "SELECT o_orderkey AS step, 'loss' AS name, o_custkey / 4.0::DOUBLE AS value FROM orders UNION ALL SELECT o_orderkey, 'eval/acc', 0.5::DOUBLE FROM orders")
def trainer_log(spark, d):
    """Lines with a step and a loss, and lines after them without a step."""
    path = scratch(spark, "log")
    line = F.concat(F.lit("step="), "o_orderkey", F.lit(" loss="), F.format_string("%.2f", F.col("o_custkey") / 4.0))
    o = t(spark, d, "orders").orderBy("o_orderkey").coalesce(1)
    o.select(F.explode(F.array(line, F.lit("noise"), F.lit("eval/acc=0.5"))).alias("value")).write.text(path)
    return files.read_trainer_log(spark, path)


@query("sk01_domain_shards", "SELECT source, lang AS domain, count(*) AS docs FROM documents WHERE trim(text) <> '' GROUP BY 1, 2")
def domain_shards(spark, d):
    path = scratch(spark, "shards")
    files.write_docs(doc_rows(spark, d).withColumn("domain", F.col("metadata.domain")), path, ["source", "domain"])
    got = files.read_docs(spark, path, f"{files.DOC}, domain string")
    return got.groupBy("source", "domain").agg(F.count("*").alias("docs"))


@query("sk04_packed_tokens", "SELECT doc_id AS ord, CAST((len(list_filter(string_split(text, ' '), lambda w: w <> '')) + 1) * 4 AS BIGINT) AS bytes FROM documents")
def packed_tokens(spark, d):
    words = F.filter(F.split("text", " ", -1), lambda w: w != "")
    df = documents(spark, d).select(F.col("doc_id").alias("ord"), F.transform(words, lambda w: F.length(w)).alias("tokens"))
    return files.write_tokens(df, scratch(spark, "packed")).select("ord", "bytes")


@query("hx03_line_audit", "SELECT event_type, count(*) AS lines, CAST(sum(strlen(props) + 1) AS BIGINT) AS bytes FROM events GROUP BY 1")
def line_audit(spark, d):
    path, e = scratch(spark, "audit"), t(spark, d, "events")
    e.select("event_type", "props").write.partitionBy("event_type").text(path, compression="gzip")
    got = files.audit(spark, path).withColumn("event_type", F.regexp_extract("path", "event_type=([^/]*)/", 1))
    return got.groupBy("event_type").agg(F.sum("lines").alias("lines"), F.sum("bytes").cast("long").alias("bytes"))


# --- functions --------------------------------------------------------------------------------------------------------
@query("fn01_normalised", f"SELECT doc_id, {NORM.format('text')} AS text FROM documents")
def normalised(spark, d):
    return documents(spark, d).select("doc_id", text.normalize(F.col("text")).alias("text"))


@query("fn02_sha256", "SELECT doc_id, sha256(text) AS sha256 FROM documents")
def sha256(spark, d):
    return t(spark, d, "documents").select("doc_id", text.sha256(F.col("text")).alias("sha256"))


@query("fn05_ngrams", f"WITH {ITEM_WORDS} SELECT item_id, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))) AS ngram FROM iw WHERE len(w) >= 5")
def ngrams(spark, d):
    w = text.words(text.normalize(F.col("text")))
    items = t(spark, d, "benchmark").select("item_id", F.explode(F.array(w)).alias("w"))
    return items.select("item_id", F.explode(text.ngrams(F.col("w"), 5)).alias("ngram"))


@query("fn06_field_keys", f"WITH {ITEM_WORDS}, {KEYS} SELECT item_id, ngram FROM keys")
def field_keys(spark, d):
    return contamination.item_index(t(spark, d, "benchmark")).select("item_id", "ngram")


@query("pf12_length_classes", f"WITH {DOC_WORDS} SELECT CASE WHEN len(w) < 8 THEN 'not_assessable' WHEN len(w) < 13 THEN 'short' ELSE 'full' END AS class, count(*) AS n FROM dw GROUP BY 1")
def length_classes(spark, d):
    w = text.words(text.normalize(F.col("text")))
    c = documents(spark, d).select(F.explode(F.array(w)).alias("w")).select(text.length_class(F.col("w")).alias("class"))
    return c.groupBy("class").agg(F.count("*").alias("n"))


@query("fn12_role_labels", "SELECT role, CASE lower(trim(role)) WHEN 'system' THEN 'System' WHEN 'user' THEN 'User' WHEN 'assistant' THEN 'Assistant' ELSE upper(role[1]) || role[2:] END AS label, count(*) AS n FROM (SELECT CASE WHEN turn % 5 = 0 THEN 'critic' ELSE role END AS role FROM conversations) GROUP BY 1, 2")
def role_labels(spark, d):
    role = F.when(F.col("turn") % 5 == 0, "critic").otherwise(F.col("role"))
    return t(spark, d, "conversations").select(role.alias("role")).groupBy("role", chat.role_label(F.col("role")).alias("label")).agg(F.count("*").alias("n"))


@query("fn15_path_domains", "SELECT o_orderkey, CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN o_orderpriority END AS domain FROM orders")
def path_domains(spark, d):
    path = F.concat(F.lit("data/"), "o_orderpriority", F.lit("/"), "o_orderkey")
    return t(spark, d, "orders").select("o_orderkey", text.domain_of_path(path, ["1-URGENT", "2-HIGH"]).alias("domain"))


@query("fn18_first_text", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN lang WHEN doc_id % 3 = 1 THEN source END AS text FROM documents")
def first_text(spark, d):
    k = F.col("doc_id") % 3
    return t(spark, d, "documents").select("doc_id", text.first_text(F.when(k == 0, F.col("lang")).otherwise(" "), F.when(k == 1, F.col("source"))).alias("text"))


@query("fn34_table_cells", "SELECT p_partkey, CASE WHEN p_size % 10 = 0 THEN '-' WHEN p_size / 1000.0 <= 0.01 THEN '<1.0e-02' ELSE printf('%.4f', p_size / 1000.0::DOUBLE) END AS p, CASE WHEN p_size % 7 = 0 THEN NULL ELSE round_even(p_retailprice / 3, 3) END AS x FROM part")
def table_cells(spark, d):
    p = F.when(F.col("p_size") % 10 == 0, F.lit(float("nan"))).otherwise(F.col("p_size") / 1000.0)
    x = F.when(F.col("p_size") % 7 == 0, F.lit(float("inf"))).otherwise(F.col("p_retailprice") / 3)
    return t(spark, d, "part").select("p_partkey", text.p_value_text(p, F.lit(100)).alias("p"), text.finite(x, 3).alias("x"))


@query("fn33_checkpoint_ladder", """WITH f AS (SELECT p_brand AS run, CAST(sum(p_size) % 1500 + count(*) AS BIGINT) AS f FROM part GROUP BY 1)
SELECT run, unnest(list_concat(range(0, CASE WHEN f % 125 > 0 AND f % 125 < 62.5 AND f >= 125 THEN f - f % 125 ELSE f - f % 125 + 1 END, 125), CASE WHEN f % 125 > 0 THEN [f] ELSE [] END)) AS step FROM f""")
def checkpoint_ladder(spark, d):
    """The ladder of each run up to its final step."""
    final = (F.sum("p_size") % 1500 + F.count("*")).cast("long")
    runs = t(spark, d, "part").groupBy(F.col("p_brand").alias("run")).agg(final.alias("final"))
    return runs.select("run", F.explode(curves.ladder_of(F.col("final"))).alias("step"))


@query("fn26_derivative_adjacency", "SELECT p_partkey, round(greatest(0, ((p_size % 7) - 3) * (p_retailprice / 100 - 9)), 8) AS a FROM part")
def derivative_adjacency(spark, d):
    t_ = -((F.col("p_size") % 7) - 3)
    return t(spark, d, "part").select("p_partkey", F.round(mixture.derivative_adjacency(t_, F.col("p_retailprice") / 100, F.lit(9)), 8).alias("a"))


@query("fn29_z_scores", f"WITH {SCORES}, m AS (SELECT pos, avg(x) AS mean, greatest(stddev_pop(x), 1e-6) AS std FROM sc GROUP BY 1) SELECT instance_id, CAST(pos AS INT) AS pos, round((x - mean) / std, 6) AS z FROM sc JOIN m USING (pos)")
def z_scores(spark, d):
    return selection.z_scores(scores(spark, d), "current").select("instance_id", "pos", F.round("z", 6).alias("z"))


# --- filters, samples and fits ----------------------------------------------------------------------------------------
@query("pf02_any_substring", "SELECT p_partkey, NOT (contains(lower(p_type), 'brass') AND p_partkey % 2 = 0) AS kept FROM part")
def any_substring(spark, d):
    p = t(spark, d, "part").select("p_partkey", F.when(F.lower("p_type").contains("brass") & (F.col("p_partkey") % 2 == 0), F.concat(F.lit("x/WildJailbreak "), "p_type")).otherwise(F.col("p_type")).alias("source"))
    return p.select("p_partkey", chat.keep_row(p, "tulu-3").alias("kept"))


@query("pf04_exact_domains", "SELECT doc_id, lang <> 'de' AS kept FROM documents")
def exact_domains(spark, d):
    docs = t(spark, d, "documents").select("doc_id", F.when(F.col("lang") == "de", " Safety ").when(F.col("lang") == "fr", "safety first").otherwise(F.col("lang")).alias("domain"))
    return docs.select("doc_id", chat.keep_row(docs, "dolci").alias("kept"))


@query("pf05_tool_calls", "SELECT conv_id, count(*) FILTER (turn % 4 = 3) = 0 AS kept FROM conversations GROUP BY 1")
def tool_calls(spark, d):
    turn = F.struct(F.when(F.col("turn") % 4 == 3, "f()").otherwise(" ").alias("function_calls"), F.lit(None).cast("string").alias("functions"))
    c = t(spark, d, "conversations").groupBy("conv_id").agg(F.collect_list(turn).alias("messages"))
    return c.select("conv_id", chat.keep_row(c, "dolci").alias("kept"))


@query("pf05_nested_calls", "SELECT conv_id, count(*) FILTER (turn % 5 = 2 OR turn % 7 = 4) = 0 AS kept FROM conversations GROUP BY 1")
def nested_calls(spark, d):
    """Calls as lists and maps, empty or not."""
    calls = F.when(F.col("turn") % 5 == 2, F.array(F.lit(""))).when(F.col("turn") % 3 == 0, F.array().cast("array<string>"))
    named = F.when(F.col("turn") % 7 == 4, F.create_map(F.lit("f"), F.lit(1))).otherwise(F.create_map().cast("map<string,int>"))
    turn = F.struct(calls.alias("function_calls"), named.alias("functions"))
    c = t(spark, d, "conversations").groupBy("conv_id").agg(F.collect_list(turn).alias("messages"))
    return c.select("conv_id", chat.keep_row(c, "dolci").alias("kept"))


@query("pf06_skipped_configs", "SELECT p_partkey, p_size % 3 <> 0 AS kept FROM part")
def skipped_configs(spark, d):
    p = t(spark, d, "part").select("p_partkey", F.when(F.col("p_size") % 3 == 0, " Apigen-80K").when(F.col("p_size") % 3 == 1, "smol-summarize").alias("config"))
    return p.select("p_partkey", chat.keep_row(p, "smoltalk").alias("kept"))


@query("ag20_least_squares", f"WITH {POINTS} SELECT run, round(regr_slope(loss, pow(CAST(step AS DOUBLE), -0.5)), 6) AS b, round(regr_intercept(loss, pow(CAST(step AS DOUBLE), -0.5)), 6) AS a FROM pts GROUP BY 1")
def least_squares(spark, d):
    one = spark.createDataFrame([(0.5,)], "alpha double")
    return curves.profile_fit(points(spark, d), one).select("run", F.round("b", 6).alias("b"), F.round("a", 6).alias("a"))


@query("ag22_position_moments", f"WITH {SCORES} SELECT CAST(pos AS INT) AS pos, count(x) AS n, round(sum(x), 6) AS s, round(sum(x * x), 6) AS ss FROM sc GROUP BY 1")
def position_moments(spark, d):
    m = selection.position_moments(scores(spark, d), "current")
    return m.select("pos", "n", F.round("s", 6).alias("s"), F.round("ss", 6).alias("ss"))


@query("ag28_trajectory_exposure", "WITH x AS (SELECT source AS run, doc_id AS step, n_chars / 1000.0 AS r, lead(doc_id, 1, 1000000) OVER (PARTITION BY source ORDER BY doc_id) - doc_id AS n FROM documents) SELECT run, round(sum(r * n) / 1000000, 6) AS exposure FROM x GROUP BY 1")
def trajectory_exposure(spark, d):
    docs = t(spark, d, "documents").select(F.col("source").alias("run"), F.col("doc_id").alias("step"), "n_chars")
    return contamination.trajectory_exposure(docs, 1_000_000, F.col("n_chars") / 1000.0).withColumn("exposure", F.round("exposure", 6))


@query("sm01_stratified_target", f"WITH {SHARDS}, o AS (SELECT *, sum(size) OVER (PARTITION BY domain ORDER BY md5('2:' || path) ROWS UNBOUNDED PRECEDING) AS cum, 20000000.0::DOUBLE * (domain[1]::INT) / 15 AS target FROM shards) SELECT domain, path FROM o WHERE cum - size < target")
def stratified_target(spark, d):
    """Each domain's share of a target by fixed weights, 1 to 5."""
    target = 20_000_000.0 * F.substring("domain", 1, 1).cast("int") / 15
    return sampling.greedy_prefix(shards(spark, d), "size", target, sampling.hash_order(2, F.col("path"))).select("domain", "path")


@query("sm04_one_at_least", f"WITH {SHARDS}, o AS (SELECT *, sum(size) OVER (PARTITION BY domain ORDER BY md5('4:' || path) ROWS UNBOUNDED PRECEDING) AS cum, row_number() OVER (PARTITION BY domain ORDER BY md5('4:' || path)) AS rn FROM shards) SELECT domain, path FROM o WHERE cum - size < CASE WHEN domain = '5-LOW' THEN 0 ELSE 100000 * 1.15 END OR rn = 1")
def one_at_least(spark, d):
    target = F.when(F.col("domain") == "5-LOW", 0.0).otherwise(100_000 * 1.15)
    return sampling.greedy_prefix(shards(spark, d), "size", target, sampling.hash_order(4, F.col("path")), at_least_one=True).select("domain", "path")


@query("sm15_simplex_points", """WITH e AS (SELECT c_custkey AS id, i, -ln(1 - CAST(('0x' || md5('dirichlet:6:' || c_custkey || ':' || i)[1:13]) AS BIGINT) / 4503599627370496.0) AS e FROM customer, range(3) b(i)), s AS (SELECT *, sum(e) OVER (PARTITION BY id) AS total FROM e)
SELECT id, CAST(i AS INT) AS domain, round(e / total, 8) AS weight FROM s""")
def simplex_points(spark, d):
    """A mixture for each customer."""
    c = mixture.simplex_points(t(spark, d, "customer").select(F.col("c_custkey").alias("id")), "id", 3, 6)
    return c.select("id", F.posexplode("w").alias("domain", "w")).select("id", "domain", F.round("w", 8).alias("weight"))


@query("wn07_top_of_row", chosen("x").replace("0.6::DOUBLE", "0.25::DOUBLE"))
def top_of_row(spark, d):
    return selection.top_fraction(scores(spark, d), F.col("current"), 0.25).select("instance_id", "pos", "weight")


@query("wn08_middle_of_row", chosen("x", "((n - keep) // 2)").replace("0.6::DOUBLE", "0.3::DOUBLE"))
def middle_of_row(spark, d):
    return selection.middle_fraction(scores(spark, d), F.col("current"), 0.3).select("instance_id", "pos", "weight")


@query("tk02_full_selection", f"WITH {SCORES} SELECT instance_id, CAST(pos AS INT) AS pos, CAST(valid AS INT) AS weight FROM sc")
def full_selection(spark, d):
    """TK-01 and TK-02: the dispatcher's method that takes every valid token."""
    return selection.select_tokens(scores(spark, d), "full").select("instance_id", "pos", "weight")


@query("tk09_keep_counts", "SELECT p_size AS n, CAST(least(greatest(round_even(p_size * 0.3::DOUBLE, 0), 1), p_size) AS BIGINT) AS keep FROM part GROUP BY 1")
def keep_counts(spark, d):
    return t(spark, d, "part").select(F.col("p_size").alias("n")).distinct().select("n", selection.keep_count(F.col("n").cast("long"), 0.3).alias("keep"))


# --- gates ------------------------------------------------------------------------------------------------------------
@query("vg02_spikes_found", f"WITH {ITEM_WORDS}, {KEYS}, g AS (SELECT item_id, row_number() OVER (ORDER BY item_id) - 1 AS rn, greatest(1, count(*) OVER () // 8) AS step FROM (SELECT DISTINCT item_id FROM idx)) SELECT item_id, true AS found FROM g WHERE rn % step = 0 AND rn < step * 8")
def spikes_found(spark, d):
    """Control items scanned as documents beside the corpus: each must be found, and is then taken out by its id."""
    items = t(spark, d, "benchmark")
    spikes = contamination.spikes(contamination.item_index(items), 8).select((-1 - F.col("item_id")).alias("doc_id"), F.concat(F.lit("before "), "text", F.lit(" after")).alias("text"))
    docs = documents(spark, d).select("doc_id", "text").unionByName(spikes)
    hits = contamination.scan(docs, items).where("doc_id < 0 and item_id = -1 - doc_id").select("doc_id").distinct().withColumn("found", F.lit(True))
    return spikes.join(hits, "doc_id", "left").select((-1 - F.col("doc_id")).alias("item_id"), F.coalesce("found", F.lit(False)).alias("found"))


@query("vg03_missing_tasks", "SELECT doc_id AS task FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def missing_tasks(spark, d):
    expected, found = (t(spark, d, n).select(F.col("doc_id").alias("task")) for n in ("documents", "labels"))
    return gates.missing(expected, found, "task")


@query("vg07_misaligned", "SELECT p_partkey FROM part WHERE p_size % 4 <> 0 OR p_size <> p_size - p_partkey % 2")
def misaligned(spark, d):
    p = t(spark, d, "part")
    return gates.misaligned(p, F.col("p_size"), F.col("p_size") - F.col("p_partkey") % 2).select("p_partkey")


@query("vg08_checked_simplex", "WITH m AS (SELECT o_orderpriority AS mix_id, o_orderstatus AS domain, round(count(*) / sum(count(*)) OVER (PARTITION BY o_orderpriority), 3) AS w FROM orders GROUP BY 1, 2) SELECT mix_id, domain, round(w / sum(w) OVER (PARTITION BY mix_id), 10) AS weight FROM m")
def checked_simplex(spark, d):
    from pyspark.sql import Window as W

    n = t(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("mix_id"), F.col("o_orderstatus").alias("domain")).agg(F.count("*").alias("n"))
    m = n.withColumn("weight", F.round(F.col("n") / F.sum("n").over(W.partitionBy("mix_id")), 3)).drop("n")
    return mixture.check_simplex(m).withColumn("weight", F.round("weight", 10))


@query("vg10_macro_mismatches", "WITH m AS (SELECT user_id AS step, avg(value) AS mean FROM events GROUP BY 1) SELECT step FROM m WHERE step % 4 = 0")
def macro_mismatches(spark, d):
    labels = t(spark, d, "events").select(F.col("user_id").alias("step"), "value")
    macro = labels.groupBy("step").agg((F.avg("value") + F.when(F.col("step") % 4 == 0, 0.01).otherwise(0.0)).alias("macro"))
    return gates.macro_matches(macro, labels, "step").select("step")


@query("st07_first_mismatch", "SELECT source, min(doc_id) AS first_bad, count(*) AS n_bad FROM documents WHERE n_chars <> length(text) OR doc_id % 9 = 0 GROUP BY 1")
def first_mismatch(spark, d):
    bad = (F.col("n_chars") != F.length("text")) | (F.col("doc_id") % 9 == 0)
    return gates.first_mismatch(t(spark, d, "documents"), "source", "doc_id", bad)


@query("vg12_bound_tables", "SELECT 'version' AS name, 'differs' AS kind")
def bound_tables(spark, d):
    """A reference table's markers against the run that wants to use it."""
    n = t(spark, d, "nation").count()
    markers = spark.createDataFrame([("rows", str(n)), ("version", "1"), ("tokenizer", "x")], "name string, value string")
    return rows.pinned(markers, {"rows": str(n), "version": "2", "tokenizer": "x"})


@query("hx05_below_prefixes", "SELECT path FROM (SELECT source || '/' || lang || '/' || doc_id AS path FROM documents) WHERE path LIKE 'src1/%' OR path LIKE 'src2/en/%' OR path = 'src3/fr/7'")
def below_prefixes(spark, d):
    docs = t(spark, d, "documents").select(F.concat_ws("/", "source", "lang", "doc_id").alias("path"))
    return relational.prefix_match(docs, "path", ["src1", "src2/en", "src3/fr/7"])


# --- streams ----------------------------------------------------------------------------------------------------------
@query("ss02_idempotent_log", "SELECT o_custkey AS step, count(*) AS n FROM orders GROUP BY 1")
def idempotent_log(spark, d):
    """The same records appended twice, and new ones: every step is there once."""
    path = scratch(spark, "updates")
    u = t(spark, d, "orders").groupBy(F.col("o_custkey").alias("step")).agg(F.count("*").alias("n"))
    for batch in (u.where("step % 2 = 0"), u.where("step % 2 = 0"), u):
        logs.append_new_steps(spark, batch, path, ["step"])
    return logs.read_steps(spark, path, "step long, n long")


@query("ss06_running_average", """WITH r AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn, count(*) OVER (PARTITION BY user_id) AS n FROM events)
SELECT CAST(user_id AS VARCHAR) AS key, round(sum(value * CASE WHEN rn = 1 THEN pow(0.9::DOUBLE, n - 1) ELSE 0.1 * pow(0.9::DOUBLE, n - rn) END), 6) AS ema, CAST(max(n) AS BIGINT) AS n FROM r GROUP BY user_id""")
def running_average(spark, d):
    """Streaming state over the events; the last state of each key."""
    got = averaged_events(spark, d, 0.9, True)
    last = got.groupBy("key").agg(F.max_by(F.struct("average", "n"), "n").alias("r"))
    return last.select("key", F.round("r.average", 6).alias("ema"), "r.n")


def averaged_events(spark: SparkSession, d: str, keep: float, seeded: bool) -> DataFrame:
    """The events as a stream in three runs, each of which goes on from the state that the one before left."""
    base = scratch(spark, "averages")
    e = t(spark, d, "events").select("event_id", "user_id", "value")
    cuts = e.agg(F.percentile_approx("event_id", [0.3, 0.8])).first()[0] or [0, 0]
    part = F.when(F.col("event_id") <= cuts[0], 0).when(F.col("event_id") <= cuts[1], 1).otherwise(2)
    for i in range(3):
        e.where(part == i).write.mode("append").parquet(f"{base}/in")
        stream = averages.running_averages(spark.readStream.schema(e.schema).parquet(f"{base}/in"), "user_id", "value", "event_id", keep, seeded)
        stream.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/offsets").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{base}/out")


@query("ss06_previous_baseline", """SELECT event_id, round(value - lag(value) OVER (PARTITION BY user_id ORDER BY event_id), 6) AS excess FROM events QUALIFY excess IS NOT NULL""")
def previous_baseline(spark, d):
    """What each event is above the one before it: the baseline is replaced, not blended."""
    got = averaged_events(spark, d, 0.0, False).where("baseline is not null")
    return got.select("event_id", F.round(F.col("average") - F.col("baseline"), 6).alias("excess"))


__all__ = ["QUERIES", "SQL"]
