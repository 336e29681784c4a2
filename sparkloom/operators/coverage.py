"""Benchmark coverage of a contamination scan: what an index holds by label, what was found by domain, benchmark and
field, and the checks before and after a scan."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.functions.text import SHORTEST, WIDTH, normalize
from sparkloom.staging import with_each

from .gates import duplicate_keys, missing, require

#: The two text fields of an item, and the ending of a label.
FIELDS = ("stem", "gold")
LABEL_END = "_rc_5shot_bpb"
#: Texts that a normaliser must treat alike everywhere, and the digest of what it makes of them.
PROBES = ("The ﬁrst, Ⅳ café—naïve!", "a\tb\n\n c", "", "Größe 10 % x_y ½")
FINGERPRINT = hashlib.sha256("\x1f".join(("the first iv café naïve", "a b c", "", "größe 10 x_y 1 2")).encode()).hexdigest()


def benchmark_of(label: Column) -> Column:
    """A label's benchmark: mmlu for all of its parts, else the label without its ending and last part."""
    whole = F.regexp_replace(label, f"{LABEL_END}$", "")
    return F.when(label.startswith("mmlu_"), "mmlu").otherwise(F.regexp_replace(whole, "_[^_]*$", ""))


def longest_prefix(label: Column, names: list[str]) -> Column:
    """The longest of names that a label starts with; null if none fits."""
    return F.get(F.filter(F.array(*[F.lit(n) for n in sorted(names, key=len, reverse=True)]), lambda n: F.startswith(label, n)), F.lit(0))


def n_keys(n: Column) -> Column:
    """Index keys of a field of n words."""
    return F.when(n < SHORTEST, 0).when(n < WIDTH, 1).otherwise(n - (WIDTH - 1)).cast("long")


def label_statistics(items: DataFrame, label: str = "label") -> DataFrame:
    """items (label, stem_words, gold_words) -> items, fields that can't be assessed, keys, and items of few keys."""
    keys = {f: n_keys(F.coalesce(F.col(f"{f}_words"), F.lit(0))) for f in FIELDS}
    counts = [F.count_if(keys[f] == 0).alias(f"{f}_not_assessable") for f in FIELDS] + [F.sum(keys[f]).alias(f"{f}_keys") for f in FIELDS]
    return items.groupBy(label).agg(F.count("*").alias("n_items"), *counts, F.count_if(keys["stem"] + keys["gold"] < 3).alias("items_with_lt3_keys"))


def merged_sentinels(sentinels: DataFrame, domains: DataFrame) -> DataFrame:
    """Sums of a scan's shards by domain. A domain without a shard, a canary that failed and controls that weren't all
    found raise: what is counted after that would be too low."""
    require(missing(domains, sentinels, "domain"), "domains without a finished shard")
    require(sentinels.where("not canary_ok or canary_ok is null or spikes_recovered <> spikes_injected").select("domain", "shard"), "shards that failed their checks")
    sums = [F.sum(c).alias(c) for c in ("docs_scanned", "words_scanned", "hit_rows", "spikes_injected", "spikes_recovered")]
    return sentinels.join(domains, "domain", "left_semi").groupBy("domain").agg(F.count("*").alias("n_shards"), *sums, F.bool_and("canary_ok").alias("canary_ok"))


def found_by_benchmark(hits: DataFrame, items: DataFrame, domains: DataFrame) -> DataFrame:
    """hits (domain, item_id, field), items (item_id, bench, field, assessable), domains (domain) -> distinct items
    found, assessable items and the rate, for every domain, benchmark and field; no rate where nothing is assessable.
    The grid of domains and benchmarks is small, items are only counted."""
    base = items.groupBy("bench", "field").agg(F.count_if("assessable").alias("assessable"))
    known = items.select("item_id", "bench", "field")
    found = hits.join(known, ["item_id", "field"]).groupBy("domain", "bench", "field").agg(F.countDistinct("item_id").alias("found"))
    grid = with_each(domains.select("domain").distinct(), base).join(found, ["domain", "bench", "field"], "left")
    grid = grid.withColumn("found", F.coalesce("found", F.lit(0)))
    return grid.withColumn("rate", F.try_divide("found", "assessable")).select("domain", "bench", "field", "found", "assessable", "rate")


def macro_rates(rates: DataFrame) -> DataFrame:
    """Mean rate over benchmarks by domain and field; benchmarks without a rate don't count."""
    return rates.groupBy("domain", "field").agg(F.avg("rate").alias("macro_rate"))


def spread(df: DataFrame, rate: str) -> DataFrame:
    """Largest over smallest positive rate; no row unless there are two."""
    up = df.where(F.col(rate) > 0)
    return up.agg(F.count("*").alias("n"), (F.max(rate) / F.min(rate)).alias("spread")).where("n > 1")


def item_flags(items: DataFrame) -> DataFrame:
    """items (item_id, label, stem_words, gold_words) -> one row a field: bench, field, assessable. Repeated ids raise."""
    require(duplicate_keys(items, "item_id"), "items that come twice")
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), (F.coalesce(F.col(f"{f}_words"), F.lit(0)) >= SHORTEST).alias("assessable")) for f in FIELDS])).alias("f")
    return items.select("item_id", benchmark_of(F.col("label")).alias("bench"), each).select("item_id", "bench", "f.field", "f.assessable")


def require_text(items: DataFrame, item: str, *fields: str) -> DataFrame:
    """items, if every row has text in every field; rows of hashes alone can't be indexed and raise."""
    lacks = F.concat_ws("/", *[F.when(F.col(f).isNull(), f) for f in fields])
    require(items.select(item, lacks.alias("lacks")).where("lacks <> ''"), "items without text")
    return items


def normaliser_fingerprint(spark: SparkSession) -> str:
    """Digest of what normalize makes of PROBES."""
    df = spark.createDataFrame(list(enumerate(PROBES)), "ord int, s string").select("ord", normalize(F.col("s")).alias("n"))
    return hashlib.sha256("\x1f".join(r.n for r in df.orderBy("ord").collect()).encode()).hexdigest()


def require_normaliser(spark: SparkSession) -> None:
    """Raises before a scan if texts would be normalised in another way than the index's were."""
    found = normaliser_fingerprint(spark)
    if found != FINGERPRINT:
        raise ValueError(f"the normaliser's fingerprint is {found}, not {FINGERPRINT}")


def exposure_and_change(weights: DataFrame, found: DataFrame, words: DataFrame, change: DataFrame) -> DataFrame:
    """weights (domain, weight), found (domain, bench, found), words (domain, words), change (bench, change) -> one row a
    benchmark: density of found items under the weights, beside the change."""
    rate = found.groupBy("domain", "bench").agg(F.sum("found").alias("found")).join(words, "domain").join(weights, "domain")
    density = rate.groupBy("bench").agg(F.sum(F.col("weight") * F.col("found") / F.col("words")).alias("density"))
    return density.join(change, "bench")
