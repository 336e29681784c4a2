"""Benchmark passages in a corpus: item index, scan, rates, totals, exposure.

The index is a long table of n-grams. The scan lists every position of a text with the hash of its next 8 words, meets
them with the index, or with its prefixes alone where it is larger (sent to the executors only within a counted bound),
and checks what passes against the words exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkloom.functions.text import SHORTEST, WIDTH, keys_for_field, length_class, normalize, words
from sparkloom.operators.running import ranked
from sparkloom.staging import checkpoint

#: Largest index, in rows of about 200 bytes, that is sent to every executor; a larger one is joined by shuffle.
BROADCAST_ROWS = 1_000_000
#: Most prefixes, in rows of about 30 bytes, that are sent to every executor.
BROADCAST_PREFIXES = 8_000_000
#: Positions that share a list of words: each row of a position holds its list until the prefixes are met.
CHUNK = 64


def _worded(df: DataFrame, text: str, compatibility: bool, *more: Column) -> DataFrame:
    """more columns, and the words of each text in _w. The words pass through a generator, beyond which the optimiser
    can't copy the expression that makes them into others."""
    return df.select(*more, F.explode(F.array(words(normalize(F.col(text), compatibility)))).alias("_w"))


def _hashed(w: Column, at: Column) -> Column:
    """Hash of the SHORTEST words from place at, from 0. Each is taken from the list by itself: a slice copies the list."""
    return F.xxhash64(*[F.get(w, at + i) for i in range(SHORTEST)])


def item_index(items: DataFrame, item: str = "item_id", text: str = "text", compatibility: bool = True) -> DataFrame:
    """(item, ngram, width, prefix): every key of every item that can be assessed."""
    normal = _worded(items, text, compatibility, F.col(item).alias("item_id"))
    keyed = normal.select("item_id", F.explode(keys_for_field(F.col("_w"))).alias("ngram")).distinct()
    parts = F.split("ngram", " ")
    return keyed.select("item_id", "ngram", F.size(parts).alias("width"), _hashed(parts, F.lit(0)).alias("prefix"))


def index_summary(items: DataFrame, item: str = "item_id", text: str = "text", compatibility: bool = True) -> DataFrame:
    """One row: items, not assessable, keys, distinct keys and 8-word prefixes, prefixes with several widths."""
    classed = _worded(items, text, compatibility).select(length_class(F.col("_w")).alias("c"))
    counts = classed.agg(F.count("*").alias("items"), F.count_if(F.col("c") == "not_assessable").alias("not_assessable"), F.count_if(F.col("c") == "short").alias("short"))
    idx = checkpoint(item_index(items, item, text, compatibility))
    keys = idx.agg(F.count("*").alias("item_keys"), F.countDistinct("ngram").alias("exact_keys"))
    by_prefix = idx.groupBy("prefix").agg(F.countDistinct("width").alias("n"))
    prefixes = by_prefix.agg(F.count("*").alias("prefixes"), F.count_if(F.col("n") > 1).alias("multi_width_prefixes"))
    return counts.crossJoin(keys).crossJoin(prefixes)  # three single rows


def _runs(docs: DataFrame, doc: str, text: str, compatibility: bool, marks: bool, *more: str) -> DataFrame:
    """Every position of every document: pos (from 1), the hash of the next SHORTEST words, and where they are (_at, from
    0) in a list of words (_part) that goes on to WIDTH words. With marks a row at pos 0 as well, of every document, which
    alone has its number of words in n."""
    w = _worded(docs, text, compatibility, *[F.col(c) for c in more], F.col(doc).alias("_doc"))
    n, none = F.size("_w"), F.array().cast("array<int>")
    starts = F.when(n >= SHORTEST, F.sequence(F.lit(1), n - SHORTEST + 1, F.lit(CHUNK))).otherwise(none)
    chunks = F.transform(F.concat(F.array(F.lit(0)), starts) if marks else starts, lambda i: F.struct(i.alias("at"), F.when(i > 0, F.slice("_w", F.greatest(i, F.lit(1)), CHUNK + WIDTH - 1)).alias("w")))
    c = w.select(*more, "_doc", n.alias("n"), F.explode(chunks).alias("_c")).select(*more, "_doc", "n", F.col("_c.at").alias("_first"), F.col("_c.w").alias("_part"))
    last = F.least(F.lit(CHUNK), F.size("_part") - SHORTEST + 1) - 1
    placed = c.select(*more, "_doc", "n", "_first", "_part", F.explode(F.when(F.col("_first") == 0, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), last))).alias("_at"))
    mark = F.col("_first") == 0
    prefix = F.when(mark, F.xxhash64("_doc")).otherwise(_hashed(F.col("_part"), F.col("_at")))
    return placed.select(*more, "_doc", F.when(mark, F.col("n")).alias("n"), (F.col("_first") + F.col("_at")).alias("pos"), prefix.alias("_prefix"), "_part", "_at")


def _found(docs: DataFrame, items: DataFrame, doc: str, text: str, compatibility: bool, marks: bool = False, *more: str) -> DataFrame:
    """Exact keys found, with more columns of the documents, and marks if asked for. One pass over the texts; nothing but
    what passes the prefixes of the index is ever shuffled, unless there are too many of these to send. The words of a
    position are put together only once its prefix is met."""
    idx = checkpoint(item_index(items, compatibility=compatibility))
    runs = _runs(docs, doc, text, compatibility, marks, *more)
    how, mark = ("left" if marks else "inner"), F.col("pos") == 0
    span = F.array_join(F.slice("_part", F.col("_at") + 1, WIDTH), " ")
    key = lambda span: (F.col("_prefix") == F.col("prefix")) & ~mark & F.startswith(F.concat(span, F.lit(" ")), F.concat("ngram", F.lit(" ")))
    if idx.count() <= BROADCAST_ROWS:
        out = runs.join(F.broadcast(idx), key(span), how).where(F.col("ngram").isNotNull() | mark)
    else:
        prefixes = idx.select(F.col("prefix").alias("_p")).distinct()
        if prefixes.count() <= BROADCAST_PREFIXES:
            prefixes = F.broadcast(prefixes)
        near = runs.join(prefixes, F.col("_prefix") == F.col("_p"), how).where(F.col("_p").isNotNull() | mark)
        near = checkpoint(near.withColumn("span", span).drop("_part", "_at"))
        out = near.where(~mark).join(idx, key(F.col("span"))).unionByName(near.where(mark), allowMissingColumns=True)
    return out.select(*more, "_doc", "n", F.col("pos").cast("long").alias("pos"), F.col("width").cast("long").alias("width"), "item_id")


def scan(docs: DataFrame, items: DataFrame, doc: str = "doc_id", text: str = "text", compatibility: bool = True) -> DataFrame:
    """(doc, pos, width, item_id) of every exact key found; pos counts words from 1."""
    return _found(docs, items, doc, text, compatibility).select(F.col("_doc").alias(doc), "pos", "width", "item_id")


def collapse(hits: DataFrame, doc: str = "doc_id") -> DataFrame:
    """One row a document with hits: matched_words (distinct positions) and n_items."""
    spans = F.collect_set(F.sequence(F.col("pos"), F.col("pos") + F.col("width") - 1))
    return hits.groupBy(doc).agg(F.size(F.array_distinct(F.flatten(spans))).cast("long").alias("matched_words"), F.countDistinct("item_id").alias("n_items"))


def rates_by_source(docs: DataFrame, items: DataFrame, source: str = "source", doc: str = "doc_id", text: str = "text", compatibility: bool = True) -> DataFrame:
    """Documents and words scanned and matched by source, with rates rounded to ten digits. Ids tell documents apart."""
    rows = _found(docs, items, doc, text, compatibility, True, source)
    mark = F.col("pos") == 0
    spans = F.collect_set(F.when(~mark, F.sequence(F.col("pos"), F.col("pos") + F.col("width") - 1)))
    each = rows.groupBy(source, "_doc").agg(F.count_if(mark).alias("k"), F.sum("n").alias("n"), F.size(F.array_distinct(F.flatten(spans))).alias("matched"))
    out = each.groupBy(source).agg(
        F.sum("k").alias("docs_scanned"), F.sum("n").alias("words_scanned"),
        F.sum(F.when(F.col("matched") > 0, F.col("k")).otherwise(0)).alias("matched_documents"), F.sum(F.col("k") * F.col("matched")).alias("matched_span_words"),
    )
    rate = lambda a, b: F.round(F.try_divide(F.col(a), F.col(b)), 10)
    return out.withColumn("matched_document_rate", rate("matched_documents", "docs_scanned")).withColumn("matched_span_word_rate", rate("matched_span_words", "words_scanned"))


def totals(hits: DataFrame, docs: DataFrame, source: str = "source", doc: str = "doc_id") -> DataFrame:
    """Distinct items and documents by (source, item group) and over everything: unions, not sums of distincts."""
    j = hits.join(docs.select(F.col(doc).alias("_d"), source), F.col(doc) == F.col("_d"))
    j = j.select(source, doc, "item_id").distinct()
    grouped = j.groupingSets([[F.col(source)], []], F.col(source))
    return grouped.agg(F.countDistinct("item_id").alias("items_hit"), F.countDistinct(doc).alias("docs_hit"), F.grouping(source).cast("long").alias("is_total"))


def exposure(rates: DataFrame, weights: DataFrame, rate: str, on: str = "source") -> DataFrame:
    """sum(weight * rate) by mixture; a mixture with a domain that has no rate raises."""
    missing = weights.where("weight > 0").join(rates, on, "left_anti")
    if not missing.isEmpty():
        raise ValueError("a mixture has a domain without a rate")
    return weights.join(rates, on).groupBy("mix_id").agg(F.round(F.sum(F.col("weight") * F.coalesce(F.col(rate), F.lit(0.0))), 10).alias("exposure"))


def trajectory_exposure(steps: DataFrame, final_step: int, rate: Column) -> DataFrame:
    """Time-weighted mean of a rate over a run's segments; the last lasts to final_step."""
    length = F.lead("step", 1, final_step).over(W.partitionBy("run").orderBy("step")) - F.col("step")
    return steps.select("run", rate.alias("r"), length.alias("n")).groupBy("run").agg(F.round(F.sum(F.col("r") * F.col("n")) / final_step, 10).alias("exposure"))


def spikes(index: DataFrame, count: int) -> DataFrame:
    """Control items evenly strided over the sorted keys, to be scanned beside the corpus and found again."""
    n = index.select("item_id").distinct().count()
    step = max(1, n // count)
    each = ranked(index.groupBy("item_id").agg(F.min("ngram").alias("ngram")), ["item_id"], out="rn").withColumn("rn", F.col("rn") - 1)
    return each.where((F.col("rn") % step == 0) & (F.col("rn") < step * count)).select("item_id", F.col("ngram").alias("text"))


def strip_preamble(items: DataFrame, label: str = "label", item: str = "item_id", w: str = "w") -> DataFrame:
    """Words that all of a label's items begin with, cut off if they are SHORTEST or more: the prefix that the least and
    the greatest share, which all between them share too. A label of one item keeps its words, and none is left empty."""
    from sparkloom.functions.text import shared_word_prefix

    ends = items.groupBy(F.col(label).alias("_l")).agg(F.min(w).alias("_lo"), F.max(w).alias("_hi"), F.count("*").alias("_n"))
    n = F.when((F.col("_n") > 1), shared_word_prefix(F.col("_lo"), F.col("_hi"))).otherwise(0)
    d = items.join(ends.select("_l", n.alias("_cut")), F.col(label).eqNullSafe(F.col("_l")))
    cut = F.when((F.col("_cut") >= SHORTEST) & (F.col("_cut") < F.size(w)), F.col("_cut")).otherwise(0)
    return d.select(label, item, cut.cast("long").alias("stripped"), F.slice(w, cut.cast("int") + 1, F.size(w)).alias(w))


def strip_shared_prefix(items: DataFrame, label: str = "label", item: str = "item_id", w: str = "w", sharers: int = 5) -> DataFrame:
    """Words of exemplars at an item's start: the best sliding minimum, over `sharers` sorted neighbours, of adjacent
    shared prefixes. Prefixes under SHORTEST words, and those that would leave nothing, are not stripped."""
    from sparkloom.functions.text import shared_word_prefix

    by = W.partitionBy(label).orderBy(w, item)
    adj = items.withColumn("_adj", shared_word_prefix(F.col(w), F.lead(w).over(by)))
    ahead = by.rowsBetween(0, sharers - 1)
    adj = adj.withColumn("_win", F.when(F.count("_adj").over(ahead) == sharers, F.min("_adj").over(ahead)))
    best = F.coalesce(F.max("_win").over(by.rowsBetween(-sharers, 0)), F.lit(0))
    adj = adj.withColumn("_best", best)
    cut = F.when((F.col("_best") >= SHORTEST) & (F.col("_best") < F.size(w)), F.col("_best")).otherwise(0)
    return adj.select(label, item, cut.cast("long").alias("stripped"), F.array_join(F.slice(w, cut.cast("int") + 1, F.size(w)), " ").alias("stem"))


__all__ = ["WIDTH", "collapse", "exposure", "index_summary", "item_index", "rates_by_source", "scan", "spikes", "strip_preamble", "strip_shared_prefix", "totals", "trajectory_exposure"]
