"""License scan by exact set-similarity join; DataFrame functions only.

A template is a set of words, and a text block is a window of words: windows are twice as wide as a template is long,
rounded up to a power of two, and begin every half width, so every run of words as long as the template lies whole in
one of them. A block holds a template if it has a share of CONTAINED or more of its words.

The words of the templates are put in one global order, the rarest in the whole table first. A block that holds a
template of n words, t of them needed, has one of the template's n - t + 1 rarest words (prefix filter), so only windows
around such words are looked at. Such a block becomes the ordered set of its template words. It needs t of them (length
filter), and it meets a template only by words in both prefixes; a meeting at place i of the template and j of the block
leaves min(n - i, size - j) common words at most (positional filter). The pairs that are left are verified whole. The
first common word alone reports a pair, so a pair is found once. Everything up to here is narrow: texts are not shuffled.

Phrases (base labels) are found apart, by their words in a row.

Defined results: a null text counts as empty; words are compared with A-Z in lower case; overlapping blocks that hold a
template are listed each; rows equal in id and text have equal results, each its own row; a text without words has score
0 and empty labels; an empty table gives no rows.
"""

from __future__ import annotations

from fractions import Fraction
from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, n_matches

#: Characters that are in words and in none, and in none once A-Z are in lower case.
IN_WORD = r"0-9A-Za-z\x{80}-\x{10FFFF}"
NO_WORD, NO_LOWER_WORD = r"\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F", r"\x00-\x2F\x3A-\x60\x7B-\x7F"
#: Phrases and their labels.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
#: The notices that licenses ask to be put on works, and their labels.
TEMPLATES = (
    ("mit", "released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction"),
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("apache", "you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
)
CONTAINED = 0.85
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(text: str) -> list[str]:
    """Words of a template, in lower case."""
    return "".join(c if c.isalnum() else " " for c in text.lower()).split()


def needed(n: int, contained: float) -> int:
    return max(1, ceil(Fraction(str(contained)) * n))


def stride(template: str) -> int:
    """Half the width of the blocks that a template is looked for in."""
    return 1 << (len(words_of(template)) - 1).bit_length()


def _words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"[{IN_WORD}]+"), 0)


def _lower(word: Column) -> Column:
    return F.translate(word, UPPER, LOWER)


def _any_of(words: list[str]) -> str:
    """Java regular expression of a text that has one of words."""
    return f"(?i)(?<![{IN_WORD}])(?:{'|'.join(sorted(words))})(?![{IN_WORD}])"


def _phrase(phrase: str) -> str:
    return f"[{NO_WORD}]+".join(f"(?i:{w})" for w in phrase.split())


def frequencies(texts: DataFrame, words: list[str], text: str) -> dict[str, int]:
    """How often each of words (lower case) is in the texts: aggregated before the shuffle, one row a word."""
    listed = texts.select(F.explode(_words(F.col(text))).alias("w")).where(F.lower("w").isin(words))
    return {r.w: r.n for r in listed.groupBy(_lower(F.col("w")).alias("w")).agg(F.count("*").alias("n")).where(F.col("w").isin(words)).collect()}


def blocks(docs: DataFrame, key: str, text: str, templates=TEMPLATES, contained: float = CONTAINED) -> DataFrame:
    """(key, template, label, start, containment) of every block that holds a template; start: the block's first word.
    Rows are listed as often as their key."""
    spark = docs.sparkSession
    sets = [list(dict.fromkeys(words_of(t))) for _, t in templates]
    often = frequencies(docs, sorted({w for s in sets for w in s}), text)
    order = sorted({w for s in sets for w in s}, key=lambda w: (often.get(w, 0), w))
    place = {w: i for i, w in enumerate(order)}
    sets = [sorted(s, key=place.get) for s in sets]
    need = [needed(len(s), contained) for s in sets]
    widths = [stride(t) for _, t in templates]
    prefix = [(widths[k], w, i, k, s, need[k], templates[k][0]) for k, s in enumerate(sets) for i, w in enumerate(s[: len(s) - need[k] + 1])]
    anchors = {w: sorted({p[0] for p in prefix if p[1] == w}) for w in {p[1] for p in prefix}}

    some = docs.where(F.col(text).rlike(_any_of(list(anchors)))).select(F.col(key).alias("_key"), _words(F.col(text)).alias("_all"))
    # words pass through a generator, beyond which the optimiser can't copy the expression that makes them into others
    some = some.select("_key", F.explode(F.array("_all")).alias("_w"))
    at = F.filter(F.transform("_w", lambda w, i: F.struct(i.alias("i"), _lower(w).alias("w"))), lambda x: x.w.isin(list(anchors)))
    scales = F.create_map(*[x for w, s in anchors.items() for x in (F.lit(w), F.lit(s))])
    near = lambda x: F.transform(F.element_at(scales, x.w), lambda s: F.array(F.struct(s.alias("s"), F.floor(x.i / s).alias("b")), F.struct(s.alias("s"), (F.floor(x.i / s) - 1).alias("b"))))
    around = F.array_distinct(F.flatten(F.flatten(F.transform(at, near))))
    one = some.select("_key", "_w", F.explode(around).alias("_b")).where("_b.b >= 0")
    start = F.col("_b.b") * F.col("_b.s")
    window = F.slice("_w", (start + 1).cast("int"), F.col("_b.s") * 2)
    # in the order of the first: the block's template words, the rarest first
    held = F.array_intersect(F.lit(order), F.transform(window, _lower))
    one = one.select("_key", F.col("_b.s").alias("_s"), start.alias("start"), F.explode(F.array(held)).alias("_set")).withColumn("_size", F.size("_set"))
    met = one.select("_key", "_s", "start", "_set", "_size", F.posexplode("_set").alias("_j", "_word"))
    names = ("_ts", "_tw", "_i", "template", "_t", "_need", "label")
    entries = F.array(*[F.struct(*[F.lit(x).alias(n) for n, x in zip(names, p)]) for p in prefix])
    index = spark.range(1).select(F.inline(entries))  # a row a prefix word of a template
    fits = (F.col("_size") >= F.col("_need")) & (F.col("_j") <= F.col("_size") - F.col("_need"))
    fits &= F.least(F.size("_t") - F.col("_i"), F.col("_size") - F.col("_j")) >= F.col("_need")
    pairs = met.join(F.broadcast(index), (F.col("_s") == F.col("_ts")) & (F.col("_word") == F.col("_tw"))).where(fits)
    pairs = pairs.withColumn("_common", F.array_intersect("_t", "_set"))
    found = pairs.where((F.size("_common") >= F.col("_need")) & (F.col("_common")[0] == F.col("_word")))
    return found.select(F.col("_key").alias(key), "template", "label", "start", (F.size("_common") / F.size("_t")).alias("containment"))


def base(text: Column) -> dict[str, Column]:
    """Columns of a whole text: n_words, n_base (places of phrases), first_word and last_word (their least and largest
    start, in words), base (the labels, an array)."""
    n = lambda t: n_matches(t, f"[{IN_WORD}]++", f"[{NO_WORD}]")
    whole = lambda phrases: f"(?<![{IN_WORD}])(?:{'|'.join(map(_phrase, phrases))})(?![{IN_WORD}])"
    places = whole(p for p, _ in PHRASES)
    last_words = "|".join(sorted({p.split()[-1] for p, _ in PHRASES}))
    may = text.rlike(f"(?i){last_words}")  # most texts end here
    # phrases have no words in common, so what comes before the first and the last place is all that has to be counted
    before = lambda how: F.when(may & text.rlike(places), n(F.regexp_extract(text, f"^((?s:.){how}){places}", 1)))
    labels = F.filter(F.array(*[F.when(text.rlike(whole([p])), label) for p, label in PHRASES]), lambda x: x.isNotNull())
    return {
        "n_words": n(text), "n_base": F.when(may, F.regexp_count(text, F.lit(places))).otherwise(0).cast("long"), "first_word": before("*?"), "last_word": before("*"),
        "base": F.when(may, labels).otherwise(F.array().cast("array<string>")),
    }


def scan(docs: DataFrame, templates=TEMPLATES, contained: float = CONTAINED, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score of every document. labels: those of
    phrases and of templates that a block holds; score: 1 if there is a phrase, else the largest containment found."""
    own = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("_text"))
    own = own.withColumn("_key", F.sha2(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), "_text"), 256))
    found = blocks(own, "_key", "_text", templates, contained)
    found = found.groupBy(F.col("_key").alias("_k")).agg(F.collect_set("label").alias("_labels"), F.max("containment").alias("_score"))  # a label a template at most
    each = checkpoint(own.select("doc_id", "_key", *[c.alias(n) for n, c in base(F.col("_text")).items()]))
    joined = each.join(found, F.col("_key") == F.col("_k"), "left")
    both = F.array_union("base", F.coalesce("_labels", F.array().cast("array<string>")))
    written = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    score = F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("_score", F.lit(0.0)))
    return joined.select("doc_id", "n_words", "n_base", "first_word", "last_word", written(F.col("base")).alias("base_labels"), written(both).alias("labels"), score.alias("score"))


def _oracle() -> str:
    sets = [sorted(set(words_of(t))) for _, t in TEMPLATES]
    rows = ", ".join(f"({stride(t)}, '{label}', {s!r}, {needed(len(s), CONTAINED)})" for (label, t), s in zip(TEMPLATES, sets))
    vocabulary = sorted({w for s in sets for w in s})
    places = " UNION ALL ".join(
        f"SELECT r, i - 1 AS i, '{label}' AS label FROM e WHERE w[i:i + {len(p.split()) - 1}] = {p.split()!r}" for p, label in PHRASES
    )
    return rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^{NO_LOWER_WORD}]+') AS w FROM documents),
e AS (SELECT r, w, unnest(range(1, len(w) + 1)) AS i FROM d),
p AS ({places}),
b AS (SELECT r, count(*) AS n, min(i) AS lo, max(i) AS hi, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM p GROUP BY r),
t AS (SELECT * FROM (VALUES {rows}) AS t(s, label, t, need)),
x AS (SELECT d.r, s, unnest(range(0, CAST(len(w) AS BIGINT), CAST(s AS BIGINT))) AS i, w FROM d, (SELECT DISTINCT s FROM t)),
y AS (SELECT r, s, list_intersect(w[i + 1:i + 2 * s], {vocabulary!r}) AS w FROM x),
m AS (SELECT r, label, max(len(list_intersect(y.w, t.t)) / len(t.t)) AS c FROM y JOIN t ON t.s = y.s AND len(y.w) >= need AND len(list_intersect(y.w, t.t)) >= need GROUP BY r, label),
a AS (SELECT r, label, c FROM m UNION ALL SELECT r, label, 1.0 FROM p),
l AS (SELECT r, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(c) AS c FROM a GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n, 0) AS n_base, lo AS first_word, hi AS last_word, coalesce(b.labels, '') AS base_labels,
       coalesce(l.labels, '') AS labels, CASE WHEN n > 0 THEN 1.0 ELSE coalesce(CAST(c AS DOUBLE), 0.0) END AS score
FROM d LEFT JOIN b ON d.r = b.r LEFT JOIN l ON d.r = l.r
"""


ORACLE = _oracle()
