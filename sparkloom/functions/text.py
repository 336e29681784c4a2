"""Text functions as column expressions: normalising, words, n-grams, prefixes, digests, names."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType


@F.pandas_udf(StringType())
def nfkc(s):
    """NFKC form; the only step that Spark has no function for."""
    return s.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def normalize(text: Column, compatibility: bool = True) -> Column:
    """NFKC, lower case, punctuation to spaces, white space collapsed. Texts of ASCII alone, which NFKC leaves as they
    are, are not sent to Python; without compatibility none is, and forms stay as they are."""
    t = F.coalesce(nfkc(F.when(text.rlike(r"[^\x00-\x7F]"), text)), text) if compatibility else text
    t = F.regexp_replace(F.lower(t), r"(?U)[^\w\s]", " ")
    return F.trim(F.regexp_replace(t, r"(?U)\s+", " "))


def words(normal: Column) -> Column:
    """Words of a normalised text; an empty array for empty or null."""
    return F.when(F.coalesce(F.length(normal), F.lit(0)) == 0, F.array().cast("array<string>")).otherwise(F.split(normal, " "))


def ngrams(w: Column, n: int) -> Column:
    """All runs of n words, joined by spaces."""
    return F.when(F.size(w) >= n, F.transform(F.sequence(F.lit(1), F.size(w) - n + 1), lambda i: F.array_join(F.slice(w, i, n), " "))).otherwise(F.array().cast("array<string>"))


#: A field under 8 words can't be assessed, one of 8 to 12 words is a single key, a longer one has all its 13-grams.
SHORTEST, WIDTH = 8, 13


def keys_for_field(w: Column) -> Column:
    return F.when(F.size(w) < SHORTEST, F.array().cast("array<string>")).when(F.size(w) < WIDTH, F.array(F.array_join(w, " "))).otherwise(ngrams(w, WIDTH))


def length_class(w: Column) -> Column:
    return F.when(F.size(w) < SHORTEST, "not_assessable").when(F.size(w) < WIDTH, "short").otherwise("full")


MERSENNE = (1 << 61) - 1


def word_hash(word: str) -> int:
    """A word's hash below 2^61 - 1."""
    import hashlib

    return int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little") % MERSENNE


@F.pandas_udf(ArrayType(LongType()))
def rolling_hashes(texts, width, base):
    """Hashes of every run of `width` words: a polynomial in base over the words' hashes, carried from run to run. For
    engines that look a run up by number; the scan itself joins on Spark's hashes."""
    def one(text, n, b):
        out, known, h = [], {}, 0
        words = [known.setdefault(w, word_hash(w)) if w not in known else known[w] for w in (text or "").split()]
        top = pow(b, n - 1, MERSENNE)
        for i, x in enumerate(words):
            if i >= n:
                h = (h - words[i - n] * top) % MERSENNE
            h = (h * b + x) % MERSENNE
            if i >= n - 1:
                out.append(h)
        return out

    return texts.combine(width, lambda t, n: (t, int(n))).combine(base, lambda tn, b: one(*tn, int(b)))


def shared_word_prefix(a: Column, b: Column) -> Column:
    """Number of leading words that two word arrays share."""
    p = F.array_position(F.zip_with(a, b, lambda x, y: x != y), True)
    return F.when(p > 0, p - 1).otherwise(F.least(F.size(a), F.size(b))).cast("long")


def common_prefix(low: Column, high: Column) -> Column:
    """Longest common prefix of the smallest and largest of a set of strings, and so of the whole set."""
    n = F.least(F.length(low), F.length(high))
    same = F.filter(F.sequence(F.lit(0), n), lambda i: F.substring(low, 1, i) == F.substring(high, 1, i))
    return F.substring(low, 1, F.array_max(same))


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def shard_name(index: Column, *parts: Column, key: Column) -> Column:
    """Zero-padded index, parts of up to 60 characters and ten digits of the key's SHA-1."""
    tail = [F.substring(p, 1, 60) for p in parts] + [F.substring(F.sha1(key), 1, 10)]
    return F.concat_ws("__", F.format_string("%05d", index), *tail)


def domain_of_path(path: Column, allowed: list[str]) -> Column:
    part = F.get(F.split(path, "/"), F.lit(1))
    return F.when(part.isin(allowed), part)


def first_text(*fields: Column) -> Column:
    """The first field that isn't empty."""
    return F.coalesce(*[F.when(F.trim(f) != "", f) for f in fields])


def skipped_rows(s: Column) -> Column:
    """'3:blank,9:badjson' -> map from row to reason."""
    return F.when(F.coalesce(s, F.lit("")) == "", F.expr("cast(map() as map<string,string>)")).otherwise(F.str_to_map(s, F.lit(","), F.lit(":")))


def key_digest(ids: Column) -> Column:
    """Aggregate: SHA-256 of all ids in order, whatever the order of rows."""
    return F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(ids)), lambda x: x.cast("string")), ","), 256)


def p_value_text(p: Column, n: Column) -> Column:
    """A p-value for a table: a floor of one draw, a dash for none."""
    return F.when(p.isNull() | F.isnan(p), "-").when(p <= 1 / n, F.concat(F.lit("<"), F.format_string("%.1e", 1 / n))).otherwise(F.format_string("%.4f", p))


def finite(x: Column, digits: int) -> Column:
    """Rounded half to even; null for anything that isn't a finite number."""
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), None).otherwise(F.bround(x, digits))
