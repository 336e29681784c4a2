"""Personal data by anchor expansion.

One Aho-Corasick pass over a text finds anchors: at-signs, plus signs, scheme marks, digits and identifier cue words.
Cues are met in any case of A-Z. At each anchor a local parser expands to the boundaries of an address or number and
validates it; text away from anchors is never parsed. Kinds: email, ip, card, phone (the base kinds) and, added by cues, cred (user and password in
a URL), iban (check digits verified), account (a number after an account cue, a word of its own; SSNs in their ranges) and secret (a value after a token,
key or password cue).

Defined results: a null text counts as empty; spans are in code points, end exclusive; spans of one kind never
overlap, spans of different kinds may. A base match that fails its check is dropped and not tried again from inside.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import free_name

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "cred", "iban", "account", "secret")
Span = tuple[str, int, int]

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
DIGITS = re.compile(r"[0-9]+")
DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+){3}")
CHAIN = re.compile(r"[0-9](?:[ -]?[0-9])*")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
CREDENTIALS = re.compile(r"://([^\s/?#@:]+:[^\s/?#@]+)@")
IBAN = re.compile(r"(?:[\s:#=]|number|no\.?){0,12}([A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30})", re.I)
ACCOUNT = re.compile(r"(?:[\s:#=.]|number|num|no\b){0,12}([0-9](?:[ -]?[0-9]){5,33})(?![A-Za-z0-9_])", re.I)
SSN = re.compile(r"(?!000|666|9)[0-9]{3}[ -]?(?!00)[0-9]{2}[ -]?(?!0000)[0-9]{4}")
SECRET = re.compile(r"[A-Za-z_]{0,12}[\"']?\s{0,3}[:=]\s{0,3}[\"']?([A-Za-z0-9_\-./+=]{16,})")
ACCOUNT_CUES = ("account", "acct", "a/c", "passport", "ssn")
SECRET_CUES = ("token", "secret", "password", "passwd", "api_key", "apikey", "api-key", "access_key")


def _automaton() -> ahocorasick.Automaton:
    cues = {"@": "at", "+": "plus", "://": "scheme", "iban": "iban"} | dict.fromkeys("0123456789", "digit")
    cues |= dict.fromkeys(ACCOUNT_CUES, "account") | dict.fromkeys(SECRET_CUES, "secret")
    a = ahocorasick.Automaton()
    for cue, kind in cues.items():
        a.add_word(cue, (kind, cue))
    a.make_automaton()
    return a


ANCHORS = _automaton()
_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}


def luhn(digits: str) -> bool:
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10 == 0


def iban_ok(s: str) -> bool:
    s = s.replace(" ", "").upper()
    return 15 <= len(s) <= 34 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def account_ok(cue: str, number: str) -> bool:
    """Whether a number after a cue can be one: not the same digit throughout, and, for ssn, in its ranges."""
    return len({c for c in number if c.isdigit()}) > 1 and (cue != "ssn" or SSN.fullmatch(number) is not None)


def find(text: str | None) -> list[Span]:
    """All spans of a text, by start and then kind."""
    text = text or ""
    spans: list[Span] = []
    done = dict.fromkeys(KINDS, 0)  # up to where each kind's parser has read

    def add(kind: str, start: int, end: int) -> None:
        spans.append((kind, start, end))
        done[kind] = end

    # A-Z only, so that places stay as they are
    for last, (kind, cue) in ANCHORS.iter(text.lower() if text.isascii() else text.translate(_LOWER)):
        at = last - len(cue) + 1
        if kind == "digit":
            if at >= done["card"]:
                end = CHAIN.match(text, at).end()
                done["card"] = end
                if end - at >= 14:
                    digits = "".join(filter("0123456789".__contains__, text[at:end]))
                    if 14 <= len(digits) <= 19 and luhn(digits):
                        add("card", at, end)
            if at >= done["ip"]:
                m = DOTTED.match(text, at)
                done["ip"] = m.end() if m else DIGITS.match(text, at).end()
                if m and all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split(".")):
                    add("ip", at, m.end())
        elif kind == "at":
            start = at
            while start > done["email"] and text[start - 1] in LOCAL:
                start -= 1
            if start < at and (m := DOMAIN.match(text, at + 1)):
                add("email", start, m.end())
        elif kind == "plus":
            if (m := PHONE.match(text, at)) and 10 <= sum(map("0123456789".__contains__, m[0])) <= 15:
                add("phone", at, m.end())
        elif kind == "scheme":
            if at >= done["cred"] and (m := CREDENTIALS.match(text, at)):
                add("cred", *m.span(1))
        elif kind == "iban":
            if last + 1 >= done["iban"] and (not at or not text[at - 1].isalnum()) and (m := IBAN.match(text, last + 1)):
                whole = m[1]
                for end in range(len(whole), 14, -1):  # words after the number may look like a part of it
                    if whole[end - 1] != " " and (end == len(whole) or whole[end] == " ") and iban_ok(whole[:end]):
                        add("iban", m.start(1), m.start(1) + end)
                        break
        elif kind == "account":
            if last + 1 >= done["account"] and (not at or not text[at - 1].isalnum()) and (m := ACCOUNT.match(text, last + 1)) and account_ok(cue, m[1]):
                add("account", *m.span(1))
        elif last + 1 >= done["secret"] and (m := SECRET.match(text, last + 1)) and re.search("[0-9]", m[1]):
            add("secret", *m.span(1))
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def redact(text: str | None, spans: list[Span]) -> str | None:
    """text with every span replaced by its kind in brackets; overlapping spans become one, of the first's kind."""
    if not spans:
        return text
    out, at, merged = [], 0, []
    for kind, a, b in spans:
        if merged and a < merged[-1][2]:
            merged[-1][2] = max(merged[-1][2], b)
        else:
            merged.append([kind, a, b])
    for kind, a, b in merged:
        out += [text[at:a], f"[{kind.upper()}]"]
        at = b
    return "".join([*out, text[at:]])


SPAN = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))


def _narrow(docs: DataFrame, text: str, outs: list[T.StructField], row, drop: tuple[str, ...] = ()) -> DataFrame:
    """docs without the columns in drop or named like outs, with the columns that row(text) gives."""
    names = {f.name for f in outs} | set(drop)
    kept = [f for f in docs.schema.fields if f.name not in names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.field(f.name, _arrow(f.dataType)) for f in outs]
        for batch in batches:
            rows = [row(t.as_py()) for t in batch.column(batch.schema.get_field_index(text))]
            new = [pa.array([r[i] for r in rows], f.type) for i, f in enumerate(types)]
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(f.name)) for f in kept] + new, [f.name for f in kept] + [f.name for f in types])

    return docs.mapInArrow(run, T.StructType(kept + outs))


def _arrow(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def pii_spans(docs: DataFrame, text: str = "text", out: str = "pii") -> DataFrame:
    """docs with an array of (kind, start, end) in column out. One narrow stage, no shuffle."""
    def row(t):
        return ([{"kind": k, "start": a, "end": b} for k, a, b in find(t)],)

    return _narrow(docs, text, [T.StructField(out, SPAN)], row)


def redacted(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with the text redacted in place and, where there is one, n_chars set to its code points; rows and columns
    stay as they are."""
    new = free_name(docs, "_redacted_")
    df = _narrow(docs, text, [T.StructField(new, T.StringType())], lambda t: (redact(t, find(t)),))
    from pyspark.sql import functions as F

    def value(c: str):
        if c == text:
            return F.col(new).alias(c)
        if c == "n_chars":
            changed = ~F.col(new).eqNullSafe(F.col(f"`{text}`"))
            return F.when(changed, F.length(new)).otherwise(F.col("n_chars")).cast(docs.schema[c].dataType).alias(c)
        return F.col(f"`{c}`")

    return df.select(*[value(c) for c in docs.columns])


def digests(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, counts of the base kinds and of all spans, SHA-256 of the joined base spans, all spans joined."""
    def row(t):
        spans = find(t)
        base = [s for s in spans if s[0] in BASE_KINDS]
        counts = [sum(s[0] == k for s in base) for k in BASE_KINDS]
        return (*counts, len(spans), hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans))

    outs = [T.StructField(f"n_{k}", T.LongType()) for k in (*BASE_KINDS, "spans")] + [T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType())]
    from pyspark.sql import functions as F

    return _narrow(docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("_text")), "_text", outs, row, ("_text",))
