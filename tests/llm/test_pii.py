import hashlib
import random
import re

from sparkloom.llm import pii
from sparkloom.llm.queries import op6_pii

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    total = 0
    for i, c in enumerate(reversed(d)):
        x = int(c) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def plain(text):
    out = []
    for kind, p in PATTERNS.items():
        for m in re.finditer(p, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            ok = kind == "email"
            ok |= kind == "ip" and all(int(x) <= 255 for x in m[0].split("."))
            ok |= kind == "card" and 14 <= len(digits) <= 19 and luhn(digits)
            ok |= kind == "phone" and 10 <= len(digits) <= 15
            if ok:
                out.append((kind, m.start(), m.end()))
    return sorted(out, key=lambda s: (s[1], list(PATTERNS).index(s[0])))


def test_base_spans_equal_the_patterns():
    rng = random.Random(11)
    parts = ["1", "23", "4", ".", ".", "-", " ", "+", "@", "a", "b.c", "%", "(", ")", "4111 1111 1111 1111", "é", "🎉", "x@y.z", "@@", "255", "256", "0001.2.3.4", "+1 (555) 010-9999"]
    for _ in range(6000):
        t = "".join(rng.choice(parts) for _ in range(rng.randint(0, 14)))
        assert [s for s in pii.find(t) if s[0] in PATTERNS] == plain(t), t


def test_added_kinds():
    t = 'token = "254ca002228af484f240146ffd26ba4415598ee8" see ftp://bob:pw@host/ IBAN: DE89 3704 0044 0532 0130 00 and account no. 12345678'
    found = {t[a:b] for k, a, b in pii.find(t) if k not in PATTERNS}
    assert {"254ca002228af484f240146ffd26ba4415598ee8", "bob:pw", "DE89 3704 0044 0532 0130 00", "12345678"} <= found
    assert pii.find("A token of thanks, the account of events, a key note and the iban system.") == []
    assert pii.redact(t, pii.find(t)).startswith('token = "[SECRET]" see ftp://[CRED]@host/ IBAN: [IBAN]')


def test_cues_in_any_case_and_numbers_that_are_none():
    value = "254ca002228af484f240146ffd26ba44"
    for cue in ("apiKey", "API_Key", "Api-Key", "aCCess_Key", "TOKEN", "passWord"):
        t = f"é İ {cue} = '{value}'"
        assert [t[a:b] for k, a, b in pii.find(t) if k == "secret"] == [value], cue
    for cue in ("ACCOUNT no. ", "Acct: ", "a/C ", "paSSport number "):
        t = f"İİ {cue}12345678."
        assert [t[a:b] for k, a, b in pii.find(t)] == ["12345678"], cue
    t = "ssn 123-45-6789, SSN: 000-12-3456, ssn 12345678, lessness 123456789, account 0000000, account 123456abc, xiban DE89370400440532013000"
    assert [t[a:b] for k, a, b in pii.find(t)] == ["123-45-6789"]


def test_odd_rows(spark, odd_docs, no_docs):
    rows = pii.digests(odd_docs).collect()
    assert len(rows) == 10
    seven = next(r for r in rows if r.doc_id == 7)
    assert (seven.n_email, seven.n_phone) == (1, 1)
    clean = pii.redacted(odd_docs)
    assert clean.columns == odd_docs.columns
    kept = {r.doc_id: r for r in clean.collect()}
    assert "[EMAIL]" in kept[7].text and kept[7].n_chars == len(kept[7].text) and kept[3].text is None and kept[1].n_chars == 10
    assert pii.digests(no_docs).collect() == [] and pii.redacted(no_docs).collect() == []


def test_query(spark, sf_dir):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = op6_pii(spark, sf_dir).collect()
    assert len(rows) == len(texts)
    for r in rows:
        base = plain(texts[r.doc_id])
        text = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        assert r.base_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert r.n_spans == len(list(filter(None, r.spans.split(","))))
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[0] == k for s in base) for k in PATTERNS]
        assert set(filter(None, text.split(","))) <= set(r.spans.split(","))
