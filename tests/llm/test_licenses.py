import re

import duckdb
import pytest

from sparkloom.llm import licenses
from sparkloom.llm.queries import op11_license_scan

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def brute(text, contained=licenses.CONTAINED):
    w = words(text)
    at = [(i, label) for p, label in licenses.PHRASES for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
    held = []
    for k, (label, t) in enumerate(licenses.TEMPLATES):
        want, s = set(licenses.words_of(t)), licenses.stride(t)
        for i in range(0, len(w), s):
            n = len(want & set(w[i : i + 2 * s]))
            if n >= contained * len(want) - 1e-9:
                held.append((k, label, i, n / len(want)))
    base = sorted({label for _, label in at})
    starts = [i for i, _ in at]
    row = (len(w), len(at), min(starts, default=None), max(starts, default=None), ",".join(base), ",".join(sorted({*base, *(h[1] for h in held)})), 1.0 if at else max((h[3] for h in held), default=0.0))
    return row, held


TEXTS = [
    None, "", " ,.; ", "MIT License", "mit-license, MIT\nLICENSE! Apache (License) xmit license mit licensed", "General public license and GNU general  public\tlicense.",
    "mit license " * 3 + "apache license", "Licensed under CC BY-NC 4.0.", "licensed under cc by nc 4 1", "released under license", "ﬁx mitK license MIT Lıcense MIT lIcEnSe éMIT License",
    *[t for _, t in licenses.TEMPLATES], *[" ".join(["filler"] * n + [licenses.TEMPLATES[1][1]] + ["more"] * 9) for n in range(20, 36)],
    " ".join(w for i, w in enumerate(licenses.TEMPLATES[5][1].split()) if i not in (3, 12)), " ".join(w for i, w in enumerate(licenses.TEMPLATES[5][1].split()) if i % 3),
    "Permission is hereby granted, \n\n * free of charge, to any\n * person obtaining a copy\n * of this software and associated documentation files (the Software), to deal in it",
    "the of to a in software license under free " * 400 + "Apache License", "x" * 200_000 + " mit license",
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")


def test_scan_equals_brute_force(docs):
    got = {r[0]: tuple(r)[1:] for r in licenses.scan(docs).collect()}
    assert got == {i: brute(t)[0] for i, t in enumerate(TEXTS)}


@pytest.mark.parametrize("contained", [0.5, 0.85, 1.0])
def test_every_block_is_found_once(docs, contained):
    got = sorted((r.doc_id, r.template, r.label, r.start, r.containment) for r in licenses.blocks(docs.na.fill("", ["text"]), "doc_id", "text", contained=contained).collect())
    assert got == sorted((i, *h) for i, t in enumerate(TEXTS) for h in brute(t, contained)[1])


def test_very_long_text(spark):
    text = "plain words of the text " * 200_000 + licenses.TEMPLATES[4][1] + " and more" * 1000
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert tuple(licenses.scan(docs).first())[1:] == brute(text)[0]


def test_odd_rows(odd_docs, no_docs):
    got = sorted(map(tuple, licenses.scan(odd_docs).collect()), key=str)
    assert got == sorted(((r.doc_id, *brute(r.text)[0]) for r in odd_docs.collect()), key=str)
    assert licenses.scan(no_docs).collect() == []


def test_no_python_in_the_plan(docs):
    plan = licenses.scan(docs)._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def test_sql(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf_dir}/documents.parquet'")
    assert sorted(map(str, map(tuple, op11_license_scan(spark, sf_dir).collect()))) == sorted(map(str, con.execute(licenses.ORACLE).fetchall()))
