import re
from itertools import permutations

import duckdb
import numpy as np

from sparkloom.llm import audit
from sparkloom.llm.queries import op12_filter_audit


def brute(docs, labels):
    """docs: (doc_id, text, lang); labels: (doc_id, quality, toxic)."""
    good = {i for i, q, _ in labels if i is not None and q == 1}
    toxic = {i for i, _, t in labels if i is not None and t == 1}
    fails = []
    for i, text, _ in docs:
        text = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", text)
        copy = i is not None and any(j is not None and j < i and (t or "") == text for j, t, _ in docs)
        conditions = (len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * len(re.findall("[A-Z]", text)) > 3 * len(text), bool(re.search("[#$%&*|]", text)), copy)
        fails.append({c for c, f in zip("ABCDE", conditions) if f})
    out = []
    for part in {p or "" for _, _, p in docs}:
        rows = [(d[0], f) for d, f in zip(docs, fails) if (d[2] or "") == part]
        mine, share = [], dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = rows
            for step, c in enumerate(order, 1):
                gone = [r for r in left if c in r[1]]
                left = [r for r in left if c not in r[1]]
                failing = sum(c in f for _, f in rows)
                share[c] += len(gone)
                mine.append((part, "".join(order), step, len(left), len(gone), failing - len(gone), sum(f == {c} for _, f in rows), sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone)))
        out += [(*r, share[r[1][r[2] - 1]]) for r in mine]
    return sorted(out)


def rows_of(df):
    return sorted(map(tuple, df.collect()))


def test_counts_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    long = lambda n: " ".join(f"w{i}" for i in range(n))
    pieces = [long(250), long(199), long(200), "a b " * 150, long(210) + " #", "ABC " * 70 + long(200), "", None, "x", long(250).upper()]
    docs = [(int(i) if i % 11 else None, pieces[rng.integers(len(pieces))], [None, "en", "de", ""][rng.integers(4)]) for i in range(150)] + [(7, pieces[0], "en")] * 3
    labels = [(int(i), int(rng.integers(2)), int(rng.integers(2))) for i in range(0, 150, 2)] + [(4, 1, 1), (None, 1, 1), (6, None, None)]
    d = spark.createDataFrame(docs, "doc_id long, text string, lang string").repartition(5)
    got = audit.audit(d, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert rows_of(got) == brute(docs, labels)


def test_batches_and_partitions_don_t_matter(spark):
    docs = spark.range(500).selectExpr("id as doc_id", "repeat('A b ', cast(id % 130 as int)) as text", "concat('l', id % 37) as lang")
    labels = docs.selectExpr("doc_id", "cast(doc_id % 2 as int) as quality", "cast(doc_id % 3 = 0 as int) as toxic")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = rows_of(audit.audit(docs.coalesce(1), labels))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        assert rows_of(audit.audit(docs.repartition(9), labels)) == want
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_bitmaps_of_one_part_of_one_row():
    bits = np.array([0b00101, 0b100010, 0b1000000, 0], np.int32)
    got = audit.counted(bits, np.array([0, 1, 2, 3]))
    assert got[:, 0].tolist() == [1] * 4 and got[:, 1:6].tolist() == [[1, 0, 1, 0, 0], [0, 1, 0, 0, 0], [0] * 5, [0] * 5]
    assert got[:, 6:11].tolist() == [[0] * 5, [0, 1, 0, 0, 0], [0] * 5, [0] * 5]


def test_odd_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(1, 1, 0), (None, 1, 1)], "doc_id long, quality int, toxic int").selectExpr("*", "'x' as text", "1 as part")
    docs = [(r.doc_id, r.text, r.lang) for r in odd_docs.collect()]
    assert rows_of(audit.audit(odd_docs, labels)) == brute(docs, [(1, 1, 0), (None, 1, 1)])
    assert audit.audit(no_docs, labels).collect() == []
    assert rows_of(audit.audit(odd_docs, labels.limit(0))) == brute(docs, [])


def test_sql(spark, sf_dir):
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    assert rows_of(op12_filter_audit(spark, sf_dir)) == sorted(con.execute(audit.ORACLE).fetchall())
