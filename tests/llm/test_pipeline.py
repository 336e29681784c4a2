from collections import Counter

import corpus_pipeline as cp
import sentencepiece

from sparkloom.llm import mixing, pii, quality, shingled, simhash
from sparkloom.llm.queries import MODEL, TOKENIZERS


def _similar(x: set, y: set) -> bool:
    """By the whole shingle sets."""
    return bool(x and y) and len(x & y) >= shingled.SIMILAR * len(x | y)


def test_run_equals_plain_stages(spark, sf_dir):
    """Every stage's decisions, made again outside Spark on what the stage before kept."""
    assert [n for n, _ in cp.STAGES] == ["quality", "near_dedup", "pii", "mix", "tokenise"]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    w = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    kept = [r for r in docs.collect() if quality.score_text(r.text, w) >= 0.5]
    fps = {r.doc_id: simhash.simhash(r.text, cp.SHINGLE) & (2**64 - 1) for r in kept}
    sets = {r.doc_id: set(simhash.shingle_hashes(r.text, cp.SHINGLE).tolist()) for r in kept}
    groups = {d: d for d in fps}
    for a in sorted(fps):
        for b in fps:
            if b > a and ((fps[a] ^ fps[b]).bit_count() <= 3 or _similar(sets[a], sets[b])):
                x, y = groups[a], groups[b]
                groups = {d: min(x, y) if g in (x, y) else g for d, g in groups.items()}
    kept = [r for r in kept if groups[r.doc_id] == r.doc_id]
    clean = spark.createDataFrame([(*r[:1], pii.redact(r.text, pii.find(r.text)), *r[2:]) for r in kept], docs.schema)
    taken = {r.doc_id: r.copies for r in mixing.mix(clean).collect()}
    texts = {r.doc_id: r.text for r in clean.collect()}
    sp = sentencepiece.SentencePieceProcessor(model_file=f"{TOKENIZERS}/{MODEL}")
    rows = cp.run(spark, sf_dir).collect()
    assert Counter(r.doc_id for r in rows) == Counter({d: n for d, n in taken.items() if n})
    assert all(r.round_trip and r.token_ids == sp.encode(texts[r.doc_id]) for r in rows)


def test_stages_on_odd_rows(spark, odd_docs, no_docs, sf_dir):
    for name, stage in cp.STAGES:
        for docs in (odd_docs, no_docs):
            out = stage(spark, docs, sf_dir)
            if name != "tokenise":
                assert out.columns == docs.columns
            n = out.count()
            assert n == 0 if docs is no_docs else n > 0
    left = cp.near_dedup(spark, odd_docs, sf_dir).collect()
    assert Counter(r.doc_id for r in left) == Counter([1, 3, 6, 7])  # the row without an id has one word more than 1


def test_clashing_names(spark, odd_docs, sf_dir):
    """Columns named like those that the stages add are kept as they are."""
    extra = ("_score", "_key", "_doc", "_mix_key", "_copies_of_row", "_mix_id", "_redacted_", "h", "fp", "copies_")
    docs = odd_docs.drop("_key").selectExpr("*", *[f"concat('{c}', doc_id) as {c}" for c in extra])
    for name, stage in cp.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == docs.columns, name
        rows = out.collect()
        assert rows and all(r[c] == (None if r.doc_id is None else f"{c}{r.doc_id}") for r in rows for c in extra)
