import os

import numpy as np
import pytest
import sentencepiece

from sparkloom.llm import spm
from sparkloom.llm.queries import MODEL, TOKENIZERS, op1_sentencepiece

PATH = f"{TOKENIZERS}/{MODEL}"
pytestmark = pytest.mark.skipif(not os.path.exists(PATH), reason="no vocabulary file")


@pytest.fixture(scope="module")
def model():
    return spm.load_model(PATH)


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def lists(ids, totals):
    ends = np.r_[0, np.cumsum(totals)]
    return [ids[a:b].tolist() for a, b in zip(ends[:-1], ends[1:])]


def test_equals_library_on_odd_texts(model, library):
    rng = np.random.default_rng(5)
    letters = list("abcdeth ing  \n\t.,AB01éß你🎉▁")
    texts = ["", " ", "  ", " a  b   c ", " " * 15, " " * 16, "a" + " " * 47 + "b", "x" * 400, "<s> <0x0A> </s>", "🎉🎉"]
    texts += ["".join(rng.choice(letters, rng.integers(0, 60))) for _ in range(400)]
    enc = spm.Encoder(model)
    assert lists(*enc.encode(texts)) == [library.encode(t) for t in texts]
    assert lists(*enc.encode(texts)) == [library.encode(t) for t in texts]  # from memory


def test_unigram_equals_exhaustive_search():
    """A small unigram model against all segmentations."""
    import struct

    def piece(s, score, kind=1):
        body = b"\n" + bytes([len(s.encode())]) + s.encode() + b"\x15" + struct.pack("<f", score) + bytes([0x18, kind])
        return b"\n" + bytes([len(body)]) + body

    vocab = {"▁": -3.0, "a": -2.0, "b": -2.5, "ab": -3.0, "▁a": -3.5, "aba": -6.0, "ba": -4.25}
    blob = piece("<unk>", 0, 2) + b"".join(piece(k, v) for k, v in vocab.items())
    blob += b"\x12\x02\x18\x01" + b"\x1a\x04\x18\x01\x20\x00"
    m = spm.SentencePieceModel(blob)
    names = ["<unk>", *vocab]

    def best(s):
        if not s:
            return 0.0
        return max(vocab[s[:k]] + best(s[k:]) for k in range(1, len(s) + 1) if s[:k] in vocab)

    for text in ("abab", "aba", "bbaab", "ababa ba"):
        (ids,) = lists(*spm.Encoder(m).encode([text]))
        got = [names[i] for i in ids]
        assert "".join(got) == "▁" + text.replace(" ", "▁")
        words = ("▁" + text.replace(" ", "▁")).replace("▁", " ▁").split()
        assert sum(vocab[p] for p in got) == pytest.approx(sum(best(w) for w in words))


def test_operator_on_odd_rows(spark, odd_docs, no_docs, model, library):
    rows = spm.encode(odd_docs, model, check=True).collect()
    assert len(rows) == 10
    for r in rows:
        assert r.token_ids == library.encode(r.text or "") and r.n_tokens == len(r.token_ids) and r.round_trip
        assert r.copies in ("x", "", "y", "z", None)
    back = spm.decode(spm.encode(odd_docs, model), model).collect()
    assert all(r.decoded == (r.text or "") for r in back)
    assert spm.encode(no_docs, model).collect() == []


def test_query_covers_the_table_and_round_trips(spark, sf_dir, library):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = op1_sentencepiece(spark, sf_dir).collect()
    assert len(rows) == len(texts) and all(r.round_trip for r in rows)
    assert all(r.token_ids == library.encode(texts[r.doc_id]) for r in rows)
