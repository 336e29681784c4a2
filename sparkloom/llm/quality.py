"""Quality classifier: logistic regression on hashed word n-grams, trained with follow-the-regularised-leader updates.

A text's tokens are runs of letters and digits and runs of punctuation, as UTF-8 bytes with their case. Unigrams and
bigrams are hashed to DIMS places; a bigram of a token and an equal one up to LAGS tokens earlier also counts as the
n-gram "same again", whatever the token. A place's value is its share of the text's n-grams times SCALE, so a score is
a sparse dot product that does not grow with length. Labels are learnt from a bounded sample: the SAMPLE labelled rows
with the smallest hashes of their id. The model, DIMS numbers at most, is the only thing that reaches the driver.

Defined results: null or empty texts have no n-grams and score the bias alone; labels that are null or not 0 or 1 are
not learnt from, and neither are labels of documents that don't exist; repeated labels count each time; without any
label to learn from every score is 0.5 and predicts 1.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import checkpoint

TOKEN = re.compile(rb"[A-Za-z0-9_\x80-\xff]+|[^A-Za-z0-9_\x80-\xff\s]+")
DIMS = 1 << 18
SCALE = 32.0
LAGS = 4
#: Bound of the sample of labelled rows that the model is fitted on.
SAMPLE = 4096
EPOCHS = 3
#: Features that are written at a time.
AT_ONCE = 1 << 20
ALPHA, BETA, L1, L2 = 1.0, 1.0, 0.5, 0.01
#: Tokens whose n-grams are scored at a time.
AT_ONCE = 1 << 18


def ngram_places(text: str | None) -> Iterator[np.ndarray]:
    """Places of all n-grams of a whole text, in parts."""
    crc = zlib.crc32
    tokens = TOKEN.findall((text or "").encode("utf-8", "replace"))
    for k in range(0, len(tokens), AT_ONCE):
        seen = min(k, LAGS)  # tokens of the part before
        one = np.fromiter(map(crc, tokens[k - seen : k + AT_ONCE]), np.uint64)
        new = len(one) - seen
        parts = [(one[seen:] % np.uint64(DIMS)).astype(np.int64)]
        for lag in range(1, LAGS + 1):
            left, right = one[max(0, seen - lag) : -lag], one[max(lag, seen) :]
            if lag == 1 and len(right):
                two = (left[-len(right) :] * np.uint64(0x9E3779B1) + right) * np.uint64(0x9E3779B97F4A7C15)
                parts.append((two >> np.uint64(64 - 18)).astype(np.int64))
            parts.append(np.full(int((left == right).sum()) if new and len(right) else 0, crc(b"same again %d" % lag) % DIMS, np.int64))
        yield np.concatenate(parts)


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Places and values of a text, for learning."""
    counts: dict[int, int] = {}
    for part in ngram_places(text):
        for p, c in zip(*(x.tolist() for x in np.unique(part, return_counts=True))):
            counts[p] = counts.get(p, 0) + c
    places = np.fromiter(sorted(counts), np.int64, len(counts))
    values = np.array([counts[p] for p in places.tolist()], np.float64)
    return places, values * (SCALE / values.sum()) if len(values) else values


class Ftrl:
    """Follow the proximally regularised leader; place DIMS is the bias and is not regularised."""

    def __init__(self):
        self.z, self.n = np.zeros(DIMS + 1), np.zeros(DIMS + 1)

    def weights(self, at: np.ndarray) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        l1, l2 = np.where(at == DIMS, 0, L1), np.where(at == DIMS, 0, L2)
        return np.where(np.abs(z) <= l1, 0.0, (np.sign(z) * l1 - z) / ((BETA + np.sqrt(n)) / ALPHA + l2))

    def learn(self, places: np.ndarray, values: np.ndarray, label: int) -> None:
        at, x = np.r_[places, DIMS], np.r_[values, 1.0]
        w = self.weights(at)
        g = (sigmoid(float(w @ x)) - label) * x
        self.z[at] += g - (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / ALPHA * w
        self.n[at] += g * g


def sigmoid(x: float) -> float:
    return 1 / (1 + np.exp(-min(max(x, -700.0), 700.0)))


def fit_rows(rows: list[tuple[np.ndarray, np.ndarray, int]]) -> np.ndarray:
    """Weights from (places, values, label) rows in their order; DIMS places and the bias."""
    model = Ftrl()
    for _ in range(EPOCHS):
        for row in rows:
            model.learn(*row)
    return model.weights(np.arange(DIMS + 1))


def learnable(doc_id: Column) -> Column:
    """Whether a row's label may be learnt from: crc32 of the id as text leaves 0 or 2 when divided by 3."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 != 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> np.ndarray:
    """Weights learnt from the sample: the labelled documents whose ids have the smallest hashes. docs: doc_id, text; labels:
    doc_id, quality.

    The features of the sample are kept in order in the shared folder, and each epoch is a pass over them that begins with
    the state the one before left. A pass holds the state and one batch, however long the texts are."""
    present = docs.select(F.col("doc_id").alias("_d")).where("_d is not null").distinct()
    chosen = (
        labels.select(F.col("doc_id").alias("_id"), F.col("quality").cast("int").alias("_label"))
        .where(learnable(F.col("_id")) & F.col("_label").isin(0, 1))
        .join(present, F.col("_id") == F.col("_d"), "left_semi")
        .withColumn("_order", F.xxhash64("_id"))
        .orderBy("_order", "_id", "_label")
        .limit(sample)
    )
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("_id"))  # at most SAMPLE ids
    names = ["_order", "_id", "_label", "places", "values"]

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, start, size = [], 0, 0
            for i, t in enumerate(batch.column("text")):
                held.append(features(t.as_py()))
                size += len(held[-1][0])
                if size >= AT_ONCE or i + 1 == batch.num_rows:
                    same = [batch.column(n).slice(start, len(held)) for n in names[:3]]
                    yield pa.RecordBatch.from_arrays([*same, pa.array([p for p, _ in held], pa.list_(pa.int64())), pa.array([v for _, v in held], pa.list_(pa.float64()))], names)
                    held, start, size = [], i + 1, 0

    rows = texts.select("_order", "_id", "_label", "text").mapInArrow(extract, "_order long, _id long, _label int, places array<long>, values array<double>")
    rows = checkpoint(rows.repartition(1).sortWithinPartitions("_order", "_id", "_label", F.xxhash64("places")))  # SAMPLE rows
    model, shared = Ftrl(), docs.sparkSession.sparkContext.broadcast
    for _ in range(EPOCHS):
        begin = shared((model.z, model.n))

        def learn(batches: Iterator[pa.RecordBatch], begin=begin) -> Iterator[pa.RecordBatch]:
            now = Ftrl()
            now.z, now.n = (x.copy() for x in begin.value)
            for batch in batches:
                for p, v, y in zip(batch.column("places"), batch.column("values"), batch.column("_label").to_pylist()):
                    now.learn(p.values.to_numpy(), v.values.to_numpy(), y)
            at = np.flatnonzero(now.n)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(now.z[at]), pa.array(now.n[at])], ["place", "z", "n"])

        state = rows.mapInArrow(learn, "place long, z double, n double").toArrow()
        at = state.column("place").to_numpy()
        model.z[at], model.n[at] = state.column("z").to_numpy(), state.column("n").to_numpy()
        begin.unpersist()
    return model.weights(np.arange(DIMS + 1))


def score_text(text: str | None, weights: np.ndarray) -> float:
    total = n = 0
    for part in ngram_places(text):
        total += float(weights[part].sum())
        n += len(part)
    return float(sigmoid(SCALE * total / n + weights[DIMS] if n else weights[DIMS]))


def score(docs: DataFrame, weights: np.ndarray, text: str = "text", out: str = "score", keep_text: bool = False) -> DataFrame:
    """docs with the score of each whole text (0 to 1; higher: label 1 likelier). One narrow stage."""
    kept = [f for f in docs.schema.fields if f.name != out and (keep_text or f.name != text)]
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        for batch in batches:
            scores = pa.array([score_text(t.as_py(), w) for t in batch.column(batch.schema.get_field_index(text))], pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(f.name)) for f in kept] + [scores], [f.name for f in kept] + [out])

    return docs.mapInArrow(run, T.StructType([*kept, T.StructField(out, T.DoubleType())]))
