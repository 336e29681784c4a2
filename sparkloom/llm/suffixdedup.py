"""Passages that documents share, with a sparse suffix array over words.

Suffixes are kept only at minimisers: of every WINDOW consecutive GRAM-word grams the one with the smallest hash (the
first of equals), so the choice depends on content alone and every run of MIN_WORDS words has exactly one. A suffix
whose gram occurs in no other document cannot begin a match and is dropped by a pre-aggregated count. The rest are
sorted by their words; neighbours that differ bound the groups of suffixes with so many words in common to the right.
Each suffix is then extended to the left and right: a run that has it as its minimiser, l words to the left and
MIN_WORDS - l from it on, is shared if a suffix of another document in its group has the same l words before it. That
is asked for every l, so the longest match isn't hidden by a neighbour that is closer on one side only. Shared runs are
merged by document.

Equal texts are one: all of a text that several documents have is a passage, and one of them stands for it against
other texts. Suffixes with one gram are compared as one list of up to LISTED rows. Where a gram has more, its suffixes'
runs are dealt by the hash of their words instead, pre-aggregated, so that a passage in very many documents spreads over
tasks; the answer is the same. Text that repeats up to PERIODS words has only so many different runs, and each is asked
for once.

Defined results: a null text has no words; words are runs of anything but space and ASCII 9 to 13, compared exactly; a
passage counts if another row has it (another id or another text), so repeats inside one document alone don't; rows
equal in id and text are one document, listed once; rows without an id are listed with a null id; an empty table gives
no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint

MIN_WORDS, GRAM = 50, 16
WINDOW = MIN_WORDS - GRAM + 1
PERIODS = 4
#: Suffixes with one gram that are compared as one list.
LISTED = 1024
#: Suffixes of a document that are written at a time.
AT_ONCE = 4096

_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_NAMES = ("gram", "at", "low", "high", "reach")
_PLACE = "gram long, at int, low int, high int, reach int"


def word_hashes(text: str | None) -> np.ndarray:
    words = (text or "").encode("utf-8", "replace").split()
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    h = (a * _A + b) * _B
    return h ^ (h >> np.uint64(29))


def grams(words: np.ndarray) -> np.ndarray:
    """Hashes of all runs of GRAM words."""
    g, step = words, 1
    while step < GRAM:
        g, step = _mix(g[:-step], g[step:]), step * 2
    return g


def first_of_equals(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each run of MIN_WORDS words, by its start: whether it is the first of those that a loop of up to PERIODS
    words repeats, and the start of the last of them."""
    n = len(words) - MIN_WORDS + 1
    to = np.arange(n)
    for p in range(PERIODS, 0, -1):  # the shortest period is set last
        same = np.r_[np.zeros(p, np.int64), np.cumsum(words[p:] == words[:-p])]
        again = np.flatnonzero(same[MIN_WORDS - 1 :] - np.r_[0, same[: n - 1]] == MIN_WORDS)
        to[again[again >= p]] = again[again >= p] - p
    last = np.arange(n)
    if (to == last).all():
        return np.ones(n, bool), last
    while (to[to] != to).any():
        to = to[to]
    np.maximum.at(last, to, np.arange(n))
    return to == np.arange(n), last


def places(words: np.ndarray) -> tuple[np.ndarray, ...]:
    """Kept suffixes: their gram's hash, their position, the least and most words to the left with which a run has them
    as its minimiser, and how far a loop repeats that run."""
    n = len(words) - MIN_WORDS + 1
    if n < 1:
        return tuple(np.zeros(0, np.uint64 if i == 0 else np.int64) for i in range(5))
    g = grams(words)
    view = np.lib.stride_tricks.sliding_window_view(g, WINDOW)
    starts = np.arange(n)
    at = np.concatenate([view[k : k + 65536].argmin(1) + starts[k : k + 65536] for k in range(0, n, 65536)])
    leads, last = first_of_equals(words)
    s = starts[leads]
    m, reach = at[s], last[s] - s
    new = np.r_[True, (m[1:] != m[:-1]) | (s[1:] != s[:-1] + 1) | (reach[1:] > 0) | (reach[:-1] > 0)]
    first = np.flatnonzero(new)
    final = np.r_[first[1:], len(s)] - 1
    return g[m[first]], m[first], m[first] - s[final], m[first] - s[first], reach[first]


def contexts(words: np.ndarray, at: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[pa.Array, pa.Array]:
    """32-bit hashes of the words from each position on, MIN_WORDS - low, and of high words before it backwards."""
    short = np.maximum((words >> np.uint64(32)).astype(np.uint32), 1)
    return _runs(short, at, MIN_WORDS - low, 1), _runs(short, at - 1, high, -1)


def _runs(short: np.ndarray, start: np.ndarray, n: np.ndarray, step: int) -> pa.Array:
    """n numbers from each start on, as big-endian bytes, whose order is the numbers' order."""
    ends = np.cumsum(n)
    inside = np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - n, n)
    data = short[np.repeat(start, n) + step * inside].astype(">u4").tobytes()
    return pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer((np.r_[0, ends] * 4).astype(np.int32).tobytes()), pa.py_buffer(data)])


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of numbers, filled up with 0."""
    rows = [np.frombuffer(x, ">u4") for x in column.to_pylist()]
    n = np.array([len(r) for r in rows], np.int64)
    out = np.zeros((len(rows), width), np.uint32)
    if n.sum():
        out[np.repeat(np.arange(len(rows)), n), np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)] = np.concatenate(rows)
    return out


def shared_runs(gram: np.ndarray, key: np.ndarray, low: np.ndarray, high: np.ndarray, right: np.ndarray, left: np.ndarray) -> np.ndarray:
    """For suffixes sorted by gram and right words: whether the run with l words to the left is another document's too,
    as a row of flags by l."""
    n = len(gram)
    found = np.zeros((n, WINDOW), bool)
    differs = right[1:] != right[:-1]
    in_common = np.where(differs.any(1), differs.argmax(1), MIN_WORDS)  # words shared with the neighbour before
    in_common[gram[1:] != gram[:-1]] = -1
    before = np.zeros(n, np.uint64)
    for l in range(WINDOW):  # noqa: E741
        if l:
            before = _mix(before, left[:, l - 1].astype(np.uint64))
        rows = np.flatnonzero((low <= l) & (l <= high))
        if not len(rows):
            continue
        group = np.cumsum(np.r_[0, in_common < MIN_WORDS - l])[rows]
        run = _mix(before[rows], group.astype(np.uint64))
        order = np.argsort(run, kind="stable")
        first = np.flatnonzero(np.r_[True, run[order][1:] != run[order][:-1]])
        keys = key[rows][order]
        several = np.minimum.reduceat(keys, first) < np.maximum.reduceat(keys, first)
        found[rows[order], l] = np.repeat(several, np.diff(np.r_[first, len(order)]))
    return found


def _spans(found: np.ndarray, at: np.ndarray, reach: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Flags by words to the left -> (row, start, end) of the stretches of neighbouring runs."""
    edge = np.diff(np.pad(found, ((0, 0), (1, 1))).astype(np.int8), axis=1)
    row, lo = np.nonzero(edge == 1)
    hi = np.nonzero(edge == -1)[1] - 1
    return row, at[row] - hi, at[row] - lo + MIN_WORDS + reach[row]


def _batch(columns: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns.values()], list(columns))


def repeated_passages(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, start_word, end_word (exclusive), n_words of every maximal run that other documents share in parts of
    MIN_WORDS words or more."""
    slim = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    slim = slim.withColumns({"key": F.xxhash64("doc_id", "text"), "same": F.xxhash64("text")})

    def suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [word_hashes(t.as_py()) for t in batch.column("text")]
            found = [places(w) for w in words]
            offsets = np.r_[0, np.cumsum([len(f[0]) for f in found], dtype=np.int64)].astype(np.int32)
            gram, *rest = (np.concatenate([f[i] for f in found]) if found else np.zeros(0, np.int64) for i in range(5))
            fields = [pa.array(gram.view(np.int64)), *[pa.array(x.astype(np.int32)) for x in rest]]
            spots = pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays(fields, list(_NAMES)))
            yield _batch({c: batch.column(c) for c in ("doc_id", "key", "same", "also")} | {"words": pa.array([len(w) for w in words], pa.int64()), "places": spots})

    every = slim.withColumn("also", F.xxhash64(F.lit("text"), "text")).mapInArrow(suffixes, f"doc_id long, key long, same long, also long, words long, places array<struct<{_PLACE}>>")
    sparse = checkpoint(every.where(F.col("words") >= MIN_WORDS))
    texts = checkpoint(sparse.groupBy("same", "also").agg(F.min("key").alias("first"), F.max("key").alias("last")))
    # one document stands for all with its text
    alone = texts.select(F.col("first").alias("_k"), F.col("same").alias("_s"))
    single = sparse.join(alone, (F.col("key") == F.col("_k")) & (F.col("same") == F.col("_s")), "left_semi").select("key", "same", F.explode("places").alias("place"))
    counts = single.groupBy(F.col("place.gram").alias("_g")).agg(F.count("*").alias("n"), F.min("key").alias("a"), F.max("key").alias("b"))
    often = checkpoint(counts.where("a < b").select("_g", (F.col("n") > LISTED).alias("hot")))
    kept = single.join(often, F.col("place.gram") == F.col("_g")).groupBy(F.col("key").alias("_k"), F.col("same").alias("_s"))
    kept = kept.agg(F.collect_set(F.struct("hot", "place")).alias("places"))
    placed = slim.join(kept, (F.col("key") == F.col("_k")) & (F.col("same") == F.col("_s"))).select("doc_id", "key", "text", "places")
    rows = checkpoint(placed.mapInArrow(_spread, _ROWS))
    spans = _listed(rows.where("run is null")).unionByName(_dealt(rows.where("run is not null")))
    copies = texts.where("first < last").select(F.col("same").alias("_s"), F.col("also").alias("_a"))
    whole = sparse.join(copies, (F.col("same") == F.col("_s")) & (F.col("also") == F.col("_a")), "left_semi").groupBy("doc_id", "key").agg(F.max("words").alias("end"))
    return _merged(spans.unionByName(whole.select("doc_id", "key", F.lit(0).cast("long").alias("start"), "end")))


#: Rows of suffixes with their words, and of runs (with no words) where a gram has too many suffixes for a list.
_ROWS = f"doc_id long, key long, {_PLACE}, right binary, left binary, run long, start long, end long"


def _spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents with the suffixes kept of them, AT_ONCE at a time -> rows of suffixes and runs."""
    for batch in batches:
        for d, k, t, p in zip(*(batch.column(n) for n in ("doc_id", "key", "text", "places"))):
            words, spots = word_hashes(t.as_py()), p.values.field("place")
            hot = p.values.field("hot").to_numpy(zero_copy_only=False)
            every = [spots.field(n).to_numpy(zero_copy_only=False).astype(np.int64) for n in _NAMES]
            for made in (_suffix_rows(words, [x[~hot] for x in every]), _run_rows(words, [x[hot] for x in every])):
                for columns in made:
                    n = len(columns["run"])
                    yield _batch({"doc_id": pa.array([d.as_py()] * n, pa.int64()), "key": np.full(n, k.as_py())} | columns)


def _suffix_rows(words: np.ndarray, numbers: list[np.ndarray]) -> Iterator[dict]:
    for i in range(0, len(numbers[0]), AT_ONCE):
        gram, at, low, high, reach = (x[i : i + AT_ONCE] for x in numbers)
        right, left = contexts(words, at, low, high)
        none = pa.nulls(len(gram), pa.int64())
        yield {"gram": gram} | {k: v.astype(np.int32) for k, v in zip(_NAMES[1:], (at, low, high, reach))} | {"right": right, "left": left, "run": none, "start": none, "end": none}


def _run_rows(words: np.ndarray, numbers: list[np.ndarray]) -> Iterator[dict]:
    g = grams(words)
    for i in range(0, len(numbers[0]), AT_ONCE):
        _, at, low, high, reach = (x[i : i + AT_ONCE] for x in numbers)
        n = high - low + 1
        start = np.repeat(at - high, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        run = g[start]
        for more in (*range(GRAM, MIN_WORDS - GRAM, GRAM), MIN_WORDS - GRAM):
            run = _mix(run, g[start + more])
        rows, none = len(start), {k: pa.nulls(len(start), pa.int32()) for k in _NAMES[1:]}
        yield {"gram": pa.nulls(rows, pa.int64())} | none | {"right": pa.nulls(rows, pa.binary()), "left": pa.nulls(rows, pa.binary()), "run": run.view(np.int64), "start": start, "end": start + MIN_WORDS + np.repeat(reach, n)}


def _listed(rows: DataFrame) -> DataFrame:
    """Spans of suffixes that are compared with all others of their gram in one list."""
    rows = rows.select("doc_id", "key", *_NAMES, "right", "left").repartition("gram").sortWithinPartitions("gram", "right")

    def compared(batch: pa.RecordBatch) -> pa.RecordBatch:
        gram, key, at, low, high, reach = (batch.column(n).to_numpy().astype(np.int64) for n in ("gram", "key", *_NAMES[1:]))
        found = shared_runs(gram, key, low, high, _matrix(batch.column("right"), MIN_WORDS), _matrix(batch.column("left"), WINDOW))
        row, start, end = _spans(found, at, reach)
        return _batch({"doc_id": batch.column("doc_id").take(pa.array(row)), "key": key[row], "start": start, "end": end})

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # rows of the gram that the last batch ended in, LISTED at most
        for batch in batches:
            if not batch.num_rows:
                continue
            gram = batch.column("gram").to_numpy()
            whole = int(np.searchsorted(gram, gram[-1]))  # where the last gram begins
            if held and (whole or held[0].column("gram")[0].as_py() != gram[-1]):
                yield compared(pa.concat_batches([*held, batch.slice(0, whole)]))
                held = []
            elif whole:
                yield compared(batch.slice(0, whole))
            held.append(batch.slice(whole))
        if held:
            yield compared(pa.concat_batches(held))

    return rows.mapInArrow(compare, "doc_id long, key long, start long, end long")


def _dealt(rows: DataFrame) -> DataFrame:
    """Spans of runs that another document has too."""
    ends = rows.groupBy(F.col("run").alias("_run")).agg(F.min("key").alias("a"), F.max("key").alias("b"))
    shared = checkpoint(ends.where("a < b").select("_run"))
    return rows.join(shared, F.col("run") == F.col("_run"), "left_semi").select("doc_id", "key", "start", "end")


def _merged(spans: DataFrame) -> DataFrame:
    """Spans that meet joined up, read as neighbouring rows; a document's rows are in one task, and none are held."""
    names = ["doc_id", "start_word", "end_word", "n_words"]

    def join_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # doc_id, key, start, end of the span that may go on
        for batch in batches:
            if not batch.num_rows:
                continue
            docs = batch.column("doc_id")
            key, start, end = (batch.column(n).to_numpy().astype(np.int64) for n in ("key", "start", "end"))
            if held is not None:
                docs = pa.concat_arrays([pa.array([held[0]], pa.int64()), docs])
                key, start, end = np.r_[held[1], key], np.r_[held[2], start], np.r_[held[3], end]
            ids = docs.fill_null(-1).to_numpy(zero_copy_only=False)  # ids too: keys of many documents may be equal
            other = (key[1:] != key[:-1]) | (ids[1:] != ids[:-1]) | (docs.is_null().to_numpy(zero_copy_only=False)[1:] != docs.is_null().to_numpy(zero_copy_only=False)[:-1])
            doc = np.cumsum(np.r_[0, other])
            far = int(end.max()) + 1
            upto = np.maximum.accumulate(end + doc * far) - doc * far  # furthest end so far in the document
            new = np.r_[True, other | (start[1:] > upto[:-1])]
            first = np.flatnonzero(new)
            last = np.r_[first[1:], len(key)] - 1
            held = (docs[int(first[-1])].as_py(), key[-1], start[first[-1]], upto[-1])
            first, last = first[:-1], last[:-1]
            yield _batch(dict(zip(names, (docs.take(pa.array(first)), start[first], upto[last], upto[last] - start[first]))))
        if held is not None:
            yield _batch(dict(zip(names, (pa.array([held[0]], pa.int64()), [held[2]], [held[3]], [held[3] - held[2]]))))

    rows = spans.repartition("key").sortWithinPartitions("key", "doc_id", "start")
    return rows.mapInArrow(join_up, "doc_id long, start_word long, end_word long, n_words long")
