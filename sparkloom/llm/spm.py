"""SentencePiece encoding and decoding with a batched numpy Viterbi.

Words of equal length advance together, one character at a time. For every end position the hashes of the
substrings that end there probe the sorted piece keys; a vectorised maximum over the admissible pieces stores the
back pointer. Unigram models maximise the sum of scores. For BPE models a piece is admissible after its predecessor
only if no merge would have crossed their boundary, which leaves one path, the one that merging by score gives, so
the result equals the merge order's result exactly.

Defined results: a null text counts as empty; an empty text has no ids; characters outside the vocabulary become
their UTF-8 bytes' pieces (or the unknown id where the model has no byte pieces); U+2581 in a text counts as a space,
as in the format itself. Repeated rows are encoded each. Input columns named like an output are replaced by it.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import chunked

SPACE = "▁"
BASE = np.uint64(0x9E3779B97F4A7C15)
MIX = np.uint64(0xC2B2AE3D27D4EB4F)
FAR = np.int64(1) << 40
BEGIN, UNKNOWN = -2, -1
#: Words that a worker remembers; it forgets all of them when there are more.
REMEMBERED = 400_000


def _fields(b: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Fields of a protocol buffer message."""

    def varint(i: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            value |= (b[i] & 127) << shift
            if b[i] < 128:
                return value, i + 1
            i, shift = i + 1, shift + 7

    i = 0
    while i < len(b):
        tag, i = varint(i)
        if tag & 7 == 0:
            value, i = varint(i)
        else:
            n, i = varint(i) if tag & 7 == 2 else (4 if tag & 7 == 5 else 8, i)
            value, i = b[i : i + n], i + n
        yield tag >> 3, value


class SentencePieceModel:
    """Tables of a .model file. Built on the driver from the file's bytes; a few MB whatever the corpus."""

    def __init__(self, blob: bytes):
        raw, trainer, normaliser = [], {}, {}
        for field, value in _fields(blob):
            if field == 1:
                raw.append(dict(_fields(value)))
            elif field == 2:
                trainer = dict(_fields(value))
            elif field == 3:
                normaliser = dict(_fields(value))
        self.bpe = trainer.get(3, 1) == 2
        if trainer.get(3, 1) not in (1, 2):
            raise ValueError("only unigram and BPE models are supported")
        if normaliser.get(2) or normaliser.get(4, 1):
            raise ValueError("only models that keep texts as they are (identity, all white space kept) are supported")
        self.prefix = bool(normaliser.get(3, 1))
        text = [p[1].decode() for p in raw]
        kind = [p.get(3, 1) for p in raw]
        if 4 in kind:
            raise ValueError("user-defined pieces are not supported")
        score = np.array([struct.unpack("<f", p[2])[0] if 2 in p else 0.0 for p in raw], np.float64)
        if any(SPACE in s.lstrip(SPACE) for s, k in zip(text, kind) if k == 1):
            raise ValueError("pieces that span words are not supported")
        self.unk = kind.index(2)
        self.bytes_ids = np.full(256, self.unk, np.int32)
        for i, (s, k) in enumerate(zip(text, kind)):
            if k == 6:
                self.bytes_ids[int(s[3:5], 16)] = i
        self.byte_fallback = 6 in kind
        # runs of spaces are laid over words afterwards: their pieces take no part in the search
        self.space = text.index(SPACE) if SPACE in text else self.unk
        self.runs = {len(s): i for i, (s, k) in enumerate(zip(text, kind)) if k == 1 and not s.strip(SPACE)}
        normal = [i for i, (s, k) in enumerate(zip(text, kind)) if k == 1 and (s == SPACE or s.strip(SPACE))]
        by_score = sorted(normal, key=lambda i: -score[i])
        self.rank = np.full(len(text), -1, np.int64)  # of merged pieces; characters are there from the start
        self.left, self.right = (np.full(len(text), -1, np.int32) for _ in range(2))
        if self.bpe:
            place = {text[i]: (r, i) for r, i in enumerate(by_score)}
            reachable = []
            for i in normal:
                if len(text[i]) == 1:
                    reachable.append(i)
                elif cut := self._last_merge(text[i], place):
                    self.left[i], self.right[i] = cut
                    self.rank[i] = place[text[i]][0]
                    reachable.append(i)
            normal = reachable
        self.longest = max(map(len, (text[i] for i in normal)), default=1)
        self.power = np.cumprod(np.r_[np.uint64(1), np.full(self.longest + 1, BASE)], dtype=np.uint64)
        self.length = np.array([len(s) for s in text], np.int64)
        self.hash = np.array([self._hash(s) for s in text], np.uint64)
        keys = self.hash[normal] * MIX + self.length[normal].astype(np.uint64)
        order = np.argsort(keys)
        self.keys, self.key_ids = keys[order], np.array(normal, np.int32)[order]
        if len(np.unique(keys)) < len(keys):
            raise ValueError("two pieces have the same key")
        self.seen = np.zeros(1 << 20, bool)
        self.seen[(self.keys >> np.uint64(44)).astype(np.int64)] = True
        self.score = score
        known = [score[i] for i in normal]
        self.unk_score = (min(known) if known else 0.0) - 10.0
        whole = [
            bytes([int(s[3:5], 16)]) if k == 6 else b"" if k == 3 else " ⁇ ".encode() if k == 2 else s.replace(SPACE, " ").encode()
            for s, k in zip(text, kind)
        ]
        self.out_len = np.array([len(w) for w in whole], np.int64)
        self.out_start = np.cumsum(self.out_len) - self.out_len
        self.out_flat = np.frombuffer(b"".join(whole), np.uint8)

    @staticmethod
    def _hash(s: str) -> int:
        h = 0
        for c in s:
            h = (h * int(BASE) + ord(c) + 1) & 0xFFFFFFFFFFFFFFFF
        return h

    @staticmethod
    def _last_merge(s: str, place: dict) -> tuple[int, int] | None:
        """Ids of the two parts whose merge makes the piece s; None if merging s's characters doesn't end in s."""
        parts = list(s)
        while len(parts) > 1:
            found = min(((place[a + b][0], k) for k, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in place), default=None)
            if found is None:
                return None
            k = found[1]
            if len(parts) == 2:
                return (place[parts[0]][1], place[parts[1]][1]) if parts[0] in place and parts[1] in place else None
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return None

    def probe(self, hashes: np.ndarray, length) -> np.ndarray:
        """Ids of the pieces with these substring hashes, -1 where there is none."""
        keys = hashes * MIX + np.asarray(length).astype(np.uint64)
        out = np.full(keys.shape, UNKNOWN, np.int32)
        maybe = np.nonzero(self.seen[(keys >> np.uint64(44)).astype(np.int64)])  # spares most misses the search
        some = keys[maybe]
        at = np.minimum(np.searchsorted(self.keys, some), len(self.keys) - 1)
        out[maybe] = np.where(self.keys[at] == some, self.key_ids[at], UNKNOWN)
        return out


class Encoder:
    """Encodes and decodes batches of texts; one per worker process."""

    def __init__(self, model: SentencePieceModel):
        self.m = model
        self.slots = 1 << 21
        self.pair_key = np.full(self.slots, -1, np.int64)  # a direct-mapped memory of checked pairs
        self.pair_ok = np.zeros(self.slots, bool)
        self.forget()

    def forget(self) -> None:
        self.place: dict[str, int] = {}
        self.start, self.count = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.int32)

    # --- pairs -------------------------------------------------------------------------------------------------
    def allowed(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether merging leaves piece b right after piece a (a, b: ids of 0 and more)."""
        key = a.astype(np.int64) * len(self.m.rank) + b
        slot = ((key.astype(np.uint64) * BASE) >> np.uint64(43)).astype(np.int64)
        ok = self.pair_ok[slot]
        new = np.flatnonzero(self.pair_key[slot] != key)
        if len(new):
            fresh, back = np.unique(key[new], return_inverse=True)
            seen = self._check(fresh // len(self.m.rank), fresh % len(self.m.rank))
            ok[new] = seen[back]
            self.pair_key[slot[new]], self.pair_ok[slot[new]] = key[new], ok[new]
        return ok

    def _check(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Walks both pieces' merges backwards in time. At each moment the parts a and b meet at the boundary; the
        pair is impossible if their union is a piece that merges before either part is taken up by its own piece."""
        m, ok, at = self.m, np.ones(len(a), bool), np.arange(len(a))
        until = np.full(len(a), FAR)
        while len(at):
            union = m.probe(m.hash[a] * m.power[np.minimum(m.length[b], m.longest)] + m.hash[b], m.length[a] + m.length[b])
            union = np.where(m.length[a] + m.length[b] <= m.longest, union, UNKNOWN)
            crossed = (union >= 0) & (m.rank[np.maximum(union, 0)] < until)
            ok[at[crossed]] = False
            ra, rb = m.rank[a], m.rank[b]
            go = ~crossed & ((ra >= 0) | (rb >= 0))
            a, b, at, ra, rb = a[go], b[go], at[go], ra[go], rb[go]
            later = ra > rb  # of equal pieces the left one merges first
            until = np.where(later, ra, rb + 1)
            a, b = np.where(later, m.right[a], a), np.where(later, b, m.left[b])
        return ok

    # --- words -------------------------------------------------------------------------------------------------
    def _learn(self, words: list[str]) -> None:
        """Adds the encodings of new words (each stands for a space and the word)."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        order = np.argsort(lengths, kind="stable")
        starts, counts, flats, at = [], [], [], len(self.flat)
        lead = SPACE if self.m.prefix else ""
        for part in np.split(order, np.flatnonzero(np.diff(lengths[order])) + 1) if len(words) else []:
            size = int(lengths[part[0]]) + len(lead)
            step = max(1, 150_000 // max(size, 1))
            for k in range(0, len(part), step):
                block = [words[i] for i in part[k : k + step]]
                chars = np.frombuffer("".join(lead + w for w in block).encode("utf-32-le", "surrogatepass"), np.uint32)
                flat, count = self._viterbi(chars.reshape(len(block), size)) if size else (np.zeros(0, np.int32), np.zeros(len(block), np.int64))
                starts.append(at + np.cumsum(count) - count)
                counts.append(count)
                flats.append(flat)
                at += len(flat)
        known = len(self.place)
        self.place.update(zip((words[i] for i in order), range(known, known + len(words))))
        self.start, self.count = np.concatenate([self.start, *starts]), np.concatenate([self.count, *counts])
        self.flat = np.concatenate([self.flat, *flats])

    def _viterbi(self, chars: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """chars: words of equal length as rows. Flat ids and their number by row."""
        m, (n, size) = self.m, chars.shape
        prefix = np.zeros((size + 1, n), np.uint64)
        for i in range(size):
            prefix[i + 1] = prefix[i] * BASE + chars[:, i] + np.uint64(1)
        last = np.full((size + 1, n), BEGIN, np.int32)
        back = np.zeros((size + 1, n), np.int32)
        best = np.zeros((size + 1, n)) if not m.bpe else None
        for i in range(1, size + 1):
            lens = np.arange(1, min(i, m.longest) + 1)
            ids = m.probe(prefix[i] - prefix[i - lens] * m.power[lens][:, None], lens[:, None])
            before = last[i - lens]
            if m.bpe:
                ok = ids >= 0
                ask = ok & (before >= 0)
                ok[ask] = self.allowed(before[ask], ids[ask])
                gain = np.where(ok, lens[:, None], 0)
            else:
                gain = np.where(ids >= 0, best[i - lens] + m.score[ids], -np.inf)
                gain[0] = np.where(ids[0] < 0, best[i - 1] + m.unk_score, gain[0])
            pick = gain.argmax(0)
            row = np.arange(n)
            last[i], back[i] = ids[pick, row], lens[pick]
            if best is not None:
                best[i] = gain[pick, row]
        where, out = np.full(n, size), np.full((n, size), -3, np.int32)
        col, row = size - 1, np.arange(n)
        while len(row):
            got = last[where[row], row]
            if (got < 0).any():  # outside the vocabulary: kept as -10 less the code point
                got = np.where(got < 0, -10 - chars[row, where[row] - 1].astype(np.int32), got)
            out[row, col] = got
            where[row] -= back[where[row], row]
            row, col = row[where[row] > 0], col - 1
        kept = out != -3
        flat, count = out[kept], kept.sum(1)
        if (odd := flat < 0).any():
            point = -10 - flat[odd].astype(np.int64)
            if m.byte_fallback and (point < 128).all():
                flat[odd] = m.bytes_ids[point]
            else:
                lists, owner = [], np.repeat(np.arange(n), count)
                for x in flat:
                    lists.append([x] if x >= 0 else m.bytes_ids[list(chr(-10 - x).encode("utf-8", "surrogatepass"))] if m.byte_fallback else [m.unk])
                if not m.byte_fallback:  # neighbouring unknown characters are one unknown piece
                    lists = [[] if k and lists[k][0] == m.unk == lists[k - 1][0] and owner[k] == owner[k - 1] else x for k, x in enumerate(lists)]
                count = np.bincount(owner, [len(x) for x in lists], n).astype(np.int64)
                flat = np.fromiter(chain.from_iterable(lists), np.int32)
        return flat, count

    # --- texts -------------------------------------------------------------------------------------------------
    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of all texts, and the number of ids of each."""
        split = [t.replace(SPACE, " ").split(" ") if t else [] for t in texts]
        if not self.m.prefix:
            raise ValueError("models without a leading space are not supported")
        words = list(chain.from_iterable(split))
        fresh = set(words)
        if len(self.place) + len(fresh) > REMEMBERED and len(self.place):
            self.forget()
        self._learn(list(fresh.difference(self.place)))
        at = np.fromiter(map(self.place.__getitem__, words), np.int64, len(words))
        count = self.count[at]
        ends = np.r_[0, np.cumsum(count)]
        ids = self.flat[np.arange(ends[-1]) + np.repeat(self.start[at] - ends[:-1], count)]
        sizes = np.fromiter(map(len, split), np.int64, len(split))
        text_ends = ends[np.r_[0, np.cumsum(sizes)]]
        totals = np.diff(text_ends)
        if "" in fresh:
            parts, first = [], np.r_[0, np.cumsum(sizes)]
            for k, (a, b) in enumerate(zip(text_ends[:-1], text_ends[1:])):
                if "" in split[k]:
                    parts.append(self._runs(split[k], ids, ends[first[k] : first[k + 1] + 1]))
                    totals[k] = len(parts[-1])
                else:
                    parts.append(ids[a:b])
            ids = np.concatenate(parts)
        return ids.astype(np.int32), totals

    def _runs(self, words: list[str], ids: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Ids of a text with runs of spaces: the last space of a run belongs to its word where it merges with it."""
        out, run = [], 0
        for w, a, b in zip(words, ends[:-1], ends[1:]):
            if w == "":
                run += 1
                continue
            own = ids[a:b]
            if run:
                alone = own[0] == self.m.space
                out.append(self._spaces(run + alone))
                own, run = own[int(alone) :], 0
            out.append(own)
        if run:
            out.append(self._spaces(run))
        return np.concatenate(out)

    def _spaces(self, n: int) -> np.ndarray:
        """Ids of n spaces in a row, by leftmost merging: all merges among spaces rank alike."""
        runs = self.m.runs
        if not self.m.bpe:
            score = [0.0] + [-np.inf] * n
            cut = [0] * (n + 1)
            for i in range(1, n + 1):
                for k, piece in runs.items():
                    if k <= i and score[i - k] + self.m.score[piece] > score[i]:
                        score[i], cut[i] = score[i - k] + self.m.score[piece], k
            out = []
            while n:
                out.append(runs[cut[n]])
                n -= cut[n]
            return np.array(out[::-1], np.int32)
        parts, k = [1] * min(n, 4 * max(runs)), 0
        rest = n - len(parts)
        while True:  # a merge gives a pair further left its turn again
            while k + 1 < len(parts) and parts[k] + parts[k + 1] not in runs:
                k += 1
            if k + 1 >= len(parts):
                if not rest:
                    break
                k, more = max(0, k - 1), min(rest, max(runs))
                parts, rest = [*parts, *[1] * more], rest - more
                continue
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
            k = max(0, k - 1)
        return np.array([runs[x] for x in parts], np.int32)

    def decode(self, ids: np.ndarray, totals: np.ndarray) -> list[str]:
        """Texts of flat ids; bytes that aren't UTF-8 become U+FFFD, ids outside the vocabulary raise IndexError."""
        m = self.m
        if len(ids) and (ids.min() < 0 or ids.max() >= len(m.out_len)):
            raise IndexError("an id is outside the vocabulary")
        count = m.out_len[ids]
        ends = np.r_[0, np.cumsum(count)]
        flat = m.out_flat[np.arange(ends[-1]) + np.repeat(m.out_start[ids] - ends[:-1], count)].tobytes()
        at = ends[np.r_[0, np.cumsum(totals)]]
        return [flat[a + (flat[a : a + 1] == b" " and b > a) : b].decode("utf-8", "replace") for a, b in zip(at[:-1], at[1:])]


_encoders: dict[int, Encoder] = {}


def encoder(model: SentencePieceModel) -> Encoder:
    """This process's encoder for a model; models are told apart by their keys."""
    mark = hash((model.keys.tobytes(), model.bpe, model.score.tobytes()))
    if mark not in _encoders:
        _encoders.clear()
        _encoders[mark] = Encoder(model)
    return _encoders[mark]


def load_model(path: str) -> SentencePieceModel:
    with open(path, "rb") as f:
        return SentencePieceModel(f.read())


def encode(docs: DataFrame, model: SentencePieceModel, text: str = "text", check: bool = False, keep_text: bool = True) -> DataFrame:
    """docs with n_tokens (long) and token_ids (array of int) of each whole text; check adds round_trip: whether
    decoding the ids gives the text back. The plan is one narrow Arrow stage, without any shuffle."""
    outs = {"n_tokens": T.LongType(), "token_ids": T.ArrayType(T.IntegerType(), False)} | ({"round_trip": T.BooleanType()} if check else {})
    kept = [f for f in docs.schema.fields if f.name not in outs and (keep_text or f.name != text)]
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(shared.value)
        for batch in batches:
            texts = [t or "" for t in batch.column(batch.schema.get_field_index(text)).to_pylist()]
            for a, b in chunked(texts) if texts else []:
                ids, totals = enc.encode(texts[a:b])
                arrays = [batch.column(batch.schema.get_field_index(f.name)).slice(a, b - a) for f in kept]
                arrays += [pa.array(totals), pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(totals)].astype(np.int32)), pa.array(ids))]
                if check:
                    arrays.append(pa.array([x == y for x, y in zip(enc.decode(ids, totals), texts[a:b])]))
                yield pa.RecordBatch.from_arrays(arrays, [f.name for f in kept] + list(outs))

    schema = T.StructType(kept + [T.StructField(k, v) for k, v in outs.items()])
    return docs.select(*[f"`{c}`" for c in dict.fromkeys([f.name for f in kept] + [text])]).mapInArrow(run, schema)


def decode(docs: DataFrame, model: SentencePieceModel, ids: str = "token_ids", out: str = "decoded") -> DataFrame:
    """docs with the texts of the token lists in column out (null for a null list)."""
    kept = [f for f in docs.schema.fields if f.name != out]
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(shared.value)
        for batch in batches:
            lists = batch.column(batch.schema.get_field_index(ids)).to_pylist()
            totals = np.array([len(x or ()) for x in lists], np.int64)
            flat = np.fromiter(chain.from_iterable(x or () for x in lists), np.int64, int(totals.sum()))
            texts = [None if x is None else t for x, t in zip(lists, enc.decode(flat, totals))]
            arrays = [batch.column(batch.schema.get_field_index(f.name)) for f in kept] + [pa.array(texts, pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, [f.name for f in kept] + [out])

    return docs.mapInArrow(run, T.StructType([*kept, T.StructField(out, T.StringType())]))
