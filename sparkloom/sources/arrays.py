"""Files that are one JSON array, read by many tasks.

A file's bytes are cut anywhere. What a piece does to a reader is a small table: for each state it may begin in (outside
strings, in one, after a backslash in one) the state it ends in, how much deeper it ends, and how many borders of elements
it has at the least depth of any. Such tables compose, so one pass over all pieces at once and a fold over the tables of
a file give the state, the depth and the number of elements before each piece. Each task then cuts its piece at the
borders (the opening bracket and the commas at depth 1) and reads on to the end of the last element that begins in it.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.staging import checkpoint

from .ranges import listed, located

#: Bytes of a piece, bytes that are looked at together, and those that are at a time past a piece's end.
PIECE, LOOK, AHEAD = 64 << 20, 1 << 20, 1 << 16
OUTSIDE, INSIDE, ESCAPED = 0, 1, 2
NOWHERE = 1 << 40
_DEEPER = np.zeros(256, np.int8)
_DEEPER[list(b"[{")], _DEEPER[list(b"]}")] = 1, -1
_MARK = _DEEPER != 0
_MARK[ord(",")] = True


class Effect(NamedTuple):
    end: int
    deeper: int
    least: int
    borders: int

    def then(self, other: Effect) -> Effect:
        later = other.least + self.deeper if other.borders else NOWHERE
        least = min(self.least, later)
        return Effect(other.end, self.deeper + other.deeper, least, self.borders * (self.least == least) + other.borders * (later == least))


NOTHING = tuple(Effect(s, 0, NOWHERE, 0) for s in (OUTSIDE, INSIDE, ESCAPED))


def marks(data: bytes, state: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Places of brackets, braces and commas outside strings, how much deeper the text is after each, and the last state."""
    a, skip = np.frombuffer(data, np.uint8), 0
    if state == ESCAPED and len(a):
        a, skip, state = a[1:], 1, INSIDE
    quote, end = np.flatnonzero(a == ord('"')), state
    back = np.flatnonzero(a == ord("\\"))
    if len(back):  # a quote after an odd run of backslashes ends no string, nor does it begin one
        first = np.r_[True, np.diff(back) != 1]
        start = back[first]
        length = np.diff(np.r_[np.flatnonzero(first), len(back)])
        quote = np.setdiff1d(quote, (start + length)[length % 2 == 1], assume_unique=True)
        loose = length[-1] % 2 == 1 and back[-1] == len(a) - 1
    end = (state + len(quote)) % 2
    if len(back) and loose and end == INSIDE:
        end = ESCAPED
    at = np.flatnonzero(_MARK[a])
    at = at[(np.searchsorted(quote, at) + state) % 2 == OUTSIDE]
    return at + skip, np.cumsum(_DEEPER[a[at]], dtype=np.int64), end


def effect(data: bytes, state: int) -> Effect:
    at, depth, end = marks(data, state)
    chars = np.frombuffer(data, np.uint8)[at]
    border = depth[(chars == ord(",")) | (_DEEPER[chars] > 0)]
    least = int(border.min()) if len(border) else NOWHERE
    return Effect(end, int(depth[-1]) if len(depth) else 0, least, int((border == least).sum()))


def effects(blocks: Iterator[bytes]) -> list[Effect]:
    """What a piece does from each state."""
    total = list(NOTHING)
    for data in blocks:
        own = [effect(data, s) for s in (OUTSIDE, INSIDE, ESCAPED)]
        total = [t.then(own[t.end]) for t in total]
    return total


def placed(pieces: pd.DataFrame) -> pd.DataFrame:
    """The pieces of a file with the state, the depth and the number of elements before each."""
    state, depth, first, rows = OUTSIDE, 0, 0, []
    pieces = pieces.sort_values("start")
    for path, start, size, table in zip(pieces.path, pieces.start, pieces["size"], pieces.effects):
        own = Effect(*(int(x) for x in table[state * 4 : state * 4 + 4]))
        n = own.borders if own.least + depth == 1 else 0
        if own.least + depth < 1 or (n and first and not depth):
            raise ValueError(f"{path}: not one JSON array")
        rows.append((path, start, size, state, depth, first))
        state, depth, first = own.end, depth + own.deeper, first + n
    if state != OUTSIDE or depth or not first:
        raise ValueError(f"{path}: unterminated, or no JSON array")
    return pd.DataFrame(rows, columns=["path", "start", "size", "state", "depth", "first"])


def _read(path: str, start: int, size: int | None = None, look: int = LOOK) -> Iterator[bytes]:
    store, at = located(path)
    with store.open_input_file(at) as file:
        file.seek(start)
        while size is None or size > 0:
            data = file.read(look if size is None else min(look, size))
            if not data:
                return
            size = None if size is None else size - len(data)
            yield data


def elements(path: str, start: int, size: int, state: int, depth: int) -> Iterator[bytes]:
    """The elements that begin in a piece, whole."""
    held: list[bytes] | None = None
    if start == 0 and not next(_read(path, 0)).removeprefix(b"\xef\xbb\xbf").lstrip().startswith(b"["):
        raise ValueError(f"{path}: not a JSON array")
    place, end = start, start + size
    for data in chain(_read(path, start, size), _read(path, end, look=AHEAD)):
        at, deeper, after = marks(data, state)
        chars, deeper = np.frombuffer(data, np.uint8)[at], deeper + depth
        last = 0
        for i in np.flatnonzero(((chars == ord(",")) & (deeper == 1)) | ((_DEEPER[chars] > 0) & (deeper == 1)) | ((_DEEPER[chars] < 0) & (deeper == 0))):
            b = int(at[i])
            if held is not None:
                yield b"".join([*held, data[last:b]])
                held = None
            if place + b >= end:
                return
            if deeper[i] == 1:
                held, last = [], b + 1
        if held is not None:
            held.append(data[last:])
        place, state = place + len(data), after
        depth = int(deeper[-1]) if len(deeper) else depth
        if place >= end and held is None:
            return
    if held is not None:
        raise ValueError(f"{path}: unterminated array")


def read_array(spark: SparkSession, paths: str | list[str], piece: int = PIECE) -> DataFrame:
    """(path, row, value): the elements of files that are one JSON array each, as JSON strings, with their index in the
    file. Files are read by as many tasks as they have pieces; an element is held by one task. What isn't one array
    raises; an empty one has no rows."""
    files = [(p, a, min(piece, n - a)) for p, n in listed([paths] if isinstance(paths, str) else paths) for a in range(0, max(n, 1), piece)]
    cut = spark.createDataFrame(files, "path string, start long, size long").repartition(max(1, min(len(files), 10_000)))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start, size in zip(*(c.to_pylist() for c in batch.columns)):
                found = [x for e in effects(_read(path, start, size)) for x in e]
                yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([start]), pa.array([size]), pa.array([found], pa.list_(pa.int64()))], ["path", "start", "size", "effects"])

    def cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start, size, state, depth, first in zip(*(c.to_pylist() for c in batch.columns)):
                values, held = [], 0
                for i, raw in enumerate(elements(path, start, size, state, depth)):
                    value = raw.strip()
                    if value:
                        values.append(value.decode())
                    elif first + i:
                        raise ValueError(f"{path}: element {first + i} is empty")
                    held += len(value)
                    if held >= LOOK:
                        yield _rows(path, first + i + 1 - len(values), values)
                        values, held = [], 0
                if values:
                    yield _rows(path, first + i + 1 - len(values), values)

    found = cut.mapInArrow(look, "path string, start long, size long, effects array<long>")
    known = found.groupBy("path").applyInPandas(placed, "path string, start long, size long, state int, depth long, first long")  # a row a piece
    known = checkpoint(known).repartition(max(1, min(len(files), 10_000)))
    return known.mapInArrow(cut_out, "path string, row long, value string")


def _rows(path: str, first: int, values: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([path] * len(values)), pa.array(range(first, first + len(values)), pa.int64()), pa.array(values, pa.string())], ["path", "row", "value"])


def parsed(rows: DataFrame, schema: str) -> DataFrame:
    """Rows of read_array with the fields of their elements in place of the text; one that doesn't fit raises."""
    return rows.select("path", "row", F.from_json("value", schema, {"mode": "FAILFAST"}).alias("r")).select("path", "row", "r.*")
