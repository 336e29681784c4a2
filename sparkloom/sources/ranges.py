"""Bytes at places of files, read inside tasks: one open of a file and one seek for each run of places that lie close
together. Paths are those that pyarrow opens: local ones, HDFS and object stores by URI."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes that are read at a time, and between two places that one read still spans.
BLOCK, GAP = 1 << 20, 1 << 18


def located(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path)


def listed(paths: list[str]) -> list[tuple[str, int]]:
    """(path, size) of files, and of the files below folders whose names begin neither with a dot nor an underscore."""
    found = []
    for path in paths:
        store, at = located(path)
        info = store.get_file_info(at)
        if info.type == fs.FileType.File:
            found.append((path, info.size))
        elif info.type == fs.FileType.Directory:
            below = store.get_file_info(fs.FileSelector(at, recursive=True))
            root = path.rstrip("/")
            shown = lambda p: not any(x[:1] in "._" for x in p.split("/"))
            names = sorted((i.path[len(at.rstrip("/")) + 1 :], i.size) for i in below if i.type == fs.FileType.File)
            found += [(f"{root}/{n}", size) for n, size in names if shown(n)]
        else:
            raise FileNotFoundError(path)
    return found


class Reader:
    """A file read at rising places. seeks and got: how often it was sought, and the bytes read."""

    def __init__(self, path: str):
        store, at = located(path)
        self.path, self.file, self.size = path, store.open_input_file(at), store.get_file_info(at).size
        self.start, self.held, self.seeks, self.got = 0, b"", 0, 0

    def _more(self, least: int = 0) -> bool:
        new = self.file.read(max(least, BLOCK))
        self.got += len(new)
        self.held += new
        return bool(new)

    def _go(self, offset: int) -> None:
        if not 0 <= offset < self.size:
            raise IndexError(f"{self.path}: {offset} is past the end ({self.size} bytes)")
        end = self.start + len(self.held)
        if not self.start <= offset <= end + GAP or not self.seeks:
            self.file.seek(offset)
            self.start, self.held, self.seeks = offset, b"", self.seeks + 1
        while self.start + len(self.held) < offset and self._more():
            pass
        self.held, self.start = self.held[offset - self.start :], offset

    def bytes_at(self, offset: int, length: int) -> bytes:
        if length:
            self._go(offset)
        while len(self.held) < length and self._more(length - len(self.held)):
            pass
        if len(self.held) < length:
            raise IndexError(f"{self.path}: {offset} + {length} is past the end ({self.size} bytes)")
        return self.held[:length]

    def line_at(self, offset: int) -> bytes:
        """What is before the next newline, or the end of the file."""
        self._go(offset)
        seen = 0
        while (end := self.held.find(b"\n", seen)) < 0:
            seen = len(self.held)
            if not self._more():
                return self.held
        return self.held[:end]


def _at(wanted: DataFrame, path: str, offset: str, out: T.StructField, take) -> DataFrame:
    """wanted with column out: take(reader, row number of the batch, columns, offset)."""
    schema = T.StructType([*(f for f in wanted.schema.fields if f.name != out.name), out])
    names = [f.name for f in schema.fields[:-1]]
    parts = int(wanted.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = wanted.repartitionByRange(parts, path, offset).sortWithinPartitions(path, offset)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = None
        for batch in batches:
            columns, found, size, begin = {n: batch.column(n) for n in batch.schema.names}, [], 0, 0
            paths, offsets = columns[path].to_pylist(), columns[offset].to_pylist()
            for i, (p, o) in enumerate(zip(paths, offsets)):
                if reader is None or reader.path != p:
                    reader = Reader(p)
                found.append(take(reader, i, columns, o))
                size += len(found[-1])
                if size >= 8 * BLOCK or i + 1 == len(paths):  # values of a bounded size at a time
                    rows = [columns[n].slice(begin, i + 1 - begin) for n in names]
                    yield pa.RecordBatch.from_arrays([*rows, pa.array(found, pa.string() if out.dataType == T.StringType() else pa.binary())], [*names, out.name])
                    found, size, begin = [], 0, i + 1

    return ordered.mapInArrow(run, schema)


def lines_at(wanted: DataFrame, path: str = "path", offset: str = "offset", out: str = "value") -> DataFrame:
    """wanted with the line that begins at each row's offset (bytes) of its file, a string; an offset past the end
    raises."""
    return _at(wanted, path, offset, T.StructField(out, T.StringType()), lambda reader, i, columns, o: reader.line_at(o).removesuffix(b"\r").decode())


def bytes_at(wanted: DataFrame, length: str, path: str = "path", offset: str = "offset", out: str = "value") -> DataFrame:
    """wanted with the bytes from each row's offset of its file, as many as column length says; fewer in the file raise."""
    return _at(wanted, path, offset, T.StructField(out, T.BinaryType()), lambda reader, i, columns, o: reader.bytes_at(o, columns[length][i].as_py()))


def numbers(raw: Column, kind: str) -> Column:
    """Bytes as an array of little-endian numbers: kind <u4 gives longs, <f4 floats."""
    from pyspark.sql.functions import pandas_udf

    to = {"<u4": ("array<long>", np.int64), "<f4": ("array<float>", np.float32)}[kind]

    @pandas_udf(to[0])
    def unpack(x):
        return x.map(lambda b: np.frombuffer(b, kind).astype(to[1]))

    return unpack(raw)


def packed(values: Column, kind: str) -> Column:
    """An array of numbers as little-endian bytes."""
    from pyspark.sql.functions import pandas_udf

    @pandas_udf("binary")
    def pack(x):
        return x.map(lambda v: np.asarray(v, kind).tobytes())

    return pack(values)
