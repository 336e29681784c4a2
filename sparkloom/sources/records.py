"""Headerless files of fixed-size records, as a splittable data source: each task reads a range of whole records, and
filters on the record number or the file narrow the ranges before anything is read.

    spark.read.format("fixed_records").option("kind", "<u4").option("width", 2048).load(folder).where("record >= 100")
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from .ranges import listed, located

#: Bytes of a split, and bytes that are unpacked at a time, unless options say otherwise.
SPLIT, UNPACKED = 64 << 20, 4 << 20
#: Splits that get a task of their own. Of more, neighbours share a task, up to SPLIT bytes (or a split, if that is more).
TASKS = 1000
#: Kinds of numbers, their bytes and the type they are read as.
KINDS = {"<u4": (4, "bigint", np.int64, pa.int64()), "<f4": (4, "float", np.float32, pa.float32())}
LAST = (1 << 63) - 1
PUSHDOWN = "spark.sql.python.filterPushdown.enabled"


@dataclass
class Span(InputPartition):
    """Records first to last (exclusive) of a file, and how many numbers the file's last record has."""

    path: str
    first: int
    last: int
    tail: int
    tail_at: int


@dataclass
class Spans(InputPartition):
    """What one task reads."""

    held: list[Span]


class FixedRecords(DataSource):
    """Options: kind (<u4 or <f4), width (numbers of a record), split (bytes), tail: what to do with numbers after the last
    whole record: raise, drop them, or keep them as a shorter record. Files of broken numbers raise."""

    @classmethod
    def name(cls) -> str:
        return "fixed_records"

    def schema(self) -> str:
        return f"path string, record bigint, numbers array<{KINDS[self.options.get('kind', '<u4')][1]}>"

    def reader(self, schema) -> DataSourceReader:
        return RecordReader(dict(self.options))


class RecordReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.paths = json.loads(options["paths"]) if "paths" in options else [options["path"]]
        self.kind, self.width, self.split = options.get("kind", "<u4"), int(options.get("width", 1)), int(options.get("split", SPLIT))
        self.tail = options.get("tail", "raise")
        if self.tail not in ("raise", "drop", "keep") or self.width < 1:
            raise ValueError("tail is raise, drop or keep, and width 1 or more")
        self.first, self.last, self.files = 0, LAST, None

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Ranges of record numbers and lists of files are handled here whole; other filters go back."""
        for f in filters:
            whole = isinstance(getattr(f, "value", None), int)
            if f.attribute == ("record",) and isinstance(f, (GreaterThan, GreaterThanOrEqual)) and whole:
                self.first = max(self.first, f.value + isinstance(f, GreaterThan))
            elif f.attribute == ("record",) and isinstance(f, (LessThan, LessThanOrEqual)) and whole:
                self.last = min(self.last, f.value + isinstance(f, LessThanOrEqual))
            elif f.attribute == ("record",) and isinstance(f, EqualTo) and whole:
                self.first, self.last = max(self.first, f.value), min(self.last, f.value + 1)
            elif f.attribute == ("path",) and isinstance(f, (EqualTo, In)):
                names = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.files = names if self.files is None else self.files & names
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        size, out = KINDS[self.kind][0], []
        for path, n in listed(self.paths):
            if n % size or (self.tail == "raise" and n % (size * self.width)):
                raise ValueError(f"{path} isn't whole records of {self.width} numbers")
            whole, tail = divmod(n // size, self.width)
            last, step = min(self.last, whole + (tail > 0 and self.tail == "keep")), max(1, self.split // (size * self.width))
            if self.files is None or path in self.files:
                out += [Span(path, a, min(a + step, last), tail, whole) for a in range(max(0, self.first), last, step)]
        return self._shared(out) or [Span("", 0, 0, 0, 0)]

    def _shared(self, spans: list[Span]) -> list[InputPartition]:
        """Splits dealt to tasks: each its own up to TASKS of them, else runs of neighbours, joined within a file."""
        if len(spans) <= TASKS:
            return spans
        each, most = -(-len(spans) // TASKS), max(SPLIT, self.split) // (KINDS[self.kind][0] * self.width)
        out, n, records = [], each, 0
        for s in spans:
            if n >= each or records + s.last - s.first > most:
                out.append(Spans([]))
                n, records = 0, 0
            held = out[-1].held
            if held and held[-1].path == s.path and held[-1].last == s.first:
                held[-1].last = s.last
            else:
                held.append(s)
            n, records = n + 1, records + s.last - s.first
        return out

    def read(self, part: InputPartition) -> Iterator[pa.RecordBatch]:
        for span in part.held if isinstance(part, Spans) else [part]:
            yield from self._span(span)

    def _span(self, span: Span) -> Iterator[pa.RecordBatch]:
        size, _, to, arrow = KINDS[self.kind]
        if span.first >= span.last:
            return
        store, at = located(span.path)
        with store.open_input_file(at) as file:
            file.seek(span.first * size * self.width)
            step = max(1, UNPACKED // (size * self.width))
            for first in range(span.first, span.last, step):
                last = min(first + step, span.last)
                lengths = np.full(last - first, self.width)
                if last > span.tail_at:
                    lengths[-1] = span.tail
                raw = file.read(int(lengths.sum()) * size)
                if len(raw) != lengths.sum() * size:
                    raise ValueError(f"{span.path} ends before record {last}")
                values = pa.array(np.frombuffer(raw, self.kind).astype(to), arrow)
                numbers = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(lengths)].astype(np.int32)), values)
                yield pa.RecordBatch.from_arrays([pa.array([span.path] * (last - first)), pa.array(np.arange(first, last)), numbers], ["path", "record", "numbers"])


def read_records(spark: SparkSession, paths: str | list[str], kind: str, width: int, tail: str = "raise", **options) -> DataFrame:
    """(path, record, numbers) of files or folders. Filters on record and path narrow what is read; for that the session's
    spark.sql.python.filterPushdown.enabled is set, without which Spark turns down sources that take filters."""
    spark.dataSource.register(FixedRecords)
    spark.conf.set(PUSHDOWN, "true")
    reader = spark.read.format("fixed_records").options(kind=kind, width=width, tail=tail, **options)
    return reader.option("paths", json.dumps([paths] if isinstance(paths, str) else paths)).load()


def chunk_places(wanted: DataFrame, shards: DataFrame, width: int, by: str = "domain", numbers: str = "tokens", bytes_each: int = 4) -> DataFrame:
    """wanted (by, chunk, ...) with path, offset and length, in bytes, of each chunk of `width` numbers: chunks are counted
    through a group's shards (by, path, numbers) in order of their paths, and a shard's rest is in none. A chunk past the
    end raises."""
    from sparkloom.operators.relational import point_in_interval
    from sparkloom.operators.running import running_totals

    whole = shards.select(by, "path", F.floor(F.col(numbers) / width).cast("long").alias("_n"))
    ends = running_totals(whole, {"end": F.col("_n")}, ["path"], [by]).withColumn("start", F.col("end") - F.col("_n"))
    mean = ends.agg(F.max("_n")).first()[0] or 1
    found = point_in_interval(wanted, ends.select(by, "path", "start", "end"), by, "chunk", int(mean))
    lost = wanted.join(found.select(by, "chunk"), [by, "chunk"], "left_anti").select(by, "chunk").limit(1).collect()
    if lost:
        raise IndexError(f"chunk {lost[0][1]} of {lost[0][0]} is past the end")
    size = width * bytes_each
    return found.withColumns({"offset": (F.col("chunk") - F.col("start")) * size, "length": F.lit(size).cast("long")}).drop("start", "end")
