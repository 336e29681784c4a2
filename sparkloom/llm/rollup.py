"""Token counts as delta-maintained rollups.

A rollup is a folder of batches. A batch holds signed totals by source, language and tokenizer version: inserts add a
document's count, deletes take it back, revisions take the old count back and add the new one. Totals are the sum of
all committed batches, so a batch costs its own rows only, and its rows are few: they are aggregated before they are
written, as one file.

Each attempt at a batch writes a folder of its own; the batch is committed by creating its mark, which names that
folder, and only one attempt can create it. So committing an id again changes nothing, attempts that were cut short or
came second count for nothing, and a lost executor only repeats its tasks. compact() replaces all batches so far by
their sum; their marks stay, so their ids stay taken.

Defined results: null sources, languages and versions are groups of their own; null texts count 0 tokens; repeated
rows count each; groups whose documents and tokens are both back at 0 are left out; an empty batch commits and adds
nothing; an id that comes back with other rows changes nothing, and raises ValueError if the commit is told to compare.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import numpy as np
import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import spm
from .common import SPACES, chunked, n_matches

KEYS = ("source", "lang", "tokenizer")
SCHEMA = "source string, lang string, tokenizer string, docs long, tokens long"
#: Counters by tokenizer version: a regular expression whose matches are tokens, and a class of all other characters.
VERSIONS = {
    "words-1": (r"[^\x20\x09-\x0D]++", SPACES),
    "runs-1": ("[A-Za-z0-9]++", "[^A-Za-z0-9]"),
    "runs-2": (r"[A-Za-z0-9]++|[^A-Za-z0-9\x20\x09-\x0D]++", SPACES),
}


def count_tokens(text: Column, version: str) -> Column:
    """Tokens of a text column under one of VERSIONS, as a long."""
    return n_matches(text, *VERSIONS[version])


def count_pieces(docs: DataFrame, model: spm.SentencePieceModel, text: str = "text", out: str = "n_pieces") -> DataFrame:
    """docs without the text, with the number of its tokens under a SentencePiece model in column out (long)."""
    kept = [f for f in docs.schema.fields if f.name not in (text, out)]
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = spm.encoder(shared.value)
        for batch in batches:
            texts = [t or "" for t in batch.column(batch.schema.get_field_index(text)).to_pylist()]
            counts = [enc.encode(texts[a:b])[1] for a, b in chunked(texts)] if texts else []
            total = pa.array(np.concatenate([np.zeros(0, np.int64), *counts]).astype(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(f.name)) for f in kept] + [total], [f.name for f in kept] + [out])

    return docs.mapInArrow(run, T.StructType([*kept, T.StructField(out, T.LongType())]))


def inserts(counted: DataFrame, tokenizer: str, tokens: str) -> DataFrame:
    """Deltas that add documents: counted has source, lang and the column tokens."""
    return counted.select("source", "lang", F.lit(tokenizer).alias("tokenizer"), F.lit(1).cast("long").alias("docs"), F.col(tokens).cast("long").alias("tokens"))


def deletes(counted: DataFrame, tokenizer: str, tokens: str) -> DataFrame:
    """Deltas that take documents back."""
    return inserts(counted, tokenizer, tokens).withColumns({"docs": -F.col("docs"), "tokens": -F.col("tokens")})


def revisions(counted: DataFrame, tokenizer: str, old: str, new: str) -> DataFrame:
    """Deltas that change counts and leave the number of documents."""
    return counted.select("source", "lang", F.lit(tokenizer).alias("tokenizer"), F.lit(0).cast("long").alias("docs"), (F.col(new) - F.col(old)).cast("long").alias("tokens"))


class TokenRollup:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._io = jvm.org.apache.commons.io.IOUtils
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._path(self.path).getFileSystem(conf)
        self._context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), conf)
        self._keep = spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)

    def _mark(self, name: str) -> str:
        return f"{self.path}/{name}.mark"

    def _read(self, mark: str) -> dict | None:
        """What a mark holds; None if it isn't there."""
        if not self._fs.exists(self._path(mark)):
            return None
        stream = self._fs.open(self._path(mark))
        try:
            return json.loads(self._io.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _create(self, mark: str, what: dict) -> bool:
        """Creates a mark, whole, by a rename that doesn't replace; False if another attempt has."""
        draft = f"{mark}.{uuid.uuid4().hex}"
        stream = self._fs.create(self._path(draft), False)
        stream.write(bytearray(json.dumps(what).encode()))
        stream.close()
        try:
            self._context.rename(self._path(draft), self._path(mark), self._keep)
        except Py4JJavaError:
            self._fs.delete(self._path(draft), False)
            if not self._fs.exists(self._path(mark)):
                raise
            return False
        return True

    def _store(self, rows: DataFrame) -> tuple[str, int]:
        """Writes rows, summed by key, to a new folder: its name, and a digest of the rows in any order."""
        folder = f"data-{uuid.uuid4().hex}"
        summed = rows.groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
        summed.write.parquet(f"{self.path}/{folder}")  # a row for each source, language and version
        written = self.spark.read.schema(SCHEMA).parquet(f"{self.path}/{folder}")
        return folder, written.agg(F.coalesce(F.bit_xor(F.xxhash64(*written.columns)), F.lit(0)).alias("x")).first().x

    def commit(self, batch_id: str, *deltas: DataFrame, compare: bool = False) -> bool:
        """Commits deltas as one batch. False if that batch is there already: without any work, or, with compare,
        after a check that it holds the same totals."""
        mark = self._mark(f"batch-{quote(batch_id, safe='')}")
        found = self._read(mark)
        if found and not compare:
            return False
        rows = deltas[0]
        for d in deltas[1:]:
            rows = rows.unionByName(d)
        folder, digest = self._store(rows)
        if not found and self._create(mark, {"data": folder, "digest": digest}):
            return True
        self._fs.delete(self._path(f"{self.path}/{folder}"), True)
        if compare and self._read(mark)["digest"] != digest:
            raise ValueError(f"batch {batch_id} was committed with other rows")
        return False

    def _marks(self, prefix: str) -> dict[str, dict]:
        if not self._fs.exists(self._path(self.path)):
            return {}
        names = sorted(s.getPath().getName() for s in self._fs.listStatus(self._path(self.path)))
        found = {n.removesuffix(".mark"): self._read(f"{self.path}/{n}") for n in names if n.startswith(prefix) and n.endswith(".mark")}
        return {n: m for n, m in found.items() if m is not None}

    def batches(self) -> list[str]:
        """Names of the committed batches."""
        return list(self._marks("batch-"))

    def _folders(self) -> tuple[list[str], list[str], int]:
        """Folders whose sum is the totals, the batches in them, and the number of the latest compaction."""
        bases, batches = self._marks("base-"), self._marks("batch-")
        latest = max(bases, default=None)
        base = bases.get(latest, {"data": None, "batches": []})
        new = [n for n in batches if n not in set(base["batches"])]
        return [f for f in [base["data"]] if f] + [batches[n]["data"] for n in new], [*base["batches"], *new], int(latest.split("-")[1]) if latest else 0

    def compact(self) -> bool:
        """Sums all batches so far into one folder, which totals() reads in their place; the next call deletes theirs.
        False if there was nothing to sum, or another compaction came first."""
        folders, names, number = self._folders()
        if len(folders) < 2:
            return False
        folder, _ = self._store(self._rows(folders))
        if not self._create(self._mark(f"base-{number + 1:012d}"), {"data": folder, "batches": names, "replaced": folders}):
            self._fs.delete(self._path(f"{self.path}/{folder}"), True)
            return False
        before = self._read(self._mark(f"base-{number:012d}")) if number else None
        for old in (before or {}).get("replaced", []):  # readers of the totals before the last have had their time
            self._fs.delete(self._path(f"{self.path}/{old}"), True)
        return True

    def _rows(self, folders: list[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], SCHEMA)
        return self.spark.read.schema(SCHEMA).parquet(*[f"{self.path}/{f}" for f in folders])

    def totals(self) -> DataFrame:
        rows = self._rows(self._folders()[0])
        return rows.groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).where("docs <> 0 or tokens <> 0")


ORACLE = r"""
WITH d AS (
  SELECT source, lang,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS words,
         len(regexp_extract_all(coalesce(text, ''), '[A-Za-z0-9]+|[^A-Za-z0-9\x20\x09-\x0D]+')) AS runs
  FROM documents
  WHERE doc_id IS NULL OR doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1 AND doc_id IS NOT NULL)),
u AS (SELECT source, lang, 'words-1' AS tokenizer, words AS n FROM d UNION ALL SELECT source, lang, 'runs', runs FROM d)
SELECT source, lang, tokenizer, CAST(count(*) AS BIGINT) AS docs, CAST(sum(n) AS BIGINT) AS tokens FROM u GROUP BY ALL
"""
