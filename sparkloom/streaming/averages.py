"""Exponential averages by key as typed state, each row with the baseline that the rows before it give."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Groups of keys that share a call and a list of states: a call and a state of its own for each key cost more than the rows.
#: Part of the state's layout, so fixed.
BUCKETS = 1024
STATE = T.StructType([T.StructField("key", T.StringType()), T.StructField("shadow", T.DoubleType()), T.StructField("correction", T.DoubleType()), T.StructField("n", T.LongType())])


def decayed(values: np.ndarray, keep: float, start: float) -> np.ndarray:
    """The averages after each value: keep * the one before + (1 - keep) * value. In blocks in which powers of keep stay
    above 1e-8, so that sums of scaled values lose nothing."""
    if not keep:
        return values.astype(float)
    block, out = max(1, int(8 / -np.log10(keep))) if keep < 1 else len(values), []
    for i in range(0, len(values), max(block, 1)):
        v = values[i : i + block]
        power = keep ** np.arange(1, len(v) + 1)
        out.append(power * (start + (1 - keep) * np.cumsum(v / power)))
        start = float(out[-1][-1])
    return np.concatenate(out) if out else np.zeros(0)


class Averages(StatefulProcessor):
    """State of each key: the decayed sum, the decayed sum of weights that it is divided by, and the number of rows; a list
    of them for a bucket of keys. seeded: the first value counts as all that came before it."""

    def __init__(self, keep: float, order: str, value: str, seeded: bool):
        self.keep, self.order, self.value, self.seeded = keep, order, value, seeded

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getListState("averages", STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = {r[0]: tuple(r[1:]) for r in self.state.get()} if self.state.exists() else {}
        own = pd.concat(list(rows), ignore_index=True)  # a bucket's rows of one batch
        own.columns = ["_bucket", "_key", self.order, self.value]  # made columns come without their names
        codes, names = pd.factorize(own["_key"], use_na_sentinel=False)
        names = [None if pd.isna(x) else str(x) for x in names]
        at = np.lexsort((own[self.order].to_numpy(), codes))
        own, codes, v = own.iloc[at], codes[at], own[self.value].to_numpy(float)[at]
        starts = [0, *(np.flatnonzero(np.diff(codes)) + 1).tolist()]
        found = []
        for i, j in zip(starts, [*starts[1:], len(v)]):
            name = names[codes[i]]
            before, average, n, held[name] = self._key(v[i:j], *held.get(name, (0.0, 0.0, 0)))
            found.append((before, average, n))
        self.state.put([(k, *s) for k, s in held.items()])
        before, average, n = (np.concatenate(x) for x in zip(*found))
        baseline = pd.Series(before, dtype=object).where(~np.isnan(before), None)
        yield pd.DataFrame({"key": [str(names[c]) for c in codes], self.order: own[self.order].to_numpy(), "baseline": baseline, "average": average, "n": n})

    def _key(self, v: np.ndarray, shadow: float, correction: float, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, tuple[float, float, int]]:
        """Baselines, averages and numbers of a key's next rows, and its state after them."""
        if self.seeded and not n:
            shadow, correction = float(v[0]), 1.0
        sums = decayed(v, self.keep, shadow)
        weights = decayed(np.ones(len(v)), self.keep, correction)
        before = np.r_[shadow / correction if n else np.nan, sums[:-1] / weights[:-1]]
        return before, sums / weights, np.arange(n + 1, n + len(v) + 1), (float(sums[-1]), float(weights[-1]), int(n + len(v)))

    def close(self) -> None:
        pass


def running_averages(events: DataFrame, key: str, value: str, order: str, keep: float, seeded: bool = False) -> DataFrame:
    """A stream's rows with baseline (the bias-corrected average of the key's rows before; null if there are none), average
    (with the row) and n (rows so far): key, order, baseline, average, n. keep 0: the baseline is the row before, alone.

    Rows of a batch are taken in order; batches must follow each other in order. State is kept by RocksDB."""
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    out = T.StructType([T.StructField("key", T.StringType()), events.schema[order], T.StructField("baseline", T.DoubleType()), T.StructField("average", T.DoubleType()), T.StructField("n", T.LongType())])
    keyed = [F.pmod(F.xxhash64(key), F.lit(BUCKETS)).alias("_bucket"), F.col(key).cast("string").alias("_key")]
    slim = events.where(f"`{value}` is not null and not isnan(`{value}`)").select(*keyed, order, value)
    return slim.groupBy("_bucket").transformWithStateInPandas(Averages(keep, order, value, seeded), out, "Append", "None")
