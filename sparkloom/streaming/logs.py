"""Incremental processing: polling result files, idempotent logs, ordered state."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def poll_results(spark: SparkSession, folder: str, schema: str, labels: list[str], out: str, checkpoint: str) -> StreamingQuery:
    """Logs each step of a folder of JSON result files once: complete payloads only, the first file of a step wins.
    Runs over what is there and stops."""
    stream = spark.readStream.schema(schema).json(folder).select("*", F.struct("_metadata.file_modification_time", "_metadata.file_path").alias("_file"))
    full = stream.where(F.size(F.array_intersect(F.map_keys("values"), F.array(*[F.lit(x) for x in labels]))) == len(labels))

    def append(batch: DataFrame, _: int) -> None:
        first = batch.groupBy("step").agg(F.min_by(F.struct(*[c for c in batch.columns if c != "_file"]), "_file").alias("r")).select("r.*")
        append_new_steps(batch.sparkSession, first, out, ["step"])

    return full.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _commits(spark: SparkSession, out: str) -> list[str]:
    """Folders of the batches that a log holds, in order."""
    from sparkloom.sources.writers import _fs, exists, read_json

    if not exists(spark, f"{out}/log"):
        return []
    fs, folder = _fs(spark, f"{out}/log")
    names = sorted(s.getPath().getName() for s in fs.listStatus(folder) if s.getPath().getName().endswith(".json"))
    return [read_json(spark, f"{out}/log/{n}")["data"] for n in names]


def append_new_steps(spark: SparkSession, batch: DataFrame, out: str, keys: list[str]) -> None:
    """Appends rows whose keys aren't in the log yet; running it again changes nothing.

    A batch is written apart and counts once a numbered file names it. Such a file is made only if it isn't there, so of
    two writers one gets the number; the other looks again at what is new and takes the next."""
    from sparkloom.sources.writers import create_json
    from sparkloom.staging import discard

    first = batch.dropDuplicates(keys)
    while True:
        before = _commits(spark, out)
        new = first
        if before:
            new = first.join(spark.read.schema(batch.schema).parquet(*[f"{out}/data/{b}" for b in before]).select(*keys), keys, "left_anti").select(*batch.columns)
        name = uuid.uuid4().hex
        new.write.parquet(f"{out}/data/{name}")
        if create_json(spark, f"{out}/log/{len(before):08d}.json", {"data": name}):
            return
        discard(spark, f"{out}/data/{name}")


def read_steps(spark: SparkSession, out: str, schema) -> DataFrame:
    """What append_new_steps has added."""
    held = _commits(spark, out)
    return spark.read.schema(schema).parquet(*[f"{out}/data/{b}" for b in held]) if held else spark.createDataFrame([], schema)


def upsert_steps(batch: DataFrame, path: str, keys: list[str]) -> None:
    """A table keyed by step whose rows a batch replaces or adds to. Each version is a folder of its own; a small file
    names the latest, and is replaced whole, so a cut run leaves the version before. The batch has each key once."""
    from sparkloom.sources.writers import read_json, write_json

    spark = batch.sparkSession
    now = read_json(spark, f"{path}/latest.json")
    if now:
        old = spark.read.schema(batch.schema).parquet(f"{path}/{now['version']:08d}")
        batch = old.join(batch.select(*keys), keys, "left_anti").select(*batch.columns).unionByName(batch)
    new = now["version"] + 1 if now else 1
    batch.write.mode("overwrite").parquet(f"{path}/{new:08d}")
    write_json(spark, f"{path}/latest.json", {"version": new})


def latest_steps(spark: SparkSession, path: str, schema) -> DataFrame:
    from sparkloom.sources.writers import read_json

    now = read_json(spark, f"{path}/latest.json")
    return spark.read.schema(schema).parquet(f"{path}/{now['version']:08d}") if now else spark.createDataFrame([], schema)


def weight_trajectory(updates: DataFrame, start: dict[str, float], eta: float) -> DataFrame:
    """Multiplicative weights carried from step to step: updates (step, domain, pull) -> (step, domain, p_after).

    p_n is proportional to p_0 * exp(eta * sum of pulls so far), so an ordered running sum gives every state."""
    from pyspark.sql import Window as W

    p0 = F.create_map(*[x for k, v in start.items() for x in (F.lit(k), F.lit(float(v)))])
    total = F.sum("pull").over(W.partitionBy("domain").orderBy("step").rowsBetween(W.unboundedPreceding, 0))
    d = updates.withColumn("_x", F.ln(F.element_at(p0, F.col("domain"))) + eta * total)
    by_step = W.partitionBy("step")
    d = d.withColumn("_w", F.exp(F.col("_x") - F.max("_x").over(by_step)))
    return d.select("step", "domain", (F.col("_w") / F.sum("_w").over(by_step)).alias("p_after"))


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """An extension for event streams: counts and sums by event-time window and type, with a watermark when streaming."""
    df = events.withWatermark("ts", late) if events.isStreaming else events
    return df.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("window_start"), "event_type", "n", "total")
