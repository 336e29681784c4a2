"""Results that are kept in the folder which driver and executors share, and names that don't clash."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; only a local session without the setting gets a folder of its own."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or sc._jsc.sc().getCheckpointDir().getOrElse(None)
    if found is None:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="checkpoints-"))
        found = sc._jsc.sc().getCheckpointDir().get()
    return found


def checkpoint(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the shared folder: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    base = shared_dir(spark)
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(base)
    # a checkpointed plan keeps its constraints, and self-joins of such plans can fail in the optimiser
    key = "spark.sql.constraintPropagation.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "false")
    try:
        return df.checkpoint(eager=True)
    finally:
        spark.conf.set(key, before)


def scratch(spark: SparkSession, what: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"


#: Tables estimated below this many bytes may be fewer units of work than there are cores.
SMALL = 64 << 20


def balanced(df: DataFrame) -> DataFrame:
    """df, dealt anew if it is small and in fewer parts than there are cores: a small table may come as one unit that tasks
    can't share, such as a Parquet file of one row group. Others are left as they are, and the rows are the same."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size < SMALL and df.rdd.getNumPartitions() < cores else df


#: Most rows of a table that every row of another meets.
FEW = 100_000


def with_each(df: DataFrame, few: DataFrame, most: int = FEW) -> DataFrame:
    """Each row of df beside each of few, which is counted and then sent to all tasks; more than `most` rows raise: a table
    that grows with the data isn't met whole."""
    if few.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} rows would meet every row of another table")
    return df.crossJoin(F.broadcast(few))


def discard(spark: SparkSession, path: str) -> None:
    """Deletes what is no longer read below a path in the shared folder."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def free_name(df: DataFrame, name: str) -> str:
    """name, or name with underscores before it until no column of df has it (names are compared without case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name
