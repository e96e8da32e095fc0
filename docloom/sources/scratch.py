"""Intermediate tables in the folder that the driver and all executors share: they end a plan's lineage, and a lost executor costs nothing of them."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or the session's checkpoint folder. Without either, a local session gets a temporary folder; on a cluster that is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        known = spark.sparkContext._jsc.sc().getCheckpointDir()
        if known.isDefined():
            return known.get()
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="docloom-")
        spark.sparkContext.setCheckpointDir(found)
    return found


def written(df: DataFrame, name: str = "table") -> DataFrame:
    """df written as Parquet in the shared folder and read again."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def at_most(spark: SparkSession, key: str, most: int, default: int) -> Iterator[None]:
    """Hold a setting of the session to a bound for what is run inside; afterwards it is what it was."""
    old = spark.conf.get(key, None)
    if int(old or default) <= most:
        yield
        return
    spark.conf.set(key, str(most))
    try:
        yield
    finally:
        if old is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, old)


def spread(df: DataFrame) -> DataFrame:
    """df, dealt out anew if it comes in fewer partitions than there are cores: a small file of few row groups, so little is moved. Others stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def parts(spark: SparkSession) -> int:
    """How many parts rows that cost much each are dealt out into: several a core, however few bytes they are (the engine would put small parts together)."""
    return 4 * spark.sparkContext.defaultParallelism
