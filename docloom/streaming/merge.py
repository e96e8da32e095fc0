"""An append log of which the latest row of each key wins, kept by a stream whose batches can be replayed."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.utils import AnalysisException

from docloom.operators.keyed import latest

_LEDGER = "kind string, batch long"


def ledger(spark: SparkSession, path: str) -> DataFrame:
    """Rows (kind, batch) of what is done: each batch of the stream, and each base that holds all up to a batch. None where nothing is yet."""
    try:
        return spark.read.schema(_LEDGER).json(f"{path}/ledger/*")
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], _LEDGER)


def _done(spark: SparkSession, path: str) -> tuple[int | None, list[int]]:
    """The last base, and the batches after it. Compaction keeps these few; the driver needs their numbers, not their rows."""
    rows = ledger(spark, path).distinct().collect()
    base = max((r.batch for r in rows if r.kind == "base"), default=None)
    return base, sorted(r.batch for r in rows if r.kind == "batch" and (base is None or r.batch > base))


def _note(spark: SparkSession, path: str, kind: str, batch: int) -> None:
    spark.createDataFrame([(kind, batch)], _LEDGER).coalesce(1).write.mode("overwrite").json(f"{path}/ledger/{kind}-{batch:012d}")


def merge_batch(rows: DataFrame, batch: int, path: str, keys: Sequence[str], order: Sequence[str]) -> bool:
    """Put one batch into the log; False if the ledger has it, and then nothing is written.

    A batch is reduced to the latest row of each key and written to a folder of its own; the ledger's entry follows. A batch that broke off between the two isn't read by anyone,
    and its replay writes the same folder over: so every batch counts once, however often it is sent.
    """
    spark = rows.sparkSession
    base, later = _done(spark, path)
    if batch in later or (base is not None and batch <= base):
        return False
    latest(rows, keys, order).write.mode("overwrite").parquet(f"{path}/rows/batch-{batch:012d}")
    _note(spark, path, "batch", batch)
    return True


def current(spark: SparkSession, path: str, keys: Sequence[str], order: Sequence[str], schema: str) -> DataFrame:
    """The latest row of each key over all batches in the ledger, in whatever order they came."""
    base, later = _done(spark, path)
    folders = ([] if base is None else [f"{path}/base/upto-{base:012d}"]) + [f"{path}/rows/batch-{b:012d}" for b in later]
    return latest(spark.read.schema(schema).parquet(*folders), keys, order) if folders else spark.createDataFrame([], schema)


def compact(spark: SparkSession, path: str, keys: Sequence[str], order: Sequence[str], schema: str) -> None:
    """Write the current rows as a new base, so that readers open one folder and the batches after it. Breaking off leaves the old state in force."""
    _, later = _done(spark, path)
    if later:
        current(spark, path, keys, order, schema).write.mode("overwrite").parquet(f"{path}/base/upto-{later[-1]:012d}")
        _note(spark, path, "base", later[-1])


def keep_latest(stream: DataFrame, path: str, checkpoint: str, keys: Sequence[str], order: Sequence[str], every: int = 50) -> None:
    """Work off a stream into the log and stop; compacts after every so many batches. A restart goes on from the checkpoint, a replayed batch changes nothing."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in stream.schema)

    def step(rows: DataFrame, batch: int) -> None:
        if merge_batch(rows, batch, path, keys, order) and batch % every == every - 1:
            compact(rows.sparkSession, path, keys, order, schema)

    stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
