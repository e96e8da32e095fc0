"""What several operators share: the shared folder, materialised tables, components of a graph, word hashes."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or the session's checkpoint folder where that is unset.

    Without either, a local session (tests) gets a temporary one; on a cluster there is none that all machines see, so that is an error.
    """
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


#: Tables of a few numbers a row are broadcast up to so many rows; beyond that joins shuffle.
BROADCAST_ROWS = 500_000


#: Edges that one task takes at least before another is worth its start.
ROWS_A_TASK = 50_000


def small(df: DataFrame, most: int | None = None) -> DataFrame:
    """df, marked for broadcast if it was counted to have no more rows than the bound. df should be a written table, for it is read to be counted."""
    return F.broadcast(df) if df.count() <= (BROADCAST_ROWS if most is None else most) else df


#: Texts go to Python workers in batches of so many bytes at most, however long they are; a single longer text is a batch of its own.
BATCH_BYTES = 8 << 20


def bound_batches(spark: SparkSession) -> None:
    """Hold Arrow batches of this session to BATCH_BYTES: by default 10,000 rows or 64 MB go at once, several times that in a worker's memory."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.conf.get(key, "67108864").rstrip("b") or 0) > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def materialise(df: DataFrame, name: str = "t", light: bool = False) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: lineage ends there, and a lost executor costs nothing.

    light: rows of a few numbers after an aggregate; two tasks a core write them, however many partitions the shuffle has.
    """
    if light:
        df = df.coalesce(2 * max(1, df.sparkSession.sparkContext.defaultParallelism))
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, *order, name: str = "number") -> DataFrame:
    """df with its rows' places, from 0 without gaps, in the given order; df should be a written table, for the sort samples it first.

    A distributed sort deals the rows out by range and writes them with their task and their place in it; the places before each task are a running sum
    over one row per task. Rows that are equal in all of the order stand in any order among each other.
    """
    at = materialise(df.orderBy(*order).withColumn(f"{name}_at_", F.monotonically_increasing_id()), name)
    task, inside = F.shiftright(f"{name}_at_", 33), F.col(f"{name}_at_").bitwiseAND(F.lit((1 << 33) - 1))
    counts = at.groupBy(task.alias(f"{name}_task_")).agg(F.count("*").alias("rows"))
    before = F.sum("rows").over(Window.orderBy(f"{name}_task_").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select(f"{name}_task_", F.coalesce(before, F.lit(0)).alias(f"{name}_start_"))
    return at.join(F.broadcast(starts), task == starts[f"{name}_task_"]).select(*df.columns, (F.col(f"{name}_start_") + inside).alias(name))


def components(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """Connected components of edges (a long, b long): rows (id long, component long), component the smallest id reachable.

    Alternating large-star and small-star steps. Every step keeps one edge per node and neighbour at most, aggregates before it
    shuffles and writes its edges to the shared folder, so that no node's neighbours are ever gathered in one task.
    Empty edges give no rows; loops and repeated edges are harmless.
    """
    e = materialise(edges.select(F.col("a").cast("long"), F.col("b").cast("long")).filter("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges", light=True)
    n = e.count()  # no round has more edges, and there are no more nodes than twice that
    hint = F.broadcast if n <= BROADCAST_ROWS else lambda df: df
    for _ in range(rounds):
        if n <= BROADCAST_ROWS:  # a few edges aren't dealt out over many tasks
            e = e.coalesce(-(-max(1, n) // ROWS_A_TASK))
        both = e.select("u", "v").unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(hint(low), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v")
        low2 = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(hint(low2), "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))).alias("p")).select("p.*").filter("u != v")
        e = materialise(small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges", light=True)
        sides = e.select(F.col("u").alias("x"), F.lit(1).alias("leaf"), F.lit(0).alias("root")).unionAll(e.select(F.col("v").alias("x"), F.lit(0).alias("leaf"), F.lit(1).alias("root")))
        deep = sides.groupBy("x").agg(F.sum("leaf").alias("leaf"), F.max("root").alias("root")).filter("leaf > 1 or (leaf = 1 and root = 1)")
        if not deep.head(1):
            break  # every node points at one root and no root points on
    else:
        raise RuntimeError(f"components didn't settle in {rounds} rounds")
    return e.select(F.col("u").alias("id"), F.col("v").alias("component")).unionAll(e.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())


#: Long texts are split into words so many bytes at a time.
SLICE_BYTES = 4 << 20


def word_slices(raw: bytes | None, fold: bytes, step: int = SLICE_BYTES) -> Iterator[list[bytes]]:
    """The words of a UTF-8 text in order, as lists of those in about `step` bytes each; fold maps each byte to what stands for it, separators to blanks."""
    raw = (raw or b"").translate(fold)
    begin = 0
    while begin < len(raw):
        end = raw.find(b" ", begin + step)
        end = len(raw) if end < 0 else end
        yield raw[begin:end].split()
        begin = end


def byte_fold(kept: Callable[[int], bool]) -> bytes:
    """A table for word_slices: A-Z become a-z, bytes that aren't kept become blanks."""
    return bytes((b + 32 if 65 <= b <= 90 else b) if kept(b) else 32 for b in range(256))


#: Bytes of words: digits, letters and whatever isn't ASCII; A-Z are lower-cased, all else is 0.
_FOLD = bytes((b + 32 if 65 <= b <= 90 else b) if (48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b >= 128) else 0 for b in range(256))
_R = np.uint64(0x9E3779B97F4A7C15 | 1)
_POW: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers (multiply and xor-shift)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """r^0..r^n and their inverses modulo 2^64."""
    if len(_POW.get("p", ())) <= n:
        size = max(n + 1, 1 << 16)
        with np.errstate(over="ignore"):
            base = np.full(size, _R, np.uint64)
            base[0] = 1
            inverse = np.full(size, np.uint64(pow(int(_R), -1, 1 << 64)), np.uint64)
            inverse[0] = 1
            _POW["p"], _POW["q"] = np.multiply.accumulate(base), np.multiply.accumulate(inverse)
    return _POW["p"], _POW["q"]


def word_hashes(text: str | None) -> np.ndarray:
    """64-bit hashes of the words of a text, in order; words are runs of ASCII digits, letters (case folded) and non-ASCII characters."""
    raw = np.frombuffer((text or "").encode("utf-8", "surrogatepass").translate(_FOLD), np.uint8)
    if not len(raw):
        return np.empty(0, np.uint64)
    inside = raw != 0
    edge = np.flatnonzero(np.diff(np.concatenate(([False], inside, [False])).astype(np.int8)))
    start, end = edge[0::2], edge[1::2]
    p, q = _powers(len(raw))
    total = np.concatenate(([np.uint64(0)], np.cumsum(raw * p[: len(raw)], dtype=np.uint64)))
    return mix((total[end] - total[start]) * q[start] + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def shingle_hashes(words: np.ndarray, k: int = 5) -> np.ndarray:
    """64-bit hashes of all runs of k words, in order; a text of fewer words, but not none, is one shingle."""
    n = len(words)
    if n == 0:
        return words
    k = min(k, n)
    out = np.full(n - k + 1, np.uint64(k), np.uint64)
    for i in range(k):
        out = out * np.uint64(0x9FB21C651E98DF25) + words[i : n - k + 1 + i]
    return mix(out)
