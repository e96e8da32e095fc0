"""Sharding by best-fit-decreasing bin packing: indivisible groups, shards of a fixed capacity."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, numbered, small

#: Bytes that a document counts for beside its text.
ROW_BYTES = 16
#: Group sizes keep so many binary digits and are rounded up behind them, so that there are never more than 2^SIZE_BITS sizes an octave, however many groups.
SIZE_BITS = 13
#: Groups of more rows than HOT_LEAST and than the rows' number over HOT_SHARE get their shard by broadcast: no more than HOT_SHARE groups.
HOT_LEAST, HOT_SHARE = 500, 20_000
#: The smallest capacity is narrowed down to this part of itself.
NARROW = 1e-5


class FreeSpace:
    """Bins by remaining capacity in a balanced tree of two levels: sorted leaves of bounded length under a sorted list of their largest entries."""

    def __init__(self, leaf: int = 256):
        self.leaf, self.leaves, self.tops = leaf, [], []

    def add(self, free: int, number: int) -> None:
        at = min(bisect_left(self.tops, (free, number)), len(self.leaves) - 1)
        if at < 0:
            self.leaves, self.tops = [[(free, number)]], [(free, number)]
            return
        found = self.leaves[at]
        insort(found, (free, number))
        if len(found) > self.leaf:
            half = len(found) // 2
            self.leaves[at : at + 1] = [found[:half], found[half:]]
            self.tops[at : at + 1] = [found[half - 1], found[-1]]
        else:
            self.tops[at] = found[-1]

    def take(self, size: int) -> tuple[int, int] | None:
        """The tightest bin with room for size, taken out of the tree; None if there is none. Of equal ones the first opened."""
        at = bisect_left(self.tops, (size, -1))
        if at == len(self.leaves):
            return None
        found = self.leaves[at]
        got = found.pop(bisect_left(found, (size, -1)))
        if found:
            self.tops[at] = found[-1]
        else:
            del self.leaves[at], self.tops[at]
        return got


def best_fit(classes: Sequence[tuple[int, int]], capacity: int, most: int | None = None) -> list[tuple[int, int, int]] | None:
    """Runs (size, groups, bin) of best-fit-decreasing for classes (size, groups) by falling size; None if it takes more than `most` bins.

    Groups of one size are alike, and the tightest bin that took one of them is still the tightest for the next, until it has no room for it: so they are
    placed a run at a time, which gives exactly what placing them one by one gives. A group above the capacity has a bin to itself.
    """
    free, runs, opened = FreeSpace(), [], 0
    for size, left in classes:
        while left:
            room, number = free.take(size) or (capacity, opened)
            opened = max(opened, number + 1)
            if most is not None and opened > most:
                return None
            n = max(1, min(left, room // size))
            runs.append((size, n, number))
            left -= n
            if room > n * size:
                free.add(room - n * size, number)
    return runs


def evenest(classes: Sequence[tuple[int, int]], shards: int) -> list[tuple[int, int, int]]:
    """best_fit at the smallest capacity found by bisection at which no more than `shards` bins are taken."""
    left, bins, alone = sum(s * n for s, n in classes), shards, 0
    for size, n in classes:  # groups above the mean of the rest are alone, whatever the capacity
        for _ in range(n):
            if bins <= 1 or size * bins < left:
                break
            left, bins, alone = left - size, bins - 1, alone + 1
        else:
            continue
        break
    low = max(1, -(-left // bins))
    best, high = best_fit(classes, low, shards), low
    while best is None:
        low, high = high + 1, 2 * high
        best = best_fit(classes, high, shards)
    while high - low > NARROW * low:
        middle = (low + high) // 2
        if found := best_fit(classes, middle, shards):
            best, high = found, middle
        else:
            low = middle + 1
    return best


def shard(docs: DataFrame, shards: int | None = None, capacity: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, size, text_crc32, shard, slot), one for each row of docs; size is the text's bytes plus ROW_BYTES.

    Groups are the rows with equal texts (null counts as empty) and stay together. capacity: bytes of a shard, of which as few are filled as best-fit-decreasing
    finds; shards: instead, the number of shards, at the smallest capacity that needs no more. A group larger than the capacity fills a shard of its own.
    slot counts the rows of a shard from 0 without gaps.

    Rows are reduced to groups before they are shuffled. Only the histogram of group sizes (SIZE_BITS) comes to the driver, which packs it; groups are
    then sorted by size, and their places in that order give their bins. Groups that many rows share come back to them by broadcast (at most HOT_SHARE groups), the others by a
    join; rows are numbered by a sort on (shard, row), which no hot shard or text can make uneven. Texts of any length count as they are; repeated and null
    ids are rows of their own; an empty table gives no rows; further columns are left behind, whatever their names. Two texts of one 64-bit hash would share a shard.
    """
    if (shards is None) == (capacity is None) or (capacity if shards is None else shards) < 1:
        raise ValueError("give a positive number of shards or a positive capacity")
    text = F.coalesce(docs[text_col], F.lit(""))
    rows = docs.select(docs[id_col].alias("id"), (F.octet_length(text) + ROW_BYTES).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("g"), F.monotonically_increasing_id().alias("row"))
    rows = materialise(rows, "rows")
    groups = rows.groupBy("g").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
    behind = F.greatest(F.length(F.bin("bytes")) - SIZE_BITS, F.lit(0))
    groups = materialise(groups.withColumn("behind", behind).selectExpr("g", "rows", "shiftleft(shiftright(bytes + shiftleft(1L, behind) - 1, behind), behind) AS class"), "groups", light=True)
    classes = sorted(((r["class"], r["n"]) for r in groups.groupBy("class").agg(F.count("*").alias("n")).collect()), reverse=True)
    packed = (evenest(classes, shards) if shards else best_fit(classes, capacity)) if classes else []
    runs, begin = [], 0
    for size, n, number in packed:
        runs.append((size, begin, begin + n, number))
        begin += n
    runs = rows.sparkSession.createDataFrame(runs, "run_class long, first long, past long, shard int")
    placed = numbered(groups, F.desc("class"), "g")
    placed = placed.join(small(runs), (F.col("class") == F.col("run_class")) & (F.col("number") >= F.col("first")) & (F.col("number") < F.col("past"))).select("g", "rows", "shard")
    placed = materialise(placed, "placed", light=True)
    hot = F.col("rows") > max(HOT_LEAST, rows.count() // HOT_SHARE)
    some = F.broadcast(placed.filter(hot).select("g", "shard"))
    dealt = rows.join(some, "g").unionByName(rows.join(some, "g", "left_anti").join(placed.filter(~hot).select("g", "shard"), "g"))
    placed = numbered(materialise(dealt.drop("g"), "dealt"), "shard", "row", name="place")
    starts = small(materialise(placed.groupBy("shard").agg(F.min("place").alias("start")), "starts", light=True))
    return placed.join(starts, "shard").select(F.col("id").alias(id_col), "size", "text_crc32", "shard", (F.col("place") - F.col("start")).alias("slot"))
