"""Operators on keyed, ordered rows: latest, previous, nearest, enclosing, carried forward, counted, ranked.

All are windows or aggregates over the key, so each costs one shuffle on it and nothing is gathered on the driver.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key: the greatest by the order columns. An aggregate, so rows are reduced before they are shuffled."""
    rest = [c for c in df.columns if c not in keys]
    row = F.max_by(F.struct(*rest), F.struct(*order)).alias("_row")
    return df.groupBy(*keys).agg(row).select(*keys, "_row.*").select(*df.columns)


def first_of(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row per key: the first by order."""
    return top(df, keys, order, 1).drop("rank")


def top(df: DataFrame, keys: Sequence[str], order: Sequence[Column], most: int) -> DataFrame:
    """The first `most` rows of each key, with their rank from 1. The engine keeps only so many per key and task before the shuffle."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("rank") <= most)


def last_n(df: DataFrame, keys: Sequence[str], order: Sequence[str], n: int) -> DataFrame:
    """The n last rows of each key."""
    return top(df, keys, [F.desc(c) for c in order], n).drop("rank")


def page(df: DataFrame, order: Sequence[Column], size: int, number: int = 0) -> DataFrame:
    """A page of rows in order; limits reach the sort, which keeps only the rows up to the page's end."""
    return df.orderBy(*order).offset(size * number).limit(size)


def without(df: DataFrame, other: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose key doesn't occur in other."""
    return df.join(other.select(*keys), list(keys), "left_anti")


def lookup(df: DataFrame, other: DataFrame, keys: Sequence[str], null_keys: Sequence[str] = ()) -> DataFrame:
    """Left join in which the null_keys match null with null; other's keys don't come along twice."""
    renamed = other.select(*(F.col(c).alias(f"_k_{c}") if c in (*keys, *null_keys) else F.col(c) for c in other.columns))
    on = None
    for c in (*keys, *null_keys):
        one = df[c].eqNullSafe(renamed[f"_k_{c}"]) if c in null_keys else df[c] == renamed[f"_k_{c}"]
        on = one if on is None else on & one
    return df.join(renamed, on, "left").drop(*(f"_k_{c}" for c in (*keys, *null_keys)))


def changes(df: DataFrame, keys: Sequence[str], order: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Rows with previous_<v> and changed_<v> for each value, compared with the row before of the same key; the first row of a key has changed nothing."""
    w = Window.partitionBy(*keys).orderBy(*order)
    first = F.row_number().over(w) == 1
    return df.withColumns({f"previous_{v}": F.lag(v).over(w) for v in values} | {f"changed_{v}": ~first & ~F.lag(v).over(w).eqNullSafe(F.col(v)) for v in values})


def clipped_total(df: DataFrame, keys: Sequence[str], order: Sequence[str], delta: str, name: str) -> DataFrame:
    """The sum of deltas applied one after another with a floor of 0 after each: the running sum less its lowest point below 0."""
    running = F.sum(delta).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return df.withColumn("_run", running).groupBy(*keys).agg((F.sum(delta) - F.least(F.lit(0), F.min("_run"))).alias(name))


def commonest(df: DataFrame, keys: Sequence[str], value: str, order: str) -> DataFrame:
    """The value seen most often per key; of several the one seen first by order."""
    counted = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("n"), F.min(order).alias("_first"))
    return first_of(counted, keys, [F.desc("n"), F.asc("_first")]).drop("_first")


def carried(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: Column, name: str) -> DataFrame:
    """Each row with the last value that isn't null up to it."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn(name, F.last(value, ignorenulls=True).over(w))


def intervals(df: DataFrame, keys: Sequence[str], order: str, end: Column) -> DataFrame:
    """Each row with the interval [order, next row's order), the last one's up to end."""
    return df.withColumn("stop", F.coalesce(F.lead(order).over(Window.partitionBy(*keys).orderBy(order)), end))


def enclosed(df: DataFrame, marks: DataFrame, keys: Sequence[str], place: str, mark: str) -> DataFrame:
    """Each row with the last mark of its key at or before its place and the first after it: both sides of an as-of match from one sort of rows and marks
    together, so that no pairs are made. Null where there is none."""
    rows = df.select(*keys, F.col(place).alias("_p"), F.lit(1).alias("_row_first"), F.struct(*df.columns).alias("_row"))
    ends = marks.select(*keys, F.col(mark).alias("_p"), F.lit(0).alias("_row_first"), F.lit(None).cast(rows.schema["_row"].dataType).alias("_row"))
    at = F.when(F.col("_row").isNull(), F.col("_p"))
    w = Window.partitionBy(*keys).orderBy("_p", "_row_first")
    both = ends.unionByName(rows).withColumns({"_before": F.last(at, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)), "_after": F.first(at, ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing))})
    return both.filter("_row is not null").select("_row.*", F.col("_before").alias("begins"), F.col("_after").alias("ends"))


def count_deltas(df: DataFrame, keys: Sequence[str], order: Sequence[str], counts: Sequence[str]) -> DataFrame:
    """Rows with <c>_delta for each count: its change against the row before of the same key; null for the first. A missing count is 0."""
    w = Window.partitionBy(*keys).orderBy(*order)
    first = F.row_number().over(w) == 1
    return df.withColumns({f"{c}_delta": F.when(~first, F.coalesce(F.col(c), F.lit(0)) - F.coalesce(F.lag(c).over(w), F.lit(0))) for c in counts})


def nearest(left: DataFrame, right: DataFrame, keys: Sequence[str], place: str, right_place: str, right_id: str) -> DataFrame:
    """Left rows with the right row of the same key nearest to their place: ties go to the lesser place, then id. Rows without one keep nulls.

    A union sorted by place finds the last right row before and the first after each left row, so no pairs within a key are made.
    """
    marks = left.select(*keys, F.col(place).alias("_p"), F.lit(None).cast(right.schema[right_id].dataType).alias("_id"), F.struct(*left.columns).alias("_row"))
    anchors = right.select(*keys, F.col(right_place).alias("_p"), F.col(right_id).alias("_id"), F.lit(None).cast(marks.schema["_row"].dataType).alias("_row"))
    anchors = anchors.groupBy(*keys, "_p").agg(F.min("_id").alias("_id"), F.first("_row").alias("_row"))
    both = anchors.unionByName(marks)
    anchor = F.when(F.col("_id").isNotNull(), F.struct(F.col("_p").alias("place"), F.col("_id").alias("id")))
    w = Window.partitionBy(*keys).orderBy("_p", F.col("_id").isNull())
    before = F.last(anchor, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    after = F.first(anchor, ignorenulls=True).over(Window.partitionBy(*keys).orderBy("_p", F.col("_id").isNotNull()).rowsBetween(Window.currentRow, Window.unboundedFollowing))
    found = both.withColumns({"_before": before, "_after": after}).filter(F.col("_row").isNotNull())
    early = F.col("_p") - F.col("_before.place")
    late = F.col("_after.place") - F.col("_p")
    pick = F.when(F.col("_after").isNull() | (early <= late), F.col("_before")).otherwise(F.coalesce("_after", "_before"))
    return found.withColumn("_pick", pick).select("_row.*", F.col("_pick.id").alias("nearest_id"), F.col("_pick.place").alias("nearest_place"))


def kth_match(left: DataFrame, right: DataFrame, keys: Sequence[str], left_order: Sequence[str], right_order: Sequence[str]) -> DataFrame:
    """The k-th row of a key on the left with the k-th on the right; beyond the last, the last one."""
    l_ = left.withColumn("k", F.row_number().over(Window.partitionBy(*keys).orderBy(*left_order)))
    r = right.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(*right_order))).withColumn("_n", F.count("*").over(Window.partitionBy(*keys)))
    n = r.groupBy(*keys).agg(F.max("_n").alias("_most"))
    return l_.join(n, list(keys)).withColumn("_k", F.least("k", "_most")).drop("_most").join(r.drop("_n"), [*keys, "_k"]).drop("_k")


def unique_match(df: DataFrame, table: DataFrame, key: str, value: str) -> DataFrame:
    """Left join with a lookup table that counts only keys with exactly one distinct value."""
    once = table.groupBy(key).agg(F.countDistinct(value).alias("_n"), F.min(value).alias(value)).filter("_n = 1").drop("_n")
    return df.join(once, key, "left")


def first_wins(df: DataFrame, keys: Sequence[str], value: str, order: str) -> DataFrame:
    """Rows without those whose folded value an earlier row of the key has."""
    from docloom.functions.text import fold

    return first_of(df.withColumn("_fold", fold(F.col(value))), [*keys, "_fold"], [F.asc(order)]).drop("_fold")


def drop_repeats(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str) -> DataFrame:
    """Rows without those that repeat the value of the row before."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_last", F.lag(value).over(w)).withColumn("_no", F.row_number().over(w)).filter((F.col("_no") == 1) | ~F.col("_last").eqNullSafe(F.col(value))).drop("_last", "_no")


def index_percentile(df: DataFrame, keys: Sequence[str], value: str, share: float, name: str) -> DataFrame:
    """The sorted sample's element at int(share * (n - 1)), without interpolation."""
    w = Window.partitionBy(*keys)
    ranked = df.withColumn("_r", F.row_number().over(w.orderBy(value))).withColumn("_n", F.count("*").over(w))
    return ranked.filter(F.col("_r") == F.floor(F.lit(share) * (F.col("_n") - 1)) + 1).select(*keys, F.col(value).alias(name))
