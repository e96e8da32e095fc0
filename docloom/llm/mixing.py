"""Mixing sources to target weights by entropy balancing. DataFrame and SQL functions only."""

from __future__ import annotations

import warnings
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise

#: Words are separated by runs of blanks, tabs, line feeds, vertical tabs, form feeds and carriage returns.
SPACE = r"[\x20\x09-\x0D]+"
#: Steps of the histogram that places the last copies of a source.
STEPS = 1 << 14


def source_targets(sizes: DataFrame, weights: Sequence[float], share: float, cap: float) -> DataFrame:
    """Rows (source, source_size, target) for rows (source, size).

    Sources by code point, null last, get the weights in turn, repeating. They share `share` times all sizes by weight; a target stops at cap times
    its source's size, and the excess is shared anew by weight. That is a water level: target = min(cap * size, level * weight), found from running
    sums over the sources in the order in which they fill up. One row per source is ordered in one task; rows of documents never are.
    """
    if share > cap:
        raise ValueError("the share can't exceed the cap")
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").isNull(), F.col("source"))) - 1
    weighed = per.withColumn("w", F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (rank % len(weights)).cast("int") + 1)).withColumn("full", F.lit(float(cap)) * F.col("source_size"))
    order = Window.orderBy(F.col("full") / F.col("w"), F.col("source").isNull(), F.col("source"))
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = F.sum("w").over(whole) - F.coalesce(F.sum("w").over(before), F.lit(0.0))  # of this source and those after it, without a frame that is summed anew for each
    level = (F.lit(float(share)) * F.sum("source_size").over(whole) - F.coalesce(F.sum("full").over(before), F.lit(0.0))) / left
    filled = weighed.withColumn("level", level).withColumn("open", F.col("level") * F.col("w") < F.col("full"))
    # the first source that doesn't fill up sets the level of all that follow
    final = F.first(F.when(F.col("open"), F.col("level")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return filled.withColumn("final", final).select("source", "source_size", F.when(F.col("final").isNull(), F.col("full")).otherwise(F.least("full", F.col("final") * F.col("w"))).alias("target"))


def _rate(tilt: Column, x: Column, cap: float) -> Column:
    """The expected copies of a document: the odds of rate against cap - rate are tilted exponentially; 1 at tilt 0, never above cap."""
    return F.lit(cap) / (F.lit(1.0) + F.lit(cap - 1.0) * F.exp(-F.greatest(F.lit(-500.0), F.least(F.lit(500.0), tilt * x))))


def balance(sizes: DataFrame, targets: DataFrame, cap: float, rounds: int = 60, tolerance: float = 1e-9) -> DataFrame:
    """Rows (source, tilt): the dual variable of each source's token constraint.

    The rates nearest to one copy each in (bounded) relative entropy whose tokens add up to the target are exponential tilts in the document's size.
    The dual is convex with one variable a source. Newton steps run on all sources at once, each step one aggregate over the histogram of sizes;
    a bracket keeps steps that overshoot (then the middle is taken). A source whose target is its cap has tilt +inf, one with target 0 -inf. Sources that
    haven't settled after all rounds are reported as a warning; the rounding that follows still brings their words to the target.
    """
    histogram = sizes.filter("size > 0").groupBy("source", "size").agg(F.count("*").alias("n"))
    unit = targets.select("source", "source_size", "target")
    mean = histogram.groupBy("source").agg((F.sum(F.col("n") * F.col("size") * F.col("size")) / F.sum(F.col("n") * F.col("size"))).alias("unit"))
    histogram = materialise(histogram, "sizes")
    fixed = F.when(F.col("target") >= cap * F.col("source_size") * (1 - 1e-12), F.lit(float("inf"))).when(F.col("target") <= 0, F.lit(float("-inf")))
    state = materialise(unit.join(mean, unit.source.eqNullSafe(mean.source)).select(unit.source, "source_size", "target", "unit", fixed.alias("fixed"), F.lit(0.0).alias("tilt"), F.lit(-1e6).alias("low"), F.lit(1e6).alias("high"), F.lit(False).alias("done")), "tilts")
    for _ in range(rounds):
        h = histogram.select(F.col("source").alias("s"), "size", "n")
        x = F.col("size") / F.col("unit")
        rate = _rate(F.col("tilt"), x, cap)
        mass = F.col("n") * F.col("size") * rate
        # aggregate first, then join: the tilts are a row per source
        sums = h.join(state.filter("not done and fixed is null"), h.s.eqNullSafe(state.source)).groupBy("s").agg(F.sum(mass).alias("tokens"), F.sum(mass * x * (F.lit(1.0) - rate / cap)).alias("slope"))
        over = F.col("tokens") > F.col("target")
        low, high = F.when(over, F.col("low")).otherwise(F.col("tilt")), F.when(over, F.col("tilt")).otherwise(F.col("high"))
        newton = F.col("tilt") - (F.col("tokens") - F.col("target")) / F.col("slope")
        middle = F.when((low > -1e6) & (high < 1e6), (low + high) / 2).otherwise(F.when(over, F.least(F.col("tilt") * 2, F.col("tilt") - 4)).otherwise(F.greatest(F.col("tilt") * 2, F.col("tilt") + 4)))
        good = (F.col("slope") > 0) & (newton > low) & (newton < high) & (F.abs(newton - F.col("tilt")) <= 8)
        near = F.abs(F.col("tokens") - F.col("target")) <= tolerance * F.col("target")
        moved = F.col("tokens").isNotNull()
        step = F.when(~moved | near, F.col("tilt")).otherwise(F.when(good, newton).otherwise(middle))
        state = materialise(
            state.join(sums, state.source.eqNullSafe(sums.s), "left").select("source", "source_size", "target", "unit", "fixed", step.alias("tilt"), F.when(moved, low).otherwise(F.col("low")).alias("low"), F.when(moved, high).otherwise(F.col("high")).alias("high"), (F.col("done") | ~moved | near).alias("done")), "tilts"
        )
        if not state.filter("not done").head(1):
            break
    else:
        warnings.warn(f"entropy balancing: sources unsettled after {rounds} rounds", stacklevel=2)
    return state.select("source", F.coalesce("fixed", "tilt").alias("tilt"), "unit")


def mix_sources(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, cap: int = 2, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", keep: Sequence[str] = ()) -> DataFrame:
    """One row per document: (id, *keep, size, source_size, target, rate, copies, taken).

    Rates come from entropy balancing and are rounded into whole copies: a document takes floor(rate) copies and one more if its place (a hash of its id
    and text size) lies below the fractional part. The line is then moved, per source, to the last step of a histogram of (place - fraction) at which the
    source's words don't exceed its target, and the document whose size comes nearest to the rest takes one more. copies never exceeds cap. Null texts have size 0 and take nothing; rows with the same id, size and source
    share one fate; reruns agree. Keeping the text (keep) reads the documents once more and moves no text.
    """
    size = F.size(F.array_remove(F.split(F.coalesce(F.col(text_col), F.lit("")), SPACE), "")).cast("long")
    place = F.pmod(F.xxhash64(F.col(id_col).cast("string"), F.lit("place"), size), F.lit(1 << 40)) / float(1 << 40)
    sized = lambda: docs.select(*(docs[c].alias(f"kept_{i}") for i, c in enumerate(keep)), docs[id_col].alias("id"), docs[source_col].alias("source"), size.alias("size"), place.alias("place"))
    slim = materialise(sized().select("id", "source", "size", "place"), "mix")
    targets = materialise(source_targets(slim, weights, share, cap), "targets")
    tilts = balance(slim, targets, float(cap))
    per = materialise(targets.join(tilts.select(F.col("source").alias("s"), "tilt", "unit"), F.col("source").eqNullSafe(F.col("s")), "left").select(F.col("source").alias("s"), "source_size", "target", "tilt", "unit"), "per")

    def rated(df: DataFrame, of: DataFrame) -> DataFrame:
        rate = F.when(F.col("tilt").isNull() | (F.col("size") == 0) | (F.col("tilt") == float("-inf")), F.lit(0.0)).when(F.col("tilt") == float("inf"), F.lit(float(cap))).otherwise(_rate(F.col("tilt"), F.col("size") / F.col("unit"), float(cap)))
        d = df.join(of, df.source.eqNullSafe(of.s)).withColumn("rate", rate).withColumn("base", F.floor("rate").cast("int"))
        return d.withColumn("over", F.col("rate") - F.col("base")).withColumn("step", F.floor((F.col("place") - F.col("over")) * STEPS).cast("int"))

    # words taken if one more copy goes to all documents at or below a step; moving the line adds documents in the order of place - fraction
    room = F.when(F.col("base") < cap, F.col("size")).otherwise(F.lit(0))
    bins = rated(slim, per).groupBy("s", "step").agg(F.sum(room).alias("more"), F.sum(F.col("size") * F.col("base")).alias("floor"), F.max("target").alias("target"))
    run, whole = Window.partitionBy("s").orderBy("step"), Window.partitionBy("s")
    placed = bins.withColumn("words", F.sum("floor").over(whole) + F.sum("more").over(run)).withColumn("ground", F.sum("floor").over(whole))
    under = F.col("words") <= F.col("target")
    line = placed.groupBy("s").agg(F.max(F.when(under, F.col("step"))).alias("line"), F.max(F.when(under, F.col("words"))).alias("words"), F.first("ground").alias("ground"))
    line = line.select(F.col("s").alias("ls"), F.coalesce("line", F.lit(-10 * STEPS)).alias("line"), F.coalesce("words", "ground").alias("words"))
    lined = materialise(per.join(line, F.col("s").eqNullSafe(F.col("ls"))).select("s", "source_size", "target", "tilt", "unit", "line", "words"), "lines")
    # what is still missing goes to the one document whose size comes nearest to it
    gap = F.col("target") - F.col("words")
    spare = rated(slim, lined).filter((F.col("base") < cap) & (F.col("step") > F.col("line")) & (F.col("size") > 0) & (F.abs(gap - F.col("size")) < gap))
    last = spare.groupBy("s").agg(F.min_by(F.struct("size", "place"), F.struct(F.abs(gap - F.col("size")), F.col("size"), F.col("place"))).alias("last")).select(F.col("s").alias("ls"), "last")
    known = materialise(lined.join(last, F.col("s").eqNullSafe(F.col("ls")), "left").drop("ls"), "lines")
    one_more = (F.col("step") <= F.col("line")) | F.coalesce((F.col("size") == F.col("last.size")) & (F.col("place") == F.col("last.place")), F.lit(False))
    out = rated(sized() if keep else slim, known).withColumn("copies", F.col("base") + F.when((F.col("base") < cap) & one_more, 1).otherwise(0))
    return out.select(F.col("id").alias(id_col), *(F.col(f"kept_{i}").alias(c) for i, c in enumerate(keep)), "size", "source_size", "target", "rate", "copies", (F.col("copies") * F.col("size")).alias("taken"))
