"""Importance resampling toward a target distribution, over hashed n-gram features, with a dictionary of distinct features."""

from __future__ import annotations

import itertools
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, byte_fold, materialise, numbered, word_slices

#: Words are runs of ASCII digits, letters (A-Z lower-cased) and whatever isn't ASCII.
_FOLD = byte_fold(lambda b: 48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b >= 128)
#: Counts of one task are handed on when so many distinct features are held.
HELD = 500_000


@dataclass(frozen=True)
class Resampling:
    """most_words: features are runs of 1 to so many words; buckets of their hash; seed of the draw; share of the eligible documents drawn, in percent;
    least_words: documents of fewer aren't drawn; hot_share: features that make up at least 1 / hot_share of all are known to every task, the others are joined."""

    most_words: int = 1
    buckets: int = 10_000
    seed: int = 2024
    percent: int = 10
    least_words: int = 20
    hot_share: int = 20_000


def features(raw: bytes | None, most_words: int, counts: Counter) -> int:
    """Adds the features of a text to counts; the number of its words."""
    n, tail = 0, []
    for words in word_slices(raw, _FOLD):
        n += len(words)
        counts.update(words)
        if most_words > 1:
            run, old = tail + words, len(tail)
            for k in range(2, most_words + 1):
                counts.update(b" ".join(run[i : i + k]) for i in range(max(0, old - k + 1), len(run) - k + 1))
            tail = run[-(most_words - 1) :]
    return n


def _strings(found: Iterable[bytes]) -> pa.Array:
    return pa.array(found, pa.binary()).cast(pa.string())


def feature_counts(texts: DataFrame, most_words: int) -> DataFrame:
    """Rows (feature, n) whose n add up to the features' counts over all texts (a column text); each task adds up its own first."""
    bound_batches(texts.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        handed = lambda: pa.RecordBatch.from_arrays([_strings(list(held)), pa.array(held.values(), pa.int64())], ["feature", "n"])
        for b in batches:
            for raw in b.column(0).cast(pa.binary()):
                features(raw.as_py(), most_words, held)
                if len(held) > HELD:
                    yield handed()
                    held.clear()
        yield handed()

    return texts.select("text").mapInArrow(count, "feature string, n long")


def dictionary(docs: DataFrame, target: DataFrame, p: Resampling) -> DataFrame:
    """Rows (feature, s, gain): every distinct feature of docs with its count there and the gain of its bucket; each distinct string is hashed once.

    gain = floor(1000 ln((t + 1)(S + buckets) / ((s + 1)(T + buckets)))) with the bucket's counts s in docs and t in target, and S and T of all buckets.
    """
    both = feature_counts(docs, p.most_words).select("feature", F.col("n").alias("s"), F.lit(0).cast("long").alias("t")).unionAll(feature_counts(target, p.most_words).select("feature", F.lit(0).cast("long").alias("s"), F.col("n").alias("t")))
    counted = both.groupBy("feature").agg(F.sum("s").alias("s"), F.sum("t").alias("t")).withColumn("bucket", F.crc32(F.col("feature").cast("binary")) % p.buckets)
    counted = materialise(counted, "features", light=True)
    buckets = materialise(counted.groupBy("bucket").agg(F.sum("s").alias("s"), F.sum("t").alias("t")), "buckets", light=True)  # no more rows than p.buckets
    whole = buckets.agg(F.coalesce(F.sum("s"), F.lit(0)).alias("s"), F.coalesce(F.sum("t"), F.lit(0)).alias("t")).first()
    ratio = (F.col("t") + 1).cast("double") * float(whole.s + p.buckets) / ((F.col("s") + 1).cast("double") * float(whole.t + p.buckets))
    gains = buckets.select("bucket", F.floor(1000 * F.ln(ratio)).alias("gain"))
    return materialise(counted.filter("s > 0").join(F.broadcast(gains), "bucket").select("feature", "s", "gain"), "dictionary", light=True)


def _gumbel(id_col: str, seed: int) -> Column:
    """-1000 ln(-ln u) floored, u from the first 32 bits of the SHA-256 of seed:id; a null id counts as empty."""
    named = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(named, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.ln(-F.ln((h + 0.5) / 4294967296)))


def resample(docs: DataFrame, target: DataFrame, p: Resampling = Resampling(), id_col: str = "doc_id", text_col: str = "text", target_text_col: str = "text") -> DataFrame:
    """Rows (id, n_features, weight, score, rank), one for each row of docs, from whole texts.

    weight is the floored mean of the gains of a document's features (0 without any). score adds a Gumbel draw from the id, so that the highest scores are a sample without replacement
    by the exponential of the weights. rank counts the drawn documents (percent of those with least_words words) by falling score and rising id; null: not drawn.

    Features that make up 1 / hot_share of all or more (at most hot_share of them) are summed where the text is read; the rest go to the dictionary by a join on
    the feature, in which no key holds more than that share of the rows. Ranks come from the histogram of scores, which gives the line, and from a
    distributed sort of the documents above it. Null and empty texts have no features; repeated ids are rows of their own, null ids come first among ties; very long texts are split
    a slice at a time; empty tables give no rows, or gains as against no features; further columns are left behind, whatever their names.
    """
    bound_batches(docs.sparkSession)
    spark = docs.sparkSession
    known = dictionary(docs.select(docs[text_col].alias("text")), target.select(target[target_text_col].alias("text")), p)
    total = known.agg(F.coalesce(F.sum("s"), F.lit(0))).first()[0]
    hot = F.col("s") * p.hot_share >= total
    shared = spark.sparkContext.broadcast({r.feature.encode(): r.gain for r in known.filter(hot).select("feature", "gain").toLocalIterator()})
    most = p.most_words

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gains = shared.value
        for b in batches:
            n_words, n_features, sums, offsets, cold, cold_n = [], [], [], [0], [], []
            for raw in b.column(2).cast(pa.binary()):
                counts: Counter = Counter()
                n_words.append(features(raw.as_py(), most, counts))
                n_features.append(sum(counts.values()))
                rest = [f for f in counts if f not in gains]
                sums.append(sum(k * gains[f] for f, k in counts.items() if f in gains))
                cold += rest
                cold_n += [counts[f] for f in rest]
                offsets.append(len(cold))
            pairs = pa.StructArray.from_arrays([_strings(cold), pa.array(cold_n, pa.int64())], ["feature", "n"])
            whole = [pa.array(x, pa.int64()) for x in (n_words, n_features, sums)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *whole, pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pairs)], ["row", "id", "n_words", "n_features", "shared", "cold"])

    rows = docs.select(F.monotonically_increasing_id().alias("row"), docs[id_col].alias("id"), docs[text_col].alias("text"))
    kind = docs.schema[id_col].dataType.simpleString()
    slim = materialise(rows.mapInArrow(summed, f"row long, id {kind}, n_words long, n_features long, shared long, cold array<struct<feature: string, n: long>>"), "slim")
    joined = slim.select("row", F.explode("cold").alias("f")).select("row", "f.feature", "f.n").join(known.filter(~hot).select("feature", "gain"), "feature")
    cold = joined.groupBy("row").agg(F.sum(F.col("n") * F.col("gain")).alias("joined"))
    total_gain = F.col("shared") + F.coalesce("joined", F.lit(0))
    both = slim.drop("cold").join(cold, "row", "left").withColumn("total", total_gain)
    mean = F.expr("CASE WHEN n_features = 0 THEN 0L ELSE (total - pmod(total, n_features)) div n_features END")
    scored = materialise(both.select("row", "id", "n_words", "n_features", mean.alias("weight"), (mean + _gumbel("id", p.seed)).alias("score")), "scored")
    able = F.col("n_words") >= p.least_words
    histogram = sorted(((r.score, r.n) for r in scored.filter(able).groupBy("score").agg(F.count("*").alias("n")).collect()), reverse=True)  # scores are whole thousandths of logarithms: some 10^5 at most
    draw = p.percent * sum(n for _, n in histogram) // 100
    reached = list(itertools.accumulate(n for _, n in histogram))
    line = next((s for (s, _), n in zip(histogram, reached, strict=True) if n >= draw), 0)
    above = able & (F.col("score") >= line) if draw else F.lit(False)
    placed = numbered(materialise(scored.filter(above), "above"), F.desc("score"), "id", "row")
    out = placed.withColumn("rank", F.when(F.col("number") < draw, F.col("number") + 1)).unionByName(scored.filter(~above).withColumns({"number": F.lit(None).cast("long"), "rank": F.lit(None).cast("long")}))
    return out.select(F.col("id").alias(id_col), "n_features", "weight", "score", "rank")
