"""Benchmark decontamination by winnowing. DataFrame and SQL functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise

#: What separates words once A-Z are lower-cased.
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Words of a window; words of a gram. The minimum of WINDOW - GRAM + 1 grams in a row is kept, so that texts that share WINDOW words share a kept hash.
WINDOW, GRAM = 13, 7
#: Fingerprints, windows or candidates up to so many rows (two or three longs each) are broadcast; beyond that joins shuffle.
BROADCAST_ROWS = 500_000


def words_of(text: Column) -> Column:
    """The words of a text as an array; none for null."""
    lowered = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.array_remove(F.split(lowered, NOT_WORD), "")


def _grams(hashes: str, k: int) -> Column:
    """Hashes of all runs of k items of an array; none if it is shorter."""
    return F.when(F.size(hashes) >= k, F.transform(F.sequence(F.lit(1), F.size(hashes) - (k - 1)), lambda i: F.xxhash64(F.slice(hashes, i, k)))).otherwise(F.array().cast("array<bigint>"))


def _hashed(df: DataFrame, *keys: str) -> DataFrame:
    return df.select(*keys, F.transform(words_of(F.col("text")), lambda w: F.xxhash64(w)).alias("h"))


def winnow(df: DataFrame, *keys: str, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """Rows (*keys, fp): the distinct hashes that winnowing keeps of each row's words (column h)."""
    span = window - gram + 1
    kept = F.when(F.size("g") >= span, F.transform(F.sequence(F.lit(1), F.size("g") - (span - 1)), lambda i: F.array_min(F.slice("g", i, span)))).otherwise(F.array().cast("array<bigint>"))
    return df.select(*keys, _grams("h", gram).alias("g")).select(*keys, F.explode(F.array_distinct(kept)).alias("fp"))


def _small(df: DataFrame, rows: int) -> DataFrame:
    """df, marked for broadcast if it has no more rows than the bound."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def hit_windows(docs: DataFrame, bench: DataFrame, window: int = WINDOW, gram: int = GRAM) -> tuple[DataFrame, DataFrame]:
    """(hits, sets): rows (doc, tag, set, at, n) for all places where n words of a document from position at (1 is the first) are a window of items, and
    rows (set, items) with the sorted item ids, as strings, of each set. Windows with the same items share a set, so a window that many items and many
    documents have never makes a row for each pair of them. Windows are compared by 64-bit hashes of their words' 64-bit hashes.

    docs has doc, tag and text; bench has item and text. Fingerprints of both sides are joined; the documents that share one, and only these, are then
    compared window by window, which extends each hit to all that it is part of. Items of fewer words than a window are one window: documents are
    searched for their whole hash at their lengths, of which there are fewer than `window`.
    """
    items = materialise(_hashed(bench.select("item", "text"), "item").withColumn("n", F.size("h")).filter("n > 0"), "items")
    lengths = [r["n"] for r in items.filter(F.col("n") < window).select("n").distinct().collect()]
    whole = _grams("h", window)
    windows = items.filter(F.col("n") >= window).select("item", F.explode(F.array_distinct(whole)).alias("w"), F.lit(window).alias("n")).unionAll(items.filter(F.col("n") < window).select("item", F.xxhash64("h").alias("w"), "n"))
    windows = materialise(windows.distinct(), "windows")
    keyed = windows.groupBy("w", "n").agg(F.lit(1).alias("one"))
    n_windows = windows.count()
    kept = materialise(winnow(items.filter(F.col("n") >= window), "item", window=window, gram=gram).select("fp").distinct(), "kept")
    hashed = _hashed(docs, "doc", "tag")
    near = winnow(hashed, "doc", "tag", window=window, gram=gram).join(_small(kept, kept.count()), "fp", "left_semi").select("doc", "tag").distinct()
    found = materialise(near, "near")
    wide = hashed.join(_small(found, found.count()), ["doc", "tag"], "left_semi").select("doc", "tag", F.posexplode(whole).alias("p", "w")).select("doc", "tag", (F.col("p") + 1).alias("at"), "w", F.lit(window).alias("n"))
    places = [wide] + [hashed.select("doc", "tag", F.posexplode(_grams("h", k)).alias("p", "w")).select("doc", "tag", (F.col("p") + 1).alias("at"), "w", F.lit(k).alias("n")) for k in lengths]
    hits = [p.join(_small(keyed.filter(F.col("n") == k).select("w"), n_windows), "w", "left_semi") for p, k in zip(places, [window, *lengths], strict=True)]
    every = hits[0]
    for h in hits[1:]:
        every = every.unionAll(h)
    # one row per place; the items come in by hash, as sets
    named = windows.groupBy("w", F.col("n").alias("k")).agg(F.array_sort(F.collect_set(F.col("item").cast("string"))).alias("items"))
    named = materialise(named.withColumn("set", F.sha2(F.to_json("items"), 256)), "sets")
    places = materialise(every.distinct(), "hits").join(_small(named.select("w", "k", "set"), n_windows), "w").filter("k = n").select("doc", "tag", "set", "at", "n")
    return places, named.select("set", "items").dropDuplicates(["set"])


def decontaminate(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Rows (id, *keep, n_words, n_hit, n_items, items_sha256, contaminated), one for each row of docs, from whole texts.

    n_hit counts the words inside any occurrence of an item's window; n_items the items with such a window; items_sha256 is of their ids, sorted as
    strings and comma-joined. contaminated: n_hit > 0 and at least a twentieth of the words. Null and empty texts have no words; rows that repeat an id,
    or have none, are told apart by a hash of their text; empty tables give no hits; columns that keep doesn't name are left behind, whatever their names.
    """
    tag = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    # ids as strings that are never null, so that a null id meets its hits
    key = F.coalesce(F.concat(F.lit("="), docs[id_col].cast("string")), F.lit(""))
    own = docs.select(key.alias("doc"), tag.alias("tag"), docs[text_col].alias("text"))
    hits, sets = hit_windows(own, bench.select(bench[item_id_col].alias("item"), bench[item_text_col].alias("text")))
    hits = materialise(hits, "hits")
    spans = hits.select("doc", "tag", "at", (F.col("at") + F.col("n")).alias("stop")).groupBy("doc", "tag", "at").agg(F.max("stop").alias("stop"))
    before = F.max("stop").over(Window.partitionBy("doc", "tag").orderBy("at").rowsBetween(Window.unboundedPreceding, -1))
    covered = spans.withColumn("reached", F.coalesce(before, F.lit(0))).groupBy("doc", "tag").agg(F.sum(F.greatest(F.lit(0), F.col("stop") - F.greatest("at", "reached"))).cast("long").alias("n_hit"))
    # documents that hit the same sets share the union of their items, which is taken once
    met = materialise(hits.groupBy("doc", "tag").agg(F.array_sort(F.collect_set("set")).alias("met")).withColumn("union", F.sha2(F.array_join("met", ","), 256)), "met")
    unions = met.select("union", "met").dropDuplicates(["union"]).select("union", F.explode("met").alias("set")).join(sets, "set").select("union", F.explode("items").alias("item")).distinct()
    unions = unions.groupBy("union").agg(F.count("*").alias("n_items"), F.sha2(F.array_join(F.array_sort(F.collect_list("item")), ","), 256).alias("items_sha256"))
    named = met.select("doc", "tag", "union").join(unions, "union").drop("union")
    found = materialise(covered.join(named, ["doc", "tag"]), "found")
    base = docs.select(*(docs[c].alias(f"kept_{i}") for i, c in enumerate(keep)), docs[id_col].alias("own_id"), key.alias("doc"), tag.alias("tag"), F.size(words_of(docs[text_col])).cast("long").alias("n_words"))
    out = base.join(_small(found, found.count()), ["doc", "tag"], "left").withColumn("n_hit", F.coalesce("n_hit", F.lit(0)))
    return out.select(
        F.col("own_id").alias(id_col), *(F.col(f"kept_{i}").alias(c) for i, c in enumerate(keep)), "n_words", "n_hit", F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"), ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
    )
