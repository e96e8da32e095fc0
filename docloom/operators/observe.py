"""Snapshots of extracted fields, their counts, changes, triage and summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions.scores import snapshot_band
from docloom.functions.validators import suspicious
from docloom.operators.keyed import commonest, last_n, top


def against_contract(values: DataFrame, contract: DataFrame, run: list[str], key: str = "field") -> DataFrame:
    """A row for each run and contract field: accepted with a value, missing without. The contract is a short fixed list and is broadcast."""
    grid = values.select(*run).distinct().crossJoin(F.broadcast(contract.select(F.col("key").alias(key))))
    return grid.join(values, [*run, key], "left").withColumn("status", F.when(F.trim("value") != "", "accepted").otherwise("missing"))


def snapshot_counts(fields: DataFrame, run: list[str]) -> DataFrame:
    """Per run: accepted, rejected and missing fields, and accepted ones by band."""
    band = snapshot_band(F.col("confidence"))
    ok = F.col("status") == "accepted"
    return fields.groupBy(*run).agg(
        F.count_if(ok).alias("accepted"), F.count_if(F.col("status") == "rejected").alias("rejected"), F.count_if(F.col("status") == "missing").alias("missing"), F.count_if(ok & (band == "low")).alias("low"), F.count_if(ok & (band == "mid")).alias("mid"), F.count_if(ok & (band == "high")).alias("high"), F.count("*").alias("total")
    )


def flagged(fields: DataFrame, run: list[str], as_of: Column | None = None) -> DataFrame:
    """Fields with flags: why accepted values look wrong. What other fields of the run hold comes from one window over it, not from a join of fields with fields."""
    ok = F.col("status") == "accepted"
    w = Window.partitionBy(*run)
    of = lambda key: F.max(F.when(ok & (F.col("field") == key), F.col("value"))).over(w)
    f = fields.withColumns({"_clinic": of("clinic_address"), "_visit": of("visit_date")})
    reasons = suspicious(F.col("field"), F.col("value"), F.col("_clinic"), F.col("_visit"), F.current_date() if as_of is None else as_of)
    return f.withColumn("flags", F.when(ok, reasons).otherwise(F.array().cast("array<string>"))).drop("_clinic", "_visit")


def field_report(fields: DataFrame, doc: str, order: list[str], limit: int = 20, as_of: Column | None = None) -> DataFrame:
    """Per document and field over its last `limit` runs: missing, rejected, accepted and suspicious ones, the commonest value and the mean confidence of accepted ones."""
    runs = last_n(fields.select(doc, *order).distinct(), [doc], order, limit)
    recent = flagged(fields.join(runs, [doc, *order], "left_semi"), [doc, *order], as_of)
    ok = F.col("status") == "accepted"
    counts = recent.groupBy(doc, "field").agg(F.count_if(F.col("status") == "missing").alias("missing"), F.count_if(F.col("status") == "rejected").alias("rejected"), F.count_if(ok).alias("accepted"), F.count_if(F.size("flags") > 0).alias("suspicious"), F.bround(F.avg(F.when(ok, F.col("confidence"))), 2).alias("mean_confidence"))
    usual = commonest(recent.filter("status = 'accepted'"), [doc, "field"], "value", order[0]).select(doc, "field", F.col("value").alias("usual"))
    return counts.join(usual, [doc, "field"], "left")


def candidate_gaps(report: DataFrame, with_candidates: DataFrame, doc: str) -> DataFrame:
    """Per document: missing fields for which candidates were found (with_candidates: doc, field), and those without."""
    missing = report.filter("missing > 0").join(with_candidates.select(doc, "field", F.lit(True).alias("_has")).distinct(), [doc, "field"], "left")
    return missing.groupBy(doc).agg(F.count_if(F.col("_has").isNotNull()).alias("missing_with_candidates"), F.count_if(F.col("_has").isNull()).alias("missing_without_candidates"))


def in_order(report: DataFrame, doc: str) -> DataFrame:
    """Field rows with their position in the document's report: by missing, rejected, suspicious and name, all descending."""
    w = Window.partitionBy(doc).orderBy(*(F.desc(c) for c in ("missing", "rejected", "suspicious", "field") if c in report.columns))
    return report.withColumn("position", F.row_number().over(w))


def coverage(best: DataFrame, record: DataFrame, docs: DataFrame, keys: list[str]) -> DataFrame:
    """Rows (document_id, key, status, top1, confidence, line_number) for each document and key: whether the record (document_id, key) has it, the first
    candidate of best (document_id, key, rank, value, confidence, snippet), and the line of its evidence if accepted. A text is joined once, with an array of its candidates; keys are laid out after that."""
    from docloom.operators.visits import lines_of

    top1 = best.filter("rank = 1").select("document_id", "key", F.trim("value").alias("top1"), F.round("confidence", 2).alias("confidence"), "snippet")
    held = top1.groupBy("document_id").agg(F.collect_list(F.struct("key", "top1", "confidence", "snippet")).alias("held"))
    placed = docs.select("document_id", "text").join(held, "document_id", "left").select("document_id", F.explode(lines_of(F.col("text"), F.col("held"))).alias("c")).select("document_id", "c.*")
    have = record.select("document_id", "key", F.lit("accepted").alias("status")).distinct()
    grid = docs.select("document_id", F.explode(F.array(*map(F.lit, keys))).alias("key"))
    g = grid.join(placed, ["document_id", "key"], "left").join(have, ["document_id", "key"], "left").withColumn("status", F.coalesce("status", F.lit("missing")))
    return g.select("document_id", "key", "status", "top1", "confidence", F.when(F.col("status") == "accepted", F.col("line")).alias("line_number"))


def date_choices(best: DataFrame) -> DataFrame:
    """Rows (document_id, key, anchor, priority, reason): why the first candidate of each kind of date was taken."""
    return best.filter(F.col("key").isin("visit_date", "document_date", "admission_date", "discharge_date") & (F.col("rank") == 1)).select("document_id", "key", "anchor", F.coalesce("priority", F.lit(0)).alias("priority"), "reason")


def most_missing(report: DataFrame, doc: str, n: int = 10, by: str = "missing") -> DataFrame:
    """The n fields of each document that are missing (or rejected) most often."""
    return top(report.filter(F.col(by) > 0), [doc], [F.desc(by), F.asc("field")], n)


def triage(fields: DataFrame, run: list[str], as_of: Column | None = None) -> DataFrame:
    """Per run: missing, rejected and suspicious fields as sorted, comma-joined names; suspicious ones with their reasons as name:reason."""
    named = lambda when: F.array_join(F.array_sort(F.collect_list(F.when(when, F.col("field")))), ",")
    reasons = F.array_join(F.array_sort(F.flatten(F.collect_list(F.transform("flags", lambda x: F.concat_ws(":", F.col("field"), x))))), ",")
    return flagged(fields, run, as_of).groupBy(*run).agg(named(F.col("status") == "missing").alias("missing"), named(F.col("status") == "rejected").alias("rejected"), reasons.alias("suspicious"))


def hotspots(churn: DataFrame, sizes: DataFrame, key: str) -> DataFrame:
    """Rows (key, churn, complexity) of places that changed (churn: a row a change) or are complex (sizes: key, complexity), whichever of both they are: the number of changes
    and the greatest complexity, 0 without. Each side is an aggregate before they meet."""
    a = churn.groupBy(key).agg(F.count("*").alias("churn"))
    b = sizes.groupBy(key).agg(F.max("complexity").alias("complexity"))
    return a.join(b, key, "full").select(key, F.coalesce("churn", F.lit(0)).alias("churn"), F.coalesce("complexity", F.lit(0)).alias("complexity"))


def rollup(rows: DataFrame, by: str, who: str, large: Column) -> DataFrame:
    """Rows (by, n, users, large): of each status its rows, distinct owners and large ones."""
    return rows.groupBy(by).agg(F.count("*").alias("n"), F.countDistinct(who).alias("users"), F.count_if(large).alias("large"))
