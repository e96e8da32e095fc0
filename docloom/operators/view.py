"""What a reader of the records sees: visits flattened to fields, validation, slots with their best candidate, groups, bands, suggestions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions.scores import policy_tone, unit
from docloom.functions.validators import SEX_WORDS, SPECIES_WORDS, accept
from docloom.operators.keyed import first_of, top

# fixed values: keys that aren't shown, and the placeholder of missing values
BILLING = ("invoice_total", "covered_amount", "non_covered_amount", "line_item")
MISSING = "—"
#: The four rows that every visit gives: key, type, critical.
VISIT_ROWS = (("visit_date", "date", True), ("admission_date", "date", False), ("discharge_date", "date", False), ("reason_for_visit", "string", False))


def visit_fields(visits: DataFrame) -> DataFrame:
    """Visits (document_id, visit_id, the four columns of VISIT_ROWS) as rows of fields."""
    rows = F.array(*(F.struct(F.concat_ws(":", F.lit(f"visit-meta-{k.split('_')[0]}"), "visit_id").alias("field_id"), F.lit(k).alias("key"), F.col(k).cast("string").alias("value"), F.lit(t).alias("value_type"), F.lit(c).alias("is_critical")) for k, t, c in VISIT_ROWS))
    return visits.select("document_id", "visit_id", F.explode(rows).alias("f")).select("document_id", "visit_id", "f.*")


def validated(fields: DataFrame, contract: DataFrame) -> DataFrame:
    """Rows (document_id, key, raw, status, normalized, reason): accepted or rejected values, and contract keys without a field as missing."""
    judged = fields.select("document_id", "key", F.col("value").alias("raw"), accept(F.col("key"), F.col("value")).alias("r"))
    judged = judged.select("document_id", "key", "raw", F.when(F.col("r.ok"), "accepted").otherwise("rejected").alias("status"), "r.normalized", "r.reason")
    none = F.lit(None).cast("string")
    grid = fields.select("document_id").distinct().crossJoin(F.broadcast(contract.select("key"))).join(fields.select("document_id", "key").distinct(), ["document_id", "key"], "left_anti")
    return judged.unionByName(grid.select("document_id", "key", none.alias("raw"), F.lit("missing").alias("status"), none.alias("normalized"), none.alias("reason")))


def shown(fields: DataFrame) -> DataFrame:
    """Fields without those of bills."""
    return fields.filter(~F.col("key").isin(*BILLING))


def bands(fields: DataFrame) -> DataFrame:
    """Fields with the band of their confidence; no confidence, no band."""
    tone = policy_tone(unit(F.col("confidence")))
    return fields.withColumn("band", F.when(F.col("confidence").isNotNull(), F.when(tone == "med", "medium").otherwise(tone)))


def worst_bands(fields: DataFrame, doc: str = "document_id") -> DataFrame:
    """Per document the fields (key) whose worst band is low, medium, high, or that have none."""
    rank = F.min(F.when(F.col("band") == "low", 0).when(F.col("band") == "medium", 1).when(F.col("band") == "high", 2).otherwise(3))
    worst = fields.filter("value is not null").groupBy(doc, "key").agg(rank.alias("r"))
    return worst.groupBy(doc).agg(*(F.count_if(F.col("r") == i).alias(n) for i, n in enumerate(("low", "medium", "high", "unknown"))))


def concept_summary(fields: DataFrame, doc: str = "document_id") -> DataFrame:
    """Per document the concepts whose best confidence (of fields with a value) is low, medium or high, or that have none."""
    best = fields.filter("value is not null and trim(value) != ''").groupBy(doc, "concept").agg(F.max(unit(F.col("confidence"))).alias("confidence"))
    b = bands(best)
    return b.groupBy(doc).agg(F.count("*").alias("detected"), *(F.count_if(F.col("band") == n).alias(n) for n in ("low", "medium", "high")), F.count_if(F.col("band").isNull()).alias("unknown"))


def slots(fields: DataFrame, aliases: DataFrame) -> DataFrame:
    """The best candidate of each slot: aliases (slot, key, document_scope) bring a slot's keys together; a document's own fields come first where the
    slot is the document's, then confidence (none counts as 0), then order. critical if any candidate is."""
    c = fields.join(F.broadcast(aliases), "key").filter("value is not null and trim(value) != ''")
    order = [F.desc((F.col("document_scope") & (F.col("scope") == "document")).cast("int")), F.desc(unit(F.col("confidence"))), F.asc("seq")]
    critical = F.max("is_critical").over(Window.partitionBy("document_id", "slot"))
    return first_of(c.withColumn("critical", critical), ["document_id", "slot"], order)


def other_fields(fields: DataFrame, known: DataFrame) -> DataFrame:
    """Fields outside the known keys, in groups by key in the order first seen: values as an array, many where there are several."""
    rest = fields.join(F.broadcast(known.select("key")), "key", "left_anti")
    g = rest.groupBy("document_id", "key").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "value"))), lambda s: s["value"]).alias("items"), F.min("seq").alias("first_seq"))
    return g.withColumn("position", F.row_number().over(Window.partitionBy("document_id").orderBy("first_seq"))).withColumn("many", F.size("items") > 1).drop("first_seq")


def distinct_events(events: DataFrame) -> DataFrame:
    """Debug events, each once by its seven parts."""
    return events.dropDuplicates(["document_id", "field", "status", "raw", "normalized", "reason", "page"])


def fields_per_visit(fields: DataFrame) -> DataFrame:
    """Per document the number of fields of each visit as a map, and whether no field has a visit."""
    n = fields.groupBy("document_id", F.coalesce("visit_id", F.lit("unassigned")).alias("visit_id")).agg(F.count("*").alias("n"))
    return n.groupBy("document_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("visit_id", "n")))).alias("per_visit"), F.bool_and(F.col("visit_id") == "unassigned").alias("all_unassigned"))


def too_long(created: Column, as_of: Column, minutes: int = 2) -> Column:
    """Whether a document has been in processing for more than some minutes."""
    return F.unix_timestamp(as_of) - F.unix_timestamp(created) > 60 * minutes


def display(value: Column, kind: Column) -> Column:
    """A value as it is shown: dates day first, truth values as words, a dash for none."""
    d = F.try_to_date(F.regexp_extract(value, r"^\d{4}-\d{2}-\d{2}", 0), "yyyy-MM-dd")
    low = F.lower(F.trim(value))
    return F.when(F.coalesce(F.trim(value), F.lit("")) == "", MISSING).when((kind == "date") & d.isNotNull(), F.date_format(d, "dd/MM/yyyy")).when((kind == "bool") & low.isin("true", "false"), F.when(low == "true", "Sí").otherwise("No")).otherwise(value)


def garbage(value: Column) -> Column:
    """Whether a detected value is too long, too punctuated or too numeric to be shown."""
    return (F.length(value) > 60) | (F.regexp_count(value, F.lit("[:;|/,]")) >= 2) | (F.regexp_count(value, F.lit(r"\d+")) >= 2)


def vocabulary_suggestions(candidates: DataFrame, most: int = 5, detected_most: int = 3) -> DataFrame:
    """Suggestions for fields with a fixed vocabulary (document_id, key, value, confidence, seq): rows (document_id, key, section, value, confidence, rank).

    A value that is an option counts for it with its highest confidence; a value that holds one option among other words, or none but isn't garbage,
    is only shown as detected, by confidence, those without one last.
    """
    word = lambda x: F.lower(F.trim(x))
    options = F.coalesce(*(F.when((F.col("key") == k) & word(F.col("value")).isin(*ws), name) for k, table in (("sex", SEX_WORDS), ("species", SPECIES_WORDS)) for name, ws in table.items()))
    tokens = F.filter(F.split(word(F.col("value")), r"[^A-Za-zÀ-ÿ]+"), lambda t: t != "")
    held = F.size(F.array_compact(F.array(*(F.when((F.col("key") == k) & F.arrays_overlap(tokens, F.array(*map(F.lit, ws))), name) for k, table in (("sex", SEX_WORDS), ("species", SPECIES_WORDS)) for name, ws in table.items()))))
    c = candidates.filter(F.col("key").isin("sex", "species") & (F.trim("value") != "")).withColumns({"option": options, "held": held, "confidence": F.when(F.col("confidence").isNotNull(), unit(F.col("confidence")))})
    good = c.filter("option is not null").groupBy("document_id", "key", F.col("option").alias("value")).agg(F.max(F.coalesce("confidence", F.lit(0.0))).alias("confidence"), F.min("seq").alias("seq"))
    good = top(good, ["document_id", "key"], [F.desc("confidence"), F.asc("seq")], most).withColumn("section", F.lit("suggestion"))
    names = [*SEX_WORDS, *SPECIES_WORDS]
    seen = c.filter(~word(F.col("value")).isin(*names) & (~garbage(F.col("value")) | ((F.col("held") == 1) & F.col("option").isNull())))
    seen = seen.groupBy("document_id", "key", word(F.col("value")).alias("_w")).agg(F.min_by("value", "seq").alias("value"), F.max("confidence").alias("confidence"), F.min("seq").alias("seq")).drop("_w")
    seen = top(seen, ["document_id", "key"], [F.desc_nulls_last("confidence"), F.asc("seq")], detected_most).withColumn("section", F.lit("detected"))
    return good.unionByName(seen).select("document_id", "key", "section", "value", "confidence", "rank")


def slot_summary(rows: DataFrame, slot: str, critical: Column, member: str, day: str) -> DataFrame:
    """Rows (slot, critical, members, last_day): a slot is critical if any of its rows is; its distinct members and last day."""
    return rows.groupBy(slot).agg(F.bool_or(critical).alias("critical"), F.countDistinct(member).alias("members"), F.date_format(F.max(day), "yyyy-MM-dd").alias("last_day"))
