"""The side of reviewers: filters over fields, marks and edits of state, policies, fields that are put in or brought into shape."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions.scores import unit
from docloom.functions.text import is_empty
from docloom.operators.keyed import latest

# fixed values: order of steps, the contract's name and version
STEP_ORDER = {"EXTRACTION": 1, "INTERPRETATION": 2}
CHIP_FIELD = {"value_type": "string", "scope": "document", "section": "patient", "classification": "medical_record", "domain": "clinical", "is_critical": "true", "origin": "machine"}


def searched(term: str, label: Column, key: Column, items: Column) -> Column:
    """Whether a field's label, key or any shown value holds a term, whatever its case; a blank term holds everywhere."""
    t = term.strip().lower()
    held = lambda x: F.contains(F.lower(x), F.lit(t))
    return F.lit(True) if not t else held(label) | held(key) | F.exists(items, lambda i: held(i["shown"]))


def banded(bands: Sequence[str], items: Column) -> Column:
    """Whether any value that isn't missing has one of the bands; none counts as unknown. No bands asked for: all fields."""
    return F.exists(items, lambda i: ~i["missing"] & F.coalesce(i["band"], F.lit("unknown")).isin(*bands)) if bands else F.lit(True)


def structured_filter(fields: DataFrame, term: str = "", bands: Sequence[str] = (), only_critical: bool = False, with_value: bool = False, empty: bool = False) -> DataFrame:
    """Fields (key, label, is_critical, repeatable, items array of (shown, band, missing)) that pass all filters; both with_value and empty is neither."""
    valued = F.when(F.col("repeatable"), F.size("items") > 0).otherwise(F.exists("items", lambda i: ~i["missing"]))
    ok = searched(term, F.col("label"), F.col("key"), F.col("items")) & banded(bands, F.col("items"))
    if only_critical:
        ok = ok & F.col("is_critical")
    if with_value != empty:
        ok = ok & (valued if with_value else ~valued)
    return fields.filter(ok)


def latest_completed(runs: DataFrame, document: str = "document_id") -> DataFrame:
    """The completed run of each document that ended last; of several the one created last."""
    return latest(runs.filter("state = 'COMPLETED'"), [document], ["completed_at", "created_at"])


def mark_reviewed(documents: DataFrame, runs: DataFrame, marks: DataFrame) -> DataFrame:
    """Documents after marks (document_id, at, by): the first mark of one that isn't reviewed sets status, time, reviewer and its latest completed run.

    Marking again changes nothing. A document without a completed run is reviewed without one. newly says which rows changed: they are what calibration
    deltas are taken from, once.
    """
    first = marks.groupBy("document_id").agg(F.min(F.struct("at", "by")).alias("m"))
    done = latest_completed(runs).select("document_id", F.col("run_id").alias("_run"))
    d = documents.join(first, "document_id", "left").join(done, "document_id", "left").withColumn("newly", F.col("m").isNotNull() & (F.col("review_status") != "REVIEWED"))
    new = {"review_status": F.lit("REVIEWED"), "reviewed_at": F.col("m.at"), "reviewed_by": F.col("m.by"), "reviewed_run_id": F.col("_run")}
    return d.select(*(F.when(F.col("newly"), new[c]).otherwise(F.col(c)).alias(c) if c in new else c for c in documents.columns), "newly")


def review_states(actions: DataFrame, document: str = "document_id") -> DataFrame:
    """Rows (document, action_id, status, changes) after actions (document, action_id, action MARK or REOPEN, at): the last one decides; changes counts those that altered
    the status, for marking what is reviewed or reopening what isn't does nothing. A document starts in review."""
    w = Window.partitionBy(document).orderBy("at", "action_id")
    altered = F.col("action") != F.coalesce(F.lag("action").over(w), F.lit("REOPEN"))
    judged = actions.withColumn("_altered", altered)
    return judged.groupBy(document).agg(F.max_by(F.struct("action_id", "action"), F.struct("at", "action_id")).alias("_last"), F.count_if("_altered").alias("changes")).select(document, "_last.action_id", F.when(F.col("_last.action") == "MARK", "REVIEWED").otherwise("IN_REVIEW").alias("status"), "changes")


def reopened(documents: DataFrame, asked: DataFrame) -> DataFrame:
    """Documents after requests (document_id) to reopen them: reviewed ones are in review again, without time, reviewer and run; newly says which."""
    d = documents.join(asked.select("document_id", F.lit(True).alias("_asked")).distinct(), "document_id", "left").withColumn("newly", F.coalesce("_asked", F.lit(False)) & (F.col("review_status") == "REVIEWED"))
    new = {"review_status": F.lit("IN_REVIEW")} | {c: F.lit(None) for c in ("reviewed_at", "reviewed_by", "reviewed_run_id")}
    return d.select(*(F.when(F.col("newly"), new[c]).otherwise(F.col(c)).alias(c) if c in new else c for c in documents.columns), "newly")


def upsert_chips(fields: DataFrame, chips: DataFrame) -> DataFrame:
    """Fields after chip numbers (document_id, chip): a document's first chip field (by seq) takes another number, one without the field gets it.

    fields has document_id, field_id, key, value, seq and any of CHIP_FIELD's columns, whose blanks are filled in.
    """
    given = chips.filter("chip is not null and chip != ''").groupBy("document_id").agg(F.min("chip").alias("chip"))
    first = fields.filter("key = 'microchip_id'").groupBy("document_id").agg(F.min("seq").alias("_seq"))
    f = fields.join(given, "document_id", "left").join(first, "document_id", "left")
    hit = (F.col("key") == "microchip_id") & (F.col("seq") == F.col("_seq")) & F.col("chip").isNotNull() & ~F.trim("value").eqNullSafe(F.col("chip"))
    kinds = dict(fields.dtypes)
    filled = {c: F.when(hit, F.coalesce(F.col(c), F.lit(v).cast(kinds[c]))).otherwise(F.col(c)).alias(c) for c, v in CHIP_FIELD.items() if c in kinds}
    patched = f.select(*(F.when(hit, F.col("chip")).otherwise(F.col("value")).alias("value") if c == "value" else filled.get(c, F.col(c)) for c in fields.columns))
    last = fields.groupBy("document_id").agg(F.max("seq").alias("_last"))
    new = given.join(first, "document_id", "left_anti").join(last, "document_id", "left")
    values = {"document_id": F.col("document_id"), "field_id": F.lit("backfill-microchip-id"), "key": F.lit("microchip_id"), "value": F.col("chip"), "seq": F.coalesce(F.col("_last") + 1, F.lit(0))}
    values |= {c: F.lit(v) for c, v in CHIP_FIELD.items()}
    return patched.unionByName(new.select(*(values.get(c, F.lit(None)).cast(kinds[c]).alias(c) for c in fields.columns)))


def policy(version: Column, low: Column, mid: Column) -> Column:
    """struct(ok, reason) of a confidence policy: a version, both limits, 0 <= low < mid <= 1."""
    bad = F.isnan(low) | F.isnan(mid) | (low < 0) | (mid > 1) | (low >= mid)
    reason = F.when(F.coalesce(F.trim(version), F.lit("")) == "", "missing_policy_version").when(low.isNull() | mid.isNull(), "missing_band_cutoffs").when(bad, "invalid_band_cutoffs")
    return F.struct(reason.isNull().alias("ok"), reason.alias("reason"))


def sanitised_confidences(fields: DataFrame) -> DataFrame:
    """Fields with their confidences in range: reliability and candidate between 0 and 1 or null, a history of null is 0; a missing candidate is the mapped
    confidence or 0; the mapped one is made anew; a bare confidence column goes."""
    fine = lambda c: F.when(F.col(c).isNotNull() & ~F.isnan(c), unit(F.col(c)))
    history = F.when(F.col("field_review_history_adjustment").isNull() | F.isnan("field_review_history_adjustment"), F.lit(0.0)).otherwise(F.col("field_review_history_adjustment"))
    out = fields.withColumns({"text_extraction_reliability": fine("text_extraction_reliability"), "field_review_history_adjustment": history, "field_candidate_confidence": F.coalesce(fine("field_candidate_confidence"), fine("field_mapping_confidence"), F.lit(0.0))})
    return out.withColumn("field_mapping_confidence", unit(F.col("field_candidate_confidence") + F.col("field_review_history_adjustment") / 100.0)).drop("confidence")


def utc_z(stamp: Column) -> Column:
    """An ISO time with Z for the offset of UTC."""
    return F.regexp_replace(stamp, r"\+00:00$", "Z")


def shape_errors(present: Column, lists: Column, keys: Sequence[str], repeatable: Sequence[str]) -> Column:
    """What is wrong with a record's shape, given the arrays of its keys and of those that are lists: missing keys in order, then repeatable ones that aren't lists."""
    missing = F.array_except(F.array(*map(F.lit, keys)), present)
    loose = F.transform(F.array_except(F.array(*map(F.lit, repeatable)), lists), lambda k: F.concat(F.lit("Repeatable key '"), k, F.lit("' must be a list")))
    return F.concat(F.when(F.size(missing) > 0, F.array(F.concat(F.lit("Missing keys: "), F.array_join(missing, ", ")))).otherwise(F.array().cast("array<string>")), loose)


def populated_keys(record: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows (document_id, populated): the keys, in order, whose column holds a text that isn't blank or an array that isn't empty."""
    kinds = dict(record.dtypes)
    return record.select("document_id", F.array_compact(F.array(*(F.when(~is_empty(F.col(k), kinds[k]), F.lit(k)) for k in keys))).alias("populated"))


def enqueued(runs: DataFrame, documents: DataFrame) -> DataFrame:
    """Runs and a new queued one for each of documents (document_id, run_id, created_at); the log only grows."""
    return runs.unionByName(documents.select("document_id", "run_id", "created_at").withColumn("state", F.lit("QUEUED")), allowMissingColumns=True)


def completed(runs: DataFrame, ends: DataFrame) -> DataFrame:
    """Runs after ends (run_id, state, failure_type, completed_at): only a running run ends, by the first end of its own."""
    first = ends.groupBy("run_id").agg(F.min(F.struct("completed_at", "state", "failure_type")).alias("e"))
    r = runs.join(first, "run_id", "left").withColumn("_ends", F.col("e").isNotNull() & (F.col("state") == "RUNNING"))
    return r.select(*(F.when(F.col("_ends"), F.col(f"e.{c}")).otherwise(F.col(c)).alias(c) if c in ("state", "failure_type", "completed_at") else c for c in runs.columns))


def created(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, history): new documents and the first entry of each one's status history, from one frame, so that neither comes without the other."""
    return documents, documents.select("document_id", F.lit("UPLOADED").alias("status"), F.col("created_at"))


def ordered_steps(groups: DataFrame, run: str = "run_id") -> DataFrame:
    """Step groups with their position in the run: by start (none first), then the pipeline's order, then attempt. Runs are ordered each by itself, never all at once."""
    order = F.create_map(*(F.lit(x) for pair in STEP_ORDER.items() for x in pair))
    w = Window.partitionBy(run).orderBy(F.coalesce(F.unix_micros("started_at"), F.lit(0)), F.coalesce(order[F.col("step")], F.lit(99)), "attempt")
    return groups.withColumn("position", F.row_number().over(w))


def in_sections(fields: DataFrame, sections: DataFrame, slots: DataFrame) -> DataFrame:
    """Fields with their position in the document, by the order of their section (section, place) and of their slot (key, place): small fixed tables, broadcast; what isn't in them comes last."""
    f = fields.join(F.broadcast(sections.select("section", F.col("place").alias("_s"))), "section", "left").join(F.broadcast(slots.select("key", F.col("place").alias("_k"))), "key", "left")
    w = Window.partitionBy("document_id").orderBy(F.coalesce("_s", F.lit(10**6)), F.coalesce("_k", F.lit(10**6)), "key")
    return f.withColumn("position", F.row_number().over(w)).select(*fields.columns, "position")
