"""Runs, edits and calibration: state as folds over events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions.normal import same_value
from docloom.functions.scores import review_adjustment
from docloom.operators.keyed import clipped_total, first_of, latest, lookup, without

# fixed values: labels and failures
STATUS_LABELS = {"UPLOADED": "Uploaded", "PROCESSING": "Processing", "COMPLETED": "Ready for review", "FAILED": "Failed", "TIMED_OUT": "Processing timed out"}
KNOWN_FAILURES = ("EXTRACTION_FAILED", "EXTRACTION_LOW_QUALITY", "INTERPRETATION_FAILED", "PROCESS_TERMINATED", "UNKNOWN_ERROR")


def derived_status(state: Column) -> Column:
    """A document's status from its latest run's state; without a run it is just uploaded."""
    return F.when(state.isNull(), "UPLOADED").when(state.isin("QUEUED", "RUNNING"), "PROCESSING").otherwise(state)


def status_label(status: Column) -> Column:
    table = F.create_map(*(F.lit(x) for pair in STATUS_LABELS.items() for x in pair))
    return F.coalesce(table[status], status)


def failure_type(state: Column, failure: Column) -> Column:
    """The failure of a failed run; unknown ones have one name."""
    return F.when(state == "FAILED", F.when(failure.isin(*KNOWN_FAILURES), failure).otherwise("UNKNOWN_ERROR"))


def status_cluster(status: Column, review: Column) -> Column:
    """What a list shows: any failure, then reviewed, completed, else processing."""
    return F.when(status.isin("FAILED", "TIMED_OUT"), "error").when(review == "REVIEWED", "reviewed").when(status == "COMPLETED", "completed").otherwise("processing")


def documents_with_status(documents: DataFrame, runs: DataFrame, document: str = "document_id") -> DataFrame:
    """Documents with their latest run (left join), status, label and failure."""
    newest = latest(runs, [document], ["created_at", "run_id"]).select(document, "run_id", "state", "failure_type")
    d = documents.join(newest, document, "left").withColumn("status", derived_status(F.col("state")))
    return d.withColumn("label", status_label(F.col("status"))).withColumn("failure_type", failure_type(F.col("state"), F.col("failure_type")))


def startable(runs: DataFrame, document: str = "document_id", most: int = 10) -> DataFrame:
    """Queued runs that may start, first come first served: one per document, none where another run is going; at most `most` in one step."""
    queued = without(runs.filter("state = 'QUEUED'"), runs.filter("state = 'RUNNING'"), [document])
    return first_of(queued, [document], [F.asc("created_at"), F.asc("run_id")]).orderBy("created_at", "run_id").limit(most)


def recover_orphans(runs: DataFrame) -> DataFrame:
    """Runs left running by a process that ended count as failed."""
    orphan = F.col("state") == "RUNNING"
    return runs.withColumn("failure_type", F.when(orphan, "PROCESS_TERMINATED").otherwise(F.col("failure_type"))).withColumn("state", F.when(orphan, "FAILED").otherwise(F.col("state")))


def step_events(steps: DataFrame) -> DataFrame:
    """The append-only events of steps (run_id, step, attempt, started_at, ended_at, status, error_code): RUNNING at the start, and the outcome at the end of those that have ended, with its error
    if it failed. step_groups folds them back."""
    none = F.lit(None)
    kinds = dict(steps.dtypes)
    begin = F.struct(F.lit("RUNNING").alias("status"), none.cast(kinds["ended_at"]).alias("ended_at"), none.cast("string").alias("error_code"), F.col("started_at").alias("created_at"))
    end = F.struct("status", "ended_at", F.when(F.col("status") == "FAILED", F.col("error_code")).alias("error_code"), F.col("ended_at").alias("created_at"))
    both = F.array_compact(F.array(begin, F.when(F.col("ended_at").isNotNull() & (F.col("status") != "RUNNING"), end)))
    return steps.select("run_id", "step", "attempt", "started_at", F.explode(both).alias("e")).select("run_id", "step", "attempt", "started_at", "e.*")


def artifacts_of_documents(artifacts: DataFrame, runs: DataFrame, kind: str, document: str = "document_id") -> DataFrame:
    """Artifacts (run_id, artifact_type, ...) of a type with the document of their run, for all documents at once: filtered before the join on the run."""
    return artifacts.filter(F.col("artifact_type") == kind).join(runs.select("run_id", document), "run_id")


def step_groups(events: DataFrame, run: str = "run_id") -> DataFrame:
    """Rows (run, step, attempt): first start, last end (null while one is running), status by failure before running before success."""
    status = F.when(F.bool_or(F.col("status") == "FAILED"), "FAILED").when(F.bool_or(F.col("status") == "RUNNING"), "RUNNING").otherwise("SUCCEEDED")
    going = F.bool_or(F.col("status") == "RUNNING") & ~F.bool_or(F.col("status") == "FAILED")
    return events.withColumn("attempt", F.coalesce("attempt", F.lit(1))).groupBy(run, "step", "attempt").agg(F.min("started_at").alias("started_at"), F.when(~going, F.max("ended_at")).alias("ended_at"), status.alias("status"))


def run_history(runs: DataFrame, steps: DataFrame, document: str = "document_id") -> DataFrame:
    """Rows (document, n, runs): a document's runs in order of creation, each with its steps (run_id, step, started_at) in order of start."""
    done = steps.groupBy("run_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("started_at", "step"))), lambda s: s["step"]).alias("steps"))
    r = runs.join(done, "run_id", "left").withColumn("steps", F.coalesce("steps", F.array().cast("array<string>")))
    return r.groupBy(document).agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("created_at", "run_id", "state", "steps"))).alias("runs"))


def duration_shown(start: Column, end: Column) -> Column:
    seconds = F.unix_timestamp(end) - F.unix_timestamp(start)
    return F.when(seconds < 0, F.lit(None)).when(seconds < 1, "<1s").otherwise(F.concat(seconds.cast("string"), F.lit("s")))


def review_deltas(fields: DataFrame) -> DataFrame:
    """One event per document, field and mapping: an edit by a person outweighs an accepted machine value."""
    edited = F.bool_or(F.col("origin") == "human")
    return fields.groupBy("document_id", "field_key", "mapping_id").agg(edited.alias("edited"), F.bool_or(F.col("origin") == "machine").alias("accepted")).select("document_id", "field_key", "mapping_id", (~F.col("edited") & F.col("accepted")).cast("int").alias("accept_delta"), F.col("edited").cast("int").alias("edit_delta"))


def reverted(deltas: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Deltas of snapshots that are undone, negated; each snapshot once."""
    undone = snapshots.filter("status = 'reverted'").select("snapshot_id").distinct()
    return deltas.join(undone, "snapshot_id", "left_semi").withColumn("accept_delta", -F.col("accept_delta")).withColumn("edit_delta", -F.col("edit_delta"))


def calibration_counts(deltas: DataFrame, scope: list[str], order: list[str]) -> DataFrame:
    """Accept and edit counts per scope; neither falls below 0 after any delta."""
    a = clipped_total(deltas, scope, order, "accept_delta", "accept_count")
    e = clipped_total(deltas, scope, order, "edit_delta", "edit_count")
    return lookup(a, e, [], scope)


_SUMS = {"accept": "accept_delta", "edit": "edit_delta"}


def calibration_state(deltas: DataFrame, scope: list[str], order: list[str]) -> DataFrame:
    """Deltas per scope in a form that further deltas can be added to: rows (*scope, accept_sum, accept_low, edit_sum, edit_low), low the lowest running sum, 0 at most.

    Counts that never fall below 0 depend on the order of all deltas, so counts alone can't take a later retraction right; the sum and its lowest point can, for
    those of two stretches, one after the other, give those of both.
    """
    w = Window.partitionBy(*scope).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = deltas.withColumns({f"_{k}": F.sum(c).over(w) for k, c in _SUMS.items()})
    return run.groupBy(*scope).agg(*(x for k, c in _SUMS.items() for x in (F.sum(c).cast("long").alias(f"{k}_sum"), F.least(F.lit(0), F.min(f"_{k}")).cast("long").alias(f"{k}_low"))))


def added_state(earlier: DataFrame, later: DataFrame, scope: list[str]) -> DataFrame:
    """The state of two stretches of deltas, the first before the second: one row per scope of each side is all that is read. Null scopes match."""
    both = earlier.withColumn("_at", F.lit(0)).unionByName(later.withColumn("_at", F.lit(1)))
    part = lambda c, at: F.coalesce(F.sum(F.when(F.col("_at") == at, F.col(c))), F.lit(0))
    out = [x for k in _SUMS for x in ((part(f"{k}_sum", 0) + part(f"{k}_sum", 1)).alias(f"{k}_sum"), F.least(part(f"{k}_low", 0), part(f"{k}_sum", 0) + part(f"{k}_low", 1)).alias(f"{k}_low"))]
    return both.groupBy(*scope).agg(*out)


def state_counts(state: DataFrame, scope: list[str]) -> DataFrame:
    """Rows (*scope, accept_count, edit_count): what applying all deltas in order, with a floor of 0 after each, has come to."""
    return state.select(*scope, *((F.col(f"{k}_sum") - F.col(f"{k}_low")).alias(f"{k}_count") for k in _SUMS))


def calibrated(fields: DataFrame, counts: DataFrame, keys: list[str], null_keys: list[str]) -> DataFrame:
    """Fields with the adjustment that past reviews of their context give: one join for all fields, null mappings matching null."""
    joined = lookup(fields, counts.select(*keys, *null_keys, "accept_count", "edit_count"), keys, null_keys)
    return joined.withColumn("adjustment", review_adjustment(F.coalesce("accept_count", F.lit(0)), F.coalesce("edit_count", F.lit(0))))


def apply_edits(fields: DataFrame, edits: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(new fields, change log, refused batches) of one version step: batches of edits (document_id, batch, version, op, field_id, value, kind) against fields
    (document_id, field_id, version, value), whose version is their document's.

    A batch is all or nothing: one edit of an unknown field, or an addition of a known one, rejects it. Of a document's batches on the active version the
    first (by batch) without an error is applied and makes the next version; later ones on the same base, and those on any other, are refused with
    BASE_VERSION_MISMATCH. Edits that change nothing aren't logged.
    """
    known = fields.select("document_id", "field_id", F.col("value").alias("old"), F.lit(True).alias("known"))
    active = fields.filter("document_id is not null").groupBy("document_id").agg(F.max("version").alias("active"))
    # one row more per document says its version, and stands before the document's edits: all that follows reads them in one sort by document and batch
    rows = edits.join(known, ["document_id", "field_id"], "left").withColumn("_edit", F.lit(1)).unionByName(active.withColumn("_edit", F.lit(0)), allowMissingColumns=True)
    so_far = lambda *order: Window.partitionBy("document_id").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("active", F.max("active").over(so_far("batch", "_edit"))).filter("_edit = 1")
    error = F.when(~F.col("version").eqNullSafe(F.col("active")), "BASE_VERSION_MISMATCH").when((F.col("op") == "ADD") & F.col("known"), "FIELD_EXISTS").when((F.col("op") != "ADD") & F.col("known").isNull(), "FIELD_NOT_FOUND")
    rows = rows.withColumn("error", error).withColumn("error", F.max("error").over(Window.partitionBy("document_id", "batch")))
    rows = rows.withColumn("first", F.min(F.when(F.col("error").isNull(), F.col("batch"))).over(so_far("batch")))  # no batch before the first is without an error
    good = rows.filter("error is null and batch = first")
    late = F.when(F.col("error").isNull() & (F.col("batch") != F.col("first")), "BASE_VERSION_MISMATCH").otherwise(F.col("error"))
    refused = rows.select("document_id", "batch", late.alias("error")).filter("error is not null").groupBy("document_id", "batch").agg(F.max("error").alias("error"))
    first = good.select("document_id").distinct().withColumn("first", F.lit(True))
    idle = (F.col("op") == "UPDATE") & same_value(F.col("old"), F.col("value"), F.col("kind"))
    log = good.filter(~idle).select("document_id", "batch", "field_id", "op", F.col("old").alias("old_value"), F.when(F.col("op") != "DELETE", F.col("value")).alias("new_value"))
    touched = good.groupBy("document_id", "field_id").agg(F.max(F.struct("op", "value")).alias("e"))  # a batch names a field once
    stepped = fields.join(touched, ["document_id", "field_id"], "left").join(first, "document_id", "left").filter("e is null or e.op != 'DELETE'")
    new = {"value": F.when(F.col("e.op") == "UPDATE", F.col("e.value")).otherwise(F.col("value")), "version": F.col("version") + F.col("first").isNotNull().cast("int")}
    kept = stepped.select(*(new[c].alias(c) if c in new else c for c in fields.columns))
    added = good.filter("op = 'ADD'").select("document_id", "field_id", (F.col("version") + 1).alias("version"), "value")
    return kept.unionByName(added, allowMissingColumns=True), log, refused
