"""Batches of edits folded into versions: each batch sees what the one before it made."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.functions.normal import same_value
from docloom.sources.scratch import written

OPS = ("ADD", "UPDATE", "DELETE")
_OUT = "part string, document_id string, batch long, version int, at int, field_id string, op string, old_value string, new_value string, kind string, error string"


class _Document:
    """A document's version and fields while its batches go by: what one fold step needs, whatever the number of batches."""

    def __init__(self, key: str):
        self.key, self.version, self.fields, self.started = key, None, {}, False

    def apply(self, batch: int, base: int | None, edits: list[dict]) -> list[tuple]:
        """Rows of the log, or of the refusal, of one batch; all of it or nothing takes effect."""
        if not self.started:
            error = "DOCUMENT_NOT_FOUND"
        else:
            error = None if base == self.version else "BASE_VERSION_MISMATCH"
        new, log = dict(self.fields), []
        for i, e in enumerate(edits if error is None else ()):
            field, op = e["field_id"], e["op"]
            known = field in new
            if op not in OPS:
                error = "INVALID_OP"
            elif known == (op == "ADD"):
                error = "FIELD_EXISTS" if known else "FIELD_NOT_FOUND"
            if error:
                break
            old = new.pop(field) if op == "DELETE" else new.get(field)
            if op != "DELETE":
                new[field] = e["value"]
            log.append(("log", self.key, batch, self.version + 1, i, field, op, old, None if op == "DELETE" else e["value"], e["kind"], None))
        if error:
            return [("refused", self.key, batch, base, None, None, None, None, None, None, error)]
        self.fields, self.version = new, self.version + 1
        return log

    def rest(self) -> list[tuple]:
        return [("field", self.key, None, self.version, None, field, None, None, value, None, None) for field, value in self.fields.items()]


def apply_edit_chain(fields: DataFrame, edits: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(fields, change log, refused batches) after all batches of edits (document_id, batch, version, seq, op, field_id, value, kind) against fields (document_id, field_id,
    version, value).

    A document's batches are taken by batch; each names the version it was made on. If that is the active one and every edit in it (by seq) can be done, the batch makes the
    next version, which the following batch sees; else all of it is refused: BASE_VERSION_MISMATCH, FIELD_NOT_FOUND, FIELD_EXISTS, INVALID_OP, or
    DOCUMENT_NOT_FOUND where there are no fields. Edits inside a batch see those before them. Updates that change nothing aren't logged, but make a version as others do.

    Rows are dealt out by document and sorted within tasks; one scan folds them. A document needs memory for its fields and one batch, never for all its batches; they follow from one
    another, so one task goes through them, however many there are. Null values are values; rows with a null document_id are a document of their own.
    """
    have = fields.select(F.col("document_id").cast("string").alias("document_id"), F.lit(0).alias("step"), F.lit(None).cast("long").alias("batch"), F.col("version").cast("int").alias("version"), F.lit(None).cast("long").alias("seq"), F.lit(None).cast("string").alias("op"), F.col("field_id").cast("string").alias("field_id"), F.col("value").cast("string").alias("value"), F.lit(None).cast("string").alias("kind"))
    asked = edits.select(F.col("document_id").cast("string").alias("document_id"), F.lit(1).alias("step"), F.col("batch").cast("long").alias("batch"), F.col("version").cast("int").alias("version"), F.col("seq").cast("long").alias("seq"), F.upper("op").alias("op"), F.col("field_id").cast("string").alias("field_id"), F.col("value").cast("string").alias("value"), F.col("kind").cast("string").alias("kind"))
    order = ("document_id", "step", "batch", "seq", "field_id")
    names = [c.split()[0] for c in _OUT.split(", ")]

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([(n, {"long": pa.int64(), "int": pa.int32()}.get(c.split()[1], pa.string())) for n, c in zip(names, _OUT.split(", "), strict=True)])
        doc, held, base, number, out = None, [], None, None, []

        def close() -> None:
            nonlocal held
            if held:
                out.extend(doc.apply(number, base, held))
                held = []

        def handed() -> pa.RecordBatch:
            rows, out[:] = list(out), []
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

        for b in batches:
            for r in b.to_pylist():
                if doc is None or r["document_id"] != doc.key:
                    if doc is not None:
                        close()
                        out.extend(doc.rest())
                    doc = _Document(r["document_id"])
                if r["step"] == 0:
                    doc.started, doc.version = True, max(doc.version or 0, r["version"] or 0)
                    doc.fields[r["field_id"]] = r["value"]
                    continue
                if held and r["batch"] != number:
                    close()
                number, base = r["batch"], r["version"] if not held else base
                held.append(r)
                if len(out) > 10_000:
                    yield handed()
        if doc is not None:
            close()
            out.extend(doc.rest())
        if out:
            yield handed()

    rows = have.unionByName(asked).repartition("document_id").sortWithinPartitions(*order)
    done = written(rows.mapInArrow(fold, _OUT), "edits")
    idle = (F.col("op") == "UPDATE") & same_value(F.col("old_value"), F.col("new_value"), F.col("kind"))
    log = done.filter("part = 'log'").filter(~idle).select("document_id", "batch", "version", "at", "field_id", "op", "old_value", "new_value")
    return done.filter("part = 'field'").select("document_id", "field_id", "version", F.col("new_value").alias("value")), log, done.filter("part = 'refused'").select("document_id", "batch", "version", "error")
