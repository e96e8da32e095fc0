"""Batches of edits are judged in one sort of all edits, and as a plain loop judges them."""

import random

from docloom.operators import state

FIELDS = "document_id int, field_id int, version int, value string"
EDITS = "document_id int, batch int, version int, op string, field_id int, value string, kind string"


def drawn(seed):
    draw = random.Random(seed)
    fields = [(d, f, d % 3, f"v{f}") for d in range(30) for f in range(draw.randrange(4))]
    places = [(d, b, f) for d in range(34) for b in range(6) for f in draw.sample(range(5), draw.randrange(3))]
    edits = [(d, b, draw.choice((d % 3, d % 3, 1)), draw.choice(("UPDATE", "UPDATE", "DELETE", "ADD")), f, draw.choice((" v1 ", "new", None)), "string") for d, b, f in places]
    return fields, edits


def judged(fields, edits):
    """(good batches, errors of the others): a loop over each document's batches in order."""
    active = {d: v for d, _, v, _ in fields}
    known = {(d, f) for d, f, *_ in fields}
    done, errors = {}, {}
    for d, b in sorted({e[:2] for e in edits}):
        own = [e for e in edits if e[:2] == (d, b)]
        bad = ["BASE_VERSION_MISMATCH" if v != active.get(d) else "FIELD_EXISTS" if op == "ADD" and (d, f) in known else "FIELD_NOT_FOUND" if op != "ADD" and (d, f) not in known else "" for _, _, v, op, f, *_ in own]
        if max(bad):
            errors[d, b] = max(bad)
        elif d in done:
            errors[d, b] = "BASE_VERSION_MISMATCH"
        else:
            done[d] = b
    return done, errors


def test_batches_are_judged_as_by_a_loop(spark):
    for seed in (1, 2):
        fields, edits = drawn(seed)
        done, errors = judged(fields, edits)
        new, log, refused = state.apply_edits(spark.createDataFrame(fields, FIELDS), spark.createDataFrame(edits, EDITS))
        assert {(r.document_id, r.batch): r.error for r in refused.collect()} == errors and refused.count() == len(errors) > 50
        good = [e for e in edits if done.get(e[0]) == e[1]]
        old = {(d, f): v for d, f, _, v in fields}
        wanted = [(d, b, f, op) for d, b, _, op, f, value, _ in good if not (op == "UPDATE" and (value or "").strip() == old[d, f])]
        assert sorted((r.document_id, r.batch, r.field_id, r.op) for r in log.collect()) == sorted(wanted) and wanted
        left = {(d, f): (v + (d in done), x) for d, f, v, x in fields}
        for d, _, v, op, f, value, _ in good:
            if op == "DELETE":
                del left[d, f]
            else:
                left[d, f] = (v + 1, value)
        assert {(r.document_id, r.field_id): (r.version, r.value) for r in new.collect()} == left


def test_edits_are_read_and_sorted_once(spark):
    fields, edits = drawn(1)
    _, log, refused = state.apply_edits(spark.createDataFrame(fields, FIELDS), spark.createDataFrame(edits, EDITS).filter("kind != 'mark'"))
    for df in (log, refused):
        assert df._jdf.queryExecution().optimizedPlan().toString().count("= mark)") == 1
        plan = df._jdf.queryExecution().sparkPlan().toString()
        assert plan.count("Join") == 1  # the field that an edit names; versions and first batches come by the sort


def test_edits_without_a_batch_or_document_stay_as_they_are(spark):
    fields = [(1, 1, 1, "a"), (2, 1, 1, "a"), (None, 1, 1, "a")]
    edits = [(1, None, 1, "UPDATE", 1, "b", "string"), (2, None, 2, "UPDATE", 1, "b", "string"), (2, 7, 1, "UPDATE", 1, "c", "string"), (None, 1, 1, "UPDATE", 1, "b", "string")]
    new, log, refused = state.apply_edits(spark.createDataFrame(fields, FIELDS), spark.createDataFrame(edits, EDITS))
    assert sorted(map(tuple, refused.collect()), key=str) == sorted([(2, None, "BASE_VERSION_MISMATCH"), (None, 1, "BASE_VERSION_MISMATCH")], key=str)
    assert [(r.document_id, r.batch, r.new_value) for r in log.collect()] == [(2, 7, "c")]
    assert sorted(map(tuple, new.select("document_id", "version", "value").collect()), key=str) == sorted([(1, 1, "a"), (2, 2, "c"), (None, 1, "a")], key=str)
