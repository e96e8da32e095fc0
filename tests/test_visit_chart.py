"""The chart of visits: stored payloads, rosters, assignment, mining of each visit's text, the current weight."""

import json

import pytest
from pyspark.sql import functions as F

from docloom.operators import mining, visit_chart as vc, visits

TEXT = """Historial de Luna
- 05/02/2024 - 10:30 - Consulta de control
Peso: 12,5 kg
Diagnóstico: otitis externa
Tratamiento: gotas cada 12 horas
- 01/02/2024 - 09:00 - Revisión general
Peso: 11 kg
Diagnóstico: gastritis
- 05/02/2024 - 18:15 - Control
El perro está mejor. Se recomienda dieta blanda.
"""
FIELDS = "document_id string, field_id string, key string, value string, snippet string, scope string, section string, seq long"


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def texts(spark, *pairs):
    return spark.createDataFrame(list(pairs), "document_id string, text string")


def test_stored_visits_of_any_shape(spark):
    good = {"visits": [{"visit_id": "v1", "visit_date": "5/2/2024", "reason_for_visit": "x", "vet": {"n": 1}, "fields": [{"field_id": "f", "key": "weight", "value": "7 kg", "evidence": {"snippet": "7 kg", "offset": 4}, "origin": "machine"}, 3]}, "oops", {"visit_id": 7, "visit_date": 20240101, "fields": {"a": 1}}, {"visit_id": "unassigned", "fields": []}], "other": 1}
    stored = [("a", json.dumps(good)), ("b", "{broken"), ("c", "[1]"), ("d", '{"visits": "none"}'), ("e", '{"visits": null}'), ("f", "{}"), ("g", None), ("h", "")]
    v, f, bad = vc.parsed_visits(spark.createDataFrame(stored, "document_id string, payload string"))
    assert rows(v.select("visit_id", "date", "reason_for_visit", "no", "rest"), "no") == [("v1", "2024-02-05", "x", 1, '{"vet":{"n":1}}'), (None, None, None, 2, None), ("unassigned", None, None, 3, None)]
    assert rows(f, "field_id") == [("a", "v1", "f", "weight", "7 kg", "7 kg", 4, 0, '{"origin":"machine"}')]
    got = rows(bad, "document_id", "reason")
    assert got == [("a", "FIELDS_NOT_A_LIST", '{"a":1}'), ("a", "FIELD_NOT_AN_OBJECT", "3"), ("a", "VISIT_NOT_AN_OBJECT", '"oops"'), ("b", "PAYLOAD_NOT_AN_OBJECT", "{broken"), ("c", "PAYLOAD_NOT_AN_OBJECT", "[1]"), ("d", "VISITS_NOT_A_LIST", '"none"'), ("h", "PAYLOAD_NOT_AN_OBJECT", "")]


def plain_roster(detected, told, known):
    """Dates in order, then the further ones; what isn't there yet is numbered on."""
    wanted = list(detected) + [d for d in dict.fromkeys(told) for _ in range(told.count(d) - 1)]
    out, n, have, met = [], len(known), {}, {}
    for d in known:
        have[d] = have.get(d, 0) + 1
    for d in wanted:
        met[d] = met.get(d, 0) + 1
        if have.get(d, 0) < met[d]:
            n += 1
            out.append((f"visit-{n:03d}", d, n))
    return out


@pytest.mark.parametrize(("detected", "told", "known"), [(["b", "a"], ["b", "a", "b", "b"], []), (["c", "a", "b"], ["a", "b", "a", "a"], ["a", None, "z"]), (["a"], ["a", "a"], ["a", "a", "a"])])
def test_rosters(spark, detected, told, known):
    dates = spark.createDataFrame([("d", detected)], "document_id string, dates array<string>")
    seen = spark.createDataFrame([("d", x, 10 * i) for i, x in enumerate(told)], "document_id string, date string, offset int")
    have = spark.createDataFrame([("d", f"k{i}", x, i + 1) for i, x in enumerate(known)], "document_id string, visit_id string, date string, no int")
    got = rows(vc.roster(dates, seen, have).filter("visit_id like 'visit-%'").select("visit_id", "date", "no"), "no")
    assert got == plain_roster(detected, told, known)


def test_evidence_without_dates_goes_to_the_only_date(spark):
    seen = spark.createDataFrame([("d", "2024-02-01", 8, 0, 1)], "document_id string, date string, offset int, line_start int, k int")
    roster = spark.createDataFrame([("d", "visit-001", "2024-02-01"), ("e", "visit-001", "2024-02-01"), ("e", "visit-002", "2024-03-01")], "document_id string, visit_id string, date string")
    fields = spark.createDataFrame([("d", "a", "nothing of the text"), ("d", "b", "nacimiento 03/03/2020"), ("d", "c", None), ("e", "d", "nothing of the text")], "document_id string, field_id string, snippet string")
    got = rows(visits.resolved(fields, texts(spark, ("d", "Control 01/02/2024"), ("e", "")), seen, roster).select("field_id", "visit_id", "how"), "field_id")
    assert got == [("a", "visit-001", "only"), ("b", None, "unassigned"), ("c", "visit-001", "only"), ("d", None, "unassigned")]


def test_each_visit_has_what_its_own_text_says(spark):
    docs = texts(spark, ("d", TEXT), ("n", None), ("e", ""))
    seen = visits.occurrences(docs)
    known = vc.no_visits(spark)[0]
    none = spark.createDataFrame([], FIELDS)
    roster = vc.roster(visits.detected_dates(visits.classified(none), seen), seen, known)
    cuts = visits.segments(docs, seen, roster)
    got = rows(vc.segment_fields(cuts).select("visit_id", "key", "value"), "visit_id", "key")
    alone = []
    for c in cuts.collect():  # each segment as a text of its own
        mined = mining.mine(texts(spark, ("x", c.segment))).filter(F.col("key").isin(*vc.SEGMENT_KEYS)).collect()
        for key in {m.key for m in mined}:
            own = sorted((m for m in mined if m.key == key), key=lambda m: m.seq)
            alone.append((c.visit_id, key, (max(own, key=lambda m: m.offset) if key == "weight" else own[0]).value))
    assert got == sorted(alone) and len({v for v, _, _ in got}) >= 2
    listed, fields, of_docs = vc.chart(docs, none)
    assert rows(listed.select("visit_id", "date", "position"), "position") == [("visit-002", "2024-02-01", 1), ("visit-001", "2024-02-05", 2), ("visit-003", "2024-02-05", 3)]
    values = {(r.visit_id, r.key): r.value for r in fields.collect()}
    assert values["visit-001", "diagnosis"] == "otitis externa" and values["visit-002", "diagnosis"] == "gastritis" and ("visit-003", "diagnosis") not in values
    assert values["visit-001", "weight"].startswith("12,5") and values["visit-002", "weight"].startswith("11")
    assert "dieta blanda" in values["visit-003", "actions"]
    assert rows(of_docs.select("document_id", "field_id", "value"), "document_id") == [("d", "derived-weight-current", "12.5 kg")]


def test_stored_visits_keep_their_fields_and_come_first(spark):
    payload = json.dumps({"visits": [{"visit_id": "mine", "visit_date": "05/02/2024", "reason_for_visit": "vacuna", "fields": [{"field_id": "k", "key": "diagnosis", "value": "sano"}]}]})
    v, f, _ = vc.parsed_visits(spark.createDataFrame([("d", payload)], "document_id string, payload string"))
    listed, fields, _ = vc.chart(texts(spark, ("d", TEXT)), spark.createDataFrame([], FIELDS), v, f)
    assert rows(listed.select("visit_id", "reason_for_visit"), "position")[1][0] == "mine" and [r.reason_for_visit for r in listed.filter("visit_id = 'mine'").collect()] == ["vacuna"]
    got = {(r.visit_id, r.key): (r.value, r.origin) for r in fields.collect()}
    assert got["mine", "diagnosis"] == ("sano", "stored") and got["mine", "weight"][1] == "derived"


def test_the_current_weight_is_the_latest_of_three_sources(spark):
    roster = spark.createDataFrame([("d", "v1", "2024-01-05", 1), ("d", "v2", None, 2), ("t", "v1", "2024-01-05", 1)], "document_id string, visit_id string, date string, no int")
    own = spark.createDataFrame([("d", "v1", "weight", "5 kg", "x", 3, 1), ("d", "v2", "weight", "6 kg", "control 07/01/2024", None, 1), ("t", "v1", "weight", "4 kg", "x", 9, 1), ("t", "v1", "weight", "4500 g", "y", 9, 2), ("u", "v9", "weight", "1 kg", "x", 1, 1)], "document_id string, visit_id string, key string, value string, snippet string, offset int, field_no int")
    loose = spark.createDataFrame([("d", "weight", "8 kg", "peso 06/01/2024", 5, 1), ("d", "weight", "9 kg", "sin fecha", 5, 2), ("f", "weight", "3 kg", "el 01/01/2024 y 02/01/2024", None, 1)], "document_id string, key string, value string, snippet string, offset int, seq int")
    docs = texts(spark, ("d", "Peso 1 kg\n- 07/01/2024 - 10:00 - x\nPV 7,25 kg"), ("f", "- 01/01/2024 - 10:00\n2 kg"), ("n", None))
    got = rows(vc.current_weights(vc.weight_candidates(own, loose, roster, docs)), "document_id")
    # d: 7 January both in the undated visit's evidence and in the text: the later source wins at the same place; f: equal dates and places, the text comes after
    assert got == [("d", "2024-01-07", "7.25 kg", "PV 7,25 kg"), ("f", "2024-01-01", "2 kg", "2 kg"), ("t", "2024-01-05", "4.5 kg", "y")]
