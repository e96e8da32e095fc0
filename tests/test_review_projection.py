"""Views, ages, sections and orders for reviewers; logs of documents and runs; reports; emptiness; both sides of boundaries; texts that mining skips."""

import json
import random

from pyspark.sql import functions as F

from docloom.functions.text import is_empty
from docloom.operators import keyed, mining, observe, record, review, review_projection as rp
from docloom.sources.files import accuracy_cases, contract_errors, read_contract


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def test_a_record_s_own_view_stays_where_it_has_the_right_kind(spark):
    own = {"medical_record_view": {"version": "x", "sections": ["a"], "field_slots": "none"}, "schema_version": 1, "visits": [{}], "other_fields": 3, "fields": [], "n": 2}
    df = rp.canonical_view(spark.createDataFrame([("a", json.dumps(own)), ("b", "{}"), ("c", "[]"), ("d", "{"), ("e", None), ("f", '{"medical_record_view": 5}')], "document_id string, payload string"))
    got = {r.document_id: r for r in df.collect()}
    assert sorted(got) == ["a", "b", "f"]
    a, b = got["a"], got["b"]
    assert (a.version, a.sections, a.visits, a.other_fields, json.loads(a.rest)) == ("x", '["a"]', "[{}]", "[]", {"fields": [], "n": 2})
    assert json.loads(b.sections) == list(rp.SECTIONS) and len(json.loads(b.field_slots)) == 17 and json.loads(a.field_slots) == json.loads(b.field_slots)
    nhc = json.loads(b.field_slots)[3]
    assert nhc == {"concept_id": "clinic.nhc", "section": "clinic", "scope": "document", "canonical_key": "nhc", "aliases": ["medical_record_number"], "label_key": "nhc"}
    assert (got["f"].version, b.schema_contract) == ("mvp-1", "visit-grouped-canonical")


def test_ages(spark):
    records = spark.createDataFrame([("m", None, "01/06/2023", None), ("y", " ", "15/03/2019", "01/01/2024"), ("g", "4", "15/03/2019", None), ("future", None, "01/01/2030", None), ("none", None, None, None), ("h", None, "15/03/2019", None)], "document_id string, age string, dob string, document_date string")
    fields = spark.createDataFrame([("h", "f", "age", " 6 ", "human", None, 2, None), ("h", "g", "age", "9", "machine", None, 3, None), ("m", "n", "notes", "x", "machine", None, 4, None)], "document_id string, field_id string, key string, value string, origin string, display_value string, seq int, is_critical boolean")
    visits = spark.createDataFrame([("m", "2023-11-30"), ("m", "2031-01-01"), ("y", "bad")], "document_id string, date string")
    ages = rp.projected_ages(records, fields, visits, F.lit("2024-02-01").cast("date"))
    assert rows(ages, "document_id") == [("g", "4", "machine", "4 años"), ("h", "6", "human", "6 años"), ("m", "0", "derived", "5 meses"), ("y", "4", "derived", "4 años")]
    got = rows(rp.upsert_ages(fields, ages).filter("key = 'age'").select("document_id", "field_id", "value", "origin", "display_value", "seq", "is_critical"), "document_id", "seq")
    assert got == [("g", "backfill-age", "4", "machine", "4 años", 0, True), ("h", "f", "6", "human", "6 años", 2, True), ("h", "g", "9", "machine", None, 3, None), ("m", "backfill-age", "0", "derived", "5 meses", 5, True), ("y", "backfill-age", "4", "derived", "4 años", 0, True)]


def test_sections_by_fallbacks(spark):
    cases = [("x", " Clinic ", "z", "Centro Veterinario"), ("notes", None, "patient", "Notas internas"), ("owner_name", "unknown", "z", "Propietario"), ("x", None, "visits", "Visitas"), ("x", "Clinico", "z", "Visitas"), ("x", None, "Clinico", "Visitas"), ("x", "mine", "given", "given")]
    df = spark.createDataFrame(cases, "key string, section string, fallback string, want string")
    assert all(r.got == r.want for r in df.select("want", rp.section_shown(F.col("key"), F.col("section"), F.col("fallback")).alias("got")).collect())


def test_definitions_of_visits_fields(spark):
    f = [("d", "b", 5, "string", "visit", None, True), ("d", "a", 2, "date", "visit", "x", None), ("d", "b", 1, "number", "visit", "x", False), ("d", "c", 0, "string", "visit", "other", True), ("d", "e", 0, "string", "document", None, True)]
    got = rp.visit_definitions(spark.createDataFrame(f, "document_id string, key string, seq int, value_type string, scope string, classification string, is_critical boolean"))
    assert rows(got.select("key", "section", "position", "value_type", "repeatable", "critical"), "position") == [("b", "Visitas", 3000, "number", True, False), ("a", "Visitas", 3001, "date", True, False)]


def test_positions_are_those_of_each_document(spark):
    groups = spark.createDataFrame([("r", "INTERPRETATION", 1, "2024-01-02"), ("r", "EXTRACTION", 2, "2024-01-01"), ("r", "EXTRACTION", 1, "2024-01-01"), ("r", "X", 1, None), ("s", "X", 1, None)], "run_id string, step string, attempt int, at string").withColumn("started_at", F.col("at").cast("timestamp"))
    assert [r[:3] for r in rows(review.ordered_steps(groups).select("run_id", "step", "attempt", "position"), "run_id", "position")] == [("r", "X", 1), ("r", "EXTRACTION", 1), ("r", "EXTRACTION", 2), ("r", "INTERPRETATION", 1), ("s", "X", 1)]
    fields = spark.createDataFrame([("d", "z", "s2"), ("d", "b", "s1"), ("d", "a", "s1"), ("d", "q", "none"), ("e", "a", "s1")], "document_id string, key string, section string")
    sections, slots = spark.createDataFrame([("s1", 1), ("s2", 0)], "section string, place int"), spark.createDataFrame([("b", 0), ("a", 1)], "key string, place int")
    assert rows(review.in_sections(fields, sections, slots).select("document_id", "key", "position"), "document_id", "position") == [("d", "z", 1), ("d", "b", 2), ("d", "a", 3), ("d", "q", 4), ("e", "a", 1)]
    report = spark.createDataFrame([("d", "a", 1, 0), ("d", "b", 2, 0), ("d", "c", 1, 5), ("e", "a", 0, 0)], "doc string, field string, missing int, rejected int")
    assert rows(observe.in_order(report, "doc").select("doc", "field", "position"), "doc", "position") == [("d", "b", 1), ("d", "c", 2), ("d", "a", 3), ("e", "a", 1)]


def test_logs_grow_by_what_is_new(spark):
    docs = spark.createDataFrame([("d", "2024-01-01")], "document_id string, created_at string")
    new, history = review.created(docs)
    assert rows(new, "document_id") == [("d", "2024-01-01")] and rows(history, "document_id") == [("d", "UPLOADED", "2024-01-01")]
    runs = spark.createDataFrame([("d", "r1", "2024-01-01", "COMPLETED", None)], "document_id string, run_id string, created_at string, state string, failure_type string")
    asked = spark.createDataFrame([("d", "r2", "2024-01-02")], "document_id string, run_id string, created_at string")
    assert rows(review.enqueued(runs, asked).select("run_id", "state", "failure_type"), "run_id") == [("r1", "COMPLETED", None), ("r2", "QUEUED", None)]


def test_reports_of_candidates_and_dates(spark):
    report = spark.createDataFrame([("d", "a", 2), ("d", "b", 1), ("d", "c", 0), ("e", "a", 1)], "doc string, field string, missing int")
    some = spark.createDataFrame([("d", "a"), ("d", "a"), ("e", "z")], "doc string, field string")
    assert rows(observe.candidate_gaps(report, some, "doc"), "doc") == [("d", 1, 1), ("e", 0, 1)]
    best = spark.createDataFrame([("d", "visit_date", 1, "consulta", 4, "anchor:consulta"), ("d", "visit_date", 2, "x", 1, "y"), ("d", "dob", 1, "z", 3, "w"), ("d", "document_date", 1, None, None, None)], "document_id string, key string, rank int, anchor string, priority int, reason string")
    assert rows(observe.date_choices(best), "key") == [("d", "document_date", None, 0, None), ("d", "visit_date", "consulta", 4, "anchor:consulta")]


def test_accuracy_of_cases(spark, tmp_path):
    path = tmp_path / "cases.json"
    path.write_text(json.dumps({"cases": [{"expected": "Luna", "got": "luna "}, {"expected": "x", "got": None}, {"expected": None, "got": "y"}, {"expected": None, "got": ""}]}))
    got = record.accuracy(accuracy_cases(spark, str(path))).first()
    assert tuple(got) == (4, 0.5, 0.25, 0.25)


def test_what_counts_as_empty(spark):
    df = spark.createDataFrame([(None, None, None), (" ", [], 0), ("x", [None], 1)], "s string, a array<string>, n int")
    assert [tuple(r) for r in df.select(*(is_empty(F.col(c), k).alias(c) for c, k in df.dtypes)).collect()] == [(True, True, True), (True, True, False), (False, False, False)]


def test_marks_on_both_sides(spark):
    rng = random.Random(3)
    left = [(rng.choice("ab"), rng.randrange(30), i) for i in range(80)]
    marks = [(rng.choice("abc"), rng.randrange(30)) for _ in range(15)]
    got = keyed.enclosed(spark.createDataFrame(left, "k string, at int, i int"), spark.createDataFrame(marks, "k string, m int"), ["k"], "at", "m")
    want = [(k, at, i, max((m for c, m in marks if c == k and m <= at), default=None), min((m for c, m in marks if c == k and m > at), default=None)) for k, at, i in left]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)


def test_texts_that_mining_skips_hold_nothing(spark, monkeypatch):
    """Mining with the look at hint words equals mining of every text, on texts put together from pieces of cards and of plain prose."""
    rng = random.Random(12)
    pieces = ["Paciente: Luna", "Especie: Canina", "M", "macho", "12/03/2020", "peso 7 kg", "7kg", "Tel: 600123123", "chip", "941000024967769", "Nota", "el perro come", "C/ Mayor 3", "- 05/02/2024 -", "a: b", "LAB: ok", "TAC - normal", "nada de nada", "The council met on Tuesday", "x" * 30, "n: 5", "p. 4", "HV Norte", "cada 8 h", "20 mg", "cura", "sutura", "TOBY", "Color: negro", "9 de mayo", "Dra: Gil"]
    texts = ["\n".join(rng.choices(pieces, k=rng.randrange(1, 5))) for _ in range(150)] + pieces
    docs = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "document_id string, text string")
    cols = ("document_id", "key", "seq", "value", "snippet", "confidence", "offset")
    got = mining.mine(docs).select(*cols).collect()
    monkeypatch.setattr(mining, "hinted", lambda d: d)
    assert sorted(map(repr, got)) == sorted(map(repr, mining.mine(docs).select(*cols).collect())) and len(got) > 100
    assert spark.conf.get("spark.sql.codegen.hugeMethodLimit", None) in (None, "65535")


def test_contracts_from_files(spark, tmp_path):
    field = lambda k, t="string": {"key": k, "label": k, "section": "s", "value_type": t, "repeatable": False, "critical": True, "optional": False}
    path = tmp_path / "contract.json"
    path.write_text(json.dumps({"contract_name": "n", "contract_revision": "r", "fields": [field("b"), field("a", ""), field("b"), field(" "), field("c")]}))
    got = read_contract(spark, str(path))
    assert rows(got.select("position", "key", "critical", "contract_revision"), "position") == [(0, "b", True, "r"), (1, "a", True, "r"), (2, "b", True, "r"), (3, " ", True, "r"), (4, "c", True, "r")]
    assert rows(contract_errors(got), "key") == [(" ", "MISSING_KEY"), ("a", "MISSING_TYPE"), ("b", "DUPLICATE_KEY")]
