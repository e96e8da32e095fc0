import random

from pyspark.sql import functions as F

from docloom.operators import keyed, mining, observe, quality_gate, state, visits


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def test_clipped_total_is_a_fold(spark):
    rng = random.Random(3)
    data = [(k, i, rng.choice([-1, 1, -2, 2])) for k in range(20) for i in range(rng.randrange(1, 30))]
    want = {}
    for k, _, x in data:
        want[k] = max(0, want.get(k, 0) + x)
    got = keyed.clipped_total(spark.createDataFrame(data, "k int, i int, x int"), ["k"], ["i"], "x", "n")
    assert {r.k: r.n for r in got.collect()} == want


def test_nearest_equals_brute_force(spark):
    rng = random.Random(5)
    left = [(k, i, rng.randrange(50)) for k in range(5) for i in range(20)]
    right = [(k, 100 + i, rng.randrange(50)) for k in range(4) for i in range(6)]
    got = keyed.nearest(spark.createDataFrame(left, "k int, i int, p int"), spark.createDataFrame(right, "k int, j int, q int"), ["k"], "p", "q", "j")
    for r in got.collect():
        best = min(((abs(q - r.p), q, j) for k, j, q in right if k == r.k), default=(None, None, None))
        assert (r.nearest_place, r.nearest_id) == best[1:]
    assert got.count() == len(left)


def test_null_safe_lookup(spark):
    a = spark.createDataFrame([(1, None), (1, "x"), (2, "y")], "k int, m string")
    b = spark.createDataFrame([(1, None, 7), (1, "x", 8)], "k int, m string, v int")
    assert rows(keyed.lookup(a, b, ["k"], ["m"]), "k", "m") == [(1, None, 7), (1, "x", 8), (2, "y", None)]


def test_commonest_breaks_ties_by_first_seen(spark):
    df = spark.createDataFrame([(1, "b", 2), (1, "a", 3), (1, "b", 4), (1, "a", 1), (2, None, 1)], "k int, v string, o int")
    assert rows(keyed.commonest(df, ["k"], "v", "o"), "k") == [(1, "a", 2)]


def test_first_wins_folds(spark):
    df = spark.createDataFrame([(1, "Straße", 1), (1, "STRASSE", 2), (1, "x", 3)], "k int, v string, o int")
    assert [r[1] for r in rows(keyed.first_wins(df, ["k"], "v", "o"), "o")] == ["Straße", "x"]


def test_runs(spark):
    runs = spark.createDataFrame([("a", "r1", "QUEUED", 1), ("a", "r2", "QUEUED", 2), ("b", "r3", "QUEUED", 0), ("b", "r4", "RUNNING", 1), ("c", "r5", "FAILED", 1)], "document_id string, run_id string, state string, created_at int")
    assert rows(state.startable(runs).select("document_id", "run_id"), "run_id") == [("a", "r1")]
    docs = spark.createDataFrame([("a",), ("c",), ("z",)], "document_id string")
    got = state.documents_with_status(docs, runs.withColumn("failure_type", F.lit("odd")))
    assert rows(got.select("document_id", "status", "failure_type"), "document_id") == [("a", "PROCESSING", None), ("c", "FAILED", "UNKNOWN_ERROR"), ("z", "UPLOADED", None)]


def test_edits_are_all_or_nothing(spark):
    fields = spark.createDataFrame([("d", f"f{i}", 1, v) for i, v in ((1, "a"), (2, "b"), (3, "c"))] + [("e", "f1", 4, "x")], "document_id string, field_id string, version int, value string")
    edits = spark.createDataFrame(
        [("d", 1, 1, "UPDATE", "f1", "A", "string"), ("d", 1, 1, "UPDATE", "gone", "x", "string"), ("d", 2, 1, "DELETE", "f2", None, "string"), ("d", 2, 1, "ADD", "f9", "n", "string"), ("d", 2, 1, "UPDATE", "f3", " c ", "string"), ("d", 3, 1, "UPDATE", "f1", "B", "string"), ("d", 4, 1, "ADD", "f1", "B", "string"), ("e", 5, 3, "UPDATE", "f1", "y", "string")],
        "document_id string, batch int, version int, op string, field_id string, value string, kind string",
    )
    new, log, refused = state.apply_edits(fields, edits)
    assert rows(new.select("document_id", "field_id", "version", "value"), "document_id", "field_id") == [("d", "f1", 2, "a"), ("d", "f3", 2, " c "), ("d", "f9", 2, "n"), ("e", "f1", 4, "x")]
    assert rows(log.select("batch", "field_id", "op"), "batch", "field_id") == [(2, "f2", "DELETE"), (2, "f9", "ADD")]
    assert rows(refused.select("batch", "error"), "batch") == [(1, "FIELD_NOT_FOUND"), (3, "BASE_VERSION_MISMATCH"), (4, "FIELD_EXISTS"), (5, "BASE_VERSION_MISMATCH")]


def test_quality_gate_cases(spark):
    words = "El paciente acude a consulta por tos y fiebre desde ayer.\n" * 5
    df = spark.createDataFrame([(1, words), (2, "short"), (3, None), (4, "#" * 200), (5, "diene " + words), (6, "12345 " * 20)], "doc_id int, text string")
    got = {r.doc_id: (r.quality_pass, r.reasons) for r in quality_gate.assess(df).collect()}
    assert got[1] == (True, "") and got[2] == (False, "TOO_SHORT") and got[3] == (False, "TOO_SHORT")
    assert got[4] == (False, "NOT_HUMAN_READABLE") and got[5] == (False, "SUSPICIOUS_SUBSTITUTIONS") and got[6] == (False, "NOT_HUMAN_READABLE")


DOC = """CENTRO VETERINARIO
Paciente: LUNA
Especie: Canina
Sexo: Hembra
Peso: 7,2 kg
Microchip: 941000024967769
Fecha de nacimiento: 05/07/2018
Capa: negra con manchas blancas en el pecho y en las patas delanteras, pelo corto
Sin alergias conocidas ni intervenciones anteriores que consten en la ficha
Visita: 11/02/2026
Diagnostico: otitis
Tratamiento: gotas cada 12 horas
"""


def test_mining_and_ranking(spark):
    docs = spark.createDataFrame([("d", DOC), ("empty", ""), ("null", None)], "document_id string, text string")
    best = {r.key: r.value for r in mining.ranked(mining.mine(docs)).filter("rank = 1").collect()}
    assert best["pet_name"].upper() == "LUNA" and best["microchip_id"] == "941000024967769" and best["dob"] == "05/07/2018"
    assert best["visit_date"] == "11/02/2026" and best["diagnosis"] == "otitis" and best["weight"].startswith("7,2") and best["medication"].startswith("gotas")
    assert mining.record(mining.ranked(mining.mine(docs))).count() == 1


def test_visits(spark):
    text = "Visita: 01/02/2024\nperro sano\nFactura 03/02/2024\nControl 05/02/2024\nmejor\nControl 05/02/2024\n"
    docs = spark.createDataFrame([("d", text), ("e", None)], "document_id string, text string")
    seen = visits.occurrences(docs)
    assert rows(seen.select("date", "k"), "offset") == [("2024-02-01", 1), ("2024-02-05", 1), ("2024-02-05", 2)]
    known = spark.createDataFrame([("d", "visit-001", "2024-02-05")], "document_id string, visit_id string, date string")
    assert rows(visits.missing_visits(seen, known), "visit_id") == [("d", "visit-002", "2024-02-01"), ("d", "visit-003", "2024-02-05")]
    roster = known.unionByName(visits.missing_visits(seen, known))
    parts = rows(visits.segments(docs, seen, roster).select("visit_id", "segment"), "start")
    assert parts == [("visit-002", "Visita: 01/02/2024\nperro sano\nFactura 03/02/2024"), ("visit-001", "Control 05/02/2024\nmejor"), ("visit-003", "Control 05/02/2024")]
    head = spark.createDataFrame([("h", "x\nVisita consulta general del dia 01/02/2024\nsano\nVisita administrativa del dia siguiente\npago")], "document_id string, text string")
    one = spark.createDataFrame([("h", "visit-001", "2024-02-01")], "document_id string, visit_id string, date string")
    assert [r.segment for r in visits.segments(head, visits.occurrences(head), one).collect()] == ["Visita consulta general del dia 01/02/2024\nsano"]
    weighed = spark.createDataFrame([("w", "- 01/02/2024 - 10:30 - visita\nPeso 7,5 kg\n- 05/02/2024 - 9:15 - control\n8 kg")], "document_id string, text string")
    assert rows(visits.latest_weight(weighed), "document_id") == [("w", "2024-02-05", "8 kg", "8 kg")]


def test_assignment_strategies(spark):
    v = spark.createDataFrame([("d", "v1", "2024-01-01", 10), ("d", "v2", "2024-02-01", 100), ("e", "v1", "2024-01-01", None)], "document_id string, visit_id string, date string, offset int")
    f = spark.createDataFrame([("d", "a", "2024-02-01", 5), ("d", "b", None, 20), ("e", "c", None, None), ("z", "x", None, None)], "document_id string, field_id string, evidence_date string, offset int")
    assert rows(visits.assign(f, v).select("field_id", "visit_id", "how"), "field_id") == [("a", "v2", "date"), ("b", "v1", "place"), ("c", "v1", "only"), ("x", None, "unassigned")]


def test_triage(spark):
    rows_ = [("r", "owner_address", "Calle Sol 1, Madrid", "accepted"), ("r", "clinic_address", "calle sol 1, madrid", "accepted"), ("r", "sex", None, "missing"), ("r", "weight", "7 kg", "accepted"), ("q", "weight", "700 kg", "accepted"), ("q", "age", "x", "rejected")]
    got = {r.run: (r.missing, r.rejected, r.suspicious) for r in observe.triage(spark.createDataFrame(rows_, "run string, field string, value string, status string"), ["run"]).collect()}
    assert got == {"r": ("sex", "", "owner_address:owner_address_matches_clinic_address"), "q": ("", "age", "weight:weight_out_of_range")}


def test_clauses(spark):
    from docloom.operators import clauses

    text = "- 11/02/2026 Visita\nAcude para revision de oido. Inflamación leve; se recomienda gotas cada 12 horas.\nExploración: normal\nDar 2 comprimidos\nrecordatorio\nInflamación leve\n"
    df = spark.createDataFrame([(1, text), (2, None), (3, "recordatorio")], "id int, segment string")
    got = {r.id: (r.observations, r.actions) for r in clauses.observations_actions(df).collect()}
    assert got[1] == ("Visita Acude para revision de oido Inflamación leve Exploración: normal", "se recomienda gotas cada 12 horas Dar 2 comprimidos recordatorio")
    assert got[2] == (None, None) and got[3] == ("recordatorio", None)
    assert [r[0] for r in df.select(clauses.reason_for_visit(F.col("segment"))).collect()] == ["Visita", None, "recordatorio"]


def test_validators(spark):
    from docloom.functions import validators as v

    cases = [("microchip", "941000024967769 x", "941000024967769", None), ("microchip_id", "abc", None, "non-digit"), ("microchip_id", "123", None, "invalid-length"), ("peso", "7,5 kg", "7.5 kg", None), ("weight", "0", None, "empty"), ("weight", "500", None, "invalid-weight"), ("dob", "5/7/70", "1970-07-05", None), ("dob", "31/02/2020", None, "invalid-date"), ("visit_date", "2024-01-05T10:00", "2024-01-05", None), ("sexo", "Female", "hembra", None), ("species", "pez", None, "invalid-species"), ("age", "7", "7", None), ("notes", " x ", "x", None), ("notes", " ", None, "empty")]
    df = spark.createDataFrame([(i, k, x) for i, (k, x, _, _) in enumerate(cases)], "i int, k string, x string").select("i", v.accept(F.col("k"), F.col("x")).alias("r")).orderBy("i")
    assert [(r.r.normalized, r.r.reason) for r in df.collect()] == [(n, why) for _, _, n, why in cases]
    rows_ = [("microchip_id", "612345678"), ("weight", "7 lb"), ("species", "pez"), ("owner_address", "Calle Sol 1, Madrid"), ("dob", "01/01/2024"), ("pet_name", "Datos"), ("notes", "x" * 81), ("clinic_name", "12")]
    df = spark.createDataFrame(rows_, "k string, x string").select(v.suspicious(F.col("k"), F.col("x"), F.lit("CALLE SOL 1, MADRID"), F.lit("01/01/2024"), F.lit("2026-01-01").cast("date")).alias("f"))
    assert [r.f for r in df.collect()] == [["microchip_phone_like_digits"], ["weight_contains_non_kg_letters"], ["species_outside_allowed_set"], ["owner_address_matches_clinic_address"], ["dob_matches_visit_date"], ["pet_name_is_stopword"], ["value_too_long"], ["clinic_name_numeric_only", "clinic_name_too_short", "clinic_name_missing_institution_token"]]


def test_visits_from_texts(spark):
    text = "Visita: 01/02/2024\nperro sano\nControl 05/02/2024\notitis leve en control del 05/02/2024\n"
    docs = spark.createDataFrame([("d", text), ("e", "nada"), ("n", None)], "document_id string, text string")
    fields = spark.createDataFrame(
        [("d", "a", "diagnosis", "otitis", "otitis leve en control del 05/02/2024", None, None, 1), ("d", "b", "symptoms", "sano", "perro sano", None, None, 2), ("d", "c", "weight", "7 kg", "7 kg", None, "patient", 3), ("d", "v", "visit_date", "09/02/2024", None, None, None, 4), ("d", "p", "pet_name", "Luna", None, "document", None, 5), ("e", "x", "procedure", "sutura", "sutura aparte", None, None, 1)],
        "document_id string, field_id string, key string, value string, snippet string, scope string, section string, seq int",
    )
    known = spark.createDataFrame([], "document_id string, visit_id string, date string")
    parts = {r.field_id: r.part for r in visits.classified(fields).collect()}
    assert parts == {"a": "visit", "b": "visit", "c": "document", "v": "meta", "p": "document", "x": "visit"}
    final, assigned = visits.visits_of(docs, fields, known)
    dates = {r.visit_id: r.date for r in final.filter("document_id = 'd'").collect()}
    got = {r.field_id: (dates.get(r.visit_id), r.how) for r in assigned.collect()}
    assert got["a"] == ("2024-02-05", "place") and got["b"] == ("2024-02-01", "place") and got["x"] == (None, "unassigned")
    assert [r.date for r in final.filter("document_id = 'd'").orderBy("position").collect()] == ["2024-02-01", "2024-02-05", "2024-02-05", "2024-02-09"]
    assert [r.visit_id for r in final.filter("document_id = 'e'").collect()] == ["unassigned"]
    cases = [("Control el 05/02/2024 y 5/2/2024", ["2024-02-05"]), ("Factura de visita 05/02/2024", []), ("05/02/2024", [])]
    df = spark.createDataFrame(cases, "s string, want array<string>").select("want", visits.snippet_dates(F.col("s")).alias("got"))
    assert all(r.got == r.want for r in df.collect())
    at = docs.filter("document_id = 'd'").select(visits.snippet_offset(F.col("text"), F.lit("PERRO  sano")).alias("a"), visits.snippet_offset(F.col("text"), F.lit("sano")).alias("b"), visits.line_of(F.col("text"), F.lit("Perro")).alias("c"), visits.line_of(F.col("text"), F.lit("gato")).alias("d")).first()
    assert at.a is None and at.b is None and at.c == 2 and at.d is None or at.a == 19


def test_review(spark):
    from docloom.functions import normal
    from docloom.operators import review

    docs = spark.createDataFrame([("a", "IN_REVIEW", None, None, None), ("b", "REVIEWED", 1, "x", "r9"), ("c", "IN_REVIEW", None, None, None)], "document_id string, review_status string, reviewed_at int, reviewed_by string, reviewed_run_id string")
    runs = spark.createDataFrame([("a", "r1", "COMPLETED", 5, 1), ("a", "r2", "COMPLETED", 4, 9), ("a", "r3", "FAILED", 9, 9)], "document_id string, run_id string, state string, completed_at int, created_at int")
    marks = spark.createDataFrame([("a", 7, "me"), ("a", 8, "you"), ("b", 7, "me")], "document_id string, at int, by string")
    marked = review.mark_reviewed(docs, runs, marks)
    assert rows(marked, "document_id") == [("a", "REVIEWED", 7, "me", "r1", True), ("b", "REVIEWED", 1, "x", "r9", False), ("c", "IN_REVIEW", None, None, None, False)]
    again = review.reopened(marked.drop("newly"), marks.select("document_id"))
    assert rows(again, "document_id")[0] == ("a", "IN_REVIEW", None, None, None, True)
    names = spark.createDataFrame([("o'neil",), ("ANA-MARIA",), ("luna ii",)], "n string").select(normal.title(F.col("n")).alias("t"))
    assert [r.t for r in names.collect()] == ["O'Neil", "Ana-Maria", "Luna Ii"]
    pairs = [(None, "Canina mestiza", [], "canino", "Mestiza"), ("canino", "Raza: labrador", [], "canino", "Labrador"), (None, None, ["Especie / Raza: Felino - Europeo"], "felino", "Europeo"), (None, None, [], None, None)]
    df = spark.createDataFrame(pairs, "s string, b string, e array<string>, ws string, wb string").withColumn("p", normal.species_and_breed(F.col("s"), F.col("b"), F.col("e")))
    assert [(r.p.species, r.p.breed) for r in df.collect()] == [(r[3], r[4]) for r in pairs]
    shape = spark.range(1).select(review.shape_errors(F.array(F.lit("a")), F.array().cast("array<string>"), ["a", "b"], ["b"]).alias("e"), review.utc_z(F.lit("2024-01-01T00:00:00+00:00")).alias("z")).first()
    assert shape.e == ["Missing keys: b", "Repeatable key 'b' must be a list"] and shape.z == "2024-01-01T00:00:00Z"
    record = spark.createDataFrame([("d", "x", [], " ")], "document_id string, a string, b array<string>, c string")
    assert review.populated_keys(record, ["a", "b", "c"]).first().populated == ["a"]
    live = spark.createDataFrame([("a", "r1", "RUNNING", None, None, 1), ("b", "r2", "FAILED", "odd", 3, 1)], "document_id string, run_id string, state string, failure_type string, completed_at int, created_at int")
    ends = spark.createDataFrame([("r1", "COMPLETED", None, 5), ("r1", "FAILED", "late", 9), ("r2", "COMPLETED", None, 9)], "run_id string, state string, failure_type string, completed_at int")
    assert [(r.state, r.completed_at) for r in review.completed(live, ends).orderBy("run_id").collect()] == [("COMPLETED", 5), ("FAILED", 3)]
