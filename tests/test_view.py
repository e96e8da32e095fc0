from pyspark.sql import functions as F

from docloom.operators import chunks, view


def test_slots_and_groups(spark):
    fields = spark.createDataFrame([("d", "pet_name", "Luna", "visit", 0.9, 1, False), ("d", "name", "Lola", "document", 0.4, 2, True), ("d", "breed", " ", "document", 0.9, 3, False), ("d", "coat", "black", "document", None, 4, False), ("d", "coat", "white", "document", 0.2, 5, False)], "document_id string, key string, value string, scope string, confidence double, seq int, is_critical boolean")
    aliases = spark.createDataFrame([("patient", "pet_name", True), ("patient", "name", True), ("breed", "breed", False)], "slot string, key string, document_scope boolean")
    assert [(r.slot, r.value, r.critical) for r in view.slots(fields, aliases).collect()] == [("patient", "Lola", True)]
    other = view.other_fields(fields, aliases.select("key")).collect()
    assert [(r.key, r.items, r.many, r.position) for r in other] == [("coat", ["black", "white"], True, 1)]
    assert view.worst_bands(view.bands(fields)).collect()[0].asDict() == {"document_id": "d", "low": 2, "medium": 0, "high": 2, "unknown": 0}


def test_visits_flatten_and_validate(spark):
    v = spark.createDataFrame([("d", "v1", "2024-01-05", None, None, "cough")], "document_id string, visit_id string, visit_date string, admission_date string, discharge_date string, reason_for_visit string")
    rows = view.visit_fields(v)
    assert rows.count() == 4 and rows.filter("is_critical").first().field_id == "visit-meta-visit:v1"
    contract = spark.createDataFrame([("visit_date",), ("weight",)], "key string")
    got = {(r.key, r.status, r.reason) for r in view.validated(rows, contract).collect()}
    assert got == {("visit_date", "accepted", None), ("admission_date", "rejected", "empty"), ("discharge_date", "rejected", "empty"), ("reason_for_visit", "accepted", None), ("weight", "missing", None)}


def test_vocabulary(spark):
    rows = [("d", "sex", "Hembra", 0.5, 1), ("d", "sex", "female", 0.8, 2), ("d", "sex", "Hembra Estado: FERTIL Peso: 0 / 1", None, 3), ("d", "sex", "x1 2 3", 0.9, 4), ("d", "sex", "quizas", 0.3, 5), ("d", "breed", "x", 0.3, 6)]
    got = [(r.section, r.value, r.confidence) for r in view.vocabulary_suggestions(spark.createDataFrame(rows, "document_id string, key string, value string, confidence double, seq int")).orderBy("section", "rank").collect()]
    assert got == [("detected", "female", 0.8), ("detected", "quizas", 0.3), ("detected", "Hembra Estado: FERTIL Peso: 0 / 1", None), ("suggestion", "hembra", 0.8)]


def test_display_and_events(spark):
    df = spark.createDataFrame([("2024-01-05", "date"), ("true", "bool"), (" ", "string"), (None, "date"), ("x", "string")], "v string, k string")
    assert [r[0] for r in df.select(view.display(F.col("v"), F.col("k"))).collect()] == ["05/01/2024", "Sí", "—", "—", "x"]
    e = spark.createDataFrame([("d", "f", "s", "r", None, None, 1)] * 3, "document_id string, field string, status string, raw string, normalized string, reason string, page int")
    assert view.distinct_events(e).count() == 1
    m = view.fields_per_visit(spark.createDataFrame([("d", "v1"), ("d", "v1"), ("d", None), ("e", None)], "document_id string, visit_id string"))
    assert {r.document_id: (dict(r.per_visit), r.all_unassigned) for r in m.collect()} == {"d": ({"v1": 2, "unassigned": 1}, False), "e": ({"unassigned": 1}, True)}


def test_chunks(spark):
    given = [(1, 1, "El paciente\x00 acude"), (1, 2, "El paciente acude"), (1, 3, "xkcdtrw qqq"), (1, 4, "a"), (1, 5, "12345 67"), (1, 6, " ")]
    got = chunks.sanitised(spark.createDataFrame(given, "k int, i int, chunk string"), ["k"], ["i"]).orderBy("i")
    assert [r.chunk for r in got.collect()] == ["El paciente acude", "a"]
    df = spark.createDataFrame([(["El paciente", "acu", "de a consulta", ", bien", "(", "hoy", ")"],), ([],)], "c array<string>")
    assert [r[0] for r in df.select(chunks.stitched(F.col("c"))).collect()] == ["El paciente acude a consulta, bien (hoy)", ""]
