"""What the steps of visits cost: dates and weights are read once, headings come with the text, segments are mined for their own keys only."""

from pyspark.sql import functions as F

from docloom.functions import normal
from docloom.operators import clauses, mining, visit_chart, visits

TEXT = "visita consulta general del día 05/02/2024\n- 05/02/2024 - 10:30 - Control\nPeso: 7 kg\nDiagnóstico: otitis\nPaciente: Luna\nChip: 941000024967769\nvisita administrativa del dia 06/02/2024\n"


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_a_date_and_a_weight_are_read_once(spark):
    df = spark.createDataFrame([("5/2/2024",)], "x string")
    for f in (normal.visit_date, normal.weight_kg):
        assert plan(df.select(f(F.concat("x", F.lit("mark"))).alias("y"))).count("mark") == 1


def test_dates_keep_their_meaning(spark):
    given = ["5/2/2024\n", "2024-1-5\n", " 5.2-24 ", "31/02/2024", "2024/01/05", "5/2/1899", "0000-01-01", None, ""]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(given)], "i int, x string")
    assert [r.y for r in df.select("i", normal.visit_date(F.col("x")).alias("y")).orderBy("i").collect()] == [None, None, "2024-02-05", None, None, None, None, None, None]


def test_a_clause_is_cleaned_once(spark):
    df = spark.createDataFrame([("d", "v", "a. b")], "document_id string, visit_id string, segment string")
    assert plan(clauses.observations_actions(df)).count(clauses.LEADING_DAY) == 1


def test_headings_stand_where_they_are_found(spark):
    df = spark.createDataFrame([("a", TEXT), ("b", "nothing"), ("c", "")], "k string, text string")
    got = {r.k: r.heads for r in df.select("k", visits.headings(F.col("text")).alias("heads")).collect()}
    assert got == {"a": [0, TEXT.index("visita administrativa")], "b": [], "c": []}


def test_texts_without_dates_are_not_split(spark):
    docs = spark.createDataFrame([("a", TEXT), ("b", "Peso: 7 kg"), ("n", None)], "document_id string, text string")
    assert {r.date for r in visits.occurrences(docs).collect()} == {"2024-02-05", "2024-02-06"}
    assert [tuple(r)[:3] for r in visits.latest_weight(docs).collect()] == [("a", "2024-02-05", "7 kg")]
    for f in (visits.occurrences, visits.latest_weight):
        before_lines = plan(f(docs)).split("Generate posexplode")[-1]
        assert "RLIKE" in before_lines


def test_mining_some_keys_gives_what_mining_all_gives(spark):
    docs = spark.createDataFrame([("a", TEXT), ("b", "Tratamiento: gotas 2 mg cada 8 h\n5 kg\nsíntomas: tos\nCirugía: sutura")], "document_id string, text string")
    keys = visit_chart.SEGMENT_KEYS
    every, some = mining.mine(docs), mining.mine(docs, keys)
    assert sorted(map(repr, every.filter(F.col("key").isin(*keys)).collect())) == sorted(map(repr, some.collect())) and some.count() > 3
