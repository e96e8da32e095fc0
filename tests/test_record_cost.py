"""What a record costs: values are made once, lines need no sort, label patterns are tried only where they can begin, with the same results as before."""

import random

from pyspark.sql import functions as F

from docloom.functions import normal, patterns as P, text
from docloom.operators import mining, record
from docloom.operators.line_rows import line_rows


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_a_normal_form_is_made_once(spark):
    df = spark.createDataFrame([("5/2/24",)], "x string")
    for f in (normal.date_dmy, normal.pet_name, normal.sex, record.clinic_name, record.owner_address):
        assert plan(df.select(f(F.concat("x", F.lit("mark"))).alias("y"))).count("mark") == 1
    best = spark.createDataFrame([("d", "dob", "5/2/24", 1)], "document_id string, key string, value string, rank int")
    # once for each of the five keys of dates; neither the filter nor a column of the record makes it again
    assert plan(mining.record(record.normalised(best))).count(normal.DATE) == 5


def test_dates_and_species_keep_their_meaning(spark):
    given = ["5/2/24", "visita: 5.2.1968", "31/02/2024", "2024-1-5", "1/1/0000", "5/2/123", "x", "", None]
    df = spark.createDataFrame(list(enumerate(given)), "i int, x string")
    assert [r.y for r in df.select("i", normal.date_dmy(F.col("x")).alias("y")).orderBy("i").collect()] == ["05/02/2024", "05/02/1968", None, "05/01/2024", None, None, None, None, None]
    pairs = spark.createDataFrame([(1, "felino", "Felino / Siamés", []), (2, None, None, ["Especie/Raza: Canina / Labrador"]), (3, None, "boxer", ["perra"]), (4, None, None, None)], "i int, s string, b string, e array<string>")
    got = [tuple(r.p) for r in pairs.select("i", normal.species_and_breed(F.col("s"), F.col("b"), F.col("e")).alias("p")).orderBy("i").collect()]
    assert got == [("felino", "Siamés"), ("canino", "Labrador"), ("canino", "Boxer"), (None, None)]


def test_lines_need_no_sort(spark):
    docs = spark.createDataFrame([("a", "x\ny")], "document_id string, text string")
    physical = line_rows(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in physical and "Sort" not in physical


def test_a_split_at_marks_is_a_split(spark):
    draw = random.Random(8)
    texts = ["".join(draw.choices(["5/2/2024", "05-02-24", " ", "x", "\u0001", "\n", "\r\n", " ", "1", "é"], k=draw.randrange(9))) for _ in range(2000)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, x string")
    x = F.col("x")
    both = df.select(text.cut(x, P.VISIT_DATE).alias("a"), F.split(x, P.VISIT_DATE).alias("b"), text.all_lines(x).alias("c"), F.split(x, text.LINE_END).alias("d"))
    assert both.filter("a != b or c != d").count() == 0 and both.count() == 2000


def test_matches_begin_with_their_letters(spark):
    from tests.test_cues import fuzzed

    texts = fuzzed(400) + [t.replace("s", "ſ").replace("i", "ı") for t in fuzzed(100)] + [t.replace("i", "İ") for t in fuzzed(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, x string")
    for i, (_, p) in enumerate(P.LABELLED):
        fast = f"(?iu)(?=[{P.LABEL_STARTS[i]}]){p}" if P.LABEL_STARTS[i] else f"(?iu){p}"
        found = df.select(*(F.regexp_extract_all("x", F.lit(q), F.lit(0)).alias(n) for q, n in ((f"(?iu){p}", "a"), (fast, "b"))))
        assert found.filter("a != b").count() == 0 and found.filter("size(a) > 0").count() > 0
    for window in (P.CHIP_WINDOW, P.RECORD_WINDOW):
        slow = window.replace("(?=[mctin])", "").replace("(?=[nh])", "")
        assert slow != window
        found = df.select(*(F.regexp_extract_all("x", F.lit(q), F.lit(0)).alias(n) for q, n in ((slow, "a"), (window, "b"))))
        assert found.filter("a != b").count() == 0 and found.filter("size(a) > 0").count() > 0


def test_the_first_short_date_over_a_chip_is_the_birth_date(spark):
    chip = "Chip: 941000024967769"
    cases = {"first": f"5/2/20\nLuna\n6/3/21\n{chip}", "late": "\n".join(["x"] * 20) + f"\n5/2/20\n{chip}", "far": "5/2/20\n" + "\n".join(["x"] * 9) + f"\n6/3/21\n{chip}", "none": "5/2/20\nLuna"}
    docs = spark.createDataFrame(list(cases.items()), "document_id string, text string")
    got = {(r.document_id, r.value) for r in mining.from_lines(docs).filter("key = 'dob'").collect()}
    assert got == {("first", "5/2/20"), ("far", "6/3/21")}
