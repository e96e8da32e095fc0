from datetime import date

import pytest
from pyspark.sql import functions as F

from docloom.functions import normal, scores, text


def one(spark, values, column, schema="x string"):
    return [r[0] for r in spark.createDataFrame([(v,) if not isinstance(v, tuple) else v for v in values], schema).select(column).collect()]


def test_dates(spark):
    given = ["05/07/2018", "Fecha: 5-7-18", "2018.07.05", "31/02/2020", "1/1/75", "1/1/68", "x", None, "", "12/13/2020"]
    assert one(spark, given, normal.date_dmy(F.col("x"))) == ["05/07/2018", "05/07/2018", "05/07/2018", None, "01/01/1975", "01/01/2068", None, None, None, None]


def test_visit_dates(spark):
    given = ["2024-01-05", "5/1/2024", "05-01-24", "5.1.99", "1/1/1899", "junk", None]
    assert one(spark, given, normal.visit_date(F.col("x"))) == ["2024-01-05", "2024-01-05", "2024-01-05", "2099-01-05", None, None, None]


def test_weights(spark):
    given = ["Peso: 7,2 kg", "7200 g", "12 kg", "0.2 kg", "500 kg", "x", None]
    assert one(spark, given, normal.weight_kg(F.col("x"))) == ["7.2 kg", "7.2 kg", "12 kg", None, None, None, None]


def test_chips_sex_species_names(spark):
    assert one(spark, ["chip 941000024967769", "94 1000 0249", "12", "1" * 16, None], normal.digits_of_chip(F.col("x"))) == ["941000024967769", "9410000249", None, None, None]
    assert one(spark, ["Sexo: Hembra", "male", "female", "?", None], normal.sex(F.col("x"))) == ["hembra", "macho", "hembra", None, None]
    assert one(spark, ["Canina", "gato europeo", "pez", None], normal.species(F.col("x"))) == ["canino", "felino", None, None]
    assert one(spark, ["ALYA - Nacimiento: 05/07/2018", "12345", "Especie: Canina", "Paciente: luna", ""], normal.pet_name(F.col("x"))) == ["Alya", None, None, "Luna", None]


def test_age_uses_the_birthday(spark):
    rows = [(date(2020, 2, 29), date(2021, 2, 28)), (date(2020, 2, 29), date(2021, 3, 1)), (date(2022, 1, 1), date(2021, 1, 1)), (date(2020, 6, 15), date(2020, 7, 20))]
    df = spark.createDataFrame(rows, "b date, o date")
    assert [r[0] for r in df.select(normal.age_years(F.col("b"), F.col("o"))).collect()] == [0, 1, None, 0]
    assert [r[0] for r in df.select(normal.age_shown(F.col("b"), F.col("o"))).collect()] == ["11 meses", "1 año", None, "1 mes"]


@pytest.mark.parametrize(("accepts", "edits", "points"), [(4, 3, 1.7), (1000, 0, 15.0), (0, 1000, -15.0), (2, 0, 0.0), (0, 0, 0.0), (-5, 3, -9.0)])
def test_review_adjustment(spark, accepts, edits, points):
    got = spark.range(1).select(scores.review_adjustment(F.lit(accepts), F.lit(edits))).first()[0]
    assert got == pytest.approx(points, abs=0.051 if abs(points) == 15 else 1e-9)


def test_scores(spark):
    assert one(spark, [0.59, 0.6, 0.8, None], scores.snapshot_band(F.col("x")), "x double") == ["low", "mid", "high", None]
    assert one(spark, [float("nan"), None, -1.0, 2.0, 0.3], scores.unit(F.col("x")), "x double") == [0.0, 0.0, 0.0, 1.0, 0.3]
    assert one(spark, [0.7, 0.66, 0.65], scores.kept_confidence(F.col("x")), "x double") == [0.66, 0.66, 0.5]


def test_matches_have_offsets(spark):
    df = spark.createDataFrame([(1, "a1bb22 3"), (2, ""), (3, None), (4, "ñ7")], "id int, text string")
    got = [tuple(r) for r in text.matches(df, "text", "[0-9]+", "id").orderBy("id", "match_no").collect()]
    assert got == [(1, 1, 1, "1"), (1, 2, 4, "22"), (1, 3, 7, "3"), (4, 1, 1, "7")]


def test_lines_are_dense(spark):
    df = spark.createDataFrame([(1, " a \n\n b\r\nc"), (2, None)], "id int, text string")
    assert [tuple(r) for r in text.lines(df, "text", "id").collect()] == [(1, 1, "a"), (1, 2, "b"), (1, 3, "c")]


def test_no_op_edits(spark):
    df = spark.createDataFrame([("1,0", "1.0", "number"), (" a", "a ", "string"), ("A", "a", "string"), ("True", "true", "bool"), (None, "", "string")], "o string, n string, k string")
    assert [r[0] for r in df.select(normal.same_value(F.col("o"), F.col("n"), F.col("k"))).collect()] == [True, True, False, True, True]
