"""The gate's counts come from one look at each text and are what its patterns say."""

import random

from pyspark.sql import functions as F

from docloom.functions.text import SPACE, chars, squeeze
from docloom.operators import quality_gate

PIECES = ["a", "É", "ñ", "ß", "×", "Ω", "中", "文", "٣", "½", "_", "__", "7", "1234567890123", "abcdefghijkl", "palabra", "EXTRAORDINARIAMENTE", "x_1", "é", "İ", "😀", "\x00", "\x7f", "​", "﻿", "\U000f0000", " ", "  ", "\n", "\r\n", "\t", "\x1c", "\x85", " ", "　", "\xa0", ".", ",", "-", "\\", "]", "@", "#", "€", "«", "¡", "Diene", "dratamiento", "dra quea"]


def by_patterns(df):
    """The counts as column functions have them, a pattern or more for each."""
    n, x = squeeze(F.col("x")), F.col("x")
    w = F.concat(F.lit(" "), F.regexp_replace(n, r"[^\p{L}\p{N}_]+", "  "), F.lit(" "))
    size, many = F.length(n), lambda s, p: F.size(F.regexp_extract_all(s, F.lit(f"({p})"), F.lit(1)))
    counts = {
        "spaces": chars(x, SPACE[1:-1]), "breaks": chars(x, "\n"), "letters": chars(n, r"\p{L}"), "alnum": chars(n, r"\p{L}\p{N}"), "capitals": chars(n, r"\p{Lu}"), "vowels": chars(n, "aeiouáéíóúüAEIOUÁÉÍÓÚÜ"), "hidden": chars(n, r"\p{C}"),
        "strange": chars(n, r"""^\p{L}\p{N} .,;:!?()\[\]{}'"\-_/\\%&+*#@"""), "chars": F.length(x), "blank": chars(n, " "), "size": size, "words": many(n, "[A-Za-zÀ-ÿ]{3,}"), "tokens": many(w, r"[\p{N}_]*\p{L}[\p{L}\p{N}_]*"),
        "long": many(w, r"[\p{L}\p{N}_]{12,}") - many(w, r" [\p{N}_]{12,} "), "single": many(w, r" \p{L} "), "suspect": F.lower(n).rlike("dratamiento|draquea|diene"),
    }
    return df.select("k", *(c.alias(name) for name, c in counts.items()))


def test_counts_are_those_of_the_patterns(spark):
    draw = random.Random(3)
    texts = ["", " ", "\n \t", "a", " a ", *PIECES, *("".join(draw.choices(PIECES, k=draw.randrange(1, 60))) for _ in range(400))]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "k int, x string")
    got, want = ({r.k: r.asDict() for r in f.collect()} for f in (quality_gate.counted(df, "x"), by_patterns(df)))
    assert len(got) == len(texts) and got == want


def test_long_texts_are_cut_without_loss(spark, monkeypatch):
    df = spark.createDataFrame([(1, "Extraordinariamente 7 días. " * 9)], "k int, x string")
    monkeypatch.setattr(quality_gate, "SLICE", 5)
    assert quality_gate.counted(df, "x").collect()[0].asDict() == by_patterns(df).collect()[0].asDict()


def test_texts_are_looked_through_once(spark):
    df = spark.createDataFrame([(1, "El paciente acude", "es"), (2, None, None)], "doc_id int, text string, lang string")
    out = quality_gate.assess(df, keep=("lang",))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "regexp" not in plan and "RLIKE" not in plan
    assert sorted(map(tuple, out.collect()), key=str) == [(1, "es", 0.0, False, "TOO_SHORT"), (2, None, 0.0, False, "TOO_SHORT")]
