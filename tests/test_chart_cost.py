"""What a chart costs: clauses are asked for words before patterns, rosters and segments come of one deal by document, with the same results as before."""

import random
import re

from pyspark.sql import functions as F

from docloom.functions.text import cue
from docloom.operators import clauses, mining, visit_chart as vc, visits
from docloom.operators.keyed import first_of, kth_match


def pieces() -> list[str]:
    """Texts near the words of all patterns of clauses."""
    out = set()
    for p in (*clauses.WORDS, clauses.MORE_ADMIN, clauses.PERFORMED, clauses.SUMMARY_PREFIX):
        for w in re.sub(r"\(\?[iu]+\)|\(\?:|\\b|[\^$()]", "", p).split("|"):
            w = re.sub(r"\\d\+?", "12", re.sub(r"\\s[+*]", " ", w))
            w = re.sub(r"\[(.).*?\]", r"\1", w)
            out |= {re.sub(r"[\\+*{},]", "", re.sub(r".\?", "", w)), re.sub(r"[\\+*{},?]", "", w)}
    return sorted(out)


def test_words_are_in_whatever_a_pattern_matches(spark):
    draw, some = random.Random(4), pieces()
    form = lambda w: draw.choice((w, w, w.upper(), w.title(), w.replace("s", "ſ"), w.replace("i", "ı"), w.replace("i", "İ")))
    texts = [form(w) for w in some for _ in range(6)] + [" ".join(form(draw.choice(some)) for _ in range(draw.randrange(1, 5))) for _ in range(3000)]
    df = spark.createDataFrame([(t,) for t in texts], "x string")
    x = F.col("x")
    for p, words in clauses.WORDS.items():
        full = p if p.startswith("(?") else f"(?iu)(?:{p})"
        r = df.agg(F.count_if(x.rlike(full)).alias("n"), F.count_if(x.rlike(full) & ~clauses.holds(cue(x), *words)).alias("lost")).first()
        assert r.n > 0 and r.lost == 0, (p, r)


def test_cue_folds_what_patterns_take_for_plain_letters(spark):
    df = spark.createDataFrame([("ſıİKſI",)], "x string")
    assert df.select(cue(F.col("x")).alias("y")).first().y == "siiksi"  # lower(upper(x)) is planned as lower(x), which leaves the first letter
    docs = spark.createDataFrame([("a", "Hoſpital Norte")], "document_id string, text string")
    assert [r.value for r in mining.from_lines(docs).filter("key = 'clinic_name'").collect()] == ["Hoſpital Norte"]


def test_segments_are_those_of_pairs_of_places_and_visits(spark):
    draw = random.Random(12)
    docs, seen, roster = [], [], []
    for d in range(60):
        lines = [f"line {i} " + "x" * draw.randrange(9) for i in range(draw.randrange(1, 9))]
        starts = [sum(len(x) + 1 for x in lines[:i]) for i in range(len(lines))]
        docs.append((str(d), "\n".join(lines)))
        seen += [(str(d), draw.choice("abc"), s + 2, s) for s in starts if draw.random() < 0.8]
        roster += [(str(d), draw.choice([f"v{i}", f"v{i}", None]) if d % 9 == 0 else f"v{i}", draw.choice(["a", "b", "c", None]), i + 1) for i in range(draw.randrange(7))]
    docs, roster = spark.createDataFrame(docs, "document_id string, text string"), spark.createDataFrame(roster, "document_id string, visit_id string, date string, no int")
    seen = spark.createDataFrame(seen, "document_id string, date string, offset int, line_start int")
    pairs = first_of(kth_match(seen, roster, ["document_id", "date"], ["offset"], ["no"]), ["document_id", "visit_id"], [F.asc("offset")])
    want = sorted(map(repr, pairs.select("document_id", "visit_id", "line_start").collect()))
    cuts = visits.segments(docs, seen, roster)
    assert sorted(map(repr, cuts.select("document_id", "visit_id", F.col("start").alias("line_start")).collect())) == want and len(want) > 50
    physical = cuts._jdf.queryExecution().executedPlan().toString()
    assert physical.count("Exchange hashpartitioning") == 2  # places and visits together, and the texts


def test_a_roster_of_fields_and_texts_equals_that_of_their_dates(spark):
    draw = random.Random(13)
    day = lambda: f"2024-01-0{draw.randrange(1, 6)}"
    fields = spark.createDataFrame([(str(draw.randrange(40)), "visit_date", day(), None, "meta", i) for i in range(60)], "document_id string, key string, value string, snippet string, part string, seq long")
    seen = spark.createDataFrame([(str(draw.randrange(40)), day(), i) for i in range(150)], "document_id string, date string, offset int")
    known = spark.createDataFrame([(str(d), f"k{i}", draw.choice([day(), None]), i + 1) for d in range(0, 40, 2) for i in range(draw.randrange(4))], "document_id string, visit_id string, date string, no int")
    want = sorted(map(repr, vc.roster(visits.detected_dates(fields, seen), seen, known).collect()))
    assert sorted(map(repr, vc.detected_roster(fields, seen, known).collect())) == want and len(want) > 100
    assert vc.detected_roster(fields, seen, known)._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
