"""Texts without dates and labels are told quickly: shapes are searched one after another, dates by their core first, with the same answer as before."""

import random
import re

from docloom.functions import patterns as P
from docloom.operators import visits
from docloom.operators.cues import BREAK, INDENT, cued

JOINT = re.compile(r"[0-9](?:[/\-.][0-9]|\s*k?gs?\b)|p\.\s*(?:[:\-]\s*)?[0-9]|dra?\.?\s*[:\-]|\bn(?:[º°�]|ro)?\.?\s*[:\-]|(?:^|" + BREAK + ")" + INDENT + P.HINT_LINE_STARTS, re.ASCII)
PIECES = ["n", "nº", "nro", "an", "_n", "ñn", "én", ".", ":", "-", " ", "\n", "\r", "\t", "1", "12", "/", "kg", "k", "gs", "p.", "dr", "dra", "vet", "doctora", "h.v", "dir", "x"]


def test_shapes_say_what_they_say_together(spark):
    draw = random.Random(5)
    texts = ["".join(draw.choices(PIECES, k=draw.randrange(7))) for _ in range(4000)]
    one = lambda t: bool(re.match(INDENT + P.HINT_LINE_STARTS, t, re.ASCII)) or any(re.search(p, t, re.ASCII) for p in (*P.HINT_SHAPES, BREAK + INDENT + P.HINT_LINE_STARTS))
    want = [bool(JOINT.search(t)) for t in texts]
    assert [one(t) for t in texts] == want and 500 < sum(want) < 3500
    # the words of the hints count too, so the column may only say more
    got = {r.i: r.hint for r in cued(spark.createDataFrame(list(enumerate(texts)), "i int, text string")).collect()}
    assert all(got[i] for i, w in enumerate(want) if w)


def test_dates_hold_their_core(spark):
    draw = random.Random(6)
    texts = ["".join(draw.choices(["1", "12", "2024", "/", "-", ".", " ", "x"], k=draw.randrange(9))) for _ in range(20000)] + ["5/2/2024"]
    dated = [t for t in texts if re.search(P.VISIT_DATE, t, re.ASCII)]
    assert len(dated) > 20 and all(re.search(P.VISIT_DATE_CORE, t) for t in dated)
    docs = spark.createDataFrame([("a", "visita 05/02/2024")], "document_id string, text string")
    assert P.VISIT_DATE_CORE in visits.occurrences(docs)._jdf.queryExecution().optimizedPlan().toString() and visits.occurrences(docs).count() == 1
