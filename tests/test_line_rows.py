"""Lines with the lines around them, against slices of plain lists."""

from pyspark.sql import functions as F

from docloom.functions.text import once
from docloom.operators.line_rows import REACH, emitted, entry, line_at, line_rows, lines_at

FRAMES = [(-8, 8), (-8, -1), (1, 8), (-3, 1), (0, 3), (-1, 1), (-5, -1), (1, 5), (-2, 2)]


def test_contexts_equal_slices(spark):
    texts = {"long": [f"line {i}" for i in range(40)], "one": ["alone"], "nine": [f"n{i}" for i in range(9)], "same": ["x"] * 12}
    docs = spark.createDataFrame([(k, "\n".join(v)) for k, v in texts.items()] + [("null", None), ("blank", " \n\t\n")], "document_id string, text string")
    ks = [k for k in range(-REACH, REACH + 1)]
    got = line_rows(docs).select("document_id", "line_no", "line", "n_lines", *(lines_at(lo, hi).alias(f"c{i}") for i, (lo, hi) in enumerate(FRAMES)), *(line_at(k).alias(f"k{k + REACH}") for k in ks)).collect()
    assert len(got) == sum(map(len, texts.values()))
    for r in got:
        all_lines, at = texts[r.document_id], r.line_no - 1
        assert r.line == all_lines[at] and r.n_lines == len(all_lines)
        for i, (lo, hi) in enumerate(FRAMES):
            assert r[f"c{i}"] == all_lines[max(0, at + lo) : max(0, at + hi + 1)], (r.document_id, at, lo, hi)
        for k in ks:
            assert r[f"k{k + REACH}"] == (all_lines[at + k] if 0 <= at + k < len(all_lines) else None)


def test_lines_are_shuffled_once(spark):
    docs = spark.createDataFrame([("a", "x\ny")], "document_id string, text string")
    rows = emitted(line_rows(docs), [entry("k", 1, F.col("line_no"), F.when(F.col("line") == "x", F.col("line")), F.array_join(lines_at(0, 1), "|"), 0.5), entry("k", 2, F.col("line_no"), F.lit(""), F.col("line"), 0.5)])
    assert rows._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    assert [tuple(r) for r in rows.collect()] == [("a", "k", 10**9 + 1, "x", "x|y", 0.5, None, 0, None)]


def test_once_passes_nulls_on(spark):
    df = spark.createDataFrame([("a",), (None,)], "x string")
    assert [r.y for r in df.select(once(F.upper("x"), lambda v: F.concat(v, v)).alias("y")).collect()] == ["AA", None]
