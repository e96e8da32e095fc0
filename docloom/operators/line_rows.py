"""Lines with the lines around them: one row a line for all rules that read lines, whose candidates come from a single pass."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions.text import fold, line_array, once
from docloom.sources.scratch import parts

#: How many lines before and after it a rule can look at.
REACH = 8


def line_rows(docs: DataFrame, **whole: Callable[[Column], Column]) -> DataFrame:
    """Rows (document_id, line_no, line, around, n_lines, low, own) of documents (document_id, text): around holds the line and up to REACH lines on both sides,
    own is the line's place in it from 1, low is the line folded. Null and blank texts have no row. Further columns are made of all lines of a text (an array), once a text.
    Texts are dealt out once, whole: their lines stand in order already and need no sort."""
    texts = docs.select("document_id", "text").repartition(parts(docs.sparkSession), "document_id")

    def around(rows: Column) -> Column:
        near = lambda n: F.slice(rows, F.greatest(F.lit(1), n - REACH), F.lit(2 * REACH + 1) + F.least(F.lit(0), n - (REACH + 1)))
        return F.transform(rows, lambda x, i: F.struct((i + 1).alias("line_no"), x.alias("line"), near(i + 1).alias("around")))

    made = once(line_array(F.col("text")), lambda rows: F.struct(around(rows).alias("rows"), F.size(rows).alias("n_lines"), *(f(rows).alias(k) for k, f in whole.items())))
    # as a generator's only element the lines of a text are made once
    rows = texts.select("document_id", F.explode(F.array(made)).alias("t")).select("document_id", F.explode("t.rows").alias("r"), "t.n_lines", *(F.col(f"t.{k}") for k in whole))
    rows = rows.select("document_id", "r.*", "n_lines", *whole)
    return rows.withColumns({"low": fold(F.col("line")), "own": F.least("line_no", F.lit(REACH + 1))})


def line_at(k: int) -> Column:
    """The line k lines on (negative: before); null beyond the text."""
    return F.get("around", F.col("own") + (k - 1))


def lines_at(lo: int, hi: int) -> Column:
    """The lines from lo to hi lines on, as an array, as far as the text goes. It is cut from the row's own array only where a rule asks for it."""
    if lo > 0:
        return F.slice("around", F.col("own") + lo, F.lit(hi - lo + 1))
    start = F.greatest(F.lit(1), F.col("own") + lo)
    return F.slice("around", start, F.col("own") + (hi + 1) - start)


def entry(key: str, rank: int, place: Column, value: Column, snippet: Column, confidence: float, reason: str | None = None, gate: Column | None = None, plain: bool = False) -> Column:
    """A candidate, or null where its value is null or empty, or its gate isn't true. The value is made once, and only behind the gate, which compiled code asks; what is inside `once` is interpreted.
    A plain value, a column or a literal, needs no `once`."""
    none = F.lit(None).cast("string")
    rest = (snippet.alias("snippet"), F.lit(confidence).alias("confidence"), none.alias("anchor"), F.lit(0).alias("priority"), (none if reason is None else F.lit(reason)).alias("reason"))
    made = lambda v: F.when(v != "", F.struct(F.lit(key).alias("key"), (F.lit(rank * 10**9) + place).cast("long").alias("seq"), v.alias("value"), *rest))
    out = made(value) if plain else once(value, made)
    return out if gate is None else F.when(gate, out)


def emitted(rows: DataFrame, entries: list[Column]) -> DataFrame:
    """The candidates of all rows. They are made in a projection of their own, not as the argument of the generator, which would make them twice."""
    made = rows.select("document_id", F.array(*entries).alias("made"))
    return made.select("document_id", F.explode_outer("made").alias("e")).filter("e is not null").select("document_id", "e.*")
