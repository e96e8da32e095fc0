"""Column functions on text: white space, folding, character classes, lines, matches with offsets."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

#: White space as Unicode has it, with the four separators U+001C to U+001F.
SPACE = r"[\t-\r\x1c-\x20\x85\p{Z}]"
#: Line ends; a carriage return and a line feed together are one.
LINE_END = r"\r\n|[\n\x0b\x0c\r\x1c-\x1e\x85  ]"


def squeeze(x: Column) -> Column:
    """Runs of white space become one blank; none at the ends."""
    return F.trim(F.regexp_replace(x, f"{SPACE}+", " "))


def fold(x: Column) -> Column:
    """Lower case for comparison; the German sharp s counts as ss."""
    return F.replace(F.lower(x), F.lit("ß"), F.lit("ss"))


def plain(x: Column) -> Column:
    """Folded text without the marks of Latin letters."""
    return F.translate(fold(x), "áàâäãåéèêëíìîïóòôöõúùûüñçýÿ", "aaaaaaeeeeiiiiooooouuuuncyy")


def count(x: Column, pattern: str) -> Column:
    """Number of matches of a pattern."""
    return F.regexp_count(x, F.lit(pattern))


def chars(x: Column, members: str) -> Column:
    """Number of characters of a class, given by its members: what is gone once they are taken out. No array of matches is built, unlike in count."""
    return F.length(x) - F.length(F.regexp_replace(x, f"[{members}]+", ""))


def strip(x: Column, chars: str) -> Column:
    """Remove any of chars from both ends."""
    return F.trim(x, F.lit(chars))


def blank_to_null(x: Column) -> Column:
    return F.nullif(F.trim(x), F.lit(""))


def is_empty(x: Column, kind: str) -> Column:
    """Whether a value of a type (as DataFrame.dtypes names it) is none: null, a blank text, an empty list or map."""
    full = F.size(x) > 0 if kind.startswith(("array", "map")) else F.trim(x) != "" if kind == "string" else x.isNotNull()
    return ~F.coalesce(full, F.lit(False))


def cue(x: Column) -> Column:
    """A text in which every letter that a pattern without regard to case takes for a plain one is that letter: long s, dotless and dotted i among them."""
    # not lower(upper(x)), of which the engine keeps the outer one only; the dot is what is left of a dotted I
    return reduce(lambda y, w: F.replace(y, F.lit(w[0]), F.lit(w[1])), (("\u017f", "s"), ("\u0131", "i"), ("\u0307", "")), F.lower(x))


def holds(x: Column, *words: str) -> Column:
    """Whether a text holds one of some words, which need no pattern."""
    return reduce(or_, (F.contains(x, F.lit(w)) for w in words))


def once(x: Column, f: Callable[[Column], Column]) -> Column:
    """f of x, where x is made once however often f uses it: Spark makes an expression under a condition anew for each use."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def shorten(x: Column, most: int) -> Column:
    """At most so many characters, the last an ellipsis where text was cut."""
    return F.when(F.length(x) > most, F.concat(F.rtrim(F.substring(x, 1, most - 1)), F.lit("…"))).otherwise(x)


#: How long snippets, evidence, previews and samples of tokens may be.
SNIPPET, EVIDENCE, PREVIEW, SAMPLE = 180, 220, 80, 30


def cuts(x: Column) -> list[Column]:
    """A text as it is shown: a snippet with an ellipsis where text was cut, evidence, preview and token sample cut short."""
    return [shorten(x, SNIPPET).alias("snippet"), *(F.substring(x, 1, n).alias(name) for name, n in (("evidence", EVIDENCE), ("preview", PREVIEW), ("sample", SAMPLE)))]


def cut(x: Column, pattern: str) -> Column:
    """F.split of a text by a pattern that matches no empty text. That compiles the pattern anew for each text, so matches are replaced by a mark and the text is split there, unless it holds
    the mark itself."""
    mark = "\u0001"
    return F.when(F.contains(x, F.lit(mark)), F.split(x, pattern)).otherwise(F.split(F.regexp_replace(x, pattern, mark), mark))


def all_lines(x: Column) -> Column:
    """The lines of a text as an array. Most texts know one kind of line end, which needs no pattern."""
    return F.when(x.rlike("[\x0b\x0c\r\x1c-\x1e\x85\u2028\u2029]"), F.split(x, LINE_END)).otherwise(F.split(x, "\n"))


def line_array(x: Column) -> Column:
    """The trimmed lines of a text that aren't blank, as an array; of a null text none."""
    return F.filter(F.transform(all_lines(F.coalesce(x, F.lit(""))), lambda x: F.when(x.rlike(f"^{SPACE}|{SPACE}$"), F.regexp_replace(x, f"^{SPACE}+|{SPACE}+$", "")).otherwise(x)), lambda x: x != "")


def lines(df: DataFrame, text: str = "text", *keys: str) -> DataFrame:
    """Rows (*keys, line_no, line): the trimmed lines that aren't blank, numbered densely from 1. Null text has none."""
    return df.select(*keys, F.posexplode(line_array(F.col(text))).alias("line_no", "line")).withColumn("line_no", F.col("line_no") + 1)


def line_window(first: int, last: int, *keys: str) -> WindowSpec:
    """For aggregates over the lines around each line, from `first` to `last` lines on (negative: before it): the lines of a text are sorted once for all of them."""
    return Window.partitionBy(*keys).orderBy("line_no").rowsBetween(first, last)


def matches(df: DataFrame, text: str, pattern: str, *keys: str) -> DataFrame:
    """Rows (*keys, match_no, offset, value): all matches of a pattern without groups, offset in code points from 0.

    Offsets come from folding the gaps between matches, so nothing leaves the engine.
    """
    x = F.coalesce(F.col(text), F.lit(""))
    gaps, values = cut(x, pattern), F.regexp_extract_all(x, F.lit(f"({pattern})"), F.lit(1))
    found = df.select(*keys, gaps.alias("_gaps"), values.alias("_values"))
    before = lambda i: F.aggregate(F.slice("_gaps", 1, i + 1), F.lit(0), lambda a, g: a + F.length(g)) + F.aggregate(F.slice("_values", 1, i), F.lit(0), lambda a, v: a + F.length(v))
    return found.select(*keys, F.posexplode(F.transform("_values", lambda v, i: F.struct(before(i).alias("offset"), v.alias("value")))).alias("match_no", "m")).select(*keys, F.col("match_no") + 1, "m.offset", "m.value").toDF(*keys, "match_no", "offset", "value")


def last_index(text: Column, part: Column) -> Column:
    """Offset of the last occurrence of part in text, from 0; -1 if there is none or part is empty."""
    return last_index_back(F.reverse(text), part)


def last_index_back(back: Column, part: Column) -> Column:
    """last_index of a text that is given from its end to its start."""
    at = F.instr(back, F.reverse(part))
    return F.when((part == "") | (at == 0), F.lit(-1)).otherwise(F.length(back) - F.length(part) - (at - 1))
