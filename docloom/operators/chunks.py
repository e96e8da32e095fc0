"""Chunks of decoded text: readability, repeats, and stitching into one text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions.text import count, squeeze
from docloom.operators.keyed import drop_repeats

# fixed values: vowels and limits of readable chunks
VOWELS = "[aeiouáéíóúüAEIOUÁÉÍÓÚÜ]"
CONSONANTS = r"(?U)(?:(?![aeiouáéíóúüAEIOUÁÉÍÓÚÜ])\p{L}){6}"


def decoded_score(x: Column) -> Column:
    """How much a chunk looks like text: shares of letters and vowels, half of blanks, less one and a half of marks; -100 without letters."""
    letters, size = count(x, r"\p{L}"), F.length(x)
    marks = size - count(x, r"[\p{L}\p{N}]") - count(x, r"\s")
    return F.when(letters == 0, F.lit(-100.0)).otherwise(letters / size + count(x, VOWELS) / letters + count(x, r"\s") / size * 0.5 - marks / size * 1.5)


def readable(x: Column) -> Column:
    """Whether a chunk is text: enough letters and vowels, few digits and marks, no long run of consonants."""
    letters, size = count(x, r"\p{L}"), F.length(x)
    vowels = count(x, VOWELS) / F.greatest(F.lit(1), letters)
    marks = (size - count(x, r"[\p{L}\p{N}]") - count(x, r"\s")) / F.greatest(F.lit(1), size)
    shouted = (size > 12) & (count(x, r"\p{Lu}") / F.greatest(F.lit(1), letters) > 0.8) & (vowels < 0.4)
    quotes = (count(x, "'") > 0) & (count(x, "'") > F.greatest(F.lit(1), F.floor(size / 60)))
    good = (size >= 3) & (letters > 0) & (decoded_score(x) >= 1.1) & (letters / size >= 0.45) & (count(x, r"\p{Nd}") / size <= 0.15) & (marks <= 0.25) & (vowels >= 0.25)
    return good & ~shouted & ~quotes & ~x.rlike(CONSONANTS)


def sanitised(chunks: DataFrame, keys: list[str], order: list[str], value: str = "chunk") -> DataFrame:
    """Chunks without NULs and marks of byte order, blank, unreadable and repeated ones; one or two letters stay."""
    x = squeeze(F.translate(F.col(value), "\x00﻿", ""))
    kept = chunks.withColumn(value, x).filter((F.col(value) != "") & (F.col(value).rlike(r"^\p{L}{1,2}$") | readable(F.col(value))))
    return drop_repeats(kept, keys, order, value)


def stitched(chunks: Column) -> Column:
    """An array of chunks as one text: no blank before closing marks, after opening ones, around dashes, and inside words that were cut."""

    def step(a: Column, c: Column) -> Column:
        last, first = F.regexp_extract(a, r"([A-Za-zÀ-ÿ]+)$", 1), F.regexp_extract(c, r"^([A-Za-zÀ-ÿ]+)", 1)
        cut = (last != "") & (first != "") & ((F.length(last) <= 3) | (F.length(first) <= 2) | ((last == F.upper(last)) & (first == F.upper(first))))
        close = c.rlike(r"^[,.;:!?)\]}\-]") | a.rlike(r"[(\[{\-]$") | cut
        return F.when(c == "", a).when((a == "") | close, F.concat(a, c)).otherwise(F.concat(a, F.lit(" "), c))

    out = F.aggregate(F.transform(chunks, F.trim), F.lit(""), step)
    return squeeze(F.regexp_replace(F.regexp_replace(F.regexp_replace(out, r"\s+([,.;:!?])", "$1"), r"\(\s+", "("), r"\s+\)", ")"))
