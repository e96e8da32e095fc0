"""Addresses in snippets of web pages."""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from docloom.functions.text import squeeze, strip

# fixed values: what begins an address, what ends one
STREET = r"(?:Carrer|Calle|Avenida|Av\.?|Plaza|Paseo|Camino|Ronda|Rua|C/|C\.)"
DIRECT = rf"(?iu)({STREET}[^.;]{{0,120}}?\b\d{{1,4}}\b[^.;]{{0,120}}?\b\d{{5}}\b[^.;]{{0,120}})"
LABELLED = r"(?iu)Direcci[oó]n\s*:?\s*([^.;]{10,220})"
AFTER = r"(?iu)(?:\bTel[eé]fono\b|tel:|\bHorario\b|\bCódigo Postal\b)"
RESULT = r'(?is)<a[^>]*class="result__snippet"[^>]*>(.*?)</a>'
MOST_RESULTS = 10


@F.pandas_udf(StringType())
def unescaped(x: pd.Series) -> pd.Series:
    """Character references decoded."""
    return x.map(lambda s: None if s is None else html.unescape(s))


def visible(markup: Column) -> Column:
    """The text of a piece of markup: tags are blanks, references decoded, white space squeezed."""
    return squeeze(unescaped(F.regexp_replace(markup, "<[^>]+>", " ")))


def cleaned(address: Column) -> Column:
    """An address without links and pictures, what follows a telephone, hours or post code label, and a rating at its end."""
    x = F.regexp_replace(F.regexp_replace(address, r"\[[^\]]+\]\([^)]+\)", ""), r"!\[[^\]]*\]\([^)]+\)", "")
    x = F.split(F.split(x, r"!\[", 2)[0], AFTER, 2)[0]
    return strip(F.regexp_replace(F.regexp_replace(x, r"\s{2,}", " "), r"\s+\d(?:[.,]\d)?$", ""), " ,;.-")


def address_in(text: Column) -> Column:
    """The first address in a visible text: from a street's word over a number to a post code, else what stands after the word address if it has a post code; null if there is none."""
    direct, labelled = F.regexp_extract(text, DIRECT, 1), cleaned(F.regexp_extract(text, LABELLED, 1))
    return F.when(direct != "", cleaned(direct)).when(labelled.rlike(r"\b\d{5}\b"), labelled)


def snippet_addresses(snippets: DataFrame, key: str, text: str) -> DataFrame:
    """Rows (key, address), one for each snippet of markup."""
    return snippets.select(key, visible(F.coalesce(F.col(text), F.lit(""))).alias("_text")).select(key, address_in(F.col("_text")).alias("address"))


def page_addresses(pages: DataFrame, key: str = "page_id", markup: str = "html") -> DataFrame:
    """Rows (key, address), one for each page: the first address among the first ten results it lists, each looked at on its own; a page without results is one
    piece of text. Null pages have none."""
    results = F.slice(F.regexp_extract_all(F.coalesce(markup, F.lit("")), F.lit(RESULT), F.lit(1)), 1, MOST_RESULTS)
    parts = F.when(F.size(results) > 0, results).otherwise(F.array(F.coalesce(markup, F.lit(""))))
    rows = pages.select(key, markup, F.monotonically_increasing_id().alias("_row"))  # pages with the same key are told apart
    found = rows.select("_row", key, F.posexplode(parts).alias("_at", "_part")).withColumn("_address", address_in(visible(F.col("_part"))))
    return found.groupBy("_row", key).agg(F.min(F.when(F.col("_address").isNotNull(), F.struct("_at", "_address")))["_address"].alias("address")).drop("_row")
