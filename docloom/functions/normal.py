"""Column functions that bring field values into their canonical form. Each gives null where the value can't be one."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import blank_to_null, fold, once, plain, squeeze, strip

# fixed values: patterns, limits and word lists
DATE = r"\b(\d{1,2}[/.\-]\d{1,2}[/.\-]\d{2,4}|\d{4}[/.\-]\d{1,2}[/.\-]\d{1,2})\b"
CHIP = r"(?<!\d)(\d{9,15})(?!\d)"
WEIGHT = r"(?i)([0-9]+(?:[.,][0-9]+)?)\s*(kgs?|gr?)?\b"
LEAST_KG, MOST_KG = 0.5, 120.0
SPECIES = (("canino", ("canina", "canino", "perro", "perra")), ("felino", ("felina", "felino", "gato", "gata")))
SEX_WORD = r"(?i)\b(hembra|macho|female|male)\b"
FEMALE = ("hembra", "female")
EDGES = " -:;,."


def unlabelled(x: Column, labels: tuple[str, ...]) -> Column:
    """A value without the labels that leaked into it; null if nothing is left."""
    out = squeeze(x)
    for label in labels:
        out = F.regexp_replace(out, rf"(?iU)\b{re.escape(label)}\b\s*[:\-]?\s*", "")
    return blank_to_null(squeeze(strip(out, EDGES)))


def digits_of_chip(x: Column) -> Column:
    """9 to 15 digits: a run of them, else all digits of the value taken together."""
    compact = once(F.regexp_replace(x, r"\D", ""), lambda c: F.when(F.length(c).between(9, 15), c))
    return F.coalesce(once(F.regexp_extract(x, CHIP, 1), lambda c: F.when(c != "", c)), compact)


# fixed values: labels of chip numbers, what names one in a text, and labels of other fields that may trail it
CHIP_LABELS = ("microchip", "micr0chip", "chip", "transponder", "identificación electrónica", "identificacion electronica", "nº chip", "n.o chip", "n° chip", "id")
CHIP_IN_TEXT = r"(?i)(?:microchip|micr0chip|chip|transponder|identificaci[oó]n\s+electr[oó]nica)\s*(?:n[ºo]\.?|nro\.?|id)?\s*[:\-]?\s*([^\n;]{3,80})"
AFTER_CHIP = r"(?i)(?:(?:^|\s)(?:paciente|propietario|propietaria|tutor|especie|raza|sexo|edad|fecha))+$"


def chip_with_evidence(value: Column, snippet: Column) -> Column:
    """A chip number from its value, else from what follows a chip's label in the evidence; without labels, marks and other fields' labels at its end."""
    label = rf"(?iU)\b(?:{'|'.join(map(re.escape, CHIP_LABELS))})\b\s*[:\-]?\s*"
    bare = lambda x: squeeze(strip(F.regexp_replace(squeeze(x), label, ""), EDGES))
    both = F.array(bare(value), bare(F.regexp_extract(squeeze(snippet), CHIP_IN_TEXT, 1)))
    text = F.try_element_at(F.filter(both, lambda x: x != ""), F.lit(1))
    whole = F.array(squeeze(F.regexp_replace(squeeze(F.regexp_replace(text, r"[^A-Za-z0-9./_\- ]+", " ")), AFTER_CHIP, "")))
    return F.transform(whole, digits_of_chip)[0]  # as an array's element a text is made once, however often it is used


def date_dmy(x: Column) -> Column:
    """A date as dd/mm/yyyy from d/m/y or y/m/d with slashes, dots or dashes; two-digit years from 69 on are in the last century."""
    raw = F.translate(F.regexp_extract(unlabelled(x, ("fecha", "date", "visita", "consulta")), DATE, 1), "-.", "//")

    def placed(part: Column) -> Column:
        first_year = F.length(part[0]) == 4
        year, month, day = F.when(first_year, part[0]).otherwise(part[2]), part[1], F.when(first_year, part[2]).otherwise(part[0])
        full = F.when(F.length(year) == 4, year.cast("int")).when(F.length(year) == 2, year.cast("int") + F.when(year.cast("int") >= 69, 1900).otherwise(2000))
        iso = lambda y: F.concat(F.lpad(y.cast("string"), 4, "0"), F.lit("-"), F.lpad(month, 2, "0"), F.lit("-"), F.lpad(day, 2, "0"))
        return once(full, lambda y: F.when(y > 0, F.date_format(F.try_to_date(iso(y), "yyyy-MM-dd"), "dd/MM/yyyy")))

    return once(raw, lambda r: F.when(r != "", once(F.split(r, "/"), placed)))


def visit_date(x: Column) -> Column:
    """A visit's date as ISO text: yyyy-mm-dd, dd/mm/yyyy or dd/mm/yy of this century, between 1900 and 2100."""
    day_first = r"^(\d{1,2})[/.\-](\d{1,2})[/.\-]"
    iso = F.regexp_replace(F.regexp_replace(F.trim(x), day_first + r"(\d{4})\z", "$3-$2-$1"), day_first + r"(\d{2})\z", "20$3-$2-$1")
    date = once(iso, lambda t: F.when(t.rlike(r"^\d{4}-\d{1,2}-\d{1,2}\z"), t).try_cast("date"))
    return once(date, lambda d: F.when(F.year(d).between(1900, 2100), d.cast("string")))


def weight_kg(x: Column) -> Column:
    """A weight as 'n kg' between the limits; grams count as thousandths, the comma as a point."""

    def in_kg(x: Column) -> Column:
        number = F.replace(F.regexp_extract(x, WEIGHT, 1), F.lit(","), F.lit(".")).try_cast("double")
        return once(number, lambda n: F.when(n.isNotNull(), F.when(F.lower(F.regexp_extract(x, WEIGHT, 2)).isin("g", "gr"), n / 1000.0).otherwise(n)))

    def shown(kg: Column) -> Column:
        text = F.when(kg == F.floor(kg), F.floor(kg).cast("string")).otherwise(F.regexp_replace(F.format_string("%.6f", kg), r"0+$", ""))
        return F.when(kg.between(LEAST_KG, MOST_KG), F.concat(text, F.lit(" kg")))

    return once(once(x, in_kg), shown)


def sex(x: Column) -> Column:
    word = F.lower(F.regexp_extract(unlabelled(x, ("sexo", "sex")), SEX_WORD, 1))
    return once(word, lambda w: F.when(w.isin(*FEMALE), "hembra").when(w != "", "macho"))


def species(x: Column) -> Column:
    """The species whose word a value holds, the first of the table."""

    def named(words: Column) -> Column:
        out = F.when(F.lit(False), "")
        for name, found in SPECIES:
            out = out.when(words.rlike(rf"\b(?:{'|'.join(found)})\b"), name)
        return out

    return once(plain(x), named)


def title(x: Column) -> Column:
    """Every run of letters with a capital first and small letters after it: O'Neil, Ana-Maria."""
    words = F.regexp_extract_all(x, F.lit(r"(\p{L}+|[^\p{L}]+)"), F.lit(1))
    return F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, 2, 1 << 30)))), "")


def species_and_breed(species: Column, breed: Column, evidence: Column) -> Column:
    """struct(species, breed) of a pair, mended from its own values and then from snippets (an array): the first word of a species names a missing one, and
    what is left of that source is the breed if there is none, or if the source was the species itself. A breed loses labels and words of species."""
    tokens = [w for _, found in SPECIES for w in found]
    bare = lambda x: squeeze(F.regexp_replace(F.regexp_replace(x, rf"(?iU)\b(?:{'|'.join(tokens)})\b", " "), r"[\-_/|]+", " "))
    both = F.transform(evidence, lambda e: F.coalesce(F.nullif(squeeze(F.regexp_extract(squeeze(e), r"(?i)(?:especie\s*/\s*raza|raza\s*/\s*especie)\s*[:\-]\s*([^\n;]{2,120})", 1)), F.lit("")), squeeze(e)))
    sources = F.filter(F.concat(F.array(species, breed), F.coalesce(both, F.array().cast("array<string>"))), lambda x: x.isNotNull())

    def named(x: Column) -> Column:
        out = lambda low: reduce(lambda rest, s: F.when(low.rlike(rf"(?U)\b(?:{'|'.join(s[1])})\b"), s[0]).otherwise(rest), reversed(SPECIES), F.lit(None).cast("string"))
        return once(fold(x), out)

    def step(s: Column, x: Column) -> Column:
        have = F.coalesce(F.nullif(s["species"], F.lit("")), x["name"])
        take = x["rest"].isNotNull() & (F.coalesce(s["breed"], F.lit("")).eqNullSafe(F.lit("")) | (x["own"] == have))
        return F.struct(F.when(x["name"].isNotNull(), have).otherwise(s["species"]).alias("species"), F.when(take, x["rest"]).otherwise(s["breed"]).alias("breed"))

    # what each source says is made once, before they are gone through; a source that names no species says nothing of the breed
    told = F.transform(sources, lambda x: once(named(x), lambda n: F.struct(x.alias("own"), n.alias("name"), F.when(n.isNotNull(), F.nullif(bare(x), F.lit(""))).alias("rest"))))
    pair = F.aggregate(told, F.struct(species.alias("species"), breed.alias("breed")), step)

    def shown(p: Column) -> Column:
        clean = F.nullif(bare(F.coalesce(unlabelled(p["breed"], ("raza", "breed")), F.lit(""))), F.lit(""))
        return F.struct(p["species"].alias("species"), F.array_join(F.transform(F.split(clean, " "), lambda w: F.when(w == F.lower(w), F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1 << 30))).otherwise(w)), " ").alias("breed"))

    return F.transform(F.array(pair), shown)[0]


def pet_name(x: Column) -> Column:
    """A name in title case without birth notes and labels; null for numbers and other fields' labels."""
    out = strip(F.regexp_replace(squeeze(x), r"(?iU)\s*[-–—]?\s*\b(?:f\.?\s*nac|fecha\s+(?:de\s+)?nac|nacimiento|nac\.?|dob|birth).*$", ""), EDGES)
    out = squeeze(F.regexp_replace(out, r"(?iU)^(?:paciente|nombre(?:\s+del\s+(?:paciente|animal))?|patient|animal|mascota)\s*[:\-|]\s*", ""))
    bad = lambda x: x.rlike(r"^[\d\s]+$") | x.rlike(r"(?iU)^(?:especie|raza|sexo|chip|microchip|fecha|edad|peso|propietari[oa])\b\s*[:\-]")
    return once(out, lambda x: F.when((x != "") & ~bad(x), title(x)))


def age_years(born: Column, on: Column) -> Column:
    """Whole years of age on a day: the difference of the years, less one before the birthday; null if born later."""
    early = F.date_format(on, "MMdd") < F.date_format(born, "MMdd")
    return F.when(born <= on, F.year(on) - F.year(born) - early.cast("int"))


def age_shown(born: Column, on: Column) -> Column:
    """Months under a year, else years, in words."""
    years = age_years(born, on)
    months = (F.year(on) - F.year(born)) * 12 + F.month(on) - F.month(born) - (F.dayofmonth(on) < F.dayofmonth(born)).cast("int")
    return F.when(years.isNull(), F.lit(None)).when(years < 1, F.concat(months.cast("string"), F.when(months == 1, " mes").otherwise(" meses"))).otherwise(F.concat(years.cast("string"), F.when(years == 1, " año").otherwise(" años")))


def same_value(old: Column, new: Column, kind: Column) -> Column:
    """Whether an edit changes nothing, by the type of the value: numbers and truth values by value, texts without regard to white space at the ends."""
    number = F.replace(F.trim(old), F.lit(","), F.lit(".")).try_cast("double").eqNullSafe(F.replace(F.trim(new), F.lit(","), F.lit(".")).try_cast("double"))
    return F.when(kind.isin("int", "number", "float", "decimal"), number).when(kind == "bool", fold(F.trim(old)).eqNullSafe(fold(F.trim(new)))).otherwise(blank_to_null(old).eqNullSafe(blank_to_null(new)))
