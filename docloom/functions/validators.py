"""Validators of field values: reasons why an accepted value looks wrong, and acceptance with a normal form."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import plain

# fixed values: limits, words and the names of reasons
STREET = r"(?iu)\b(?:c/|calle|av\.?|avenida|plaza|paseo|camino|carretera|ctra\.?|portal|puerta)\b"
ADDRESS_WORD = r"(?iu)\b(?:c/|calle|av\.?|avenida|plaza|paseo|camino|carretera|ctra\.?|portal|piso|puerta|cp\b|c\.p\.|codigo\s+postal|n[º°o]?)\b"
PHONE_WORD = r"(?iu)\b(?:tel(?:[eé]fono)?|movil|m[oó]vil)\b"
DATE_KEYS = ("document_date", "visit_date", "admission_date", "discharge_date", "dob")
KEY_NAMES = {"microchip": "microchip_id", "peso": "weight", "edad": "age", "sexo": "sex", "especie": "species"}
SEX_WORDS = {"hembra": ("hembra", "female"), "macho": ("macho", "male")}
SPECIES_WORDS = {"canino": ("canino", "canina", "perro", "perra"), "felino": ("felino", "felina", "gato", "gata")}


def _flags(*rules: tuple[Column, str]) -> Column:
    return F.array_compact(F.array(*(F.when(when, F.lit(name)) for when, name in rules)))


def first_number(x: Column) -> Column:
    return F.replace(F.regexp_extract(x, r"-?\d+(?:[.,]\d+)?", 0), F.lit(","), F.lit(".")).try_cast("double")


def suspicious(key: Column, value: Column, clinic_address: Column, visit_date: Column, as_of: Column) -> Column:
    """Reasons why an accepted value looks wrong, in order; other fields of the same run (clinic_address, visit_date) and the day come as columns."""
    v = F.trim(value)
    low, size, digits = plain(v), F.length(v), F.regexp_replace(v, r"\D", "")
    number = first_number(v)
    chip = _flags((v.rlike(r"\p{L}"), "microchip_contains_letters"), (F.size(F.split(v, r"\s+")) > 1, "microchip_multiple_words"), (~size.between(9, 15), "microchip_length_out_of_range"), (~v.rlike(r"^\d+$"), "microchip_non_digit_characters"), (v.rlike(PHONE_WORD), "microchip_phone_context"), (v.rlike(r"(?iu)\b(?:nif|dni|nie|pasaporte|documento)\b"), "microchip_document_id_context"), ((F.length(digits) == 9) & digits.rlike("^[6-9]"), "microchip_phone_like_digits"))
    weight = _flags((F.regexp_replace(v, r"(?i)(?<![A-Za-z])kgs?(?![A-Za-z])", "").rlike("[A-Za-z]"), "weight_contains_non_kg_letters"), (number.isNull(), "weight_missing_numeric_value"), ((number < 0.5) | (number > 120), "weight_out_of_range"))
    pet = _flags((v.rlike(r"^\d+$"), "pet_name_numeric_only"), (size <= 1, "pet_name_too_short"), (v.rlike(r"(?iu)\b(?:especie|raza|sexo|chip|fecha|peso)\b"), "pet_name_contains_field_label"), (v.rlike(r"\d{2}[/\-.]\d{2}[/\-.]\d{2,4}"), "pet_name_contains_embedded_date"), (low.isin("nombre", "datos", "cliente", "historial", "visita"), "pet_name_is_stopword"))
    clinic = _flags((v.rlike(r"^\d+$"), "clinic_name_numeric_only"), (size <= 2, "clinic_name_too_short"), (v.rlike(r"(?iu)\b(?:c/|calle|av\.?|avenida|cp\b|portal|piso|puerta|direcci[oó]n|domicilio)\b") & v.rlike(r"\d"), "clinic_name_address_like"), (~low.rlike(r"\b(?:clinica|veterinari|hospital|centro|vet)\b"), "clinic_name_missing_institution_token"))
    address = _flags((v.rlike(r"^\d+$"), "clinic_address_numeric_only"), (size < 10, "clinic_address_too_short"), (v.rlike(r"(?iu)\b[\w.+-]+@[\w.-]+\.[A-Za-z]{2,}\b"), "clinic_address_contains_email"), (v.rlike(PHONE_WORD), "clinic_address_contains_phone_token"), (v.rlike(r"\b\d{9,}\b"), "clinic_address_contains_phone_number"), (low.rlike(r"\b(?:po\s*box|apartado\s+postal|apdo\.?\s*postal)\b") & ~v.rlike(STREET), "clinic_address_po_box_without_street"))
    owner = _flags((size < 10, "owner_address_too_short"), (size > 120, "owner_address_too_long"), (~(low.rlike(ADDRESS_WORD) & v.rlike(r"\d")), "owner_address_no_address_tokens"), (plain(F.trim(clinic_address)) == low, "owner_address_matches_clinic_address"))
    born = F.try_to_date(F.when(v.rlike(r"^\d{1,2}/\d{1,2}/\d{4}$"), v), "d/M/yyyy")
    dob = _flags((born > as_of, "dob_future_date"), (F.datediff(as_of, born) / 365.25 > 40, "dob_implausibly_old"), (born.isNotNull() & (F.trim(visit_date) == v), "dob_matches_visit_date"))
    own = (
        F.when(key == "microchip_id", chip).when(key == "weight", weight).when(key == "species", _flags((~low.isin("canino", "felino"), "species_outside_allowed_set"))).when(key == "sex", _flags((~low.isin("macho", "hembra"), "sex_outside_allowed_set")))
        .when(key == "pet_name", pet).when(key == "clinic_name", clinic).when(key == "clinic_address", address).when(key == "owner_address", owner).when(key == "dob", dob).otherwise(F.array().cast("array<string>"))
    )
    return F.when(F.coalesce(v, F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.concat(_flags((size > 80, "value_too_long")), own))


def canonical_key(key: Column) -> Column:
    k = F.lower(F.trim(key))
    names = F.create_map(*(F.lit(x) for pair in KEY_NAMES.items() for x in pair))
    return F.coalesce(names[k], k)


def _by_word(x: Column, words: dict[str, tuple[str, ...]]) -> Column:
    out = F.lit(None).cast("string")
    for name, found in words.items():
        out = F.when(x.isin(*found), name).otherwise(out)
    return out


def iso_date(x: Column) -> Column:
    """A date as yyyy-mm-dd from yyyy-m-d, d/m/y or y/m/d; two-digit years from 70 on are in the last century."""
    lead, dmy, ymd = r"^(\d{4})-(\d{1,2})-(\d{1,2})(?:[T\s].*)?$", r"\b(\d{1,2})[/.-](\d{1,2})[/.-](\d{4}|\d{2})\b", r"\b(\d{4})[/.-](\d{1,2})[/.-](\d{1,2})\b"
    part = lambda p, i: F.nullif(F.regexp_extract(x, p, i), F.lit(""))
    year2 = part(dmy, 3)
    year = F.when(F.length(year2) == 2, F.when(year2.cast("int") >= 70, F.concat(F.lit("19"), year2)).otherwise(F.concat(F.lit("20"), year2))).otherwise(year2)
    joined = F.when(x.rlike(lead), F.concat_ws("-", part(lead, 1), part(lead, 2), part(lead, 3))).when(x.rlike(dmy), F.concat_ws("-", year, part(dmy, 2), part(dmy, 1))).when(x.rlike(ymd), F.concat_ws("-", part(ymd, 1), part(ymd, 2), part(ymd, 3)))
    return F.date_format(F.try_to_date(joined, "yyyy-M-d"), "yyyy-MM-dd")


def accept(key: Column, value: Column) -> Column:
    """struct(ok, normalized, reason) of a value of a field."""
    v, k = F.trim(F.coalesce(value, F.lit(""))), canonical_key(key)
    compact = F.regexp_replace(v, r"[\s-]+", "")
    lead = F.nullif(F.regexp_extract(compact, r"^(\d{9,15})\D+$", 1), F.lit(""))
    chip = F.coalesce(lead, F.when(compact.rlike(r"^\d{9,15}$"), compact))
    kg = F.replace(F.regexp_extract(v, r"(?i)^(\d+(?:[.,]\d+)?)\s*(?:kgs?)?\s*$", 1), F.lit(","), F.lit(".")).try_cast("double")
    shown = F.when(kg == F.floor(kg), F.floor(kg).cast("string")).otherwise(kg.cast("string"))
    normal = (
        F.when(v == "", F.lit(None)).when(k == "microchip_id", chip).when(k == "weight", F.when(kg.between(0.5, 120), F.concat(shown, F.lit(" kg")))).when(k == "sex", _by_word(F.lower(v), SEX_WORDS)).when(k == "species", _by_word(F.lower(v), SPECIES_WORDS))
        .when(k == "age", F.when(v.rlike(r"^\d{1,3}$"), v.try_cast("int").cast("string"))).when(k.isin(*DATE_KEYS) | k.startswith("fecha_"), iso_date(v)).otherwise(v)
    )
    reason = (
        F.when(v == "", "empty").when(normal.isNotNull(), F.lit(None)).when(k == "microchip_id", F.when(compact == "", "empty").when(compact.rlike(r"^\d+$"), "invalid-length").otherwise("non-digit"))
        .when(k == "weight", F.when(kg == 0, "empty").otherwise("invalid-weight")).when(k.isin("sex", "species", "age"), F.concat(F.lit("invalid-"), k)).otherwise("invalid-date")
    )
    return F.struct(normal.isNotNull().alias("ok"), normal.alias("normalized"), reason.alias("reason"))
