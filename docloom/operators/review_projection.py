"""What reviewers are given: the canonical view of a stored record, ages filled in, sections of fields, definitions of visits' fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions import normal
from docloom.functions.text import blank_to_null
from docloom.operators.keyed import first_of
from docloom.operators.visits import latest_past

# fixed values: the view's version and contract, its sections, its slots (concept, section, key, alias), and how sections are called
VIEW_VERSION, VIEW_CONTRACT = "mvp-1", "visit-grouped-canonical"
SECTIONS = ("clinic", "patient", "owner", "visits", "notes", "other", "report_info")
SLOTS = (
    ("clinic.name", "clinic", "clinic_name", None), ("clinic.address", "clinic", "clinic_address", None), ("clinic.vet_name", "clinic", "vet_name", None), ("clinic.nhc", "clinic", "nhc", "medical_record_number"),
    ("patient.pet_name", "patient", "pet_name", None), ("patient.species", "patient", "species", None), ("patient.breed", "patient", "breed", None), ("patient.sex", "patient", "sex", None), ("patient.age", "patient", "age", None), ("patient.dob", "patient", "dob", None), ("patient.microchip_id", "patient", "microchip_id", None), ("patient.weight", "patient", "weight", None), ("patient.reproductive_status", "patient", "reproductive_status", "repro_status"),
    ("owner.name", "owner", "owner_name", None), ("owner.address", "owner", "owner_address", "owner_id"), ("notes.main", "notes", "notes", None), ("report.language", "report_info", "language", None),
)
SECTION_NAMES = {"clinic": "Centro Veterinario", "patient": "Paciente", "owner": "Propietario", "visits": "Visitas", "notes": "Notas internas", "other": "Otros campos detectados", "report_info": "Detalles del informe"}
KEY_SECTIONS = {"notes": "Notas internas", "language": "Detalles del informe", "owner_address": "Propietario", "owner_name": "Propietario", "nhc": "Centro Veterinario", "medical_record_number": "Centro Veterinario"}
OLD_SECTIONS = {"Identificacion del caso": "Centro Veterinario", "Datos de la clínica": "Centro Veterinario", "Visita / episodio": "Visitas", "Clinico": "Visitas", "Metadatos / revisión": "Detalles del informe"}
AGE_FIELD = {"value_type": "string", "scope": "document", "section": "patient", "classification": "medical_record", "domain": "clinical", "is_critical": "true"}


def _named(table: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for pair in table.items() for x in pair))


def canonical_view(records: DataFrame) -> DataFrame:
    """Rows (document_id, version, sections, field_slots, schema_contract, visits, other_fields, rest) of stored records (document_id, payload) that are JSON objects.

    The view's version, sections and slots are the record's own where they have the right kind (text, list, list), else the default ones; visits and other fields are lists in any
    case; the contract is the canonical one and an old schema_version goes. Lists and rest, all other members, are JSON. Payloads that are no object have no row.
    """
    v = records.select("document_id", F.try_parse_json("payload").alias("v")).filter(F.schema_of_variant("v").startswith("OBJECT"))
    part = lambda path: F.try_variant_get("v", path, "variant")
    kind = lambda x, k: F.coalesce(F.schema_of_variant(x).startswith(k), F.lit(False))
    slot = lambda c, s, k, a: F.struct(F.lit(c).alias("concept_id"), F.lit(s).alias("section"), F.lit("document").alias("scope"), F.lit(k).alias("canonical_key"), F.when(F.lit(a is not None), F.array(F.lit(a))).alias("aliases"), F.lit(k).alias("label_key"))
    sections, slots = part("$.medical_record_view.sections"), part("$.medical_record_view.field_slots")
    version = part("$.medical_record_view.version")
    listed = lambda x: F.when(kind(x, "ARRAY"), F.to_json(x)).otherwise("[]")
    known = ("medical_record_view", "schema_contract", "schema_version", "visits", "other_fields")
    rest = F.map_filter(F.try_variant_get("v", "$", "map<string,variant>"), lambda k, _: ~k.isin(*known))
    return v.select(
        "document_id", F.when(F.schema_of_variant(version) == "STRING", F.try_variant_get("v", "$.medical_record_view.version", "string")).otherwise(VIEW_VERSION).alias("version"),
        F.when(kind(sections, "ARRAY"), F.to_json(sections)).otherwise(F.to_json(F.array(*map(F.lit, SECTIONS)))).alias("sections"), F.when(kind(slots, "ARRAY"), F.to_json(slots)).otherwise(F.to_json(F.array(*(slot(*s) for s in SLOTS)))).alias("field_slots"),
        F.lit(VIEW_CONTRACT).alias("schema_contract"), listed(part("$.visits")).alias("visits"), listed(part("$.other_fields")).alias("other_fields"), F.to_json(rest).alias("rest"),
    )


def reference_dates(records: DataFrame, visits: DataFrame, as_of: Column) -> DataFrame:
    """Rows (document_id, on): the latest visit (document_id, date as ISO text) that isn't in the future, else the record's document_date (dd/mm/yyyy) if it isn't, else the day itself."""
    past = visits.select("document_id", F.try_to_date("date", "yyyy-MM-dd").alias("date")).groupBy("document_id").agg(latest_past(F.col("date"), as_of).alias("last"))
    own = F.try_to_date("document_date", "dd/MM/yyyy")
    return records.join(past, "document_id", "left").select("document_id", F.coalesce("last", F.when(own <= as_of, own), as_of).alias("on"))


def projected_ages(records: DataFrame, fields: DataFrame, visits: DataFrame, as_of: Column) -> DataFrame:
    """Rows (document_id, age, age_origin, age_display) of records (document_id, age, dob, document_date) with an age.

    The record's age, else that of its first age field, else the years from birth to the reference date. The origin is derived for the last, else human if the
    field is a person's. A derived age under a year is shown in months, others in years; an age that isn't a number isn't shown.
    """
    first = first_of(fields.filter("key = 'age'"), ["document_id"], [F.asc("seq")]).select("document_id", blank_to_null(F.col("value")).alias("_value"), F.when(F.col("origin").isin("human", "machine", "derived"), F.col("origin")).alias("_hint"))
    r = records.join(first, "document_id", "left").join(reference_dates(records, visits, as_of), "document_id")
    given = F.coalesce(blank_to_null(F.col("age")), F.trim("_value"))
    born = F.try_to_date("dob", "dd/MM/yyyy")
    years = normal.age_years(born, F.col("on"))
    age = F.coalesce(given, years.cast("string"))
    origin = F.when(given.isNull(), "derived").otherwise(F.col("_hint"))
    plain = F.when(age.rlike("^[0-9]+$"), F.concat(age.cast("int").cast("string"), F.when(age.cast("int") == 1, " año").otherwise(" años")))
    shown = F.when((origin == "derived") & (years.cast("string") == age), normal.age_shown(born, F.col("on"))).otherwise(plain)
    return r.select("document_id", age.alias("age"), F.when(origin.isin("human", "derived"), origin).otherwise("machine").alias("age_origin"), shown.alias("age_display")).filter("age is not null")


def upsert_ages(fields: DataFrame, ages: DataFrame) -> DataFrame:
    """Fields (document_id, field_id, key, value, origin, display_value, seq and any of AGE_FIELD's columns) after ages (document_id, age, age_origin, age_display): a document's first age field
    takes the value, origin and display, and what it lacks; a document without one gets a critical field of its own, after its others."""
    kinds = dict(fields.dtypes)
    first = fields.filter("key = 'age'").groupBy("document_id").agg(F.min("seq").alias("_first"))
    f = fields.join(ages, "document_id", "left").join(first, "document_id", "left")
    hit = (F.col("key") == "age") & (F.col("seq") == F.col("_first")) & F.col("age").isNotNull()
    new = {"value": F.col("age"), "origin": F.col("age_origin"), "display_value": F.col("age_display")} | {c: F.coalesce(F.col(c), F.lit(x).cast(kinds[c])) for c, x in AGE_FIELD.items() if c in kinds}
    patched = f.select(*(F.when(hit, new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in fields.columns))
    last = fields.groupBy("document_id").agg(F.max("seq").alias("_last"))
    made = ages.join(first, "document_id", "left_anti").join(last, "document_id", "left")
    values = {"document_id": F.col("document_id"), "field_id": F.lit("backfill-age"), "key": F.lit("age"), "value": F.col("age"), "origin": F.col("age_origin"), "display_value": F.col("age_display"), "seq": F.coalesce(F.col("_last") + 1, F.lit(0))} | {c: F.lit(x) for c, x in AGE_FIELD.items()}
    return patched.unionByName(made.select(*(values.get(c, F.lit(None)).cast(kinds[c]).alias(c) for c in fields.columns)))


def section_shown(key: Column, section: Column, fallback: Column) -> Column:
    """The name of the section a field is shown in: that of its own section, else of its key, else of the fallback; old names are brought up to date, others stay."""
    own = _named(SECTION_NAMES)
    called = lambda x: own[F.lower(F.trim(x))]
    return F.coalesce(called(section), _named(KEY_SECTIONS)[key], called(fallback), _named(OLD_SECTIONS)[F.coalesce(section, fallback)], fallback)


def visit_definitions(fields: DataFrame) -> DataFrame:
    """Rows (document_id, key, section, position, value_type, repeatable, critical): one for each key of a document's fields of visits (scope visit, not classified as other), in the order in
    which they are first seen (seq), with the first one's type and weight."""
    mine = fields.filter("scope = 'visit' and coalesce(classification, '') != 'other'")
    one = mine.groupBy("document_id", "key").agg(F.min(F.struct("seq", "value_type", F.coalesce("is_critical", F.lit(False)).alias("critical"))).alias("f"))
    placed = one.groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("f.seq", "key", "f.value_type", "f.critical"))).alias("all"))
    rows = placed.select("document_id", F.posexplode("all").alias("at", "d"))
    return rows.select("document_id", "d.key", F.lit(SECTION_NAMES["visits"]).alias("section"), (F.lit(3000) + F.col("at")).alias("position"), "d.value_type", F.lit(True).alias("repeatable"), "d.critical")
