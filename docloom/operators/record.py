"""The canonical record: fields of the best candidates in their normal forms, checked against the contract."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions import normal, patterns as P
from docloom.functions.text import blank_to_null, fold, once, squeeze, strip
from docloom.operators import mining
from docloom.sources.scratch import written


def clinic_name(x: Column) -> Column:
    out = squeeze(strip(F.regexp_replace(squeeze(x), P.CLINIC_NAME_LABEL, ""), normal.EDGES))
    address = lambda x: x.rlike(r"\d") & x.rlike(r"(?iu)\b(?:c/|calle|av\.?|avenida|cp\b|portal|piso|puerta|direcci[oó]n|domicilio)\b")
    return once(out, lambda x: F.when((x != "") & ~address(x), x))


def _address(x: Column, lead: str, short: tuple[tuple[str, str], ...]) -> Column:
    out = strip(F.regexp_replace(squeeze(x), lead, ""), normal.EDGES)
    for pattern, word in short:
        out = F.regexp_replace(out, pattern, word)
    return blank_to_null(strip(squeeze(F.regexp_replace(out, r"\s*,\s*", ", ")), " ,;."))


def clinic_address(x: Column) -> Column:
    return _address(x, P.CLINIC_ADDRESS_LEAD, P.CLINIC_ABBREVIATIONS)


def owner_address(x: Column) -> Column:
    """An address needs a digit and a word of addresses, and no other field's label."""
    out = _address(x, P.OWNER_ADDRESS_LEAD, P.OWNER_ABBREVIATIONS)
    return once(out, lambda x: F.when(x.rlike(r"\d") & x.rlike(P.OWNER_ADDRESS_WORD) & ~(F.contains(x, F.lit(":")) & x.rlike(P.OWNER_ADDRESS_OTHER)), x))


#: How each field is brought into form; fields that aren't listed stay as they are.
NORMAL = {
    "pet_name": normal.pet_name, "clinic_name": clinic_name, "clinic_address": clinic_address, "owner_address": owner_address, "species": normal.species, "sex": normal.sex, "microchip_id": normal.digits_of_chip,
    "breed": lambda x: normal.unlabelled(x, ("raza", "breed")), "dob": normal.date_dmy, "visit_date": normal.date_dmy, "document_date": normal.date_dmy, "admission_date": normal.date_dmy, "discharge_date": normal.date_dmy,
}


def normalised(best: DataFrame) -> DataFrame:
    """Ranked candidates with their value in its normal form; those without one drop out."""
    # as a generator's only element the value is made once; what follows, up to each column of the record, would make it again
    return best.withColumn("value", F.explode(F.array(_normal()))).filter("value is not null")


def _normal() -> Column:
    """A candidate's value in the normal form of its key; null if it has none or is blank."""
    key, value = F.col("key"), F.col("value")
    shaped = value
    for k, f in NORMAL.items():
        shaped = F.when(key == k, f(value)).otherwise(shaped)
    return once(shaped, lambda x: F.when(F.trim(x) != "", x))


def missing_keys(record: DataFrame, contract: DataFrame) -> DataFrame:
    """Contract keys without a value in each document, as rows (document_id, key)."""
    have = record.select("document_id", "key").distinct()
    return record.select("document_id").distinct().crossJoin(F.broadcast(contract.select("key"))).join(have, ["document_id", "key"], "left_anti")


def with_derived(wide: DataFrame, as_of: Column) -> DataFrame:
    """A wide record with the document's date from the visit's and the age from the birth date where they are missing."""
    d = wide.withColumn("document_date", F.coalesce("document_date", "visit_date"))
    on = F.coalesce(F.try_to_date("visit_date", "dd/MM/yyyy"), F.try_to_date("document_date", "dd/MM/yyyy"), as_of)
    born = F.try_to_date("dob", "dd/MM/yyyy")
    derived = normal.age_years(born, on).cast("string")
    return d.withColumn("age_origin", F.when(F.col("age").isNull() & derived.isNotNull(), "derived").when(F.col("age").isNotNull(), "extracted")).withColumn("age", F.coalesce("age", derived))


def of_texts(docs: DataFrame, as_of: Column) -> tuple[DataFrame, DataFrame]:
    """(records, ranked candidates) of texts (document_id, text): the best candidates in normal form as one wide row per document, species and breed mended
    from each other and their evidence, dates and age filled in. A text without candidates has no row."""
    ranked = written(mining.ranked(mining.placed(docs)), "ranked")
    # a document's values and the evidence of its species and breed are gathered together, in one pass
    shaped = ranked.select("document_id", "key", "rank", "snippet", F.explode(F.array(_normal())).alias("value"))
    proof = F.when(F.col("key").isin("species", "breed") & (F.col("rank") == 1), F.struct((F.col("key") == "breed").alias("breed"), "snippet"))
    whole = shaped.groupBy("document_id").agg(F.collect_list(F.when(F.col("value").isNotNull(), F.struct("key", "rank", "value"))).alias("held"), F.transform(F.sort_array(F.collect_list(proof)), lambda s: s["snippet"]).alias("_proof"))
    wide = mining.fields_of(whole.filter(F.size("held") > 0)).drop("held")
    pair = wide.withColumn("_pair", normal.species_and_breed(F.col("species"), F.col("breed"), F.col("_proof")))
    mended = pair.withColumns({"species": F.col("_pair.species"), "breed": F.col("_pair.breed")}).drop("_pair", "_proof")
    return with_derived(mended, as_of), ranked


def visit_inputs(ranked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(fields, known visits) of ranked candidates, as visits.visits_of takes them: a field per candidate, no visit known before."""
    table = mining.contract(ranked.sparkSession).select("key", "section")
    fields = ranked.select("document_id", F.concat_ws(":", "key", "rank").alias("field_id"), "key", "value", "snippet", F.lit(None).cast("string").alias("scope"), "seq").join(F.broadcast(table), "key")
    return fields, ranked.sparkSession.createDataFrame([], "document_id string, visit_id string, date string")


def same(x: Column, y: Column) -> Column:
    """Equality of a field's values in accuracy figures."""
    return fold(squeeze(F.coalesce(x, F.lit("")))) == fold(squeeze(F.coalesce(y, F.lit(""))))


def accuracy(cases: DataFrame) -> DataFrame:
    """Shares over rows (expected, got): exact matches, misses of a value, values where none is."""
    e, g = F.coalesce("expected", F.lit("")) != "", F.coalesce("got", F.lit("")) != ""
    return cases.agg(F.count("*").alias("n"), F.avg(same(F.col("expected"), F.col("got")).cast("double")).alias("exact"), F.avg((e & ~g).cast("double")).alias("missed"), F.avg((~e & g).cast("double")).alias("false_positive"))
