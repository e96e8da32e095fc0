"""The chart of visits: stored visits parsed, missing ones made, fields assigned, each visit's own text mined, and the current weight.

Fields are rows (document_id, field_id, key, value, snippet, scope, section, seq) with an optional offset; visits rows (document_id, visit_id, date, no), no their place in the
document's list. Every step is an aggregate, a window or a join on the document (and visit), so documents are independent of each other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.functions import patterns as P
from docloom.functions.normal import visit_date, weight_kg
from docloom.functions.text import blank_to_null
from docloom.operators import clauses, mining
from docloom.operators.keyed import latest
from docloom.operators.visits import classified, detection, first_visit_date, latest_weight, occurrences, resolved, said_dates, segment_values, segments, visit_order
from docloom.sources.scratch import written

#: Fields that a visit takes from its own text, in the order in which they are added.
SEGMENT_KEYS = ("diagnosis", "symptoms", "medication", "procedure", "weight")
UNASSIGNED = "unassigned"
VISITS = "document_id string, visit_id string, date string, admission_date string, discharge_date string, reason_for_visit string, no int, rest string"
KEPT = "document_id string, visit_id string, field_id string, key string, value string, snippet string, offset int, no int, rest string"
_FIELD_KEYS = ("field_id", "key", "value", "evidence")
_VISIT_KEYS = ("visit_id", "visit_date", "admission_date", "discharge_date", "reason_for_visit", "fields")


def _text(v, path: str):
    """A string at a path of a variant; null for anything that isn't a string."""
    return F.when(F.schema_of_variant(F.try_variant_get(v, path, "variant")) == "STRING", F.try_variant_get(v, path, "string"))


def _is(v, kind: str):
    return F.coalesce(F.schema_of_variant(v).startswith(kind), F.lit(False))


def _rest(v, known: tuple[str, ...]):
    """The members of an object under other names, as JSON; null if there are none."""
    more = F.map_filter(F.try_variant_get(v, "$", "map<string,variant>"), lambda k, _: ~k.isin(*known))
    return F.when(F.size(more) > 0, F.to_json(more))


def parsed_visits(payloads: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(visits, their fields, refused parts) of stored records (document_id, payload), JSON of any age.

    Payloads are read as variants, so no schema has to hold for all of them: a visit is any object in the list `visits`, a field any object in its list
    `fields`; members of other names stay in rest. A visit's date is brought into ISO form, or null. Refused, with a reason and the part as JSON: payloads that are no
    JSON object, lists of visits or fields that are no list, and visits or fields that are no object. Payloads that are null, or have no visits, give nothing.
    A visit whose visit_id is no text has null there; it counts for its date but takes no text of its own.
    """
    v = payloads.filter("payload is not null").select("document_id", "payload", F.try_parse_json("payload").alias("v"))
    whole = v.filter(_is(F.col("v"), "OBJECT")).select("document_id", F.try_variant_get("v", "$.visits", "variant").alias("list")).filter("list is not null and not is_variant_null(list)")
    refused = [v.filter(~_is(F.col("v"), "OBJECT")).select("document_id", F.lit("PAYLOAD_NOT_AN_OBJECT").alias("reason"), F.col("payload").alias("part"))]
    refused.append(whole.filter(~_is(F.col("list"), "ARRAY")).select("document_id", F.lit("VISITS_NOT_A_LIST").alias("reason"), F.to_json("list").alias("part")))
    each = whole.filter(_is(F.col("list"), "ARRAY")).select("document_id", F.posexplode(F.try_variant_get("list", "$", "array<variant>")).alias("at", "v"))
    refused.append(each.filter(~_is(F.col("v"), "OBJECT")).select("document_id", F.lit("VISIT_NOT_AN_OBJECT").alias("reason"), F.to_json("v").alias("part")))
    good = each.filter(_is(F.col("v"), "OBJECT")).withColumn("no", F.row_number().over(Window.partitionBy("document_id").orderBy("at")))
    text = lambda c: _text(F.col("v"), f"$.{c}").alias(c)
    visits = good.select("document_id", text("visit_id"), first_visit_date(_text(F.col("v"), "$.visit_date")).alias("date"), text("admission_date"), text("discharge_date"), text("reason_for_visit"), "no", _rest(F.col("v"), _VISIT_KEYS).alias("rest"))
    lists = good.select("document_id", _text(F.col("v"), "$.visit_id").alias("visit_id"), F.try_variant_get("v", "$.fields", "variant").alias("list")).filter("list is not null and not is_variant_null(list)")
    refused.append(lists.filter(~_is(F.col("list"), "ARRAY")).select("document_id", F.lit("FIELDS_NOT_A_LIST").alias("reason"), F.to_json("list").alias("part")))
    inner = lists.filter(_is(F.col("list"), "ARRAY")).select("document_id", "visit_id", F.posexplode(F.try_variant_get("list", "$", "array<variant>")).alias("at", "v"))
    refused.append(inner.filter(~_is(F.col("v"), "OBJECT")).select("document_id", F.lit("FIELD_NOT_AN_OBJECT").alias("reason"), F.to_json("v").alias("part")))
    fields = inner.filter(_is(F.col("v"), "OBJECT")).select("document_id", "visit_id", text("field_id"), text("key"), text("value"), _text(F.col("v"), "$.evidence.snippet").alias("snippet"), F.try_variant_get("v", "$.evidence.offset", "int").alias("offset"), F.col("at").alias("no"), _rest(F.col("v"), _FIELD_KEYS).alias("rest"))
    bad = refused[0]
    for r in refused[1:]:
        bad = bad.unionByName(r)
    return visits, fields, bad


def roster(dates: DataFrame, seen: DataFrame, known: DataFrame) -> DataFrame:
    """Rows (document_id, visit_id, date, no): the known visits (document_id, visit_id, date, no) and those that are missing.

    Every detected date (document_id, dates in order) has a visit, and a date that the text names n times has n. New visits are numbered on after the known ones: first those of
    dates in the order of detection, then the further ones of dates in the text's order.
    """
    wanted = dates.select("document_id", F.posexplode("dates").alias("at", "date")).select("document_id", "date", detection(0, F.col("at")), F.lit(None).cast("int").alias("told"))
    return _numbered(wanted.unionByName(seen.select("document_id", "date", F.lit(None).cast(wanted.schema["o"].dataType).alias("o"), F.col("offset").alias("told"))), known)


def detected_roster(fields: DataFrame, seen: DataFrame, known: DataFrame) -> DataFrame:
    """roster of the dates that detected_dates finds in fields and texts, without an array of them in between."""
    return _numbered(said_dates(fields).withColumn("told", F.lit(None).cast("int")).unionByName(seen.select("document_id", "date", detection(1, F.col("offset")), F.col("offset").alias("told"))), known)


def _numbered(rows: DataFrame, known: DataFrame) -> DataFrame:
    """The roster of rows (document_id, date, o, told): o the place of a detected date, told where the text names one. All rows are dealt out by document once; what follows is by document and date."""
    have = known.select("document_id", "date", F.lit(None).cast(rows.schema["o"].dataType).alias("o"), F.lit(None).cast("int").alias("told"), F.lit(1).alias("have"))
    every = rows.withColumn("have", F.lit(0)).unionByName(have).repartition("document_id")
    each = every.groupBy("document_id", "date").agg(F.min("o").alias("o"), F.count("told").alias("told"), F.min("told").alias("first"), F.sum("have").alias("have"))
    need = each.withColumns({"n": F.sum("have").over(Window.partitionBy("document_id")), "need": F.greatest(F.lit(1), F.col("told"))}).filter("o is not null and need > have")
    new = need.select("document_id", "date", "o", "first", "n", F.explode(F.sequence(F.col("have") + 1, F.col("need"))).alias("i"))
    order = (F.col("i") > 1, F.when(F.col("i") == 1, F.col("o")), F.col("first"), F.col("i"))
    number = (F.col("n") + F.row_number().over(Window.partitionBy("document_id").orderBy(*order))).cast("int")
    made = new.select("document_id", F.format_string("visit-%03d", number).alias("visit_id"), "date", number.alias("no"))
    return known.select("document_id", "visit_id", "date", F.col("no").cast("int").alias("no")).unionByName(made)


def segment_fields(cuts: DataFrame) -> DataFrame:
    """Rows (document_id, visit_id, key, value, snippet, offset, seq): what mining finds in each visit's text (segments), as in a text of its own, for
    SEGMENT_KEYS: the first value of a key, of weights the last in the text. All segments are mined in one pass."""
    joint = F.concat_ws("\u0001", "document_id", "visit_id")
    mined = mining.placed(cuts.select(joint.alias("document_id"), F.col("segment").alias("text")), SEGMENT_KEYS)
    part = F.split("document_id", "\u0001")
    best = segment_values(mined.select("document_id", "key", "value", "snippet", "offset", "seq"), ("document_id",))
    return best.select(part[0].alias("document_id"), part[1].alias("visit_id"), "key", "value", "snippet", "offset", "seq")


def weight_candidates(assigned: DataFrame, loose: DataFrame, roster_: DataFrame, docs: DataFrame) -> DataFrame:
    """Rows (document_id, date, offset, visit_no, field_no, value, snippet) of all dated weights of three sources: fields of visits (by the visit's date, else the evidence's), weights
    without a visit (by the evidence's date) and the text's latest weight under a timeline heading."""
    total = roster_.groupBy("document_id").agg(F.count("*").alias("n"))
    place = F.coalesce(F.col("offset").cast("double"), F.lit(-1.0)).alias("offset")
    dated = F.coalesce("date", first_visit_date(F.col("snippet"))).alias("date")
    own = assigned.filter("key = 'weight'").join(roster_, ["document_id", "visit_id"]).select("document_id", dated, place, F.col("no").cast("int").alias("visit_no"), F.col("field_no").cast("int").alias("field_no"), "value", "snippet")
    count = F.coalesce("n", F.lit(0)).cast("int")
    free = loose.filter("key = 'weight'").join(total, "document_id", "left").select("document_id", first_visit_date(F.col("snippet")).alias("date"), place, (count + 1).alias("visit_no"), F.row_number().over(Window.partitionBy("document_id").orderBy("seq")).cast("int").alias("field_no"), F.coalesce(weight_kg(F.col("value")), F.col("value")).alias("value"), "snippet")
    told = latest_weight(docs).join(total, "document_id", "left").select("document_id", "date", F.lit(-1.0).alias("offset"), (count + 2).alias("visit_no"), F.lit(0).alias("field_no"), F.col("weight").alias("value"), F.col("line").alias("snippet"))
    return own.unionByName(free).unionByName(told).filter("date is not null")


def current_weights(candidates: DataFrame) -> DataFrame:
    """Rows (document_id, date, value, snippet): of each document the latest weight of all sources: by date, then place of the evidence, visit and field."""
    best = latest(candidates, ["document_id"], ["date", "offset", "visit_no", "field_no"])
    return best.select("document_id", "date", F.coalesce(weight_kg(F.col("value")), F.col("value")).alias("value"), "snippet")


def no_visits(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """No known visits, and no fields of them."""
    return spark.createDataFrame([], VISITS), spark.createDataFrame([], KEPT)


def chart(docs: DataFrame, fields: DataFrame, known: DataFrame | None = None, kept: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(visits, fields of visits, fields of documents) of texts (document_id, text) with their fields and the visits stored before (known, kept: as parsed_visits gives them).

    Fields are classified, missing visits made and fields assigned by their evidence; each visit's text is then mined for what the visit lacks, with
    its observations, actions and reason; what is left of visits' data goes to the unassigned visit, weights without a visit to the document, whose weight is
    the latest of all sources. visits: document_id, visit_id, date, admission_date, discharge_date, reason_for_visit, n_fields, position; the unassigned visit stands
    last, and only if it holds something. Null texts have no dates; documents without fields and dates have no visits of their own.
    """
    spark = docs.sparkSession
    docs = docs.select("document_id", "text")
    if known is None or kept is None:
        known, kept = no_visits(spark)
    fields = fields if "offset" in fields.columns else fields.withColumn("offset", F.lit(None).cast("int"))
    seen = written(occurrences(docs), "seen")
    parts = written(classified(fields), "parts")
    listed = known.filter(~F.col("visit_id").eqNullSafe(F.lit(UNASSIGNED)))
    visits = written(detected_roster(parts, seen, listed), "roster")
    assigned = resolved(parts.filter("part = 'visit'"), docs, seen, visits)
    shape = ("document_id", "visit_id", "field_id", "key", "value", "snippet", "offset", "origin", "seq")
    placed = assigned.select("document_id", F.coalesce("visit_id", F.lit(UNASSIGNED)).alias("visit_id"), "field_id", "key", "value", "snippet", "offset", F.lit("assigned").alias("origin"), (F.lit(10**6) + F.col("seq")).alias("seq"))
    stored = kept.select("document_id", "visit_id", "field_id", "key", "value", "snippet", "offset", F.lit("stored").alias("origin"), F.col("no").cast("long").alias("seq"))
    have = stored.unionByName(placed)
    cuts = written(segments(docs, seen, visits), "cuts")
    found = segment_fields(cuts)
    at = F.create_map(*(F.lit(x) for i, k in enumerate((*SEGMENT_KEYS, "observations", "actions")) for x in (k, i)))
    said = clauses.observations_actions(cuts.select("document_id", "visit_id", "segment"))
    said = said.select("document_id", "visit_id", F.explode(F.create_map(F.lit("observations"), F.col("observations"), F.lit("actions"), F.col("actions"))).alias("key", "value")).filter("value is not null")
    new = found.select("document_id", "visit_id", "key", "value", "snippet", F.col("offset").cast("int").alias("offset")).unionByName(said.select("document_id", "visit_id", "key", "value", F.col("value").alias("snippet"), F.lit(None).cast("int").alias("offset")))
    derived = new.select("document_id", "visit_id", F.concat(F.lit("derived-"), F.col("key"), F.lit("-"), F.col("visit_id")).alias("field_id"), "key", "value", "snippet", "offset", F.lit("derived").alias("origin"), (F.lit(10**12) + at[F.col("key")]).alias("seq"))
    # what is derived and what the visits have come together once, by document; of a key that a visit has nothing is derived
    pool = have.withColumn("_new", F.lit(False)).unionByName(derived.select(*shape, F.lit(True).alias("_new"))).repartition("document_id")
    held = F.max(~F.col("_new")).over(Window.partitionBy("document_id", "visit_id", "key"))
    every = pool.withColumn("_held", held).filter(~F.col("_new") | ~F.col("_held") | F.col("visit_id").isNull()).select(*shape)
    every = written(every.withColumn("field_no", F.row_number().over(Window.partitionBy("document_id", "visit_id").orderBy("seq", "field_id"))), "every")
    loose = every.filter((F.col("visit_id") == UNASSIGNED) & (F.col("key") == "weight"))
    weight = written(current_weights(weight_candidates(every.filter(F.col("visit_id") != UNASSIGNED), loose, visits, docs)), "weights")
    of_visits = every.filter(~((F.col("visit_id") == UNASSIGNED) & (F.col("key") == "weight"))).select("document_id", "visit_id", "field_no", "field_id", "key", "value", "snippet", "offset", "origin")
    own = parts.filter("part = 'document'").select("document_id", "field_id", "key", "value", "snippet", "scope", "section", "seq")
    restored = loose.select("document_id", "field_id", "key", F.coalesce(weight_kg(F.col("value")), F.col("value")).alias("value"), "snippet", F.lit("document").alias("scope"), F.lit("patient").alias("section"), "seq")
    current = weight.select("document_id", F.lit("derived-weight-current").alias("field_id"), F.lit("weight").alias("key"), "value", "snippet", F.lit("document").alias("scope"), F.lit("patient").alias("section"), F.lit(10**13).alias("seq"))
    older = own.unionByName(restored).join(weight.select("document_id", F.lit("weight").alias("key")), ["document_id", "key"], "left_anti").select(*own.columns)
    return _listed(parts, visits, known, cuts, every, of_visits), of_visits, older.unionByName(current)


def _listed(parts: DataFrame, visits: DataFrame, known: DataFrame, cuts: DataFrame, every: DataFrame, of_visits: DataFrame) -> DataFrame:
    """The visits in order with their own data; the unassigned one, if it was stored or fields fell to it, takes the first of each of the document's data about visits."""
    meta = parts.filter("part = 'meta'").withColumn("value", F.when(F.col("key") == "visit_date", first_visit_date(F.col("value"))).otherwise(F.col("value"))).filter("value is not null")
    dated = visits.select("document_id", F.col("date").alias("value"), F.lit("visit_date").alias("key")).filter("value is not null").distinct()
    spare = meta.join(dated, ["document_id", "key", "value"], "left_anti").groupBy("document_id").agg(*(F.min(F.when(F.col("key") == k, F.struct("seq", "value")))["value"].alias(f"spare_{k}") for k in P.VISIT_META))
    n = of_visits.groupBy("document_id", "visit_id").agg(F.count("*").alias("n_fields"))
    own = known.groupBy("document_id", "visit_id").agg(*(F.first(c, ignorenulls=True).alias(c) for c in ("admission_date", "discharge_date", "reason_for_visit")))
    reason = cuts.select("document_id", "visit_id", clauses.reason_for_visit(F.col("segment")).alias("said"))
    rows = visits.join(own, ["document_id", "visit_id"], "left").join(reason, ["document_id", "visit_id"], "left")
    rows = rows.withColumn("reason_for_visit", F.coalesce(blank_to_null(F.col("reason_for_visit")), F.col("said"))).select("document_id", "visit_id", "date", "admission_date", "discharge_date", "reason_for_visit")
    stored = known.filter(F.col("visit_id") == UNASSIGNED).select("document_id", F.col("date").alias("own_visit_date"), *(F.col(c).alias(f"own_{c}") for c in ("admission_date", "discharge_date", "reason_for_visit"))).dropDuplicates(["document_id"])
    fell = every.filter(F.col("visit_id") == UNASSIGNED).select("document_id").unionByName(stored.select("document_id")).distinct()
    taken = {"date" if k == "visit_date" else k: F.coalesce(f"spare_{k}", f"own_{k}") for k in P.VISIT_META}
    last = fell.join(spare, "document_id", "left").join(stored, "document_id", "left").select("document_id", F.lit(UNASSIGNED).alias("visit_id"), *(c.alias(k) for k, c in taken.items()))
    both = rows.unionByName(last).join(n, ["document_id", "visit_id"], "left").withColumn("n_fields", F.coalesce("n_fields", F.lit(0)))
    alone = F.col("visit_id").eqNullSafe(F.lit(UNASSIGNED))
    held = (F.col("n_fields") > 0) | F.coalesce(*(blank_to_null(F.col(k)) for k in taken)).isNotNull()
    w = Window.partitionBy("document_id").orderBy(alone, *visit_order(F.col("date"), F.coalesce("visit_id", F.lit(""))))
    return both.filter(~alone | held).withColumn("position", F.row_number().over(w))
