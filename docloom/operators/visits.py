"""Visits: dates in texts, missing visits, the visit a field belongs to, segments of text, weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions import patterns as P
from docloom.functions.normal import visit_date, weight_kg
from docloom.functions.text import LINE_END, fold, matches, squeeze
from docloom.operators.keyed import carried, first_of, latest, nearest


def raw_lines(docs: DataFrame) -> DataFrame:
    """Rows (document_id, line_no, start, line): all lines with the offset at which each starts, blank ones too."""
    parts = F.split(F.coalesce("text", F.lit("")), "\n")
    rows = docs.select("document_id", F.posexplode(parts).alias("line_no", "raw"))
    before = F.sum(F.length("raw") + 1).over(Window.partitionBy("document_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumn("start", F.coalesce(before, F.lit(0))).withColumn("line", F.trim("raw"))


def occurrences(docs: DataFrame) -> DataFrame:
    """Rows (document_id, date, offset, line_start, k): dates of visits in the texts, by the words of their line; k counts the occurrences of a date.

    A line of another kind (births, invoices, lab) has none unless it reads like an entry of a timeline. A line that names a day takes the line before it
    into account.
    """
    rows = raw_lines(docs.filter(F.col("text").rlike(P.VISIT_DATE_CORE) & F.col("text").rlike(P.VISIT_DATE)))  # texts without a date aren't split
    w = Window.partitionBy("document_id").orderBy("line_no")
    previous = F.last(F.nullif("line", F.lit("")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("previous", F.coalesce(previous, F.lit("")))
    line = F.col("line")
    # the commonest kind is asked for first; only lines with a date are looked at
    speaks = line.rlike(P.VISIT_CONTEXT) | line.rlike(P.VISIT_LABEL) | line.rlike(P.VISIT_CLINICAL) | (line.rlike(P.VISIT_DAY_LINE) & F.col("previous").rlike(P.VISIT_CONTEXT))
    kept = rows.filter(F.col("raw").rlike(P.VISIT_DATE)).filter(line.rlike(P.VISIT_TIMELINE_LINE) | (speaks & ~line.rlike(P.NOT_VISIT)))
    found = matches(kept, "raw", P.VISIT_DATE, "document_id", "start")
    # as a generator's only element the date is made once
    placed = found.select("document_id", (F.col("start") + F.col("offset")).alias("offset"), F.col("start").alias("line_start"), F.explode(F.array_compact(F.array(visit_date(F.col("value"))))).alias("date"))
    return placed.select("document_id", "date", "offset", "line_start").withColumn("k", F.row_number().over(Window.partitionBy("document_id", "date").orderBy("offset")))


def missing_visits(seen: DataFrame, known: DataFrame) -> DataFrame:
    """Visits (document_id, visit_id, date) that texts name more often than they are known, numbered on after the known ones."""
    wanted, have = seen.groupBy("document_id", "date").agg(F.count("*").alias("wanted")), known.groupBy("document_id", "date").agg(F.count("*").alias("have"))
    gap = wanted.join(have, ["document_id", "date"], "left").withColumn("more", F.col("wanted") - F.coalesce("have", F.lit(0))).filter("more > 0")
    new = gap.select("document_id", "date", F.explode(F.sequence(F.lit(1), F.col("more").cast("int"))).alias("i"))
    total = known.groupBy("document_id").agg(F.count("*").alias("n"))
    number = F.coalesce("n", F.lit(0)) + F.row_number().over(Window.partitionBy("document_id").orderBy("date", "i"))
    return new.join(total, "document_id", "left").select("document_id", F.format_string("visit-%03d", number).alias("visit_id"), "date")


def headings(text: Column) -> Column:
    """The offsets of visits' headings in a text, as a sorted array; empty where there are none."""
    gaps, values = F.split(text, P.VISIT_BOUNDARY), F.regexp_extract_all(text, F.lit(f"({P.VISIT_BOUNDARY})"), F.lit(1))
    steps = F.zip_with(F.slice(gaps, 1, F.size(values)), values, lambda g, v: F.struct(F.length(g).alias("gap"), F.length(v).alias("own")))
    start = F.struct(F.lit(0).alias("end"), F.array().cast("array<int>").alias("heads"))
    placed = F.aggregate(steps, start, lambda s, m: F.struct((s["end"] + m["gap"] + m["own"]).alias("end"), F.concat(s["heads"], F.array(s["end"] + m["gap"])).alias("heads")))["heads"]
    return F.when(text.rlike(P.VISIT_BOUNDARY), placed).otherwise(F.array().cast("array<int>"))


def numbered_roster(roster: DataFrame) -> DataFrame:
    """A roster with no, the place of each visit in its document's list: as given, else by visit_id."""
    return roster if "no" in roster.columns else roster.withColumn("no", F.row_number().over(Window.partitionBy("document_id").orderBy("visit_id")))


def segments(docs: DataFrame, seen: DataFrame, roster: DataFrame) -> DataFrame:
    """Rows (document_id, visit_id, start, stop, segment): the text of each visit of the roster (document_id, visit_id, date).

    The k-th place of a date belongs to the k-th visit of that date, beyond the last to the last; a visit's first place counts. A segment begins at its
    line's start, or at a heading on that line before the date, and ends at the next heading or at the start of the next date's line. A document's
    places are an array beside its text, which is joined once, not once for each visit.
    """
    none = lambda kind: F.lit(None).cast(kind)
    # as a visit's first place counts, its place is that of its own number among its date's; places and visits are dealt out by document once, together
    marks = seen.select("document_id", "date", F.lit(False).alias("visit"), F.col("offset").cast("long").alias("at"), F.col("offset").cast("int").alias("offset"), F.col("line_start").cast("int").alias("line_start"), none("string").alias("visit_id"))
    owners = numbered_roster(roster).filter("date is not null").select("document_id", "date", F.lit(True).alias("visit"), F.col("no").cast("long").alias("at"), none("int").alias("offset"), none("int").alias("line_start"), "visit_id")
    both = marks.unionByName(owners).repartition("document_id")
    both = both.withColumn("next_line", F.lead("line_start").over(Window.partitionBy("document_id", "visit").orderBy("at"))).withColumn("k", F.row_number().over(Window.partitionBy("document_id", "date", "visit").orderBy("at")))
    place = F.when(~F.col("visit"), F.struct("offset", "line_start", "next_line"))
    owned = both.groupBy("document_id", "date", "k").agg(F.max("visit_id").alias("visit_id"), F.min(place).alias("p"), F.max("visit").alias("owned")).filter("owned and p is not null")
    owned = owned.groupBy("document_id", "visit_id").agg(F.min("p").alias("p"))
    places = owned.groupBy("document_id").agg(F.collect_list(F.struct("visit_id", "p.offset", "p.line_start", "p.next_line")).alias("places"))
    t = places.join(docs.select("document_id", "text"), "document_id").withColumn("heads", headings(F.coalesce("text", F.lit(""))))

    def cut(p: Column) -> Column:
        own_head = F.array_max(F.filter("heads", lambda h: (h <= p["offset"]) & (h >= p["line_start"])))
        next_head = F.array_min(F.filter("heads", lambda h: h > p["offset"]))
        start = F.coalesce(own_head, p["line_start"])
        stop = F.greatest(start, F.least(F.length("text"), next_head, p["next_line"]))
        return F.struct(p["visit_id"].alias("visit_id"), start.cast("int").alias("start"), stop.cast("int").alias("stop"), F.regexp_replace(F.substr("text", (start + 1).cast("int"), (stop - start).cast("int")), r"^\s+|\s+$", "").alias("segment"))

    return t.select("document_id", F.explode(F.transform("places", cut)).alias("s")).select("document_id", "s.*").filter("segment != ''")


def _offset_in(low: Column, snippet: Column) -> Column:
    part = fold(squeeze(snippet))
    at = lambda x: F.nullif(F.instr(low, x), F.lit(0)) - 1
    return F.when(F.length(part) >= 8, F.coalesce(at(part), F.when(F.length(part) >= 12, at(F.substring(part, 1, 48)))))


def snippet_offset(text: Column, snippet: Column) -> Column:
    """Where a snippet stands in a text, from 0, whatever its case: whole if it has 8 characters or more, else by its first 48 (12 at least); null if nowhere."""
    return _offset_in(fold(text), snippet)



def first_visit_date(x: Column) -> Column:
    """The first date in a text that can be a visit's, as ISO text; null if none can."""
    return F.try_element_at(F.array_compact(F.transform(F.regexp_extract_all(x, F.lit(f"({P.VISIT_DATE})"), F.lit(1)), visit_date)), F.lit(1))


def snippet_dates(snippet: Column) -> Column:
    """The dates of a snippet that speaks of a visit and of nothing else, each once, in order."""
    found = F.transform(F.regexp_extract_all(snippet, F.lit(f"({P.VISIT_DATE})"), F.lit(1)), visit_date)
    return F.when(snippet.rlike(P.VISIT_CONTEXT) & ~snippet.rlike(P.NOT_VISIT), F.array_distinct(F.array_compact(found))).otherwise(F.array().cast("array<string>"))


def _line_in(rows: Column, snippet: Column) -> Column:
    part = fold(squeeze(snippet))
    hit = F.filter(rows, lambda r: (r["line"] != "") & (F.contains(r["line"], part) | F.contains(part, r["line"])))
    return F.when(part != "", F.try_element_at(hit, F.lit(1))["no"])


def _folded_lines(text: Column) -> Column:
    return F.transform(F.split(F.coalesce(text, F.lit("")), LINE_END), lambda x, i: F.struct((i + 1).alias("no"), fold(squeeze(x)).alias("line")))


def line_of(text: Column, snippet: Column) -> Column:
    """The number, from 1, of the first line that holds a snippet or is held by it; null if none does or the snippet is blank."""
    return _line_in(_folded_lines(text), snippet)


def lines_of(text: Column, held: Column) -> Column:
    """An array of structs with a snippet, each with line, the number of its line; the text is split and folded once for all."""
    return F.transform(F.array(_folded_lines(text)), lambda rows: F.transform(held, lambda h: F.struct(h["key"].alias("key"), h["top1"].alias("top1"), h["confidence"].alias("confidence"), _line_in(rows, h["snippet"]).alias("line"))))[0]


def classified(fields: DataFrame) -> DataFrame:
    """Fields (document_id, key, value, snippet, scope, section) with their part: meta (what all visits have), visit or document.

    A weight is the visit's only if it says so itself or its evidence is dated. Fields of visits get the scope and section of visits.
    """
    said = (fold(F.trim("scope")) == "visit") | (fold(F.trim("section")) == "visits")
    weighed = F.coalesce(said, F.lit(False)) | (F.size(snippet_dates(F.coalesce("snippet", F.lit("")))) > 0)
    part = F.when(F.col("key").isin(*P.VISIT_META), "meta").when((F.col("key") == "weight") & ~weighed, "document").when(F.col("key").isin(*P.VISIT_KEYS), "visit").otherwise("document")
    f = fields.withColumn("part", part)
    return f.withColumns({"scope": F.when(F.col("part") == "visit", "visit").otherwise(F.col("scope")), "section": F.when(F.col("part") == "visit", "visits").otherwise(F.col("section"))})


def detection(source: int, at: Column) -> Column:
    """The place o of a detected date: those of fields (source 0) come before those of the text (1)."""
    return F.struct(F.lit(source).alias("source"), at.cast("long").alias("at")).alias("o")


def said_dates(fields: DataFrame) -> DataFrame:
    """Rows (document_id, date, o): the dates of visits that fields (classified, with seq) name."""
    of = F.when((F.col("part") == "meta") & (F.col("key") == "visit_date"), F.array_compact(F.array(visit_date(F.col("value"))))).when(F.col("part") == "visit", snippet_dates(F.coalesce("snippet", F.lit(""))))
    return fields.select("document_id", F.explode(of).alias("date"), detection(0, F.col("seq")))


def detected_dates(fields: DataFrame, seen: DataFrame) -> DataFrame:
    """Rows (document_id, dates): the dates of visits in the order in which fields (classified, with seq) and then the text name them, each once."""
    first = said_dates(fields).unionByName(seen.select("document_id", "date", detection(1, F.col("offset")))).groupBy("document_id", "date").agg(F.min("o").alias("o"))
    return first.groupBy("document_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("o", "date"))), lambda x: x["date"]).alias("dates"))


def resolved(fields: DataFrame, docs: DataFrame, seen: DataFrame, roster: DataFrame) -> DataFrame:
    """Fields (document_id, field_id, snippet) with their visit_id and how it was found.

    Evidence that names dates of visits: of the places of these dates the one nearest to the evidence decides (ties: the earlier date, then the earlier place),
    first between the headings around it, then anywhere; it stands for the k-th visit of its date. If the evidence or the dates aren't in the text, the first
    of its dates that has a visit counts. Evidence without any date goes by place in the same way, among all dates, if the document's visits have several; if they
    have one date only, it is that date's first visit. Else the visit is unassigned. A document's places, headings and visits come as arrays, so no pairs are joined.
    """
    k = F.row_number().over(Window.partitionBy("document_id", "date").orderBy("offset")) - 1
    places = seen.withColumn("k", k).groupBy("document_id").agg(F.collect_list(F.struct("offset", "date", "k")).alias("places"))
    visits = numbered_roster(roster).filter("date is not null").groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("no", "visit_id", "date"))).alias("visits"), F.countDistinct("date").alias("_n_dates"))
    # a document's fields, text, places and visits come together by document; its text is folded once for all its fields
    own = fields.groupBy("document_id").agg(F.collect_list(F.struct(*(c for c in fields.columns if c != "document_id"))).alias("_fields"))
    texts = docs.select("document_id", F.coalesce("text", F.lit("")).alias("_text"))
    t = own.join(texts, "document_id", "left").join(places, "document_id", "left").join(visits, "document_id", "left")
    t = t.withColumns({"heads": headings(F.col("_text")), "_low": F.array(fold(F.col("_text")))})
    found = F.transform("_low", lambda low: F.transform("_fields", lambda f: F.struct(f.alias("f"), _offset_in(low, f["snippet"]).alias("at"))))[0]
    f = t.select("document_id", "places", "visits", "_n_dates", "heads", F.explode(found).alias("_x")).select("document_id", "places", "visits", "_n_dates", "heads", "_x.f.*", "_x.at")
    snippet = F.coalesce("snippet", F.lit(""))
    f = f.withColumns({"_dates": snippet_dates(snippet), "_token": snippet.rlike(P.VISIT_DATE), "_n_dates": F.coalesce("_n_dates", F.lit(0))})
    at, none = F.col("at"), F.array()
    by_text = (F.size("_dates") > 0) | (~F.col("_token") & (F.col("_n_dates") > 1))
    near = F.filter(F.coalesce("places", none.cast("array<struct<offset:int,date:string,k:int>>")), lambda p: (F.size("_dates") == 0) | F.array_contains("_dates", p["date"]))
    ranked = F.transform(near, lambda p: F.struct(F.abs(p["offset"] - at).alias("far"), p["date"].alias("date"), p["k"].alias("k"), p["offset"].alias("offset")))
    heads = F.coalesce("heads", none.cast("array<int>"))
    low, high = F.array_max(F.filter(heads, lambda h: h <= at)), F.array_min(F.filter(heads, lambda h: h > at))
    f = f.withColumns({"_near": ranked, "_low": low, "_high": high})
    inside = F.filter("_near", lambda p: (F.col("_low").isNull() | (p["offset"] >= F.col("_low"))) & (F.col("_high").isNull() | (p["offset"] < F.col("_high"))))
    f = f.withColumn("_pick", F.when(at.isNotNull() & by_text, F.coalesce(F.array_min(inside), F.array_min("_near"))))
    same = F.filter("visits", lambda v: v["date"] == F.col("_pick.date"))
    by_place = F.try_element_at(same, F.least(F.col("_pick.k") + 1, F.size(same)))["visit_id"]
    dated = F.array_compact(F.transform("_dates", lambda d: F.try_element_at(F.filter("visits", lambda v: v["date"] == d), F.lit(1))["visit_id"]))
    f = f.withColumns({"_place": F.when(F.size(same) > 0, by_place), "_date": F.try_element_at(dated, F.lit(1))})
    by_date = F.when(F.col("_pick").isNull(), F.col("_date"))
    only = F.when(~F.col("_token") & (F.col("_n_dates") == 1), F.try_element_at("visits", F.lit(1))["visit_id"])
    how = F.when(F.col("_place").isNotNull(), "place").when(by_date.isNotNull(), "date").when(only.isNotNull(), "only").otherwise("unassigned")
    return f.select(*fields.columns, F.coalesce("_place", by_date, only).alias("visit_id"), how.alias("how"))


def distributed(meta: DataFrame, roster: DataFrame) -> DataFrame:
    """Rows (document_id, visit_date, admission_date, discharge_date, reason_for_visit) of the unassigned visit: the first value of each key (by seq); of visit
    dates the first that no visit of the roster has."""
    norm = F.when(F.col("key") == "visit_date", visit_date(F.col("value"))).otherwise(F.col("value"))
    m = meta.filter(F.col("key").isin(*P.VISIT_META)).withColumn("value", norm).filter("value is not null")
    known = roster.select("document_id", F.col("date").alias("value"), F.lit("visit_date").alias("key")).distinct()
    free = m.join(known, ["document_id", "key", "value"], "left_anti")
    return free.groupBy("document_id").agg(*(F.min(F.when(F.col("key") == k, F.struct("seq", "value")))["value"].alias(k) for k in P.VISIT_META))


def finalised(roster: DataFrame, assigned: DataFrame, leftover: DataFrame) -> DataFrame:
    """Rows (document_id, visit_id, date, n_fields, position): visits by date, without one last, then id; the unassigned visit at the end if it holds a field
    (assigned: document_id, visit_id, null for none) or something distributed to it."""
    n = assigned.groupBy("document_id", F.coalesce("visit_id", F.lit("unassigned")).alias("visit_id")).agg(F.count("*").alias("n_fields"))
    rest = n.filter("visit_id = 'unassigned'").select("document_id").unionByName(leftover.filter(" or ".join(f"{k} is not null" for k in P.VISIT_META)).select("document_id")).distinct()
    every = roster.select("document_id", "visit_id", "date").unionByName(rest.select("document_id", F.lit("unassigned").alias("visit_id"), F.lit(None).cast("string").alias("date")))
    out = every.join(n, ["document_id", "visit_id"], "left").withColumn("n_fields", F.coalesce("n_fields", F.lit(0)))
    w = Window.partitionBy("document_id").orderBy(F.col("visit_id") == "unassigned", *visit_order(F.col("date"), F.col("visit_id")))
    return out.withColumn("position", F.row_number().over(w))


def visits_of(docs: DataFrame, fields: DataFrame, known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(visits, fields of visits) of texts: fields (document_id, field_id, key, value, snippet, scope, section, seq) are classified, missing visits made,
    fields assigned by their evidence, what is left distributed, and the list put in order. known has the visits there are (document_id, visit_id, date)."""
    seen = occurrences(docs)
    parts = classified(fields)
    wanted = detected_dates(parts, seen).select("document_id", F.explode("dates").alias("date"))
    told = seen.select("document_id", "date").unionByName(wanted.join(seen.select("document_id", "date").distinct(), ["document_id", "date"], "left_anti"))
    roster = known.select("document_id", "visit_id", "date").unionByName(missing_visits(told, known))
    assigned = resolved(parts.filter("part = 'visit'"), docs, seen, roster)
    return finalised(roster, assigned, distributed(parts.filter("part = 'meta'"), roster)), assigned


def assign(fields: DataFrame, visits: DataFrame) -> DataFrame:
    """Fields (document_id, field_id, evidence_date, offset) with a visit (visit_id) and how it was found.

    A date in the evidence that one visit has decides; else the visit nearest to the evidence's place; else a document's only visit; else none.
    """
    dated = visits.groupBy("document_id", "date").agg(F.min("visit_id").alias("by_date"))
    only = visits.groupBy("document_id").agg(F.count("*").alias("_n"), F.min("visit_id").alias("by_only")).filter("_n = 1").drop("_n")
    close = nearest(fields.filter("offset is not null"), visits.filter("offset is not null"), ["document_id"], "offset", "offset", "visit_id").select("document_id", "field_id", F.col("nearest_id").alias("by_place"))
    f = fields.join(dated, (fields.document_id == dated.document_id) & (fields.evidence_date == dated.date), "left").select(fields["*"], "by_date").join(close, ["document_id", "field_id"], "left").join(only, "document_id", "left")
    how = F.when(F.col("by_date").isNotNull(), "date").when(F.col("by_place").isNotNull(), "place").when(F.col("by_only").isNotNull(), "only").otherwise("unassigned")
    return f.select(*fields.columns, F.coalesce("by_date", "by_place", "by_only").alias("visit_id"), how.alias("how"))


def scoping_metrics(assigned: DataFrame) -> DataFrame:
    """Per document: fields in all, with a visit, placed by their evidence, and without a visit."""
    return assigned.groupBy("document_id").agg(F.count("*").alias("total"), F.count("visit_id").alias("assigned"), F.count_if(F.col("how").isin("date", "place")).alias("anchored"), F.count_if(F.col("visit_id").isNull()).alias("unassigned"))


def latest_weight(docs: DataFrame) -> DataFrame:
    """Rows (document_id, date, weight, line): the last weight at or under the latest heading with date and time of each text, and its line."""
    line = F.col("line")
    # only headings and lines with a weight count; what is read from them is made once, as a generator's only element
    weighed = line.rlike(r"(?i)[0-9]\s*k?g")  # cheap, and without it there is no weight
    texts = docs.filter(F.col("text").rlike(r"[0-9]:[0-9]{2}") & F.col("text").rlike(r"(?i)[0-9]\s*k?g"))  # a heading names a time
    rows = raw_lines(texts).select("document_id", "line_no", "line").filter(line.rlike(P.TIMELINE_HEADER) | (weighed & line.rlike(P.WEIGHT_TOKEN)))
    token = lambda g: F.regexp_extract("line", P.WEIGHT_TOKEN, g)
    headed = F.when(line.rlike(P.TIMELINE_HEADER), F.struct(visit_date(F.regexp_extract("line", P.TIMELINE_HEADER, 1)).alias("own")))
    read = F.struct(headed.alias("head"), F.when(weighed, weight_kg(F.concat_ws(" ", token(1), token(2)))).alias("weight"))
    rows = rows.select("document_id", "line_no", "line", F.explode(F.array(read)).alias("r")).select("document_id", "line_no", "line", "r.*")
    dated = carried(rows, ["document_id"], ["line_no"], F.col("head"), "_head").withColumn("date", F.col("_head.own"))
    return latest(dated.filter("weight is not null and date is not null").select("document_id", "date", "weight", "line", "line_no"), ["document_id"], ["date", "line_no"]).drop("line_no")


def newest_weight(candidates: DataFrame) -> DataFrame:
    """The latest of weight candidates (document_id, date, offset, visit_no, field_no, value) of all sources: by date, then place, then order."""
    return latest(candidates, ["document_id"], ["date", "offset", "visit_no", "field_no"])


def segment_values(mined: DataFrame, visit: tuple[str, ...] = ("document_id", "visit_id")) -> DataFrame:
    """One value for each visit and key of candidates mined from segments (document_id, visit_id, key, value, offset, seq): a weight's last, else the first."""
    weight = F.when(F.col("key") == "weight", -F.col("offset")).otherwise(F.col("seq"))
    return first_of(mined, [*visit, "key"], [weight.asc(), F.asc("seq")])



def latest_past(date: Column, on: Column) -> Column:
    """Aggregate: the latest of dates that don't lie after a day; null if all do."""
    return F.max(F.when(date <= on, date))


def visit_order(date: Column, visit_id: Column) -> list[Column]:
    """Visits by date, those without one last, then by id."""
    return [F.coalesce(date, F.lit("9999-12-31")).asc(), visit_id.asc()]
