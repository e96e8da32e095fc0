"""Mining of field candidates from texts, and their ranking into a record.

Every extractor gives rows (document_id, key, seq, value, snippet, confidence, anchor, priority, reason); seq orders them as they would be read, and the
first accepted of equal values wins. Documents are exploded into lines once, each with the lines around it.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions import patterns as P
from docloom.functions.normal import CHIP, digits_of_chip, species, title as titled
from docloom.functions.scores import FALLBACK_CONFIDENCE, LABEL_CONFIDENCE, kept_confidence
from docloom.functions.text import cue, fold, holds, last_index_back, matches, once, squeeze, strip
from docloom.operators import people_places
from docloom.operators.cues import cued, may_hold
from docloom.operators.keyed import first_of, top
from docloom.operators.line_rows import emitted, entry, line_rows, lines_at
from docloom.sources.scratch import at_most, parts, spread, written

COLUMNS = ("document_id", "key", "seq", "value", "snippet", "confidence", "anchor", "priority", "reason")


def _candidates(df: DataFrame, rank: int, key: Column | str, place: Column, value: Column, snippet: Column, confidence: float | Column, anchor: Column | None = None, priority: Column | None = None, reason: Column | None = None) -> DataFrame:
    none = F.lit(None).cast("string")
    return df.select("document_id", (F.lit(key) if isinstance(key, str) else key).alias("key"), (F.lit(rank * 10**9) + place).cast("long").alias("seq"), value.alias("value"), snippet.alias("snippet"), (F.lit(confidence) if isinstance(confidence, float) else confidence).alias("confidence"), (none if anchor is None else anchor).alias("anchor"), (F.lit(0) if priority is None else priority).cast("int").alias("priority"), (none if reason is None else reason).alias("reason"))


def _found(text: Column, pattern: str, may: Column | None = None) -> Column:
    """Array of (value, snippet) of a pattern's matches, in texts that may hold any. Most have none: they are looked through once, not once for each group."""
    pairs = F.zip_with(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda v, s: F.struct(v.alias("value"), s.alias("snippet")))
    return F.when(text.rlike(pattern) if may is None else may & text.rlike(pattern), pairs).otherwise(F.array().cast("array<struct<value:string,snippet:string>>"))


def labelled(docs: DataFrame, keys: tuple[str, ...] | None = None) -> DataFrame:
    """Matches of the label table, in its order, of all keys or of the given ones. Where docs carries cues, a text is matched with the patterns that it holds a word of."""
    x = F.coalesce("text", F.lit(""))

    def tagged(i: int, key: str):
        return lambda m, j: F.struct(F.lit(key).alias("key"), (F.lit(i * 10**6) + j).alias("place"), m["value"].alias("value"), m["snippet"].alias("snippet"))

    # where a match can't begin, the alternatives of a pattern aren't tried
    each = [F.transform(_found(x, f"(?iu){f'(?=[{P.LABEL_STARTS[i]}])' if P.LABEL_STARTS[i] else ''}{p}", may_hold(docs, i)), tagged(i, k)) for i, (k, p) in enumerate(P.LABELLED) if keys is None or k in keys]
    if not each:
        each = [F.array().cast("array<struct<key:string,place:int,value:string,snippet:string>>")]
    rows = docs.select("document_id", "text", F.explode(F.concat(*each)).alias("m")).select("document_id", "text", "m.*")
    # an address under a general label isn't the clinic's if one of the two lines above speaks of the owner
    above = F.filter(F.split(F.substr("text", F.lit(1), F.greatest(F.lit(0), F.instr("text", F.trim("snippet")) - 1)), "\n"), lambda x: F.trim(x) != "")
    owners = F.concat_ws(" ", F.try_element_at(above, F.lit(-2)), F.try_element_at(above, F.lit(-1))).rlike(P.OWNER_CONTEXT)
    rows = rows.filter(~((F.col("key") == "clinic_address") & F.col("snippet").rlike(P.GENERIC_ADDRESS_LABEL) & ~F.col("snippet").rlike(P.CLINIC_ADDRESS_LABEL) & owners))
    return _candidates(rows, 0, F.col("key"), F.col("place"), F.col("value"), F.col("snippet"), LABEL_CONFIDENCE)


def windowed(docs: DataFrame, rank: int, key: str, pattern: str, value: Column, confidence: float, may: Column | None = None) -> DataFrame:
    """Matches whose window (group 1, column v) holds a value, in texts that may hold any."""
    rows = docs.select("document_id", F.posexplode(_found(F.coalesce("text", F.lit("")), pattern, may)).alias("place", "m")).select("document_id", "place", F.col("m.value").alias("v"), F.col("m.snippet").alias("snippet"))
    return _candidates(rows.withColumn("value", value).filter("value is not null"), rank, key, F.col("place"), F.col("value"), F.col("snippet"), confidence)


def dates(docs: DataFrame) -> DataFrame:
    """Dates by the words around them: the anchor of the highest priority within 70 characters says which date it is, else the document's."""
    found = matches(docs.filter("text is not null"), "text", P.ANY_DATE, "document_id", "text")
    start = F.greatest(F.lit(0), F.col("offset") - 70)
    around = F.substr("text", start + 1, F.col("offset") + F.length("value") + 70 - start)
    seen = found.withColumn("around", around).withColumn("low", fold(F.col("around")))
    first = lambda words: F.coalesce(*(F.when(F.contains("low", F.lit(w)), F.lit(w)) for w in words))
    best = F.array_compact(F.array(*(F.when(first(words).isNotNull(), F.struct(F.lit(p).alias("p"), F.lit(-i).alias("i"), F.lit(k).alias("key"), first(words).alias("anchor"))) for i, (k, p, words) in enumerate(P.DATE_ANCHORS))))
    b = seen.withColumn("best", F.array_max(best))
    anchor = F.coalesce("best.anchor", F.lit("fallback"))
    return _candidates(b, 3, F.coalesce("best.key", F.lit("document_date")), F.col("match_no"), F.col("value"), squeeze(F.col("around")), F.when(F.col("best").isNotNull(), LABEL_CONFIDENCE).otherwise(FALLBACK_CONFIDENCE), anchor, F.coalesce("best.p", F.lit(1)), F.when(F.col("best").isNotNull(), F.concat(F.lit("anchor:"), F.col("best.anchor"))).otherwise("fallback_document_date"))


def plain_dates(docs: DataFrame) -> DataFrame:
    """Every day-first date as a date of the document, with the 36 characters on both sides."""
    found = matches(docs.filter("text is not null"), "text", rf"\b{P.NUMERIC_DATE}\b", "document_id", "text")
    start = F.greatest(F.lit(0), F.col("offset") - 36)
    return _candidates(found, 2, "document_date", F.col("match_no"), F.col("value"), F.substr("text", start + 1, F.col("offset") + F.length("value") + 36 - start), FALLBACK_CONFIDENCE)


def from_lines(docs: DataFrame, keys: tuple[str, ...] | None = None) -> DataFrame:
    """Extractors that read lines: birth date in the header, timeline, chip numbers near their label, clinical lines, sex, species, weight, persons and places.

    All of them look at each line once, in one pass over rows that carry the lines around. Only rules of the given keys are asked, if any are given.
    """
    # the header ends with line 20, and so do its contexts; the first such line of a text counts
    headed = lambda rows, n: F.array_join(F.slice(rows, n, F.least(F.lit(9), F.greatest(F.lit(1), 21 - n))), "\n")
    short = r"^[0-9]{1,2}[/\-.][0-9]{1,2}[/\-.][0-9]{2}$"

    def first_head(rows: Column) -> Column:
        at = F.transform(F.slice(rows, 1, 20), lambda x, i: F.when((F.length(x) <= 8) & x.rlike(short), i + 1))
        return F.array_min(F.filter(at, lambda n: n.isNotNull() & once(headed(rows, n), lambda h: h.rlike(P.CHIP_LABEL) | h.rlike(CHIP))))

    births = keys is None or "dob" in keys
    rows = line_rows(docs, **{"first_head": first_head} if births else {})
    # words that a pattern can't match without are looked for first: most lines have none of them
    rows = rows.withColumns({"cue": cue(F.col("line")), "cut": F.when(F.contains("line", F.lit(":")), F.split("line", ":", 2)).when(F.contains("line", F.lit("-")), F.split("line", "-", 2))})
    rows = rows.withColumns({"head": F.lower(F.col("cut")[0]), "rest": F.col("cut")[1]})
    line, low, no, seen = F.col("line"), F.col("low"), F.col("line_no"), F.col("cue")
    header = F.array_join(F.slice("around", F.col("own"), F.least(F.lit(9), F.greatest(F.lit(1), 21 - no))), "\n")
    out = []

    def rule(key: str, *rest, **how) -> None:
        if keys is None or key in keys:
            out.append(entry(key, *rest, **how))

    if births:
        rule("dob", 1, no, line, header, FALLBACK_CONFIDENCE, gate=no == F.col("first_head"), plain=True)
    timeline = r"^-\s*([0-9]{1,2}/[0-9]{1,2}/[0-9]{2,4})\s*-"
    rule("document_date", 4, no, F.regexp_extract("line", timeline, 1), line, FALLBACK_CONFIDENCE, "timeline_unanchored", gate=line.startswith("-") & line.rlike(timeline))
    labels = F.exists(F.concat(lines_at(-8, -1), lines_at(1, 8)), lambda x: x.rlike(P.CHIP_LABEL))
    rule("microchip_id", 6, no, once(digits_of_chip(line), lambda x: F.when(x.isNotNull(), F.when(labels, x))), F.array_join(lines_at(-8, 8), "\n"), LABEL_CONFIDENCE, gate=line.rlike("^[^0-9]*+(?:[0-9][^0-9]*+){9}"))
    has = lambda x, words: holds(x, *words)
    colon, head, rest = F.contains("line", F.lit(":")), F.col("head"), F.col("rest")
    clinical = [(k, (rest != "") & has(head, words), rest, LABEL_CONFIDENCE) for k, words in P.CLINICAL_LABELS]
    clinical += [(k, has(low, words) & ~colon if k == "diagnosis" else has(low, words), line, FALLBACK_CONFIDENCE) for k, words in P.CLINICAL_WORDS]
    for i, (k, gate, value, c) in enumerate(clinical):
        rule(k, 20, no * 100 + i, value, line, c, gate=gate, plain=True)
    inside = (holds(seen, "centr", "nica", "hospital") & line.rlike(P.CLINIC_IN_LINE), F.concat_ws(" ", F.regexp_replace(F.regexp_extract("line", P.CLINIC_IN_LINE, 1), "(?i)^centr0$", "Centro"), strip(F.regexp_extract("line", P.CLINIC_IN_LINE, 2), " .,:;\t")))
    alone = (holds(seen, "v", "hospital", "centro", "nica") & line.rlike(P.CLINIC_LINE) & ~F.regexp_extract("line", P.CLINIC_LINE, 2).rlike("(?i)^de "), F.concat_ws(" ", F.regexp_replace(F.regexp_extract("line", P.CLINIC_LINE, 1), r"(?i)^h\.?\s*v\.?$", "HV"), strip(F.regexp_extract("line", P.CLINIC_LINE, 2), " .,:;\t")))
    for i, (gate, value) in enumerate((inside, alone)):
        rule("clinic_name", 18, no * 100 + i, value, line, FALLBACK_CONFIDENCE, gate=gate)
    next4 = F.lower(F.array_join(lines_at(0, 3), " "))
    patient = next4.rlike("canino|felino|raza|chip|especie")
    born = F.nullif(squeeze(F.regexp_extract("line", P.PET_BIRTH_LINE, 1)), F.lit(""))
    birth = holds(seen, "nac", "dob", "birth") & line.rlike(P.PET_BIRTH_LINE)
    pet = once(born, lambda x: F.when(~x.rlike(P.PET_GUARD) & (F.size(F.split(x, " ")) <= 3) & (patient | next4.rlike("nac")), x))
    title = F.length("line").between(3, 40) & ~colon & line.rlike(r"^(?:\p{Lu}[\p{Ll}]*|\p{Lu}+)(?:[\s'-]+(?:\p{Lu}[\p{Ll}]*|\p{Lu}+)){0,2}$") & ~line.rlike(P.PET_GUARD) & ~low.rlike(r"^(?:nombre|especie|raza|sexo|chip|n[ºo°]?\s*chip|fecha|paciente|propietari[oa]|veterinari[oa]|diagn[oó]stico|tratamiento|medicaci[oó]n|vacunaci[oó]n|canin[oa]|felin[oa]|macho|hembra|historial|informe|ficha|capa|edad|peso)\b")
    around1, before3 = F.array_join(lines_at(-1, 1), " "), lines_at(-3, 1)
    single = low.isin("m", "macho", "male", "h", "hembra", "female")
    short = F.when(F.contains(F.lower(around1), F.lit("sexo")), F.when(low.isin("m", "macho", "male"), "macho").otherwise("hembra"))
    kg = F.regexp_replace(F.lower(F.regexp_extract("line", P.WEIGHT_LINE, 2)), "^kgs$", "kg")
    dated = F.array_join(before3, " ")
    weight = F.contains(seen, F.lit("g")) & line.rlike(P.WEIGHT_LINE)
    weighed = F.when(dated.rlike(P.ANY_DATE) | dated.rlike(P.VISIT_TIMELINE) | (F.col("n_lines") <= 5), F.concat(F.regexp_extract("line", P.WEIGHT_LINE, 1), F.lit(" "), kg))
    body = (("pet_name", birth, pet, line), ("pet_name", title, F.when(patient, titled(line)), line), ("sex", has(low, ("macho", "male")), F.lit("macho"), line), ("sex", has(low, ("hembra", "female")), F.lit("hembra"), line), ("species", ~F.contains("low", F.lit(" ")), species(low), line), ("sex", single, short, around1), ("weight", weight, weighed, F.array_join(before3, "\n")))
    for i, (k, gate, value, snippet) in enumerate(body):
        rule(k, 21, no * 100 + i, value, snippet, FALLBACK_CONFIDENCE, gate=gate)
    if keys is None or not people_places.KEYS.isdisjoint(keys):
        out += people_places.entries()
    return emitted(rows, out)


def accepted(c: DataFrame) -> DataFrame:
    """Candidates with their value brought into form, without those that a field's rules reject."""
    value, snippet, low = strip(F.col("value"), " .,:;\t\r\n"), F.col("snippet"), fold(F.col("snippet"))
    chip = F.regexp_extract(value, CHIP, 1)
    chip = F.when((chip != "") & F.contains(F.regexp_replace(snippet, r"[\s\-.]", ""), chip), chip)
    key = F.col("key")
    clinic_ok = ~(low.rlike(P.OWNER_CONTEXT) & ~low.rlike(P.CLINIC_ADDRESS_CONTEXT))
    shaped = (
        F.when(value == "", F.lit(None).cast("string"))
        .when(key == "microchip_id", chip)
        .when(key == "owner_name", F.when(~snippet.rlike(P.VET_OR_CLINIC), people_places.person(people_places.before_address(value))))
        .when(key == "vet_name", people_places.person(value))
        .when(key == "clinic_name", F.when(~low.rlike("direcci[oó]n|domicilio") & ~(value.rlike(P.ADDRESS_LIKE) & value.rlike(r"\d")), value))
        .when(key == "clinic_address", F.when(clinic_ok, value))
        .when(key == "owner_address", F.when(~(low.rlike(P.CLINIC_ADDRESS_CONTEXT) & ~low.rlike(P.OWNER_ADDRESS_CONTEXT)), value))
        .when(key == "weight", F.when(~snippet.rlike(P.WEIGHT_GUARD) | snippet.rlike(P.WEIGHT_EXPLICIT), value))
        .when((key == "clinical_record_number") & value.rlike(rf"\b{P.NUMERIC_DATE}\b"), F.lit(None).cast("string"))
        .otherwise(value)
    )
    # as a generator's only element the value is made once; a filter on the expression itself would be pushed into each branch and make it there again
    return c.withColumn("value", F.explode_outer(F.array(shaped))).filter("value is not null").withColumn("confidence", kept_confidence(F.col("confidence")))


def hinted(docs: DataFrame) -> DataFrame:
    """Documents that hold a word or shape without which no extractor finds anything (docs has cues)."""
    return docs.filter("hint")


def mine(docs: DataFrame, keys: tuple[str, ...] | None = None) -> DataFrame:
    """The candidates of placed, written: for what reads them several times."""
    return written(placed(docs, keys), "mined")


def placed(docs: DataFrame, keys: tuple[str, ...] | None = None) -> DataFrame:
    """All candidates of documents (document_id, text) with offset, after acceptance; of equal folded values of a key the first. Accepted ones are written, so that what is built on
    them doesn't plan the extractors anew, and then dealt out by document once, for all that follows by document and key. With keys, only their candidates are made: keys don't depend on each
    other, so these are the same as without."""
    asked = lambda *of: keys is None or any(k in keys for k in of)
    # looked through once and written: each extractor reads the few documents that are left, and each label pattern those with one of its words
    docs = written(hinted(cued(spread(docs.select("document_id", "text")))).drop("hint").repartition(parts(docs.sparkSession), "document_id"), "hinted")
    found = [labelled(docs, keys), from_lines(docs, keys)]
    if asked("document_date"):
        found.append(plain_dates(docs))
    if asked(*(k for k, *_ in P.DATE_ANCHORS)):
        found.append(dates(docs))
    if asked("microchip_id"):
        found += [windowed(docs, 5, "microchip_id", P.CHIP_WINDOW, digits_of_chip(F.col("v")), LABEL_CONFIDENCE, may_hold(docs, P.CHIP_RULE)), windowed(docs, 8, "microchip_id", P.CHIP_OCR_WINDOW, digits_of_chip(F.col("v")), FALLBACK_CONFIDENCE)]
    if asked("clinical_record_number"):
        found.append(windowed(docs, 7, "clinical_record_number", P.RECORD_WINDOW, F.trim("v"), LABEL_CONFIDENCE, may_hold(docs, P.RECORD_RULE)))
    if asked("language"):
        low = fold(F.coalesce("text", F.lit("")))
        spanish = docs.filter(F.exists(F.array(low), lambda t: reduce(or_, (F.contains(t, F.lit(w)) for w in P.SPANISH_HINTS))))
        found.append(_candidates(spanish, 30, "language", F.lit(0), F.lit("es"), F.lit("Heuristic language inference based on Spanish clinical tokens"), FALLBACK_CONFIDENCE))
    every = reduce(DataFrame.unionByName, found)
    if keys is not None:
        every = every.filter(F.col("key").isin(*keys))
    with at_most(docs.sparkSession, "spark.sql.codegen.hugeMethodLimit", 8000, 65535):  # longer generated methods aren't compiled by the JVM but interpreted
        ok = written(accepted(every), "accepted")  # the extractors' plan ends here: what follows is planned without it
    kept = first_of(ok.repartition("document_id").withColumn("_fold", fold(F.col("value"))), ["document_id", "key", "_fold"], [F.asc("seq")]).drop("_fold")
    texts = docs.select("document_id", F.reverse("text").alias("_back"))  # a text is turned round once, not once for each candidate
    return kept.withColumn("snippet", F.trim("snippet")).join(texts, "document_id").withColumn("offset", last_index_back(F.col("_back"), F.col("snippet"))).drop("_back").withColumn("snippet", F.substring("snippet", 1, 220))


def rank_keys(c: DataFrame) -> DataFrame:
    """Candidates with the three numbers (k1, k2, k3) by which those of a key are ranked, all descending."""
    key, value, snippet = F.col("key"), F.trim("value"), F.coalesce("snippet", F.lit(""))
    low, low_snippet = fold(value), fold(snippet)
    num = lambda when, x: F.when(when, F.lit(float(x))).otherwise(F.lit(0.0))
    chip_words = num(low_snippet.rlike(P.CHIP_LABEL), 0.5) + num(low_snippet.rlike(r"(?U)\b(?:tel(?:[eé]fono)?|movil|m[oó]vil|nif|dni)\b"), -0.5)
    chip = F.when(value.rlike(r"^\d{9,15}$"), 2.0).when(value.rlike(CHIP), 1.0).otherwise(0.0) + chip_words
    pet = num(~value.rlike(r"\d") & ~value.rlike(r"(?i)^(?:especie|raza|sexo|chip|fecha)") & F.length(value).between(2, 40), 1)
    address = low.rlike(P.ADDRESS_LIKE) & low.rlike(r"\d")
    token = low.rlike(r"(?U)\b(?:cl[ií]nic|veterinari|hospital|centro|vet|h\.?\s*v\.?)\b")
    clinic = F.when(low.rlike(r"(?U)\bh\.?\s*v\.?\b") & ~address, 3.0).when(token & ~address, 2.0).when(token, 1.0).otherwise(0.0)
    postal = value.rlike(r"\b\d{5}\b") | F.contains(low, F.lit("cp"))
    clinic_address = num(low_snippet.rlike(P.OWNER_CONTEXT), -2) + num(value.rlike(P.STREET_START), 1) + num(postal, 1) + num(F.contains(snippet, F.lit("\n")), 0.5)
    owner = low_snippet.rlike(P.OWNER_ADDRESS_CONTEXT)
    owner_address = num(owner, 2) + num(low_snippet.rlike(P.CLINIC_ADDRESS_CONTEXT) & ~owner, -2) + F.when(low.rlike(P.ADDRESS_SPLIT), 1.5).otherwise(-1.0) + num(postal, 0.5) + num(value.rlike(r"\d"), 0.5) + num(value.rlike(rf"^{P.NUMERIC_DATE}$"), -2)
    weight = num(snippet.rlike(P.ANY_DATE), 1) + num(snippet.rlike(P.WEIGHT_OTHER), -0.5)
    k1 = F.when(key.isin("visit_date", "document_date", "admission_date", "discharge_date", "dob"), F.col("priority").cast("double")).when(key == "microchip_id", chip).when(key == "pet_name", pet).when(key == "clinic_name", clinic).when(key == "clinic_address", clinic_address).when(key == "owner_address", owner_address).when(key == "weight", weight).otherwise(0.0)
    return c.withColumns({"k1": k1, "k2": F.col("confidence"), "k3": F.when(key == "weight", F.col("offset").cast("double")).otherwise(-1.0)})


def ranked(c: DataFrame) -> DataFrame:
    """The best candidate of each key, of repeatable keys the best three, with rank; ties keep the order of mining. Keys outside the contract drop out."""
    rows = top(rank_keys(c), ["document_id", "key"], [F.desc("k1"), F.desc("k2"), F.desc("k3"), F.asc("seq")], 3)
    table = contract(c.sparkSession)
    return rows.join(F.broadcast(table.select("key", "repeatable")), "key").filter("rank = 1 or repeatable").drop("repeatable")


def contract(spark: SparkSession) -> DataFrame:
    """The canonical record's fields: a fixed short table."""
    return spark.createDataFrame([(i, *row) for i, row in enumerate(P.CONTRACT)], "position int, key string, section string, value_type string, repeatable boolean, critical boolean")


def suggestions(c: DataFrame, most: int = 5) -> DataFrame:
    """Per document and key the distinct values with the highest confidence, as an ordered array of (value, confidence, snippet)."""
    order = [F.desc("confidence"), F.asc("value"), F.asc("snippet")]
    distinct = first_of(c.withColumn("_fold", fold(F.col("value"))), ["document_id", "key", "_fold"], order).drop("_fold")
    best = top(distinct, ["document_id", "key"], order, most)
    return best.groupBy("document_id", "key").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "value", "confidence", "snippet"))), lambda s: F.struct(s["value"].alias("value"), s["confidence"].alias("confidence"), s["snippet"].alias("snippet"))).alias("suggestions"))


def record(best: DataFrame) -> DataFrame:
    """One row per document with a column for each contract field; repeatable ones are arrays in rank order."""
    return fields_of(best.groupBy("document_id").agg(F.collect_list(F.struct("key", "rank", "value")).alias("held"))).drop("held")


def fields_of(docs: DataFrame) -> DataFrame:
    """Documents whose best candidates are an array held of (key, rank, value), with a column for each contract field."""
    own = lambda k: F.filter("held", lambda h: (h["key"] == k) & (h["rank"] == 1))
    every = lambda k: F.sort_array(F.transform(F.filter("held", lambda h: h["key"] == k), lambda h: F.struct(h["rank"].alias("rank"), h["value"].alias("value"))))
    field = lambda k, many: F.transform(every(k), lambda s: s["value"]) if many else F.array_max(F.transform(own(k), lambda h: h["value"]))
    return docs.select("*", *(field(k, many).alias(k) for k, _, _, many, _ in P.CONTRACT))
