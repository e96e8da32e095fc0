"""Segments of visits split into clauses, each an observation or an action.

Whether some clauses are actions depends on whether an action came before, so the clauses of a segment are folded in order; all else is expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions.text import all_lines, blank_to_null, cue, fold, holds, once, squeeze

# fixed values: the words that tell observations from actions
SUMMARY_PREFIX = r"(?iu)^(?:visita|consulta|control|revisi[oó]n|seguimiento|ingreso)\b"
LEADING_DATES = r"^(?:[ :,\-\t]*(?:\d{4}[-/.]\d{1,2}[-/.]\d{1,2}|\d{1,2}[-/.]\d{1,2}[-/.]\d{2,4})\b)*[ :,\-\t]*"
LEADING_DAY = r"(?iu)^d[ií]a\s+\d{1,2}[-/.]\d{1,2}[-/.]\d{2,4}\s+\d{1,2}:\d{2}(?::\d{2})?\s*"
REASON_PREFIX = r"(?iu)^(?:motivo(?:\s+de\s+(?:la\s+)?(?:consulta|visita))?|visita|consulta|control|revisi[oó]n|seguimiento|ingreso|alta)\b\s*[:\-]?\s*"
TRAILING_STUB = r"(?iu)\b(?:les|le|se)\s*$"
INLINE_ACTION = (
    r"pongo\s+vacuna|ponemos\s+vacuna|se\s+recomienda|se\s+prescribe|se\s+administra|se\s+aplica|se\s+indica|se\s+pauta|damos|tratamie?nto\s*:|tto\s*:|"
    r"vamos\s+a\s+(?:hacer|pasar|repetir|valorar|tratar|controlar|cambiar)|cogemos\s+cita|poner\s+cita|seguimiento|recomiendo|recomendamos|mezcla\s+progresiva|observar|curas?\s+con|por\s+lo\s+que\s+(?:mando|mandamos)"
)
ACTION_VERB = (
    r"(?iu)\b(?:se\s+recomienda|se\s+prescribe|se\s+administra|se\s+aplica|se\s+indica|se\s+pauta|se\s+realiza|recomendar|recomiendo|recomendamos|prescribir|administrar|aplicar|iniciar|continuar|mantener|mezclar|cambiar|esterilizar|castrar|lavados?|"
    r"damos|pongo|ponemos|vacunar|vacunamos|se\s+vacuna|vacunaci[oó]n|vamos\s+a\s+(?:hacer|pasar|repetir|valorar|tratar|controlar|cambiar)|cogemos\s+cita|poner\s+cita|repetiremos|volveremos\s+a\s+tratar|controlamos|podemos\s+esterilizar|le\s+comentamos|"
    r"curas?\b|observar|acudir\s+de\s+urgencias|contactamos|llamo|recalcamos|preguntar|preguntamos|desparasitar|heptavalente|novibac|hospitalizad[oa]|hospitalizar|dieta\b|coger\s+muestra|conservar\s+en\s+fr[ií]o|plan\s+cachorro|"
    r"mando|mandamos|enviar\s+por\s+mail|mandar\s+por\s+mail|por\s+mail|volvemos\s+a\s+revisar|traer\s+fotos|castraremos|repetir\s+test)\b"
)
THERAPEUTIC = (
    r"(?iu)\b(?:pongo\s+vacuna|ponemos\s+vacuna|se\s+vacuna|vacunamos|vacunaci[oó]n|damos|administrar|administra(?:mos)?|aplicar|aplica(?:mos)?|comprimid[oa]s?|c[aá]psul[ae]s?|gotas?|sobre(?:s)?|ml|mg|cada\s+\d+\s*(?:h|horas?|d[ií]as?)|"
    r"durante\s+\d+\s*(?:d[ií]as?|semanas?|meses?)|revisi[oó]n|seguimiento|control|lata\s+i/d|mantener|mezclar|insistir|cambiar|esterilizar|castrar)\b"
)
DIAGNOSTIC = (
    r"(?iu)\b(?:test|anal[ií]tica|coprol[oó]gic[oa]|perfil\s+heces|ecograf[ií]a|radiograf[ií]a|rx|biopsia|colonoscopia|saco\s+sangre|extra(?:er|emos?)\s+sangre|muestra(?:s)?\s+de\s+heces|resultado(?:s)?|negativ[oa]s?|positiv[oa]s?|descarta(?:mos|r)?)\b"
)
TREATMENT = r"(?iu)^\s*(?:tratamie?nto|tto)\b(?:\s*[:\-])?"
GIVE, GO_ON = r"(?i)^\s*dar\s+\d", r"(?i)^\s*[-*•]?\s*seguir\s+con\b"
ANAMNESIS = r"(?iu)\b(?:anamnesis|acude\s+para)\b"
PERFORMED = r"(?iu)\b(?:pongo|ponemos|damos|se\s+administra|se\s+aplica|se\s+pauta|se\s+prescribe)\b"
DOSAGE = r"(?iu)\b(?:\d+(?:[.,]\d+)?\s*(?:ml|mg)|\d+\s*(?:/\s*\d+)?\s*comprimid[oa]s?|(?:comprimid[oa]s?|c[aá]psul[ae]s?|gotas?|sobres?)\b).{0,40}\b(?:cada|durante)\b"
PLAN = (
    r"(?iu)^(?:importante\s+ofrecer|es\s+importante\s+que|en\s+\d+\s*(?:d[ií]as?|semanas?|mes(?:es)?)\s+deber[ií]a|si\s+se\s+mantiene|si\s+evoluciona|si\s+no\s+hay\s+mejor[ií]a|introduciremos|revisaremos|ser[aá]\s+necesario\s+realizar|"
    r"(?:y\s+)?si\s+no\s+haremos|tenemos\s+que\s+descartar|si\s+empeora)\b"
)
HEADER = r"(?iu)^(?:exploraci[oó]n|exploracion|anamnesis)\b"
MORE_ACTION = r"(?iu)^(?:el\s+test\s+de|la\s+anal[ií]tica|el\s+coprol[oó]gico|mezclado\s+con|pienso\s+digestivo|limpiezas?|lata\s+i/d)\b|^en\s+casa$"
MORE_ADMIN = r"(?iu)^(?:recordatorios?|vacuna|f|pr[oó]xima|f\.?\s*pr[oó]xima|aplicada|s[ií])$"
FINDING = r"(?iu)\b(?:no\s+parecen?\s+hongos|inflamaci[oó]n|alopecia|mordisco)\b"
HOME = r"(?iu)^(?:en\s+casa\s+comentan|en\s+casa\b.*\best[aá]\s+bien\b)"
ADMIN = r"(?iu)\b(?:recordatorios?\s+vacunaciones|vacunaci[oó]n\s+\w+)\b"

#: Words of which one is in whatever a pattern above matches, as `cue` folds them. A pattern is asked only behind them.
WORDS = {
    INLINE_ACTION: ("vacuna", "recom", "prescribe", "administra", "aplica", "indica", "pauta", "damos", "tratami", "tto", "vamos", "cita", "seguimiento", "mezcla", "observar", "cura", "mand"),
    ACTION_VERB: (
        "recom", "prescrib", "administra", "aplica", "indica", "pauta", "realiza", "iniciar", "continuar", "mantener", "mezclar", "cambiar", "esterilizar", "castra", "lavado", "damos", "pongo", "ponemos", "vacun", "vamos", "cita", "repeti", "tratar",
        "controlamos", "comentamos", "cura", "observar", "urgencias", "contactamos", "llamo", "recalcamos", "pregunta", "desparasitar", "heptavalente", "novibac", "hospitaliz", "dieta", "coger", "conservar", "plan", "mand", "mail", "volvemos", "traer",
    ),
    THERAPEUTIC: ("vacun", "damos", "administra", "aplica", "comprimid", "psul", "gota", "sobre", "ml", "mg", "cada", "durante", "revisi", "seguimiento", "control", "lata", "mantener", "mezclar", "insistir", "cambiar", "esterilizar", "castrar"),
    DIAGNOSTIC: ("test", "anal", "coprol", "perfil", "ecograf", "radiograf", "rx", "biopsia", "colonoscopia", "sangre", "muestra", "resultado", "negativ", "positiv", "descarta"),
    TREATMENT: ("tratami", "tto"), GIVE: ("dar",), GO_ON: ("seguir",), ANAMNESIS: ("anamnesis", "acude"), DOSAGE: ("cada", "durante"),
    PLAN: ("importante", "deber", "mantiene", "evoluciona", "mejor", "introduciremos", "revisaremos", "necesario", "haremos", "descartar", "empeora"),
    HEADER: ("explorac", "anamnesis"), MORE_ACTION: ("test", "anal", "coprol", "mezclado", "pienso", "limpieza", "lata", "casa"), FINDING: ("hongos", "inflamaci", "alopecia", "mordisco"), HOME: ("casa",), ADMIN: ("vacunaci",),
}


def _says(x: Column, low: Column, pattern: str) -> Column:
    """Whether a text (low: folded) matches a pattern: its words are looked for first."""
    return holds(low, *WORDS[pattern]) & x.rlike(pattern)


def clean(clause: Column) -> Column:
    """A clause without bullets, leading dates and the visit's heading."""
    x = F.regexp_replace(F.regexp_replace(F.trim(clause), r"^[-*•\s]+", ""), r"(?U)^[^\w]+", "")
    x = F.trim(F.regexp_replace(x, LEADING_DAY, ""))
    x = F.trim(F.regexp_replace(x, SUMMARY_PREFIX, ""))
    x = once(x, lambda x: F.when(x.rlike(r"^[ :,\-\t\d]"), F.regexp_replace(x, LEADING_DATES, "")).otherwise(x))  # nothing else is such a beginning
    x = squeeze(F.regexp_replace(x, r"[ :,\-\t]+$", ""))
    return F.trim(F.regexp_replace(x, TRAILING_STUB, ""))


def _kind(clause: Column, raw: Column) -> Column:
    """observation, action, or action_after (an action only if one came before)."""

    def kind(low: Column, low_raw: Column) -> Column:
        says = lambda pattern: _says(clause, low, pattern)
        treatment, dosage = _says(raw, low_raw, TREATMENT), says(DOSAGE)
        acts = treatment | _says(raw, low_raw, GIVE) | _says(raw, low_raw, GO_ON) | dosage | says(PLAN) | says(THERAPEUTIC)
        # what acts is told before, so a finding of a test is one unless it has a verb of actions, and so is all else
        later = F.when(acts, "action").when(says(ACTION_VERB), "action").otherwise("observation")
        watched = (says(ANAMNESIS) & ~clause.rlike(PERFORMED)) | (says(HEADER) & ~treatment) | (says(FINDING) & ~treatment & ~dosage) | says(HOME)
        follows = ((F.length(clause) <= 16) & clause.rlike(MORE_ADMIN)) | says(MORE_ACTION)
        rest = once(later, lambda x: F.when((x == "observation") & follows, "action_after").otherwise(x))
        return F.when(watched, "observation").when(says(ADMIN), "action").otherwise(rest)

    return once(F.struct(cue(clause).alias("low"), cue(raw).alias("raw")), lambda c: kind(c["low"], c["raw"]))


def split_clauses(text: Column) -> Column:
    """The raw clauses of a segment: lines, cut at stops and semicolons and before words that begin an action."""
    rows = all_lines(F.coalesce(text, F.lit("")))
    # a split compiles its pattern anew for each text, so only texts are split that hold what they are split at
    before_action = rf"(?iu)\s+(?=(?:{INLINE_ACTION})\b)"
    stops = lambda x: F.when(F.contains(x, F.lit(";")) | F.contains(x, F.lit(".")), F.split(x, r";|\.(?=\s|$)")).otherwise(F.array(x))
    actions = lambda x: F.when(once(cue(x), lambda low: holds(low, *WORDS[INLINE_ACTION])) & x.rlike(before_action), F.split(x, before_action)).otherwise(F.array(x))
    cut = F.flatten(F.transform(rows, lambda x: once(F.trim(x), stops)))
    return F.filter(F.flatten(F.transform(cut, actions)), lambda x: F.trim(x) != "")


def observations_actions(segments: DataFrame, text: str = "segment") -> DataFrame:
    """segments with observations and actions: the clauses of each kind, each once, joined by a blank; null where there are none."""
    judged = F.transform(split_clauses(F.col(text)), lambda raw: once(clean(raw), lambda c: F.struct(c.alias("clause"), F.when(c != "", _kind(c, raw)).alias("kind"))))
    empty = F.struct(F.array().cast("array<string>").alias("o"), F.array().cast("array<string>").alias("a"))

    def step(s: Column, x: Column) -> Column:
        act = (x["kind"] == "action") | ((x["kind"] == "action_after") & (F.size(s["a"]) > 0))
        add = lambda have: F.when(F.exists(have, lambda y: fold(y) == fold(x["clause"])), have).otherwise(F.concat(have, F.array(x["clause"])))
        return F.struct(F.when(act, s["o"]).otherwise(add(s["o"])).alias("o"), F.when(act, add(s["a"])).otherwise(s["a"]).alias("a"))

    folded = segments.withColumn("_c", F.filter(judged, lambda x: x["clause"] != "")).withColumn("_f", F.aggregate("_c", empty, step))
    return folded.withColumn("observations", blank_to_null(F.array_join("_f.o", " "))).withColumn("actions", blank_to_null(F.array_join("_f.a", " "))).drop("_c", "_f")


def reason_for_visit(text: Column) -> Column:
    """The first clause of a segment that says something once headings and dates are gone."""
    rows = all_lines(F.coalesce(text, F.lit("")))
    said = F.transform(rows, lambda x: squeeze(F.regexp_extract(F.regexp_replace(F.regexp_replace(F.regexp_replace(F.trim(x), r"^[-*•\s]+", ""), REASON_PREFIX, ""), LEADING_DATES, ""), r"^([^.;]*)", 1)))
    return F.try_element_at(F.filter(said, lambda x: x != ""), F.lit(1))
