"""Extractors of persons and addresses: each rule one expression over a line and the lines around it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docloom.functions import patterns as P
from docloom.functions.scores import FALLBACK_CONFIDENCE, LABEL_CONFIDENCE
from docloom.functions.text import fold, holds, once, squeeze, strip
from docloom.operators.line_rows import entry, line_at, lines_at

_EDGE = " .,:;\t\r\n"
#: The keys that the rules here have values for.
KEYS = frozenset(("vet_name", "owner_name", "clinic_name", "clinic_address", "owner_address"))


def person(x: Column) -> Column:
    """A person's name of two to five words, most of them names; null for addresses, phones, mail and licences."""

    def named(x: Column) -> Column:
        words = F.split(x, " ")
        names = F.size(F.filter(words, lambda w: w.rlike(P.NAME_TOKEN)))
        bad = F.contains(x, F.lit("@")) | x.rlike(P.PHONE_LIKE) | x.rlike(P.LICENSE_ONLY) | x.rlike(P.ADDRESS_LIKE)
        return F.when((x != "") & F.size(words).between(2, 5) & ~bad & (names >= F.greatest(F.lit(2), F.floor(F.size(words) * 0.6))), x)

    return once(strip(squeeze(x), _EDGE), named)


def before_address(x: Column) -> Column:
    """A text up to the first word that begins an address."""
    return F.trim(F.regexp_replace(x, r"(?iu)(?:^|\s+)[(\[{]?(?:c/\S*|(?:" + "|".join(w.replace(" ", r"\s+") for w in P.ADDRESS_WORDS) + r")[.,:;)\]}]*(?=\s|$)).*$", ""))


def _parts(*parts: Column) -> Column:
    return F.array_join(F.filter(F.array(*parts), lambda x: x.isNotNull() & (x != "")), " ")


def entries() -> list[Column]:
    """Persons and places found at a line of `line_rows`, each one candidate or null. The rows also have the line as cue text and cut, its two parts at a colon or hyphen."""
    line, no, seen, cut = F.col("line"), F.col("line_no"), F.col("cue"), F.col("cut")
    near = {f"l{i}": line_at(i) for i in range(1, 5)} | {"p1": line_at(-1), "after8": lines_at(1, 8), "before8": lines_at(-8, -1)}
    near |= {name: F.array_join(lines_at(lo, hi), glue) for name, lo, hi, glue in (("within2", -2, 2, " "), ("past2", -2, -1, " "), ("past3", -3, 3, " "), ("past5", -5, -1, " "), ("next5", 1, 5, " "), ("next7", 1, 7, " "), ("block3", 0, 2, "\n"), ("block4", 0, 3, "\n"), ("around13", -1, 3, " "), ("around11", -1, 1, "\n"))}
    near["line"] = line
    clean = lambda c: strip(F.coalesce(near[c], F.lit("")), _EDGE)
    label = lambda c: F.coalesce(near[c].rlike(P.SIMPLE_LABEL), F.lit(False))
    out = []

    # persons: a label with the name on its line, or on the next line after a colon
    for key, pattern, guard, words in (("vet_name", P.VET_LABEL, P.ADDRESS_LIKE, ("vet", "dr", "doctor")), ("owner_name", P.OWNER_LABEL, P.VET_OR_CLINIC, ("propietari", "titular", "due", "owner"))):
        own = F.trim(F.regexp_extract("line", pattern, 1))
        source = F.when(own != "", own).when(F.contains("line", F.lit(":")), near["l1"])
        name = person(before_address(source) if key == "owner_name" else source)
        out.append(entry(key, 9 if key == "vet_name" else 10, no * 10, name, line, LABEL_CONFIDENCE, gate=holds(seen, *words) & line.rlike(pattern) & ~fold(line).rlike(guard)))
    owner_near, header_before = near["within2"].rlike(P.OWNER_CONTEXT), F.exists(near["before8"], lambda x: x.rlike(P.CLIENT_HEADER))
    allowed = (owner_near | header_before) & ~near["within2"].rlike(P.VET_OR_CLINIC) & (owner_near | ~near["past2"].rlike(P.PATIENT_LABEL))
    own = F.trim(F.regexp_extract("line", P.OWNER_NAME_LABEL, 1))
    names = F.transform(F.filter(near["after8"], lambda x: ~x.rlike(P.CLIENT_TABLE_LABEL)), lambda x: person(before_address(x)))
    below = F.try_element_at(F.filter(names, lambda x: x.isNotNull()), F.lit(1))
    out.append(entry("owner_name", 11, no * 10, F.when(allowed, F.when(own != "", person(before_address(own))).otherwise(below)), line, LABEL_CONFIDENCE, gate=F.contains(seen, F.lit("nombre")) & line.rlike(P.OWNER_NAME_LABEL)))

    # the clinic's name as a heading in capitals above an address and a section
    heading = (no == 1) & (line == F.upper("line")) & line.rlike(r"\p{Lu}") & F.length("line").between(3, 60) & ~line.rlike(r"[:\-\d]") & ~line.isin(*P.HEADER_WORDS)
    out.append(entry("clinic_name", 12, no * 10, F.when(near["next7"].rlike(P.HEADER_ADDRESS) & near["next7"].rlike(P.HEADER_SECTION), line), near["block4"], FALLBACK_CONFIDENCE, gate=heading))
    # an address over three lines near the top
    third = F.coalesce(near["l2"].rlike(P.POSTAL_HINT), F.lit(False)) & ~near["l2"].rlike(P.HEADER_SECTION) & ~near["l1"].rlike(P.HEADER_SECTION)
    street = holds(seen, "c/", "calle", "av", "plaza", "pza", "paseo", "camino", "carretera", "ctra")
    three = ~label("line") & ~label("l1") & third & (line.rlike(r"\d") | near["l1"].rlike(r"\d")) & ~near["around13"].rlike(P.OWNER_CONTEXT)
    out.append(entry("clinic_address", 13, no * 10, F.when(three, _parts(clean("line"), clean("l1"), clean("l2"))), near["block4"], FALLBACK_CONFIDENCE, gate=(no <= 8) & street & line.rlike(P.STREET_START)))
    # a name above an address, with what belongs to the address below it
    known = near["past3"].rlike(P.OWNER_ADDRESS_CONTEXT)
    below_name = line.rlike(P.NAME_LINE) & near["l1"].rlike(r"\d")
    block = ~label("line") & ~label("l1") & near["l1"].rlike(P.ADDRESS_LIKE) & (known | (near["past3"].rlike(P.IDENTIFICATION) & ~near["past3"].rlike(P.CLINIC_ADDRESS_CONTEXT)))
    belongs = lambda c: F.coalesce(~label(c) & ~clean(c).rlike(P.NAME_LINE) & ~F.lower(clean(c)).isin(*P.LOCALITY_NOT) & ~near[c].rlike(r"^\s*-\s*\d{1,2}[/\-.]") & (clean(c).rlike(P.POSTAL_HINT) | clean(c).rlike(P.LOCALITY_LINE)), F.lit(False))
    tail = [F.when(belongs("l2"), clean("l2")), F.when(belongs("l2") & belongs("l3"), clean("l3")), F.when(belongs("l2") & belongs("l3") & belongs("l4"), clean("l4"))]
    out.append(entry("owner_address", 14, no * 10, F.when(block, _parts(clean("l1"), *tail)), near["block3"], FALLBACK_CONFIDENCE, gate=below_name))
    # an address inside the value of an owner's label
    inner = F.regexp_extract(strip(F.coalesce(cut[1], F.lit("")), _EDGE), rf"({P.STREET_START.replace('(?iu)', '(?iu:', 1)}).*$)", 1)
    out.append(entry("owner_address", 15, no * 10, strip(inner, _EDGE), line, LABEL_CONFIDENCE, gate=holds(seen, "propietari", "titular", "due", "owner", "cliente", "tutor") & cut[0].rlike(P.OWNER_HEADER)))
    # labelled addresses, on their line or the next, with a postal line after

    def labelled(pattern: str, group: int) -> Column:
        given = strip(F.regexp_extract("line", pattern, group), _EDGE)
        first = F.when(given != "", given).when(~label("l1"), clean("l1"))
        return F.when(first.isNotNull(), _parts(first, F.when(~label("l2") & F.coalesce(near["l2"].rlike(P.POSTAL_HINT), F.lit(False)), clean("l2"))))

    out.append(entry("owner_address", 16, no * 10, labelled(P.OWNER_ADDRESS_LINE, 1), near["block3"], LABEL_CONFIDENCE, gate=holds(seen, "dir", "domicilio") & line.rlike(P.OWNER_ADDRESS_LINE)))
    placed = holds(seen, "dir", "domicilio") & line.rlike(P.CLINIC_ADDRESS_LINE)  # looked at first: few lines are, and the contexts are long
    said = fold(F.regexp_extract("line", P.CLINIC_ADDRESS_LINE, 1))
    explicit = said.rlike("cl[ií]nica")
    context = F.concat_ws(" ", near["past5"], near["next5"])
    owners, clinics = context.rlike(P.OWNER_ADDRESS_CONTEXT), context.rlike(P.CLINIC_ADDRESS_CONTEXT)
    generic = line.rlike(P.GENERIC_ADDRESS_LINE) & ~explicit
    address = labelled(P.CLINIC_ADDRESS_LINE, 2)
    owned = F.coalesce(near["past2"], F.lit("")).rlike(P.OWNER_CONTEXT)  # two lines above a general label
    out.append(entry("clinic_address", 16, no * 10 + 1, F.when(explicit, address), near["block3"], LABEL_CONFIDENCE, gate=placed))
    out.append(entry("owner_address", 16, no * 10 + 1, F.when(~explicit & owners & ~clinics & generic, address), near["block3"], LABEL_CONFIDENCE, gate=placed))
    out.append(entry("clinic_address", 16, no * 10 + 2, F.when(~explicit & ~owned & clinics & ~owners & generic, address), near["block3"], LABEL_CONFIDENCE, gate=placed))
    out.append(entry("clinic_address", 16, no * 10 + 3, F.when(~explicit & ~owned & ~(generic & (owners != clinics)), address), near["block3"], FALLBACK_CONFIDENCE, gate=placed))
    # an address right below a clinic's line
    above = F.coalesce(near["p1"], F.lit(""))
    out.append(entry("clinic_address", 17, no * 10, F.when(above.rlike(P.CLINIC_CONTEXT) & ~above.rlike(P.OWNER_CONTEXT), clean("line")), near["around11"], FALLBACK_CONFIDENCE, gate=street & ~F.contains("line", F.lit(":")) & line.rlike(P.STREET_START) & line.rlike(r"\d")))
    return out
