"""The automaton of cue words against plain looks at each text, and the label table with it against the label table without."""

import random

from docloom.functions import patterns as P
from docloom.operators import mining
from docloom.operators.cues import HINT, HINT_LABEL, cued, label_words

LABELS = [
    "Paciente", "NOMBRE DEL ANIMAL", "patient", "Especie / Raza", "raza", "BREED", "Sexo", "SEX", "Edad", "age", "F. Nac.", "fcha nacimiento", "F/Nto", "dob", "Birth date", "Fecha Nac", "Peso corporal", "P.", "Signos vitales", "Datos de la mascota",
    "nº chip", "MICR0CHIP", "IdentificaciÓn electrónica", "NHC", "Nº Historia ClÍnica", "número de historial", "Historial clínico", "Fecha de visita", "CONSULTA", "Visit date", "fecha documento", "DATE", "ClÍnica", "centr0 veterinari0",
    "Dirección", "DOMICILIO DE LA CLÍNICA", "Veterinaria", "Dra.", "DR", "Propietario", "tutor", "Dir. titular", "Domicilio del titular", "Capa", "Color del pelaje", "longitud del pelo", "Esterilizada", "FÉRTIL", "Repro", "Motivo de consulta", "Reason for visit",
    "Seİo", "ſexo", "Eſpecie", "Chİp", "chıp", "Mascota", "nada", "The council",
]
VALUES = ["Luna", "Canina", "M", "7 kg", "7,5kg", "12/03/2020", "2020-03-12", "941000024967769", "C/ Mayor 3, 28001 Madrid", "", "x;y", "\nLuna"]


def fuzzed(n: int) -> list[str]:
    rng = random.Random(31)
    line = lambda: rng.choice(LABELS) + rng.choice([": ", " - ", ":", " ", " | ", "\n"]) + rng.choice(VALUES)
    texts = ["\n".join(line() for _ in range(rng.randrange(1, 4))) for _ in range(n)]
    return texts + [rng.choice((t.upper(), t.lower(), t.title())) for t in texts[: n // 2]] + LABELS


def test_bits_are_the_words_of_each_text(spark):
    texts = fuzzed(200) + ["", None, "a-lab", "a lab", "5/3", "kg", "  vet", "x vet"]
    got = {r.document_id: r for r in cued(spark.createDataFrame(list(enumerate(texts)), "document_id int, text string")).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        low = (t or "").upper().lower().replace(chr(0x307), "")
        want = 0
        for word, bits in label_words():
            want |= bits if word in low else 0
        assert got[i].cues == want and got[i].text == t
        assert got[i].hint or not want & HINT
    hints = [got[len(texts) - 8 + k].hint for k in range(8)]
    assert hints == [False, False, True, False, True, False, True, False]
    assert HINT_LABEL.bit_count() == 1 and len(P.LABEL_CUES) == len(P.LABELLED) < 60


def test_label_table_with_cues_equals_the_table_without(spark):
    docs = spark.createDataFrame([(str(i), t) for i, t in enumerate(fuzzed(600))], "document_id string, text string")
    cols = ("document_id", "key", "seq", "value", "snippet")
    want = sorted(map(repr, mining.labelled(docs).select(*cols).collect()))
    assert sorted(map(repr, mining.labelled(cued(docs)).select(*cols).collect())) == want and len(want) > 400
    assert {int(r.split("seq=")[1].split(",")[0]) // 10**6 for r in want} == set(range(len(P.LABELLED)))  # every pattern finds something


def test_runs_of_blanks_and_digits_take_linear_time(spark):
    n = 1_000_000
    docs = spark.createDataFrame([("a", "\n" * n), ("b", "p." + " " * n), ("c", " " * n), ("d", "5" + "\t" * n)], "document_id string, text string")
    assert cued(docs).filter("hint").count() == 0


def test_an_empty_table_and_further_columns(spark):
    docs = spark.createDataFrame([], "document_id string, text string, own int")
    assert cued(docs).columns == ["document_id", "text", "own", "cues", "hint"] and cued(docs).count() == 0
