"""Cue words of texts: one automaton over all words, which goes through each text once and says which rules can find something in it."""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StructField, StructType

from docloom.functions import patterns as P

#: Bits of a text's cues beyond those of the label table: words that count alone, words that count beside a colon or a hyphen.
HINT, HINT_LABEL = 1 << 61, 1 << 60
#: What ends a line, and the indent of one, for Python's regular expressions: as docloom.functions.text has them.
BREAK, INDENT = r"[\n\x0b\x0c\r\x1c-\x1e\x85\u2028\u2029]", r"[\t\x1f \xa0\u1680\u2000-\u200a\u202f\u205f\u3000]*"


def label_words() -> list[tuple[str, int]]:
    """All cue words with their bits: bit i for pattern i of the label table, and those of the hints."""
    own = [(w, 1 << i) for i, words in enumerate(P.LABEL_CUES) for w in words]
    return own + [(w, HINT) for w in P.HINT_WORDS] + [(w, HINT_LABEL) for w in P.HINT_LABELS]


def cued(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with the columns cues (a long: bit i if a word of rule i occurs in the text) and hint (whether any rule can find something).

    Each text goes through the automaton once, in Arrow batches; texts that hold no word are looked through for the shapes of dates, weights and short
    labels. What matches a rule always has its bit; a bit alone says nothing. Null and empty texts have no cues. The automaton is of fixed size and made
    once a task. docs must not have columns of these two names yet.
    """
    at = docs.columns.index(text)
    schema = StructType([*docs.schema.fields, StructField("cues", LongType()), StructField("hint", BooleanType())])

    words, start, shapes = label_words(), f"{INDENT}{P.HINT_LINE_STARTS}", (*P.HINT_SHAPES, f"{BREAK}{INDENT}{P.HINT_LINE_STARTS}")
    counts, beside = HINT, HINT_LABEL

    # what tasks need is held here by value, so that workers need not find this module
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, bits = ahocorasick.Automaton(), {}
        begins, shaped = re.compile(start, re.ASCII).match, [re.compile(x, re.ASCII).search for x in shapes]  # one after another: together they would be tried at every character
        for word, own in words:
            bits[word] = bits.get(word, 0) | own
        for word, own in bits.items():
            found.add_word(word, own)
        found.make_automaton()
        for batch in batches:
            cues, hints = [], []
            for t in batch.column(at).to_pylist():
                # folded so that each letter that matches a plain one without regard to case becomes that letter: long s, dotless and dotted i among them
                t = t or ""
                low, mask = t.lower() if t.isascii() else t.upper().lower().replace("\u0307", ""), 0
                for _, own in found.iter(low):
                    mask |= own
                cues.append(mask)
                hints.append(bool(mask & counts or mask & beside and (":" in low or "-" in low) or begins(low) or any(f(low) for f in shaped)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cues, pa.int64()), pa.array(hints, pa.bool_())], [*batch.schema.names, "cues", "hint"])

    return docs.mapInArrow(work, schema)


def may_hold(docs: DataFrame, rule: int) -> Column:
    """Whether a text can hold what rule `rule` of the label table looks for; always, where docs carries no cues."""
    return F.getbit("cues", F.lit(rule)) == 1 if "cues" in docs.columns else F.lit(True)
