"""The quality gate of extracted text: prerequisites, metrics, penalties and reasons. Characters and words are counted in one pass; all else are columns."""

from __future__ import annotations

import unicodedata
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StructField, StructType

from docloom.sources.scratch import spread

# fixed values: limits, penalties and reasons
PASS, LEAST_LENGTH, LEAST_WORDS = 0.60, 20, 3
PRINTABLE, LETTERS, STRANGE = 0.9, 0.35, 0.15
SUSPICIOUS = ("dratamiento", "draquea", "diene")
MARKS = frozenset(".,;:!?()[]{}'\"-_/\\%&+*#@")
VOWELS = frozenset("aeiouáéíóúüAEIOUÁÉÍÓÚÜ")
LONG_TOKEN, WORD = 12, 3

#: What is counted of each text, in this order; all but spaces, breaks and chars are of the text with its white space squeezed.
COUNTS = ("spaces", "breaks", "letters", "alnum", "capitals", "vowels", "hidden", "strange", "chars", "blank", "size", "words", "tokens", "long", "single")
#: What a character can be: the first eight of COUNTS, then a letter of words, then a character of tokens.
_TRAITS = 10
#: Characters of a text that are looked up at once.
SLICE = 1 << 20


@lru_cache(maxsize=1)
def classes() -> tuple[bytes, np.ndarray]:
    """(for each code point the number of its class, packed; for each class its traits as a row of zeros and ones), by Unicode's categories as Python has them."""

    def traits(c: str, kind: str) -> tuple[int, ...]:
        space = kind[0] == "Z" or c in "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85"
        alnum = kind[0] in "LN"
        return tuple(map(int, (space, c == "\n", kind[0] == "L", alnum, kind == "Lu", c in VOWELS, kind[0] == "C" and not space, not (space or alnum or c in MARKS), "A" <= c <= "Z" or "a" <= c <= "z" or "À" <= c <= "ÿ", alnum or c == "_")))

    numbers: dict[tuple[int, ...], int] = {}
    by_kind: dict[str, int] = {}
    table = bytearray(0x110000)
    for i in range(0x110000):
        kind = unicodedata.category(chr(i))
        if i >= 256 and kind in by_kind:  # beyond Latin-1 the category alone decides
            table[i] = by_kind[kind]
            continue
        table[i] = numbers.setdefault(traits(chr(i), kind), len(numbers))
        if i >= 256:
            by_kind[kind] = table[i]
    return zlib.compress(bytes(table)), np.array(list(numbers), np.int64)


def counted(docs: DataFrame, text: str) -> DataFrame:
    """docs with COUNTS and suspect in place of their text: each text is looked through once, in Arrow batches. Null texts are empty."""
    at = docs.columns.index(text)
    kept = [c for c in docs.columns if c != text]
    schema = StructType([*(docs.schema[c] for c in kept), *(StructField(c, LongType()) for c in COUNTS), StructField("suspect", BooleanType())])
    (packed, traits), n_traits, step = classes(), _TRAITS, SLICE
    names, suspicious, long_token, word = COUNTS, [w.encode() for w in SUSPICIOUS], LONG_TOKEN, WORD

    # what tasks need is held here by value, so that workers need not find this module
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.frombuffer(zlib.decompress(packed), np.uint8)
        is_space, is_letter, is_latin, is_token = (traits[:, i].astype(bool) for i in (0, 2, n_traits - 2, n_traits - 1))

        def runs(inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            edge = np.flatnonzero(np.diff(inside.view(np.int8), prepend=0, append=0))
            return edge[0::2], edge[1::2]

        def look(raw: bytes) -> list[int]:
            s = raw.decode("utf-8", "replace")
            if not s:
                return [0] * len(names)
            of = np.concatenate([table[np.frombuffer(s[i : i + step].encode("utf-32-le", "surrogatepass"), np.uint32)] for i in range(0, len(s), step)])
            n = np.bincount(of, minlength=len(traits)) @ traits[:, :8]
            space = is_space[of]
            first, _ = runs(space)
            blank = max(0, len(first) - int(space[0]) - int(space[-1]))  # those at the ends are cut off
            begin, end = runs(is_latin[of])
            words = int(np.count_nonzero(end - begin >= word))
            begin, end = runs(is_token[of])
            spelt = np.maximum.reduceat(is_letter[of].view(np.uint8), begin) > 0 if len(begin) else np.empty(0, bool)  # up to the next token there is no letter
            size = (end - begin)[spelt]
            return [*n.tolist(), len(s), blank, len(s) - int(n[0]) + blank, words, len(size), int(np.count_nonzero(size >= long_token)), int(np.count_nonzero(size == 1))]

        for batch in batches:
            rows, marked = [], []
            for v in batch.column(at).cast(pa.binary()):
                raw = v.as_py() or b""
                low = raw.lower()
                rows.append(look(raw))
                marked.append(any(w in low for w in suspicious))
            made = np.array(rows, np.int64).reshape(len(rows), len(names))
            yield pa.RecordBatch.from_arrays([*(c for i, c in enumerate(batch.columns) if i != at), *(pa.array(made[:, i]) for i in range(len(names))), pa.array(marked, pa.bool_())], [*(c for i, c in enumerate(batch.schema.names) if i != at), *names, "suspect"])

    return docs.mapInArrow(work, schema)


def assess(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Rows (id, *keep, score, quality_pass, reasons): reasons comma-joined in the order of the rules. Null texts are too short."""
    looked = counted(spread(docs.select(F.col(id_col), *keep, F.col(text_col).alias("_x"))), "_x")
    c = F.col
    early = (
        F.when(c("size") < LEAST_LENGTH, "TOO_SHORT")
        .when(((c("size") - c("hidden")) / c("size") < PRINTABLE) | (c("letters") == 0) | (c("letters") / c("size") < LETTERS) | (c("strange") / c("size") >= STRANGE), "NOT_HUMAN_READABLE")
        .when(c("words") < LEAST_WORDS, "TOO_FEW_WORDS")
    )
    ratio = lambda a, b: c(a) / F.greatest(F.lit(1), c(b))
    rules = [
        (ratio("vowels", "letters") < 0.30, 0.20, "LOW_VOWEL_RATIO"),
        ((c("size") - c("alnum") - c("blank")) / F.greatest(F.lit(1), c("size")) > 0.25, 0.25, "HIGH_PUNCTUATION_RATIO"),
        (c("spaces") / F.greatest(F.lit(1), c("chars")) < 0.10, 0.20, "LOW_WHITESPACE_STRUCTURE"),
        ((c("breaks") / F.greatest(F.lit(1), c("chars")) < 0.0005) & (c("size") > 800), 0.10, "LOW_LINEBREAK_STRUCTURE"),
        ((ratio("long", "tokens") > 0.20) & (c("tokens") >= 80), 0.35, "EXCESS_LONG_TOKENS"),
        ((ratio("single", "tokens") > 0.045) & (c("tokens") > 120), 0.35, "EXCESS_SINGLE_LETTER_TOKENS"),
        ((ratio("capitals", "letters") > 0.80) & (c("tokens") < 250), 0.20, "SUSPICIOUS_ALL_CAPS_DENSITY"),
        (c("suspect"), 0.40, "SUSPICIOUS_SUBSTITUTIONS"),
    ]
    score = F.lit(1.0)
    for when, penalty, _ in rules:
        score = score - F.when(when, F.lit(penalty)).otherwise(F.lit(0.0))
    reasons = F.concat_ws(",", *(F.when(when, reason) for when, _, reason in rules))
    out = looked.select(id_col, *keep, early.alias("early"), score.alias("score"), reasons.alias("reasons"), "suspect")
    return out.select(id_col, *keep, F.when(c("early").isNull(), c("score")).otherwise(F.lit(0.0)).alias("score"), (c("early").isNull() & (c("score") >= PASS) & ~c("suspect")).alias("quality_pass"), F.coalesce("early", "reasons").alias("reasons"))
