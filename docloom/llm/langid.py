"""Language identification by prediction by partial matching: byte context trees with escape probabilities and frozen counts."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bound_batches

#: Symbols are bytes reduced to 6 bits: 0 stands for all that isn't a letter (runs count once), 1-26 for a-z, the rest for the commonest other bytes.
BITS, SYMBOLS = 6, 64
#: Code lengths (of 4 bytes) that a model holds at most over all languages: with very many languages it keeps fewer contexts, so that its broadcast is bounded.
MOST_BITS = 64_000_000
#: Characters of the pieces that the fit draws from a language with more text than it counts.
PIECE = 4096
_LETTER = re.compile(r"[^\W\d_]")


def has_letter(text: str | None) -> bool:
    """Whether a text has a letter of any script; numerals that aren't digits are none."""
    m = _LETTER.search(text or "")
    return bool(m) and (m[0].isalpha() or any(c.isalpha() for c in text))


@dataclass
class Ppm:
    """Frozen trees of all languages as one automaton.

    child[node, symbol] is the node one symbol further back, or -1; bits[node, symbol, language] the exact code length of a symbol after the
    context that the node stands for (float32). Node 0 is the empty context.
    """

    languages: list[str]
    order: int
    table: bytes
    child: np.ndarray
    bits: np.ndarray

    def code_lengths(self, texts: list[str | None], span: int = 1 << 18) -> np.ndarray:
        """Bits that each language's tree needs for each whole text (texts x languages). Long texts are coded in spans that overlap by the order."""
        out = np.zeros((len(texts), len(self.languages)))
        coded = [symbols(t, self.table) for t in texts]
        lengths = np.array([len(c) for c in coded])
        at = 0
        while at < len(texts):
            stop, total = at + 1, lengths[at]
            while stop < len(texts) and total + lengths[stop] <= span:
                total += lengths[stop]
                stop += 1
            pad = np.zeros(self.order, np.uint8)
            for first in range(0, max(1, int(lengths[at])), span) if stop == at + 1 else (0,):
                if stop == at + 1:
                    left = coded[at][max(0, first - self.order) : first]
                    parts = [np.concatenate((pad[len(left) :], left, coded[at][first : first + span]))]
                else:
                    parts = [np.concatenate((pad, c)) for c in coded[at:stop]]
                sizes = np.array([len(p) for p in parts])
                ends = np.cumsum(sizes)
                all_bits = np.concatenate((np.zeros((1, len(self.languages))), np.cumsum(self._bits(np.concatenate(parts)), axis=0, dtype=np.float64)))
                out[at:stop] += all_bits[ends] - all_bits[ends - sizes + self.order]
            at = stop
        return out

    def _bits(self, x: np.ndarray) -> np.ndarray:
        """Code length of every symbol of x given the symbols before it; the first `order` rows don't count."""
        x = x.astype(np.int64)
        n = len(x)
        node, live = np.zeros(n, np.int64), np.ones(n, bool)
        for back in range(1, self.order + 1):
            prior = np.concatenate((np.zeros(back, np.int64), x[:-back]))[:n]
            deeper = self.child[node, prior]
            live &= deeper >= 0
            node = np.where(live, deeper, node)
        return self.bits[node, x]


def symbols(text: str | None, table: bytes) -> np.ndarray:
    """The symbols of a text: lower-cased UTF-8 bytes through the table, runs of symbol 0 as one."""
    s = np.frombuffer((text or "").lower().encode("utf-8", "surrogatepass").translate(table), np.uint8)
    if len(s) < 2:
        return s
    keep = np.empty(len(s), bool)
    keep[0] = True
    np.logical_or(s[1:] != 0, s[:-1] != 0, out=keep[1:])
    return s[keep]


def byte_table(counts: dict[int, int]) -> bytes:
    """Bytes to symbols: a-z, then the commonest bytes above ASCII, the rest of those together as the last symbol."""
    table = bytearray(256)
    for i in range(26):
        table[97 + i] = table[65 + i] = 1 + i
    high = sorted((b for b in counts if b >= 128), key=lambda b: (-counts[b], b))
    for b in range(128, 256):
        table[b] = SYMBOLS - 1
    for i, b in enumerate(high[: SYMBOLS - 28]):
        table[b] = 27 + i
    return bytes(table)


def build(counts: pd.DataFrame, table: bytes, order: int, max_nodes: int) -> Ppm:
    """The automaton for rows (lang, depth, context, symbol, n).

    context packs the symbols before, the nearest in the lowest bits. Escapes follow method C: a context of n symbols, d of them distinct, gives d / (n + d)
    to the escape; in the shorter context the symbols of the longer one are excluded. Contexts are kept by count, max_nodes in all.
    """
    languages = sorted(counts["lang"].unique())
    seen = counts.groupby(["depth", "context"], as_index=False)["n"].sum()
    seen = seen[seen["depth"] > 0].sort_values(["n", "depth", "context"], ascending=[False, True, True]).head(max_nodes - 1)
    index: dict[tuple[int, int], int] = {(0, 0): 0}
    for depth, context in sorted(zip(seen["depth"], seen["context"], strict=True)):
        if (depth - 1, context & ((1 << BITS * (depth - 1)) - 1)) in index:
            index[int(depth), int(context)] = len(index)
    size = len(index)
    child, parent = np.full((size, SYMBOLS), -1, np.int32), np.zeros(size, np.int64)
    for (depth, context), i in index.items():
        if depth:
            parent[i] = index[depth - 1, context & ((1 << BITS * (depth - 1)) - 1)]
            child[parent[i], context >> BITS * (depth - 1)] = i
    bits = np.empty((size, SYMBOLS, len(languages)), np.float32)
    for k, lang in enumerate(languages):
        own = counts[counts["lang"] == lang]
        c = np.zeros((size, SYMBOLS))
        where = [index.get(x, -1) for x in zip(own["depth"], own["context"], strict=True)]
        ok = np.array(where) >= 0
        np.add.at(c, (np.array(where)[ok], own["symbol"].to_numpy()[ok]), own["n"].to_numpy()[ok])
        n, d = c.sum(1), (c > 0).sum(1)
        own_bits = np.empty((size, SYMBOLS))
        for i in range(size):  # parents come before their children
            if i == 0:
                own_bits[0] = -np.log2((c[0] + 0.5) / (n[0] + 0.5 * SYMBOLS))  # the last resort: all symbols, half a count each
                continue
            if n[i] == 0:
                own_bits[i] = own_bits[parent[i]]
                continue
            there = c[i] > 0
            rest = own_bits[parent[i]]
            # exclusion: what the parent gives to symbols seen here goes to the others in proportion
            left = 1.0 - np.exp2(-rest[there]).sum()
            own_bits[i, there] = -np.log2(c[i, there] / (n[i] + d[i]))
            if there.all():
                own_bits[i] = -np.log2(c[i] / n[i])
            else:
                own_bits[i, ~there] = -np.log2(d[i] / (n[i] + d[i])) + rest[~there] + np.log2(max(left, 1e-12))
        bits[:, :, k] = own_bits
    return Ppm(languages, order, table, child, bits)


def train(docs: DataFrame, learn: Column, order: int = 4, sample_bytes: int = 1_500_000, max_nodes: int = 40_000, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Ppm | None:
    """Fit the trees on rows where `learn` holds and neither text nor language is null; None if there are none.

    At most about sample_bytes of UTF-8 text per language are counted (a documented bound of the fit, nothing else): of a language with more, the pieces
    of PIECE characters whose hash lies below the share that fits, and at least the piece with the least hash, so that no language is missed and a long
    text is neither taken nor left as a whole. Contexts are counted on the executors; their sums, bounded by the sample, reach the driver; symbols seen once
    after a context of three or more are left out. Code lengths are exact for the reduced symbols; what a symbol stands for (which mark, which rare byte) would
    cost every language the same and is left out of all.
    """
    bound_batches(docs.sparkSession)
    rows = docs.filter(learn & F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.xxhash64(F.col(id_col).cast("string"), F.col(text_col), F.lit("fit")).alias("h"))
    pieces = F.sequence(F.lit(0), F.floor((F.greatest(F.length("text"), F.lit(1)) - 1) / PIECE).cast("int"))
    draw = lambda k: F.pmod(F.xxhash64("h", k), F.lit(1 << 30)) / float(1 << 30)
    sizes = {r["lang"]: (r["b"], r["u"]) for r in rows.groupBy("lang").agg(F.sum(F.octet_length("text")).alias("b"), F.min(F.array_min(F.transform(pieces, draw))).alias("u")).collect()}
    if not sizes:
        return None
    line = F.create_map(*(F.lit(x) for lang, (b, u) in sizes.items() for x in (lang, 1.0 if b <= sample_bytes else max(u, sample_bytes / b))))[F.col("lang")]
    drawn = F.transform(F.filter(pieces, lambda k: draw(k) <= line), lambda k: F.substring("text", k * PIECE + 1, F.lit(PIECE)))
    sample = rows.select("lang", F.explode(F.when(line == 1.0, F.array("text")).otherwise(drawn)).alias("text"))

    def raw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(256, np.int64)
        for b in batches:
            for t in b.column(1).to_pylist():
                total += np.bincount(np.frombuffer(t.lower().encode("utf-8", "surrogatepass"), np.uint8), minlength=256)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(256), pa.int32()), pa.array(total, pa.int64())], ["byte", "n"])

    table = byte_table({r["byte"]: r["n"] for r in sample.mapInArrow(raw, "byte int, n long").groupBy("byte").agg(F.sum("n").alias("n")).filter("n > 0").collect()})

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            frame = b.to_pandas()
            for lang, texts in frame.groupby("lang")["text"]:
                pad = np.zeros(order, np.uint8)
                x = np.concatenate([part for t in texts for part in (pad, symbols(t, table))]).astype(np.int64)
                context = np.zeros(len(x), np.int64)
                for depth in range(order + 1):
                    if depth:
                        context |= np.concatenate((np.zeros(depth, np.int64), x[:-depth]))[: len(x)] << BITS * (depth - 1)
                    key, n = np.unique((context << BITS | x), return_counts=True)
                    m = len(key)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * m, pa.string()), pa.array(np.full(m, depth), pa.int32()), pa.array(key >> BITS, pa.int64()), pa.array((key & (SYMBOLS - 1)), pa.int32()), pa.array(n, pa.int64())], ["lang", "depth", "context", "symbol", "n"])

    counts = sample.mapInArrow(count, "lang string, depth int, context long, symbol int, n long").groupBy("lang", "depth", "context", "symbol").agg(F.sum("n").alias("n")).filter("n > 1 or depth < 3").toPandas()
    missing = set(sizes) - set(counts["lang"])
    assert not missing, f"no text drawn of {sorted(missing)}"
    return build(counts, table, order, min(max_nodes, MOST_BITS // (len(sizes) * SYMBOLS)))


def identify(docs: DataFrame, model: Ppm | None, id_col: str = "doc_id", text_col: str = "text", unknown: str = "und") -> DataFrame:
    """Rows (id, lang_pred, score), one for each row of docs, from whole texts.

    score is the posterior of the language under equal priors, 2^-length normalised. A null text, a text without a letter, or no model gives
    (unknown, 0). Ties go to the first language by code point. Rows that repeat, or repeat an id, keep a row each; an empty table gives an empty one; further
    columns are left behind, whatever their names.
    """
    bound_batches(docs.sparkSession)
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shipped.value
        for b in batches:
            for i in range(0, b.num_rows, 256):
                texts = b.column(1).slice(i, 256).to_pylist()
                names, scores = [unknown] * len(texts), np.zeros(len(texts))
                lettered = [j for j, t in enumerate(texts) if has_letter(t)] if m else []
                if lettered:
                    length = m.code_lengths([texts[j] for j in lettered])
                    best = length.argmin(1)
                    odds = np.exp2(-np.minimum(length - length[np.arange(len(best)), best][:, None], 1000)).sum(1)
                    for j, k, o in zip(lettered, best, odds, strict=True):
                        names[j], scores[j] = m.languages[k], 1 / o
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, 256), pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["id", "lang_pred", "score"])

    kind = dict(docs.dtypes)[id_col]
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(predict, f"id {kind}, lang_pred string, score double").withColumnRenamed("id", id_col)
