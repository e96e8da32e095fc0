"""Quality classifier: a naive Bayes support vector machine over n-gram indicators, fitted by dual coordinate descent."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import _powers, bound_batches, mix

#: Labelled documents of a class that the fit reads at least, if there are so many.
CLASS_LEAST = 200
#: Features are hashed to so many places.
PLACES = 1 << 19
# byte classes: 0 white space, 1 word (letters, digits, all beyond ASCII), 2 other marks, 3 line end
_CLASS = np.array([3 if b == 10 else 0 if b <= 32 or b == 127 else 1 if b >= 128 or chr(b).isalnum() else 2 for b in range(256)], np.int8)
_LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
_UPPER = np.array([65 <= b <= 90 or b == 0xC3 for b in range(256)])  # the lead byte of accented capitals counts with either case
_SMALL = np.array([97 <= b <= 122 for b in range(256)])
_DIGIT = np.array([48 <= b <= 57 for b in range(256)])


def _upto(tag: int, share: float) -> np.ndarray:
    """Indicators of the eighths that a share reaches."""
    return np.arange(tag, tag + int(share * 8) + 1, dtype=np.uint64)


def features(text: str | None) -> np.ndarray:
    """The distinct feature places of a whole text: indicators of word 1- and 2-grams, of 1- to 3-grams of word shapes and marks, and of repetition.

    Null and empty texts have none.
    """
    raw = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
    if not len(raw):
        return np.empty(0, np.int64)
    kind = _CLASS[raw]
    start = np.flatnonzero(np.concatenate(([True], kind[1:] != kind[:-1])))
    end = np.append(start[1:], len(raw))
    real = kind[start] != 0
    start, end = start[real], end[real]
    if not len(start):
        return np.empty(0, np.int64)
    kinds = kind[start]
    p, q = _powers(len(raw))
    total = np.concatenate(([np.uint64(0)], np.cumsum(_LOWER[raw] * p[: len(raw)], dtype=np.uint64)))
    token = mix((total[end] - total[start]) * q[start] + (end - start).astype(np.uint64))
    count = lambda flags: np.diff(np.concatenate(([0], np.cumsum(flags[raw])))[np.stack((start, end))], axis=0)[0]
    capitals, digits = count(_UPPER), count(_DIGIT)
    size = end - start
    shape = (_UPPER[raw[start]] * 1 + 2 * ((capitals > 1) & (count(_SMALL) == 0)) + 4 * (digits > 0) + 8 * (digits == size)).astype(np.uint64)
    shape = np.where(kinds == 1, shape, np.where(size <= 4, token, raw[start] + np.uint64(1000)))  # a long run of marks counts by its first
    out = [token, shape + np.uint64(1 << 40)]
    words = token[kinds == 1]
    if len(words) > 1:
        out += [words[1:] * np.uint64(3) + words[:-1], _upto(1 << 41, (words[1:] == words[:-1]).mean())]
    if len(words) > 5:
        runs = words[4:] + np.uint64(5) * words[3:-1] + np.uint64(7) * words[2:-2]
        out.append(_upto(1 << 42, 1 - len(np.unique(runs)) / len(runs)))
    for k in (2, 3):
        if len(shape) >= k:
            run = np.full(len(shape) - k + 1, np.uint64(k), np.uint64)
            for i in range(k):
                run = mix(run + shape[i : len(shape) - k + 1 + i])
            out.append(run)
    return np.unique((mix(np.concatenate(out)) & np.uint64(PLACES - 1)).astype(np.int64))


@dataclass
class NbSvm:
    """Weights by place with the log-count ratios multiplied in, a bias, and the line from margins to probabilities."""

    weights: np.ndarray
    bias: float
    slope: float = 1.0
    offset: float = 0.0

    def margin(self, text: str | None) -> float:
        f = features(text)
        return (float(self.weights[f].sum()) / np.sqrt(len(f)) if len(f) else 0.0) + self.bias

    def score(self, text: str | None) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * self.margin(text) + self.offset, -40, 40))))


@dataclass
class Bags:
    """The features of many documents in one array: those of document i are flat[start[i] : start[i + 1]]."""

    flat: np.ndarray
    start: np.ndarray

    def __getitem__(self, i: int) -> np.ndarray:
        return self.flat[self.start[i] : self.start[i + 1]]

    def sizes(self) -> np.ndarray:
        return np.diff(self.start)


def fit_svm(bags: Bags, y: np.ndarray, chosen: np.ndarray, alpha: float = 1.0, c: float = 1.0, epochs: int = 12, seed: int = 7) -> NbSvm:
    """Scale indicators by log-count ratios of the classes; minimise hinge loss with an L2 penalty by dual coordinate descent, on the chosen documents.

    y is +1 or -1.
    """
    pos, neg = np.full(PLACES, alpha, np.float32), np.full(PLACES, alpha, np.float32)
    for i in chosen:
        (pos if y[i] > 0 else neg)[bags[i]] += 1
    ratio = np.log(pos / (pos.sum(dtype=float) - alpha * PLACES + alpha)) - np.log(neg / (neg.sum(dtype=float) - alpha * PLACES + alpha))
    ratio[(pos + neg) < 2 * alpha + 2] = 0  # seen in one document: no evidence of either class
    ratio = ratio.astype(np.float32)
    value = Bags(ratio[bags.flat], bags.start)  # divided by the root of the bag's size where it is used
    scale = 1 / np.sqrt(np.maximum(1, bags.sizes()))
    norm = {i: float(value[i] @ value[i]) * scale[i] ** 2 + 1.0 for i in chosen}
    own = y[chosen]
    share = {1.0: 0.5 * len(own) / max(1, (own > 0).sum()), -1.0: 0.5 * len(own) / max(1, (own < 0).sum())}  # both classes weigh the same
    w, bias, dual, rng = np.zeros(PLACES, np.float32), 0.0, np.zeros(len(y)), np.random.default_rng(seed)
    for _ in range(epochs):
        for i in rng.permutation(chosen):
            at = bags[i]
            slack = y[i] * (float(value[i] @ w[at]) * scale[i] + bias) - 1
            new = min(max(dual[i] - slack / norm[i], 0.0), c * share[float(y[i])])
            if new != dual[i]:
                step = (new - dual[i]) * y[i]
                w[at] += np.float32(step * scale[i]) * value[i]
                bias += step
                dual[i] = new
    return NbSvm(w * ratio, bias)


def _margins(model: NbSvm, bags: Bags, chosen: np.ndarray) -> np.ndarray:
    return np.array([(float(model.weights[bags[i]].sum()) / np.sqrt(len(bags[i])) if len(bags[i]) else 0.0) + model.bias for i in chosen])


def calibrate(margins: np.ndarray, y: np.ndarray, rounds: int = 60) -> tuple[float, float]:
    """Platt's line from margins to log odds, by Newton steps on smoothed targets."""
    n1, n0 = (y > 0).sum(), (y < 0).sum()
    t = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a, b = 1.0, 0.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a * margins + b, -40, 40)))
        g, h = p - t, np.maximum(p * (1 - p), 1e-9)
        hess = np.array([[(h * margins**2).sum() + 1e-6, (h * margins).sum()], [(h * margins).sum(), h.sum() + 1e-6]])
        step = np.linalg.solve(hess, [(g * margins).sum(), g.sum()])
        a, b = a - np.clip(step[0], -2, 2), b - np.clip(step[1], -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return float(max(a, 1e-3)), float(b)


def train(docs: DataFrame, labels: DataFrame, learn: Column, max_docs: int = 4000, folds: int = 3, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> NbSvm | None:
    """Fit on labelled rows where `learn` (an expression over the id, there named i) holds; None if a class is missing there.

    About max_docs labelled documents are read for the fit (a documented bound): those whose hash lies below the share that fits, of
    a rare class about CLASS_LEAST at least; the line to probabilities is corrected for its larger share. Their ids, bounded so,
    are broadcast to the scan of the texts. Margins of held-back folds set the line to probabilities.
    """
    bound_batches(docs.sparkSession)
    own = labels.select(F.col(id_col).alias("i"), F.col(label_col).cast("int").alias("y")).filter(learn & F.col("y").isin(0, 1)).distinct()
    sizes = {r["y"]: r["count"] for r in own.groupBy("y").count().collect()}
    if len(sizes) < 2:
        return None
    share = {v: min(1.0, max(max_docs / sum(sizes.values()), CLASS_LEAST / k)) for v, k in sizes.items()}
    place = F.pmod(F.xxhash64(F.col("i").cast("string"), F.lit("fit")), F.lit(1 << 30)) / float(1 << 30)
    sample = F.broadcast(own.filter(place < F.when(F.col("y") == 1, share[1]).otherwise(share[0])))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([features(t).astype(np.int32).tobytes() for t in b.column(2).to_pylist()], pa.binary())], ["i", "y", "f"])

    got = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("text")).join(sample, "i").select(F.col("i").cast("string").alias("i"), "y", "text").mapInArrow(read, "i string, y int, f binary").toArrow().sort_by([("i", "ascending"), ("y", "ascending")])
    y = np.where(got["y"].to_numpy() == 1, 1.0, -1.0)
    packed = got["f"].combine_chunks()
    start = np.concatenate(([0], np.cumsum(np.array([len(x.as_buffer()) for x in packed], np.int64) // 4)))
    bags = Bags(np.frombuffer(b"".join(x.as_buffer() for x in packed), np.int32), start)
    del got, packed
    if len(set(y)) < 2:
        return None
    part = np.random.default_rng(11).permutation(len(y)) % folds
    held = np.zeros(len(y))
    for k in range(folds):
        inside, out = np.flatnonzero(part != k), np.flatnonzero(part == k)
        if len(out) and len(set(y[inside])) == 2:
            held[out] = _margins(fit_svm(bags, y, inside), bags, out)
    model = fit_svm(bags, y, np.arange(len(y)))
    model.slope, model.offset = calibrate(held, y)
    model.offset -= float(np.log(share[1] / share[0]))
    return model


def score_quality(docs: DataFrame, model: NbSvm | None, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), with_text: bool = False) -> DataFrame:
    """Rows (id, *keep, score[, text]), one for each row of docs, from whole texts. Null and empty texts get the score of no features.

    Without a model (labels of one class or none) all get 1: what nothing was learnt of isn't rejected. Rows that repeat, or repeat an id, keep a row each; an
    empty table gives an empty one; columns that keep doesn't name are left behind, whatever their names. The model is a fixed number of weights (PLACES) and goes to the executors as a broadcast.
    """
    bound_batches(docs.sparkSession)
    shipped = docs.sparkSession.sparkContext.broadcast(model and NbSvm(model.weights.astype(np.float32), model.bias, model.slope, model.offset))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shipped.value
        for b in batches:
            texts = b.column(b.num_columns - 1)
            s = [m.score(t.as_py()) if m else 1.0 for t in texts]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(s, pa.float64()), *([texts] if with_text else [])], [*b.schema.names[:-1], "score", *(["text"] if with_text else [])])

    cols = [docs[id_col].alias("k0"), *(docs[c].alias(f"k{i + 1}") for i, c in enumerate(keep))]
    slim = docs.select(*cols, docs[text_col].alias("text"))
    schema = ", ".join(f"{c} {t}" for c, t in slim.dtypes[:-1])
    out = slim.mapInArrow(judge, f"{schema}, score double{', text string' if with_text else ''}")
    return out.select(F.col("k0").alias(id_col), *(F.col(f"k{i + 1}").alias(c) for i, c in enumerate(keep)), "score", *([F.col("text").alias(text_col)] if with_text else []))
