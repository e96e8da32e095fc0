"""Near-duplicate texts: improved consistent weighted sampling over TF-IDF shingles, banded, verified by weighted Jaccard similarity."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, components, materialise, mix, shingle_hashes, small, word_hashes


@dataclass(frozen=True)
class NearDupParams:
    """shingle: words of a shingle; similarity: weighted Jaccard of a link; bands x rows samples a text; common: share of texts from which a shingle's weight falls.

    votes: who counts in a shingle's frequency: each distinct text ("texts"), or each family of near copies once ("families"), whose members then don't
    lower the weight of what they share.
    """

    shingle: int = 5
    similarity: float = 0.8
    bands: int = 14
    rows: int = 4
    common: float = 0.01
    votes: str = "texts"
    #: Ids or pairs up to so many rows are broadcast; beyond that joins shuffle.
    broadcast_rows: int = 500_000

    #: A tile of a crowded band compares two blocks of about so many texts, or bytes of text, at most.
    block_rows: int = 2000
    block_bytes: int = 8_000_000

    @property
    def samples(self) -> int:
        return self.bands * self.rows


#: Buckets of the first, coarse count of shingles: a fixed table per task, added up over tasks.
COARSE = 1 << 20
#: Plain minimum hashes of the first pass, which only finds families: bands x rows.
FAMILY_BANDS, FAMILY_ROWS = 6, 4


def _shingles(text: str | None, k: int) -> np.ndarray:
    return shingle_hashes(word_hashes(text), k)


def scan(rows: DataFrame, params: NearDupParams) -> DataFrame:
    """One pass over the whole texts of rows (id, text), for what needs no weights. Two kinds of rows come out: (id, digest, bytes, bands) for each text,
    and per task the blocks (block, counts) of a table that counts texts by bucket of shingle.

    digest is of the words in order (null without words); bands are of FAMILY_BANDS x FAMILY_ROWS plain minimum hashes, for the search of families.
    """
    seeds = mix(np.arange(FAMILY_BANDS * FAMILY_ROWS, dtype=np.uint64) + np.uint64(0x0FA111E5))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(COARSE, np.int64)
        for b in batches:
            digests, sizes, bands, parts = [], [], [], []
            for t in b.column(1).to_pylist():
                w = word_hashes(t)
                sizes.append(len(t) * 2)
                if not len(w):
                    digests.append(None)
                    bands.append(None)
                    continue
                place = np.arange(1, len(w) + 1, dtype=np.uint64)
                digests.append(mix(w + place * np.uint64(0x9E3779B97F4A7C15)).sum(dtype=np.uint64).tobytes() + mix(w ^ mix(place)).sum(dtype=np.uint64).tobytes())
                s = np.unique(shingle_hashes(w, params.shingle))
                parts.append((s & np.uint64(COARSE - 1)).astype(np.int32))
                least = np.full(len(seeds), np.iinfo(np.uint64).max)
                for i in range(0, len(s), 4096):
                    least = np.minimum(least, mix(s[i : i + 4096, None] ^ seeds[None, :]).min(0))
                h = np.arange(FAMILY_BANDS, dtype=np.uint64)
                for row in least.reshape(FAMILY_BANDS, FAMILY_ROWS).T:
                    h = mix(h * np.uint64(31) + row)
                bands.append(h.view(np.int64))
            if parts:
                total += np.bincount(np.concatenate(parts), minlength=COARSE)
            none = pa.nulls(b.num_rows, pa.int32())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(digests, pa.binary()), pa.array(sizes, pa.int64()), pa.array(bands, pa.list_(pa.int64())), none, pa.nulls(b.num_rows, pa.binary())], names)
        step = 1 << 12
        blocks = [(i, total[i * step : (i + 1) * step]) for i in range(COARSE // step)]
        n = len(blocks)
        yield pa.RecordBatch.from_arrays([pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.list_(pa.int64())), pa.array([i for i, _ in blocks], pa.int32()), pa.array([v.astype(np.uint32).tobytes() for _, v in blocks], pa.binary())], names)

    names = ["id", "digest", "bytes", "bands", "block", "counts"]
    return rows.select("id", "text").mapInArrow(work, "id long, digest binary, bytes long, bands array<long>, block int, counts binary")


def common_shingles(docs: DataFrame, n: int, params: NearDupParams, coarse: DataFrame, families: DataFrame | None = None) -> dict[int, float]:
    """Weights of the shingles that at least a share `common` of all n distinct texts (rows of docs: id, text) hold; all others weigh the most.

    With families (id, component) all texts of a component count once for each shingle that any of them holds, and n is the number of families, texts of
    no component included.

    A shingle in a share f of texts weighs 1 - ln(max(f, common)): inverse document frequency, level below `common`. Counts are exact and over all texts:
    tables of COARSE buckets (coarse: block, counts; copies count there too, so no bucket is counted short), added up over tasks, leave the buckets that
    reach the line; only shingles of those are counted one by one. No more than mean length / common shingles (distinct ones of a family) can reach it,
    whatever the number of texts; so many go to the driver and the executors.
    """
    line = max(1, math.ceil(params.common * n))
    if n == 0:
        return {}
    k = params.shingle

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}  # as many tables as there are blocks at most, however many tasks sent theirs
        for b in batches:
            for i, c in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                totals[i] = totals.get(i, 0) + np.frombuffer(c.as_py(), np.uint32).astype(np.int64)
        hot = [np.flatnonzero(t >= line) + (i << 12) for i, t in totals.items()]
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(hot) if hot else [], pa.int64())], ["bucket"])

    hot = np.sort(coarse.select("block", "counts").repartition("block").mapInArrow(add, "bucket long").toPandas()["bucket"].to_numpy())
    if not len(hot):
        return {}
    flags = np.zeros(COARSE, bool)
    flags[hot] = True
    shipped = docs.sparkSession.sparkContext.broadcast(np.packbits(flags))

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = np.unpackbits(shipped.value).astype(bool)
        for b in batches:
            parts: dict[int | None, list[np.ndarray]] = {}
            for t, g in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                s = np.unique(_shingles(t, k))
                parts.setdefault(g, []).append(s[wanted[(s & np.uint64(COARSE - 1)).astype(np.int64)]])
            for g, own in parts.items():
                s, c = np.unique(np.concatenate(own), return_counts=True)
                if len(s):
                    yield pa.RecordBatch.from_arrays([pa.array(s.view(np.int64), pa.int64()), pa.array([g] * len(s), pa.int64()), pa.array(c, pa.int64())], ["s", "g", "n"])

    if families is None:
        voters = docs.select("text", F.lit(None).cast("long").alias("g"))
    else:
        voters = docs.join(small(families, params.broadcast_rows), "id", "left").select("text", F.col("component").alias("g"))
    held = voters.mapInArrow(exact, "s long, g long, n long").groupBy("s", "g").agg(F.sum("n").alias("n"))
    got = held.groupBy("s").agg(F.sum(F.when(F.col("g").isNull(), F.col("n")).otherwise(1)).alias("n")).filter(F.col("n") >= line).toPandas()
    return {int(s): 1.0 - math.log(c / n) for s, c in zip(got["s"], got["n"], strict=True)}


class Weigher:
    """TF-IDF weights of a text's shingles."""

    def __init__(self, common: dict[int, float], params: NearDupParams):
        keys = np.array(list(common), np.int64).view(np.uint64)
        order = np.argsort(keys)
        self.keys, self.weights = keys[order], np.array(list(common.values()))[order]
        self.most, self.k = 1.0 - math.log(params.common), params.shingle

    def idf(self, s: np.ndarray) -> np.ndarray:
        """Weights of one occurrence of each of the shingles s."""
        out = np.full(len(s), self.most)
        if len(self.keys) and len(s):
            at = np.minimum(np.searchsorted(self.keys, s), len(self.keys) - 1)
            known = self.keys[at] == s
            out[known] = self.weights[at[known]]
        return out

    def __call__(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """(distinct shingles in order, their weights)."""
        s, n = np.unique(_shingles(text, self.k), return_counts=True)
        return s, n * self.idf(s)


def icws(s: np.ndarray, w: np.ndarray, samples: int) -> np.ndarray:
    """Consistent weighted samples (s: distinct shingles, w: weights > 0): for each of `samples` a hash of the sampled (shingle, level).

    Per shingle and sample, r and c are Gamma(2, 1) and b uniform, all drawn from the shingle's hash alone; t = floor(ln w / r + b), ln a = ln c - r (t - b + 1),
    and the shingle with the least a is the sample. Two texts get the same sample with the probability of their weighted Jaccard similarity.
    """
    out = np.empty(samples, np.uint64)
    log_w = np.log(w).astype(np.float32)[:, None]
    scale, half = np.float32(2.0**-16), np.float32(0.5)
    n = len(s)
    chunk = max(1, 32768 // max(1, min(n, 32768)))
    for k in range(0, samples, chunk):
        seeds = mix(np.arange(k, min(samples, k + chunk), dtype=np.uint64) + np.uint64(0x51ED2701))
        h = mix(s[:, None] ^ seeds[None, :])
        bits = h.view(np.uint16).reshape(n, len(seeds), 4)
        u = (bits.astype(np.float32) + half) * scale
        r = -np.log(u[..., 0] * u[..., 1])
        log_c = np.log(-np.log(u[..., 2] * u[..., 3]))
        b = ((h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype(np.float32) * np.float32(2.0**-24)
        t = np.floor(log_w / r + b)
        best = np.argmin(log_c - r * (t - b + np.float32(1.0)), axis=0)
        at = np.arange(len(seeds))
        out[k : k + len(seeds)] = mix(s[best] ^ (t[best, at].astype(np.int64).view(np.uint64) * np.uint64(0xD1B54A32D192ED03)))
    return out


def weighted_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Sum of the lesser over sum of the greater weights; two texts without words are alike."""
    if not len(a[0]) and not len(b[0]):
        return 1.0
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    low = np.minimum(a[1][i], b[1][j]).sum()
    return float(low / (a[1].sum() + b[1].sum() - low))


def _bands(docs: DataFrame, common, params: NearDupParams) -> DataFrame:
    """Rows (id, bytes, bands): the length and a hash for each band of each row (id, text) that has words."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weigh = Weigher(common.value, params)
        for b in batches:
            ids, sizes, bands = [], [], []
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                s, w = weigh(t)
                if not len(s):
                    continue
                x = icws(s, w, params.samples).reshape(params.bands, params.rows)
                h = np.arange(params.bands, dtype=np.uint64)
                for row in range(params.rows):
                    h = mix(h * np.uint64(31) + x[:, row])
                ids.append(i)
                sizes.append(len(t) * 2)
                bands.append(h.view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(bands, pa.list_(pa.int64()))], ["id", "bytes", "bands"])

    return docs.select("id", "text").mapInArrow(work, "id long, bytes long, bands array<long>")


def _verify(pairs: DataFrame, texts: DataFrame, common, params: NearDupParams) -> DataFrame:
    """The pairs (a, b) whose weighted Jaccard similarity reaches the line. Each pair is compared exactly, on whole texts.

    A text in many pairs as a is dealt out with its partners in parts of about block_rows, so that no task meets all of them.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weigh, last, known = Weigher(common.value, params), None, None
        for batch in batches:
            a, b, ok = batch.column(0), batch.column(1), []
            for i, ta, tb in zip(a.to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if i != last:
                    last, known = i, weigh(ta)
                ok.append(weighted_jaccard(known, weigh(tb)) >= params.similarity - 1e-12)
            mask = pa.array(ok, pa.bool_())
            yield pa.RecordBatch.from_arrays([a.filter(mask), b.filter(mask)], ["a", "b"])

    left, right = texts.select(F.col("id").alias("a"), F.col("text").alias("ta")), texts.select(F.col("id").alias("b"), F.col("text").alias("tb"))
    heads = materialise(pairs.groupBy("a").agg(F.ceil(F.count("*") / params.block_rows).cast("int").alias("parts")), "heads", light=True)
    few = lambda df: small(df, params.broadcast_rows)
    dealt = materialise(pairs.join(few(heads), "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int").alias("part")), "pairs", light=True)
    left = left.join(few(heads), "a").select("a", "ta", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    return right.join(few(dealt), "b").join(left, ["a", "part"]).select("a", "b", "ta", "tb").mapInArrow(work, "a long, b long")


def _similar(texts: list[str], groups: np.ndarray, blocks: np.ndarray, weigh: Weigher, line: float) -> np.ndarray:
    """For each text the least place that links of this set reach; pairs of one group, or of one block where there are two, aren't looked at.

    All pairs are compared exactly: a shingle that a text holds k times is k elements of its weight, and the shared weight of all pairs is a matrix product
    over the elements that two texts hold at least.
    """
    n = len(texts)
    root = np.arange(n)
    rows, marks, weights = [], [], []
    total = np.zeros(n)
    for i, t in enumerate(texts):
        s, c = np.unique(_shingles(t, weigh.k), return_counts=True)
        idf = weigh.idf(s)
        total[i] = (c * idf).sum()
        each = np.repeat(np.arange(len(s)), c)
        nth = np.arange(len(each)) - np.repeat(np.cumsum(c) - c, c)
        marks.append(mix(s[each] + nth.astype(np.uint64) * np.uint64(0xA24BAED4963EE407)))
        weights.append(idf[each])
        rows.append(np.full(len(each), i))
    mark, row, weight = np.concatenate(marks), np.concatenate(rows), np.concatenate(weights)
    _, column, times = np.unique(mark, return_inverse=True, return_counts=True)
    shared_columns = np.full(len(times), -1)
    shared_columns[times > 1] = np.arange((times > 1).sum())
    column = shared_columns[column]
    order = np.argsort(column, kind="stable")
    order = order[column[order] >= 0]
    column, row, weight = column[order], row[order], weight[order]
    low = np.zeros((n, n))
    step = max(256, 4_000_000 // max(1, n))
    for first in range(0, int(column[-1]) + 1 if len(column) else 0, step):
        a, b = np.searchsorted(column, [first, first + step])
        part = np.zeros((n, min(step, int(column[-1]) + 1 - first)))
        part[row[a:b], column[a:b] - first] = np.sqrt(weight[a:b])
        low += part @ part.T
    with np.errstate(divide="ignore", invalid="ignore"):
        alike = low / (total[:, None] + total[None, :] - low) >= line - 1e-9
    alike &= groups[:, None] != groups[None, :]
    if len(np.unique(blocks)) > 1:
        alike &= blocks[:, None] != blocks[None, :]
    i, j = np.nonzero(np.triu(alike, 1))
    while len(i):
        was = root.copy()
        least = np.minimum(root[i], root[j])
        np.minimum.at(root, i, least)
        np.minimum.at(root, j, least)
        root = root[root]
        if (root == was).all():
            break
    return root


def _tiles(rows: DataFrame, common, params: NearDupParams) -> DataFrame:
    """Links (a, b) inside the tiles (band, h, tile) of rows (band, h, tile, id, g, block, text): enough to join all that similar pairs join."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weigh = Weigher(common.value, params)
        key, ids, g, block, texts = None, [], [], [], []

        def close() -> pa.RecordBatch:
            a, b = [], []
            if len(set(g)) > 1:
                root = _similar(texts, np.array(g), np.array(block), weigh, params.similarity)
                for i in np.flatnonzero(root != np.arange(len(root))):
                    a.append(ids[root[i]])
                    b.append(ids[i])
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

        for batch in batches:
            for *k, i, gi, bi, t in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if k != key:
                    if len(ids) > 1:
                        yield close()
                    key, ids, g, block, texts = k, [], [], [], []
                ids.append(i)
                g.append(gi)
                block.append(bi)
                texts.append(t)
        if len(ids) > 1:
            yield close()

    dealt = rows.select("band", "h", "tile", "id", "g", "block", "text").repartition("band", "h", "tile").sortWithinPartitions("band", "h", "tile")
    return dealt.mapInArrow(work, "a long, b long")


def _groups(distinct: DataFrame, banded: DataFrame, common, params: NearDupParams) -> DataFrame:
    """Rows (id, component) of all texts (id, text) that links join with others; banded has their bands, common the weights."""
    places = banded.select("id", "bytes", F.posexplode("bands").alias("band", "h"))
    few = lambda df: small(df, params.broadcast_rows)
    shared = materialise(places.groupBy("band", "h").agg(F.count("*").alias("n"), F.min("id").alias("lead")).filter("n > 1").select("band", "h", "lead"), "shared", light=True)
    crowd = materialise(places.join(few(shared), ["band", "h"]).select("band", "h", "id", "bytes", "lead"), "crowd", light=True)
    members = materialise(crowd.select("id").distinct(), "members", light=True)
    texts = distinct.join(few(members), "id", "left_semi")
    texts = materialise(texts, "texts")

    star = materialise(crowd.filter("id != lead").select(F.col("lead").alias("a"), F.col("id").alias("b")).distinct(), "star", light=True)
    links = materialise(_verify(star, texts, common, params), "links")
    group = components(links)
    labelled = crowd.join(few(group), "id", "left").select("band", "h", "id", "bytes", F.coalesce("component", "id").alias("g"))
    # of a mixed band the largest group and the rest get blocks of their own: pairs inside the group are joined already, so only tiles with the rest are made
    per = labelled.groupBy("band", "h", "g").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"))
    mixed = per.groupBy("band", "h").agg(F.count("*").alias("groups"), F.max(F.struct("n", "bytes", "g")).alias("top"), F.sum("n").alias("n"), F.sum("bytes").alias("bytes")).filter("groups > 1")
    fits = lambda n, size: F.greatest(F.lit(1), F.ceil(F.greatest(n / params.block_rows, size / params.block_bytes))).cast("int")
    one = fits(F.col("n"), F.col("bytes")) == 1
    mixed = mixed.select("band", "h", F.col("top.g").alias("first"), F.when(one, 0).otherwise(fits(F.col("top.n"), F.col("top.bytes"))).alias("ours"), F.when(one, 1).otherwise(fits(F.col("n") - F.col("top.n"), F.col("bytes") - F.col("top.bytes"))).alias("rest"))
    mixed = materialise(mixed, "mixed", light=True)
    inside, every = (F.col("g") == F.col("first")) & (F.col("ours") > 0), F.col("ours") + F.col("rest")
    block = F.when(inside, F.pmod(F.xxhash64("id"), F.col("ours"))).otherwise(F.col("ours") + F.pmod(F.xxhash64("id"), F.col("rest"))).cast("int")
    open_ = labelled.join(few(mixed), ["band", "h"]).withColumn("block", block).withColumn("other", F.explode(F.sequence(F.when(inside, F.col("ours")).otherwise(0), every - 1)))
    open_ = open_.select("band", "h", (F.least("block", "other") * every + F.greatest("block", "other")).alias("tile"), "id", "g", "block")
    more_links = materialise(_tiles(texts.join(few(materialise(open_, "open", light=True)), "id"), common, params), "links")
    return components(links.unionAll(more_links))


def near_duplicates(docs: DataFrame, params: NearDupParams = NearDupParams(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, class_id, kept), one for each row of docs: class_id is the smallest id of the group, kept marks it.

    Texts with the same words in the same order are one text from the start, whatever their number. Each distinct text is sampled, its samples are banded,
    and texts that share a band are candidates. First every text is compared with the first of each of its bands; then, in bands whose texts these links
    leave in different groups, all pairs of different groups are compared, in tiles of bounded size and without a row for each pair. So each candidate
    pair is either compared or already joined by links. Links are verified by weighted Jaccard similarity on whole texts; groups are their components. Null and empty texts, and texts without words, are groups of their own.
    With votes "families" a first pass by plain minimum hashes, verified with all weights level, finds the families; shingle frequencies are then of
    families, and all texts are sampled and all candidates compared under these weights.
    Rows that repeat an id or have none are told apart and compared each by its own text; of a class one row is kept, and class_id is null only if all its
    ids are. Nothing is capped or sampled.
    """
    own, numbered = _unique(docs, id_col)
    if not numbered:
        out = _classes(own.select(own[id_col].cast("long").alias("id"), F.coalesce(own[text_col], F.lit("")).alias("text")), params)
        return out.select(F.col("id").alias(id_col), "class_id", (F.col("id") == F.col("class_id")).alias("kept"))
    return _judged_rows(own, params, id_col, text_col).select(F.col("id").alias(id_col), "class_id", "kept")


def _unique(docs: DataFrame, id_col: str) -> tuple[DataFrame, bool]:
    """docs, or, if an id repeats or is null, docs written with a number row_ for each row; and whether they are."""
    n, ids = docs.agg(F.count("*"), F.countDistinct(docs[id_col])).first()
    return (docs, False) if n == ids else (materialise(docs.withColumn("row_", F.monotonically_increasing_id()), "rows"), True)


def _judged_rows(own: DataFrame, params: NearDupParams, id_col: str, text_col: str) -> DataFrame:
    """Rows (row_, id, class_id, kept) of numbered rows: each is compared by its own text; the first by id, nulls last, is kept of each class."""
    found = _classes(own.select(F.col("row_").alias("id"), F.coalesce(own[text_col], F.lit("")).alias("text")), params)
    named = materialise(found.select(F.col("id").alias("row_"), F.col("class_id").alias("c")).join(own.select("row_", own[id_col].cast("long").alias("id")), "row_"), "judged", light=True)
    heads = named.groupBy("c").agg(F.min("id").alias("class_id"), F.min(F.struct(F.col("id").isNull(), "id", "row_"))["row_"].alias("head"))
    return named.join(heads, "c").select("row_", "id", "class_id", (F.col("row_") == F.col("head")).alias("kept"))


def _classes(rows: DataFrame, params: NearDupParams) -> DataFrame:
    """Rows (id, class_id) of rows (id, text) whose ids are neither null nor repeated."""
    spark = rows.sparkSession
    bound_batches(spark)

    scanned = materialise(scan(rows, params), "scanned")
    keyed, coarse = scanned.filter("block is null").select("id", "digest", "bytes", "bands"), scanned.filter("block is not null")
    first = keyed.filter("digest is not null").groupBy("digest").agg(F.min("id").alias("rep"))
    first = materialise(first, "firsts", light=True)
    n = first.count()
    more = keyed.filter("digest is not null").join(first, "digest").filter("id != rep").select("id", "rep").distinct()
    same = materialise(more, "same", light=True)
    known = small(same.select("id"), params.broadcast_rows)
    distinct = rows.join(known, "id", "left_anti")

    if params.votes == "families":
        level = spark.sparkContext.broadcast({})
        banded = keyed.filter("digest is not null").join(known, "id", "left_anti").select("id", "bytes", "bands")
        families = materialise(_groups(distinct, banded, level, params), "families", light=True)
        joined, heads = families.agg(F.count("*"), F.countDistinct("component")).first()
        weights = common_shingles(distinct, n - joined + heads, params, coarse, families)
    else:
        weights = common_shingles(distinct, n, params, coarse)
    common = spark.sparkContext.broadcast(weights)
    final = _groups(distinct, materialise(_bands(distinct, common, params), "bands"), common, params)
    of = same.join(final.select(F.col("id").alias("rep"), "component"), "rep", "left").select("id", F.coalesce("component", "rep").alias("class_id")).unionAll(final.select("id", F.col("component").alias("class_id")))
    of = materialise(of.groupBy("id").agg(F.min("class_id").alias("class_id")), "classes", light=True)
    return keyed.select("id").join(small(of, params.broadcast_rows), "id", "left").select("id", F.coalesce("class_id", "id").alias("class_id"))


def drop_near_duplicates(docs: DataFrame, params: NearDupParams = NearDupParams(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs without those whose own text is a copy or near copy of a kept row's, whatever their ids. Further columns pass through, whatever their
    names: they travel in one struct, so none clashes with what is added on the way."""
    rest = [c for c in docs.columns if c not in (id_col, text_col)]
    packed = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"), F.struct(*(docs[c] for c in rest)).alias("rest") if rest else F.lit(0).alias("rest"))
    own, numbered = _unique(packed, "id")
    if numbered:
        kept = _judged_rows(own, params, "id", "text").filter("kept").select("row_")
        out = own.join(small(materialise(kept, "kept", light=True), params.broadcast_rows), "row_", "left_semi")
    else:
        judged = materialise(near_duplicates(own, params, "id", "text"), "judged", light=True)
        gone = judged.filter("not kept").select("id")
        out = own.join(F.broadcast(gone) if gone.count() <= params.broadcast_rows else gone, "id", "left_anti")
    return out.select(*(out["id"].alias(c) if c == id_col else out["text"].alias(c) if c == text_col else out["rest"][c].alias(c) for c in docs.columns))
