"""Audit of how sources diverge: exact counts of terms by sorted runs, partial divergences of pairs of sources and of terms."""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bound_batches, byte_fold, materialise, word_slices

#: Terms are runs of letters (only A-Z lower-cased) and whatever isn't ASCII.
_FOLD = byte_fold(lambda b: 65 <= b <= 90 or 97 <= b <= 122 or b >= 128)
#: Distinct (group, term) entries that one task holds before it hands its counts on.
HELD = 500_000
#: Cells of the tables of pairs that one task holds, and of one table of terms by sources.
CELLS = 4_000_000
#: Groups whose totals are sent to every task, and beyond which the languages are gone through in several passes.
PASS_GROUPS = 200_000
SCALE = 1_000_000_000


def share(count: np.ndarray, total: np.ndarray | int, kept: int) -> np.ndarray:
    """1 + floor(SCALE (count + 2) / (total + 2 kept)), exact in 64 bits: a long division by thousands, good for totals up to 9e15."""
    of = np.asarray(total, np.int64) + 2 * kept
    x = np.asarray(count, np.int64) + 2
    whole, rest = x // of, x % of
    for _ in range(3):
        whole, rest = whole * 1000 + rest * 1000 // of, rest * 1000 % of
    return whole + 1


def gap(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """floor((p - q)^2 / (p + q))."""
    return (p - q) ** 2 // (p + q)


def partial_counts(docs: DataFrame) -> DataFrame:
    """Rows (lang, term, source, docs, n) for docs of lang, source and text, whose docs and n add up to each term's documents and occurrences.

    Documents come one after the other, so each task adds up its own before anything is shuffled; beyond HELD entries it hands them on and starts anew.
    """

    def handed(held: dict) -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, with_term) in held.items():
            terms = list(n)
            for i in range(0, len(terms), 50_000):
                part = terms[i : i + 50_000]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(part), pa.string()), pa.array(part, pa.binary()).cast(pa.string()), pa.array([source] * len(part), pa.string()), pa.array([with_term[t] for t in part], pa.int64()), pa.array([n[t] for t in part], pa.int64())],
                    ["lang", "term", "source", "docs", "n"],
                )

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = defaultdict(lambda: (Counter(), Counter()))
        for b in batches:
            for lang, source, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).cast(pa.binary()), strict=True):
                n, with_term = held[lang, source]
                seen: set[bytes] = set()
                for words in word_slices(raw.as_py(), _FOLD):
                    n.update(words)
                    seen.update(words)
                with_term.update(seen)
            if sum(len(n) for n, _ in held.values()) > HELD:
                yield from handed(held)
                held.clear()
        yield from handed(held)

    return docs.select("lang", "source", "text").mapInArrow(count, "lang string, term string, source string, docs long, n long")


def _starts(*columns: pa.Array) -> np.ndarray:
    """Where rows differ from the row before them; the first does."""
    n = len(columns[0])
    new = np.zeros(n, bool)
    new[:1] = True
    for c in columns:
        new[1:] |= pc.not_equal(c.slice(1), c.slice(0, n - 1)).to_numpy(zero_copy_only=False)
    return np.flatnonzero(new)


def term_runs(docs: DataFrame, least_docs: int) -> DataFrame:
    """Rows (lang, term, sources, counts) for the terms in at least least_docs documents of a language, sources in order.

    Partial counts are dealt out by (lang, term) and sorted by (lang, term, source) within each task; one scan over the runs adds them up. A run holds no
    more than a row per source and hand-over of a task, however many documents have the term; between batches only the reduced last run is carried over.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carried: pa.Table | None = None

        def reduced(t: pa.Table) -> pa.Table:
            at = _starts(t["lang"], t["term"], t["source"])
            sums = [pa.array(np.add.reduceat(t[c].to_numpy(), at)) for c in ("docs", "n")]
            return pa.table([*(t[c].take(pa.array(at)) for c in ("lang", "term", "source")), *sums], ["lang", "term", "source", "docs", "n"]).combine_chunks()

        def kept(t: pa.Table) -> pa.RecordBatch:
            at = _starts(t["lang"], t["term"])
            past = np.append(at[1:], t.num_rows)
            keep = np.add.reduceat(t["docs"].to_numpy(), at) >= least_docs
            inside = np.repeat(keep, past - at)
            t, sizes, first = t.filter(pa.array(inside)), (past - at)[keep], at[keep]
            offsets = pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32))
            heads = pa.array((np.cumsum(np.concatenate(([0], sizes)))[:-1]).astype(np.int64)) if len(first) else pa.array([], pa.int64())
            flat = {c: t[c].combine_chunks() for c in t.column_names}
            flat = {c: a.chunk(0) if isinstance(a, pa.ChunkedArray) and a.num_chunks == 1 else pa.concat_arrays(a.chunks) if isinstance(a, pa.ChunkedArray) and a.num_chunks else pa.array([], t.schema.field(c).type) if isinstance(a, pa.ChunkedArray) else a for c, a in flat.items()}
            return pa.RecordBatch.from_arrays([flat["lang"].take(heads), flat["term"].take(heads), pa.ListArray.from_arrays(offsets, flat["source"]), pa.ListArray.from_arrays(offsets, flat["n"])], ["lang", "term", "sources", "counts"])

        for b in batches:
            if not b.num_rows:
                continue
            t = pa.Table.from_batches([b])
            t = reduced(pa.concat_tables([carried, t]).combine_chunks() if carried is not None else t)
            last = int(_starts(t["lang"], t["term"])[-1])
            if last:
                yield kept(t.slice(0, last).combine_chunks())
            carried = t.slice(last).combine_chunks()
        if carried is not None:
            yield kept(carried)

    sort = ("lang", "term", "source")
    return partial_counts(docs).repartition("lang", "term").sortWithinPartitions(*sort).mapInArrow(scan, "lang string, term string, sources array<string>, counts array<long>")


def _partials(runs: DataFrame, totals: dict[str, tuple[int, list[str], list[int]]], top: int) -> DataFrame:
    """Rows (part, lang, source, item, value): partial sums of pairs (source before item) and the best terms of each group that one task has seen.

    totals: by language, the number of kept terms, its sources in order and their numbers of occurrences.
    """
    known = runs.sparkSession.sparkContext.broadcast(totals)

    def rows(part: str, lang: str, sources: list, items: list, values: list) -> pa.RecordBatch:
        text = [pa.array(x, pa.string()) for x in ([part] * len(values), [lang] * len(values), sources, items)]
        return pa.RecordBatch.from_arrays([*text, pa.array(values, pa.int64())], ["part", "lang", "source", "item", "value"])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs: dict[tuple[str, int], np.ndarray] = {}  # by language and first source: sums over the sources after it
        best: dict[tuple[str, int], list] = defaultdict(list)
        places: dict[str, dict] = {}

        def handed() -> Iterator[pa.RecordBatch]:
            for (lang, a), sums in pairs.items():
                names, some = known.value[lang][1], np.flatnonzero(sums)
                yield rows("pair", lang, [names[a]] * len(some), [names[a + 1 + i] for i in some], sums[some].tolist())
            pairs.clear()

        def settle(lang: str, terms: pa.Array, sources: pa.Array, counts: pa.Array) -> Iterator[pa.RecordBatch]:
            kept, names, n = known.value[lang]
            if lang not in places:
                places[lang] = {s: i for i, s in enumerate(names)}
            lens = np.diff(sources.offsets.to_numpy())
            at = np.array([places[lang][s] for s in sources.flatten().to_pylist()], np.int64)
            table = np.zeros((len(terms), len(names)), np.int64)
            table[np.repeat(np.arange(len(terms)), lens), at] = counts.flatten().to_numpy()
            p, q = share(table, np.array(n, np.int64), kept), share(table.sum(axis=1), sum(n), kept)
            words = terms.cast(pa.binary()).to_pylist()
            for a in range(len(names)):
                over = np.flatnonzero((table[:, a] > 0) & (p[:, a] > q))
                if len(over):
                    found = zip((-gap(p[over, a], q[over])).tolist(), (words[i] for i in over), strict=True)
                    best[lang, a] = sorted([*best[lang, a], *found])[:top]
                if a + 1 < len(names):
                    sums = gap(p[:, a + 1 :], p[:, a : a + 1]).sum(axis=0)
                    pairs[lang, a] = pairs[lang, a] + sums if (lang, a) in pairs else sums
                    if len(pairs) * len(names) > CELLS:
                        yield from handed()

        for b in batches:
            at = np.append(_starts(b.column(0)), b.num_rows) if b.num_rows else np.array([0])
            for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                lang = b.column(0)[i].as_py()
                step = max(1, CELLS // max(1, len(known.value[lang][1])))
                for k in range(i, j, step):
                    m = min(step, j - k)
                    # copies, so that lists start at offset 0
                    part = pa.RecordBatch.from_arrays([c.slice(k, m).take(pa.array(range(m))) for c in b.columns[1:]], ["term", "sources", "counts"])
                    yield from settle(lang, *part.columns)
        yield from handed()
        for (lang, a), found in best.items():
            yield rows("term", lang, [known.value[lang][1][a]] * len(found), [t.decode() for _, t in found], [-v for v, _ in found])

    return runs.mapInArrow(scan, "part string, lang string, source string, item string, value long")


def audit(docs: DataFrame, least_docs: int = 10, top: int = 10, lang_col: str = "lang", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """Rows (lang, source, part, item, value, rank) for each (lang, source) group of docs; all arithmetic is in whole numbers.

    A language keeps the terms in at least least_docs of its documents. Each group, and the language, gives a kept term share(count, N, kept terms), N the sum of its
    counts of kept terms. Part `pair`: for each other source of the language, the sum of gap() over all kept terms. Part `term`: the `top` terms by gap() to the language among those that the
    group has and that weigh more there. rank counts from 1 in each group and part, by falling value, then by the item's UTF-8 bytes.

    Texts, languages and sources that are null count as ''. Groups without terms still have pairs; a language with one source has none, and one without kept terms has
    pairs of value 0. Repeated rows and ids count each; very long texts are split a slice at a time; an empty table gives no rows; further columns don't matter, whatever
    their names. Two groups of pairs make as many rows as a language has pairs of sources: that is the result. Totals of groups go to every task, PASS_GROUPS at most
    in one pass over the runs (more if one language alone has more).
    """
    spark = docs.sparkSession
    bound_batches(spark)
    plain = docs.select(*(F.coalesce(docs[c], F.lit("")).alias(name) for c, name in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))))
    runs = materialise(term_runs(plain, least_docs), "runs")
    groups = plain.select("lang", "source").distinct()
    each = runs.select("lang", F.explode(F.arrays_zip("sources", "counts")).alias("x")).groupBy("lang", F.col("x.sources").alias("source")).agg(F.sum("x.counts").alias("n"))
    kept = runs.groupBy("lang").agg(F.count("*").alias("kept"))
    groups = materialise(groups.join(each, ["lang", "source"], "left").join(kept, "lang", "left").select("lang", "source", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("kept", F.lit(0)).alias("kept")), "groups", light=True)
    sizes = groups.filter("kept > 0").groupBy("lang").agg(F.count("*").alias("n")).collect()
    passes: list[tuple[int, list[str]]] = []
    for r in sizes:
        if passes and passes[-1][0] + r.n <= PASS_GROUPS:
            passes[-1] = (passes[-1][0] + r.n, [*passes[-1][1], r.lang])
        else:
            passes.append((r.n, [r.lang]))
    parts = []
    for _, langs in passes:
        totals: dict[str, tuple[int, list[str], list[int]]] = {}
        for r in groups.filter(F.col("lang").isin(langs)).orderBy("lang", "source").toLocalIterator():
            _, names, n = totals.setdefault(r.lang, (r.kept, [], []))
            names.append(r.source)
            n.append(r.n)
        parts.append(materialise(_partials(runs.filter(F.col("lang").isin(langs)), totals, top), "partials"))
    found = spark.createDataFrame([], "part string, lang string, source string, item string, value long")
    for p in parts:
        found = found.unionAll(p)
    sums = materialise(found.filter("part = 'pair'").groupBy("lang", "source", "item").agg(F.sum("value").alias("value")), "pairs", light=True)
    both = sums.unionAll(sums.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value"))
    others = groups.select("lang", "source").join(groups.select("lang", F.col("source").alias("item")), "lang").filter("source != item")
    pairs = others.join(both, ["lang", "source", "item"], "left").select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0)).cast("long").alias("value"))
    terms = found.filter("part = 'term'").select("lang", "source", "part", "item", "value")
    ranked = pairs.unionAll(terms).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")))
    return ranked.filter(f"part = 'pair' OR rank <= {int(top)}")
