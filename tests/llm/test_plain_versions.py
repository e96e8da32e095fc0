"""Language model, quality model and the pipeline's stages against plain versions that are written down anew from their definitions."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from docloom.llm import langid, minhash, quality
from docloom.llm.common import word_hashes
from docloom.llm.queries import NEAR_COPIES, QUALITY_LINE, _fold

from .test_corpus_operators import brute_hits, plain_targets
from .test_text_operators import brute_spans

SF = "/root/testdata/sf0.001"


def plain_bits(texts, held, table, order=4):
    """Bits of held under prediction by partial matching: lang -> text; method C, symbols of a longer context excluded from the shorter ones in proportion."""
    counts = {}
    for lang, text in texts.items():
        x = [0] * order + langid.symbols(text, table).tolist()
        c = Counter((tuple(x[max(0, i - k) : i]) if i >= k else (0,) * (k - i) + tuple(x[:i]), x[i]) for i in range(len(x)) for k in range(order + 1))
        counts[lang] = {}
        for (context, symbol), n in c.items():
            if n > 1 or len(context) < 3:
                counts[lang].setdefault(context, {})[symbol] = n
    every = {context for own in counts.values() for context in own}

    def chance(own, context, symbol):
        if not context:
            n = sum(own[()].values())
            return (own[()].get(symbol, 0) + 0.5) / (n + 0.5 * langid.SYMBOLS)
        seen = own.get(context)
        if not seen:
            return chance(own, context[1:], symbol)
        n, d = sum(seen.values()), len(seen)
        if symbol in seen:
            return seen[symbol] / (n + d)
        return d / (n + d) * chance(own, context[1:], symbol) / (1 - sum(chance(own, context[1:], s) for s in seen))

    out = {}
    for lang, own in counts.items():
        x, bits = [0] * order + langid.symbols(held, table).tolist(), 0.0
        for i in range(order, len(x)):
            k = 0
            while k < order and tuple(x[i - k - 1 : i]) in every:
                k += 1
            bits -= np.log2(chance(own, tuple(x[i - k : i]), x[i]))
        out[lang] = bits
    return out


def test_code_lengths_equal_plain_matching(spark):
    rng = random.Random(5)
    texts = {"p": "".join(rng.choice("aab c") for _ in range(400)), "q": "".join(rng.choice("abbd é") for _ in range(300)), "r": "dcba " * 40}
    docs = spark.createDataFrame([(i, t, lang) for i, (lang, t) in enumerate(texts.items())], "doc_id long, text string, lang string").coalesce(1)
    model = langid.train(docs, F.lit(True))
    for held in ("abac bad cab", "dcba dcba x", "zzz é aab", "b" * 50, "".join(rng.choice("abcd é") for _ in range(200))):
        want = plain_bits(texts, held, model.table)
        assert model.code_lengths([held])[0] == pytest.approx([want[lang] for lang in model.languages], rel=1e-4)


def test_svm_is_the_plain_optimum():
    """Ratios, margins and the optimum of the hinge loss are those of a dense projected ascent on the dual."""
    rng = random.Random(2)
    y = np.array([1.0 if i % 3 else -1.0 for i in range(24)])
    texts = [" ".join(rng.choice("good fine well plain text" if v > 0 else "bad odd spam plain text").strip() or "x" for _ in range(3)) + " " + " ".join(rng.choice(("good", "fine", "text") if v > 0 else ("bad", "spam", "text")) for _ in range(rng.randrange(2, 9))) for v in y]
    found = [quality.features(t) for t in texts]
    bags = quality.Bags(np.concatenate(found), np.concatenate(([0], np.cumsum([len(f) for f in found]))))
    model = quality.fit_svm(bags, y, np.arange(len(y)), epochs=3000)

    names = sorted({int(f) for own in found for f in own})
    pos, neg = ({f: sum(f in own for own, v in zip(map(set, found), y) if v == side) for f in names} for side in (1.0, -1.0))
    total_pos, total_neg = sum(pos.values()) + 1, sum(neg.values()) + 1
    ratio = np.array([np.log((pos[f] + 1) / total_pos) - np.log((neg[f] + 1) / total_neg) if pos[f] + neg[f] > 1 else 0.0 for f in names])
    x = np.array([[(f in own) for f in names] for own in map(set, found)]) * ratio / np.sqrt([[len(f)] for f in found])
    x = np.hstack([x, np.ones((len(y), 1))])
    gram = (x @ x.T) * np.outer(y, y)
    most = np.where(y > 0, 0.5 * len(y) / (y > 0).sum(), 0.5 * len(y) / (y < 0).sum())
    dual, pace = np.zeros(len(y)), 1 / np.linalg.eigvalsh(gram)[-1]
    for _ in range(200_000):
        dual = np.clip(dual + pace * (1 - gram @ dual), 0, most)
    want = x @ (x.T @ (dual * y))
    assert [model.margin(t) for t in texts] == pytest.approx(want.tolist(), abs=2e-3)


def brute_groups(rows, params):
    """Classes of (id, text) with one vote for each family in document frequencies; ids are distinct."""
    import math

    def classes(weigh):
        root = {i: i for i, _ in rows}

        def find(i):
            while root[i] != i:
                i = root[i]
            return i

        vec = [(i, weigh(t), word_hashes(t).tobytes()) for i, t in rows]
        for k, (a, va, wa) in enumerate(vec):
            for b, vb, wb in vec[:k]:
                if len(wa) and (wa == wb or (len(wb) and minhash.weighted_jaccard(va, vb) >= params.similarity)):
                    x, y = find(a), find(b)
                    root[max(x, y)] = min(x, y)
        return {i: find(i) for i in root}

    family = classes(minhash.Weigher({}, params))
    voted = {}
    for i, t in rows:
        if len(word_hashes(t)):
            voted.setdefault(family[i], set()).update(minhash._shingles(t, 5).tolist())
    n, votes = len(voted), Counter(s for own in voted.values() for s in own)
    common = {int(np.uint64(s).view(np.int64)): 1 - math.log(c / n) for s, c in votes.items() if c >= max(1, math.ceil(params.common * n))}
    return classes(minhash.Weigher(common, params))


def test_pipeline_stages_equal_plain_versions(spark, tmp_path):
    """Every stage on what the stage before kept: the rows that stay are those that a plain version keeps."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    text = lambda df: {r.doc_id: r.text for r in df.select("doc_id", "text").collect()}
    kept = [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, kept[-1], SF).write.parquet(str(tmp_path / str(k)))
        kept.append(spark.read.parquet(str(tmp_path / str(k))))
    raw, good, single, clean, safe = (text(df) for df in kept[:5])

    model = quality.train(docs, spark.read.parquet(f"{SF}/labels.parquet"), _fold(5, "i") != 0)
    assert set(good) == {i for i, t in raw.items() if model.score(t) >= QUALITY_LINE}

    group = brute_groups(sorted(good.items()), NEAR_COPIES)
    assert set(single) == set(group.values())

    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert set(clean) == {r[0] for r in brute_hits(sorted(single.items()), bench) if not r[-1]}

    assert set(safe) == set(clean)
    found = {i: brute_spans(t or "") for i, t in clean.items()}
    assert any(found.values())
    assert all(safe[i] != clean[i] for i, spans in found.items() if spans)
    assert not any(brute_spans(t or "") for t in safe.values())
    assert all(safe[i] == t for i, t in clean.items() if t and not any(c.isdigit() or c == "@" for c in t) and " at" not in t.lower() and "[at" not in t.lower() and "(at" not in t.lower())

    words = lambda t: len((t or "").split())
    source = {r.doc_id: r.source for r in kept[4].select("doc_id", "source").collect()}
    sizes, taken, copies = Counter(), Counter(), Counter()
    for i, t in safe.items():
        sizes[source[i]] += words(t)
    for r in kept[5].select("doc_id", "text", "source").collect():
        taken[r.source] += words(r.text)
        copies[r.doc_id] += 1
        assert r.text == safe[r.doc_id]
    longest = {s: max(words(t) for i, t in safe.items() if source[i] == s) for s in sizes}
    assert set(copies) <= set(safe) and max(copies.values()) <= 2
    assert all(abs(taken[s] - target) <= longest[s] for s, target in plain_targets(sizes).items())
