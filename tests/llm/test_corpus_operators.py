"""Mixing, near duplicates, embeddings, decontamination and the pipeline: against brute force on small fixtures."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from docloom.llm import decontam, embeddings, minhash, mixing
from docloom.llm.common import components, shingle_hashes, word_hashes
from docloom.llm.queries import NEAR_COPIES

SF = "/root/testdata/sf0.001"

# ---- shared


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(i, i + 1) for i in range(100, 130)]
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = {r.id: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in parent if any(x in e and e[0] != e[1] for e in edges)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_word_hashes_see_words():
    same = word_hashes("The Cat, sat!  on-the mat")
    assert (same == word_hashes("the cat sat on the MAT")).all() and len(same) == 6 and same[0] == same[4]
    assert len(word_hashes(None)) == len(word_hashes(" .,")) == 0
    assert len(shingle_hashes(word_hashes("a b c"), 5)) == 1 and len(shingle_hashes(same, 5)) == 2
    assert (word_hashes("x" * 70_000 + " é") == word_hashes("X" * 70_000 + "\né")).all()


# ---- mixing


def plain_targets(sizes, weights=(5, 2, 1), share=1.5, cap=2.0):
    """Share out by weight; whoever is above the cap stops there, the rest is shared anew."""
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, target, fixed = share * sum(sizes.values()), {}, set()
    while True:
        left = total - sum(target[s] for s in fixed)
        free = [s for s in names if s not in fixed]
        if not free:
            return target
        for s in free:
            target[s] = left * w[s] / sum(w[f] for f in free)
        over = [s for s in free if target[s] > cap * sizes[s]]
        if not over:
            return target
        for s in over:
            target[s] = cap * sizes[s]
            fixed.add(s)


def test_mix_reaches_its_targets(spark):
    rng = random.Random(3)
    rows = [(i, "w " * rng.randrange(0, 60), rng.choice(["a", "b", "c", "d", None]) if i % 3 else "hot") for i in range(1500)] + [(7, None, "a"), (8, "", "only empty"), (5, "x y", "tiny"), (5, "x y", "tiny")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("rate", F.lit("clash")).withColumn("s", F.lit(1))
    got = [r.asDict() for r in mixing.mix_sources(df.select("doc_id", "text", "source", "rate", "s"), keep=("source",)).collect()]
    assert len(got) == len(rows)
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    want = plain_targets(sizes)
    assert sum(want.values()) == pytest.approx(1.5 * sum(sizes.values()))
    for s, target in want.items():
        own = [r for r in got if r["source"] == s]
        assert all(r["target"] == pytest.approx(target) and r["source_size"] == sizes[s] and r["taken"] <= 2 * r["size"] for r in own)
        assert abs(sum(r["taken"] for r in own) - target) <= max(2, 0.02 * target)
    again = [r.asDict() for r in mixing.mix_sources(df, keep=("source",)).collect()]
    assert sorted(map(str, got)) == sorted(map(str, again))
    assert mixing.mix_sources(df.limit(0)).count() == 0


def test_rates_are_the_balanced_tilt(spark):
    """Expected words meet the target exactly before rounding, by rates that rise or fall with size alone."""
    rows = [(i, "w " * (1 + i % 40), "a" if i % 4 else "b") for i in range(400)]
    got = mixing.mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source string"), keep=("source",)).collect()
    for s in ("a", "b"):
        own = [r for r in got if r.source == s]
        assert sum(r.rate * r["size"] for r in own) == pytest.approx(own[0].target, rel=1e-6)
        by_size = {r["size"]: r.rate for r in own}
        steps = np.diff([by_size[k] for k in sorted(by_size)])
        assert (steps >= -1e-12).all() or (steps <= 1e-12).all()


# ---- near duplicates


def brute_classes(rows, params=minhash.NearDupParams()):
    import math

    key = {}
    for i, t in rows:
        w = word_hashes(t)
        key.setdefault(w.tobytes() if len(w) else ("none", i), []).append(i)
    text = {}
    for i, t in rows:
        text.setdefault(i, t)
    reps = [min(v) for k, v in key.items() if k[0] != "none" or isinstance(k, bytes)]
    n, df = len(reps), {}
    for i in reps:
        for s in set(minhash._shingles(text[i], 5).tolist()):
            df[s] = df.get(s, 0) + 1
    common = {int(np.uint64(s).view(np.int64)): 1 - math.log(c / n) for s, c in df.items() if c >= max(1, math.ceil(params.common * n))}
    weigh = minhash.Weigher(common, params)
    root = {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    def join(a, b):
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)

    for v in key.values():
        for i in v[1:]:
            join(v[0], i)
    vec = {i: weigh(text[i]) for i in reps}
    for x, a in enumerate(reps):
        for b in reps[:x]:
            if minhash.weighted_jaccard(vec[a], vec[b]) >= params.similarity:
                join(a, b)
    return {i: find(i) for i in root}


def near_rows():
    rng = random.Random(6)
    words = [f"w{i}" for i in range(3000)]
    shared = " ".join(rng.choice(words) for _ in range(60))
    rows, base = [], [rng.choice(words) for _ in range(150)]
    for i in range(60):
        rows.append((i, " ".join(rng.choice(words) for _ in range(rng.randrange(5, 200))) + (" " + shared if i % 2 else "")))
    for i in range(60, 130):  # one large group with 0 to 9 edits each: chains, and texts just off the line
        own = list(base)
        for _ in range(i % 10):
            own[rng.randrange(150)] = rng.choice(words)
        rows.append((i, " ".join(own)))
    rows += [(200 + i, rows[5][1].upper() + "!!") for i in range(30)] + [(300, None), (301, ""), (302, "..."), (303, "one two"), (304, "One, two"), (305, "x " * 30_000), (306, "x " * 30_000 + "y"), (306, "x " * 30_000 + "y")]
    return rows


@pytest.mark.parametrize("block", [2000, 8])
def test_classes_equal_brute_force(spark, block):
    rows = near_rows()
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("id", F.lit("clash")).withColumn("band", F.lit(1))
    got = minhash.near_duplicates(df, minhash.NearDupParams(block_rows=block)).collect()
    assert len(got) == len(rows)
    want = brute_classes(rows)
    assert {r.doc_id: r.class_id for r in got} == want and all(r.kept == (r.doc_id == want[r.doc_id]) for r in got)
    left = minhash.drop_near_duplicates(df)
    assert sorted(r.doc_id for r in left.collect()) == sorted({c for c in want.values()}) and left.columns == df.columns
    assert minhash.near_duplicates(df.limit(0)).count() == 0


def test_a_large_family_links_like_a_small_one(spark):
    """Copies don't lower the weight of what they share: 30 members, each one edit off the base, among 70 strangers, as among 970; a shared passage still weighs less."""
    rng = random.Random(9)
    words = [f"w{i}" for i in range(5000)]
    base = [rng.choice(words) for _ in range(80)]
    rows = [(i, " ".join(base[: 2 * i + 5] + [f"e{i}"] + base[2 * i + 6 :])) for i in range(30)]
    passage = " ".join(rng.choice(words) for _ in range(60))
    rows += [(100 + i, " ".join(rng.choice(words) for _ in range(80))) for i in range(60)]
    rows += [(200 + i, passage + " " + " ".join(rng.choice(words) for _ in range(5))) for i in range(10)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in minhash.near_duplicates(df, NEAR_COPIES).collect()}
    assert all(got[i] == 0 for i in range(30))
    assert all(got[i] == i for i in range(100, 160))
    texts = spark.createDataFrame([(i, t) for i, t in rows], "id long, text string")
    family = spark.createDataFrame([(i, 0) for i in range(30)], "id long, component long")
    shingle = lambda t: int(minhash._shingles(" ".join(t), 5)[0].view(np.int64))
    coarse = minhash.scan(texts, NEAR_COPIES).filter("block is not null")
    by_text, by_family = minhash.common_shingles(texts, 100, NEAR_COPIES, coarse), minhash.common_shingles(texts, 71, NEAR_COPIES, coarse, family)
    assert by_text[shingle(base[:5])] == pytest.approx(1 - np.log(30 / 100)) and by_family[shingle(base[:5])] == pytest.approx(1 - np.log(1 / 71))
    assert by_family[shingle(passage.split()[:5])] == pytest.approx(1 - np.log(10 / 71))
    assert [r.doc_id for r in corpus_pipeline.near_duplicate_stage(spark, df.filter("doc_id < 160"), SF).orderBy("doc_id").collect()] == [0, *range(100, 160)]


def test_texts_of_repeated_and_null_ids_stay(spark):
    """Only rows whose own text is a copy of a kept row's are dropped."""
    a, b, c, d = (" ".join(f"{x}{i}" for i in range(20)) for x in "abcd")
    rows = [(1, a), (2, a), (2, b), (2, c), (None, c), (None, d), (None, None)]
    left = minhash.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.text or "") for r in left) == [(0, ""), (0, d), (1, a), (2, b), (2, c)]


def test_consistent_samples_meet_weighted_jaccard():
    rng = np.random.default_rng(1)
    s = rng.integers(1, 1 << 62, 300).astype(np.uint64)
    s.sort()
    a, b = (s[:220], rng.uniform(0.5, 5, 220)), (s[60:], rng.uniform(0.5, 5, 240))
    want = minhash.weighted_jaccard(a, b)
    got = (minhash.icws(*a, 4000) == minhash.icws(*b, 4000)).mean()
    assert got == pytest.approx(want, abs=0.03)


# ---- embeddings


@pytest.mark.parametrize("block", [2000, 40])
def test_links_equal_brute_force(spark, block):
    rng = np.random.default_rng(2)
    base = rng.standard_normal((40, 16))
    x = np.concatenate([base, base[:20] + rng.normal(0, 0.08, (20, 16)), np.repeat(base[:1], 150, 0) + rng.normal(0, 0.05, (150, 16)), np.repeat(base[1:2], 30, 0), base[2:5] * 7.5]).astype(np.float32)
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    n = len(rows)
    rows += [(n, None), (n + 1, [0.0] * 16), (n + 2, [float("nan")] + [1.0] * 15), (n + 3, [None] + [1.0] * 15), (n + 4, [float("inf")] * 16), (n + 5, []), (n + 6, [1.0, 2.0]), (n + 7, [2.0, 4.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("label", F.lit(1)).withColumn("id", F.lit("clash")).withColumn("n", F.lit(0))
    got = {r.vec_id: r for r in embeddings.near_embeddings(df, embeddings.ProjectionParams(block=block)).collect()}
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    link = u @ u.T >= 0.95
    np.fill_diagonal(link, False)
    found = np.array([got[i].n_links for i in range(n)])
    assert (found <= link.sum(1)).all() and found.sum() >= 0.98 * link.sum()
    if found.sum() == link.sum():
        component = np.arange(n)
        for _ in range(n):
            component = np.minimum(component, np.where(link, component[None, :], n).min(1))
        assert [got[i].component_id for i in range(n)] == component.tolist()
    assert all(got[i].n_links == 0 and got[i].component_id == i and got[i].kept for i in range(n, n + 6))
    assert got[n + 7].component_id == n + 6 and got[n + 7].n_links == 1
    assert embeddings.near_embeddings(df.limit(0)).count() == 0


def test_plan_is_calibrated():
    p = embeddings.ProjectionParams()
    plan = p.plan(1_000_000)
    rng = np.random.default_rng(3)
    diff = rng.normal(0, np.sqrt(2 - 2 * p.cosine), (20_000, p.projections))
    assert ((np.abs(diff) <= plan.width).sum(1) >= plan.need).mean() >= p.kept - 0.001
    assert p.plan(10**9).planes > plan.planes


# ---- decontamination


def brute_hits(docs, bench):
    fold = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (t or "").translate(fold))
    windows = {}
    for item, t in bench:
        w = words(t)
        n = min(13, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[i : i + n]), set()).add(item)
    out = []
    for d, t in docs:
        w, hit, items = words(t), set(), set()
        for n in {len(k) for k in windows}:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in windows:
                    hit |= set(range(i, i + n))
                    items |= windows[tuple(w[i : i + n])]
        ids = ",".join(sorted(map(str, items)))
        out.append((d, len(w), len(hit), len(items), hashlib.sha256(ids.encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out)


def test_hits_equal_brute_force(spark):
    rng = random.Random(8)
    words = ["É", "é", "The", "the", "a", "b-c", "10", "x.y"] + [f"w{i}" for i in range(8)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    bench = [(i, text(rng.choice([13, 14, 20, 30]))) for i in range(12)] + [(50, "short one"), (51, ""), (52, None), (53, "w1 w2 w3 w4 w5 w6 w7"), (54, text(13)), (2, "THE a b c")]
    docs = []
    for i in range(60):
        parts = [text(rng.randrange(0, 30))]
        for _ in range(rng.randrange(3)):
            b = rng.choice(bench)[1] or ""
            w = b.split()
            k = rng.randrange(len(w)) if w else 0
            parts += [" ".join(w[k:]).upper() if rng.random() < 0.3 else b, text(rng.randrange(0, 40))]
        docs.append((i, " ".join(parts)))
    docs += [(90, None), (91, ""), (92, bench[0][1]), (92, "other text"), (92, "other text"), (93, "w9 " * 60_000 + bench[3][1])]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("tag", F.lit("clash")).withColumn("n_words", F.lit(1)).withColumn("item", F.lit(1))
    bf = spark.createDataFrame(bench, "item_id long, text string").withColumn("doc", F.lit("clash"))
    assert sorted(tuple(r) for r in decontam.decontaminate(df, bf).collect()) == brute_hits(docs, bench)
    assert {r.n_hit for r in decontam.decontaminate(df, bf.limit(0)).collect()} == {0}
    assert decontam.decontaminate(df.limit(0), bf).count() == 0


def test_null_ids_meet_their_hits(spark):
    text = " ".join(f"q{i}" for i in range(30))
    docs, bench = [(None, text), (None, "none"), (3, text)], spark.createDataFrame([(7, text)], "item_id long, text string")
    got = decontam.decontaminate(spark.createDataFrame(docs, "doc_id long, text string"), bench).collect()
    assert sorted((r.doc_id or 0, r.n_hit, r.contaminated) for r in got) == [(0, 0, False), (0, 30, True), (3, 30, True)]


def test_joins_beyond_the_broadcast_bound(spark, monkeypatch):
    monkeypatch.setattr(decontam, "BROADCAST_ROWS", 0)
    docs, bench = [(1, " ".join(f"q{i}" for i in range(40))), (2, "none")], [(7, " ".join(f"q{i}" for i in range(5, 25)))]
    got = decontam.decontaminate(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string"))
    assert sorted(tuple(r) for r in got.collect()) == brute_hits(docs, bench)


# ---- pipeline


def test_pipeline_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("score", F.lit("clash")).withColumn("contaminated", F.lit("clash"))
    extra = spark.createDataFrame([(10**6, None, None, None, 0), (10**6 + 1, "", "en", "src0", 0), (10**6 + 2, "mail me at jo@mail.example.com " + " ".join(f"the of and word{i}." for i in range(60)), "en", "src0", 60)], "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.unionByName(extra.withColumn("score", F.lit("x")).withColumn("contaminated", F.lit("x")))
    seen = [{r.doc_id for r in docs.collect()}]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        assert out.columns[: len(docs.columns)] == docs.columns and (k == 4 or len(out.columns) == len(docs.columns))
        out.write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        seen.append({r.doc_id for r in docs.select("doc_id").collect()})
        assert seen[-1] <= seen[-2]
    assert seen[3] == seen[4] and len(seen[1]) > 0.7 * len(seen[0])
    redacted = spark.read.parquet(str(tmp_path / "3"))
    assert redacted.filter(F.col("text").contains("jo@mail.example.com")).count() == 0 and redacted.filter(F.length("text") != F.col("n_chars")).count() == 0
    assert docs.select(F.max("copy")).first()[0] == 2


def test_pipeline_runs_whole(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.count() > 100 and [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "decontamination", "personal_data", "source_mix"]
