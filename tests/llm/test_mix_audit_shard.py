"""Divergence audit, sharding and importance resampling against plain versions; nulls, ties, repeats, long texts, empty tables, clashing names."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from docloom.llm import divergence, importance, sharding
from docloom.llm.common import byte_fold, numbered, word_slices

DOCS = "doc_id long, text string, lang string, source string, row int, term string, size string, g int, number int"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def table(spark, rows):
    """Documents (doc_id, text, lang, source) with further columns of names that the operators use themselves."""
    return spark.createDataFrame([(*r, 1, "t", "s", 2, 3) for r in rows], DOCS)


def some_docs(seed, n):
    rng = random.Random(seed)
    words = [*"abcdefgh", "Été", "été", "ÑU", "naïve", "x1y", "b2", "日本", "O'Neil"]
    weights = [40, 30, 20, 10, 8, 5, 3, 2, 2, 2, 1, 1, 2, 2, 1, 1]
    out = []
    for i in range(n):
        text = rng.choice([" ", "-", "_", "\t7"]).join(rng.choices(words, weights, k=rng.randrange(0, 60)))
        out.append((i, rng.choice([text, text.upper(), None, ""]) if i % 9 == 0 else text, rng.choice(["en", "en", "de", None, ""]), rng.choice(["s1", "s1", "s2", "S3", "é", None])))
    return [*out, *out[:5], (None, "a b c", "solo", "only")]


def test_slices_give_all_words_once():
    fold = byte_fold(lambda b: 97 <= b <= 122 or 65 <= b <= 90 or b >= 128)
    raw = ("Ab cdé  ,,, " * 300 + "z" * 50 + " end").encode()
    whole = raw.translate(fold).split()
    for step in (1, 7, 64, 10**6):
        assert [w for s in word_slices(raw, fold, step) for w in s] == whole
    assert list(word_slices(None, fold)) == [] == list(word_slices(b"", fold))


def test_numbers_have_no_gaps(spark):
    df = spark.range(0, 1000, 1, 7).selectExpr("id", "id % 3 AS a")
    got = numbered(df, "a", "id").collect()
    assert [r.number for r in sorted(got, key=lambda r: (r.a, r.id))] == list(range(1000))
    assert numbered(df.limit(0), "a").count() == 0


# -- divergence --------------------------------------------------------------------------------------------------------------------------------------


def plain_audit(rows, least, top):
    terms = lambda t: re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
    df, n, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for _, text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups[lang].add(source)
        df[lang].update(set(terms(text)))
        n[lang, source].update(terms(text))
    out = []
    for lang, sources in groups.items():
        kept = [t for t in df[lang] if df[lang][t] >= least]
        v = len(kept)
        total = {s: sum(n[lang, s][t] for t in kept) for s in sources}
        p = {s: {t: 1 + 10**9 * (n[lang, s][t] + 2) // (total[s] + 2 * v) for t in kept} for s in sources}
        q = {t: 1 + 10**9 * (sum(n[lang, s][t] for s in sources) + 2) // (sum(total.values()) + 2 * v) for t in kept}
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in sources:
            pairs = sorted(((-sum(f(p[s][t], p[o][t]) for t in kept), o.encode()) for o in sources if o != s))
            some = sorted((-f(p[s][t], q[t]), t.encode()) for t in kept if n[lang, s][t] and p[s][t] > q[t])[:top]
            for part, found in (("pair", pairs), ("term", some)):
                out += [(lang, s, part, item.decode(), -value, i + 1) for i, (value, item) in enumerate(found)]
    return sorted(out)


@pytest.mark.parametrize(("cells", "held", "groups"), [(4_000_000, 500_000, 200_000), (3, 5, 2)])
def test_audit_equals_the_plain_version(spark, monkeypatch, cells, held, groups):
    monkeypatch.setattr(divergence, "CELLS", cells)
    monkeypatch.setattr(divergence, "HELD", held)
    monkeypatch.setattr(divergence, "PASS_GROUPS", groups)
    rows = some_docs(3, 160)
    got = divergence.audit(table(spark, rows).repartition(5), least_docs=6, top=3)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(map(tuple, got.collect())) == plain_audit(rows, 6, 3)


def test_audit_without_kept_terms_and_of_nothing(spark):
    rows = [(1, "a b", "en", "x"), (2, None, "en", "y"), (3, "...", None, None)]
    assert sorted(map(tuple, divergence.audit(table(spark, rows)).collect())) == [("en", "x", "pair", "y", 0, 1), ("en", "y", "pair", "x", 0, 1)]
    assert divergence.audit(table(spark, [])).count() == 0


def test_shares_are_exact_for_large_counts():
    import numpy as np

    rng = random.Random(8)
    for _ in range(300):
        kept, total = rng.randrange(1, 10**9), rng.randrange(1, 8 * 10**15)
        count = rng.randrange(0, total + 1)
        assert divergence.share(np.array([count]), total, kept)[0] == 1 + 10**9 * (count + 2) // (total + 2 * kept)


# -- sharding ----------------------------------------------------------------------------------------------------------------------------------------


def one_by_one(sizes, capacity):
    bins, out = [], []
    for s in sorted(sizes, reverse=True):
        fits = [(room, i) for i, room in enumerate(bins) if room >= s]
        i = min(fits)[1] if fits else len(bins)
        if not fits:
            bins.append(capacity)
        bins[i] = max(0, bins[i] - s)
        out.append((s, i))
    return out


def test_runs_equal_best_fit_of_one_group_at_a_time():
    rng = random.Random(5)
    for _ in range(300):
        sizes = [rng.choice([rng.randrange(1, 12), rng.randrange(1, 120)]) for _ in range(rng.randrange(1, 60))]
        capacity = rng.randrange(1, 150)
        classes = sorted(Counter(sizes).items(), reverse=True)
        runs = [(s, b) for s, n, b in sharding.best_fit(classes, capacity) for _ in range(n)]
        assert runs == one_by_one(sizes, capacity)


def test_free_space_finds_the_tightest_bin():
    rng, tree, plain = random.Random(6), sharding.FreeSpace(leaf=4), []
    for i in range(4000):
        if rng.random() < 0.6:
            free = rng.randrange(200)
            tree.add(free, i)
            plain.append((free, i))
        else:
            size = rng.randrange(220)
            want = min((x for x in plain if x[0] >= size), default=None)
            assert tree.take(size) == want
            if want:
                plain.remove(want)


def test_shards_hold_whole_groups_and_count_their_rows(spark):
    rng = random.Random(7)
    texts = ["é" * rng.randrange(1, 200) + str(i % 70) for i in range(300)] + ["same text"] * 60 + [None, None, ""]
    rows = [(i % 290, t, "en", "s") for i, t in enumerate(texts)]
    got = sharding.shard(table(spark, rows).repartition(6), shards=7)
    assert got.columns == ["doc_id", "size", "text_crc32", "shard", "slot"]
    got = got.collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t, *_ in rows)
    shards, groups = defaultdict(list), defaultdict(set)
    for r in got:
        shards[r.shard].append(r)
        groups[r.text_crc32, r.size].add(r.shard)
    assert all(len(s) == 1 for s in groups.values()) and sorted(shards) == list(range(7))
    assert all(sorted(r.slot for r in s) == list(range(len(s))) for s in shards.values())
    bytes_ = [sum(r.size for r in s) for s in shards.values()]
    assert max(bytes_) - min(bytes_) <= 0.02 * max(bytes_)


def test_shards_of_a_capacity(spark):
    rows = [(i, "x" * (100 * (i % 5 + 1) - 16), "en", "s") for i in range(50)] + [(99, "y" * 5000, "en", "s")]
    got = sharding.shard(table(spark, rows), capacity=1000).collect()
    by = Counter()
    for r in got:
        by[r.shard] += r.size
    assert len(got) == 51 and by.pop(next(r.shard for r in got if r.doc_id == 99)) == 5016
    # equal texts are one group: the 10 rows of 500 bytes are 5,000 together
    sizes = Counter(t for _, t, *_ in rows)
    alone = [n * (len(t) + 16) for t, n in sizes.items() if n * (len(t) + 16) > 1000]
    assert all(b in alone or b <= 1000 for b in by.values())
    assert sharding.shard(table(spark, []), shards=3).count() == 0
    for wrong in ({}, {"shards": 3, "capacity": 4}, {"shards": 0}):
        with pytest.raises(ValueError):
            sharding.shard(table(spark, []), **wrong)


def test_a_group_above_the_mean_is_alone_and_the_rest_stay_even():
    runs = sharding.evenest([(1000, 1), (10, 50), (1, 500)], 5)
    by = Counter()
    for s, n, b in runs:
        by[b] += s * n
    assert sorted(by.values()) == [250, 250, 250, 250, 1000]


# -- importance resampling ---------------------------------------------------------------------------------------------------------------------------


def plain_resample(rows, target, p):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
    grams = lambda t: [" ".join(w[i : i + k]) for w in [words(t)] for k in range(1, p.most_words + 1) for i in range(len(w) - k + 1)]
    bucket = lambda f: zlib.crc32(f.encode()) % p.buckets
    s, t = Counter(bucket(f) for r in rows for f in grams(r[1])), Counter(bucket(f) for x in target for f in grams(x))
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1.0) * (big_s + p.buckets) / ((s[b] + 1.0) * (big_t + p.buckets))))
    out = []
    for i, text, *_ in rows:
        f = grams(text)
        weight = sum(gain(bucket(x)) for x in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"{p.seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words(text))])
    able = sorted((r for r in out if r[5] >= p.least_words), key=lambda r: (-r[3], -1 if r[0] is None else r[0]))
    for k, r in enumerate(able[: p.percent * len(able) // 100]):
        r[4] = k + 1
    return sorted((tuple(r[:5]) for r in out), key=repr)


@pytest.mark.parametrize("p", [importance.Resampling(), importance.Resampling(most_words=3, buckets=50, percent=30, least_words=5, hot_share=20), importance.Resampling(hot_share=1, percent=100)])
def test_resampling_equals_the_plain_version(spark, monkeypatch, p):
    monkeypatch.setattr(importance, "HELD", 40)
    rows, target = some_docs(11, 120), ["a b naïve c d", None, "", "zebra ÉTÉ a"]
    bench = spark.createDataFrame([(i, t, 0) for i, t in enumerate(target)], "item_id int, text string, feature int")
    got = importance.resample(table(spark, rows).repartition(4), bench, p)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert sorted(map(tuple, got.collect()), key=repr) == plain_resample(rows, target, p)


def test_resampling_of_and_toward_nothing(spark):
    none = spark.createDataFrame([], "text string")
    assert importance.resample(table(spark, []), none).count() == 0
    rows = [(1, "a " * 30, "en", "s"), (2, None, "en", "s")]
    assert sorted(map(tuple, importance.resample(table(spark, rows), none).collect()), key=repr) == plain_resample(rows, [], importance.Resampling())


def test_n_grams_cross_slices(monkeypatch):
    text, whole, cut = ("Ab cd, ef gh " * 40).encode(), Counter(), Counter()
    n = importance.features(text, 3, whole)
    monkeypatch.setattr(importance, "word_slices", lambda raw, fold: word_slices(raw, fold, 5))
    assert importance.features(text, 3, cut) == n and cut == whole
