"""Main text, languages, personal data, urls, quality, token counts: against plain versions, with the awkward rows."""

import re
import zlib

import pytest
from pyspark.sql import functions as F

import public_tokenizers
from docloom.llm import html, langid, pii, quality, tokens, urls
from docloom.llm.queries import URL_RULES

SF = "/root/testdata/sf0.01"

# ---- main text


def test_main_text_of_articles(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    model = html.train(pages)
    got = {r.page_id: r for r in html.extract(pages, model).collect()}
    import html as entities

    for p in pages.collect():
        inside = re.search(r"<article>(.*)</article>", p.html, re.S)[1]
        parts = [" ".join(entities.unescape(re.sub("<[^>]*>", "", x.replace("<br>", "\n"))).split()) for x in re.split(r"</?(?:p|h1)>", inside)]
        assert got[p.page_id].text == "\n\n".join(x for x in parts if x)
        assert got[p.page_id].n_chars == len(got[p.page_id].text)


LAYOUT = """<html><head><title>x</title></head><body class="has-header"><header><h1>Site</h1><nav><a href=x>Home</a></nav></header><div class="cookie-notice">We use cookies. Accept them all please now.</div>
<main><article><h1>Title here</h1><p>First para &lt;of&gt; text,   long enough.</p><aside>Related thing</aside><div class="ad">Buy &amp; now.</div><p>Yes.</p>
<section id="comments"><article class="comment"><p>Nice article, I really liked it a lot.</p></article></section></article></main><form><label>Mail</label></form><footer>&copy; me</footer><script>var a="<p>x</p>"</script></body>"""


def test_other_layouts_and_awkward_pages(spark):
    model = html.train(spark.read.parquet(f"{SF}/pages.parquet"))
    assert html.main_text(LAYOUT, model) == "Title here\n\nFirst para <of> text, long enough.\n\nYes."
    rows = [(1, None, None), (2, "", ""), (3, "u", "<p>"), (4, "u", "<article><p>" + "word " * 50_000 + ".</p></article>"), (5, "u", "<article><button><p>Open to the end.</p>"), (5, "u", "<article><button><p>Open to the end.</p>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash")).withColumn("k0", F.lit(1))
    got = sorted((r.page_id, r.n_chars) for r in html.extract(df, model).collect())
    assert got == [(1, 0), (2, 0), (3, 0), (4, 250_001), (5, 16), (5, 16)]
    assert html.extract(df.limit(0), html.train(df.limit(0))).count() == 0


def test_long_prose_in_a_named_wrapper_is_content(spark):
    model = html.train(spark.read.parquet(f"{SF}/pages.parquet"))
    prose = " ".join(["The committee met again and spoke at length of the old harbour wall, which nobody had repaired in years."] * 4)
    for name in ("content has-sidebar", "legal", "social", "share", "tags", "search", "ad", "header", "copyright"):
        page = f'<body><nav><ul><li><a href=x>Home</a></li><li><a href=y>News</a></li></ul></nav><div class="{name}"><p>{prose}</p><p>{prose}</p></div><footer>&copy; me</footer></body>'
        assert html.main_text(page, model) == f"{prose}\n\n{prose}", name
    menu = '<div class="sidebar"><ul><li><a href=x>Home</a></li><li><a href=y>News</a></li></ul><p>Buy now.</p></div>'
    assert html.main_text(menu, model) == ""


def test_min_cut_is_least(spark):
    import itertools
    import random

    rng = random.Random(1)
    for _ in range(200):
        n = rng.randrange(1, 8)
        unary = [rng.uniform(-3, 3) for _ in range(n)]
        edges = [(rng.randrange(n), rng.randrange(n), rng.uniform(0, 2)) for _ in range(10)]
        energy = lambda lab: sum(-u if x else 0 for u, x in zip(unary, lab, strict=True)) + sum(w for i, j, w in edges if i != j and lab[i] != lab[j])  # noqa: E731, B023
        best = min(map(energy, itertools.product([False, True], repeat=n)))
        assert energy(html.min_cut(unary, edges)) == pytest.approx(best)


# ---- languages


def test_languages_held_out(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    held = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2
    model = langid.train(docs, ~held)
    got = langid.identify(docs, model).join(docs.select("doc_id", "lang", held.alias("held")), "doc_id").filter("held")
    n, right = got.agg(F.count("*"), F.count_if(F.col("lang") == F.col("lang_pred"))).first()
    assert right / n > 0.98
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "123 !?"), (4, "the and of " * 60_000), (4, "the"), (5, "日本語")], "doc_id long, text string").withColumn("lang_pred", F.lit("clash"))
    pred = {(r.doc_id, r.lang_pred) for r in langid.identify(odd, model).collect()}
    assert {(1, "und"), (2, "und"), (3, "und"), (4, "en")} <= pred and len(pred) == 5
    assert {r.lang_pred for r in langid.identify(odd, langid.train(docs.limit(0), F.lit(True))).collect()} == {"und"}


def test_few_long_texts_are_drawn_in_pieces(spark):
    """A language of two texts far beyond the bound is in the model, and a long text neither breaks the bound nor leaves out the short ones."""
    long = ["lorem ipsum dolor " * 20_000, "sit amet elit " * 25_000]
    rows = [(i, t, "la") for i, t in enumerate(long)] + [(9, "zzz " * 50_000, "mixed")] + [(10 + i, f"abc{i} def", "mixed") for i in range(3000)] + [(i, "null ids too " * 2000, "none") for i in (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(docs, F.lit(True), sample_bytes=30_000)
    assert model.languages == ["la", "mixed", "none"]
    odd = spark.createDataFrame([(1, "lorem ipsum amet"), (2, "abc7 def"), (3, "null ids too")], "doc_id long, text string")
    assert [r.lang_pred for r in langid.identify(odd, model).orderBy("doc_id").collect()] == ["la", "mixed", "none"]


def test_code_lengths_are_a_code(spark):
    """After any context the code lengths of all symbols satisfy Kraft's equality, and long texts cut into spans cost what they cost whole."""
    import numpy as np

    docs = spark.createDataFrame([(i, "abcab " * (i + 1) + "xyz", "q") for i in range(5)] + [(9, "bbb ccc", "r")], "doc_id long, text string, lang string")
    model = langid.train(docs, F.lit(True))
    assert np.allclose(np.exp2(-model.bits.astype(float)).sum(1), 1, atol=1e-4)
    text = "abc xyz abcab " * 500
    assert np.allclose(model.code_lengths([text, "b"], span=64), model.code_lengths([text, "b"]), rtol=1e-6)


# ---- personal data

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def brute_spans(t):
    out = []
    for k in pii.KINDS:
        for m in re.finditer(PATTERNS[k], t):
            d = re.sub("[^0-9]", "", m[0])
            if not (k == "ip" and any(int(p) > 255 for p in m[0].split(".")) or k == "card" and not (16 <= len(d) <= 19 and pii.luhn(d)) or k == "phone" and not 8 <= len(d) <= 15):
                out.append((k, *m.span()))
    return out


def test_patterns_equal_plain_matching(spark):
    import random

    rng = random.Random(2)
    for _ in range(4000):
        t = "".join(rng.choice("01234567890123456789+().- -..@@abcZ_%é,") for _ in range(rng.randrange(1, 70)))
        assert pii.base_spans(t) == brute_spans(t)
    for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect():
        assert pii.base_spans(r.text) == brute_spans(r.text)


def test_field_adds_and_keeps(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = pii.train(docs)
    rows = [(1, "call (599) 555-3756 or +1 (599) 555-3756 now"), (2, None), (3, ""), (4, "x " * 100_000 + "a.b@mail.example.com"), (4, "nothing here"), (5, "Version 2.0 of 10 pages")]
    got = {(r.doc_id, r.spans): r for r in pii.detect(spark.createDataFrame(rows, "doc_id long, text string").withColumn("spans", F.lit(1)), model, with_text=True).collect()}
    for (_, spans), r in got.items():
        base = pii.joined(brute_spans(next(t for i, t in rows if i == r.doc_id and (t is None) == (r.redacted is None) and (t or "")[:5] == (r.redacted or "")[:5]) or ""))
        assert set(base.split(",")) <= set(spans.split(",")) | {""}
    assert got[(4, "email:200000:200020")].redacted.endswith("x [EMAIL]")
    assert any(i == 5 and s == "" for i, s in got) and got[(2, "")].redacted is None


def test_field_knows_spellings_and_leaves_the_rest(spark):
    model = pii.train(spark.read.parquet("/root/testdata/sf0.1/documents.parquet"))
    added = lambda t: [(k, t[a:b]) for k, a, b in pii.find(t, model)[1] if (k, a, b) not in brute_spans(t)]
    assert added("write to jo.smith [at] mail.example.com please") == [("email", "jo.smith [at] mail.example.com")]
    assert added("call (843) 555-4223 today") == [("phone", "(843) 555-4223")]
    for t in ("12.05.2024 10:30", "ISBN 978-3-16-148410-0", "300.1.2.3", "order 20240105123456789", "pages 12, 13, 14, 15, 16, 17", "foo@bar", "jo at example.com"):
        assert not [x for x in added(t) if x[0] in ("ip", "email")]


def test_decoding_is_the_best_segmentation(spark):
    """The dynamic programme finds the highest sum over all sets of disjoint candidate segments."""
    import itertools

    model = pii.train(spark.read.parquet(f"{SF}/documents.parquet"))
    for text in ("+1 (599) 555-3756 4111111111111111", "10.0.0.1 192.168.1.77", "4465758382889437 4465758382889437"):
        n, found = model.lattice(text, 0, len(text))
        best = model.scores(found).max(1)
        top = 0.0
        for k in range(4):
            for chosen in itertools.combinations(range(len(found)), k):
                if all(found[a][1] <= found[b][0] or found[b][1] <= found[a][0] for a, b in itertools.combinations(chosen, 2)):
                    top = max(top, sum(best[list(chosen)]))
        cut = pii.tokens(text, 0, len(text))
        spans = {(cut[i][0], cut[j - 1][1]): best[x] for x, (i, j, *_) in enumerate(found)}
        assert sum(spans[a, b] for _, a, b in model.decode(text, 0, len(text), [])) == pytest.approx(top)


# ---- urls


def test_url_rules(spark):
    cases = [("https://www.example.com/en/1", "www.example.com/en/", "allow"), ("https://m.example.com/en/1", "example.com/en/", "block"), ("http://A.COM/x", "com/", "allow"), ("http://a.com", None, "allow"), ("http://x.net/es/", "net/es/", "block"), ("http://x.net/es", None, "allow"), ("http://examplenet/es/", None, "allow"), (None, None, "allow"), ("no url", None, "allow"), ("http://x.net?u=/es/", None, "allow"), ("ftp://x.net/fr/a#b", "net/fr/", "block")]
    df = spark.createDataFrame([(i, u) for i, (u, _, _) in enumerate(cases)], "page_id long, url string").withColumn("host", F.lit("clash"))
    got = {r.page_id: (r.rule, r.verdict) for r in urls.filter_urls(df, URL_RULES).collect()}
    assert [got[i] for i in range(len(cases))] == [(r, v) for _, r, v in cases]
    assert urls.filter_urls(df.limit(0), URL_RULES).count() == 0


def test_trie_equals_scanning_all_rules():
    import random

    rng = random.Random(4)
    hosts, paths = ["a", "b.a", "c.b.a", "x.a", "b"], ["/", "/p", "/p/", "/p/q", "/q/"]
    rules = [urls.Rule(rng.choice(["allow", "block"]), h, p) for h in hosts for p in paths if rng.random() < 0.5]
    trie = urls.build_trie(rules)
    for host in [*hosts, "z.c.b.a", "q", ""]:
        for path in ["", "/", "/p", "/pp", "/p/", "/p/qq", "/q", "/q/z"]:
            fit = [r for r in rules if ("." + host).endswith("." + r.host) and path.startswith(r.path)]
            want = max(fit, key=lambda r: (len(r.host), len(r.path)), default=None)
            assert urls.match(trie, host, path) == (want and (want.name, want.verdict))


# ---- quality


def test_a_rare_class_is_drawn(spark):
    """Three bad documents among 3,000 reach a fit on about 20."""
    rows = [(i, f"a good text of word{i % 50} and more", 1) for i in range(3000)] + [(5000 + i, "!!! ??? buy $$$ now", 0) for i in range(3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    assert quality.train(df.drop("quality"), df.drop("text"), F.lit(True), max_docs=20) is not None
    assert quality.train(df.drop("quality"), df.drop("text").filter("quality = 1"), F.lit(True)) is None


def test_quality_held_out(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    held = F.pmod(F.crc32(F.col("i").cast("string").cast("binary")), F.lit(5)) == 0
    model = quality.train(docs, labels, ~held)
    got = quality.score_quality(docs, model).join(labels, "doc_id").collect()
    out = [r for r in got if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert sum((r.score >= 0.3) == (r.quality == 1) for r in out) / len(out) > 0.97
    odd = spark.createDataFrame([(1, None), (2, ""), (3, " "), (4, "word " * 200_000), (4, "***")], "doc_id long, text string").withColumn("score", F.lit(9)).withColumn("k0", F.lit(9))
    scores = quality.score_quality(odd, model).collect()
    assert len(scores) == 5 and all(0 <= r.score <= 1 for r in scores)
    assert {r.score for r in quality.score_quality(odd, quality.train(docs, labels.limit(0), F.lit(True))).collect()} == {1.0}


# ---- token counts


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"])
def test_counts_are_the_librarys(spark, tmp_path, name):
    path, cache = public_tokenizers.path(name), str(tmp_path / "cache")
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()] + [None, "", " \n\t", "a<|endoftext|>b c", "x́  y\x1cz\x85w", "it's I'LL", "a" * 5000, texts_repeat := "same same", texts_repeat]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("digest", F.lit("clash")).withColumn("n_bytes", F.lit(0))
    got = {r.doc_id: r for r in tokens.token_counts(df, path, cache).collect()}
    model = tokens.Encoder(path)
    for i, t in enumerate(texts):
        assert got[i].n_tokens == model.whole([t or ""])[0] and got[i].n_bytes == len((t or "").encode())
    before = spark.read.parquet(cache).count()
    assert before == len({t or "" for t in texts})
    tokens.token_counts(df.unionByName(df.limit(1).withColumn("text", F.lit("fresh one"))), path, cache).count()
    assert spark.read.parquet(cache).count() == before + 1
    assert tokens.token_counts(df.limit(0), path, str(tmp_path / "none")).count() == 0
