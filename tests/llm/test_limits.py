"""Main text by the cut, long texts, empty tables and clashing names: small pages, texts and tables."""

import random
import time
from itertools import product

import corpus_pipeline
from docloom.llm import embeddings, html, langid, pii, quality, tokens
from docloom.llm.quality import NbSvm

SF = "/root/testdata/sf0.001"
PROSE = "The council met on Tuesday to discuss the new plan for the river, and most members agreed that it should go on. "


def model(spark):
    return html.train(spark.read.parquet(f"{SF}/pages.parquet"))


def test_names_that_describe_and_wrappers_keep_the_article(spark):
    m = model(spark)
    text = lambda page: html.main_text(page, m).split("\n\n")
    p = PROSE.strip()
    assert text(f'<body><div class="content has-sidebar"><p>{p}</p><p>{p}</p></div></body>') == [p, p]
    assert text(f'<body><article class="post type-post tag-promotion"><p>{p}</p></article></body>') == [p]
    assert text(f'<body><article><p>{p}</p><div class="story-related-body"><p>{p}</p></div></article><footer>(c) us</footer></body>') == [p, p]
    assert text(f'<body><form id="aspnet"><h1>Head of it</h1><p>{PROSE * 3}</p></form></body>')[-1] == (PROSE * 3).strip()
    assert text(f'<body><article><p>{p}</p></article><section class="comments"><p>{PROSE * 2}</p><p>{p}</p></section></body>') == [p]
    assert text(f'<body><main><p>{PROSE * 3}</p></main><aside class="related"><article><h3>Other</h3><p>Teaser.</p></article></aside></body>') == [(PROSE * 3).strip()]
    assert text("<body><article><p title=it\"s>hello there my friends.</p><p data-x=don't>hello again my friends.</p></article></body>") == ["hello there my friends.", "hello again my friends."]
    assert text("<body><article><p>I like <math>x+y</math> sums and <svg><text>art</text></svg>.</p></article></body>") == ["I like x+y sums and art."]
    assert text("<body><nav><a href=1>x</a></nav><footer>Copyright by us all, some words here.</footer></body>") == [""]


def test_the_cut_overturns_a_block_s_own_cost(spark):
    m = model(spark)
    page = f"<body><div><a href=1>Home</a> <a href=2>News</a></div><div><div>{PROSE}</div><div>And so it went.</div><div>Yes</div><div>{PROSE}</div></div></body>"
    blocks, unary, label = html.judged(page, m)
    at = [b.text for b in blocks].index("Yes")
    assert unary[at] < 0 and label[at] and html.cut_text(page, m)[1] >= 1


def test_no_group_of_features_outweighs_all_others():
    most = {g: max(abs(a), abs(b)) for g, (a, b) in html.BOUNDS.items()} | {"place": max(map(abs, html.PLACE.values()))}
    for group, x in most.items():
        assert x < sum(y for g, y in most.items() if g != group) + 2 * html.ADJACENT


def test_the_place_is_not_counted_from_its_own_label(spark):
    m = model(spark)
    assert m.odds and not any(f.startswith("place") for f in m.odds) and all(a <= 50 * b and b <= 50 * a for a, b in html.PRIOR.values())
    # looks outweigh a name: of two lists in an article, the one of bare links goes by the cut's costs although it stands where the other does
    p = PROSE.strip()
    links = "".join(f"<li><a href={i}>more</a></li>" for i in range(9))
    blocks, unary, _ = html.judged(f"<body><article><p>{p}</p><ul>{links}</ul><ul><li>{p}</li></ul></article></body>", m)
    assert {b.cue for b in blocks} == {"article"} and unary[1] < 0.5 < unary[0] and unary[-1] > 2


def test_boilerplate_longer_than_the_article_stays_out(spark):
    m, p = model(spark), PROSE.strip()
    for part in ('<div class="sidebar">{}</div>', "<aside>{}</aside>", '<section id="comments">{}</section>', '<div class="cookie-notice">{}</div>', "<footer>{}</footer>", '<div class="promo"><h3>Buy</h3>{}</div>'):
        for n in (1, 3, 9):
            other = part.format(f"<p>{p}</p>" * n)
            for page in (f"<body><article><p>{p}</p></article>{other}</body>", f"<body>{other}<main><h1>Of rivers</h1><p>{p}</p></main></body>"):
                got = html.main_text(page, m).split("\n\n")
                assert [x for x in got if x != "Of rivers"] == [p], (part, n)


def test_a_page_without_names_keeps_a_lone_paragraph(spark):
    assert html.main_text("<p title=it\"s>hello", model(spark)) == "hello"
    assert html.main_text("<ul><li><a href=1>Home</a></li><li><a href=2>News</a></li></ul>", model(spark)) == ""


def test_min_cut_equals_brute_force():
    rng = random.Random(4)
    for _ in range(150):
        n = rng.randrange(1, 9)
        unary = [rng.uniform(-2, 2) for _ in range(n)]
        edges = [(i, j, rng.uniform(0, 1.5)) for i in range(n) for j in range(i) if rng.random() < 0.4]
        cost = lambda label: sum(max(0, u) if not k else max(0, -u) for u, k in zip(unary, label, strict=True)) + sum(w for i, j, w in edges if label[i] != label[j])
        assert abs(cost(html.min_cut(unary, edges)) - min(map(cost, product([False, True], repeat=n)))) < 1e-9


def test_markup_without_ends_takes_time_in_proportion():
    began = time.time()
    for page in ('<a b="x ' * 20_000, "<noscript>x " * 20_000, "<div>a b c d</div>" * 5_000, "<" * 100_000, "<a " + "b " * 100_000):
        html.main_text(page, html.BlockModel())
    assert time.time() - began < 15


def test_personal_data_in_long_texts_takes_time_in_proportion():
    m = pii.SemiCrf()
    began = time.time()
    assert pii.find("a" * 2_000_000, m) == ([], [])
    assert pii.find("7" * 1_000_000, m) == ([], [])
    base, every = pii.find("user.name@example.com, " * 20_000, m)
    assert len(base) == len(every) == 20_000 and time.time() - began < 15


def test_the_field_s_gradient_points_uphill():
    text = "call 555 123-4567 now"
    example = (text, 5, 17, [("phone", 5, 17)])

    def chance(crf):
        cut = pii.tokens(text, 5, 17)
        found = crf.lattice(text, 5, 17)[1]
        s = crf.scores(found)

        def walk(i):  # sum over all segmentations from token i on
            if i == len(cut):
                return 1.0
            return walk(i + 1) + sum(float(e) * walk(found[x][1]) for x in range(len(found)) if found[x][0] == i for e in 2.718281828459045 ** s[x])

        gold = next(x for x, f in enumerate(found) if f[0] == 0 and f[1] == len(cut))
        return float(2.718281828459045 ** s[gold][pii.KINDS.index("phone")]) / walk(0)

    before, after = chance(pii.SemiCrf()), chance(pii.SemiCrf().fit([example], epochs=3))
    assert after > before and after > 0.5


def test_empty_tables_and_clashing_columns(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, score double, spans string, k0 int, id int")
    assert langid.identify(docs, None).count() == 0 and pii.detect(docs, None).count() == 0
    assert quality.score_quality(docs, NbSvm(__import__("numpy").zeros(quality.PLACES), 0.0)).count() == 0
    some = spark.createDataFrame([(1, None, "x", 0.5, "s", 3, 4), (1, "mail a@b.co", "x", 0.5, "s", 3, 4), (1, "mail a@b.co", "x", 0.5, "s", 3, 4)], docs.schema)
    assert sorted((r.n_email, r.spans) for r in pii.detect(some, None).collect()) == [(0, ""), (1, "email:5:11"), (1, "email:5:11")]
    assert [r.lang_pred for r in langid.identify(some, None).collect()] == ["und"] * 3
    assert quality.score_quality(some, None).count() == 3


def test_stages_on_empty_tables_and_on_columns_of_their_own(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumns({c: docs_col for c, docs_col in (("copy", __import__("pyspark.sql.functions", fromlist=["lit"]).lit(1)), ("mix_copy", __import__("pyspark.sql.functions", fromlist=["lit"]).lit(2)))})
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs.limit(0), SF)
        assert out.count() == 0 and (out.columns == docs.columns or name == "source_mix")
    mixed = corpus_pipeline.mixing_stage(spark, docs, SF)
    assert mixed.columns == [*docs.columns, "mix_mix_copy"] and mixed.count() > 0


def test_digests_that_many_rows_share(spark, tmp_path, monkeypatch):
    import public_tokenizers

    monkeypatch.setattr(tokens, "HOT_LEAST", 3)
    docs = spark.createDataFrame([(i, "same text") for i in range(9)] + [(9, "other"), (10, None)], "doc_id long, text string")
    got = {r.doc_id: r.n_tokens for r in tokens.token_counts(docs, public_tokenizers.path("word_bpe_49k.json"), str(tmp_path / "cache")).collect()}
    assert len(got) == 11 and len({got[i] for i in range(9)}) == 1 and got[10] == 0


def test_slim_rows_of_embeddings_are_small(spark):
    import numpy as np

    x = np.random.default_rng(1).standard_normal((300, 32))
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "row long, v array<double>")
    p = embeddings.ProjectionParams()
    plan = p.plan(50_000)
    code = embeddings._cells(df, plan, p).first().code
    assert len(code) == -(-plan.planes * plan.tables // 8) + p.projections < 64


def test_dotted_numbers_equal_the_plain_pattern_and_take_time_in_proportion():
    import re

    plain = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
    rng = random.Random(9)
    for _ in range(20_000):
        text = "".join(rng.choices("019.25+ x", [5, 4, 3, 9, 3, 2, 1, 1, 1], k=rng.randrange(7, 40)))
        want = [("ip", *m.span()) for m in plain.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
        assert [s for s in pii.base_spans(text) if s[0] == "ip"] == want, text
    began = time.time()
    for text in ("1" * 2_000_000 + "...", "1." * 1_000_000, "a@" + "b-" * 1_000_000):
        pii.base_spans(text)
    assert time.time() - began < 15


def test_columns_named_like_those_of_the_operator_pass_through(spark):
    text = "one two three four five six seven eight nine ten eleven twelve"
    rows = [(1, text, "A", "a", 1.5), (1, "quite another text that has nothing to do with the first one at all", "B", "b", 2.5), (None, text, "C", "c", 3.5), (2, "a third text of several words which nobody else has written so far here", "D", "d", 4.5)]
    for given in (rows, [r for r in rows if r[0] is not None][1:]):
        docs = spark.createDataFrame(given, "doc_id long, text string, row_ string, id string, rest double")
        out = corpus_pipeline.near_duplicate_stage(spark, docs, SF)
        assert out.columns == docs.columns and dict(out.dtypes) == dict(docs.dtypes)
        got = {r.row_: (r.doc_id, r.text, r.id, r.rest) for r in out.collect()}
        assert all(got[r[2]] == (r[0], r[1], r[3], r[4]) for r in given if r[2] in got) and len(got) == len(given) - (len(given) == 4)
