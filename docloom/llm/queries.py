"""The thin queries of this subpackage: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, divergence, embeddings, html, importance, langid, minhash, mixing, pii, quality, sharding, tokens, urls
from .common import shared_dir


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _fold(modulus: int, col: str = "doc_id"):
    """crc32 of the id as text, modulo."""
    return F.pmod(F.crc32(F.col(col).cast("string").cast("binary")), F.lit(modulus))


def op1_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _read(spark, sf_dir, "pages")
    return html.extract(pages, html.train(pages))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    model = langid.train(docs, _fold(4) != 2)
    return langid.identify(docs, model).select("doc_id", (_fold(4) == 2).alias("held_out"), "lang_pred", "score")


def op3_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(_read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies", "rate")


def op4_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    return pii.detect(docs, pii.train(docs))


URL_RULES = (urls.Rule("allow", "com"), urls.Rule("block", "example.com", "/en/"), urls.Rule("allow", "www.example.com", "/en/"), urls.Rule("block", "net", "/es/"), urls.Rule("block", "net", "/fr/"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.filter_urls(_read(spark, sf_dir, "pages"), URL_RULES)


#: Host and path by pattern, then the longest rule by a CASE in the order of length.
OP5_SQL = r"""
WITH split AS (
  SELECT page_id, translate(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's') AS path
  FROM pages),
clean AS (SELECT page_id, coalesce(host, '') AS host, coalesce(path, '') AS path FROM split),
ruled AS (
  SELECT page_id, host, path, CASE
    WHEN ('.' || host) LIKE '%.www.example.com' AND path LIKE '/en/%' THEN 'www.example.com/en/'
    WHEN ('.' || host) LIKE '%.example.com' AND path LIKE '/en/%' THEN 'example.com/en/'
    WHEN ('.' || host) LIKE '%.net' AND path LIKE '/es/%' THEN 'net/es/'
    WHEN ('.' || host) LIKE '%.net' AND path LIKE '/fr/%' THEN 'net/fr/'
    WHEN ('.' || host) LIKE '%.com' AND path LIKE '/%' THEN 'com/' END AS rule
  FROM clean)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('example.com/en/', 'net/es/', 'net/fr/') THEN 'block' ELSE 'allow' END AS verdict FROM ruled
"""

def op6_embedding_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_embeddings(_read(spark, sf_dir, "embeddings"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.decontaminate(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


#: All windows of both sides as text, joined; words inside hits counted one by one.
OP7_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bi AS (SELECT item_id, w, least(13, len(w)) AS k, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM b WHERE len(w) > 0),
bw AS (SELECT DISTINCT item_id, k, array_to_string(list_slice(w, i, i + k - 1), ' ') AS s FROM bi),
ks AS (SELECT DISTINCT k FROM bw),
di AS (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, ks WHERE len(w) >= k),
dw AS (SELECT doc_id, k, i, array_to_string(list_slice(w, i, i + k - 1), ' ') AS s FROM di),
hits AS (SELECT dw.doc_id, dw.k, dw.i, bw.item_id FROM dw JOIN bw ON dw.k = bw.k AND dw.s = bw.s),
places AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + k)) AS p FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS items_sha256 FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hits) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN places ON places.doc_id = d.doc_id LEFT JOIN items ON items.doc_id = d.doc_id
"""

#: Documents with this score or more are kept.
QUALITY_LINE = 0.3


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    model = quality.train(docs, _read(spark, sf_dir, "labels"), _fold(5, "i") != 0)
    return quality.score_quality(docs, model).select("doc_id", (_fold(5) == 0).alias("held_out"), "score", F.when(F.col("score") >= QUALITY_LINE, 1).otherwise(0).alias("predicted"))


TOKENIZER, TOKEN_LIMIT = "word_bpe_49k.json", 2048


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    cache = f"{shared_dir(spark).rstrip('/')}/token-cache-{uuid.uuid4().hex}"
    counted = tokens.token_counts(_read(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER), cache)
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > TOKEN_LIMIT).alias("over_limit"))


#: A family of near copies has one vote in the document frequencies.
NEAR_COPIES = minhash.NearDupParams(votes="families")


def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_read(spark, sf_dir, "documents"), NEAR_COPIES)


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(_read(spark, sf_dir, "documents"))


#: Every kept term against every source of its language, in 128-bit whole numbers.
OP11_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS row_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
o AS (SELECT row_id, lang, source, unnest(w) AS term FROM d),
per AS (SELECT lang, source, term, count(*)::HUGEINT AS n, count(DISTINCT row_id) AS docs FROM o GROUP BY ALL),
kept AS (SELECT lang, term, sum(n)::HUGEINT AS n FROM per GROUP BY lang, term HAVING sum(docs) >= 10),
v AS (SELECT lang, count(*)::HUGEINT AS v, sum(n)::HUGEINT AS n FROM kept GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
gn AS (SELECT g.lang, g.source, coalesce(sum(CASE WHEN kept.term IS NOT NULL THEN per.n END), 0)::HUGEINT AS n FROM g LEFT JOIN per ON per.lang = g.lang AND per.source = g.source LEFT JOIN kept ON kept.lang = per.lang AND kept.term = per.term GROUP BY ALL),
p AS (SELECT gn.lang, gn.source, kept.term, coalesce(per.n, 0) AS c, 1 + (1000000000::HUGEINT * (coalesce(per.n, 0) + 2)) // (gn.n + 2 * v.v) AS p, 1 + (1000000000::HUGEINT * (kept.n + 2)) // (v.n + 2 * v.v) AS q
      FROM gn JOIN v ON v.lang = gn.lang JOIN kept ON kept.lang = gn.lang LEFT JOIN per ON per.lang = gn.lang AND per.source = gn.source AND per.term = kept.term),
pairs AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p))::BIGINT AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
found AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(pairs.value, 0)::BIGINT AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pairs ON pairs.lang = a.lang AND pairs.source = a.source AND pairs.item = b.source
  UNION ALL SELECT lang, source, 'term', term, ((p - q) * (p - q) // (p + q))::BIGINT FROM p WHERE c > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item))::INTEGER AS rank FROM found)
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 10
"""

SHARDS = 40


def op12_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    dealt = sharding.shard(_read(spark, sf_dir, "documents"), shards=SHARDS)
    return dealt.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


#: Features counted word by word; the CRC of each distinct one byte by byte from the polynomial.
OP13_SQL = r"""
WITH RECURSIVE steps AS (SELECT i::BIGINT AS i, i::BIGINT AS c, 0 AS k FROM range(256) t(i) UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END, k + 1 FROM steps WHERE k < 8),
crc AS (SELECT list(c ORDER BY i) AS low FROM steps WHERE k = 8),
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
df AS (SELECT doc_id, x, count(*) AS n FROM (SELECT doc_id, unnest(w) AS x FROM d) GROUP BY ALL),
bf AS (SELECT x, count(*) AS n FROM (SELECT unnest(w) AS x FROM b) GROUP BY ALL),
f AS (SELECT x, sum(s)::BIGINT AS s, sum(t)::BIGINT AS t, hex(encode(x)) AS h FROM (SELECT x, n AS s, 0 AS t FROM df UNION ALL SELECT x, 0, n FROM bf) GROUP BY x),
hashed AS (SELECT x, s, t, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(0, length(h) // 2), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT)), lambda a, y: xor(crc.low[(xor(a, y) & 255) + 1], a >> 8))) % 10000 AS bucket FROM f, crc),
buckets AS (SELECT bucket, sum(s)::BIGINT AS s, sum(t)::BIGINT AS t FROM hashed GROUP BY bucket),
whole AS (SELECT coalesce(sum(s), 0)::BIGINT AS s, coalesce(sum(t), 0)::BIGINT AS t FROM buckets),
gains AS (SELECT bucket, floor(1000 * ln((k.t + 1)::DOUBLE * (whole.s + 10000)::DOUBLE / ((k.s + 1)::DOUBLE * (whole.t + 10000)::DOUBLE)))::BIGINT AS gain FROM buckets k, whole),
w AS (SELECT doc_id, floor(sum(n * gain)::DOUBLE / sum(n))::BIGINT AS weight FROM df JOIN hashed USING (x) JOIN gains USING (bucket) GROUP BY doc_id),
scored AS (SELECT doc_id, len(d.w)::BIGINT AS n_features, coalesce(weight, 0) AS weight,
             coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score FROM d LEFT JOIN w USING (doc_id)),
drawn AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS n FROM scored WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= 10 * n // 100 THEN rank END AS rank FROM scored LEFT JOIN drawn USING (doc_id)
"""


def queries() -> dict:
    return {f.__name__: f for f in (op1_main_text, op2_language_id, op3_source_mix, op4_personal_data, op5_url_filter, op6_embedding_duplicates, op7_decontamination, op8_quality, op9_token_counts, op10_near_duplicates, op11_source_divergence, op12_shards, op13_importance_resampling)}


def oracle_sql() -> dict[str, str]:
    return {"op5_url_filter": OP5_SQL, "op7_decontamination": OP7_SQL, "op11_source_divergence": OP11_SQL, "op13_importance_resampling": OP13_SQL}
