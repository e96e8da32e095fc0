"""Named queries on the test tables, one for each operator or small group of operators, with the same result in SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.functions import normal, scores, text, validators
from docloom.operators import clauses, edit_chain, keyed, mining, observe, quality_gate, record, review, review_projection, state, view, visit_chart, visits, web_addresses
from docloom.sources.files import object_payload, read_raw_texts, split_uploads, table, write_raw_texts
from docloom.sources.scratch import shared_dir, written
from docloom.streaming import merge

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str = ""):
    """Register a query under its function's name, with the SQL that gives the same rows."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _micros(col: str):
    """Microseconds since 1970 of a timestamp without time zone, whatever the session's zone."""
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', {col})")


def _seconds(col: str):
    return F.floor(_micros(col) / 1000000)


# ---- quality of texts

_GATE = r"""
WITH a AS (SELECT doc_id, lang, coalesce(text, '') AS x, trim(regexp_replace(coalesce(text, ''), '[\t-\r\x1c-\x20\x{85}\p{Z}]+', ' ', 'g'), ' ') AS n FROM documents),
b AS (SELECT *, ' ' || regexp_replace(n, '[^\p{L}\p{N}_]+', '  ', 'g') || ' ' AS w, length(n) AS size FROM a),
c AS (SELECT *, length(regexp_replace(n, '[^\p{L}]', '', 'g')) AS letters, length(regexp_replace(n, '[^ ]', '', 'g')) AS blank, length(regexp_replace(n, '[^\p{L}\p{N}]', '', 'g')) AS alnum,
  length(regexp_replace(n, '[^\p{C}]', '', 'g')) AS hidden, length(regexp_replace(n, '[\p{L}\p{N} .,;:!?()\[\]{}''"\-_/\\%&+*#@]', '', 'g')) AS strange, len(regexp_extract_all(n, '[A-Za-zÀ-ÿ]{3,}')) AS words,
  length(regexp_replace(n, '[^aeiouáéíóúüAEIOUÁÉÍÓÚÜ]', '', 'g')) AS vowels, length(regexp_replace(n, '[^\p{Lu}]', '', 'g')) AS capitals, length(regexp_replace(x, '[^\t-\r\x1c-\x20\x{85}\p{Z}]', '', 'g')) AS spaces,
  length(regexp_replace(x, '[^\n]', '', 'g')) AS breaks, len(regexp_extract_all(w, '[\p{N}_]*\p{L}[\p{L}\p{N}_]*')) AS tokens, len(regexp_extract_all(w, '[\p{L}\p{N}_]{12,}')) - len(regexp_extract_all(w, ' [\p{N}_]{12,} ')) AS long,
  len(regexp_extract_all(w, ' \p{L} ')) AS single, regexp_matches(lower(n), 'dratamiento|draquea|diene') AS suspect FROM b),
d AS (SELECT *, CASE WHEN size < 20 THEN 'TOO_SHORT' WHEN (size - hidden) / size < 0.9 OR letters = 0 OR letters / size < 0.35 OR strange / size >= 0.15 THEN 'NOT_HUMAN_READABLE' WHEN words < 3 THEN 'TOO_FEW_WORDS' END AS early,
  CASE WHEN vowels / greatest(1, letters) < 0.30 THEN 'LOW_VOWEL_RATIO' END AS r1, CASE WHEN (size - alnum - blank) / greatest(1, size) > 0.25 THEN 'HIGH_PUNCTUATION_RATIO' END AS r2,
  CASE WHEN spaces / greatest(1, length(x)) < 0.10 THEN 'LOW_WHITESPACE_STRUCTURE' END AS r3, CASE WHEN breaks / greatest(1, length(x)) < 0.0005 AND size > 800 THEN 'LOW_LINEBREAK_STRUCTURE' END AS r4,
  CASE WHEN long / greatest(1, tokens) > 0.20 AND tokens >= 80 THEN 'EXCESS_LONG_TOKENS' END AS r5, CASE WHEN single / greatest(1, tokens) > 0.045 AND tokens > 120 THEN 'EXCESS_SINGLE_LETTER_TOKENS' END AS r6,
  CASE WHEN capitals / greatest(1, letters) > 0.80 AND tokens < 250 THEN 'SUSPICIOUS_ALL_CAPS_DENSITY' END AS r7, CASE WHEN suspect THEN 'SUSPICIOUS_SUBSTITUTIONS' END AS r8 FROM c),
e AS (SELECT doc_id, lang, early, suspect, 1.0::DOUBLE - CASE WHEN r1 IS NULL THEN 0.0::DOUBLE ELSE 0.20::DOUBLE END - CASE WHEN r2 IS NULL THEN 0.0::DOUBLE ELSE 0.25::DOUBLE END - CASE WHEN r3 IS NULL THEN 0.0::DOUBLE ELSE 0.20::DOUBLE END
  - CASE WHEN r4 IS NULL THEN 0.0::DOUBLE ELSE 0.10::DOUBLE END - CASE WHEN r5 IS NULL THEN 0.0::DOUBLE ELSE 0.35::DOUBLE END - CASE WHEN r6 IS NULL THEN 0.0::DOUBLE ELSE 0.35::DOUBLE END
  - CASE WHEN r7 IS NULL THEN 0.0::DOUBLE ELSE 0.20::DOUBLE END - CASE WHEN r8 IS NULL THEN 0.0::DOUBLE ELSE 0.40::DOUBLE END AS score, concat_ws(',', r1, r2, r3, r4, r5, r6, r7, r8) AS reasons FROM d),
gate AS (SELECT doc_id, lang, CASE WHEN early IS NULL THEN score ELSE 0.0::DOUBLE END AS score, early IS NULL AND score >= 0.60::DOUBLE AND NOT suspect AS quality_pass, coalesce(early, reasons) AS reasons FROM e)
"""


@query(_GATE + "SELECT doc_id, round(score, 6) AS score, quality_pass, reasons FROM gate")
def quality_gate_docs(spark, d):
    return quality_gate.assess(table(spark, d, "documents")).withColumn("score", F.round("score", 6))


@query(_GATE + "SELECT lang, count(*) AS n, count(*) FILTER (quality_pass) AS passed, round(avg(score), 4) AS mean_score, max(l.quality) AS best_label FROM gate LEFT JOIN labels l USING (doc_id) GROUP BY lang")
def quality_report(spark, d):
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels").select("doc_id", "quality")
    joined = quality_gate.assess(docs, keep=("lang",)).join(labels, "doc_id", "left")
    return joined.groupBy("lang").agg(F.count("*").alias("n"), F.count_if("quality_pass").alias("passed"), F.round(F.avg("score"), 4).alias("mean_score"), F.max("quality").alias("best_label"))


# ---- runs and states: users stand for documents, events for their runs

_STATES = {"signup": "QUEUED", "view": "RUNNING", "click": "COMPLETED", "purchase": "COMPLETED", "error": "FAILED"}
_STATE_SQL = "CASE event_type WHEN 'signup' THEN 'QUEUED' WHEN 'view' THEN 'RUNNING' WHEN 'error' THEN 'FAILED' ELSE 'COMPLETED' END"


def _runs(spark, d, kinds=tuple(_STATES)):
    e = table(spark, d, "events").filter(F.col("event_type").isin(*kinds))
    st = F.create_map(*(F.lit(x) for p in _STATES.items() for x in p))[F.col("event_type")]
    return e.select(F.col("user_id").alias("document_id"), F.col("event_id").alias("run_id"), F.col("ts").alias("created_at"), st.alias("state"), F.when(F.col("event_type") == "error", F.when(F.col("event_id") % 2 == 0, "EXTRACTION_FAILED").otherwise("odd")).alias("failure_type"), "value")


@query("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def latest_event_per_user(spark, d):
    return keyed.latest(table(spark, d, "events").select("user_id", "event_id", "event_type", "ts"), ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "event_type")


@query(f"""WITH r AS (SELECT user_id, event_id, {_STATE_SQL} AS state, CASE WHEN event_type = 'error' THEN CASE WHEN event_id % 2 = 0 THEN 'EXTRACTION_FAILED' ELSE 'UNKNOWN_ERROR' END END AS failure, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events),
s AS (SELECT c_custkey AS document_id, CASE WHEN state IS NULL THEN 'UPLOADED' WHEN state IN ('QUEUED', 'RUNNING') THEN 'PROCESSING' ELSE state END AS status, failure FROM customer LEFT JOIN (SELECT * FROM r WHERE n = 1) ON user_id = c_custkey)
SELECT document_id, status, CASE status WHEN 'UPLOADED' THEN 'Uploaded' WHEN 'PROCESSING' THEN 'Processing' WHEN 'COMPLETED' THEN 'Ready for review' WHEN 'FAILED' THEN 'Failed' END AS label, failure AS failure_type,
CASE WHEN status = 'FAILED' THEN 'error' WHEN document_id % 3 = 0 THEN 'reviewed' WHEN status = 'COMPLETED' THEN 'completed' ELSE 'processing' END AS cluster FROM s""")
def document_status(spark, d):
    docs = table(spark, d, "customer").select(F.col("c_custkey").alias("document_id"))
    s = state.documents_with_status(docs, _runs(spark, d))
    return s.select("document_id", "status", "label", "failure_type", state.status_cluster(F.col("status"), F.when(F.col("document_id") % 3 == 0, "REVIEWED").otherwise("IN_REVIEW")).alias("cluster"))


@query("SELECT event_type AS status, count(*) AS n, count(DISTINCT user_id) AS users, count(*) FILTER (value > 50) AS large FROM events GROUP BY event_type")
def status_rollup(spark, d):
    return observe.rollup(table(spark, d, "events").withColumnRenamed("event_type", "status"), "status", "user_id", F.col("value") > 50)


@query("SELECT DISTINCT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM events WHERE user_id = c_custkey AND event_type = 'error')")
def users_without_error(spark, d):
    bad = table(spark, d, "events").filter("event_type = 'error'").select(F.col("user_id").alias("c_custkey"))
    return keyed.without(table(spark, d, "customer").select("c_custkey"), bad, ["c_custkey"])


@query("""WITH q AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events WHERE event_type = 'view' AND user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'signup' AND value > 200))
SELECT user_id AS document_id, event_id AS run_id FROM q WHERE k = 1 ORDER BY ts, event_id LIMIT 10""")
def queue_head(spark, d):
    """Views are queued runs, signups of a large value going ones, which block some users and not others."""
    e = table(spark, d, "events")
    of = F.when(F.col("event_type") == "view", "QUEUED").when((F.col("event_type") == "signup") & (F.col("value") > 200), "RUNNING")
    runs = e.select(F.col("user_id").alias("document_id"), F.col("event_id").alias("run_id"), F.col("ts").alias("created_at"), of.alias("state")).filter("state is not null")
    return state.startable(runs).select("document_id", "run_id")


@query(f"SELECT event_id AS run_id, CASE WHEN {_STATE_SQL} = 'RUNNING' THEN 'FAILED' ELSE {_STATE_SQL} END AS state, CASE WHEN {_STATE_SQL} = 'RUNNING' THEN 'PROCESS_TERMINATED' WHEN event_type = 'error' THEN CASE WHEN event_id % 2 = 0 THEN 'EXTRACTION_FAILED' ELSE 'odd' END END AS failure_type FROM events")
def orphan_recovery(spark, d):
    return state.recover_orphans(_runs(spark, d)).select("run_id", "state", "failure_type")


@query("""WITH s AS (SELECT user_id AS run_id, event_type AS step, 1 + event_id % 2 AS attempt, ts AS a, ts + INTERVAL 5 SECOND AS b, CASE WHEN value > 90 THEN 'FAILED' WHEN value < 2 THEN 'RUNNING' ELSE 'SUCCEEDED' END AS status FROM events)
SELECT run_id, step, attempt, epoch(min(a))::BIGINT AS started, CASE WHEN bool_or(status = 'RUNNING') AND NOT bool_or(status = 'FAILED') THEN NULL ELSE epoch(max(b))::BIGINT END AS ended, CASE WHEN bool_or(status = 'FAILED') THEN 'FAILED' WHEN bool_or(status = 'RUNNING') THEN 'RUNNING' ELSE 'SUCCEEDED' END AS status FROM s GROUP BY ALL""".replace("GROUP BY ALL", "GROUP BY run_id, step, attempt").replace("epoch(min(a))::BIGINT", "floor(epoch(min(a)))::BIGINT").replace("epoch(max(b))::BIGINT", "floor(epoch(max(b)))::BIGINT"))
def step_groups(spark, d):
    e = table(spark, d, "events")
    steps = e.select(F.col("user_id").alias("run_id"), F.col("event_type").alias("step"), (1 + F.col("event_id") % 2).alias("attempt"), F.col("ts").alias("started_at"), (F.col("ts") + F.expr("INTERVAL 5 SECOND")).alias("ended_at"), F.when(F.col("value") > 90, "FAILED").when(F.col("value") < 2, "RUNNING").otherwise("SUCCEEDED").alias("status"))
    g = state.step_groups(steps)
    return g.select("run_id", "step", "attempt", _seconds("started_at").alias("started"), _seconds("ended_at").alias("ended"), "status")


@query(f"SELECT user_id, count(*) AS n, string_agg(event_id::VARCHAR || ':' || {_STATE_SQL} || CASE WHEN event_id % 2 = 0 THEN ':a,b' ELSE ':' END, ' ' ORDER BY ts, event_id) AS runs FROM events WHERE event_type IN ('error', 'purchase') GROUP BY user_id")
def run_history(spark, d):
    e = table(spark, d, "events").filter(F.col("event_type").isin("error", "purchase") & (F.col("event_id") % 2 == 0))
    steps = e.select(F.col("event_id").alias("run_id"), F.explode(F.array(F.struct(F.lit("b").alias("step"), F.lit(2).alias("started_at")), F.struct(F.lit("a").alias("step"), F.lit(1).alias("started_at")))).alias("s")).select("run_id", "s.*")
    h = state.run_history(_runs(spark, d, ("error", "purchase")), steps)
    shown = F.array_join(F.transform("runs", lambda r: F.concat(r["run_id"].cast("string"), F.lit(":"), r["state"], F.lit(":"), F.array_join(r["steps"], ","))), " ")
    return h.select(F.col("document_id").alias("user_id"), "n", shown.alias("runs"))


@query("SELECT o_orderkey, c_name, o_orderstatus FROM orders JOIN customer ON o_custkey = c_custkey ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 50 OFFSET 50")
def page_list(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate")
    joined = o.join(table(spark, d, "customer").select("c_custkey", "c_name"), F.col("o_custkey") == F.col("c_custkey"))
    return keyed.page(joined, [F.desc("o_orderdate"), F.desc("o_orderkey")], 50, 1).select("o_orderkey", "c_name", "o_orderstatus")


@query("""WITH a AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r, event_type <> coalesce(lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id), 'error') AS altered FROM events WHERE event_type IN ('purchase', 'error'))
SELECT max(event_id) FILTER (r = 1) AS event_id, user_id, CASE WHEN max(event_type) FILTER (r = 1) = 'purchase' THEN 'REVIEWED' ELSE 'IN_REVIEW' END AS review, count(*) FILTER (altered) AS changes FROM a GROUP BY user_id""")
def review_transitions(spark, d):
    e = table(spark, d, "events").filter(F.col("event_type").isin("purchase", "error"))
    actions = e.select("user_id", F.col("event_id").alias("action_id"), F.when(F.col("event_type") == "purchase", "MARK").otherwise("REOPEN").alias("action"), F.col("ts").alias("at"))
    return review.review_states(actions, "user_id").select(F.col("action_id").alias("event_id"), "user_id", F.col("status").alias("review"), "changes")


@query("SELECT event_id, json_extract_string(props, '$.k') AS k, CASE WHEN json_extract_string(props, '$.k')::BIGINT > 50 THEN 'applied' ELSE 'pending' END AS status FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL")
def json_payload(spark, d):
    e = table(spark, d, "events").select("event_id", object_payload(F.col("props"), "k bigint").alias("p")).filter("p.k is not null")
    return e.select("event_id", F.col("p.k").cast("string").alias("k"), F.when(F.col("p.k") > 50, "applied").otherwise("pending").alias("status"))


@query("""WITH a AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events WHERE json_extract_string(props, '$.k')::BIGINT > 50) SELECT user_id, event_id AS snapshot_id FROM a WHERE r = 1""")
def latest_applied_snapshot(spark, d):
    e = table(spark, d, "events").filter(F.get_json_object("props", "$.k").cast("bigint") > 50).select("user_id", F.col("event_id").alias("snapshot_id"), "ts")
    return keyed.latest(e, ["user_id"], ["ts", "snapshot_id"]).select("user_id", "snapshot_id")


_UPLOADS = "SELECT page_id, CASE WHEN page_id % 7 = 0 THEN 'text/html' ELSE 'application/pdf' END AS content_type, CASE WHEN page_id % 5 = 0 THEN 'a.txt' ELSE 'a.PDF' END AS name, length(html) * 3000 - 9000000 AS size FROM pages"


@query(f"SELECT page_id, CASE WHEN content_type <> 'application/pdf' OR lower(name) NOT LIKE '%.pdf' THEN 'UNSUPPORTED_MEDIA_TYPE' WHEN size <= 0 THEN 'EMPTY_FILE' ELSE 'FILE_TOO_LARGE' END AS error FROM ({_UPLOADS}) WHERE content_type <> 'application/pdf' OR lower(name) NOT LIKE '%.pdf' OR size <= 0 OR size > 20971520")
def refused_uploads(spark, d):
    p = table(spark, d, "pages")
    u = p.select("page_id", F.when(F.col("page_id") % 7 == 0, "text/html").otherwise("application/pdf").alias("content_type"), F.when(F.col("page_id") % 5 == 0, "a.txt").otherwise("a.PDF").alias("original_filename"), (F.length("html") * 3000 - 9000000).alias("file_size"))
    return split_uploads(u)[1].select("page_id", "error")


# ---- snapshots: changes, retention, summaries

@query("""WITH p AS (SELECT user_id, event_id, event_type, lag(event_type) OVER w AS before, row_number() OVER w AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT user_id, event_id, before AS previous, n > 1 AND before IS DISTINCT FROM event_type AS changed FROM p""")
def snapshot_diff(spark, d):
    e = table(spark, d, "events").select("user_id", "event_id", "event_type", "ts")
    return keyed.changes(e, ["user_id"], ["ts", "event_id"], ["event_type"]).select("user_id", "event_id", F.col("previous_event_type").alias("previous"), F.col("changed_event_type").alias("changed"))


@query("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events)
SELECT user_id, count(*) AS runs, count(*) FILTER (event_type = 'error') AS failed, min(event_id) AS first_run FROM r WHERE k <= 20 GROUP BY user_id""")
def last_n_summary(spark, d):
    e = keyed.last_n(table(spark, d, "events").select("user_id", "event_id", "event_type", "ts"), ["user_id"], ["ts", "event_id"], 20)
    return e.groupBy("user_id").agg(F.count("*").alias("runs"), F.count_if(F.col("event_type") == "error").alias("failed"), F.min("event_id").alias("first_run"))


@query("""WITH c AS (SELECT l_partkey, l_shipmode, count(*) AS n, min(k) AS f FROM (SELECT l_partkey, l_returnflag || l_linestatus AS l_shipmode, l_orderkey * 10 + l_linenumber AS k FROM lineitem) GROUP BY l_partkey, l_shipmode)
SELECT l_partkey, l_shipmode AS mode, n FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY n DESC, f) AS r FROM c) WHERE r = 1""")
def top_values_mode(spark, d):
    li = table(spark, d, "lineitem").select("l_partkey", F.concat("l_returnflag", "l_linestatus").alias("mode"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("k"))
    return keyed.commonest(li, ["l_partkey"], "mode", "k").select("l_partkey", "mode", "n")


_FIELDS_SQL = """f AS (SELECT c_custkey % 50 AS doc, c_custkey AS run, key, CASE key WHEN 'name' THEN c_name WHEN 'segment' THEN CASE WHEN c_mktsegment = 'BUILDING' THEN '' ELSE c_mktsegment END ELSE CASE WHEN c_acctbal < 0 THEN NULL ELSE 'x' END END AS value,
 CASE WHEN key = 'balance' THEN least(1, greatest(0, c_acctbal / 10000)) ELSE 0.7::DOUBLE END AS confidence FROM customer, (VALUES ('name'), ('segment'), ('balance'), ('phone')) k(key)),
g AS (SELECT *, CASE WHEN key = 'phone' THEN 'missing' WHEN trim(value) <> '' THEN CASE WHEN key = 'segment' AND value = 'MACHINERY' THEN 'rejected' ELSE 'accepted' END ELSE 'missing' END AS status FROM f)"""


def _fields(spark, d):
    """Fields of a run per customer: name, segment and balance, against a contract that also asks for a phone."""
    c = table(spark, d, "customer")
    cells = F.explode(F.array(F.struct(F.lit("name").alias("field"), F.col("c_name").alias("value"), F.lit(0.7).alias("confidence")), F.struct(F.lit("segment").alias("field"), F.when(F.col("c_mktsegment") == "BUILDING", "").otherwise(F.col("c_mktsegment")).alias("value"), F.lit(0.7).alias("confidence")), F.struct(F.lit("balance").alias("field"), F.when(F.col("c_acctbal") >= 0, "x").alias("value"), F.least(F.lit(1), F.greatest(F.lit(0), F.col("c_acctbal") / 10000)).alias("confidence"))))
    rows = c.select((F.col("c_custkey") % 50).alias("doc"), F.col("c_custkey").alias("run"), cells.alias("f")).select("doc", "run", "f.*")
    asked = spark.createDataFrame([("name",), ("segment",), ("balance",), ("phone",)], "key string")
    f = observe.against_contract(rows, asked, ["doc", "run"])
    return f.withColumn("status", F.when((F.col("field") == "segment") & (F.col("value") == "MACHINERY"), "rejected").otherwise(F.col("status"))).withColumn("confidence", F.coalesce("confidence", F.lit(0.7)))


def _named_fields(spark, d):
    """The same fields, segments as species and balances as sexes, which are suspicious as such."""
    return _fields(spark, d).withColumn("field", F.when(F.col("field") == "segment", "species").when(F.col("field") == "balance", "sex").otherwise(F.col("field")))


@query(f"WITH {_FIELDS_SQL} SELECT run, count(*) FILTER (status = 'accepted') AS accepted, count(*) FILTER (status = 'rejected') AS rejected, count(*) FILTER (status = 'missing') AS missing, count(*) FILTER (status = 'accepted' AND confidence < 0.6) AS low, count(*) FILTER (status = 'accepted' AND confidence >= 0.6 AND confidence < 0.8) AS mid, count(*) FILTER (status = 'accepted' AND confidence >= 0.8) AS high, count(*) AS total FROM g GROUP BY run")
def snapshot_counts(spark, d):
    return observe.snapshot_counts(_fields(spark, d), ["run"])


@query(f"""WITH {_FIELDS_SQL}, recent AS (SELECT * FROM g WHERE run IN (SELECT run FROM (SELECT c_custkey AS run, row_number() OVER (PARTITION BY c_custkey % 50 ORDER BY c_custkey DESC) AS r FROM customer) WHERE r <= 20)),
u AS (SELECT doc, key, value, row_number() OVER (PARTITION BY doc, key ORDER BY count(*) DESC, min(run)) AS r FROM recent WHERE status = 'accepted' GROUP BY doc, key, value)
SELECT a.doc, a.key2 AS field, count(*) FILTER (status = 'missing') AS missing, count(*) FILTER (status = 'rejected') AS rejected, count(*) FILTER (status = 'accepted') AS accepted, count(*) FILTER (status = 'accepted' AND key2 IN ('species', 'sex')) AS suspicious, round_even(avg(confidence) FILTER (status = 'accepted'), 2) AS mean_confidence, max(u.value) AS usual FROM (SELECT *, CASE key WHEN 'segment' THEN 'species' WHEN 'balance' THEN 'sex' ELSE key END AS key2 FROM recent) a LEFT JOIN (SELECT * FROM u WHERE r = 1) u ON u.doc = a.doc AND u.key = a.key GROUP BY a.doc, a.key, a.key2""")
def field_report(spark, d):
    return observe.field_report(_named_fields(spark, d), "doc", ["run"])


@query(f"WITH {_FIELDS_SQL}, m AS (SELECT doc, key, count(*) FILTER (status = 'missing') AS missing FROM g GROUP BY doc, key) SELECT doc, key AS field, missing, r AS rank FROM (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY missing DESC, key) AS r FROM m WHERE missing > 0) WHERE r <= 10")
def most_missing_fields(spark, d):
    return observe.most_missing(observe.field_report(_fields(spark, d), "doc", ["run"], 10**6), "doc").select("doc", "field", "missing", "rank")


@query(f"""WITH {_FIELDS_SQL}, h AS (SELECT *, CASE key WHEN 'segment' THEN 'species' WHEN 'balance' THEN 'sex' ELSE key END AS field FROM g) SELECT run, coalesce(string_agg(field, ',' ORDER BY field) FILTER (status = 'missing'), '') AS missing, coalesce(string_agg(field, ',' ORDER BY field) FILTER (status = 'rejected'), '') AS rejected,
coalesce(string_agg(field || ':' || field || '_outside_allowed_set', ',' ORDER BY field) FILTER (status = 'accepted' AND field IN ('species', 'sex')), '') AS suspicious FROM h GROUP BY run""")
def triage_lists(spark, d):
    return observe.triage(_named_fields(spark, d), ["run"])


@query("""WITH x AS (SELECT p_partkey, p_partkey % 10 AS k, p_partkey % 20 >= 10 AS odd, p_size AS z, p_type AS t, lpad(p_size::VARCHAR, 2, '0') AS zz FROM part),
y AS (SELECT *, CASE k WHEN 0 THEN z || CASE WHEN odd THEN ' lb' ELSE ' kg' END WHEN 1 THEN z || '0000000' || CASE WHEN odd THEN 'x' ELSE '' END WHEN 2 THEN t WHEN 3 THEN CASE WHEN odd THEN 'macho' ELSE t END WHEN 4 THEN CASE WHEN odd THEN z::VARCHAR ELSE 'Datos' END
 WHEN 5 THEN CASE WHEN odd THEN 'Clinica ' || t ELSE z::VARCHAR END WHEN 6 THEN CASE WHEN odd THEN 'Calle Mayor ' || z ELSE 'tel 9' || zz || '000000' END WHEN 7 THEN CASE WHEN odd THEN 'Calle Sol ' || zz ELSE t END WHEN 8 THEN CASE WHEN odd THEN '01/01/' || (1950 + z) ELSE '05/06/' || (2000 + z) END ELSE repeat('n', 2 * z) END AS v FROM x)
SELECT p_partkey, CASE k WHEN 0 THEN concat_ws(',', CASE WHEN odd THEN 'weight_contains_non_kg_letters' END, CASE WHEN z < 0.5 OR z > 120 THEN 'weight_out_of_range' END)
WHEN 1 THEN concat_ws(',', CASE WHEN odd THEN 'microchip_contains_letters' END, CASE WHEN length(v) NOT BETWEEN 9 AND 15 THEN 'microchip_length_out_of_range' END, CASE WHEN odd THEN 'microchip_non_digit_characters' END, CASE WHEN length(z::VARCHAR) = 2 AND z >= 60 THEN 'microchip_phone_like_digits' END)
WHEN 2 THEN 'species_outside_allowed_set' WHEN 3 THEN CASE WHEN odd THEN '' ELSE 'sex_outside_allowed_set' END
WHEN 4 THEN CASE WHEN odd THEN concat_ws(',', 'pet_name_numeric_only', CASE WHEN length(v) <= 1 THEN 'pet_name_too_short' END) ELSE 'pet_name_is_stopword' END
WHEN 5 THEN CASE WHEN odd THEN '' ELSE concat_ws(',', 'clinic_name_numeric_only', CASE WHEN length(v) <= 2 THEN 'clinic_name_too_short' END, 'clinic_name_missing_institution_token') END
WHEN 6 THEN CASE WHEN odd THEN '' ELSE 'clinic_address_contains_phone_token,clinic_address_contains_phone_number' END
WHEN 7 THEN CASE WHEN odd THEN CASE WHEN v = 'Calle Sol 07' THEN 'owner_address_matches_clinic_address' ELSE '' END ELSE concat_ws(',', CASE WHEN length(v) < 10 THEN 'owner_address_too_short' END, 'owner_address_no_address_tokens') END
WHEN 8 THEN CASE WHEN odd THEN CASE WHEN (DATE '2024-01-01' - make_date(1950 + z, 1, 1)) / 365.25 > 40 THEN 'dob_implausibly_old' ELSE '' END ELSE concat_ws(',', CASE WHEN 2000 + z >= 2024 THEN 'dob_future_date' END, CASE WHEN z = 20 THEN 'dob_matches_visit_date' END) END
ELSE CASE WHEN 2 * z > 80 THEN 'value_too_long' ELSE '' END END AS flags FROM y""")
def validator_flags(spark, d):
    """A value of each kind of field for every part, right and wrong ones."""
    k, odd, z, t = F.col("p_partkey") % 10, F.col("p_partkey") % 20 >= 10, F.col("p_size").cast("string"), F.col("p_type")
    two, or_ = F.lpad(z, 2, "0"), lambda a, b: F.when(odd, a).otherwise(b)
    c = lambda *x: F.concat(*(F.lit(y) if isinstance(y, str) else y for y in x))
    year = lambda base: (F.lit(base) + F.col("p_size")).cast("string")
    values = [
        ("weight", c(z, or_(" lb", " kg"))), ("microchip_id", c(z, "0000000", or_("x", ""))), ("species", t), ("sex", or_("macho", t)), ("pet_name", or_(z, "Datos")), ("clinic_name", or_(c("Clinica ", t), z)), ("clinic_address", or_(c("Calle Mayor ", z), c("tel 9", two, "000000"))),
        ("owner_address", or_(c("Calle Sol ", two), t)), ("dob", or_(c("01/01/", year(1950)), c("05/06/", year(2000)))), ("notes", F.repeat(F.lit("n"), 2 * F.col("p_size"))),
    ]
    field, v = F.lit(None).cast("string"), F.lit(None).cast("string")
    for i, (name, value) in enumerate(values):
        field, v = F.when(k == i, name).otherwise(field), F.when(k == i, value).otherwise(v)
    return table(spark, d, "part").select("p_partkey", F.array_join(validators.suspicious(field, v, F.lit("Calle Sol 07"), F.lit("05/06/2020"), F.lit("2024-01-01").cast("date")), ",").alias("flags"))


@query("""WITH x AS (SELECT o_orderkey, o_orderkey % 4 AS k, CASE o_orderkey % 4 WHEN 0 THEN strftime(o_orderdate, '%d/%m/%Y') WHEN 1 THEN (o_orderkey % 200)::VARCHAR || ' kg' WHEN 2 THEN o_orderpriority ELSE o_orderkey::VARCHAR END AS v, o_orderdate FROM orders)
SELECT o_orderkey, CASE k WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN CASE WHEN o_orderkey % 200 BETWEEN 1 AND 120 THEN v END WHEN 2 THEN NULL ELSE CASE WHEN length(v) <= 3 THEN v END END AS normalized,
CASE k WHEN 1 THEN CASE WHEN o_orderkey % 200 = 0 THEN 'empty' WHEN o_orderkey % 200 > 120 THEN 'invalid-weight' END WHEN 2 THEN 'invalid-sex' WHEN 3 THEN CASE WHEN length(v) > 3 THEN 'invalid-age' END END AS reason FROM x""")
def validated_fields(spark, d):
    k = F.col("o_orderkey") % 4
    v = F.when(k == 0, F.date_format("o_orderdate", "dd/MM/yyyy")).when(k == 1, F.concat((F.col("o_orderkey") % 200).cast("string"), F.lit(" kg"))).when(k == 2, F.col("o_orderpriority")).otherwise(F.col("o_orderkey").cast("string"))
    key = F.when(k == 0, "visit_date").when(k == 1, "peso").when(k == 2, "sexo").otherwise("edad")
    return table(spark, d, "orders").select("o_orderkey", validators.accept(key, v).alias("r")).select("o_orderkey", "r.normalized", "r.reason")


@query("""WITH c AS (SELECT unnest(['name', 'segment', 'balance', 'phone']) AS key), h AS (SELECT c_custkey, 'name' AS key FROM customer UNION ALL SELECT c_custkey, 'segment' FROM customer WHERE c_mktsegment <> 'BUILDING' UNION ALL SELECT c_custkey, 'balance' FROM customer WHERE c_acctbal >= 0)
SELECT c_custkey::VARCHAR AS document_id, c.key FROM customer CROSS JOIN c WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.c_custkey = customer.c_custkey AND h.key = c.key)""")
def contract_completeness(spark, d):
    f = _fields(spark, d).filter("value is not null and trim(value) != ''").select(F.col("run").cast("string").alias("document_id"), F.col("field").alias("key"))
    return record.missing_keys(f, spark.createDataFrame([("name",), ("segment",), ("balance",), ("phone",)], "key string"))


@query()
def segment_clauses(spark, d):
    """Observations and actions of conversation turns, read as segments; tests hold the rules against worked cases."""
    return clauses.observations_actions(table(spark, d, "conversations").select("conv_id", "turn", "text"), "text").select("conv_id", "turn", "observations", "actions")


@query("SELECT event_type, v AS p95 FROM (SELECT event_type, value AS v, row_number() OVER (PARTITION BY event_type ORDER BY value) AS r, count(*) OVER (PARTITION BY event_type) AS n FROM events) WHERE r = floor(0.95 * (n - 1)) + 1")
def p95_latency(spark, d):
    return keyed.index_percentile(table(spark, d, "events"), ["event_type"], "value", 0.95, "p95")


# ---- calibration

@query("""WITH x AS (SELECT user_id, CASE event_type WHEN 'purchase' THEN 1 ELSE -1 END AS delta, ts, event_id FROM events WHERE event_type IN ('purchase', 'error')), y AS (SELECT *, sum(delta) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM x)
SELECT user_id, (sum(delta) - least(0, min(run)))::BIGINT AS count FROM y GROUP BY user_id""")
def calibration_counters(spark, d):
    e = table(spark, d, "events").filter(F.col("event_type").isin("purchase", "error")).withColumn("delta", F.when(F.col("event_type") == "purchase", 1).otherwise(-1))
    return keyed.clipped_total(e, ["user_id"], ["ts", "event_id"], "delta", "count")


@query("""WITH n AS (SELECT user_id, count(*) FILTER (event_type = 'purchase') AS a, count(*) FILTER (event_type = 'error') AS e FROM events GROUP BY user_id),
j AS (SELECT c_custkey, coalesce(a, 0) AS a, coalesce(e, 0) AS e FROM customer LEFT JOIN n ON user_id = c_custkey)
SELECT c_custkey, CASE WHEN a + e < 3 THEN 0.0::DOUBLE ELSE round_even(((a + 1.0::DOUBLE) / (a + e + 2.0::DOUBLE) - 0.5::DOUBLE) * 2.0::DOUBLE * 15.0::DOUBLE, 1) END AS adjustment FROM j""")
def calibration_adjustment(spark, d):
    n = table(spark, d, "events").groupBy(F.col("user_id").alias("c_custkey")).agg(F.count_if(F.col("event_type") == "purchase").alias("accept_count"), F.count_if(F.col("event_type") == "error").alias("edit_count"))
    return state.calibrated(table(spark, d, "customer").select("c_custkey"), n, ["c_custkey"], []).select("c_custkey", "adjustment")


@query("""WITH x AS (SELECT DISTINCT lang, CASE WHEN doc_id % 3 = 0 THEN ' Invoice ' WHEN doc_id % 3 = 1 THEN '' END AS t FROM documents)
SELECT lang, coalesce(t, '-') AS t, 'ctx_v1:' || sha256('{"context_version":"v1","document_type":"' || coalesce(nullif(lower(trim(t)), ''), 'veterinary_record') || '","language":"' || coalesce(nullif(lower(trim(lang)), ''), 'unknown') || '"}') AS context_key FROM x""")
def context_keys(spark, d):
    x = table(spark, d, "documents").select("lang", F.when(F.col("doc_id") % 3 == 0, " Invoice ").when(F.col("doc_id") % 3 == 1, "").alias("t")).distinct()
    return x.select("lang", F.coalesce("t", F.lit("-")).alias("t"), scores.context_key(F.col("t"), F.col("lang")).alias("context_key"))


@query("""WITH x AS (SELECT event_id, value / 100 AS c, event_id % 31 - 15 AS pp FROM events), y AS (SELECT *, least(1.0::DOUBLE, greatest(0.0::DOUBLE, c + pp / 100.0::DOUBLE)) AS m FROM x)
SELECT event_id, round(m, 6) AS mapped, CASE WHEN m < 0.6::DOUBLE THEN 'low' WHEN m < 0.8::DOUBLE THEN 'mid' ELSE 'high' END AS band, CASE WHEN m < 0.5::DOUBLE THEN 'low' WHEN m < 0.75::DOUBLE THEN 'med' ELSE 'high' END AS tone FROM y""")
def confidence_bands(spark, d):
    m = scores.mapped_confidence(F.col("value") / 100, (F.col("event_id") % 31 - 15).cast("double"))
    return table(spark, d, "events").select("event_id", m.alias("m")).select("event_id", F.round("m", 6).alias("mapped"), scores.snapshot_band(F.col("m")).alias("band"), scores.policy_tone(F.col("m")).alias("tone"))


@query("""SELECT event_id, coalesce(CASE WHEN event_id % 4 = 0 THEN 'm' || event_id END, CASE WHEN event_id % 4 = 1 THEN 'anchor::' || event_type END, CASE WHEN event_id % 4 = 2 THEN 'fallback::' || event_type END) AS mapping_id FROM events""")
def mapping_ids(spark, d):
    k = F.col("event_id") % 4
    return table(spark, d, "events").select("event_id", scores.mapping_id(F.when(k == 0, F.concat(F.lit("m"), F.col("event_id").cast("string"))).when(k == 1, " "), F.when(k == 1, F.upper("event_type")), F.when(k == 2, "fallback_x").otherwise("anchor"), F.col("event_type")).alias("mapping_id"))


@query("""WITH f AS (SELECT user_id AS d, event_type AS k, CASE WHEN event_id % 3 = 0 THEN NULL ELSE 'm' || event_id % 3 END AS m, CASE WHEN value > 80 THEN 'human' ELSE 'machine' END AS o FROM events)
SELECT d AS document_id, k AS field_key, m AS mapping_id, CASE WHEN bool_or(o = 'human') THEN 0 ELSE 1 END AS accept_delta, CASE WHEN bool_or(o = 'human') THEN 1 ELSE 0 END AS edit_delta FROM f GROUP BY d, k, m""")
def review_deltas(spark, d):
    e = table(spark, d, "events")
    return state.review_deltas(e.select(F.col("user_id").alias("document_id"), F.col("event_type").alias("field_key"), F.when(F.col("event_id") % 3 != 0, F.concat(F.lit("m"), (F.col("event_id") % 3).cast("string"))).alias("mapping_id"), F.when(F.col("value") > 80, "human").otherwise("machine").alias("origin")))


# ---- order: nearest, enclosing, carried forward, k-th, ranked

@query("""WITH a AS (SELECT * FROM events WHERE event_type = 'error'), b AS (SELECT * FROM events WHERE event_type = 'purchase'),
p AS (SELECT a.event_id, b.event_id AS near, row_number() OVER (PARTITION BY a.event_id ORDER BY abs(epoch_us(b.ts) - epoch_us(a.ts)), b.ts, b.event_id) AS r FROM a JOIN b USING (user_id))
SELECT a.event_id, p.near AS nearest_id FROM a LEFT JOIN (SELECT * FROM p WHERE r = 1) p USING (event_id)""")
def nearest_anchor(spark, d):
    e = table(spark, d, "events").select("event_id", "user_id", "event_type", _micros("ts").alias("at"))
    left, right = e.filter("event_type = 'error'"), e.filter("event_type = 'purchase'").select("user_id", "at", F.col("event_id").alias("anchor_id"))
    return keyed.nearest(left, right, ["user_id"], "at", "at", "anchor_id").select("event_id", "nearest_id")


@query("""SELECT event_id, epoch_us(ts) AS start, coalesce(lead(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts), 9999999999999999) AS stop FROM events WHERE event_type = 'purchase'""")
def enclosing_interval(spark, d):
    e = table(spark, d, "events").filter("event_type = 'purchase'").select("event_id", "user_id", _micros("ts").alias("start"))
    return keyed.intervals(e, ["user_id"], "start", F.lit(9999999999999999)).select("event_id", "start", "stop")


@query("""SELECT event_id, last_value(CASE WHEN event_type = 'purchase' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS last_purchase FROM events""")
def carry_forward(spark, d):
    return keyed.carried(table(spark, d, "events"), ["user_id"], ["ts", "event_id"], F.when(F.col("event_type") == "purchase", F.col("event_id")), "last_purchase").select("event_id", "last_purchase")


@query("""WITH a AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events WHERE event_type = 'view'), b AS (SELECT user_id, event_id AS other, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k, count(*) OVER (PARTITION BY user_id) AS n FROM events WHERE event_type = 'purchase')
SELECT a.event_id, b.other, 'visit-' || lpad(b.k::VARCHAR, 3, '0') AS visit FROM a JOIN b ON a.user_id = b.user_id AND b.k = least(a.k, b.n)""")
def kth_occurrence_match(spark, d):
    e = table(spark, d, "events").select("user_id", "event_id", "event_type", "ts")
    a, b = e.filter("event_type = 'view'").drop("event_type"), e.filter("event_type = 'purchase'").select("user_id", F.col("event_id").alias("other"), F.col("ts").alias("at"))
    n = b.withColumn("place", F.row_number().over(Window.partitionBy("user_id").orderBy("at", "other")))
    m = keyed.kth_match(a, n, ["user_id"], ["ts", "event_id"], ["at", "other"])
    return m.select("event_id", "other", F.format_string("visit-%03d", "place").alias("visit"))


@query("SELECT l_orderkey, l_partkey, r AS rank FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber, l_partkey) AS r FROM lineitem) WHERE r <= 3")
def top3_repeatable(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_extendedprice", "l_linenumber")
    return keyed.top(li, ["l_orderkey"], [F.desc("l_extendedprice"), F.asc("l_linenumber"), F.asc("l_partkey")], 3).select("l_orderkey", "l_partkey", "rank")


@query("""WITH x AS (SELECT p_brand AS k, lower(p_type) AS v, max(p_retailprice) AS c FROM part GROUP BY p_brand, lower(p_type)), y AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY c DESC, v) AS r FROM x)
SELECT k, string_agg(v, '|' ORDER BY r) AS best FROM y WHERE r <= 5 GROUP BY k""")
def suggestion_top5(spark, d):
    p = table(spark, d, "part").select(F.lit("d").alias("document_id"), F.col("p_brand").alias("key"), F.lower("p_type").alias("value"), F.col("p_retailprice").alias("confidence"), F.lit("").alias("snippet"))
    return mining.suggestions(p).select(F.col("key").alias("k"), F.array_join(F.transform("suggestions", lambda s: s["value"]), "|").alias("best"))


@query("SELECT event_id, user_id FROM (SELECT *, lag(event_type) OVER w AS before, row_number() OVER w AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) WHERE n = 1 OR before IS DISTINCT FROM event_type")
def consecutive_repeats(spark, d):
    return keyed.drop_repeats(table(spark, d, "events").select("event_id", "user_id", "event_type", "ts"), ["user_id"], ["ts", "event_id"], "event_type").select("event_id", "user_id")


@query("SELECT c_mktsegment, min(c_custkey) AS c_custkey, lower(c_mktsegment) AS folded FROM customer GROUP BY c_mktsegment")
def dedup_values(spark, d):
    c = table(spark, d, "customer").select(F.lit(1).alias("g"), "c_mktsegment", "c_custkey")
    return keyed.first_wins(c, ["g"], "c_mktsegment", "c_custkey").select("c_mktsegment", "c_custkey", text.fold(F.col("c_mktsegment")).alias("folded"))


@query("""WITH a AS (SELECT p_brand AS alias, p_name AS address FROM part), u AS (SELECT alias, min(address) AS address FROM a GROUP BY alias HAVING count(DISTINCT address) = 1), n AS (SELECT n_name, n_nationkey FROM nation)
SELECT p_partkey, u.address FROM part LEFT JOIN (SELECT p_type AS alias, min(p_brand) AS address FROM part GROUP BY p_type HAVING count(DISTINCT p_brand) = 1) u ON alias = p_type""")
def catalog_lookup(spark, d):
    p = table(spark, d, "part")
    return keyed.unique_match(p.select("p_partkey", "p_type"), p.select("p_type", F.col("p_brand").alias("address")), "p_type", "address").select("p_partkey", "address")


@query("""WITH s AS (SELECT o_orderpriority AS document_id, o_custkey, max(least(1.0::DOUBLE, o_totalprice / 400000.0::DOUBLE)) AS c FROM orders WHERE o_orderstatus <> 'P' GROUP BY o_orderpriority, o_custkey)
SELECT document_id, count(*) AS detected, count(*) FILTER (c < 0.5::DOUBLE) AS low, count(*) FILTER (c >= 0.5::DOUBLE AND c < 0.75::DOUBLE) AS medium, count(*) FILTER (c >= 0.75::DOUBLE) AS high, 0::BIGINT AS unknown FROM s GROUP BY document_id""")
def concept_summary(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderpriority").alias("document_id"), F.col("o_custkey").alias("concept"), F.when(F.col("o_orderstatus") == "P", " ").otherwise("x").alias("value"), (F.col("o_totalprice") / 400000.0).alias("confidence"))
    return view.concept_summary(o)


@query("""WITH x AS (SELECT l_suppkey, l_partkey, l_quantity, CASE WHEN l_linenumber = 1 THEN 0 ELSE 1 END AS scope, l_orderkey * 10 + l_linenumber AS seq, l_returnflag = 'R' AS critical FROM lineitem)
SELECT l_suppkey AS slot, l_partkey AS best, crit AS critical FROM (SELECT *, bool_or(critical) OVER (PARTITION BY l_suppkey) AS crit, row_number() OVER (PARTITION BY l_suppkey ORDER BY scope, coalesce(l_quantity, 0) DESC, seq) AS r FROM x) WHERE r = 1""")
def best_slot_candidate(spark, d):
    li = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("document_id"), F.col("l_returnflag").alias("key"), F.col("l_partkey").cast("string").alias("value"), (F.col("l_quantity") / 50).alias("confidence"), F.when(F.col("l_linenumber") == 1, "document").otherwise("visit").alias("scope"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"), (F.col("l_returnflag") == "R").alias("is_critical"))
    aliases = spark.createDataFrame([("goods", k, True) for k in "ANR"], "slot string, key string, document_scope boolean")
    return view.slots(li, aliases).select(F.col("document_id").alias("slot"), F.col("value").cast("long").alias("best"), "critical")


# ---- texts: lines, dates, digits, mining

@query(r"""WITH l AS (SELECT doc_id, unnest(list_filter(list_transform(regexp_split_to_array(text, '\n'), lambda x: trim(x)), lambda x: x <> '')) AS line, generate_subscripts(list_filter(list_transform(regexp_split_to_array(text, '\n'), lambda x: trim(x)), lambda x: x <> ''), 1) AS line_no FROM documents)
SELECT doc_id, line_no::INT AS line_no, length(line)::INT AS size, lag(length(line)) OVER (PARTITION BY doc_id ORDER BY line_no)::INT AS before, max(length(line)) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN 1 FOLLOWING AND 8 FOLLOWING)::INT AS after FROM l""")
def line_context(spark, d):
    rows = text.lines(table(spark, d, "documents"), "text", "doc_id").withColumn("size", F.length("line"))
    near = lambda first, last: F.max("size").over(text.line_window(first, last, "doc_id"))
    return rows.select("doc_id", "line_no", "size", near(-1, -1).alias("before"), near(1, 8).alias("after"))


@query(r"""WITH t AS (SELECT doc_id, unnest(regexp_extract_all(text, '\b(?:\d{1,2}[/.\-]\d{1,2}[/.\-]\d{2,4}|\d{4}[/.\-]\d{1,2}[/.\-]\d{1,2})\b')) AS token FROM documents), n AS (SELECT doc_id, token, string_split(translate(token, '-.', '//'), '/') AS p FROM t),
y AS (SELECT doc_id, token, CASE WHEN length(p[1]) = 4 THEN p[1] ELSE p[3] END AS yy, p[2] AS mm, CASE WHEN length(p[1]) = 4 THEN p[3] ELSE p[1] END AS dd FROM n),
z AS (SELECT *, CASE WHEN length(yy) = 4 THEN yy::INT WHEN length(yy) = 2 THEN yy::INT + CASE WHEN yy::INT >= 69 THEN 1900 ELSE 2000 END END AS full_year FROM y)
SELECT doc_id, token, strftime(try_cast(lpad(full_year::VARCHAR, 4, '0') || '-' || lpad(mm, 2, '0') || '-' || lpad(dd, 2, '0') AS DATE), '%d/%m/%Y') AS date FROM z""")
def date_tokens(spark, d):
    found = text.matches(table(spark, d, "documents").filter("text is not null"), "text", normal.DATE.replace("(", "(?:", 1), "doc_id")
    return found.select("doc_id", F.col("value").alias("token"), normal.date_dmy(F.col("value")).alias("date"))


@query(r"""WITH r AS (SELECT doc_id, unnest(regexp_extract_all(text, '[0-9]+')) AS run FROM documents) SELECT doc_id, run AS chip FROM r WHERE length(run) BETWEEN 9 AND 15""")
def digit_runs(spark, d):
    found = text.matches(table(spark, d, "documents").filter("text is not null"), "text", r"[0-9]+", "doc_id").filter(F.length("value").between(9, 15))
    return found.select("doc_id", normal.digits_of_chip(F.col("value")).alias("chip"))


@query(r"""SELECT p_partkey, CASE WHEN kg BETWEEN 0.5 AND 120 THEN CASE WHEN kg = floor(kg) THEN floor(kg)::BIGINT::VARCHAR ELSE regexp_replace(printf('%.6f', kg), '0+$', '') END || ' kg' END AS weight FROM (SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN p_size * 125 / 1000.0::DOUBLE ELSE p_size + 0.5::DOUBLE END AS kg FROM part)""")
def weights(spark, d):
    p = table(spark, d, "part")
    raw = F.when(F.col("p_partkey") % 2 == 0, F.concat((F.col("p_size") * 125).cast("string"), F.lit(" g"))).otherwise(F.concat(F.col("p_size").cast("string"), F.lit(",5kg")))
    return p.select("p_partkey", normal.weight_kg(raw).alias("weight"))


@query("""WITH x AS (SELECT o_orderkey, o_orderdate::DATE AS born, DATE '1998-12-01' AS on_day FROM orders) SELECT o_orderkey, (year(on_day) - year(born) - CASE WHEN strftime(on_day, '%m%d') < strftime(born, '%m%d') THEN 1 ELSE 0 END)::INT AS years FROM x WHERE born <= on_day""")
def age_years(spark, d):
    return table(spark, d, "orders").select("o_orderkey", normal.age_years(F.col("o_orderdate").cast("date"), F.lit("1998-12-01").cast("date")).alias("years")).filter("years is not null")


def _told_and_known(spark, d):
    """Events with an odd number as dates that texts name, those with an even one as visits."""
    e = table(spark, d, "events").select(F.col("user_id").alias("document_id"), F.col("event_type").alias("date"), "event_id")
    return e.filter("event_id % 2 != 0"), e.filter("event_id % 2 = 0").withColumn("visit_id", F.col("event_id").cast("string"))


@query("""SELECT user_id, event_type, (count(*) FILTER (event_id % 2 = 0) ) AS have, greatest(0, count(*) - 2 * count(*) FILTER (event_id % 2 = 0)) AS missing FROM events GROUP BY user_id, event_type""")
def missing_counts(spark, d):
    seen, known = _told_and_known(spark, d)
    more = visits.missing_visits(seen, known).groupBy("document_id", "date").agg(F.count("*").alias("missing"))
    every = known.select("document_id", "date", F.lit(1).alias("n")).unionByName(seen.select("document_id", "date", F.lit(0).alias("n"))).groupBy("document_id", "date").agg(F.sum("n").alias("have"))
    return every.join(more, ["document_id", "date"], "left").select(F.col("document_id").alias("user_id"), F.col("date").alias("event_type"), "have", F.coalesce("missing", F.lit(0)).alias("missing"))


@query("""WITH g AS (SELECT user_id, event_type, count(*) - 2 * count(*) FILTER (event_id % 2 = 0) AS more FROM events GROUP BY user_id, event_type), t AS (SELECT user_id, count(*) FILTER (event_id % 2 = 0) AS n FROM events GROUP BY user_id),
x AS (SELECT user_id, event_type, unnest(range(1, more + 1)) AS i FROM g WHERE more > 0)
SELECT user_id AS document_id, 'visit-' || lpad((n + row_number() OVER (PARTITION BY user_id ORDER BY event_type, i))::VARCHAR, 3, '0') AS visit_id, event_type AS date FROM x JOIN t USING (user_id)""")
def generated_visits(spark, d):
    return visits.missing_visits(*_told_and_known(spark, d))


@query("""SELECT o_custkey AS document_id, count(*) AS total, count(*) FILTER (o_orderstatus <> 'P') AS assigned, count(*) FILTER (o_orderstatus = 'F') AS anchored, count(*) FILTER (o_orderstatus = 'P') AS unassigned FROM orders GROUP BY o_custkey""")
def visit_metrics(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("document_id"), F.when(F.col("o_orderstatus") != "P", F.col("o_orderkey")).alias("visit_id"), F.when(F.col("o_orderstatus") == "F", "date").otherwise("only").alias("how"))
    return visits.scoping_metrics(o)


_EDITS = """e AS (SELECT o_orderkey AS batch, o_custkey AS d, CASE WHEN o_orderkey % 11 = 0 THEN 2 ELSE 1 END AS version, CASE WHEN o_orderkey % 5 = 0 THEN 'DELETE' ELSE 'UPDATE' END AS op, CASE WHEN o_orderkey % 7 = 0 THEN -1 ELSE o_custkey END AS id, CASE WHEN o_orderkey % 3 = 0 THEN ' ' || c_name ELSE o_orderstatus END AS value, c_name FROM orders JOIN customer ON c_custkey = o_custkey),
g AS (SELECT * FROM e WHERE batch IN (SELECT min(batch) FROM e WHERE version = 1 AND id = d GROUP BY d))"""


def _edited(spark, d):
    """Every order is a batch with one edit of its customer's name: on another version, of another field, or good."""
    o, c = table(spark, d, "orders"), table(spark, d, "customer")
    edits = o.join(c, o.o_custkey == c.c_custkey).select(F.col("o_custkey").alias("document_id"), F.col("o_orderkey").alias("batch"), F.when(F.col("o_orderkey") % 11 == 0, 2).otherwise(1).alias("version"), F.when(F.col("o_orderkey") % 5 == 0, "DELETE").otherwise("UPDATE").alias("op"), F.when(F.col("o_orderkey") % 7 == 0, -1).otherwise(F.col("o_custkey")).alias("field_id"), F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit(" "), F.col("c_name"))).otherwise(F.col("o_orderstatus")).alias("value"), F.lit("string").alias("kind"))
    return state.apply_edits(c.select(F.col("c_custkey").alias("document_id"), F.col("c_custkey").alias("field_id"), F.lit(1).alias("version"), F.col("c_name").alias("value")), edits)


@query(f"WITH {_EDITS} SELECT batch, id AS field_id, op, c_name AS old_value, CASE WHEN op <> 'DELETE' THEN value END AS new_value FROM g WHERE NOT (op = 'UPDATE' AND trim(c_name) = trim(value))")
def edit_log(spark, d):
    return _edited(spark, d)[1].drop("document_id")


@query(f"WITH {_EDITS} SELECT c_custkey AS document_id, CASE WHEN g.d IS NULL THEN 1 ELSE 2 END AS version, CASE WHEN g.op = 'UPDATE' THEN g.value ELSE customer.c_name END AS value FROM customer LEFT JOIN g ON g.d = c_custkey WHERE g.op IS DISTINCT FROM 'DELETE'")
def edited_fields(spark, d):
    return _edited(spark, d)[0].select("document_id", "version", "value")


@query(f"WITH {_EDITS} SELECT d AS document_id, batch, CASE WHEN version = 1 AND id <> d THEN 'FIELD_NOT_FOUND' ELSE 'BASE_VERSION_MISMATCH' END AS error FROM e WHERE batch NOT IN (SELECT batch FROM g)")
def refused_edits(spark, d):
    return _edited(spark, d)[2]


@query("""WITH f AS (SELECT l_orderkey AS d, l_returnflag AS key, l_partkey::VARCHAR AS v, l_linenumber AS seq FROM lineitem)
SELECT d AS document_id, max(v) FILTER (key = 'A' AND r = 1) AS single_a, coalesce(string_agg(v, ',' ORDER BY seq, v) FILTER (key = 'N'), '') AS many_n FROM (SELECT *, row_number() OVER (PARTITION BY d, key ORDER BY seq, v) AS r FROM f) GROUP BY d""")
def canonical_record(spark, d):
    """Parts of an order as its candidates: one for a single field, all for a repeatable one."""
    key = F.when(F.col("l_returnflag") == "A", "pet_name").when(F.col("l_returnflag") == "N", "diagnosis").otherwise("breed")
    li = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("document_id"), key.alias("key"), F.col("l_partkey").cast("string").alias("value"), F.col("l_linenumber").alias("seq"))
    best = li.withColumn("rank", F.row_number().over(Window.partitionBy("document_id", "key").orderBy("seq", "value")))
    return mining.record(best).select("document_id", F.col("pet_name").alias("single_a"), F.array_join("diagnosis", ",").alias("many_n"))


@query("""SELECT c_custkey, c_name FROM customer WHERE (contains(lower(c_name), '0012') OR contains(lower(c_mktsegment), '0012')) AND c_mktsegment <> 'MACHINERY' AND c_acctbal < 5000 AND c_nationkey % 2 = 0""")
def structured_filter(spark, d):
    """Critical fields with a value of a low or unknown band that speak of a term: a field per customer, without a value in one segment."""
    band = F.when(F.col("c_acctbal") < 0, F.lit(None)).when(F.col("c_acctbal") < 5000, "low").otherwise("high")
    item = F.struct(F.col("c_mktsegment").alias("shown"), band.alias("band"), (F.col("c_mktsegment") == "MACHINERY").alias("missing"))
    fields = table(spark, d, "customer").select("c_custkey", "c_name", F.col("c_name").alias("label"), F.col("c_mktsegment").alias("key"), (F.col("c_nationkey") % 2 == 0).alias("is_critical"), F.lit(False).alias("repeatable"), F.array(item).alias("items"))
    return review.structured_filter(fields, " 0012 ", ("low", "unknown"), only_critical=True, with_value=True).select("c_custkey", "c_name")


@query("""WITH m AS (SELECT user_id, min(ts) AS marked FROM events WHERE event_type = 'signup' GROUP BY user_id), r AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, ts DESC) AS k FROM events WHERE event_type IN ('purchase', 'click'))
SELECT c_custkey AS document_id, CASE WHEN c_custkey % 4 = 0 OR marked IS NOT NULL THEN 'REVIEWED' ELSE 'IN_REVIEW' END AS review_status, c_custkey % 4 <> 0 AND marked IS NOT NULL AS newly, (c_custkey % 4 <> 0 AND marked IS NOT NULL AND EXISTS (SELECT 1 FROM r WHERE r.user_id = c_custkey)) AS has_run FROM customer LEFT JOIN m ON m.user_id = c_custkey""")
def marked_reviewed(spark, d):
    docs = table(spark, d, "customer").select(F.col("c_custkey").alias("document_id"), F.when(F.col("c_custkey") % 4 == 0, "REVIEWED").otherwise("IN_REVIEW").alias("review_status"), F.lit(None).cast("timestamp_ntz").alias("reviewed_at"), F.lit(None).cast("string").alias("reviewed_by"), F.lit(None).cast("long").alias("reviewed_run_id"))
    e = table(spark, d, "events")
    marks = e.filter("event_type = 'signup'").select(F.col("user_id").alias("document_id"), F.col("ts").cast("timestamp_ntz").alias("at"), F.lit("r").alias("by"))
    runs = _runs(spark, d).withColumn("completed_at", F.col("created_at"))
    return review.mark_reviewed(docs, runs, marks).select("document_id", "review_status", "newly", F.col("reviewed_run_id").isNotNull().alias("has_run"))


@query("""SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN 'missing_policy_version' WHEN p_partkey % 7 = 0 THEN 'missing_band_cutoffs' WHEN p_size / 50.0 >= 0.75 THEN 'invalid_band_cutoffs' END AS reason FROM part""")
def policy_reasons(spark, d):
    p = table(spark, d, "part")
    return p.select("p_partkey", review.policy(F.when(F.col("p_partkey") % 5 == 0, " ").otherwise("v1"), F.when(F.col("p_partkey") % 7 != 0, F.col("p_size") / 50.0), F.lit(0.75))["reason"].alias("reason"))


@query("""WITH f AS (SELECT o_custkey AS d, o_orderkey AS seq, CASE WHEN o_orderkey % 3 = 0 THEN 'microchip_id' ELSE 'notes' END AS key, o_orderkey::VARCHAR AS v FROM orders), c AS (SELECT c_custkey AS d, (900000000 + c_custkey)::VARCHAR AS chip FROM customer WHERE c_custkey % 2 = 0), first AS (SELECT d, min(seq) AS s FROM f WHERE key = 'microchip_id' GROUP BY d)
SELECT f.d AS document_id, f.key, CASE WHEN f.key = 'microchip_id' AND seq = s AND chip IS NOT NULL THEN chip ELSE v END AS value FROM f LEFT JOIN first USING (d) LEFT JOIN c USING (d)
UNION ALL SELECT c.d, 'microchip_id', chip FROM c LEFT JOIN first USING (d) WHERE s IS NULL""")
def chip_upserts(spark, d):
    f = table(spark, d, "orders").select(F.col("o_custkey").alias("document_id"), F.col("o_orderkey").cast("string").alias("field_id"), F.when(F.col("o_orderkey") % 3 == 0, "microchip_id").otherwise("notes").alias("key"), F.col("o_orderkey").cast("string").alias("value"), F.col("o_orderkey").alias("seq"))
    chips = table(spark, d, "customer").filter("c_custkey % 2 = 0").select(F.col("c_custkey").alias("document_id"), (F.lit(900000000) + F.col("c_custkey")).cast("string").alias("chip"))
    return review.upsert_chips(f, chips).select("document_id", "key", "value")


@query("""WITH x AS (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN NULL ELSE value / 50 END AS c, CASE WHEN event_id % 5 = 0 THEN NULL ELSE value / 80 END AS m, CASE WHEN event_id % 2 = 0 THEN NULL ELSE (event_id % 21 - 10)::DOUBLE END AS a FROM events),
y AS (SELECT event_id, CASE WHEN c IS NOT NULL THEN least(1.0::DOUBLE, greatest(0.0::DOUBLE, c)) WHEN m IS NOT NULL THEN least(1.0::DOUBLE, greatest(0.0::DOUBLE, m)) ELSE 0.0::DOUBLE END AS c, coalesce(a, 0.0::DOUBLE) AS a FROM x) SELECT event_id, round(c, 6) AS candidate, round(least(1.0::DOUBLE, greatest(0.0::DOUBLE, c + a / 100.0::DOUBLE)), 6) AS mapped FROM y""")
def sanitised_confidences(spark, d):
    e = table(spark, d, "events").select("event_id", F.lit(0.5).alias("text_extraction_reliability"), F.when(F.col("event_id") % 3 != 0, F.col("value") / 50).alias("field_candidate_confidence"), F.when(F.col("event_id") % 5 != 0, F.col("value") / 80).alias("field_mapping_confidence"), F.when(F.col("event_id") % 2 != 0, (F.col("event_id") % 21 - 10).cast("double")).alias("field_review_history_adjustment"), F.lit(0.1).alias("confidence"))
    return review.sanitised_confidences(e).select("event_id", F.round("field_candidate_confidence", 6).alias("candidate"), F.round("field_mapping_confidence", 6).alias("mapped"))


@query("""WITH a AS (SELECT l_partkey AS k, count(*) AS churn FROM lineitem GROUP BY l_partkey), b AS (SELECT p_partkey AS k, max(p_size) AS complexity FROM part WHERE p_size > 25 GROUP BY p_partkey)
SELECT coalesce(a.k, b.k) AS k, coalesce(churn, 0) AS churn, coalesce(complexity, 0) AS complexity FROM a FULL JOIN b ON a.k = b.k""")
def hotspot_signals(spark, d):
    sizes = table(spark, d, "part").filter("p_size > 25").select(F.col("p_partkey").alias("k"), F.col("p_size").alias("complexity"))
    return observe.hotspots(table(spark, d, "lineitem").select(F.col("l_partkey").alias("k")), sizes, "k")


@query("""SELECT user_id, max(CASE WHEN ts <= TIMESTAMP '2024-01-20' THEN ts END)::DATE::VARCHAR AS latest FROM events WHERE event_type = 'view' GROUP BY user_id""")
def latest_past_visit(spark, d):
    e = table(spark, d, "events").filter("event_type = 'view'")
    latest = visits.latest_past(F.col("ts"), F.lit("2024-01-20 00:00:00").cast(dict(e.dtypes)["ts"]))
    return e.groupBy("user_id").agg(F.date_format(latest, "yyyy-MM-dd").alias("latest"))


@query()
def mined_candidates(spark, d):
    """Candidates of all documents with their rank; tests hold extraction against the published examples."""
    docs = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("document_id"), "text")
    return mining.ranked(mining.placed(docs)).select("document_id", "key", "rank", "value", "confidence", "offset")


@query()
def visit_occurrences(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("document_id"), "text")
    return visits.occurrences(docs)


@query()
def document_records(spark, d):
    """The canonical record of every document; tests hold extraction against the published cases."""
    docs = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("document_id"), "text")
    return record.of_texts(docs, F.lit("2024-01-31").cast("date"))[0]


@query()
def document_visits(spark, d):
    """The visits of every document with what they hold, from its text, the fields mined from it and from each visit's own text."""
    docs = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("document_id"), "text")
    return visit_chart.chart(docs, record.visit_inputs(record.of_texts(docs, F.lit("2024-01-31").cast("date"))[1])[0])[0]


# ---- clinical texts composed of the tables: a customer is a document, an order a visit

def _histories(spark, d):
    """Texts (document_id, text): under a heading with date and time each order's weight and case, by order number."""
    o = table(spark, d, "orders")
    case = F.lpad(F.col("o_orderkey").cast("string"), 9, "0")
    part = F.concat(F.lit("- "), F.date_format("o_orderdate", "dd/MM/yyyy"), F.lit(" - 10:30 - Control caso "), case, F.lit("\nPeso: "), (F.col("o_orderkey") % 100 + 1).cast("string"), F.lit(" kg\nDiagnóstico: otitis "), case, F.lit("\n"))
    whole = o.groupBy(F.col("o_custkey").cast("string").alias("document_id")).agg(F.sort_array(F.collect_list(F.struct("o_orderkey", part.alias("part")))).alias("parts"))
    return whole.select("document_id", F.array_join(F.transform("parts", lambda p: p["part"]), "").alias("text"))


def _procedures(spark, d):
    """A field of every third order, whose evidence is in the order's heading."""
    case = F.lpad(F.col("o_orderkey").cast("string"), 9, "0")
    none = F.lit(None).cast("string")
    return table(spark, d, "orders").filter("o_orderkey % 3 = 0").select(F.col("o_custkey").cast("string").alias("document_id"), F.concat(F.lit("f"), case).alias("field_id"), F.lit("procedure").alias("key"), F.concat(F.lit("sutura "), case).alias("value"), F.concat(F.lit("Control caso "), case).alias("snippet"), none.alias("scope"), none.alias("section"), F.col("o_orderkey").alias("seq"))


#: Orders as visits: n counts a customer's orders of a day, no the visits: first days in order of their first order, then the days' further orders.
_ORDER_VISITS = """a AS (SELECT o_custkey, o_orderkey AS k, o_orderdate::DATE AS day, (o_orderkey % 100 + 1) || ' kg' AS w, lpad(o_orderkey::VARCHAR, 9, '0') AS c, row_number() OVER (PARTITION BY o_custkey, o_orderdate::DATE ORDER BY o_orderkey) AS n, min(o_orderkey) OVER (PARTITION BY o_custkey, o_orderdate::DATE) AS f FROM orders),
v AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY n > 1, f, n) AS no, count(*) FILTER (n = 1) OVER (PARTITION BY o_custkey) AS days FROM a)"""


@query(f"""WITH {_ORDER_VISITS}, p AS (SELECT o_custkey, no, string_agg('sutura ' || c, ',' ORDER BY k) AS procedures FROM (SELECT o_custkey, k, c, CASE WHEN days = 1 THEN 1 ELSE no END AS no FROM v WHERE k % 3 = 0) GROUP BY o_custkey, no),
l AS (SELECT o_custkey, max_by(w, day || lpad(no::VARCHAR, 9, '0')) AS current FROM v GROUP BY o_custkey)
SELECT v.o_custkey::VARCHAR AS document_id, 'visit-' || lpad(no::VARCHAR, 3, '0') AS visit_id, day::VARCHAR AS date, row_number() OVER (PARTITION BY v.o_custkey ORDER BY day, no)::INT AS position, w AS weight, 'otitis ' || c AS diagnosis, procedures, current
FROM v LEFT JOIN p USING (o_custkey, no) JOIN l USING (o_custkey)""")
def charted_visits(spark, d):
    """Visits with the fields assigned to them and mined from their own text, and the document's current weight."""
    listed, fields, of_docs = visit_chart.chart(written(_histories(spark, d), "histories"), _procedures(spark, d))
    one = lambda key: F.max(F.when(F.col("key") == key, F.col("value"))).alias(key)
    procedures = F.array_join(F.array_sort(F.collect_list(F.when((F.col("key") == "procedure") & (F.col("origin") == "assigned"), F.col("value")))), ",")
    held = fields.groupBy("document_id", "visit_id").agg(one("weight"), one("diagnosis"), F.nullif(procedures, F.lit("")).alias("procedures"))
    current = of_docs.filter("key = 'weight'").select("document_id", F.col("value").alias("current"))
    return listed.join(held, ["document_id", "visit_id"], "left").join(current, "document_id", "left").select("document_id", "visit_id", "date", "position", "weight", "diagnosis", "procedures", "current")


@query(f"WITH {_ORDER_VISITS}, s AS (SELECT *, length('- dd/mm/yyyy - 10:30 - Control caso 123456789' || chr(10) || 'Peso: ' || w || chr(10) || 'Diagnóstico: otitis 123456789') AS size FROM v) SELECT o_custkey::VARCHAR AS document_id, 'visit-' || lpad(no::VARCHAR, 3, '0') AS visit_id, strftime(day, '%Y-%m-%d') AS date, (sum(size + 1) OVER (PARTITION BY o_custkey ORDER BY k) - size - 1)::INT AS start, md5('- ' || strftime(day, '%d/%m/%Y') || ' - 10:30 - Control caso ' || c || chr(10) || 'Peso: ' || w || chr(10) || 'Diagnóstico: otitis ' || c) AS digest FROM s")
def visit_segments(spark, d):
    """The text of each visit."""
    docs = written(_histories(spark, d), "histories")
    seen = written(visits.occurrences(docs), "seen")
    dates = visits.detected_dates(visits.classified(_procedures(spark, d)), seen)
    roster = written(visit_chart.roster(dates, seen, visit_chart.no_visits(spark)[0]), "roster")
    return visits.segments(docs, seen, roster).join(roster, ["document_id", "visit_id"]).select("document_id", "visit_id", "date", "start", F.md5("segment").alias("digest"))


@query("""WITH a AS (SELECT o_custkey, strftime(o_orderdate, '%Y-%m-%d') AS date, o_orderkey AS k, length('- dd/mm/yyyy - 10:30 - Control caso 123456789' || chr(10) || 'Peso: ' || (o_orderkey % 100 + 1) || ' kg' || chr(10) || 'Diagnóstico: otitis 123456789') + 1 AS size FROM orders)
SELECT o_custkey::VARCHAR AS document_id, date, (sum(size) OVER (PARTITION BY o_custkey ORDER BY k) - size + 2)::BIGINT AS offset, row_number() OVER (PARTITION BY o_custkey, date ORDER BY k)::INT AS k FROM a""")
def history_occurrences(spark, d):
    """Where the histories name dates of visits."""
    return visits.occurrences(_histories(spark, d)).select("document_id", "date", F.col("offset").cast("long").alias("offset"), "k")


@query("""WITH x AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate::DATE DESC, o_orderkey DESC) AS r FROM orders) SELECT o_custkey::VARCHAR AS document_id, strftime(o_orderdate, '%Y-%m-%d') AS date, (o_orderkey % 100 + 1) || ' kg' AS weight FROM x WHERE r = 1""")
def history_weights(spark, d):
    """The last weight under the latest heading of each history."""
    return visits.latest_weight(_histories(spark, d)).select("document_id", "date", "weight")


_STORED = """s AS (SELECT o_custkey AS c, o_orderkey AS k, o_orderkey % 7 AS m, strftime(o_orderdate, '%d/%m/%Y') AS day, o_orderpriority AS clerk, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS place FROM orders WHERE o_custkey % 10 > 1)"""


def _stored(spark, d):
    """A stored record for each customer: a visit per order, some malformed; every tenth customer's payload is broken, every tenth's list is none."""
    o, c, m = table(spark, d, "orders"), F.col("o_custkey"), F.col("o_orderkey") % 7
    quoted = lambda x: F.concat(F.lit('"'), x, F.lit('"'))
    visit = F.concat(F.lit('{"visit_id": "v'), F.col("o_orderkey").cast("string"), F.lit('", "visit_date": '), F.when(m == 1, F.lit("17")).otherwise(quoted(F.date_format("o_orderdate", "dd/MM/yyyy"))), F.when(m == 2, F.concat(F.lit(', "clerk": '), quoted(F.col("o_orderpriority")))).otherwise(""), F.lit(', "fields": '), F.when(m == 3, F.lit('{"a": 1}')).otherwise(F.concat(F.lit('[{"key": "weight", "value": "'), (F.col("o_orderkey") % 100 + 1).cast("string"), F.lit(' kg"}]'))), F.lit("}"))
    part = F.when(m == 0, quoted(F.col("o_orderkey").cast("string"))).otherwise(visit)
    whole = o.groupBy(c.alias("document_id")).agg(F.array_sort(F.collect_list(F.struct("o_orderkey", part.alias("part")))).alias("parts"))
    body = F.concat(F.lit('{"visits": ['), F.array_join(F.transform("parts", lambda p: p["part"]), ", "), F.lit("]}"))
    tenth = F.col("document_id") % 10
    return whole.select(F.col("document_id").cast("string").alias("document_id"), F.when(tenth == 0, F.lit('{"visits": [')).when(tenth == 1, F.lit('{"visits": 5}')).otherwise(body).alias("payload"))


@query(f"""WITH {_STORED}, g AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY place) AS no FROM s WHERE m <> 0) SELECT c::VARCHAR AS document_id, 'v' || k AS visit_id, CASE WHEN m <> 1 THEN strftime(strptime(day, '%d/%m/%Y'), '%Y-%m-%d') END AS date, no::INT AS no, CASE WHEN m = 2 THEN '{{"clerk":"' || clerk || '"}}' END AS rest, CASE WHEN m <> 3 THEN (k % 100 + 1) || ' kg' END AS weight FROM g""")
def stored_visits(spark, d):
    """Visits and their fields out of stored records, with members of other names."""
    v, f, _ = visit_chart.parsed_visits(_stored(spark, d))
    return v.join(f.select("document_id", "visit_id", F.col("value").alias("weight")), ["document_id", "visit_id"], "left").select("document_id", "visit_id", "date", "no", "rest", "weight")


@query(f"""WITH {_STORED} SELECT c::VARCHAR AS document_id, CASE m WHEN 0 THEN 'VISIT_NOT_AN_OBJECT' ELSE 'FIELDS_NOT_A_LIST' END AS reason, CASE m WHEN 0 THEN '"' || k || '"' ELSE '{{"a":1}}' END AS part FROM s WHERE m IN (0, 3)
UNION ALL SELECT DISTINCT o_custkey::VARCHAR, CASE o_custkey % 10 WHEN 0 THEN 'PAYLOAD_NOT_AN_OBJECT' ELSE 'VISITS_NOT_A_LIST' END, CASE o_custkey % 10 WHEN 0 THEN '{{"visits": [' ELSE '5' END FROM orders WHERE o_custkey % 10 < 2""")
def refused_payload_parts(spark, d):
    """What stored records hold in place of visits and fields."""
    return visit_chart.parsed_visits(_stored(spark, d))[2]


# ---- clinical cards composed of the tables: a customer is a document, of one of three kinds

_PETS, _OWNERS = ("Luna", "Toby", "Kira", "Nico", "Thor"), ("Ana García", "Juan Pérez", "Eva Gil", "Luis Mora", "Rosa Soler")
_CARDS = (
    "Clínica Veterinaria Sol\nPaciente: {pet}\nEspecie: Canina\nRaza: Labrador\nSexo: Hembra\nFecha de nacimiento: 05/07/{year}\nMicrochip: {chip}\nPeso: {kg},5 kg\nPropietario: {owner}\nFecha de visita: 11/02/2026\nDiagnóstico: otitis externa\nTratamiento: gotas óticas\n",
    "HISTORIAL CLÍNICO\nHospital Veterinario Norte\nC/ Mayor {kg}, 28001 Madrid\nDatos del paciente\nNombre: {pet}\nEspecie/Raza: Felino / Siamés\nSexo: M\nNacimiento: {year}-03-04\nChip nº {chip}\nTitular: {owner}\nDomicilio: Calle Luna {kg}, 28013 Madrid\nEdad: 5 años\nPeso 3500 g\n",
    "Centro Veterinario Mar\nMascota: {pet}\nPerra mestiza\nHembra\n- 05/02/2024 - 10:30 - Consulta\nPeso: {kg} kg\nDiagnóstico: gastritis\nVeterinaria: Dra. Marta Ruiz\nPropietaria: {owner}\n",
)
#: kind, key, value, confidence, first number of its rank, and the start of the line that holds its evidence; '' where the evidence is no part of a line.
_CARD_VALUES = """(0, 'clinic_name', 'Clínica Veterinaria Sol', 0.5, 0, 'Clínica'), (0, 'pet_name', '{pet}', 0.66, 1, 'Paciente'), (0, 'species', 'Canina', 0.66, 0, 'Especie'), (0, 'breed', 'Labrador', 0.66, 0, 'Raza'), (0, 'sex', 'Hembra', 0.66, 0, 'Sexo'), (0, 'dob', '05/07/{year}', 0.66, 0, 'Fecha de nac'),
(0, 'microchip_id', '{chip}', 0.66, 2.5, 'Microchip'), (0, 'weight', '{kg},5 kg', 0.66, 0, 'Peso'), (0, 'owner_name', '{owner}', 0.66, 0, 'Propietario'), (0, 'visit_date', '11/02/2026', 0.66, 0, 'Fecha de vis'), (0, 'diagnosis', 'otitis externa', 0.66, 0, 'Diagn'), (0, 'medication', 'gotas óticas', 0.66, 0, 'Tratamiento'), (0, 'treatment_plan', 'gotas óticas', 0.66, 0, 'Tratamiento'), (0, 'document_date', '05/07/{year}', 0.5, 0, ''), (0, 'language', 'es', 0.5, 0, ''),
(1, 'clinic_name', 'Hospital Veterinario Norte', 0.5, 2, 'Hospital'), (1, 'clinic_address', 'C/ Mayor {kg}, 28001 Madrid', 0.5, 2.5, 'Hospital'), (1, 'pet_name', '{pet}', 0.66, 1, 'Nombre'), (1, 'species', 'Felino / Siamés', 0.66, 0, 'Especie'), (1, 'breed', 'Felino / Siamés', 0.66, 0, 'Especie'), (1, 'sex', 'M', 0.66, 0, 'Sexo'), (1, 'dob', '{year}-03-04', 0.66, 0, 'Nacimiento'),
(1, 'microchip_id', '{chip}', 0.66, 2.5, 'Chip'), (1, 'owner_name', '{owner}', 0.66, 0, 'Titular'), (1, 'owner_address', 'Calle Luna {kg}, 28013 Madrid', 0.66, 2.5, 'Domicilio'), (1, 'age', '5 años', 0.66, 0, 'Edad'), (1, 'weight', '3500 g', 0.66, 0, 'Peso'), (1, 'document_date', '{year}-03-04', 0.5, 1, ''), (1, 'language', 'es', 0.5, 0, ''),
(2, 'clinic_name', 'Centro Veterinario Mar', 0.5, 2, 'Centro'), (2, 'pet_name', '{pet}', 0.66, 1, 'Mascota'), (2, 'sex', 'hembra', 0.5, 0, 'Hembra'), (2, 'weight', '{kg} kg', 0.66, 0, 'Peso'), (2, 'diagnosis', 'gastritis', 0.66, 0, 'Diagn'), (2, 'vet_name', 'Dra. Marta Ruiz', 0.66, 0, 'Veterinaria'), (2, 'owner_name', '{owner}', 0.66, 0, 'Propietaria'), (2, 'visit_date', '05/02/2024', 0.66, 4, ''), (2, 'document_date', '05/02/2024', 0.5, 0, '')"""
_CARD_SQL = f"""c AS (SELECT c_custkey, c_custkey % 3 AS kind, (['{"', '".join(_PETS)}'])[c_custkey % 5 + 1] AS pet, (['{"', '".join(_OWNERS)}'])[c_custkey // 5 % 5 + 1] AS owner, (941000000000000 + c_custkey)::VARCHAR AS chip, (c_custkey % 80 + 1)::VARCHAR AS kg, (2010 + c_custkey % 12)::VARCHAR AS year FROM customer)"""


def _cards(spark, d):
    k = F.col("c_custkey")
    one = lambda names, n: F.element_at(F.array(*map(F.lit, names)), (n % len(names) + 1).cast("int"))
    text = F.element_at(F.array(*map(F.lit, _CARDS)), (k % 3 + 1).cast("int"))
    for name, value in (("pet", one(_PETS, k)), ("owner", one(_OWNERS, F.floor(k / 5))), ("chip", (F.lit(941000000000000) + k).cast("string")), ("kg", (k % 80 + 1).cast("string")), ("year", (F.lit(2010) + k % 12).cast("string"))):
        text = F.replace(text, F.lit(f"{{{name}}}"), value)
    return table(spark, d, "customer").select(k.cast("string").alias("document_id"), text.alias("text"))


@query(f"""WITH {_CARD_SQL}, e(kind, key, value, confidence, k1, line) AS (VALUES {_CARD_VALUES})
SELECT c_custkey::VARCHAR AS document_id, key, replace(replace(replace(replace(replace(value, '{{pet}}', pet), '{{owner}}', owner), '{{chip}}', chip), '{{kg}}', kg), '{{year}}', year) AS value, confidence::DOUBLE AS confidence, k1::DOUBLE AS k1 FROM c JOIN e USING (kind)""")
def card_candidates(spark, d):
    """The best candidate of each field of each card, with its confidence and the first number of its rank."""
    best = mining.ranked(mining.placed(_cards(spark, d))).filter("rank = 1")
    return best.select("document_id", "key", "value", "confidence", "k1")


@query(f"""WITH {_CARD_SQL} SELECT c_custkey::VARCHAR AS document_id, pet AS pet_name, owner AS owner_name,
CASE kind WHEN 0 THEN 'Clínica Veterinaria Sol' WHEN 1 THEN 'Hospital Veterinario Norte' ELSE 'Centro Veterinario Mar' END AS clinic_name, CASE kind WHEN 1 THEN 'Calle Mayor ' || kg || ', 28001 Madrid' END AS clinic_address, CASE kind WHEN 2 THEN 'Dra. Marta Ruiz' END AS vet_name, CASE kind WHEN 1 THEN 'Calle Luna ' || kg || ', 28013 Madrid' END AS owner_address,
CASE kind WHEN 0 THEN 'canino' WHEN 1 THEN 'felino' END AS species, CASE kind WHEN 0 THEN 'Labrador' WHEN 1 THEN 'Siamés' END AS breed, CASE WHEN kind <> 1 THEN 'hembra' END AS sex, CASE WHEN kind <> 2 THEN chip END AS microchip_id, CASE kind WHEN 0 THEN kg || ',5 kg' WHEN 1 THEN '3500 g' ELSE kg || ' kg' END AS weight,
CASE kind WHEN 0 THEN '05/07/' || year WHEN 1 THEN '04/03/' || year END AS dob, CASE kind WHEN 0 THEN (2025 - year::INT)::VARCHAR WHEN 1 THEN '5 años' END AS age, CASE kind WHEN 0 THEN 'derived' WHEN 1 THEN 'extracted' END AS age_origin, CASE kind WHEN 0 THEN '11/02/2026' WHEN 2 THEN '05/02/2024' END AS visit_date, CASE kind WHEN 0 THEN '05/07/' || year WHEN 1 THEN '04/03/' || year ELSE '05/02/2024' END AS document_date,
CASE kind WHEN 0 THEN 'otitis externa' WHEN 2 THEN 'gastritis' ELSE '' END AS diagnosis, CASE kind WHEN 0 THEN 'gotas óticas' ELSE '' END AS medication, CASE WHEN kind <> 2 THEN 'es' END AS language FROM c""")
def card_records(spark, d):
    """The canonical record of each card."""
    r = record.of_texts(_cards(spark, d), F.lit("2026-03-01").cast("date"))[0]
    single = ("pet_name", "owner_name", "clinic_name", "clinic_address", "vet_name", "owner_address", "species", "breed", "sex", "microchip_id", "weight", "dob", "age", "age_origin", "visit_date", "document_date", "language")
    return r.select("document_id", *single, *(F.array_join(F.coalesce(k, F.array().cast("array<string>")), ",").alias(k) for k in ("diagnosis", "medication")))


@query(f"""WITH {_CARD_SQL}, e(kind, key, value, confidence, k1, line) AS (VALUES {_CARD_VALUES}),
t(kind, lines) AS (VALUES {", ".join(f"({i}, {t.splitlines()})" for i, t in enumerate(_CARDS))}),
n AS (SELECT e.kind, e.key, list_position(list_transform(lines, lambda x: starts_with(x, line)), true) AS no FROM e JOIN t USING (kind) WHERE line <> ''),
k AS (SELECT unnest(['pet_name', 'weight', 'sex', 'age', 'owner_name', 'microchip_id', 'vet_name']) AS key)
SELECT c_custkey::VARCHAR AS document_id, k.key, CASE WHEN n.no IS NULL THEN 'missing' ELSE 'accepted' END AS status, n.no::INT AS line_number FROM c CROSS JOIN k LEFT JOIN n ON n.kind = c.kind AND n.key = k.key""")
def card_coverage(spark, d):
    """Which fields of each card were found, and the lines of their evidence."""
    docs = _cards(spark, d)
    best = mining.ranked(mining.mine(docs))
    found = observe.coverage(best, best.filter("rank = 1").select("document_id", "key"), docs, ["pet_name", "weight", "sex", "age", "owner_name", "microchip_id", "vet_name"])
    return found.select("document_id", "key", "status", "line_number")


# ---- ages, views, sections

@query(f"""WITH x AS (SELECT c_custkey AS c, c_custkey % 6 AS m, make_date(2023 - (c_custkey % 9)::INT, 1 + (c_custkey % 12)::INT, 1 + (c_custkey % 28)::INT) AS born FROM customer), v AS (SELECT user_id AS c, max(ts)::DATE AS day FROM events WHERE ts < TIMESTAMP '2024-01-21' GROUP BY user_id),
y AS (SELECT x.*, coalesce(v.day, DATE '2024-01-20') AS on_day FROM x LEFT JOIN v USING (c)), z AS (SELECT *, year(on_day) - year(born) - CASE WHEN strftime(on_day, '%m%d') < strftime(born, '%m%d') THEN 1 ELSE 0 END AS years, (year(on_day) - year(born)) * 12 + month(on_day) - month(born) - CASE WHEN day(on_day) < day(born) THEN 1 ELSE 0 END AS months FROM y)
SELECT c::VARCHAR AS document_id, CASE m WHEN 1 THEN '7' WHEN 2 THEN 'viejo' WHEN 3 THEN '1' ELSE years::VARCHAR END AS age, CASE WHEN m IN (1, 2) THEN 'machine' WHEN m = 3 THEN 'human' ELSE 'derived' END AS origin, CASE m WHEN 1 THEN '7 años' WHEN 2 THEN NULL WHEN 3 THEN '1 año' ELSE CASE WHEN years < 1 THEN months || CASE WHEN months = 1 THEN ' mes' ELSE ' meses' END ELSE years || CASE WHEN years = 1 THEN ' año' ELSE ' años' END END END AS display_value, m <> 3 AS made FROM z WHERE m <> 0""")
def review_ages(spark, d):
    """Age fields after review's projection: of records with an age, with a person's age field, and with a birth date only."""
    k, c = F.col("c_custkey"), table(spark, d, "customer")
    m, doc = k % 6, k.cast("string").alias("document_id")
    born = F.make_date((F.lit(2023) - k % 9).cast("int"), (k % 12 + 1).cast("int"), (k % 28 + 1).cast("int"))
    none = F.lit(None).cast("string")
    records = c.select(doc, F.when(m == 1, "7").when(m == 2, "viejo").alias("age"), F.when(m != 0, F.date_format(born, "dd/MM/yyyy")).alias("dob"), none.alias("document_date"))
    fields = c.filter(m == 3).select(doc, F.lit("f1").alias("field_id"), F.lit("age").alias("key"), F.lit(" 1 ").alias("value"), F.lit("human").alias("origin"), none.alias("display_value"), F.lit(1).alias("seq"))
    seen = table(spark, d, "events").select(F.col("user_id").cast("string").alias("document_id"), F.date_format("ts", "yyyy-MM-dd").alias("date"))
    ages = review_projection.projected_ages(records, fields, seen, F.lit("2024-01-20").cast("date"))
    return review_projection.upsert_ages(fields, ages).select("document_id", F.col("value").alias("age"), "origin", "display_value", (F.col("field_id") == "backfill-age").alias("made"))


@query("""SELECT o_custkey::VARCHAR AS document_id, 'mvp-1' AS version, 7 AS n_sections, 17 AS n_slots, CASE WHEN o_custkey % 10 = 1 THEN 0 ELSE count(*) END AS n_visits FROM orders WHERE o_custkey % 10 <> 0 GROUP BY o_custkey""")
def canonical_views(spark, d):
    """The canonical view of stored records without one of their own."""
    v = review_projection.canonical_view(_stored(spark, d))
    size = lambda c: F.json_array_length(c).cast("int")
    return v.select("document_id", "version", size("sections").alias("n_sections"), size("field_slots").alias("n_slots"), size("visits").alias("n_visits"))


@query("""WITH f AS (SELECT o_custkey AS d, o_orderpriority AS key, min(o_orderkey) AS seq, min_by(o_orderstatus, o_orderkey) AS t FROM orders WHERE o_orderstatus <> 'P' GROUP BY o_custkey, o_orderpriority) SELECT d AS document_id, key, (2999 + row_number() OVER (PARTITION BY d ORDER BY seq))::INT AS position, t AS value_type FROM f""")
def visit_definitions(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("document_id"), F.col("o_orderpriority").alias("key"), F.col("o_orderkey").alias("seq"), F.col("o_orderstatus").alias("value_type"), F.lit("visit").alias("scope"), F.when(F.col("o_orderstatus") == "P", "other").alias("classification"), F.lit(None).cast("boolean").alias("is_critical"))
    return review_projection.visit_definitions(o).select("document_id", "key", "position", "value_type")


@query("""WITH e AS (SELECT user_id, event_id, event_type, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events)
SELECT a.event_id, max(b.event_id) FILTER (b.event_type = 'purchase' AND b.r < a.r) IS NOT NULL AS has_before, max(b.ts) FILTER (b.event_type = 'purchase' AND b.ts <= a.ts) AS begins, min(b.ts) FILTER (b.event_type = 'purchase' AND b.ts > a.ts) AS ends FROM e a JOIN e b USING (user_id) WHERE a.event_type = 'error' GROUP BY a.event_id, a.r""")
def enclosing_boundaries(spark, d):
    """The purchases before and after each error of a user."""
    e = table(spark, d, "events").select("user_id", "event_id", "event_type", "ts")
    m = keyed.enclosed(e.filter("event_type = 'error'"), e.filter("event_type = 'purchase'").select("user_id", F.col("ts").alias("mark")), ["user_id"], "ts", "mark")
    return m.select("event_id", F.col("begins").isNotNull().alias("has_before"), "begins", "ends")


@query("""WITH x AS (SELECT o_custkey, o_orderkey, o_orderkey * 3 % 7 AS a, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_orderkey % 5 END AS b, o_orderstatus AS s, o_orderpriority AS p FROM orders)
SELECT o_orderkey, a - lag(a) OVER w AS a_delta, CASE WHEN lag(o_orderkey) OVER w IS NOT NULL THEN coalesce(b, 0) - coalesce(lag(b) OVER w, 0) END AS b_delta, lag(o_orderkey) OVER w IS NOT NULL AND s IS DISTINCT FROM lag(s) OVER w AS status_changed, lag(o_orderkey) OVER w IS NOT NULL AND p IS DISTINCT FROM lag(p) OVER w AS priority_changed FROM x WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)""")
def goal_changes(spark, d):
    """Counts and several fields of each snapshot (an order) against the one before of the same document (a customer)."""
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", (F.col("o_orderkey") * 3 % 7).alias("a"), F.when(F.col("o_orderkey") % 4 != 0, F.col("o_orderkey") % 5).alias("b"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"))
    c = keyed.changes(keyed.count_deltas(o, ["o_custkey"], ["o_orderkey"], ["a", "b"]), ["o_custkey"], ["o_orderkey"], ["status", "priority"])
    return c.select("o_orderkey", "a_delta", "b_delta", F.col("changed_status").alias("status_changed"), F.col("changed_priority").alias("priority_changed"))


# ---- small forms: cuts, hints, chips, steps, lookups

@query("SELECT doc_id, CASE WHEN length(text) > 180 THEN rtrim(left(text, 179), ' ') || '…' ELSE text END AS snippet, left(text, 220) AS evidence, left(text, 80) AS preview, left(text, 30) AS sample FROM documents")
def text_cuts(spark, d):
    return table(spark, d, "documents").select("doc_id", *text.cuts(F.col("text")))


@query("SELECT conv_id, turn, CASE WHEN turn > 0 THEN 'page:' || turn || CASE WHEN role = 'user' THEN ' | snippet:' || left(trim(text), 80) ELSE '' END WHEN role = 'user' THEN 'snippet:' || left(trim(text), 80) END AS hint FROM conversations")
def source_hints(spark, d):
    page, snippet = F.when(F.col("turn") > 0, F.col("turn")), F.when(F.col("role") == "user", F.col("text"))
    return table(spark, d, "conversations").select("conv_id", "turn", scores.source_hint(page, snippet).alias("hint"))


@query("SELECT p_partkey, CASE p_partkey % 4 WHEN 3 THEN NULL ELSE (900000000 + p_partkey)::VARCHAR END AS chip FROM part")
def chips_with_evidence(spark, d):
    """Chip numbers from a labelled value, from digits in groups with another label after them, from the evidence, and none."""
    k, n = F.col("p_partkey") % 4, (F.lit(900000000) + F.col("p_partkey")).cast("string")
    value = F.when(k == 0, F.concat(F.lit("Microchip: "), n)).when(k == 1, F.concat(F.substring(n, 1, 3), F.lit("-"), F.substring(n, 4, 3), F.lit(" "), F.substring(n, 7, 3), F.lit(" Especie"))).otherwise("id: ")
    snippet = F.when(k == 2, F.concat(F.lit("Transponder nº: "), n, F.lit("; canino"))).otherwise("chip: no consta")
    return table(spark, d, "part").select("p_partkey", normal.chip_with_evidence(value, snippet).alias("chip"))


@query("""WITH s AS (SELECT event_id, user_id, ts, event_type, CASE event_type WHEN 'error' THEN 'FAILED' WHEN 'view' THEN 'RUNNING' ELSE 'SUCCEEDED' END AS status FROM events)
SELECT event_id AS run_id, 'RUNNING' AS status, NULL::VARCHAR AS error_code, NULL::BIGINT AS took FROM s UNION ALL SELECT event_id, status, CASE WHEN status = 'FAILED' THEN 'E' || user_id END, event_id % 100 FROM s WHERE status <> 'RUNNING'""")
def step_event_log(spark, d):
    e = table(spark, d, "events")
    status = F.when(F.col("event_type") == "error", "FAILED").when(F.col("event_type") == "view", "RUNNING").otherwise("SUCCEEDED")
    end = F.when(status != "RUNNING", F.col("ts") + F.make_dt_interval(secs=F.col("event_id") % 100))
    steps = e.select(F.col("event_id").alias("run_id"), F.lit("EXTRACTION").alias("step"), F.lit(1).alias("attempt"), F.col("ts").alias("started_at"), end.alias("ended_at"), status.alias("status"), F.concat(F.lit("E"), F.col("user_id").cast("string")).alias("error_code"))
    took = F.floor((_micros("ended_at") - _micros("started_at")) / 1000000)
    return state.step_events(steps).select("run_id", "status", "error_code", took.alias("took"))


@query("SELECT event_id, CASE event_id % 5 WHEN 0 THEN NULL WHEN 1 THEN '<1s' ELSE (event_id % 5 * 30) || 's' END AS shown FROM events")
def step_durations(spark, d):
    k = F.col("event_id") % 5
    begin = F.col("ts").cast("timestamp")
    end = F.when(k == 0, begin - F.expr("INTERVAL 30 SECOND")).when(k == 1, begin).otherwise(begin + F.make_dt_interval(secs=k * 30))
    return table(spark, d, "events").select("event_id", state.duration_shown(begin, end).alias("shown"))


@query("""WITH a AS (SELECT o_custkey, l_orderkey, l_linenumber, l_shipdate FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_returnflag = 'R') SELECT o_custkey AS document_id, arg_max(l_orderkey * 10 + l_linenumber, (l_shipdate, l_orderkey * 10 + l_linenumber)) AS artifact_id FROM a GROUP BY o_custkey""")
def latest_document_artifacts(spark, d):
    """Of each document the newest artifact of one type over all of its runs: customers, orders and line items."""
    a = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("run_id"), F.col("l_returnflag").alias("artifact_type"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("artifact_id"), F.col("l_shipdate").alias("created_at"))
    runs = table(spark, d, "orders").select(F.col("o_orderkey").alias("run_id"), F.col("o_custkey").alias("document_id"))
    return keyed.latest(state.artifacts_of_documents(a, runs, "R"), ["document_id"], ["created_at", "artifact_id"]).select("document_id", "artifact_id")


@query("""SELECT s_suppkey, u.n_name AS name FROM supplier LEFT JOIN (SELECT s_nationkey AS address, min(s_name) AS n_name FROM supplier GROUP BY s_nationkey HAVING count(DISTINCT s_name) = 1) u ON address = s_nationkey""")
def reverse_lookup(spark, d):
    """The one name that an address of the catalog has, if it is one: a supplier's nation as its address."""
    s = table(spark, d, "supplier").select("s_suppkey", F.col("s_nationkey").alias("address"), F.col("s_name").alias("name"))
    return keyed.unique_match(s.drop("name"), s.select("address", "name"), "address", "name").select("s_suppkey", "name")


# ---- edits in chains, calibration by increments, stores, streams

_CHAIN = """e AS (SELECT o_custkey AS d, o_orderkey AS batch, row_number() OVER w AS i, 1 + coalesce(count(*) FILTER (o_orderkey % 5 <> 0) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS base,
 CASE WHEN o_orderkey % 5 = 0 THEN 'UPDATE' WHEN o_orderkey % 11 = 0 THEN 'DELETE' WHEN o_orderkey % 13 = 0 THEN 'ADD' ELSE 'UPDATE' END AS op, CASE WHEN o_orderkey % 5 = 0 THEN '-1' ELSE o_custkey::VARCHAR END AS field, CASE WHEN o_orderkey % 3 = 0 THEN o_orderstatus ELSE o_orderpriority END AS value FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)),
r AS (SELECT c_custkey AS d, 0::BIGINT AS i, 1::BIGINT AS version, c_name AS value, true AS has, NULL::BIGINT AS batch, NULL::VARCHAR AS old, NULL::VARCHAR AS op, NULL::VARCHAR AS error, NULL::BIGINT AS base FROM customer
 UNION ALL SELECT d, i, CASE WHEN error IS NULL THEN version + 1 ELSE version END, CASE WHEN error IS NOT NULL THEN old WHEN op = 'DELETE' THEN NULL ELSE value END, CASE WHEN error IS NOT NULL THEN has WHEN op = 'DELETE' THEN false ELSE true END, batch, old, op, error, base
 FROM (SELECT r.d, e.i, r.version, r.has, r.value AS old, e.value, e.batch, e.op, e.base, CASE WHEN e.base <> r.version THEN 'BASE_VERSION_MISMATCH' WHEN e.field = '-1' OR (e.op <> 'ADD' AND NOT r.has) THEN 'FIELD_NOT_FOUND' WHEN e.op = 'ADD' AND r.has THEN 'FIELD_EXISTS' END AS error FROM r JOIN e ON e.d = r.d AND e.i = r.i + 1))"""


def _chained(spark, d):
    """A batch per order with one edit of its customer's name, made on the version that it would be if no earlier one but those of an unknown field had failed."""
    o, k = table(spark, d, "orders"), F.col("o_orderkey")
    before = F.count_if(k % 5 != 0).over(Window.partitionBy("o_custkey").orderBy("o_orderkey").rowsBetween(Window.unboundedPreceding, -1))
    op = F.when(k % 5 == 0, "UPDATE").when(k % 11 == 0, "DELETE").when(k % 13 == 0, "ADD").otherwise("UPDATE")
    edits = o.select(F.col("o_custkey").alias("document_id"), k.alias("batch"), (F.lit(1) + F.coalesce(before, F.lit(0))).alias("version"), F.lit(0).alias("seq"), op.alias("op"), F.when(k % 5 == 0, "-1").otherwise(F.col("o_custkey").cast("string")).alias("field_id"), F.when(k % 3 == 0, F.col("o_orderstatus")).otherwise(F.col("o_orderpriority")).alias("value"), F.lit("string").alias("kind"))
    fields = table(spark, d, "customer").select(F.col("c_custkey").alias("document_id"), F.col("c_custkey").alias("field_id"), F.lit(1).alias("version"), F.col("c_name").alias("value"))
    return edit_chain.apply_edit_chain(fields, edits)


@query(f"WITH RECURSIVE {_CHAIN} SELECT batch, version::INT AS version, op, old AS old_value, CASE WHEN op <> 'DELETE' THEN value END AS new_value FROM r WHERE i > 0 AND error IS NULL AND NOT (op = 'UPDATE' AND trim(old) = trim(value))")
def edit_chain_log(spark, d):
    return _chained(spark, d)[1].select("batch", "version", "op", "old_value", "new_value")


@query(f"WITH RECURSIVE {_CHAIN} SELECT d::VARCHAR AS document_id, version::INT AS version, value FROM (SELECT *, row_number() OVER (PARTITION BY d ORDER BY i DESC) AS k FROM r) WHERE k = 1 AND has")
def edit_chain_fields(spark, d):
    return _chained(spark, d)[0].select("document_id", "version", "value")


@query(f"WITH RECURSIVE {_CHAIN} SELECT d::VARCHAR AS document_id, batch, base::INT AS version, error FROM r WHERE error IS NOT NULL")
def edit_chain_refused(spark, d):
    return _chained(spark, d)[2]


_RETRACTIONS = """x AS (SELECT user_id, event_id, (event_type = 'view')::INT AS a, (event_type = 'click')::INT AS e, ts AS tm, 0 AS k FROM events WHERE event_type IN ('view', 'click')
 UNION ALL SELECT user_id, event_id, -(event_type = 'view')::INT, -(event_type = 'click')::INT, CASE WHEN value > 60 THEN ts - INTERVAL 6 HOUR ELSE ts + INTERVAL 6 HOUR END, 1 FROM events WHERE event_type IN ('view', 'click') AND value > 30)"""


@query(f"""WITH {_RETRACTIONS}, y AS (SELECT *, sum(a) OVER w AS ra, sum(e) OVER w AS re FROM x WINDOW w AS (PARTITION BY user_id ORDER BY tm, event_id, k ROWS UNBOUNDED PRECEDING))
SELECT user_id, (sum(a) - least(0, min(ra)))::BIGINT AS accept_count, (sum(e) - least(0, min(re)))::BIGINT AS edit_count FROM y GROUP BY user_id""")
def calibration_increments(spark, d):
    """Counts kept up in four increments of deltas and retractions, some of which come before what they take back; the SQL counts anew over all."""
    e = table(spark, d, "events").filter(F.col("event_type").isin("view", "click"))
    deltas = e.select("user_id", "event_id", F.col("event_id").alias("snapshot_id"), (F.col("event_type") == "view").cast("int").alias("accept_delta"), (F.col("event_type") == "click").cast("int").alias("edit_delta"), F.col("ts").alias("at"), "value")
    undone = deltas.filter("value > 30").select("snapshot_id", F.lit("reverted").alias("status"))
    late = F.when(F.col("value") > 60, F.expr("at - INTERVAL 6 HOUR")).otherwise(F.expr("at + INTERVAL 6 HOUR"))
    back = state.reverted(deltas, undone).withColumn("at", late)
    every = deltas.withColumn("k", F.lit(0)).unionByName(back.withColumn("k", F.lit(1))).withColumn("day", F.date_format("at", "yyyy-MM-dd"))
    scope, held = ["user_id"], None
    for first, past in (("", "2024-01-08"), ("2024-01-08", "2024-01-15"), ("2024-01-15", "2024-01-22"), ("2024-01-22", "9")):
        new = state.calibration_state(every.filter((F.col("day") >= first) & (F.col("day") < past)), scope, ["at", "event_id", "k"])
        held = new if held is None else state.added_state(held, new, scope)
    return state.state_counts(held, scope)


@query("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def event_log_latest(spark, d):
    """The latest event of each user, kept by a stream over the events; it is run twice, and the second run finds nothing new."""
    events = table(spark, d, "events").select("user_id", "event_id", "event_type", "ts")
    stream = spark.readStream.schema(table(spark, d, "events").schema).option("pathGlobFilter", "events.parquet").parquet(d).select(*events.columns)
    path = f"{shared_dir(spark).rstrip('/')}/event-log-{uuid.uuid4().hex}"
    keys, order = ["user_id"], ["ts", "event_id"]
    for _ in range(2):
        merge.keep_latest(stream, f"{path}/log", f"{path}/checkpoint", keys, order)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in events.schema)
    return merge.current(spark, f"{path}/log", keys, order, schema).select("user_id", "event_id", "event_type")


@query("SELECT conv_id::VARCHAR AS document_id, turn::VARCHAR AS run_id, CASE WHEN role = 'user' THEN md5(text) END AS digest FROM conversations")
def raw_text_store(spark, d):
    """Texts written to the store, and all turns with what the store has for them: those of users."""
    c = table(spark, d, "conversations").select(F.col("conv_id").cast("string").alias("document_id"), F.col("turn").cast("string").alias("run_id"), "role", "text")
    path = f"{shared_dir(spark).rstrip('/')}/texts-{uuid.uuid4().hex}"
    write_raw_texts(c.filter("role = 'user'"), path)
    return read_raw_texts(spark, path, c.select("document_id", "run_id")).select("document_id", "run_id", F.md5("text").alias("digest"))


@query("""SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'Calle ' || c_name || ' , ' || (c_custkey % 200 + 1) || ', ' || (28000 + c_custkey % 1000) || ' Madrid' WHEN 1 THEN 'Edificio ' || c_mktsegment || ' & hijos, ' || (28000 + c_custkey % 1000) END AS address FROM customer""")
def snippet_addresses(spark, d):
    """Addresses out of a snippet of markup for each customer: after a street's word, after a label, and none. A tag is a blank."""
    k, c = F.col("c_custkey"), F.concat
    post, m = (F.lit(28000) + k % 1000).cast("string"), k % 3
    direct = c(F.lit("Hospital <b>Sol</b>&nbsp;Calle <i>"), F.col("c_name"), F.lit("</i>,  "), (k % 200 + 1).cast("string"), F.lit(", "), post, F.lit(" Madrid Tel&eacute;fono 91 000 00 00"))
    label = c(F.lit("Direcci&oacute;n: Edificio "), F.col("c_mktsegment"), F.lit(" &amp; hijos, "), post, F.lit(" Horario: 9 a 20."))
    return web_addresses.snippet_addresses(table(spark, d, "customer").select("c_custkey", F.when(m == 0, direct).when(m == 1, label).otherwise(F.col("c_name")).alias("snippet")), "c_custkey", "snippet")


@query()
def page_addresses(spark, d):
    """The first address that each page shows; tests hold it against worked pages."""
    return web_addresses.page_addresses(table(spark, d, "pages"))


# ---- the reader's view

@query("""WITH f AS (SELECT l_suppkey AS d, l_returnflag || l_linestatus AS k, min(CASE WHEN l_quantity / 50 < 0.5 THEN 0 WHEN l_quantity / 50 < 0.75 THEN 1 ELSE 2 END) AS r FROM lineitem GROUP BY l_suppkey, l_returnflag || l_linestatus)
SELECT d AS document_id, count(*) FILTER (r = 0) AS low, count(*) FILTER (r = 1) AS medium, count(*) FILTER (r = 2) AS high, 0::BIGINT AS unknown FROM f GROUP BY d""")
def worst_bands(spark, d):
    li = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("document_id"), F.concat("l_returnflag", "l_linestatus").alias("key"), F.lit("x").alias("value"), (F.col("l_quantity") / 50).alias("confidence"))
    return view.worst_bands(view.bands(li))


@query("""WITH o AS (SELECT o_custkey, o_orderstatus, o_orderkey, o_totalprice FROM orders WHERE o_orderstatus <> 'F'), g AS (SELECT o_custkey AS document_id, o_orderstatus AS key, count(*) AS n, min(o_orderkey) AS f FROM o GROUP BY o_custkey, o_orderstatus)
SELECT document_id, key, n > 1 AS many, row_number() OVER (PARTITION BY document_id ORDER BY f)::INT AS position FROM g""")
def other_field_groups(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("document_id"), F.col("o_orderstatus").alias("key"), F.col("o_orderkey").alias("seq"), F.col("o_totalprice").cast("string").alias("value"))
    return view.other_fields(o, spark.createDataFrame([("F",)], "key string")).select("document_id", "key", "many", "position")


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN '—' WHEN o_orderkey % 4 = 1 THEN strftime(o_orderdate, '%d/%m/%Y') ELSE o_orderpriority END AS shown FROM orders""")
def display_values(spark, d):
    k = F.col("o_orderkey") % 4
    value = F.when(k == 0, " ").when(k == 1, F.date_format("o_orderdate", "yyyy-MM-dd")).otherwise(F.col("o_orderpriority"))
    return table(spark, d, "orders").select("o_orderkey", view.display(value, F.when(k == 1, "date").otherwise("string")).alias("shown"))


@query("""SELECT event_type, user_id, min(event_id) AS first_event FROM events GROUP BY event_type, user_id""")
def distinct_event_keys(spark, d):
    e = table(spark, d, "events").select("event_id", "event_type", "user_id")
    return keyed.first_of(e, ["event_type", "user_id"], [F.asc("event_id")]).select("event_type", "user_id", F.col("event_id").alias("first_event"))


@query("""SELECT DISTINCT user_id, event_type, event_id % 2 = 0 AS even, value > 50 AS large FROM events""")
def distinct_events(spark, d):
    """Debug events that agree in all seven parts are one."""
    e = table(spark, d, "events")
    parts = e.select(F.col("user_id").alias("document_id"), F.col("event_type").alias("field"), (F.col("event_id") % 2 == 0).alias("status"), (F.col("value") > 50).alias("raw"), F.lit("n").alias("normalized"), F.lit(None).cast("string").alias("reason"), F.lit(1).alias("page"))
    return view.distinct_events(parts).select(F.col("document_id").alias("user_id"), F.col("field").alias("event_type"), F.col("status").alias("even"), F.col("raw").alias("large"))


@query("""WITH x AS (SELECT o_custkey AS d, CASE o_orderkey % 3 WHEN 0 THEN 'peso' WHEN 1 THEN 'sexo' ELSE 'edad' END AS key, CASE o_orderkey % 3 WHEN 0 THEN (o_orderkey % 200)::VARCHAR || ' kg' WHEN 1 THEN CASE WHEN o_orderkey % 2 = 0 THEN 'macho' ELSE 'x' END ELSE o_orderkey::VARCHAR END AS v, o_orderkey AS k FROM orders),
y AS (SELECT d, key, CASE key WHEN 'peso' THEN k % 200 BETWEEN 1 AND 120 WHEN 'sexo' THEN k % 2 = 0 ELSE length(v) <= 3 END AS ok FROM x), c AS (SELECT unnest(['peso', 'sexo', 'edad', 'dob']) AS key)
SELECT key, CASE WHEN ok THEN 'accepted' ELSE 'rejected' END AS status, count(*) AS n FROM y GROUP BY 1, 2
UNION ALL SELECT c.key, 'missing', count(*) FROM (SELECT DISTINCT d FROM x) p CROSS JOIN c WHERE NOT EXISTS (SELECT 1 FROM x WHERE x.d = p.d AND x.key = c.key) GROUP BY c.key""")
def validated_grid(spark, d):
    k = F.col("o_orderkey") % 3
    v = F.when(k == 0, F.concat((F.col("o_orderkey") % 200).cast("string"), F.lit(" kg"))).when(k == 1, F.when(F.col("o_orderkey") % 2 == 0, "macho").otherwise("x")).otherwise(F.col("o_orderkey").cast("string"))
    fields = table(spark, d, "orders").select(F.col("o_custkey").alias("document_id"), F.when(k == 0, "peso").when(k == 1, "sexo").otherwise("edad").alias("key"), v.alias("value"))
    asked = spark.createDataFrame([(x,) for x in ("peso", "sexo", "edad", "dob")], "key string")
    return view.validated(fields, asked).groupBy("key", "status").agg(F.count("*").alias("n"))


@query("""SELECT l_partkey, bool_or(l_returnflag = 'R') AS critical, count(DISTINCT l_suppkey) AS suppliers, max(l_shipdate)::DATE::VARCHAR AS last_ship FROM lineitem GROUP BY l_partkey""")
def slot_criticality(spark, d):
    li = view.slot_summary(table(spark, d, "lineitem"), "l_partkey", F.col("l_returnflag") == "R", "l_suppkey", "l_shipdate")
    return li.select("l_partkey", "critical", F.col("members").alias("suppliers"), F.col("last_day").alias("last_ship"))
