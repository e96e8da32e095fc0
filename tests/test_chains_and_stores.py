"""Chains of edits, calibration by increments, the replayable log, stores for lookups, addresses in pages."""

import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from docloom.operators import edit_chain, review, state, web_addresses
from docloom.operators.keyed import clipped_total
from docloom.sources import files
from docloom.streaming import merge

EDITS = "document_id string, batch long, version int, seq int, op string, field_id string, value string, kind string"
FIELDS = "document_id string, field_id string, version int, value string"


def plain_chain(fields, edits):
    """Batches one after the other, each on a copy."""
    have, version, log, refused = {}, {}, [], []
    for d, f, v, x in fields:
        have.setdefault(d, {})[f] = x
        version[d] = max(version.get(d, 0), v)
    for d, b in sorted({(e[0], e[1]) for e in edits}):
        batch = sorted((e for e in edits if e[:2] == (d, b)), key=lambda e: e[3])
        new, lines, error = dict(have.get(d, {})), [], None
        if d not in have:
            error = "DOCUMENT_NOT_FOUND"
        elif batch[0][2] != version[d]:
            error = "BASE_VERSION_MISMATCH"
        for e in batch if not error else ():
            op, f, x = e[4].upper(), e[5], e[6]
            if op not in ("ADD", "UPDATE", "DELETE"):
                error = "INVALID_OP"
            elif op == "ADD" and f in new:
                error = "FIELD_EXISTS"
            elif op != "ADD" and f not in new:
                error = "FIELD_NOT_FOUND"
            if error:
                break
            old = new.get(f)
            if op == "DELETE":
                del new[f]
                x = None
            else:
                new[f] = x
            if not (op == "UPDATE" and (old or "").strip() == (x or "").strip()):
                lines.append((d, b, version[d] + 1, f, op, old, x))
        if error:
            refused.append((d, b, batch[0][2], error))
        else:
            have[d], version[d], log = new, version[d] + 1, log + lines
    return sorted((d, f, version[d], x) for d, fs in have.items() for f, x in fs.items()), sorted(log), sorted(refused)


def test_three_versions_in_one_call(spark):
    fields = spark.createDataFrame([("d", "a", 1, "x"), ("d", "b", 1, "y")], FIELDS)
    edits = spark.createDataFrame([("d", 1, 1, 0, "update", "a", "x2", "string"), ("d", 2, 2, 0, "DELETE", "b", None, "string"), ("d", 2, 2, 1, "ADD", "b", "new", "string"), ("d", 3, 2, 0, "UPDATE", "a", "late", "string"), ("d", 4, 3, 0, "UPDATE", "a", " x2 ", "string"), ("z", 1, 1, 0, "ADD", "a", "q", "string")], EDITS)
    new, log, refused = edit_chain.apply_edit_chain(fields, edits)
    assert sorted(map(tuple, new.collect())) == [("d", "a", 4, " x2 "), ("d", "b", 4, "new")]
    assert [tuple(r) for r in log.select("batch", "version", "op", "old_value", "new_value").orderBy("version", "at").collect()] == [(1, 2, "UPDATE", "x", "x2"), (2, 3, "DELETE", "y", None), (2, 3, "ADD", None, "new")]
    assert sorted(map(tuple, refused.collect())) == [("d", 3, 2, "BASE_VERSION_MISMATCH"), ("z", 1, 1, "DOCUMENT_NOT_FOUND")]
    assert all(x.count() == 0 for x in edit_chain.apply_edit_chain(fields.limit(0), edits.limit(0)))


@pytest.mark.parametrize("seed", [1, 2])
def test_chains_equal_the_plain_fold(spark, seed):
    rng = random.Random(seed)
    fields = [(f"d{i}", f"f{j}", 1, "v") for i in range(12) for j in range(rng.randrange(1, 4))]
    edits = []
    for i in range(13):
        guess = 1
        for b in range(rng.randrange(0, 12)):
            guess += rng.random() < 0.7
            edits += [(f"d{i}", b, guess if rng.random() < 0.9 else 1, s, rng.choice(["ADD", "UPDATE", "UPDATE", "DELETE", "MOVE"][: 5 if rng.random() < 0.1 else 4]), f"f{rng.randrange(5)}", rng.choice(["v", " v", "w"]), "string") for s in range(rng.randrange(1, 3))]
            guess = rng.choice([guess, guess, max(1, guess - 1)])
    got = edit_chain.apply_edit_chain(spark.createDataFrame(fields, FIELDS), spark.createDataFrame(edits, EDITS).repartition(5))
    want = plain_chain(fields, edits)
    key = lambda r: tuple((x is None, x or "") if not isinstance(x, int) else (False, x) for x in r)
    assert sorted(map(tuple, got[0].collect()), key=key) == sorted(want[0], key=key)
    assert sorted((tuple(r) for r in got[1].select("document_id", "batch", "version", "field_id", "op", "old_value", "new_value").collect()), key=key) == sorted(want[1], key=key)
    assert sorted(map(tuple, got[2].collect()), key=key) == sorted(want[2], key=key)


def test_increments_equal_the_recount(spark):
    rng = random.Random(4)
    rows = [(rng.choice(["a", "b", None]), t, rng.choice([-1, 0, 1, 2]), rng.choice([-2, 0, 1])) for t in range(300)]
    df = spark.createDataFrame(rows, "scope string, at int, accept_delta int, edit_delta int")
    held = state.calibration_state(df.filter("at < 0"), ["scope"], ["at"])
    for first in range(0, 300, 75):
        held = state.added_state(held, state.calibration_state(df.filter((F.col("at") >= first) & (F.col("at") < first + 75)), ["scope"], ["at"]), ["scope"])
    got = sorted((tuple(r) for r in state.state_counts(held, ["scope"]).collect()), key=str)
    accept, edit = (clipped_total(df, ["scope"], ["at"], c, "n").collect() for c in ("accept_delta", "edit_delta"))
    want = sorted(((a.scope, a.n, next(e.n for e in edit if e.scope == a.scope)) for a in accept), key=str)
    plain = {}
    for scope, _, a, e in rows:
        x = plain.get(scope, (0, 0))
        plain[scope] = (max(0, x[0] + a), max(0, x[1] + e))
    assert got == want == sorted(((s, *c) for s, c in plain.items()), key=str)


def test_replayed_batches_count_once(spark, tmp_path):
    path, schema = str(tmp_path / "log"), "k string, at int, v string"
    batch = lambda *rows: spark.createDataFrame(list(rows), schema)
    now = lambda: sorted(map(tuple, merge.current(spark, path, ["k"], ["at"], schema).collect()))
    assert now() == []
    assert merge.merge_batch(batch(("a", 1, "x"), ("a", 3, "y"), ("b", 1, "z")), 0, path, ["k"], ["at"])
    files_before = sorted(p for p in Path(path).rglob("*.parquet"))
    assert not merge.merge_batch(batch(("a", 1, "x"), ("a", 3, "y"), ("b", 1, "z")), 0, path, ["k"], ["at"])
    assert sorted(Path(path).rglob("*.parquet")) == files_before
    assert merge.merge_batch(batch(("a", 2, "old"), ("b", 5, "new")), 1, path, ["k"], ["at"])
    assert now() == [("a", 3, "y"), ("b", 5, "new")]
    # a batch that was written but not noted isn't read, and its replay writes it over
    batch(("a", 9, "ghost")).write.parquet(f"{path}/rows/batch-{2:012d}")
    assert now() == [("a", 3, "y"), ("b", 5, "new")]
    assert merge.merge_batch(batch(("c", 1, "real")), 2, path, ["k"], ["at"]) and now() == [("a", 3, "y"), ("b", 5, "new"), ("c", 1, "real")]
    merge.compact(spark, path, ["k"], ["at"], schema)
    assert now() == [("a", 3, "y"), ("b", 5, "new"), ("c", 1, "real")] and not merge.merge_batch(batch(("a", 99, "again")), 1, path, ["k"], ["at"])
    assert merge.merge_batch(batch(("a", 4, "last")), 3, path, ["k"], ["at"]) and now()[0] == ("a", 4, "last")
    assert [tuple(r) for r in merge.ledger(spark, path).orderBy("kind", "batch").collect()] == [("base", 2), ("batch", 0), ("batch", 1), ("batch", 2), ("batch", 3)]


def test_a_stream_that_loses_its_checkpoint_replays_without_repeats(spark, tmp_path):
    source, path, schema = str(tmp_path / "in"), str(tmp_path / "log"), "k string, at int"
    for i in range(3):
        spark.createDataFrame([(f"k{j}", 10 * i + j) for j in range(4)], schema).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    want = [(f"k{j}", 20 + j) for j in range(4)]
    for checkpoint in ("one", "one", "two"):
        merge.keep_latest(stream, path, str(tmp_path / checkpoint), ["k"], ["at"], every=2)
        assert sorted(map(tuple, merge.current(spark, path, ["k"], ["at"], schema).collect())) == want
    assert merge.ledger(spark, path).filter("kind = 'batch'").count() == 3


def test_lookups_read_one_bucket(spark, tmp_path):
    path, buckets = str(tmp_path / "texts"), 16
    texts = spark.range(4000).select(F.col("id").cast("string").alias("document_id"), F.lit("r").alias("run_id"), F.concat(F.lit("text "), "id").alias("text"))
    files.write_raw_texts(texts, path, files=4, buckets=buckets)
    assert len(list(Path(path).rglob("*.parquet"))) <= 4 + buckets
    found = files.lookup_raw_text(spark, path, "77", buckets=buckets)
    assert [tuple(r) for r in found.collect()] == [("77", "r", "text 77")] and files.lookup_raw_text(spark, path, "77", "other", buckets).count() == 0
    plan = found._jdf.queryExecution().executedPlan().toString()
    bucket = spark.range(1).select(files.bucket_of(F.lit("77"), buckets).alias("b")).first().b
    assert f"= {bucket})" in plan.split("PartitionFilters:")[1].split("]")[0] and "EqualTo(document_id,77)" in plan
    runs = spark.createDataFrame([("77", "r"), ("77", "s"), ("x", "r"), (None, "r")], "document_id string, run_id string")
    assert sorted(((r.document_id, r.run_id, r.text) for r in files.read_raw_texts(spark, path, runs, buckets).collect()), key=str) == [("77", "r", "text 77"), ("77", "s", None), ("x", "r", None), (None, "r", None)]


def test_original_files(spark, tmp_path):
    path = str(tmp_path / "originals")
    rows = spark.createDataFrame([("a", "a.pdf", bytearray(b"%PDF-a")), ("b", "b.pdf", bytearray(b"%PDF-b"))], "document_id string, filename string, content binary")
    files.write_originals(rows, path, tasks=2, buckets=8)
    got = files.lookup_original(spark, path, "b", buckets=8).collect()
    assert [(r.document_id, r.filename, bytes(r.content)) for r in got] == [("b", "b.pdf", b"%PDF-b")]


def test_addresses_in_pages(spark):
    result = '<a rel="x" class="result__snippet" href="u">{}</a>'
    pages = [
        (1, result.format("Nada") + result.format("Cl&iacute;nica en <b>Avenida</b> de Am&eacute;rica 12, 28028 Madrid 4.5") + result.format("Calle Otra 1, 28001 Madrid")),
        (2, "<p>Dirección: Polígono Norte, nave [mapa](http://x) 08001 Barcelona; abierto</p>"),
        (3, "<p>Direccion: sin codigo postal alguno</p>"), (4, None), (5, "<p>C/ Luna 3, 46001 Valencia Teléfono 96 000 00 00</p>"), (5, "<p>nada</p>"),
    ]
    got = web_addresses.page_addresses(spark.createDataFrame(pages, "page_id int, html string")).collect()
    assert sorted(((r.page_id, r.address) for r in got), key=str) == [(1, "Avenida de América 12, 28028 Madrid"), (2, "Polígono Norte, nave 08001 Barcelona"), (3, None), (4, None), (5, "C/ Luna 3, 46001 Valencia"), (5, None)]


def test_review_states(spark):
    rows = [("a", 1, "MARK", 1), ("a", 2, "MARK", 2), ("a", 3, "REOPEN", 3), ("b", 4, "REOPEN", 1), ("c", 6, "MARK", 2), ("c", 5, "REOPEN", 2)]
    got = review.review_states(spark.createDataFrame(rows, "document_id string, action_id int, action string, at int"))
    assert sorted(map(tuple, got.collect())) == [("a", 3, "IN_REVIEW", 2), ("b", 4, "IN_REVIEW", 0), ("c", 6, "REVIEWED", 1)]
