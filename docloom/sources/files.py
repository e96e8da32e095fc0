"""Sources and sinks: tables, raw texts by document and run, JSON snapshots, uploads, the contract."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.operators.keyed import last_n, latest

MOST_BYTES = 20 * 1024 * 1024


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A Parquet table of a folder."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def upload_error(content_type: Column, filename: Column, size: Column) -> Column:
    """Why an upload is refused; null if it isn't."""
    return F.when((content_type != "application/pdf") | ~F.lower(filename).endswith(".pdf"), "UNSUPPORTED_MEDIA_TYPE").when(size <= 0, "EMPTY_FILE").when(size > MOST_BYTES, "FILE_TOO_LARGE")


def split_uploads(uploads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, refused with a reason)."""
    judged = uploads.withColumn("error", upload_error(F.col("content_type"), F.col("original_filename"), F.col("file_size")))
    return judged.filter("error is null").drop("error"), judged.filter("error is not null")


#: Folders of a store of texts or files, by a hash of the document.
BUCKETS = 256


def bucket_of(document_id: Column, buckets: int = BUCKETS) -> Column:
    """The folder of a document; of a literal id the optimizer makes a constant, by which folders are left out."""
    return F.pmod(F.xxhash64(document_id.cast("string")), F.lit(buckets)).cast("int")


def _stored(rows: DataFrame, path: str, files: int | None, buckets: int) -> None:
    placed = rows.withColumn("bucket", bucket_of(F.col("document_id"), buckets))
    n = files or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [c for c in ("bucket", "document_id", "run_id") if c in placed.columns]
    placed.repartitionByRange(n, *order).sortWithinPartitions(*order).write.partitionBy("bucket").mode("append").parquet(path)


def write_raw_texts(texts: DataFrame, path: str, files: int | None = None, buckets: int = BUCKETS) -> None:
    """Append texts (document_id, run_id, text). Rows are dealt out by ranges of (bucket, document, run), so that an append makes no more than files + buckets files, however many
    documents and runs, and each file holds a narrow range of documents, which its statistics tell."""
    _stored(texts.select("document_id", "run_id", "text"), path, files, buckets)


def read_raw_texts(spark: SparkSession, path: str, runs: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """Runs with their text; null where there is none."""
    stored = spark.read.schema("document_id string, run_id string, text string, bucket int").parquet(path)
    asked = runs.withColumn("bucket", bucket_of(F.col("document_id"), buckets))
    return asked.join(stored, ["bucket", "document_id", "run_id"], "left").select(*runs.columns, "text")


def lookup_raw_text(spark: SparkSession, path: str, document_id: str, run_id: str | None = None, buckets: int = BUCKETS) -> DataFrame:
    """A document's stored texts (of one run, if given): one bucket is listed and read, and of its files only those whose range holds the document."""
    stored = spark.read.schema("document_id string, run_id string, text string, bucket int").parquet(path)
    found = stored.filter((F.col("bucket") == bucket_of(F.lit(document_id), buckets)) & (F.col("document_id") == document_id))
    return (found if run_id is None else found.filter(F.col("run_id") == run_id)).drop("bucket")


def write_originals(files: DataFrame, path: str, tasks: int | None = None, buckets: int = BUCKETS) -> None:
    """Append original files (document_id, filename, content) in the layout of texts; content is bytes."""
    _stored(files.select("document_id", "filename", "content"), path, tasks, buckets)


def lookup_original(spark: SparkSession, path: str, document_id: str, buckets: int = BUCKETS) -> DataFrame:
    """A document's original file."""
    stored = spark.read.schema("document_id string, filename string, content binary, bucket int").parquet(path)
    return stored.filter((F.col("bucket") == bucket_of(F.lit(document_id), buckets)) & (F.col("document_id") == document_id)).drop("bucket")


def append_artifacts(rows: DataFrame, path: str) -> None:
    """Append artifacts (artifact_id, run_id, artifact_type, payload struct, created_at) with compact JSON payloads, in folders by type."""
    rows.withColumn("payload", F.to_json("payload")).write.partitionBy("artifact_type").mode("append").parquet(path)


def object_payload(payload: Column, schema: str) -> Column:
    """A payload's fields as a struct; null if it isn't a JSON object."""
    return F.when(F.ltrim(payload).startswith("{"), F.from_json(payload, schema))


def active_artifacts(artifacts: DataFrame) -> DataFrame:
    """The newest artifact of each run and type."""
    return latest(artifacts, ["run_id", "artifact_type"], ["created_at", "artifact_id"])


def read_snapshots(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON snapshots; broken lines are left out."""
    return spark.read.schema(f"{schema}, _broken string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_broken").json(path).filter("_broken is null").drop("_broken")


def keep_snapshots(old: DataFrame, new: DataFrame, most: int = 20) -> DataFrame:
    """Snapshots after an upsert by document and run: of a run the newest copy, of a document the last `most` runs."""
    rows = old.unionByName(new, allowMissingColumns=True)
    return last_n(latest(rows, ["document_id", "run_id"], ["created_at"]), ["document_id"], ["created_at", "run_id"], most)


def accuracy_cases(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a JSON file of the shape {cases: [...]}, a row a case."""
    return spark.read.option("multiLine", True).json(path).select(F.explode("cases").alias("c")).select("c.*")


CONTRACT_SCHEMA = "contract_name string, contract_revision string, fields array<struct<key: string, label: string, section: string, value_type: string, repeatable: boolean, critical: boolean, optional: boolean>>"


def read_contract(spark: SparkSession, path: str) -> DataFrame:
    """The fields of a contract's JSON file, a row a field with its place in the file: a short list, to be broadcast where it is joined."""
    whole = spark.read.schema(CONTRACT_SCHEMA).option("multiLine", True).option("mode", "FAILFAST").json(path)
    return whole.select("contract_name", "contract_revision", F.posexplode("fields").alias("position", "f")).select("contract_name", "contract_revision", "position", "f.*")


def contract_errors(contract: DataFrame) -> DataFrame:
    """Rows (key, error) of a contract's fields that can't be used: without a key or a type, or with a key that another field has."""
    n = contract.groupBy("key").agg(F.count("*").alias("n"), F.count_if(F.coalesce(F.trim("value_type"), F.lit("")) == "").alias("untyped"))
    blank = F.coalesce(F.trim("key"), F.lit("")) == ""
    return n.select("key", F.when(blank, "MISSING_KEY").when(F.col("n") > 1, "DUPLICATE_KEY").when(F.col("untyped") > 0, "MISSING_TYPE").alias("error")).filter("error is not null")
