"""The corpus pipeline: quality, near duplicates, benchmark passages, personal data, and the mix of sources.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage before kept. run() writes each stage's documents as Parquet in the shared
folder and reads them again as the next one's, so that a lost executor never costs more than one stage.

In every stage null and empty texts are documents without words, rows that repeat (or repeat an id, or have none) are judged each by its own text, further
columns pass through whatever their names, and empty tables give empty ones.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm import decontam, minhash, mixing, pii, quality
from docloom.llm.common import shared_dir
from docloom.llm.queries import NEAR_COPIES, QUALITY_LINE, _fold, _read


def _packed(docs: DataFrame, *named: str) -> DataFrame:
    """doc_id, text and the named columns, and all others in one struct, so that no extra column clashes with what an operator adds."""
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    return docs.select("doc_id", "text", *named, F.struct(*rest).alias("rest_") if rest else F.struct(F.lit(0).alias("_")).alias("rest_"))


def _unpacked(df: DataFrame, docs: DataFrame, **new) -> list:
    """The columns of docs again; new ones replace those of their name."""
    return [new[c].alias(c) if c in new else df[c] if c in ("doc_id", "text") else df["rest_"][c].alias(c) for c in docs.columns]


def _free(name: str, docs: DataFrame) -> str:
    """The name, with mix_ in front as often as it takes to be no column of docs."""
    while name.lower() in (c.lower() for c in docs.columns):
        name = f"mix_{name}"
    return name


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score reaches the line."""
    model = quality.train(docs, _read(spark, sf_dir, "labels"), _fold(5, "i") != 0)
    scored = quality.score_quality(_packed(docs), model, keep=("rest_",), with_text=True).filter(F.col("score") >= QUALITY_LINE)
    return scored.select(*_unpacked(scored, docs))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return minhash.drop_near_duplicates(docs, NEAR_COPIES)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of whose words less than a twentieth stand in benchmark windows."""
    judged = decontam.decontaminate(_packed(docs), _read(spark, sf_dir, "benchmark"), keep=("text", "rest_")).filter("not contaminated")
    return judged.select(*_unpacked(judged, docs))


def personal_data_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by its kind in brackets; n_chars follows."""
    found = pii.detect(_packed(docs), pii.train(docs), keep=("rest_",), with_text=True).withColumnRenamed("redacted", "text")
    return found.select(*_unpacked(found, docs, n_chars=F.coalesce(F.length("text"), F.lit(0)).cast("long")))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each copy of a document that the mix of sources takes; copy counts from 1."""
    mixed = mixing.mix_sources(_packed(docs, "source"), keep=("text", "rest_")).filter("copies > 0")
    return mixed.select(*_unpacked(mixed, docs), F.explode(F.sequence(F.lit(1), "copies")).alias(_free("copy", docs)))


STAGES = [("quality", quality_stage), ("near_duplicates", near_duplicate_stage), ("decontamination", decontamination_stage), ("personal_data", personal_data_stage), ("source_mix", mixing_stage)]

#: Fitted classifiers and sampled hashes aren't SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order, from the documents of sf_dir."""
    docs = _read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        out = stage(spark, docs, sf_dir)
        path = f"{shared_dir(spark).rstrip('/')}/pipeline-{name}-{uuid.uuid4().hex}"
        out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
    return docs
