"""Token counts behind a cache of content digests: every distinct text is encoded once per tokenizer version."""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from .common import bound_batches, materialise

#: A digest that more rows share than HOT_LEAST and than the rows' number over HOT_SHARE is joined by broadcast.
HOT_LEAST, HOT_SHARE = 500, 20_000
CACHE_SCHEMA = "tokenizer string, digest string, n_tokens long"
_PIECES = re.compile(r"[^ \t\n\r]+")
_LOADED: dict[str, object] = {}


def tokenizer_digest(path: str) -> str:
    """The version of a tokenizer: the SHA-256 of its file."""
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


def _drops_space(spec: dict) -> bool:
    """Whether white space only separates words for this tokenizer: runs become one blank and the split removes what lies between matches that hold none."""
    norm, pre = json.dumps(spec.get("normalizer") or {}), json.dumps(spec.get("pre_tokenizer") or {})
    plain = all(not (t["lstrip"] or t["rstrip"] or t["single_word"]) and not re.search(r"\s", t["content"]) for t in spec.get("added_tokens", []))
    return plain and '"\\\\s+"' in norm and '"Removed"' in pre and "[^\\\\s" in pre and " ?" not in pre and spec["model"]["type"] == "BPE" and not spec.get("post_processor")


class Encoder:
    """Counts tokens without begin, end or added special tokens. Special strings inside texts are handled as the library does by default.

    Where white space only separates words, distinct words of a batch are encoded once each and a text's count is the sum over its words.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        if path.endswith(".model"):
            import sentencepiece

            self.model, self.by_word = sentencepiece.SentencePieceProcessor(model_file=path), False
        else:
            from tokenizers import Tokenizer

            self.model = Tokenizer.from_file(path)
            with open(path, encoding="utf-8") as f:
                self.by_word = _drops_space(json.load(f))
        self.known: dict[str, int] = {}

    def whole(self, texts: list[str]) -> list[int]:
        if hasattr(self.model, "encode_batch"):
            return [len(e.ids) for e in self.model.encode_batch(texts, add_special_tokens=False)]
        return [len(x) for x in self.model.encode(texts, num_threads=1)]

    def count(self, texts: list[str]) -> list[int]:
        if not self.by_word:
            return self.whole(texts)
        bags, known = [Counter(_PIECES.findall(t)) for t in texts], self.known
        fresh = list({w for b in bags for w in b if w not in known})
        known.update(zip(fresh, self.whole(fresh), strict=True))
        out = [sum(k * known[w] for w, k in b.items()) for b in bags]
        for w in fresh:
            if len(w) > 64:
                del known[w]
        if len(known) > 300_000:  # a bounded memo, begun anew when full
            known.clear()
        return out


def encoder(path: str) -> Encoder:
    """One encoder per worker process. The path is opened on the worker; where it isn't there, a file of that name shipped by Spark is used."""
    here = path if os.path.exists(path) else SparkFiles.get(os.path.basename(path))
    if here not in _LOADED:
        _LOADED[here] = Encoder(here)
    return _LOADED[here]


def read_cache(spark, path: str) -> DataFrame:
    """The cache table at path; no rows where there is none yet."""
    try:
        return spark.read.schema(CACHE_SCHEMA).parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], CACHE_SCHEMA)


def token_counts(docs: DataFrame, tokenizer_path: str, cache_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, digest, n_bytes, n_tokens), one for each row of docs.

    The digest is of the content (null: empty) and joins, with the tokenizer's version, to the stored counts. Only distinct texts that the cache lacks
    are encoded, whole, and appended to it: texts are reduced to one per digest before they are shuffled, so that a third of all rows with the same
    text costs one row per task. Counts come back to the rows by digest; the few digests that many rows share (a share of 1 / HOT_SHARE at least, so no more
    than HOT_SHARE of them) are broadcast instead. Repeated ids keep a row each; an empty table encodes nothing; further columns are left behind.
    """
    bound_batches(docs.sparkSession)
    spark, version = docs.sparkSession, tokenizer_digest(tokenizer_path)
    if not any(os.path.basename(f) == os.path.basename(tokenizer_path) for f in spark.sparkContext.listFiles):
        spark.sparkContext.addFile(tokenizer_path)  # for executors that don't have the path
    keyed = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("digest", F.sha2(F.col("text"), 256))
    cache = lambda: read_cache(spark, cache_path).filter(F.col("tokenizer") == version).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))
    missing = keyed.select("digest", "text").join(cache().select("digest"), "digest", "left_anti").dropDuplicates(["digest"])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = encoder(tokenizer_path)
        for b in batches:
            digests, texts = b.column(0), b.column(1)
            for i in range(0, b.num_rows, 500):
                part = texts.slice(i, 500).to_pylist()
                n = pa.array(model.count(part), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array([version] * len(part), pa.string()), digests.slice(i, 500), n], ["tokenizer", "digest", "n_tokens"])

    missing.mapInArrow(encode, CACHE_SCHEMA).write.mode("append").parquet(cache_path)
    sized = materialise(keyed.select("id", "digest", F.octet_length("text").cast("long").alias("n_bytes")), "sized")
    shared = materialise(sized.groupBy("digest").agg(F.count("*").alias("rows")).filter(F.col("rows") > max(HOT_LEAST, sized.count() // HOT_SHARE)).select("digest"), "shared", light=True)
    hot = F.broadcast(cache().join(F.broadcast(shared), "digest", "left_semi"))
    counted = sized.join(F.broadcast(shared), "digest", "left_anti").join(cache(), "digest").unionByName(sized.join(hot, "digest").select("digest", "id", "n_bytes", "n_tokens"))
    return counted.select(F.col("id").alias(id_col), "digest", "n_bytes", "n_tokens")
