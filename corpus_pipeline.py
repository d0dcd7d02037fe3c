"""The corpus pipeline: documents in, token ids of the cleaned documents out."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loglode.llm.byte_bpe import decode, encode, read_ranks
from loglode.llm.common import written
from loglode.llm.decontaminate import without_leaks
from loglode.llm.near_dedup import near_duplicates
from loglode.llm.quality import keep_good
from loglode.llm.substring_dedup import substring_dedup

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the quality rules reject go; the others stay as they are."""
    return keep_good(docs, *COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest doc_id stays."""
    gone = near_duplicates(docs).where(~F.col("kept")).select(F.col("doc_id").alias("gone"), "text_hash").distinct()
    same = (F.col("doc_id") == F.col("gone")) & (F.xxhash64("text") == F.col("text_hash"))
    return docs.select(*COLUMNS).join(gone.hint("shuffle_hash"), same, "left_anti")


def passage_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that earlier documents hold are cut out; n_chars follows. A document of nothing else stays, empty."""
    cut = substring_dedup(docs, text_out=True, carry=("text", "lang", "source", "n_chars"))
    whole = F.col("n_removed") == 0
    return cut.select(
        "doc_id",
        F.when(whole, F.col("own_text")).otherwise(F.col("kept_text")).alias("text"),
        F.col("own_lang").alias("lang"),
        F.col("own_source").alias("source"),
        F.when(whole, F.col("own_n_chars")).otherwise(F.length("kept_text").cast("long")).alias("n_chars"),
    )


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, a few edits allowed, go."""
    return without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), *COLUMNS)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and digests of the ids and of the bytes they decode to."""
    ranks = read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    both = decode(encode(docs, ranks, public_tokenizers.PATTERN), ranks)
    return both.select("doc_id", "n_tokens", "ids", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality rules", quality_rules),
    ("MinHash near-dedup", near_dedup),
    ("substring dedup", passage_dedup),
    ("benchmark decontamination", decontamination),
    ("byte-level BPE", byte_bpe),
]

#: Near-duplicate components and byte-pair merges have no SQL form; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
