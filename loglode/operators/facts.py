"""Parsed files by content: a text is parsed once, however many versions, machines and paths hold it.

A store is a folder of two parquet tables. `parsed` has a row per digest with the batch
that parsed it; `bodies` has a row per function, in a folder per batch. A digest counts
as known once its row is in `parsed`, which is written last: what a broken run left in
`bodies` belongs to a batch nobody names.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loglode.operators.chunks import chunk_bodies, with_chunk_id
from loglode.operators.syntax import with_facts
from loglode.session import path_exists

PARSED = "digest string, batch string, parsed boolean"


def with_digest(files: DataFrame, text: str = "text") -> DataFrame:
    return files.withColumn("digest", F.sha2(F.col(text), 256))


def _marks(spark: SparkSession, path: str) -> DataFrame:
    """Rows of `parsed` as they are now, by the names of their files.

    Two reads of one folder are the same to Spark even if it has grown between them: in one
    plan the later read would get the rows of the earlier one.
    """
    if not path_exists(spark, f"{path}/parsed"):
        return spark.createDataFrame([], PARSED)
    reader = spark.read.schema(PARSED)
    files = reader.parquet(f"{path}/parsed").inputFiles()
    return reader.parquet(*map(unquote, files)) if files else spark.createDataFrame([], PARSED)


def known_digests(spark: SparkSession, path: str) -> DataFrame:
    """(digest, batch, parsed) of every text parsed so far; of two runs that parsed the same text, one."""
    rows = _marks(spark, path)
    return rows.groupBy("digest").agg(F.min_by(F.struct("batch", "parsed"), "batch").alias("r")).select("digest", "r.*")


def unseen_files(files: DataFrame, known: DataFrame, key: Sequence[str] = ("path",)) -> DataFrame:
    """One file (digest, text) for each text not known yet.

    Which files these are is settled on keys and digests; only their own texts are read on.
    """
    marked = with_digest(files.select(*key, "text"))
    first = marked.groupBy("digest").agg(F.min(F.struct(*key)).alias("k")).join(known.select("digest"), "digest", "left_anti")
    wanted = first.select("digest", *[F.col(f"k.{c}").alias(c) for c in key])
    return marked.join(wanted, ["digest", *key], "left_semi").select("digest", "text")


def update_facts(files: DataFrame, path: str, key: Sequence[str] = ("path",), deep: bool = False) -> int:
    """Parse the texts of files the store does not know; returns how many these were.

    A null text is no file. Repeated files and equal texts under several keys are parsed once.
    """
    spark, batch = files.sparkSession, uuid.uuid4().hex
    fresh = unseen_files(files.filter("text IS NOT NULL"), known_digests(spark, path), key)
    bodies = with_facts(fresh)
    # One pass parses and writes: a text that does not parse, or has no function, leaves one row without a body.
    rows = chunk_bodies(bodies, ("digest",), deep, outer=True)
    rows.write.parquet(f"{path}/bodies/batch={batch}")
    stored = spark.read.parquet(f"{path}/bodies/batch={batch}")
    seen = stored.groupBy("digest").agg(F.bool_or("parsed").alias("parsed"))
    marks = seen.select("digest", F.lit(batch).alias("batch"), "parsed")
    n = marks.count()
    if n:
        marks.write.mode("append").parquet(f"{path}/parsed")
    return n


def file_facts(files: DataFrame, path: str, key: Sequence[str] = ("path",)) -> DataFrame:
    """(*key, digest, parsed): whether each file of the store parses; no file is parsed for it."""
    marked = with_digest(files.select(*key, "text")).drop("text")
    return marked.join(known_digests(files.sparkSession, path), "digest").select(*key, "digest", "batch", "parsed")


def stored_chunks(files: DataFrame, path: str, key: Sequence[str] = ("path",)) -> DataFrame:
    """The function chunks of the files, from the store: a join on digests in place of parsing."""
    spark = files.sparkSession
    # By the folders of its batches, as a store that has grown would else pass for what it was; see _marks.
    batches = [f"{path}/bodies/batch={r[0]}" for r in _marks(spark, path).select("batch").distinct().sort("batch").collect()]
    stored = spark.read.option("basePath", f"{path}/bodies").parquet(*(batches or [f"{path}/bodies"]))
    bodies = stored.filter("function_name IS NOT NULL").drop("parsed")
    return with_chunk_id(file_facts(files, path, key).drop("parsed").join(bodies, ["digest", "batch"]).drop("digest", "batch"))
