"""Roll-ups and lookups over occurrences of error keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loglode.functions.logparse import normalize_query


def error_key_rollup(occurrences: DataFrame, message: str = "message", ts: str = "ts") -> DataFrame:
    """Count, first and last time per normalised key."""
    return occurrences.groupBy(normalize_query(F.col(message)).alias("normalized_key")).agg(
        F.count(F.lit(1)).alias("occurrence_count"), F.min(ts).alias("first_seen"), F.max(ts).alias("last_indexed"),
        F.min(message).alias("key"),
    )


def filter_keys(keys: DataFrame, text: str | None) -> DataFrame:
    """Keys whose shown or normalised form contains the text, case aside."""
    if not text:
        return keys
    low = F.lit(text.lower())
    return keys.filter(F.contains(F.lower("key"), low) | F.contains("normalized_key", low))


def filter_occurrences(
    occurrences: DataFrame,
    min_confidence: float | None = None,
    file_path: str | None = None,
    function_name: str | None = None,
    date_from: str | None = None,
    date_to: str | None = None,
) -> DataFrame:
    """The search filters; those not given let everything pass and reach the scan as they are."""
    tests: list[Column] = []
    if min_confidence is not None:
        tests.append(F.col("confidence") >= min_confidence)
    if file_path:
        tests.append(F.contains("file_path", F.lit(file_path)))
    if function_name:
        tests.append(F.contains("function_name", F.lit(function_name)))
    if date_from:
        tests.append(F.col("ts") >= F.lit(date_from).cast("timestamp"))
    if date_to:
        tests.append(F.col("ts") <= F.lit(date_to).cast("timestamp"))
    for test in tests:
        occurrences = occurrences.filter(test)
    return occurrences


def grouped_occurrences(occurrences: DataFrame, by: str = "confidence") -> DataFrame:
    """Occurrences with their group's display key and size, in row form: a key may hold any share of all rows."""
    keyed = occurrences.withColumn("normalized_key", normalize_query(F.col("message")))
    groups = keyed.groupBy("normalized_key").agg(
        F.count(F.lit(1)).alias("group_count"), F.min("message").alias("display_key")
    )
    return keyed.join(groups, "normalized_key").orderBy(F.desc("group_count"), "normalized_key", F.desc(by), "occurrence_id")


def top_occurrences(occurrences: DataFrame, limit: int, by: str = "confidence") -> DataFrame:
    """The first rows of each group by confidence or time."""
    keyed = occurrences.withColumn("normalized_key", normalize_query(F.col("message")))
    order = Window.partitionBy("normalized_key").orderBy(F.desc(by), "occurrence_id")
    return keyed.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= limit)


def occurrence_details(occurrences: DataFrame, wanted: DataFrame, key: Sequence[str] = ("error_key",)) -> DataFrame:
    """Occurrences by id with the ids of others of the same key, one row per related id."""
    mine = occurrences.join(wanted.select("occurrence_id"), "occurrence_id")
    others = occurrences.select(*key, F.col("occurrence_id").alias("related_id"))
    related = mine.join(others, list(key), "left")
    # The row of the occurrence itself stays as the one with no related id.
    return related.withColumn("related_id", F.when(F.col("related_id") != F.col("occurrence_id"), F.col("related_id")))
