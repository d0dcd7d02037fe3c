"""Log streams: the batch transforms on a live source, with bounded state."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loglode.functions.logparse import ERROR_MARK, event_time, normalize_query, with_parsed
from loglode.functions.text import strip
from loglode.operators.index_search import search_index
from loglode.operators.word_index import WordIndex
from loglode.plans.bounds import broadcast_if_small


def log_stream(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """Lines of text files as they land in a folder."""
    return spark.readStream.options(**options).text(path)


def parsed_stream(lines: DataFrame, line: str = "value") -> DataFrame:
    """Stateless: fields, keys and typed event time of each line."""
    parsed = with_parsed(lines, line)
    return parsed.withColumn("event_time", event_time(F.col("timestamp")))


def lookup_stream(parsed: DataFrame, postings: DataFrame, index: Sequence[str] = ("machine_id", "version_id")) -> DataFrame:
    """Stream-static join of error lines with the postings of the active index, keyed by the normalised message."""
    keyed = parsed.withColumn("error_key", normalize_query(F.col("search_message")))
    return keyed.join(broadcast_if_small(postings), [*index, "error_key"])


def windowed_counts(
    parsed: DataFrame, window: str = "1 hour", delay: str = "10 minutes", group: Sequence[str] = ("key_normalized",)
) -> DataFrame:
    """Lines per key and tumbling window; rows later than the delay are dropped."""
    timed = parsed.withWatermark("event_time", delay)
    counts = timed.groupBy(F.window("event_time", window).alias("w"), *group).agg(F.count(F.lit(1)).alias("n_lines"))
    return counts.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *group, "n_lines")


def relevant_line_stream(
    lines: DataFrame, block: Sequence[str], pos: str, text: str, event_time: str, gap: str = "10 minutes", delay: str = "10 minutes"
) -> DataFrame:
    """Relevant line of each block once its session closes; the state is one best line per block."""
    clean = lines.withColumn("_line", strip(F.col(text))).filter(F.col("_line") != "")
    rank = F.struct(~F.contains("_line", F.lit(ERROR_MARK)), F.col(pos))
    sessions = clean.withWatermark(event_time, delay).groupBy(F.session_window(event_time, gap).alias("s"), *block)
    best = sessions.agg(F.min_by("_line", rank).alias("selected_line"))
    return best.select(*block, F.col("s.start").alias("session_start"), "selected_line")


def drain(stream: DataFrame, out: str) -> DataFrame:
    """Run a stream over all that is there now and return everything it has written so far.

    The sink is a parquet folder; the checkpoint beside it holds offsets, watermark and
    state, so the next call with the same folder goes on where this one ended.
    """
    writer = stream.writeStream.format("parquet").outputMode("append").trigger(availableNow=True)
    writer.option("path", out).option("checkpointLocation", f"{out}.checkpoint").start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(out)


def lookup_batches(
    queries: DataFrame, current: Callable[[], tuple[DataFrame, DataFrame, WordIndex | None]], out: str
) -> DataFrame:
    """Look up a stream of queries in the index as it is when each batch comes, all tiers included.

    ``queries`` streams query_id, machine_id, version_id (or machine_id alone with an index
    that names one version each) and message; ``current`` gives the postings, chunks and
    word index to read for a batch. A batch that is run again replaces its own results.
    """

    def look_up(batch: DataFrame, batch_id: int) -> None:
        postings, chunks, words = current()
        if "version_id" not in batch.columns:
            batch = batch.join(chunks.select("machine_id", "version_id").distinct(), "machine_id")
        found = search_index(batch, postings, chunks, words)
        found.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    writer = queries.writeStream.foreachBatch(look_up).trigger(availableNow=True)
    writer.option("checkpointLocation", f"{out}.checkpoint").start().awaitTermination()
    spark = queries.sparkSession
    return spark.read.option("basePath", out).parquet(out)
