"""Figures of a run, taken from the run itself: what was read, left out and written."""

from __future__ import annotations

import time
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from loglode.sources.documents import file_sizes


def write_measured(df: DataFrame, path: str, raw_bytes: Column, partition: Sequence[str] = ()) -> DataFrame:
    """Write parquet and report, in one row, rows and raw bytes as they passed and files and bytes as they lie there.

    The rows are counted on their way into the files, so nothing is read twice; stored bytes
    come from the listing of the files.
    """
    seen = Observation()
    counted = df.observe(seen, F.count(F.lit(1)).alias("n_rows"), F.coalesce(F.sum(raw_bytes), F.lit(0)).alias("raw_bytes"))
    writer = counted.write.partitionBy(*partition) if partition else counted.write
    writer.parquet(path)
    got = seen.get
    files = file_sizes(df.sparkSession, path).agg(F.count(F.lit(1)).alias("n_files"), F.coalesce(F.sum("length"), F.lit(0)).alias("stored_bytes"))
    own = [F.lit(got[c]).cast("long").alias(c) for c in ("n_rows", "raw_bytes")]
    ratio = F.when(F.lit(got["raw_bytes"]) > 0, F.col("stored_bytes") / F.lit(got["raw_bytes"]))
    return files.select(*own, "n_files", "stored_bytes", ratio.alias("ratio"))


def measured_scan(listing: DataFrame, reason: str = "skip_reason", size: str = "length") -> tuple[DataFrame, Observation]:
    """The files to read, and an observation that counts them, their bytes and the ones left out while they are read."""
    seen, kept = Observation(), F.col(reason).isNull()
    counts = [
        F.count_if(kept).alias("files_read"),
        F.count_if(~kept).alias("files_skipped"),
        F.coalesce(F.sum(F.when(kept, F.col(size))), F.lit(0)).alias("bytes_read"),
    ]
    return listing.observe(seen, *counts).filter(kept), seen


def scan_report(listing: DataFrame, read, reason: str = "skip_reason", size: str = "length") -> DataFrame:
    """Run `read`, an action on the files to read, once; one row of its counts, seconds and rates."""
    files, seen = measured_scan(listing, reason, size)
    start = time.monotonic()
    read(files)
    seconds = max(time.monotonic() - start, 1e-9)
    got = seen.get
    row = (got["files_read"], got["files_skipped"], got["bytes_read"], seconds, got["files_read"] / seconds, got["bytes_read"] / seconds)
    schema = "files_read long, files_skipped long, bytes_read long, seconds double, files_per_second double, bytes_per_second double"
    return listing.sparkSession.createDataFrame([row], schema)
