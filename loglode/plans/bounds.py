"""Size checks in front of every broadcast."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BROADCAST_ROWS = 1_000_000
BROADCAST_BYTES = 128 * 1024 * 1024
ROW_OVERHEAD = 64


@dataclass(frozen=True)
class Size:
    rows: int
    bytes: int

    @property
    def fits(self) -> bool:
        return self.rows <= BROADCAST_ROWS and self.bytes <= BROADCAST_BYTES

    @property
    def passes(self) -> int:
        """Slices needed so that each one stays well inside the bound."""
        if self.fits:
            return 1
        return 2 * math.ceil(max(self.rows / BROADCAST_ROWS, self.bytes / BROADCAST_BYTES))


def row_bytes(df: DataFrame) -> Column:
    """Estimated bytes of a row: text by its length, everything else flat."""
    total = F.lit(ROW_OVERHEAD)
    for field in df.schema.fields:
        name = f"`{field.name}`"
        if field.dataType.typeName() in ("string", "binary"):
            total = total + F.coalesce(F.octet_length(name), F.lit(0))
        elif field.dataType.typeName() in ("array", "map", "struct", "variant"):
            total = total + F.coalesce(F.octet_length(F.to_json(F.struct(name))), F.lit(0))
        else:
            total = total + 8
    return total


def measure(df: DataFrame) -> Size:
    """Rows and bytes of the (supposedly small) side, by one partial aggregate."""
    got = df.agg(*size_columns(df)).first()
    return Size(got["n"], got["b"] or 0)


def size_columns(df: DataFrame) -> list[Column]:
    return [F.count(F.lit(1)).alias("n"), F.sum(row_bytes(df)).alias("b")]


def broadcast_if_small(df: DataFrame) -> DataFrame:
    """Broadcast behind a check; beyond the bound Spark shuffles (AQE splits skew)."""
    return F.broadcast(df) if measure(df).fits else df


def shuffled(df: DataFrame) -> DataFrame:
    """Rows whose joins go by shuffle unless the other side asks for a broadcast.

    Spark guesses stored rows by the size of the table they came from and takes every text for 20 bytes, so a
    whole index would pass for a small table and be gathered on the driver. What is made of one frame keeps this;
    a join forgets it.
    """
    return df.hint("merge")


def spread(df: DataFrame, *key: str) -> DataFrame:
    """Use all cores where the input has fewer splits than there are; else no shuffle."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores, *key)
