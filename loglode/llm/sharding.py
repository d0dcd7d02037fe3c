"""Shards of near equal size by sampled splitters, with equal texts together."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loglode.llm.common import stored

SHARDS = 16
#: A group of equal texts is split where it holds more than this share of a shard, or more rows than MAX_ROWS.
GROUP_SHARE = 1 / 64
MAX_ROWS = 1_000_000
UNITS_PER_RANGE = 1_000_000
MIN_RANGES = 64
SAMPLES_PER_RANGE = 100


def splitters(units: DataFrame, ranges: int, total: int) -> list[int]:
    """At most ranges - 1 boundaries that cut the keys into ranges of about equal weight.

    From a sample in which a unit is drawn with a chance in proportion to its weight (surely, with its weight, if that is
    large); the draw is a hash, so it is the same at any time. The sample's size is set by the number of ranges.
    """
    rate = ranges * SAMPLES_PER_RANGE / max(total, 1)
    chance = F.col("bytes") * F.lit(rate)
    draw = F.pmod(F.xxhash64("key", "piece", F.lit("draw")), F.lit(1 << 40)) / F.lit(float(1 << 40))
    sample = units.where(draw < chance).select("key", F.greatest(chance, F.lit(1.0)).alias("w"))
    order = Window.orderBy("key")
    cut = F.floor(F.sum("w").over(order) * ranges / F.sum("w").over(Window.partitionBy()))
    cuts = sample.select("key", cut.alias("cut")).where("cut > 0").groupBy("cut").agg(F.min("key").alias("key"))
    return sorted({r.key for r in cuts.collect()})


def range_of(key: str, bounds: list[int]):
    """The number of boundaries up to the key: a coarse step over every n-th of them, a fine one between two of those."""
    step = max(1, int(len(bounds) ** 0.5))
    if not bounds:
        return F.lit(0)
    coarse = F.size(F.filter(F.lit(bounds[::step]), lambda b: b <= F.col(key)))
    fine = F.slice(F.lit(bounds), F.greatest(coarse - 1, F.lit(0)) * step + 1, F.lit(step))
    return F.when(coarse == 0, 0).otherwise((coarse - 1) * step + F.size(F.filter(fine, lambda b: b <= F.col(key))))


def shard_by_bytes(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) for every row of docs (doc_id, text, ...): shards of near equal bytes.

    The size of a row is the UTF-8 length of its text plus 1; text_crc32 is unsigned; law is 'bytes'; slot counts from 0
    in every shard without gaps; grown_shard is null (this law promises nothing about another number of shards).

    Rows with equal text (by hash) make a unit, and units in the order of their hash fill the shards one after another,
    each unit going where its middle falls; a group over GROUP_SHARE of a shard or MAX_ROWS rows is subdivided by a hash
    of its rows' numbers into units of that size, so one text may hold any share of the table. Positions come without a global
    sort: splitters from a size-weighted sample cut the units into ranges, ranges are summed, and within a range a
    running sum goes on from the sums before. Texts do not move; only the slim rows (hash, id, size) are shuffled.

    Defined cases: a null text has size 1 and checksum 0, like an empty one, and makes one group with other null texts; a
    null doc_id is carried; repeated rows each get a slot of their own, and are subdivided like all others;
    an empty table gives no rows; a single text larger than a shard makes a larger shard; other columns are ignored.
    """
    text = F.col("`text`")
    slim = docs.select(
        F.col("`doc_id`"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("bytes"), F.coalesce(F.crc32(text), F.lit(0)).alias("text_crc32"),
        F.xxhash64(text).alias("key"),
    )
    slim = stored(slim.withColumn("bytes", F.col("bytes") + 1))
    whole = slim.agg(F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"), F.count("*").alias("rows")).first()
    most = max(1, int(whole.bytes / shards * GROUP_SHARE))
    groups = slim.groupBy("key").agg(F.sum("bytes").alias("group_bytes"), F.count("*").alias("group_rows"))
    pieces = F.greatest(F.ceil(F.col("group_bytes") / most), F.ceil(F.col("group_rows") / MAX_ROWS))
    large = groups.select("key", pieces.alias("pieces")).where("pieces > 1")
    # The stored rows are numbered for good, so rows that are equal in all they hold can be told apart as well.
    draw = F.pmod(F.xxhash64("key", F.monotonically_increasing_id()), F.lit(1 << 20))
    rows = slim.withColumn("d", draw).join(large, "key", "left")
    rows = rows.withColumn("piece", F.floor(F.col("d") * F.coalesce("pieces", F.lit(1)) / (1 << 20)))
    rows = rows.select("doc_id", "bytes", "text_crc32", "key", "piece")
    units = rows.groupBy("key", "piece").agg(F.sum("bytes").alias("bytes"), F.count("*").alias("rows"))
    ranges = max(MIN_RANGES, -(-whole.rows // UNITS_PER_RANGE))
    units = stored(units)
    units = units.withColumn("range", range_of("key", splitters(units, ranges, whole.bytes)))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = units.groupBy("range").agg(F.sum("bytes").alias("b")).select("range", F.coalesce(F.sum("b").over(before), F.lit(0)).alias("range_start"))
    within = Window.partitionBy("range").orderBy("key", "piece")
    middle = F.col("range_start") + F.sum("bytes").over(within) - F.col("bytes") / 2
    shard = F.least(F.floor(middle * shards / max(whole.bytes, 1)), F.lit(shards - 1)).cast("int")
    units = stored(units.join(starts, "range").withColumn("shard", shard))
    before = Window.partitionBy("shard").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    firsts = units.groupBy("shard", "range").agg(F.sum("rows").alias("n"))
    firsts = firsts.select("shard", "range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    within = Window.partitionBy("shard", "range").orderBy("key", "piece")
    place = F.col("first") + F.sum("rows").over(within) - F.col("rows")
    placed = units.join(firsts, ["shard", "range"]).select("key", "piece", "shard", place.alias("place"))
    inside = Window.partitionBy("key", "piece").orderBy("doc_id", "bytes", "text_crc32")
    return rows.join(placed, ["key", "piece"]).select(
        "doc_id", F.col("bytes").alias("size"), "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("place") + F.row_number().over(inside) - 1).alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
