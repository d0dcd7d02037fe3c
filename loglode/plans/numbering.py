"""Row numbers within groups of any size: range partitions numbered apart, then put end to end."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loglode.session import cut_lineage


def numbered(
    df: DataFrame, group: Sequence[str], order: Sequence[str], name: str = "row_no", previous: Mapping[str, Column] | None = None
) -> DataFrame:
    """Number the rows of each group from 1 in the order given, and carry values over from the row before.

    ``previous`` names columns that take an expression's value of the preceding row of the
    group (null at its first). The rows are dealt by range over group and order, so a group
    of half of all rows lies in many tasks and is numbered in each of them apart. What the
    pieces of a group before a task hold is a row per group and task; only groups that go on
    from one task to the next need it, so no more rows than there are tasks are broadcast.
    Order columns should end in a unique one; equal rows are numbered in any order.
    """
    previous = dict(previous or {})
    taken = {f"_{i}": c for i, c in enumerate(previous.values())}
    dealt = df.repartitionByRange(*group, *order).sortWithinPartitions(*group, *order)
    rows = cut_lineage(dealt.withColumn("_own", F.struct(F.lit(0).alias("_"), *[c.alias(n) for n, c in taken.items()])))
    rows = rows.withColumn("_task", F.spark_partition_id())
    pieces = rows.groupBy(*group, "_task").agg(
        F.count(F.lit(1)).alias("_n"), F.max_by("_own", F.struct(*order)).alias("_last")
    )
    before = Window.partitionBy(*group).orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    ahead = pieces.withColumns({"_before": F.sum("_n").over(before), "_left": F.last("_last").over(before)})
    ahead = ahead.filter("_before IS NOT NULL").select(*[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)], F.col("_task").alias("_t"), "_before", "_left")
    here = Window.partitionBy("_task", *group).orderBy(*order)
    local = rows.withColumns({"_no": F.row_number().over(here), "_lag": F.lag("_own").over(here)})
    same = F.col("_task") == F.col("_t")
    for i, g in enumerate(group):
        same = same & F.col(g).eqNullSafe(F.col(f"_g{i}"))
    joined = local.join(F.broadcast(ahead), same, "left")
    row_before = F.coalesce("_lag", "_left")
    return joined.select(
        *df.columns,
        (F.col("_no") + F.coalesce("_before", F.lit(0))).cast("long").alias(name),
        *[row_before[f"_{i}"].alias(n) for i, n in enumerate(previous)],
    )
