"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loglode.llm.common import stored

#: Edges of a task: rounds over few edges write few files, however many partitions a shuffle has.
TASK_EDGES = 100_000


def components(edges: DataFrame) -> DataFrame:
    """(id, component) for every id of the edges (a, b); the component is the smallest id reachable.

    Union-find in rounds over tables: every id takes its smallest neighbour as parent (if smaller), paths are halved
    until all point at roots, and the edges between different roots go into the next round. Each round is a fixed
    number of joins and sums by key, partial sums first, so an id with very many edges is no task of its own.
    """
    edges = stored(edges.where(F.col("a") != F.col("b")).select("a", "b").distinct())
    tasks = 1 + edges.count() // TASK_EDGES
    found = None
    while True:
        both = edges.union(edges.select("b", "a"))
        parent = both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("n")).select("id", F.least("id", "n").alias("root"))
        parent = _roots(stored(parent.coalesce(tasks)), tasks)
        if found is None:
            found = parent
        else:
            up = parent.select(F.col("id").alias("root"), F.col("root").alias("upper"))
            found = found.join(up, "root", "left").select("id", F.coalesce("upper", "root").alias("root"))
        left = parent.select(F.col("id").alias("a"), F.col("root").alias("ra"))
        right = parent.select(F.col("id").alias("b"), F.col("root").alias("rb"))
        across = edges.join(left, "a").join(right, "b").where("ra <> rb")
        edges = stored(across.select(F.col("ra").alias("a"), F.col("rb").alias("b")).distinct().coalesce(tasks))
        if edges.isEmpty():
            return found.select("id", F.col("root").alias("component"))
        found = stored(found.coalesce(tasks))


def _roots(parent: DataFrame, tasks: int) -> DataFrame:
    """Halve the paths until every parent is a root."""
    while True:
        up = parent.select(F.col("id").alias("root"), F.col("root").alias("upper"))
        halved = parent.join(up, "root", "left").select("id", F.coalesce("upper", "root").alias("upper"), "root")
        halved = stored(halved.select("id", F.col("upper").alias("root"), (F.col("upper") != F.col("root")).alias("moved")).coalesce(tasks))
        moved = not halved.where("moved").isEmpty()
        parent = halved.select("id", "root")
        if not moved:
            return parent
