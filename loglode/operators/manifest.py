"""Tree manifests: entries, fingerprint, comparison."""

from __future__ import annotations

import hashlib
import sys
from collections.abc import Iterator, Sequence
from functools import reduce

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Entry fields in canonical order, and how many mismatches a report shows.
ENTRY_FIELDS = ["error", "link_target", "path", "sha256", "size", "type"]
SHOWN_MISMATCHES = 50
STATUS_ORDER = ["only_in_a", "only_in_b", "different", "identical"]
#: Hex digits of a leaf's bucket in a digest tree, and of each level.
LEAF, STEP = 4, 2


def manifest_entries(listing: DataFrame, key: Sequence[str] = ("machine",)) -> DataFrame:
    """Entries of a listing (path, type, length, content, link_target, error).

    Links to directories are no entries. Files get size and SHA-256, links their target, directories neither. The content
    column is read by the hash only, so it never leaves the scan stage.
    """
    is_file = F.col("type") == "file"
    return listing.filter(F.col("type").isin("file", "dir", "symlink")).select(
        *key,
        F.translate("path", "\\", "/").alias("path"),
        "type",
        F.when(is_file, F.col("length")).alias("size"),
        F.when(is_file & F.col("error").isNull(), F.sha2("content", 256)).alias("sha256"),
        F.when(F.col("type") == "symlink", F.translate("link_target", "\\", "/")).alias("link_target"),
        "error",
    )


def canonical_line(df: DataFrame) -> Column:
    """``key:value`` pairs in key order; fields an entry lacks are left out."""
    present = [f for f in ENTRY_FIELDS if f in df.columns]
    pairs = [F.concat(F.lit(f + ":"), F.col(f).cast("string")) for f in present]
    return F.concat_ws("|", *pairs)


def manifest_stats(entries: DataFrame, key: Sequence[str] = ("machine",)) -> DataFrame:
    kind = lambda t: F.count_if(F.col("type") == t)
    return entries.groupBy(*key).agg(
        kind("file").alias("file_count"),
        kind("symlink").alias("symlink_count"),
        kind("dir").alias("dir_count"),
        F.coalesce(F.sum("size"), F.lit(0)).alias("total_bytes"),
        F.count("error").alias("error_count"),
        F.count(F.lit(1)).alias("total_entries"),
    )


cloudpickle.register_pickle_by_value(sys.modules[__name__])

BLOCK_BYTES = 1 << 20
_BLOCK = pa.schema(
    [("tree", pa.string()), ("first_path", pa.string()), ("n", pa.int64()), ("block", pa.string())]
)
_PRINT = pa.schema([("tree", pa.string()), ("n_entries", pa.int64()), ("fingerprint", pa.string())])


def _pack_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Join neighbouring sorted lines of a tree to blocks of about a megabyte."""
    held: list[str] = []
    tree = first = None
    size = 0

    def flush() -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist(
            [{"tree": tree, "first_path": first, "n": len(held), "block": "\n".join(held)}], schema=_BLOCK
        )

    for batch in batches:
        for name, path, line in zip(*(c.to_pylist() for c in batch.columns)):
            if held and (name != tree or size >= BLOCK_BYTES):
                yield flush()
                held, size = [], 0
            if not held:
                tree, first = name, path
            held.append(line)
            size += len(line)
    if held:
        yield flush()


def _hash_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chain the ordered blocks of each tree through one hash state."""
    tree, n, digest = None, 0, None

    def done() -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist(
            [{"tree": tree, "n_entries": n, "fingerprint": digest.hexdigest()}], schema=_PRINT
        )

    for batch in batches:
        for name, _, count, block in zip(*(c.to_pylist() for c in batch.columns)):
            if digest is not None and name != tree:
                yield done()
                digest = None
            if digest is None:
                tree, n, digest = name, 0, hashlib.sha256()
            else:
                digest.update(b"\n")
            digest.update(block.encode("utf-8"))
            n += count
    if digest is not None:
        yield done()


def tree_fingerprint(entries: DataFrame, key: str = "machine") -> DataFrame:
    """SHA-256 over the canonical lines of each tree in path order.

    The hash is a chain, so the lines of one tree must pass one hash state in order.
    All other work is spread: range partitions over (tree, path) sort and pack the
    lines, however large a tree is; only the packed blocks of a tree then stream
    through the task that chains them. Run it on a stored manifest, as the range
    partitioning samples its input.
    """
    lines = entries.select(F.col(key).cast("string").alias("tree"), "path", canonical_line(entries).alias("line"))
    packed = (
        lines.repartitionByRange("tree", "path")
        .sortWithinPartitions("tree", "path")
        .mapInArrow(_pack_lines, "tree string, first_path string, n bigint, block string")
    )
    prints = (
        packed.repartition("tree")
        .sortWithinPartitions("tree", "first_path")
        .mapInArrow(_hash_blocks, "tree string, n_entries bigint, fingerprint string")
    )
    return prints.withColumnRenamed("tree", key)


def with_bucket(entries: DataFrame) -> DataFrame:
    """Adds the bucket of a path, LEAF hex digits of its digest."""
    return entries.withColumn("bucket", F.substring(F.sha2("path", 256), 1, LEAF))


def tree_digests(entries: DataFrame, key: Sequence[str] = ("machine",)) -> DataFrame:
    """(*key, bucket, n_entries, digest) of every node of each tree's digest tree.

    A path lies in the bucket its own digest begins with. A leaf's digest is that of its
    canonical lines in order, an inner node's that of its children; the root's bucket is the
    empty text. Buckets are hashed side by side, so no tree passes through one task, and a
    leaf holds a 65 536th of a tree.
    """
    lines = with_bucket(entries).select(*key, "bucket", canonical_line(entries).alias("line"))
    nodes = lines.groupBy(*key, "bucket").agg(
        F.count(F.lit(1)).alias("n_entries"), F.sha2(F.array_join(F.array_sort(F.collect_list("line")), "\n"), 256).alias("digest")
    )
    levels = [nodes]
    for size in range(LEAF - STEP, -1, -STEP):
        children = F.transform(F.array_sort(F.collect_list(F.struct("bucket", "digest"))), lambda x: F.concat(x["bucket"], F.lit(" "), x["digest"]))
        nodes = nodes.groupBy(*key, F.substring("bucket", 1, size).alias("parent")).agg(
            F.sum("n_entries").alias("n_entries"), F.sha2(F.array_join(children, "\n"), 256).alias("digest")
        ).withColumnRenamed("parent", "bucket")
        levels.append(nodes)
    return reduce(DataFrame.unionByName, levels)


def write_tree(entries: DataFrame, path: str) -> None:
    """Store one tree: its entries in folders by the first digits of their bucket, and its digests."""
    own = with_bucket(entries)
    own.withColumn("folder", F.concat(F.lit("b"), F.substring("bucket", 1, STEP))).repartition("folder").write.partitionBy("folder").parquet(f"{path}/entries")
    tree_digests(entries, ()).coalesce(1).write.parquet(f"{path}/digests")


def differing_buckets(a: DataFrame, b: DataFrame) -> DataFrame:
    """(bucket, in_a, in_b) of the nodes that are not the same in both digest trees."""
    left, right = (t.select("bucket", F.col("digest").alias(n)) for t, n in ((a, "_a"), (b, "_b")))
    both = left.join(right, "bucket", "full_outer")
    return both.filter(~F.col("_a").eqNullSafe(F.col("_b"))).select("bucket", F.col("_a").isNotNull().alias("in_a"), F.col("_b").isNotNull().alias("in_b"))


def compare_by_buckets(a: DataFrame, b: DataFrame) -> DataFrame:
    """All paths of two trees, as `compare_manifests` gives them: the digests of both settle which buckets need a join."""
    differ = differing_buckets(tree_digests(a, ()), tree_digests(b, ()))
    leaves = differ.filter(F.length("bucket") == LEAF).select("bucket")
    sides = [with_bucket(s) for s in (a, b)]
    return _compared(*sides, leaves).unionByName(_identical(sides[0], leaves))


def _compared(a: DataFrame, b: DataFrame, leaves: DataFrame) -> DataFrame:
    return compare_manifests(*[s.join(leaves, "bucket", "left_semi") for s in (a, b)])


def _identical(a: DataFrame, leaves: DataFrame) -> DataFrame:
    none = F.array().cast("array<string>").alias("differences")
    return a.join(leaves, "bucket", "left_anti").select("path", F.lit("identical").alias("status"), none)


def compare_trees(spark: SparkSession, a: str, b: str, identical: bool = False) -> DataFrame:
    """Differences of two stored trees, as `compare_manifests` gives them.

    The digests tell which of the (at most 256) folders differ; only these are read, and of
    them only buckets that differ are joined. With ``identical`` the paths of all other
    buckets are listed too, from A alone.
    """
    trees = [spark.read.parquet(f"{p}/digests") for p in (a, b)]
    differ = differing_buckets(*trees)
    folders = ["b" + r.bucket for r in differ.filter(F.length("bucket") == STEP).select("bucket").collect()]
    leaves = differ.filter(F.length("bucket") == LEAF).select("bucket")
    sides = [spark.read.parquet(f"{p}/entries") for p in (a, b)]
    found = _compared(*[s.filter(F.col("folder").isin(folders)) for s in sides], leaves)
    return found.unionByName(_identical(sides[0], leaves)) if identical else found


def entry_differences(a: str = "a", b: str = "b") -> Column:
    """Text of each difference between two entry structs."""

    def pair(field: str, missing: str | None = None) -> Column:
        x, y = (F.coalesce(F.col(f"{s}.{field}").cast("string"), F.lit(missing or "None")) for s in (a, b))
        return F.concat(F.lit(f"{field}: "), x, F.lit(" vs "), y)

    def differ(field: str) -> Column:
        return ~F.col(f"{a}.{field}").eqNullSafe(F.col(f"{b}.{field}"))

    def both(kind: str) -> Column:
        return (F.col(f"{a}.type") == kind) & (F.col(f"{b}.type") == kind)

    ea, eb = F.col(f"{a}.error"), F.col(f"{b}.error")
    error = F.when(
        ~ea.eqNullSafe(eb),
        F.when(eb.isNull(), F.concat(F.lit("error in A: "), ea))
        .when(ea.isNull(), F.concat(F.lit("error in B: "), eb))
        .otherwise(pair("error")),
    )
    options = F.array(
        F.when(differ("type"), pair("type")),
        F.when(both("file") & differ("size"), pair("size")),
        F.when(both("file") & differ("sha256"), pair("sha256", "missing")),
        F.when(both("symlink") & differ("link_target"), pair("link_target")),
        error,
    )
    return F.filter(options, lambda d: d.isNotNull())


def compare_manifests(a: DataFrame, b: DataFrame, key: Sequence[str] = ("path",)) -> DataFrame:
    """One row per path of either side: status and differences. One full outer join on path."""
    fields = ["type", "size", "sha256", "link_target", "error"]
    left = a.select(*key, F.struct(*fields).alias("a"))
    right = b.select(*key, F.struct(*fields).alias("b"))
    joined = left.join(right, list(key), "full_outer").withColumn("differences", entry_differences())
    status = (
        F.when(F.col("b").isNull(), "only_in_a")
        .when(F.col("a").isNull(), "only_in_b")
        .when(F.size("differences") > 0, "different")
        .otherwise("identical")
    )
    none = F.array().cast("array<string>")
    return joined.select(
        *key,
        status.alias("status"),
        F.when(status == "different", F.col("differences")).otherwise(none).alias("differences"),
    )


def compare_summary(compared: DataFrame) -> DataFrame:
    """Counts per status and whether both trees are the same."""
    counts = compared.agg(
        *[F.count_if(F.col("status") == s).alias(s) for s in STATUS_ORDER],
        F.count(F.lit(1)).alias("total_paths"),
    )
    return counts.withColumn("is_identical", F.col("identical") == F.col("total_paths"))


def top_mismatches(compared: DataFrame, limit: int | None = SHOWN_MISMATCHES, group: Sequence[str] = ()) -> DataFrame:
    """First mismatches of each group: missing in B, missing in A, different; by path."""
    rank = F.array_position(F.array(*[F.lit(s) for s in STATUS_ORDER]), F.col("status"))
    found = compared.filter("status <> 'identical'")
    ranked = found.withColumn("mismatch_no", F.row_number().over(Window.partitionBy(*group).orderBy(rank, "path")))
    return ranked if limit is None else ranked.filter(F.col("mismatch_no") <= limit)


def path_difference(a: DataFrame, b: DataFrame, key: Sequence[str] = ("path",)) -> DataFrame:
    """Paths of A that B lacks."""
    return a.select(*key).distinct().join(b.select(*key), list(key), "left_anti")
