"""Code-root discovery, scan statistics and size figures over a file listing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loglode.functions import paths as P

# Scores and limits of the discovery.
GIT_SCORE = 100
MARKER_SCORE = 20
CODE_FILE_CAP = 50
MAX_DEPTH = 6
MAX_CANDIDATES = 200


def code_roots(
    listing: DataFrame,
    key: Sequence[str] = (),
    max_depth: int = MAX_DEPTH,
    excluded: list[str] = P.SEARCH_EXCLUDED_DIRS,
) -> DataFrame:
    """Score of every directory by repository marks and code files; one map-side combined aggregate.

    ``listing`` has relative ``path`` and ``type`` (file, dir or symlink). A ``.git``
    directory counts 100 and is a marker as well; it is also known from any path below it.
    """
    rel, name = F.col("path"), P.basename(F.col("path"))
    in_git = F.regexp_extract(rel, r"^(?:(.*?)/)?\.git/", 1)
    has_git_part = rel.rlike(r"(^|/)\.git/")
    # A link to a file counts as one; the listing gives it the length of its target.
    linked = (F.col("type") == "symlink") & F.col("length").isNotNull() if "length" in listing.columns else F.lit(False)
    is_file = ((F.col("type") == "file") | linked) & ~has_git_part
    git = has_git_part | ((F.col("type") == "dir") & (name == P.GIT_DIR))
    marker = F.when(is_file & name.isin(P.MARKER_FILES), name).when(git, F.lit(P.GIT_DIR))
    rows = listing.select(
        *key,
        F.when(has_git_part, in_git).otherwise(P.dirname(rel)).alias("dir"),
        marker.alias("marker"),
        is_file.alias("is_file"),
        (is_file & P.extension(rel).isin(P.CODE_EXTENSIONS)).alias("is_code"),
        git.alias("git"),
    )
    depth = F.when(F.col("dir") == "", 0).otherwise(F.size(F.split("dir", "/")))
    rows = rows.filter((depth <= max_depth) & ~P.has_part(F.col("dir"), excluded))
    # The marker set holds at most nine names, however large the directory is.
    per_dir = rows.groupBy(*key, F.col("dir").alias("path")).agg(
        F.coalesce(F.max("git"), F.lit(False)).alias("git"),
        F.array_sort(F.collect_set("marker")).alias("markers"),
        F.count_if("is_code").alias("code_files_here"),
        F.count_if("is_file").alias("total_files_here"),
    )
    score = (
        F.when(F.col("git"), GIT_SCORE).otherwise(0)
        + MARKER_SCORE * F.size("markers")
        + F.least("code_files_here", F.lit(CODE_FILE_CAP))
    )
    return per_dir.withColumn("score", score).filter("score > 0")


def top_code_roots(listing: DataFrame, limit: int | None = MAX_CANDIDATES, key: Sequence[str] = (), **options) -> DataFrame:
    """The best directories of each key by score; None keeps all."""
    roots = code_roots(listing, key, **options)
    ranked = roots.withColumn("root_no", F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("score"), "path")))
    return ranked if limit is None else ranked.filter(F.col("root_no") <= limit)


def scan_stats(listing: DataFrame, reason: str = "skip_reason", key: Sequence[str] = ()) -> DataFrame:
    """Files scanned, and left out per reason."""
    reasons = ["excluded_dir", "symlink", "too_big", "unreadable", "extension"]
    return listing.groupBy(*key).agg(
        F.count_if(F.col(reason).isNull()).alias("files_scanned"),
        *[F.count_if(F.col(reason) == r).alias(f"files_skipped_{r}") for r in reasons],
    )


def scan_throughput(
    listing: DataFrame, elapsed: Column | None = None, key: Sequence[str] = (), reason: str = "skip_reason"
) -> DataFrame:
    """Files found and read, bytes, and rates where the run time is given."""
    out = listing.groupBy(*key).agg(
        F.count(F.lit(1)).alias("files_found"),
        F.count_if(F.col(reason).isNull()).alias("files_scanned"),
        F.count_if(F.col(reason).isNotNull()).alias("files_skipped"),
        F.coalesce(F.sum(F.when(F.col(reason).isNull(), F.col("length"))), F.lit(0)).alias("total_bytes"),
    )
    if elapsed is None:
        return out
    return out.withColumns(
        {
            "seconds_per_file": F.try_divide(elapsed, F.col("files_scanned")),
            "bytes_per_second": F.try_divide(F.col("total_bytes"), elapsed),
        }
    )


def first_files(listing: DataFrame, limit: int, order: Sequence[str] = ("path",)) -> DataFrame:
    """Cap of a scan at N files, in path order, before any content is read."""
    return listing.orderBy(*order).limit(limit)


def pycache_metrics(listing: DataFrame) -> DataFrame:
    cached = F.col("path").rlike(r"(^|/)__pycache__/")
    pyc = F.endswith("path", F.lit(".pyc"))
    is_dir = (F.col("type") == "dir") & (P.basename(F.col("path")) == "__pycache__")
    return listing.agg(
        F.count_if(is_dir).alias("pycache_dirs"),
        F.count_if(pyc).alias("pyc_total"),
        F.count_if(pyc & ~cached).alias("pyc_outside_pycache"),
    )
