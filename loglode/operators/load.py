"""Loading versions: staged, checked, and made visible by one append to a table of commits.

Readers see a row only through the commit of its load, so a run that breaks off anywhere
leaves what was there before; what it staged belongs to a load nobody names.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loglode.operators.registry import DELETE, UPLOAD
from loglode.session import path_exists
from loglode.sources.fragments import checked_versions, fragment_chunks, fragment_postings

KEYS = ("machine_id", "version_id")
TABLES = {"chunks": fragment_chunks, "postings": fragment_postings}
DELETIONS = "machine_id string, version_id string, deleted_at timestamp_ntz"
COMMITS = "load string, machine_id string, version_id string, committed_at timestamp_ntz, total_chunks long, total_errors long"


def stage_versions(fragments: DataFrame, path: str, keys: Sequence[str] = KEYS) -> tuple[str, DataFrame]:
    """Write the chunks and postings of all valid versions under a new load; returns it and the verdict on every version."""
    spark, load = fragments.sparkSession, uuid.uuid4().hex
    verdicts = checked_versions(fragments, keys).select(*keys, "n_chunks", "n_postings", "violations")
    verdicts.write.parquet(f"{path}/verdicts/load={load}")
    verdicts = spark.read.parquet(f"{path}/verdicts/load={load}")
    valid = fragments.join(verdicts.filter(F.size("violations") == 0).select(*keys), list(keys), "left_semi")
    for table, rows in TABLES.items():
        rows(valid, keys).write.parquet(f"{path}/{table}/load={load}")
    return load, verdicts


def commit_load(spark: SparkSession, path: str, load: str, committed_at: str, keys: Sequence[str] = KEYS) -> DataFrame:
    """Check what was staged against the verdicts and name its versions in one new file of the commit table.

    A version whose rows are not all there is not named. Returns the committed versions.
    """
    counts = []
    for table in TABLES:
        rows = spark.read.parquet(f"{path}/{table}/load={load}")
        counts.append(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias(f"staged_{table}")))
    valid = spark.read.parquet(f"{path}/verdicts/load={load}").filter(F.size("violations") == 0)
    for c in counts:
        valid = valid.join(c, list(keys), "left")
    whole = valid.fillna(0).filter("staged_chunks = n_chunks AND staged_postings = n_postings")
    rows = whole.select(
        F.lit(load).alias("load"), *keys, F.lit(committed_at).cast("timestamp_ntz").alias("committed_at"),
        F.col("n_chunks").alias("total_chunks"), F.col("n_postings").alias("total_errors"),
    )
    # One file, so one rename makes all versions of the load visible.
    rows.coalesce(1).write.mode("append").parquet(f"{path}/commits")
    return commits(spark, path).filter(F.col("load") == load)


def load_versions(fragments: DataFrame, path: str, committed_at: str, keys: Sequence[str] = KEYS) -> DataFrame:
    """Load all valid versions; returns the verdict on every version: (*keys, n_chunks, n_postings, violations)."""
    load, verdicts = stage_versions(fragments, path, keys)
    commit_load(fragments.sparkSession, path, load, committed_at, keys)
    return verdicts


def commits(spark: SparkSession, path: str) -> DataFrame:
    if not path_exists(spark, f"{path}/commits"):
        return spark.createDataFrame([], COMMITS)
    return spark.read.schema(COMMITS).parquet(f"{path}/commits")


def delete(spark: SparkSession, path: str, gone: DataFrame, deleted_at: str) -> None:
    """Name versions, or whole machines (a null version_id), as deleted at a time: one append, as a commit is.

    What goes with them, versions with their machine and stored rows with their version, is
    settled by readers, so no file is touched; a version loaded again later is there again.
    """
    rows = gone.select("machine_id", "version_id", F.lit(deleted_at).cast("timestamp_ntz").alias("deleted_at")).distinct()
    rows.coalesce(1).write.mode("append").parquet(f"{path}/deletions")


def deletions(spark: SparkSession, path: str) -> DataFrame:
    if not path_exists(spark, f"{path}/deletions"):
        return spark.createDataFrame([], DELETIONS)
    return spark.read.schema(DELETIONS).parquet(f"{path}/deletions")


def current(spark: SparkSession, path: str, keys: Sequence[str] = KEYS) -> DataFrame:
    """The last commit of every version that lives: a version loaded again replaces itself, one deleted since, or with
    its machine, is not there."""
    last = F.max_by(F.struct("load", "committed_at", "total_chunks", "total_errors"), F.struct("committed_at", "load"))
    newest = commits(spark, path).groupBy(*keys).agg(last.alias("c")).select(*keys, "c.*")
    ended = deletions(spark, path)
    end = F.max("deleted_at")
    of_machine = ended.filter("version_id IS NULL").groupBy("machine_id").agg(end.alias("_machine_gone"))
    of_version = ended.filter("version_id IS NOT NULL").groupBy(*keys).agg(end.alias("_version_gone"))
    dated = newest.join(of_machine, "machine_id", "left").join(of_version, list(keys), "left")
    gone = F.greatest("_machine_gone", "_version_gone")
    return dated.filter(gone.isNull() | (F.col("committed_at") > gone)).drop("_machine_gone", "_version_gone")


def stale_loads(spark: SparkSession, path: str) -> list[str]:
    """Loads that no living version comes from: their folders may be removed. One row a load, not a version."""
    named = commits(spark, path).select("load").distinct()
    return [r.load for r in named.join(current(spark, path).select("load").distinct(), "load", "left_anti").collect()]


def compact(spark: SparkSession, source: str, target: str, committed_at: str) -> DataFrame:
    """Write what lives in one store to another as a single load: deleted and replaced rows stay behind."""
    load = uuid.uuid4().hex
    alive = current(spark, source)
    for table in TABLES:
        loaded(spark, source, table).write.parquet(f"{target}/{table}/load={load}")
    rows = alive.withColumns({"load": F.lit(load), "committed_at": F.lit(committed_at).cast("timestamp_ntz")})
    rows.select("load", *KEYS, "committed_at", "total_chunks", "total_errors").coalesce(1).write.mode("append").parquet(f"{target}/commits")
    return current(spark, target)


def loaded(spark: SparkSession, path: str, table: str, keys: Sequence[str] = KEYS) -> DataFrame:
    """The chunks or postings readers see; the loads they come from prune the folders."""
    rows = spark.read.option("basePath", f"{path}/{table}").parquet(f"{path}/{table}")
    return rows.join(current(spark, path, keys).select("load", *keys), ["load", *keys], "left_semi").drop("load")


def events(spark: SparkSession, path: str, keys: Sequence[str] = KEYS) -> DataFrame:
    """Commits and deletions as events of the registry; a machine's deletion is one of each of its versions."""
    loads = commits(spark, path).select(*keys, F.lit(UPLOAD).alias("op"), F.col("committed_at").alias("ts"))
    ended = deletions(spark, path)
    whole = ended.filter("version_id IS NULL").select("machine_id", "deleted_at").join(loads.select(*keys).distinct(), "machine_id")
    ends = ended.filter("version_id IS NOT NULL").unionByName(whole.select(*ended.columns))
    return loads.unionByName(ends.select(*keys, F.lit(DELETE).alias("op"), F.col("deleted_at").alias("ts")))
