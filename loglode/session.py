"""Session settings the jobs rely on."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Set where a session handed in leaves them open: AQE splits skewed join partitions
# even where that costs one more exchange, and Arrow batches stay small because one
# row may hold a whole source file.
RUNTIME_SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # Parsing is heavy per byte: small stages keep all cores; large ones never get this small.
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64k",
    "spark.sql.optimizer.runtime.bloomFilter.enabled": "true",
    "spark.sql.execution.arrow.maxBytesPerBatch": "4m",
    "spark.sql.session.timeZone": "UTC",
}

#: Shuffle files of a finished step are removed at once, not when the driver's heap is next cleared.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def tune(spark: SparkSession) -> SparkSession:
    for key, value in RUNTIME_SETTINGS.items():
        if spark.conf.get(key, None) is None:
            spark.conf.set(key, value)
    return spark


def build_session(app: str = "loglode", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings above; cluster settings win where already set."""
    builder = SparkSession.builder.appName(app).config("spark.ui.enabled", "false")
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key, value)
    return tune(builder.getOrCreate())


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder of the session, which all executors and the driver share.

    It is the one the session names. On a local master, as in tests, a new scratch folder
    serves where none is named; a cluster has to name one.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named:
            context.setCheckpointDir(named)
        elif context.master == "local" or context.master.startswith("local["):
            context.setCheckpointDir(tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
        else:
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
    return context.getCheckpointDir()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path nobody uses yet in the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a folder or file is there, in whatever store the path names."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write a reused result to the shared checkpoint folder and go on from there."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """Write a reused result to the shared checkpoint folder as Parquet and go on from there.

    Repeated values (machines, versions, words) take little room on disk, which the rows of a checkpoint do not, and
    later steps read only the columns they ask for. The shuffle files of this step go when it is written.
    """
    spark, path = df.sparkSession, scratch_path(df.sparkSession, "stored")
    before = spark.conf.get(SHUFFLE_CLEANUP, None)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.unset(SHUFFLE_CLEANUP) if before is None else spark.conf.set(SHUFFLE_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)
