"""Machine and version registry as a fold over an append-only event table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loglode.plans.numbering import numbered

# Operations of the event table and index states.
UPLOAD, ACTIVATE, DELETE = "upload", "activate", "delete"
HEALTHY, BUILDING, ERROR, UNKNOWN = "healthy", "building", "error", "unknown"
UUID_PATTERN = "^[0-9a-fA-F]{8}-?[0-9a-fA-F]{4}-?[0-9a-fA-F]{4}-?[0-9a-fA-F]{4}-?[0-9a-fA-F]{12}$"


def version_lifetimes(events: DataFrame) -> DataFrame:
    """Per version: upload, deletion and last choice (upload or activation) while it lived.

    ``events``: machine_id, version_id, op, ts. A version counts from its upload on.
    """
    at = lambda op: F.when(F.col("op") == op, F.col("ts"))
    lives = events.groupBy("machine_id", "version_id").agg(
        F.min(at(UPLOAD)).alias("created_at"),
        F.min(at(DELETE)).alias("deleted_at"),
    )
    lives = lives.filter("created_at is not null")
    # A version that is gone cannot be activated: only what came before its deletion counts.
    picks = events.filter(F.col("op") != DELETE).join(lives.select("machine_id", "version_id", "deleted_at"), ["machine_id", "version_id"])
    picks = picks.filter("deleted_at is null or ts < deleted_at")
    chosen = picks.groupBy("machine_id", "version_id").agg(F.max("ts").alias("chosen_at"))
    return lives.join(chosen, ["machine_id", "version_id"], "left")


def active_versions(events: DataFrame) -> DataFrame:
    """Active version of each machine after all events.

    The last upload or activation wins while its version lives. When that version
    was deleted, the newest one by upload that is still there takes over, and so on
    down; later deletions of the substitute move on the same way, so the outcome is
    the newest surviving version uploaded before the (last) deletion. Everything is
    max/min per machine, so a machine with a third of all events costs no single task.
    """
    lives = version_lifetimes(events)
    stamp = lambda c: F.struct(F.col(c).alias("ts"), F.col("version_id"))
    alive = F.col("deleted_at").isNull()
    per_machine = lives.groupBy("machine_id").agg(
        F.max(F.struct(F.col("chosen_at").alias("ts"), "version_id", alive.alias("alive"))).alias("chosen"),
        F.max(F.when(alive, stamp("created_at"))).alias("newest"),
    )
    # A survivor uploaded after the chosen one's stamp would itself be the chosen one.
    return per_machine.select(
        "machine_id",
        F.when(F.col("chosen.alive"), F.col("chosen.version_id")).otherwise(F.col("newest.version_id")).alias("version_id"),
    )


def versions_table(events: DataFrame) -> DataFrame:
    """Surviving versions with their active mark."""
    lives = version_lifetimes(events).filter("deleted_at is null").select("machine_id", "version_id", "created_at")
    active = active_versions(events).withColumn("is_active", F.lit(True))
    return lives.join(active, ["machine_id", "version_id"], "left").fillna({"is_active": False})


def version_history(versions: DataFrame) -> DataFrame:
    """Versions numbered by age per machine, with the version each one followed.

    The versions of one machine are numbered over as many tasks as they fill.
    """
    carried = {"previous_version_id": F.col("version_id"), "previous_created_at": F.col("created_at")}
    return numbered(versions, ["machine_id"], ["created_at", "version_id"], "version_no", carried)


def machines_with_active(machines: DataFrame, active: DataFrame) -> DataFrame:
    """Every machine with its active version, null where there is none."""
    mine = active.select(F.col("machine_id").alias("id"), F.col("version_id").alias("active_version_id"))
    return machines.join(mine, "id", "left")


def fold_machines(changes: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Machines from their changes (create, update, delete): each field keeps its last given value."""
    given = [F.max_by(f, F.when(F.col(f).isNotNull(), F.col("ts"))).alias(f) for f in fields]
    folded = changes.groupBy("id").agg(
        *given,
        F.min(F.when(F.col("op") == "create", F.col("ts"))).alias("created_at"),
        F.max("ts").alias("updated_at"),
        F.max(F.when(F.col("op") == "delete", F.col("ts"))).alias("_deleted"),
    )
    return folded.filter("created_at is not null and _deleted is null").drop("_deleted")


def without_deleted(versions: DataFrame, machines: DataFrame) -> DataFrame:
    """Versions go with their machine."""
    return versions.join(machines.select(F.col("id").alias("machine_id")), "machine_id", "left_semi")


def duplicate_names(machines: DataFrame, name: str = "display_name") -> DataFrame:
    """Names held by more than one machine: the lowest id keeps it."""
    held = machines.groupBy(name).agg(F.count(F.lit(1)).alias("n_machines"), F.min("id").alias("kept_id"))
    return held.filter("n_machines > 1")


def accept_uploads(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Validated index documents split into accepted and rejected ones."""
    return documents.filter(F.size("violations") == 0), documents.filter(F.size("violations") > 0)


def index_status(machines: DataFrame, versions: DataFrame) -> DataFrame:
    """One state per machine's index: active means healthy, pending versions building."""
    per_machine = versions.groupBy("machine_id").agg(
        F.max("created_at").alias("last_built"),
        F.count(F.lit(1)).alias("n_versions"),
        F.bool_or("is_active").alias("has_active"),
    )
    joined = machines.join(per_machine.withColumnRenamed("machine_id", "id"), "id", "left")
    status = (
        F.when(F.col("n_versions").isNull(), UNKNOWN).when(F.col("has_active"), HEALTHY).otherwise(BUILDING)
    )
    return joined.withColumn("status", status)
