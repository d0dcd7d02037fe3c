"""Index documents as ordered fragments: a version of any size without one value that holds it.

A document is a head and a row for every chunk and every posting. The head is the
document itself with its chunks and its error index left empty; `place` orders the rows
as the document has them. Fragments are validated by counts and sums over their version,
never by putting it together.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loglode import schemas
from loglode.operators.chunks import SCHEMA_VERSION
from loglode.session import path_exists, stored
from loglode.sources.documents import CHUNK_FIELDS, INDEX_KEYS, parse_documents, with_violations

HEAD, CHUNK, POSTING = "head", "chunk", "posting"
LINES = "machine_id string, version_id string, part string, place struct<part: int, key: string, path: string, fn_seq: int, pos: int>, json string"
_NULLS = {"ignoreNullFields": "false"}
#: Folders of a machine: a folder a version would be as many renames and listings as there are versions.
FOLDERS, FOLDER = 64, "versions"


def _place(part: int, key: Column, path: Column, fn_seq: Column, pos: Column) -> Column:
    named = {"part": F.lit(part), "key": key.cast("string"), "path": path.cast("string"), "fn_seq": fn_seq.cast("int"), "pos": pos.cast("int")}
    return F.struct(*[c.alias(n) for n, c in named.items()]).alias("place")


def document_fragments(
    chunks: DataFrame, postings: DataFrame, totals: DataFrame, created_at: str, keys: Sequence[str] = INDEX_KEYS
) -> DataFrame:
    """Rows (*keys, part, place, json) of every version that has a row in totals."""
    none = F.lit(None)
    stats = F.struct("files_processed", "files_failed", "functions_found", "errors_found").alias("stats")
    empty = [F.array().cast("array<string>").alias("chunks"), F.create_map().cast("map<string,string>").alias("error_index")]
    head = F.struct(F.lit(SCHEMA_VERSION).alias("schema_version"), F.lit(created_at).alias("created_at"), *empty, stats, "total_chunks", "total_errors")
    heads = totals.select(*keys, F.lit(HEAD).alias("part"), _place(0, none, none, none, none), F.to_json(head).alias("json"))
    body = F.struct(*CHUNK_FIELDS)
    listed = chunks.withColumn("file_path", F.col("path")).select(
        *keys, F.lit(CHUNK).alias("part"), _place(1, none, F.col("path"), F.col("fn_seq"), none), F.to_json(body, _NULLS).alias("json")
    )
    said = F.struct("error_key", "chunk_id", "original_message", "log_level", "source_type")
    posted = postings.select(
        *keys, F.lit(POSTING).alias("part"),
        _place(2, F.col("error_key"), F.col("path"), F.col("fn_seq"), F.col("error_pos")), F.to_json(said, _NULLS).alias("json"),
    )
    return heads.unionByName(listed).unionByName(posted)


def checked_versions(fragments: DataFrame, keys: Sequence[str] = INDEX_KEYS) -> DataFrame:
    """(*keys, doc, n_chunks, n_postings, violations): everything that would reject each version.

    A version without a head, or with two, or with a row that is no JSON, is no JSON document.
    """
    is_part = lambda p: F.col("part") == p
    seen = fragments.groupBy(*keys).agg(
        F.max(F.when(is_part(HEAD), F.col("json"))).alias("value"),
        F.count_if(is_part(HEAD)).alias("n_heads"),
        F.count_if(is_part(CHUNK)).alias("n_chunks"),
        F.count_if(is_part(POSTING)).alias("n_postings"),
        F.bool_or(~is_part(HEAD) & F.try_parse_json("json").isNull()).alias("broken"),
    )
    whole = F.when((F.col("n_heads") == 1) & ~F.col("broken"), F.col("value")).otherwise("")
    parsed = parse_documents(seen.withColumn("value", whole))
    return with_violations(parsed, n_chunks=F.col("n_chunks"), n_postings=F.col("n_postings")).drop("value", "n_heads", "broken")


def fragment_chunks(fragments: DataFrame, keys: Sequence[str] = INDEX_KEYS) -> DataFrame:
    rows = fragments.filter(F.col("part") == CHUNK).select(*keys, F.from_json("json", schemas.CHUNK).alias("c"), F.col("place.fn_seq").alias("fn_seq"))
    return rows.select(*keys, "fn_seq", "c.*")


def fragment_postings(fragments: DataFrame, keys: Sequence[str] = INDEX_KEYS) -> DataFrame:
    said = schemas.POSTING.replace("STRUCT<", "STRUCT<error_key: STRING, ", 1)
    rows = fragments.filter(F.col("part") == POSTING).select(*keys, "place", F.from_json("json", said).alias("p"))
    return rows.select(*keys, "p.*", F.col("place.path").alias("path"), F.col("place.fn_seq").alias("fn_seq"), F.col("place.pos").alias("error_pos"))


def _folder(version: Column) -> Column:
    return F.pmod(F.xxhash64(version), F.lit(FOLDERS)).cast("int").alias(FOLDER)


def _read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(f"{LINES}, {FOLDER} int").json(path)


def write_fragments(fragments: DataFrame, path: str, keys: Sequence[str] = INDEX_KEYS) -> None:
    """JSON lines, a machine's versions dealt over a fixed number of folders, each in the order of its document.

    Many files of a folder are in order by name. What is written replaces its versions; the others that share their
    folders are written again with them.
    """
    spark, (machine, version) = fragments.sparkSession, keys
    rows = fragments.withColumn(FOLDER, _folder(F.col(version)))
    if path_exists(spark, path):
        rows = stored(rows)
        kept = _read(spark, path).join(rows.select(machine, FOLDER).distinct(), [machine, FOLDER], "left_semi")
        rows = rows.unionByName(kept.join(rows.select(*keys).distinct(), list(keys), "left_anti"))
    order = [machine, FOLDER, version, "place"]
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    dealt.write.partitionBy(machine, FOLDER).mode("overwrite").option("partitionOverwriteMode", "dynamic").json(path)


def read_fragments(spark: SparkSession, path: str, machine: str | None = None, version: str | None = None) -> DataFrame:
    """Fragments as written; machine and version prune folders, so one version's download reads one folder of each machine."""
    rows = _read(spark, path)
    if machine is not None:
        rows = rows.filter(F.col("machine_id") == machine)
    if version is not None:
        rows = rows.filter((F.col(FOLDER) == _folder(F.lit(version))) & (F.col("version_id") == version))
    return rows.drop(FOLDER)
