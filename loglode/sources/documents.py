"""Index documents, manifests, log blocks and registry tables: readers and writers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loglode import schemas
from loglode.operators.chunks import SCHEMA_VERSION

# Fields an index document must have.
REQUIRED_FIELDS = ["schema_version", "created_at", "chunks", "error_index", "stats"]
CHUNK_FIELDS = [
    "chunk_id", "file_path", "function_name", "class_name", "line_start", "line_end", "signature", "code",
    "docstring", "leading_comment", "error_messages", "log_levels",
]
INDEX_KEYS = ["machine_id", "version_id"]


def read_index_documents(spark: SparkSession, path: str) -> DataFrame:
    """One row per JSON file: source, raw text, digest."""
    raw = spark.read.text(path, wholetext=True).withColumn("source", F.col("_metadata.file_path"))
    return raw.select("source", "value", F.sha2("value", 256).alias("file_sha256"))


def parse_documents(raw: DataFrame, value: str = "value") -> DataFrame:
    return raw.withColumn("doc", F.from_json(F.col(value), schemas.INDEX_DOCUMENT))


def created_time(created_at: Column) -> Column:
    """ISO time as naive UTC."""
    return F.to_utc_timestamp(F.try_to_timestamp(F.regexp_replace(created_at, "Z$", "+00:00")), "UTC").cast("timestamp_ntz")


def with_violations(
    parsed: DataFrame, value: str = "value", n_chunks: Column | None = None, n_postings: Column | None = None
) -> DataFrame:
    """Add ``violations``: everything that would reject an index document.

    The counts are those of the document's own lists, or given where the lists are elsewhere.
    """
    raw = F.try_parse_json(F.col(value))
    doc = F.col("doc")
    kind = lambda f: F.coalesce(F.schema_of_variant(F.try_variant_get(raw, f"$.{f}", "variant")), F.lit(""))
    present = lambda f: F.try_variant_get(raw, f"$.{f}", "variant").isNotNull()
    if n_chunks is None:
        n_chunks = F.size(doc["chunks"])
    if n_postings is None:
        n_postings = F.aggregate(F.map_values(doc["error_index"]), F.lit(0), lambda a, x: a + F.size(x))
    tests = [F.when(~present(f), F.lit(f"Missing required field: {f}")) for f in REQUIRED_FIELDS]
    tests += [
        F.when(present("chunks") & ~kind("chunks").startswith("ARRAY"), "Field 'chunks' must be an array"),
        F.when(present("error_index") & ~kind("error_index").startswith("OBJECT"), "Field 'error_index' must be an object"),
        F.when(present("stats") & ~kind("stats").startswith("OBJECT"), "Field 'stats' must be an object"),
        F.when(doc["total_chunks"] != n_chunks, "total_chunks does not match chunks"),
        F.when(doc["total_errors"] != n_postings, "total_errors does not match error_index"),
        F.when(doc["schema_version"] == "", "Missing 'schema_version' field in index"),
        F.when(doc["created_at"] == "", "Missing 'created_at' field in index"),
        F.when((doc["created_at"] != "") & created_time(doc["created_at"]).isNull(), "Invalid 'created_at' format"),
    ]
    violations = F.filter(F.array(*tests), lambda v: v.isNotNull())
    return parsed.withColumn("violations", F.when(raw.isNull(), F.array(F.lit("Invalid JSON"))).otherwise(violations))


def document_chunks(docs: DataFrame, keys: Sequence[str] = INDEX_KEYS) -> DataFrame:
    return docs.select(*keys, F.explode("doc.chunks").alias("c")).select(*keys, "c.*")


def document_postings(docs: DataFrame, keys: Sequence[str] = INDEX_KEYS) -> DataFrame:
    """Postings with the place each one has under its key."""
    per_key = docs.select(*keys, F.explode("doc.error_index").alias("error_key", "postings"))
    return per_key.select(*keys, "error_key", F.posexplode("postings").alias("posting_pos", "p")).select(
        *keys, "error_key", "posting_pos", "p.*"
    )


def index_parts(chunks: DataFrame, postings: DataFrame, keys: Sequence[str] = INDEX_KEYS) -> DataFrame:
    """Interchange rows of an index, one JSON object per row: header, chunks, one row per posting.

    A key can hold any share of the postings, so the exchange form of a large index
    is this table (``part``, ``json``); one whole document per version is
    ``index_document`` and meant for indexes of a single tree.
    """
    chunk = chunks.withColumn("file_path", F.col("path")).select(
        *keys, F.lit("chunk").alias("part"), F.to_json(F.struct(*CHUNK_FIELDS), {"ignoreNullFields": "false"}).alias("json")
    )
    posting = postings.select(
        *keys,
        F.lit("posting").alias("part"),
        F.to_json(F.struct("error_key", "chunk_id", "original_message", "log_level", "source_type")).alias("json"),
    )
    return chunk.unionByName(posting)


def index_document(
    chunks: DataFrame, postings: DataFrame, totals: DataFrame, created_at: str, keys: Sequence[str] = INDEX_KEYS
) -> DataFrame:
    """One JSON document per (machine, version), as the upload takes it.

    The document format itself holds a version whole in one value; use it per source
    tree (whose files are capped) and ``index_parts`` or the tables for bulk.
    """
    keys = list(keys)
    own = chunks.withColumn("file_path", F.col("path"))
    chunk_list = own.groupBy(*keys).agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("path", "fn_seq", F.struct(*CHUNK_FIELDS).alias("c")))), lambda x: x["c"]
        ).alias("chunks")
    )
    posting = F.struct("chunk_id", "original_message", "log_level", "source_type")
    per_key = postings.groupBy(*keys, "error_key").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("path", "fn_seq", "error_pos", posting.alias("p")))), lambda x: x["p"]
        ).alias("ps")
    )
    index = per_key.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("error_key", "ps"))).alias("error_index"))
    stats = F.struct("files_processed", "files_failed", "functions_found", "errors_found")
    body = F.struct(
        F.lit(SCHEMA_VERSION).alias("schema_version"),
        F.lit(created_at).alias("created_at"),
        F.coalesce("chunks", F.array().cast(dict(chunk_list.dtypes)["chunks"])).alias("chunks"),
        F.coalesce("error_index", F.create_map().cast(f"map<string,array<{schemas.POSTING}>>")).alias("error_index"),
        stats.alias("stats"),
        "total_chunks",
        "total_errors",
    )
    joined = totals.join(chunk_list, keys, "left").join(index, keys, "left")
    return joined.select(*keys, F.to_json(body, {"ignoreNullFields": "false", "pretty": "true"}).alias("value"))


def write_index(df: DataFrame, path: str, keys: Sequence[str] = INDEX_KEYS) -> None:
    """Store chunks or postings as parquet by machine and version; only touched versions are replaced."""
    writer = df.write.partitionBy(*keys).mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.parquet(path)


def read_index(spark: SparkSession, path: str, machine: str | None = None, version: str | None = None) -> DataFrame:
    """Stored chunks or postings; machine and version prune partitions."""
    df = spark.read.parquet(path)
    if machine is not None:
        df = df.filter(F.col("machine_id") == machine)
    return df if version is None else df.filter(F.col("version_id") == version)


def drop_versions(df: DataFrame, deleted: DataFrame, keys: Sequence[str] = INDEX_KEYS) -> DataFrame:
    """Rows of the versions that are left after deletions."""
    return df.join(deleted.select(*keys), list(keys), "left_anti")


def index_sizes(docs: DataFrame, value: str = "value", keys: Sequence[str] = INDEX_KEYS) -> DataFrame:
    """Raw bytes of the stored documents; compressed bytes come from the written files."""
    return docs.groupBy(*keys).agg(F.sum(F.octet_length(value)).alias("raw_bytes"), F.count(F.lit(1)).alias("n_documents"))


def file_sizes(spark: SparkSession, path: str) -> DataFrame:
    """Bytes of written files, read from the listing only."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "length")


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Entries of manifest files; comments, blanks and bad lines are skipped, the last line of a path wins."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("source"), F.monotonically_increasing_id().alias("n"))
    return parse_manifest(lines)


def parse_manifest(lines: DataFrame) -> DataFrame:
    """``lines``: source, n (order of the lines), value."""
    kept = lines.filter((F.trim("value") != "") & ~F.startswith(F.ltrim("value"), F.lit("#")))
    entry = F.from_json("value", schemas.MANIFEST_ENTRY)
    rows = kept.select("source", "n", entry.alias("e")).filter(F.col("e.path") != "")
    last = rows.groupBy("source", F.col("e.path").alias("path")).agg(F.max_by("e", "n").alias("e"))
    return last.select("source", "e.*")


def manifest_lines(entries: DataFrame) -> DataFrame:
    """JSON lines in path order, keys sorted, absent fields left out."""
    fields = ["error", "link_target", "path", "sha256", "size", "type"]
    return entries.select("path", F.to_json(F.struct(*fields)).alias("value")).orderBy("path").select("value")


def manifest_header(stats: DataFrame, prints: DataFrame, machine: str = "machine") -> DataFrame:
    """Header lines of each manifest, as a table of their own."""
    rows = stats.join(prints, machine)
    return rows.select(
        machine,
        F.posexplode(
            F.array(
                F.concat(F.lit("# Machine: "), machine),
                F.concat(F.lit("# Total files: "), F.col("file_count").cast("string")),
                F.concat(F.lit("# Total bytes: "), F.col("total_bytes").cast("string")),
                F.concat(F.lit("# Total symlinks: "), F.col("symlink_count").cast("string")),
                F.concat(F.lit("# Total directories: "), F.col("dir_count").cast("string")),
                F.concat(F.lit("# Total entries: "), F.col("total_entries").cast("string")),
                F.concat(F.lit("# Errors: "), F.col("error_count").cast("string")),
                F.concat(F.lit("# Fingerprint ID: "), "fingerprint"),
            )
        ).alias("line_no", "value"),
    )


def read_log_blocks(spark: SparkSession, path: str, whole: bool = True) -> DataFrame:
    """Pasted blocks, one file each, or one row per line."""
    raw = spark.read.text(path, wholetext=whole)
    return raw.select(F.col("_metadata.file_path").alias("block_id"), F.col("value").alias("text"))


def read_registry(spark: SparkSession, location: str, table: str | None = None, **options: str) -> DataFrame:
    """Registry table from parquet, or over JDBC when the location is a JDBC URL."""
    if location.startswith("jdbc:"):
        return spark.read.format("jdbc").options(url=location, dbtable=table, **options).load()
    return spark.read.parquet(location if table is None else f"{location}/{table}")


def result_bundle(matches: DataFrame, group: Sequence[str], per_group: int) -> DataFrame:
    """JSON bundle per block: input, parsed fields, matches, selected first match.

    ``matches`` are ranked and already cut to ``per_group`` rows, so the list is bounded.
    """
    fields = ["timestamp", "host_or_serial", "process", "level", "thread", "component", "message"]
    shown = [
        "rank", "path", "line_no", "line_text", "match_type", "score", "enclosure_type", "name", "signature",
        "confidence_percent", "location_short", "enclosure_display_name", "summary_text",
    ]
    kept = matches.filter(F.col("rank") <= per_group)
    per_block = kept.groupBy(*group).agg(
        F.first(F.struct("selected_line", "search_message")).alias("input"),
        F.first(F.struct(*fields)).alias("parsed"),
        F.array_sort(F.collect_list(F.struct(*shown))).alias("matches"),
    )
    body = F.struct("input", "matches", "parsed", F.get("matches", 0).alias("selected"))
    return per_block.select(*group, F.to_json(body, {"pretty": "true"}).alias("bundle"))


def write_json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)
