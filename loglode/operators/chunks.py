"""Function chunks and the inverted index of their error messages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loglode.functions.levels import index_level, looks_like_error
from loglode.functions.text import collapse, split_lines, strip
from loglode.operators.enclosure import INDEX_COMMENT_WINDOW, with_comment
from loglode.operators.syntax import RAISE, with_facts

# How far a signature may run, and the length of a chunk id.
SIGNATURE_LINES = 15
CHUNK_ID_LENGTH = 16
SCHEMA_VERSION = "1.0"


def _signature(lines: Column) -> Column:
    """Header text until its parentheses balance."""
    count = lambda x, c: F.length(x) - F.length(F.replace(x, F.lit(c), F.lit("")))
    start = F.struct(
        F.lit(False).alias("done"), F.lit(0).alias("open"), F.array().cast("array<string>").alias("taken")
    )

    def step(acc: Column, x: Column) -> Column:
        still = acc["open"] + count(x, "(") - count(x, ")")
        ends = (still == 0) | ((F.size(acc["taken"]) == 0) & (still < 0))
        return F.when(acc["done"], acc).otherwise(
            F.struct(ends.alias("done"), still.alias("open"), F.concat(acc["taken"], F.array(x)).alias("taken"))
        )

    return F.aggregate(lines, start, step, lambda acc: collapse(F.array_join(acc["taken"], " ")))


def call_errors(call: Column) -> Column:
    """Error messages one call or raise contributes, with level and source."""
    level = index_level(F.when(call["method"], call["name"]))

    def entry(a: Column) -> Column:
        source = (
            F.when(
                level.isNotNull(),
                F.when(a["form"] == "str", "logging")
                .when(a["form"] == "format", "logging_format_template")
                .when(a["form"] == "percent", "logging_format"),
            )
            .when((a["form"] == "str") & (call["name"] == RAISE), "exception")
            .when((a["form"] == "str") & (call["name"] == "print") & ~call["method"] & looks_like_error(a["text"]), "print")
        )
        return F.struct(
            a["text"].alias("message"), F.coalesce(level, F.lit("E")).alias("log_level"), source.alias("source_type")
        )

    return F.filter(
        F.transform(call["args"], entry), lambda e: e["source_type"].isNotNull() & (F.coalesce(e["message"], F.lit("")) != "")
    )


def chunk_bodies(
    src: DataFrame,
    key: Sequence[str],
    deep: bool = False,
    outer: bool = False,
    signature_lines: int | None = SIGNATURE_LINES,
    comment_window: int | None = INDEX_COMMENT_WINDOW,
) -> DataFrame:
    """One row per function of parsed files (key, text, facts): code, signature, docstring, comment, messages.

    Shuffle-free: every function leaves its file's row as a row of its own, and takes its
    slices of the file's lines and calls only there. With ``outer`` a file without
    functions leaves one empty row, and ``parsed`` tells whether it could be read. The
    limits are lines; None has none.
    """
    # A file that does not parse has no functions; a filter on that would parse every file once more.
    lines = src.withColumn("_lines", split_lines(F.col("text")))
    wanted = F.filter(F.transform("facts.functions", lambda f, i: F.struct(i.alias("fn_seq"), f.alias("f"))),
                      lambda x: x["f"]["via_body"] | F.lit(deep))
    explode = F.explode_outer if outer else F.explode
    rows = lines.select(*key, "facts", "_lines", explode(wanted).alias("x"))
    f = F.col("x.f")
    d, end = f["line_start"], f["line_end"]
    above_from = F.lit(1) if comment_window is None else F.greatest(d - 2 * comment_window, F.lit(1))
    calls = F.slice(F.col("facts.calls"), f["first_call"] + 1, f["n_calls"])
    ordered = F.array_sort(F.transform(calls, lambda c: F.struct(c["depth"], c["seq"], c.alias("c"))), _by_depth)
    head = F.slice(F.col("_lines"), d, end - d + 1 if signature_lines is None else F.lit(signature_lines + 1))
    rows = rows.select(
        *key,
        *([F.col("facts.parsed").alias("parsed")] if outer else []),
        F.col("x.fn_seq").alias("fn_seq"),
        f["name"].alias("function_name"),
        f["class_name"].alias("class_name"),
        d.alias("line_start"),
        end.alias("line_end"),
        _signature(head).alias("signature"),
        F.array_join(F.slice(F.col("_lines"), d, end - d + 1), "\n").alias("code"),
        f["docstring"].alias("docstring"),
        F.reverse(F.slice(F.col("_lines"), above_from, d - above_from)).alias("above"),
        F.flatten(F.transform(ordered, lambda o: call_errors(o["c"]))).alias("error_messages"),
    )
    rows = with_comment(rows, "line_start", comment_window, skip_decorators=False)
    rows = rows.withColumnRenamed("leading_comment_block", "leading_comment").drop(
        "above", "leading_comment_start_line", "leading_comment_end_line"
    )
    return rows.withColumn(
        "log_levels", F.array_sort(F.array_distinct(F.transform("error_messages", lambda e: e["log_level"])))
    )


def with_chunk_id(rows: DataFrame) -> DataFrame:
    """Adds the id of a chunk: a digest of all that is in it and of its path."""
    body = [c for c in rows.columns if c not in ("machine_id", "version_id", "fn_seq")]
    digest = F.sha2(F.to_json(F.struct(*sorted(body))), 256)
    return rows.withColumn("chunk_id", F.substring(digest, 1, CHUNK_ID_LENGTH))


def function_chunks(files: DataFrame, key: Sequence[str] = ("path",), deep: bool = False, **limits: int | None) -> DataFrame:
    """One row per function: code, signature, docstring, comment, messages, id.

    ``deep`` also takes functions defined under else, except, finally and match arms;
    ``limits`` are those of `chunk_bodies`.
    """
    return with_chunk_id(chunk_bodies(with_facts(files.select(*key, "text")), key, deep, **limits))


def _by_depth(a: Column, b: Column) -> Column:
    return (
        F.when(a["depth"] != b["depth"], a["depth"] - b["depth"]).otherwise(a["seq"] - b["seq"])
    )


def error_postings(chunks: DataFrame, key: Sequence[str] = ("path",), collapse_key: bool = False) -> DataFrame:
    """Inverted index in row form: one posting per message of a chunk."""
    rows = chunks.select(*key, "fn_seq", "chunk_id", F.posexplode("error_messages").alias("error_pos", "e"))
    message = F.col("e.message")
    error_key = collapse(F.lower(message)) if collapse_key else strip(F.lower(message))
    return rows.filter(message != "").select(
        *key,
        "fn_seq",
        "error_pos",
        error_key.alias("error_key"),
        "chunk_id",
        message.alias("original_message"),
        F.col("e.log_level").alias("log_level"),
        F.col("e.source_type").alias("source_type"),
    )


def index_totals(
    files: DataFrame, chunks: DataFrame, group: Sequence[str] = (), parsed: DataFrame | None = None
) -> DataFrame:
    """Files processed and failed, functions, messages and distinct keys of an index.

    ``parsed`` has the group's columns and ``parsed`` for each file, as a store of facts
    knows it; without it the files are parsed here.
    """
    marked = parsed if parsed is not None else with_facts(files).withColumn("parsed", F.col("facts.parsed"))
    ok = F.col("parsed")
    per_file = marked.groupBy(*group).agg(
        F.count_if(ok).alias("files_processed"), F.count_if(~ok).alias("files_failed")
    )
    sizes = chunks.groupBy(*group).agg(
        F.count(F.lit(1)).alias("functions_found"),
        F.coalesce(F.sum(F.size("error_messages")), F.lit(0)).alias("errors_found"),
        F.count_if(F.size("error_messages") > 0).alias("chunks_with_errors"),
    )
    if not group:
        per_file, sizes = per_file.withColumn("_all", F.lit(1)), sizes.withColumn("_all", F.lit(1))
    out = per_file.join(sizes, list(group) or ["_all"], "left").drop("_all")
    out = out.fillna(0, ["functions_found", "errors_found", "chunks_with_errors"])
    return out.withColumns({"total_chunks": F.col("functions_found"), "total_errors": F.col("errors_found")})


def unique_keys(postings: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    """Distinct error keys per group, by two partial aggregates."""
    keys = postings.groupBy(*group, "error_key").agg(F.count(F.lit(1)).alias("n"))
    return keys.groupBy(*group).agg(
        F.count(F.lit(1)).alias("unique_error_keys"), F.sum("n").alias("total_errors")
    )


def error_key_listing(postings: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    """Postings per key, most frequent first."""
    counts = postings.groupBy(*group, "error_key").agg(F.count(F.lit(1)).alias("count"))
    return counts.orderBy(*group, F.desc("count"), "error_key")
