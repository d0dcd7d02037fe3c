"""Inventory of logging calls and their message literals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loglode.functions import paths as P
from loglode.functions.levels import inventory_level, level_allowed
from loglode.functions.text import shorten, split_lines, strip
from loglode.operators.slices import line_slices
from loglode.operators.syntax import file_calls, with_facts

# Patterns of log calls and literals outside Python, cut lengths, limits.
JS_CONSOLE = r"(?i)\bconsole\.(log|info|warn|error|debug|trace)\s*\("
GENERIC_LOGGER = r"(?i)\b(logger|log)\.(trace|debug|info|warn|warning|error|fatal|critical)\s*\("
C_PRINTF = r"\b(printf|fprintf|syslog)\s*\("
C_LOG_MACRO = r"\b(LOG|LOG_[A-Z]+|SPDLOG_[A-Z]+|QLOG|DLOG|ELOG|WLOG|ILOG)\s*\("
QUOTED = r""""(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*'"""
TEMPLATE = r"`(?:[^`\\]|\\.)*`"
PERCENT_TOKEN = "%[sdifoxX]"
SNIPPET_MAX = 240
MESSAGE_FROM_SNIPPET = 100
SITES_PER_MESSAGE = 5
CALL_COLUMNS = [
    "line_no", "seq", "language", "kind", "level", "callee", "snippet", "string_literals", "is_dynamic", "dynamic_reasons",
]


def python_calls(files: DataFrame, key: Sequence[str] = ("path",), context_lines: int = 0) -> DataFrame:
    """Log-like calls of Python files that parse.

    With ``context_lines`` also ``context_preview``, so many lines on each side of a call, cut where the file's lines are.
    """
    src = with_facts(files.select(*key, "text")).withColumn("_lines", split_lines(F.col("text")))

    preview = lambda column: [column] if context_lines else []

    def place(c: Column) -> Column:
        line = F.regexp_replace(F.coalesce(F.get("_lines", c["line_no"] - 1), F.lit("")), r"^[\n\r]+|[\n\r]+\z", "")
        start = F.greatest(c["line_no"] - context_lines, F.lit(1))
        near = F.array_join(F.slice("_lines", start, c["line_no"] + context_lines - start + 1), "\n").alias("context_preview")
        return F.struct(c.alias("c"), shorten(line, SNIPPET_MAX, SNIPPET_MAX - 3).alias("snippet"), *preview(near))

    rows = src.select(*key, F.explode(F.transform(file_calls(F.col("facts")), place)).alias("x")).select(
        *key, "x.c.*", "x.snippet", *preview("x.context_preview")
    )
    last = F.element_at(F.split("callee", r"\."), -1)
    level = F.when(F.contains("callee", F.lit(".")), inventory_level(last))
    kind = (
        F.when(F.col("callee") == "print", "python_print")
        .when(level.isNotNull(), "python_logger")
        .when(F.endswith("callee", F.lit(".log")) & (F.size("args") >= 2), "python_logger_log")
    )
    literals = F.array_distinct(F.flatten(F.transform("args", lambda a: a["literals"])))
    reasons = F.array_distinct(F.flatten(F.transform("args", lambda a: a["reasons"])))
    mixed = F.exists("args", lambda a: a["form"] != "str") & (F.size(literals) > 0)
    return (
        rows.withColumns({"kind": kind, "level": level})
        .filter(F.col("kind").isNotNull())
        .select(
            *key,
            "line_no",
            "seq",
            F.lit("python").alias("language"),
            "kind",
            "level",
            "callee",
            "snippet",
            literals.alias("string_literals"),
            ((F.size(reasons) > 0) | mixed).alias("is_dynamic"),
            F.when(mixed, F.array_append(reasons, F.lit("python_non_literal_args"))).otherwise(reasons).alias(
                "dynamic_reasons"
            ),
            *preview("context_preview"),
        )
    )


def text_calls(files: DataFrame, key: Sequence[str] = ("path",)) -> DataFrame:
    """Log-like calls of other languages, one per line at most, all in the scan stage."""
    rows = files.select(*key, F.posexplode(split_lines(F.col("text"))).alias("pos", "line"))
    line = F.col("line")
    kind = (
        F.when(line.rlike(JS_CONSOLE), "js_console")
        .when(line.rlike(GENERIC_LOGGER), "generic_logger")
        .when(line.rlike(C_PRINTF), "c_printf_family")
        .when(line.rlike(C_LOG_MACRO), "c_log_macro")
    )
    part = lambda pattern, i: F.regexp_extract(line, pattern, i)
    k = F.col("kind")
    level = F.when(k == "js_console", F.lower(part(JS_CONSOLE, 1))).when(
        k == "generic_logger", F.lower(part(GENERIC_LOGGER, 2))
    )
    callee = (
        F.when(k == "js_console", F.concat(F.lit("console."), part(JS_CONSOLE, 1)))
        .when(k == "generic_logger", F.concat_ws(".", part(GENERIC_LOGGER, 1), part(GENERIC_LOGGER, 2)))
        .when(k == "c_printf_family", "printf/fprintf/syslog")
        .when(k == "c_log_macro", part(C_LOG_MACRO, 1))
    )
    inside = lambda x: F.substring(x, F.lit(2), F.length(x) - 2)
    found = F.concat(
        F.regexp_extract_all(line, F.lit(QUOTED), F.lit(0)), F.regexp_extract_all(line, F.lit(TEMPLATE), F.lit(0))
    )
    reasons = F.filter(
        F.array(
            F.when(line.rlike(TEMPLATE), "js_template_literal"),
            F.when(line.rlike(PERCENT_TOKEN), "percent_format_token"),
            F.when(F.contains(line, F.lit(".format(")), "dot_format_call"),
            F.when(F.contains(line, F.lit("+")) & line.rlike("[\"'`]"), "concat_operator"),
        ),
        lambda r: r.isNotNull(),
    )
    path = F.col(key[-1])
    return (
        rows.withColumn("kind", kind)
        .filter(k.isNotNull())
        .select(
            *key,
            (F.col("pos") + 1).alias("line_no"),
            F.lit(0).alias("seq"),
            P.language(path).alias("language"),
            "kind",
            level.alias("level"),
            callee.alias("callee"),
            strip(line).alias("snippet"),
            F.array_distinct(F.transform(found, inside)).alias("string_literals"),
            (F.size(reasons) > 0).alias("is_dynamic"),
            reasons.alias("dynamic_reasons"),
        )
    )


def log_calls(files: DataFrame, key: Sequence[str] = ("path",)) -> DataFrame:
    """All log calls of a mixed corpus."""
    python = P.extension(F.col(key[-1])) == ".py"
    return python_calls(files.filter(python), key).unionByName(text_calls(files.filter(~python), key))


def literal_sites(calls: DataFrame, key: Sequence[str] = ("path",)) -> DataFrame:
    """One row per literal of a call."""
    return calls.select(
        F.explode("string_literals").alias("literal"), *key, "line_no", "seq", "callee", "level", "kind"
    )


def literal_catalog(calls: DataFrame, key: Sequence[str] = ("path",)) -> DataFrame:
    """Distinct literals with counts, by partial aggregation; their sites are ``literal_sites`` rows."""
    sites = literal_sites(calls, key)
    return sites.groupBy("literal").agg(
        F.count(F.lit(1)).alias("count"), F.min(F.struct(*key, "line_no", "seq")).alias("first_site")
    )


def calls_overview(calls: DataFrame) -> DataFrame:
    """Calls by kind, by level (null left out), dynamic ones and in total, as (what, name, count) rows."""
    rows = calls.select(
        F.explode(
            F.array(
                F.struct(F.lit("kind").alias("what"), F.col("kind").alias("name")),
                F.struct(F.lit("level").alias("what"), F.col("level").alias("name")),
                F.struct(F.lit("dynamic").alias("what"), F.when(F.col("is_dynamic"), "dynamic").alias("name")),
                F.struct(F.lit("total").alias("what"), F.lit("calls").alias("name")),
            )
        ).alias("r")
    ).select("r.*")
    counts = rows.filter("name is not null").groupBy("what", "name").agg(F.count(F.lit(1)).alias("count"))
    distinct = calls.select(F.explode("string_literals").alias("l")).distinct().agg(F.count(F.lit(1)).alias("count"))
    return counts.unionByName(distinct.select(F.lit("distinct").alias("what"), F.lit("literals").alias("name"), "count"))


def with_message(calls: DataFrame, allowed: list[str] | None = None) -> DataFrame:
    """Calls of the wanted levels with their message key: first literal, else the snippet's start."""
    start = strip(F.substring("snippet", 1, MESSAGE_FROM_SNIPPET))
    key = F.coalesce(F.get("string_literals", 0), F.when(start != "", start))
    return calls.filter(level_allowed(F.col("level"), allowed)).withColumn("message", key).filter(
        F.coalesce(F.col("message"), F.lit("")) != ""
    )


def message_summary(calls: DataFrame, key: Sequence[str] = ("path",), allowed: list[str] | None = None) -> DataFrame:
    """De-duplicated messages: count, files, kind and level of the first call.

    Counting per (message, file) first keeps a message that is everywhere from
    gathering in one task; the second step sees one row per file and task.
    """
    rows = with_message(calls, allowed)
    seen = F.struct(*key, "line_no", "seq", "is_dynamic", F.coalesce(F.lower("level"), F.lit("unknown")).alias("level"))
    per_file = rows.groupBy("message", *key).agg(F.count(F.lit(1)).alias("n"), F.min(seen).alias("first"))
    return (
        per_file.groupBy("message")
        .agg(F.sum("n").alias("count"), F.count(F.lit(1)).alias("unique_files"), F.min("first").alias("first"))
        .select(
            "message",
            F.when(F.col("first.is_dynamic"), "template").otherwise("literal").alias("kind"),
            F.col("first.level").alias("level"),
            "count",
            "unique_files",
        )
    )


def message_sites(
    calls: DataFrame,
    key: Sequence[str] = ("path",),
    allowed: list[str] | None = None,
    per_message: int = SITES_PER_MESSAGE,
) -> DataFrame:
    """First sites of each message; Spark cuts to the limit before the shuffle."""
    order = Window.partitionBy("message").orderBy(*key, "line_no", "seq")
    ranked = with_message(calls, allowed).withColumn("site_no", F.row_number().over(order))
    return ranked.filter(F.col("site_no") <= per_message).select(
        "message", "site_no", *key, "line_no", F.coalesce("callee", "kind").alias("logger_call")
    )


def level_totals(calls: DataFrame, allowed: list[str] | None = None) -> DataFrame:
    level = F.coalesce(F.lower("level"), F.lit("unknown")).alias("level")
    return with_message(calls, allowed).groupBy(level).agg(F.count(F.lit(1)).alias("count"))


def call_records(
    calls: DataFrame,
    key: Sequence[str] = ("path",),
    allowed: list[str] | None = None,
    files: DataFrame | None = None,
    context_lines: int = 0,
) -> DataFrame:
    """One record per call for export, with lines around it when asked for.

    Calls that bring their ``context_preview`` keep it; for others ``context_lines`` cuts it from ``files`` by a join.
    """
    out = calls.filter(level_allowed(F.col("level"), allowed)).withColumn("message", F.get("string_literals", 0))
    columns = [*key, "line_no", "language", "kind", "level", "callee", "snippet", "message", "is_dynamic"]
    if "context_preview" in calls.columns:
        return out.select(*columns, "context_preview")
    if not context_lines or files is None:
        return out.select(*columns)
    near = out.withColumns(
        {
            "from_line": F.greatest(F.col("line_no") - context_lines, F.lit(1)),
            "to_line": F.col("line_no") + context_lines,
        }
    )
    texts = line_slices(files, near, key, lines=split_lines(F.col("text")))
    joined = near.join(texts, [*key, "from_line", "to_line"], "left")
    return joined.select(*columns, F.col("slice_text").alias("context_preview"))
