"""Log triage: relevant line, fields, search keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loglode.functions.text import collapse, settle, split_lines, strip, words

# Fixed values of the log format.
ERROR_MARK = "<E>"
TIMESTAMP_WORD = r"^(?U)\d{4}-\d{2}-\d{2}T(?-U)[^\s]+"
LEVEL_SPLIT = r"(?s)^(.*?)<[^>]>(.*)\z"
LEVEL = r"<([^>])>"
THREAD_SPLIT = r"(?s)^(.*?)\[[^\]]+\](.*)\z"
THREAD = r"\[([^\]]+)\]"
KEY_TIMESTAMP = r"^\d{4}-\d{2}-\d{2}T\S+\s+"
KEY_LEVEL = r"<[^>]>"
KEY_THREAD = r"\[[^\]]+\]"
KEY_HOST = r"^[A-Za-z0-9_.-]{4,}\s+[A-Za-z0-9_.-]+:\s+"
KEY_FLOAT = r"\b\d+\.\d+\b"
KEY_INTEGER = r"\b\d{4,}\b"
KEY_NUMBER = "<NUM>"
KEY_TOKEN_BREAK = "[^a-z0-9]+"
KEY_TOKEN_MIN = 3
PARSED_COLUMNS = [
    "timestamp", "host_or_serial", "process", "level", "thread", "component", "message",
    "key_exact", "key_normalized", "tokens", "search_message",
]


def relevant_line(block: Column) -> Column:
    """First stripped line with an error mark, else the first one, else empty."""
    lines = F.filter(F.transform(split_lines(block), strip), lambda x: x != "")
    marked = F.filter(lines, lambda x: F.contains(x, F.lit(ERROR_MARK)))
    return F.coalesce(F.get(marked, 0), F.get(lines, 0), F.lit(""))


def relevant_rows(lines: DataFrame, block: list[str], pos: str, text: str) -> DataFrame:
    """The same choice where a block is stored as rows."""
    clean = lines.withColumn("_line", strip(F.col(text))).filter(F.col("_line") != "")
    rank = F.struct(~F.contains("_line", F.lit(ERROR_MARK)), F.col(pos))
    return clean.groupBy(*block).agg(F.min_by("_line", rank).alias("selected_line"))


def _blank_to_null(c: Column) -> Column:
    return F.when(c != "", c)


def _without_first(c: Column, split: str) -> Column:
    """One space instead of the first marker; unchanged where there is none."""
    return F.trim(F.regexp_replace(c, split, "$1 $2"))


def parsed_fields(df: DataFrame, line: str) -> DataFrame:
    """Add the seven fields of a log line.

    Built in steps, each on the columns of the one before, so that no expression is
    repeated in the plan; all of it is one generated stage.
    """
    tok, c = F.col("_tok"), F.col
    colon = F.lit(":")
    out = df.withColumn("_tok", words(c(line)))
    out = out.withColumns(
        {
            "_dated": F.coalesce(F.get(tok, 0).rlike(TIMESTAMP_WORD), F.lit(False)),
            "_second_ends": F.coalesce(F.endswith(F.get(tok, 1), colon), F.lit(False)),
            "_third_ends": F.coalesce(F.endswith(F.get(tok, 2), colon), F.lit(False)),
        }
    )
    dated, bare = c("_dated"), ~c("_dated") & c("_second_ends")
    used = F.when(dated & c("_third_ends"), 3).when(dated | bare, 2).otherwise(0)
    drop_colon = lambda x: F.substring(x, F.lit(1), F.length(x) - 1)
    out = out.withColumns(
        {
            "timestamp": F.when(dated, F.get(tok, 0)),
            "host_or_serial": F.when(dated, F.get(tok, 1)).when(bare, F.get(tok, 0)),
            "process": F.when(dated & c("_third_ends"), drop_colon(F.get(tok, 2))).when(bare, drop_colon(F.get(tok, 1))),
            "_rest": F.array_join(F.slice(tok, used + 1, F.size(tok)), " "),
        }
    )
    out = out.withColumns(
        {"level": _blank_to_null(F.regexp_extract("_rest", LEVEL, 1)), "_rest": _without_first(c("_rest"), LEVEL_SPLIT)}
    )
    out = out.withColumns(
        {
            "thread": _blank_to_null(strip(F.regexp_extract("_rest", THREAD, 1))),
            "_rest": collapse(_without_first(c("_rest"), THREAD_SPLIT)),
        }
    )
    out = out.withColumn("_at", F.instr("_rest", ":"))
    out = out.withColumns(
        {
            "component": F.when(c("_at") > 0, _blank_to_null(F.trim(F.substring(c("_rest"), F.lit(1), c("_at") - 1)))),
            "_right": F.when(c("_at") > 0, _blank_to_null(F.trim(F.substring(c("_rest"), c("_at") + 1, F.length("_rest"))))),
        }
    )
    message = F.coalesce("_right", _blank_to_null(c("_rest")), strip(c(line)), F.lit(""))
    return out.withColumn("message", message).drop(
        "_tok", "_dated", "_second_ends", "_third_ends", "_rest", "_at", "_right"
    )


def event_time(timestamp: Column) -> Column:
    """Typed twin of the timestamp text."""
    return F.try_to_timestamp(timestamp)


def key_exact(component: Column, message: Column) -> Column:
    both = (component != "") & (message != "")
    return F.when(both, F.concat_ws(": ", component, message)).otherwise(F.coalesce(message, F.lit("")))


def key_normalized(exact: Column, normalize_numbers: bool = False) -> Column:
    c = F.regexp_replace(exact, KEY_TIMESTAMP, "")
    c = F.regexp_replace(c, KEY_LEVEL, " ")
    c = F.regexp_replace(c, KEY_THREAD, " ")
    c = F.regexp_replace(c, KEY_HOST, "")
    if normalize_numbers:
        c = F.regexp_replace(F.regexp_replace(c, KEY_FLOAT, KEY_NUMBER), KEY_INTEGER, KEY_NUMBER)
    c = F.lower(collapse(c))
    return F.when(c != "", c).otherwise(F.lower(strip(exact)))


def key_tokens(normalized: Column) -> Column:
    return F.filter(F.split(normalized, KEY_TOKEN_BREAK), lambda t: F.length(t) >= KEY_TOKEN_MIN)


def search_message(message: Column, exact: Column) -> Column:
    return F.coalesce(_blank_to_null(strip(message)), strip(exact))


def normalize_query(message: Column) -> Column:
    return F.coalesce(collapse(F.lower(message)), F.lit(""))


def with_parsed(df: DataFrame, line: str, normalize_numbers: bool = False) -> DataFrame:
    """Add the parsed fields, the search keys and the search message of a line column."""
    return settle(build_columns(parsed_fields(df, line), normalize_numbers), *PARSED_COLUMNS)


def build_columns(parsed: DataFrame, normalize_numbers: bool = False) -> DataFrame:
    """Add the keys, tokens and search message of ``component`` and ``message``."""
    keyed = parsed.withColumn("key_exact", key_exact(F.col("component"), F.col("message")))
    keyed = keyed.withColumn("key_normalized", key_normalized(F.col("key_exact"), normalize_numbers))
    return keyed.withColumns(
        {
            "tokens": key_tokens(F.col("key_normalized")),
            "search_message": search_message(F.col("message"), F.col("key_exact")),
        }
    )


def analyze_blocks(blocks: DataFrame, text: str = "text", normalize_numbers: bool = False) -> DataFrame:
    """End-to-end analysis of pasted blocks: choose the line, parse it, build its keys."""
    chosen = settle(blocks.withColumn("selected_line", relevant_line(F.col(text))), "selected_line")
    return with_parsed(chosen, "selected_line", normalize_numbers)
