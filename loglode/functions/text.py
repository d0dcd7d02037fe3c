"""Blank handling, line models and decoding as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Blanks as str.strip() and str.split() see them, and the line
# ends str.splitlines() knows.
BLANK = r"[\s\x1c-\x1f]"
LINE_END = "\\r\\n|[\\n\\r\\x0B\\f\\x1C-\\x1E\\u0085\\u2028\\u2029]"


def strip(c: Column) -> Column:
    """Trim Unicode blanks, tabs included (``trim`` would cut spaces only)."""
    return F.regexp_replace(c, rf"(?U)^{BLANK}+|{BLANK}+\z", "")


def lstrip(c: Column) -> Column:
    return F.regexp_replace(c, rf"(?U)^{BLANK}+", "")


def rstrip(c: Column) -> Column:
    return F.regexp_replace(c, rf"(?U){BLANK}+\z", "")


def collapse(c: Column) -> Column:
    """Runs of blanks become one space; ends are trimmed."""
    return F.trim(F.regexp_replace(c, rf"(?U){BLANK}+", " "))


def words(c: Column) -> Column:
    """Blank-separated words, without empty ones."""
    return F.filter(F.split(collapse(c), " "), lambda w: w != "")


def _without_last_empty(lines: Column) -> Column:
    return F.when(F.element_at(lines, -1) == "", F.slice(lines, 1, F.size(lines) - 1)).otherwise(lines)


def byte_lines(text: Column) -> Column:
    """Lines split at ``\\n`` only, carriage returns cut off at the end."""
    body = F.when(F.endswith(text, F.lit("\n")), F.substring(text, F.lit(1), F.length(text) - 1)).otherwise(text)
    parts = F.split(body, "\n")
    cut = F.when(
        F.contains(text, F.lit("\r")),
        F.transform(parts, lambda x: F.regexp_replace(x, r"[\r\n]+\z", "")),
    ).otherwise(parts)
    return F.when(text == "", F.array().cast("array<string>")).otherwise(cut)


def split_lines(text: Column) -> Column:
    """Lines split at every Unicode line end."""
    return _without_last_empty(F.split(text, LINE_END))


def explode_lines(files: DataFrame, text: str = "text", model: str = "byte") -> DataFrame:
    """One row per line: the other columns, ``line_no`` from 1 and ``line_text``."""
    arr = byte_lines(F.col(text)) if model == "byte" else split_lines(F.col(text))
    keep = [c for c in files.columns if c != text]
    return files.select(*keep, F.posexplode(arr).alias("_pos", "line_text")).select(
        *keep, (F.col("_pos") + 1).alias("line_no"), "line_text"
    )


def decode_lossy(content: Column) -> Column:
    """UTF-8 text of a binary column; bad bytes become U+FFFD."""
    return F.make_valid_utf8(content.cast("string"))


def shorten(c: Column, limit: int, keep: int | None = None) -> Column:
    """Cut to ``keep`` characters plus an ellipsis when longer than ``limit``."""
    keep = limit if keep is None else keep
    return F.when(F.length(c) > limit, F.concat(F.substring(c, 1, keep), F.lit("..."))).otherwise(c)


def indent_width(line: Column) -> Column:
    """Leading spaces count one, leading tabs four."""
    lead = F.regexp_extract(line, r"^([ \t]*)", 1)
    return F.length(lead) + 3 * F.length(F.regexp_replace(lead, " ", ""))


def settle(df: DataFrame, *names: str) -> DataFrame:
    """Let later filters on computed columns stay above their computation.

    The optimizer would move such a filter below every step and copy the whole chain
    of expressions into it; it does not look through a one-row generator.
    """
    rest = [c for c in df.columns if c not in names]
    one = F.explode(F.array(F.struct(*names))).alias("_settled")
    return df.select(*rest, one).select(*rest, "_settled.*")
