"""Level maps of the three jobs and the error-like text test."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Level names and what each job makes of them.
INDEX_LEVELS = {
    "error": "E",
    "critical": "E",
    "exception": "E",
    "warning": "W",
    "info": "I",
    "debug": "I",
}
INVENTORY_LEVELS = ["debug", "info", "warning", "warn", "error", "exception", "critical", "fatal", "trace"]
AUDIT_LEVELS = ["debug", "info", "warning", "error", "critical", "exception"]
AUDIT_ALIASES = {"warn": "warning", "fatal": "critical"}
DEFAULT_REPORT_LEVELS = ["error", "exception", "critical"]
ERROR_TEXT = "(?i)error|fail|exception"


def _lookup(name: Column, table: dict[str, str]) -> Column:
    pairs = [F.lit(x) for pair in table.items() for x in pair]
    return F.try_element_at(F.create_map(*pairs), name)


def index_level(name: Column) -> Column:
    return _lookup(name, INDEX_LEVELS)


def inventory_level(name: Column) -> Column:
    low = F.lower(name)
    return F.when(low == "warning", "warn").when(low.isin(INVENTORY_LEVELS), low)


def audit_level(name: Column) -> Column:
    level = F.coalesce(_lookup(name, AUDIT_ALIASES), name)
    return F.when(level.isin(AUDIT_LEVELS), level)


def looks_like_error(text: Column) -> Column:
    return text.rlike(ERROR_TEXT)


def level_allowed(level: Column, allowed: list[str] | None = None) -> Column:
    return level.isNull() | F.lower(level).isin(allowed or DEFAULT_REPORT_LEVELS)
