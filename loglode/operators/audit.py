"""Logging audit of production Python code, as windows and aggregates over syntax facts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loglode.functions import paths as P
from loglode.functions.levels import audit_level
from loglode.functions.text import collapse, split_lines, strip
from loglode.operators.syntax import file_calls, with_facts

# Logger sources, wrappers, config calls, JSON marks, patterns, thresholds.
FRAMEWORK_NAMES = ["uvicorn", "uvicorn.error", "uvicorn.access", "gunicorn", "gunicorn.error", "gunicorn.access"]
FRAMEWORK_BASES = ["app.logger", "current_app.logger", "fastapi.logger"]
TRANSLATORS = ["call:_", "call:gettext", "call:ugettext"]
CONFIG_CALLS = {
    "logging.basicConfig": "basicConfig",
    "logging.config.dictConfig": "dictConfig",
    "logging.config.fileConfig": "fileConfig",
    "structlog.configure": "structlog.configure",
}
GUARDED, IMPORT_TIME = "guarded", "import-time"
JSON_MARKS = "(?i)JSONFormatter|pythonjsonlogger|jsonlogger|JSONRenderer|orjson"
JSON_LIBRARY = "JSONFormatter|(?i)pythonjsonlogger"
JSON_RENDERER = "(?i)json_?renderer"
JSON_PROCESSORS = r"structlog\.configure|(?i)processors"
ERROR_LEVELS = ["error", "exception", "critical"]
GUARD_LINES = 20
JSON_LINES = 10
FALLBACK_LOGGER = r"\b([A-Za-z_][A-Za-z0-9_\.]*?)\.(debug|info|warning|warn|error|critical|fatal|exception)\s*\("
FALLBACK_PRINT = r"\bprint\s*\("
FALLBACK_PRINT_WORD = r"\bprint\s+(>>\s*\w+\s*,\s*)?[\"']"
FALLBACK_TEMPLATE = r"^[fF]?[\"']([^\"']*)[\"']"
MANY_PRINTS = 10
GENERIC_SHARE = 0.1
DYNAMIC_SHARE = 0.3
TOP_FILES, TOP_VARIABLES, TOP_TEMPLATES, TOP_FINDINGS = 10, 10, 20, 20
VARIABLE_FILES, TEMPLATE_FILES, SAMPLES = 5, 3, 20


def coverage(files: DataFrame, self_files: list[str] | None = None) -> DataFrame:
    """Python files with the reason they are left out, null for those to scan."""
    python = files.filter(F.endswith("path", F.lit(".py")))
    return python.withColumn("skip_reason", P.production_skip_reason(F.col("path"), self_files))


def coverage_counts(covered: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    """Files scanned (by parse or by patterns) and skipped per reason, for each group."""
    src = with_facts(covered.filter("skip_reason is null")).select(
        *group, F.when(F.col("facts.parsed"), "scanned_ast").otherwise("scanned_regex").alias("outcome")
    )
    skipped = covered.filter("skip_reason is not null").select(*group, F.col("skip_reason").alias("outcome"))
    return src.unionByName(skipped).groupBy(*group, "outcome").agg(F.count(F.lit(1)).alias("n_files"))


def skipped_samples(covered: DataFrame, samples: int | None = SAMPLES, group: Sequence[str] = ()) -> DataFrame:
    """The first files left out per group and reason."""
    ranked = covered.filter("skip_reason is not null").select(*group, "skip_reason", "path")
    return _first(ranked, [*group, "skip_reason"], ["path"], samples, "sample_no")


def _first(rows: DataFrame, group: Sequence[str], order: Sequence, limit: int | None, name: str) -> DataFrame:
    """Rows numbered per group; a limit is cut before the shuffle, None keeps all."""
    numbered = rows.withColumn(name, F.row_number().over(Window.partitionBy(*group).orderBy(*order)))
    return numbered if limit is None else numbered.filter(F.col(name) <= limit)


def line_counts(files: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    """Total and non-blank lines per group, summed from per-file counts."""
    lines = split_lines(F.col("text"))
    filled = F.size(F.filter(lines, lambda x: strip(x) != ""))
    return files.select(*group, F.size(lines).alias("n"), filled.alias("f")).groupBy(*group).agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_lines"), F.coalesce(F.sum("f"), F.lit(0)).alias("non_empty_lines")
    )


def production_facts(files: DataFrame, key: Sequence[str] = ("path",)) -> DataFrame:
    """Files to audit (`coverage` leaves out the rest) with their facts; store it when several reports follow."""
    return with_facts(coverage(files.select(*key, "text")).filter("skip_reason is null").drop("skip_reason"))


def logger_bindings(facts: DataFrame, key: Sequence[str] = ("path",)) -> DataFrame:
    """Which names hold a logger of which kind, and from which point of the visit on.

    A called name is looked up among the imports seen before it by a running
    "last value" per (file, name).
    """
    key = list(key)
    assigns = facts.select(*key, F.explode("facts.assigns").alias("a")).select(*key, "a.*")
    imports = facts.select(*key, F.explode("facts.imports").alias("i")).select(*key, "i.*").filter("bound is not null")
    origin = F.struct("module", F.coalesce("name", "module").alias("name"))
    named = imports.select(*key, F.col("bound").alias("symbol"), "seq", origin.alias("origin"), F.lit(None).alias("a"))
    call = F.struct("targets", "base", "name", "first_text")
    calls = assigns.select(*key, F.coalesce("base", "name").alias("symbol"), "seq", F.lit(None).alias("origin"), call.alias("a"))
    named = named.withColumn("a", F.col("a").cast(calls.schema["a"].dataType))
    calls = calls.withColumn("origin", F.col("origin").cast(named.schema["origin"].dataType))
    before = Window.partitionBy(*key, "symbol").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    known = named.unionByName(calls).withColumn("origin", F.last("origin", ignorenulls=True).over(before))
    base, name = F.col("a.base"), F.col("a.name")
    module, original = F.col("origin.module"), F.col("origin.name")
    imported = base.isNull() & module.isNotNull()
    source = (
        F.when((base == "logging") & (name == "getLogger"), "logging")
        .when((base == "structlog") & (name == "get_logger"), "structlog")
        .when(imported & (module == "logging") & (original == "getLogger"), "imported_logging")
        .when(imported & (module == "structlog") & (original == "get_logger"), "structlog")
        .when(imported & (F.contains(F.lower(module), F.lit("log")) | F.contains(F.lower(original), F.lit("log"))), "helper")
    )
    kind = (
        F.when((F.col("source") == "logging") & F.col("a.first_text").isin(FRAMEWORK_NAMES), "framework")
        .when(F.col("source") == "structlog", "structlog")
        .otherwise("stdlib")
    )
    return (
        known.filter("a is not null")
        .withColumn("source", source)
        .filter("source is not null")
        .select(*key, "seq", "source", kind.alias("logger_kind"), F.col("a.targets").alias("targets"))
    )


def audited_calls(facts: DataFrame, bindings: DataFrame, key: Sequence[str] = ("path",)) -> DataFrame:
    """Every call the audit counts: what it is, its logging system, level and variable.

    The logger kind of a variable is a running value per (file, name); calls written
    inside the arguments of a resolved call are left out by a running maximum of
    where such calls end.
    """
    key = list(key)
    rows = facts.select(*key, F.explode(file_calls(F.col("facts"))).alias("c")).select(*key, "c.*")
    base = F.col("base")
    level = F.when(F.col("method"), audit_level(F.col("name")))
    pieces = F.split(base, r"\.")
    symbol = F.when(F.size(pieces) == 1, base).otherwise(F.concat_ws(".", F.get(pieces, 0), F.element_at(pieces, -1)))
    calls = rows.select(
        *key,
        F.coalesce(symbol, F.lit("")).alias("symbol"),
        "seq",
        F.struct("seq_end", "line_no", "name", "method", "base", "args", "msg", "exc_info", level.alias("level")).alias("c"),
        F.lit(None).cast("string").alias("logger_kind"),
    )
    binds = bindings.select(*key, F.explode("targets").alias("symbol"), "seq", "logger_kind")
    binds = binds.withColumn("c", F.lit(None).cast(calls.schema["c"].dataType))
    before = Window.partitionBy(*key, "symbol").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    seen = lambda kind: F.coalesce(F.max(F.col("logger_kind") == kind).over(before), F.lit(False))
    joined = calls.unionByName(binds).withColumns(
        {
            "structlog": seen("structlog"),
            "stdlib": seen("stdlib"),
            "framework": seen("framework"),
            "latest": F.last("logger_kind", ignorenulls=True).over(before),
        }
    )
    dotted = F.contains(base, F.lit("."))
    system = (
        F.when(base == "logging", "stdlib")
        .when(base.isin(FRAMEWORK_BASES), "framework")
        .when(dotted, F.coalesce("latest", F.lit("generic")))
        .when(base.isNotNull() & F.col("structlog"), "structlog")
        .when(base.isNotNull() & F.col("stdlib"), "stdlib")
        .when(base.isNotNull() & F.col("framework"), "framework")
        .otherwise("generic")
    )
    flat = joined.filter("c is not null").select(*key, "seq", "c.*", "structlog", "stdlib", "framework", "latest")
    is_print = ~F.col("method") & (F.col("name") == "print")
    is_trace = (base == "traceback") & F.col("name").isin("print_exc", "format_exc")
    flat = flat.withColumns(
        {
            "system": F.when(F.col("level").isNotNull(), system),
            "what": F.when(is_print, "print").when(is_trace, "traceback").when(F.col("level").isNotNull(), "log").otherwise("other"),
        }
    )
    closed = F.col("what").isin("print", "traceback") | (F.col("system") != "generic")
    above = Window.partitionBy(*key).orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    reach = F.max(F.when(closed, F.col("seq_end"))).over(above)
    variable = F.when(F.col("system") == "generic", base)
    return (
        flat.withColumn("_reach", reach)
        .filter(F.coalesce(F.col("seq") > F.col("_reach"), F.lit(True)))
        .select(*key, "seq", "line_no", "what", "system", "level", variable.alias("variable"), "name", "base", "args", "msg", "exc_info")
    )


def template_columns(first: Column) -> tuple[Column, Column]:
    """Message template of an error call and whether it is static, dynamic or unknown."""
    form, text, parts = first["form"], first["text"], first["parts"]
    wrapped = form.isin(TRANSLATORS) & first["inner"].isNotNull()
    placeholder = F.transform(parts, lambda p: F.coalesce(p, F.lit("{}")))
    literal = ~F.exists(parts, lambda p: p.isNull())
    template = (
        F.when(form.isNull() | (form == "other"), "<unknown>")
        .when(form.isin("str", "format"), text)
        .when(form == "percent", text)
        .when(wrapped & first["inner"].isin("str", "percent"), text)
        .when(form == "name", F.concat(F.lit("<var:"), text, F.lit(">")))
        .when(form == "attribute", F.concat(F.lit("<attr:"), text, F.lit(">")))
        .when((form == "concat") & literal, F.array_join(parts, ""))
        .when(form == "concat", F.array_join(placeholder, "{}"))
    )
    kind = (
        F.when(form.isNull() | (form == "other"), "unknown")
        .when(form.isin("str", "format"), "static")
        .when((form == "percent") & text.isNotNull(), "static")
        .when(wrapped & (first["inner"] == "str"), "static")
        .when((form == "concat") & literal, "static")
        .otherwise("dynamic")
    )
    return collapse(F.coalesce(template, F.lit("<dynamic>"))), kind


def error_templates(calls: DataFrame, key: Sequence[str] = ("path",)) -> DataFrame:
    """Template, kind and level of every error, exception and critical call."""
    first = F.coalesce("msg", F.get("args", 0))
    rows = calls.filter((F.col("what") == "log") & F.col("level").isin(ERROR_LEVELS)).withColumn("first", first)
    template, kind = template_columns(F.col("first"))
    return rows.select(*key, "line_no", "seq", "level", template.alias("template"), kind.alias("kind"))


def log_configs(facts: DataFrame, key: Sequence[str] = ("path",)) -> DataFrame:
    """Logging configuration calls: guarded or run at import, and whether the file logs JSON.

    JSON marks count near any configuration call, as a formatter library anywhere, or
    as a structlog renderer in a file that imports structlog.
    """
    text = F.col("text")
    lines = split_lines(text)
    structlog = F.exists("facts.imports", lambda i: i["module"] == "structlog")
    in_file = text.rlike(JSON_LIBRARY) | (structlog & text.rlike(JSON_RENDERER) & text.rlike(JSON_PROCESSORS))
    calls = F.filter(file_calls(F.col("facts")), lambda c: F.concat_ws(".", c["base"], c["name"]).isin(list(CONFIG_CALLS)))
    src = facts.select(*key, calls.alias("calls"), lines.alias("lines"), in_file.alias("json_in_file")).filter(
        F.size("calls") > 0
    )

    def place(c: Column) -> Column:
        n = c["line_no"]
        own = F.coalesce(F.get("lines", n - 1), F.lit(""))
        earliest = F.greatest(n - GUARD_LINES, F.lit(1))
        before = F.slice(F.col("lines"), earliest, n - earliest)
        near = F.slice(F.col("lines"), F.greatest(n - JSON_LINES, F.lit(1)), F.least(n, F.lit(JSON_LINES + 1)) + JSON_LINES)
        main = F.exists(before, lambda x: F.contains(x, F.lit("if __name__")) & F.contains(x, F.lit("__main__")))
        return F.struct(
            n.alias("line_no"),
            c["seq"].alias("seq"),
            F.concat_ws(".", c["base"], c["name"]).alias("call"),
            (own.rlike(r"^[ \t]+\S") | main).alias("is_guarded"),
            F.exists(near, lambda x: x.rlike(JSON_MARKS)).alias("json_near"),
        )

    src = src.withColumn("places", F.transform("calls", place))
    json = F.col("json_in_file") | F.exists("places", lambda p: p["json_near"])
    rows = src.withColumn("has_json_formatting", json).select(*key, "has_json_formatting", F.explode("places").alias("r"))
    rows = rows.select(*key, "has_json_formatting", "r.*")
    names = F.create_map(*[F.lit(x) for pair in CONFIG_CALLS.items() for x in pair])
    return rows.select(
        *key,
        "line_no",
        F.try_element_at(names, F.col("call")).alias("config_type"),
        "is_guarded",
        F.when(F.col("is_guarded"), GUARDED).otherwise(IMPORT_TIME).alias("entry_point_likelihood"),
        "has_json_formatting",
    )


def fallback_calls(facts: DataFrame, key: Sequence[str] = ("path",)) -> DataFrame:
    """Logger and print calls by pattern in files that do not parse."""
    lines = facts.filter("not facts.parsed").select(*key, F.posexplode(split_lines(F.col("text"))).alias("pos", "line"))
    line = F.col("line")
    levels = F.regexp_extract_all(line, F.lit(FALLBACK_LOGGER), F.lit(2))
    prints = F.size(F.regexp_extract_all(line, F.lit(FALLBACK_PRINT), F.lit(0)))
    n_prints = F.when(prints > 0, prints).when(line.rlike(FALLBACK_PRINT_WORD), 1).otherwise(0)
    what = F.concat(
        F.transform(levels, lambda x: F.struct(F.lit("log").alias("what"), audit_level(x).alias("level"))),
        F.array_repeat(F.struct(F.lit("print").alias("what"), F.lit(None).cast("string").alias("level")), n_prints),
    )
    return lines.select(*key, (F.col("pos") + 1).alias("line_no"), F.posexplode(what).alias("seq", "w")).select(
        *key, "line_no", "seq", "w.what", F.when(F.col("w.what") == "log", "generic").alias("system"), "w.level"
    )


def fallback_templates(facts: DataFrame, key: Sequence[str] = ("path",)) -> DataFrame:
    """Templates of error calls by pattern: the literal that opens the next parenthesis on the line.

    Nested parentheses are followed for one level, which is as far as a literal can start.
    """
    lines = facts.filter("not facts.parsed").select(*key, F.posexplode(split_lines(F.col("text"))).alias("pos", "line"))
    whole = FALLBACK_LOGGER + r"(?:(?=[^()]*\(([^()]*(?:\([^()]*\)[^()]*)*)\))|)"
    pieces = F.arrays_zip(
        F.regexp_extract_all("line", F.lit(whole), F.lit(2)).alias("name"),
        F.regexp_extract_all("line", F.lit(whole), F.lit(3)).alias("inside"),
    )
    rows = lines.select(*key, (F.col("pos") + 1).alias("line_no"), F.explode(pieces).alias("p")).select(
        *key, "line_no", audit_level(F.col("p.name")).alias("level"), strip(F.col("p.inside")).alias("inside")
    )
    text = F.regexp_replace(F.regexp_extract("inside", FALLBACK_TEMPLATE, 1), r"\{[^}]*\}", "<expr>")
    template = F.when(F.col("inside").rlike(FALLBACK_TEMPLATE), text).otherwise("<unknown>")
    kept = rows.filter(F.col("level").isin(ERROR_LEVELS) & (F.col("inside") != ""))
    return kept.select(*key, "line_no", "level", template.alias("template"), F.lit("dynamic").alias("kind")).filter("template <> ''")


def counted_calls(calls: DataFrame, fallback: DataFrame | None = None, key: Sequence[str] = ("path",)) -> DataFrame:
    """Parsed and pattern-found calls in one shape."""
    columns = [*key, "line_no", "seq", "what", "system", "level"]
    rows = calls.select(*columns)
    return rows if fallback is None else rows.unionByName(fallback.select(*columns))


def system_levels(rows: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    """Calls by logging system and level, with totals, per group."""
    logs = rows.filter("what = 'log'")
    own = [F.col(c) for c in group]
    sets = [own, [*own, F.col("system")], [*own, F.col("system"), F.col("level")]]
    return logs.groupingSets(sets, *own, "system", "level").agg(F.count(F.lit(1)).alias("n_calls"))


def level_distribution(rows: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    return rows.filter("what = 'log'").groupBy(*group, "level").agg(F.count(F.lit(1)).alias("n_calls"))


def file_counts(rows: DataFrame, key: Sequence[str] = ("path",)) -> DataFrame:
    """Log and print calls per file, error-like ones apart."""
    return rows.groupBy(*key).agg(
        F.count_if(F.col("what") == "log").alias("logging_calls"),
        F.count_if(F.col("what") == "print").alias("print_calls"),
        F.count_if((F.col("what") == "log") & F.col("level").isin(ERROR_LEVELS)).alias("error_calls"),
    )


def top_files(per_file: DataFrame, by: str, limit: int | None = TOP_FILES, group: Sequence[str] = ()) -> DataFrame:
    """Files with most calls of a kind, per group."""
    return _first(per_file.filter(F.col(by) > 0), group, [F.desc(by), "path"], limit, "file_no")


def files_with_both(per_file: DataFrame) -> DataFrame:
    """Files that print and log."""
    both = per_file.filter("print_calls > 0 and logging_calls > 0")
    return both.withColumn("both_calls", F.col("print_calls") + F.col("logging_calls"))


def static_templates(templates: DataFrame, key: Sequence[str] = ("path",), group: Sequence[str] = ()) -> DataFrame:
    """Static templates with their number of calls and of files, per group."""
    per_file = templates.filter("kind = 'static'").groupBy("template", *key).agg(F.count(F.lit(1)).alias("n"))
    return per_file.groupBy(*group, "template").agg(F.sum("n").alias("count"), F.count(F.lit(1)).alias("n_files"))


def example_files(
    rows: DataFrame, of: str, key: Sequence[str] = ("path",), limit: int | None = TEMPLATE_FILES, group: Sequence[str] = ()
) -> DataFrame:
    """First files per group and value of a column."""
    return _first(rows.select(of, *key).distinct(), [*group, of], key, limit, "example_no")


def template_kinds(templates: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    kinds = ("static", "dynamic", "unknown")
    return templates.groupBy(*group).agg(*[F.count_if(F.col("kind") == k).alias(f"{k}_templates") for k in kinds])


def unknown_variables(calls: DataFrame, key: Sequence[str] = ("path",), group: Sequence[str] = ()) -> DataFrame:
    """Calls and files per logger variable of unknown origin, for each group."""
    per_file = calls.filter("variable is not null").groupBy("variable", *key).agg(F.count(F.lit(1)).alias("n"))
    return per_file.groupBy(*group, "variable").agg(F.sum("n").alias("n_calls"), F.count(F.lit(1)).alias("n_files"))


def usage_totals(facts: DataFrame, bindings: DataFrame, calls: DataFrame, rows: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    """Imports, logger lookups, prints, tracebacks, exc_info and bare excepts as (metric, value) rows per group."""
    counted = facts.select(*group, F.explode("facts.imports").alias("i")).filter("i.counted").groupBy(
        *group, F.concat(F.col("i.module"), F.lit("_imports")).alias("metric")
    ).agg(F.count(F.lit(1)).alias("value"))
    imports = counted.filter(F.col("metric").isin("logging_imports", "structlog_imports", "loguru_imports"))
    lookups = bindings.filter("source <> 'helper'").groupBy(
        *group, F.when(F.col("source") == "structlog", "structlog_get_logger").otherwise("stdlib_get_logger").alias("metric")
    ).agg(F.count(F.lit(1)).alias("value"))
    script = P.is_script(F.col("path"))
    what = F.col("what")
    printed = rows.filter(what == "print").select(
        *group, F.explode(F.array(F.lit("print_calls"), F.when(script, "print_calls_in_scripts").otherwise("print_calls_outside_scripts"))).alias("metric")
    )
    other = calls.select(
        *group, F.explode(
            F.array(
                F.when(what == "traceback", "traceback_calls"),
                F.when((what == "log") & (F.col("level") == "exception"), "exception_calls"),
                F.when((what == "log") & F.col("exc_info"), "exc_info_calls"),
            )
        ).alias("metric")
    )
    excepts = facts.select(*group, F.explode("facts.bare_excepts").alias("line_no")).select(*group, F.lit("bare_except_blocks").alias("metric"))
    events = printed.unionByName(other).unionByName(excepts).filter("metric is not null")
    return imports.unionByName(lookups).unionByName(events.groupBy(*group, "metric").agg(F.count(F.lit(1)).alias("value")))


def bare_excepts(facts: DataFrame, key: Sequence[str] = ("path",), limit: int | None = TOP_FINDINGS, group: Sequence[str] = ()) -> DataFrame:
    """The first bare excepts per group."""
    rows = facts.select(*key, F.explode("facts.bare_excepts").alias("line_no"))
    return _first(rows, group, [*key, "line_no"], limit, "except_no")


def many_print_files(per_file: DataFrame, limit: int | None = TOP_FINDINGS, group: Sequence[str] = ()) -> DataFrame:
    """Files with very many prints outside scripts and tests, most first, per group."""
    low = F.lower("path")
    outside = ~F.contains(low, F.lit("scripts")) & ~F.contains(low, F.lit("tests"))
    found = per_file.filter((F.col("print_calls") >= MANY_PRINTS) & outside)
    return _first(found, group, [F.desc("print_calls"), "path"], limit, "file_no")


def findings(
    rows: DataFrame,
    per_file: DataFrame,
    templates: DataFrame,
    configs: DataFrame,
    bindings: DataFrame,
    group: Sequence[str] = (),
) -> DataFrame:
    """All findings of a group in one row; each input is reduced to a row per group by partial aggregates first."""
    keys = list(group) or ["_one"]
    rows, per_file, templates, configs, bindings = (
        d if group else d.withColumn("_one", F.lit(1)) for d in (rows, per_file, templates, configs, bindings)
    )
    is_log, system = F.col("what") == "log", F.col("system")
    error_like = is_log & F.col("level").isin(ERROR_LEVELS)
    totals = rows.groupBy(*keys).agg(
        F.count_if(is_log).alias("level_sum"),
        F.count_if(is_log & (system != "framework")).alias("total_calls"),
        F.count_if(is_log & (system == "generic")).alias("generic_calls"),
        F.count_if(is_log & (system == "structlog")).alias("structlog_calls"),
        F.count_if(error_like).alias("error_calls"),
    )
    low = F.lower("path")
    printing = (F.col("print_calls") >= MANY_PRINTS) & ~F.contains(low, F.lit("scripts")) & ~F.contains(low, F.lit("tests"))
    files = per_file.groupBy(*keys).agg(
        F.count_if(printing).alias("high_print_files"),
        F.count_if((F.col("print_calls") > 0) & (F.col("logging_calls") > 0)).alias("files_with_both"),
    )
    kinds = template_kinds(templates, keys)
    config = configs.groupBy(*keys).agg(
        F.count_if(F.col("config_type") == "basicConfig").alias("basic_config_count"),
        F.count_if(F.col("config_type") == "structlog.configure").alias("structlog_configs"),
        F.count_if("has_json_formatting").alias("json_configs"),
    )
    lookups = bindings.groupBy(*keys).agg(F.count_if(F.col("source") == "structlog").alias("structlog_lookups"))
    row = configs.select(*keys).union(bindings.select(*keys)).union(rows.select(*keys)).distinct()
    for part in (totals, files, kinds, config, lookups):
        row = row.join(part, keys, "left")
    row = row.fillna(0)
    share = lambda a, b: F.coalesce(F.try_divide(F.col(a), F.col(b)), F.lit(0.0))
    generic, dynamic = share("generic_calls", "total_calls"), share("dynamic_templates", "error_calls")
    return row.select(
        *group,
        "level_sum",
        "total_calls",
        (F.col("level_sum") == F.col("total_calls")).alias("levels_match"),
        "error_calls",
        "basic_config_count",
        (F.col("basic_config_count") > 1).alias("multiple_basic_config"),
        "high_print_files",
        "files_with_both",
        (F.col("json_configs") > 0).alias("json_logging_enabled"),
        ((F.col("structlog_lookups") > 0) & (F.col("structlog_calls") == 0) & (F.col("structlog_configs") > 0)).alias(
            "structlog_configured_but_unused"
        ),
        (generic > GENERIC_SHARE).alias("high_unknown_logger_usage"),
        F.round(generic * 100, 4).alias("unknown_logger_percentage"),
        (dynamic > DYNAMIC_SHARE).alias("high_dynamic_error_templates"),
        F.round(dynamic * 100, 4).alias("dynamic_error_percentage"),
        F.round(share("unknown_templates", "error_calls") * 100, 4).alias("unknown_error_percentage"),
    )
