"""Check queries: call inventory, audit, manifests, discovery, registry."""

from __future__ import annotations

from pyspark.sql import functions as F

from loglode.functions import paths as P
from loglode.operators import audit as A
from loglode.operators import discover as V
from loglode.operators import inventory as I
from loglode.operators import manifest as M
from loglode.operators import registry as R
from loglode.operators.measure import scan_report, write_measured
from loglode.queries.base import query
from loglode.queries.inputs import (
    CODE_SQL,
    FILE_KEY,
    INDEX_KEY,
    MANIFEST_SQL,
    REGISTRY_SQL,
    TREE_SQL,
    changed_listing,
    code_files,
    machines,
    manifest_listing,
    registry_events,
    script_files,
    table,
    tree_listing,
)
from loglode.session import cut_lineage, scratch_path
from loglode.sources import documents as D

# --- inventory -----------------------------------------------------------------------------

CALL_SQL = (
    CODE_SQL
    + """
, calls AS (
  SELECT machine_id, version_id, path, base + c.d AS line_no, c.kind AS kind, c.level AS level, c.callee AS callee,
    c.snippet AS snippet, c.lit AS literal, c.reasons AS reasons
  FROM (SELECT *, unnest([
    {'d': 5, 'kind': 'python_logger', 'level': 'error', 'callee': 'logger.error',
     'snippet': '    logger.error("' || p_name || ' failed for %s" % x)', 'lit': p_name || ' failed for %s',
     'reasons': 'python_percent_formatting,python_non_literal_args'},
    {'d': 8, 'kind': 'python_print', 'level': NULL, 'callee': 'print', 'snippet': '    print("error in ' || p_brand || '")',
     'lit': 'error in ' || p_brand, 'reasons': ''},
    {'d': 9, 'kind': 'python_logger', 'level': CASE note_name WHEN 'warning' THEN 'warn' ELSE note_name END,
     'callee': note_var || '.' || note_name, 'snippet': '    ' || note_var || '.' || note_name || '("' || p_type || ' note")',
     'lit': p_type || ' note', 'reasons': ''}]) AS c FROM fns WHERE NOT legacy))
"""
)


@query(
    "SELECT machine_id, version_id, path, line_no, kind, level, callee, snippet, literal AS literals, reasons <> '' AS is_dynamic, reasons FROM calls",
    CALL_SQL,
)
def log_calls(spark, sf_dir):
    calls = I.python_calls(code_files(spark, sf_dir), FILE_KEY)
    return calls.select(
        *FILE_KEY, "line_no", "kind", "level", "callee", "snippet", F.array_join("string_literals", "|").alias("literals"),
        "is_dynamic", F.array_join("dynamic_reasons", ",").alias("reasons"),
    )


@query(
    """
WITH js AS (
  SELECT p_brand AS machine_id, 'v' || p_partkey // 400 AS version_id,
    'web/m' || p_partkey // 400 || CASE WHEN p_size % 4 < 2 THEN '.js' ELSE '.c' END AS path,
    row_number() OVER (PARTITION BY p_brand, p_partkey // 400, p_size % 4 < 2 ORDER BY p_partkey) AS line_no, p_size % 4 AS m, p_name, p_type
  FROM part)
SELECT machine_id, version_id, path, line_no, CASE WHEN m < 2 THEN 'javascript' ELSE 'c' END AS language,
  list_extract(['js_console', 'generic_logger', 'c_printf_family', 'c_log_macro'], m + 1) AS kind,
  list_extract(['warn', 'info', NULL, NULL], m + 1) AS level,
  list_extract(['console.warn', 'logger.info', 'printf/fprintf/syslog', 'LOG_ERR'], m + 1) AS callee,
  list_extract(['console.warn("' || p_name || ' " + x);', 'logger.info(`made ${' || p_type || '}`);', 'printf("' || p_name || ' %d", x);',
    'LOG_ERR(''' || p_type || ''', "' || p_name || '");'], m + 1) AS snippet,
  list_extract([p_name || ' ', 'made ${' || p_type || '}', p_name || ' %d', p_type || '|' || p_name], m + 1) AS literals,
  list_extract(['concat_operator', 'js_template_literal', 'percent_format_token', ''], m + 1) AS reasons
FROM js""",
)
def text_log_calls(spark, sf_dir):
    calls = I.text_calls(script_files(spark, sf_dir), FILE_KEY)
    return calls.select(
        *FILE_KEY, "line_no", "language", "kind", "level", "callee", "snippet",
        F.array_join("string_literals", "|").alias("literals"), F.array_join("dynamic_reasons", ",").alias("reasons"),
    )


@query(
    """
SELECT 'kind' AS what, kind AS name, count(*) AS count FROM calls GROUP BY kind
UNION ALL SELECT 'level', level, count(*) FROM calls WHERE level IS NOT NULL GROUP BY level
UNION ALL SELECT 'dynamic', 'dynamic', count(*) FROM calls WHERE reasons <> '' HAVING count(*) > 0
UNION ALL SELECT 'total', 'calls', count(*) FROM calls
UNION ALL SELECT 'distinct', 'literals', count(DISTINCT literal) FROM calls""",
    CALL_SQL,
)
def calls_by_kind_level(spark, sf_dir):
    return I.calls_overview(I.python_calls(code_files(spark, sf_dir), FILE_KEY))


@query(
    """
SELECT literal, count(*) AS count, first(machine_id || '|' || version_id || '|' || path || '|' || printf('%06d', line_no)
  ORDER BY machine_id, version_id, path, line_no) AS first_site
FROM calls GROUP BY literal""",
    CALL_SQL,
)
def literal_catalog(spark, sf_dir):
    site = F.format_string("%s|%s|%s|%06d", "first_site.machine_id", "first_site.version_id", "first_site.path", "first_site.line_no")
    rows = I.literal_catalog(I.python_calls(code_files(spark, sf_dir), FILE_KEY), FILE_KEY)
    return rows.select("literal", "count", site.alias("first_site"))


@query("SELECT literal, machine_id, version_id, path, line_no, callee, level, kind FROM calls", CALL_SQL)
def literal_sites(spark, sf_dir):
    return I.literal_sites(I.python_calls(code_files(spark, sf_dir), FILE_KEY), FILE_KEY).drop("seq")


@query(
    """
SELECT literal AS message, first(CASE WHEN reasons <> '' THEN 'template' ELSE 'literal' END ORDER BY machine_id, version_id, path, line_no) AS kind,
  first(coalesce(level, 'unknown') ORDER BY machine_id, version_id, path, line_no) AS level,
  count(*) AS count, count(DISTINCT (machine_id, version_id, path)) AS unique_files
FROM calls WHERE level IS NULL OR level IN ('error', 'exception', 'critical') GROUP BY literal""",
    CALL_SQL,
)
def call_summary(spark, sf_dir):
    return I.message_summary(I.python_calls(code_files(spark, sf_dir), FILE_KEY), FILE_KEY)


@query(
    """
SELECT literal AS message, machine_id, version_id, path, line_no, callee AS logger_call,
  row_number() OVER (PARTITION BY literal ORDER BY machine_id, version_id, path, line_no) AS site_no
FROM calls WHERE level IS NULL OR level IN ('error', 'exception', 'critical') QUALIFY site_no <= 5""",
    CALL_SQL,
)
def call_sites(spark, sf_dir):
    return I.message_sites(I.python_calls(code_files(spark, sf_dir), FILE_KEY), FILE_KEY)


@query(
    "SELECT coalesce(level, 'unknown') AS level, count(*) AS count FROM calls WHERE level IS NULL OR level IN ('error', 'exception', 'critical') GROUP BY ALL",
    CALL_SQL,
)
def call_level_totals(spark, sf_dir):
    return I.level_totals(I.python_calls(code_files(spark, sf_dir), FILE_KEY))


@query(
    """
SELECT machine_id, version_id, path, line_no, kind, level, literal AS message,
  CASE kind WHEN 'python_print' THEN '        raise ValueError("' || p_type || ' size ' || p_size || '")'
    ELSE '    ""\"Docs for ' || p_name || '.""\"' END || chr(10) || snippet || chr(10)
  || CASE kind WHEN 'python_print' THEN '    ' || note_var || '.' || note_name || '("' || p_type || ' note")'
    ELSE '    if x > ' || p_size || ':' END AS context_preview
FROM calls JOIN fns USING (machine_id, version_id, path)
WHERE (level IS NULL OR level = 'error') AND line_no IN (base + 5, base + 8)""",
    CALL_SQL,
)
def call_records(spark, sf_dir):
    """Export records with one line around each call."""
    records = I.call_records(I.python_calls(code_files(spark, sf_dir), FILE_KEY, context_lines=1), FILE_KEY)
    return records.select(*FILE_KEY, "line_no", "kind", "level", "message", "context_preview")


# --- audit -----------------------------------------------------------------------------------

AUDIT_SQL = (
    CODE_SQL
    + """
, prod AS (SELECT * FROM fns WHERE path NOT LIKE 'tests/%' AND path NOT LIKE 'build/%'),
events_ AS (
  SELECT machine_id, version_id, path, legacy, base + e.d AS line_no, e.what AS what,
    CASE WHEN e.what = 'log' THEN CASE WHEN legacy THEN 'generic' ELSE e.sys END END AS system, e.lv AS level, p_name, note_var
  FROM (SELECT *, unnest([
    {'d': 5, 'what': 'log', 'sys': 'stdlib', 'lv': 'error'},
    {'d': 8, 'what': 'print', 'sys': NULL, 'lv': NULL},
    {'d': 9, 'what': 'log', 'sys': CASE note_var WHEN 'logger' THEN 'stdlib' WHEN 'log' THEN 'generic' ELSE 'framework' END,
     'lv': CASE note_name WHEN 'warn' THEN 'warning' WHEN 'fatal' THEN 'critical' ELSE note_name END}]) AS e FROM prod)
  UNION ALL
  SELECT DISTINCT machine_id, version_id, path, legacy, 999999, 'print', NULL, NULL, NULL, NULL FROM prod WHERE legacy),
templates AS (
  SELECT machine_id, version_id, path, legacy, base + 5 AS line_no, 'error' AS level, p_name || ' failed for %s' AS template, 'static' AS kind
  FROM prod WHERE NOT legacy
  UNION ALL
  SELECT machine_id, version_id, path, legacy, base + 9, 'critical', p_type || ' note', 'static' FROM prod WHERE NOT legacy AND note_name = 'fatal')
"""
)


def _facts(spark, sf_dir):
    return A.production_facts(code_files(spark, sf_dir), FILE_KEY)


def _audit(spark, sf_dir):
    facts = cut_lineage(_facts(spark, sf_dir))
    bindings = A.logger_bindings(facts, FILE_KEY)
    calls = A.audited_calls(facts, bindings, FILE_KEY)
    rows = A.counted_calls(calls, A.fallback_calls(facts, FILE_KEY), FILE_KEY)
    return facts, bindings, calls, rows


@query(
    """
SELECT machine_id, version_id, system, level, count(*) AS n_calls FROM events_ WHERE what = 'log'
GROUP BY GROUPING SETS ((machine_id, version_id), (machine_id, version_id, system), (machine_id, version_id, system, level))""",
    AUDIT_SQL,
)
def audit_levels(spark, sf_dir):
    return A.system_levels(_audit(spark, sf_dir)[3], INDEX_KEY)


@query("SELECT machine_id, version_id, level, count(*) AS n_calls FROM events_ WHERE what = 'log' GROUP BY ALL", AUDIT_SQL)
def audit_level_distribution(spark, sf_dir):
    return A.level_distribution(_audit(spark, sf_dir)[3], INDEX_KEY)


@query("SELECT machine_id, version_id, path, line_no, level, template, kind FROM templates", AUDIT_SQL)
def audit_templates(spark, sf_dir):
    calls = _audit(spark, sf_dir)[2]
    return A.error_templates(calls, FILE_KEY).drop("seq")


@query(
    "SELECT machine_id, version_id, template, count(*) AS count, count(DISTINCT path) AS n_files FROM templates GROUP BY ALL",
    AUDIT_SQL,
)
def audit_static_templates(spark, sf_dir):
    return A.static_templates(A.error_templates(_audit(spark, sf_dir)[2], FILE_KEY), FILE_KEY, INDEX_KEY)


@query(
    """
SELECT template, machine_id, version_id, path, row_number() OVER (PARTITION BY machine_id, version_id, template ORDER BY path) AS example_no
FROM (SELECT DISTINCT template, machine_id, version_id, path FROM templates) QUALIFY example_no <= 3""",
    AUDIT_SQL,
)
def audit_template_files(spark, sf_dir):
    return A.example_files(A.error_templates(_audit(spark, sf_dir)[2], FILE_KEY), "template", FILE_KEY, group=INDEX_KEY)


@query(
    """
SELECT machine_id, version_id, path, count(*) FILTER (what = 'log') AS logging_calls, count(*) FILTER (what = 'print') AS print_calls,
  count(*) FILTER (what = 'log' AND level IN ('error', 'exception', 'critical')) AS error_calls
FROM events_ GROUP BY ALL""",
    AUDIT_SQL,
)
def audit_file_counts(spark, sf_dir):
    return A.file_counts(_audit(spark, sf_dir)[3], FILE_KEY)


@query(
    """
SELECT machine_id, version_id, note_var AS variable, count(*) AS n_calls, count(DISTINCT path) AS n_files
FROM prod WHERE note_var = 'log' AND NOT legacy GROUP BY ALL""",
    AUDIT_SQL,
)
def audit_unknown_variables(spark, sf_dir):
    return A.unknown_variables(_audit(spark, sf_dir)[2], FILE_KEY, INDEX_KEY)


@query(
    """
SELECT machine_id, version_id, 'logging_imports' AS metric, count(DISTINCT path) AS value FROM prod WHERE NOT legacy GROUP BY ALL
UNION ALL SELECT machine_id, version_id, 'stdlib_get_logger', count(DISTINCT path) FROM prod WHERE NOT legacy GROUP BY ALL
UNION ALL SELECT machine_id, version_id, 'print_calls', count(*) FROM events_ WHERE what = 'print' GROUP BY ALL
UNION ALL SELECT machine_id, version_id, CASE WHEN path LIKE '%/scripts/%' THEN 'print_calls_in_scripts' ELSE 'print_calls_outside_scripts' END, count(*)
  FROM events_ WHERE what = 'print' GROUP BY ALL""",
    AUDIT_SQL,
)
def audit_usage(spark, sf_dir):
    return A.usage_totals(*_audit(spark, sf_dir), INDEX_KEY)


@query(
    """
, per AS (SELECT machine_id, version_id, path, count(*) FILTER (what = 'log') AS l, count(*) FILTER (what = 'print') AS p FROM events_ GROUP BY ALL),
t AS (SELECT machine_id, version_id, count(*) FILTER (what = 'log') AS level_sum, count(*) FILTER (what = 'log' AND system <> 'framework') AS total_calls,
  count(*) FILTER (what = 'log' AND system = 'generic') AS g, count(*) FILTER (what = 'log' AND level IN ('error', 'exception', 'critical')) AS error_calls
  FROM events_ GROUP BY ALL),
pf AS (SELECT machine_id, version_id, count(*) FILTER (p >= 10 AND path NOT LIKE '%scripts%' AND path NOT LIKE '%tests%') AS high_print_files,
  count(*) FILTER (p > 0 AND l > 0) AS files_with_both FROM per GROUP BY ALL),
b AS (SELECT machine_id, version_id, count(DISTINCT path) FILTER (NOT legacy AND file_no % 2 = 0) AS n FROM prod GROUP BY ALL)
SELECT machine_id, version_id, level_sum, total_calls, level_sum = total_calls AS levels_match, error_calls, n AS basic_config_count, n > 1 AS multiple_basic_config,
  high_print_files, files_with_both,
  false AS json_logging_enabled, false AS structlog_configured_but_unused, g / total_calls > 0.1 AS high_unknown_logger_usage,
  round(g / total_calls * 100, 4) AS unknown_logger_percentage, false AS high_dynamic_error_templates,
  0.0::DOUBLE AS dynamic_error_percentage, 0.0::DOUBLE AS unknown_error_percentage
FROM t JOIN pf USING (machine_id, version_id) JOIN b USING (machine_id, version_id)""",
    AUDIT_SQL,
)
def audit_findings(spark, sf_dir):
    facts, bindings, calls, rows = _audit(spark, sf_dir)
    per_file = A.file_counts(rows, FILE_KEY)
    return A.findings(rows, per_file, A.error_templates(calls, FILE_KEY), A.log_configs(facts, FILE_KEY), bindings, INDEX_KEY)


@query(
    """
SELECT DISTINCT machine_id, version_id, path, 3 AS line_no, 'basicConfig' AS config_type, false AS is_guarded,
  'import-time' AS entry_point_likelihood, false AS has_json_formatting FROM prod WHERE NOT legacy AND file_no % 2 = 0""",
    AUDIT_SQL,
)
def audit_config_sites(spark, sf_dir):
    return A.log_configs(_facts(spark, sf_dir), FILE_KEY)


@query(
    """
SELECT machine_id, version_id, CASE WHEN path LIKE 'tests/%' THEN 'test_file' WHEN path LIKE 'build/%' THEN 'ignored_path' WHEN legacy THEN 'scanned_regex' ELSE 'scanned_ast' END AS outcome,
  count(DISTINCT path) AS n_files FROM fns GROUP BY ALL""",
    CODE_SQL,
)
def scan_coverage(spark, sf_dir):
    return A.coverage_counts(A.coverage(code_files(spark, sf_dir)), INDEX_KEY)


@query(
    """
SELECT machine_id, version_id, CASE WHEN path LIKE 'tests/%' THEN 'test_file' ELSE 'ignored_path' END AS skip_reason, path,
  row_number() OVER (PARTITION BY machine_id, version_id, skip_reason ORDER BY path) AS sample_no
FROM (SELECT DISTINCT machine_id, version_id, path FROM fns WHERE path LIKE 'tests/%' OR path LIKE 'build/%')""",
    CODE_SQL,
)
def coverage_samples(spark, sf_dir):
    return A.skipped_samples(A.coverage(code_files(spark, sf_dir)), group=INDEX_KEY)


@query(
    """
SELECT machine_id, version_id, path, count(*) FILTER (what = 'print') AS print_calls,
  row_number() OVER (PARTITION BY machine_id, version_id ORDER BY count(*) FILTER (what = 'print') DESC, path) AS file_no
FROM events_ GROUP BY machine_id, version_id, path HAVING count(*) FILTER (what = 'print') > 0 QUALIFY file_no <= 10""",
    AUDIT_SQL,
)
def audit_top_files(spark, sf_dir):
    per_file = A.file_counts(_audit(spark, sf_dir)[3], FILE_KEY)
    return A.top_files(per_file, "print_calls", group=INDEX_KEY).select(*FILE_KEY, "print_calls", "file_no")


@query(
    """
SELECT machine_id, version_id, sum(n)::BIGINT AS total_lines, sum(f)::BIGINT AS non_empty_lines FROM (
  SELECT machine_id, version_id, 3 + 11 * count(*) + max(legacy::INT) AS n, 2 + max((file_no % 2 = 0)::INT) + 10 * count(*) + max(legacy::INT) AS f
  FROM prod GROUP BY machine_id, version_id) GROUP BY ALL""",
    AUDIT_SQL,
)
def lines_of_code(spark, sf_dir):
    return A.line_counts(A.coverage(code_files(spark, sf_dir)).filter("skip_reason is null"), INDEX_KEY)


# --- manifests -------------------------------------------------------------------------------


@query("SELECT * FROM ma", MANIFEST_SQL)
def manifest(spark, sf_dir):
    return M.manifest_entries(manifest_listing(spark, sf_dir))


@query(
    """
SELECT machine, count(*) FILTER (type = 'file') AS file_count, count(*) FILTER (type = 'symlink') AS symlink_count,
  count(*) FILTER (type = 'dir') AS dir_count, coalesce(sum(size), 0)::BIGINT AS total_bytes, count(error) AS error_count, count(*) AS total_entries
FROM ma GROUP BY machine""",
    MANIFEST_SQL,
)
def manifest_stats(spark, sf_dir):
    return M.manifest_stats(M.manifest_entries(manifest_listing(spark, sf_dir)))


@query(
    """
SELECT machine, count(*) AS n_entries, sha256(string_agg(concat_ws('|', 'error:' || error, 'link_target:' || link_target, 'path:' || path,
  'sha256:' || sha256, 'size:' || size, 'type:' || type), chr(10) ORDER BY path)) AS fingerprint
FROM ma GROUP BY machine""",
    MANIFEST_SQL,
)
def fingerprint(spark, sf_dir):
    return M.tree_fingerprint(M.manifest_entries(manifest_listing(spark, sf_dir)))


@query(
    """
, leaves AS (
  SELECT machine, left(sha256(path), 4) AS bucket, count(*) AS n_entries, sha256(string_agg(line, chr(10) ORDER BY line)) AS digest
  FROM (SELECT *, concat_ws('|', 'error:' || error, 'link_target:' || link_target, 'path:' || path, 'sha256:' || sha256, 'size:' || size, 'type:' || type) AS line FROM ma)
  GROUP BY ALL),
mids AS (
  SELECT machine, left(bucket, 2) AS bucket, sum(n_entries)::BIGINT AS n_entries, sha256(string_agg(bucket || ' ' || digest, chr(10) ORDER BY bucket)) AS digest
  FROM leaves GROUP BY machine, left(bucket, 2))
SELECT machine, '' AS bucket, sum(n_entries)::BIGINT AS n_entries, sha256(string_agg(bucket || ' ' || digest, chr(10) ORDER BY bucket)) AS digest
FROM mids GROUP BY machine
UNION ALL FROM mids UNION ALL FROM leaves""",
    MANIFEST_SQL,
)
def tree_digests(spark, sf_dir):
    """The digest tree of every machine: all its nodes."""
    return M.tree_digests(M.manifest_entries(manifest_listing(spark, sf_dir)))


COMPARE_SQL = (
    MANIFEST_SQL
    + """
, cmp AS (
  SELECT coalesce(a.path, b.path) AS path, a.path IS NULL AS no_a, b.path IS NULL AS no_b, concat_ws('; ',
    CASE WHEN a.type <> b.type THEN 'type: ' || a.type || ' vs ' || b.type END,
    CASE WHEN a.type = 'file' AND b.type = 'file' AND a.size <> b.size THEN 'size: ' || a.size || ' vs ' || b.size END,
    CASE WHEN a.type = 'file' AND b.type = 'file' AND a.sha256 IS DISTINCT FROM b.sha256
      THEN 'sha256: ' || coalesce(a.sha256, 'missing') || ' vs ' || coalesce(b.sha256, 'missing') END,
    CASE WHEN a.type = 'symlink' AND b.type = 'symlink' AND a.link_target <> b.link_target
      THEN 'link_target: ' || a.link_target || ' vs ' || b.link_target END,
    CASE WHEN a.error IS NOT NULL AND b.error IS NULL THEN 'error in A: ' || a.error WHEN a.error IS NULL AND b.error IS NOT NULL THEN 'error in B: ' || b.error
      WHEN a.error <> b.error THEN 'error: ' || a.error || ' vs ' || b.error END) AS d
  FROM ma a FULL OUTER JOIN mb b ON a.path = b.path),
compared AS (
  SELECT path, CASE WHEN no_b THEN 'only_in_a' WHEN no_a THEN 'only_in_b' WHEN d <> '' THEN 'different' ELSE 'identical' END AS status,
    CASE WHEN no_a OR no_b THEN '' ELSE d END AS differences FROM cmp)
"""
)


def _compared(spark, sf_dir):
    a = manifest_listing(spark, sf_dir)
    return M.compare_manifests(M.manifest_entries(a), M.manifest_entries(changed_listing(a)))


@query("SELECT path, status, differences FROM compared", COMPARE_SQL)
def manifest_compare(spark, sf_dir):
    """Only the buckets whose digests differ are joined."""
    a = manifest_listing(spark, sf_dir)
    compared = M.compare_by_buckets(M.manifest_entries(a), M.manifest_entries(changed_listing(a)))
    return compared.select("path", "status", F.array_join("differences", "; ").alias("differences"))


@query("SELECT path, status, differences FROM compared WHERE status <> 'identical'", COMPARE_SQL)
def stored_tree_compare(spark, sf_dir):
    """Both sides stored with their digests; only the folders and buckets that differ are read."""
    listing, paths = manifest_listing(spark, sf_dir), [scratch_path(spark, "tree") for _ in range(2)]
    for side, path in zip((listing, changed_listing(listing)), paths, strict=True):
        M.write_tree(M.manifest_entries(side), path)
    compared = M.compare_trees(spark, *paths).filter("status <> 'identical'")
    return compared.select("path", "status", F.array_join("differences", "; ").alias("differences"))


@query(
    """
SELECT count(*) FILTER (status = 'only_in_a') AS only_in_a, count(*) FILTER (status = 'only_in_b') AS only_in_b,
  count(*) FILTER (status = 'different') AS different, count(*) FILTER (status = 'identical') AS identical, count(*) AS total_paths,
  count(*) = count(*) FILTER (status = 'identical') AS is_identical FROM compared""",
    COMPARE_SQL,
)
def compare_summary(spark, sf_dir):
    return M.compare_summary(_compared(spark, sf_dir))


@query(
    """
SELECT split_part(path, '/', 1) AS machine, path, status,
  row_number() OVER (PARTITION BY split_part(path, '/', 1) ORDER BY list_position(['only_in_a', 'only_in_b', 'different'], status), path) AS mismatch_no
FROM compared WHERE status <> 'identical' QUALIFY mismatch_no <= 50""",
    COMPARE_SQL,
)
def top_mismatches(spark, sf_dir):
    """The first mismatches of every machine."""
    a, key = manifest_listing(spark, sf_dir), ("machine", "path")
    compared = M.compare_manifests(M.manifest_entries(a), M.manifest_entries(changed_listing(a)), key)
    return M.top_mismatches(compared, group=("machine",)).select(*key, "status", "mismatch_no")


@query("SELECT path FROM ma WHERE path NOT IN (SELECT path FROM mb)", MANIFEST_SQL)
def path_difference(spark, sf_dir):
    a = manifest_listing(spark, sf_dir)
    return M.path_difference(M.manifest_entries(a), M.manifest_entries(changed_listing(a)))


@query(
    """
SELECT machine AS source, path, coalesce(u.type, m.type) AS type, m.size, m.sha256, m.link_target, m.error
FROM ma m LEFT JOIN (SELECT path AS p, 'moved' AS type FROM listing WHERE page_id % 3 = 0) u ON u.p = m.path""",
    MANIFEST_SQL,
)
def manifest_lines(spark, sf_dir):
    """Manifest lines written as JSON and read back, with comments, broken lines and repeated paths in between."""
    listing = manifest_listing(spark, sf_dir)
    fields = ["error", "link_target", "path", "sha256", "size", "type"]
    entries = M.manifest_entries(listing, ("machine", "page_id"))
    good = entries.select(F.col("machine").alias("source"), (F.col("page_id") * 10).alias("n"), F.to_json(F.struct(*fields)).alias("value"), "page_id")
    line = lambda plus, value: F.struct((F.col("n") + plus).alias("n"), value.cast("string").alias("value"))
    moved = F.when(F.col("page_id") % 3 == 0, F.regexp_replace("value", '"type":"[a-z]+"', '"type":"moved"'))
    noise = F.array(
        line(0, F.col("value")), line(1, F.lit("# a comment")), line(2, F.lit("{broken")), line(3, F.lit("")), line(4, moved)
    )
    lines = good.select("source", F.explode(noise).alias("x")).select("source", "x.n", "x.value").filter("value is not null")
    return D.parse_manifest(lines)


# --- discovery ---------------------------------------------------------------------------------

DIR_SQL = (
    TREE_SQL
    + """
, dirs AS (
  SELECT dir AS path, count(*) FILTER (page_id % 6 = 3) > 0 AS git,
    count(DISTINCT CASE page_id % 6 WHEN 0 THEN 'setup.py' WHEN 2 THEN 'Makefile' END) + (count(*) FILTER (page_id % 6 = 3) > 0)::INT AS n_markers,
    count(*) FILTER (page_id % 6 IN (0, 1, 4)) AS code_files_here, count(*) FILTER (page_id % 6 <> 3) AS total_files_here
  FROM tree GROUP BY dir)
"""
)


@query(
    """
SELECT path, git, n_markers, code_files_here, total_files_here,
  CASE WHEN git THEN 100 ELSE 0 END + 20 * n_markers + least(code_files_here, 50) AS score FROM dirs
WHERE git OR n_markers > 0 OR code_files_here > 0
QUALIFY row_number() OVER (PARTITION BY split_part(path, '/', 1) ORDER BY score DESC, path) <= 200""",
    DIR_SQL,
)
def code_roots(spark, sf_dir):
    trees = tree_listing(spark, sf_dir).withColumn("machine", F.element_at(F.split("path", "/"), 1))
    rows = V.top_code_roots(trees, key=("machine",))
    return rows.select("path", "git", F.size("markers").alias("n_markers"), "code_files_here", "total_files_here", "score")


SCAN_SQL = (
    TREE_SQL
    + """
, reasons AS (SELECT *, CASE WHEN path LIKE '%/.git/%' THEN 'excluded_dir' WHEN is_symlink THEN 'symlink'
    WHEN NOT regexp_matches(lower(path), '[.](py|c)$') THEN 'extension' WHEN length > 2000 THEN 'too_big' END AS r FROM tree)
"""
)


def _scanned(spark, sf_dir):
    listing = tree_listing(spark, sf_dir)
    reason = P.scan_skip_reason(F.col("path"), F.col("length"), F.col("is_symlink"), [".py", ".c"], P.SEARCH_EXCLUDED_DIRS, 2000)
    return listing.withColumn("skip_reason", reason)


@query(
    """
SELECT count(*) FILTER (r IS NULL) AS files_scanned, count(*) FILTER (r = 'excluded_dir') AS files_skipped_excluded_dir,
  count(*) FILTER (r = 'symlink') AS files_skipped_symlink, count(*) FILTER (r = 'too_big') AS files_skipped_too_big,
  count(*) FILTER (r = 'unreadable') AS files_skipped_unreadable, count(*) FILTER (r = 'extension') AS files_skipped_extension FROM reasons""",
    SCAN_SQL,
)
def scan_stats(spark, sf_dir):
    return V.scan_stats(_scanned(spark, sf_dir))


@query(
    """
SELECT count(*) AS files_found, count(*) FILTER (r IS NULL) AS files_scanned, count(r) AS files_skipped,
  coalesce(sum(length) FILTER (r IS NULL), 0)::BIGINT AS total_bytes FROM reasons""",
    SCAN_SQL,
)
def scan_throughput(spark, sf_dir):
    return V.scan_throughput(_scanned(spark, sf_dir))


@query(
    """
SELECT count(*) FILTER (r IS NULL) AS files_read, count(r) AS files_skipped, coalesce(sum(length) FILTER (r IS NULL), 0)::BIGINT AS bytes_read,
  true AS has_rates FROM reasons""",
    SCAN_SQL,
)
def scan_observed(spark, sf_dir):
    """Counts taken by the scan itself while its files are stored; the rates differ from run to run, so only their being is told."""
    path = scratch_path(spark, "scan")
    report = scan_report(_scanned(spark, sf_dir), lambda files: files.write.parquet(path))
    rates = (F.col("files_per_second") > 0) & (F.col("bytes_per_second") > 0)
    return report.select("files_read", "files_skipped", "bytes_read", rates.alias("has_rates"))


@query(
    """
SELECT count(*) AS n_rows, sum(strlen(text))::BIGINT AS raw_bytes, true AS has_ratio FROM documents""",
)
def stored_sizes(spark, sf_dir):
    """Documents stored by language: raw bytes as they passed, stored bytes from the listing of the files."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    sizes = write_measured(docs, scratch_path(spark, "documents"), F.octet_length("text"), ["lang"])
    fits = (F.col("n_files") > 0) & (F.col("ratio") > 0) & (F.col("ratio") < 2)
    return sizes.select("n_rows", "raw_bytes", fits.alias("has_ratio"))


@query(
    """
SELECT path, regexp_matches(path, '/(scripts|bin)/') AS is_script,
  regexp_matches(lower(path), '(^|/)test[^/]*[.]py$|_test[.]py$') OR path LIKE '%fixture%' AS is_test,
  CASE WHEN lower(path) LIKE '%.c' THEN 'c' ELSE 'unknown' END AS language, false AS is_massive_root
FROM tree""",
    TREE_SQL,
)
def path_predicates(spark, sf_dir):
    path = F.col("path")
    return tree_listing(spark, sf_dir).select(
        "path", P.is_script(path).alias("is_script"), P.is_test_file(path).alias("is_test"), P.language(path).alias("language"),
        P.is_massive_root(path).alias("is_massive_root"),
    )


# --- registry ------------------------------------------------------------------------------------

STAMP = "yyyy-MM-dd HH:mm:ss"


@query("SELECT machine_id, version_id FROM act", REGISTRY_SQL)
def active_version(spark, sf_dir):
    return R.active_versions(registry_events(spark, sf_dir))


@query(
    """
SELECT machine_id, version_id, strftime(created_at, '%Y-%m-%d %H:%M:%S') AS created_at, row_number() OVER w AS version_no,
  lag(version_id) OVER w AS previous_version_id,
  coalesce(version_id = (SELECT a.version_id FROM act a WHERE a.machine_id = lives.machine_id), false) AS is_active
FROM lives WHERE deleted_at IS NULL WINDOW w AS (PARTITION BY machine_id ORDER BY created_at, version_id)""",
    REGISTRY_SQL,
)
def version_history(spark, sf_dir):
    history = R.version_history(R.versions_table(registry_events(spark, sf_dir)))
    return history.select(
        "machine_id", "version_id", F.date_format("created_at", STAMP).alias("created_at"), "version_no", "previous_version_id", "is_active"
    )


@query(
    """
SELECT c_custkey AS id, c_mktsegment AS printing_type, act.version_id AS active_version_id
FROM customer LEFT JOIN act ON machine_id = c_custkey""",
    REGISTRY_SQL,
)
def machines_with_version(spark, sf_dir):
    rows = R.machines_with_active(machines(spark, sf_dir), R.active_versions(registry_events(spark, sf_dir)))
    return rows.select("id", "printing_type", "active_version_id")


@query(
    """
SELECT o_custkey AS id, first(o_orderpriority ORDER BY o_orderdate + to_seconds(o_orderkey % 86400) DESC) AS printer_model,
  first(o_orderstatus ORDER BY o_orderdate + to_seconds(o_orderkey % 86400) DESC) FILTER (o_orderstatus <> 'F') AS printing_type,
  strftime(max(o_orderdate + to_seconds(o_orderkey % 86400)), '%Y-%m-%d %H:%M:%S') AS updated_at
FROM orders GROUP BY o_custkey HAVING o_custkey % 9 <> 4""",
)
def registry_state(spark, sf_dir):
    """Machines folded from change events: the orders of a customer update its machine, some machines are deleted."""
    orders = table(spark, sf_dir, "orders")
    at = F.col("o_orderdate") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.col("o_orderkey") % 86400)
    updates = orders.select(
        F.col("o_custkey").alias("id"), F.lit("create").alias("op"), at.alias("ts"),
        F.col("o_orderpriority").alias("printer_model"), F.when(F.col("o_orderstatus") != "F", F.col("o_orderstatus")).alias("printing_type"),
    )
    gone = machines(spark, sf_dir).filter(F.col("id") % 9 == 4).select(
        "id", F.lit("delete").alias("op"), F.lit("2030-01-01").cast("timestamp").alias("ts"),
        F.lit(None).cast("string").alias("printer_model"), F.lit(None).cast("string").alias("printing_type"),
    )
    state = R.fold_machines(updates.unionByName(gone), ["printer_model", "printing_type"])
    return state.select("id", "printer_model", "printing_type", F.date_format("updated_at", STAMP).alias("updated_at"))


@query(
    """
SELECT c_mktsegment || '-' || c_nationkey || '-' || c_custkey % 40 AS display_name, count(*) AS n_machines, min(c_custkey) AS kept_id
FROM customer GROUP BY 1 HAVING count(*) > 1""",
)
def duplicate_names(spark, sf_dir):
    return R.duplicate_names(machines(spark, sf_dir))


@query(
    """
SELECT c_custkey AS id, CASE WHEN n IS NULL THEN 'unknown' WHEN act.version_id IS NOT NULL THEN 'healthy' ELSE 'building' END AS status, n AS n_versions
FROM customer LEFT JOIN (SELECT machine_id, count(*) AS n FROM lives WHERE deleted_at IS NULL GROUP BY ALL) v ON v.machine_id = c_custkey
LEFT JOIN act ON act.machine_id = c_custkey""",
    REGISTRY_SQL,
)
def index_status(spark, sf_dir):
    versions = R.versions_table(registry_events(spark, sf_dir))
    return R.index_status(machines(spark, sf_dir), versions).select("id", "status", "n_versions")
