"""Check queries: log triage, roll-ups, message search, enrichment."""

from __future__ import annotations

from pyspark.sql import functions as F

from loglode.functions.display import cut_metadata, human_bytes, human_time, with_display
from loglode.functions.logparse import analyze_blocks, build_columns, normalize_query, relevant_line, relevant_rows, with_parsed
from loglode.functions.scoring import match_excerpt, significant_tokens
from loglode.functions.text import explode_lines, settle, shorten, split_lines
from loglode.operators import rollups
from loglode.operators.enclosure import enclose, enrich_matches
from loglode.operators.search import search_messages, tiered_search
from loglode.operators.slices import context_preview, files_with_hits
from loglode.plans.analyze import analyze
from loglode.plans.bounds import spread
from loglode.queries.base import query
from loglode.queries.inputs import (
    CODE_SQL,
    DOC_SQL,
    FILE_KEY,
    LOG_SQL,
    code_files,
    doc_files,
    log_lines,
    messages,
    table,
)
from loglode.session import cut_lineage

TIME = "yyyy-MM-dd HH:mm:ss.SSSSSS"


@query(
    """
SELECT event_id, stamp AS timestamp, 'RS' || user_id AS host_or_serial, 'proc' || user_id % 4 AS process,
  upper(event_type[1]) AS level, '#' || user_id % 8 AS thread, component, message, message AS search_message,
  component || ': ' || message AS key_exact
FROM logs""",
    LOG_SQL,
)
def parse_log_lines(spark, sf_dir):
    parsed = with_parsed(log_lines(spark, sf_dir).select("event_id", "line"), "line")
    return parsed.select(
        "event_id", "timestamp", "host_or_serial", "process", "level", "thread", "component", "message",
        "search_message", "key_exact",
    )


@query(
    """
, keyed AS (
  SELECT event_id, lower(component || ': value ' || regexp_replace(regexp_replace(printf('%.2f', value),
    '^[0-9]+[.][0-9]+$', '<NUM>'), '^-[0-9]+[.][0-9]+$', '-<NUM>') || ' of '
    || CASE WHEN event_id % 50 + 990 >= 1000 THEN '<NUM>' ELSE (event_id % 50 + 990)::VARCHAR END) AS key_normalized
  FROM logs)
SELECT event_id, key_normalized,
  array_to_string(list_filter(regexp_split_to_array(key_normalized, '[^a-z0-9]+'), lambda t: length(t) >= 3), ' ') AS tokens
FROM keyed""",
    LOG_SQL,
)
def build_keys_tokens(spark, sf_dir):
    parsed = with_parsed(log_lines(spark, sf_dir).select("event_id", "line"), "line", normalize_numbers=True)
    return parsed.select("event_id", "key_normalized", F.array_join("tokens", " ").alias("tokens"))


@query(
    """
SELECT doc_id, key_normalized,
  array_to_string(list_filter(regexp_split_to_array(key_normalized, '[^a-z0-9]+'), lambda t: length(t) >= 3), ' ') AS tokens
FROM (SELECT doc_id, CASE WHEN n <> '' THEN n ELSE lower(trim(text)) END AS key_normalized FROM (
  SELECT doc_id, text, lower(trim(regexp_replace(
    regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '^\\d{4}-\\d{2}-\\d{2}T\\S+\\s+', ''),
      '<[^>]>', ' ', 'g'), '\\[[^\\]]+\\]', ' ', 'g'), '^[A-Za-z0-9_.-]{4,}\\s+[A-Za-z0-9_.-]+:\\s+', ''),
    '[\\s\\x0b\\x1c-\\x1f\\x{85}\\x{a0}\\x{2028}\\x{3000}]+', ' ', 'g'))) AS n FROM documents))""",
)
def document_keys(spark, sf_dir):
    """Search keys of whole documents taken as one message."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("message"))
    keyed = build_columns(docs.withColumn("component", F.lit(None).cast("string")))
    return keyed.select("doc_id", "key_normalized", F.array_join("tokens", " ").alias("tokens"))


CONV_SQL = """
turns AS (SELECT conv_id, turn, CASE WHEN turn % 3 = 2 THEN '<E> ' || text ELSE text END AS text FROM conversations),
turn_lines AS (
  SELECT conv_id, turn, unnest(range(1, len(ls) + 1)) AS pos, trim(unnest(ls), chr(9) || ' ') AS line
  FROM (SELECT conv_id, turn, string_split(text, chr(10)) AS ls FROM turns))
"""


@query(
    """
SELECT conv_id, first(line ORDER BY line NOT LIKE '%<E>%', turn, pos) AS selected_line
FROM turn_lines WHERE line <> '' GROUP BY conv_id""",
    CONV_SQL,
)
def relevant_line_per_block(spark, sf_dir):
    lines = _turns(spark, sf_dir).select("conv_id", "turn", F.posexplode(split_lines(F.col("text"))).alias("pos", "line"))
    placed = lines.withColumn("place", F.struct("turn", "pos"))
    return relevant_rows(placed, ["conv_id"], "place", "line")


@query(
    """
SELECT conv_id, turn, coalesce((list_filter(ls, lambda x: contains(x, '<E>')))[1], ls[1], '') AS selected_line
FROM (SELECT conv_id, turn, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x, chr(9) || ' ')), lambda x: x <> '') AS ls
  FROM turns)""",
    CONV_SQL,
)
def relevant_line_of_text(spark, sf_dir):
    turns = _turns(spark, sf_dir)
    return turns.select("conv_id", "turn", relevant_line(F.col("text")).alias("selected_line"))


def _turns(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    return turns.withColumn("text", F.when(F.col("turn") % 3 == 2, F.concat(F.lit("<E> "), "text")).otherwise(F.col("text")))


@query(
    """
SELECT component || ': ' || message AS key, lower(component || ': ' || message) AS normalized_key,
  count(*) AS occurrence_count, strftime(min(ts), '%Y-%m-%d %H:%M:%S.%f') AS first_seen,
  strftime(max(ts), '%Y-%m-%d %H:%M:%S.%f') AS last_indexed
FROM logs GROUP BY ALL""",
    LOG_SQL,
)
def error_key_rollup(spark, sf_dir):
    rolled = rollups.error_key_rollup(_occurrences(spark, sf_dir))
    stamp = lambda c: F.date_format(c, TIME).alias(c)
    return rolled.select("key", "normalized_key", "occurrence_count", stamp("first_seen"), stamp("last_indexed"))


def _occurrences(spark, sf_dir):
    parsed = with_parsed(log_lines(spark, sf_dir).select("event_id", "ts", "user_id", "value", "line"), "line")
    return parsed.select(
        F.col("event_id").alias("occurrence_id"),
        "ts",
        F.col("key_exact").alias("message"),
        F.least(F.col("value") / 100, F.lit(1.0)).alias("confidence"),
        F.concat(F.lit("src/"), "host_or_serial", F.lit(".py")).alias("file_path"),
        F.concat(F.lit("handle_"), F.lower("level")).alias("function_name"),
    )


@query(
    """
SELECT component || ': ' || message AS key, count(*) AS occurrence_count FROM logs
WHERE contains(lower(component || ': ' || message), 'error') GROUP BY ALL""",
    LOG_SQL,
)
def error_key_filter(spark, sf_dir):
    return rollups.filter_keys(rollups.error_key_rollup(_occurrences(spark, sf_dir)), "ErroR").select("key", "occurrence_count")


@query(
    """
SELECT event_id AS occurrence_id, component || ': ' || message AS message FROM logs
WHERE least(value / 100, 1.0) >= 0.2 AND contains('src/RS' || user_id || '.py', 'RS1') AND upper(event_type[1]) IN ('E')
  AND ts >= TIMESTAMP '2024-01-05' AND ts <= TIMESTAMP '2024-01-25'""",
    LOG_SQL,
)
def occurrence_filters(spark, sf_dir):
    kept = rollups.filter_occurrences(_occurrences(spark, sf_dir), 0.2, "RS1", "handle_e", "2024-01-05", "2024-01-25")
    return kept.select("occurrence_id", "message")


@query(
    """
SELECT lower(component || ': ' || message) AS normalized_key, event_id AS occurrence_id,
  row_number() OVER (PARTITION BY lower(component || ': ' || message) ORDER BY ts DESC, event_id) AS place
FROM logs QUALIFY place <= 5""",
    LOG_SQL,
)
def error_key_groups(spark, sf_dir):
    """The five latest occurrences of each key."""
    return rollups.top_occurrences(_occurrences(spark, sf_dir), 5, "ts").select("normalized_key", "occurrence_id", "place")


@query(
    """
SELECT lower(component || ': ' || message) AS normalized_key, event_id AS occurrence_id,
  count(*) OVER (PARTITION BY lower(component || ': ' || message)) AS group_count FROM logs""",
    LOG_SQL,
)
def grouped_occurrences(spark, sf_dir):
    return rollups.grouped_occurrences(_occurrences(spark, sf_dir)).select("normalized_key", "occurrence_id", "group_count")


@query(
    """
SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS window_start, upper(event_type[1]) AS level,
  component, count(*) AS n_lines FROM logs GROUP BY ALL""",
    LOG_SQL,
)
def log_counts_per_hour(spark, sf_dir):
    """Batch twin of the windowed stream counts."""
    parsed = with_parsed(log_lines(spark, sf_dir).select("event_id", "ts", "line"), "line")
    counts = parsed.groupBy(F.window("ts", "1 hour").alias("w"), "level", "component").agg(F.count(F.lit(1)).alias("n_lines"))
    return counts.select(F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "level", "component", "n_lines")


@query(
    """
, picked AS (
  SELECT event_id // 5 AS block_id, arg_min(event_id, (CASE WHEN upper(event_type[1]) = 'E' THEN 0 ELSE 1 END, event_id)) AS event_id
  FROM events GROUP BY 1)
SELECT block_id, stamp AS timestamp, upper(event_type[1]) AS level, component, message AS search_message, component || ': ' || message AS key_exact
FROM picked JOIN logs USING (event_id)""",
    LOG_SQL,
)
def analyze_pasted_blocks(spark, sf_dir):
    """Blocks of five log lines: the relevant line of each, parsed to its end."""
    lines = log_lines(spark, sf_dir).select("event_id", "line").withColumn("block_id", F.floor(F.col("event_id") / 5))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("event_id", "line"))), lambda x: x["line"]), "\n")
    blocks = lines.groupBy("block_id").agg(joined.alias("text"))
    return analyze_blocks(blocks).select("block_id", "timestamp", "level", "component", "search_message", "key_exact")


# --- search ------------------------------------------------------------------------------


@query(
    """
SELECT DISTINCT item_id, message, path, line_no FROM msgs JOIN doc_lines ON contains(line_text, message)""",
    DOC_SQL,
)
def overlapping_roots(spark, sf_dir):
    """Files listed by two overlapping roots: one hit per line all the same."""
    files = doc_files(spark, sf_dir)
    lines = explode_lines(files.unionByName(files))
    return search_messages(lines, messages(spark, sf_dir), file=("path",)).select("item_id", "message", "path", "line_no")


@query(
    """
SELECT item_id, message, path, line_no, line_text, 'exact_message' AS match_type, 1.0::DOUBLE AS score
FROM msgs JOIN doc_lines ON contains(line_text, message)""",
    DOC_SQL,
)
def exact_search(spark, sf_dir):
    lines = explode_lines(doc_files(spark, sf_dir))
    hits = search_messages(lines, messages(spark, sf_dir))
    return hits.select("item_id", "message", "path", "line_no", "line_text", "match_type", "score")


@query(
    """
SELECT item_id, message, path, line_no,
  row_number() OVER (PARTITION BY item_id, message ORDER BY path, line_no) AS rank
FROM msgs JOIN doc_lines ON contains(lower(line_text), lower(message)) QUALIFY rank <= 10""",
    DOC_SQL,
)
def exact_search_topk(spark, sf_dir):
    """Ten best lines per message, letter case aside."""
    lines = explode_lines(doc_files(spark, sf_dir))
    hits = search_messages(lines, messages(spark, sf_dir), case_insensitive=True, max_results=10)
    return hits.select("item_id", "message", "path", "line_no", "rank")


@query(
    """
, keys AS (
  SELECT item_id, m.message AS key_exact, lower(m.message) AS key_normalized,
    regexp_extract(m.message, '^[A-Za-z]+') AS component,
    list_filter(regexp_split_to_array(lower(m.message), '[^a-z0-9]+'), lambda t: length(t) >= 3) AS tokens
  FROM (SELECT item_id, regexp_replace(message, '\\s+', ' ', 'g') AS message FROM msgs) m),
tiers AS (
  SELECT item_id, key_exact, path, line_no,
    CASE WHEN contains(line_text, key_exact) THEN 'exact' WHEN contains(line_text, key_normalized) THEN 'normalized'
      WHEN len(tokens) >= 2 AND len(list_filter(tokens, lambda t: NOT contains(line_text, t))) = 0 THEN 'tokens' END AS match_type,
    component <> '' AND contains(line_text, component) AS has_component
  FROM keys, doc_lines),
scored AS (
  SELECT *, round(least(1.0, CASE match_type WHEN 'exact' THEN 1.0 WHEN 'normalized' THEN 0.8 ELSE 0.6 END
    + CASE WHEN has_component THEN 0.1 ELSE 0 END), 6)::DOUBLE AS score
  FROM tiers WHERE match_type IS NOT NULL)
SELECT item_id, key_exact, path, line_no, match_type, score,
  row_number() OVER (PARTITION BY item_id, key_exact ORDER BY score DESC, path, line_no) AS rank
FROM scored QUALIFY rank <= 10""",
    DOC_SQL,
)
def tiered_search_topk(spark, sf_dir):
    lines = explode_lines(doc_files(spark, sf_dir))
    keys = build_columns(
        messages(spark, sf_dir).withColumns(
            {"message": F.regexp_replace("message", r"\s+", " "), "component": F.lit(None).cast("string")}
        )
    ).withColumn("component", F.regexp_extract("key_exact", "^[A-Za-z]+", 0))
    keys = keys.withColumn("key_normalized", F.lower("key_exact")).select(
        "item_id", "key_exact", "key_normalized",
        F.filter(F.split("key_normalized", "[^a-z0-9]+"), lambda t: F.length(t) >= 3).alias("tokens"), "component",
    )
    hits = tiered_search(lines, keys, ["item_id", "key_exact"])
    return hits.select("item_id", "key_exact", "path", "line_no", "match_type", "score", "rank")


@query(
    """
, hits AS (SELECT DISTINCT path, line_no, n_lines FROM msgs JOIN doc_lines ON contains(line_text, message))
SELECT h.path, h.line_no, string_agg(l.line_no || ': ' || l.line_text, chr(10) ORDER BY l.line_no) AS context_preview
FROM hits h JOIN doc_lines l ON l.path = h.path AND l.line_no BETWEEN h.line_no - 10 AND h.line_no + 10
GROUP BY ALL""",
    DOC_SQL,
)
def context_previews(spark, sf_dir):
    files = doc_files(spark, sf_dir)
    hits = search_messages(explode_lines(files), messages(spark, sf_dir)).select("path", "line_no").distinct()
    hits = cut_lineage(hits)
    return context_preview(files_with_hits(files, hits), hits).select("path", "line_no", "context_preview")


# --- enclosing blocks ------------------------------------------------------------------------

CODE_HIT_SQL = """
, hits AS (
  SELECT machine_id, version_id, path, base + 5 AS line_no, message, 'def' AS enclosure_type,
    function_name AS name, block_start AS start_line, block_end AS end_line, line_start AS def_line_no, signature
  FROM fns JOIN (SELECT DISTINCT p_name || ' failed for' AS message FROM part) ON contains(p_name || ' failed for', message)
  UNION ALL
  SELECT DISTINCT machine_id, version_id, path, 2, 'getLogger(__name__)', 'module', NULL, NULL, NULL, NULL, NULL FROM fns)
"""


def _code_hits(spark, sf_dir):
    files = code_files(spark, sf_dir)
    names = table(spark, sf_dir, "part").select(F.concat("p_name", F.lit(" failed for")).alias("message")).distinct()
    wanted = names.union(spark.range(1).select(F.lit("getLogger(__name__)")))
    hits = cut_lineage(search_messages(explode_lines(files), wanted))
    return files_with_hits(files, hits, FILE_KEY), hits


@query(
    """
SELECT machine_id, version_id, path, line_no, message, enclosure_type, name, start_line, end_line, def_line_no,
  signature, enclosure_type <> 'module' AS enclosure_contains_match FROM hits""",
    CODE_SQL + CODE_HIT_SQL,
)
def enclosing_block(spark, sf_dir):
    files, hits = _code_hits(spark, sf_dir)
    return enclose(files, hits, FILE_KEY).select(
        "machine_id", "version_id", "path", "line_no", "message", "enclosure_type", "name", "start_line", "end_line",
        "def_line_no", "signature", "enclosure_contains_match",
    )


@query(
    """
, blocks AS (SELECT p_partkey AS block_id, p_name || ' failed for' AS message FROM part)
SELECT block_id, machine_id, version_id, path, base + 5 AS line_no, 'E' AS level, 'Handler' AS component, function_name AS name,
  block_start AS start_line, block_end AS end_line, docstring AS docstring_text
FROM blocks JOIN fns ON contains(p_name || ' failed for', message)""",
    CODE_SQL,
)
def analysis(spark, sf_dir):
    """From pasted lines to their places in the code of all machines, with block and docstring."""
    part = table(spark, sf_dir, "part")
    text = F.concat(F.lit("RS1234 proc: <I> [#1] Other: ok\nRS1234 proc: <E> [#1] Handler: "), "p_name", F.lit(" failed for"))
    blocks = part.select(F.col("p_partkey").alias("block_id"), text.alias("text"))
    found = analyze(blocks, code_files(spark, sf_dir), key=FILE_KEY, max_results=None)
    return found.select("block_id", *FILE_KEY, "line_no", "level", "component", "name", "start_line", "end_line", "docstring_text")


@query(
    """
SELECT machine_id, version_id, path, line_start AS def_line_no, docstring AS docstring_text, line_start + 1 AS docstring_start_line,
  line_start + 1 AS docstring_end_line, comment1 || coalesce(chr(10) || comment2, '') AS leading_comment_block,
  base + 1 AS leading_comment_start_line, CASE WHEN comment2 IS NULL THEN base + 1 ELSE base + 2 END AS leading_comment_end_line
FROM fns""",
    CODE_SQL,
)
def doc_and_comments(spark, sf_dir):
    files, hits = _code_hits(spark, sf_dir)
    rich = enrich_matches(files, hits, FILE_KEY).filter("enclosure_type <> 'module'")
    return rich.select(
        "machine_id", "version_id", "path", "def_line_no", "docstring_text", "docstring_start_line", "docstring_end_line",
        "leading_comment_block", "leading_comment_start_line", "leading_comment_end_line",
    ).distinct()


@query(
    """
SELECT machine_id, version_id, path, line_no, 100 AS confidence_percent,
  regexp_extract(path, '[^/]+$') || ':' || line_no AS location_short,
  coalesce(signature, '<module>') AS enclosure_display_name,
  'Function/Enclosure: ' || coalesce(signature, '<module>') || chr(10) || 'Match info: exact_message, 100%, '
    || regexp_extract(path, '[^/]+$') || ':' || line_no || chr(10) || 'Log literal key: ' || message || chr(10)
    || 'Component: ' || machine_id AS summary_text
FROM hits""",
    CODE_SQL + CODE_HIT_SQL,
)
def match_display(spark, sf_dir):
    files, hits = _code_hits(spark, sf_dir)
    shown = enclose(files, hits, FILE_KEY).withColumns({"search_message": F.col("message"), "component": F.col("machine_id")})
    return with_display(shown).select(
        "machine_id", "version_id", "path", "line_no", "confidence_percent", "location_short", "enclosure_display_name",
        "summary_text",
    )


@query(
    """
SELECT doc_id, CASE WHEN length(text) > 240 THEN text[:237] || '...' ELSE text END AS snippet,
  CASE WHEN length(text) > 60 THEN text[:57] || '...' ELSE text END AS metadata,
  CASE WHEN n_chars < 1024 THEN printf('%.2f B', n_chars::DOUBLE) ELSE printf('%.2f KB', n_chars / 1024.0) END AS size,
  CASE WHEN n_chars < 60 THEN printf('%.2f seconds', n_chars::DOUBLE)
    WHEN n_chars < 3600 THEN printf('%.2f minutes (%.2f seconds)', n_chars / 60.0, n_chars::DOUBLE)
    ELSE printf('%.1f hours %.1f minutes (%.2f seconds)', n_chars / 3600.0, (n_chars % 3600) / 60.0, n_chars::DOUBLE) END AS duration
FROM documents""",
)
def shortened_texts(spark, sf_dir):
    """Cut texts and figures for people; a document's length also plays a duration."""
    n = F.col("n_chars").cast("double")
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        shorten(F.col("text"), 240, 237).alias("snippet"),
        cut_metadata(F.col("text")).alias("metadata"),
        human_bytes(n).alias("size"),
        human_time(n).alias("duration"),
    )


@query(
    """
, pairs AS (
  SELECT doc_id, text, lower(text) AS low, words[3] || ' ' || words[4] AS q FROM (
    SELECT doc_id, text, list_filter(regexp_split_to_array(lower(text), '[\\s\\x{a0}]+'), lambda w: w <> '') AS words FROM documents)),
sig AS (
  SELECT *, list_filter(string_split(q, ' '), lambda t: length(t) > 2 AND NOT list_contains(stop, t)) AS toks
  FROM pairs, stops),
placed AS (
  SELECT *, CASE WHEN strpos(low, q) > 0 THEN strpos(low, q) ELSE coalesce(strpos(low, toks[1]), 0) END AS p,
    CASE WHEN strpos(low, q) > 0 THEN length(q) ELSE length(toks[1]) END AS w FROM sig),
cut AS (SELECT *, greatest(p - 100, 1) AS s, least(p - 1 + w + 100, length(text)) AS e FROM placed)
SELECT doc_id, CASE WHEN q IS NULL OR coalesce(p, 0) = 0 THEN '' ELSE trim(CASE WHEN s > 1 THEN '...' ELSE '' END || substr(text, s, e - s + 1)
  || CASE WHEN e < length(text) THEN '...' ELSE '' END, chr(9) || chr(10) || ' ') END AS excerpt
FROM cut""",
    """
stops AS (SELECT string_split('a an and are as at be by for from has he in is it its of on that the to was will with get got go goes went this these they them their there then than have had having do does did doing can could should would may might must', ' ') AS stop)""",
)
def match_excerpts(spark, sf_dir):
    """Excerpt of each document around its third and fourth word."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", normalize_query(F.col("text")).alias("norm"))
    parts = docs.withColumn("w", F.filter(F.split("norm", " "), lambda w: w != ""))
    pair = F.when(F.size("w") >= 4, F.concat_ws(" ", F.get("w", 2), F.get("w", 3))).otherwise("")
    asked = parts.select("doc_id", "text", pair.alias("q"))
    asked = settle(asked.withColumn("toks", significant_tokens(F.col("q"))), "q", "toks")
    return asked.select("doc_id", F.when(F.col("q") == "", "").otherwise(match_excerpt(F.col("q"), F.col("toks"), F.col("text"))).alias("excerpt"))
