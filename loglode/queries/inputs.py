"""Log lines, source files, manifests and registry events derived from the driver's tables.

Each Spark builder has a SQL twin below it, used by the check queries.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loglode.functions.text import strip
from loglode.plans.bounds import spread

PARTS_PER_FILE = 400
HEADER_LINES = 3
PART_LINES = 11
FILE_KEY = ("machine_id", "version_id", "path")
INDEX_KEY = ("machine_id", "version_id")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- log lines -------------------------------------------------------------------------


def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One line per event: event_id, ts, value, line. Every third user logs without a time."""
    user = F.col("user_id")
    stamp = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("+00:00 "))
    line = F.concat(
        F.when(user % 3 == 0, "").otherwise(stamp),
        F.lit("RS"),
        user.cast("string"),
        F.lit(" proc"),
        (user % 4).cast("string"),
        F.lit(": <"),
        F.upper(F.substring("event_type", 1, 1)),
        F.lit("> [#"),
        (user % 8).cast("string"),
        F.lit("] "),
        F.col("event_type"),
        F.lit("Handler: value "),
        F.format_string("%.2f", F.col("value")),
        F.lit(" of "),
        (F.col("event_id") % 50 + 990).cast("string"),
    )
    events = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value")
    return spread(events, "event_id").withColumn("line", line)


LOG_SQL = """
logs AS (
  SELECT event_id, ts, user_id, event_type, value,
    CASE WHEN user_id % 3 = 0 THEN NULL ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || '+00:00' END AS stamp,
    'value ' || printf('%.2f', value) || ' of ' || (event_id % 50 + 990) AS message,
    event_type || 'Handler' AS component
  FROM events)
"""


# --- documents and messages --------------------------------------------------------------


def doc_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(
        F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("path"), "text"
    )
    return spread(docs, "path")


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "benchmark").select("item_id", F.explode(F.split("text", "\n")).alias("m"))
    trimmed = lines.select("item_id", strip(F.col("m")).alias("message"))
    return trimmed.filter(F.length("message") > 0).distinct()


DOC_SQL = """
doc_lines AS (
  SELECT path, unnest(range(1, len(ls) + 1)) AS line_no, unnest(ls) AS line_text, len(ls) AS n_lines FROM (
    SELECT source || '/' || doc_id AS path,
      string_split(CASE WHEN suffix(text, chr(10)) THEN text[:-2] ELSE text END, chr(10)) AS ls
    FROM documents WHERE text <> '')),
msgs AS (
  SELECT DISTINCT item_id, trim(m, chr(9) || chr(10) || chr(13) || ' ') AS message
  FROM (SELECT item_id, unnest(string_split(text, chr(10))) AS m FROM benchmark)
  WHERE length(trim(m, chr(9) || chr(10) || chr(13) || ' ')) > 0)
"""


# --- Python and JavaScript files -----------------------------------------------------------


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size")
    file_no = F.floor(F.col("p_partkey") / PARTS_PER_FILE).cast("int")
    folder = F.element_at(
        F.array(*[F.lit(d) for d in ("src", "tests", "tools/scripts", "build")]), F.col("file_no") % 4 + 1
    )
    return part.withColumn("file_no", file_no).select(
        F.col("p_brand").alias("machine_id"),
        F.concat(F.lit("v"), F.col("file_no").cast("string")).alias("version_id"),
        folder.alias("folder"),
        "file_no",
        "p_partkey",
        "p_name",
        "p_type",
        "p_size",
        "p_brand",
    )


def code_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A Python file per brand and block of 400 part numbers: at most 400 functions each."""
    p, size = _parts(spark, sf_dir), F.col("p_size")
    pick = lambda *names: F.element_at(F.array(*[F.lit(n) for n in names]), size % len(names) + 1)
    function = F.format_string(
        "# Handles %s.\n%s\ndef handle_%d(x):\n"
        '    """Docs for %s."""\n'
        '    logger.error("%s failed for %%s" %% x)\n'
        "    if x > %d:\n"
        '        raise ValueError("%s size %d")\n'
        '    print("error in %s")\n'
        '    %s.%s("%s note")\n'
        "    return x\n\n",
        "p_name",
        F.when(size % 2 == 1, "@register").otherwise(F.format_string("# Size %d.", size)),
        "p_partkey",
        "p_name",
        "p_name",
        size,
        "p_type",
        size,
        "p_brand",
        pick("logger", "log", "app.logger"),
        pick("debug", "info", "warning", "warn", "fatal"),
        "p_type",
    )
    body = F.array_sort(F.collect_list(F.struct("p_partkey", function.alias("f"))))
    files = p.groupBy("machine_id", "version_id", "folder", "file_no").agg(body.alias("fs"))
    text = F.concat(
        F.lit("import logging\nlogger = logging.getLogger(__name__)\n"),
        F.when(F.col("file_no") % 2 == 0, "logging.basicConfig(level=10)\n").otherwise("\n"),
        F.array_join(F.transform("fs", lambda x: x["f"]), ""),
        F.when(F.col("file_no") % 5 == 4, 'print "legacy"\n').otherwise(""),
    )
    path = F.concat("folder", F.lit("/mod_"), F.col("file_no").cast("string"), F.lit(".py"))
    return files.select("machine_id", "version_id", path.alias("path"), text.alias("text"))


def script_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same parts as JavaScript and C log lines, a file per brand, block and language."""
    p, size = _parts(spark, sf_dir), F.col("p_size")
    line = (
        F.when(size % 4 == 0, F.format_string('  console.warn("%s " + x);', "p_name"))
        .when(size % 4 == 1, F.format_string("  logger.info(`made ${%s}`);", "p_type"))
        .when(size % 4 == 2, F.format_string('  printf("%s %%d", x);', "p_name"))
        .otherwise(F.format_string("  LOG_ERR('%s', \"%s\");", "p_type", "p_name"))
    )
    ext = F.when(size % 4 < 2, "js").otherwise("c")
    body = F.array_sort(F.collect_list(F.struct("p_partkey", line.alias("l"))))
    files = p.groupBy("machine_id", "version_id", "file_no", ext.alias("ext")).agg(body.alias("ls"))
    path = F.concat(F.lit("web/m"), F.col("file_no").cast("string"), F.lit("."), F.col("ext"))
    text = F.array_join(F.transform("ls", lambda x: x["l"]), "\n")
    return files.select("machine_id", "version_id", path.alias("path"), text.alias("text"))


CODE_SQL = """
parts AS (
  SELECT p_brand AS machine_id, 'v' || (p_partkey // 400) AS version_id, p_partkey // 400 AS file_no,
    list_extract(['src', 'tests', 'tools/scripts', 'build'], (p_partkey // 400) % 4 + 1)
      || '/mod_' || (p_partkey // 400) || '.py' AS path,
    p_partkey, p_name, p_type, p_size, p_brand,
    row_number() OVER w AS k,
    3 + 11 * (row_number() OVER w - 1) AS base,
    count(*) OVER (PARTITION BY p_brand, p_partkey // 400) AS n_fns,
    (p_partkey // 400) % 5 = 4 AS legacy,
    list_extract(['logger', 'log', 'app.logger'], p_size % 3 + 1) AS note_var,
    list_extract(['debug', 'info', 'warning', 'warn', 'fatal'], p_size % 5 + 1) AS note_name,
    lead(p_size % 2) OVER w AS next_odd
  FROM part WINDOW w AS (PARTITION BY p_brand, p_partkey // 400 ORDER BY p_partkey)),
fns AS (
  SELECT *, 'handle_' || p_partkey AS function_name,
    'def handle_' || p_partkey || '(x):' AS signature,
    '# Handles ' || p_name || '.' AS comment1,
    CASE WHEN p_size % 2 = 0 THEN '# Size ' || p_size || '.' END AS comment2,
    'Docs for ' || p_name || '.' AS docstring,
    base + 3 AS line_start, base + 10 AS line_end,
    CASE WHEN p_size % 2 = 1 THEN base + 2 ELSE base + 3 END AS block_start,
    CASE WHEN next_odd = 1 THEN base + 12 WHEN next_odd = 0 THEN base + 13 ELSE base + 11 END AS block_end,
    'def handle_' || p_partkey || '(x):' || chr(10) ||
    '    \"\"\"Docs for ' || p_name || '.\"\"\"' || chr(10) ||
    '    logger.error("' || p_name || ' failed for %s" % x)' || chr(10) ||
    '    if x > ' || p_size || ':' || chr(10) ||
    '        raise ValueError("' || p_type || ' size ' || p_size || '")' || chr(10) ||
    '    print("error in ' || p_brand || '")' || chr(10) ||
    '    ' || note_var || '.' || note_name || '("' || p_type || ' note")' || chr(10) ||
    '    return x' AS code
  FROM parts),
errs AS (
  SELECT *, CASE note_name WHEN 'warning' THEN 'W' WHEN 'debug' THEN 'I' WHEN 'info' THEN 'I' END AS note_level
  FROM fns),
posts AS (
  SELECT machine_id, version_id, path, k - 1 AS fn_seq, line_start,
    row_number() OVER (PARTITION BY machine_id, version_id, path, k ORDER BY e.o) - 1 AS error_pos,
    lower(e.m) AS error_key, e.m AS original_message, e.l AS log_level, e.s AS source_type, function_name
  FROM (SELECT *, unnest([
      {'o': 1, 'm': p_name || ' failed for %s', 'l': 'E', 's': 'logging_format'},
      {'o': 2, 'm': p_type || ' size ' || p_size, 'l': 'E', 's': 'exception'},
      {'o': 3, 'm': 'error in ' || p_brand, 'l': 'E', 's': 'print'},
      {'o': 4, 'm': p_type || ' note', 'l': note_level, 's': 'logging'}]) AS e
    FROM errs WHERE NOT legacy)
  WHERE e.l IS NOT NULL)
"""


# --- manifests -------------------------------------------------------------------------------


def _page_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    bare = F.regexp_replace(F.regexp_replace("url", "^[a-z]+://", ""), "[?#].*$", "")
    pages = table(spark, sf_dir, "pages").select(
        "page_id",
        F.split(bare, "/")[0].alias("machine"),
        F.concat_ws("/", bare, F.col("page_id").cast("string")).alias("path"),
        "html",
    )
    return spread(pages, "page_id")


def manifest_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as files (some as links or directories) of the tree of their host."""
    n = F.col("page_id")
    kind = F.when(n % 10 == 3, "symlink").when(n % 10 == 6, "dir").otherwise("file")
    return _page_paths(spark, sf_dir).select(
        "page_id",
        "machine",
        "path",
        kind.alias("type"),
        F.octet_length("html").cast("bigint").alias("length"),
        F.col("html").cast("binary").alias("content"),
        F.concat(F.lit("target/"), F.col("page_id").cast("string")).alias("link_target"),
        F.when(n % 23 == 5, "hash_failed: denied").alias("error"),
    )


def changed_listing(listing: DataFrame) -> DataFrame:
    """The other side of a comparison: some entries gone, new, of another size, hash, type, target or error."""
    n = F.col("page_id")
    kept = listing.filter(n % 11 != 0)
    return kept.withColumns(
        {
            "path": F.when(n % 13 == 1, F.concat("path", F.lit(".new"))).otherwise(F.col("path")),
            "length": F.when(n % 7 == 0, F.col("length") + 1).otherwise(F.col("length")),
            "content": F.when(n % 7 == 0, F.concat("content", F.lit("x").cast("binary"))).otherwise(F.col("content")),
            "type": F.when(n % 17 == 2, "dir").otherwise(F.col("type")),
            "link_target": F.when(n % 4 == 1, F.lit("elsewhere")).otherwise(F.col("link_target")),
            "error": F.when(n % 19 == 4, "stat_failed: gone").otherwise(F.col("error")),
        }
    )


def _entry_sql(source: str) -> str:
    return f"""
  SELECT machine, path, type,
    CASE WHEN type = 'file' THEN length END AS size,
    CASE WHEN type = 'file' AND error IS NULL THEN sha256(content) END AS sha256,
    CASE WHEN type = 'symlink' THEN link_target END AS link_target, error
  FROM {source}"""


MANIFEST_SQL = f"""
listing AS (
  SELECT page_id, split_part(bare, '/', 1) AS machine, bare || '/' || page_id AS path,
    CASE page_id % 10 WHEN 3 THEN 'symlink' WHEN 6 THEN 'dir' ELSE 'file' END AS type,
    strlen(html) AS length, html AS content, 'target/' || page_id AS link_target,
    CASE WHEN page_id % 23 = 5 THEN 'hash_failed: denied' END AS error
  FROM (SELECT page_id, html, regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', '') AS bare FROM pages)),
changed AS (
  SELECT page_id, machine, CASE WHEN page_id % 13 = 1 THEN path || '.new' ELSE path END AS path,
    CASE WHEN page_id % 17 = 2 THEN 'dir' ELSE type END AS type,
    CASE WHEN page_id % 7 = 0 THEN length + 1 ELSE length END AS length,
    CASE WHEN page_id % 7 = 0 THEN content || 'x' ELSE content END AS content,
    CASE WHEN page_id % 4 = 1 THEN 'elsewhere' ELSE link_target END AS link_target,
    CASE WHEN page_id % 19 = 4 THEN 'stat_failed: gone' ELSE error END AS error
  FROM listing WHERE page_id % 11 <> 0),
ma AS ({_entry_sql("listing")}),
mb AS ({_entry_sql("changed")})
"""


def tree_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page addresses as a source tree with markers and code files."""
    n = F.col("page_id")
    name = (
        F.when(n % 6 == 0, "setup.py")
        .when(n % 6 == 1, F.concat(F.lit("m"), n.cast("string"), F.lit(".PY")))
        .when(n % 6 == 2, "Makefile")
        .when(n % 6 == 3, ".git/config")
        .when(n % 6 == 4, F.concat(F.lit("c"), n.cast("string"), F.lit(".c")))
        .otherwise("page.html")
    )
    folder = F.concat_ws("/", F.element_at(F.split("path", "/"), 1), F.element_at(F.split("path", "/"), 2))
    pages = _page_paths(spark, sf_dir)
    return pages.select(
        F.concat_ws("/", folder, name).alias("path"),
        F.when(n % 9 == 8, "symlink").otherwise("file").alias("type"),
        F.octet_length("html").cast("bigint").alias("length"),
        (n % 9 == 8).alias("is_symlink"),
    )


TREE_SQL = """
tree AS (
  SELECT dir || '/' || CASE page_id % 6 WHEN 0 THEN 'setup.py' WHEN 1 THEN 'm' || page_id || '.PY' WHEN 2 THEN 'Makefile'
      WHEN 3 THEN '.git/config' WHEN 4 THEN 'c' || page_id || '.c' ELSE 'page.html' END AS path,
    dir, page_id, page_id % 9 = 8 AS is_symlink, strlen(html) AS length
  FROM (SELECT page_id, html, split_part(bare, '/', 1) || '/' || split_part(bare, '/', 2) AS dir
    FROM (SELECT page_id, html, regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', '') AS bare FROM pages)))
"""


# --- registry --------------------------------------------------------------------------------


def registry_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order uploads a version of its customer's machine; some are activated again, some deleted, some activated after they are gone."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority", "o_orderdate")
    # Seconds from the order number keep the events of a machine apart in time.
    at = lambda days: F.col("o_orderdate") + F.make_dt_interval(F.lit(days), F.lit(0), F.lit(0), F.col("o_orderkey") % 86400)
    event = lambda op, days: F.struct(F.lit(op).alias("op"), at(days).alias("ts"))
    urgent = F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")
    steps = F.array(
        event("upload", 0),
        F.when(F.col("o_orderstatus") == "P", event("activate", 200)),
        F.when(urgent, event("delete", 400)),
        F.when(F.col("o_orderkey") % 3 == 0, event("activate", 450)),
    )
    return orders.select(
        F.col("o_custkey").alias("machine_id"), F.col("o_orderkey").alias("version_id"), F.explode(steps).alias("e")
    ).filter("e is not null").select("machine_id", "version_id", "e.op", "e.ts")


REGISTRY_SQL = """
ev AS (
  SELECT machine_id, version_id, e.op AS op, e.ts AS ts FROM (
    SELECT o_custkey AS machine_id, o_orderkey AS version_id, unnest([
      {'op': 'upload', 'ts': o_orderdate + to_seconds(o_orderkey % 86400)},
      {'op': CASE WHEN o_orderstatus = 'P' THEN 'activate' END, 'ts': o_orderdate + to_seconds(o_orderkey % 86400) + INTERVAL 200 DAY},
      {'op': CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'delete' END, 'ts': o_orderdate + to_seconds(o_orderkey % 86400) + INTERVAL 400 DAY},
      {'op': CASE WHEN o_orderkey % 3 = 0 THEN 'activate' END, 'ts': o_orderdate + to_seconds(o_orderkey % 86400) + INTERVAL 450 DAY}]) AS e
    FROM orders) WHERE e.op IS NOT NULL),
lives AS (
  SELECT machine_id, version_id, min(ts) FILTER (op = 'upload') AS created_at, max(ts) FILTER (op = 'delete') AS deleted_at,
    max(ts) FILTER (op <> 'delete' AND ts < coalesce(gone, ts + INTERVAL 1 DAY)) AS chosen_at
  FROM (SELECT *, min(ts) FILTER (op = 'delete') OVER (PARTITION BY machine_id, version_id) AS gone FROM ev) GROUP BY ALL),
picked AS (
  SELECT machine_id, version_id, deleted_at,
    row_number() OVER (PARTITION BY machine_id ORDER BY chosen_at DESC, version_id DESC) AS by_choice,
    row_number() OVER (PARTITION BY machine_id ORDER BY deleted_at IS NOT NULL, created_at DESC, version_id DESC) AS by_age
  FROM lives),
act AS (
  SELECT machine_id, coalesce(max(version_id) FILTER (by_choice = 1 AND deleted_at IS NULL),
    max(version_id) FILTER (by_age = 1 AND deleted_at IS NULL)) AS version_id
  FROM picked GROUP BY machine_id)
"""


def machines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("id"),
        F.concat_ws("-", "c_mktsegment", F.col("c_nationkey").cast("string"), (F.col("c_custkey") % 40).cast("string")).alias("display_name"),
        F.col("c_mktsegment").alias("printing_type"),
    )
