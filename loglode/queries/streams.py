"""Check queries: streams run to the end over files that land step by step."""

from __future__ import annotations

from pyspark.sql import functions as F

from loglode.operators import chunks as C
from loglode.operators.load import events, load_versions, loaded
from loglode.operators.facts import file_facts, stored_chunks, update_facts
from loglode.operators.registry import active_versions
from loglode.operators.word_index import build_words
from loglode.queries.base import query
from loglode.queries.code import QUERY_SQL
from loglode.queries.inputs import CODE_SQL, FILE_KEY, INDEX_KEY, LOG_SQL, code_files, log_lines, table
from loglode.queries.logs import CONV_SQL, _turns
from loglode.session import cut_lineage, scratch_path
from loglode.sources.fragments import document_fragments
from loglode.streaming import logs as S

STAMP = "yyyy-MM-dd HH:mm:ss"


@query(
    """
SELECT stamp AS timestamp, 'RS' || user_id AS host_or_serial, upper(event_type[1]) AS level, component, message, count(*) AS n_lines
FROM logs GROUP BY ALL""",
    LOG_SQL,
)
def stream_parsed(spark, sf_dir):
    """Log files landing in two steps, parsed as a stream into parquet; then counted."""
    source, out = scratch_path(spark, "logs"), scratch_path(spark, "parsed")
    lines = log_lines(spark, sf_dir).select("event_id", "line")
    for step in range(2):
        lines.filter(F.col("event_id") % 2 == step).select("line").write.mode("append").text(source)
        stream = S.parsed_stream(S.log_stream(spark, source)).select("timestamp", "host_or_serial", "level", "component", "message")
        found = S.drain(stream, out)
    return found.groupBy(*found.columns).agg(F.count(F.lit(1)).alias("n_lines"))


@query(
    """
, timed AS (SELECT *, date_trunc('hour', ts) AS hour FROM logs WHERE stamp IS NOT NULL),
ends AS (SELECT max(ts) - INTERVAL 10 MINUTE AS mark FROM timed)
SELECT strftime(hour, '%Y-%m-%d %H:%M:%S') AS window_start, component, count(*) AS n_lines
FROM timed, ends WHERE event_id % 50 <> 7 AND hour + INTERVAL 1 HOUR <= mark GROUP BY ALL""",
    LOG_SQL,
)
def stream_counts(spark, sf_dir):
    """Lines per hour as a stream with state over three steps: the first half of the month, the rest, and one line in
    fifty that comes when its hour has been closed and is dropped. The last hours are still open and not written."""
    source, out = scratch_path(spark, "logs"), scratch_path(spark, "counts")
    rows = log_lines(spark, sf_dir).select("event_id", "ts", "line", "user_id")
    late = F.col("event_id") % 50 == 7
    last_hours = F.col("ts") >= F.lit(rows.agg(F.max("ts")).first()[0]) - F.expr("INTERVAL 3 HOURS")
    half = F.dayofmonth("ts") <= 15
    for kept in (~late & half, ~late & ~half, late & ~last_hours):
        rows.filter(kept).select("line").write.mode("append").text(source)
        parsed = S.parsed_stream(S.log_stream(spark, source))
        counts = S.windowed_counts(parsed, group=("component",)).drop("window_end")
        found = S.drain(counts, out)
    return found.select(F.date_format("window_start", STAMP).alias("window_start"), "component", "n_lines")


@query(
    """
SELECT conv_id, first(line ORDER BY line NOT LIKE '%<E>%', turn, pos) AS selected_line
FROM turn_lines WHERE line <> '' GROUP BY conv_id""",
    CONV_SQL,
)
def stream_relevant_lines(spark, sf_dir):
    """The relevant line of every conversation once its session is over, as a stream; a last far row closes them all."""
    source, out = scratch_path(spark, "turns"), scratch_path(spark, "relevant")
    day = F.col("conv_id") * 86400 + F.col("turn") * 60
    turns = _turns(spark, sf_dir).select("conv_id", "turn", "text", F.timestamp_seconds(day).alias("at"))
    end = turns.agg(F.lit(-1).cast("long").alias("conv_id"), F.lit(0).cast("long").alias("turn"), F.lit("end").alias("text"), (F.max("at") + F.expr("INTERVAL 2 DAYS")).alias("at"))
    after = end.withColumns({"conv_id": F.lit(-2).cast("long"), "at": F.col("at") + F.expr("INTERVAL 2 DAYS")})
    schema = turns.schema
    for rows in (turns, end, after):
        rows.write.mode("append").json(source)
        lines = spark.readStream.schema(schema).json(source).select("conv_id", "turn", "at", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
        placed = lines.withColumn("place", F.struct("turn", "pos"))
        found = S.drain(S.relevant_line_stream(placed, ["conv_id"], "place", "line", "at").select("conv_id", "selected_line"), out)
    return found.filter("conv_id >= 0")


@query(
    """
, steps AS (SELECT unnest([0, 1]) AS step),
actives AS (
  SELECT step, machine_id, coalesce(max(file_no) FILTER (step = 1 AND file_no % 2 = 0), max(file_no) FILTER (file_no % 2 = 1)) AS file_no
  FROM steps, (SELECT DISTINCT machine_id, file_no FROM parts WHERE NOT legacy) WHERE step = 1 OR file_no % 2 = 1 GROUP BY ALL),
asked_now AS (SELECT DISTINCT step, a.machine_id, p.p_type || ' note' AS message, 'v' || a.file_no AS version_id
  FROM actives a JOIN parts p ON p.machine_id = a.machine_id AND p.file_no = a.file_no)
SELECT step, machine_id, version_id, message, match_type, error_key, score, n_chunks
FROM asked_now JOIN results USING (machine_id, version_id, message)""",
    CODE_SQL + QUERY_SQL,
)
def stream_lookup(spark, sf_dir):
    """Log messages looked up in the active index while it changes: first the odd versions are loaded, then the even ones.

    The messages of each step are of the version then active; what they find comes from that version only.
    """
    files, facts, store = code_files(spark, sf_dir), scratch_path(spark, "facts"), scratch_path(spark, "loads")
    source, out = scratch_path(spark, "asked"), scratch_path(spark, "found")
    number = F.regexp_extract("version_id", "[0-9]+", 0).cast("int")
    update_facts(files, facts, FILE_KEY)
    chunks = stored_chunks(files, facts, FILE_KEY)
    totals = C.index_totals(files, chunks, INDEX_KEY, file_facts(files, facts, FILE_KEY))
    rows = cut_lineage(document_fragments(chunks, C.error_postings(chunks, FILE_KEY), totals.filter("total_chunks > 0"), "2024-01-01T00:00:00Z"))
    part = table(spark, sf_dir, "part")
    asks = part.select(
        F.col("p_brand").alias("machine_id"),
        F.concat(F.lit("v"), F.floor(F.col("p_partkey") / 400).cast("int").cast("string")).alias("version_id"),
        F.concat("p_type", F.lit(" note")).alias("message"),
    ).distinct()

    def active():
        stamped = events(spark, store).withColumn("ts", F.col("ts") + F.make_dt_interval(secs=number.cast("decimal(18,6)")))
        return active_versions(stamped)

    def current():
        versions = active()
        postings, held = [loaded(spark, store, t).join(versions, list(INDEX_KEY), "left_semi") for t in ("postings", "chunks")]
        held = cut_lineage(held.withColumnRenamed("file_path", "path"))
        return postings, held, build_words(postings, held)

    for step in range(2):
        load_versions(rows.filter(number % 2 == 1 - step), store, f"2024-01-0{step + 1} 00:00:00")
        now = asks.join(active(), list(INDEX_KEY), "left_semi").select("machine_id", "message", F.lit(step).alias("step"))
        now.write.mode("append").json(source)
        stream = spark.readStream.schema("machine_id string, message string, step int").json(source)
        asked = stream.withColumn("query_id", F.concat_ws("|", F.col("step").cast("string"), "machine_id", "message"))
        found = S.lookup_batches(asked, current, out)
    at = lambda i: F.element_at(F.split("query_id", r"\|"), i)
    return found.select(
        at(1).cast("int").alias("step"), "machine_id", "version_id", at(3).alias("message"),
        "match_type", "error_key", F.round("score", 6).alias("score"), "n_chunks",
    )
