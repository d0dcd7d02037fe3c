"""Check queries: function chunks, indexes, index search."""

from __future__ import annotations

from pyspark.sql import functions as F

from loglode.operators import chunks as C
from loglode.operators import index_search as S
from loglode.operators.facts import file_facts, stored_chunks, update_facts
from loglode.operators.load import compact, delete, events, load_versions, loaded
from loglode.operators.registry import active_versions
from loglode.operators.word_index import build_words
from loglode.plans.bounds import shuffled
from loglode.queries.base import query
from loglode.queries.inputs import CODE_SQL, FILE_KEY, INDEX_KEY, code_files, table
from loglode.session import cut_lineage, scratch_path, stored
from loglode.sources.fragments import checked_versions, document_fragments, fragment_postings, read_fragments, write_fragments


def chunk_index(spark, sf_dir):
    """Chunks and postings of the derived files; written once, as an index is, since searches read it several times."""
    chunks = shuffled(stored(C.function_chunks(code_files(spark, sf_dir), FILE_KEY)))
    return chunks, C.error_postings(chunks, FILE_KEY)


@query(
    """
SELECT machine_id, version_id, path, k - 1 AS fn_seq, function_name, NULL AS class_name, line_start, line_end, signature,
  sha256(code) AS code_sha, docstring, comment2 AS leading_comment,
  CASE WHEN note_level IS NULL THEN 3 ELSE 4 END AS n_errors,
  CASE WHEN note_level IS NULL THEN 'E' ELSE 'E,' || note_level END AS log_levels
FROM (SELECT * REPLACE (CASE WHEN p_size % 2 = 0 THEN comment1 || chr(10) || comment2 END AS comment2) FROM errs) WHERE NOT legacy""",
    CODE_SQL,
)
def function_chunks(spark, sf_dir):
    rows = C.function_chunks(code_files(spark, sf_dir), FILE_KEY)
    return rows.select(
        *FILE_KEY, "fn_seq", "function_name", "class_name", "line_start", "line_end", "signature",
        F.sha2("code", 256).alias("code_sha"), "docstring", "leading_comment", F.size("error_messages").alias("n_errors"),
        F.array_join("log_levels", ",").alias("log_levels"),
    )


@query(
    """
SELECT machine_id, version_id, path, fn_seq, error_pos, error_key, original_message, log_level, source_type FROM posts""",
    CODE_SQL,
)
def error_index(spark, sf_dir):
    chunks = C.function_chunks(code_files(spark, sf_dir), FILE_KEY)
    return C.error_postings(chunks, FILE_KEY).drop("chunk_id")


@query(
    """
SELECT machine_id, count(DISTINCT path) FILTER (NOT legacy) AS files_processed,
  count(DISTINCT path) FILTER (legacy) AS files_failed, count(*) FILTER (NOT legacy) AS functions_found,
  coalesce(sum(CASE WHEN note_level IS NULL THEN 3 ELSE 4 END) FILTER (NOT legacy), 0)::BIGINT AS errors_found,
  count(*) FILTER (NOT legacy) AS chunks_with_errors,
  count(*) FILTER (NOT legacy) AS total_chunks,
  coalesce(sum(CASE WHEN note_level IS NULL THEN 3 ELSE 4 END) FILTER (NOT legacy), 0)::BIGINT AS total_errors
FROM errs GROUP BY machine_id""",
    CODE_SQL,
)
def index_totals(spark, sf_dir):
    """Totals from a store of facts: every file is parsed once, for its chunks and its state."""
    files, store = code_files(spark, sf_dir), scratch_path(spark, "facts")
    update_facts(files, store, FILE_KEY)
    return C.index_totals(files, stored_chunks(files, store, FILE_KEY), ("machine_id",), file_facts(files, store, FILE_KEY))


@query(
    """
, files AS (SELECT DISTINCT machine_id, version_id, file_no, legacy, n_fns FROM parts),
moved AS (SELECT *, file_no % 16 = 7 AS changed, file_no % 16 = 9 AS copied FROM files)
SELECT 1 AS step, count(*) AS n_files, count(*) AS n_parsed, sum(CASE WHEN legacy THEN 0 ELSE n_fns END)::BIGINT AS n_chunks FROM files
UNION ALL
SELECT 2, count(*) + count(*) FILTER (copied), count(*) FILTER (changed),
  sum(CASE WHEN legacy THEN 0 WHEN copied THEN 2 * n_fns WHEN changed THEN n_fns + 1 ELSE n_fns END)::BIGINT FROM moved""",
    CODE_SQL,
)
def facts_reuse(spark, sf_dir):
    """A second version of all trees, with some files changed and some copied: only the changed ones are parsed."""
    files, store = code_files(spark, sf_dir), scratch_path(spark, "facts")
    number = F.regexp_extract("version_id", "[0-9]+", 0).cast("int") % 16
    later = files.withColumn("text", F.concat("text", F.when(number == 7, F.lit("def added(x):\n    return x\n")).otherwise("")))
    later = later.unionByName(files.filter(number == 9).withColumn("path", F.concat(F.lit("copy/"), "path")))
    rows = []
    for step, tree in enumerate((files, later), 1):
        n_parsed = update_facts(tree, store, FILE_KEY)
        chunks = stored_chunks(tree, store, FILE_KEY).agg(F.count(F.lit(1)).alias("n_chunks"))
        counts = tree.agg(F.count(F.lit(1)).alias("n_files"))
        rows.append(counts.crossJoin(chunks).select(F.lit(step).alias("step"), "n_files", F.lit(n_parsed).cast("long").alias("n_parsed"), "n_chunks"))
    return rows[0].unionByName(rows[1])


@query(
    """
SELECT machine_id, error_key, count(*) AS count FROM posts GROUP BY ALL""",
    CODE_SQL,
)
def error_key_listing(spark, sf_dir):
    chunks = C.function_chunks(code_files(spark, sf_dir), FILE_KEY)
    return C.error_key_listing(C.error_postings(chunks, FILE_KEY), ("machine_id",))


@query(
    """
SELECT machine_id, version_id, count(DISTINCT error_key) AS unique_error_keys, count(*) AS total_errors FROM posts GROUP BY ALL""",
    CODE_SQL,
)
def index_inspection(spark, sf_dir):
    chunks = C.function_chunks(code_files(spark, sf_dir), FILE_KEY)
    return C.unique_keys(C.error_postings(chunks, FILE_KEY), INDEX_KEY)


#: Damages to the heads of documents, by case: what is replaced, by what; the others are whole.
_DAMAGE = {
    1: ('"schema_version":"1.0",', ""),
    2: ('"created_at":"[^"]*",', ""),
    3: (r'"chunks":\[\],', ""),
    4: (r'"error_index":\{\},', ""),
    5: (r'"stats":\{[^}]*\},', ""),
    6: (r'"chunks":\[\]', '"chunks":{}'),
    7: (r'"error_index":\{\}', '"error_index":[]'),
    8: (r'"stats":\{[^}]*\}', '"stats":[1]'),
    9: ('"total_chunks":', '"total_chunks":9'),
    10: ('"total_errors":', '"total_errors":9'),
    11: ('"schema_version":"1.0"', '"schema_version":""'),
    12: ("2024-01-01T00:00:00Z", ""),
    13: ("2024-01-01T00:00:00Z", "first of May"),
    14: ("^.", "{{"),
}
_CASE = "(CAST(substr(version_id, 2) AS INT) * 5 + CAST(substr(machine_id, 7) AS INT)) % 16"
VIOLATION_SQL = f"""
, cases AS (SELECT *, {_CASE} AS c FROM errs),
judged AS (SELECT *, coalesce(map {{
  1: 'Missing required field: schema_version', 2: 'Missing required field: created_at', 3: 'Missing required field: chunks',
  4: 'Missing required field: error_index', 5: 'Missing required field: stats', 6: 'Field ''chunks'' must be an array',
  7: 'Field ''error_index'' must be an object', 8: 'Field ''stats'' must be an object', 9: 'total_chunks does not match chunks',
  10: 'total_errors does not match error_index', 11: 'Missing ''schema_version'' field in index', 12: 'Missing ''created_at'' field in index',
  13: 'Invalid ''created_at'' format', 14: 'Invalid JSON'}}[c], '') AS violations FROM cases)
"""


def _fragments(spark, sf_dir):
    """Index documents of all versions in fragments; in 14 of 16 cases the head is damaged, each time in another way."""
    files, store = code_files(spark, sf_dir), scratch_path(spark, "facts")
    update_facts(files, store, FILE_KEY)
    chunks = stored_chunks(files, store, FILE_KEY)
    totals = C.index_totals(files, chunks, INDEX_KEY, file_facts(files, store, FILE_KEY))
    rows = document_fragments(chunks, C.error_postings(chunks, FILE_KEY), totals, "2024-01-01T00:00:00Z")
    case = F.expr(_CASE)
    json = F.col("json")
    for k, (old, new) in _DAMAGE.items():
        json = F.when((case == k) & (F.col("part") == "head"), F.regexp_replace("json", old, new)).otherwise(json)
    return rows.withColumn("json", json)


@query(
    """
SELECT machine_id, version_id, count(*) FILTER (NOT legacy) AS n_chunks,
  coalesce(sum(CASE WHEN note_level IS NULL THEN 3 ELSE 4 END) FILTER (NOT legacy), 0)::BIGINT AS n_postings, violations
FROM judged GROUP BY ALL""",
    CODE_SQL + VIOLATION_SQL,
)
def index_validate(spark, sf_dir):
    """Documents in fragments, damaged in every way there is, validated by sums over their rows."""
    checked = checked_versions(_fragments(spark, sf_dir))
    return checked.select(*INDEX_KEY, "n_chunks", "n_postings", F.array_join("violations", "; ").alias("violations"))


@query(
    """
SELECT machine_id, version_id, error_key, original_message, log_level, source_type, count(*) AS n
FROM posts WHERE (machine_id, version_id) IN (SELECT (machine_id, version_id) FROM judged WHERE violations = '') GROUP BY ALL""",
    CODE_SQL + VIOLATION_SQL,
)
def index_roundtrip(spark, sf_dir):
    """Documents written as fragments in JSON lines and read back: the postings of those that pass validation."""
    path = scratch_path(spark, "fragments")
    write_fragments(_fragments(spark, sf_dir), path)
    rows = read_fragments(spark, path)
    good = checked_versions(rows).filter(F.size("violations") == 0).select(*INDEX_KEY)
    back = fragment_postings(rows.join(good, list(INDEX_KEY), "left_semi"))
    return back.groupBy(*INDEX_KEY, "error_key", "original_message", "log_level", "source_type").agg(F.count(F.lit(1)).alias("n"))


@query(
    """
, loads AS (
  SELECT machine_id, version_id, file_no, violations, count(*) FILTER (NOT legacy) AS n_chunks,
    coalesce(sum(CASE WHEN note_level IS NULL THEN 3 ELSE 4 END) FILTER (NOT legacy), 0)::BIGINT AS n_postings
  FROM judged GROUP BY ALL)
SELECT machine_id, version_id, violations, CASE WHEN violations = '' THEN n_chunks ELSE 0 END AS n_chunks,
  CASE WHEN violations = '' THEN n_postings ELSE 0 END AS n_postings,
  violations = '' AND file_no = coalesce(max(CASE WHEN violations = '' AND file_no % 2 = 0 THEN file_no END) OVER w,
    max(CASE WHEN violations = '' THEN file_no END) OVER w) AS is_active
FROM loads WINDOW w AS (PARTITION BY machine_id)""",
    CODE_SQL + VIOLATION_SQL,
)
def version_loads(spark, sf_dir):
    """All versions loaded, those with an even number later than the others, each in order; what readers then see of them."""
    path, rows = scratch_path(spark, "loads"), cut_lineage(_fragments(spark, sf_dir))
    number = F.regexp_extract("version_id", "[0-9]+", 0).cast("int")
    verdicts = [load_versions(rows.filter(number % 2 == 1 - step), path, f"2024-01-0{step + 1} 00:00:00") for step in range(2)]
    every = verdicts[0].unionByName(verdicts[1]).select(*INDEX_KEY, F.array_join("violations", "; ").alias("violations"))
    counts = [loaded(spark, path, t).groupBy(*INDEX_KEY).agg(F.count(F.lit(1)).alias(n)) for t, n in (("chunks", "n_chunks"), ("postings", "n_postings"))]
    stamped = events(spark, path).withColumn("ts", F.col("ts") + F.make_dt_interval(secs=number.cast("decimal(18,6)")))
    active = active_versions(stamped).withColumn("is_active", F.lit(True))
    for part in (*counts, active):
        every = every.join(part, list(INDEX_KEY), "left")
    return every.fillna(0, ["n_chunks", "n_postings"]).fillna(False, ["is_active"])


@query(
    """
, loads AS (
  SELECT machine_id, version_id, file_no, violations, count(*) FILTER (NOT legacy) AS n_chunks,
    coalesce(sum(CASE WHEN note_level IS NULL THEN 3 ELSE 4 END) FILTER (NOT legacy), 0)::BIGINT AS n_postings,
    CAST(substr(machine_id, 7) AS INT) % 5 = 2 AS machine_gone
  FROM judged GROUP BY ALL)
SELECT machine_id, version_id, n_chunks, n_postings FROM loads
WHERE violations = '' AND NOT machine_gone AND (file_no % 3 <> 1 OR file_no % 2 = 0)""",
    CODE_SQL + VIOLATION_SQL,
)
def deletions_cascade(spark, sf_dir):
    """Machines deleted with their versions and index rows, single versions too, some of these loaded again; then compacted."""
    path, rows = scratch_path(spark, "loads"), cut_lineage(_fragments(spark, sf_dir))
    number = F.regexp_extract("version_id", "[0-9]+", 0).cast("int")
    brand = F.substring("machine_id", 7, 9).cast("int")
    load_versions(rows, path, "2024-01-01 00:00:00")
    versions = rows.select(*INDEX_KEY).distinct()
    delete(spark, path, versions.filter(number % 3 == 1), "2024-01-02 00:00:00")
    load_versions(rows.filter((number % 3 == 1) & (number % 2 == 0)), path, "2024-01-03 00:00:00")
    machines = versions.filter(brand % 5 == 2).select("machine_id", F.lit(None).cast("string").alias("version_id"))
    delete(spark, path, machines, "2024-01-04 00:00:00")
    target = scratch_path(spark, "compacted")
    alive = compact(spark, path, target, "2024-01-05 00:00:00").select(*INDEX_KEY)
    for t, n in (("chunks", "n_chunks"), ("postings", "n_postings")):
        alive = alive.join(loaded(spark, target, t).groupBy(*INDEX_KEY).agg(F.count(F.lit(1)).alias(n)), list(INDEX_KEY), "left")
    return alive.fillna(0, ["n_chunks", "n_postings"])


# --- index search: each file version asked for its part types and names -----------------------------

QUERY_SQL = """
, asks AS (
  SELECT machine_id, version_id, message, lower(message) AS norm, path, row_number() OVER () AS qid
  FROM (SELECT DISTINCT machine_id, version_id, path, unnest([p_type || ' note', p_type, p_name || ' docs handles']) AS message
    FROM parts)),
chunk AS (SELECT * FROM errs WHERE NOT legacy),
exact AS (
  SELECT qid, machine_id, version_id, message, original_message AS error_key, arg_min(function_name, fn_seq) AS first_fn
  FROM asks JOIN posts USING (machine_id, version_id) WHERE posts.error_key = norm GROUP BY ALL),
ks AS (SELECT DISTINCT machine_id, version_id, error_key FROM posts),
sim AS (
  SELECT qid, machine_id, version_id, message, norm, error_key,
    0.6 * len(list_intersect(string_split(norm, ' '), string_split(error_key, ' ')))
      / len(list_distinct(list_concat(string_split(norm, ' '), string_split(error_key, ' '))))
    + 0.4 * (1 - abs(length(norm) - length(error_key))::DOUBLE / greatest(length(norm), length(error_key))) AS score
  FROM asks JOIN ks USING (machine_id, version_id)
  WHERE contains(error_key, norm) AND NOT EXISTS (FROM exact x WHERE x.qid = asks.qid AND x.error_key = ks.error_key)),
top AS (SELECT * FROM sim QUALIFY row_number() OVER (PARTITION BY qid ORDER BY score DESC, error_key) <= 25),
partial AS (
  SELECT qid, machine_id, version_id, message, norm, error_key, score, count(*) AS n_chunks, arg_min(function_name, fn_seq * 10 + error_pos) AS first_fn
  FROM top JOIN posts USING (machine_id, version_id, error_key) GROUP BY ALL),
shown AS (
  SELECT p.*, code, greatest(strpos(lower(code), lower(p.message)), 0) AS at_phrase,
    string_split(norm, ' ')[1] AS token
  FROM partial p JOIN chunk c ON c.machine_id = p.machine_id AND c.version_id = p.version_id AND c.function_name = p.first_fn),
spot AS (
  SELECT *, CASE WHEN at_phrase > 0 THEN at_phrase ELSE strpos(lower(code), token) END AS p,
    CASE WHEN at_phrase > 0 THEN length(message) ELSE length(token) END AS w FROM shown),
cut AS (
  SELECT *, CASE WHEN p = 0 THEN '' ELSE trim(CASE WHEN p > 101 THEN '...' ELSE '' END
    || substr(code, greatest(p - 100, 1), least(p - 1 + w + 100, length(code)) - greatest(p - 100, 1) + 1)
    || CASE WHEN p - 1 + w + 100 < length(code) THEN '...' ELSE '' END, chr(9) || chr(10) || ' ') END AS excerpt
  FROM spot),
asked AS (
  SELECT *, list_filter(string_split(norm, ' '), lambda t: length(t) > 2) AS toks FROM asks
  WHERE qid NOT IN (SELECT qid FROM exact) AND qid NOT IN (SELECT qid FROM partial)),
scored AS (
  SELECT qid, a.machine_id, a.version_id, a.path, a.message, function_name, k, toks, norm,
    list_transform([lower(p_name || ' failed for %s'), lower(p_type || ' size ' || p_size), lower('error in ' || p_brand),
      CASE WHEN note_level IS NULL THEN '' ELSE lower(p_type || ' note') END, lower(code),
      lower(docstring || ' ' || CASE WHEN p_size % 2 = 0 THEN comment1 || chr(10) || comment2 ELSE '' END)],
      lambda tx: CASE WHEN tx <> '' AND contains(tx, norm) THEN 1.0
        WHEN len(list_filter(toks, lambda t: contains(tx, t)))::DOUBLE / len(toks) < 0.5 THEN 0.0
        ELSE 0.6 * len(list_filter(toks, lambda t: contains(tx, t)))::DOUBLE / len(toks)
          + 0.4 * len(list_filter(range(1, len(toks)), lambda i: strpos(tx, toks[i]) > 0
              AND strpos(substr(tx, strpos(tx, toks[i])), toks[i + 1]) > 1))::DOUBLE / (len(toks) - 1) END) AS s
  FROM asked a JOIN chunk c ON c.machine_id = a.machine_id AND c.version_id = a.version_id WHERE len(toks) >= 2),
final AS (
  SELECT *, CASE WHEN list_max(s[1:4]) > 0 THEN list_max(s[1:4]) WHEN s[5] > 0 THEN s[5] * 0.8 ELSE s[6] * 0.5 END AS score FROM scored),
results AS (
  SELECT qid, machine_id, version_id, message, 'exact' AS match_type, error_key, 1.0::DOUBLE AS score, 1 AS n_chunks, error_key AS matched_text FROM exact
  UNION ALL
  SELECT qid, machine_id, version_id, message, 'partial', error_key, round(score, 6), n_chunks,
    CASE WHEN length(excerpt) > length(error_key) THEN excerpt ELSE error_key END FROM cut
  UNION ALL
  SELECT qid, machine_id, version_id, message, 'code_search', 'Code match in ' || path, round(max(score), 6), least(count(*), 25), NULL
  FROM final WHERE score >= 0.3 GROUP BY ALL)
"""


def _asks(spark, sf_dir):
    files = table(spark, sf_dir, "part").select(
        F.col("p_brand").alias("machine_id"),
        F.concat(F.lit("v"), F.floor(F.col("p_partkey") / 400).cast("int").cast("string")).alias("version_id"),
        F.explode(
            F.array(
                F.concat("p_type", F.lit(" note")),
                F.col("p_type"),
                F.concat("p_name", F.lit(" docs handles")),
            )
        ).alias("message"),
    )
    return files.distinct().withColumn("query_id", F.concat_ws("|", "machine_id", "version_id", "message"))


def _search(spark, sf_dir):
    chunks, postings = chunk_index(spark, sf_dir)
    return S.search_index(_asks(spark, sf_dir), postings, chunks)


def _result(*more):
    return ["machine_id", "version_id", F.element_at(F.split("query_id", r"\|"), 3).alias("message"), *more]


@query("SELECT machine_id, version_id, message, error_key, n_chunks, first_fn FROM (SELECT *, 1 AS n_chunks FROM exact)", CODE_SQL + QUERY_SQL)
def index_exact(spark, sf_dir):
    chunks, postings = chunk_index(spark, sf_dir)
    asks = S.prepare_queries(_asks(spark, sf_dir))
    groups = S.exact_groups(asks, postings, chunks)
    names = chunks.select(*INDEX_KEY, F.col("chunk_id").alias("first_chunk_id"), F.col("function_name").alias("first_fn"))
    return groups.join(names, [*INDEX_KEY, "first_chunk_id"]).select(*_result("error_key"), "n_chunks", "first_fn")


@query("SELECT machine_id, version_id, message, error_key, score, n_chunks, matched_text FROM results WHERE match_type = 'partial'", CODE_SQL + QUERY_SQL)
def index_partial(spark, sf_dir):
    chunks, postings = chunk_index(spark, sf_dir)
    asks = S.prepare_queries(_asks(spark, sf_dir))
    words = build_words(postings, chunks)
    groups = S.partial_groups(asks, postings, chunks, words, S.exact_groups(asks, postings, chunks))
    return groups.select(*_result("error_key"), F.round("score", 6).alias("score"), "n_chunks", "matched_text")


@query("SELECT machine_id, version_id, message, error_key, score, n_chunks FROM results WHERE match_type = 'code_search'", CODE_SQL + QUERY_SQL)
def index_code_search(spark, sf_dir):
    found = _search(spark, sf_dir).filter("match_type = 'code_search'")
    return found.select(*_result("error_key"), F.round("score", 6).alias("score"), "n_chunks")


@query(
    """
SELECT machine_id, version_id, message, count(*) FILTER (match_type = 'exact') AS exact_matches,
  count(*) FILTER (match_type = 'partial') AS partial_matches, count(*) FILTER (match_type = 'code_search') AS code_search_matches,
  count(*) AS total_matches FROM results GROUP BY ALL""",
    CODE_SQL + QUERY_SQL,
)
def index_match_counts(spark, sf_dir):
    counts = S.match_type_counts(_search(spark, sf_dir), ("query_id", "machine_id", "version_id"))
    return counts.select(*_result(), "exact_matches", "partial_matches", "code_search_matches", "total_matches")


@query(
    """
SELECT machine_id, version_id, message, 'exact' AS match_type, error_key, 1 AS place, first_fn AS function_name FROM exact
UNION ALL
SELECT t.machine_id, t.version_id, message, 'partial', t.error_key, row_number() OVER (PARTITION BY qid, t.error_key ORDER BY fn_seq, error_pos), function_name
FROM top t JOIN posts p ON p.machine_id = t.machine_id AND p.version_id = t.version_id AND p.error_key = t.error_key
UNION ALL
SELECT machine_id, version_id, message, 'code_search', 'Code match in ' || path, NULL, function_name FROM final WHERE score >= 0.3""",
    CODE_SQL + QUERY_SQL,
)
def index_group_chunks(spark, sf_dir):
    """All chunks of all groups found; places of content matches have ties that names do not tell, so they are left out here."""
    chunks, postings = chunk_index(spark, sf_dir)
    words, asks = build_words(postings, chunks), _asks(spark, sf_dir)
    members = S.group_chunks(S.search_index(asks, postings, chunks, words), asks, postings, chunks, words)
    names = chunks.select(*INDEX_KEY, "chunk_id", "function_name")
    place = F.when(F.col("match_type") != "code_search", F.col("place"))
    return members.join(names, [*INDEX_KEY, "chunk_id"]).select(*_result("match_type", "error_key"), place.alias("place"), "function_name")


@query(
    """
, newest AS (SELECT machine_id, 'v' || max(file_no) AS version_id FROM parts WHERE NOT legacy AND file_no % 7 <> 3 GROUP BY machine_id)
SELECT machine_id, version_id, message, match_type, error_key, score, n_chunks
FROM results WHERE (machine_id, version_id) IN (SELECT (machine_id, version_id) FROM newest)""",
    CODE_SQL + QUERY_SQL,
)
def active_index_search(spark, sf_dir):
    """The search over each machine's active version: versions uploaded in file order, every seventh deleted."""
    chunks, postings = chunk_index(spark, sf_dir)
    number = F.regexp_replace("version_id", "v", "").cast("int")
    stamp = lambda plus: F.timestamp_seconds(number * 100 + plus)
    versions = chunks.select("machine_id", "version_id").distinct()
    steps = F.array(
        F.struct(F.lit("upload").alias("op"), stamp(0).alias("ts")),
        F.when(number % 7 == 3, F.struct(F.lit("delete").alias("op"), stamp(50).alias("ts"))),
    )
    events = versions.select("machine_id", "version_id", F.explode(steps).alias("e")).filter("e is not null").select(
        "machine_id", "version_id", "e.op", "e.ts"
    )
    active = active_versions(events)
    asks = _asks(spark, sf_dir).join(active, ["machine_id", "version_id"], "left_semi").drop("version_id")
    found = S.search_active(asks, active, postings, chunks)
    return found.select(*_result("error_key"), "match_type", F.round("score", 6).alias("score"), "n_chunks")
