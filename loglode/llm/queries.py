"""The check queries of the llm operators and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loglode.llm.byte_bpe import decode, encode, read_ranks
from loglode.llm.conversation_repair import repair_conversations
from loglode.llm.decontaminate import leaks
from loglode.llm.hard_negatives import hard_negatives
from loglode.llm.html_text import main_text
from loglode.llm.language_id import held_out, languages, learn
from loglode.llm.licenses import licence_paragraphs
from loglode.llm.near_dedup import near_duplicates
from loglode.llm.quality import quality_verdicts
from loglode.llm.sharding import shard_by_bytes
from loglode.llm.substring_dedup import substring_dedup
from loglode.llm.token_counts import token_counts, zipf_scores
from loglode.llm.url_filter import filter_urls

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL twin where there is one."""

    def add(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[fn.__name__] = fn
        if sql:
            SQL[fn.__name__] = sql.strip()
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


OP1_SQL = r"""
WITH w AS (
  SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS p FROM (
    SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents)
), g AS (
  SELECT doc_id, p, string_agg(w, ' ') OVER win AS g, count(*) OVER win AS k FROM w
  WINDOW win AS (PARTITION BY doc_id ORDER BY p ROWS BETWEEN CURRENT ROW AND 12 FOLLOWING)
), f AS (SELECT doc_id, p, min(doc_id) OVER (PARTITION BY g) AS first FROM g WHERE k = 13),
c AS (
  SELECT w.doc_id, w.p, w.w, coalesce(max(f.p) OVER (PARTITION BY w.doc_id ORDER BY w.p ROWS BETWEEN 12 PRECEDING AND CURRENT ROW), -1) >= 0 AS gone
  FROM w LEFT JOIN f ON f.doc_id = w.doc_id AND f.p = w.p AND f.first < w.doc_id
), s AS (
  SELECT doc_id, count(*) AS n_words, count(*) FILTER (WHERE gone) AS n_removed,
    sha256(coalesce(string_agg(w, ' ' ORDER BY p) FILTER (WHERE NOT gone), '')) AS kept_sha256 FROM c GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, coalesce(kept_sha256, sha256('')) AS kept_sha256
FROM documents d LEFT JOIN s USING (doc_id)
"""


@query(OP1_SQL)
def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of 13 words and more that repeat from earlier documents, removed from all documents."""
    found = substring_dedup(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", "kept_sha256")


OP8_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
w AS (
  SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS p FROM (
    SELECT doc_id, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM d)
), g AS (
  SELECT doc_id, p, string_agg(w, ' ') OVER win AS g, count(*) OVER win AS k FROM w
  WINDOW win AS (PARTITION BY doc_id ORDER BY p ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING)
), r AS (SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, g) > 1 AS twice FROM g WHERE k = 5),
c AS (
  SELECT w.doc_id, w.w, coalesce(bool_or(r.twice) OVER (PARTITION BY w.doc_id ORDER BY w.p ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), false) AS rep
  FROM w LEFT JOIN r USING (doc_id, p)
), n AS (SELECT doc_id, count(*) AS n_words, sum(length(w)) AS word_chars, count(*) FILTER (WHERE rep) AS n_repeat_words FROM c GROUP BY doc_id),
l AS (
  SELECT doc_id, len(ls) AS n_lines, len(ls) - len(list_distinct(ls)) AS n_dup_lines FROM (
    SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d)
), m AS (
  SELECT d.doc_id, lang, source, coalesce(n_words, 0)::BIGINT AS n_words, coalesce(word_chars, 0)::BIGINT AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
    coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, n_lines::BIGINT AS n_lines
  FROM d LEFT JOIN n USING (doc_id) LEFT JOIN l USING (doc_id)
), b AS (
  SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, 1000 * n_symbols // n_words AS symbols,
    1000 * n_dup_lines // greatest(n_lines, 1) AS dup_lines, 100 * word_chars // n_words AS word_length FROM m
), v AS (
  SELECT lang, source, metric, v - v % (1::BIGINT << greatest(length(bin(v)) - 7, 0)::INT) AS bucket FROM (
    SELECT lang, source, unnest(['symbols', 'dup_lines', 'word_length']) AS metric, unnest([symbols, dup_lines, word_length]) AS v
    FROM b WHERE NOT base_failed)
), s AS (
  SELECT 'own' AS lvl, lang, source, metric, bucket, count(*) AS n FROM v GROUP BY ALL
  UNION ALL SELECT 'lang', lang, '', metric, bucket, count(*) FROM v GROUP BY ALL
  UNION ALL SELECT 'all', '', '', metric, bucket, count(*) FROM v GROUP BY ALL
), u AS (
  SELECT *, sum(n) OVER (PARTITION BY lvl, lang, source, metric ORDER BY bucket) AS upto, sum(n) OVER (PARTITION BY lvl, lang, source, metric) AS total FROM s
), q AS (
  SELECT lvl, lang, source, metric, max(total) AS total, min(bucket) FILTER (WHERE 4 * upto >= total) AS q1,
    min(bucket) FILTER (WHERE 4 * upto >= 2 * total) AS q2, min(bucket) FILTER (WHERE 4 * upto >= 3 * total) AS q3
  FROM u GROUP BY ALL
), t AS (
  SELECT lvl, lang, source, max(total) AS total,
    max(q2 + greatest(3 * (q3 - q1), 100)) FILTER (WHERE metric = 'symbols') AS symbols_most,
    max(q2 + greatest(3 * (q3 - q1), 400)) FILTER (WHERE metric = 'dup_lines') AS dup_most,
    max(q2 + greatest(3 * (q3 - q1), 250)) FILTER (WHERE metric = 'word_length') AS len_most,
    max(q2 - greatest(3 * (q3 - q1), 250)) FILTER (WHERE metric = 'word_length') AS len_least
  FROM q GROUP BY ALL
), f AS (
  SELECT b.*, CASE WHEN o.total >= 100 THEN 'own' WHEN g.total >= 100 THEN 'lang' ELSE 'all' END AS pick
  FROM b LEFT JOIN t o ON o.lvl = 'own' AND o.lang = b.lang AND o.source = b.source LEFT JOIN t g ON g.lvl = 'lang' AND g.lang = b.lang
)
SELECT f.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND symbols <= symbols_most AND dup_lines <= dup_most AND word_length BETWEEN len_least AND len_most AS kept
FROM f LEFT JOIN t ON t.lvl = pick AND t.lang = CASE WHEN pick = 'all' THEN '' ELSE f.lang END
  AND t.source = CASE WHEN pick = 'own' THEN f.source ELSE '' END
"""


@query()
def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document and the bytes they decode to, as digests."""
    ranks = read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    both = decode(encode(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN), ranks)
    return both.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@query()
def op3_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every licence paragraph of the documents and its family."""
    return licence_paragraphs(table(spark, sf_dir, "documents"))


@query()
def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 16 shards of near equal bytes."""
    return shard_by_bytes(table(spark, sf_dir, "documents"))


#: The rules of the check: host, path, verdict.
URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
OP5_SQL = r"""
WITH p AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), u AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM p
), r(h, p, v) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
m AS (
  SELECT u.*, h || p AS rule, v, row_number() OVER (PARTITION BY page_id, host, path ORDER BY length(h || p) DESC NULLS LAST) AS k
  FROM u LEFT JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)
)
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM m WHERE k = 1
"""


@query(OP5_SQL)
def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rule and verdict of every page's url."""
    rules = spark.sql("SELECT * FROM VALUES " + ", ".join(map(str, URL_RULES)) + " AS r(host, path, verdict)")
    return filter_urls(table(spark, sf_dir, "pages"), rules)


@query()
def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unigram token counts of every document."""
    scores = zipf_scores(read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")))
    return token_counts(table(spark, sf_dir, "documents"), scores, public_tokenizers.PATTERN)


@query()
def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return main_text(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


@query(OP8_SQL)
def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality counts and verdict of every document."""
    return quality_verdicts(table(spark, sf_dir, "documents"))


@query()
def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document that holds a benchmark item, with the item and the number of edits."""
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query()
def op10_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SuperMinHash near-duplicate groups over all documents."""
    return near_duplicates(table(spark, sf_dir, "documents"))


def _edit(p: str, cost: int | str, letter: str, line: str = "''") -> str:
    """SQL: a state `cost, audit, chr(1), lines` with one more edit in front, and the line that edit leaves."""
    return f"(lpad((left({p}, 10)::INT + {cost})::VARCHAR, 10, '0') || '{letter}' || substr({p}, 11, instr({p}, chr(1)) - 10) || {line} || substr({p}, instr({p}, chr(1)) + 1))"


#: Grammar states: 0 nothing yet, 1 behind s, 2 behind u, 3 behind a; the state behind the next user or assistant.
_ON = {0: 2, 1: 2, 2: 3, 3: 2}
_ROLE = {2: "user", 3: "assistant"}


def _own_edits(state: int) -> str:
    on = _ON[state]
    keeps = [("u" if on == 2 else "a", on)] + [("s", 1)] * (state == 0)
    ways = [_edit(f"p{state}", 2, "D")]
    ways += [f"CASE WHEN fault < 2 THEN {_edit(f'p{on}', '(1 + 5 * fault)', 'R', f"'{_ROLE[on]}:' || text || chr(10)")} END"]
    ways += [f"CASE WHEN fault < 2 AND left(role, 1) = '{c}' THEN {_edit(f'p{to}', '5 * fault', 'K', "role || ':' || text || chr(10)")} END" for c, to in keeps]
    return f"least({', '.join(ways)})"


def _inserted(state: int) -> str:
    on = _ON[state]
    return _edit(f"b{on}", 5, "I", f"'{_ROLE[on]}:' || chr(10)")


OP11_SQL = rf"""
WITH RECURSIVE c AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''),
      lambda x: ascii(x)::BIGINT)), lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), range(8)),
      lambda v, i: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END))) % 20 AS h
  FROM conversations
), d AS (
  SELECT conv_id, turn, CASE WHEN h = 4 THEN 'user' ELSE role END AS role,
    CASE h WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(CASE WHEN h = 3 THEN [1, 2] ELSE [1] END) AS copy
  FROM c WHERE h > 0
), o AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text), copy) AS k, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS ends FROM d
), r AS (
  SELECT *, CASE WHEN ends = '' THEN 2 WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY k) > 1 THEN 3
    WHEN right(ends, 1) IN ('.', '!', '?') THEN 0 ELSE 1 END AS fault,
    coalesce(left(lag(role) OVER (PARTITION BY conv_id ORDER BY k), 1) || left(role, 1) NOT IN ('su', 'ua', 'au'), false) AS illegal
  FROM o
), s AS (
  SELECT conv_id, max(k) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 2) AS blank,
    count(*) FILTER (WHERE fault = 3) AS duplicate, count(*) FILTER (WHERE fault = 1) AS truncated, count(*) FILTER (WHERE illegal) AS illegal
  FROM r GROUP BY conv_id
), dp(conv_id, k, p0, p1, p2, p3) AS (
  SELECT conv_id, n, '0000000000' || chr(1), '0000000010II' || chr(1) || 'user:' || chr(10) || 'assistant:' || chr(10),
    '0000000005I' || chr(1) || 'assistant:' || chr(10), '0000000000' || chr(1) FROM s
  UNION ALL
  SELECT conv_id, k, least(b0, {_inserted(0)}), least(b1, {_inserted(1)}), b2, b3 FROM (
    SELECT conv_id, k, b0, b1, least(b2, {_inserted(2)}) AS b2, least(b3, {_inserted(3)}) AS b3 FROM (
      SELECT conv_id, k - 1 AS k, {_own_edits(0)} AS b0, {_own_edits(1)} AS b1, {_own_edits(2)} AS b2, {_own_edits(3)} AS b3
      FROM (SELECT dp.*, r.role, r.text, r.fault FROM dp JOIN r ON r.conv_id IS NOT DISTINCT FROM dp.conv_id AND r.k = dp.k)))
), e AS (SELECT conv_id, left(p0, 10)::BIGINT AS cost, substr(p0, 11, instr(p0, chr(1)) - 11) AS audit, substr(p0, instr(p0, chr(1)) + 1) AS lines FROM dp WHERE k = 0)
SELECT a.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  coalesce(illegal, 0) AS illegal, coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit, sha256(coalesce(left(lines, length(lines) - 1), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) AS a LEFT JOIN s ON s.conv_id IS NOT DISTINCT FROM a.conv_id
LEFT JOIN e ON e.conv_id IS NOT DISTINCT FROM a.conv_id
"""


def damaged(rows: DataFrame) -> DataFrame:
    """Conversations with known faults: `copies` says how often a row is left in its place."""
    own = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    h = F.crc32(F.concat(own("conv_id"), F.lit(":"), own("turn")).cast("binary")) % 20
    text = F.when(h == 1, "").when(h == 2, F.translate(own("text"), ".!?", "")).otherwise(own("text"))
    role = F.when(h == 4, "user").otherwise(own("role"))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.when(h == 0, 0).when(h == 3, 2).otherwise(1).alias("copies"))


@query(OP11_SQL)
def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults and cheapest repair of every conversation, after known damage."""
    return repair_conversations(damaged(table(spark, sf_dir, "conversations")), F.col("copies"))


OP12_SQL = """
WITH r AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, a.label = r.label AS same, r.vec_id, list_inner_product(a.v, r.v)::BIGINT AS score
  FROM r AS a JOIN r ON a.vec_id % 100 = 0 AND a.vec_id <> r.vec_id
), p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT anchor_id, positive_id, (row_number() OVER w)::INT AS rank, s.vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id)
WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, s.vec_id)
QUALIFY row_number() OVER w <= 10
"""


@query(OP12_SQL)
def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every hundredth vector, with every seventh label wrong."""
    rows = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(rows.select("vec_id", label.alias("label"), "embedding"), F.col("vec_id") % 100 == 0)


@query()
def op13_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from four fifths of them."""
    docs, out = table(spark, sf_dir, "documents"), held_out(F.col("doc_id"))
    found = languages(docs, learn(docs.where(~out)))
    return found.select("doc_id", out.alias("held_out"), "lang_pred", "score", "n_words")


@query(corpus_pipeline.ORACLE_SQL)
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus pipeline over all documents."""
    return corpus_pipeline.run(spark, sf_dir)
