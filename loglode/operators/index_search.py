"""Ranked search of many queries over chunk indexes of many machines."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loglode.functions.logparse import normalize_query
from loglode.functions.scoring import (
    PHRASE_MIN_RATIO,
    key_similarity,
    match_excerpt,
    phrase_score,
    significant_tokens,
)
from loglode.functions.text import settle, shorten
from loglode.functions.text import words as words_of
from loglode.operators.word_index import CHUNK, KEY, WordIndex, build_words, places_of, rarest_tokens
from loglode.plans.bounds import shuffled
from loglode.session import stored


class Limits(NamedTuple):
    """Results kept per query; None keeps all. keys is also the number of exact groups from which no partial ones are asked for."""

    keys: int | None = 25
    chunks: int | None = 25
    files: int | None = 10


# Weights, thresholds, names.
CODE_WEIGHT = 0.8
DOC_WEIGHT = 0.5
MIN_CODE_SCORE = 0.3
SNIPPET = 150
FILE_LABEL = "Code match in "

INDEX = ("machine_id", "version_id")
POSTING_ORDER = ("path", "fn_seq", "error_pos")
GROUP_COLUMNS = ["query_id", "match_type", "error_key", "score", "matched_text", "n_chunks"]


def prepare_queries(queries: DataFrame, message: str = "message") -> DataFrame:
    """Queries with their normalised form and significant tokens; empty ones find nothing."""
    norm = queries.filter(F.length(message) > 0).withColumn("norm", normalize_query(F.col(message)))
    return shuffled(settle(norm.withColumn("sig", significant_tokens(F.col("norm"))), "norm", "sig"))


def _order() -> Column:
    return F.struct(*POSTING_ORDER)


def _known(postings: DataFrame, chunks: DataFrame, index: Sequence[str]) -> DataFrame:
    """Postings whose chunk exists."""
    return postings.join(shuffled(chunks.select(*index, "chunk_id")), [*index, "chunk_id"], "left_semi")


def exact_groups(queries: DataFrame, postings: DataFrame, chunks: DataFrame, index: Sequence[str] = INDEX) -> DataFrame:
    """One group per distinct original message under the query's key, with its first chunk."""
    wanted = queries.select("query_id", *index, F.col("norm").alias("error_key"))
    hits = _known(shuffled(postings).join(wanted, [*index, "error_key"]), chunks, index)
    first = F.min(F.struct(_order().alias("o"), F.col("chunk_id"))).getField("chunk_id")
    return hits.groupBy("query_id", *index, "original_message").agg(first.alias("chunk_id")).select(
        "query_id",
        *index,
        F.lit("exact").alias("match_type"),
        F.col("original_message").alias("error_key"),
        F.lit(1.0).alias("score"),
        F.col("original_message").alias("matched_text"),
        F.lit(1).cast("bigint").alias("n_chunks"),
        F.col("chunk_id").alias("first_chunk_id"),
    )


def partial_keys(
    queries: DataFrame,
    found: WordIndex,
    exact: DataFrame,
    index: Sequence[str] = INDEX,
    repeat_mixed_case: bool = True,
    limits: Limits = Limits(),
) -> DataFrame:
    """Keys per query that contain it, closest first.

    A key that contains the query holds each of the query's words within one of its own;
    the query's rarest word, by the frequencies of the word index, names the keys to
    look at. Only asked while fewer exact groups exist than the limit of keys. A key is
    left out when an exact group already shows it letter for letter; with
    ``repeat_mixed_case`` off, also when they differ in case.
    """
    open_queries = queries.select("query_id", *index, "norm")
    if limits.keys is not None:
        by_query = exact.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
        full = by_query.filter(F.col("n") >= limits.keys).select("query_id")
        open_queries = shuffled(open_queries.join(full, "query_id", "left_anti"))
    tokens = open_queries.select("query_id", *index, F.posexplode(F.array_distinct(words_of(F.col("norm")))).alias("token_pos", "token"))
    picked = rarest_tokens(tokens, found, KEY, F.lit(1), index).filter("absent = 0")
    keys = places_of(picked, found, KEY, index).withColumnRenamed("id", "error_key")
    pairs = keys.join(open_queries, ["query_id", *index]).filter(F.contains("error_key", F.col("norm")))
    shown = F.col("error_key") if repeat_mixed_case else F.lower("error_key")
    seen = exact.select("query_id", shown.alias("error_key")).distinct()
    pairs = pairs.join(seen, ["query_id", "error_key"], "left_anti")
    scored = pairs.withColumn("score", key_similarity(F.col("norm"), F.col("error_key")))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "error_key")
    ranked_keys = scored.withColumn("rank", F.row_number().over(best))
    return ranked_keys if limits.keys is None else ranked_keys.filter(F.col("rank") <= limits.keys)


def partial_groups(
    queries: DataFrame,
    postings: DataFrame,
    chunks: DataFrame,
    found: WordIndex,
    exact: DataFrame,
    index: Sequence[str] = INDEX,
    repeat_mixed_case: bool = True,
    limits: Limits = Limits(),
) -> DataFrame:
    top = partial_keys(queries, found, exact, index, repeat_mixed_case, limits)
    return _with_excerpt(_key_groups(top, postings, chunks, index), queries, chunks, index)


def _key_groups(top: DataFrame, postings: DataFrame, chunks: DataFrame, index: Sequence[str]) -> DataFrame:
    """(query_id, *index, error_key, score, n_chunks, first_chunk_id): the keys found, with how many chunks hold each and which is first."""
    asked = top.select("query_id", *index, "error_key", "score")
    members = _known(shuffled(postings), chunks, index).groupBy(*index, "error_key").agg(
        F.count(F.lit(1)).alias("n_chunks"), F.min(F.struct(_order().alias("o"), F.col("chunk_id"))).getField("chunk_id").alias("first_chunk_id")
    )
    return shuffled(members).join(asked, [*index, "error_key"]).select("query_id", *index, "error_key", "score", "n_chunks", "first_chunk_id")


def _with_excerpt(groups: DataFrame, queries: DataFrame, chunks: DataFrame, index: Sequence[str]) -> DataFrame:
    """Groups of partial matches as results; the code of their first chunks is fetched here and goes no further."""
    said = shuffled(groups).join(queries.select("query_id", "message", "sig"), "query_id")
    code = shuffled(chunks.select(*index, F.col("chunk_id").alias("first_chunk_id"), "code"))
    shown = shuffled(settle(said, "message", "sig")).join(code, [*index, "first_chunk_id"])
    shown = shown.withColumn("excerpt", match_excerpt(F.col("message"), F.col("sig"), F.col("code")))
    excerpt = F.col("excerpt")
    longer = F.length(excerpt) > F.length("error_key")
    return shown.select(
        "query_id",
        *index,
        F.lit("partial").alias("match_type"),
        "error_key",
        "score",
        F.when(longer, excerpt).otherwise(F.col("error_key")).alias("matched_text"),
        "n_chunks",
        "first_chunk_id",
    )


def code_candidates(queries: DataFrame, found: WordIndex, index: Sequence[str] = INDEX) -> DataFrame:
    """(query, chunk) pairs that can reach a score.

    A score needs at least half of the n significant tokens, so at least one of any
    n - ceil(n/2) + 1 of them must occur. The ones with the fewest chunks, by the
    frequencies of the word index, are looked up; common words never are.
    """
    size = F.size("sig")
    # A token said twice counts twice for the share, so the plain rule is on all n of them.
    needed = size - F.ceil(size * PHRASE_MIN_RATIO) + 1
    tokens = queries.select("query_id", *index, needed.alias("needed"), F.posexplode(F.array_distinct("sig")).alias("token_pos", "token"))
    picked = rarest_tokens(tokens, found, CHUNK, F.col("needed"), index)
    return places_of(picked, found, CHUNK, index).withColumnRenamed("id", "chunk_id")


def with_chunk_score(rows: DataFrame) -> DataFrame:
    """Best message score, else weighted code score, else weighted comment score."""
    norm, sig, c = F.col("norm"), F.col("sig"), F.col
    messages = F.filter(F.transform("error_messages", lambda e: F.lower(e["message"])), lambda m: m != "")
    texts = rows.withColumns(
        {
            "_messages": messages,
            "_code": F.lower(F.coalesce("code", F.lit(""))),
            "_notes": F.lower(F.concat(F.coalesce("docstring", F.lit("")), F.lit(" "), F.coalesce("leading_comment", F.lit("")))),
        }
    )
    scores = texts.withColumns(
        {
            "_of_messages": F.coalesce(F.array_max(F.transform("_messages", lambda m: phrase_score(norm, sig, m))), F.lit(0.0)),
            "_of_code": phrase_score(norm, sig, c("_code")),
            "_of_notes": phrase_score(norm, sig, c("_notes")),
        }
    )
    score = (
        F.when(c("_of_messages") > 0, c("_of_messages"))
        .when(c("_of_code") > 0, c("_of_code") * CODE_WEIGHT)
        .when(c("_of_notes") > 0, c("_of_notes") * DOC_WEIGHT)
        .otherwise(0.0)
    )
    scored = scores.withColumn("score", score)
    return settle(scored.drop("_messages", "_code", "_notes", "_of_messages", "_of_code", "_of_notes"), "score")


def code_chunks(
    queries: DataFrame, chunks: DataFrame, found: WordIndex, index: Sequence[str] = INDEX, limits: Limits = Limits()
) -> DataFrame:
    """Top chunks per query by content, of the top files by their best chunk: ids, path, score and ranks."""
    asked = shuffled(queries.filter(F.size("sig") >= 2))
    pairs = shuffled(code_candidates(asked, found, index)).join(asked.select("query_id", "norm", "sig"), "query_id")
    rows = shuffled(settle(pairs, "norm", "sig")).join(shuffled(chunks), [*index, "chunk_id"])
    # Texts end here: pairs go on with their score only.
    scored = with_chunk_score(rows).filter(F.col("score") >= MIN_CODE_SCORE).select("query_id", *index, "path", "chunk_id", "score")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")
    top = scored.withColumn("chunk_rank", F.row_number().over(best))
    if limits.chunks is not None:
        top = top.filter(F.col("chunk_rank") <= limits.chunks)
    in_file = Window.partitionBy("query_id", "path")
    top = top.withColumn("file_score", F.max("score").over(in_file))
    file_order = Window.partitionBy("query_id").orderBy(F.desc("file_score"), "path")
    top = top.withColumn("file_rank", F.dense_rank().over(file_order))
    return top if limits.files is None else top.filter(F.col("file_rank") <= limits.files)


def code_groups(
    queries: DataFrame, chunks: DataFrame, found: WordIndex, index: Sequence[str] = INDEX, limits: Limits = Limits()
) -> DataFrame:
    """Content matches grouped by file, with the ids of their chunks, best first; only the texts of the first ones are fetched."""
    top = code_chunks(queries, chunks, found, index, limits)
    ranked_ids = F.array_sort(F.collect_list(F.struct("chunk_rank", "chunk_id")))
    groups = top.groupBy("query_id", *index, "path").agg(
        F.max("score").alias("score"),
        F.count(F.lit(1)).alias("n_chunks"),
        F.transform(ranked_ids, lambda x: x["chunk_id"]).alias("chunk_ids"),
    )
    groups = groups.withColumn("first_chunk_id", F.get("chunk_ids", 0))
    said = shuffled(groups).join(queries.select("query_id", "message", "norm", "sig"), "query_id")
    texts = shuffled(chunks.select(*index, F.col("chunk_id").alias("first_chunk_id"), "code", "error_messages"))
    shown = shuffled(settle(said, "message", "norm", "sig")).join(texts, [*index, "first_chunk_id"])
    norm = F.col("norm")
    hit = F.filter("error_messages", lambda e: F.contains(F.lower(e["message"]), norm))
    said = F.get(hit, 0)["message"]
    shown = shown.withColumn("excerpt", match_excerpt(F.col("message"), F.col("sig"), F.col("code")))
    excerpt = F.col("excerpt")
    text = F.coalesce(
        F.when(said != "", said), F.when(excerpt != "", excerpt), shorten(F.col("code"), SNIPPET), F.lit("")
    )
    return shown.select(
        "query_id",
        *index,
        F.lit("code_search").alias("match_type"),
        F.concat(F.lit(FILE_LABEL), "path").alias("error_key"),
        "score",
        text.alias("matched_text"),
        "n_chunks",
        "first_chunk_id",
        "chunk_ids",
    )


def search_index(
    queries: DataFrame,
    postings: DataFrame,
    chunks: DataFrame,
    found: WordIndex | None = None,
    index: Sequence[str] = INDEX,
    repeat_mixed_case: bool = True,
    limits: Limits = Limits(),
) -> DataFrame:
    """All three tiers for every query; content search only for queries without a hit.

    ``queries`` has ``query_id``, the index columns and ``message``. ``found`` is the
    stored word index of the chunks (built here where none is given). The groups of the
    first tiers are stored, since the later tiers ask for them again, partial ones without
    their excerpts: a reader of counts or of other tiers has none cut.
    """
    asked = prepare_queries(queries)
    words = build_words(postings, chunks, index) if found is None else found
    exact = shuffled(stored(exact_groups(asked, postings, chunks, index).drop("match_type")))
    top = partial_keys(asked, words, exact, index, repeat_mixed_case, limits)
    partial = shuffled(stored(_key_groups(top, postings, chunks, index)))
    answered = exact.select("query_id").union(partial.select("query_id")).distinct()
    unanswered = shuffled(stored(asked.join(shuffled(answered), "query_id", "left_anti")))
    exact = exact.withColumn("match_type", F.lit("exact"))
    content = code_groups(unanswered, chunks, words, index, limits)
    keyed = exact.unionByName(_with_excerpt(partial, asked, chunks, index))
    return keyed.unionByName(content, allowMissingColumns=True)


def group_chunks(
    results: DataFrame,
    queries: DataFrame,
    postings: DataFrame,
    chunks: DataFrame,
    found: WordIndex | None = None,
    index: Sequence[str] = INDEX,
    limits: Limits = Limits(),
) -> DataFrame:
    """Every chunk of the groups a search returned: (query_id, *index, match_type, error_key, place, chunk_id).

    An exact group holds its first chunk; a partial one the chunk of every posting, in
    their order, repeats kept; a content group the chunks found in its file, best first,
    as the search listed them, so no tier is asked again.
    """
    columns = ["query_id", *index, "match_type", "error_key"]
    first = results.filter("match_type = 'exact'").select(*columns, F.lit(1).alias("place"), F.col("first_chunk_id").alias("chunk_id"))
    partial = results.filter("match_type = 'partial'").select(*columns)
    # Places are those of the key, the same for every query that found it: ordered once, before the queries come in.
    of_key = Window.partitionBy(*index, "error_key").orderBy(*POSTING_ORDER)
    placed = _known(shuffled(postings), chunks, index).select(*index, "error_key", F.row_number().over(of_key).alias("place"), "chunk_id")
    posted = shuffled(placed).join(partial, [*index, "error_key"]).select(*columns, "place", "chunk_id")
    content = results.filter("match_type = 'code_search'")
    listed = content.select(*columns, F.posexplode("chunk_ids").alias("place", "chunk_id")).withColumn("place", F.col("place") + 1)
    return first.unionByName(posted).unionByName(listed)


def ranked(results: DataFrame) -> DataFrame:
    """Exact groups first, then by score; ties by key."""
    return results.orderBy("query_id", F.col("match_type") != "exact", F.desc("score"), "error_key")


def search_active(
    queries: DataFrame,
    active: DataFrame,
    postings: DataFrame,
    chunks: DataFrame,
    found: WordIndex | None = None,
    machine: str = "machine_id",
) -> DataFrame:
    """The search over each machine's active version; other versions are pruned by partition."""
    versions = active.select(machine, "version_id")
    only = lambda df: df.join(versions, [machine, "version_id"], "left_semi")
    words = None if found is None else WordIndex(*[only(t) for t in found])
    return search_index(queries.join(versions, machine), only(postings), only(chunks), words)


def match_type_counts(results: DataFrame, group: Sequence[str] = ("query_id",)) -> DataFrame:
    """Groups per match type and in total."""
    kinds = ("exact", "partial", "code_search")
    return results.groupBy(*group).agg(
        *[F.count_if(F.col("match_type") == k).alias(f"{k}_matches") for k in kinds],
        F.count(F.lit(1)).alias("total_matches"),
    )
