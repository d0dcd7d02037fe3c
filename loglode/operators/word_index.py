"""Stored word index of chunk indexes: which words hold a token, how frequent they are, where they stand.

A token that occurs anywhere in a text without blanks inside it lies within one of the
text's words. So a substring search needs no scan of the texts: a gram of a token finds
the words that contain it, and the words their keys or chunks. Grams are cut from the
stored words when tokens are looked up and take no room; a Bloom filter of the grams (then
of the words) asked for drops the other rows where they are read, before any shuffle.
All rows carry machine and version, so a search touches no other index, and a new version
adds rows without changing those of others.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loglode.functions.text import words
from loglode.operators.substring_join import bloom, might_hold
from loglode.plans.bounds import shuffled
from loglode.session import stored
from loglode.sources.documents import read_index, write_index

INDEX = ("machine_id", "version_id")
#: What a place is: an error key or a chunk.
KEY, CHUNK = "key", "chunk"
#: Longest grams; a shorter token is a gram itself.
GRAM = 3


class WordIndex(NamedTuple):
    places: DataFrame  # *index, kind, word, id: a row for each distinct word of a key or chunk
    words: DataFrame  # *index, kind, word, n_places: a row for each distinct word


def searchable_text() -> Column:
    """Messages, code, docstring and comment of a chunk in one text."""
    messages = F.array_join(F.transform("error_messages", lambda e: e["message"]), "\n")
    return F.concat_ws("\n", messages, "code", "docstring", "leading_comment")


def _grams(word: Column, sizes: Sequence[int]) -> Column:
    def cut(q: int) -> Column:
        starts = F.filter(F.sequence(F.lit(1), F.greatest(F.length(word) - q + 1, F.lit(1))), lambda i: i + q - 1 <= F.length(word))
        return F.transform(starts, lambda i: F.substring(word, i, F.lit(q)))

    return F.array_distinct(F.concat(*[cut(q) for q in sizes]))


def _asked_for(rows: DataFrame, asked: DataFrame, keys: Sequence[str], count: int) -> DataFrame:
    """Rows whose keys are among those asked for, and a few others: what a Bloom filter lets through where they are read."""
    key = F.xxhash64(*keys)
    held, size = bloom(asked.select(key.alias("_key")), "_key", count)
    return shuffled(rows.filter(might_hold(held, size, key)))


def build_words(postings: DataFrame, chunks: DataFrame, index: Sequence[str] = INDEX) -> WordIndex:
    """The index of some chunks and their postings; both of its tables are stored once."""
    keys = postings.select(*index, F.lit(KEY).alias("kind"), F.col("error_key").alias("id"), F.col("error_key").alias("text")).distinct()
    texts = chunks.select(*index, F.lit(CHUNK).alias("kind"), F.col("chunk_id").alias("id"), F.lower(searchable_text()).alias("text"))
    both = keys.unionByName(texts)
    places = shuffled(stored(both.select(*index, "kind", F.explode(F.array_distinct(words(F.col("text")))).alias("word"), "id")))
    counted = places.groupBy(*index, "kind", "word").agg(F.count(F.lit(1)).alias("n_places"))
    return WordIndex(places, shuffled(stored(counted)))


def write_words(found: WordIndex, path: str) -> None:
    """Store or update the versions the index holds; those of others stay as they are."""
    write_index(found.places, f"{path}/places")
    write_index(found.words, f"{path}/words")


def read_words(spark: SparkSession, path: str, machine: str | None = None, version: str | None = None) -> WordIndex:
    return WordIndex(read_index(spark, f"{path}/places", machine, version), read_index(spark, f"{path}/words", machine, version))


def words_with(tokens: DataFrame, found: WordIndex, kind: str, index: Sequence[str] = INDEX) -> DataFrame:
    """(*index, token, word, n_places): the words that contain a token, for each distinct token.

    A word that contains the token holds any gram of it, so one gram is asked for; what comes through is verified.
    """
    held = found.words.filter(F.col("kind") == kind).drop("kind")
    size = F.least(F.length("token"), F.lit(GRAM))
    distinct = tokens.filter(F.length("token") > 0).select(*index, "token").distinct()
    asked = shuffled(stored(distinct.select(*index, "token", F.substring("token", -GRAM, GRAM).alias("gram"))))
    seen = asked.agg(F.count(F.lit(1)).alias("n"), F.collect_set(size).alias("sizes")).first()
    if not seen["n"]:
        return held.select(*index, F.lit("").alias("token"), "word", "n_places").filter(F.lit(False))
    cut = held.select(*index, F.explode(_grams(F.col("word"), sorted(seen["sizes"]))).alias("gram"), "word", "n_places")
    pairs = asked.join(_asked_for(cut, asked, [*index, "gram"], seen["n"]), [*index, "gram"])
    return pairs.filter(F.contains("word", F.col("token"))).select(*index, "token", "word", "n_places")


def rarest_tokens(tokens: DataFrame, found: WordIndex, kind: str, take: Column, index: Sequence[str] = INDEX) -> DataFrame:
    """Words of the rarest tokens of every query: `take` of them, by the frequency the index holds.

    ``tokens`` has query_id, the index columns, token, token_pos and the columns `take` needs. Adds ``absent``, the
    number of the query's tokens that no word contains; they are the rarest and find nothing.
    """
    held = shuffled(stored(words_with(tokens, found, kind, index)))
    counted = held.groupBy(*index, "token").agg(F.sum("n_places").alias("n"))
    own = shuffled(tokens).join(counted, [*index, "token"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    of_query = Window.partitionBy("query_id", *index)
    ranked = own.withColumns(
        {
            "_rank": F.row_number().over(of_query.orderBy("n", "token_pos")),
            "absent": F.count_if(F.col("n") == 0).over(of_query),
        }
    )
    picked = ranked.filter(F.col("_rank") <= take).select("query_id", *index, "token", "absent")
    return picked.join(held, [*index, "token"]).select("query_id", *index, "token", "absent", "word")


def places_of(picked: DataFrame, found: WordIndex, kind: str, index: Sequence[str] = INDEX) -> DataFrame:
    """(query_id, *index, id) of the keys or chunks that hold a picked word."""
    asked = shuffled(stored(picked.select("query_id", *index, "word").distinct()))
    held = found.places.filter(F.col("kind") == kind).drop("kind")
    return asked.join(_asked_for(held, asked, [*index, "word"], asked.count()), [*index, "word"]).select("query_id", *index, "id").distinct()
