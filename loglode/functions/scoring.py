"""Predicates and scores of the searches."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loglode.functions.text import strip, words

# Tier scores, weights, thresholds and the stop words.
TIER_SCORE = {"exact": 1.0, "normalized": 0.8, "tokens": 0.6}
COMPONENT_BONUS = 0.1
MIN_TOKENS = 2
KEY_TOKEN_WEIGHT, KEY_LENGTH_WEIGHT = 0.6, 0.4
PHRASE_TOKEN_WEIGHT, PHRASE_ORDER_WEIGHT = 0.6, 0.4
PHRASE_MIN_RATIO = 0.5
EXCERPT_CONTEXT = 100
STOP_WORDS = [
    "a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "has", "he", "in", "is", "it", "its", "of",
    "on", "that", "the", "to", "was", "will", "with", "get", "got", "go", "goes", "went", "this", "these", "they",
    "them", "their", "there", "then", "than", "have", "had", "having", "do", "does", "did", "doing", "can",
    "could", "should", "would", "may", "might", "must",
]


def fold(c: Column, case_insensitive: bool) -> Column:
    return F.lower(c) if case_insensitive else c


def matches_key(line: Column, key: Column, case_insensitive: bool = False) -> Column:
    hit = F.contains(fold(line, case_insensitive), fold(key, case_insensitive)) & (key != "")
    return F.coalesce(hit, F.lit(False))


def matches_tokens(line: Column, tokens: Column, case_insensitive: bool = False) -> Column:
    hay = fold(line, case_insensitive)
    every = F.forall(tokens, lambda t: F.contains(hay, fold(t, case_insensitive)))
    return F.coalesce((F.size(tokens) >= MIN_TOKENS) & every, F.lit(False))


def tier_score(tier: Column, line: Column, component: Column, case_insensitive: bool = False) -> Column:
    base = F.coalesce(*[F.when(tier == name, F.lit(score)) for name, score in TIER_SCORE.items()], F.lit(0.0))
    bonus = F.when(matches_key(line, component, case_insensitive), COMPONENT_BONUS).otherwise(0.0)
    return F.least(F.lit(1.0), F.round(base + bonus, 6))


def message_score(line: Column, component: Column, case_insensitive: bool = False) -> Column:
    bonus = F.when(matches_key(line, component, case_insensitive), COMPONENT_BONUS).otherwise(0.0)
    return F.least(F.lit(1.0), F.lit(1.0) + bonus)


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    some = (F.size(a) > 0) & (F.size(b) > 0)
    return F.when(some, F.size(F.array_intersect(a, b)) / union).otherwise(0.0)


def length_proximity(a: Column, b: Column) -> Column:
    longest = F.greatest(a, b)
    return F.when((a > 0) & (b > 0), 1.0 - F.abs(a - b) / longest).otherwise(0.0)


def key_similarity(query: Column, key: Column) -> Column:
    """How close an index key is to a query it contains."""
    return KEY_TOKEN_WEIGHT * jaccard(words(query), words(key)) + KEY_LENGTH_WEIGHT * length_proximity(
        F.length(query), F.length(key)
    )


def significant_tokens(query: Column) -> Column:
    stop = F.array(*[F.lit(w) for w in STOP_WORDS])
    return F.filter(words(query), lambda t: (F.length(t) > 2) & ~F.array_contains(stop, t))


def phrase_score(query: Column, tokens: Column, text: Column) -> Column:
    """Phrase hit 1.0; else token share and order of neighbouring tokens.

    All three columns are lower case; ``tokens`` are the significant tokens of ``query``.
    The place of each token is looked up once, then bound as a lambda variable.
    """

    def from_places(places: Column) -> Column:
        n = F.size(places)
        ratio = F.size(F.filter(places, lambda p: p > 0)) / n

        def in_order(p: Column, i: Column) -> Column:
            later = F.call_function("locate", F.get(tokens, i + 1), text, p)
            return F.when((p > 0) & (i < n - 1), F.when(later > p, 1).otherwise(0)).otherwise(0)

        pairs = F.aggregate(F.transform(places, in_order), F.lit(0), lambda acc, x: acc + x)
        order = F.when(n >= 2, pairs / (n - 1)).otherwise(0.0)
        return F.transform(
            F.array(F.when(n > 0, ratio).otherwise(0.0)),
            lambda r: F.when(r < PHRASE_MIN_RATIO, 0.0).otherwise(PHRASE_TOKEN_WEIGHT * r + PHRASE_ORDER_WEIGHT * order),
        )

    places = F.transform(tokens, lambda t: F.instr(text, t))
    scored = F.get(F.flatten(F.transform(F.array(places), from_places)), 0)
    return F.when(text.isNull() | query.isNull(), 0.0).when(F.contains(text, query), 1.0).otherwise(scored)


def match_excerpt(query: Column, tokens: Column, text: Column, context: int = EXCERPT_CONTEXT) -> Column:
    """Text around the phrase, else around the first significant token, else empty.

    Tries both in turn and takes the first that occurs; each try is bound once as a
    lambda variable (place, length), as its parts are used several times.
    """
    low = F.lower(text)

    def spot(wanted: Column) -> Column:
        return F.struct(F.coalesce(F.instr(low, wanted), F.lit(0)).alias("at"), F.length(wanted).alias("width"))

    def cut(p: Column) -> Column:
        start = F.greatest(p["at"] - context, F.lit(1))
        end = F.least(p["at"] - 1 + p["width"] + context, F.length(text))
        return strip(
            F.concat(
                F.when(start > 1, "...").otherwise(""),
                F.substring(text, start, end - start + 1),
                F.when(end < F.length(text), "...").otherwise(""),
            )
        )

    tries = F.array(spot(F.lower(query)), spot(F.get(tokens, 0)))
    found = F.slice(F.filter(tries, lambda p: p["at"] > 0), 1, 1)
    return F.coalesce(F.get(F.transform(found, cut), 0), F.lit(""))
