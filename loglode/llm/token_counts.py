"""Token counts under a unigram vocabulary, with scores shared along a trie of pre-tokens."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loglode.llm.common import CHUNK_BYTES, chunks, map_arrow

BATCH_BYTES = 16 << 20
#: Distinct words a worker remembers between batches; beyond that it starts over (results do not change).
REMEMBERED = 1 << 20


def zipf_scores(ranks: dict[bytes, int]) -> dict[bytes, float]:
    """Log-probabilities that fall with the rank as in Zipf's law, for a vocabulary that gives an order but no scores."""
    return {token: -math.log(rank + 2) for token, rank in ranks.items()}


def count_tokens(words: Iterable[bytes], scores: dict[bytes, float]) -> dict[bytes, int]:
    """Number of tokens in the best segmentation of every distinct word; of equal scores the one with fewer tokens.

    The words in order are their trie, depth first: what two neighbours have in common is a shared path. best[i] and
    count[i] are the forward score and tokens of the first i bytes, so a word goes on from the end of that path, and its
    count is stored where it ends. A byte outside the vocabulary counts as one token that no other segmentation avoids.
    """
    longest = max(map(len, scores), default=1)
    missing = min(scores.values(), default=0.0) * 2 - 1
    best, count, out, last = [0.0], [0], {}, b""
    for word in sorted(set(words)):
        at, upto = 0, min(len(word), len(last))
        while at < upto and word[at] == last[at]:
            at += 1
        del best[at + 1 :], count[at + 1 :]
        for i in range(at + 1, len(word) + 1):
            top, fewest = best[i - 1] + missing, count[i - 1] + 1
            for j in range(max(0, i - longest), i):
                s = scores.get(word[j:i])
                if s is not None:
                    s += best[j]
                    if s > top or s == top and count[j] + 1 < fewest:
                        top, fewest = s, count[j] + 1
            best.append(top)
            count.append(fewest)
        out[word] = count[-1]
        last = word
    return out


def _count(shared, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, scores = regex.compile(pattern).findall, shared.value
        known: dict[str, int] = {}
        parts, held = [], 0
        for part in chunks(batches, limit=CHUNK_BYTES):
            parts.append((part, [find(t) if t else [] for t in part.column("text").to_pylist()]))
            held += part.column("text").nbytes
            if held >= BATCH_BYTES:
                yield from _finish(parts, known, scores)
                parts, held = [], 0
        yield from _finish(parts, known, scores)

    return run


def _finish(parts: list, known: dict[str, int], scores: dict[bytes, float]) -> Iterator[pa.RecordBatch]:
    if len(known) > REMEMBERED:
        known.clear()
    fresh = {w for _, texts in parts for words in texts for w in words}.difference(known)
    by_bytes = count_tokens([w.encode() for w in fresh], scores)
    known.update((w, by_bytes[w.encode()]) for w in fresh)
    for part, texts in parts:
        tokens = np.array([sum(map(known.__getitem__, words)) for words in texts], np.int64)
        yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([len(w) for w in texts], pa.int64()), pa.array(tokens)], names=["doc_id", "n_pretokens", "n_tokens"])


def token_counts(docs: DataFrame, scores: dict[bytes, float], pattern: str) -> DataFrame:
    """(doc_id, n_pretokens, n_tokens) for every row of docs (doc_id, text, ...).

    Every match of the pattern is segmented by itself so that the sum of token scores is largest. A task takes the
    distinct pre-tokens of some 16 MB of text at a time, puts them in a trie and scores each shared prefix once
    (`count_tokens`); documents add up the stored counts. Nothing is shuffled; the vocabulary, whose size does not
    depend on the input, is broadcast.

    Defined cases: a null or empty text has no tokens; a null doc_id is carried; repeated rows get equal results; an
    empty table gives no rows; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(scores)
    slim = docs.select(F.col("`doc_id`"), F.col("`text`"))
    return map_arrow(slim, _count(shared, pattern), "doc_id long, n_pretokens long, n_tokens long")
