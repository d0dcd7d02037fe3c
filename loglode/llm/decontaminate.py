"""Benchmark passages in documents, with a bounded number of edits: pigeonhole pieces and Myers' distance."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import ahocorasick
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loglode.llm.common import chunks, map_arrow

ERROR_PERCENT = 8
#: Shorter items are looked for without edits and between word bounds.
SHORT_CHARS = 20
#: Item characters sent to every executor at once; more items are taken in several slices.
SLICE_CHARS = 1 << 20

_WORD = re.compile(r"\w+")
_HELD: list[tuple[list, tuple[int, int], Matcher]] = []


def normal(text: str | None) -> str:
    """Lower-cased words with one space between."""
    return " ".join(_WORD.findall(text.lower())) if text else ""


def errors_within(masks: dict[str, int], m: int, text: str) -> int:
    """Least edit distance of a pattern of m characters to any part of the text (Myers' bit vectors, one per column)."""
    full, top = (1 << m) - 1, 1 << (m - 1)
    rise, fall, score, best = full, 0, m, m
    for c in text:
        equal = masks.get(c, 0)
        down = equal | fall
        across = ((equal & rise) + rise ^ rise) | equal
        more, less = fall | ~(across | rise) & full, rise & across
        if more & top:
            score += 1
        elif less & top:
            score -= 1
            best = min(best, score)
        more, less = more << 1, less << 1
        rise, fall = (less | ~(down | more)) & full, more & down
    return best


class Matcher:
    """All items of a slice: an automaton of their pieces, and what verification needs."""

    def __init__(self, items: list[tuple[int, str]], error_percent: int, short_chars: int = SHORT_CHARS):
        self.short = short_chars
        self.items = [(i, t, 0 if len(t) < short_chars else len(t) * error_percent // 100) for i, t in items]
        self.masks: list[dict[str, int] | None] = [None] * len(items)
        pieces: dict[str, list[tuple[int, int]]] = {}
        for k, (_, text, budget) in enumerate(self.items):
            for j in range(budget + 1):
                a, b = len(text) * j // (budget + 1), len(text) * (j + 1) // (budget + 1)
                pieces.setdefault(text[a:b], []).append((k, a))
        self.automaton = ahocorasick.Automaton()
        for piece, places in pieces.items():
            self.automaton.add_word(piece, (len(piece), places))
        self.automaton.make_automaton()

    def found(self, text: str) -> list[tuple[int, int]]:
        """(item id, errors) of every item in the text within its budget."""
        starts: dict[int, set[int]] = {}
        for end, (size, places) in self.automaton.iter(text):
            for k, at in places:
                starts.setdefault(k, set()).add(end + 1 - size - at)
        out = []
        for k, where in starts.items():
            item, pattern, budget = self.items[k]
            if len(pattern) < self.short:
                if any((not s or text[s - 1] == " ") and text[s + len(pattern) : s + len(pattern) + 1] in ("", " ") for s in where):
                    out.append((item, 0))
                continue
            errors = 0 if pattern in text else min(self._verify(k, *span, text) for span in self._spans(where, len(pattern), budget))
            if errors <= budget:
                out.append((item, errors))
        return out

    @staticmethod
    def _spans(starts: set[int], m: int, budget: int) -> list[tuple[int, int]]:
        spans: list[list[int]] = []
        for s in sorted(starts):
            lo, hi = s - budget, s + m + budget
            if spans and lo <= spans[-1][2] + budget:
                spans[-1][1], spans[-1][2] = hi, s
            else:
                spans.append([lo, hi, s])
        return [(max(lo, 0), hi) for lo, hi, _ in spans]

    def _verify(self, k: int, lo: int, hi: int, text: str) -> int:
        pattern = self.items[k][1]
        if self.masks[k] is None:
            masks: dict[str, int] = {}
            for bit, c in enumerate(pattern):
                masks[c] = masks.get(c, 0) | 1 << bit
            self.masks[k] = masks
        return errors_within(self.masks[k], len(pattern), text[lo:hi])


def _matcher(shared: Broadcast, limits: tuple[int, int]) -> Matcher:
    """One matcher per worker process and slice."""
    if not _HELD or _HELD[0][0] is not shared.value or _HELD[0][1] != limits:
        _HELD[:] = [(shared.value, limits, Matcher(shared.value, *limits))]
    return _HELD[0][2]


def _slices(docs: DataFrame, items: DataFrame) -> Iterator[Broadcast]:
    """The items to look for as broadcasts of SLICE_CHARS characters or a little more, cut by a hash of the id."""
    size = items.agg(F.coalesce(F.sum(F.length("`text`")), F.lit(0)).alias("n")).first().n
    count = -(-size // SLICE_CHARS) if size else 0
    context = docs.sparkSession.sparkContext
    for k in range(count):
        rows = items.where(F.pmod(F.xxhash64("`item_id`"), F.lit(count)) == k).select("`item_id`", "`text`").distinct().collect()
        picked = sorted((r.item_id, t) for r in rows if r.item_id is not None and (t := normal(r.text)))
        if picked:
            yield context.broadcast(picked)


def _hits(shared: Broadcast, *limits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = _matcher(shared, limits)
        for part in chunks(batches):
            ids, found = part.column("doc_id").to_pylist(), [matcher.found(normal(t)) for t in part.column("text").to_pylist()]
            rows = [(d, i, e) for d, hits in zip(ids, found, strict=True) for i, e in hits]
            columns = list(zip(*rows, strict=True)) if rows else [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["doc_id", "item_id", "errors"])

    return run


def _clean(shared: Broadcast, *limits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = _matcher(shared, limits)
        for part in chunks(batches):
            yield part.filter(pa.array([not matcher.found(normal(t)) for t in part.column("text").to_pylist()], pa.bool_()))

    return run


def leaks(docs: DataFrame, items: DataFrame, error_percent: int = ERROR_PERCENT, short_chars: int = SHORT_CHARS) -> DataFrame:
    """(doc_id, item_id, errors) for every document (doc_id, text) that holds a test item (item_id, text).

    Both texts are reduced to lower-cased words with one space between. A document holds an item if some part of it is
    within error_percent of the item's length in single-character edits; errors is the least number. An item of budget k
    is split into k + 1 pieces, one of which must stand unchanged in any such part; one automaton per slice of items
    finds all pieces in one pass over a text, and Myers' bit-parallel distance settles each place.

    Items travel to the documents: slices of a fixed number of characters are broadcast, and the documents are read once
    per slice, so neither the number of items nor of documents is bounded, and no text is shuffled.

    Items below short_chars characters must stand unchanged, as whole words.

    Defined cases: a null or empty text holds nothing; items without a word (null ones too) are not looked for, nor those
    without an id; equal items are found each by its id; a document row gives one row per item, repeated
    rows give repeated rows; without items, or documents, the result is empty; other columns are ignored.
    """
    slim = docs.select(F.col("`doc_id`"), F.col("`text`"))
    schema = "doc_id long, item_id long, errors long"
    found = [map_arrow(slim, _hits(s, error_percent, short_chars), schema) for s in _slices(docs, items)]
    return reduce(DataFrame.union, found) if found else slim.where(F.lit(False)).select("doc_id", *[F.lit(0).cast("long").alias(c) for c in ("item_id", "errors")])


def without_leaks(docs: DataFrame, items: DataFrame, *columns: str, error_percent: int = ERROR_PERCENT, short_chars: int = SHORT_CHARS) -> DataFrame:
    """The named columns (text among them) of the documents that hold no item, as `leaks` finds them, in the same passes."""
    rest = docs.select(*[F.col(f"`{c}`") for c in columns])
    for shared in _slices(docs, items):
        rest = map_arrow(rest, _clean(shared, error_percent, short_chars), rest.schema)
    return rest
