"""Quality rules with thresholds that follow each language and source."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loglode.llm.common import chunks, gram_hashes, map_arrow, offsets, raw_bytes, stored, words

MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
REPEAT_WINDOW = 5
#: A fence lies this many quartile distances beyond the median, and never nearer than the least distance given.
FENCE = 3
MIN_GROUP = 100
#: So many rows of fences (some 100 bytes each) are sent to every task; more of them meet the documents in a shuffle.
FENCES_TO_ALL = 100_000
SKETCH_BITS = 7
SYMBOLS_LEAST, DUP_LINES_LEAST, WORD_LENGTH_LEAST = 100, 400, 250

_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_GAP = np.zeros(256, bool)
_GAP[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_BLANKS = " \t\n\x0b\x0c\r"
_COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines"]


def _sums(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate([[0], np.cumsum(flags)])[bounds])


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in chunks(batches):
        column = part.column("text")
        data, bounds, found = raw_bytes(column), offsets(column), words(column)
        inside = ~_GAP[data]
        chars = _sums(inside & ((data & 0xC0) != 0x80), bounds)
        symbols = _sums(_SYMBOL[data], bounds)
        grams = gram_hashes(found.hashes, REPEAT_WINDOW)
        dup, lines, repeats = [], [], []
        for text, at, upto in zip(column.to_pylist(), found.first[:-1].tolist(), found.first[1:].tolist(), strict=True):
            real = [x for x in text.split("\n") if x.strip(_BLANKS)] if text else []
            dup.append(len(real) - len(set(real)))
            lines.append(len(real))
            repeats.append(_repeated(grams[at : max(at, upto - REPEAT_WINDOW + 1)], upto - at))
        arrays = [np.diff(found.first), chars, symbols, np.array(dup), np.array(repeats), np.array(lines)]
        own = [c for c in part.schema.names if c.startswith("own_")]
        yield pa.RecordBatch.from_arrays(
            [*[part.column(c) for c in own], *[pa.array(a.astype(np.int64)) for a in arrays]], names=[*own, *_COUNTS]
        )


def _repeated(grams: np.ndarray, n: int) -> int:
    """Words under windows that stand in the text twice or more."""
    if len(grams) < 2:
        return 0
    _, back, counts = np.unique(grams, return_inverse=True, return_counts=True)
    twice = counts[back] > 1
    if not twice.any():
        return 0
    edges = np.zeros(n + 1, np.int64)
    edges[: len(grams)] += twice
    edges[REPEAT_WINDOW : REPEAT_WINDOW + len(grams)] -= twice
    return int((np.cumsum(edges[:n]) > 0).sum())


def measured(docs: DataFrame, *carry: str) -> DataFrame:
    """The counts of each text, with the carried columns as own_<name> and base_failed."""
    kinds = dict(docs.select(*[F.col(f"`{c}`") for c in carry]).dtypes)
    taken = docs.select(F.col("`text`"), *[F.col(f"`{c}`").alias(f"own_{c}") for c in carry])
    schema = "".join(f"own_{c} {kinds[c]}, " for c in carry) + ", ".join(f"{c} long" for c in _COUNTS)
    out = map_arrow(taken, _measure, schema)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return out.withColumn("base_failed", failed)


_METRICS = {
    "symbols": "1000 * n_symbols div n_words",
    "dup_lines": "1000 * n_dup_lines div greatest(n_lines, 1)",
    "word_length": "100 * word_chars div n_words",
}


def quartiles(counts: DataFrame) -> DataFrame:
    """Quartiles of every metric for each (lang, source), from mergeable histogram sketches.

    A sketch is the number of values per bucket; a bucket keeps the SKETCH_BITS leading bits of a value (relative error
    below 1/64). Sketches merge by addition, so partial sums in every task, and sums of source sketches for a language
    or for all, give the same in any order. A source with fewer than MIN_GROUP documents in a language takes the sketch
    of the language, a smaller language that of all documents.
    """
    values = F.explode(F.array(*[F.struct(F.lit(k).alias("metric"), F.expr(v).alias("v")) for k, v in _METRICS.items()]))
    keys = [F.coalesce(f"own_{c}", F.lit("")).alias(c) for c in ("lang", "source")]
    bucket = F.expr(f"m.v - m.v % shiftleft(1L, greatest(length(bin(m.v)) - {SKETCH_BITS}, 0))").alias("bucket")
    good = counts.where(~F.col("base_failed")).select(*keys, values.alias("m")).select("lang", "source", "m.metric", bucket)
    sketch = stored(good.groupBy("lang", "source", "metric", "bucket").agg(F.count("*").alias("n")))
    own, lang = _quantiles(sketch, "lang", "source"), _quantiles(sketch, "lang").withColumnsRenamed({"n": "lang_n", "q": "lang_q"})
    total = _quantiles(sketch).first()
    whole = F.struct(*[F.array(*[F.lit(v).cast("long") for v in (total.q[m] or [None] * 3)]).alias(m) for m in _METRICS])
    named = counts.select(*keys).distinct().join(own, ["lang", "source"], "left").join(lang, ["lang"], "left")
    picked = F.when(F.col("n") >= MIN_GROUP, F.col("q")).when(F.col("lang_n") >= MIN_GROUP, F.col("lang_q")).otherwise(whole)
    return named.select("lang", "source", picked.alias("q"))


def _quantiles(sketch: DataFrame, *keys: str) -> DataFrame:
    """Number of documents n and the three quartiles of every metric q, per key (one row if there is none)."""
    merged = sketch.groupBy(*keys, "metric", "bucket").agg(F.sum("n").alias("n"))
    along = Window.partitionBy(*keys, "metric")
    merged = merged.withColumn("upto", F.sum("n").over(along.orderBy("bucket"))).withColumn("total", F.sum("n").over(along))
    cuts = [F.min(F.when(4 * F.col("upto") >= k * F.col("total"), F.col("bucket"))) for k in (1, 2, 3)]
    each = merged.groupBy(*keys, "metric").agg(F.max("total").alias("total"), F.array(*cuts).alias("cuts"))
    named = F.struct(*[F.max(F.when(F.col("metric") == m, F.col("cuts"))).alias(m) for m in _METRICS])
    return each.groupBy(*keys).agg(F.max("total").alias("n"), named.alias("q"))


def judged(counts: DataFrame, quarters: DataFrame) -> DataFrame:
    """The counts with kept: not base_failed and every metric within its fences."""

    def around(metric: str, least: int, sign: int) -> Column:
        cuts = F.col(f"q.{metric}")
        return cuts[1] + sign * F.greatest(FENCE * (cuts[2] - cuts[0]), F.lit(least))

    fences = quarters.select(
        F.col("lang").alias("fence_lang"), F.col("source").alias("fence_source"),
        around("symbols", SYMBOLS_LEAST, 1).alias("symbols_most"), around("dup_lines", DUP_LINES_LEAST, 1).alias("dup_lines_most"),
        around("word_length", WORD_LENGTH_LEAST, 1).alias("word_length_most"), around("word_length", WORD_LENGTH_LEAST, -1).alias("word_length_least"),
    )
    fences = stored(fences)
    if fences.count() <= FENCES_TO_ALL:
        fences = F.broadcast(fences)
    same = (F.coalesce("own_lang", F.lit("")) == F.col("fence_lang")) & (F.coalesce("own_source", F.lit("")) == F.col("fence_source"))
    metric = {k: F.expr(v) for k, v in _METRICS.items()}
    within = (metric["symbols"] <= F.col("symbols_most")) & (metric["dup_lines"] <= F.col("dup_lines_most"))
    within &= metric["word_length"].between(F.col("word_length_least"), F.col("word_length_most"))
    kept = F.when(F.col("base_failed"), False).otherwise(F.coalesce(within, F.lit(True)))
    return counts.join(fences, same, "left").withColumn("kept", kept)


def quality_verdicts(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept) for every row of docs.

    Rules: base_failed if there are under MIN_WORDS words or over MAX_REPEAT_PERCENT of them stand in repeated windows;
    otherwise kept unless symbols per word, share of repeated lines or mean word length lie beyond the fences of the
    document's language and source: median plus (minus) FENCE quartile distances, or the least distance if that is more.

    Defined cases: a null or empty text has no words and fails; null lang or source count as ''; a null doc_id is
    carried; repeated rows are judged alike; an empty table gives no rows; other columns are ignored.
    """
    counts = stored(measured(docs, "doc_id", "lang", "source"))
    out = judged(counts, quartiles(counts))
    return out.select(F.col("own_doc_id").alias("doc_id"), *_COUNTS[:5], "base_failed", "kept")


def keep_good(docs: DataFrame, *columns: str) -> DataFrame:
    """The named columns of the rows the rules keep. Texts are measured again beside the small table of fences, so they never move."""
    carry = list(dict.fromkeys([*columns, "lang", "source"]))
    slim = measured(docs, "lang", "source")
    out = judged(measured(docs, *carry), quartiles(slim)).where("kept")
    return out.select(*[F.col(f"own_{c}").alias(c) for c in columns])
