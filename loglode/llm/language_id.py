"""Language of texts, word by word: a conditional random field fitted on a bounded sample, applied to every text."""

from __future__ import annotations

import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loglode.llm.common import chunks, map_arrow
from loglode.llm.crf import WORD, Field, fit, forward_backward, look_up

#: The sample to learn from: so many texts of each language, a run of so many words of each. Both bound what reaches the driver.
TEXTS_PER_LANGUAGE = 150
WORDS_PER_TEXT = 60
#: Longer words teach nothing (they are scored like all others).
LONGEST_WORD = 40
LEXICON_WORDS = 100
#: Languages with the most texts that the field learns; its weights are so many columns.
LANGUAGES = 200
UNKNOWN = "und"


def words_of(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def _runs(words_per_text: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches):
            rows = []
            for h, text in zip(part.column("h").to_pylist(), part.column("text").to_pylist(), strict=True):
                words = [w for w in words_of(text) if len(w) <= LONGEST_WORD]
                at = random.Random(h).randint(0, max(len(words) - words_per_text, 0))
                rows.append(" ".join(words[at : at + words_per_text]))
            yield pa.RecordBatch.from_arrays([part.column("lang"), part.column("h"), pa.array(rows, pa.string())], names=["lang", "h", "words"])

    return run


def learn(docs: DataFrame, texts: int = TEXTS_PER_LANGUAGE, words: int = WORDS_PER_TEXT, lexicon: int = LEXICON_WORDS) -> Field:
    """A field fitted on a sample of docs (text, lang): of each language the texts with the smallest hashes, copies once.

    A first pass estimates each language's number of different texts, so that the second sends only the lower end of the
    hash range on; the driver gets `texts` runs of `words` words for each of at most LANGUAGES languages. Rows without a
    text, a letter or a language teach nothing.
    """
    rows = docs.select(F.col("lang").alias("lang"), F.col("text").alias("text"), F.xxhash64("text").alias("h")).where("lang IS NOT NULL AND text IS NOT NULL")
    sizes = rows.groupBy("lang").agg(F.count("*").alias("n"), F.approx_count_distinct("h").alias("d"))
    sizes = sizes.orderBy(F.desc("n"), "lang").limit(LANGUAGES)
    share = F.least(F.lit(1.0), 4.0 * texts / F.col("d"))
    ends = sizes.select("lang", (F.lit(-(2.0**63)) + share * 2.0**64).alias("end"))
    low = rows.join(F.broadcast(ends), "lang").where("h <= end").select("lang", "h", "text")
    runs = map_arrow(low, _runs(words), "lang string, h long, words string").where("words <> ''")
    once = runs.groupBy("lang", "h").agg(F.min("words").alias("words"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("h"))
    sample = once.withColumn("k", rank).where(F.col("k") <= texts).collect()
    return fit([(r.lang, r.words.split(" ")) for r in sample], lexicon)


def _predict(model: Field, spans: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches):
            texts = part.column("text").to_pylist()
            words = [words_of(t) for t in texts]
            first = np.concatenate([[0], np.cumsum([len(w) for w in words])]).astype(np.int64)
            flat = [w for ws in words for w in ws]
            if flat and model.langs:
                rows = look_up(flat, model)
                p, _ = forward_backward(model.scores[rows], first, model.change, model.start)
                sums = np.diff(np.concatenate([np.zeros((1, p.shape[1])), np.cumsum(p, 0)])[first], axis=0)
                best = sums.argmax(1)
                score = np.clip(sums[np.arange(len(best)), best] / np.maximum(np.diff(first), 1), 0, 1)
                names = np.array([*model.langs, UNKNOWN], object)[np.where(np.diff(first) > 0, best, len(model.langs))]
                score[np.diff(first) == 0] = 0.0
            else:
                names, score = np.full(len(texts), UNKNOWN, object), np.zeros(len(texts))
            columns = [part.column("doc_id"), pa.array(np.diff(first)), pa.array(list(names), pa.string()), pa.array(score)]
            if spans:
                labels = p.argmax(1) if flat and model.langs else np.zeros(len(flat), np.int64)
                found = [_spans(t, labels[a:b], model.langs) for t, a, b in zip(texts, first[:-1].tolist(), first[1:].tolist(), strict=True)]
                columns.append(pa.array(found, SPANS))
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "lang_pred", "score", "spans"][: len(columns)])

    return run


SPANS = pa.list_(pa.struct([("lang", pa.string()), ("n_words", pa.int64()), ("start", pa.int64()), ("end", pa.int64())]))


def _spans(text: str | None, labels: np.ndarray, langs: list[str]) -> list[tuple]:
    """Runs of words of one language, as code points of the lower-cased text."""
    out: list[list] = []
    for m, label in zip(WORD.finditer(text.lower()) if text and langs else (), labels.tolist(), strict=False):
        if out and out[-1][0] == langs[label]:
            out[-1][1] += 1
            out[-1][3] = m.end()
        else:
            out.append([langs[label], 1, m.start(), m.end()])
    return [tuple(x) for x in out]


def languages(docs: DataFrame, model: Field, spans: bool = False) -> DataFrame:
    """(doc_id, n_words, lang_pred, score) and, if asked for, the spans of each language, for every row of docs (doc_id, text).

    Each word's language is the most probable one given all words of its text; lang_pred has the largest mean
    probability over the words (ties: the alphabetically first), score is that mean. A null text, one without a letter, and
    every text where nothing could be learned get `und` and 0. Equal rows get equal results, one each; null ids stay;
    columns beyond doc_id and text are not looked at. An empty table gives an empty one.
    """
    schema = "doc_id long, n_words long, lang_pred string, score double"
    if spans:
        schema += ", spans array<struct<lang: string, n_words: long, start: long, end: long>>"
    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text")), _predict(model, spans), schema)


def held_out(doc_id: Column) -> Column:
    """A fifth of the ids, by their text's checksum; a null id counts as an empty text and is held out."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0
