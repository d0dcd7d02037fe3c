"""Repeated passages: Relative Lempel-Ziv factors of every document against all indexed reference blocks."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loglode.llm.common import LAST_ID, Words, chunks, gram_hashes, map_arrow, mix, powers, raw_bytes, signed, stored, words

MIN_WORDS = 13
ANCHOR = 5
INDEX_CHUNK = 2 << 20
_BLOCK_ROW = "key long, content long, doc long, tag int, place long"
BLOCK, FACTOR, MIXED, MARK = 0, 1, 2, 3
_SPAN_ROW = "window long, doc long, tag int, at int"


class Blocks(NamedTuple):
    """Runs of consecutive windows with the same anchor word run."""

    text: np.ndarray
    at: np.ndarray  # first window (a word position in its text)
    n: np.ndarray  # number of windows
    anchor: np.ndarray
    content: np.ndarray  # hash of all the windows


def _windows(texts: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes, first word of each text, and of every window inside a text its first word and its text."""
    found = words(texts)
    counts = np.maximum(np.diff(found.first) - size + 1, 0)
    text = np.repeat(np.arange(len(counts)), counts)
    within = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    return found.hashes, found.first, found.first[text] + within, text


def cut_blocks(texts: pa.Array, size: int = MIN_WORDS, anchor: int = ANCHOR) -> Blocks:
    """Cut every text into blocks at places its own words choose, so that equal passages are cut alike wherever they stand.

    The anchor of a window is its word run of `anchor` words with the smallest hash; a block is a run of windows with
    the same anchor. A block is short (at most size - anchor + 1 windows), two equal windows have equal anchors.
    """
    hashes, first, window, text = _windows(texts, size)
    if not len(window):
        none = np.zeros(0, np.int64)
        return Blocks(none, none, none, none, none)
    order = mix(gram_hashes(hashes, anchor) ^ np.uint64(0x5851F42D4C957F2D))
    best, place = order[window].copy(), window.copy()
    for k in range(1, size - anchor + 1):
        other = order[window + k]
        less = other < best
        best[less] = other[less]
        place[less] = window[less] + k
    fresh = np.concatenate([[True], (place[1:] != place[:-1]) | (text[1:] != text[:-1])])
    head = np.flatnonzero(fresh)
    n = np.diff(np.concatenate([head, [len(window)]]))
    grams = gram_hashes(hashes, size)[window]
    grams *= powers(int(n.max()))[np.arange(len(window)) - np.repeat(head, n)]
    content = mix(np.add.reduceat(grams, head) + n.astype(np.uint64))
    return Blocks(text[head], window[head] - first[text[head]], n, signed(best[head]), signed(content))


def _index_rows(size: int, anchor: int):
    """The blocks of each chunk of documents, by anchor.

    A block that an earlier document of the chunk holds needs no look-up: runs of such go out as one FACTOR row. An
    anchor that stands in different blocks of the chunk is settled too: its blocks go out as MIXED rows, dealt by their
    content, and one MARK row tells the rest of the corpus.
    """

    bits = _place_bits(size, anchor)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, limit=INDEX_CHUNK):
            b = cut_blocks(part.column("text"), size, anchor)
            if not len(b.text):
                continue
            doc = part.column("doc").to_numpy(zero_copy_only=False)[b.text]
            tag = part.column("tag").to_numpy(zero_copy_only=False)[b.text]
            by = np.lexsort((doc, b.content, b.anchor))
            anchors, contents = b.anchor[by], b.content[by]
            other_anchor = np.concatenate([[True], anchors[1:] != anchors[:-1]])
            other = other_anchor | np.concatenate([[True], contents[1:] != contents[:-1]])
            known = np.empty(len(by), bool)
            known[by] = doc[by] > doc[by][other][np.cumsum(other) - 1]
            distinct = np.add.reduceat(other.astype(np.int64), np.flatnonzero(other_anchor))
            several = np.empty(len(by), bool)
            several[by] = (distinct > 1)[np.cumsum(other_anchor) - 1]
            key = np.where(several, signed(mix(b.content)), b.anchor)
            left = ~known
            yield _rows(bits, key[left], b.content[left], doc[left], tag[left], b.at[left], b.n[left], np.where(several[left], MIXED, BLOCK))
            marks = anchors[other_anchor][distinct > 1]
            if len(marks):
                none = np.zeros(len(marks), np.int64)
                yield _rows(bits, marks, none, none, none.astype(np.int32), none, none, np.full(len(marks), MARK))
            if known.any():
                text, at, n, doc, tag = b.text[known], b.at[known], b.n[known], doc[known], tag[known]
                head = np.flatnonzero(np.concatenate([[True], (text[1:] != text[:-1]) | (at[1:] != at[:-1] + n[:-1])]))
                spread = signed(mix(doc[head].view(np.uint64) + at[head].astype(np.uint64)))
                yield _rows(bits, spread, np.zeros(len(head), np.int64), doc[head], tag[head], at[head], np.add.reduceat(n, head), np.full(len(head), FACTOR))

    return run


def _place_bits(size: int, anchor: int) -> int:
    """Bits of a place below the position: two for the kind, the others for the number of windows of a block."""
    return 2 + (size - anchor + 1).bit_length()


def _rows(bits: int, key, content, doc, tag, at, n, kind) -> pa.RecordBatch:
    """Rows of the index. place holds at, n and kind in few neighbouring bytes; the n of a factor, of any size, is its content."""
    factor = kind == FACTOR
    place = (at.astype(np.int64) << bits) | (np.where(factor, 0, n).astype(np.int64) << 2) | kind
    columns = [pa.array(key), pa.array(np.where(factor, n, content)), pa.array(doc), pa.array(tag.astype(np.int32)), pa.array(place)]
    return pa.RecordBatch.from_arrays(columns, names=["key", "content", "doc", "tag", "place"])


def _boundary_rows(size: int):
    """The single windows of the blocks at factor boundaries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches):
            _, first, window, text = _windows(part.column("text"), size)
            chosen = np.zeros(len(window), bool)
            start = np.searchsorted(text, np.arange(part.num_rows))
            spans = part.column("open").to_pylist()
            for i, pairs in enumerate(spans):
                for pair in pairs or ():
                    chosen[start[i] + pair["at"] : start[i] + pair["at"] + pair["n"]] = True
            hashes = gram_hashes(words(part.column("text")).hashes, size)
            window, text = window[chosen], text[chosen]
            doc = part.column("doc").to_numpy(zero_copy_only=False)[text]
            tag = part.column("tag").to_numpy(zero_copy_only=False)[text]
            at = (window - first[text]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(signed(hashes[window])), pa.array(doc), pa.array(tag), pa.array(at)], names=["window", "doc", "tag", "at"])

    return run


def _cut_rows(size: int, text_out: bool):
    """Join the factors of each document and drop the words under them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches):
            column = part.column("text")
            found, data = words(column), raw_bytes(column)
            removed, digests, texts, factors = [], [], [], []
            blocks, edges = part.column("factors").to_pylist(), part.column("edges").to_pylist()
            for i in range(part.num_rows):
                lo, hi = int(found.first[i]), int(found.first[i + 1])
                spans = sorted([(s["at"], s["at"] + s["n"]) for s in blocks[i] or ()] + [(a, a + 1) for a in edges[i] or ()])
                joined = _join(spans)
                gone = np.zeros(hi - lo, bool)
                for a, b in joined:
                    gone[a : b + size - 1] = True
                keep = lo + np.flatnonzero(~gone)
                kept = b" ".join([data[s:e].tobytes() for s, e in zip(found.starts[keep].tolist(), found.ends[keep].tolist(), strict=True)])
                removed.append(int(gone.sum()))
                digests.append(hashlib.sha256(kept).hexdigest())
                factors.append([{"first_word": a, "n_words": b - a + size - 1} for a, b in joined])
                texts.append(_without(data, found, lo, hi, gone) if text_out else None)
            spans_type = pa.list_(pa.struct([("first_word", pa.int32()), ("n_words", pa.int32())]))
            arrays = [part.column("doc_id"), pa.array(np.diff(found.first)), pa.array(removed, pa.int64()), pa.array(digests, pa.string()), pa.array(factors, spans_type)]
            names = ["doc_id", "n_words", "n_removed", "kept_sha256", "factors"]
            if text_out:
                arrays += [pa.array(texts, pa.string()), *[part.column(c) for c in part.schema.names if c.startswith("own_")]]
                names += ["kept_text", *[c for c in part.schema.names if c.startswith("own_")]]
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    return run


def _without(data: np.ndarray, found: Words, lo: int, hi: int, gone: np.ndarray) -> str:
    """The text of words lo to hi without the words that are gone; the blanks after those go with them, all others stay."""
    pieces, edges = [], np.flatnonzero(np.diff(np.concatenate([[True], gone, [True]]).astype(np.int8)))
    for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
        end = found.starts[lo + b] if lo + b < hi else found.ends[hi - 1]
        pieces.append(data[found.starts[lo + a] : end].tobytes())
    return b"".join(pieces).decode()


def _join(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Greedy factors: window runs that touch or overlap become one, as long as it gets."""
    out: list[tuple[int, int]] = []
    for a, b in spans:
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def substring_dedup(docs: DataFrame, min_words: int = MIN_WORDS, anchor: int = ANCHOR, text_out: bool = False, carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, factors) for every row of docs (doc_id, text, ...).

    Words are what stands between ASCII white space. A word is removed if it lies in a window of min_words words that
    also starts in a document with a smaller doc_id, all judged on the input. factors are the duplicate spans
    (first_word, n_words). With text_out the text without them comes as kept_text (the blanks between kept words stay),
    with the columns named in carry as own_<name>.

    Reference blocks are cut where the words themselves say so (`cut_blocks`) and indexed by anchor. Each document is
    factored greedily against every block of every earlier document: a block found whole extends the factor. Where a
    factor ends inside a block (its anchor is indexed, but only with other words around it), the boundary is checked
    window by window. Anchors and contents are 64 bits each and both must agree, so strange blocks do not meet at 100 TB
    either. Block hashes move once, about one per five words; the windows of blocks at boundaries move as well; texts meet
    their factors in one join.

    An anchor or passage in very many documents costs one row per chunk of text at its place in the index, not one per
    document (`_index_rows`); boundary windows are summed before they are shuffled, and joins split skewed keys.
    docs should be a stored table: which rows share a chunk must be the same if a lost task runs again.

    Defined cases: a null or empty text has no words (0, 0, hash of nothing); a null doc_id counts as larger than all
    others; rows with equal doc_id are never each other's reference (their texts are told apart by a hash of 32 bits);
    other columns are ignored.
    """
    keyed = docs.select(
        F.col("`doc_id`"), F.col("`text`"), F.coalesce("`doc_id`", F.lit(LAST_ID)).alias("doc"),
        F.hash("`text`").alias("tag"), *[F.col(f"`{c}`").alias(f"own_{c}") for c in carry],
    )
    index = map_arrow(keyed.select("text", "doc", "tag"), _index_rows(min_words, anchor), _BLOCK_ROW).repartition("key")
    bits = _place_bits(min_words, anchor)
    kind, at = F.col("place").bitwiseAND(3), F.shiftright("place", bits)
    n = F.when(kind == FACTOR, F.col("content")).otherwise(F.shiftright("place", 2).bitwiseAND((1 << (bits - 2)) - 1))
    same, near = Window.partitionBy("key", "content"), Window.partitionBy("key")
    content = F.when(kind == BLOCK, F.col("content"))
    marked = F.coalesce(F.max(kind == MARK).over(near), F.lit(False))
    differ = F.coalesce(F.min(content).over(near) < F.max(content).over(near), F.lit(False))
    met = index.withColumn("first", F.min("doc").over(same)).withColumn("mixed", (kind == MIXED) | marked | differ)
    whole = (kind == FACTOR) | (F.col("doc") > F.col("first"))
    met = met.where(kind != MARK).where(whole | F.col("mixed"))
    met = met.select("doc", "tag", at.cast("int").alias("at"), n.cast("int").alias("n"), whole.alias("whole"))
    span = F.struct("at", "n")
    spans = met.groupBy("doc", "tag").agg(
        F.collect_list(F.when(F.col("whole"), span)).alias("factors"), F.collect_list(F.when(~F.col("whole"), span)).alias("open")
    )
    spans = stored(spans)
    edge = keyed.join(spans.where(F.size("open") > 0).select("doc", "tag", "open").hint("shuffle_hash"), ["doc", "tag"])
    edge = map_arrow(edge, _boundary_rows(min_words), _SPAN_ROW)
    first = edge.groupBy("window").agg(F.min("doc").alias("first"), F.max("doc").alias("last")).where("first < last")
    edge = edge.join(first.select("window", "first"), "window").where(F.col("doc") > F.col("first"))
    edge = edge.groupBy("doc", "tag").agg(F.collect_set("at").alias("edges"))
    marks = spans.select("doc", "tag", "factors").join(edge, ["doc", "tag"], "full")
    cut = keyed.join(marks.hint("shuffle_hash"), ["doc", "tag"], "left")
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string, factors array<struct<first_word:int,n_words:int>>"
    if text_out:
        types = dict(docs.select(*[F.col(f"`{c}`") for c in carry]).dtypes)
        schema += ", kept_text string" + "".join(f", own_{c} {types[c]}" for c in carry)
    columns = ["doc_id", "text", "factors", "edges", *[f"own_{c}" for c in carry]]
    return map_arrow(cut.select(*columns), _cut_rows(min_words, text_out), schema)
