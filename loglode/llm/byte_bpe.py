"""Byte-level BPE of whole tables: every distinct word is encoded once, ids go back to their positions."""

from __future__ import annotations

import base64
import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loglode.llm.common import CHUNK_BYTES, chunks, map_arrow, offsets, raw_bytes

#: Text of one batch: its words are looked up together and its documents reassembled together.
BATCH_BYTES = 12 << 20
#: Words and ids a task remembers before it starts afresh.
KNOWN_BYTES = 64 << 20
_ROW = "key long, batch long, words binary, sizes binary, places binary, doc_id long, sequence binary"
_IDS_ROW = "key long, places binary, sizes binary, ids binary"


def read_ranks(path: str) -> dict[bytes, int]:
    """The vocabulary of a rank file: one token (base64) and its rank per line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


def merge(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Token ids of one word: the neighbouring pair of lowest rank is joined, the first of equals, until none is left."""
    if word in ranks:
        return [ranks[word]]
    ends = list(range(1, len(word) + 1))  # end of the part that starts here
    before = list(range(-1, len(word) - 1))
    heap = [(r, i, i + 2) for i in range(len(word) - 1) if (r := ranks.get(word[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, upto = heapq.heappop(heap)
        middle = ends[i]
        if middle == 0 or middle >= len(word) or ends[middle] != upto:
            continue  # one of the two parts has been joined otherwise
        ends[i], ends[middle] = upto, 0
        if upto < len(word):
            before[upto] = i
            if (r := ranks.get(word[i : ends[upto]])) is not None:
                heapq.heappush(heap, (r, i, ends[upto]))
        if (b := before[i]) >= 0 and (r := ranks.get(word[b:upto])) is not None:
            heapq.heappush(heap, (r, b, upto))
    out, i = [], 0
    while i < len(word):
        out.append(ranks[word[i : ends[i]]])
        i = ends[i]
    return out


def _pack(numbers: np.ndarray) -> bytes:
    """Small numbers first: the bytes of a kind stand together and compress to about their entropy."""
    return zlib.compress(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes(), 1)


def _unpack(packed: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zlib.decompress(packed), np.uint8).reshape(4, -1).T).view("<u4").reshape(-1)


def _split(pattern: str, fan: int):
    """Batches of documents as sequences of word numbers, and the batch's distinct words, dealt by their hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = regex.compile(pattern).findall
        batch = TaskContext.get().partitionId() << 24
        numbers: dict[str, int] = {}
        docs: list[tuple[int | None, np.ndarray]] = []
        held = 0
        for part in chunks(batches, limit=CHUNK_BYTES):
            for doc_id, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True):
                found = find(text) if text else []
                docs.append((doc_id, np.array([numbers.setdefault(w, len(numbers)) for w in found], np.uint32)))
            held += part.column("text").nbytes
            if held >= BATCH_BYTES:
                yield from _flush(batch, numbers, docs, fan)
                batch, numbers, docs, held = batch + 1, {}, [], 0
        if docs:
            yield from _flush(batch, numbers, docs, fan)

    return run


def _flush(batch: int, numbers: dict[str, int], docs: list, fan: int) -> Iterator[pa.RecordBatch]:
    counts = np.bincount(np.concatenate([s for _, s in docs]), minlength=len(numbers))
    rank = np.empty(len(numbers), np.int64)
    rank[np.argsort(-counts, kind="stable")] = np.arange(len(numbers))
    raw = [w.encode() for w in numbers]
    key = np.fromiter((zlib.crc32(w) % fan for w in raw), np.int64, len(raw))
    by = np.lexsort((rank, key))
    cuts = np.flatnonzero(np.concatenate([[True], key[by][1:] != key[by][:-1]])) if len(raw) else np.zeros(0, np.int64)
    rows = []
    for a, b in zip(cuts, [*cuts[1:], len(by)], strict=True):
        picked = by[a:b]
        words = [raw[i] for i in picked]
        sizes = np.array([len(w) for w in words], "<u4")
        rows.append((int(key[picked[0]]), batch, b"".join(words), _pack(sizes), _pack(rank[picked]), None, None))
    rows += [(-1 - batch, batch, None, None, None, doc_id, _pack(rank[s])) for doc_id, s in docs]
    types = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.int64(), pa.binary()]
    names = ["key", "batch", "words", "sizes", "places", "doc_id", "sequence"]
    for at in range(0, len(rows), 2000):
        columns = zip(*rows[at : at + 2000], strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)


def _encode_words(shared):
    """Ids of the words of every batch; a word that several batches hold is encoded once, since its hash leads all of them here.

    What a task remembers is bounded by KNOWN_BYTES; beyond, it begins anew and encodes a word again at worst."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks: dict[bytes, int] = shared.value
        known: dict[bytes, bytes] = {}
        held = 0
        for part in batches:
            rows = []
            for row in part.select(["batch", "words", "sizes", "places"]).to_pylist():
                if row["words"] is None:
                    continue
                ids, counts, at = [], [], 0
                for size in _unpack(row["sizes"]).tolist():
                    word = row["words"][at : at + size]
                    at += size
                    if (own := known.get(word)) is None:
                        own = np.array(merge(word, ranks), "<u4").tobytes()
                        if held > KNOWN_BYTES:
                            known, held = {}, 0
                        known[word] = own
                        held += len(word) + len(own) + 100
                    ids.append(own)
                    counts.append(len(own) // 4)
                rows.append((-1 - row["batch"], row["places"], _pack(np.array(counts)), _pack(np.frombuffer(b"".join(ids), "<u4"))))
            columns = list(zip(*rows, strict=True)) if rows else [(), (), (), ()]
            arrays = [pa.array(c, t) for c, t in zip(columns, [pa.int64(), pa.binary(), pa.binary(), pa.binary()], strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, names=["key", "places", "sizes", "ids"])

    return run


def _reassemble(rows: pa.Table, found: pa.Table) -> pa.Table:
    """The ids of a batch's documents, position by position."""
    pieces = found.select(["places", "sizes", "ids"]).to_pylist() if rows.num_rows else []
    places = [_unpack(p["places"]) for p in pieces]
    sizes = [_unpack(p["sizes"]) for p in pieces]
    ids = np.concatenate([_unpack(p["ids"]) for p in pieces]) if pieces else np.zeros(0, "<u4")
    place = np.concatenate(places).astype(np.int64) if pieces else np.zeros(0, np.int64)
    size = np.concatenate(sizes).astype(np.int64) if pieces else np.zeros(0, np.int64)
    start, length = np.zeros(len(place), np.int64), np.zeros(len(place), np.int64)
    start[place], length[place] = np.cumsum(size) - size, size
    out, counts = [], []
    for packed in rows.column("sequence").to_pylist() if rows.num_rows else []:
        sequence = _unpack(packed)
        out.append(ids[_ranges(start[sequence], length[sequence])].astype("<u4").tobytes())
        counts.append(len(out[-1]) // 4)
    doc_ids = rows.column("doc_id").to_pylist() if rows.num_rows else []
    return pa.table({"doc_id": pa.array(doc_ids, pa.int64()), "n_tokens": pa.array(counts, pa.int64()), "ids": pa.array(out, pa.binary())})


def _ranges(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... (length[0] of them), start[1], ..."""
    ends = np.cumsum(length)
    return np.repeat(start - ends + length, length) + np.arange(ends[-1] if len(ends) else 0)


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str) -> DataFrame:
    """(doc_id, n_tokens, ids) for every row of docs (doc_id, text, ...); ids are packed little-endian unsigned 32-bit integers.

    Every match of the pattern is encoded by itself, as byte-pair merges by rank, without special tokens.

    A batch of some 12 MB of text turns into its distinct words and its documents as sequences of word numbers. Words
    are shuffled by hash, so each distinct word of the table is encoded once; their ids go back to the batches, where
    they replace the numbers at every position. The one exchange carries both kinds of rows and is read twice; only the
    sequences reach the reassembly, a batch at a time. A very
    common word costs one entry per batch. The vocabulary (some 50,000 tokens, whatever the input) is broadcast.
    docs should be a stored table: a batch must hold the same rows if a lost task runs again.

    Defined cases: a null or empty text has no tokens; a null doc_id is carried; repeated rows get equal results; an
    empty table gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(ranks)
    fan = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    slim = docs.select(F.col("`doc_id`"), F.col("`text`"))
    rows = map_arrow(slim, _split(pattern, fan), _ROW).repartition("key")
    found = map_arrow(rows, _encode_words(shared), _IDS_ROW)
    # Tied to the partition, the condition stays above the exchange; with all columns, the exchange serves both sides.
    sequences = rows.where(F.when(F.spark_partition_id() >= 0, F.col("sequence").isNotNull()))
    both = sequences.groupBy("key").cogroup(found.groupBy("key"))
    return both.applyInArrow(_reassemble, "doc_id long, n_tokens long, ids binary")


def token_bytes(ranks: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The token table by id: start, length and all bytes end to end (a missing id has no bytes)."""
    length = np.zeros(max(ranks.values(), default=-1) + 1, np.int64)
    by_id = {i: t for t, i in ranks.items()}
    for i, t in by_id.items():
        length[i] = len(t)
    return np.cumsum(length) - length, length, np.frombuffer(b"".join(by_id[i] for i in sorted(by_id)), np.uint8)


def _decode(shared, carry: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start, length, data = shared.value
        for part in chunks(batches, "ids"):
            column = part.column("ids")
            ids = raw_bytes(column).view("<u4").astype(np.int64) if len(raw_bytes(column)) else np.zeros(0, np.int64)
            sizes = length[ids]
            ends = np.concatenate([[0], np.cumsum(sizes)])[offsets(column) // 4]
            text = data[_ranges(start[ids], sizes)]
            decoded = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(column), [None, pa.py_buffer(ends.astype(np.int64).tobytes()), pa.py_buffer(text.tobytes())])
            yield pa.RecordBatch.from_arrays([*[part.column(c) for c in carry], decoded.cast(pa.binary())], names=[*carry, "decoded"])

    return run


def decode(encoded: DataFrame, ranks: dict[bytes, int]) -> DataFrame:
    """The rows of encoded (ids, ...) with decoded, the bytes of their ids: every id is joined with the broadcast token table.

    The table's key is a dense number and its size fixed by the vocabulary, so the join is a broadcast one whose look-up
    is an array index; positions stay in order and no id moves.

    Null ids decode to nothing, as do ids the table lacks; an id beyond the table is an error.
    """
    spark: SparkSession = encoded.sparkSession
    shared = spark.sparkContext.broadcast(token_bytes(ranks))
    schema = ", ".join(f"`{c}` {t}" for c, t in encoded.dtypes) + ", decoded binary"
    return map_arrow(encoded, _decode(shared, encoded.columns), schema)
