"""Hard negatives by a BOND scan: vectors as columns, dimensions in each anchor's order, candidates dropped by bounds."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loglode.llm.common import map_arrow, stored

POSITIVES, NEGATIVES = 5, 10
LOW_PERCENT, HIGH_PERCENT = 30, 90
#: Anchors of one slice: their components' bytes. A slice is what a task holds; the table is read once per slice.
SLICE_BYTES = 16 << 20
#: Dimensions read between two looks at the bounds; what is left comes last.
STEPS = (8, 8, 16, 32)
#: One row in so many is searched beforehand, for scores that the best ones cannot fall below.
SAMPLE = 16
#: Components beyond count as this.
LARGEST = float(1 << 62)
LONG = (1 << 63) - 1


class Anchors(NamedTuple):
    """The anchors of one slice, for each what is searched: score windows, and what their k-th best is at least."""

    ids: np.ndarray
    labels: np.ndarray
    vectors: np.ndarray  # (anchors, dimensions), whole numbers as doubles
    low: np.ndarray  # (anchors, windows): the least score that counts; above `high` where there is no such window
    high: np.ndarray


class Best:
    """The k best (score, id) of one window; equal scores by smaller id, equal pairs once."""

    def __init__(self, k: int):
        self.k, self.pairs = k, []

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        if len(scores) > 4 * self.k and scores.dtype != object:
            top = scores >= np.partition(scores, len(scores) - self.k)[len(scores) - self.k]
            if len(set(zip(scores[top].tolist(), ids[top].tolist(), strict=True))) >= self.k:
                scores, ids = scores[top], ids[top]
        new = {(-int(s), i) for s, i in zip(scores.tolist(), ids.tolist(), strict=True)}
        self.pairs = sorted(new.union(self.pairs))[: self.k]

    @property
    def least(self) -> float:
        return -self.pairs[-1][0] if len(self.pairs) == self.k else -np.inf


def whole_numbers(column: pa.ListArray, scale: float, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """floor(scale * x) of all rows, (rows, dimensions), zeros behind short vectors; and which rows are all finite."""
    sizes = np.asarray(column.value_lengths().fill_null(0)).astype(np.int64)
    values = np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64)
    who = np.repeat(np.arange(len(sizes)), sizes)
    fine = np.bincount(who[~np.isfinite(values)], minlength=len(sizes)) == 0
    nth = np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out = np.zeros((len(sizes), max(dims, int(sizes.max(initial=0)))))
    with np.errstate(invalid="ignore", over="ignore"):
        out[who, nth] = np.clip(np.floor(values * scale), -LARGEST, LARGEST)
    return out, fine


def exact_type(vectors: np.ndarray, rows: np.ndarray) -> type:
    """The fastest type that holds every partial score exactly."""
    bound = np.abs(vectors).sum(1).max(initial=0) * np.abs(rows).max(initial=0)
    return np.float32 if bound < 1 << 24 else np.float64 if bound < 1 << 53 else object


def as_type(x: np.ndarray, kind: type) -> np.ndarray:
    if kind is not object:
        return np.ascontiguousarray(x, kind)
    return np.array([[int(v) for v in row] for row in x], object).reshape(x.shape)


def bond(anchor: np.ndarray, columns: np.ndarray, least: np.ndarray, most: np.ndarray, low: float, high: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows whose product with the anchor lies between low and high, and these products.

    The dimensions (rows of `columns`) are read by the anchor's descending magnitude. What the ones still unread can add
    lies between the sums of their least and most contributions; a row that cannot reach the window any more is dropped.
    """
    order = np.argsort(-np.abs(anchor), kind="stable")
    ends = anchor * least, anchor * most
    rest_low = np.cumsum(np.minimum(*ends)[order][::-1])[::-1]
    rest_high = np.cumsum(np.maximum(*ends)[order][::-1])[::-1]
    alive, at, partial = None, 0, 0
    for size in (*STEPS, len(order)):
        dims = order[at : at + size]
        if not len(dims):
            break
        part = columns[dims] if alive is None else columns[dims][:, alive]
        partial = partial + anchor[dims] @ part
        at += size
        least_more, most_more = (rest_low[at], rest_high[at]) if at < len(order) else (0, 0)
        keep = (partial + most_more >= low) & (partial + least_more <= high)
        if not keep.all():
            alive = np.flatnonzero(keep) if alive is None else alive[keep]
            partial = partial[keep]
            if not len(alive):
                break
    if not len(order):
        partial = np.zeros(columns.shape[1])
        alive = np.flatnonzero((partial >= low) & (partial <= high))
        return alive, partial[alive]
    return (np.arange(columns.shape[1]) if alive is None else alive), partial


def _scan(sent: Broadcast, scale: float, k: int, same: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors: Anchors = sent.value
        best: dict[tuple[int, int], Best] = {}
        for batch in batches:
            found, fine = whole_numbers(batch.column("embedding"), scale, anchors.vectors.shape[1])
            rows, ids = found[fine], batch.column("vec_id").to_numpy()[fine]
            labels = batch.column("label").to_numpy()[fine]
            if not len(rows):
                continue
            short = rows.shape[1] - anchors.vectors.shape[1]
            vectors = np.pad(anchors.vectors, ((0, 0), (0, short))) if short else anchors.vectors
            kind = exact_type(vectors, rows)
            for label in np.unique(anchors.labels):
                fits = np.flatnonzero((labels == label) == same)
                if not len(fits):
                    continue
                columns = as_type(rows[fits].T, kind)
                edges = columns.min(1), columns.max(1)
                for a in np.flatnonzero(anchors.labels == label).tolist():
                    _one(a, as_type(vectors[a : a + 1], kind)[0], columns, edges, ids[fits], anchors, best, k)
        out = [(a, w, -s, i) for (a, w), b in best.items() for s, i in b.pairs]
        for at in range(0, len(out), 100_000):
            part = list(zip(*out[at : at + 100_000], strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(part[0], pa.int32()), pa.array(part[1], pa.int32()), pa.array(part[2], pa.int64()), pa.array(part[3], pa.int64())], names=["anchor", "nth", "score", "id"])

    return run


def _one(a: int, vector: np.ndarray, columns: np.ndarray, edges: tuple, ids: np.ndarray, anchors: Anchors, best: dict, k: int) -> None:
    """One anchor against one block of rows."""
    windows = np.flatnonzero(anchors.low[a] <= anchors.high[a]).tolist()
    if not windows:
        return
    low = {w: max(anchors.low[a, w], best[a, w].least if (a, w) in best else -np.inf) for w in windows}
    rows, scores = bond(vector, columns, *edges, min(low.values()), max(anchors.high[a, w] for w in windows))
    if not len(rows):
        return
    if scores.dtype == object:
        scores = np.array([max(min(s, LONG), -LONG - 1) for s in scores], object)
    own = ids[rows]
    other = own != anchors.ids[a]
    for w in windows:
        hit = (scores >= low[w]) & (scores <= anchors.high[a, w]) & other
        if hit.any():
            best.setdefault((a, w), Best(k)).add(scores[hit], own[hit])


def _search(rows: DataFrame, anchors: Anchors, scale: float, k: int, same: bool) -> DataFrame:
    """(anchor, nth, score, id, place): the k best rows of every window of every anchor."""
    sent = rows.sparkSession.sparkContext.broadcast(anchors)
    found = map_arrow(rows, _scan(sent, scale, k, same), "anchor int, nth int, score long, id long")
    place = F.dense_rank().over(Window.partitionBy("anchor", "nth").orderBy(F.desc("score"), "id"))
    return found.withColumn("place", place).where(F.col("place") <= k).dropDuplicates(["anchor", "nth", "score", "id"])


def _raised(rows: DataFrame, anchors: Anchors, scale: float, k: int, same: bool) -> Anchors:
    """Windows raised to the k-th best score among a sample of the rows: no better k can be lost by that."""
    sample = rows.where(F.pmod(F.xxhash64("vec_id"), F.lit(SAMPLE)) == 0)
    low = anchors.low.copy()
    for r in _search(sample, anchors, scale, k, same).where(F.col("place") == k).select("anchor", "nth", "score").collect():
        low[r.anchor, r.nth] = max(low[r.anchor, r.nth], r.score)
    return anchors._replace(low=low)


def hard_negatives(
    vectors: DataFrame,
    is_anchor: Column,
    scale: float = 256.0,
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    low_percent: int = LOW_PERCENT,
    high_percent: int = HIGH_PERCENT,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) from vectors (vec_id, label, embedding).

    Components become floor(scale * x); a score is the integer inner product with the anchor, higher first, ties by the
    smaller vec_id. Positives of an anchor are its best rows of the same label, at most `positives`; for each of them come
    the best rows of another label whose score is low_percent to high_percent of the positive's, at most `negatives`.

    Rows with a null vec_id, label or vector, or a component that is null or not finite, take no part. Vectors of
    different lengths meet with zeros behind the shorter one. A row with the anchor's own vec_id is no other row; rows
    equal in vec_id and score count once for an anchor; one vec_id with two vectors is two anchors. Components beyond
    2^62 count as that, scores beyond 64 bits as the nearest long, before anything is compared. No anchors, or an empty table: no rows. Columns beyond
    these three are not looked at.

    Anchors are sent to the tasks in slices of SLICE_BYTES at most, one after the other; every slice meets all rows. Each
    task keeps the best of a window; a sample searched first lifts the windows, so that a task returns few rows.
    """
    names = {c: F.col(f"`{c}`") for c in ("vec_id", "label", "embedding")}
    rows = vectors.select(names["vec_id"].cast("long").alias("vec_id"), names["label"].cast("long").alias("label"), names["embedding"].alias("embedding"), is_anchor.alias("is_anchor"))
    rows = rows.where("vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL")
    chosen, rows = rows.where("is_anchor").drop("is_anchor"), rows.drop("is_anchor")
    size = chosen.agg(F.count("*").alias("n"), F.max(F.size("embedding")).alias("dims")).first()
    slices = max(1, -(-size.n * (size.dims or 1) * 8 // SLICE_BYTES))
    parts = []
    for s in range(slices):
        mine = chosen if slices == 1 else chosen.where(F.pmod(F.xxhash64("vec_id"), F.lit(slices)) == s)
        parts.append(_slice(rows, mine, scale, positives, negatives, low_percent, high_percent))
        if slices > 1:
            parts[-1] = stored(parts[-1])
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def _slice(rows: DataFrame, chosen: DataFrame, scale: float, positives: int, negatives: int, low_percent: int, high_percent: int) -> DataFrame:
    spark = rows.sparkSession
    table = chosen.toArrow()
    column = table.column("embedding").combine_chunks()
    found, fine = whole_numbers(column, scale, 0)
    ids, labels = table.column("vec_id").to_numpy()[fine], table.column("label").to_numpy()[fine]
    first = {}
    for i, (vec_id, label, vector) in enumerate(zip(ids.tolist(), labels.tolist(), found[fine], strict=True)):
        first.setdefault((vec_id, label, vector.tobytes()), i)
    at = np.array(sorted(first.values()), np.int64)
    n = len(at)
    endless = np.full((n, 1), np.inf, object)
    anchors = Anchors(ids[at], labels[at], found[fine][at], -endless, endless)
    best = _search(rows, _raised(rows, anchors, scale, positives, True), scale, positives, True)
    best = stored(best.select("anchor", F.col("place").alias("nth"), F.col("score").alias("positive_score"), F.col("id").alias("positive_id")))
    low, high = np.full((n, positives), 1, object), np.full((n, positives), 0, object)
    for r in best.select("anchor", "nth", "positive_score").collect():
        if low_percent * r.positive_score <= high_percent * r.positive_score:
            low[r.anchor, r.nth - 1] = -(-low_percent * r.positive_score // 100)
            high[r.anchor, r.nth - 1] = high_percent * r.positive_score // 100
    windows = anchors._replace(low=low, high=high)
    hard = _search(rows, _raised(rows, windows, scale, negatives, False), scale, negatives, False)
    named = spark.createDataFrame([(i, int(v)) for i, v in enumerate(anchors.ids)], "anchor int, anchor_id long")
    pairs = best.join(F.broadcast(named), "anchor")
    hard = hard.select("anchor", (F.col("nth") + 1).alias("nth"), F.col("place").alias("rank"), F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    return hard.join(F.broadcast(pairs), ["anchor", "nth"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
