"""Near-duplicate groups: SuperMinHash signatures, banding, verification on full sets, union-find."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loglode.llm.common import chunks, give_back, gram_hashes, map_arrow, mix, plain, signed, stored, words
from loglode.llm.components import components
from loglode.llm.superminhash import signatures

SHINGLE = 5
BANDS = 32
ROWS = 4
MIN_PERCENT = 75
BLOCK = 500
#: Shingles of a block: some 4 MB of hashes, and a few arrays of their size while two blocks are compared.
BLOCK_SHINGLES = 1 << 19


def shingle_sets(texts: pa.Array, shingle: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, sorted, end to end, and where each set starts."""
    found = words(texts, lower=True)
    grams = gram_hashes(found.hashes, shingle)
    sets = []
    for at, upto in zip(found.first[:-1].tolist(), found.first[1:].tolist(), strict=True):
        if upto - at >= shingle:
            sets.append(np.unique(grams[at : upto - shingle + 1]))
        elif upto > at:
            sets.append(gram_hashes(found.hashes[at:upto], upto - at))
        else:
            sets.append(grams[:0])
    first = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int64)
    return (np.concatenate(sets) if sets else grams[:0]), first


def _digests(elements: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The two halves of a digest of each set."""
    digests = [hashlib.blake2b(elements[a:b].tobytes(), digest_size=16).digest() for a, b in zip(first[:-1], first[1:], strict=True)]
    return np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)


def _sketches(shingle: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches):
            elements, first = shingle_sets(part.column("text"), shingle)
            ranks = signatures(elements, first, bands * rows)
            keys = np.zeros((len(ranks), bands), np.uint64)
            for r in range(rows):
                keys = mix(keys * np.uint64(31) + ranks[:, r::rows][:, :bands] + np.arange(bands, dtype=np.uint64))
            halves = _digests(elements, first)
            sizes = np.diff(first)
            edges = np.arange(0, keys.size + 1, bands, dtype=np.int32)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), part.column("text_hash"), pa.array(sizes), pa.array(halves[:, 0]), pa.array(halves[:, 1]), pa.ListArray.from_arrays(pa.array(edges), pa.array(signed(keys).reshape(-1)))],
                names=["doc_id", "text_hash", "n_shingles", "s1", "s2", "bands"],
            )

    return run


def _set_rows(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches):
            elements, first = shingle_sets(part.column("text"), shingle)
            sets = pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(signed(elements)))
            halves = _digests(elements, first)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(halves[:, 0]), pa.array(halves[:, 1]), sets], names=["doc_id", "s1", "s2", "members"])

    return run


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, bands: int = BANDS, rows: int = ROWS, min_percent: int = MIN_PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept, text_hash) for every row of docs (doc_id, text, ...).

    Documents are linked if their sets of distinct word shingles (words split at ASCII white space, A-Z lower-cased)
    overlap by min_percent of their union or more. component_id is the smallest doc_id reachable over links, kept is
    doc_id = component_id. text_hash, xxhash64 of the text, tells the texts of one doc_id apart.

    Equal sets count once: one row stands for all copies from the start. Each set then meets, in every band of its
    signature, only one centre, the set that shares most bands with others; the pairs are confirmed on the full sets and
    joined to groups. Sets that share a band but are in another group than its centre are compared with all the sets of
    that centre, in blocks (`_across`), so no candidate pair is lost and no pairs within a group are emitted. With 32 bands of 4 ranks a pair at the very
    threshold is missed with probability (1 - 0.75 ** 4) ** 32, about 5e-6; more similar pairs far less often.

    Defined cases: a null or empty text, or one without words, has an empty set and is linked with nothing; fewer
    words than a shingle count as one element; a null doc_id is a row of its own (component_id null, kept true);
    repeated rows get equal results; texts that share a doc_id are judged each by itself, and the component is the smallest
    doc_id its sets are found in; an empty table gives no rows; other columns are ignored.
    """
    slim = plain(docs, "doc_id", "text")
    hashed = slim.withColumn("text_hash", F.xxhash64("text"))
    sketch = stored(map_arrow(hashed, _sketches(shingle, bands, rows), "doc_id long, text_hash long, n_shingles long, s1 long, s2 long, bands array<long>"))
    full = sketch.where("n_shingles > 0 AND doc_id IS NOT NULL")
    sets = full.groupBy("s1", "s2").agg(F.min(F.struct("doc_id", "n_shingles", "bands")).alias("s"))
    # A set's number stands for it from here on: one doc_id may have several texts.
    sets = sets.select("s1", "s2", F.monotonically_increasing_id().alias("id"), F.col("s.doc_id").alias("doc_id"), F.col("s.n_shingles").alias("n"), F.col("s.bands").alias("bands"))
    sets = stored(sets)
    keys = sets.select(F.explode("bands").alias("band"), "id", "n").distinct()
    crowds = keys.groupBy("band").agg(F.count("*").alias("k")).where("k > 1")
    shared = stored(keys.join(crowds, "band").select("band", "id", "n", "k"))
    scores = shared.groupBy("id").agg(F.sum("k").alias("score"))
    met = shared.join(scores, "id")
    centres = met.groupBy("band").agg(F.max_by(F.struct("id", "n"), F.struct("score", -F.col("id"))).alias("c"))
    shared = stored(met.join(centres, "band").select("band", "id", "n", "c"))
    fits = "100 * least(n, m) >= {0} * greatest(n, m)".format(min_percent)
    star = shared.select(F.col("c.id").alias("a"), F.col("c.n").alias("m"), F.col("id").alias("b"), "n")
    star = stored(star.where("a <> b").where(fits).select("a", "b").distinct())
    wanted = sets.select("s1", "s2", "doc_id", "id").join(shared.select("id").distinct(), "id", "left_semi")
    kept = slim.join(wanted.select("doc_id"), "doc_id", "left_semi")
    members = map_arrow(kept, _set_rows(shingle), "doc_id long, s1 long, s2 long, members array<long>")
    members = stored(members.join(wanted, ["doc_id", "s1", "s2"]).select("id", "members").dropDuplicates(["id"]))
    links = confirmed(star, members, min_percent)
    groups = components(links)
    more = stored(_across(shared, groups, members, min_percent))
    if not more.isEmpty():
        groups = components(links.union(more))
    # The smallest doc_id among all the sets of a group.
    owners = sets.join(groups, "id", "left").select("s1", "s2", "doc_id", F.coalesce("component", "id").alias("group"))
    least = owners.groupBy("group").agg(F.min("doc_id").alias("root"))
    roots = owners.join(least, "group").select("s1", "s2", "root")
    out = sketch.select("doc_id", "n_shingles", "s1", "s2", "text_hash").join(roots, ["s1", "s2"], "left")
    own = F.when(F.col("n_shingles") == 0, F.col("doc_id")).when(F.col("doc_id").isNotNull(), F.col("root"))
    out = out.select("doc_id", "n_shingles", own.alias("component_id"), "text_hash")
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def confirmed(pairs: DataFrame, members: DataFrame, min_percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough. The set of b moves to a, the skewed side of the second join."""
    right = members.select(F.col("id").alias("b"), F.col("members").alias("right"))
    left = members.select(F.col("id").alias("a"), F.col("members").alias("left"))
    met = pairs.join(right, "b").join(left, "a").withColumn("both", F.size(F.array_intersect("left", "right")))
    union = F.size("left") + F.size("right") - F.col("both")
    return met.where(F.col("both") * 100 >= union * min_percent).select("a", "b")


def _across(shared: DataFrame, groups: DataFrame, members: DataFrame, min_percent: int) -> DataFrame:
    """Links that join groups further: members outside their centre's group against all that share the centre.

    They are compared in blocks of about BLOCK rows and at most about BLOCK_SHINGLES shingles (one row at least) on
    either side, every block pair in one bounded task, and a block pair gives the links that join groups, not all pairs.
    """
    met = shared.select(F.col("c.id").alias("centre"), "id", "n").distinct()
    met = met.join(groups, "id", "left").select("centre", "id", "n", F.coalesce("component", "id").alias("g"))
    roots = groups.select(F.col("id").alias("centre"), F.col("component").alias("cg"))
    met = stored(met.join(roots, "centre", "left").withColumn("apart", F.col("g") != F.coalesce("cg", "centre")).drop("cg"))
    asking = F.coalesce(F.sum(F.when(F.col("apart"), F.col("n"))), F.lit(0))
    sizes = met.groupBy("centre").agg(F.count_if("apart").alias("n_apart"), asking.alias("s_apart"), F.count("*").alias("n_all"), F.sum("n").alias("s_all")).where("n_apart > 0")
    blocks = [F.ceil(F.greatest(F.col(f"n_{x}") / BLOCK, F.col(f"s_{x}") / BLOCK_SHINGLES)).cast("int").alias(k) for x, k in (("apart", "left_blocks"), ("all", "right_blocks"))]
    met = met.join(sizes.select("centre", *blocks), "centre")
    part = "cast(pmod(xxhash64(id), {0}) as int)"
    left = met.where("apart").selectExpr("centre", "id", "g", "true AS asks", f"{part.format('left_blocks')} AS i", "explode(sequence(0, right_blocks - 1)) AS j")
    right = met.selectExpr("centre", "id", "g", "false AS asks", "explode(sequence(0, left_blocks - 1)) AS i", f"{part.format('right_blocks')} AS j")
    both = left.unionByName(right).join(members, "id")
    return both.groupBy("centre", "i", "j").applyInPandas(_compare(min_percent), "a long, b long").distinct()


def _compare(min_percent: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        asks = rows["asks"].to_numpy(bool)
        sets = rows["members"].tolist()
        size = np.array([len(s) for s in sets])
        values, codes, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        owner = np.repeat(np.arange(len(sets)), size)
        # Overlaps by way of what each set lacks of, or has beyond, the elements most sets share: such differences are few.
        common = counts * 2 > len(sets)
        have = np.zeros((len(sets), int(common.sum())), bool)
        place = np.cumsum(common) - 1
        inside = common[codes]
        have[owner[inside], place[codes[inside]]] = True
        lack_owner, lack = np.nonzero(~have)
        element = np.concatenate([codes[~inside], len(values) + lack])
        holder = np.concatenate([owner[~inside], lack_owner])
        lacks = (~have).sum(axis=1)
        right = np.flatnonzero(~asks)
        seat = np.full(len(sets), -1)
        seat[right] = np.arange(len(right))
        answer = seat[holder] >= 0
        by = np.argsort(element[answer], kind="stable")
        posted, seats = element[answer][by], seat[holder][answer][by]
        mine = np.argsort(holder, kind="stable")
        start = np.searchsorted(holder[mine], np.arange(len(sets) + 1))
        groups: dict[int, int] = {}
        ids, g = rows["id"].to_numpy(), rows["g"].to_numpy()
        out = []
        for x in np.flatnonzero(asks):
            wanted = element[mine[start[x] : start[x + 1]]]
            lo, hi = np.searchsorted(posted, wanted, "left"), np.searchsorted(posted, wanted, "right")
            hits = np.concatenate([seats[l:h] for l, h in zip(lo, hi, strict=True) if h > l] or [seats[:0]])
            both = have.shape[1] - lacks[x] - lacks[right] + np.bincount(hits, minlength=len(right))
            for y in right[both * 100 >= (size[x] + size[right] - both) * min_percent]:
                p, q = _top(groups, g[x]), _top(groups, g[y])
                if p != q:
                    groups[max(p, q)] = min(p, q)
                    out.append((min(ids[x], ids[y]), max(ids[x], ids[y])))
        if len(values) > BLOCK_SHINGLES // 8:
            del sets, values, codes, counts, owner, element, holder, posted, seats, mine
            give_back()
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return run


def _top(groups: dict[int, int], x: int) -> int:
    while x in groups:
        x = groups[x]
    return x
