"""Substring and near-duplicate operators against plain forms."""

import re
from pathlib import Path

import numpy as np
import pandas as pd
from brute import cut, documents, frame, near_groups, sha, substring
from loglode.llm import common, near_dedup
from loglode.llm.common import gram_hashes, words
from loglode.llm.components import components
from loglode.llm.near_dedup import near_duplicates
from loglode.llm.substring_dedup import cut_blocks, substring_dedup
from loglode.llm.superminhash import signatures

import pyarrow as pa


def test_substring_dedup(spark):
    rows = documents()
    found = substring_dedup(frame(spark, rows), text_out=True, carry=("source", "doc")).collect()
    want = []
    for (i, text), (ws, gone) in zip(rows, substring(rows), strict=True):
        kept = " ".join(w for w, g in zip(ws, gone, strict=True) if not g)
        want.append((i, len(ws), sum(gone), sha(kept), cut(text or "", gone)))
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted([(r.doc_id, r.n_words, r.n_removed, r.kept_sha256, r.kept_text) for r in found], key=key) == sorted(want, key=key)
    assert sum(r.n_removed for r in found) > 300 and {r.own_doc for r in found} == {"x"}
    assert substring_dedup(frame(spark, rows).where("false")).count() == 0


def test_blocks_are_cut_alike_wherever_a_passage_stands():
    passage = " ".join(f"p{i}" for i in range(60))
    b = cut_blocks(pa.array([passage, "a b c " + passage + " d e", "q " * 20 + passage]))
    by_text = [{(c, n) for t, n, c in zip(b.text, b.n, b.content, strict=True) if t == k} for k in range(3)]
    assert len(by_text[0] & by_text[1] & by_text[2]) >= len(by_text[0]) - 2


def test_near_duplicates(spark):
    rows = documents(seed=4)
    group, size = near_groups(rows)
    for r in near_duplicates(frame(spark, rows)).collect():
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.n_shingles, r.component_id, r.kept) == (size[r.doc_id], group[r.doc_id], group[r.doc_id] == r.doc_id)
    assert len(set(group.values())) < len(group)
    assert near_duplicates(frame(spark, rows).where("false")).count() == 0


def test_one_doc_id_with_two_texts(spark):
    one, two, three = (" ".join(f"{c}{i}" for i in range(60)) for c in "abc")
    rows = [(3, one), (5, two), (5, one + " end"), (7, two + " end"), (9, three), (9, three), (8, two)]
    got = sorted((r.doc_id, r.component_id, r.kept) for r in near_duplicates(frame(spark, rows)).collect())
    assert got == [(3, 3, True), (5, 3, False), (5, 5, True), (7, 5, False), (8, 5, False), (9, 9, True), (9, 9, True)]


def test_recall_against_all_pairs(spark):
    # Every hundredth text against all: no link of 0.75 or more may be lost.
    rng = np.random.default_rng(11)
    rows = []
    for k in range(200):
        ws = [f"t{k}.{i}" for i in rng.integers(0, 10_000, 80)]
        rows.append((k * 100, " ".join(ws)))
        for j in range(1, 6):
            near = list(ws)
            for at in rng.integers(0, len(near), j):
                near[at] = "other"
            rows.append((k * 100 + j, " ".join(near)))
    group, _ = near_groups(rows)
    assert {r.doc_id: r.component_id for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()} == group
    assert len(set(group.values())) < len(rows)


def test_anchors_and_contents_are_64_bits_wide():
    rng = np.random.default_rng(5)
    b = cut_blocks(pa.array([" ".join(f"u{i}" for i in rng.integers(0, 1 << 40, 4000))]))
    assert (np.abs(b.anchor) >> 33).any() and b.anchor.dtype == b.content.dtype == np.int64
    assert len(set(b.anchor.tolist())) == len(b.anchor)


def test_links_across_centres_are_found(spark):
    # A chain: every text is close to the next only, so one centre cannot hold the group together.
    base = [f"w{i}" for i in range(200)]
    rows = []
    for k in range(12):
        for j in range(3):
            base[k * 12 + j * 4 : k * 12 + j * 4 + 4] = [f"v{k}.{j}.{m}" for m in range(4)]
        rows.append((k, " ".join(base)))
    group, _ = near_groups(rows)
    assert {r.doc_id: r.component_id for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()} == group


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 99), (99, 98), (200, 200)]
    got = {r.id: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {98: 98, 99: 98, 100: 98}


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(2)
    seen = []
    for _ in range(40):
        x = rng.integers(0, 1 << 63, 300).astype(np.uint64)
        two = signatures(np.concatenate([x[:250], x[50:]]), np.array([0, 250, 500]))
        seen.append((two[0] == two[1]).mean())
    assert abs(np.mean(seen) - 200 / 300) < 0.02
    big = rng.integers(0, 1 << 63, 300_000).astype(np.uint64)
    parts = np.minimum(signatures(big[:150_000], np.array([0, 150_000])), signatures(big[150_000:], np.array([0, 150_000])))
    assert (signatures(big, np.array([0, 300_000])) == parts).all()


def test_words_match_the_pattern():
    texts = [t for _, t in documents(seed=9)]
    from brute import WORD, lower

    found = words(pa.array(texts), lower=True)
    assert np.diff(found.first).tolist() == [len(WORD.findall(t or "")) for t in texts]
    flat = [w for t in texts for w in WORD.findall(lower(t))]
    assert len(set(flat)) == len(set(zip(flat, found.hashes.tolist(), strict=True))) == len(set(found.hashes.tolist()))
    grams = [tuple(flat[k : k + 3]) for k in range(len(flat) - 2)]
    assert len(set(grams)) == len(set(gram_hashes(found.hashes, 3).tolist()))


def test_blocks_hold_few_shingles_however_long_the_sets(spark, monkeypatch):
    def sizes(percent):
        return lambda rows: pd.DataFrame({"a": [sum(map(len, rows["members"]))], "b": [len(rows)]}, dtype="int64")

    monkeypatch.setattr(near_dedup, "BLOCK_SHINGLES", 2000)
    monkeypatch.setattr(near_dedup, "_compare", sizes)
    shared = spark.range(1, 65).selectExpr("7L AS band", "id", "200L AS n", "named_struct('id', 1L, 'n', 200L) AS c")
    groups = spark.createDataFrame([], "id long, component long")
    members = spark.range(1, 65).selectExpr("id", "transform(sequence(1, 200), i -> xxhash64(id, i)) AS members")
    found = near_dedup._across(shared, groups, members, 75).collect()
    # 64 sets of 200 shingles: 7 blocks on either side instead of one of all 12,800.
    assert len(found) > 1 and max(r.a for r in found) < 3 * 2 * 2000


def test_freed_memory_goes_back_to_the_system():
    own = lambda: int(re.search(r"RssAnon:\s+(\d+)", Path("/proc/self/status").read_text()).group(1)) // 1024

    def hold(batches):
        yield from batches
        pieces = [bytearray(3000) for _ in range(60_000)]
        kept.append(pieces[-1])  # what lies behind the freed pieces keeps the allocator from shrinking by itself

    kept, before = [], own()
    assert list(common._giving_back(hold)(iter([1, 2]))) == [1, 2]
    assert own() - before < 60


def test_components_of_few_edges_write_few_files(spark, monkeypatch):
    from loglode.llm import components as module

    parts = []

    def counted(df):
        out = common.stored(df)
        parts.append(out.rdd.getNumPartitions())
        return out

    monkeypatch.setattr(module, "stored", counted)
    monkeypatch.setattr(module, "TASK_EDGES", 100)
    edges = spark.range(0, 250).selectExpr("id AS a", "id + 1 AS b").union(spark.range(1000, 1010).selectExpr("1000L AS a", "id AS b"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "32")
    try:
        found = {r.id: r.component for r in components(edges).collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert found == {**dict.fromkeys(range(251), 0), **dict.fromkeys(range(1000, 1010), 1000)}
    assert max(parts[1:]) <= 3
