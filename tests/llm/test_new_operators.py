"""Conversation repair, hard negatives and language identification against plain versions."""

import hashlib
import heapq
import itertools
import math
import random
import re

import numpy as np
from brute import sha
from pyspark.sql import functions as F

from loglode.llm.conversation_repair import repair_conversations
from loglode.llm.crf import fit, forward_backward
from loglode.llm.hard_negatives import hard_negatives
from loglode.llm.language_id import UNKNOWN, held_out, languages, learn
from loglode.llm.suffix_automaton import solve


def cheapest(rows):
    """(cost, audit, lines) by searching all edits, cheapest and then least audit first. rows: (role, text, fault 0 1 2)."""
    queue, seen = [(0, "", 0, "", ())], set()
    while queue:
        cost, audit, at, roles, lines = heapq.heappop(queue)
        if at == len(rows) and re.fullmatch("(s?(ua)+)?", roles):
            return cost, audit, list(lines)
        if (at, roles[-1:]) in seen:
            continue
        seen.add((at, roles[-1:]))
        legal = lambda x: any(re.fullmatch("(s?(ua)+)?", x + end) for end in ("", "a", "ua"))
        ways = [(5, "I", at, roles + r[0], (*lines, f"{r}:")) for r in ("user", "assistant")]
        if at < len(rows):
            role, text, fault = rows[at]
            ways.append((2, "D", at + 1, roles, lines))
            if fault < 2:
                ways.append((5 * fault, "K", at + 1, roles + (role[:1] or "?"), (*lines, f"{role}:{text}")))
                ways += [(1 + 5 * fault, "R", at + 1, roles + r[0], (*lines, f"{r}:{text}")) for r in ("user", "assistant")]
        for c, letter, to, new, out in ways:
            if legal(new):
                heapq.heappush(queue, (cost + c, audit + letter, to, new, out))


def plain_repair(rows):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).digest()))
    seen, marked = set(), []
    for _, role, text in rows:
        end = text.rstrip(" \t\n\x0b\x0c\r")
        marked.append((role, text, 2 if not end else 3 if (role, text) in seen else 0 if end[-1] in ".!?" else 1))
        seen.add((role, text))
    turns = {t for t, _, _ in rows if t is not None}
    faults = [m[2] for m in marked]
    illegal = sum((a[0][:1] + b[0][:1]) not in ("su", "ua", "au") for a, b in itertools.pairwise(marked))
    cost, audit, lines = cheapest([(r, t, min(f, 2)) for r, t, f in marked])
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    return (gaps, faults.count(2), faults.count(3), faults.count(1), illegal, cost, audit, sha("\n".join(lines).encode()))


CONVERSATIONS = "conv_id long, turn long, role string, text string, part string, signature string"


def test_repairs_against_search(spark):
    rng = random.Random(4)
    texts = ["Yes.", "No", " ", "", "What?", "cut off,", "Fine!\n", "Ja.  "]
    roles = ["system", "user", "assistant", "tool", "", "user", "assistant"]
    rows = []
    for c in range(60):
        for _ in range(rng.randint(0, 7)):
            rows.append((c if c else None, rng.choice([None, *range(5)]), rng.choice(roles), rng.choice(texts), "x", "y"))
    rows += [(70, None, None, None, None, None), (71, 1, "user", "a" * 100_000, "", ""), (71, 2, "user", "b.", "", ""), (71, 2, "user", "b.", "", "")]
    got = {r[0]: tuple(r)[1:] for r in repair_conversations(spark.createDataFrame(rows, CONVERSATIONS).repartition(5)).collect()}
    want = {}
    for c in {r[0] for r in rows}:
        want[c] = plain_repair([(t, " " if r is None else r, " " if x is None else x) for k, t, r, x, *_ in rows if k == c])
    assert got == want


def test_long_conversations_are_cut_in_pieces(spark, monkeypatch):
    import loglode.llm.conversation_repair as module

    rows = [(9, t, ("user", "assistant")[t % 2], f"Turn {t % 700}.") for t in range(3000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    whole = repair_conversations(df).collect()
    monkeypatch.setattr(module, "PIECE", 7)
    assert repair_conversations(df).collect() == whole
    assert (whole[0].gaps, whole[0].duplicate, whole[0].illegal, whole[0].audit) == (0, 2300, 0, "K" * 700 + "D" * 2300)


def test_conversations_without_rows(spark):
    rows = spark.createDataFrame([(1, 1, "user", "Hi."), (2, 5, "user", "x")], "conv_id long, turn long, role string, text string")
    got = {r.conv_id: tuple(r)[1:] for r in repair_conversations(rows, F.when(F.col("conv_id") == 1, 0).otherwise(1)).collect()}
    assert got[1] == (0, 0, 0, 0, 0, 0, "", sha(b""))
    assert repair_conversations(rows.where("false")).count() == 0


def test_signatures_in_any_order_have_the_same_repair():
    rng = random.Random(5)
    signatures = {"".join(rng.choice("suaoSUAO-") for _ in range(rng.randint(0, 9))) for _ in range(300)}
    by_end = {s: (c, a) for s, c, a in solve(iter(sorted(signatures, key=lambda s: s[::-1])))}
    assert by_end == {s: (c, a) for s, c, a in solve(iter(sorted(signatures)))}
    for s in list(signatures)[:80]:
        rows = [({"s": "s", "u": "u", "a": "a"}.get(x.lower(), "o"), "t", 2 if x == "-" else int(x.isupper())) for x in s]
        assert by_end[s] == cheapest(rows)[:2]


def plain_negatives(rows):
    fine = [(i, k, [math.floor(256 * x) for x in v]) for i, k, v in rows if i is not None and k is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, label, v in {(i, k, tuple(x)) for i, k, x in fine if i % 100 == 0}:
        scored = {(k, -max(min(sum(p * q for p, q in zip(v, x, strict=False)), 2**63 - 1), -(2**63)), i) for i, k, x in fine if i != a}
        near = sorted({(s, i) for k, s, i in scored if k == label})[:5]
        for s, p in near:
            hard = sorted({(n, i) for k, n, i in scored if k != label and 30 * -s <= 100 * -n <= 90 * -s})[:10]
            out += [(a, p, r, i, -s, -n) for r, (n, i) in enumerate(hard, 1)]
    return sorted(out)


VECTORS = "vec_id long, label int, embedding array<double>, score long, anchor int, nth int"


def vectors(seed, n, scale):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(4, 12))
    rows = []
    for i in range(n):
        k = int(rng.integers(4))
        v = [float(x) for x in (centres[k] * 0.3 + rng.normal(size=12)) * scale]
        rows.append((i * 10, k, v, 1, 1, 1))
    odd = [(None, 1, [1.0]), (7, None, [1.0]), (8, 1, None), (9, 1, [1.0, None]), (11, 1, [float("nan")]), (12, 1, [float("inf")] * 12), (300, 2, []), (500, 1, [0.5] * 3), (13, 0, [0.25] * 20)]
    return rows + [(*r, 1, 1, 1) for r in odd] + rows[:40]


def test_hard_negatives_against_all_pairs(spark):
    for seed, scale in ((1, 0.3), (2, 40.0), (3, 1e6), (4, 1e300)):
        rows = vectors(seed, 300, scale)
        df = spark.createDataFrame(rows, VECTORS).repartition(3)
        got = sorted(map(tuple, hard_negatives(df, F.col("vec_id") % 100 == 0).collect()))
        assert got == plain_negatives([r[:3] for r in rows])
        assert got or scale > 1e9
    assert hard_negatives(df.where("false"), F.col("vec_id") % 100 == 0).count() == 0
    assert hard_negatives(df, F.lit(False)).count() == 0


def test_anchors_in_slices(spark, monkeypatch):
    import loglode.llm.hard_negatives as module

    df = spark.createDataFrame(vectors(4, 300, 0.3), VECTORS)
    whole = sorted(map(tuple, hard_negatives(df, F.col("vec_id") % 100 == 0).collect()))
    monkeypatch.setattr(module, "SLICE_BYTES", 1000)
    assert sorted(map(tuple, hard_negatives(df, F.col("vec_id") % 100 == 0).collect())) == whole


def test_forward_backward_against_all_paths():
    rng = np.random.default_rng(3)
    change, start = rng.normal(size=(3, 3)), rng.normal(size=3)
    sizes = [5, 0, 1, 4]
    scores = rng.normal(size=(sum(sizes), 3)) * 2
    first = np.concatenate([[0], np.cumsum(sizes)])
    p, _ = forward_backward(scores, first, change, start)
    for a, b in itertools.pairwise(first):
        total, want = 0.0, np.zeros((b - a, 3))
        for path in itertools.product(range(3), repeat=int(b - a)) if b > a else ():
            w = np.exp(start[path[0]] + sum(scores[a + t, k] for t, k in enumerate(path)) + sum(change[i, j] for i, j in itertools.pairwise(path)))
            total += w
            want[np.arange(b - a), path] += w
        if b > a:
            assert np.allclose(p[a:b], want / total)


def test_long_texts_need_no_other_rounding():
    rng = np.random.default_rng(4)
    change, start = rng.normal(size=(2, 2)), np.zeros(2)
    scores = rng.normal(size=(1000, 2)) * 3
    p, _ = forward_backward(scores, np.array([0, 1000]), change, start)
    move, emit = np.exp(change), np.exp(scores)
    alpha, beta = np.empty((1000, 2)), np.ones((1000, 2))
    for t in range(1000):
        alpha[t] = (alpha[t - 1] @ move if t else np.ones(2)) * emit[t]
        alpha[t] /= alpha[t].sum()
    for t in range(998, -1, -1):
        beta[t] = move @ (emit[t + 1] * beta[t + 1])
        beta[t] /= beta[t].sum()
    want = alpha * beta
    assert np.allclose(p, want / want.sum(1, keepdims=True))


SF = "/root/testdata/sf0.01"


def test_held_out_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = learn(docs.where(~held_out(F.col("doc_id"))))
    found = languages(docs.where(held_out(F.col("doc_id"))), model).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert sum(r.lang == r.lang_pred for r in found) >= 0.97 * len(found)
    assert all(0 <= r.score <= 1 for r in found)
    texts = {r.lang: " ".join(r.text.split()[:40]) for r in docs.where("lang IN ('de', 'fr') AND doc_id < 60").collect()}
    rows = [(1, texts["de"] + " " + texts["fr"], "h"), (2, None, "h"), (3, "12 -- 3!", "h"), (3, "", "h"), (None, texts["fr"], "h"), (4, texts["de"] * 3000, "h")]
    both = spark.createDataFrame(rows, "doc_id long, text string, h string")
    got = languages(both, model, spans=True).collect()
    assert [x.lang for x in got[0].spans if x.n_words > 5] == ["de", "fr"]
    assert [(r.doc_id, r.lang_pred) for r in got[1:]] == [(2, UNKNOWN), (3, UNKNOWN), (3, UNKNOWN), (None, "fr"), (4, "de")]
    assert got[1].score == 0 and got[1].spans == []
    assert languages(both.where("false"), model).count() == 0


def test_nothing_to_learn(spark):
    docs = spark.createDataFrame([(1, "abc", None), (2, None, "en")], "doc_id long, text string, lang string")
    model = learn(docs)
    assert [(r.lang_pred, r.score) for r in languages(docs, model, spans=True).collect()] == [(UNKNOWN, 0.0)] * 2
    assert [r.lang_pred for r in languages(docs, fit([("en", ["abc"])], 10)).collect()] == ["en", UNKNOWN]
