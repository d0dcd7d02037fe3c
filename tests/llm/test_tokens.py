"""Token operators against the tokenizer library and a plain segmentation."""

import random

import numpy as np
import public_tokenizers
import pytest
import regex
import tiktoken
from brute import documents, frame, sha
from loglode.llm.byte_bpe import decode, encode, merge, read_ranks
from loglode.llm.token_counts import count_tokens, token_counts, zipf_scores


@pytest.fixture(scope="module")
def ranks():
    return read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))


@pytest.fixture(scope="module")
def library(ranks):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_merge(ranks, library):
    rng = random.Random(1)
    for _ in range(400):
        word = "".join(rng.choice("abcdeéßthing日") for _ in range(rng.randint(1, 60)))
        assert merge(word.encode(), ranks) == library.encode_ordinary(word)


def test_encode_and_decode(spark, ranks, library):
    rows = [*documents(), (3000, "<|endoftext|> it's 12 345\r\n\n  end  "), (3001, "ab" * 20_000)]
    both = decode(encode(frame(spark, rows), ranks, public_tokenizers.PATTERN), ranks)
    got = [(r.doc_id, r.n_tokens, sha(bytes(r.ids)), bytes(r.decoded)) for r in both.collect()]
    want = []
    for i, text in rows:
        ids = library.encode_ordinary(text or "")
        want.append((i, len(ids), sha(np.array(ids, "<u4").tobytes()), (text or "").encode()))
    assert sorted(got, key=str) == sorted(want, key=str)
    assert encode(frame(spark, rows).where("false"), ranks, public_tokenizers.PATTERN).count() == 0


def test_words_are_exchanged_once_and_do_not_reach_the_reassembly(spark, ranks):
    encoded = encode(frame(spark, documents()), ranks, public_tokenizers.PATTERN)
    encoded.collect()
    plan = encoded._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("ReusedExchange") == 1 and "isnotnull(sequence" in plan


def best_count(word, scores):
    best = [(0.0, 0)] + [(-1e18, 0)] * len(word)
    for i in range(1, len(word) + 1):
        for j in range(i):
            if word[j:i] in scores:
                s = best[j][0] + scores[word[j:i]]
                if s > best[i][0] or s == best[i][0] and best[j][1] + 1 < best[i][1]:
                    best[i] = (s, best[j][1] + 1)
    return best[-1][1]


def test_token_counts(spark, ranks):
    scores, rows = zipf_scores(ranks), documents(seed=6)
    find = regex.compile(public_tokenizers.PATTERN).findall
    known = {w: best_count(w.encode(), scores) for _, t in rows for w in find(t or "") if len(w) < 1000}
    got = {(r.doc_id, r.n_pretokens, r.n_tokens) for r in token_counts(frame(spark, rows), scores, public_tokenizers.PATTERN).collect() if r.doc_id != 2007}
    assert got == {(i, len(find(t or "")), sum(known[w] for w in find(t or ""))) for i, t in rows if i != 2007}


def test_prefixes_are_shared_without_changing_counts(ranks):
    scores = zipf_scores(ranks)
    words = [b"in", b"inter", b"internal", b"international", b"internet", b"zebra", b"\xff\xfe"]
    assert count_tokens(words, scores) == {w: best_count(w, scores) for w in words}
    assert count_tokens([b"abc"], {b"a": -1.0}) == {b"abc": 3}
