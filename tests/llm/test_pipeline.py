"""The pipeline against its stages done plainly, and the registered queries."""

import duckdb
import numpy as np
import public_tokenizers
import tiktoken
from brute import cut, least_errors, near_groups, sha, substring

import corpus_pipeline
from loglode.llm import queries
from loglode.llm.byte_bpe import read_ranks
from loglode.llm.decontaminate import normal

SF = "/root/testdata/sf0.001"


def test_pipeline(spark):
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    good = {r[0] for r in con.execute(f"SELECT doc_id FROM ({queries.SQL['op8_quality_rules']}) WHERE kept").fetchall()}
    docs = [r for r in con.execute("SELECT doc_id, text FROM documents").fetchall() if r[0] in good]
    group, _ = near_groups(docs)
    docs = [d for d in docs if group[d[0]] == d[0]]
    docs = [(i, cut(t, gone) if any(gone) else t) for (i, t), (_, gone) in zip(docs, substring(docs), strict=True)]
    items = [normal(t) for (t,) in con.execute("SELECT text FROM benchmark").fetchall()]
    pieces = lambda p: {p[k : k + 8] for k in range(len(p) - 7)}
    leaked = set()
    for i, t in docs:
        text = normal(t)
        have = pieces(text)
        if any(len(pieces(p) & have) * 4 > len(p) and least_errors(p, text) <= len(p) * 8 // 100 for p in items):
            leaked.add(i)
    ranks = read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = {}
    for i, t in docs:
        if i not in leaked:
            ids = library.encode_ordinary(t)
            want[i] = (len(ids), sha(np.array(ids, "<u4").tobytes()), sha(t))
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in corpus_pipeline.run(spark, SF).collect()}
    assert got == want and leaked and len(want) > 100


def test_queries_are_registered():
    numbers = {n.split("_")[0] for n in queries.QUERIES}
    assert {f"op{k}" for k in range(1, 14)} | {"pipeline"} == numbers
    assert len(corpus_pipeline.STAGES) == 5
