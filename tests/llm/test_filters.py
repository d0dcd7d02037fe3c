"""Quality rules, decontamination, url rules, shards and licences."""

import random
import zlib
from collections import Counter

from brute import WORD, documents, frame, least_errors
from pyspark.sql import functions as F

from loglode.llm.decontaminate import Matcher, errors_within, leaks, normal, without_leaks
from loglode.llm.licenses import LEAST_PROBABILITY, licence_paragraphs, sample_lines, thresholds
from loglode.llm.quality import keep_good, quality_verdicts
from loglode.llm.sharding import shard_by_bytes
from loglode.llm.url_filter import filter_urls


def counts(text):
    ws = WORD.findall(text or "")
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    seen = Counter(tuple(ws[k : k + 5]) for k in range(len(ws) - 4))
    repeated = {k + j for k in range(len(ws) - 4) if seen[tuple(ws[k : k + 5])] > 1 for j in range(5)}
    return len(ws), sum(map(len, ws)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(repeated)


def test_quality(spark):
    rng = random.Random(5)
    plain = lambda: " ".join(rng.choice(["alpha", "beta", "gamma", "of", "the"]) + str(rng.randrange(900)) for _ in range(60))
    rows = [*documents(), *[(4000 + i, plain()) for i in range(150)], (5000, plain().replace(" ", "%%% ")), (5001, " | ".join("abcde" for _ in range(9)))]
    got = quality_verdicts(frame(spark, rows)).collect()
    key = lambda r: str(r)
    assert sorted([(r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got], key=key) == sorted([(i, *counts(t)) for i, t in rows], key=key)
    for r in got:
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
        assert not (r.base_failed and r.kept)
    kept = {r.doc_id: r.kept for r in got}
    assert all(kept[4000 + i] for i in range(150)) and not kept[5000] and not kept[5001]
    good = keep_good(frame(spark, rows), "doc_id", "text", "lang", "source", "n_chars")
    assert sorted([r.doc_id for r in good.collect()], key=str) == sorted([r.doc_id for r in got if r.kept], key=str)
    assert quality_verdicts(frame(spark, rows).where("false")).count() == 0


def test_leaks(spark):
    rng = random.Random(8)
    text = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(n))
    items = [(k, text(20)) for k in range(8)] + [(8, None), (9, ""), (10, "too short"), (None, text(20)), (11, "")]
    items.append((12, items[0][1]))
    docs = []
    for k in range(60):
        words = text(60)
        if k % 2:
            passage = list(items[k % 8][1])
            for _ in range(k // 5):
                at = rng.randrange(len(passage))
                passage[at : at + rng.randint(0, 1)] = rng.choice(["", "z", "q"])
            words = words[:50] + " " + "".join(passage).upper() + "!\n " + words[50:]
        docs.append((k, words))
    docs += [(100, None), (101, ""), (None, "see " + items[2][1]), (102, items[3][1]), (102, items[3][1])]
    want = Counter()
    for i, d in docs:
        for k, t in items:
            p = normal(t)
            if k is not None and len(p) >= 20 and (e := least_errors(p, normal(d))) <= len(p) * 8 // 100:
                want[(i, k, e)] += 1
    table = spark.createDataFrame(items, "item_id long, text string")
    df = spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, item_id string")
    assert Counter((r.doc_id, r.item_id, r.errors) for r in leaks(df, table).collect()) == want and len(want) > 25
    clean = {r.doc_id for r in without_leaks(df, table, "doc_id", "text").collect()}
    assert clean == {i for i, _ in docs} - {i for i, _, _ in want}
    assert leaks(df, table.where("false")).count() == 0 and leaks(df.where("false"), table).count() == 0


def test_short_items_stand_as_whole_words(spark):
    items = spark.createDataFrame([(1, "What is 7 x 6?"), (2, "cat"), (3, "?!"), (4, "a b")], "item_id long, text string")
    texts = ["So: what is 7 X 6? 42", "concatenate", "The CAT.", "cat", "what is 7 x 61", "c a b", "a ba b", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(map(tuple, leaks(docs, items).collect())) == [(0, 1, 0), (2, 2, 0), (3, 2, 0), (5, 4, 0)]
    assert sorted(r.doc_id for r in without_leaks(docs, items, "doc_id", "text").collect()) == [1, 4, 6, 7]


def test_edit_distance():
    rng = random.Random(3)
    for _ in range(200):
        p, t = ("".join(rng.choice("abc") for _ in range(rng.randint(a, b))) for a, b in ((1, 14), (0, 40)))
        masks = {c: sum(1 << i for i, x in enumerate(p) if x == c) for c in p}
        assert errors_within(masks, len(p), t) == least_errors(p, t)
    assert Matcher([(1, "abcdefghij" * 3)], 8).found("xx" + "abcdefghij" * 3) == [(1, 0)]


def test_urls(spark):
    rules = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("a.example.net", "/en/x", "block"), ("example.net", "/en/long/path/", "block"), ("org", "", "block"), (None, "/", "block"), ("b.org", "/", "allow")]
    urls = [
        "http://example.net/", "https://www.Example.NET/en/1?x=/en/", "http://a.example.net/en/xy#z", "http://notexample.net/en/", "http://example.net/en/long/path/q", "http://net/a",
        "http://b.org", "http://b.org/", "http://x.b.org/?q", "ftp://c.org#f", "no scheme", None, "", "http://", "http:///p", "http://a.b.c.d.example.net/en/long/path/", "http://example.net.evil.com/en/",
    ]
    rows = [(i, u, "h", "p") for i, u in enumerate(urls * 3)] + [(None, "http://net/", "h", "p")]

    def judge(url):
        rest = url.split("://", 1)[1] if url and "://" in url else ""
        host = next(rest[:k] for k in range(len(rest) + 1) if k == len(rest) or rest[k] in "/?#")
        tail = rest[len(host) :]
        path = tail[: min([tail.find(c) for c in "?#" if c in tail], default=len(tail))]
        host = host.lower()
        fits = [(len(h + p), h + p, v) for h, p, v in rules if h is not None and (host == h or host.endswith("." + h)) and path.startswith(p)]
        _, rule, verdict = max(fits, default=(0, None, "allow"))
        return host, path, rule, verdict

    df = spark.createDataFrame(rows, "page_id long, url string, host string, key string")
    got = filter_urls(df, spark.createDataFrame(rules, "host string, path string, verdict string")).collect()
    assert sorted([tuple(r) for r in got], key=str) == sorted([(i, *judge(u)) for i, u, _, _ in rows], key=str)
    none = filter_urls(df, spark.createDataFrame([], "host string, path string, verdict string"))
    assert {r.verdict for r in none.collect()} == {"allow"} and filter_urls(df.where("false"), none.select("host", "path", "verdict")).count() == 0


def test_shards(spark):
    rows = documents() + [(9000 + i, "copy of one text, many times") for i in range(900)] + [(20_000 + i, f"text number {i} " * (i % 40)) for i in range(3000)]
    got = shard_by_bytes(frame(spark, rows)).collect()
    size = lambda t: len((t or "").encode()) + 1
    assert sorted([(r.doc_id, r["size"], r.text_crc32) for r in got], key=str) == sorted([(i, size(t), zlib.crc32((t or "").encode())) for i, t in rows], key=str)
    by_shard = {s: [r for r in got if r.shard == s] for s in range(16)}
    total = sum(r["size"] for r in got)
    for s, members in by_shard.items():
        assert sorted(r.slot for r in members) == list(range(len(members))), s
        assert abs(sum(r["size"] for r in members) - total / 16) < 0.06 * total / 16
    home = {}
    for r in got:
        if r.doc_id is None or r.doc_id < 9000 or r.doc_id >= 20_000:
            home.setdefault((r.text_crc32, r["size"]), set()).add(r.shard)
    assert max(len(x) for x in home.values()) <= 2 and sum(len(x) > 1 for x in home.values()) <= 16
    assert {r.law for r in got} == {"bytes"} and {r.grown_shard for r in got} == {None}
    assert shard_by_bytes(frame(spark, rows).where("false")).count() == 0


def test_shards_of_repeated_rows_are_near_equal(spark):
    rows = [(None, "one text in all rows")] * 20_000 + [(7, "another one")] * 5_000 + [(i, f"text number {i}") for i in range(20_000)]
    got = shard_by_bytes(frame(spark, rows)).groupBy("shard").agg(F.sum("size").alias("b"), F.count("*").alias("n"), F.max("slot").alias("last")).collect()
    total = sum(r.b for r in got)
    assert len(got) == 16 and all(abs(r.b - total / 16) < 0.06 * total / 16 and r["last"] == r.n - 1 for r in got)


def test_licences(spark):
    rows = documents() + [
        (6000, "Words before.\nReleased under the MIT License.\nWords after."), (6001, "Licensed under the Apache License, Version 2.0."),
        (6002, "This work is licensed under the GNU General Public License, version 2."), (6003, "Licensed under CC BY-NC 3.0."), (6004, "He holds a driving license for cars."),
        (6005, "She was released in the spring.\n\nThe general public cheered."), (None, "All rights reserved."),
    ]
    got = Counter((r.doc_id, r.line_no, r.family) for r in licence_paragraphs(frame(spark, rows)).collect())
    assert got == Counter([(6000, 2, "mit"), (6001, 1, "apache"), (6002, 1, "gpl"), (6003, 1, "cc-by-nc"), (None, 1, "reserved")])
    plan = licence_paragraphs(frame(spark, rows))._jdf.queryExecution().toString()
    assert not any(k in plan for k in ("Python", "Arrow", "Pandas"))


WRAPPED = {
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\"), to deal\nin the Software without restriction, including without limitation the rights\nto use, copy, modify, merge, publish, distribute, sublicense, and/or sell\ncopies of the Software.",
    "bsd": "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions\nare met:",
    "gpl": "This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\nthe Free Software Foundation, either version 3 of the License, or\n(at your option) any later version.",
}


def test_wrapped_licences(spark):
    rows, want = documents(), []
    for k, (family, text) in enumerate(WRAPPED.items()):
        lines = text.split("\n")
        for j, mark in enumerate(("", "# ", " * ", "// ", "REM ", "-- ")):
            rows.append((7000 + 10 * k + j, "\n".join(["/*", f"{mark}Copyright 2020 Ann Lee", mark.rstrip(), *[mark + x for x in lines], "*/", "", "int main();"])))
            want.append((7000 + 10 * k + j, 4, family))
    prose = " ".join(f"word{i} then" for i in range(150))
    rows.append((7100, f"{prose} This work is licensed under the GNU General Public License, version 3. {prose}"))  # one long line
    rows.append((7101, f"{prose}\nand so on. The program was released\nunder the MIT License.\n{prose}"))  # wrapped, in no block of its own
    rows.append((7102, "Released under the MIT License.\nReleased under the MIT License.\nReleased under the GNU General Public License."))
    want += [(7100, 1, "gpl"), (7101, 2, "mit"), (7102, 1, "mit"), (7102, 2, "mit"), (7102, 3, "gpl")]
    got = Counter((r.doc_id, r.line_no, r.family) for r in licence_paragraphs(frame(spark, rows)).collect())
    assert got == Counter(want)


def test_licence_calibration(spark):
    # One held line that looks like a licence moves neither its own family's threshold nor another's.
    assert thresholds([(1, 0.99), (2, 0.3)], 300, 3) == [LEAST_PROBABILITY] * 3
    assert thresholds([(1, 0.99), (1, 0.8), (2, 0.99)], 300, 2) == [0.8 + 1e-6, LEAST_PROBABILITY]
    # Copies do not crowd out other texts, and what may be a licence is not taught as unknown.
    rows = [(k, f"copy number {k % 30}") for k in range(3000)] + [(4000 + k, f"text alone {k}") for k in range(30)]
    rows += [(5000, "GNU GPL v3\nMIT\n(c) 2019\nTous droits réservés\nrights all")]
    got = {" ".join(r.words) for r in sample_lines(frame(spark, rows)).collect()}
    assert got == {t for _, t in rows[:30]} | {t for i, t in rows if 4000 <= i < 5000}
