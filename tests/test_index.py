"""Chunks, documents, index search."""

import random

from pyspark.sql import functions as F

from loglode.functions.scoring import phrase_score, significant_tokens
from loglode.operators.chunks import error_postings, function_chunks, index_totals
from loglode.operators.facts import file_facts, stored_chunks, update_facts
from loglode.operators.index_search import Limits, group_chunks, prepare_queries, ranked, search_index
from loglode.operators.word_index import build_words, read_words, words_with, write_words
from loglode.operators import load
from loglode.operators.registry import active_versions
from loglode.sources import documents as D
from loglode.sources.fragments import checked_versions, document_fragments, fragment_chunks, fragment_postings, read_fragments, write_fragments

KEY = ("machine_id", "version_id", "path")
SOURCE = '''import logging
# above
def f(a,
      b):
    """Doc."""
    logger.error("top %s" % a)
    if a:
        raise ValueError("bad value")
    else:
        def hidden(): pass
    print("an error here", "fine")
    logger.info("x {}".format(b), "y", f"no {a}")
    def inner():
        logger.warning("Inner Warn ")
    return inner

class K:
    @staticmethod
    async def m(self):
        logger.fatal("ignored")
        logger.critical("")
'''
MESSAGES = "array<struct<message:string,log_level:string,source_type:string>>"
CHUNKS = (
    "machine_id string, version_id string, chunk_id string, path string, fn_seq int, function_name string, code string, "
    f"docstring string, leading_comment string, error_messages {MESSAGES}"
)


def sources(spark):
    return spark.createDataFrame(
        [("m", "v", "a.py", SOURCE), ("m", "v", "bad.py", "def x(:\n")], "machine_id string, version_id string, path string, text string"
    )


def test_function_chunks(spark):
    rows = {r["function_name"]: r for r in function_chunks(sources(spark), KEY).collect()}
    assert set(rows) == {"f", "inner", "m"}
    f = rows["f"]
    assert (f["signature"], f["line_start"], f["line_end"], f["docstring"]) == ("def f(a, b):", 3, 15, "Doc.")
    assert f["leading_comment"] == "# above" and f["log_levels"] == ["E", "I", "W"] and len(f["chunk_id"]) == 16
    said = [(e["message"], e["log_level"], e["source_type"]) for e in f["error_messages"]]
    assert said == [
        ("top %s", "E", "logging_format"),
        ("bad value", "E", "exception"),
        ("an error here", "E", "print"),
        ("x {}", "I", "logging_format_template"),
        ("y", "I", "logging"),
        ("Inner Warn ", "W", "logging"),
    ]
    m = rows["m"]
    assert (m["class_name"], m["signature"], m["error_messages"], m["leading_comment"]) == ("K", "async def m(self):", [], None)
    assert "hidden" in {r["function_name"] for r in function_chunks(sources(spark), KEY, deep=True).collect()}


def test_postings_and_totals(spark):
    chunks = function_chunks(sources(spark), KEY)
    keys = [r["error_key"] for r in error_postings(chunks, KEY).collect()]
    assert keys.count("inner warn") == 2 and len(keys) == 7
    row = index_totals(sources(spark), chunks, ("machine_id",)).first()
    assert (row["files_processed"], row["files_failed"], row["functions_found"], row["errors_found"]) == (1, 1, 3, 7)


def test_document_roundtrip_and_rejects(spark):
    chunks = function_chunks(sources(spark), KEY)
    totals = index_totals(sources(spark), chunks, ("machine_id", "version_id"))
    good = D.index_document(chunks, error_postings(chunks, KEY), totals, "2024-01-01T00:00:00Z")
    bad = [
        ("a", '{"chunks": {}, "error_index": [], "stats": {}, "schema_version": "1", "created_at": "2024-01-01T00:00:00Z"}'),
        ("b", "nope"),
        ("c", '{"schema_version": "", "created_at": "xx", "chunks": [], "error_index": {}, "stats": {}, "total_chunks": 2, "total_errors": 1}'),
        ("d", '{"schema_version": "1", "created_at": "2024-01-01T00:00:00Z", "chunks": [], "error_index": {}, "stats": {}}'),
    ]
    docs = good.unionByName(spark.createDataFrame([("m", v, x) for v, x in bad], "machine_id string, version_id string, value string"))
    checked = D.with_violations(D.parse_documents(docs))
    got = {r["version_id"]: r["violations"] for r in checked.collect()}
    assert got["v"] == [] and got["d"] == [] and got["b"] == ["Invalid JSON"] and len(got["c"]) == 4
    assert got["a"] == ["Field 'chunks' must be an array", "Field 'error_index' must be an object"]
    assert D.document_postings(checked.filter("version_id = 'v'")).count() == 7
    assert D.document_chunks(checked.filter("version_id = 'v'")).count() == 3


def test_stored_index_prunes(spark, tmp_path):
    chunks = function_chunks(sources(spark), KEY)
    D.write_index(chunks, str(tmp_path / "chunks"))
    D.write_index(chunks.withColumn("version_id", F.lit("w")), str(tmp_path / "chunks"))
    assert D.read_index(spark, str(tmp_path / "chunks")).count() == 6
    one = D.read_index(spark, str(tmp_path / "chunks"), "m", "w")
    assert one.count() == 3 and "PartitionFilters: [isnotnull(machine_id" in one._jdf.queryExecution().toString()


def small_index(spark):
    def chunk(i, path, code, *messages):
        return ("m", "v", f"chunk_{i:03d}", path, i, "f", code, None, None, [(m, "E", "logging") for m in messages])

    rows = [
        chunk(1, "src/utils/connection.py", "sock = socket.connect(host)", "Connection failed", "unable to establish connection"),
        chunk(2, "src/utils/connection.py", "socket = 1 # host", "Reconnection attempt failed"),
        chunk(3, "src/p.py", "pass", "Printer not connected"),
    ]
    chunks = spark.createDataFrame(rows, CHUNKS)
    return chunks, error_postings(chunks, KEY)


def ask(spark, *messages):
    return spark.createDataFrame([(i, "m", "v", m) for i, m in enumerate(messages)], "query_id int, machine_id string, version_id string, message string")


def test_search_tiers(spark):
    chunks, postings = small_index(spark)
    asked = ask(spark, "Printer  NOT connected", "connection", "socket connect host", "the of", "")
    got = [(r["query_id"], r["match_type"], r["error_key"], round(r["score"], 4), r["n_chunks"]) for r in ranked(search_index(asked, postings, chunks)).collect()]
    assert got == [
        (0, "exact", "Printer not connected", 1.0, 1),
        (0, "partial", "printer not connected", 1.0, 1),
        (1, "partial", "connection failed", 0.5353, 1),
        (1, "partial", "unable to establish connection", 0.2833, 1),
        (1, "partial", "reconnection attempt failed", 0.1481, 1),
        (2, "code_search", "Code match in src/utils/connection.py", 0.8, 2),
    ]
    once = search_index(asked, postings, chunks, repeat_mixed_case=False)
    assert once.filter("query_id = 0").count() == 1
    members = group_chunks(once, asked, postings, chunks).orderBy("query_id", "error_key", "place").collect()
    assert [(r["query_id"], r["match_type"], r["place"], r["chunk_id"]) for r in members] == [
        (0, "exact", 1, "chunk_003"),
        (1, "partial", 1, "chunk_001"),
        (1, "partial", 1, "chunk_002"),
        (1, "partial", 1, "chunk_001"),
        (2, "code_search", 1, "chunk_001"),
        (2, "code_search", 2, "chunk_002"),
    ]


def test_words_of_short_and_odd_tokens(spark):
    chunks, postings = small_index(spark)
    words = build_words(postings, chunks)
    asked = [("v", "c"), ("v", "nn"), ("v", "connect"), ("w", "connect"), ("v", ""), ("v", "zzz"), ("v", "c")]
    tokens = spark.createDataFrame([("m", v, t) for v, t in asked], "machine_id string, version_id string, token string")
    got = sorted((r["token"], r["word"], r["n_places"]) for r in words_with(tokens, words, "key").collect())
    held = [("connected", 1), ("connection", 2), ("reconnection", 1)]
    assert got == [(t, *w) for t in ("c", "connect", "nn") for w in held]
    short = search_index(ask(spark, "n", "ti", "no"), postings, chunks).collect()
    keys = [r["error_key"] for r in postings.collect()]
    assert sorted((r["query_id"], r["error_key"]) for r in short) == sorted((i, k) for i, q in enumerate(["n", "ti", "no"]) for k in keys if q in k)


def test_partial_search_equals_nested_loop(spark):
    rng = random.Random(9)
    say = lambda: " ".join("".join(rng.choice("abc") for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(1, 4)))
    rows = [("m", v, f"c{v}{i:03d}", "a.py", i, "f", "pass", None, None, [(say(), "E", "logging") for _ in range(3)]) for v in ("v", "w") for i in range(40)]
    chunks = spark.createDataFrame(rows, CHUNKS)
    postings = error_postings(chunks, KEY)
    asked = spark.createDataFrame([(i, "m", rng.choice("vw"), say()) for i in range(60)], "query_id int, machine_id string, version_id string, message string")
    found = search_index(asked, postings, chunks, limits=Limits(None, None, None)).filter("match_type = 'partial'")
    keys = {(r["version_id"], r["error_key"]) for r in postings.collect()}
    exact = {(q["query_id"], k) for q in asked.collect() for v, k in keys if v == q["version_id"] and k == q["message"]}
    want = {(q["query_id"], k) for q in asked.collect() for v, k in keys if v == q["version_id"] and q["message"] in k} - exact
    assert {(r["query_id"], r["error_key"]) for r in found.collect()} == want and len(want) > 40


def test_word_index_is_updated_by_version(spark, tmp_path):
    chunks, postings = small_index(spark)
    write_words(build_words(postings, chunks), str(tmp_path / "words"))
    other = [df.withColumn("version_id", F.lit("w")) for df in (postings, chunks)]
    write_words(build_words(*other), str(tmp_path / "words"))
    write_words(build_words(other[0].limit(0), other[1].filter("chunk_id = 'chunk_003'")), str(tmp_path / "words"))
    stored = read_words(spark, str(tmp_path / "words"))
    asked = ask(spark, "connection", "socket connect host")
    got = search_index(asked, postings, chunks, stored).select("query_id", "error_key").collect()
    assert sorted(got) == sorted(search_index(asked, postings, chunks).select("query_id", "error_key").collect())
    assert {r[0] for r in read_words(spark, str(tmp_path / "words"), "m", "w").places.filter("kind = 'chunk'").select("id").distinct().collect()} == {"chunk_003"}


def phrase_twin(query, text):
    stop = {"the", "and", "for", "with"}
    if query in text:
        return 1.0
    tokens = [t for t in query.split() if len(t) > 2 and t not in stop]
    share = sum(t in text for t in tokens) / len(tokens) if tokens else 0.0
    if share < 0.5:
        return 0.0
    ordered = [text.find(b, text.find(a)) > text.find(a) >= 0 for a, b in zip(tokens, tokens[1:])]
    return 0.6 * share + (0.4 * sum(ordered) / len(ordered) if ordered else 0.0)


def test_phrase_score_matches_twin(spark):
    rng = random.Random(5)
    pick = lambda n: " ".join(rng.choice(["the", "pump", "valve", "low", "flow", "ab", "for", "valves"]) for _ in range(n))
    rows = [(pick(rng.randint(1, 5)), pick(rng.randint(0, 9))) for _ in range(400)]
    df = spark.createDataFrame(rows, "q string, t string").withColumn("sig", significant_tokens(F.col("q")))
    for r in df.withColumn("s", phrase_score(F.col("q"), F.col("sig"), F.col("t"))).collect():
        assert abs(r["s"] - phrase_twin(r["q"], r["t"])) < 1e-9, r


def test_prepare_drops_empty(spark):
    assert prepare_queries(ask(spark, "", "x")).count() == 1


def test_facts_are_parsed_once_by_content(spark, tmp_path):
    store = str(tmp_path / "facts")
    files = sources(spark).union(spark.createDataFrame([("m", "v", "b.py", SOURCE), ("m", "v", "empty.py", ""), ("m", "v", "null.py", None)], sources(spark).schema))
    assert update_facts(files, store, KEY) == 3 and update_facts(files, store, KEY) == 0
    want = function_chunks(files.filter("text IS NOT NULL"), KEY)
    got = stored_chunks(files, store, KEY)
    assert sorted(map(str, got.select(sorted(got.columns)).collect())) == sorted(map(str, want.select(sorted(want.columns)).collect()))
    assert {(r["path"], r["parsed"]) for r in file_facts(files, store, KEY).collect()} == {("a.py", True), ("b.py", True), ("bad.py", False), ("empty.py", True)}
    later = files.withColumn("version_id", F.lit("w")).withColumn("text", F.when(F.col("path") == "b.py", "def g(): pass\n").otherwise(F.col("text")))
    assert update_facts(later, store, KEY) == 1
    assert stored_chunks(later, store, KEY).count() == 4
    # what a run left that ended before its last write is not seen, and is parsed again
    spark.read.parquet(f"{store}/bodies").drop("batch").write.parquet(f"{store}/bodies/batch=broken")
    assert stored_chunks(later, store, KEY).count() == 4


def fragments_of(spark, versions):
    chunks, _ = small_index(spark)
    chunks = chunks.withColumns({"class_name": F.lit(None).cast("string"), "line_start": F.lit(1), "line_end": F.lit(2), "signature": F.lit("def f():"), "log_levels": F.array(F.lit("E"))})
    every = [chunks.withColumn("version_id", F.lit(v)) for v in versions]
    rows = every[0]
    for df in every[1:]:
        rows = rows.unionByName(df)
    totals = rows.groupBy("machine_id", "version_id").agg(
        F.lit(1).alias("files_processed"), F.lit(0).alias("files_failed"), F.count(F.lit(1)).alias("functions_found"), F.lit(4).alias("errors_found"),
        F.count(F.lit(1)).alias("total_chunks"), F.lit(4).alias("total_errors"),
    )
    return document_fragments(rows, error_postings(rows, KEY), totals, "2024-01-01T00:00:00Z")


def test_fragments_come_back_in_order(spark, tmp_path):
    rows = fragments_of(spark, ["v", "w"])
    write_fragments(rows, str(tmp_path / "f"))
    back = read_fragments(spark, str(tmp_path / "f"), "m", "w")
    assert "PartitionFilters: [isnotnull(machine_id" in back._jdf.queryExecution().toString()
    parts = [r["part"] for r in back.orderBy("place").collect()]
    assert parts == ["head"] + ["chunk"] * 3 + ["posting"] * 4
    assert fragment_chunks(back).count() == 3 and fragment_postings(back).orderBy("error_key").first()["path"] == "src/utils/connection.py"
    two = checked_versions(rows.union(rows.filter("part = 'head' AND version_id = 'v'"))).collect()
    assert {r["version_id"]: r["violations"] for r in two} == {"v": ["Invalid JSON"], "w": []}
    lost = checked_versions(rows.filter("NOT (part = 'chunk' AND json LIKE '%chunk_002%')")).first()
    assert lost["violations"] == ["total_chunks does not match chunks"]


def test_a_load_that_breaks_off_changes_nothing(spark, tmp_path):
    path = str(tmp_path / "store")
    rows = fragments_of(spark, ["v", "w"])
    bad = rows.filter("NOT (version_id = 'w' AND part = 'posting')")
    verdicts = load.load_versions(bad, path, "2024-01-01 00:00:00").collect()
    assert {r["version_id"]: len(r["violations"]) for r in verdicts} == {"v": 0, "w": 1}
    see = lambda: sorted((r["version_id"], r["chunk_id"]) for r in load.loaded(spark, path, "chunks").collect())
    before = see()
    assert [v for v, _ in before] == ["v"] * 3
    # staged and not committed: readers see what was there
    staged, _ = load.stage_versions(rows, path)
    assert see() == before and load.loaded(spark, path, "postings").count() == 4
    # rows of the staged version lost: it is not named, the other is
    kept = spark.read.parquet(f"{path}/chunks/load={staged}").filter("NOT (version_id = 'w' AND chunk_id = 'chunk_002')").collect()
    lost = spark.createDataFrame(kept, spark.read.parquet(f"{path}/chunks/load={staged}").schema)
    lost.write.mode("overwrite").parquet(f"{path}/chunks/load={staged}")
    assert [r["version_id"] for r in load.commit_load(spark, path, staged, "2024-01-02 00:00:00").collect()] == ["v"]
    assert see() == before
    load.load_versions(rows, path, "2024-01-03 00:00:00")
    assert [v for v, _ in see()] == ["v"] * 3 + ["w"] * 3
    assert load.events(spark, path).count() == 4


def test_deletions_take_what_belongs_to_them(spark, tmp_path):
    path = str(tmp_path / "store")
    rows = fragments_of(spark, ["v", "w"])
    rows = rows.union(rows.withColumn("machine_id", F.lit("n")))
    load.load_versions(rows, path, "2024-01-01 00:00:00")
    see = lambda: sorted(tuple(r) for r in load.loaded(spark, path, "postings").select("machine_id", "version_id").distinct().collect())
    gone = lambda *rs: spark.createDataFrame(list(rs), "machine_id string, version_id string")
    load.delete(spark, path, gone(("m", "v"), ("zz", None)), "2024-01-02 00:00:00")
    assert see() == [("m", "w"), ("n", "v"), ("n", "w")] and load.stale_loads(spark, path) == []
    load.delete(spark, path, gone(("n", None)), "2024-01-03 00:00:00")
    assert see() == [("m", "w")]
    load.load_versions(rows.filter("machine_id = 'n' AND version_id = 'v'"), path, "2024-01-04 00:00:00")
    assert see() == [("m", "w"), ("n", "v")]
    lives = {tuple(r)[:2] for r in active_versions(load.events(spark, path)).collect()}
    assert ("m", "w") in lives
    target = str(tmp_path / "target")
    assert load.compact(spark, path, target, "2024-01-05 00:00:00").count() == 2
    assert load.loaded(spark, target, "chunks").count() == 6 and load.commits(spark, target).select("load").distinct().count() == 1


def folder_bytes(spark):
    import os
    from urllib.parse import urlparse

    from loglode.session import shared_folder

    walked = os.walk(urlparse(shared_folder(spark)).path)
    return sum(os.path.getsize(os.path.join(folder, f)) for folder, _, files in walked for f in files)


def test_a_word_index_takes_little_more_room_than_its_texts(spark):
    rng = random.Random(4)
    code = " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(40)) for _ in range(1000))
    chunks = spark.createDataFrame([("m", "v", "c1", "a.py", 1, "f", code, None, None, [("Bad value", "E", "logging")])], CHUNKS)
    postings, before = error_postings(chunks, KEY), folder_bytes(spark)
    found = build_words(postings, chunks)
    assert folder_bytes(spark) - before < 3 * len(code)
    tokens = spark.createDataFrame([("m", "v", code[3:30])], "machine_id string, version_id string, token string")
    assert [(r["word"], r["n_places"]) for r in words_with(tokens, found, "chunk").collect()] == [(code[:40], 1)]


def test_group_chunks_asks_no_tier_again(spark, monkeypatch):
    from loglode.operators import index_search as S

    asked, tier = [], S.code_chunks
    monkeypatch.setattr(S, "code_chunks", lambda *a, **k: [asked.append(1), tier(*a, **k)][1])
    chunks, postings = small_index(spark)
    queries = ask(spark, "socket connect host")
    words = build_words(postings, chunks)
    members = group_chunks(search_index(queries, postings, chunks, words), queries, postings, chunks, words)
    assert [(r["place"], r["chunk_id"]) for r in members.orderBy("place").collect()] == [(1, "chunk_001"), (2, "chunk_002")]
    assert len(asked) == 1


def test_fragments_of_many_versions_share_folders(spark, tmp_path):
    path, one = str(tmp_path / "f"), fragments_of(spark, ["v"])
    heads = one.filter("part = 'head'").crossJoin(spark.range(300).select(F.concat(F.lit("v"), "id").alias("other")))
    many = heads.withColumn("version_id", F.col("other")).select(*one.columns)
    write_fragments(many.repartition(1), path)
    assert 32 < len([f for f in (tmp_path / "f" / "machine_id=m").iterdir() if f.is_dir()]) <= 64
    assert [r["version_id"] for r in read_fragments(spark, path, "m", "v17").collect()] == ["v17"]
    # a version written again is replaced, alone
    write_fragments(one.withColumn("version_id", F.lit("v17")), path)
    counts = {r["version_id"]: r["count"] for r in read_fragments(spark, path).groupBy("version_id").count().collect()}
    assert counts == {f"v{i}": 8 if i == 17 else 1 for i in range(300)}
