"""Numbering over many tasks, and digest trees."""

import random

import pytest
from pyspark.sql import functions as F

from loglode.operators import manifest as M
from loglode.operators.registry import version_history
from loglode.plans.numbering import numbered


@pytest.fixture
def many_tasks(spark):
    names = ["spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.shuffle.partitions"]
    old = [spark.conf.get(n) for n in names]
    for n, v in zip(names, ["false", "7"], strict=True):
        spark.conf.set(n, v)
    yield spark
    for n, v in zip(names, old, strict=True):
        spark.conf.set(n, v)


def test_numbers_of_a_large_group_come_from_many_tasks(many_tasks):
    spark = many_tasks
    rng = random.Random(2)
    rows = [(0 if i % 2 else rng.choice([None, *range(1, 40)]), rng.randint(0, 400), i) for i in range(3000)]
    df = spark.createDataFrame(rows, "g int, at int, id int").repartition(5)
    out = numbered(df, ["g"], ["at", "id"], previous={"before": F.col("id")})
    tasks = out.filter("g = 0").select(F.spark_partition_id().alias("t")).distinct().count()
    got = {r["id"]: (r["row_no"], r["before"]) for r in out.collect()}
    want = {}
    for g in {r[0] for r in rows}:
        own = sorted((at, i) for k, at, i in rows if k == g)
        want |= {i: (n, own[n - 2][1] if n > 1 else None) for n, (_, i) in enumerate(own, 1)}
    assert got == want and tasks > 2
    assert numbered(df.filter("false"), ["g"], ["at", "id"]).count() == 0


def test_version_history_of_a_large_machine(many_tasks):
    rows = [("m" if i % 2 else f"x{i % 9}", f"v{i:04d}", i // 3) for i in range(600)]
    versions = many_tasks.createDataFrame(rows, "machine_id string, version_id string, created_at int")
    got = [tuple(r) for r in version_history(versions).filter("machine_id = 'm'").orderBy("version_no").select("version_no", "version_id", "previous_version_id").collect()]
    own = [f"v{i:04d}" for i in range(1, 600, 2)]
    assert got == [(n + 1, v, own[n - 1] if n else None) for n, v in enumerate(own)]


ENTRIES = "path string, type string, size long, sha256 string, link_target string, error string"


def test_only_buckets_that_differ_are_read(spark, tmp_path):
    rows = [(f"src/{i}.py", "file", i, f"{i:064d}", None, None) for i in range(800)]
    a = spark.createDataFrame(rows, ENTRIES)
    changed = [(p, t, s + 1 if s == 17 else s, d, x, e) for p, t, s, d, x, e in rows if s != 30] + [("new.py", "file", 1, "0", None, None)]
    b = spark.createDataFrame(changed, ENTRIES)
    M.write_tree(a, str(tmp_path / "a"))
    M.write_tree(b, str(tmp_path / "b"))
    found = M.compare_trees(spark, str(tmp_path / "a"), str(tmp_path / "b"))
    plan = found._jdf.queryExecution().toString()
    assert "PartitionFilters: [folder" in plan or "PartitionFilters: [isnotnull(folder" in plan or "folder#" in plan.split("PartitionFilters: ")[1][:40]
    wrong = sorted(map(str, found.filter("status <> 'identical'").collect()))
    assert wrong == sorted(map(str, M.compare_manifests(a, b).filter("status <> 'identical'").collect())) and len(wrong) == 3
    assert found.count() < 40
    whole = M.compare_trees(spark, str(tmp_path / "a"), str(tmp_path / "b"), identical=True)
    assert sorted(map(str, whole.collect())) == sorted(map(str, M.compare_manifests(a, b).collect()))
    digests = M.tree_digests(a, ())
    assert M.differing_buckets(digests, M.tree_digests(a.repartition(3), ())).count() == 0
    assert digests.filter("bucket = ''").first()["n_entries"] == 800


def test_facts_of_a_batch_are_held_in_pieces():
    import tracemalloc

    import pyarrow as pa

    from loglode.operators import syntax

    source = "".join(f'def f{i}(x):\n    logger.error("a failed for %s" % x)\n    raise ValueError("b")\n\n' for i in range(60))
    texts = pa.array([source] * (600_000 // len(source)) + [None, "def x(:\n"])
    tracemalloc.start()
    facts = syntax._facts_batch(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(facts) == len(texts) and facts[0].as_py() == pa.array([syntax.source_facts(source)], type=syntax._FACTS)[0].as_py()
    assert facts[-2].as_py()["parsed"] and not facts[-1].as_py()["parsed"] and peak < 10_000_000


def test_facts_leave_a_large_batch_piece_by_piece(spark):
    import tracemalloc

    import pyarrow as pa

    from loglode.operators import syntax

    source = "".join(f'def f{i}(x):\n    logger.error("a failed for %s" % x)\n    raise ValueError("b")\n\n' for i in range(60))
    texts = pa.array([source] * (3_000_000 // len(source)) + [None, "def x(:\n"])
    held = pa.total_allocated_bytes()
    tracemalloc.start()
    n, most = 0, 0
    for piece in syntax._facts_stream(iter([texts, texts.slice(0, 0), texts.slice(0, 3)])):
        n, most = n + len(piece), max(most, pa.total_allocated_bytes() - held)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    # The texts of the batch are 3 MB, their facts some 8 MB.
    assert n == len(texts) + 3 and peak < 10_000_000 and most < 3_000_000
    rows = spark.createDataFrame([(i, source if i % 7 else None) for i in range(400)], "id int, text string").repartition(2)
    found = syntax.with_facts(rows).selectExpr("id", "facts.parsed", "size(facts.functions) AS n").collect()
    assert sorted(map(tuple, found)) == [(i, True, 60 if i % 7 else 0) for i in range(400)]


def test_call_records_cut_their_lines_where_the_file_is(spark):
    from loglode.operators import inventory as I

    text = 'print("a")\nx = 1\n\nlogger.error("b")\r\nprint("c")'
    files = spark.createDataFrame([("a.py", text), ("b.py", None), ("c.py", "def x(:\n")], "path string, text string")
    plan = I.call_records(I.python_calls(files, context_lines=1))
    joined = I.call_records(I.python_calls(files), files=files, context_lines=1)
    assert sorted(map(tuple, plan.collect())) == sorted(map(tuple, joined.collect())) and plan.count() == 3
    steps = plan._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in steps and "Exchange" not in steps and steps.count("ArrowEvalPython") == 1


def test_an_index_is_not_gathered_by_a_guess_of_its_size(spark):
    from loglode.operators.index_search import exact_groups, prepare_queries
    from loglode.session import shared_folder

    shared_folder(spark)
    known = {"machine_id": "m", "version_id": "v", "path": "p", "fn_seq": 0, "error_pos": 0, "error_key": "bad value",
             "chunk_id": "c", "original_message": "Bad value"}
    postings = spark.range(1).select(*[F.lit(v).alias(k) for k, v in known.items()])
    postings, chunks = postings.checkpoint(), postings.select("machine_id", "version_id", "chunk_id").checkpoint()
    asks = spark.createDataFrame([("q", "m", "v", "bad value")], "query_id string, machine_id string, version_id string, message string")
    found = exact_groups(prepare_queries(asks), postings, chunks)
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    assert [r["error_key"] for r in found.collect()] == ["Bad value"]


def test_a_store_that_grew_is_read_anew_in_the_same_plan(spark, tmp_path):
    from loglode.operators.facts import stored_chunks, update_facts

    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        trees = [spark.createDataFrame([(f"{i}.py", f"def f{i}(x):\n    return x\n" * (k if i == 3 else 1)) for i in range(6)],
                                       "path string, text string") for k in (1, 2)]
        store, rows = str(tmp_path / "a store"), []
        for step, tree in enumerate(trees):
            update_facts(tree, store)
            rows.append(stored_chunks(tree, store).agg(F.count(F.lit(1)).alias("n")).select(F.lit(step).alias("step"), "n"))
        assert sorted(map(tuple, rows[0].unionByName(rows[1]).collect())) == [(0, 6), (1, 7)]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
