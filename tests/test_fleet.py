"""Audit, inventory, manifests, trees, registry, pipeline, streams."""

import hashlib
import os

from pyspark.sql import functions as F

from loglode.functions import paths as P
from loglode.functions.display import confidence_percent, human_bytes, human_time, report_text, select_match
from loglode.operators import audit as A
from loglode.operators import discover as V
from loglode.operators import inventory as I
from loglode.operators import manifest as M
from loglode.operators import registry as R
from loglode.operators import rollups
from loglode.operators.syntax import source_facts
from loglode.plans.analyze import analyze, unsearchable
from loglode.session import tune
from loglode.sources import documents as D
from loglode.sources import tree as T
from loglode.streaming import logs as S

AUDITED = '''import logging, structlog
from logging import getLogger as gl
from app.logcfg import make
logging.basicConfig(level=1)
log = logging.getLogger("uvicorn")
a = gl(__name__)
b = structlog.get_logger()
c = make()
class X:
    def f(self, msg):
        self.log = logging.getLogger("x")
        log.info("a")
        a.error("x %s" % msg, exc_info=True)
        b.warn("w")
        c.fatal("lib" + "rary")
        self.log.exception(msg)
        unk.error("u {}".format(print("inner")))
        a.info(unk2.error("hidden"))
        app.logger.error(f"fs {msg}")
        try:
            pass
        except:
            traceback.print_exc()
if __name__ == "__main__":
    logging.basicConfig(format=JSONFormatter)
'''


def audited(spark):
    files = spark.createDataFrame([("a.py", AUDITED), ("b.py", 'print "old"\nlogger.error("x %s" % f("y"), 1)\nlog.warn("a"); log.info(x)\n')], "path string, text string")
    facts = A.production_facts(files).persist()
    bindings = A.logger_bindings(facts)
    return facts, bindings, A.audited_calls(facts, bindings)


def test_audit(spark):
    facts, bindings, calls = audited(spark)
    got = {r["line_no"]: (r["system"], r["level"]) for r in calls.filter("what = 'log'").collect()}
    assert got == {
        12: ("framework", "info"), 13: ("stdlib", "error"), 14: ("structlog", "warning"), 15: ("stdlib", "critical"),
        16: ("stdlib", "exception"), 17: ("generic", "error"), 18: ("stdlib", "info"), 19: ("framework", "error"),
    }
    templates = {r["line_no"]: (r["template"], r["kind"]) for r in A.error_templates(calls).collect()}
    assert templates == {
        13: ("x %s", "static"), 15: ("library", "static"), 16: ("<var:msg>", "dynamic"), 17: ("u {}", "static"), 19: ("<unknown>", "unknown"),
    }
    configs = [(r["line_no"], r["is_guarded"], r["has_json_formatting"]) for r in A.log_configs(facts).orderBy("line_no").collect()]
    assert configs == [(4, False, True), (25, True, True)]
    rows = A.counted_calls(calls, A.fallback_calls(facts))
    totals = {r["metric"]: r["value"] for r in A.usage_totals(facts, bindings, calls, rows).collect()}
    assert totals["print_calls"] == 2 and totals["exc_info_calls"] == 1 and totals["bare_except_blocks"] == 1
    assert totals["stdlib_get_logger"] == 3 and totals["traceback_calls"] == 1
    found = A.findings(rows, A.file_counts(rows), A.error_templates(calls), A.log_configs(facts), bindings).first()
    assert found["multiple_basic_config"] and not found["levels_match"] and found["level_sum"] - found["total_calls"] == 2
    assert [r["template"] for r in A.fallback_templates(facts).collect()] == ["y"]


def test_inventory(spark):
    js = 'console.log("hi" + x);\nLOG.warn(`t ${x}`)\nprintf("%d", 1);\nLOG_ERR("q")\nnothing("x")\n'
    files = spark.createDataFrame([("a.py", AUDITED), ("c.js", js)], "path string, text string")
    calls = I.log_calls(files).persist()
    assert [r["kind"] for r in calls.filter("path = 'c.js'").orderBy("line_no").collect()] == ["js_console", "generic_logger", "c_printf_family", "c_log_macro"]
    row = calls.filter("path = 'a.py' and line_no = 15").first()
    assert row["string_literals"] == ["lib", "rary"] and row["dynamic_reasons"] == ["python_concat", "python_non_literal_args"]
    summary = {r["message"]: (r["kind"], r["count"]) for r in I.message_summary(calls).collect()}
    assert summary["x %s"] == ("template", 1) and "a" not in summary


def test_tree_scan_manifest_and_roots(spark, tmp_path):
    root = tmp_path / "r"
    for d in ("pkg/sub", "node_modules/x", ".git"):
        os.makedirs(root / d)
    (root / "pkg/__init__.py").write_text("a = 1\n")
    (root / "pkg/sub/m.py").write_text("def f():\n    log.error('boom happened here')\n")
    (root / "setup.py").write_text("")
    (root / "node_modules/x/a.py").write_text("boom happened here")
    (root / "bad.py").write_bytes(b"\xff abc")
    os.symlink(root / "pkg", root / "link")
    os.symlink(root / "setup.py", root / "l.py")
    listing = T.list_tree(spark, [str(root)], P.SEARCH_EXCLUDED_DIRS)
    reason = P.scan_skip_reason(F.col("path"), F.col("length"), F.col("is_symlink"), [".py"], P.SEARCH_EXCLUDED_DIRS)
    listing = listing.withColumn("skip_reason", T.scan_reason(reason))
    files = T.with_text(T.with_content(listing.filter("type = 'file' and skip_reason is null"))).persist()
    assert {r["path"]: r["text"] for r in files.collect()}["bad.py"] == "\ufffd abc"
    assert {r["path"] for r in files.collect()} == {"pkg/__init__.py", "pkg/sub/m.py", "setup.py", "bad.py"}
    stats = V.scan_stats(listing.filter("type <> 'dir'")).first()
    assert (stats["files_scanned"], stats["files_skipped_symlink"], stats["files_skipped_excluded_dir"]) == (4, 2, 2)

    whole = T.list_tree(spark, [str(root)])
    roots = {r["path"]: r["score"] for r in V.code_roots(whole).collect()}
    assert roots == {"": 100 + 40 + 3, "pkg": 1, "pkg/sub": 1}
    entries = M.manifest_entries(T.with_content(whole), ("root",)).persist()
    rows = sorted((r.asDict() for r in entries.collect()), key=lambda r: r["path"])
    assert "link" not in {r["path"] for r in rows} and "l.py" in {r["path"] for r in rows}
    text = "\n".join("|".join(f"{k}:{r[k]}" for k in sorted(r) if k != "root" and r[k] is not None) for r in rows)
    assert M.tree_fingerprint(entries, "root").first()["fingerprint"] == hashlib.sha256(text.encode()).hexdigest()
    same = M.compare_summary(M.compare_manifests(entries, entries)).first()
    assert same["is_identical"] and same["total_paths"] == len(rows)
    out = str(tmp_path / "manifest")
    M_lines = D.manifest_lines(entries)
    M_lines.write.text(out)
    assert M.compare_summary(M.compare_manifests(entries, D.read_manifest(spark, out))).first()["is_identical"]

    block = "x\n2025-12-19T05:22:06+11:00 RS1 K0: <E> [#4] Per: boom happened here\n"
    blocks = spark.createDataFrame([("b1", block), ("b2", "")], "block_id string, text string")
    found = analyze(blocks, files.select("path", "text")).persist()
    row = found.first()
    assert found.count() == 1 and (row["path"], row["line_no"], row["name"]) == ("pkg/sub/m.py", 2, "f")
    assert row["summary_text"].splitlines()[1:] == ["Match info: exact_message, 100%, m.py:2", "Log literal key: boom happened here", "Component: Per"]
    assert unsearchable(blocks).first()["block_id"] == "b2"
    assert '"selected"' in D.result_bundle(found, ["block_id"], 10).first()["bundle"]
    assert "Selected Match" in found.select(report_text(F.lit(True)).alias("t")).first()["t"]
    assert select_match(found, 0, ["block_id"]).count() == 1 and select_match(found, 1, ["block_id"]).count() == 0


def walk(events):
    """Registry rule step by step: (op, version) in order to the active version."""
    alive, active = {}, None
    for i, (op, v) in enumerate(events):
        if op == "upload":
            alive[v], active = i, v
        elif op == "activate" and v in alive:
            active = v
        elif op == "delete" and v in alive:
            del alive[v]
            if active == v:
                active = max(alive, key=alive.get) if alive else None
    return active


def test_dead_version_cannot_be_activated(spark):
    events = [("upload", "A"), ("upload", "C"), ("upload", "B"), ("activate", "A"), ("delete", "B"), ("activate", "B")]
    rows = [("m", v, op, i) for i, (op, v) in enumerate(events)]
    df = spark.createDataFrame(rows, "machine_id string, version_id string, op string, ts int")
    assert R.active_versions(df).first()["version_id"] == walk(events) == "A"


def test_long_joins_of_literals_parse():
    for n in (1200, 5000):
        facts = source_facts("import logging\nlogging.error(" + " + ".join(["'a'"] * n) + ")\n")
        assert not facts["parsed"] or len(facts["calls"][0]["args"][0]["parts"]) == n


def test_tune_keeps_what_is_set(spark):
    spark.conf.set("spark.sql.session.timeZone", "Europe/Berlin")
    assert tune(spark).conf.get("spark.sql.session.timeZone") == "Europe/Berlin"
    spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_active_version_matches_walk(spark):
    import random

    rng, rows, want = random.Random(3), [], {}
    for m in range(120):
        alive, events, n = [], [], 0
        for _ in range(rng.randint(1, 9)):
            op = rng.choice(["upload", "upload", "activate", "delete"])
            if op == "upload":
                n += 1
                alive.append(f"v{n}")
                events.append((op, f"v{n}"))
            elif alive:
                v = rng.choice(alive) if op == "delete" else f"v{rng.randint(1, n)}"
                events.append((op, v))
                if op == "delete":
                    alive.remove(v)
        rows += [(m, v, op, i) for i, (op, v) in enumerate(events)]
        if events:
            want[m] = walk(events)
    df = spark.createDataFrame(rows, "machine_id int, version_id string, op string, s long").select("machine_id", "version_id", "op", F.timestamp_seconds("s").alias("ts"))
    assert {r["machine_id"]: r["version_id"] for r in R.active_versions(df).collect()} == want


def test_figures_and_lookups(spark):
    df = spark.createDataFrame([(0.125,), (0.005,), (None,), (1.7,), (-1.0,)], "s double")
    assert [r[0] for r in df.select(confidence_percent(F.col("s"))).collect()] == [12, 0, 0, 100, 0]
    sizes = spark.createDataFrame([(500.0,), (2048.0,), (6339.0,)], "n double").select(human_bytes(F.col("n")), human_time(F.col("n"))).collect()
    assert sizes[1][0] == "2.00 KB" and sizes[2][1] == "1.8 hours 105.7 minutes (6339.00 seconds)".replace("105.7", "45.6")
    roots = spark.createDataFrame([("/",), ("C:\\",), ("/opt",), ("D:",)], "r string")
    assert [r[0] for r in roots.select(P.is_massive_root(F.col("r"))).collect()] == [True, True, False, True]
    occ = spark.createDataFrame([(1, "k"), (2, "k"), (3, "j")], "occurrence_id int, error_key string")
    got = rollups.occurrence_details(occ, occ.filter("occurrence_id = 1")).select("related_id").collect()
    assert sorted((r[0] for r in got), key=str) == [2, None]


def drain(query_df, name, mode="append"):
    q = query_df.writeStream.format("memory").queryName(name).outputMode(mode).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()


def test_streams_equal_their_batch_twins(spark, tmp_path):
    lines = [f"2025-01-01T0{h}:0{m}:00+00:00 RS1 p: <E> [#1] Comp: failed {m % 2}" for h in range(4) for m in range(6)]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.log").write_text("\n".join(lines[:18]) + "\n")
    source = str(tmp_path / "in")
    parsed = S.parsed_stream(S.log_stream(spark, source))
    drain(parsed.select("component", "message", "event_time"), "parsed")
    batch = S.parsed_stream(spark.read.text(source))
    assert sorted(map(str, spark.table("parsed").collect())) == sorted(map(str, batch.select("component", "message", "event_time").collect()))
    drain(S.windowed_counts(parsed), "counts")
    closed = {(str(r["window_start"]), r["key_normalized"], r["n_lines"]) for r in spark.table("counts").collect()}
    every = batch.groupBy(F.window("event_time", "1 hour").alias("w"), "key_normalized").count()
    want = {(str(r["w"]["start"]), r["key_normalized"], r["count"]) for r in every.collect()}
    assert closed and closed < want
    postings = spark.createDataFrame([("m", "v", "failed 1", "c1")], "machine_id string, version_id string, error_key string, chunk_id string")
    keyed = parsed.withColumns({"machine_id": F.lit("m"), "version_id": F.lit("v")})
    drain(S.lookup_stream(keyed, postings).select("error_key", "chunk_id"), "looked")
    assert spark.table("looked").count() == 9
    blocks = parsed.select(F.col("host_or_serial").alias("block_id"), F.col("value").alias("text"), F.col("timestamp").alias("pos"), "event_time")
    drain(S.relevant_line_stream(blocks, ["block_id"], "pos", "text", "event_time", gap="30 minutes"), "blocks")
    assert {r["selected_line"] for r in spark.table("blocks").collect()} == {lines[0], lines[6]}


def test_blocks_that_say_the_same_share_one_enriched_match(spark, monkeypatch):
    from loglode.plans import analyze as P

    block = "2025-12-19T05:22:06+11:00 RS1 K0: <E> [#4] Per: boom happened here\n"
    blocks = spark.createDataFrame([(f"b{i}", block) for i in range(50)], "block_id string, text string")
    files = spark.createDataFrame([("m.py", "def f():\n    log('boom happened here')\n")], "path string, text string")
    sizes, kept = [], P.cut_lineage
    monkeypatch.setattr(P, "cut_lineage", lambda df: [out := kept(df), sizes.append(out.count())][0])
    found = analyze(blocks, files, max_results=None)
    assert sorted((r["block_id"], r["line_no"], r["name"], r["component"]) for r in found.collect()) == sorted((f"b{i}", 2, "f", "Per") for i in range(50))
    assert sizes[-1] == 1


def test_equal_blocks_are_parsed_once_and_meet_matches_in_lists(spark, monkeypatch):
    from loglode.plans import analyze as P

    block = "2025-12-19T05:22:06+11:00 RS1 K0: <E> [#4] Per: boom happened here\n"
    blocks = spark.createDataFrame([(f"b{i}", block) for i in range(300)] + [("c", "x"), ("d", None)], "block_id string, text string")
    files = spark.createDataFrame([(f"m{i}.py", "def f():\n    log('boom happened here')\n") for i in range(40)], "path string, text string")
    seen, parse = [], P.analyze_blocks
    monkeypatch.setattr(P, "analyze_blocks", lambda df: [seen.append(df.count()), parse(df)][1])
    monkeypatch.setattr(P, "SLICE", 50)
    found = analyze(blocks, files, max_results=None)
    assert sorted((r["block_id"], r["path"], r["level"]) for r in found.collect()) == sorted((f"b{i}", f"m{j}.py", "E") for i in range(300) for j in range(40))
    assert seen == [2]
