"""Log triage: fields, keys, relevant line; random lines against a row twin."""

import random
import re

import pytest
from pyspark.sql import functions as F

from loglode.functions.logparse import analyze_blocks, normalize_query, relevant_line, with_parsed

INFO = "2025-12-19T05:22:06.751222+11:00 RS100 Unit0: <I> [#4] EngineHub: Changing state from a to maint"
ERROR = "2025-12-19T05:22:07.1+11:00 RS100 Unit0: <E> [#4] IdleLoop: waitComplete for localhost:9210:Dyn-main:VALVE"


def parse(spark, lines, **options):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "i int, line string")
    return [r.asDict() for r in with_parsed(df, "line", **options).orderBy("i").collect()]


def test_info_line(spark):
    row = parse(spark, [INFO])[0]
    assert (row["level"], row["component"], row["thread"]) == ("I", "EngineHub", "#4")
    assert row["timestamp"] == "2025-12-19T05:22:06.751222+11:00"
    assert (row["host_or_serial"], row["process"]) == ("RS100", "Unit0")
    assert row["message"] == "Changing state from a to maint"
    assert row["key_exact"] == "EngineHub: Changing state from a to maint"


def test_error_block_chooses_first_error_line(spark):
    df = spark.createDataFrame([("b", f"\n\t{INFO}\n  {ERROR}\n<E> later: x\n"), ("e", " \n\t\n")], "block_id string, text string")
    got = {r["block_id"]: r for r in analyze_blocks(df).collect()}
    assert got["b"]["selected_line"] == ERROR
    assert got["b"]["component"] == "IdleLoop"
    assert got["b"]["search_message"] == "waitComplete for localhost:9210:Dyn-main:VALVE"
    assert got["e"]["selected_line"] == "" and got["e"]["search_message"] == ""


def test_edge_lines(spark):
    rows = parse(
        spark,
        ["host proc: <W> rest", "a <x> b <y> c", "x [ ] y", ": msg", "comp:", "", "\tonly tabs\t", "2025-01-01T00:00:00Z", "plain words"],
    )
    assert (rows[0]["host_or_serial"], rows[0]["process"], rows[0]["level"], rows[0]["message"]) == ("host", "proc", "W", "rest")
    assert rows[1]["level"] == "x" and rows[1]["message"] == "a b <y> c"
    assert rows[2]["thread"] is None and rows[2]["message"] == "x y"
    assert rows[3]["component"] is None and rows[3]["message"] == "msg"
    assert rows[4]["component"] == "comp" and rows[4]["message"] == "comp:"
    assert rows[5]["message"] == "" and rows[6]["message"] == "only tabs"
    assert rows[7]["timestamp"] == "2025-01-01T00:00:00Z" and rows[7]["message"] == "2025-01-01T00:00:00Z"
    assert rows[8]["component"] is None and rows[8]["message"] == "plain words"


def test_numbers_and_tokens(spark):
    row = parse(spark, ["IdleLoop: valve failed on localhost:9210 code 12345 at 1.5 in 12"], normalize_numbers=True)[0]
    assert row["key_normalized"] == "idleloop: valve failed on localhost:<num> code <num> at <num> in 12"
    assert row["tokens"] == ["idleloop", "valve", "failed", "localhost", "num", "code", "num", "num"]


def row_twin(line):
    """The rule in plain Python, written from its description."""
    words = line.split()
    out = dict.fromkeys(["timestamp", "host_or_serial", "process", "level", "thread", "component"])
    used = 0
    if words and re.match(r"\d{4}-\d{2}-\d{2}T\S", words[0]):
        out["timestamp"], used = words[0], 1
        if len(words) > 1:
            out["host_or_serial"], used = words[1], 2
            if len(words) > 2 and words[2][-1] == ":":
                out["process"], used = words[2][:-1], 3
    elif len(words) > 1 and words[1][-1] == ":":
        out["host_or_serial"], out["process"], used = words[0], words[1][:-1], 2
    rest = " ".join(words[used:])
    for field, pattern in (("level", r"<([^>])>"), ("thread", r"\[([^\]]+)\]")):
        hit = re.search(pattern, rest)
        if hit:
            out[field] = hit.group(1).strip() or None
            rest = f"{rest[:hit.start()]} {rest[hit.end():]}".strip()
    rest = " ".join(rest.split())
    head, colon, tail = rest.partition(":")
    if colon:
        out["component"], out["message"] = head.strip() or None, tail.strip() or rest
    else:
        out["message"] = rest or line.strip()
    return out


def test_random_lines_match_row_twin(spark):
    rng = random.Random(7)
    bits = ["2025-01-02T03:04:05", "RS1", "proc:", "<E>", "<ab>", "[#1]", "[x y]", "Comp:", "a:b", ":", "word", "  ", "\t", "[", "]", "12"]
    lines = [" ".join(rng.choice(bits) for _ in range(rng.randint(0, 8))) for _ in range(1500)]
    for line, got in zip(lines, parse(spark, lines)):
        want = row_twin(line)
        assert {k: got[k] for k in want} == want, line


@pytest.mark.parametrize("text,want", [("  A \t B ", "a b"), ("", "")])
def test_normalize_query(spark, text, want):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(normalize_query(F.col("t")).alias("n")).first()["n"] == want


def test_relevant_line_without_mark(spark):
    df = spark.createDataFrame([("\n a\n b",)], "t string")
    assert df.select(relevant_line(F.col("t")).alias("r")).first()["r"] == "a"
