"""Block attribution against a row twin, docstrings, comments, context."""

import random
import re

from loglode.operators.enclosure import block_bounds, doc_and_comments, enclose, enrich_matches, with_block_text
from loglode.operators.slices import context_preview

HEADER = re.compile(r"^\s*((async\s+def|def)\s+[A-Za-z_]\w*\s*\(|class\s+[A-Za-z_]\w*\s*(\(|:))")


def width(line):
    lead = re.match(r"[ \t]*", line).group()
    return lead.count(" ") + 4 * lead.count("\t")


def twin(lines, m):
    """Nearest header at or above line m (1-based) whose block reaches it, from the description."""
    for h in range(m, 0, -1):
        if not HEADER.match(lines[h - 1]):
            continue
        base, end = width(lines[h - 1]), len(lines)
        for k in range(h + 1, len(lines) + 1):
            s = lines[k - 1]
            code = s.strip() and not s.lstrip().startswith("#")
            starts = HEADER.match(s) or width(s) == 0
            if code and width(s) <= base and not lines[k - 2].rstrip().endswith("\\") and starts:
                end = k - 1
                break
        if m <= end:
            return h, end
    return None


def random_file(rng):
    kinds = ["def f{i}(x):", "class C{i}:", "async def g{i}(a,", "x = {i}", "# note", "", "@deco", "y = 1 + \\", "):", "return"]
    return [rng.choice(["", "    ", "        ", "\t", "  "]) + rng.choice(kinds).format(i=i) for i in range(rng.randint(3, 30))]


def test_random_files_match_twin(spark):
    rng = random.Random(11)
    files = {f"p{i}": random_file(rng) for i in range(60)}
    src = spark.createDataFrame([(p, "\n".join(ls) + "\n") for p, ls in files.items()], "path string, text string")
    hits = spark.createDataFrame([(p, n) for p, ls in files.items() for n in range(1, len(ls) + 1)], "path string, line_no int")
    got = {(r["path"], r["line_no"]): r for r in enclose(src, hits).collect()}
    for p, ls in files.items():
        for n in range(1, len(ls) + 1):
            want, row = twin(ls, n), got[p, n]
            assert (row["def_line_no"], row["end_line"]) == (want or (None, None)), (p, n, ls)
            if want:
                above = want[0] - 1
                while above and ls[above - 1].lstrip().startswith("@") and width(ls[above - 1]) >= width(ls[want[0] - 1]):
                    above -= 1
                assert row["start_line"] == above + 1
                assert row["decorator_lines"] == [x.rstrip() for x in ls[above : want[0] - 1]]


SOURCE = '''import os

# first comment
# second comment

@deco
@other(1)
async def handler(event):
    """One line doc."""
    log("hit one")

class Box(object):
    # remark
    """
    Doc of box.

    More.
    """
    def get(self):
        x = 1
        log("hit two")


"""Header block"""
def bare():
    return 1
print("module level")
'''


def rich(spark, *lines):
    src = spark.createDataFrame([("s.py", SOURCE)], "path string, text string")
    hits = spark.createDataFrame([("s.py", n) for n in lines], "path string, line_no int")
    return src, {r["line_no"]: r for r in enrich_matches(src, hits).collect()}


def test_enriched_fields(spark):
    src, got = rich(spark, 10, 15, 20, 25, 27)
    a = got[10]
    assert (a["enclosure_type"], a["name"], a["start_line"], a["def_line_no"], a["signature"]) == (
        "async_def", "handler", 6, 8, "async def handler(event):",
    )
    assert a["decorator_lines"] == ["@deco", "@other(1)"] and a["enclosure_contains_match"]
    assert (a["docstring_text"], a["docstring_start_line"], a["docstring_end_line"]) == ("One line doc.", 9, 9)
    assert (a["leading_comment_block"], a["leading_comment_start_line"], a["leading_comment_end_line"]) == (
        "# first comment\n# second comment", 3, 4,
    )
    b = got[15]
    assert (b["enclosure_type"], b["name"], b["docstring_start_line"], b["docstring_end_line"]) == ("class", "Box", 14, 18)
    assert b["docstring_text"].startswith("Doc of box.") and b["docstring_text"].endswith("More.")
    # The quote line above the method stands for everything up to its opening line.
    whole = '    """\n    Doc of box.\n\n    More.\n    """'
    assert (got[20]["name"], got[20]["docstring_text"], got[20]["leading_comment_block"]) == ("get", None, whole)
    assert (got[25]["name"], got[25]["leading_comment_block"]) == ("bare", '"""Header block"""')
    assert (got[27]["enclosure_type"], got[27]["start_line"], got[27]["enclosure_contains_match"]) == ("module", None, False)


def test_block_text_and_context(spark):
    src, got = rich(spark, 20, 27)
    hits = spark.createDataFrame([("s.py", 20), ("s.py", 27)], "path string, line_no int")
    blocks = {r["line_no"]: r["block"] for r in with_block_text(src, enclose(src, hits)).collect()}
    assert blocks[20].startswith("    def get(self):") and blocks[27].startswith("import os")
    near = {r["line_no"]: r["context_preview"] for r in context_preview(src, hits, around=2).collect()}
    assert near[20].splitlines()[0].startswith("18: ") and near[20].splitlines()[-1] == "22: "
    assert near[27].splitlines()[-1] == '27: print("module level")'


def test_bounds_of_every_header(spark):
    src, _ = rich(spark, 10)
    names = [r["name"] for r in block_bounds(src).orderBy("def_line_no").collect()]
    assert names == ["handler", "Box", "get", "bare"]


def test_long_docstrings_and_comments_without_limits(spark):
    comment = "\n".join(f"# line {i}" for i in range(200))
    body = "\n".join("    words of a long docstring" for _ in range(1600))
    text = f'x = 1\n{comment}\ndef f(a):\n    """First.\n{body}\n    """\n    return a\n'
    files = spark.createDataFrame([("a.py", text)], "path string, text string")
    blocks = spark.createDataFrame([("a.py", 202, 1805, 0)], "path string, def_line_no int, end_line int, header_indent int")
    whole = doc_and_comments(files, blocks, docstring_cap=None, comment_window=None).first()
    assert whole["leading_comment_block"] == comment and whole["docstring_text"].startswith("First.\n    words") and len(whole["docstring_text"]) > 40_000
    live = doc_and_comments(files, blocks).first()
    assert live["docstring_text"] is None and live["leading_comment_block"].count("\n") == 24
