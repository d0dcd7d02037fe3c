"""Which def or class encloses a line: block bounds and attribution as windows per file."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loglode.functions.text import byte_lines, explode_lines, indent_width, lstrip, rstrip, strip
from loglode.operators.slices import MODULE_CONTEXT_LINES, files_with_hits, line_slices

# Header patterns, decorator and comment marks, and the note.
DEF_HEADER = r"^\s*(async\s+def|def)\s+([A-Za-z_][A-Za-z0-9_]*)\s*\("
CLASS_HEADER = r"^\s*class\s+([A-Za-z_][A-Za-z0-9_]*)\s*(\(|:)\s*"
ASYNC_DEF = r"^\s*async\s+def\s+"
HEADER_NAME = r"^\s*(?:async\s+def|def|class)\s+([A-Za-z_][A-Za-z0-9_]*)"
MODULE_NOTE = "No enclosing def/class found; returning module-level context window."
DOCSTRING_CAP = 16 * 1024
LIVE_COMMENT_WINDOW = 25
INDEX_COMMENT_WINDOW = 30


def is_header(line: Column) -> Column:
    return line.rlike(DEF_HEADER) | line.rlike(CLASS_HEADER)


def header_kind(line: Column) -> Column:
    bare = lstrip(line)
    return (
        F.when(line.rlike(ASYNC_DEF), "async_def")
        .when(F.startswith(bare, F.lit("def ")), "def")
        .when(F.startswith(bare, F.lit("class ")), "class")
    )


def block_bounds(files: DataFrame, key: Sequence[str] = ("path",)) -> DataFrame:
    """Every def/class header of every file with its block.

    One shuffle by file. A header ends before the next breaker of its indent or
    less, where a breaker is a code line that starts a header or sits at column
    zero and does not continue the line above. Breakers are repeated once per
    header indent they end (few per file), so "next breaker" is a running value
    over (file, indent) read backwards.
    """
    key = list(key)
    sized = files.select(*key, "text").withColumn("n_lines", F.size(byte_lines(F.col("text"))))
    line = F.col("line_text")
    by_line = Window.partitionBy(*key).orderBy("line_no")
    bare = lstrip(line)
    decorator = F.startswith(bare, F.lit("@"))
    rows = explode_lines(sized).withColumns(
        {
            "indent": indent_width(line),
            "header": is_header(line),
            "decorator": decorator,
            "code": (bare != "") & ~F.startswith(bare, F.lit("#")),
            "continued": F.coalesce(F.endswith(rstrip(F.lag("line_text").over(by_line)), F.lit("\\")), F.lit(False)),
            # A run of decorators and the line right below it share this number.
            "run": F.coalesce(
                F.sum(F.when(~decorator, 1).otherwise(0)).over(by_line.rowsBetween(Window.unboundedPreceding, -1)),
                F.lit(0),
            ),
        }
    )
    rows = rows.withColumn(
        "breaker", F.col("code") & ~F.col("continued") & (F.col("header") | (F.col("indent") == 0))
    ).filter("header or breaker or decorator")

    above = F.struct("line_no", "indent", "breaker", rstrip(line).alias("text"))
    here = F.struct("line_no", "indent", "breaker", "header", line.alias("text"))
    runs = rows.groupBy(*key, "n_lines", "run").agg(
        F.sort_array(F.collect_list(F.when(F.col("decorator"), above))).alias("decorators"),
        F.max(F.when(~F.col("decorator"), here)).alias("here"),
    )
    levels = F.collect_set(F.when(F.col("here.header"), F.col("here.indent"))).over(Window.partitionBy(*key))
    runs = runs.withColumn("levels", levels).filter(F.size("levels") > 0)

    def at_levels(p: Column) -> Column:
        ended = F.filter("levels", lambda d: d >= p["indent"])
        return F.transform(ended, lambda d: F.struct(d.alias("level"), p["line_no"].alias("line_no")))

    breakers = F.concat(
        F.flatten(F.transform(F.filter("decorators", lambda p: p["breaker"]), at_levels)),
        F.when(F.col("here.breaker"), at_levels(F.col("here"))).otherwise(F.array()),
    )
    # Decorators of a header: the unbroken tail of the run with its indent or more.
    outdented = F.filter("decorators", lambda p: p["indent"] < F.col("here.indent"))
    own = F.filter("decorators", lambda p: p["line_no"] > F.coalesce(F.get(outdented, F.size(outdented) - 1)["line_no"], F.lit(0)))
    header = F.struct(
        F.col("here.text").alias("text"),
        F.transform(own, lambda p: p["text"]).alias("decorators"),
        F.get(own, 0)["line_no"].alias("decorator_start"),
    )
    header_type = "struct<text:string,decorators:array<string>,decorator_start:int>"
    ends = runs.select(*key, "n_lines", F.explode(breakers).alias("b")).select(
        *key, "n_lines", "b.level", "b.line_no", F.lit(None).cast(header_type).alias("h"), F.lit(True).alias("ends")
    )
    heads = runs.filter("here.header").select(
        *key,
        "n_lines",
        F.col("here.indent").alias("level"),
        F.col("here.line_no").alias("line_no"),
        header.cast(header_type).alias("h"),
        F.lit(False).alias("ends"),
    )
    backwards = Window.partitionBy(*key, "level").orderBy(F.desc("line_no"))
    # Rows of the header line itself are left out by looking at the line below only.
    next_end = F.min(F.when(F.col("ends"), F.col("line_no"))).over(backwards.rangeBetween(Window.unboundedPreceding, -1))
    blocks = heads.unionByName(ends).withColumn("next_end", next_end).filter("h is not null")
    text = F.col("h.text")
    return blocks.select(
        *key,
        header_kind(text).alias("enclosure_type"),
        F.regexp_extract(text, HEADER_NAME, 1).alias("name"),
        F.coalesce("h.decorator_start", "line_no").alias("start_line"),
        F.coalesce(F.col("next_end") - 1, "n_lines").alias("end_line"),
        strip(text).alias("def_line_text"),
        F.col("h.decorators").alias("decorator_lines"),
        F.col("h.decorator_start").alias("decorator_start_line"),
        F.col("line_no").alias("def_line_no"),
        F.col("level").alias("header_indent"),
    )


BLOCK_FIELDS = [
    "enclosure_type",
    "name",
    "start_line",
    "end_line",
    "def_line_text",
    "decorator_lines",
    "decorator_start_line",
    "def_line_no",
    "header_indent",
]


def enclose(
    files: DataFrame,
    hits: DataFrame,
    key: Sequence[str] = ("path",),
) -> DataFrame:
    """Add the nearest block at or above each hit that contains it, else type ``module``.

    Blocks of one indent never overlap, so per indent only the last header above the
    hit can hold it: a running value over (file, indent), then the nearest that reaches.
    """
    key = list(key)
    places = hits.select(*key, "line_no").distinct()
    blocks = block_bounds(files, key).filter("enclosure_type is not null")
    block = F.struct(*BLOCK_FIELDS)
    levels = blocks.groupBy(*key).agg(F.collect_set("header_indent").alias("levels"))
    heads = blocks.select(
        *key, F.col("header_indent").alias("level"), F.col("def_line_no").alias("line_no"), block.alias("block")
    ).withColumn("hit", F.lit(False))
    asked = places.join(levels, key).select(
        *key, F.explode("levels").alias("level"), "line_no", F.lit(None).alias("block"), F.lit(True).alias("hit")
    )
    asked = asked.withColumn("block", F.col("block").cast(heads.schema["block"].dataType))
    order = Window.partitionBy(*key, "level").orderBy("line_no", "hit")
    seen = F.last("block", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    held = (
        heads.unionByName(asked)
        .withColumn("block", seen)
        .filter(F.col("hit") & (F.col("block.end_line") >= F.col("line_no")))
        .groupBy(*key, "line_no")
        .agg(F.max_by("block", F.col("block.def_line_no")).alias("block"))
        .select(*key, "line_no", "block.*")
    )
    out = hits.join(held, [*key, "line_no"], "left")
    inside = F.col("enclosure_type").isNotNull()
    return out.withColumns(
        {
            "enclosure_contains_match": inside,
            "signature": F.col("def_line_text"),
            "notes": F.when(~inside, MODULE_NOTE),
            "enclosure_type": F.coalesce("enclosure_type", F.lit("module")),
        }
    )


def signature_of_block(enclosure_type: Column, def_line_text: Column, block: Column) -> Column:
    """The stored header line, else the first def or class line of the block text."""
    lines = F.split(block, "\n")
    defs = F.filter(lines, lambda x: lstrip(x).rlike("^(async def |def )"))
    classes = F.filter(lines, lambda x: F.startswith(lstrip(x), F.lit("class ")))
    return F.coalesce(
        F.when(def_line_text != "", def_line_text),
        F.when(enclosure_type.isin("def", "async_def"), strip(F.get(defs, 0))).when(
            enclosure_type == "class", strip(F.get(classes, 0))
        ),
    )


def with_block_text(files: DataFrame, enclosed: DataFrame, key: Sequence[str] = ("path",)) -> DataFrame:
    """Add ``block``: the lines of the enclosing block, or the window around a module-level hit."""
    key = list(key)
    ranged = enclosed.withColumns(
        {
            "from_line": F.coalesce("start_line", F.greatest(F.col("line_no") - MODULE_CONTEXT_LINES, F.lit(1))),
            "to_line": F.coalesce("end_line", F.col("line_no") + MODULE_CONTEXT_LINES),
        }
    )
    texts = line_slices(files, ranged, key).withColumnRenamed("slice_text", "block")
    return ranged.join(texts, [*key, "from_line", "to_line"], "left").drop("from_line", "to_line")


def _first(items: Column, test) -> Column:
    """1-based position of the first item that passes, 0 when none does."""
    return F.coalesce(F.array_position(F.transform(items, test), F.lit(True)), F.lit(0)).cast("int")


def with_docstring(blocks: DataFrame, cap: int | None = DOCSTRING_CAP) -> DataFrame:
    """Docstring of blocks from ``below``, the lines under their header; one of more than ``cap`` characters is none."""
    c = F.col
    out = blocks.withColumn("_at", _first(c("below"), lambda x: ~lstrip(x).rlike(r"^(#|\z)")))
    out = out.withColumn("_line", F.get("below", c("_at") - 1)).withColumn("_bare", lstrip(c("_line")))
    mark = F.substring("_bare", 1, 3)
    opens = (c("_at") > 0) & (indent_width(c("_line")) > c("header_indent")) & mark.isin('"""', "'''")
    out = out.withColumn("_mark", F.when(opens, mark))
    single = F.substring(c("_bare"), F.lit(4), F.length("_bare") - 6)
    fits = lambda size: F.lit(True) if cap is None else size <= cap
    one_line = F.endswith("_bare", "_mark") & (F.length("_bare") > 6) & fits(F.length("_bare") - 6)
    rest = F.when(c("_mark").isNotNull(), F.slice(c("below"), c("_at") + 1, F.size("below")))
    out = out.withColumns({"_single": F.when(one_line, single), "_rest": rest})
    out = out.withColumn("_close", _first(c("_rest"), lambda x: F.contains(x, c("_mark"))))
    closing = F.get("_rest", c("_close") - 1)
    head = F.substring(c("_bare"), F.lit(4), F.length("_bare"))
    out = out.withColumns(
        {
            "_head": head,
            "_body": F.slice(c("_rest"), F.lit(1), F.greatest(c("_close") - 1, F.lit(0))),
            "_tail": F.substring(closing, F.lit(1), F.instr(closing, c("_mark")) - 1),
        }
    )
    size = F.aggregate("_body", F.length("_head"), lambda acc, x: acc + F.length(x))
    joined = strip(F.concat_ws("\n", F.array("_head"), "_body", F.when(c("_tail") != "", F.array("_tail"))))
    out = out.withColumn("_joined", F.when((c("_close") > 0) & fits(size), joined))
    text = F.coalesce("_single", F.when(c("_joined") != "", c("_joined")))
    out = out.withColumn("docstring_text", text)
    first = F.when(c("docstring_text").isNotNull(), c("def_line_no") + c("_at"))
    length = F.when(c("_single").isNotNull(), 0).otherwise(c("_close"))
    return out.withColumns({"docstring_start_line": first, "docstring_end_line": first + length}).drop(
        "_at", "_line", "_bare", "_mark", "_single", "_rest", "_close", "_head", "_body", "_tail", "_joined"
    )


def with_comment(
    blocks: DataFrame, def_line: str, window: int | None = LIVE_COMMENT_WINDOW, skip_decorators: bool = True
) -> DataFrame:
    """Comment block above headers; ``above`` holds the lines upwards from each one, ``window`` bounds the walk.

    Each line becomes one letter, and the lines to walk are the longest prefix with
    at most one blank between marked lines. A ``#`` line or one-line quote stands for
    itself, any other quote line for everything up to the next line with its quote.
    """
    is_decorator = lambda x: F.startswith(lstrip(x), F.lit("@"))

    def letter(x: Column) -> Column:
        bare = lstrip(x)
        return (
            F.when(bare == "", "B")
            .when(F.startswith(bare, F.lit("@")), "D")
            .when(F.startswith(bare, F.lit("#")), "C")
            .when(F.substring(bare, 1, 3).isin('"""', "'''"), "Q")
            .otherwise("X")
        )

    above = F.col("above")
    near = above if window is None else F.slice(above, 1, window)
    out = blocks.withColumn("_letters", F.array_join(F.transform(near, letter), ""))
    walk = "^(?:B?[DCQ])*" if skip_decorators else "^(?:B?[CQ])*"
    out = out.withColumn("_walk", F.split(F.regexp_extract("_letters", walk, 0), ""))
    marked = F.filter(F.transform("_walk", lambda x, i: F.when(x.isin("C", "Q"), i + 1)), lambda i: i.isNotNull())
    # The header line counts from the end of the file part above it.
    ends = F.transform(marked, lambda i: F.struct(i.alias("i"), F.get(above, i - 1).alias("line")))
    marks = F.transform(
        ends, lambda p: F.struct(p["i"].alias("i"), p["line"].alias("line"), lstrip(p["line"]).alias("bare"))
    )
    out = out.withColumn("_marks", marks)

    def reach(p: Column) -> Column:
        mark = F.substring(p["bare"], 1, 3)
        further = F.slice(above, p["i"] + 1, F.size(above) if window is None else F.lit(window - 1))
        closes = lambda x: F.contains(x, mark) & (~is_decorator(x) if skip_decorators else F.lit(True))
        single = F.startswith(p["bare"], F.lit("#")) | (F.endswith(p["bare"], mark) & (F.length(p["bare"]) > 6))
        return F.struct(
            p["i"].alias("i"),
            single.alias("single"),
            F.when(single, 0).otherwise(_first(further, closes)).alias("hit"),
            F.when(single, 0).otherwise(F.size(further)).alias("further"),
        )

    out = out.withColumn("_reach", F.transform("_marks", reach))

    def piece(p: Column) -> Column:
        span = F.when(p["hit"] > 0, p["hit"] + 1).otherwise(p["further"] + 1)
        lines = F.reverse(F.slice(above, p["i"], span))
        known = F.when(p["hit"] > 0, span).otherwise(1) if skip_decorators else span
        return F.struct(
            (F.filter(lines, lambda x: ~is_decorator(x)) if skip_decorators else lines).alias("lines"),
            (F.col(def_line) - p["i"]).alias("last"),
            (F.col(def_line) - p["i"] - known + 1).alias("first"),
        )

    out = out.withColumn("_pieces", F.transform("_reach", piece))
    text = F.array_join(F.flatten(F.transform(F.reverse("_pieces"), lambda p: p["lines"])), "\n")
    return out.withColumns(
        {
            "leading_comment_block": F.when(F.size("_pieces") > 0, text),
            "leading_comment_start_line": F.get("_pieces", F.size("_pieces") - 1)["first"],
            "leading_comment_end_line": F.get("_pieces", 0)["last"],
        }
    ).drop("_letters", "_walk", "_marks", "_reach", "_pieces")


def doc_and_comments(
    files: DataFrame,
    blocks: DataFrame,
    key: Sequence[str] = ("path",),
    docstring_cap: int | None = DOCSTRING_CAP,
    comment_window: int | None = LIVE_COMMENT_WINDOW,
) -> DataFrame:
    """Docstring and leading comment of blocks: (key, def_line_no) plus six columns.

    The limits are those of a live look-up; None takes docstrings and comments of any
    length. Every header leaves its file's row as a row of its own before it takes its lines.
    """
    key = list(key)
    heads = blocks.filter("def_line_no is not null").select(*key, "def_line_no", "end_line", "header_indent").distinct()
    per_file = heads.groupBy(*key).agg(F.collect_list(F.struct("def_line_no", "end_line", "header_indent")).alias("heads"))
    src = files.select(*key, "text").join(per_file, key)
    src = src.select(*key, byte_lines(F.col("text")).alias("_lines"), "heads")
    rows = src.select(*key, "_lines", F.explode("heads").alias("h")).select(*key, "_lines", "h.*")
    d = F.col("def_line_no")
    start = F.lit(1) if comment_window is None else F.greatest(d - 2 * comment_window, F.lit(1))
    rows = rows.select(
        *key,
        "def_line_no",
        "header_indent",
        F.reverse(F.slice("_lines", start, d - start)).alias("above"),
        F.slice("_lines", d + 1, F.greatest(F.col("end_line") - d, F.lit(0))).alias("below"),
    )
    return with_comment(with_docstring(rows, docstring_cap), "def_line_no", comment_window).drop("above", "below", "header_indent")


def enrich_matches(files: DataFrame, hits: DataFrame, key: Sequence[str] = ("path",)) -> DataFrame:
    """Enclosing block, docstring and leading comment of every (persisted) hit."""
    held = files_with_hits(files, hits, key)
    enclosed = enclose(held, hits, key)
    docs = doc_and_comments(held, enclosed, key)
    return enclosed.join(docs, [*key, "def_line_no"], "left")
