"""Faults of conversations and their cheapest repair, over conversations of any length."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loglode.llm.common import map_arrow, stored
from loglode.llm.suffix_automaton import AFTER, ASSISTANT, GONE, NEXT, START, USER, solve

#: Rows whose symbols one piece of a signature holds at most.
PIECE = 1 << 16
BLANKS = " \t\n\x0b\x0c\r"
LEGAL = ("su", "ua", "au")
ROLE = {USER: "user", ASSISTANT: "assistant"}

_PIECES = "conv_id long, turn long, role string, digest binary, signature string, blank long, duplicate long, truncated long, illegal long, first_initial string, last_initial string, least long, most long, turns long"
_RESULT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def _marked(rows: DataFrame, copies: Column) -> DataFrame:
    """Rows with their null values set, their text's digest and their own fault: 0 none, 1 cut off, 2 blank."""
    end = F.rtrim(F.col("text"), F.lit(BLANKS))
    rows = rows.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role"), F.lit(" ")).alias("role"),
        F.coalesce(F.col("text"), F.lit(" ")).alias("text"),
        copies.cast("long").alias("n"),
    )
    fault = F.when(end == "", 2).when(F.right(end, F.lit(1)).isin(".", "!", "?"), 0).otherwise(1)
    return rows.withColumn("fault", fault.cast("int")).withColumn("digest", F.unhex(F.md5("text")))


def _symbols(marked: DataFrame) -> DataFrame:
    """One row for equal rows of a turn: their number, their fault, and whether their text stands here first."""
    here = F.col("n") > 0
    keys = [F.col("conv_id"), F.when(here, F.col("turn")).alias("turn"), F.when(here, F.col("role")).otherwise("").alias("role")]
    keys += [F.when(here, F.col("digest")).otherwise(F.lit(b"")).alias("digest"), F.when(here, F.col("fault")).otherwise(2).alias("fault")]
    rows = marked.groupBy(*keys).agg(F.sum("n").alias("n"))
    said = marked.where((F.col("fault") < 2) & here).groupBy("conv_id", "role", "digest")
    first = said.agg(F.min("turn").alias("first_turn"), F.bool_or(F.col("turn").isNull()).alias("first_null"))
    first = first.select(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("digest").alias("d"), "first_turn", "first_null")
    same = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("digest") == F.col("d"))
    opens = F.when(F.col("first_null"), F.col("turn").isNull()).otherwise(F.col("turn") == F.col("first_turn"))
    joined = rows.join(first.hint("shuffle_hash"), same, "left")
    return joined.select("conv_id", "turn", "role", "digest", "fault", "n", F.coalesce(opens, F.lit(False)).alias("opens"))


class _Piece:
    """A run of one conversation's rows in order."""

    def __init__(self, conv_id, turn, role, digest):
        self.key = (conv_id, turn, role, digest)
        self.symbols, self.rows = [], 0
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.first = self.last = self.least = self.most = None

    def add(self, turn, role: str, fault: int, n: int, opens: bool) -> None:
        if not n:
            return
        initial = role[:1] if role[:1] in AFTER else "o"
        if fault == 2:
            self.blank += n
            self.symbols.append(GONE * n)
        else:
            new = int(opens)
            self.duplicate += n - new
            self.truncated += new * fault
            self.symbols.append((initial.upper() if fault else initial) * new + GONE * (n - new))
        self.illegal += n - 1 + (self.last is not None and self.last + initial not in LEGAL)
        self.first, self.last = self.first or initial, initial
        if turn is not None:
            self.turns += turn != self.most
            self.least, self.most = turn if self.least is None else self.least, turn
        self.rows += n

    def row(self) -> tuple:
        return (*self.key, "".join(self.symbols), self.blank, self.duplicate, self.truncated, self.illegal, self.first, self.last, self.least, self.most, self.turns)


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    piece, done = None, []
    for batch in batches:
        for conv_id, turn, role, digest, fault, n, opens in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if piece is None or piece.key[0] != conv_id or piece.rows >= PIECE:
                done += [piece.row()] if piece else []
                piece = _Piece(conv_id, turn, role, digest)
            piece.add(turn, role, fault, n, opens)
        if done:
            yield _batch(done, _PIECES_ARROW)
            done = []
    if piece:
        yield _batch([piece.row()], _PIECES_ARROW)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def _arrow(ddl: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary(), "int": pa.int32()}
    return pa.schema([(name, kinds[kind]) for name, kind in (x.split() for x in ddl.split(", "))])


_PIECES_ARROW = _arrow(_PIECES)
_RESULT_ARROW = _arrow(_RESULT)


def _conversations(symbols: DataFrame) -> DataFrame:
    """One row a conversation: its signature and counts, put together from its pieces."""
    order = ["conv_id", "turn", "role", "digest"]
    dealt = symbols.repartitionByRange(*order).sortWithinPartitions(*order)
    pieces = map_arrow(dealt.select(*order, "fault", "n", "opens"), _pieces, _PIECES)
    counts = ["blank", "duplicate", "truncated", "illegal", "turns"]
    held = F.struct(F.col("turn").isNotNull().alias("timed"), "turn", "role", "digest", "signature", "first_initial", "last_initial", "least", "most")
    conv = pieces.groupBy("conv_id").agg(F.array_sort(F.collect_list(held)).alias("p"), *[F.sum(c).alias(c) for c in counts], F.min("least").alias("least"), F.max("most").alias("most"))
    # where one piece ends and the next begins: a pair of rows more, and perhaps a turn that both hold
    real = F.filter("p", lambda x: x.signature != "")
    seams = F.arrays_zip(F.slice(real, 1, F.greatest(F.size(real) - 1, F.lit(0))).alias("a"), F.slice(real, 2, F.greatest(F.size(real) - 1, F.lit(0))).alias("b"))
    illegal = F.size(F.filter(seams, lambda x: ~F.concat(x.a.last_initial, x.b.first_initial).isin(*LEGAL)))
    shared = F.size(F.filter(seams, lambda x: F.coalesce(x.a.most == x.b.least, F.lit(False))))
    wide = F.col("most").cast("decimal(20,0)") - F.col("least").cast("decimal(20,0)") + 1 - F.col("turns") + shared
    most = F.lit((1 << 63) - 1).cast("decimal(20,0)")
    gaps = F.when(F.col("most").isNull(), 0).otherwise(F.least(wide, most)).cast("long")
    signature = F.array_join(F.transform("p", lambda x: x.signature), "")
    return conv.select("conv_id", signature.alias("signature"), gaps.alias("gaps"), "blank", "duplicate", "truncated", (F.col("illegal") + illegal).alias("illegal"))


def _solved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def signatures():
        for batch in batches:
            yield from batch.column("signature").to_pylist()

    rows, size = [], 0
    for row in solve(signatures()):
        rows.append(row)
        size += len(row[0]) + len(row[2])
        if size > 1 << 22:
            yield _batch(rows, _SOLVED)
            rows, size = [], 0
    if rows:
        yield _batch(rows, _SOLVED)


_SOLVED = _arrow("signature string, cost long, audit string")


def _repairs(conversations: DataFrame) -> DataFrame:
    """The cost and the audit of every distinct signature: equal ends meet in one task, and are solved there once."""
    distinct = conversations.select("signature").distinct().withColumn("ends", F.reverse("signature"))
    dealt = distinct.repartitionByRange("ends").sortWithinPartitions("ends").select("signature")
    return map_arrow(dealt, _solved, "signature string, cost long, audit string")


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out, walk = [], None
    for batch in batches:
        for conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, role, text, n in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if audit is not None:
                out += [walk.close()] if walk else []
                walk = _Walk((conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit))
            else:
                for _ in range(n):
                    walk.row(role, text)
        if out:
            yield _batch(out, _RESULT_ARROW)
            out = []
    if walk:
        yield _batch([walk.close()], _RESULT_ARROW)


class _Walk:
    """One conversation's audit applied to its rows as they pass; only the running digest is kept."""

    def __init__(self, head: tuple):
        self.head, self.audit = head, head[-1]
        self.at, self.state, self.some, self.sha = 0, START, False, hashlib.sha256()

    def _line(self, role: str, text: str) -> None:
        self.sha.update(f"{chr(10) if self.some else ''}{role}:{text}".encode())
        self.some = True

    def _insert(self) -> None:
        self.state = NEXT[self.state]
        self._line(ROLE[self.state], "")

    def row(self, role: str, text: str) -> None:
        while self.audit[self.at] == "I":
            self.at += 1
            self._insert()
        letter, self.at = self.audit[self.at], self.at + 1
        if letter == "R":
            self.state = NEXT[self.state]
            self._line(ROLE[self.state], text)
        elif letter == "K":
            self.state = AFTER[role[:1]][self.state]
            self._line(role, text)

    def close(self) -> tuple:
        for _ in self.audit[self.at :]:
            self._insert()
        return (*self.head, self.sha.hexdigest())


def repair_conversations(rows: DataFrame, copies: Column | None = None) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of every conversation.

    rows has conv_id, turn, role, text; other columns are not looked at. `copies` says how often a row stands in its
    place (1 if not given); with 0 it only makes its conversation known. A conversation's rows come by turn, nulls first,
    then by role, then by their text's md5; a null role or text is one blank, rows with a null conv_id are one
    conversation. Faults, edits and their costs are those of `suffix_automaton`; a role that does not begin with s, u
    or a, as an empty one, cannot be kept. Equal rows of a turn are one row and its duplicates. A conversation without rows
    has zeros, an empty audit and the empty text's digest; an empty table gives no rows.

    Only digests and marks of the rows are dealt by range, so that a conversation of any length lies in many tasks; its
    signature, as long as the audit returned, is put together from pieces. Distinct signatures are solved once. The
    texts pass once, sorted, beside their audit, through a running digest: that digest is a chain, so one conversation's
    texts pass one task, without being held there.
    """
    marked = _marked(rows, F.lit(1) if copies is None else copies)
    conversations = stored(_conversations(_symbols(marked)))
    repairs = _repairs(conversations)
    heads = conversations.join(repairs, "signature")
    head = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"]
    nothing = [F.lit(None).cast(t).alias(c) for c, t in (("turn", "long"), ("role", "string"), ("text", "string"), ("n", "long"), ("digest", "binary"))]
    tops = heads.select("conv_id", F.lit(0).alias("part"), *head, *nothing)
    no_head = [F.lit(None).cast("string" if c == "audit" else "long").alias(c) for c in head]
    lines = marked.where("n > 0").select("conv_id", F.lit(1).alias("part"), *no_head, "turn", "role", "text", "n", "digest")
    dealt = tops.unionByName(lines).repartition("conv_id").sortWithinPartitions("conv_id", "part", "turn", "role", "digest")
    return map_arrow(dealt.select("conv_id", *head, "role", "text", "n"), _digests, _RESULT)
