"""Syntax facts of Python files.

Only the parse itself needs Python: one Arrow function turns a file's text into
arrays of facts (functions, log-like calls and raises, imports, assignments, bare
excepts). Every rule about those facts is a Spark expression elsewhere.
"""

from __future__ import annotations

import ast
import ctypes
import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Method and function names that any of the jobs looks at.
LOG_NAMES = {"debug", "info", "warning", "warn", "error", "exception", "critical", "fatal", "trace", "log"}
OTHER_NAMES = {"print", "print_exc", "format_exc", "basicconfig", "dictconfig", "fileconfig", "configure"}
RAISE = "<raise>"
#: As Python objects facts take over 20 times the room of their text, as Arrow columns under three times.
PIECE_CHARS = 250_000

_ARG = pa.struct(
    [
        ("form", pa.string()),
        ("text", pa.string()),
        ("inner", pa.string()),
        ("parts", pa.list_(pa.string())),
        ("literals", pa.list_(pa.string())),
        ("reasons", pa.list_(pa.string())),
    ]
)
_FACTS = pa.struct(
    [
        ("parsed", pa.bool_()),
        (
            "functions",
            pa.list_(
                pa.struct(
                    [
                        ("name", pa.string()),
                        ("class_name", pa.string()),
                        ("line_start", pa.int32()),
                        ("line_end", pa.int32()),
                        ("docstring", pa.string()),
                        ("via_body", pa.bool_()),
                        ("first_call", pa.int32()),
                        ("n_calls", pa.int32()),
                    ]
                )
            ),
        ),
        (
            "calls",
            pa.list_(
                pa.struct(
                    [
                        ("seq", pa.int32()),
                        ("seq_end", pa.int32()),
                        ("depth", pa.int32()),
                        ("line_no", pa.int32()),
                        ("name", pa.string()),
                        ("method", pa.bool_()),
                        ("callee", pa.string()),
                        ("base", pa.string()),
                        ("args", pa.list_(_ARG)),
                        ("msg", _ARG),
                        ("exc_info", pa.bool_()),
                    ]
                )
            ),
        ),
        (
            "imports",
            pa.list_(
                pa.struct(
                    [
                        ("seq", pa.int32()),
                        ("module", pa.string()),
                        ("name", pa.string()),
                        ("bound", pa.string()),
                        ("counted", pa.bool_()),
                    ]
                )
            ),
        ),
        (
            "assigns",
            pa.list_(
                pa.struct(
                    [
                        ("seq", pa.int32()),
                        ("targets", pa.list_(pa.string())),
                        ("base", pa.string()),
                        ("name", pa.string()),
                        ("first_text", pa.string()),
                    ]
                )
            ),
        ),
        ("bare_excepts", pa.list_(pa.int32())),
    ]
)
_ARG_DDL = "struct<form:string,text:string,inner:string,parts:array<string>,literals:array<string>,reasons:array<string>>"
FACTS_DDL = (
    "struct<parsed:boolean,"
    "functions:array<struct<name:string,class_name:string,line_start:int,line_end:int,docstring:string,"
    "via_body:boolean,first_call:int,n_calls:int>>,"
    "calls:array<struct<seq:int,seq_end:int,depth:int,line_no:int,name:string,method:boolean,callee:string,base:string,"
    f"args:array<{_ARG_DDL}>,msg:{_ARG_DDL},exc_info:boolean>>,"
    "imports:array<struct<seq:int,module:string,name:string,bound:string,counted:boolean>>,"
    "assigns:array<struct<seq:int,targets:array<string>,base:string,name:string,first_text:string>>,"
    "bare_excepts:array<int>>"
)


def _text(node: ast.AST | None) -> str | None:
    return node.value if isinstance(node, ast.Constant) and isinstance(node.value, str) else None


def _chain(node: ast.AST) -> tuple[bool, list[str]]:
    """Attribute names of a dotted expression, and whether it starts at a plain name."""
    names: list[str] = []
    while isinstance(node, ast.Attribute):
        names.append(node.attr)
        node = node.value
    rooted = isinstance(node, ast.Name)
    if rooted:
        names.append(node.id)
    return rooted, names[::-1]


def _dotted(node: ast.AST) -> str | None:
    rooted, names = _chain(node)
    return ".".join(names) if rooted else None


def _fragments(node: ast.AST) -> Iterator[tuple[str, str]]:
    """String literals below an argument and the reasons why it is built at run time, outermost and leftmost first."""
    waiting = [node]
    while waiting:
        node = waiting.pop()
        text = _text(node)
        if text is not None:
            yield "literal", text
            continue
        inner = list(ast.iter_child_nodes(node))
        match node:
            case ast.JoinedStr():
                yield "reason", "python_fstring"
            case ast.BinOp(op=ast.Mod()):
                yield "reason", "python_percent_formatting"
                inner = [node.left, node.right]
            case ast.BinOp(op=ast.Add()):
                yield "reason", "python_concat"
                inner = [node.left, node.right]
            case ast.Call(func=ast.Attribute(attr="format")):
                yield "reason", "python_dot_format"
                inner = [node.func.value, *node.args]
        waiting.extend(reversed(inner))


def _addends(node: ast.AST) -> Iterator[str | None]:
    waiting = [node]
    while waiting:
        node = waiting.pop()
        if isinstance(node, ast.BinOp) and isinstance(node.op, ast.Add):
            waiting += [node.right, node.left]
        else:
            yield _text(node)


def _argument(node: ast.AST, deep: bool = True) -> dict:
    form, text, inner, parts = "other", None, None, None
    match node:
        case ast.Constant(value=str()):
            form, text = "str", node.value
        case ast.Call(func=ast.Attribute(attr="format", value=ast.Constant(value=str()))):
            form, text = "format", node.func.value.value
        case ast.Call(func=ast.Attribute()):
            form = "call"
        case ast.Call(func=ast.Name()):
            form = "call:" + node.func.id
            if node.args and deep:
                first = _argument(node.args[0], deep=False)
                inner, text = first["form"], first["text"]
        case ast.BinOp(op=ast.Mod()):
            form, text = "percent", _text(node.left)
        case ast.BinOp(op=ast.Add()):
            form, parts = "concat", list(_addends(node))
        case ast.Name():
            form, text = "name", node.id
        case ast.Attribute():
            form, text = "attribute", _dotted(node)
    found = list(_fragments(node)) if deep else []
    return {
        "form": form,
        "text": text,
        "inner": inner,
        "parts": parts,
        "literals": list(dict.fromkeys(v for k, v in found if k == "literal")),
        "reasons": list(dict.fromkeys(v for k, v in found if k == "reason")),
    }


def _call(node: ast.Call, name: str) -> dict:
    rooted, names = _chain(node.func)
    keywords = {k.arg: k.value for k in reversed(node.keywords) if k.arg}
    flag = keywords.get("exc_info")
    return {
        "line_no": node.lineno,
        "name": name,
        "method": isinstance(node.func, ast.Attribute),
        "callee": ".".join(names),
        "base": ".".join(names[:-1]) if rooted and len(names) > 1 else None,
        "args": [_argument(a) for a in node.args],
        "msg": _argument(keywords["msg"]) if "msg" in keywords else None,
        "exc_info": isinstance(flag, ast.Constant) and flag.value is True,
    }


def _assign(node: ast.Assign) -> dict | None:
    call = node.value
    if not isinstance(call, ast.Call) or not isinstance(call.func, (ast.Name, ast.Attribute)):
        return None
    rooted, names = _chain(call.func)
    targets = []
    for target in node.targets:
        known, path = _chain(target)
        if known:
            targets.append(path[0] if len(path) == 1 else f"{path[0]}.{path[-1]}")
    if not rooted or not targets and len(names) < 2:
        return None
    return {
        "targets": targets,
        "base": ".".join(names[:-1]) or None,
        "name": names[-1],
        "first_text": _text(call.args[0]) if call.args else None,
    }


def source_facts(source: str) -> dict:
    """Facts of one file in the order of a depth-first visit."""
    facts: dict = {"parsed": False, "functions": [], "calls": [], "imports": [], "assigns": [], "bare_excepts": []}
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return facts
    facts["parsed"] = True
    seq = 0
    # Entries are (node, depth, class name, reached through bodies only, to do on leaving).
    stack: list[tuple] = [(tree, 0, None, True, None)]
    while stack:
        node, depth, owner, via_body, leave = stack.pop()
        if leave is not None:
            leave()
            continue
        seq += 1
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
            first = node.body[0]
            function = {
                "name": node.name,
                "class_name": owner,
                "line_start": node.lineno,
                "line_end": node.end_lineno,
                "docstring": _text(first.value) if isinstance(first, ast.Expr) else None,
                "via_body": via_body,
                "first_call": len(facts["calls"]),
            }
            facts["functions"].append(function)
            close = lambda f=function: f.update(n_calls=len(facts["calls"]) - f["first_call"])
            stack.append((None, 0, None, False, close))
        elif isinstance(node, ast.ClassDef):
            owner = node.name
        elif isinstance(node, ast.Call):
            name = node.func.id if isinstance(node.func, ast.Name) else getattr(node.func, "attr", "")
            if name.lower() in LOG_NAMES | OTHER_NAMES:
                call = {"seq": seq, "depth": depth, **_call(node, name)}
                facts["calls"].append(call)
                stack.append((None, 0, None, False, lambda c=call: c.update(seq_end=seq)))
        elif isinstance(node, ast.Raise) and isinstance(node.exc, ast.Call):
            args = [_argument(a, deep=False) for a in node.exc.args]
            facts["calls"].append(
                {"seq": seq, "seq_end": seq, "depth": depth, "line_no": node.lineno, "name": RAISE, "method": False, "args": args}
            )
        elif isinstance(node, ast.Import):
            facts["imports"] += [
                {"seq": seq, "module": a.name, "name": None, "bound": a.asname, "counted": True} for a in node.names
            ]
        elif isinstance(node, ast.ImportFrom) and node.module:
            facts["imports"] += [
                {"seq": seq, "module": node.module, "name": a.name, "bound": a.asname or a.name, "counted": i == 0}
                for i, a in enumerate(node.names)
            ]
        elif isinstance(node, ast.Assign):
            assign = _assign(node)
            if assign:
                facts["assigns"].append({"seq": seq, **assign})
        elif isinstance(node, ast.ExceptHandler) and node.type is None:
            facts["bare_excepts"].append(node.lineno)
        body = getattr(node, "body", None)
        members = {id(c) for c in body} if isinstance(body, list) else set()
        children = [(c, depth + 1, owner, via_body and id(c) in members, None) for c in ast.iter_child_nodes(node)]
        stack.extend(reversed(children))
    return facts


def _fact_pieces(text: pa.Array) -> Iterator[pa.Array]:
    """Facts of the texts in pieces of some PIECE_CHARS characters, one file at least."""
    held, chars = [], 0
    for value in text:
        source = value.as_py() or ""
        held.append(source_facts(source))
        chars += len(source)
        if chars >= PIECE_CHARS:
            yield pa.array(held, type=_FACTS)
            held, chars = [], 0
    yield pa.array(held, type=_FACTS)


def _facts_batch(text: pa.Array) -> pa.Array:
    """Facts of all texts of a batch; as Python objects only those of some PIECE_CHARS characters are held at once."""
    return pa.concat_arrays(list(_fact_pieces(text)))


def _facts_stream(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Facts piece by piece: of a batch, whatever its size, only the texts are held whole.

    What a worker has freed goes back to the system, as idle workers would else keep the most they ever took.
    """
    for text in batches:
        yield from _fact_pieces(text)
        pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim:
        trim(0)


# Ship these helpers inside the task, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def with_facts(files: DataFrame, text: str = "text") -> DataFrame:
    """Add ``facts``; the text itself stays on the JVM side of the exchange."""
    return files.withColumn("facts", F.arrow_udf(_facts_stream, FACTS_DDL)(F.col(text)))


def file_calls(facts: Column) -> Column:
    """The log-like calls of a file, raises left out."""
    return F.filter(facts["calls"], lambda c: c["name"] != RAISE)
