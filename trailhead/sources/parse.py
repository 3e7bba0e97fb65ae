"""Function spans of source files: position, name, callees and a structural fingerprint.

A fingerprint is made of node kinds, keywords and punctuation, never of names or literal text, so renaming does not change
it.  Python goes through its own grammar; C and C++ through a scanner of declarations (``c_family``).  Nested functions belong to the
outermost one.  A Python file with an error is cut into islands, a function each, by indentation; each goes through the
grammar alone, so a broken function costs only itself: it keeps its place, name and calls with a low confidence.  What has
no function that parses becomes one span over the whole file, fingerprinted by its path.
"""

from __future__ import annotations

import ast
import io
import keyword
import re
import tokenize

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schema, session
from ..functions.text import pieces, simhash_py
from . import c_family

C_SUFFIXES = (".cpp", ".h", ".hpp", ".cc")


def _first_name(node: ast.AST) -> str:
    """The leftmost name of a callee: the receiver of a method call."""
    if isinstance(node, ast.Name):
        return node.id
    for child in ast.iter_child_nodes(node):
        if found := _first_name(child):
            return found
    return node.attr if isinstance(node, ast.Attribute) else ""


def python_spans(source: bytes) -> list[tuple]:
    tree = ast.parse(source)
    lines = source.splitlines(keepends=True)
    at = [0]
    for line in lines:
        at.append(at[-1] + len(line))
    place = lambda line, col: at[line - 1] + col
    marks = []
    for t in tokenize.tokenize(io.BytesIO(source).readline):
        if t.type == tokenize.OP or t.type == tokenize.NAME and keyword.iskeyword(t.string):
            col = len(t.line[: t.start[1]].encode())
            marks.append((place(t.start[0], col), t.string))
    out = []

    def visit(node: ast.AST) -> None:
        for child in ast.iter_child_nodes(node):
            if isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef)):
                a, b = place(child.lineno, child.col_offset), place(child.end_lineno, child.end_col_offset)
                calls, kinds = [], []

                def walk(n: ast.AST) -> None:
                    if not isinstance(n, (ast.Name, ast.expr_context)):
                        kinds.append((type(n).__name__, 1))
                    if isinstance(n, ast.Call) and (name := _first_name(n.func)):
                        calls.append(name)
                    for c in ast.iter_child_nodes(n):
                        walk(c)

                walk(child)
                kinds += [(s, 1) for p, s in marks if a <= p < b]
                out.append((a, b, child.name, calls, simhash_py(kinds)))
            else:
                visit(child)

    visit(tree)
    return out


_DEF = re.compile(rb"^([ \t]*)(?:async[ \t]+)?def[ \t]+([A-Za-z_\x80-\xff][\w\x80-\xff]*)", re.M)
#: Within an island: comments, strings, brackets and the beginnings of lines that say something.
_PIECE = re.compile(rb"""(?P<skip>\#[^\n]*|(?P<q>\"{3}|'{3})(?:\\.|(?!(?P=q)).)*(?:(?P=q)|\Z)|"(?:\\.|[^"\\\n])*"?|'(?:\\.|[^'\\\n])*'?)|(?P<open>[(\[{])|(?P<close>[)\]}])|\n(?P<line>[ \t]*)(?=[^\s#])""", re.S | re.X)
_CALL = re.compile(rb"([A-Za-z_\x80-\xff][\w\x80-\xff]*)(?:[ \t]*\.[ \t]*[\w\x80-\xff]+)*[ \t]*\(")
_MARK = re.compile(rb"[A-Za-z_]\w*|[^\w\s]")
#: What a function that does not parse is worth: under the threshold of uncertainty.
BROKEN = 0.25


def _ends(source: bytes, at: int, indent: int) -> list[int]:
    """Where the function whose line begins at ``at`` may end: at the next line no deeper than it, outside of strings and
    brackets; and without regard to these, should they not be closed."""
    depth, strict = 0, len(source)
    for m in _PIECE.finditer(source, at):
        if m["open"]:
            depth += 1
        elif m["close"]:
            depth = max(0, depth - 1)
        elif m["line"] is not None and not depth and len(m["line"]) <= indent:
            strict = m.start() + 1
            break
    plain = re.compile(rb"\n[ \t]{0,%d}(?=[^\s#)\]}])" % indent).search(source, source.find(b"\n", at) if b"\n" in source[at:] else len(source))
    return [strict, plain.start() + 1 if plain else len(source)]


def _decorated(source: bytes, at: int, indent: int, least: int) -> int:
    """Where the decorators of the function whose line begins at ``at`` begin, not before ``least``; ``at`` without any."""
    begin = here = at
    while here > least:
        line_at = max(source.rfind(b"\n", 0, here - 1) + 1, least)
        line = source[line_at:here]
        depth = len(line) - len(line.lstrip(b" \t"))
        if line.lstrip(b" \t").startswith(b"@") and depth == indent:
            begin = line_at
        elif not line.strip() or depth <= indent and line.strip()[:1] not in (b")", b"]", b"}"):
            break  # a decorator goes on deeper, or with a closing bracket
        here = line_at
    return begin


def recovered_spans(source: bytes) -> list[tuple]:
    """Spans of a file that does not parse: (byte_start, byte_end, name, calls, simhash, confidence, error), function by function."""
    out, at = [], 0
    head = b"if 1:\n"  # any indentation parses below it
    while m := _DEF.search(source, at):
        indent, line_at, why = len(m[1]), m.start(), None
        begin, ends = _decorated(source, line_at, indent, at), _ends(source, line_at, indent)
        for end in dict.fromkeys(ends):
            text = source[begin:end]
            try:
                shift = begin - len(head) if indent else begin
                got = python_spans(head + text if indent else text)
                out += [(a + shift, b + shift, *rest, 1.0, None) for a, b, *rest in got]
                break
            except (SyntaxError, ValueError, RecursionError, tokenize.TokenError) as e:
                why = f"{type(e).__name__}: {e}"
        else:
            end = min(ends)
            a, text = line_at + indent, source[line_at + indent : end].rstrip()
            calls = [c.decode("utf-8", "replace") for c in _CALL.findall(text[text.find(b"(") + 1 :]) if not keyword.iskeyword(c.decode("utf-8", "replace"))]
            marks = [t.decode("latin-1") for t in _MARK.findall(text)]
            kinds = [("broken_function", 1), *((t, 1) for t in marks if keyword.iskeyword(t) or not (t[0].isalnum() or t[0] == "_"))]
            out.append((a, a + len(text), m[2].decode("utf-8", "replace"), calls, simhash_py(kinds), BROKEN, why))
        at = max(end, m.end())
    return out


def c_spans(source: bytes) -> list[tuple]:
    out = []
    for a, b, name, calls, kinds in c_family.functions(source):
        out.append((a, b, name, calls, simhash_py([("function_definition", 1), *(("call_expression", 1) for _ in calls), *((k, 1) for k in kinds)])))
    return out


def spans(path: str, source: bytes) -> list[tuple]:
    """(byte_start, byte_end, name, calls, simhash, confidence, error) of a file's functions."""
    try:
        if path.endswith(".py"):
            return [(*s, 1.0, None) for s in python_spans(source)]
        if path.endswith(C_SUFFIXES):
            return [(*s, 1.0, None) for s in c_spans(source)]
        why = None
    except (SyntaxError, ValueError, RecursionError, tokenize.TokenError) as e:
        why = f"{type(e).__name__}: {e}"
        found = recovered_spans(source) if path.endswith(".py") else []
        if any(s[5] == 1.0 for s in found):
            return found
    return [(0, len(source), "", [], simhash_py([(path, 1)]), 0.0, why)]


def parse(files: DataFrame) -> DataFrame:
    """``files`` (file_path, content binary, others) with a column ``spans``; a file stays one row, so map only."""
    session.ship(files.sparkSession)
    files, kind = session.spread(files), T.ArrayType(schema.SPAN)
    names = schema.SPAN.fieldNames()

    def f(batches):
        for b in (part for whole in batches for part in pieces(whole, "content")):
            rows = [[dict(zip(names, s)) for s in spans(p, c)] if c else [] for p, c in zip(b.column("file_path").to_pylist(), b.column("content").to_pylist())]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(rows, _arrow(kind))], [*b.schema.names, "spans"])

    return files.mapInArrow(f, T.StructType([*files.schema.fields, T.StructField("spans", kind)]))


def _arrow(kind: T.DataType):
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def exploded(parsed: DataFrame, outer: bool = False) -> DataFrame:
    """One row a span, with its place in the file (``pos``); ``outer``: a file without spans has one row, without a place."""
    rest = [c for c in parsed.columns if c not in ("spans", "content")]
    each = F.posexplode_outer if outer else F.posexplode
    return parsed.select(*rest, "content", each("spans").alias("pos", "s")).select(*rest, "content", "pos", "s.*")
