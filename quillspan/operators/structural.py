"""Structural queries over source files: patterns of a small language, matched against syntax trees, a row for each capture.

    pattern  (Type field: pattern pattern ... "text")   the type is that of a Python syntax node, or _ for any
    field    name: pattern                              the field's value, or one of its values, matches
    child    pattern                                    some node directly below matches
    text     "text"                                     a field that is a name or a constant is exactly this
    capture  pattern @name                              what matches is a row; also behind a field: name: @capture

Only Python is parsed. A file that does not parse gives no rows.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspan.operators.extract import language

LIMIT, WIDTH = 100, 120
SCHEMA = "path string, capture string, line int, place int, text string"
_TOKEN = re.compile(r'\s*(?:([()])|([A-Za-z_]\w*)(\s*:)?|@(\w+)|"((?:[^"\\]|\\.)*)"|(\S))')


@dataclass
class Pattern:
    kind: str = "_"
    fields: list[tuple[str, Pattern]] = field(default_factory=list)
    below: list[Pattern] = field(default_factory=list)
    text: str | None = None
    capture: str | None = None


def parse(source: str) -> Pattern:
    """The pattern that a text spells; a ValueError names what is wrong with one that spells none."""
    tokens = [m.groups() for m in _TOKEN.finditer(source) if m[0].strip()]
    at = 0

    def peek() -> tuple:
        return tokens[at] if at < len(tokens) else (None,) * 6

    def one() -> Pattern:
        nonlocal at
        bracket, word, _, capture, text, other = peek()
        if capture is not None:  # a capture alone is any node
            at += 1
            return Pattern(capture=capture)
        if text is not None:
            at += 1
            out = Pattern(text=text.replace('\\"', '"'))
        elif word == "_":
            at += 1
            out = Pattern()
        elif bracket == "(":
            at += 1
            kind = peek()[1]
            if kind is None or (kind != "_" and not hasattr(ast, kind)):
                raise ValueError(f"no kind of node: {kind or source!r}")
            at += 1
            out = Pattern(kind)
            while peek()[0] != ")":
                if at >= len(tokens):
                    raise ValueError("a bracket is not closed")
                _, name, colon, *_ = peek()
                if colon:
                    at += 1
                    out.fields.append((name, one()))
                else:
                    out.below.append(one())
            at += 1
        else:
            raise ValueError(f"not a pattern: {other or word or bracket or source!r}")
        if peek()[3] is not None:
            out.capture = peek()[3]
            at += 1
        return out

    found = one()
    if at < len(tokens):
        raise ValueError("more than one pattern")
    return found


def match(pattern: Pattern, value: object, parent: ast.AST | None = None) -> list[tuple[str, object, ast.AST]] | None:
    """(capture, value, node that has a place) of a match; None if there is none."""
    own = value if isinstance(value, ast.AST) and hasattr(value, "lineno") else parent
    if pattern.text is not None:
        if not isinstance(value, str) or value != pattern.text:
            return None
    elif pattern.kind != "_" and type(value).__name__ != pattern.kind:
        return None
    found = [(pattern.capture, value, own)] if pattern.capture and own is not None else []
    for name, inner in pattern.fields:
        held = getattr(value, name, None)
        hit = next((x for v in (held if isinstance(held, list) else [held]) if v is not None and (x := match(inner, v, own)) is not None), None)
        if hit is None:
            return None
        found += hit
    for inner in pattern.below:
        hit = next((x for v in (ast.iter_child_nodes(value) if isinstance(value, ast.AST) else ()) if (x := match(inner, v, own)) is not None), None)
        if hit is None:
            return None
        found += hit
    return found


def captures(text: str, pattern: Pattern) -> Iterator[tuple[str, int, int, str]]:
    """(capture, line, place, text) of every match in a file, in the order of the text."""
    rows = []
    for node in ast.walk(ast.parse(text)):
        for name, value, where in match(pattern, node) or ():
            shown = value if isinstance(value, str) else ast.get_source_segment(text, where) or ""
            rows.append((where.lineno, where.col_offset, name, shown[:WIDTH]))
    rows.sort()
    for place, (line, _, name, shown) in enumerate(rows):
        yield name, line, place, shown


def grep_ast(files: DataFrame, pattern: str, limit: int | None = LIMIT) -> DataFrame:
    """(path, capture, line, place, text), by path and place, the first ``limit``; ``truncated`` says whether they are as many."""
    parsed = parse(pattern)  # a wrong pattern is an error here, not in a task

    def of(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                try:
                    rows += [(path, *r) for r in captures(text, parsed)]
                except (SyntaxError, ValueError, RecursionError):
                    continue
            kinds = (pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [()] * 5, kinds)], ["path", "capture", "line", "place", "text"])

    python = files.where((language(F.col("path")) == "python") & F.col("content").isNotNull()).select("path", "content")
    found = python.mapInArrow(of, SCHEMA)
    return found if limit is None else found.orderBy("path", "place").limit(limit)
