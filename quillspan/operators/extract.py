"""Definitions, calls and imports of source files, and file skeletons, by task over Arrow batches of (path, content).

Python is parsed. Of other languages, definitions are a keyword before a name, calls a name before a parenthesis, and the scope of a
definition reaches to the brace that closes it; strings and comments are blanked before. A file that does not parse, or has an
unknown extension, gives no rows.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Languages by extension.
LANGUAGES = {
    "rs": "rust", "py": "python", "js": "javascript", "jsx": "javascript", "ts": "typescript", "tsx": "typescript", "go": "go", "c": "c", "h": "c", "cpp": "cpp",
    "cs": "csharp", "java": "java", "kt": "kotlin", "scala": "scala", "rb": "ruby", "php": "php", "lua": "lua", "sh": "bash",
}
KEYWORD_KINDS = {"fn": "function", "func": "function", "function": "function", "fun": "function", "def": "function", "class": "class", "struct": "struct", "enum": "enum", "trait": "trait", "interface": "interface"}
NOT_CALLED = {"if", "for", "while", "switch", "match", "return", "catch", "sizeof", "fn", "func", "function", "fun", "def"}
SCHEMA = "path string, row string, kind string, name string, owner string, line int"
_BLANKED = re.compile(r"//[^\n]*|/\*.*?\*/|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'", re.S)
_DEFINED = re.compile(r"\b(" + "|".join(KEYWORD_KINDS) + r")\s+(?:\([^)]*\)\s*)?([A-Za-z_]\w*)")
_CALLED = re.compile(r"\b([A-Za-z_]\w*)!?\s*\(")
_IMPORTED = re.compile(r"^\s*(?:use|import)\s+[^\n]*?(\w+)\W*$", re.M)

Row = tuple[str, str, str, str | None, int]


def language(path: Column) -> Column:
    """The language of a path's extension, or null."""
    table = F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])
    return F.try_element_at(table, F.lower(F.regexp_extract(path, r"\.([A-Za-z]+)$", 1)))


def of_python(text: str) -> Iterator[Row]:
    """Rows (row, kind, name, owner, line): owner is the innermost definition around it, none for the module."""
    todo: list[tuple[ast.AST, str | None]] = [(ast.parse(text), None)]
    while todo:
        node, owner = todo.pop()
        inner = owner
        if isinstance(node, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef):
            yield "def", "class" if isinstance(node, ast.ClassDef) else "function", node.name, owner, node.lineno
            inner = node.name if not isinstance(node, ast.ClassDef) else owner
        elif isinstance(node, ast.Call):
            name = getattr(node.func, "id", getattr(node.func, "attr", None))
            if name:
                yield "call", "calls", name, owner, node.lineno
        elif isinstance(node, ast.Import | ast.ImportFrom):
            for x in node.names:
                yield "import", "imports", x.name.split(".")[-1], owner, node.lineno
        todo += [(x, inner) for x in ast.iter_child_nodes(node)]


def of_braces(text: str) -> Iterator[Row]:
    text = _BLANKED.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), text)
    line = lambda at: text.count("\n", 0, at) + 1
    scopes, names = [], set()
    for m in _DEFINED.finditer(text):
        kind, begin, depth, end = KEYWORD_KINDS[m[1]], text.find("{", m.end()), 0, len(text)
        for b in re.finditer(r"[{}]", text[begin:]) if begin >= 0 else ():
            depth += 1 if b[0] == "{" else -1
            if not depth:
                end = begin + b.end()
                break
        names.add(m.start(2))
        owner = next((n for s, e, n in reversed(scopes) if s <= m.start() < e), None)
        yield "def", kind, m[2], owner, line(m.start())
        if kind == "function":
            scopes.append((m.start(), end, m[2]))
    for m in _CALLED.finditer(text):
        if m[1] not in NOT_CALLED and m.start(1) not in names:
            yield "call", "calls", m[1], next((n for s, e, n in reversed(scopes) if s <= m.start() < e), None), line(m.start())
    for m in _IMPORTED.finditer(text):
        yield "import", "imports", m[1], None, line(m.start(1))


def _extracted(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for path, content, lang in zip(batch.path, batch.content, batch.lang, strict=True):
            try:
                rows += [(path, *r) for r in (of_python if lang == "python" else of_braces)(content)]
            except (SyntaxError, ValueError, RecursionError):
                continue
        yield pd.DataFrame(rows, columns=["path", "row", "kind", "name", "owner", "line"]).astype({"line": "int32"})


def extracted(files: DataFrame, languages: list[str] | None = None) -> DataFrame:
    """Rows (path, row: def | call | import, kind, name, owner, line) of files (path, content), of some languages only if they are named."""
    known = files.select("path", "content", language(F.col("path")).alias("lang")).where("lang is not null and content is not null")
    if languages is not None:
        known = known.where(F.col("lang").isin(*map(str.lower, languages)))
    return known.mapInPandas(_extracted, SCHEMA)


def skeleton(text: str) -> str:
    """A Python file with the bodies of functions left out and runs of blank lines as one; classes keep their members."""
    lines, cut = text.split("\n"), {}
    for node in ast.walk(ast.parse(text)):
        if isinstance(node, ast.FunctionDef | ast.AsyncFunctionDef):
            first = node.body[0]
            if first.lineno > node.lineno:
                cut[first.lineno] = (node.end_lineno, " " * first.col_offset + "…")
    out, i = [], 1
    while i <= len(lines):
        if i in cut:
            end, mark = cut[i]
            out.append(mark)
            i = end + 1
            continue
        if lines[i - 1].strip() or (out and out[-1].strip()):
            out.append(lines[i - 1])
        i += 1
    return "\n".join(out)
