"""A reversible compaction of JSON values: null fields dropped, tables transposed, repeated strings referred to, runs of integers counted.

``expand(compact(v))`` is ``v`` without its null fields. The result is ``{"_d": strings, "_v": value, "_t": whether markers are in use}``.
Values that hold a marker as a key are neither transposed nor run-length encoded. JSON of any shape has no Catalyst type, so columns
go through Arrow batches.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from typing import Any

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Marker keys, the least bytes of a string worth a reference, the least rows of a table.
TABLE, FLAT, RUNS = "_tbl", "__toon__", "_rle"
LEAST_BYTES, LEAST_ROWS = 5, 2
_REFERENCE = re.compile(r"\$(\d+)")


def drop_nulls(v: Any) -> Any:
    """Without the null fields of objects; nulls in arrays stay."""
    if isinstance(v, dict):
        return {k: drop_nulls(v[k]) for k in sorted(v) if v[k] is not None}
    return [drop_nulls(x) for x in v] if isinstance(v, list) else v


def _nodes(v: Any):
    todo = [v]
    while todo:
        x = todo.pop()
        yield x
        todo += x.values() if isinstance(x, dict) else x if isinstance(x, list) else ()


def _is_number(x: Any) -> bool:
    return isinstance(x, int) and not isinstance(x, bool)


def _packed(v: Any, names: dict[str, int], markers: bool) -> Any:
    if isinstance(v, str):
        return f"${names[v]}" if v in names else "$" + v if v.startswith("$") else v
    if isinstance(v, dict):
        return {k: _packed(x, names, markers) for k, x in v.items()}
    if not isinstance(v, list):
        return v
    if markers and len(v) >= LEAST_ROWS:
        if all(isinstance(x, dict) and x and x.keys() == v[0].keys() for x in v):
            columns = list(v[0])
            rows = [[_packed(x[c], names, markers) for c in columns] for x in v]
            flat = not any(isinstance(cell, dict | list) for x in v for cell in x.values())
            return {FLAT: {"keys": columns, "rows": rows}} if flat else {TABLE: {"c": columns, "r": rows}}
        if all(map(_is_number, v)):
            runs: list[list[int]] = []
            for x in v:
                if runs and runs[-1][0] == x:
                    runs[-1][1] += 1
                else:
                    runs.append([x, 1])
            if len(runs) < len(v):
                return {RUNS: runs}
    return [_packed(x, names, markers) for x in v]


def compact(v: Any) -> dict:
    v = drop_nulls(v)
    nodes = list(_nodes(v))
    markers = not any(isinstance(x, dict) and not {TABLE, FLAT, RUNS}.isdisjoint(x) for x in nodes)
    seen = Counter(x for x in nodes if isinstance(x, str) and len(x.encode()) >= LEAST_BYTES)
    strings = sorted((x for x, n in seen.items() if n > 1), key=lambda x: (-seen[x], x))
    return {"_d": strings, "_v": _packed(v, {x: i for i, x in enumerate(strings)}, markers), "_t": markers}


def expand(packed: dict) -> Any:
    strings, markers = packed["_d"], packed.get("_t", True)

    def back(x: Any) -> Any:
        if isinstance(x, str):
            found = _REFERENCE.fullmatch(x)
            return strings[int(found[1])] if found else x[1:] if x.startswith("$$") else x
        if isinstance(x, list):
            return [back(y) for y in x]
        if not isinstance(x, dict):
            return x
        if markers and len(x) == 1:
            (kind, body), = x.items()
            if kind == RUNS:
                return [value for value, n in body for _ in range(n)]
            if kind in (TABLE, FLAT):
                columns, rows = (body["c"], body["r"]) if kind == TABLE else (body["keys"], body["rows"])
                return [dict(zip(columns, map(back, row), strict=True)) for row in rows]
        return {k: back(y) for k, y in x.items()}

    return back(packed["_v"])


def _column(f):
    def of(x: str | None) -> str | None:
        try:
            return None if x is None else json.dumps(f(json.loads(x)), ensure_ascii=False, separators=(",", ":"), sort_keys=True)
        except ValueError:
            return None

    def over(s: pd.Series) -> pd.Series:
        return pd.Series([of(x) for x in s], dtype=object)

    return F.pandas_udf(over, StringType())


#: Columns of JSON text; null and text that is no JSON give null.
compacted, expanded, without_nulls = _column(compact), _column(expand), _column(drop_nulls)
