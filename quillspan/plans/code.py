"""Queries over source files, written from the parts (a file a part, of three languages), over command lines, and over further text scalars."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from quillspan.functions import text as t
from quillspan.operators import commands, extract, rules, structural
from quillspan.operators import graph as g
from quillspan.plans.queries import COMMANDS, query
from quillspan.sources.stored import stored
from quillspan.sources.tables import CHUNKS, OPS, chunks, op_records, table

_PYTHON = "from app.part_{n} import load_{n}\n\nclass Part{k}:\n    def size(self):\n        return load_{k}({s})\n\ndef load_{k}(n):\n    return n\n\ndef main_{k}():\n    load_{n}(load_{k}(1))\n"
_RUST = "use store::load_{n};\nfn main_{k}() {\n  load_{n}(load_{k}(1));\n}\nfn load_{k}(n: i32) -> i32 { n }\n"
_SKELETON = "from app.part_{n} import load_{n}\n\nclass Part{k}:\n    def size(self):\n        …\n\ndef load_{k}(n):\n    …\n\ndef main_{k}():\n    …\n"


def _filled(template, k, n, s):
    """A template's text with the columns in its places."""
    out = F.lit(template)
    for name, column in (("{k}", k), ("{n}", n), ("{s}", s)):
        out = F.replace(out, F.lit(name), column.cast("string"))
    return out


def _files(s, d):
    """(path, content): Python, Rust and text in turn; each Python file imports what the next one defines."""
    k = F.col("p_partkey")
    path = F.when(k % 3 == 0, F.concat(F.lit("app/part_"), k.cast("string"), F.lit(".py"))).when(k % 3 == 1, F.concat(F.lit("src/part_"), k.cast("string"), F.lit(".rs"))).otherwise(F.concat(F.lit("doc/part_"), k.cast("string"), F.lit(".txt")))
    content = F.when(k % 3 == 0, _filled(_PYTHON, k, k + 3, F.col("p_size"))).when(k % 3 == 1, _filled(_RUST, k, k + 3, F.col("p_size"))).otherwise("def nothing of the kind")
    # a file of parts is small, the sources written from it take long to parse: their keys are dealt out
    parts = table(s, d, "part").select("p_partkey", "p_size").repartition(3 * s.sparkContext.defaultParallelism)
    return parts.select(path.alias("path"), content.alias("content"), k.alias("k"))


_PATH = "CASE p_partkey % 3 WHEN 0 THEN 'app/part_' || p_partkey || '.py' WHEN 1 THEN 'src/part_' || p_partkey || '.rs' ELSE 'doc/part_' || p_partkey || '.txt' END"
_ROWS = [
    (0, "import", "imports", "'load_' || n", "NULL", 1), (0, "def", "class", "'Part' || k", "NULL", 3), (0, "def", "function", "'size'", "NULL", 4), (0, "call", "calls", "'load_' || k", "'size'", 5), (0, "def", "function", "'load_' || k", "NULL", 7),
    (0, "def", "function", "'main_' || k", "NULL", 10), (0, "call", "calls", "'load_' || n", "'main_' || k", 11), (0, "call", "calls", "'load_' || k", "'main_' || k", 11),
    (1, "import", "imports", "'load_' || n", "NULL", 1), (1, "def", "function", "'main_' || k", "NULL", 2), (1, "call", "calls", "'load_' || n", "'main_' || k", 3), (1, "call", "calls", "'load_' || k", "'main_' || k", 3), (1, "def", "function", "'load_' || k", "NULL", 5),
]
_EXTRACTED = f"p AS (SELECT {_PATH} AS path, p_partkey AS k, p_partkey + 3 AS n, p_size AS s FROM part), rows AS (" + " UNION ALL ".join(f"SELECT path, '{row}' AS row, '{kind}' AS kind, {name} AS name, {owner} AS owner, {line} AS line FROM p WHERE k % 3 = {m}" for m, row, kind, name, owner, line in _ROWS) + ")"


@query("G1_extracted", f"WITH {_EXTRACTED} SELECT path, row, kind, name, coalesce(owner, '-') AS owner, line FROM rows")
def _(s, d):
    return extract.extracted(_files(s, d)).withColumn("owner", F.coalesce("owner", F.lit("-")))


@query("G2_other_languages", f"WITH {_EXTRACTED} SELECT path, count(*) FILTER (row = 'def') AS defs, count(*) FILTER (row = 'call') AS calls FROM rows WHERE path LIKE '%.rs' GROUP BY 1")
def _(s, d):
    """Definitions and calls of a language that is read by its keywords and braces."""
    rows = extract.extracted(_files(s, d).where("path like '%.rs'"))
    return rows.groupBy("path").agg(F.count_if(F.col("row") == "def").alias("defs"), F.count_if(F.col("row") == "call").alias("calls"))


@query("G3_languages", f"SELECT {_PATH} AS path, CASE p_partkey % 3 WHEN 0 THEN 'python' WHEN 1 THEN 'rust' END AS language FROM part")
def _(s, d):
    return _files(s, d).select("path", extract.language(F.col("path")).alias("language"))


@query("G4_of_language", f"WITH {_EXTRACTED} SELECT path, count(*) AS n FROM rows WHERE path LIKE '%.py' GROUP BY 1")
def _(s, d):
    return extract.extracted(_files(s, d), ["PYTHON", "Go"]).groupBy("path").agg(F.count("*").alias("n"))


@query("G9_resolved_calls", f"""WITH {_EXTRACTED}, x AS (SELECT *, (SELECT max(p_partkey) FROM part) AS most FROM p WHERE k % 3 = 0)
  SELECT path || ':size' AS caller, path || ':load_' || k || ':7' AS callee FROM x UNION ALL SELECT path || ':main_' || k, path || ':load_' || k || ':7' FROM x UNION ALL SELECT path || ':main_' || k, 'app/part_' || n || '.py:load_' || n || ':7' FROM x WHERE n <= most""")
def _(s, d):
    """Calls of functions, resolved in the file, then through its imports, then anywhere."""
    rows = stored(extract.extracted(_files(s, d), ["python"]))  # parsed once
    defs = rows.where("row = 'def'").select("name", F.concat_ws(":", "path", "name", "line").alias("id"), F.col("path").alias("file"))
    calls = rows.where("row = 'call' and owner is not null").select(F.concat_ws(":", "path", "owner").alias("caller"), F.col("path").alias("file"), F.col("name").alias("callee_name"))
    imports = rows.where("row = 'import'").select(F.col("path").alias("file"), "name").join(defs.select("name", F.col("file").alias("from_file")), "name").where("file <> from_file").select("file", "from_file", "name")
    return g.resolve_calls(calls, defs, imports.distinct())


@query("A1_grep_ast", f"""WITH {_EXTRACTED}, c AS (SELECT path, k, n, unnest([5, 11, 11]) AS line, unnest([0, 1, 2]) AS place FROM p WHERE k % 3 = 0)
  SELECT path, 'callee' AS capture, line, place, CASE place WHEN 1 THEN 'load_' || n ELSE 'load_' || k END AS text FROM c ORDER BY path, place LIMIT 100""")
def _(s, d):
    """The names of the functions called, the first hundred."""
    return structural.grep_ast(_files(s, d), "(Call func: (Name id: @callee))")


@query("A1_methods", f"WITH {_EXTRACTED} SELECT path, capture, line, text FROM (SELECT path, 'class' AS capture, 3 AS line, 'Part' || k AS text FROM p WHERE k % 3 = 0 UNION ALL SELECT path, 'method', 4, 'def size(self):' || chr(10) || '        return load_' || k || '(' || s || ')' FROM p WHERE k % 3 = 0)")
def _(s, d):
    """Classes with a method of a given name, and the method."""
    found = structural.grep_ast(_files(s, d), '(ClassDef name: @class body: (FunctionDef name: "size") @method)', None)
    return found.select("path", "capture", "line", "text")


@query("A2_skeletons", "SELECT 'app/part_' || p_partkey || '.py' AS path, replace(replace('" + _SKELETON.replace("\n", "' || chr(10) || '") + "', '{k}', CAST(p_partkey AS VARCHAR)), '{n}', CAST(p_partkey + 3 AS VARCHAR)) AS skeleton FROM part WHERE p_partkey % 3 = 0")
def _(s, d):
    def cut(texts: pa.Array) -> pa.Array:
        return pa.array([extract.skeleton(x) for x in texts.to_pylist()], pa.string())

    return _files(s, d).where(extract.language(F.col("path")) == "python").select("path", F.arrow_udf(cut, StringType())("content").alias("skeleton"))


@query("T1_heading_chunks", "SELECT p_partkey, unnest(range(3)) AS i, unnest(['# ' || p_name || chr(10) || 'text' || chr(10), '# B' || chr(10) || chr(10), '## C' || chr(10) || p_brand]) AS content FROM part")
def _(s, d):
    text = F.concat(F.lit("# "), "p_name", F.lit("\ntext\n\n# B\n\n\n## C\n"), "p_brand")
    return table(s, d, "part").select("p_partkey", F.posexplode(t.heading_chunks(text)).alias("i", "content")).withColumn("i", F.col("i").cast("long"))


@query("T4_symbols", f"SELECT {_PATH} AS path, CASE p_partkey % 3 WHEN 0 THEN 'Part' || p_partkey || ' load_' || p_partkey || ' main_' || p_partkey || ' size' WHEN 1 THEN 'load_' || p_partkey || ' main_' || p_partkey ELSE 'nothing' END AS symbols FROM part")
def _(s, d):
    return _files(s, d).select("path", t.symbols(F.col("content")).alias("symbols"))


@query("T5_subwords", "SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN [a, upper(b[1]) || b[2:], 'HTTP', 'Server'] ELSE [] END AS parts FROM (SELECT p_partkey, split_part(p_name, ' ', 1) AS a, split_part(p_name, ' ', 2) AS b FROM part)")
def _(s, d):
    a, b = F.split_part("p_name", F.lit(" "), F.lit(1)), F.split_part("p_name", F.lit(" "), F.lit(2))
    name = F.when(F.col("p_partkey") % 2 == 0, F.concat(a, F.initcap(b), F.lit("HTTPServer"))).otherwise(F.upper(F.concat(a, F.lit("_"), b)))
    return table(s, d, "part").select("p_partkey", t.subwords(name).alias("parts"))


_HIT = "(contains(lower(x), 'the') OR contains(lower(x), 'license'))"


@query("T13_snippets", f"""WITH {CHUNKS}, w AS (SELECT chunk_id, list_filter(string_split_regex(content, '[ \\t\\n\\r\\f\\x0B]+'), lambda x: x <> '') AS w FROM chunks),
  f AS (SELECT *, greatest(coalesce(list_position(list_transform(w, lambda x: {_HIT}), true), 0) - 5, 0) AS a FROM w)
  SELECT chunk_id, CASE WHEN a > 0 THEN '… ' ELSE '' END || array_to_string(list_transform(w[a + 1 : a + 24], lambda x: CASE WHEN {_HIT} THEN '[' || x || ']' ELSE x END), ' ') || CASE WHEN a + 24 < len(w) THEN ' …' ELSE '' END AS snippet FROM f""")
def _(s, d):
    return chunks(s, d).select("chunk_id", t.snippet(F.col("content"), F.array(F.lit("the"), F.lit("license"))).alias("snippet"))


#: Command lines with what is true of each: stateful, wrappable, redirect.
LABELLED = (
    ("git log | head", False, True, None), ("git push", False, False, None), ("cargo test && ls", False, True, None), ("find . | xargs rm", False, False, None), ("", False, False, None), ("cd x && ls", True, False, None),
    ("A=1 make", True, False, None), ("f() { ls; }", True, False, None), ("curl http://a", False, True, "network"), ("curl http://a -o f", False, True, None), ("curl -s u -o -", False, True, "network"), ("mvn package", False, True, "build"),
    ("python -c 'requests.get(u)'", False, False, "network"), ("node -e 'fetch(\"https://a\")'", False, False, "network"), ("/usr/bin/git status", False, True, None), ("npm run x; pytest", False, True, None), ("echo `id`", True, False, None), ("pip install x", False, False, None),
)
#: The risk of each of the sample commands.
RISKS = ("block", "safe", "safe", "safe", "warn", "safe", "warn", "warn", "safe", "warn", "safe", "safe", "safe", "warn", "warn", "block", "warn", "warn")


def _lines(s, d, lines):
    """Op records with a command line each, by their number."""
    return op_records(s, d).select("seq", "k", F.get(F.array(*map(F.lit, lines)), (F.col("seq") % len(lines)).cast("int")).alias("command"))


def _truth(values) -> str:
    quote = lambda v: "NULL" if v is None else str(v).lower() if isinstance(v, bool) else "'" + v.replace("'", "''") + "'"
    return "truth(i, v) AS (VALUES " + ", ".join(f"({i}, {quote(v)})" for i, v in enumerate(values)) + ")"


def _labelled(column: int, name: str) -> str:
    return f"WITH {OPS}, {_truth([x[column] for x in LABELLED])} SELECT seq, v AS {name} FROM ops JOIN truth ON i = seq % {len(LABELLED)}"


def _of(s, d, f, name):
    return _lines(s, d, [x[0] for x in LABELLED]).select("seq", f(F.col("command")).alias(name))


@query("H5_stateful", _labelled(1, "stateful"))
def _(s, d):
    return _of(s, d, commands.stateful, "stateful")


@query("H6_wrappable", _labelled(2, "wrappable"))
def _(s, d):
    return _of(s, d, commands.wrappable, "wrappable")


@query("H8_redirects", _labelled(3, "redirect"))
def _(s, d):
    return _of(s, d, commands.redirect, "redirect")


@query("H7_risk", f"WITH {OPS}, {_truth(RISKS)} SELECT seq, v AS risk FROM ops JOIN truth ON i = seq % {len(RISKS)}")
def _(s, d):
    return _lines(s, d, COMMANDS).select("seq", rules.risk(F.col("command")).alias("risk"))


@query("H9_external_tools", f"WITH {OPS}, {_truth((True, False, False, False))} SELECT seq, v AS external FROM ops JOIN truth ON i = seq % 4")
def _(s, d):
    return _lines(s, d, ("mcp__db__query", "mcp__own__run", "mcp____x", "Read")).select("seq", F.coalesce(commands.external_tool(F.col("command"), "own"), F.lit(False)).alias("external"))


_EVENTS = ((0, "git", "other"), (1, "git", "push"), (5, "environment", "cd x && ls"), (8, "error", "no route"), (9, "error", "no route"), (10, "error", "no route"), (17, "environment", "pip install x"))


@query("E3_command_events", f"WITH {OPS}, e(i, category, detail) AS (VALUES " + ", ".join(f"({i}, '{c}', '{x}')" for i, c, x in _EVENTS) + f") SELECT seq, category, detail FROM ops JOIN e ON i = seq % {len(LABELLED)}")
def _(s, d):
    events = commands.command_events(F.col("command"), F.col("command").contains("curl"), F.lit("no route"))
    return _lines(s, d, [x[0] for x in LABELLED]).select("seq", F.explode(events).alias("e")).select("seq", "e.category", "e.detail")
