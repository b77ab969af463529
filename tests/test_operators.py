"""Operator contracts that SQL does not cover."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from hypothesis import given, settings
from hypothesis import strategies as st

import pytest

from quillspan.functions import codec, stem
from quillspan.functions import text as t
from quillspan.operators import commands, extract, graph, incremental, rules, scripts, search, sessions, structural
from quillspan.plans import code
from quillspan.plans.queries import QUERIES
from quillspan.sources import files, stored, tables
from quillspan.streaming import counters
from tests.conftest import SMALL


def test_subwords(spark):
    cases = {"HTTPServer": ["HTTP", "Server"], "OAuth2Token": ["Auth", "Token"], "MAX_SIZE": [], "plain": []}
    rows = spark.createDataFrame([(k,) for k in cases], "n string").select("n", t.subwords(F.col("n")).alias("p")).collect()
    assert {r.n: r.p for r in rows} == cases


def test_heading_chunks(spark):
    df = spark.createDataFrame([("a\nb\n# c\nd\n# e",), ("# x",), ("",)], "x string").select(t.heading_chunks(F.col("x")).alias("c"))
    assert [r.c for r in df.collect()] == [["a\nb", "# c\nd", "# e"], ["# x"], [""]]


def test_markers_do_not_overlap(spark):
    df = spark.createDataFrame([("You must instead do it",), ("always use x",)], "p string").select(sessions.marker_classes(F.col("p")).alias("m"))
    assert [r.m for r in df.collect()] == [["constraint"], ["decision"]]


def test_risk(spark):
    cases = {"rm -rf x": "block", "rm --dry-run x": "safe", "git status": "safe", "git status | cat": "warn", "ls -R": "warn", "idle": "warn", "git log -5": "safe", "git log": "warn", "mv -v a b": "warn", "": "warn"}
    rows = spark.createDataFrame([(k,) for k in cases], "c string").select("c", rules.risk(F.col("c")).alias("r")).collect()
    assert {r.c: r.r for r in rows} == cases


def test_call_tiers(spark):
    calls = spark.createDataFrame([("a", "f1", "g"), ("b", "f2", "g"), ("c", "f3", "g")], "caller string, file string, callee_name string")
    defs = spark.createDataFrame([("g", "g1", "f1"), ("g", "g4", "f4")], "name string, id string, file string")
    imports = spark.createDataFrame([("f2", "f4", "g")], "file string, from_file string, name string")
    got = sorted(tuple(r) for r in graph.resolve_calls(calls, defs, imports).collect())
    assert got == [("a", "g1"), ("b", "g4"), ("c", "g1"), ("c", "g4")]


def test_page_rank_sums_to_one_and_empty_seed_is_flat(spark):
    nodes = spark.createDataFrame([(x, x, "f") for x in "abcd"], "id string, name string, file string")
    edges = spark.createDataFrame([("a", "b", "calls"), ("b", "c", "calls"), ("c", "d", "contains")], "src string, dst string, kind string")
    ranks = {r.id: r["rank"] for r in graph.page_rank(nodes, edges).collect()}
    assert abs(sum(ranks.values()) - 1) < 1e-9 and ranks["c"] > ranks["b"] > ranks["a"] == ranks["d"]
    none = spark.createDataFrame([("x", 1.0), ("a", -1.0)], "id string, weight double")
    assert {r.id: r["rank"] for r in graph.page_rank(nodes, edges, none).collect()} == ranks


def test_common_and_private_targets_weigh_less(spark):
    nodes = spark.createDataFrame([("m", "m", "g"), *((f"s{i}", f"s{i}", f"f{i}") for i in range(6)), ("hub", "hub", "h"), ("one", "one", "h"), ("p", "_p", "h")], "id string, name string, file string")
    edges = spark.createDataFrame([*((f"s{i}", "hub", "calls") for i in range(6)), ("m", "hub", "calls"), ("m", "one", "imports"), ("m", "p", "calls")], "src string, dst string, kind string")
    shares = {(r.src, r.dst): r.w for r in graph.reference_links(nodes, edges).collect()}
    assert shares["s0", "hub"] == 1.0 and all(abs(shares["m", x] - w / 1.2) < 1e-12 for x, w in (("hub", 0.1), ("one", 1.0), ("p", 0.1)))


def test_shortest_path(spark):
    edges = spark.createDataFrame([("a", "b", "k"), ("a", "c", "k"), ("b", "d", "k"), ("c", "d", "k"), ("x", "y", "k")], "src string, dst string, kind string")
    assert graph.shortest_path(edges, "d", "a").first().path == ["d", "b", "a"]
    assert graph.shortest_path(edges, "a", "a").first().path == ["a"]
    assert graph.shortest_path(edges, "a", "y").count() == 0


def test_replace_chunks(spark):
    old = spark.createDataFrame([("a", "1"), ("b", "2")], "path string, content string")
    diff = spark.createDataFrame([("a", "changed")], "path string, change string")
    new = spark.createDataFrame([("a", "3")], "path string, content string")
    assert sorted(tuple(r) for r in incremental.replace_chunks(old, diff, new).collect()) == [("a", "3"), ("b", "2")]


def _by_line(spark, cases, f):
    rows = spark.createDataFrame([(k,) for k in cases], "c string").select("c", f(F.col("c")).alias("r")).collect()
    assert {r.c: r.r for r in rows} == cases


def test_wrappable(spark):
    _by_line(spark, {"git log | head": True, "git push": False, "cargo test && ls": True, "find . | xargs rm": False, "": False, "/usr/bin/git status": True, "npm run x; pytest": True, "npm install": False}, commands.wrappable)


def test_stateful(spark):
    _by_line(spark, {"cd x && ls": True, "A=1 make": True, "f() { ls; }": True, "echo `id`": True, "ls | wc": False, "": False, "make A=1": False}, commands.stateful)


def test_redirect(spark):
    cases = {"curl http://a": "network", "curl http://a -o f": None, "curl -s u -o -": "network", "mvn package": "build", "python -c 'requests.get(u)'": "network", "ls": None, "node -e 'fetch(\"https://a\")'": "network"}
    _by_line(spark, cases, commands.redirect)


def test_external_tool(spark):
    _by_line(spark, {"mcp__db__query": True, "mcp__own__run": False, "mcp____x": False, "Read": False, "mcp__db": True}, lambda c: commands.external_tool(c, "own"))


def test_codec_forms():
    assert codec.compact([{"a": 1, "b": "long text"}, {"a": 2, "b": "long text"}]) == {"_d": ["long text"], "_v": {"__toon__": {"keys": ["a", "b"], "rows": [[1, "$0"], [2, "$0"]]}}, "_t": True}
    assert codec.compact([3, 3, 3, 1])["_v"] == {"_rle": [[3, 3], [1, 1]]}
    assert codec.compact([{"x": [1]}, {"x": None}])["_v"] == [{"x": [1]}, {}]


_values = st.recursive(
    st.none() | st.booleans() | st.integers(-3, 3) | st.sampled_from(["$0", "$$", "$", "repeated", "", "ä"]),
    lambda x: st.lists(x, max_size=4) | st.dictionaries(st.sampled_from(["a", "b", "_rle", "_tbl", "__toon__", "_d"]), x, max_size=3),
    max_leaves=12,
)


@settings(max_examples=300, deadline=None)
@given(_values)
def test_codec_round_trip(v):
    assert codec.expand(codec.compact(v)) == codec.drop_nulls(v)


PYTHON = "import os.path\n\nclass A:\n    def f(self):\n        return g(1)\n\n\n\ndef g(x):\n    y = x.h()\n    return y\n\ng(2)\n"
RUST = 'use a::b;\nfn f(x: i32) {\n  if (x > 0) { g(x); } // h(1)\n}\nstruct S {}\nfn g(x: i32) { println!("k(2)"); }\n'


def test_extraction(spark):
    files = spark.createDataFrame([("a.py", PYTHON), ("b.rs", RUST), ("c.txt", "def f"), ("d.py", "def ("), ("e.py", None)], "path string, content string")
    got = {(r.path, r.row, r.name, r.owner, r.line) for r in extract.extracted(files).collect()}
    assert got == {
        ("a.py", "import", "path", None, 1), ("a.py", "def", "A", None, 3), ("a.py", "def", "f", None, 4), ("a.py", "call", "g", "f", 5), ("a.py", "def", "g", None, 9),
        ("a.py", "call", "h", "g", 10), ("a.py", "call", "g", None, 13), ("b.rs", "import", "b", None, 1), ("b.rs", "def", "f", None, 2), ("b.rs", "call", "g", "f", 3),
        ("b.rs", "def", "S", None, 5), ("b.rs", "def", "g", None, 6), ("b.rs", "call", "println", "g", 6),
    }
    assert {r.path for r in extract.extracted(files, ["Rust"]).collect()} == {"b.rs"}


def test_skeleton():
    assert extract.skeleton(PYTHON) == "import os.path\n\nclass A:\n    def f(self):\n        …\n\ndef g(x):\n    …\n\ng(2)\n"


def test_imports_of_a_common_name_meet_two_nodes(spark):
    """Many modules that import a name of many nodes: no row for each pair of them."""
    n = 3000
    nodes = spark.range(n).selectExpr("concat('n', id) as id", "'run' as name", "id as place").unionByName(spark.range(n).selectExpr("concat('m', id) as id", "concat('own', id) as name", "id + 9000 as place"))
    imports = spark.range(n).selectExpr("concat('m', id) as module", "'run' as segment").union(spark.createDataFrame([("n0", "run"), ("m1", "own1"), ("m1", "none"), ("m1", None)], "module string, segment string"))
    edges, made = graph.resolve_imports(imports, nodes)
    got = {(r.src, r.dst) for r in edges.collect()}
    assert got == {(f"m{i}", "n0") for i in range(n)} | {("n0", "n1"), ("m1", "import:own1"), ("m1", "import:none"), ("m1", None)}
    assert {r.name for r in made.collect()} == {"own1", "none", None}
    assert _most_rows(spark, edges) < 20 * n


def _rows_made(spark, df) -> list[tuple[str, int]]:
    """(operator, rows) of the plan, as it ran without AQE."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    df = df.select("*")  # planned anew
    try:
        plan = df._jdf.queryExecution().executedPlan()
        df._jdf.queryExecution().toRdd().count()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    out, todo = [], [plan]
    while todo:
        node = todo.pop()
        for metric in ("numOutputRows", "shuffleRecordsWritten"):
            rows = node.metrics().get(metric)
            out += [(node.nodeName(), rows.get().value())] if rows.isDefined() else []
        below = node.children()
        todo += [below.apply(i) for i in range(below.size())]
    return out


def _most_rows(spark, df) -> int:
    return max(n for _, n in _rows_made(spark, df))


def _rows_of(spark, df, operator: str) -> int:
    return sum(n for name, n in _rows_made(spark, df) if name == operator)


def test_calls_meet_the_nearest_definitions_first(spark):
    """A name that each file defines and calls itself makes no row for each pair of files; parsing is dealt out."""
    n = 2000
    file = spark.range(n).selectExpr("concat('f', id) as file", "concat('c', id) as caller", "'run' as callee_name")
    defs = spark.range(n).selectExpr("'run' as name", "concat('d', id) as id", "concat('f', id) as file")
    found = graph.resolve_calls(file, defs, spark.createDataFrame([("f0", "f1", "run")], "file string, from_file string, name string"))
    assert {tuple(r) for r in found.collect()} == {(f"c{i}", f"d{i}") for i in range(n)}
    assert _most_rows(spark, found) < 20 * n
    assert code._files(spark, SMALL).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def _ranks(nodes, links, seed, rounds=20):
    """By the definition: all nodes in every round."""
    n = len(nodes)
    p = np.array([seed.get(x, 0.0) for x in nodes]) / sum(seed.values()) if seed else np.full(n, 1 / n)
    at, r = {x: i for i, x in enumerate(nodes)}, p.copy()
    for _ in range(rounds):
        m = np.zeros(n)
        for a, b in links:
            m[at[b]] += r[at[a]] / sum(x == a for x, _ in links)
        r = 0.15 * p + 0.85 * (m + (1 - m.sum()) * p)
    return dict(zip(nodes, r, strict=True))


@pytest.mark.parametrize("links", [["ab", "ac", "bc", "ca", "cd", "de", "dd"], ["ad", "ae", "bd", "cd"]])
@pytest.mark.parametrize("seed", [{}, {"a": 3.0, "d": 1.0}, {"e": 1.0}])
def test_ranks_move_between_sources_only(spark, monkeypatch, links, seed):
    nodes = spark.createDataFrame([(x, x, "f") for x in "abcde"], "id string, name string, file string")
    edges = spark.createDataFrame([(*x, "calls") for x in links], "src string, dst string, kind string")
    kept = []
    monkeypatch.setattr(graph, "stored", lambda df: kept.append(1) or stored.stored(df))
    ranks = {r.id: r["rank"] for r in graph.page_rank(nodes, edges, spark.createDataFrame([(k, v) for k, v in seed.items()], "id string, weight double") if seed else None).collect()}
    want = _ranks("abcde", links, seed)
    assert all(abs(ranks[x] - want[x]) < 1e-12 for x in "abcde")
    assert len(kept) < 6 or links[0] == "ab", "where no link leads to a source only the last round reads links"


def test_a_small_frontier_goes_to_the_edges(spark, monkeypatch):
    """One hop from a few nodes deals out no edges, and entries of an overview are worked out once."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    kept = []
    monkeypatch.setattr(graph, "stored", lambda df: kept.append(df) or stored.stored(df))
    try:
        edges = spark.range(5000).selectExpr("concat('a', id % 10) as src", "concat('b', id) as dst", "'calls' as kind")
        near = graph.within(edges, spark.createDataFrame([("b7",), ("a3",)], "id string"), 1)
        assert {(r.start, r.id) for r in near.collect()} == {("b7", "b7"), ("b7", "a7"), ("a3", "a3"), *(("a3", f"b{i}") for i in range(3, 5000, 10))}
        assert sum(_rows_of(spark, df, "Exchange") for df in kept) < 5000
        kept.clear()
        asked = spark.createDataFrame([("x", 1.0, 2), ("y", 2.0, 2)], "id string, rank double, tokens long")
        assert graph.overview(asked, 2) == ["y"] and len(kept) == 1
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_short_outputs_are_not_dealt_out(spark, tmp_path):
    """Outputs that are not stored meet no blob: no task gets all of them by their empty reference."""
    rows = [(i, "x" * 4000, "en", "s", 4000) for i in range(400)] + [(400 + i, "y" * 9000 + str(i % 2), "en", "s", 9001) for i in range(4)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        df = QUERIES["U4_offloaded"](spark, str(tmp_path))
        got = {r.doc_id: r for r in df.collect()}
        dealt = _rows_of(spark, df, "Exchange")
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert len(got) == 404 and all(r.whole for r in got.values()) and {k for k, r in got.items() if r.stored} == {400, 401, 402, 403}
    assert len({r.ref for r in got.values()}) == 3 and dealt < 20


def test_batches_of_a_stream_are_written_by_many_tasks(spark, tmp_path):
    rows = spark.range(0, 100, 1, 4)
    taken = []
    counters.each_batch_of(spark, [rows, rows.where("id < 10")], f"{tmp_path}/in", lambda batch, n: taken.append((n, batch.count())))
    assert taken == [(0, 100), (1, 10)] and len(list((tmp_path / "in").glob("*.parquet"))) > 4


def test_symbol_and_overview(spark):
    nodes = spark.createDataFrame([("a", "run", "f1"), ("b", "runner", "f2"), ("c", "stop", "f1"), ("d", "idle", "f3")], "id string, name string, file string")
    edges = spark.createDataFrame([("c", "b", "calls"), ("d", "c", "calls")], "src string, dst string, kind string")
    around, links = graph.symbol(nodes, edges, "RUN", spark.createDataFrame([("f2",)], "file string"), limit=1)
    assert {r.id for r in around.collect()} == {"b", "c"} and [tuple(r) for r in links.collect()] == [("c", "b", "calls")]
    entries = spark.createDataFrame([("hub", 5.0, 9), ("x", 3.0, 4), ("y", 3.0, 4), ("z", 0.1, 1)], "id string, rank double, tokens long")
    assert graph.overview(entries, 9) == ["x", "y", "z"]
    assert graph.overview(entries, 18) == ["hub", "x", "y", "z"]
    assert graph.overview(entries, 0) == []


def test_graph_has_all_edges(spark):
    nodes, edges = tables.graph(spark, SMALL)
    t = {n: pd.read_parquet(f"{SMALL}/{n}.parquet") for n in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")}
    pairs = lambda n, a, ka, b, kb, kind: {(f"{a}:{x}", f"{b}:{y}", kind) for x, y in zip(t[n][ka], t[n][kb], strict=True)}
    want = pairs("nation", "region", "n_regionkey", "nation", "n_nationkey", "contains") | pairs("customer", "nation", "c_nationkey", "customer", "c_custkey", "contains")
    want |= pairs("supplier", "nation", "s_nationkey", "supplier", "s_suppkey", "contains") | pairs("lineitem", "supplier", "l_suppkey", "part", "l_partkey", "imports")
    want |= pairs("orders", "order", "o_orderkey", "customer", "o_custkey", "calls")
    got = [tuple(r) for r in edges.collect()]
    assert len(got) == len(want) and set(got) == want
    ids = [r.id for r in nodes.collect()]
    assert len(ids) == len(set(ids)) == sum(len(t[n]) for n in t if n != "lineitem")


def test_overview_ranks_all_kinds(spark):
    nodes, edges = tables.graph(spark, SMALL)
    rows = nodes.where("kind not in ('region', 'nation')").join(graph.page_rank(nodes, edges), "id").collect()
    cost = {r.id: max(-(-len(r.name) // 4), 1) for r in rows}
    rank = {r.id: r["rank"] for r in rows}
    chosen = [r.id for r in QUERIES["Q15_overview"](spark, SMALL).collect()]
    best = np.zeros(201)
    for k, w in cost.items():
        if w <= 200:
            best[w:] = np.maximum(best[w:], best[: 201 - w] + rank[k])
    assert sum(cost[k] for k in chosen) <= 200 and abs(sum(rank[k] for k in chosen) - best[200]) < 1e-9
    assert any(k.startswith("customer:") for k in chosen)


def test_stems():
    pairs = "consigned consign,consistency consist,knackeries knackeri,kneaded knead,knitting knit,running run,happiness happi,relational relat,generously generous,communication communic,hopping hop,hoping hope,flies fli,ties tie,cries cri,dies die,gas gas,this this,agreed agre,luxuriated luxuri,national nation,organization organ,adjustable adjust,effective effect,rate rate,roll roll,enjoy enjoy,saying say,easily easili,inning inning,proceeding proceed,apologize apolog,analogi analog,beautiful beauti,hopelessly hopeless"
    for word, want in (x.split() for x in pairs.split(",")):
        assert stem.stem(word) == want


def test_stemmed_search_joins_forms_and_index_keeps_up(spark, tmp_path):
    rows = [("a.txt", "a#0", "running dogs run", ""), ("b.txt", "b#0", "he runs", ""), ("c.md", "c#0", "nothing of it", "runner")]
    chunks = spark.createDataFrame(rows, "path string, chunk_id string, content string, symbols string")
    index = search.index_of(chunks, f"{tmp_path}/index")
    queries = spark.createDataFrame([("q", "Running")], "query_id string, query string")
    hits = lambda **k: [r.chunk_id for r in search.top(search.bm25(index, queries, **k), 9).orderBy("rank").collect()]
    assert hits() == ["a#0"] and hits(stemmed=True) == ["a#0", "b#0"]
    index.add(spark.createDataFrame([("a.txt", "a#0", "cats sleep", ""), ("d.txt", "d#0", "a run", "")], chunks.schema), chunks.where("path = 'a.txt'"))
    assert set(hits(stemmed=True)) == {"b#0", "d#0"} and index.chunks().count() == 4
    assert [r.chunk_id for r in search.literal_indexed(index, "SLEEP", 5).collect()] == ["a#0"] and search.literal_indexed(index, "dogs", 5).count() == 0
    assert search.index_of(chunks, f"{tmp_path}/index").chunks().count() == 4


def test_index_is_packed_and_made_when_asked_for(spark, tmp_path):
    """A stored row is a word's or a trigram's of many chunks, and a search makes what it reads and no more."""
    said = lambda i: f"The common words of {'odd' if i % 2 else 'even'} x{i % 7} chunks, the ends of the İs\U0001f600z"
    rows = [(f"p{i}.txt", f"p{i}#0", said(i), "") for i in range(600)] + [("none.txt", "none#0", None, None), ("two.txt", "two#0", "ab", "f")]
    chunks = spark.createDataFrame(rows, "path string, chunk_id string, content string, symbols string").coalesce(2)
    index = search.index_of(chunks, f"{tmp_path}/index")
    assert search.literal(index.chunks(), "od", 1000).count() == 300
    assert not any((tmp_path / "index" / x).exists() for x in ("postings", "trigrams"))
    assert search.literal_indexed(index, "ODD X3", 1000).count() == 43 and search.literal_indexed(index, "\U0001f600z", 1000).count() == 600
    assert not (tmp_path / "index/postings").exists() and spark.read.parquet(f"{tmp_path}/index/trigrams").count() < 6000
    want = {(f, w, c): [i for i, x in enumerate(ws) if x == w] for _, c, *texts in rows for f, text in zip(("content", "symbols"), texts, strict=True) for ws in [spark_tokens(text)] for w in set(ws)}
    got = {(r.field, r.term, r.chunk_id): r for r in index.postings().collect()}
    assert {k: r.places for k, r in got.items()} == want and all(r.tf == len(r.places) for r in got.values())
    assert got["content", "the", "p3#0"].len == len(spark_tokens(said(3))) and got["content", "chunks", "p3#0"].stem == "chunk"
    assert spark.read.parquet(f"{tmp_path}/index/postings").count() < 200


def spark_tokens(text) -> list[str]:
    import re

    return [x for x in re.split(r"[^a-z0-9]+", (text or "").lower().replace("i̇", "i ")) if x]


def test_patterns():
    code = "class A:\n    def f(self):\n        return g(1, 'x')\n\ndef g(a, b):\n    return h.k(a)\n"
    got = lambda p: [(n, line, x) for n, line, _, x in structural.captures(code, structural.parse(p))]
    assert got("(Call func: (Name id: @n))") == [("n", 3, "g")] and got("(Call func: (Attribute attr: @a))") == [("a", 6, "k")]
    assert got('(FunctionDef name: "g" body: (Return) @r)') == [("r", 6, "return h.k(a)")]
    assert got("(Call args: (Constant value: @v))") == [("v", 3, "1")] and got('(Call args: (Constant value: "x") @v)') == [("v", 3, "'x'")]
    assert got('(Call func: (Name id: "h") @v)') == []
    assert got("(ClassDef (FunctionDef name: @m))") == [("m", 2, "f")]
    for wrong in ("(Nothing)", "(Call", "Call", "(Call) (Call)", ""):
        with pytest.raises(ValueError):
            structural.parse(wrong)


def test_scripts_report_codes_and_time(spark):
    rows = spark.createDataFrame([("a", "x"), ("b", None)], "id string, content string")
    got = {r.id: r for r in scripts.run_script(rows, "import sys; t = sys.stdin.read(); print(t or sys.exit(3))").collect()}
    assert (got["a"].exit_code, got["a"].stdout, got["a"].input_bytes) == (0, "x\n", 1) and (got["b"].exit_code, got["b"].input_bytes) == (3, 0)
    slow = scripts.run_script(rows.limit(1), "import time; time.sleep(9)", timeout=0.3).first()
    assert slow.exit_code is None and "stopped" in slow.stderr


def test_walk_rules_and_missing_root(spark, tmp_path):
    for name in ("a.txt", "sub/b.txt", "sub/deep/c.py", "build/d.txt"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"ok" if name != "sub/b.txt" else b"\xff\xfe")
    paths = lambda **k: {r.path for r in files.walk(spark, str(tmp_path), **k).collect()}
    assert paths() == {"a.txt", "sub/b.txt", "sub/deep/c.py", "build/d.txt"} and paths(recursive=False) == {"a.txt"}
    assert paths(ignore=("build/", "*.py")) == {"a.txt", "sub/b.txt"} and paths(ignore=("/sub/**",)) == {"a.txt", "build/d.txt"} and paths(extensions=("py",)) == {"sub/deep/c.py"}
    assert {r.path for r in files.walk(spark, f"{tmp_path}/a.txt").collect()} == {"a.txt"}
    assert files.whole_texts(spark, str(tmp_path)).count() == 3
    with pytest.raises(FileNotFoundError):
        files.walk(spark, f"{tmp_path}/none")


def test_short_references_are_met_by_prefix(spark):
    blobs = spark.createDataFrame([("{}",), ('{"a": 1}',)], "content string").selectExpr("sha2(content, 256) as hash", "content")
    refs = blobs.selectExpr("1L as seq", "substring(hash, 1, 12) as ref").unionByName(blobs.selectExpr("2L as seq", "hash as ref")).unionByName(spark.createDataFrame([(3, "0" * 64)], "seq long, ref string"))
    assert sorted((r.seq, r.status) for r in incremental.verified(refs, blobs, 10).collect()) == [(1, "PASS"), (1, "PASS"), (2, "PASS"), (2, "PASS"), (3, "MISSING")]
