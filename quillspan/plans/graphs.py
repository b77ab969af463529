"""Queries over the graph: names, ranks, neighbourhoods, paths, overviews, its construction."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillspan.functions import text as t
from quillspan.operators import graph as g
from quillspan.plans.queries import query
from quillspan.sources.tables import GRAPH, graph, op_records, table


def ranks_sql(seed: str | None = None, rounds: int = g.ROUNDS, last: str = "ranks") -> str:
    """Common table expressions of the rank over ``nodes`` and ``edges``, a round each; ``seed`` names a table (id, weight) of the teleport."""
    share = f"coalesce(weight / (SELECT sum(weight) FROM {seed}), 0)::DOUBLE AS p FROM nodes LEFT JOIN {seed} USING (id)" if seed else "(1.0::DOUBLE / (SELECT count(*) FROM nodes)) AS p FROM nodes"
    out = [
        "refs AS MATERIALIZED (SELECT src, dst FROM edges WHERE kind IN ('calls', 'imports'))",
        "used AS (SELECT dst, count(DISTINCT file) AS files FROM refs JOIN nodes ON id = src GROUP BY 1)",
        "weights AS (SELECT dst, (CASE WHEN files > 5 THEN 0.1 ELSE 1.0 END)::DOUBLE * (CASE WHEN name[1] = '_' THEN 0.1 ELSE 1.0 END) AS w FROM used JOIN nodes ON id = dst)",
        "links AS MATERIALIZED (SELECT src, dst, w / sum(w) OVER (PARTITION BY src) AS l FROM refs JOIN weights USING (dst))",
        f"tele AS MATERIALIZED (SELECT id, {share})",
        "r0 AS (SELECT id, p AS r FROM tele)",
    ]
    for i in range(rounds):
        out.append(f"m{i} AS MATERIALIZED (SELECT dst AS id, sum(r * l) AS m FROM links JOIN r{i} ON id = src GROUP BY 1)")
        name = f"r{i + 1}" if i + 1 < rounds else last
        out.append(f"{name} AS MATERIALIZED (SELECT id, 0.15 * p + 0.85 * (coalesce(m, 0) + (1 - (SELECT coalesce(sum(m), 0) FROM m{i})) * p) AS {'r' if name != last else 'rank'} FROM tele LEFT JOIN m{i} USING (id))")
    return ",\n".join(out)


#: Ranks of a million nodes are millionths: this keeps enough of their digits.
_SHOWN = "round({} * 1e6, 3)"


def _shown(rank: str):
    return F.round(F.col(rank) * 1e6, 3)


@query("Q1_find_by_name", f"WITH {GRAPH} SELECT id, name, kind FROM nodes WHERE contains(lower(name), 'ion_1') AND kind = 'nation'")
def _(s, d):
    return graph(s, d)[0].where(F.contains(F.lower("name"), F.lit("ion_1")) & (F.col("kind") == "nation")).orderBy("id").select("id", "name", "kind")


_WORDS = ["small", "ring", "nation"]
_EACH = [f"CASE WHEN list_contains(w, '{x}') THEN 3 WHEN starts_with(l, '{x}') THEN 2 WHEN contains(l, '{x}') THEN 1 ELSE 0 END" for x in _WORDS]
_FOUND = f"""named AS (SELECT id, lower(name) AS l, list_filter(string_split_regex(lower(name), '[^\\pL\\pN]+'), lambda x: x <> '') AS w FROM nodes),
each AS (SELECT id, {", ".join(f"{x} AS s{i}" for i, x in enumerate(_EACH))} FROM named),
found AS MATERIALIZED (SELECT id, s0 + s1 + s2 + 2 * greatest((s0 > 0)::INT + (s1 > 0)::INT + (s2 > 0)::INT - 1, 0) AS score FROM each WHERE s0 + s1 + s2 > 0)"""


def _name_tokens():
    return t.identifier_tokens(F.col("name"))


@query("Q4_find", f"WITH {GRAPH}, {_FOUND} SELECT id, score FROM found")
def _(s, d):
    return g.find(graph(s, d)[0], _WORDS, _name_tokens()).select("id", "score")


@query("Q5_raw", f"WITH {GRAPH}, {_FOUND} SELECT id, score, row_number() OVER (ORDER BY score DESC, id) AS place FROM found QUALIFY place <= 30")
def _(s, d):
    return g.find_ranked(*graph(s, d), _WORDS, _name_tokens(), 30, "raw")


_SEED = "seed AS (SELECT id, score AS weight FROM found)"


@query("Q5_personalized", f"WITH {GRAPH}, {_FOUND}, {_SEED}, {ranks_sql('seed')} SELECT id, score, row_number() OVER (ORDER BY round(rank, 12) DESC, score DESC, id) AS place FROM found JOIN ranks USING (id) QUALIFY place <= 30")
def _(s, d):
    return g.find_ranked(*graph(s, d), _WORDS, _name_tokens(), 30, "personalized")


@query("Q5_blend", f"WITH {GRAPH}, {_FOUND}, {_SEED}, {ranks_sql('seed')} SELECT id, score, row_number() OVER (ORDER BY score DESC, round(rank, 12) DESC, id) AS place FROM found JOIN ranks USING (id) QUALIFY place <= 30")
def _(s, d):
    """Scores first; a tie crosses the limit of thirty, so that ranks break it."""
    return g.find_ranked(*graph(s, d), _WORDS, _name_tokens(), 30, "blend")


_BY_RANK = "ORDER BY round(rank, 12) DESC, id"


@query("Q6_ranked_nodes", f"WITH {GRAPH}, {ranks_sql()} SELECT id, {_SHOWN.format('rank')} AS rank FROM ranks {_BY_RANK} LIMIT 20")
def _(s, d):
    return g.page_rank(*graph(s, d)).orderBy(F.desc(F.round("rank", 12)), "id").limit(20).select("id", _shown("rank").alias("rank"))


@query("Q7_personalized", f"WITH {GRAPH}, seed AS (SELECT 'supplier:1' AS id, 3.0::DOUBLE AS weight UNION ALL SELECT 'order:1', 1.0), {ranks_sql('seed')} SELECT id, {_SHOWN.format('rank')} AS rank FROM ranks {_BY_RANK} LIMIT 20")
def _(s, d):
    seed = s.createDataFrame([("supplier:1", 3.0), ("order:1", 1.0), ("none", 5.0), ("supplier:2", -1.0)], "id string, weight double")
    return g.page_rank(*graph(s, d), seed).orderBy(F.desc(F.round("rank", 12)), "id").limit(20).select("id", _shown("rank").alias("rank"))


@query("Q2_symbol", f"""WITH {GRAPH}, {ranks_sql()}, best AS (SELECT id FROM nodes JOIN ranks USING (id) WHERE contains(lower(name), 'ring') ORDER BY file = 'Brand#7' DESC, round(rank, 12) DESC, id LIMIT 5),
  around AS (SELECT id FROM best UNION SELECT dst FROM edges JOIN best ON src = id UNION SELECT src FROM edges JOIN best ON dst = id) SELECT id, name, kind FROM nodes WHERE id IN (SELECT id FROM around)""")
def _(s, d):
    """Five parts of a name, those of a brand seen recently first, with their neighbours."""
    return g.symbol(*graph(s, d), "ring", s.createDataFrame([("Brand#7",)], "file string"), 5)[0].select("id", "name", "kind")


@query("Q3_recent_files", "SELECT file, max(event_id) AS seq FROM (SELECT 'user/' || user_id AS file, event_id FROM events WHERE event_type = 'view' ORDER BY event_id DESC LIMIT 80) GROUP BY 1 ORDER BY seq DESC LIMIT 20")
def _(s, d):
    views = op_records(s, d).where("tool = 'view'").select("seq", F.concat(F.lit("user/"), F.col("session_id").cast("string")).alias("file"))
    return g.recent_files(views)


@query("Q8_incident", f"WITH {GRAPH} SELECT src, dst, kind FROM edges WHERE src = 'nation:3' OR dst = 'nation:3'")
def _(s, d):
    return graph(s, d)[1].where("src = 'nation:3' OR dst = 'nation:3'")


@query("Q9_adjacency", f"WITH {GRAPH}, c AS (SELECT src, dst FROM edges WHERE kind = 'contains') SELECT src, count(*) AS degree FROM (SELECT src, dst FROM c UNION SELECT dst, src FROM c) GROUP BY 1")
def _(s, d):
    return g.both_ways(graph(s, d)[1].where("kind = 'contains'")).groupBy("src").agg(F.count("*").alias("degree"))


@query("Q10_neighbourhood", f"WITH {GRAPH}, b AS (SELECT src, dst FROM edges UNION SELECT dst, src FROM edges), one AS (SELECT dst AS id FROM b WHERE src = 'region:1'), two AS (SELECT b.dst AS id FROM one JOIN b ON b.src = one.id) SELECT id, min(distance) AS distance FROM (SELECT 'region:1' AS id, 0 AS distance UNION ALL SELECT id, 1 FROM one UNION ALL SELECT id, 2 FROM two) GROUP BY 1")
def _(s, d):
    return g.within(graph(s, d)[1], s.createDataFrame([("region:1",)], "id string"), 2).select("id", "distance")


_COMMON = "(SELECT min('part:' || a.l_partkey) AS part FROM lineitem a JOIN lineitem b ON a.l_partkey = b.l_partkey WHERE a.l_suppkey = 1 AND b.l_suppkey = 2)"


@query("Q11_shortest_path", f"SELECT ['supplier:1', part, 'supplier:2'] AS path FROM {_COMMON}")
def _(s, d):
    """Containment is no way: two suppliers are joined by the least part of both."""
    return g.shortest_path(graph(s, d)[1].where("kind <> 'contains'"), "supplier:1", "supplier:2")


@query("Q13_path_nodes", f"WITH {GRAPH}, p AS (SELECT 0 AS place, 'supplier:1' AS id UNION ALL SELECT 1, part FROM {_COMMON} UNION ALL SELECT 2, 'supplier:2') SELECT place, id, name, kind FROM p JOIN nodes USING (id)")
def _(s, d):
    nodes, edges = graph(s, d)
    return g.path_nodes(g.shortest_path(edges.where("kind <> 'contains'"), "supplier:1", "supplier:2"), nodes)


@query("Q12_resolved", f"WITH {GRAPH}, t AS (SELECT unnest(['region:1', 'ASIA', 'nation:3', 'widget']) AS token), m AS (SELECT token, id, CASE WHEN id = token THEN 0 WHEN name = token THEN 1 ELSE 2 END AS tier FROM t JOIN nodes ON id = token OR name = token OR contains(lower(name), lower(token))) SELECT token, arg_min(id, (tier, id)) AS id FROM m GROUP BY 1")
def _(s, d):
    """A token is an id, else a name, else part of a name; of several the least id. The tokens are few, the nodes are read once."""
    tokens = F.explode(F.array(*[F.lit(x) for x in ("region:1", "ASIA", "nation:3", "widget")]))
    each = graph(s, d)[0].select("id", "name", tokens.alias("token"))
    tier = F.when(F.col("id") == F.col("token"), 0).when(F.col("name") == F.col("token"), 1).when(F.contains(F.lower("name"), F.lower("token")), 2)
    return each.withColumn("tier", tier).where("tier is not null").groupBy("token").agg(F.min_by("id", F.struct("tier", "id")).alias("id"))


@query("Q14_induced", f"WITH {GRAPH}, chosen AS (SELECT id FROM nodes WHERE kind IN ('region', 'nation', 'supplier')) SELECT src, dst, kind FROM edges WHERE src IN (SELECT id FROM chosen) AND dst IN (SELECT id FROM chosen)")
def _(s, d):
    nodes, edges = graph(s, d)
    return g.induced(nodes.where(F.col("kind").isin("region", "nation", "supplier")), edges)


@query("Q15_overview")
def _(s, d):
    """Of what is contained, the entries worth most in a budget of tokens."""
    nodes, edges = graph(s, d)
    shown = nodes.where(~F.col("kind").isin("region", "nation"))
    entries = shown.join(g.page_rank(nodes, edges), "id").select("id", "rank", F.greatest(F.ceil(F.length("name") / 4), F.lit(1)).alias("tokens"))
    return s.createDataFrame([(x,) for x in g.overview(entries, 200)], "id string")


def _few_sql(end: str, other: str) -> str:
    return f"""SELECT {end} AS id, string_agg({other}, ', ' ORDER BY {other}) || CASE WHEN any_value(total) > 3 THEN ' (+' || (any_value(total) - 3) || ' more)' ELSE '' END AS names
  FROM (SELECT {end}, {other}, row_number() OVER (PARTITION BY {end} ORDER BY {other}) AS n, count(*) OVER (PARTITION BY {end}) AS total FROM edges WHERE kind IN ('calls', 'imports')) WHERE n <= 3 GROUP BY 1"""


def _few(edges, end, other):
    """Three names at most and how many more; a hot node's are ranked, never gathered."""
    w = Window.partitionBy(end)
    ranked = edges.withColumns({"n": F.row_number().over(w.orderBy(other)), "total": F.count("*").over(w)})
    few = ranked.where("n <= 3").groupBy(F.col(end).alias("id")).agg(F.array_sort(F.collect_list(other)).alias("names"), F.max("total").alias("total"))
    more = F.when(F.col("total") > 3, F.concat(F.lit(" (+"), (F.col("total") - 3).cast("string"), F.lit(" more)"))).otherwise("")
    return few.select("id", F.concat(F.array_join("names", ", "), more).alias("names"))


@query("Q16_entries", f"WITH {GRAPH}, callers AS ({_few_sql('dst', 'src')}), callees AS ({_few_sql('src', 'dst')}) SELECT id, callers.names AS callers, callees.names AS callees FROM callers FULL JOIN callees USING (id)")
def _(s, d):
    refs = graph(s, d)[1].where("kind in ('calls', 'imports')")
    callers, callees = _few(refs, "dst", "src").withColumnRenamed("names", "callers"), _few(refs, "src", "dst").withColumnRenamed("names", "callees")
    return callers.join(callees, "id", "full").select("id", "callers", "callees")


@query("Q17_callers", f"WITH {GRAPH} SELECT dst AS id, list(DISTINCT name ORDER BY name) AS callers FROM edges JOIN nodes ON nodes.id = src WHERE edges.kind = 'calls' AND dst IN ('customer:7', 'customer:8') GROUP BY 1")
def _(s, d):
    nodes, edges = graph(s, d)
    calls = edges.where("kind = 'calls' and dst in ('customer:7', 'customer:8')").join(nodes.select(F.col("id").alias("src"), "name"), "src")
    return calls.groupBy(F.col("dst").alias("id")).agg(F.sort_array(F.collect_set("name")).alias("callers"))


@query("Q18_size_gate", f"""WITH {GRAPH}, j AS (SELECT src, CAST(to_json(list({{'dst': dst, 'kind': kind}} ORDER BY dst)) AS VARCHAR) AS json FROM edges WHERE kind = 'contains' GROUP BY 1)
  SELECT src, strlen(json) AS bytes, CASE WHEN strlen(json) > 1024 THEN sha256(json) END AS ref, CASE WHEN strlen(json) <= 1024 THEN json END AS inline FROM j""")
def _(s, d):
    """What each container holds, as JSON; more than a kilobyte of it is stored and named by its hash."""
    held = graph(s, d)[1].where("kind = 'contains'").groupBy("src").agg(F.to_json(F.array_sort(F.collect_list(F.struct("dst", "kind")))).alias("json"))
    return g.size_gated(held, "json", 1024)


@query("G5_enclosing", """WITH s AS (SELECT o_custkey AS file, o_orderkey AS id, CAST(date_diff('day', DATE '1990-01-01', CAST(o_orderdate AS DATE)) AS INT) AS start FROM orders),
  e AS (SELECT user_id AS file, event_id, CAST((event_id * 37) % 4000 AS INT) AS pos FROM events)
  SELECT event_id, arg_max(id, (start, -start - id % 200, id)) AS scope FROM e LEFT JOIN s ON s.file = e.file AND e.pos BETWEEN start AND start + id % 200 GROUP BY 1""")
def _(s, d):
    """The order, open for some days from its date, that each event's day falls in; of several the one that starts last."""
    start = F.datediff(F.col("o_orderdate").cast("date"), F.lit("1990-01-01").cast("date"))
    scopes = table(s, d, "orders").select(F.col("o_custkey").alias("file"), F.col("o_orderkey").alias("id"), start.alias("start"), (start + F.col("o_orderkey") % 200).cast("int").alias("stop"))
    positions = table(s, d, "events").select(F.col("user_id").alias("file"), ((F.col("event_id") * 37) % 4000).cast("int").alias("pos"), "event_id")
    return g.enclosing(positions, scopes).select("event_id", "scope")


@query("G6_node_ids", f"WITH {GRAPH} SELECT id, substring(sha256(concat_ws(':', kind, name)), 1, 16) AS node FROM nodes")
def _(s, d):
    return graph(s, d)[0].select("id", g.node_id(F.col("kind"), F.col("name")).alias("node"))


@query("G7_name_index", f"WITH {GRAPH} SELECT name, list(id ORDER BY id) AS ids FROM nodes GROUP BY 1")
def _(s, d):
    return graph(s, d)[0].groupBy("name").agg(F.array_sort(F.collect_list("id")).alias("ids"))


_IMPORTS = "SELECT DISTINCT 'supplier:' || s_suppkey AS module, CASE WHEN s_suppkey % 3 = 0 THEN 'lib' || s_suppkey % 7 WHEN s_suppkey % 3 = 1 THEN 'small ring' ELSE s_name END AS segment FROM supplier"


@query("G8_imports", f"WITH {GRAPH}, i AS ({_IMPORTS}), f AS (SELECT module, segment, min(id) FILTER (id <> module) AS id FROM i LEFT JOIN nodes ON name = segment GROUP BY 1, 2) SELECT module AS src, coalesce(id, 'import:' || segment) AS dst, id IS NULL AS made FROM f")
def _(s, d):
    """Imports of names that parts have, of the importing module's own name, and of names that nothing has."""
    k = F.col("s_suppkey")
    segment = F.when(k % 3 == 0, F.concat(F.lit("lib"), (k % 7).cast("string"))).when(k % 3 == 1, "small ring").otherwise(F.col("s_name"))
    imports = table(s, d, "supplier").select(F.concat(F.lit("supplier:"), k.cast("string")).alias("module"), segment.alias("segment"))
    edges, made = g.resolve_imports(imports, graph(s, d)[0].withColumn("place", F.col("id")))
    return edges.join(made.select(F.col("id").alias("dst"), F.lit(True).alias("made")), "dst", "left").select("src", "dst", F.coalesce("made", F.lit(False)).alias("made"))


@query("G10_unique", f"WITH {GRAPH} SELECT src, dst, kind, row_number() OVER (ORDER BY src, dst, kind) AS place FROM edges WHERE kind = 'contains'")
def _(s, d):
    """Edges given twice are one; a total order of them."""
    edges = graph(s, d)[1].where("kind = 'contains'")
    return g.numbered(g.unique_edges(edges.unionByName(edges)), ["src", "dst", "kind"], "place")


@query("G11_summary", f"WITH {GRAPH}, e AS (SELECT count(*) AS n, list(DISTINCT kind ORDER BY kind) AS kinds FROM edges) SELECT count(*) AS n_nodes, any_value(e.n) AS n_edges, count(DISTINCT file) AS files, list(DISTINCT nodes.kind ORDER BY nodes.kind) AS node_kinds, any_value(e.kinds) AS edge_kinds FROM nodes, e")
def _(s, d):
    nodes, edges = graph(s, d)
    of_edges = edges.agg(F.count("*").alias("n_edges"), F.sort_array(F.collect_set("kind")).alias("edge_kinds"))
    own = nodes.agg(F.count("*").alias("n_nodes"), F.count_distinct("file").alias("files"), F.sort_array(F.collect_set("kind")).alias("node_kinds"))
    return own.join(F.broadcast(of_edges))


@query("G12_agreement", """WITH l AS (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem WHERE l_returnflag = 'R'), r AS (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem WHERE l_linestatus = 'F'), b AS (SELECT count(*) AS n FROM (SELECT * FROM l INTERSECT SELECT * FROM r))
  SELECT n AS shared, (SELECT count(*) FROM l) - n AS only_left, (SELECT count(*) FROM r) - n AS only_right, round(n / (SELECT count(*) FROM l)::DOUBLE, 6) AS recall, round(n / (SELECT count(*) FROM r)::DOUBLE, 6) AS precision FROM b""")
def _(s, d):
    """Two ways to find which parts suppliers deal in, held against each other."""
    items = table(s, d, "lineitem")
    side = lambda where: items.where(where).select("l_suppkey", "l_partkey")
    return g.agreement(side("l_returnflag = 'R'"), side("l_linestatus = 'F'"))
