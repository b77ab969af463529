"""Property-graph construction and queries over ``nodes(id, name, kind, file)`` and ``edges(src, dst, kind)``."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from quillspan.sources.stored import stored

DAMPING, ROUNDS = 0.85, 20
#: Kinds of edges that ranks move along; files beyond which a target counts as common, and what it then weighs.
REFERENCES, MANY_FILES, LIGHT = ("calls", "imports"), 5, 0.1
#: Rows that a broadcast may hold.
BROADCAST_ROWS = 500_000


def node_id(*parts: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws(":", *parts), 256), 1, 16)


def unique_edges(edges: DataFrame) -> DataFrame:
    return edges.dropDuplicates(["src", "dst", "kind"])


def resolve_calls(calls: DataFrame, defs: DataFrame, imports: DataFrame) -> DataFrame:
    """(caller, callee) of ``calls(caller, file, callee_name)``: definitions of that name in the same file, else in files it is imported from, else anywhere; all of the nearest kind, never the caller itself.

    Each kind is looked for among the calls that none nearer was found for, so a name that many files define is not joined with all calls of it.
    """
    call, key = calls.distinct(), ["caller", "callee_name"]
    defined = defs.select(F.col("name").alias("callee_name"), F.col("id").alias("callee"), F.col("file").alias("def_file"))
    seen = imports.select("file", F.col("from_file").alias("def_file"), F.col("name").alias("callee_name")).distinct()
    nearest = (
        lambda left: left.withColumn("def_file", F.col("file")).join(defined, ["def_file", "callee_name"]),
        lambda left: left.join(seen, ["file", "callee_name"]).join(defined, ["def_file", "callee_name"]),
        lambda left: left.join(defined, "callee_name"),
    )
    found = None
    for k, of in enumerate(nearest):
        one = of(call).where("caller <> callee").select(*key, "callee")
        if k + 1 < len(nearest):
            one = stored(one)
            call = call.join(one.select(*key).distinct(), key, "left_anti")
        found = one if found is None else found.unionByName(one)
    return found.select("caller", "callee").distinct()


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst").union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()


def reference_links(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(src, dst, w) of calls and imports: the share of src's rank that goes to dst. A target that more than five files refer to weighs a tenth, and so does one whose name begins with _."""
    refs = edges.where(F.col("kind").isin(*REFERENCES)).select("src", "dst")
    used = refs.join(nodes.select(F.col("id").alias("src"), "file"), "src").groupBy("dst").agg(F.count_distinct("file").alias("files"))
    target = nodes.select(F.col("id").alias("dst"), "name").join(used, "dst")
    weight = F.when(F.col("files") > MANY_FILES, LIGHT).otherwise(1.0) * F.when(F.startswith("name", F.lit("_")), LIGHT).otherwise(1.0)
    weighted = refs.join(target.select("dst", weight.alias("w")), "dst").groupBy("src", "dst").agg(F.sum("w").alias("w"))
    return weighted.withColumn("w", F.col("w") / F.sum("w").over(Window.partitionBy("src")))


def page_rank(nodes: DataFrame, edges: DataFrame, seed: DataFrame | None = None, rounds: int = ROUNDS, damping: float = DAMPING) -> DataFrame:
    """(id, rank) over calls and imports after a fixed number of rounds; the teleport is uniform, or by the positive weights of ``seed(id, weight)`` if there are any.

    What nodes without outgoing links hold goes back by the teleport: it is what of the whole, 1, has not moved. As the shares of a
    source's links add up to 1, what moves in a round is what the sources hold; so all rounds but the last need only the links between
    sources, and the last one all. A round is a join of those with the ranks that moved in the round before, and a sum by target,
    which is stored: so no plan grows with the rounds, and a lost executor costs the round it was in. Where no link leads
    to a source there is nothing to join, and the rounds are sums of two numbers.
    """
    n = max(nodes.count(), 1)
    total = 0.0
    if seed is not None:
        wanted = stored(seed.where("weight > 0").join(nodes.select("id"), "id", "left_semi").groupBy("id").agg(F.sum("weight").alias("weight")))
        total = wanted.agg(F.sum("weight")).first()[0] or 0.0
    share = F.coalesce(F.col("weight") / total, F.lit(0.0)) if total else F.lit(1.0 / n)
    given = lambda ids: (ids.join(wanted, "id", "left") if total else ids).withColumn("share", share)
    links = stored(reference_links(nodes, edges))
    sources = stored(given(links.select(F.col("src").alias("id")).distinct()))
    held = sources.agg(F.sum("share")).first()[0] or 0.0
    inner = stored(links.join(sources.select(F.col("id").alias("dst")), "dst", "left_semi")) if rounds > 1 else links.limit(0)
    some = not inner.isEmpty()
    moved, sum_moved, lost = None, 0.0, 0.0
    for i in range(rounds):
        teleport = 1.0 if i == 0 else 1 - damping + damping * lost
        last = i + 1 == rounds
        if last or some:
            rank = F.col("share") * teleport
            now = sources
            if moved is not None:
                now = sources.join(moved, "id", "left")
                rank = rank + damping * F.coalesce("moved", F.lit(0.0))
            # nothing moves from a source without rank: of a seed's ranks these are most
            sent = (links if last else inner).join(now.select(F.col("id").alias("src"), rank.alias("rank")).where("rank > 0"), "src")
            lost = 1.0 - (held * teleport + damping * sum_moved)
            kept = Observation()  # the sum is taken while the round is written
            moved = stored(sent.groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("rank") * F.col("w")).alias("moved")).observe(kept, F.sum("moved").alias("sum")))
            sum_moved = kept.get["sum"] or 0.0
        else:
            lost = 1.0 - held * teleport
    whole = given(nodes.select("id"))
    if moved is None:
        return whole.select("id", F.col("share").alias("rank"))
    return whole.join(moved, "id", "left").select("id", (F.col("share") * (1 - damping + damping * lost) + damping * F.coalesce("moved", F.lit(0.0))).alias("rank"))


def _met(frontier: DataFrame, edges: DataFrame) -> DataFrame:
    """``frontier(id, ...)`` with the other end (next) of each edge that it meets, either way; a small frontier goes to the edges."""
    near = F.broadcast(frontier) if frontier.count() <= BROADCAST_ROWS else frontier
    ways = [edges.select(F.col(a).alias("id"), F.col(b).alias("next")) for a, b in (("src", "dst"), ("dst", "src"))]
    return ways[0].join(near, "id").unionByName(ways[1].join(near, "id"))


def within(edges: DataFrame, start: DataFrame, hops: int) -> DataFrame:
    """(start, id, distance) of all nodes at most ``hops`` away, edges taken both ways; a frontier meets only nodes not seen before."""
    links = stored(edges.select("src", "dst")) if hops > 1 else edges
    seen = frontier = start.select(F.col("id").alias("start"), "id", F.lit(0).alias("distance"))
    for d in range(1, hops + 1):
        ahead = _met(frontier, links).select("start", F.col("next").alias("id")).distinct()
        frontier = stored(ahead.join(seen, ["start", "id"], "left_anti").withColumn("distance", F.lit(d)))
        seen = stored(seen.unionByName(frontier))
    return seen


def shortest_path(edges: DataFrame, source: str, target: str, most: int = 64) -> DataFrame:
    """One row (path) with a shortest path, edges taken both ways; no row if there is none.

    A breadth-first queue that meets neighbours in order holds each level in the order of its paths, so of equal paths the least is kept.
    """
    links = stored(edges.select("src", "dst"))
    level = edges.sparkSession.createDataFrame([(source, [source])], "id string, path array<string>")
    seen = level.select("id")
    for _ in range(most):
        if source == target or level.isEmpty() or not level.where(F.col("id") == target).isEmpty():
            break
        ahead = _met(level, links).select(F.col("next").alias("id"), F.concat("path", F.array("next")).alias("path"))
        level = stored(ahead.join(seen, "id", "left_anti").groupBy("id").agg(F.min("path").alias("path")))
        seen = stored(seen.union(level.select("id")))
    return level.where(F.col("id") == target).select("path")


def induced(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The edges whose ends are both among the nodes."""
    return edges.join(nodes.select(F.col("id").alias("src")), "src", "left_semi").join(nodes.select(F.col("id").alias("dst")), "dst", "left_semi").select("src", "dst", "kind")


def find(nodes: DataFrame, words: list[str], name_tokens: Column) -> DataFrame:
    """Nodes by words: 3 for a whole sub-token, 2 for a prefix of the name, 1 for a part of it; 2 more for each further word hit."""
    low = F.lower("name")
    each = [F.when(F.array_contains(name_tokens, w), 3).when(low.startswith(w), 2).when(low.contains(w), 1).otherwise(0) for w in words]
    hits = sum((F.when(s > 0, 1).otherwise(0) for s in each), F.lit(0))
    score = sum(each, F.lit(0)) + 2 * F.greatest(hits - 1, F.lit(0))
    return nodes.withColumn("score", score.cast("int")).where("score > 0")


def find_ranked(nodes: DataFrame, edges: DataFrame, words: list[str], name_tokens: Column, limit: int, mode: str = "blend") -> DataFrame:
    """The best ``limit`` of ``find`` (id, score, place). ``raw``: by score, id. ``personalized``: by rank seeded with the scores, then score, id.

    ``blend``: by score, then that rank, then id; ranks are worked out only if a tie of scores crosses the limit, as else they change nothing.
    """
    found = stored(find(nodes, words, name_tokens).select("id", "score"))
    order = [F.desc("score"), F.col("id")]
    if mode != "raw":
        edge = [r["score"] for r in found.orderBy(*order).select("score").limit(limit + 1).collect()]
        if mode == "personalized" or (0 < limit < len(edge) and edge[limit - 1] == edge[limit]):
            seed = found.select("id", F.col("score").cast("double").alias("weight"))
            # ranks that differ by less than rounding are a tie
            found = found.join(page_rank(nodes, edges, seed), "id").withColumn("rank", F.round("rank", 12))
            order = [F.desc("rank"), *order] if mode == "personalized" else [F.desc("score"), F.desc("rank"), F.col("id")]
    best = found.orderBy(*order).limit(limit)
    return best.withColumn("place", F.row_number().over(Window.orderBy(*order))).select("id", "score", "place")


def recent_files(events: DataFrame, scan: int = 80, keep: int = 20) -> DataFrame:
    """(file, seq): the last ``keep`` different files among the newest ``scan`` rows of ``events(seq, file)``."""
    newest = events.where("file is not null").orderBy(F.desc("seq")).limit(scan)
    return newest.groupBy("file").agg(F.max("seq").alias("seq")).orderBy(F.desc("seq")).limit(keep)


def path_nodes(path: DataFrame, nodes: DataFrame) -> DataFrame:
    """(place, id, name, kind) of a path's nodes in order; no row if no path was found."""
    return path.select(F.posexplode("path").alias("place", "id")).join(nodes.select("id", "name", "kind"), "id", "left")


def size_gated(rows: DataFrame, json: str, limit: int = 8192) -> DataFrame:
    """The rows with bytes, and where the JSON has more bytes than the limit with the hash it is stored under (ref) in its place."""
    large = F.octet_length(json) > limit
    return rows.withColumns({"bytes": F.octet_length(json).cast("long"), "ref": F.when(large, F.sha2(json, 256)), "inline": F.when(~large, F.col(json))}).drop(json)


def resolve_imports(imports: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges, new nodes) of ``imports(module, segment)``: each goes to the first node (by ``place``) of that name that is not the module itself, else to a node made for it.

    A module is one node, so the first two of a name are all that its imports can go to; Spark prunes each task to two before the shuffle.
    """
    wanted = imports.distinct()
    of_name = nodes.select(F.col("name").alias("segment"), "id", "place").join(wanted.select("segment").distinct(), "segment", "left_semi")
    once = of_name.groupBy("segment", "id").agg(F.min("place").alias("place"))
    two = once.withColumn("n", F.row_number().over(Window.partitionBy("segment").orderBy("place", "id"))).where("n <= 2")
    pair = two.groupBy("segment").agg(F.min_by("id", "n").alias("first"), F.max_by("id", "n").alias("second"))
    first = wanted.join(pair, "segment", "left").withColumn("id", F.when(F.col("first") != F.col("module"), F.col("first")).when(F.col("second") != F.col("module"), F.col("second")))
    target = F.coalesce("id", F.concat(F.lit("import:"), F.col("segment")))
    made = first.where("id is null").select(target.alias("id"), F.col("segment").alias("name"), F.lit("import").alias("kind")).distinct()
    return first.select(F.col("module").alias("src"), target.alias("dst"), F.lit("imports").alias("kind")).distinct(), made


def enclosing(positions: DataFrame, scopes: DataFrame, width: int = 64) -> DataFrame:
    """``positions(file, pos, ...)`` with the scope (id) of ``scopes(file, id, start, stop)`` that holds each and starts last; null if none does.

    Scopes are laid out over blocks of ``width`` places, so that the join has keys and no pair of a file is looked at that is not near.
    """
    block = lambda c: F.floor(c / width)
    laid = scopes.withColumn("block", F.explode(F.sequence(block(F.col("start")), block(F.col("stop")))))
    at = positions.withColumn("block", block(F.col("pos")))
    held = at.join(laid, ["file", "block"]).where("pos between start and stop").groupBy("file", "pos").agg(F.max_by("id", F.struct("start", (-F.col("stop")).alias("stop"), "id")).alias("scope"))
    return positions.join(held, ["file", "pos"], "left")


def agreement(left: DataFrame, right: DataFrame) -> DataFrame:
    """One row: shared, only_left, only_right, recall and precision of the right set against the left one."""
    keys = left.columns
    both = left.distinct().withColumn("l", F.lit(1)).join(right.distinct().withColumn("r", F.lit(1)), keys, "full")
    shared = F.count_if(F.col("l").isNotNull() & F.col("r").isNotNull())
    ratio = lambda c: F.round(shared / F.nullif(F.count(c), F.lit(0)), 6)
    return both.agg(shared.alias("shared"), F.count_if(F.col("r").isNull()).alias("only_left"), F.count_if(F.col("l").isNull()).alias("only_right"), ratio("l").alias("recall"), ratio("r").alias("precision"))


def symbol(nodes: DataFrame, edges: DataFrame, name: str, recent: DataFrame, limit: int = 20) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) around the nodes whose name holds ``name``: those of recent files (file) first, then by rank, ``limit`` at most; with their neighbours."""
    ranked = nodes.where(F.contains(F.lower("name"), F.lit(name.lower()))).join(page_rank(nodes, edges), "id")
    touched = recent.select("file").distinct().withColumn("recent", F.lit(True))
    best = ranked.join(touched, "file", "left").orderBy(F.coalesce("recent", F.lit(False)).desc(), F.desc(F.round("rank", 12)), "id").limit(limit)
    around = stored(within(edges, stored(best.select("id")), 1).select("id").distinct())
    return nodes.join(around, "id", "left_semi"), induced(around, edges)


def overview(entries: DataFrame, budget: int, cells: int = 8_000_000) -> list[str]:
    """Ids of the entries (id, rank, tokens, each of one token at least) of the greatest rank in sum that fit the budget, by rank.

    All if they fit; by a 0/1 knapsack on the driver if its table has no more than ``cells``; else as many of the highest rank as fit.
    The driver gets no more rows than the budget has tokens, or than the table has rows.
    """
    entries = stored(entries.select("id", "rank", "tokens"))  # used twice
    n, total = entries.agg(F.count("*"), F.coalesce(F.sum("tokens"), F.lit(0))).first()
    ranked = entries.orderBy(F.desc("rank"), "id").select("id", "rank", "tokens")
    if budget <= 0 or not n:
        return []
    if total <= budget or n * budget > cells:
        rows = ranked.limit(budget).collect()
        sums = np.cumsum([r["tokens"] for r in rows])
        return [r["id"] for r, used in zip(rows, sums, strict=True) if used <= budget]
    rows = ranked.collect()
    best, took = np.zeros(budget + 1), np.zeros((len(rows), budget + 1), bool)
    for i, r in enumerate(rows):
        w = r["tokens"]
        if w <= budget:
            with_it = best[: budget + 1 - w] + r["rank"]
            took[i, w:] = with_it > best[w:]
            best[w:] = np.maximum(best[w:], with_it)
    left, chosen = budget, []
    for i in range(len(rows) - 1, -1, -1):
        if took[i, left]:
            chosen.append(rows[i]["id"])
            left -= rows[i]["tokens"]
    return chosen[::-1]


def numbered(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """The rows with their place, from 1, in a total order: ranges are sorted each by its task, and the counts of the ranges before are added."""
    parted = stored(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id()))
    counts = parted.groupBy("part").agg(F.count("*").alias("n"))  # a row a range
    before = counts.withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    own = F.row_number().over(Window.partitionBy("part").orderBy(*order))
    return parted.join(F.broadcast(before.drop("n")), "part").withColumn(name, (own + F.col("before")).cast("long")).drop("part", "before")
