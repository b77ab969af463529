"""Queries over files, logs, stored graphs and events, and their incremental upkeep."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillspan.operators import incremental, oplog
from quillspan.plans.queries import query
from quillspan.sources import files
from quillspan.sources.tables import GRAPH, OPS, graph, op_records, table

_OP = "seq long, tool string, raw long, k long"


def _by_nation(s, d):
    """The customers as text files, a folder a nation; the folder's path."""
    at = files.scratch(s, "walk")
    rows = table(s, d, "customer").select("c_nationkey", F.col("c_name").alias("value"))
    rows.repartition(8, "c_nationkey").write.partitionBy("c_nationkey").text(at)
    return at


def _nation():
    return F.regexp_extract("path", "c_nationkey=([0-9]+)", 1).cast("int").alias("c_nationkey")


@query("S1_walk", "SELECT c_nationkey, count(*) > 0 AS found FROM customer WHERE c_nationkey % 5 <> 3 GROUP BY 1")
def _(s, d):
    """A walk over a folder a nation, four folders of twenty-five ignored by a rule each."""
    rules = tuple(f"/c_nationkey={k}/" for k in range(3, 25, 5))
    return files.walk(s, _by_nation(s, d), ignore=rules).groupBy(_nation()).agg((F.count("*") > 0).alias("found"))


@query("S2_whole_texts", "SELECT c_nationkey, CAST(sum(strlen(c_name) + 1) AS BIGINT) AS bytes, count(*) AS lines FROM customer GROUP BY 1")
def _(s, d):
    lines = F.size(F.split("content", "\n")) - 1
    return files.whole_texts(s, _by_nation(s, d)).groupBy(_nation()).agg(F.sum(F.octet_length("content")).alias("bytes"), F.sum(lines).alias("lines"))


@query("S3_manifest", "SELECT c_nationkey, CAST(sum(strlen(c_name) + 1) AS BIGINT) AS bytes, true AS dated FROM customer GROUP BY 1")
def _(s, d):
    """Status of the files of one extension; contents are not read."""
    found = files.walk(s, _by_nation(s, d), extensions=("txt",))
    return found.groupBy(_nation()).agg(F.sum("length").alias("bytes"), F.bool_and(F.col("mtime").isNotNull()).alias("dated"))


@query("S4_one_session", f"WITH {OPS} SELECT seq, tool, raw, k FROM ops WHERE tool = 'error' AND k % 3 <> 1 ORDER BY k % 3 = 0, seq")
def _(s, d):
    """The rotated log's records of one tool, then the log's; the predicate is applied at the scan."""
    at, rows = files.scratch(s, "log"), op_records(s, d).select("seq", "tool", "raw", "k")
    files.append_log(rows.where("k % 3 = 1"), at, 1)
    files.append_log(rows.where("k % 3 = 2"), at, 1)
    files.append_log(rows.where("k % 3 = 0"), at, 1)
    return files.read_log(s, at, _OP, F.col("tool") == "error").orderBy("part", "seq").select("seq", "tool", "raw", "k")


@query("S5_saved_graph", f"WITH {GRAPH} SELECT src, dst, edges.kind AS kind, a.name AS src_name FROM edges JOIN nodes a ON a.id = src")
def _(s, d):
    at = files.scratch(s, "graph")
    files.save_graph(*graph(s, d), at)
    nodes, edges = files.load_graph(s, at)
    return edges.join(nodes.select(F.col("id").alias("src"), F.col("name").alias("src_name")), "src").select("src", "dst", "kind", "src_name")


@query("S6_session_events", "SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS place FROM conversations WHERE conv_id IN (SELECT conv_id FROM conversations WHERE role = 'system')")
def _(s, d):
    """The events of the sessions that a system message is in, in order."""
    events = table(s, d, "conversations")
    some = events.where("role = 'system'").select("conv_id")
    return events.join(some, "conv_id", "left_semi").select("conv_id", "turn", "role", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")).cast("long").alias("place"))


_GAIN = "project long, total_commands long, total_input long, total_output long, total_saved long, avg_savings_pct double"


@query("S8_gain", f"WITH {OPS} SELECT session_id AS project, count(*) AS total_commands, CAST(sum(raw) AS BIGINT) AS total_input, CAST(sum(returned) AS BIGINT) AS total_output, CAST(sum(raw - returned) AS BIGINT) AS total_saved, round(sum(raw - returned) * 100.0 / sum(raw), 4) AS avg_savings_pct FROM ops GROUP BY 1 HAVING sum(raw) > 0")
def _(s, d):
    """Summaries of each project as an outside tool's JSON, read by a fixed schema."""
    at = files.scratch(s, "gain")
    rows = op_records(s, d).groupBy(F.col("session_id").alias("project")).agg(F.count("*").alias("total_commands"), F.sum("raw").alias("total_input"), F.sum("returned").alias("total_output")).where("total_input > 0")
    saved = F.col("total_input") - F.col("total_output")
    rows.withColumns({"total_saved": saved, "avg_savings_pct": F.round(saved * 100.0 / F.col("total_input"), 4), "other": F.lit("x")}).write.json(at)
    return s.read.schema(_GAIN).json(at)


@query("S10_rotation", f"WITH {OPS} SELECT seq, tool, raw, CAST(k % 3 AS INT) AS part FROM ops WHERE k % 3 <> 2 UNION ALL SELECT seq, tool, raw, 9 FROM ops WHERE k % 3 = 2")
def _(s, d):
    """Three appends: the second begins a new log, the third adds to it; a mirror keeps what was appended last as well."""
    at, mirror, rows = files.scratch(s, "log"), files.scratch(s, "mirror"), op_records(s, d).select("seq", "tool", "raw", "k")
    files.append_log(rows.where("k % 3 = 0"), at)
    files.append_log(rows.where("k % 3 = 1"), at, 1)
    files.append_log(rows.where("k % 3 = 2"), at, 1 << 50, (mirror,))
    own = files.read_log(s, at, _OP).where("k % 3 <> 2")
    return own.select("seq", "tool", "raw", "part").unionByName(s.read.schema(_OP).json(mirror).select("seq", "tool", "raw", F.lit(9).alias("part")))


@query("S11_inserted_events", "SELECT conv_id AS project, role AS category, text, count(*) AS n FROM conversations WHERE role IN ('system', 'user') GROUP BY 1, 2, 3")
def _(s, d):
    """Events inserted in two batches, and the memory of the durable ones among them; n is the number of events behind an entry."""
    events = table(s, d, "conversations").select(F.col("conv_id").alias("project"), F.col("role").alias("category"), "text", "turn")
    at = files.scratch(s, "events")
    events.where("turn % 2 = 0").write.mode("append").parquet(at)
    events.where("turn % 2 = 1").write.mode("append").parquet(at)
    held = s.read.schema(events.schema).parquet(at)
    memory = incremental.durable(held, ("system", "user"))
    return memory.join(held.groupBy("project", "category", "text").agg(F.count("*").alias("n")), ["project", "category", "text"])


@query("S12_indexed_records", "SELECT 'doc/' || doc_id AS chunk_id, CASE WHEN doc_id % 3 = 0 AND doc_id % 9 <> 0 THEN 'session' ELSE 'file' END AS path FROM documents WHERE doc_id % 2 = 0 OR (doc_id % 3 = 0 AND doc_id % 9 <> 0)")
def _(s, d):
    docs = table(s, d, "documents").select(F.concat(F.lit("doc/"), F.col("doc_id").cast("string")).alias("chunk_id"), F.col("text").alias("content"), "doc_id")
    chunks = docs.where("doc_id % 2 = 0").select(F.lit("file").alias("path"), "chunk_id", "content", F.lit("a b").alias("symbols"))
    records = docs.where("doc_id % 3 = 0").select(F.lit("session").alias("path"), "chunk_id", F.when(F.col("doc_id") % 9 != 0, F.concat(F.lit("x "), "content")).otherwise(" \n").alias("content"))
    return incremental.index_records(chunks, records).select("chunk_id", "path")


@query("S13_snapshot", f"WITH {OPS} SELECT tool AS scope, CAST(to_json({{'ops': count(*), 'raw_bytes': CAST(sum(raw) AS BIGINT), 'errors': count(*) FILTER (outcome = 'error')}}) AS VARCHAR) AS body FROM ops WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-25' GROUP BY 1")
def _(s, d):
    """The answer of the statistics endpoint for each scope, since one day and until another, as JSON."""
    totals = oplog.totals(oplog.between(op_records(s, d), "2024-01-05", "2024-01-25"), "tool")
    return totals.select(F.col("tool").alias("scope"), F.to_json(F.struct("ops", "raw_bytes", "errors")).alias("body"))


@query("C4_incremental", "SELECT path, hash, CAST(len(list_filter(string_split_regex(lower(text), '[^\\pL\\pN]+'), lambda x: x <> '')) AS INT) AS n, doc_id % 2 = 0 AND doc_id % 3 <> 0 AS reused FROM (SELECT 'd/' || doc_id AS path, sha256(text) AS hash, text, doc_id FROM documents WHERE doc_id % 7 <> 0)")
def _(s, d):
    """Extracts of all files: a half is in the cache, a third of it stale; files deleted since leave it."""
    from quillspan.functions.text import tokens

    docs = table(s, d, "documents").select(F.concat(F.lit("d/"), F.col("doc_id").cast("string")).alias("path"), F.col("text").alias("content"), "doc_id")
    extract = lambda rows: rows.select("path", "hash", F.size(tokens(F.col("content"))).alias("n"))
    old = docs.where("doc_id % 2 = 0").withColumn("hash", F.when(F.col("doc_id") % 3 == 0, F.lit("stale")).otherwise(F.sha2("content", 256)))
    return incremental.refreshed(extract(old), docs.where("doc_id % 7 <> 0").select("path", "content"), extract)


@query("C5_gates", "SELECT kind, kind IN ('same') AS fresh FROM (VALUES ('same'), ('changed'), ('deleted'), ('empty')) t(kind)")
def _(s, d):
    """Whether a stored manifest is that of the files: it is only where nothing is changed, deleted or missing altogether."""
    now = table(s, d, "documents").select(F.col("doc_id").alias("path"), F.col("n_chars").alias("mtime"))
    states = {"same": now, "changed": now.withColumn("mtime", F.col("mtime") + (F.col("path") == 7).cast("int")), "deleted": now.unionByName(now.limit(1).withColumn("path", F.lit(-1).cast("long"))), "empty": now.limit(0)}
    out = None
    for kind, stored in states.items():
        one = incremental.manifest_diff(stored, now).agg((F.count("*") == 0).alias("fresh")).select(F.lit(kind).alias("kind"), "fresh")
        out = one if out is None else out.unionByName(one)
    return out


@query("C6_guards", "SELECT n_regionkey, count(*) FILTER (n_nationkey > 12) > 0 AS whole, count(*) FILTER (n_nationkey > 12) > 0 AND count(*) FILTER (n_nationkey > 12) >= count(*) FILTER (n_nationkey <= 12) AS partial FROM nation GROUP BY 1")
def _(s, d):
    """Whether the graph of a region's later nations may replace that of its earlier ones, as a build of all files and of a part."""
    counts = table(s, d, "nation").groupBy("n_regionkey").agg(F.count_if(F.col("n_nationkey") <= 12).alias("before"), F.count_if(F.col("n_nationkey") > 12).alias("after"))
    may = lambda part: incremental.may_replace(F.col("before"), F.col("after"), F.lit(part))
    return counts.select("n_regionkey", may(False).alias("whole"), may(True).alias("partial"))


@query("C7_debounced", """WITH RECURSIVE e AS (SELECT user_id, epoch_us(ts) AS t FROM events), w(user_id, t) AS (SELECT user_id, min(t) FROM e GROUP BY 1
  UNION ALL SELECT w.user_id, min(e.t) FROM w JOIN e ON e.user_id = w.user_id AND e.t >= w.t + 172800000000 GROUP BY w.user_id, w.t) SELECT user_id, t AS walked FROM w""")
def _(s, d):
    """Requests that walk the files anew, two days being the time to live."""
    from quillspan.functions.text import micros

    return incremental.debounced(table(s, d, "events").withColumn("at", micros("ts")), "user_id", "at", 2 * 86_400_000_000).withColumnRenamed("at", "walked")
