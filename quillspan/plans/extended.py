"""Further queries: text scalars, command rules, the JSON codec, graph answers, change data, streams."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillspan.functions import codec
from quillspan.functions import text as t
from quillspan.operators import incremental
from quillspan.plans.queries import query
from quillspan.sources.stored import shared_folder
from quillspan.sources.tables import CHUNKS, OPS, chunks, op_records, table
from quillspan.streaming import counters

# text
@query("T3_chunk_ids", f"WITH {CHUNKS} SELECT chunk_id, strlen(content) AS bytes FROM chunks")
def _(s, d):
    return chunks(s, d).select("chunk_id", F.octet_length("content").cast("long").alias("bytes"))


@query("T8_distinct_tokens", "SELECT conv_id, turn, CAST(len(list_distinct(list_filter(string_split_regex(lower(text), '[^\\pL\\pN]+'), lambda x: x <> ''))) AS INT) AS n FROM conversations")
def _(s, d):
    return table(s, d, "conversations").select("conv_id", "turn", F.size(F.array_distinct(t.tokens(F.col("text")))).alias("n"))


@query("T10_identifier_tokens", "SELECT event_id, array_to_string(list_filter(string_split_regex(lower(regexp_replace(event_type || 'Event' || user_id, '([a-z0-9])([A-Z])', '\\1_\\2', 'g')), '[^\\pL\\pN]+'), lambda x: x <> ''), ' ') AS parts FROM events")
def _(s, d):
    name = F.concat("event_type", F.lit("Event"), F.col("user_id").cast("string"))
    return table(s, d, "events").select("event_id", F.array_join(t.identifier_tokens(name), " ").alias("parts"))


@query("T12_doc_paths", f"WITH {CHUNKS} SELECT DISTINCT path FROM chunks WHERE ends_with(path, '.md')")
def _(s, d):
    return chunks(s, d).where(t.is_doc_path(F.col("path"))).select("path").distinct()


@query("T20_token_estimate", "SELECT doc_id, CAST(floor(strlen(text) / 4) AS BIGINT) AS est_tokens FROM documents")
def _(s, d):
    return table(s, d, "documents").select("doc_id", F.floor(F.octet_length("text") / 4).cast("long").alias("est_tokens"))


@query("T21_saved_tokens", f"WITH {OPS} SELECT seq, CAST(greatest(raw - returned, 0) // 4 AS BIGINT) AS saved FROM ops")
def _(s, d):
    return op_records(s, d).select("seq", t.saved_tokens(F.col("raw"), F.col("returned")).alias("saved"))


@query("T22_path_suffix", "SELECT DISTINCT source || '/' || doc_id || '.txt' AS path FROM documents WHERE doc_id = 17")
def _(s, d):
    paths = table(s, d, "documents").select(F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"))
    return paths.where(t.path_matches(F.col("path"), F.lit("17.txt"))).distinct()


@query("T24_query_parameters", "SELECT page_id, url, nullif(regexp_extract(url, '^[a-z]+://([^/?#]+)', 1), '') AS host FROM pages")
def _(s, d):
    return table(s, d, "pages").select("page_id", "url", F.nullif(F.regexp_extract("url", r"^[a-z]+://([^/?#]+)", 1), F.lit("")).alias("host"))


# rules
@query("H3_large_results", f"WITH {OPS} SELECT session_id, seq, returned FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY seq) AS n FROM ops WHERE tool = 'view' AND returned > 16384) WHERE n = 1")
def _(s, d):
    large = op_records(s, d).where("tool = 'view' AND returned > 16384")
    return large.withColumn("n", F.row_number().over(Window.partitionBy("session_id").orderBy("seq"))).where("n = 1").select("session_id", "seq", "returned")


@query("E9_attributed", "SELECT conv_id AS session_id, role AS source_hook, count(*) AS n FROM conversations GROUP BY 1, 2")
def _(s, d):
    return table(s, d, "conversations").select(F.col("conv_id").alias("session_id"), F.col("role").alias("source_hook")).groupBy("session_id", "source_hook").agg(F.count("*").alias("n"))


@query("E22_search_records", "SELECT 'session://' || conv_id || '/' || role AS path, turn AS chunk, text AS content FROM conversations WHERE text IS NOT NULL")
def _(s, d):
    path = F.concat(F.lit("session://"), F.col("conv_id").cast("string"), F.lit("/"), F.col("role"))
    return table(s, d, "conversations").where("text is not null").select(path.alias("path"), F.col("turn").alias("chunk"), F.col("text").alias("content"))


# codec
@query("D1_without_nulls")
def _(s, d):
    cells = table(s, d, "documents").select("doc_id", F.to_json(F.struct("doc_id", "lang", F.nullif("source", F.lit("web")).alias("source")), {"ignoreNullFields": "false"}).alias("json"))
    return cells.select("doc_id", codec.without_nulls("json").alias("json"))


@query("D2_compacted")
def _(s, d):
    orders = table(s, d, "orders").groupBy("o_custkey").agg(F.to_json(F.sort_array(F.collect_list(F.struct("o_orderkey", "o_orderstatus", "o_orderpriority")))).alias("json"))
    return orders.select("o_custkey", codec.compacted("json").alias("packed"))


@query("D5_round_trip", "SELECT o_custkey, true AS same FROM orders GROUP BY 1")
def _(s, d):
    orders = table(s, d, "orders").groupBy("o_custkey").agg(F.to_json(F.sort_array(F.collect_list(F.struct("o_orderkey", "o_orderpriority")))).alias("json"))
    return orders.select("o_custkey", (codec.expanded(codec.compacted("json")) == codec.without_nulls("json")).alias("same"))


# change data
@query("C2_replaced_chunks", "SELECT doc_id AS path, CASE WHEN doc_id % 4 = 0 THEN 'new' ELSE 'old' END AS state FROM documents WHERE doc_id % 4 <> 1")
def _(s, d):
    docs = table(s, d, "documents").select(F.col("doc_id").alias("path"), F.lit("old").alias("state"))
    touched = docs.where("path % 4 in (0, 1)")
    return incremental.replace_chunks(docs, touched, docs.where("path % 4 = 0").withColumn("state", F.lit("new")))


@query("C3_pruned", "SELECT path FROM (SELECT source || '/' || doc_id AS path, doc_id FROM documents) WHERE doc_id % 3 <> 0 UNION ALL SELECT DISTINCT 'session://' || conv_id FROM conversations")
def _(s, d):
    """Stored paths that still exist, and those of sessions."""
    docs = table(s, d, "documents").select(F.concat("source", F.lit("/"), F.col("doc_id").cast("string")).alias("path"), "doc_id")
    sessions = table(s, d, "conversations").select(F.concat(F.lit("session://"), F.col("conv_id").cast("string")).alias("path")).distinct()
    stored = docs.select("path").unionByName(sessions)
    gone = stored.where(~F.startswith("path", F.lit("session://"))).join(docs.where("doc_id % 3 <> 0"), "path", "left_anti")
    return stored.join(gone, "path", "left_anti")


@query("C5_fresh", "SELECT false AS fresh, count(*) AS stale FROM documents WHERE doc_id % 5 = 0")
def _(s, d):
    now = table(s, d, "documents").select(F.col("doc_id").alias("path"), F.col("n_chars").alias("mtime"))
    diff = incremental.manifest_diff(now.where("path % 5 <> 0"), now)
    return diff.agg((F.count("*") == 0).alias("fresh"), F.count("*").alias("stale"))


# sources, sinks and streams
@query("S4_op_log", f"WITH {OPS} SELECT seq, tool, raw, coalesce(store_ref, '') AS store_ref FROM ops")
def _(s, d):
    """Op records written as JSON lines and read back by a fixed schema; a line that is no JSON is left out."""
    at = f"{shared_folder(s)}/log-{uuid.uuid4().hex}"
    op_records(s, d).select("seq", "tool", "raw", "store_ref").write.json(at)
    log = s.read.schema("seq long, tool string, raw long, store_ref string").option("mode", "DROPMALFORMED").json(at)
    return log.withColumn("store_ref", F.coalesce("store_ref", F.lit("")))


@query("S7_tab_log", f"WITH {OPS} SELECT session_id, tool, count(*) AS n FROM ops GROUP BY 1, 2")
def _(s, d):
    at = f"{shared_folder(s)}/tab-{uuid.uuid4().hex}"
    op_records(s, d).select("session_id", "tool").write.option("sep", "\t").csv(at)
    return s.read.schema("session_id long, tool string").option("sep", "\t").csv(at).groupBy("session_id", "tool").agg(F.count("*").alias("n"))


@query("W2_live_totals", "SELECT event_type AS tool, count(*) AS ops, CAST(sum(CAST(floor(value * 100) AS BIGINT)) AS BIGINT) AS raw_bytes, max(event_id) AS last_event FROM events GROUP BY 1")
def _(s, d):
    return counters.drained(counters.live_totals(counters.event_stream(s, d)))


@query("W4_keyed_counters", "SELECT user_id AS session_id, event_type AS tool, count(*) AS n FROM events GROUP BY 1, 2")
def _(s, d):
    return counters.drained(counters.keyed_counters(counters.event_stream(s, d)))
