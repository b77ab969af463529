"""The dataset's tables and the views of them that the library's queries take: op records, chunks, graph, prompts."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspan.functions.text import line_chunks, symbols
from quillspan.sources import files


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as op records: k is the number in their props."""
    events = table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("long"))
    raw = F.floor(F.col("value") * 100).cast("long")
    ops = events.select(F.col("event_id").alias("seq"), "ts", F.col("user_id").alias("session_id"), F.col("event_type").alias("tool"), raw.alias("raw"), "k")
    return ops.select(
        "*",
        F.floor(F.col("raw") * (F.col("k") % 10) / 10).cast("long").alias("returned"),
        F.when(F.col("k") % 3 == 0, F.sha2(F.col("seq").cast("string"), 256)).alias("store_ref"),
        F.when(F.col("tool") == "error", "error").when(F.col("k") == 99, "timed_out").otherwise("ok").alias("outcome"),
    )


OPS = """ops AS (SELECT *, CAST(floor(raw * (k % 10) / 10) AS BIGINT) AS returned, CASE WHEN k % 3 = 0 THEN sha256(CAST(seq AS VARCHAR)) END AS store_ref,
  CASE WHEN tool = 'error' THEN 'error' WHEN k = 99 THEN 'timed_out' ELSE 'ok' END AS outcome
  FROM (SELECT event_id AS seq, ts, user_id AS session_id, event_type AS tool, CAST(floor(value * 100) AS BIGINT) AS raw, CAST(regexp_extract(props, '[0-9]+') AS BIGINT) AS k FROM events))"""


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as chunks (path, chunk_id, content, symbols), a hundred lines each; blank ones are left out after numbering."""
    docs = table(spark, sf_dir, "documents")
    path = F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.when(F.col("doc_id") % 5 == 0, ".md").otherwise(".txt"))
    rows = docs.select(path.alias("path"), F.posexplode(line_chunks(F.col("text"))).alias("i", "content"))
    rows = rows.where(F.col("content").rlike(r"\S")).select("path", F.concat("path", F.lit("#"), F.col("i").cast("string")).alias("chunk_id"), "content")
    return rows.withColumn("symbols", symbols(F.col("content")))


def search_index(spark: SparkSession, sf_dir: str):
    """The index of the documents' chunks, kept in this application's folder while the table's files are the same, and made anew when they change."""
    from quillspan.operators.search import index_of
    from quillspan.sources.stored import shared_folder

    fs, where = files._at(spark, f"{sf_dir}/documents.parquet")
    parts = [where, *(x.getPath() for x in fs.listStatus(where))] if fs.getFileStatus(where).isDirectory() else [where]
    state = "|".join(f"{p}:{fs.getFileStatus(p).getModificationTime()}:{fs.getFileStatus(p).getLen()}" for p in parts)
    return index_of(chunks(spark, sf_dir), f"{shared_folder(spark)}/index-{hashlib.sha256(state.encode()).hexdigest()[:16]}")


CHUNKS = """chunks AS (SELECT path, path || '#' || i AS chunk_id, content FROM (
  SELECT path, i, array_to_string(list_slice(l, i * 100 + 1, i * 100 + 100), chr(10)) AS content FROM (
    SELECT path, l, unnest(range(0, (len(l) + 99) // 100)) AS i FROM (
      SELECT source || '/' || doc_id || CASE WHEN doc_id % 5 = 0 THEN '.md' ELSE '.txt' END AS path, string_split(text, chr(10)) AS l FROM documents))) WHERE regexp_matches(content, '[^ \\t\\n\\r\\f\\x0B]')),
words AS (SELECT chunk_id, list_filter(string_split_regex(lower(content), '[^\\pL\\pN]+'), lambda x: x <> '') AS w FROM chunks)"""


_NODES = (
    ("region", "region", "r_regionkey", "r_name", "'world'"),
    ("nation", "nation", "n_nationkey", "n_name", "concat('region:', n_regionkey)"),
    ("customer", "customer", "c_custkey", "c_name", "concat('nation:', c_nationkey)"),
    ("supplier", "supplier", "s_suppkey", "s_name", "concat('nation:', s_nationkey)"),
    ("part", "part", "p_partkey", "p_name", "p_brand"),
    ("order", "orders", "o_orderkey", "concat('order:', o_orderkey)", "o_orderpriority"),
)
_EDGES = (
    ("nation", "region", "n_regionkey", "nation", "n_nationkey", "contains"),
    ("customer", "nation", "c_nationkey", "customer", "c_custkey", "contains"),
    ("supplier", "nation", "s_nationkey", "supplier", "s_suppkey", "contains"),
    ("orders", "order", "o_orderkey", "customer", "o_custkey", "calls"),
    ("lineitem", "supplier", "l_suppkey", "part", "l_partkey", "imports"),
)


def graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of the star schema: regions contain nations, nations customers and suppliers; orders call their customers, suppliers import the parts of their line items."""
    nodes = edges = None
    for kind, name, key, label, file in _NODES:
        one = table(spark, sf_dir, name).selectExpr(f"concat('{kind}:', {key}) as id", f"{label} as name", f"'{kind}' as kind", f"{file} as file")
        nodes = one if nodes is None else nodes.unionByName(one)
    for name, a, ka, b, kb, kind in _EDGES:
        keys = table(spark, sf_dir, name).select(ka, kb)
        keys = keys.distinct() if name == "lineitem" else keys  # numbers are less to deal out than names
        one = keys.selectExpr(f"concat('{a}:', {ka}) as src", f"concat('{b}:', {kb}) as dst", f"'{kind}' as kind")
        edges = one if edges is None else edges.unionByName(one)
    return nodes, edges


GRAPH = (
    "nodes AS (" + " UNION ALL ".join(f"SELECT '{kind}:' || {key} AS id, {label} AS name, '{kind}' AS kind, {file} AS file FROM {name}" for kind, name, key, label, file in _NODES) + "),\nedges AS ("
    + " UNION ALL ".join(f"SELECT {'DISTINCT ' * (name == 'lineitem')}'{a}:' || {ka} AS src, '{b}:' || {kb} AS dst, '{kind}' AS kind FROM {name}" for name, a, ka, b, kb, kind in _EDGES) + ")"
)


def prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").where("role = 'user'").select(F.col("conv_id").alias("session_id"), F.col("turn").alias("seq"), F.col("text").alias("prompt"))


PROMPTS = "prompts AS (SELECT conv_id AS session_id, turn AS seq, text AS prompt FROM conversations WHERE role = 'user')"
