"""Queries over streams, scripts and stored outputs."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspan.operators import incremental, scripts, search
from quillspan.plans.queries import query
from quillspan.sources import files
from quillspan.sources.tables import OPS, op_records, table
from quillspan.streaming import counters

_DAY = 86_400_000_000


@query("W1_rebuilds", f"""WITH e AS (SELECT user_id, ts, CAST(regexp_extract(props, '[0-9]+') AS BIGINT) % 5 AS k FROM events), g AS (SELECT *, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts)) < {_DAY // 4} THEN 0 ELSE 1 END AS fresh FROM e),
  b AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS burst FROM g), x AS (SELECT user_id, burst, min(ts) AS start, count(*) AS n, arg_min(k, ts) AS first, arg_max(k, ts) AS last FROM b GROUP BY 1, 2)
  SELECT user_id, epoch_us(start) AS start, n FROM x WHERE n = 1 OR first <> last""")
def _(s, d):
    """A rebuild for each burst of changes with six quiet hours behind it, unless it ends as it began."""
    from quillspan.functions.text import micros

    changes = counters.event_stream(s, d).select("user_id", F.col("ts").cast("timestamp").alias("ts"), (F.get_json_object("props", "$.k").cast("long") % 5).alias("k"))
    found = counters.drained(counters.bursts(changes, "user_id", "ts", "k", "6 hours"))
    return found.where("n = 1 or first <> last").select("user_id", micros("start").alias("start"), "n")


@query("W3_sliding", "SELECT event_type AS tool, epoch_us(w) AS start, count(*) AS n FROM (SELECT event_type, unnest(list_transform(range(7), lambda i: date_trunc('day', ts)::TIMESTAMP - to_days(CAST(i AS INT)))) AS w FROM events) GROUP BY 1, 2")
def _(s, d):
    """Counts of the seven days from each day on."""
    from quillspan.functions.text import micros

    events = counters.event_stream(s, d).select(F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("tool"))
    return counters.drained(counters.sliding_totals(events, "ts", "tool", "7 days", "1 day")).select("tool", micros("start").alias("start"), "n")


@query("W5_high_water", "WITH s AS (SELECT user_id, event_id, event_id * 10 - (event_id % 3) * 400 AS total FROM events) SELECT user_id, event_id, delta FROM (SELECT *, total - coalesce(lag(total) OVER (PARTITION BY user_id ORDER BY event_id), 0) AS delta FROM s) WHERE delta > 0")
def _(s, d):
    """Counters that fall back at times, in three batches; each is compared with the one before, whichever batch that came in."""
    at = files.scratch(s, "marks-in")
    rows = table(s, d, "events").select("user_id", "event_id", (F.col("event_id") * 10 - F.col("event_id") % 3 * 400).alias("total"))
    edges = rows.agg(F.max("event_id")).first()[0] or 0
    part = F.least(F.floor(F.col("event_id") * 3 / (edges + 1)), F.lit(2))
    return counters.high_water_deltas(s, [rows.where(part == i) for i in range(3)], at, "user_id", "event_id", "total")


_TERMS = ("le", "la", "the", "de", "und", "der", "que", "en")


@query("W6_kept_index", f"""SELECT term, count(*) AS df, sum(n)::BIGINT AS tf FROM (SELECT term, len(list_filter(w, lambda x: x = term)) AS n FROM (SELECT list_filter(string_split_regex(lower(text), '[^\\pL\\pN]+'), lambda x: x <> '') AS w FROM conversations WHERE turn % 2 = 1 OR conv_id % 2 = 0), (SELECT unnest({list(_TERMS)!r}) AS term)) WHERE n > 0 GROUP BY 1""")
def _(s, d):
    """An index kept by a stream: the first batch has every message, the second empties the even ones of odd conversations."""
    at, home = files.scratch(s, "chunks-in"), files.scratch(s, "index")
    path = F.concat(F.lit("session://"), F.col("conv_id").cast("string"), F.lit("/"), F.col("turn").cast("string"))
    rows = table(s, d, "conversations").select(path.alias("path"), path.alias("chunk_id"), F.col("text").alias("content"), F.lit("").alias("symbols"), "conv_id", "turn")
    emptied = rows.where("turn % 2 = 0 and conv_id % 2 = 1").withColumn("content", F.lit(""))
    index = search.Index(s, home)

    def put(batch, number: int) -> None:
        # a batch that is given again replaces its own paths and changes nothing
        index.add(batch.where("content <> ''"), batch)

    counters.each_batch_of(s, [rows, emptied], at, put)
    return index.postings().where((F.col("field") == "content") & F.col("term").isin(*_TERMS)).groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("tf"))


@query("U1_script", "SELECT CAST(c_nationkey AS VARCHAR) AS id, CAST(0 AS INT) AS exit_code, count(*) || ' ' || max(c_name) || chr(10) AS stdout FROM customer GROUP BY c_nationkey")
def _(s, d):
    """A script that counts the lines on its input and prints the last of them in order, once a nation."""
    names = table(s, d, "customer").groupBy(F.col("c_nationkey").alias("id")).agg(F.array_join(F.collect_list("c_name"), "\n").alias("content"))
    return scripts.run_script(names, "import sys; x = sys.stdin.read().split('\\n'); print(len(x), max(x))").select("id", "exit_code", "stdout")


@query("U2_file_script", "SELECT CAST(s_nationkey AS VARCHAR) AS id, CAST(s_nationkey % 3 AS INT) AS exit_code, CAST(sum(strlen(s_name) + 1) AS BIGINT) AS input_bytes, count(*) || chr(10) AS stdout FROM supplier GROUP BY s_nationkey")
def _(s, d):
    """A script that gets a file's path, once a nation; its exit code says how the number of the nation divides by three."""
    text = F.concat(F.array_join(F.collect_list("s_name"), "\n"), F.lit("\n"))
    rows = table(s, d, "supplier").groupBy("s_nationkey").agg(text.alias("content")).select(F.col("s_nationkey").alias("id"), "content")
    source = "import sys; x = open(sys.argv[1]).read(); print(x.count(chr(10)))"
    parts = [scripts.run_script(rows.where(F.col("id") % 3 == k), f"{source}; sys.exit({k})", True) for k in range(3)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).select("id", "exit_code", "input_bytes", "stdout")


@query("U4_offloaded", "SELECT doc_id, strlen(text) > 8192 AS stored, CASE WHEN strlen(text) > 8192 THEN sha256(text) END AS ref, CASE WHEN strlen(text) > 8192 THEN sha256(text) = sha256(text) ELSE true END AS whole FROM documents")
def _(s, d):
    """Texts as outputs: long ones are shown in part and come back whole from what is stored."""
    shown, blobs = scripts.offloaded(table(s, d, "documents").select("doc_id", "text"), "text")
    short = shown.where("ref is null").select("doc_id", F.lit(False).alias("stored"), "ref", F.lit(True).alias("whole"))
    # what is stored is read back and hashed once; only its hash and size meet the outputs
    back = blobs.select("hash", (F.sha2("content", 256) == F.col("hash")).alias("same"), F.octet_length("content").alias("bytes"))
    long = shown.where("ref is not null").select("doc_id", "ref", F.octet_length("text").alias("kept")).join(back, F.col("ref") == F.col("hash"), "left")
    return short.unionByName(long.select("doc_id", F.lit(True).alias("stored"), "ref", (F.col("same") & (F.col("kept") < F.col("bytes"))).alias("whole")))


@query("O17_scopes", f"WITH {OPS}, p AS (SELECT seq, 'r' || session_id % 4 AS project FROM ops) SELECT 'own' AS scope, seq FROM p WHERE project = 'r0' UNION ALL SELECT 'named', seq FROM p WHERE project = 'r2' UNION ALL SELECT 'all', seq FROM p")
def _(s, d):
    ops = op_records(s, d).select("seq", F.concat(F.lit("r"), (F.col("session_id") % 4).cast("string")).alias("project"))
    out = None
    for name, scope in (("own", None), ("named", "r2"), ("all", "*")):
        one = incremental.scoped(ops, scope, "r0").select(F.lit(name).alias("scope"), "seq")
        out = one if out is None else out.unionByName(one)
    return out
