"""The library's queries, keyed by operator, each with the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspan.functions import text as t
from quillspan.operators import graph as g
from quillspan.operators import incremental, oplog, rules, search, sessions
from quillspan.sources.tables import CHUNKS, OPS, PROMPTS, chunks, op_records, prompts, search_index, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
#: Fixed values of the sample queries.
MECHANISMS = {"view": "index", "click": "discovery", "purchase": "store", "signup": "session"}
RATES = [("view", "search", 216.333333, 1.0), ("click", "navigation", 0.0, 2.272727), ("purchase", "recovery", 4401.5, 1.0), ("signup", "darkroom", 0.0, 1.0)]
DIMENSIONS = ["darkroom", "skeleton", "search", "navigation", "recovery"]
SEARCHES = [("q1", "the of and"), ("q2", "un que la"), ("q3", "licensed under the license")]
COMMANDS = ["rm -rf x", "rm --dry-run x", "git status", "git log -5", "git log", "ls -la", "ls -R", "cat a | wc -l", "mv a b", "mv -v a b", "node -V", "python --version", "echo hi", "idle", "", "/bin/kill 9", "pwd && ls", "cp --verbose a b"]


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


_MEASURES = """count(*) AS ops, CAST(sum(raw) AS BIGINT) AS raw_bytes, CAST(sum(returned) AS BIGINT) AS returned_bytes, CAST(sum(greatest(raw - returned, 0) // 4) AS BIGINT) AS saved_tokens,
  count(*) FILTER (outcome = 'error') AS errors, count(*) FILTER (outcome = 'timed_out') AS timed_out, count(*) FILTER (store_ref IS NOT NULL AND raw > returned) AS offloaded_ops,
  CAST(coalesce(sum(raw - returned) FILTER (store_ref IS NOT NULL AND raw > returned), 0) AS BIGINT) AS offloaded_bytes"""


@query("O1_totals", f"WITH {OPS} SELECT {_MEASURES} FROM ops")
def _(s, d):
    return oplog.totals(op_records(s, d))


@query("O2_by_tool", f"WITH {OPS} SELECT tool, {_MEASURES} FROM ops GROUP BY tool")
def _(s, d):
    return oplog.totals(op_records(s, d), "tool")


_CASE = "CASE tool " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in MECHANISMS.items()) + " ELSE 'other' END"


@query("O3_by_mechanism", f"WITH {OPS} SELECT {_CASE} AS mechanism, {_MEASURES} FROM ops GROUP BY 1")
def _(s, d):
    return oplog.totals(op_records(s, d).withColumn("mechanism", oplog.labelled(F.col("tool"), MECHANISMS, "other")), "mechanism")


@query("O4_measured_only", f"WITH {OPS} SELECT {_MEASURES} FROM ops WHERE tool <> 'click'")
def _(s, d):
    return oplog.totals(op_records(s, d).where("tool <> 'click'"))


@query("O5_time_range", f"WITH {OPS} SELECT {_MEASURES} FROM ops WHERE ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-20'")
def _(s, d):
    return oplog.totals(oplog.between(op_records(s, d), "2024-01-10", "2024-01-20"))


@query("O5_last_n", f"WITH {OPS} SELECT seq, tool, raw FROM ops ORDER BY seq DESC LIMIT 50")
def _(s, d):
    return oplog.last(op_records(s, d), 50).select("seq", "tool", "raw")


_TIMELINE = """span AS (SELECT CAST(min(epoch_us(ts)) AS DOUBLE) AS a, CAST(max(epoch_us(ts)) AS DOUBLE) AS b FROM ops),
filled AS (SELECT CAST(least(59, floor(greatest(0.0, least(1.0, (CAST(epoch_us(ts) AS DOUBLE) - a) / greatest(b - a, 1.0))) * 60)) AS INT) AS bucket, sum(greatest(raw - returned, 0) // 4) AS value FROM ops, span GROUP BY 1),
line AS (SELECT CAST(i AS INT) AS bucket, CAST(coalesce(value, 0) AS BIGINT) AS value, CAST(sum(coalesce(value, 0)) OVER (ORDER BY i) AS BIGINT) AS total FROM range(60) r(i) LEFT JOIN filled ON bucket = i)"""


def _timeline(s, d):
    return oplog.timeline(op_records(s, d), t.saved_tokens(F.col("raw"), F.col("returned")))


@query("O6_timeline", f"WITH {OPS}, {_TIMELINE} SELECT * FROM line")
def _(s, d):
    return _timeline(s, d)


@query("O12_sparkline", f"WITH {OPS}, {_TIMELINE}, cells AS (SELECT CAST(floor(bucket * 20 / 60) AS INT) AS cell, sum(value) AS v FROM line GROUP BY 1) SELECT cell, CAST(CASE WHEN max(v) OVER () > 0 THEN floor(v * 7 / max(v) OVER () + 0.5) ELSE 0 END AS INT) AS level FROM cells")
def _(s, d):
    return oplog.sparkline(_timeline(s, d))


@query("O7_event_buckets", "SELECT CAST(least(59, floor((epoch(ts) - 1704067200) / 2678400 * 60)) AS INT) AS bucket, count(*) AS n FROM events WHERE epoch(ts) BETWEEN 1704067200 AND 1706745600 GROUP BY 1")
def _(s, d):
    at = t.micros("ts") / 1e6
    inside = table(s, d, "events").where(at.between(1704067200, 1706745600))
    return inside.groupBy(F.least(F.lit(59), F.floor((at - 1704067200) / 2678400 * 60)).cast("int").alias("bucket")).agg(F.count("*").alias("n"))


@query("O8_activity", f"WITH {OPS} SELECT tool, count(*) AS n, count(DISTINCT session_id) AS sessions, max(ts) AS latest FROM ops GROUP BY tool")
def _(s, d):
    return oplog.activity(op_records(s, d), "tool")


@query("O9_by_recency", f"WITH {OPS} SELECT session_id, max(ts) AS latest FROM ops GROUP BY 1")
def _(s, d):
    return op_records(s, d).groupBy("session_id").agg(F.max("ts").alias("latest")).orderBy(F.desc("latest"))


_RATE_ROWS = ", ".join(f"('{a}', '{b}', {c}, {e})" for a, b, c, e in RATES)
_DIMS = ", ".join(f"('{x}')" for x in DIMENSIONS)
_MODEL = f"""rates(tool, dimension, tpo, trips) AS (VALUES {_RATE_ROWS}), dims(dimension) AS (VALUES {_DIMS}), counts AS (SELECT tool, count(*) AS n FROM ops GROUP BY 1),
model AS (SELECT dimension, CAST(sum(coalesce(n, 0)) AS BIGINT) AS ops, round(sum(coalesce(n, 0) * coalesce(tpo, 0.0)::DOUBLE), 6) AS est_tokens, round(sum(coalesce(n, 0) * coalesce(trips, 0.0)::DOUBLE), 6) AS round_trips FROM dims LEFT JOIN rates USING (dimension) LEFT JOIN counts USING (tool) GROUP BY 1)"""


def _model(s, d):
    return oplog.value_model(op_records(s, d), s.createDataFrame(RATES, "tool string, dimension string, tokens_per_op double, trips_per_op double"), s.createDataFrame([(x,) for x in DIMENSIONS], "dimension string"))


@query("O10_value_model", f"WITH {OPS}, {_MODEL} SELECT * FROM model")
def _(s, d):
    return _model(s, d)


@query("O11_cost", f"WITH {OPS}, {_MODEL} SELECT dimension, round(est_tokens * 3.0 / 1e6, 6) AS dollars, round(round_trips * 2.5, 6) AS seconds FROM model")
def _(s, d):
    return _model(s, d).select("dimension", F.round(F.col("est_tokens") * 3.0 / 1e6, 6).alias("dollars"), F.round(F.col("round_trips") * 2.5, 6).alias("seconds"))


@query("O13_rate_per_minute", f"WITH {OPS} SELECT round(count(*) / greatest((epoch(max(ts)) - epoch(min(ts))) / 60, 1 / 60.0::DOUBLE), 6) AS per_minute FROM ops")
def _(s, d):
    return op_records(s, d).agg(F.round(F.count("*") / F.greatest((t.micros(F.max("ts")) - t.micros(F.min("ts"))) / 6e7, F.lit(1 / 60.0)), 6).alias("per_minute"))


@query("O14_savings_adoption", f"WITH {OPS}, canonical(tool) AS (VALUES ('view'), ('click'), ('purchase'), ('signup'), ('export')) SELECT tool, coalesce(count(seq), 0) AS n, CAST(coalesce(sum(raw - returned) * 100 // sum(raw), 0) AS BIGINT) AS saved_pct, count(seq) > 0 AS adopted FROM canonical LEFT JOIN ops USING (tool) GROUP BY tool")
def _(s, d):
    names = s.createDataFrame([(x,) for x in ("view", "click", "purchase", "signup", "export")], "tool string")
    per = op_records(s, d).groupBy("tool").agg(F.count("*").alias("n"), F.sum("raw").alias("raw"), F.sum(F.col("raw") - F.col("returned")).alias("saved"))
    n = F.coalesce("n", F.lit(0))
    return names.join(per, "tool", "left").select("tool", n.alias("n"), F.coalesce(F.expr("saved * 100 div raw"), F.lit(0)).cast("long").alias("saved_pct"), (n > 0).alias("adopted"))


@query("O15_rebase", f"WITH {OPS} SELECT session_id, seq, CAST(raw - first_value(raw) OVER (PARTITION BY session_id ORDER BY seq) AS BIGINT) AS delta FROM ops")
def _(s, d):
    return op_records(s, d).select("session_id", "seq", (F.col("raw") - F.first("raw").over(Window.partitionBy("session_id").orderBy("seq"))).alias("delta"))


@query("O16_daily", f"WITH {OPS} SELECT date_trunc('day', ts)::TIMESTAMP AS day, count(*) AS n FROM ops GROUP BY 1")
def _(s, d):
    return op_records(s, d).groupBy(F.date_trunc("day", "ts").cast("timestamp_ntz").alias("day")).agg(F.count("*").alias("n"))


@query("O18_counters", f"WITH {OPS} SELECT tool AS key, CAST(sum(k) AS BIGINT) AS value, arg_max(k, seq) AS latest FROM ops GROUP BY tool")
def _(s, d):
    return op_records(s, d).groupBy(F.col("tool").alias("key")).agg(F.sum("k").alias("value"), F.max_by("k", "seq").alias("latest"))


@query("O19_cumulative", f"WITH {OPS} SELECT CAST(greatest(sum(raw) - sum(returned), 0) // 4 AS BIGINT) AS saved FROM ops")
def _(s, d):
    return op_records(s, d).agg(t.saved_tokens(F.sum("raw"), F.sum("returned")).alias("saved"))


@query("O20_savings_curve", f"WITH {OPS} SELECT tool, CAST(round((sum(raw) - sum(returned)) / sum(raw) * 100) AS BIGINT) AS pct FROM ops GROUP BY tool")
def _(s, d):
    return op_records(s, d).groupBy("tool").agg(F.round((F.sum("raw") - F.sum("returned")) / F.sum("raw") * 100).cast("long").alias("pct"))


@query("O21_grouped_accuracy", f"WITH {OPS} SELECT tool, count(*) AS n, round(avg(CASE WHEN k > 50 THEN 1.0 ELSE 0.0 END), 6)::DOUBLE AS correct, CAST(sum(raw) AS BIGINT) AS control, CAST(sum(returned) AS BIGINT) AS treatment FROM ops GROUP BY tool")
def _(s, d):
    return op_records(s, d).groupBy("tool").agg(F.count("*").alias("n"), F.round(F.avg((F.col("k") > 50).cast("double")), 6).alias("correct"), F.sum("raw").alias("control"), F.sum("returned").alias("treatment"))


@query("C8_counter_increments", f"WITH {OPS}, marks AS (SELECT session_id, seq, CAST(floor(sum(k) OVER (PARTITION BY session_id ORDER BY seq) / 50) AS BIGINT) AS v FROM ops) SELECT session_id, seq, delta FROM (SELECT session_id, seq, v - coalesce(lag(v) OVER (PARTITION BY session_id ORDER BY seq), 0) AS delta FROM marks) WHERE delta > 0")
def _(s, d):
    marks = op_records(s, d).select("session_id", "seq", F.floor(F.sum("k").over(Window.partitionBy("session_id").orderBy("seq")) / 50).cast("long").alias("v"))
    return oplog.increments(marks, "session_id", "v").select("session_id", "seq", "delta")


# sessions
@query("E5_intents", f"""WITH {PROMPTS}, l AS (SELECT *, lower(prompt) AS p FROM prompts) SELECT session_id, seq, CASE
  {' '.join("WHEN " + " OR ".join(f"contains(p, '{w}')" for w in ws) + f" THEN '{k}'" for k, ws in sessions.INTENTS.items())} ELSE 'general' END AS intent FROM l""")
def _(s, d):
    return prompts(s, d).select("session_id", "seq", sessions.intent(F.col("prompt")).alias("intent"))


_PATTERN = "|".join(sorted((w for ws in sessions.MARKERS.values() for w in ws), key=len, reverse=True)).replace("'", "''")
_IN = lambda ws: ", ".join("'" + w.replace("'", "''") + "'" for w in ws)


@query("E4_prompt_events", f"""WITH {PROMPTS}, m AS (SELECT session_id, seq, regexp_extract_all(lower(prompt), '({_PATTERN})') AS f FROM prompts)
  SELECT session_id, seq, 'user-prompt' AS category, 1 AS priority FROM m UNION ALL SELECT session_id, seq, 'intent', 4 FROM m"""
  + "".join(f" UNION ALL SELECT session_id, seq, '{k}', {sessions.PRIORITIES[k]} FROM m WHERE list_has_any(f, [{_IN(ws)}])" for k, ws in sessions.MARKERS.items()))
def _(s, d):
    return sessions.prompt_events(prompts(s, d)).select("session_id", "seq", "category", "priority")


@query("E6_references", "SELECT doc_id, array_to_string(list_slice(list_filter(list_transform(regexp_split_to_array(text, '\\s+'), lambda w: regexp_replace(w, '[.,;:)\\]}>]+$', '')), lambda w: regexp_matches(w, '^https?://') OR regexp_matches(w, '^#[0-9]+$')), 1, 5), ' ') AS refs FROM documents")
def _(s, d):
    return table(s, d, "documents").select("doc_id", F.array_join(sessions.references(F.col("text")), " ").alias("refs"))


@query("E7_failures", "SELECT conv_id, turn, turn % 10 < 9 AS failed FROM conversations")
def _(s, d):
    """Responses with a sign of failure in upper case, nine of ten."""
    sign = F.coalesce(F.get(F.array(*map(F.lit, sessions.FAILURES)), (F.col("turn") % 10).cast("int")), F.lit("done"))
    return table(s, d, "conversations").select("conv_id", "turn", sessions.looks_failed(F.concat(F.lit("ok, "), F.upper(sign))).alias("failed"))


_MARKED = "CASE turn % 7 " + " ".join(f"WHEN {i} THEN '{x}'" for i, x in enumerate(sessions.SYSTEM_PREFIXES)) + " ELSE '' END"


@query("E8_system_messages", f"SELECT conv_id, turn FROM (SELECT conv_id, turn, '  ' || {_MARKED} || text AS text FROM conversations) WHERE NOT (" + " OR ".join(f"starts_with(ltrim(text), '{x}')" for x in sessions.SYSTEM_PREFIXES) + ")")
def _(s, d):
    """Messages of which six of seven begin as a system message does, behind blanks."""
    prefix = F.coalesce(F.get(F.array(*map(F.lit, sessions.SYSTEM_PREFIXES)), F.col("turn").cast("int") % 7), F.lit(""))
    marked = table(s, d, "conversations").withColumn("text", F.concat(F.lit("  "), prefix, "text"))
    return marked.where(~sessions.is_system_message(F.col("text"))).select("conv_id", "turn")


@query("E10_latest_wins", f"WITH {OPS} SELECT k, tool, seq FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY ts DESC, seq DESC) AS n FROM ops) WHERE n = 1")
def _(s, d):
    return sessions.latest_wins(op_records(s, d), "k", ["ts", "seq"]).select("k", "tool", "seq")


@query("E11_project_memory", f"WITH {OPS} SELECT DISTINCT session_id, tool AS category, k FROM ops WHERE tool IN ('purchase', 'signup')")
def _(s, d):
    return op_records(s, d).where(F.col("tool").isin("purchase", "signup")).select("session_id", F.col("tool").alias("category"), "k").distinct()


@query("E12_resume", f"WITH {OPS} SELECT session_id, max(seq) FILTER (tool = 'purchase') AS snapshot, coalesce(max(seq) FILTER (tool = 'signup') > max(seq) FILTER (tool = 'purchase'), false) AS consumed FROM ops GROUP BY 1")
def _(s, d):
    at = lambda x: F.max(F.when(F.col("tool") == x, F.col("seq")))
    return op_records(s, d).groupBy("session_id").agg(at("purchase").alias("snapshot"), F.coalesce(at("signup") > at("purchase"), F.lit(False)).alias("consumed"))


@query("E14_latest_tasks", f"WITH {OPS} SELECT session_id, k, arg_max(tool, seq) AS status, min(seq) AS first_seen FROM ops GROUP BY 1, 2")
def _(s, d):
    return op_records(s, d).groupBy("session_id", "k").agg(F.max_by("tool", "seq").alias("status"), F.min("seq").alias("first_seen"))


@query("E15_recent_distinct", f"WITH {OPS}, l AS (SELECT session_id, k, max(seq) AS seq FROM ops GROUP BY 1, 2) SELECT * FROM (SELECT session_id, k, seq, row_number() OVER (PARTITION BY session_id ORDER BY seq DESC) AS rank FROM l) WHERE rank <= 5")
def _(s, d):
    return sessions.recent_distinct(op_records(s, d), "session_id", "k", 5).select("session_id", "k", "seq", F.col("rank").cast("long"))


@query("E16_frequency", f"WITH {OPS} SELECT k, count(*) AS n FROM ops GROUP BY k")
def _(s, d):
    return op_records(s, d).groupBy("k").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "k")


@query("E17_error_fixes", f"WITH {OPS} SELECT session_id, error_seq, fixed_by FROM (SELECT session_id, tool, seq AS error_seq, min(CASE WHEN tool = 'purchase' THEN seq END) OVER (PARTITION BY session_id ORDER BY seq ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS fixed_by FROM ops) WHERE tool = 'error'")
def _(s, d):
    return sessions.error_fixes(op_records(s, d), F.col("tool") == "error", F.col("tool") == "purchase")


@query("E18_last_values", f"WITH {OPS} SELECT session_id, tool, arg_max(k, seq) AS last FROM ops GROUP BY 1, 2")
def _(s, d):
    return op_records(s, d).groupBy("session_id", "tool").agg(F.max_by("k", "seq").alias("last"))


@query("E19_budget", """WITH s AS (SELECT conv_id AS session_id, turn AS idx, turn = 0 AS must, (turn * 7) % 5 AS rank, text FROM conversations),
  b AS (SELECT *, sum(strlen(text) + 1) OVER (PARTITION BY session_id ORDER BY must DESC, rank DESC, idx DESC ROWS UNBOUNDED PRECEDING) AS bytes, sum(CASE WHEN must THEN strlen(text) + 1 ELSE 0 END) OVER (PARTITION BY session_id) AS fixed FROM s)
  SELECT session_id, idx FROM b WHERE must OR greatest(bytes, fixed) <= 1000""")
def _(s, d):
    rows = table(s, d, "conversations").select(F.col("conv_id").alias("session_id"), F.col("turn").alias("idx"), (F.col("turn") == 0).alias("must"), (F.col("turn") * 7 % 5).alias("rank"), "text")
    return sessions.within_budget(rows, 1000).select("session_id", "idx")


@query("E20_memory_render", f"WITH {OPS} SELECT tool AS category, string_agg(DISTINCT CAST(k AS VARCHAR), ',' ORDER BY CAST(k AS VARCHAR)) AS entries FROM ops GROUP BY 1")
def _(s, d):
    return op_records(s, d).groupBy(F.col("tool").alias("category")).agg(F.array_join(F.array_sort(F.collect_set(F.col("k").cast("string"))), ",").alias("entries"))


@query("E23_active_groups", f"WITH {OPS} SELECT session_id, bool_or(tool IN ('purchase', 'signup')) AS commerce, bool_or(tool = 'error') AS failing FROM ops GROUP BY 1")
def _(s, d):
    return op_records(s, d).groupBy("session_id").agg(F.bool_or(F.col("tool").isin("purchase", "signup")).alias("commerce"), F.bool_or(F.col("tool") == "error").alias("failing"))


# rules
@query("H4_segments", "SELECT doc_id, CAST(len(list_filter(list_transform(regexp_split_to_array(text, '&&|\\|\\||[;|&\\n]'), lambda x: trim(x)), lambda x: x <> '')) AS INT) AS n FROM documents")
def _(s, d):
    return table(s, d, "documents").select("doc_id", F.size(rules.segments(F.col("text"))).alias("n"))


@query("H10_throttle", f"WITH {OPS}, n AS (SELECT session_id, tool, seq, row_number() OVER (PARTITION BY session_id, tool ORDER BY seq) AS n FROM ops) SELECT *, n = 1 AS once, n % 10 = 1 AS periodic, n >= 3 AND (n - 3) % 3 = 0 AS escalate FROM n")
def _(s, d):
    return rules.throttled(op_records(s, d).select("session_id", "tool", "seq"), ["session_id", "tool"]).withColumn("n", F.col("n").cast("long"))


@query("H11_liveness", f"WITH {OPS}, m AS (SELECT max(ts) AS now FROM ops) SELECT session_id, epoch(any_value(now)) - epoch(max(ts)) <= 86400 AS alive FROM ops, m GROUP BY 1")
def _(s, d):
    ops = op_records(s, d)
    now = ops.agg(F.max("ts").alias("now"))
    return ops.groupBy("session_id").agg(F.max("ts").alias("latest")).join(F.broadcast(now)).select("session_id", (t.micros("now") - t.micros("latest") <= 86400 * 1_000_000).alias("alive"))


# text
@query("T2_line_chunks", f"WITH {CHUNKS} SELECT path, chunk_id, md5(content) AS digest FROM chunks")
def _(s, d):
    return chunks(s, d).select("path", "chunk_id", F.md5("content").alias("digest"))


@query("T7_trigrams", "SELECT p_partkey, list_transform(range(1, length(p_name) - 1), lambda i: lower(substring(p_name, i, 3)))::VARCHAR[] AS grams FROM part")
def _(s, d):
    return table(s, d, "part").select("p_partkey", t.trigrams(F.col("p_name")).alias("grams"))


@query("T9_tokens", "SELECT doc_id, CAST(len(w) AS INT) AS n, CAST(len(list_distinct(w)) AS INT) AS n_distinct FROM (SELECT doc_id, list_filter(string_split_regex(lower(text), '[^\\pL\\pN]+'), lambda x: x <> '') AS w FROM documents)")
def _(s, d):
    w = t.tokens(F.col("text"))
    return table(s, d, "documents").select("doc_id", F.size(w).alias("n"), F.size(F.array_distinct(w)).alias("n_distinct"))


@query("T11_literal_queries", "SELECT c_custkey, NOT regexp_matches(c_name, '\\s') AND regexp_matches(c_name, '[^\\pL\\pN_]') AS literal FROM customer")
def _(s, d):
    return table(s, d, "customer").select("c_custkey", t.is_literal_query(F.col("c_name")).alias("literal"))


@query("T14_first_line_with", "SELECT doc_id, coalesce(substring(trim(list_filter(string_split(text, chr(10)), lambda x: contains(x, 'the'))[1]), 1, 120), '') AS line FROM documents")
def _(s, d):
    return table(s, d, "documents").select("doc_id", t.first_line_with(F.col("text"), "the").alias("line"))


_HEAD = "CASE " + " ".join(f"WHEN substr(h, {2 * (2048 - k) + 1}, 1) NOT IN ('8', '9', 'A', 'B') THEN {2048 - k}" for k in range(3)) + " ELSE 2045 END"
_TAIL = "CASE " + " ".join(f"WHEN substr(h, 2 * (n - 2048 + {k}) + 1, 1) NOT IN ('8', '9', 'A', 'B') THEN n - 2048 + {k}" for k in range(3)) + " ELSE n - 2045 END"


@query("T15_preview", f"""WITH x AS (SELECT doc_id, text, hex(encode(text)) AS h, strlen(text) AS n FROM documents), y AS (SELECT *, {_HEAD} AS a, {_TAIL} AS b FROM x)
  SELECT doc_id, CASE WHEN n > 8192 THEN decode(unhex(substr(h, 1, 2 * a))) || chr(10) || '... [' || (b - a) || ' bytes omitted] ...' || chr(10) || decode(unhex(substr(h, 2 * b + 1))) ELSE text END AS shown FROM y""")
def _(s, d):
    return table(s, d, "documents").select("doc_id", t.preview(F.col("text")).alias("shown"))


@query("T16_truncated", "SELECT doc_id, CASE WHEN length(text) > 80 THEN left(replace(text, chr(10), ' '), 80) || '…' ELSE replace(text, chr(10), ' ') END AS short FROM documents")
def _(s, d):
    return table(s, d, "documents").select("doc_id", t.truncated(F.col("text"), 80).alias("short"))


@query("T17_first_line", "SELECT doc_id, coalesce(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '')[1], '') AS line FROM documents")
def _(s, d):
    return table(s, d, "documents").select("doc_id", t.first_line(F.col("text")).alias("line"))


@query("T18_iso_time", "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%g') || 'Z' AS iso FROM events")
def _(s, d):
    return table(s, d, "events").select("event_id", t.iso_time(F.col("ts")).alias("iso"))


@query("T25_flattened", "SELECT event_id, 'k: ' || regexp_extract(props, '[0-9]+') AS flat FROM events")
def _(s, d):
    return table(s, d, "events").select("event_id", t.flattened(F.col("props")).alias("flat"))


# search
_BM25 = """q(query_id, query) AS (VALUES """ + ", ".join(f"('{a}', '{b}')" for a, b in SEARCHES) + """),
terms AS (SELECT DISTINCT query_id, unnest(string_split(query, ' ')) AS term FROM q), size AS (SELECT count(*) AS n, avg(len(w)) AS a FROM words),
posted AS (SELECT chunk_id, term, count(*) AS tf, any_value(len) AS len FROM (SELECT chunk_id, len(w) AS len, unnest(w) AS term FROM words) GROUP BY 1, 2),
df AS (SELECT term, count(*) AS df FROM posted GROUP BY 1),
scored AS (SELECT query_id, chunk_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / a))) AS score FROM posted JOIN df USING (term) JOIN terms USING (term), size GROUP BY 1, 2)"""


def _searches(s):
    return s.createDataFrame(SEARCHES, "query_id string, query string")


@query("R5_bm25_topk", f"WITH {CHUNKS}, {_BM25} SELECT query_id, chunk_id, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, path, chunk_id) AS rank FROM scored JOIN chunks USING (chunk_id)) WHERE rank <= 5")
def _(s, d):
    scored = search.bm25(search_index(s, d), _searches(s)).withColumn("score", F.round("score", 9))
    return search.top(scored, 5).select("query_id", "chunk_id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query("R1_stemmed")
def _(s, d):
    """Best chunks of both fields, words counted by their stems."""
    scored = search.bm25(search_index(s, d), _searches(s), ("content", "symbols"), True).withColumn("score", F.round("score", 9))
    return search.top(scored, 20).select("query_id", "chunk_id", F.round("score", 6).alias("score"), "rank")


@query("R2_overfetch", f"WITH {CHUNKS}, {_BM25} SELECT query_id, count(*) AS n FROM (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS r FROM scored) WHERE r <= 200 GROUP BY 1")
def _(s, d):
    """A limit of a hundred fetches two hundred candidates of each query, never eight hundred."""
    pool = search.top(search.bm25(search_index(s, d), _searches(s)), min(100 * 8, 200))
    return pool.groupBy("query_id").agg(F.count("*").alias("n"))


@query("R4_proximity", f"""WITH {CHUNKS}, {_BM25}, many AS (SELECT query_id, count(*) AS k FROM terms GROUP BY 1 HAVING count(*) > 1),
  places AS (SELECT query_id, chunk_id, term, pos, k FROM (SELECT chunk_id, unnest(w) AS term, unnest(range(0, len(w))) AS pos FROM words) JOIN terms USING (term) JOIN many USING (query_id)),
  ends AS (SELECT p.query_id, p.chunk_id, p.pos, t.term, p.k, max(CASE WHEN p.term = t.term THEN p.pos END) OVER (PARTITION BY p.query_id, p.chunk_id, t.term ORDER BY p.pos) AS latest FROM places p JOIN terms t ON p.query_id = t.query_id),
  covers AS (SELECT query_id, chunk_id, pos, pos - min(latest) AS span FROM ends GROUP BY ALL HAVING count(latest) = any_value(k))
  SELECT query_id, chunk_id, CAST(min(span) AS INT) AS span FROM covers GROUP BY 1, 2""".replace("GROUP BY ALL", "GROUP BY query_id, chunk_id, pos"))
def _(s, d):
    return search.spans(search_index(s, d), _searches(s))


_COVERS = """many AS (SELECT query_id, count(*) AS k FROM terms GROUP BY 1 HAVING count(*) > 1),
  places AS (SELECT query_id, chunk_id, term, pos, k FROM (SELECT chunk_id, unnest(w) AS term, unnest(range(0, len(w))) AS pos FROM words) JOIN terms USING (term) JOIN many USING (query_id)),
  ends AS (SELECT p.query_id, p.chunk_id, p.pos, t.term, p.k, max(CASE WHEN p.term = t.term THEN p.pos END) OVER (PARTITION BY p.query_id, p.chunk_id, t.term ORDER BY p.pos) AS latest FROM places p JOIN terms t ON p.query_id = t.query_id),
  covers AS (SELECT query_id, chunk_id, pos, pos - min(latest) AS span FROM ends GROUP BY query_id, chunk_id, pos HAVING count(latest) = any_value(k))"""
_RANKED = f"""WITH {CHUNKS}, {_BM25}, {_COVERS}, near AS (SELECT query_id, chunk_id, min(span) AS span FROM covers GROUP BY 1, 2),
  base AS (SELECT query_id, chunk_id, score * CASE WHEN contains(chunk_id, '.md#') THEN 0.7 ELSE 1 END AS score, split_part(chunk_id, '#', 1) AS path FROM scored),
  pool AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, path, chunk_id) AS r FROM base),
  summed AS (SELECT query_id, chunk_id, path, score + coalesce(4.0 / greatest(span, 1), 0) AS score FROM pool LEFT JOIN near USING (query_id, chunk_id) WHERE r <= 40),
  final AS (SELECT query_id, chunk_id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, path, chunk_id) AS rank FROM summed)"""


@query("R3_content_ranked", _RANKED + " SELECT query_id, chunk_id, score, rank FROM final WHERE rank <= 5")
def _(s, d):
    """Penalty and proximity over the content's words as they are."""
    best = search.ranked(search_index(s, d), _searches(s), 5, ("content",), False)
    return best.select("query_id", "chunk_id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query("R3_ranked")
def _(s, d):
    return search.ranked(search_index(s, d), _searches(s)).select("query_id", "chunk_id", F.round("score", 6).alias("score"), "rank")


@query("R7_literal", f"WITH {CHUNKS} SELECT chunk_id, CAST((length(lower(content)) - length(replace(lower(content), 'tion', ''))) // 4 AS BIGINT) AS score FROM chunks WHERE contains(lower(content), 'tion') ORDER BY score DESC, path, chunk_id LIMIT 20")
def _(s, d):
    return search.literal_indexed(search_index(s, d), "tion", 20).select("chunk_id", "score")


@query("R8_short_literal", f"WITH {CHUNKS} SELECT chunk_id, CAST((length(lower(content)) - length(replace(lower(content), 'qu', ''))) // 2 AS BIGINT) AS score FROM chunks WHERE contains(lower(content), 'qu') ORDER BY score DESC, path, chunk_id LIMIT 20")
def _(s, d):
    """A needle of two characters has no trigram: the contents are searched."""
    return search.literal(search_index(s, d).chunks(), "qu", 20).select("chunk_id", "score")


@query("R9_corpus_size", f"WITH {CHUNKS} SELECT count(DISTINCT path) AS paths, count(*) AS n_chunks FROM chunks")
def _(s, d):
    return chunks(s, d).agg(F.count_distinct("path").alias("paths"), F.count("*").alias("n_chunks"))


@query("R10_grep", "SELECT source || '/' || doc_id || CASE WHEN doc_id % 5 = 0 THEN '.md' ELSE '.txt' END AS path, i AS line, x AS text FROM (SELECT source, doc_id, unnest(l) AS x, unnest(range(1, len(l) + 1)) AS i FROM (SELECT source, doc_id, string_split(text, chr(10)) AS l FROM documents)) WHERE contains(x, 'Licensed')")
def _(s, d):
    docs = table(s, d, "documents").select(F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.when(F.col("doc_id") % 5 == 0, ".md").otherwise(".txt")).alias("path"), F.col("text").alias("content"))
    return search.grep(docs, "Licensed").withColumn("line", F.col("line").cast("long"))


@query("R11_metrics", f"""{_RANKED}, good AS (SELECT doc_id FROM labels WHERE quality = 1), truth AS (SELECT query_id, chunk_id FROM chunks JOIN good ON doc_id = CAST(regexp_extract(path, '/([0-9]+)[.]', 1) AS BIGINT), (SELECT DISTINCT query_id FROM terms)),
  hits AS (SELECT f.*, t.chunk_id IS NOT NULL AS hit FROM final f LEFT JOIN truth t USING (query_id, chunk_id) WHERE rank <= 10),
  each AS (SELECT query_id, min(rank) FILTER (hit) AS first, count(*) FILTER (hit AND rank <= 5) AS h, count(*) FILTER (hit) AS found, count(*) AS given FROM hits GROUP BY 1),
  whole AS (SELECT *, (SELECT count(*) FROM truth t WHERE t.query_id = e.query_id) AS relevant FROM each e)
  SELECT round(avg(coalesce(1.0::DOUBLE / first, 0)), 6) AS mrr, round(avg(h / 5.0::DOUBLE), 6) AS precision_at_k, round(avg(CAST(found > 0 AS INT)), 6) AS hit_rate, round(avg(found / given::DOUBLE), 6) AS precision, round(avg(coalesce(found / nullif(relevant, 0)::DOUBLE, 0)), 6) AS recall FROM whole""")
def _(s, d):
    """Rankings held against the documents labelled good."""
    index = search_index(s, d)
    good = table(s, d, "labels").where("quality = 1").select("doc_id")
    doc = F.regexp_extract("path", r"/([0-9]+)\.", 1).cast("long")
    truth = index.chunks().join(good, doc == F.col("doc_id"), "left_semi").select("chunk_id").join(F.broadcast(_searches(s).select("query_id")))
    return search.retrieval_metrics(search.ranked(index, _searches(s), 10, ("content",), False), truth, 5)


# change data and blobs
@query("C1_manifest_diff", "SELECT a.path, 'changed' AS change FROM (SELECT doc_id AS path, n_chars AS m FROM documents WHERE doc_id % 7 <> 0) a LEFT JOIN (SELECT doc_id AS path, n_chars - (doc_id % 3 = 0)::INT AS m FROM documents WHERE doc_id % 5 <> 0) b USING (path) WHERE b.path IS NULL OR a.m <> b.m UNION ALL SELECT doc_id, 'deleted' FROM documents WHERE doc_id % 5 <> 0 AND doc_id % 7 = 0")
def _(s, d):
    docs = table(s, d, "documents")
    was = docs.where("doc_id % 5 <> 0").select(F.col("doc_id").alias("path"), (F.col("n_chars") - (F.col("doc_id") % 3 == 0).cast("int")).alias("mtime"))
    return incremental.manifest_diff(was, docs.where("doc_id % 7 <> 0").select(F.col("doc_id").alias("path"), F.col("n_chars").alias("mtime")))


@query("S9_blobs", "SELECT DISTINCT sha256(text) AS hash, strlen(text) AS bytes FROM documents")
def _(s, d):
    return incremental.new_blobs(table(s, d, "documents").select(F.col("text").alias("content"))).select("hash", F.octet_length("content").cast("long").alias("bytes"))


@query("S14_recall", "SELECT hash FROM (SELECT sha256(text) AS hash FROM documents) WHERE hash >= 'a' AND hash < 'ag' ORDER BY hash LIMIT 1")
def _(s, d):
    return incremental.recall(incremental.new_blobs(table(s, d, "documents").select(F.col("text").alias("content"))), "a").select("hash")


@query("D6_verify", "SELECT o_custkey, CASE WHEN o_custkey % 10 = 3 THEN 'CORRUPT' WHEN o_custkey % 10 = 4 THEN 'MISSING' ELSE 'PASS' END AS status FROM (SELECT DISTINCT o_custkey FROM orders ORDER BY 1 DESC LIMIT 500)")
def _(s, d):
    """The last five hundred references held against what is stored under them: altered, gone, or whole and the same after compaction."""
    json = F.to_json(F.sort_array(F.collect_list(F.struct("o_orderkey", "o_orderpriority"))))
    blobs = table(s, d, "orders").groupBy("o_custkey").agg(json.alias("content")).withColumn("ref", F.sha2("content", 256))
    kept = blobs.where("o_custkey % 10 <> 4").select(F.col("ref").alias("hash"), F.when(F.col("o_custkey") % 10 == 3, F.concat("content", F.lit(" "))).otherwise(F.col("content")).alias("content"))
    return incremental.verified(blobs.select(F.col("o_custkey").alias("seq"), "ref"), kept, 500).select(F.col("seq").alias("o_custkey"), "status")


@query("D4_run_lengths", "SELECT user_id, grp, v, n FROM (SELECT user_id, grp, any_value(event_type) AS v, count(*) AS n FROM (SELECT *, sum(ch) OVER (PARTITION BY user_id ORDER BY event_id) AS grp FROM (SELECT *, CASE WHEN event_type = lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) THEN 0 ELSE 1 END AS ch FROM events)) GROUP BY 1, 2)")
def _(s, d):
    w = Window.partitionBy("user_id").orderBy("event_id")
    marked = table(s, d, "events").withColumn("ch", F.when(F.col("event_type") == F.lag("event_type").over(w), 0).otherwise(1)).withColumn("grp", F.sum("ch").over(w))
    return marked.groupBy("user_id", "grp").agg(F.first("event_type").alias("v"), F.count("*").alias("n"))


@query("D3_dictionary", "SELECT s, n, row_number() OVER (ORDER BY n DESC, s) AS ref FROM (SELECT p_brand AS s, count(*) AS n FROM part WHERE strlen(p_brand) >= 5 GROUP BY 1 HAVING count(*) >= 2)")
def _(s, d):
    """Strings by how often they occur, numbered by ranges: no task sorts them all."""
    counts = table(s, d, "part").where(F.octet_length("p_brand") >= 5).groupBy(F.col("p_brand").alias("s")).agg(F.count("*").alias("n")).where("n >= 2")
    return g.numbered(counts.withColumn("down", -F.col("n")), ["down", "s"], "ref").select("s", "n", "ref")


# what scripts are run for
@query("U6_summary", "SELECT max(l_quantity) AS most, round(sum(l_quantity), 2) AS total, count(*) FILTER (l_returnflag = 'R') AS returned, count(DISTINCT l_shipdate) AS days FROM lineitem")
def _(s, d):
    return table(s, d, "lineitem").agg(F.max("l_quantity").alias("most"), F.round(F.sum("l_quantity"), 2).alias("total"), F.count_if(F.col("l_returnflag") == "R").alias("returned"), F.count_distinct("l_shipdate").alias("days"))


@query("U6_busiest", "SELECT o_orderpriority, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1 ORDER BY total DESC, 1 LIMIT 1")
def _(s, d):
    return table(s, d, "orders").groupBy("o_orderpriority").agg(F.round(F.sum("o_totalprice"), 2).alias("total")).orderBy(F.desc("total"), "o_orderpriority").limit(1)


from quillspan.plans import code, extended, flows, graphs, store, streams, texts  # noqa: E402, F401  registers their queries
