"""Queries over tool calls, session upkeep, guides and routing."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspan.operators import routing, snapshot, toolcalls
from quillspan.plans.queries import query
from quillspan.sources.tables import OPS, op_records, table

#: Sample tools; the number of an event picks one.
TOOLS = ("Edit", "Write", "Read", "TodoWrite", "EnterPlanMode", "ExitPlanMode", "Skill", "Agent", "mcp__db__query", "Bash", "TaskUpdate", "Other")


def _calls(s, d):
    """Op records as tool calls: k picks the tool, every seventh fails."""
    ops = op_records(s, d)
    k, user = F.col("k"), F.col("session_id").cast("string")
    pick = lambda column, values: F.get(F.array(*map(F.lit, values)), (column % len(values)).cast("int"))
    todos = F.array(F.struct(F.concat(F.lit("do "), user).alias("content"), F.lit("completed").alias("status")), F.struct(F.lit("").alias("content"), F.lit("pending").alias("status")), F.struct(F.lit("then").alias("content"), F.lit(None).cast("string").alias("status")))
    input_ = F.to_json(F.struct(
        F.when(k % 12 < 3, F.concat(F.lit("src/u"), user, F.lit(".py"))).alias("file_path"), F.when(k % 12 == 3, todos).alias("todos"), F.when(k % 12 == 5, F.lit("step one")).alias("plan"), F.when(k % 12 == 6, F.lit("chart")).alias("skill"),
        F.when(k % 12 == 7, F.lit("look around")).alias("description"), F.when(k % 12 == 9, pick(F.col("seq"), ("git commit -m x", "cd /tmp", "ls"))).alias("command"), F.when(k % 12 == 10, F.lit("one task")).alias("content"),
    ))
    response = F.when(k % 7 == 0, F.concat(F.lit("\nerror: no "), user)).otherwise("fine\nmore")
    return ops.select("seq", "session_id", pick(k, TOOLS).alias("tool"), input_.alias("input"), response.alias("response"), "k")


_E1 = f"""calls AS (SELECT seq, session_id AS u, k % 12 AS t, k % 7 = 0 AS bad, seq % 3 AS c FROM ops),
rows AS (SELECT seq, 'file' AS category, 1 AS priority, 'src/u' || u || '.py' AS text, ['edit', 'write', 'read'][t + 1] AS status FROM calls WHERE t < 3
  UNION ALL SELECT seq, 'task', 1, unnest(['do ' || u, 'then']), unnest(['completed', 'pending']) FROM calls WHERE t = 3
  UNION ALL SELECT seq, 'plan', 1, CASE t WHEN 4 THEN '' ELSE 'step one' END, CASE t WHEN 4 THEN 'enter' ELSE 'exit' END FROM calls WHERE t IN (4, 5)
  UNION ALL SELECT seq, 'skill', 3, 'chart', NULL FROM calls WHERE t = 6
  UNION ALL SELECT seq, 'subagent', 3, 'look around', 'launched' FROM calls WHERE t = 7
  UNION ALL SELECT seq, 'subagent', 3, CASE WHEN bad THEN 'error: no ' || u ELSE 'fine' END, 'finding' FROM calls WHERE t = 7
  UNION ALL SELECT seq, 'mcp-tool', 3, 'mcp__db__query', NULL FROM calls WHERE t = 8
  UNION ALL SELECT seq, CASE c WHEN 0 THEN 'git' ELSE 'environment' END, 2, CASE c WHEN 0 THEN 'commit' ELSE 'cd /tmp' END, NULL FROM calls WHERE t = 9 AND c < 2
  UNION ALL SELECT seq, 'error', 2, 'error: no ' || u, NULL FROM calls WHERE t = 9 AND bad
  UNION ALL SELECT seq, 'task', 1, 'one task', 'pending' FROM calls WHERE t = 10
  UNION ALL SELECT seq, 'error', 2, 'error: no ' || u, {list(TOOLS)!r}[t + 1] FROM calls WHERE t <> 9 AND bad)"""


@query("E1_tool_events", f"WITH {OPS}, {_E1} SELECT seq, category, priority, text, coalesce(status, '-') AS status FROM rows")
def _(s, d):
    events = toolcalls.tool_events(F.col("tool"), F.col("input"), F.col("response"))
    return _calls(s, d).select("seq", F.explode(events).alias("e")).select("seq", "e.category", "e.priority", "e.text", F.coalesce("e.status", F.lit("-")).alias("status"))


@query("E2_task_events", f"WITH {OPS}, {_E1} SELECT seq, text, status FROM rows WHERE category = 'task'")
def _(s, d):
    calls = _calls(s, d).where(F.col("tool").isin(*toolcalls.TASK_TOOLS))
    return calls.select("seq", F.explode(toolcalls.task_events(F.col("input"))).alias("e")).select("seq", "e.text", "e.status")


@query("E12_claims", f"""WITH {OPS}, saved AS (SELECT k % 5 AS project, session_id, max(seq) AS seq FROM ops WHERE tool = 'purchase' GROUP BY 1, 2), marks AS (SELECT session_id, max(seq) AS marked FROM ops WHERE tool = 'signup' AND k < 20 GROUP BY 1),
  free AS (SELECT s.* FROM saved s LEFT JOIN marks m ON m.session_id = s.session_id WHERE NOT coalesce(marked > seq, false)), asking AS (SELECT DISTINCT k % 5 AS project, session_id FROM ops WHERE tool = 'error')
  SELECT a.project, a.session_id, arg_max(f.session_id, f.seq) AS claimed, 'guide ' || max(f.seq) AS snapshot FROM asking a JOIN free f ON f.project = a.project AND f.session_id <> a.session_id GROUP BY 1, 2""")
def _(s, d):
    """Sessions with an error take over the latest resume of their project that is neither used up nor their own."""
    ops = op_records(s, d).withColumn("project", F.col("k") % 5)
    saved = ops.where("tool = 'purchase'").select("project", "session_id", "seq", F.concat(F.lit("guide "), F.col("seq").cast("string")).alias("snapshot"))
    held = toolcalls.resumes(saved, ops.where("tool = 'signup' and k < 20").select("session_id", "seq"))
    return toolcalls.claims(ops.where("tool = 'error'").select("project", "session_id").distinct(), held)


@query("E13_compactions", f"WITH {OPS} SELECT session_id, seq, row_number() OVER (PARTITION BY session_id ORDER BY seq) AS compact_count FROM ops WHERE tool = 'signup'")
def _(s, d):
    return toolcalls.compactions(op_records(s, d), F.col("tool") == "signup").select("session_id", "seq", F.col("compact_count").cast("long").alias("compact_count"))


_ACTION = "CASE source WHEN 'compact' THEN CASE WHEN own THEN 'own resume' WHEN n > 1 THEN 'snapshot' ELSE 'nothing' END WHEN 'resume' THEN CASE WHEN n > 1 THEN 'snapshot' WHEN other THEN 'claimed resume' ELSE 'nothing' END WHEN 'startup' THEN 'memory' ELSE 'nothing' END"


@query("E21_starts", f"""WITH x AS (SELECT conv_id AS session_id, count(*) AS n, bool_or(role = 'system') AS own, max(turn) % 2 = 0 AS other FROM conversations GROUP BY 1),
  y AS (SELECT *, unnest(['compact', 'resume', 'startup', 'clear']) AS source FROM x) SELECT session_id, source, {_ACTION} AS action FROM y""")
def _(s, d):
    """What each way to start brings into each conversation."""
    known = table(s, d, "conversations").groupBy(F.col("conv_id").alias("session_id")).agg(F.count("*").alias("n"), F.bool_or(F.col("role") == "system").alias("own"), (F.max("turn") % 2 == 0).alias("other"))
    each = known.withColumn("source", F.explode(F.array(*map(F.lit, ("compact", "resume", "startup", "clear")))))
    return each.select("session_id", "source", toolcalls.start_action(F.col("source"), F.col("n") > 1, F.col("own"), F.col("other")).alias("action"))


@query("E24_session_ids", "SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'pid-' || event_id WHEN 1 THEN 'u' || user_id WHEN 2 THEN 'conv.' || user_id ELSE '.hidden' END AS id FROM events")
def _(s, d):
    k, user = F.col("event_id") % 4, F.col("user_id").cast("string")
    transcript = F.when(k == 2, F.concat(F.lit("/t/conv."), user, F.lit(".jsonl"))).when(k == 3, "/t/.hidden").when(k == 1, "")
    given = F.when(k == 1, F.concat(F.lit("u"), user)).when(k == 0, "").otherwise("not used")
    return table(s, d, "events").select("event_id", toolcalls.session_id(transcript, given, F.col("event_id")).alias("id"))


@query("E25_cleared", f"WITH {OPS}, c AS (SELECT session_id, max(seq) AS since FROM ops WHERE tool = 'signup' GROUP BY 1) SELECT ops.session_id AS project, seq FROM ops LEFT JOIN c USING (session_id) WHERE since IS NULL OR seq > since")
def _(s, d):
    events = op_records(s, d).select(F.col("session_id").alias("project"), "seq", "tool")
    return toolcalls.cleared(events, events.where("tool = 'signup'")).select("project", "seq")


_CATEGORIES = ("user-prompt", "task", "plan", "decision", "file", "error", "constraint", "blocker", "git", "rule", "mcp-tool", "subagent", "rejected-approach", "external-ref", "environment", "role", "intent")


def _events(s, d):
    """Op records as session events of all kinds."""
    ops = op_records(s, d)
    category = F.get(F.array(*map(F.lit, _CATEGORIES)), (F.col("k") % 17).cast("int"))
    status = F.when(F.col("k") % 17 == 1, F.get(F.array(*map(F.lit, ("pending", "completed", "in_progress"))), (F.col("seq") % 3).cast("int"))).when(F.col("k") % 17 == 2, F.get(F.array(*map(F.lit, ("enter", "exit"))), (F.col("seq") % 2).cast("int")))
    status = status.when(F.col("k") % 17 == 4, F.get(F.array(*map(F.lit, ("edit", "read", "write"))), (F.col("seq") % 3).cast("int"))).when(F.col("k") % 17 == 8, F.when(F.col("seq") % 2 == 0, "commit").otherwise("push")).when(F.col("k") % 17 == 11, F.when(F.col("seq") % 2 == 0, "finding").otherwise("launched"))
    return ops.select("session_id", "seq", category.alias("category"), F.concat("tool", F.lit(" "), (F.col("seq") % 7).cast("string")).alias("text"), status.alias("status"))


def _sections_sql() -> str:
    """The lines of every section, from ``ev(session_id, seq, c, text, status)``."""
    parts = ["SELECT session_id, 0 AS idx, 0 AS place, arg_max(text, seq) AS line FROM ev WHERE c = 0 GROUP BY 1", "SELECT session_id, 15, 0, arg_max(text, seq) FROM ev WHERE c = 15 GROUP BY 1"]
    parts.append("SELECT session_id, 1, place, CASE status WHEN 'completed' THEN '[x]' WHEN 'in_progress' THEN '[~]' ELSE '[ ]' END || ' ' || text || ' (' || status || ')' FROM (SELECT session_id, text, arg_max(status, seq) AS status, min(seq) AS place, row_number() OVER (PARTITION BY session_id ORDER BY min(seq), text) AS n FROM ev WHERE c = 1 GROUP BY 1, 2) WHERE n <= 20")
    for idx, most, line, where in (
        (2, 5, "CASE WHEN status = 'exit' THEN 'plan: ' || text ELSE 'plan enter' END", "true"), (3, 8, "text", "true"), (4, 15, "text", "status IN ('edit', 'write')"), (6, 5, "text", "true"), (7, 5, "text", "true"), (8, 8, "status || ': ' || text", "true"),
        (9, 6, "text", "true"), (11, 4, "text", "status = 'finding'"), (12, 5, "text", "true"), (13, 8, "text", "true"), (14, 5, "text", "true"),
    ):
        parts.append(f"SELECT session_id, {idx}, place, line FROM (SELECT session_id, {line} AS line, max(seq) AS place, row_number() OVER (PARTITION BY session_id ORDER BY max(seq) DESC, {line}) AS n FROM ev WHERE c = {idx} AND {where} GROUP BY 1, 2) WHERE n <= {most}")
    parts.append("SELECT session_id, 10, row_number() OVER (PARTITION BY session_id ORDER BY count(*) DESC, text), text || ' ×' || count(*) FROM ev WHERE c = 10 GROUP BY session_id, text")
    parts.append("SELECT session_id, 16, 1, text FROM (SELECT session_id, text, row_number() OVER (PARTITION BY session_id ORDER BY count(*) DESC, text) AS n FROM ev WHERE c = 16 GROUP BY 1, 2) WHERE n = 1")
    fixed = "(c = 4 AND status IN ('edit', 'write')) OR (c = 8 AND status = 'commit')"
    parts.append(f"""SELECT session_id, 5, CASE WHEN fix IS NULL THEN n ELSE 6 + n END, CASE WHEN fix IS NULL THEN 'UNRESOLVED: ' || text ELSE 'fixed: ' || text || ' → ' || fix END FROM (SELECT e.session_id, e.text, CASE WHEN f.c = 4 THEN 'edited ' || f.text WHEN f.c = 8 THEN 'git commit' END AS fix, row_number() OVER (PARTITION BY e.session_id, f.seq IS NULL ORDER BY e.seq) AS n
      FROM (SELECT *, min(CASE WHEN {fixed} THEN seq END) OVER (PARTITION BY session_id ORDER BY seq ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS fixed_by FROM ev) e LEFT JOIN ev f ON f.session_id = e.session_id AND f.seq = e.fixed_by WHERE e.c = 5) WHERE (fix IS NULL AND n <= 6) OR (fix IS NOT NULL AND n <= 4)""")
    return " UNION ALL ".join(parts)


_EV = """ev AS (SELECT session_id, seq, k % 17 AS c, tool || ' ' || seq % 7 AS text, CASE k % 17 WHEN 1 THEN ['pending', 'completed', 'in_progress'][seq % 3 + 1] WHEN 2 THEN ['enter', 'exit'][seq % 2 + 1] WHEN 4 THEN ['edit', 'read', 'write'][seq % 3 + 1] WHEN 8 THEN ['commit', 'push'][seq % 2 + 1] WHEN 11 THEN ['finding', 'launched'][seq % 2 + 1] END AS status FROM ops)"""
_TITLES = "[" + ", ".join(f"'{x[0]}'" for x in snapshot.SECTIONS) + "]"
_RANKS = "[" + ", ".join(str(x[4]) for x in snapshot.SECTIONS) + "]"
_SECTIONS = f"WITH {OPS}, {_EV}, lines AS ({_sections_sql()}), sections AS (SELECT session_id, CAST(idx AS INT) AS idx, {_RANKS}[idx + 1] AS rank, '## ' || {_TITLES}[idx + 1] || chr(10) || string_agg('- ' || line || chr(10), '' ORDER BY place, line) AS text FROM lines GROUP BY session_id, idx)"


@query("E19_sections", f"{_SECTIONS} SELECT session_id, idx, rank, text FROM sections")
def _(s, d):
    return snapshot.sections(_events(s, d)).select("session_id", "idx", "rank", "text")


@query("E19_guide", f"""{_SECTIONS}, counted AS (SELECT *, 16 + sum(CASE WHEN rank = 255 THEN strlen(text) + 1 ELSE 0 END) OVER (PARTITION BY session_id) + sum(CASE WHEN rank < 255 THEN strlen(text) + 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY rank DESC, idx DESC ROWS UNBOUNDED PRECEDING) AS bytes FROM sections),
  kept AS (SELECT * FROM counted WHERE rank = 255 OR bytes <= 700) SELECT session_id, '# Session Guide' || chr(10) || string_agg(chr(10) || text, '' ORDER BY idx) AS guide FROM kept GROUP BY 1""")
def _(s, d):
    """Guides of seven hundred bytes, more only where the sections that must stay have more."""
    return snapshot.guide(_events(s, d), 700)


_SETTINGS = (None, " Full ", "STEER", "wrap", "nudge", "off", "", "loud")
_LEVELS = ("full", "full", "steer", "wrap", "nudge", "off", "off", "off")


@query("H1_levels", "SELECT event_id, level, level IN ('steer', 'full') AS steers, level IN ('nudge', 'steer', 'full') AS nudges, level IN ('wrap', 'full') AS wraps FROM (SELECT event_id, CASE event_id % 8 " + " ".join(f"WHEN {i} THEN '{x}'" for i, x in enumerate(_LEVELS)) + " END AS level FROM events)")
def _(s, d):
    spec = F.get(F.array(*(F.lit(x).cast("string") for x in _SETTINGS)), (F.col("event_id") % 8).cast("int"))
    lvl = table(s, d, "events").select("event_id", routing.level(spec).alias("level"))
    return lvl.select("event_id", "level", routing.steers(F.col("level")).alias("steers"), routing.nudges(F.col("level")).alias("nudges"), routing.wraps(F.col("level")).alias("wraps"))


#: Sample calls: tool, command, path, prompt, and the decision at each level (off, nudge, steer, wrap, full) where the server is ready, hints aside.
_SAMPLES = (
    ("WebFetch", None, None, None, ("", "", "fetch", "", "fetch")),
    ("Bash", "curl http://a", None, None, ("", "hint bash", "network", "wrap", "network")),
    ("Bash", "git log", None, None, ("", "hint bash", "hint bash", "wrap", "wrap")),
    ("Bash", "git status", None, None, ("", "", "", "", "")),
    ("Bash", "cd x && ls", None, None, ("", "", "", "", "")),
    ("Bash", "mvn package", None, None, ("", "hint bash", "build", "wrap", "build")),
    ("Grep", None, None, None, ("", "hint grep", "hint grep", "", "hint grep")),
    ("Read", None, "a/b.py", None, ("", "hint code", "hint code", "", "hint code")),
    ("Read", None, "notes.txt", None, ("", "hint read", "hint read", "", "hint read")),
    ("Agent", None, None, "look", ("", "agent", "agent", "", "agent")),
    ("mcp__db__query", None, None, None, ("", "hint external", "hint external", "", "hint external")),
    ("mcp__own__run", None, None, None, ("", "", "", "", "")),
    ("Write", None, "a.py", None, ("", "", "", "", "")),
)
_SAMPLE_ROWS = ", ".join(f"({i}, {j}, '{outcome}')" for i, x in enumerate(_SAMPLES) for j, outcome in enumerate(x[4]))


@query("H2_routed", f"""WITH {OPS}, s(i, j, o) AS (VALUES {_SAMPLE_ROWS}), c AS (SELECT seq, session_id, session_id % 5 AS j, k % 13 AS i, k % 2 = 0 AS ready FROM ops),
  x AS (SELECT seq, session_id, o, ready, CASE WHEN starts_with(o, 'hint ') THEN substr(o, 6) END AS hint FROM c JOIN s USING (i, j)),
  n AS (SELECT *, sum(CASE WHEN hint = 'code' THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY seq) AS reads, row_number() OVER (PARTITION BY session_id, hint ORDER BY seq) AS nth FROM x),
  g AS (SELECT *, coalesce(hint = 'code' AND reads >= 3 AND (reads - 3) % 3 = 0, false) AS graph FROM n),
  p AS (SELECT *, sum(CASE WHEN hint IN ('code', 'read') AND NOT graph THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY seq) AS plain FROM g),
  r AS (SELECT seq, CASE WHEN o IN ('fetch', 'network', 'build') THEN CASE WHEN ready THEN o END WHEN o IN ('wrap', 'agent') THEN o WHEN graph THEN 'read-graph' WHEN hint IN ('code', 'read') AND plain = 1 THEN 'read'
    WHEN hint IN ('grep', 'bash') AND nth = 1 THEN hint WHEN hint = 'external' AND nth % 10 = 1 THEN hint END AS reason FROM p)
  SELECT seq, CASE WHEN reason IS NULL THEN 'passthrough' WHEN reason = 'fetch' THEN 'deny' WHEN reason IN ('network', 'build', 'wrap', 'agent') THEN 'modify' ELSE 'context' END AS decision, coalesce(reason, '-') AS reason FROM r""")
def _(s, d):
    """Sample calls by thirteens, at the level of their session."""
    ops = op_records(s, d)
    of = lambda i: F.get(F.array(*(F.lit(x[i]).cast("string") for x in _SAMPLES)), (F.col("k") % 13).cast("int"))
    lvl = F.get(F.array(*map(F.lit, routing.LEVELS)), (F.col("session_id") % 5).cast("int"))
    calls = ops.select("session_id", "seq", of(0).alias("tool"), of(1).alias("command"), of(2).alias("path"), of(3).alias("prompt"), lvl.alias("level"), (F.col("k") % 2 == 0).alias("ready"))
    return routing.routed(calls, "own").select("seq", "decision", F.coalesce("reason", F.lit("-")).alias("reason"))


_BULLETS = {"shell": "- shell\n", "read": "- read\n", "search": "- search\n", "fetch": "- fetch\n"}


@query("H12_guides", f"""WITH {OPS}, a AS (SELECT session_id, bool_or(tool = 'error') AS sh, bool_or(tool = 'signup' AND k < 50) AS f FROM ops GROUP BY 1)
  SELECT session_id, '<guide>' || chr(10) || CASE WHEN sh OR NOT f THEN '- shell' || chr(10) ELSE '' END || CASE WHEN f OR NOT sh THEN '- read' || chr(10) || '- search' || chr(10) ELSE '' END || '- fetch' || chr(10) || '</guide>' AS guide,
  CASE WHEN session_id % 2 = 0 THEN 'look' || chr(10) || chr(10) || 'G' END AS prompt FROM a""")
def _(s, d):
    """The guide of each session's groups of tools, and a sub-agent's instructions with one behind them."""
    active = op_records(s, d).groupBy("session_id").agg(F.bool_or(F.col("tool") == "error").alias("shell"), F.bool_or((F.col("tool") == "signup") & (F.col("k") < 50)).alias("file"))
    guide = routing.guide_text(F.col("shell"), F.col("file"), "<guide>\n", _BULLETS, "</guide>")
    input_ = F.when(F.col("session_id") % 2 == 0, F.lit('{"other":"x","query":"look"}')).otherwise('{"other":"x"}')
    return active.select("session_id", guide.alias("guide"), F.get_json_object(routing.agent_prompt(input_, F.lit("G")), "$.query").alias("prompt"))
