"""Events from tool calls ``(tool, input, response)``, input being JSON, and the upkeep of sessions: ids, starts, resumes, compactions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspan.functions.text import first_line, truncated
from quillspan.operators.commands import command_events
from quillspan.operators.sessions import looks_failed

#: Tools by what their calls are events of.
FILE_ACTIONS = {"Edit": "edit", "MultiEdit": "edit", "NotebookEdit": "edit", "Write": "write", "Read": "read"}
TASK_TOOLS, AGENT_TOOLS = ("TodoWrite", "TaskCreate", "TaskUpdate"), ("Agent", "Task")
PRIORITY = {"file": 1, "task": 1, "plan": 1, "git": 2, "environment": 2, "error": 2, "skill": 3, "subagent": 3, "mcp-tool": 3}
_TODOS = "array<struct<content: string, status: string>>"


def _field(json: Column, *names: str) -> Column:
    return F.coalesce(*(F.get_json_object(json, f"$.{n}") for n in names))


def _event(when: Column, category: str, text: Column, status: Column | str | None = None) -> Column:
    status = F.lit(status).cast("string") if status is None or isinstance(status, str) else status
    row = F.struct(F.lit(category).alias("category"), F.lit(PRIORITY[category]).alias("priority"), text.cast("string").alias("text"), status.alias("status"))
    return F.when(when & text.isNotNull(), row)


def task_events(input: Column) -> Column:
    """A (category, priority, text, status) for each item of a list of todos that has content; without a list, one of the call's own description."""
    todos = F.from_json(F.get_json_object(input, "$.todos"), _TODOS)
    pending = lambda s: F.coalesce(s, F.lit("pending"))
    row = lambda text, status: F.struct(F.lit("task").alias("category"), F.lit(1).alias("priority"), text.alias("text"), pending(status).alias("status"))
    real = lambda text: F.coalesce(text, F.lit("")) != ""
    several = F.transform(F.filter(todos, lambda x: real(x["content"])), lambda x: row(x["content"], x["status"]))
    own = _field(input, "description", "content", "prompt")
    return F.when(todos.isNotNull(), several).otherwise(F.array_compact(F.array(F.when(real(own), row(truncated(own, 200), _field(input, "status"))))))


def tool_events(tool: Column, input: Column, response: Column) -> Column:
    """The events of a call, an array of (category, priority, text, status): none for a tool that says nothing of its own."""
    events = [_event(tool.isin(*[t for t, a in FILE_ACTIONS.items() if a == action]), "file", _field(input, "file_path", *["notebook_path"] * (action == "edit")), action) for action in ("edit", "write", "read")]
    events += [
        _event(tool == "EnterPlanMode", "plan", F.lit(""), "enter"),
        _event(tool == "ExitPlanMode", "plan", truncated(F.coalesce(_field(input, "plan"), F.lit("")), 600), "exit"),
        _event(tool == "Skill", "skill", _field(input, "skill")),
        _event(tool.isin(*AGENT_TOOLS), "subagent", F.coalesce(_field(input, "description"), F.lit("")), "launched"),
        _event(tool.isin(*AGENT_TOOLS) & (first_line(response) != ""), "subagent", truncated(first_line(response), 300), "finding"),
        _event(F.startswith(tool, F.lit("mcp__")), "mcp-tool", tool),
    ]
    command = F.coalesce(_field(input, "command"), F.lit(""))
    shell = F.transform(command_events(command, looks_failed(response), first_line(response)), lambda x: F.struct(x["category"].alias("category"), F.lit(2).alias("priority"), x["detail"].alias("text"), F.lit(None).cast("string").alias("status")))
    none = F.filter(F.array(events[0]), lambda x: F.lit(False))
    failed = F.array_compact(F.array(_event(looks_failed(response) & (tool != "Bash"), "error", truncated(first_line(response), 300), tool)))
    return F.concat(F.array_compact(F.array(*events)), F.when(tool.isin(*TASK_TOOLS), task_events(input)).otherwise(none), F.when(tool == "Bash", shell).otherwise(none), failed)


def session_id(transcript: Column, given: Column, pid: Column) -> Column:
    """The stem of the transcript's file name, else the id given, else one of the process."""
    name = F.element_at(F.split(transcript, "/"), -1)
    stem = F.when(name.rlike(r"^.+\.[^.]*$"), F.regexp_replace(name, r"\.[^.]*$", "")).otherwise(name)
    return F.coalesce(F.nullif(stem, F.lit("")), F.nullif(given, F.lit("")), F.concat(F.lit("pid-"), pid.cast("string")))


def compactions(events: DataFrame, is_compact: Column, by: str = "session_id") -> DataFrame:
    """Each compaction with the number of its session's compactions so far."""
    return events.where(is_compact).withColumn("compact_count", F.row_number().over(Window.partitionBy(by).orderBy("seq")))


def resumes(saved: DataFrame, consumed: DataFrame) -> DataFrame:
    """(project, session_id, seq, snapshot, consumed): the last one saved of each session, consumed if a mark ``consumed(session_id, seq)`` came after it."""
    last = saved.groupBy("project", "session_id").agg(F.max_by(F.struct("seq", "snapshot"), "seq").alias("x")).select("project", "session_id", "x.*")
    marks = consumed.groupBy("session_id").agg(F.max("seq").alias("marked"))
    return last.join(marks, "session_id", "left").select("project", "session_id", "seq", "snapshot", F.coalesce(F.col("marked") > F.col("seq"), F.lit(False)).alias("consumed"))


def claims(asking: DataFrame, held: DataFrame) -> DataFrame:
    """(project, session_id, claimed, snapshot): for each session that asks, its project's latest resume that is neither consumed nor its own.

    A project offers its two latest only, of different sessions, so a project with many sessions is not paired with itself.
    """
    free = held.where("not consumed").withColumn("n", F.row_number().over(Window.partitionBy("project").orderBy(F.desc("seq")))).where("n <= 2")
    offers = free.select("project", F.col("session_id").alias("claimed"), "snapshot", "seq")
    return asking.join(offers, "project").where("claimed <> session_id").groupBy("project", "session_id").agg(F.max_by(F.struct("claimed", "snapshot"), "seq").alias("x")).select("project", "session_id", "x.*")


def start_action(source: Column, has_events: Column, has_own: Column, has_claim: Column) -> Column:
    """What a session's start brings in: its stored resume, a snapshot of its events, one claimed from another session, the project's memory, or nothing."""
    compact = F.when(has_own, "own resume").when(has_events, "snapshot").otherwise("nothing")
    resume = F.when(has_events, "snapshot").when(has_claim, "claimed resume").otherwise("nothing")
    return F.when(source == "compact", compact).when(source == "resume", resume).when(source == "startup", "memory").otherwise("nothing")


def cleared(events: DataFrame, starts: DataFrame) -> DataFrame:
    """The events of each project since its last start ``starts(project, seq)`` that clears it."""
    last = starts.groupBy("project").agg(F.max("seq").alias("since"))
    return events.join(last, "project", "left").where(F.col("since").isNull() | (F.col("seq") > F.col("since"))).drop("since")
