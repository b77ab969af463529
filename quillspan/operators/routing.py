"""What becomes of a tool call, by the level of routing: passed through, denied, modified, or answered with a hint."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspan.operators.commands import external_tool, redirect, stateful, wrappable
from quillspan.operators.extract import LANGUAGES
from quillspan.operators.rules import risk

#: Levels, and the fields a sub-agent's instructions come under, in order.
LEVELS = ("off", "nudge", "steer", "wrap", "full")
PROMPT_FIELDS = ("prompt", "request", "objective", "question", "query", "task")
#: Reads of code files from which on, and how often then, the hint is about the graph; calls of other servers' tools a hint.
CODE_READS, CODE_PERIOD, EXTERNAL_PERIOD, FLOOD_BYTES = 3, 3, 10, 16384


def level(spec: Column) -> Column:
    """The level that a setting names: full if unset, off if unknown."""
    word = F.lower(F.trim(spec))
    return F.when(spec.isNull(), "full").when(word.isin(*LEVELS), word).otherwise("off")


def steers(lvl: Column) -> Column:
    return lvl.isin("steer", "full")


def nudges(lvl: Column) -> Column:
    return lvl.isin("nudge", "steer", "full")


def wraps(lvl: Column) -> Column:
    return lvl.isin("wrap", "full")


def routed(calls: DataFrame, own_server: str, order: str = "seq") -> DataFrame:
    """``calls(session_id, seq, tool, command, path, prompt, level, ready)`` with the decision and the key of its hint or reason.

    A hint is given once a session and key, or periodically; the calls that could give it are numbered in order, one window a session.
    What redirects to a server's tool does so only where the server is ready.
    """
    lvl, tool = F.col("level"), F.col("tool")
    code = F.lower(F.regexp_extract("path", r"\.([A-Za-z]+)$", 1)).isin(*LANGUAGES)
    to = redirect(F.col("command"))
    shell = (tool == "Bash") & (F.coalesce("command", F.lit("")) != "") & ~stateful(F.col("command"))
    sent = shell & steers(lvl) & to.isNotNull()
    output = shell & ~sent & (risk(F.col("command")) != "safe") & wrappable(F.col("command"))
    named = calls.withColumns({
        "_code": F.coalesce((tool == "Read") & code & nudges(lvl), F.lit(False)),
        "_key": F.when((tool == "Grep") & nudges(lvl), "grep").when(output & ~wraps(lvl) & nudges(lvl), "bash").when(F.coalesce(external_tool(tool, own_server), F.lit(False)) & nudges(lvl), "external"),
    })
    so_far = Window.partitionBy("session_id").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    numbered = named.withColumns({"_reads": F.sum(F.col("_code").cast("long")).over(so_far), "_n": F.row_number().over(Window.partitionBy("session_id", "_key").orderBy(order))})
    graph = F.col("_code") & (F.col("_reads") >= CODE_READS) & ((F.col("_reads") - CODE_READS) % CODE_PERIOD == 0)
    # the first read that is not about the graph gives the general hint
    plain = (tool == "Read") & nudges(lvl) & ~graph
    numbered = numbered.withColumns({"_graph": graph, "_plain": F.sum(plain.cast("long")).over(so_far), "_is_plain": plain})
    hint = (
        F.when(F.col("_graph"), "read-graph")
        .when(F.col("_is_plain") & (F.col("_plain") == 1), "read")
        .when(F.col("_key").isin("grep", "bash") & (F.col("_n") == 1), F.col("_key"))
        .when((F.col("_key") == "external") & (F.col("_n") % EXTERNAL_PERIOD == 1), "external")
    )
    agent = tool.isin("Agent", "Task") & nudges(lvl) & F.col("prompt").isNotNull()
    reason = F.when((tool == "WebFetch") & steers(lvl) & F.col("ready"), "fetch").when(sent & F.col("ready"), to).when(output & wraps(lvl), "wrap").when(agent, "agent").otherwise(hint)
    decision = F.when(reason == "fetch", "deny").when(reason.isin("network", "build", "wrap", "agent"), "modify").when(reason.isNotNull(), "context").otherwise("passthrough")
    off = lvl == "off"
    return numbered.withColumns({"reason": F.when(~off, reason), "decision": F.when(off, "passthrough").otherwise(decision)}).drop("_code", "_key", "_reads", "_n", "_graph", "_plain", "_is_plain")


def agent_prompt(input: Column, guide: Column) -> Column:
    """The call's JSON input with the guide behind the instructions, under the first field that holds them; unchanged without one."""
    fields = F.from_json(input, "map<string,string>")

    def with_guide(field: str) -> Column:
        others = F.map_filter(fields, lambda k, v: k != field)
        return F.to_json(F.map_concat(others, F.create_map(F.lit(field), F.concat(F.get_json_object(input, f"$.{field}"), F.lit("\n\n"), guide))))

    out = input
    for field in reversed(PROMPT_FIELDS):
        out = F.when(F.get_json_object(input, f"$.{field}").isNotNull(), with_guide(field)).otherwise(out)
    return out


def guide_text(shell: Column, file: Column, head: str, bullets: dict[str, str], tail: str) -> Column:
    """The guide with the hints of the groups of tools that are in use (of all, where none is): ``bullets`` has shell, read, search and fetch, the last always given."""
    none = ~shell & ~file
    part = lambda when, key: F.when(when, bullets[key]).otherwise("")
    return F.concat(F.lit(head), part(shell | none, "shell"), part(file | none, "read"), part(file | none, "search"), F.lit(bullets["fetch"] + tail))
