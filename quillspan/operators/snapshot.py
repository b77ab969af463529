"""A session's guide: seventeen sections out of its events ``(session_id, seq, category, text, status)``, kept within a budget of bytes.

Each section is an aggregation by session; a section holds a fixed number of lines at most, so nothing grows with a session.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspan.functions.text import truncated
from quillspan.operators.sessions import error_fixes, within_budget
from quillspan.sources.stored import stored

MUST = 255
BUDGET = 8192
#: Sections in order, with the category they are of, how their lines come about, how many, and their rank.
SECTIONS = (
    ("Last Request", "user-prompt", "last", 500, MUST),
    ("Tasks", "task", "tasks", 20, MUST),
    ("Plans", "plan", "plans", 5, 50),
    ("Key Decisions", "decision", "distinct", 8, MUST),
    ("Files Modified", "file", "changed", 15, MUST),
    ("Unresolved Errors", "error", "errors", 6, MUST),
    ("Constraints", "constraint", "distinct", 5, 60),
    ("Blockers", "blocker", "distinct", 5, 60),
    ("Git ops", "git", "distinct", 8, 40),
    ("Project Rules", "rule", "distinct", 6, MUST),
    ("MCP Tools Used", "mcp-tool", "counts", 0, 20),
    ("Subagent findings", "subagent", "findings", 4, 20),
    ("Rejected Approaches", "rejected-approach", "distinct", 5, 55),
    ("External Refs", "external-ref", "distinct", 8, 15),
    ("Environment", "environment", "distinct", 5, 45),
    ("User Role", "role", "last", 200, 30),
    ("Session Intent", "intent", "most", 1, 10),
)
FIXED_SHOWN = 4
_LINE = ["session_id", "place", "line"]


def _distinct(events: DataFrame, line: Column, most: int) -> DataFrame:
    """The last occurrence of each line, the most recent ``most``, in order."""
    last = events.select("session_id", "seq", line.alias("line")).where("line is not null").groupBy("session_id", "line").agg(F.max("seq").alias("place"))
    return last.withColumn("n", F.row_number().over(Window.partitionBy("session_id").orderBy(F.desc("place"), "line"))).where(F.col("n") <= most).select(_LINE)


def _counts(events: DataFrame, most: int | None) -> DataFrame:
    counted = events.where("text is not null").groupBy("session_id", "text").agg(F.count("*").alias("n"))
    placed = counted.withColumn("place", F.row_number().over(Window.partitionBy("session_id").orderBy(F.desc("n"), "text")).cast("long"))
    shown = F.concat("text", F.lit(" ×"), F.col("n").cast("string")) if most is None else F.col("text")
    return (placed if most is None else placed.where(F.col("place") <= most)).select("session_id", "place", shown.alias("line"))


def _tasks(events: DataFrame, most: int) -> DataFrame:
    each = events.groupBy("session_id", "text").agg(F.max_by("status", "seq").alias("status"), F.min("seq").alias("place"))
    few = each.withColumn("n", F.row_number().over(Window.partitionBy("session_id").orderBy("place", "text"))).where(F.col("n") <= most)
    box = F.when(F.col("status").isin("completed", "done"), "[x]").when(F.col("status") == "in_progress", "[~]").otherwise("[ ]")
    return few.select("session_id", "place", F.concat(box, F.lit(" "), truncated(F.col("text"), 120), F.lit(" ("), "status", F.lit(")")).alias("line"))


def _errors(events: DataFrame, most: int) -> DataFrame:
    """Errors that nothing has mended since, then errors with the change that came next."""
    changed = (F.col("category") == "file") & F.col("status").isin("edit", "write")
    committed = (F.col("category") == "git") & (F.col("status") == "commit")
    fixes = error_fixes(events, F.col("category") == "error", changed | committed)
    said = events.where("category = 'error'").select("session_id", F.col("seq").alias("error_seq"), F.coalesce("text", F.lit("error")).alias("message"))
    what = events.where(changed | committed).select("session_id", F.col("seq").alias("fixed_by"), F.when(changed, F.concat(F.lit("edited "), "text")).otherwise("git commit").alias("fix"))
    pairs = fixes.join(said, ["session_id", "error_seq"]).join(what, ["session_id", "fixed_by"], "left").withColumn("open", F.col("fixed_by").isNull())
    few = pairs.withColumn("n", F.row_number().over(Window.partitionBy("session_id", "open").orderBy("error_seq"))).where((F.col("open") & (F.col("n") <= most)) | (~F.col("open") & (F.col("n") <= FIXED_SHOWN)))
    line = F.when(F.col("open"), F.concat(F.lit("UNRESOLVED: "), truncated(F.col("message"), 200))).otherwise(F.concat(F.lit("fixed: "), truncated(F.col("message"), 120), F.lit(" → "), truncated(F.col("fix"), 120)))
    return few.select("session_id", (F.when(F.col("open"), 0).otherwise(most) + F.col("n")).cast("long").alias("place"), line.alias("line"))


def _lines(events: DataFrame, category: str, how: str, most: int) -> DataFrame:
    own = events.where(F.col("category") == category)
    text = F.col("text")
    if how == "last":
        return own.where(text.isNotNull()).groupBy("session_id").agg(F.max_by(truncated(text, most), "seq").alias("line")).select("session_id", F.lit(0).cast("long").alias("place"), "line")
    if how == "tasks":
        return _tasks(own, most)
    if how == "errors":
        return _errors(events, most)
    if how in ("counts", "most"):
        return _counts(own, most if how == "most" else None)
    if how == "plans":
        plan = F.when((F.col("status") == "exit") & (text != ""), F.concat(F.lit("plan: "), truncated(text, 240))).otherwise(F.concat(F.lit("plan "), "status"))
        return _distinct(own, plan, most)
    if how == "changed":
        own = own.where(F.col("status").isin("edit", "write"))
    if how == "findings":
        own = own.where("status = 'finding'")
    return _distinct(own, F.concat("status", F.lit(": "), truncated(text, 100)) if category == "git" else text, most)


def sections(events: DataFrame) -> DataFrame:
    """(session_id, idx, must, rank, text) of every section that has lines."""
    events = stored(events.select("session_id", "seq", "category", "text", "status"))  # read once, by every section
    lines = None
    for i, (_, category, how, most, _) in enumerate(SECTIONS):
        one = _lines(events, category, how, most).withColumn("idx", F.lit(i))
        lines = one if lines is None else lines.unionByName(one)
    held = lines.groupBy("session_id", "idx").agg(F.array_sort(F.collect_list(F.struct("place", "line"))).alias("x"))
    titles, ranks = (F.array(*(F.lit(s[k]) for s in SECTIONS)) for k in (0, 4))
    rank = F.get(ranks, F.col("idx"))
    body = F.array_join(F.transform("x", lambda e: F.concat(F.lit("- "), e["line"], F.lit("\n"))), "")
    return held.select("session_id", "idx", (rank == MUST).alias("must"), rank.alias("rank"), F.concat(F.lit("## "), F.get(titles, F.col("idx")), F.lit("\n"), body).alias("text"))


def guide(events: DataFrame, budget: int = BUDGET, compactions: DataFrame | None = None) -> DataFrame:
    """(session_id, guide): the header and what sections fit the budget, in order. Those that must stay do; of the others the lowest rank goes first."""
    header = F.lit("# Session Guide\n")
    made = sections(events)
    if compactions is None:
        made = made.withColumn("header", header)
    else:
        counted = compactions.groupBy("session_id").agg(F.max("compact_count").alias("n"))
        said = F.concat(F.lit("# Session Guide (resumed after "), F.col("n").cast("string"), F.lit(" compaction(s))\n"))
        made = made.join(counted, "session_id", "left").withColumn("header", F.when(F.col("n") > 0, said).otherwise(header)).drop("n")
    # the header counts as a section that must stay
    top = made.select("session_id", "header").distinct().select("session_id", F.lit(-1).alias("idx"), F.lit(True).alias("must"), F.lit(MUST + 1).alias("rank"), F.regexp_replace("header", "\n$", "").alias("text"))
    kept = within_budget(top.unionByName(made.drop("header")), budget)
    texts = F.array_sort(F.collect_list(F.struct("idx", "text")))
    return kept.groupBy("session_id").agg(F.array_join(F.transform(texts, lambda x: F.when(x["idx"] < 0, F.concat(x["text"], F.lit("\n"))).otherwise(F.concat(F.lit("\n"), x["text"]))), "").alias("guide"))
