"""Session events: extraction from prompts and commands, latest-wins, error-to-fix matching, budgeted sections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Phrases that mark a prompt, by class.
MARKERS = {
    "decision": (" instead", "don't ", "do not ", "use ", "stop ", "actually ", "rather than", "never ", "always ", "make sure"),
    "blocker": ("blocked", "waiting on", "can't ", "cannot "),
    "constraint": ("must ", "required", "constraint", "has to "),
    "role": ("you are ", "act as ", "your role"),
}
#: Words of an intent, the first intent that has one wins.
INTENTS = {
    "debug": ("fix", "bug", "error", "broken"),
    "feature": ("add", "implement", "build", "create"),
    "refactor": ("refactor", "clean", "simplify"),
    "testing": ("test",),
    "question": ("?", "explain", "how ", "what "),
}
#: Signs of a failed command.
FAILURES = ("error", "traceback", "exception", "command not found", "no such file", "failed", "panicked", "fatal:", "cannot find")
#: What a message of the system begins with.
SYSTEM_PREFIXES = ("<task-notification>", "<system-reminder>", "<context_guidance>", "<tool-result>", "<local-command", "<command-")
PRIORITIES = {"user-prompt": 1, "decision": 2, "blocker": 2, "constraint": 2, "role": 3, "intent": 4}


def _any(text: Column, words: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | text.contains(w)
    return out


def marker_classes(prompt: Column) -> Column:
    """Classes of the markers found from left to right, the longest at each place, none inside another."""
    every = sorted((w for ws in MARKERS.values() for w in ws), key=len, reverse=True)
    found = F.regexp_extract_all(F.lower(prompt), F.lit("(" + "|".join(every) + ")"), F.lit(1))
    own = lambda ws: F.arrays_overlap(found, F.array(*map(F.lit, ws)))
    return F.array_compact(F.array(*(F.when(own(ws), F.lit(k)) for k, ws in MARKERS.items())))


def intent(prompt: Column) -> Column:
    out = F.lit("general")
    for k, words in reversed(INTENTS.items()):
        out = F.when(_any(F.lower(prompt), words), k).otherwise(out)
    return out


def looks_failed(response: Column) -> Column:
    return _any(F.lower(response), FAILURES)


def is_system_message(prompt: Column) -> Column:
    shown = F.regexp_replace(prompt, r"^\s+", "")
    out = F.lit(False)
    for prefix in SYSTEM_PREFIXES:
        out = out | shown.startswith(prefix)
    return out


def references(prompt: Column, n: int = 5) -> Column:
    """URLs and #numbers of a prompt, the first n."""
    words = F.transform(F.split(prompt, r"\s+"), lambda w: F.regexp_replace(w, r"[.,;:)\]}>]+$", ""))
    return F.slice(F.filter(words, lambda w: w.rlike(r"^https?://") | w.rlike(r"^#[0-9]+$")), 1, n)


def prompt_events(prompts: DataFrame) -> DataFrame:
    """Rows (…, category, priority): one for the prompt, one for its intent, one for each class of marker."""
    categories = F.concat(F.array(F.lit("user-prompt")), marker_classes(F.col("prompt")), F.array(F.lit("intent")))
    rows = prompts.withColumn("category", F.explode(categories))
    priority = F.element_at(F.create_map(*(F.lit(x) for kv in PRIORITIES.items() for x in kv)), F.col("category"))
    return rows.withColumn("priority", priority)


def latest_wins(events: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last event of each key; events without a key all stay."""
    best = Window.partitionBy(key).orderBy(*(F.desc(c) for c in order))
    keyed = events.where(F.col(key).isNotNull()).withColumn("_n", F.row_number().over(best)).where("_n = 1").drop("_n")
    return keyed.unionByName(events.where(F.col(key).isNull()))


def recent_distinct(events: DataFrame, by: str, value: str, n: int) -> DataFrame:
    """The last place of each value, the n most recent values of each ``by``."""
    last = events.groupBy(by, value).agg(F.max("seq").alias("seq"))
    return last.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(F.desc("seq")))).where(F.col("rank") <= n)


def error_fixes(events: DataFrame, is_error: Column, is_fix: Column, by: str = "session_id") -> DataFrame:
    """Each error and the seq of the first fix behind it, null while there is none. One sort per session, no self-join."""
    after = Window.partitionBy(by).orderBy("seq").rowsBetween(1, Window.unboundedFollowing)
    return events.withColumn("fixed_by", F.min(F.when(is_fix, F.col("seq"))).over(after)).where(is_error).select(by, F.col("seq").alias("error_seq"), "fixed_by")


def within_budget(sections: DataFrame, budget: int, by: str = "session_id") -> DataFrame:
    """Sections (by, idx, must, rank, text) that fit: must-keep ones always, then by rank down; of equal ranks the earliest is dropped first."""
    size = F.octet_length("text") + 1
    fixed = F.sum(F.when(F.col("must"), size).otherwise(0)).over(Window.partitionBy(by))
    order = Window.partitionBy(by).orderBy(F.desc("must"), F.desc("rank"), F.desc("idx")).rowsBetween(Window.unboundedPreceding, 0)
    counted = sections.withColumns({"bytes": F.sum(size).over(order), "fixed": fixed})
    return counted.where(F.col("must") | (F.greatest("bytes", "fixed") <= budget))
