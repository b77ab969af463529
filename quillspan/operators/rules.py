"""Command classification and throttling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Commands that destroy, and leads with bounded output, by what must follow them.
DESTRUCTIVE = ("rm", "dd", "mkfs", "chmod", "chown", "kill", "pkill", "truncate", "shred")
BOUNDED_WORDS = (
    "pwd", "whoami", "hostname", "uname", "id", "date", "readlink", "basename", "dirname", "realpath", "cd", "mkdir", "git status", "git rev-parse",
    "git remote", "git branch", "git config --get", "git diff --stat", "git diff --name-only", "git stash list", "git tag",
)
BOUNDED_PREFIXES = ("echo ", "printf ", "which ", "type ", "command -v ", "touch ")


def segments(command: Column) -> Column:
    """Parts of a command line between && || ; | & and line ends, trimmed."""
    return F.filter(F.transform(F.split(command, r"&&|\|\||[;|&\n]"), lambda x: F.trim(x)), lambda x: x != "")


def risk(command: Column) -> Column:
    """Block for a destructive program without --dry-run, safe for bounded output without shell operators, else warn."""
    cmd = F.trim(command)
    words = F.split(cmd, r"\s+")
    program = F.regexp_extract(F.get(words, F.lit(0)), r"([^/]*)$", 1)
    destroys = program.isin(*DESTRUCTIVE) & ~F.array_contains(words, "--dry-run")
    flag = lambda c: F.exists(words, lambda w: w.rlike(rf"^-[A-Za-z]*{c}[A-Za-z]*$"))
    first = F.get(words, F.lit(0))
    version = F.array_contains(words, "--version") | F.coalesce(F.get(words, F.lit(1)) == "-V", F.lit(False))
    bounded = cmd.rlike("^(" + "|".join(BOUNDED_WORDS) + ")( |$)") | cmd.rlike("^(" + "|".join(BOUNDED_PREFIXES) + ")") | cmd.rlike(r"^git log -[0-9]")
    quiet = F.when(first.isin("mv", "cp", "rm", "ln"), (F.size(words) >= 2) & ~flag("v") & ~cmd.contains("--verbose")).when(first == "ls", ~flag("R") & ~cmd.contains("--recursive")).otherwise(version | bounded)
    return F.when(cmd == "", "warn").when(destroys, "block").when(~cmd.rlike(r"[|;&<>$`\n\r]") & quiet, "safe").otherwise("warn")


def throttled(events: DataFrame, by: list[str], order: str = "seq") -> DataFrame:
    """Adds n (the event's number for its key) and whether it fires once, periodically (1, 11, 21, ...) or as an escalation (3, 6, 9, ...)."""
    numbered = events.withColumn("n", F.row_number().over(Window.partitionBy(*by).orderBy(order)))
    n = F.col("n")
    return numbered.withColumns({"once": n == 1, "periodic": n % 10 == 1, "escalate": (n >= 3) & ((n - 3) % 3 == 0)})
