"""Shell command rules as Catalyst expressions: what a line may be wrapped, what it changes, what it fetches, which events it makes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillspan.operators.rules import segments

#: Programs that only read, subcommands that do, builtins that change the shell, build tools, interpreters, git operations.
READERS = (
    "find", "cat", "ls", "tree", "rg", "grep", "egrep", "fgrep", "tail", "head", "wc", "sort", "uniq", "nl", "curl", "wget",
    "gradle", "gradlew", "mvn", "sbt", "pytest", "jest", "vitest",
)
PACKAGE_SUBCOMMANDS = ("test", "run", "build", "ci", "audit", "outdated", "list", "ls")
SUBCOMMANDS = {
    "git": ("log", "diff", "show", "status", "blame", "shortlog", "reflog", "whatchanged", "ls-files", "ls-tree", "rev-parse", "describe", "grep"),
    "cargo": ("test", "build", "check", "clippy", "bench", "tree", "doc"),
    "go": ("test", "build", "vet", "list"),
    "npm": PACKAGE_SUBCOMMANDS,
    "yarn": PACKAGE_SUBCOMMANDS,
    "pnpm": PACKAGE_SUBCOMMANDS,
}
BUILTINS = ("cd", "export", "source", ".", "alias", "unalias", "set", "unset", "pushd", "popd", "eval", "trap")
BUILD_TOOLS = ("gradle", "gradlew", "mvn", "mvnw", "sbt")
INTERPRETERS = ("python", "python3", "node", "ruby", "deno", "bun", "php", "perl")
GIT_OPERATIONS = ("commit", "checkout", "merge", "rebase", "push", "pull", "status", "branch", "stash")
ENVIRONMENT = ("activate", "npm install", "pip install", "cargo add", "worktree", "export ")


def word(text: Column, i: int) -> Column:
    """The word of that number, empty past the end."""
    return F.coalesce(F.get(F.split(F.trim(text), r"\s+"), F.lit(i)), F.lit(""))


def program(segment: Column) -> Column:
    return F.regexp_extract(word(segment, 0), r"([^/]*)$", 1)


def any_of(text: Column, parts: tuple[str, ...]) -> Column:
    return reduce(Column.__or__, [F.contains(text, F.lit(p)) for p in parts])


def wrappable(command: Column) -> Column:
    """Every part of the line only reads, and there is one."""
    def reads(segment: Column) -> Column:
        out = program(segment).isin(*READERS)
        for name, subs in SUBCOMMANDS.items():
            out = F.when(program(segment) == name, word(segment, 1).isin(*subs)).otherwise(out)
        return out

    return (F.size(segments(command)) > 0) & F.forall(segments(command), reads)


def stateful(command: Column) -> Column:
    """A backtick, a builtin that changes the shell, an assignment or a function definition."""
    changes = lambda x: word(x, 0).isin(*BUILTINS) | word(x, 0).rlike(r"^[A-Za-z_][A-Za-z0-9_]*=") | x.rlike(r"^[A-Za-z0-9_]+\s*\(\s*\)")
    return command.contains("`") | F.exists(segments(command), changes)


def redirect(command: Column) -> Column:
    """network: a fetch that prints its body, or an interpreter's one-line request; build: a build tool; null: neither. The first part decides."""
    def kind(x: Column) -> Column:
        to_file = any_of(x, (" -o ", " --output ", " -O ", " --output-document ", ">"))
        back = any_of(x, (" -o -", " -O -", "/dev/stdout"))
        return F.when(program(x).isin("curl", "wget") & (~to_file | back), "network").when(program(x).isin(*BUILD_TOOLS), "build")

    request = (command.contains("fetch(") & command.rlike("https?://")) | any_of(command, ("requests.get(", "requests.post(", "requests.put(", "http.get(", "http.request("))
    first = F.get(F.filter(F.transform(segments(command), kind), lambda k: k.isNotNull()), F.lit(0))
    return F.coalesce(first, F.when(program(command).isin(*INTERPRETERS) & request, "network"))


def external_tool(tool: Column, own: str) -> Column:
    """A tool ``mcp__server__name`` of another server than one's own."""
    server = F.regexp_extract(tool, r"^mcp__(.*?)(?:__|$)", 1)
    return (server != "") & ~server.contains(own)


def command_events(command: Column, failed: Column, message: Column) -> Column:
    """Array of (category, detail): a git operation, a change of the environment, an error with the first line of what was said."""
    low = F.lower(command)
    operation = F.lit("other")
    for op in reversed(GIT_OPERATIONS):
        operation = F.when(low.contains(op), op).otherwise(operation)
    event = lambda when, category, detail: F.when(when, F.struct(F.lit(category).alias("category"), detail.alias("detail")))
    found = [event(word(command, 0) == "git", "git", operation), event(low.startswith("cd ") | any_of(low, ENVIRONMENT), "environment", F.substring(command, 1, 200)), event(failed, "error", F.substring(message, 1, 300))]
    return F.filter(F.array(*found), lambda x: x.isNotNull())
