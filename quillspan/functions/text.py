"""Text scalars as Catalyst expressions: chunking, tokens, names, snippets, previews, formatting. Nulls give nulls unless said otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Keywords before a defined name (fixed values).
DEFINITION_WORDS = ("fn", "func", "function", "def", "class", "struct", "enum", "trait", "interface", "impl", "type", "mod", "module", "const", "let")
CHUNK_LINES = 100


def lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def line_chunks(text: Column, size: int = CHUNK_LINES) -> Column:
    """Windows of ``size`` lines, joined again."""
    ls = lines(text)
    return F.transform(F.sequence(F.lit(0), F.size(ls) - 1, F.lit(size)), lambda i: F.array_join(F.slice(ls, i + 1, size), "\n"))


def heading_chunks(text: Column) -> Column:
    """Parts of a Markdown text: a new one at each line that starts with #, if the part before is not blank."""
    step = lambda done, line: F.when(
        line.startswith("#") & (F.trim(F.element_at(done, -1)) != ""), F.concat(done, F.array(line))
    ).otherwise(F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.when(F.element_at(done, -1) == "", line).otherwise(F.concat(F.element_at(done, -1), F.lit("\n"), line)))))
    return F.aggregate(lines(text), F.array(F.lit("")), step)


def tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda x: x != "")


def subwords(name: Column) -> Column:
    """Parts of a camel-case, Pascal-case or acronym name, of two letters at least; none where the name has no such boundary."""
    parts = F.split(F.regexp_replace(name, r"(?<=[\p{Ll}0-9])(?=\p{Lu})|(?<=\p{Lu})(?=\p{Lu}\p{Ll})|(?<=\p{L})(?=[0-9])|(?<=[0-9])(?=\p{L})", "\u0001"), "\u0001")
    has = name.rlike(r"\p{Ll}\p{Lu}|\p{Lu}\p{Lu}\p{Ll}")
    return F.when(has, F.filter(parts, lambda x: F.length(x) > 1)).otherwise(F.array().cast("array<string>"))


def identifier_tokens(name: Column) -> Column:
    return F.filter(F.split(F.lower(F.regexp_replace(name, r"(?<=[\p{Ll}0-9])(?=\p{Lu})", "_")), r"[^\p{L}\p{N}]+"), lambda x: x != "")


def defined_names(text: Column) -> Column:
    pattern = r"\b(?:" + "|".join(DEFINITION_WORDS) + r")\s+([A-Za-z_][A-Za-z0-9_]*)"
    return F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), F.lit(1))))


def symbols(text: Column) -> Column:
    """The names a chunk defines and their subwords, without repeats, in one string."""
    names = defined_names(text)
    return F.array_join(F.array_distinct(F.concat(names, F.flatten(F.transform(names, subwords)))), " ")


def trigrams(text: Column) -> Column:
    """Runs of three characters, in lower case; the characters are taken apart once, so the work is linear in the text."""
    at = lambda c, i: F.get(c, i)
    runs = lambda c: F.when(F.size(c) >= 3, F.transform(F.sequence(F.lit(0), F.size(c) - 3), lambda i: F.concat(at(c, i), at(c, i + 1), at(c, i + 2)))).otherwise(F.array().cast("array<string>"))
    characters = F.filter(F.split(F.lower(text), ""), lambda x: x != "")
    return F.element_at(F.transform(F.array(characters), runs), 1)


def is_literal_query(query: Column) -> Column:
    """One token without white space that has a character besides letters, digits and _."""
    return query.rlike(r"^\S+$") & query.rlike(r"[^\p{L}\p{N}_]")


def is_doc_path(path: Column) -> Column:
    return F.lower(path).rlike(r"\.(md|markdown)$")


def occurrences(text: Column, needle: str) -> Column:
    """How often the needle occurs, without overlap and without regard to case."""
    low, n = F.lower(text), needle.lower()
    return ((F.length(low) - F.length(F.replace(low, F.lit(n), F.lit("")))) / len(n)).cast("long")


def first_line_with(text: Column, needle: str, width: int = 120) -> Column:
    """The first line that holds the needle, as it is cased, trimmed and cut; empty if none does."""
    found = F.filter(lines(text), lambda x: x.contains(needle))
    return F.coalesce(F.substring(F.trim(F.get(found, F.lit(0))), 1, width), F.lit(""))


def first_line(text: Column) -> Column:
    return F.coalesce(F.get(F.filter(F.transform(lines(text), lambda x: F.trim(x)), lambda x: x != ""), F.lit(0)), F.lit(""))


def truncated(text: Column, n: int) -> Column:
    one = F.replace(text, F.lit("\n"), F.lit(" "))
    return F.when(F.length(one) > n, F.concat(F.substring(one, 1, n), F.lit("…"))).otherwise(one)


def preview(text: Column, limit: int = 8192, side: int = 2048) -> Column:
    """Head and tail of a text over ``limit`` bytes, ``side`` bytes each at most and cut between characters, with the number of bytes left out."""
    raw, n = text.cast("binary"), F.octet_length(text)
    inside = lambda at: F.hex(F.substring(raw, at, F.lit(1))).rlike("^[89AB]")  # noqa: E731  a byte that continues a character
    head, tail = F.lit(side - 3), n - side + 4
    for k in (2, 1, 0):
        head = F.when(~inside(F.lit(side - k + 1)), side - k).otherwise(head)
        tail = F.when(~inside(n - side + 1 + k), n - side + 1 + k).otherwise(tail)
    part = lambda start, length: F.substring(raw, start, length).cast("string")
    note = F.concat(F.lit("\n... ["), (tail - 1 - head).cast("string"), F.lit(" bytes omitted] ...\n"))
    return F.when(n > limit, F.concat(part(F.lit(1), head), note, part(tail, n - tail + 1))).otherwise(text)


def snippet(text: Column, terms: Column, width: int = 24, before: int = 4) -> Column:
    """``width`` words from ``before`` words ahead of the first that contains a term; matching words are bracketed, cuts are marked."""
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    match = lambda w: F.exists(terms, lambda t: F.contains(F.lower(w), t))
    hits = F.transform(words, match)
    first = F.greatest(F.array_position(hits, True) - 1 - before, F.lit(0)).cast("int")
    shown = F.transform(F.slice(words, first + 1, width), lambda w: F.when(match(w), F.concat(F.lit("["), w, F.lit("]"))).otherwise(w))
    return F.concat(F.when(first > 0, "… ").otherwise(""), F.array_join(shown, " "), F.when(first + width < F.size(words), " …").otherwise(""))


def human_bytes(n: Column) -> Column:
    out = F.format_string("%.1f TB", n / float(1 << 40))
    for unit, size in (("GB", 30), ("MB", 20), ("KB", 10)):
        out = F.when(n < 1 << size + 10, F.format_string(f"%.1f {unit}", n / float(1 << size))).otherwise(out)
    return F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B"))).otherwise(out)


def human_count(n: Column) -> Column:
    return F.when(n >= 1_000_000, F.format_string("%.1fM", n / 1e6)).when(n >= 1000, F.format_string("%.1fK", n / 1e3)).otherwise(n.cast("string"))


def human_money(dollars: Column) -> Column:
    """Two places from a dollar on, three from a cent on, else four."""
    return F.when(dollars >= 1, F.format_string("$%.2f", dollars)).when(dollars >= 0.01, F.format_string("$%.3f", dollars)).otherwise(F.format_string("$%.4f", dollars))


def human_time(seconds: Column) -> Column:
    return F.when(seconds < 90, F.format_string("~%.0fs", seconds)).when(seconds < 5400, F.format_string("~%.1f min", seconds / 60)).otherwise(F.format_string("~%.1f h", seconds / 3600))


def human_duration(seconds: Column) -> Column:
    """Whole days or hours, else minutes, one at least."""
    of = lambda size, unit: F.concat(F.floor(seconds / size).cast("string"), F.lit(unit))
    minutes = F.concat(F.floor(F.greatest(seconds, F.lit(60)) / 60).cast("string"), F.lit("m"))
    return F.when((seconds >= 86400) & (seconds % 86400 == 0), of(86400, "d")).when((seconds >= 3600) & (seconds % 3600 == 0), of(3600, "h")).otherwise(minutes)


def duration_seconds(spec: Column) -> Column:
    """Seconds of a duration such as 45s, 15m, 3h or 2d; null for anything else."""
    size = F.when(spec.endswith("s"), 1).when(spec.endswith("m"), 60).when(spec.endswith("h"), 3600).otherwise(86400)
    return F.when(spec.rlike("^[0-9]{1,15}[smhd]$"), F.regexp_extract(spec, "^[0-9]+", 0).cast("long") * size)


def window_start(spec: Column, now: Column, offset: Column | None = None) -> Column:
    """Where the window ``all`` (null), ``today`` (local midnight; ``offset`` is the zone's seconds) or a duration before ``now`` begins, in seconds."""
    local = now + (F.lit(0) if offset is None else offset)
    word = F.trim(spec)
    return F.when(word == "today", now - F.pmod(local, F.lit(86400))).when(word != "all", now - duration_seconds(word))


def iso_time(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def parsed_time(text: Column) -> Column:
    """The time that an ISO-8601 text with milliseconds and Z spells; null for other texts."""
    return F.try_to_timestamp(text, F.lit("yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"))


def micros(ts: str | Column) -> Column:
    """Microseconds since 1970 of a timestamp, with or without a time zone, as it reads in the session's zone."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), (F.col(ts) if isinstance(ts, str) else ts).cast("timestamp_ntz"))


def saved_tokens(raw: Column, returned: Column) -> Column:
    """Four bytes a token, rounded down record by record."""
    return F.floor(F.greatest(raw - returned, F.lit(0)) / 4).cast("long")


def path_matches(path: Column, suffix: Column) -> Column:
    """Either path ends with the other at a / boundary."""
    a, b = F.replace(path, F.lit("\\"), F.lit("/")), F.replace(suffix, F.lit("\\"), F.lit("/"))
    return (a == b) | F.endswith(a, F.concat(F.lit("/"), b)) | F.endswith(b, F.concat(F.lit("/"), a))


def last_segment(name: Column) -> Column:
    return F.element_at(F.filter(F.split(name, r"[.:]+"), lambda x: x != ""), -1)


def flattened(payload: Column) -> Column:
    """``key: value`` pairs of a JSON object of scalars, joined by bars, by key."""
    pairs = F.array_sort(F.map_entries(F.from_json(payload, "map<string,string>")))
    return F.array_join(F.transform(pairs, lambda e: F.concat(e["key"], F.lit(": "), e["value"])), " | ")


#: Words of an import statement that name nothing.
IMPORT_WORDS = ("use", "pub", "import", "from", "as", "crate", "self", "super", "mod", "require")


def import_targets(statement: Column) -> Column:
    """The names that an import statement brings: the last name of each member of a group in braces, else the last of all."""
    last = lambda part: F.try_element_at(F.filter(F.split(part, r"[^\p{L}\p{N}_]+"), lambda x: (x != "") & ~x.isin(*IMPORT_WORDS)), F.lit(-1))
    group = F.array_compact(F.transform(F.split(F.regexp_extract(statement, r"(?s)\{(.*)\}", 1), ","), last))
    return F.when(statement.rlike(r"(?s)\{.*\}") & (F.size(group) > 0), group).otherwise(F.array_compact(F.array(last(statement))))


def percent_decoded(text: Column) -> Column:
    """%XX escapes as UTF-8; a plus stays a plus. Null where an escape is not whole."""
    return F.try_url_decode(F.replace(text, F.lit("+"), F.lit("%2B")))


def query_parameter(url: Column, name: str) -> Column:
    """The decoded value of the first parameter of that name; null if there is none."""
    value = F.regexp_extract(F.regexp_extract(url, r"\?([^#]*)", 1), rf"(?:^|&){name}=([^&]*)", 1)
    return F.when(F.regexp_extract(url, r"\?([^#]*)", 1).rlike(rf"(?:^|&){name}="), percent_decoded(value))


def shell_unescaped(path: Column) -> Column:
    """Blanks that a backslash protects, without it."""
    return F.replace(path, F.lit("\\ "), F.lit(" "))


def as_predicate(answer: Column) -> Column:
    """True or false of a yes/no word, else null."""
    word = F.lower(F.trim(answer))
    return F.when(word.isin("yes", "true", "y"), True).when(word.isin("no", "false", "n"), False)


def answer_matches(answer: Column, truth: Column, check: str, tolerance: float = 0.0) -> Column:
    """Whether an answer agrees with the truth: ``exact`` (numbers as numbers, yes/no words alike, else the words in any case), ``contains`` or ``numeric``. Null answers do not."""
    number = lambda x: F.trim(x).try_cast("double")
    both = as_predicate(answer) == as_predicate(truth)
    if check == "numeric":
        agrees = F.abs(number(answer) - number(truth)) <= tolerance
    elif check == "contains":
        agrees = F.coalesce(both, F.contains(F.lower(answer), F.lower(truth)))
    else:
        agrees = F.when(number(truth).isNotNull(), F.abs(number(answer) - number(truth)) < 2.220446049250313e-16).otherwise(F.coalesce(both, F.lower(F.trim(answer)) == F.lower(F.trim(truth))))
    return F.coalesce(agrees, F.lit(False))
