"""Quality rules judged by document and by host.

Each text is measured once. Its own rules reject it alone; in addition, failures are added up by host, each host's rate is
shrunk towards the rate of all hosts by a beta prior fitted to the hosts themselves (so a host of few documents says little),
and a host whose shrunk rate of any rule is over ``worst_rate`` takes its documents with it.

Words are runs of characters other than space and \\x09-\\x0D. Null text has no words and fails; empty text too. A null host
is no host: its documents are judged alone. Repeated rows are measured and counted each. Columns of the input that have the
name of a measure or verdict are replaced by it in ``judge``; ``keep_documents`` returns the input's columns as they are. An
empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspan.llm.common import WORD_GAP_CHARS, read, spare, stored, tidied

SYMBOLS = "#*$%&|<>"
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
#: A host goes if it fails a rule in more than this part of its documents, after shrinking.
WORST_RATE = 0.75
_RESULTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "host_failed", "kept")
MEASURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


def measure_text(text: str) -> tuple[int, int, int, int, int]:
    raw = text.encode()
    words = raw.split()
    n = len(words)
    chars = len(text) - sum(map(text.count, WORD_GAP_CHARS))
    symbols = sum(map(text.count, SYMBOLS))
    lines = raw.split(b"\n")
    dup = 0
    if len(set(lines)) < len(lines):
        seen: set[bytes] = set()
        for x in lines:
            if x in seen:
                dup += bool(x.split())
            seen.add(x)
    repeat = 0
    if n > 3:
        number: dict[bytes, int] = {}
        ids = [number.setdefault(w, len(number)) for w in words]
        k = len(number)
        if k < n:
            windows = [(a * k + b) * k + c for a, b, c in zip(ids, ids[1:], ids[2:])]
            if len(set(windows)) < len(windows):
                times = Counter(windows)
                last = -1
                for i, x in enumerate(windows):
                    if times[x] > 1:
                        repeat += i + 3 - max(i, last)
                        last = i + 3
    return n, chars, symbols, dup, repeat


def measure(docs: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
    """The columns ``keep`` of the documents, then their measures; a pass over the texts, without a shuffle. A text that is kept is sent to Python once."""
    keep = [c for c in keep if c not in {x.split()[0] for x in MEASURES.split(", ")}]
    kept = docs.select(*keep)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema), MEASURES])
    names = [*keep, *(x.split()[0] for x in MEASURES.split(", "))]

    at = keep.index(text_col) if text_col in keep else len(keep)

    @tidied
    def of(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [measure_text(t.as_py() or "") for t in batch.column(at)]
            columns = zip(*found) if found else [[]] * 5
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *(pa.array(list(c), pa.int64()) for c in columns)], names)

    return (kept if text_col in keep else docs.select(*keep, F.col(text_col).alias(spare(keep, "text")))).mapInArrow(of, schema)


def rules() -> dict[str, Column]:
    """Failures by rule. The first two reject a document by themselves; all of them count for its host."""
    n = F.col("n_words")
    return {
        "few_words": n < MIN_WORDS,
        "repeats": 100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * n,
        "symbols": 10 * F.col("n_symbols") > n,
        "odd_words": (F.col("word_chars") < 2 * n) | (F.col("word_chars") > 15 * n),
    }


OWN_RULES = ("few_words", "repeats")


def host_verdicts(measured: DataFrame, host_col: str, worst_rate: float = WORST_RATE) -> DataFrame:
    """(host, n_docs, shrunk rate of each rule, host_failed) of every host that is not null.

    The prior of a rule has the mean m of all documents and the strength m(1-m)/t - 1, with t the variance between hosts left
    when the binomial variance within them is taken off (an analysis of variance); strength is held between 1 and 10^6.
    """
    names = list(rules())
    # failures are flagged, then added up with map-side partial sums: a host with a third of all rows is one row per task
    by_host = measured.where(F.col(host_col).isNotNull()).groupBy(F.col(host_col).alias("host")).agg(F.count("*").alias("n_docs"), *(F.sum(c.cast("long")).alias(f"f_{k}") for k, c in rules().items()))
    n = F.col("n_docs").cast("double")
    total = by_host.agg(F.count("*").alias("hosts"), F.sum(n).alias("n"), F.sum(n * n).alias("nn"), *(F.sum(f"f_{k}").alias(f"f_{k}") for k in names), *(F.sum(F.col(f"f_{k}") * F.col(f"f_{k}") / n).alias(f"ff_{k}") for k in names)).first()
    if not total.hosts:
        total = None
    rates = []
    for k in names:
        m = total[f"f_{k}"] / total.n if total else 0.0
        within = m * (1 - m)
        between = ((total[f"ff_{k}"] - total.n * m * m) - within * (total.hosts - 1)) / free if total and (free := total.n - total.nn / total.n) > 0 else 0.0
        strength = min(1e6, max(1.0, within / between - 1)) if between > 0 else 1e6
        rates.append(((F.col(f"f_{k}") + m * strength) / (n + strength)).alias(f"rate_{k}"))
    shrunk = by_host.select("host", "n_docs", *rates)
    return shrunk.withColumn("host_failed", F.greatest(*(F.col(f"rate_{k}") for k in names)) > worst_rate)


def judge(docs: DataFrame, keep: list[str], host_col: str = "source", worst_rate: float = WORST_RATE, text_col: str = "text") -> DataFrame:
    """The columns ``keep``, the measures, base_failed, host_failed and kept, for each document.

    The measures are written once and used for the hosts and for the documents; texts are read once and never shuffled.
    """
    host = spare([*docs.columns, *_RESULTS], "host")
    measured = stored(measure(docs.withColumn(host, F.col(host_col)), [*(c for c in keep if c not in _RESULTS), host], text_col))
    failed = rules()
    base = F.lit(False)
    for k in OWN_RULES:
        base = base | failed[k]
    bad = host_verdicts(measured, host, worst_rate).where("host_failed").select(F.col("host").alias(host), F.lit(True).alias("host_failed"))
    judged = measured.withColumn("base_failed", base).join(bad, host, "left").withColumn("host_failed", F.coalesce("host_failed", F.lit(False)))
    return judged.withColumn("kept", ~F.col("base_failed") & ~F.col("host_failed")).drop(host)


def keep_documents(docs: DataFrame, host_col: str = "source", worst_rate: float = WORST_RATE) -> DataFrame:
    """The documents that neither their own rules nor their host's reject, with all their columns, whatever their names."""
    plain = [f"column_{i}" for i in range(len(docs.columns))]
    inner = docs.select(*(F.col(f"`{c}`").alias(p) for c, p in zip(docs.columns, plain)))
    kept = judge(inner, plain, plain[docs.columns.index(host_col)], worst_rate, plain[docs.columns.index("text")]).where("kept")
    return kept.select(*(F.col(p).alias(c) for c, p in zip(docs.columns, plain)))


def op9_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(read(spark, sf_dir, "documents"), ["doc_id"]).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


QUERIES = {"op9_host_rules": op9_host_rules}


def _oracle() -> str:
    conditions = {
        "few_words": f"n_words < {MIN_WORDS}",
        "repeats": f"100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words",
        "symbols": "10 * n_symbols > n_words",
        "odd_words": "(word_chars < 2 * n_words OR word_chars > 15 * n_words)",
    }
    sums = ", ".join(f"sum(CAST({c} AS INT))::DOUBLE AS f_{k}" for k, c in conditions.items())
    totals = ", ".join(f"sum(f_{k}) / sum(n) AS m_{k}, sum(f_{k} * f_{k} / n) AS ff_{k}" for k in conditions)
    between = ", ".join(f"CASE WHEN n - nn / n > 0 THEN ((ff_{k} - n * m_{k} * m_{k}) - m_{k} * (1 - m_{k}) * (hosts - 1)) / (n - nn / n) ELSE 0 END AS t_{k}" for k in conditions)
    strength = ", ".join(f"m_{k}, CASE WHEN t_{k} > 0 THEN least(1e6, greatest(1.0, m_{k} * (1 - m_{k}) / t_{k} - 1)) ELSE 1e6 END AS s_{k}" for k in conditions)
    rates = ", ".join(f"(f_{k} + m_{k} * s_{k}) / (hosts.n + s_{k})" for k in conditions)
    return rf"""
WITH words AS (
  SELECT doc_id, source, text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
triples AS (
  SELECT doc_id, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM words WHERE len(w) >= 3)),
repeated AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n FROM triples) WHERE n > 1),
covered AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM repeated) GROUP BY doc_id),
duplicate AS (
  SELECT doc_id, sum(n - 1) AS n FROM (SELECT doc_id, x, count(*) AS n FROM (SELECT doc_id, unnest(l) AS x FROM words) WHERE regexp_matches(x, '[^\x20\x09-\x0D]') GROUP BY doc_id, x) GROUP BY doc_id),
measured AS (
  SELECT doc_id, source, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
    CAST(coalesce(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')), 0) AS BIGINT) AS n_symbols,
    CAST(coalesce(duplicate.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(covered.n, 0) AS BIGINT) AS n_repeat_words
  FROM words LEFT JOIN duplicate USING (doc_id) LEFT JOIN covered USING (doc_id)),
hosts AS (SELECT source, count(*)::DOUBLE AS n, {sums} FROM measured WHERE source IS NOT NULL GROUP BY source),
total AS (SELECT count(*) AS hosts, sum(n) AS n, sum(n * n) AS nn, {totals} FROM hosts),
spread AS (SELECT *, {between} FROM total),
prior AS (SELECT {strength} FROM spread),
bad AS (SELECT source FROM hosts, prior WHERE greatest({rates}) > {WORST_RATE}),
base AS (SELECT *, ({conditions["few_words"]} OR {conditions["repeats"]}) AS base_failed FROM measured)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT EXISTS (SELECT 1 FROM bad WHERE bad.source = base.source) AS kept FROM base
"""


ORACLE_SQL = {"op9_host_rules": _oracle()}
