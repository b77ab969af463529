"""Queries over text scalars: stems, readable numbers, times, import statements, URLs, answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspan.functions import stem
from quillspan.functions import text as t
from quillspan.plans.queries import query
from quillspan.sources.tables import table


@query("T6_stems")
def _(s, d):
    """Each word of the conversations once, with its stem."""
    words = table(s, d, "conversations").select(F.explode(t.tokens(F.col("text"))).alias("word")).distinct()
    return words.select("word", stem.stems(F.col("word")).alias("stem"))


_UNITS = "CASE WHEN b < 1024 THEN b || ' B' " + " ".join(f"WHEN b < {1 << size + 10} THEN printf('%.1f {unit}', b / {1 << size}.0)" for unit, size in (("KB", 10), ("MB", 20), ("GB", 30))) + " ELSE printf('%.1f TB', b / 1099511627776.0) END"


@query("T19_readable", f"""SELECT o_orderkey, {_UNITS} AS bytes, CASE WHEN c >= 1000000 THEN printf('%.1fM', c / 1e6) WHEN c >= 1000 THEN printf('%.1fK', c / 1e3) ELSE CAST(c AS VARCHAR) END AS count,
  CASE WHEN m >= 1 THEN printf('$%.2f', m) WHEN m >= 0.01 THEN printf('$%.3f', m) ELSE printf('$%.4f', m) END AS money,
  CASE WHEN x < 90 THEN printf('~%.0fs', x::DOUBLE) WHEN x < 5400 THEN printf('~%.1f min', x / 60.0) ELSE printf('~%.1f h', x / 3600.0) END AS time,
  CASE WHEN x >= 86400 AND x % 86400 = 0 THEN x // 86400 || 'd' WHEN x >= 3600 AND x % 3600 = 0 THEN x // 3600 || 'h' ELSE greatest(x, 60) // 60 || 'm' END AS duration
  FROM (SELECT o_orderkey, CAST(1 AS BIGINT) << (o_orderkey % 45) AS b, o_orderkey * 128 AS c, (1 << (o_orderkey % 12)) / 1000.0::DOUBLE AS m, (o_orderkey % 97) * 1200 AS x FROM orders)""")
def _(s, d):
    k = F.col("o_orderkey")
    power = lambda n: F.pow(F.lit(2), k % n)
    seconds = (k % 97) * 1200
    return table(s, d, "orders").select(
        "o_orderkey",
        t.human_bytes(power(45).cast("long")).alias("bytes"),
        t.human_count(k * 128).alias("count"),
        t.human_money(power(12) / 1000).alias("money"),
        t.human_time(seconds.cast("double")).alias("time"),
        t.human_duration(seconds).alias("duration"),
    )


@query("T18_parsed_time", "SELECT event_id, epoch_us(ts) // 1000 AS ms FROM events")
def _(s, d):
    """Times written as ISO-8601 and read again."""
    return table(s, d, "events").select("event_id", F.floor(t.micros(t.parsed_time(t.iso_time(F.col("ts")))) / 1000).cast("long").alias("ms"))


_STATEMENT = "CASE p_partkey % 3 WHEN 0 THEN 'use ' || a || '::{' || b || ', self, x::' || a || ' as ' || b || '};' WHEN 1 THEN 'from ' || a || ' import ' || b ELSE 'import ' || a || '.' || b || ';' END"


@query("T23_import_targets", """SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN [b, b] ELSE [b] END AS names FROM (SELECT p_partkey, split_part(p_name, ' ', 2) AS b FROM part)""")
def _(s, d):
    """Statements of three languages' forms made of the parts' names."""
    a, b = F.split_part("p_name", F.lit(" "), F.lit(1)), F.split_part("p_name", F.lit(" "), F.lit(2))
    grouped = F.concat(F.lit("use "), a, F.lit("::{"), b, F.lit(", self, x::"), a, F.lit(" as "), b, F.lit("};"))
    plain = F.when(F.col("p_partkey") % 3 == 1, F.concat(F.lit("from "), a, F.lit(" import "), b)).otherwise(F.concat(F.lit("import "), a, F.lit("."), b, F.lit(";")))
    return table(s, d, "part").select("p_partkey", t.import_targets(F.when(F.col("p_partkey") % 3 == 0, grouped).otherwise(plain)).alias("names"))


@query("T24_parameters", "SELECT page_id, nullif(regexp_extract(url, '[?&]page=([0-9]+)', 1), '') AS page, CASE WHEN contains(url, 'ref=') THEN regexp_extract(url, 'ref=([^&#]*)', 1) || ' +é' END AS ref FROM pages")
def _(s, d):
    """Parameters of the pages' addresses, one with escapes added to it."""
    url = F.regexp_replace("url", "(ref=[^&#]*)", "$1%20+%C3%A9")
    return table(s, d, "pages").select("page_id", t.query_parameter(F.col("url"), "page").alias("page"), t.query_parameter(url, "ref").alias("ref"))


@query("T26_unescaped", "SELECT page_id, replace(url, '/', ' /') AS path FROM pages")
def _(s, d):
    return table(s, d, "pages").select("page_id", t.shell_unescaped(F.replace("url", F.lit("/"), F.lit("\\ /"))).alias("path"))


@query("T27_answers", """SELECT p_partkey, p_partkey % 4 IN (0, 1) AS exact, p_partkey % 4 = 3 AS predicate, p_partkey % 4 <> 2 AS within, true AS holds FROM part""")
def _(s, d):
    """Answers that are the truth padded, in other digits, a little off, or a yes for a true."""
    k, size = F.col("p_partkey") % 4, F.col("p_size").cast("string")
    number = F.when(k == 0, F.concat(F.lit(" "), size, F.lit(" "))).when(k == 1, F.concat(size, F.lit(".0"))).when(k == 2, (F.col("p_size") + 2).cast("string")).otherwise((F.col("p_size") + 0.5).cast("string"))
    word = F.when(k == 3, "Yes").otherwise("no")
    return table(s, d, "part").select(
        "p_partkey",
        t.answer_matches(number, size, "exact").alias("exact"),
        t.answer_matches(word, F.lit("true"), "exact").alias("predicate"),
        t.answer_matches(number, size, "numeric", 0.5).alias("within"),
        t.answer_matches(F.upper("p_name"), F.split_part("p_name", F.lit(" "), F.lit(1)), "contains").alias("holds"),
    )


_SPECS = ("all", "today", "45s", "15m", "3h", "2d", "soon")
_STARTS = " ".join(f"WHEN {i} THEN {x}" for i, x in enumerate(("NULL", "now - (now + 7200) % 86400", "now - 45", "now - 900", "now - 10800", "now - 172800", "NULL")))


@query("O16_windows", f"SELECT event_id, CASE event_id % 7 {_STARTS} END AS start FROM (SELECT event_id, CAST(floor(epoch(ts)) AS BIGINT) AS now FROM events)")
def _(s, d):
    """Where each event's window begins: of all time, of its day two hours east, of a duration, or of no known form."""
    spec = F.get(F.array(*map(F.lit, _SPECS)), (F.col("event_id") % 7).cast("int"))
    now = F.floor(t.micros("ts") / 1_000_000)
    return table(s, d, "events").select("event_id", t.window_start(spec, now, F.lit(7200)).cast("long").alias("start"))
