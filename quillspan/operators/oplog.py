"""Analytics of an operation log ``(seq, ts, session_id, tool, raw, returned, store_ref, duration_ms, outcome)``.

All aggregations are one groupBy with map-side partials; timelines and rankings window over their own few result rows only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspan.functions.text import micros, saved_tokens

BUCKETS = 60


def measures() -> list[Column]:
    offloaded = F.col("store_ref").isNotNull() & (F.col("raw") > F.col("returned"))
    return [
        F.count("*").alias("ops"),
        F.sum("raw").alias("raw_bytes"),
        F.sum("returned").alias("returned_bytes"),
        F.sum(saved_tokens(F.col("raw"), F.col("returned"))).alias("saved_tokens"),
        F.count_if(F.col("outcome") == "error").alias("errors"),
        F.count_if(F.col("outcome") == "timed_out").alias("timed_out"),
        F.count_if(offloaded).alias("offloaded_ops"),
        F.coalesce(F.sum(F.when(offloaded, F.col("raw") - F.col("returned"))), F.lit(0)).alias("offloaded_bytes"),
    ]


def totals(ops: DataFrame, *by: str) -> DataFrame:
    return ops.groupBy(*by).agg(*measures())


def labelled(column: Column, table: dict[str, str], default: str) -> Column:
    """A lookup in a small fixed table."""
    out = F.lit(default)
    for k, v in reversed(table.items()):
        out = F.when(column == k, v).otherwise(out)
    return out


def between(ops: DataFrame, since: str | None = None, until: str | None = None) -> DataFrame:
    """Records of the half-open range [since, until); None leaves an end open."""
    if since is not None:
        ops = ops.where(F.col("ts") >= F.lit(since).cast("timestamp"))
    return ops if until is None else ops.where(F.col("ts") < F.lit(until).cast("timestamp"))


def last(ops: DataFrame, n: int) -> DataFrame:
    return ops.orderBy(F.desc("seq")).limit(n)


def timeline(ops: DataFrame, value: Column, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, value, total so far) over the log's own span; buckets without records are there with zero."""
    at = micros("ts").cast("double")
    span = ops.agg(F.min(at).alias("start"), F.max(at).alias("end"))  # one row
    share = (at - F.col("start")) / F.greatest(F.col("end") - F.col("start"), F.lit(1.0))
    bucket = F.least(F.lit(buckets - 1), F.floor(F.greatest(F.lit(0.0), F.least(F.lit(1.0), share)) * buckets)).cast("int")
    filled = ops.join(F.broadcast(span)).groupBy(bucket.alias("bucket")).agg(F.sum(value).alias("value"))
    every = ops.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    rows = every.join(filled, "bucket", "left").select("bucket", F.coalesce("value", F.lit(0)).alias("value"))
    return rows.withColumn("total", F.sum("value").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)))


def sparkline(timeline: DataFrame, cells: int = 20) -> DataFrame:
    """(cell, level 0..7): the timeline's increases, resampled and scaled to the largest."""
    cell = F.floor(F.col("bucket") * cells / BUCKETS).cast("int")
    summed = timeline.groupBy(cell.alias("cell")).agg(F.sum(F.greatest("value", F.lit(0))).alias("v"))
    most = F.max("v").over(Window.partitionBy(F.lit(1)))
    return summed.select("cell", F.when(most > 0, F.floor(F.col("v") * 7 / most + 0.5)).otherwise(0).cast("int").alias("level"))


def activity(ops: DataFrame, by: str) -> DataFrame:
    return ops.groupBy(by).agg(F.count("*").alias("n"), F.count_distinct("session_id").alias("sessions"), F.max("ts").alias("latest"))


def value_model(ops: DataFrame, rates: DataFrame, dimensions: DataFrame) -> DataFrame:
    """(dimension, ops, est_tokens, round_trips) of every dimension, zero where it has no operations; the two small tables are fixed."""
    counts = ops.groupBy("tool").agg(F.count("*").alias("n"))
    joined = dimensions.join(F.broadcast(rates), "dimension", "left").join(counts, "tool", "left")
    n = F.coalesce("n", F.lit(0))
    return joined.groupBy("dimension").agg(F.sum(n).alias("ops"), F.round(F.sum(n * F.coalesce("tokens_per_op", F.lit(0.0))), 6).alias("est_tokens"), F.round(F.sum(n * F.coalesce("trips_per_op", F.lit(0.0))), 6).alias("round_trips"))


def increments(snapshots: DataFrame, key: str, value: str) -> DataFrame:
    """Increases of a cumulative counter between snapshots; a snapshot that adds nothing is skipped but still is the mark for the next."""
    before = F.coalesce(F.lag(value).over(Window.partitionBy(key).orderBy("seq")), F.lit(0))
    return snapshots.withColumn("delta", F.col(value) - before).where("delta > 0")
