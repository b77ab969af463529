"""Op records as a stream: keyed counters and live totals by Structured Streaming.

State is one row a key, kept by the state store in the checkpoint folder; order among late records does not matter to counts.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspan.sources.stored import shared_folder


def drained(stream: DataFrame, mode: str = "complete") -> DataFrame:
    """What the stream's query holds once all input at hand has been taken; the sink is a table in the shared folder, written anew by each batch."""
    spark = stream.sparkSession
    at = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{at}/out")

    run = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{at}/state").trigger(availableNow=True).foreachBatch(put).start()
    run.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{at}/out")


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)


def keyed_counters(events: DataFrame) -> DataFrame:
    """(session_id, tool, n)."""
    return events.groupBy(F.col("user_id").alias("session_id"), F.col("event_type").alias("tool")).agg(F.count("*").alias("n"))


def live_totals(events: DataFrame) -> DataFrame:
    raw = F.floor(F.col("value") * 100).cast("long")
    return events.groupBy(F.col("event_type").alias("tool")).agg(F.count("*").alias("ops"), F.sum(raw).alias("raw_bytes"), F.max("event_id").alias("last_event"))


def file_stream(spark: SparkSession, path: str, schema, files_a_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    return (reader if files_a_batch is None else reader.option("maxFilesPerTrigger", files_a_batch)).parquet(path)


def each_batch(stream: DataFrame, put: Callable[[DataFrame, int], None], state: str | None = None) -> None:
    """Gives every micro-batch of the input at hand to ``put``, in order; goes on after what a stream with the same ``state`` folder has taken."""
    at = state or f"{shared_folder(stream.sparkSession)}/stream-{uuid.uuid4().hex}"
    run = stream.writeStream.option("checkpointLocation", f"{at}/state").trigger(availableNow=True).foreachBatch(put).start()
    run.awaitTermination()


def each_batch_of(spark: SparkSession, arrivals: list[DataFrame], path: str, put: Callable[[DataFrame, int], None]) -> None:
    """One micro-batch for each of ``arrivals``, whose rows are written to the folder as they come, by as many tasks as they have, and taken by one stream that stops between them."""
    state = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    for rows in arrivals:
        rows.write.mode("append").parquet(path)
        each_batch(file_stream(spark, path, rows.schema), put, state)


def bursts(changes: DataFrame, by: str, at: str, value: str, quiet: str) -> DataFrame:
    """(by, start, n, first, last): changes of a key with less than ``quiet`` between them are one burst, after which there is one rebuild; ``first`` and ``last`` are its values."""
    return changes.groupBy(by, F.session_window(at, quiet).alias("w")).agg(F.count("*").alias("n"), F.min_by(value, at).alias("first"), F.max_by(value, at).alias("last")).select(by, F.col("w.start").alias("start"), "n", "first", "last")


def sliding_totals(events: DataFrame, at: str, by: str, length: str, step: str) -> DataFrame:
    """(start, by, n) of windows of one length, a step apart."""
    return events.groupBy(F.window(at, length, step).alias("w"), by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), by, "n")


def high_water_deltas(spark: SparkSession, arrivals: list[DataFrame], path: str, key: str, order: str, value: str) -> DataFrame:
    """(key, order, delta) of cumulative counters that a stream takes in the batches of ``arrivals``: what each snapshot adds to the one before, of whatever batch, where it adds anything.

    The state, each key's last snapshot, is a table that every batch writes anew beside the last one; deltas are appended.
    """
    root = f"{shared_folder(spark)}/marks-{uuid.uuid4().hex}"
    kinds = {f.name: f.dataType.simpleString() for f in arrivals[0].schema}
    form = f"{key} {kinds[key]}, {order} {kinds[order]}, {value} {kinds[value]}"

    def put(batch: DataFrame, number: int) -> None:
        rows = batch.select(key, order, value).withColumn("new", F.lit(True))
        if number:
            rows = rows.unionByName(spark.read.schema(form).parquet(f"{root}/marks-{number - 1}").withColumn("new", F.lit(False)))
        before = F.lag(value).over(Window.partitionBy(key).orderBy(order))
        deltas = rows.withColumn("delta", F.col(value) - F.coalesce(before, F.lit(0))).where("new and delta > 0")
        deltas.select(key, order, "delta").write.mode("overwrite").parquet(f"{root}/deltas/batch={number}")
        marks = rows.groupBy(key).agg(F.max_by(F.struct(order, value), order).alias("x")).select(key, f"x.{order}", f"x.{value}")
        marks.write.mode("overwrite").parquet(f"{root}/marks-{number}")

    each_batch_of(spark, arrivals, path, put)
    return spark.read.schema(f"{key} {kinds[key]}, {order} {kinds[order]}, delta long").parquet(f"{root}/deltas").select(key, order, "delta")
