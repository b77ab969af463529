"""Change data: manifest differences, replacement of touched chunks, content-addressed blobs."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def manifest_diff(stored: DataFrame, current: DataFrame) -> DataFrame:
    """(path, change): changed for new or differing paths, deleted for missing ones."""
    was = stored.select("path", F.col("mtime").alias("before"), F.lit(True).alias("known"))
    changed = current.join(was, "path", "left").where(F.col("known").isNull() | ~F.col("mtime").eqNullSafe(F.col("before"))).select("path", F.lit("changed").alias("change"))
    return changed.unionByName(stored.join(current, "path", "left_anti").select("path", F.lit("deleted").alias("change")))


def replace_chunks(chunks: DataFrame, diff: DataFrame, fresh: DataFrame) -> DataFrame:
    """The chunks without those of changed or deleted paths, and the fresh ones."""
    return chunks.join(diff.select("path"), "path", "left_anti").unionByName(fresh)


def new_blobs(contents: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(hash, content) of contents not stored yet, each once."""
    hashed = contents.select(F.sha2("content", 256).alias("hash"), "content").dropDuplicates(["hash"])
    return hashed if known is None else hashed.join(known.select("hash"), "hash", "left_anti")


def recall(blobs: DataFrame, prefix: str) -> DataFrame:
    """The blob of the least hash with that prefix; none for an empty prefix. The range reaches the scan as a filter."""
    if not prefix:
        return blobs.limit(0)
    return blobs.where((F.col("hash") >= prefix) & (F.col("hash") < prefix + "g")).orderBy("hash").limit(1)


def index_records(chunks: DataFrame, records: DataFrame) -> DataFrame:
    """The chunks, with records ``(path, chunk_id, content)`` in the place of those of the same chunk_id; records without content are skipped, and define no symbols."""
    real = records.where(F.col("content").rlike(r"\S")).select("path", "chunk_id", "content", F.lit("").alias("symbols"))
    return chunks.join(real, "chunk_id", "left_anti").select("path", "chunk_id", "content", "symbols").unionByName(real)


def refreshed(cache: DataFrame, files: DataFrame, extract: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What ``extract`` gives for all ``files(path, content)``, with ``reused``: rows of the cache whose path has the same hash are taken from it, others are worked out, those of deleted files go.

    ``extract`` returns a row per (path, hash, content) it gets, with path and hash kept.
    """
    now = files.withColumn("hash", F.sha2("content", 256))
    fresh = extract(now.join(cache.select("path", "hash"), ["path", "hash"], "left_anti")).withColumn("reused", F.lit(False))
    return cache.join(now.select("path", "hash"), ["path", "hash"], "left_semi").withColumn("reused", F.lit(True)).unionByName(fresh)


def may_replace(before: Column, after: Column, partial: Column) -> Column:
    """Whether a new graph may replace the stored one: never one of no nodes, and one of a part of the files only if it does not shrink."""
    return (after > 0) & ~(partial & (after < before))


def debounced(requests: DataFrame, by: str, at: str, ttl: int) -> DataFrame:
    """(by, at) of the requests that walk anew: the first of each key, and each that comes ``ttl`` or more after the last walk; with 0 all do.

    The rows of a key stream by in order, so a task holds the last walk of one key only.
    """
    rows = requests.select(F.col(by).alias("by"), F.col(at).cast("long").alias("at")).where("by is not null and at is not null")
    kind = rows.schema["by"].dataType.simpleString()

    def of(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, last = None, 0
        for batch in batches:
            walks = np.zeros(len(batch), bool)
            for i, (k, x) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
                if k != key or x - last >= ttl:
                    key, last, walks[i] = k, x, True
            yield batch.filter(pa.array(walks))

    ordered = rows.repartition("by").sortWithinPartitions("by", "at")
    return ordered.mapInArrow(of, f"by {kind}, at long").withColumnsRenamed({"by": by, "at": at})


def durable(events: DataFrame, categories: tuple[str, ...]) -> DataFrame:
    """(project, category, text): what of inserted events goes into a project's memory, each once."""
    return events.where(F.col("category").isin(*categories) & F.col("text").isNotNull()).select("project", "category", "text").distinct()


def verified(references: DataFrame, blobs: DataFrame, last: int) -> DataFrame:
    """(seq, ref, status) of the last ``references(seq, ref)``: PASS where the content stored under the hash, or under a hash with that prefix, has it and comes back the same from the codec; MISSING where there is none."""
    from quillspan.functions import codec

    some = references.orderBy(F.desc("seq")).limit(last)
    short = F.length("ref") < 64
    whole = some.where(~short).join(blobs, F.col("ref") == F.col("hash"), "left")
    # a shortened reference is met by its first twelve characters
    head = some.where(short & (F.length("ref") >= 12)).withColumn("head", F.substring("ref", 1, 12)).join(blobs.withColumn("head", F.substring("hash", 1, 12)), "head", "left").drop("head")
    rows = whole.unionByName(head).where("hash is null or startswith(hash, ref)")
    intact = F.sha2("content", 256) == F.col("hash")
    json = F.try_parse_json("content").isNotNull()
    checked = rows.withColumn("same", F.when(intact & json, codec.expanded(codec.compacted("content")) == codec.without_nulls("content")))
    status = F.when(F.col("hash").isNull(), "MISSING").when(~intact | ~F.coalesce("same", F.lit(True)), "CORRUPT").otherwise("PASS")
    return checked.select("seq", "ref", status.alias("status"))


def scoped(ops: DataFrame, scope: str | None, own: str) -> DataFrame:
    """The records of a named project, of one's own (None), or of all (``*``)."""
    return ops if scope == "*" else ops.where(F.col("project") == (own if scope is None else scope))
