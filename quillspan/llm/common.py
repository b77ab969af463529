"""What several corpus operators share: reading a table, stored intermediate results, words, connected components."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import functools
import gc
import shutil
import sys
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes that separate words in every contract: space and \x09-\x0D. ``bytes.split()`` splits on exactly these.
WORD_GAP_CHARS = " \t\n\x0b\x0c\r"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """The table ``table`` of the dataset at ``sf_dir``, by Spark's own reader, so any Hadoop path works."""
    text_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def spare(columns: Iterable[str], stem: str) -> str:
    """A column name that none of ``columns`` has, in upper or lower case."""
    taken = {c.lower() for c in columns}
    while stem.lower() in taken:
        stem += "_"
    return stem


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; only where that is unset and all is one machine (tests, local mode) a folder of our own, dropped at exit."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="quillspan-")
        atexit.register(shutil.rmtree, found, True)
        spark.conf.set("spark.checkpoint.dir", found)
    return found


_ARROW = "spark.sql.execution.arrow."
#: Bytes of an Arrow batch for Python, beyond which it ends with the row it is at.
BATCH_BYTES = 4 << 20
#: Rows that Parquet's reader holds at once: of whole texts, Spark's 4096 are arrays of tens of MB in each task, which G1 takes new regions for.
_READER, READER_ROWS = "spark.sql.parquet.columnarReaderBatchSize", 512


def _reader_rows(spark: SparkSession) -> str:
    return str(min(READER_ROWS, int(spark.conf.get(_READER))))


@contextlib.contextmanager
def small_batches(spark: SparkSession, rows: int) -> Iterator[None]:
    """Within it, Arrow batches for Python have so many rows and ``BATCH_BYTES`` (and a row) at most, by default 10,000 texts are one; Parquet is read by ``READER_ROWS``."""
    new = {f"{_ARROW}maxRecordsPerBatch": str(rows), f"{_ARROW}maxBytesPerBatch": str(BATCH_BYTES), _READER: _reader_rows(spark)}
    before = {name: spark.conf.get(name) for name in new}
    for name, value in new.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def text_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Lowers the session's Arrow and reader batches, for operators that move whole texts in a plan they only return: it runs when the caller runs it.

    A batch ends at Spark's own bound of bytes as well, 64 MB unless the session says otherwise, so long texts are few in a batch.
    """
    name = f"{_ARROW}maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= rows:
        spark.conf.set(name, str(rows))
    spark.conf.set(_READER, _reader_rows(spark))


def tidied(work: Callable[..., Iterator]) -> Callable[..., Iterator]:
    """A task's generator that gives freed memory back to the system at its end: workers live on, and what they keep adds up over operators."""

    @functools.wraps(work)
    def of(*args, **more) -> Iterator:
        try:
            yield from work(*args, **more)
        finally:
            pa.default_memory_pool().release_unused()
            if sys.platform == "linux":
                with contextlib.suppress(OSError, AttributeError):
                    ctypes.CDLL(None).malloc_trim(0)

    return of


def stored(df: DataFrame, batch_rows: int = 1000, files: int | None = None) -> DataFrame:
    """``df`` written once as Parquet to the shared folder and read again.

    It cuts the lineage, so that a lost executor costs a reread and not a recomputation, and computes the plan once, where
    ``checkpoint()`` would compute it twice. ``files`` deals a small result of many tasks out to as many files first, as each file costs
    the file system and later readers. Nothing deletes the application's folder in ``spark.checkpoint.dir`` but ``discard``.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/quillspan-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    with small_batches(spark, batch_rows):
        (df if files is None else df.repartition(max(1, files))).write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def discard(*frames: DataFrame) -> None:
    """Deletes what ``stored`` has written for the frames; nothing may read them later."""
    for df in frames:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df._stored_at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Lets Spark drop the shuffle files of plans that nothing refers to any more; it does so when the driver collects garbage."""
    gc.collect()
    spark._jvm.System.gc()


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Edges that one task connects, in some 100 MB; more are contracted by rounds until they are so few, or are stars.
FEW_EDGES = 500_000


def connected(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, root) of the nodes of the edges (a, b) that are not the least of their component."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = ends[: len(a)], ends[len(a) :]
    label = np.arange(len(nodes))
    while True:
        m, n = label[x], label[y]
        differ = m != n
        if not differ.any():
            return nodes[label != np.arange(len(nodes))], nodes[label[label != np.arange(len(nodes))]]
        x, y, m, n = x[differ], y[differ], m[differ], n[differ]
        np.minimum.at(label, np.maximum(m, n), np.minimum(m, n))
        while (label != (up := label[label])).any():
            label = up


@tidied
def _connect(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    ends = [[c.to_numpy() for c in batch.columns] for batch in batches]
    node, root = connected(*(np.concatenate([e[k] for e in ends] or [np.zeros(0, np.int64)]) for k in range(2)))
    yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(root)], ["node", "root"])


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges(a, b)``: rows ``(node, root)`` with the smallest reachable node as root.

    Up to ``FEW_EDGES`` edges are connected in one task. More alternate large-star and small-star steps: every node hangs itself and
    its larger (then smaller) neighbours under the least of its neighbourhood, and components and their least nodes stay the same,
    until the edges are few or stars. Each step is one aggregation and one equi-join of edge rows, so no more than that is gathered
    in a task, and nothing on the driver (a hot node's rows are joined, and AQE splits them); rounds grow with the logarithm of the
    longest path. Null ends and self-loops are dropped; an empty input has an empty result.
    """
    ends = edges.select(F.greatest("a", "b").cast("long").alias("a"), F.least("a", "b").cast("long").alias("b"))
    now = stored(ends.where("a is not null and b is not null and a <> b"))
    size, before = now.count(), None
    while size > FEW_EDGES:
        both = now.select("a", "b").union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        after = stored(small.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct())
        mark = after.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        discard(now)
        now, size = after, mark[0]
        if mark == before:
            out = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
            out._stored_at = now._stored_at
            return out
        before = mark
    out = stored(now.coalesce(1).mapInArrow(_connect, "node long, root long"))
    discard(now)
    return out
