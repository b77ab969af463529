"""Files and logs: walks, whole texts, manifests, appended logs with rotation, JSON snapshots, saved graphs.

Listings and sizes come from the file system that a path names, so local folders and object stores work alike.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Default size of a log beyond which the next append begins a new one.
LOG_BYTES = 10 << 20


def _at(spark: SparkSession, path: str):
    """(file system, path) as the JVM has them."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def exists(spark: SparkSession, path: str) -> bool:
    fs, where = _at(spark, path)
    return fs.exists(where)


def size_of(spark: SparkSession, path: str) -> int:
    fs, where = _at(spark, path)
    return fs.getContentSummary(where).getLength() if fs.exists(where) else 0


def remove(spark: SparkSession, path: str) -> None:
    fs, where = _at(spark, path)
    fs.delete(where, True)


def rename(spark: SparkSession, old: str, new: str) -> None:
    """``old`` takes the place of ``new``."""
    fs, where = _at(spark, old)
    remove(spark, new)
    fs.rename(where, _at(spark, new)[1])


def scratch(spark: SparkSession, stem: str) -> str:
    """A new path in this application's part of the shared folder."""
    from quillspan.sources.stored import shared_folder

    return f"{shared_folder(spark)}/{stem}-{uuid.uuid4().hex}"


def glob_to_regex(pattern: str) -> str:
    """An ignore rule as a pattern for a path below the root: ``*`` and ``?`` stay inside a part, ``**`` does not, a trailing ``/`` names folders, a leading one the root."""
    rooted, folder = pattern.startswith("/"), pattern.endswith("/")
    body = "".join({"**": ".*", "*": "[^/]*", "?": "[^/]"}.get(x, "".join("\\" + c if c in ".^$+{}[]|()\\" else c for c in x)) for x in _parts(pattern.strip("/")))
    return ("^" if rooted or "/" in pattern.strip("/") else "(^|.*/)") + body + ("/.*$" if folder else "(/.*)?$")


def _parts(pattern: str) -> list[str]:
    out, i = [], 0
    while i < len(pattern):
        step = 2 if pattern.startswith("**", i) else 1
        out.append(pattern[i : i + step])
        i += step
    return out


def walk(spark: SparkSession, root: str, recursive: bool = True, ignore: tuple[str, ...] = (), extensions: tuple[str, ...] = ()) -> DataFrame:
    """(path below the root, mtime, length) of the files of a folder, or of the root if it is a file; a missing root is an error.

    Hidden files (a name that begins with . or _) are left out. Only file status is read: the content column is pruned.
    """
    fs, where = _at(spark, root)
    if not fs.exists(where):
        raise FileNotFoundError(root)
    base = fs.makeQualified(where).toUri().getPath().rstrip("/")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(root)
    below = F.regexp_replace(F.regexp_replace("path", r"^[a-zA-Z0-9+.-]+:(//[^/]*)?", ""), "^" + "".join("\\" + c if not c.isalnum() and c != "/" else c for c in base) + "/?", "")
    rows = files.select(F.when(below == "", F.element_at(F.split("path", "/"), -1)).otherwise(below).alias("path"), F.col("modificationTime").alias("mtime"), "length")
    for rule in ignore:
        rows = rows.where(~F.col("path").rlike(glob_to_regex(rule)))
    return rows.where(F.lower(F.element_at(F.split("path", r"\."), -1)).isin(*extensions)) if extensions else rows


def whole_texts(spark: SparkSession, root: str) -> DataFrame:
    """(path, content) of files that are UTF-8 throughout; others are left out, as if binary."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "content")
    return files.where(F.is_valid_utf8(F.col("content").cast("string"))).select("path", F.col("content").cast("string").alias("content"))


def append_log(records: DataFrame, path: str, most: int = LOG_BYTES, mirrors: tuple[str, ...] = ()) -> None:
    """Appends JSON lines to the log at ``path`` and to each mirror. A log that has reached ``most`` bytes becomes ``path.1`` first; a mirror that cannot be written is passed over."""
    spark = records.sparkSession
    if exists(spark, path) and size_of(spark, path) >= max(most, 1):
        rename(spark, path, f"{path}.1")
    records.write.mode("append").json(path)
    for mirror in mirrors:
        try:
            records.write.mode("append").json(mirror)
        except Exception:  # noqa: BLE001, PERF203  the log itself is written; a mirror never stops it
            continue


def read_log(spark: SparkSession, path: str, schema: StructType | str, where: Column | None = None) -> DataFrame:
    """The records of the rotated log, then of the log (``part`` 0 and 1); lines that are no JSON are left out. ``where`` is applied at the scan."""
    parts = [(k, p) for k, p in enumerate((f"{path}.1", path)) if exists(spark, p)]
    found = None
    for k, p in parts:
        rows = spark.read.schema(schema).option("mode", "DROPMALFORMED").json(p)
        rows = (rows if where is None else rows.where(where)).withColumn("part", F.lit(k))
        found = rows if found is None else found.unionByName(rows)
    if found is None:
        raise FileNotFoundError(path)
    return found


def save_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    nodes.write.mode("overwrite").parquet(f"{path}/nodes")
    edges.write.mode("overwrite").parquet(f"{path}/edges")


def load_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/edges")
