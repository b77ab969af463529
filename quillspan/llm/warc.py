"""WARC archives: writing, and reading by a verified chain of record boundaries.

Writing. Each page is a record; pages of equal payload (its SHA-1) are one response, the page with the largest id, and
revisits of it. Spark's text writer lays the records into archives in the shared folder, with the blank lines that end a record
as its line separator. Archives are gzip files of ``FILE_RECORDS`` records at most, as such a file can be read by one task only;
a large collection is many of them.

Reading. Spark's text reader cuts the archives at the magic that begins a record, and where an archive is not compressed, in
every split of it. Each piece is a candidate: its own offset and, from its header, the offset of its successor.
The magic may stand inside a payload; such a candidate is on no chain from the start of its file. Pointer jumping finds the chain:
in each round the reached offsets are joined with jumps, which then double. Pieces that are not reached belong to the payload of
the last record before them. Most pieces are whole records and are read back as they are; only those that are not are listed and joined.

Null html is an empty payload; null urls are left out; a null page_id has an empty record id and reads back as null. Among
repeated page_ids of the same payload, one row is the response. Extra columns are ignored; an empty table has no archives.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspan.llm.common import discard, read, shared_dir, small_batches, stored

MAGIC, END = "WARC/1.1\r\n", "\r\n\r\n"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
RECORD_ID = "urn:quillspan:page:"
#: Rows (of four or five numbers) that are broadcast to the payloads at most; beyond it payloads are shuffled to them.
BROADCAST_ROWS = 500_000
FILE_RECORDS = 20_000


def payload_digest(payload: str) -> Column:
    """Upper-case base32 of the SHA-1 of a binary column."""

    @F.arrow_udf("string")
    def digest(values: pa.Array) -> pa.Array:
        return pa.array([base64.b32encode(hashlib.sha1(x.as_py() or b"").digest()).decode() for x in values], pa.string())

    return digest(payload)


def records(pages: DataFrame, least_revisit_bytes: int = 0) -> DataFrame:
    """(record) of each page: the whole text of its WARC record but for the end."""
    # the number makes repeated rows differ; it is written down, as another evaluation might number other rows so
    pages = stored(pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html")).withColumn("row", F.monotonically_increasing_id()))
    pages = pages.withColumn("payload", F.col("html").cast("binary")).withColumn("digest", payload_digest("payload"))
    rows = stored(pages.select("page_id", "row", "digest"))
    first = rows.groupBy("digest").agg(F.max(F.struct(F.col("page_id"), F.col("row"))).alias("first"))
    # payloads stay where they are: only the rows of revisits go to them
    others = stored(rows.join(first, "digest").where(F.col("row") != F.col("first.row")).select("row", F.struct("first.page_id").alias("first")))
    discard(rows)
    paired = pages.join(F.broadcast(others) if others.count() <= BROADCAST_ROWS else others, "row", "left")
    size = F.octet_length("payload")
    revisit = F.col("first").isNotNull() & (size >= least_revisit_bytes)
    block = F.when(revisit, F.lit(HTTP)).otherwise(F.concat(F.lit(HTTP), "html"))
    url = F.regexp_replace("url", r"[\x00-\x20\x7f]", "%20")
    name = lambda c: F.concat(F.lit(f"<{RECORD_ID}"), F.coalesce(c.cast("string"), F.lit("")), F.lit(">"))
    header = F.concat(
        F.lit(MAGIC),
        F.lit("WARC-Type: "), F.when(revisit, "revisit").otherwise("response"), F.lit("\r\nWARC-Record-ID: "), name(F.col("page_id")),
        F.lit("\r\nWARC-Date: 2024-01-01T00:00:00Z"),
        F.coalesce(F.concat(F.lit("\r\nWARC-Target-URI: "), url), F.lit("")),
        F.lit("\r\nWARC-Payload-Digest: sha1:"), F.col("digest"),
        F.when(revisit, F.concat(F.lit("\r\nWARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\nWARC-Refers-To: "), name(F.col("first.page_id")))).otherwise(F.lit("")),
        F.lit("\r\nContent-Type: application/http;msgtype=response\r\nContent-Length: "), F.octet_length(block).cast("string"), F.lit("\r\n\r\n"),
    )
    return paired.select(F.concat(header, block).alias("record"))


def write_archives(pages: DataFrame, path: str | None = None, least_revisit_bytes: int = 0) -> str:
    """Writes the pages' records as archives into ``path`` (a folder of its own in the shared one, if None) and returns it."""
    path = path or f"{shared_dir(pages.sparkSession).rstrip('/')}/quillspan-{pages.sparkSession.sparkContext.applicationId}/{uuid.uuid4().hex}"
    with small_batches(pages.sparkSession, 1000):
        records(pages, least_revisit_bytes).write.option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", FILE_RECORDS).text(path)
    return path


_FIELD = re.compile(rb"(?im)^([A-Za-z-]+):[ \t]*([^\r\n]*)\r?$")
_ARROW = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
PIECE = "path string, split long, local long, size long, skip long, length long, kind string, id string, refers string, digest string"


def _pieces(batches: Iterable[pa.RecordBatch], raw: bool) -> Iterator[pa.RecordBatch]:
    """What stands between magics, in the order of each split: its place behind the first such piece of the split, and its header and, if ``raw``, its bytes."""
    key, at = None, 0
    for batch in batches:
        rows = []
        for path, split, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            if (path, split) != key:
                key, at = (path, split), 0
            rows.append((path, split, at, len(value), *_header(value), *[value] * raw))
            at += len(value) + len(MAGIC)
        schema = PIECE + ", raw binary" * raw
        yield pa.RecordBatch.from_arrays([pa.array(c, _ARROW[x.split()[1]]) for c, x in zip(zip(*rows) if rows else [()] * 11, schema.split(", "))], [x.split()[0] for x in schema.split(", ")])


def _header(value: bytes) -> tuple:
    """(bytes before the block, Content-Length, type, id, what it refers to, digest); the length is null where there is no header."""
    head = value.find(b"\r\n\r\n")
    fields = {k.lower(): v.strip() for k, v in _FIELD.findall(value[:head])} if head >= 0 else {}
    known = fields.get(b"content-length", b"")
    texts = (fields[k].decode("utf-8", "replace") if k in fields else None for k in (b"warc-type", b"warc-record-id", b"warc-refers-to", b"warc-payload-digest"))
    return head + 4, int(known) if known.isdigit() and len(known) < 19 else None, *texts


def reachable(jumps: DataFrame) -> DataFrame:
    """(path, at) of the records on the chain from offset 0 of each file; ``jumps(path, at, next)`` has the candidates.

    Each round reaches twice as far: those reached so far jump, and jumps are joined with themselves. Keys are single offsets,
    so no key is hot; rounds are the logarithm of the longest file's number of records.
    """
    jumps = stored(jumps.select("path", "at", "next"))
    reached = stored(jumps.where("at = 0").select("path", "at"))
    n = reached.count()
    while n:
        beyond = reached.join(jumps, ["path", "at"]).select("path", F.col("next").alias("at"))
        more = stored(reached.union(beyond).distinct())
        longer = stored(jumps.alias("a").join(jumps.alias("b"), (F.col("a.path") == F.col("b.path")) & (F.col("a.next") == F.col("b.at"))).select("a.path", "a.at", "b.next"))
        discard(reached, jumps)
        reached, jumps, before, n = more, longer, n, more.count()
        if n == before:
            break
    return reached


def _few(rows: DataFrame) -> DataFrame:
    return F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """(path, at, kind, id, refers, digest, payload) of the records of the archives in ``path``; the payload is what follows the HTTP header."""
    text = spark.read.option("lineSep", MAGIC).option("pathGlobFilter", "*.txt*").text(path)
    text = text.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("split"), F.col("value").cast("binary").alias("raw"))
    cut = stored(text.mapInArrow(lambda b: _pieces(b, False), PIECE).select("path", "split", "local", "size", "skip", "length"))
    # a split's first piece starts where the pieces of the splits before it end
    sizes = cut.groupBy("path", "split").agg(F.sum(F.col("size") + len(MAGIC)).alias("n"))
    before = Window.partitionBy("path").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    starts = stored(sizes.select("path", "split", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start")))
    placed = stored(cut.join(starts, ["path", "split"]).withColumn("at", F.col("local") + F.col("start") - len(MAGIC)).where("at >= 0").drop("start"))
    jumps = placed.where("length is not null").select("path", "at", (F.col("at") + len(MAGIC) + F.col("skip") + F.col("length") + len(END)).alias("next"))
    chain = reachable(jumps.where("next > at"))  # the last jump ends at the end of the file, where no record is
    discard(cut)
    marked = placed.join(chain.withColumn("real", F.lit(True)), ["path", "at"], "left")
    # a payload with the magic in it has come in several pieces: those that are not real follow the last real one
    own = Window.partitionBy("path").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    owned = marked.withColumn("owner", F.last(F.when(F.col("real"), F.col("at")), True).over(own))
    real = F.col("real").isNotNull()
    whole = real & (F.col("size") == F.col("skip") + F.col("length") + len(END))
    # what is listed: pieces of a record that has several, and what stands before the first record of a file
    odd = stored(owned.select("path", "split", "local", F.col("owner").alias("at"), F.lit(True).alias("listed"), whole.alias("whole")).where("not whole").drop("whole"))
    again = text.mapInArrow(lambda b: _pieces(b, True), PIECE + ", raw binary").join(_few(starts), ["path", "split"]).withColumn("own", F.col("local") + F.col("start") - len(MAGIC)).where("own >= 0")
    pieces = again.join(_few(odd), ["path", "split", "local"], "left")
    several = pieces.where("at is not null").groupBy("path", "at").agg(F.min_by(F.struct("kind", "id", "refers", "digest", "skip", "length"), "own").alias("head"), F.array_sort(F.collect_list(F.struct("own", "raw"))).alias("rest"))
    glued = F.aggregate(F.slice("rest", 2, 1 << 30), F.element_at("rest", 1)["raw"], lambda s, x: F.concat(s, F.lit(MAGIC).cast("binary"), x["raw"]))
    header = ["kind", "id", "refers", "digest", "skip", "length"]
    joined = several.select("path", "at", *(F.col(f"head.{c}").alias(c) for c in header), glued.alias("raw"))
    whole = pieces.where("listed is null").select("path", F.col("own").alias("at"), *header, "raw").unionByName(joined)
    block = F.substring("raw", F.col("skip") + 1, F.col("length"))

    @F.arrow_udf("binary")
    def body(blocks: pa.Array) -> pa.Array:
        return pa.array([b.partition(b"\r\n\r\n")[2] if (b := x.as_py()) is not None else None for x in blocks], pa.binary())

    return whole.select("path", "at", "kind", "id", "refers", F.regexp_replace("digest", "^sha1:", "").alias("digest"), body(block).alias("payload"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = read_archives(spark, write_archives(read(spark, sf_dir, "pages")))
    page = lambda c: F.regexp_extract(c, rf"{RECORD_ID}(-?\d+)>", 1)
    number = lambda c: F.when(page(c) != "", page(c).cast("long"))
    read_back = stored(found.select(number("id").alias("page_id"), F.col("kind").alias("record_type"), number("refers").alias("refers_to"), "digest", F.octet_length("payload").cast("long").alias("bytes"), payload_digest("payload").alias("computed")))
    # a revisit carries no payload: what it refers to has the size, found by the digest that its header names
    responses = read_back.where("record_type = 'response'").groupBy(F.col("computed").alias("digest")).agg(F.max("bytes").alias("full"))
    both = read_back.where("record_type = 'revisit'").join(responses, "digest").select("page_id", F.col("full").alias("payload_bytes"), F.col("digest").alias("payload_digest"), "record_type", "refers_to")
    return read_back.where("record_type = 'response'").select("page_id", F.col("bytes").alias("payload_bytes"), F.col("computed").alias("payload_digest"), "record_type", "refers_to").union(both)


QUERIES = {"op6_warc": op6_warc}
ORACLE_SQL: dict[str, str] = {}
