"""Retrieval over chunks ``(path, chunk_id, content, symbols)``: a stored index, BM25 with a boosted field, proximity, literal search, metrics.

Queries are a DataFrame ``(query_id, query)``; any number of them is answered in one plan.

The index is a folder of Parquet tables, each in folders by segment: an update adds a segment, and names the paths whose rows in older
segments no longer count. ``chunks`` numbers the chunks of a segment; ``sizes`` (each chunk's number of words, a row a field),
``postings`` and ``trigrams`` are made of a segment when first asked for. Both of these are packed where the chunks are read: a row has a
field and word, or a trigram, and the numbers of all chunks of one Arrow batch that have it, with the places of the word in each. Rows lie in
folders by a hash of the word's stem or of the trigram, so a search reads the folders of its words only; a large folder is written by several tasks.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspan.functions.stem import stem, stems
from quillspan.functions.text import is_doc_path, occurrences, tokens
from quillspan.sources import files
from quillspan.sources.stored import stored

K1, B, SYMBOL_BOOST, DOC_PENALTY, PROXIMITY = 1.2, 0.75, 5.0, 0.7, 4.0
FIELDS = {"content": 1.0, "symbols": SYMBOL_BOOST}
#: Folders of postings; rows that a broadcast may hold.
FOLDERS, BROADCAST_ROWS = 64, 500_000


def _folder(stem: Column) -> Column:
    return F.pmod(F.xxhash64(stem), F.lit(FOLDERS)).cast("int")


def _if_few(few: bool, rows: DataFrame) -> DataFrame:
    return F.broadcast(rows) if few else rows


def _few(rows: DataFrame) -> DataFrame:
    return _if_few(rows.count() <= BROADCAST_ROWS, rows)


#: Of packed rows. A chunk's number is ``base`` and its ``off``, which is small and so stays small as the corpus grows; ``ends`` are where a chunk's places end in ``places``.
_POSTED = "field string, stem string, term string, base long, off array<int>, len array<int>, ends array<int>, places array<int>"
_TRIGRAMS = "trigram long, base long, off array<int>"
_PACKED = {"postings": _POSTED, "trigrams": _TRIGRAMS}


def _groups(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of equal keys begin, and where the last one ends."""
    starts = np.flatnonzero(np.diff(keys, prepend=keys[:1] - 1)) if len(keys) else np.zeros(0, np.int64)
    return starts, np.append(starts, len(keys))


def _lists(offsets: np.ndarray, values: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind))


def _parts(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, int, np.ndarray]]:
    """The batches (no, ...), cut where the numbers of another written partition begin, with the least number and the distances to it."""
    for batch in batches:
        no = batch.column(0).to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(no >> 33)) + 1).tolist(), len(no)]
        for a, b in zip(cuts, cuts[1:]):
            if b > a:
                base = int(no[a:b].min())
                yield batch.slice(a, b - a), base, no[a:b] - base


def _posted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Packed postings of batches (no, a list of words for each field)."""
    known: dict[str, str] = {}
    for batch, base, off in _parts(batches):
        for field in FIELDS:
            words = batch.column(field)
            size = pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            coded = words.flatten().dictionary_encode()
            if not len(coded):
                continue
            row = np.repeat(np.arange(len(off)), size)
            pos = np.arange(len(coded)) - np.repeat(np.cumsum(size) - size, size)
            key = coded.indices.to_numpy().astype(np.int64) * len(off) + row
            order = np.argsort(key, kind="stable")
            key = key[order]
            each, ends = _groups(key)  # a word in a chunk
            of_word, bounds = _groups(key[each] // len(off))
            own = row[order][each]
            code = (key[each] // len(off))[of_word]
            # ends of places within their word's row
            within = ends[1:] - np.repeat(ends[bounds[:-1]], np.diff(bounds))
            terms = coded.dictionary.to_pylist()
            for t in terms:
                if t not in known:
                    known[t] = stem(t)
            columns = [
                pa.array([field] * len(code), pa.string()), pa.array([known[terms[c]] for c in code], pa.string()), coded.dictionary.take(pa.array(code)),
                pa.array([base] * len(code), pa.int64()), _lists(bounds, off[own], pa.int32()), _lists(bounds, size[own], pa.int32()), _lists(bounds, within, pa.int32()), _lists(ends[bounds], pos[order], pa.int32()),
            ]
            yield pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in _POSTED.split(", ")])
        if len(known) > 1_000_000:
            known.clear()


def _trigram_keys(low: str) -> np.ndarray:
    """The different trigrams of a text, each as a number: three characters of 21 bits."""
    c = np.frombuffer(low.encode("utf-32-le", "replace"), "<u4").astype(np.int64)
    return np.unique(c[:-2] << 42 | c[1:-1] << 21 | c[2:])


def _trigrammed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Packed trigrams of batches (no, text in lower case)."""
    for batch, base, off in _parts(batches):
        found = [_trigram_keys(x or "") for x in batch.column(1).to_pylist()]
        key = np.concatenate([np.zeros(0, np.int64), *found])
        own = np.repeat(off, [len(x) for x in found])
        order = np.argsort(key, kind="stable")
        starts, bounds = _groups(key[order])
        yield pa.RecordBatch.from_arrays([pa.array(key[order][starts]), pa.array([base] * len(starts), pa.int64()), _lists(bounds, own[order], pa.int32())], ["trigram", "base", "off"])


@dataclass
class Index:
    """A stored index at a path."""

    spark: SparkSession
    path: str

    def _segments(self) -> int:
        n = 0
        while files.exists(self.spark, f"{self.path}/chunks/segment={n}/_SUCCESS"):
            n += 1
        return n

    def _table(self, table: str) -> DataFrame:
        """All rows of a table; of segments that do not have it yet it is made."""
        make = {"sizes": self._make_sizes, "postings": self._make_postings, "trigrams": self._make_trigrams}
        for n in range(self._segments() if table in make else 0):
            at = f"{self.path}/{table}/segment={n}"
            if not files.exists(self.spark, f"{at}/_SUCCESS"):
                make[table](self.spark.read.parquet(f"{self.path}/chunks/segment={n}"), at)
        read = self.spark.read.schema(f"{_PACKED[table]}, segment int, folder int") if table in _PACKED else self.spark.read
        return read.parquet(f"{self.path}/{table}")

    def _live(self, table: str) -> DataFrame:
        """The rows of a table with paths that no later segment has replaced."""
        rows = self._table(table)
        if not files.exists(self.spark, f"{self.path}/replaced"):
            return rows
        gone = self.spark.read.parquet(f"{self.path}/replaced").groupBy("path").agg(F.max("segment").alias("since"))
        return rows.join(_few(gone), "path", "left").where(F.col("since").isNull() | (F.col("segment") >= F.col("since"))).drop("since")

    def _words(self, chunks: DataFrame) -> DataFrame:
        return chunks.select("no", *(tokens(F.col(f)).alias(f) for f in FIELDS))

    def _make_sizes(self, chunks: DataFrame, at: str) -> None:
        size = F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.size(tokens(F.col(f))).alias("len")) for f in FIELDS))).alias("x")
        chunks.select("no", "path", "chunk_id", size).select("no", "path", "chunk_id", "x.*").write.mode("overwrite").parquet(at)

    def _make_postings(self, chunks: DataFrame, at: str) -> None:
        packed = self._words(chunks).mapInArrow(_posted, _POSTED).withColumn("folder", _folder(F.col("stem")))
        packed.hint("rebalance", "field", "folder").sortWithinPartitions("field", "folder", "stem", "term").write.mode("overwrite").partitionBy("field", "folder").parquet(at)

    def _make_trigrams(self, chunks: DataFrame, at: str) -> None:
        packed = chunks.select("no", F.lower("content").alias("text")).mapInArrow(_trigrammed, _TRIGRAMS).withColumn("folder", _folder(F.col("trigram")))
        packed.hint("rebalance", "folder").sortWithinPartitions("folder", "trigram").write.mode("overwrite").partitionBy("folder").parquet(at)

    def named(self, found: DataFrame, pool: DataFrame | None = None) -> DataFrame:
        """Rows ``found(segment, no, ...)`` with the paths and ids of their chunks, of live chunks only; of those in ``pool(chunk_id)`` only, if given."""
        names = self._live("sizes").where("field = 'content'").select("segment", "no", "path", "chunk_id")
        if pool is not None:
            few = pool.count() <= BROADCAST_ROWS
            names = names.join(_if_few(few, pool.select("chunk_id").distinct()), "chunk_id", "left_semi")
            names = _if_few(few, names)
        return found.join(names, ["segment", "no"])

    def postings(self) -> DataFrame:
        """A row for each field, word and live chunk that has it."""
        return self.named(unpacked(self._table("postings")))

    def chunks(self) -> DataFrame:
        return self._live("chunks").select("path", "chunk_id", "content", "symbols")

    def sizes(self) -> DataFrame:
        """(field, n, avg_len), a row a field."""
        return self._live("sizes").groupBy("field").agg(F.count("*").alias("n"), F.avg("len").alias("avg_len"))

    def add(self, chunks: DataFrame, replaces: DataFrame | None = None) -> None:
        """Another segment with the chunks; earlier rows of the paths in ``replaces(path)`` no longer count."""
        segment = self._segments()
        if replaces is not None and segment:
            replaces.select("path", F.lit(segment).alias("segment")).distinct().write.mode("append").parquet(f"{self.path}/replaced")
        rows = chunks.select("path", "chunk_id", "content", "symbols").withColumn("no", F.monotonically_increasing_id())
        rows.write.mode("overwrite").parquet(f"{self.path}/chunks/segment={segment}")


def unpacked(packed: DataFrame, *more: str) -> DataFrame:
    """Packed postings with a row a chunk: tf, len and the places of the word, with the columns ``more``."""
    each = packed.select("field", "segment", "stem", "term", *more, "base", "ends", "places", F.posexplode(F.arrays_zip("off", "len")).alias("i", "x"))
    each = each.withColumn("start", F.when(F.col("i") > 0, F.get("ends", F.col("i") - 1)).otherwise(0)).withColumn("tf", F.get("ends", F.col("i")) - F.col("start"))
    return each.select("field", "segment", "stem", "term", *more, (F.col("base") + F.col("x.off")).alias("no"), F.col("x.len").alias("len"), "tf", F.slice("places", F.col("start") + 1, F.col("tf")).alias("places"))


def index_of(chunks: DataFrame, path: str) -> Index:
    """The index at the path, made of the chunks if there is none."""
    index = Index(chunks.sparkSession, path)
    done = f"{path}/done"
    if not files.exists(index.spark, done):
        files.remove(index.spark, path)
        index.add(chunks)
        index.spark.range(1).write.parquet(done)
    return index


def query_terms(queries: DataFrame) -> DataFrame:
    """(query_id, term, stem, place), each term of a query once."""
    each = queries.select("query_id", F.posexplode(F.array_distinct(tokens(F.col("query")))).alias("place", "term"))
    return each.withColumn("stem", stems(F.col("term")))


@dataclass
class Asked:
    """The terms of queries, stored, with what is needed to search for them: the folders of their stems, and whether they are few enough to broadcast."""

    terms: DataFrame
    folders: list[int]
    few: bool
    most: int  # terms of a query

    def near(self, rows: DataFrame) -> DataFrame:
        """``rows`` are no more than the terms."""
        return _if_few(self.few, rows)

    def postings(self, index: Index, word: str, fields: tuple[str, ...]) -> DataFrame:
        """The index's packed postings of the terms: the folders' numbers prune the scan."""
        packed = index._table("postings").where(F.col("field").isin(*fields) & (F.col("folder").isin(*self.folders) if self.folders else F.lit(False)))
        return packed.join(self.near(self.terms.select(word).distinct()), word, "left_semi")


def asked(queries: DataFrame | Asked) -> Asked:
    if isinstance(queries, Asked):
        return queries
    terms = stored(query_terms(queries))
    by_query = terms.groupBy("query_id").agg(F.count("*").alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.max("n"), F.lit(0)).alias("most"))
    folders = terms.select(_folder(F.col("stem")).alias("f")).agg(F.sort_array(F.collect_set("f")).alias("f"))  # no more than FOLDERS numbers
    found = by_query.join(folders).first()
    return Asked(terms, found["f"], found["n"] <= BROADCAST_ROWS, found["most"])


def bm25(index: Index, queries: DataFrame | Asked, fields: tuple[str, ...] = ("content",), stemmed: bool = False) -> DataFrame:
    """(query_id, chunk_id, path, score): the fields' scores, each with its boost, added up; words of the same stem are one if ``stemmed``."""
    q = asked(queries)
    word = "stem" if stemmed else "term"
    wanted = q.terms.select("query_id", word).distinct()
    # stored, as it is used twice
    found = stored(index.named(unpacked(q.postings(index, word, fields)).drop("places")).select("field", word, "chunk_id", "path", "tf", "len"))
    if stemmed:
        found = found.groupBy("field", "stem", "chunk_id", "path").agg(F.sum("tf").alias("tf"), F.first("len").alias("len"))
    df = found.groupBy("field", word).agg(F.count("*").alias("df"))
    boost = F.lit(1.0)
    for field in fields:
        boost = F.when(F.col("field") == field, FIELDS[field]).otherwise(boost)
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.col("avg_len")))
    # df has a row a word and field, sizes one a field
    scored = found.join(F.broadcast(index.sizes()), "field").join(q.near(df), ["field", word]).withColumn("part", part * boost)
    return scored.join(q.near(wanted), word).groupBy("query_id", "chunk_id", "path").agg(F.sum("part").alias("score"))


def top(scored: DataFrame, k: int, by: str = "query_id") -> DataFrame:
    """The best k of each query: score down, then path and chunk up. Spark prunes each task to k rows a query before the shuffle."""
    order = Window.partitionBy(by).orderBy(F.desc("score"), "path", "chunk_id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def spans(index: Index, queries: DataFrame | Asked, pool: DataFrame | None = None) -> DataFrame:
    """(query_id, chunk_id, span): the least distance between places that cover all (two or more) terms of the query; of the pairs in ``pool(query_id, chunk_id)`` only, if given.

    At each place the last place of every term so far is at hand; the span is the distance to the earliest of them, so the work is linear in the places.
    """
    q = asked(queries)
    many = q.terms.groupBy("query_id").agg(F.count("*").alias("k")).where("k > 1")
    own = q.terms.join(q.near(many), "query_id").select("query_id", "term", "place", "k")
    found = index.named(unpacked(q.postings(index, "term", ("content",))), pool).join(q.near(own), "term")
    if pool is not None:
        found = found.join(_few(pool.select("query_id", "chunk_id")), ["query_id", "chunk_id"], "left_semi")
    places = found.select("query_id", "chunk_id", "place", "k", F.explode("places").alias("pos"))
    so_far = Window.partitionBy("query_id", "chunk_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    last = [f"last_{i}" for i in range(q.most)]
    if not last:
        return places.select("query_id", "chunk_id", F.col("pos").alias("span")).limit(0)
    seen = places.withColumns({c: F.when(F.col("k") > i, F.last(F.when(F.col("place") == i, F.col("pos")), True).over(so_far)).otherwise(F.col("pos")) for i, c in enumerate(last)})
    covered = seen.where(" and ".join(f"{c} is not null" for c in last))
    return covered.groupBy("query_id", "chunk_id").agg(F.min(F.col("pos") - F.least(*last, "pos")).alias("span"))


def ranked(index: Index, queries: DataFrame | Asked, k: int = 5, fields: tuple[str, ...] = tuple(FIELDS), stemmed: bool = True) -> DataFrame:
    """BM25 of the fields, the penalty of documentation paths, the proximity boost; best k of each query, out of eight times as many (200 at most)."""
    q = asked(queries)
    base = bm25(index, q, fields, stemmed)
    base = base.withColumn("score", F.when(is_doc_path(F.col("path")), F.col("score") * DOC_PENALTY).otherwise(F.col("score")))
    # stored, as it is used twice
    pool = stored(top(base, min(k * 8, 200)).drop("rank"))
    near = pool.join(spans(index, q, pool), ["query_id", "chunk_id"], "left")
    return top(near.withColumn("score", F.col("score") + F.coalesce(PROXIMITY / F.greatest("span", F.lit(1)), F.lit(0.0))), k)


def literal(chunks: DataFrame, needle: str, k: int = 5) -> DataFrame:
    """Chunks that contain the needle in any case, most occurrences first: a scan, for needles of any length."""
    hits = chunks.where(F.contains(F.lower("content"), F.lit(needle.lower()))).withColumn("score", occurrences(F.col("content"), needle))
    return hits.orderBy(F.desc("score"), "path", "chunk_id").limit(k)


def literal_indexed(index: Index, needle: str, k: int = 5) -> DataFrame:
    """As ``literal``, for a needle of three characters or more: chunks that have all its trigrams are candidates, and only their contents are searched.

    If the candidates are too many to broadcast the needle is no rare one, and all contents are searched where they are.
    """
    parts = [int(x) for x in _trigram_keys(needle.lower())]
    if not parts:
        return literal(index.chunks(), needle, k)
    folders = [r[0] for r in index.spark.createDataFrame([(x,) for x in parts], "x long").select(_folder(F.col("x"))).distinct().collect()]
    packed = index._table("trigrams").where(F.col("folder").isin(*folders) & F.col("trigram").isin(*parts))
    hits = stored(packed.select("segment", "base", F.explode("off").alias("off")).select("segment", (F.col("base") + F.col("off")).alias("no")).groupBy("segment", "no").agg(F.count("*").alias("n")).where(F.col("n") == len(parts)).drop("n"))
    if hits.count() > BROADCAST_ROWS:
        return literal(index.chunks(), needle, k)
    return literal(index._live("chunks").join(F.broadcast(hits), ["segment", "no"], "left_semi"), needle, k)


def grep(chunks: DataFrame, needle: str) -> DataFrame:
    ls = chunks.select("path", F.posexplode(F.split("content", "\n", -1)).alias("line", "text"))
    return ls.where(F.contains("text", F.lit(needle))).select("path", (F.col("line") + 1).alias("line"), "text")


def retrieval_metrics(results: DataFrame, relevant: DataFrame, k: int) -> DataFrame:
    """One row: mrr, precision_at_k, hit_rate, precision and recall of ``results(query_id, chunk_id, rank)`` against ``relevant(query_id, chunk_id)``, of the queries that have results."""
    truth = relevant.select("query_id", "chunk_id").distinct()
    hit = F.col("hit").isNotNull()
    by_query = results.join(truth.withColumn("hit", F.lit(1)), ["query_id", "chunk_id"], "left").groupBy("query_id").agg(
        F.min(F.when(hit, F.col("rank"))).alias("first"), F.count_if(hit & (F.col("rank") <= k)).alias("hits"), F.count_if(hit).alias("found"), F.count("*").alias("given")
    )
    all_ = truth.groupBy("query_id").agg(F.count("*").alias("relevant"))
    one = by_query.join(all_, "query_id", "left")
    mean = lambda c, name: F.round(F.avg(c), 6).alias(name)
    return one.agg(
        mean(F.coalesce(1 / F.col("first"), F.lit(0.0)), "mrr"),
        mean(F.col("hits") / k, "precision_at_k"),
        mean((F.col("found") > 0).cast("int"), "hit_rate"),
        mean(F.col("found") / F.col("given"), "precision"),
        mean(F.coalesce(F.col("found") / F.col("relevant"), F.lit(0.0)), "recall"),
    )
