"""Near-duplicate documents by Order MinHash.

A document is the sequence of its ``GRAM``-word k-mers, each labelled with its occurrence, so that no two are equal. Under each of
``SKETCHES`` hash functions the ``TAKEN`` labelled k-mers of least hash are sampled and put back into their text order; the hash of
that row is one sketch value. Two documents agree in a value if they share those k-mers and have them in the same order, so
agreement falls with insertions, deletions and moves. Documents that agree in ``AGREE`` values at least are candidates. At
similarity 0.8 a value agrees with a chance of 0.51 in long texts, and fewer than ``AGREE`` of the 24 do with a chance under 2 in
10,000. The k-mers are drawn without replacement, so in short texts a value agrees less often: with 0.4 where 4 of 5 k-mers are
shared (8 against 9 words), the worst case, and such a pair is missed with a chance of 0.0035; with 0.467 for 8 of 10 (0.00045).

Candidates are verified by banded alignment: L, the longest common subsequence of the labelled k-mers, over the cells that at
most (n + m) / 9 insertions and deletions can reach, and the pair links if L / (n + m - L) is at least ``NUM / DEN``. As labelled k-mers
are unique, the alignment is a longest increasing run of matched places, in O(n log n).

1. Texts of equal words are one, the smallest doc_id, with any number of copies.
2. Each document names the earlier one (by doc_id) that agrees with it most; those pairs are verified first and join most of a group.
3. Where documents of different classes still meet in a sketch value, all their candidate pairs are verified in place, in blocks,
   and only the links leave the task. No link between candidates of different classes is left out.

Documents of fewer than ``GRAM`` words link with equal ones only; texts without words, null ones included, with none. A row
with a null doc_id belongs to the class of its text's smallest doc_id, null if there is none. Repeated rows are copies. Extra
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspan.llm.common import components, discard, partitions, read, spare, stored, text_batches, tidied
from quillspan.llm.flat import mix
from quillspan.llm.phrases import gram_hashes, joined_words, word_hashes

GRAM, SKETCHES, TAKEN, AGREE = 5, 24, 3, 4
NUM, DEN = 4, 5
#: Documents of a bucket that one task compares, and pairs of one earlier document that one copy of its text serves.
BLOCK, SERVED = 1024, 500
BROADCAST_DOCS = 1_000_000
_BASE = 0x9E3779B97F4A7C15
_LAST = (1 << 63) - 1
_SEEDS = mix(np.arange(1, SKETCHES + 1, dtype=np.uint64) * np.uint64(_BASE))


def labelled(words: list[bytes]) -> np.ndarray:
    """Hashes of the k-mers in text order, each with the number of its occurrence: all different."""
    g = gram_hashes(word_hashes(words), GRAM, _BASE)
    if not len(g):
        return g
    order = np.argsort(g, kind="stable")
    s = g[order]
    begins = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
    if len(begins) == len(g):
        return g
    seen = np.empty(len(g), np.uint64)
    seen[order] = np.arange(len(g)) - np.repeat(begins, np.diff(np.concatenate([begins, [len(g)]])))
    return np.where(seen > 0, mix(g + seen * np.uint64(_BASE)), g)


def sketch(kmers: np.ndarray) -> np.ndarray:
    """``SKETCHES`` values, as signed 64-bit integers."""
    n = min(TAKEN, len(kmers))
    at = np.empty((SKETCHES, n), np.int64)
    step = max(1, (1 << 20) // len(kmers))  # hash functions at once, so that long texts take no more memory
    for i in range(0, SKETCHES, step):
        h = (kmers[None, :] ^ _SEEDS[i : i + step, None]) * np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        at[i : i + step] = np.argpartition(h, n - 1, 1)[:, :n]
    picked = kmers[np.sort(at, 1)]
    value = _SEEDS
    for k in range(n):
        value = mix(value * np.uint64(31) + picked[:, k])
    return value.view(np.int64)


def similar(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether the labelled k-mers of two documents are similar enough, by banded alignment."""
    n, m = len(x), len(y)
    need = -(-NUM * (n + m) // (NUM + DEN))
    if not n or not m or min(n, m) < need:
        return False
    _, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    order = np.argsort(i)
    i, j = i[order], j[order]
    j = j[np.abs(i - j) <= n + m - 2 * need]  # outside the band too much is inserted or deleted
    if len(j) < need:
        return False
    if (np.diff(j) > 0).all():
        return True
    tails: list[int] = []
    for k in j.tolist():
        at = bisect_left(tails, k)
        if at == len(tails):
            tails.append(k)
        else:
            tails[at] = k
    return len(tails) >= need


@tidied
def _scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    none = np.zeros(0, np.int64)
    for batch in batches:
        sha, rows = [], []
        for t in batch.column(1):
            words = (t.as_py() or "").encode().split()
            sha.append(hashlib.sha256(b" ".join(words)).digest() if words else None)
            rows.append(sketch(k) if len(k := labelled(words)) else none)
        ends = pa.array(np.concatenate([[0], np.cumsum([len(r) for r in rows])]), pa.int32())
        sketches = pa.ListArray.from_arrays(ends, pa.array(np.concatenate([*rows, none])))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sha, pa.binary()), sketches], ["doc_id", "sha", "sketch"])


def _buckets(one: DataFrame) -> DataFrame:
    """``one(doc, sketch)`` dealt out by sketch value (key) and pair of blocks; values of one document are left out.

    Values meet as bare (key, doc) rows; the sketches join only those that have met.
    """
    keys = one.select(F.explode("sketch").alias("key"), "doc", "first")
    sizes = keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    dealt = keys.join(sizes, "key").withColumn("block", F.pmod(F.xxhash64("doc"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return dealt.select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "doc", "first")


def _in_order(dealt: DataFrame, columns: list[str]) -> DataFrame:
    return dealt.select("key", "i", "j", "block", "doc", "first", *columns).repartition(partitions(dealt.sparkSession), "key", "i", "j").sortWithinPartitions("key", "i", "j", "first", "doc")


def _groups(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables that hold whole groups of equal (key, i, j)."""
    left: pa.Table | None = None
    for batch in batches:
        now = pa.Table.from_batches([batch])
        left = pa.concat_tables([left, now]) if left is not None else now
        key, i, j = (left.column(k).to_numpy() for k in range(3))
        other = np.flatnonzero((key != key[-1]) | (i != i[-1]) | (j != j[-1])) if len(key) else []
        if len(other):
            yield left.slice(0, int(other[-1]) + 1).combine_chunks()
            left = left.slice(int(other[-1]) + 1)
    if left is not None and len(left):
        yield left.combine_chunks()


def _meetings(table: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(later, earlier, agreeing values) of the rows that meet and agree enough, for one distance between rows after another."""
    key, i, j, block = (table.column(k).to_numpy() for k in range(4))
    sketches = table.column("sketch").combine_chunks().flatten().to_numpy().reshape(len(key), SKETCHES)
    first = np.concatenate([[True], (key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])])
    begins = np.flatnonzero(first)
    place = np.arange(len(key)) - np.repeat(begins, np.diff(np.concatenate([begins, [len(key)]])))
    who = np.flatnonzero(place > 0)
    for back in range(1, int(place.max(initial=0)) + 1):
        who = who[place[who] >= back]
        c = who[(i[who] == j[who]) | (block[who] != block[who - back])]
        agree = (sketches[c] == sketches[c - back]).sum(1)
        some = agree >= AGREE
        yield c[some], c[some] - back, agree[some]


@tidied
def _best(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of the documents met in a bucket, the earlier one that agrees most."""
    for table in _groups(batches):
        doc = table.column("doc").to_numpy()
        most, best = np.zeros(len(doc), np.int64), np.zeros(len(doc), np.int64)
        for c, b, agree in _meetings(table):
            better = agree >= most[c]  # of equal ones the earliest
            most[c[better]], best[c[better]] = agree[better], doc[b[better]]
        found = np.flatnonzero(most)
        yield pa.RecordBatch.from_arrays([pa.array(doc[found]), pa.array(best[found]), pa.array(most[found])], ["b", "a", "agree"])


@tidied
def _verify(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows (a, copy, kind, b, text): an earlier document's text, then the later ones to verify against it."""
    mine, kmers = None, None
    for batch in batches:
        left, right = [], []
        for a, copy, kind, b, text in zip(*(batch.column(k) for k in range(5))):
            own = labelled(text.as_py().encode().split())
            if kind.as_py() == 0:
                mine, kmers = a.as_py(), own
            elif mine == a.as_py() and similar(kmers, own):
                left.append(mine)
                right.append(b.as_py())
        yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], ["a", "b"])


def _first_met(c: np.ndarray, b: np.ndarray, key: np.ndarray, sketches: np.ndarray) -> np.ndarray:
    """Which pairs have met in the first value they agree in: each pair is looked at there only."""
    return sketches[c, (sketches[c] == sketches[b]).argmax(1)] == key[c]


@tidied
def _open(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows (key, i, j, block, doc, first) that candidates of another class meet there."""
    for table in _groups(batches):
        key, root = table.column("key").to_numpy(), table.column("root").to_numpy()
        sketches = table.column("sketch").combine_chunks().flatten().to_numpy().reshape(len(key), SKETCHES)
        wanted = np.zeros(len(key), bool)
        for c, b, _ in _meetings(table):
            differ = root[c] != root[b]
            c, b = c[differ], b[differ]
            some = _first_met(c, b, key, sketches)
            wanted[c[some]] = wanted[b[some]] = True
        found = table.select(["key", "i", "j", "block", "doc", "first"]).filter(pa.array(wanted))
        yield from found.to_batches()


def _enough(x: np.ndarray, others: Iterable[np.ndarray]) -> Iterator[bool]:
    """For each of the others, whether it shares as many k-mers with ``x`` as ``similar`` wants aligned: the rest needs no alignment."""
    x = np.sort(x)

    def of(some: list[np.ndarray]) -> Iterator[bool]:
        sizes = np.array([len(y) for y in some])
        flat = np.concatenate(some)
        met = np.append(0, np.cumsum(x[np.minimum(np.searchsorted(x, flat), len(x) - 1)] == flat))
        ends = np.cumsum(sizes)
        yield from (met[ends] - met[ends - sizes] >= -(-NUM * (len(x) + sizes) // (NUM + DEN))).tolist()

    some: list[np.ndarray] = []
    size = 0
    for y in others:
        some.append(y)
        size += len(y)
        if size >= 1 << 20:  # so that long texts take no more memory
            yield from of(some)
            some, size = [], 0
    if some:
        yield from of(some)


@tidied
def _rest(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links between documents of different classes that meet in a bucket; a pair is verified where it first agrees, or not at all once it is connected."""
    for table in _groups(batches):
        key, i, j, block, doc, root = (table.column(k).to_numpy() for k in ("key", "i", "j", "block", "doc", "root"))
        texts = table.column("text")
        sketches = table.column("sketch").combine_chunks().flatten().to_numpy().reshape(len(key), SKETCHES)
        root = root.copy()  # follows the links
        first = np.concatenate([[True], (key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])])
        begins = np.maximum.accumulate(np.where(first, np.arange(len(key)), 0))
        kept: dict[int, np.ndarray] = {}

        def kmers(k: int) -> np.ndarray:
            if k not in kept:
                kept[k] = labelled(texts[k].as_py().encode().split())
            return kept[k]

        left, right = [], []
        for x, begin in enumerate(begins.tolist()):
            others = slice(begin, x)
            same = sketches[others] == sketches[x]
            some = (root[others] != root[x]) & (same.sum(1) >= AGREE) & ((i[x] == j[x]) | (block[others] != block[x]))
            b = begin + np.flatnonzero(some)
            b = b[_first_met(np.full(len(b), x), b, key, sketches)]
            for y, enough in zip(b.tolist(), _enough(kmers(x), map(kmers, b.tolist())) if len(b) else ()):
                if enough and root[x] != root[y] and similar(kmers(x), kmers(y)):
                    root[root == max(root[x], root[y])] = min(root[x], root[y])
                    left.append(int(doc[y]))
                    right.append(int(doc[x]))
        yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], ["a", "b"])


def near_documents(docs: DataFrame, row: Column | None = None) -> DataFrame:
    """(doc_id, class_id, row, class) of every row of ``docs``.

    class_id is the smallest doc_id reachable by links; row, a number of its own, tells repeated rows apart; class is a
    number of the class itself, null without words, for where doc_ids are not unique and one doc_id is in several classes.
    """
    row = F.monotonically_increasing_id() if row is None else row
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", row.alias("row"))

    def of(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for out in _scan([batch]):
                yield pa.RecordBatch.from_arrays([*out.columns, batch.column(2)], ["doc_id", "sha", "sketch", "row"])

    scan = stored(docs.mapInArrow(of, "doc_id long, sha binary, sketch array<long>, row long"))
    # texts are told apart by a number of their words' own (doc), in the order of their least doc_id (first)
    doc = F.xxhash64("sha").alias("doc")
    firsts = stored(scan.where("sha is not null").groupBy("sha").agg(F.min("doc_id").alias("first")).select("sha", "first", doc))
    least = F.coalesce("first", F.lit(_LAST))
    # one row of each text: rows of the same text have the same sketch
    one = scan.where(F.size("sketch") > 0).join(firsts, "sha").where(F.col("doc_id").eqNullSafe(F.col("first"))).select("doc", least.alias("first"), "sha", "sketch")
    one = stored(one.dropDuplicates(["doc"]))
    met = stored(_buckets(one))
    sketches = one.select("doc", "sketch")
    best = _in_order(met.join(sketches, "doc"), ["sketch"]).mapInArrow(_best, "b long, a long, agree long")
    pairs = stored(best.groupBy("b").agg(F.max_by("a", F.struct("agree", "a")).alias("a")))
    rows = stored(one.join(met.select("doc").distinct(), "doc", "left_semi").select("doc", "first", "sha"))
    texts = docs.select(F.coalesce("doc_id", F.lit(_LAST)).alias("first"), "text")
    some = rows.select("first").distinct()
    texts = texts.join(F.broadcast(some) if rows.count() <= BROADCAST_DOCS else some, "first", "left_semi")
    # of rows with the doc_id, one with the text that was scanned
    chosen = stored(texts.withColumn("sha", F.unhex(F.sha2(joined_words("text"), 256))).join(rows, ["first", "sha"]).dropDuplicates(["doc"]).select("doc", "text"))
    copies = stored(pairs.groupBy("a").agg(F.ceil(F.count("*") / SERVED).cast("int").alias("copies")))
    later = chosen.withColumnRenamed("doc", "b").join(pairs, "b").join(copies, "a").select("a", F.pmod(F.xxhash64("b"), "copies").cast("int").alias("copy"), F.lit(1).alias("kind"), "b", "text")
    earlier = chosen.withColumnRenamed("doc", "a").join(copies, "a").select("a", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("copy"), F.lit(0).alias("kind"), F.col("a").alias("b"), "text")
    together = earlier.unionByName(later).repartition(partitions(docs.sparkSession), "a", "copy").sortWithinPartitions("a", "copy", "kind")
    links = stored(together.mapInArrow(_verify, "a long, b long"))
    discard(pairs, rows, copies)
    roots = components(links)
    named = met.join(roots.withColumnRenamed("node", "doc"), "doc", "left").withColumn("root", F.coalesce("root", "doc"))
    # buckets (of two blocks) where classes still differ
    open_ = named.groupBy("key", "i", "j").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x < y").select("key", "i", "j")
    sketched = named.join(open_, ["key", "i", "j"]).join(sketches, "doc")
    # texts follow only to where candidates of different classes meet
    needed = stored(_in_order(sketched, ["root", "sketch"]).mapInArrow(_open, "key long, i int, j int, block int, doc long, first long"))
    discard(met)
    open_rows = needed.join(roots.select(F.col("node").alias("doc"), "root"), "doc", "left").withColumn("root", F.coalesce("root", "doc")).join(sketches, "doc").join(chosen, "doc")
    more = stored(_in_order(open_rows, ["root", "sketch", "text"]).mapInArrow(_rest, "a long, b long"))
    discard(one, chosen, needed, roots)
    roots = components(links.union(more))
    discard(links, more)
    # the class's own number is that of its least text by number; its class_id is the least doc_id of its texts
    members = roots.select(F.col("node").alias("doc"), "root").union(roots.select(F.col("root").alias("doc"), "root").distinct())
    named = firsts.join(members, "doc").select("sha", "root", "first")
    linked = named.join(named.groupBy("root").agg(F.min("first").alias("class_id")), "root").select("sha", "root", "class_id")
    classes = firsts.join(linked, "sha", "left").select("sha", F.coalesce("root", "doc").alias("class"), F.when(F.col("root").isNull(), F.col("first")).otherwise(F.col("class_id")).alias("class_id"))
    # texts without words are in a class of their own
    return scan.select("doc_id", "sha", "row").join(classes, "sha", "left").select("doc_id", F.when(F.col("sha").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), "row", "class")


def dedup_documents(docs: DataFrame) -> DataFrame:
    """The documents, of each class one: the row of the smallest doc_id, of repeated rows one.

    Rows without words are of one class if they have the same doc_id; those of a null doc_id all stay.
    """
    text_batches(docs.sparkSession)
    row = spare(docs.columns, "row")
    docs = stored(docs.withColumn(row, F.monotonically_increasing_id()))
    near = stored(near_documents(docs, F.col(row)))
    group = ["class", F.when(F.col("class").isNull(), F.col("doc_id")).alias("own")]
    real = near.where(F.col("class").isNotNull() | F.col("doc_id").isNotNull()).select("row", F.coalesce("doc_id", F.lit(_LAST)).alias("doc_id"), *group)
    stays = real.groupBy("class", "own").agg(F.min(F.struct("doc_id", "row")).alias("least")).select("least.row")
    gone = stored(real.select("row").join(stays, "row", "left_anti"))
    discard(near)
    gone_ = gone.withColumnRenamed("row", row)
    return docs.join(F.broadcast(gone_) if gone.count() <= BROADCAST_DOCS else gone_, row, "left_anti").drop(row)


def op4_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = near_documents(read(spark, sf_dir, "documents"))
    return near.select("doc_id", "class_id", F.coalesce(F.col("doc_id") == F.col("class_id"), F.lit(False)).alias("kept"))


QUERIES = {"op4_order_minhash": op4_order_minhash}
ORACLE_SQL: dict[str, str] = {}
