"""Best-two-fit packing of documents into sequences of a fixed number of tokens.

A document is its ids and an end id. Only longer ones are cut, into full pieces behind a first piece that takes the remainder,
so each document has at most one piece that does not fill a sequence. Packing looks at nothing but lengths, of which there are
fewer than ``capacity``: the plan needs the count of each length, not the documents. ``plan`` fills a bin greedily with the
largest lengths that fit, then replaces its smallest piece by two unpacked ones that fill the widened gap more tightly. As
the choice depends only on which lengths are left, the same bin is repeated until one of its lengths runs short: exactly what
packing bin after bin would do, in a number of steps bound by the capacity and not by the documents.

Pieces are ranked within their length without gathering a length anywhere: each task counts its own pieces by length, and a
running sum over the tasks' counts gives each task its first rank. A piece finds its bin by its rank in the plan.

Null or empty text is a document of the end id alone. Null and repeated doc_ids are packed like others (rows, not ids, are
packed); extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspan.llm.bpe import codec, vocabulary_path
from quillspan.llm.common import read, stored, tidied

CAPACITY, END_ID = 1024, 2


def _two_that_fit(left: list[int], counts: list[int], least: int, most: int) -> tuple[int, int] | None:
    """The pair of unpacked lengths with the largest sum over ``least`` and up to ``most``; of equal sums, the longest first."""
    best, found, low = least, None, 0
    for i in range(bisect_right(left, most - 1) - 1, -1, -1):
        a = left[i]
        if 2 * a <= best:
            break
        j = bisect_right(left, min(a, most - a)) - 1
        if j == i and counts[a] < 2:
            j -= 1
        if j >= low and a + left[j] > best:
            best, found = a + left[j], (a, left[j])
            if best == most:
                break
    return found


def plan(counts: list[int], capacity: int) -> list[tuple[list[int], int]]:
    """Bins as (lengths in their order, repeats) for ``counts[length]`` pieces of each length."""
    counts = list(counts)
    left = [n for n in range(1, capacity + 1) if counts[n]]
    bins = []

    def take(n: int, by: int) -> None:
        counts[n] -= by
        if not counts[n]:
            del left[bisect_left(left, n)]
        elif counts[n] == by and by < 0:
            left.insert(bisect_left(left, n), n)

    while left:
        own, gap = [], capacity
        while gap and left and left[0] <= gap:
            n = left[bisect_right(left, gap) - 1]
            k = min(counts[n], gap // n)
            own += [n] * k
            gap -= n * k
            take(n, k)
        if gap and (two := _two_that_fit(left, counts, own[-1], gap + own[-1])):
            back = own.pop()
            counts[back] += 1
            if counts[back] == 1:
                left.insert(bisect_left(left, back), back)
            for n in two:
                take(n, 1)
            own += two
        used = Counter(own)
        more = min(counts[n] // k for n, k in used.items())
        if more:
            for n, k in used.items():
                take(n, k * more)
        bins.append((own, 1 + more))
    return bins


class _Places:
    """Where the piece of a length and rank goes: parallel arrays over runs of ranks, a few for each repeated bin."""

    def __init__(self, bins: list[tuple[list[int], int]], capacity: int):
        at, first, rows, offsets = [0] * (capacity + 1), 0, [], []
        for own, repeats in bins:
            places: dict[int, list[int]] = {}
            place = 0
            for n in own:
                places.setdefault(n, []).append(place)
                place += n
            for n, where in places.items():
                rows.append((n, at[n], first, len(where), len(offsets)))
                offsets += where
                at[n] += len(where) * repeats
            first += repeats
        rows.sort()
        self.n, self.start, self.first, self.each, self.offset = (np.array(c, np.int64) for c in (zip(*rows) if rows else [[]] * 5))
        self.offsets, self.bins = np.array(offsets, np.int64), first
        self.keys = (self.n << 48) + self.start

    def of(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        i = np.searchsorted(self.keys, (length << 48) + rank, "right") - 1
        k = rank - self.start[i]
        return self.first[i] + k // self.each[i], self.offsets[self.offset[i] + k % self.each[i]]


def pieces(docs: DataFrame, capacity: int = CAPACITY, end_id: int = END_ID, path: str | None = None, keep_ids: bool = False) -> DataFrame:
    """A row per piece: doc_id, piece, start, length, ids_crc32, part and slot (its task and its number among the task's pieces of that length); with ``keep_ids`` also ids."""
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, slot long" + ", ids binary" * keep_ids

    @tidied
    def of(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        own = codec(vocabulary_path(path))
        # the same ids as the tokenizers library gives for this file, at several times its speed
        fast = tiktoken.Encoding("own", pat_str=own.pattern.pattern, mergeable_ranks=own.ranks, special_tokens=own.special)
        end = np.array([end_id], "<u4")
        part, slots = TaskContext.get().partitionId(), [0] * (capacity + 1)
        for batch in batches:
            out: list[list] = [[] for _ in range(8)]
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = np.concatenate([fast.encode_to_numpy(text.as_py() or "", allowed_special="all").astype("<u4"), end])
                to = (len(ids) - 1) % capacity + 1
                start = number = 0
                while start < len(ids):
                    raw = ids[start:to].tobytes()
                    for column, value in zip(out, (doc, number, start, to - start, zlib.crc32(raw), part, slots[to - start], raw if keep_ids else None)):
                        column.append(value)
                    slots[to - start] += 1
                    start, to, number = to, to + capacity, number + 1
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary()]
            n = 7 + keep_ids
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out[:n], kinds)], [x.split()[0] for x in schema.split(", ")])

    return docs.select("doc_id", "text").mapInArrow(of, schema)


def pack(docs: DataFrame, capacity: int = CAPACITY, end_id: int = END_ID, path: str | None = None, keep_ids: bool = False) -> DataFrame:
    """A row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids).

    Sequences of one full piece have negative numbers, packed ones count from 0.
    """
    cut = stored(pieces(docs, capacity, end_id, path, keep_ids))
    by_part = cut.where(F.col("length") < capacity).groupBy("part", "length").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = stored(by_part.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))))
    counts = [0] * (capacity + 1)
    for row in base.groupBy("length").agg(F.sum("n").alias("n")).collect():  # a row per length at most
        counts[row.length] = row.n
    places = _Places(plan(counts, capacity), capacity)

    @F.arrow_udf("struct<sequence_id: long, offset: long>")
    def place(length: pa.Array, slot: pa.Array, part: pa.Array, base: pa.Array) -> pa.Array:
        n, s, p, b = (np.asarray(x.fill_null(0)).astype(np.int64) for x in (length, slot, part, base))
        sequence, offset = -1 - ((p << 32) + s), np.zeros(len(n), np.int64)
        short = n < capacity
        sequence[short], offset[short] = places.of(n[short], b[short] + s[short])
        return pa.StructArray.from_arrays([pa.array(sequence), pa.array(offset)], ["sequence_id", "offset"])

    full = cut.where(F.col("length") == capacity).withColumn("base", F.lit(0).cast("long"))
    short = cut.where(F.col("length") < capacity).join(base.drop("n"), ["part", "length"])
    both = short.unionByName(full).withColumn("to", place("length", "slot", "part", "base"))
    return both.select("doc_id", "piece", "start", "length", "ids_crc32", "to.sequence_id", "to.offset", *["ids"] * keep_ids)


def op3_best_two_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read(spark, sf_dir, "documents"))


QUERIES = {"op3_best_two_fit": op3_best_two_fit}
ORACLE_SQL: dict[str, str] = {}
