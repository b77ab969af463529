"""Substring deduplication by automata of repeated phrases.

A window is ``WINDOW`` consecutive words of a document; a word goes if a window over it also starts in a document with a smaller
doc_id. All steps are exact up to collisions of 64-bit word hashes and 128-bit window hashes.

1. Scan. Of the ``GRAM``-word grams in each window the one with the least hash is its anchor; equal windows have equal anchors, and
   neighbouring windows mostly share theirs, so anchors are a sixteenth of the positions. Texts with equal words are one: all
   but the smallest doc_id lose every word if they have a window at all, and need no search.
2. Confirm. Anchors of at least two documents point at windows that may recur. Those windows' hashes, grouped, give each
   recurring window its first document. Runs of recurring windows in their first document are the passages.
3. Compile. Passages are dealt out as shards of bounded size. Of each passage, blocks of ``BLOCK`` words, one every
   ``WINDOW - BLOCK + 1``, go into the shard's Aho-Corasick automaton (any window holds a whole block), as ``LETTERS`` letters a word.
4. Locate. Each document is streamed through the automata of the shards that it has a recurring window of; each block that is met
   is extended over the words that agree with a passage, as far as windows over it reach, unless all of them are gone already. Stretches
   of a window or more, of a passage from a smaller doc_id, are removed. Shards that very many documents need are repeated for shares of them.

Anchors of more than ``HOT`` stretches are joined by a broadcast, so no task gathers what one of them has.

Null text has no words. Null doc_ids neither lose words nor take them. Repeated rows are treated alike and returned each.
Extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspan.llm.common import discard, partitions, read, stored, tidied

WINDOW, GRAM, BLOCK = 50, 20, 25
#: Passage windows of a shard (about an automaton's nodes), words of a chunk of a passage, documents that one copy of a shard serves.
SHARD_WINDOWS, CHUNK, SERVED = 250_000, 4096, 4000
#: Words beside a block that windows over it reach.
REACH = WINDOW - BLOCK
#: Letters of a word in an automaton, of a byte each, which keeps its nodes narrow; a block is met by 400 bits and then compared word by word.
LETTERS = 2
#: Stretches of an anchor beyond which it is joined by a broadcast.
HOT = 5000
#: Candidate documents whose ids are broadcast at most; beyond it texts are shuffled to meet them.
BROADCAST_IDS = 1_000_000

_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
NOTHING = hashlib.sha256(b"").hexdigest()


def word_hashes(words: list[bytes]) -> np.ndarray:
    import xxhash

    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def _powers(base: int, n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.concatenate([[np.uint64(1)], np.cumprod(np.full(n, base, np.uint64))])


_kept_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    if base not in _kept_powers or len(_kept_powers[base]) < n:
        _kept_powers[base] = _powers(base, max(n, 1 << 15))
    return _kept_powers[base][:n]


def gram_hashes(h: np.ndarray, n: int, base: int) -> np.ndarray:
    """A mixed 64-bit hash of each run of n words: a polynomial of the words' hashes."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        sums = np.concatenate([[np.uint64(0)], np.cumsum(h * _power(base, len(h)))])
        x = (sums[n:] - sums[:-n]) * _power(pow(base, -1, 1 << 64), len(h) - n + 1)
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xD6E8FEB86659FD93)
        x ^= x >> np.uint64(32)
    return x


def anchors(h: np.ndarray, window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """(anchor of a stretch of windows, first window of that stretch), for all windows in order."""
    if len(h) < window:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    grams = gram_hashes(h, gram, _BASES[0])
    at = np.lib.stride_tricks.sliding_window_view(grams, window - gram + 1).argmin(1) + np.arange(len(h) - window + 1)
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    return grams[at[first]], first


@tidied
def _scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n, sha, found, firsts = [], [], [], []
        for t in batch.column(1):
            words = (t.as_py() or "").encode().split()
            a, first = anchors(word_hashes(words))
            n.append(len(words))
            sha.append(hashlib.sha256(b" ".join(words)).hexdigest())
            found.append(a.view(np.int64))
            firsts.append(first.astype(np.int32))
        ends = pa.array(np.concatenate([[0], np.cumsum([len(x) for x in found])]), pa.int32())
        flat = lambda xs, k: pa.ListArray.from_arrays(ends, pa.array(np.concatenate([*xs, np.zeros(0, k)]).astype(k)))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(sha, pa.string()), flat(found, np.int64), flat(firsts, np.int32)], ["doc_id", "n_words", "sha", "anchors", "firsts"])


@tidied
def _windows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The 128-bit hashes of the windows from each of ``lows`` to before the next anchor's first (``highs``)."""
    for batch in batches:
        for rid, doc, text, lows, highs in zip(*(batch.column(i) for i in range(5))):
            h = word_hashes(text.as_py().encode().split())
            starts = np.concatenate([np.arange(a, b) for a, b in zip(lows.as_py(), highs.as_py())])
            x, y = (gram_hashes(h, WINDOW, b)[starts].view(np.int64) for b in _BASES)
            n = len(starts)
            yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y), pa.array(np.full(n, doc.as_py())), pa.array(np.full(n, rid.as_py())), pa.array(starts.astype(np.int32))], ["x", "y", "doc_id", "rid", "start"])


def _letters(words: np.ndarray) -> str:
    """The low bytes of each word's hash, those of the first, second, ... place from ranges of their own, so that blocks are met where words begin."""
    k = np.arange(LETTERS)
    bytes_ = (words[:, None] >> (8 * k).astype(np.uint64)).astype(np.uint8).astype(np.uint32)
    return (bytes_ + (256 * k + 1).astype(np.uint32)).astype("<u4").tobytes().decode("utf-32-le")


class _Shard:
    """An automaton over the blocks of the passages of a shard.

    All windows over a block lie within ``REACH`` words of it. So of each place where a block stands in a passage, it and that many words before and
    behind are kept, of equal ones those of the smallest doc_id; a document's words around a block that is met are compared with all of them at once.
    """

    def __init__(self):
        self.passages: list[tuple[int, np.ndarray]] = []
        self.automaton = None

    def add(self, doc: int, words: np.ndarray) -> None:
        self.passages.append((doc, words))

    def compile(self) -> None:
        import ahocorasick

        blocks: dict[str, dict[bytes, int]] = {}
        none = np.zeros(REACH, np.uint64)  # beyond a passage
        for doc, words in self.passages:
            letters, padded = _letters(words), np.concatenate([none, words, none])
            for at in range(0, len(words) - BLOCK + 1, WINDOW - BLOCK + 1):
                around = padded[at : at + 2 * REACH + BLOCK].tobytes()
                own = blocks.setdefault(letters[at * LETTERS : (at + BLOCK) * LETTERS], {})
                own[around] = min(doc, own.get(around, doc))
        self.passages = []
        self.automaton = ahocorasick.Automaton()
        for key, own in blocks.items():
            docs = np.fromiter(own.values(), np.int64, len(own))
            order = np.argsort(docs, kind="stable")
            around = np.frombuffer(b"".join(own), np.uint64).reshape(len(own), 2 * REACH + BLOCK)[order]
            self.automaton.add_word(key, (docs[order], around[:, REACH - 1 :: -1].copy(), around[:, REACH : REACH + BLOCK].copy(), around[:, REACH + BLOCK :].copy()))
        self.automaton.make_automaton()

    def locate(self, doc: int, words: np.ndarray) -> list[tuple[int, int]]:
        """Stretches of the document, of a window or more, that agree with a passage of a smaller doc_id."""
        if self.automaton is None:
            self.compile()
        if not len(self.automaton):
            return []
        found, gone = [], np.zeros(len(words), bool)
        none = np.ones(REACH, np.uint64)  # beyond the document; unlike what is beyond a passage
        padded = np.concatenate([none, words, none])
        for end, (docs, before, block, behind) in self.automaton.iter(_letters(words)):
            last = end // LETTERS
            first = last - BLOCK + 1
            if gone[max(0, first - REACH) : last + 1 + REACH].all():
                continue
            m = int(np.searchsorted(docs, doc))
            if not m:
                continue
            left, right = _agreeing(before[:m], padded[first + REACH - 1 : first - 1 if first else None : -1]), _agreeing(behind[:m], padded[last + 1 + REACH : last + 1 + 2 * REACH])
            # letters are a part of a word's hash: the block is compared whole
            whole = (left + right >= WINDOW - BLOCK) & (block[:m] == words[first : last + 1]).all(1)
            if whole.any():
                a, b = first - int(left[whole].max()), last + 1 + int(right[whole].max())
                found.append((a, b))
                gone[a:b] = True
        return found


def _agreeing(rows: np.ndarray, words: np.ndarray) -> np.ndarray:
    """How many words each row agrees with, from the first on."""
    differ = rows != words
    return np.where(differ.any(1), differ.argmax(1), rows.shape[1])


@tidied
def _locate(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows (shard, copy, kind, rid, doc_id, words): the passages of a copy of a shard, then the documents it serves."""
    key, shard = None, _Shard()
    for batch in batches:
        rid_out, a_out, b_out = [], [], []
        for s, copy, kind, rid, doc, words in zip(*(batch.column(i) for i in range(6))):
            if (s.as_py(), copy.as_py()) != key:
                key, shard = (s.as_py(), copy.as_py()), _Shard()
            ids = np.frombuffer(words.as_py(), np.uint64)
            if kind.as_py() == 0:
                shard.add(doc.as_py(), ids)
            elif found := shard.locate(doc.as_py(), ids):
                rid_out.append(rid.as_py())
                a_out.append([a for a, _ in found])
                b_out.append([b for _, b in found])
        yield pa.RecordBatch.from_arrays([pa.array(rid_out, pa.int64()), pa.array(a_out, pa.list_(pa.int32())), pa.array(b_out, pa.list_(pa.int32()))], ["rid", "a", "b"])


@tidied
def _passages(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of the windows that start at ``starts``, cut into chunks: rows (rid, doc_id, chunk, words)."""
    for batch in batches:
        out: list[list] = [[], [], [], []]
        for rid, doc, text, starts in zip(*(batch.column(i) for i in range(4))):
            h = word_hashes(text.as_py().encode().split())
            at = np.sort(np.asarray(starts.as_py(), np.int64))
            cut = np.flatnonzero((np.diff(at) > 1) | (np.diff(at // CHUNK) > 0)) + 1
            for run in np.split(at, cut):
                for column, value in zip(out, (rid.as_py(), doc.as_py(), int(run[0]) // CHUNK, h[run[0] : run[-1] + WINDOW].tobytes())):
                    column.append(value)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, (pa.int64(), pa.int64(), pa.int32(), pa.binary()))], ["rid", "doc_id", "chunk", "words"])


@tidied
def _hashed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = [word_hashes(t.as_py().encode().split()).tobytes() for t in batch.column(2)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ids, pa.binary())], ["rid", "doc_id", "words"])


def _cut(text: str, firsts: list[list[int]], lasts: list[list[int]]) -> tuple[list[bytes], list[bytes]]:
    """(all words, kept words)"""
    words = text.encode().split()
    gone = np.zeros(len(words) + 1, np.int64)
    for a, b in zip(firsts, lasts):
        np.add.at(gone, a, 1)
        np.add.at(gone, b, -1)
    keep = np.cumsum(gone[:-1]) == 0
    return words, [w for w, k in zip(words, keep.tolist()) if k]


def dedup_windows(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(scan, changed): a row per document (rid, doc_id, n_words, sha, first_doc), and a row per rid that loses words to passages (rid, n_removed, kept)."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    scan = stored(docs.mapInArrow(_scan, "doc_id long, n_words long, sha string, anchors array<long>, firsts array<int>").withColumn("rid", F.xxhash64("doc_id", "sha")))
    known = scan.where(F.col("doc_id").isNotNull() & (F.col("n_words") >= WINDOW))
    least = stored(known.groupBy("sha").agg(F.min("doc_id").alias("first_doc")))
    # of texts with equal words only the first is searched; repeated rows of it are one
    one = known.join(least, "sha").where("doc_id = first_doc").dropDuplicates(["rid"]).select("rid", "doc_id", "n_words", "anchors", "firsts")
    stretches = stored(
        one.select("rid", "doc_id", "n_words", F.explode(F.arrays_zip("anchors", "firsts", F.concat(F.slice("firsts", 2, 1 << 30), F.array((F.col("n_words") - WINDOW + 1).cast("int"))).alias("nexts"))).alias("s")).select("rid", "doc_id", F.col("s.anchors").alias("anchor"), F.col("s.firsts").alias("low"), F.col("s.nexts").alias("high"))
    )
    again = stored(stretches.groupBy("anchor").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.count("*").alias("n")).where("lo < hi").select("anchor", "n"))
    hot = again.where(F.col("n") > HOT).select("anchor")
    met = stored(_by_anchor(stretches, again.select("anchor"), hot))
    where = stored(met.groupBy("rid", "doc_id").agg(F.collect_list("low").alias("lows"), F.collect_list("high").alias("highs")))
    discard(stretches, met, again)
    ids = where.select("doc_id").distinct()
    n = where.count()
    texts = docs.join(F.broadcast(ids) if n <= BROADCAST_IDS else ids, "doc_id", "left_semi") if n else docs.limit(0)
    # the scan's row is found again by the same hash of its words
    named = texts.withColumn("rid", F.xxhash64("doc_id", F.sha2(joined_words("text"), 256))).dropDuplicates(["rid"])
    chosen = stored(named.join(where.drop("doc_id"), "rid").select("rid", "doc_id", "text", "lows", "highs"))
    discard(where)
    windows = chosen.mapInArrow(_windows, "x long, y long, doc_id long, rid long, start int")
    firsts = windows.groupBy("x", "y").agg(F.min(F.struct("doc_id", "rid", "start")).alias("first"), F.max("doc_id").alias("hi")).where("first.doc_id < hi")
    firsts = stored(firsts.select("x", "y", F.col("first.doc_id").alias("from_doc"), F.col("first.rid").alias("from_rid"), F.col("first.start").alias("from_start")))
    shards = max(1, -(-firsts.count() // SHARD_WINDOWS))
    shard = lambda rid, chunk: F.pmod(F.xxhash64(rid, chunk), F.lit(shards)).cast("int")
    starts = firsts.groupBy(F.col("from_rid").alias("rid")).agg(F.collect_list("from_start").alias("starts"))
    passages = chosen.select("rid", "doc_id", "text").join(starts, "rid").mapInArrow(_passages, "rid long, doc_id long, chunk int, words binary").withColumn("shard", shard("rid", "chunk"))
    # a window has one first document, so each is at one shard
    routes = windows.join(firsts, ["x", "y"]).where("doc_id > from_doc").select("rid", shard("from_rid", F.floor(F.col("from_start") / CHUNK).cast("int")).alias("shard"))
    routes = stored(routes.distinct())
    copies = routes.groupBy("shard").agg(F.ceil(F.count("*") / SERVED).cast("int").alias("copies"))  # a row per shard
    few = shards <= BROADCAST_IDS
    if few:
        copies = copies.withColumn("base", F.coalesce(F.sum("copies").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    copies = stored(copies)
    dealt = F.broadcast(copies) if few else copies
    hashed = chosen.select("rid", "doc_id", "text").mapInArrow(_hashed, "rid long, doc_id long, words binary")
    unit = [F.col("base").cast("int").alias("base")] if few else []
    served = hashed.join(routes, "rid").join(dealt, "shard").select("shard", F.pmod("rid", "copies").cast("int").alias("copy"), F.lit(1).alias("kind"), "rid", "doc_id", "words", *unit)
    compiled = passages.join(dealt, "shard").select("shard", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("copy"), F.lit(0).alias("kind"), "rid", "doc_id", "words", *unit)
    rows = compiled.unionByName(served)
    if few:  # each copy of a shard is a task
        rows = rows.repartitionById(max(1, copies.agg(F.sum("copies")).first()[0] or 1), (F.col("base") + F.col("copy")).cast("int")).drop("base")
    else:
        rows = rows.repartition(partitions(spark), "shard", "copy")
    rows = rows.sortWithinPartitions("shard", "copy", "kind")
    found = rows.mapInArrow(_locate, "rid long, a array<int>, b array<int>")
    by_doc = found.groupBy("rid").agg(F.collect_list("a").alias("a"), F.collect_list("b").alias("b"))

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            gone, kept = [], []
            for text, a, b in zip(*(batch.column(i) for i in range(1, 4))):
                words, left = _cut(text.as_py(), a.as_py(), b.as_py())
                gone.append(len(words) - len(left))
                kept.append(b" ".join(left))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(gone, pa.int64()), pa.array(kept, pa.binary())], ["rid", "n_removed", "kept"])

    changed = chosen.select("rid", "text").join(by_doc, "rid").mapInArrow(cut, "rid long, n_removed long, kept binary")
    return scan.drop("anchors", "firsts").join(least, "sha", "left"), changed


def _by_anchor(rows: DataFrame, keys: DataFrame, hot: DataFrame) -> DataFrame:
    """``rows`` and ``keys`` joined on anchor; what is of the hot anchors stays where it is and meets a broadcast, if that is small enough."""
    often = keys.join(hot, "anchor", "left_semi")
    n = often.count()
    if not n or n > BROADCAST_IDS:
        return rows.join(keys, "anchor")
    names = F.broadcast(often.select("anchor").distinct())
    return rows.join(F.broadcast(often), "anchor").unionByName(rows.join(names, "anchor", "left_anti").join(keys.join(names, "anchor", "left_anti"), "anchor"))


def joined_words(text: str):
    """The words of a text with single spaces between them, as the scan joins them."""
    return F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " "), r"^ | \z", "")


def op7_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    scan, changed = dedup_windows(read(spark, sf_dir, "documents"))
    changed = changed.select("rid", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
    copy = F.coalesce(F.col("doc_id") > F.col("first_doc"), F.lit(False))
    return scan.join(changed, "rid", "left").select(
        "doc_id",
        "n_words",
        F.when(copy, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(copy, F.lit(NOTHING)).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"),
    )


QUERIES = {"op7_phrases": op7_phrases}
ORACLE_SQL: dict[str, str] = {}
