"""Line deduplication by an exact set-similarity join.

A line is the set of its words. A line goes if a line before it (by doc_id, then place) has a Jaccard similarity of at least
4/5 with it; lines are judged on the input, not on what is left. Lines without a word stay.

1. Words are counted over all documents, in ``BUCKETS`` counters by hash, which gives words an order from rare to common (any
   fixed order is exact; rarity makes it fast). The table of counters has one size however much text there is.
2. Lines of equal sets are one set with its first place: first those that a task holds, then, dealt out by set, all. What is
   not at the first place goes, and needs no comparison.
3. Two different sets that are similar enough share a word among their rarest |x| - ceil(t |x|) + 1 (prefix filter); sets
   meet by those words. A word of more than ``HOT`` sets is too little to meet by: there, sets meet by the word and a further one
   of their prefix, one word longer, as similar sets share two (all sets of four words or more do). Pairs of words of more
   than ``GROUP`` sets are dealt out as pairs of blocks.
4. Where sets meet, those of sizes too far apart (length filter), of which the word comes too late for enough shared words to
   follow (positional filter), and whose bitmaps (of parities, so they differ by the words not shared only) differ in more bits
   than the sets may in words, drop out. Rows that meet are in order of size
   band, then place, so a set looks at near sizes and at earlier sets only. It keeps its earliest partners, ``FEW`` of them; if none is verified
   and there were more, it asks again for the next ones, ``MORE`` times as many a round, until none is left. So no
   group emits all its pairs.
5. The Jaccard similarity of what is left is verified on the whole sets, read again from one place of each.

Between tasks, rows travel packed: one row for each task and destination, a column being one binary value (``_planes``), so that
the JVM moves few large values and never sees single words.

Words are 64-bit hashes where sets are made and verified, 32-bit ones where they meet (a collision there costs a comparison
and changes nothing). Null texts have no lines and stay null. Rows with a null doc_id come first in order and are
handled like others; repeated rows (equal doc_id) share places: the line of the same place is not before itself, so both keep
it. An empty table gives an empty result; extra columns, of any name, pass through ``dedup_lines``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspan.llm.common import discard, partitions, read, release, spare, stored, tidied
from quillspan.llm.flat import flat_words, mix

#: The threshold as a fraction, so that all bounds are whole numbers.
NUM, DEN = 4, 5
BUCKETS, SLICES = 1 << 18, 64
#: Sets of a word beyond which they meet by two words, and of a meeting beyond which it is dealt out in blocks.
HOT, GROUP = 2048, 4096
#: Partners of a set and meeting in the first round, and how many times more in each further one.
FEW, MORE = 3, 32
#: Lines, and rows that meet, that a task holds before it sends them; sets of a stored row; words of text for a share of the sets; rows for a share of the meetings.
HELD, HELD_ROWS, ROW_SETS, SHARE_WORDS, SHARE_ROWS = 1 << 15, 1 << 17, 1 << 12, 1 << 22, 1 << 19
#: Bytes by which a further round finds the rows it needs.
MARKS = 1 << 20
#: Removed or wanted lines that are broadcast to the texts at most; beyond it the texts are shuffled to them.
BROADCAST_LINES = 2_000_000
NO_DOC = -(1 << 63)
_BASE = np.uint64(0x9E3779B97F4A7C15)

_SET = {"key": np.int64, "doc": np.int64, "line": np.int32, "size": np.int32, "kept": np.int32, "low": np.uint64, "high": np.uint64, "words": np.uint32}
_PLACE = {"rdoc": np.int64, "rline": np.int32}
_ROW = {"unit": np.uint32, "side": np.uint8, "asks": np.uint8, "key": np.int64, "doc": np.int64, "line": np.int32, "size": np.int32, "at": np.int32, "low": np.uint64, "high": np.uint64}


def _schema(columns: Iterable[str], more: str = "") -> str:
    return "part int, " + ", ".join(f"{c} binary" for c in columns) + more


def _planes(x: np.ndarray) -> bytes:
    """The bytes of the numbers, all first ones, then all second ones: high bytes that are all zero compress to nothing."""
    return np.ascontiguousarray(np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.itemsize).T).tobytes()


def _numbers(packed: bytes, kind: type) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(packed, np.uint8).reshape(width, -1).T).reshape(-1).view(kind)


def _joined(rows: list[dict[str, np.ndarray]], kinds: dict[str, type]) -> dict[str, np.ndarray]:
    return {c: np.concatenate([r[c] for r in rows]) if rows else np.zeros(0, k) for c, k in kinds.items()}


def _batch(rows: list[dict], columns: Iterable[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r["part"] for r in rows], pa.int32()), *(pa.array([r[c] for r in rows], pa.binary()) for c in columns)], ["part", *columns])


def _by_part(batches: Iterable[pa.RecordBatch], columns: dict[str, type]) -> Iterator[tuple[int, dict[str, np.ndarray]]]:
    """The packed rows of sorted ``part``, put together part by part."""
    now, held = None, []
    for batch in batches:
        for k, part in enumerate(batch.column("part").to_pylist()):
            if part != now and held:
                yield now, _joined(held, columns)
                held = []
            now = part
            held.append({c: _numbers(batch.column(c)[k].as_py(), kind) for c, kind in columns.items()})
    if held:
        yield now, _joined(held, columns)


@tidied
def _counted(batches: Iterable[pa.RecordBatch], count: Callable[[pa.RecordBatch, np.ndarray], None], size: int, kind: type) -> Iterator[pa.RecordBatch]:
    total = np.zeros(size, kind)
    for batch in batches:
        count(batch, total)
    yield pa.RecordBatch.from_arrays([pa.array(range(SLICES), pa.int32()), pa.array([x.tobytes() for x in total.reshape(SLICES, -1)], pa.binary())], ["slice", "counts"])


def _total(rows: DataFrame, count: Callable[[pa.RecordBatch, np.ndarray], None], size: int, kind: type = np.int64, join: np.ufunc = np.add) -> np.ndarray:
    """A table of ``size`` counters that each task fills by ``count``, added up; the driver gets one table, of a fixed size."""

    def added(several: pa.Table) -> pa.Table:
        total = np.zeros(size // SLICES, kind)
        for x in several.column("counts"):
            join(total, np.frombuffer(x.as_py(), kind), total)
        return pa.table({"slice": several.column("slice").slice(0, 1), "counts": pa.array([total.tobytes()], pa.binary())})

    form = "slice int, counts binary"
    out = np.zeros((SLICES, size // SLICES), kind)
    for r in rows.mapInArrow(lambda b: _counted(b, count, size, kind), form).groupBy("slice").applyInArrow(added, form).collect():
        out[r["slice"]] = np.frombuffer(r["counts"], kind)
    return out.ravel()


def _bucket(hashes: np.ndarray) -> np.ndarray:
    return (hashes & hashes.dtype.type(BUCKETS - 1)).astype(np.int64)


def word_counts(docs: DataFrame) -> np.ndarray:
    """Words of all documents by bucket of their hash."""

    def count(batch: pa.RecordBatch, total: np.ndarray) -> None:
        total += np.bincount(np.concatenate([np.zeros(0, np.int64), *(_bucket(w.hash) for w in flat_words(batch.column(0)))]), minlength=BUCKETS)

    return _total(docs.select("text"), count, BUCKETS)


def _taken(values: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Of each list that begins at ``first``, ``size`` values, one list after the other."""
    ends = np.cumsum(size)
    return values[np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - (ends - size), size)]


class _Lines:
    """The lines with words of a piece of texts: ``doc`` (number of the text), ``line``, ``size``, ``key`` of each, and their words ``h`` from rare to common, from ``first`` on."""

    def __init__(self, w, rank: np.ndarray):
        # a line begins where a text begins and behind each \n
        begins = np.union1d(w.bounds[:-1], np.flatnonzero(w.bytes == 10) + 1)
        line = np.searchsorted(begins, w.start, "right") - 1
        order = self._order(line, rank[_bucket(w.hash)], w.hash)
        h, line = w.hash[order], line[order]
        new = np.concatenate([[True], (h[1:] != h[:-1]) | (line[1:] != line[:-1])])
        self.h, line = h[new], line[new]
        self.first = np.flatnonzero(np.concatenate([[True], line[1:] != line[:-1]]))
        self.size = np.diff(np.concatenate([self.first, [len(line)]]))
        self.key = mix(np.add.reduceat(mix(self.h), self.first)).view(np.int64)
        # of empty texts at the same byte the last one owns it; they have no words
        inside = np.searchsorted(w.bounds[:-1], begins[line[self.first]], "right") - 1
        self.line = (line[self.first] - np.searchsorted(begins, w.bounds[inside])).astype(np.int32)
        self.doc = inside + w.first

    @staticmethod
    def _order(line: np.ndarray, rank: np.ndarray, h: np.ndarray) -> np.ndarray:
        """By line, rank, 26 bits of the hash. One number holds the line, the rank (which is that of the hash's lowest 18 bits) and those bits, if no two words have them alike."""
        upper = (h >> np.uint64(18)) & np.uint64((1 << 26) - 1)
        if line[-1] < 1 << 20:
            whole = (line.astype(np.uint64) << np.uint64(44)) | (rank.astype(np.uint64) << np.uint64(26)) | upper
            order = np.argsort(whole)
            whole, same = whole[order], h[order]
            if not ((whole[1:] == whole[:-1]) & (same[1:] != same[:-1])).any():
                return order
        return np.lexsort((h, upper, rank, line))


def _prefix(size: np.ndarray) -> np.ndarray:
    """The length of the prefix. Sets of fewer than four words have none: they are similar to equal ones only."""
    return np.where(size >= DEN - 1, size - -(-NUM * size // DEN) + 1, 0)


def _described(x: _Lines, docs: np.ndarray) -> dict[str, np.ndarray]:
    bit = (x.h >> np.uint64(20)) & np.uint64(127)
    one = np.uint64(1) << (bit & np.uint64(63))
    low = np.bitwise_xor.reduceat(np.where(bit < 64, one, np.uint64(0)), x.first)
    high = np.bitwise_xor.reduceat(np.where(bit >= 64, one, np.uint64(0)), x.first)
    prefix = _prefix(x.size)
    kept = prefix + (prefix > 0)  # the prefix and a word more, for meetings by two words
    words = (_taken(x.h, x.first, kept) >> np.uint64(32)).astype(np.uint32)
    return {"key": x.key, "doc": docs[x.doc], "line": x.line, "size": x.size.astype(np.int32), "kept": kept.astype(np.int32), "low": low, "high": high, "words": words}


def _one_of_each(sets: dict[str, np.ndarray]) -> tuple[dict[str, np.ndarray], dict[str, np.ndarray]]:
    """Of equal sets the first, and the places of the others."""
    order = np.lexsort((sets["line"], sets["doc"], sets["key"]))
    key, doc, line = (sets[c][order] for c in ("key", "doc", "line"))
    new = np.concatenate([[True], key[1:] != key[:-1]]) if len(key) else np.zeros(0, bool)
    own = np.flatnonzero(new)[np.cumsum(new) - 1] if len(key) else order
    again = (doc != doc[own]) | (line != line[own])
    kept = order[new]
    begins = np.cumsum(sets["kept"]) - sets["kept"]
    out = {c: sets[c][kept] for c in _SET if c != "words"}
    return out | {"words": _taken(sets["words"], begins[kept], out["kept"])}, {"rdoc": doc[again], "rline": line[again]}


@tidied
def _sets(batches: Iterable[pa.RecordBatch], rank: np.ndarray, parts: int) -> Iterator[pa.RecordBatch]:
    """Packed rows of the different sets of ``HELD`` lines, dealt out by set, and of the places of repeated ones."""
    held: list[dict] = []
    n = 0

    def send() -> pa.RecordBatch:
        sets, again = _one_of_each(_joined(held, _SET))
        held.clear()
        to = (sets["key"].view(np.uint64) >> np.uint64(1)) % np.uint64(parts)
        rto = mix(again["rdoc"].view(np.uint64)) % np.uint64(parts)
        order, rorder = np.argsort(to, kind="stable"), np.argsort(rto, kind="stable")
        begins = np.cumsum(sets["kept"]) - sets["kept"]
        words = _taken(sets["words"], begins[order], sets["kept"][order])
        sets = {c: x[order] for c, x in sets.items() if c != "words"}
        again = {c: x[rorder] for c, x in again.items()}
        ends, rends = (np.searchsorted(x, np.arange(parts + 1, dtype=np.uint64)) for x in (to[order], rto[rorder]))
        wends = np.concatenate([[0], np.cumsum(sets["kept"])])[ends]
        rows = []
        for p in np.flatnonzero((ends[1:] > ends[:-1]) | (rends[1:] > rends[:-1])).tolist():
            row = {c: _planes(x[ends[p] : ends[p + 1]]) for c, x in sets.items()} | {c: _planes(x[rends[p] : rends[p + 1]]) for c, x in again.items()}
            rows.append(row | {"part": p, "words": _planes(words[wends[p] : wends[p + 1]])})
        return _batch(rows, [*_SET, *_PLACE])

    for batch in batches:
        docs = batch.column(0).fill_null(NO_DOC).to_numpy()
        for w in flat_words(batch.column(1)):
            if len(w.hash):
                held.append(_described(_Lines(w, rank), docs))
                n += len(held[-1]["key"])
                if n >= HELD:
                    yield send()
                    n = 0
    if held:
        yield send()


@tidied
def _merged(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Packed rows of a part's sets with their first places, and of the places of the others."""
    for part, both in _by_part(batches, _SET | _PLACE):
        sets, again = _one_of_each({c: both[c] for c in _SET})
        places = {c: np.concatenate([both[c], again[c]]) for c in _PLACE}
        ends = np.concatenate([[0], np.cumsum(sets["kept"])])
        for at in range(0, max(len(sets["key"]), len(places["rdoc"])), ROW_SETS):
            own = {c: x[at : at + ROW_SETS] for c, x in (sets | places).items() if c != "words"}
            own["words"] = sets["words"][ends[min(at, len(ends) - 1)] : ends[min(at + ROW_SETS, len(ends) - 1)]]
            yield _batch([{"part": part} | {c: _planes(x) for c, x in own.items()}], [*_SET, *_PLACE])


@tidied
def _places(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for doc, line in zip(batch.column("rdoc"), batch.column("rline")):
            yield pa.RecordBatch.from_arrays([pa.array(_numbers(doc.as_py(), np.int64)), pa.array(_numbers(line.as_py(), np.int32))], ["doc", "line"])


def _spread(sets: dict[str, np.ndarray], hot: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(set, place of the word, hash of what they meet by) of each row that meets; ``hot``: whether the words of a bucket are."""
    prefix = _prefix(sets["size"])
    begins = np.cumsum(sets["kept"]) - sets["kept"]
    who = np.repeat(np.arange(len(prefix)), prefix)
    at = np.arange(len(who)) - np.repeat(np.cumsum(prefix) - prefix, prefix)
    word = sets["words"][begins[who] + at]
    if hot is None or not (two := hot[_bucket(word)]).any():
        return who, at, word
    times = (prefix[who] - at)[two]  # the further words of the prefix and the one behind it
    who2, at2, word2 = (np.repeat(x[two], times) for x in (who, at, word))
    further = np.arange(len(who2)) - np.repeat(np.cumsum(times) - times, times) + 1
    both = mix(word2.astype(np.uint64) * _BASE + sets["words"][begins[who2] + at2 + further])
    return np.concatenate([who[~two], who2]), np.concatenate([at[~two], at2]), np.concatenate([word[~two], (both >> np.uint64(32)).astype(np.uint32)])


@tidied
def _dealt(batches: Iterable[pa.RecordBatch], parts: int, hot: np.ndarray | None, blocks: np.ndarray | None, marks: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    """Packed rows that meet; ``blocks``: by bucket of the meeting; ``marks``: of a further round, in which the keys in ``asked`` ask and meetings without a mark are left out."""
    held: list[dict] = []
    n = 0
    for batch in batches:
        for k in range(len(batch)):
            row = {c: _numbers(batch.column(c)[k].as_py(), kind) for c, kind in _SET.items()}
            row["asks"] = np.ones(len(row["key"]), np.uint8)
            if marks is not None:
                row["asks"] = np.isin(row["key"], np.asarray(batch.column("asked")[k].as_py() or [], np.int64)).astype(np.uint8)
            held.append(row)
            n += int(_prefix(row["size"]).sum())
            if n >= HELD_ROWS:
                yield from _meeting_rows(_joined(held, _SET | {"asks": np.uint8}), parts, hot, blocks, marks)
                held, n = [], 0
    if held:
        yield from _meeting_rows(_joined(held, _SET | {"asks": np.uint8}), parts, hot, blocks, marks)


def _meeting_rows(sets: dict[str, np.ndarray], parts: int, hot: np.ndarray | None, blocks: np.ndarray | None, marks: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    who, at, met = _spread(sets, hot)
    if marks is not None:
        some = marks[(met & np.uint32(MARKS - 1)).astype(np.int64)] > 0
        who, at, met = who[some], at[some], met[some]
    side = np.zeros(len(who), np.uint8)
    if blocks is not None and (many := (n := blocks[_bucket(met)]) > 1).any():
        # a set's block meets every block once: as the first of the pair or as the second
        n, w, a, m = n[many], who[many], at[many], met[many]
        block = sets["key"][w].view(np.uint64) % n.astype(np.uint64)
        w, a, m, block = (np.repeat(x, n) for x in (w, a, m, block))
        other = (np.arange(len(w)) - np.repeat(np.cumsum(n) - n, n)).astype(np.uint64)
        pair = np.minimum(block, other) * np.uint64(1 << 32) + np.maximum(block, other)
        unit = (mix(mix(m.astype(np.uint64)) + pair * _BASE) >> np.uint64(32)).astype(np.uint32)
        own = np.where(block == other, 0, np.where(block < other, 1, 2)).astype(np.uint8)
        who, at, met, side = (np.concatenate([x[~many], y]) for x, y in ((who, w), (at, a), (met, unit), (side, own)))
    for begin in range(0, len(who), HELD_ROWS):
        piece = slice(begin, begin + HELD_ROWS)
        yield _packed_rows(sets, who[piece], at[piece], met[piece], side[piece], parts)


def _packed_rows(sets: dict[str, np.ndarray], who: np.ndarray, at: np.ndarray, met: np.ndarray, side: np.ndarray, parts: int) -> pa.RecordBatch:
    to = mix(met.astype(np.uint64) * _BASE) % np.uint64(parts)
    order = np.argsort((to << np.uint64(32)) | met)
    who, at, met, side, to = who[order], at[order], met[order], side[order], to[order]
    columns = {"unit": met, "side": side, "at": at.astype(np.int32)} | {c: sets[c][who] for c in ("asks", "key", "doc", "line", "size", "low", "high")}
    ends = np.searchsorted(to, np.arange(parts + 1, dtype=np.uint64))
    some = np.flatnonzero(ends[1:] > ends[:-1]).tolist()
    return _batch([{"part": p} | {c: _planes(x[ends[p] : ends[p + 1]]) for c, x in columns.items()} for p in some], list(_ROW))


def overlap_needed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least overlap of sets of these sizes that are similar enough."""
    return -(-NUM * (a + b) // (NUM + DEN))


def _band(size: np.ndarray) -> np.ndarray:
    """Sets that are similar enough are of the same band or of neighbouring ones."""
    return np.minimum(np.floor(np.log(size) / np.log(DEN / NUM) + 1e-9), 63).astype(np.uint64)


_MEET = "a long, doc_a long, line_a int, b long, doc_b long, line_b int, unit long, more boolean"


@tidied
def _meet(batches: Iterable[pa.RecordBatch], skip: int, few: int) -> Iterator[pa.RecordBatch]:
    """For each set that asks, the next ``few`` of the earlier ones of its meeting that pass the filters: (a, ..., b, ..., unit, more)."""
    for _, x in _by_part(batches, _ROW):
        order = np.lexsort((x["key"], x["line"], x["doc"]))
        place = np.empty(len(order), np.uint64)
        place[order] = np.arange(len(order))
        where = (x["unit"].astype(np.uint64) << np.uint64(32)) | (_band(x["size"]) << np.uint64(26))
        order = np.lexsort((place, where))
        x, where, place = {c: v[order] for c, v in x.items()}, where[order], place[order]
        new = np.flatnonzero(np.concatenate([[True], where[1:] != where[:-1]]))
        run = np.cumsum(np.concatenate([[0], where[1:] != where[:-1]]))
        ends = np.concatenate([new[1:], [len(where)]])
        size, at, low, high, key, side = x["size"].astype(np.int64), x["at"].astype(np.int64), x["low"], x["high"], x["key"], x["side"]
        times = np.zeros(len(where), np.int64)
        found: tuple[list, list] = ([], [])
        for step in (0, -1, 1):
            other = run + step
            real = (other >= 0) & (other < len(new)) & (x["asks"] > 0)
            other = np.clip(other, 0, len(new) - 1)
            real &= where[new[other]] == where + np.uint64((step << 26) % (1 << 64))
            who = np.flatnonzero(real)
            begin, end = new[other[who]], ends[other[who]]
            if step == 0:
                end = who
            else:  # a neighbouring run is in order of place too
                end = begin + _before(place, begin, end, place[who])
            some = end > begin
            who, begin, end = who[some], begin[some], end[some]
            k = 0
            while len(who):
                b = begin + k
                sa, sb = size[who], size[b]
                need = overlap_needed(sa, sb)
                ok = (at[who] <= sa - need) & (at[b] <= sb - need) & (DEN * np.minimum(sa, sb) >= NUM * np.maximum(sa, sb))
                c, b, far = who[ok], b[ok], (sa + sb - 2 * need)[ok]
                apart = np.bitwise_count(low[c] ^ low[b]).astype(np.int64) + np.bitwise_count(high[c] ^ high[b])
                ok = (apart <= far) & (key[c] != key[b]) & ((side[c] == 0) | (side[c] != side[b]))
                c, b = c[ok], b[ok]
                times[c] += 1
                some = (times[c] > skip) & (times[c] <= skip + few)
                found[0].append(c[some])
                found[1].append(b[some])
                k += 1
                on = (begin + k < end) & (times[who] <= skip + few)
                who, begin, end = who[on], begin[on], end[on]
        if found[0]:
            c, b = (np.concatenate(v) for v in found)
            yield pa.RecordBatch.from_arrays(
                [pa.array(v) for v in (key[c], x["doc"][c], x["line"][c], key[b], x["doc"][b], x["line"][b], x["unit"][c].astype(np.int64), times[c] > skip + few)],
                ["a", "doc_a", "line_a", "b", "doc_b", "line_b", "unit", "more"],
            )


def _before(values: np.ndarray, begin: np.ndarray, end: np.ndarray, than: np.ndarray) -> np.ndarray:
    """How many of the ascending values[begin:end] are less, by bisection of all at once."""
    low, high = begin.copy(), end.copy()
    while (open_ := low < high).any():
        middle = (low + high) // 2
        less = open_ & (values[np.minimum(middle, len(values) - 1)] < than)
        low = np.where(less, middle + 1, low)
        high = np.where(open_ & ~less, middle, high)
    return low - begin


@tidied
def _wanted_words(batches: Iterable[pa.RecordBatch], rank: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(key, words) of the lines that are listed beside the text, once in a batch."""
    for batch in batches:
        seen: np.ndarray = np.zeros(0, np.int64)
        lists = batch.column(1)
        owner = np.repeat(np.arange(len(batch)), lists.value_lengths().to_numpy())
        wanted = np.unique(owner.astype(np.int64) << 32 | lists.flatten().to_numpy())
        for w in flat_words(batch.column(0)):
            if len(w.hash):
                x = _Lines(w, rank)
                some = np.flatnonzero(np.isin(x.doc.astype(np.int64) << 32 | x.line, wanted))
                some = some[np.unique(x.key[some], return_index=True)[1]]
                some = some[~np.isin(x.key[some], seen)]
                seen = np.concatenate([seen, x.key[some]])
                ends = np.concatenate([[0], np.cumsum(x.size[some])])
                words = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(_taken(x.h, x.first[some], x.size[some]).view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(x.key[some]), words], ["key", "words"])


def _beside(docs: DataFrame, lines: DataFrame, name: str, how: str) -> DataFrame:
    """``docs`` with the ``lines(doc, lines)`` of their doc_id as the column ``name``; broadcast where the lines are few."""
    doc = spare([*docs.columns, name], "doc")
    count = lines.agg(F.coalesce(F.sum(F.size("lines") + 4), F.lit(0))).first()[0]
    lines = lines.select(F.col("doc").alias(doc), F.col("lines").alias(name))
    named = docs.withColumn(doc, F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_DOC)))
    return named.join(F.broadcast(lines) if count <= BROADCAST_LINES else lines, doc, how).drop(doc)


def _similar(docs: DataFrame, pairs: DataFrame, rank: np.ndarray, files: int) -> DataFrame:
    """The sets ``a(key, doc, line)`` of the pairs that are similar enough to their ``b``, stored."""
    wanted = stored(pairs.select("a", "doc_a", "line_a", "b", "doc_b", "line_b").dropDuplicates(["a", "b"]))
    places = wanted.select(F.col("doc_a").alias("doc"), F.col("line_a").alias("line")).union(wanted.select("doc_b", "line_b"))
    # a list is no longer than the longest text has lines
    lines = stored(places.groupBy("doc").agg(F.collect_set("line").alias("lines")))
    words = _beside(docs, lines, "lines", "inner").select("text", "lines").mapInArrow(lambda b: _wanted_words(b, rank), "key long, words array<long>")
    words = stored(words, files=files)
    # a set comes from one place; only repeated rows give it again, and where they are many, copies are dropped first
    if words.count() > 1.5 * places.distinct().count():
        several, words = words, stored(words.dropDuplicates(["key"]), files=files)
        discard(several)
    a, b = words.select(F.col("key").alias("a"), F.col("words").alias("wa")), words.select(F.col("key").alias("b"), F.col("words").alias("wb"))
    both = F.size(F.array_intersect("wa", "wb"))
    alike = wanted.select("a", "doc_a", "line_a", "b").join(b, "b").join(a, "a").where((NUM + DEN) * both >= NUM * (F.size("wa") + F.size("wb")))
    sure = stored(alike.select(F.col("a").alias("key"), F.col("doc_a").alias("doc"), F.col("line_a").alias("line")).dropDuplicates(["key"]))
    discard(wanted, lines, words)
    return sure


def removed_places(docs: DataFrame) -> DataFrame:
    """(doc, line) of every line that goes, some more than once; rows with a null doc_id are of doc ``NO_DOC``."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    counts = word_counts(docs)
    rank = np.argsort(np.argsort(counts, kind="stable"), kind="stable").astype(np.int32)
    shares = max(1, int(counts.sum()) // SHARE_WORDS)
    few = max(1, partitions(spark) // 8)  # files of what is small
    dealt = docs.mapInArrow(lambda b: _sets(b, rank, shares), _schema([*_SET, *_PLACE])).repartitionById(shares, F.col("part")).sortWithinPartitions("part")
    sets = stored(dealt.mapInArrow(_merged, _schema([*_SET, *_PLACE])))
    del dealt
    release(spark)

    def often(hot: np.ndarray | None) -> np.ndarray:
        """How many rows meet, by bucket of what they meet by."""

        def count(batch: pa.RecordBatch, total: np.ndarray) -> None:
            for k in range(len(batch)):
                met = _spread({c: _numbers(batch.column(c)[k].as_py(), _SET[c]) for c in ("size", "kept", "words")}, hot)[2]
                total += np.bincount(_bucket(met), minlength=BUCKETS)

        return _total(sets.select("size", "kept", "words"), count, BUCKETS)

    met, hot, blocks = often(None), None, None
    if (met > HOT).any():
        hot = met > HOT
        met = often(hot)
        blocks = -(-met // GROUP) if (met > GROUP).any() else None
    rows = int((met * (blocks if blocks is not None else 1)).sum())
    units = max(1, rows // SHARE_ROWS)
    gone = sets.select("rdoc", "rline").mapInArrow(_places, "doc long, line int")
    asked: DataFrame | None = None
    marks: np.ndarray | None = None
    skip, most = 0, FEW
    while True:
        who = sets.select("part", *_SET)
        if asked is not None:
            share = (F.shiftrightunsigned("key", 1) % shares).cast("int")
            who = who.join(asked.groupBy(share.alias("part")).agg(F.collect_set("key").alias("asked")), "part", "left")
        now = who.mapInArrow(lambda b, m=marks: _dealt(b, units, hot, blocks, m), _schema(_ROW)).repartitionById(units, F.col("part")).sortWithinPartitions("part")
        pairs = stored(now.mapInArrow(lambda b, s=skip, k=most: _meet(b, s, k), _MEET), files=few)
        del now, who
        release(spark)
        sure = _similar(docs, pairs, rank, few)
        gone = gone.union(sure.select("doc", "line"))
        again = pairs.where("more").select(F.col("a").alias("key"), "unit").distinct().join(sure.select("key"), "key", "left_anti")
        before, asked = asked, stored(again)
        discard(pairs, *([before] if before is not None else []))
        release(spark)

        def mark(batch: pa.RecordBatch, total: np.ndarray) -> None:
            total[batch.column(0).to_numpy() & (MARKS - 1)] = 1

        if not asked.count():
            return gone
        marks = _total(asked.select("unit"), mark, MARKS, np.uint8, np.maximum)
        skip, most = skip + most, most * MORE


def removals(docs: DataFrame) -> DataFrame:
    """(doc, lines): the numbers, from 0, of the lines that go, for each doc_id that loses some."""
    return stored(removed_places(docs).groupBy("doc").agg(F.array_sort(F.collect_set("line")).alias("lines")))


def _split() -> Column:
    return F.split("text", "\n", -1)


def dedup_lines(docs: DataFrame) -> DataFrame:
    """The documents, their texts without the lines that go. Documents that lose all their words go; others stay."""
    lines = spare(docs.columns, "lines")
    # an array position past the end is never asked for: numbers come from the same text
    kept = F.filter(_split(), lambda line, i: ~F.array_contains(lines, i))
    text = F.when(F.col(lines).isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))
    out = _beside(docs, removals(docs), lines, "left").withColumn("text", text)
    return out.where(F.col(lines).isNull() | F.col("text").rlike(r"[^\x20\x09-\x0D]")).select(*docs.columns)


def op5_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    n = F.size(F.split(F.coalesce("text", F.lit("")), "\n", -1))
    removed = F.coalesce("lines", F.array().cast("array<int>"))
    return _beside(docs, removals(docs), "lines", "left").select("doc_id", n.cast("long").alias("n_lines"), F.size(removed).cast("long").alias("n_removed"), F.array_join(removed.cast("array<string>"), ",").alias("removed_lines"))


QUERIES = {"op5_lines": op5_lines}
ORACLE_SQL: dict[str, str] = {}
