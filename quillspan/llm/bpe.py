"""Byte-level BPE by a contiguous rank array, and its inverse.

A short word is a row of parts. ``_merge`` holds the part boundaries and, beside each, the rank of the pair that starts there;
it scans for the least rank, deletes the boundary between the two parts and computes the two neighbouring ranks anew, until no
pair has a rank. Words over ``SHORT`` bytes would make that scan quadratic, so they take the same merges from a heap.
Words repeat, so each worker remembers the ids of the words it has met, within a bound.

Null text counts as empty: no ids, and the digests of zero bytes. Empty tables give empty results; repeated rows give repeated
rows; columns besides the named ones pass through ``encode`` untouched.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
from pyspark.sql import DataFrame, SparkSession

from quillspan.llm.common import read

VOCABULARY = "byte_bpe_50k.json"
SHORT = 256
#: Words whose ids a worker keeps, and the longest word (in characters) that it keeps.
REMEMBERED, REMEMBERED_CHARS = 400_000, 40
NO_RANK = 1 << 60


def _merge(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of a short word, by the contiguous rank array."""
    n = len(word)
    at = list(range(n + 1))
    get = ranks.get
    rank = [get(word[i : i + 2], NO_RANK) for i in range(n - 1)]
    while rank:
        least = min(rank)
        if least == NO_RANK:
            break
        i = rank.index(least)
        del at[i + 1], rank[i]
        if i < len(rank):
            rank[i] = get(word[at[i] : at[i + 2]], NO_RANK)
        if i:
            rank[i - 1] = get(word[at[i - 1] : at[i + 1]], NO_RANK)
    return [ranks[word[i:j]] for i, j in zip(at, at[1:])]


def _merge_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same merges for a long word: a heap of (rank, place) and linked parts, in O(n log n)."""
    n = len(word)
    after, before = list(range(1, n + 1)), list(range(-1, n))
    end = list(range(1, n + 1))
    get = ranks.get
    heap = [(r, i) for i in range(n - 1) if (r := get(word[i : i + 2], NO_RANK)) != NO_RANK]
    heapq.heapify(heap)
    alive = [True] * n
    while heap:
        r, i = heapq.heappop(heap)
        if not alive[i] or (j := after[i]) >= n or get(word[i : end[j]], NO_RANK) != r:
            continue
        alive[j] = False
        end[i], after[i] = end[j], after[j]
        if after[i] < n:
            before[after[i]] = i
            if (x := get(word[i : end[after[i]]], NO_RANK)) != NO_RANK:
                heapq.heappush(heap, (x, i))
        if (p := before[i]) >= 0 and (x := get(word[p : end[i]], NO_RANK)) != NO_RANK:
            heapq.heappush(heap, (x, p))
    return [ranks[word[i : end[i]]] for i in range(n) if alive[i]]


def _byte_characters() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies: printable Latin-1 bytes stand for themselves, the others follow from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Codec(dict):
    """Encoder and decoder of one vocabulary file. As a dict: the word's ids as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str):
        super().__init__()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        of = _byte_characters()
        vocab = {bytes(of[c] for c in token): i for token, i in spec["model"]["vocab"].items() if all(c in of for c in token)}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        listed = {x.encode() for x in self.special}
        merged = (x.split(" ") if isinstance(x, str) else x for x in spec["model"]["merges"])
        self.order = {bytes(of[c] for c in a + b): i for i, (a, b) in enumerate(merged)}
        self.ids = vocab
        plain = {k: v for k, v in vocab.items() if k not in listed}
        # where ids follow the merges, they are the ranks: one table does for both
        self.ranked = all(plain.get(k) == i + 256 for k, i in self.order.items())
        self.ranks = plain if self.ranked else self.order
        self.pattern = regex.compile(public_tokenizers.PATTERN)
        self.split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        table = {i: k for k, i in vocab.items()} | {i: x.encode() for x, i in self.special.items()}
        self.bytes_of = [table.get(i, b"") for i in range(max(table) + 1)]

    def __missing__(self, word: str) -> bytes:
        raw = word.encode()
        if raw in self.ids and self.ranked and (len(raw) == 1 or raw in self.order):
            ids = [self.ids[raw]]
        else:
            ids = self.merged(raw)
        out = np.array(ids, "<u4").tobytes()
        if len(word) <= REMEMBERED_CHARS:
            if len(self) >= REMEMBERED:
                self.clear()
            self[word] = out
        return out

    def merged(self, raw: bytes) -> list[int]:
        merge = _merge if len(raw) <= SHORT else _merge_long
        if self.ranked:
            return merge(raw, self.ranks)
        parts = merge(raw, _WithBytes(self.order))
        return [self.ids[x] if isinstance(x, bytes) else x for x in parts]

    def encode(self, text: str) -> bytes:
        """The ids of a text, each a little-endian unsigned 32-bit integer. Special tokens in the text are themselves."""
        if self.special and any(x in text for x in self.special):
            out = []
            for part in self.split.split(text):
                if part in self.special:
                    out.append(self.special[part].to_bytes(4, "little"))
                elif part:
                    out.append(b"".join(map(self.__getitem__, self.pattern.findall(part))))
            return b"".join(out)
        return b"".join(map(self.__getitem__, self.pattern.findall(text)))

    def decode(self, ids: bytes) -> bytes:
        """UTF-8 bytes of the text that the ids spell; bytes that are no UTF-8 become U+FFFD."""
        raw = b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))
        try:
            raw.decode()
            return raw
        except UnicodeDecodeError:
            return raw.decode("utf-8", "replace").encode()


_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """The worker's codec for a file; it lasts as long as the worker."""
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def vocabulary_path(path: str | None = None) -> str:
    return path or public_tokenizers.path(VOCABULARY)


def encode(docs: DataFrame, text_col: str = "text", ids_col: str = "ids", path: str | None = None) -> DataFrame:
    """``docs`` with a binary column of the text's ids (little-endian unsigned 32-bit). Null text: no ids."""
    from pyspark.sql import functions as F

    @F.arrow_udf("binary")
    def ids(texts: pa.Array) -> pa.Array:
        own = codec(vocabulary_path(path))
        return pa.array([own.encode(t.as_py() or "") for t in texts], pa.binary())

    return docs.withColumn(ids_col, ids(F.col(text_col)))


def decode(frame: DataFrame, ids_col: str = "ids", text_col: str = "decoded", path: str | None = None) -> DataFrame:
    """``frame`` with the text that a binary column of ids spells. Null ids: empty text."""
    from pyspark.sql import functions as F

    @F.arrow_udf("string")
    def text(ids: pa.Array) -> pa.Array:
        own = codec(vocabulary_path(path))
        return pa.array([own.decode(x.as_py() or b"").decode() for x in ids], pa.string())

    return frame.withColumn(text_col, text(F.col(ids_col)))


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): encodes, then decodes the ids, one document at a time in one pass.

    The digests replace ids and text inside the pass, so that neither goes back through Arrow to the JVM.
    """

    def of(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(vocabulary_path(path))
        for batch in batches:
            n, ids_sha, text_sha = [], [], []
            for t in batch.column(1):
                ids = own.encode(t.as_py() or "")
                n.append(len(ids) // 4)
                ids_sha.append(hashlib.sha256(ids).hexdigest())
                text_sha.append(hashlib.sha256(own.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(of, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(read(spark, sf_dir, "documents"))


QUERIES = {"op10_bpe": op10_bpe}
ORACLE_SQL: dict[str, str] = {}
