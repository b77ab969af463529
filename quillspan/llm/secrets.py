"""Secret scans through nested encodings.

A text is the first layer of a worklist. Each layer is scanned; its encoded runs (percent escapes, Unicode escapes, base64 of
text or of zlib, gzip, bzip2 or xz data) are unwrapped into further layers, until nothing new comes out. A layer seen before
in the same text, by its digest, is not worked on again, so cycles end. Every layer knows where each of its characters
comes from in the text: one by one where escapes are replaced, as a whole run where base64 or compressed data is opened. The
lines of wrapped base64 are one run. A run that is not readable as it stands (glued to a path or a word, say) is decoded at all
four alignments, and compressed data is looked for at any place in it. Bytes and escapes that are no UTF-8 are replaced one by
one, and UTF-16 is read with its zero bytes left out, so that what stands beside them is scanned. A
finding of an inner layer becomes the span of the text that it came from.

Spans count code points, end exclusive. Null text counts as empty. Compressed data is opened to its end, member after member and
as often as it is compressed, in pieces that overlap, so memory stays bounded and time grows with what a bomb inflates to; broken
data is read up to where it breaks. Two bounds are left: an encoded run inside compressed data is decoded in parts beyond
``MAX_RUN`` characters, and an xz stream that needs more than ``XZ_MEMORY`` is not opened. Repeated rows are scanned each; other columns
pass through ``scan`` except those with the names of its results, which are replaced.
"""

from __future__ import annotations

import base64
import bz2
import codecs
import hashlib
import itertools
import lzma
import re
import string
import zlib
from collections.abc import Generator, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspan.llm.common import read, spare, text_batches

KINDS = ("assign", "access", "hex")
PIECE, OVERLAP, MAX_RUN, XZ_MEMORY = 4 << 20, 1 << 16, 64 << 20, 1 << 30

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")
_PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
_UNICODE = re.compile(r"(?:\\u[0-9A-Fa-f]{4}|\\U[0-9A-Fa-f]{8}|\\u\{[0-9A-Fa-f]{1,6}\}|\\x[0-9A-Fa-f]{2}|&#[0-9]{1,7};|&#[xX][0-9A-Fa-f]{1,6};)+")
_ONE_UNICODE = re.compile(r"\\u\{([0-9A-Fa-f]+)\}|\\[uUx]([0-9A-Fa-f]+)|&#([0-9]+);|&#[xX]([0-9A-Fa-f]+);")
_RUN = re.compile(r"[A-Za-z0-9+/_-]++={0,2}")
#: A run with the lines that follow it; they hold nothing else but for what may close a block.
_BASE64 = re.compile(r"""[A-Za-z0-9+/_-]{16,}+(?:[ \t]*+\r?\n[ \t]*+[A-Za-z0-9+/_-]++(?==|[ \t]*+(?:\r?\n|\Z)|["'`<>)\],;}\\]))*+(?:(?:[ \t]*+\r?\n[ \t]*+)?=){0,2}""")
_RUN_CHARS = string.ascii_letters + string.digits + "+/_-=%\\{}&#;\r\n\t"
_STREAM = re.compile(rb"\x1f\x8b\x08|\x78[\x01\x5e\x9c\xda]|BZh[1-9]|\xfd7zXZ\x00")
_MAGIC = ((b"\x1f\x8b", 31), (b"\x78\x01", 15), (b"\x78\x5e", 15), (b"\x78\x9c", 15), (b"\x78\xda", 15))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, number of the kind, end) of the findings in one layer, by start and kind.

    The quantified forms of the access and hex patterns find the same runs as the bare ones with short runs dropped: a run is
    matched at its first character or, too short, at none. An access match that fails can only end where its run ends.
    """
    found = []
    if "=" in text or ":" in text:
        found += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    found.sort()
    return found


def _readable(raw: bytes) -> str | None:
    """The text of decoded bytes, if they are text: UTF-8 with no control characters but white space."""
    try:
        text = raw.decode("utf-8")
    except UnicodeDecodeError:
        return None
    return text if not any(c < 32 and c not in (9, 10, 11, 12, 13) or c == 127 for c in raw) else None


def _read(raw: bytes) -> Iterator[str]:
    """The texts of bytes: as UTF-8, and as UTF-16 where they hold zeros."""
    yield raw.decode("utf-8", "replace")
    if b"\0" in raw:
        yield raw.replace(b"\0", b"").decode("utf-8", "replace")


def _opener(raw: bytes):
    """What decompresses a stream that starts like this, or None."""
    for magic, bits in _MAGIC:
        if raw.startswith(magic):
            return zlib.decompressobj(bits)
    if raw.startswith(b"BZh"):
        return bz2.BZ2Decompressor()
    return lzma.LZMADecompressor(memlimit=XZ_MEMORY) if raw.startswith(b"\xfd7zXZ\x00") else None


class _Inflated:
    """The pieces of what the compressed streams at the start of ``source`` hold, how many of its bytes they took, and whether the last of them was whole."""

    def __init__(self, source: Iterator[bytes]):
        self.source, self.used, self.whole = source, 0, False

    def __iter__(self) -> Iterator[bytes]:
        head, taken = b"", 0
        while True:
            while len(head) < 6 and (more := next(self.source, None)) is not None:
                head, taken = head + more, taken + len(more)
                if self.used:
                    head = head.lstrip(b"\0")  # padding between streams
            if (d := _opener(head)) is None:
                return
            self.whole = False
            while not d.eof:
                given = getattr(d, "needs_input", True)
                try:
                    piece = d.decompress(head if given else b"", PIECE)
                except (zlib.error, OSError, EOFError, ValueError, lzma.LZMAError, MemoryError):
                    return
                if given:
                    head = getattr(d, "unconsumed_tail", b"")
                if d.eof:
                    head = d.unused_data
                elif not piece and not head and getattr(d, "needs_input", True):
                    if (head := next(self.source, b"")) == b"":
                        return
                    taken += len(head)
                if piece:
                    yield piece
            self.used, self.whole = taken - len(head), True
            head = head.lstrip(b"\0")


def _gathered(pieces: Iterable[bytes]) -> Iterator[bytes]:
    """Pieces of PIECE bytes at least, but for the last."""
    parts, size = [], 0
    for x in pieces:
        parts.append(x)
        size += len(x)
        if size >= PIECE:
            yield b"".join(parts)
            parts, size = [], 0
    if parts:
        yield b"".join(parts)


def _tail(text: str) -> str:
    """The end of a piece that a finding or an encoded run may go on from."""
    keep = len(text[: max(0, len(text) - OVERLAP)].rstrip(" "))
    return text[max(0, min(keep, len(text.rstrip(_RUN_CHARS))) - 64, len(text) - MAX_RUN) :]


def _pieces() -> Generator[str | None, bytes | None, None]:
    """Is sent the pieces of a text and, at their end, None; gives overlapping texts, or None where it waits for more."""
    decode = codecs.getincrementaldecoder("utf-8")("replace").decode
    tail = new = ""
    piece = yield None
    while piece is not None:
        new += decode(piece)
        text = None
        if len(new) >= len(tail):
            text = tail + new
            tail, new = _tail(text), ""
        piece = yield text
    new += decode(b"", True)
    yield tail + new if new else None


def _opened(inflated: _Inflated) -> Iterator[str]:
    """The text of compressed data, opened as often as it is compressed, in pieces that overlap; data that holds itself ends."""
    pieces, seen, nested = _gathered(inflated), set(), []
    while True:
        if (first := next(pieces, None)) is None:
            return
        second = next(pieces, None)
        if second is None:
            key = hashlib.blake2b(first, digest_size=16).digest()
            if key in seen:
                return
            seen.add(key)
        pieces = iter((first,)) if second is None else itertools.chain((first, second), pieces)
        if _opener(first) is None or next(iter(_Inflated(iter((first,)))), None) is None:
            break
        nested.append((_Inflated(pieces), first))
        pieces = _gathered(nested[-1][0])
    plain, dense = _pieces(), _pieces()
    next(plain), next(dense)
    zeros = False
    for piece in itertools.chain(pieces, (None,)):
        if (text := plain.send(piece)) is not None:
            yield text
        zeros = zeros or piece is not None and b"\0" in piece
        text = dense.send(piece and piece.replace(b"\0", b""))
        if zeros and text is not None:
            yield text
    for streams, first in nested:  # what stands behind them
        if streams.used < len(first):
            yield from _read(first[streams.used :])


def _from_base64(run: str) -> bytes | None:
    body = run.replace("=", "").replace("-", "+").replace("_", "/")
    return None if len(body) % 4 == 1 else base64.b64decode(body + "=" * (-len(body) % 4))


def _streams(raw: bytes) -> Iterator[str]:
    """The texts of the compressed data anywhere in the bytes."""
    at = 0
    while m := _STREAM.search(raw, at):
        inflated = _Inflated(raw[i : i + OVERLAP] for i in range(m.start(), len(raw), OVERLAP))
        yield from _opened(inflated)
        at = max(m.start() + 1, m.start() + inflated.used)


def _clean(run: str, whole: list) -> Iterator[str]:
    """The texts of a run that holds text or compressed data from its first to its last character; ``whole`` gets an entry if it does."""
    raw = _from_base64(run)
    if raw is None:
        return
    if _opener(raw) is not None:
        inflated = _Inflated(raw[i : i + OVERLAP] for i in range(0, len(raw), OVERLAP))
        yield from _opened(inflated)
        if inflated.whole and inflated.used == len(raw):
            whole.append(run)
    elif out := _readable(raw):
        whole.append(run)
        yield out


def _alignments(run: str) -> Iterator[str]:
    """The texts in a run that starts or ends with other characters: its four alignments, and the compressed data anywhere in them."""
    for k in range(4):
        part = run.replace("=", "")[k:]
        raw = _from_base64(part[: len(part) - (len(part) % 4 == 1)])
        yield from _read(raw)
        yield from _streams(raw)


def _decoded(text: str) -> Iterator[tuple[int, int, str]]:
    """(start, end, text inside) of the base64 of a layer."""
    for m in _BASE64.finditer(text):
        lines = list(_RUN.finditer(text, *m.span()))
        run, whole = "".join(x.group() for x in lines), []
        for out in _clean(run, whole):
            yield (*m.span(), out)
        if whole:
            continue
        for x in lines:
            if len(lines) > 1 and len(x.group()) >= 16:
                for out in _clean(x.group(), []):
                    yield (*x.span(), out)
        for out in _alignments(run):
            yield (*m.span(), out)


def _empty(text: str) -> bool:
    """Whether a layer has neither findings nor anything encoded."""
    return not (base_spans(text) or _BASE64.search(text) or _PERCENT.search(text) or _UNICODE.search(text))


def _escapes(text: str, pattern: re.Pattern, spell) -> tuple[str, list[tuple[int, int, int]]] | None:
    """The text with its escapes replaced, and for each character replaced (its place there, start, end here)."""
    out, marks, at, size = [], [], 0, 0
    for m in pattern.finditer(text):
        chars = spell(m.group(), m.start())
        out.append(text[at : m.start()])
        size += m.start() - at
        for c, start, end in chars:
            out.append(c)
            marks.append((size, start, end))
            size += len(c)
        at = m.end()
    if not marks:
        return None
    out.append(text[at:])
    return "".join(out), marks


def _percent(run: str, start: int) -> list[tuple[str, int, int]]:
    raw = bytes.fromhex(run.replace("%", ""))
    out, at, i = [], start, 0
    while i < len(raw):
        n = 1 if raw[i] < 0xC2 else 2 if raw[i] < 0xE0 else 3 if raw[i] < 0xF0 else 4
        try:
            c = raw[i : i + n].decode("utf-8")
        except UnicodeDecodeError:
            c, n = "\ufffd", 1
        out.append((c, at, at + 3 * n))
        at += 3 * n
        i += n
    return out


def _unicode(run: str, start: int) -> list[tuple[str, int, int]]:
    units = [(int(a or b or d, 16) if (a or b or d) else int(c), m.start() + start, m.end() + start) for m in _ONE_UNICODE.finditer(run) for a, b, c, d in [m.groups()]]
    out, i = [], 0
    while i < len(units):
        code, s, e = units[i]
        if 0xD800 <= code < 0xDC00 and i + 1 < len(units) and 0xDC00 <= units[i + 1][0] < 0xE000:
            code, e, i = 0x10000 + ((code - 0xD800) << 10) + units[i + 1][0] - 0xDC00, units[i + 1][2], i + 1
        if code > 0x10FFFF or 0xD800 <= code < 0xE000:
            code = 0xFFFD
        out.append((chr(code), s, e))
        i += 1
    return out


Origin = np.ndarray | int | None


def _origins(n: int, marks: list[tuple[int, int, int]], starts: Origin, ends: Origin) -> tuple[Origin, Origin]:
    """Where each of n characters of the inner layer starts and ends in the whole text; one number where it is the same for all."""
    if isinstance(starts, int):
        return starts, ends
    step = np.ones(n, np.int64)
    at = np.array([m[0] for m in marks])
    width = np.array([m[2] - m[1] for m in marks])
    step[at] = width
    e = np.cumsum(step) if marks[0][1] >= 0 else np.zeros(n, np.int64)
    s = e - step
    return (s, e) if starts is None else (starts[s], ends[e - 1])


def _span(start: int, end: int, starts: Origin, ends: Origin) -> tuple[int, int]:
    """Where a span of a layer is in the whole text."""
    if starts is None:
        return start, end
    return (starts, ends) if isinstance(starts, int) else (int(starts[start]), int(ends[end - 1]))


def _inner(layer: str, starts: Origin, ends: Origin) -> Iterator[tuple[str, Origin, Origin]]:
    """The layers inside one, each when it is asked for."""
    for sign, pattern, spell in (("%", _PERCENT, _percent), ("\\", _UNICODE, _unicode), ("&#", _UNICODE, _unicode)):
        if sign in layer and (out := _escapes(layer, pattern, spell)):
            yield (out[0], *_origins(len(out[0]), out[1], starts, ends))
    for start, end, out in _decoded(layer):
        if not _empty(out):
            yield (out, *_span(start, end, starts, ends))


def scan_text(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """(base findings, all findings), each (start, number of the kind, end) in order."""
    base = base_spans(text)
    encoded = "%" in text or "\\" in text or "&#" in text
    if not encoded and not _BASE64.search(text):
        return base, base
    found, seen = set(base), {hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16).digest()}
    work: list[Iterator[tuple[str, Origin, Origin]]] = [iter([(text, None, None)])]
    while work:
        if (x := next(work[-1], None)) is None:
            work.pop()
            continue
        layer, starts, ends = x
        if starts is not None:
            first = starts if isinstance(starts, int) else int(starts[0])
            key = hashlib.blake2b(layer.encode("utf-8", "surrogatepass"), digest_size=16, salt=first.to_bytes(8, "little")).digest()
            if key in seen:
                continue
            seen.add(key)
            for s, k, e in base_spans(layer):
                at = _span(s, e, starts, ends)
                found.add((at[0], k, at[1]))
        work.append(_inner(layer, starts, ends))
    return base, sorted(found)


def spell(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


RESULT = "n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


def _scan_column(texts: Iterable) -> list[pa.Array]:
    out: list[list] = [[] for _ in range(5)]
    for t in texts:
        base, found = scan_text(t.as_py() or "")
        kinds = [k for _, k, _ in base]
        listed = spell(base)
        for column, value in zip(out, (kinds.count(0), kinds.count(1), kinds.count(2), hashlib.sha256(listed.encode()).hexdigest(), listed if len(found) == len(base) else spell(found))):
            column.append(value)
    return [pa.array(c, k) for c, k in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()))]


def scan(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (all, if None) of the documents, then n_assign, n_access, n_hex, base_sha256 and spans; one pass without a shuffle."""
    results = [x.split()[0] for x in RESULT.split(", ")]
    keep = [c for c in (docs.columns if keep is None else keep) if c not in results]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema), RESULT])

    def of(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *_scan_column(batch.column(len(keep)))], [*keep, *results])

    return docs.select(*keep, F.col("text").alias(spare(keep, "text"))).mapInArrow(of, schema)


def redact(docs: DataFrame, mark: str = "[{kind}]") -> DataFrame:
    """The documents with every span (of all layers) replaced by its mark; overlapping spans become one, of the first kind. Other texts and null ones stay."""
    text_batches(docs.sparkSession)

    @F.arrow_udf("string")
    def clean(texts: pa.Array) -> pa.Array:
        out = []
        for t in texts:
            text = t.as_py()
            if text:
                spans = scan_text(text)[1]
                parts, at = [], 0
                for s, k, e in spans:
                    if s >= at:
                        parts += [text[at:s], mark.format(kind=KINDS[k])]
                    at = max(at, e)
                text = "".join([*parts, text[at:]]) if spans else text
            out.append(text)
        return pa.array(out, pa.string())

    return docs.withColumn("text", clean("text"))


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(read(spark, sf_dir, "documents"), ["doc_id"])


QUERIES = {"op8_secrets": op8_secrets}
ORACLE_SQL: dict[str, str] = {}
