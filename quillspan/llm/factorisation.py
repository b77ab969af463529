"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

The score of a document with features x is the logistic of b + w.x + the sum over pairs of <v_i, v_j> x_i x_j. The pairs are
never visited: by the sum-of-squares identity they are half of (sum of v x) squared less the sum of (v x) squared, a
time linear in the document's features. Words are hashed into ``BUCKETS`` and weighted by their share of the document; structure
statistics (of the text) and metadata (the text's size in characters and lines) are one bucket each out of fixed ranges.

The model is fitted on the driver by Adam over at most ``MAX_FIT`` labelled documents, taken in the order of a hash of their
ids; this bound is the only one. Labels, lang, source and doc_id are no features.

Null text counts as empty; empty texts get the score of their statistics. A null doc_id is not held out. Null labels are not
used; with no labels at all every score is 0.5. Repeated rows are scored each. Extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspan.llm.common import read, spare

BUCKETS, FACTORS = 1 << 15, 8
MAX_FIT, EPOCHS, BATCH, RATE, DECAY = 12_000, 5, 64, 0.02, 1e-4
#: Ranges of the statistics: shares by tenths of a logarithm, sizes by powers of two.
_SHARES = np.array([0.0, 0.002, 0.005, 0.01, 0.02, 0.05, 0.1, 0.2, 0.35, 0.5, 0.7, 0.9])
_SIZES = 2.0 ** np.arange(0, 20)
_KINDS = (*["share"] * 10, *["size"] * 5)
_WIDTH = 24
FEATURES = BUCKETS + _WIDTH * len(_KINDS)
_SYMBOL_BYTES = np.frombuffer(b"#*$%&|<>@^~=+_{}[]\\/", np.uint8)


def statistics(raw: bytes, words: list[bytes], n_chars: int) -> list[float]:
    """Shares first, then sizes, in the order of ``_KINDS``."""
    n, m = max(1, len(words)), max(1, len(raw))
    of = np.bincount(np.frombuffer(raw, np.uint8), minlength=256) if raw else np.zeros(256, np.int64)
    letters = max(1, int(of[65:91].sum() + of[97:123].sum()))
    different = len(set(words))
    same = sum(map(bytes.__eq__, words, words[1:]))
    lines = raw.count(b"\n") + 1
    return [
        of[65:91].sum() / letters,
        of[48:58].sum() / m,
        of[_SYMBOL_BYTES].sum() / m,
        (of[33] + of[63]) / m,
        (of[44] + of[46]) / m,
        of[128:].sum() / m,
        1 - different / n,
        same / n,
        of[124] / n,
        (of[32] + of[9]) / m,
        n_chars,
        n,
        m / n,
        n / lines,
        lines,
    ]


def features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(feature numbers, values) of a text: hashed words of unit length together, then one bucket of each statistic."""
    raw = text.encode("utf-8", "replace")
    words = raw.split()
    numbers, counts = np.unique(np.fromiter(map(zlib.crc32, words), np.int64, len(words)) & (BUCKETS - 1), return_counts=True)
    values = counts / max(1e-9, float(np.sqrt(np.dot(counts, counts))))
    own = [
        BUCKETS + _WIDTH * i + int(np.searchsorted(_SHARES if kind == "share" else _SIZES, x, "right"))
        for i, (kind, x) in enumerate(zip(_KINDS, statistics(raw, words, len(text))))
    ]
    return np.concatenate([numbers, own]).astype(np.int32), np.concatenate([values, np.full(len(own), 0.5)]).astype(np.float32)


class Machine:
    """Weights and the score."""

    def __init__(self, bias: float, weights: np.ndarray, factors: np.ndarray):
        self.bias, self.weights, self.factors = bias, weights, factors

    def raw(self, numbers: np.ndarray, values: np.ndarray) -> float:
        vx = self.factors[numbers] * values[:, None]
        s = vx.sum(0)
        return self.bias + float(self.weights[numbers] @ values) + 0.5 * float(s @ s - np.einsum("ij,ij->", vx, vx))

    def score(self, text: str) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.raw(*features(text)), -40, 40))))


def train(rows: list[tuple[np.ndarray, np.ndarray, int]], seed: int = 7) -> Machine:
    """Fits by Adam on the logistic loss, in ``EPOCHS`` passes over mini-batches; labels are weighted to half the way to balance."""
    rng = np.random.default_rng(seed)
    w, v = np.zeros(FEATURES, np.float32), rng.normal(0, 0.01, (FEATURES, FACTORS)).astype(np.float32)
    if not rows:
        return Machine(0.0, w, np.zeros_like(v))
    share = min(0.95, max(0.05, float(np.mean([y for *_, y in rows]))))
    b = float(np.log(share / (1 - share)))
    if len({y for *_, y in rows}) < 2:
        return Machine(b, w, np.zeros_like(v))
    params = np.concatenate([w[:, None], v], 1)
    m1, m2, t, b1, b2 = np.zeros_like(params), np.zeros_like(params), 0, 0.0, 0.0
    weight = {1: (0.5 / share) ** 0.5, 0: (0.5 / (1 - share)) ** 0.5}
    for _ in range(EPOCHS):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), BATCH):
            some = [rows[i] for i in order[at : at + BATCH]]
            numbers, x = np.concatenate([r[0] for r in some]), np.concatenate([r[1] for r in some])
            sizes = np.array([len(r[0]) for r in some])
            begin = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            own = params[numbers]
            vx = own[:, 1:] * x[:, None]
            s = np.add.reduceat(vx, begin, 0)
            z = b + np.add.reduceat(own[:, 0] * x, begin) + 0.5 * ((s * s).sum(1) - np.add.reduceat((vx * vx).sum(1), begin))
            y = np.array([r[2] for r in some])
            g = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y) * np.where(y == 1, weight[1], weight[0]) / len(some)
            each = np.repeat(g, sizes) * x
            grads = np.concatenate([each[:, None], each[:, None] * (np.repeat(s, sizes, 0) - vx)], 1)
            touched, place = np.unique(numbers, return_inverse=True)
            total = np.stack([np.bincount(place, grads[:, k], len(touched)) for k in range(FACTORS + 1)], 1) + DECAY * params[touched]
            t += 1
            m1[touched] = 0.9 * m1[touched] + 0.1 * total
            m2[touched] = 0.999 * m2[touched] + 0.001 * total * total
            params[touched] -= RATE * (m1[touched] / (1 - 0.9**t)) / (np.sqrt(m2[touched] / (1 - 0.999**t)) + 1e-8)
            gb = float(g.sum())
            b1, b2 = 0.9 * b1 + 0.1 * gb, 0.999 * b2 + 0.001 * gb * gb
            b -= RATE * (b1 / (1 - 0.9**t)) / ((b2 / (1 - 0.999**t)) ** 0.5 + 1e-8)
    return Machine(b, params[:, 0].copy(), params[:, 1:].copy())


def held_out(doc_id="doc_id"):
    """True for ids whose crc32, taken of their decimal text, leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, max_fit: int = MAX_FIT) -> Machine:
    """A machine for ``labels(doc_id, quality)``, fitted on rows that are not held out, ``max_fit`` at most."""
    known = labels.where(F.col("quality").isNotNull() & ~held_out()).select("doc_id", F.col("quality").alias("_label"))
    some = known.orderBy(F.xxhash64("doc_id"), "doc_id", "_label").limit(max_fit)

    def of(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [features(t.as_py() or "") for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int32()), pa.array([a.tobytes() for a, _ in found], pa.binary()), pa.array([x.tobytes() for _, x in found], pa.binary())], ["y", "i", "x"])

    # the labels' side has max_fit rows at most; results are as many rows of sparse features
    picked = docs.select("doc_id", "text").join(F.broadcast(some), "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id", "_label").limit(max_fit).select("_label", "text")
    rows = picked.mapInArrow(of, "y int, i binary, x binary").collect()
    return train([(np.frombuffer(r.i, np.int32), np.frombuffer(r.x, np.float32), int(r.y > 0)) for r in rows])


def score(docs: DataFrame, machine: Machine, keep: list[str]) -> DataFrame:
    """The columns ``keep``, then score (double) and predicted (int), in one pass over the texts."""
    keep = [c for c in keep if c not in ("score", "predicted")]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema), "score double, predicted int"])

    def of(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([machine.score(t.as_py() or "") for t in batch.column(len(keep))], float)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found), pa.array((found >= 0.5).astype(np.int32))], [*keep, "score", "predicted"])

    return docs.select(*keep, F.col("text").alias(spare(keep, "text"))).mapInArrow(of, schema)


def op1_factorisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    machine = fit(docs, read(spark, sf_dir, "labels"))
    return score(docs.withColumn("held_out", held_out()), machine, ["doc_id", "held_out"])


QUERIES = {"op1_factorisation": op1_factorisation}
ORACLE_SQL: dict[str, str] = {}
