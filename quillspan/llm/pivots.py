"""Embedding near-duplicates by a pivot-permutation index.

Pivots are a bounded sample of the vectors, spread out: one as close to an earlier pivot as ``SPREAD`` is passed over, so a dense
group cannot supply the pivots that its members are told apart by. A vector within ``OWNED`` of its nearest pivot belongs to
it and is compared with all vectors that its links can be among, those of the pivot's ball (by the triangle inequality of
angles), so no link of it is lost. Any other vector is described by its ``prefix`` nearest pivots; the inverted list of a
pivot holds the vectors that have it among theirs. Two of them are candidates if they share at least ``min_shared`` pivots.
Candidates are links if their cosine, in double precision, is at least ``threshold``. A pair is looked at in the ball of its
first owner or, with none, in the list of its first shared pivot only. Balls and lists longer than ``BLOCK`` are dealt out as
pairs of blocks, so a task holds two blocks, however hot a pivot is.
Of the links a task returns sums per vector and a spanning forest, never the pairs, so groups of n copies cost O(n) rows.

Vectors of different dimensions are in one index, the shorter ones as if zeros followed, and only pairs of the same dimension
are looked at. Equal vectors are one representative with a count. Null, zero, or non-finite vectors link with nothing. A null vec_id is counted by its neighbours and is not kept; repeated rows count as further vectors.
Extra columns are ignored; an empty table gives an empty result. Measured recall is in the tests and the README.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspan.llm.common import components, read, stored

THRESHOLD, PREFIX, MIN_SHARED, BLOCK = 0.95, 12, 2, 1024
#: Pivots: one for so many vectors, within these bounds.
VECTORS_A_PIVOT, LEAST_PIVOTS, MOST_PIVOTS = 64, 64, 4096
#: Cosines that pivots stay under, the next where the one before leaves too few; candidates for one pivot; the cosine to its pivot of an owned vector.
SPREAD, CANDIDATES, OWNED = (0.6, 0.7, 0.8), 4, 0.9


def _unit(rows: list) -> np.ndarray:
    x = np.array(rows, np.float64)
    return x / np.sqrt((x * x).sum(1))[:, None]


def _by_width(rows: list) -> dict[int, np.ndarray]:
    """Which of the vectors are of each dimension."""
    widths = np.array([len(r) for r in rows], np.int64)
    return {int(w): np.flatnonzero(widths == w) for w in np.unique(widths)}


def _padded(rows: list) -> np.ndarray:
    """Unit vectors of the longest's dimension, the shorter ones followed by zeros."""
    x = np.zeros((len(rows), max(map(len, rows), default=0)))
    for width, own in _by_width(rows).items():
        x[own, :width] = _unit([rows[k] for k in own])
    return x


def _close(found: np.ndarray, a: list, b: list, threshold: float) -> np.ndarray:
    """Of the pairs found, those of the same dimension with a cosine of at least the threshold."""
    out = np.zeros_like(found)
    in_b = _by_width(b)
    for width, i in _by_width(a).items():
        if (j := in_b.get(width)) is not None and (some := found[np.ix_(i, j)]).any():
            out[np.ix_(i, j)] = some & (_unit([a[k] for k in i]) @ _unit([b[k] for k in j]).T >= threshold)
    return out


def _spread(x: np.ndarray, most: int) -> np.ndarray:
    """``most`` of the unit vectors at most, in order, none as close to another as SPREAD."""
    chosen: list[int] = []
    nearest = np.full(len(x), -1.0)
    for limit in SPREAD:
        for i in range(len(x)):
            if len(chosen) < most and nearest[i] < limit:
                chosen.append(i)
                nearest = np.maximum(nearest, x @ x[i])
    return x[chosen]


def _owned_links(a: pd.DataFrame, b: pd.DataFrame, pivot: int, same: bool, threshold: float) -> np.ndarray:
    """Which of a's vectors link with which of b's, of the pairs whose first owner is ``pivot``."""
    found = np.minimum(a.owner.to_numpy()[:, None], b.owner.to_numpy()[None, :]) == pivot
    if same:
        found &= np.triu(np.ones(found.shape, bool), 1)
    if found.any():
        found = _close(found, a.v.tolist(), b.v.tolist(), threshold)
    return found


def _links_between(a: pd.DataFrame, b: pd.DataFrame, pivot: int, same: bool, threshold: float, min_shared: int) -> np.ndarray:
    """Which of a's vectors link with which of b's, of the pairs whose first shared pivot is ``pivot``."""
    pa_, pb = np.stack(a.pivots.to_numpy()), np.stack(b.pivots.to_numpy())
    shared, first = np.zeros((len(a), len(b)), np.uint8), np.ones((len(a), len(b)), bool)
    at_b: dict[int, list[int]] = {}
    for j, row in enumerate(pb.tolist()):
        for q in row:
            at_b.setdefault(q, []).append(j)
    at_a: dict[int, list[int]] = {}
    for i, row in enumerate(pa_.tolist()):
        for q in row:
            if q in at_b:
                at_a.setdefault(q, []).append(i)
    for q, i in at_a.items():
        where = np.ix_(i, at_b[q])
        if q < pivot:
            first[where] = False
        else:
            shared[where] += 1
    found = first & (shared >= min_shared)
    if same:
        found &= np.triu(np.ones(found.shape, bool), 1)
    if found.any():
        found = _close(found, a.v.tolist(), b.v.tolist(), threshold)
    return found


def _block_pair(key: tuple, rows: pd.DataFrame, threshold: float, min_shared: int, n_pivots: int) -> pd.DataFrame:
    """Lists are numbered as their pivots, balls by ``n_pivots`` more."""
    pivot, i, j = (int(x) for x in key)
    a, b = rows[rows.block == i], rows[rows.block == j]
    if not len(a) or not len(b):
        found = np.zeros((0, 0), bool)
    elif pivot >= n_pivots:
        found = _owned_links(a, b, pivot - n_pivots, i == j, threshold)
    else:
        found = _links_between(a, b, pivot, i == j, threshold, min_shared)
    if not found.any():
        return pd.DataFrame({"id": [], "n": [], "to": []}, dtype="int64")
    ids = np.concatenate([a.id.to_numpy(), b.id.to_numpy()])
    counts_a, counts_b = found @ b["count"].to_numpy(), found.T @ a["count"].to_numpy()
    # least label of the neighbourhood, again and again: a spanning forest of the local components
    label, la = ids.copy(), len(a)
    big = np.iinfo(np.int64).max
    while True:
        ra, rb = label[:la], label[la:]
        na = np.minimum(ra, np.where(found, rb[None, :], big).min(1))
        nb = np.minimum(rb, np.where(found, na[:, None], big).min(0))
        after = np.concatenate([na, nb])
        if i == j:  # both sides are the same vectors
            after = np.tile(np.minimum(after[:la], after[la:]), 2)
        if (after == label).all():
            break
        label = after
    out = pd.DataFrame({"id": ids, "n": np.concatenate([counts_a, counts_b]), "to": label})
    return out[(out.n > 0) | (out.to != out.id)].astype("int64")


def near_vectors(vectors: DataFrame, threshold: float = THRESHOLD, prefix: int = PREFIX, min_shared: int = MIN_SHARED, n_pivots: int | None = None, block: int = BLOCK) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of ``vectors(vec_id, embedding)``."""
    base = vectors.select("vec_id", "embedding")
    squares = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x)
    usable = base.where(F.col("embedding").isNotNull()).where(~F.exists("embedding", lambda x: x.isNull()) & (squares > 0) & (squares < float("inf")) & ~F.isnan(squares))
    # equal vectors become one; the number of a representative is the least id of its copies
    groups = usable.groupBy("embedding").agg(F.min("vec_id").alias("least"), F.count("*").alias("count"))
    reps = stored(groups.select(F.xxhash64("embedding", "least").alias("id"), "embedding", "least", "count"))
    total = reps.count()
    n_pivots = n_pivots or min(MOST_PIVOTS, max(LEAST_PIVOTS, total // VECTORS_A_PIVOT))
    sample = [r.embedding for r in reps.orderBy("id").limit(CANDIDATES * n_pivots).select("embedding").collect()]
    pivots = _spread(_padded(sample), n_pivots).T
    count = pivots.shape[1]
    near = min(prefix, count)
    min_shared = min(min_shared, near)
    ball = np.cos(min(np.pi, np.arccos(OWNED) + np.arccos(threshold))) - 1e-9
    if not near:
        return base.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.col("vec_id").isNotNull().alias("kept"))

    @F.arrow_udf("struct<pivots: array<int>, keys: array<int>, owner: int>")
    def nearest(embedding: pa.Array) -> pa.Array:
        """The nearest pivots, the numbers of the lists and balls, and the owner or a number beyond all pivots."""
        rows = embedding.to_pylist()
        close = np.empty((len(rows), count))
        for width, own in _by_width(rows).items():
            most = min(width, len(pivots))
            close[own] = _unit([rows[k] for k in own])[:, :most] @ pivots[:most]
        top = np.argpartition(-close, near - 1, 1)[:, :near]
        order = np.take_along_axis(top, np.argsort(-np.take_along_axis(close, top, 1), 1, kind="stable"), 1)
        owner = np.where(np.take_along_axis(close, order[:, :1], 1)[:, 0] >= OWNED, order[:, 0], count)
        described = [[] if o < count else row for o, row in zip(owner, order.tolist())]
        keys = [row + (np.flatnonzero(c >= ball) + count).tolist() for row, c in zip(described, close)]
        ints = pa.list_(pa.int32())
        return pa.StructArray.from_arrays([pa.array(described, ints), pa.array(keys, ints), pa.array(owner.astype(np.int32))], ["pivots", "keys", "owner"])

    indexed = reps.select("id", "count", F.col("embedding").alias("v"), nearest("embedding").alias("at"))
    lists = stored(indexed.select("id", "count", "v", "at.pivots", "at.owner", F.explode("at.keys").alias("pivot")))
    sizes = {r.pivot: r.n for r in lists.groupBy("pivot").agg(F.count("*").alias("n")).collect()}  # two rows per pivot
    blocks = np.ones(2 * count, np.int64)
    for p, n in sizes.items():
        blocks[p] = -(-n // block)
    many = F.element_at(F.array(*(F.lit(int(x)) for x in blocks)), F.col("pivot") + 1) if len(set(blocks)) > 1 else F.lit(int(blocks[0]))
    dealt = lists.withColumn("blocks", many).withColumn("block", F.pmod(F.col("id"), F.col("blocks")).cast("int"))
    # block b meets every block once: as the first of the pair or as the second
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), (F.col("blocks") - 1).cast("int"))))
    dealt = dealt.select("pivot", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "id", "count", "v", "pivots", "owner")
    found = stored(dealt.groupBy("pivot", "i", "j").applyInPandas(lambda key, rows: _block_pair(key, rows, threshold, min_shared, count), "id long, n long, to long"))
    links = found.groupBy("id").agg(F.sum("n").alias("n"))
    roots = components(found.select(F.col("id").alias("a"), F.col("to").alias("b")))
    # components are of representatives, whose numbers are hashes; the least vec_id of each is looked up
    with_root = reps.select("id", "least").join(roots.withColumnRenamed("node", "id"), "id", "left").select("id", "least", F.coalesce("root", "id").alias("root"))
    least = with_root.groupBy("root").agg(F.min("least").alias("component"))
    by_rep = reps.join(with_root.drop("least"), "id").join(least, "root").join(links, "id", "left").select("embedding", "count", F.coalesce("n", F.lit(0)).alias("n"), "component")
    joined = base.join(by_rep, "embedding", "left")
    component = F.coalesce("component", "vec_id")
    return joined.select("vec_id", F.coalesce(F.col("n") + F.col("count") - 1, F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))


def op2_pivot_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(read(spark, sf_dir, "embeddings"))


QUERIES = {"op2_pivot_index": op2_pivot_index}
ORACLE_SQL: dict[str, str] = {
    "op2_pivot_index": """
WITH RECURSIVE good AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x))) > 0),
links AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM good a, good b WHERE a.vec_id <> b.vec_id AND list_cosine_similarity(a.v, b.v) >= 0.95),
reach AS (SELECT a, b FROM links UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
least AS (SELECT a, min(b) AS b FROM reach GROUP BY a),
counts AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, least(vec_id, coalesce(least.b, vec_id)) AS component_id, vec_id = least(vec_id, coalesce(least.b, vec_id)) AS kept
FROM embeddings LEFT JOIN counts ON counts.a = vec_id LEFT JOIN least ON least.a = vec_id
"""
}
