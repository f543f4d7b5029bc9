"""Near-duplicate vectors by a pivot-permutation index.

Reference points are thinned from a bounded sample so that no two are close. A
vector is described by its NEAREST nearest reference points in order, nearest
first, and filed in the inverted lists of its first FILED. The lists say which
vectors share how many reference points: a pair that shares one of the first
FILED of both, and another among the NEAREST, is a candidate, and only
candidates are verified by their cosine in double precision. A pair belongs to
the list of the smallest reference point that is among the first of both. A list
longer than BLOCK is parted by the other reference points of its vectors, where a
pair belongs to the part of the smallest other one it shares: it counts once.

Equal vectors are one point with a weight, so groups of copies cost nothing. A
part that is still longer than BLOCK is dealt into blocks that meet pair by
pair; only sums and one root per vector leave a block, never its pairs.

Vectors that are null, empty or zero, or hold null or non-finite components,
and vectors with a null id, link with nothing: n_links 0, a component of their
own (null for a null id), kept. Vectors of different dimensions never link.
Repeated rows of an id count as one vector and get a row each. Empty table: no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import blocks, by_group, components, cut, forget, ship, table
from .vectors import by_size, packed, unit

COSINE = 0.9
#: Reference points: twice the root of the number of vectors, within these bounds.
LEAST_PIVOTS, MOST_PIVOTS = 16, 4096
#: The sample has so many vectors for each reference point; no two reference points are closer than APART.
SAMPLE, APART = 4, 0.6
#: Of pairs at the threshold, with 4,096 reference points and vectors in no clusters at all, 98 % are candidates.
NEAREST, FILED, BLOCK = 10, 6, 4096
#: Sizes of up to so many lists go to every task; more are joined by a shuffle.
BROADCAST_LISTS = 100_000


def choose_pivots(x: np.ndarray, n: int) -> np.ndarray:
    """At most ``n`` rows of unit vectors, in order, none nearer than APART to an earlier one."""
    chosen: list[int] = []
    near = np.full(len(x), -1.0)
    for i in range(len(x)):
        if near[i] < APART:
            chosen.append(i)
            if len(chosen) == n:
                break
            near = np.maximum(near, x @ x[i])
    return x[chosen]


def pivots_of(points: DataFrame) -> dict[int, np.ndarray]:
    """Reference points for each dimension, from a sample of bounded size."""
    n = points.count()
    if not n:
        return {}
    want = int(min(MOST_PIVOTS, max(LEAST_PIVOTS, np.ceil(2 * np.sqrt(n)))))
    share = min(1.0, SAMPLE * want / n)
    picked = points.where(F.pmod(F.xxhash64("id", F.lit("pivot")), F.lit(1_000_000)) < F.lit(int(1_000_000 * share) + 1)).select("id", "vec").orderBy("id").toPandas()
    raw = [bytes(v) for v in picked["vec"]]
    return {x.shape[1]: choose_pivots(unit(x), want) for _, x in by_size(raw)}


def described(points: DataFrame, pivots: dict[int, np.ndarray], kind: str) -> DataFrame:
    """(id, weight, dim, near, vec): points with their nearest pivots, nearest first; -1 alone where there are too few to share two."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in range(0, batch.num_rows, 2048):
                part = batch.slice(s, 2048)
                raw, ids, weight = part.column(2).to_pylist(), part.column(0).to_numpy(), part.column(1).to_numpy()
                for at, x in by_size(raw):
                    refs = pivots.get(x.shape[1], np.zeros((0, x.shape[1])))
                    n, k = len(at), min(NEAREST, len(refs))
                    if k < 2:
                        near = np.full((n, 1), -1, np.int32)
                    else:
                        far = -(unit(x) @ refs.T)
                        near = np.argpartition(far, k - 1, axis=1)[:, :k]
                        near = np.take_along_axis(near, np.argsort(np.take_along_axis(far, near, 1), axis=1, kind="stable"), 1).astype(np.int32)
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * near.shape[1]), pa.array(near.ravel()))
                    vec = pa.array([row.tobytes() for row in x.astype(kind)], pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array(ids[at]), pa.array(weight[at]), pa.array(np.full(n, x.shape[1], np.int32)), lists, vec], ["id", "weight", "dim", "near", "vec"])

    return points.select("id", "weight", "vec").mapInArrow(run, "id long, weight long, dim int, near array<int>, vec binary")


def filed(points: DataFrame, few: bool) -> DataFrame:
    """(dim, pivot, parts, part, id, weight, near, vec): described points in the inverted lists of their first pivots, long lists in parts.

    ``few``: the number of lists is known to be bounded, so their sizes go to every task.
    """
    first = F.slice("near", F.lit(1), F.lit(FILED))
    # a list's rows are in as many parts as they have other pivots, so a long one gets so many times more parts
    parts = F.when((F.count(F.lit(1)) > BLOCK) & (F.col("pivot") >= 0), F.ceil(F.count(F.lit(1)) * (NEAREST - 1) / F.lit(BLOCK))).otherwise(1).cast("int")
    sizes = points.select("dim", F.explode(first).alias("pivot")).groupBy("dim", "pivot").agg(parts.alias("parts"))
    others = F.array_except("near", F.array("pivot"))
    part = F.explode(F.when(F.col("parts") == 1, F.array(F.lit(0))).otherwise(F.array_distinct(F.transform(others, lambda q: F.pmod(q, F.col("parts"))))))
    at = points.select("*", F.explode(first).alias("pivot"))
    return at.join(F.broadcast(sizes) if few else sizes, ["dim", "pivot"]).select("dim", "pivot", "parts", part.alias("part"), "id", "weight", "near", "vec")


def _candidates(near: np.ndarray, pivot: int, rows: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Whether each of ``rows`` shares another pivot than ``pivot`` with each of ``others``: shared-pivot counts from inverted lists."""
    shared = np.zeros((len(rows), len(others)), bool)

    def lists(at: np.ndarray) -> dict[int, np.ndarray]:
        flat = near[at].ravel()
        order = np.argsort(flat, kind="stable")
        names, starts = np.unique(flat[order], return_index=True)
        return dict(zip(names.tolist(), np.split(order // near.shape[1], starts[1:])))

    right = lists(others)
    for name, mine in lists(rows).items():
        if name != pivot and name in right:
            shared[np.ix_(mine, right[name])] = True
    return shared


def _owner(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For rows of ``a`` and ``b`` the smallest pivot among the first of both, and the smallest other one that they share."""
    none = np.iinfo(np.int32).max
    equal = a[:, :, None] == b[:, None, :]
    one = np.where(equal[:, :FILED, :FILED].any(2), a[:, :FILED], none).min(1)
    two = np.where(equal.any(2) & (a != one[:, None]), a, none).min(1)
    return np.stack((one, two), axis=1)


def _roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest place that each of ``n`` places is linked to over (i, j)."""
    low = np.arange(n)
    while True:
        new = low.copy()
        np.minimum.at(new, i, low[j])
        np.minimum.at(new, j, low[i])
        new = new[new]
        if np.array_equal(new, low):
            return low
        low = new


#: Where more than one in so many pairs of a tile are candidates, one matrix product gives all their cosines.
DENSE = 30
KEY = ["dim", "pivot", "part", "bi", "bj"]


def _search(part: pa.Table, kind: str) -> Iterator[pa.RecordBatch]:
    """(id, links, root) of every point with a link in a block pair."""
    dim, pivot, group, bi, bj = keys = [part.column(c).to_numpy() for c in KEY]
    own, parts, ids, weight = (part.column(c).to_numpy() for c in ("own", "parts", "id", "weight"))
    near_raw, vec_raw = part.column("near").to_pylist(), part.column("vec").to_pylist()
    new = np.ones(len(dim), bool)
    new[1:] = False
    for x in keys:
        new[1:] |= x[1:] != x[:-1]
    edge = np.flatnonzero(new)
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for s, e in zip(edge.tolist(), np.append(edge[1:], len(dim)).tolist()):
        if e - s < 2:
            continue
        order = s + np.argsort(ids[s:e], kind="stable")
        x = unit(np.frombuffer(b"".join(vec_raw[i] for i in order.tolist()), kind).reshape(e - s, -1).astype(np.float64))
        left, right = (np.arange(e - s), np.arange(e - s)) if bi[s] == bj[s] else (np.flatnonzero(own[order] == bi[s]), np.flatnonzero(own[order] == bj[s]))
        near = np.array([near_raw[k] for k in order.tolist()], np.int32)
        alone = near[0, 0] < 0
        found = []
        for a in range(0, len(left), 512):
            rows = left[a : a + 512]
            could = np.ones((len(rows), len(right)), bool) if alone else _candidates(near, int(pivot[s]), rows, right)
            if bi[s] == bj[s]:
                could &= right[None, :] > rows[:, None]
            i, j = np.nonzero(could)
            if len(i) * DENSE > could.size:
                near_by = (x[rows] @ x[right].T)[i, j] >= COSINE
            else:
                near_by = np.concatenate([np.einsum("ij,ij->i", x[rows[i[c : c + 65536]]], x[right[j[c : c + 65536]]]) >= COSINE for c in range(0, len(i), 65536)] or [np.zeros(0, bool)])
            found.append((rows[i[near_by]], right[j[near_by]]))
        i, j = (np.concatenate(c) for c in zip(*found)) if found else (left, left)
        if not len(i):
            continue
        mine = np.ones(len(i), bool)
        if not alone:
            for a in range(0, len(i), 200_000):
                two = _owner(near[i[a : a + 200_000]], near[j[a : a + 200_000]])
                mine[a : a + 200_000] = (two[:, 0] == pivot[s]) & (two[:, 1] % parts[s] == group[s])
        w = weight[order]
        links = np.bincount(i[mine], weights=w[j[mine]], minlength=e - s) + np.bincount(j[mine], weights=w[i[mine]], minlength=e - s)
        i, j = i[mine], j[mine]
        linked = np.unique(np.concatenate((i, j)))
        root = _roots(e - s, i, j)
        out.append((ids[order][linked], links[linked].astype(np.int64), ids[order][root[linked]]))
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], ["id", "links", "root"])


def near_duplicate_vectors(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row."""
    ship(vectors.sparkSession)
    rows = cut(packed(vectors, id_col, vec_col))
    valid = rows.where("name is not null")
    # all rows of a name hold the same values, so any of them will do
    sizes = valid.select("name", "vec_id").distinct().groupBy("name").agg(F.min("vec_id").alias("id"), F.count(F.lit(1)).alias("weight"))
    points = cut(sizes.join(valid.groupBy("name").agg(F.first("vec").alias("vec")), "name"))
    # components that were single floats travel as such
    kind = "<f4" if "array<float>" in vectors.select(vec_col).schema.simpleString() else "<f8"
    pivots = pivots_of(points)
    index = cut(described(points, pivots, kind))
    most = index.select("dim").distinct().count() + sum(map(len, pivots.values()))
    lists = filed(index, most <= BROADCAST_LISTS)
    dealt = blocks(lists, KEY[:3], "id", BLOCK).select(*KEY, "own", "parts", "id", "weight", "near", "vec")
    found = cut(by_group(dealt, KEY, lambda part: _search(part, kind), "id long, links long, root long"))
    forget(index)
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    comp = cut(components(found.where("id <> root").select(F.col("id").alias("a"), F.col("root").alias("b"))))
    per_name = points.select("name", "id", "weight").join(links, "id", "left").join(comp, "id", "left").select(
        "name", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "id").alias("component_id")
    )
    return rows.join(per_name, "name", "left").select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", "vec_id").alias("component_id"),
        F.coalesce(F.col("vec_id") == F.coalesce("component_id", "vec_id"), F.lit(True)).alias("kept"),
    )


def op1_pivot_permutation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_vectors(table(spark, sf_dir, "embeddings"))
