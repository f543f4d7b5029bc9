"""Maximum inner product search with score-aware quantisation and exact reranking.

Codebooks of 16 centres for every two components are fitted so that the part of
the residual along the vector counts ETA times the rest: it is the part that
changes large inner products. Codes are chosen by coordinate descent on that
loss. A search adds up table entries for the four-bit codes (two codes a byte),
takes the best by estimate for a first bound, and reranks every vector whose
estimate plus its own error margin reaches the bound, by the exact inner
product in double precision. There is no cap on the vectors reranked.

Queries meet the rows in blocks of bounded size on both sides; a block returns
its K best for each query, which are then merged.

Vectors null, empty or zero, or with null or non-finite components, or a null
id take no part. Queries and rows of different dimensions don't meet. Repeated
rows of an id are one candidate. Ties go to the smaller id. Fewer candidates
than K: all of them. Empty table: no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import by_group, cut, ship, table
from .vectors import by_size, matrix, packed

K, QUERY_EVERY = 20, 20
#: Vectors that the codebooks are fitted on, at most; centres of a codebook; components of a subspace.
SAMPLE, CENTRES, SUB = 8192, 16, 2
#: Inner products from this share of the norms on are what the codes are for; it sets ETA.
THRESHOLD, ROUNDS = 0.2, 8
#: Margin of an estimate, in standard deviations of its error for a residual in no special direction.
MARGIN = 3.0
ROWS, QUERIES = 8192, 2048


class Codebook:
    """Product codes of one dimension."""

    def __init__(self, sample: np.ndarray):
        self.dim = sample.shape[1]
        self.subs = -(-self.dim // SUB)
        self.subs += self.subs % 2
        self.eta = max(1.0, (self.dim - 1) * THRESHOLD**2 / (1 - THRESHOLD**2))
        x, along = self._split(sample)
        n = len(x)
        pick = np.linspace(0, n - 1, CENTRES).astype(int)
        self.centres = np.stack([x[np.argsort(x[:, m].sum(1), kind="stable")[pick], m] for m in range(self.subs)])
        codes = np.stack([((x[:, m, None] - self.centres[m]) ** 2).sum(2).argmin(1) for m in range(self.subs)], axis=1)
        for _ in range(ROUNDS):
            rest = self._along(x, along, codes)
            for m in range(self.subs):
                rest -= ((x[:, m] - self.centres[m][codes[:, m]]) * along[:, m]).sum(1)
                for c in range(CENTRES):
                    at = codes[:, m] == c
                    if at.any():
                        a, xs, r = along[at, m], x[at, m], rest[at]
                        left = at.sum() * np.eye(SUB) + (self.eta - 1) * a.T @ a
                        right = xs.sum(0) + (self.eta - 1) * (a * (r + (xs * a).sum(1))[:, None]).sum(0)
                        self.centres[m, c] = np.linalg.solve(left, right)
                codes[:, m], rest = self._choose(x, along, rest, m)

    def _split(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        x = np.pad(x, ((0, 0), (0, self.subs * SUB - x.shape[1])))
        along = x / np.sqrt((x * x).sum(1, keepdims=True))
        return x.reshape(len(x), self.subs, SUB), along.reshape(len(x), self.subs, SUB)

    def _along(self, x: np.ndarray, along: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """The residual's part along the vector."""
        out = np.zeros(len(x))
        for m in range(self.subs):
            out += ((x[:, m] - self.centres[m][codes[:, m]]) * along[:, m]).sum(1)
        return out

    def _choose(self, x: np.ndarray, along: np.ndarray, rest: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray]:
        """The best code of a subspace, given what the others leave along the vector; and that part with it."""
        r = x[:, m, None, :] - self.centres[m]
        part = (r * along[:, m, None, :]).sum(2)
        loss = (r**2).sum(2) + (self.eta - 1) * (rest[:, None] + part) ** 2
        best = loss.argmin(1)
        return best, rest + part[np.arange(len(x)), best]

    def encode(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Packed codes (two a byte) and residual norms."""
        x, along = self._split(rows)
        codes = np.stack([((x[:, m, None] - self.centres[m]) ** 2).sum(2).argmin(1) for m in range(self.subs)], axis=1)
        for _ in range(2):
            rest = self._along(x, along, codes)
            for m in range(self.subs):
                rest -= ((x[:, m] - self.centres[m][codes[:, m]]) * along[:, m]).sum(1)
                codes[:, m], rest = self._choose(x, along, rest, m)
        kept = self.centres[np.arange(self.subs), codes]
        error = np.sqrt(((x - kept) ** 2).sum((1, 2)))
        return (codes[:, 0::2] | codes[:, 1::2] << 4).astype(np.uint8), error

    def tables(self, query: np.ndarray) -> np.ndarray:
        """For each byte of a code, the share of the inner product that each of its 256 values stands for."""
        q = np.pad(query, (0, self.subs * SUB - len(query))).reshape(self.subs, SUB)
        each = (self.centres * q[:, None, :]).sum(2)
        return (each[1::2, :, None] + each[0::2, None, :]).reshape(self.subs // 2, 256).astype(np.float32)


def codebooks(rows: DataFrame) -> dict[int, Codebook]:
    """A codebook for each dimension, fitted on a sample of bounded size."""
    n = rows.count()
    share = min(1.0, SAMPLE / max(n, 1))
    picked = rows.where(F.pmod(F.xxhash64("vec_id", F.lit("codes")), F.lit(1_000_000)) < F.lit(int(1_000_000 * share) + 1)).select("vec_id", "vec").orderBy("vec_id").toPandas()
    return {x.shape[1]: Codebook(x) for _, x in by_size([bytes(v) for v in picked["vec"]])}


def coded(rows: DataFrame, books: dict[int, Codebook]) -> DataFrame:
    """Rows with their codes; a dimension that the sample lacks has none and is searched exactly."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in range(0, batch.num_rows, 2048):
                part = batch.slice(s, 2048)
                raw = part.column(1).to_pylist()
                codes: list[bytes] = [b""] * len(raw)
                error = np.zeros(len(raw))
                for at, x in by_size(raw):
                    if x.shape[1] in books:
                        c, error[at] = books[x.shape[1]].encode(x)
                        for i, row in zip(at.tolist(), c):
                            codes[i] = row.tobytes()
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(codes, pa.binary()), pa.array(error)], ["vec_id", "vec", "codes", "error"])

    return rows.select("vec_id", "vec").mapInArrow(run, "vec_id long, vec binary, codes binary, error double")


def _top(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    return np.lexsort((ids, -score))[:k]


def search_block(book: Codebook | None, ids: np.ndarray, x: np.ndarray, codes: np.ndarray | None, error: np.ndarray, q_ids: np.ndarray, q: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """The k best rows of a block for each query: (query id, ids, exact scores)."""
    for query_id, query in zip(q_ids.tolist(), q):
        if book is None or codes is None:
            at = np.flatnonzero(ids != query_id)
        else:
            lookup = book.tables(query)
            guess = lookup[0][codes[0]]
            for j in range(1, len(codes)):
                guess = guess + lookup[j][codes[j]]
            guess[ids == query_id] = -np.inf
            first = np.argpartition(-guess, min(k, len(guess) - 1))[:k]
            first = first[ids[first] != query_id]
            bound = np.sort(x[first] @ query)[0] if len(first) == k else -np.inf
            slack = MARGIN * np.sqrt(query @ query) / np.sqrt(book.dim)
            at = np.flatnonzero((guess + slack * error >= bound) & (ids != query_id))
        # summed in the order of the components, as any engine can repeat it
        score = np.cumsum(x[at] * query, axis=1)[:, -1] if len(at) else np.zeros(0)
        best = _top(score, ids[at], k)
        yield query_id, ids[at][best], score[best]


def nearest(vectors: DataFrame, k: int = K, every: int = QUERY_EVERY, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k rows with the largest inner product for each query."""
    ship(vectors.sparkSession)
    rows = cut(packed(vectors, id_col, vec_col).where("vec is not null").select("vec_id", "vec"))
    books = codebooks(rows)
    n = rows.count()
    parts, q_parts = max(1, -(-n // ROWS)), max(1, -(-n // (every * QUERIES)))
    deal = lambda c, m: F.pmod(F.xxhash64("vec_id", F.lit(c)), F.lit(m)).cast("int")
    all_of = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    data = coded(rows, books).withColumn("part", deal("row", parts)).withColumn("q_part", all_of(q_parts)).withColumn("query", F.lit(False))
    asked = (
        rows.where(F.col("vec_id") % every == 0).withColumn("codes", F.lit(b"")).withColumn("error", F.lit(0.0)).withColumn("q_part", deal("query", q_parts)).withColumn("part", all_of(parts)).withColumn("query", F.lit(True))
    )
    columns = ["part", "q_part", "query", "vec_id", "vec", "codes", "error"]

    def run(table_: pa.Table) -> Iterator[pa.RecordBatch]:
        part, q_part, query = (table_.column(c).to_numpy() for c in columns[:3])
        ids_all, error_all = table_.column("vec_id").to_numpy(), table_.column("error").to_numpy()
        vec_all, codes_all = table_.column("vec").to_pylist(), table_.column("codes").to_pylist()
        edge = np.flatnonzero(np.concatenate(([True], (part[1:] != part[:-1]) | (q_part[1:] != q_part[:-1]))))
        for s, e in zip(edge.tolist(), np.append(edge[1:], len(part)).tolist()):
            out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
            sizes = np.array([len(vec_all[i]) for i in range(s, e)])
            for size in np.unique(sizes[query[s:e]]).tolist():
                mine = s + np.flatnonzero(sizes == size)
                r, w = mine[~query[mine]], mine[query[mine]]
                # repeated rows of an id are one candidate and one query
                r, w = (g[np.unique(ids_all[g], return_index=True)[1]] for g in (r, w))
                if not len(r):
                    continue
                x, q = matrix([vec_all[i] for i in r.tolist()]), matrix([vec_all[i] for i in w.tolist()])
                book = books.get(size // 8)
                codes = np.ascontiguousarray(np.frombuffer(b"".join(codes_all[i] for i in r.tolist()), np.uint8).reshape(len(r), -1).T) if book else None
                for query_id, ids, score in search_block(book, ids_all[r], x, codes, error_all[r], ids_all[w], q, k):
                    out.append((np.full(len(ids), query_id), ids, score))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], ["query_id", "vec_id", "score"])

    found = by_group(data.select(*columns).unionByName(asked.select(*columns)), ["part", "q_part"], run, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op3_score_aware(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"))
