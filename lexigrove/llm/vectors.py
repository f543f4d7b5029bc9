"""Vectors as packed bytes: which ones take part, and numpy views of them."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def packed(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(vec_id, vec, name): the vector as little-endian doubles and a 128-bit name of its values.

    ``vec`` and ``name`` are null if the id or the vector is null, the vector is
    empty or zero, or a component is null or not finite.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, column = batch.column(0), batch.column(1)
            raw: list[bytes | None] = []
            name: list[bytes | None] = []
            known = ids.is_valid().to_pylist()
            offsets, flat = column.offsets.to_numpy(), column.values
            values = flat.to_numpy(zero_copy_only=False).astype(np.float64) + 0.0
            ok = np.concatenate((np.zeros(1, np.int64), np.cumsum(np.isfinite(values) & flat.is_valid().to_numpy(zero_copy_only=False))))
            there = column.is_valid().to_pylist()
            for i, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
                v = values[a:b]
                if known[i] and there[i] and b > a and ok[b] - ok[a] == b - a and v.any():
                    x = v.astype("<f8").tobytes()
                    raw.append(x)
                    name.append(blake2b(x, digest_size=16).digest())
                else:
                    raw.append(None)
                    name.append(None)
            yield pa.RecordBatch.from_arrays([ids, pa.array(raw, pa.binary()), pa.array(name, pa.binary())], ["vec_id", "vec", "name"])

    return vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("vec")).mapInArrow(run, "vec_id long, vec binary, name binary")


def matrix(raw: list[bytes]) -> np.ndarray:
    """Vectors of one dimension as rows."""
    return np.frombuffer(b"".join(raw), "<f8").reshape(len(raw), -1)


def unit(x: np.ndarray) -> np.ndarray:
    """Rows at length 1; scaled first, so that no square overflows."""
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def by_size(raw: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, rows) for each dimension among the vectors."""
    sizes = np.array([len(x) for x in raw])
    for s in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == s)
        yield at, matrix([raw[i] for i in at.tolist()])
