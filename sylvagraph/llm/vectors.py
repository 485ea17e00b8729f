"""Blocks of vectors, shared by the vector operators.

A block is one row: ids, and the vectors as packed doubles. Blocks have bounded size, so tasks work on matrices while
joins and shuffles still deal in rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(vector: str) -> Column:
    """Neither null nor holding null or non-finite components."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    return F.col(vector).isNotNull() & (F.size(vector) > 0) & ~F.coalesce(bad, F.lit(False))


def dimension(df: DataFrame, vector: str) -> int:
    return df.agg(F.max(F.size(vector)).alias("d")).first().d or 1


def matrix(column: pa.Array, d: int) -> np.ndarray:
    """Rows of doubles; shorter vectors count as padded with zeros."""
    values, sizes = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64), np.diff(column.offsets.to_numpy())
    if (sizes == d).all():
        return values.reshape(-1, d)
    out = np.zeros((len(sizes), d))
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = values
    return out


def unpacked(x: bytes, d: int, kind: str = "<f8") -> np.ndarray:
    return np.frombuffer(x, dtype=kind).reshape(-1, d)


def sample(df: DataFrame, id_col: str, vector: str, rows: int, d: int) -> np.ndarray:
    """The vectors of the ``rows`` smallest id hashes: a bounded sample that depends on ids alone."""
    found = df.orderBy(F.xxhash64(id_col), id_col).limit(rows).select(vector).collect()
    out = np.zeros((len(found), d))
    for i, row in enumerate(found):
        out[i, : len(row[0])] = row[0]
    return out


def means(x: np.ndarray, k: int, rounds: int = 8, seed: int = 7) -> np.ndarray:
    """k-means; at most k centres, none without a point."""
    rng = np.random.default_rng(seed)
    distinct = np.unique(x, axis=0)
    centres = distinct[rng.permutation(len(distinct))[:k]].copy()
    for _ in range(rounds):
        near = np.argmin((centres**2).sum(axis=1) - 2 * x @ centres.T, axis=1)
        count = np.bincount(near, minlength=len(centres))
        total = np.zeros_like(centres)
        np.add.at(total, near, x)
        centres = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], centres)
    return centres


def slices(batch: pa.RecordBatch, rows: int) -> Iterator[pa.RecordBatch]:
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)
