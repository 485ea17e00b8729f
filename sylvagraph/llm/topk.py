"""Exact top-k by inner product: a Voronoi join of queries and data (operator 7).

Components x become floor(256 * x). Some data vectors are pivots; each data row belongs to the cell of its nearest pivot p.
With r = |x - p|, Cauchy-Schwarz gives q.p - |q| r <= q.x <= q.p + |q| r. A cell's summary is a histogram of
r, with bins between quantiles of the sample's radii, and each bin's number of rows and largest r. For a query, the summaries and a sample of real rows bound its k-th best score from below; it is needed only in cells
whose largest r may still reach this bound. Queries, the smaller side, are what is replicated: those of neighbouring cells
make a block, which goes to the cells that any of its members needs. Cells are held in chunks of bounded size, so a cell that has
most rows is many tasks. Each meeting of a block and a chunk is solved by itself and keeps what reaches the query's bound; ranks follow from
these rows.

Pivots and sample come from a bounded number of rows (``SAMPLE``); they only steer the work, results are exact. Vectors that are null,
empty or hold null or non-finite components, and rows whose id is null, take no part. Shorter vectors count as padded
with zeros. A query's own row is every row of its id; rows that repeat an id are candidates like others, and the query of a
repeated id is its first row by vector. Ties go to the smaller id. Scores are exact while they stay below 2**53; beyond they are those of
doubles, and those outside of a long become its least or largest value.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sylvagraph.llm.common import stored
from sylvagraph.llm.vectors import matrix, sample, slices, unpacked, usable

SAMPLE, PIVOTS, BINS = 2048, 48, 32
CHUNK_ROWS, BLOCK_ROWS = 2048, 256

CELLED = "id bigint, cell int, bin int, ball double, packed binary, is_query boolean"


class Plan:
    """What every task knows: pivots, the edges of bins, sample rows and, once counted, the summaries (cell, bin, rows, largest distance)."""

    def __init__(self, known: np.ndarray, pivots: int, d: int):
        distinct = np.unique(known, axis=0) if len(known) else np.zeros((1, d))
        self.known = known
        self.pivots = distinct[np.random.default_rng(7).permutation(len(distinct))[:pivots]]
        self.edges = np.unique(np.quantile(self.cells(known)[1], np.linspace(0, 1, BINS + 1)[1:-1])) if len(known) else np.zeros(0)
        self.summary: list[tuple[int, int, int, float]] = []

    def cells(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        far = (x**2).sum(axis=1)[:, None] + (self.pivots**2).sum(axis=1) - 2 * x @ self.pivots.T
        cell = np.argmin(far, axis=1)
        # Distances anew: the difference of large squares loses digits, and bounds need them.
        return cell, np.sqrt(((x - self.pivots[cell]) ** 2).sum(axis=1))


def _celled(batches: Iterator[pa.RecordBatch], plan: Broadcast) -> Iterator[pa.RecordBatch]:
    """id, v, is_query -> the nearest pivot, the distance to it, its bin and the whole-number components as packed doubles."""
    d = plan.value.pivots.shape[1]
    for batch in batches:
        for part in slices(batch, 4096):
            x = matrix(part.column("v"), d) + 0.0  # no negative zeros
            cell, ball = plan.value.cells(x)
            bins = np.searchsorted(plan.value.edges, ball)
            packed = [row.tobytes() for row in x]
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(cell.astype(np.int32)), pa.array(bins.astype(np.int32)), pa.array(ball), pa.array(packed, pa.binary()), part.column("is_query")], names=["id", "cell", "bin", "ball", "packed", "is_query"])


def _packed_rows(batches: Iterator[pa.RecordBatch], limit: int, keys: list[str]) -> Iterator[pa.RecordBatch]:
    """Rows in the order of ``keys`` -> blocks of at most ``limit`` rows, each of one key."""
    ids: list[int] = []
    rows: list[bytes] = []
    now: tuple = ()

    def block() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*(pa.array([k], pa.int32()) for k in now), pa.array([ids], pa.list_(pa.int64())), pa.array([b"".join(rows)], pa.binary())], names=[*keys, "ids", "rows"])

    for batch in batches:
        for *key, i, row in zip(*(batch.column(k).to_pylist() for k in keys), batch.column("id").to_pylist(), batch.column("packed").to_pylist(), strict=True):
            if rows and (tuple(key) != now or len(rows) >= limit):
                yield block()
                ids, rows = [], []
            now = tuple(key)
            ids.append(i)
            rows.append(row)
    if rows:
        yield block()


def _bounds(q: np.ndarray, k: int, plan: Plan) -> tuple[np.ndarray, np.ndarray]:
    """For each query the score its k-th best can't be below, and whether each cell may hold a row that reaches it."""
    at_pivots, norm = q @ plan.pivots.T, np.sqrt((q**2).sum(axis=1))[:, None]
    cells, _, counts, radii = (np.array(x) for x in zip(*plan.summary, strict=True))
    radii = radii * (1 + 1e-9)
    # At least so many rows of a bin score this much; k others and perhaps the query's own row.
    least = at_pivots[:, cells] - norm * radii
    order = np.argsort(-least, axis=1)
    reach = np.cumsum(counts[order], axis=1) >= k + 1
    place = np.argmax(reach, axis=1)
    bound = np.where(reach.any(axis=1), np.take_along_axis(least, np.take_along_axis(order, place[:, None], 1), 1)[:, 0], -np.inf)
    if len(plan.known) > k:
        bound = np.maximum(bound, np.partition(q @ plan.known.T, len(plan.known) - k - 1, axis=1)[:, len(plan.known) - k - 1])
    bound = bound - 1e-9 * np.abs(np.where(np.isfinite(bound), bound, 0))
    widest = np.full(len(plan.pivots), -np.inf)
    np.maximum.at(widest, cells, radii)
    needed = at_pivots + norm * np.where(np.isfinite(widest), widest, 0) >= bound[:, None] - 1e-6 * (1 + np.abs(bound[:, None]))
    return bound, needed & np.isfinite(widest)


def _query_blocks(batches: Iterator[pa.RecordBatch], k: int, plan: Broadcast) -> Iterator[pa.RecordBatch]:
    """Blocks of queries with their bounds, once for each cell that they need."""
    for batch in batches:
        for ids, rows in zip(batch.column("ids").to_pylist(), batch.column("rows").to_pylist(), strict=True):
            q = unpacked(rows, plan.value.pivots.shape[1])
            bound, needed = _bounds(q, k, plan.value)
            for cell in np.flatnonzero(needed.any(axis=0)).tolist():
                mine = np.flatnonzero(needed[:, cell])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([cell], pa.int32()), pa.array([np.array(ids)[mine]], pa.list_(pa.int64())), pa.array([q[mine].tobytes()], pa.binary()), pa.array([bound[mine]], pa.list_(pa.float64()))],
                    names=["cell", "query_ids", "query_rows", "bounds"],
                )


def _solved(batches: Iterator[pa.RecordBatch], k: int, d: int) -> Iterator[pa.RecordBatch]:
    """A query block and a data chunk a row -> each query's k best of the chunk that reach its bound."""
    for batch in batches:
        for at in range(batch.num_rows):
            row = {c: batch.column(c)[at].as_py() for c in batch.schema.names}
            q, x = unpacked(row["query_rows"], d), unpacked(row["rows"], d)
            own, ids, bound = np.array(row["query_ids"]), np.array(row["ids"]), np.array(row["bounds"])
            scores = q @ x.T
            scores[own[:, None] == ids[None, :]] = -np.inf
            keep = min(k, len(ids))
            cut = np.partition(scores, len(ids) - keep, axis=1)[:, len(ids) - keep]
            qi, xi = np.nonzero((scores >= np.maximum(cut, bound)[:, None]) & np.isfinite(scores))
            found = scores[qi, xi]
            order = np.lexsort((ids[xi], -found, qi))
            qi, xi, found = qi[order], xi[order], found[order]
            place = np.arange(len(qi)) - np.searchsorted(qi, qi)
            best = place < k
            yield pa.RecordBatch.from_arrays([pa.array(own[qi[best]]), pa.array(ids[xi[best]]), pa.array(found[best])], names=["query_id", "vec_id", "score"])


def _floor(x: Column) -> Column:
    """Spark's floor of a double is a long; doubles that large are whole anyway."""
    return F.when(F.abs(x) < 2.0**53, F.floor(x).cast("double")).otherwise(x)


def top_k(df: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", pivots: int | None = None) -> DataFrame:
    """query_id, rank (from 1), vec_id and score of the k best rows for each row where ``is_query`` holds. Pivots by default grow with the root of the table."""
    rows = df.filter(F.col(id_col).isNotNull() & usable(vector_col)).select(
        F.col(id_col).cast("bigint").alias("id"),
        F.transform(vector_col, lambda x: _floor(F.lit(256) * x.cast("double"))).alias("v"),
        F.coalesce(is_query, F.lit(False)).alias("is_query"),
    )
    found = rows.agg(F.max(F.size("v")).alias("d"), F.count(F.lit(1)).alias("n")).first()
    d = found.d or 1
    context = df.sparkSession.sparkContext
    plan = Plan(sample(rows, "id", "v", SAMPLE, d), pivots or min(SAMPLE, max(PIVOTS, isqrt(found.n) // 16)), d)
    celled = stored(rows.mapInArrow(partial(_celled, plan=context.broadcast(plan)), CELLED))
    # Cells times bins, whatever the number of rows.
    plan.summary = [tuple(r) for r in celled.groupBy("cell", "bin").agg(F.count(F.lit(1)).alias("n"), F.max("ball").alias("ball")).collect()]

    of_cell = celled.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / CHUNK_ROWS).cast("int").alias("chunks"))
    dealt = celled.join(of_cell, "cell").withColumn("chunk", F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int"))
    chunks = (
        dealt.select("cell", "chunk", "id", "packed")
        .repartition(F.col("cell"), F.col("chunk"))
        .sortWithinPartitions("cell", "chunk")
        .mapInArrow(partial(_packed_rows, limit=2 * CHUNK_ROWS, keys=["cell", "chunk"]), "cell int, chunk int, ids array<bigint>, rows binary")
    )
    first = Window.partitionBy("id").orderBy("packed")
    queries = celled.filter("is_query").withColumn("n", F.row_number().over(first)).filter("n = 1")
    parts = max(1, queries.count() // BLOCK_ROWS)
    blocks = (
        queries.withColumn("part", F.lit(0))
        .repartitionByRange(parts, "cell", "id")
        .sortWithinPartitions("cell", "id")
        .mapInArrow(partial(_packed_rows, limit=BLOCK_ROWS, keys=["part"]), "part int, ids array<bigint>, rows binary")
        .mapInArrow(partial(_query_blocks, k=k, plan=context.broadcast(plan)), "cell int, query_ids array<bigint>, query_rows binary, bounds array<double>")
    )
    placed = blocks.join(of_cell, "cell").withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).drop("chunks")
    solved = placed.join(chunks, ["cell", "chunk"]).mapInArrow(partial(_solved, k=k, d=d), "query_id bigint, vec_id bigint, score double")
    ranks = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    whole = F.when(F.col("score") >= 2.0**63, F.lit(2**63 - 1)).when(F.col("score") <= -(2.0**63), F.lit(-(2**63))).otherwise(F.col("score").cast("bigint"))
    return solved.withColumn("rank", F.row_number().over(ranks)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", whole.alias("score"))
