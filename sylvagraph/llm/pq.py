"""Embedding near-duplicates by product quantisation over inverted lists (operator 5).

Equal vectors are one node with a count. Each node is filed in the list of its nearest centre with the codes of its residual,
one for each subspace, and asks the lists of its nearest few centres. There, distances to all filed nodes come from tables of the
asking node's products with the code words; a filed node's own quantisation error turns them into an upper bound, so the filter
loses nothing that was asked. What passes is compared by exact cosine in double precision.

Nodes so close to their centre that any two of them must be linked (twice the angle is within that of the threshold) are the
list's core. Core nodes of a list are linked without being compared, so large groups of near copies cost rows in
proportion to their size. Other nodes of a list stand in chunks of bounded size, each a task's share. Counts and a
spanning set of edges leave a comparison, never all pairs. A pair that only one side asks for counts for both.

Centres and code words come from a bounded sample (``SAMPLE`` rows); every row is indexed. Vectors that are null, empty,
zero or hold null or non-finite components have no links and are components of their own. Shorter vectors count as
padded with zeros. Rows that repeat a vector, whatever their ids, are links of each other. Rows whose id is null
take no part: no links, null component, kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sylvagraph.llm.common import cut, stored
from sylvagraph.llm.components import connected_components
from sylvagraph.llm.vectors import dimension, matrix, means, slices, unpacked, usable

SAMPLE, ROWS_A_LIST, MOST_LISTS = 8192, 96, 2048
SUBSPACES, WORDS, PROBES = 8, 64, 12
CHUNK_ROWS, ASK_ROWS = 2048, 256


class Index:
    """Centres and code words. The threshold is a cosine."""

    def __init__(self, known: np.ndarray, lists: int, threshold: float):
        unit = known / np.linalg.norm(known, axis=1, keepdims=True)
        self.d = known.shape[1]
        self.threshold = threshold
        self.angle = float(np.arccos(threshold))
        centres = means(unit, lists)
        centres = centres[np.linalg.norm(centres, axis=1) > 1e-9]
        centres /= np.linalg.norm(centres, axis=1, keepdims=True)
        # A group of near copies has one centre: of centres within the threshold's angle, the first stays.
        kept: list[int] = []
        for i, row in enumerate(centres @ centres.T):
            if not kept or row[kept].max() < threshold:
                kept.append(i)
        self.centres = centres[kept]
        home = np.argmax(unit @ self.centres.T, axis=1)
        # The centre of what its list holds close by, so that a core is as large as can be.
        for c in range(len(self.centres)):
            near = unit[(home == c) & (unit @ self.centres[c] >= threshold)]
            if len(near):
                mean = near.mean(axis=0)
                self.centres[c] = mean / np.linalg.norm(mean)
        home = np.argmax(unit @ self.centres.T, axis=1)
        rest = unit - self.centres[home]
        self.edges = np.linspace(0, self.d, min(SUBSPACES, self.d) + 1).astype(int)
        self.words = [means(rest[:, a:b], WORDS) for a, b in zip(self.edges, self.edges[1:], strict=False)]

    def spans(self) -> Iterator[tuple[int, int, np.ndarray]]:
        yield from zip(self.edges.tolist(), self.edges[1:].tolist(), self.words, strict=False)

    def filed(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Nearest centres (the first is home), whether in its core, codes and quantisation error."""
        near = x @ self.centres.T
        probes = np.argsort(-near, axis=1, kind="stable")[:, :PROBES]
        home = probes[:, 0]
        core = np.arccos(np.clip(near[np.arange(len(x)), home], -1, 1)) <= self.angle / 2 - 1e-6
        rest = x - self.centres[home]
        codes = np.empty((len(x), len(self.words)), dtype=np.uint8)
        error = np.zeros(len(x))
        for m, (a, b, words) in enumerate(self.spans()):
            part = rest[:, a:b]
            far = (part**2).sum(axis=1)[:, None] + (words**2).sum(axis=1) - 2 * part @ words.T
            codes[:, m] = np.argmin(far, axis=1)
            error += np.maximum(far[np.arange(len(x)), codes[:, m]], 0)
        return probes, core, codes, np.sqrt(error) + 1e-9

    def reachable(self, q: np.ndarray, home: int, codes: np.ndarray, error: np.ndarray) -> np.ndarray:
        """Which filed nodes of a list may reach the threshold with which queries, by table look-ups."""
        bound = (q @ self.centres[home])[:, None] + error[None, :]
        for m, (a, b, words) in enumerate(self.spans()):
            bound += (q[:, a:b] @ words.T)[:, codes[:, m]]
        return bound >= self.threshold - 1e-9


def _packed(batches: Iterator[pa.RecordBatch], d: int) -> Iterator[pa.RecordBatch]:
    """id, v -> the vector's doubles, null if it is zero."""
    for batch in batches:
        for part in slices(batch, 8192):
            x = matrix(part.column("v"), d) + 0.0  # no negative zeros
            rows = [row.tobytes() if row.any() else None for row in x]
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(rows, pa.binary())], names=["id", "packed"])


def _unit(rows: list[bytes], d: int) -> np.ndarray:
    x = unpacked(b"".join(rows), d)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


FILED = "list int, core boolean, asked boolean, id bigint, n bigint, packed binary, codes binary, error double, probes array<int>"


def _filed(batches: Iterator[pa.RecordBatch], index: Index) -> Iterator[pa.RecordBatch]:
    """Nodes -> one filed row each (asked) and one row for each list that they ask."""
    for batch in batches:
        for part in slices(batch, 2048):
            x = _unit(part.column("packed").to_pylist(), index.d)
            probes, core, codes, error = index.filed(x)
            rows = [r.tobytes() for r in x]
            lists = pa.array(list(probes.astype(np.int32)), pa.list_(pa.int32()))
            names = ["list", "core", "asked", "id", "n", "packed", "codes", "error", "probes"]
            yield pa.RecordBatch.from_arrays(
                [pa.array(probes[:, 0].astype(np.int32)), pa.array(core), pa.array(np.ones(len(x), bool)), part.column("id"), part.column("n"), pa.array(rows, pa.binary()), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(error), lists],
                names=names,
            )
            none = pa.array([None] * len(x), pa.binary())
            for k in range(probes.shape[1]):
                # Only the home list knows a node as one of its core.
                mine = core if k == 0 else np.zeros(len(x), bool)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(probes[:, k].astype(np.int32)), pa.array(mine), pa.array(np.zeros(len(x), bool)), part.column("id"), part.column("n"), pa.array(rows, pa.binary()), none, pa.array(np.zeros(len(x))), pa.array(probes[:, :1].astype(np.int32).tolist(), pa.list_(pa.int32()))],
                    names=names,
                )


BLOCK = "list int, core boolean, chunk int, ids array<bigint>, ns array<bigint>, rows binary, codes binary, errors array<double>, probes array<int>"


def _blocks(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.RecordBatch]:
    """Rows in the order of list, core and chunk -> blocks of at most ``limit`` rows of one such key. Probes: of all rows, one after another."""
    held: list[tuple] = []
    now: tuple = ()

    def block() -> pa.RecordBatch:
        ids, ns, rows, codes, errors, probes = zip(*held, strict=True)
        return pa.RecordBatch.from_arrays(
            [
                pa.array([now[0]], pa.int32()), pa.array([now[1]], pa.bool_()), pa.array([now[2]], pa.int32()),
                pa.array([list(ids)], pa.list_(pa.int64())), pa.array([list(ns)], pa.list_(pa.int64())), pa.array([b"".join(rows)], pa.binary()),
                pa.array([b"".join(c or b"" for c in codes)], pa.binary()), pa.array([list(errors)], pa.list_(pa.float64())), pa.array([[p for x in probes for p in x]], pa.list_(pa.int32())),
            ],
            names=["list", "core", "chunk", "ids", "ns", "rows", "codes", "errors", "probes"],
        )

    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("list", "core", "chunk", "id", "n", "packed", "codes", "error", "probes")]
        for row in zip(*columns, strict=True):
            if held and (row[:3] != now or len(held) >= limit):
                yield block()
                held = []
            now = row[:3]
            held.append(row[3:])
    if held:
        yield block()


FOUND = "id bigint, links bigint, other bigint"


def _compared(batches: Iterator[pa.RecordBatch], index: Index) -> Iterator[pa.RecordBatch]:
    """A block that asks and a filed chunk a row -> links counted for ids (links) and spanning edges (other)."""
    for batch in batches:
        for at in range(batch.num_rows):
            row = {c: batch.column(c)[at].as_py() for c in batch.schema.names}
            q, x = unpacked(row["ask_rows"], index.d), unpacked(row["rows"], index.d)
            q_ids, x_ids = np.array(row["ask_ids"]), np.array(row["ids"])
            q_n, x_n = np.array(row["ask_ns"]), np.array(row["ns"])
            homes, probes = np.array(row["ask_homes"]), np.array(row["probes"]).reshape(len(x_ids), -1)
            codes = np.frombuffer(row["codes"], dtype=np.uint8).reshape(len(x_ids), -1)
            may = index.reachable(q, row["list"], codes, np.array(row["errors"])) & (q_ids[:, None] != x_ids[None, :])
            qi, xi = np.nonzero(may)
            if not len(qi):
                continue
            near = np.concatenate([np.einsum("ij,ij->i", q[qi[a : a + 65536]], x[xi[a : a + 65536]]) for a in range(0, len(qi), 65536)]) >= index.threshold
            qi, xi = qi[near], xi[near]
            if not len(qi):
                continue
            ids, counts = [q_ids], [np.bincount(qi, weights=x_n[xi], minlength=len(q_ids)).astype(np.int64)]
            # Where the filed node doesn't ask the other's list, nobody else counts this pair for it.
            blind = ~(probes[xi] == homes[qi][:, None]).any(axis=1)
            ids.append(x_ids)
            counts.append(np.bincount(xi[blind], weights=q_n[qi[blind]], minlength=len(x_ids)).astype(np.int64))
            ids, counts = np.concatenate(ids), np.concatenate(counts)
            some = counts > 0
            yield pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.array(counts[some]), pa.array([None] * int(some.sum()), pa.int64())], names=["id", "links", "other"])
            src, dst = _spanning(q_ids[qi], x_ids[xi])
            yield pa.RecordBatch.from_arrays([pa.array(src), pa.array([None] * len(src), pa.int64()), pa.array(dst)], names=["id", "links", "other"])


def _spanning(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges from each id to the smallest that is linked with it, directly or not, within these pairs."""
    names, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(names))
    while True:
        least = label.copy()
        np.minimum.at(least, x, label[y])
        np.minimum.at(least, y, label[x])
        least = least[least]
        if (least == label).all():
            break
        label = least
    some = label != np.arange(len(names))
    return names[some], names[label[some]]


def near_duplicates(df: DataFrame, threshold: float = 0.9, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``id_col``, n_links, component_id and kept for every row."""
    rows = df.select(F.col(id_col).cast("bigint").alias("id"), F.when(usable(vector_col) & F.col(id_col).isNotNull(), F.col(vector_col)).alias("v"))
    valid = rows.filter("v is not null")
    d = dimension(valid, "v")
    packed = stored(valid.mapInArrow(partial(_packed, d=d), "id bigint, packed binary"))
    nodes = stored(packed.filter("packed is not null").groupBy("packed").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n")))
    total = nodes.count()
    if not total:
        return rows.select(F.col("id").alias(id_col), F.lit(0).cast("bigint").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    known = _known(nodes, d)
    index = df.sparkSession.sparkContext.broadcast(Index(known, max(1, min(MOST_LISTS, total // ROWS_A_LIST)), threshold))

    filed = stored(nodes.mapInArrow(partial(_with, fn=_filed, index=index), FILED))
    base, asks = filed.filter("asked"), filed.filter("not asked")
    sizes = base.groupBy("list", "core").agg(F.ceil(F.count(F.lit(1)) / CHUNK_ROWS).cast("int").alias("chunks"), F.sum("n").alias("of_core"), F.min("id").alias("first"))
    sizes = cut(sizes)  # at most two rows a list
    keyed = base.join(sizes.select("list", "core", "chunks"), ["list", "core"]).withColumn("chunk", F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int"))
    chunks = keyed.repartition("list", "core", "chunk").sortWithinPartitions("list", "core", "chunk").mapInArrow(partial(_blocks, limit=2 * CHUNK_ROWS), BLOCK)
    # Asking rows of a hot list are dealt over several tasks.
    dealt = asks.withColumn("chunk", F.pmod(F.xxhash64("id"), F.lit(1 << 20)).cast("int"))
    dealt = dealt.repartition(F.col("list"), F.col("core"), F.expr("chunk div 65536")).sortWithinPartitions("list", "core").withColumn("chunk", F.lit(0))
    asking = dealt.mapInArrow(partial(_blocks, limit=ASK_ROWS), BLOCK).select(
        "list", F.col("core").alias("ask_core"), F.col("ids").alias("ask_ids"), F.col("ns").alias("ask_ns"), F.col("rows").alias("ask_rows"), F.col("probes").alias("ask_homes")
    )
    # A list's core asks the rest of its list only; all others ask both.
    places = sizes.select("list", "core", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"))
    placed = asking.join(places, "list").filter(~(F.col("ask_core") & F.col("core")))
    found = stored(placed.join(chunks, ["list", "core", "chunk"]).mapInArrow(partial(_with, fn=_compared, index=index), FOUND))

    core = base.filter("core").join(sizes.filter("core").select("list", "of_core", "first"), "list")
    links = found.filter("links is not null").select("id", "links").unionByName(core.select("id", (F.col("of_core") - F.col("n")).alias("links")))
    counted = links.groupBy("id").agg(F.sum("links").alias("links"))
    edges = found.filter("other is not null").select(F.col("id").alias("src"), F.col("other").alias("dst")).unionByName(core.filter("id != first").select(F.col("first").alias("src"), F.col("id").alias("dst")))
    roots = connected_components(stored(edges.distinct()))
    judged = nodes.join(counted, "id", "left").join(roots.select(F.col("node").alias("id"), "root"), "id", "left").select("packed", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("root", "id").alias("component_id"))
    some = packed.filter("packed is not null").join(judged, "packed").select("id", "n_links", "component_id")
    none = packed.filter("packed is null").select("id").unionByName(rows.filter("v is null").select("id")).select("id", F.lit(0).cast("bigint").alias("n_links"), F.col("id").alias("component_id"))
    return some.unionByName(none).select(F.col("id").alias(id_col), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def _known(nodes: DataFrame, d: int) -> np.ndarray:
    """The vectors of the smallest id hashes, at most SAMPLE."""
    found = nodes.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("packed").collect()
    return _unit([bytes(r.packed) for r in found], d)


def _with(batches: Iterator[pa.RecordBatch], fn, index) -> Iterator[pa.RecordBatch]:
    yield from fn(batches, index.value)
