"""Connected components of an edge table, in Spark throughout, by small and large stars.

Edges point from a node to a smaller one. Small star: of a node's smaller neighbours all, and the node, move to the smallest. Large star: an
edge to a node that itself points lower goes there instead. When neither changes anything, each node that isn't the smallest
of its component has one edge, to the smallest. Each half of a round is a written table; those of the round before are deleted.
A node that many point to is the key of rows of two longs, never a list; its rows meet its one row in a merge join of two plain tables, which
adaptive execution splits and which needs no memory of the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F

from sylvagraph.llm.common import discarded, stored

#: Small tables are written as few files, so that later rounds have few tasks.
ROWS_A_FILE = 500_000


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """``node`` and ``root``, the smallest node of its component, for each node of an edge but the roots themselves. Nulls touch nothing."""
    a, b = F.col(src), F.col(dst)
    now = stored(edges.filter(a != b).select(F.greatest(a, b).alias("node"), F.least(a, b).alias("root")))
    state = _state(now)
    while state.n:
        files = 1 + state.n // ROWS_A_FILE
        small = stored(_small_star(now).coalesce(files))
        lower = stored(small.groupBy(F.col("node").alias("root")).agg(F.min("root").alias("lower")).coalesce(files))
        large = small.join(lower.hint("merge"), "root", "left").select("node", F.coalesce("lower", "root").alias("root"))
        after = stored(large.distinct().coalesce(files))
        for table in (now, small, lower):
            discarded(table)
        now, before, state = after, state, _state(after)
        if state == before:
            break
    return now


def _small_star(edges: DataFrame) -> DataFrame:
    least = F.min("root").over(Window.partitionBy("node"))
    moved = F.when(F.col("root") == F.col("least"), F.col("node")).otherwise(F.col("root"))
    return edges.withColumn("least", least).select(moved.alias("node"), F.col("least").alias("root"))


def _state(edges: DataFrame) -> Row:
    """The number of edges and a checksum."""
    return edges.agg(F.count(F.lit(1)).alias("n"), F.expr("bit_xor(xxhash64(node, root))").alias("sum")).first()
