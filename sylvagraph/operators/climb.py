"""Climbing parents by pointer doubling: after k joins every pointer is 2^k parents further up, so a chain of depth d takes about log2(d) of them.

Only pointers that haven't arrived take part in a round. What hasn't arrived when pointers have gone further than there are nodes leads into a circle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sylvagraph.lineage import cut


def arrivals(steps: DataFrame) -> tuple[DataFrame, int]:
    """Where each id (id, next; a null next is an end) arrives: id, top, steps and ended (false: it goes round in a circle, ``top`` is on it), and the rounds that took.

    Each ``next`` must be an id itself.
    """
    state = cut(steps.select("id", F.coalesce("next", "id").alias("top"), F.when(F.col("next").isNull(), 0).otherwise(1).cast("bigint").alias("steps"), F.col("next").isNull().alias("ended")))
    most, reach, rounds = state.count(), 1, 0
    while reach <= most and not state.filter("not ended").isEmpty():
        further = state.select(F.col("id").alias("top"), F.col("top").alias("further"), F.col("steps").alias("more"), F.col("ended").alias("there"))
        moved = state.filter("not ended").join(further, "top").select("id", F.col("further").alias("top"), (F.col("steps") + F.col("more")).alias("steps"), F.col("there").alias("ended"))
        state, reach, rounds = cut(state.filter("ended").unionByName(moved)), 2 * reach, rounds + 1
    return state, rounds


def known_parents(nodes: DataFrame) -> DataFrame:
    """id and next: the parent if it is a node itself, else null."""
    own = nodes.select("id", F.col("parent_id").alias("next"))
    return own.join(nodes.select(F.col("id").alias("next"), F.lit(True).alias("known")), "next", "left").select("id", F.when(F.col("known"), F.col("next")).alias("next"))


def circles(steps: DataFrame, found: DataFrame) -> DataFrame:
    """id, circle (its least id) and size of the ids on circles. ``found``: what ``arrivals`` says of ``steps``."""
    # A whole turn brings each of them back, so all of them are where something ends up.
    on = found.filter("not ended").select(F.col("top").alias("id")).distinct()
    state = cut(steps.join(on, "id", "left_semi").select("id", "next", F.least("id", "next").alias("circle")))
    most, reach = state.count(), 1
    while reach < most:
        further = state.select(F.col("id").alias("next"), F.col("next").alias("further"), F.col("circle").alias("other"))
        state, reach = cut(state.join(further, "next").select("id", F.col("further").alias("next"), F.least("circle", "other").alias("circle"))), 2 * reach
    return state.join(state.groupBy("circle").agg(F.count(F.lit(1)).alias("size")), "circle").select("id", "circle", "size")


def depths(nodes: DataFrame) -> DataFrame:
    """id and depth: how many different ancestors that exist are met on the way up. On a circle of n that is n, since the way comes back to the node."""
    steps = cut(known_parents(nodes))
    found, _ = arrivals(steps)
    straight = found.filter("ended").select("id", F.col("steps").alias("depth"))
    if found.filter("not ended").isEmpty():
        return straight
    round_ = cut(circles(steps, found))
    # What hangs on a circle climbs to its first node there, then goes round.
    cut_open = steps.join(found.filter("not ended").select("id"), "id", "left_semi").join(round_.select("id", "size"), "id", "left").select("id", F.when(F.col("size").isNull(), F.col("next")).alias("next"))
    tails, _ = arrivals(cut_open)
    into = tails.join(round_.select(F.col("id").alias("top"), "size"), "top").select("id", F.when(F.col("steps") == 0, F.col("size")).otherwise(F.col("steps") + F.col("size") - 1).alias("depth"))
    return straight.unionByName(into)


def nearest(nodes: DataFrame, wanted: Column) -> DataFrame:
    """id and ancestor: the node itself if ``wanted`` holds for it, else the nearest ancestor for which it does; null if there is none."""
    marked = nodes.select("id", F.coalesce(wanted, F.lit(False)).alias("wanted"))
    steps = known_parents(nodes).join(marked, "id").select("id", F.when(~F.col("wanted"), F.col("next")).alias("next"))
    found, _ = arrivals(steps)
    there = found.filter("ended").join(marked.filter("wanted").select(F.col("id").alias("top")), "top", "left_semi").select("id", F.col("top").alias("ancestor"))
    return nodes.select("id").join(there, "id", "left")


def owners(ids: DataFrame, nodes: DataFrame) -> DataFrame:
    """id and owner of each of ``ids`` (id): the nearest file or decision record from the node up, else the first id on the way that is no node, itself included.

    Null where the way ends at a node without a parent or goes round in a circle.
    """
    known = nodes.select("id", F.col("parent_id").alias("next"), F.col("type").isin("file", "adr").alias("wanted"))
    others = ids.select("id").unionByName(nodes.filter("parent_id is not null").select(F.col("parent_id").alias("id"))).distinct().join(known.select("id"), "id", "left_anti")
    ways = cut(known.unionByName(others.select("id", F.lit(None).cast("string").alias("next"), F.lit(True).alias("wanted"))))
    found, _ = arrivals(ways.select("id", F.when(~F.col("wanted"), F.col("next")).alias("next")))
    there = found.filter("ended").join(ways.filter("wanted").select(F.col("id").alias("top")), "top", "left_semi").select("id", F.col("top").alias("owner"))
    return ids.select("id").join(there, "id", "left")
