"""SimHash near-duplicates by multi-index hashing (operator 6).

Fingerprints: A-Z lower-cased, words ``[^\\x20\\x09-\\x0D]+``, word shingles with repeats, XXH64 of each; a bit is
set if over half of the hashes have it. A text with fewer words than a shingle has one shingle, its whole word
sequence; a text without words (null, empty, white space) has fingerprint zero and is linked like any other.

Links: equal fingerprints are one node. The 64 bits are cut into segments; of two fingerprints within
the radius, one segment differs in few bits (generalised pigeonhole: with radius r and m segments, r = m*a + b,
either one of the first b+1 segments differs in at most a bits or one of the others in at most a-1). Every
fingerprint is filed in m tables by its segments; the balls around its segments are enumerated and
fetched, and each candidate's complete distance is verified.

Segments follow the number of distinct fingerprints, so buckets of more than ``pair_limit`` are groups of near copies. Their members aren't paired:
each is listed under all values within half the radius of it; those that share a value are within the
radius of each other, and any two within the radius share one. So the edges to the smallest of each value's list, verified like all others, connect
what pairs would connect, with rows in proportion to the bucket and none for its square.

All ids stay in Spark; repeated and tied rows are nodes like any other. Rows whose id is null get a
fingerprint but no component (null).
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sylvagraph.llm import jaccard
from sylvagraph.llm.common import arrow_map, free_name, majority_bits, quoted, shingle_hashes, stored, text_bytes
from sylvagraph.llm.components import connected_components

BITS = 64


def fingerprint_of(text: bytes, shingle_words: int = 4, seed: int = 42) -> int:
    """The 64-bit fingerprint of UTF-8 text."""
    words = text.lower().split()
    return majority_bits(shingle_hashes(words, shingle_words, seed)) if words else 0


def fingerprints(df: DataFrame, keep: list[str], text_col: str = "text", shingle_words: int = 4, seed: int = 42, name: str = "bits") -> DataFrame:
    """``keep`` and the fingerprint of each whole text as a signed BIGINT."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        bits = np.array([fingerprint_of(x, shingle_words, seed) for x in text_bytes(batch.column(text_col))], dtype=np.uint64)
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(bits.view(np.int64))], names=[*keep, name])

    schema = T.StructType([*(df.schema[c] for c in keep), T.StructField(name, T.LongType())])
    return arrow_map(df.select(*quoted([*keep, text_col])), run, schema)


def segments_of(radius: int, count: int) -> list[tuple[int, int, int]]:
    """(shift, width, ball radius) of each segment; a ball radius of -1 needs no probe."""
    a, b = divmod(radius, count)
    widths = [BITS // count + (i < BITS % count) for i in range(count)]
    widths.reverse()  # the narrow segments first: theirs are the larger balls
    shifts = [sum(widths[:i]) for i in range(count)]
    return [(shifts[i], widths[i], a if i <= b else a - 1) for i in range(count)]


def ball(width: int, radius: int) -> list[int]:
    """All values of ``width`` bits with at most ``radius`` ones."""
    return [sum(1 << i for i in at) for k in range(radius + 1) for at in combinations(range(width), k)] if radius >= 0 else []


def signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def xored(value: Column, masks: list[int]) -> Column:
    """The array of ``value`` under each mask; the optimizer folds the literal of masks."""
    return F.transform(F.split(F.lit(",".join(map(str, masks))), ",").cast("array<bigint>"), lambda mask: value.bitwiseXOR(mask))


def segments_for(nodes: int) -> int:
    """Segments, so that buckets of unrelated fingerprints stay small: three of 21 bits, two of 32 for more than 2**26 fingerprints."""
    return 3 if nodes <= 1 << 26 else 2


def links(nodes: DataFrame, radius: int = 4, segments: int | None = None, pair_limit: int = 256) -> DataFrame:
    """Edges (src, dst) of at most ``radius`` bits between the distinct values of stored ``bits``; they connect all that such edges connect."""
    if radius % 2:
        raise ValueError("an even radius is needed")
    parts = segments_of(radius, segments or segments_for(nodes.count()))
    # A slot is a table's number and a segment's value.
    slots = [F.shiftrightunsigned("bits", s).bitwiseAND((1 << w) - 1).bitwiseOR(F.lit(i << 56)) for i, (s, w, _) in enumerate(parts)]
    near = F.bit_count(F.col("src").bitwiseXOR(F.col("dst"))) <= radius
    filed = nodes.select("bits", F.explode(F.array(*slots)).alias("slot"))
    hot = stored(filed.groupBy("slot").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > pair_limit).select("slot"))
    probes = reduce(
        DataFrame.unionByName,
        (nodes.select(F.col("bits").alias("asks"), F.explode(xored(slot, ball(w, r))).alias("slot")) for slot, (_, w, r) in zip(slots, parts, strict=True) if r >= 0),
    )
    pairs = (
        probes.join(filed.join(hot, "slot", "left_anti").hint("merge"), "slot")
        .filter("asks != bits")
        .select(F.least("asks", "bits").alias("src"), F.greatest("asks", "bits").alias("dst"))
        .filter(near)
    )
    # In a dense bucket stand those filed in it and those that probe it: any link found there is between one of each.
    crowd = probes.join(hot, "slot", "left_semi").select(F.col("asks").alias("bits")).distinct()
    listed = crowd.select("bits", F.explode(xored(F.col("bits"), [signed(x) for x in ball(BITS, radius // 2)])).alias("value"))
    least = listed.groupBy("value").agg(F.min("bits").alias("src"), F.max("bits").alias("top")).filter("src != top")
    stars = listed.join(least.select("value", "src").hint("merge"), "value").filter("src != bits").select("src", F.col("bits").alias("dst")).filter(near)
    return pairs.unionByName(stars).distinct()


def grouped(prints: DataFrame, id_col: str, radius: int = 4, segments: int | None = None, pair_limit: int = 256) -> DataFrame:
    """For each distinct ``bits`` of stored ``prints``: its group's ``root`` and ``component_id``, the smallest id in the group."""
    nodes = stored(prints.groupBy("bits").agg(F.min(id_col).alias("first_id")))
    found = connected_components(links(nodes.select("bits"), radius, segments, pair_limit))
    # Nodes that are the smallest of their group, or alone, are their own roots.
    roots = nodes.join(found.withColumnRenamed("node", "bits").hint("merge"), "bits", "left").withColumn("root", F.coalesce("root", "bits"))
    least = roots.groupBy("root").agg(F.min("first_id").alias("component_id"))
    return roots.join(least.hint("merge"), "root").select("bits", "root", "component_id")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 4, seed: int = 42, radius: int = 4, segments: int | None = None, pair_limit: int = 256) -> DataFrame:
    """``id_col``, ``bits`` and ``component_id``: the smallest id reachable by links, the row's own included.

    The last join meets all copies of a text under one key. Both its sides are plain tables, so adaptive execution splits them.
    """
    prints = stored(fingerprints(df, [id_col], text_col, shingle_words, seed))
    found = prints.join(stored(grouped(prints, id_col, radius, segments, pair_limit)).hint("merge"), "bits")
    return found.select(id_col, "bits", F.when(F.col(id_col).isNotNull(), F.col("component_id")).alias("component_id"))


def deduplicated(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: Fraction = Fraction(4, 5), shingle_words: int = 5, seed: int = 42, radius: int = 4) -> DataFrame:
    """One row of each group, with all columns of ``df``: that of the smallest id; of rows that repeat it, any one.

    Groups are what links of a Jaccard similarity of ``similarity`` or more connect. Fingerprints within ``radius`` give the first candidates; such texts
    differ by some ten bits at a similarity of 0.8, more than tables of segments can search, so the exact prefix filter (``jaccard``)
    gives the rest. All candidates are verified by their shingles. A group whose ids are all null keeps one of its rows.
    """
    row = free_name(df, "row_key")
    keyed = df.withColumn(row, F.xxhash64(id_col, text_col))
    rows = jaccard.signatures(keyed, row, id_col, text_col, similarity, shingle_words, seed)
    # Of each node the row that stands for it: the smallest id, nulls last.
    best = F.min(F.struct(F.col("id").isNull(), "id", "row"))
    nodes = stored(rows.groupBy("node").agg(best.alias("best"), F.first("size").alias("size"), F.first("prefix").alias("prefix"), F.first("sketch").alias("sketch"), F.first("longs").alias("longs"), F.first("bits").alias("bits")))
    prints = stored(nodes.groupBy("bits").agg(F.min("node").alias("first")))
    same = nodes.select("node", "bits").join(prints.hint("merge"), "bits").filter("node != first").select(F.col("first").alias("src"), F.col("node").alias("dst"))
    first = lambda c: prints.select(F.col("bits").alias(c), F.col("first").alias(f"{c}_node")).hint("merge")
    close = links(prints.select("bits"), radius).join(first("src"), "src").join(first("dst"), "dst").select(F.col("src_node").alias("src"), F.col("dst_node").alias("dst"))
    candidates = same.unionByName(close).select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"))

    def texts(asked: DataFrame) -> DataFrame:
        mine = nodes.select("node", F.col("best.row").alias(row)).join(asked.hint("merge"), "node", "left_semi")
        return keyed.select(row, F.col(text_col).alias("text")).join(mine, row).dropDuplicates([row]).select("node", "text")

    roots = connected_components(jaccard.links(nodes, texts, candidates, similarity, shingle_words, seed))
    groups = nodes.select("node", "best").join(roots.hint("merge"), "node", "left").groupBy(F.coalesce("root", "node").alias("root")).agg(F.min("best").alias("best"))
    keep = stored(groups.select(F.col("best.row").alias(row)))
    return keyed.join(keep, row, "left_semi").dropDuplicates([row]).select(*quoted(df.columns))
