"""Links of texts by the exact Jaccard similarity of word shingles (for the pipeline's near-duplicate stage).

Words and shingles are those of operator 6, each distinct shingle counted once. Texts with the same shingles are one node. Two nodes
are linked if their Jaccard similarity is ``similarity`` or more; groups are what links connect.

Candidates lose no link: in any one order of all shingles, two sets that similar share one among the first
n - ceil(similarity * n) + 1 of each (prefix filter), the first such leaves enough behind it (positional filter), and their sizes are as near
(length filter). The order begins with rare shingles, as seen in a sample: the sample decides how many candidates there are, not which links are found.
It is a fixed share of the texts, so that shingles of CROWD texts are known as frequent in a large table as in a small one.
Every candidate must pass a bound from sketches, small bitmaps of the shingles: a bit that only one of two sets has stands for a shingle that only
that one has. Those that do are verified by the shingles of both texts.

Large groups of near copies share shingles by the thousand. So each shingle's nodes are verified against one of them first, together with
the candidates that the caller has; where these links leave several groups, against some more; and then only pairs that are still in different groups.

Passages that many texts share leave many nodes in different groups under one shingle, and the sample may not know it as frequent. Two nodes that such a
shingle joins have both of them, so nodes with one are compared among themselves in a second order: by exact counts among these nodes. A text with
less than four fifths of its shingles in passages is then out at once, for shingles of its own come first.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sylvagraph.llm.common import arrow_map, majority_bits, shingle_hashes, stored, text_bytes
from sylvagraph.llm.components import connected_components
from sylvagraph.llm.vectors import slices

#: The sample that tells frequent shingles: one row of so many, and so many rows at least; seen in so many of them; the table's size.
SAMPLE_OF, SAMPLE_ROWS, SEEN, FREQUENT = 4, 10_000, 4, 1 << 18
#: Longs of a node's bits, the bitmap that joins of the second order look at.
LONGS = 8
#: Nodes that all others of a shingle are verified against once the first links are known.
PIVOTS = 4
#: A shingle that leaves more nodes than this in different groups is compared in the second order.
CROWD = 64
#: Orders of keys (their values under a mask) of which a row has the smallest earlier key, and all its marks.
MASKS = (0, 0x5555555555555555, 0x3333333333333333)
MARKS = ("previous", "high", *(f"low{i}" for i in range(len(MASKS))))


def shingles_of(text: bytes, shingle_words: int = 5, seed: int = 42) -> np.ndarray:
    """The sorted distinct XXH64 of the word shingles of UTF-8 text; fewer words than a shingle are one."""
    return np.unique(shingle_hashes(text.lower().split(), shingle_words, seed))


def alike(a: np.ndarray, b: np.ndarray, similarity: Fraction) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both * similarity.denominator >= similarity.numerator * (len(a) + len(b) - both)


def _frequent(df: DataFrame, text_col: str, shingle_words: int, seed: int) -> np.ndarray:
    """Sorted by hash: shingles frequent in a sample, and their counts, as two rows."""
    rows = df.count()
    some = df.select(text_col).sample(min(1.0, max(1 / SAMPLE_OF, SAMPLE_ROWS / max(rows, 1))), seed=seed)

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for part in slices(batch, 500):
            found = [shingles_of(x, shingle_words, seed) for x in text_bytes(part.column(text_col))]
            values, n = np.unique(np.concatenate(found), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(values.view(np.int64)), pa.array(n.astype(np.int64))], names=["shingle", "n"])

    counts = arrow_map(some, run, "shingle bigint, n bigint").groupBy("shingle").agg(F.sum("n").alias("n")).filter(F.col("n") >= SEEN)
    top = counts.orderBy(F.desc("n"), "shingle").limit(FREQUENT).toArrow()
    values, n = top.column("shingle").to_numpy().view(np.uint64), top.column("n").to_numpy().astype(np.uint64)
    order = np.argsort(values)
    return np.stack((values[order], n[order]))


def signatures(df: DataFrame, row: str, id_col: str, text_col: str, similarity: Fraction, shingle_words: int, seed: int) -> DataFrame:
    """row, id, node (a hash of all shingles), size, prefix (the first shingles in order), sketch and bits (the SimHash of all shingles) of each row of ``df``."""
    frequent = df.sparkSession.sparkContext.broadcast(_frequent(df, text_col, shingle_words, seed))
    schema = T.StructType([
        T.StructField("row", T.LongType()), T.StructField("id", df.schema[id_col].dataType), T.StructField("node", T.LongType()), T.StructField("size", T.IntegerType()),
        T.StructField("prefix", T.ArrayType(T.LongType())), T.StructField("sketch", T.BinaryType()), T.StructField("longs", T.ArrayType(T.LongType())), T.StructField("bits", T.LongType()),
    ])

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for part in slices(batch, 1000):
            yield _signed(part, row, id_col, text_col, similarity, shingle_words, seed, frequent)

    return arrow_map(df.select(row, id_col, text_col), run, schema)


def _signed(batch: pa.RecordBatch, row: str, id_col: str, text_col: str, similarity: Fraction, shingle_words: int, seed: int, frequent: Broadcast) -> pa.RecordBatch:
    from xxhash import xxh64_intdigest

    known, counts = frequent.value
    nodes, sizes, prefixes, sketches, bitmaps, bits = [], [], [], [], [], []
    for text in text_bytes(batch.column(text_col)):
        words = text.lower().split()
        hashes = shingle_hashes(words, shingle_words, seed)
        bits.append(majority_bits(hashes) if words else 0)
        found = np.unique(hashes)
        nodes.append(xxh64_intdigest(found.tobytes(), seed))
        sizes.append(len(found))
        sketches.append(sketch_of(found))
        bitmaps.append(np.frombuffer(sketch_of(found, 64 * LONGS), dtype="<i8"))
        if len(known):
            at = np.minimum(np.searchsorted(known, found), len(known) - 1)
            found = found[np.lexsort((found, np.where(known[at] == found, counts[at], 0)))]
        least = -(-similarity.numerator * len(found) // similarity.denominator)
        prefixes.append(found[: len(found) - least + 1].view(np.int64))
    longs = lambda x: pa.array(np.array(x, dtype=np.uint64).view(np.int64))
    offsets = np.concatenate(([0], np.cumsum([len(x) for x in prefixes]))).astype(np.int32)
    lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(prefixes)))
    return pa.RecordBatch.from_arrays([batch.column(row), batch.column(id_col), longs(nodes), pa.array(sizes, pa.int32()), lists, pa.array(sketches, pa.binary()), pa.array(bitmaps, pa.list_(pa.int64())), longs(bits)], names=["row", "id", "node", "size", "prefix", "sketch", "longs", "bits"])


def sketch_of(shingles: np.ndarray, size: int = 0) -> bytes:
    """A bitmap of the shingles' last bits, of ``size`` bits or as many bits as shingles at least, and a power of two."""
    size = size or max(64, 1 << (len(shingles) - 1).bit_length())
    bits = np.zeros(size, dtype=bool)
    bits[(shingles & np.uint64(size - 1)).astype(np.int64)] = True
    return np.packbits(bits, bitorder="little").tobytes()


def may_be_alike(a: bytes, b: bytes, a_size: int, b_size: int, similarity: Fraction) -> bool:
    """False if sizes or sketches rule it out."""
    p, q = similarity.numerator, similarity.denominator
    if min(a_size, b_size) * q < max(a_size, b_size) * p:
        return False
    x, y, n, m = int.from_bytes(a, "little"), int.from_bytes(b, "little"), 8 * len(a), 8 * len(b)
    while n > m:
        n //= 2
        x = (x | x >> n) & ((1 << n) - 1)
    while m > n:
        m //= 2
        y = (y | y >> m) & ((1 << m) - 1)
    both = min(a_size - (x & ~y).bit_count(), b_size - (y & ~x).bit_count())
    return both * q >= p * (a_size + b_size - both)


def plausible(pairs: DataFrame, nodes: DataFrame, similarity: Fraction) -> DataFrame:
    """The ``pairs`` that sizes and sketches don't rule out."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        columns = [batch.column(c).to_pylist() for c in ("a", "b", "a_size", "b_size")]
        keep = [may_be_alike(*row, similarity) for row in zip(*columns, strict=True)]
        yield batch.select(["src", "dst"]).filter(pa.array(keep, pa.bool_()))

    named = lambda node, c: nodes.select(F.col("node").alias(node), F.col("sketch").alias(c), F.col("size").alias(f"{c}_size")).hint("merge")
    both = pairs.join(named("dst", "b"), "dst").join(named("src", "a"), "src")
    return arrow_map(both.select("src", "dst", "a", "b", "a_size", "b_size"), run, "src bigint, dst bigint")


def verified(pairs: DataFrame, texts: DataFrame, similarity: Fraction, shingle_words: int, seed: int) -> DataFrame:
    """The ``pairs`` (src, dst) of nodes that are links, by the ``texts`` (node, text) of the nodes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, mine = None, None
        for part in (part for batch in batches for part in slices(batch, 250)):
            keep = []
            src, a, b = part.column("src").to_pylist(), text_bytes(part.column("a")), text_bytes(part.column("b"))
            for s, x, y in zip(src, a, b, strict=True):
                if s != last or mine is None:
                    last, mine = s, shingles_of(x, shingle_words, seed)
                keep.append(alike(mine, shingles_of(y, shingle_words, seed), similarity))
            yield part.select(["src", "dst"]).filter(pa.array(keep, pa.bool_()))

    # The order by src saves most of its shingles.
    named = lambda node, text: texts.select(F.col("node").alias(node), F.col("text").alias(text)).hint("merge")
    both = pairs.join(named("dst", "b"), "dst").join(named("src", "a"), "src")
    return both.select("src", "dst", "a", "b").mapInArrow(run, "src bigint, dst bigint")


def links(nodes: DataFrame, texts: Callable[[DataFrame], DataFrame], candidates: DataFrame, similarity: Fraction, shingle_words: int = 5, seed: int = 42) -> DataFrame:
    """Links (src, dst) that connect just what all links connect.

    ``nodes``: node, size, prefix, sketch; ``texts``: gives node and text of the nodes of a table; ``candidates``: src < dst, pairs to verify besides those of the prefix filter.
    """
    filed = nodes.select("node", "size", F.posexplode("prefix").alias("pos", "key"))
    # Keys of one node link nothing.
    of_key = Window.partitionBy("key")
    filed = stored(filed.withColumn("first", F.min("node").over(of_key)).withColumn("last", F.max("node").over(of_key)).filter("first != last").drop("last"))
    stars = filed.filter("node != first").select(F.col("first").alias("src"), F.col("node").alias("dst"))
    tried = stored(plausible(stars.unionByName(candidates).distinct(), nodes, similarity))
    first = stored(verified(tried, _texts_of(tried, texts), similarity, shingle_words, seed))

    # Some more of each shingle's nodes, by other hashes, for groups whose members are about as similar as the threshold.
    between = stored(_mixed(_rooted(filed, first)))
    marks = [F.min(F.struct(F.xxhash64("node", F.lit(i)), "node", "root")).over(of_key) for i in range(PIVOTS)]
    marked = between.select("node", "root", *(mark.alias(f"mark{i}") for i, mark in enumerate(marks)))
    asked = marked.select("node", "root", F.explode(F.array(*(f"mark{i}" for i in range(PIVOTS)))).alias("mark")).filter("mark.root != root")
    more = asked.select(F.least("node", "mark.node").alias("src"), F.greatest("node", "mark.node").alias("dst")).distinct()
    more = stored(plausible(more.join(tried.hint("merge"), ["src", "dst"], "left_anti"), nodes, similarity))
    first = stored(first.unionByName(verified(more, _texts_of(more, texts), similarity, shingle_words, seed)))
    tried = tried.unionByName(more)

    mixed = _mixed(_rooted(between.drop("root"), first)).withColumn("crowd", F.count(F.lit(1)).over(of_key) > CROWD)
    rest = stored(mixed.select("key", "node", "size", "pos", "root", "crowd"))
    # Bitmaps go along, so that pairs that they rule out are never made.
    longs = nodes.select("node", "longs").hint("merge")
    # Nodes with a crowded key in common are compared in the second order anyway, so such keys too count as earlier ones.
    pairs = _paired(_marked(rest).filter("not crowd").join(longs, "node"), similarity)
    crowded = rest.filter("crowd").select("node", F.col("size").cast("bigint").alias("size"), "root").distinct()
    crowded = stored(crowded.join(longs, "node"))
    again = stored(_mixed(_second_order(crowded, texts, similarity, shingle_words, seed)))
    pairs = pairs.unionByName(_paired(_marked(again), similarity)).distinct()
    later = stored(plausible(pairs.join(tried.hint("merge"), ["src", "dst"], "left_anti"), nodes, similarity))
    return first.unionByName(verified(later, _texts_of(later, texts), similarity, shingle_words, seed))


def _rooted(rows: DataFrame, links: DataFrame) -> DataFrame:
    """``rows`` with the root of each node's group."""
    return rows.join(connected_components(links).hint("merge"), "node", "left").withColumn("root", F.coalesce("root", "node"))


def _mixed(rows: DataFrame) -> DataFrame:
    """The rows whose key has several roots."""
    of_key = Window.partitionBy("key")
    return rows.withColumn("low", F.min("root").over(of_key)).withColumn("high", F.max("root").over(of_key)).filter("low != high").drop("low", "high")


def _marked(rows: DataFrame) -> DataFrame:
    """The rows with some of the node's keys before each: the last one, the largest, and the smallest in ``MASKS`` orders. Null for a node's first key."""
    of_node = Window.partitionBy("node").orderBy("pos")
    before = of_node.rowsBetween(Window.unboundedPreceding, -1)
    least = [F.min(F.col("key").bitwiseXOR(F.lit(mask))).over(before).alias(f"low{i}") for i, mask in enumerate(MASKS)]
    return rows.select("*", F.lag("key").over(of_node).alias("previous"), F.max("key").over(before).alias("high"), *least)


def _paired(rows: DataFrame, similarity: Fraction) -> DataFrame:
    """src and dst of nodes of different roots that share a key and may be alike by sizes, places, longs and, if they have them, the marks of ``_marked``. ``rows``: key, node, size, pos, root, longs.

    Long texts that share a passage share hundreds of keys. A mark that both have is an earlier key in common, under which the pair is made, or was
    ruled out for good: so most pairs are made once, under their first key.
    """
    p, q = similarity.numerator, similarity.denominator
    a, b = rows.alias("a"), rows.alias("b").hint("merge")
    size_a, size_b = F.col("a.size").cast("bigint"), F.col("b.size").cast("bigint")
    # The first shingle in common has none in common before it.
    left = 1 + F.least(size_a - F.col("a.pos") - 1, size_b - F.col("b.pos") - 1)
    fits = (F.least(size_a, size_b) * q >= F.greatest(size_a, size_b) * p) & (left * (p + q) >= (size_a + size_b) * p)
    for mark in MARKS if "previous" in rows.columns else []:
        fits = fits & ~F.coalesce(F.col(f"a.{mark}") == F.col(f"b.{mark}"), F.lit(False))
    if "longs" in rows.columns:
        # As for sketches: a bit that one alone has is a shingle that one alone has.
        alone = lambda x, y: sum((F.bit_count(F.col(f"{x}.longs")[i].bitwiseAND(F.bitwise_not(F.col(f"{y}.longs")[i]))) for i in range(LONGS)), F.lit(0))
        fits = fits & (F.least(size_a - alone("a", "b"), size_b - alone("b", "a")) * (p + q) >= (size_a + size_b) * p)
    return a.join(b, (F.col("a.key") == F.col("b.key")) & (F.col("a.root") < F.col("b.root")) & fits).select(F.least("a.node", "b.node").alias("src"), F.greatest("a.node", "b.node").alias("dst"))


def _second_order(nodes: DataFrame, texts: Callable[[DataFrame], DataFrame], similarity: Fraction, shingle_words: int, seed: int) -> DataFrame:
    """key, node, size, pos, root and longs of the first shingles of ``nodes`` (node, size, root, longs), by their counts among them; those of one node are left out."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for part in slices(batch, 500):
            found = [shingles_of(x, shingle_words, seed).view(np.int64) for x in text_bytes(part.column("text"))]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(part.column("node").to_numpy(), [len(x) for x in found])), pa.array(np.concatenate(found))], names=["node", "key"])

    keys = arrow_map(texts(nodes.select("node")), run, "node bigint, key bigint")
    shared = stored(keys.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("key"))).filter("n > 1"))
    of_node = Window.partitionBy("node")
    ranked = shared.withColumn("rank", F.row_number().over(of_node.orderBy("n", "key")) - 1).withColumn("shared", F.count(F.lit(1)).over(of_node))
    # Shingles of a node's own come before those.
    placed = ranked.join(nodes.hint("merge"), "node").withColumn("pos", F.col("size") - F.col("shared") + F.col("rank"))
    p, q = similarity.numerator, similarity.denominator
    return placed.filter(F.expr(f"pos <= size - (size * {p} + {q - 1}) div {q}")).select("key", "node", "size", "pos", "root", "longs")


def _texts_of(pairs: DataFrame, texts: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Texts of candidates, stored: only these are shuffled by pairs."""
    return stored(texts(pairs.select(F.explode(F.array("src", "dst")).alias("node")).distinct()))
