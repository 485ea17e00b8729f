"""Mixing sources to target weights by Pfair scheduling (operator 2). DataFrame and SQL functions only.

Each source's documents, in an order that depends on ids alone, are dealt into blocks. Source s with the whole-number
weight m(s) offers m(s) blocks a round, while it lasts; a source that has no block left gives its share to the others. In a
round of C blocks, block j (from 1) of a source with c of them is released at slot floor((j-1)*C/c) and due at
ceil(j*C/c). Each slot takes the released block that is due first (ties: by source). One resource and rates that sum to one make
this schedule feasible, so within a round no source is ahead or behind its share by a whole block. Rounds begin and end on
time, so they are scheduled independently: a block's slot follows from the pattern of its round's composition, and
compositions change at most twice for each source that ends. A composition's pattern is one expression.

All rows are kept: none is dropped, sampled or repeated. Ranks come from counts of hash buckets of bounded size, so a
source that holds most rows is ranked by many tasks. A round should have some hundred blocks at most (the weights of all sources), since a
pattern's time grows with the product of its blocks and sources; the number of documents doesn't matter to it. A null source is a source of its own. Rows with equal
ids take neighbouring ranks; which of them is first depends on their other columns. Rows with null ids are
placed by their other columns. Sources without a target weight get ``default_weight``. An empty table gives an empty schedule.
Columns may have any names; those named like the three added ones are replaced by them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sylvagraph.llm.common import stored

#: The target weights of the production query. All other sources get 1.
TARGET_WEIGHTS = {"src0": 6, "src1": 4, "src2": 4, "src3": 2, "src4": 2}
BLOCK_ROWS = 16
#: Hex digits of the hash that name a bucket: four, so 65,536 buckets a source.
BUCKET_DIGITS = 4
#: Patterns of up to so many rows are broadcast; larger ones are joined by a shuffle.
BROADCAST_ROWS = 100_000


def _prior(*by: str) -> Window:
    return Window.partitionBy(*by[:-1]).orderBy(by[-1]).rowsBetween(Window.unboundedPreceding, -1)


def _sum_before(column: str, *by: str) -> Column:
    return F.coalesce(F.sum(column).over(_prior(*by)), F.lit(0))


def _weight(weights: dict[str, int], default: int) -> Column:
    found = F.lit(default)
    for name, m in sorted(weights.items()):
        found = F.when(F.col("mix_source") == f"={name}", m).otherwise(found)
    return found.cast("bigint")


def sources_of(buckets: DataFrame, weights: dict[str, int], default_weight: int, block_rows: int) -> DataFrame:
    """mix_source, rows, blocks and m."""
    return buckets.groupBy("mix_source").agg(F.sum("n").alias("rows")).select("mix_source", "rows", F.ceil(F.col("rows") / block_rows).cast("bigint").alias("blocks"), _weight(weights, default_weight).alias("m"))


def phases_of(sources: DataFrame) -> DataFrame:
    """Rounds of one composition: phase (from 1), first round, slots before it, its composition (source, blocks a round) in source order and its size."""
    edges = sources.select(F.explode(F.array(F.lit(0).cast("bigint"), F.expr("blocks div m"), F.expr("(blocks + m - 1) div m"))).alias("from_round")).distinct()
    ends = edges.agg(F.sort_array(F.collect_set("from_round")).alias("starts"))
    edges = ends.select(F.posexplode("starts").alias("at", "from_round")).select((F.col("at") + 1).alias("phase"), "from_round")
    # The phases are at most two a source, so each source is asked for its share of each.
    shares = sources.withColumn("starts", ends.scalar()).select("mix_source", "m", "blocks", F.posexplode("starts").alias("at", "from_round"))
    return (
        shares.select(
            (F.col("at") + 1).alias("phase"),
            "from_round",
            F.least(F.col("blocks"), F.col("from_round") * F.col("m")).alias("done"),
            F.struct("mix_source", F.greatest(F.lit(0), F.least("m", F.col("blocks") - F.col("from_round") * F.col("m"))).alias("c")).alias("share"),
        )
        .groupBy("phase", "from_round")
        .agg(F.sum("done").alias("slots_before"), F.sort_array(F.expr("collect_list(share) filter (where share.c > 0)")).alias("parts"))
        .withColumn("size", F.aggregate("parts", F.lit(0).cast("bigint"), lambda a, x: a + x.c))
        .filter("size > 0")
    )


def patterns_of(phases: DataFrame) -> DataFrame:
    """Earliest-deadline-first over one round of each phase: phase, mix_source, j (from 0) and slot_in_round."""
    pick = """
        array_min(filter(transform(sequence(0, size(parts) - 1), i -> if(
            s.done[i] < parts[i].c and (s.done[i] * size) div parts[i].c <= t,
            struct(((s.done[i] + 1) * size + parts[i].c - 1) div parts[i].c as due, i as i), null)), x -> x is not null)).i"""
    picks = F.expr(f"""
        aggregate(
            sequence(0L, size - 1),
            struct(transform(parts, x -> 0L) as done, cast(array() as array<int>) as picks),
            (s, t) -> transform(array({pick}), p -> struct(transform(s.done, (n, i) -> if(i = p, n + 1, n)) as done, concat(s.picks, array(p)) as picks))[0],
            s -> s.picks)""")
    slots = phases.select("phase", "parts", picks.alias("picks")).select("phase", "parts", "picks", F.posexplode("picks").alias("slot_in_round", "i"))
    j = F.expr("size(filter(slice(picks, 1, slot_in_round), x -> x = i))")
    return slots.select("phase", F.expr("parts[i].mix_source").alias("mix_source"), j.cast("bigint").alias("j"), F.col("slot_in_round").cast("bigint").alias("slot_in_round"))


def schedule(df: DataFrame, weights: dict[str, int] | None = None, default_weight: int = 1, block_rows: int = BLOCK_ROWS, id_col: str = "doc_id", source_col: str = "source", bucket_digits: int = BUCKET_DIGITS) -> DataFrame:
    """``df`` with mix_block (of its source), mix_slot (of the block, over all) and mix_row (within the block)."""
    weights = TARGET_WEIGHTS if weights is None else weights
    if min([default_weight, *weights.values()]) < 1:
        raise ValueError("weights are whole numbers from 1")
    return _placed(df, weights, default_weight, block_rows, id_col, source_col, bucket_digits).select(*_columns(df, ("mix_block", "mix_slot", "mix_row")), "mix_block", "mix_slot", "mix_row")


def _columns(df: DataFrame, without: tuple[str, ...] = ()) -> list[Column]:
    return [F.col("mix_all").getField(c).alias(c) for c in df.columns if c.lower() not in without]


def _placed(df: DataFrame, weights: dict[str, int], default_weight: int, block_rows: int, id_col: str, source_col: str, bucket_digits: int) -> DataFrame:
    """mix_all (a row of ``df``, so that none of its names can clash), mix_block, mix_slot and mix_row."""
    row = F.struct(*(F.col(f"`{c}`") for c in df.columns))
    keyed = df.select(row.alias("mix_all")).select(
        "mix_all",
        F.when(F.col("mix_all")[source_col].isNull(), "").otherwise(F.concat(F.lit("="), F.col("mix_all")[source_col])).alias("mix_source"),
        F.md5(F.coalesce(F.col("mix_all")[id_col].cast("string"), F.xxhash64("mix_all").cast("string")).cast("binary")).alias("mix_key"),
    )
    keyed = keyed.withColumn("mix_bucket", F.substring("mix_key", 1, bucket_digits))
    buckets = stored(keyed.groupBy("mix_source", "mix_bucket").agg(F.count(F.lit(1)).alias("n")))
    sources = stored(sources_of(buckets, weights, default_weight, block_rows).coalesce(1))
    phases = stored(phases_of(sources).coalesce(1))
    patterns = stored(patterns_of(phases).join(phases.select("phase", "from_round", "slots_before", "size"), "phase").coalesce(1))

    # Ranks: rows of the source's buckets before, by groups of buckets first.
    wide = buckets.withColumn("mix_super", F.substring("mix_bucket", 1, max(1, bucket_digits // 2)))
    supers = wide.groupBy("mix_source", "mix_super").agg(F.sum("n").alias("of_super")).withColumn("base", _sum_before("of_super", "mix_source", "mix_super")).drop("of_super")
    bases = (
        wide.withColumn("inside", _sum_before("n", "mix_source", "mix_super", "mix_bucket"))
        .join(supers, ["mix_source", "mix_super"])
        .join(sources.select("mix_source", "m"), "mix_source")
        .select("mix_source", "mix_bucket", (F.col("base") + F.col("inside")).alias("mix_base"), "m")
    )
    order = Window.partitionBy("mix_source", "mix_bucket").orderBy("mix_key", F.col("mix_all")[id_col], F.xxhash64("mix_all"))
    starts = phases.agg(F.sort_array(F.collect_list("from_round"))).scalar()
    placed = (
        keyed.withColumn("mix_rank", F.row_number().over(order) - 1)
        .join(bases, ["mix_source", "mix_bucket"])
        .withColumn("mix_rank", F.col("mix_base") + F.col("mix_rank"))
        .withColumn("mix_block", F.expr(f"mix_rank div {block_rows}"))
        .withColumn("mix_round", F.expr("mix_block div m"))
        .withColumn("j", F.expr("mix_block % m"))
        .withColumn("mix_starts", starts)
        .withColumn("phase", F.size(F.filter("mix_starts", lambda x: x <= F.col("mix_round"))))
    )
    small = patterns.count() <= BROADCAST_ROWS
    joined = placed.join(F.broadcast(patterns) if small else patterns, ["phase", "mix_source", "j"])
    slot = F.col("slots_before") + (F.col("mix_round") - F.col("from_round")) * F.col("size") + F.col("slot_in_round")
    return joined.select("mix_all", "mix_block", slot.alias("mix_slot"), F.expr(f"mix_rank % {block_rows}").alias("mix_row"))


def mixed(df: DataFrame, weights: dict[str, int] | None = None, default_weight: int = 1, block_rows: int = BLOCK_ROWS, id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """The rows of ``df`` in mixed order: partitions by ranges of slots, each sorted."""
    found = _placed(df, TARGET_WEIGHTS if weights is None else weights, default_weight, block_rows, id_col, source_col, BUCKET_DIGITS)
    return found.repartitionByRange("mix_slot").sortWithinPartitions("mix_slot", "mix_row").select(*_columns(df))
