"""Which texts hold which others: a join on substrings by postings of short runs of characters.

A needle is looked up by its rarest run of ``RUN`` characters (a shorter needle by itself), so only texts that have this run are compared with it. Runs of texts and of needles
meet in equi-joins; no side is an array or a broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RUN = 3


def _runs(text: Column, size: int) -> Column:
    """The distinct runs of ``size`` characters."""
    last = F.char_length(text) - size + 1
    return F.when(last > 0, F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.substr(text, i, F.lit(size))))).otherwise(F.array().cast("array<string>"))


def holding(needles: DataFrame, texts: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Each distinct needle (``by``..., needle) with every row of ``texts`` (``by``..., text and others) of the same ``by`` that holds it. An empty needle is held by every text.

    Null needles and texts meet nothing.
    """
    by = by or []
    asked = needles.select(*by, "needle").filter("needle is not null").distinct()
    held = texts.filter("text is not null")
    size = F.least(F.char_length("needle"), F.lit(RUN))
    out = asked.filter("needle = ''").join(held, by) if by else asked.filter("needle = ''").join(held, F.lit(True))
    # Needles shorter than a run are runs of their own size.
    postings = held.withColumn("run", F.explode(F.concat(*(_runs(F.col("text"), n) for n in range(1, RUN + 1)))))
    runs = asked.filter("needle != ''").select(*by, "needle", F.explode(F.when(size == RUN, _runs(F.col("needle"), RUN)).otherwise(F.array("needle"))).alias("run"))
    counts = postings.join(runs.select(*by, "run").distinct(), [*by, "run"], "left_semi").groupBy(*by, "run").agg(F.count(F.lit(1)).alias("n"))
    # A run that no text has rules its needle out.
    rarest = runs.join(counts, [*by, "run"], "left").groupBy(*by, "needle").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "run")).alias("r")).filter("r.n > 0")
    near = rarest.select(*by, "needle", F.col("r.run").alias("run")).join(postings, [*by, "run"])
    found = near.filter(F.contains("text", F.col("needle"))).select(*by, "needle", *(c for c in texts.columns if c not in by))
    return found.unionByName(out.select(*found.columns))


def first_holding(needles: DataFrame, texts: DataFrame) -> DataFrame:
    """needle and the id of the first text (ord, id, text) that holds it."""
    return holding(needles, texts).groupBy("needle").agg(F.min(F.struct("ord", "id")).alias("first")).select("needle", F.col("first.id").alias("id"))
