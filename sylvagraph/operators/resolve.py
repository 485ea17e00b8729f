"""Resolution of link targets against the nodes that exist."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sylvagraph.functions.paths import structural

#: Fixed values, in the order in which they are tried.
SUFFIXES = [".ts", ".tsx", ".js", ".jsx", ".mts", ".cts", ".mjs", ".cjs"]
TRIED = ["", *SUFFIXES, *(f"/index{s}" for s in SUFFIXES)]
#: Symbols of any candidate file come before any candidate file itself.
FILE_RANK = 1000


def asked_by(file: Column) -> Column:
    """The targets without a symbol for which ``file`` is tried, each with its place in ``TRIED``: an array of structs (base, at), of at most three.

    This is what is tried, turned round: a target has many candidates, a file ends in one suffix.
    """
    cut_off = F.array(*(F.when(file.endswith(s), F.struct(F.substring(file, F.lit(1), F.char_length(file) - len(s)).alias("base"), F.lit(at).alias("at"))) for at, s in enumerate(TRIED)))
    return F.array_compact(cut_off)


def ranked_targets(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """The links whose target is no node, each with ``found`` (null: none) and its ``rank`` among what was tried.

    What is found depends on the target alone, so each is looked up once. Candidates are found from the nodes' side, each by an equi-join on what it may stand for.
    """
    ids = nodes.select(F.col("id").alias("candidate"))
    missing = links.join(ids, links.target == ids.candidate, "left_anti")
    symbol = F.when(F.col("target").contains("#"), F.split_part("target", F.lit("#"), F.lit(2)))
    targets = missing.select("target").distinct().select("target", structural(F.col("target")).alias("base"), symbol.alias("symbol"))
    named = targets.filter("symbol is not null")
    is_symbol = F.col("id").contains("#")
    tails = nodes.filter(is_symbol).select("id", F.expr("substring(id, instr(id, '#') + 1)").alias("symbol"), F.inline(asked_by(structural(F.col("id")))))
    by_name = named.join(tails, ["base", "symbol"]).select("target", (F.col("at") * 3).alias("rank"), F.col("id").alias("candidate"))
    files = nodes.filter(~is_symbol)
    itself = targets.join(files.select("id", F.inline(asked_by(F.col("id")))), "base").select("target", (F.col("at") + FILE_RANK).alias("rank"), F.col("id").alias("candidate"))
    exporting = files.filter(F.size("exports") > 0).select("id", "exports", F.inline(asked_by(F.col("id"))))
    match = F.get(F.filter("exports", lambda e: (e.exported_name == F.col("symbol")) | ((F.col("symbol") == "default") & e.is_default)), F.lit(0))
    in_file = F.transform(F.array(match.local_name, match.exported_name), lambda n, i: F.struct((F.col("at") * 3 + i + 1).alias("rank"), F.concat("id", F.lit("#"), n).alias("candidate")))
    by_export = named.join(exporting, "base").select("target", F.inline(in_file)).filter("candidate is not null").join(ids, "candidate", "left_semi").select("target", "rank", "candidate")
    best = by_name.unionByName(itself).unionByName(by_export).groupBy("target").agg(F.min(F.struct("rank", "candidate")).alias("best"))
    return missing.join(best, "target", "left").select(*links.columns, F.col("best.candidate").alias("found"), F.col("best.rank").alias("rank"))


def resolve_links(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """Links with their targets replaced by nodes; links without one are dropped, duplicates stay. Sources aren't checked."""
    exact = links.join(nodes.select(F.col("id").alias("target")), "target", "left_semi").select(*links.columns)
    moved = ranked_targets(nodes, links).filter("found is not null").withColumn("target", F.col("found")).select(*links.columns)
    return exact.unionByName(moved)


#: What tells links apart; ``target`` is what was written, before resolution.
LINK = ["source", "target", "value", "type", "ord"]


def with_found(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """The links that resolve, with what was written as ``target`` and the node as ``found``."""
    exact = links.join(nodes.select(F.col("id").alias("target")), "target", "left_semi").select(*LINK, F.col("target").alias("found"))
    return exact.unionByName(ranked_targets(nodes, links).filter("found is not null").select(*LINK, "found"))


def waiting(links: DataFrame) -> DataFrame:
    """The inverted table of links: by ``key``, the file or folder that the target names without a suffix. ``touched_links`` has the ids whose coming, going or change may lead the link elsewhere.

    A symbol comes and goes with its file.
    """
    return links.select(structural(F.col("target")).alias("key"), *LINK)


def touched_links(waits: DataFrame, keys: DataFrame) -> DataFrame:
    """The links that wait for any of ``keys`` (key): those whose target names it, with or without a suffix."""
    bases = keys.select(F.explode(asked_by(F.col("key"))).alias("asked")).select(F.col("asked.base").alias("key")).distinct()
    return waits.join(bases, "key", "left_semi").select(*LINK).distinct()


def reresolved(before: DataFrame, again: DataFrame, nodes: DataFrame) -> DataFrame:
    """``before`` (as of ``with_found``) where only the links ``again`` are resolved anew, against ``nodes``."""
    return before.join(again, LINK, "left_anti").select(*LINK, "found").unionByName(with_found(nodes, again))


def unresolved_links(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """The links that resolution drops."""
    return ranked_targets(nodes, links).filter("found is null").select(*links.columns)
