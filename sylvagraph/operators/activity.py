"""Change activity from version control, and the impact of a set of changed files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HASH = r"\A[a-f0-9]{40}\z"


def churn(commits: DataFrame) -> DataFrame:
    """file_path and n: rows of commits that touch a file."""
    return commits.groupBy("file_path").agg(F.count(F.lit(1)).alias("n"))


def heatmap(commits: DataFrame, since: str | None = None, until: str | None = None) -> DataFrame:
    """file_path, commits, additions, deletions, last_modified, authors (sorted, without what looks like a hash)."""
    if since is not None:
        commits = commits.filter(F.col("ts") >= F.lit(since).cast("timestamp"))
    if until is not None:
        commits = commits.filter(F.col("ts") <= F.lit(until).cast("timestamp"))
    return commits.groupBy("file_path").agg(
        F.countDistinct("hash").alias("commits"), F.sum("additions").alias("additions"), F.sum("deletions").alias("deletions"),
        F.max("ts").alias("last_modified"), F.sort_array(F.filter(F.collect_set("author"), lambda a: ~a.rlike(HASH))).alias("authors"),
    )


def heatmap_globals(found: DataFrame) -> DataFrame:
    """One row: max_commits and max_changes (1 at least) and total_files."""
    floor = lambda c: F.greatest(F.coalesce(F.max(c), F.lit(1)), F.lit(1))
    return found.agg(floor(F.col("commits")).alias("max_commits"), floor(F.col("additions") + F.col("deletions")).alias("max_changes"), F.count(F.lit(1)).alias("total_files"))


def heatmap_bands(found: DataFrame) -> DataFrame:
    """``found`` with intensity, its band (0 to 4 by fifths) and bar_percent (2 at least)."""
    most = heatmap_globals(found).select("max_commits")
    share = F.least(F.col("commits") / F.col("max_commits"), F.lit(1.0))
    return found.join(F.broadcast(most), F.lit(True)).withColumn("intensity", share).withColumn("band", F.least(F.floor(F.col("intensity") * 5), F.lit(4)).cast("int")).withColumn("bar_percent", F.greatest(F.col("intensity") * 100, F.lit(2.0))).drop("max_commits")


def changed_files(numstat: DataFrame, base_paths: DataFrame, head_paths: DataFrame) -> DataFrame:
    """path, status, additions, deletions. Status by whether the path is in either tree."""
    trees = base_paths.select("path", F.lit(True).alias("old")).join(head_paths.select("path", F.lit(True).alias("new")), "path", "full_outer")
    status = F.when(F.col("old").isNull() & F.col("new").isNotNull(), "added").when(F.col("old").isNotNull() & F.col("new").isNull(), "deleted").otherwise("modified")
    return numstat.join(trees, "path", "left").select("path", status.alias("status"), "additions", "deletions")


def change_blast(nodes: DataFrame, neighbors: DataFrame, changed: DataFrame) -> DataFrame:
    """path, node_id and neighbors for each node of a changed file. ``neighbors``: origin and one row a neighbour; ``nodes``: id and file_path."""
    counts = neighbors.groupBy(F.col("origin").alias("node_id")).agg(F.count(F.lit(1)).alias("neighbors"))
    return changed.select("path", "status").join(nodes.select(F.col("id").alias("node_id"), F.col("file_path").alias("path")), "path").join(counts, "node_id", "left").fillna(0, ["neighbors"])


def risk(changes: Column, blast: Column, nodes: Column) -> Column:
    level = lambda c, b, n: (changes > c) | (blast > b) | (nodes > n)
    return F.when(level(500, 50, 20), "critical").when(level(200, 20, 10), "high").when(level(50, 5, 5), "medium").otherwise("low")


def pr_summary(changed: DataFrame, blast: DataFrame) -> DataFrame:
    """One row: changed_files, total_changes, blast_radius, affected_nodes, risk and recommendation codes."""
    a = changed.agg(F.count(F.lit(1)).alias("changed_files"), F.coalesce(F.sum(F.col("additions") + F.col("deletions")), F.lit(0)).alias("total_changes"), F.coalesce(F.bool_or(F.col("path").contains("test")), F.lit(False)).alias("tests"))
    b = blast.agg(F.coalesce(F.sum("neighbors"), F.lit(0)).alias("blast_radius"), F.countDistinct("node_id").alias("affected_nodes"), F.coalesce(F.bool_or((F.col("status") == "deleted") & (F.col("neighbors") > 5)), F.lit(False)).alias("cuts"))
    row = a.join(b, F.lit(True)).withColumn("risk", risk(F.col("total_changes"), F.col("blast_radius"), F.col("affected_nodes")))
    codes = F.array_compact(F.array(F.when(F.col("cuts"), "deleted_file_has_dependents"), F.when(F.col("affected_nodes") > 10, "split_change"), F.when(F.col("tests"), "tests_changed").otherwise("no_tests_changed")))
    return row.withColumn("recommendations", codes).drop("tests", "cuts")
