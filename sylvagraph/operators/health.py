"""Health score and patterns of a graph."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sylvagraph.operators import architecture
from sylvagraph.operators.stats import degrees, with_directory_parent
from sylvagraph.schema import CodeGraph


def orphans(graph: CodeGraph, classified: DataFrame) -> DataFrame:
    """Ids of nodes outside configuration, folders and projects that have no link, no parent that exists and no child."""
    nodes, links = graph.nodes, graph.links
    touched = links.select(F.col("source").alias("id")).unionByName(links.select(F.col("target").alias("id"))).unionByName(nodes.filter("parent_id is not null").select(F.col("parent_id").alias("id"))).distinct()
    with_parent = nodes.join(nodes.select(F.col("id").alias("parent_id")), "parent_id", "left_semi").select("id")
    single = nodes.filter(~F.col("type").isin("directory", "project")).join(touched, "id", "left_anti").join(with_parent, "id", "left_anti")
    return single.join(classified.filter("layer != 'configuration'").select("id"), "id", "left_semi").select("id")


def unresolved_imports(nodes: DataFrame, links: DataFrame) -> DataFrame:
    return links.filter("type = 'import'").join(nodes.select(F.col("id").alias("target")), "target", "left_anti")


def facts(graph: CodeGraph, classified: DataFrame, edges: DataFrame) -> DataFrame:
    """One row of what the score depends on."""
    one = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    nodes = graph.nodes.agg(F.count(F.lit(1)).alias("node_count"), F.count_if(F.col("id").contains("#")).alias("symbol_count"), F.count_if(F.col("type") == "file").alias("file_count"))
    cover = with_directory_parent(graph.nodes, graph.root).agg(F.count(F.lit(1)).alias("expected"), F.count_if("covered").alias("covered"))
    summary = architecture.summary(classified, edges).select("violation_count", "unknown_nodes")
    parts = [one(graph.links, "link_count"), one(orphans(graph, classified), "orphan_count"), one(unresolved_imports(graph.nodes, graph.links), "unresolved_count"), cover, summary]
    for part in parts:
        nodes = nodes.join(part, F.lit(True))
    return nodes.withColumn("coverage", F.when(F.col("expected") == 0, 1.0).otherwise(F.col("covered") / F.col("expected")))


def _issue(code: str, holds: Column, points: Column, severity: Column) -> Column:
    return F.struct(F.lit(code).alias("code"), holds.alias("holds"), points.cast("bigint").alias("points"), severity.alias("severity"))


def issue_array() -> Column:
    """Every issue with whether it holds, its deduction and severity, over a row of ``facts``."""
    c = F.col
    graded = lambda n, at, high, low: F.when(c(n) > at, high).otherwise(low)
    return F.array(
        _issue("empty_graph", c("node_count") == 0, F.lit(70), F.lit("high")),
        _issue("unresolved_import_links", c("unresolved_count") > 0, F.least(F.lit(25), c("unresolved_count")), graded("unresolved_count", 25, "high", "medium")),
        _issue("orphan_nodes", c("orphan_count") > 0, F.least(F.lit(15), F.ceil(c("orphan_count") / 3)), graded("orphan_count", 20, "medium", "low")),
        _issue("weak_hierarchy", c("coverage") < 0.85, F.least(F.lit(20), F.ceil((1 - c("coverage")) * 20)), F.when(c("coverage") < 0.5, "high").otherwise("medium")),
        _issue("missing_symbols", (c("symbol_count") == 0) & (c("file_count") > 0), F.lit(25), F.lit("high")),
        _issue("architecture_violations", c("violation_count") > 0, F.least(F.lit(20), c("violation_count") * 2), graded("violation_count", 10, "high", "medium")),
        _issue("unknown_layer_nodes", c("unknown_nodes") > 0, F.least(F.lit(10), F.ceil(c("unknown_nodes") / 10)), graded("unknown_nodes", 25, "medium", "low")),
    )


def issues(found: DataFrame) -> DataFrame:
    return found.select(F.inline(issue_array())).filter("holds").select("code", "severity", "points")


def grade(score: Column) -> Column:
    return F.when(score >= 90, "A").when(score >= 80, "B").when(score >= 70, "C").when(score >= 60, "D").otherwise("F")


def health_score(found: DataFrame) -> DataFrame:
    """The facts with score (0 to 100) and grade."""
    lost = F.aggregate(issue_array(), F.lit(0).cast("bigint"), lambda a, x: a + F.when(x.holds, x.points).otherwise(F.lit(0).cast("bigint")))
    score = F.greatest(F.lit(0), F.least(F.lit(100), F.lit(100) - lost)).cast("int")
    return found.withColumn("score", score).withColumn("grade", grade(score))


# Patterns: rows (pattern_id, place, node_id, metric) and a summary (pattern_id, severity, n).


def _ranked(df: DataFrame, name: str, metric: str, most: int) -> DataFrame:
    top = df.orderBy(F.desc(metric), "ord", "id").limit(most)
    return top.select(F.lit(name).alias("pattern_id"), F.col("id").alias("node_id"), F.col(metric).cast("bigint").alias("metric"))


def hub_nodes(with_degrees: DataFrame, least: int = 8, most: int = 10) -> DataFrame:
    return _ranked(with_degrees.filter(F.col("type").isin("file", "class", "function") & (F.col("fan_in") >= least)), "hub_nodes", "fan_in", most)


def high_fan_out_files(with_degrees: DataFrame, least: int = 12, most: int = 10) -> DataFrame:
    return _ranked(with_degrees.filter((F.col("type") == "file") & (F.col("fan_out") >= least)), "high_fan_out_files", "fan_out", most)


def deep_nesting(with_depth: DataFrame, least: int = 5, most: int = 20) -> DataFrame:
    """The first in store order. ``with_depth``: nodes with depth."""
    some = with_depth.filter(F.col("type").isin("file", "directory") & (F.col("depth") >= least)).orderBy("ord", "id").limit(most)
    return some.select(F.lit("deep_nesting").alias("pattern_id"), F.col("id").alias("node_id"), F.col("depth").cast("bigint").alias("metric"))


def churn_hotspots(nodes: DataFrame, least: int = 10, most: int = 10) -> DataFrame:
    return _ranked(nodes.filter((F.col("type") == "file") & (F.col("churn") >= least)), "churn_hotspots", "churn", most)


def broad_adr_impact(nodes: DataFrame, links: DataFrame, least: int = 12) -> DataFrame:
    sources = links.filter("type = 'adr'").groupBy(F.col("target").alias("id")).agg(F.countDistinct("source").alias("n")).filter(F.col("n") >= least)
    return nodes.join(sources, "id").select(F.lit("broad_adr_impact").alias("pattern_id"), F.col("id").alias("node_id"), F.col("n").alias("metric"))


def isolated_files(graph: CodeGraph, classified: DataFrame, most: int = 10) -> DataFrame:
    """The first orphans in store order that are files."""
    some = graph.nodes.filter("type = 'file'").join(orphans(graph, classified), "id", "left_semi").orderBy("ord", "id").limit(most)
    return some.select(F.lit("isolated_files").alias("pattern_id"), F.col("id").alias("node_id"), F.lit(0).cast("bigint").alias("metric"))


def pattern_rows(graph: CodeGraph, classified: DataFrame, with_depth: DataFrame) -> DataFrame:
    """pattern_id, node_id and metric of the nodes of all patterns."""
    counted = degrees(graph.nodes, graph.links)
    parts = [hub_nodes(counted), high_fan_out_files(counted), deep_nesting(with_depth), churn_hotspots(graph.nodes), broad_adr_impact(graph.nodes, graph.links), isolated_files(graph, classified)]
    return reduce(DataFrame.unionByName, (p.select("pattern_id", "node_id", F.col("metric").cast("bigint").alias("metric")) for p in parts))


def violation_ends(found: DataFrame, most: int = 15) -> DataFrame:
    """place and node_id of both ends of the first violations (s, t, ord) in store order, repeats included."""
    first = found.orderBy("ord", "s", "t").limit(most).agg(F.sort_array(F.collect_list(F.struct("ord", "s", "t"))).alias("v"))
    return first.select(F.posexplode(F.flatten(F.transform("v", lambda x: F.array(x.s, x.t)))).alias("place", "node_id"))


def pattern_summary(graph: CodeGraph, classified: DataFrame, edges: DataFrame, with_depth: DataFrame) -> DataFrame:
    """pattern_id, severity and n of the patterns that are there."""
    counted = degrees(graph.nodes, graph.links)
    rows = [
        (hub_nodes(counted), 1, lambda n, m: F.when(m >= 15, "high").otherwise("medium")),
        (high_fan_out_files(counted), 1, lambda n, m: F.when(m >= 20, "high").otherwise("medium")),
        (deep_nesting(with_depth), 1, lambda n, m: F.when(n > 10, "medium").otherwise("low")),
        (churn_hotspots(graph.nodes), 1, lambda n, m: F.when(m >= 25, "high").otherwise("medium")),
        (broad_adr_impact(graph.nodes, graph.links), 1, lambda n, m: F.lit("low")),
        (isolated_files(graph, classified), 3, lambda n, m: F.when(n >= 8, "medium").otherwise("low")),
    ]
    found = None
    for df, least, severity in rows:
        one = df.groupBy("pattern_id").agg(F.count(F.lit(1)).alias("n"), F.max("metric").alias("m")).filter(F.col("n") >= least).select("pattern_id", severity(F.col("n"), F.col("m")).alias("severity"), "n")
        found = one if found is None else found.unionByName(one)
    of_edges = architecture.violations(edges).agg(F.count(F.lit(1)).alias("n")).filter("n > 0").select(F.lit("layer_violations").alias("pattern_id"), F.when(F.col("n") > 10, "high").otherwise("medium").alias("severity"), "n")
    unknown = classified.filter("layer = 'unknown'").agg(F.count(F.lit(1)).alias("n")).filter("n >= 5").select(F.lit("unknown_layer_classification").alias("pattern_id"), F.lit("low").alias("severity"), "n")
    return found.unionByName(of_edges).unionByName(unknown)
