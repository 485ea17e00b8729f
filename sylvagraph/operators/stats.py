"""Counts, degrees and neighbourhoods."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sylvagraph.functions.paths import dirname, extension, structural

# Languages by extension.
LANGUAGES = {
    "javascript": [".js", ".mjs", ".cjs", ".jsx"],
    "typescript": [".ts", ".mts", ".cts"],
    "tsx": [".tsx"],
    "python": [".py"],
    "go": [".go"],
    "rust": [".rs"],
    "java": [".java"],
    "cpp": [".c", ".cc", ".cpp", ".h", ".hpp"],
    "c_sharp": [".cs"],
    "php": [".php"],
    "ruby": [".rb"],
    "zig": [".zig"],
    "swift": [".swift"],
    "kotlin": [".kt", ".kts"],
    "markdown": [".md"],
    "bash": [".sh", ".bash"],
    "html": [".html", ".htm"],
    "css": [".css"],
    "vue": [".vue"],
    "yaml": [".yml", ".yaml"],
    "json": [".json"],
}


def language_of(path: Column) -> Column:
    """The language id of a path, null if none claims its extension."""
    # One look into a map, so the extension is cut off once a row.
    of = F.create_map(*(F.lit(x) for name, exts in LANGUAGES.items() for ext in exts for x in (ext, name)))
    return F.try_element_at(of, extension(path))


def counts_by_type(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy(F.coalesce("type", F.lit("unknown")).alias("type")).agg(F.count(F.lit(1)).alias("n"))


def totals(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """One row: node_count, link_count."""
    return nodes.agg(F.count(F.lit(1)).alias("node_count")).join(links.agg(F.count(F.lit(1)).alias("link_count")), F.lit(True))


def language_profile(paths: DataFrame, path_col: str = "id") -> DataFrame:
    """language and n, most frequent first, then by name."""
    return paths.select(language_of(F.col(path_col)).alias("language")).filter("language is not null").groupBy("language").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "language")


def degrees(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """``nodes`` with fan_in and fan_out: numbers of links, duplicates included."""
    into = links.groupBy(F.col("target").alias("id")).agg(F.count(F.lit(1)).alias("fan_in"))
    out = links.groupBy(F.col("source").alias("id")).agg(F.count(F.lit(1)).alias("fan_out"))
    return nodes.join(into, "id", "left").join(out, "id", "left").fillna(0, ["fan_in", "fan_out"])


def edge_type(kind: Column) -> Column:
    """The graph store's edge type of a link type."""
    return F.when(kind == "structure", "contains").when(kind == "import", "imports").when(kind == "adr", "references").otherwise("depends_on")


def graph_edges(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """source_id, target_id and type of links whose two ends exist; duplicates stay."""
    ids = nodes.select("id")
    return (
        links.join(ids.withColumnRenamed("id", "source"), "source", "left_semi")
        .join(ids.withColumnRenamed("id", "target"), "target", "left_semi")
        .select(F.col("source").alias("source_id"), F.col("target").alias("target_id"), edge_type(F.col("type")).alias("type"))
    )


def ordered_edges(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """source_id, target_id and ord of links whose two ends exist: their place in store order decides what a search finds first."""
    ids = nodes.select("id")
    both = links.join(ids.withColumnRenamed("id", "source"), "source", "left_semi").join(ids.withColumnRenamed("id", "target"), "target", "left_semi")
    return both.select(F.col("source").alias("source_id"), F.col("target").alias("target_id"), "ord")


def neighbors(nodes: DataFrame, edges: DataFrame, of: DataFrame, edge_kind: str | None = None) -> DataFrame:
    """origin, id, type, label and edge_type of all nodes one edge away from each id of ``of``, either way, without repeats."""
    some = edges if edge_kind is None else edges.filter(F.col("type") == edge_kind)
    out = some.select(F.col("source_id").alias("origin"), F.col("target_id").alias("id"), F.col("type").alias("edge_type"))
    into = some.select(F.col("target_id").alias("origin"), F.col("source_id").alias("id"), F.col("type").alias("edge_type"))
    near = out.unionByName(into).join(of.select(F.col("id").alias("origin")), "origin", "left_semi").distinct()
    return near.join(nodes.select("id", "type", "label"), "id").select("origin", "id", "type", "label", "edge_type")


def dependencies(links: DataFrame, of: DataFrame) -> DataFrame:
    """origin, direction (out or in), other, type: the links that touch each id of ``of``."""
    ids = of.select(F.col("id").alias("origin"))
    out = links.select(F.col("source").alias("origin"), F.lit("out").alias("direction"), F.col("target").alias("other"), "type")
    into = links.select(F.col("target").alias("origin"), F.lit("in").alias("direction"), F.col("source").alias("other"), "type")
    return out.unionByName(into).join(ids, "origin", "left_semi")


def dependency_nodes(nodes: DataFrame, links: DataFrame, of: DataFrame) -> DataFrame:
    """origin, direction, id, label, type, link_type and ord (the link's) of the nodes at the other ends of ``dependencies``; ends that don't exist are left out, repeats stay."""
    ids = of.select(F.col("id").alias("origin"))
    out = links.select(F.col("source").alias("origin"), F.lit("out").alias("direction"), F.col("target").alias("id"), F.col("type").alias("link_type"), "ord")
    into = links.select(F.col("target").alias("origin"), F.lit("in").alias("direction"), F.col("source").alias("id"), F.col("type").alias("link_type"), "ord")
    near = out.unionByName(into).join(ids, "origin", "left_semi")
    return near.join(nodes.select("id", "label", "type"), "id").select("origin", "direction", "id", "label", "type", "link_type", "ord")


def related_records(nodes: DataFrame, links: DataFrame, of: DataFrame) -> DataFrame:
    """origin and id of the decision records at either end of an adr link that touches an id of ``of`` or starts in its file."""
    ids = of.select(F.col("id").alias("origin")).distinct()
    adr = links.filter("type = 'adr'").select("source", "target")
    by_source = ids.join(adr, ids.origin == adr.source).select("origin", "source", "target")
    by_target = ids.join(adr, ids.origin == adr.target).select("origin", "source", "target")
    by_file = ids.withColumn("file", structural(F.col("origin"))).join(adr.withColumn("file", structural(F.col("source"))), "file").select("origin", "source", "target")
    ends = by_source.unionByName(by_target).unionByName(by_file).select("origin", F.explode(F.array("source", "target")).alias("id"))
    return ends.join(nodes.filter("type = 'adr'").select("id"), "id", "left_semi").select("origin", "id").distinct()


def truncated(nodes: DataFrame, links: DataFrame, most_nodes: int = 1000, most_links: int = 2000) -> DataFrame:
    """The first nodes and links in store order, with whether anything was cut off."""
    flag = totals(nodes, links).select(((F.col("node_count") > most_nodes) | (F.col("link_count") > most_links)).alias("truncated"))
    a = nodes.orderBy("ord", "id").limit(most_nodes).select(F.lit("node").alias("kind"), "id", F.lit(None).cast("string").alias("target"))
    b = links.orderBy("ord", "source", "target").limit(most_links).select(F.lit("link").alias("kind"), F.col("source").alias("id"), "target")
    return a.unionByName(b).join(flag, F.lit(True))


def top_target(nodes: DataFrame, links: DataFrame, rows: int = 1) -> DataFrame:
    """The files with most incoming links; ties by store order."""
    return degrees(nodes.filter("type = 'file'"), links).orderBy(F.desc("fan_in"), "ord", "id").limit(rows).select("id")


def with_directory_parent(nodes: DataFrame, root: str) -> DataFrame:
    """Files and adrs that should have a folder above them (expected) and whether they do (covered)."""
    folders = nodes.filter("type = 'directory'").select(F.col("id").alias("parent_id"), F.lit(True).alias("covered"))
    above = dirname(F.col("id"))
    return nodes.filter(F.col("type").isin("file", "adr") & above.isNotNull() & (above != root)).join(folders, "parent_id", "left").withColumn("covered", F.coalesce("covered", F.lit(False)))
