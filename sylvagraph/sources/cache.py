"""Snapshots of analysed projects: saved, loaded, restored and brought in line with the files that are there now."""

from __future__ import annotations

from hashlib import md5

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sylvagraph.functions.paths import dirname, normalized, structural
from sylvagraph.operators.build import directory_nodes, without_files
from sylvagraph.schema import LINKS, NODES, CodeGraph
from sylvagraph.sources import versions

#: Fixed value: the version of snapshots; others aren't read.
VERSION = "v9"


def snapshot_path(base: str, root: str) -> str:
    return f"{base}/{md5(root.encode()).hexdigest()}_{VERSION}"


def save(graph: CodeGraph, files: DataFrame, base: str) -> str:
    """Writes stats (path, mtime) of files that are nodes and still there, all nodes, and unresolved links, as a new version. Returns its folder.

    What an earlier version wrote stays until ``versions.forget``, so a graph that was loaded from it can be saved again.
    """
    spark, path = graph.nodes.sparkSession, snapshot_path(base, graph.root)
    last = versions.current(spark, path)
    version = last[0] + 1 if last else 0
    folder = f"{path}/version={version}"
    known = graph.nodes.filter("type = 'file'").select(F.col("id").alias("path"))
    files.select("path", "mtime").join(known, "path", "left_semi").write.mode("overwrite").parquet(f"{folder}/stats")
    graph.nodes.write.mode("overwrite").parquet(f"{folder}/nodes")
    graph.links.write.mode("overwrite").parquet(f"{folder}/links")
    versions.commit(spark, path, version, {"root": graph.root})
    return folder


def load(spark: SparkSession, base: str, root: str) -> tuple[CodeGraph, DataFrame] | None:
    """The graph as saved last and its stats; None without a snapshot of this kind."""
    path = snapshot_path(base, root)
    last = versions.current(spark, path)
    if last is None:
        return None
    nodes, links, stats = (spark.read.schema(schema).parquet(f"{path}/version={last[0]}/{name}") for name, schema in (("nodes", NODES), ("links", LINKS), ("stats", "path string, mtime timestamp")))
    return CodeGraph(nodes, links, root), stats


def restored(graph: CodeGraph) -> CodeGraph:
    """Slashes instead of backslashes, and parents by type: a symbol's is its file, a folder's, file's or decision record's its folder below the root."""
    node_id, root = normalized(F.col("id")), normalized(F.lit(graph.root))
    folder = dirname(node_id)
    parent = (
        F.when(F.col("type").isin("directory", "file", "adr"), F.when(folder != root, folder))
        .when(F.col("type").isin("class", "function"), structural(node_id))
        .otherwise(normalized(F.col("parent_id")))
    )
    nodes = graph.nodes.withColumn("parent_id", parent).withColumn("id", node_id)
    links = graph.links.withColumn("source", normalized(F.col("source"))).withColumn("target", normalized(F.col("target")))
    return CodeGraph(nodes, links, graph.root)


def purged(graph: CodeGraph, stats: DataFrame, files: DataFrame) -> CodeGraph:
    """Without the saved files that are gone."""
    return without_files(graph, stats.select("path").join(files.select("path"), "path", "left_anti"))


def with_directories(graph: CodeGraph) -> CodeGraph:
    """With the folders of its files and decision records, and no others."""
    kept = graph.nodes.filter("type != 'directory'")
    found = directory_nodes(kept.filter("type in ('file', 'adr')").select(F.col("id").alias("path")), graph.root)
    return CodeGraph(kept.unionByName(found.select(*kept.columns)), graph.links, graph.root)


def without_directory(graph: CodeGraph, folder: str) -> CodeGraph:
    """Without a folder's node and its links; what is in it stays."""
    nodes = graph.nodes.filter(~((F.col("id") == folder) & (F.col("type") == "directory")))
    return CodeGraph(nodes, graph.links.filter((F.col("source") != folder) & (F.col("target") != folder)), graph.root)
