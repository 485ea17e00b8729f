"""Short Markdown notes about nodes for assistants that work on the code."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sylvagraph.functions.texts import slug
from sylvagraph.lineage import cut
from sylvagraph.operators.traverse import pattern_hints


def project_files(nodes: DataFrame, most: int = 10) -> DataFrame:
    """The first files in store order outside of packages and hidden folders."""
    return nodes.filter((F.col("type") == "file") & ~F.col("id").contains("/node_modules/") & ~F.col("id").contains("/.")).orderBy("ord", "id").limit(most)


#: What a reader of a note may call and read.
TOOLS = ["analyze_project", "get_graph_context", "get_node_dependencies", "get_blast_radius"]
RESOURCES = ["project/summary", "graph/full", "agent/project-brain"]


def edges_around(edges: DataFrame, asked: DataFrame) -> DataFrame:
    """The edges both of whose ends are ``asked`` nodes (id) or neighbours of one: they hold all neighbours of each of these, and all cycles of up to three steps through it."""
    ids = cut(asked.select("id").distinct())
    one_end = lambda c, other: edges.join(ids.withColumnRenamed("id", c), c, "left_semi").select(F.col(other).alias("id"))
    near = cut(ids.unionByName(one_end("source_id", "target_id")).unionByName(one_end("target_id", "source_id")).distinct())
    return edges.join(near.withColumnRenamed("id", "source_id"), "source_id", "left_semi").join(near.withColumnRenamed("id", "target_id"), "target_id", "left_semi")


def skills(nodes: DataFrame, edges: DataFrame, asked: DataFrame) -> DataFrame:
    """node_id, name, description, file_name, hints, text and ord of a note on each of the ``asked`` nodes (id). Only the edges among these and their neighbours are searched for hints."""
    hints = pattern_hints(nodes.join(asked.select("id").distinct(), "id", "left_semi"), edges_around(edges, asked)).join(asked.select("id").distinct(), "id", "left_semi")
    rows = nodes.select("id", "label", "type", "ord").join(hints, "id")
    found = F.array_compact(F.array(F.when(F.col("in_cycle"), "circular dependency"), F.when(F.col("crowded"), "many neighbours: consider a split")))
    name, description = F.concat(F.lit("context-"), slug(F.col("label"))), F.concat(F.lit("Context of "), F.col("label"), F.lit(" ("), F.col("type"), F.lit(")"))
    noted = rows.select(F.col("id").alias("node_id"), name.alias("name"), description.alias("description"), F.concat(slug(F.col("label")), F.lit("-context.md")).alias("file_name"), found.alias("hints"), "label", "ord")
    return noted.withColumn("text", _text()).drop("label")


def _list(items: Column) -> Column:
    return F.when(F.size(items) > 0, F.array_join(F.transform(items, lambda x: F.concat(F.lit("- "), x)), "\n")).otherwise("- none")


def _text() -> Column:
    fixed = lambda xs: F.lit("\n".join(f"- {x}" for x in xs))
    return F.concat(
        F.lit("# "), F.col("label"), F.lit("\n\nName: "), F.col("name"), F.lit("\n\n"), F.col("description"), F.lit(".\n\n- Node: "), F.col("node_id"),
        F.lit("\n\n## Tools\n"), fixed(TOOLS), F.lit("\n\n## Resources\n"), fixed(RESOURCES), F.lit("\n\n## Hints\n"), _list(F.col("hints")), F.lit("\n"),
    )


def write_skills(found: DataFrame, path: str) -> None:
    """One folder a note, each with one text file. Of notes with one file name the last in store order stays."""
    last = found.groupBy("file_name").agg(F.max_by("text", F.struct("ord", "node_id")).alias("text"))
    last.write.mode("overwrite").partitionBy("file_name").option("lineSep", "\n\n").text(path)
