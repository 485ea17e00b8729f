"""Exports of a graph: JSON, Markdown, DOT and a placeholder SVG. Rows are formatted in Spark and written by it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def quoted(column: str) -> Column:
    """Inside double quotes of DOT."""
    return F.replace(F.replace(F.coalesce(column, F.lit("")), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))


def dot_lines(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One line a node and one an edge, without the surrounding braces."""
    a = nodes.select(F.concat(F.lit('  "'), quoted("id"), F.lit('" [label="'), quoted("label"), F.lit('"];')).alias("line"))
    b = edges.select(F.concat(F.lit('  "'), quoted("source_id"), F.lit('" -> "'), quoted("target_id"), F.lit('" [label="'), quoted("type"), F.lit('"];')).alias("line"))
    return a.unionByName(b)


def json_lines(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    a = nodes.select(F.to_json(F.struct(F.lit("node").alias("kind"), "id", "type", "label", F.col("id").alias("filePath"))).alias("line"))
    return a.unionByName(edges.select(F.to_json(F.struct(F.lit("edge").alias("kind"), "type", "source_id", "target_id")).alias("line")))


def markdown_lines(nodes: DataFrame) -> DataFrame:
    cell = lambda c: F.replace(F.coalesce(F.col(c), F.lit("")), F.lit("|"), F.lit("\\|"))
    return nodes.select(F.concat(F.lit("| "), cell("label"), F.lit(" | "), cell("type"), F.lit(" | "), cell("id"), F.lit(" |")).alias("line"))


HEADS = {"dot": ["digraph code {"], "markdown": ["| Name | Type | Path |", "| --- | --- | --- |"], "json": [], "svg": []}
TAILS = {"dot": ["}"], "markdown": [], "json": [], "svg": []}


def export(kind: str, nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """Writes text files under ``path``; ``head`` and ``tail`` hold what stands around the rows."""
    if kind not in HEADS:
        raise ValueError(f"unsupported format {kind!r}")
    spark = nodes.sparkSession
    if kind == "svg":
        text = '<svg xmlns="http://www.w3.org/2000/svg" width="400" height="60"><text x="10" y="30">See the DOT export</text></svg>'
        spark.createDataFrame([(text,)], "line string").write.mode("overwrite").text(f"{path}/svg")
        kind = "dot"
    rows = {"dot": dot_lines, "json": json_lines, "markdown": lambda n, e: markdown_lines(n)}[kind](nodes, edges)
    rows.write.mode("overwrite").text(f"{path}/rows")
    for part, lines in (("head", HEADS[kind]), ("tail", TAILS[kind])):
        spark.createDataFrame([(x,) for x in lines], "line string").coalesce(1).write.mode("overwrite").text(f"{path}/{part}")


def save_tables(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """A full refresh of the stored graph."""
    nodes.write.mode("overwrite").parquet(f"{path}/nodes")
    edges.write.mode("overwrite").parquet(f"{path}/edges")
