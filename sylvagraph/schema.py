"""Schemas of the engine's tables. ``ord`` is a row's place in store order and decides every first-match rule."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import types as T

EXPORT = T.StructType([T.StructField("exported_name", T.StringType()), T.StructField("local_name", T.StringType()), T.StructField("is_default", T.BooleanType())])

NODES = T.StructType([
    T.StructField("id", T.StringType()), T.StructField("label", T.StringType()), T.StructField("group", T.IntegerType()), T.StructField("type", T.StringType()),
    T.StructField("churn", T.LongType()), T.StructField("adr", T.StringType()), T.StructField("parent_id", T.StringType()),
    T.StructField("exports", T.ArrayType(EXPORT)), T.StructField("ord", T.LongType()),
])

LINKS = T.StructType([
    T.StructField("source", T.StringType()), T.StructField("target", T.StringType()), T.StructField("value", T.IntegerType()),
    T.StructField("type", T.StringType()), T.StructField("ord", T.LongType()),
])

FILES = T.StructType([T.StructField("path", T.StringType()), T.StructField("mtime", T.TimestampType()), T.StructField("length", T.LongType()), T.StructField("content", T.StringType())])
COMMITS = "hash string, author string, ts timestamp, file_path string, additions bigint, deletions bigint"
CHANGED = "path string, status string, additions bigint, deletions bigint"
FILE_EVENTS = "seq bigint, op string, path string, ts timestamp, content string"


@dataclass(frozen=True)
class CodeGraph:
    """A property graph: nodes, links (a multiset) and the project's root, which is no node itself."""

    nodes: DataFrame
    links: DataFrame
    root: str

    def persisted(self) -> CodeGraph:
        """Kept for the several analyses of one version."""
        return CodeGraph(self.nodes.persist(), self.links.persist(), self.root)

    def released(self) -> None:
        self.nodes.unpersist()
        self.links.unpersist()
