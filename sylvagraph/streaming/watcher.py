"""File events as a stream: each batch becomes a new version of the project's index, from which the graph follows.

Events (seq, op, path, ts, content) are rows of an event table, since a file source shows neither changes nor deletions. A folder that was added is a row whose path ends in a
slash. Folders without such a row are there as long as a file is in them. Give ``watch`` a ``processingTime`` to gather bursts of events.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sylvagraph.lineage import cut
from sylvagraph.operators.build import raw_graph, script_modules
from sylvagraph.operators.index import ProjectIndex
from sylvagraph.operators.resolve import resolve_links
from sylvagraph.parsing.facts import parsed
from sylvagraph.schema import CodeGraph
from sylvagraph.sources.files import MOST_BYTES, is_ignored_event

GONE = ["unlink", "unlinkDir"]
FILES = "path string, mtime timestamp, length bigint, content string"


def applied(files: DataFrame, events: DataFrame) -> DataFrame:
    """``files`` after the last event of each path. Additions and changes in ignored folders don't count; deletions always do."""
    last = Window.partitionBy("path").orderBy(F.desc("seq"))
    events = events.withColumn("path", F.when(F.col("op").isin("addDir", "unlinkDir"), F.concat("path", F.lit("/"))).otherwise(F.col("path")))
    counted = events.filter(F.col("op").isin(GONE) | (F.col("op").isin("add", "change", "addDir") & ~is_ignored_event(F.col("path"))))
    latest = counted.withColumn("n", F.row_number().over(last)).filter("n = 1")
    kept = files.join(latest.select("path"), "path", "left_anti")
    # As discovery does: a file above the size limit has no content.
    size = F.coalesce(F.octet_length("content"), F.lit(0)).cast("bigint")
    return kept.unionByName(latest.filter(~F.col("op").isin(GONE)).select("path", F.col("ts").alias("mtime"), size.alias("length"), F.when(size <= MOST_BYTES, F.col("content")).alias("content")))


def graph_of(files: DataFrame, root: str) -> CodeGraph:
    folders, files = files.filter(F.col("path").endswith("/")), files.filter(~F.col("path").endswith("/"))
    facts = cut(parsed(files))
    raw = raw_graph(facts, root, modules=script_modules(facts, files, root), folders=folders)
    return CodeGraph(raw.nodes, resolve_links(raw.nodes, raw.links), root)


def latest(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The files (FILES) that a batch's last event of each path leaves there, and the paths (path) that it takes away; folders end in a slash."""
    none = events.sparkSession.createDataFrame([], FILES)
    gone = events.filter(F.col("op").isin(GONE)).select(F.when(F.col("op") == "unlinkDir", F.concat("path", F.lit("/"))).otherwise(F.col("path")).alias("path")).distinct()
    there = applied(none, events)
    return there, gone.join(there, "path", "left_anti")


def watch(events: DataFrame, base: str, checkpoint: str, root: str, publish: Callable[[CodeGraph, DataFrame, int], None] | None = None, **trigger) -> StreamingQuery:
    """Starts a query over streamed events that keeps a project's index (``operators/index.py``) in ``base``. Only files of a batch are parsed, only links that wait for them resolved again.

    ``publish`` gets the new graph, the batch's changes (kind, op, id, target, type) and its number. A batch that comes again changes nothing, but is published again.
    """
    index = ProjectIndex(events.sparkSession, base, root)

    def batch(rows: DataFrame, number: int) -> None:
        rows.persist()
        try:
            index.apply(*latest(rows), batch=number)
        finally:
            rows.unpersist()
        if publish is not None:
            publish(index.graph(), index.changes_of(index.state()["version"]), number)

    return events.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def language_counts(events: DataFrame) -> DataFrame:
    """A streamed profile of languages: additions less deletions."""
    from sylvagraph.operators.stats import language_of

    change = F.when(F.col("op") == "add", 1).when(F.col("op") == "unlink", -1).otherwise(0)
    return events.select(language_of(F.col("path")).alias("language"), change.alias("change")).filter("language is not null").groupBy("language").agg(F.sum("change").alias("n")).filter("n > 0")
