"""A project's index that is kept from one analysis to the next: facts of files, links, and an inverted table of what links wait for.

A version is what a set of changed and removed files does to these tables (``sources/versions.py``). Only changed files are parsed. Imports by aliases are looked up again where a
configuration changed or a candidate of theirs came or went; links are resolved again where their source changed or an id that they wait for came, went or changed. All else stays
as it was. The result equals a fresh analysis of the same files.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sylvagraph.functions.paths import ancestors
from sylvagraph.lineage import cut
from sylvagraph.operators import build, modules
from sylvagraph.operators.progress import Report, in_steps, reported
from sylvagraph.operators.resolve import LINK, touched_links, waiting, with_found
from sylvagraph.parsing import facts as parsing
from sylvagraph.schema import CodeGraph
from sylvagraph.sources import versions
from sylvagraph.sources.files import deleted, to_parse

FACTS = f"{parsing.SCHEMA}, mtime timestamp, length bigint, config string"
_LINK = "source string, target string, value int, type string, ord bigint"
SCRIPTS = ["javascript", "typescript", "tsx"]
#: A change of a node or link: links have their target too.
CHANGES = "version int, kind string, op string, id string, target string, type string"


def _union(*tables: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, tables)


class ProjectIndex:
    def __init__(self, spark: SparkSession, base: str, root: str):
        self.spark, self.base, self.root = spark, base, root
        table = lambda name, schema, keys: versions.DeltaTable(spark, base, name, schema, keys)
        self.tables = {
            "facts": table("facts", FACTS, ["path"]),
            "tried": table("tried", "path string, specifier string, rank int, candidate string", ["path"]),
            "links": table("links", _LINK, ["source"]),
            "waiting": table("waiting", f"key string, {_LINK}", ["source"]),
            "resolved": table("resolved", f"{_LINK}, found string", LINK),
        }

    def state(self) -> dict:
        found = versions.current(self.spark, self.base)
        return {"version": -1, "batch": -1, **{name: [] for name in self.tables}} if found is None else found[1]

    def _read(self, name: str, state: dict) -> DataFrame:
        return self.tables[name].read(state[name])

    def _put(self, name: str, state: dict, after: dict, rows: DataFrame, keys: DataFrame) -> None:
        after[name] = self.tables[name].write(after["version"], state[name], rows, keys)

    def update(self, files: DataFrame, report: Report | None = None) -> dict:
        """Brings the index in line with all files (path, mtime, length, content) that are there now."""
        known = self._read("facts", self.state()).select("path", "mtime")
        return self.apply(to_parse(files, known), deleted(files, known), report=report)

    def apply(self, changed: DataFrame, gone: DataFrame, batch: int | None = None, report: Report | None = None) -> dict:
        """A new version: ``changed`` files (path, mtime, length, content; folders end in a slash) take the place of their former selves, ``gone`` (path) are left out.

        Returns how many files were parsed and removed and how many links were resolved. A ``batch`` that is in the index already changes nothing. ``report`` hears how parsing goes on.
        """
        before = self.state()
        counts = {"version": before["version"], "parsed": 0, "removed": 0, "resolved": 0}
        if batch is not None and batch <= before["batch"]:
            return counts
        content = F.when(F.col("path").endswith(".json"), F.col("content"))
        total = changed.select("path").count() if report else 0
        dealt, parts = in_steps(changed, total) if report else (changed, 0)
        with reported(changed, total, parts, report):
            fresh = cut(parsing.parsed(dealt.withColumn("config", content), keep=["mtime", "length", "config"]))
        old = self._read("facts", before)
        removed = cut(gone.select("path").distinct().join(fresh.select("path"), "path", "left_anti").join(old.select("path"), "path", "left_semi"))
        touched = _union(fresh.select("path"), removed)
        is_config = F.col("path").endswith(".json")
        of_fresh = fresh.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.bool_or(is_config), F.lit(False)).alias("configs"), F.coalesce(F.bool_or("is_markdown_adr"), F.lit(False)).alias("records")).first()
        of_old = old.join(touched, "path", "left_semi").agg(F.count_if("is_markdown_adr").alias("records")).first()
        of_gone = removed.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.bool_or(is_config), F.lit(False)).alias("configs")).first()
        counts |= {"parsed": of_fresh.n, "removed": of_gone.n}
        if not counts["parsed"] and not counts["removed"]:
            if batch is not None:
                self._commit({**before, "version": before["version"] + 1, "batch": batch}, None)
            return counts
        configured = before.get("configured", False) or of_fresh.configs
        after = {**before, "version": before["version"] + 1, "batch": before["batch"] if batch is None else batch, "configured": configured}
        self._put("facts", before, after, fresh, touched)
        now = self._read("facts", after)
        code = now.filter(~F.col("path").endswith("/"))

        # Imports: all of them where a configuration was touched, else those of changed files; answers where a candidate was touched, too.
        scripts = code if of_fresh.configs or of_gone.configs else fresh.drop("mtime", "length", "config")
        scripts = scripts.filter(F.col("language").isin(SCRIPTS))
        stale = scripts.select("path")
        imports = scripts.select("path", F.explode("imports").alias("i")).select("path", F.col("i.path").alias("specifier"))
        written = now.filter("config is not null").select("path", F.col("config").alias("content"))
        configs = modules.configurations(written) if configured else self.spark.createDataFrame([], modules.CONFIGURATIONS)
        self._put("tried", before, after, modules.tried_modules(imports, configs, self.root), _union(stale, touched))
        tried = self._read("tried", after)
        asking = tried.join(touched.select(F.col("path").alias("candidate")), "candidate", "left_semi").select("path")

        # Links of these files, and of annotated ones where a decision record was touched.
        dirty = _union(fresh.select("path"), stale, asking)
        if of_fresh.records or of_old.records:
            dirty = dirty.unionByName(code.filter("adr is not null").select("path"))
        dirty = cut(dirty.distinct())
        some = code.join(dirty, "path", "left_semi")
        answers = modules.answered(tried.join(dirty, "path", "left_semi"), code)
        fresh_links = cut(build.import_links(some, answers).unionByName(build.adr_links(some, build.decision_records(code))))
        sources = cut(_union(dirty, removed).distinct().withColumnRenamed("path", "source"))
        stale_links = cut(self._read("links", before).join(sources, "source", "left_semi"))
        self._put("links", before, after, fresh_links, sources)
        self._put("waiting", before, after, waiting(fresh_links), sources)

        # Folders that came or went, for links to them.
        folders = [t.select(F.explode(ancestors(F.col("path"), self.root)).alias("key")).distinct() for t in (old, now)]
        keys = _union(touched.select(F.col("path").alias("key")), folders[0].join(folders[1], "key", "left_anti"), folders[1].join(folders[0], "key", "left_anti"))
        again = cut(_union(fresh_links.select(*LINK), touched_links(self._read("waiting", after), keys)).distinct())
        counts["resolved"] = again.count()
        resolved = cut(with_found(self._nodes(now), again))
        self._put("resolved", before, after, resolved, _union(stale_links.select(*LINK), again))
        self._commit(after, self._changes(before, after, old, now, touched, stale_links, again))
        return counts | {"version": after["version"]}

    def _nodes(self, facts: DataFrame, churn: DataFrame | None = None) -> DataFrame:
        code = facts.filter(~F.col("path").endswith("/"))
        return build.directory_nodes(facts.select("path"), self.root).unionByName(build.code_nodes(code, self.root, churn))

    def graph(self, churn: DataFrame | None = None, state: dict | None = None) -> CodeGraph:
        """The graph with resolved links, as of the current version."""
        state = state or self.state()
        links = self._read("resolved", state).withColumn("target", F.col("found")).select(*LINK)
        return CodeGraph(self._nodes(self._read("facts", state), churn), links, self.root)

    def languages(self) -> DataFrame:
        """Files of each language, the commonest first; a language without files isn't there."""
        return self._read("facts", self.state()).filter("language is not null").groupBy("language").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "language")

    # The change feed: what each version added and removed, and how far each reader has read.
    def _changes(self, before: dict, after: dict, old: DataFrame, now: DataFrame, touched: DataFrame, stale: DataFrame, again: DataFrame) -> DataFrame:
        """Nodes of touched files and of folders, and links that were resolved again, that only one of the versions has."""
        none = F.lit(None).cast("string")

        def nodes(facts: DataFrame) -> DataFrame:
            mine = facts.join(touched, "path", "left_semi").filter(~F.col("path").endswith("/"))
            found = build.directory_nodes(facts.select("path"), self.root).unionByName(build.code_nodes(mine, self.root))
            return found.select(F.lit("node").alias("kind"), "id", none.alias("target"), "type")

        def links(state: dict) -> DataFrame:
            some = self._read("resolved", state).join(_union(stale.select(*LINK), again).distinct(), LINK, "left_semi")
            return some.select(F.lit("link").alias("kind"), F.col("source").alias("id"), F.col("found").alias("target"), "type")

        was, is_now = nodes(old).unionByName(links(before)), nodes(now).unionByName(links(after))
        op = lambda rows, name: rows.distinct().withColumn("op", F.lit(name))
        both = op(is_now.exceptAll(was), "added").unionByName(op(was.exceptAll(is_now), "removed"))
        return both.withColumn("version", F.lit(after["version"]))

    def _commit(self, state: dict, changes: DataFrame | None) -> None:
        path = f"{self.base}/changes/at={state['version']}"
        empty = self.spark.createDataFrame([], CHANGES)
        (empty if changes is None else changes.select(*empty.columns)).write.mode("overwrite").parquet(path)
        versions.commit(self.spark, self.base, state["version"], state)

    def changes_of(self, version: int) -> DataFrame:
        return self.spark.read.schema(CHANGES).parquet(f"{self.base}/changes/at={version}")

    def fetch(self, reader: str) -> tuple[CodeGraph | None, DataFrame]:
        """What changed since ``reader`` last asked, and from now on counts as read by it. A new reader gets the whole graph and no changes.

        Changes that undo each other between two calls are both there, in the order of their versions. Readers don't disturb each other.
        """
        state = self.state()
        place = f"{self.base}/readers/{reader}"
        last = versions.current(self.spark, place)
        seen = last[1]["version"] if last else None
        if last is None or seen < state["version"]:
            versions.commit(self.spark, place, last[0] + 1 if last else 0, {"version": state["version"]})
        empty = self.spark.createDataFrame([], CHANGES)
        if seen is None:
            return self.graph(state=state), empty
        paths = [f"{self.base}/changes/at={v}" for v in range(seen + 1, state["version"] + 1)]
        return None, self.spark.read.schema(CHANGES).parquet(*paths) if paths else empty


def analyze(spark: SparkSession, root: str, base: str, churn: DataFrame | None = None, report: Report | None = None) -> tuple[CodeGraph, dict]:
    """The graph of a project, of which only files that changed since the last analysis into ``base`` are parsed, and what was done."""
    from sylvagraph.sources.files import discover

    files = discover(spark, root)
    if files.isEmpty():
        raise ValueError(f"no source files under {root}")
    index = ProjectIndex(spark, base, root)
    done = index.update(files, report)
    return index.graph(churn), done
