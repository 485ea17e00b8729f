"""The graph of a source tree from the facts of its files, and changes to it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sylvagraph.functions.paths import ancestors, basename, dirname, structural
from sylvagraph.lineage import cut
from sylvagraph.operators.holding import first_holding
from sylvagraph.operators.resolve import resolve_links
from sylvagraph.schema import CodeGraph

#: Files are this far apart in store order.
STEP = 1_000_000


def is_local(specifier: Column) -> Column:
    return specifier.rlike(r"^(\.|/|[A-Za-z]:[\\/])")


def joined(folder: Column, specifier: Column) -> Column:
    """``specifier`` seen from ``folder``, with . and .. taken out."""
    parts = F.split(F.when(specifier.startswith("/"), specifier).otherwise(F.concat(folder, F.lit("/"), specifier)), "/")
    kept = F.aggregate(parts, F.array().cast("array<string>"), lambda a, p: F.when((p == "") | (p == "."), a).when(p == "..", F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(F.array_append(a, p)))
    return F.concat(F.lit("/"), F.array_join(kept, "/"))


def order_of(path: Column) -> Column:
    """A fixed store order without a global sort."""
    return F.conv(F.substring(F.md5(path.cast("binary")), 1, 10), 16, 10).cast("bigint") * STEP


def directory_nodes(paths: DataFrame, root: str) -> DataFrame:
    ids = paths.select(F.explode(ancestors(F.col("path"), root)).alias("id")).distinct()
    parent = F.when(dirname(F.col("id")) != root, dirname(F.col("id")))
    return _nodes(ids, basename(F.col("id")), 0, F.lit("directory"), F.lit(0), F.lit(None), parent, F.lit(None), -order_of(F.col("id")) - 1)


def _nodes(df: DataFrame, label: Column, group: int | Column, kind: Column, churn: Column, adr: Column, parent: Column, exports: Column, order: Column) -> DataFrame:
    group = F.lit(group) if isinstance(group, int) else group
    return df.select("id", label.alias("label"), group.cast("int").alias("group"), kind.alias("type"), churn.cast("bigint").alias("churn"), adr.cast("string").alias("adr"), parent.cast("string").alias("parent_id"), exports.cast("array<struct<exported_name:string,local_name:string,is_default:boolean>>").alias("exports"), order.cast("bigint").alias("ord"))


def code_nodes(facts: DataFrame, root: str, churn: DataFrame | None = None) -> DataFrame:
    """The nodes of parsed files and of their symbols. A file's symbols of one name are one node, a function or class by which came last."""
    counts = churn.select("path", "n") if churn is not None else facts.sparkSession.createDataFrame([], "path string, n bigint")
    files = facts.join(counts, "path", "left").withColumn("churn", F.when(F.coalesce("n", F.lit(0)) == 0, 1).otherwise(F.col("n"))).withColumn("ord", order_of(F.col("path"))).withColumn("id", F.col("path"))
    parent = F.when(dirname(F.col("path")) != root, dirname(F.col("path")))
    is_adr = F.col("is_markdown_adr")
    label = F.when(is_adr, F.concat(F.lit("ADR: "), "adr")).otherwise(basename(F.col("path")))
    file_nodes = _nodes(files, label, F.when(is_adr, 4).otherwise(1), F.when(is_adr, "adr").otherwise("file"), F.col("churn"), F.when(is_adr, F.col("path")).otherwise(F.col("adr")), parent, F.col("exports"), F.col("ord"))
    each = files.filter(~is_adr).select("path", "churn", "ord", F.posexplode("entities").alias("at", "e"))
    last = each.groupBy("path", "churn", "ord", F.col("e.name").alias("name")).agg(F.max_by("e.type", "at").alias("kind"), F.min("at").alias("at"))
    symbols = _nodes(last.withColumn("id", F.concat("path", F.lit("#"), "name")), F.col("name"), F.when(F.col("kind") == "class", 2).otherwise(3), F.col("kind"), F.col("churn"), F.lit(None), F.col("path"), F.lit(None), F.col("ord") + F.col("at") + 1)
    return file_nodes.unionByName(symbols)


def import_links(facts: DataFrame, modules: DataFrame | None = None) -> DataFrame:
    """``modules``: path, specifier and resolved of imports whose file is known; others count if they are local."""
    code = facts.filter(~F.col("is_markdown_adr")).withColumn("ord", order_of(F.col("path")))
    imports = code.select("path", "ord", F.posexplode("imports").alias("at", "i")).withColumn("specifier", F.col("i.path"))
    known = modules if modules is not None else facts.sparkSession.createDataFrame([], "path string, specifier string, resolved string")
    imports = imports.join(known.select("path", "specifier", "resolved"), ["path", "specifier"], "left").filter(F.col("resolved").isNotNull() | is_local(F.col("specifier")))
    target = F.coalesce("resolved", joined(dirname(F.col("path")), F.col("specifier")))
    names = F.when(F.size("i.imported_entities") > 0, F.col("i.imported_entities")).otherwise(F.array(F.lit("*")))
    named = imports.select("path", "ord", "at", target.alias("file"), F.posexplode(names).alias("k", "name"))
    whole = F.col("name") == "*"
    return named.select(F.col("path").alias("source"), F.when(whole, F.col("file")).otherwise(F.concat("file", F.lit("#"), "name")).alias("target"), F.when(whole, 1).otherwise(2).alias("value"), F.lit("import").alias("type"), (F.col("ord") + F.col("at") * 1000 + F.col("k")).alias("ord"))


def decision_records(facts: DataFrame) -> DataFrame:
    """id and ord of the decision records among parsed files."""
    return facts.filter("is_markdown_adr").select(F.col("path").alias("id"), order_of(F.col("path")).alias("ord"))


def adr_links(facts: DataFrame, records: DataFrame) -> DataFrame:
    """From each annotated file to the first decision record whose id holds its annotation, whatever the case."""
    marked = facts.filter(~F.col("is_markdown_adr") & F.col("adr").isNotNull()).select("path", F.lower("adr").alias("needle"))
    hits = first_holding(marked.select("needle"), records.select("ord", "id", F.lower("id").alias("text")))
    return marked.join(hits, "needle").select(F.col("path").alias("source"), F.col("id").alias("target"), F.lit(3).alias("value"), F.lit("adr").alias("type"), (order_of(F.col("path")) + STEP - 1).alias("ord"))


def raw_graph(facts: DataFrame, root: str, churn: DataFrame | None = None, modules: DataFrame | None = None, folders: DataFrame | None = None) -> CodeGraph:
    """Nodes and unresolved links of parsed files. ``churn``: path and n; files without one, or with zero, count once.
    ``modules``: as for ``import_links``. ``folders``: path (with a slash at the end) of folders that are nodes even without files.
    """
    below = facts.select("path") if folders is None else facts.select("path").unionByName(folders.select("path"))
    nodes = directory_nodes(below, root).unionByName(code_nodes(facts, root, churn))
    return CodeGraph(nodes, import_links(facts, modules).unionByName(adr_links(facts, decision_records(facts))), root)


def script_modules(facts: DataFrame, files: DataFrame, root: str) -> DataFrame:
    """path, specifier and resolved of what scripts import, by the configurations among ``files`` (path, content)."""
    from sylvagraph.operators.modules import configurations, resolved_modules

    scripts = facts.filter(F.col("language").isin("javascript", "typescript", "tsx"))
    imports = scripts.select("path", F.explode("imports").alias("i")).select("path", F.col("i.path").alias("specifier"))
    return resolved_modules(imports, files, configurations(files), root)


def analyze(spark: SparkSession, root: str, churn: DataFrame | None = None) -> CodeGraph:
    """Discovers, parses, builds and resolves a project. Files are parsed once."""
    from sylvagraph.parsing.facts import parsed
    from sylvagraph.sources.files import discover

    files = discover(spark, root)
    if files.isEmpty():
        raise ValueError(f"no source files under {root}")
    facts = cut(parsed(files))
    raw = raw_graph(facts, root, churn, script_modules(facts, files, root))
    return CodeGraph(raw.nodes, resolve_links(raw.nodes, raw.links), root)


def without_files(graph: CodeGraph, paths: DataFrame) -> CodeGraph:
    """Without files (path), their symbols and the links from them or to them; links to their symbols stay unresolved."""
    gone = paths.select(F.col("path").alias("gone")).distinct()
    nodes = graph.nodes.join(gone, structural(F.col("id")) == gone.gone, "left_anti")
    links = graph.links.join(gone, structural(F.col("source")) == gone.gone, "left_anti").join(gone, F.col("target") == gone.gone, "left_anti")
    return CodeGraph(nodes, links, graph.root)
