"""What a project is made of, and campaigns of change over it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sylvagraph.functions.paths import structural
from sylvagraph.lineage import cut
from sylvagraph.operators import architecture, search

# Fixed values.
ENTRY_POINT = r"(?:^|/)(main|app|server|cli|index|preload|worker|mcp|oracle)\.(?:ts|tsx|js|jsx)\z"
TECHNOLOGIES = [(r"\.tsx?\z", "TypeScript"), (r"\.jsx?\z", "JavaScript"), (r"\.json\z", "JSON"), (r"\.css\z", "CSS"), (r"\.md\z", "Markdown")]
LAYER_BONUS = {"integration": 20, "application": 16, "presentation": 12}
WAVES = {"wave-foundation": ["shared", "state", "configuration"], "wave-core": ["application", "analysis", "parsing"], "wave-edge": ["integration", "presentation"]}
TOP = 8


def technologies(nodes: DataFrame, most: int = 5) -> DataFrame:
    """name and n of the commonest kinds of files."""
    path = F.lower(structural(F.col("id")))
    name = F.lit("Other")
    for pattern, label in reversed(TECHNOLOGIES):
        name = F.when(path.rlike(pattern), label).otherwise(name)
    return nodes.filter(F.col("type").isin("file", "adr")).groupBy(name.alias("name")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "name").limit(most)


def _files(with_degrees: DataFrame, classified: DataFrame) -> DataFrame:
    return with_degrees.filter("type = 'file'").join(classified.select("id", "layer"), "id")


def entry_points(with_degrees: DataFrame, classified: DataFrame, most: int = TOP) -> DataFrame:
    """id, label, score of files that start things: named like it, or unused integration."""
    named = F.lower("id").rlike(ENTRY_POINT)
    score = F.col("fan_out") * 3 - F.col("fan_in") + F.when(named, 25).otherwise(0)
    for layer, bonus in LAYER_BONUS.items():
        score = score + F.when(F.col("layer") == layer, bonus).otherwise(0)
    some = _files(with_degrees, classified).filter((F.col("layer") != "configuration") & (named | ((F.col("layer") == "integration") & (F.col("fan_in") == 0))))
    return some.select("id", "label", score.cast("bigint").alias("score")).orderBy(F.desc("score"), "label", "id").limit(most)


def orchestrators(with_degrees: DataFrame, classified: DataFrame, most: int = TOP) -> DataFrame:
    """id, label, links of the busiest files of application, analysis and integration."""
    total = F.col("fan_in") + F.col("fan_out")
    some = _files(with_degrees, classified).filter(F.col("layer").isin("application", "analysis", "integration") & (total > 0))
    return some.select("id", "label", total.cast("bigint").alias("links")).orderBy(F.desc("links"), "label", "id").limit(most)


def foundations(with_degrees: DataFrame, classified: DataFrame, most: int = TOP) -> DataFrame:
    """id, label, fan_in of the most used files of shared and state."""
    some = _files(with_degrees, classified).filter(F.col("layer").isin("shared", "state") & (F.col("fan_in") > 0))
    return some.select("id", "label", F.col("fan_in").cast("bigint").alias("fan_in")).orderBy(F.desc("fan_in"), "label", "id").limit(most)


def key_boundaries(edges: DataFrame, most: int = 6) -> DataFrame:
    return architecture.dependencies(edges.filter("source_layer != target_layer")).limit(most)


def maturity(score: Column, violations: Column, findings: Column) -> Column:
    return F.when((score >= 90) & (violations == 0) & (findings == 0), "strong").when((score >= 75) & (violations <= 5), "fair").otherwise("weak")


def campaign_seeds(nodes: DataFrame, classified: DataFrame, queries: DataFrame, explicit: list[str] | None = None, most: int = 10) -> DataFrame:
    """id, label, type and place of the nodes to start from: those named, then the best matches, else the first of the central layers."""
    order = ["source_rank", "r", "ord", "id"]
    named = nodes.filter(F.col("id").isin(explicit or [])).select("id", "label", "type", F.lit(0).alias("source_rank"), F.lit(0).alias("r"), "ord")
    scored = search.best_scores(nodes.filter(F.col("type").isin(["file", "class", "function"])), queries, "campaign")
    top = scored.orderBy(F.desc("score"), F.desc(search.type_priority(F.col("type"), search.CAMPAIGN_PRIORITY, 1)), "label", "id").limit(most * 3)
    found = top.select("id", "label", "type", F.lit(1).alias("source_rank"), (-F.col("score")).alias("r"), F.lit(0).cast("bigint").alias("ord"))
    both = cut(named.unionByName(found.join(named.select("id"), "id", "left_anti")))  # at most those named and three times ``most``
    if not both.isEmpty():
        return both.orderBy(*order).limit(most).select("id", "label", "type")
    central = classified.filter(F.col("layer").isin("application", "integration", "analysis")).join(nodes.select("id", "label"), "id").orderBy("ord", "id").limit(most)
    other = central.select("id", "label", "type", F.lit(2).alias("source_rank"), F.lit(0).alias("r"), "ord")
    return other.orderBy(*order).limit(most).select("id", "label", "type")


def matched_files(nodes: DataFrame, seeds: DataFrame, queries: DataFrame, most: int) -> DataFrame:
    """id and start (their order) of the files that a campaign sets out from: those of the seeds (id, place), else the first in store order that a query fits."""
    files = nodes.filter("type = 'file'")
    own = seeds.select(structural(F.col("id")).alias("id"), "place").groupBy("id").agg(F.min("place").cast("bigint").alias("start")).join(files.select("id"), "id", "left_semi")
    fitting = search.best_scores(files, queries, "campaign").filter("score > 0").select("id").join(files.select("id", F.col("ord").alias("start")), "id").orderBy("start", "id").limit(most)
    none = own.agg(F.count(F.lit(1)).alias("some"))
    other = fitting.withColumn("some", none.scalar()).filter("some = 0").drop("some")
    return own.orderBy("start").limit(most).unionByName(other)


def wave(layer: Column) -> Column:
    found = F.lit("wave-core")
    for name, layers in WAVES.items():
        found = F.when(layer.isin(layers), name).otherwise(found)
    return found


def execution_waves(affected: DataFrame, classified: DataFrame, most: int = 15) -> DataFrame:
    """wave, layer and id of the affected files (id, depth: bounded by their own limit), the first few of each wave. A core wave with other layers is mixed."""
    rows = affected.join(classified.select("id", "layer", "ord"), "id", "left").withColumn("wave", wave(F.coalesce("layer", F.lit("unknown")))).withColumn("odd", ~F.coalesce(F.col("layer").isin([x for xs in WAVES.values() for x in xs]), F.lit(False)))
    kinds = rows.groupBy("wave").agg(F.bool_or("odd").alias("odd"))
    first = F.lit(None)
    for name, layers in WAVES.items():
        first = F.when(F.col("wave") == name, layers[0]).otherwise(first)
    kept = architecture.first_rows(rows.drop("odd"), ["wave"], ["depth", "ord", "id"], most)
    return kept.join(kinds, "wave").select("wave", F.when(F.col("odd"), "mixed").otherwise(first).alias("layer"), "id")


def layers_involved(affected: DataFrame, classified: DataFrame) -> DataFrame:
    return affected.join(classified.select("id", "layer"), "id", "left").groupBy(F.coalesce("layer", F.lit("unknown")).alias("layer")).agg(F.count(F.lit(1)).alias("n"))


def breadth(files: int) -> str:
    return "large" if files >= 20 else "medium" if files >= 8 else "small"


def recent_projects(opened: DataFrame, most: int = 10) -> DataFrame:
    """path, name and last_opened of the latest opening of each project, latest first. ``opened``: path, name, ts."""
    path = F.replace("path", F.lit("\\"), F.lit("/"))
    last = opened.groupBy(path.alias("path")).agg(F.max(F.struct("ts", "name")).alias("last"))
    return last.select("path", F.col("last.name").alias("name"), F.col("last.ts").alias("last_opened")).orderBy(F.desc("last_opened"), "path").limit(most)


def rename_preview(nodes: DataFrame, edges: DataFrame, old: str) -> DataFrame:
    """kind (node or edge) and text of what renaming a file or folder touches."""
    some = nodes.filter((structural(F.col("id")) == old) | F.col("id").startswith(f"{old}/")).select("id")
    ends = edges.join(some.withColumnRenamed("id", "source_id"), "source_id", "left_semi").unionByName(edges.join(some.withColumnRenamed("id", "target_id"), "target_id", "left_semi").select(*edges.columns)).distinct()
    return some.select(F.lit("node").alias("kind"), F.col("id").alias("text")).unionByName(ends.select(F.lit("edge").alias("kind"), F.concat("source_id", F.lit(" -> "), "target_id").alias("text")))


def renamed(nodes: DataFrame, old: str, new: str) -> DataFrame:
    """``nodes`` with ids and parents moved from one path to another."""
    def moved(c: Column) -> Column:
        here = (c == old) | c.startswith(f"{old}/") | c.startswith(f"{old}#")
        return F.when(here, F.concat(F.lit(new), F.substring(c, len(old) + 1, 1 << 30))).otherwise(c)

    return nodes.withColumn("id", moved(F.col("id"))).withColumn("parent_id", moved(F.col("parent_id")))


def version_diff(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """op (added or removed) and the keys of rows that only one version has."""
    gone, come = old.select(*keys).distinct(), new.select(*keys).distinct()
    return come.join(gone, keys, "left_anti").withColumn("op", F.lit("added")).unionByName(gone.join(come, keys, "left_anti").withColumn("op", F.lit("removed")))
