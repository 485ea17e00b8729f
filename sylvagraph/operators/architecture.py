"""Layers by ordered rules, dependencies between layers and their violations."""

from __future__ import annotations

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sylvagraph.functions.paths import normalized, structural

# The rules in the order in which they are asked: pattern, layer, reason. All are asked without regard to case.
RULES = [
    (r"\.(json|ya?ml|md|env.*|config\.[jt]s|rc)\z", "configuration", "config_or_doc_file"),
    (r"(^/|\\|/)(scripts|\.github|\.husky)/", "configuration", "automation_scripts"),
    (r"(^/|\\|/)(test|__tests__|spec)/", "configuration", "test_or_support_path"),
    (r"(^/|\\|/)(components|views|pages|ui|screens|layouts|hooks|i18n|locales)/", "presentation", "ui_layer"),
    (r"(^/|\\|/)(assets|public|static)/", "presentation", "static_assets"),
    (r"\.(css|scss|sass|less|styl)\z", "presentation", "stylesheet_path"),
    (r"(^/|\\|/)(store|state|reducers|actions|context)/", "state", "state_management"),
    (r"(^/|\\|/)(services|usecases|application|features|controllers)/", "application", "application_logic"),
    (r"(^/|\\|/)(domain|models|entities|core)/", "domain", "domain_logic"),
    (r"(^/|\\|/)(infrastructure|db|database|api|clients|repositories|integration|bin)/", "integration", "infrastructure_integration"),
    (r"(^/|\\|/)(electron|main|preload|mcp)\.ts\z", "integration", "entrypoint_or_adapter_path"),
    (r"(^/|\\|/)(utils|shared|helpers|common|types|interfaces)/", "shared", "shared_utilities"),
    (r"\.d\.ts\z", "shared", "type_declaration_path"),
    (r"(^/|\\|/)(analysis)/", "analysis", "analysis_path"),
    (r"(^/|\\|/)(parsing)/", "parsing", "parsing_path"),
    (r"(^/|\\|/)(oracle)/", "application", "orchestration_path"),
]
LAYERS = ["presentation", "state", "application", "domain", "integration", "shared", "analysis", "parsing", "configuration", "unknown"]
# What a layer may depend on besides itself; the others are only kept from presentation.
ALLOWED = {
    "domain": ["shared", "configuration"],
    "shared": ["configuration", "domain"],
    "state": ["shared", "configuration", "domain"],
}
NOT_INTEGRATION = ["analysis", "parsing"]

Rules = list[tuple[str, str, str]]


def load_rules(spark: SparkSession, path: str) -> Rules:
    """Rules of a project's own file (``{"rules": [{"pattern", "layer", "reason"}]}``), in its order; the default ones if it can't be read or has none."""
    try:
        table = spark.read.option("multiLine", True).schema("rules array<struct<pattern:string,layer:string,reason:string>>").json(path)
        rows = table.select(F.posexplode("rules").alias("ord", "rule")).filter("rule.pattern is not null and rule.layer is not null").orderBy("ord").collect()
    except AnalysisException:  # a missing file means the default rules, as does one without any; a failed job doesn't
        return RULES
    return [(r.rule.pattern, r.rule.layer, r.rule.reason or "custom_rule") for r in rows] or RULES


def first_match(path: Column, rules: Rules, value: int, default: str) -> Column:
    found = F.lit(default)
    for rule in reversed(rules):
        found = F.when(path.rlike(f"(?i){rule[0]}"), rule[value]).otherwise(found)
    return found


def classify(nodes: DataFrame, rules: Rules = RULES) -> DataFrame:
    """id, type, ord, layer and reason of every node; a symbol has its file's."""
    path = structural(normalized(F.col("id")))
    return nodes.select("id", "type", "ord", first_match(path, rules, 1, "unknown").alias("layer"), first_match(path, rules, 2, "no_rule_matched").alias("reason"))


def layer_rank(layer: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, LAYERS)), layer)


def layer_counts(classified: DataFrame, samples: int = 5) -> DataFrame:
    """layer, n and the first ids in store order. Each partition keeps its first few before the shuffle."""
    firsts = first_rows(classified.select("layer", "ord", "id"), ["layer"], ["ord", "id"], samples).groupBy("layer").agg(F.sort_array(F.collect_list(F.struct("ord", "id"))).alias("r"))
    counts = classified.groupBy("layer").agg(F.count(F.lit(1)).alias("n"))
    return counts.join(firsts, "layer").select("layer", "n", F.transform("r", lambda x: x.id).alias("sample_ids"))


def first_rows(df: DataFrame, keys: list[str], order: list[str], rows: int) -> DataFrame:
    """The first rows of each key: in two steps, so that no task ranks a whole frequent key."""
    from pyspark.sql import Window

    salted = df.withColumn("salt", F.pmod(F.xxhash64(*df.columns), F.lit(64)))
    part = salted.withColumn("place", F.row_number().over(Window.partitionBy(*keys, "salt").orderBy(*order))).filter(F.col("place") <= rows)
    return part.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("place") <= rows).drop("salt")


def import_edges(links: DataFrame) -> DataFrame:
    """Distinct pairs (s, t) of files between which an import goes, without loops, with the place (ord) of the first one in store order."""
    pairs = links.filter("type = 'import'").select(structural(F.col("source")).alias("s"), structural(F.col("target")).alias("t"), "ord").filter("s != t")
    return pairs.groupBy("s", "t").agg(F.min("ord").alias("ord"))


def layered_edges(links: DataFrame, classified: DataFrame) -> DataFrame:
    """s, t, source_layer, target_layer and ord."""
    of = classified.select("id", "layer")
    unknown = lambda c: F.coalesce(c, F.lit("unknown"))
    return (
        import_edges(links)
        .join(of.select(F.col("id").alias("s"), F.col("layer").alias("a")), "s", "left")
        .join(of.select(F.col("id").alias("t"), F.col("layer").alias("b")), "t", "left")
        .select("s", "t", unknown(F.col("a")).alias("source_layer"), unknown(F.col("b")).alias("target_layer"), "ord")
    )


def is_violation(source: Column, target: Column) -> Column:
    known = (source != "unknown") & (target != "unknown") & (source != target)
    strict = reduce(lambda x, y: x | y, ((source == layer) & ~target.isin(allowed) for layer, allowed in ALLOWED.items()))
    return known & ((target == "presentation") | strict | (source.isin(NOT_INTEGRATION) & (target == "integration")))


def violation_code(source: Column, target: Column) -> Column:
    """Why a dependency is one, null if it isn't."""
    return F.when(
        is_violation(source, target),
        F.when(target == "presentation", "inner_layer_depends_on_presentation").when(source.isin("analysis", "parsing"), F.concat(source, F.lit("_depends_on_integration"))).otherwise(F.concat(source, F.lit("_depends_on_outer_layer"))),
    )


def dependencies(edges: DataFrame) -> DataFrame:
    """source_layer, target_layer and n, most frequent first."""
    return edges.groupBy("source_layer", "target_layer").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "source_layer", "target_layer")


def violations(edges: DataFrame) -> DataFrame:
    return edges.withColumn("code", violation_code(F.col("source_layer"), F.col("target_layer"))).filter("code is not null")


def summary(classified: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: classified_nodes, unknown_nodes, cross_layer_dependencies, violation_count and dominant_layer (ties: layer order)."""
    nodes = classified.agg(F.count(F.lit(1)).alias("classified_nodes"), F.count_if(F.col("layer") == "unknown").alias("unknown_nodes"))
    of_edges = edges.agg(F.count_if(F.col("source_layer") != F.col("target_layer")).alias("cross_layer_dependencies"), F.count_if(is_violation(F.col("source_layer"), F.col("target_layer"))).alias("violation_count"))
    top = classified.groupBy("layer").agg(F.count(F.lit(1)).alias("n")).agg(F.max_by("layer", F.struct("n", -layer_rank(F.col("layer")))).alias("dominant_layer"))
    return nodes.join(of_edges, F.lit(True)).join(top, F.lit(True))
