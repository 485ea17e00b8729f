"""Every query of the engine, over the graph that the adapter makes of a data folder, with its DuckDB equivalent."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sylvagraph.lineage import cut, shared_folder
from sylvagraph.operators import activity, architecture, climb, health, project, requests, search, security, stats, traverse
from sylvagraph.operators.holding import first_holding
from sylvagraph.operators.index import ProjectIndex
from sylvagraph.operators.resolve import reresolved, touched_links, unresolved_links, waiting, with_found
from sylvagraph.parsing.facts import parsed
from sylvagraph.plans import oracle as o
from sylvagraph.functions import texts
from sylvagraph.schema import CodeGraph
from sylvagraph.sinks import skills
from sylvagraph.sources import adapter
from sylvagraph.sources.tables import read_table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLE_SQL[name] = sql
        return fn

    return add


def on_graph(name: str, sql: str | None = None) -> Callable[[Callable[[CodeGraph], DataFrame]], Callable[[CodeGraph], DataFrame]]:
    """Registers a function of the resolved graph."""

    def add(fn: Callable[[CodeGraph], DataFrame]) -> Callable[[CodeGraph], DataFrame]:
        query(name, sql)(lambda spark, sf_dir: fn(adapter.graph(spark, sf_dir)))
        return fn

    return add


def on_nodes(name: str, sql: str | None = None) -> Callable[[Callable[[CodeGraph], DataFrame]], Callable[[CodeGraph], DataFrame]]:
    """Registers a function that reads the nodes only, so links aren't resolved for it."""

    def add(fn: Callable[[CodeGraph], DataFrame]) -> Callable[[CodeGraph], DataFrame]:
        query(name, sql)(lambda spark, sf_dir: fn(adapter.raw_graph(spark, sf_dir)))
        return fn

    return add


def layered(g: CodeGraph) -> tuple[DataFrame, DataFrame]:
    classified = architecture.classify(g.nodes)
    return classified, architecture.layered_edges(g.links, classified)


BIG = "CAST({} AS BIGINT)".format
COUNT = BIG("count(*)")
FILES_ONLY = [o.FILES, o.SYMBOLS, o.COMMITS, o.NODES]


# Counts and neighbourhoods.
@on_nodes("graph_stats_by_type", o.sql(f"SELECT type, {COUNT} AS n FROM nodes GROUP BY type"))
def _(g):
    return stats.counts_by_type(g.nodes)


@on_graph("graph_totals", o.sql("SELECT (SELECT count(*) FROM nodes) AS node_count, (SELECT count(*) FROM links) AS link_count"))
def _(g):
    return stats.totals(g.nodes, g.links)


@query("language_profile", o.sql(f"SELECT CASE ext WHEN '.ts' THEN 'typescript' WHEN '.tsx' THEN 'tsx' WHEN '.py' THEN 'python' ELSE 'markdown' END AS language, {COUNT} AS n FROM fx_files GROUP BY 1", base=[o.FILES]))
def _(spark, sf_dir):
    return stats.language_profile(adapter.files(spark, sf_dir))


@query("directory_chain", o.sql("SELECT id, label, parent_id FROM nodes WHERE type = 'directory'", base=FILES_ONLY))
def _(spark, sf_dir):
    return adapter.directories(adapter.files(spark, sf_dir)).select("id", "label", "parent_id")


@on_graph("link_resolution", o.sql("SELECT source, target, CAST(value AS INTEGER) AS value, type FROM links"))
def _(g):
    return g.links.select("source", "target", "value", "type")


@query("link_resolution_dropped", o.sql("SELECT source, target FROM fx_links_raw r WHERE NOT EXISTS (SELECT 1 FROM links l WHERE l.ord = r.ord AND l.source = r.source AND l.type = r.type)"))
def _(spark, sf_dir):
    raw = adapter.raw_graph(spark, sf_dir)
    return unresolved_links(raw.nodes, raw.links).select("source", "target")


@on_graph("adr_links", o.sql("SELECT source, target FROM links WHERE type = 'adr'"))
def _(g):
    return g.links.filter("type = 'adr'").select("source", "target")


@query("symbol_nodes", o.sql("SELECT id, label, type, parent_id FROM fx_symbols", base=[o.FILES, o.SYMBOLS]))
def _(spark, sf_dir):
    return adapter.symbols(spark, sf_dir, adapter.files(spark, sf_dir)).select("id", "label", "type", "parent_id")


@on_nodes("graph_node_scan", o.sql("SELECT id, type, label, id AS file_path, CAST(0 AS BIGINT) AS line, CAST(0 AS BIGINT) AS col FROM nodes WHERE type = 'class'", base=FILES_ONLY))
def _(g):
    zero = F.lit(0).cast("bigint")
    return g.nodes.filter("type = 'class'").select("id", "type", "label", F.col("id").alias("file_path"), zero.alias("line"), zero.alias("col"))


@on_graph("stored_edges_by_type", o.sql(f"SELECT type, {COUNT} AS n FROM stored GROUP BY type", o.STORED))
def _(g):
    return stats.graph_edges(g.nodes, g.links).groupBy("type").agg(F.count(F.lit(1)).alias("n"))


@on_nodes("node_search_unranked", o.sql("SELECT id, label FROM nodes WHERE contains(lower(label), 'part_1') OR contains(lower(id), 'part_1') ORDER BY ord, id LIMIT 20", base=FILES_ONLY))
def _(g):
    return search.search(g.nodes, "Part_1").select("id", "label")


def _score_sql(q: str, weights: dict, priority: str, generic: bool = False) -> str:
    tests = {
        "label=": f"lower(label) = {q}", "base=": f"base = {q}", "stem=": f"stem = {q}", "label_stem=": f"regexp_replace(lower(label), '\\.[^.]+$', '') = {q}",
        "id$": f"(ends_with(lower(id), '/' || {q}) OR ends_with(lower(id), '/' || {q} || '.ts') OR ends_with(lower(id), '/' || {q} || '.tsx'))",
        "label^": f"starts_with(lower(label), {q})", "base^": f"starts_with(base, {q})", "stem^": f"starts_with(stem, {q})",
        "label*": f"contains(lower(label), {q})", "id*": f"contains(lower(id), {q})", "id/": f"contains(lower(id), '/' || {q})",
    }
    points = lambda w: str(w) if generic else f"CASE WHEN type = 'file' THEN {w[0]} ELSE {w[1]} END"
    return " + ".join(f"CASE WHEN {tests[k]} THEN {points(w)} ELSE 0 END" for k, w in weights.items())


NAMED = "named AS MATERIALIZED (SELECT *, split_part(split_part(lower(id), '#', 1), '/', -1) AS base, regexp_replace(split_part(split_part(lower(id), '#', 1), '/', -1), '\\.[^.]+$', '') AS stem FROM nodes)"
PRIORITY = "(CASE type WHEN 'function' THEN 6 WHEN 'class' THEN 5 WHEN 'file' THEN 4 WHEN 'adr' THEN 3 WHEN 'directory' THEN 1 ELSE 2 END)"


@on_nodes(
    "node_search_ranked",
    o.sql(
        f"SELECT id, label, CAST(score AS INTEGER) AS score FROM (SELECT *, {_score_sql(chr(39) + 'part_11' + chr(39), search.GENERIC, PRIORITY, True)} + {PRIORITY} * 10 + CASE WHEN type IN ('file', 'class', 'function', 'adr') THEN 20 ELSE 0 END AS score FROM named WHERE contains(lower(label), 'part_11') OR contains(lower(id), 'part_11')) ORDER BY score DESC, {PRIORITY} DESC, label, id LIMIT 20",
        NAMED,
        base=FILES_ONLY,
    ),
)
def _(g):
    return search.ranked_search(g.nodes, "part_11").select("id", "label", "score")


@on_graph("node_dependencies", o.sql("SELECT id AS origin, 'out' AS direction, target AS other, l.type FROM root JOIN links l ON source = id UNION ALL SELECT id, 'in', source, l.type FROM root JOIN links l ON target = id", o.DEGREES))
def _(g):
    return stats.dependencies(g.links, stats.top_target(g.nodes, g.links))


_NEAR = "SELECT DISTINCT root.id AS origin, n.id, n.type, n.label, e.type AS edge_type FROM root JOIN stored e ON root.id IN (source_id, target_id) JOIN nodes n ON n.id = CASE WHEN e.source_id = root.id THEN e.target_id ELSE e.source_id END"


@on_graph("neighbors_bidirectional", o.sql(_NEAR, o.DEGREES, o.STORED))
def _(g):
    return stats.neighbors(g.nodes, stats.graph_edges(g.nodes, g.links), stats.top_target(g.nodes, g.links))


@on_graph("neighbors_by_edge_type", o.sql(_NEAR + " WHERE e.type = 'imports'", o.DEGREES, o.STORED))
def _(g):
    return stats.neighbors(g.nodes, stats.graph_edges(g.nodes, g.links), stats.top_target(g.nodes, g.links), "imports")


@on_graph("fan_in_out", o.sql("SELECT id, fan_in, fan_out FROM degrees WHERE fan_in + fan_out > 0", o.DEGREES))
def _(g):
    return stats.degrees(g.nodes, g.links).filter("fan_in + fan_out > 0").select("id", "fan_in", "fan_out")


@on_graph("graph_truncated", o.sql("SELECT kind, id, target, (SELECT count(*) FROM nodes) > 1000 OR (SELECT count(*) FROM links) > 2000 AS truncated FROM (SELECT * FROM (SELECT 'node' AS kind, id, NULL AS target FROM nodes ORDER BY ord, id LIMIT 1000) UNION ALL SELECT * FROM (SELECT 'link', source, target FROM links ORDER BY ord, source, target LIMIT 2000))"))
def _(g):
    return stats.truncated(g.nodes, g.links)


# Architecture.
@on_nodes("layer_classification", o.sql("SELECT id, layer, reason FROM classified", o.CLASSIFIED, base=FILES_ONLY))
def _(g):
    return architecture.classify(g.nodes).select("id", "layer", "reason")


@on_nodes("layer_counts", o.sql(f"SELECT layer, {COUNT} AS n FROM classified GROUP BY layer", o.CLASSIFIED, base=FILES_ONLY))
def _(g):
    return architecture.classify(g.nodes).groupBy("layer").agg(F.count(F.lit(1)).alias("n"))


@on_nodes("layer_samples", o.sql("SELECT layer, id FROM (SELECT *, row_number() OVER (PARTITION BY layer ORDER BY ord, id) AS k FROM classified) WHERE k <= 5", o.CLASSIFIED, base=FILES_ONLY))
def _(g):
    return architecture.layer_counts(architecture.classify(g.nodes)).select("layer", F.explode("sample_ids").alias("id"))


@on_graph("layer_dependencies", o.sql(f"SELECT source_layer, target_layer, {COUNT} AS n FROM edges GROUP BY ALL", o.CLASSIFIED, o.EDGES))
def _(g):
    return architecture.dependencies(layered(g)[1])


@on_graph("layer_violations", o.sql("SELECT s, t, source_layer, target_layer FROM violations", o.CLASSIFIED, o.EDGES))
def _(g):
    return architecture.violations(layered(g)[1]).select("s", "t", "source_layer", "target_layer")


@on_graph(
    "architecture_summary",
    o.sql(
        f"SELECT (SELECT count(*) FROM classified) AS classified_nodes, (SELECT count(*) FROM classified WHERE layer = 'unknown') AS unknown_nodes, (SELECT count(*) FROM edges WHERE source_layer <> target_layer) AS cross_layer_dependencies, (SELECT count(*) FROM violations) AS violation_count, (SELECT layer FROM classified GROUP BY layer ORDER BY count(*) DESC, {o.LAYER_RANK} LIMIT 1) AS dominant_layer",
        o.CLASSIFIED,
        o.EDGES,
    ),
)
def _(g):
    return architecture.summary(*layered(g))


# Health and patterns.
@on_graph("orphan_nodes", o.plain_sql("SELECT id FROM orphans", o.CLASSIFIED, o.ORPHANS))
def _(g):
    return health.orphans(g, architecture.classify(g.nodes))


@query("unresolved_imports", o.sql("SELECT source, target FROM fx_links_raw WHERE type = 'import' AND target NOT IN (SELECT id FROM nodes)"))
def _(spark, sf_dir):
    raw = adapter.raw_graph(spark, sf_dir)
    return health.unresolved_imports(raw.nodes, raw.links).select("source", "target")


_COVER = "cover AS (SELECT n.id, p.id IS NOT NULL AS covered FROM nodes n LEFT JOIN nodes p ON p.id = n.parent_id AND p.type = 'directory' WHERE n.type IN ('file', 'adr') AND regexp_replace(n.id, '/[^/]*$', '') <> '/proj')"


@on_nodes("directory_coverage", o.sql(f"SELECT {BIG('count(*)')} AS expected, {BIG('count(*) FILTER (covered)')} AS covered FROM cover", _COVER, base=FILES_ONLY))
def _(g):
    return stats.with_directory_parent(g.nodes, g.root).agg(F.count(F.lit(1)).alias("expected"), F.count_if("covered").alias("covered"))


_FACTS = f"""facts AS (
    SELECT (SELECT count(*) FROM nodes) AS node_count, (SELECT count(*) FROM nodes WHERE contains(id, '#')) AS symbol_count, (SELECT count(*) FROM nodes WHERE type = 'file') AS file_count,
           (SELECT count(*) FROM links) AS link_count, (SELECT count(*) FROM orphans) AS orphan_count,
           (SELECT count(*) FROM links WHERE type = 'import' AND target NOT IN (SELECT id FROM nodes)) AS unresolved_count,
           (SELECT CASE WHEN count(*) = 0 THEN 1.0 ELSE count(*) FILTER (covered) / CAST(count(*) AS DOUBLE) END FROM cover) AS coverage,
           (SELECT count(*) FROM violations) AS violation_count, (SELECT count(*) FROM classified WHERE layer = 'unknown') AS unknown_nodes
), issues AS (
    SELECT unnest([
        {{'code': 'empty_graph', 'holds': node_count = 0, 'points': 70, 'severity': 'high'}},
        {{'code': 'unresolved_import_links', 'holds': unresolved_count > 0, 'points': least(25, unresolved_count), 'severity': CASE WHEN unresolved_count > 25 THEN 'high' ELSE 'medium' END}},
        {{'code': 'orphan_nodes', 'holds': orphan_count > 0, 'points': least(15, CAST(ceil(orphan_count / 3.0) AS BIGINT)), 'severity': CASE WHEN orphan_count > 20 THEN 'medium' ELSE 'low' END}},
        {{'code': 'weak_hierarchy', 'holds': coverage < 0.85, 'points': least(20, CAST(ceil((1 - coverage) * 20) AS BIGINT)), 'severity': CASE WHEN coverage < 0.5 THEN 'high' ELSE 'medium' END}},
        {{'code': 'missing_symbols', 'holds': symbol_count = 0 AND file_count > 0, 'points': 25, 'severity': 'high'}},
        {{'code': 'architecture_violations', 'holds': violation_count > 0, 'points': least(20, violation_count * 2), 'severity': CASE WHEN violation_count > 10 THEN 'high' ELSE 'medium' END}},
        {{'code': 'unknown_layer_nodes', 'holds': unknown_nodes > 0, 'points': least(10, CAST(ceil(unknown_nodes / 10.0) AS BIGINT)), 'severity': CASE WHEN unknown_nodes > 25 THEN 'medium' ELSE 'low' END}}
    ]) AS i FROM facts
), score AS (SELECT greatest(0, least(100, 100 - coalesce(sum(i.points) FILTER (i.holds), 0))) AS score FROM issues)"""


def _facts(g: CodeGraph) -> DataFrame:
    return health.facts(g, *layered(g))


@on_graph("health_score", o.sql("SELECT CAST(score AS INTEGER) AS score, CASE WHEN score >= 90 THEN 'A' WHEN score >= 80 THEN 'B' WHEN score >= 70 THEN 'C' WHEN score >= 60 THEN 'D' ELSE 'F' END AS grade, node_count, link_count, orphan_count FROM score, facts", o.CLASSIFIED, o.EDGES, o.ORPHANS, _COVER, _FACTS))
def _(g):
    return health.health_score(_facts(g)).select("score", "grade", "node_count", "link_count", "orphan_count")


@on_graph("health_issues", o.sql("SELECT i.code AS code, i.severity AS severity, CAST(i.points AS BIGINT) AS points FROM issues WHERE i.holds", o.CLASSIFIED, o.EDGES, o.ORPHANS, _COVER, _FACTS))
def _(g):
    return health.issues(_facts(g))


def _pattern_sql(name: str, where: str, metric: str, order: str, limit: int) -> str:
    return f"SELECT '{name}' AS pattern_id, id AS node_id, {BIG(metric)} AS metric FROM degrees WHERE {where} ORDER BY {order} LIMIT {limit}"


_HUB = _pattern_sql("hub_nodes", "type IN ('file', 'class', 'function') AND fan_in >= 8", "fan_in", "fan_in DESC, ord, id", 10)
_OUT = _pattern_sql("high_fan_out_files", "type = 'file' AND fan_out >= 12", "fan_out", "fan_out DESC, ord, id", 10)
_HOT = _pattern_sql("churn_hotspots", "type = 'file' AND churn >= 10", "churn", "churn DESC, ord, id", 10)
_DEEP = "SELECT 'deep_nesting' AS pattern_id, n.id AS node_id, CAST(d AS BIGINT) AS metric FROM (SELECT id, count(*) AS d FROM chain GROUP BY id) JOIN nodes n USING (id) WHERE n.type IN ('file', 'directory') AND d >= 5 ORDER BY ord, n.id LIMIT 20"
_ADR = "SELECT 'broad_adr_impact' AS pattern_id, target AS node_id, CAST(count(DISTINCT source) AS BIGINT) AS metric FROM links WHERE type = 'adr' GROUP BY target HAVING count(DISTINCT source) >= 12"
_ALONE = "SELECT 'isolated_files' AS pattern_id, id AS node_id, CAST(0 AS BIGINT) AS metric FROM orphans WHERE type = 'file' ORDER BY ord, id LIMIT 10"


@on_graph("hub_nodes", o.sql(_HUB, o.DEGREES))
def _(g):
    return health.hub_nodes(stats.degrees(g.nodes, g.links))


@on_graph("high_fan_out_files", o.sql(_OUT, o.DEGREES))
def _(g):
    return health.high_fan_out_files(stats.degrees(g.nodes, g.links))


@on_nodes("deep_nesting", o.sql(_DEEP, o.ANCESTRY, base=FILES_ONLY))
def _(g):
    return health.deep_nesting(traverse.hierarchy_depth(g.nodes))


@on_nodes("churn_hotspots", o.sql(_HOT, o.DEGREES))
def _(g):
    return health.churn_hotspots(g.nodes)


@on_graph("broad_adr_impact", o.sql(_ADR))
def _(g):
    return health.broad_adr_impact(g.nodes, g.links)


@on_graph("isolated_files", o.sql(_ALONE, o.CLASSIFIED, o.ORPHANS))
def _(g):
    return health.isolated_files(g, architecture.classify(g.nodes))


_GRADES = "CASE pattern_id WHEN 'hub_nodes' THEN CASE WHEN m >= 15 THEN 'high' ELSE 'medium' END WHEN 'high_fan_out_files' THEN CASE WHEN m >= 20 THEN 'high' ELSE 'medium' END WHEN 'deep_nesting' THEN CASE WHEN n > 10 THEN 'medium' ELSE 'low' END WHEN 'churn_hotspots' THEN CASE WHEN m >= 25 THEN 'high' ELSE 'medium' END WHEN 'isolated_files' THEN CASE WHEN n >= 8 THEN 'medium' ELSE 'low' END ELSE 'low' END"


@on_graph(
    "pattern_summary",
    o.sql(
        f"SELECT pattern_id, {_GRADES} AS severity, n FROM (SELECT pattern_id, {COUNT} AS n, max(metric) AS m FROM ("
        + " UNION ALL ".join(f"SELECT * FROM ({x})" for x in (_HUB, _OUT, _DEEP, _HOT, _ADR, _ALONE))
        + f") GROUP BY pattern_id) WHERE pattern_id <> 'isolated_files' OR n >= 3 UNION ALL SELECT 'layer_violations', CASE WHEN count(*) > 10 THEN 'high' ELSE 'medium' END, {COUNT} FROM violations HAVING count(*) > 0 UNION ALL SELECT 'unknown_layer_classification', 'low', {COUNT} FROM classified WHERE layer = 'unknown' HAVING count(*) >= 5",
        o.CLASSIFIED,
        o.EDGES,
        o.DEGREES,
        o.ANCESTRY,
        o.ORPHANS,
    ),
)
def _(g):
    return health.pattern_summary(g, *layered(g), traverse.hierarchy_depth(g.nodes))


# Traversal.
_BACK = "reach AS (SELECT id, 0 AS depth FROM root UNION SELECT l.source, depth + 1 FROM reach JOIN links l ON l.target = reach.id WHERE depth < {depth}), found AS (SELECT id, min(depth) AS depth FROM reach GROUP BY id)"
_BOTH = "reach AS (SELECT id, 0 AS depth FROM root UNION SELECT CASE WHEN e.source_id = reach.id THEN e.target_id ELSE e.source_id END, depth + 1 FROM reach JOIN stored e ON reach.id IN (e.source_id, e.target_id) WHERE depth < {depth}), found AS (SELECT id, min(depth) AS depth FROM reach GROUP BY id)"


@on_graph("blast_radius_v1_levels", o.sql("SELECT (SELECT id FROM root) AS seed_id, id, depth FROM found WHERE depth > 0 AND id IN (SELECT id FROM nodes)", o.DEGREES, _BACK.format(depth=4)))
def _(g):
    return traverse.blast_radius(g.nodes, g.links, stats.top_target(g.nodes, g.links), 4)


@on_graph(
    "blast_radius_v1_summary",
    o.sql(
        f"SELECT *, CASE WHEN affected_nodes = 0 THEN 'low' WHEN i > 0 AND a = 0 THEN 'high' WHEN i > 0 THEN 'medium' ELSE 'low' END AS confidence FROM (SELECT (SELECT id FROM root) AS seed_id, (SELECT count(*) FROM found WHERE depth > 0 AND id IN (SELECT id FROM nodes)) AS affected_nodes, {COUNT} AS affected_links, (SELECT count(*) FROM links l JOIN root ON l.target = root.id WHERE l.source IN (SELECT id FROM nodes)) AS direct_dependents, (SELECT max(depth) FROM found) AS max_depth, count(*) FILTER (type = 'import') AS i, count(*) FILTER (type = 'adr') AS a FROM links JOIN found f ON f.id = target WHERE f.depth < 3)".replace("SELECT *, CASE", "SELECT seed_id, affected_nodes, affected_links, direct_dependents, max_depth, CASE"),
        o.DEGREES,
        _BACK.format(depth=3),
    ),
)
def _(g):
    return traverse.blast_summary(g.nodes, g.links, stats.top_target(g.nodes, g.links), 3)


@on_graph("blast_radius_v2_levels", o.sql("SELECT (SELECT id FROM root) AS seed_id, id, depth AS distance FROM found WHERE depth > 0", o.DEGREES, o.STORED, _BOTH.format(depth=3)))
def _(g):
    return traverse.surroundings(stats.graph_edges(g.nodes, g.links), stats.top_target(g.nodes, g.links), 3)


_V2 = "(SELECT id FROM root) AS seed_id, count(*) FILTER (depth = 1) AS direct, count(*) FILTER (depth > 1) AS transitive, coalesce(max(depth) FILTER (depth > 1), 0) AS max_depth"


@on_graph("blast_radius_v2_summary", o.sql(f"SELECT {_V2}, count(*) FILTER (depth >= 3) AS risk_nodes FROM found", o.DEGREES, o.STORED, _BOTH.format(depth=4)))
def _(g):
    return traverse.surroundings_summary(stats.graph_edges(g.nodes, g.links), stats.top_target(g.nodes, g.links), 4)


@on_graph("blast_radius_v2_paths", o.sql("SELECT id, depth AS distance, CAST(depth + 1 AS INTEGER) AS steps FROM found WHERE depth > 0", o.DEGREES, o.STORED, _BOTH.format(depth=3)))
def _(g):
    return traverse.with_paths(stats.graph_edges(g.nodes, g.links), stats.top_target(g.nodes, g.links), 3).select("id", "distance", F.size("path").alias("steps"))


@on_graph("impact_score", o.sql(f"SELECT seed_id, CAST(least(100.0, 2 * direct + transitive + 0.5 * max_depth) AS DOUBLE) AS impact_score FROM (SELECT {_V2} FROM found)", o.DEGREES, o.STORED, _BOTH.format(depth=3)))
def _(g):
    return traverse.impact_score(traverse.surroundings_summary(stats.graph_edges(g.nodes, g.links), stats.top_target(g.nodes, g.links), 3)).select("seed_id", "impact_score")


_COLLAPSED = "pairs AS MATERIALIZED (SELECT DISTINCT s AS source, t AS target FROM (SELECT split_part(source, '#', 1) AS s, split_part(target, '#', 1) AS t FROM links) WHERE s <> t AND s IN (SELECT id FROM nodes WHERE type = 'file') AND t IN (SELECT id FROM nodes WHERE type = 'file'))"
_AROUND = "reach AS (SELECT id, 0 AS depth FROM root UNION SELECT CASE WHEN p.source = reach.id THEN p.target ELSE p.source END, depth + 1 FROM reach JOIN pairs p ON reach.id IN (p.source, p.target) WHERE depth < 2), found AS (SELECT id, min(depth) AS depth FROM reach GROUP BY id)"
_AFFECTED = "affected AS MATERIALIZED (SELECT f.id, f.depth, n.ord FROM found f JOIN nodes n USING (id) ORDER BY f.depth, n.ord, f.id LIMIT {most})"


@on_graph("collapsed_file_graph", o.sql("SELECT source, target FROM pairs", _COLLAPSED))
def _(g):
    return traverse.collapsed(g.nodes, g.links)


@on_graph("affected_file_expansion", o.sql("SELECT id, depth FROM affected", o.DEGREES, _COLLAPSED, _AROUND, _AFFECTED.format(most=30)))
def _(g):
    return traverse.affected_files(g.nodes, g.links, stats.top_target(g.nodes, g.links))


_SEEDS3 = "seeds AS MATERIALIZED (SELECT id FROM degrees WHERE type = 'file' ORDER BY fan_in DESC, ord, id LIMIT 3), reach AS (SELECT id AS seed_id, id, 0 AS depth FROM seeds UNION SELECT seed_id, l.source, depth + 1 FROM reach JOIN links l ON l.target = reach.id WHERE depth < 2)"


@on_graph("multi_seed_blast", o.sql("SELECT seed_id, id, min(depth) AS depth FROM reach GROUP BY seed_id, id HAVING min(depth) > 0 AND id IN (SELECT id FROM nodes)", o.DEGREES, _SEEDS3))
def _(g):
    return traverse.blast_radius(g.nodes, g.links, stats.top_target(g.nodes, g.links, 3), 2)


@on_nodes("hierarchy_depth", o.sql(f"SELECT n.id, {BIG('coalesce(d, 0)')} AS depth FROM nodes n LEFT JOIN (SELECT id, count(*) AS d FROM chain GROUP BY id) USING (id)", o.ANCESTRY, base=FILES_ONLY))
def _(g):
    return traverse.hierarchy_depth(g.nodes).select("id", F.col("depth").cast("bigint").alias("depth"))


@on_graph(
    "cycle_2_3",
    o.sql(
        "SELECT id, min(length) AS length FROM (SELECT x.a AS id, 2 AS length FROM one x JOIN one y ON y.a = x.b AND y.b = x.a UNION ALL SELECT x.a, 3 FROM one x JOIN one y ON y.a = x.b JOIN one z ON z.a = y.b AND z.b = x.a WHERE y.b <> x.a) GROUP BY id",
        o.STORED,
        "one AS MATERIALIZED (SELECT DISTINCT source_id AS a, target_id AS b FROM stored WHERE source_id <> target_id)",
    ),
)
def _(g):
    return traverse.short_cycles(stats.graph_edges(g.nodes, g.links))


_VISIBLE = "standing AS (SELECT id, CASE WHEN type = 'directory' THEN id ELSE (SELECT arg_min(ancestor, distance) FROM chain c JOIN nodes p ON p.id = c.ancestor AND p.type = 'directory' WHERE c.id = n.id) END AS ancestor FROM nodes n)"


@on_nodes("visible_ancestor", o.sql("SELECT id, ancestor FROM standing", o.ANCESTRY, _VISIBLE, base=FILES_ONLY))
def _(g):
    return traverse.nearest_ancestor(g.nodes, F.col("type") == "directory")


@on_graph("rendered_edges", o.sql("SELECT DISTINCT a.ancestor AS source, b.ancestor AS target, l.type FROM links l JOIN standing a ON a.id = l.source JOIN standing b ON b.id = l.target WHERE a.ancestor <> b.ancestor", o.ANCESTRY, _VISIBLE))
def _(g):
    return traverse.rendered_edges(g.nodes, g.links, F.col("type") == "directory")


@query("path_trie", o.sql(f"SELECT path, bool_or(is_dir) AS is_dir, {COUNT} AS files FROM (SELECT array_to_string(parts[1:n], '/') AS path, n < len(parts) AS is_dir FROM (SELECT string_split(substr(id, 7), '/') AS parts FROM fx_files), unnest(range(1, len(parts) + 1)) AS r(n)) GROUP BY path", base=[o.FILES]))
def _(spark, sf_dir):
    return traverse.path_trie(adapter.files(spark, sf_dir), adapter.ROOT).select("path", "is_dir", "files")


# Activity.
_HEAT = "heat AS MATERIALIZED (SELECT file_path, count(DISTINCT hash) AS commits, CAST(sum(additions) AS BIGINT) AS additions, CAST(sum(deletions) AS BIGINT) AS deletions, max(ts) AS last_modified, count(DISTINCT author) AS authors FROM fx_commits {where} GROUP BY file_path)"
GIT = [o.FILES, o.COMMITS]


@query("churn_per_file", o.sql(f"SELECT file_path, {COUNT} AS n FROM fx_commits GROUP BY file_path", base=GIT))
def _(spark, sf_dir):
    return activity.churn(adapter.commits(spark, sf_dir))


def _heat_columns(df: DataFrame) -> DataFrame:
    return df.withColumn("authors", F.size("authors").cast("bigint"))


@query("activity_heatmap", o.sql("SELECT * FROM heat", _HEAT.format(where=""), base=GIT))
def _(spark, sf_dir):
    return _heat_columns(activity.heatmap(adapter.commits(spark, sf_dir)))


@query("heatmap_since_until", o.sql("SELECT * FROM heat", _HEAT.format(where="WHERE ts >= (SELECT min(ts) + INTERVAL 5 DAY FROM events) AND ts <= (SELECT max(ts) - INTERVAL 5 DAY FROM events)"), base=GIT))
def _(spark, sf_dir):
    ends = read_table(spark, sf_dir, "events").agg(F.date_format(F.min("ts") + F.expr("interval 5 days"), "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("a"), F.date_format(F.max("ts") - F.expr("interval 5 days"), "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("b")).first()
    return _heat_columns(activity.heatmap(adapter.commits(spark, sf_dir), ends.a, ends.b))


@query("heatmap_globals", o.sql("SELECT greatest(max(commits), 1) AS max_commits, greatest(max(additions + deletions), 1) AS max_changes, count(*) AS total_files FROM heat", _HEAT.format(where=""), base=GIT))
def _(spark, sf_dir):
    return activity.heatmap_globals(activity.heatmap(adapter.commits(spark, sf_dir)))


@query("heatmap_buckets", o.sql("SELECT file_path, CAST(least(floor(least(commits / CAST((SELECT max(commits) FROM heat) AS DOUBLE), 1.0) * 5), 4) AS INTEGER) AS band FROM heat", _HEAT.format(where=""), base=GIT))
def _(spark, sf_dir):
    return activity.heatmap_bands(activity.heatmap(adapter.commits(spark, sf_dir))).select("file_path", "band")


_CHANGED = "changed AS MATERIALIZED (SELECT id AS path, CASE WHEN partkey % 5 = 0 THEN 'added' WHEN partkey % 5 = 1 THEN 'deleted' ELSE 'modified' END AS status, partkey % 40 AS additions, partkey % 7 AS deletions FROM fx_files WHERE partkey % 50 < 2)"


def _changed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A made-up change: two files of fifty; the trees differ by key."""
    found = adapter.files(spark, sf_dir)
    numstat = found.filter("partkey % 50 < 2").select(F.col("id").alias("path"), (F.col("partkey") % 40).alias("additions"), (F.col("partkey") % 7).alias("deletions"))
    return activity.changed_files(numstat, found.filter("partkey % 5 != 0").select(F.col("id").alias("path")), found.filter("partkey % 5 != 1").select(F.col("id").alias("path")))


@query("pr_changed_files", o.sql("SELECT path, status, additions, deletions FROM changed", _CHANGED, base=[o.FILES]))
def _(spark, sf_dir):
    return _changed(spark, sf_dir)


_PR = "near AS (SELECT DISTINCT o.id AS origin, CASE WHEN e.source_id = o.id THEN e.target_id ELSE e.source_id END AS id, e.type FROM nodes o JOIN changed ON changed.path = split_part(o.id, '#', 1) JOIN stored e ON o.id IN (e.source_id, e.target_id)), blast AS (SELECT n.id AS node_id, status, (SELECT count(*) FROM near WHERE origin = n.id) AS neighbors FROM changed JOIN nodes n ON split_part(n.id, '#', 1) = changed.path)"


@query(
    "pr_impact_summary",
    o.sql(
        "SELECT *, CASE WHEN total_changes > 500 OR blast_radius > 50 OR affected_nodes > 20 THEN 'critical' WHEN total_changes > 200 OR blast_radius > 20 OR affected_nodes > 10 THEN 'high' WHEN total_changes > 50 OR blast_radius > 5 OR affected_nodes > 5 THEN 'medium' ELSE 'low' END AS risk FROM (SELECT (SELECT count(*) FROM changed) AS changed_files, CAST((SELECT sum(additions + deletions) FROM changed) AS BIGINT) AS total_changes, CAST((SELECT coalesce(sum(neighbors), 0) FROM blast) AS BIGINT) AS blast_radius, (SELECT count(DISTINCT node_id) FROM blast) AS affected_nodes)",
        _CHANGED,
        o.STORED,
        _PR,
    ),
)
def _(spark, sf_dir):
    g = adapter.graph(spark, sf_dir)
    changed = _changed(spark, sf_dir)
    mine = g.nodes.select("id", F.substring_index("id", "#", 1).alias("file_path"))
    touched = mine.join(changed.select(F.col("path").alias("file_path")), "file_path", "left_semi")
    near = stats.neighbors(g.nodes, stats.graph_edges(g.nodes, g.links), touched)
    return activity.pr_summary(changed, activity.change_blast(mine, near, changed)).drop("recommendations")


# Sources and security.
_CODE = f"""code AS MATERIALIZED (
    SELECT parent_id AS file_id, suppkey + 1 AS line_no, 'export ' || type || ' ' || label || CASE WHEN type = 'class' THEN ' {{' ELSE '() {{' END AS line FROM fx_symbols
    UNION ALL
    SELECT id, 10000000 + k, line FROM fx_files, (VALUES (0, 97, '  eval(x);'), (1, 89, '  localStorage.getItem(k);'), (2, 83, '  execSync(cmd);'), (3, 79, '  // eval(x) localStorage.a execSync(c)'),
        (4, 73, '  log(''eval(x)'');'), (5, 71, '  const password = ''hunter2hunter2'';'), (6, 67, '  fetch(''http://example.org/x'');'), (7, 61, '  fetch(''http://localhost/x'');'), (8, 1, 'const value = (a, b) => a;')) r(k, m, line)
    WHERE type = 'file' AND partkey % m = 0)"""


@query(
    "signature_search",
    o.sql(
        "SELECT file_id AS node_id, symbol_id, CAST(line_no AS BIGINT) AS line, trim(line) AS preview FROM (SELECT c.*, f.ord AS file_ord, (SELECT arg_min(s.id, s.ord) FROM fx_symbols s WHERE s.parent_id = c.file_id AND contains(c.line, s.label)) AS symbol_id FROM code c JOIN fx_files f ON f.id = c.file_id WHERE contains(lower(line), 'sym_1')) ORDER BY file_ord, line_no LIMIT 50",
        _CODE,
        base=[o.FILES, o.SYMBOLS],
    ),
)
def _(spark, sf_dir):
    g = adapter.raw_graph(spark, sf_dir)
    return search.signatures(g.nodes, adapter.code_lines(spark, sf_dir), "sym_1", limit=50).select("node_id", "symbol_id", "line", "preview")


_FINDINGS = """findings AS (
    SELECT CASE split_part(trim(line), '(', 1) WHEN 'eval' THEN 'dynamic_code_execution' WHEN 'localStorage.getItem' THEN 'browser_storage_auth' WHEN 'execSync' THEN 'child_process_shell' WHEN 'const password = ''hunter2hunter2'';' THEN 'hardcoded_secret' WHEN 'fetch' THEN 'insecure_http_url' END AS rule_id, file_id AS node_id
    FROM code WHERE trim(line) IN ('eval(x);', 'localStorage.getItem(k);', 'execSync(cmd);', 'const password = ''hunter2hunter2'';', 'fetch(''http://example.org/x'');') AND NOT regexp_matches(file_id, '(dist|dist-electron|dist-renderer|node_modules|build|out|coverage)/')
), graded AS (SELECT rule_id, CASE rule_id WHEN 'browser_storage_auth' THEN 'critical' WHEN 'insecure_http_url' THEN 'medium' ELSE 'high' END AS severity, node_id FROM findings)"""


def _security(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = adapter.raw_graph(spark, sf_dir)
    return security.findings(g.nodes, security.texts_of(adapter.code_lines(spark, sf_dir)))


@query("security_findings", o.sql("SELECT rule_id, severity, node_id FROM graded", _CODE, _FINDINGS, base=[o.FILES, o.SYMBOLS]))
def _(spark, sf_dir):
    return _security(spark, sf_dir)


@query("security_summary", o.sql("SELECT count(*) AS total, count(*) FILTER (severity = 'critical') AS critical, count(*) FILTER (severity = 'high') AS high, count(*) FILTER (severity = 'medium') AS medium, count(*) FILTER (severity = 'low') AS low FROM graded", _CODE, _FINDINGS, base=[o.FILES, o.SYMBOLS]))
def _(spark, sf_dir):
    return security.severity_summary(_security(spark, sf_dir))


@query("security_http_urls", "SELECT page_id FROM pages WHERE regexp_matches(url, '(?i)http://') AND NOT regexp_matches(url, '(?i)localhost|127\\.0\\.0\\.1') AND NOT contains(url, '${') AND NOT regexp_matches(url, '(?i)xmlns\\s*=|www\\.w3\\.org')")
def _(spark, sf_dir):
    return read_table(spark, sf_dir, "pages").filter(security.has_plain_http(F.col("url"))).select("page_id")


@query("secret_detection", "SELECT doc_id FROM documents WHERE regexp_matches(text, '(?i)\\b(?:api[_-]?key|secret|token|password)\\b\\s*[:=]\\s*[''\"`][^''\"`\\s]{8,}[''\"`]')")
def _(spark, sf_dir):
    return read_table(spark, sf_dir, "documents").filter(F.col("text").rlike(security.HARDCODED_SECRET)).select("doc_id")


# Requests.
_ASKED = "asked AS (SELECT conv_id, turn, text, lower(trim(text)) AS t FROM conversations WHERE role = 'user' AND turn IS NOT NULL)"


def _any(words: list[str]) -> str:
    return "(" + " OR ".join(f"contains(t, '{w}')" for w in words) + ")"


def _intent_sql() -> str:
    h = {k: _any(v) for k, v in requests.HINTS.items()}
    order = [
        (f"{h['bugfix']} AND {h['security']} AND NOT contains(t, 'ломает')", "security"), (h["bugfix"], "bugfix"),
        (f"{h['campaign']} AND ({h['refactor']} OR {h['feature']} OR contains(t, 'нов') OR contains(t, 'библиотек'))", "refactor"),
        (h["refactor"], "refactor"), (h["feature"], "feature"), (h["security"], "security"), (h["architecture"], "architecture"), (h["review"], "review"), (h["stabilization"], "stabilization"),
    ]
    return "CASE " + " ".join(f"WHEN {test} THEN '{kind}'" for test, kind in order) + " ELSE 'explore' END"


@query("intent_inference", f"WITH {_ASKED} SELECT conv_id, turn, {_intent_sql()} AS task_kind FROM asked")
def _(spark, sf_dir):
    asked = read_table(spark, sf_dir, "conversations").filter("role = 'user' and turn is not null")
    return requests.inferred(asked).select("conv_id", "turn", "task_kind")


@query("keyword_extraction")
def _(spark, sf_dir):
    asked = read_table(spark, sf_dir, "conversations").filter("role = 'user'")
    return requests.inferred(asked).select("conv_id", "turn", F.posexplode("keywords").alias("place", "keyword"))


# Trees, notes and texts.
@on_nodes("tree_parents", o.sql("SELECT n.id, p.id AS parent FROM nodes n LEFT JOIN (SELECT id FROM nodes WHERE type <> 'directory') p ON p.id = n.parent_id WHERE type <> 'directory'", base=FILES_ONLY))
def _(g):
    return traverse.tree(g.nodes, F.col("type") != "directory")


@on_graph("violation_ends", o.sql("SELECT CAST((k - 1) * 2 + side AS INTEGER) AS place, CASE side WHEN 0 THEN s ELSE t END AS node_id FROM (SELECT s, t, row_number() OVER (ORDER BY ord, s, t) AS k FROM violations), (VALUES (0), (1)) x(side) WHERE k <= 15", o.CLASSIFIED, o.EDGES))
def _(g):
    return health.violation_ends(architecture.violations(layered(g)[1]))


_NEAR = "near AS (SELECT a AS id, count(*) AS n FROM (SELECT source_id AS a, target_id AS b FROM stored UNION SELECT target_id, source_id FROM stored) WHERE a <> b GROUP BY a)"


@on_graph("project_skills", o.sql("SELECT f.id AS node_id, regexp_replace(lower(label), '[^a-z0-9]', '-', 'g') || '-context.md' AS file_name, contains(coalesce(CASE WHEN n > 10 THEN 'many' END, ''), 'many') AS crowded FROM (SELECT * FROM nodes WHERE type = 'file' AND NOT contains(id, '/.') AND NOT contains(id, '/node_modules/') ORDER BY ord, id LIMIT 10) f LEFT JOIN near ON near.id = f.id", o.STORED, _NEAR))
def _(g):
    found = skills.skills(g.nodes, stats.graph_edges(g.nodes, g.links), skills.project_files(g.nodes))
    return found.select("node_id", "file_name", F.col("text").contains("many neighbours").alias("crowded"))


@query("event_ages", "SELECT event_id, CASE WHEN m < 1 THEN 'just now' WHEN m < 60 THEN m || 'm ago' WHEN m < 1440 THEN m // 60 || 'h ago' WHEN m < 10080 THEN m // 1440 || 'd ago' ELSE strftime(ts, '%b %-d, %Y') END AS age FROM (SELECT *, (epoch_us(max(ts) OVER ()) - epoch_us(ts)) // 60000000 AS m FROM events)")
def _(spark, sf_dir):
    events = read_table(spark, sf_dir, "events").select("event_id", "ts")
    latest = events.agg(F.max("ts").alias("now"))
    return events.withColumn("now", latest.scalar()).select("event_id", texts.age(F.col("ts"), F.col("now")).alias("age"))


# Projects and campaigns.
ASKED_FOR = ["part_11", "sym_7", "services"]
_Q = "(VALUES ('part_11'), ('sym_7'), ('services')) q(q)"


def _queries(spark_df: DataFrame) -> DataFrame:
    return spark_df.sparkSession.createDataFrame([(q,) for q in ASKED_FOR], "query string")


def _best_sql(weights: dict, priority: str, where: str = "true") -> str:
    inner = f"SELECT named.*, {_score_sql('q', weights, priority)} AS text_score FROM named, {_Q} WHERE {where}"
    return f"scored AS MATERIALIZED (SELECT id, type, label, max(text_score + {priority} * 10) AS score FROM ({inner}) WHERE text_score > 0 GROUP BY id, type, label)"


@on_nodes("target_candidates", o.sql(f"SELECT id, CAST(score AS INTEGER) AS score FROM scored ORDER BY score DESC, {PRIORITY} DESC, label, id LIMIT 6", NAMED, _best_sql(search.TASK, PRIORITY), base=FILES_ONLY))
def _(g):
    return search.target_candidates(g.nodes, _queries(g.nodes)).select("id", "score")


_P2 = "(CASE type WHEN 'file' THEN 5 WHEN 'class' THEN 4 WHEN 'function' THEN 3 ELSE 1 END)"


@on_nodes("campaign_seeds", o.sql(f"SELECT id FROM (SELECT * FROM scored ORDER BY score DESC, {_P2} DESC, label, id LIMIT 30) ORDER BY score DESC, id LIMIT 10", NAMED, _best_sql(search.CAMPAIGN, _P2, "type IN ('file', 'class', 'function')"), base=FILES_ONLY))
def _(g):
    return project.campaign_seeds(g.nodes, architecture.classify(g.nodes), _queries(g.nodes)).select("id")


_WAVE = "CASE WHEN layer IN ('shared', 'state', 'configuration') THEN 'wave-foundation' WHEN layer IN ('integration', 'presentation') THEN 'wave-edge' ELSE 'wave-core' END"


@on_graph("execution_waves", o.sql(f"SELECT wave, id FROM (SELECT *, row_number() OVER (PARTITION BY wave ORDER BY depth, ord, id) AS k FROM (SELECT a.id, a.depth, a.ord, {_WAVE} AS wave FROM affected a LEFT JOIN classified c ON c.id = a.id)) WHERE k <= 15", o.CLASSIFIED, o.DEGREES, _COLLAPSED, _AROUND, _AFFECTED.format(most=50)))
def _(g):
    affected = traverse.affected_files(g.nodes, g.links, stats.top_target(g.nodes, g.links), most=50)
    return project.execution_waves(affected, architecture.classify(g.nodes)).select("wave", "id")


@on_graph("layers_involved", o.sql(f"SELECT coalesce(layer, 'unknown') AS layer, {COUNT} AS n FROM affected a LEFT JOIN classified c ON c.id = a.id GROUP BY 1", o.CLASSIFIED, o.DEGREES, _COLLAPSED, _AROUND, _AFFECTED.format(most=50)))
def _(g):
    affected = traverse.affected_files(g.nodes, g.links, stats.top_target(g.nodes, g.links), most=50)
    return project.layers_involved(affected, architecture.classify(g.nodes))


_LAYERED = "layered AS (SELECT d.*, layer FROM degrees d JOIN classified c USING (id) WHERE d.type = 'file')"


@on_graph(
    "entry_points",
    o.sql(
        "SELECT id, label, CAST(score AS BIGINT) AS score FROM (SELECT *, fan_out * 3 - fan_in + CASE layer WHEN 'integration' THEN 20 WHEN 'application' THEN 16 WHEN 'presentation' THEN 12 ELSE 0 END + CASE WHEN named THEN 25 ELSE 0 END AS score FROM (SELECT *, regexp_matches(lower(id), '(?:^|/)(main|app|server|cli|index|preload|worker|mcp|oracle)\\.(?:ts|tsx|js|jsx)$') AS named FROM layered) WHERE layer <> 'configuration' AND (named OR (layer = 'integration' AND fan_in = 0))) ORDER BY score DESC, label, id LIMIT 8",
        o.CLASSIFIED,
        o.DEGREES,
        _LAYERED,
    ),
)
def _(g):
    return project.entry_points(stats.degrees(g.nodes, g.links), architecture.classify(g.nodes))


@on_graph("core_orchestrators", o.sql(f"SELECT id, label, {BIG('fan_in + fan_out')} AS links FROM layered WHERE layer IN ('application', 'analysis', 'integration') AND fan_in + fan_out > 0 ORDER BY 3 DESC, label, id LIMIT 8", o.CLASSIFIED, o.DEGREES, _LAYERED))
def _(g):
    return project.orchestrators(stats.degrees(g.nodes, g.links), architecture.classify(g.nodes))


@on_graph("shared_foundations", o.sql(f"SELECT id, label, {BIG('fan_in')} AS fan_in FROM layered WHERE layer IN ('shared', 'state') AND fan_in > 0 ORDER BY layered.fan_in DESC, label, id LIMIT 8", o.CLASSIFIED, o.DEGREES, _LAYERED))
def _(g):
    return project.foundations(stats.degrees(g.nodes, g.links), architecture.classify(g.nodes))


@on_nodes("primary_technologies", o.sql(f"SELECT CASE ext WHEN '.ts' THEN 'TypeScript' WHEN '.tsx' THEN 'TypeScript' WHEN '.md' THEN 'Markdown' ELSE 'Other' END AS name, {COUNT} AS n FROM fx_files GROUP BY 1 ORDER BY n DESC, name LIMIT 5", base=[o.FILES]))
def _(g):
    return project.technologies(g.nodes)


@on_graph("key_boundaries", o.sql(f"SELECT source_layer, target_layer, {COUNT} AS n FROM edges WHERE source_layer <> target_layer GROUP BY ALL ORDER BY n DESC, source_layer, target_layer LIMIT 6", o.CLASSIFIED, o.EDGES))
def _(g):
    return project.key_boundaries(layered(g)[1])


@query("recent_projects_topk", "SELECT path, last_opened FROM (SELECT '/projects/user_' || user_id AS path, max(ts) AS last_opened FROM events GROUP BY 1) ORDER BY last_opened DESC, path LIMIT 10")
def _(spark, sf_dir):
    opened = read_table(spark, sf_dir, "events").select(F.concat(F.lit("\\projects\\user_"), F.col("user_id").cast("string")).alias("path"), F.col("event_type").alias("name"), "ts")
    return project.recent_projects(opened).select("path", "last_opened")


@on_graph("rename_preview", o.plain_sql("SELECT 'node' AS kind, id AS text FROM moved UNION ALL SELECT DISTINCT 'edge', source_id || ' -> ' || target_id || '' FROM (SELECT DISTINCT * FROM stored WHERE source_id IN (SELECT id FROM moved) OR target_id IN (SELECT id FROM moved))", o.STORED, "moved AS (SELECT id FROM nodes WHERE starts_with(id, '/proj/src/store/') OR split_part(id, '#', 1) = '/proj/src/store')"))
def _(g):
    return project.rename_preview(g.nodes, stats.graph_edges(g.nodes, g.links), "/proj/src/store").distinct()


@query("diff_between_versions", o.sql("SELECT 'removed' AS op, source, target FROM (SELECT source, target FROM fx_links_raw EXCEPT SELECT source, target FROM links) UNION ALL SELECT 'added', source, target FROM (SELECT source, target FROM links EXCEPT SELECT source, target FROM fx_links_raw)"))
def _(spark, sf_dir):
    raw, done = adapter.raw_graph(spark, sf_dir), adapter.graph(spark, sf_dir)
    return project.version_diff(raw.links, done.links, ["source", "target"])


@on_nodes("node_table_export_json", o.sql("SELECT '{\"id\":\"' || id || '\",\"type\":\"' || type || '\",\"label\":\"' || label || '\",\"filePath\":\"' || id || '\"}' AS line FROM nodes", base=FILES_ONLY))
def _(g):
    return g.nodes.select(F.to_json(F.struct("id", "type", "label", F.col("id").alias("filePath"))).alias("line"))


@on_graph("dot_export_lines", o.plain_sql("SELECT '  \"' || id || '\" [label=\"' || label || '\"];' AS line FROM nodes UNION ALL SELECT '  \"' || source_id || '\" -> \"' || target_id || '\" [label=\"' || type || '\"];' FROM stored", o.STORED))
def _(g):
    from sylvagraph.sinks.export import dot_lines

    return dot_lines(g.nodes, stats.graph_edges(g.nodes, g.links))


# Index and link resolution from one version to the next.
@query("incremental_link_resolution", o.sql("SELECT source, target, CAST(value AS INTEGER) AS value, type FROM links"))
def _(spark, sf_dir):
    """Two batches of files: links resolved against the first are resolved again only where they wait for files of the second."""
    raw = adapter.raw_graph(spark, sf_dir)
    nodes, links = cut(raw.nodes), cut(raw.links)
    late = F.crc32(F.substring_index("id", "#", 1).cast("binary")) % 4 == 0
    first = with_found(nodes.filter(~late), links)
    again = touched_links(waiting(links), nodes.filter(late).select(F.substring_index("id", "#", 1).alias("key")))
    return reresolved(first, again, nodes).select("source", F.col("found").alias("target"), "value", "type")


_TEXTS = "sources AS (SELECT id, partkey FROM fx_files WHERE type = 'file' AND ext IN ('.ts', '.tsx'))"


@query(
    "incremental_index",
    o.sql(
        """SELECT id, type FROM fx_files WHERE type = 'file' AND partkey % 7 <> 0
UNION ALL SELECT s.id, s.type FROM fx_symbols s JOIN sources f ON f.id = s.parent_id WHERE s.partkey % 7 <> 0
UNION ALL SELECT id || '#value', 'function' FROM sources WHERE partkey % 7 <> 0 AND (partkey % 3 = 0 OR partkey % 10 = 3)""",
        _TEXTS,
        base=[o.FILES, o.SYMBOLS],
    ),
)
def _(spark, sf_dir):
    """Nodes after a version in which files come, change and go; only the new texts of those are parsed."""
    texts, project_index = adapter.code_texts(spark, sf_dir), ProjectIndex(spark, f"{shared_folder(spark)}/index-{uuid.uuid4().hex}", adapter.ROOT)
    as_files = lambda df, text: df.select("path", F.timestamp_seconds(F.lit(0)).alias("mtime"), F.length(text).cast("bigint").alias("length"), F.col(text).alias("content"))
    new = F.col("partkey") % 10 == 3
    project_index.apply(as_files(texts.filter(~new), "declared"), spark.createDataFrame([], "path string"))
    changed, gone = texts.filter(new | (F.col("partkey") % 3 == 0)), texts.filter("partkey % 7 = 0").select("path")
    project_index.apply(as_files(changed.filter("partkey % 7 != 0"), "content"), gone)
    return project_index.graph().nodes.filter("type != 'directory'").select("id", "type")


@query(
    "parsed_facts",
    o.sql(
        """SELECT parent_id AS path, type AS kind, label AS name FROM fx_symbols WHERE parent_id IN (SELECT id FROM sources)
UNION ALL SELECT parent_id, 'export', label FROM fx_symbols WHERE parent_id IN (SELECT id FROM sources)
UNION ALL SELECT id, kind, name FROM sources, (VALUES (1, 'function', 'value'), (1, 'variable', 'value'), (71, 'variable', 'password'), (97, 'call', 'eval'), (89, 'call', 'getItem'), (83, 'call', 'execSync'), (73, 'call', 'log')) r(m, kind, name) WHERE partkey % m = 0
UNION ALL SELECT id, 'call', 'fetch' FROM sources WHERE partkey % 67 = 0 OR partkey % 61 = 0
UNION ALL SELECT id, 'comment', '// eval(x) localStorage.a execSync(c)' FROM sources WHERE partkey % 79 = 0
UNION ALL SELECT id, 'comment', '//' || host || '/x'');' FROM sources, (VALUES (67, 'example.org'), (61, 'localhost')) r(m, host) WHERE partkey % m = 0""",
        _TEXTS,
        base=[o.FILES, o.SYMBOLS],
    ),
)
def _(spark, sf_dir):
    """path, kind and name of all facts of the invented sources."""
    facts = parsed(adapter.code_texts(spark, sf_dir).withColumn("length", F.length("content").cast("bigint")))
    named = lambda kind, names: F.transform(names, lambda n: F.struct(F.lit(kind).alias("kind"), n.alias("name")))
    entities = F.transform("entities", lambda e: F.struct(e["type"].alias("kind"), e["name"].alias("name")))
    exports = named("export", F.transform("exports", lambda e: e["exported_name"]))
    each = F.concat(entities, exports, *(named(k, F.col(c)) for k, c in (("variable", "variables"), ("call", "calls"), ("comment", "comments"))))
    return facts.select("path", F.inline(each))


# Climbing, discovery in order, substrings, patterns.
@on_nodes("owning_file", o.sql("SELECT id, CASE WHEN type IN ('file', 'adr') THEN id WHEN type <> 'directory' THEN parent_id END AS owner FROM nodes", base=FILES_ONLY))
def _(g):
    return climb.owners(g.nodes.select("id"), g.nodes)


_PLACES = """places AS MATERIALIZED (
    SELECT a, b, min({{'incoming': incoming, 'ord': ord, 'b': b}}) AS place
    FROM (SELECT s AS a, t AS b, 0 AS incoming, ord FROM {pairs} UNION ALL SELECT t, s, 1, ord FROM {pairs}) WHERE a <> b GROUP BY a, b)"""
_QUEUE = """walks AS (
    SELECT id, 0 AS depth, CAST([] AS STRUCT(incoming INTEGER, ord BIGINT, b VARCHAR)[]) AS rank, [id] AS path FROM root
    UNION ALL SELECT b, depth + 1, list_append(rank, place), list_append(path, b) FROM walks JOIN places ON places.a = walks.id WHERE depth < {depth} AND NOT list_contains(path, b)
), found AS (SELECT id, depth, min(rank) AS rank, arg_min(path, rank) AS path FROM walks GROUP BY id, depth QUALIFY row_number() OVER (PARTITION BY id ORDER BY depth) = 1)"""
_ORDERED = "ordered AS MATERIALIZED (SELECT split_part(source, '#', 1) AS s, split_part(target, '#', 1) AS t, ord FROM links WHERE split_part(source, '#', 1) IN (SELECT id FROM nodes WHERE type = 'file') AND split_part(target, '#', 1) IN (SELECT id FROM nodes WHERE type = 'file'))"


@on_graph("affected_files_in_order", o.sql("SELECT id, depth, CAST(row_number() OVER (ORDER BY depth, rank) - 1 AS INTEGER) AS place FROM found ORDER BY depth, rank LIMIT 30", o.DEGREES, _ORDERED, _PLACES.format(pairs="ordered"), _QUEUE.format(depth=2)))
def _(g):
    return traverse.affected_in_order(g.nodes, g.links, stats.top_target(g.nodes, g.links).withColumn("start", F.lit(0)))


_EDGES_IN_ORDER = "ordered AS MATERIALIZED (SELECT source AS s, target AS t, ord FROM links WHERE source IN (SELECT id FROM nodes) AND target IN (SELECT id FROM nodes))"


@on_graph("blast_radius_v2_first_paths", o.sql("SELECT id, depth AS distance, array_to_string(path, ' > ') AS path FROM found WHERE depth > 0", o.DEGREES, _EDGES_IN_ORDER, _PLACES.format(pairs="ordered"), _QUEUE.format(depth=2)))
def _(g):
    found = traverse.first_paths(stats.ordered_edges(g.nodes, g.links), stats.top_target(g.nodes, g.links), 2)
    return found.select("id", "distance", F.array_join("path", " > ").alias("path"))


@query(
    "first_record_holding",
    o.sql("SELECT needle, arg_min(f.id, f.ord) AS id FROM (SELECT DISTINCT regexp_replace(label, '\\.[^.]+$', '') AS needle FROM fx_files UNION SELECT DISTINCT lower(replace(brand, '#', '_')) FROM fx_files) n JOIN fx_files f ON f.type = 'adr' AND contains(lower(f.id), needle) GROUP BY needle", base=[o.FILES]),
)
def _(spark, sf_dir):
    """Names of all files and brands as annotations, each with the first decision record whose id holds it."""
    found = adapter.files(spark, sf_dir)
    needles = found.select(F.regexp_replace("label", r"\.[^.]+$", "").alias("needle")).unionByName(found.select(F.lower(F.replace("brand", F.lit("#"), F.lit("_"))).alias("needle")))
    return first_holding(needles, found.filter("type = 'adr'").select("ord", "id", F.lower("id").alias("text")))


@query(
    "signature_search_regex",
    o.sql(
        "SELECT file_id AS node_id, symbol_id, CAST(line_no AS BIGINT) AS line FROM (SELECT c.*, f.ord AS file_ord, (SELECT arg_min(s.id, s.ord) FROM fx_symbols s WHERE s.parent_id = c.file_id AND contains(c.line, s.label)) AS symbol_id FROM code c JOIN fx_files f ON f.id = c.file_id WHERE regexp_matches(line, '\\b(class|function) sym_[0-9]*7\\b')) ORDER BY file_ord, line_no LIMIT 100",
        _CODE,
        base=[o.FILES, o.SYMBOLS],
    ),
)
def _(spark, sf_dir):
    g = adapter.raw_graph(spark, sf_dir)
    return search.signatures(g.nodes, adapter.code_lines(spark, sf_dir), r"\b(class|function) sym_[0-9]*7\b", limit=100, case_sensitive=True, regex=True).select("node_id", "symbol_id", "line")


@on_graph("dependency_nodes", o.sql("SELECT l.source AS origin, 'out' AS direction, n.id, n.label, n.type, l.type AS link_type FROM links l JOIN nodes n ON n.id = l.target UNION ALL SELECT l.target, 'in', n.id, n.label, n.type, l.type FROM links l JOIN nodes n ON n.id = l.source"))
def _(g):
    """Both sides of every node."""
    return stats.dependency_nodes(g.nodes, g.links, g.nodes).drop("ord")


@on_graph("related_records", o.sql("SELECT DISTINCT n.id AS origin, r.id FROM nodes n JOIN links l ON l.type = 'adr' AND (l.source = n.id OR l.target = n.id OR split_part(l.source, '#', 1) = split_part(n.id, '#', 1)) JOIN nodes r ON r.type = 'adr' AND r.id IN (l.source, l.target)"))
def _(g):
    return stats.related_records(g.nodes, g.links, g.nodes)
