"""The engine's tools, resources and composite contexts.

Each tool takes a graph and returns plain dicts and lists; everything before the last collect is a DataFrame. Lists are whole, but for
the full graph (with its truncated flag) and where a tool takes a limit.
Messages are codes. Classifications, edges and degrees are computed once a call.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sylvagraph.operators import activity, architecture, health, project, requests, search, security, stats, traverse
from sylvagraph.schema import CodeGraph

#: A finding of content needs the texts of files (id, text); without them names alone are judged.
Texts = DataFrame | None


def _rows(df: DataFrame, most: int | None = None) -> list[dict]:
    return [r.asDict(recursive=True) for r in (df if most is None else df.limit(most)).collect()]


def _one(graph: CodeGraph, node_id: str) -> DataFrame:
    found = graph.nodes.filter(F.col("id") == node_id).select("id").limit(1)
    if found.isEmpty():
        raise LookupError(f"no node {node_id!r}")
    return found


def _bounded(value: int, low: int, high: int) -> int:
    if not low <= value <= high:
        raise ValueError(f"{value} is not between {low} and {high}")
    return value


def _layers(graph: CodeGraph) -> tuple[DataFrame, DataFrame]:
    classified = architecture.classify(graph.nodes)
    return classified, architecture.layered_edges(graph.links, classified)


def _findings(graph: CodeGraph, texts: Texts) -> DataFrame:
    return security.name_findings(graph.nodes) if texts is None else security.findings(graph.nodes, texts)


def analyze_project(graph: CodeGraph) -> dict:
    return {"root": graph.root, **_rows(stats.totals(graph.nodes, graph.links))[0], "types": _rows(stats.counts_by_type(graph.nodes)), "languages": _rows(stats.language_profile(graph.nodes.filter("type in ('file', 'adr')")))}


def get_graph_context(graph: CodeGraph, include_full_graph: bool = False) -> dict:
    out = analyze_project(graph)
    return out | {"graph": _rows(stats.truncated(graph.nodes, graph.links), 3000)} if include_full_graph else out


def get_node_dependencies(graph: CodeGraph, node_id: str) -> dict:
    rows = _rows(stats.dependencies(graph.links, _one(graph, node_id)).orderBy("direction", "other", "type"))
    return {"dependencies": [r for r in rows if r["direction"] == "out"], "dependents": [r for r in rows if r["direction"] == "in"]}


def search_graph(graph: CodeGraph, query: str, type: str | None = None, limit: int = 20) -> list[dict]:
    return _rows(search.search(graph.nodes, query, type, _bounded(limit, 1, 100)).select("id", "label", "type"))


def get_blast_radius(graph: CodeGraph, node_id: str, depth: int = 3) -> dict:
    root, depth = _one(graph, node_id), _bounded(depth, 1, 20)
    return _rows(traverse.blast_summary(graph.nodes, graph.links, root, depth))[0] | {"nodes": _rows(traverse.blast_radius(graph.nodes, graph.links, root, depth).orderBy("depth", "id").select("id", "depth"))}


def get_health_score(graph: CodeGraph) -> dict:
    facts = health.facts(graph, *_layers(graph))
    return _rows(health.health_score(facts))[0] | {"issues": _rows(health.issues(facts))}


def get_architecture_overview(graph: CodeGraph, include_classifications: bool = False) -> dict:
    classified, edges = _layers(graph)
    out = {"summary": _rows(architecture.summary(classified, edges))[0], "layers": _rows(architecture.layer_counts(classified)), "dependencies": _rows(architecture.dependencies(edges)), "violations": _rows(architecture.violations(edges).orderBy("ord", "s", "t").drop("ord"))}
    return out | {"classifications": _rows(classified.orderBy("ord").select("id", "layer", "reason"))} if include_classifications else out


def detect_patterns(graph: CodeGraph, limit: int = 20) -> list[dict]:
    return _rows(health.pattern_summary(graph, *_layers(graph), traverse.hierarchy_depth(graph.nodes)), _bounded(limit, 1, 100))


def run_security_scan(graph: CodeGraph, texts: Texts = None, limit: int = 100) -> dict:
    found = _findings(graph, texts)
    return {"summary": _rows(security.severity_summary(found))[0], "findings": _rows(found.orderBy("node_id", "rule_id"), _bounded(limit, 1, 500))}


def search_signatures(graph: CodeGraph, lines: DataFrame, query: str, type: str | None = None, limit: int = 20, case_sensitive: bool = False, regex: bool = False) -> list[dict]:
    return _rows(search.signatures(graph.nodes, lines, query, type, limit, case_sensitive, regex))


def analyze_pr_impact(graph: CodeGraph, changed: DataFrame) -> dict:
    """``changed``: path (below the root), status, additions, deletions."""
    mine = graph.nodes.select("id", F.substring(F.substring_index("id", "#", 1), len(graph.root) + 2, 1 << 30).alias("file_path"))
    touched = mine.join(changed.select(F.col("path").alias("file_path")), "file_path", "left_semi")
    blast = activity.change_blast(mine, stats.neighbors(graph.nodes, stats.graph_edges(graph.nodes, graph.links), touched), changed)
    return _rows(activity.pr_summary(changed, blast))[0]


def analyze_activity_heatmap(commits: DataFrame, since: str | None = None, until: str | None = None, limit: int = 50) -> dict:
    found = activity.heatmap(commits, since, until)
    return {**_rows(activity.heatmap_globals(found))[0], "files": _rows(activity.heatmap_bands(found).orderBy(F.desc("commits"), "file_path"), limit)}


def calculate_blast_radius_v2(graph: CodeGraph, node_id: str, max_depth: int = 5) -> dict:
    """Nodes in the order in which a queue finds them, each with the way it was found by; the first ten ways of three steps or more."""
    root, edges = _one(graph, node_id), stats.ordered_edges(graph.nodes, graph.links)
    found = traverse.first_paths(edges, root, _bounded(max_depth, 1, 20)).persist()
    nodes = found.join(graph.nodes.select("id", "label", "type"), "id").orderBy("distance", "rank").select("id", "label", "type", "distance", "path")
    out = _rows(traverse.surroundings_summary(stats.graph_edges(graph.nodes, graph.links), root, max_depth))[0] | {"nodes": _rows(nodes), "risk_paths": [r["path"] for r in _rows(traverse.risk_paths(found).orderBy("place"))]}
    found.unpersist()
    return out


def prepare_project_context(graph: CodeGraph, texts: Texts = None, include_security_findings: bool = False, include_classifications: bool = False, limit: int = 10) -> dict:
    classified, edges = _layers(graph)
    degrees = stats.degrees(graph.nodes, graph.links)
    score = get_health_score(graph)
    found = _findings(graph, texts) if include_security_findings else None
    summary = _rows(security.severity_summary(found))[0] if found is not None else {"total": 0}
    grade = "strong" if score["score"] >= 90 and not score["violation_count"] and not summary["total"] else "fair" if score["score"] >= 75 and score["violation_count"] <= 5 else "weak"
    out = {
        "health": score, "maturity": grade, "architecture": _rows(architecture.summary(classified, edges))[0], "technologies": _rows(project.technologies(graph.nodes)),
        "entry_points": _rows(project.entry_points(degrees, classified)), "core_orchestrators": _rows(project.orchestrators(degrees, classified)),
        "shared_foundations": _rows(project.foundations(degrees, classified)), "key_boundaries": _rows(project.key_boundaries(edges)), "patterns": detect_patterns(graph, limit),
    }
    if found is not None:
        out["security"] = {"summary": summary, "findings": _rows(found.orderBy("node_id", "rule_id"), limit)}
    if include_classifications:
        out["classifications"] = _rows(classified.select("id", "layer", "reason").orderBy("id"))
    return out


#: How many related nodes, patterns, findings and files a change context shows.
MOST_NODES, MOST_PATTERNS, MOST_FINDINGS, MOST_FILES = 12, 8, 10, 15


def prepare_change_context(graph: CodeGraph, target: str, texts: Texts = None, type: str | None = None, depth: int = 3, include_security_findings: bool = False) -> dict:
    """What a change of a node touches. Related ids stay a table; lists are the first of their kind in store order."""
    node, others, how = search.resolve_target(graph.nodes, target, type)
    reason, exact = ("exact_id_match", True) if how == "exact_id" else search.match_reason(node, target)
    classified, edges = _layers(graph)
    file, root = F.lit(node["id"].split("#")[0]), graph.nodes.filter(F.col("id") == node["id"]).select("id")
    near = stats.dependency_nodes(graph.nodes, graph.links, root).persist()
    reached = traverse.blast_radius(graph.nodes, graph.links, root, _bounded(depth, 1, 20)).join(graph.nodes.select("id", "label", "type", "ord"), "id").persist()
    # Ids in the order in which they are recommended: the node, what it uses, what uses it, what else depends on it.
    group = F.when(F.col("direction") == "out", 1).otherwise(2)
    ordered = root.select("id", F.lit(0).alias("group"), F.lit(0).cast("bigint").alias("ord")).unionByName(near.select("id", group.alias("group"), "ord")).unionByName(reached.select("id", (F.col("depth") + 2).alias("group"), "ord"))
    files = ordered.groupBy(F.substring_index("id", "#", 1).alias("id")).agg(F.min(F.struct("group", "ord")).alias("first"))
    related = ordered.select(F.col("id").alias("node_id")).unionByName(files.select(F.col("id").alias("node_id"))).distinct()
    patterns = health.pattern_rows(graph, classified, traverse.hierarchy_depth(graph.nodes)).join(related, "node_id", "left_semi")
    shown = lambda df, *columns: _rows(df.select(*columns), MOST_NODES)
    side = lambda d: near.filter(F.col("direction") == d).orderBy("ord")
    records = stats.related_records(graph.nodes, graph.links, root).select("id").join(graph.nodes.select("id", "label", "ord"), "id").orderBy("ord")
    out = {
        "target": node, "exact_match": exact, "alternatives": others, "match": how, "match_reason": reason,
        "layer": _rows(classified.filter(F.col("id") == node["id"]).select("layer", "reason"))[0],
        "architecture": {"summary": _rows(architecture.summary(classified, edges))[0], "dependencies": _rows(architecture.dependencies(edges), 10)},
        "dependencies": {"outgoing": shown(side("out"), "id", "label", "type", "link_type"), "incoming": shown(side("in"), "id", "label", "type", "link_type"), "records": shown(records, "id", "label")},
        "blast_radius": _rows(traverse.blast_summary(graph.nodes, graph.links, root, depth))[0] | {"direct": shown(reached.filter("depth = 1").orderBy("ord"), "id", "label", "type"), "nodes": shown(reached.orderBy("depth", "ord"), "id", "label", "type", "depth")},
        "violations": _rows(architecture.violations(edges).filter((F.col("s") == file) | (F.col("t") == file)).orderBy("ord", "s", "t").drop("ord"), 100),
        "patterns": _rows(patterns.groupBy("pattern_id").agg(F.count(F.lit(1)).alias("n")).orderBy("pattern_id"), MOST_PATTERNS),
        "recommended_files": [r["id"] for r in _rows(files.orderBy("first", "id").select("id"), MOST_FILES)],
    }
    if include_security_findings:
        out["findings"] = _rows(_findings(graph, texts).join(files.select(F.col("id").alias("node_id")), "node_id", "left_semi").orderBy("node_id", "rule_id"), MOST_FINDINGS)
    near.unpersist()
    reached.unpersist()
    return out


def prepare_review_context(graph: CodeGraph, texts: Texts = None, focus_query: str | None = None, include_security_findings: bool = True, limit: int = 10) -> dict:
    overview, score = get_architecture_overview(graph), get_health_score(graph)
    found = run_security_scan(graph, texts, limit) if include_security_findings else None
    priorities = [f"health:{i['code']}" for i in score["issues"]] + [f"pattern:{p['pattern_id']}" for p in detect_patterns(graph, limit)]
    priorities = ([f"security:{s}" for s in ("critical", "high") if found and found["summary"][s]] + priorities)[:6]
    focus = _rows(search.ranked_search(graph.nodes, focus_query, None, 5).select("id", "label", "type", "score")) if focus_query else []
    return {"architecture": overview["summary"], "violations": overview["violations"][:limit], "health": score, "security": found, "focus": focus, "priorities": priorities}


def prepare_change_campaign(graph: CodeGraph, user_request: str, candidate_queries: list[str] | None = None, seed_node_ids: list[str] | None = None, depth: int = 2, max_seeds: int = 10, max_files: int = 50) -> dict:
    spark = graph.nodes.sparkSession
    asked = candidate_queries or _inferred(spark, user_request)["keywords"]
    queries = spark.createDataFrame([(q,) for q in asked], "query string")
    classified = architecture.classify(graph.nodes)
    chosen = _rows(project.campaign_seeds(graph.nodes, classified, queries, seed_node_ids, _bounded(max_seeds, 1, 30)))
    seeds = spark.createDataFrame([(r["id"], i) for i, r in enumerate(chosen)], "id string, place int")
    matched = project.matched_files(graph.nodes, seeds, queries, max_seeds).persist()
    affected = traverse.affected_in_order(graph.nodes, graph.links, matched, depth, _bounded(max_files, 1, 100)).persist()
    count = affected.count()
    out = {
        "seeds": chosen, "matched_files": [r["id"] for r in _rows(matched.orderBy("start"))], "affected_files": _rows(affected.orderBy("place")), "breadth": project.breadth(count), "waves": _rows(project.execution_waves(affected, classified)),
        "layers": _rows(project.layers_involved(affected, classified)), "blast": _rows(traverse.blast_summary(graph.nodes, graph.links, matched, depth).select("seed_id", "affected_nodes", "confidence").orderBy("seed_id")),
    }
    matched.unpersist()
    affected.unpersist()
    return out


def _inferred(spark, text: str) -> dict:
    return _rows(requests.inferred(spark.createDataFrame([(text,)], "text string")))[0]


def prepare_task_context(graph: CodeGraph, user_request: str, texts: Texts = None, depth: int = 3, limit: int = 10) -> dict:
    """The request's intent and keywords, candidates, and the context that suits it: campaign, change, review or project."""
    spark = graph.nodes.sparkSession
    found = _inferred(spark, user_request)
    queries = spark.createDataFrame([(q,) for q in found["keywords"]], "query string")
    candidates = _rows(search.target_candidates(graph.nodes, queries))
    broad = any(w in user_request.lower() for w in requests.HINTS["campaign"])
    if found["task_kind"] == "refactor" and broad:
        route, context = "campaign", prepare_change_campaign(graph, user_request, found["keywords"])
    elif found["task_kind"] in ("review", "architecture", "security", "stabilization"):
        route, context = "review", prepare_review_context(graph, texts, limit=limit)
    elif candidates and found["task_kind"] != "explore":
        route, context = "change", prepare_change_context(graph, candidates[0]["id"], texts, depth=depth)
    else:
        route, context = "project", prepare_project_context(graph, texts, limit=limit)
    return {"intent": {k: found[k] for k in ("task_kind", "confidence", "keywords")}, "candidates": candidates, "route": route, "context": context}


TOOLS: dict[str, Callable] = {
    f.__name__: f
    for f in (
        analyze_project, get_graph_context, get_node_dependencies, search_graph, get_blast_radius, get_health_score, get_architecture_overview, detect_patterns, run_security_scan,
        search_signatures, analyze_pr_impact, analyze_activity_heatmap, calculate_blast_radius_v2, prepare_project_context, prepare_task_context, prepare_change_campaign, prepare_change_context, prepare_review_context,
    )
}

RESOURCES: dict[str, Callable[[CodeGraph], object]] = {
    "project/summary": analyze_project,
    "graph/full": lambda g: get_graph_context(g, True),
    "agent/playbook": lambda g: ["prepare_task_context", "prepare_change_context", "get_blast_radius", "detect_patterns", "prepare_review_context"],
    "agent/project-brain": prepare_project_context,
}


def text_content(value: object) -> str:
    """A fenced JSON block."""
    return "```json\n" + json.dumps(value, indent=2, default=str, ensure_ascii=False) + "\n```"
