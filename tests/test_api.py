"""Shapes of the tools' answers over the adapter's graph."""

import pytest

from sylvagraph import api
from sylvagraph.operators import security, stats
from sylvagraph.schema import CodeGraph
from sylvagraph.sources import adapter


@pytest.fixture(scope="module")
def graph(spark, sf_dir):
    g = adapter.graph(spark, sf_dir)
    return CodeGraph(g.nodes.persist(), g.links.persist(), g.root)


def test_tools(spark, sf_dir, graph):
    root = stats.top_target(graph.nodes, graph.links).first().id
    assert len(api.TOOLS) == 18
    assert api.analyze_project(graph)["node_count"] == graph.nodes.count()
    assert api.get_node_dependencies(graph, root)["dependents"]
    assert 0 < len(api.search_graph(graph, "part_1", limit=5)) <= 5
    assert api.get_blast_radius(graph, root, 2)["affected_nodes"] > 0
    assert 0 <= api.get_health_score(graph)["score"] <= 100
    lines = adapter.code_lines(spark, sf_dir)
    assert api.run_security_scan(graph, security.texts_of(lines))["summary"]["total"] > 0
    assert api.search_signatures(graph, lines, "sym_", limit=3)
    assert api.calculate_blast_radius_v2(graph, root, 2)["direct"] > 0
    assert api.analyze_activity_heatmap(adapter.commits(spark, sf_dir))["total_files"] > 0
    none = spark.createDataFrame([], "path string, status string, additions long, deletions long")
    assert api.analyze_pr_impact(graph, none)["risk"] == "low"
    with pytest.raises(LookupError):
        api.get_blast_radius(graph, "nowhere")
    with pytest.raises(ValueError):
        api.search_graph(graph, "x", limit=0)


def test_contexts(graph):
    found = api.prepare_change_context(graph, "part_11", include_security_findings=True)
    assert found["target"]["label"].startswith("part_11") and found["recommended_files"][0] == found["target"]["id"].split("#")[0]
    assert found["match_reason"] == "basename_without_extension_match" and found["exact_match"] and len(found["recommended_files"]) <= 15
    whole = api.prepare_change_context(graph, found["target"]["id"].upper())
    assert (whole["match_reason"], whole["target"]["id"], whole["alternatives"]) == ("exact_id_match", found["target"]["id"], [])
    task = api.prepare_task_context(graph, "Replace part_12 across all services")
    assert task["route"] == "campaign" and task["context"]["seeds"]
    assert len(api.prepare_review_context(graph, focus_query="services")["priorities"]) <= 6
    assert api.text_content({"a": 1}).startswith("```json\n{")
