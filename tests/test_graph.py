"""Operators on small graphs written by hand."""

import pytest
from pyspark.sql import functions as F

from sylvagraph.operators import activity, architecture, health, project, requests, search, security, stats, traverse
from sylvagraph.operators.resolve import resolve_links
from sylvagraph.schema import LINKS, NODES, CodeGraph


def nodes(spark, *ids, parents=None, exports=None, types=None):
    rows = [(i, i.rsplit("/", 1)[-1].split("#")[-1], 1, (types or {}).get(i, "function" if "#" in i else "file"), 1, None, (parents or {}).get(i), (exports or {}).get(i), n) for n, i in enumerate(ids)]
    return spark.createDataFrame(rows, NODES)


def links(spark, *pairs, kind="import"):
    return spark.createDataFrame([(a, b, 1, kind, n) for n, (a, b) in enumerate(pairs)], LINKS)


def pairs(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_resolution_tries_suffixes_exports_and_files_in_order(spark):
    n = nodes(spark, "/p/x.ts", "/p/x.tsx", "/p/d/index.ts", "/p/x.ts#f", "/p/x.ts#main", exports={"/p/x.ts": [("g", "f", False), ("main", "main", True)]})
    asked = ["/p/x", "/p/d", "/p/x#f", "/p/x#g", "/p/x#default", "/p/x#nope", "/p/missing", "/p/x.tsx"]
    found = {r.source: r.target for r in resolve_links(n, links(spark, *((f"s{i}", t) for i, t in enumerate(asked)))).collect()}
    assert [found.get(f"s{i}") for i in range(len(asked))] == ["/p/x.ts", "/p/d/index.ts", "/p/x.ts#f", "/p/x.ts#f", "/p/x.ts#main", "/p/x.ts", None, "/p/x.tsx"]


def test_resolution_keeps_duplicates_and_is_idempotent(spark):
    n = nodes(spark, "a", "b.ts")
    twice = links(spark, ("a", "b"), ("a", "b"))
    once = resolve_links(n, twice)
    assert pairs(once, "source", "target") == [("a", "b.ts")] * 2
    assert pairs(resolve_links(n, once), "source", "target") == [("a", "b.ts")] * 2


@pytest.mark.parametrize("depth,affected,touched", [(1, 1, 1), (2, 2, 2), (3, 3, 3), (4, 3, 3)])
def test_blast_radius_of_a_chain(spark, depth, affected, touched):
    n, e = nodes(spark, *"abcd"), links(spark, ("b", "a"), ("c", "b"), ("d", "c"))
    row = traverse.blast_summary(n, e, n.filter("id = 'a'").select("id"), depth).first()
    assert (row.affected_nodes, row.affected_links, row.direct_dependents, row.max_depth, row.confidence) == (affected, touched, 1, min(depth, 3), "high")


def test_blast_radius_counts_all_links_but_nodes_once(spark):
    n = nodes(spark, *"abcd")
    root = n.filter("id = 'a'").select("id")
    diamond = traverse.blast_summary(n, links(spark, ("b", "a"), ("c", "a"), ("d", "b"), ("d", "c")), root).first()
    assert (diamond.affected_nodes, diamond.affected_links) == (3, 4)
    double = traverse.blast_summary(n, links(spark, ("b", "a"), ("b", "a")), root).first()
    assert (double.affected_nodes, double.direct_dependents) == (1, 2)
    ring = traverse.blast_summary(n, links(spark, ("b", "a"), ("c", "b"), ("a", "c")), root).first()
    assert (ring.affected_nodes, ring.affected_links) == (2, 3)
    alone = traverse.blast_summary(n, links(spark, ("b", "c")), root).first()
    assert (alone.affected_nodes, alone.max_depth, alone.confidence) == (0, 0, "low")


def test_cycles_of_two_and_three_only(spark):
    def edges(*p):
        return spark.createDataFrame(list(p), "source_id string, target_id string")

    assert pairs(traverse.short_cycles(edges(("a", "b"), ("b", "c"), ("c", "a"))), "id", "length") == [("a", 3), ("b", 3), ("c", 3)]
    assert pairs(traverse.short_cycles(edges(("a", "b"), ("b", "c"), ("c", "d"), ("d", "a"))), "id") == []
    assert pairs(traverse.short_cycles(edges(("a", "b"), ("b", "a"), ("a", "a"))), "id", "length") == [("a", 2), ("b", 2)]


def test_parent_cycles_end(spark):
    n = nodes(spark, "p", "q", "r", parents={"p": "q", "q": "p", "r": "q"})
    assert {r.id: r.depth for r in traverse.hierarchy_depth(n).collect()} == {"p": 2, "q": 2, "r": 2}
    assert pairs(traverse.nearest_ancestor(n, F.col("id") == "p"), "id", "ancestor") == [("p", "p"), ("q", "p"), ("r", "p")]


def test_hub_threshold_and_dangling_links(spark):
    names = [f"f{i}" for i in range(9)]
    n = nodes(spark, "hub", *names)
    few, many = links(spark, *((f, "hub") for f in names[:7])), links(spark, *((f, "hub") for f in names[:8]), ("hub", "gone"))
    assert health.hub_nodes(stats.degrees(n, few)).count() == 0
    assert health.hub_nodes(stats.degrees(n, many)).first().metric == 8
    assert health.unresolved_imports(n, many).count() == 1
    assert stats.graph_edges(n, many).count() == 8


@pytest.mark.parametrize("source,target,broken", [("domain", "shared", False), ("domain", "application", True), ("shared", "state", True), ("state", "domain", False), ("application", "presentation", True), ("analysis", "integration", True), ("analysis", "state", False), ("unknown", "presentation", False), ("presentation", "presentation", False), ("configuration", "presentation", True)])
def test_violations(spark, source, target, broken):
    row = spark.range(1).select(architecture.is_violation(F.lit(source), F.lit(target)).alias("v")).first()
    assert row.v == broken


@pytest.mark.parametrize("path,layer", [("/p/src/components/A.tsx", "presentation"), ("/p/README.md", "configuration"), ("/p/src/layout/x.ts", "unknown"), ("/p/src/oracle/x.ts", "application"), ("/p/electron/main.ts", "integration"), ("/p/types.d.ts", "shared"), ("/p/src/services/a.ts#f", "application")])
def test_layers(spark, path, layer):
    assert architecture.classify(nodes(spark, path)).first().layer == layer


def test_empty_graph(spark):
    g = CodeGraph(spark.createDataFrame([], NODES), spark.createDataFrame([], LINKS), "/p")
    classified = architecture.classify(g.nodes)
    row = health.health_score(health.facts(g, classified, architecture.layered_edges(g.links, classified))).first()
    assert (row.score, row.grade, row.coverage) == (30, "F", 1.0)
    assert search.ranked_search(g.nodes, "x").count() == 0


@pytest.mark.parametrize("changes,blast,count,level", [(50, 5, 5, "low"), (51, 0, 0, "medium"), (200, 20, 10, "medium"), (0, 21, 0, "high"), (501, 0, 0, "critical"), (0, 0, 21, "critical")])
def test_change_risk(spark, changes, blast, count, level):
    assert spark.range(1).select(activity.risk(F.lit(changes), F.lit(blast), F.lit(count)).alias("r")).first().r == level


def test_security_rules_ignore_strings_and_comments(spark):
    texts = {"/p/a.ts": "eval(x)", "/p/b.ts": "// eval(x)\nconst s = 'eval(x)';", "/p/c.ts": "fetch('http://example.org')\n", "/p/d.ts": "x = 'http://localhost/a'", "/p/layout/e.ts": "eval(x)", "/p/f.ts": "const token = \"abcdefgh1\"", "/p/g.ts": "ätoken = \"abcdefgh1\""}
    n = nodes(spark, *texts, "/p/secret.key")
    found = security.findings(n, spark.createDataFrame(list(texts.items()), "id string, text string"))
    assert pairs(found, "rule_id", "node_id") == [("dynamic_code_execution", "/p/a.ts"), ("hardcoded_secret", "/p/f.ts"), ("hardcoded_secret", "/p/g.ts"), ("insecure_http_url", "/p/c.ts"), ("sensitive_file_name", "/p/secret.key")]


@pytest.mark.parametrize("text,kind", [("The login is broken", "bugfix"), ("auth token issue", "security"), ("Migrate all services: replace the library", "refactor"), ("please refactor this", "refactor"), ("add support for x", "feature"), ("архитектура", "architecture"), ("hello", "explore")])
def test_intent(spark, text, kind):
    assert requests.inferred(spark.createDataFrame([(text,)], "text string")).first().task_kind == kind


def test_keywords(spark):
    row = requests.inferred(spark.createDataFrame([("Why is 'Login Form' in auth.ts broken for users?",)], "text string")).first()
    assert row.keywords[:2] == ["login form", "auth.ts"] and "users" not in row.keywords and len(row.keywords) == 8


def test_signatures(spark):
    n = nodes(spark, "/p/a.ts", "/p/a.ts#run", parents={"/p/a.ts#run": "/p/a.ts"})
    lines = spark.createDataFrame([("/p/a.ts", 1, "export function run() {"), ("/p/a.ts", 2, "  run();"), ("/p/a.ts", 3, "const other = (a) => a;")], "file_id string, line_no long, line string")
    assert pairs(search.signatures(n, lines, "RUN"), "symbol_id", "line") == [("/p/a.ts#run", 1)]
    assert search.signatures(n, lines, " ").count() == 0
    with pytest.raises(ValueError):
        search.signatures(n, lines, "(a+)+b", regex=True)


def test_rename_moves_symbols(spark):
    n = project.renamed(nodes(spark, "/p/a/x.ts", "/p/a/x.ts#f", "/p/ab.ts"), "/p/a", "/p/b")
    assert pairs(n, "id") == [("/p/ab.ts",), ("/p/b/x.ts",), ("/p/b/x.ts#f",)]
