"""Work that grows with the input is done once a row, and only where it is asked for."""

from pyspark.sql import functions as F

from sylvagraph.operators import architecture, project, search, stats
from sylvagraph.operators.traverse import pattern_hints
from sylvagraph.sinks import skills


def plan(df):
    return df._jdf.queryExecution().analyzed().toString()


def test_an_extension_is_cut_off_once_a_row(spark):
    paths = ["/p/a.ts", "/p/b.TSX", "c.d.hpp", "/p/.ts", "x", "", None, "/p/a.unknown", "/p/x.md"]
    df = spark.createDataFrame([(p,) for p in paths], "path string").select("path", stats.language_of(F.col("path")).alias("language"))
    assert plan(df).count("regexp_extract") == 1
    assert [r.language for r in df.collect()] == ["typescript", "tsx", "cpp", None, None, None, None, None, "markdown"]


def test_names_are_made_once_a_node_and_other_layers_read_only_if_nothing_matches(spark):
    rows = [(f"/p/{d}/part_{i}.ts", f"part_{i}.ts", "file", None, i) for i, d in enumerate(["api", "store", "services", "utils"])]
    nodes = spark.createDataFrame(rows, "id string, label string, type string, exports string, ord long")
    asked = lambda q: spark.createDataFrame([(q,)], "query string")
    assert plan(search.best_scores(nodes, asked("Part_2"), "campaign")).count("lower(id") == 3  # of the id, its base name and its stem
    some = project.campaign_seeds(nodes, architecture.classify(nodes), asked("part_2"))
    assert [r.id for r in some.collect()] == ["/p/services/part_2.ts"] and "label" in some.columns and "no_rule_matched" not in plan(some)
    none = project.campaign_seeds(nodes, architecture.classify(nodes), asked("zzz"))
    assert [r.id for r in none.collect()] == ["/p/api/part_0.ts", "/p/services/part_2.ts"]


def test_hints_of_some_nodes_need_the_edges_around_them(spark):
    pairs = [("a", "b"), ("b", "a"), ("c", "d"), ("d", "e"), ("e", "c"), ("f", "g"), ("x", "y"), ("y", "x"), *(("h", f"n{i}") for i in range(12)), ("n1", "n2"), ("n2", "q")]
    edges = spark.createDataFrame([(s, t, "imports") for s, t in pairs], "source_id string, target_id string, type string")
    nodes = spark.createDataFrame([(i,) for i in sorted({x for p in pairs for x in p} | {"alone"})], "id string")
    whole = {r.id: (r.in_cycle, r.crowded) for r in pattern_hints(nodes, edges).collect()}
    for some in (["a"], ["c"], ["f", "h"], ["n2", "alone"], list(whole)):
        asked = spark.createDataFrame([(i,) for i in some], "id string")
        around = skills.edges_around(edges, asked)
        got = {r.id: (r.in_cycle, r.crowded) for r in pattern_hints(asked, around).collect()}
        assert got == {i: whole[i] for i in some}
    assert skills.edges_around(edges, spark.createDataFrame([("a",)], "id string")).count() == 2
