"""Answers of the tools about nodes with more links than any list used to hold."""

from pyspark.sql import functions as F

from sylvagraph import api
from sylvagraph.schema import CodeGraph
from sylvagraph.sources import adapter


def test_lists_of_a_hub_are_whole(spark, sf_dir):
    g = adapter.graph(spark, sf_dir)
    hub = g.nodes.filter("type = 'file'").orderBy("ord").limit(1)
    hub_id = hub.first().id
    others = hub.crossJoin(spark.range(1500).select("id").withColumnRenamed("id", "k"))
    added = others.select(*(F.concat(F.col("id"), F.lit("_"), "k").alias("id") if c == "id" else F.col(c) for c in g.nodes.columns))
    link = g.links.limit(1)
    into = link.crossJoin(added.select(F.col("id").alias("new_id"))).withColumns({"source": F.col("new_id"), "target": F.lit(hub_id)}).select(*g.links.columns)
    out = link.crossJoin(added.select(F.col("id").alias("new_id")).limit(3)).withColumns({"source": F.lit(hub_id), "target": F.col("new_id")}).select(*g.links.columns)
    graph = CodeGraph(hub.select(*g.nodes.columns).unionByName(added).persist(), into.unionByName(out).persist(), g.root)
    found = api.get_node_dependencies(graph, hub_id)
    assert len(found["dependents"]) == 1500 and len(found["dependencies"]) == 3
    assert len(api.get_blast_radius(graph, hub_id, 1)["nodes"]) >= 1500
    assert len(api.calculate_blast_radius_v2(graph, hub_id, 1)["nodes"]) >= 1500
    assert len(api.get_architecture_overview(graph, True)["classifications"]) == 1501
