"""Snapshots, and traversals of deep and dense graphs."""

from pyspark.sql import functions as F

from sylvagraph.operators import traverse
from sylvagraph.schema import LINKS, NODES, CodeGraph
from sylvagraph.sources import cache, versions


def graph(spark, root="/p"):
    node = lambda i, kind, parent=None: (i, i.split("/")[-1], 0, kind, 0, None, parent, None, 0)
    nodes = [node("/p/old", "directory"), node("/p/src\\a.ts", "file", "x"), node("/p/src/b.ts", "file"), node("/p/src/b.ts#f", "function", "y"), node("/p/c.md", "adr", "z")]
    links = [("/p/src\\a.ts", "/p/src/b.ts", 1, "import", 0), ("/p/old", "/p/c.md", 1, "structure", 1)]
    return CodeGraph(spark.createDataFrame(nodes, NODES), spark.createDataFrame(links, LINKS), root)


def test_snapshot_round_trip(spark, tmp_path):
    base = str(tmp_path / "cache")
    assert cache.load(spark, base, "/p") is None
    g = cache.restored(graph(spark))
    files = spark.createDataFrame([("/p/src/a.ts", "2024-01-01"), ("/p/src/b.ts", "2024-01-02"), ("/p/other", "2024-01-02")], "path string, mtime string").withColumn("mtime", F.to_timestamp("mtime"))
    cache.save(g, files, base)
    found, stats = cache.load(spark, base, "/p")
    assert sorted(r.path for r in stats.collect()) == ["/p/src/a.ts", "/p/src/b.ts"]
    parents = {r.id: r.parent_id for r in found.nodes.collect()}
    assert parents == {"/p/old": None, "/p/src/a.ts": "/p/src", "/p/src/b.ts": "/p/src", "/p/src/b.ts#f": "/p/src/b.ts", "/p/c.md": None}
    left = cache.with_directories(cache.purged(found, stats, files.filter("path != '/p/src/b.ts'")))
    assert sorted(r.id for r in left.nodes.collect()) == ["/p/c.md", "/p/src", "/p/src/a.ts"]
    assert [r.target for r in cache.without_directory(found, "/p/old").links.collect()] == ["/p/src/b.ts"]


def test_a_restored_snapshot_can_be_saved_again(spark, tmp_path):
    base = str(tmp_path / "cache")
    files = spark.createDataFrame([("/p/src/a.ts", "2024-01-01"), ("/p/src/b.ts", "2024-01-02")], "path string, mtime string").withColumn("mtime", F.to_timestamp("mtime"))
    g = cache.restored(graph(spark))
    first = {tuple(r) for r in g.nodes.select("id", "parent_id", "type").collect()}
    path = cache.snapshot_path(base, "/p")
    for turn in range(3):
        cache.save(g, files, base)
        g, stats = cache.load(spark, base, "/p")
        g = cache.restored(g)
        assert {tuple(r) for r in g.nodes.select("id", "parent_id", "type").collect()} == first and stats.count() == 2
        assert versions.current(spark, path)[0] == turn
    # A version without a manifest, as a crash leaves it, isn't read.
    g.nodes.limit(0).write.parquet(f"{path}/version=3/nodes")
    assert cache.load(spark, base, "/p")[0].nodes.count() == 5
    versions.forget(spark, path, keep=1)
    assert cache.load(spark, base, "/p")[0].nodes.count() == 5 and not (tmp_path / "cache").joinpath(path.split("/")[-1], "version=0").exists()


def test_graphs_are_made_once_a_revision(spark, tmp_path):
    import os
    import shutil
    from pathlib import Path

    from sylvagraph.sources import adapter

    made = []
    memo = versions.Memo(most=2)
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x").write_text("1")
    get = lambda: memo.get(spark, [str(tmp_path / "a")], lambda: made.append(1) or len(made))
    assert (get(), get()) == (1, 1)
    (tmp_path / "a" / "x").write_text("12")
    assert (get(), get(), len(memo.held)) == (2, 2, 2)
    os.utime(tmp_path / "a" / "x", (1, 1))
    assert (get(), len(memo.held)) == (3, 2)
    for name in ("part", "lineitem", "events"):
        shutil.copy(f"/root/testdata/sf0.001/{name}.parquet", tmp_path)
    one, two = adapter.graph(spark, str(tmp_path)), adapter.graph(spark, str(tmp_path))
    assert one is two
    part = Path(tmp_path / "part.parquet")
    spark.read.parquet(str(part)).limit(50).toPandas().to_parquet(part)
    assert adapter.graph(spark, str(tmp_path)).nodes.count() < one.nodes.count()


def test_chains_have_no_end_but_their_own(spark):
    chain = spark.createDataFrame([(f"n{i}", f"n{i + 1}" if i < 100 else None) for i in range(101)], "id string, parent_id string")
    depth = {r.id: r.depth for r in traverse.hierarchy_depth(chain).collect()}
    assert depth["n0"] == 100 and depth["n100"] == 0
    ring = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a")], "id string, parent_id string")
    assert traverse.parent_chain(ring).count() == 9


def test_short_cycles_and_hints(spark):
    edges = [("a", "b"), ("b", "a"), ("c", "d"), ("d", "e"), ("e", "c"), ("x", "y"), ("y", "z"), *((f"in{i}", "hub") for i in range(30)), *(("hub", f"out{i}") for i in range(30)), ("out3", "in7")]
    df = spark.createDataFrame(edges, "source_id string, target_id string")
    found = {r.id: r.length for r in traverse.short_cycles(df).collect()}
    assert found == {"a": 2, "b": 2, "c": 3, "d": 3, "e": 3, "hub": 3, "out3": 3, "in7": 3}
    nodes = spark.createDataFrame([("a",), ("hub",), ("x",)], "id string")
    assert {tuple(r) for r in traverse.pattern_hints(nodes, df).collect()} == {("a", True, False), ("hub", True, True), ("x", False, False)}
