"""Trees, settings, notes, texts and events of folders."""

from pyspark.sql import functions as F

from sylvagraph.functions import texts
from sylvagraph.operators import traverse
from sylvagraph.sinks import skills
from sylvagraph.sources import settings
from sylvagraph.streaming import watcher


def test_tree_cuts_circles_and_hidden_parents(spark):
    rows = [("top", None), ("mid", "top"), ("leaf", "mid"), ("lost", "nowhere"), ("a", "b"), ("b", "a"), ("on", "a"), ("hid", "top"), ("kid", "hid")]
    nodes = spark.createDataFrame(rows, "id string, parent_id string")
    found = {r.id: r.parent for r in traverse.tree(nodes, F.col("id") != "hid").collect()}
    assert found == {"top": None, "mid": "top", "leaf": "mid", "lost": None, "a": None, "b": None, "on": None, "kid": None}


def test_orders(spark):
    nodes = spark.createDataFrame([("1", "x", "adr"), ("2", "b", "file"), ("3", "a", "odd"), ("4", "a", "file"), ("5", "z", "directory")], "id string, label string, type string")
    assert [r.id for r in traverse.in_layout_order(nodes).collect()] == ["5", "4", "2", "1", "3"]
    entries = traverse.path_trie(spark.createDataFrame([("/p/b.ts",), ("/p/z/a.ts",)], "id string"), "/p")
    assert [r.path for r in traverse.in_tree_order(entries).collect()] == ["z", "b.ts", "z/a.ts"]


def test_settings(spark, tmp_path):
    base = str(tmp_path / "kv")
    settings.put(spark, base, {"a": "1", "b": "2"})
    settings.put(spark, base, {"a": "3"})
    settings.remove(spark, base, ["b", "none"])
    assert (settings.get(spark, base, "a"), settings.get(spark, base, "b"), settings.get(spark, base, "x")) == ("3", None, None)
    lists = spark.createDataFrame([('[{"path": "C:\\\\x", "name": "x", "lastOpened": "2024-01-01T00:00:00Z"}, {"path": "/y", "name": "y", "lastOpened": "2024-02-01T00:00:00Z"}]',), ("not json",), (None,)], "value string")
    assert [(r.path, r.name) for r in settings.projects_of(lists).collect()] == [("/y", "y"), ("C:/x", "x")]


def test_texts(spark):
    now = F.to_timestamp(F.lit("2024-03-10 12:00:00"))
    cases = {"2024-03-10 11:59:30": "just now", "2024-03-10 11:01:00": "59m ago", "2024-03-09 12:01:00": "23h ago", "2024-03-04 12:00:00": "6d ago", "2024-03-03 12:00:00": "Mar 3, 2024"}
    df = spark.createDataFrame([(c,) for c in cases], "at string")
    assert {r.at: r.age for r in df.select("at", texts.age(F.to_timestamp("at"), now).alias("age")).collect()} == cases
    row = spark.range(1).select(texts.slug(F.lit("App.Main_1")).alias("s"), texts.percent(F.lit(0.12345)).alias("p")).first()
    assert (row.s, row.p) == ("app-main-1", "12.3%")
    words = spark.createDataFrame([("b",), ("A",), ("a",), ("B",)], "w string")
    assert [r.w for r in words.orderBy(texts.collated(F.col("w"))).collect()] == ["a", "A", "b", "B"]


def test_skills(spark, tmp_path):
    nodes = spark.createDataFrame([("/p/A b.ts", "A b.ts", "file", 1), ("/p/.x/c.ts", "c.ts", "file", 0), ("/p/d.ts", "d.ts", "file", 2)], "id string, label string, type string, ord long")
    edges = spark.createDataFrame([("/p/A b.ts", "/p/d.ts"), ("/p/d.ts", "/p/A b.ts")], "source_id string, target_id string")
    found = skills.skills(nodes, edges, skills.project_files(nodes, 1))
    assert [(r.node_id, r.file_name, "circular" in r.text) for r in found.collect()] == [("/p/A b.ts", "a-b-ts-context.md", True)]
    skills.write_skills(found, str(tmp_path / "skills"))
    assert [p.name for p in (tmp_path / "skills").glob("file_name=*")] == ["file_name=a-b-ts-context.md"]


def test_folder_events(spark):
    events = [(1, "addDir", "/p/new", None), (2, "addDir", "/p/dist", None), (3, "addDir", "/p/old", None), (4, "add", "/p/src/a.ts", "x"), (5, "unlinkDir", "/p/old", None)]
    df = spark.createDataFrame(events, "seq long, op string, path string, content string").withColumn("ts", F.timestamp_seconds("seq"))
    files = watcher.applied(spark.createDataFrame([], watcher.FILES), df)
    assert sorted(r.path for r in files.collect()) == ["/p/new/", "/p/src/a.ts"]
    assert sorted(r.id for r in watcher.graph_of(files, "/p").nodes.collect()) == ["/p/new", "/p/src", "/p/src/a.ts"]


def test_notes_of_one_name_are_one_file(spark, tmp_path):
    from sylvagraph.sinks import skills

    nodes = spark.createDataFrame([("/p/a/x.ts", "x.ts", "file", 1), ("/p/b/x.ts", "x.ts", "file", 2), ("/p/c/y.ts", "y.ts", "file", 3)], "id string, label string, type string, ord long")
    edges = spark.createDataFrame([("/p/a/x.ts", "/p/b/x.ts"), ("/p/b/x.ts", "/p/a/x.ts")], "source_id string, target_id string")
    found = skills.skills(nodes, edges, nodes)
    skills.write_skills(found, str(tmp_path / "notes"))
    texts = {p.parent.name.removeprefix("file_name="): p.read_text() for p in (tmp_path / "notes").glob("*/part-*.txt")}
    assert set(texts) == {"x-ts-context.md", "y-ts-context.md"} and "/p/b/x.ts" in texts["x-ts-context.md"] and "/p/a/x.ts" not in texts["x-ts-context.md"]
    assert "circular dependency" in texts["x-ts-context.md"] and "- none" in texts["y-ts-context.md"] and "- get_blast_radius" in texts["y-ts-context.md"]
