"""A small project on disk, from discovery to answers; streams of file events; Cypher."""

import pytest
from pyspark.sql import functions as F

from sylvagraph.operators import architecture, build, health, stats, traverse
from sylvagraph.parsing.facts import facts
from sylvagraph.plans import cypher
from sylvagraph.sources import files as sources
from sylvagraph.streaming import watcher


@pytest.fixture(scope="module")
def project(tmp_path_factory):
    root = tmp_path_factory.mktemp("project")
    texts = {f"utils{i}.ts": f"export function util{i}() {{ return {i}; }}\n" for i in range(1, 14)}
    texts["App.tsx"] = "".join(f"import {{ util{i} }} from './utils{i}';\n" for i in range(1, 14)) + "// @adr 001\nexport function App() { return eval('x'); }\n"
    texts |= {"a/b/c/d/e/f/deep.ts": "export const x = 1;\n", "package.json": "{}", "docs/adr-001.md": "# Use it\nStatus: done\nContext: x\n", "node_modules/x.ts": "no", ".env": "no", "pic.png": "no"}
    for name, text in texts.items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)
    return str(root)


@pytest.fixture(scope="module")
def graph(spark, project):
    return build.analyze(spark, project).persisted()


def test_graph_of_a_project(graph, project):
    kinds = {r.type: r.n for r in stats.counts_by_type(graph.nodes).collect()}
    assert kinds == {"file": 16, "directory": 7, "function": 14, "adr": 1}
    found = {(r.source, r.target, r.value) for r in graph.links.collect()}
    assert len(found) == 14 and (f"{project}/App.tsx", f"{project}/utils1.ts#util1", 2) in found and (f"{project}/App.tsx", f"{project}/docs/adr-001.md", 3) in found
    assert health.high_fan_out_files(stats.degrees(graph.nodes, graph.links)).first().metric == 14
    assert {r.node_id for r in health.deep_nesting(traverse.hierarchy_depth(graph.nodes)).collect()} == {f"{project}/a/b/c/d/e/f", f"{project}/a/b/c/d/e/f/deep.ts"}
    assert architecture.classify(graph.nodes).count() == graph.nodes.count()


def test_large_files_are_not_read(spark, tmp_path):
    (tmp_path / "big.ts").write_text("x" * (sources.MOST_BYTES + 1))
    (tmp_path / "small.ts").write_text("é")
    found = sources.discover(spark, str(tmp_path))
    assert {r.path.split("/")[-1]: (r.length, r.content) for r in found.collect()} == {"big.ts": (sources.MOST_BYTES + 1, None), "small.ts": (2, "é")}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "LessThanOrEqual(length," in plan and plan.count("content#") < 4 * plan.count("FileScan")


def test_removal(spark, graph, project):
    left = build.without_files(graph, spark.createDataFrame([(f"{project}/utils1.ts",)], "path string"))
    assert left.nodes.filter(F.col("id").contains("utils1.ts")).count() == 0
    assert left.links.count() == 14


@pytest.mark.parametrize(
    "path,language,text,entities,imports",
    [
        ("a.ts", "typescript", "import d, { a as b } from './m';\nimport * as n from 'n';\nexport class C { run() { } }\nexport default C;", {("class", "C"), ("function", "run")}, {"./m": ["default", "a"], "n": ["*"]}),
        ("a.js", "javascript", "export * from './x'; const q = require('y'); export { z as default } from './z'; // import 'no'", set(), {"./x": ["*"], "y": [], "./z": ["z"]}),
        ("a.py", "python", "from . import b\nimport os\nclass A:\n    def f(self): pass", {("class", "A"), ("function", "f")}, {".": ["b"], "os": []}),
        ("a.go", "go", 'import "fmt"\ntype T struct {}\nfunc (t T) Run() {}', {("class", "T"), ("function", "Run")}, {"fmt": []}),
        ("a.rs", "rust", "use std::io;\npub struct S;\npub fn go() {}", {("class", "S"), ("function", "go")}, {"std::io": ["io"]}),
        ("bad.py", "python", "def (", set(), {}),
    ],
)
def test_facts(path, language, text, entities, imports):
    found = facts(path, language, text, False)
    assert {(e["type"], e["name"]) for e in found["entities"]} == entities
    assert {i["path"]: i["imported_entities"] for i in found["imports"]} == imports


def test_relative_paths(spark):
    row = spark.range(1).select(build.joined(F.lit("/p/src/a"), F.lit("../b/./c")).alias("x"), build.joined(F.lit("/p"), F.lit("./x")).alias("y")).first()
    assert (row.x, row.y) == ("/p/src/b/c", "/p/x")


def test_logs(spark):
    lines = ["COMMIT:abc|Ann|100", "", "1\t2\tsrc/a.ts", "-\t-\tpic.png", "COMMIT:def|Bo|200", "3\t0\tsrc/a.ts"]
    df = spark.createDataFrame([(1, i, x) for i, x in enumerate(lines)], "log_id int, line_no int, value string")
    rows = sources.numstat_log(df).orderBy("hash", "file_path").collect()
    assert [(r.hash, r.file_path, r.additions, r.deletions) for r in rows] == [("abc", "pic.png", 0, 0), ("abc", "src/a.ts", 1, 2), ("def", "src/a.ts", 3, 0)]


def test_replayed_events_equal_a_rebuild(spark, tmp_path):
    rows = [(1, "add", "/p/a.ts", "import { b } from './b';"), (2, "add", "/p/b.ts", "export function b() {}"), (3, "add", "/p/dist/x.ts", "no"), (4, "add", "/p/c.ts", "x"), (5, "unlink", "/p/c.ts", None), (6, "change", "/p/b.ts", "export function b() {} export function c() {}")]
    df = spark.createDataFrame(rows, "seq long, op string, path string, content string").withColumn("ts", F.timestamp_seconds("seq"))
    for at in ("seq <= 3", "seq > 3"):
        df.filter(at).coalesce(1).write.mode("append").parquet(str(tmp_path / "events"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "events"))
    versions = []
    done = watcher.watch(stream, str(tmp_path / "files"), str(tmp_path / "log"), "/p", lambda g, diff, v: versions.append((v, sorted(r.id for r in g.nodes.collect()), g.links.count())))
    done.awaitTermination()
    assert versions[-1][1:] == (["/p/a.ts", "/p/b.ts", "/p/b.ts#b", "/p/b.ts#c"], 1)
    assert [v for v, *_ in versions] == [0, 1]


def test_cypher(spark, graph, project):
    nodes, edges = graph.nodes, stats.graph_edges(graph.nodes, graph.links)
    run = lambda q: cypher.run(q, nodes, edges)
    assert run("MATCH (n) RETURN COUNT(n) AS n").first().n == nodes.count()
    assert run("MATCH (n:FileNode) WHERE n.type = 'adr' RETURN n.id, n.label").first().label == "ADR: Use it"
    assert run("MATCH (a)-[r]->(b) RETURN r.type, COUNT(r) AS n ORDER BY n DESC LIMIT 1").first().n == 13
    assert run(f"MATCH (n) WHERE n.filePath = '{project}/App.tsx' OR n.filePath STARTS WITH '{project}/a/' RETURN n.id").count() == 7
    assert run("MATCH (n)-[:FileEdge*2..3]->(n) RETURN DISTINCT n.id").count() == 0
    with pytest.raises(ValueError):
        run("CREATE (n)")
