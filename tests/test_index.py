"""The incremental index against fresh analyses, and readers of its changes."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from sylvagraph.lineage import cut
from sylvagraph.operators import build, index, progress
from sylvagraph.operators.resolve import reresolved, resolve_links, touched_links, waiting, with_found
from sylvagraph.parsing.facts import parsed
from sylvagraph.sources.versions import DeltaTable

ROOT, FILES = "/p", "path string, mtime timestamp, length bigint, content string"
NAMES = [f"{d}/{n}" for d in ("src", "src/ui", "lib") for n in ("a.ts", "b.tsx", "index.ts", "c.js")] + ["docs/adr-1.md", "docs/adr-2.md", "tsconfig.json", "py/m.py"]
DAY = datetime(2024, 1, 1)


def content(rng, path):
    if path.endswith(".md"):
        return "# A choice\nStatus: accepted\n## Context\nx" if rng.random() < 0.8 else "# Notes"
    if path.endswith(".json"):
        return rng.choice(['{"compilerOptions": {"paths": {"@/*": ["src/*"]}}}', '{"compilerOptions": {"paths": {"@/*": ["lib/*"]}}}', "{}"])
    if path.endswith(".py"):
        return "import os\ndef f():\n    pass\n"
    lines = [f"import {{ {rng.choice('fgh')} }} from '{rng.choice(['./a', './b', '../ui', '../../lib/c', './ui/index', '@/a', '@/ui/b', '../lib', './c.js', 'react'])}';" for _ in range(rng.randint(0, 3))]
    lines += [f"// @adr {rng.choice(['adr-1', 'docs/ADR', 'adr-9'])}"] if rng.random() < 0.4 else []
    lines += [f"export class {x} {{}}" if rng.random() < 0.5 else f"export function {x}() {{}}" for x in rng.sample("fgh", rng.randint(0, 2))]
    return "\n".join(lines + [f"export const {rng.choice('fgh')} = () => 1; export {{ {rng.choice('fgh')} as default }};"])


def frame(spark, files):
    return spark.createDataFrame([(p, t, len(c or ""), c) for p, (t, c) in files.items()], FILES)


def fresh(spark, files):
    df = frame(spark, files)
    code, folders = df.filter(~F.col("path").endswith("/")), df.filter(F.col("path").endswith("/"))
    facts = parsed(code)
    raw = build.raw_graph(facts, ROOT, modules=build.script_modules(facts, code, ROOT), folders=folders)
    return raw.nodes, resolve_links(raw.nodes, raw.links)


def same(spark, made, files):
    nodes, links = fresh(spark, files)
    key = lambda r: str(tuple(r))
    assert sorted(map(key, made.nodes.select(*nodes.columns).collect())) == sorted(map(key, nodes.collect()))
    assert sorted(map(key, made.links.select(*links.columns).collect())) == sorted(map(key, links.collect()))


@pytest.fixture
def small(spark):
    """Tiny tables need neither partitions nor plans that adapt."""
    settings = {"spark.sql.shuffle.partitions": "1", "spark.sql.adaptive.enabled": "false", "spark.sql.codegen.wholeStage": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def test_batches_equal_a_rebuild(spark, small, tmp_path):
    rng = random.Random(11)
    project = index.ProjectIndex(spark, str(tmp_path / "index"), ROOT)
    files = {f"{ROOT}/{n}": (DAY, content(rng, n)) for n in NAMES[:9]}
    assert project.update(frame(spark, files))["parsed"] == 9
    assert project.update(frame(spark, files)) == {"version": 0, "parsed": 0, "removed": 0, "resolved": 0}
    whole, changes = project.fetch("early")
    same(spark, whole, files)
    seen = {(r.kind, r.id, r.target, r.type) for r in _rows(whole)}
    for batch in range(5):
        before = dict(files)
        for name in rng.sample([*NAMES, "empty/"], rng.randint(2, 5)):
            path = f"{ROOT}/{name}"
            if path in files and rng.random() < 0.4 and len(files) > 3:
                del files[path]
            else:
                files[path] = (DAY + timedelta(days=batch + 1), None if name.endswith("/") else content(rng, name))
        changed = {p: v for p, v in files.items() if before.get(p) != v}
        gone = spark.createDataFrame([(p,) for p in before if p not in files], "path string")
        done = project.apply(frame(spark, changed) if changed else frame(spark, files).limit(0), gone, batch)
        assert (done["parsed"], done["removed"]) == (len(changed), len(set(before) - set(files)))
        assert project.apply(frame(spark, files), gone, batch)["parsed"] == 0  # a batch that comes again
        if batch in (1, 4):
            same(spark, project.graph(), files)
    # The feed's changes lead from the first graph to the last one; a reader who comes late gets that whole.
    for row in sorted(project.fetch("early")[1].collect(), key=lambda r: (r.version, r.op == "added")):
        (seen.add if row.op == "added" else seen.discard)((row.kind, row.id, row.target, row.type))
    assert seen == {(r.kind, r.id, r.target, r.type) for r in _rows(project.graph())}
    assert project.fetch("early")[1].count() == 0
    late, none = project.fetch("late")
    assert none.count() == 0 and {(r.kind, r.id, r.target, r.type) for r in _rows(late)} == seen
    again = index.ProjectIndex(spark, str(tmp_path / "index"), ROOT)  # another session
    assert {r.language for r in again.languages().collect()} == {r.language for r in parsed(frame(spark, files)).collect() if r.language}


def _rows(graph):
    none = F.lit(None).cast("string").alias("target")
    return graph.nodes.select(F.lit("node").alias("kind"), "id", none, "type").unionByName(graph.links.select(F.lit("link").alias("kind"), F.col("source").alias("id"), "target", "type")).collect()


def test_a_second_analysis_parses_only_what_changed(spark, tmp_path):
    root = tmp_path / "tree"
    (root / "src").mkdir(parents=True)
    for name, text in {"src/a.ts": "import { b } from './b'\n// @adr choice", "src/b.ts": "export function b() {}", "choice.md": "# C\nStatus: x\nContext", "node_modules.ts": "x"}.items():
        (root / name).write_text(text)
    base = str(tmp_path / "index")
    graph, done = index.analyze(spark, str(root), base)
    assert done["parsed"] == 4 and {(r.source.split("/")[-1], r.target.split("/")[-1]) for r in graph.links.collect()} == {("a.ts", "b.ts#b"), ("a.ts", "choice.md")}
    (root / "src/b.ts").unlink()
    (root / "src/b").mkdir()
    (root / "src/b/index.ts").write_text("const q = 1; export { q as b }")
    heard = []
    graph, done = index.analyze(spark, str(root), base, report=lambda *said: heard.append(said))
    assert (done["parsed"], done["removed"]) == (1, 1) and heard == [("indexing_files", 0, 1), ("indexing_complete", 1, 1)]
    plain = build.analyze(spark, str(root))
    key = lambda df: sorted(map(str, df.collect()))
    assert key(graph.nodes.select(*plain.nodes.columns)) == key(plain.nodes) and key(graph.links.select(*plain.links.columns)) == key(plain.links)


def test_progress_is_reported_while_files_are_parsed(spark):
    heard = []
    files = spark.range(95).selectExpr("concat('/p/', id) as path")
    dealt, parts = progress.in_steps(files, 95)

    def slow(batches):
        import time

        for batch in batches:
            time.sleep(0.5)
            yield batch

    with progress.reported(files, 95, parts, lambda *said: heard.append(said), wait=0.05):
        assert dealt.mapInArrow(slow, "path string").count() == 95
    assert parts == 10 and heard[0] == ("indexing_files", 0, 95) and heard[-1] == ("indexing_complete", 95, 95) and len(heard) > 2
    assert [c for _, c, _ in heard] == sorted(c for _, c, _ in heard) and progress.in_steps(files, 10**7)[1] == progress.MOST_PARTITIONS


def test_only_waiting_links_are_resolved_again(spark):
    node = lambda i: (i, None)
    nodes = [node(x) for x in ("/p/a.ts", "/p/a.ts#f", "/p/b/index.js", "/p/d")]
    kinds = "id string, exports array<struct<exported_name:string,local_name:string,is_default:boolean>>"
    links = [("/p/x.ts", t, 1, "import", i) for i, t in enumerate(["/p/a", "/p/a#f", "/p/b", "/p/c", "/p/c#g", "/p/d", "/p/a#none"])]
    df = spark.createDataFrame(links, "source string, target string, value int, type string, ord long")
    old, new = spark.createDataFrame(nodes, kinds), spark.createDataFrame([*nodes, node("/p/c.tsx"), node("/p/c.tsx#g"), node("/p/a")], kinds)
    keys = spark.createDataFrame([("/p/c.tsx",), ("/p/a",)], "key string")
    again = touched_links(waiting(df), keys)
    assert sorted(r.ord for r in again.collect()) == [0, 1, 3, 4, 6]
    got = reresolved(with_found(old, df), again, new)
    assert sorted((r.ord, r.found) for r in got.collect()) == sorted((r.ord, r.found) for r in with_found(new, df).collect())


def test_links_after_twenty_batches_equal_a_rebuild(spark, small):
    rng = random.Random(5)
    kinds, columns = "id string, exports array<struct<exported_name:string,local_name:string,is_default:boolean>>", "source string, target string, value int, type string, ord long"
    files = [f"/p/{d}{n}{e}" for d in ("", "d/") for n in "abc" for e in (".ts", ".js", "/index.ts", "")]
    links = [("/p/x", rng.choice(files).removesuffix(".ts").removesuffix("/index") + rng.choice(["", "#f", "#g", "#default"]), 1, "import", i) for i in range(120)]
    df = spark.createDataFrame(links, columns).cache()
    waits = waiting(df).cache()
    held: dict[str, list] = {}
    state = cut(with_found(spark.createDataFrame([], kinds), df))
    for _ in range(20):
        touched = rng.sample(files, 3)
        for path in touched:
            held.pop(path, None)
            if rng.random() < 0.7:
                held[path] = [(path, [("f", "h", False), ("x", "g", True)] if rng.random() < 0.5 else None), *((f"{path}#{x}", None) for x in rng.sample("fgh", rng.randint(0, 3)))]
        nodes = spark.createDataFrame([n for ns in held.values() for n in ns], kinds)
        again = touched_links(waits, spark.createDataFrame([(p,) for p in touched], "key string"))
        state = cut(reresolved(state, again, nodes))
    key = lambda rows: sorted(map(str, rows.collect()))
    assert key(state) == key(with_found(nodes, df)) and state.count() > 20


def test_tables_of_changes_are_put_together(spark, tmp_path):
    table = DeltaTable(spark, str(tmp_path), "t", "k string, v int", ["k"], most=3)
    versions, held, rng = [], {}, random.Random(1)
    for version in range(8):
        keys = rng.sample("abcdef", 3)
        rows = [(k, version * 10 + i) for k in keys[:2] for i in range(2)]
        for k in keys:
            held[k] = [v for key, v in rows if key == k]
        versions = table.write(version, versions, spark.createDataFrame(rows, "k string, v int"), spark.createDataFrame([(k,) for k in keys], "k string"))
        assert len(versions) <= 3
        assert sorted(tuple(r) for r in table.read(versions).collect()) == sorted((k, v) for k, vs in held.items() for v in vs)
