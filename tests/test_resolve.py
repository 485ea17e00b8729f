"""Link targets are looked up from the nodes' side: as many rows as nodes and targets have, not one for each suffix."""

import random

from pyspark.sql import functions as F

from sylvagraph.operators.resolve import FILE_RANK, TRIED, asked_by, ranked_targets, touched_links, waiting
from sylvagraph.schema import EXPORT


def test_a_file_is_asked_by_the_targets_that_try_it(spark):
    files = ["/p/a.ts", "/p/a/index.ts", "/p/a.mts", "/p/a.d.ts", "/p/index.js", "/p/x", ".ts", "", "/p/é🙂.tsx", None]
    got = {r.id: {tuple(x) for x in r.asked} for r in spark.createDataFrame([(f,) for f in files], "id string").select("id", asked_by(F.col("id")).alias("asked")).collect()}
    for f in files:
        assert got[f] == (set() if f is None else {(f[: len(f) - len(s)], at) for at, s in enumerate(TRIED) if f.endswith(s)}) and len(got[f]) <= 3


def plain(nodes, target):
    """The first that exists: symbols of any candidate file, then files."""
    if target is None:
        return None
    ids, (base, *rest) = {n for n, _ in nodes}, target.split("#")
    tried = []
    for at, suffix in enumerate(TRIED):
        file = base + suffix
        tried.append((at + FILE_RANK, file))
        if rest:
            exports = next((e for n, e in nodes if n == file), None) or []
            match = next((e for e in exports if e[0] == rest[0] or (rest[0] == "default" and e[2])), (None, None, None))
            tried += [(at * 3 + i, f"{file}#{n}") for i, n in enumerate((rest[0], match[1], match[0])) if n is not None]
    return min(((rank, c) for rank, c in tried if c in ids), default=None)


def test_targets_are_found_as_one_by_one(spark):
    rng = random.Random(3)
    bases, names = ["/p/a", "/p/b", "/p/b/index", "/p", "/p/c.ts"], ["x", "y", "default", "", "z"]
    files = [b + s for b in bases for s in TRIED if rng.random() < 0.4]
    export = lambda: (rng.choice(names[:3]), rng.choice([*names, None]), rng.choice([True, False, None]))
    nodes = [(f, [export() for _ in range(rng.randint(0, 3))] or None) for f in files] + [(f"{f}#{n}", None) for f in [*files, "/p/a.js", "/p/gone"] for n in ["x", "y", "#x", "a#b"] if rng.random() < 0.5]
    targets = [b + s for b in [*bases, "/p/gone", ""] for s in ["", ".ts", "#x", "#y", "#default", "#", "#z", "#a#b"]] + [None]
    links = [(f"s{i % 3}", t, 1, "import", i) for i, t in enumerate(targets * 2)]
    df = spark.createDataFrame(links, "source string, target string, value int, type string, ord bigint")
    node_rows = spark.createDataFrame([(n, e) for n, e in nodes], "id string, exports array<struct<exported_name:string,local_name:string,is_default:boolean>>")
    assert node_rows.schema["exports"].dataType.elementType == EXPORT
    found = ranked_targets(node_rows, df)
    got = {r.ord: r.found and (r.rank, r.found) for r in found.collect()}
    assert got == {o: plain(nodes, t) for _, t, _, _, o in links if t not in {n for n, _ in nodes}}
    assert sum(v is not None for v in got.values()) > 20
    # What waits for a file is what tries it; the inverted table has one row a link.
    waits = waiting(df)
    assert waits.count() == len(links)
    for key in ["/p/a.ts", "/p/b/index.ts", "/p", "/p/index.js", "/p/none"]:
        again = touched_links(waits, spark.createDataFrame([(key,)], "key string"))
        assert sorted(r.ord for r in again.collect()) == [o for _, t, _, _, o in links if t is not None and key in [t.split("#")[0] + s for s in TRIED]]
