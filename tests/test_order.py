"""Pointer doubling, searches in the order of their discovery, substring joins and safe patterns."""

import random

from pyspark.sql import functions as F

from sylvagraph.operators import climb, patterns, search, traverse
from sylvagraph.operators.holding import first_holding, holding


def walk(parents, start):
    seen, current = [], start
    while parents.get(current) in parents and parents[current] not in seen:
        current = parents[current]
        seen.append(current)
    return seen


def owner(parents, kinds, start):
    current, seen = start, set()
    while current is not None and current not in seen:
        seen.add(current)
        if current not in parents or kinds[current] in ("file", "adr"):
            return current
        current = parents[current]
    return None


def forest(n, seed):
    rng = random.Random(seed)
    parents = {f"n{i}": rng.choice([None, "gone", *[f"n{rng.randrange(n)}"] * 6]) for i in range(n)}
    kinds = {k: rng.choice(["file", "adr", "directory", "class", "class", "function"]) for k in parents}
    return parents, kinds


def test_climbing_is_walking(spark):
    for seed in range(2):
        parents, kinds = forest(60, seed)
        nodes = spark.createDataFrame([(k, v, kinds[k]) for k, v in parents.items()], "id string, parent_id string, type string")
        assert {r.id: r.depth for r in climb.depths(nodes).collect()} == {k: len(walk(parents, k)) for k in parents}
        chain = {(r.id, r.ancestor): r.distance for r in traverse.parent_chain(nodes).collect()}
        assert chain == {(k, a): i + 1 for k in parents for i, a in enumerate(walk(parents, k))}
        nearest = {r.id: r.ancestor for r in climb.nearest(nodes, F.col("type") == "directory").collect()}
        assert nearest == {k: next((a for a in [k, *walk(parents, k)] if kinds[a] == "directory"), None) for k in parents}
        asked = [*parents, "gone", "nowhere"]
        owners = {r.id: r.owner for r in climb.owners(spark.createDataFrame([(a,) for a in asked], "id string"), nodes).collect()}
        assert owners == {a: owner(parents, kinds, a) for a in asked}


def test_a_long_chain_takes_few_rounds(spark):
    chain = spark.createDataFrame([(f"n{i}", f"n{i + 1}" if i < 999 else None) for i in range(1000)], "id string, next string")
    found, rounds = climb.arrivals(chain)
    assert rounds <= 11 and {r.id: r.steps for r in found.collect()} == {f"n{i}": 999 - i for i in range(1000)}


def queue(links, seeds, depth, most):
    out, into = {}, {}
    for s, t in links:
        if s != t:
            out.setdefault(s, {})[t] = None
            into.setdefault(t, {})[s] = None
    order, paths, level = [], {}, {}
    for s in seeds:
        if s not in paths:
            order.append(s)
            paths[s], level[s] = [s], 0
    at = 0
    while at < len(order):
        a = order[at]
        at += 1
        if level[a] >= depth:
            continue
        for b in [*out.get(a, {}), *into.get(a, {})]:
            if b not in paths:
                paths[b], level[b] = [*paths[a], b], level[a] + 1
                order.append(b)
    return order[:most], paths, level


def test_discovery_is_a_queue_s(spark):
    rng = random.Random(7)
    links = [(f"/p/{rng.randrange(40)}", f"/p/{rng.randrange(40)}") for _ in range(70)]
    df = spark.createDataFrame([(s, t, i) for i, (s, t) in enumerate(links)], "source string, target string, ord long").repartition(3)
    nodes = spark.createDataFrame([(f"/p/{i}", "file", i) for i in range(40)], "id string, type string, ord long")
    seeds = ["/p/5", "/p/3", "/p/9"]
    start = spark.createDataFrame([(s, i) for i, s in enumerate(seeds)], "id string, start long")
    for depth, most in ((2, 7), (2, 30), (4, 12)):
        got = [r.id for r in traverse.affected_in_order(nodes, df, start, depth, most).orderBy("place").collect()]
        assert got == queue(links, seeds, depth, most)[0]
    edges = df.select(F.col("source").alias("source_id"), F.col("target").alias("target_id"), "ord")
    found = traverse.first_paths(edges, spark.createDataFrame([("/p/5",), ("/p/3",)], "id string"), 4)
    for seed in ("/p/5", "/p/3"):
        order, paths, level = queue(links, [seed], 4, 99)
        mine = [r for r in found.orderBy("distance", "rank").collect() if r.seed_id == seed]
        assert [(r.id, r.distance, r.path) for r in mine] == [(i, level[i], paths[i]) for i in order[1:]]
        risk = [r.path for r in traverse.risk_paths(found).orderBy("place").collect() if r.seed_id == seed]
        assert risk == [paths[i] for i in order if level[i] >= 3][:10]


def test_holding_is_brute_force(spark):
    rng = random.Random(3)
    word = lambda n: "".join(rng.choice("aabcé/") for _ in range(n))
    needles = ["", "a", "é", "ab", "zz", *(word(rng.randint(1, 6)) for _ in range(120)), None]
    texts = [(i, f"id{i}", word(rng.randint(0, 40))) for i in range(150)] + [(150, "id150", None)]
    n, t = spark.createDataFrame([(x,) for x in needles], "needle string"), spark.createDataFrame(texts, "ord long, id string, text string")
    got = sorted((r.needle, r.id) for r in holding(n, t).collect())
    assert got == sorted((x, i) for x in {x for x in needles if x is not None} for _, i, text in texts if text is not None and x in text)
    first = {r.needle: r.id for r in first_holding(n, t).collect()}
    assert first == {x: next(i for _, i, text in texts if text is not None and x in text) for x in needles if x is not None and any(text and x in text or text == x or (text is not None and x == "") for _, _, text in texts)}
    groups = holding(spark.createDataFrame([("g", "ab"), ("h", "ab")], "k string, needle string"), spark.createDataFrame([("g", "xabx"), ("h", "none"), ("i", "ab")], "k string, text string"), ["k"])
    assert [tuple(r) for r in groups.select("k", "needle", "text").collect()] == [("g", "ab", "xabx")]


def test_many_annotations_meet_many_records(spark):
    n = 20_000
    records = spark.range(n).select(F.col("id").alias("ord"), F.concat(F.lit("/docs/adr/"), F.lpad(F.col("id").cast("string"), 6, "0"), F.lit("-choice.md")).alias("id")).withColumn("text", F.col("id"))
    marks = spark.range(n).select(F.concat(F.lit("adr/"), F.lpad((F.col("id") * 7 % (2 * n)).cast("string"), 6, "0"), F.lit("-")).alias("needle"))
    got = {r.needle: r.id for r in first_holding(marks, records).collect()}
    assert got == {f"adr/{k:06}-": f"/docs/adr/{k:06}-choice.md" for k in (i * 7 % (2 * n) for i in range(n)) if k < n}


SAFE = ["abc", "a+b*c?", r"\bclass\s+\w+", "(a|b)+", "[a-z+*]+x{2,5}", "(?:ab)?c", r"\(a\+\)+", "(?<name>a)b+", "a{,3}", "^(foo|bar)$", "", "x" * 30, "a?" * 25]
UNSAFE = ["(a+)+", "((a+)b)+", "(a*)*", "(a|b+)*", "(?:a?)+", "(x+x+)+y", "(a{2,3})*", "([a-z]+)*$", "a?" * 26, "(", ")", "[a", "*a", "a**", "\\", "(?=a+)*", "(?<!(b+)c)+", "a|*"]


def test_patterns_are_told_apart(spark):
    assert [p for p in SAFE if not patterns.is_safe(p)] == [] and [p for p in UNSAFE if patterns.is_safe(p)] == []
    assert patterns.star_height("((a+)b)+") == (2, 2) and patterns.star_height(r"a+(b|c*)d") == (1, 2)
    for bad in UNSAFE:
        try:
            search.line_test(bad, regex=True)
        except ValueError:
            continue
        raise AssertionError(bad)
