"""Graph traversal: breadth-first levels from many seeds, impact summaries, parent chains and short cycles.

Levels are DataFrame joins; each new front is a reliable checkpoint, so lineage doesn't grow with depth and no level is written twice. A node that many edges
meet is one row on the other side of the join.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sylvagraph.functions.paths import structural
from sylvagraph.lineage import cut
from sylvagraph.operators import climb


#: Types in the order of the layout; others come last.
LAYOUT = ["directory", "file", "class", "function", "adr"]


def levels(edges: DataFrame, seeds: DataFrame, depth: int | None = None) -> DataFrame:
    """seed_id, id and depth (0: the seed) of what each seed reaches along ``edges`` (a to b). Nodes need not exist.

    ``seeds``: seed_id, id. Without a depth it ends when no new node is found.
    """
    edges = cut(edges.select("a", "b").distinct())
    front = cut(seeds.select("seed_id", "id").distinct().withColumn("depth", F.lit(0)))
    fronts, level = [front], 0
    while depth is None or level < depth:
        level += 1
        near = front.join(edges, front.id == edges.a).select("seed_id", F.col("b").alias("id")).distinct()
        front = cut(near.join(_union(fronts), ["seed_id", "id"], "left_anti").withColumn("depth", F.lit(level)))
        if front.isEmpty():
            break
        fronts.append(front)
    return _union(fronts)


def _union(tables: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, tables)


def reversed_edges(links: DataFrame) -> DataFrame:
    """From a target to the sources that depend on it."""
    return links.select(F.col("target").alias("a"), F.col("source").alias("b"))


def both_ways(links: DataFrame) -> DataFrame:
    return links.select(F.col("source").alias("a"), F.col("target").alias("b")).unionByName(reversed_edges(links))


def blast_radius(nodes: DataFrame, links: DataFrame, roots: DataFrame, depth: int | None = None) -> DataFrame:
    """What depends on each root, directly or not: seed_id, id and depth of nodes that exist, without the root."""
    found = levels(reversed_edges(links), roots.select(F.col("id").alias("seed_id"), "id"), depth)
    return found.filter("depth > 0").join(nodes.select("id"), "id", "left_semi").select("seed_id", "id", "depth")


def blast_summary(nodes: DataFrame, links: DataFrame, roots: DataFrame, depth: int | None = None) -> DataFrame:
    """One row a root: affected_nodes, affected_links (all links into expanded nodes), direct_dependents (a link each), max_depth and confidence."""
    found = levels(reversed_edges(links), roots.select(F.col("id").alias("seed_id"), "id"), depth)
    known = found.join(nodes.select("id", F.lit(1).alias("known")), "id", "left")
    of_nodes = known.groupBy("seed_id").agg(F.count_if((F.col("depth") > 0) & F.col("known").isNotNull()).alias("affected_nodes"), F.max("depth").alias("max_depth"))
    expanded = found if depth is None else found.filter(F.col("depth") < depth)
    touched = links.join(expanded.select("seed_id", F.col("id").alias("target")), "target")
    of_links = touched.groupBy("seed_id").agg(F.count(F.lit(1)).alias("affected_links"), F.count_if(F.col("type") == "import").alias("imports"), F.count_if(F.col("type") == "adr").alias("adrs"))
    direct = links.join(roots.select(F.col("id").alias("target")), "target").join(nodes.select(F.col("id").alias("source")), "source", "left_semi").groupBy(F.col("target").alias("seed_id")).agg(F.count(F.lit(1)).alias("direct_dependents"))
    row = of_nodes.join(of_links, "seed_id", "left").join(direct, "seed_id", "left").fillna(0)
    return row.withColumn("confidence", confidence(F.col("affected_nodes"), F.col("imports"), F.col("adrs"))).select("seed_id", "affected_nodes", "affected_links", "direct_dependents", "max_depth", "confidence")


def confidence(affected: Column, imports: Column, adrs: Column) -> Column:
    return F.when(affected == 0, "low").when((imports > 0) & (adrs == 0), "high").when(imports > 0, "medium").otherwise("low")


def surroundings(edges: DataFrame, roots: DataFrame, depth: int = 5) -> DataFrame:
    """The undirected blast radius over stored edges: seed_id, id, distance."""
    found = levels(both_ways(edges.select(F.col("source_id").alias("source"), F.col("target_id").alias("target"))), roots.select(F.col("id").alias("seed_id"), "id"), depth)
    return found.filter("depth > 0").select("seed_id", "id", F.col("depth").alias("distance"))


def surroundings_summary(edges: DataFrame, roots: DataFrame, depth: int = 5) -> DataFrame:
    """One row a root: direct, transitive, max_depth (of transitive ones) and risk_nodes (three or more away)."""
    found = roots.select(F.col("id").alias("seed_id")).join(surroundings(edges, roots, depth), "seed_id", "left")
    far = F.col("distance") > 1
    return found.groupBy("seed_id").agg(
        F.count_if(F.col("distance") == 1).alias("direct"), F.count_if(far).alias("transitive"),
        F.coalesce(F.max(F.when(far, F.col("distance"))), F.lit(0)).alias("max_depth"), F.count_if(F.col("distance") >= 3).alias("risk_nodes"),
    )


def with_paths(edges: DataFrame, roots: DataFrame, depth: int = 5) -> DataFrame:
    """seed_id, id, distance and one shortest path: that of the smallest parent by distance, then path. Depth is bounded, so are paths."""
    pairs = cut(both_ways(edges.select(F.col("source_id").alias("source"), F.col("target_id").alias("target"))).distinct())
    front = cut(roots.select(F.col("id").alias("seed_id"), "id", F.lit(0).alias("distance"), F.array("id").alias("path")))
    fronts = [front]
    for level in range(1, depth + 1):
        near = front.join(pairs, front.id == pairs.a).select("seed_id", F.col("b").alias("id"), F.array_append("path", F.col("b")).alias("path")).groupBy("seed_id", "id").agg(F.min("path").alias("path"))
        front = cut(near.join(_union(fronts), ["seed_id", "id"], "left_anti").select("seed_id", "id", F.lit(level).alias("distance"), "path"))
        if front.isEmpty():
            break
        fronts.append(front)
    return _union(fronts).filter("distance > 0")


def impact_score(summary: DataFrame) -> DataFrame:
    """min(100, 2 * direct + transitive + max_depth / 2) over a summary at depth 3."""
    return summary.withColumn("impact_score", F.least(F.lit(100.0), 2.0 * F.col("direct") + F.col("transitive") + 0.5 * F.col("max_depth")))


def collapsed(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """source and target of distinct file-to-file dependencies; symbols count as their files."""
    files = nodes.filter("type = 'file'").select("id")
    pairs = links.select(structural(F.col("source")).alias("source"), structural(F.col("target")).alias("target")).filter("source != target").distinct()
    return pairs.join(files.withColumnRenamed("id", "source"), "source", "left_semi").join(files.withColumnRenamed("id", "target"), "target", "left_semi").select("source", "target")


def affected_files(nodes: DataFrame, links: DataFrame, seeds: DataFrame, depth: int = 2, most: int = 30) -> DataFrame:
    """id and depth of the files around the seeds, nearest first, then in store order, at most so many."""
    files = nodes.filter("type = 'file'").select("id", "ord")
    own = seeds.select(structural(F.col("id")).alias("id")).distinct().join(files.select("id"), "id", "left_semi")
    found = levels(both_ways(collapsed(nodes, links)), own.select(F.lit("all").alias("seed_id"), "id"), depth)
    return found.join(files, "id").orderBy("depth", "ord", "id").limit(most).select("id", "depth")


def neighbour_order(links: DataFrame) -> DataFrame:
    """a, b and place: the distinct neighbours of each node in the order in which a list of its outgoing links, then of its incoming ones, has them. ``links``: source, target, ord."""
    out = links.select(F.col("source").alias("a"), F.col("target").alias("b"), F.struct(F.lit(0).alias("incoming"), "ord", F.col("target").alias("b")).alias("place"))
    back = links.select(F.col("target").alias("a"), F.col("source").alias("b"), F.struct(F.lit(1).alias("incoming"), "ord", F.col("source").alias("b")).alias("place"))
    return out.unionByName(back).filter("a != b").groupBy("a", "b").agg(F.min("place").alias("place"))


def discovered(links: DataFrame, seeds: DataFrame, depth: int, most: int | None = None) -> DataFrame:
    """What a queue that starts with the seeds (seed_id, id, start) finds, neighbours in ``neighbour_order``: seed_id, id, depth, rank and path.

    ``rank`` orders what one queue finds within a depth: the places by which a node was first reached, from the seed on. ``path`` is the way of that first discovery. With ``most``
    no level is begun once some queue has found so many, since a queue that stops there needs no more; what is over is the caller's to cut.
    """
    pairs = cut(neighbour_order(links))
    none = "array<struct<incoming:int,ord:bigint,b:string>>"
    start = F.array(F.struct(F.lit(0).alias("incoming"), F.col("start").cast("bigint").alias("ord"), F.col("id").alias("b"))).cast(none)
    front = cut(seeds.select("seed_id", "id", F.lit(0).alias("depth"), start.alias("rank"), F.array("id").alias("path")).groupBy("seed_id", "id", "depth").agg(F.min("rank").alias("rank"), F.min_by("path", "rank").alias("path")))
    fronts = [front]
    for level in range(1, depth + 1):
        if most is not None and not _union(fronts).groupBy("seed_id").count().filter(F.col("count") < most).limit(1).count():
            break
        near = front.join(pairs, front.id == pairs.a).select("seed_id", F.col("b").alias("id"), F.array_append("rank", F.col("place")).alias("rank"), F.array_append("path", F.col("b")).alias("path"))
        first = near.groupBy("seed_id", "id").agg(F.min(F.struct("rank", "path")).alias("f"))
        front = cut(first.join(_union(fronts).select("seed_id", "id"), ["seed_id", "id"], "left_anti").select("seed_id", "id", F.lit(level).alias("depth"), "f.rank", "f.path"))
        if front.isEmpty():
            break
        fronts.append(front)
    return _union(fronts)


def collapsed_links(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """source, target and ord of file-to-file links; symbols count as their files, repeats stay."""
    files = nodes.filter("type = 'file'").select("id")
    pairs = links.select(structural(F.col("source")).alias("source"), structural(F.col("target")).alias("target"), "ord").filter("source != target")
    return pairs.join(files.withColumnRenamed("id", "source"), "source", "left_semi").join(files.withColumnRenamed("id", "target"), "target", "left_semi").select("source", "target", "ord")


def affected_in_order(nodes: DataFrame, links: DataFrame, seeds: DataFrame, depth: int = 2, most: int = 30) -> DataFrame:
    """id, depth and place (from 0) of the files that a queue from the seeds' files (id, start: their order) finds first, at most so many."""
    files = nodes.filter("type = 'file'").select("id")
    own = seeds.select(structural(F.col("id")).alias("id"), "start").groupBy("id").agg(F.min("start").alias("start")).join(files, "id", "left_semi")
    found = discovered(collapsed_links(nodes, links), own.select(F.lit("all").alias("seed_id"), "id", "start"), depth, most)
    first = found.orderBy("depth", "rank").limit(most)
    rows = first.agg(F.sort_array(F.collect_list(F.struct("depth", "rank", "id"))).alias("r"))  # at most ``most``
    return rows.select(F.posexplode("r").alias("place", "r")).select("r.id", "r.depth", "place")


def first_paths(edges: DataFrame, roots: DataFrame, depth: int = 5) -> DataFrame:
    """seed_id, id, distance, rank and path: how a queue from each root first comes to each node over stored edges (source_id, target_id, ord)."""
    links = edges.select(F.col("source_id").alias("source"), F.col("target_id").alias("target"), "ord")
    found = discovered(links, roots.select(F.col("id").alias("seed_id"), "id", F.lit(0).alias("start")), depth)
    return found.filter("depth > 0").select("seed_id", "id", F.col("depth").alias("distance"), "rank", "path")


def risk_paths(paths: DataFrame, most: int = 10) -> DataFrame:
    """seed_id, place and path of the first ways of three steps or more, in the order of their discovery."""
    within = Window.partitionBy("seed_id").orderBy("distance", "rank")
    return paths.filter("distance >= 3").withColumn("place", F.row_number().over(within)).filter(F.col("place") <= most).select("seed_id", "place", "path")


def parent_chain(nodes: DataFrame) -> DataFrame:
    """id, ancestor and distance of every ancestor that exists, however far, by joins of pairs with pairs. Cycles end where they come back."""
    pairs = cut(climb.known_parents(nodes).filter("next is not null").select("id", F.col("next").alias("ancestor"), F.lit(1).alias("distance")))
    reach, front = 1, pairs
    while not front.isEmpty():
        # The pairs of the furthest distance go on by all pairs of their ancestor.
        further = pairs.select(F.col("id").alias("ancestor"), F.col("ancestor").alias("next"), F.col("distance").alias("more"))
        found = front.join(further, "ancestor").select("id", F.col("next").alias("ancestor"), (F.col("distance") + F.col("more")).alias("distance")).groupBy("id", "ancestor").agg(F.min("distance").alias("distance"))
        added = cut(found.join(pairs.select("id", "ancestor"), ["id", "ancestor"], "left_anti"))
        pairs, reach = pairs.unionByName(added), 2 * reach
        front = added.filter(F.col("distance") == reach)
    return pairs


def hierarchy_depth(nodes: DataFrame) -> DataFrame:
    """``nodes`` with depth: the number of their ancestors."""
    return nodes.join(climb.depths(nodes), "id", "left").withColumn("depth", F.coalesce("depth", F.lit(0)))


def nearest_ancestor(nodes: DataFrame, wanted: Column) -> DataFrame:
    """id and ancestor: the node itself if ``wanted`` holds for it, else the nearest ancestor for which it does; null if there is none."""
    return climb.nearest(nodes, wanted)


def rendered_edges(nodes: DataFrame, links: DataFrame, visible: Column) -> DataFrame:
    """source, target, type of links between the visible nodes that stand for their ends; loops and repeats are left out."""
    of = cut(nearest_ancestor(nodes, visible))
    ends = links.join(of.select(F.col("id").alias("source"), F.col("ancestor").alias("s")), "source").join(of.select(F.col("id").alias("target"), F.col("ancestor").alias("t")), "target")
    return ends.filter("s is not null and t is not null and s != t").select(F.col("s").alias("source"), F.col("t").alias("target"), "type").distinct()


def short_cycles(edges: DataFrame) -> DataFrame:
    """id and length (2 or 3, the shortest) of nodes on a short directed cycle.

    A triangle is looked for at its end of fewest edges only, which few ends of as many edges can have around them, so hubs make no wedges.
    """
    one = cut(edges.select(F.col("source_id").alias("a"), F.col("target_id").alias("b")).filter("a != b").distinct())
    back = one.select(F.col("b").alias("a"), F.col("a").alias("b"))
    pairs = one.join(back, ["a", "b"], "left_semi").select(F.col("a").alias("id"), F.lit(2).alias("length"))
    rank = one.unionByName(back).groupBy("a").agg(F.count(F.lit(1)).alias("n")).select(F.col("a").alias("id"), F.struct("n", F.col("a").alias("id")).alias("rank"))
    of = lambda c: rank.select(F.col("id").alias(c), F.col("rank").alias(f"rank_{c}"))
    ranked = cut(one.join(of("a"), "a").join(of("b"), "b"))
    into = ranked.filter("rank_a > rank_b").select(F.col("a").alias("x"), F.col("b").alias("at"))
    out = ranked.filter("rank_b > rank_a").select(F.col("a").alias("at"), F.col("b").alias("y"))
    closed = into.join(out, "at").join(one.select(F.col("a").alias("y"), F.col("b").alias("x")), ["x", "y"], "left_semi")
    triples = closed.select(F.explode(F.array("x", "at", "y")).alias("id"), F.lit(3).alias("length"))
    return pairs.unionByName(triples).groupBy("id").agg(F.min("length").alias("length"))


def pattern_hints(nodes: DataFrame, edges: DataFrame, many: int = 10) -> DataFrame:
    """id, in_cycle (a directed cycle of two or three) and crowded (more than ``many`` distinct neighbours) of every node."""
    near = both_ways(edges.select(F.col("source_id").alias("source"), F.col("target_id").alias("target"))).filter("a != b").distinct().groupBy(F.col("a").alias("id")).agg((F.count(F.lit(1)) > many).alias("crowded"))
    cycles = short_cycles(edges).select("id", F.lit(True).alias("in_cycle"))
    found = nodes.select("id").join(cycles, "id", "left").join(near, "id", "left")
    return found.select("id", F.coalesce("in_cycle", F.lit(False)).alias("in_cycle"), F.coalesce("crowded", F.lit(False)).alias("crowded"))


def focused_edges(nodes: DataFrame, links: DataFrame, visible: Column, selected: str) -> DataFrame:
    """The rendered edges that touch a node, or the visible one that stands for it."""
    mine = nearest_ancestor(nodes, visible).filter(F.col("id") == selected).select(F.col("ancestor").alias("mine"))
    return rendered_edges(nodes, links, visible).crossJoin(F.broadcast(mine.limit(1))).filter("source = mine or target = mine").drop("mine")


def tree(nodes: DataFrame, shown: Column) -> DataFrame:
    """id and parent (null: a root) of the ``shown`` nodes. Under a parent that isn't shown or whose own parents go round in a circle, a node is a root.

    Nodes are reached from the top, so circles need no search: they and what hangs on them are what isn't reached.
    """
    child = nodes.filter("parent_id is not null").select(F.col("parent_id").alias("a"), F.col("id").alias("b"))
    tops = nodes.join(nodes.select(F.col("id").alias("parent_id")), "parent_id", "left_anti").select(F.lit("all").alias("seed_id"), "id")
    reached = levels(child, tops).select("id", F.lit(True).alias("reached"))
    mine = nodes.filter(shown).select("id", "parent_id")
    clean = mine.join(reached, "id", "left_semi").join(mine.select(F.col("id").alias("parent_id")), "parent_id", "left_semi")
    return mine.select("id").join(clean.select("id", F.col("parent_id").alias("parent")), "id", "left")


def in_layout_order(nodes: DataFrame) -> DataFrame:
    """By type, then label."""
    return nodes.orderBy(F.coalesce(F.array_position(F.array(*map(F.lit, LAYOUT)), F.col("type")), F.lit(0)) == 0, F.array_position(F.array(*map(F.lit, LAYOUT)), F.col("type")), "label", "id")


def in_tree_order(entries: DataFrame) -> DataFrame:
    """The entries of ``path_trie``, folder by folder, folders before files."""
    return entries.orderBy("parent", F.desc("is_dir"), "name")


def path_trie(paths: DataFrame, root: str, path_col: str = "id") -> DataFrame:
    """path, parent, name, is_dir and files of each entry of the explorer's tree."""
    rel = F.substring(F.col(path_col), len(root) + 2, 1 << 30)
    parts = F.split(rel, "/")
    some = paths.filter(F.col(path_col).startswith(f"{root}/")).select(parts.alias("parts"), F.size(parts).alias("size"))
    each = some.select("parts", "size", F.explode(F.sequence(F.lit(1), F.col("size"))).alias("n"))
    joined = lambda n: F.array_join(F.slice("parts", 1, n), "/")
    rows = each.select(joined(F.col("n")).alias("path"), F.when(F.col("n") > 1, joined(F.col("n") - 1)).otherwise("").alias("parent"), F.element_at("parts", F.col("n")).alias("name"), (F.col("n") < F.col("size")).alias("is_dir"))
    return rows.groupBy("path").agg(F.first("parent").alias("parent"), F.first("name").alias("name"), F.bool_or("is_dir").alias("is_dir"), F.count(F.lit(1)).alias("files"))


