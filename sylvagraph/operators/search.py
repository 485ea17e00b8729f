"""Node search, target resolution, scores of texts against nodes, and declarations in sources."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sylvagraph.functions.paths import basename, stem, structural
from sylvagraph.operators.holding import holding
from sylvagraph.operators.patterns import is_safe

# What a match adds. Keys name what is compared: the label, the file's base name, its stem.
GENERIC = {"label=": 140, "base=": 180, "stem=": 220, "label_stem=": 160, "id$": 160, "label^": 60, "base^": 80, "stem^": 100, "label*": 25, "id/": 20}
#: (for files, for other types)
TASK = {"label=": (160, 160), "base=": (180, 90), "stem=": (220, 100), "label^": (90, 90), "base^": (100, 50), "stem^": (120, 60), "label*": (40, 40), "id*": (35, 20)}
CAMPAIGN = {"label=": (160, 160), "base=": (200, 100), "stem=": (240, 120), "label^": (90, 90), "base^": (110, 50), "stem^": (130, 60), "label*": (45, 45), "id*": (40, 20)}
TYPE_PRIORITY = {"function": 6, "class": 5, "file": 4, "adr": 3, "directory": 1}
CAMPAIGN_PRIORITY = {"file": 5, "class": 4, "function": 3}
CODE_TYPES = ["file", "class", "function", "adr"]
# How a line begins that declares something. The border after a keyword is written out: words are ASCII here, and Java's own border also counts other letters.
DECLARATIONS = [
    r"^\s*(export\s+)?(default\s+)?(async\s+)?(class|function|interface|type|enum|struct|trait|impl|def|func|fn|module|namespace)(?![A-Za-z0-9_])",
    r"^\s*(export\s+)?(const|let|var)\s+\w+\s*=\s*(async\s*)?\([^)]*\)\s*=>",
    r"^\s*\w+\s*:\s*(async\s*)?\([^)]*\)\s*=>",
    r"^\s*(public|private|protected|static|readonly|abstract|\s)*\s*\w+\s*\([^;=]*\)\s*(?::\s*[^=]+)?\s*\{",
]


def type_priority(kind: Column, table: dict[str, int] = TYPE_PRIORITY, default: int = 2) -> Column:
    found = F.lit(default)
    for name, n in table.items():
        found = F.when(kind == name, n).otherwise(found)
    return found


def _names() -> Column:
    """What of a node is compared with a query."""
    label, ident = F.lower("label"), F.lower("id")
    base = basename(structural(ident))
    return F.struct(label.alias("label"), ident.alias("id"), base.alias("base"), stem(base).alias("stem"))


def _tests(query: Column, names: Column | None = None) -> dict[str, Column]:
    names = _names() if names is None else names
    label, ident, base, near = (names[c] for c in ("label", "id", "base", "stem"))
    return {
        "label=": label == query, "base=": base == query, "stem=": near == query, "label_stem=": stem(label) == query,
        "id$": ident.endswith(F.concat(F.lit("/"), query)) | ident.endswith(F.concat(F.lit("/"), query, F.lit(".ts"))) | ident.endswith(F.concat(F.lit("/"), query, F.lit(".tsx"))),
        "label^": label.startswith(query), "base^": base.startswith(query), "stem^": near.startswith(query),
        "label*": label.contains(query), "id*": ident.contains(query), "id/": ident.contains(F.concat(F.lit("/"), query)),
    }


def generic_score(query: Column) -> Column:
    tests = _tests(query)
    total = type_priority(F.col("type")) * 10 + F.when(F.col("type").isin(CODE_TYPES), 20).otherwise(0)
    for name, points in GENERIC.items():
        total = total + F.when(tests[name], points).otherwise(0)
    return total


def weighted_score(query: Column, weights: dict[str, tuple[int, int]], priority: Column, names: Column | None = None) -> Column:
    """0 without any match of texts."""
    tests, total = _tests(query, names), F.lit(0)
    for name, (of_file, other) in weights.items():
        total = total + F.when(tests[name], F.when(F.col("type") == "file", of_file).otherwise(other)).otherwise(0)
    return F.when((F.length(query) > 0) & (total > 0), total + priority * 10).otherwise(0)


def task_score(query: Column, names: Column | None = None) -> Column:
    return weighted_score(query, TASK, type_priority(F.col("type")), names)


def campaign_score(query: Column, names: Column | None = None) -> Column:
    return weighted_score(query, CAMPAIGN, type_priority(F.col("type"), CAMPAIGN_PRIORITY, 1), names)


def _matching(nodes: DataFrame, query: str, kind: str | None) -> DataFrame:
    asked = query.strip().lower()
    some = nodes if kind is None else nodes.filter(F.col("type") == kind)
    return some.filter(F.lower("label").contains(asked) | F.lower("id").contains(asked)) if asked else some


def search(nodes: DataFrame, query: str, kind: str | None = None, limit: int = 20) -> DataFrame:
    """The first matches in store order."""
    return _matching(nodes, query, kind).orderBy("ord", "id").limit(limit)


def ranked_search(nodes: DataFrame, query: str, kind: str | None = None, limit: int = 20) -> DataFrame:
    """The best matches: score, type, label, id."""
    scored = _matching(nodes, query, kind).withColumn("score", generic_score(F.lit(query.strip().lower()))).filter("score > 0")
    return scored.orderBy(F.desc("score"), F.desc(type_priority(F.col("type"))), "label", "id").limit(limit)


def best_scores(nodes: DataFrame, queries: DataFrame, weights: str) -> DataFrame:
    """``nodes`` with the highest score over all queries (column query; few rows, so each node is scored against them as a list)."""
    score = {"task": task_score, "campaign": campaign_score}[weights]
    asked = queries.agg(F.collect_set(F.trim(F.lower("query"))).alias("q"))
    # A lambda's variable is a value: names are made once a node, not once a test.
    best = F.transform(F.array(_names()), lambda names: F.array_max(F.transform("asked", lambda q: score(q, names))))[0]
    return nodes.withColumn("asked", asked.scalar()).withColumn("score", best).filter("score > 0").drop("asked", "exports")


def target_candidates(nodes: DataFrame, queries: DataFrame, limit: int = 6) -> DataFrame:
    found = best_scores(nodes, queries, "task")
    return found.orderBy(F.desc("score"), F.desc(type_priority(F.col("type"))), "label", "id").limit(limit).select("id", "type", "label", "score")


def resolve_target(nodes: DataFrame, target: str, kind: str | None = None) -> tuple[dict, list[dict], str]:
    """The node that a text means, alternatives and how it was matched: exact id, else best match; a folder gives way to code of its name."""
    asked = target.strip().lower()
    exact = nodes.filter(F.lower("id") == asked).orderBy("ord").limit(1).select("id", "label", "type").collect()
    if exact:
        return exact[0].asDict(), [], "exact_id"
    found = [r.asDict() for r in ranked_search(nodes, target, kind, 6).select("id", "label", "type").collect()]
    if not found:
        raise LookupError(f"no node matches {target!r}")
    top = found[0]
    if top["type"] == "directory":
        top = next((r for r in found if r["type"] in CODE_TYPES and _named(r, asked)), top)
    return top, [r for r in found if r["id"] != top["id"]][:5], "promoted_code" if top is not found[0] else "ranked"


def match_reason(node: dict, asked: str) -> tuple[str, bool]:
    """What a found node shares with the text that was asked for, and whether that is a whole name of it."""
    asked, label = asked.strip().lower(), node["label"].lower()
    base = node["id"].lower().split("#")[0].rsplit("/", 1)[-1]
    if re.sub(r"\.[^.]+$", "", base) == asked:
        return "basename_without_extension_match", True
    if base == asked:
        return "basename_match", True
    if label == asked:
        return "label_match", True
    return ("label_prefix_match" if label.startswith(asked) else "fuzzy_graph_match"), False


def _named(row: dict, asked: str) -> bool:
    base = row["id"].lower().split("#")[0].rsplit("/", 1)[-1]
    label = row["label"].lower()
    return asked in (base, re.sub(r"\.[^.]+$", "", base), label) or label.startswith(asked)


def is_declaration(line: Column) -> Column:
    found = F.lit(False)
    for pattern in DECLARATIONS:
        found = found | line.rlike(pattern)
    return found


def line_test(query: str, regex: bool = False, case_sensitive: bool = False):
    """A test of lines. Patterns that nest repetitions or have too many of them are refused."""
    if regex:
        if not is_safe(query):
            raise ValueError("unsafe pattern")
        return lambda line: line.rlike(query if case_sensitive else f"(?i){query}")
    if case_sensitive:
        return lambda line: line.contains(query)
    return lambda line: F.lower(line).contains(query.lower())


def signatures(nodes: DataFrame, lines: DataFrame, query: str, kind: str | None = None, limit: int = 20, case_sensitive: bool = False, regex: bool = False) -> DataFrame:
    """node_id, symbol_id, symbol_type, line and preview of the first matching declarations by file and line. ``lines``: file_id, line_no, line.

    A line's symbol is the first of its file whose label it contains.
    """
    test = line_test(query.strip(), regex, case_sensitive)
    found = lines.filter(is_declaration(F.col("line")) & test(F.col("line"))) if query.strip() else lines.limit(0)
    files = nodes.filter("type = 'file'").select(F.col("id").alias("file_id"), F.col("ord").alias("file_ord"))
    symbols = nodes.filter(F.col("id").contains("#")).select(F.col("parent_id").alias("file_id"), F.col("id").alias("symbol_id"), F.col("type").alias("symbol_type"), "label", "ord")
    texts = found.select("file_id", "line_no", F.col("line").alias("text"))
    held = holding(symbols.select("file_id", F.col("label").alias("needle")), texts, ["file_id"]).withColumnRenamed("needle", "label")
    own = held.join(symbols, ["file_id", "label"]).groupBy("file_id", "line_no").agg(F.min_by(F.struct("symbol_id", "symbol_type"), F.struct("ord", "symbol_id")).alias("s"))
    rows = found.join(files, "file_id").join(own, ["file_id", "line_no"], "left").select(
        F.col("file_id").alias("node_id"), F.col("s.symbol_id").alias("symbol_id"), F.col("s.symbol_type").alias("symbol_type"), F.col("line_no").alias("line"), F.trim("line").alias("preview"), "file_ord"
    )
    rows = rows if kind is None else rows.filter(F.col("symbol_type") == kind)
    return rows.orderBy("file_ord", "line").limit(limit).drop("file_ord")
