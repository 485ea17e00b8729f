"""A subset of Cypher over stored nodes and edges, compiled to DataFrames.

``MATCH (n)``, ``MATCH (a)-[r]->(b)`` and ``MATCH (n)-[*2..3]->(n)``, with labels and types ignored; WHERE with =, <>, STARTS WITH, CONTAINS,
IN, AND, OR; RETURN of properties, COUNT and DISTINCT; ORDER BY and LIMIT. Anything else is refused.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sylvagraph.operators.traverse import short_cycles

_STATEMENT = re.compile(r"^\s*MATCH\s+(?P<match>.+?)(?:\s+WHERE\s+(?P<where>.+?))?\s+RETURN\s+(?P<distinct>DISTINCT\s+)?(?P<returns>.+?)(?:\s+ORDER\s+BY\s+(?P<order>.+?))?(?:\s+LIMIT\s+(?P<limit>\d+))?\s*;?\s*$", re.I | re.S)
_NODE = r"\(\s*(\w+)?\s*(?::\s*\w+)?\s*\)"
_ONE = re.compile(rf"^{_NODE}$")
_EDGE = re.compile(rf"^{_NODE}\s*-\s*\[\s*(\w+)?\s*(?::\s*\w+)?\s*\]\s*->\s*{_NODE}$")
_CYCLE = re.compile(rf"^{_NODE}\s*-\s*\[\s*(?::\s*\w+)?\s*\*\s*2\s*\.\.\s*3\s*\]\s*->\s*{_NODE}$")
_PROPERTIES = {"id": "id", "type": "type", "label": "label", "filepath": "id", "sourceid": "source_id", "targetid": "target_id"}


def _sql(text: str) -> str:
    """A condition or expression in SQL: a.property becomes a column of the joined row."""
    pieces = re.split(r"('(?:[^'\\]|\\.)*')", text)
    for i in range(0, len(pieces), 2):
        p = re.sub(r"\b(\w+)\.(\w+)\b", lambda m: f"`{m[1]}.{_property(m[2])}`", pieces[i])
        p = re.sub(r"\bIN\s*\[([^\]]*)", r"IN (\1", p, flags=re.I).replace("]", ")")
        pieces[i] = p
    joined = "".join(pieces)
    joined = re.sub(r"IN\s*\[", "IN (", joined, flags=re.I)
    for word, name in ((r"STARTS\s+WITH", "startswith"), (r"ENDS\s+WITH", "endswith"), ("CONTAINS", "contains")):
        joined = re.sub(rf"(`[^`]+`)\s+{word}\s+('(?:[^'\\]|\\.)*')", rf"{name}(\1, \2)", joined, flags=re.I)
    return joined


def _property(name: str) -> str:
    if name.lower() not in _PROPERTIES:
        raise ValueError(f"unknown property {name!r}")
    return _PROPERTIES[name.lower()]


def _prefixed(df: DataFrame, name: str) -> DataFrame:
    return df.select(*(F.col(c).alias(f"{name}.{c}") for c in df.columns))


def run(statement: str, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``nodes``: id, type, label; ``edges``: source_id, target_id, type."""
    m = _STATEMENT.match(statement)
    if not m:
        raise ValueError("only MATCH ... RETURN is supported")
    nodes = nodes.select("id", "type", "label")
    pattern = m["match"].strip()
    if one := _ONE.match(pattern):
        name = one[1] or "n"
        rows, whole = _prefixed(nodes, name), {name: f"`{name}.id`"}
    elif edge := _EDGE.match(pattern):
        a, r, b = edge[1] or "a_", edge[2] or "r_", edge[3] or "b_"
        rows = _prefixed(edges, r).join(_prefixed(nodes, a), F.col(f"`{r}.source_id`") == F.col(f"`{a}.id`")).join(_prefixed(nodes, b), F.col(f"`{r}.target_id`") == F.col(f"`{b}.id`"))
        whole = {a: f"`{a}.id`", b: f"`{b}.id`", r: f"`{r}.source_id`"}
    elif (cycle := _CYCLE.match(pattern)) and cycle[1] == cycle[2]:
        name = cycle[1] or "n"
        rows, whole = _prefixed(nodes.join(short_cycles(edges), "id", "left_semi"), name), {name: f"`{name}.id`"}
    else:
        raise ValueError(f"unsupported pattern {pattern!r}")
    if m["where"]:
        rows = rows.filter(F.expr(_sql(m["where"])))
    plain, counted = [], []
    for item in re.split(r",(?![^()]*\))", m["returns"]):
        text, _, alias = (x.strip() for x in re.sub(r"\s+AS\s+", "\0", item.strip(), flags=re.I).partition("\0"))
        count = re.fullmatch(r"COUNT\s*\(\s*(\*|\w+)\s*\)", text, re.I)
        if count:
            counted.append(F.count(F.lit(1) if count[1] == "*" else F.expr(whole[count[1]])).alias(alias or "count"))
        else:
            plain.append(F.expr(whole.get(text) or _sql(text)).alias(alias or text.rpartition(".")[2]))
    out = rows.groupBy(*plain).agg(*counted) if counted and plain else rows.agg(*counted) if counted else rows.select(*plain)
    out = out.distinct() if m["distinct"] else out
    if m["order"]:
        keys = [re.match(r"(?:\w+\.)?(\w+)(?:\s+(ASC|DESC))?\s*$", k.strip(), re.I) for k in m["order"].split(",")]
        out = out.orderBy(*(F.desc(k[1]) if (k[2] or "").upper() == "DESC" else F.asc(k[1]) for k in keys))
    return out.limit(int(m["limit"])) if m["limit"] else out
