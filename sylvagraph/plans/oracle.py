"""DuckDB SQL for the engine's queries: the adapter's rules as common table expressions, then one statement a query."""

from __future__ import annotations

from sylvagraph.operators.architecture import ALLOWED, LAYERS, NOT_INTEGRATION, RULES
from sylvagraph.operators.resolve import FILE_RANK, TRIED
from sylvagraph.sources.adapter import DIRS, EXTENSIONS, ROOT, STEP


def _list(values: list[str]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def _in(values: list[str]) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


FILES = f"""fx_files AS MATERIALIZED (
    SELECT id, split_part(id, '/', -1) AS label, CASE WHEN ext = '.md' AND partkey % 8 = 3 THEN 'adr' ELSE 'file' END AS type, ext, brand, partkey,
           regexp_replace(id, '/[^/]*$', '') AS parent_id, CAST(partkey * {STEP} AS BIGINT) AS ord
    FROM (
        SELECT CASE WHEN p_partkey % 10 = 7 THEN '{ROOT}' ELSE '{ROOT}/' || ({_list(DIRS)})[1 + p_partkey % {len(DIRS)}] END
                 || '/' || lower(replace(p_brand, '#', '_')) || '/part_' || p_partkey || ({_list(EXTENSIONS)})[1 + p_size % 4] AS id,
               ({_list(EXTENSIONS)})[1 + p_size % 4] AS ext, p_brand AS brand, p_partkey AS partkey
        FROM part))"""
SYMBOLS = f"""fx_symbols AS MATERIALIZED (
    SELECT f.id || '#sym_' || suppkey AS id, 'sym_' || suppkey AS label, CASE WHEN suppkey % 2 = 0 THEN 'class' ELSE 'function' END AS type,
           f.id AS parent_id, partkey, suppkey, f.ord + suppkey + 1 AS ord
    FROM (SELECT DISTINCT l_partkey AS partkey, l_suppkey AS suppkey FROM lineitem WHERE l_linestatus = 'F' AND l_quantity >= 45) s
    JOIN fx_files f USING (partkey) WHERE f.type = 'file')"""
COMMITS = f"""fx_commits AS MATERIALIZED (
    SELECT CAST(event_id AS VARCHAR) AS hash, CAST(user_id AS VARCHAR) AS author, ts, f.id AS file_path, lines AS additions, lines % 7 AS deletions
    FROM (SELECT event_id, user_id, ts, CAST(floor(abs(value)) AS BIGINT) AS lines,
                 (user_id * 31 + coalesce(CAST(json_extract_string(props, '$.k') AS BIGINT), 0)) % (SELECT count(*) FROM part) AS partkey FROM events) e
    JOIN fx_files f USING (partkey))"""
NODES = f"""fx_dirs AS MATERIALIZED (
    SELECT DISTINCT '{ROOT}/' || array_to_string(parts[1:n], '/') AS id
    FROM (SELECT string_split(substr(id, {len(ROOT) + 2}), '/') AS parts FROM fx_files), unnest(range(1, len(parts))) AS r(n)
), fx_churn AS (SELECT file_path AS id, count(*) AS n FROM fx_commits GROUP BY file_path),
nodes AS MATERIALIZED (
    SELECT id, split_part(id, '/', -1) AS label, 'directory' AS type, CAST(0 AS BIGINT) AS churn,
           CASE WHEN regexp_replace(id, '/[^/]*$', '') <> '{ROOT}' THEN regexp_replace(id, '/[^/]*$', '') END AS parent_id,
           -CAST('0x' || substr(md5(id), 1, 12) AS BIGINT) - 1 AS ord
    FROM fx_dirs
    UNION ALL
    SELECT f.id, CASE WHEN type = 'adr' THEN 'ADR: ' ELSE '' END || label, type, coalesce(n, 1), CASE WHEN parent_id <> '{ROOT}' THEN parent_id END, ord
    FROM fx_files f LEFT JOIN fx_churn c ON c.id = f.id
    UNION ALL
    SELECT s.id, label, type, coalesce(n, 1), parent_id, ord FROM fx_symbols s LEFT JOIN fx_churn c ON c.id = s.parent_id)"""
LINKS = f"""fx_links_raw AS MATERIALIZED (
    SELECT s.id AS source,
           CASE WHEN (a + b) % 3 = 0 THEN regexp_replace(t.id, '\\.[^./]+$', '') ELSE t.id END || CASE WHEN (a + b) % 5 = 0 THEN '#sym_' || k ELSE '' END AS target,
           CASE WHEN (a + b) % 5 = 0 THEN 2 ELSE 1 END AS value, 'import' AS type, CAST(a * 100000000 + b AS BIGINT) AS ord
    FROM (SELECT x.l_partkey AS a, y.l_partkey AS b, min(y.l_suppkey) AS k
          FROM lineitem x JOIN lineitem y ON y.l_orderkey = x.l_orderkey AND y.l_linenumber = x.l_linenumber + 1
          WHERE x.l_returnflag = 'R' AND x.l_quantity >= 30 AND x.l_partkey <> y.l_partkey GROUP BY 1, 2) p
    JOIN fx_files s ON s.partkey = a JOIN fx_files t ON t.partkey = b WHERE s.type = 'file'
    UNION ALL
    SELECT f.id, first, 3, 'adr', CAST(f.partkey * 100000000 + 99999999 AS BIGINT)
    FROM fx_files f JOIN (SELECT brand, arg_min(id, partkey) AS first FROM fx_files WHERE type = 'adr' GROUP BY brand) d USING (brand)
    WHERE f.type = 'file' AND f.partkey % 10 = 0
), fx_tried AS (
    SELECT l.*, CASE WHEN contains(target, '#') THEN split_part(target, '#', 2) END AS symbol, split_part(target, '#', 1) || suffix AS file, nth - 1 AS nth
    FROM fx_links_raw l, (SELECT unnest({_list(TRIED)}) AS suffix, generate_subscripts({_list(TRIED)}, 1) AS nth) t
    WHERE target NOT IN (SELECT id FROM nodes)
), fx_candidates AS (
    SELECT source, target, value, type, ord, nth * 3 AS rank, file || '#' || symbol AS found FROM fx_tried WHERE symbol IS NOT NULL
    UNION ALL SELECT source, target, value, type, ord, nth + {FILE_RANK}, file FROM fx_tried
), links AS MATERIALIZED (
    SELECT source, target, value, type, ord FROM fx_links_raw WHERE target IN (SELECT id FROM nodes)
    UNION ALL
    SELECT source, arg_min(found, rank), value, type, ord FROM fx_candidates WHERE found IN (SELECT id FROM nodes) GROUP BY source, target, value, type, ord)"""


def _case(value: int, default: str) -> str:
    # The same rules; RE2 writes the end of the text as $.
    tests = " ".join(f"WHEN regexp_matches(path, '(?i){r[0].replace(chr(92) + 'z', '$')}') THEN '{r[value]}'" for r in RULES)
    return f"CASE {tests} ELSE '{default}' END"


CLASSIFIED = f"""classified AS MATERIALIZED (
    SELECT id, type, ord, {_case(1, "unknown")} AS layer, {_case(2, "no_rule_matched")} AS reason
    FROM (SELECT id, type, ord, split_part(id, '#', 1) AS path FROM nodes))"""
_STRICT = " OR ".join(f"(source_layer = '{k}' AND target_layer NOT IN {_in(v)})" for k, v in ALLOWED.items())
VIOLATES = f"""(source_layer <> 'unknown' AND target_layer <> 'unknown' AND source_layer <> target_layer
    AND (target_layer = 'presentation' OR {_STRICT} OR (source_layer IN {_in(NOT_INTEGRATION)} AND target_layer = 'integration')))"""
EDGES = f"""edges AS MATERIALIZED (
    SELECT s, t, coalesce(a.layer, 'unknown') AS source_layer, coalesce(b.layer, 'unknown') AS target_layer, e.ord
    FROM (SELECT split_part(source, '#', 1) AS s, split_part(target, '#', 1) AS t, min(ord) AS ord FROM links WHERE type = 'import' GROUP BY 1, 2) e
    LEFT JOIN classified a ON a.id = s LEFT JOIN classified b ON b.id = t WHERE s <> t
), violations AS (SELECT * FROM edges WHERE {VIOLATES})"""
DEGREES = """degrees AS MATERIALIZED (
    SELECT n.*, coalesce(fan_in, 0) AS fan_in, coalesce(fan_out, 0) AS fan_out FROM nodes n
    LEFT JOIN (SELECT target AS id, count(*) AS fan_in FROM links GROUP BY target) USING (id)
    LEFT JOIN (SELECT source AS id, count(*) AS fan_out FROM links GROUP BY source) USING (id)
), root AS MATERIALIZED (SELECT id FROM degrees WHERE type = 'file' ORDER BY fan_in DESC, ord, id LIMIT 1)"""
STORED = """stored AS MATERIALIZED (
    SELECT source AS source_id, target AS target_id, CASE type WHEN 'structure' THEN 'contains' WHEN 'import' THEN 'imports' WHEN 'adr' THEN 'references' ELSE 'depends_on' END AS type
    FROM links WHERE source IN (SELECT id FROM nodes) AND target IN (SELECT id FROM nodes))"""
ANCESTRY = """chain AS (
    SELECT n.id, p.id AS ancestor, p.parent_id AS up, 1 AS distance FROM nodes n JOIN nodes p ON p.id = n.parent_id
    UNION ALL SELECT c.id, p.id, p.parent_id, distance + 1 FROM chain c JOIN nodes p ON p.id = c.up WHERE distance < (SELECT count(*) FROM nodes))"""
ORPHANS = """orphans AS (
    SELECT n.id, n.type, n.ord FROM nodes n JOIN classified c USING (id)
    WHERE layer <> 'configuration' AND n.type NOT IN ('directory', 'project') AND n.id NOT IN (SELECT source FROM links) AND n.id NOT IN (SELECT target FROM links)
      AND n.id NOT IN (SELECT parent_id FROM nodes WHERE parent_id IS NOT NULL) AND (n.parent_id IS NULL OR n.parent_id NOT IN (SELECT id FROM nodes)))"""

GRAPH = [FILES, SYMBOLS, COMMITS, NODES, LINKS]


def sql(body: str, *more: str, base: list[str] | None = None) -> str:
    return "WITH RECURSIVE " + ",\n".join([*(GRAPH if base is None else base), *more]) + "\n" + body


def plain_sql(body: str, *more: str) -> str:
    """The same without recursion and without tables that must be kept."""
    return sql(body, *more).replace("WITH RECURSIVE ", "WITH ", 1).replace(" AS MATERIALIZED (", " AS (")


LAYER_RANK = f"list_position({_list(LAYERS)}, layer)"
