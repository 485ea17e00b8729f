"""DuckDB SQL of the queries that SQL can express."""

from __future__ import annotations

from sylvagraph.llm.mixing import BLOCK_ROWS, TARGET_WEIGHTS


def pfair_mixing(weights: dict[str, int] = TARGET_WEIGHTS, block_rows: int = BLOCK_ROWS) -> str:
    cases = " ".join(f"WHEN '{name}' THEN {m}" for name, m in sorted(weights.items()))
    return f"""
WITH RECURSIVE ranked AS (
    SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5(coalesce(CAST(doc_id AS VARCHAR), '')), doc_id) - 1 AS rank
    FROM documents
), sources AS (
    SELECT source, (count(*) + {block_rows - 1}) // {block_rows} AS blocks, CASE source {cases} ELSE 1 END AS m
    FROM documents GROUP BY source
), edges AS (
    SELECT DISTINCT unnest([0, blocks // m, (blocks + m - 1) // m]) AS from_round FROM sources
), shares AS (
    SELECT from_round, source, least(blocks, from_round * m) AS done, greatest(0, least(m, blocks - from_round * m)) AS c
    FROM edges, sources
), phases AS (
    SELECT from_round, lead(from_round) OVER (ORDER BY from_round) AS to_round, slots_before, size
    FROM (SELECT from_round, sum(done) AS slots_before, sum(c) AS size FROM shares GROUP BY from_round) WHERE size > 0
), sim AS (
    SELECT from_round, source, c, size, CAST(0 AS BIGINT) AS n, CAST(-1 AS BIGINT) AS t, false AS taken
    FROM shares JOIN phases USING (from_round) WHERE c > 0
    UNION ALL
    SELECT from_round, source, c, size, CAST(n + (place = 1)::INT AS BIGINT), t + 1, place = 1
    FROM (
        SELECT *, row_number() OVER (PARTITION BY from_round ORDER BY (n < c AND (n * size) // c <= t + 1) DESC, ((n + 1) * size + c - 1) // c, source NULLS FIRST) AS place
        FROM sim WHERE t + 1 < size
    )
), pattern AS (
    SELECT from_round, source, n - 1 AS j, t FROM sim WHERE taken
), placed AS (
    SELECT doc_id, ranked.source AS source, rank // {block_rows} AS block, rank % {block_rows} AS row_in_block, m, (rank // {block_rows}) // m AS round, (rank // {block_rows}) % m AS j
    FROM ranked JOIN sources ON ranked.source IS NOT DISTINCT FROM sources.source
)
SELECT doc_id, placed.source AS source, CAST(block AS BIGINT) AS block,
       CAST(slots_before + (round - phases.from_round) * size + t AS BIGINT) AS slot, CAST(row_in_block AS BIGINT) AS row_in_block
FROM placed
JOIN phases ON round >= phases.from_round AND (to_round IS NULL OR round < to_round)
JOIN pattern ON pattern.from_round = phases.from_round AND pattern.source IS NOT DISTINCT FROM placed.source AND pattern.j = placed.j
"""


TOP_K = """
WITH whole AS (
    SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
    FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scores AS (
    SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
    FROM whole q JOIN whole c ON q.vec_id <> c.vec_id
    WHERE q.vec_id % 50 = 0
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scores)
WHERE rank <= 5
"""


NEAR_VECTORS = """
WITH RECURSIVE usable AS (
    SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v
    FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
      AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
    SELECT a.vec_id AS a, b.vec_id AS b
    FROM usable a JOIN usable b ON a.vec_id <> b.vec_id
    WHERE list_cosine_similarity(a.v, b.v) >= 0.9
), reach AS (
    SELECT vec_id AS a, vec_id AS b FROM embeddings WHERE vec_id IS NOT NULL
    UNION
    SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b
), components AS (
    SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a
), counts AS (
    SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a
)
SELECT e.vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, component_id, e.vec_id IS NOT DISTINCT FROM component_id AS kept
FROM embeddings e LEFT JOIN components c ON c.vec_id = e.vec_id LEFT JOIN counts l ON l.vec_id = e.vec_id
"""
