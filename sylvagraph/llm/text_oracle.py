"""DuckDB SQL of the license scan, the lexical search and the collocations."""

from __future__ import annotations

from sylvagraph.llm.licenses import LOWER, RELEVANCE, RULES, UPPER, spaced


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def license_scan() -> str:
    rules = ",\n".join(f"({k}, {_text(r.keyword)}, {_text(' (' + spaced(r.pattern)[1:-1] + ') ')}, {_text(r.label)}, {r.priority}, {r.base})" for k, r in enumerate(RULES))
    relevance = " ".join(f"WHEN {p} THEN {v}" for p, v in RELEVANCE.items())
    covered = " OR ".join(f"(priority = {p} AND max(CASE WHEN priority >= {p} THEN last END) OVER before >= last)" for p in sorted({r.priority for r in RULES}))
    return rf"""
WITH rules(rule, keyword, pattern, label, priority, base) AS (VALUES {rules}),
bare AS (
    SELECT doc_id, row_number() OVER () AS row, trim(regexp_replace(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+', '  ', 'g')) AS t
    FROM documents
), texts AS (
    SELECT doc_id, row, CASE WHEN t = '' THEN '' ELSE ' ' || t || ' ' END AS words, CASE WHEN t = '' THEN 0 ELSE len(string_split(t, '  ')) END AS n_words FROM bare
), marked AS (
    SELECT row, rule, label, priority, base, string_split(trim(regexp_replace(words, pattern, ' ' || chr(1) || '\1' || chr(2) || ' ', 'g')), '  ') AS ws
    FROM texts JOIN rules ON contains(words, keyword)
), spans AS (
    SELECT row, rule, label, priority, base,
        unnest(list_filter(list_transform(ws, lambda w, i: CASE WHEN starts_with(w, chr(1)) THEN i - 1 END), lambda i: i IS NOT NULL)) AS first,
        unnest(list_filter(list_transform(ws, lambda w, i: CASE WHEN suffix(w, chr(2)) THEN i - 1 END), lambda i: i IS NOT NULL)) AS last
    FROM marked
), judged AS (
    SELECT *, coalesce({covered}, false) AS covered FROM spans
    WINDOW before AS (PARTITION BY row ORDER BY first, last DESC, priority DESC, rule ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), summed AS (
    SELECT row, count(*) FILTER (base) AS n_base, min(first) FILTER (base) AS first_word, max(first) FILTER (base) AS last_word,
        string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base OR NOT covered) AS labels,
        max(CASE priority {relevance} END) FILTER (NOT covered) AS score
    FROM judged GROUP BY row
)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
    coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, CAST(coalesce(score, 0) AS DOUBLE) AS score
FROM texts LEFT JOIN summed USING (row)
"""


LEXICAL = rf"""
WITH terms AS (
    SELECT row, doc_id, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
    FROM (SELECT row_number() OVER () AS row, doc_id, text FROM documents)
), tfs AS (
    SELECT row, any_value(doc_id) AS doc_id, term, count(*) AS tf FROM terms GROUP BY row, term
), lengths AS (
    SELECT row, sum(tf) AS n FROM tfs GROUP BY row
), totals AS (
    SELECT count(*) AS docs, sum(n) AS total FROM lengths
), weights AS (
    SELECT term, CAST(floor(1000 * ln((2 * any_value(docs) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tfs, totals GROUP BY term
), asked AS (
    SELECT DISTINCT item, item_id, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
    FROM (SELECT row_number() OVER () AS item, item_id, text FROM benchmark)
), scores AS (
    SELECT item, any_value(item_id) AS item_id, row, any_value(doc_id) AS doc_id,
        CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + CAST((90 * n * docs) // total AS BIGINT))))) AS BIGINT) AS score
    FROM asked JOIN tfs USING (term) JOIN weights USING (term) JOIN lengths USING (row), totals GROUP BY item, row
)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id) AS rank FROM scores WHERE score > 0)
WHERE rank <= 10
"""


COLLOCATIONS = rf"""
WITH pieces AS (
    SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(text, '{UPPER}', '{LOWER}'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
), words AS (
    SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM pieces
), grams AS (
    SELECT lang, g AS size, unnest(list_transform(range(1, len(ws) - g + 2), lambda i: array_to_string(ws[i:i + g - 1], ' '))) AS phrase
    FROM words, range(1, 5) AS sizes(g) WHERE len(ws) >= g
), counts AS (
    SELECT lang, size, phrase, count(*) AS f FROM grams GROUP BY lang, size, phrase HAVING count(*) >= 30
), candidates AS (
    SELECT lang, size, phrase, f AS a, string_split(phrase, ' ') AS ws FROM counts WHERE size > 1
), cuts AS (
    SELECT lang, phrase, a, size, k, array_to_string(ws[1:k], ' ') AS head, array_to_string(ws[k + 1:], ' ') AS tail FROM candidates, range(1, 4) AS t(k) WHERE k < size
), scored AS (
    SELECT c.lang, c.phrase, c.size, a, k, x.f AS l, y.f AS r, CAST((2000000::HUGEINT * a) // (x.f + y.f) AS BIGINT) AS score
    FROM cuts c JOIN counts x ON x.lang = c.lang AND x.phrase = head JOIN counts y ON y.lang = c.lang AND y.phrase = tail
), worst AS (
    SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), inner_phrases AS (
    SELECT lang, array_to_string(ws[i:i + g - 1], ' ') AS phrase, max(a) AS wider
    FROM candidates, range(2, 4) AS sizes(g), range(1, 4) AS starts(i) WHERE g < size AND i + g - 1 <= size GROUP BY 1, 2
), free AS (
    SELECT w.* FROM worst w LEFT JOIN inner_phrases i ON i.lang = w.lang AND i.phrase = w.phrase WHERE wider IS NULL OR 100::HUGEINT * wider < 80::HUGEINT * a
), totals AS (
    SELECT lang, sum(len(ws)) AS n FROM words GROUP BY lang
)
SELECT free.lang, CAST(rank AS BIGINT) AS rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, CAST(n AS BIGINT) AS n, score
FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM free) AS free JOIN totals ON totals.lang = free.lang WHERE rank <= 2000
"""
