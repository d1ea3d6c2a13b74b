"""DuckDB SQL for those of the operators' queries that SQL can express."""

LOWER = "translate(coalesce({0}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
WORDS = f"regexp_extract_all({LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

OP1 = f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, {WORDS.format("text")} AS w FROM documents),
i AS (SELECT item_id, {WORDS.format("text")} AS w FROM benchmark),
ig AS (SELECT item_id, least(10, len(w)) AS k, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS s, w FROM i WHERE len(w) > 0),
grams AS (SELECT DISTINCT item_id, k, array_to_string(w[s : s + k - 1], ' ') AS g FROM ig),
sizes AS (SELECT DISTINCT k FROM grams),
dg AS (SELECT d.r, k, unnest(range(1, len(w) - k + 2)) AS p, w FROM d, sizes WHERE len(w) >= k),
hit AS (SELECT dg.r, dg.p, dg.k, item_id FROM dg JOIN grams ON dg.k = grams.k AND array_to_string(w[p : p + dg.k - 1], ' ') = g),
pos AS (SELECT r, count(DISTINCT q) AS n_hit FROM (SELECT r, unnest(range(p, p + k)) AS q FROM hit) GROUP BY r),
its AS (SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS listed
        FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS item_id FROM hit) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(listed, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (r) LEFT JOIN its USING (r)
"""
