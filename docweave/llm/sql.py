"""DuckDB SQL of the queries for training data, where SQL can express them."""

_N = "nullif(lower(trim({}, ' ' || chr(9) || chr(10) || chr(13))), '')"
#: Near repeats by all pairs that share a shingle, then row by row in their order, the accepted keys in a list.
_NEAR = """v AS (SELECT DISTINCT ON (vector_id) vector_id AS k, coalesce(batch_no, 1000000) AS b, regexp_extract_all(lower(content), '[\\p{L}\\p{N}]+') AS w FROM vector_metadata WHERE content IS NOT NULL),
sh AS MATERIALIZED (SELECT DISTINCT k, b, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT k, b, w, unnest(range(1, len(w) - 1)) AS i FROM v WHERE len(w) >= 3)),
n AS MATERIALIZED (SELECT k, any_value(b) AS b, count(*) AS n FROM sh GROUP BY k),
p AS (SELECT x.k AS a, y.k AS c, count(*) AS o FROM sh x JOIN sh y USING (g) WHERE x.b < y.b OR (x.b = y.b AND x.k < y.k) GROUP BY 1, 2),
l AS MATERIALIZED (SELECT a, c FROM p JOIN n x ON x.k = a JOIN n y ON y.k = c WHERE o >= 0.7::DOUBLE * (x.n + y.n - o) - 1e-9),
q AS (SELECT c, list(a) AS nb FROM l GROUP BY c),
u AS MATERIALIZED (SELECT k, row_number() OVER (ORDER BY b, k) AS pos, coalesce(nb, []) AS nb FROM n LEFT JOIN q ON c = k WHERE k IN (SELECT a FROM l UNION SELECT c FROM l)),
s AS (SELECT 0::BIGINT AS i, []::BIGINT[] AS acc UNION ALL SELECT i + 1, CASE WHEN list_has_any(acc, u.nb) THEN acc ELSE list_append(acc, u.k) END FROM s JOIN u ON u.pos = s.i + 1),
acc AS (SELECT acc FROM s ORDER BY i DESC LIMIT 1),
near AS (SELECT list_min(list_filter(u.nb, lambda x: list_contains(acc.acc, x))) AS kept_id, u.k AS dup_id FROM u, acc WHERE NOT list_contains(acc.acc, u.k))"""

SQL: dict[str, str] = {
    "p2_found": f"""WITH RECURSIVE {_NEAR},
h AS (SELECT DISTINCT record_id AS k, coalesce(batch_no, 1000000) AS b, coalesce({_N.format("document_id")}, '') AS doc, regexp_replace({_N.format("content_hash")}, '^sha256:\\s*', '')[1:32] AS h FROM document_records),
o AS (SELECT h, arg_min(doc, (b, k)) AS owner FROM h WHERE h <> '' GROUP BY h)
SELECT 'vector_metadata' AS table_name, kept_id, dup_id FROM near
UNION ALL SELECT 'document_records', min(a.k), r.k FROM h r JOIN o USING (h) JOIN h a ON a.h = r.h AND a.doc = o.owner AND (a.b < r.b OR (a.b = r.b AND a.k < r.k)) WHERE r.doc <> o.owner GROUP BY r.k""",
    "p2_batches": f"WITH RECURSIVE {_NEAR} SELECT kept_id, dup_id FROM near",
    "p4_whole": """
SELECT DISTINCT v.vector_id, CAST(v.characters AS BIGINT) AS characters, true AS within FROM (
  SELECT vector_id, length(content) AS characters, length(content) // 4 AS size,
         CASE WHEN json_valid(metadata) THEN json_extract_string(metadata, '$.strategy') END AS strategy FROM vector_metadata) v
LEFT JOIN chunking_config c ON c.strategy = v.strategy
WHERE v.size > coalesce(c.chunk_size, (SELECT chunk_size FROM chunking_config WHERE strategy = 'sentence'))""",
    "p9_kept": f"""SELECT DISTINCT t.source, true AS repeats_kept, true AS share_kept FROM (SELECT {_N.format("source")} AS source FROM mixture_targets WHERE target_share > 0 AND max_repeats > 0) t
JOIN (SELECT DISTINCT {_N.format("source")} AS source FROM documents WHERE length(text) > 0) d USING (source)""",
    "p4_found": """
SELECT DISTINCT v.vector_id FROM (
  SELECT vector_id, length(content) // 4 AS size,
         CASE WHEN json_valid(metadata) THEN json_extract_string(metadata, '$.strategy') END AS strategy FROM vector_metadata) v
LEFT JOIN chunking_config c ON c.strategy = v.strategy
WHERE v.size > coalesce(c.chunk_size, (SELECT chunk_size FROM chunking_config WHERE strategy = 'sentence'))""",
    "p3_ten": """
WITH v AS (SELECT vector_id, e.embedding::DOUBLE[] AS x FROM (SELECT chunk_id, min(embedding) AS embedding FROM chunk_embeddings WHERE len(embedding) = 64 AND list_aggregate(list_transform(embedding, lambda z: abs(z)), 'sum') > 0 GROUP BY 1) e
  JOIN (SELECT DISTINCT vector_id, chunk_id FROM vector_metadata) USING (chunk_id)),
p AS (SELECT q.vector_id AS query_id, v.vector_id AS id, round(list_cosine_similarity(q.x, v.x), 6) AS score FROM v q, v WHERE q.vector_id % 20 = 0 AND q.vector_id <> v.vector_id)
SELECT query_id, id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INTEGER) AS rank FROM p QUALIFY rank <= 10""",
}
