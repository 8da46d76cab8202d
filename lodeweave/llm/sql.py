"""SQL for those queries of the ten problems that DuckDB can express on whole tables."""

from __future__ import annotations

_SQL: dict[str, str] = {
    "p1_found": """WITH RECURSIVE v AS (SELECT chunk_id, repo_id, language, embedding::DOUBLE[] AS e FROM code_chunks WHERE embedding IS NOT NULL AND list_sum(list_transform(embedding, lambda x: abs(x))) > 0),
links AS (SELECT a.chunk_id AS a, b.chunk_id AS b FROM v a JOIN v b USING (repo_id, language) WHERE list_cosine_similarity(a.e, b.e) >= 0.85),
reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
large AS (SELECT a FROM reach GROUP BY a HAVING count(*) >= 3)
SELECT a AS chunk_id_a, b AS chunk_id_b FROM reach JOIN large USING (a) WHERE a < b""",
    "p2_found": r"""WITH w AS (SELECT chunk_id, regexp_extract_all(raw_code, '[A-Za-z0-9_]+') AS t FROM code_chunks WHERE chunk_type IN ('function', 'method') AND raw_code IS NOT NULL),
i AS (SELECT chunk_id, t, unnest(range(1, len(t) - 1)) AS i FROM w),
g AS (SELECT DISTINCT chunk_id, lower(t[i] || ' ' || t[i + 1] || ' ' || t[i + 2]) AS k FROM i),
n AS (SELECT chunk_id, count(*) AS n FROM g GROUP BY 1),
c AS (SELECT a.chunk_id AS a, b.chunk_id AS b, count(*) AS c FROM g a JOIN g b ON a.k = b.k AND a.chunk_id < b.chunk_id GROUP BY ALL)
SELECT a AS chunk_id_a, b AS chunk_id_b FROM c JOIN n x ON x.chunk_id = a JOIN n y ON y.chunk_id = b WHERE c >= 0.6 * (x.n + y.n - c)""",
    "p9_found": r"""WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS t FROM documents WHERE text IS NOT NULL), di AS (SELECT doc_id, t, unnest(range(1, len(t) - 8)) AS i FROM d),
b AS (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS t FROM benchmark WHERE text IS NOT NULL), bi AS (SELECT item_id, t, unnest(range(1, len(t) - 8)) AS i FROM b)
SELECT DISTINCT doc_id, item_id FROM di JOIN bi ON array_to_string(di.t[di.i:di.i + 9], ' ') = array_to_string(bi.t[bi.i:bi.i + 9], ' ')""",
}


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
