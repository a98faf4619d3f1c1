"""Statements of the training-data queries that SQL can express, by brute force over whole tables."""

from __future__ import annotations

_ITEMS = r"""i AS (SELECT DISTINCT 'file' AS item_kind, repo, sha, regexp_replace(replace(regexp_replace(f, '^\s+|\s+$', '', 'g'), '\', '/'), '^(\./+)+', '') AS item FROM (SELECT repo, sha, unnest(files) AS f FROM commit_nodes WHERE repo IS NOT NULL AND sha IS NOT NULL) WHERE f IS NOT NULL
UNION SELECT DISTINCT 'function', repo, sha, f FROM (SELECT repo, sha, unnest(functions) AS f FROM commit_nodes WHERE repo IS NOT NULL AND sha IS NOT NULL) WHERE f IS NOT NULL),
e AS (SELECT * FROM i WHERE trim(item) <> ''),
t AS (SELECT item_kind, repo, count(DISTINCT sha)::BIGINT AS n FROM e GROUP BY ALL), s AS (SELECT item_kind, repo, item, count(*)::BIGINT AS k FROM e GROUP BY ALL),
p AS (SELECT a.item_kind, a.repo, a.item AS item_a, b.item AS item_b, count(*)::BIGINT AS n_ab FROM e a JOIN e b ON a.item_kind = b.item_kind AND a.repo = b.repo AND a.sha = b.sha AND a.item < b.item GROUP BY ALL),
r AS (SELECT p.*, x.k AS n_a, y.k AS n_b, t.n FROM p JOIN s x ON p.item_kind = x.item_kind AND p.repo = x.repo AND p.item_a = x.item JOIN s y ON p.item_kind = y.item_kind AND p.repo = y.repo AND p.item_b = y.item JOIN t ON p.item_kind = t.item_kind AND p.repo = t.repo)"""

_NEAR = """v AS (SELECT DISTINCT vec_id, embed_model, dim, list_transform(vector, lambda x: x::DOUBLE) AS x FROM vector_records WHERE vec_id IS NOT NULL AND embed_model IS NOT NULL AND dim > 0 AND len(vector) = dim AND list_bool_and(list_transform(vector, lambda x: x IS NOT NULL AND isfinite(x))) AND list_bool_or(list_transform(vector, lambda x: x <> 0))),
c AS (SELECT a.vec_id, b.vec_id AS near_id, list_inner_product(a.x, b.x) / sqrt(list_inner_product(a.x, a.x) * list_inner_product(b.x, b.x)) AS cosine FROM v a JOIN v b ON a.embed_model = b.embed_model AND a.dim = b.dim AND a.vec_id <> b.vec_id{where}),
n AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY round(cosine, 12) DESC, near_id) AS rank FROM c)"""

_WINDOWS = """d AS (SELECT DISTINCT doc_id, text FROM documents WHERE length(text) >= 400 AND doc_id IS NOT NULL),
w AS (SELECT text, pos, md5(substr(text, pos, 400)) AS h FROM (SELECT text, unnest(range(1, length(text) - 398)) AS pos FROM (SELECT DISTINCT text FROM d))),
k AS (SELECT h FROM w GROUP BY h HAVING count(DISTINCT text) > 1), m AS (SELECT w.* FROM w JOIN k USING (h))"""

ORACLES = {
    "p4_found": "SELECT DISTINCT chunk_id FROM chunks WHERE strlen(text) > 4096",
    "p5_found": f"WITH {_ITEMS} SELECT item_kind, repo, item_a, item_b FROM r WHERE n_ab >= 4 AND n_ab * n >= 3 * n_a * n_b",
    "p5_pairs": f"WITH {_ITEMS} SELECT item_kind, repo, item_a, item_b, n_ab, n_a, n_b, n, round(n_ab * n / (n_a * n_b), 9) AS lift, round(log2(n_ab * n / (n_a * n_b)), 9) AS pmi, round(n_ab / (n_a + n_b - n_ab), 9) AS jaccard FROM r",
    "p6_found": f"WITH {_NEAR.format(where='')} SELECT DISTINCT least(vec_id, near_id) AS vec_id_a, greatest(vec_id, near_id) AS vec_id_b FROM n WHERE rank <= 5 AND cosine >= 0.9",
    "p6_search": f"WITH {_NEAR.format(where=' AND a.vec_id % 20 = 0')} SELECT vec_id, rank::INTEGER AS rank, near_id, round(cosine, 6) AS cosine FROM n WHERE rank <= 5",
    "p9_found": f"""WITH {_WINDOWS}, l AS (SELECT DISTINCT h, doc_id FROM m JOIN d USING (text)) SELECT DISTINCT a.doc_id AS doc_id_a, b.doc_id AS doc_id_b FROM l a JOIN l b ON a.h = b.h AND a.doc_id < b.doc_id
UNION SELECT a.doc_id, b.doc_id FROM d a JOIN d b ON a.text = b.text AND a.doc_id < b.doc_id""",
    "p9_shared": f"""WITH {_WINDOWS}, g AS (SELECT text, least(400, coalesce(lead(pos) OVER (PARTITION BY text ORDER BY pos) - pos, 400)) AS n FROM m), s AS (SELECT text, sum(n)::BIGINT AS covered FROM g GROUP BY text),
x AS (SELECT DISTINCT doc_id, text, length(coalesce(text, ''))::BIGINT AS n_chars FROM documents), c AS (SELECT text, count(*)::BIGINT AS copies FROM x GROUP BY text)
SELECT doc_id, n_chars, CASE WHEN n_chars > 0 THEN copies ELSE 1 END AS copies, CASE WHEN copies > 1 AND n_chars >= 400 THEN n_chars ELSE coalesce(covered, 0) END AS shared_chars,
round(CASE WHEN n_chars > 0 THEN (CASE WHEN copies > 1 AND n_chars >= 400 THEN n_chars ELSE coalesce(covered, 0) END) / n_chars ELSE 0.0 END, 9) AS shared_share FROM x LEFT JOIN c ON x.text IS NOT DISTINCT FROM c.text LEFT JOIN s ON x.text = s.text""",
}
