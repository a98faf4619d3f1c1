"""Queries of ranked search."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestrata.operators import search, sequence, sets
from lodestrata.plans.registry import Registry
from lodestrata.runtime import table

R = Registry()
QUERY = ("ledger", "shard", "index", "ledger")


def _bm25(table_: str, key: str, k: int) -> str:
    weights = {"ledger": 2, "shard": 1, "index": 1}
    terms = " + ".join(
        f"{w} * ln((n - df_{t} + 0.5) / (df_{t} + 0.5) + 1) * {t} * 2.5 / ({t} + 1.5 * (0.25 + 0.75 * dl / avgdl))" for t, w in weights.items()
    )
    count = ", ".join(f"len(list_filter(w, lambda x: x = '{t}'))::DOUBLE AS {t}" for t in weights)
    df = ", ".join(f"sum(CASE WHEN {t} > 0 THEN 1 ELSE 0 END) AS df_{t}" for t in weights)
    some = " OR ".join(f"{t} > 0" for t in weights)
    return rf"""WITH t AS (SELECT {key}, regexp_extract_all(lower(text), '[a-z0-9_][a-z0-9_\-]+') AS w FROM {table_} WHERE text IS NOT NULL),
c AS (SELECT {key}, len(w) AS dl, {count} FROM t WHERE len(w) > 0), s AS (SELECT count(*) AS n, avg(dl) AS avgdl, {df} FROM c)
SELECT {key}, round({terms}, 6) AS score FROM c, s WHERE {some} ORDER BY score DESC, {key} LIMIT {k}"""


@R.query("tk01_bm25", _bm25("documents", "doc_id", 20))
def _(s, d):
    return search.bm25(table(s, d, "documents"), "doc_id", "text", QUERY, 20)


@R.query("tk02_bm25_postings", r"SELECT doc_id, term, count(*)::BIGINT AS tf FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9_][a-z0-9_\-]+')) AS term FROM documents WHERE text IS NOT NULL) GROUP BY ALL")
def _(s, d):
    return search.read_postings(table(s, d, "documents"), "doc_id", "text").select("doc_id", "term", "tf")


def first_vector(vectors, key: str, vector: str) -> list[float]:
    """The vector of the least key as a query; a zero where there is none."""
    r = vectors.orderBy(key).select(vector).first()
    return [float(x) for x in r[0]] if r and r[0] else [0.0]


def _first(s, d) -> list[float]:
    return first_vector(table(s, d, "embeddings"), "vec_id", "embedding")


@R.query("tk03_knn", "SELECT vec_id, score FROM (SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings ORDER BY vec_id LIMIT 1)), 6) AS score FROM embeddings ORDER BY score DESC, vec_id LIMIT 10) WHERE score >= 0.1")
def _(s, d):
    return search.knn(table(s, d, "embeddings"), "vec_id", "embedding", _first(s, d), 10, 0.1)


_V = "(SELECT vec_id, any_value(text) AS text, any_value(vector)::DOUBLE[] AS v FROM vector_records WHERE embed_model = 'hashbow-64' AND len(vector) = 64 AND list_min(vector) IS NOT NULL AND len(list_filter(vector, lambda x: NOT isfinite(x))) = 0 AND len(list_filter(vector, lambda x: x <> 0)) > 0 GROUP BY vec_id)"


@R.query("tk06_hybrid", f"WITH v AS {_V}, q AS (SELECT v AS q FROM v ORDER BY vec_id LIMIT 1), c AS (SELECT vec_id, text, list_cosine_similarity(v, q) AS dense FROM v, q ORDER BY round(dense, 9) DESC, vec_id LIMIT 32) SELECT vec_id, round(0.7 * dense + (1 - 0.7) * (len(list_intersect(['def','ledger','return'], list_distinct(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9_]+')))) / 3.0), 4) AS score FROM c ORDER BY score DESC, vec_id LIMIT 8")
def _(s, d):
    v = table(s, d, "vector_records").where("embed_model = 'hashbow-64' and size(vector) = 64").where(
        F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vector", lambda x: x != 0)
    )
    v = v.groupBy("vec_id").agg(F.first("text").alias("text"), F.first("vector").alias("vector"))
    q = first_vector(v, "vec_id", "vector")
    return search.hybrid(v, "vec_id", "text", "vector", ("return", "def", "ledger"), q)


@R.query("tk07_phrase_prefix")
def _(s, d):
    return search.phrase_prefix(table(s, d, "documents"), "doc_id", "text", ("cold", "start"), 10)


@R.query("tk08_all_words", r"SELECT doc_id FROM documents WHERE text IS NOT NULL AND len(list_filter(['ledger','shard','index'], lambda x: list_contains(regexp_extract_all(lower(text), '[a-z0-9_][a-z0-9_\-]+'), x))) = 3")
def _(s, d):
    return search.all_words(table(s, d, "documents"), "doc_id", "text", ("ledger", "shard", "index"))


@R.query("tk10_substring_rank", "WITH c AS (SELECT doc_id, (((length(lower(text)) - length(replace(lower(text), 'token', ''))) // 5) + ((length(lower(text)) - length(replace(lower(text), 'queue', ''))) // 5))::BIGINT AS hits FROM documents WHERE text IS NOT NULL) SELECT doc_id, hits, CASE WHEN hits >= 5 THEN 'high' WHEN hits >= 3 THEN 'medium' ELSE 'low' END AS confidence FROM c WHERE hits > 0 ORDER BY hits DESC, doc_id LIMIT 50")
def _(s, d):
    return search.substring_rank(table(s, d, "documents"), "doc_id", "text", ("token", "queue"), 50)


@R.query("tk14_quotes", r"WITH p AS (SELECT doc_id, unnest(regexp_split_to_array(text, '\n\s*\n')) AS p, generate_subscripts(regexp_split_to_array(text, '\n\s*\n'), 1) - 1 AS part FROM documents WHERE text IS NOT NULL), s AS (SELECT doc_id, part::BIGINT AS part, round((CASE WHEN contains(lower(p), 'ledger') THEN 1 ELSE 0 END + CASE WHEN contains(lower(p), 'shard') THEN 1 ELSE 0 END + CASE WHEN contains(lower(p), 'token') THEN 1 ELSE 0 END) / 3.0, 6)::DOUBLE AS score, substr(p, 1, 500) AS quote FROM p WHERE trim(p) <> '') SELECT * FROM s WHERE score > 0 ORDER BY score DESC, doc_id, part LIMIT 20")
def _(s, d):
    return search.quotes(table(s, d, "documents"), "doc_id", "text", ("ledger", "shard", "token"), 20)


@R.query("tk16_fused", f"WITH a AS ({_bm25('documents', 'doc_id', 40)}), c AS (SELECT doc_id, ((length(lower(text)) - length(replace(lower(text), 'token', ''))) // 5)::BIGINT AS hits FROM documents WHERE text IS NOT NULL), b AS (SELECT doc_id, hits FROM c WHERE hits > 0 ORDER BY hits DESC, doc_id LIMIT 40), f AS (SELECT doc_id, (length(text) - length(replace(text, '# ', ''))) // 2 AS heads FROM documents WHERE fmt = 'markdown' AND text IS NOT NULL), g AS (SELECT doc_id, heads FROM f WHERE heads > 0 ORDER BY heads DESC, doc_id LIMIT 40), u AS (SELECT doc_id, score FROM a UNION ALL SELECT doc_id, 0.8 * hits FROM b UNION ALL SELECT doc_id, 0.7 * heads FROM g) SELECT doc_id, round(max(score), 6)::DOUBLE AS score FROM u GROUP BY doc_id ORDER BY score DESC, doc_id LIMIT 25")
def _(s, d):
    t = table(s, d, "documents")
    b = search.substring_rank(t, "doc_id", "text", ("token",), 40).select("doc_id", F.col("hits").cast("double").alias("score"))
    g = search.substring_rank(t.where("fmt = 'markdown'"), "doc_id", "text", ("# ",), 40).select("doc_id", F.col("hits").cast("double").alias("score"))
    return search.fused([(search.bm25(t, "doc_id", "text", QUERY, 40), 1.0), (b, 0.8), (g, 0.7)], "doc_id", 25)


@R.query("jn17_claims", r"""WITH c AS (SELECT DISTINCT item_id, list_distinct(regexp_extract_all(lower(text), '[a-z][a-z0-9_]{3,}')) AS w FROM eval_items), n AS (SELECT item_id, len(w) AS n, unnest(w) AS term FROM c),
h AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z][a-z0-9_]{3,}'))) AS term FROM documents WHERE text IS NOT NULL),
s AS (SELECT item_id, doc_id, count(*)::DOUBLE / min(n) AS s FROM n JOIN h USING (term) GROUP BY ALL), b AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY s DESC, doc_id) AS i FROM s)
SELECT c.item_id, doc_id AS best_doc, round(coalesce(s, 0.0), 6) AS support, CASE WHEN round(coalesce(s, 0.0), 6) >= 0.7 THEN 'supported' WHEN round(coalesce(s, 0.0), 6) >= 0.4 THEN 'partial' WHEN round(coalesce(s, 0.0), 6) >= 0.1 THEN 'weak' ELSE 'unsupported' END AS verdict FROM c LEFT JOIN b ON c.item_id = b.item_id AND i = 1""")
def _(s, d):
    return sets.claim_support(table(s, d, "eval_items"), "item_id", "text", table(s, d, "documents"), "doc_id", "text")


@R.query("wn11_budget_pack", "WITH o AS (SELECT chunk_id, repo, path, start_byte, strlen(text) AS n, row_number() OVER (PARTITION BY repo, path, start_byte ORDER BY chunk_id, indexed_at) AS i FROM chunks), u AS (SELECT repo, chunk_id, n::BIGINT AS n, sum(n) OVER (PARTITION BY repo ORDER BY path, start_byte, chunk_id ROWS UNBOUNDED PRECEDING) AS used FROM o WHERE i = 1) SELECT repo, chunk_id, used::BIGINT AS used FROM u WHERE used <= 24576")
def _(s, d):
    c = table(s, d, "chunks").select("chunk_id", "repo", "path", "start_byte", F.octet_length("text").cast("bigint").alias("n"))
    return sequence.pack(c, ["repo"], [F.col("path"), F.col("start_byte"), F.col("chunk_id")], ["path", "start_byte"], "n", 24576).select("repo", "chunk_id", "used")


@R.query("st07_duplicates", "SELECT sha256(text) AS sha, count(*)::BIGINT AS n, min(doc_id) AS first_doc FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1")
def _(s, d):
    return table(s, d, "documents").where("text is not null").groupBy(F.sha2("text", 256).alias("sha")).agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_doc")).where("n > 1")


@R.query("ax01_audit_sample", "SELECT doc_id, source, length(text) = n_chars AS size_ok FROM documents ORDER BY md5('7:' || doc_id), doc_id LIMIT (SELECT greatest(1, round(count(*) * 0.1))::BIGINT FROM documents)")
def _(s, d):
    """A tenth of the documents, max(1, round(n / 10)) of them, without replacement: the sampling operator."""
    t = table(s, d, "documents").select("doc_id", "source", (F.length("text") == F.col("n_chars")).alias("size_ok"))
    return sequence.sample(t, "doc_id", 0.1, 7)
