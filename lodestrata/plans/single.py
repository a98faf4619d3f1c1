"""Small operators, each as a query of its own."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lodestrata.functions import normal as N
from lodestrata.functions import rules as U
from lodestrata.functions import text as T
from lodestrata.operators import joins, parse, search, sequence, sets
from lodestrata.plans.code import source
from lodestrata.plans.registry import Registry
from lodestrata.plans.retrieval import first_vector
from lodestrata.plans.scalars import _case, _redacted
from lodestrata.plans.texts import _canonical, _first_bytes
from lodestrata.runtime import table

R = Registry()
_SRC = "(SELECT DISTINCT repo, path, text FROM source_files)"


def docs(s, d):
    return table(s, d, "documents").where(F.col("text").isNotNull())


@R.query("prj02_sensitive_paths", f"SELECT DISTINCT p AS path, regexp_matches(lower(p), '{U.SENSITIVE_PATH}') AS sensitive FROM (SELECT path AS p FROM source_files UNION ALL SELECT unnest(files) FROM commit_nodes) WHERE p IS NOT NULL")
def _(s, d):
    p = table(s, d, "source_files").select("path").unionByName(table(s, d, "commit_nodes").select(F.explode("files").alias("path"))).where("path is not null").distinct()
    return p.select("path", U.sensitive_path(F.col("path")).alias("sensitive"))


@R.query("prj03_sensitive_contents", "SELECT DISTINCT chunk_id, contains(substr(text, 1, 64), 'PRIVATE KEY') AS sensitive FROM chunks WHERE text IS NOT NULL")
def _(s, d):
    return table(s, d, "chunks").where("text is not null").select("chunk_id", F.contains(F.substring("text", 1, 64), F.lit("PRIVATE KEY")).alias("sensitive")).distinct()


@R.query("prj04_forbidden", "SELECT DISTINCT f AS path, contains(lower(f), '.git/') OR contains(lower(f), 'node_modules/') OR contains(lower(f), '../') AS forbidden FROM (SELECT unnest(files) AS f FROM commit_nodes UNION ALL SELECT '../' || path FROM source_files) WHERE f IS NOT NULL")
def _(s, d):
    """Files of commits, and those of the table as seen from a folder beside it."""
    f = table(s, d, "commit_nodes").select(F.explode("files").alias("path")).unionByName(table(s, d, "source_files").select(F.concat(F.lit("../"), "path").alias("path")))
    return f.where("path is not null").distinct().select("path", U.forbidden_path(F.col("path")).alias("forbidden"))


@R.query("prj06_excluded", f"SELECT DISTINCT repo, path, list_has_any(string_split(path, '/'), {list(U.EXCLUDED)}) AS excluded FROM source_files")
def _(s, d):
    return table(s, d, "source_files").select("repo", "path", U.excluded(F.col("path")).alias("excluded")).distinct()


@R.query("prj10_json_keys", r"SELECT repo, path, array_to_string(list_sort(list_distinct(json_keys(text))), '|') AS keys FROM (SELECT DISTINCT repo, path, text FROM source_files WHERE path LIKE '%.json') WHERE json_valid(text) AND starts_with(ltrim(text, ' ' || chr(9) || chr(10) || chr(13)), '{')")
def _(s, d):
    """Top-level keys of JSON files that are valid objects."""
    f = source(s, d).where(F.col("path").endswith(".json")).select("repo", "path", F.json_object_keys("text").alias("k"), F.get_json_object("text", "$").alias("whole"))
    return f.where("k is not null and whole is not null").select("repo", "path", F.array_join(F.array_sort(F.array_distinct("k")), "|").alias("keys"))


@R.query("prj11_config_types", f"SELECT repo, path, {_case('text', parse.CONFIG_TYPES, 'generic')} AS type FROM {_SRC} WHERE regexp_matches(path, '\\.(json|toml|xml)$')")
def _(s, d):
    f = source(s, d).where(F.col("path").rlike(r"\.(json|toml|xml)$"))
    return f.select("repo", "path", T.ladder(F.col("text"), parse.CONFIG_TYPES, "generic").alias("type"))


@R.query("prj16_modules", r"SELECT DISTINCT p AS path, regexp_replace(replace(regexp_replace(p, '\.py$', ''), '/', '.'), '\.__init__$', '') AS module FROM (SELECT path AS p FROM symbols UNION ALL SELECT regexp_replace(path, '[^/]+$', '__init__.py') FROM symbols)")
def _(s, d):
    p = table(s, d, "symbols").select("path")
    p = p.unionByName(p.select(F.regexp_replace("path", r"[^/]+$", "__init__.py").alias("path"))).distinct()
    return p.select("path", T.module_name(F.col("path")).alias("module"))


@R.query("jn14_symmetric", "WITH a AS (SELECT DISTINCT content_hash AS h FROM vector_records WHERE content_hash IS NOT NULL), b AS (SELECT DISTINCT content_hash AS h FROM chunks WHERE content_hash IS NOT NULL) SELECT coalesce(a.h, b.h) AS h, CASE WHEN a.h IS NULL THEN 'added' ELSE 'deleted' END AS change FROM a FULL JOIN b ON a.h = b.h WHERE a.h IS NULL OR b.h IS NULL")
def _(s, d):
    """What stands in one of two snapshots only."""
    have = lambda n: table(s, d, n).where("content_hash is not null").select(F.col("content_hash").alias("h"), F.lit(1).alias("v")).distinct()
    return joins.snapshot_diff(have("vector_records"), have("chunks"), "h", "v").where("change in ('added', 'deleted')")


@R.query("ag06_main_types", "WITH c AS (SELECT repo, sha, min(node_type) AS t, min(committed_at) AS at_ FROM commit_nodes GROUP BY repo, sha), n AS (SELECT repo, t, count(*)::BIGINT AS n, min((at_, sha)) AS first_ FROM c GROUP BY repo, t) SELECT repo, t AS main_type, n FROM (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY n DESC, first_) AS i FROM n) WHERE i = 1")
def _(s, d):
    """The most frequent kind of commit of a repository, of equals the one met first."""
    c = table(s, d, "commit_nodes").groupBy("repo", "sha").agg(F.min("node_type").alias("t"), F.min("committed_at").alias("at"))
    return sequence.dominant(c, ["repo"], "t", ["at", "sha"]).select("repo", F.col("t").alias("main_type"), "n")


@R.query("wn13_ordinals", r"SELECT chunk_id, (row_number() OVER (PARTITION BY repo, path ORDER BY start_byte, chunk_id) - 1)::BIGINT AS ordinal FROM (SELECT DISTINCT chunk_id, repo, path, start_byte, text FROM chunks) WHERE regexp_matches(text, '\S')")
def _(s, d):
    """Chunks numbered in their file, those of blanks alone left out."""
    c = table(s, d, "chunks").select("chunk_id", "repo", "path", "start_byte", "text").distinct().where(F.col("text").rlike(r"\S"))
    w = Window.partitionBy("repo", "path").orderBy("start_byte", "chunk_id")
    return c.select("chunk_id", (F.row_number().over(w) - 1).cast("bigint").alias("ordinal"))


@R.query("tk04_scan", "SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings ORDER BY vec_id LIMIT 1)), 6) AS score FROM embeddings")
def _(s, d):
    """The plain scan of a store: the cosine of every vector."""
    from lodestrata.functions.vector import cosine

    v = table(s, d, "embeddings")
    q = first_vector(v, "vec_id", "embedding")
    return v.select("vec_id", F.round(cosine(F.col("embedding"), F.array(*map(F.lit, q))), 6).alias("score"))


@R.query("st08_first_nodes", "SELECT sha, arg_min(repo || '@' || branch, (mined_at, repo, branch)) AS first_seen FROM commit_nodes WHERE sha IS NOT NULL GROUP BY sha")
def _(s, d):
    c = table(s, d, "commit_nodes").where("sha is not null")
    return sequence.first_wins(c, ["sha"], [F.col("mined_at"), F.col("repo"), F.col("branch")]).select("sha", F.concat_ws("@", "repo", "branch").alias("first_seen"))


@R.query("sc02_token_sets", r"SELECT item_id, array_to_string(list_sort(list_distinct(regexp_extract_all(lower(text), '[a-z0-9_][a-z0-9_\-]+'))), ' ') AS tokens FROM (SELECT DISTINCT item_id, text FROM eval_items)")
def _(s, d):
    i = table(s, d, "eval_items").select("item_id", "text").distinct()
    return i.select("item_id", F.array_join(F.array_sort(F.array_distinct(T.tokens(F.col("text")))), " ").alias("tokens"))


_SLUG = r"substr(regexp_replace(regexp_replace(lower({0}), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 60)"


@R.query("sc08_slugs", f"SELECT doc_id, {_SLUG.format('text')} AS slug FROM documents WHERE text IS NOT NULL")
def _(s, d):
    return docs(s, d).select("doc_id", T.slug(F.col("text")).alias("slug"))


@R.query("sc09_slugs_unknown", f"SELECT doc_id, coalesce(nullif({_SLUG.format('source')}, ''), 'unknown') AS slug FROM documents")
def _(s, d):
    return table(s, d, "documents").select("doc_id", T.slug(F.coalesce("source", F.lit("")), empty="unknown").alias("slug"))


@R.query("sc15_short_claims", f"SELECT item_id, 'clm_' || substr(sha256(lower({_canonical('text')})), 1, 8) AS claim FROM (SELECT DISTINCT item_id, text FROM eval_items)")
def _(s, d):
    return table(s, d, "eval_items").select("item_id", "text").distinct().select("item_id", F.concat(F.lit("clm_"), F.substring(N.claim_hash(F.col("text")), 1, 8)).alias("claim"))


@R.query("sc30_splices", f"SELECT DISTINCT chunk_id, {_first_bytes('text', 333)} AS text FROM chunks WHERE text IS NOT NULL")
def _(s, d):
    """At most 333 bytes, no character broken."""
    return table(s, d, "chunks").where("text is not null").select("chunk_id", T.splice(F.col("text"), 333).alias("text")).distinct()


@R.query("sc31_redacted_guard", "SELECT DISTINCT chunk_id, " + _first_bytes("r", 16384) + " AS text FROM (SELECT chunk_id, array_to_string(list_slice(string_split(" + _redacted("text") + ", chr(10)), 1, 200), chr(10)) AS r FROM chunks WHERE text IS NOT NULL)")
def _(s, d):
    """Masked first, then at most 200 lines and 16 KiB."""
    c = T.splice(F.array_join(F.slice(F.split(T.redact(F.col("text")), "\n"), 1, 200), "\n"), 16384)
    return table(s, d, "chunks").where("text is not null").select("chunk_id", c.alias("text")).distinct()


@R.query("sc38_intents", f"SELECT doc_id, {_case('text', T.INTENTS, 'other')} AS intent FROM documents WHERE text IS NOT NULL")
def _(s, d):
    return docs(s, d).select("doc_id", T.ladder(F.col("text"), T.INTENTS, "other").alias("intent"))


@R.query("sc39_item_intents", f"SELECT DISTINCT item_id, {_case('text', T.INTENTS, 'other')} AS intent FROM eval_items")
def _(s, d):
    return table(s, d, "eval_items").select("item_id", T.ladder(F.col("text"), T.INTENTS, "other").alias("intent")).distinct()


@R.query("sc54_bands", "SELECT event_id, CASE WHEN v >= 0.7 THEN 'supported' WHEN v >= 0.4 THEN 'partial' WHEN v >= 0.1 THEN 'weak' ELSE 'unsupported' END AS band FROM (SELECT event_id, round((event_id % 101) / 100.0, 2) AS v FROM events)")
def _(s, d):
    return table(s, d, "events").select("event_id", sets.band(F.round(F.col("event_id") % 101 / 100, 2)).alias("band"))


@R.query("sc61_file_scores")
def _(s, d):
    """The seven scores of every Python file that parses."""
    return parse.python_scores(source(s, d).where(F.col("path").endswith(".py")))


@R.query("ag08_mined_usage", f"""WITH q AS (SELECT doc_id, {_case('text', T.INTENTS, 'other')} AS intent, fmt, repo FROM documents WHERE text IS NOT NULL), n AS (SELECT intent, count(*)::BIGINT AS n FROM q GROUP BY intent),
f AS (SELECT intent, fmt, count(*) AS k, min(doc_id) AS o FROM q WHERE fmt IS NOT NULL GROUP BY ALL), u AS (SELECT intent, repo, count(*) AS k, min(doc_id) AS o FROM q WHERE repo IS NOT NULL GROUP BY ALL),
ft AS (SELECT intent, string_agg(fmt, '|' ORDER BY k DESC, o) AS labels FROM (SELECT *, row_number() OVER (PARTITION BY intent ORDER BY k DESC, o) AS i FROM f) WHERE i <= 6 GROUP BY intent), ut AS (SELECT intent, string_agg(repo, '|' ORDER BY k DESC, o) AS units FROM (SELECT *, row_number() OVER (PARTITION BY intent ORDER BY k DESC, o) AS i FROM u) WHERE i <= 3 GROUP BY intent)
SELECT n.intent, n, coalesce(labels, '') AS labels, coalesce(units, '') AS units FROM n LEFT JOIN ft ON n.intent = ft.intent LEFT JOIN ut ON n.intent = ut.intent""")
def _(s, d):
    """Prompts by intent: how many, the six most frequent labels (formats) and three units (repositories); ties go to the one met first."""
    q = docs(s, d).select("doc_id", T.ladder(F.col("text"), T.INTENTS, "other").alias("intent"), "fmt", "repo")

    def top(c: str, k: int, name: str):
        n = q.where(F.col(c).isNotNull()).groupBy("intent", c).agg(F.count(F.lit(1)).alias("k"), F.min("doc_id").alias("o"))
        best = search.per_group(n, ["intent"], [F.desc("k"), F.col("o")], k)
        return best.groupBy("intent").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", c))), lambda x: x[c]), "|").alias(name))

    none = F.lit("")
    out = q.groupBy("intent").agg(F.count(F.lit(1)).alias("n")).join(top("fmt", 6, "labels"), "intent", "left").join(top("repo", 3, "units"), "intent", "left")
    return out.select("intent", "n", F.coalesce("labels", none).alias("labels"), F.coalesce("units", none).alias("units"))


@R.query("sc55_token_estimates", "SELECT DISTINCT chunk_id, ((length(text) + 3) // 4)::BIGINT AS tokens FROM chunks WHERE text IS NOT NULL")
def _(s, d):
    return table(s, d, "chunks").where("text is not null").select("chunk_id", T.estimate_tokens(F.col("text")).alias("tokens")).distinct()


@R.query("sc17_file_digests")
def _(s, d):
    """XXH64 of files, which SQL has no function for."""
    return source(s, d).select("repo", "path", N.file_digest(F.col("text")).alias("digest"))


@R.query("sc18_query_keys")
def _(s, d):
    """BLAKE2 of test items with single blanks, in lower case."""
    return table(s, d, "eval_items").select("item_id", "text").distinct().select("item_id", N.query_key(F.col("text")).alias("key"))


@R.query("src13_tails", "SELECT repo, branch, count(*)::BIGINT AS lines, max(n)::BIGINT AS longest FROM (SELECT repo, branch, length(x) AS n FROM (SELECT repo, branch, unnest(list_slice(string_split(text, chr(10)), 2, 100000)) AS x FROM (SELECT repo, branch, right(string_agg(line, '' ORDER BY sha), 100) AS text FROM (SELECT DISTINCT repo, branch, sha, sha || ' ' || branch || chr(10) AS line FROM commit_nodes) GROUP BY repo, branch HAVING length(string_agg(line, '')) > 100)) WHERE trim(x) <> '') GROUP BY repo, branch")
def _(s, d):
    """The last 100 bytes of each branch's log, by lines; branches whose logs are shorter are left out."""
    from lodestrata.runtime import shared_path
    from lodestrata.sources import files as S

    line = F.concat("sha", F.lit(" "), "branch", F.lit("\n"))
    logs = table(s, d, "commit_nodes").select("repo", "branch", "sha", line.alias("line")).distinct().groupBy("repo", "branch").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("sha", "line"))), lambda x: x["line"]), "").alias("text"))
    at = shared_path(s, "logs")
    S.write_tree(logs.where(F.length("text") > 100).select("repo", F.concat("branch", F.lit("/log.txt")).alias("path"), "text"), at)
    files = S.listed(s, at).select("repo", F.regexp_replace("path", "/log.txt$", "").alias("branch"), "path")
    x = S.tails(files, at, 100).select("repo", "branch", F.explode("lines").alias("x"))
    return x.groupBy("repo", "branch").agg(F.count(F.lit(1)).alias("lines"), F.max(F.length("x")).cast("bigint").alias("longest"))


@R.query("src28_followed", "SELECT event_type AS kind, count(*)::BIGINT AS n FROM events GROUP BY 1")
def _(s, d):
    """A ledger followed by a stream while it grows: what was there first and what came later, each line once."""
    from lodestrata.runtime import shared_path
    from lodestrata.sources.files import telemetry
    from lodestrata.streaming.events import drain

    at, state = shared_path(s, "ledger"), shared_path(s, "stream")
    e = table(s, d, "events")
    for half in (0, 1):
        part = e.where(F.pmod("event_id", F.lit(2)) == half)
        part.select(telemetry(F.col("event_type"), F.col("event_id").cast("string"), F.lit("ledger"), F.lit("x")).alias("value")).write.mode("append").text(at)
        out = drain(s.readStream.schema("kind string, source string").json(at), state)
    return out.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@R.query("src32_snapshots", "WITH c AS (SELECT repo, path, start_byte, strlen(text) AS size FROM (SELECT DISTINCT repo, path, start_byte, text FROM chunks WHERE text IS NOT NULL)), m AS (SELECT *, size - lag(size) OVER (PARTITION BY repo ORDER BY path, start_byte) AS diff FROM c), k AS (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY path DESC, start_byte DESC) AS i FROM m WHERE diff IS NULL OR abs(diff) >= 1024) SELECT repo, path, start_byte FROM k WHERE i <= 5")
def _(s, d):
    """Snapshots (chunks in order) whose size differs from the one before by 1,024 bytes or more, the newest five."""
    c = table(s, d, "chunks").where("text is not null").select("repo", "path", "start_byte", "text").distinct().select("repo", "path", "start_byte", F.octet_length("text").alias("size"))
    return sequence.snapshots(c.withColumn("o", F.struct("path", "start_byte")), ["repo"], F.col("o"), "size", 1024, 5).select("repo", "path", "start_byte")


_LINE = r"SELECT doc_id, x, i, array_to_string(list_sort(list_distinct(regexp_extract_all(lower(x), '[a-z][a-z0-9_]{3,}'))), ' ') AS k FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, unnest(range(0, len(string_split(text, chr(10))))) AS i FROM documents WHERE text IS NOT NULL) WHERE trim(x) <> ''"


@R.query("st05_longest", f"SELECT doc_id, md5(arg_max(x, (length(x), -i))) AS kept, count(*)::BIGINT AS members FROM ({_LINE}) GROUP BY doc_id, k")
def _(s, d):
    """Of the lines of a text with the same key words the longest, of equals the first."""
    lines = docs(s, d).select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "x")).where(F.trim("x") != "")
    g = lines.groupBy("doc_id", F.array_join(T.key_tokens(F.col("x")), " ").alias("k")).agg(F.max_by("x", F.struct(F.length("x"), -F.col("i"))).alias("x"), F.count(F.lit(1)).alias("members"))
    return g.select("doc_id", F.md5("x").alias("kept"), "members")


@R.query("sm07_synced", "WITH c AS (SELECT DISTINCT chunk_id, chunk_index, text FROM chunks) SELECT chunk_id, length(text)::BIGINT AS size FROM c WHERE chunk_index % 4 <> 3")
def _(s, d):
    """One sync of an embedded index: changed chunks embedded anew, deleted ones out."""
    from lodestrata.functions.embed import embedder
    from lodestrata.sources.files import sync

    c = table(s, d, "chunks").select("chunk_id", "chunk_index", "text").distinct()
    made = lambda df: df.select("chunk_id", F.length("text").cast("bigint").alias("size"), embedder(16)(F.col("text")).alias("vector"))
    old = made(c.where("chunk_index % 2 = 0")).withColumn("size", F.lit(-1).cast("bigint")).unionByName(made(c.where("chunk_index % 4 = 3")))
    return sync(old, made(c.where("chunk_index % 4 <> 3")), c.where("chunk_index % 4 = 3").select("chunk_id"), ["chunk_id"]).select("chunk_id", "size")
