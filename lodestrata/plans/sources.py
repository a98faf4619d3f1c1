"""Queries that read and write files: trees of repositories, front matter, logs, indexes, keyed tables.

The test tables hold texts; they are written as files into the shared folder first, once a session, and read back by the
sources.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestrata.plans.code import source
from lodestrata.plans.registry import Registry
from lodestrata.runtime import shared_path, table
from lodestrata.sources import files as S
from lodestrata.streaming import events as E

R = Registry()
KEYWORDS = ("dataclass", "json.dumps", "logging", "sorted(")
_trees: dict[tuple[str, str], str] = {}


def tree(s, d) -> str:
    """The files of the table as a tree, with a marker file for each language of a repository."""
    mark = (s.sparkContext.applicationId, d)
    if mark not in _trees:
        f = source(s, d).select("repo", "path", "text")
        py, js = (f.where(F.col("path").endswith(e)).select("repo", F.lit(m).alias("path"), F.lit("{}\n").alias("text")).distinct() for e, m in ((".py", "pyproject.toml"), (".js", "package.json")))
        at = shared_path(s, "tree")
        S.write_tree(f.unionByName(py).unionByName(js), at)
        _trees[mark] = at
    return _trees[mark]


_TREE = """f AS (SELECT DISTINCT repo, path, text FROM source_files UNION ALL SELECT DISTINCT repo, 'pyproject.toml', '{}' || chr(10) FROM source_files WHERE path LIKE '%.py' UNION ALL SELECT DISTINCT repo, 'package.json', '{}' || chr(10) FROM source_files WHERE path LIKE '%.js'),
m AS (SELECT *, lower(regexp_extract(path, '\\.([^./]+)$', 1)) AS extension, CASE WHEN list_has_any(string_split(path, '/'), ['.git', 'node_modules', '__pycache__', '.venv', 'dist', 'build']) THEN 'excluded' WHEN regexp_matches(path, '__SENSITIVE__') THEN 'sensitive_path' WHEN regexp_matches(path, '__BINARY__') THEN 'binary'
WHEN lower(regexp_extract(path, '\\.([^./]+)$', 1)) NOT IN ('py', 'js', 'json', 'toml', 'xml', 'sh', 'md', 'sql') THEN 'extension' WHEN strlen(text) = 0 THEN 'empty' WHEN strlen(text) > 1048576 THEN 'too_large' WHEN contains(substr(text, 1, 64), 'PRIVATE KEY') THEN 'sensitive_content' WHEN contains(substr(text, 1, 512), chr(0)) THEN 'binary' END AS reason FROM f)""".replace("__SENSITIVE__", S.SENSITIVE).replace("__BINARY__", S.BINARY)


@R.query("src05_scan", f"WITH {_TREE} SELECT repo, path, extension, strlen(text)::BIGINT AS size, substr(sha256(text), 1, 16) AS content_hash FROM m WHERE reason IS NULL")
def _(s, d):
    return S.scan(s, tree(s, d))[0].select("repo", "path", "extension", "size", "content_hash")


@R.query("src05_skipped", f"WITH {_TREE} SELECT repo, path, reason FROM m WHERE reason IS NOT NULL")
def _(s, d):
    return S.scan(s, tree(s, d))[1]


_LANGS = "array_to_string(list_sort(list_distinct(list_filter(list(CASE regexp_extract(path, '([^/]+)$', 1) WHEN 'pyproject.toml' THEN 'python' WHEN 'setup.py' THEN 'python' WHEN 'package.json' THEN 'javascript' WHEN 'Cargo.toml' THEN 'rust' WHEN 'go.mod' THEN 'go' WHEN 'pom.xml' THEN 'java' END), lambda x: x IS NOT NULL))), '|')"


@R.query("src01_repositories", f"WITH {_TREE} SELECT repo, {_LANGS} AS languages FROM f WHERE repo NOT LIKE 'g%' GROUP BY repo HAVING {_LANGS} <> ''")
def _(s, d):
    """Repositories that show a marker, but those an exclusion names."""
    at = tree(s, d)
    found = S.discover(S.listed(s, at, S.repositories(at, ["*"], ["g*"])))
    return found.select("repo", F.array_join("languages", "|").alias("languages"))


@R.query("src02_candidates", f"WITH {_TREE} SELECT repo, CASE WHEN repo LIKE 'g%' THEN 'excluded' WHEN {_LANGS} = '' THEN 'no_marker' ELSE 'taken' END AS gate FROM f GROUP BY repo")
def _(s, d):
    """What the gate says of every directory under the root."""
    at = tree(s, d)
    taken = S.discover(S.listed(s, at)).select("repo", F.lit(True).alias("t"))
    every = s.createDataFrame([(n,) for n in S.repositories(at)], "repo string")
    return every.join(taken, "repo", "left").select("repo", F.when(F.col("repo").startswith("g"), "excluded").when(F.col("t").isNull(), "no_marker").otherwise("taken").alias("gate"))


@R.query("src03_signature", f"WITH {_TREE}, p AS (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY path) AS i FROM f WHERE path LIKE '%.py'), k AS (SELECT repo, array_to_string(list_sort(list_distinct(flatten(list(list_filter({list(KEYWORDS)}, lambda k: contains(text, k)))))), '|') AS frameworks FROM p WHERE i <= 20 GROUP BY repo), l AS (SELECT repo, {_LANGS} AS languages FROM f GROUP BY repo) SELECT repo, languages, coalesce(frameworks, '') AS frameworks FROM l LEFT JOIN k USING (repo)")
def _(s, d):
    at = tree(s, d)
    f = S.contents(S.listed(s, at), at).withColumn("text", F.make_valid_utf8(F.col("content").cast("string")))
    return S.signature(f, KEYWORDS).select("repo", F.array_join("languages", "|").alias("languages"), F.array_join("frameworks", "|").alias("frameworks"))


@R.query("src04_projects", f"WITH {_TREE} SELECT DISTINCT repo, regexp_extract(path, '^(.*)/[^/]*$', 1) AS folder FROM f WHERE regexp_extract(path, '([^/]+)$', 1) IN ('pyproject.toml', 'setup.py', 'package.json', 'Cargo.toml', 'go.mod', 'pom.xml')")
def _(s, d):
    """Folders at any depth that hold a marker file."""
    f = S.listed(s, tree(s, d)).where(F.regexp_extract("path", r"([^/]+)$", 1).isin(*S.MARKERS))
    return f.select("repo", F.regexp_extract("path", r"^(.*)/[^/]*$", 1).alias("folder")).distinct()


@R.query("src06_bounded", f"WITH {_TREE} SELECT repo, path FROM (SELECT repo, path, row_number() OVER (PARTITION BY repo ORDER BY path) AS i FROM f WHERE len(string_split(path, '/')) <= 3 AND NOT list_has_any(string_split(path, '/'), ['.git', 'node_modules', '__pycache__', '.venv', 'dist', 'build'])) WHERE i <= 120")
def _(s, d):
    return S.bounded(S.listed(s, tree(s, d))).select("repo", "path")


@R.query("src07_python_texts", "SELECT repo, path, md5(text) AS h FROM (SELECT DISTINCT repo, path, text FROM source_files) WHERE path LIKE '%.py'")
def _(s, d):
    at = tree(s, d)
    f = S.contents(S.listed(s, at).where(F.col("path").endswith(".py")).select("repo", "path"), at)
    return f.select("repo", "path", F.md5(F.make_valid_utf8(F.col("content").cast("string"))).alias("h"))


_NOTE = r"documents WHERE starts_with(replace(text, chr(13) || chr(10), chr(10)), '---' || chr(10))"
_BLOCK = r"regexp_extract(replace(text, chr(13) || chr(10), chr(10)), '(?s)^---\n(.*?)\n---', 1)"


def notes(s, d):
    return table(s, d, "documents").where(F.regexp_replace("text", r"\r\n", "\n").startswith("---\n"))


@R.query("src08_front_matter", rf"SELECT doc_id, regexp_extract({_BLOCK}, '(?m)^title: *(.*)$', 1) AS title, regexp_extract({_BLOCK}, '(?m)^type: *(.*)$', 1) AS type FROM {_NOTE}")
def _(s, d):
    m = S.front_matter(F.col("text"))
    return notes(s, d).select("doc_id", F.coalesce(m["title"], F.lit("")).alias("title"), F.coalesce(m["type"], F.lit("")).alias("type"))


@R.query("src09_tag_lists", rf"SELECT doc_id, array_to_string(list_filter(list_transform(string_split(regexp_extract({_BLOCK}, '(?m)^tags: *\[(.*)\]$', 1), ','), lambda x: trim(x)), lambda x: x <> ''), '|') AS tags FROM {_NOTE}")
def _(s, d):
    m = S.front_matter(F.col("text"))
    return notes(s, d).select("doc_id", F.array_join(S.list_value(F.coalesce(m["tags"], F.lit(""))), "|").alias("tags"))


@R.query("src10_commit_heads", rf"SELECT doc_id, regexp_extract({_BLOCK}, '(?m)^type: *(.*)$', 1) AS type, regexp_extract({_BLOCK}, '(?m)^title: *(.*)$', 1) AS title, regexp_extract({_BLOCK}, '(?m)^commit: *(.*)$', 1) AS commit_, regexp_extract({_BLOCK}, '(?m)^repo: *(.*)$', 1) AS repo FROM {_NOTE}")
def _(s, d):
    """Four keys alone, sought in the first forty lines."""
    head = F.array_join(F.slice(F.split(F.regexp_replace("text", r"\r\n", "\n"), "\n"), 1, 40), "\n")
    m = S.front_matter(head)
    return notes(s, d).select("doc_id", *[F.coalesce(m[k], F.lit("")).alias(n) for k, n in (("type", "type"), ("title", "title"), ("commit", "commit_"), ("repo", "repo"))])


@R.query("src11_bad_lines", "WITH l AS (SELECT doc_id, unnest(string_split(replace(text, chr(13), ''), chr(10))) AS x FROM documents WHERE text IS NOT NULL) SELECT doc_id, count_if(json_valid(x))::BIGINT AS good, count_if(NOT json_valid(x))::BIGINT AS bad FROM l WHERE starts_with(x, '{') GROUP BY doc_id")
def _(s, d):
    """Lines that begin as objects of JSON: how many are and how many are not."""
    x = table(s, d, "documents").where("text is not null").select("doc_id", F.explode(F.split(F.replace("text", F.lit("\r"), F.lit("")), "\n")).alias("x")).where(F.col("x").startswith("{"))
    ok = F.get_json_object("x", "$").isNotNull()
    return x.groupBy("doc_id").agg(F.count_if(ok).alias("good"), F.count_if(~ok).alias("bad"))


_LONGEST = "(SELECT text FROM documents WHERE text IS NOT NULL AND strlen(text) = length(text) ORDER BY length(text) DESC, doc_id LIMIT 1)"


@R.query("src12_tail", f"SELECT x AS line, count(*)::BIGINT AS n FROM (SELECT unnest(list_slice(string_split(right(text, 4096), chr(10)), 2, 100000)) AS x FROM {_LONGEST}) WHERE trim(x) <> '' GROUP BY x")
def _(s, d):
    """The last 4,096 bytes of the longest text, by lines."""
    one = table(s, d, "documents").where(F.octet_length("text") == F.length("text")).orderBy(F.desc(F.length("text")), "doc_id").limit(1)
    at = shared_path(s, "tail")
    S.write_tree(one.select(F.lit("r").alias("repo"), F.lit("log.txt").alias("path"), "text"), at)
    rows = s.createDataFrame([(x,) for x in S.tail_lines(f"{at}/r/log.txt", 4096)], "line string")
    return rows.groupBy("line").agg(F.count(F.lit(1)).alias("n"))


@R.query("src14_transcripts", "SELECT event_id, CASE WHEN user_id % 2 = 0 THEN 'a' ELSE 'b' END AS file FROM events WHERE user_id IS NOT NULL")
def _(s, d):
    """Messages that stand in several transcripts count where they come first by file name and line."""
    e = table(s, d, "events").where("user_id is not null")
    lines = e.where("user_id % 2 = 0").withColumn("file", F.lit("a")).unionByName(e.withColumn("file", F.lit("b")))
    at = shared_path(s, "transcripts")
    lines.select("file", F.to_json(F.struct("event_id", "event_type", "value")).alias("value")).unionByName(s.createDataFrame([("b", "{no json")], "file string, value string")).write.partitionBy("file").text(at)
    raw = s.read.text(at + "/file=*").select(F.regexp_extract(F.input_file_name(), "file=([^/]+)", 1).alias("file"), F.from_json("value", "event_id bigint, event_type string, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("m"))
    return raw.where("m._bad is null and m.event_id is not null").groupBy(F.col("m.event_id").alias("event_id")).agg(F.min("file").alias("file"))


@R.query("src15_git_log", r"SELECT DISTINCT repo, sha, coalesce(author, '') AS author, subject, coalesce(body, '') AS body, array_to_string(list_filter(list_transform(list_filter(coalesce(files, []), lambda x: x IS NOT NULL), lambda x: trim(x)), lambda x: x <> ''), '|') AS files FROM commit_nodes WHERE subject IS NOT NULL")
def _(s, d):
    """Logs of repositories, written as git would export them and parsed again."""
    c = table(s, d, "commit_nodes").where("subject is not null")
    none = F.lit("")
    record = F.concat_ws("\x1f", "sha", F.coalesce("author", none), "commit_date", "subject", F.coalesce("body", none), F.array_join(F.coalesce("files", F.array().cast("array<string>")), "\n"))
    at = shared_path(s, "logs")
    # A repository's log is many files, so that none holds it all.
    part = F.concat(F.lit("log-"), F.substring(F.md5("sha"), 1, 3), F.lit(".txt"))
    logs = c.select("repo", part.alias("path"), record.alias("r")).groupBy("repo", "path").agg(F.array_join(F.array_sort(F.collect_set("r")), "\x1e").alias("text"))
    S.write_tree(logs, at)
    back = S.contents(S.listed(s, at).select("repo", "path"), at).select("repo", F.col("content").cast("string").alias("value"))
    return S.git_log(back, keep=["repo"]).select("repo", "sha", "author", "subject", "body", F.array_join("files", "|").alias("files")).distinct()


@R.query("src16_branch_heads", "SELECT repo, branch, arg_max(sha, (committed_at, sha)) AS sha FROM commit_nodes WHERE repo IS NOT NULL AND branch IS NOT NULL AND sha IS NOT NULL GROUP BY ALL")
def _(s, d):
    return S.branch_heads(table(s, d, "commit_nodes"))


@R.query("src19_indexed", "SELECT repo, count(DISTINCT chunk_id)::BIGINT AS n FROM chunks GROUP BY repo")
def _(s, d):
    return table(s, d, "chunks").groupBy("repo").agg(F.count_distinct("chunk_id").alias("n"))


@R.query("src20_sync", "WITH i AS (SELECT DISTINCT chunk_id, repo, path, sha256(text) AS h FROM chunks WHERE chunk_index = 0), f AS (SELECT DISTINCT repo || ':' || path || '#0' AS chunk_id, repo, path, sha256(text) AS h, length(text) AS n FROM source_files) SELECT chunk_id, h FROM (SELECT chunk_id, h FROM f WHERE n > 0 AND path LIKE '%.py' UNION ALL SELECT chunk_id, h FROM i WHERE chunk_id NOT IN (SELECT chunk_id FROM f WHERE path LIKE '%.py' OR n = 0))")
def _(s, d):
    """First chunks with those of Python files replaced by the whole files, and those of empty files taken out."""
    i = table(s, d, "chunks").where("chunk_index = 0").select("chunk_id", F.sha2("text", 256).alias("h")).distinct()
    f = source(s, d).select(F.concat("repo", F.lit(":"), "path", F.lit("#0")).alias("chunk_id"), "path", F.sha2("text", 256).alias("h"), F.length("text").alias("n"))
    return S.sync(i, f.where(F.col("path").endswith(".py")).select("chunk_id", "h"), f.where("n = 0").select("chunk_id"), ["chunk_id"])


@R.query("src21_history", "SELECT DISTINCT sha AS task_id, coalesce(subject, '') AS task_description, coalesce(ticket, '') AS ticket, coalesce(scope, '') AS scope FROM commit_nodes")
def _(s, d):
    """Rows appended to a history, missing values as empty texts, read back."""
    at = shared_path(s, "history")
    c = table(s, d, "commit_nodes")
    c.select(F.col("sha").alias("task_id"), *[F.coalesce(x, F.lit("")).alias(n) for x, n in (("subject", "task_description"), ("ticket", "ticket"), ("scope", "scope"))]).write.mode("append").parquet(at)
    return s.read.parquet(at).distinct()


@R.query("src22_vector_store", "SELECT embed_model, count(DISTINCT vec_id)::BIGINT AS n FROM vector_records WHERE embed_model IN ('hashbow-64', 'nobody') GROUP BY embed_model")
def _(s, d):
    """A store in partitions of models: of other models' files nothing is read."""
    at = shared_path(s, "vectors")
    v = table(s, d, "vector_records").select("vec_id", "vector", "embed_model")
    S.write_partitioned(v, at, ["embed_model"])
    return s.read.schema(v.schema).parquet(at).where(F.col("embed_model").isin("hashbow-64", "nobody")).groupBy("embed_model").agg(F.count_distinct("vec_id").alias("n"))


@R.query("src23_vector_upsert", "SELECT vec_id, max(embedded_at) AS embedded_at FROM vector_records GROUP BY vec_id")
def _(s, d):
    v = table(s, d, "vector_records").select("vec_id", "embedded_at")
    first = v.groupBy("vec_id").agg(F.min("embedded_at").alias("embedded_at"))
    return S.upsert(first, v, ["vec_id"], "embedded_at")


@R.query("src24_claims", "SELECT event_id, (user_id % 4)::BIGINT AS worker FROM events WHERE user_id IS NOT NULL")
def _(s, d):
    """A queue drained once: every entry is claimed by one worker, and a stream started again claims nothing twice."""
    at = shared_path(s, "queue")
    q = E.read(s, d).where("user_id is not null").select("event_id", F.pmod("user_id", F.lit(4)).alias("worker"))
    E.drain(q, at)
    return E.drain(q, at).select("event_id", "worker")


@R.query("src25_summary", "SELECT 'repositories' AS name, count(DISTINCT repo)::BIGINT AS n FROM source_files UNION ALL SELECT 'files', count(DISTINCT file_id)::BIGINT FROM source_files")
def _(s, d):
    f = table(s, d, "source_files").agg(F.count_distinct("repo").alias("repositories"), F.count_distinct("file_id").alias("files")).first()
    at = shared_path(s, "summary") + "/summary.json"
    S.write_json(f.asDict(), at)
    return s.createDataFrame([(k, int(v)) for k, v in S.read_json(at).items()], "name string, n bigint")


@R.query("src26_indexes", "SELECT 'commits' AS name, count(*)::BIGINT AS rows FROM (SELECT DISTINCT repo, sha FROM commit_nodes) UNION ALL SELECT 'files', count(*)::BIGINT FROM (SELECT DISTINCT repo, path FROM source_files) UNION ALL SELECT 'symbols', count(*)::BIGINT FROM (SELECT DISTINCT repo, path, qualname, start_line FROM symbols)")
def _(s, d):
    made = {"files": source(s, d).select("repo", "path", "content_hash"), "symbols": table(s, d, "symbols").select("repo", "path", "qualname", "start_line").distinct(), "commits": table(s, d, "commit_nodes").select("repo", "sha").distinct()}
    return S.write_indexes(made, shared_path(s, "indexes"), "b1").select("name", "rows")


_TOLD = "SELECT doc_id, CASE WHEN strlen(substr(text, 1, 500)) < 3500 THEN substr(text, 1, 500) ELSE substr(text, 1, 200) END AS message FROM documents WHERE text IS NOT NULL"


@R.query("src27_telemetry", _TOLD)
def _(s, d):
    """Lines of JSON with trimmed messages, written and read back."""
    at = shared_path(s, "telemetry")
    t = table(s, d, "documents").where("text is not null")
    t.select(S.telemetry(F.lit("note"), F.col("doc_id").cast("string"), F.lit("log"), F.col("text")).alias("value")).write.mode("append").text(at)
    return s.read.schema("source string, message string").json(at).select(F.col("source").cast("bigint").alias("doc_id"), "message")


@R.query("sm08_telemetry_tail", f"SELECT doc_id, length(message)::BIGINT AS n FROM ({_TOLD})")
def _(s, d):
    """The same lines followed by a stream."""
    at = shared_path(s, "telemetry")
    t = table(s, d, "documents").where("text is not null")
    t.select(S.telemetry(F.lit("note"), F.col("doc_id").cast("string"), F.lit("log"), F.col("text")).alias("value")).write.mode("append").text(at)
    q = s.readStream.schema("source string, message string").json(at).select(F.col("source").cast("bigint").alias("doc_id"), F.length("message").cast("bigint").alias("n"))
    return E.drain(q, shared_path(s, "stream")).select("doc_id", "n")


@R.query("src30_fact_cache", "WITH f AS (SELECT DISTINCT repo, path, content_hash AS h FROM source_files), c AS (SELECT repo, path, max(file_hash) AS c FROM vector_records GROUP BY ALL) SELECT f.repo, f.path, CASE WHEN c.repo IS NULL THEN 'compile' WHEN h IS NOT DISTINCT FROM c THEN 'hit' ELSE 'stale' END AS state FROM f LEFT JOIN c ON f.repo = c.repo AND f.path = c.path")
def _(s, d):
    """Which facts a cache can serve, which it must make anew, and which it never had."""
    cache = table(s, d, "vector_records").select("repo", "path", F.col("file_hash").alias("content_hash"))
    return S.cache_state(table(s, d, "source_files").select("repo", "path", "content_hash").distinct(), cache, ["repo", "path"], "content_hash").select("repo", "path", "state")


@R.query("src31_summaries", r"SELECT repo, '# ' || repo || chr(10) || chr(10) || '- files: ' || count(*) || chr(10) || '- characters: ' || sum(length(text)) AS summary FROM (SELECT DISTINCT repo, path, text FROM source_files) GROUP BY repo")
def _(s, d):
    g = source(s, d).groupBy("repo").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("c"))
    return g.select("repo", F.concat(F.lit("# "), "repo", F.lit("\n\n- files: "), F.col("n").cast("string"), F.lit("\n- characters: "), F.col("c").cast("string")).alias("summary"))


@R.query("sc29_language_sizes", "SELECT lower(regexp_extract(path, '\\.([^./]+)$', 1)) AS extension, count(*)::BIGINT AS files, sum(strlen(text))::BIGINT AS bytes FROM (SELECT DISTINCT repo, path, text FROM source_files) GROUP BY 1")
def _(s, d):
    return source(s, d).groupBy(F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).alias("extension")).agg(F.count(F.lit(1)).alias("files"), F.sum(F.octet_length("text")).cast("bigint").alias("bytes"))
