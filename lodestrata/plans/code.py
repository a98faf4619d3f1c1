"""Queries over files, symbols and commits."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestrata.functions import text as T
from lodestrata.operators import joins, parse, sequence
from lodestrata.plans.registry import Registry
from lodestrata.runtime import table
from lodestrata.sources import files as S

R = Registry()
_MOD = r"regexp_replace(replace(regexp_replace(path, '\.py$', ''), '/', '.'), '\.__init__$', '')"
_EXT = r"lower(regexp_extract(path, '\.([^./]+)$', 1))"


def source(s, d):
    """Every file once, in the state scanned last."""
    state = F.struct("scanned_at", F.xxhash64("text"))
    g = table(s, d, "source_files").groupBy("repo", "path").agg(F.max_by(F.struct("text", "content_hash", "size", "lang", "scanned_at"), state).alias("f"))
    return g.select("repo", "path", "f.*")


@R.query("prj15_language_module", rf"SELECT DISTINCT repo, path, CASE {_EXT} WHEN 'py' THEN 'python' WHEN 'js' THEN 'javascript' WHEN 'json' THEN 'json' WHEN 'toml' THEN 'toml' WHEN 'xml' THEN 'xml' WHEN 'sh' THEN 'shell' WHEN 'md' THEN 'markdown' WHEN 'sql' THEN 'sql' ELSE 'unknown' END AS language, CASE WHEN path LIKE '%.py' THEN {_MOD} END AS module FROM source_files")
def _(s, d):
    p = F.col("path")
    return table(s, d, "source_files").select("repo", "path", T.language(p).alias("language"), F.when(p.endswith(".py"), T.module_name(p)).alias("module")).distinct()


@R.query("prj08_python_facts")
def _(s, d):
    f = parse.python_facts(source(s, d).where("path like '%.py'"))
    return f.select("repo", "path", "status", *[F.array_join(c, "|").alias(c) for c in ("imports", "classes", "functions", "constants", "decorators")], "summary")


@R.query("prj19_symbols")
def _(s, d):
    return parse.python_symbols(source(s, d).where("path like '%.py'"))


@R.query("prj20_calls")
def _(s, d):
    return parse.python_calls(source(s, d).where("path like '%.py'"))


@R.query("prj18_imports")
def _(s, d):
    return parse.python_imports(source(s, d).where("path like '%.py'"))


@R.query("ag15_scorecard")
def _(s, d):
    return parse.scorecard(parse.python_scores(source(s, d).where("path like '%.py'")))


@R.query("sc36_chunks", "SELECT DISTINCT repo, path, chunk_index::BIGINT AS chunk_index, start_byte, sha256(text) AS content FROM chunks")
def _(s, d):
    c = S.chunks(source(s, d))
    return c.select("repo", "path", F.col("chunk_index").cast("bigint").alias("chunk_index"), "start_byte", F.col("content_hash").alias("content"))


@R.query("wn14_duplicate_blocks", r"""WITH f AS (SELECT DISTINCT repo, path, list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '\s+', '', 'g')) AS l FROM source_files),
b AS (SELECT repo, path, CASE WHEN len(l) >= 3 THEN list_filter(list_transform(range(1, len(l) - 1), lambda i: l[i] || l[i + 1] || l[i + 2]), lambda x: length(x) >= 10) ELSE [] END AS b FROM f)
SELECT repo, path, len(b)::BIGINT AS blocks, round(CASE WHEN len(b) > 0 THEN 1 - len(list_distinct(b))::DOUBLE / len(b) ELSE 0.0 END, 6) AS duplicate_share FROM b""")
def _(s, d):
    return sequence.duplicate_blocks(source(s, d), ["repo", "path"], "text")


@R.query("prj23_commit_type", r"""WITH c AS (SELECT DISTINCT repo, sha, subject, lower(regexp_replace(subject, '^\s*\[?[A-Z][A-Z0-9]+-[0-9]+\]?[:\s-]*', '')) AS b FROM commit_nodes)
SELECT repo, sha, CASE WHEN regexp_matches(b, '^(?:feat|feature)(?:\([^)]*\))?!?:') THEN 'feature' WHEN regexp_matches(b, '^(?:fix|bug|bugfix|hotfix)(?:\([^)]*\))?!?:') THEN 'bug' WHEN regexp_matches(b, '^(?:test|tests)(?:\([^)]*\))?!?:') THEN 'test' WHEN regexp_matches(b, '^(?:refactor|perf)(?:\([^)]*\))?!?:') THEN 'refactor' WHEN regexp_matches(b, '^(?:chore|docs|style|build|ci|revert)(?:\([^)]*\))?!?:') THEN 'chore' ELSE 'unknown' END AS commit_type, coalesce(regexp_extract(lower(subject), '^(?:[^:(]*)\(([^)]*)\)!?:', 1), '') AS scope, coalesce(regexp_extract(subject, '\b([A-Z][A-Z0-9]+-[0-9]+)\b', 1), '') AS ticket FROM c""")
def _(s, d):
    c = F.col("subject")
    e = F.lit("")
    return table(s, d, "commit_nodes").select("repo", "sha", "subject").distinct().select("repo", "sha", parse.commit_type(c).alias("commit_type"), F.coalesce(parse.commit_scope(c), e).alias("scope"), F.coalesce(parse.commit_ticket(c), e).alias("ticket"))


_COMMITS = "(SELECT repo, sha, min(node_type) AS node_type, min(ticket) AS ticket, min(scope) AS scope, min(author) AS author, min(committed_at) AS at FROM commit_nodes GROUP BY repo, sha)"


def commits(s, d):
    return table(s, d, "commit_nodes").groupBy("repo", "sha").agg(*[F.min(c).alias(c) for c in ("node_type", "ticket", "scope", "author")], F.min("committed_at").alias("at"))


@R.query("ag05_commit_groups", rf"""WITH c AS (SELECT *, coalesce(nullif(ticket, ''), node_type || '-' || coalesce(scope, 'none')) AS grp FROM {_COMMITS}), n AS (SELECT repo, grp, node_type, count(*) AS k FROM c GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY repo, grp ORDER BY k DESC, node_type) AS i, sum(k) OVER (PARTITION BY repo, grp) AS total FROM n)
SELECT repo, grp, node_type AS main_type, CASE WHEN node_type IN ('feature', 'bug') THEN node_type ELSE 'knowledge' END AS rollup_type, total::BIGINT AS commits FROM r WHERE i = 1""")
def _(s, d):
    grp = F.coalesce(F.nullif("ticket", F.lit("")), F.concat_ws("-", "node_type", F.coalesce("scope", F.lit("none"))))
    n = commits(s, d).groupBy("repo", grp.alias("grp"), "node_type").agg(F.count(F.lit(1)).alias("k"))
    # The most frequent type, of equals the first by name.
    g = n.groupBy("repo", "grp").agg(F.max("k").alias("m"), F.sum("k").alias("commits")).join(n, ["repo", "grp"]).where("k = m").groupBy("repo", "grp", "commits").agg(F.min("node_type").alias("main_type"))
    return g.select("repo", "grp", "main_type", F.when(F.col("main_type").isin("feature", "bug"), F.col("main_type")).otherwise("knowledge").alias("rollup_type"), "commits")


@R.query("ag07_commit_index", "SELECT repo, f AS file, count(DISTINCT sha)::BIGINT AS commits, min(committed_at) AS first_at, max(committed_at) AS last_at FROM (SELECT repo, sha, committed_at, unnest(files) AS f FROM commit_nodes) WHERE f IS NOT NULL AND f <> '' GROUP BY repo, f")
def _(s, d):
    e = table(s, d, "commit_nodes").select("repo", "sha", "committed_at", F.explode("files").alias("file")).where("file is not null and file <> ''")
    per = e.groupBy("repo", "file", "sha").agg(F.min("committed_at").alias("a"), F.max("committed_at").alias("z"))
    return per.groupBy("repo", "file").agg(F.count(F.lit(1)).alias("commits"), F.min("a").alias("first_at"), F.max("z").alias("last_at"))


@R.query("ag01_repo_summary", rf"SELECT repo, count(*)::BIGINT AS files, count(DISTINCT {_EXT})::BIGINT AS languages, sum(length(text))::BIGINT AS chars, sum(CASE WHEN length(text) = 0 THEN 1 ELSE 0 END)::BIGINT AS empty FROM (SELECT DISTINCT repo, path, text FROM source_files) GROUP BY repo")
def _(s, d):
    ext = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    return source(s, d).groupBy("repo").agg(F.count(F.lit(1)).alias("files"), F.count_distinct(ext).alias("languages"), F.sum(F.length("text")).alias("chars"), F.count_if(F.length("text") == 0).alias("empty"))


@R.query("ag18_checksums", r"SELECT repo, dir, sha256(string_agg(part, ',' ORDER BY b)) AS checksum FROM (SELECT repo, dir, b, sha256(string_agg(path || ':' || sha256(text), ',' ORDER BY path)) AS part FROM (SELECT DISTINCT repo, path, text, regexp_extract(path, '^(.*)/', 1) AS dir, substr(sha256(path), 1, 2) AS b FROM source_files) GROUP BY ALL) GROUP BY repo, dir")
def _(s, d):
    """Files are hashed in 256 parts of a directory first, so that no row holds all of a directory's files."""
    row = F.struct("path", F.concat("path", F.lit(":"), F.sha2("text", 256)).alias("v"))
    joined = lambda c: F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(c)), lambda x: x["v"]), ","), 256)
    parts = source(s, d).groupBy("repo", F.regexp_extract("path", "^(.*)/", 1).alias("dir"), F.substring(F.sha2("path", 256), 1, 2).alias("b")).agg(joined(row).alias("v"))
    return parts.groupBy("repo", "dir").agg(joined(F.struct("b", "v")).alias("checksum"))


@R.query("ax18_sizes", r"SELECT coalesce(repo, '(all)') AS repo, coalesce(top, '(all)') AS top, sum(n)::BIGINT AS bytes FROM (SELECT repo, regexp_extract(path, '^([^/]*)', 1) AS top, strlen(text) AS n FROM (SELECT DISTINCT repo, path, text FROM source_files)) GROUP BY ROLLUP (repo, top)")
def _(s, d):
    f = source(s, d).select("repo", F.regexp_extract("path", "^([^/]*)", 1).alias("top"), F.octet_length("text").alias("n"))
    return f.rollup("repo", "top").agg(F.sum("n").alias("bytes")).select(F.coalesce("repo", F.lit("(all)")).alias("repo"), F.coalesce("top", F.lit("(all)")).alias("top"), "bytes")


@R.query("jn01_chunk_files", "SELECT DISTINCT c.chunk_id, f.content_hash AS file_hash, strlen(f.text)::BIGINT AS file_bytes FROM chunks c LEFT JOIN (SELECT repo, path, min(content_hash) AS content_hash, min(text) AS text FROM source_files GROUP BY repo, path) f USING (repo, path)")
def _(s, d):
    f = table(s, d, "source_files").groupBy("repo", "path").agg(F.min("content_hash").alias("file_hash"), F.min(F.octet_length("text")).cast("bigint").alias("file_bytes"))
    return table(s, d, "chunks").select("chunk_id", "repo", "path").distinct().join(f, ["repo", "path"], "left").select("chunk_id", "file_hash", "file_bytes")


_SPANS = "(SELECT DISTINCT repo, path, qualname, start_line, end_line FROM symbols)"


@R.query("jn04_innermost", f"""WITH p AS (SELECT DISTINCT repo, path, unnest(range(1, len(string_split(text, chr(10))) + 1, 3))::INTEGER AS line FROM source_files WHERE path LIKE '%.py'),
h AS (SELECT p.*, s.qualname, s.start_line, row_number() OVER (PARTITION BY p.repo, p.path, p.line ORDER BY s.start_line DESC, coalesce(s.end_line, s.start_line), s.qualname DESC) AS i FROM p JOIN {_SPANS} s ON p.repo = s.repo AND p.path = s.path AND p.line BETWEEN s.start_line AND coalesce(s.end_line, s.start_line))
SELECT repo, path, line, start_line, qualname FROM h WHERE i = 1""")
def _(s, d):
    """Every third line of every Python file with the definition that holds it."""
    lines = F.explode(F.sequence(F.lit(1), F.size(F.split("text", "\n")), F.lit(3))).alias("line")
    points = table(s, d, "source_files").where("path like '%.py'").select("repo", "path", lines).distinct()
    spans = table(s, d, "symbols").select("repo", "path", "qualname", "start_line", "end_line").distinct()
    return joins.innermost(points, spans, ["repo", "path"], "line", "start_line", "end_line", ["start_line", "qualname"])


@R.query("jn07_longest_prefix", rf"WITH n AS (SELECT DISTINCT {_MOD} AS name FROM source_files WHERE path LIKE '%.py'), p AS (SELECT DISTINCT replace(regexp_extract(path, '^(.*)/', 1), '/', '.') AS prefix FROM source_files WHERE path LIKE '%/%/%'), h AS (SELECT name, prefix, row_number() OVER (PARTITION BY name ORDER BY length(prefix) DESC) AS i FROM n JOIN p ON name = prefix OR starts_with(name, prefix || '.')) SELECT name, prefix FROM h WHERE i = 1")
def _(s, d):
    f = table(s, d, "source_files")
    names = f.where("path like '%.py'").select(T.module_name(F.col("path")).alias("name")).distinct()
    prefixes = f.where("path like '%/%/%'").select(F.replace(F.regexp_extract("path", "^(.*)/", 1), F.lit("/"), F.lit(".")).alias("prefix"))
    return joins.longest_prefix(names, "name", prefixes, "prefix")


@R.query("jn09_cross_repo", """WITH o AS (SELECT name, min(repo) AS to_repo FROM (SELECT DISTINCT repo, split_part(qualname, '.', 1) AS name FROM symbols) GROUP BY name HAVING count(*) = 1), u AS (SELECT DISTINCT repo, path AS file, unnest(regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_]*')) AS name FROM source_files)
SELECT repo AS from_repo, to_repo, count(*)::BIGINT AS uses, array_to_string(list_sort(list_distinct(list(file)))[1:5], ',') AS examples FROM u JOIN o USING (name) WHERE repo <> to_repo GROUP BY repo, to_repo""")
def _(s, d):
    """Names that one repository alone defines and files of another mention, with the first five files."""
    owners = table(s, d, "symbols").select("repo", F.substring_index("qualname", ".", 1).alias("name"))
    names = F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit("[A-Za-z_][A-Za-z0-9_]*"), F.lit(0))))
    uses = table(s, d, "source_files").select("repo", F.col("path").alias("file"), names.alias("name")).distinct()
    return joins.ownership(uses, owners, "name")


@R.query("jn13_snapshot_diff", "WITH o AS (SELECT repo || ':' || path AS id, min(content_hash) AS h FROM chunks WHERE chunk_index = 0 GROUP BY 1), n AS (SELECT file_id AS id, min(content_hash) AS h FROM source_files GROUP BY 1) SELECT coalesce(o.id, n.id) AS id, CASE WHEN o.id IS NULL THEN 'added' WHEN n.id IS NULL THEN 'deleted' WHEN o.h IS NOT DISTINCT FROM n.h THEN 'unchanged' ELSE 'changed' END AS change FROM o FULL OUTER JOIN n ON o.id = n.id")
def _(s, d):
    old = table(s, d, "chunks").where("chunk_index = 0").groupBy(F.concat_ws(":", "repo", "path").alias("id")).agg(F.min("content_hash").alias("h"))
    new = table(s, d, "source_files").groupBy(F.col("file_id").alias("id")).agg(F.min("content_hash").alias("h"))
    return joins.snapshot_diff(old, new, "id", "h")


_FILES = "SELECT DISTINCT repo || ':' || f AS id FROM (SELECT repo, unnest(files) AS f FROM commit_nodes) WHERE f IS NOT NULL"


@R.query("jn21_membership", f"WITH k AS ({_FILES}) SELECT id FROM k WHERE (id IN (SELECT file_id FROM source_files WHERE path LIKE '%.py') OR id IN (SELECT repo || ':README.md' FROM source_files)) AND id NOT IN (SELECT file_id FROM source_files WHERE length(text) = 0)")
def _(s, d):
    f = table(s, d, "source_files")
    keys = table(s, d, "commit_nodes").select("repo", F.explode("files").alias("f")).where("f is not null").select(F.concat_ws(":", "repo", "f").alias("id")).distinct()
    base, gone = f.where("path like '%.py'").select(F.col("file_id").alias("id")), f.where(F.length("text") == 0).select(F.col("file_id").alias("id"))
    return joins.members(keys, "id", base, f.select(F.concat("repo", F.lit(":README.md")).alias("id")), gone)


@R.query("jn23_freshness", "WITH c AS (SELECT DISTINCT repo || ':' || path AS id, file_hash AS h FROM vector_records), n AS (SELECT file_id AS id, min(content_hash) AS now FROM source_files GROUP BY 1) SELECT id, coalesce(coalesce(h, '') <> '' AND h = now, false) AS fresh FROM c LEFT JOIN n USING (id)")
def _(s, d):
    cited = table(s, d, "vector_records").select(F.concat_ws(":", "repo", "path").alias("id"), F.col("file_hash").alias("h")).distinct()
    now = table(s, d, "source_files").groupBy(F.col("file_id").alias("id")).agg(F.min("content_hash").alias("h"))
    return joins.stale(cited, now, "id", "h")


@R.query("tk24_symbols_by_prefix", "SELECT DISTINCT repo, path, qualname, start_line FROM symbols WHERE starts_with(qualname, 'read_') OR starts_with(qualname, 'Read')")
def _(s, d):
    q = F.col("qualname")
    return table(s, d, "symbols").where(q.startswith("read_") | q.startswith("Read")).select("repo", "path", "qualname", "start_line").distinct()


@R.query("tk17_symbols_per_file", "WITH s AS (SELECT DISTINCT repo, path, qualname, start_line FROM symbols), r AS (SELECT *, row_number() OVER (PARTITION BY repo, path ORDER BY CASE WHEN contains(qualname, 'token') THEN 0 ELSE 1 END, start_line, qualname) AS rank FROM s) SELECT repo, path, qualname, start_line, rank::INTEGER AS rank FROM r WHERE rank <= 3")
def _(s, d):
    from lodestrata.operators.search import per_group

    sy = table(s, d, "symbols").select("repo", "path", "qualname", "start_line").distinct()
    return per_group(sy, ["repo", "path"], [F.when(F.contains("qualname", F.lit("token")), 0).otherwise(1), F.col("start_line"), F.col("qualname")], 3)


@R.query("src17_upsert", "SELECT file_id, content_hash, scanned_at FROM (SELECT file_id, min(content_hash) AS content_hash, scanned_at, row_number() OVER (PARTITION BY file_id ORDER BY scanned_at DESC) AS i FROM source_files GROUP BY file_id, scanned_at) WHERE i = 1")
def _(s, d):
    """The state of the first scans, with the rows of all later scans put in."""
    f = table(s, d, "source_files").groupBy("file_id", "scanned_at").agg(F.min("content_hash").alias("content_hash")).select("file_id", "content_hash", "scanned_at")
    first = f.groupBy("file_id").agg(F.min("scanned_at").alias("scanned_at"))
    return S.upsert(f.join(first, ["file_id", "scanned_at"]).select(*f.columns), f.join(first, ["file_id", "scanned_at"], "left_anti").select(*f.columns), ["file_id"], "scanned_at")


@R.query("src18_delete", "SELECT DISTINCT file_id FROM source_files WHERE file_id NOT IN (SELECT file_id FROM source_files WHERE length(text) = 0)")
def _(s, d):
    f = table(s, d, "source_files").select("file_id", "text")
    return S.delete(f, f.where(F.length("text") == 0), ["file_id"]).select("file_id").distinct()


@R.query("src29_addressed", "SELECT DISTINCT sha256(text) AS sha, substr(sha256(text), 1, 2) AS prefix FROM source_files")
def _(s, d):
    return S.addressed(table(s, d, "source_files"), "text").select("sha", "prefix")
