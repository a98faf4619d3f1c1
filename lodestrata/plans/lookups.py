"""Queries of lookups, reconciliations and small rankings."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lodestrata.functions import text as T
from lodestrata.operators import joins, lookups, parse, search
from lodestrata.plans.code import source
from lodestrata.plans.graphs import follows
from lodestrata.plans.ledgers import events, runs
from lodestrata.plans.ledgers import _LINES as LINES
from lodestrata.plans.registry import Registry
from lodestrata.plans.retrieval import first_vector
from lodestrata.runtime import table

R = Registry()
_SRC = "(SELECT DISTINCT repo, path, text, content_hash FROM source_files)"
_MOD = r"regexp_replace(replace(regexp_replace(path, '\.py$', ''), '/', '.'), '\.__init__$', '')"


@R.query("jn02_symbol_files", f"SELECT DISTINCT s.repo, s.path, s.qualname, s.start_line, coalesce(f.content_hash, s.repo || ':' || s.path) AS file FROM symbols s LEFT JOIN {_SRC} f ON s.repo = f.repo AND s.path = f.path")
def _(s, d):
    sy = table(s, d, "symbols").select("repo", "path", "qualname", "start_line").distinct().withColumn("id", F.concat_ws(":", "repo", "path"))
    f = source(s, d).select("repo", "path", F.col("content_hash").alias("file"))
    return lookups.left_lookup(sy, f, ["repo", "path"], "file", "id").drop("id")


@R.query("jn03_feature_tests", rf"""WITH t AS (SELECT DISTINCT repo, path, regexp_extract(path, '([^/]+)/[^/]+$', 1) AS feature FROM source_files WHERE starts_with(path, 'tests/') AND path LIKE '%/%/%'),
a AS (SELECT DISTINCT repo, regexp_extract(path, '([^/]+)/[^/]+$', 1) AS feature FROM source_files WHERE NOT starts_with(path, 'tests/') AND path LIKE '%/%')
SELECT a.repo, a.feature, t.path AS test, f.content_hash AS file FROM a LEFT JOIN t ON a.repo = t.repo AND a.feature = t.feature LEFT JOIN {_SRC} f ON t.repo = f.repo AND t.path = f.path""")
def _(s, d):
    """Features (folders) with the tests of the same name and their hashes; features without tests stay."""
    f = source(s, d).select("repo", "path", F.col("content_hash").alias("file"), F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("feature"))
    t = f.where(F.col("path").startswith("tests/") & F.col("path").like("%/%/%")).select("repo", "feature", F.col("path").alias("test"), "file")
    a = f.where(~F.col("path").startswith("tests/") & F.col("path").contains("/")).select("repo", "feature").distinct()
    return a.join(t, ["repo", "feature"], "left").select("repo", "feature", "test", "file")


@R.query("jn05_smallest_span", """WITH p AS (SELECT DISTINCT repo, path, start_line + 1 AS line FROM symbols), s AS (SELECT DISTINCT repo, path, qualname, start_line, coalesce(end_line, start_line) AS e FROM symbols)
SELECT repo, path, line, qualname FROM (SELECT p.*, s.qualname, row_number() OVER (PARTITION BY p.repo, p.path, p.line ORDER BY s.e - s.start_line, s.start_line, s.qualname) AS i FROM p JOIN s ON p.repo = s.repo AND p.path = s.path AND line BETWEEN s.start_line AND s.e) WHERE i = 1""")
def _(s, d):
    """The line after the head of every definition, with the shortest definition that holds it."""
    sy = table(s, d, "symbols").select("repo", "path", "qualname", "start_line", F.coalesce("end_line", "start_line").alias("e")).distinct()
    p = sy.select("repo", "path", (F.col("start_line") + 1).alias("line")).distinct()
    cell = lambda a, z: F.explode(F.sequence(F.floor(a / 64), F.floor(z / 64)))
    hit = p.withColumn("c", F.floor(F.col("line") / 64)).join(sy.withColumn("c", cell(F.col("start_line"), F.col("e"))), ["repo", "path", "c"]).where("line between start_line and e")
    best = F.min(F.struct((F.col("e") - F.col("start_line")).alias("w"), "start_line", "qualname")).alias("b")
    return hit.groupBy("repo", "path", "line").agg(best).select("repo", "path", "line", "b.qualname")


def diffs(s, d):
    """Commits as diffs: of file i of a commit the lines from 1 + 7 * i on, 20 of them; every fifth file is deleted."""
    c = table(s, d, "commit_nodes").select("repo", "sha", "files").distinct().where("files is not null")
    f = c.select("repo", "sha", F.posexplode(F.array_compact("files")).alias("i", "path")).where("path <> ''").distinct()
    start = (F.col("i") * 7 + 1).cast("string")
    head = F.concat(F.lit("--- a/"), "path", F.lit("\n+++ "), F.when(F.col("i") % 5 == 4, "/dev/null").otherwise(F.concat(F.lit("b/"), "path")))
    hunk = F.when(F.col("i") % 5 == 4, F.lit("\n@@ -1,3 +0,0 @@\n-x")).when(F.col("i") % 3 == 2, F.concat(F.lit("\n@@ -1 +"), start, F.lit(" @@\n+x"))).otherwise(F.concat(F.lit("\n@@ -1,3 +"), start, F.lit(",20 @@ def f\n+x")))
    part = F.struct("i", F.concat(head, hunk).alias("t"))
    return f.groupBy("repo", "sha").agg(F.array_join(F.transform(F.array_sort(F.collect_list(part)), lambda x: x["t"]), "\n").alias("diff"))


_HUNKS = "h AS (SELECT DISTINCT repo, sha, path, (i * 7 + 1)::INTEGER AS start, CASE WHEN i % 3 = 2 THEN 1 ELSE 20 END::INTEGER AS count FROM (SELECT repo, sha, unnest(fs) AS path, unnest(range(0, len(fs))) AS i FROM (SELECT DISTINCT repo, sha, list_filter(files, lambda x: x IS NOT NULL) AS fs FROM (SELECT DISTINCT repo, sha, files FROM commit_nodes) WHERE files IS NOT NULL)) WHERE i % 5 <> 4 AND path <> '')"


def hunks(s, d):
    x = diffs(s, d).withColumn("id", F.concat_ws(" ", "repo", "sha"))
    r = parse.diff_ranges(x, "id", "diff")
    return r.select(F.substring_index("id", " ", 1).alias("repo"), F.substring_index("id", " ", -1).alias("sha"), "path", "start", "count")


@R.query("prj22_hunks", f"WITH {_HUNKS} SELECT repo, sha, path, start, count FROM h")
def _(s, d):
    return hunks(s, d)


@R.query("jn06_commit_functions", f"WITH {_HUNKS}, n AS (SELECT repo, sha FROM h GROUP BY repo, sha HAVING count(DISTINCT path) <= 60) SELECT DISTINCT h.repo, h.sha, h.path, s.qualname FROM h JOIN n ON h.repo = n.repo AND h.sha = n.sha JOIN symbols s ON h.repo = s.repo AND h.path = s.path AND s.start_line <= h.start + h.count - 1 AND h.start <= coalesce(s.end_line, s.start_line)")
def _(s, d):
    return lookups.hunk_functions(hunks(s, d), table(s, d, "symbols"), ["repo", "sha"])


@R.query("jn08_related", rf"""WITH m AS (SELECT repo, {_MOD} AS module, min(path) AS file FROM source_files WHERE path LIKE '%.py' GROUP BY ALL), i AS (SELECT DISTINCT repo, path, {_MOD} || '.Thing' AS name, 1 AS rank FROM source_files WHERE path LIKE '%.py' UNION ALL SELECT DISTINCT a.repo, a.path, regexp_replace(replace(regexp_replace(b.path, '\.py$', ''), '/', '.'), '\.__init__$', '') || '.x.y' AS name, 2 AS rank FROM source_files a JOIN source_files b ON a.repo = b.repo AND a.path LIKE '%.py' AND b.path LIKE '%.py' AND regexp_extract(a.path, '^(.*)/', 1) = regexp_extract(b.path, '^(.*)/', 1)),
h AS (SELECT i.repo, i.path, i.rank, i.name, arg_max(m.file, length(m.module)) AS target FROM i JOIN m ON i.repo = m.repo AND (i.name = m.module OR starts_with(i.name, m.module || '.')) GROUP BY ALL), o AS (SELECT repo, path, target, min((rank, name)) AS o FROM h WHERE target <> path GROUP BY ALL)
SELECT repo, path, target FROM (SELECT *, row_number() OVER (PARTITION BY repo, path ORDER BY o, target) AS i FROM o) WHERE i <= 3""")
def _(s, d):
    """Files related to each file: the first three that hold what it names, itself and those beside it."""
    f = source(s, d).where(F.col("path").endswith(".py")).select("repo", "path", T.module_name(F.col("path")).alias("module"), F.regexp_extract("path", "^(.*)/", 1).alias("dir"))
    own = f.select("repo", "path", F.concat("module", F.lit(".Thing")).alias("name"), F.lit(1).alias("rank"))
    near = f.select("repo", "path", "dir").join(f.select("repo", "dir", F.concat("module", F.lit(".x.y")).alias("name")), ["repo", "dir"]).select("repo", "path", "name", F.lit(2).alias("rank"))
    return lookups.related(own.unionByName(near), f.select("repo", "module", F.col("path").alias("file")), ["repo", "path"], 3)


@R.query("jn12_reconciled", "WITH k AS (SELECT user_id, CASE WHEN user_id % 3 = 0 THEN 'resolved' ELSE 'open' END AS status, count(*) AS c FROM events WHERE event_type = 'error' AND user_id IS NOT NULL AND ts < TIMESTAMP '2024-01-10' GROUP BY user_id), n AS (SELECT user_id, count(*) AS n FROM events WHERE event_type = 'error' AND user_id IS NOT NULL AND ts >= TIMESTAMP '2024-01-29' GROUP BY user_id) SELECT coalesce(k.user_id, n.user_id) AS user_id, CASE WHEN n IS NOT NULL THEN 'open' WHEN status = 'open' AND k.user_id % 7 <> 0 THEN 'resolved' ELSE status END AS status, (coalesce(c, 0) + coalesce(n, 0))::BIGINT AS count, CASE WHEN status IS NULL THEN 'detected' WHEN n IS NOT NULL AND status = 'resolved' THEN 'reopened' WHEN n IS NULL AND status = 'open' AND k.user_id % 7 <> 0 THEN 'resolved' ELSE 'unchanged' END AS change FROM k FULL JOIN n ON k.user_id = n.user_id")
def _(s, d):
    """Errors of users known from the first days, against those of the last: detected, reopened, resolved, unchanged; scans of every seventh user were cut short."""
    e = table(s, d, "events").where("event_type = 'error' and user_id is not null")
    known = e.where("ts < timestamp_ntz '2024-01-10'").groupBy("user_id").agg(F.count(F.lit(1)).alias("count")).withColumn("status", F.when(F.col("user_id") % 3 == 0, "resolved").otherwise("open"))
    found = e.where("ts >= timestamp_ntz '2024-01-29'").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    return lookups.reconcile(known, found, "user_id", F.col("user_id") % 7 == 0)


@R.query("jn18_roster", f"""WITH {LINES}, v AS (SELECT doc_id, pos, CASE WHEN pos % 4 <> 0 THEN tier END AS session, status FROM r WHERE event = 'gate.verdict'), a AS (SELECT CASE WHEN pos % 5 <> 0 THEN tier END AS session, event AS agent, ts, doc_id, pos, total_tokens FROM r WHERE event IS NOT NULL AND ts IS NOT NULL),
x AS (SELECT DISTINCT session FROM v), j AS (SELECT x.session, a.agent, arg_max(coalesce(a.total_tokens, -1), (a.ts, a.doc_id, a.pos)) AS tokens FROM x JOIN a ON a.session = x.session OR (a.session IS NULL AND x.session IS NOT NULL) GROUP BY ALL), g AS (SELECT agent, arg_max(coalesce(total_tokens, -1), (ts, doc_id, pos)) AS tokens FROM a GROUP BY agent)
SELECT v.doc_id, v.pos, v.session, j.agent, j.tokens FROM v JOIN j ON v.session = j.session UNION ALL SELECT v.doc_id, v.pos, v.session, g.agent, g.tokens FROM v, g WHERE v.session IS NULL""")
def _(s, d):
    """Verdicts with the last record of each agent (event) of their session (tier)."""
    r = runs(s, d)
    v = r.where("event = 'gate.verdict'").select("doc_id", "pos", F.when(F.col("pos") % 4 != 0, F.col("tier")).alias("session"))
    a = r.where("event is not null and ts is not null").select(F.when(F.col("pos") % 5 != 0, F.col("tier")).alias("session"), F.col("event").alias("agent"), "ts", F.col("doc_id").alias("o1"), F.col("pos").alias("o2"), F.coalesce("total_tokens", F.lit(-1)).alias("tokens"))
    return lookups.roster(v, a, "session", "agent", ["ts", "o1", "o2"], ["tokens"]).select("doc_id", "pos", "session", "agent", "tokens")


@R.query("jn22_prefiltered", "SELECT DISTINCT vec_id FROM vector_records WHERE content_hash IN (SELECT content_hash FROM chunks WHERE content_hash IS NOT NULL)")
def _(s, d):
    """Vectors of chunks that are there: a Bloom filter leaves few others, an exact join takes those out."""
    c = table(s, d, "chunks").where("content_hash is not null").select("content_hash").distinct()
    v = table(s, d, "vector_records").select("vec_id", "content_hash")
    return lookups.maybe_in(v, "content_hash", lookups.bloom(c, "content_hash")).join(c, "content_hash", "left_semi").select("vec_id").distinct()


@R.query("st01_seeds", "SELECT id FROM (SELECT DISTINCT id FROM (SELECT repo || ':' || path AS id FROM symbols WHERE starts_with(qualname, 'read_') UNION ALL SELECT file_id FROM source_files WHERE contains(path, '/ledger')) ORDER BY id LIMIT 10)")
def _(s, d):
    a = table(s, d, "symbols").where(F.col("qualname").startswith("read_")).select(F.concat_ws(":", "repo", "path").alias("id"))
    return lookups.page(a.unionByName(table(s, d, "source_files").where(F.contains("path", F.lit("/ledger"))).select(F.col("file_id").alias("id"))).distinct(), ["id"], 10)


@R.query("st12_new_titles", "SELECT repo, sha, CASE WHEN lower(trim(subject)) IN (SELECT lower(trim(subject)) FROM commit_nodes WHERE node_type = 'feature' AND subject IS NOT NULL) THEN 'duplicate' ELSE 'new' END AS verdict FROM (SELECT DISTINCT repo, sha, subject FROM commit_nodes WHERE node_type = 'bug')")
def _(s, d):
    """Titles of bugs that an approved feature has already."""
    c = table(s, d, "commit_nodes")
    title = F.lower(F.trim("subject"))
    have = c.where("node_type = 'feature' and subject is not null").select(title.alias("t"), F.lit(True).alias("in")).distinct()
    rows = c.where("node_type = 'bug'").select("repo", "sha", "subject").distinct().withColumn("t", title)
    return rows.join(have, "t", "left").select("repo", "sha", F.when(F.col("in"), "duplicate").otherwise("new").alias("verdict"))


@R.query("tk09_first_word", "SELECT doc_id FROM (SELECT doc_id FROM documents WHERE contains(lower(text), 'ledger') ORDER BY doc_id LIMIT 20)")
def _(s, d):
    """The plain fallback: texts that hold the first word of a query."""
    word = "ledger shard".split()[0].lower()
    return lookups.page(table(s, d, "documents").where(F.contains(F.lower("text"), F.lit(word))).select("doc_id"), ["doc_id"], 20)


_SECTIONS = r"(SELECT doc_id, unnest(list_slice(regexp_split_to_array(chr(10) || replace(text, chr(13), ''), '\n## '), 2, 100000)) AS card FROM documents WHERE text IS NOT NULL)"


def cards(s, d):
    body = F.concat(F.lit("\n"), F.replace("text", F.lit("\r"), F.lit("")))
    parts = F.split(body, "\n## ")
    return table(s, d, "documents").where("text is not null").select("doc_id", F.explode(F.slice(parts, 2, 100000)).alias("card"))


_COUNT = "((length(lower({c})) - length(replace(lower({c}), 'ledger', ''))) // 6 + (length(lower({c})) - length(replace(lower({c}), 'shard', ''))) // 5)::BIGINT"


@R.query("tk11_patterns", f"SELECT title, hits, CASE WHEN hits >= 5 THEN 'high' WHEN hits >= 3 THEN 'medium' ELSE 'low' END AS confidence FROM (SELECT string_split(card, chr(10))[1] AS title, max({_COUNT.format(c='card')}) AS hits FROM {_SECTIONS} GROUP BY 1) WHERE hits > 0 ORDER BY hits DESC, title LIMIT 12")
def _(s, d):
    """Sections ranked as patterns by how often they name the words asked for."""
    c = cards(s, d).withColumn("title", F.get(F.split("card", "\n"), F.lit(0)))
    hits = sum((T.occurrences(F.col("card"), w) for w in ("ledger", "shard")), F.lit(0).cast("bigint"))
    per = c.groupBy("title").agg(F.max(hits).alias("hits")).where("hits > 0").orderBy(F.desc("hits"), "title").limit(12)
    return per.withColumn("confidence", F.when(F.col("hits") >= 5, "high").when(F.col("hits") >= 3, "medium").otherwise("low"))


@R.query("tk12_nodes", f"SELECT node, hits FROM (SELECT DISTINCT repo || ':' || path AS node, {_COUNT.format(c='path')} AS hits FROM source_files) WHERE hits > 0 ORDER BY hits DESC, node LIMIT 15")
def _(s, d):
    n = table(s, d, "source_files").select(F.concat_ws(":", "repo", "path").alias("node"), "path").distinct()
    return search.substring_rank(n, "node", "path", ("ledger", "shard"), 15).select("node", "hits")


@R.query("tk13_directories", f"SELECT dir, hits FROM (SELECT dir, sum({_COUNT.format(c='path')})::BIGINT AS hits FROM (SELECT DISTINCT repo, path, repo || '/' || regexp_extract(path, '^(.*)/', 1) AS dir FROM source_files) GROUP BY dir) WHERE hits > 0 ORDER BY hits DESC, dir LIMIT 10")
def _(s, d):
    f = table(s, d, "source_files").select("repo", "path").distinct()
    hits = sum((T.occurrences(F.col("path"), w) for w in ("ledger", "shard")), F.lit(0).cast("bigint"))
    g = f.groupBy(F.concat_ws("/", "repo", F.regexp_extract("path", "^(.*)/", 1)).alias("dir")).agg(F.sum(hits).alias("hits"))
    return g.where("hits > 0").orderBy(F.desc("hits"), "dir").limit(10)


@R.query("tk15_corpus_quotes", r"WITH p AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS p FROM documents WHERE text IS NOT NULL), s AS (SELECT p AS quote, min(doc_id) AS doc_id, ((CASE WHEN contains(lower(p), 'ledger') THEN 1 ELSE 0 END + CASE WHEN contains(lower(p), 'queue') THEN 1 ELSE 0 END))::INTEGER AS words FROM p WHERE length(p) BETWEEN 20 AND 300 GROUP BY p) SELECT quote, doc_id, words FROM s WHERE words > 0 ORDER BY words DESC, doc_id, quote LIMIT 25")
def _(s, d):
    """The best lines of the whole corpus, each once."""
    p = table(s, d, "documents").where("text is not null").select("doc_id", F.explode(F.split("text", "\n")).alias("quote")).where("length(quote) between 20 and 300")
    words = sum((F.when(F.contains(F.lower("quote"), F.lit(w)), 1).otherwise(0) for w in ("ledger", "queue")), F.lit(0))
    return p.withColumn("words", words).where("words > 0").groupBy("quote", "words").agg(F.min("doc_id").alias("doc_id")).orderBy(F.desc("words"), "doc_id", "quote").limit(25).select("quote", "doc_id", "words")


@R.query("tk19_named_nodes", "SELECT name, n FROM (SELECT DISTINCT regexp_extract(qualname, '([^.]*)$', 1) AS name, (CASE WHEN contains(lower(qualname), 'shard') THEN 1 ELSE 0 END + CASE WHEN contains(lower(qualname), 'queue') THEN 1 ELSE 0 END + CASE WHEN contains(lower(qualname), 'token') THEN 1 ELSE 0 END)::INTEGER AS n FROM symbols WHERE NOT contains(qualname, '.')) WHERE n > 0 ORDER BY n DESC, name LIMIT 3")
def _(s, d):
    """Nodes whose name holds most of the long words of a title."""
    words = [w.lower() for w in "shard queue of token".split() if len(w) > 3]
    n = sum((F.when(F.contains(F.lower("name"), F.lit(w)), 1).otherwise(0) for w in words), F.lit(0))
    q = table(s, d, "symbols").where(~F.contains("qualname", F.lit("."))).select(F.col("qualname").alias("name")).distinct()
    return q.withColumn("n", n).where("n > 0").orderBy(F.desc("n"), "name").limit(3)


_RICE = "round(length(subject) * len(coalesce(files, [])) * 0.5 / greatest(0.1, len(coalesce(functions, []))), 3)"


@R.query("tk20_proposals", f"SELECT repo, sha, {_RICE}::DOUBLE AS rice FROM (SELECT DISTINCT repo, sha, subject, files, functions, node_type FROM commit_nodes) WHERE node_type = 'feature' AND subject IS NOT NULL ORDER BY rice DESC, repo, sha LIMIT 40")
def _(s, d):
    """Rows of one status by reach * impact * confidence / effort."""
    from lodestrata.functions.vector import rice

    c = table(s, d, "commit_nodes").where("node_type = 'feature' and subject is not null").select("repo", "sha", "subject", "files", "functions").distinct()
    n = lambda x: F.size(F.coalesce(x, F.array().cast("array<string>"))).cast("double")
    r = rice(F.length("subject").cast("double"), n("files"), F.lit(0.5), n("functions"))
    return c.select("repo", "sha", r.alias("rice")).orderBy(F.desc("rice"), "repo", "sha").limit(40)


@R.query("tk21_hotspots")
def _(s, d):
    """Functions of Python files of complexity 6 and more, the most complex first."""
    f = parse.python_complexity(source(s, d).where(F.col("path").endswith(".py")))
    return f.where("complexity >= 6").orderBy(F.desc("complexity"), "repo", "path", "line", "function")


_LINT = r"(SELECT repo || ':' || path AS target, len(list_filter(string_split(text, chr(10)), lambda x: length(x) > 100))::BIGINT AS n FROM (SELECT DISTINCT repo, path, text FROM source_files))"


@R.query("tk22_selected", f"SELECT target, n FROM (SELECT target, n FROM {_LINT} WHERE n > 0 AND target NOT IN (SELECT repo || ':' || f FROM (SELECT repo, unnest(files) AS f FROM commit_nodes WHERE node_type = 'chore') WHERE f IS NOT NULL) ORDER BY n DESC, target LIMIT 3)")
def _(s, d):
    """The three worst files (lines over 100 characters) that nobody is at work on."""
    n = F.size(F.filter(F.split("text", "\n"), lambda x: F.length(x) > 100)).cast("bigint")
    f = source(s, d).select(F.concat_ws(":", "repo", "path").alias("target"), n.alias("n")).where("n > 0")
    busy = table(s, d, "commit_nodes").where("node_type = 'chore'").select("repo", F.explode("files").alias("f")).where("f is not null").select(F.concat_ws(":", "repo", "f").alias("target")).distinct()
    return f.join(busy, "target", "left_anti").orderBy(F.desc("n"), "target").limit(3)


@R.query("tk26_page", "SELECT file_id FROM (SELECT DISTINCT file_id FROM source_files) ORDER BY file_id LIMIT 100 OFFSET 50")
def _(s, d):
    return lookups.page(table(s, d, "source_files").select("file_id").distinct(), ["file_id"], 5000, 50)


@R.query("wn10_leases", "SELECT event_id, CASE WHEN epoch_us(ts) + (user_id % 40) * 86400 * 1000000 <= epoch_us(TIMESTAMP '2024-01-25') THEN 'expired' ELSE 'valid' END AS state FROM events WHERE user_id IS NOT NULL")
def _(s, d):
    """Leases of as many days as the user's number says, on a given day."""
    e = events(s, d).where("user_id is not null").withColumn("ttl", F.col("user_id") % 40 * 86400)
    return lookups.leases(e, "ts", "ttl", F.lit("2024-01-25").cast("timestamp")).select("event_id", "state")


@R.query("ag21_canaries", r"""WITH k AS (SELECT item_id, list_slice(list_sort(list_distinct(regexp_extract_all(lower(text), '[a-z][a-z0-9_]{3,}'))), 1, 5) AS keys FROM (SELECT DISTINCT item_id, text FROM eval_items)), w AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z][a-z0-9_]{3,}')) AS w FROM documents WHERE text IS NOT NULL),
m AS (SELECT item_id, len(keys) AS n, len(list_filter(keys, lambda x: x IN (SELECT w FROM w))) AS c FROM k) SELECT item_id, c::BIGINT AS matched, n::BIGINT AS expected, c >= 0.6 * n AS ok FROM m""".replace("len(list_filter(keys, lambda x: x IN (SELECT w FROM w))) AS c FROM k)", "(SELECT count(*) FROM (SELECT unnest(keys) AS x) WHERE x IN (SELECT w FROM w)) AS c FROM k)"))
def _(s, d):
    """Canaries with five key words each: how many of them the corpus holds, and whether that is six tenths."""
    k = table(s, d, "eval_items").select("item_id", "text").distinct().select("item_id", F.slice(T.key_tokens(F.col("text")), 1, 5).alias("keys"))
    have = table(s, d, "documents").select(F.explode(T.key_tokens(F.col("text"))).alias("w")).distinct()
    m = k.select("item_id", F.explode("keys").alias("w")).join(have, "w", "left_semi").groupBy("item_id").agg(F.count(F.lit(1)).alias("c"))
    c, n = F.coalesce("c", F.lit(0)).cast("bigint"), F.size("keys").cast("bigint")
    return k.join(m, "item_id", "left").select("item_id", c.alias("matched"), n.alias("expected"), (c >= 0.6 * n).alias("ok"))


@R.query("ag22_utilisation", r"""WITH l AS (SELECT DISTINCT repo, path AS f FROM source_files), a AS (SELECT DISTINCT repo, f FROM (SELECT repo, unnest(files) AS f FROM commit_nodes) WHERE f IS NOT NULL),
n AS (SELECT l.repo, count(*)::BIGINT AS loaded, count(a.f)::BIGINT AS accessed, array_to_string(list_sort(list_distinct(list_filter(list(CASE WHEN a.f IS NULL AND regexp_extract(l.f, '(\.[^./]+)$', 1) <> '' THEN '*' || regexp_extract(l.f, '(\.[^./]+)$', 1) END), lambda x: x IS NOT NULL))), '|') AS x FROM l LEFT JOIN a ON l.repo = a.repo AND l.f = a.f GROUP BY l.repo) SELECT repo, loaded, accessed, round(accessed / loaded, 4) AS utilisation, CASE WHEN round(accessed / loaded, 4) < 0.5 THEN x ELSE '' END AS excluded FROM n""")
def _(s, d):
    """Files scanned against files that commits touched."""
    c = table(s, d, "commit_nodes").select("repo", F.explode("files").alias("path")).where("path is not null")
    return lookups.utilisation(table(s, d, "source_files").select("repo", "path"), c, ["repo"], "path")


@R.query("ax04_satisfied", "WITH n AS (SELECT repo, unnest(['feature', 'bug', 'chore', 'test', 'refactor']) AS need FROM (SELECT DISTINCT repo FROM commit_nodes)), m AS (SELECT n.repo, list_sort(list(need)) AS missing FROM n LEFT JOIN (SELECT DISTINCT repo, node_type FROM commit_nodes) c ON n.repo = c.repo AND n.need = c.node_type WHERE c.repo IS NULL GROUP BY n.repo) SELECT r.repo, coalesce(array_to_string(missing, '|'), '') AS missing, CASE WHEN coalesce(len(missing), 0) = 0 THEN 'Pass' WHEN len(missing) <= 2 THEN 'Needs Fix' ELSE 'Blocked' END AS verdict FROM (SELECT DISTINCT repo FROM commit_nodes) r LEFT JOIN m USING (repo)")
def _(s, d):
    """What a manifest requires (one commit of each type) less what the ledger shows."""
    c = table(s, d, "commit_nodes").select("repo", "node_type").distinct()
    repos = c.select("repo").distinct()
    need = repos.select("repo", F.explode(F.array(*map(F.lit, ("feature", "bug", "chore", "test", "refactor")))).alias("node_type"))
    m = need.join(c, ["repo", "node_type"], "left_anti").groupBy("repo").agg(F.array_sort(F.collect_list("node_type")).alias("m"))
    n = F.coalesce(F.size("m"), F.lit(0))
    return repos.join(m, "repo", "left").select("repo", F.coalesce(F.array_join("m", "|"), F.lit("")).alias("missing"), F.when(F.col("m").isNull() | (n == 0), "Pass").when(n <= 2, "Needs Fix").otherwise("Blocked").alias("verdict"))


_EDGE = ("empty", "timeout", "unicode", "late", "missing", "duplicate")


@R.query("ax06_edge_cases", f"SELECT doc_id, array_to_string(list_filter({list(_EDGE)}, lambda m: contains(lower(text), m)), '|') AS markers FROM documents WHERE text IS NOT NULL")
def _(s, d):
    t = F.lower("text")
    return table(s, d, "documents").where("text is not null").select("doc_id", F.array_join(F.filter(F.array(*map(F.lit, _EDGE)), lambda m: F.contains(t, m)), "|").alias("markers"))


_TASKS = f"WITH {LINES}, t AS (SELECT worker, arg_max(event, (ts, doc_id, pos)) AS state, max(ts) AS news FROM r WHERE worker IS NOT NULL AND ts IS NOT NULL GROUP BY worker)"


def tasks(s, d):
    r = runs(s, d).where("worker is not null and ts is not null")
    return r.groupBy("worker").agg(F.max_by("event", F.struct("ts", "doc_id", "pos")).alias("state"), F.max("ts").alias("news"))


@R.query("ax14_stuck", _TASKS + " SELECT worker, state, news FROM t WHERE state NOT IN ('worker.done', 'worker.stop', 'gate.verdict') AND news < '2026-06-01T00:00:00Z'")
def _(s, d):
    """Tasks whose last news is older than a day and no end."""
    return tasks(s, d).where("state not in ('worker.done', 'worker.stop', 'gate.verdict') and news < '2026-06-01T00:00:00Z'")


@R.query("ax15_task_list", _TASKS + " SELECT worker, state, news FROM t WHERE state = 'worker.start' ORDER BY news DESC, worker LIMIT 100")
def _(s, d):
    return lookups.page(tasks(s, d).where("state = 'worker.start'"), [F.desc("news"), F.col("worker")], 100)


@R.query("ax16_checkpoints", "SELECT repo, branch, count(DISTINCT sha)::BIGINT AS commits, max(mined_at) AS saved_at FROM commit_nodes WHERE branch LIKE 'topic/%' GROUP BY repo, branch")
def _(s, d):
    """Checkpoints of mining by unit (branch), with what they hold."""
    return table(s, d, "commit_nodes").where("branch like 'topic/%'").groupBy("repo", "branch").agg(F.count_distinct("sha").alias("commits"), F.max("mined_at").alias("saved_at"))


_TEMPLATES = (("cache-warm", "ledger cache warm shard"), ("index-build", "index shard build queue"), ("log-scan", "log error queue token"))


@R.query("ax21_templates", "WITH t(template, words) AS (VALUES " + ", ".join(f"('{n}', {w.split()})" for n, w in _TEMPLATES) + r"), q AS (SELECT doc_id, list_distinct(regexp_extract_all(lower(text), '[a-z0-9_][a-z0-9_\-]+')) AS w FROM documents WHERE text IS NOT NULL), n AS (SELECT doc_id, template, len(list_intersect(q.w, t.words)) AS shared FROM q, t), b AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY shared DESC, template) AS i FROM n WHERE shared >= 2) SELECT doc_id, template, shared::BIGINT AS shared FROM b WHERE i = 1")
def _(s, d):
    """The template that shares most words with a text, two at least."""
    t = s.createDataFrame([(n, w.split()) for n, w in _TEMPLATES], "template string, terms array<string>")
    q = table(s, d, "documents").where("text is not null").select("doc_id", T.tokens(F.col("text")).alias("w"))
    return lookups.best_template(q, "doc_id", "w", t, "template", "terms").select("doc_id", "template", "shared")


#: What versions of the language brought.
IDIOMS = (((3, 8), "assignment expressions"), ((3, 9), "generics of built-in types"), ((3, 10), "structural matching"), ((3, 11), "exception groups"), ((3, 12), "type parameters"))


@R.query("prj36_idioms", "WITH r AS (SELECT repo, 7 + (length(repo) % 6) AS minor FROM (SELECT DISTINCT repo FROM source_files)), i(m, idiom) AS (VALUES " + ", ".join(f"({v[1]}, '{t}')" for v, t in IDIOMS) + ") SELECT repo, coalesce(string_agg(idiom, '|' ORDER BY m), '') AS idioms FROM r LEFT JOIN i ON i.m <= r.minor GROUP BY repo")
def _(s, d):
    """What a repository of a language version can use (the version stands for what its settings say)."""
    r = table(s, d, "source_files").select("repo").distinct().withColumn("minor", 7 + F.length("repo") % 6)
    known = F.array(*[F.struct(F.lit(v[1]).alias("m"), F.lit(t).alias("t")) for v, t in IDIOMS])
    return r.select("repo", F.array_join(F.transform(F.filter(known, lambda x: x["m"] <= F.col("minor")), lambda x: x["t"]), "|").alias("idioms"))


@R.query("ax22_styles", rf"SELECT repo, count(*)::BIGINT AS files, round(avg(CASE WHEN contains(text, chr(9)) THEN 1.0 ELSE 0.0 END), 6) AS tabs, round(avg(CASE WHEN contains(text, chr(13)) THEN 1.0 ELSE 0.0 END), 6) AS crlf, round(avg(CASE WHEN regexp_matches(text, '-> [A-Za-z]') THEN 1.0 ELSE 0.0 END), 6) AS annotated FROM (SELECT DISTINCT repo, path, text FROM source_files) WHERE path LIKE '%.py' GROUP BY repo")
def _(s, d):
    """How the Python of a repository is written."""
    share = lambda c: F.round(F.avg(F.when(c, 1.0).otherwise(0.0)), 6)
    t = F.col("text")
    return source(s, d).where(F.col("path").endswith(".py")).groupBy("repo").agg(F.count(F.lit(1)).alias("files"), share(F.contains(t, F.lit("\t"))).alias("tabs"), share(F.contains(t, F.lit("\r"))).alias("crlf"), share(t.rlike("-> [A-Za-z]")).alias("annotated"))


_CAPS = r"""t AS (SELECT DISTINCT repo, sha, subject, unnest(tags) AS tag FROM commit_nodes), c AS (SELECT tag, count(DISTINCT repo || sha)::BIGINT AS n, array_to_string(list_slice(list_sort(list_distinct(list(subject))), 1, 3), '; ') AS examples FROM t WHERE tag IS NOT NULL AND subject IS NOT NULL GROUP BY tag)"""


def capsules(s, d):
    t = table(s, d, "commit_nodes").select("repo", "sha", "subject", F.explode("tags").alias("tag")).where("tag is not null and subject is not null").distinct()
    n = t.groupBy("tag").agg(F.count_distinct("repo", "sha").alias("n"))
    w = Window.partitionBy("tag").orderBy("subject")
    first = t.select("tag", "subject").distinct().withColumn("r", F.row_number().over(w)).where("r <= 3").groupBy("tag").agg(F.array_join(F.array_sort(F.collect_list("subject")), "; ").alias("examples"))
    return n.join(first, "tag")


@R.query("ax23_capsules", f"WITH {_CAPS} SELECT tag, n, examples FROM c")
def _(s, d):
    """A short account of every topic: how many commits, and three of them."""
    return capsules(s, d)


@R.query("ax24_built", f"WITH {_CAPS}, q AS (SELECT unnest(['ledger', 'shard', 'nothing']) AS tag) SELECT q.tag, CASE WHEN c.tag IS NULL THEN 'assembled' WHEN length(examples) > 60 THEN 'shrunk' ELSE 'precomputed' END AS origin, substr(coalesce(examples, 'no topic ' || q.tag), 1, 60) AS body FROM q LEFT JOIN c ON q.tag = c.tag")
def _(s, d):
    """Accounts asked for: those made before, shrunk where too long, others put together on the spot."""
    q = s.createDataFrame([("ledger",), ("shard",), ("nothing",)], "tag string")
    c = capsules(s, d).withColumn("in", F.lit(True))
    origin = F.when(F.col("in").isNull(), "assembled").when(F.length("examples") > 60, "shrunk").otherwise("precomputed")
    return q.join(c, "tag", "left").select("tag", origin.alias("origin"), F.substring(F.coalesce("examples", F.concat(F.lit("no topic "), "tag")), 1, 60).alias("body"))


# Links of graphs.

_FOLLOW = "e AS (SELECT DISTINCT repo || '/' || a AS src, repo || '/' || b AS dst FROM (SELECT repo, unnest(list_zip(files[1:len(files)-1], files[2:len(files)])) AS p FROM commit_nodes WHERE len(files) > 1), LATERAL (SELECT p[1] AS a, p[2] AS b) WHERE a IS NOT NULL AND b IS NOT NULL)"


@R.query("gr09_typed_links", r"""SELECT DISTINCT 'commit:' || sha AS src, 'file:' || repo || '/' || f AS dst, 'references' AS type FROM (SELECT sha, repo, unnest(files) AS f FROM commit_nodes) WHERE f IS NOT NULL AND repo || '/' || f IN (SELECT repo || '/' || path FROM source_files)
UNION SELECT DISTINCT 'file:' || repo || '/' || path, 'dir:' || repo || '/' || regexp_extract(path, '^(.*)/', 1), 'located_in' FROM source_files UNION SELECT DISTINCT 'file:' || repo || '/' || path, 'symbol:' || repo || '/' || path || '::' || qualname, 'defines' FROM symbols WHERE repo || '/' || path IN (SELECT repo || '/' || path FROM source_files)
UNION SELECT DISTINCT 'commit:' || sha, 'type:' || node_type, 'maps_to' FROM commit_nodes""")
def _(s, d):
    """Links by type between commits, files, folders, definitions and kinds; only such whose ends are there."""
    f = table(s, d, "source_files").select("repo", "path", F.concat_ws("/", "repo", "path").alias("id")).distinct()
    c = table(s, d, "commit_nodes")
    link = lambda df, a, b, t: df.select(a.alias("src"), b.alias("dst"), F.lit(t).alias("type"))
    refs = c.select("sha", "repo", F.explode("files").alias("f")).where("f is not null").select("sha", F.concat_ws("/", "repo", "f").alias("id")).join(f.select("id"), "id", "left_semi")
    defs = table(s, d, "symbols").select(F.concat_ws("/", "repo", "path").alias("id"), "qualname").join(f.select("id"), "id", "left_semi")
    at = lambda kind, x: F.concat(F.lit(kind + ":"), x)
    out = link(refs, at("commit", "sha"), at("file", "id"), "references").unionByName(link(f, at("file", "id"), F.concat(F.lit("dir:"), "repo", F.lit("/"), F.regexp_extract("path", "^(.*)/", 1)), "located_in"))
    out = out.unionByName(link(defs, at("file", "id"), F.concat(F.lit("symbol:"), "id", F.lit("::"), "qualname"), "defines")).unionByName(link(c, at("commit", "sha"), at("type", "node_type"), "maps_to"))
    return out.distinct()


@R.query("gr12_bounded_walk", f"WITH {_FOLLOW}, s AS (SELECT DISTINCT src AS node FROM e WHERE src LIKE '%/Makefile'), a AS (SELECT lower(node) AS node, 0 AS hop FROM s UNION ALL SELECT lower(dst), 1 FROM e JOIN s ON src = node UNION ALL SELECT lower(e2.dst), 2 FROM e JOIN s ON src = node JOIN e e2 ON lower(e2.src) = lower(e.dst)) SELECT node, min(hop)::INTEGER AS hop FROM a GROUP BY node")
def _(s, d):
    """Two hops from given notes; nodes count the same in any letter case."""
    from lodestrata.operators import graph

    e = follows(s, d).select(F.lower("src").alias("src"), F.lower("dst").alias("dst")).distinct()
    return graph.within(e, e.where("src like '%/makefile'").select(F.col("src").alias("node")), 2)


@R.query("gr13_one_hop", f"WITH {_FOLLOW}, q AS (SELECT src FROM (SELECT DISTINCT src FROM e WHERE src LIKE '%.py') ORDER BY src LIMIT 5), r AS (SELECT e.src, dst, row_number() OVER (PARTITION BY e.src ORDER BY dst) AS i FROM e JOIN q ON e.src = q.src) SELECT DISTINCT regexp_extract(dst, '([^/]+)$', 1) AS name FROM r WHERE i <= 3")
def _(s, d):
    """The last names of the first three neighbours of the first five files."""
    e = follows(s, d)
    q = e.where(F.col("src").endswith(".py")).select("src").distinct().orderBy("src").limit(5)
    near = search.per_group(e.join(F.broadcast(q), "src"), ["src"], [F.col("dst")], 3)
    return near.select(F.regexp_extract("dst", r"([^/]+)$", 1).alias("name")).distinct()


@R.query("gr16_module_links", f"WITH {_FOLLOW}, m AS (SELECT repo || '/' || path AS id, row_number() OVER (PARTITION BY repo ORDER BY path) AS i FROM (SELECT DISTINCT repo, path FROM source_files)), k AS (SELECT id FROM m WHERE i <= 10) SELECT src, dst FROM e WHERE src IN (SELECT id FROM k) AND dst IN (SELECT id FROM k)")
def _(s, d):
    """Links among the first ten modules of every shard: the cap is the feature."""
    f = table(s, d, "source_files").select("repo", "path").distinct()
    k = search.per_group(f, ["repo"], [F.col("path")], 10).select(F.concat_ws("/", "repo", "path").alias("id"))
    e = follows(s, d)
    return e.join(k.withColumnRenamed("id", "src"), "src", "left_semi").join(k.withColumnRenamed("id", "dst"), "dst", "left_semi").select("src", "dst")


@R.query("gr17_pointers", "WITH o AS (SELECT name, min(repo) AS r FROM (SELECT DISTINCT repo, split_part(qualname, '.', 1) AS name FROM symbols) GROUP BY name HAVING count(*) = 1), u AS (SELECT DISTINCT repo, unnest(regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_]*')) AS name FROM source_files) SELECT 'repo:' || u.repo AS source, 'repo:' || o.r AS target, 'mentions' AS type, count(*)::BIGINT AS count FROM u JOIN o USING (name) WHERE u.repo <> o.r GROUP BY ALL")
def _(s, d):
    """Links between repositories: how many names that one repository alone defines another one mentions."""
    owners = table(s, d, "symbols").select("repo", F.substring_index("qualname", ".", 1).alias("name"))
    names = F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit("[A-Za-z_][A-Za-z0-9_]*"), F.lit(0))))
    uses = table(s, d, "source_files").select("repo", names.alias("name")).distinct().withColumn("file", F.col("name"))
    e = joins.ownership(uses, owners, "name")
    return e.select(F.concat(F.lit("repo:"), "from_repo").alias("source"), F.concat(F.lit("repo:"), "to_repo").alias("target"), F.lit("mentions").alias("type"), F.col("uses").alias("count"))


@R.query("gr18_shard", "SELECT path, count(DISTINCT qualname)::BIGINT AS symbols FROM symbols WHERE repo = (SELECT min(repo) FROM symbols) GROUP BY path")
def _(s, d):
    """One repository's shard out of a table partitioned by repository: of the others nothing is read."""
    from lodestrata.runtime import shared_path
    from lodestrata.sources.files import write_partitioned

    sy, at = table(s, d, "symbols").select("repo", "path", "qualname"), shared_path(s, "shards")
    write_partitioned(sy, at, ["repo"])
    first = sy.agg(F.min("repo")).first()[0]
    return s.read.schema(sy.schema).parquet(at).where(F.col("repo") == F.lit(first)).groupBy("path").agg(F.count_distinct("qualname").alias("symbols"))


@R.query("tk05_index_search", "WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings), q AS (SELECT x AS y FROM v ORDER BY vec_id LIMIT 1) SELECT vec_id, round(list_cosine_similarity(x, y), 6) AS score FROM v, q ORDER BY score DESC, vec_id LIMIT 10")
def _(s, d):
    """Nearest vectors through an index of random planes: near buckets first, by exact scores, until no bucket left can hold a better one."""
    from lodestrata.operators.planes import search as by_planes

    v = table(s, d, "embeddings").select("vec_id", "embedding")
    q = first_vector(v, "vec_id", "embedding")
    return by_planes(v, "vec_id", "embedding", q, 10)
