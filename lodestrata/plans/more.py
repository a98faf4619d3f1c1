"""Further queries: predicates, tags, roll-ups, lookups, index builds."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lodestrata.functions import embed
from lodestrata.functions import rules as U
from lodestrata.functions import text as T
from lodestrata.plans.graphs import _EDGES, follows
from lodestrata.plans.registry import Registry
from lodestrata.runtime import table

R = Registry()
_FILES = "(SELECT repo, path, min(text) AS text FROM source_files GROUP BY repo, path)"


def files(s, d):
    return table(s, d, "source_files").groupBy("repo", "path").agg(F.min("text").alias("text"))


def _rules(c: str, rules, default: str = "other") -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({c}, '{p}') THEN '{n}'" for n, p in rules) + f" ELSE '{default}' END"


_PRED = rf"regexp_matches(lower(path), '{U.SENSITIVE_PATH}')"
_EXCL = "len(list_intersect(string_split(path, '/'), ['" + "','".join(U.EXCLUDED) + "'])) > 0"


@R.query("prj01_predicates", f"SELECT repo, path, {_PRED} AS sensitive, (contains(lower(path), '.git/') OR contains(lower(path), 'node_modules/') OR contains(lower(path), '../')) AS forbidden, {_EXCL} AS excluded, instr(substr(text, 1, 512), chr(0)) > 0 AS binary_, contains(substr(text, 1, 64), 'PRIVATE KEY') AS key_head FROM {_FILES}")
def _(s, d):
    p = F.col("path")
    return files(s, d).select("repo", "path", U.sensitive_path(p).alias("sensitive"), U.forbidden_path(p).alias("forbidden"), U.excluded(p).alias("excluded"), U.binary_text(F.col("text")).alias("binary_"), F.contains(F.substring("text", 1, 64), F.lit("PRIVATE KEY")).alias("key_head"))


@R.query("ag03_skip_reasons", f"SELECT CASE WHEN {_PRED} THEN 'sensitive' WHEN length(text) = 0 THEN 'empty' WHEN strlen(text) > 16384 THEN 'too_large' WHEN {_EXCL} THEN 'excluded' ELSE 'kept' END AS reason, count(*)::BIGINT AS n FROM {_FILES} GROUP BY 1")
def _(s, d):
    p = F.col("path")
    reason = F.when(U.sensitive_path(p), "sensitive").when(F.length("text") == 0, "empty").when(F.octet_length("text") > 16384, "too_large").when(U.excluded(p), "excluded").otherwise("kept")
    return files(s, d).groupBy(reason.alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@R.query("ag04_artifacts", f"SELECT repo, {_rules('path', U.ARTIFACTS)} AS artifact, count(*)::BIGINT AS n FROM {_FILES} GROUP BY ALL")
def _(s, d):
    return files(s, d).groupBy("repo", U.first_rule(F.col("path"), U.ARTIFACTS).alias("artifact")).agg(F.count(F.lit(1)).alias("n"))


@R.query("prj30_tags", "SELECT repo, path, array_to_string(list_sort(list_filter([" + ", ".join(f"CASE WHEN regexp_matches(path, '{p}') THEN '{n}' END" for n, p in U.ARTIFACTS) + f", CASE WHEN strlen(text) > 8192 THEN 'large' END, CASE WHEN strlen(text) = 0 THEN 'empty' END], lambda x: x IS NOT NULL)), '|') AS tags FROM {_FILES}")
def _(s, d):
    return files(s, d).select("repo", "path", F.array_join(U.tags(F.col("path"), F.octet_length("text")), "|").alias("tags"))


@R.query("prj31_purposes", f"SELECT repo, regexp_extract(path, '^(.*)/', 1) AS dir, {_rules('lower(min(path))', U.PURPOSES)} AS purpose, count(*)::BIGINT AS n FROM {_FILES} GROUP BY repo, 2")
def _(s, d):
    g = files(s, d).groupBy("repo", F.regexp_extract("path", "^(.*)/", 1).alias("dir")).agg(F.min("path").alias("p"), F.count(F.lit(1)).alias("n"))
    return g.select("repo", "dir", U.first_rule(F.lower("p"), U.PURPOSES).alias("purpose"), "n")


@R.query("ag02_reuse_candidates", f"SELECT repo, regexp_extract(path, '^([^/]*)', 1) AS feature, count(*)::BIGINT AS files, CASE WHEN count(*) >= 10 AND count_if(regexp_matches(path, 'tests?/')) > 0 THEN 'high' WHEN count(*) >= 5 THEN 'medium' ELSE 'low' END AS confidence FROM {_FILES} GROUP BY ALL")
def _(s, d):
    n = F.count(F.lit(1))
    conf = F.when((n >= 10) & (F.count_if(F.col("path").rlike("tests?/")) > 0), "high").when(n >= 5, "medium").otherwise("low")
    return files(s, d).groupBy("repo", F.regexp_extract("path", "^([^/]*)", 1).alias("feature")).agg(n.alias("files"), conf.alias("confidence"))


@R.query("ag16_violations", f"SELECT repo, path, count(*)::BIGINT AS n FROM (SELECT repo, path, unnest(string_split(text, chr(10))) AS l FROM {_FILES}) WHERE length(l) > 120 OR regexp_matches(l, '[ \\t]$') GROUP BY repo, path".replace("\\\\t", "\\t"))
def _(s, d):
    lines = files(s, d).select("repo", "path", F.explode(F.split("text", "\n")).alias("l"))
    return lines.where((F.length("l") > 120) | F.col("l").rlike(r"[ \t]\z")).groupBy("repo", "path").agg(F.count(F.lit(1)).alias("n"))


@R.query("ag23_symbol_counts", "SELECT repo, count(*)::BIGINT AS n, count_if(kind = 'class')::BIGINT AS classes, count_if(kind = 'method')::BIGINT AS methods, count(DISTINCT path)::BIGINT AS files FROM (SELECT DISTINCT repo, path, qualname, start_line, kind FROM symbols) GROUP BY repo")
def _(s, d):
    x = table(s, d, "symbols").select("repo", "path", "qualname", "start_line", "kind").distinct()
    return x.groupBy("repo").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("kind") == "class").alias("classes"), F.count_if(F.col("kind") == "method").alias("methods"), F.count_distinct("path").alias("files"))


@R.query("ag24_touched_repos", r"SELECT DISTINCT d.doc_id, r.repo FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[a-z]+')) AS name FROM documents WHERE text IS NOT NULL AND fmt = 'log') d JOIN (SELECT DISTINCT repo, split_part(repo, '-', 1) AS name FROM source_files) r USING (name)")
def _(s, d):
    """Repositories whose first name a log mentions."""
    logs = table(s, d, "documents").where("fmt = 'log'").select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit("[a-z]+"), F.lit(0)))).alias("name"))
    repos = table(s, d, "source_files").select("repo", F.split_part("repo", F.lit("-"), F.lit(1)).alias("name")).distinct()
    return logs.join(repos, "name").select("doc_id", "repo").distinct()


@R.query("ag25_mining_summary", "WITH c AS (SELECT repo, sha, min(author) AS author, min(committed_at) AS done, max(coalesce(len(functions), 0)) AS f FROM commit_nodes GROUP BY repo, sha) SELECT repo, count(*)::BIGINT AS commits, count(DISTINCT author)::BIGINT AS authors, min(done) AS first_at, max(done) AS last_at, count_if(f > 0)::BIGINT AS linked FROM c GROUP BY repo")
def _(s, d):
    c = table(s, d, "commit_nodes").groupBy("repo", "sha").agg(F.min("author").alias("author"), F.min("committed_at").alias("at"), F.max(F.coalesce(F.size("functions"), F.lit(0))).alias("f"))
    return c.groupBy("repo").agg(F.count(F.lit(1)).alias("commits"), F.count_distinct("author").alias("authors"), F.min("at").alias("first_at"), F.max("at").alias("last_at"), F.count_if(F.col("f") > 0).alias("linked"))


@R.query("ag27_most_frequent", "SELECT author, count(DISTINCT sha)::BIGINT AS n FROM commit_nodes WHERE author IS NOT NULL GROUP BY author ORDER BY n DESC, author LIMIT 20")
def _(s, d):
    return table(s, d, "commit_nodes").where("author is not null").select("author", "sha").distinct().groupBy("author").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "author").limit(20)


@R.query("ag11_source_counts", "SELECT lower(trim(source)) AS source, count(*)::BIGINT AS n, sum(length(text))::BIGINT AS chars FROM documents GROUP BY 1")
def _(s, d):
    return table(s, d, "documents").groupBy(F.lower(F.trim("source")).alias("source")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars"))


@R.query("prj24_path_type", "SELECT DISTINCT repo, sha, CASE WHEN len(f) = 0 THEN 'unknown' WHEN len(list_filter(f, lambda x: regexp_matches(x, '(^|/)tests?/'))) > 0 THEN 'test' WHEN len(list_filter(f, lambda x: regexp_matches(x, '[.]md$'))) = len(f) THEN 'chore' WHEN len(list_filter(f, lambda x: regexp_matches(x, '[.](py|js)$'))) > 0 THEN 'feature' ELSE 'unknown' END AS path_type FROM (SELECT repo, sha, list_filter(coalesce(files, []), lambda x: x IS NOT NULL) AS f FROM commit_nodes)")
def _(s, d):
    f = F.filter(F.coalesce("files", F.array().cast("array<string>")), lambda x: x.isNotNull())
    kind = (
        F.when(F.size("f") == 0, "unknown").when(F.exists("f", lambda x: x.rlike(r"(^|/)tests?/")), "test")
        .when(F.forall("f", lambda x: x.rlike(r"[.]md\z")), "chore").when(F.exists("f", lambda x: x.rlike(r"[.](py|js)\z")), "feature").otherwise("unknown")
    )
    return table(s, d, "commit_nodes").select("repo", "sha", f.alias("f")).select("repo", "sha", kind.alias("path_type")).distinct()


@R.query("prj27_sections", r"SELECT doc_id, i::BIGINT AS part, trim(regexp_extract(p, '^([^\r\n]*)', 1)) AS title, length(p)::BIGINT AS chars FROM (SELECT doc_id, unnest(regexp_split_to_array(text, '(?:^|\n)## +')) AS p, generate_subscripts(regexp_split_to_array(text, '(?:^|\n)## +'), 1) - 1 AS i FROM documents WHERE text IS NOT NULL AND fmt = 'markdown') WHERE i > 0")
def _(s, d):
    m = table(s, d, "documents").where("text is not null and fmt = 'markdown'")
    p = m.select("doc_id", F.posexplode(F.split("text", r"(?:^|\n)## +")).alias("part", "p")).where("part > 0")
    return p.select("doc_id", F.col("part").cast("bigint").alias("part"), F.trim(F.regexp_extract("p", r"^([^\r\n]*)", 1)).alias("title"), F.length("p").cast("bigint").alias("chars"))


@R.query("prj35_byte_spans", "SELECT DISTINCT c.chunk_id, encode(f.text)[c.start_byte + 1 : c.end_byte] = encode(c.text) AS holds FROM chunks c JOIN (SELECT repo, path, min(text) AS text FROM source_files GROUP BY repo, path) f USING (repo, path) WHERE c.end_byte IS NOT NULL")
def _(s, d):
    c = table(s, d, "chunks").where("end_byte is not null").select("chunk_id", "repo", "path", "start_byte", "end_byte", F.col("text").alias("piece"))
    raw = F.encode("text", "UTF-8")
    got = F.substring(raw, (F.col("start_byte") + 1).cast("int"), (F.col("end_byte") - F.col("start_byte")).cast("int"))
    return c.join(files(s, d), ["repo", "path"]).select("chunk_id", (got == F.encode("piece", "UTF-8")).alias("holds")).distinct()


@R.query("prj38_quarantine", "SELECT doc_id, CASE WHEN length(trim(text)) BETWEEN 20 AND 600 THEN 'kept' ELSE 'quarantine' END AS state, substr(text, 1, 100) AS claim FROM documents WHERE text IS NOT NULL")
def _(s, d):
    n = F.length(F.trim("text"))
    return table(s, d, "documents").where("text is not null").select("doc_id", F.when(n.between(20, 600), "kept").otherwise("quarantine").alias("state"), F.substring("text", 1, 100).alias("claim"))


@R.query("prj33_types", "SELECT event_id, json_type(props, '$.k') = 'UBIGINT' OR json_type(props, '$.k') = 'BIGINT' AS k_is_integer FROM events")
def _(s, d):
    v = F.get_json_object("props", "$.k")
    return table(s, d, "events").select("event_id", v.rlike(r"^-?[0-9]+\z").alias("k_is_integer"))


@R.query("jn10_shares_word", r"SELECT DISTINCT doc_id FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9_][a-z0-9_\-]+')) AS w FROM documents WHERE text IS NOT NULL) WHERE w IN (SELECT unnest(regexp_extract_all(lower(subject), '[a-z0-9_][a-z0-9_\-]+')) FROM commit_nodes WHERE scope = 'ledger')")
def _(s, d):
    words = table(s, d, "commit_nodes").where("scope = 'ledger'").select(F.explode(T.tokens(F.col("subject"))).alias("w")).distinct()
    return table(s, d, "documents").select("doc_id", F.explode(F.array_distinct(T.tokens(F.col("text")))).alias("w")).join(words, "w", "left_semi").select("doc_id").distinct()


@R.query("jn15_both_ways", "SELECT path, 'only_chunks' AS side FROM (SELECT DISTINCT repo || ':' || path AS path FROM chunks EXCEPT SELECT DISTINCT repo || ':' || path FROM vector_records) UNION ALL SELECT path, 'only_vectors' FROM (SELECT DISTINCT repo || ':' || path AS path FROM vector_records EXCEPT SELECT DISTINCT repo || ':' || path FROM chunks)")
def _(s, d):
    a, b = (table(s, d, t).select(F.concat_ws(":", "repo", "path").alias("path")).distinct() for t in ("chunks", "vector_records"))
    return a.join(b, "path", "left_anti").withColumn("side", F.lit("only_chunks")).unionByName(b.join(a, "path", "left_anti").withColumn("side", F.lit("only_vectors")))


@R.query("jn16_phrases", r"WITH a AS (SELECT DISTINCT scope AS phrase FROM commit_nodes WHERE scope <> '') SELECT DISTINCT doc_id, phrase FROM documents JOIN a ON regexp_matches(lower(text), '(^|[^a-z0-9_-])' || phrase || '([^a-z0-9_-]|$)') WHERE text IS NOT NULL")
def _(s, d):
    """Phrases found in texts with word borders: phrases are words here, so the theta join is an equi-join on words."""
    a = table(s, d, "commit_nodes").where("scope <> ''").select(F.col("scope").alias("phrase")).distinct()
    words = table(s, d, "documents").select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9_-]+"), F.lit(0)))).alias("phrase"))
    return words.join(a, "phrase").select("doc_id", "phrase").distinct()


@R.query("jn19_two_hops", "SELECT DISTINCT v.vec_id, s.qualname FROM vector_records v JOIN source_files f ON v.repo = f.repo AND v.path = f.path JOIN (SELECT DISTINCT repo, path, qualname FROM symbols WHERE kind = 'class') s ON s.repo = f.repo AND s.path = f.path")
def _(s, d):
    sy = table(s, d, "symbols").where("kind = 'class'").select("repo", "path", "qualname").distinct()
    v = table(s, d, "vector_records").select("vec_id", "repo", "path").distinct()
    return v.join(files(s, d).select("repo", "path"), ["repo", "path"], "left_semi").join(sy, ["repo", "path"]).select("vec_id", "qualname")


@R.query("jn20_first_repo", "SELECT sha, arg_min(repo, (mined_at, repo)) AS repo FROM commit_nodes GROUP BY sha")
def _(s, d):
    return table(s, d, "commit_nodes").groupBy("sha").agg(F.min_by("repo", F.struct("mined_at", "repo")).alias("repo"))


@R.query("jn24_dirty", "SELECT DISTINCT v.vec_id FROM vector_records v JOIN (SELECT DISTINCT repo, unnest(files) AS path FROM commit_nodes WHERE node_type = 'bug') c ON v.repo = c.repo AND v.path = c.path")
def _(s, d):
    c = table(s, d, "commit_nodes").where("node_type = 'bug'").select("repo", F.explode("files").alias("path")).distinct()
    return table(s, d, "vector_records").select("vec_id", "repo", "path").join(c, ["repo", "path"], "left_semi").select("vec_id").distinct()


@R.query("st02_posting_lists", r"SELECT term, (doc_id // 1024)::BIGINT AS block, array_to_string(list_sort(list(DISTINCT doc_id))::VARCHAR[], ',') AS docs FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9_][a-z0-9_\-]+')) AS term FROM documents WHERE text IS NOT NULL) GROUP BY ALL")
def _(s, d):
    """Sorted distinct posting lists in blocks of ids, so that a word of all documents fills no single row."""
    w = table(s, d, "documents").select("doc_id", F.explode(F.array_distinct(T.tokens(F.col("text")))).alias("term"))
    g = w.groupBy("term", F.floor(F.col("doc_id") / 1024).alias("block")).agg(F.array_sort(F.collect_set("doc_id")).alias("ids"))
    return g.select("term", "block", F.array_join(F.transform("ids", lambda x: x.cast("string")), ",").alias("docs"))


@R.query("st11_append_new", "SELECT head, min(doc_id) AS first_doc, count(*)::BIGINT AS n FROM (SELECT substr(text, 1, 80) AS head, doc_id FROM documents WHERE text IS NOT NULL) WHERE head NOT IN (SELECT substr(text, 1, 80) FROM eval_items) GROUP BY head")
def _(s, d):
    """Entries by their first 80 characters that a list does not hold yet, each once."""
    h = table(s, d, "documents").where("text is not null").select(F.substring("text", 1, 80).alias("head"), "doc_id")
    have = table(s, d, "eval_items").select(F.substring("text", 1, 80).alias("head")).distinct()
    return h.join(have, "head", "left_anti").groupBy("head").agg(F.min("doc_id").alias("first_doc"), F.count(F.lit(1)).alias("n"))


@R.query("tk18_fuzzy", "WITH n AS (SELECT DISTINCT regexp_extract(qualname, '[^.]*$') AS name FROM symbols), m AS (SELECT name, CASE WHEN name = 'read_ledger' THEN 0 WHEN lower(name) = 'read_ledger' THEN 1 WHEN regexp_replace(lower(name), '[^a-z0-9]', '', 'g') = 'readledger' THEN 2 WHEN contains(lower(name), 'ledger') AND contains(lower(name), 'read') THEN 3 WHEN contains(lower(name), 'ledger') THEN 4 END AS tier FROM n) SELECT name, tier::INTEGER AS tier FROM m WHERE tier IS NOT NULL ORDER BY tier, name LIMIT 10")
def _(s, d):
    """A name sought by a ladder: as it is, in one case, without signs, by all its words, by one of them."""
    low = F.lower("name")
    tier = F.when(F.col("name") == "read_ledger", 0).when(low == "read_ledger", 1).when(F.regexp_replace(low, "[^a-z0-9]", "") == "readledger", 2).when(F.contains(low, F.lit("ledger")) & F.contains(low, F.lit("read")), 3).when(F.contains(low, F.lit("ledger")), 4)
    n = table(s, d, "symbols").select(F.regexp_extract("qualname", r"([^.]*)$", 1).alias("name")).distinct()
    return n.select("name", tier.alias("tier")).where("tier is not null").orderBy("tier", "name").limit(10)


@R.query("tk25_newest", "SELECT sha, repo FROM (SELECT sha, repo, row_number() OVER (PARTITION BY repo ORDER BY done DESC, sha) AS i FROM (SELECT repo, sha, max(committed_at) AS done FROM commit_nodes GROUP BY repo, sha)) WHERE i <= 15")
def _(s, d):
    """The newest 15 commits of every repository: what an eviction keeps."""
    c = table(s, d, "commit_nodes").groupBy("repo", "sha").agg(F.max("committed_at").alias("at"))
    w = Window.partitionBy("repo").orderBy(F.desc("at"), "sha")
    return c.withColumn("i", F.row_number().over(w)).where("i <= 15").select("sha", "repo")


@R.query("gr07_base_rank", f"WITH {_EDGES}, d AS (SELECT node, count(*) AS degree FROM (SELECT src AS node FROM e UNION ALL SELECT dst FROM e) GROUP BY node) SELECT node, round(degree + len(regexp_extract_all(node, '[a-z]+')) / 100.0, 6)::DOUBLE AS base_rank FROM d")
def _(s, d):
    from lodestrata.operators.graph import degrees

    words = F.size(F.regexp_extract_all("node", F.lit("[a-z]+"), F.lit(0)))
    return degrees(follows(s, d)).select("node", F.round(F.col("degree") + words / F.lit(100.0), 6).alias("base_rank"))


@R.query("gr08_capped_nodes", "WITH n AS (SELECT DISTINCT repo, 'file' AS type, path AS id FROM source_files UNION SELECT DISTINCT repo, 'dir', regexp_extract(path, '^(.*)/', 1) FROM source_files WHERE path LIKE '%/%'), r AS (SELECT *, row_number() OVER (PARTITION BY repo, type ORDER BY id) AS i FROM n) SELECT repo, type, id FROM r WHERE i <= CASE type WHEN 'file' THEN 20 ELSE 10 END")
def _(s, d):
    f = table(s, d, "source_files").select("repo", "path").distinct()
    n = f.select("repo", F.lit("file").alias("type"), F.col("path").alias("id")).unionByName(f.where("path like '%/%'").select("repo", F.lit("dir").alias("type"), F.regexp_extract("path", "^(.*)/", 1).alias("id")).distinct())
    w = Window.partitionBy("repo", "type").orderBy("id")
    return n.withColumn("i", F.row_number().over(w)).where(F.col("i") <= F.when(F.col("type") == "file", 20).otherwise(10)).select("repo", "type", "id")


@R.query("gr15_name_links", "WITH s AS (SELECT DISTINCT repo, path, qualname, start_line, regexp_extract(qualname, '[^.]*$') AS name FROM symbols) SELECT repo, name, arg_min(qualname, (path, start_line, qualname)) AS first_def, count(*)::BIGINT AS n FROM s GROUP BY repo, name")
def _(s, d):
    x = table(s, d, "symbols").select("repo", "path", "qualname", "start_line").distinct()
    return x.groupBy("repo", F.regexp_extract("qualname", r"([^.]*)$", 1).alias("name")).agg(F.min_by("qualname", F.struct("path", "start_line", "qualname")).alias("first_def"), F.count(F.lit(1)).alias("n"))


@R.query("sc10_node_names", r"SELECT DISTINCT qualname, regexp_replace(regexp_replace(lower(qualname), '[_.\-]+', ' ', 'g'), '[^a-z0-9 ]', '', 'g') AS name FROM symbols")
def _(s, d):
    return table(s, d, "symbols").select("qualname", F.regexp_replace(F.regexp_replace(F.lower("qualname"), r"[_.\-]+", " "), "[^a-z0-9 ]", "").alias("name")).distinct()


@R.query("sc40_label_counts", "SELECT doc_id, " + ", ".join(f"((length(lower(text)) - length(replace(lower(text), '{w}', ''))) // {len(w)})::BIGINT AS n_{w}" for w in ("error", "ledger", "token")) + " FROM documents WHERE text IS NOT NULL")
def _(s, d):
    return table(s, d, "documents").where("text is not null").select("doc_id", *[T.occurrences(F.col("text"), w).alias(f"n_{w}") for w in ("error", "ledger", "token")])


@R.query("sc57_sanitised", r"SELECT DISTINCT repo, sha, trim(regexp_replace(regexp_replace(subject, '[^A-Za-z0-9_ ]+|\b(AND|OR|NOT|NEAR)\b', ' ', 'g'), ' +', ' ', 'g')) AS query FROM commit_nodes")
def _(s, d):
    return table(s, d, "commit_nodes").select("repo", "sha", U.match_sanitised(F.col("subject")).alias("query")).distinct()


@R.query("sc48_features", r"SELECT repo, path, concat_ws('|', CASE WHEN regexp_matches(lower(path), 'ledger') THEN 'ledger' END, CASE WHEN regexp_matches(lower(path), 'index|lookup') THEN 'search' END, CASE WHEN regexp_matches(lower(path), 'queue|worker') THEN 'work' END) AS features FROM " + _FILES)
def _(s, d):
    low = F.lower("path")
    return files(s, d).select("repo", "path", F.concat_ws("|", F.when(low.rlike("ledger"), "ledger"), F.when(low.rlike("index|lookup"), "search"), F.when(low.rlike("queue|worker"), "work")).alias("features"))


@R.query("prj25_wikilinks", r"SELECT doc_id, array_to_string(list_sort(list_distinct(list_filter(list_transform(regexp_extract_all(text, '\[\[([^\]\n]+)\]\]', 1), lambda x: trim(regexp_replace(x, '[|#^].*$', ''))), lambda x: x <> ''))), '|') AS links FROM documents WHERE text IS NOT NULL")
def _(s, d):
    return table(s, d, "documents").where("text is not null").select("doc_id", F.array_join(U.wikilinks(F.col("text")), "|").alias("links"))


@R.query("ax13_task_ids", r"SELECT DISTINCT repo, sha, substr(regexp_replace(regexp_replace(lower(subject), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 40) || '-' || substr(sha1(repo || '|' || subject), 1, 10) AS task FROM commit_nodes")
def _(s, d):
    c = F.col("subject")
    return table(s, d, "commit_nodes").select("repo", "sha", F.concat_ws("-", T.slug(c, 40), F.substring(F.sha1(F.concat_ws("|", "repo", c)), 1, 10)).alias("task")).distinct()


@R.query("ax03_health_row", "SELECT (SELECT count(DISTINCT file_id) FROM source_files)::BIGINT AS files, (SELECT count(DISTINCT chunk_id) FROM chunks)::BIGINT AS chunks, (SELECT count(DISTINCT vec_id) FROM vector_records)::BIGINT AS vectors, (SELECT count(DISTINCT repo || sha) FROM commit_nodes)::BIGINT AS commits, (SELECT count(*) FROM events WHERE event_type = 'error')::BIGINT AS errors")
def _(s, d):
    one = [
        table(s, d, "source_files").agg(F.count_distinct("file_id").alias("files")), table(s, d, "chunks").agg(F.count_distinct("chunk_id").alias("chunks")),
        table(s, d, "vector_records").agg(F.count_distinct("vec_id").alias("vectors")), table(s, d, "commit_nodes").agg(F.count_distinct(F.concat("repo", "sha")).alias("commits")),
        table(s, d, "events").where("event_type = 'error'").agg(F.count(F.lit(1)).alias("errors")),
    ]
    out = one[0]
    for x in one[1:]:
        out = out.join(F.broadcast(x))  # one row each
    return out


@R.query("ud01_embed")
def _(s, d):
    return table(s, d, "documents").select("doc_id", embed.embedder(64)(F.col("text")).alias("vector"))
