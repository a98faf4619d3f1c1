"""Queries of scalar functions on text."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestrata.functions import text as T
from lodestrata.functions import vector as V
from lodestrata.operators import parse, sets
from lodestrata.plans.registry import Registry
from lodestrata.runtime import table

R = Registry()
_DOCS = "documents WHERE text IS NOT NULL"
_TOK = r"regexp_extract_all(lower(text), '[a-z0-9_][a-z0-9_\-]+')"


def docs(s, d):
    return table(s, d, "documents").where(F.col("text").isNotNull())


@R.query("sc01_tokens", f"SELECT doc_id, len({_TOK})::BIGINT AS n_tokens, len(list_distinct({_TOK}))::BIGINT AS n_distinct FROM {_DOCS}")
def _(s, d):
    t = T.tokens(F.col("text"))
    return docs(s, d).select("doc_id", F.size(t).cast("bigint").alias("n_tokens"), F.size(F.array_distinct(t)).cast("bigint").alias("n_distinct"))


@R.query("sc04_path_tokens", rf"SELECT doc_id, len(list_filter(regexp_extract_all(text, '[A-Za-z0-9_./-]+'), lambda x: length(x) > 1))::BIGINT AS n FROM {_DOCS}")
def _(s, d):
    return docs(s, d).select("doc_id", F.size(T.path_tokens(F.col("text"))).cast("bigint").alias("n"))


@R.query("sc05_key_tokens", rf"SELECT doc_id, array_to_string(list_sort(list_distinct(regexp_extract_all(lower(text), '[a-z][a-z0-9_]{{3,}}'))), '|') AS words FROM {_DOCS}")
def _(s, d):
    return docs(s, d).select("doc_id", F.array_join(T.key_tokens(F.col("text")), "|").alias("words"))


@R.query(
    "sc06_sub_tokens",
    "SELECT DISTINCT q AS name, array_to_string(list_sort(list_distinct(list_concat(list_concat([lower(q)], list_filter(string_split(lower(q), '_'), lambda x: x <> '')), list_transform(regexp_extract_all(q, '[A-Z][a-z]*|[a-z]+|[0-9]+'), lambda x: lower(x))))), '|') AS parts FROM (SELECT DISTINCT regexp_extract(qualname, '[^.]*$') AS q FROM symbols)",
)
def _(s, d):
    q = table(s, d, "symbols").select(F.regexp_extract("qualname", r"([^.]*)$", 1).alias("name")).distinct()
    return q.select("name", F.array_join(T.sub_tokens(F.col("name")), "|").alias("parts"))


@R.query("sc07_alias_slug", r"SELECT DISTINCT repo, sha, regexp_replace(lower(trim(subject)), '[\s\-]+', '_', 'g') AS alias, coalesce(nullif(substr(regexp_replace(regexp_replace(lower(subject), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 60), ''), 'unknown') AS slug FROM commit_nodes")
def _(s, d):
    c = F.col("subject")
    return table(s, d, "commit_nodes").select("repo", "sha", T.alias_form(c).alias("alias"), T.slug(c, empty="unknown").alias("slug")).distinct()


@R.query("sc12_hashes", rf"SELECT doc_id, sha256(text) AS sha, 'clm_' || substr(sha256(lower(trim(text))), 1, 8) AS claim, sha256(regexp_replace(lower(trim(text)), '\s+', ' ', 'g')) AS query_key FROM {_DOCS} ")
def _(s, d):
    c = F.col("text")
    return docs(s, d).select("doc_id", F.sha2(c, 256).alias("sha"), T.claim_id(c).alias("claim"), T.query_key(c).alias("query_key"))


_STOP = "['the','and','for','with','that','this','from','into','are','was','you','please']"


@R.query("sc19_signature", rf"SELECT doc_id, substr(sha1(array_to_string(list_sort(list_filter(list_distinct({_TOK}), lambda x: length(x) >= 3 AND NOT list_contains({_STOP}, x)))[1:24], ' ')), 1, 16) AS signature FROM {_DOCS}")
def _(s, d):
    return docs(s, d).select("doc_id", T.signature(F.col("text")).alias("signature"))


@R.query("sc21_fingerprint", rf"SELECT doc_id, substr(sha1(concat_ws('|', source, repo, substr(regexp_replace(text, '[0-9]+', '#', 'g'), 1, 300))), 1, 16) AS fingerprint FROM {_DOCS}")
def _(s, d):
    return docs(s, d).select("doc_id", T.fingerprint(F.col("source"), F.col("repo"), F.col("text")).alias("fingerprint"))


@R.query("sc22_template", rf"SELECT doc_id, sha256(regexp_replace(text, '0x[0-9a-fA-F]+|[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}[T ][0-9:.]+Z?|[0-9a-f]{{8}}-[0-9a-f]{{4}}-[0-9a-f]{{4}}-[0-9a-f]{{4}}-[0-9a-f]{{12}}|[0-9]+', '<LITERAL>', 'g')) AS template FROM {_DOCS}")
def _(s, d):
    return docs(s, d).select("doc_id", F.sha2(T.template(F.col("text")), 256).alias("template"))


def _case(column: str, rules, default: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches(lower({column}), '{p}') THEN '{label}'" for label, p in rules) + f" ELSE '{default}' END"


@R.query("sc25_severity_intent", f"SELECT doc_id, {_case('text', T.SEVERITY, 'low')} AS severity, {_case('text', T.INTENTS, 'other')} AS intent, CASE WHEN contains(text, '?') THEN 'interrogation' WHEN regexp_matches(lower(text), '^[^a-z]*(add|build|create|fix|implement|remove|write|rename)') THEN 'action' ELSE 'interrogation' END AS track FROM {_DOCS}")
def _(s, d):
    c = F.col("text")
    track = F.when(F.contains(c, F.lit("?")), "interrogation").when(F.lower(c).rlike("^[^a-z]*(add|build|create|fix|implement|remove|write|rename)"), "action").otherwise("interrogation")
    return docs(s, d).select("doc_id", T.ladder(c, T.SEVERITY, "low").alias("severity"), T.ladder(c, T.INTENTS, "other").alias("intent"), track.alias("track"))


def _redacted(c: str) -> str:
    for p in T.MASKED:
        c = f"regexp_replace({c}, '{p}', '[REDACTED]', 'g')"
    return rf"regexp_replace({c}, '{T.ASSIGNED}', '\1=[REDACTED]', 'g')"


@R.query("sc26_redact", f"SELECT DISTINCT chunk_id, sha256({_redacted('text')}) AS redacted FROM chunks")
def _(s, d):
    return table(s, d, "chunks").select("chunk_id", F.sha2(T.redact(F.col("text")), 256).alias("redacted")).distinct()


@R.query("sc27_labelled_secrets", rf"SELECT DISTINCT chunk_id, len(regexp_extract_all(lower(text), '(password|passwd|secret|token|api_key)\s*[:=]\s*[^\s]+'))::BIGINT AS hits FROM chunks")
def _(s, d):
    return table(s, d, "chunks").select("chunk_id", T.labelled_secrets(F.col("text")).cast("bigint").alias("hits")).distinct()


@R.query("sc28_markers", "SELECT DISTINCT chunk_id, concat_ws('|', " + ", ".join(f"CASE WHEN regexp_matches(text, '{p}') THEN '{n}' END" for n, p in T.MARKERS.items()) + ") AS markers FROM chunks")
def _(s, d):
    return table(s, d, "chunks").select("chunk_id", F.array_join(T.markers(F.col("text")), "|").alias("markers")).distinct()


@R.query("sc29_counts", f"SELECT doc_id, len(string_split(text, chr(10)))::BIGINT AS lines, strlen(text)::BIGINT AS bytes, ((length(text) + 3) // 4)::BIGINT AS tokens FROM {_DOCS}")
def _(s, d):
    c = F.col("text")
    return docs(s, d).select("doc_id", T.line_count(c).cast("bigint").alias("lines"), F.octet_length(c).cast("bigint").alias("bytes"), T.estimate_tokens(c).alias("tokens"))


@R.query("sc31_guarded")
def _(s, d):
    """Redacted, at most 200 lines and 16 KiB of every chunk."""
    c = T.splice(F.array_join(F.slice(F.split(T.redact(F.col("text")), "\n"), 1, 200), "\n"), 16384)
    return table(s, d, "chunks").select("chunk_id", c.alias("text"), F.octet_length(c).cast("bigint").alias("bytes")).distinct()


@R.query("sc34_overlap", f"SELECT doc_id, (len(list_intersect(['index','shard','token'], list_distinct(regexp_extract_all(lower(text), '[a-z0-9_]+')))) / 3.0)::DOUBLE AS share FROM {_DOCS}")
def _(s, d):
    return docs(s, d).select("doc_id", T.overlap(F.col("text"), ["shard", "index", "token"]).alias("share"))


@R.query("sc32_cosine", "SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings ORDER BY vec_id LIMIT 1)), 6) AS score FROM embeddings")
def _(s, d):
    v = table(s, d, "embeddings")
    q = v.orderBy("vec_id").select("embedding").limit(1).withColumnRenamed("embedding", "q")  # one row
    return v.join(F.broadcast(q)).select("vec_id", F.round(V.cosine(F.col("embedding"), F.col("q")), 6).alias("score"))


@R.query("st03_jaccard", f"WITH w AS (SELECT doc_id, list_distinct({_TOK}) AS t FROM {_DOCS}), p AS (SELECT a.doc_id AS a, b.doc_id AS b, a.t AS x, b.t AS y FROM w a JOIN w b ON b.doc_id = a.doc_id + 1) SELECT a AS doc_id, round(CASE WHEN len(x) = 0 AND len(y) = 0 THEN 1.0 ELSE len(list_intersect(x, y))::DOUBLE / len(list_distinct(list_concat(x, y))) END, 6) AS jaccard FROM p")
def _(s, d):
    w = docs(s, d).select("doc_id", F.array_distinct(T.tokens(F.col("text"))).alias("t"))
    other = w.select((F.col("doc_id") - 1).alias("doc_id"), F.col("t").alias("u"))
    return w.join(other, "doc_id").select("doc_id", F.round(sets.jaccard(F.col("t"), F.col("u")), 6).alias("jaccard"))


@R.query("st04_compact_lines")
def _(s, d):
    return sets.compact_lines(table(s, d, "documents"), "doc_id", "text")


@R.query("st06_coverage", rf"WITH k AS (SELECT doc_id, list_distinct(regexp_extract_all(lower(text), '[a-z][a-z0-9_]{{3,}}')) AS w, lower(regexp_replace(text, '\n[^\n]*\n', chr(10), 'g')) AS p FROM {_DOCS}) SELECT doc_id, round(CASE WHEN len(w) = 0 THEN 1.0 ELSE len(list_filter(w, lambda x: contains(p, x)))::DOUBLE / len(w) END, 6) AS covered FROM k")
def _(s, d):
    """Share of a text's key words that every second line holds: the coverage a shorter stand-in keeps."""
    return docs(s, d).select("doc_id", F.round(sets.coverage(F.col("text"), F.regexp_replace("text", r"\n[^\n]*\n", "\n")), 6).alias("covered"))


@R.query("ax02_line_scan", r"SELECT DISTINCT repo, path, i::BIGINT AS line, substr(l, 1, 160) AS hit FROM (SELECT repo, path, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM (SELECT DISTINCT repo, path, text FROM source_files)) WHERE regexp_matches(l, 'TODO|FIXME|Rename ')")
def _(s, d):
    f = table(s, d, "source_files").select("repo", "path", F.posexplode(F.split("text", "\n")).alias("p", "l"))
    return f.where(F.col("l").rlike("TODO|FIXME|Rename ")).select("repo", "path", (F.col("p") + 1).cast("bigint").alias("line"), F.substring("l", 1, 160).alias("hit")).distinct()


@R.query("ax05_constraints", rf"SELECT doc_id, len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '^\s*([-*]|[0-9]+[.)])\s') OR regexp_matches(lower(x), 'must|never|always|do not')))::BIGINT AS n FROM {_DOCS}")
def _(s, d):
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"^\s*([-*]|[0-9]+[.)])\s") | F.lower(x).rlike("must|never|always|do not"))
    return docs(s, d).select("doc_id", F.size(lines).cast("bigint").alias("n"))


@R.query("prj29_backticks", rf"SELECT doc_id, array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all(text, '`([^`\n]+)`', 1), lambda x: regexp_matches(x, '^[A-Za-z0-9_./-]+$')))), '|') AS refs FROM {_DOCS}")
def _(s, d):
    refs = F.filter(F.regexp_extract_all("text", F.lit(r"`([^`\n]+)`"), F.lit(1)), lambda x: x.rlike(r"^[A-Za-z0-9_./-]+\z"))
    return docs(s, d).select("doc_id", F.array_join(F.array_sort(F.array_distinct(refs)), "|").alias("refs"))


@R.query("prj09_markdown", r"""SELECT doc_id, array_to_string(regexp_extract_all(text, '(?:^|\n)#{1,6}[ \t]+([^\r\n]+)', 1)[1:20], '|') AS headings, array_to_string(list_sort(list_distinct(regexp_extract_all(text, '(?:^|\n)```([a-zA-Z0-9_+-]+)', 1))), '|') AS fences FROM documents WHERE fmt = 'markdown' AND text IS NOT NULL""")
def _(s, d):
    m = docs(s, d).where("fmt = 'markdown'")
    heads = F.slice(F.regexp_extract_all("text", F.lit(r"(?:^|\n)#{1,6}[ \t]+([^\r\n]+)"), F.lit(1)), 1, 20)
    fences = F.array_sort(F.array_distinct(F.regexp_extract_all("text", F.lit(r"(?:^|\n)```([a-zA-Z0-9_+-]+)"), F.lit(1))))
    return m.select("doc_id", F.array_join(heads, "|").alias("headings"), F.array_join(fences, "|").alias("fences"))


@R.query("prj10_config_facts", "SELECT DISTINCT repo, path, " + _case("text", parse.CONFIG_TYPES, "general") + r""" AS config_type, array_to_string(list_sort(list_distinct(regexp_extract_all(text, '(?:^|\n)[ \t]{0,2}"?([A-Za-z_][A-Za-z0-9_.-]*)"?[ \t]*[:=]', 1))), '|') AS keys FROM source_files WHERE regexp_matches(path, '\.(json|toml)$')""")
def _(s, d):
    f = table(s, d, "source_files").where(F.col("path").rlike(r"\.(json|toml)\z"))
    keys = F.array_sort(F.array_distinct(F.regexp_extract_all("text", F.lit(r'(?:^|\n)[ \t]{0,2}"?([A-Za-z_][A-Za-z0-9_.-]*)"?[ \t]*[:=]'), F.lit(1))))
    return f.select("repo", "path", T.ladder(F.col("text"), parse.CONFIG_TYPES, "general").alias("config_type"), F.array_join(keys, "|").alias("keys")).distinct()


@R.query("prj12_shell", r"SELECT DISTINCT repo, path, array_to_string(list_sort(list_distinct(regexp_extract_all(text, '([A-Za-z0-9_./-]+\.(?:sh|py|js))\b', 1))), '|') AS scripts FROM source_files WHERE path LIKE '%.sh'")
def _(s, d):
    return table(s, d, "source_files").where("path like '%.sh'").select("repo", "path", F.array_join(parse.shell_scripts(F.col("text")), "|").alias("scripts")).distinct()


@R.query("prj13_sql_tables", r"SELECT DISTINCT repo, path, array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(text, '(?i)\b(?:FROM|JOIN|INTO|UPDATE|TABLE)\s+([A-Za-z_][A-Za-z0-9_.]*)', 1), lambda x: lower(x)))), '|') AS tables FROM source_files WHERE path LIKE '%.sql'")
def _(s, d):
    return table(s, d, "source_files").where("path like '%.sql'").select("repo", "path", F.array_join(parse.sql_tables(F.col("text")), "|").alias("tables")).distinct()
