"""Queries of parsers, normal forms and validations over texts."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from lodestrata.functions import normal as N
from lodestrata.functions import rules as U
from lodestrata.functions import text as T
from lodestrata.operators import parse
from lodestrata.plans.code import source
from lodestrata.plans.registry import Registry
from lodestrata.plans.retrieval import first_vector
from lodestrata.runtime import table

R = Registry()
_DOCS = "documents WHERE text IS NOT NULL"
_SRC = "(SELECT DISTINCT repo, path, text FROM source_files)"
_EXT = r"lower(regexp_extract(path, '\.([^./]+)$', 1))"
_MOD = r"regexp_replace(replace(regexp_replace(path, '\.py$', ''), '/', '.'), '\.__init__$', '')"
_BLANK = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_INLINE = _BLANK.replace(r"\s", r"\t\r\f ").replace("[", "[ ", 1)


def docs(s, d):
    return table(s, d, "documents").where(F.col("text").isNotNull())


@R.query("sc03_words", f"SELECT doc_id, len(regexp_extract_all(text, '[A-Za-z0-9_]+'))::BIGINT AS n FROM {_DOCS}")
def _(s, d):
    return docs(s, d).select("doc_id", F.size(F.regexp_extract_all("text", F.lit(r"\w+"), F.lit(0))).cast("bigint").alias("n"))


def _canonical(c: str) -> str:
    stripped = rf"regexp_replace(nfc_normalize({c}), '^{_BLANK}+|{_BLANK}+$', '', 'g')"
    lf = rf"replace(replace({stripped}, chr(13) || chr(10), chr(10)), chr(13), chr(10))"
    return rf"regexp_replace(regexp_replace({lf}, '{_INLINE}+', ' ', 'g'), ' ?\n ?', chr(10), 'g')"


@R.query("sc11_canonical", f"SELECT doc_id, {_canonical('text')} AS canonical FROM {_DOCS}")
def _(s, d):
    return docs(s, d).select("doc_id", N.canonical(F.col("text")).alias("canonical"))


@R.query("sc13_text_hash", f"SELECT doc_id, sha256({_canonical('text')}) AS text_hash FROM {_DOCS}")
def _(s, d):
    return docs(s, d).select("doc_id", N.text_hash(F.col("text")).alias("text_hash"))


@R.query("sc14_claims", f"SELECT item_id, sha256(lower({_canonical('text')})) AS claim FROM (SELECT DISTINCT item_id, text FROM eval_items)")
def _(s, d):
    return table(s, d, "eval_items").select("item_id", "text").distinct().select("item_id", N.claim_hash(F.col("text")).alias("claim"))


@R.query("sc16_digests")
def _(s, d):
    """Digests SQL has no function for: BLAKE2 of chunks, XXH64 of files, keys of queries."""
    c = F.col("text")
    return docs(s, d).select("doc_id", N.chunk_hash(c).alias("chunk_hash"), N.file_digest(c).alias("file_digest"), N.query_key(c).alias("query_key"))


@R.query("sc20_route", rf"SELECT doc_id, concat_ws(':', CASE " + " ".join(f"WHEN regexp_matches(lower(text), '{p}') THEN '{n}'" for n, p in T.INTENTS) + rf" ELSE 'other' END, CASE WHEN length(text) > 2000 THEN 'deep' ELSE 'plain' END, concat_ws(',', lang, fmt), array_to_string(list_slice(list_sort(list_distinct(regexp_extract_all(lower(text), '[a-z0-9_][a-z0-9_\-]+'))), 1, 12), ' ')) AS route FROM {_DOCS}")
def _(s, d):
    c = F.col("text")
    words = F.slice(F.array_sort(F.array_distinct(T.tokens(c))), 1, 12)
    return docs(s, d).select("doc_id", F.concat_ws(":", T.ladder(c, T.INTENTS, "other"), F.when(F.length(c) > 2000, "deep").otherwise("plain"), F.concat_ws(",", "lang", "fmt"), F.array_join(words, " ")).alias("route"))


@R.query("sc23_stacks", r"WITH s AS (SELECT repo, path, qualname, start_line, row_number() OVER (PARTITION BY repo, path ORDER BY start_line, qualname) AS i FROM (SELECT DISTINCT repo, path, qualname, start_line FROM symbols)) SELECT repo, path, substr(sha1(string_agg(regexp_extract(path, '([^/]+)$', 1) || ':' || qualname, '->' ORDER BY i)), 1, 16) AS signature FROM s GROUP BY repo, path")
def _(s, d):
    """Signatures of tracebacks: one through all definitions of each file, in order."""
    sy = table(s, d, "symbols").select("repo", "path", "qualname", "start_line").distinct()
    line = F.concat(F.lit('  File "/x/'), "path", F.lit('", line '), F.col("start_line").cast("string"), F.lit(", in "), "qualname")
    g = sy.groupBy("repo", "path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start_line", "qualname", line.alias("t")))), lambda x: x["t"]), "\n    ...\n").alias("trace"))
    return g.select("repo", "path", U.stack_signature(F.concat(F.lit("Traceback (most recent call last):\n"), "trace")).alias("signature"))


@R.query("sc24_loci")
def _(s, d):
    """The node and scope at the line after the head of every definition, and a hash of its children's kinds."""
    at = table(s, d, "symbols").select("repo", "path", (F.col("start_line") + 1).alias("line")).distinct().groupBy("repo", "path").agg(F.array_sort(F.collect_set("line")).alias("lines"))
    f = source(s, d).where(F.col("path").endswith(".py")).join(at, ["repo", "path"])
    return parse.python_loci(f)


_GUARD = r"array_to_string(list_slice(string_split({c}, chr(10)), 1, 200), chr(10))"


def _first_bytes(c: str, n: int) -> str:
    return f"CASE WHEN strlen({c}) <= {n} THEN {c} ELSE substr({c}, 1, list_max(list_filter(range(0, {n} + 1), lambda k: strlen(substr({c}, 1, k)) <= {n}))) END"


@R.query("sc35_snippets", f"SELECT doc_id, {_first_bytes('text', 1200)} AS snippet FROM {_DOCS}")
def _(s, d):
    """The first 1,200 bytes, no character broken."""
    return docs(s, d).select("doc_id", T.splice(F.col("text"), 1200).alias("snippet"))


@R.query("sc33_batch_cosine", "SELECT vec_id, round(list_cosine_similarity(embedding, (SELECT embedding FROM embeddings ORDER BY vec_id LIMIT 1)), 3) AS score FROM embeddings")
def _(s, d):
    v = table(s, d, "embeddings").select("vec_id", "embedding")
    q = first_vector(v, "vec_id", "embedding")
    return v.select("vec_id", F.round(N.batch_cosine(F.col("embedding"), q), 3).alias("score"))


_LINES = r"l AS (SELECT doc_id, i::BIGINT AS line, x, regexp_extract(x, '^#{1,6}\s+(.+)$', 1) AS head FROM (SELECT doc_id, unnest(string_split(replace(text, chr(13), ''), chr(10))) AS x, unnest(range(1, len(string_split(replace(text, chr(13), ''), chr(10))) + 1)) AS i FROM documents WHERE text IS NOT NULL))"


@R.query("sc37_parts", rf"WITH {_LINES}, g AS (SELECT *, sum(CASE WHEN head <> '' OR trim(x, ' ' || chr(9)) = '' THEN 1 ELSE 0 END) OVER w AS part, max(CASE WHEN head <> '' THEN line END) OVER w AS under FROM l WINDOW w AS (PARTITION BY doc_id ORDER BY line)), b AS (SELECT doc_id, part, min(line) AS line, any_value(under) AS under, string_agg(x, chr(10) ORDER BY line) AS text FROM g WHERE head = '' AND trim(x, ' ' || chr(9)) <> '' GROUP BY doc_id, part) SELECT b.doc_id, b.line, coalesce(h.head, '') AS heading, md5(b.text) AS text FROM b LEFT JOIN l h ON h.doc_id = b.doc_id AND h.line = b.under")
def _(s, d):
    """Paragraphs with the line they begin at and the heading they stand under; headings and blank lines part them."""
    return parse.paragraphs(docs(s, d), "doc_id", "text").select("doc_id", "line", "heading", F.md5("text").alias("text"))


_FLAGS = (("dataframe", "DataFrame"), ("distributed", "worker"), ("query", "SELECT"), ("schemaval", "schema"), ("tests", "assert"))


@R.query("sc49_reuse_tags", f"SELECT repo, path, array_to_string(list_sort(list_filter([{', '.join(f'CASE WHEN contains(text, {chr(39)}{w}{chr(39)}) THEN {chr(39)}{n}{chr(39)} END' for n, w in _FLAGS)}], lambda x: x IS NOT NULL)), '|') AS tags FROM {_SRC}")
def _(s, d):
    tags = F.array_compact(F.array(*[F.when(F.contains("text", F.lit(w)), F.lit(n)) for n, w in _FLAGS]))
    return source(s, d).select("repo", "path", F.array_join(F.array_sort(tags), "|").alias("tags"))


@R.query("sc52_usage", "SELECT DISTINCT chunk_id, (coalesce(start_byte, 0) + coalesce(end_byte, 0) + chunk_index + 7)::BIGINT AS total_tokens, round(CASE WHEN chunk_index % 2 = 0 THEN chunk_index * 0.5 ELSE (3.0 * coalesce(start_byte, 0) + 15.0 * coalesce(end_byte, 0)) / 1000000 END, 6) AS cost FROM chunks")
def _(s, d):
    """Usage records as JSON: all four kinds of tokens, and the cost reported or else worked out."""
    n = F.lit(None).cast("double")
    raw = F.to_json(F.struct(F.struct(F.col("start_byte").alias("input_tokens"), F.col("end_byte").alias("output_tokens"), F.col("chunk_index").alias("cache_read_tokens"), F.lit(7).alias("cache_write_tokens")).alias("usage"), F.when(F.col("chunk_index") % 2 == 0, F.col("chunk_index") * 0.5).otherwise(n).alias("total_cost_usd")))
    u = U.usage(raw, 3.0, 15.0)
    return table(s, d, "chunks").select("chunk_id", u["total_tokens"].alias("total_tokens"), u["cost"].alias("cost")).distinct()


@R.query("sc56_goal_parts", rf"SELECT doc_id, len(p)::BIGINT AS n, md5(array_to_string(p, '|')) AS parts FROM (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(text, '\n\s*(?:[-*]|[0-9]+[.)])\s+|[.;]\s+|\bthen\b|\n'), lambda x: trim(x)), lambda x: x <> '') AS p FROM {_DOCS})")
def _(s, d):
    p = U.goal_parts(F.col("text"))
    return docs(s, d).select("doc_id", F.size(p).cast("bigint").alias("n"), F.md5(F.array_join(p, "|")).alias("parts"))


@R.query("sc58_filters", "WITH n AS (SELECT lower(trim(source)) AS source, count(*)::BIGINT AS n FROM documents WHERE source IS NOT NULL GROUP BY 1), m AS (SELECT *, greatest(8, ceil(-n * ln(0.0001) / (ln(2) * ln(2))))::BIGINT AS m FROM n), k AS (SELECT *, greatest(1, round(m / n * ln(2)))::BIGINT AS k FROM m) SELECT source, n, m, k, round(pow(1 - exp(-k * n / m), k), 9) AS rate FROM k")
def _(s, d):
    """Size, hash functions and expected false positives of a filter for each source's documents."""
    n = table(s, d, "documents").where("source is not null").groupBy(F.lower(F.trim("source")).alias("source")).agg(F.count(F.lit(1)).alias("n"))
    ln2 = math.log(2)
    m = F.greatest(F.lit(8), F.ceil(-F.col("n") * F.log(F.lit(0.0001)) / (ln2 * ln2))).cast("bigint")
    from lodestrata.operators.lookups import false_positive_rate

    k = n.withColumn("m", m).withColumn("k", F.greatest(F.lit(1), F.round(F.col("m") / F.col("n") * ln2)).cast("bigint"))
    return k.withColumn("rate", F.round(false_positive_rate(F.col("m"), F.col("k"), F.col("n")), 9))


@R.query("prj07_dispatched")
def _(s, d):
    """Every file through the parser its extension names: (language, kind of fact, how many)."""
    return parse.dispatched(source(s, d))


@R.query("prj14_gherkin", "SELECT DISTINCT repo, sha, subject AS feature, 1::BIGINT AS scenarios, CASE WHEN coalesce(body, '') = '' THEN 1 ELSE 2 END::BIGINT AS steps FROM commit_nodes WHERE subject IS NOT NULL AND NOT contains(subject, chr(10)) AND NOT contains(coalesce(body, ''), chr(10)) AND trim(subject) <> '' AND trim(subject) = subject")
def _(s, d):
    """Commits told as features with one scenario each."""
    c = table(s, d, "commit_nodes").where("subject is not null and not contains(subject, '\\n') and not contains(coalesce(body, ''), '\\n') and trim(subject) <> '' and trim(subject) = subject").select("repo", "sha", "subject", "body").distinct()
    body = F.coalesce("body", F.lit(""))
    text = F.concat(F.lit("@tag\nFeature: "), "subject", F.lit("\n  Scenario: one\n    Given a commit\n"), F.when(body != "", F.concat(F.lit("    Then "), body, F.lit("\n"))).otherwise(""))
    f = c.select("repo", "sha", *parse.gherkin(text))
    return f.select("repo", "sha", "feature", F.size("scenarios").cast("bigint").alias("scenarios"), F.size("steps").cast("bigint").alias("steps"))


@R.query("prj17_relative", rf"SELECT repo, path, level, CASE WHEN len(p) < level THEN NULL ELSE array_to_string(list_filter([array_to_string(list_slice(p, 1, len(p) - level), '.'), 'near'], lambda x: x <> ''), '.') END AS target FROM (SELECT DISTINCT repo, path, string_split({_MOD}, '.') AS p FROM source_files WHERE path LIKE '%.py'), (VALUES (1), (3), (6)) v(level)")
def _(s, d):
    """Where imports one, three and six dots up lead to from every module."""
    f = source(s, d).where(F.col("path").endswith(".py")).select("repo", "path", T.module_name(F.col("path")).alias("module"), F.explode(F.array(F.lit(1), F.lit(3), F.lit(6))).alias("level"))
    return f.select("repo", "path", "level", U.resolve_relative(F.col("module"), F.col("level"), F.lit("near")).alias("target"))


@R.query("prj21_top_imports")
def _(s, d):
    """Names of the packages every Python file imports absolutely."""
    return parse.python_top_imports(source(s, d).where(F.col("path").endswith(".py")))


_NOTE = r"documents WHERE starts_with(replace(text, chr(13) || chr(10), chr(10)), '---' || chr(10))"
_BLOCK = r"regexp_extract(replace(text, chr(13) || chr(10), chr(10)), '(?s)^---\n(.*?)\n---', 1)"


@R.query("prj26_aliases", rf"SELECT doc_id, array_to_string(list_sort(list_distinct(list_filter(list_transform(string_split(regexp_extract({_BLOCK}, '(?m)^tags: *\[(.*)\]$', 1), ','), lambda x: lower(trim(x))), lambda x: x <> ''))), '|') AS aliases FROM {_NOTE}")
def _(s, d):
    """Other names of a note: the items of a list in its front matter."""
    n = table(s, d, "documents").where(F.regexp_replace("text", r"\r\n", "\n").startswith("---\n"))
    return n.select("doc_id", F.array_join(U.aliases(F.col("text"), "tags"), "|").alias("aliases"))


@R.query("prj28_cards", "SELECT DISTINCT repo, sha, sha || ': ' || subject AS title, coalesce(array_to_string(list_slice(list_filter(files, lambda x: x IS NOT NULL AND trim(x) <> ''), 1, 8), '|'), '') AS files, coalesce(array_to_string(list_slice(list_filter(tags, lambda x: x IS NOT NULL AND trim(x) <> ''), 1, 1), '|'), '') AS tags FROM (SELECT DISTINCT repo, sha, subject, list_transform(files, lambda x: trim(x)) AS files, list_transform(tags, lambda x: trim(x)) AS tags FROM commit_nodes WHERE subject IS NOT NULL AND NOT contains(subject, chr(10)))")
def _(s, d):
    """Commits written as cards with labelled lists, and compacted."""
    none = F.array().cast("array<string>")
    lines = lambda c: F.transform(F.coalesce(c, none), lambda x: F.concat(F.lit("- "), F.coalesce(x, F.lit(""))))
    c = table(s, d, "commit_nodes").where("subject is not null and not contains(subject, '\\n')").select("repo", "sha", "subject", "files", "tags").distinct()
    body = F.concat(F.lit("Tags:\n"), F.array_join(lines("tags"), "\n"), F.lit("\nFiles:\n"), F.array_join(lines("files"), "\n"), F.lit("\nTests:\n- none\n"))
    return c.select("repo", "sha", F.concat_ws(": ", "sha", "subject").alias("title"), F.array_join(U.labelled(body, "Files", 8), "|").alias("files"), F.array_join(U.labelled(body, "Tags", 1), "|").alias("tags"))


@R.query("prj32_normalised", "SELECT doc_id, coalesce(lang, 'und') AS lang, coalesce(source, 'unknown') AS source, array_to_string(list_sort(list_filter([CASE WHEN lang IS NULL THEN 'default lang' END, CASE WHEN source IS NULL THEN 'default source' END, 'unknown size', CASE WHEN n_chars IS NULL THEN 'missing n_chars' END, CASE WHEN lang NOT IN ('en', 'de', 'es', 'fr') THEN 'enum lang' END], lambda x: x IS NOT NULL)), '|') AS changes FROM documents")
def _(s, d):
    """Records of JSON against a schema: defaults filled, unknown fields dropped, what is missing or out of range told."""
    raw = F.to_json(F.struct("doc_id", "lang", "source", "n_chars", F.lit(1).alias("size")))
    r = U.normalised(raw, {"doc_id": "bigint", "lang": "string", "source": "string", "n_chars": "bigint"}, {"lang": "und", "source": "unknown"}, {"lang": ("en", "de", "es", "fr")})
    return table(s, d, "documents").select(r.alias("r")).select("r.doc_id", "r.lang", "r.source", F.array_join("r.changes", "|").alias("changes"))


@R.query("prj34_provenance", rf"SELECT DISTINCT c.chunk_id, coalesce(trim(regexp_replace(c.text, '\s+', ' ', 'g')) <> '' AND contains(trim(regexp_replace(f.text, '\s+', ' ', 'g')), trim(regexp_replace(c.text, '\s+', ' ', 'g'))), false) AS anchored FROM chunks c LEFT JOIN {_SRC} f ON c.repo = f.repo AND c.path = f.path WHERE c.text IS NOT NULL")
def _(s, d):
    """Whether what a chunk says stands in its file, blanks aside."""
    c = table(s, d, "chunks").where("text is not null").select("chunk_id", "repo", "path", F.col("text").alias("claim")).distinct()
    f = source(s, d).select("repo", "path", "text")
    return c.join(f, ["repo", "path"], "left").select("chunk_id", U.anchored(F.col("claim"), F.col("text"), F.lit(0), F.length("text")).alias("anchored"))


@R.query("sc31_lines", f"SELECT doc_id, {_first_bytes(_GUARD.format(c='text'), 4096)} AS text FROM documents WHERE text IS NOT NULL")
def _(s, d):
    """At most 200 lines and 4,096 bytes of every text, no character broken."""
    return docs(s, d).select("doc_id", T.splice(F.array_join(F.slice(F.split("text", "\n"), 1, 200), "\n"), 4096).alias("text"))


@R.query("sc60_values", "SELECT event_id, json_extract_string(props, '$.k') AS k, (props IS NOT NULL AND json_extract(props, '$.k') IS NOT NULL) AS there FROM events")
def _(s, d):
    """A value out of JSON by its key, as a map."""
    m = F.from_json("props", "map<string,string>")
    return table(s, d, "events").select("event_id", m["k"].alias("k"), F.coalesce(F.map_contains_key(m, F.lit("k")), F.lit(False)).alias("there"))
