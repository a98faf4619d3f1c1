"""Queries over graphs: files that follow one another in commits, imports, topics."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestrata.functions import text as T
from lodestrata.operators import graph, joins, parse
from lodestrata.plans.code import source
from lodestrata.plans.registry import Registry
from lodestrata.runtime import table

R = Registry()

_EDGES = "e AS (SELECT DISTINCT repo || '/' || a AS src, repo || '/' || b AS dst FROM (SELECT repo, unnest(list_zip(files[1:len(files)-1], files[2:len(files)])) AS p FROM commit_nodes WHERE len(files) > 1), LATERAL (SELECT p[1] AS a, p[2] AS b) WHERE a IS NOT NULL AND b IS NOT NULL)"


def follows(s, d):
    """Edges from every file of a commit to the next one."""
    n = F.size("files")
    f = table(s, d, "commit_nodes").where(n > 1).select("repo", F.explode(F.arrays_zip(F.slice("files", F.lit(1), n - 1).alias("a"), F.slice("files", F.lit(2), n - 1).alias("b"))).alias("p"))
    return f.where("p.a is not null and p.b is not null").select(F.concat_ws("/", "repo", "p.a").alias("src"), F.concat_ws("/", "repo", "p.b").alias("dst")).distinct()


def python_files(s, d):
    return source(s, d).where(F.col("path").endswith(".py")).select("repo", "path", "text")


def imports_of(files):
    """Edges between modules of a repository: each import to the longest own module that is a prefix of it."""
    targets = parse.python_imports(files).select("repo", "path", F.concat_ws(".", "repo", "target").alias("name"))
    mods = files.select(F.concat_ws(".", "repo", T.module_name(F.col("path"))).alias("module")).distinct()
    hit = joins.longest_prefix(targets.select("name").distinct(), "name", mods, "module")
    return targets.join(hit, "name").select(F.concat_ws(".", "repo", T.module_name(F.col("path"))).alias("src"), F.col("module").alias("dst")).where("src != dst").distinct()


def calls_of(files):
    """Calls inside a file: the innermost definition a call stands in to a name defined in the same file, itself excluded."""
    symbols = parse.python_symbols(files)
    simple = F.regexp_extract("qualname", r"([^.]*)$", 1)
    calls = parse.python_calls(files).distinct()
    held = joins.innermost(calls, symbols, ["repo", "path"], "line", "start_line", "end_line", ["qualname"])
    local = symbols.select("repo", "path", simple.alias("callee")).distinct()
    return held.join(local, ["repo", "path", "callee"], "left_semi").where(simple != F.col("callee")).select("repo", "path", F.col("qualname").alias("caller"), "callee").distinct()


def written(s, d):
    """Modules that import what follows them in commits, some by relative imports, with three functions each, every other one with a class: files the import and call graphs have edges of."""
    e = follows(s, d).select(F.split_part("src", F.lit("/"), F.lit(1)).alias("repo"), F.regexp_replace("src", "^[^/]+/", "").alias("path"), F.regexp_replace("dst", "^[^/]+/", "").alias("to"))
    plain = r"^[a-z_][a-z0-9_]*(/[a-z_][a-z0-9_]*)*\.py$"
    e = e.where(F.col("path").rlike(plain) & F.col("to").rlike(plain))
    dir_of = lambda c: F.regexp_extract(c, r"^(.*/)?[^/]*$", 1)
    near = (dir_of("path") == dir_of("to")) & (dir_of("path") != "")
    line = F.when(near, F.concat(F.lit("from . import "), F.regexp_extract("to", r"([^/]*)\.py$", 1))).otherwise(F.concat(F.lit("import "), T.module_name(F.col("to"))))
    text = F.concat(F.array_join(F.array_sort(F.collect_set(line)), "\n"), F.lit("\n\n\ndef f():\n    g()\n    return len(h())\n\n\ndef g():\n    return g()\n\n\ndef h():\n    return []\n"))
    held = F.lit("\n\nclass A:\n    def a(self):\n        return self.x\n\n    def b(self):\n        return self.x\n\n    def c(self):\n        return self._y.z\n")
    made = e.groupBy("repo", "path").agg(text.alias("text")).withColumn("text", F.when(F.length("path") % 2 == 0, F.concat("text", held)).otherwise(F.col("text")))
    ends = e.select("repo", F.col("to").alias("path")).distinct().join(made.select("repo", "path"), ["repo", "path"], "left_anti").withColumn("text", F.lit("x = 1\n"))
    return made.unionByName(ends)


@R.query("gr00_edges", f"WITH {_EDGES} SELECT src, dst FROM e")
def _(s, d):
    return follows(s, d)


@R.query("gr01_neighbours", f"WITH {_EDGES}, h AS (SELECT src, count(*) AS n FROM e GROUP BY src ORDER BY n DESC, src LIMIT 1) SELECT DISTINCT dst AS node FROM e WHERE src = (SELECT src FROM h)")
def _(s, d):
    e = follows(s, d)
    hub = e.groupBy("src").count().orderBy(F.desc("count"), "src").first()
    return graph.neighbours(e, hub[0] if hub else "")


@R.query("gr02_reverse_neighbours", f"WITH {_EDGES}, h AS (SELECT dst, count(*) AS n FROM e GROUP BY dst ORDER BY n DESC, dst LIMIT 1) SELECT DISTINCT src AS node FROM e WHERE dst = (SELECT dst FROM h)")
def _(s, d):
    e = follows(s, d)
    hub = e.groupBy("dst").count().orderBy(F.desc("count"), "dst").first()
    return graph.neighbours(e, hub[0] if hub else "", reverse=True)


@R.query("gr03_reachable", f"WITH RECURSIVE {_EDGES}, s AS (SELECT DISTINCT src AS node FROM e WHERE src LIKE '%/README.md'), r AS (SELECT dst AS node FROM e JOIN s ON src = node UNION SELECT e.dst FROM r JOIN e ON e.src = r.node) SELECT DISTINCT node FROM r")
def _(s, d):
    e = follows(s, d)
    return graph.reachable(e, e.where("src like '%/README.md'").select(F.col("src").alias("node")))


@R.query("gr03_within_two", f"WITH {_EDGES}, s AS (SELECT DISTINCT src AS node FROM e WHERE src LIKE '%/README.md'), a AS (SELECT node, 0 AS hop FROM s UNION ALL SELECT dst, 1 FROM e JOIN s ON src = node UNION ALL SELECT e2.dst, 2 FROM e JOIN s ON src = node JOIN e e2 ON e2.src = e.dst) SELECT node, min(hop)::INTEGER AS hop FROM a GROUP BY node")
def _(s, d):
    e = follows(s, d)
    return graph.within(e, e.where("src like '%/README.md'").select(F.col("src").alias("node")), 2)


@R.query("gr04_cycles", f"WITH RECURSIVE {_EDGES}, r AS (SELECT src AS a, dst AS b FROM e UNION SELECT r.a, e.dst FROM r JOIN e ON e.src = r.b) SELECT x.a AS node, min(x.b) AS component FROM r x JOIN r y ON x.a = y.b AND x.b = y.a GROUP BY x.a")
def _(s, d):
    return graph.cyclic(follows(s, d))


_PLAIN = r"'^[a-z_][a-z0-9_]*(/[a-z_][a-z0-9_]*)*\.py$'"
_MODULE = r"regexp_replace(replace(regexp_replace({0}, '\.py$', ''), '/', '.'), '\.__init__$', '')"
_WRITTEN = f"""{_EDGES}, p AS (SELECT split_part(src, '/', 1) AS repo, regexp_replace(src, '^[^/]+/', '') AS a, regexp_replace(dst, '^[^/]+/', '') AS b FROM e), q AS (SELECT * FROM p WHERE regexp_matches(a, {_PLAIN}) AND regexp_matches(b, {_PLAIN})),
i AS (SELECT DISTINCT repo || '.' || {_MODULE.format('a')} AS src, repo || '.' || {_MODULE.format('b')} AS dst FROM q WHERE a <> b)"""


@R.query("gr04_import_cycles", f"WITH RECURSIVE {_WRITTEN}, r AS (SELECT src AS a, dst AS b FROM i UNION SELECT r.a, i.dst FROM r JOIN i ON i.src = r.b) SELECT x.a AS node, min(x.b) AS component FROM r x JOIN r y ON x.a = y.b AND x.b = y.a GROUP BY x.a")
def _(s, d):
    """Cycles of imports among the written modules."""
    return graph.cyclic(imports_of(written(s, d)))


@R.query("gr05_import_graph", f"WITH {_WRITTEN} SELECT src, dst FROM i")
def _(s, d):
    """The import graph of the written modules."""
    return imports_of(written(s, d))


@R.query("gr05_scanned_imports")
def _(s, d):
    """The import graph of the files as they are: theirs name no module of their own repository, so it has no edges."""
    return imports_of(python_files(s, d))


@R.query("gr_components", f"WITH RECURSIVE {_EDGES}, u AS (SELECT src AS a, dst AS b FROM e UNION SELECT dst, src FROM e), r AS (SELECT a, b FROM u UNION SELECT r.a, u.b FROM r JOIN u ON u.a = r.b) SELECT a AS node, least(a, min(b)) AS component FROM r GROUP BY a")
def _(s, d):
    return graph.components(follows(s, d))


@R.query("gr06_topic_search", f"""WITH {_EDGES}, w AS (SELECT src, dst, 2.0 AS weight FROM e), s AS (SELECT DISTINCT src AS node, 3.0 + CASE WHEN contains(src, 'ledger') THEN 5.0 ELSE 0.0 END AS score FROM e WHERE contains(src, 'index') OR contains(src, 'ledger')),
p1 AS (SELECT dst AS node, max(score) AS s, max(score) * 0.55 * 2.0 AS v FROM s JOIN w ON src = node GROUP BY dst), q AS (SELECT dst AS node, max(score) AS s FROM s JOIN w ON src = node GROUP BY dst), p2 AS (SELECT dst AS node, max(s) * 0.55 * 0.55 * 2.0 AS v FROM q JOIN w ON src = node GROUP BY dst)
SELECT node, round(max(v), 6)::DOUBLE AS score FROM (SELECT node, score AS v FROM s UNION ALL SELECT node, v FROM p1 UNION ALL SELECT node, v FROM p2) GROUP BY node ORDER BY score DESC, node LIMIT 12""")
def _(s, d):
    e = follows(s, d)
    hit = F.contains("src", F.lit("index")) | F.contains("src", F.lit("ledger"))
    seeds = e.where(hit).select(F.col("src").alias("node"), (F.lit(3.0) + F.when(F.contains("src", F.lit("ledger")), 5.0).otherwise(0.0)).alias("score")).distinct()
    return graph.expand(seeds, e.withColumn("weight", F.lit(2.0)))


@R.query("ag14_degrees", f"WITH {_EDGES}, d AS (SELECT src AS node FROM e UNION ALL SELECT dst FROM e) SELECT node, count(*)::BIGINT AS degree FROM d GROUP BY node")
def _(s, d):
    return graph.degrees(follows(s, d))


@R.query("st09_valid_links", f"WITH {_EDGES}, n AS (SELECT DISTINCT repo || '/' || path AS node FROM source_files) SELECT DISTINCT src, dst, 'follows' AS type FROM e WHERE src IN (SELECT node FROM n) AND dst IN (SELECT node FROM n)")
def _(s, d):
    nodes = table(s, d, "source_files").select(F.concat_ws("/", "repo", "path").alias("node"))
    return graph.valid_links(follows(s, d).withColumn("type", F.lit("follows")), nodes)


@R.query("gr14_call_edges", f"WITH {_EDGES}, p AS (SELECT DISTINCT split_part(src, '/', 1) AS repo, regexp_replace(src, '^[^/]+/', '') AS path FROM e WHERE regexp_matches(regexp_replace(src, '^[^/]+/', ''), {_PLAIN}) AND regexp_matches(regexp_replace(dst, '^[^/]+/', ''), {_PLAIN})) SELECT repo, path, 'f' AS caller, unnest(['g', 'h']) AS callee FROM p")
def _(s, d):
    """Calls inside the written modules."""
    return calls_of(written(s, d))


@R.query("gr14_scanned_calls")
def _(s, d):
    """Calls inside the files as they are."""
    return calls_of(python_files(s, d))


@R.query("tk23_degree_one", f"WITH {_EDGES}, h AS (SELECT src, count(*) AS n FROM e GROUP BY src ORDER BY n DESC, src LIMIT 1), v AS (SELECT DISTINCT dst AS node FROM e WHERE src = (SELECT src FROM h)) SELECT node, (SELECT count(*) FROM v)::BIGINT AS total FROM v ORDER BY node LIMIT 10")
def _(s, d):
    e = follows(s, d)
    hub = e.groupBy("src").count().orderBy(F.desc("count"), "src").first()
    return graph.adjacency_view(e, hub[0] if hub else "")


@R.query("ag13_shards", f"WITH {_EDGES}, x AS (SELECT split_part(src, '/', 1) AS repo, * FROM e) SELECT repo, count(*)::BIGINT AS links, count(DISTINCT src)::BIGINT AS sources, count(DISTINCT dst)::BIGINT AS targets FROM x GROUP BY repo")
def _(s, d):
    return follows(s, d).groupBy(F.split_part("src", F.lit("/"), F.lit(1)).alias("repo")).agg(F.count(F.lit(1)).alias("links"), F.count_distinct("src").alias("sources"), F.count_distinct("dst").alias("targets"))
