"""Queries of parsers of Python over modules written for the purpose, whose facts SQL can tell."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestrata.operators import parse
from lodestrata.plans.graphs import _EDGES, _MODULE, _PLAIN, written
from lodestrata.plans.registry import Registry

R = Registry()

#: i: import lines of each module; w: modules with the number of those lines and whether they have a class; z: modules without code.
_W = rf"""{_EDGES}, p AS (SELECT split_part(src, '/', 1) AS repo, regexp_replace(src, '^[^/]+/', '') AS path, regexp_replace(dst, '^[^/]+/', '') AS b FROM e), q AS (SELECT *, regexp_extract(path, '^(.*/)?[^/]*$', 1) AS da, regexp_extract(b, '^(.*/)?[^/]*$', 1) AS db FROM p WHERE regexp_matches(path, {_PLAIN}) AND regexp_matches(b, {_PLAIN})),
i AS (SELECT DISTINCT repo, path, da = db AND da <> '' AS near, CASE WHEN da = db AND da <> '' THEN regexp_extract(b, '([^/]*)\.py$', 1) ELSE {_MODULE.format('b')} END AS name, replace(rtrim(da, '/'), '/', '.') AS package FROM q),
w AS (SELECT repo, path, count(*)::INTEGER AS n, length(path) % 2 = 0 AS held FROM (SELECT DISTINCT repo, path, near, name FROM i) GROUP BY repo, path), z AS (SELECT DISTINCT repo, b AS path FROM q WHERE (repo, b) NOT IN (SELECT (repo, path) FROM w))"""


@R.query("prj19_written_symbols", f"WITH {_W}, s(qualname, kind, a, z, held) AS (VALUES ('f', 'function', 3, 5, false), ('g', 'function', 8, 9, false), ('h', 'function', 12, 13, false), ('A', 'class', 16, 24, true), ('A.a', 'method', 17, 18, true), ('A.b', 'method', 20, 21, true), ('A.c', 'method', 23, 24, true)) SELECT repo, path, qualname, kind, (n + a)::INTEGER AS start_line, (n + s.z)::INTEGER AS end_line FROM w, s WHERE w.held OR NOT s.held")
def _(s, d):
    return parse.python_symbols(written(s, d))


@R.query("prj20_written_calls", f"WITH {_W}, c(callee, a) AS (VALUES ('g', 4), ('h', 5), ('len', 5), ('g', 9)) SELECT repo, path, (n + a)::INTEGER AS line, callee FROM w, c")
def _(s, d):
    return parse.python_calls(written(s, d))


@R.query("prj18_written_imports", f"WITH {_W} SELECT DISTINCT repo, path, unnest(CASE WHEN near THEN [package, package || '.' || name] ELSE [name] END) AS target FROM i")
def _(s, d):
    return parse.python_imports(written(s, d))


@R.query("prj21_written_packages", f"WITH {_W} SELECT DISTINCT repo, path, split_part(name, '.', 1) AS package FROM i WHERE NOT near")
def _(s, d):
    return parse.python_top_imports(written(s, d))


@R.query("prj08_written_facts", f"WITH {_W}, t AS (SELECT repo, path, array_to_string(list_sort(list_distinct(list(split_part(name, '.', 1)))), '|') AS imports FROM i WHERE NOT near GROUP BY repo, path) SELECT w.repo, w.path, 'ok' AS status, coalesce(imports, '') AS imports, CASE WHEN held THEN 'A' ELSE '' END AS classes, CASE WHEN held THEN 'a|b|c|f|g|h' ELSE 'f|g|h' END AS functions FROM w LEFT JOIN t ON w.repo = t.repo AND w.path = t.path UNION ALL SELECT repo, path, 'ok', '', '', '' FROM z")
def _(s, d):
    f = parse.python_facts(written(s, d))
    return f.select("repo", "path", "status", *[F.array_join(c, "|").alias(c) for c in ("imports", "classes", "functions")])


@R.query("prj07_written", f"WITH {_W} SELECT repo, path, 'definitions' AS kind, CASE WHEN held THEN 7 ELSE 3 END::BIGINT AS n FROM w UNION ALL SELECT repo, path, 'definitions', 0 FROM z")
def _(s, d):
    return parse.dispatched(written(s, d))


#: What the scores of the written modules come to, with a class (held) and without.
_SCORES = {
    "simplicity": ("1.0", "1.0"), "cohesion": ("CASE WHEN held THEN round(1.0 / 3, 6) ELSE 1.0 END", "1.0"), "need": ("1.0", "1.0"),
    "decoupling": ("round((CASE WHEN held THEN 0.75 ELSE 1.0 END + 10.0 / (10 + n)) / 2, 6)", "1.0"), "encapsulation": ("1.0", "1.0"), "convention": ("1.0", "1.0"), "craft": ("0.0", "1.0"),
}


def _score(k: int, principle: str) -> None:
    of_code, of_none = _SCORES[principle]

    @R.query(f"sc{k}_{principle}", f"WITH {_W} SELECT repo, path, ({of_code})::DOUBLE AS score FROM w UNION ALL SELECT repo, path, {of_none}::DOUBLE FROM z")
    def _(s, d):
        return parse.python_scores(written(s, d)).select("repo", "path", F.col(principle).alias("score"))


for _k, _name in enumerate(parse.PRINCIPLES, 61):
    _score(_k, _name)


@R.query("tk21_written_hotspots", f"WITH {_W}, f(function, a, held) AS (VALUES ('f', 3, false), ('g', 8, false), ('h', 12, false), ('a', 17, true), ('b', 20, true), ('c', 23, true)) SELECT repo, path, (n + a)::INTEGER AS line, function, 1 AS complexity FROM w, f WHERE w.held OR NOT f.held")
def _(s, d):
    return parse.python_complexity(written(s, d)).where("complexity >= 1")
