"""Queries through the plug-in surfaces: kept results, analysers, tools."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from lodestrata.operators.registries import Memo, Tools, analysed
from lodestrata.plans.code import source
from lodestrata.plans.registry import Registry
from lodestrata.runtime import table

R = Registry()
MEMO = Memo()
TOOLS = Tools()


@MEMO.cached("sizes")
def sizes(s, d):
    return source(s, d).groupBy("repo").agg(F.count(F.lit(1)).alias("files"))


@R.query("ud06_memoised", "SELECT a.repo, a.n * 2 AS files FROM (SELECT repo, count(*)::BIGINT AS n FROM (SELECT DISTINCT repo, path FROM source_files) GROUP BY repo) a")
def _(s, d):
    """A table asked for twice and made once."""
    return sizes(s, d).unionByName(sizes(s, d)).groupBy("repo").agg(F.sum("files").alias("files"))


@R.query("ud08_analysed", r"WITH l AS (SELECT repo, path, string_split(text, chr(10)) AS l FROM (SELECT DISTINCT repo, path, text FROM source_files)) SELECT repo, path, round(len(list_filter(l, lambda x: starts_with(ltrim(x, ' ' || chr(9)), '#') OR starts_with(ltrim(x, ' ' || chr(9)), '//')))::DOUBLE / len(l), 6) AS comments, round(len(list_filter(l, lambda x: length(x) > 100))::DOUBLE / len(l), 6) AS long_lines FROM l")
def _(s, d):
    return source(s, d).select("repo", "path", *[analysed(F.col("text"), a).alias(a) for a in ("comments", "long_lines")])


TOOLS.tool("repos", "repositories and their files")(sizes)


@TOOLS.tool("symbols", "definitions whose name begins so")
def _(s, d, prefix="read_"):
    return table(s, d, "symbols").where(F.col("qualname").startswith(prefix)).select("repo", "path", "qualname").distinct().orderBy("repo", "path", "qualname")


@TOOLS.tool("commits", "commits of a kind")
def _(s, d, kind="bug"):
    return table(s, d, "commit_nodes").where(F.col("node_type") == kind).select("repo", "sha").distinct().orderBy("repo", "sha")


@TOOLS.tool("search", "texts that hold a word")
def _(s, d, word="ledger"):
    return table(s, d, "documents").where(F.contains(F.lower("text"), F.lit(word))).select("doc_id").orderBy("doc_id")


@R.query("ud09_tools", "SELECT 'commits' AS tool, least(100, count(*))::BIGINT AS rows FROM (SELECT DISTINCT repo, sha FROM commit_nodes WHERE node_type = 'bug') UNION ALL SELECT 'repos', least(100, count(DISTINCT repo))::BIGINT FROM source_files UNION ALL SELECT 'search', least(7, count(*))::BIGINT FROM documents WHERE contains(lower(text), 'ledger') UNION ALL SELECT 'symbols', least(100, count(*))::BIGINT FROM (SELECT DISTINCT repo, path, qualname FROM symbols WHERE starts_with(qualname, 'read_'))")
def _(s, d):
    """Every tool called with a request of JSON, and how many rows it answers."""
    asked = {"commits": {"limit": 1000}, "repos": {"limit": 100}, "search": {"limit": 7, "arguments": {"word": "ledger"}}, "symbols": {"limit": 100}}
    rows = [(n, len(json.loads(TOOLS.call(s, d, json.dumps({"tool": n, **r})))["rows"])) for n, r in asked.items()]
    return s.createDataFrame(rows, "tool string, rows bigint")
