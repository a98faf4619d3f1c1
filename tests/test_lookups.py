import datetime as dt

from pyspark.sql import functions as F

from lodestrata.functions import normal as N
from lodestrata.functions import rules as U
from lodestrata.operators import joins, lookups, parse, sequence
from lodestrata.operators.planes import search as by_planes
from lodestrata.operators.registries import Memo, Tools


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_functions_of_hunks(spark):
    h = spark.createDataFrame([("r", "s", "a.py", 4, 3), ("r", "s", "b.py", 1, 0), ("r", "s", "a.py", 200, 1)], "repo string, sha string, path string, start int, count int")
    s = spark.createDataFrame([("r", "a.py", "A", 1, 10), ("r", "a.py", "A.m", 6, 8), ("r", "a.py", "g", 12, None), ("r", "a.py", "z", 130, 260), ("q", "a.py", "other", 1, 99)], "repo string, path string, qualname string, start_line int, end_line int")
    assert rows(lookups.hunk_functions(h, s, ["repo", "sha"])) == [("r", "s", "a.py", "A"), ("r", "s", "a.py", "A.m"), ("r", "s", "a.py", "z")]
    assert rows(lookups.hunk_functions(h, s, ["repo", "sha"], most_files=1)) == []


def test_related_files(spark):
    m = spark.createDataFrame([("r", "a", "a/__init__.py"), ("r", "a.b", "a/b.py"), ("r", "c", "c.py")], "repo string, module string, file string")
    i = spark.createDataFrame([("r", "c.py", "a.b.Thing", 1), ("r", "c.py", "a.x", 2), ("r", "c.py", "c.self", 3), ("r", "c.py", "os", 4)], "repo string, path string, name string, rank int")
    assert rows(lookups.related(i, m, ["repo", "path"], 5)) == [("r", "c.py", "a/__init__.py"), ("r", "c.py", "a/b.py")]
    assert rows(lookups.related(i, m, ["repo", "path"], 1)) == [("r", "c.py", "a/b.py")]


def test_roster(spark):
    v = spark.createDataFrame([(1, "s"), (2, None), (3, "t")], "id int, session string")
    r = spark.createDataFrame([("s", "a", 1, "old"), ("s", "a", 2, "new"), (None, "b", 1, "any"), ("t", "a", 3, "t")], "session string, agent string, o int, m string")
    got = lookups.roster(v, r, "session", "agent", ["o"], ["m"]).select("id", "agent", "m")
    assert rows(got) == [(1, "a", "new"), (1, "b", "any"), (2, "a", "t"), (2, "b", "any"), (3, "a", "t"), (3, "b", "any")]


def test_filter_loses_no_key(spark):
    keys = spark.range(0, 3000, 3).select(F.col("id").cast("string").alias("k"))
    made = lookups.bloom(keys, "k", 0.01)
    got = {r[0] for r in lookups.maybe_in(spark.range(3000).select(F.col("id").cast("string").alias("k")).unionByName(spark.createDataFrame([(None,)], "k string")), "k", made).collect()}
    assert {str(x) for x in range(0, 3000, 3)} <= got and len(got) < 1000 + 100 and None not in got
    assert lookups.maybe_in(keys, "k", lookups.bloom(keys.limit(0), "k")).count() == 0


def test_findings(spark):
    known = spark.createDataFrame([("a", "open", 2), ("b", "resolved", 1), ("c", "open", 1), ("d", "resolved", 5)], "f string, status string, count int")
    found = spark.createDataFrame([("a", 3), ("b", 1), ("e", 1)], "f string, n int")
    assert rows(lookups.reconcile(known, found, "f")) == [("a", "open", 5, "unchanged"), ("b", "open", 2, "reopened"), ("c", "resolved", 1, "resolved"), ("d", "resolved", 5, "unchanged"), ("e", "open", 1, "detected")]
    assert ("c", "open", 1, "unchanged") in rows(lookups.reconcile(known, found, "f", F.lit(True)))


def test_small_ones(spark):
    q = spark.createDataFrame([(1, ["a", "b", "b"]), (2, ["a"]), (3, None)], "id int, w array<string>")
    t = spark.createDataFrame([("x", ["a", "b"]), ("w", ["b", "a", "c"])], "t string, terms array<string>")
    assert rows(lookups.best_template(q, "id", "w", t, "t", "terms").select("id", "t", "shared")) == [(1, "w", 2)]
    at = dt.datetime(2024, 1, 1)
    le = spark.createDataFrame([(1, at, 60), (2, at, 61), (3, None, 5)], "id int, g timestamp, ttl int")
    got = {r.id: r.state for r in lookups.leases(le, "g", "ttl", F.lit("2024-01-01 00:01:00").cast("timestamp")).collect()}
    assert got[1] == "expired" and got[2] == "valid"
    assert lookups.page(spark.range(500), ["id"], 0).count() == 1 and lookups.page(spark.range(500), ["id"], 900).count() == 100
    lo = spark.createDataFrame([("t", "a.py"), ("t", "b.md"), ("t", "c"), ("t", "a.py")], "g string, f string")
    assert rows(lookups.utilisation(lo, lo.where("f = 'a.py'"), ["g"], "f")) == [("t", 3, 1, 0.3333, "*.md")]


def test_nearest_through_anchors(spark):
    import numpy as np

    x = np.random.default_rng(1).standard_normal((400, 6)).astype("float32")
    v = spark.createDataFrame([(i, [float(a) for a in r]) for i, r in enumerate(x)], "id int, v array<float>")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = np.argsort(-(u @ u[7]), kind="stable")[:10].tolist()
    assert [r.id for r in by_planes(v, "id", "v", [float(a) for a in x[7]], 10).collect()] == want


def test_as_of_over_buckets(spark):
    day = lambda n, h=0: dt.datetime(2024, 1, 1) + dt.timedelta(days=n, hours=h)
    a = spark.createDataFrame([(1, "k", day(0)), (2, "k", day(100)), (3, "k", day(400)), (4, "m", day(5)), (5, None, day(5)), (6, "k", day(99, 23))], "id int, k string, t timestamp")
    b = spark.createDataFrame([("k", day(0, 1), 10), ("k", day(99, 23), 20), ("k", day(99, 23), 21), ("k", day(101), 30), (None, day(1), 9)], "k string, at timestamp, v int")
    assert rows(joins.as_of(a, b, ["k"], "t", "at", ["v"]).select("id", "v")) == [(1, None), (2, 21), (3, 30), (4, None), (5, None), (6, 21)]


def test_sessions_and_counts_over_buckets(spark):
    hour = lambda n: dt.datetime(2024, 1, 1) + dt.timedelta(hours=n)
    e = spark.createDataFrame([("k", hour(h)) for h in [0, 1, 23, 24, 25, 47, 49, 100, 101, 130]] + [("m", hour(3)), ("m", None)], "k string, t timestamp")
    whole = rows(sequence.sessions(e, ["k"], "t", 4 * 3600, bucket=10**9))
    assert rows(sequence.sessions(e, ["k"], "t", 4 * 3600, bucket=86400)) == whole and len(whole) == 6
    for bucket in (3600, 86400):
        got = sequence.rolling_count(e, ["k"], "t", 2 * 3600, bucket=bucket)
        assert got.columns == ["k", "t", "calls"] and rows(got.where("t is not null")) == rows(sequence.rolling_count(e, ["k"], "t", 2 * 3600, bucket=10**9).where("t is not null"))


def test_parsers_and_rules(spark):
    md = "# A\n\nfirst\nmore\n\n## B c\nsecond\n\n\nthird"
    d = spark.createDataFrame([(1, md), (2, ""), (3, None)], "id int, t string")
    assert rows(parse.paragraphs(d, "id", "t")) == [(1, 3, "A", "first\nmore"), (1, 7, "B c", "second"), (1, 10, "B c", "third")]
    py = "import os.path\nfrom a.b import c\nfrom . import d\n\n\nclass A:\n    def m(self):\n        return os.x(1)\n"
    f = spark.createDataFrame([("r", "a.py", py, [8]), ("r", "b.py", "def (", [1])], "repo string, path string, text string, lines array<int>")
    assert rows(parse.python_top_imports(f)) == [("r", "a.py", "a"), ("r", "a.py", "os")]
    got = rows(parse.python_loci(f))
    assert got[0][3] == "Attribute:m" or got[0][3].endswith(":m")
    assert got[1][3] == "parse_error:global"
    assert rows(parse.dispatched(f.unionByName(f.where("path = 'b.py'").withColumn("path", F.lit("x.md")).withColumn("text", F.lit("# a\n## b\n")))))[2][2:] == ("headings", 2)
    u = spark.createDataFrame([('{"usage": {"input_tokens": 1000000, "output_tokens": 2}, "total_cost_usd": null}',), ('{"usage": {"input_tokens": 1}, "total_cost_usd": 0.5}',), ("no json",), (None,)], "raw string")
    assert [tuple(r[0]) for r in u.select(U.usage(F.col("raw"), 3.0, 15.0)).collect()] == [(1000002, 3.00003), (1, 0.5), (None, None), (None, None)]
    body = "Tags: one\nFiles:\n- a.py\n- b.py\n\nTests:\n- t\n"
    r = spark.range(1).select(U.labelled(F.lit(body), "Files", 8), U.labelled(F.lit(body), "Tags", 1), U.labelled(F.lit(body), "Other", 3), U.anchored(F.lit("b  c"), F.lit("a b\nc d"), F.lit(0), F.lit(7)), U.anchored(F.lit("b"), F.lit("a b"), F.lit(0), F.lit(9))).first()
    assert r[0] == ["a.py", "b.py"] and r[1] == ["one"] and r[2] == [] and r[3] and not r[4]
    c = spark.createDataFrame([(" e\u0301 \t x\r\n\u00a0y ",), (None,), ("",)], "t string").select(N.canonical(F.col("t")), N.query_key(F.col("t"))).collect()
    assert c[0][0] == "\u00e9 x\ny" and c[1][0] is None and c[1][1] is None and c[2][0] == ""


def test_plug_ins(spark):
    memo, calls = Memo(), []

    @memo.cached("x")
    def f(s, n):
        calls.append(n)
        return s.range(n)

    assert f(spark, 3).count() == f(spark, 3).count() == 3 and f(spark, 4).count() == 4 and calls == [3, 4] and memo.hits == 1
    t = Tools()
    t.tool("r", "rows")(lambda s, d, n=5: s.range(n))
    assert t.call(spark, "", '{"tool": "r", "limit": 2, "arguments": {"n": 9}}') == '{"rows": [{"id": 0}, {"id": 1}]}'
    assert "error" in t.call(spark, "", "no json") and "error" in t.call(spark, "", '{"tool": "none"}')
