import os

from pyspark.sql import functions as F

from lodestrata.sources import files as S
from lodestrata.streaming.events import drain
from lodestrata.streaming.tables import Versions, learned_threshold, replace_rows


def test_tree_is_written_listed_and_scanned(spark, tmp_path):
    root = f"file://{tmp_path}"
    f = spark.createDataFrame([("r", "a/b.py", "import os\n"), ("r", "pyproject.toml", "[x]\n"), ("r", ".env", "K=1"), ("r", "_x/c.py", ""), ("r", "k.md", "-----BEGIN RSA PRIVATE KEY-----"), ("q", "node_modules/z.js", "1"), ("q", "n.py", "a\0b"), ("q", "big.sql", "x" * 50), ("q", "../up.py", "no"), (None, "a.py", "no"), ("q", None, "no")], "repo string, path string, text string")
    assert S.write_tree(f, root) == 8
    assert sorted(os.listdir(tmp_path)) == ["q", "r"] and not any(x.endswith(".part") for _, _, n in os.walk(tmp_path) for x in n)
    assert S.repositories(root) == ["q", "r"] and S.repositories(root, ["r*"], []) == ["r"] and S.repositories(root, ["*"], ["r"]) == ["q"]
    good, skipped = S.scan(spark, root, most_bytes=40)
    assert sorted(tuple(x) for x in good.select("repo", "path", "text").collect()) == [("r", "a/b.py", "import os\n"), ("r", "pyproject.toml", "[x]\n")]
    assert sorted(tuple(x) for x in skipped.collect()) == [("q", "big.sql", "too_large"), ("q", "n.py", "binary"), ("q", "node_modules/z.js", "excluded"), ("r", ".env", "sensitive_path"), ("r", "_x/c.py", "empty"), ("r", "k.md", "sensitive_content")]
    found = {r.repo: r.languages for r in S.discover(S.listed(spark, root)).collect()}
    assert found == {"r": ["python"]}
    sig = {r.repo: (r.languages, r.frameworks) for r in S.signature(f.where("repo is not null and path is not null"), ["import os", "zzz"]).collect()}
    assert sig == {"r": (["python"], ["import os"]), "q": ([], [])}
    assert S.bounded(S.listed(spark, root), depth=0, most=1).count() == 2
    os.symlink(tmp_path / "r", tmp_path / "r" / "loop")
    assert S.listed(spark, root).count() < 40


def test_small_files(spark, tmp_path):
    at = f"file://{tmp_path}/x/y.json"
    S.write_json({"a": [1, "é"]}, at)
    S.write_json({"a": 2}, at)
    assert S.read_json(at) == {"a": 2} and os.listdir(tmp_path / "x") == ["y.json"]
    (tmp_path / "log").write_text("first\nsecond\nthird\n")
    assert S.tail_lines(f"file://{tmp_path}/log", 9) == ["third"] and S.tail_lines(f"file://{tmp_path}/log") == ["first", "second", "third"] and S.tail_lines(f"file://{tmp_path}/none") == []


def test_sync_and_cache(spark):
    i = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "id int, h string")
    got = S.sync(i, spark.createDataFrame([(2, "B"), (4, "d"), (5, "e")], "id int, h string"), spark.createDataFrame([(3,), (5,)], "id int"), ["id"])
    assert sorted(map(tuple, got.collect())) == [(1, "a"), (2, "B"), (4, "d")]
    c = S.cache_state(i.unionByName(spark.createDataFrame([(9, None)], "id int, h string")), spark.createDataFrame([(1, "a"), (2, "x"), (9, None)], "id int, h string"), ["id"], "h")
    assert {r.id: r.state for r in c.collect()} == {1: "hit", 2: "stale", 3: "compile", 9: "hit"}


def test_chunks_are_linear_and_exact(spark):
    text = "".join(f"line {k} é\n" for k in range(150)) + "end"
    f = spark.createDataFrame([("r", "a.txt", text), ("r", "b.txt", " \n\n"), ("r", "c.txt", None), ("r", "d.txt", "")], "repo string, path string, text string")
    c = sorted(S.chunks(f, 40, 8).collect(), key=lambda r: r.chunk_index)
    data = text.encode()
    assert [r.chunk_index for r in c] == list(range(len(c))) and c[0].start_byte == 0 and c[-1].end_byte == len(data) and {r.path for r in c} == {"a.txt"}
    assert all(data[r.start_byte : r.end_byte].decode() == r.text for r in c) and all(a.end_byte > b.start_byte for a, b in zip(c, c[1:], strict=False))


def test_versions_follow_a_stream(spark, tmp_path):
    at = lambda x: f"file://{tmp_path}/{x}"
    v = Versions(spark, at("t"), "k string, n int")
    step = replace_rows(["k"], ["o"], "gone")
    kind = "k string, n int, o int, gone boolean"
    for rows in ([("a", 1, 1, False), ("b", 1, 1, False), ("a", 2, 2, False)], [("b", 0, 2, True), ("c", 3, 1, False)]):
        spark.createDataFrame(rows, kind).write.mode("append").parquet(at("in"))
        out = v.follow(spark.readStream.schema(kind).parquet(at("in")), at("s"), step)
    assert sorted(map(tuple, out.collect())) == [("a", 2), ("c", 3)]
    # Nothing new makes no version.
    assert sorted(map(tuple, v.follow(spark.readStream.schema(kind).parquet(at("in")), at("s"), step).collect())) == [("a", 2), ("c", 3)]
    assert v.latest(1).count() == 2


def test_thresholds_of_stream_and_batch_agree(spark, tmp_path):
    from lodestrata.operators.sequence import adaptive_threshold

    e = spark.range(300).select((F.col("id") % 3).alias("u"), F.timestamp_seconds("id").alias("ts"), F.col("id").alias("event_id"), (F.col("id") % 7 != 0).alias("hit"))
    e.write.parquet(f"{tmp_path}/in")
    s = drain(learned_threshold(spark.readStream.schema(e.schema).parquet(f"{tmp_path}/in"), "u", target=0.7), f"file://{tmp_path}/s", "update")
    assert sorted(tuple(r)[:4] for r in s.collect()) == sorted(map(tuple, adaptive_threshold(e, ["u"], ["ts", "event_id"], "hit", target=0.7).collect()))
