import itertools
import random
from collections import defaultdict

import numpy as np

from lodestrata.llm import cooccur, knn, mix, queries


def test_cooccurrence_against_brute_force(spark):
    rng = random.Random(3)
    rows = []
    for k in range(300):
        n = 150 if k % 60 == 0 else rng.randrange(0, 7)
        files = [f"f{min(rng.randrange(40), rng.randrange(160))}" for _ in range(n)]
        rows.append(("r" if k % 3 else "q", f"s{k}", [*files, None, " ", *(["./" + files[0].replace("/", "\\")] if files else [])], ["g1", "g2"] if k % 2 else None))
    rows += [rows[1], ("r", None, ["a"], None), (None, "x", ["a"], None), ("r", "new", None, None)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "repo string, sha string, files array<string>, functions array<string>, n int")
    got = {tuple(r)[:4]: (r.n_ab, r.n_a, r.n_b, r.n) for r in cooccur.cooccurrence(df, 4, block=8).collect()}
    baskets = defaultdict(set)
    for repo, sha, files, functions in rows:
        if repo and sha:
            for kind, items in (("file", files), ("function", functions)):
                for x in items or []:
                    if x and x.strip():
                        baskets[kind, repo, sha].add(x.strip().removeprefix("./") if kind == "file" else x)
    n, single, pair = defaultdict(int), defaultdict(int), defaultdict(int)
    for (kind, repo, _), items in baskets.items():
        n[kind, repo] += 1
        for x in items:
            single[kind, repo, x] += 1
        for a, b in itertools.combinations(sorted(items), 2):
            pair[kind, repo, a, b] += 1
    want = {k: (c, single[k[0], k[1], k[2]], single[k[0], k[1], k[3]], n[k[:2]]) for k, c in pair.items() if c >= 4}
    assert got == want and len(want) > 100
    lifted = {tuple(r) for r in cooccur.associated(df).collect()}
    assert lifted == {k for k, (c, a, b, m) in want.items() if c * m >= 3 * a * b}
    assert cooccur.cooccurrence(df.limit(0)).count() == 0


def test_registered_pairs_hold_rare_ones(spark, tmp_path):
    rows = [("r", "s1", ["a", "b", "c"], None), ("r", "s2", ["./a", "b"], ["f", "g"]), ("r", "s3", ["d"], None)]
    spark.createDataFrame(rows, "repo string, sha string, files array<string>, functions array<string>").write.parquet(str(tmp_path / "commit_nodes.parquet"))
    got = {(r.item_kind, r.item_a, r.item_b): (r.n_ab, r.n_a, r.n_b, r.n) for r in queries.queries()["p5_pairs"](spark, str(tmp_path)).collect()}
    assert got == {("file", "a", "b"): (2, 2, 2, 3), ("file", "a", "c"): (1, 2, 1, 3), ("file", "b", "c"): (1, 2, 1, 3), ("function", "f", "g"): (1, 1, 1, 1)}


def test_nearest_against_brute_force(spark):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((600, 16)).astype(np.float32)
    x[300:320] = x[:20] * 3.0
    x[400:412] = x[400]
    rows = [(i, "m", 16, [float(v) for v in r], "t") for i, r in enumerate(x)]
    rows += [(1000, "m", 16, None, ""), (1001, "m", 16, [0.0] * 16, ""), (1002, "m", 16, [1.0] * 15, ""), (1003, "m", 16, [float("nan")] * 16, ""), (1004, None, 16, [1.0] * 16, ""), (1005, "n", 16, [1.0] * 16, ""), (3, "m", 16, rows[3][3], "")]
    df = spark.createDataFrame(rows, "vec_id bigint, embed_model string, dim int, vector array<float>, rank string")
    u = x.astype(np.float64)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -9)
    for settings in ({}, {"cell": 64}):
        got = defaultdict(dict)
        for r in knn.nearest(df, 5, **settings).collect():
            got[r.vec_id][r.near_id] = r.cosine
        hits = total = 0
        for i in range(600):
            order = sorted(range(600), key=lambda j: (-round(s[i, j], 12), j))[:5]
            hits += len(set(order) & set(got[i]))
            total += 5
            assert len(got[i]) == 5 and all(abs(c - s[i, j]) < 1e-9 for j, c in got[i].items())
        assert hits / total > 0.97
    assert 1005 not in got and 1001 not in got
    asked = {r.vec_id for r in knn.nearest(df, 5, query_mod=20).collect()}
    assert asked == set(range(0, 600, 20))
    assert knn.nearest(df.limit(0)).count() == 0


def test_recall_holds_where_cells_are_skipped(spark):
    rng = np.random.default_rng(8)
    x = rng.standard_normal((3000, 12)).astype(np.float32)
    x[:1500] = x[1500:] + 0.3 * rng.standard_normal((1500, 12)).astype(np.float32)
    df = spark.createDataFrame([(i, "m", 12, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id bigint, embed_model string, dim int, vector array<float>")
    u = knn.unit(x)
    s = u @ u.T
    np.fill_diagonal(s, -9)
    order = np.argsort(-s, axis=1)[:, :5]
    reps = df.select(knn.F.lit(0).alias("gid"), knn.F.col("vec_id").alias("id"), "vector", knn.F.lit(True).alias("ask"))
    models = knn._fitted(reps, 8)
    assert len(models[0].centres) > 300
    for least, bound in ((-2.0, 0.93), (0.9, 0.98)):
        got = defaultdict(set)
        for r in knn.nearest(df, 5, cell=8, least=least).collect():
            got[r.vec_id].add(r.near_id)
        want = [(i, j) for i in range(3000) for j in order[i].tolist() if s[i, j] >= least]
        assert all(len(v) <= 5 for v in got.values()) and len(want) > 1500
        assert sum(j in got[i] for i, j in want) / len(want) > bound


def test_two_levels_of_centres_agree_with_one():
    rng = np.random.default_rng(2)
    x = knn.unit(rng.standard_normal((4000, 8))).astype(np.float32)
    m = knn.Model(x, 4000, 8, 400, 10)
    flat = m.ranked(x[:200], 5)
    m.FLAT = 10
    deep = m.ranked(x[:200], 5)
    assert (flat[:, 0] == deep[:, 0]).mean() > 0.9
    assert all(len(set(r)) == 5 and (r >= 0).all() for r in deep.tolist() for r in [np.array(r)])


def test_error_bounds_hold():
    rng = np.random.default_rng(5)
    raw = rng.standard_normal((400, 32)).astype(np.float32)
    x, c = knn.unit(raw), 0.2 * knn.unit(rng.standard_normal((1, 32)))[0]
    p = knn.rotation(32)
    assert np.allclose(p @ p.T, np.eye(32), atol=1e-4)
    r = x - c
    code, size, along = knn.encode(r, 32), np.linalg.norm(r, axis=1), x @ c
    differ = np.bitwise_count(code[:, None] ^ code[None]).sum(axis=2)
    upper = along[None] + (r @ c)[:, None] + size[:, None] * size[None] * knn.highest_cosine(knn.bits_of(32))[differ]
    assert (x @ x.T <= upper + 1e-9).mean() > 0.99
    # The bound leaves few to compare.
    cell = knn.Cell(np.arange(400), raw, code, size, along, c)
    kept = [len(cell.candidates(code[i], float(size[i]), float(r[i] @ c), 0.6)) for i in range(400)]
    assert np.mean(kept) < 60


def test_mixture(spark):
    rng = random.Random(6)
    vocab = {"Docs ": "alpha beta gamma guide", "code": "def return import x y", " LOG": "error warn info at line"}
    rows = []
    for i in range(600):
        s = rng.choice(["Docs ", "code", "code", "code", " LOG"])
        text = " ".join(rng.choice(vocab[s].split()) for _ in range(rng.randrange(20, 60)))
        rows.append((i, text, None if i % 20 == 0 else s, 1))
    rows += [(9001, None, "code", 1), (9002, "", None, 1), (9003, "alien words", "other", 1), (5, rows[5][1], rows[5][2], 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, tokens int")
    goals = spark.createDataFrame([("m", "docs", 0.4, 4), ("m", "code", 0.4, 2), ("m", "log", 0.2, 4), ("far", "docs", 0.9, 1), ("far", "log", 0.1, 9)], "mix_id string, source string, target_share double, max_repeats int")
    out = {(r.mix_id, r.source): r for r in mix.report(docs, goals).collect()}
    assert all(abs(out["m", s].share_reached - t) < 0.01 for s, t in (("docs", 0.4), ("code", 0.4), ("log", 0.2)))
    assert not out["far", "docs"].reachable and out["far", "docs"].share_reached < 0.9
    taken = mix.taken(docs, goals)
    top = {r.mix_id: r.m for r in taken.groupBy("mix_id").agg({"copies": "max"}).withColumnRenamed("max(copies)", "m").collect()}
    assert top["m"] <= 4 and taken.where("doc_id in (9001, 9002, 9003)").count() == 0
    assert mix.taken(docs.limit(0), goals).count() == 0
    sources = ["code", "docs", "log"]
    assert mix.classifier(mix.read(docs, sources, mix.VOCABULARY), sources)[1] > 0.9
    # The same rows however the documents are spread.
    rows = lambda d: sorted(map(tuple, mix.taken(d, goals).select("mix_id", "doc_id", "copies").collect()))
    assert rows(docs.repartition(7)) == rows(docs.coalesce(1)) == rows(docs.orderBy("text"))
    # With labels trusted in part, memberships are soft and expected shares still meet their targets.
    out = {(r.mix_id, r.source): r for r in mix.report(docs, goals, trust=0.5).collect()}
    assert all(abs(out["m", s].share_reached - t) < 0.02 for s, t in (("docs", 0.4), ("code", 0.4), ("log", 0.2)))


def test_mixture_goes_by_every_text(spark):
    rng = random.Random(7)
    say = lambda words: " ".join(rng.choice(words.split()) for _ in range(40))
    rows = [(i, say("alpha beta gamma guide"), "docs") for i in range(300)] + [(300 + i, say("def return import x"), "code") for i in range(300)]
    # Documents of one source that read like the other.
    rows += [(1000 + i, say("def return import x"), "docs") for i in range(60)] + [(2000, None, "docs"), (2001, "", "code")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    goals = spark.createDataFrame([("m", "docs", 0.2, 4), ("m", "code", 0.8, 4)], "mix_id string, source string, target_share double, max_repeats int")
    assert [r.doc_id for r in mix.read(docs, ["code", "docs"], mix.VOCABULARY).where("x is null").collect()] == [2000]
    copies = {r.doc_id: r.copies for r in mix.taken(docs, goals).collect()}
    mean = lambda ids: sum(copies.get(i, 0) for i in ids) / len(ids)
    assert mean(range(1000, 1060)) > 2 * mean(range(300)) and max(copies.values()) <= 4
    # Shares are by the sources told.
    out = {r.source: r.share_reached for r in mix.report(docs, goals).collect()}
    assert abs(out["docs"] - 0.2) < 0.01 and abs(out["code"] - 0.8) < 0.01


def test_posteriors_know_how_common_a_source_is(spark):
    docs = spark.createDataFrame([(i, "the same words", "rare" if i % 10 == 0 else "common") for i in range(1000)], "doc_id bigint, text string, source string")
    weights, _ = mix.classifier(mix.read(docs, ["common", "rare"], mix.VOCABULARY, sample=50), ["common", "rare"], sample=50)
    assert abs(mix.soft(mix.features("the same words"), weights)[1] - 0.1) < 0.03
