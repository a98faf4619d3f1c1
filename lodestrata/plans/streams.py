"""Streaming queries run to the end of what is there, so that they compare with their batch statements."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestrata.plans.ledgers import THRESHOLDS
from lodestrata.plans.registry import Registry
from lodestrata.runtime import shared_path, table
from lodestrata.streaming import events as E

R = Registry()


def _run(s, stream, mode: str):
    return E.drain(stream, shared_path(s, "stream"), mode)


@R.query("sm12_tumbling", "SELECT date_trunc('day', ts)::TIMESTAMP AS day, event_type, count(*)::BIGINT AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def _(s, d):
    t = _run(s, E.tumbling(E.read(s, d)), "complete")
    return t.select(F.col("start").cast("timestamp_ntz").alias("day"), "event_type", "n", "total")


@R.query("sm02_outcomes", "SELECT event_id, user_id, CASE WHEN event_type IN ('purchase', 'signup') THEN 'pass' ELSE 'fail' END AS outcome FROM events WHERE event_type IN ('purchase', 'signup', 'error')")
def _(s, d):
    return _run(s, E.outcomes(E.read(s, d)), "append").select("event_id", "user_id", "outcome")


@R.query("sm09_open_state", "SELECT user_id, arg_max(event_type, (ts, event_id)) = 'error' AS open, count_if(event_type = 'error')::BIGINT AS errors FROM events WHERE user_id IS NOT NULL GROUP BY user_id")
def _(s, d):
    t = _run(s, E.open_state(E.read(s, d)), "update")
    return t.groupBy("user_id").agg(F.max_by(F.struct("open", "errors"), "_batch").alias("x")).select("user_id", "x.open", "x.errors")


_LINES = "l AS (SELECT doc_id, unnest(string_split(replace(text, chr(13), ''), chr(10))) AS x FROM documents WHERE text IS NOT NULL)"


@R.query("sm01_mined", f"WITH {_LINES} SELECT doc_id, count_if(contains(lower(x), 'error') OR contains(lower(x), 'fail'))::BIGINT AS failed, count_if(contains(lower(x), 'pass') OR contains(lower(x), 'ok'))::BIGINT AS passed FROM l WHERE contains(lower(x), 'error') OR contains(lower(x), 'fail') OR contains(lower(x), 'pass') OR contains(lower(x), 'ok') GROUP BY doc_id")
def _(s, d):
    """Outcomes mined from lines of logs by what they say; every new line once, none lost beyond a cap."""
    at = shared_path(s, "lines")
    t = table(s, d, "documents").where("text is not null").select("doc_id", F.explode(F.split(F.replace("text", F.lit("\r"), F.lit("")), "\n")).alias("x"))
    t.write.mode("append").parquet(at)
    low = F.lower("x")
    failed, passed = F.contains(low, F.lit("error")) | F.contains(low, F.lit("fail")), F.contains(low, F.lit("pass")) | F.contains(low, F.lit("ok"))
    lines = s.readStream.schema("doc_id bigint, x string").parquet(at).select("doc_id", failed.alias("f"), passed.alias("p")).where("f or p")
    return _run(s, lines, "append").groupBy("doc_id").agg(F.count_if("f").alias("failed"), F.count_if("p").alias("passed"))


@R.query("sm03_rebuilds", "SELECT 0::BIGINT AS build, count(*)::BIGINT AS files FROM (SELECT DISTINCT repo, path FROM source_files WHERE path LIKE '%.py') UNION ALL SELECT 1, count(*)::BIGINT FROM (SELECT DISTINCT repo, path FROM source_files WHERE path NOT LIKE '%.py')")
def _(s, d):
    """A watcher that rebuilds when files have come: one build for the first files, one for those that came later."""
    at, state = shared_path(s, "watched"), shared_path(s, "stream")
    f = table(s, d, "source_files").select("repo", "path").distinct()
    q = lambda: s.readStream.schema("repo string, path string").parquet(at)
    f.where(F.col("path").endswith(".py")).write.mode("append").parquet(at)
    E.drain(q(), state)
    f.where(~F.col("path").endswith(".py")).write.mode("append").parquet(at)
    return E.drain(q(), state).groupBy(F.col("_batch").alias("build")).agg(F.count(F.lit(1)).alias("files"))


@R.query("sm04_changes", "SELECT CASE WHEN path LIKE '%.json' THEN 'changed' WHEN path LIKE '%.md' THEN 'deleted' ELSE 'unchanged' END AS change, count(*)::BIGINT AS n FROM (SELECT DISTINCT repo, path FROM source_files) GROUP BY 1 UNION ALL SELECT 'added', count(DISTINCT repo)::BIGINT FROM source_files")
def _(s, d):
    """Fingerprints (size and content) of a tree at two times, compared."""
    from lodestrata.operators.joins import snapshot_diff
    from lodestrata.plans.code import source
    from lodestrata.sources import files as S

    f = source(s, d).select("repo", "path", "text")
    before, after = shared_path(s, "tree"), shared_path(s, "tree")
    S.write_tree(f, before)
    p = F.col("path")
    later = f.where(~p.endswith(".md")).withColumn("text", F.when(p.endswith(".json"), F.concat("text", F.lit(" "))).otherwise(F.col("text")))
    S.write_tree(later.unionByName(f.select("repo", F.lit("NEW.txt").alias("path"), F.lit("x").alias("text")).distinct()), after)
    marked = lambda at: S.contents(S.listed(s, at).select("repo", "path", "size"), at).select(F.concat_ws(":", "repo", "path").alias("id"), F.concat_ws("-", "size", F.sha2("content", 256)).alias("mark"))
    return snapshot_diff(marked(before), marked(after), "id", "mark").groupBy("change").agg(F.count(F.lit(1)).alias("n"))


@R.query("sm05_mining_cursors", "SELECT repo, branch, arg_max(sha, (committed_at, sha)) AS last_sha FROM commit_nodes GROUP BY repo, branch")
def _(s, d):
    """Mining in two cycles, each of which takes only commits that are new: the cursor of every branch."""
    from lodestrata.streaming.tables import Versions

    at = shared_path(s, "commits")
    c = table(s, d, "commit_nodes").select("repo", "branch", "sha", "committed_at").distinct()
    v = Versions(s, shared_path(s, "cursors"), "repo string, branch string, sha string, committed_at timestamp")
    state = shared_path(s, "stream")

    def step(have, batch):
        both = have.unionByName(batch.select(*have.columns))
        return both.groupBy("repo", "branch").agg(F.max(F.struct("committed_at", "sha")).alias("x")).select("repo", "branch", "x.sha", "x.committed_at")

    for half in (0, 1):
        c.where(F.pmod(F.xxhash64("sha"), F.lit(2)) == half).write.mode("append").parquet(at)
        out = v.follow(s.readStream.schema(c.schema).parquet(at), state, step)
    return out.select("repo", "branch", F.col("sha").alias("last_sha"))


@R.query("sm06_embedded", "WITH c AS (SELECT DISTINCT chunk_id, chunk_index, text FROM chunks) SELECT chunk_id, length(text)::BIGINT + CASE WHEN chunk_index % 2 = 0 THEN 1 ELSE 0 END AS size FROM c WHERE chunk_index % 3 <> 2")
def _(s, d):
    """An index of embedded chunks kept up to date: all chunks first, then changed ones embedded again and deleted ones taken out."""
    from lodestrata.functions.embed import embedder
    from lodestrata.streaming.tables import Versions, replace_rows

    at, state = shared_path(s, "chunks"), shared_path(s, "stream")
    c = table(s, d, "chunks").select("chunk_id", "chunk_index", "text").distinct()
    v = Versions(s, shared_path(s, "index"), "chunk_id string, size bigint, vector array<float>")
    step = replace_rows(["chunk_id"], ["version"], "gone")
    embed = embedder(32)
    first = c.select("chunk_id", "text", F.lit(0).alias("version"), F.lit(False).alias("gone"))
    second = c.where("chunk_index % 2 = 0 or chunk_index % 3 = 2").select("chunk_id", F.concat("text", F.lit("!")).alias("text"), F.lit(1).alias("version"), (F.col("chunk_index") % 3 == 2).alias("gone"))
    for rows in (first, second):
        rows.write.mode("append").parquet(at)
        q = s.readStream.schema(first.schema).parquet(at)
        out = v.follow(q, state, lambda have, batch: step(have, batch.select("chunk_id", F.length("text").cast("bigint").alias("size"), embed(F.col("text")).cast("array<float>").alias("vector"), "version", "gone")))
    return out.select("chunk_id", "size")


@R.query("sm10_findings", """WITH e AS (SELECT user_id, CASE WHEN extract(day FROM ts) <= 2 THEN 1 WHEN extract(day FROM ts) <= 4 THEN 2 ELSE 3 END AS scan FROM events WHERE event_type = 'error' AND user_id IS NOT NULL AND extract(day FROM ts) <= 6), n AS (SELECT user_id, count(*)::BIGINT AS count, bool_or(scan = 1) AS a, bool_or(scan = 2) AS b, bool_or(scan = 3) AS c FROM e GROUP BY user_id)
SELECT user_id, CASE WHEN c THEN 'open' ELSE 'resolved' END AS status, count, (CASE WHEN a AND NOT b AND c THEN 1 ELSE 0 END)::BIGINT AS reopened FROM n""")
def _(s, d):
    """Findings over three scans: opened when they are seen, resolved when a scan no longer shows them, opened again when one does."""
    from lodestrata.operators.lookups import reconcile
    from lodestrata.streaming.tables import Versions

    at, state = shared_path(s, "scans"), shared_path(s, "stream")
    day = F.dayofmonth("ts")
    e = table(s, d, "events").where((F.col("event_type") == "error") & F.col("user_id").isNotNull() & (day <= 6)).select("user_id", F.when(day <= 2, 1).when(day <= 4, 2).otherwise(3).alias("scan"))
    v = Versions(s, shared_path(s, "findings"), "user_id bigint, status string, count bigint, reopened bigint")

    def step(have, batch):
        r = reconcile(have, batch.groupBy("user_id").agg(F.count(F.lit(1)).alias("n")), "user_id")
        again = F.coalesce("reopened", F.lit(0)) + F.when(F.col("change") == "reopened", 1).otherwise(0)
        return r.join(have.select("user_id", "reopened"), "user_id", "left").select("user_id", "status", "count", again.cast("bigint").alias("reopened"))

    for k in (1, 2, 3):
        e.where(F.col("scan") == k).write.mode("append").parquet(at)
        out = v.follow(s.readStream.schema(e.schema).parquet(at), state, step)
    return out


@R.query("sm11_thresholds", THRESHOLDS)
def _(s, d):
    """Thresholds learned from a stream of hits; the same as the batch fold gives."""
    from lodestrata.streaming.tables import learned_threshold

    e = E.read(s, d).withColumn("hit", F.col("event_type") != "error")
    t = _run(s, learned_threshold(e, "user_id"), "update")
    return t.groupBy("user_id").agg(F.max_by(F.struct("samples", "hit_rate", "threshold"), "_batch").alias("x")).select("user_id", "x.*")
