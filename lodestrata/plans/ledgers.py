"""Queries over event logs and run ledgers."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestrata.operators import joins, sequence
from lodestrata.plans.registry import Registry
from lodestrata.runtime import table

R = Registry()

RUN = "ts string, event string, worker string, tier string, total_tokens bigint, cost_usd double, status string, note string"
_LINES = """l AS (SELECT doc_id, i::BIGINT AS pos, x FROM (SELECT doc_id, unnest(string_split(replace(text, chr(13), ''), chr(10))) AS x, generate_subscripts(string_split(replace(text, chr(13), ''), chr(10)), 1) AS i FROM documents WHERE text IS NOT NULL) WHERE starts_with(ltrim(x), '{') AND json_valid(x) AND json_extract_string(x, '$.event') IS NOT NULL),
r AS (SELECT doc_id, pos, json_extract_string(x, '$.ts') AS ts, json_extract_string(x, '$.event') AS event, json_extract_string(x, '$.worker') AS worker, json_extract_string(x, '$.tier') AS tier, json_extract_string(x, '$.total_tokens')::BIGINT AS total_tokens, json_extract_string(x, '$.cost_usd')::DOUBLE AS cost_usd, json_extract_string(x, '$.status') AS status FROM l)"""


def runs(s, d):
    """Rows of the run ledger: lines of JSON inside texts; lines that are none are left out."""
    lines = table(s, d, "documents").where("text is not null").select("doc_id", F.posexplode(F.split(F.replace("text", F.lit("\r"), F.lit("")), "\n")).alias("p", "x"))
    rows = lines.where(F.ltrim("x").startswith("{") & F.get_json_object("x", "$.event").isNotNull() & (F.get_json_object("x", "$") != "") & F.get_json_object("x", "$").isNotNull())
    rows = rows.select("doc_id", (F.col("p") + 1).cast("bigint").alias("pos"), F.from_json("x", RUN + ", _corrupt_record string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}).alias("r"))
    return rows.select("doc_id", "pos", "r.*").where("_corrupt_record is null").drop("_corrupt_record")


def events(s, d):
    return table(s, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))


@R.query("src11_run_rows", f"WITH {_LINES} SELECT doc_id, pos, event, worker, tier, total_tokens, cost_usd, status FROM r")
def _(s, d):
    return runs(s, d).select("doc_id", "pos", "event", "worker", "tier", "total_tokens", "cost_usd", "status")


@R.query("ag09_worker_totals", f"WITH {_LINES} SELECT coalesce(worker, 'unknown') AS worker, count(*)::BIGINT AS rows_, sum(coalesce(total_tokens, 0))::BIGINT AS tokens, round(sum(coalesce(cost_usd, 0)), 4) AS cost FROM r GROUP BY 1")
def _(s, d):
    g = runs(s, d).groupBy(F.coalesce("worker", F.lit("unknown")).alias("worker"))
    return g.agg(F.count(F.lit(1)).alias("rows_"), F.sum(F.coalesce("total_tokens", F.lit(0))).alias("tokens"), F.round(F.sum(F.coalesce("cost_usd", F.lit(0.0))), 4).alias("cost"))


@R.query("ag10_cost_by_day", f"WITH {_LINES} SELECT coalesce(substr(ts, 1, 10), '(all)') AS day, coalesce(tier, '(all)') AS tier, sum(total_tokens)::BIGINT AS tokens, round(sum(cost_usd), 4) AS cost FROM r WHERE ts IS NOT NULL AND tier IS NOT NULL GROUP BY ROLLUP (substr(ts, 1, 10), tier)")
def _(s, d):
    r = runs(s, d).where("ts is not null and tier is not null").select(F.substring("ts", 1, 10).alias("day"), "tier", "total_tokens", "cost_usd")
    g = r.rollup("day", "tier").agg(F.sum("total_tokens").alias("tokens"), F.round(F.sum("cost_usd"), 4).alias("cost"))
    return g.select(F.coalesce("day", F.lit("(all)")).alias("day"), F.coalesce("tier", F.lit("(all)")).alias("tier"), "tokens", "cost")


@R.query("sc51_list_price", f"WITH {_LINES}, p AS (SELECT * FROM (VALUES ('low', 0.5), ('mid', 3.0), ('high', 15.0)) v(tier, price)) SELECT doc_id, pos, tier, (total_tokens * price)::DOUBLE AS micros FROM r JOIN p USING (tier) WHERE total_tokens IS NOT NULL")
def _(s, d):
    """Cost in millionths at a list price a million tokens, by tier: tiers without a price are left out."""
    price = F.when(F.col("tier") == "low", 0.5).when(F.col("tier") == "mid", 3.0).when(F.col("tier") == "high", 15.0)
    return runs(s, d).where(price.isNotNull() & F.col("total_tokens").isNotNull()).select("doc_id", "pos", "tier", (F.col("total_tokens") * price).alias("micros"))


@R.query("wn01_replay", f"WITH {_LINES} SELECT worker, arg_max(status, (ts, doc_id, pos)) AS status, arg_max(event, (ts, doc_id, pos)) AS event, sum(CASE WHEN event = 'usage' THEN total_tokens ELSE 0 END)::BIGINT AS used, max(ts) AS last_ts FROM r WHERE worker IS NOT NULL AND ts IS NOT NULL GROUP BY worker")
def _(s, d):
    order = F.struct("ts", "doc_id", "pos")
    r = runs(s, d).where("worker is not null and ts is not null")
    return r.groupBy("worker").agg(F.max_by("status", order).alias("status"), F.max_by("event", order).alias("event"), F.sum(F.when(F.col("event") == "usage", F.col("total_tokens")).otherwise(0)).alias("used"), F.max("ts").alias("last_ts"))


@R.query("wn05_latest_verdict", f"WITH {_LINES} SELECT worker, CASE WHEN bool_or(status = 'failed') THEN 'failed' ELSE arg_max(status, (ts, doc_id, pos)) END AS verdict FROM r WHERE event = 'gate.verdict' AND worker IS NOT NULL AND status IS NOT NULL GROUP BY worker")
def _(s, d):
    """The latest verdict of each worker; one failure sticks."""
    r = runs(s, d).where("event = 'gate.verdict' and worker is not null and status is not null")
    return r.groupBy("worker").agg(F.when(F.bool_or(F.col("status") == "failed"), "failed").otherwise(F.max_by("status", F.struct("ts", "doc_id", "pos"))).alias("verdict"))


@R.query("wn04_streaks", f"WITH {_LINES}, v AS (SELECT *, CASE status WHEN 'ok' THEN 'PASS' WHEN 'failed' THEN 'CAPITAL' ELSE 'FAIL' END AS v FROM r WHERE worker IS NOT NULL) SELECT worker, CASE WHEN bool_or(v = 'CAPITAL') THEN 0 ELSE count_if(v = 'PASS') END::BIGINT AS streak, bool_or(v = 'CAPITAL') AS revoked, arg_max(v, (ts, doc_id, pos)) AS last FROM v GROUP BY worker")
def _(s, d):
    r = runs(s, d).where("worker is not null").withColumn("v", F.when(F.col("status") == "ok", "PASS").when(F.col("status") == "failed", "CAPITAL").otherwise("FAIL"))
    return sequence.streaks(r, ["worker"], [F.col("ts"), F.col("doc_id"), F.col("pos")], "v")


THRESHOLDS = """WITH l AS (SELECT user_id, list({'n': 1::BIGINT, 'h': CASE WHEN event_type <> 'error' THEN 1 ELSE 0 END::BIGINT, 't': 0.0::DOUBLE} ORDER BY ts, event_id) AS l FROM events WHERE user_id IS NOT NULL GROUP BY user_id),
f AS (SELECT user_id, list_reduce(l, lambda a, x: {'n': a.n + 1, 'h': a.h + x.h, 't': round(least(0.9, greatest(0.15, CASE WHEN a.n + 1 >= 20 AND (a.h + x.h) / (a.n + 1) < 0.8 THEN a.t + 0.02 WHEN a.n + 1 >= 20 AND (a.h + x.h) / (a.n + 1) > 0.8 + 0.1 THEN a.t - 0.02 ELSE a.t END)), 4)}, {'n': 0::BIGINT, 'h': 0::BIGINT, 't': 0.5::DOUBLE}) AS r FROM l) SELECT user_id, r.n AS samples, round(r.h / r.n, 6) AS hit_rate, r.t AS threshold FROM f"""


@R.query("wn03_threshold", THRESHOLDS)
def _(s, d):
    e = events(s, d).where("user_id is not null").withColumn("hit", F.col("event_type") != "error")
    return sequence.adaptive_threshold(e, ["user_id"], ["ts", "event_id"], "hit")


@R.query("wn02_trend", "WITH d AS (SELECT date_trunc('day', ts) AS day, sum(value) AS v FROM events GROUP BY 1), n AS (SELECT row_number() OVER (ORDER BY day) - 1 AS x, v FROM d) SELECT round(coalesce(regr_slope(v, x), 0), 6) AS slope, round(coalesce(regr_intercept(v, x), avg(v)), 6) AS intercept, count(*)::BIGINT AS days FROM n")
def _(s, d):
    return sequence.trend(events(s, d).groupBy(F.to_date("ts").alias("day")).agg(F.sum("value").alias("v")), "day", "v")


@R.query("wn06_decay", "SELECT event_id, CASE WHEN date_diff('day', ts::DATE, DATE '2024-02-15') > 30 AND value > 0.1 THEN round(value * 0.5, 3) ELSE value END AS value FROM events")
def _(s, d):
    e = events(s, d).select("event_id", "value", F.to_date("ts").alias("day"))
    return sequence.decay(e, "value", "day", F.lit("2024-02-15").cast("date"), days=30, digits=3).select("event_id", "value")


@R.query("wn08_snapshots", "WITH m AS (SELECT event_id, user_id, ts, value, abs(value - lag(value) OVER (PARTITION BY user_id ORDER BY ts)) AS g FROM events), k AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC) AS i FROM m WHERE coalesce(g >= 10, true)) SELECT user_id, event_id, value FROM k WHERE i <= 5")
def _(s, d):
    return sequence.snapshots(events(s, d), ["user_id"], F.col("ts"), "value", gate=10).select("user_id", "event_id", "value")


@R.query("wn09_rolling", "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 HOUR PRECEDING AND CURRENT ROW)::BIGINT AS calls FROM events")
def _(s, d):
    return sequence.rolling_count(events(s, d), ["user_id"], "ts", 3600).select("event_id", "calls")


@R.query("wn12_first_seen", "SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS i FROM events) WHERE i = 1")
def _(s, d):
    return sequence.first_wins(events(s, d), ["user_id", "event_type"], [F.col("ts"), F.col("event_id")]).select("user_id", "event_type", "event_id")


@R.query("jn11_open_starts", "WITH e AS (SELECT user_id, arg_max(event_type, (ts, event_id)) AS l FROM events WHERE event_type IN ('signup', 'purchase') AND user_id IS NOT NULL GROUP BY user_id) SELECT user_id FROM e WHERE l = 'signup'")
def _(s, d):
    return joins.unmatched_starts(events(s, d), ["user_id"], "event_type", [F.col("ts"), F.col("event_id")], "signup", "purchase")


@R.query("jn_as_of", "WITH o AS (SELECT o_custkey AS user_id, o_orderdate, max(o_totalprice) AS price FROM orders GROUP BY ALL), e AS (SELECT event_id, user_id, ts - INTERVAL 9000 DAY AS t FROM events) SELECT event_id, e.user_id, price FROM e ASOF LEFT JOIN o ON e.user_id = o.user_id AND e.t >= o.o_orderdate")
def _(s, d):
    o = table(s, d, "orders").groupBy(F.col("o_custkey").alias("user_id"), F.col("o_orderdate").cast("timestamp").alias("at")).agg(F.max("o_totalprice").alias("price"))
    e = events(s, d).select("event_id", "user_id", (F.col("ts") - F.expr("interval 9000 days")).alias("t"))
    return joins.as_of(e, o, ["user_id"], "t", "at", ["price"]).select("event_id", "user_id", "price")


@R.query("sm12_sessions", "WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w >= INTERVAL 6 HOUR OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, count(*)::BIGINT AS n, (epoch_us(max(ts)) - epoch_us(min(ts)))::BIGINT AS micros FROM s GROUP BY user_id, k")
def _(s, d):
    x = sequence.sessions(events(s, d), ["user_id"], "ts", 6 * 3600)
    return x.select("user_id", "n", (F.unix_micros("end") - F.unix_micros("start")).alias("micros"))


@R.query("ag08_usage", "WITH c AS (SELECT user_id, event_type, count(*)::BIGINT AS n FROM events GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, event_type) AS i FROM c) SELECT user_id, string_agg(event_type || ':' || n, ',' ORDER BY i) AS top FROM r WHERE i <= 3 GROUP BY user_id")
def _(s, d):
    from lodestrata.operators.search import per_group

    c = events(s, d).groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
    top = per_group(c, ["user_id"], [F.desc("n"), F.col("event_type")], 3)
    return top.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("rank", F.concat_ws(":", "event_type", "n").alias("v")))).alias("v")).select("user_id", F.array_join(F.transform("v", lambda x: x["v"]), ",").alias("top"))


@R.query("ag12_error_rollup", "SELECT user_id, count(*)::BIGINT AS n, min(ts) AS first_seen, max(ts) AS last_seen FROM events WHERE event_type = 'error' GROUP BY user_id")
def _(s, d):
    return table(s, d, "events").where("event_type = 'error'").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"))


@R.query("ag17_health", "SELECT user_id, count_if(event_type = 'error')::BIGINT AS red, count_if(event_type = 'view')::BIGINT AS green, CASE WHEN bool_or(event_type = 'error' AND value > 18) THEN 'red' WHEN bool_or(event_type = 'error') THEN 'yellow' ELSE 'green' END AS status FROM events GROUP BY user_id")
def _(s, d):
    err = F.col("event_type") == "error"
    status = F.when(F.bool_or(err & (F.col("value") > 18)), "red").when(F.bool_or(err), "yellow").otherwise("green")
    return events(s, d).groupBy("user_id").agg(F.count_if(err).alias("red"), F.count_if(F.col("event_type") == "view").alias("green"), status.alias("status"))


@R.query("ag19_success_rate", "SELECT user_id, count(*)::BIGINT AS n, CASE WHEN count(*) < 3 THEN 1.0 ELSE round(avg(CASE WHEN event_type <> 'error' THEN 1.0 ELSE 0.0 END), 6) END::DOUBLE AS rate FROM events GROUP BY user_id")
def _(s, d):
    ok = F.round(F.avg(F.when(F.col("event_type") != "error", 1.0).otherwise(0.0)), 6)
    return events(s, d).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.when(F.count(F.lit(1)) < 3, 1.0).otherwise(ok).alias("rate"))


@R.query("ag20_quorum", "SELECT user_id, count_if(event_type IN ('click', 'purchase', 'signup')) >= ceil(2 * count(*) / 3.0) AS passed FROM events GROUP BY user_id")
def _(s, d):
    yes = F.count_if(F.col("event_type").isin("click", "purchase", "signup"))
    return events(s, d).groupBy("user_id").agg((yes >= F.ceil(2 * F.count(F.lit(1)) / 3)).alias("passed"))


@R.query("prj37_props", "SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k FROM events")
def _(s, d):
    return events(s, d).select("event_id", F.get_json_object("props", "$.k").cast("bigint").alias("k"))


@R.query("sc53_rice", "SELECT event_id, round(value * (user_id % 7 + 1) * 0.8 / greatest(0.1, value - 5), 3)::DOUBLE AS rice FROM events WHERE value IS NOT NULL")
def _(s, d):
    from lodestrata.functions import vector as V

    v = F.col("value")
    return events(s, d).where("value is not null").select("event_id", V.rice(v, (F.col("user_id") % 7 + 1), F.lit(0.8), v - 5).alias("rice"))


@R.query("st10_difference", "SELECT user_id, ts::DATE AS day FROM events WHERE event_type = 'view' EXCEPT SELECT user_id, ts::DATE FROM events WHERE event_type = 'purchase'")
def _(s, d):
    e = events(s, d).select("user_id", F.to_date("ts").alias("day"), "event_type")
    return e.where("event_type = 'view'").select("user_id", "day").subtract(e.where("event_type = 'purchase'").select("user_id", "day"))


@R.query("ax08_task_queue", "WITH t AS (SELECT DISTINCT user_id, event_type FROM events), n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_type) AS pos FROM t) SELECT user_id || '-' || pos AS task, lag(user_id || '-' || pos) OVER (PARTITION BY user_id ORDER BY pos) AS depends_on FROM n WHERE user_id IS NOT NULL")
def _(s, d):
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("event_type")
    n = events(s, d).where("user_id is not null").select("user_id", "event_type").distinct().withColumn("pos", F.row_number().over(w))
    task = F.concat_ws("-", "user_id", "pos")
    return n.select(task.alias("task"), F.lag(task).over(w).alias("depends_on"))
