"""Order-dependent operators: replay to the latest state, trends, rolling limits, packing, gated folds, snapshots."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(df: DataFrame, keys: Sequence[str], order: Sequence[Column], values: Sequence[str]) -> DataFrame:
    """The values of the last row of every key; combined before the shuffle."""
    return df.groupBy(*keys).agg(F.max_by(F.struct(*values), F.struct(*order)).alias("_v")).select(*keys, *[F.col(f"_v.{v}").alias(v) for v in values])


def first_wins(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row per key, the first in order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def dominant(df: DataFrame, group: Sequence[str], value: str, order: Sequence[str]) -> DataFrame:
    """(group, value, n): the most frequent value of every group, of equals the one met first in order; nulls are a value."""
    n = df.groupBy(*group, value).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(*order)).alias("_o"))
    w = Window.partitionBy(*group).orderBy(F.desc("n"), "_o")
    return n.withColumn("_r", F.row_number().over(w)).where("_r = 1").select(*group, value, "n")


def trend(daily: DataFrame, day: str, value: str) -> DataFrame:
    """(slope, intercept, days) of a value over the ordinal of its days; fewer than two days have slope 0.

    ``daily`` has one row a day, so the one window it needs stays small.
    """
    n = daily.withColumn("_x", F.row_number().over(Window.orderBy(day)) - 1)
    s = n.agg(F.regr_slope(value, F.col("_x")).alias("slope"), F.regr_intercept(value, F.col("_x")).alias("intercept"), F.count(F.lit(1)).alias("days"), F.avg(value).alias("mean"))
    return s.select(F.round(F.coalesce("slope", F.lit(0.0)), 6).alias("slope"), F.round(F.coalesce("intercept", "mean", F.lit(0.0)), 6).alias("intercept"), "days")


#: Seconds of a bucket of time; the rows of a key are spread over tasks by buckets.
BUCKET = 30 * 86400


def rolling_count(df: DataFrame, keys: Sequence[str], time: str, seconds: int, name: str = "calls", bucket: int = BUCKET) -> DataFrame:
    """Rows of the key within so many seconds up to each row; rows without a time count those without one.

    Rows near the end of a bucket of time are copied into the next, so that every bucket is counted by itself.
    """
    width, span = max(bucket, seconds) * 1_000_000, seconds * 1_000_000
    t = df.withColumn("_t", F.unix_micros(F.col(time).cast("timestamp"))).withColumn("_b", F.floor(F.col("_t") / width))
    copies = t.where(F.col("_t") >= (F.col("_b") + 1) * width - span).withColumn("_b", F.col("_b") + 1)
    both = t.withColumn("_own", F.lit(True)).unionByName(copies.withColumn("_own", F.lit(False)))
    w = Window.partitionBy(*keys, "_b").orderBy("_t").rangeBetween(-span, 0)
    return both.withColumn(name, F.count(F.lit(1)).over(w)).where("_own").drop("_t", "_b", "_own")


def sessions(df: DataFrame, keys: Sequence[str], time: str, gap_seconds: int, bucket: int = BUCKET) -> DataFrame:
    """(keys, start, end, n) of runs without a pause of the gap or longer; rows without a time are left out.

    Runs are found within buckets of time first; only the first and the last run of every bucket can go on in another, and
    only those are joined.
    """
    gap, width = gap_seconds * 1_000_000, bucket * 1_000_000
    t = df.select(*keys, time, F.unix_micros(F.col(time).cast("timestamp")).alias("_t")).where(F.col("_t").isNotNull()).withColumn("_b", F.floor(F.col("_t") / width))
    w = Window.partitionBy(*keys, "_b").orderBy("_t")
    new = F.coalesce((F.col("_t") - F.lag("_t").over(w) >= gap).cast("int"), F.lit(0))
    runs = t.withColumn("_new", new).withColumn("_s", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    runs = runs.groupBy(*keys, "_b", "_s").agg(F.min(time).alias("start"), F.max(time).alias("end"), F.min("_t").alias("_a"), F.max("_t").alias("_z"), F.count(F.lit(1)).alias("n"))
    last = F.max("_s").over(Window.partitionBy(*keys, "_b"))
    marked = runs.withColumn("_edge", (F.col("_s") == 0) | (F.col("_s") == last))
    v = Window.partitionBy(*keys).orderBy("_a")
    edges = marked.where("_edge").withColumn("_new", F.coalesce((F.col("_a") - F.lag("_z").over(v) >= gap).cast("int"), F.lit(1))).withColumn("_g", F.sum("_new").over(v.rowsBetween(Window.unboundedPreceding, 0)))
    joined = edges.groupBy(*keys, "_g").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.sum("n").alias("n")).drop("_g")
    return joined.unionByName(marked.where("not _edge").select(*joined.columns))


def pack(hits: DataFrame, group: Sequence[str], order: Sequence[Column], unique: Sequence[str], size: str, budget: int) -> DataFrame:
    """Hits of every group in order, each key once, up to the first that would overflow the budget (it and all after go)."""
    once = first_wins(hits, [*group, *unique], order)
    w = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return once.withColumn("used", F.sum(size).over(w)).where(F.col("used") <= budget)


def adaptive_threshold(hits: DataFrame, keys: Sequence[str], order: Sequence[str], hit: str, start: float = 0.5, target: float = 0.8, warm: int = 20, step: float = 0.02) -> DataFrame:
    """A threshold learned by a fold over hits in order: after ``warm`` samples it rises while the hit rate is under the
    target and falls while it is 0.1 above, in [0.15, 0.9].  One row per key: samples, hit_rate, threshold.

    Rows of a key come in order and in Arrow batches; only three numbers are kept between them, however long a log is.
    """
    n_keys = len(keys)

    def learn(n: int, h: int, t: float) -> float:
        rate = h / n
        if n >= warm and rate < target:
            t += step
        elif n >= warm and rate > target + 0.1:
            t -= step
        return round(min(0.9, max(0.15, t)), 4)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, n, h, t = None, 0, 0, start
        last = None

        def row(k: pa.RecordBatch) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([*[k.column(j) for j in range(n_keys)], pa.array([n], pa.int64()), pa.array([round(h / n, 6)]), pa.array([t])], [*keys, "samples", "hit_rate", "threshold"])

        for batch in batches:
            names = list(zip(*[batch.column(j).to_pylist() for j in range(n_keys)], strict=True))
            for k, (name, got) in enumerate(zip(names, batch.column(n_keys).to_pylist(), strict=True)):
                if name != key or last is None:
                    if last is not None:
                        yield row(last)
                    key, n, h, t, last = name, 0, 0, start, batch.slice(k, 1)
                n, h = n + 1, h + int(bool(got))
                t = learn(n, h, t)
        if last is not None:
            yield row(last)

    rows = hits.repartition(*keys).sortWithinPartitions(*keys, *order).select(*keys, F.col(hit).cast("boolean").alias("_h"))
    head = ", ".join(f"{k} {hits.schema[k].dataType.simpleString()}" for k in keys)
    return rows.mapInArrow(run, f"{head}, samples bigint, hit_rate double, threshold double")


def streaks(log: DataFrame, keys: Sequence[str], order: Sequence[Column], status: str) -> DataFrame:
    """(keys, streak, revoked, last): passes since the start; one capital failure revokes for good, ordinary failures don't
    reset; ``last`` is the status of the last row in order."""
    return log.groupBy(*keys).agg(
        F.count_if(F.col(status) == "PASS").alias("passes"), F.coalesce(F.bool_or(F.col(status) == "CAPITAL"), F.lit(False)).alias("revoked"), F.max_by(status, F.struct(*order)).alias("last")
    ).select(*keys, F.when(F.col("revoked"), 0).otherwise(F.col("passes")).cast("bigint").alias("streak"), "revoked", "last")


def decay(df: DataFrame, weight: str, touched: str, now: Column, days: int = 90, least: float = 0.1, digits: int = 2) -> DataFrame:
    """Weights above ``least`` untouched for more than ``days`` are halved; a missing time counts as now."""
    old = F.datediff(now, F.coalesce(F.col(touched), now)) > days
    return df.withColumn(weight, F.when(old & (F.col(weight) > least), F.round(F.col(weight) * 0.5, digits)).otherwise(F.col(weight)))


def snapshots(df: DataFrame, keys: Sequence[str], order: Column, size: str, gate: int = 4096, keep: int = 5) -> DataFrame:
    """Snapshots whose size differs from the one before by ``gate`` or more, of these the newest ``keep``."""
    w = Window.partitionBy(*keys).orderBy(order)
    moved = df.withColumn("_d", F.abs(F.col(size) - F.lag(size).over(w))).where(F.coalesce(F.col("_d") >= gate, F.lit(True)))
    v = Window.partitionBy(*keys).orderBy(order.desc())
    return moved.withColumn("_r", F.row_number().over(v)).where(F.col("_r") <= keep).drop("_r", "_d")


def duplicate_blocks(files: DataFrame, keys: Sequence[str], text: str, size: int = 3, least: int = 10) -> DataFrame:
    """Share of sliding blocks of lines (blanks removed, short ones left out) that occur again in the same file."""
    lines = F.transform(F.split(text, "\n"), lambda x: F.regexp_replace(x, r"\s+", ""))
    n = F.size("_l")
    blocks = F.when(n >= size, F.transform(F.sequence(F.lit(1), n - size + 1), lambda i: F.array_join(F.slice("_l", i, size), ""))).otherwise(F.array().cast("array<string>"))
    b = files.select(*keys, lines.alias("_l")).select(*keys, F.filter(blocks, lambda x: F.length(x) >= least).alias("_b"))
    count = F.size("_b")
    return b.select(*keys, count.cast("bigint").alias("blocks"), F.round(F.when(count > 0, 1 - F.size(F.array_distinct("_b")) / count).otherwise(F.lit(0.0)), 6).alias("duplicate_share"))


def sample(df: DataFrame, key: str, rate: float, seed: int) -> DataFrame:
    """max(1, round(rows * rate)) rows without replacement, those first in order of a hash of seed and key.

    How many rows each of 65,536 ranges of the hash holds tells where the last row wanted lies; only the rows of that one
    range are ordered.  An empty table gives no rows.
    """
    h = F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))
    marked = df.withColumns({"_h": h, "_b": F.substring(h, 1, 4)})
    counts = sorted((r[0], r[1]) for r in marked.groupBy("_b").agg(F.count(F.lit(1))).collect() if r[0] is not None)
    total = sum(n for _, n in counts)
    want = min(total, max(1, math.floor(total * rate + 0.5)))
    below, last = 0, ""
    for b, n in counts:
        last = b
        if below + n >= want:
            break
        below += n
    edge = marked.where(F.col("_b") == last).orderBy("_h", key).limit(want - below)
    return marked.where(F.col("_b") < last).unionByName(edge).drop("_h", "_b")
