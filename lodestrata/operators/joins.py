"""Joins Spark has no name for: point in interval, longest prefix, ownership, snapshot difference, freshness."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def innermost(points: DataFrame, spans: DataFrame, keys: Sequence[str], point: str, start: str, end: str, out: Sequence[str], cell: int = 64) -> DataFrame:
    """Each point with the innermost span that holds it (latest start, then earliest end, then ``out``).

    Spans are entered under every cell of ``cell`` positions they touch and joined by equality on keys and cell, so a
    key with many spans is spread and no pair is tested outside a cell.  Points outside every span give no row; a span
    without an end holds its start alone.
    """
    last = F.coalesce(F.col(end), F.col(start))
    s = spans.select(*keys, start, last.alias("_end"), *[c for c in out if c not in (*keys, start)])
    s = s.withColumn("_cell", F.explode(F.sequence(F.floor(F.col(start) / cell), F.floor(F.greatest("_end", start) / cell))))
    p = points.withColumn("_cell", F.floor(F.col(point) / cell))
    hit = p.join(s, [*keys, "_cell"]).where((F.col(start) <= F.col(point)) & (F.col(point) <= F.col("_end")))
    rest = [c for c in out if c not in (*keys, start)]
    best = F.struct(F.col(start), (-F.col("_end")).alias("_back"), *rest)
    found = hit.groupBy(*points.columns).agg(F.max(best).alias("_b"))
    return found.select(*points.columns, *[F.col(f"_b.{c}").alias(c) for c in out if c not in keys])


def longest_prefix(names: DataFrame, name: str, prefixes: DataFrame, prefix: str) -> DataFrame:
    """Each dotted name with the longest of the given names that is it or a dotted prefix of it.

    A name is exploded into its own few prefixes, which are joined by equality.
    """
    parts = F.split(name, r"\.")
    own = names.select(name, F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.concat_ws(".", F.slice(parts, 1, n)))).alias(prefix))
    return own.join(prefixes.select(prefix).distinct(), prefix).groupBy(name).agg(F.max_by(prefix, F.length(prefix)).alias(prefix))


def ownership(uses: DataFrame, owners: DataFrame, name: str, examples: int = 5) -> DataFrame:
    """Edges between repositories: uses (repo, name, file) of names that exactly one other repository owns (repo, name).

    Columns: from_repo, to_repo, uses, examples (first files in order).
    """
    sole = owners.select("repo", name).distinct().groupBy(name).agg(F.count(F.lit(1)).alias("n"), F.min("repo").alias("to_repo")).where("n = 1")
    hit = uses.join(sole.select(name, "to_repo"), name).where(F.col("repo") != F.col("to_repo"))
    per_file = hit.groupBy(F.col("repo").alias("from_repo"), "to_repo", "file").agg(F.count(F.lit(1)).alias("u"))
    w = Window.partitionBy("from_repo", "to_repo").orderBy("file")
    first = per_file.withColumn("r", F.row_number().over(w)).where(F.col("r") <= examples).groupBy("from_repo", "to_repo").agg(F.array_join(F.array_sort(F.collect_list("file")), ",").alias("examples"))
    return per_file.groupBy("from_repo", "to_repo").agg(F.sum("u").alias("uses")).join(first, ["from_repo", "to_repo"])


def snapshot_diff(old: DataFrame, new: DataFrame, key: str, value: str) -> DataFrame:
    """(key, change) with change added, changed, deleted or unchanged; nulls compare as equal."""
    a = old.select(key, F.col(value).alias("_a"), F.lit(True).alias("_ina"))
    b = new.select(key, F.col(value).alias("_b"), F.lit(True).alias("_inb"))
    change = F.when(F.col("_ina").isNull(), "added").when(F.col("_inb").isNull(), "deleted").when(F.col("_a").eqNullSafe(F.col("_b")), "unchanged").otherwise("changed")
    return a.join(b, key, "full_outer").select(key, change.alias("change"))


def unmatched_starts(log: DataFrame, keys: Sequence[str], event: str, order: Sequence[Column], start: str, stop: str) -> DataFrame:
    """Keys whose last event of the two is a start; a later start replaces an earlier; rows with all keys null are left out."""
    some = F.coalesce(*[F.col(k).cast("string") for k in keys]).isNotNull()
    last = log.where(F.col(event).isin(start, stop) & some).groupBy(*keys).agg(F.max_by(event, F.struct(*order)).alias("last"))
    return last.where(F.col("last") == start).select(*keys)


def members(keys: DataFrame, key: str, base: DataFrame, added: DataFrame, removed: DataFrame) -> DataFrame:
    """The keys in the base or the additions, and not among the removals: exact membership with a delta."""
    inside = keys.join(base.select(key).unionByName(added.select(key)).distinct(), key, "left_semi")
    return inside.join(removed.select(key).distinct(), key, "left_anti")


def stale(cited: DataFrame, current: DataFrame, key: str, hash_: str) -> DataFrame:
    """(key, fresh): fresh if the cited hash is the current one (``current`` has a row a key; of several the greatest hash); a missing key or hash is stale."""
    now = current.select(key, F.col(hash_).alias("_now")).groupBy(key).agg(F.max("_now").alias("_now"))
    return cited.join(now, key, "left").select(key, ((F.coalesce(F.col(hash_), F.lit("")) != "") & F.col(hash_).eqNullSafe(F.col("_now"))).alias("fresh"))


def as_of(left: DataFrame, right: DataFrame, keys: Sequence[str], ltime: str, rtime: str, values: Sequence[str], bucket_seconds: int = 30 * 86400) -> DataFrame:
    """Each left row with the values of the latest right row at or before its time; nulls where there is none or a key is null.

    Times are cut into buckets, so that a key with many rows is spread over tasks; what a bucket hands on to later ones is
    one row a key and bucket.  Of right rows at the same time the greatest values count.
    """
    width = bucket_seconds * 1_000_000
    mark = lambda c: F.floor(F.unix_micros(F.col(c).cast("timestamp")) / width)
    kind = right.select(F.struct(*values).alias("x")).schema["x"].dataType
    a = left.withColumns({"_t": F.col(ltime), "_side": F.lit(1), "_v": F.lit(None).cast(kind), "_b": mark(ltime)})
    b = right.select(*keys, F.col(rtime).alias("_t"), F.lit(0).alias("_side"), F.struct(*values).alias("_v"), mark(rtime).alias("_b"))
    w = Window.partitionBy(*keys, "_b").orderBy("_t", "_side", "_v").rowsBetween(Window.unboundedPreceding, 0)
    inside = a.unionByName(b, allowMissingColumns=True).withColumn("_in", F.last("_v", ignorenulls=True).over(w)).where("_side = 1")
    ends = b.groupBy(*keys, "_b").agg(F.max_by("_v", F.struct("_t", "_v")).alias("_e")).unionByName(a.select(*keys, "_b", F.lit(None).cast(kind).alias("_e")).distinct())
    ends = ends.groupBy(*keys, "_b").agg(F.max("_e").alias("_e"))
    before = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    handed = ends.select(*keys, "_b", F.last("_e", ignorenulls=True).over(before).alias("_h")).where(F.col("_h").isNotNull())
    got = inside.join(handed, [*keys, "_b"], "left").withColumn("_last", F.coalesce("_in", "_h"))
    some = reduce(lambda x, y: x & y, [F.col(k).isNotNull() for k in keys])
    return got.select(*left.columns, *[F.when(some, F.col(f"_last.{v}")).alias(v) for v in values])
