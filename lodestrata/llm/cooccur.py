"""Items that appear together in a commit: counts, lift, PMI and Jaccard, with blocking of very wide baskets.

Items get numbers in their order, so that pairs are pairs of numbers.  A basket wider than a block is dealt into chunks,
and every two chunks meet in a row of their own; no basket and no product of chunks is ever held whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.runtime import stage

#: Items of a basket held together; a wider basket becomes products of chunks of about this many.
BLOCK = 64
#: Rows of an item that are joined with its number under one key; more are salted.
HOT = 1 << 20


def _plain_path(c):
    """One spelling per file: outer blanks off, back-slashes turned, leading ./ off."""
    return F.regexp_replace(F.translate(F.trim(F.regexp_replace(c, r"^\s+|\s+$", "")), "\\", "/"), r"^(\./+)+", "")


def entries(commits: DataFrame) -> DataFrame:
    """One row per (item_kind, repo, sha, item).  Rows of a commit mined again are merged."""
    none = F.array().cast("array<string>")
    clean = commits.select("repo", "sha", F.transform(F.coalesce("files", none), _plain_path).alias("file"), F.coalesce("functions", none).alias("function"))
    kinds = clean.where(F.col("repo").isNotNull() & F.col("sha").isNotNull()).select(
        "repo", "sha", F.explode(F.create_map(F.lit("file"), F.col("file"), F.lit("function"), F.col("function"))).alias("item_kind", "items")
    )
    rows = kinds.select("item_kind", "repo", "sha", F.explode(F.array_distinct("items")).alias("item"))
    return rows.where(F.col("item").isNotNull() & (F.trim("item") != "")).distinct()


def pair_counts(e: DataFrame, min_count: int, block: int = BLOCK, hot: int = HOT) -> DataFrame:
    """(item_kind, repo, item_a < item_b, n_ab, n_a, n_b, n) of every pair with n_ab >= ``min_count``.

    Exact: an item in fewer than ``min_count`` baskets can be in no such pair, so it is left out before pairs are made.
    """
    key, basket = ["item_kind", "repo", "item"], ["item_kind", "repo", "sha"]
    e = stage(e, "entries")
    total = e.select(*basket).distinct().groupBy("item_kind", "repo").agg(F.count(F.lit(1)).alias("n"))
    counted = e.groupBy(*key).agg(F.count(F.lit(1)).alias("n_item")).where(F.col("n_item") >= min_count)
    # Numbers rise with the items of a repository, partition by partition.
    item = stage(counted.join(total, ["item_kind", "repo"]).orderBy(*key).withColumn("id", F.monotonically_increasing_id()), "items")
    salts = F.col("n_item").cast("bigint") / hot + 1
    few = F.broadcast(item.where(F.col("n_item") > hot).select(*key, salts.cast("int").alias("salts")))  # at most one in ``hot`` entries
    spread = item.select(*key, "id", F.explode(F.sequence(F.lit(0), F.when(F.col("n_item") > hot, salts.cast("int")).otherwise(1) - 1)).alias("salt"))
    salted = e.join(few, key, "left").select(*basket, "item", F.pmod(F.xxhash64("sha"), F.coalesce("salts", F.lit(1))).cast("int").alias("salt"))
    kept = stage(salted.join(spread, [*key, "salt"]).select(*basket, "id"), "kept")

    wide = kept.groupBy(*basket).agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > block)
    chunks = F.coalesce(F.ceil(F.col("size") / block), F.lit(1)).cast("int")
    dealt = kept.join(wide, basket, "left").select(*basket, "id", chunks.alias("chunks"))
    dealt = dealt.groupBy(*basket, "chunks", F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int").alias("c")).agg(F.sort_array(F.collect_list("id")).alias("x"))
    dealt = stage(dealt, "chunks")
    within = dealt.select("x", F.posexplode("x").alias("k", "a")).select("a", F.explode(F.expr("slice(x, k + 2, size(x))")).alias("b"))
    many = dealt.where("chunks > 1")
    left = many.select(*basket, "c", "x", F.explode(F.sequence(F.col("c"), F.col("chunks") - 1)).alias("d")).where("c < d")
    right = many.select(*basket, F.col("c").alias("d"), F.col("x").alias("y"), F.explode(F.sequence(F.lit(0), F.col("c"))).alias("c")).where("c < d")
    across = left.join(right, [*basket, "c", "d"]).select(F.explode("x").alias("s"), "y").select("s", F.explode("y").alias("t")).select(F.least("s", "t").alias("a"), F.greatest("s", "t").alias("b"))
    n_ab = within.unionByName(across).groupBy("a", "b").agg(F.count(F.lit(1)).alias("n_ab")).where(F.col("n_ab") >= min_count)
    first = item.select(F.col("id").alias("a"), "item_kind", "repo", F.col("item").alias("item_a"), F.col("n_item").alias("n_a"), "n")
    second = item.select(F.col("id").alias("b"), F.col("item").alias("item_b"), F.col("n_item").alias("n_b"))
    return n_ab.join(first, "a").join(second, "b").select("item_kind", "repo", "item_a", "item_b", "n_ab", "n_a", "n_b", "n")


def cooccurrence(commits: DataFrame, min_count: int = 4, block: int = BLOCK) -> DataFrame:
    """Pairs of items of a repository with at least ``min_count`` common commits and how far above chance they are.

    Columns: item_kind, repo, item_a, item_b, n_ab, n_a, n_b, n, lift, pmi, jaccard; item_a < item_b by code point.
    Null arrays count as empty; null or blank entries are no items; repeated entries and commits mined again count
    once; rows with a null repo or sha are left out.  n counts commits with at least one item of the kind.  lift, pmi and
    jaccard are rounded to nine places.
    """
    p = pair_counts(entries(commits), min_count, block)
    lift = F.col("n_ab") * F.col("n") / (F.col("n_a") * F.col("n_b"))
    return p.select(
        "item_kind", "repo", "item_a", "item_b", "n_ab", "n_a", "n_b", "n",
        F.round(lift, 9).alias("lift"), F.round(F.log2(lift), 9).alias("pmi"), F.round(F.col("n_ab") / (F.col("n_a") + F.col("n_b") - F.col("n_ab")), 9).alias("jaccard"),
    )


def associated(commits: DataFrame, min_count: int = 4, min_lift: int = 3) -> DataFrame:
    """The pairs of :func:`cooccurrence` at least ``min_lift`` times as frequent as chance, tested in whole numbers."""
    p = pair_counts(entries(commits), min_count)
    return p.where(F.col("n_ab") * F.col("n") >= min_lift * F.col("n_a") * F.col("n_b")).select("item_kind", "repo", "item_a", "item_b")
