"""An index of vectors by their nearest anchor, with exact answers: buckets are skipped by the triangle inequality of angles."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.functions import vector as V


def anchors(dim: int, n: int) -> np.ndarray:
    """Random directions, the same in every run."""
    a = np.random.default_rng(dim).standard_normal((n, dim))
    return a / np.linalg.norm(a, axis=1, keepdims=True)


def buckets(vectors: DataFrame, vector: str, dim: int, n: int = 32) -> DataFrame:
    """The vectors with ``bucket`` (the nearest anchor) and ``angle`` (to it); write them partitioned by bucket to keep the index."""
    near = F.array(*[F.struct(V.cosine(F.col(vector), F.array(*map(F.lit, a.tolist()))).alias("c"), F.lit(-k).alias("k")) for k, a in enumerate(anchors(dim, n))])
    best = F.array_max(near)
    return vectors.select("*", best.alias("_b")).select("*", (-F.col("_b.k")).alias("bucket"), F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), F.col("_b.c")))).alias("angle")).drop("_b")


def search(vectors: DataFrame, key: str, vector: str, query: Sequence[float], k: int = 10, n: int = 32) -> DataFrame:
    """(key, score) of the ``k`` vectors of greatest cosine; ties go to the smaller key.

    The bucket of the query gives a first bound; of the others only those are searched whose nearest or furthest member may
    be as near.  Nothing is lost by that.
    """
    dim = len(query)
    q = np.array(query, float)
    q = q / (np.linalg.norm(q) or 1.0)
    to = np.arccos(np.clip(anchors(dim, n) @ q, -1, 1))
    b = buckets(vectors, vector, dim, n)
    score: Column = F.round(V.cosine(F.col(vector), F.array(*map(F.lit, map(float, query)))), 6)
    own = int(to.argmin())
    first = b.where(F.col("bucket") == own).select(score.alias("score")).orderBy(F.desc("score")).limit(k).collect()
    reach = math.acos(max(-1.0, min(1.0, first[-1][0] - 1e-6))) if len(first) == k else math.pi
    spans = {r[0]: (r[1], r[2]) for r in b.groupBy("bucket").agg(F.min("angle"), F.max("angle")).collect()}
    # A member at angle a to its anchor lies between |to - a| and to + a from the query.
    may = [g for g, (lo, hi) in spans.items() if max(0.0, to[g] - hi, lo - to[g]) <= reach + 1e-9]
    return b.where(F.col("bucket").isin(may)).select(key, score.alias("score")).orderBy(F.desc("score"), key).limit(k)
