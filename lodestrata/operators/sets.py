"""Similarity of token sets, compaction of near-duplicate lines, evidence for claims."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from lodestrata.functions import text as T


def jaccard(a: Column, b: Column) -> Column:
    """Two empty sets are alike (1.0); a null set counts as empty."""
    e = F.array().cast("array<string>")
    a, b = F.coalesce(a, e), F.coalesce(b, e)
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def coverage(original: Column, kept: Column) -> Column:
    """Share of the key words of a text that stand somewhere in what is kept; 1.0 without key words."""
    w = T.key_tokens(original)
    low = F.lower(kept)
    return F.when(F.size(w) == 0, F.lit(1.0)).otherwise(F.size(F.filter(w, lambda x: F.contains(low, x))) / F.size(w))


def compact_lines(docs: DataFrame, key: str, text: str, alike: float = 0.6, covered: float = 0.65) -> DataFrame:
    """Near-duplicate lines of every document dropped by greedy leader clustering: (key, kept, dropped, lines).

    A line joins the first leader whose key words it shares to ``alike`` (Jaccard); of a cluster the longest line stays
    (the first of equals).  If a dropped line has less than ``covered`` of its key words in the line that stays, the
    document is left as it is.  Null texts give no row.  Leaders are looked up by shared words, not by trying all.
    """
    import re

    word = re.compile(r"[a-z][a-z0-9_]{3,}")

    def one(text: str) -> tuple[int, int, str]:
        lines = [x for x in text.split("\n") if x.strip()]
        leaders: list[tuple[frozenset, list[str]]] = []
        by_word: dict[str, list[int]] = {}
        blank: int | None = None
        for line in lines:
            w = frozenset(word.findall(line.lower()))
            near = sorted({i for x in w for i in by_word.get(x, ())}) if w else [blank] if blank is not None else []
            for i in near:
                lead = leaders[i][0]
                if not (w | lead) or len(w & lead) / len(w | lead) >= alike:
                    leaders[i][1].append(line)
                    break
            else:
                for x in w:
                    by_word.setdefault(x, []).append(len(leaders))
                if not w:
                    blank = len(leaders)
                leaders.append((w, [line]))
        out = []
        for _, members in leaders:
            best = max(members, key=len)
            low = best.lower()
            for m in members:
                w = set(word.findall(m.lower()))
                if w and sum(x in low for x in w) / len(w) < covered:
                    return len(lines), 0, "\n".join(lines)
            out.append(best)
        return len(out), len(lines) - len(out), "\n".join(out)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            got = [one(t) for t in f[text]]
            yield pd.DataFrame({key: f[key], "kept": [g[0] for g in got], "dropped": [g[1] for g in got], "lines": [g[2] for g in got]})

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).where(F.col(text).isNotNull()).mapInPandas(run, f"{key} {kind}, kept bigint, dropped bigint, lines string")


def band(support: Column) -> Column:
    """What a share of support means; null counts as none."""
    return F.when(support >= 0.7, "supported").when(support >= 0.4, "partial").when(support >= 0.1, "weak").otherwise("unsupported")


#: Words of claims that are shipped to every task, at most.
CLAIM_WORDS = 2_000_000


def claim_support(claims: DataFrame, claim: str, claim_text: str, evidence: DataFrame, doc: str, doc_text: str, most_words: int = CLAIM_WORDS) -> DataFrame:
    """Per claim the best share of its key words in one piece of evidence and its band.

    Columns: claim, best_doc, support, verdict (supported from 0.7, partial from 0.4, weak from 0.1, else unsupported).
    Claims of up to ``most_words`` words in all go to every task, where each text is counted against them and only the best
    so far of every claim is kept; with more, claims are taken in parts, each of which reads the evidence once.
    """
    own = claims.select(claim, F.array_distinct(T.key_tokens(F.col(claim_text))).alias("w")).where(F.col(claim).isNotNull()).distinct()
    total = own.agg(F.sum(F.size("w"))).first()[0] or 0
    parts = max(1, -(-total // most_words))
    kinds = [df.schema[c].dataType.simpleString() for df, c in ((claims, claim), (evidence, doc))]
    texts = evidence.where(F.col(doc_text).isNotNull() & F.col(doc).isNotNull()).select(doc, F.array_distinct(T.key_tokens(F.col(doc_text))).alias("w"))

    def best_of(held) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names, sizes, where = held.value
            top = np.zeros(len(names))
            at: list = [None] * len(names)
            for batch in batches:
                for d, words in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    hit = [where[w] for w in words if w in where]
                    if not hit:
                        continue
                    ids, n = np.unique(np.concatenate(hit), return_counts=True)
                    share = n / sizes[ids]
                    for i, s in zip(ids[share >= top[ids]].tolist(), share[share >= top[ids]].tolist(), strict=True):
                        if s > top[i] or at[i] is None or d < at[i]:
                            top[i], at[i] = s, d
            keep = [i for i, d in enumerate(at) if d is not None]
            yield pa.RecordBatch.from_pydict({claim: [names[i] for i in keep], "d": [at[i] for i in keep], "s": [float(top[i]) for i in keep]}, schema)

        schema = pa.schema([(claim, to_arrow_type(claims.schema[claim].dataType)), ("d", to_arrow_type(evidence.schema[doc].dataType)), ("s", pa.float64())])
        return texts.mapInArrow(run, f"{claim} {kinds[0]}, d {kinds[1]}, s double")

    found = None
    for k in range(parts):
        rows = own.where(F.pmod(F.xxhash64(claim), F.lit(parts)) == k).collect()
        where: dict[str, list[int]] = {}
        for i, r in enumerate(rows):
            for w in r[1]:
                where.setdefault(w, []).append(i)
        held = evidence.sparkSession.sparkContext.broadcast(([r[0] for r in rows], np.array([max(1, len(r[1])) for r in rows]), {w: np.array(v) for w, v in where.items()}))
        one = best_of(held)
        found = one if found is None else found.unionByName(one)
    best = found.groupBy(claim).agg(F.max(F.struct("s", (-F.col("d")).alias("d"))).alias("b"))
    s = F.round(F.coalesce("b.s", F.lit(0.0)), 6)
    return claims.select(claim).distinct().join(best, claim, "left").select(claim, (-F.col("b.d")).alias("best_doc"), s.alias("support"), band(s).alias("verdict"))
