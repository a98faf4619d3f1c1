"""Long exact spans shared between records, by content-defined chunking with a gear rolling hash.

A gear hash over the last 32 characters is taken at every position.  Fine cuts (smallest hash of some ``FINE``
neighbours) bound variable chunks; the coarser cuts among them (smallest of some ``COARSE``) are anchors.  A run is the
sequence of whole chunks from an anchor to the first cut at least ``reach`` characters on.  Cuts depend on the text
around them alone, so an insertion moves no cut but those beside it, and the lengths are such that *every* shared span
of ``min_span`` characters holds a whole run.  Runs are deduplicated by digest; what repeats in another text is then
extended character by character to the exact span.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.runtime import stage

GEAR = 32
FINE, COARSE = 17, 192
#: A digest found in more places than this is resolved by hashes of all its windows instead of by comparing places.
HOT = 64
#: Members of a group that meet another block of its members in one task.
BLOCK = 256


def gear(codes: np.ndarray) -> np.ndarray:
    """Gear rolling hash (shift by one bit, add the character's random value) ending at each position."""
    g = codes.astype(np.uint32) * np.uint32(0x9E3779B1)
    g ^= g >> np.uint32(15)
    g *= np.uint32(0x85EBCA77)
    g ^= g >> np.uint32(13)
    g *= np.uint32(0xC2B2AE3D)
    g ^= g >> np.uint32(16)
    width = 1
    while width < GEAR:
        more = g.copy()
        more[width:] += g[:-width] << np.uint32(width)
        g, width = more, 2 * width
    return g


def _window_min(key: np.ndarray, width: int) -> np.ndarray:
    """Smallest of each ``width`` consecutive values."""
    have = 1
    while 2 * have <= width:
        key = np.minimum(key[:-have], key[have:])
        have *= 2
    rest = width - have
    return np.minimum(key[:-rest], key[rest:]) if rest else key


def cuts(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(fine cuts, anchors): positions after which the text is cut, both ascending."""
    h = gear(codes)[GEAR - 1 :]
    out = []
    key = (h.astype(np.uint64) << np.uint64(32)) | (np.uint64(0xFFFFFFFF) - np.arange(len(h), dtype=np.uint64))
    have = key
    for width in (FINE, COARSE):
        if len(key) < width:
            out.append(np.zeros(0, np.int64))
            continue
        have = _window_min(key, width)
        low = have & np.uint64(0xFFFFFFFF)
        low = low[np.concatenate(([True], low[1:] != low[:-1]))]
        out.append(np.unique((np.uint64(0xFFFFFFFF) - low).astype(np.int64)) + GEAR)
    return out[0], out[1]


def reach_of(min_span: int) -> int:
    """Least length of a run such that every shared span of ``min_span`` characters holds a whole one."""
    reach = min_span - (GEAR - 1) - COARSE - 2 * (FINE - 1) - 1
    if reach < 32:
        raise ValueError(f"min_span must be at least {min_span - reach + 32}")
    return reach


def runs(text: str, reach: int) -> list[tuple[int, int, int]]:
    """(64-bit digest, start, length) of the runs of a text."""
    raw = text.encode("utf-32-le")
    fine, anchors = cuts(np.frombuffer(raw, np.uint32))
    if not len(anchors):
        return []
    ends = np.searchsorted(fine, anchors + reach)
    ok = ends < len(fine)
    view = memoryview(raw)
    digest = xxhash.xxh3_64_intdigest
    return [
        (digest(view[4 * a : 4 * z]) - (1 << 63), a, z - a)
        for a, z in zip(anchors[ok].tolist(), fine[ends[ok]].tolist(), strict=True)
    ]


def _common(a: str, b: str) -> int:
    """Length of the common prefix."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    lo, hi = 0, n
    while hi - lo > 1:
        mid = (lo + hi) // 2
        if a[lo:mid] == b[lo:mid]:
            lo = mid
        else:
            hi = mid
    return lo


def _arrays(rows: list[tuple], types: list[pa.DataType], names: list[str]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) if rows else [[]] * len(types)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names)


def _classes(documents: DataFrame, min_span: int) -> DataFrame:
    """doc_id, text and the id of its text, of texts long enough to hold a span."""
    return documents.select("doc_id", "text").where((F.length("text") >= min_span) & F.col("doc_id").isNotNull()).select("doc_id", "text", F.xxhash64("text").alias("cls"))


def _shared_places(documents: DataFrame, min_span: int, hot: int = HOT) -> tuple[DataFrame, DataFrame]:
    """What texts share, in two parts.

    Spans (cls_a, lo_a, cls_b, lo_b, length) of digests found in up to ``hot`` places, once per pair of places; and
    windows (digest, cls, at) of ``min_span`` characters round the other digests that stand in two texts or more, at
    every place.

    Columns of spans: cls_a, lo_a, cls_b, lo_b, length, with cls_a < cls_b; cls is the 64-bit hash of a whole text, the class of
    its exact copies.  ``length`` is a lower bound where the span runs over ``min_span`` characters past a run; the
    next run of the same span carries it on.
    """
    i64, i32, s = pa.int64(), pa.int32(), pa.string()
    reach = reach_of(min_span)
    docs = _classes(documents, min_span)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                part = batch.slice(k, 512)
                found = [(d, c, (at << 16) | n) for c, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True) for d, at, n in runs(t, reach)]
                yield _arrays(found, [i64, i64, i64], ["digest", "cls", "place"])

    found = stage(docs.select("cls", "text").mapInArrow(cut, "digest bigint, cls bigint, place bigint"), "runs")
    repeated = (
        found.groupBy("digest")
        .agg(F.min("cls").alias("least"), F.max("cls").alias("most"), F.count(F.lit(1)).alias("n"))
        .where(F.col("least") < F.col("most"))
        .select("digest", "n")
    )
    places = found.join(repeated, "digest").groupBy("cls", "digest", "place").agg(F.max("n").alias("n"))
    wanted = places.groupBy("cls").agg(F.collect_list(F.struct("digest", "place", "n")).alias("places"))
    firsts = docs.groupBy("cls").agg(F.min("doc_id").alias("doc_id"))
    around = wanted.join(firsts, "cls").join(docs, ["doc_id", "cls"]).dropDuplicates(["cls"]).select("cls", "places", "text")

    def context(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_64_intdigest
        for batch in batches:
            for row in range(batch.num_rows):
                cls, places, text = (c[row].as_py() for c in batch.columns)
                out, wide = [], set()
                raw = None
                for p in places:
                    at, n = p["place"] >> 16, p["place"] & 0xFFFF
                    if p["n"] <= hot:
                        out.append((p["digest"], cls, at, n, text[max(0, at - min_span) : at], text[at + n : at + n + min_span]))
                    else:
                        wide.update(range(max(0, at + n - min_span), min(at, len(text) - min_span) + 1))
                if wide:
                    raw = memoryview(text.encode("utf-32-le"))
                    out += [(digest(raw[4 * x : 4 * (x + min_span)]) - (1 << 63), cls, x, 0, None, None) for x in sorted(wide)]
                if out:
                    yield _arrays(out, [i64, i64, i64, i32, s, s], ["digest", "cls", "at", "n", "left", "right"])

    seen = stage(around.mapInArrow(context, "digest bigint, cls bigint, at bigint, n int, left string, right string"), "places")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["cls_a", "lo_a", "cls_b", "lo_b", "length"]
        group: list[tuple] = []

        def pairs() -> list[tuple]:
            out = []
            turned = [g[4][::-1] for g in group]
            for i in range(1, len(group)):
                for j in range(i):
                    p, q = (i, j) if group[i][1] < group[j][1] else (j, i)
                    a, b = group[p], group[q]
                    if a[1] == b[1]:
                        continue
                    left, right = _common(turned[p], turned[q]), _common(a[5], b[5])
                    if left + a[3] + right >= min_span:
                        out.append((a[1], a[2] - left, b[1], b[2] - left, left + a[3] + right))
            return out

        for batch in batches:
            out: set[tuple] = set()
            for r in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if group and r[0] != group[0][0]:
                    out.update(pairs())
                    group = []
                group.append(r)
            yield _arrays(sorted(out), [i64] * 5, names)
        yield _arrays(sorted(set(pairs())), [i64] * 5, names)

    cold = seen.where("n > 0").repartition("digest").sortWithinPartitions("digest").mapInArrow(compare, "cls_a bigint, lo_a bigint, cls_b bigint, lo_b bigint, length bigint")
    w = seen.where("n = 0").select("digest", "cls", "at")
    # The windows of a hot run that stand in one text only are dropped before any are paired.
    kept = w.groupBy("digest").agg(F.min("cls").alias("least"), F.max("cls").alias("most")).where("least < most").select("digest")
    return cold, w.join(kept, "digest", "left_semi")


def _passages(w: DataFrame) -> DataFrame:
    """(passage, cls, at, n): of windows that stand in the same texts one each, with the texts and how many they are.

    The windows of a licence notice all stand in the same texts; they are told apart by the number of their texts and two
    sums over hashes of them, so no set of texts is ever collected.
    """
    w = w.groupBy("digest", "cls").agg(F.min("at").alias("at"))
    signs = w.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("cls").bitwiseAND((1 << 32) - 1)).alias("s1"), F.sum(F.xxhash64("cls", F.lit(1)).bitwiseAND((1 << 32) - 1)).alias("s2"))
    one = signs.groupBy("n", "s1", "s2").agg(F.min("digest").alias("digest")).select("digest", "n")
    return w.join(one, "digest").select(F.col("digest").alias("passage"), "cls", "at", "n")


def _pairs(members: DataFrame, key: str, by: str, n: str, *more: str) -> DataFrame:
    """Every two members (``by``_a < ``by``_b, with the columns ``more``) of each ``key``; ``n`` is the number of its members.

    Members are dealt into blocks of about ``BLOCK`` by a hash, and every two blocks meet in a task of their own, so a
    large group is never in one task.
    """
    blocks = F.greatest(F.lit(1), F.ceil(F.col(n) / BLOCK)).cast("int")
    dealt = members.select(key, by, *more, blocks.alias("blocks"), F.pmod(F.xxhash64(by, F.lit(9)), blocks).cast("int").alias("b"))
    to = F.sequence(F.lit(0), F.col("blocks") - 1)
    meets = dealt.select(key, by, *more, F.col("b"), F.explode(to).alias("o")).select(key, F.least("b", "o").alias("p"), F.greatest("b", "o").alias("q"), "b", by, *more)
    x = meets.select(key, "p", "q", F.col("b").alias("b_x"), F.col(by).alias(f"{by}_a"), *[F.col(m).alias(f"{m}_a") for m in more])
    y = meets.select(key, "p", "q", F.col("b").alias("b_y"), F.col(by).alias(f"{by}_b"), *[F.col(m).alias(f"{m}_b") for m in more])
    # Of two blocks only pairs across, of one block with itself all.
    return x.join(y, [key, "p", "q"]).where((F.col(f"{by}_a") < F.col(f"{by}_b")) & ((F.col("b_x") != F.col("b_y")) | (F.col("p") == F.col("q")))).drop("b_x", "b_y", "p", "q")


def shared_spans(documents: DataFrame, min_span: int = 400, hot: int = HOT) -> DataFrame:
    """Spans of at least ``min_span`` characters that two different texts share, for every two texts that share any.

    Columns: cls_a, lo_a, cls_b, lo_b, length, with cls_a < cls_b.  Every pair of places of spans found in up to ``hot``
    places; of passages found in more, one place in each text for every two texts.
    """
    cold, w = _shared_places(documents, min_span, hot)
    pairs = _pairs(_passages(w), "passage", "cls", "n", "at")
    return cold.unionByName(pairs.select("cls_a", F.col("at_a").alias("lo_a"), "cls_b", F.col("at_b").alias("lo_b"), F.lit(min_span).cast("bigint").alias("length")))


def passages(documents: DataFrame, min_span: int = 400) -> DataFrame:
    """Which documents hold which shared passage, without pairs: one row per passage and document.

    Columns: passage (a number standing for the passage), doc_id, at (characters before it), texts (different texts that
    hold it), documents (documents that hold it).  A passage is a window of ``min_span`` characters for every set of texts
    that share one; rows grow with the texts times the passages in each, whatever the number of texts that share one.
    """
    _, w = _shared_places(documents, min_span, 0)
    docs = _classes(documents, min_span).select("doc_id", "cls").distinct()
    held = _passages(w).join(docs, "cls").select("passage", "doc_id", "at", F.col("n").alias("texts"))
    many = held.groupBy("passage").agg(F.count(F.lit(1)).alias("documents"))
    return held.join(many, "passage")


def sharing_pairs(documents: DataFrame, min_span: int = 400, hot: int = HOT) -> DataFrame:
    """(doc_id_a < doc_id_b) of documents that share a span of at least ``min_span`` characters, exact copies included.

    Null and short texts share nothing; rows with a null doc_id are left out; a repeated row counts once.  The output has
    a row for every pair, as asked for; :func:`passages` tells the same by membership.
    """
    links = shared_spans(documents, min_span, hot).select("cls_a", "cls_b").distinct()
    docs = stage(_classes(documents, min_span).select("doc_id", "cls").distinct(), "classes")
    a = docs.select(F.col("cls").alias("cls_a"), F.col("doc_id").alias("x"))
    b = docs.select(F.col("cls").alias("cls_b"), F.col("doc_id").alias("y"))
    many = docs.groupBy("cls").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    copies = _pairs(docs.join(many, "cls"), "cls", "doc_id", "n").select("doc_id_a", "doc_id_b")
    other = links.join(a, "cls_a").join(b, "cls_b").select(F.least("x", "y").alias("doc_id_a"), F.greatest("x", "y").alias("doc_id_b"))
    return copies.unionByName(other).distinct()


def shared_share(documents: DataFrame, min_span: int = 400, hot: int = HOT) -> DataFrame:
    """Per document how much of its text stands verbatim elsewhere in spans of at least ``min_span`` characters.

    Columns: doc_id, n_chars, copies, shared_chars, shared_share.  A null text counts as empty; an empty one has share
    0.  A text with exact copies (and of span length) is shared wholly.  ``hot`` changes how it is found, not what.
    """
    spans, windows = _shared_places(documents, min_span, hot)
    side = spans.select(F.col("cls_a").alias("cls"), F.col("lo_a").alias("lo"), "length").unionByName(spans.select(F.col("cls_b").alias("cls"), F.col("lo_b").alias("lo"), "length"))
    side = side.unionByName(windows.select("cls", F.col("at").alias("lo"), F.lit(min_span).cast("bigint").alias("length")))
    side = side.groupBy("cls", "lo").agg(F.max(F.col("lo") + F.col("length")).alias("hi"))
    w = Window.partitionBy("cls").orderBy("lo").rowsBetween(Window.unboundedPreceding, -1)
    covered = side.withColumn("seen", F.max("hi").over(w)).groupBy("cls").agg(F.sum(F.greatest(F.lit(0), F.col("hi") - F.greatest("lo", F.coalesce("seen", "lo")))).alias("covered"))
    docs = documents.select("doc_id", F.length(F.coalesce("text", F.lit(""))).alias("n_chars"), F.xxhash64("text").alias("cls")).distinct()
    copies = docs.groupBy("cls").agg(F.count(F.lit(1)).alias("copies"))
    long_copy = (F.col("copies") > 1) & (F.col("n_chars") >= min_span)
    chars = F.when(long_copy, F.col("n_chars")).otherwise(F.coalesce("covered", F.lit(0))).cast("bigint")
    return docs.join(copies, "cls").join(covered, "cls", "left").select(
        "doc_id", F.col("n_chars").cast("bigint"), F.when(F.col("n_chars") > 0, F.col("copies")).otherwise(F.lit(1)).alias("copies"), chars.alias("shared_chars"),
        F.when(F.col("n_chars") > 0, F.round(chars / F.col("n_chars"), 9)).otherwise(F.lit(0.0)).alias("shared_share"),
    )
