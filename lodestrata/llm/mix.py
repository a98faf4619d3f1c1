"""Mixing sources to target weights by soft membership.

A classifier fitted on a bounded labelled sample gives every document, labelled or not, a posterior over the sources.  Rates
(how often a document is taken) minimise the squared distance between the expected tokens of every source and its target,
by projected gradient with rates kept between nothing and the cap.  They descend twice: by the posteriors, and from there
by the sources that documents tell, so that shares by source meet their targets; there a label counts with the weight
``trust``, and what is left goes by the posterior, as all does where there is no label.  A document's rate depends on its
posterior and its label alone, so documents alike in both are summed up before the descent; each step is one distributed
sum of a few numbers per mix.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestrata.runtime import stage

#: Where the vocabulary stands unless the session's ``spark.lodestrata.vocabulary`` names another file.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The published splitting pattern of that vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Labelled documents of a source the classifier is fitted on, at most; hashed features; steps of a posterior.
SAMPLE, FEATURES, STEPS = 400, 1024, 64
#: Weight of a document's own source in its membership, by which shares are counted.
TRUST = 1.0
#: Rates are rounded in these parts of a copy, within cells of about so many rows.
UNIT, CELL_ROWS = 1_000_000, 100_000
_WORD = re.compile(r"\w+|[^\w\s]")
_encoders: dict[int, object] = {}


class _Places(dict):
    """Words' features, remembered for a process's next documents."""

    def __missing__(self, word: str) -> int:
        at = zlib.crc32(word.encode()) % FEATURES
        if len(word) <= 40:
            if len(self) >= 500_000:
                self.clear()
            self[word] = at
        return at


_places = _Places()


def encoder(ranks: bytes):
    """The tokenizer of a vocabulary file's content, made once per process."""
    key = zlib.crc32(ranks)
    if key not in _encoders:
        import tiktoken

        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines()) if a}
        _encoders[key] = tiktoken.Encoding("mix", pat_str=PATTERN, mergeable_ranks=table, special_tokens={})
    return _encoders[key]


def _vocabulary(spark: SparkSession) -> str:
    return spark.conf.get("spark.lodestrata.vocabulary", VOCABULARY)


def features(text: str) -> np.ndarray:
    """Hashed words and signs of a whole text, damped and of unit length, with a constant."""
    x = np.zeros(FEATURES + 1, np.float32)
    counts = Counter(_WORD.findall(text.lower()))
    at = np.fromiter(map(_places.__getitem__, counts), np.int64, len(counts))
    x[:-1] = np.bincount(at, 1 + np.log(np.fromiter(counts.values(), float, len(counts))), FEATURES)
    norm = np.linalg.norm(x)
    if norm:
        x /= norm
    x[-1] = 1
    return x


def fit(x: np.ndarray, y: np.ndarray, k: int, rounds: int = 120, ridge: float = 1e-4) -> np.ndarray:
    """Softmax regression by gradient descent with momentum."""
    w = np.zeros((x.shape[1], k), np.float32)
    v = np.zeros_like(w)
    hot = np.eye(k, dtype=np.float32)[y]
    for _ in range(rounds):
        z = x @ w
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        v = 0.9 * v - np.float32(4.0) * (x.T @ (p - hot) / np.float32(max(1, len(x))) + np.float32(ridge) * w)
        w += v
    return w


def soft(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Posterior over the sources."""
    z = x @ w
    p = np.exp(z - z.max())
    return p / p.sum()


def in_steps(p: np.ndarray) -> np.ndarray:
    """The same row by row in whole ``STEPS``-ths, which add up to ``STEPS``; rows of zeros stay."""
    p = p * STEPS
    q = np.floor(p + 1e-9).astype(np.int32)
    left = np.where(p.any(axis=1), STEPS - q.sum(axis=1), 0)
    place = np.argsort(np.argsort(-(p - q), axis=1, kind="stable"), axis=1, kind="stable")
    return q + (place < left[:, None])


def targets(spark: SparkSession, mixes: DataFrame) -> tuple[list[str], list[str], np.ndarray, np.ndarray]:
    """(sources, mixes, shares, caps): shares and caps by mix and source.  A row that comes again counts once."""
    rows = mixes.select("mix_id", F.lower(F.trim("source")).alias("source"), "target_share", "max_repeats").where("mix_id is not null and source is not null").distinct().limit(100_001).collect()
    if len(rows) > 100_000:
        raise ValueError("more than 100000 targets")
    sources, names = sorted({r[1] for r in rows}), sorted({r[0] for r in rows})
    share, cap = np.zeros((len(names), len(sources))), np.zeros((len(names), len(sources)))
    for m, s, t, c in rows:
        share[names.index(m), sources.index(s)] = t or 0.0
        cap[names.index(m), sources.index(s)] = c or 0
    return sources, names, share, cap


def _source() -> F.Column:
    return F.lower(F.trim(F.regexp_replace("source", r"^\s+|\s+$", "")))


def _sparse(x: np.ndarray) -> bytes:
    """Features other than the constant, as places and values."""
    at = np.flatnonzero(x[:-1]).astype(np.uint16)
    return at.tobytes() + x[at].tobytes()


def _dense(b: bytes) -> np.ndarray:
    x, n = np.zeros(FEATURES + 1, np.float32), len(b) // 6
    x[np.frombuffer(b[: 2 * n], np.uint16)] = np.frombuffer(b[2 * n :], np.float32)
    x[-1] = 1
    return x


def read(documents: DataFrame, sources: list[str], vocabulary: str, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, tokens, s, drawn, x) of every document, in one pass over the texts: its size, its source, whether it is in the classifier's sample, and the features of its text.

    About ``sample`` documents a source are drawn by a hash of doc_id.  x is null where the text is.
    """
    spark = documents.sparkSession
    rows = documents.where(F.col("doc_id").isNotNull()).select("doc_id", "text", _source().alias("s"))
    # The source alone is read to know how many documents each has.
    counts = {r[0]: r[1] for r in rows.where(F.col("s").isin(*sources)).groupBy("s").agg(F.count(F.lit(1)).alias("n")).collect()}
    rate = F.create_map(*[v for s in sources for v in (F.lit(s), F.lit(min(1.0, 1.2 * sample / max(1, counts.get(s, 0)))))]) if sources else F.create_map().cast("map<string, double>")
    at = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30)
    rows = rows.select("doc_id", "text", "s", F.coalesce(at < rate[F.col("s")], F.lit(False)).alias("drawn"))
    with open(vocabulary, "rb") as f:
        held = spark.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(held.value)
        for batch in batches:
            size, x = [], []
            for t in batch.column(1):
                text = t.as_py()
                size.append(len(enc.encode_ordinary(text or "")))
                x.append(None if text is None else _sparse(features(text)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size, pa.int64()), batch.column(2), batch.column(3), pa.array(x, pa.binary())], ["doc_id", "tokens", "s", "drawn", "x"])

    return stage(rows.mapInArrow(run, "doc_id bigint, tokens bigint, s string, drawn boolean, x binary"), "read")


def classifier(docs: DataFrame, sources: list[str], sample: int = SAMPLE) -> tuple[np.ndarray, float]:
    """(weights, accuracy on a held-out fifth) fitted on at most ``sample`` of the drawn documents of every source.

    The sample holds sources alike, the documents don't: the constant of a source is moved by the logarithm of its documents
    for each one fitted on, so that posteriors hold for all documents.
    """
    drawn = docs.where("drawn and x is not null").select("s", "doc_id", "x").collect()
    rows, met = [], dict.fromkeys(sources, 0)
    for s, i, x in sorted(((r[0], r[1], bytes(r[2])) for r in drawn), key=lambda r: (zlib.crc32(b"%d" % r[1]), r)):
        if met[s] < sample:
            met[s] += 1
            rows.append((s, i, x))
    if not rows:
        return np.zeros((FEATURES + 1, len(sources))), 0.0
    x = np.stack([_dense(r[2]) for r in rows])
    y = np.array([sources.index(r[0]) for r in rows])
    test = np.arange(len(rows)) % 5 == 0
    trial = fit(x[~test], y[~test], len(sources), rounds=60)
    weights = fit(x, y, len(sources))
    counts = {r[0]: r[1] for r in docs.where(F.col("s").isin(*sources) & F.col("x").isNotNull()).groupBy("s").agg(F.count(F.lit(1)).alias("n")).collect()}
    weights[-1] += np.log([max(0.5, counts.get(s, 0)) / max(1, met[s]) for s in sources])
    return weights, float((np.argmax(x[test] @ trial, axis=1) == y[test]).mean())


def measured(documents: DataFrame, sources: list[str], vocabulary: str | None = None, sample: int = SAMPLE, trust: float = TRUST) -> DataFrame:
    """(doc_id, tokens, known, p array<int>, soft array<int>) of every document: its size, its membership and its posterior in whole ``STEPS``-ths.

    A document with a source belongs to it with the weight ``trust``, for the rest as the classifier predicts; one with a
    null or blank source as predicted.  Documents of a source outside the targets belong to none (p and soft all 0).  Null
    texts have no tokens.  A repeated doc_id counts once, as the larger.
    """
    docs = read(documents, sources, vocabulary or _vocabulary(documents.sparkSession), sample)
    weights, _ = classifier(docs, sources, sample)
    held = docs.sparkSession.sparkContext.broadcast(weights)
    order = {s: k for k, s in enumerate(sources)}
    columns = "doc_id bigint, tokens bigint, known boolean, p array<int>, soft array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = held.value
        for batch in batches:
            if not batch.num_rows:
                continue
            s = batch.column(2).to_pylist()
            # One by one, so that a posterior is the same to the last bit in any batch.
            q = np.array([soft(_dense(x.as_py() or b""), weights) for x in batch.column(3)], float)
            own, known = np.array([order.get(v, -1) for v in s]), np.array([bool(v) for v in s])
            told = np.flatnonzero(own >= 0)
            p = q.copy()
            p[told] *= 1 - trust
            p[told, own[told]] += trust
            p[known & (own < 0)] = q[known & (own < 0)] = 0
            ends = pa.array(np.arange(len(s) + 1) * len(order), pa.int32())
            lists = [pa.ListArray.from_arrays(ends, pa.array(in_steps(v).ravel(), pa.int32())) for v in (p, q)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(known), *lists], ["doc_id", "tokens", "known", "p", "soft"])

    out = docs.select("doc_id", "tokens", "s", "x").mapInArrow(run, columns)
    return stage(out.groupBy("doc_id").agg(F.max(F.struct("tokens", "known", "p", "soft")).alias("d")).select("doc_id", "d.*"), "sizes")


def _both(batch: pa.RecordBatch, at: int, k: int) -> np.ndarray:
    """Membership and posterior side by side, from columns ``at`` and the next."""
    return np.hstack([np.array(batch.column(j).flatten().to_numpy(), float).reshape(-1, k) / STEPS for j in (at, at + 1)])


def _rates(p: np.ndarray, history: list[np.ndarray], cap: np.ndarray) -> np.ndarray:
    """Rates (group, mix) after the steps so far: each step moves along membership and posterior (p) and is projected on the box, which the membership bounds."""
    inside = np.where(p[:, None, : cap.shape[1]] > 0, cap[None], np.inf).min(axis=2)
    top = np.where(np.isfinite(inside), inside, 0)
    r = np.minimum(1.0, top)
    for step in history:
        r = np.clip(r - p @ step.T, 0, top)
    return r


def descend(docs: DataFrame, share: np.ndarray, cap: np.ndarray, rounds: int = 60, close: float = 1e-4) -> tuple[list[np.ndarray], np.ndarray, float]:
    """(steps taken, tokens available by source, budget): the descent over all documents, by their posteriors and then, from there, by their memberships."""
    groups = stage(docs.where("tokens > 0").groupBy("p", "soft").agg(F.sum("tokens").alias("tokens")), "groups")
    k = share.shape[1]

    def total(history: list[np.ndarray] | None) -> np.ndarray:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            s = np.zeros((1 if history is None else len(share), 2 * k))
            for batch in batches:
                p = _both(batch, 0, k)
                t = batch.column(2).to_numpy().astype(float)
                s += (t @ p)[None] if history is None else (_rates(p, history, cap) * t[:, None]).T @ p
            yield pa.RecordBatch.from_arrays([pa.array(range(s.size), pa.int32()), pa.array(s.ravel(), pa.float64())], ["i", "v"])

        out = np.zeros((1 if history is None else len(share)) * 2 * k)
        # A handful of numbers for each task of the groups' table.
        for i, v in groups.select("p", "soft", "tokens").mapInArrow(run, "i int, v double").collect():
            out[i] += v
        return out.reshape(-1, 2 * k)

    both = total(None)[0]
    have = both[:k]
    budget = float(have.sum())
    history: list[np.ndarray] = []
    want = share * budget
    for part in (slice(k, None), slice(0, k)):
        # Steps are scaled by a source's tokens, which is the curvature where memberships don't overlap.
        scale = 1 / np.maximum(both[part], 1.0)
        reachable = np.minimum(want, cap * both[part][None])
        least, best, before, mark = np.inf, len(history), None, (np.inf, 0)
        # A source whose own documents are at their cap is moved by others' alone: its steps grow while its miss hardly shrinks.
        grown = np.ones_like(want)
        for _ in range(rounds if budget else 0):
            miss = total(history)[:, part] - want
            if before is not None:
                same = np.sign(miss) == np.sign(before)
                grown = np.where(same & (np.abs(miss) > 0.8 * np.abs(before)), np.minimum(2 * grown, 32.0), np.where(same, grown, np.maximum(grown / 4, 1.0)))
            before = miss
            step = np.zeros((len(share), 2 * k))
            step[:, part] = 0.9 * miss * scale[None] * grown
            history.append(step)
            error = float(np.abs(miss + want - reachable).max() / budget)
            if error < least:
                least, best = error, len(history) - 1
            if error < 0.9 * mark[0]:
                mark = (error, len(history))
            # Within reach, or hardly better for six steps.
            if error < close or len(history) - mark[1] > 6:
                break
        # The steps up to the least error are those taken.
        history = history[:best]
    return history, have, budget


def _copies(docs: DataFrame, names: list[str], history: list[np.ndarray], cap: np.ndarray) -> DataFrame:
    """(mix_id, doc_id, copies, rate, tokens, known, p) of the documents a mix takes.

    Rates are rounded systematically: documents of a mix and source stand in order of size (in steps of a fifth) and then
    of a hash of doc_id, fractions are added up along it, and a document is taken once more where the sum passes a whole
    number.  The answer depends on the documents alone, however they are spread over tasks.  Sums run within cells of
    bounded size, whose totals are added up first.
    """
    held = docs.sparkSession.sparkContext.broadcast((history, cap, names))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        history, cap, names = held.value
        for batch in batches:
            p = _both(batch, 3, cap.shape[1])
            r = _rates(p, history, cap)
            own = p[:, : cap.shape[1]].argmax(axis=1)
            for m, name in enumerate(names):
                # In millionths, so that sums are exact in any order.
                parts = np.round(r[:, m] * UNIT).astype(np.int64)
                keep = np.flatnonzero(parts > 0)
                part = batch.take(pa.array(keep))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * part.num_rows, pa.string()), *part.columns[:4], pa.array(own[keep], pa.int32()), pa.array(parts[keep], pa.int64()), pa.array(r[keep, m], pa.float64())],
                    ["mix_id", "doc_id", "tokens", "known", "p", "own", "parts", "rate"],
                )

    rows = docs.where("tokens > 0").select("doc_id", "tokens", "known", "p", "soft").mapInArrow(run, "mix_id string, doc_id bigint, tokens bigint, known boolean, p array<int>, own int, parts bigint, rate double")
    size = F.floor(F.log(F.col("tokens").cast("double")) / float(np.log(1.2))).cast("int")
    rows = stage(rows.withColumns({"size": size, "rest": F.col("parts") % UNIT, "h": F.xxhash64("doc_id", F.lit(3))}), "rates")
    cell = ["mix_id", "own", "size"]
    per = rows.where("rest > 0").groupBy(*cell).agg(F.count(F.lit(1)).alias("n"))
    splits = per.select(*cell, F.ceil(F.col("n") / CELL_ROWS).alias("splits"))  # at most a few hundred rows a source and mix
    dealt = rows.where("rest > 0").join(F.broadcast(splits), cell).withColumn("c", F.pmod("h", "splits"))
    totals = dealt.groupBy(*cell, "c").agg(F.sum("rest").alias("total"))
    along = Window.partitionBy("mix_id", "own").orderBy("size", "c").rowsBetween(Window.unboundedPreceding, -1)
    base = totals.select(*cell, "c", F.coalesce(F.sum("total").over(along), F.lit(0)).alias("base"))
    within = Window.partitionBy(*cell, "c").orderBy("h", "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # The start is drawn once for a mix and source.
    start = F.pmod(F.xxhash64("mix_id", "own"), F.lit(UNIT))
    upto = F.col("base") + start + F.sum("rest").over(within)
    more = F.floor(upto / UNIT) - F.floor((upto - F.col("rest")) / UNIT)
    parted = dealt.join(base, [*cell, "c"]).select("mix_id", "doc_id", "tokens", "known", "p", "rate", (F.floor(F.col("parts") / UNIT) + more).cast("int").alias("copies"))
    plain = rows.where("rest = 0").select("mix_id", "doc_id", "tokens", "known", "p", "rate", F.floor(F.col("parts") / UNIT).cast("int").alias("copies"))
    return parted.unionByName(plain).where("copies > 0")


def taken(documents: DataFrame, mixes: DataFrame, vocabulary: str | None = None, trust: float = TRUST) -> DataFrame:
    """Documents of every mix: mix_id, doc_id, copies (never more than the source allows), rate, tokens.

    The budget of a mix is the number of tokens of all documents.  A document of unknown source may be taken as often as
    the strictest of the sources it may belong to allows.  Without documents or targets there are no rows.
    """
    sources, names, share, cap = targets(documents.sparkSession, mixes)
    if not names:
        return documents.sparkSession.createDataFrame([], "mix_id string, doc_id bigint, copies int, rate double, tokens bigint")
    docs = measured(documents, sources, vocabulary, trust=trust)
    history, _, _ = descend(docs, share, cap)
    return _copies(docs, names, history, cap).select("mix_id", "doc_id", "copies", "rate", "tokens")


def report(documents: DataFrame, mixes: DataFrame, vocabulary: str | None = None, trust: float = TRUST) -> DataFrame:
    """What every mix reached: mix_id, source, target_share, max_repeats, tokens_available, tokens_taken, share_reached, reachable.

    Tokens of documents of unknown source are spread over sources by their posterior.  ``reachable`` tells whether the
    source has the tokens, with repeats, for its share of the budget; where it has not, every document is taken as often
    as it may be and the share stays below the target.
    """
    spark = documents.sparkSession
    sources, names, share, cap = targets(spark, mixes)
    if not names:
        return spark.createDataFrame([], "mix_id string, source string, target_share double, max_repeats int, tokens_available double, tokens_taken double, share_reached double, reachable boolean")
    docs = measured(documents, sources, vocabulary, trust=trust)
    history, have, budget = descend(docs, share, cap)
    got = _copies(docs, names, history, cap).select("mix_id", (F.col("copies") * F.col("tokens")).alias("t"), F.posexplode("p").alias("k", "q")).where("q > 0")
    sums = got.groupBy("mix_id", "k").agg(F.sum(F.col("t") * F.col("q") / STEPS).alias("tokens_taken"))
    rows = [(m, s, j, float(share[i, j]), int(cap[i, j]), float(have[j]), bool(share[i, j] * budget <= cap[i, j] * have[j])) for i, m in enumerate(names) for j, s in enumerate(sources)]
    want = spark.createDataFrame(rows, "mix_id string, source string, k int, target_share double, max_repeats int, tokens_available double, reachable boolean")
    w = Window.partitionBy("mix_id")
    n = F.coalesce("tokens_taken", F.lit(0.0))
    return want.join(sums, ["mix_id", "k"], "left").select(
        "mix_id", "source", "target_share", "max_repeats", "tokens_available", n.alias("tokens_taken"),
        F.when(F.sum(n).over(w) > 0, n / F.sum(n).over(w)).otherwise(0.0).alias("share_reached"), "reachable",
    )
