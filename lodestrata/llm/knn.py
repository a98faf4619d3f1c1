"""Most similar vectors for every vector: randomly rotated one-bit codes with error bounds choosing what is reranked.

A unit vector x of a cell with centre c is kept as the signs of the rotated residual x - c, packed into words, and two
scalars: the residual's length and its product with the centre.  A query is coded in the same way in every cell it
visits; the share of differing bits estimates the angle of the two residuals without bias and with a known error, and
with the scalars that bounds the inner product from above.  Where the first
words of a cell's codes leave few, the others are compared for those alone.  Only vectors whose bound reaches the query's k-th best exact value so far are compared exactly.

The number of cells follows the number of vectors.  How many cells a query visits is not fixed: true neighbours of some
calibrating queries are found by brute force over all rows, and so many of the nearest cells are visited as held the
wished share of them.  Neighbouring cells lie together in a group, which is what is shuffled: a query goes once to a
group, not once to a cell.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.runtime import parallelism, stage

#: Rows a cell is meant to hold, and how many cells a query visits at least.
CELL, PROBES = 8192, 16
#: Bytes of all centres together, which bound what is broadcast; eight rows a centre are fitted on, so the sample is bounded too.
MODEL_BYTES, ROWS_A_CENTRE = 32 << 20, 8
#: Calibrating queries of a group, and of all groups together.
CALIBRATING, CALIBRATING_ALL = 256, 16384
#: Width of the error bound in standard deviations.
EPSILON = 2.0


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, embed_model, dim, vector of rows that take part: right length, every value finite, not all zero."""
    v = vectors.select("vec_id", "embed_model", "dim", F.col("vector").cast("array<float>").alias("vector"))
    limit = F.lit(float("inf"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < limit))
    return v.where(
        F.col("vec_id").isNotNull() & F.col("embed_model").isNotNull() & (F.col("dim") > 0) & (F.size("vector") == F.col("dim")) & finite & F.exists("vector", lambda x: x != 0)
    )


def unit(raw: np.ndarray) -> np.ndarray:
    x = raw.astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def bits_of(dim: int) -> int:
    """Bits of a code: one a dimension, and 256 at least."""
    return max(256, 1 << (dim - 1).bit_length())


@lru_cache(maxsize=16)
def rotation(dim: int) -> np.ndarray:
    """Orthonormal rows turning ``dim`` numbers into :func:`bits_of` ones, the same in every run: three rounds of random signs and Hadamard's transform."""
    width = bits_of(dim)
    rng = np.random.default_rng(dim)
    x = np.eye(dim, width, dtype=np.float32)
    for _ in range(3):
        x *= rng.choice(np.array([-1, 1], np.float32), width)
        step = 1
        while step < width:
            x = x.reshape(dim, -1, 2, step)
            x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], axis=2)
            step *= 2
        x = x.reshape(dim, width) / np.float32(np.sqrt(width))
    return x


@lru_cache(maxsize=16)
def highest_cosine(bits: int) -> np.ndarray:
    """By the number of differing bits, the greatest cosine two vectors with so many may have, within the error bound."""
    share = np.arange(bits + 1) / bits
    low = np.maximum(0, share - EPSILON * np.sqrt(share * (1 - share) / bits) - 0.5 / bits)
    return np.cos(np.pi * low).astype(np.float32)


def lloyd(x: np.ndarray, k: int, rounds: int = 6) -> tuple[np.ndarray, np.ndarray]:
    """(centres of ``k`` cells, the cell of each row) by Lloyd's rounds over a bounded sample."""
    c = x[np.random.default_rng(7).choice(len(x), min(k, len(x)), replace=False)].astype(np.float32)
    for _ in range(rounds if len(c) > 1 else 1):
        own = nearest_of(x, c)
        n = np.bincount(own, minlength=len(c))
        order = np.argsort(own, kind="stable")
        starts = np.concatenate(([0], np.cumsum(n)[:-1]))
        total = np.add.reduceat(x[order], np.minimum(starts, len(x) - 1), axis=0)
        c = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], c).astype(np.float32)
    return c, nearest_of(x, c)


def nearest_of(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    half = 0.5 * (c * c).sum(1)
    return np.concatenate([(x[s : s + 8192] @ c.T - half).argmax(axis=1) for s in range(0, len(x), 8192)] or [np.zeros(0, int)])


class Model:
    """Centres of a group of vectors in two levels: cells, and groups of neighbouring cells."""

    #: Centres searched at once; with more, only cells in the nearest groups are looked at.
    FLAT = 4096

    def __init__(self, sample: np.ndarray, n: int, dim: int, cells: int, cell: int) -> None:
        self.dim, self.probes = dim, PROBES
        fan = max(1, (1 << 21) // (cell * dim))
        x = unit(sample).astype(np.float32) if len(sample) else np.zeros((0, dim), np.float32)
        if cells <= 1 or not len(x):
            self.centres, self.group, share = np.zeros((1, dim), np.float32), np.zeros(1, np.int32), np.ones(1)
            self.upper = self.centres
        else:
            self.upper, own = lloyd(x, -(-cells // fan))
            parts = [x[own == g] for g in range(len(self.upper))]
            fitted = [lloyd(p, max(1, min(len(p), round(cells * len(p) / len(x))))) for p in parts if len(p)]
            self.upper = self.upper[[k for k, p in enumerate(parts) if len(p)]]
            self.centres = np.concatenate([c for c, _ in fitted])
            self.group = np.repeat(np.arange(len(fitted), dtype=np.int32), [len(c) for c, _ in fitted])
            share = np.array([len(o) for _, o in fitted]) / len(x)
        self.half = 0.5 * (self.centres * self.centres).sum(1)
        self.first = np.concatenate((np.searchsorted(self.group, np.arange(len(self.upper))), [len(self.group)]))
        #: A group with more rows than are meant for it is split by id.
        self.blocks = np.maximum(1, np.ceil(share * n / (2 * cell * fan))).astype(np.int64)

    def ranked(self, x: np.ndarray, many: int) -> np.ndarray:
        """The ``many`` nearest cells of each unit vector, nearest first; -1 where there are no more."""
        if len(self.centres) <= self.FLAT:
            near = x @ self.centres.T - self.half
            many = min(many, near.shape[1])
            if many == 1:
                return near.argmax(axis=1)[:, None]
            at = np.argpartition(-near, many - 1, axis=1)[:, :many]
            return np.take_along_axis(at, np.argsort(-np.take_along_axis(near, at, 1), axis=1, kind="stable"), 1)
        widths = np.diff(self.first)
        groups = min(len(self.upper), max(16, int(np.ceil(4 * many / widths.mean()))))
        out = []
        half = 0.5 * (self.upper * self.upper).sum(1)
        for s in range(0, len(x), 64):
            part = x[s : s + 64]
            g = np.argpartition(-(part @ self.upper.T - half), groups - 1, axis=1)[:, :groups]
            at = self.first[g][:, :, None] + np.arange(widths.max())
            there = at < self.first[g + 1][:, :, None]
            at, there = np.minimum(at, len(self.centres) - 1).reshape(len(part), -1), there.reshape(len(part), -1)
            near = np.where(there, np.einsum("qd,qcd->qc", part, self.centres[at]) - self.half[at], -np.inf)
            best = np.argsort(-near, axis=1, kind="stable")[:, :many]
            out.append(np.where(np.take_along_axis(there, best, 1), np.take_along_axis(at, best, 1), -1))
        return np.concatenate(out) if out else np.zeros((0, many), int)


def encode(r: np.ndarray, dim: int) -> np.ndarray:
    """Packed signs of rotated residuals, in words."""
    return np.packbits((r.astype(np.float32) @ rotation(dim)) > 0, axis=1).view(np.uint64)


class Cell:
    """Codes, scalars and vectors of (a block of) a cell."""

    def __init__(self, ids: np.ndarray, raw: np.ndarray, codes: np.ndarray, size: np.ndarray, along: np.ndarray, centre: np.ndarray) -> None:
        self.ids, self.raw, self.size, self.along, self.centre = ids, raw, size, along, centre
        self.words = np.ascontiguousarray(codes.T)
        peak = np.abs(raw).max(axis=1)
        self.scale = (1 / (peak * np.linalg.norm(raw / peak[:, None], axis=1))).astype(np.float32)
        self.widest, self.furthest = float(size.max()), float(along.max())

    def differing(self, code: np.ndarray, at: np.ndarray | None = None) -> np.ndarray:
        """Differing bits of the codes of all vectors, or of those at some places."""
        words = self.words if at is None else self.words[:, at]
        out = np.bitwise_count(words[0] ^ code[0]).astype(np.uint16)
        for word, c in zip(words[1:], code[1:], strict=True):
            out += np.bitwise_count(word ^ c)
        return out

    def most(self, bits: int, need: float, size: float) -> int:
        """Of so many bits, how many a vector of this cell may differ in whose product of residuals is to reach ``need``."""
        return int(np.searchsorted(-highest_cosine(bits), -min(need / max(self.widest * size, 1e-12), 2.0), "right")) - 1

    def candidates(self, code: np.ndarray, size: float, shift: float, floor: float, differ: np.ndarray | None = None) -> np.ndarray:
        """Places of the vectors whose bound reaches ``floor``."""
        bits, need = 64 * len(code), floor - 1e-5 - shift - self.furthest
        if need <= 0:
            at, differ = np.arange(len(self.ids)), self.differing(code) if differ is None else differ
        elif differ is not None:
            at = np.flatnonzero(differ <= self.most(bits, need, size))
            differ = differ[at]
        else:
            near = np.bitwise_count(self.words[0] ^ code[0]) <= self.most(64, need, size)
            if 8 * np.count_nonzero(near) < len(near):
                at = np.flatnonzero(near)
                differ = self.differing(code, at)
            else:
                differ = self.differing(code)
                at = np.flatnonzero(differ <= self.most(bits, need, size))
                differ = differ[at]
        return at[self.along[at] + shift + self.size[at] * np.float32(size) * highest_cosine(bits)[differ] >= floor - 1e-5]


class Search:
    """The k best of each query over the cells it visits, of one group of cells."""

    def __init__(self, model: Model, cells: dict[int, Cell], k: int, least: float) -> None:
        self.model, self.cells, self.k, self.least, self.compared = model, cells, k, least, 0

    def run(self, ids: np.ndarray, raw: np.ndarray, visits: list[np.ndarray]) -> list[tuple[int, list[int], list[float]]]:
        q = unit(raw)
        visits = [v[np.isin(v, list(self.cells))] for v in visits]
        best: list[list[tuple[float, int]]] = [[] for _ in ids]
        floor = [self.least] * len(ids)
        for turn in range(max(map(len, visits), default=0)):
            now = [j for j, v in enumerate(visits) if len(v) > turn]
            at = np.array([visits[j][turn] for j in now])
            for c in np.unique(at).tolist():
                cell = self.cells[c]
                who = [j for j, x in zip(now, at.tolist(), strict=True) if x == c]
                r = q[who] - cell.centre
                codes, sizes, shifts = encode(r, self.model.dim), np.linalg.norm(r, axis=1).tolist(), (r @ cell.centre).tolist()
                for code, size, shift, j in zip(codes, sizes, shifts, who, strict=True):
                    differ = None
                    if floor[j] <= -1:
                        # Those that seem nearest give a first exact bound for all.
                        differ = cell.differing(code)
                        lead = np.flatnonzero(differ <= np.searchsorted(np.cumsum(np.bincount(differ)), min(4 * self.k, len(differ))))
                        self._compare(cell, lead, ids[j], q[j], best, floor, j)
                    found = cell.candidates(code, size, shift, floor[j], differ) if floor[j] > -1 else np.arange(len(cell.ids))
                    self._compare(cell, found, ids[j], q[j], best, floor, j)
        return [(int(i), [x for _, x in b], [-v for v, _ in b]) for i, b in zip(ids, best, strict=True) if b]

    def _compare(self, cell: Cell, at: np.ndarray, own: int, q: np.ndarray, best: list, floor: list, j: int) -> None:
        if not len(at):
            return
        self.compared += len(at)
        if floor[j] > -1:
            at = at[(cell.raw[at] @ q.astype(np.float32)) * cell.scale[at] >= floor[j] - 1e-4]
        cos = np.round(unit(cell.raw[at]) @ q, 12)
        keep = (cos >= floor[j] - 1e-9) & (cell.ids[at] != own)
        met = {i: c for c, i in best[j]}
        met.update(zip(cell.ids[at[keep]].tolist(), (-cos[keep]).tolist(), strict=True))
        best[j] = sorted((c, i) for i, c in met.items())[: self.k]
        if len(best[j]) == self.k:
            floor[j] = max(floor[j], -best[j][-1][0])


def _floats(col: pa.Array, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(col.to_pylist()), np.float32).reshape(-1, dim)


_LAYOUT = "gid int, part int, block int, kind byte, cell int, id bigint, code binary, size float, along float, vec binary"
_NAMES = [x.split()[0] for x in _LAYOUT.split(", ")]
_TYPES = [pa.int32(), pa.int32(), pa.int32(), pa.int8(), pa.int32(), pa.int64(), pa.binary(), pa.float32(), pa.float32(), pa.binary()]


def _rows(*columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(columns, _TYPES, strict=True)], _NAMES)


def _by_group(batches: Iterator[pa.RecordBatch], rows: int = 4096) -> Iterator[tuple[int, pa.RecordBatch]]:
    """Slices of batches by gid (the first column), at most ``rows`` long."""
    for whole in batches:
        for s in range(0, whole.num_rows, rows):
            batch = whole.slice(s, rows)
            gids = batch.column(0).to_numpy()
            for g in np.unique(gids).tolist():
                yield g, batch.take(pa.array(np.flatnonzero(gids == g)))


def _fitted(reps: DataFrame, cell: int) -> dict[int, Model]:
    """Centres of every group, fitted on a sample bounded by ``MODEL_BYTES`` and drawn by a hash of the id."""
    sizes = {r[0]: (r[1], r[2]) for r in reps.groupBy("gid").agg(F.count(F.lit(1)), F.max(F.size("vector"))).collect()}
    wish = {g: -(-n // cell) for g, (n, _) in sizes.items()}
    bytes_wished = sum(4 * sizes[g][1] * w for g, w in wish.items() if w > 1)
    cells = {g: max(1, int(w * min(1.0, MODEL_BYTES / max(1, bytes_wished)))) for g, w in wish.items()}
    share = [(g, min(1.0, 1.1 * ROWS_A_CENTRE * max(cells[g], 32) / sizes[g][0])) for g in sizes if cells[g] > 1]
    drawn: dict[int, list] = {}
    if share:
        rate = reps.sparkSession.createDataFrame(share, "gid int, rate double")
        at = F.pmod(F.xxhash64("id"), F.lit(1 << 30)) / float(1 << 30)
        for g, v in reps.join(F.broadcast(rate), "gid").where(at < F.col("rate")).select("gid", "id", "vector", at.alias("at")).orderBy("gid", "at", "id").select("gid", "vector").collect():
            drawn.setdefault(g, []).append(v)
    # Groups of one cell share a model for each dimension, so that many small groups take no room.
    single = {dim: Model(np.zeros((0, dim), np.float32), 1, dim, 1, cell) for dim in {dim for g, (n, dim) in sizes.items() if n <= cell}}
    return {g: single[dim] if n <= cell else Model(np.array(drawn.get(g, []), np.float32).reshape(-1, dim), n, dim, cells[g], cell) for g, (n, dim) in sizes.items()}


def _calibrate(base: DataFrame, models: dict[int, Model], k: int, least: float, recall: float) -> None:
    """Set how many cells the queries of every group visit: as many as held the share ``recall`` of the true neighbours of calibrating queries, compared with every row."""
    spark = base.sparkSession
    many = {g: m for g, m in models.items() if len(m.centres) > m.probes}
    if not many:
        return
    each = max(16, min(CALIBRATING, CALIBRATING_ALL // len(many)))
    rate = spark.createDataFrame([(g, 1.5 * each) for g in many], "gid int, want double").join(base.groupBy("gid").agg(F.count(F.lit(1)).alias("n")), "gid")
    at = F.pmod(F.xxhash64("id", F.lit(2)), F.lit(1 << 30)) / float(1 << 30)
    chosen = base.join(F.broadcast(rate), "gid").where(at < F.col("want") / F.col("n")).select("gid", "id", "vec", at.alias("at")).orderBy("gid", "at", "id").select("gid", "id", "vec").collect()
    asked = {g: [(r[1], r[2]) for r in chosen if r[0] == g][:each] for g in many}
    asked = {g: (np.array([i for i, _ in a], np.int64), unit(np.frombuffer(b"".join(bytes(v) for _, v in a), np.float32).reshape(-1, many[g].dim))) for g, a in asked.items() if a}
    held = spark.sparkContext.broadcast(asked)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g, part in _by_group(batches):
            if g not in held.value:
                continue
            ids, q = held.value[g]
            x, own, cell = unit(_floats(part.column(3), q.shape[1])), part.column(1).to_numpy(), part.column(2).to_numpy()
            cos = q @ x.T
            cos[ids[:, None] == own] = -2
            n = min(k, len(own))
            top = np.argpartition(-cos, n - 1, axis=1)[:, :n]
            value = np.take_along_axis(cos, top, 1).ravel()
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(value), g), pa.int32()), pa.array(np.repeat(np.arange(len(ids)), n), pa.int32()), pa.array(value), pa.array(cell[top].ravel(), pa.int32())], ["gid", "q", "cos", "cell"])

    w = Window.partitionBy("gid", "q").orderBy(F.desc("cos"), "cell")
    near = base.select("gid", "id", "cell", "vec").mapInArrow(compare, "gid int, q int, cos double, cell int")
    near = near.withColumn("r", F.row_number().over(w)).where((F.col("r") <= k) & (F.col("cos") >= max(least, -1.0))).groupBy("gid", "q").agg(F.collect_list("cell").alias("cells")).collect()
    for g, m in many.items():
        ranks = []
        for _, q, cells in (r for r in near if r[0] == g):
            order = m.ranked(asked[g][1][q : q + 1].astype(np.float32), len(m.centres))[0].tolist()
            place = {c: p for p, c in enumerate(order)}
            ranks += [place.get(c, len(order)) for c in cells]
        if ranks:
            m.probes = max(m.probes, int(np.sort(ranks)[min(len(ranks) - 1, int(np.ceil(recall * len(ranks))) - 1)]) + 1)


def nearest_classes(reps: DataFrame, k: int, cell: int = CELL, least: float = -2.0, recall: float = 0.97) -> DataFrame:
    """(gid, id, near array<struct<id, cos>>) of every vector of ``reps`` (gid, id, vector, ask) that asks.

    ``reps`` must hold distinct vectors; every one is indexed.  With ``least`` only cosines of at least that are sought.
    """
    spark = reps.sparkSession
    models = _fitted(reps, cell)
    held = spark.sparkContext.broadcast(models)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g, part in _by_group(batches):
            m = held.value[g]
            raw, ids = np.array(part.column(2).flatten().to_numpy(), np.float32).reshape(-1, m.dim), part.column(1).to_numpy()
            x = unit(raw)
            own = m.ranked(x.astype(np.float32), 1)[:, 0]
            r = x - m.centres[own]
            at = m.group[own]
            code, size, along = encode(r, m.dim), np.linalg.norm(r, axis=1), np.einsum("ij,ij->i", x, m.centres[own])
            block = (ids * 2654435761 % (1 << 32)) % m.blocks[at]
            n = len(ids)
            yield _rows(np.full(n, g), at, block, part.column(3).cast(pa.int8()), own, ids, [c.tobytes() for c in code], size, along, [v.tobytes() for v in raw])

    base = stage(reps.select("gid", "id", "vector", "ask").mapInArrow(index, _LAYOUT), "codes")
    _calibrate(base, models, k, least, 0.999 if least > -1 else recall)
    probes = spark.sparkContext.broadcast({g: m.probes for g, m in models.items()})

    def asks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g, part in _by_group(batches):
            m, ids, vec = held.value[g], part.column(1).to_numpy(), part.column(2)
            cells = m.ranked(unit(_floats(vec, m.dim)).astype(np.float32), probes.value[g])
            groups = np.where(cells >= 0, m.group[cells], -1)
            who, at, block, listed = [], [], [], []
            for j in range(len(ids)):
                for p in np.unique(groups[j][groups[j] >= 0]).tolist():
                    visit = cells[j][groups[j] == p].astype(np.int32).tobytes()
                    for b in range(int(m.blocks[p])):
                        who.append(j), at.append(p), block.append(b), listed.append(visit)
                if len(who) >= 16384 or j == len(ids) - 1:
                    n, take = len(who), np.array(who, np.int64)
                    none = pa.nulls(n, pa.float32())
                    yield _rows(np.full(n, g), at, block, np.full(n, 2), np.zeros(n), ids[take], listed, none, none, vec.take(pa.array(take)))
                    who, at, block, listed = [], [], [], []

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, base, search = None, {}, None
        struct = pa.list_(pa.struct([("id", pa.int64()), ("cos", pa.float64())]))
        for batch in batches:
            marks = np.stack([batch.column(j).to_numpy() for j in (0, 1, 2, 3, 4)])
            edges = [0, *(np.flatnonzero((marks[:, 1:] != marks[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
            for a, z in zip(edges[:-1], edges[1:], strict=True):
                if a == z:
                    continue
                part, now, kind, own = batch.slice(a, z - a), tuple(marks[:3, a].tolist()), marks[3, a], int(marks[4, a])
                m = held.value[now[0]]
                if now != key:
                    key, base, search = now, {}, None
                if kind < 2:
                    code = np.frombuffer(b"".join(part.column(6).to_pylist()), np.uint64).reshape(part.num_rows, -1)
                    base.setdefault(own, []).append((part.column(5).to_numpy(), _floats(part.column(9), m.dim), code, part.column(7).to_numpy(), part.column(8).to_numpy()))
                    continue
                if search is None:
                    if not base:
                        continue
                    search = Search(m, {c: Cell(*(np.concatenate(v) for v in zip(*rows, strict=True)), m.centres[c].astype(np.float64)) for c, rows in base.items()}, k, least)
                found = []
                for s in range(0, part.num_rows, 512):
                    some = part.slice(s, 512)
                    found += search.run(some.column(5).to_numpy(), _floats(some.column(9), m.dim), [np.frombuffer(v, np.int32) for v in some.column(6).to_pylist()])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([key[0]] * len(found), pa.int32()), pa.array([r[0] for r in found], pa.int64()), pa.array([[{"id": i, "cos": v} for i, v in zip(r[1], r[2], strict=True)] for r in found], struct)],
                    ["gid", "id", "near"],
                )

    rows = base.withColumn("kind", F.lit(0).cast("byte")).unionByName(base.where("kind = 1").select("gid", "id", "vec").mapInArrow(asks, _LAYOUT))
    answered = (
        rows.repartition(max(parallelism(spark), sum(int(m.blocks.sum()) for m in models.values() if len(m.centres) > 1 or m.blocks[0] > 1)), "gid", "part", "block")
        .sortWithinPartitions("gid", "part", "block", "kind", "cell")
        .mapInArrow(answer, "gid int, id bigint, near array<struct<id: bigint, cos: double>>")
    )
    order = lambda a, b: F.when(a["cos"] > b["cos"], -1).when(a["cos"] < b["cos"], 1).otherwise(F.signum((a["id"] - b["id"]).cast("double")).cast("int"))
    return answered.groupBy("gid", "id").agg(F.slice(F.array_sort(F.flatten(F.collect_list("near")), order), 1, k).alias("near"))


def nearest(vectors: DataFrame, k: int = 5, cell: int = CELL, query_mod: int = 1, least: float = -2.0, recall: float = 0.97) -> DataFrame:
    """The ``k`` most similar vectors (cosine) of the same embed_model and dim, for every vector or a stated query set.

    Columns: vec_id, rank (1..k), near_id, cosine.  Ties (to twelve places) go to the smaller id.  Vectors that are null, of the wrong
    length, not finite or all zero, and rows without id, model or dim, take no part; a repeated row counts once.
    Exact copies are one entry of the index and are expanded afterwards, at most ``k`` for each vector.  With
    ``query_mod`` only vectors whose id is divisible by it are asked about, against all.  With ``least`` only neighbours
    of at least that cosine are sought.  ``recall`` is the share of the true neighbours of calibrating queries that must
    lie in the cells visited.
    """
    v = usable(vectors)
    v = v.withColumns({"h1": F.xxhash64("vector"), "h2": F.xxhash64(F.lit("second"), "vector")})
    names = v.select("embed_model", "dim").distinct().orderBy("embed_model", "dim").limit(100_001).collect()
    if len(names) > 100_000:
        raise ValueError("more than 100000 pairs of embed_model and dim")
    spark = vectors.sparkSession
    gids = spark.createDataFrame([(r[0], int(r[1]), g) for g, r in enumerate(names)], "embed_model string, dim int, gid int")
    v = v.join(F.broadcast(gids), ["embed_model", "dim"])
    reps = stage(v.groupBy("gid", "h1", "h2").agg(F.min("vec_id").alias("id"), F.first("vector").alias("vector"), F.max(F.col("vec_id") % query_mod == 0).alias("ask")), "vectors")
    members = v.select("gid", "h1", "h2", "vec_id").distinct().join(reps.select("gid", "h1", "h2", "id"), ["gid", "h1", "h2"]).select("gid", "id", "vec_id")
    w = Window.partitionBy("gid", "id").orderBy("vec_id")
    first = members.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k + 1).groupBy("gid", "id").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    near = nearest_classes(reps, k, cell, least, recall)
    flat = near.select("gid", "id", F.explode("near").alias("n")).select("gid", "id", F.col("n.id").alias("other"), F.col("n.cos").alias("cosine"))
    others = flat.join(first.select("gid", F.col("id").alias("other"), "ids"), ["gid", "other"]).groupBy("gid", "id").agg(F.collect_list(F.struct("cosine", "ids")).alias("others"))
    own = first.join(reps.where("ask").select("gid", "id"), ["gid", "id"]).join(others, ["gid", "id"], "left")
    spread = F.flatten(
        F.transform(
            F.coalesce("others", F.array().cast("array<struct<cosine: double, ids: array<bigint>>>")),
            lambda o: F.transform(o["ids"], lambda i: F.struct((-o["cosine"]).alias("c"), i.alias("i"))),
        )
    )
    same = F.transform("ids", lambda i: F.struct(F.lit(-1.0).alias("c"), i.alias("i")))
    listed = own.select("gid", "id", F.slice(F.sort_array(F.concat(same, spread)), 1, 2 * k + 1).alias("near"))
    per = members.where(F.col("vec_id") % query_mod == 0).join(listed, ["gid", "id"]).select("vec_id", F.slice(F.filter("near", lambda x: x["i"] != F.col("vec_id")), 1, k).alias("near"))
    return per.select("vec_id", F.posexplode("near").alias("p", "n")).select("vec_id", (F.col("p") + 1).alias("rank"), F.col("n.i").alias("near_id"), (-F.col("n.c")).alias("cosine"))


def alike(vectors: DataFrame, least: float = 0.9, k: int = 5) -> DataFrame:
    """(vec_id_a < vec_id_b) with cosine at least ``least`` of which one is among the other's ``k`` most similar."""
    n = nearest(vectors, k, least=least - 1e-9).where(F.col("cosine") >= least)
    return n.select(F.least("vec_id", "near_id").alias("vec_id_a"), F.greatest("vec_id", "near_id").alias("vec_id_b")).distinct()
