"""Lookups and reconciliations between tables: hunks and definitions, related files, rosters, findings, templates, prefilters."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def left_lookup(rows: DataFrame, table: DataFrame, keys: Sequence[str], value: str, fallback: str) -> DataFrame:
    """Rows with a value of a table, or their own ``fallback`` where the table has none; the table has a row a key."""
    return rows.join(table.select(*keys, F.col(value).alias("_v")), list(keys), "left").withColumn(value, F.coalesce("_v", F.col(fallback).cast("string"))).drop("_v")


def hunk_functions(hunks: DataFrame, spans: DataFrame, change: Sequence[str], most_files: int = 60, cell: int = 64) -> DataFrame:
    """(change, path, qualname) of the definitions a change touches, once each.

    hunks: change, path, start, count (lines of the new side); spans: repo, path, qualname, start_line, end_line.  Hunks and
    spans meet in cells of lines by equality.  Changes of more than ``most_files`` files touch nothing that counts.
    """
    few = hunks.groupBy(*change).agg(F.count_distinct("path").alias("_n")).where(F.col("_n") <= most_files).select(*change)
    last = F.col("start") + F.col("count") - 1
    h = hunks.join(few, list(change)).where(F.col("count") > 0).select(*change, "path", "start", last.alias("_last"), F.explode(F.sequence(F.floor(F.col("start") / cell), F.floor(last / cell))).alias("_c"))
    end = F.coalesce("end_line", "start_line")
    s = spans.select("repo", "path", "qualname", F.col("start_line").alias("_s"), end.alias("_e"), F.explode(F.sequence(F.floor(F.col("start_line") / cell), F.floor(end / cell))).alias("_c"))
    hit = h.join(s, ["repo", "path", "_c"]).where((F.col("_s") <= F.col("_last")) & (F.col("start") <= F.col("_e")))
    return hit.select(*change, "path", "qualname").distinct()


def related(imports: DataFrame, modules: DataFrame, keys: Sequence[str], limit: int) -> DataFrame:
    """(keys, target file): files that hold what a file imports, by the longest module name that is a prefix; the first file of each module.

    imports: keys, name (dotted), rank; modules: repo, module, file.  A file is not related to itself; at most ``limit`` each.
    """
    first = modules.groupBy("repo", "module").agg(F.min("file").alias("file"))
    parts = F.split("name", r"\.")
    own = imports.select(*keys, "rank", "name", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.concat_ws(".", F.slice(parts, 1, n)))).alias("module"))
    hit = own.join(first, ["repo", "module"]).groupBy(*keys, "rank", "name").agg(F.max_by(F.col("file"), F.length("module")).alias("target"))
    once = hit.where(F.col("target") != F.col("path")).groupBy(*keys, "target").agg(F.min(F.struct("rank", "name")).alias("o"))
    w = Window.partitionBy(*keys).orderBy("o", "target")
    return once.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= limit).select(*keys, "target")


def roster(verdicts: DataFrame, runs: DataFrame, session: str, agent: str, order: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Verdicts with the last record of every agent of their session; a run without a session belongs to all.

    A verdict without a session meets the last record of every agent.
    """
    rows = runs.where(F.col(agent).isNotNull()).select(session, agent, F.struct(*order).alias("_o"), F.struct(*values).alias("_v"))
    last = lambda df, by: df.groupBy(*by).agg(F.max(F.struct("_o", "_v")).alias("_x")).select(*by, "_x._o", "_x._v")
    sessions = verdicts.where(F.col(session).isNotNull()).select(session).distinct()
    named = last(rows.where(F.col(session).isNotNull()).join(sessions, session), [session, agent])
    # Of runs without a session one row an agent is left before they meet the sessions.
    anywhere = sessions.join(F.broadcast(last(rows.where(F.col(session).isNull()), [agent])))
    of_session = last(named.unionByName(anywhere.select(*named.columns)), [session, agent])
    found = verdicts.where(F.col(session).isNotNull()).join(of_session, session)
    others = verdicts.where(F.col(session).isNull()).join(F.broadcast(last(rows, [agent])))
    out = found.unionByName(others.select(*found.columns))
    return out.select(*verdicts.columns, agent, *[F.col(f"_v.{x}").alias(x) for x in values])


def bloom(keys: DataFrame, key: str, rate: float = 1e-4, n: int | None = None) -> tuple[bytes, int, int]:
    """(bits, their number, hash functions) of a filter of the keys: made in the tasks and united by OR."""
    from lodestrata.functions.vector import bloom_bits

    m, k = bloom_bits(max(1, keys.count() if n is None else n), rate)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(m, bool)
        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                bits[[(a + i * b) % m for i in range(k)]] = True
        yield pa.RecordBatch.from_arrays([pa.array([np.packbits(bits).tobytes()], pa.binary())], ["bits"])

    h = keys.where(F.col(key).isNotNull()).select(F.xxhash64(key).alias("a"), F.xxhash64(F.lit("b"), key).bitwiseOR(F.lit(1)).alias("b"))
    out = np.zeros(-(-m // 8), np.uint8)
    # One filter a task comes back; they have the size of the result.
    for r in h.coalesce(8).mapInArrow(run, "bits binary").toLocalIterator():
        out |= np.frombuffer(bytes(r[0]), np.uint8)
    return out.tobytes(), m, k


def maybe_in(rows: DataFrame, key: str, made: tuple[bytes, int, int]) -> DataFrame:
    """The rows whose key a filter may hold: all that are in, and few others."""
    held = rows.sparkSession.sparkContext.broadcast(made)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, m, k = held.value
        on = np.unpackbits(np.frombuffer(bits, np.uint8))
        for batch in batches:
            a, b = batch.column(batch.num_columns - 2).to_pylist(), batch.column(batch.num_columns - 1).to_pylist()
            keep = [j for j, (x, y) in enumerate(zip(a, b, strict=True)) if x is not None and all(on[(x + i * y) % m] for i in range(k))]
            part = batch.take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays(part.columns[:-2], part.schema.names[:-2])

    some = F.col(key).isNotNull()
    marked = rows.withColumns({"_a": F.when(some, F.xxhash64(key)), "_b": F.when(some, F.xxhash64(F.lit("b"), key).bitwiseOR(F.lit(1)))})
    return marked.mapInArrow(run, rows.schema)


def false_positive_rate(m: Column, k: Column, n: Column) -> Column:
    return F.pow(1 - F.exp(-k * n / m), k)


def reconcile(known: DataFrame, found: DataFrame, key: str, capped: Column | None = None) -> DataFrame:
    """Findings after a scan: (key, status, count, change).

    known: key, status, count; found: key, n (detections of this scan).  A finding seen again is counted on and opened anew
    if it was resolved; an open one not seen is resolved, unless ``capped`` (of the known row) says the scan was cut short.
    """
    k = known.select(key, F.col("status").alias("_s"), F.col("count").alias("_c"), (F.lit(False) if capped is None else capped).alias("_capped"))
    j = k.join(found.select(key, F.col("n").alias("_n")), key, "full_outer")
    seen, had = F.col("_n").isNotNull(), F.col("_s").isNotNull()
    gone = had & ~seen & (F.col("_s") == "open") & ~F.coalesce("_capped", F.lit(False))
    change = F.when(~had, "detected").when(seen & (F.col("_s") == "resolved"), "reopened").when(gone, "resolved").otherwise("unchanged")
    return j.select(key, F.when(seen, "open").when(gone, "resolved").otherwise(F.col("_s")).alias("status"), (F.coalesce("_c", F.lit(0)) + F.coalesce("_n", F.lit(0))).cast("bigint").alias("count"), change.alias("change"))


def best_template(queries: DataFrame, key: str, words: str, templates: DataFrame, name: str, terms: str, least: int = 2) -> DataFrame:
    """Each query with the template that shares most of its words, at least ``least``; of equals the first by name."""
    q = queries.select(key, F.explode(F.array_distinct(words)).alias("_w"))
    t = templates.select(name, F.explode(F.array_distinct(terms)).alias("_w"))
    n = q.join(t, "_w").groupBy(key, name).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    best = n.groupBy(key).agg(F.max("n").alias("shared")).join(n.withColumnRenamed("n", "shared"), [key, "shared"]).groupBy(key, "shared").agg(F.min(name).alias(name))
    return best


def leases(rows: DataFrame, granted: str, ttl_seconds: str, now: Column) -> DataFrame:
    """Rows with ``state``: valid or expired; a lease ends when its time has passed, to the microsecond."""
    ends = F.unix_micros(granted) + F.col(ttl_seconds).cast("bigint") * 1_000_000
    return rows.withColumn("state", F.when(ends <= F.unix_micros(now), "expired").otherwise("valid"))


def page(rows: DataFrame, order: Sequence[Column | str], asked: int, offset: int = 0) -> DataFrame:
    """A page of an ordered list: of what is asked for at least 1 and at most 100 rows."""
    n = min(max(asked, 1), 100)
    return rows.orderBy(*order).offset(max(0, offset)).limit(n)


def utilisation(loaded: DataFrame, accessed: DataFrame, group: Sequence[str], file: str) -> DataFrame:
    """(group, loaded, accessed, utilisation, wasted extensions): distinct files; extensions of files loaded in vain where less than half was used."""
    a = loaded.select(*group, file).distinct().join(accessed.select(*group, file).distinct().withColumn("_u", F.lit(1)), [*group, file], "left")
    ext = F.regexp_extract(file, r"(\.[^./]+)$", 1)
    n = a.groupBy(*group).agg(F.count(F.lit(1)).alias("loaded"), F.count("_u").alias("accessed"), F.array_sort(F.collect_set(F.when(F.col("_u").isNull() & (ext != ""), F.concat(F.lit("*"), ext)))).alias("_x"))
    share = F.round(F.col("accessed") / F.col("loaded"), 4)
    return n.select(*group, "loaded", "accessed", share.alias("utilisation"), F.when(share < 0.5, F.array_join("_x", "|")).otherwise("").alias("excluded"))
