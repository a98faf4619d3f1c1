"""Streams that keep a table up to date: each micro-batch makes the next version of it, and a batch run again makes the same one."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lodestrata.streaming.events import drain


class Versions:
    """Versions of a table under a folder: version n is made by batch n from the version before."""

    def __init__(self, spark: SparkSession, at: str, schema: str | T.StructType) -> None:
        self.spark, self.at, self.schema = spark, at, schema
        self.fs = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _there(self, n: int) -> bool:
        return self.fs.exists(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.at}/v{n}/_SUCCESS"))

    def latest(self, before: int | None = None) -> DataFrame:
        """The last whole version (under ``before``); an empty table if there is none."""
        n = -1
        while self._there(n + 1) and (before is None or n + 1 < before):
            n += 1
        return self.spark.read.schema(self.schema).parquet(f"{self.at}/v{n}") if n >= 0 else self.spark.createDataFrame([], self.schema)

    def follow(self, stream: DataFrame, state: str, step: Callable[[DataFrame, DataFrame], DataFrame]) -> DataFrame:
        """Take what the stream has new: version n + 1 is ``step`` (version n, rows of the batch)."""

        def make(batch: DataFrame, number: int) -> None:
            step(self.latest(number), batch).write.mode("overwrite").parquet(f"{self.at}/v{number}")

        drain(stream, state, handle=make)
        return self.latest()


def replace_rows(keys: Sequence[str], order: Sequence[str], gone: str) -> Callable[[DataFrame, DataFrame], DataFrame]:
    """A step that keeps of every key the last row in order; a row whose ``gone`` is true takes its key out."""

    def step(have: DataFrame, batch: DataFrame) -> DataFrame:
        rest = [c for c in have.columns if c not in keys]
        last = batch.groupBy(*keys).agg(F.max_by(F.struct(*rest, gone), F.struct(*order)).alias("r"))
        kept = have.join(last.select(*keys), list(keys), "left_anti")
        return kept.unionByName(last.where(~F.col(f"r.{gone}")).select(*keys, *[F.col(f"r.{c}").alias(c) for c in rest]))

    return step


def learned_threshold(hits: DataFrame, key: str, start: float = 0.5, target: float = 0.8, warm: int = 20, gap: float = 0.02) -> DataFrame:
    """(key, samples, hit_rate, threshold) of every key with new hits (key, ts, event_id, hit); three numbers a key are its state.

    The same fold as the batch operator, over rows in order of ts and event_id within a batch.
    """
    kind = hits.schema[key].dataType.simpleString()

    def update(name: tuple, frames: Iterator[pd.DataFrame], s: GroupState) -> Iterator[pd.DataFrame]:
        n, h, t = s.get if s.exists else (0, 0, start)
        rows = pd.concat(list(frames)).sort_values(["ts", "event_id"])
        for hit in rows["hit"]:
            n, h = n + 1, h + int(bool(hit))
            if n >= warm:
                t = t + gap if h / n < target else t - gap if h / n > target + 0.1 else t
            t = round(min(0.9, max(0.15, t)), 4)
        s.update((n, h, t))
        yield pd.DataFrame({key: [name[0]], "samples": [n], "hit_rate": [round(h / n, 6)], "threshold": [t]})

    rows = hits.where(F.col(key).isNotNull()).select(key, "ts", "event_id", "hit").groupBy(key)
    return rows.applyInPandasWithState(update, f"{key} {kind}, samples bigint, hit_rate double, threshold double", "n bigint, h bigint, t double", "update", GroupStateTimeout.NoTimeout)
