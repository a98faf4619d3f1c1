"""Streaming forms of the log queries: windows with a watermark, deduplication, latest state, incremental mining."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

EVENTS = T.StructType([T.StructField("event_id", T.LongType()), T.StructField("ts", T.TimestampNTZType()), T.StructField("user_id", T.LongType()), T.StructField("event_type", T.StringType()), T.StructField("value", T.DoubleType()), T.StructField("props", T.StringType())])


def read(spark: SparkSession, folder: str, pattern: str = "events.parquet", schema: T.StructType = EVENTS) -> DataFrame:
    """A stream of parquet files that match a name; ts becomes an instant (the session is in UTC)."""
    return spark.readStream.schema(schema).option("pathGlobFilter", pattern).parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))


def tumbling(events: DataFrame, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Counts and sums per window and type; rows later than the watermark are dropped in append mode."""
    g = events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return g.select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "6 hours", late: str = "1 hour") -> DataFrame:
    g = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return g.select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "user_id", "n")


def deduplicated(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Each event id once within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def outcomes(events: DataFrame) -> DataFrame:
    """(event_id, user_id, outcome): pass for purchases and sign-ups, fail for errors; the rest is left out.  No cap: no row is lost."""
    outcome = F.when(F.col("event_type").isin("purchase", "signup"), "pass").when(F.col("event_type") == "error", "fail")
    return events.withColumn("outcome", outcome).where(F.col("outcome").isNotNull()).select("event_id", "user_id", "ts", "outcome")


def open_state(events: DataFrame) -> DataFrame:
    """Per user whether the last event is an error that nothing has followed, kept over batches as state.

    Columns: user_id, open, since, errors, seen (events taken so far), late (events older than one already taken, which
    change nothing but this count).  A user's state is one small row and stays as long as the stream runs.
    """
    state = "since timestamp, last timestamp, open boolean, errors bigint, seen bigint, late bigint"
    out = "user_id bigint, open boolean, since timestamp, errors bigint, seen bigint, late bigint"

    def update(key: tuple, frames: Iterator[pd.DataFrame], s: GroupState) -> Iterator[pd.DataFrame]:
        since, last, is_open, errors, seen, late = s.get if s.exists else (None, None, False, 0, 0, 0)
        rows = pd.concat(list(frames)).sort_values(["ts", "event_id"])
        for t, kind in zip(rows["ts"], rows["event_type"], strict=True):
            seen += 1
            if last is not None and t < last:
                late += 1
                continue
            last = t
            if kind == "error":
                errors += 1
                since = since if is_open else t
                is_open = True
            else:
                is_open, since = False, None
        s.update((since, last, is_open, errors, seen, late))
        yield pd.DataFrame({"user_id": [key[0]], "open": [is_open], "since": pd.Series([since], dtype="datetime64[ns]"), "errors": [errors], "seen": [seen], "late": [late]})

    return events.where(F.col("user_id").isNotNull() & F.col("ts").isNotNull()).groupBy("user_id").applyInPandasWithState(update, out, state, "update", GroupStateTimeout.NoTimeout)


def drain(stream: DataFrame, at: str, mode: str = "append", handle: Callable[[DataFrame, int], None] | None = None) -> DataFrame:
    """Run a stream over what is there and stop; what it gave is a parquet table under ``at``, read back.

    Every micro-batch is written under its own number, so that a batch run again after a failure replaces itself.  In
    complete mode the last batch is what is there; in update mode rows have the number ``_batch`` of the batch they come
    from, and of a key the last one holds.  ``handle`` gets every batch instead, and nothing is read back.
    """
    spark = stream.sparkSession

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{at}/rows/_batch={number}")

    w = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{at}/state").trigger(availableNow=True)
    w.foreachBatch(handle or keep).start().awaitTermination()
    empty = spark.createDataFrame([], stream.schema).withColumn("_batch", F.lit(0))
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{at}/rows")
    if handle or not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return empty
    schema = T.StructType([*stream.schema.fields, T.StructField("_batch", T.LongType())])
    rows = spark.read.schema(schema).parquet(f"{at}/rows")
    if mode != "complete":
        return rows
    last = rows.agg(F.max("_batch")).first()[0]
    return rows.where(F.col("_batch") == (last if last is not None else 0))
