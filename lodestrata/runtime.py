"""Session helpers shared by every operator: tables, shared storage, lineage cuts."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A parquet table of the data folder; a file or a folder of part files."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as the cluster names it.

    Read from ``spark.checkpoint.dir``.  Only where that is unset (local tests) a temporary folder is chosen.
    """
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        master = spark.sparkContext.master
        if not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        at = os.path.join(tempfile.gettempdir(), "lodestrata-shared")
        os.makedirs(at, exist_ok=True)
        at = "file://" + at
    return at


def shared_path(spark: SparkSession, label: str) -> str:
    """A new place in the shared folder, which is removed when the session's application ends."""
    at = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(path)
    return at


def stage(df: DataFrame, label: str = "stage") -> DataFrame:
    """Cut lineage: write ``df`` as a parquet table in the shared folder and read it back.

    The table survives the loss of any executor and is column-pruned by whatever reads it.  It is removed when the
    session's application ends.
    """
    spark = df.sparkSession
    at = shared_path(spark, label)
    df.write.option("compression", "zstd").parquet(at)
    return spark.read.schema(df.schema).parquet(at)


def parallelism(spark: SparkSession) -> int:
    """Shuffle partitions of the session, which the cluster sizes to its data."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
