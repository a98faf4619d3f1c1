"""Every query of the core on empty tables, and on tables with null rows and columns of clashing names."""

import os

import pytest
from pyspark.sql import functions as F

from lodestrata.plans import catalog

SOURCE = "/root/testdata/sf0.001"
CLASHING = ("n", "id", "rank", "score", "key", "value", "digest", "at", "_r", "c", "k", "state", "items", "tokens", "label", "dir", "cell", "_b", "_t", "_v", "hits", "term")


def folder(spark, at: str, kind: str) -> str:
    for name in sorted(os.listdir(SOURCE)):
        df = spark.read.parquet(f"{SOURCE}/{name}")
        out = df.limit(0)
        if kind == "null":
            one = df.limit(2)
            out = one.select(*[F.lit(None).cast(df.schema[c].dataType).alias(c) for c in df.columns]).unionByName(one)
            out = out.withColumns({c: F.lit("x") for c in CLASHING if c not in df.columns})
        out.coalesce(1).write.mode("overwrite").parquet(f"{at}/{name}")
    return at


@pytest.mark.parametrize("kind", ["empty", "null"])
def test_every_query_stands(spark, tmp_path, kind):
    at = folder(spark, str(tmp_path), kind)
    wrong = []
    for name, q in catalog.queries().items():
        try:
            q(spark, at).collect()
        except Exception as e:  # noqa: BLE001
            wrong.append((name, str(e)[:200]))
    assert not wrong
