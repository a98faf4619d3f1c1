"""A deterministic embedder of bags of words, in Arrow batches: the default for anything that wants vectors."""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_WORD = re.compile(r"[a-z0-9_]+")


def bag(text: str | None, dim: int) -> list[float]:
    """Unit vector of hashed word counts; zeros for no words."""
    v = np.zeros(dim)
    for w in _WORD.findall((text or "").lower()):
        v[zlib.crc32(w.encode()) % dim] += 1
    n = np.linalg.norm(v)
    return (v / n if n else v).astype(np.float32).tolist()


def embedder(dim: int = 64) -> Callable[[Column], Column]:
    @F.pandas_udf("array<float>")
    def embed(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: bag(t, dim))

    return embed
