"""Normal forms and digests that need Python, in Arrow batches: Unicode composition, BLAKE2, float32 cosines."""

from __future__ import annotations

import hashlib
import unicodedata
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

try:
    from xxhash import xxh64_hexdigest as _file_digest
except ImportError:  # pragma: no cover

    def _file_digest(data: bytes) -> str:
        return hashlib.blake2b(data, digest_size=8).hexdigest()


def plain(text: str) -> str:
    """Composed characters, ends stripped, line feeds alone, blanks within lines collapsed."""
    text = unicodedata.normalize("NFC", text).strip().replace("\r\n", "\n").replace("\r", "\n")
    return "\n".join(" ".join(line.split()) for line in text.split("\n"))


def _each(f, kind: str):
    """A function of one text over columns; a null stays null."""

    @F.pandas_udf(kind)
    def run(c: pd.Series) -> pd.Series:
        return c.map(lambda x: None if x is None else f(x))

    return run


def canonical(c: Column) -> Column:
    return _each(plain, "string")(c)


def text_hash(c: Column) -> Column:
    """SHA-256 of the canonical form."""
    return F.sha2(canonical(c), 256)


def claim_hash(c: Column) -> Column:
    """SHA-256 of the canonical form in lower case."""
    return F.sha2(_each(lambda x: plain(x).lower(), "string")(c), 256)


def chunk_hash(c: Column) -> Column:
    """BLAKE2b of eight bytes."""
    return _each(lambda x: hashlib.blake2b(x.encode(), digest_size=8).hexdigest(), "string")(c)


def file_digest(c: Column) -> Column:
    """XXH64 of the bytes, BLAKE2b where that is not installed."""
    return _each(lambda x: _file_digest(x.encode()), "string")(c)


def query_key(c: Column) -> Column:
    """BLAKE2b of sixteen bytes of the text in lower case with single blanks."""
    return _each(lambda x: hashlib.blake2b(" ".join(x.lower().split()).encode(), digest_size=16).hexdigest(), "string")(c)


def batch_cosine(vector: Column, query: Sequence[float]) -> Column:
    """Cosines with one query in float32, a batch at a time; 0.0 where a vector is null, of another length or zero."""
    q = np.array(query, np.float32)

    @F.pandas_udf("float")
    def run(c: pd.Series) -> pd.Series:
        ok = c.map(lambda v: v is not None and len(v) == len(q)).to_numpy(bool)
        out = np.zeros(len(c), np.float32)
        if ok.any() and np.linalg.norm(q) > 0:
            x = np.array([np.asarray(v, np.float32) for v in c[ok]])
            n = np.linalg.norm(x, axis=1) * np.linalg.norm(q)
            out[ok] = np.where(n > 0, x @ q / np.where(n > 0, n, 1), 0)
        return pd.Series(out)

    return run(vector)
