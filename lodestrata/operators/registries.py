"""Plug-in surfaces: results kept by the call that made them, analysers of texts by name, tools by name."""

from __future__ import annotations

import json
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.runtime import stage


class Memo:
    """Tables made once a session: a call with the same operation and arguments reads what the first one wrote."""

    def __init__(self) -> None:
        self.made: dict[tuple, DataFrame] = {}
        self.hits = 0

    def cached(self, name: str) -> Callable[[Callable[..., DataFrame]], Callable[..., DataFrame]]:
        def wrap(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
            def call(spark: SparkSession, *args, **named) -> DataFrame:
                key = (spark.sparkContext.applicationId, name, repr(args), repr(sorted(named.items())))
                if key in self.made:
                    self.hits += 1
                else:
                    self.made[key] = stage(f(spark, *args, **named), name)
                return self.made[key]

            return call

        return wrap


#: Analysers by name: each gives a number for a text.
ANALYSERS: dict[str, Callable[[str], float]] = {}


def analyser(name: str) -> Callable[[Callable[[str], float]], Callable[[str], float]]:
    def keep(f: Callable[[str], float]) -> Callable[[str], float]:
        ANALYSERS[name] = f
        return f

    return keep


@analyser("comments")
def comments(text: str) -> float:
    """Share of lines that are comments."""
    lines = text.split("\n")
    return sum(x.lstrip(" \t").startswith(("#", "//")) for x in lines) / len(lines)


@analyser("long_lines")
def long_lines(text: str) -> float:
    """Share of lines over 100 characters."""
    lines = text.split("\n")
    return sum(len(x) > 100 for x in lines) / len(lines)


def analysed(text: Column, name: str) -> Column:
    """The number an analyser gives, to six places; null for a null text."""
    f = ANALYSERS[name]

    @F.pandas_udf("double")
    def run(c: pd.Series) -> pd.Series:
        return c.map(lambda x: None if x is None else round(f(x), 6))

    return run(text)


class Tools:
    """Tools by name: a request and an answer in JSON; the rows of an answer are limited to 1..100."""

    def __init__(self) -> None:
        self.made: dict[str, tuple[str, Callable[..., DataFrame]]] = {}

    def tool(self, name: str, about: str) -> Callable[[Callable[..., DataFrame]], Callable[..., DataFrame]]:
        def keep(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
            self.made[name] = (about, f)
            return f

        return keep

    def call(self, spark: SparkSession, folder: str, request: str) -> str:
        """{"tool", "arguments", "limit"} -> {"rows"} or {"error"}; a request that is no JSON or names no tool is an error."""
        try:
            r = json.loads(request)
            about, f = self.made[r["tool"]]
        except (ValueError, KeyError, TypeError) as e:
            return json.dumps({"error": f"{type(e).__name__}: {e}"})
        n = min(max(int(r.get("limit", 20)), 1), 100)
        rows = f(spark, folder, **r.get("arguments", {})).limit(n).select(F.to_json(F.struct("*"))).collect()
        return json.dumps({"rows": [json.loads(x[0]) for x in rows]})
