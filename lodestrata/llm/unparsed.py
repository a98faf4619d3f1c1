"""Source files that do not parse: every file is read by the parser of the language its extension names."""

from __future__ import annotations

import sys
import threading
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.llm.syntax import data, javascript, python
from lodestrata.llm.syntax.base import Fault

#: Bytes of stack for texts nested very deeply: some hundred thousand brackets.
STACK = 512 << 20
LANGUAGES: dict[str, tuple[str, Callable[[str], list[Fault]]]] = {
    "py": ("python", python.check),
    "js": ("javascript", javascript.check),
    "json": ("json", data.check_json),
    "toml": ("toml", data.check_toml),
    "xml": ("xml", data.check_xml),
}


def faults(extension: str, text: str) -> list[Fault] | None:
    """All syntax errors of a text, None if they can't be told.

    One nested too deeply for the ordinary stack is read again on a larger one, of ``STACK`` bytes; one too deep for that
    as well is neither valid nor invalid.
    """
    check = LANGUAGES[extension][1]
    try:
        return check(text)
    except RecursionError:
        out: list[list[Fault] | None] = []

        def again() -> None:
            try:
                out.append(check(text))
            except RecursionError:
                out.append(None)

        limit, size = sys.getrecursionlimit(), threading.stack_size(STACK)
        sys.setrecursionlimit(400_000)
        try:
            t = threading.Thread(target=again)
            t.start()
            t.join()
        finally:
            sys.setrecursionlimit(limit)
            threading.stack_size(size)
        return out[0]


SCHEMA = "repo string, path string, language string, n_errors int, first_line int, first_cause string, errors array<struct<line: int, cause: string>>"


def parsed(files: DataFrame) -> DataFrame:
    """One row per file in a language with a parser: its syntax errors, none if it is valid.

    Columns: repo, path, language, n_errors, first_line, first_cause, errors.  A null text counts as empty; rows with
    a null repo or path are left out; a repeated row counts once.  If a file stands there in several states, errors
    are those of the state scanned last.  n_errors is null where a text is nested too deeply to tell.  Only repo, path, text and scanned_at are read.
    """
    extension = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    rows = files.select("repo", "path", F.coalesce("text", F.lit("")).alias("text"), F.unix_micros("scanned_at").alias("at")).where(
        F.col("repo").isNotNull() & F.col("path").isNotNull() & extension.isin(*LANGUAGES)
    )
    struct = pa.list_(pa.struct([("line", pa.int32()), ("cause", pa.string())]))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for path, text in zip(batch.column(1).to_pylist(), batch.column(2), strict=True):
                ext = path.rsplit(".", 1)[-1].lower()
                found.append((LANGUAGES[ext][0], faults(ext, text.as_py())))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), batch.column(1), pa.array([x for x, _ in found], pa.string()), pa.array([None if e is None else len(e) for _, e in found], pa.int32()),
                    pa.array([e[0].line if e else None for _, e in found], pa.int32()), pa.array([e[0].cause if e else None for _, e in found], pa.string()),
                    pa.array([[{"line": f.line, "cause": f.cause} for f in e or []] for _, e in found], struct), batch.column(3), batch.column(4),
                ],
                ["repo", "path", "language", "n_errors", "first_line", "first_cause", "errors", "at", "h"],
            )

    out = rows.select("repo", "path", "text", "at", F.xxhash64("text").alias("h")).mapInArrow(read, SCHEMA + ", at bigint, h bigint")
    state = F.struct(F.coalesce("at", F.lit(-(1 << 62))), F.coalesce("h", F.lit(0)))
    names = ["language", "n_errors", "first_line", "first_cause", "errors"]
    return out.groupBy("repo", "path").agg(F.max_by(F.struct(*names), state).alias("s")).select("repo", "path", *[f"s.{n}" for n in names])


def unparsed(files: DataFrame) -> DataFrame:
    """(repo, path) of the files that are not valid in the language of their extension."""
    return parsed(files).where(F.col("n_errors") > 0).select("repo", "path")


def acceptance(files: DataFrame) -> DataFrame:
    """Per repository and language: files, files that do not parse, their share, and the most frequent first cause."""
    p = parsed(files).withColumn("bad", F.col("n_errors") > 0)
    causes = p.where("bad").groupBy("repo", "language", "first_cause").agg(F.count(F.lit(1)).alias("n"))
    top = causes.groupBy("repo", "language").agg(F.max_by("first_cause", F.struct("n", "first_cause")).alias("usual_cause"))
    rate = p.groupBy("repo", "language").agg(F.count(F.lit(1)).alias("files"), F.count_if("bad").alias("invalid"))
    return rate.join(top, ["repo", "language"], "left").select("repo", "language", "files", "invalid", (F.col("invalid") / F.col("files")).alias("invalid_share"), "usual_cause")
