"""File sources and sinks: repositories, whole texts, front matter, logs, keyed tables."""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Iterator, Sequence
from fnmatch import fnmatch
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestrata.runtime import parallelism

# Fixed values.
MARKERS = {"pyproject.toml": "python", "setup.py": "python", "package.json": "javascript", "Cargo.toml": "rust", "go.mod": "go", "pom.xml": "java"}
EXCLUDED = (".git", "node_modules", "__pycache__", ".venv", "dist", "build")
SENSITIVE = r"(?i)(^|/)(\.env(\..*)?|id_rsa|id_ed25519|.*\.(pem|key|p12|pfx)|[^/]*(secret|credential|password)[^/]*\.(json|ya?ml|toml|ini|env|txt|cfg))$"
BINARY = r"(?i)\.(png|jpe?g|gif|pdf|zip|gz|exe|dll|so|pyc|woff2?|ico)$"


def write_tree(files: DataFrame, root: str, text: str = "text") -> int:
    """Write each row's text as the file ``root/repo/path``, from the tasks, and count them.

    A file is written beside its place and then moved there, so that a reader sees it whole or not at all, and a task run
    again replaces what it wrote.  Rows whose path is null, empty or leads upwards are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = _open(root)
        for batch in batches:
            for repo, path, body in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                at = f"{base}/{repo}/{path}"
                fs.create_dir(at.rsplit("/", 1)[0], recursive=True)
                _put(fs, at, body.encode())
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], ["n"])

    good = F.col("repo").isNotNull() & (F.coalesce("path", F.lit("")) != "") & ~F.array_contains(F.split("path", "/"), "..")
    rows = files.where(good & F.col(text).isNotNull()).select("repo", "path", text)
    return rows.mapInArrow(run, "n bigint").agg(F.sum("n")).first()[0] or 0


def _open(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def _put(fs, at: str, data: bytes) -> None:
    """Write beside the place, then move there."""
    aside = f"{at}.{uuid.uuid4().hex}.part"
    with fs.open_output_stream(aside) as f:
        f.write(data)
    fs.move(aside, at)


def write_json(value: object, at: str) -> None:
    """A small JSON file, whole or not at all."""
    fs, path = _open(at)
    fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
    _put(fs, path, json.dumps(value, ensure_ascii=False, sort_keys=True).encode())


def read_json(at: str) -> object:
    fs, path = _open(at)
    with fs.open_input_stream(path) as f:
        return json.loads(f.read())


def repositories(root: str, include: Sequence[str] = ("*",), exclude: Sequence[str] = ()) -> list[str]:
    """Names of the directories right under a root that match one of ``include`` and none of ``exclude``, sorted."""
    from pyarrow import fs as pf

    fs, base = _open(root)
    names = [i.base_name for i in fs.get_file_info(pf.FileSelector(base, allow_not_found=True)) if i.type == pf.FileType.Directory]
    return sorted(n for n in names if any(fnmatch(n, g) for g in include) and not any(fnmatch(n, g) for g in exclude))


def listed(spark: SparkSession, root: str, repos: Sequence[str] | None = None) -> DataFrame:
    """(repo, path, size, mtime) of every file under the repositories of a root, hidden ones too; links to directories are not followed twice.

    Repositories are listed by the tasks; only their names pass through the driver.
    """
    names = repositories(root) if repos is None else list(repos)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs as pf

        fs, base = _open(root)
        for batch in batches:
            for repo in batch.column(0).to_pylist():
                todo, seen = [""], set()
                while todo:
                    under = todo.pop()
                    infos = fs.get_file_info(pf.FileSelector(f"{base}/{repo}/{under}".rstrip("/"), allow_not_found=True))
                    rows = []
                    for i in infos:
                        rel = f"{under}{i.base_name}"
                        if i.type == pf.FileType.Directory:
                            real = os.path.realpath(i.path) if isinstance(fs, pf.LocalFileSystem) else i.path
                            if real not in seen:
                                seen.add(real)
                                todo.append(rel + "/")
                        elif i.type == pf.FileType.File:
                            rows.append((repo, rel, i.size, i.mtime))
                    if rows:
                        c = list(zip(*rows, strict=True))
                        yield pa.RecordBatch.from_arrays([pa.array(c[0], pa.string()), pa.array(c[1], pa.string()), pa.array(c[2], pa.int64()), pa.array(c[3], pa.timestamp("us", "UTC"))], ["repo", "path", "size", "mtime"])

    one = spark.createDataFrame([(n,) for n in names], "repo string")
    return one.repartition(max(1, min(len(names), 4 * parallelism(spark))), "repo").mapInArrow(run, "repo string, path string, size bigint, mtime timestamp")


def contents(files: DataFrame, root: str) -> DataFrame:
    """The rows with the bytes of ``root/repo/path``, read by the tasks; null where a file is gone."""
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in files.schema.fields)
    where = [files.columns.index(c) for c in ("repo", "path")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = _open(root)

        def get(repo: str, path: str) -> bytes | None:
            try:
                with fs.open_input_stream(f"{base}/{repo}/{path}") as f:
                    return f.read()
            except FileNotFoundError:
                return None

        for whole in batches:
            for k in range(0, whole.num_rows, 256):
                batch = whole.slice(k, 256)
                data = [get(r, p) for r, p in zip(batch.column(where[0]).to_pylist(), batch.column(where[1]).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(data, pa.binary())], [*batch.schema.names, "content"])

    return files.repartition(parallelism(files.sparkSession), "repo", "path").mapInArrow(run, kinds + ", content binary")


def scan(spark: SparkSession, root: str, extensions: Sequence[str] = ("py", "js", "json", "toml", "xml", "sh", "md", "sql"), most_bytes: int = 1 << 20, repos: Sequence[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(files, skipped) under a root of repositories.

    files: repo, path, extension, size, mtime, content_hash, text.  skipped: repo, path, reason out of excluded,
    extension, empty, too_large, sensitive_path, sensitive_content, binary.  Files that their path or size rules out are
    not read.  Bytes that are no UTF-8 become U+FFFD.
    """
    f = listed(spark, root, repos)
    ext = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    reason = (
        F.when(F.arrays_overlap(F.split("path", "/"), F.array(*map(F.lit, EXCLUDED))), "excluded")
        .when(F.col("path").rlike(SENSITIVE), "sensitive_path").when(F.col("path").rlike(BINARY), "binary").when(~ext.isin(*extensions), "extension")
        .when(F.col("size") == 0, "empty").when(F.col("size") > most_bytes, "too_large")
    )
    named = f.withColumn("reason", reason)
    read = contents(named.where(F.col("reason").isNull()).select("repo", "path", "size", "mtime"), root)
    inside = F.when(F.col("content").isNull(), "gone").when(F.substring("content", 1, 64).cast("string").contains("PRIVATE KEY"), "sensitive_content").when(F.hex(F.substring("content", 1, 512)).rlike("^(?:[0-9A-F]{2})*00"), "binary")
    marked = read.withColumn("reason", inside)
    good = marked.where(F.col("reason").isNull()).select("repo", "path", ext.alias("extension"), "size", "mtime", F.substring(F.sha2("content", 256), 1, 16).alias("content_hash"), F.make_valid_utf8(F.col("content").cast("string")).alias("text"))
    skipped = named.where(F.col("reason").isNotNull()).select("repo", "path", "reason").unionByName(marked.where(F.col("reason").isNotNull()).select("repo", "path", "reason"))
    return good, skipped


def bounded(files: DataFrame, depth: int = 2, most: int = 120) -> DataFrame:
    """Of every repository the first ``most`` files by path that lie at most ``depth`` folders deep, in no excluded folder."""
    parts = F.split("path", "/")
    near = files.where((F.size(parts) <= depth + 1) & ~F.arrays_overlap(parts, F.array(*map(F.lit, EXCLUDED))))
    w = Window.partitionBy("repo").orderBy("path")
    return near.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= most).drop("_r")


def signature(files: DataFrame, keywords: Sequence[str], most: int = 20) -> DataFrame:
    """(repo, languages, frameworks): languages of marker files, and which keywords the first ``most`` Python files by path hold."""
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    lang = F.create_map(*[F.lit(x) for kv in MARKERS.items() for x in kv])[name]
    languages = files.groupBy("repo").agg(F.array_sort(F.collect_set(lang)).alias("languages"))
    w = Window.partitionBy("repo").orderBy("path")
    first = files.where(F.col("path").endswith(".py")).withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= most)
    hit = first.select("repo", F.explode(F.filter(F.array(*map(F.lit, keywords)), lambda k: F.contains(F.col("text"), k))).alias("k"))
    found = hit.groupBy("repo").agg(F.array_sort(F.collect_set("k")).alias("frameworks"))
    return languages.join(found, "repo", "left").select("repo", "languages", F.coalesce("frameworks", F.array().cast("array<string>")).alias("frameworks"))


def tail_lines(at: str, most_bytes: int = 512_000) -> list[str]:
    """Lines of the last ``most_bytes`` of a file, without the first if it is cut; a missing file has none."""
    fs, path = _open(at)
    info = fs.get_file_info(path)
    if not info.is_file:
        return []
    begin = max(0, info.size - most_bytes)
    with fs.open_input_file(path) as f:
        f.seek(begin)
        rows = f.read().decode("utf-8", "replace").split("\n")
    return [r for r in (rows[1:] if begin else rows) if r.strip()]


def tails(files: DataFrame, root: str, most_bytes: int = 512_000) -> DataFrame:
    """The rows with ``lines``: the last lines of ``root/repo/path``, as :func:`tail_lines` reads them, read by the tasks."""
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in files.schema.fields)
    where = [files.columns.index(c) for c in ("repo", "path")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [tail_lines(f"{root}/{r}/{p}", most_bytes) for r, p in zip(batch.column(where[0]).to_pylist(), batch.column(where[1]).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(got, pa.list_(pa.string()))], [*batch.schema.names, "lines"])

    return files.mapInArrow(run, kinds + ", lines array<string>")


def branch_heads(commits: DataFrame) -> DataFrame:
    """(repo, branch, sha): the latest commit of every branch, of equals the greatest sha."""
    return commits.where("repo is not null and branch is not null and sha is not null").groupBy("repo", "branch").agg(F.max_by("sha", F.struct("committed_at", "sha")).alias("sha"))


def sync(index: DataFrame, changed: DataFrame, deleted: DataFrame, keys: Sequence[str]) -> DataFrame:
    """An index with changed rows put in for those of their keys and deleted keys taken out."""
    gone = changed.select(*keys).unionByName(deleted.select(*keys)).distinct()
    kept = index.join(gone, list(keys), "left_anti")
    return kept.unionByName(changed.join(deleted.select(*keys).distinct(), list(keys), "left_anti"))


def cache_state(wanted: DataFrame, cache: DataFrame, keys: Sequence[str], mark: str) -> DataFrame:
    """Each wanted row with ``state``: hit if the cache has its key with the same mark, stale with another, else compile."""
    have = cache.groupBy(*keys).agg(F.max(mark).alias("_have"), F.lit(True).alias("_in"))
    state = F.when(F.col("_in").isNull(), "compile").when(F.col(mark).eqNullSafe(F.col("_have")), "hit").otherwise("stale")
    return wanted.join(have, list(keys), "left").withColumn("state", state).drop("_have", "_in")


def telemetry(kind: Column, source: Column, target: Column, message: Column) -> Column:
    """One line of JSON: a message has at most 500 characters, and 200 if those take 3,500 bytes or more."""
    m = F.substring(message, 1, 500)
    return F.to_json(F.struct(kind.alias("kind"), source.alias("source"), target.alias("target"), F.when(F.octet_length(m) < 3500, m).otherwise(F.substring(message, 1, 200)).alias("message")))


def write_indexes(tables: dict[str, DataFrame], at: str, build: str) -> DataFrame:
    """Write every table under ``at`` by its name, stamped with the build, and then the manifest (name, rows, build_id), which is given back.

    The manifest comes last: where it is, all tables are.
    """
    for name, df in tables.items():
        write_index(df, f"{at}/{name}", build)
    spark = next(iter(tables.values())).sparkSession
    rows = [(name, spark.read.parquet(f"{at}/{name}").count(), build) for name in sorted(tables)]
    spark.createDataFrame(rows, "name string, rows bigint, build_id string").coalesce(1).write.mode("overwrite").parquet(f"{at}/manifest")
    return spark.read.parquet(f"{at}/manifest")


def discover(files: DataFrame) -> DataFrame:
    """(repo, is_git, languages): directories with a version-control folder or a marker file of a language."""
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    lang = F.create_map(*[F.lit(x) for kv in MARKERS.items() for x in kv])[name]
    return files.groupBy("repo").agg(F.bool_or(F.col("path").startswith(".git/")).alias("is_git"), F.array_sort(F.collect_set(lang)).alias("languages")).where(F.col("is_git") | (F.size("languages") > 0))


def whole_texts(spark: SparkSession, path: str) -> DataFrame:
    """(path, text) of whole files."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def front_matter(text: Column) -> Column:
    """The ``key: value`` pairs of a leading block between --- lines, as a map; inline lists stay as they are, quotes go.

    A text without a block gives an empty map.  Of a repeated key the last value stays.
    """
    block = F.regexp_extract(F.regexp_replace(text, r"\r\n", "\n"), r"(?s)\A---\n(.*?)\n---", 1)
    joined = F.regexp_replace(block, r"\n[ \t]*-[ \t]+", "\u0001")
    pairs = F.filter(F.split(joined, "\n"), lambda x: x.rlike(r"^\w[\w-]*:"))
    clean = lambda v: F.regexp_replace(F.regexp_replace(F.trim(v), r"^[\"']|[\"']$", ""), "^\u0001", "")
    keyed = F.transform(pairs, lambda x: F.struct(F.regexp_extract(x, r"^([\w-]+):", 1).alias("k"), F.replace(clean(F.regexp_replace(x, r"^[\w-]+:", "")), F.lit("\u0001"), F.lit(",")).alias("v")))
    names = F.array_distinct(F.transform(keyed, lambda p: p["k"]))
    last = lambda k: F.element_at(F.filter(keyed, lambda p: p["k"] == k), -1)["v"]
    return F.map_from_arrays(names, F.transform(names, last))


def list_value(value: Column) -> Column:
    """Items of an inline ``[a, b]`` or of a block list."""
    return F.filter(F.transform(F.split(F.regexp_replace(value, r"^\[|\]$", ""), ","), lambda x: F.regexp_replace(F.trim(x), r"^[\"']|[\"']$", "")), lambda x: x != "")


def json_log(spark: SparkSession, path: str, schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """(rows, bad): rows of a log of JSON lines by a declared schema, and the lines that are none."""
    full = T.StructType([*schema.fields, T.StructField("_corrupt_record", T.StringType())])
    lines = spark.read.text(path).where(F.trim("value") != "")
    parsed = lines.select("value", F.from_json("value", full, {"mode": "PERMISSIVE"}).alias("r"))
    good = parsed.where(F.col("r._corrupt_record").isNull()).select(*[F.col(f"r.{f.name}").alias(f.name) for f in schema.fields])
    return good, parsed.where(F.col("r._corrupt_record").isNotNull()).select("value")


def git_log(text: DataFrame, column: str = "value", keep: Sequence[str] = ()) -> DataFrame:
    """(sha, author, date, subject, body, files) from exported log text of records split by RS and fields by US.

    Fields: sha, author, date, subject, body, name list.  The body may span lines; files are the last field alone.  Columns of
    ``keep`` are carried along.
    """
    rec = text.select(*keep, F.explode(F.split(column, "\x1e")).alias("r")).where(F.trim("r") != "")
    f = F.split("r", "\x1f")
    names = F.filter(F.transform(F.split(F.coalesce(F.get(f, F.lit(5)), F.lit("")), "\n"), lambda x: F.trim(x)), lambda x: x != "")
    return rec.select(*keep, F.trim(F.get(f, F.lit(0))).alias("sha"), F.get(f, F.lit(1)).alias("author"), F.get(f, F.lit(2)).alias("date"), F.get(f, F.lit(3)).alias("subject"), F.get(f, F.lit(4)).alias("body"), names.alias("files"))


def upsert(table: DataFrame, rows: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """The table with rows added or replaced: of every key the row with the greatest ``order``, new rows before old at a tie."""
    both = table.withColumn("_new", F.lit(0)).unionByName(rows.withColumn("_new", F.lit(1)))
    w = Window.partitionBy(*keys).orderBy(F.desc(order), F.desc("_new"))
    return both.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r", "_new")


def delete(table: DataFrame, ids: DataFrame, keys: Sequence[str]) -> DataFrame:
    return table.join(ids.select(*keys).distinct(), list(keys), "left_anti")


def write_partitioned(table: DataFrame, path: str, by: Sequence[str]) -> None:
    """Committed parquet sink, rows of a partition together so that each gets few files."""
    table.repartition(*by).write.mode("overwrite").partitionBy(*by).parquet(path)


def write_index(index: DataFrame, path: str, build: str) -> None:
    """An index table stamped with the version of the build that made it."""
    index.withColumn("build_id", F.lit(build)).write.mode("overwrite").parquet(path)


def addressed(blobs: DataFrame, content: str) -> DataFrame:
    """Blobs once per content: (sha, prefix, content), to be partitioned by the prefix."""
    sha = F.sha2(F.col(content), 256)
    return blobs.select(sha.alias("sha"), F.substring(sha, 1, 2).alias("prefix"), content).dropDuplicates(["sha"])


def chunks(files: DataFrame, lines: int = 60, overlap: int = 10) -> DataFrame:
    """Windows of lines of every file: (repo, path, chunk_index, start_byte, end_byte, text, content_hash).

    Lines keep their ends, so bytes are those of the file; windows of blanks alone are left out and don't count.  One pass
    over the lines of a file; null and empty texts give no rows.
    """
    step = lines - overlap

    def windows(text: str) -> Iterator[tuple[int, int, int, str]]:
        rows = text.split("\n")
        rows = [r + "\n" for r in rows[:-1]] + ([rows[-1]] if rows[-1] else [])
        ends = [0, *accumulate(len(r.encode()) for r in rows)]
        n = 0
        for at in range(0, max(1, len(rows) - overlap), step):
            part = "".join(rows[at : at + lines])
            if part.strip(" \t\n\r\x0b\x0c"):
                yield n, ends[at], ends[min(at + lines, len(rows))], part
                n += 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, got = [], []
            for k, text in enumerate(batch.column(2)):
                for w in windows(text.as_py()):
                    at.append(k)
                    got.append(w)
            cols = list(zip(*got, strict=True)) if got else [[]] * 4
            part = batch.take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *[pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int64(), pa.int64(), pa.string()), strict=True)]], ["repo", "path", "chunk_index", "start_byte", "end_byte", "text"])

    kinds = ", ".join(f"{c} {files.schema[c].dataType.simpleString()}" for c in ("repo", "path"))
    cut = files.select("repo", "path", "text").where(F.length("text") > 0).mapInArrow(run, kinds + ", chunk_index int, start_byte bigint, end_byte bigint, text string")
    return cut.withColumn("content_hash", F.sha2("text", 256))
