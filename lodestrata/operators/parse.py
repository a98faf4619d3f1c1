"""Facts from source text: Python by its syntax tree (Arrow batches), other languages by built-in patterns."""

from __future__ import annotations

import ast
import hashlib
import re
import warnings
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def tree(text: str | None) -> ast.Module | None:
    """The syntax tree, or nothing if the text is null or does not parse."""
    if text is None:
        return None
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            return ast.parse(text.replace("\0", "\x01") if "\0" in text else text)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return None


_DEFS = (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)


def symbols_of(module: ast.Module) -> list[tuple[str, str, int, int]]:
    """(dotted name, kind, first line, last line) of every definition, in order of the text.

    A definition in a class is a method, asynchronous or not.  Definitions inside branches and loops are not listed.
    """
    out: list[tuple[str, str, int, int]] = []
    todo: list[tuple[list[ast.stmt], str, bool]] = [(module.body, "", False)]
    while todo:
        body, prefix, in_class = todo.pop()
        for d in body:
            if not isinstance(d, _DEFS):
                continue
            is_class = isinstance(d, ast.ClassDef)
            kind = "class" if is_class else "method" if in_class else "async_function" if isinstance(d, ast.AsyncFunctionDef) else "function"
            out.append((prefix + d.name, kind, d.lineno, d.end_lineno or d.lineno))
            todo.append((d.body, f"{prefix}{d.name}.", is_class))
    return sorted(out, key=lambda s: (s[2], s[3], s[0]))


def calls_of(module: ast.Module) -> list[tuple[int, str]]:
    """(line, simple name) of every call of a name or an attribute."""
    out = []
    for node in ast.walk(module):
        if isinstance(node, ast.Call):
            f = node.func
            name = f.id if isinstance(f, ast.Name) else f.attr if isinstance(f, ast.Attribute) else None
            if name:
                out.append((node.lineno, name))
    return sorted(out)


def imports_of(module: ast.Module, here: str) -> list[str]:
    """Dotted targets of imports: modules, and module.name of every imported name; relative ones resolved from ``here``."""
    out: set[str] = set()
    for node in ast.walk(module):
        if isinstance(node, ast.Import):
            out.update(a.name for a in node.names)
        elif isinstance(node, ast.ImportFrom):
            base = node.module or ""
            if node.level:
                parts = here.split(".")
                if node.level > len(parts):
                    continue
                base = ".".join([*parts[: len(parts) - node.level], *([base] if base else [])])
            if base:
                out.add(base)
                out.update(f"{base}.{a.name}" for a in node.names if a.name != "*")
    return sorted(out)


def facts_of(module: ast.Module) -> dict:
    every = list(ast.walk(module))
    doc = ast.get_docstring(module) or ""
    assigned = [t for n in every if isinstance(n, (ast.Assign, ast.AnnAssign)) for t in (n.targets if isinstance(n, ast.Assign) else [n.target])]
    return {
        "imports": sorted({a.name.split(".")[0] for n in ast.walk(module) if isinstance(n, ast.Import) for a in n.names} | {(n.module or "").split(".")[0] for n in ast.walk(module) if isinstance(n, ast.ImportFrom) and not n.level and n.module}),
        "classes": sorted({n.name for n in every if isinstance(n, ast.ClassDef)}),
        "functions": sorted({n.name for n in every if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef))}),
        "constants": sorted({t.id for t in assigned if isinstance(t, ast.Name) and t.id.isupper()}),
        "decorators": sorted({ast.unparse(d).split("(")[0] for n in ast.walk(module) if isinstance(n, _DEFS) for d in n.decorator_list}),
        "summary": doc[:200],
    }


def _map(df: DataFrame, keys: list[str], text: str, schema: str, fields: list[tuple[str, pa.DataType]], rows: Callable[[tuple, str | None], list[tuple]]) -> DataFrame:
    """Rows of a function of (keys, text) in Arrow batches."""
    names = keys + [n for n, _ in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            index, out = [], []
            heads = [batch.column(j).to_pylist() for j in range(len(keys))]
            for k in range(batch.num_rows):
                for r in rows(tuple(h[k] for h in heads), batch.column(len(keys))[k].as_py()):
                    index.append(k)
                    out.append(r)
            part = batch.take(pa.array(index, pa.int64()))
            cols = list(zip(*out, strict=True)) if out else [[]] * len(fields)
            yield pa.RecordBatch.from_arrays([*[part.column(j) for j in range(len(keys))], *[pa.array(c, t) for c, (_, t) in zip(cols, fields, strict=True)]], names)

    head = ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in keys)
    return df.select(*keys, text).mapInArrow(run, f"{head}, {schema}")


def python_symbols(files: DataFrame) -> DataFrame:
    """(repo, path, qualname, kind, start_line, end_line) of Python files (repo, path, text) that parse."""
    def rows(_: tuple, text: str | None) -> list[tuple]:
        t = tree(text)
        return symbols_of(t) if t else []

    return _map(files, ["repo", "path"], "text", "qualname string, kind string, start_line int, end_line int", [("qualname", pa.string()), ("kind", pa.string()), ("start_line", pa.int32()), ("end_line", pa.int32())], rows)


def python_calls(files: DataFrame) -> DataFrame:
    """(repo, path, line, callee) of every call."""
    def rows(_: tuple, text: str | None) -> list[tuple]:
        t = tree(text)
        return calls_of(t) if t else []

    return _map(files, ["repo", "path"], "text", "line int, callee string", [("line", pa.int32()), ("callee", pa.string())], rows)


def python_imports(files: DataFrame) -> DataFrame:
    """(repo, path, target): import targets, relative ones resolved against the file's module."""
    def rows(keys: tuple, text: str | None) -> list[tuple]:
        t = tree(text)
        here = keys[1].removesuffix(".py").replace("/", ".")
        return [(x,) for x in imports_of(t, here)] if t else []

    return _map(files, ["repo", "path"], "text", "target string", [("target", pa.string())], rows)


def python_top_imports(files: DataFrame) -> DataFrame:
    """(repo, path, package): the first names of absolute imports at the top of a file's statements."""
    def rows(_: tuple, text: str | None) -> list[tuple]:
        t = tree(text)
        found = set()
        for n in ast.walk(t) if t else ():
            if isinstance(n, ast.Import):
                found |= {a.name.partition(".")[0] for a in n.names}
            elif isinstance(n, ast.ImportFrom) and not n.level and n.module:
                found.add(n.module.partition(".")[0])
        return [(x,) for x in sorted(found)]

    return _map(files, ["repo", "path"], "text", "package string", [("package", pa.string())], rows)


def locus_of(module: ast.Module, line: int) -> tuple[str, str]:
    """(kind:scope, hash of the kinds of the children) of the innermost node that begins on a line; unknown:global without one."""
    found, kinds = "unknown:global", []
    todo: list[tuple[ast.AST, str]] = [(module, "global")]
    while todo:
        node, scope = todo.pop(0)
        inner = node.name if isinstance(node, _DEFS) else scope
        if getattr(node, "lineno", None) == line:
            found, kinds = f"{type(node).__name__}:{inner}", [type(c).__name__ for c in ast.iter_child_nodes(node)]
        todo[:0] = [(c, inner) for c in ast.iter_child_nodes(node)]
    return found, hashlib.sha256("-".join(kinds).encode()).hexdigest()


def python_loci(files: DataFrame) -> DataFrame:
    """(repo, path, line, locus, children) of the lines asked for; ``files`` has repo, path, text and the array lines."""
    def rows(keys: tuple, text: str | None) -> list[tuple]:
        t = tree(text)
        wrong = ("parse_error:global", hashlib.sha256(b"error").hexdigest())
        return [(n, *(locus_of(t, n) if t else wrong)) for n in keys[2] or []]

    return _map(files, ["repo", "path", "lines"], "text", "line int, locus string, children string", [("line", pa.int32()), ("locus", pa.string()), ("children", pa.string())], rows).drop("lines")


def python_facts(files: DataFrame) -> DataFrame:
    """(repo, path, status, imports, classes, functions, constants, decorators, summary); status ok or error."""
    lists = ["imports", "classes", "functions", "constants", "decorators"]

    def rows(_: tuple, text: str | None) -> list[tuple]:
        t = tree(text)
        if t is None:
            return [("error", *[[]] * 5, "")]
        f = facts_of(t)
        return [("ok", *[f[x] for x in lists], f["summary"])]

    fields = [("status", pa.string()), *[(x, pa.list_(pa.string())) for x in lists], ("summary", pa.string())]
    return _map(files, ["repo", "path"], "text", "status string, " + ", ".join(f"{x} array<string>" for x in lists) + ", summary string", fields, rows)


# Quality of Python files: each score in [0, 1].

def _complexity(f: ast.AST) -> int:
    return 1 + sum(isinstance(n, (ast.If, ast.For, ast.AsyncFor, ast.While, ast.ExceptHandler, ast.IfExp, ast.comprehension, ast.Assert)) + (len(n.values) - 1 if isinstance(n, ast.BoolOp) else 0) for n in ast.walk(f))


def scores_of(module: ast.Module) -> dict[str, float]:
    """simplicity, cohesion, need, decoupling, encapsulation, convention, craft of a parsed file."""
    functions = [n for n in ast.walk(module) if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef))]
    classes = [n for n in ast.walk(module) if isinstance(n, ast.ClassDef)]
    worst = max(map(_complexity, functions), default=1)
    cohesion = []
    for c in classes:
        used = [{n.attr for n in ast.walk(m) if isinstance(n, ast.Attribute) and isinstance(n.value, ast.Name) and n.value.id == "self"} for m in c.body if isinstance(m, (ast.FunctionDef, ast.AsyncFunctionDef))]
        pairs = len(used) * (len(used) - 1) // 2
        cohesion.append(sum(bool(a & b) for i, a in enumerate(used) for b in used[:i]) / pairs if pairs else 1.0)
    empty = sum(all(isinstance(s, ast.Pass) or (isinstance(s, ast.Expr) and isinstance(s.value, ast.Constant)) for s in f.body) for f in functions)
    attributes = [n for n in ast.walk(module) if isinstance(n, ast.Attribute)]
    chains = sum(isinstance(n.value, ast.Attribute) for n in attributes)
    imports = sum(isinstance(n, (ast.Import, ast.ImportFrom)) for n in ast.walk(module))
    private = sum(n.attr.startswith("_") and not n.attr.startswith("__") and not (isinstance(n.value, ast.Name) and n.value.id in ("self", "cls")) for n in attributes)
    good = sum(f.name == f.name.lower() for f in functions) + sum(c.name[:1].isupper() and "_" not in c.name for c in classes)
    named = len(functions) + len(classes)
    documented = sum(ast.get_docstring(n) is not None for n in [*functions, *classes])
    annotated = sum(f.returns is not None for f in functions)
    return {
        "simplicity": 10 / (10 + worst - 1),
        "cohesion": sum(cohesion) / len(cohesion) if cohesion else 1.0,
        "need": max(0.0, 1 - 0.1 * empty),
        "decoupling": ((1 - chains / len(attributes) if attributes else 1.0) + 10 / (10 + imports)) / 2,
        "encapsulation": 1 - private / len(attributes) if attributes else 1.0,
        "convention": good / named if named else 1.0,
        "craft": (documented / named + (annotated / len(functions) if functions else 1.0)) / 2 if named else 1.0,
    }


PRINCIPLES = ("simplicity", "cohesion", "need", "decoupling", "encapsulation", "convention", "craft")


def python_scores(files: DataFrame) -> DataFrame:
    """(repo, path, lines, one column per principle) of Python files that parse."""
    def rows(_: tuple, text: str | None) -> list[tuple]:
        t = tree(text)
        if t is None:
            return []
        s = scores_of(t)
        return [(text.count("\n") + 1, *[round(s[p], 6) for p in PRINCIPLES])]

    return _map(files, ["repo", "path"], "text", "lines int, " + ", ".join(f"{p} double" for p in PRINCIPLES), [("lines", pa.int32()), *[(p, pa.float64()) for p in PRINCIPLES]], rows)


def python_complexity(files: DataFrame) -> DataFrame:
    """(repo, path, line, function, complexity) of every function of Python files that parse."""
    def rows(_: tuple, text: str | None) -> list[tuple]:
        t = tree(text)
        return sorted((n.lineno, n.name, _complexity(n)) for n in ast.walk(t) if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef))) if t else []

    return _map(files, ["repo", "path"], "text", "line int, function string, complexity int", [("line", pa.int32()), ("function", pa.string()), ("complexity", pa.int32())], rows)


def scorecard(scores: DataFrame) -> DataFrame:
    """(repo, principle, mean, worst, composite): composite is the mean of means, from 0 to 100."""
    long = scores.select("repo", F.explode(F.create_map(*[x for p in PRINCIPLES for x in (F.lit(p), F.col(p))])).alias("principle", "v"))
    per = long.groupBy("repo", "principle").agg(F.round(F.avg("v"), 6).alias("mean"), F.min("v").alias("worst"))
    whole = per.groupBy("repo").agg(F.round(100 * F.avg("mean"), 3).alias("composite"))
    return per.join(whole, "repo")


# Other languages, by built-in patterns.

def markdown_facts(text: Column) -> list[Column]:
    """headings (20 at most), links (30), languages of fences, title, first 300 characters."""
    heads = F.regexp_extract_all(text, F.lit(r"(?m)^#{1,6}[ \t]+(.+?)[ \t\r]*$"), F.lit(1))
    return [
        F.array_join(F.slice(heads, 1, 20), "|").alias("headings"),
        F.array_join(F.slice(F.regexp_extract_all(text, F.lit(r"\[[^\]\n]*\]\(([^)\s]+)\)"), F.lit(1)), 1, 30), "|").alias("links"),
        F.array_join(F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(r"(?m)^```([a-zA-Z0-9_+-]+)"), F.lit(1)))), "|").alias("fences"),
        F.coalesce(F.get(heads, F.lit(0)), F.lit("")).alias("title"),
        F.substring(text, 1, 300).alias("snippet"),
    ]


def shell_scripts(text: Column) -> Column:
    """Scripts a shell text calls, sorted."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(r"([A-Za-z0-9_./-]+\.(?:sh|py|js))\b"), F.lit(1))))


def sql_tables(text: Column) -> Column:
    """Tables after FROM, JOIN, INTO, UPDATE and TABLE, lower-case and sorted."""
    names = F.regexp_extract_all(text, F.lit(r"(?i)\b(?:FROM|JOIN|INTO|UPDATE|TABLE)\s+([A-Za-z_][A-Za-z0-9_.]*)"), F.lit(1))
    return F.array_sort(F.array_distinct(F.transform(names, F.lower)))


def gherkin(text: Column) -> list[Column]:
    """feature, scenarios (30 at most), steps (50)."""
    return [
        F.regexp_extract(text, r"(?m)^[ \t]*Feature:[ \t]*(.+)$", 1).alias("feature"),
        F.slice(F.regexp_extract_all(text, F.lit(r"(?m)^[ \t]*Scenario(?: Outline)?:[ \t]*(.+)$"), F.lit(1)), 1, 30).alias("scenarios"),
        F.slice(F.regexp_extract_all(text, F.lit(r"(?m)^[ \t]*(?:Given|When|Then|And|But)[ \t]+(.+)$"), F.lit(1)), 1, 50).alias("steps"),
    ]


CONFIG_TYPES = (("docker", "services:|from "), ("ci", "jobs:|pipeline|workflow"), ("package", '"dependencies"|\\[project\\]|lockfileversion'), ("lint", "eslint|ruff|flake8"), ("database", "postgres|mysql|redis|mongodb"))


def config_keys(text: Column) -> Column:
    """Keys at the start of lines of a configuration text, sorted."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(r'(?m)^\s{0,2}"?([A-Za-z_][A-Za-z0-9_.-]*)"?\s*[:=]'), F.lit(1))))


def paragraphs(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, line, heading, text): runs of lines between headings and blank lines, the line (from 1) they begin at, and the last heading above."""
    head, blank = re.compile(r"#{1,6}\s+(.+)$"), " \t"

    def rows(_: tuple, body: str | None) -> list[tuple]:
        out, heading, begin, held = [], "", 0, []
        for k, line in enumerate([*(body or "").replace("\r", "").split("\n"), ""], 1):
            m = head.match(line)
            if m or not line.strip(blank):
                if held:
                    out.append((begin, heading, "\n".join(held)))
                    held = []
                heading = m[1] if m else heading
            else:
                begin = begin if held else k
                held.append(line)
        return out

    return _map(docs, [key], text, "line bigint, heading string, text string", [("line", pa.int64()), ("heading", pa.string()), ("text", pa.string())], rows)


def dispatched(files: DataFrame) -> DataFrame:
    """(repo, path, kind, n) of every file (repo, path, text) through the parser its extension names: how many facts of that kind it has.

    Python gives definitions (-1 if it does not parse), Markdown headings, SQL tables, shell scripts, configurations keys, the
    rest lines.  Null texts count as empty.
    """
    t = F.coalesce(F.col("text"), F.lit(""))
    ext = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    kind = F.when(ext == "py", "definitions").when(ext == "md", "headings").when(ext == "sql", "tables").when(ext == "sh", "scripts").when(ext.isin("json", "toml", "xml"), "keys").otherwise("lines")
    by_text = (
        F.when(ext == "md", F.regexp_count(t, F.lit(r"(?m)^#{1,6}[ \t]+\S"))).when(ext == "sql", F.size(sql_tables(t))).when(ext == "sh", F.size(shell_scripts(t)))
        .when(ext.isin("json", "toml", "xml"), F.size(config_keys(t))).otherwise(F.size(F.split(t, "\n")))
    )

    def count(_: tuple, text: str | None) -> list[tuple]:
        m = tree(text or "")
        return [(-1 if m is None else sum(isinstance(n, _DEFS) for n in ast.walk(m)),)]

    others = files.where(ext != "py").select("repo", "path", kind.alias("kind"), by_text.cast("bigint").alias("n"))
    python = _map(files.where(ext == "py"), ["repo", "path"], "text", "n bigint", [("n", pa.int64())], count)
    return others.unionByName(python.select("repo", "path", F.lit("definitions").alias("kind"), "n"))


# Commits and diffs.

COMMIT_TYPES = (("feature", "feat|feature"), ("bug", "fix|bug|bugfix|hotfix"), ("test", "test|tests"), ("refactor", "refactor|perf"), ("chore", "chore|docs|style|build|ci|revert"))


def commit_type(subject: Column) -> Column:
    """Type by the conventional prefix, after a leading ticket; unknown without one."""
    bare = F.lower(F.regexp_replace(subject, r"^\s*\[?[A-Z][A-Z0-9]+-[0-9]+\]?[:\s-]*", ""))
    return F.coalesce(*[F.when(bare.rlike(rf"^(?:{p})(?:\([^)]*\))?!?:"), F.lit(t)) for t, p in COMMIT_TYPES], F.lit("unknown"))


def commit_scope(subject: Column) -> Column:
    return F.regexp_extract(F.lower(subject), r"^(?:[^:(]*)\(([^)]*)\)!?:", 1)


def commit_ticket(subject: Column) -> Column:
    return F.regexp_extract(subject, r"\b([A-Z][A-Z0-9]+-[0-9]+)\b", 1)


def diff_ranges(diffs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, path, start, count) of the new side of every hunk; deleted files and empty hunks give no rows, a missing count is 1."""
    lines = diffs.select(key, F.posexplode(F.split(text, "\n")).alias("pos", "line"))
    name = F.when(F.col("line").startswith("+++ "), F.regexp_extract("line", r"^\+\+\+ (?:b/)?([^\t\r]+)", 1))
    from pyspark.sql import Window

    w = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    named = lines.withColumn("path", F.last(name, ignorenulls=True).over(w)).where(F.col("line").startswith("@@"))
    count = F.regexp_extract("line", r"^@@ -\S+ \+\d+(?:,(\d+))? @@", 1)
    got = named.select(key, "path", F.regexp_extract("line", r"^@@ -\S+ \+(\d+)", 1).cast("int").alias("start"), F.when(count == "", 1).otherwise(count.cast("int")).alias("count"))
    return got.where((F.col("count") > 0) & (F.col("path") != "/dev/null") & F.col("start").isNotNull())
