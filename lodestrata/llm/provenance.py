"""Generated, minified, vendored and blob files, by belief propagation over directory trees.

Every file gives evidence for five labels; every directory has a hidden label that its children tend to share.  A tree
needs one pass of messages up and one down for exact marginals.  Both run level by level over a table of directories
(never over the files of a repository in one task); messages of the files of a directory are added up before they are
shuffled.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.runtime import stage

LABELS = ("handwritten", "generated", "minified", "vendored", "blob")
K = range(len(LABELS))

#: log P(child's label | directory's label), by rows of the directory's label.
_SHARE = (
    (0.88, 0.05, 0.02, 0.02, 0.03),
    (0.35, 0.60, 0.02, 0.02, 0.01),
    (0.25, 0.02, 0.70, 0.02, 0.01),
    (0.03, 0.01, 0.02, 0.93, 0.01),
    (0.40, 0.02, 0.02, 0.01, 0.55),
)
#: Evidence of a folder's name, and of the name of one above it, that it holds copies: more than its plain files can say
#: against it, since copies look like files written here and there may be any number of them.
_NAMED = 1e6
#: Log prior of the label of a repository's root.
_PRIOR = (0.0, -3.0, -3.5, -4.0, -4.0)

# Names and phrases by which tools and people mark such files.
_VENDOR_DIRS = ("vendor", "_vendor", "vendored", "third_party", "third-party", "thirdparty", "node_modules", "bower_components", "extern", "external", "externals", "deps", "site-packages")
_VERSIONED = r"^[a-z][a-z0-9_.-]*-[0-9]+(\.[0-9]+)+$"
_GENERATED_DIRS = ("generated", "gen", "autogen", "__generated__")
_BUILT_DIRS = ("dist", "build", "static", "min")
_MADE = re.compile(
    r"(?i)^(?:this (?:file|module|code) (?:is|was|has been) )?(?:code |automatically |auto-?)?(?:generated|erzeugt|generiert)(?: file\b| code\b| automatically)?(?: by| from| with| on| von| aus|\b.*do not|.*nicht von hand|\s*--|$)"
    r"|^@generated\b|^<auto-?generated|^machine output of|^auto-?generated\b|^automatisch (?:erzeugt|generiert)|^g[ée]n[ée]r[ée] (?:par|automatiquement)|^generado (?:por|autom)|^autogenerado|^erzeugt von|.*(?:generated|erzeugt|generiert).*(?:do not (?:edit|modify)|nicht von hand|nicht (?:bearbeiten|ändern))"
)
_KEPT = re.compile(r"(?i)not (?:auto-?)?generated|no longer generated|hand-?(?:kept|written|made|maintained)|(?:generator|generation) (?:was|is|has been) (?:retired|removed|dropped)|edit (?:it )?freely")
_COPIED = re.compile(r"(?i)^(?:bundled|vendored|local|verbatim) copy of|^(?:copied|vendored|imported|taken|adapted) from \S+ v?\d|this file is part of (?:the )?\S+ (?:distribution|project|library|package)|\(c\) .*contributors|^@license\b|^\S+ v?\d+\.\d+(?:\.\d+)* - .*(?:licen[cs]e|\(c\)|copyright)|upstream release|report bugs upstream")
_MADE_NAME = re.compile(r"(?i)_pb2?(?:_grpc)?\.(?:py|js)$|_grpc_pb2?\.(?:py|js)$|_pb2(?:_grpc)?\.py$|\.generated\.|\.g\.(?:py|js)$|\.gen\.(?:py|js)$|_generated\.(?:py|js)$")
_LOCK_KEY = re.compile(r'"(?:lockfileVersion|integrity|resolved|checksum|_integrity|_resolved)"\s*:|"version"\s*:\s*"\d+\.\d+')
_LITERAL = re.compile(r"\"\"\"[\s\S]*?\"\"\"|'''[\s\S]*?'''|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|`(?:[^`\\]|\\.)*`")
_COMMENT = re.compile(r"(?m)^\s*(?:#|//|/?\*|<!--).*$")
_WORD = re.compile(r"[A-Za-z_$][\w$]*")
_DATA = re.compile(r"\d[\w.]*")
_MARK = re.compile(r"^\s*(?:#+!?|//+|/\*+!?|\*+|<!--|--|;+|\"\"\"|''')\s*(.*?)\s*(?:\*/|-->)?\s*$")

#: Block comments and texts that can stand before the code: how they open and close; other lines that end no heading.
_BLOCK = re.compile(r"[rRuU]?(/\*|<!--|\"\"\"|''')")
_CLOSE = {"/*": "*/", "<!--": "-->", '"""': '"""', "'''": "'''"}
_HEADING = re.compile(r"(?:#|//|--|;;|;\s|<\?[^>]*\?>$|[rRuU]?(?:\"[^\"]*\"|'[^']*');?$|$)")

STATS = ("made", "kept", "copied", "late_made", "late_copied", "lock", "chars", "solid", "rows", "data", "words", "same", "code", "gaps")
#: Lines from the start of a file that count as its heading even if code stands among them.
NEAR = 12


def _after(rest: str) -> str | None:
    return "" if rest.strip() in ("", ";") else None


def marks(lines: list[str], state: str | None = "", near: int = NEAR) -> tuple[tuple[int, ...], list[str | None]]:
    """Marks in comments of a part of a file: (made, kept, copied) of its heading, (made, copied) of what follows.

    The heading are all comments before the first code, however long, and the first ``near`` lines.  ``state`` tells
    where the part begins: "" between comments of the heading, the closing sign within one, None past the first code.
    Also returned: the state after each line.
    """
    made = kept = copied = late_made = late_kept = late_copied = 0
    states: list[str | None] = []
    fresh = True  # a paragraph may begin
    for k, line in enumerate(lines):
        within, m = state, _MARK.match(line)
        text = line.strip()
        if state:
            if state in line:
                text, rest = (x.strip() for x in line.split(state, 1))
                state = _after(rest)
        elif state == "":
            o = _BLOCK.match(text)
            if o:
                body, sign, rest = text[o.end() :].partition(_CLOSE[o[1]])
                state = _after(rest) if sign else _CLOSE[o[1]]
                if not m:
                    within, text, fresh = _CLOSE[o[1]], body.strip(), True
            elif not _HEADING.match(text):
                state = None
        states.append(state)
        # Lines of a block without a sign of their own are prose; a mark there begins a paragraph.
        said = m[1] if m else text if within and fresh else None
        fresh = not text.strip("/*<!-\"' ")
        if not said:
            continue
        keeps = bool(_KEPT.search(said))
        makes = not keeps and bool(_MADE.match(said))
        copies = bool(_COPIED.search(said) if m else _COPIED.match(said))
        if k < near or within is not None and (within or state is not None or _BLOCK.match(line.strip())):
            made, kept, copied = made + makes, kept + keeps, copied + copies
        else:
            late_made, late_kept, late_copied = late_made + makes, late_kept + keeps, late_copied + copies
    return (made, kept, copied, 0 if late_kept else late_made, late_copied), states


def statistics(text: str, found: tuple[int, ...]) -> tuple[int, ...]:
    """Counts that add up over the parts of a file: its marks as ``found``, sizes, data in literals, alike lines."""
    lines = text.splitlines()
    solid = [x for line in lines if (x := line.strip())]
    bare = _COMMENT.sub("", text)
    code = _LITERAL.sub("", bare)
    words = len(_WORD.findall(code))
    # Data are numbers and texts without blanks; prose in a literal is none.
    data = sum(len(x) for x in _LITERAL.findall(bare) if len(x.split(None, 2)) < 2) + sum(map(len, _DATA.findall(code)))
    same = len(solid) - len({_DATA.sub("0", _WORD.sub("a", _LITERAL.sub("s", x))) for x in solid})
    tight = "".join(code.split())
    return *found, len(_LOCK_KEY.findall(text)), len(text), len("".join(text.split())), len(solid), data, words, same, len(tight), len(code) - len(tight)


def _evidence(path: Column) -> list[Column]:
    """Log likelihood of the file under each label, from its statistics and its name."""
    c = F.col
    js_py = path.rlike(r"(?i)\.(py|pyi|js|mjs|cjs|jsx|ts)$")
    js = path.rlike(r"(?i)\.(js|mjs|cjs)$")
    zero = F.lit(0.0)
    when = lambda cond, v: F.when(cond, F.lit(v)).otherwise(zero)
    is_kept = c("kept") > 0
    is_blob = js_py & (c("chars") >= 400) & (c("data") >= 0.6 * c("solid")) & (c("words") <= 12)
    alike = js_py & ~is_blob & (c("rows") >= 30) & (c("rows") - c("same") <= 8 + 0.01 * c("rows"))
    is_min = js & ~is_blob & (c("code") >= 100) & (c("gaps") <= 0.15 * c("code")) & (c("code") >= 80 * c("rows")) & (c("words") >= 20)
    is_lock = path.rlike(r"(?i)\.json$") & (c("lock") >= 3)
    hand = when(is_kept, 5.0) + when(js_py & ~is_blob & ~is_min & ~alike, 1.0) + when(~js_py & ~is_lock, 5.0)
    generated = when((c("made") > 0) & ~is_kept, 8.0) + when((c("made") == 0) & (c("late_made") > 0) & ~is_kept, 3.0) + when(path.rlike(_MADE_NAME.pattern), 3.0) + when(alike, 6.0) + when(is_lock, 9.0)
    minified = when(is_min, 7.0) + when(path.rlike(r"(?i)[.-]min\.(js|css)$"), 3.0)
    vendored = when(c("copied") > 0, 8.0) + when((c("copied") == 0) & (c("late_copied") > 0), 3.0)
    blob = when(is_blob, 8.0)
    return [hand, generated, minified, vendored, blob]


def _lse(terms: list[Column]) -> Column:
    """Logarithm of the sum of exponentials, over an array so that the code made for it stays small."""
    return F.transform(F.array(F.array(*terms)), lambda a: F.array_max(a) + F.log(F.aggregate(a, F.lit(0.0), lambda t, x: t + F.exp(x - F.array_max(a)))))[0]


def _logs() -> list[list[float]]:
    return [[math.log(x) for x in row] for row in _SHARE]


def _up(prefix: str) -> list[Column]:
    """Message of a child to its directory, from its own belief."""
    t = _logs()
    return [_lse([F.col(f"{prefix}{j}") + F.lit(t[p][j]) for j in K]) for p in K]


def _down(prefix: str, minus: str) -> list[Column]:
    """Message of a directory to a child: all it knows but what that child told it."""
    t = _logs()
    return [_lse([F.col(f"{prefix}{p}") - F.col(f"{minus}{p}") + F.lit(t[p][j]) for p in K]) for j in K]


def _overlap(before: list[str], lines: list[str]) -> int:
    """How many of the last lines of a part begin the next one again."""
    return next((k for k in range(min(len(before), len(lines)), 0, -1) if before[-k:] == lines[:k]), 0)


def _stats_of(table: DataFrame) -> DataFrame:
    """Statistics of each row of (repo, path, chunk_index, text); the parts of a file come together and in order.

    A row that follows its equal is left out.  A chunk_index of null or 0 begins a file; the heading of a file may run on into its later parts.
    """
    names = ["repo", "path", "at", "h", *STATS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple = (None, None, None)
        same: tuple | None = None
        before, states, start, line_no = [], [], None, 0
        for batch in batches:
            got, keep = [], []
            for k, (repo, path, index, t) in enumerate(zip(*(batch.column(k).to_pylist() for k in range(3)), batch.column(3), strict=True)):
                text = t.as_py()
                if same == (same := (repo, path, index, text)):
                    continue
                keep.append(k)
                lines = text.splitlines()
                if not index:
                    state, line_no = "", 0
                elif last == (repo, path, index - 1):
                    shared = _overlap(before, lines)
                    at = len(before) - shared
                    state, line_no = states[at - 1] if at else start, line_no + at
                else:
                    state, line_no = None, NEAR
                found, now = marks(lines, state, NEAR - line_no)
                last, before, states, start = (repo, path, index or 0), lines, now, state
                got.append(statistics(text, found))
            cols = list(zip(*got, strict=True)) if got else [[]] * len(STATS)
            rows = batch.take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), rows.column(4), rows.column(5), *[pa.array(x, pa.int64()) for x in cols]], names)

    text = F.coalesce("text", F.lit(""))
    rows = table.select("repo", "path", "chunk_index", text.alias("text"), "at", F.xxhash64(text).alias("h")).where(F.col("repo").isNotNull() & F.col("path").isNotNull())
    return rows.mapInArrow(run, "repo string, path string, at bigint, h bigint, " + ", ".join(f"{s} bigint" for s in STATS))


def labelled(files: DataFrame, chunks: DataFrame) -> DataFrame:
    """Every file of either table with its most likely label.

    Columns: repo, path, label, probability, and of each label its log belief b0..b4 (order of ``LABELS``).  A file only
    known by its chunks is judged by them.  Null texts count as empty, rows with null repo or path are left out, a
    repeated row counts once.
    """
    at = F.coalesce(F.unix_micros("scanned_at"), F.lit(-(1 << 62))) if "scanned_at" in files.columns else F.lit(0).cast("bigint")
    # A file that stands there in several states is judged by the one scanned last.
    whole = _stats_of(files.select("repo", "path", F.lit(None).cast("int").alias("chunk_index"), "text", at.alias("at")))
    whole = whole.groupBy("repo", "path").agg(F.max_by(F.struct(*STATS), F.struct("at", "h")).alias("s")).select("repo", "path", *[f"s.{x}" for x in STATS])
    # Which files are known by chunks only is told by keys alone; only their chunks are brought together.
    known = files.select("repo", "path").distinct()
    only = stage(chunks.select("repo", "path").distinct().join(known, ["repo", "path"], "left_anti"), "only")
    parts = chunks.select("repo", "path", "text", "chunk_index", F.lit(0).cast("bigint").alias("at")).join(only, ["repo", "path"], "left_semi")
    parts = _stats_of(parts.repartition("repo", "path").sortWithinPartitions("repo", "path", "chunk_index", "text"))
    parts = parts.groupBy("repo", "path").agg(*[F.sum(s).alias(s) for s in STATS])
    judged = whole.unionByName(parts)
    evidence = _evidence(F.col("path"))
    folder = F.when(F.instr("path", "/") > 0, F.regexp_extract("path", r"^(.*)/[^/]*$", 1)).otherwise(F.lit(""))
    f = judged.select("repo", "path", folder.alias("dir"), *[e.alias(f"e{k}") for k, e in zip(K, evidence, strict=True)])
    f = stage(f.select("*", *[m.alias(f"m{k}") for k, m in zip(K, _up("e"), strict=True)]), "evidence")

    told = f.groupBy("repo", "dir").agg(*[F.sum(f"m{k}").alias(f"m{k}") for k in K])
    steps = F.split("dir", "/")
    every = told.select("repo", F.explode(F.when(F.col("dir") == "", F.array(F.lit(""))).otherwise(F.concat(F.array(F.lit("")), F.transform(F.sequence(F.lit(1), F.size(steps)), lambda n: F.concat_ws("/", F.slice(steps, 1, n)))))).alias("dir")).distinct()
    name = F.lower(F.regexp_extract("dir", r"([^/]*)$", 1))
    within = F.col("dir").rlike(r"(?i)(^|/)(" + "|".join(map(re.escape, _VENDOR_DIRS)) + r")(/|$)")
    vendor = F.when(within, _NAMED).otherwise(0.0) + F.when(name.rlike(_VERSIONED), 2.0).otherwise(0.0)
    hint = [F.lit(0.0), F.when(name.isin(*_GENERATED_DIRS), 1.5).otherwise(0.0), F.when(name.isin(*_BUILT_DIRS), 1.0).otherwise(0.0), vendor, F.lit(0.0)]
    depth = F.when(F.col("dir") == "", 0).otherwise(F.size(steps))
    zero = F.lit(0.0)
    above = F.when(F.instr("dir", "/") > 0, F.regexp_extract("dir", r"^(.*)/[^/]*$", 1)).otherwise(F.lit(""))
    dirs = every.join(told, ["repo", "dir"], "left").select(
        "repo", "dir", above.alias("above"), depth.alias("depth"), *[(F.coalesce(f"m{k}", zero) + hint[k] + F.when(F.col("dir") == "", _PRIOR[k]).otherwise(0.0)).alias(f"b{k}") for k in K]
    )
    dirs = stage(dirs, "folders")
    deepest = dirs.agg(F.max("depth")).first()[0] or 0

    # Up: a level knows all below it before it speaks to the one above.
    levels: dict[int, DataFrame] = {}
    below: DataFrame | None = None
    for d in range(deepest, -1, -1):
        level = dirs.where(F.col("depth") == d).drop("depth")
        if below is not None:
            level = level.join(below, ["repo", "dir"], "left").select("repo", "dir", "above", *[(F.col(f"b{k}") + F.coalesce(f"u{k}", zero)).alias(f"b{k}") for k in K])
        level = level.select("*", *[m.alias(f"t{k}") for k, m in zip(K, _up("b"), strict=True)])
        levels[d] = level = stage(level, f"up{d}")
        below = level.groupBy("repo", F.col("above").alias("dir")).agg(*[F.sum(f"t{k}").alias(f"u{k}") for k in K])
    # Down: a directory hears from the one above what it did not say itself.
    done = [levels[0].select("repo", "dir", *[F.col(f"b{k}").alias(f"w{k}") for k in K])]
    for d in range(1, deepest + 1):
        upper = done[-1].withColumnRenamed("dir", "above")
        heard = levels[d].join(upper, ["repo", "above"]).select("repo", "dir", *[f"b{k}" for k in K], *[m.alias(f"d{k}") for k, m in zip(K, _down("w", "t"), strict=True)])
        done.append(stage(heard.select("repo", "dir", *[(F.col(f"b{k}") + F.col(f"d{k}")).alias(f"w{k}") for k in K]), f"down{d}"))
    beliefs = done[0]
    for x in done[1:]:
        beliefs = beliefs.unionByName(x)
    out = f.join(beliefs, ["repo", "dir"]).select("repo", "path", *[(F.col(f"e{k}") + m).alias(f"b{k}") for k, m in zip(K, _down("w", "m"), strict=True)])
    best = F.greatest(*[F.col(f"b{k}") for k in K])
    label = F.element_at(F.array(*map(F.lit, LABELS)), F.array_position(F.array(*[F.col(f"b{k}") for k in K]), best).cast("int"))
    return out.select("repo", "path", label.alias("label"), F.exp(best - _lse([F.col(f"b{k}") for k in K])).alias("probability"), *[f"b{k}" for k in K])


def not_handwritten(files: DataFrame, chunks: DataFrame) -> DataFrame:
    """(repo, path) of code that nobody here wrote, and of lists of resolved dependencies."""
    code = F.col("path").rlike(r"(?i)\.(py|js)$")
    lock = F.col("path").rlike(r"(?i)\.json$") & (F.col("label") == "generated")
    return labelled(files, chunks).where((code & (F.col("label") != "handwritten")) | lock).select("repo", "path")
