"""Rule tables over names and texts, as expressions: predicates on paths, tags, purposes, link and section extraction."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
SENSITIVE_PATH = r"(^|/)(\.env|id_rsa|.*\.pem|.*\.key)$|(^|/)[^/]*(secret|credential|password|token)[^/]*\.(json|toml|yaml|yml|ini|env|cfg)$"
FORBIDDEN = (".git/", "node_modules/", "../")
EXCLUDED = ("node_modules", "vendor", "_vendor", "third_party", "dist", "build", "static")
ARTIFACTS = (("test", r"(^|/)tests?/"), ("doc", r"\.md$"), ("config", r"\.(json|toml|xml)$"), ("script", r"\.sh$"), ("query", r"\.sql$"), ("code", r"\.(py|js)$"))
PURPOSES = (("tests", "test"), ("tooling", "tools|scripts"), ("library", "lib"), ("application", "app"), ("third party", "vendor|extern|deps|third_party|node_modules"))


def sensitive_path(path: Column) -> Column:
    return F.lower(path).rlike(SENSITIVE_PATH)


def forbidden_path(path: Column) -> Column:
    low = F.lower(path)
    out = F.lit(False)
    for x in FORBIDDEN:
        out = out | F.contains(low, F.lit(x))
    return out


def excluded(path: Column) -> Column:
    return F.arrays_overlap(F.split(path, "/"), F.array(*map(F.lit, EXCLUDED)))


def binary_text(text: Column) -> Column:
    """A zero character among the first 512."""
    return F.instr(F.substring(text, 1, 512), "\0") > 0


def first_rule(c: Column, rules: Sequence[tuple[str, str]], default: str = "other") -> Column:
    return F.coalesce(*[F.when(c.rlike(p), F.lit(n)) for n, p in rules], F.lit(default))


def tags(path: Column, size: Column) -> Column:
    """All tags a file's name and size earn, sorted."""
    made = [F.when(path.rlike(p), F.lit(n)) for n, p in ARTIFACTS]
    return F.array_sort(F.array_compact(F.array(*made, F.when(size > 8192, F.lit("large")), F.when(size == 0, F.lit("empty")))))


def wikilinks(text: Column) -> Column:
    """Targets of [[links]] without alias, anchor and block, distinct and sorted."""
    raw = F.regexp_extract_all(text, F.lit(r"\[\[([^\]\n]+)\]\]"), F.lit(1))
    return F.array_sort(F.array_distinct(F.filter(F.transform(raw, lambda x: F.trim(F.regexp_replace(x, r"[|#^].*$", ""))), lambda x: x != "")))


def resolve_relative(current: Column, level: Column, module: Column) -> Column:
    """The dotted target of a relative import; null if it leaves the root."""
    parts = F.split(current, r"\.")
    keep = F.size(parts) - level
    base = F.array_join(F.slice(parts, F.lit(1), F.greatest(keep, F.lit(0))), ".")
    return F.when(keep < 0, F.lit(None)).otherwise(F.concat_ws(".", F.nullif(base, F.lit("")), F.nullif(module, F.lit(""))))


def stack_signature(trace: Column) -> Column:
    """file:function joined by arrows, hashed, of the frames of a traceback."""
    f = F.regexp_extract_all(trace, F.lit(r'File "(?:[^"]*/)?([^"/]+)", line'), F.lit(1))
    g = F.regexp_extract_all(trace, F.lit(r'File "[^"]+", line \d+, in (\S+)'), F.lit(1))
    return F.substring(F.sha1(F.array_join(F.zip_with(f, g, lambda a, b: F.concat_ws(":", a, b)), "->")), 1, 16)


def match_sanitised(query: Column) -> Column:
    """A full-text query without operators and signs, blanks collapsed."""
    return F.trim(F.regexp_replace(F.regexp_replace(query, r"[^A-Za-z0-9_ ]+|\b(AND|OR|NOT|NEAR)\b", " "), r" +", " "))


def goal_parts(text: Column) -> Column:
    """Parts of a goal: bullets, numbered items, sentences, and what "then" joins."""
    return F.filter(F.transform(F.split(text, r"\n\s*(?:[-*]|[0-9]+[.)])\s+|[.;]\s+|\bthen\b|\n"), lambda x: F.trim(x)), lambda x: x != "")


def usage(raw: Column, price_in: float, price_out: float) -> Column:
    """(total_tokens, cost) of a usage record as JSON: the four kinds of tokens added up, the reported cost or else list prices a million.

    Text that is no JSON gives nulls; missing numbers count as 0.
    """
    r = F.from_json(raw, "usage struct<input_tokens: bigint, output_tokens: bigint, cache_read_tokens: bigint, cache_write_tokens: bigint>, total_cost_usd double")
    n = lambda k: F.coalesce(r["usage"][k], F.lit(0))
    total = n("input_tokens") + n("output_tokens") + n("cache_read_tokens") + n("cache_write_tokens")
    cost = F.coalesce(r["total_cost_usd"], (price_in * n("input_tokens") + price_out * n("output_tokens")) / 1e6)
    return F.struct(F.when(r["usage"].isNotNull(), total).alias("total_tokens"), F.when(r["usage"].isNotNull(), F.round(cost, 6)).alias("cost"))


def aliases(text: Column, key: str = "aliases") -> Column:
    """Items of a list in the front matter, lower-case, distinct and sorted; none without one."""
    from lodestrata.sources.files import front_matter, list_value

    items = F.transform(list_value(F.coalesce(front_matter(text)[key], F.lit(""))), F.lower)
    return F.array_sort(F.array_distinct(items))


def labelled(body: Column, label: str, most: int) -> Column:
    """Items of the list after ``Label:`` up to the next label, without their dashes; at most ``most``."""
    block = F.regexp_extract(F.concat(F.lit("\n"), body), rf"\n{label}:[ \t]*([^\n]*(?:\n(?![A-Z][A-Za-z /]*:)[^\n]*)*)", 1)
    items = F.transform(F.split(block, "\n"), lambda x: F.trim(F.regexp_replace(F.trim(x), r"^-(?:\s+|$)", "")))
    return F.slice(F.filter(items, lambda x: x != ""), 1, most)


def normalised(raw: Column, schema: dict[str, str], defaults: dict[str, str], enums: dict[str, Sequence[str]]) -> Column:
    """A record of JSON by a schema, with ``changes``: defaults filled, unknown fields dropped, missing fields and values out of their lists told, sorted."""
    keys = F.json_object_keys(raw)
    r = F.from_json(raw, ", ".join(f"{k} {t}" for k, t in schema.items()))
    unknown = F.transform(F.array_except(F.coalesce(keys, F.array().cast("array<string>")), F.array(*map(F.lit, schema))), lambda k: F.concat(F.lit("unknown "), k))
    told = [F.when(r[k].isNull(), F.lit(f"default {k}" if k in defaults else f"missing {k}")) for k in schema]
    told += [F.when(~r[k].isin(*v), F.lit(f"enum {k}")) for k, v in enums.items()]
    changes = F.array_sort(F.concat(unknown, F.array_compact(F.array(*told))))
    return F.struct(*[(F.coalesce(r[k], F.lit(defaults[k])) if k in defaults else r[k]).alias(k) for k in schema], changes.alias("changes"))


def anchored(claim: Column, source: Column, start: Column, end: Column) -> Column:
    """Whether a claim stands in a span of its source, or the span in the claim, runs of blanks counting as one; false outside the source."""
    flat = lambda c: F.trim(F.regexp_replace(c, r"\s+", " "))
    ok = (start >= 0) & (end <= F.length(source)) & (start < end)
    span, said = flat(F.substr(source, start + 1, end - start)), flat(claim)
    return F.coalesce(ok & (said != "") & (F.contains(span, said) | ((span != "") & F.contains(said, span))), F.lit(False))
