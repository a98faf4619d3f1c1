"""Configuration formats parsed into key paths with the places of their values, whole files or fragments of them.

Every parser is one pass with a stack of the keys that are open.  Places are characters of the text as it is;
:func:`byte_places` turns them into bytes.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np


class Entry(NamedTuple):
    """A value: the mapping that holds it (where that opens), its key path, start and end, whether it is a number."""

    mapping: int
    path: tuple[str, ...]
    start: int
    end: int
    number: bool = False


LITERAL = r"(?:[rRbBuU]{0,2})(?:\"\"\"((?:[^\\]|\\.)*?)\"\"\"|'''((?:[^\\]|\\.)*?)'''|\"((?:[^\"\\\n]|\\.)*)\"|'((?:[^'\\\n]|\\.)*)'|`((?:[^`\\]|\\.)*)`)"
_LITERAL = re.compile(LITERAL, re.S)
_FLOW_TOKEN = re.compile(r"\"\"\"([\s\S]*?)\"\"\"|'''([\s\S]*?)'''|\"((?:[^\"\\\n]|\\.)*)\"|'([^'\n]*)'|([^\s\"'{}\[\],:=#][^\s{}\[\],:=#]*)|#[^\n]*|[{}\[\],:=\n]")
_SECTION = re.compile(r"[ \t]*\[\[?[ \t]*([^\[\]\n]+?)[ \t]*\]\]?[ \t]*(?:[#;].*)?\r?$")
_ASSIGNED = re.compile(r"[ \t]*(?:export[ \t]+)?((?:[\w-]+|\"[^\"\n]*\"|'[^'\n]*')(?:[ \t]*\.[ \t]*(?:[\w-]+|\"[^\"\n]*\"|'[^'\n]*'))*)[ \t]*[=:][ \t]*")
_PLAIN = re.compile(r"[ \t]*([^\s\"'`#(){}<>&*!|\[]\S*)[ \t]*(?:[#;].*)?\r?$")
_YAML = re.compile(r"([ ]*(?:-[ ]+)*)(\"[^\"\n]*\"|'[^'\n]*'|[^\s#:{}\[\],&*!|>'\"%@`-][^:#\n]*?)[ ]*:(?:[ \t]+(?:[!&][\w!.-]*[ \t]+)*|(?=\r?$))")
_ITEM = re.compile(r"([ ]*(?:-[ ]+)+)(?:[!&][\w!.-]*[ \t]+)*")
_SCALAR = re.compile(r"[|>][-+0-9]*[ \t]*(?:#.*)?\r?$")
_JSON_TOKEN = re.compile(r'"((?:[^"\\\n]|\\.)*)"|(-?\d[\d.eE+-]*)|[{}\[\]:,]')
_XML_TOKEN = re.compile(r"<!--[\s\S]*?-->|<!\[CDATA\[([\s\S]*?)\]\]>|</([A-Za-z_][\w.:-]*)\s*>|<([A-Za-z_][\w.:-]*)((?:\s+[\w.:-]+\s*=\s*(?:\"[^\"<]*\"|'[^'<]*'))*)\s*(/?)>|([^<]+)")
_ATTRIBUTE = re.compile(r"([\w.:-]+)\s*=\s*(?:\"([^\"<]*)\"|'([^'<]*)')")
_NUMBER = re.compile(r"[0-9]+$")
#: Attributes that name an element, as in <setting name="password">.
NAMING = ("name", "key", "id", "property")


def byte_places(text: str) -> np.ndarray | None:
    """Where each character begins in the UTF-8 text (with its end as the last); None if places are the same."""
    if text.isascii():
        return None
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    width = 1 + (code >= 0x80).astype(np.int64) + (code >= 0x800) + (code >= 0x10000)
    return np.concatenate(([0], np.cumsum(width)))


def body(m: re.Match) -> tuple[int, int]:
    """Place of what a literal holds between its quotes."""
    g = next(k for k in range(1, 6) if m.group(k) is not None)
    return m.span(g)


def _trimmed(text: str, start: int, end: int) -> tuple[int, int]:
    inner = text[start:end]
    return start + len(inner) - len(inner.lstrip()), end - len(inner) + len(inner.rstrip())


def flow(text: str, at: int, sign: str, base: tuple[str, ...], mapping: int) -> tuple[list[Entry], int]:
    """Values in brackets, of TOML and YAML alike, and where they end; keys stand before ``sign``."""
    out: list[Entry] = []
    stack: list[tuple[tuple[str, ...], int, bool]] = []
    path, here, waiting = base, mapping, False
    held: tuple[str, int, int, bool] | None = None
    last = at
    for m in _FLOW_TOKEN.finditer(text, at):
        c, last = m[0][0], m.end()
        if c == "\n" or c == "#":
            continue
        g = next((k for k in range(1, 6) if m[k] is not None), 0)
        if g:
            held = (m[g], *_trimmed(text, *m.span(g)), g == 5 and bool(_NUMBER.match(m[g])))
            continue
        if c in sign:
            if not stack or not stack[-1][2]:
                waiting, path = True, (*(stack[-1][0] if stack else base), *((held[0],) if held else ()))
                held = None
            continue
        if held:
            if waiting or stack and stack[-1][2]:
                out.append(Entry(here, path, *held[1:]))
            held = None
        waiting = False
        if c in "{[":
            stack.append((path, here, c == "["))
            here = here if c == "[" else m.start() + 1
        elif c in "}]" and stack:
            path, here, _ = stack.pop()
            if not stack:
                break
        else:
            path = stack[-1][0] if stack else base
    return out, last


def json_entries(text: str) -> Iterator[Entry]:
    """Every text and number of JSON."""
    # Open brackets: the path of what they hold, where the mapping opens, whether they are a list.
    stack: list[tuple[tuple[str, ...], int, bool]] = [((), 0, False)]
    key: str | None = None
    waiting = False
    for m in _JSON_TOKEN.finditer(text):
        c = m[0][0]
        path, here, listed = stack[-1]
        g = 1 if m[1] is not None else 2 if m[2] is not None else 0
        if g:
            if waiting or listed:
                yield Entry(here, (*path, key or "") if waiting else path, *m.span(g), g == 2)
                waiting = False
            elif g == 1:
                key = m[1]
        elif c == ":":
            waiting = True
        elif c in "{[":
            stack.append(((*path, key or "") if waiting else path, here if c == "[" else m.start() + 1, c == "["))
            waiting = False
        else:
            if c in "}]" and len(stack) > 1:
                stack.pop()
            waiting = False


def _keys(dotted: str) -> tuple[str, ...]:
    return tuple(k.strip().strip("\"'") for k in re.findall(r"\"[^\"\n]*\"|'[^'\n]*'|[^.\"'\s]+", dotted))


def section_entries(text: str, brackets: bool = True) -> Iterator[Entry]:
    """Values of TOML (with values in ``brackets``), INI, properties and env files under their sections."""
    section: tuple[str, ...] = ()
    mapping = at = 0
    while at < len(text):
        end = text.find("\n", at)
        end = len(text) if end < 0 else end
        if m := _SECTION.match(text, at, end):
            section, mapping = _keys(m[1]), at + 1
        elif m := _ASSIGNED.match(text, at, end):
            path = section + _keys(m[1])
            if v := _LITERAL.match(text, m.end()):
                yield Entry(mapping, path, *_trimmed(text, *body(v)))
                end = max(end, v.end())
            elif brackets and text[m.end() : m.end() + 1] in ("{", "["):
                found, z = flow(text, m.end(), "=", path, mapping)
                yield from found
                end = max(end, z)
            elif v := _PLAIN.match(text, m.end(), end):
                yield Entry(mapping, path, *v.span(1), bool(_NUMBER.match(v[1])))
        at = end + 1


def _yaml_value(text: str, at: int, end: int, indent: int, path: tuple[str, ...], mapping: int) -> tuple[list[Entry], int] | None:
    """Entries of the value at ``at`` and where it ends; None if the value is what is indented below."""
    if q := _LITERAL.match(text, at):
        return [Entry(mapping, path, *_trimmed(text, *body(q)))], max(end, q.end())
    if text[at : at + 1] in ("{", "["):
        found, z = flow(text, at, ":", path, mapping)
        return found, max(end, z)
    if _SCALAR.match(text, at, end):
        rows, z = [], end
        while z < len(text):
            to = text.find("\n", z + 1)
            to = len(text) if to < 0 else to
            row = text[z + 1 : to]
            if row.strip() and len(row) - len(row.lstrip()) <= indent:
                break
            if row.strip():
                rows.append((z + 1 + len(row) - len(row.lstrip()), z + 1 + len(row.rstrip())))
            z = to
        return ([Entry(mapping, path, rows[0][0], rows[-1][1])] if rows else []), end
    if b := _PLAIN.match(text, at, end):
        return [Entry(mapping, path, *b.span(1), bool(_NUMBER.match(b[1])))], end
    return ([], end) if text[at:end].strip() and text[at] != "#" else None


def yaml_entries(text: str) -> Iterator[Entry]:
    """Values of YAML under the keys that indent them: plain, quoted, block and flow values, and items of lists."""
    keys: list[tuple[int, str]] = []
    mappings: list[tuple[int, int]] = []  # by their indent
    at = 0
    while at < len(text):
        end = text.find("\n", at)
        end = len(text) if end < 0 else end
        if m := _YAML.match(text, at, end):
            indent = m.end(1) - at
            dashed = "-" in m[1]
            outer = len(m[1]) - len(m[1].lstrip(" "))
            while keys and keys[-1][0] >= (outer + 1 if dashed and keys[-1][0] < indent else indent):
                keys.pop()
            while mappings and (mappings[-1][0] > indent or dashed and mappings[-1][0] >= indent):
                mappings.pop()
            if not mappings or mappings[-1][0] < indent:
                mappings.append((indent, at + 1))
            key = m[2].strip().strip("\"'")
            value = _yaml_value(text, m.end(), end, outer, (*(k for _, k in keys), key), mappings[-1][1])
            if value is None:
                keys.append((indent, key))
            else:
                yield from value[0]
                end = value[1]
        elif m := _ITEM.match(text, at, end):
            indent = len(m[1]) - len(m[1].lstrip(" "))
            while keys and keys[-1][0] > indent:
                keys.pop()
            value = _yaml_value(text, m.end(), end, indent, tuple(k for _, k in keys), mappings[-1][1] if mappings else 0) if keys else None
            if value:
                yield from value[0]
                end = value[1]
        at = end + 1


def xml_entries(text: str) -> Iterator[Entry]:
    """Attribute values and element texts of XML; an element named by an attribute goes by that name."""
    stack: list[tuple[str, str]] = []
    for m in _XML_TOKEN.finditer(text):
        if m[3]:
            tag, at = m[3], m.start(4)
            places = {a[1].lower(): (a.start(g := 2 if a[2] is not None else 3) + at, a.end(g) + at) for a in _ATTRIBUTE.finditer(m[4])}
            named = next((text[slice(*places[n])] for n in NAMING if n in places), "")
            above = tuple(t for t, _ in stack)
            for a, place in places.items():
                if a not in NAMING:
                    yield Entry(m.start(), (*above, tag, *((named,) if named else ()), a), *place)
            if not m[5]:
                stack.append((tag, named))
        elif m[2]:
            if any(t == m[2] for t, _ in stack):
                while stack.pop()[0] != m[2]:
                    pass
        else:
            g = 1 if m[1] is not None else 6
            if m[g] and m[g].strip() and stack:
                path = tuple(x for t, n in stack for x in ((t, n) if n else (t,)))
                yield Entry(m.start(), path, *_trimmed(text, *m.span(g)))


def entries(text: str, extension: str) -> list[Entry]:
    """The values of a text in the format its extension names; of XML in any text that holds elements."""
    if extension == "json":
        return list(json_entries(text))
    if extension in ("toml", "ini", "cfg", "conf", "properties", "env"):
        return list(section_entries(text, extension == "toml"))
    if extension in ("yaml", "yml"):
        return list(yaml_entries(text))
    return list(xml_entries(text)) if "</" in text or "/>" in text else []
