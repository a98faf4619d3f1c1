"""Acceptors for JSON (RFC 8259), TOML 1.0 and well-formed XML 1.0."""

from __future__ import annotations

import re

from .base import Fault, Panic


def _line(text: str, at: int) -> int:
    return text.count("\n", 0, at) + 1


# JSON

_JSON = re.compile(r'[ \t\n\r]*("(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*+"|-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][-+]?[0-9]+)?(?![\w.+-])|true(?!\w)|false(?!\w)|null(?!\w)|[\[\]{},:]|\Z|.)', re.S)


class Json:
    """Values inside values are kept on an own stack, so that depth is bounded by the text alone."""

    def __init__(self, text: str) -> None:
        self.text, self.faults = text, []
        self.at = 0

    def next(self) -> str:
        m = _JSON.match(self.text, self.at)
        self.begin, self.at = m.start(1), m.end()
        t = m[1]
        if not t:
            return "end"
        c = t[0]
        if c in "[]{},:":
            return c
        return "string" if len(t) > 1 and c == '"' else "value" if len(t) > 1 or c.isdigit() and c.isascii() else "?"

    def wrong(self, wanted: str) -> None:
        """Record an error; recovery goes on at the next comma or bracket."""
        found = self.text[self.begin : self.begin + 1]
        self.faults.append(Fault(_line(self.text, self.begin), f"expected {wanted}, found {found or 'the end'!r}"))

    def check(self) -> list[Fault]:
        stack: list[str] = []
        want = "value"
        while True:
            t = self.next()
            if t == "end":
                if stack or want != "end":
                    self.wrong("a value" if want.startswith("value") else "a closing bracket")
                return self.faults
            if want == "end":
                self.wrong("the end")
                return self.faults
            if want in ("value", "value]"):
                if t == "{":
                    stack.append("}")
                    want = "key}"
                elif t == "[":
                    stack.append("]")
                    want = "value]"
                elif t in ("string", "value"):
                    want = "," if stack else "end"
                elif t == "]" and want == "value]":
                    stack.pop()
                    want = "," if stack else "end"
                else:
                    self.wrong("a value")
                    want = self.recover(t, stack)
            elif want in ("key", "key}"):
                if t == "string":
                    want = ":"
                elif t == "}" and want == "key}":
                    stack.pop()
                    want = "," if stack else "end"
                else:
                    self.wrong("a key in double quotes")
                    want = self.recover(t, stack)
            elif want == ":":
                if t == ":":
                    want = "value"
                else:
                    self.wrong("':'")
                    want = self.recover(t, stack)
            elif t == ",":
                want = "key" if stack[-1] == "}" else "value"
            elif t == stack[-1]:
                stack.pop()
                want = "," if stack else "end"
            else:
                self.wrong(f"',' or {stack[-1]!r}")
                want = self.recover(t, stack)

    def recover(self, t: str, stack: list[str]) -> str:
        while True:
            if t == "end":
                self.at = len(self.text)
                return ","
            if not stack:
                self.at = len(self.text)
                return "end"
            if t == ",":
                return "key}" if stack[-1] == "}" else "value]"
            if t == stack[-1]:
                stack.pop()
                return "," if stack else "end"
            t = self.next()


def check_json(text: str) -> list[Fault]:
    """All syntax errors of a JSON text.  A leading byte order mark is let pass, as the RFC allows."""
    return Json(text[1:] if text.startswith("﻿") else text).check()


# TOML

_BASIC = r'"(?:[^"\\\x00-\x08\x0a-\x1f\x7f]|\\(?:[btnfr"\\]|u[0-9a-fA-F]{4}|U[0-9a-fA-F]{8}))*+"'
_LITERAL = r"'[^'\x00-\x08\x0a-\x1f\x7f]*'"
_KEY = re.compile(rf"[A-Za-z0-9_-]+|{_BASIC}|{_LITERAL}")
_LONG_BASIC = re.compile(r'"""(?:[^"\\\x00-\x08\x0b\x0c\x0e-\x1f\x7f]|\\(?:[btnfr"\\]|u[0-9a-fA-F]{4}|U[0-9a-fA-F]{8}|[ \t]*\r?\n\s*)|""?(?!"))*+"{3,5}')
_LONG_LITERAL = re.compile(r"'''(?:[^'\x00-\x08\x0b\x0c\x0e-\x1f\x7f]|''?(?!'))*+'{3,5}")
_DATE = r"\d{4}-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12]\d|3[01])"
_TIME = r"(?:[01]\d|2[0-3]):[0-5]\d:[0-5]\d(?:\.\d+)?"
_SCALAR = re.compile(
    rf"{_BASIC}|{_LITERAL}|(?:{_DATE}(?:[Tt ]{_TIME}(?:[Zz]|[-+](?:[01]\d|2[0-3]):[0-5]\d)?)?|{_TIME}|true|false|[-+]?(?:inf|nan)|0x[0-9a-fA-F](?:_?[0-9a-fA-F])*|0o[0-7](?:_?[0-7])*|0b[01](?:_?[01])*"
    r"|[-+]?(?:0|[1-9](?:_?\d)*)(?:\.\d(?:_?\d)*)?(?:[eE][-+]?\d(?:_?\d)*)?)(?![\w.:+-])",
    re.ASCII,
)
_BLANK = re.compile(r"[ \t]*")
_GAP = re.compile(r"(?:[ \t\r\n]|#[^\n\x00-\x08\x0b\x0c\x0e-\x1f\x7f]*)*+")
_END = re.compile(r"[ \t]*(?:#[^\n\x00-\x08\x0b-\x0c\x0e-\x1f\x7f]*?)?(?:\r?\n|\Z)")
_MONTH = (31, 29, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31)


class Toml:
    """Recursive descent over lines; an error ends its line."""

    def __init__(self, text: str) -> None:
        self.text, self.at, self.faults = text, 0, []

    def fail(self, cause: str) -> None:
        raise Panic(self.at, cause)

    def blank(self) -> None:
        self.at = _BLANK.match(self.text, self.at).end()

    def key(self) -> list[str]:
        out = []
        while True:
            self.blank()
            m = _KEY.match(self.text, self.at)
            if not m:
                self.fail("expected a key")
            self.at = m.end()
            t = m[0]
            out.append(self._plain(t[1:-1]) if t[0] == '"' else t[1:-1] if t[0] == "'" else t)
            self.blank()
            if not self.text.startswith(".", self.at):
                return out
            self.at += 1

    def _plain(self, t: str) -> str:
        def one(m: re.Match) -> str:
            if m[1]:
                n = int(m[1][1:], 16)
                if n > 0x10FFFF or 0xD800 <= n < 0xE000:
                    self.fail("an escape that is no character")
                return chr(n)
            return m[0]

        return re.sub(r"\\(?:([uU][0-9a-fA-F]+)|.)", one, t) if "\\" in t else t

    def value(self, depth: int = 0):
        """Parses a value; a dict for an inline table, else None."""
        t = self.text
        for q, rx in (('"""', _LONG_BASIC), ("'''", _LONG_LITERAL)):
            if t.startswith(q, self.at):
                m = rx.match(t, self.at)
                if not m:
                    self.fail("a text over lines is not closed")
                if q == '"""':
                    self._plain(m[0])
                self.at = m.end()
                return None
        c = t[self.at : self.at + 1]
        if c == "[":
            self.at += 1
            while True:
                self.at = _GAP.match(t, self.at).end()
                if t.startswith("]", self.at):
                    break
                self.value(depth + 1)
                self.at = _GAP.match(t, self.at).end()
                if t.startswith(",", self.at):
                    self.at += 1
                elif not t.startswith("]", self.at):
                    self.fail("expected ',' or ']'")
            self.at += 1
            return None
        if c == "{":
            self.at += 1
            table: dict = {}
            self.blank()
            if t.startswith("}", self.at):
                self.at += 1
                return table
            while True:
                self.pair(table)
                self.blank()
                if t.startswith(",", self.at):
                    self.at += 1
                    continue
                if not t.startswith("}", self.at):
                    self.fail("expected ',' or '}'")
                self.at += 1
                return table
        m = _SCALAR.match(t, self.at)
        if not m:
            self.fail("expected a value")
        if m[0][0] == '"':
            self._plain(m[0])
        d = re.match(r"(\d{4})-(\d\d)-(\d\d)", m[0])
        if d:
            y, mo, day = map(int, d.groups())
            if y == 0 or day > _MONTH[mo - 1] or (mo == 2 and day == 29 and (y % 4 or (y % 100 == 0 and y % 400))):
                self.fail("no such date")
        self.at = m.end()
        return None

    def pair(self, table: dict) -> None:
        """key = value into a table: a value is stored as None or as a closed table."""
        path = self.key()
        if not self.text.startswith("=", self.at):
            self.fail("expected '=' after a key")
        self.at += 1
        self.blank()
        value = self.value()
        for part in path[:-1]:
            inner = table.setdefault(part, {"\0dotted": True})
            if not isinstance(inner, dict) or "\0closed" in inner or "\0list" in inner or ("\0dotted" not in inner):
                self.fail("a key already has a value")
            table = inner
        if path[-1] in table:
            self.fail("a key is defined twice")
        if isinstance(value, dict):
            value["\0closed"] = True
        table[path[-1]] = value

    def header(self, root: dict) -> dict:
        many = self.text.startswith("[[", self.at)
        self.at += 1 + many
        path = self.key()
        if not self.text.startswith("]]" if many else "]", self.at):
            self.fail("expected ']'")
        self.at += 1 + many
        table = root
        for part in path[:-1]:
            inner = table.setdefault(part, {})
            if isinstance(inner, dict) and "\0list" in inner:
                inner = inner["\0list"]
            if not isinstance(inner, dict) or "\0closed" in inner:
                self.fail("a table under a value")
            table = inner
        last = path[-1]
        if many:
            have = table.setdefault(last, {"\0list": {}})
            if not isinstance(have, dict) or "\0list" not in have:
                self.fail("a list of tables where something else is")
            have["\0list"] = {}
            return have["\0list"]
        have = table.setdefault(last, {})
        if not isinstance(have, dict) or have.keys() & {"\0closed", "\0list", "\0header", "\0dotted"}:
            self.fail("a table is defined twice")
        have["\0header"] = True
        return have

    def check(self) -> list[Fault]:
        root: dict = {}
        table = root
        n = len(self.text)
        while self.at < n:
            start = self.at
            try:
                m = _END.match(self.text, self.at)
                if m:
                    self.at = m.end()
                    continue
                self.blank()
                if self.text.startswith("[", self.at):
                    table = self.header(root)
                else:
                    self.pair(table)
                m = _END.match(self.text, self.at)
                if not m:
                    self.fail("expected the end of the line")
                self.at = m.end()
            except Panic as p:
                self.faults.append(Fault(_line(self.text, p.at), p.cause))
                end = self.text.find("\n", max(p.at, start))
                self.at = n if end < 0 else end + 1
        return self.faults


def check_toml(text: str) -> list[Fault]:
    """All syntax errors of a TOML text."""
    return Toml(text[1:] if text.startswith("﻿") else text).check()


# XML

_NAME = r"[:A-Z_a-z\xc0-\xd6\xd8-\xf6\xf8-˿Ͱ-ͽͿ-῿‌-‍⁰-↏Ⰰ-⿯、-퟿豈-﷏ﷰ-�\U00010000-\U000effff][-.0-9\xb7̀-ͯ‿-⁀:A-Z_a-z\xc0-\xd6\xd8-\xf6\xf8-˿Ͱ-ͽͿ-῿‌-‍⁰-↏Ⰰ-⿯、-퟿豈-﷏ﷰ-�\U00010000-\U000effff]*"
_ILLEGAL = re.compile("[^\t\n\r\x20-퟿-�\U00010000-\U0010ffff]")
_DECLARATION = re.compile(r"""<\?xml\s+version\s*=\s*(?:"1\.[0-9]+"|'1\.[0-9]+')(?:\s+encoding\s*=\s*(?:"[A-Za-z][\w.-]*"|'[A-Za-z][\w.-]*'))?(?:\s+standalone\s*=\s*(?:"(?:yes|no)"|'(?:yes|no)'))?\s*\?>""", re.ASCII)
_DOCTYPE = re.compile(rf"""<!DOCTYPE\s+{_NAME}(?:\s+(?:SYSTEM\s+|PUBLIC\s+(?:"[^"]*"|'[^']*')\s+)(?:"[^"]*"|'[^']*'))?\s*(?:\[(?:[^\]"'<]|"[^"]*"|'[^']*'|<!--(?:[^-]|-(?!-))*-->|<[!?](?:[^>"']|"[^"]*"|'[^']*')*>)*\]\s*)?>""")
_COMMENT = re.compile(r"<!--(?:[^-]++|-(?!-))*+-->")
_PI = re.compile(rf"<\?({_NAME})(?:\s(?:[^?]++|\?(?!>))*+)?\?>")
_OPEN = re.compile(rf"""<({_NAME})((?:\s+{_NAME}\s*=\s*(?:"[^"<]*"|'[^'<]*'))*+)\s*(/?)>""")
_ATTRIBUTE = re.compile(rf"""({_NAME})\s*=\s*("[^"]*"|'[^']*')""")
_CLOSE = re.compile(rf"</({_NAME})\s*>")
_ENTITY = re.compile(rf"&(?:({_NAME});|#([0-9]+);|#x([0-9a-fA-F]+);)?")
_ENTITIES = frozenset(("lt", "gt", "amp", "apos", "quot"))


class Xml:
    def __init__(self, text: str) -> None:
        self.text, self.faults = text, []
        self.declared: set[str] = set(_ENTITIES)

    def add(self, at: int, cause: str) -> None:
        self.faults.append(Fault(_line(self.text, at), cause))

    def characters(self, at: int, end: int) -> None:
        t = self.text
        if "&" in t[at:end]:
            for m in _ENTITY.finditer(t, at, end):
                number = int(m[2]) if m[2] else int(m[3], 16) if m[3] else None
                if m[1]:
                    if m[1] not in self.declared:
                        self.add(m.start(), "an undefined entity")
                elif number is None:
                    self.add(m.start(), "a bare '&'")
                elif number > 0x10FFFF or _ILLEGAL.match(chr(number)):
                    self.add(m.start(), "a reference to no character")

    def check(self) -> list[Fault]:
        t, n = self.text, len(self.text)
        for m in _ILLEGAL.finditer(t):
            self.add(m.start(), "an illegal character")
        at, open_tags, roots = 0, [], 0
        m = _DECLARATION.match(t)
        if m:
            at = m.end()
        doctype = False
        while at < n:
            lt = t.find("<", at)
            end = n if lt < 0 else lt
            if end > at:
                if open_tags:
                    self.characters(at, end)
                    bad = t.find("]]>", at, end)
                    if bad >= 0:
                        self.add(bad, "']]>' in text")
                elif t[at:end].strip(" \t\r\n"):
                    self.add(at + len(t[at:end]) - len(t[at:end].lstrip()), "text outside the root element")
            if lt < 0:
                break
            at = lt
            m = None
            if t.startswith("<!--", at):
                m = _COMMENT.match(t, at)
            elif t.startswith("<![CDATA[", at) and open_tags:
                close = t.find("]]>", at)
                if close >= 0:
                    at = close + 3
                    continue
            elif t.startswith("<!DOCTYPE", at) and not doctype and not roots:
                m = _DOCTYPE.match(t, at)
                doctype = True
                if m:
                    self.declared |= set(re.findall(rf"<!ENTITY\s+({_NAME})\s", m[0]))
            elif t.startswith("<?", at):
                m = _PI.match(t, at)
                if m and m[1].lower() == "xml":
                    self.add(at, "a misplaced XML declaration")
            elif t.startswith("</", at):
                m = _CLOSE.match(t, at)
                if m:
                    if m[1] in open_tags:
                        while open_tags[-1] != m[1]:
                            self.add(at, f"<{open_tags.pop()}> is not closed")
                        open_tags.pop()
                    else:
                        self.add(at, f"</{m[1]}> closes nothing")
            else:
                m = _OPEN.match(t, at)
                if m:
                    if not open_tags:
                        roots += 1
                        if roots > 1:
                            self.add(at, "a second root element")
                    names = _ATTRIBUTE.findall(m[2])
                    if len({a for a, _ in names}) < len(names):
                        self.add(at, "an attribute appears twice")
                    self.characters(m.start(2), m.end(2))
                    if not m[3]:
                        open_tags.append(m[1])
            if m:
                at = m.end()
            else:
                self.add(at, "malformed markup")
                close = t.find(">", at)
                at = n if close < 0 else close + 1
        for tag in open_tags:
            self.add(n, f"<{tag}> is never closed")
        if not roots:
            self.add(0, "no root element")
        return self.faults


def check_xml(text: str) -> list[Fault]:
    """All errors of well-formedness of an XML text."""
    return Xml(text[1:] if text.startswith("﻿") else text).check()
