"""Acceptor for Python 3.13 source.

A file is cut into logical lines.  What a line means to the grammar depends on the kinds of its tokens alone, so each
distinct sequence of kinds is parsed once (recursive descent for statements, precedence climbing for expressions) and
remembered.  Blocks are then checked over the lines.  An error ends its logical line only; parsing goes on at the next.
"""

from __future__ import annotations

import re
import unicodedata

from .base import Fault, Memo, Panic

# Fixed values of the language: keywords, soft keywords, operators, binding strengths.
KEYWORDS = "False None True and as assert async await break class continue def del elif else except finally for from global if import in is lambda nonlocal not or pass raise return try while with yield".split()
SOFT = "match case type _".split()
OPERATORS = "**= //= >>= <<= ... := -> == != <= >= += -= *= /= %= &= |= ^= @= ** // << >> + - * / % @ & | ^ ~ < > ( ) [ ] { } , : . ; =".split()
AUGMENTED = frozenset("+= -= *= /= //= %= @= &= |= ^= >>= <<= **=".split())
BINARY = {"or": 1, "and": 2, "<": 4, ">": 4, "==": 4, ">=": 4, "<=": 4, "!=": 4, "in": 4, "is": 4, "not": 4, "|": 5, "^": 6, "&": 7, "<<": 8, ">>": 8, "+": 9, "-": 9, "*": 10, "/": 10, "//": 10, "%": 10, "@": 10, "**": 12}

_NUMBER = r"(?:0[xX](?:_?[0-9a-fA-F])+|0[bB](?:_?[01])+|0[oO](?:_?[0-7])+|(?:[0-9](?:_?[0-9])*\.?(?:[0-9](?:_?[0-9])*)?|\.[0-9](?:_?[0-9])*)(?:[eE][-+]?[0-9](?:_?[0-9])*)?[jJ]?)"
_PREFIX = r"(?:[rR][bBfF]?|[bB][rR]?|[fF][rR]?|[uU])?"
_LONG = "|".join(rf"{q * 3}(?:[^\\{q}]++|\\.|{q}(?!{q * 2}))*+{q * 3}" for q in "\"'")
_SHORT = "|".join(rf"{q}(?!{q * 2})(?:[^\\{q}\n]++|\\.)*+{q}" for q in "\"'")
TOKEN = re.compile(
    rf"[ \t\f]*(?:\\\n[ \t\f]*)*(\n[ \t\f]*|{_PREFIX}(?:{_LONG}|{_SHORT})"
    rf"|[^\W\d]\w*|{_NUMBER}(?=(?:and|else|for|if|in|is|not|or)\b|(?!\w))|[0-9]\w*|#[^\n]*|{'|'.join(map(re.escape, OPERATORS))}|.|\Z)",
    re.S,
)
_STRING = re.compile(rf"({_PREFIX})(\"\"\"|'''|\"|')(.*)\2", re.S)
_ESCAPE = re.compile(r"\\(?:x([0-9a-fA-F]{0,2})|u([0-9a-fA-F]{0,4})|U([0-9a-fA-F]{0,8})|N(\{[^}]*\})?|.)", re.S)

END = "$"


class Line:
    """One logical line: kinds of tokens, and a place in them."""

    def __init__(self, kinds: tuple[str, ...]) -> None:
        self.k = (*kinds, END, END)
        self.i = 0

    def fail(self, cause: str) -> None:
        raise Panic(self.i, cause)

    def take(self, kind: str) -> None:
        if self.k[self.i] != kind:
            self.fail(f"expected {kind!r}, found {self.k[self.i]!r}")
        self.i += 1

    def at(self, kind: str) -> bool:
        if self.k[self.i] == kind:
            self.i += 1
            return True
        return False

    def name(self) -> None:
        k = self.k[self.i]
        if k != "N" and k not in SOFT:
            self.fail(f"expected a name, found {k!r}")
        self.i += 1

    # Expressions give what may be done with them: a set of letters out of
    # a(ssign) s(ingle target) d(elete) *(starred) n(bare name) t(bare tuple) g(bare generator) y(ield).

    def atom(self) -> str:
        k = self.k[self.i]
        if k == "N" or k in SOFT:
            self.i += 1
            return "asdn"
        if k in ("S", "B"):
            while self.k[self.i] in ("S", "B"):
                if self.k[self.i] != k:
                    self.fail("bytes and text are joined")
                self.i += 1
            return ""
        if k in ("0", "None", "True", "False", "..."):
            self.i += 1
            return ""
        if k == "(":
            self.i += 1
            if self.at(")"):
                return "ad"
            if self.k[self.i] == "yield":
                self.yields()
                self.take(")")
                return ""
            got = self.named(star=True)
            if self.k[self.i] in ("for", "async"):
                if "*" in got:
                    self.fail("a starred generator element")
                self.comprehension()
                self.take(")")
                return ""
            if self.k[self.i] != ",":
                self.take(")")
                if "*" in got:
                    self.fail("starred expression in brackets")
                return "".join(c for c in got if c in "asd")
            ok = [got]
            while self.at(","):
                if self.k[self.i] == ")":
                    break
                ok.append(self.named(star=True))
            self.take(")")
            return self._many(ok)
        if k == "[":
            self.i += 1
            if self.at("]"):
                return "ad"
            got = self.named(star=True)
            if self.k[self.i] in ("for", "async"):
                if "*" in got:
                    self.fail("iterable unpacking in a comprehension")
                self.comprehension()
                self.take("]")
                return ""
            ok = [got]
            while self.at(","):
                if self.k[self.i] == "]":
                    break
                ok.append(self.named(star=True))
            self.take("]")
            return self._many(ok)
        if k == "{":
            self.i += 1
            self.braces()
            return ""
        self.fail(f"expected an expression, found {k!r}")
        return ""

    @staticmethod
    def _many(parts: list[str]) -> str:
        stars = sum("*" in p for p in parts)
        return ("a" if all("a" in p for p in parts) and stars < 2 else "") + ("d" if all("d" in p and "*" not in p for p in parts) else "")

    def braces(self) -> None:
        if self.at("}"):
            return
        if self.k[self.i] == "**":
            kind = "dict"
            self.i += 1
            self.binary(5)
        else:
            got = self.named(star=True)
            kind = "set"
            if self.k[self.i] == ":" and "*" not in got:
                self.i += 1
                self.expression()
                kind = "dict"
            if self.k[self.i] in ("for", "async"):
                if "*" in got:
                    self.fail("iterable unpacking in a comprehension")
                self.comprehension()
                self.take("}")
                return
        while self.at(","):
            if self.k[self.i] == "}":
                break
            if kind == "set":
                self.named(star=True)
            elif self.at("**"):
                self.binary(5)
            else:
                self.expression()
                self.take(":")
                self.expression()
        self.take("}")

    def comprehension(self) -> None:
        while self.k[self.i] == "for" or (self.k[self.i] == "async" and self.k[self.i + 1] == "for"):
            self.at("async")
            self.take("for")
            self.targets()
            self.take("in")
            self.binary(1)
            while self.at("if"):
                self.binary(1)
        if self.k[self.i] == "async":
            self.fail("expected 'for'")

    def targets(self) -> None:
        """Targets of a for: parsed above comparisons, so that 'in' stays."""
        parts, comma = [], False
        while True:
            starred = self.at("*")
            got = self.binary(5)
            if "a" not in got:
                self.fail("cannot assign here")
            parts.append("a*" if starred else got)
            if not self.at(","):
                break
            comma = True
            if self.k[self.i] == "in":
                break
        if sum("*" in p for p in parts) > comma:
            self.fail("a starred target outside a tuple")

    def primary(self) -> str:
        if self.at("await"):
            self.primary()
            return ""
        got = self.atom()
        while True:
            k = self.k[self.i]
            if k == ".":
                self.i += 1
                self.name()
                got = "asd"
            elif k == "(":
                self.i += 1
                self.arguments()
                got = ""
            elif k == "[":
                self.i += 1
                self.subscript()
                got = "asd"
            else:
                return got

    def subscript(self) -> None:
        while True:
            if self.at("*"):
                self.binary(5)
            else:
                if self.k[self.i] != ":":
                    self.named()
                if self.at(":"):
                    if self.k[self.i] not in (":", ",", "]"):
                        self.expression()
                    if self.at(":") and self.k[self.i] not in (",", "]"):
                        self.expression()
            if not self.at(",") or self.k[self.i] == "]":
                break
        self.take("]")

    def arguments(self) -> None:
        keyword = doubled = False
        n = 0
        while self.k[self.i] != ")":
            bare = False
            if self.at("*"):
                if doubled:
                    self.fail("iterable argument unpacking follows keyword argument unpacking")
                self.expression()
            elif self.at("**"):
                self.expression()
                keyword = doubled = True
            elif self.k[self.i + 1] == "=" and (self.k[self.i] == "N" or self.k[self.i] in SOFT):
                self.i += 2
                self.expression()
                keyword = True
            else:
                self.named()
                if self.k[self.i] in ("for", "async"):
                    self.comprehension()
                    bare = True
                elif keyword:
                    self.fail("positional argument follows keyword argument")
            n += 1
            if bare and (n > 1 or (self.k[self.i] == "," and self.k[self.i + 1] != ")")):
                self.fail("generator expression must be in brackets")
            if not self.at(","):
                break
        self.take(")")

    def unary(self) -> str:
        k = self.k[self.i]
        if k in ("+", "-", "~"):
            self.i += 1
            self.unary()
            return ""
        got = self.primary()
        if self.at("**"):
            self.unary()
            return ""
        return got

    def binary(self, least: int) -> str:
        """Precedence climbing over the operators at least as strong as ``least``."""
        if self.k[self.i] == "not":
            if least > 3:
                self.fail("'not' needs brackets here")
            self.i += 1
            self.binary(3)
            got = ""
        else:
            got = self.unary()
        while True:
            k = self.k[self.i]
            power = BINARY.get(k, 0)
            if power < least or not power or k == "**":
                return got
            if k == "not":
                if self.k[self.i + 1] != "in":
                    return got
                self.i += 1
            self.i += 1
            if k == "is":
                self.at("not")
            self.binary(power + 1)
            got = ""

    def expression(self) -> str:
        if self.k[self.i] == "lambda":
            self.i += 1
            self.parameters(":", False)
            self.take(":")
            self.expression()
            return ""
        got = self.binary(1)
        if self.at("if"):
            self.binary(1)
            self.take("else")
            self.expression()
            return ""
        return got

    def named(self, star: bool = False) -> str:
        if star and self.at("*"):
            got = self.binary(5)
            return "*" + ("a" if "a" in got and "*" not in got else "")
        if self.k[self.i + 1] == ":=" and (self.k[self.i] == "N" or self.k[self.i] in SOFT):
            self.i += 2
            self.expression()
            return ""
        return self.expression()

    def yields(self) -> None:
        self.take("yield")
        if self.at("from"):
            self.expression()
        elif self.k[self.i] not in (")", END, ";", "=", "]", "}"):
            self.expressions()

    def expressions(self, named: bool = False) -> str:
        """star_expressions: a bare tuple if there is a comma."""
        one = lambda: self.named(star=True) if named or self.k[self.i] == "*" else self.expression()
        got = one()
        if self.k[self.i] != ",":
            return got
        parts = [got]
        while self.at(","):
            if self.k[self.i] in (END, "=", ")", "]", "}", ":", ";", "in") or self.k[self.i] in AUGMENTED:
                break
            parts.append(one())
        return self._many(parts) + "t"

    def parameters(self, close: str, annotated: bool) -> None:
        star = double = default = False
        names = slash = 0
        while self.k[self.i] != close:
            if double:
                self.fail("a parameter follows the keyword dictionary")
            if self.at("/"):
                if slash or star or not names:
                    self.fail("a misplaced '/' in parameters")
                slash = 1
            elif self.at("**"):
                self.name()
                if annotated and self.at(":"):
                    self.expression()
                double = True
                if self.k[self.i] == "=":
                    self.fail("the keyword dictionary cannot have a default")
            elif self.at("*"):
                if star:
                    self.fail("'*' may appear only once")
                star = True
                if self.k[self.i] == ",":
                    if self.k[self.i + 1] in (close, "**", "*"):
                        self.fail("named parameters must follow a bare *")
                elif self.k[self.i] == close:
                    self.fail("named parameters must follow a bare *")
                else:
                    self.name()
                    if annotated and self.at(":"):
                        if self.at("*"):
                            self.binary(5)
                        else:
                            self.expression()
                    if self.k[self.i] == "=":
                        self.fail("the argument list cannot have a default")
            else:
                self.name()
                names += 1
                if annotated and self.at(":"):
                    self.expression()
                if self.at("="):
                    self.expression()
                    default = True
                elif default and not star:
                    self.fail("a parameter without a default follows one with a default")
            if not self.at(","):
                break

    def type_parameters(self) -> None:
        if not self.at("["):
            return
        default = False
        while True:
            stars = self.at("*") or self.at("**")
            self.name()
            if not stars and self.at(":"):
                self.expression()
            if self.at("="):
                if stars and self.at("*"):
                    self.binary(5)
                else:
                    self.expression()
                default = True
            elif default:
                self.fail("a type parameter without a default follows one with a default")
            if not self.at(",") or self.k[self.i] == "]":
                break
        self.take("]")

    # Statements.

    def simple(self) -> None:
        k = self.k[self.i]
        if k in ("pass", "break", "continue"):
            self.i += 1
        elif k == "return":
            self.i += 1
            if self.k[self.i] not in (END, ";"):
                self.expressions()
        elif k == "raise":
            self.i += 1
            if self.k[self.i] not in (END, ";"):
                self.expression()
                if self.at("from"):
                    self.expression()
        elif k in ("global", "nonlocal"):
            self.i += 1
            self.name()
            while self.at(","):
                self.name()
        elif k == "del":
            self.i += 1
            got = self.expressions()
            if "d" not in got:
                self.fail("cannot delete this")
        elif k == "assert":
            self.i += 1
            self.expression()
            if self.at(","):
                self.expression()
        elif k == "import":
            self.i += 1
            while True:
                self.dotted()
                if self.at("as"):
                    self.name()
                if not self.at(","):
                    break
        elif k == "from":
            self.imports()
        elif k == "type" and self.k[self.i + 1] in ("N", *SOFT) and self.k[self.i + 2] in ("=", "["):
            self.i += 2
            self.type_parameters()
            self.take("=")
            self.expression()
        else:
            self.assignment()

    def dotted(self) -> None:
        self.name()
        while self.at("."):
            self.name()

    def imports(self) -> None:
        self.take("from")
        dots = 0
        while self.k[self.i] in (".", "..."):
            self.i += 1
            dots += 1
        if not dots or self.k[self.i] != "import":
            self.dotted()
        self.take("import")
        if self.at("*"):
            return
        bracket = self.at("(")
        while True:
            self.name()
            if self.at("as"):
                self.name()
            if not self.at(","):
                break
            if bracket and self.k[self.i] == ")":
                break
        if bracket:
            self.take(")")

    def assignment(self) -> None:
        start = self.i
        if self.k[self.i] == "yield":
            self.yields()
            if self.k[self.i] == "=":
                self.fail("cannot assign to yield")
            return
        got = self.expressions()
        k = self.k[self.i]
        if k == ":":
            if "s" not in got:
                self.fail("only a single target can be annotated")
            self.i += 1
            self.expression()
            if self.at("="):
                self.value()
            return
        if k in AUGMENTED:
            if "s" not in got or "t" in got:
                self.fail("this cannot be the target of an augmented assignment")
            self.i += 1
            self.value()
            return
        if k != "=":
            if got.startswith("*") and "t" not in got:
                self.i = start
                self.fail("a starred expression alone")
            return
        while self.at("="):
            if "a" not in got or got.startswith("*"):
                self.fail("cannot assign to this")
            if self.k[self.i] == "yield":
                self.yields()
                if self.k[self.i] == "=":
                    self.fail("cannot assign to yield")
                return
            got = self.expressions()
        if got.startswith("*") and "t" not in got:
            self.fail("a starred expression alone")

    def value(self) -> None:
        if self.k[self.i] == "yield":
            self.yields()
        else:
            self.expressions()

    def simples(self) -> None:
        while True:
            self.simple()
            if not self.at(";"):
                break
            if self.k[self.i] == END:
                return
        if self.k[self.i] != END:
            self.fail(f"unexpected {self.k[self.i]!r}")

    def statement(self) -> tuple[str, bool]:
        """(kind of statement, whether a block must follow)."""
        k = self.k[self.i]
        kind = k
        if k == "async":
            self.i += 1
            k = kind = self.k[self.i]
            if k not in ("def", "for", "with"):
                self.fail("unexpected word after 'async'")
        if k == "@":
            self.i += 1
            self.named()
            if self.k[self.i] != END:
                self.fail("unexpected end of decorator")
            return "@", False
        if k in ("if", "elif", "while"):
            self.i += 1
            self.named()
        elif k in ("else", "try", "finally"):
            self.i += 1
        elif k == "for":
            self.i += 1
            self.targets()
            self.take("in")
            self.expressions()
        elif k == "with":
            self.withs()
        elif k == "except":
            self.i += 1
            if self.at("*"):
                kind = "except*"
                self.expression()
            elif self.k[self.i] != ":":
                self.expression()
                kind = "except"
            else:
                kind = "bare"
            if kind != "bare" and self.at("as"):
                self.name()
        elif k == "def":
            self.i += 1
            self.name()
            self.type_parameters()
            self.take("(")
            self.parameters(")", True)
            self.take(")")
            if self.at("->"):
                self.expressions()
        elif k == "class":
            self.i += 1
            self.name()
            self.type_parameters()
            if self.at("("):
                self.arguments()
        elif k in ("match", "case") and self.k[-3] == ":":
            start = self.i
            try:
                self.i += 1
                if k == "match":
                    self.expressions(named=True)
                else:
                    self.patterns()
                    if self.at("if"):
                        self.named()
                self.take(":")
                if self.k[self.i] != END:
                    self.fail("unexpected text after ':'")
                return k, True
            except Panic:
                self.i = start
            self.simples()
            return "simple", False
        elif k == "case":
            start = self.i
            try:
                self.i += 1
                self.patterns()
                if self.at("if"):
                    self.named()
                self.take(":")
                self.simples()
                return "case", False
            except Panic:
                self.i = start
            self.simples()
            return "simple", False
        else:
            self.simples()
            return "simple", False
        self.take(":")
        if self.k[self.i] == END:
            return kind, True
        self.simples()
        return kind, False

    def withs(self) -> None:
        self.take("with")
        start = self.i
        if self.at("("):  # brackets round all items, or an expression
            try:
                while self.k[self.i] != ")":
                    self.item()
                    if not self.at(","):
                        break
                self.take(")")
                if self.k[self.i] == ":":
                    return
            except Panic:
                pass
            self.i = start
        while True:
            self.item()
            if not self.at(","):
                return

    def item(self) -> None:
        self.expression()
        if self.at("as"):
            self.at("*")
            if "a" not in self.unary():
                self.fail("cannot assign here")

    # Patterns of a case.

    def patterns(self) -> None:
        self.pattern(True)
        while self.at(","):
            if self.k[self.i] in (":", "if"):
                break
            self.pattern(True)

    def pattern(self, star: bool = False) -> None:
        if star and self.at("*"):
            self.name()
            return
        self.closed()
        while self.at("|"):
            self.closed()
        if self.at("as"):
            self.name()

    def closed(self) -> None:
        k = self.k[self.i]
        if k in ("-", "0"):
            self.at("-")
            self.take("0")
            if self.k[self.i] in ("+", "-"):
                self.i += 1
                self.take("0")
        elif k in ("S", "B"):
            self.atom()
        elif k in ("None", "True", "False"):
            self.i += 1
        elif k in ("(", "["):
            close = ")" if k == "(" else "]"
            self.i += 1
            while self.k[self.i] != close:
                self.pattern(True)
                if not self.at(","):
                    break
            self.take(close)
        elif k == "{":
            self.i += 1
            while self.k[self.i] != "}":
                if self.at("**"):
                    self.name()
                else:
                    self.closed()
                    self.take(":")
                    self.pattern()
                if not self.at(","):
                    break
            self.take("}")
        else:
            self.dotted()
            if self.at("("):
                keyword = False
                while self.k[self.i] != ")":
                    if self.k[self.i + 1] == "=":
                        self.name()
                        self.take("=")
                        keyword = True
                    elif keyword:
                        self.fail("positional pattern follows keyword pattern")
                    self.pattern()
                    if not self.at(","):
                        break
                self.take(")")


# Kinds of tokens.

_known: Memo = Memo(400_000)
_fixed = {k: k for k in (*KEYWORDS, *SOFT, *OPERATORS)}
_lines: Memo = Memo(200_000)


def _escapes(body: str, raw_bytes: bool) -> bool:
    for m in _ESCAPE.finditer(body):
        x, u, wide, name = m.groups()
        if x is not None and len(x) != 2:
            return False
        if raw_bytes:
            continue
        if (u is not None and len(u) != 4) or (wide is not None and (len(wide) != 8 or int(wide, 16) > 0x10FFFF)):
            return False
        if m[0][1] == "N":
            if not name:
                return False
            try:
                unicodedata.lookup(name[1:-1])
            except KeyError:
                return False
    return True


def _field(text: str, at: int, quote: str) -> int:
    """End of the replacement field of an f-string whose '{' is before ``at``; the place after its '}'."""
    kinds: list[str] = []
    depth = 0
    n = len(text)
    while True:
        m = TOKEN.match(text, at)
        t = m[1] if m else ""
        if t == "":
            raise Panic(at, "unterminated replacement field")
        begin = m.start(1)
        if t[0] in "\n#":
            at = m.end()
            continue
        if not depth and t in ("}", ":", ":=", "!"):
            at = begin
            break
        if _FSTART.match(text, begin):
            at = _fstring(text, begin)
            kinds.append("S")
            continue
        k = _kind(t)
        if k == "?":
            raise Panic(at, "an invalid token in a replacement field")
        depth += (k in ("(", "[", "{")) - (k in (")", "]", "}"))
        kinds.append(k)
        at = m.end()
    if kinds and kinds[-1] == "=":
        kinds.pop()
    line = Line(tuple(kinds))
    if line.k[0] == "yield":
        line.yields()
    else:
        line.expressions(named=True)
    if line.k[line.i] != END:
        line.fail("unexpected text in a replacement field")
    if text[at] == "!":
        m = re.compile(r"!\s*[rsa]\s*").match(text, at)
        if not m:
            raise Panic(at, "invalid conversion")
        at = m.end()
    if at < n and text[at] == ":":
        at += 1
        while at < n and text[at] != "}":
            if text[at] == "{":
                at = _field(text, at + 1, quote)
            elif text.startswith(quote, at) or (text[at] == "\n" and len(quote) == 1):
                raise Panic(at, "unterminated format")
            else:
                at += 1
    if at >= n or text[at] != "}":
        raise Panic(at, "expected '}'")
    return at + 1


_FSTART = re.compile(r"([rR]?[fF][rR]?)(\"\"\"|'''|\"|')")


def _fstring(text: str, at: int) -> int:
    """End of the f-string that starts at ``at``."""
    m = _FSTART.match(text, at)
    raw, quote = "r" in m[1].lower(), m[2]
    at = m.end()
    n = len(text)
    start = at
    while at < n:
        c = text[at]
        if text.startswith(quote, at):
            if not raw and not _escapes(re.sub(r"\{.*?\}", "", text[start:at], flags=re.S), False):
                raise Panic(at, "invalid escape")
            return at + len(quote)
        if c == "\\" and not (raw and at + 1 < n and text[at + 1] in "{}"):
            if not raw and text.startswith("\\N{", at):
                at = text.find("}", at) + 1 or n
            elif at + 1 < n and text[at + 1] in "{}":
                at += 1
            else:
                at += 2
        elif c == "\n" and len(quote) == 1:
            break
        elif c == "{":
            at = at + 2 if text.startswith("{{", at) else _field(text, at + 1, quote)
        elif c == "}":
            if not text.startswith("}}", at):
                raise Panic(at, "single '}' in an f-string")
            at += 2
        else:
            at += 1
    raise Panic(at, "unterminated f-string")


def _kind(t: str) -> str:
    """Kind of a token: a fixed word or sign, N(ame), 0 (number), S(tring), B(ytes), ? (none)."""
    k = _fixed.get(t)
    if k:
        return k
    c = t[0]
    if t[-1] in "\"'" and (m := _STRING.fullmatch(t)):
        prefix = m[1].lower()
        if "f" in prefix:
            try:
                return "S" if _fstring(t, 0) == len(t) else "?"
            except Panic:
                return "?"
        if "b" in prefix:
            return "B" if m[3].isascii() and ("r" in prefix or _escapes(m[3], True)) else "?"
        return "S" if "r" in prefix or "\\" not in m[3] or _escapes(m[3], False) else "?"
    if c.isdigit() or c == ".":
        return "0" if re.fullmatch(_NUMBER, t) and not re.fullmatch(r"0[0-9_]*[1-9][0-9_]*", t) else "?"
    return "N" if t.isidentifier() else "?"


def _parse(kinds: tuple[str, ...]) -> tuple[str, bool, str, int]:
    """(kind of statement, block must follow, cause of the error or nothing, token of the error)."""
    try:
        kind, block = Line(kinds).statement()
        return kind, block, "", 0
    except Panic as p:
        if "?" in kinds:
            return "error", False, "invalid token", kinds.index("?")
        return "error", kinds[-1:] == (":",), p.cause, p.at


def _depth(kinds: tuple[str, ...]) -> tuple[int, int]:
    low = now = 0
    for k in kinds:
        if k in "([{":
            now += 1
        elif k in ")]}":
            now -= 1
            low = min(low, now)
    return low, now


#: Brackets that may stand within one another.
DEEPEST = 200


def _deepest(kinds: tuple[str, ...]) -> int:
    now = most = 0
    for k in kinds:
        now += (k in ("(", "[", "{")) - (k in (")", "]", "}"))
        most = max(most, now)
    return most


def _retoken(text: str) -> list[str]:
    """Tokens of a text with f-strings that hold their own quotes; slower than one search for all."""
    out, at, n = [], 0, len(text)
    while at < n:
        m = TOKEN.match(text, at)
        t, begin = m[1], m.start(1)
        if t == "":
            break
        f = _FSTART.match(text, begin)
        if f:
            try:
                at = _fstring(text, begin)
                out.append('f""' + "\n" * 0 if "\n" not in text[begin:at] else 'f"""' + "\n" * text.count("\n", begin, at) + '"""')
                continue
            except Panic:
                pass
        out.append(t)
        at = m.end()
    return out


#: What may follow a finished clause in the same block.
_AFTER = {
    "if": ("elif", "else"), "elif": ("elif", "else"), "while": ("else",), "for": ("else",), "try": ("except", "except*", "bare", "finally"),
    "except": ("except", "bare", "else", "finally"), "bare": ("else", "finally"), "except*": ("except*", "else", "finally"), "tryelse": ("finally",),
}
#: Words that begin a statement and stand in no bracket: where parsing goes on after an open one.
_STARTS = frozenset("def class return import while with try except finally raise pass break continue global nonlocal del assert elif".split())
_CLAUSES = frozenset(("elif", "else", "except", "except*", "bare", "finally"))


def check(source: str) -> list[Fault]:
    """All syntax errors of a Python file, in order; an empty list if it is valid."""
    text = source[1:] if source.startswith("\ufeff") else source
    if "\r" in text:
        text = text.replace("\r\n", "\n").replace("\r", "\n")
    if "\0" in text:
        return [Fault(text.count("\n", 0, text.index("\0")) + 1, "null byte")]
    known = _known.get
    tokens = TOKEN.findall("\n" + text)
    kinds: list[str] = []
    retried = False
    while True:
        kinds = [known(t) or _classify(t) for t in tokens]
        if "?" in kinds and not retried and ("f'" in text or 'f"' in text or "F'" in text or 'F"' in text or "fr" in text.lower() or "rf" in text.lower()):
            tokens = _retoken("\n" + text)
            retried = True
            continue
        break
    faults: list[Fault] = []
    ends = [k for k, kind in enumerate(kinds) if kind == "\n"]
    ends.append(len(kinds))
    line_no = 0
    # Blocks: [column, column with tabs as one, last clause, kind of the block]
    blocks: list[list] = [[0, 0, "", ""]]
    opener = ""  # a block must follow
    held: tuple[str, ...] = ()
    held_line = 0
    held_at = 0
    depth = 0
    loose = False  # after a bracket given up, a deeper line may be the block that was meant
    for j in range(len(ends) - 1):
        a, z = ends[j], ends[j + 1]
        line_no += 1
        first_line = line_no
        body = tuple(kinds[a + 1 : z])
        if "c" in body:
            body = tuple(k for k in body if k != "c")
        extra = 0
        for k in range(a + 1, z):
            if kinds[k] in ("S", "B") and "\n" in tokens[k]:
                extra += tokens[k].count("\n")
        line_no += extra
        if not body and not depth:
            continue
        low, net = _known.get(body) or _known.keep(body, _depth(body))
        if depth and body and body[0] in _STARTS:
            faults.append(Fault(held_line, "a bracket was never closed"))
            depth, held, opener, loose = 0, (), "", True
            blocks[-1][2] = ""
        if depth or net or low:
            if not depth:
                held, held_line, held_at = (), first_line, a
            held += body
            if depth + low < 0:
                faults.append(Fault(first_line, "unmatched closing bracket"))
                depth, held = 0, ()
                continue
            depth += net
            if depth:
                continue
            body, first_line, begin = held, held_line, held_at
            held = ()
        else:
            begin = a
        if len(body) > 2 * DEEPEST and _deepest(body) > DEEPEST:
            faults.append(Fault(first_line, "too many nested brackets"))
            continue
        got = _lines.get(body)
        if got is None:
            got = _lines.keep(body, _parse(body))
        kind, block, cause, _ = got
        space = tokens[begin][1:]
        if "\f" in space:
            space = space[space.rindex("\f") + 1 :]
        if "\t" in space:
            col = 0
            for c in space:
                col = col // 8 * 8 + 8 if c == "\t" else col + 1
            alt = len(space)
        else:
            col = alt = len(space)
        if opener:
            if col > blocks[-1][0] and alt > blocks[-1][1]:
                blocks.append([col, alt, "", opener])
            else:
                faults.append(Fault(first_line, f"expected an indented block after {opener!r}"))
            opener = ""
        elif col > blocks[-1][0]:
            if not loose:
                faults.append(Fault(first_line, "unexpected indent"))
            blocks.append([col, alt, "", "?"])
        loose = False
        top = blocks[-1]
        while col < top[0]:
            if top[2] == "try":
                faults.append(Fault(first_line, "expected 'except' or 'finally' block"))
            elif top[2] == "@":
                faults.append(Fault(first_line, "a decorator with nothing to decorate"))
            blocks.pop()
            top = blocks[-1]
            if col > top[0]:
                faults.append(Fault(first_line, "unindent does not match any outer level"))
                top[0], top[1] = top[0], top[1]
                blocks.append([col, alt, "", "?"])
                top = blocks[-1]
                break
        if col == top[0] and alt != top[1]:
            faults.append(Fault(first_line, "inconsistent use of tabs and spaces"))
        last = top[2]
        if kind == "error":
            faults.append(Fault(first_line, cause))
            top[2] = ""
            opener = "?" if block else ""
            continue
        if last == "@" and kind not in ("@", "def", "class"):
            faults.append(Fault(first_line, "a decorator with nothing to decorate"))
        if kind in _CLAUSES:
            if kind not in _AFTER.get(last, ()):
                faults.append(Fault(first_line, f"{kind!r} without its statement"))
            now = "tryelse" if kind == "else" and last in ("except", "bare", "except*") else "" if kind in ("else", "finally") else kind
        else:
            if last == "try":
                faults.append(Fault(first_line, "expected 'except' or 'finally' block"))
            now = kind if kind in ("if", "while", "for", "try", "@") else ""
        if top[3] == "match" and kind != "case":
            faults.append(Fault(first_line, "expected 'case'"))
        elif kind == "case" and top[3] != "match":
            faults.append(Fault(first_line, "'case' outside 'match'"))
        top[2] = now
        if block:
            opener = kind
    if depth:
        faults.append(Fault(held_line, "a bracket was never closed"))
    elif opener:
        faults.append(Fault(line_no, f"expected an indented block after {opener!r}"))
    for b in blocks:
        if b[2] == "try" and not (depth or opener):
            faults.append(Fault(line_no, "expected 'except' or 'finally' block"))
        elif b[2] == "@":
            faults.append(Fault(line_no, "a decorator with nothing to decorate"))
    return faults


def _classify(t: str) -> str:
    if not t:
        return _known.keep(t, "c")
    c = t[0]
    if c == "\n":
        return _known.keep(t, "\n")
    if c == "#":
        return "c"
    k = _kind(t)
    if len(t) < 64:
        _known.keep(t, k)
    return k
