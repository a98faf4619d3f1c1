"""Acceptor for ECMAScript modules: recursive descent for statements, precedence climbing for expressions.

After an error the parser skips to the end of the statement and goes on, so a file gives all its errors.
"""

from __future__ import annotations

import re

from .base import Fault, Memo, Panic

# Fixed values of the language.
KEYWORDS = "break case catch class const continue debugger default delete do else enum export extends false finally for function if import in instanceof new null return super switch this throw true try typeof var void while with yield let static implements interface package private protected public await".split()
PUNCTUATORS = ">>>= ... === !== **= <<= >>= >>> &&= ||= ??= => == != <= >= && || ?? ?. ++ -- += -= *= /= %= &= |= ^= ** << >> { } ( ) [ ] . ; , < > + - * / % & | ^ ! ~ ? : = @".split()
BINARY = {"??": 1, "||": 2, "&&": 3, "|": 4, "^": 5, "&": 6, "==": 7, "!=": 7, "===": 7, "!==": 7, "<": 8, ">": 8, "<=": 8, ">=": 8, "instanceof": 8, "in": 8, "<<": 9, ">>": 9, ">>>": 9, "+": 10, "-": 10, "*": 11, "/": 11, "%": 11, "**": 12}
ASSIGN = frozenset("= += -= *= /= %= **= <<= >>= >>>= &= |= ^= &&= ||= ??=".split())
#: Reserved in strict code, which a module always is; never names of bindings.
RESERVED = frozenset(KEYWORDS)

_NUMBER = r"(?:0[xX][0-9a-fA-F](?:_?[0-9a-fA-F])*n?|0[bB][01](?:_?[01])*n?|0[oO][0-7](?:_?[0-7])*n?|(?:0|[1-9](?:_?[0-9])*)n|(?:(?:0|[1-9](?:_?[0-9])*)(?:\.(?:[0-9](?:_?[0-9])*)?)?|\.[0-9](?:_?[0-9])*)(?:[eE][-+]?[0-9](?:_?[0-9])*)?)"
_STRING = "|".join(rf"{q}(?:[^\\{q}\n\r]++|\\(?:\r\n|.))*+{q}" for q in "\"'")
_PLAIN_TEMPLATE = r"`(?:[^`\\$]++|\\.|\$(?!\{)|\$\{[^`{}\"'/]*\})*+`"
_IDENT = r"(?:[^\W\d]|[$]|\\u(?:[0-9a-fA-F]{4}|\{[0-9a-fA-F]+\}))(?:[\w$\u200c\u200d]|\\u(?:[0-9a-fA-F]{4}|\{[0-9a-fA-F]+\}))*"
_REGEX = r"/(?![*/])(?:[^\\/\[\n\r\u2028\u2029]|\\[^\n\r]|\[(?:[^\]\\\n\r]|\\[^\n\r])*\])+/[A-Za-z]*"
_SPACE = r"[ \t\v\f\u00a0\ufeff\u1680\u2000-\u200a\u202f\u205f\u3000]*"
TOKEN = re.compile(
    rf"{_SPACE}([\n\r\u2028\u2029]\s*|//[^\n\r\u2028\u2029]*|/\*(?:[^*]++|\*(?!/))*+\*/|{_STRING}|{_PLAIN_TEMPLATE}|{_IDENT}|#{_IDENT}"
    rf"|{_NUMBER}(?![\w$])|[0-9][\w$]*|\?\.(?=[0-9])|{'|'.join(re.escape(p) for p in PUNCTUATORS)}|.|\Z)",
    re.S,
)
_TEMPLATE_PART = re.compile(r"(?:[^`\\$]++|\\.|\$(?!\{))*+", re.S)
_HOLE = re.compile(r"\$\{([^`{}]*)\}")
_BAD_ESCAPE = re.compile(r"\\(?:x(?![0-9a-fA-F]{2})|u(?![0-9a-fA-F]{4}|\{0*(?:10|[0-9a-fA-F])?[0-9a-fA-F]{1,4}\})|[1-9]|0[0-9])")
END = "$"
_known: Memo = Memo(200_000)
_known.update({k: k for k in (*KEYWORDS, *PUNCTUATORS)})
_fixed = frozenset(_known)
_holes: Memo = Memo(50_000)


def _kind(t: str) -> str:
    """A word or sign itself, or N(ame) 0 S(tring) T(emplate) P(rivate name) c(omment) newline ? (none)."""
    if t in _fixed:
        return t
    if t == "":
        return "c"
    c = t[0]
    if c in "\n\r\u2028\u2029":
        return "\n"
    if t.startswith("//"):
        return "c"
    if t.startswith("/*"):
        return "\n" if re.search("[\n\r\u2028\u2029]", t) else "c"
    if c in "\"'":
        bare = t.replace("\\\\", "")
        return "S" if len(t) > 1 and t[-1] == c and not ("\\" in bare and _BAD_ESCAPE.search(bare)) else "?"
    if c == "`":
        if len(t) < 2 or t[-1] != "`":
            return "?"
        bare = t.replace("\\\\", "")
        if "\\" in bare and _BAD_ESCAPE.search(bare):
            return "?"
        return "T" if all(_hole(h) for h in _HOLE.findall(t)) else "?"
    if c.isdigit() or (c == "." and len(t) > 1):
        return "0" if re.fullmatch(_NUMBER, t) else "?"
    if c == "#":
        return "P" if len(t) > 1 else "?"
    if "\\" in t:
        t = re.sub(r"\\u(?:\{([0-9a-fA-F]+)\}|([0-9a-fA-F]{4}))", lambda m: chr(min(int(m[1] or m[2], 16), 0x10FFFF)), t)
        if t in RESERVED:
            return "?"
    return "N" if re.sub("[$\u200c\u200d]", "a", t).isidentifier() else "?"


def _hole(text: str) -> bool:
    """Whether the text is an expression, as in a template."""
    known = _holes.get(text)
    if known is None:
        p = Parser(*_tokens(text))
        # What a hole may hold besides (await, yield, super ...) depends on the function round it; it is let pass.
        p.function = p.asynchronous = p.generator = True
        try:
            p.sequence()
            known = p.k[p.i] == END
        except Panic:
            known = False
        _holes.keep(text, known)
    return known


_GROUP = re.compile(r"\(\?(?::|=|!|<=|<!|<[$A-Za-z_][\w$]*>|[ims]*(?:-[ims]*)?:)")
_regexes = Memo(1 << 14)


def _sound(regex: str) -> bool:
    """Whether flags and groups of a regular expression are in order, and nothing is repeated that isn't there."""
    pattern, _, flags = regex[1:].rpartition("/")
    if len(set(flags)) < len(flags) or not set(flags) <= set("dgimsuvy") or {"u", "v"} <= set(flags):
        return False
    depth, at, first = 0, 0, True
    while at < len(pattern):
        c = pattern[at]
        if c == "\\":
            at, first = at + 2, False
            continue
        if c == "[":
            at += 1
            while at < len(pattern) and pattern[at] != "]":
                at += 2 if pattern[at] == "\\" else 1
            first = False
        elif c == "(":
            depth += 1
            if pattern[at + 1 : at + 2] == "?":
                m = _GROUP.match(pattern, at)
                if not m:
                    return False
                at = m.end() - 1
            first = True
        elif c == ")":
            depth, first = depth - 1, False
            if depth < 0:
                return False
        elif c in "*+?" and first:
            return False
        else:
            first = c == "|"
        at += 1
    return depth == 0


_BEFORE_DIVISION = frozenset(("N", "0", "S", "T", "R", "P", ")", "]", "}", "this", "super", "null", "true", "false", "++", "--", "?"))


def _walk(text: str, at: int, inner: bool) -> tuple[list[str], list[str], int]:
    """Tokens with a place for each, telling regular expressions from divisions and following nested templates."""
    out: list[str] = []
    kinds: list[str] = []
    regex = re.compile(_REGEX)
    n, depth, last = len(text), 0, ""
    while at < n:
        m = TOKEN.match(text, at)
        t, begin = m[1], m.start(1)
        at = m.end()
        if t == "":
            break
        k = _known.get(t) or _kind(t)
        if t[0] == "`":
            end, ok = _template(text, begin)
            out.append(text[begin:end] if "\n" in text[begin:end] else "``")
            kinds.append("T" if ok else "?")
            at, last = end, "T"
            continue
        if k in ("/", "/=") and last not in _BEFORE_DIVISION and (r := regex.match(text, begin)):
            out.append(r[0])
            known = _regexes.get(r[0])
            kinds.append("R" if (_regexes.keep(r[0], _sound(r[0])) if known is None else known) else "?")
            at, last = r.end(), "R"
            continue
        if k == "{":
            depth += 1
        elif k == "}":
            if not depth and inner:
                return out, kinds, begin
            depth -= 1
        out.append(t)
        kinds.append(k)
        if k not in ("c", "\n"):
            last = k
    return out, kinds, n


def _template(text: str, at: int) -> tuple[int, bool]:
    """(end, whether it is valid) of the template that starts at ``at``."""
    at += 1
    ok, n = True, len(text)
    while True:
        m = _TEMPLATE_PART.match(text, at)
        bare = m[0].replace("\\\\", "")
        ok &= not ("\\" in bare and _BAD_ESCAPE.search(bare))
        at = m.end()
        if at >= n:
            return n, False
        if text[at] == "`":
            return at + 1, ok
        if not text.startswith("${", at):
            return n, False
        tokens, kinds, end = _walk(text, at + 2, True)
        if end >= n:
            return n, False
        p = Parser(tokens, kinds)
        p.function = p.asynchronous = p.generator = True
        try:
            p.sequence()
            ok &= p.k[p.i] == END
        except Panic:
            ok = False
        at = end + 1


def _tokens(text: str) -> tuple[list[str], list[str]]:
    tokens = TOKEN.findall(text)
    known = _known.get
    kinds = [known(t) or (_known.keep(t, _kind(t)) if len(t) < 48 else _kind(t)) for t in tokens]
    if "/" in kinds or "/=" in kinds or "`" in tokens:
        tokens, kinds, _ = _walk(text, 0, False)
    return tokens, kinds


class Parser:
    """What expressions return: '=' a simple target, 'p' may be a pattern, 'c' must become one, '' neither."""

    def __init__(self, tokens: list[str], kinds: list[str]) -> None:
        line, fresh = 1, True
        self.k: list[str] = []
        self.t: list[str] = []
        self.nl: list[bool] = []
        self.line: list[int] = []
        for t, k in zip(tokens, kinds, strict=True):
            if k == "\n":
                fresh = True
                line += t.count("\n")
            elif k != "c":
                self.k.append(k)
                self.t.append(t)
                self.nl.append(fresh)
                self.line.append(line)
                fresh = False
                if k == "T" or k == "S":
                    line += t.count("\n")
        self.k += [END, END, END]
        self.t += ["", "", ""]
        self.nl += [True, True, True]
        self.line += [line] * 3
        self.close = self._brackets()
        self.i = 0
        self.function = self.asynchronous = self.generator = False
        self.loop = self.switch = 0
        self.method = False
        self.labels: list[str] = []
        self.defaulted = False
        self.faults: list[Fault] = []

    def _brackets(self) -> dict[int, int]:
        stack: list[int] = []
        close: dict[int, int] = {}
        k = self.k
        for j, x in enumerate(k):
            if x in ("(", "[", "{"):
                stack.append(j)
            elif x in (")", "]", "}") and stack:
                close[stack.pop()] = j
        return close

    def fail(self, cause: str) -> None:
        raise Panic(self.i, cause)

    def take(self, kind: str) -> None:
        if self.k[self.i] != kind:
            self.fail(f"expected {kind!r}, found {self.t[self.i] or 'the end'!r}")
        self.i += 1

    def at(self, kind: str) -> bool:
        if self.k[self.i] == kind:
            self.i += 1
            return True
        return False

    def word(self, text: str) -> bool:
        """A contextual word, which is an ordinary name to the tokenizer."""
        return self.t[self.i] == text and self.k[self.i] == "N"

    def binding(self) -> None:
        if self.k[self.i] != "N":
            self.fail(f"expected a name, found {self.t[self.i] or 'the end'!r}")
        if self.t[self.i] in ("eval", "arguments"):
            self.fail("eval and arguments cannot be bound")
        self.i += 1

    def semicolon(self) -> None:
        if self.at(";") or self.k[self.i] in ("}", END) or self.nl[self.i]:
            return
        self.fail(f"expected ';', found {self.t[self.i]!r}")

    # Statements.

    def program(self) -> list[Fault]:
        while self.k[self.i] != END:
            self.guarded(True)
        return self.faults

    def guarded(self, top: bool) -> None:
        """A statement; after an error what is left of it is skipped."""
        start = self.i
        state = self.function, self.asynchronous, self.generator, self.loop, self.switch, self.method, len(self.labels)
        try:
            self.statement(top)
        except Panic as p:
            self.function, self.asynchronous, self.generator, self.loop, self.switch, self.method = state[:6]
            del self.labels[state[6] :]
            self.faults.append(Fault(self.line[min(p.at, len(self.line) - 1)], p.cause))
            self.i = max(p.at, start)
            while self.k[self.i] not in (END, ";", "}"):
                if self.i > start and self.nl[self.i] and self.k[self.i] in ("const", "var", "let", "function", "class", "import", "export", "if", "for", "while", "return", "switch", "try"):
                    return
                self.i = self.close.get(self.i, self.i) + 1
            if self.k[self.i] == ";" or (self.k[self.i] == "}" and top):
                self.i += 1

    def block(self) -> None:
        self.take("{")
        while self.k[self.i] not in ("}", END):
            self.guarded(False)
        self.take("}")

    def declarations(self, kind: str, no_in: bool) -> int:
        n = 0
        while True:
            pattern = self.k[self.i] in ("[", "{")
            self.target()
            n += 1
            if self.at("="):
                self.assignment(no_in)
            elif (pattern or kind == "const") and not (no_in and (self.k[self.i] == "in" or self.word("of"))):
                self.fail("a declaration without a value")
            if not self.at(","):
                return n

    def target(self) -> None:
        """A binding: a name or a pattern of them."""
        k = self.k[self.i]
        if k == "[":
            self.i += 1
            while self.k[self.i] != "]":
                if self.at(","):
                    continue
                rest = self.at("...")
                self.target()
                if not rest and self.at("="):
                    self.assignment()
                if self.k[self.i] != "]":
                    if rest:
                        self.fail("a rest element must be last")
                    self.take(",")
            self.i += 1
        elif k == "{":
            self.i += 1
            while self.k[self.i] != "}":
                if self.at("..."):
                    self.binding()
                    if self.k[self.i] != "}":
                        self.fail("a rest element must be last")
                    break
                short = self.k[self.i] == "N"
                self.property_name()
                if self.at(":"):
                    self.target()
                elif not short:
                    self.fail("expected ':'")
                if self.at("="):
                    self.assignment()
                if not self.at(","):
                    break
            self.take("}")
        else:
            self.binding()

    def statement(self, top: bool = False, single: bool = False) -> None:
        k = self.k[self.i]
        if k == "{":
            self.block()
        elif k == ";":
            self.i += 1
        elif k in ("const", "let") or k == "var":
            if single and k != "var":
                self.fail("a declaration in a single-statement place")
            self.i += 1
            self.declarations(k, False)
            self.semicolon()
        elif k == "function" or (self.word("async") and self.k[self.i + 1] == "function" and not self.nl[self.i + 1]):
            if single:
                self.fail("a declaration in a single-statement place")
            self.functions(True)
        elif k == "class":
            if single:
                self.fail("a declaration in a single-statement place")
            self.classes(True)
        elif k == "@":
            self.decorators()
            self.at("export") and self.at("default")
            self.classes(False)
        elif k == "if":
            self.i += 1
            self.bracketed()
            self.statement(single=True)
            if self.at("else"):
                self.statement(single=True)
        elif k == "for":
            self.fors()
        elif k == "while":
            self.i += 1
            self.bracketed()
            self.body()
        elif k == "do":
            self.i += 1
            self.body()
            self.take("while")
            self.bracketed()
            self.at(";")
        elif k in ("break", "continue"):
            self.i += 1
            if self.k[self.i] == "N" and not self.nl[self.i]:
                if self.t[self.i] not in self.labels:
                    self.fail("an undefined label")
                self.i += 1
            elif not self.loop and not (k == "break" and self.switch):
                self.i -= 1
                self.fail(f"{k!r} outside a loop")
            self.semicolon()
        elif k == "return":
            if not self.function:
                self.fail("'return' outside a function")
            self.i += 1
            if self.k[self.i] not in (";", "}", END) and not self.nl[self.i]:
                self.sequence()
            self.semicolon()
        elif k == "throw":
            self.i += 1
            if self.nl[self.i]:
                self.fail("line end after 'throw'")
            self.sequence()
            self.semicolon()
        elif k == "switch":
            self.i += 1
            self.bracketed()
            self.take("{")
            self.switch += 1
            default = False
            while self.k[self.i] != "}":
                if self.at("case"):
                    self.sequence()
                elif self.at("default"):
                    if default:
                        self.fail("a second 'default'")
                    default = True
                else:
                    self.fail(f"expected 'case', found {self.t[self.i] or 'the end'!r}")
                self.take(":")
                while self.k[self.i] not in ("case", "default", "}", END):
                    self.guarded(False)
            self.i += 1
            self.switch -= 1
        elif k == "try":
            self.i += 1
            self.block()
            handled = False
            if self.at("catch"):
                handled = True
                if self.at("("):
                    self.target()
                    self.take(")")
                self.block()
            if self.at("finally"):
                handled = True
                self.block()
            if not handled:
                self.fail("'try' without 'catch' or 'finally'")
        elif k == "debugger":
            self.i += 1
            self.semicolon()
        elif k == "import" and self.k[self.i + 1] not in ("(", "."):
            if not top:
                self.fail("'import' not at the top of the module")
            self.imports()
        elif k == "export":
            if not top:
                self.fail("'export' not at the top of the module")
            self.exports()
        elif k == "N" and self.k[self.i + 1] == ":":
            if self.t[self.i] in self.labels:
                self.fail("a label within its own statement")
            self.labels.append(self.t[self.i])
            self.i += 2
            self.statement(single=True)
            self.labels.pop()
        else:
            self.sequence()
            self.semicolon()

    def bracketed(self) -> None:
        self.take("(")
        self.sequence()
        self.take(")")

    def body(self) -> None:
        self.loop += 1
        self.statement(single=True)
        self.loop -= 1

    def fors(self) -> None:
        self.take("for")
        if self.k[self.i] == "await":
            if self.function and not self.asynchronous:
                self.fail("'await' outside an async function")
            self.i += 1
        self.take("(")
        k = self.k[self.i]
        if k in ("var", "let", "const"):
            self.i += 1
            n = self.declarations(k, True)
            if n == 1 and (self.at("in") or self.word("of")):
                self.of()
                return
        elif k != ";":
            got = self.sequence(True)
            if self.k[self.i] == "in" or self.word("of"):
                if not got:
                    self.fail("an invalid target of 'for'")
                self.at("in")
                self.of()
                return
            if "c" in got:
                self.fail("an initialiser in an object literal")
        self.take(";")
        if self.k[self.i] != ";":
            self.sequence()
        self.take(";")
        if self.k[self.i] != ")":
            self.sequence()
        self.take(")")
        self.body()

    def of(self) -> None:
        if self.word("of"):
            self.i += 1
            self.assignment()
        else:
            self.sequence()
        self.take(")")
        self.body()

    def imports(self) -> None:
        self.take("import")
        if not self.at("S"):
            if self.k[self.i] == "N":
                self.binding()
                more = self.at(",")
            else:
                more = True
            if more:
                if self.at("*"):
                    self.as_binding()
                else:
                    self.take("{")
                    while self.k[self.i] != "}":
                        if self.k[self.i] == "S" or self.k[self.i + 1] == "N" and self.t[self.i + 1] == "as":
                            self.i += 1
                            self.as_binding()
                        else:
                            self.binding()
                        if not self.at(","):
                            break
                    self.take("}")
            self.source()
        self.attributes()
        self.semicolon()

    def as_binding(self) -> None:
        if not self.word("as"):
            self.fail("expected 'as'")
        self.i += 1
        self.binding()

    def source(self) -> None:
        if not self.word("from"):
            self.fail("expected 'from'")
        self.i += 1
        self.take("S")

    def attributes(self) -> None:
        if self.k[self.i] == "with" and not self.nl[self.i]:
            self.i += 1
            self.take("{")
            while self.k[self.i] != "}":
                if self.k[self.i] not in ("N", "S") and self.k[self.i] not in RESERVED:
                    self.fail("expected a name")
                self.i += 1
                self.take(":")
                self.take("S")
                if not self.at(","):
                    break
            self.take("}")

    def exports(self) -> None:
        self.take("export")
        k = self.k[self.i]
        if self.at("default"):
            if self.defaulted:
                self.fail("a second default export")
            self.defaulted = True
            if self.k[self.i] == "function" or (self.word("async") and self.k[self.i + 1] == "function" and not self.nl[self.i + 1]):
                self.functions(False)
            elif self.k[self.i] == "class":
                self.classes(False)
            else:
                self.assignment()
                self.semicolon()
        elif k == "*":
            self.i += 1
            if self.word("as"):
                self.i += 2
            self.source()
            self.attributes()
            self.semicolon()
        elif k == "{":
            self.i += 1
            reserved = False
            while self.k[self.i] != "}":
                for second in (False, True):
                    k = self.k[self.i]
                    if k not in ("N", "S") and k not in RESERVED:
                        self.fail("expected a name")
                    reserved |= k != "N" and not second
                    self.i += 1
                    if second or not self.word("as"):
                        break
                    self.i += 1
                if not self.at(","):
                    break
            self.take("}")
            if self.word("from"):
                self.source()
                self.attributes()
            elif reserved:
                self.fail("a reserved word is exported")
            self.semicolon()
        elif k in ("const", "let", "var", "function", "class", "@") or self.word("async"):
            self.statement()
        else:
            self.fail(f"unexpected {self.t[self.i] or 'the end'!r} after 'export'")

    # Functions and classes.

    def functions(self, named: bool) -> None:
        asynchronous = self.word("async")
        if asynchronous:
            self.i += 1
        self.take("function")
        generator = self.at("*")
        if self.k[self.i] == "N":
            self.binding()
        elif named:
            self.fail("a function without a name")
        self.rest_of_function(asynchronous, generator)

    def enter(self, asynchronous: bool, generator: bool) -> tuple:
        state = self.function, self.asynchronous, self.generator, self.loop, self.switch, self.labels, self.method
        self.function, self.asynchronous, self.generator, self.loop, self.switch, self.labels = True, asynchronous, generator, 0, 0, []
        return state

    def leave(self, state: tuple) -> None:
        self.function, self.asynchronous, self.generator, self.loop, self.switch, self.labels, self.method = state

    def rest_of_function(self, asynchronous: bool, generator: bool) -> None:
        state = self.enter(asynchronous, generator)
        self.take("(")
        self.parameters(")")
        self.block()
        self.leave(state)

    def parameters(self, close: str) -> None:
        while self.k[self.i] != close:
            rest = self.at("...")
            self.target()
            if not rest and self.at("="):
                self.assignment()
            if rest or not self.at(","):
                break
        self.take(close)

    def decorators(self) -> None:
        while self.at("@"):
            if self.k[self.i] == "(":
                self.bracketed()
            else:
                self.binding()
                while self.at("."):
                    self.i += 1
                if self.at("("):
                    self.arguments()

    def classes(self, named: bool) -> None:
        self.take("class")
        if self.k[self.i] == "N":
            self.binding()
        elif named:
            self.fail("a class without a name")
        if self.at("extends"):
            self.left_hand()
        self.take("{")
        while self.k[self.i] != "}":
            if self.at(";"):
                continue
            self.decorators()
            if self.k[self.i] == "static" and self.k[self.i + 1] not in ("(", "=", ";", "}"):
                self.i += 1
                if self.k[self.i] == "{":
                    state = self.enter(False, False)
                    self.function = False
                    self.block()
                    self.leave(state)
                    continue
            self.member(True)
        self.i += 1

    def property_name(self) -> None:
        k = self.k[self.i]
        if k == "[":
            self.i += 1
            self.assignment()
            self.take("]")
        elif k in ("N", "S", "0") or k in RESERVED:
            self.i += 1
        else:
            self.fail(f"expected a property name, found {self.t[self.i] or 'the end'!r}")

    def member(self, of_class: bool) -> str:
        """A member of a class, or of an object literal, of which it tells what an expression tells."""
        asynchronous = generator = accessor = False
        stops = ("(", ",", "}", ":", "=", ";", END)
        if self.word("async") and self.k[self.i + 1] not in stops and not self.nl[self.i + 1]:
            self.i += 1
            asynchronous = True
        if self.at("*"):
            generator = True
        elif not asynchronous and (self.word("get") or self.word("set") or (of_class and self.word("accessor"))) and self.k[self.i + 1] not in stops and not (of_class and self.nl[self.i + 1] and self.k[self.i + 1] in ("*",)):
            accessor = not self.word("accessor")
            self.i += 1
        plain = self.k[self.i] == "N" or self.k[self.i] in ("yield", "await", "let", "static") and False
        if of_class and self.k[self.i] == "P":
            self.i += 1
        else:
            self.property_name()
        if self.k[self.i] == "(":
            self.rest_of_function(asynchronous, generator)
            return ""
        if asynchronous or generator or accessor:
            self.fail("expected '('")
        if of_class:
            if self.at("="):
                state = self.enter(False, False)
                self.assignment()
                self.leave(state)
            self.semicolon()
            return ""
        if self.at(":"):
            return self.assignment()
        if not plain:
            self.fail("expected ':'")
        if self.at("="):
            self.assignment()
            return "pc"
        return "=p"

    # Expressions.

    def sequence(self, no_in: bool = False) -> str:
        got = self.assignment(no_in)
        if "c" in got and not (no_in and (self.k[self.i] == "in" or self.word("of"))):
            self.fail("an initialiser in an object literal")
        while self.at(","):
            self.final(no_in)
            got = ""
        return got

    def final(self, no_in: bool = False) -> str:
        """An assignment expression whose value is used, so that nothing of it waits to become a pattern."""
        got = self.assignment(no_in)
        if "c" in got:
            self.fail("an initialiser in an object literal")
        return got

    def arrow_body(self, asynchronous: bool, no_in: bool, state: tuple) -> str:
        if self.nl[self.i]:
            self.fail("line end before '=>'")
        self.take("=>")
        if self.k[self.i] == "{":
            self.block()
        else:
            self.final(no_in)
        self.leave(state)
        return ""

    def assignment(self, no_in: bool = False) -> str:
        k = self.k[self.i]
        if k == "N":
            if self.k[self.i + 1] == "=>":
                state = self.enter(False, False)
                self.binding()
                return self.arrow_body(False, no_in, state)
            if self.t[self.i] == "async" and not self.nl[self.i + 1]:
                if self.k[self.i + 1] == "N" and self.k[self.i + 2] == "=>":
                    self.i += 1
                    state = self.enter(True, False)
                    self.binding()
                    return self.arrow_body(True, no_in, state)
                if self.k[self.i + 1] == "(" and self.k[self.close.get(self.i + 1, -2) + 1] == "=>":
                    self.i += 2
                    state = self.enter(True, False)
                    self.parameters(")")
                    return self.arrow_body(True, no_in, state)
        elif k == "(" and self.k[self.close.get(self.i, -2) + 1] == "=>":
            self.i += 1
            state = self.enter(False, False)
            self.parameters(")")
            return self.arrow_body(False, no_in, state)
        elif k == "yield":
            if not self.generator:
                self.fail("'yield' outside a generator")
            self.i += 1
            if not self.nl[self.i]:
                if self.at("*"):
                    self.final(no_in)
                elif self.k[self.i] not in (")", "]", "}", ",", ";", ":", "in", END) and not self.word("of"):
                    self.final(no_in)
            return ""
        got = self.binary(1, no_in)
        k = self.k[self.i]
        if k == "?":
            if "c" in got:
                self.fail("an initialiser in an object literal")
            self.i += 1
            self.final()
            self.take(":")
            self.final(no_in)
            return ""
        if k in ASSIGN:
            if "=" not in got and not (k == "=" and "p" in got):
                self.fail("an invalid target of an assignment")
            self.i += 1
            self.final(no_in)
            return "a"
        return got

    def binary(self, least: int, no_in: bool) -> str:
        if self.k[self.i] == "P" and self.k[self.i + 1] == "in":
            self.i += 1
            got = ""
        else:
            got = self.unary()
        while True:
            k = self.k[self.i]
            power = BINARY.get(k, 0)
            if not power or power < least or (no_in and k == "in"):
                return got
            if "c" in got:
                self.fail("an initialiser in an object literal")
            if k == "**" and got == "u":
                self.fail("a unary operator before '**'")
            self.i += 1
            right = self.binary(power if k == "**" else power + 1, no_in)
            if "c" in right:
                self.fail("an initialiser in an object literal")
            if k == "??" and "l" in (got, right):
                self.fail("'??' mixed with '||' or '&&'")
            got = "l" if k in ("||", "&&") else ""

    def unary(self) -> str:
        k = self.k[self.i]
        if k in ("!", "-", "+", "~", "typeof", "void", "delete"):
            self.i += 1
            bare = k == "delete" and self.k[self.i] == "N" and self.k[self.i + 1] not in (".", "[", "(", "?.", "T")
            self.unary()
            if bare:
                self.fail("'delete' of a name")
            return "u"
        if k == "await":
            if self.function and not self.asynchronous:
                self.fail("'await' outside an async function")
            self.i += 1
            self.unary()
            return "u"
        if k in ("++", "--"):
            self.i += 1
            if "=" not in self.unary():
                self.fail("an invalid target of an increment")
            return ""
        got = self.left_hand()
        k = self.k[self.i]
        if k in ("++", "--") and not self.nl[self.i]:
            if "=" not in got:
                self.fail("an invalid target of an increment")
            self.i += 1
            return ""
        return got

    def arguments(self) -> None:
        while self.k[self.i] != ")":
            self.at("...")
            self.final()
            if not self.at(","):
                break
        self.take(")")

    def new(self) -> None:
        """``new`` with its own arguments, if it has any."""
        self.take("new")
        if self.at("."):
            if not (self.word("target") and self.function):
                self.fail("'new.target' outside a function")
            self.i += 1
            return
        if self.k[self.i] == "new":
            self.new()
        else:
            if self.k[self.i] == "import" and self.k[self.i + 1] == "(":
                self.fail("'new' of an import")
            self.atom()
        while True:
            k = self.k[self.i]
            if k == ".":
                self.i += 1
                self.dot_name()
            elif k == "[":
                self.i += 1
                self.sequence()
                self.take("]")
            elif k == "T":
                self.i += 1
            else:
                break
        if self.at("("):
            self.arguments()

    def dot_name(self) -> None:
        k = self.k[self.i]
        if k not in ("N", "P") and k not in RESERVED:
            self.fail(f"expected a property name, found {self.t[self.i] or 'the end'!r}")
        self.i += 1

    def left_hand(self) -> str:
        if self.k[self.i] == "new":
            self.new()
            got = ""
        else:
            got = self.atom()
        optional = False
        while True:
            k = self.k[self.i]
            if k == ".":
                self.i += 1
                self.dot_name()
                got = "" if optional else "=p"
            elif k == "?.":
                self.i += 1
                optional = True
                if self.at("("):
                    self.arguments()
                elif self.at("["):
                    self.sequence()
                    self.take("]")
                else:
                    self.dot_name()
                got = ""
            elif k == "[":
                self.i += 1
                self.sequence()
                self.take("]")
                got = "" if optional else "=p"
            elif k == "(":
                self.i += 1
                self.arguments()
                got = ""
            elif k == "T":
                if optional:
                    self.fail("a template in an optional chain")
                self.i += 1
                got = ""
            else:
                return got

    def atom(self) -> str:
        k = self.k[self.i]
        if k == "N":
            if self.t[self.i] == "async" and self.k[self.i + 1] == "function" and not self.nl[self.i + 1]:
                self.functions(False)
                return ""
            self.i += 1
            return "" if self.t[self.i - 1] in ("eval", "arguments") else "=p"
        if k in ("0", "S", "T", "R", "this", "null", "true", "false"):
            self.i += 1
            return ""
        if k == "(":
            self.i += 1
            got = self.sequence()
            self.take(")")
            return "=p" if "=" in got else ""
        if k == "[":
            self.i += 1
            ok, cover = True, False
            while self.k[self.i] != "]":
                if self.at(","):
                    continue
                rest = self.at("...")
                got = self.assignment()
                ok &= "=" in got or "p" in got or ("a" in got and not rest)
                cover |= "c" in got
                if self.k[self.i] != "]":
                    self.take(",")
                    ok &= not rest
            self.i += 1
            return "pc" if cover and ok else "p" if ok else ""
        if k == "{":
            self.i += 1
            ok, cover = True, False
            while self.k[self.i] != "}":
                if self.at("..."):
                    got = self.assignment()
                    ok &= "=" in got
                else:
                    got = self.member(False)
                    ok &= "=" in got or "p" in got or "a" in got
                    cover |= "c" in got
                if not self.at(","):
                    break
            self.take("}")
            return "pc" if cover and ok else "p" if ok else ""
        if k == "function":
            self.functions(False)
            return ""
        if k in ("class", "@"):
            self.decorators()
            self.classes(False)
            return ""
        if k == "import":
            self.i += 1
            if self.at("("):
                self.final()
                if self.at(",") and self.k[self.i] != ")":
                    self.final()
                    self.at(",")
                self.take(")")
                return ""
            self.take(".")
            if not self.word("meta"):
                self.fail("expected 'meta'")
            self.i += 1
            return ""
        if k == "super":
            if self.k[self.i + 1] not in ("(", ".", "["):
                self.fail("'super' alone")
            self.i += 1
            return ""
        self.fail(f"unexpected {self.t[self.i] or 'end'!r}")
        return ""


def check(source: str) -> list[Fault]:
    """All syntax errors of a module, in order; an empty list if it is valid."""
    text = source[1:] if source.startswith("\ufeff") else source
    if text.startswith("#!"):
        text = "//" + text
    return Parser(*_tokens(text)).program()
