"""Credentials embedded in source code and configuration.

Configuration and code are parsed into key paths with the places of their values; a value counts if its key names
something secret and it looks like a literal, or if its own shape is that of an issued credential.  Redactions are
spliced into the original bytes, so that everything round them stays as it was.
"""

from __future__ import annotations

import base64
import binascii
import math
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.llm import configuration

MASK = b"REDACTED"
#: Rule of a value that stands without quotes where its mask needs some.
NUMBER = "number of a key path"


class Credential(NamedTuple):
    """Where a credential stands in a text (characters), by which rule, and under which key path."""

    start: int
    end: int
    rule: str
    key: str
    parts: tuple[tuple[int, int], ...]


# Names of keys, by their words.
_ALONE = frozenset("password passwd pwd pw pass passphrase passcode passwort kennwort contrasena contraseña senha clave parola motdepasse secret secrets bearer apikey credential credentials clientsecret webhooksecret refreshtoken accesstoken authtoken apitoken accesskey secretkey privatekey signingkey servicekey deploykey xauth pgpassword".split())
_FIRST = frozenset("api access secret private deploy service signing sign encryption master account ssh auth storage license shared app client consumer session".split())
_SECOND = frozenset("key keys salt auth".split())
_TOKENS = frozenset("auth access refresh api bearer security csrf github gitlab slack bot npm pypi deploy service webhook".split())
_WEAK = frozenset("token tokens key keys auth login salt credentialref".split())
_NO_SECRET_LAST = frozenset("id ids ref refs sha256 sha1 sha512 md5 checksum etag hint url uri path file".split())
#: Under a weak name: what is meant to be seen; names whose hexadecimal values may be secret, and words that say they are sums or ids.
_PUBLIC = frozenset("public pub cert certificate fingerprint".split())
_HEX_KEYS = frozenset("token tokens key keys".split())
_IDS = frozenset("id ids uid uuid guid ref refs sha sha1 sha256 sha512 md5 crc checksum checksums sum hash hashes digest etag hint commit revision rev version cache idempotency dedup primary foreign partition sort object content index".split())
_SUMMED = re.compile(r"(?i)checksum|\bsha-?(?:1|256|384|512)?\b|\bmd5\b|digest|fingerprint|\bhash\b|\bids?\b")
#: Keys whose value names what a sibling holds, and those siblings.
_NAMING = frozenset("name key id property variable var".split())
_VALUED = frozenset("value val data literal default content string".split())
_GENERIC = frozenset("value default data content text string literal val".split())
#: Words run together, as in capitals: what they end with, and what may stand before a shorter end.
_ENDS = ("password", "passwd", "passphrase", "passcode", "passwort", "kennwort", "contrasena", "secret", "credential", "credentials", "apikey")
_SHORT_ENDS = ("key", "token", "salt", "auth", "pass", "pw", "pwd")
_BEFORE = _FIRST | _TOKENS | frozenset("smtp db database admin root user login replica x mail ftp ldap redis mysql pg".split())
_CAMEL = re.compile(r"[A-Z]+(?![a-zà-ÿ])|[A-ZÀ-Þ]?[a-zà-ÿ]+|[0-9]+")


#: Words of keys beside secrets that tell about them; moments.
_TOLD = frozenset("type kind title description desc format pattern label host hostname server user username login email mail name region zone endpoint database db account role roles scope scopes issuer audience algorithm alg min max length version date time created updated rotated expires expiry issued owner comment note notes help message example policy".split())
_MOMENT = re.compile(r"\d{4}-\d\d-\d\d(?:[T ][\d:.]+(?:Z|[+-][\d:]+)?)?$")


def _words(key: str) -> list[str]:
    words = [w.lower() for w in _CAMEL.findall(key)]
    while words and words[-1].isdigit():
        words.pop()
    return words


def _is_password(word: str) -> bool:
    return any(w in _ALONE or w.endswith(_ENDS) for w in (word, word.removesuffix("s")))


def key_strength(key: str) -> int:
    """2: the name of a secret, 1: may be one, 0: none."""
    words = _words(key)
    if not words or words[-1] in _NO_SECRET_LAST and len(words) > 1 and words[-1] in ("ref", "refs", "url", "uri", "path", "file", "hint"):
        return 0
    if any(map(_is_password, words)) or any(w.endswith(e) and w[: -len(e)] in _BEFORE for w in words for e in _SHORT_ENDS):
        return 2
    for a, b in zip(words, words[1:], strict=False):
        if (a in _FIRST and b in _SECOND) or (a in _TOKENS and b in ("token", "tokens")) or (a == "x" and b == "auth"):
            return 2
    return 1 if any(w in _WEAK for w in words) else 0


# Shapes of values.

#: Forms in which providers issue credentials.
SHAPES = {
    "aws key id": r"(?<![A-Za-z0-9])(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9])",
    "git host token": r"(?<![A-Za-z0-9_])(?:gh[pousr]_[A-Za-z0-9]{36,}|github_pat_[A-Za-z0-9_]{22,}|glpat-[A-Za-z0-9_-]{20,})(?![A-Za-z0-9])",
    "payment key": r"(?<![A-Za-z0-9_])[rs]k_live_[A-Za-z0-9]{16,}(?![A-Za-z0-9])",
    "cloud key": r"(?<![A-Za-z0-9_])AIza[A-Za-z0-9_-]{35}(?![A-Za-z0-9_-])",
    "chat token": r"(?<![A-Za-z0-9_])xox[abeoprs]-[A-Za-z0-9-]{10,}",
    "package token": r"(?<![A-Za-z0-9_])(?:npm_[A-Za-z0-9]{36}|pypi-[A-Za-z0-9_-]{40,}|hf_[A-Za-z0-9]{30,}|dop_v1_[a-f0-9]{64}|SG\.[A-Za-z0-9_-]{16,}\.[A-Za-z0-9_-]{16,}|sk-[A-Za-z0-9_-]{20,})(?![A-Za-z0-9])",
    "signed token": r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}",
}
_SHAPE = re.compile("|".join(f"(?P<s{k}>{p})" for k, p in enumerate(SHAPES.values())))
_SHAPE_NAMES = list(SHAPES)
_PRIVATE = re.compile(r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")
_PRIVATE_END = re.compile(r"-----END (?:[A-Z0-9]+ )*(?:PRIVATE KEY(?: BLOCK)?)?-----")
_BODY = re.compile(r"(?:\s|\\[nr]|[#*/;>+\"',|])*((?:(?:Proc-Type|DEK-Info|Version|Comment)[^\n]*\n\s*)*)[A-Za-z0-9+/=]{16,}")
_URL = re.compile(r"\b[A-Za-z][A-Za-z0-9+.-]{1,20}://([^\s:/@\"'<>`]*):([^\s/@\"'`<>]+|<[^<>\s]*>)@(?=[\w\[$])")
_HEADER = re.compile(r"(?i)\b(?:proxy-)?(authorization|x-[a-z-]*(?:key|token|auth|secret)|api-key|apikey)[\"']?\s*[:=,]\s*[\"'`]?\s*(?:(bearer|basic|token|apikey|digest)\s+)?([A-Za-z0-9+/=_.~!@#%^&*-]{8,})")
_PLACEHOLDER = re.compile(
    r"(?i)\s*$|<[^>]*>$|\[[^\]]*\]$|.*\*{3,}|x{3,}$|.*\$[{(]|\$\w+$|.*\{\{|\{\w*\}$|%\w+%$|.*%\(|(?:env|vault|ssm|secret|secrets|arn|op|keyring|file|ref)[:/]|os\.environ|process\.env|.*getenv"
    r"|(?:todo|dummy|change[-_ ]?(?:me|it|this)|example|placeholder|none|null|nil|undefined|true|false|(?:is)?redacted|masked|hidden|fixme|tbd|unset|n/?a|\.{2,}|password|passwd|secret|token|api[-_]?key|default|string|sample|fake|mock|test|optional|required|empty|removed)[.!]*$"
    r"|.*\b(?:your|my|the|insert|enter|replace)[-_ ]|.*example(?:key)?$|.*redacted|.*\.\.\."
)
#: Values that tell their own kind: checksums with the name of the method, embedded data.
_DIGESTED = re.compile(r"(?i)(?:sha(?:1|256|384|512)|md5)[-:]|data:")
_UUID = re.compile(r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$")
_HEX = re.compile(r"(?:[0-9a-f]+|[0-9A-F]+)$")
_WORDS = re.compile(r"[a-z]+(?:-[a-z]+){2,}-?[0-9]+$")
_PATTERN = re.compile(r"\[[^\]]*-[^\]]*\]|\\[dwsb]|\{\d+(?:,\d*)?\}|\(\?|\.[*+]|\^|\$$")
_IDENTIFIER = re.compile(r"[A-Za-z_][A-Za-z_]*(?:[.\[\]= -][A-Za-z_]+)*\]?$")


def placeholder(v: str) -> bool:
    return bool(_PLACEHOLDER.match(v))


def entropy(v: str) -> float:
    n = len(v)
    return -sum(c / n * math.log2(c / n) for c in Counter(v).values())


def random_like(v: str, hexes: bool = False) -> bool:
    """Whether a value looks drawn at random (or a chosen password), not written as a word, a path or an id."""
    if len(v) < 8 or any(c.isspace() for c in v) or _UUID.match(v) or _PATTERN.search(v):
        return False
    if _HEX.match(v):
        return hexes and len(v) >= 16 and any(c.isalpha() for c in v)
    if _WORDS.match(v):
        return hexes
    digits, upper, lower = (any(map(f, v)) for f in (str.isdigit, str.isupper, str.islower))
    special = any(not c.isalnum() and c not in "_-./" for c in v)
    if digits + upper + lower + special < 3 or entropy(v) < 2.7:
        return False
    # Names of several words with a number at the end are no secrets.
    name = v.rstrip("0123456789")
    if special or len(v) - len(name) > 3 or any(map(str.isdigit, name)):
        return True
    return len(name) < 4 * len(_CAMEL.findall(name))


def literal_counts(key: str, value: str, context: str = "") -> bool:
    """Whether the literal under a key is a credential; ``context`` is the rest of its line."""
    strength = key_strength(key)
    if not strength or placeholder(value) or len(value) < 5 or _DIGESTED.match(value):
        return False
    if "://" in value or value.isdigit() and not (len(value) >= 6 and _is_password(_words(key)[-1])):
        return False
    if strength == 1:
        named = [w.lower() for w in _CAMEL.findall(key)]
        names = set(named)
        # What is public, and what names a sum, an id or a state of a token.
        if names & _PUBLIC or named[-1] in _IDS:
            return False
        if _HEX.match(value):
            return bool(names & _HEX_KEYS) and not names & _IDS and not _SUMMED.search(context) and random_like(value, True)
        return random_like(value)
    if any(c.isspace() for c in value) or value.startswith("-----"):
        return False
    if value[0] in "./" and "/" in value and not random_like(value.replace("/", ""), True):
        return False
    words = [w.lower() for w in _CAMEL.findall(key)]
    while words and words[-1].isdigit():
        words.pop()
    if words and words[-1] in _NO_SECRET_LAST and (_UUID.match(value) or _HEX.match(value)):
        return False
    if _PATTERN.search(value) and not re.search(r"[0-9].*[0-9]", re.sub(r"\[[^\]]*\]|\{[^}]*\}", "", value)):
        return False
    # The name of a field, a variable or a selector.
    if _IDENTIFIER.match(value) and (key_strength(value) or re.search(r"(?i)pass|secret|token|key", value)) and not re.search(r"[0-9]", value) and (value.islower() or value.isupper()):
        return False
    return True


# Values under keys.

_LITERAL = re.compile(configuration.LITERAL, re.S)
_KEYED = re.compile(r"[\"'`]?([A-Za-zÀ-ÿ_][\wÀ-ÿ.-]*)[\"'`]?\]?\s*(?::\s*[A-Za-z_][\w.\[\]| ]*(?==))?\s*(?::=|=>|=(?![=>~])|:(?![:/=]))\s*(?:await\s+|str\(|bytes\(|String\(|Secret(?:Str)?\()?([(\[]\s*(?:(?:#|//)[^\n]*\n\s*)*)?(?=[rRbBuU]{0,2}[\"'`])")
_BEFORE_VALUE = re.compile(r"(?:[\s(\[]|(?<=\n)[ \t]*(?:#|//)[^\n]*\n)*")
_DEFAULT = re.compile(r"(?:environ\.get|getenv|env\.get|config\.get|settings\.get|\.get|env)\(\s*[\"']([\w.-]+)[\"']\s*,\s*(?:default\s*=\s*)?(?=[rRbBuU]{0,2}[\"'`])|(?:process\.env|import\.meta\.env|os\.environ|ENV)(?:\.([A-Za-z_]\w*)|\[\s*[\"'](\w+)[\"']\s*\])\s*\)?\s*(?:\|\||\?\?|or)\s*(?=[\"'`])")
_SHELL_DEFAULT = re.compile(r"\$\{([A-Za-z_]\w*):?-([^}$\s\"']+)\}")
_BARE = re.compile(r"^[ \t]*(?:export[ \t]+|set[ \t]+|ENV[ \t]+|-[ \t]+)?([A-Za-z_][\w.]*)=([^\s\"'`;#(){}<>]+)[ \t]*(?:#.*)?$")
_LOOSE = re.compile(r"^[ \t]*-?[ \t]*([A-Za-z_][\w.-]*)[ \t]*[:=][ \t]*([^\s\"'`#(){}<>&*!|\[]\S*)[ \t]*(?:[#;].*)?$")
_SQL = re.compile(r"(?i)\b(?:IDENTIFIED\s+(?:WITH\s+\w+\s+)?BY|(?:WITH\s+|ENCRYPTED\s+)?PASSWORD)\s+(?:PASSWORD\s+)?'((?:[^']|'')+)'")
_CONNECTION = re.compile(r"(?i)(?:^|[;\"'\s])(pwd|password|accountkey|sharedaccesskey|sharedsecret)\s*=\s*([^;\"'\s]+)(?=;|[\"'])")
_OPTION = re.compile(r"(?:^|\s)(?:--(password|passwd|pass|token|api-key|secret|auth-token|access-token|secret-key)(?:=|\s+)([^\s\"'$<-][^\s\"']*)|(?:-u|--user)\s+[\"']?[\w.@-]+:([^\s\"'$<]+)|sshpass\s+-p\s*[\"']?([^\s\"'$<]+)|mysql\b[^\n|;]*?\s-p([^\s\"'$<]+))")
_PROSE = re.compile(r"(?i)\b(?:login|password|passwd|passphrase|pw|pwd|pass|token|key|secret|credential|kennwort|contrasena)s?\b(?:[^:=\n]{0,40}[:=])?\s*(?:is|was)?\s*[`\"']?([^\s`\"'<>]{6,})[`\"']?\s*(?:\*/|-->)?\s*$")
_LOGIN = re.compile(r"(?i)\b(?:log(?:ged|ging|s)?|sign(?:ed|ing|s)?)[- ]?(?:in|on)\b[^\n]*?\bwith\s+(?:the\s+)?(?:pass(?:word|phrase)?\s+)?[`\"']([^\s`\"']{5,})[`\"']")
_ENCODED = re.compile(r"\b[Bb]asic\s+([A-Za-z0-9+/]{8,}={0,2})(?![A-Za-z0-9+/=])")
_HEXED = re.compile(r"(?:fromhex|unhexlify|a2b_hex|Buffer\.from|decodeHex|hex\.DecodeString)\(\s*[\"']([0-9A-Fa-f]{32,})[\"']")
_SIGNS = re.compile(r"(?i)\b(?:signs?|signing|encrypts?|decrypts?|hmac|secret|private|unlocks?|authenticates?|key)\b|secret|hmac|_key|key_")
_COMMENT = re.compile(r"^\s*(?:#|//|--|/?\*|<!--|;|>|-\s)|(?:\s#|\s//|\s--)\s")
_CALL_TOKEN = re.compile(configuration.LITERAL + r"|[()]", re.S)
_POSITIONS = re.compile(r"(?:#|//|--)\s*([\w ]+(?:,[\w ]+)+)\s*$")
_LOGINS = tuple(a + b + c for a in ("log", "logged", "logging", "logs", "sign", "signed", "signing", "signs") for b in ("", " ", "-") for c in ("in", "on"))
#: A line is parsed if it holds one of these (in any case); all rules below need one.
_TRIGGERS = ("pass", "pwd", "pw", "secret", "token", "key", "auth", "bearer", "kennwort", "contrase", "senha", "clave", "parola", "credential", "salt", *_LOGINS, "basic", "fromhex", "unhexlify", "a2b_hex", "buffer.from", "decodehex", "decodestring", "identified", "mysql", "-u ", "-u\t", "--user")
_ISSUED = ("AKIA", "ASIA", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "github_pat_", "glpat-", "k_live_", "AIza", "xox", "npm_", "pypi-", "hf_", "dop_v1_", "SG.", "sk-", "eyJ")


def _chain(text: str, at: int, group: bool) -> list[tuple[int, int]]:
    """Places of a literal and those it is joined with."""
    parts: list[tuple[int, int]] = []
    while m := _LITERAL.match(text, at):
        parts.append(configuration.body(m))
        at = m.end()
        gap = re.compile(r"(?:[ \t]*[+.]?[ \t]*\\?\n?[ \t]*)" if not group else r"\s*[+.]?\s*").match(text, at)
        joined = gap[0]
        if "\n" in joined and not group and not re.search(r"[+\\]", joined):
            break
        at = gap.end()
    return parts


def _named(text: str, found: list[configuration.Entry]) -> Iterator[tuple[tuple[str, ...], str, configuration.Entry]]:
    """(key path, key, entry) of values; one under a generic key goes by its sibling's name or by the key above, whichever tells more."""
    names = {x.mapping: text[x.start : x.end] for x in found if x.path and x.path[-1].lower() in _NAMING}
    for x in found:
        if not x.path:
            continue
        key = x.path[-2] if len(x.path) > 1 and x.path[-1].lower() in _GENERIC else x.path[-1]
        if x.path[-1].lower() in _VALUED and x.mapping in names and key_strength(names[x.mapping]) > key_strength(key):
            key = names[x.mapping]
        yield x.path, key, x


def path_counts(path: tuple[str, ...], key: str, value: str, number: bool, context: str) -> bool:
    """Whether a value of a configuration is a credential: by its own key, or as random text under a key that holds secrets."""
    if number and not value.isdigit():
        return False
    if literal_counts(key, value, context):
        return True
    leaf = _words(path[-1])
    if number or key_strength(key) or not leaf or any(w in _TOLD for w in leaf) or leaf[-1] in _IDS or leaf[-1] in _NO_SECRET_LAST:
        return False
    above = max((k for k, p in enumerate(path[:-1]) if key_strength(p) == 2), default=-1)
    return above >= 0 and not placeholder(value) and not _DIGESTED.match(value) and "://" not in value and not _MOMENT.match(value) and random_like(value, True)


def _call(head: str) -> int:
    """Where the call that ends ``head`` opens; 0 if it opens on an earlier line."""
    opens: list[int] = []
    at = 0
    for m in _CALL_TOKEN.finditer(head):
        if m[0] == "(":
            opens.append(m.start())
        elif m[0] == ")":
            at = opens.pop() if opens else 0
    return at


def _arguments(line: str) -> list[tuple[int, int, str]]:
    """(start, end, name) of literals in a call whose trailing comment names its arguments, as in f("a", "b")  # user, password."""
    at = max(line.rfind("#"), line.rfind("//"), line.rfind("--"))
    m = _POSITIONS.match(line, at) if at > 0 else None
    if not m:
        return []
    head = line[:at].rstrip().removesuffix(";").rstrip()
    if not head.endswith(")"):
        return []
    names = [x.strip() for x in m[1].split(",")]
    found = [configuration.body(x) for x in _LITERAL.finditer(head, _call(head))]
    return [(s, e, n) for (s, e), n in zip(found[-len(names) :], names, strict=False)] if len(found) >= len(names) else []


def _basic(v: str) -> bool:
    try:
        return b":" in base64.b64decode(v + "=" * (-len(v) % 4), validate=True)
    except (binascii.Error, ValueError):
        return False


def find(text: str, extension: str = "") -> list[Credential]:
    """The credentials of a text, in order, none inside another."""
    found: list[Credential] = []

    def add(parts: list[tuple[int, int]], rule: str, key: str = "") -> None:
        found.append(Credential(parts[0][0], parts[-1][1], rule, key, tuple(parts)))

    if "-----BEGIN" in text:
        for m in _PRIVATE.finditer(text):
            body = _BODY.match(text, m.end())
            if not body and not text[m.end() :].strip(" \t\r\n\"'`"):
                found.append(Credential(m.start(), len(text), "private key", "", ((m.end(), m.end()),)))  # the rest is in the next part
            elif body:
                end = _PRIVATE_END.search(text, body.end())
                z = end.start() if end else len(text)
                if not end:
                    quote = re.compile(r"[\"'`]").search(text, body.end())
                    z = quote.start() if quote else z
                found.append(Credential(m.start(), z, "private key", "", ((m.end(), z),)))
    for m in _SHAPE.finditer(text) if any(x in text for x in _ISSUED) else ():
        v = m[0]
        if not v.upper().endswith("EXAMPLE") and not _PATTERN.search(text[m.start() : m.end() + 2]):
            add([m.span()], _SHAPE_NAMES[int(m.lastgroup[1:])])
    if "://" in text:
        for m in _URL.finditer(text):
            if not placeholder(m[2]) and not re.search(r"[${}]|^%", m[2]):
                add([m.span(2)], "login in an address", m[1])
    low = text.lower()
    if len(low) != len(text):
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    starts: set[int] = set()
    for word in _TRIGGERS:
        at = low.find(word)
        while at >= 0:
            starts.add(low.rfind("\n", 0, at) + 1)
            end = low.find("\n", at)
            if end < 0:
                break
            at = low.find(word, end)
    if not starts:
        return _disjoint(found)
    pairs: list[tuple[str, list[tuple[int, int]]]] = []
    held: list[tuple[tuple[int, int], str, str]] = []
    for path, key, x in _named(text, configuration.entries(text, extension)):
        value = text[x.start : x.end]
        begin, end = text.rfind("\n", 0, x.start) + 1, text.find("\n", x.end)
        if path_counts(path, key, value, x.number, text[begin : x.start] + " " + text[x.end : end if end >= 0 else len(text)]):
            held.append(((x.start, x.end), NUMBER if x.number and extension in ("json", "toml") else "value of a key path", ".".join(path)))
    loose = extension in ("env", "ini", "cfg", "conf", "properties", "yaml", "yml")
    prose = extension in ("md", "txt", "rst")
    for start in sorted(starts):
        seen = text.find("\n", start)
        seen = len(text) if seen < 0 else seen
        line = text[start:seen].rstrip("\r")
        if '"' in line or "'" in line or "`" in line or "(" in line or line.endswith(("[", "=", ":")):
            # A value may begin on a later line, after blanks, comments and an opening bracket.
            for m in _KEYED.finditer(text, start, _BEFORE_VALUE.match(text, seen).end() + 4):
                if m.start() > seen:
                    break
                if key_strength(m[1]):
                    parts = _chain(text, m.end(), bool(m[2]))
                    if parts:
                        pairs.append((m[1], parts))
            for m in _DEFAULT.finditer(text, start, seen):
                parts = _chain(text, m.end(), False)
                if parts:
                    pairs.append((m[1] or m[2] or m[3], parts))
        for m in _HEADER.finditer(line):
            v = m[3]
            if not placeholder(v) and (_basic(v) if (m[2] or "").lower() == "basic" else random_like(v, True) or bool(m[2]) and len(v) >= 12):
                add([(start + m.start(3), start + m.end(3))], "header", m[1])
        for m in _ENCODED.finditer(line):
            if _basic(m[1]):
                add([(start + m.start(1), start + m.end(1))], "encoded login", "Basic")
        for m in _HEXED.finditer(line):
            if _SIGNS.search(line[: m.start()] + " " + line[m.end() :]):
                add([(start + m.start(1), start + m.end(1))], "key in bytes", "")
        m = _LOGIN.search(line)
        if m and not placeholder(m[1]) and not m[1].isalpha():
            add([(start + m.start(1), start + m.end(1))], "note", "login")
        for m in _SQL.finditer(line):
            if not placeholder(m[1]):
                add([(start + m.start(1), start + m.end(1))], "password in SQL", "IDENTIFIED BY")
        for m in _CONNECTION.finditer(line):
            if not placeholder(m[2]) and ";" in line:
                add([(start + m.start(2), start + m.end(2))], "connection string", m[1])
        for m in _SHELL_DEFAULT.finditer(line):
            pairs.append((m[1], [(start + m.start(2), start + m.end(2))]))
        m = _BARE.match(line) or (loose and _LOOSE.match(line)) or None
        if m:
            pairs.append((m[1], [(start + m.start(2), start + m.end(2))]))
        for m in _OPTION.finditer(line):
            g = next(k for k in (2, 3, 4, 5) if m.group(k))
            if not placeholder(m[g]):
                add([(start + m.start(g), start + m.end(g))], "command line", m[1] or "user")
        for s, e, name in _arguments(line):
            if literal_counts(name, line[s:e]):
                add([(start + s, start + e)], "argument", name)
        if prose or _COMMENT.search(line):
            m = _PROSE.search(line)
            if m and not placeholder(m[1]) and random_like(m[1], True):
                add([(start + m.start(1), start + m.end(1))], "note")
    for place, rule, path in held:
        add([place], rule, path)
    for key, parts in pairs:
        value = "".join(text[s:e] for s, e in parts)
        begin, end = text.rfind("\n", 0, parts[0][0]) + 1, text.find("\n", parts[-1][1])
        if literal_counts(key, value, text[begin : parts[0][0]] + " " + text[parts[-1][1] : end if end >= 0 else len(text)]):
            add(parts, "value of a key", key)
    return _disjoint(found)


def _disjoint(found: list[Credential]) -> list[Credential]:
    out: list[Credential] = []
    for c in sorted(found, key=lambda c: (c.start, -c.end)):
        if not out or c.start >= out[-1].end:
            out.append(c)
    return out


def redact(text: str, found: list[Credential]) -> str:
    """The text with every credential masked: masks are spliced into its bytes, everything else stays as it is."""
    at_byte = configuration.byte_places(text)
    data = text.encode("utf-8", "surrogatepass")
    cuts = sorted((s, e, k == 0, b'"' + MASK + b'"' if c.rule == NUMBER else MASK) for c in found for k, (s, e) in enumerate(c.parts))
    out, at = [], 0
    for s, e, first, mask in cuts:
        a, z = (s, e) if at_byte is None else (int(at_byte[s]), int(at_byte[e]))
        if a < at:
            continue
        key_lines = data[max(0, a - 5) : a] == b"-----" and b"\n" in data[a:z]
        out += [data[at:a], (b"\n" + mask + b"\n" if key_lines else mask) if first else b""]
        at = z
    return b"".join([*out, data[at:]]).decode("utf-8", "surrogatepass")


SCHEMA = "record_kind string, record_id string, n_credentials int, credentials array<struct<line_no: int, start_byte: int, end_byte: int, rule: string, key: string>>, redacted string"


def scan(records: DataFrame) -> DataFrame:
    """Records (record_kind, record_id, path, text) with at least one credential: where they are, and the text masked.

    Columns: record_kind, record_id, n_credentials, credentials (line_no from 1, bytes in the UTF-8 text, rule, key),
    redacted.  A null text has none; a repeated record gives its row again unless the caller drops repeats.
    """
    struct = pa.list_(pa.struct([("line_no", pa.int32()), ("start_byte", pa.int32()), ("end_byte", pa.int32()), ("rule", pa.string()), ("key", pa.string())]))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, listed, masked = [], [], []
            for k, (path, value) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3), strict=True)):
                text = value.as_py()
                found = find(text, (path or "").rsplit(".", 1)[-1].lower())
                if found:
                    keep.append(k)
                    places = configuration.byte_places(text)
                    rows_of, line, seen = [], 1, 0
                    for c in found:
                        line, seen = line + text.count("\n", seen, c.start), c.start
                        a, z = (c.start, c.end) if places is None else (int(places[c.start]), int(places[c.end]))
                        rows_of.append({"line_no": line, "start_byte": a, "end_byte": z, "rule": c.rule, "key": c.key})
                    listed.append(rows_of)
                    masked.append(redact(text, found))
            rows = batch.take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [rows.column(0), rows.column(1), pa.array([len(x) for x in listed], pa.int32()), pa.array(listed, struct), pa.array(masked, pa.string())],
                ["record_kind", "record_id", "n_credentials", "credentials", "redacted"],
            )

    return records.select("record_kind", "record_id", "path", "text").where(F.col("text").isNotNull()).mapInArrow(search, SCHEMA)


def records(chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """The texts of chunks and vector records in one table."""
    a = chunks.select(F.lit("chunk").alias("record_kind"), F.col("chunk_id").alias("record_id"), "path", "text")
    b = vectors.select(F.lit("vector").alias("record_kind"), F.col("vec_id").cast("string").alias("record_id"), "path", "text")
    return a.unionByName(b)


def lines(found: DataFrame) -> DataFrame:
    """(record_kind, record_id, line_no) of every line on which a credential starts, once."""
    return found.select("record_kind", "record_id", F.explode("credentials").alias("c")).select("record_kind", "record_id", F.col("c.line_no").alias("line_no")).distinct()


def redacted(found: DataFrame) -> DataFrame:
    """Masked texts, once per record and text."""
    return found.dropDuplicates(["record_kind", "record_id", "redacted"])
