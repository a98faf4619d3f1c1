import ast
import json
import random
import tomllib
import warnings
import xml.parsers.expat

import pytest

from lodestrata.llm.syntax import data, javascript, python
from lodestrata.llm.unparsed import acceptance, faults, parsed, unparsed

warnings.simplefilter("ignore")

PYTHON = '''import os
@dec(1)
async def f(a, /, b: int = 1, *args, c, d=2, **kw) -> dict[str, int]:
    """doc"""
    async with x as y, z:
        return {k: v for k, v in y.items() if (n := len(k)) > 1}
    match a:
        case [1, *rest] | {"k": Point(x=0)} if rest:
            yield
        case _:
            pass
try:
    print(f"{a!r:>{w}} {{}} {d["k"]}", 0x_ff, 1e3j, lambda *a, k=1: (a, k))
except* (A, B) as e:
    raise E from e
else:
    del a[1:2, ...], b
finally:
    x: int = 1 if a else [*b]
    y = z = x
'''


def python_ok(t):
    try:
        compile(t, "x", "exec", flags=ast.PyCF_ONLY_AST, dont_inherit=True)
        return True
    except (SyntaxError, ValueError):
        return False


def toml_ok(t):
    try:
        tomllib.loads(t)
        return True
    except tomllib.TOMLDecodeError:
        return False


def json_ok(t):
    try:
        json.loads(t, parse_constant=lambda c: 1 / 0)
        return True
    except (ValueError, ZeroDivisionError):
        return False


def xml_ok(t):
    try:
        xml.parsers.expat.ParserCreate().Parse(t.encode(), True)
        return True
    except xml.parsers.expat.ExpatError:
        return False


CASES = [
    (python.check, python_ok, PYTHON),
    (data.check_json, json_ok, '{"a": [1, -2.5e+3, true, null, {"b": "x\\u00e9\\n"}], "c": {}}'),
    (data.check_toml, toml_ok, 'a = 1\n[t."x y"]\nb = [1, 2, # c\n 3]\nd = 2024-02-29T10:00:00Z\n[[l]]\ne = {x.y = \'\', z = """q\n"""}\n[[l]]\nf = 0x1F\n'),
    (data.check_xml, xml_ok, '<?xml version="1.0"?>\n<!-- c -->\n<a b="1" c=\'&lt;\'><d/>t &#65; &amp;<![CDATA[<x>]]></a>\n'),
]


@pytest.mark.parametrize("check,ok,text", CASES)
def test_valid_text_and_mutations_agree_with_the_language(check, ok, text):
    assert ok(text) and not check(text)
    rng = random.Random(5)
    for _ in range(400):
        s = list(text)
        k = rng.randrange(len(s))
        if rng.random() < 0.5:
            del s[k : k + rng.choice((1, 1, 3))]
        else:
            s.insert(k, rng.choice("\"'{}[]()<>=,:;&#\\\n -+.01axf!?*@$%\t"))
        t = "".join(s)
        if t.startswith('<?xml version="1.0"?>') or check is not data.check_xml:
            assert ok(t) == (not check(t)), repr(t)


@pytest.mark.parametrize("text", ["", "\n\n", "# only a comment", "x = 1\r\ny = 2\r\n", "if x:\n\tpass\n", "\ufeffx = 1"])
def test_valid_python(text):
    assert python.check(text) == []


def test_python_keeps_every_error_and_the_first_cause():
    found = python.check("x = (\ndef f(:\n    pass\nprint 'a'\ny = 1\n<<<<<<< HEAD\n")
    assert [f.line for f in found] == [1, 2, 4, 6] and "never closed" in found[0].cause


GOOD = ["", "a\nb", "({a=1}={})", "x = a / b / c", "x = /re[/]g/.test(s)", "async()=>{await x}", "`a${b+`c${d}`}e`", "export {a as b, c as default}", "do x++\nwhile(x<5) y", "a?.b?.[c]?.(d)", "for await(const a of b){}", "a\n++b", "class A{static #x=1;get y(){return this.#x} async *g(){yield* z}}", "({a:[b]}=c)", "label: for(;;){break label}"]
BAD = ["let x y", "const a", "return", "if(", "({a=1})", "1=2", "break", '"abc', "`abc", "<<<<<<< HEAD", "export {if}", "-x**2", "a??b||c", "function f(){await x}", "010", "delete x", "a b", "def f(): pass", '{"a":1,"b":2}', "foo?.a=1", "try{}", "{", "throw\nx"]


@pytest.mark.parametrize("text", GOOD)
def test_valid_module(text):
    assert javascript.check(text) == []


@pytest.mark.parametrize("text", BAD)
def test_invalid_module(text):
    assert javascript.check(text)


def test_javascript_goes_on_after_an_error():
    assert [f.line for f in javascript.check("let x y;\nlet ok = 1;\nconst b;\n")] == [1, 3]


def test_deep_nesting_is_read_on_a_larger_stack():
    assert faults("js", "(" * 3000 + "1" + ")" * 3000) == []
    assert faults("json", "[" * 50_000 + "]" * 50_000) == []


def test_table(spark):
    rows = [
        ("r", "a.py", "x = 1", 5), ("r", "a.py", "x = 1", 5), ("r", "b.py", "x = (", 5), ("r", "b.py", "x = (", 5), ("r", "c.json", "", 5), ("r", "d.md", "{", 5), (None, "e.py", "(", 5),
        ("r", "f.py", None, 5), ("r", "g.toml", "a = 1\na = 2", 5), ("q", "b.PY", "y = )", 5),
    ]
    df = spark.createDataFrame([(*r, "x") for r in rows], "repo string, path string, text string, n int, errors string").selectExpr("repo", "path", "text", "timestamp_seconds(n) as scanned_at", "errors")
    assert sorted(map(tuple, unparsed(df).collect())) == [("q", "b.PY"), ("r", "b.py"), ("r", "c.json"), ("r", "g.toml")]
    rate = {(r.repo, r.language): (r.files, r.invalid) for r in acceptance(df).collect()}
    assert rate[("r", "python")] == (3, 1) and rate[("r", "json")] == (1, 1)
    assert parsed(df.limit(0)).count() == 0


def test_early_errors_of_modules():
    from lodestrata.llm.unparsed import faults

    for text in ("x = /(/;", "x = /a)/;", "x = /a/gg", "x = /a/q", "x = /+a/", "x = /(?y)a/", "export default 1; export default 2", "a: a: for (;;) {}"):
        assert len(faults("js", text)) == 1, text
    for text in (r"x = /(?<n>a)[(]\(+?(?:b|c)*$/giu", r"y = /[^\]]+/", "z = /a{2,}/v", "a: for (;;) {} a: for (;;) {}", "x = a / b / c", "x = /(?i:a)|b/"):
        assert not faults("js", text), text


def test_deep_nesting():
    from lodestrata.llm.unparsed import faults

    assert not faults("py", "x = " + "(" * 200 + ")" * 200) and [f.cause for f in faults("py", "x = " + "(" * 201 + ")" * 201)] == ["too many nested brackets"]
    assert not faults("json", "[" * 30_000 + "]" * 30_000) and faults("json", "[" * 30_000 + "]" * 29_999)
