import ast
import pathlib

ROOT = pathlib.Path(__file__).resolve().parent.parent


def test_queries_and_statements():
    import __spark_entry__ as e

    names, sql = e.queries(), e.oracle_sql()
    assert set(sql) <= set(names) and len(sql) > 80


def test_nothing_else_imports_the_training_data_package():
    for p in (ROOT / "lodestrata").rglob("*.py"):
        if "llm" in p.relative_to(ROOT).parts:
            continue
        for node in ast.walk(ast.parse(p.read_text())):
            if isinstance(node, ast.ImportFrom):
                assert not (node.module or "").startswith("lodestrata.llm"), p
            elif isinstance(node, ast.Import):
                assert not any(a.name.startswith("lodestrata.llm") for a in node.names), p
