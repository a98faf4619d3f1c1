"""Every training-data query on empty tables, and on tables with null rows and columns of clashing names."""

import pytest

from lodestrata.llm import queries
from tests.test_tables import folder


@pytest.mark.parametrize("kind", ["empty", "null"])
def test_every_query_stands(spark, tmp_path, kind):
    at = folder(spark, str(tmp_path), kind)
    wrong = []
    for name, q in queries.queries().items():
        try:
            q(spark, at).collect()
        except Exception as e:  # noqa: BLE001
            wrong.append((name, str(e)[:200]))
    assert not wrong


def test_statements_belong_to_queries():
    assert set(queries.oracle_sql()) <= set(queries.queries())
