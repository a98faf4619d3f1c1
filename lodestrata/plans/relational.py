"""Relational queries on the star schema, in SQL, which both engines run as it stands."""

from __future__ import annotations

from lodestrata.plans.registry import Registry
from lodestrata.runtime import table

R = Registry()

_SQL = {
    "rel_pricing": "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_discount), 6) AS avg_disc, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02 00:00:00' GROUP BY l_returnflag, l_linestatus",
    "rel_top_orders": "SELECT l_orderkey, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, o_orderdate FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey WHERE c_mktsegment = 'BUILDING' GROUP BY l_orderkey, o_orderdate ORDER BY revenue DESC, l_orderkey LIMIT 10",
    "rel_region_revenue": "SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey AND s_nationkey = c_nationkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY n_name",
    "rel_forecast": "SELECT round(sum(l_extendedprice * l_discount), 2) AS revenue FROM lineitem WHERE l_discount BETWEEN 0.03 AND 0.07 AND l_quantity < 24",
    "rel_large_orders": "SELECT o_orderkey, c_custkey, round(sum(l_quantity), 2) AS qty FROM orders JOIN customer ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey, c_custkey HAVING sum(l_quantity) > 200",
    "rel_no_orders": "SELECT c_custkey, c_acctbal FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')",
    "rel_priorities": "SELECT o_orderpriority, count(*) AS n FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R') GROUP BY o_orderpriority",
    "rel_part_suppliers": "SELECT p_brand, p_size, count(DISTINCT l_suppkey) AS suppliers FROM part JOIN lineitem ON l_partkey = p_partkey WHERE p_size IN (1, 9, 19, 36) GROUP BY p_brand, p_size",
}
_TABLES = "region nation customer supplier part orders lineitem".split()


def _make(name: str, statement: str) -> None:
    @R.query(name, statement)
    def _(s, d):
        import re

        text = statement
        views = {t: table(s, d, t) for t in _TABLES if re.search(rf"\b{t}\b", statement)}
        for t in views:
            text = re.sub(rf"\b{t}\b", "{" + t + "}", text)
        return s.sql(text, **views)


for _name, _statement in _SQL.items():
    _make(_name, _statement)
