"""Every registered query against its SQL, plus plan rules that hold for all of them."""

import oracle
import pytest

from rowmill.plans import load
from rowmill.session import scratch_path, scratch_scope, shared_dir

QUERIES, SQL = load()
# A join without keys, or Python per row, must not appear anywhere.
FORBIDDEN = ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython")


@pytest.fixture(scope="module")
def con(sf):
    return oracle.connect(sf)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, sf, con):
    seen = []

    def run(session, folder):
        df = QUERIES[name](session, folder)
        seen.append(df)
        return df

    assert name in SQL, "every query has its SQL"
    with scratch_scope(spark):
        assert oracle.compare(spark, con, sf, run, SQL[name]) == []
    plan = seen[0]._jdf.queryExecution().executedPlan().toString()
    assert [f for f in FORBIDDEN if f in plan] == []
    # A join on nothing but numbers made up for it is a product in disguise.
    assert [k for k in join_keys(seen[0]) if not any(k)] == []


def join_keys(df):
    """For each join of the analysed plan: whether each key column comes from a table, directly or by computing."""
    plan = df._jdf.queryExecution().optimizedPlan()
    out, todo = [], [plan]
    while todo:
        node = todo.pop()
        todo += [node.children().apply(i) for i in range(node.children().size())]
        if node.nodeName() == "Join" and node.condition().isDefined():
            used = node.condition().get().references()
            names = [a.name() for a in _items(used)]
            out.append([not n.startswith(("_spread", "_copy", "_salt")) for n in names])
    return out


def _items(references):
    it = references.iterator()
    while it.hasNext():
        yield it.next()


def test_no_sql_without_query():
    assert set(SQL) == set(QUERIES)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(QUERIES) <= set(__spark_entry__.queries()) and set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.parametrize(
    "name,table,columns",
    [
        ("j08_first_match", "orders", {"o_orderkey", "o_custkey", "o_totalprice", "o_orderdate"}),
        ("w01_dedup", "documents", {"doc_id", "text", "lang", "source"}),
        ("w03_first_rows", "events", {"event_id", "user_id", "ts"}),
    ],
)
def test_order_needs_no_other_columns(spark, sf, name, table, columns):
    """An order that is unique by itself does not make the scan read all columns."""
    import re

    plan = QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    schemas = [set(re.findall(r"(\w+):", m)) for m in re.findall(r"ReadSchema: struct<([^>]*)>", plan)]
    assert any(columns >= s and "o_orderkey" in s or columns >= s for s in schemas) and all(len(s) <= len(columns) for s in schemas if s & columns)


def test_scope_leaves_no_scratch(spark, sf):
    import os

    folder = shared_dir(spark).removeprefix("file:")
    before = set(os.listdir(folder))
    with scratch_scope(spark):
        kept = scratch_path(spark, "inner")
        assert QUERIES["w04_sequence_within"](spark, sf).count() > 0 and kept
        assert QUERIES["l06_levels"](spark, sf).count() > 0
    assert {f for f in set(os.listdir(folder)) - before if f.startswith("rowmill-")} == set()
