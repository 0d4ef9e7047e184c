"""Every query against its SQL on the smallest tables."""

import pytest
from compare import differences

from quarry import catalog


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, sf, name):
    if name in catalog.ORACLES:
        assert not differences(spark, catalog.QUERIES[name], catalog.ORACLES[name], sf)
    else:
        assert catalog.QUERIES[name](spark, sf).columns


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_order_of_partitions_does_not_matter(spark, sf):
    from quarry.operators import graph as G
    from quarry.plans.relations import Relations

    r = Relations(spark, sf)
    a = G.dedup_edges(r.edges()).collect()
    b = G.dedup_edges(r.edges().repartition(7, "ord")).collect()
    assert sorted(a) == sorted(b)


def test_entry_without_its_optional_part(monkeypatch):
    import importlib
    import sys

    import __spark_entry__ as e

    for m in [m for m in sys.modules if m.startswith("quarry.llm") or m == "corpus_pipeline"]:
        monkeypatch.delitem(sys.modules, m)
    monkeypatch.setitem(sys.modules, "quarry.llm", None)
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    monkeypatch.delattr("quarry.llm", raising=False)
    assert set(importlib.reload(e).queries()) == set(catalog.QUERIES)
    monkeypatch.undo()
    importlib.reload(e)
