"""Every query against its SQL on the smallest tables; the long model fits are left out."""

import pytest
from oracle_check import compare, connect

from duskwatch.plans import registry

# Full-size model fits; covered with small settings in test_models.py.
LONG = {"boosted_trees_metrics", "unsw_evaluation", "native_2018_evaluation"}


@pytest.fixture(scope="module")
def duck(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", [n for n in registry.QUERIES if n not in LONG])
def test_query(spark, duck, sf_dir, name):
    state, note = compare(spark, duck, sf_dir, name, registry.QUERIES[name], registry.ORACLE.get(name))
    assert state in ("ok", "rows") or (state == "EMPTY" and name in registry.ORACLE), note


def test_entry_contract(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns
    assert set(entry.oracle_sql()) <= set(entry.queries())
