"""Every registered query against its SQL twin, and the driver contract."""

import pytest
from oracle import compare

import __spark_entry__ as entry
from spectrel.plans import registry

SF = "/root/testdata/sf0.001"
QUERIES = {n: q for n, q in entry.queries().items() if n in registry.QUERIES}
SQL = {n: q for n, q in entry.oracle_sql().items() if n in registry.QUERIES}


#: Queries that SQL cannot state, and the tests that hold their operators against brute force.
BRUTE = {
    "forest_predictions": "test_models", "trained_split_metrics": "test_models", "trained_test_report": "test_evaluation",
    "run_from_registry": "test_runs", "trained_mixing_ablation": "test_runs", "bootstrap_by_tree": "test_bootstrap",
}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    result = compare(spark, name, QUERIES[name], SQL.get(name), SF)
    assert (name in SQL) != (name in BRUTE)
    assert result["ok"] or name in BRUTE and result["rows"] > 0, result["why"]


def test_entry(spark):
    assert entry.entry(spark).count() == 500


def test_every_oracle_has_a_query():
    assert set(SQL) <= set(QUERIES) and all(registry.COVERS[n] for n in QUERIES)
