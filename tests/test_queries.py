import pytest

from modeloom.plans.chain_queries import ORACLES, QUERIES
from tests.oracle import check

#: What queries without SQL hold, besides having rows: for each a condition on all of them. Their operators have tests of their own.
CONDITIONS = {
    "art1_component_chain": "subject IS NOT NULL AND power > 0 AND size(split(removed, ',')) <= 2",
    "art1_line_removal": "x IS NOT NULL AND NOT isnan(x)",
    "clf1_decision_tree": "predicted IN (0, 1) AND label IN (0, 1)",
    "clf2_rbf_svm": "predicted IN (0, 1) AND probability BETWEEN 0 AND 1",
    "clf3_bagged_trees": "predicted IN (0, 1) AND label IN (0, 1)",
    "clf4_comparison": "accuracy BETWEEN 0.2 AND 1 AND f1 BETWEEN 0 AND 1",
}
#: How many rows queries without SQL have, as SQL.
SIZES = {
    "clf1_decision_tree": "SELECT count(*) FROM embeddings", "clf2_rbf_svm": "SELECT count(*) FROM embeddings", "clf3_bagged_trees": "SELECT count(*) FROM embeddings", "clf4_comparison": "SELECT 4",
    "art1_component_chain": "SELECT count(DISTINCT vec_id // 112) FROM embeddings", "art1_line_removal": "SELECT sum(n) FROM (SELECT (max(vec_id // 14 % 8) + 1) * 64 * 14 AS n FROM embeddings GROUP BY vec_id // 112)",
    "mr1_ranking_by_information": "SELECT 64", "mr3_neighbour_redundancy": "SELECT 64 * 63 / 2", "drv3_experiments_from_recordings": "SELECT 3", "drv7_audit_of_protocols": "SELECT 2", "drv2_experiment": "SELECT 1",
}


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_agrees_with_sql(spark, data, name):
    check(spark, data, QUERIES[name], ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_sql(spark, data, name):
    from tests.oracle import connect

    found = QUERIES[name](spark, data).cache()
    try:
        n = found.count()
        assert n > 0
        if name in SIZES:
            assert n == connect(data).execute(SIZES[name]).fetchone()[0]
        assert found.filter(f"NOT coalesce({CONDITIONS.get(name, 'true')}, false)").count() == 0
        assert found.distinct().count() == n or name not in SIZES
    finally:
        found.unpersist()


def test_entry():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
