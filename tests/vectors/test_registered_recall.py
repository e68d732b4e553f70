import pytest
from orrery import queries

TABLES = "/root/testdata/sf0.01"
EXACT = {"projected_search": "cosine", "binary_search": "cosine", "ivf_inner_product_search": "inner_product"}
NAMES = [
    "scalar_quantised_search", "scalar8_quantised_search", "projected_search", "binary_search", "product_quantised_search", "rotated_product_search",
    "stored_ivf_search", "stored_product_search", "ivf_fitted_search", "ivf_product_search", "ivf_inner_product_search", "ivf_rabitq_search", "lsh_search", "forest_search",
    "graph_search_rnd", "graph_search_rrnd", "graph_search_mond", "graph_search_mrng",
]
truth = {}


def found(spark, name):
    return {(r.query_id, r.doc_id) for r in queries.QUERIES[name](spark, TABLES).collect()}


def recall(spark, name):
    metric = EXACT.get(name, "l2")
    truth[metric] = truth.get(metric) or found(spark, f"knn_{metric}")
    return len(truth[metric] & found(spark, name)) / len(truth[metric])


@pytest.mark.parametrize("name", NAMES)
def test_registered_query_reaches_its_recall(spark, name):
    got = recall(spark, name)
    print(name, round(got, 3))
    assert got >= 0.9


def test_fitted_lists_beat_those_that_sql_states(spark):
    plain, fitted = recall(spark, "ivf_search"), recall(spark, "ivf_fitted_search")
    print("ivf_search", round(plain, 3))
    assert plain < 0.9 <= fitted
