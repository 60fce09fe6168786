import pytest

from checks.compare import connect, difference
from checks.oracles import ORACLES
from checks.queries import QUERIES
from tests.conftest import MEDIUM, SMALL

# These need more entities than features, which the smallest tables do not have.
FACTORED = {"correlation_matrix", "factor_eigen", "factor_reconstruction", "factor_count", "factor_loadings",
            "variance_table", "factor_scores", "rank_factor", "rank_cv_factor", "final_ranking", "final_summary",
            "saved_models", "saved_scores", "landed_to_summary"}


@pytest.fixture(scope="module")
def duck():
    return connect(SMALL)


@pytest.fixture(scope="module")
def larger():
    return connect(MEDIUM)


@pytest.mark.parametrize("name", sorted(FACTORED & set(ORACLES)))
def test_factor_query_equals_sql(spark, larger, name):
    got = QUERIES[name](spark, MEDIUM).toPandas()
    assert difference(got, larger.execute(ORACLES[name]).fetchdf()) is None


def test_every_statement_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(set(ORACLES) - FACTORED))
def test_query_equals_sql(spark, duck, name):
    got = QUERIES[name](spark, SMALL).toPandas()
    assert difference(got, duck.execute(ORACLES[name]).fetchdf()) is None
