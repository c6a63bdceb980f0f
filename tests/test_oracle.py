"""Every registered query with an oracle equals DuckDB on the same tables
(sf0.001 here; the driver does the same at sf0.01)."""

import os

import pytest

import __spark_entry__ as E
from oracle import compare, duck

SF = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")
NAMES = sorted(E.oracle_sql())


@pytest.fixture(scope="module")
def con():
    return duck(SF)


def test_every_query_has_oracle_or_is_model():
    no_sql = set(E.queries()) - set(E.oracle_sql())
    # fitted models, and the training-data operators (held against brute force in their own tests)
    assert all(n.endswith("_noisy") or n[:2] == "op" or n == "pipeline" for n in no_sql), no_sql


@pytest.fixture(scope="module", autouse=True)
def one_search():
    """The grid search that five checks share runs once in this module."""
    from stayframe.plans import registry_ml
    search, held = registry_ml._search, {}

    def once(spark, d):
        if d not in held:
            held[d] = search(spark, d)
        return held[d]

    registry_ml._search = once
    yield
    registry_ml._search = search


@pytest.mark.parametrize("name", NAMES)
def test_oracle(spark, con, name):
    ok, msg = compare(E.queries()[name](spark, SF), con, E.oracle_sql()[name])
    assert ok, msg
