"""Every check query against its SQL, on the smallest tables."""

import pytest

from __spark_entry__ import entry
from __spark_entry__ import oracle_sql as every_oracle
from __spark_entry__ import queries as every_query
from tests.conftest import SF_DIR
from workbench.compare import compare, connect
from workbench.oracles import ORACLES
from workbench.queries import QUERIES


def queries():
    return {n: every_query()[n] for n in QUERIES}


def oracle_sql():
    return {n: every_oracle()[n] for n in ORACLES}


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


def test_every_query_has_an_oracle():
    assert set(queries()) == set(oracle_sql())


@pytest.mark.parametrize("name", list(queries()))
def test_query(spark, con, name):
    assert compare(spark, con, queries()[name], oracle_sql()[name], SF_DIR) == ""


def test_entry_returns_rows(spark):
    assert entry(spark).count() > 0


# Streams give a plan over their written output, so only batch queries tell much here.
@pytest.mark.parametrize("name", [n for n in queries() if not n.startswith("stream_")])
def test_no_pairwise_joins(spark, name):
    plan = queries()[name](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
