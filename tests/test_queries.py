"""Every query of the first part against its SQL on the driver's tables."""

from __future__ import annotations

from pathlib import Path

import pytest

import __spark_entry__
from compare import connect, differences
from paytally.plans.oracles import SQL
from paytally.plans.queries import REGISTRY

SF_DIR = "/root/testdata/sf0.01"
QUERIES = REGISTRY

pytestmark = pytest.mark.skipif(not Path(SF_DIR).exists(), reason="no driver tables")


@pytest.fixture(scope="module")
def views():
    return connect(SF_DIR)


def test_every_query_has_its_sql():
    assert set(QUERIES) == set(SQL)
    assert set(QUERIES) <= set(__spark_entry__.queries()) and set(SQL) <= set(__spark_entry__.oracle_sql())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, views, name):
    assert differences(QUERIES[name](spark, SF_DIR), views, SQL[name]) == ""


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
