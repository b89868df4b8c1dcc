from __future__ import annotations

import os
import time

os.environ["TZ"] = "UTC"
time.tzset()

import pytest

from paytally.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session("8", "paytally-tests")
    yield session
    session.stop()


@pytest.fixture
def interpreted(spark):
    """Many tiny jobs: compiling each plan would take longer than running it."""
    spark.conf.set("spark.sql.codegen.wholeStage", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.codegen.wholeStage", "true")
    spark.conf.set("spark.sql.shuffle.partitions", "8")
