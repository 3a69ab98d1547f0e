import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from bench import session  # noqa: E402

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    return session(8)


@pytest.fixture(scope="session")
def tables(spark):
    from tallyloom.catalog.registry import Tables

    return Tables(spark, DATA)


@pytest.fixture(scope="session")
def daily(spark):
    """731 days from 2023-01-01 to 2024-12-31."""
    return spark.sql("""
        SELECT CAST(d AS timestamp_ntz) AS day, CAST(date_diff(d, DATE'2023-01-01') AS bigint) AS sales
        FROM (SELECT explode(sequence(DATE'2023-01-01', DATE'2024-12-31')) AS d)""")


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()
